"""Proposals merged in one walk over each document give what the steps over tables give, and write nothing."""

from __future__ import annotations

import pytest

from folioscope.operators import concepts as cc
from folioscope.operators import context as cx
from folioscope.operators import paths as ps
from folioscope.operators import replies as rp
from folioscope.operators import whole as wh
from folioscope.plans import catalogue
from folioscope.sources import store as st
from tests.test_whole import LONG, TEXTS, same

MORE = [
    "Deep learning uses C++ code. C++ code is a language. The e.g. rule. A B-tree index uses B-trees. B-tree indices are kinds of data-set views. Café au lait is a drink, known as café au lait.",
    "SQL engines run. A SQL engine is based on the relational algebra. relational algebra: sets. Relational-algebra uses tuple of tuple of tuples. An engine requires relational algebra for tuples.",
]
PROPOSED = [
    "Networks", "graph", " \"data set\" ", "the", "of the", "zzq unheard phrase", "rule", "Policies", "POLICY", "system", "Café", "cafés", "kelvin scale", "e.g. rule", "C++ code", "c++",
    "B-tree", "b-tree index", "Café au lait", "SQL engines", "relational algebra", "tuple of tuple", "tree", "Tree3", "parts of graphs", "istanbul city", "x", "12", "data data", "item one", "the kelvin", "nodes",
    "box boxes", "long line that goes on and", "a  set", None, "", "Is A", "graph theory uses", "theory", "networks",
]


@pytest.fixture(scope="module")
def both(spark):
    rows = [(k, 1, t) for k, t in enumerate([*TEXTS, LONG, *MORE])] + [(3, 1, "Second row of one id. Data is a set.\nA set uses data.")]
    pages = spark.createDataFrame(rows, "doc_id long, page int, text string")
    old, new = cc.Analysis(cx.Context(pages, kind="text")), wh.Analysis(pages)
    asked = [(d, k, raw) for d, _, _ in rows[:-1] if d != 4 for k, raw in enumerate(PROPOSED[::-1] if d % 2 else PROPOSED)]
    asked = spark.createDataFrame(asked, "doc_id long, ord int, raw string")
    topics, edges, verdicts = rp.merge(old, asked)
    found, heard = rp.sought(old, topics)
    intros = st.stored(ps.introductions(heard), "intros", "doc_id")
    steps = ps.learning_path(topics, intros, st.stored(ps.prerequisite_edges(old.ctx, topics, found, heard), "edges", "doc_id"))[0]
    return {"verdicts": verdicts, "topics": topics, "edges": edges, "steps": steps}, wh.refine(new, asked, *wh.REFINED)


@pytest.mark.parametrize("name", list(wh.REFINED))
def test_a_walk_gives_the_rows_of_the_steps(both, name):
    old, new = both
    assert old[name].count()
    same(old[name], wh.unfolded(new, name))


def test_refined_paths_write_only_the_analysis(spark, sf, monkeypatch):
    """The steps wrote eleven tables more and took most of the time."""
    made = []
    for module in (cx, cc, ps, rp, wh, st, catalogue.st):
        monkeypatch.setattr(module, "stored", lambda df, name="step", *args, of=module.stored, **kw: made.append(name) or of(df, name, *args, **kw))
    monkeypatch.setattr(catalogue, "_MEMO", {})
    assert catalogue.queries()["llm_refine_path"](spark, sf).count()
    assert made == ["analysis"]


@pytest.mark.parametrize("text", [*TEXTS, *MORE, "a", " a1-b ", "\ud800 x", "x²y \U0001f600z"])
def test_word_bounds_are_those_of_the_pattern(text):
    low = wh.folded(text)
    assert list(zip(*wh.word_bounds(low), strict=True)) == [m.span() for m in wh.TOKENS.finditer(low)]
