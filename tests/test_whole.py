"""The analysis of whole documents finds what the steps over tables find, and writes one table."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from folioscope.operators import concepts as cc
from folioscope.operators import context as cx
from folioscope.operators import paths as ps
from folioscope.operators import whole as wh
from folioscope.plans import catalogue

TEXTS = [
    "",
    "the the the",
    "data data data data is a data. Data data: x y",
    'data-set is a data set. Data set means data  sets.\nThe data set, known as a "data set", uses data.',
    "Networks are built. A network is a kind of graph. Graphs (directed) are the\tbasis.\rGraph theory uses networks. Network: a graph. Of course, a network is a graph.",
    "café naïve cafés. Café is a place. x² alpha² alpha beta‍gamma delta_eps Kelvin kelvin. The kelvin is a unit. Kelvin scale is based on kelvin.",
    "System one uses system two. system-two is derived from system one. \x1cSystem\x1d two extends system. \x85System two requires system one.",
    "policies and policy. A policy is a rule. Policies rely on rules. Rules are needed for the policy. The boys toy, toys. Bosses boxes box boxes.",
    "Page 3\nTitle Here\nthis continues\nand-\nmore text here. It ends.\n12\nContents .... 5\nhttp://x.y\n- 4 -\nAlpha beta 12\nGamma delta 13\nEpsilon zeta 14\nEta theta 15\n"
    "• item one\n1) item two\nLong line that goes on and on and on until the end of the line\nand goes on, for example: x. See Figure 3.",
    "İstanbul ıstanbul istanbul city. Istanbul city is a city. Istanbul city: big.",
]
LONG = " ".join(f"A graph{k % 7} uses tree{k % 5} nodes. Tree{k % 5} nodes, called leaves, are the parts of graphs! See table {k}." for k in range(150))


@pytest.fixture(scope="module")
def both(spark):
    rows = [(k, 1, t) for k, t in enumerate([*TEXTS, LONG])] + [(3, 1, "Second row of one id. Data is a set.\nA set uses data."), (None, 1, "A null id is a null id.")]
    pages = spark.createDataFrame(rows, "doc_id long, page int, text string")
    return cc.Analysis(cx.Context(pages, kind="text")), wh.Analysis(pages)


def same(old, new):
    cols = old.columns
    plain = lambda rows: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in map(tuple, rows.select(*cols).collect())), key=repr)
    assert [t for c, t in old.dtypes] == [dict(new.dtypes)[c] for c in cols]
    assert plain(new) == plain(old)


@pytest.mark.parametrize("name", ["candidates", "mentions", "heard", "topics", "edges"])
def test_whole_documents_give_the_rows_of_the_steps(both, name):
    same(*(getattr(a, name) for a in both))


@pytest.mark.parametrize("name", ["sections", "sentences"])
def test_whole_documents_are_cut_as_the_steps_cut_them(both, name):
    same(*(getattr(a.ctx, name).where("doc_id is not null").drop("title") for a in both))


@pytest.fixture(scope="module")
def paths(both):
    old, new = both
    edges = ps.prerequisite_edges(old.ctx, old.topics, old.mentions, old.heard)
    steps, kept = ps.learning_path(old.topics, ps.introductions(old.heard), edges)
    return (edges, steps, kept, ps.reachability(kept)), wh.Path(new.rows)


@pytest.mark.parametrize(("k", "name"), [(0, "edges"), (1, "steps"), (2, "kept"), (3, "ways")])
def test_paths_of_whole_documents_are_those_of_the_steps(paths, k, name):
    same(paths[0][k], getattr(paths[1], name))


def test_evidence_of_whole_documents_is_that_of_the_steps(both, paths):
    (old, new), ((_, steps, kept, _), _) = both, paths
    same(ps.concept_evidence(old.ctx, old.topics, old.mentions, steps, kept, heard=old.heard).select(*wh.concept_evidence(new).columns), wh.concept_evidence(new))


def test_relations_of_whole_documents_are_those_of_the_steps(both, paths):
    (old, new), ((_, _, kept, _), _) = both, paths
    pairs = old.edges.select("doc_id", F.col("source").alias("a"), F.col("target").alias("b"))
    same(ps.relation_evidence(old.ctx, pairs, old.mentions, kept), wh.relation_evidence(new))


def test_only_the_first_shared_sentences_state_a_dependency():
    for gap, stated in ((ps.SHARED - 1, True), (ps.SHARED, False)):
        said = [(0, 9, "Plain alpha goes along with a plain omega here.")] * gap + [(0, 10, "The omega relies on alpha in all of these cases.")]
        found = {t: {s: [(text.index(t), text.index(t) + 5)] for s, (_, _, text) in enumerate(said)} for t in ("alpha", "omega")}
        heard = {t: [(s, size, False) for s, (_, size, _) in enumerate(said)] for t in found}
        edges = wh.prerequisites([("alpha", "core"), ("omega", "core")], found, heard, said)[1]
        assert [e[3] for e in edges] == (["stated_dependency"] if stated else [])


def test_a_statement_can_hold_a_match_that_is_no_mention():
    """Of "tree tree trees" only the first two words are a mention; the statement has the last two."""
    text = "Here every plain tree tree trees uses good grass of all kinds."
    found = {"tree tree": {0: [(text.index("tree"), text.index("tree") + 9)]}, "grass": {0: [(text.index("grass"), text.index("grass") + 5)]}}
    edges = wh.prerequisites([("grass", "core"), ("tree tree", "core")], found, {t: [(0, 12, False)] for t in found}, [(0, 12, text)])[1]
    assert [(e[0], e[1], e[3]) for e in edges] == [("grass", "tree tree", "stated_dependency")]


def test_topics_write_one_table(spark, sf, monkeypatch):
    """The nine tables of the steps, most with the text in them, were the disk that failed."""
    made = []
    for module in (cx, cc, wh):
        monkeypatch.setattr(module, "stored", lambda df, name="step", *args, of=module.stored, **kw: made.append(name) or of(df, name, *args, **kw))
    monkeypatch.setattr(catalogue, "_MEMO", {})
    assert catalogue.queries()["concept_topics"](spark, sf).count()
    assert made == ["analysis"]


@pytest.mark.parametrize(("x", "places", "wanted"), [(0.0625, 3, 0.063), (0.5, 3, 0.5), (2.5e-10, 9, 0.0), (5e-10, 9, 1e-9), (0.0005, 3, 0.001), (1 / 3, 3, 0.333)])
def test_half_up(x, places, wanted):
    assert wh.half_up(x, places) == wanted
