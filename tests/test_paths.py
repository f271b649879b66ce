"""Ways between concepts, chunks and terms against plain Python."""

from __future__ import annotations

import random

import pytest

from folioscope.operators import concepts as cc
from folioscope.operators import context as cx
from folioscope.operators import paths as ps
from folioscope.plans import catalogue


def longest(edges):
    """The longest way between any two nodes of an acyclic graph, by memory."""
    after = {}
    for u, v in edges:
        after.setdefault(u, set()).add(v)
    memo = {}

    def ways(u):
        if u not in memo:
            memo[u] = {}
            for v in after.get(u, ()):
                memo[u][v] = max(memo[u].get(v, 0), 1)
                for w, n in ways(v).items():
                    memo[u][w] = max(memo[u].get(w, 0), n + 1)
        return memo[u]

    return {(u, v): n for u in after for v, n in ways(u).items()}


def frame(spark, edges):
    return spark.createDataFrame([(d, u, v) for d, e in edges.items() for u, v in e], "doc_id int, source string, target string")


def test_long_chains_and_random_graphs(spark):
    rnd = random.Random(1)
    graphs = {0: [(f"n{i:03}", f"n{i + 1:03}") for i in range(200)]}
    for d in range(1, 6):
        graphs[d] = sorted({(f"n{a:02}", f"n{b:02}") for a, b in (sorted(rnd.sample(range(14), 2)) for _ in range(30))})
    edges = frame(spark, graphs)
    reach = ps.reachability(edges)
    want = {(d, u, v): n for d, e in graphs.items() for (u, v), n in longest(e).items()}
    assert {(r.doc_id, r.source, r.target): r.hops for r in reach.collect()} == want
    kept = {(r.doc_id, r.source, r.target) for r in ps.transitive_reduction(edges, reach).collect()}
    assert kept == {(d, u, v) for d, e in graphs.items() for u, v in e if want[d, u, v] == 1}


def test_a_cycle_is_an_error(spark):
    with pytest.raises(ValueError, match="cycle"):
        ps.reachability(frame(spark, {3: [("a", "b"), ("b", "c"), ("c", "a")]}))


def test_ways_between_concepts_of_all_documents(spark, sf):
    edges = {}
    for r in catalogue.queries()["learning_path_edges"](spark, sf).collect():
        edges.setdefault(r.doc_id, []).append((r.source, r.target))
    want = {(d, u, v): n for d, e in edges.items() for (u, v), n in longest(e).items()}
    assert want and {(r.doc_id, r.source, r.target): r.hops for r in catalogue.queries()["concept_reachability"](spark, sf).collect()} == want
    level = {}
    for (d, _, v), n in want.items():
        level[d, v] = max(level.get((d, v), 0), n)
    got = {(r.doc_id, r.term): r.level for r in catalogue.queries()["concept_levels"](spark, sf).collect()}
    assert got == {k: level.get(k, 0) for k in got} and set(level) <= set(got)
    steps = {(r.doc_id, r.term): r for r in catalogue.queries()["learning_path"](spark, sf).collect()}
    assert all(steps[k].level == n for k, n in got.items())
    assert all(steps[d, u].pos < steps[d, v].pos for d, u, v in want)


def test_learning_path_of_all_documents(spark, sf):
    """Edges go only where a longer way or a cycle accounts for it; the order is that of a plain choice, step by step."""
    q = catalogue.queries()
    intro = {(r.doc_id, r.term): r.intro for r in q["concept_introductions"](spark, sf).collect()}
    docs = {}
    for r in q["prereq_edges"](spark, sf).collect():
        docs.setdefault(r.doc_id, ([], [], []))[0].append((r.source, r.target))
    for r in q["learning_path_edges"](spark, sf).collect():
        docs[r.doc_id][1].append((r.source, r.target))
    for r in q["learning_path"](spark, sf).orderBy("pos").collect():
        docs.setdefault(r.doc_id, ([], [], []))[2].append(r)
    for d, (edges, kept, steps) in docs.items():
        ways, after = longest(kept), {}
        for u, v in edges:
            after.setdefault(u, set()).add(v)
        assert set(kept) <= set(edges) and all(ways[e] == 1 for e in kept)
        for u, v in set(edges) - set(kept) - set(ways):  # taken out of a cycle
            seen, todo = set(), [v]
            while todo:
                x = todo.pop()
                todo += after.get(x, set()) - seen
                seen |= after.get(x, set())
            assert u in seen
        names = [r.term for r in steps]
        total = {n: sum(u == n for u, _ in ways) for n in names}
        key = lambda n: (-total[n], intro.get((d, n), float("inf")), n)  # noqa: B023, E731
        order = []
        while len(order) < len(names):
            order.append(min((n for n in names if n not in order and all(u in order for u, v in kept if v == n)), key=key))
        assert order == names
        for r in steps:
            assert r.unlocks_total == total[r.term]
            assert r.unlocks == [n for n in names if (r.term, n) in kept] and r.prerequisites == [n for n in names if (n, r.term) in kept]
    assert any(edges for edges, _, _ in docs.values())


def plain_chunks(text, size, overlap):
    """Break positions looked up character by character."""
    breaks = [(i, 2 if text[i] == "." else 1) for i in range(len(text)) if text[i] == "\n" or text[i : i + 2] == ". "]
    at, out = 0, []
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            good = [i for i, n in breaks if at + size // 2 <= i and i + n <= end]
            end = good[-1] + 1 if good else end
        part = text[at:end].strip()
        if len(part) > 20:
            out.append((text.index(part, at), part))
        if end == len(text):
            return out
        good = [i for i, n in breaks if end - overlap <= i and i + n <= end] or [i for i in range(end - overlap, end) if text[i] == " "]
        at = good[0] + 1 if good else end - overlap
    return out


def test_chunks_and_their_pages(spark, sf):
    docs = cx.document_texts(cx.clean_pages(catalogue.texts(spark, sf)))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rnd = random.Random(2)
    rows += [(10_000 + k, "".join(rnd.choice(["word ", "x" * 90, ". ", "\n", "  ", "end. "]) for _ in range(rnd.randint(0, 200)))) for k in range(60)]
    frame_ = spark.createDataFrame([(d, t, [0, 1200, 5000]) for d, t in rows], "doc_id long, text string, page_starts array<int>")
    got = {}
    for r in cx.chunks(frame_).orderBy("doc_id", "chunk").collect():
        got.setdefault(r.doc_id, []).append((r.s, r.text))
        assert r.e - r.s == len(r.text) <= 1000
        assert r.page_start == sum(x <= r.s for x in (0, 1200, 5000)) and r.page_end == sum(x <= r.e - 1 for x in (0, 1200, 5000))
    want = {d: plain_chunks(t, 1000, 200) for d, t in rows}
    assert got == {d: x for d, x in want.items() if x}


def test_terms_that_end_in_y_and_late_capitals(spark):
    text = "The axis y crosses here. An axis  y and the axes Y differ. " + "Plain words follow now. " * 3
    ctx = cx.Context(spark.createDataFrame([(1, 1, text)], "doc_id int, page int, text string"), kind="text")
    terms = spark.createDataFrame([(1, "axis y"), (1, "y"), (1, "plain word")], "doc_id int, term string")
    found = cc.mentions(ctx, terms).groupBy("term").count().collect()
    assert {r.term: r["count"] for r in found} == {"axis y": 2, "y": 3, "plain word": 3}
    long = "a" + "b" * 1500 + "C"
    rows = spark.createDataFrame([(1, "t", long, 0)], "doc_id int, term string, surface string, at int")
    assert cc.surface_forms(rows).first().form == long


def test_pagerank_equals_a_dense_matrix(spark):
    rnd = random.Random(4)
    names, edges = {}, {}
    for d in range(6):
        names[d] = [f"t{k}" for k in range(rnd.randint(1, 12))]
        edges[d] = {(a, b): round(rnd.random(), 3) + 0.05 for i, a in enumerate(names[d]) for b in names[d][i + 1 :] if rnd.random() < 0.4}
    terms = spark.createDataFrame([(d, t, k) for d, x in names.items() for k, t in enumerate(x)], "doc_id int, term string, ord int")
    links = spark.createDataFrame([(d, *e, w) for d, x in edges.items() for e, w in x.items()], "doc_id int, source string, target string, weight double")
    got = {(r.doc_id, r.term): r.centrality for r in cc.pagerank(terms, links).collect()}
    for d, own in names.items():
        w = {(a, b): x for (a, b), x in edges[d].items()} | {(b, a): x for (a, b), x in edges[d].items()}
        out = {a: sum(x for (s, _), x in w.items() if s == a) for a in own}
        rank = dict.fromkeys(own, 1 / len(own))
        for _ in range(100):
            loose = sum(rank[a] for a in own if not out[a])
            new = {b: 0.85 * (sum(rank[a] * w.get((a, b), 0) / out[a] for a in own if out[a]) + loose / len(own)) + 0.15 / len(own) for b in own}
            moved, rank = sum(abs(new[a] - rank[a]) for a in own), new
            if moved < len(own) * 1e-6:
                break
        assert all(abs(got[d, a] - rank[a] / max(rank.values())) < 1e-5 for a in own)
