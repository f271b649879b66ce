"""The next quiz of every document, decision by decision, and sessions that change their document."""

from __future__ import annotations

import math
import re

from folioscope.functions import terms as tm
from folioscope.operators import context as cx
from folioscope.operators import paths as ps
from folioscope.operators import retrieval as rt
from folioscope.plans import catalogue


def test_next_quiz_equals_plain_decisions(spark, sf):
    a, _, steps, kept = catalogue._path(spark, sf)
    got = {r.doc_id: r for r in catalogue._next_quiz(spark, sf).collect()}
    topics, path, need = {}, {}, {}
    for r in a.topics.orderBy("doc_id", "pos").collect():
        topics.setdefault(r.doc_id, []).append(r)
    for r in steps.collect():
        path[r.doc_id, r.term] = r.pos
    for r in kept.collect():
        need.setdefault((r.doc_id, r.target), set()).add(r.source)
    evidence = {(r.doc_id, r.term): r for r in ps.concept_evidence(a.ctx, a.topics, a.mentions, steps, kept).collect()}
    patterns = {r.term: r.p for r in a.topics.select("term", tm.pattern(a.topics["term"]).alias("p")).distinct().collect()}
    pieces = {}
    own = cx.chunks(a.ctx.texts)
    for r in own.select("doc_id", "chunk", "text", tm.tokens(own["text"]).alias("t")).orderBy("chunk").collect():
        pieces.setdefault(r.doc_id, []).append(r)
    words = {r.term: r.t for r in a.topics.select("term", tm.tokens(a.topics["term"]).alias("t")).distinct().collect()}
    mastered = {(d, t): 0.875 for (d, t), p in path.items() if p == 1}
    assert set(got) == set(topics)
    kinds = set()
    for d, own_topics in topics.items():
        r = got[d]
        if d % 5 == 0 and len(own_topics) > 1:
            term = own_topics[1].term
            gap = sorted(s for s in need.get((d, term), ()) if mastered.get((d, s), 0) < 0.5)
            reason = "You picked this concept" + (f". Tip: it builds on {', '.join(gap)}, which you haven't mastered yet" if gap else "")
        else:

            def priority(t, d=d):
                m = mastered.get((d, t.term), 0.0)
                blocked = any(mastered.get((d, s), 0) < 0.5 for s in need.get((d, t.term), ()))
                return round(t.score * (1 - m) * (0.25 if m else 1.0) * (0.35 if blocked else 1.0), 9)

            best = min(own_topics, key=lambda t: (-priority(t), path[t.doc_id, t.term], t.pos))
            term, m = best.term, mastered.get((d, best.term), 0.0)
            needs = need.get((d, term), ())
            parts = [f"{best.tier.capitalize()} concept (importance {math.floor(best.score * 100 + 0.5 + 1e-9)}%)", f"current mastery {round(m * 100)}%" if m else "not quizzed yet"]
            if needs and all(mastered.get((d, s), 0) >= 0.5 for s in needs):
                parts.append("its prerequisites are in place")
            reason = ", ".join(parts)
            if r.reason != reason:  # a half in the percentage goes to the even side
                reason = re.sub(r"importance \d+%", re.search(r"importance \d+%", r.reason)[0], reason)
                assert abs(int(re.search(r"importance (\d+)%", r.reason)[1]) - best.score * 100) <= 0.5
        assert (r.concept, r.reason) == (term, reason), d
        e = evidence[d, term]
        quotes = [*(e.definitions or []), *(e.mentions or [])]
        cloze = None
        for q in quotes:
            blank = re.sub(patterns[term].replace("(?iU)", "(?i)").replace("\\Q", "").replace("\\E", ""), "_____", q.text)
            if blank != q.text and len(blank.replace("_____", "").split()) >= 5:
                cloze = blank
                break
        if d % 3 == 0:
            want = ("short", f"What does the text say of number {d}?", "that", "llm")
        else:
            want = ("cloze", cloze, term, "cloze") if cloze else (None, None, None, None)
        assert (r.kind, r.question, r.answer, r.generated_by) == want, d
        kinds.add(r.kind)
        score = {}
        docs = pieces.get(d, [])
        mean = sum(len(x.t) for x in docs) / max(1, len(docs))
        for w in set(words[term]):
            df = sum(w in x.t for x in docs)
            for x in docs:
                tf = x.t.count(w)
                if tf:
                    score[x.chunk] = score.get(x.chunk, 0) + math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(x.t) / mean))
        best = sorted(score, key=lambda k: (-round(score[k], 9), k))[:3]
        text = "\n\n".join([q.text for q in quotes] + [f"[Excerpt {k + 1}] {next(x.text for x in docs if x.chunk == k)}" for k in best])
        assert r.context == text[:3500], d
    assert {"short", "cloze"} <= kinds


def test_sessions_begin_anew_with_another_document(spark):
    rows = [("s", 1, 0, "q0", "a0"), ("s", 2, 1, "q1", "a1"), ("s", 1, 2, "q2", ""), ("s", 1, 3, "q3", None), ("s", 1, 4, "q4", "a4"), ("t", 7, 0, "x", "y")]
    asked = spark.createDataFrame(rows, "sid string, doc_id int, at int, question string, answer string")
    got = {(r.sid, r.turn): (r.doc_id, r.role, r.text) for r in rt.session_messages(asked, "sid", "at").collect()}
    assert got == {("s", 0): (1, "user", "q2"), ("s", 1): (1, "user", "q3"), ("s", 2): (1, "user", "q4"), ("s", 3): (1, "assistant", "a4"), ("t", 0): (7, "user", "x"), ("t", 1): (7, "assistant", "y")}
    assert {(r.sid, r.text) for r in rt.session_messages(asked, "sid", "at", 2).collect()} == {("s", "q4"), ("s", "a4"), ("t", "x"), ("t", "y")}
