"""DuckDB SQL for the queries of the catalogue that SQL can express, over the same tables."""

from __future__ import annotations

from folioscope.functions import terms as tm
from folioscope.functions.lexicon import content_stops, english
from folioscope.plans import fixtures as fx
from folioscope.plans.tables import BLOCK

NL = "chr(10)"


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, (int, float)):
        return str(v)
    return "'" + v.replace("'", "''") + "'"


def values(columns: str, rows) -> str:
    """A fixed table; columns as 'name type, ...'."""
    cols = [c.split() for c in columns.split(", ")]
    body = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    return f"SELECT {', '.join(f'CAST({n} AS {t}) AS {n}' for n, t in cols)} FROM (VALUES {body}) AS v({', '.join(n for n, _ in cols)})"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def sing(w: str) -> str:
    return (
        f"CASE WHEN length({w}) <= 3 THEN {w} WHEN {w} LIKE '%ies' AND length({w}) > 4 THEN left({w}, length({w}) - 3) || 'y' "
        f"WHEN regexp_matches({w}, '(?:sses|shes|ches|xes|zes)$') THEN left({w}, length({w}) - 2) WHEN regexp_matches({w}, '(?:ss|us|is)$') THEN {w} "
        f"WHEN {w} LIKE '%s' THEN left({w}, length({w}) - 1) ELSE {w} END"
    )


def words(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, '\\s+'), lambda z: z <> ''))"


def listed(items) -> str:
    return "(" + ", ".join(map(lit, items)) + ")"


BINDERS = f"(SELECT source || '/' || CAST(doc_id // {BLOCK} AS VARCHAR) AS doc_id, CAST(row_number() OVER (PARTITION BY source, doc_id // {BLOCK} ORDER BY doc_id) AS INT) AS page, coalesce(text, '') AS text FROM documents)"
LINES = f"(SELECT doc_id, page, i, ls[i] AS line FROM (SELECT doc_id, page, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, page, string_split(text, {NL}) AS ls FROM {BINDERS})))"
NORM = "trim(regexp_replace(lower(line), '[^a-z0-9\\s]', '', 'g'))"
REPEATED = f"""(SELECT doc_id, norm, n_pages FROM (SELECT doc_id, norm, count(DISTINCT page) AS n_pages FROM (SELECT doc_id, page, {NORM} AS norm FROM {LINES}) WHERE length(norm) > 2 GROUP BY ALL)
JOIN (SELECT doc_id, count(*) AS pages FROM {BINDERS} GROUP BY doc_id) USING (doc_id) WHERE pages >= 3 AND n_pages >= greatest(2, floor(pages * 0.3)))"""
DOC_LINES = f"(SELECT doc_id, unnest(string_split(coalesce(text, ''), {NL})) AS line FROM documents)"
METADATA = (
    r"(?i)^\s*(?:\d+\s*$|-\s*\d+\s*-\s*$|page\s+\d+(?:\s+of\s+\d+)?\s*$|\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}\s*$"
    r"|(?:january|february|march|april|may|june|july|august|september|october|november|december)\s+\d"
    r"|\S+@\S+\.\S+\s*$|https?://\S+\s*$|doi[:\s]|(?:figure|fig|table|chapter|module|exercise)\s+\d)"
)
PAGE_REFERENCE = r"(?i)(?:(?:\.{3,}|…+)\s*\d{1,4}\s*$|\(?\b(?:page|pg\.?|p\.)\s*\d{1,4}\)?\s*$)"
IS_METADATA = f"({strip('line')} <> '' AND (regexp_matches({strip('line')}, {lit(METADATA)}) OR ({words('line')} <= 3 AND regexp_matches(line, '\\d')) OR regexp_matches({strip('line')}, {lit(PAGE_REFERENCE)})))"
NUMBERED = f"regexp_matches({strip('line')}, '^\\D.{{2,100}}?\\s\\d{{1,4}}$')"

SECTIONS = """WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(text, '') AS text, CAST(0 AS INT) AS sec, CAST(0 AS INT) AS start FROM documents
  UNION ALL
  SELECT doc_id, text, CAST(sec + 1 AS INT), CAST(CASE WHEN greatest(a, b) > 0 THEN start + 1500 + greatest(a, b) ELSE start + 1500 END AS INT)
  FROM (SELECT *, strpos(substring(text, start + 1501, 300), '. ') AS a, strpos(substring(text, start + 1501, 300), chr(10)) AS b FROM w WHERE start + 1500 < length(text))
), s AS (SELECT doc_id, sec, start, CAST(coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY sec), length(text)) AS INT) AS stop, text FROM w),
secs AS (SELECT doc_id, sec, start, stop, substring(text, start + 1, stop - start) AS part FROM s)
"""
RUNS = "regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+')"
SENTENCES = f"""(SELECT doc_id, {strip('piece')} AS text FROM (SELECT doc_id, unnest(string_split(regexp_replace(line, '([.!?])(\\s+["''“‘(\\[]?[A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1))) AS piece FROM {DOC_LINES}) WHERE {strip('piece')} <> '')"""
TOKENS = f"list_transform(list_filter(regexp_extract_all(lower({{x}}), '[a-z0-9]+(?:[''-][a-z0-9]+)*'), lambda t: length(t) > 1 AND t NOT IN {listed(english())}), lambda t: {sing('t')})"
PROBES = {"the": "the(?:s|es)?", "and": "and(?:s|es)?", "of the": "of(?:[^\\S\\n]|-)+the(?:s|es)?", "is the": "is(?:[^\\S\\n]|-)+the(?:s|es)?", "er": "er(?:s|es)?", "this": "this(?:s|es)?"}


def mentions(text: str, body: str) -> str:
    return f"len(regexp_extract_all(replace({text}, '_', '.'), '(?i)\\b{body}\\b'))"


BM25 = f"""WITH d AS (SELECT doc_id, {TOKENS.format(x="coalesce(text, '')")} AS t FROM documents),
len_ AS (SELECT doc_id, len(t) AS length FROM d), tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY ALL),
n AS (SELECT count(*) AS n, avg(length) AS mean FROM len_), idf AS (SELECT term, sum(tf) AS tf, count(*) AS df, ln(1 + (max(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, n GROUP BY term)
"""
SCORES = """, q AS (SELECT DISTINCT {key}, unnest({tokens}) AS term FROM {asked}),
scores AS (SELECT {key}, doc_id, sum(idf * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * length / mean))) AS score FROM q JOIN tf USING (term) JOIN idf USING (term) JOIN len_ USING (doc_id), n GROUP BY ALL)
"""
BENCH = BM25 + SCORES.format(key="item_id", tokens=TOKENS.format(x="text"), asked="benchmark")
UNIT = "list_transform(CAST({v} AS DOUBLE[]), lambda x: x / sqrt(list_sum(list_transform(CAST({v} AS DOUBLE[]), lambda y: y * y))))"
NEAREST = f"""u AS (SELECT vec_id, {UNIT.format(v='embedding')} AS v FROM embeddings),
near AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.v, b.v) AS score FROM u a, u b WHERE a.vec_id % 50 = 0)
"""

FOLD = """WITH log AS (SELECT user_id, event_type AS concept, list({'mastery': CAST(0 AS DOUBLE), 'attempts': 0, 'correct': 0, 'exposures': 0, 'ease': CAST(2.5 AS DOUBLE), 'interval': 0, 'reps': 0, 'last_score': CAST(NULL AS DOUBLE),
  'due': CAST(NULL AS TIMESTAMP), 'ts': CAST(ts AS TIMESTAMP), 'score': CASE WHEN event_type <> 'view' THEN least(value / 100, 1.0) END} ORDER BY ts, event_id) AS es FROM events GROUP BY ALL),
folded AS (SELECT user_id, concept, list_reduce(list_prepend({'mastery': CAST(0 AS DOUBLE), 'attempts': 0, 'correct': 0, 'exposures': 0, 'ease': CAST(2.5 AS DOUBLE), 'interval': 0, 'reps': 0, 'last_score': CAST(NULL AS DOUBLE),
  'due': CAST(NULL AS TIMESTAMP), 'ts': CAST(NULL AS TIMESTAMP), 'score': CAST(NULL AS DOUBLE)}, es), lambda s, e: CASE WHEN e.score IS NULL THEN
  {'mastery': s.mastery, 'attempts': s.attempts, 'correct': s.correct, 'exposures': s.exposures + 1, 'ease': s.ease, 'interval': s.interval, 'reps': s.reps, 'last_score': s.last_score, 'due': s.due, 'ts': e.ts, 'score': e.score}
  ELSE {'mastery': floor((s.mastery + 0.5 * (e.score - s.mastery)) * 10000.0 + 0.5) / 10000.0, 'attempts': s.attempts + 1, 'correct': s.correct + CASE WHEN e.score >= 0.6 THEN 1 ELSE 0 END, 'exposures': s.exposures,
  'ease': floor(greatest(1.3, s.ease + 0.1 - (5 - round_even(e.score * 5, 0)) * (0.08 + (5 - round_even(e.score * 5, 0)) * 0.02)) * 1000.0 + 0.5) / 1000.0,
  'interval': CASE WHEN round_even(e.score * 5, 0) < 3 OR s.reps = 0 THEN 1 WHEN s.reps = 1 THEN 6 ELSE CAST(round_even(s.interval * s.ease, 0) AS INT) END,
  'reps': CASE WHEN round_even(e.score * 5, 0) < 3 THEN 0 ELSE s.reps + 1 END, 'last_score': floor(e.score * 1000.0 + 0.5) / 1000.0,
  'due': e.ts + to_days(CASE WHEN round_even(e.score * 5, 0) < 3 OR s.reps = 0 THEN 1 WHEN s.reps = 1 THEN 6 ELSE CAST(round_even(s.interval * s.ease, 0) AS INT) END), 'ts': e.ts, 'score': e.score} END) AS s FROM log),
state AS (SELECT user_id, concept, s.mastery AS mastery, s.attempts AS attempts, s.correct AS correct, s.exposures AS exposures, s.ease AS ease, s.interval AS interval, s.reps AS reps, s.due AS due, s.last_score AS last_score,
  CASE WHEN s.attempts > 0 AND s.mastery >= 0.8 THEN 'mastered' WHEN s.attempts > 0 THEN 'learning' WHEN s.exposures > 0 THEN 'explored' ELSE 'unseen' END AS status FROM folded)
"""
COURSE = FOLD + f""", course AS ({values('term VARCHAR, tier VARCHAR, score DOUBLE, pos INT', fx.COURSE)}), need AS ({values('source VARCHAR, target VARCHAR', fx.COURSE_EDGES)}),
rows_ AS (SELECT u.user_id, c.*, coalesce(s.status, 'unseen') AS status, coalesce(s.attempts, 0) AS attempts, coalesce(s.mastery, 0.0) AS mastery, s.due FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN course c LEFT JOIN state s ON s.user_id = u.user_id AND s.concept = c.term)
"""
REACH = f"""WITH RECURSIVE e AS ({values('source VARCHAR, target VARCHAR', fx.DAG)}), r AS (SELECT source, target, 1 AS hops FROM e UNION ALL SELECT r.source, e.target, r.hops + 1 FROM r JOIN e ON e.source = r.target),
reach AS (SELECT 'd' AS doc_id, source, target, CAST(max(hops) AS INT) AS hops FROM r GROUP BY ALL)
"""
REPLY = {
    "thanks": "You're welcome. Ask me anything else about the document whenever you're ready.",
    "goodbye": "Good luck with your studying. Your progress on this document is saved.",
    "agreement": "Sounds good. What would you like to explore next?",
    "greeting": "Hey! I'm assistant, your document analyst. Ask me anything about the document you've uploaded.",
}
PERCENT = "CAST(CAST(round_even(round({x} * 100, 9), 0) AS INT) AS VARCHAR) || '%'"
HASH = f"sha256({strip('coalesce(text, chr(32))')})"


def _defined() -> str:
    verbs = r"(?:(?:is|are|was|were)\s+(?:an?|the|one of|any|when|how|what|called|known as|defined as)|refers? to|means?|denotes?|describes?|represents?|can be (?:defined|described) as)"
    parts = []
    for t in fx.DEFINED:
        b = rf"\b{t}(?:s|es)?\b"
        rx = (
            rf"(?i)^[^\p{{L}}\p{{N}}_]*(?:[^,.;]{{0,40}},\s*)?(?:an?\s+|the\s+)?{b}\s*(?:\([^)]*\)\s*)?,?\s+{verbs}\b"
            rf"|(?:defined as|known as|called|termed|referred to as)\s+(?:an?\s+|the\s+)?[\"'“]?{b}|^[^\p{{L}}\p{{N}}_]*{b}\s*[:–—-]\s+\S"
        )
        parts.append(f"SELECT doc_id, {lit(t)} AS term, count(*) AS n FROM {SENTENCES} WHERE regexp_matches(text, {lit(rx)}) GROUP BY doc_id")
    return " UNION ALL ".join(parts)


TFIDF = SECTIONS + f""", t AS (SELECT doc_id, sec, list_filter({RUNS.format(x='part')}, lambda x: regexp_full_match(x, '[a-z]{{2,}}') AND x NOT IN {listed(content_stops())}) AS w FROM secs),
g AS (SELECT doc_id, sec, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM t), c AS (SELECT doc_id, sec, term, count(*) AS tf FROM g GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n FROM secs GROUP BY doc_id), v AS (SELECT doc_id, term, count(*) AS df, sum(tf) AS total FROM c GROUP BY ALL),
v2 AS (SELECT v.*, n.n, (df >= CASE WHEN n < 8 THEN 1 ELSE 2 END AND df <= CASE WHEN n < 3 THEN 1.0 WHEN n < 8 THEN 0.95 ELSE 0.7 END * n AND CASE WHEN n < 3 THEN 1.0 WHEN n < 8 THEN 0.95 ELSE 0.7 END * n >= CASE WHEN n < 8 THEN 1 ELSE 2 END) AS ok FROM v JOIN n USING (doc_id)),
v3 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY total DESC, term) AS k FROM (SELECT *, max(CAST(ok AS INT)) OVER (PARTITION BY doc_id) AS any_ok FROM v2) WHERE ok OR any_ok = 0),
x AS (SELECT c.doc_id, c.sec, c.term, v3.n, c.tf * (ln((1 + v3.n) / (1 + v3.df)) + 1) AS x FROM c JOIN v3 USING (doc_id, term) WHERE k <= 50),
y AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id, sec)) AS y FROM x)
SELECT doc_id, term, round(sum(y) / max(n), 6) AS score FROM y GROUP BY doc_id, term"""
PLAIN = "regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\\b.*?</script>|<style\\b.*?</style>', ' ', 'g'), '<[^>]*>', chr(10), 'g')"
HEAD = "regexp_replace(regexp_extract(coalesce(html, ''), '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')"
FUSED = f"""{BM25}{SCORES.format(key='query_id', tokens=TOKENS.format(x='text'), asked="(SELECT doc_id AS query_id, coalesce(text, '') AS text FROM documents WHERE doc_id % 50 = 0)")},
kw AS (SELECT query_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scores) WHERE rank <= 20 AND score > 0),
{NEAREST}, de AS (SELECT query_id, vec_id AS doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM near) WHERE rank <= 20),
f AS (SELECT query_id, doc_id, sum(1.0 / (60 + rank)) AS score, min(l * 1000 + rank) AS first FROM (SELECT *, 0 AS l FROM de UNION ALL SELECT *, 1 AS l FROM kw) GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first) AS pos FROM f)
SELECT p.query_id, p.doc_id, round(p.score, 9) AS score, CAST(pos AS INT) AS pos, CAST(de.rank AS INT) AS dense_rank, CAST(kw.rank AS INT) AS keyword_rank FROM p LEFT JOIN de USING (query_id, doc_id) LEFT JOIN kw USING (query_id, doc_id) WHERE pos <= 5"""

# Text documents as the engine sees them: cleaned, in sections and sentences, with their candidate terms and mentions.

IS_LOWER, IS_UPPER = "'^\\p{Ll}'", "'^\\p{Lu}'"
LIST_ITEM = r"'^(?:[•\-–*▪●◦]|\d+[.)])\s'"


def kept_lines(ls: str) -> str:
    """The lines of a list that carry prose: no metadata, nor what ends in a number on a contents page."""
    full = f"list_filter({ls}, lambda line: {strip('line')} <> '')"
    contents = f"len(list_filter({full}, lambda line: {NUMBERED})) >= greatest(3.0, 0.3 * len({full}))"
    return f"list_filter({ls}, lambda line: NOT ({IS_METADATA} OR (({contents}) AND {strip('line')} <> '' AND {NUMBERED})))"


def reflowed(lines: str) -> str:
    """The segments of a list of lines, joined by line feeds."""
    one = "{'done': CAST([] AS VARCHAR[]), 'buf': CAST(%s AS VARCHAR)}"
    ends = (
        f"CASE WHEN right(s.buf, 1) IN ('.', '!', '?', ':', ';') THEN NOT regexp_matches(e.buf, {IS_LOWER}) ELSE regexp_matches(e.buf, {LIST_ITEM}) "
        f"OR (length(s.buf) < 60 AND {words('s.buf')} <= 8 AND right(s.buf, 1) NOT IN (',', '(') AND regexp_matches(e.buf, {IS_UPPER})) END"
    )
    fold = (
        f"list_reduce(list_prepend({one % repr('')}, list_transform({lines}, lambda x: {one % strip('x')})), lambda s, e: "
        "CASE WHEN e.buf = '' AND s.buf <> '' THEN {'done': list_append(s.done, s.buf), 'buf': ''} WHEN e.buf = '' THEN s "
        "WHEN s.buf = '' THEN {'done': s.done, 'buf': e.buf} "
        f"WHEN right(s.buf, 1) = '-' AND regexp_matches(e.buf, {IS_LOWER}) THEN {{'done': s.done, 'buf': left(s.buf, length(s.buf) - 1) || e.buf}} "
        f"WHEN {ends} THEN {{'done': list_append(s.done, s.buf), 'buf': e.buf}} ELSE {{'done': s.done, 'buf': s.buf || ' ' || e.buf}} END)"
    )
    return f"array_to_string(list_filter(list_append({fold}.done, {fold}.buf), lambda z: z <> ''), {NL})"


STRIPPED = f"""(SELECT doc_id, page, coalesce(list(line ORDER BY i) FILTER (WHERE r.norm IS NULL), []) AS ls FROM (SELECT *, {NORM} AS own FROM {LINES}) l
LEFT JOIN (SELECT doc_id AS d, norm FROM {REPEATED}) r ON r.d = l.doc_id AND r.norm = l.own GROUP BY doc_id, page)"""
PAGES = f"(SELECT doc_id, page, {reflowed('ls')} AS text FROM (SELECT doc_id, page, {kept_lines('ls')} AS ls FROM {STRIPPED}))"
TEXTS = f"(SELECT doc_id, {reflowed('ls')} AS text FROM (SELECT doc_id, {kept_lines('ls')} AS ls FROM (SELECT doc_id, string_split(coalesce(text, ''), {NL}) AS ls FROM documents)))"
#: clean: texts; secs: their sections; sents: their sentences with offsets.
STUDY = f"""WITH RECURSIVE clean AS MATERIALIZED (SELECT * FROM {{texts}}), w AS (
  SELECT doc_id, text, CAST(0 AS INT) AS sec, CAST(0 AS INT) AS start FROM clean
  UNION ALL
  SELECT doc_id, text, CAST(sec + 1 AS INT), CAST(CASE WHEN greatest(a, b) > 0 THEN start + 1500 + greatest(a, b) ELSE start + 1500 END AS INT)
  FROM (SELECT *, strpos(substring(text, start + 1501, 300), '. ') AS a, strpos(substring(text, start + 1501, 300), chr(10)) AS b FROM w WHERE start + 1500 < length(text))
), s AS (SELECT doc_id, sec, start, CAST(coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY sec), length(text)) AS INT) AS stop, text FROM w),
secs AS MATERIALIZED (SELECT doc_id, sec, start, stop, substring(text, start + 1, stop - start) AS part FROM s),
seg AS (SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, {NL}) AS ls FROM clean))),
seg2 AS (SELECT doc_id, i, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base,
  string_split(regexp_replace(line, '([.!?])(\\s+["''“‘(\\[]?[A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS ps FROM seg),
piece AS (SELECT doc_id, i, k, ps[k] AS raw, base + coalesce(list_sum(list_transform(ps[1:k - 1], lambda z: length(z))), 0) AS base FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS k FROM seg2)),
sents0 AS (SELECT doc_id, {strip('raw')} AS text, CAST(base + length(raw) - length(regexp_replace(raw, '^\\s+', '')) AS INT) AS start, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1 AS sent FROM piece WHERE {strip('raw')} <> ''),
sents AS MATERIALIZED (SELECT z.doc_id, z.sent, z.text, z.start, secs.sec, {words('z.text')} AS words FROM sents0 z ASOF JOIN secs ON z.doc_id = secs.doc_id AND z.start >= secs.start)
"""
TERM_WORDS = "string_split(term, ' ')"
LAST = sing("ws[-1]")
BODY = (
    f"CASE WHEN len(ws) > 1 THEN array_to_string(ws[1:len(ws) - 1], '(?:[^\\S\\n]|-)+') || '(?:[^\\S\\n]|-)+' ELSE '' END || "
    "CASE WHEN last LIKE '%y' AND length(last) > 3 AND NOT regexp_matches(last, '[aeou]y$') THEN left(last, length(last) - 1) || '(?:y|ies)' ELSE last || '(?:s|es)?' END"
)
#: terms: candidate terms with patterns; found: their mentions (sent, sent_sec, at, stop, sec), by offsets.
FOUND = STUDY.format(texts=TEXTS) + ", " + TFIDF[len(SECTIONS) :].lstrip(", ").rpartition("SELECT doc_id, term, round")[0] + f""", cand AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY round(sum(y) / max(n), 9) DESC, term) AS ord FROM y GROUP BY doc_id, term),
terms AS MATERIALIZED (SELECT doc_id, term, ord, ws, {BODY} AS body, regexp_replace(last, 'y$', '') AS stem FROM (SELECT *, {LAST} AS last FROM (SELECT *, {TERM_WORDS} AS ws FROM cand))),
pair AS MATERIALIZED (SELECT t.doc_id, t.term, z.sent, z.sec AS sent_sec, z.start, replace(z.text, '_', '.') AS text, '(?i)\\b' || t.body || '\\b' AS p FROM sents z JOIN terms t ON t.doc_id = z.doc_id AND contains(lower(z.text), t.stem)),
hit AS (SELECT *, regexp_extract_all(text, p) AS hs, string_split_regex(text, p) AS gs FROM pair WHERE regexp_matches(text, p)),
one AS (SELECT doc_id, term, sent, sent_sec, hs[k] AS surface, start + list_sum(list_transform(gs[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(hs[1:k - 1], lambda h: length(h))), 0) AS at FROM (SELECT *, unnest(range(1, len(hs) + 1)) AS k FROM hit)),
found AS MATERIALIZED (SELECT one.doc_id, one.term, one.sent, one.sent_sec, one.at, one.at + length(surface) AS stop, secs.sec FROM one ASOF JOIN secs ON one.doc_id = secs.doc_id AND one.at >= secs.start)
"""
VERBS = r"(?:(?:is|are|was|were)\s+(?:an?|the|one of|any|when|how|what|called|known as|defined as)|refers? to|means?|denotes?|describes?|represents?|can be (?:defined|described) as)"
NAMED = r"(?:defined as|known as|called|termed|referred to as)"
B_ = "'\\b' || body || '\\b'"
DEFINITION = (
    f"'(?i)^[^\\p{{L}}\\p{{N}}_]*(?:[^,.;]{{0,40}},\\s*)?(?:an?\\s+|the\\s+)?' || {B_} || '\\s*(?:\\([^)]*\\)\\s*)?,?\\s+{VERBS}\\b|{NAMED}\\s+(?:an?\\s+|the\\s+)?[\"''“]?' || {B_} || "
    f"'|^[^\\p{{L}}\\p{{N}}_]*' || {B_} || '\\s*[:–—-]\\s+\\S'"
)
#: heard: the sentences of each term, and whether they define it.
HEARD = FOUND + f""", heard AS MATERIALIZED (SELECT doc_id, term, sent, words, CASE WHEN regexp_matches(text, '(?i){VERBS}\\b|{NAMED}|[:–—-]\\s+\\S') THEN regexp_matches(replace(text, '_', '.'), {DEFINITION}) ELSE FALSE END AS defines
FROM (SELECT DISTINCT doc_id, term, sent FROM found) JOIN sents USING (doc_id, sent) JOIN terms USING (doc_id, term))
"""
NESTED = """, nested AS (SELECT a.doc_id, a.term, b.term AS longer FROM terms a JOIN terms b ON a.doc_id = b.doc_id AND len(b.ws) > len(a.ws) AND contains(b.term, a.stem) AND regexp_matches(b.term, '(?i)\\b' || a.body || '\\b')),
around AS (SELECT DISTINCT nested.doc_id, nested.term, f.at, f.stop FROM nested JOIN found f ON f.doc_id = nested.doc_id AND f.term = nested.longer),
last_ AS (SELECT f.doc_id, f.term, f.at, max({'at': a.at, 'stop': a.stop}) AS z FROM found f LEFT JOIN around a ON a.doc_id = f.doc_id AND a.term = f.term AND a.at <= f.at GROUP BY ALL),
kept AS MATERIALIZED (SELECT doc_id, term FROM last_ GROUP BY ALL HAVING avg(CASE WHEN z.at IS NOT NULL AND last_.at < z.stop THEN 1.0 ELSE 0.0 END) < 0.7)
"""
TOLD = """, told AS (SELECT doc_id, term, bool_or(defines) AS definition FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, term ORDER BY sent) AS k FROM heard) WHERE k <= 300 GROUP BY ALL),
flag AS (SELECT doc_id, sec, regexp_matches(lower(part), '\\b(?:figure|fig\\.|table|diagram)\\b') AS figure, regexp_matches(lower(part), '\\b(?:for example|for instance|example:|case study)\\b') AS example FROM secs),
flags AS (SELECT doc_id, term, bool_or(figure) AS figure, bool_or(example) AS example FROM (SELECT DISTINCT doc_id, term, sec FROM found) JOIN flag USING (doc_id, sec) GROUP BY ALL)
"""
#: pr: PageRank by power iteration, a document's rows until it settles; topics: the twenty best concepts; edge: sections in common.
TOPICS = HEARD + NESTED + TOLD + f""", own AS MATERIALIZED (SELECT f.doc_id, f.sec, f.term, t.ord, count(*) AS c FROM found f JOIN kept USING (doc_id, term) JOIN terms t USING (doc_id, term) GROUP BY ALL),
size_ AS (SELECT doc_id, count(*) AS n FROM secs GROUP BY doc_id), wide AS (SELECT doc_id, sec, greatest(1, {words('part')}) AS words FROM secs),
x1 AS (SELECT own.*, n, words, count(*) OVER (PARTITION BY doc_id, term) AS df FROM own JOIN size_ USING (doc_id) JOIN wide USING (doc_id, sec)),
x2 AS (SELECT *, c / words * (ln((1 + n) / (1 + df)) + 1) AS x FROM x1), x3 AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id, sec)) AS z FROM x2),
base_ AS (SELECT doc_id, term, ord, sum(z) / max(n) AS f, max(df) / max(n) AS spread FROM x3 GROUP BY ALL),
edge AS MATERIALIZED (SELECT a.doc_id, a.term AS source, b.term AS target, count(*) / max(n) AS weight FROM own a JOIN own b ON a.doc_id = b.doc_id AND a.sec = b.sec AND a.ord < b.ord JOIN size_ ON size_.doc_id = a.doc_id GROUP BY ALL HAVING count(*) / max(n) >= 0.05),
both_ AS (SELECT doc_id, source, target, weight FROM edge UNION ALL SELECT doc_id, target, source, weight FROM edge),
link AS MATERIALIZED (SELECT doc_id, source, target, weight / sum(weight) OVER (PARTITION BY doc_id, source) AS w FROM both_),
node AS MATERIALIZED (SELECT doc_id, term, count(*) OVER (PARTITION BY doc_id) AS n, NOT EXISTS (SELECT 1 FROM link WHERE link.doc_id = b.doc_id AND link.source = b.term) AS loose FROM base_ b),
pr AS (SELECT doc_id, term, n, loose, 1.0::DOUBLE / n AS x, 0 AS turn, 1e9::DOUBLE AS err FROM node UNION ALL
  SELECT doc_id, term, n, loose, new, turn + 1, sum(abs(new - x)) OVER (PARTITION BY doc_id) FROM (
    SELECT p.*, 0.85 * (coalesce(g.s, 0) + sum(CASE WHEN loose THEN x ELSE 0 END) OVER (PARTITION BY p.doc_id) / n) + 0.15 / n AS new
    FROM pr p LEFT JOIN (SELECT q.doc_id, link.target AS term, sum(q.x * link.w) AS s FROM pr q JOIN link ON link.doc_id = q.doc_id AND link.source = q.term GROUP BY ALL) g ON g.doc_id = p.doc_id AND g.term = p.term
    WHERE p.err >= n * 1e-6 AND turn < 100)),
rank_ AS (SELECT doc_id, term, x / max(x) OVER (PARTITION BY doc_id) AS centrality FROM (SELECT doc_id, term, CASE WHEN err < n * 1e-6 THEN x ELSE 1.0 / n END AS x FROM pr QUALIFY turn = max(turn) OVER (PARTITION BY doc_id))),
sig AS (SELECT b.doc_id, b.term, b.ord, b.f / max(b.f) OVER (PARTITION BY doc_id) AS frequency, b.spread, r.centrality, CASE WHEN definition THEN 1.3 ELSE 1.0 END::DOUBLE * CASE WHEN figure THEN 1.2 ELSE 1.0 END::DOUBLE * CASE WHEN example THEN 1.15 ELSE 1.0 END::DOUBLE AS boost,
  list_aggregate(list_transform(regexp_extract_all(lower(term), '[a-z0-9]+'), lambda q: {sing('q')}), 'string_agg', ' ') AS key
  FROM base_ b JOIN rank_ r USING (doc_id, term) JOIN told USING (doc_id, term) JOIN flags USING (doc_id, term)),
raw_ AS (SELECT *, round((0.30 * frequency + 0.25 * spread + 0.25 * centrality) * boost, 9) AS raw FROM sig),
topics AS MATERIALIZED (SELECT *, round(raw / max(raw) OVER (PARTITION BY doc_id), 3) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY raw DESC, ord) AS pos FROM (SELECT * FROM raw_ WHERE raw > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY raw DESC, ord) = 1)) WHERE pos <= 20)
"""

WIDE = lambda x: x.replace("[\\w-]", "[\\p{L}\\p{N}\\p{M}_-]").replace("'", "''")
STATED = f"'(?i)' || b.p || '{WIDE(tm.IS_A)}' || a.p || '|' || b.p || '{WIDE(tm.USES)}' || a.p || '|' || a.p || '{WIDE(tm.USED_FOR)}' || b.p"
#: big: topics with an introduction; used: topics in the introductions of others, outside their names; said: dependencies stated in a sentence.
NEEDS = TOPICS + f""", big AS MATERIALIZED (SELECT t.doc_id, t.term, t.key, t.score <= 0.30 AS minor, '\\b' || terms.body || '\\b' AS p, i.intro FROM topics t JOIN terms USING (doc_id, term)
  JOIN (SELECT doc_id, term, coalesce(min(sent) FILTER (WHERE defines), min(sent)) AS intro FROM heard WHERE words >= 6 GROUP BY ALL) i USING (doc_id, term)),
near_ AS (SELECT b.doc_id, b.term, z.sent FROM big b JOIN sents y ON y.doc_id = b.doc_id AND y.sent = b.intro JOIN sents z ON z.doc_id = b.doc_id AND z.sec = y.sec AND z.sent >= b.intro AND z.sent <= b.intro + 2
  UNION SELECT doc_id, term, sent FROM heard JOIN big USING (doc_id, term) WHERE defines AND words >= 6 QUALIFY row_number() OVER (PARTITION BY doc_id, term ORDER BY sent) <= 3),
spot AS MATERIALIZED (SELECT n.doc_id, f.term AS a, n.term AS b, n.sent, f.at, f.stop FROM near_ n JOIN found f ON f.doc_id = n.doc_id AND f.sent = n.sent AND f.term <> n.term),
hidden AS (SELECT DISTINCT s.* FROM spot s JOIN found o ON o.doc_id = s.doc_id AND o.sent = s.sent AND o.term = s.b WHERE o.at <= s.at AND s.stop <= o.stop),
used AS (SELECT doc_id, a, b, count(DISTINCT sent) AS hits, min(sent) AS hit FROM (SELECT * FROM spot EXCEPT SELECT * FROM hidden) GROUP BY ALL),
real_ AS MATERIALIZED (SELECT doc_id, term, sent FROM heard JOIN big USING (doc_id, term) WHERE words >= 6),
mutual AS (SELECT x.doc_id, x.term AS a, y.term AS b, x.sent FROM real_ x JOIN real_ y ON x.doc_id = y.doc_id AND x.sent = y.sent AND x.term <> y.term QUALIFY row_number() OVER (PARTITION BY x.doc_id, x.term, y.term ORDER BY x.sent) <= 150),
said AS (SELECT m.doc_id, m.a, m.b, min(m.sent) AS sent FROM mutual m JOIN big a ON a.doc_id = m.doc_id AND a.term = m.a JOIN big b ON b.doc_id = m.doc_id AND b.term = m.b JOIN sents z ON z.doc_id = m.doc_id AND z.sent = m.sent
  WHERE regexp_matches(z.text, '(?i){WIDE(tm.IS_A)}|{WIDE(tm.USES)}|{WIDE(tm.USED_FOR)}') AND regexp_matches(replace(z.text, '_', '.'), {STATED}) GROUP BY ALL),
need AS (SELECT a.doc_id, a.term AS source, b.term AS target, b.intro AS b_intro, CASE WHEN a.intro < b.intro THEN coalesce(hits, 0) ELSE 0 END AS h, hit, said.sent AS said, a.key <> '' AND b.key LIKE '% ' || a.key AS special
  FROM big a JOIN big b ON a.doc_id = b.doc_id AND a.term <> b.term AND NOT a.minor LEFT JOIN used u ON u.doc_id = a.doc_id AND u.a = a.term AND u.b = b.term LEFT JOIN said ON said.doc_id = a.doc_id AND said.a = a.term AND said.b = b.term)
"""


def _probe_pieces(after: str) -> str:
    """What ``after`` selects from (doc_id, t: text, hs: matches, gs: what lies between) of each probe term."""
    rows = " UNION ALL ".join(
        f"SELECT doc_id, {lit(t)} AS term, regexp_extract_all(t, {lit('(?i)' + chr(92) + 'b' + b + chr(92) + 'b')}) AS hs, string_split_regex(t, {lit('(?i)' + chr(92) + 'b' + b + chr(92) + 'b')}) AS gs FROM (SELECT doc_id, replace(coalesce(text, ''), '_', '.') AS t FROM documents)"
        for t, b in PROBES.items()
    )
    return f"WITH hit AS (SELECT * FROM ({rows}) WHERE len(hs) > 0) {after}"


STUDIES: dict[str, str] = {
    "reflow_segments": f"SELECT doc_id, CAST(len(list_filter(string_split(t, {NL}), lambda z: z <> '')) AS INT) AS n_segments, CAST(length(t) AS INT) AS n_chars FROM (SELECT doc_id, {reflowed('ls')} AS t FROM (SELECT doc_id, string_split(coalesce(text, ''), {NL}) AS ls FROM documents))",
    "clean_pages": f"SELECT doc_id, page, CAST(length(text) AS INT) AS n_chars, md5(text) AS text_md5 FROM {PAGES}",
    "document_context": STUDY.format(texts=f"(SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page) AS text FROM {PAGES} GROUP BY doc_id)")
    + f""", pg AS (SELECT doc_id, page, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM {PAGES})
SELECT doc_id, count(*) AS n_sentences, CAST(max(page) AS INT) AS last_page, CAST(max(sec) AS INT) AS last_sec, CAST(sum(start) AS BIGINT) AS sum_start FROM (SELECT z.doc_id, z.start, z.sec, pg.page FROM sents z ASOF JOIN pg ON z.doc_id = pg.doc_id AND z.start >= pg.start) GROUP BY doc_id""",
    "term_offsets": _probe_pieces("SELECT doc_id, term, CAST(length(gs[1]) AS INT) AS first_at, CAST(list_sum(list_transform(gs, lambda g: length(g))) + list_sum(list_transform(hs, lambda h: length(h))) - length(gs[-1]) AS INT) AS last_stop FROM hit"),
    "surface_form": _probe_pieces(
        """, f AS (SELECT doc_id, term, k, regexp_replace(hs[k], '\\s+', ' ', 'g') AS form FROM (SELECT *, unnest(range(1, len(hs) + 1)) AS k FROM hit)), c AS (SELECT doc_id, term, form, count(*) AS n, min(k) AS first FROM f GROUP BY ALL),
b AS (SELECT doc_id, term, arg_max(form, {'n': n, 'first': -first}) AS form FROM c GROUP BY ALL) SELECT doc_id, term, CASE WHEN regexp_matches(substring(form, 2), '\\p{Lu}') THEN form ELSE lower(form) END AS form FROM b"""
    ),
    "section_term_frequency": FOUND + "SELECT doc_id, CAST(sec AS INT) AS sec, term, count(*) AS n FROM found GROUP BY ALL",
    "term_spread": FOUND + "SELECT f.doc_id, f.term, count(DISTINCT sec) AS df, round(count(DISTINCT sec) / max(k.n), 6) AS spread FROM found f JOIN (SELECT doc_id, count(*) AS n FROM secs GROUP BY doc_id) k USING (doc_id) GROUP BY ALL",
    "concept_stats": FOUND + "SELECT doc_id, term, count(*) AS mentions, count(DISTINCT sent) AS sentences, count(DISTINCT sent_sec) AS sections FROM found GROUP BY ALL",
    "cooccurrence_edges": FOUND
    + """, own AS (SELECT DISTINCT f.doc_id, f.sec, t.term, t.ord FROM found f JOIN terms t USING (doc_id, term)), k AS (SELECT doc_id, count(*) AS n FROM secs GROUP BY doc_id),
e AS (SELECT a.doc_id, count(*) / max(n) AS weight FROM own a JOIN own b ON a.doc_id = b.doc_id AND a.sec = b.sec AND a.ord < b.ord JOIN k ON k.doc_id = a.doc_id GROUP BY a.doc_id, a.term, b.term)
SELECT doc_id, count(*) AS n_edges, round(sum(weight), 6) AS weight FROM e WHERE weight >= 0.05 GROUP BY doc_id""",
    "drop_fragments": FOUND + NESTED + "SELECT doc_id, term FROM kept",
    "concept_introductions": HEARD + "SELECT doc_id, term, CAST(coalesce(min(sent) FILTER (WHERE defines), min(sent)) AS INT) AS intro FROM heard WHERE words >= 6 GROUP BY ALL",
    "exam_boost": HEARD + TOLD + "SELECT definition, figure, example, count(*) AS n FROM told JOIN flags USING (doc_id, term) GROUP BY ALL",
    "concept_topics": TOPICS
    + """SELECT doc_id, CAST(pos AS INT) AS pos, term, score, CASE WHEN score > 0.55 THEN 'core' WHEN score > 0.30 THEN 'supporting' ELSE 'minor' END AS tier, FALSE AS is_heading, FALSE AS llm_endorsed,
round(round(frequency, 9), 3) AS frequency, round(round(spread, 9), 3) AS spread, CAST(0 AS DOUBLE) AS heading, round(round(centrality, 9), 3) AS centrality, round(round(boost, 9), 3) AS exam_boost FROM topics""",
    "concept_edges": TOPICS
    + "SELECT doc_id, source, target, round(weight, 3) AS weight FROM edge WHERE weight >= 0.10 AND EXISTS (SELECT 1 FROM topics t WHERE t.doc_id = edge.doc_id AND t.term = edge.source) AND EXISTS (SELECT 1 FROM topics t WHERE t.doc_id = edge.doc_id AND t.term = edge.target)",
    "prereq_edges": NEEDS
    + """SELECT doc_id, source, target, CAST(CASE WHEN h = 0 AND said IS NULL THEN 1 ELSE h + CASE WHEN said IS NULL THEN 0 ELSE 2 END END AS DOUBLE) AS weight,
CASE WHEN said IS NOT NULL THEN 'stated_dependency' WHEN h > 0 THEN 'introduced_using' ELSE 'specialization' END AS reason, CAST(CASE WHEN said IS NOT NULL THEN said WHEN h > 0 THEN hit ELSE b_intro END AS INT) AS evidence
FROM need WHERE h > 0 OR said IS NOT NULL OR special""",
    "relation_counts": TOPICS
    + """, told_ AS MATERIALIZED (SELECT DISTINCT doc_id, term, sent, sent_sec FROM found),
shown AS MATERIALIZED (SELECT doc_id, source AS a, target AS b FROM edge WHERE weight >= 0.10 AND EXISTS (SELECT 1 FROM topics t WHERE t.doc_id = edge.doc_id AND t.term = edge.source) AND EXISTS (SELECT 1 FROM topics t WHERE t.doc_id = edge.doc_id AND t.term = edge.target)),
ss AS (SELECT p.doc_id, p.a, p.b, count(*) AS n FROM shown p JOIN told_ x ON x.doc_id = p.doc_id AND x.term = p.a JOIN told_ y ON y.doc_id = p.doc_id AND y.term = p.b AND y.sent = x.sent GROUP BY ALL),
home AS MATERIALIZED (SELECT DISTINCT doc_id, term, sent_sec FROM told_),
sc AS (SELECT p.doc_id, p.a, p.b, count(*) AS n FROM shown p JOIN home x ON x.doc_id = p.doc_id AND x.term = p.a JOIN home y ON y.doc_id = p.doc_id AND y.term = p.b AND y.sent_sec = x.sent_sec GROUP BY ALL)
SELECT p.doc_id, p.a, p.b, round(coalesce(sc.n, 0) / size_.n, 3) AS weight, coalesce(ss.n, 0) AS shared_sentences, coalesce(sc.n, 0) AS shared_sections, CAST(least(coalesce(ss.n, 0), 5) AS INT) AS quotes
FROM shown p JOIN size_ USING (doc_id) LEFT JOIN ss USING (doc_id, a, b) LEFT JOIN sc USING (doc_id, a, b)""",
    "concept_quotes": TOPICS
    + f""", own_ AS MATERIALIZED (SELECT h.doc_id, h.term, h.sent, h.words, h.defines AND h.words >= 4 AS d, z.sec, CASE WHEN length(z.text) > 320 THEN regexp_replace(left(z.text, 320), ' [^ ]*$', '') || '…' ELSE z.text END AS quote
  FROM heard h JOIN topics USING (doc_id, term) JOIN sents z ON z.doc_id = h.doc_id AND z.sent = h.sent),
def_ AS (SELECT *, coalesce(d, FALSE) AND sum(CASE WHEN d THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, term ORDER BY sent) <= 2 AS chosen FROM own_),
free_ AS (SELECT * FROM def_ WHERE NOT chosen AND words >= 6 QUALIFY row_number() OVER (PARTITION BY doc_id, term, sec ORDER BY sent) = 1),
four AS (SELECT * FROM free_ QUALIFY row_number() OVER (PARTITION BY doc_id, term ORDER BY sent) <= 4),
cnt AS (SELECT doc_id, term, count(*) AS n FROM found GROUP BY ALL)
SELECT o.doc_id, o.term, o.n_sentences, o.n_sections, cnt.n AS n_mentions, size_.n AS total_sections, coalesce(dd.t, '') AS definitions, coalesce(mm.t, '') AS mentions
FROM (SELECT doc_id, term, count(*) AS n_sentences, count(DISTINCT sec) AS n_sections FROM own_ GROUP BY ALL) o JOIN cnt USING (doc_id, term) JOIN size_ USING (doc_id)
LEFT JOIN (SELECT doc_id, term, string_agg(quote, {NL} ORDER BY sent) AS t FROM def_ WHERE chosen GROUP BY ALL) dd USING (doc_id, term)
LEFT JOIN (SELECT doc_id, term, string_agg(quote, {NL} ORDER BY sent) AS t FROM four GROUP BY ALL) mm USING (doc_id, term)""",
    "study_priority": TOPICS
    + """SELECT doc_id, coverage, 'Top 5 topics cover ~' || coverage || '% of this document' AS study_priority FROM (SELECT doc_id, CAST(CASE WHEN sum(score) > 0 THEN round_even(round(sum(CASE WHEN pos <= 5 THEN score ELSE 0 END) / sum(score) * 100, 9), 0) ELSE 0 END AS INT) AS coverage FROM topics GROUP BY doc_id)""",
}

ORACLES: dict[str, str] = {
    "content_hash_dedup": f"SELECT content_hash, doc_id, first_doc_id, doc_id <> first_doc_id AS reused FROM (SELECT {HASH} AS content_hash, doc_id, min(doc_id) OVER (PARTITION BY {HASH}) AS first_doc_id FROM documents)",
    "text_admission": f"SELECT doc_id, CASE WHEN octet_length(encode(coalesce(text, ''))) > 52428800 THEN 'too large' WHEN length({strip('coalesce(text, chr(32))')}) < 20 THEN 'too short' ELSE 'admitted' END AS verdict FROM documents",
    "upload_admission": "SELECT 'page-' || page_id || CASE WHEN page_id % 7 = 0 THEN '.txt' ELSE '.PDF' END AS name, CASE WHEN page_id % 7 = 0 THEN 'not a document' WHEN octet_length(encode(html)) > 52428800 THEN 'too large' WHEN trim(html) = '' THEN 'blank' ELSE 'admitted' END AS verdict FROM pages",
    "doc_summary": f"SELECT doc_id, count(*) AS n_pages, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM {BINDERS} GROUP BY doc_id",
    "health_counts": "SELECT count(*) AS n_documents, count(DISTINCT source) AS n_sources FROM documents",
    "point_lookup": "SELECT doc_id, text, lang FROM documents WHERE doc_id = 7",
    "reject_chunkless": f"SELECT doc_id FROM documents WHERE length({strip('text')}) > 20",
    "store_roundtrip": "SELECT doc_id, lang, source, CAST(length(text) AS INT) AS n_chars FROM documents",
    "repeated_line_blacklist": f"SELECT doc_id, norm, n_pages FROM {REPEATED}",
    "strip_repeated_lines": f"SELECT doc_id, page, md5(coalesce(string_agg(line, {NL} ORDER BY i) FILTER (WHERE r.norm IS NULL), '')) AS text_md5 FROM (SELECT *, {NORM} AS own FROM {LINES}) l LEFT JOIN (SELECT doc_id AS d, norm FROM {REPEATED}) r ON r.d = l.doc_id AND r.norm = l.own GROUP BY doc_id, page",
    "metadata_line_filter": f"SELECT doc_id, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM {DOC_LINES} WHERE NOT {IS_METADATA} GROUP BY doc_id",
    "toc_page_lines": f"SELECT doc_id, n_lines, n_numbered, n_numbered >= greatest(3.0, 0.3 * n_lines) AS contents FROM (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE {NUMBERED}) AS n_numbered FROM {DOC_LINES} WHERE trim(line) <> '' GROUP BY doc_id)",
    "metadata_fixtures": values("line VARCHAR, dropped BOOLEAN", fx.LINES),
    "heading_tiers": values("line_no INT, level INT", [(20, 1), (21, 2), (22, 3)]),
    "heading_locate": f"SELECT doc_id, CAST(hit - 1 AS INT) AS found_at, title FROM (SELECT page_id AS doc_id, {HEAD} AS title, strpos(lower({PLAIN}), lower(trim(regexp_replace({HEAD}, '\\s+', ' ', 'g')))) AS hit FROM pages) WHERE hit > 0 AND length(title) >= 3",
    "heading_weight": f"SELECT page_id AS doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower({HEAD}), '[^a-z]+'), lambda w: length(w) > 2))) AS term, CAST(3.0 AS DOUBLE) AS heading FROM pages WHERE {HEAD} <> ''",
    "section_starts": "SELECT doc_id, list_aggregate(list_transform(range(0, 6 // c + 1), lambda i: CAST(i * c * s AS VARCHAR)), 'string_agg', ',') AS starts FROM (SELECT doc_id, s, CAST(ceil(30 / s) AS INT) AS c FROM (SELECT doc_id, doc_id % 17 + 9 AS s FROM documents))",
    "fixed_window_sections": SECTIONS + "SELECT doc_id, sec, start, stop FROM secs",
    "section_flags": values("text VARCHAR, flags VARCHAR", fx.FLAGS),
    "sentence_split": f"SELECT doc_id, count(*) AS n_sentences, CAST(sum({words('text')}) AS BIGINT) AS n_words, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM {SENTENCES} GROUP BY doc_id",
    "page_asof_lookup": f"WITH p AS (SELECT doc_id, page, length(text) AS n, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM {BINDERS}), o AS (SELECT doc_id, unnest(range(0, CAST(max(start + n) AS BIGINT) + 1, 997)) AS off FROM p GROUP BY doc_id) SELECT o.doc_id, CAST(o.off AS INT) AS off, CAST(p.page AS INT) AS page FROM o ASOF JOIN p ON o.doc_id = p.doc_id AND o.off >= p.start",
    "evidence_ref": "SELECT doc_id, CASE WHEN length(t) > 320 THEN regexp_replace(left(t, 320), ' [^ ]*$', '') || '…' ELSE t END AS ref FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
    "singular_fold": f"SELECT word, {sing('word')} AS folded FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents)",
    "term_key": f"SELECT doc_id, md5(coalesce(list_aggregate(list_transform(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: {sing('w')}), 'string_agg', ' '), '')) AS key_md5 FROM documents",
    "concept_key": "SELECT doc_id, md5(trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g'))) AS key_md5 FROM documents",
    "find_topic": f"SELECT key, min(doc_id) AS doc_id FROM (SELECT doc_id, coalesce(list_aggregate(list_transform(regexp_extract_all(lower(word), '[a-z0-9]+'), lambda w: {sing('w')}), 'string_agg', ' '), '') AS key FROM (SELECT doc_id, unnest(list_distinct(regexp_split_to_array(coalesce(text, ''), '\\s+'))) AS word FROM documents)) WHERE key <> '' GROUP BY key",
    "pattern_columns": values("term VARCHAR, body VARCHAR", [(" ".join(t), "(?<![A-Za-z0-9])" + "(?:[^\\S\\n]|-)+".join(f"\\Q{w}\\E" for w in t) + "(?:s|es)?(?![A-Za-z0-9])") for t in (k.split() for k in PROBES)]),
    "term_mentions": " UNION ALL ".join(f"SELECT doc_id, {lit(t)} AS term, CAST(m AS BIGINT) AS mentions FROM (SELECT doc_id, {mentions('text', b)} AS m FROM documents) WHERE m > 0" for t, b in PROBES.items()),
    "definitional_sentences": _defined(),
    "term_predicates": values("kind VARCHAR, text VARCHAR, a VARCHAR, b VARCHAR, result BOOLEAN", fx.PREDICATES),
    "tokenize_chunks": f"SELECT doc_id, CAST(len(t) AS INT) AS n_tokens, md5(coalesce(list_aggregate(t, 'string_agg', ' '), '')) AS tokens_md5 FROM (SELECT doc_id, {TOKENS.format(x='text')} AS t FROM documents)",
    "branding_stopwords": f"WITH p AS (SELECT doc_id, page, max(page) OVER (PARTITION BY doc_id) AS last, text FROM {BINDERS}), w AS (SELECT doc_id, page, last, unnest(list_filter({RUNS.format(x='text')}, lambda x: regexp_full_match(x, '[a-z]{{4,}}') AND x NOT IN {listed(content_stops())})) AS word FROM p WHERE last >= 5) SELECT doc_id, word FROM w GROUP BY ALL HAVING count(*) FILTER (WHERE page = 1) > 0 AND count(*) FILTER (WHERE page = last) > 0 AND count(*) FILTER (WHERE page NOT IN (1, last)) = 0 AND count(*) >= 3",
    "tfidf_nominate": TFIDF,
    "bm25_index": BM25 + "SELECT term, CAST(tf AS BIGINT) AS tf, df, round(idf, 6) AS idf FROM idf",
    "bm25_scores": BENCH + "SELECT item_id, count(*) AS n_docs, round(sum(score), 3) AS total FROM scores GROUP BY item_id",
    "bm25_topk": BENCH + "SELECT item_id, doc_id, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scores) WHERE rank <= 5 AND score > 0",
    "dense_topk": f"WITH {NEAREST} SELECT query_id, vec_id, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM near) WHERE rank <= 10",
    "pair_similarity": f"WITH u AS (SELECT vec_id, {UNIT.format(v='embedding')} AS v FROM embeddings) SELECT a.vec_id, round(list_inner_product(a.v, b.v), 6) AS similarity FROM u a JOIN u b ON b.vec_id = a.vec_id + 1",
    "rrf_fusion": f"WITH r AS ({values('query_id INT, list_id INT, chunk INT, rank INT', fx.RANKINGS)}), f AS (SELECT query_id, chunk, sum(1.0 / (60 + rank)) AS score, min(list_id * 1000 + rank) AS first FROM r GROUP BY ALL) SELECT query_id, chunk, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first) AS INT) AS pos FROM f",
    "hybrid_retrieve": FUSED,
    "context_block": f"SELECT query_id, md5(block) AS block_md5, CAST(length(block) AS INT) AS n_chars FROM (SELECT query_id, string_agg('[Excerpt ' || (doc_id + 1) || ']' || {NL} || coalesce(text, ''), {NL} || {NL} ORDER BY pos) AS block FROM ({FUSED}) JOIN documents USING (doc_id) GROUP BY query_id)",
    "label_forms": values("i INT, label VARCHAR", [(0, "p. 3"), (1, "pp. 3–5"), (2, "Excerpt 3")]),
    "mastery_store": FOLD + "SELECT user_id, concept, mastery, attempts, exposures, reps FROM state",
    "pending_quizzes": "SELECT conv_id || '-' || turn AS quiz_id, turn * 100000 + conv_id AS made FROM conversations WHERE role = 'user' ORDER BY made DESC, quiz_id DESC LIMIT 500",
    "session_turns": """WITH q AS (SELECT conv_id, turn // 4 AS doc_id, turn AS seen, text AS question, role, CASE WHEN lead(role) OVER w = 'assistant' THEN lead(text) OVER w END AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
l AS (SELECT *, max(doc_id) OVER (PARTITION BY conv_id) AS last FROM q WHERE role = 'user'), m AS (SELECT conv_id, doc_id, seen, 0 AS n, 'user' AS role, question AS text FROM l WHERE doc_id = last UNION ALL SELECT conv_id, doc_id, seen, 1, 'assistant', answer FROM l WHERE doc_id = last AND coalesce(answer, '') <> ''),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY seen, n) - 1 AS turn, row_number() OVER (PARTITION BY conv_id ORDER BY seen DESC, n DESC) AS back FROM m)
SELECT conv_id, CAST(doc_id AS INT) AS doc_id, CAST(turn AS INT) AS turn, role, md5(text) AS text_md5 FROM t WHERE back <= 20""",
    "fit_history": "WITH k AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS s FROM conversations), f AS (SELECT *, min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS first FROM k WHERE s <= 2000) SELECT conv_id, turn, role FROM f WHERE turn >= first",
    "last_messages": "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 3",
    "session_remember": "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WHERE NOT (role = 'assistant' AND coalesce(text, '') = '')) WHERE k <= 4",
    "session_lru": "SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS used FROM conversations GROUP BY conv_id ORDER BY used DESC, conv_id DESC LIMIT 50",
    "prompt_budget": "SELECT conv_id, CAST(greatest(0, 11648 - length(coalesce(max(text) FILTER (WHERE role = 'system'), '')) - length(coalesce(max(text) FILTER (WHERE role = 'user'), ''))) AS INT) AS budget FROM conversations WHERE role IN ('system', 'user') GROUP BY conv_id",
    "small_talk": values("message VARCHAR, small_talk BOOLEAN, reply VARCHAR", [(m, s, REPLY[r]) for m, s, r in fx.SMALL_TALK]),
    "small_talk_messages": "SELECT role, count(*) FILTER (WHERE regexp_full_match(trim(regexp_replace(regexp_replace(lower(text), '[^a-z ]+', ' ', 'g'), ' +', ' ', 'g')), '(?:hi|hello|hey|hiya|yo|thanks|thank you|thank u|thx|ty|ok|okay|cool|great|nice|bye|goodbye|good (?:morning|afternoon|evening|night))(?: (?:assistant|there|so much|a lot|again))*')) AS n, count(*) AS total FROM conversations GROUP BY role",
    "question_exposure": " UNION ALL ".join(f"SELECT conv_id, {lit(t)} AS term, count(*) AS turns FROM conversations WHERE role = 'user' AND {mentions('text', PROBES[t])} > 0 GROUP BY conv_id" for t in ("the", "of the", "and")),
    "parse_llm_topics": values("id INT, topics VARCHAR", [(k, r[1]) for k, r in enumerate(fx.TOPIC_REPLIES)]),
    "clean_llm_term": values("id INT, term VARCHAR", [(k, r[1]) for k, r in enumerate(fx.RAW_TERMS)]),
    "parse_quiz": values("id INT, question VARCHAR, answer VARCHAR", [(k, *r[1:]) for k, r in enumerate(fx.QUIZ_REPLIES)]),
    "parse_grade": values("id INT, score DOUBLE, feedback VARCHAR", [(k, *r[1:]) for k, r in enumerate(fx.GRADE_REPLIES)]),
    "reachability": REACH + "SELECT doc_id, source, target, hops FROM reach",
    "transitive_reduction": REACH + "SELECT doc_id, source, target FROM reach WHERE hops = 1",
    "path_levels": REACH + "SELECT 'd' AS doc_id, term, CAST(coalesce(max(hops), 0) AS INT) AS level FROM (SELECT source AS term FROM e UNION SELECT target FROM e) t LEFT JOIN reach ON reach.target = t.term GROUP BY term",
    "mastery_fold": FOLD + "SELECT user_id, concept, mastery, attempts, correct, exposures, ease, interval, reps, strftime(due, '%Y-%m-%d %H:%M:%S') AS due, last_score FROM state",
    "mastery_status": FOLD + "SELECT user_id, concept, status FROM state",
    "mastery_summary": COURSE + "SELECT user_id, count(*) FILTER (WHERE status = 'unseen') AS unseen, count(*) FILTER (WHERE status = 'explored') AS explored, count(*) FILTER (WHERE status = 'learning') AS learning, count(*) FILTER (WHERE status = 'mastered') AS mastered, count(*) AS total, count(*) FILTER (WHERE tier = 'core') AS core_total, count(*) FILTER (WHERE tier = 'core' AND status = 'mastered') AS core_mastered FROM rows_ GROUP BY user_id",
    "mastery_payload": COURSE + "SELECT user_id, term, tier, status, attempts, mastery FROM rows_",
    "quiz_target": COURSE + f""", b AS (SELECT r.user_id, n.target AS term, count(*) AS needs, count(*) FILTER (WHERE r.mastery < 0.5) AS open FROM need n JOIN rows_ r ON r.term = n.source GROUP BY ALL),
p AS (SELECT r.*, coalesce(b.needs, 0) AS needs, coalesce(b.open, 0) AS open, (due IS NULL OR due <= TIMESTAMP '{fx.NOW}') AS is_due FROM rows_ r LEFT JOIN b USING (user_id, term)),
q AS (SELECT *, round(score * (1 - mastery) * CASE WHEN is_due THEN 1.0 ELSE 0.25 END * CASE WHEN open > 0 THEN 0.35 ELSE 1.0 END, 9) AS priority FROM p)
SELECT user_id, term, round(priority, 6) AS priority, concat_ws(', ', upper(left(tier, 1)) || substring(tier, 2) || ' concept (importance ' || {PERCENT.format(x='score')} || ')', CASE WHEN attempts = 0 THEN 'not quizzed yet' ELSE 'current mastery ' || {PERCENT.format(x='mastery')} END,
CASE WHEN attempts > 0 AND is_due THEN 'due for review' END, CASE WHEN needs > 0 AND open = 0 THEN 'its prerequisites are in place' END) AS reason FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY priority DESC, pos) AS k FROM q) WHERE k = 1""",
    "prerequisite_gap": COURSE + "SELECT r.user_id, n.target AS term, string_agg(n.source, ',' ORDER BY n.source) AS gap FROM need n JOIN rows_ r ON r.term = n.source WHERE r.mastery < 0.5 GROUP BY ALL",
    "cloze_questions": f"SELECT item_id, question FROM (SELECT item_id, text, regexp_replace(text, '(?i)\\bthe(?:s|es)?\\b', '_____', 'g') AS question FROM benchmark) WHERE question <> text AND {words("replace(question, '_____', '')")} >= 5",
    "grade_exact": values("answer VARCHAR, expected VARCHAR, score DOUBLE, dont_know BOOLEAN", fx.ANSWERS),
    "grade_blend": f"SELECT model, cosine, round(s, 6) AS similarity, round(g, 6) AS score, CASE WHEN g >= 0.8 THEN 'correct' WHEN g >= 0.5 THEN 'partial' ELSE 'incorrect' END AS verdict FROM (SELECT *, coalesce(0.6 * model + 0.4 * s, s) AS g FROM (SELECT *, least(1.0, greatest(0.0, (cosine - 0.25) / 0.5)) AS s FROM ({values('model DOUBLE, cosine DOUBLE', fx.BLENDS)})))",
    "grade_routing": values("id INT, score DOUBLE, graded_by VARCHAR", [(1, 1.0, "exact match"), (2, 0.0, "no answer"), (3, 0.5, "llm + embedding similarity"), (4, 0.5, "embedding similarity"), (5, 0.0, "no answer"), (6, 0.0, "exact match")]),
    "stream_dedup": f"SELECT DISTINCT {HASH} AS content_hash FROM documents",
    "stream_mastery": FOLD + "SELECT user_id, concept, mastery, attempts, correct, exposures, ease, interval, reps FROM state",
}


def oracle_sql() -> dict[str, str]:
    return {**ORACLES, **STUDIES}
