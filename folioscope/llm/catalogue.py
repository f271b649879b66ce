"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from folioscope.llm import compression, decontaminate, language_model, line_dedup, packing, quality, simhash, token_files, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": packing.query,
        "op2_compression_bands": compression.query,
        "op3_line_dedup": line_dedup.query,
        "op4_simhash": simhash.query,
        "op5_decontaminate": decontaminate.query,
        "op6_warc": warc.query,
        "op7_quality": quality.query,
        "op8_language_model": language_model.query,
        "op9_toxicity": toxicity.query,
        "op10_token_files": token_files.query,
        "pipeline": corpus_pipeline.run,
    }


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "list_filter(regexp_split_to_array({x}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_PLAIN = f"regexp_replace({_LOW}, '[!-/:-@\\[-`{{-~]', ' ', 'g')"

OP3 = f"""WITH l AS (SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
n AS (SELECT doc_id, i, line, {_WORDS.format(x="translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM l),
r AS (SELECT doc_id, i, len(ws) AS w, array_to_string(ws, ' ') AS t, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, sum(len(ws)) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM n WHERE len(ws) > 0),
win AS (SELECT a.doc_id, a.k AS a, min(b.k) AS b FROM r a JOIN r b ON a.doc_id = b.doc_id AND b.c - a.c + a.w >= 50 AND b.k >= a.k GROUP BY ALL
  UNION SELECT b.doc_id, max(a.k) AS a, b.k AS b FROM r a JOIN r b ON a.doc_id = b.doc_id AND b.c - a.c + a.w >= 50 AND b.k >= a.k GROUP BY b.doc_id, b.k),
txt AS (SELECT win.doc_id, a, b, string_agg(t, chr(10) ORDER BY k) AS content FROM win JOIN r ON r.doc_id = win.doc_id AND r.k BETWEEN a AND b GROUP BY ALL),
late AS (SELECT doc_id, a, b FROM (SELECT *, min(doc_id * 1000000 + a) OVER (PARTITION BY content) AS first FROM txt) WHERE doc_id * 1000000 + a > first),
gone AS (SELECT DISTINCT r.doc_id, r.k, r.i, r.w FROM r JOIN late ON late.doc_id = r.doc_id AND r.k BETWEEN late.a AND late.b),
drop_ AS (SELECT doc_id, i, w FROM gone UNION ALL SELECT g.doc_id, n.i, 0 FROM gone g JOIN gone h ON h.doc_id = g.doc_id AND h.k = g.k + 1 JOIN n ON n.doc_id = g.doc_id AND n.i > g.i AND n.i < h.i)
SELECT n.doc_id, count(*) AS n_lines, count(d.i) AS lines_deleted, CAST(coalesce(sum(d.w), 0) AS BIGINT) AS words_deleted, coalesce(string_agg(n.line, chr(10) ORDER BY n.i) FILTER (WHERE d.i IS NULL), '') AS text
FROM n LEFT JOIN drop_ d ON d.doc_id = n.doc_id AND d.i = n.i GROUP BY n.doc_id"""

_GRAMS = "SELECT DISTINCT {key}, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT {key}, ws, unnest(range(1, len(ws) - 3)) AS i FROM (SELECT {key}, {words} AS ws FROM {table}))"
OP5 = f"""WITH d AS ({_GRAMS.format(key="doc_id", words=_WORDS.format(x=_PLAIN), table="documents")}), b AS ({_GRAMS.format(key="item_id", words=_WORDS.format(x=_PLAIN), table="benchmark")}),
n AS (SELECT item_id, count(*) AS n FROM b GROUP BY item_id), s AS (SELECT doc_id, item_id, count(*) AS shared FROM d JOIN b USING (g) GROUP BY ALL)
SELECT doc_id, item_id, n AS item_shingles, shared AS shared_shingles, shared / n AS containment FROM s JOIN n USING (item_id) WHERE shared >= 0.8 * n"""

OP6 = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), s AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS d FROM p),
t AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d, n) ELSE page_id END AS top FROM s)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN top = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN top <> page_id THEN top END AS refers_to FROM t"""


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": OP3, "op5_decontaminate": OP5, "op6_warc": OP6}
