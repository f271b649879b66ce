"""Quality rules by compression bands: zstandard ratios of whole documents and of fixed chunks.

A ratio is a text's UTF-8 bytes over those of its zstandard frame. Text that repeats compresses too well, noise too
little; how well ordinary text compresses depends on its length, so the limits of the whole text are read from a curve
over log2 of its bytes, straight between the points of ``BANDS``, level beyond them. A text of ``CHUNK`` bytes or more is
cut into chunks of that length, the last of which takes what is left behind it; a chunk's limits are those of the curve at
its own length, wider by ``CHUNK_SLACK``; a text passes if at most ``CHUNK_SHARE`` of its chunks leave them. Before that, base
rules reject texts under 50 words and those more than half of whose words lie in repeated three-word windows.

The curve was set from the labelled good documents of the test tables: about the 99.8th percentile for the upper limits.

Defined results: a null text has no words, ratio null and fails the base rules, as an empty one does. Words are told
apart by 64-bit hashes within a text. Rows stand for themselves: repeated rows and rows with a null doc_id give a result
each; a ratio that equals a limit is within it; a very long text is compressed by one task, in whole; without documents the
result is empty. Columns other than doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import textbuf as tb
from folioscope.llm.store import table

MIN_WORDS, LEVEL, CHUNK, CHUNK_SHARE = 50, 3, 1024, 0.2
#: log2 of the bytes, lower and upper limit of the whole text's ratio.
BANDS = (
    (7, 0.80, 2.05), (8, 1.15, 1.97), (9, 1.25, 1.93), (9.5, 1.35, 1.995), (10, 1.45, 2.035), (10.5, 1.50, 2.09),
    (11, 1.55, 2.15), (11.5, 1.60, 2.205), (12, 1.65, 2.275), (12.5, 1.70, 2.315), (13, 1.75, 2.37), (13.5, 1.80, 2.415),
    (14, 1.85, 2.455), (14.5, 1.90, 2.495), (15, 1.95, 2.535), (16, 2.00, 2.60), (17, 2.00, 2.68), (20, 2.00, 2.95),
)
#: A chunk may be so much below and above the limits of a whole text of its length.
CHUNK_SLACK = (0.15, 0.025)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def duplicates(h: np.ndarray, first: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For hashes in rows: whether each has an equal in its row, and whether it has an earlier one."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    key = tb.mix(h + tb.mix(row.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    twice, later = np.zeros(len(s), bool), np.zeros(len(s), bool)
    twice[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return twice, later


def statistics(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each text."""
    starts, ends, first = tb.words(buf, offs)
    h = tb.hashes(buf, starts, ends)
    g, at = tb.grams(h, first, 3)
    twice, _ = duplicates(g, np.searchsorted(at, first))
    inside = np.zeros(len(h), bool)
    for k in range(3):
        inside[at[twice] + k] = True
    l_start, l_end, l_first = tb.lines(buf, offs)
    has = np.searchsorted(starts, l_end) > np.searchsorted(starts, l_start)
    _, later = duplicates(tb.hashes(buf, l_start, l_end), l_first)
    lead = (buf & 0xC0) != 0x80
    ink = lead & ~tb._SPACE[buf]
    return {
        "n_words": np.diff(first),
        "word_chars": tb.per_row(ink, offs),
        "n_symbols": tb.per_row(_SYMBOL[buf], offs),
        "n_dup_lines": tb.per_row(later & has, l_first),
        "n_repeat_words": tb.per_row(inside, first),
    }


def limits(n_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper limit of the whole text's ratio."""
    x = np.log2(np.maximum(n_bytes, 1))
    at, low, high = (np.array(v) for v in zip(*BANDS, strict=True))
    return np.interp(x, at, low), np.interp(x, at, high)


_AT = limits(np.arange(2 * CHUNK))  # of all lengths that a chunk can have


def ratios(data: bytes | memoryview, press: zstandard.ZstdCompressor, chunk: int = CHUNK) -> tuple[float | None, int, int]:
    """Ratio of the whole, number of its chunks, and of those outside their band."""
    n = len(data)
    if not n:
        return None, 0, 0
    below, above = CHUNK_SLACK
    bad, chunks = 0, n // chunk
    for k in range(chunks):
        part = data[k * chunk : n if k == chunks - 1 else (k + 1) * chunk]
        if not _AT[0][len(part)] - below <= len(part) / len(press.compress(part)) <= _AT[1][len(part)] + above:
            bad += 1
    return n / len(press.compress(data)), chunks, bad


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
    for batch in batches:
        for at, buf, offs in tb.slices(batch.column(1)):
            n = len(offs) - 1
            stats = statistics(buf, offs)
            view = memoryview(np.ascontiguousarray(buf))
            found = [ratios(view[offs[i] : offs[i + 1]], press) for i in range(n)]
            ratio = np.array([np.nan if r is None else r for r, _, _ in found])
            chunks, bad = (np.array([x[k] for x in found], np.int64) for k in (1, 2))
            low, high = limits(np.diff(offs))
            failed = (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])
            with np.errstate(invalid="ignore"):
                good = (ratio >= low) & (ratio <= high) & (bad <= CHUNK_SHARE * chunks)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(at, n),
                    *(pa.array(stats[k], pa.int64()) for k in COUNTS),
                    pa.array(failed),
                    pa.array(good & ~failed),
                    pc.if_else(pa.array(np.isnan(ratio)), pa.scalar(None, pa.float64()), pa.array(ratio)),
                    pa.array(chunks),
                    pa.array(bad),
                ],
                ["doc_id", *COUNTS, "base_failed", "kept", "ratio", "n_chunks", "n_bad_chunks"],
            )


def bands(docs: DataFrame) -> DataFrame:
    """Counts, ratios and verdict of every document."""
    kinds = ", ".join(f"{k} long" for k in COUNTS)
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        _bands,
        f"doc_id {dict(docs.dtypes)['doc_id']}, {kinds}, base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: all documents."""
    return bands(table(spark, sf_dir, "documents"))
