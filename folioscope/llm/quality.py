"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into at most ``BINS`` quantile bins and has a lookup table of log odds over them. The tables are
learned by boosting in cycles: each round fits, for one feature after another, a shallow tree (up to four leaves) to the
logistic gradient of the whole model, over histograms, and adds a small part of it to that feature's table. Then the
``PAIRS`` pairs of features whose four-quadrant trees explain most of what is left get tables over two features, learned
the same way. A score is the logistic function of a sum of table entries, one gather and one addition for each table.

The model is fitted on the driver on at most ``SAMPLE`` labelled documents (those with the smallest hash of doc_id), of
which only the features are collected; everything else covers all documents.

Defined results: a null text is an empty one and is scored; without labels, or with one class of them, the score is the
smoothed share of good ones (0.5 without any); rows whose label or whose document is missing are not learned from; a
null doc_id is held out; rows stand for themselves, also repeated ones, and a doc_id that repeats teaches with each of its
texts, within ``SAMPLE``; where gains tie, the first feature and the lowest cut win. A very long text is scored by one
task, in whole. Labels, language, source and doc_id are no inputs. Other columns, whatever their names, pass unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from folioscope.llm import textbuf as tb
from folioscope.llm.compression import duplicates
from folioscope.llm.store import every, free, in_arrow, table

SAMPLE, BINS, ROUNDS, RATE, PAIRS, PAIR_ROUNDS = 20_000, 32, 120, 0.15, 8, 30
CUT = 0.3


def _kind(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _DIGIT = _kind(bytes(range(65, 91))), _kind(bytes(range(48, 58)))
_LETTER = _kind(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
_MARKS = {"bangs": _kind(b"!?"), "stops": _kind(b".,;:"), "bars": _kind(b"|<>"), "signs": _kind(b"#*$%&@~^_=+"), "quotes": _kind(b"\"'()[]{}/\\")}
FEATURES = (
    "words", "word_length", "long_words", "upper", "capital_words", "digits", *_MARKS, "letters", "wide", "distinct", "repeats", "next_same",
    "dup_lines", "line_words", "sentence_words", "end_marks",
)


def features(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(rows, features) of whole texts."""
    starts, ends, first = tb.words(buf, offs)
    n = np.diff(first)
    w = np.maximum(n, 1)
    total = np.maximum(np.diff(offs), 1)
    h = tb.hashes(buf, starts, ends)
    g, at = tb.grams(h, first, 3)
    twice, _ = duplicates(g, np.searchsorted(at, first))
    inside = np.zeros(len(h), bool)
    for k in range(3):
        inside[at[twice] + k] = True
    _, later = duplicates(h, first)
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[first[:-1][first[:-1] < len(h)]] = False
    l_start, l_end, l_first = tb.lines(buf, offs)
    has = np.searchsorted(starts, l_end) > np.searchsorted(starts, l_start)
    _, l_later = duplicates(tb.hashes(buf, l_start, l_end), l_first)
    lines = np.maximum(tb.per_row(has, l_first), 1)
    lead = (buf & 0xC0) != 0x80
    chars = tb.per_row(lead & ~tb._SPACE[buf], offs)
    last, head = (buf[ends - 1], buf[starts]) if len(starts) else (np.zeros(0, np.uint8),) * 2
    closing = _kind(b".!?")[last]
    cols = [
        np.log1p(n),
        chars / w,
        tb.per_row(ends - starts > 18, first) / w,
        tb.per_row(_UPPER[buf], offs) / total,
        tb.per_row(_UPPER[head], first) / w,
        tb.per_row(_DIGIT[buf], offs) / total,
        *(tb.per_row(k[buf], offs) / w for k in _MARKS.values()),
        tb.per_row(_LETTER[buf], offs) / total,
        tb.per_row(buf >= 128, offs) / total,
        tb.per_row(~later, first) / w,
        tb.per_row(inside, first) / w,
        tb.per_row(same, first) / w,
        tb.per_row(l_later & has, l_first) / lines,
        np.log1p(n / lines),
        np.log1p(n / (1 + tb.per_row(closing, first))),
        tb.per_row(~_LETTER[last] & ~_DIGIT[last], first) / w,
    ]
    return np.stack([np.asarray(c, np.float64) for c in cols], 1)


def _tree(grad: np.ndarray, hess: np.ndarray, count: np.ndarray, least: int, leaves: int = 4) -> np.ndarray:
    """Values over the bins of a tree on one feature: the best cut, again in the parts, up to so many leaves."""
    cg, ch, cn = (np.concatenate([[0], np.cumsum(x)]) for x in (grad, hess, count))

    def best(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, -1
        k = np.arange(a + 1, b)
        score = lambda lo, hi: (cg[hi] - cg[lo]) ** 2 / (ch[hi] - ch[lo] + 1)
        gain = score(a, k) + score(k, b) - score(a, b)
        gain[(cn[k] - cn[a] < least) | (cn[b] - cn[k] < least)] = 0
        i = int(np.argmax(gain))
        return float(gain[i]), int(k[i])

    parts = [(0, len(grad))]
    while len(parts) < leaves:
        cuts = [best(a, b) for a, b in parts]
        i = int(np.argmax([c[0] for c in cuts]))
        if cuts[i][0] <= 1e-9:
            break
        a, b = parts.pop(i)
        parts += [(a, cuts[i][1]), (cuts[i][1], b)]
    out = np.zeros(len(grad))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1)
    return out


def _quadrants(grad: np.ndarray, hess: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts both features of a pair once."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (grad, hess))

    def corner(c: np.ndarray) -> list[np.ndarray]:
        a = c[1:-1, 1:-1]
        top, left, whole = c[1:-1, -1:], c[-1:, 1:-1], c[-1, -1]
        return [a, top - a, left - a, whole - top - left + a]

    if min(grad.shape) < 2:
        return 0.0, np.zeros_like(grad)
    gs, hs = corner(cg), corner(ch)
    gain = sum(g * g / (h + 1) for g, h in zip(gs, hs, strict=True))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    v = [float(g[i, j] / (h[i, j] + 1)) for g, h in zip(gs, hs, strict=True)]
    out = np.empty_like(grad)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(gain[i, j]), out


class Model:
    """Cuts of the bins, tables of single features, and tables of pairs of them."""

    def __init__(self, base: float = 0.0):
        self.base, self.cuts, self.single, self.pairs = base, [], [], []

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, k], "right") for k, c in enumerate(self.cuts)]

    def logits(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = np.full(len(x), self.base)
        for k, t in enumerate(self.single):
            out += t[b[k]]
        for i, j, t in self.pairs:
            out += t[b[i], b[j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(x)))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of main effects, then of the strongest pairs."""
    good = float(y.sum())
    model = Model(np.log((good + 1) / (len(y) - good + 1)))
    if not 0 < good < len(y):
        return model
    model.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    b = model.bins(x)
    sizes = [len(c) + 1 for c in model.cuts]
    model.single = [np.zeros(s) for s in sizes]
    counts = [np.bincount(c, minlength=s) for c, s in zip(b, sizes, strict=True)]
    f = np.full(len(y), model.base)
    least = max(1, min(20, len(y) // 50))
    for _ in range(ROUNDS):
        for k, s in enumerate(sizes):
            p = 1 / (1 + np.exp(-f))
            tree = _tree(np.bincount(b[k], y - p, s), np.bincount(b[k], p * (1 - p), s), counts[k], least)
            step = RATE * np.clip(tree, -4, 4)
            model.single[k] += step
            f += step[b[k]]

    def pair(i: int, j: int) -> tuple[float, np.ndarray]:
        p, key, shape = 1 / (1 + np.exp(-f)), b[i] * sizes[j] + b[j], (sizes[i], sizes[j])
        n = sizes[i] * sizes[j]
        return _quadrants(np.bincount(key, y - p, n).reshape(shape), np.bincount(key, p * (1 - p), n).reshape(shape))

    ranked = sorted(((pair(i, j)[0], i, j) for i, j in combinations(range(len(sizes)), 2)), key=lambda r: (-r[0], r[1], r[2]))
    model.pairs = [(i, j, np.zeros((sizes[i], sizes[j]))) for _, i, j in ranked[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, t in model.pairs:
            step = RATE * np.clip(pair(i, j)[1], -4, 4)
            t += step
            f += step[b[i], b[j]]
    for k, t in enumerate(model.single):  # centred: the base holds the mean
        mean = float((t * counts[k]).sum() / len(y))
        model.single[k] = t - mean
        model.base += mean
    return model


def remainder(modulus: int) -> F.Column:
    """crc32 of doc_id as text, modulo; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def labelled(docs: DataFrame, labels: DataFrame, column: str, learn: F.Column, most: int) -> DataFrame:
    """(h, text, label) of labelled documents to learn from: those of at most ``most`` labels, with the least hash h.

    A doc_id that repeats in docs gives several rows, so callers keep the ``most`` least h of what they make of the texts."""
    chosen = labels.where(learn & F.col(column).isin(0, 1)).select("doc_id", F.col(column).cast("int").alias("label"))
    chosen = chosen.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id", "label").limit(most)
    return docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id").select("h", "text", "label")  # bounded by ``most``


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, buf, offs in tb.slices(batch.column(1)):
            x = features(buf, offs)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, len(x)), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64())), batch.column(2).slice(at, len(x))],
                ["h", "x", "label"],
            )


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The model, learned from labels whose remainder modulo 5 is not 0."""
    sample = labelled(docs, labels, "quality", remainder(5) != 0, SAMPLE)
    rows = sample.mapInArrow(_featured, "h long, x array<double>, label int").orderBy("h", "x", "label").limit(SAMPLE).toArrow()
    if not rows.num_rows:
        return Model()
    x = np.array(rows["x"].combine_chunks().flatten()).reshape(-1, len(FEATURES))
    y = rows["label"].to_numpy().astype(np.float64)
    order = np.lexsort((*x.T, y))  # the same model, whatever order the rows arrive in
    return fit(x[order], y[order])


def _scored(shared, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at, buf, offs in tb.slices(batch.column(column).cast(pa.string())):
                p = model.score(features(buf, offs))
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(p)) for c in batch.columns), pa.array(p)], [f"c{k}" for k in range(len(batch.columns) + 1)])

    return run


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with _score added (with underscores behind it until the name is free); all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return in_arrow(docs, _scored(shared, docs.columns.index("text")), [(*free(docs, "_score"), DoubleType())])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: the score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (remainder(5) == 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= CUT).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    (score,) = free(docs, "_score")
    return scored(docs, train(docs, table(spark, sf_dir, "labels"))).where(F.col(score) >= CUT).select(*every(docs))
