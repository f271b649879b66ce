"""Log-bilinear neural language model, trained in numpy with noise-contrastive estimation.

Tokens: words with A-Z in lower case, then one end for each document. Counts of all words of all training documents are
taken first. The words map onto output classes: the end, the most frequent words, each a class of its own, and, as a
quarter of all classes, groups of the others by their first and last bytes. The model gives P(class | two classes before)
as a softmax of q . (C1 r1 + C2 r2) + b; within a group a word has (c + 1) / (N_b + V_b + 1), with one such share for all
unknown words, so probabilities over known words and the unknown one add up to 1.

What is gathered grows with the corpus: the counts with its words, the classes with the root of its tokens, from 1,024 up
to 4,096 (from 4 x 10**9 tokens on; the exact normaliser is a table over pairs of classes). The context of a token is two
classes at any size.

Learning covers every training document once. Documents are dealt by a hash of doc_id and text, so the model is a function
of the corpus, whatever its files and partitions: four rounds over a sixteenth, three sixteenths, a quarter and half of
them, in each as many learners as there are ``SHARE`` tokens (``LEARNERS`` at most), each running Adagrad on
noise-contrastive batches in the order of the hashes from common parameters, which are then averaged by tokens in a fixed
order. Scores are normalised exactly: as the score is a sum over two classes, batched matrix products give one table for
each context position and the log normaliser of all pairs of contexts, once for the whole corpus; a token's
log-probability is four look-ups.

Word counts stay distributed. Only words at or over a count chosen so that at most ``HEAD`` of them qualify (8 MB) go to
all executors; the tokens below that meet their counts in a join. Words are told apart by 64-bit hashes.

Defined results: a null text is an empty one and has the end alone; a null doc_id counts as an empty text in the split;
rows stand for themselves, also repeated ones; words with equal counts (ties) are taken in the order of their hashes; a
very long text is held by one task, in whole. Without training documents all counts are 0 and classes are uniform; without
documents the result is empty. Columns other than doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import textbuf as tb
from folioscope.llm.quality import remainder
from folioscope.llm.store import table, written

LEAST, MOST, SHAPES, HEAD = 1024, 4096, 1024, 1 << 19
SHARE, LEARNERS, CHUNK = 1 << 20, 4096, 1 << 16
#: The sixteenths of the documents, by their hash, that each round learns from.
ROUNDS = ((0, 1), (1, 4), (4, 8), (8, 16))
DIM, NOISE, BATCH, RATE, START = 16, 48, 1024, 0.1, 1e-6
END = np.int64(0x5EED0FE4D)


def classes_for(tokens: int) -> int:
    """Number of classes of a corpus with so many tokens: a power of two that grows with their root."""
    return int(min(MOST, max(LEAST, 1 << int(np.log2(max(1.0, tokens**0.5 / 8))))))


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, their shapes (below SHAPES), and the index of each row's first."""
    low = tb.lower(buf)
    starts, ends, first = tb.words(low, offs)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), first
    shape = low[starts].astype(np.uint64) + (low[ends - 1].astype(np.uint64) << np.uint64(8)) + (low[np.maximum(ends - 2, starts)].astype(np.uint64) << np.uint64(16))
    return tb.hashes(low, starts, ends).view(np.int64), (tb.mix(shape) % np.uint64(SHAPES)).astype(np.int64), first


def _counted(batches: Iterator[pa.RecordBatch], flush: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    keys: list[np.ndarray] = []
    kinds: list[np.ndarray] = []
    held = docs = 0

    def out() -> pa.RecordBatch:
        k, b = np.concatenate(keys), np.concatenate(kinds)
        u, at, c = np.unique(k, return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(b[at]), pa.array(c)], ["key", "shape", "c"])

    for batch in batches:
        for _, buf, offs in tb.slices(batch.column(0)):
            k, b, _ = tokens(buf, offs)
            docs += len(offs) - 1
            keys.append(k)
            kinds.append(b)
            held += len(k)
            if held >= flush:
                yield out()
                keys, kinds, held = [], [], 0
    if held:
        yield out()
    if docs:
        yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([-1], pa.int64()), pa.array([docs], pa.int64())], ["key", "shape", "c"])


def word_counts(texts: DataFrame) -> DataFrame:
    """key (hash of the word), shape and count c over all texts; the end has shape -1."""
    parts = texts.mapInArrow(_counted, "key long, shape long, c long")
    return parts.groupBy("key", "shape").agg(F.sum("c").alias("c"))


class Vocabulary:
    """The frequent words with counts and classes, and the totals of all; at most HEAD words, whatever the corpus.

    Class 0 is the end, then come words of their own, then ``buckets`` groups of the others by their shapes."""

    def __init__(self, keys: np.ndarray, shapes: np.ndarray, counts: np.ndarray, stats: dict[int, tuple[int, int]], bound: int):
        """stats: shape -> (tokens, words) over all words; bound: words with fewer occurrences aren't listed."""
        self.bound = bound
        self.total = sum(n for n, _ in stats.values())
        self.distinct = sum(v for _, v in stats.values())
        self.classes = classes_for(self.total)
        self.buckets = self.classes // 4
        self.single = self.classes - self.buckets
        order = np.lexsort((keys, -counts))
        keys, shapes, counts = keys[order], shapes[order], counts[order]
        own = np.flatnonzero(shapes >= 0)[: self.single - 1]
        kind = np.where(shapes < 0, 0, self.group(shapes))
        kind[own] = 1 + np.arange(len(own))
        n, v = np.zeros(self.classes), np.zeros(self.classes)
        for b, (t, w) in stats.items():
            k = 0 if b < 0 else int(self.group(np.array(b)))
            n[k] += t
            v[k] += w
        np.subtract.at(n, self.group(shapes[own]), counts[own])
        np.subtract.at(v, self.group(shapes[own]), 1)
        n[kind[own]] = counts[own]
        self.class_tokens = n
        self.inside = np.log10(n + v + 1)  # of groups; 0 for classes of one word
        self.inside[: self.single] = 0
        order = np.argsort(keys.view(np.uint64), kind="stable")
        self.keys, self.kind, self.logs = keys.view(np.uint64)[order], kind[order].astype(np.int16), np.log10(counts[order] + 1.0)
        self.bits = max(8, int(len(keys)).bit_length() + 1)
        self.first = np.searchsorted(self.keys >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1).astype(np.uint64)).astype(np.int32)

    def group(self, shapes: np.ndarray) -> np.ndarray:
        """The class of words with these shapes that have none of their own."""
        return self.single + shapes % self.buckets

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key among the frequent words, or -1."""
        k = keys.view(np.uint64)
        top = (k >> np.uint64(64 - self.bits)).astype(np.int64)
        at, stop = self.first[top], self.first[top + 1]
        out = np.full(len(k), -1, np.int32)
        todo = np.flatnonzero(at < stop)
        while len(todo):
            here = at[todo]
            hit = self.keys[here] == k[todo]
            out[todo[hit]] = here[hit]
            todo = todo[~hit]
            at[todo] += 1
            todo = todo[at[todo] < stop[todo]]
        return out


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    """From the counts of all words. What is collected is bounded: the head, the shapes, and the counts that occur."""
    stats = {r.shape: (r.n, r.v) for r in counts.groupBy("shape").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    steps = F.when(F.col("c") < 1000, F.col("c")).otherwise(F.floor(F.log2("c") * 64) + 10_000)  # exact below, then in steps of 1 %
    levels = counts.where("shape >= 0").groupBy(steps.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).orderBy(F.desc("step")).collect()
    bound, held = 1 << 62, 0
    for r in levels:
        held += r.n
        if held > head:
            break
        bound = r.c
    rows = counts.where((F.col("c") >= bound) | (F.col("shape") < 0)).toArrow()
    cols = [rows[k].to_numpy() for k in ("key", "shape", "c")]
    return Vocabulary(*cols, stats, bound)


def _prepared(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab: Vocabulary = shared.value
        end = vocab.find(np.array([END]))[0]
        end_log = vocab.logs[end] if end >= 0 else 0.0
        for batch in batches:
            for at, buf, offs in tb.slices(batch.column(4)):
                keys, shapes, first = tokens(buf, offs)
                n = len(offs) - 1
                found = vocab.find(keys)
                known = found >= 0
                kind = vocab.group(shapes).astype(np.int16)
                kind[known] = vocab.kind[found[known]]
                logs = np.zeros(len(keys) + 1)
                np.cumsum(np.where(known, vocab.logs[np.maximum(found, 0)] if len(vocab.logs) else 0.0, 0.0), out=logs[1:])
                # of words in groups: the log of their count without that of the group's total
                extra = np.where(known & (kind >= vocab.single), vocab.logs[np.maximum(found, 0)] if len(vocab.logs) else 0.0, 0.0) - vocab.inside[kind]
                extras = np.concatenate([[0.0], np.cumsum(extra)])
                row = np.repeat(np.arange(n), np.diff(first))
                tail = keys[~known]
                tail_first = np.concatenate([[0], np.cumsum(np.bincount(row[~known], minlength=n))])
                full = np.zeros(len(keys) + n, np.int16)  # the end is class 0
                full[np.arange(len(keys)) + row] = kind
                blob = lambda x, f, item: pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer((f * item).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())
                part = lambda c, f: c[f[1:]] - c[f[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(k).slice(at, n) for k in range(4)),
                        pa.array(np.diff(first) + 1),
                        pa.array(np.bincount(row[known], minlength=n).astype(np.int64) + int(end >= 0)),
                        pa.array(part(logs, first) + end_log),
                        pa.array(part(extras, first)),
                        blob(full, first + np.arange(n + 1), 2),
                        blob(tail, tail_first, 8),
                    ],
                    ["rid", "h", "doc_id", "held_out", "n_tokens", "n_head", "head_logs", "inside", "classes", "tail"],
                )

    return run


def _contexts(rows: pa.Array, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two classes before and the class of each token, and each row's first token."""
    rows = rows.cast(pa.large_binary())
    offs = np.frombuffer(rows.buffers()[1], np.int64)[rows.offset : rows.offset + len(rows) + 1]
    w = np.frombuffer(rows.buffers()[2], np.int16)[offs[0] // 2 : offs[-1] // 2].astype(np.int64)
    first = (offs - offs[0]) // 2
    one, two = np.empty_like(w), np.empty_like(w)
    one[1:], two[2:] = w[:-1], w[:-2]
    one[first[:-1]] = two[first[:-1]] = classes
    second = first[:-1] + 1
    two[second[second < first[1:]]] = classes
    return two, one, w, first


def start_parameters(class_tokens: np.ndarray) -> dict[str, np.ndarray]:
    rnd, n = np.random.default_rng(5), len(class_tokens)
    p = (class_tokens + 1) / (class_tokens + 1).sum()
    draw = lambda *s: rnd.standard_normal(s).astype(np.float32)
    return {"r": draw(n + 1, DIM) * 0.3, "c1": np.eye(DIM, dtype=np.float32) * 0.7, "c2": np.eye(DIM, dtype=np.float32) * 0.3, "q": draw(n, DIM) * 0.1, "b": np.log(p).astype(np.float32)}


def _summed(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Rows added up by index."""
    order = np.argsort(at, kind="stable")
    s = at[order]
    new = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    out = np.zeros((size, *rows.shape[1:]), np.float32)
    out[s[new]] = np.add.reduceat(rows[order], new, axis=0)
    return out


class Learner:
    """Adagrad on noise-contrastive batches: one set of noise classes for a batch, drawn by frequency."""

    def __init__(self, p: dict[str, np.ndarray], class_tokens: np.ndarray, seed: int):
        self.p = {k: v.copy() for k, v in p.items()}
        self.g2 = {k: np.full_like(v, START) for k, v in p.items()}
        self.share = (class_tokens + 1) / (class_tokens + 1).sum()
        self.until = np.cumsum(self.share)
        self.log_noise = np.log(NOISE * self.share).astype(np.float32)
        self.rnd, self.seen = np.random.default_rng(seed), 0

    def learn(self, two: np.ndarray, one: np.ndarray, w: np.ndarray) -> None:
        order = self.rnd.permutation(len(w))
        for i in range(0, len(w), BATCH):
            k = order[i : i + BATCH]
            self.step(two[k], one[k], w[k])
        self.seen += len(w)

    def step(self, two: np.ndarray, one: np.ndarray, w: np.ndarray) -> None:
        p, n, size = self.p, len(w), len(self.share)
        noise = np.searchsorted(self.until, self.rnd.random(NOISE)).clip(max=size - 1)
        r1, r2 = p["r"][one], p["r"][two]
        pred = r1 @ p["c1"] + r2 @ p["c2"]
        qw, qn = p["q"][w], p["q"][noise]
        d = np.einsum("nd,nd->n", pred, qw) + p["b"][w] - self.log_noise[w]
        d = -1 / (1 + np.exp(np.clip(d, -30, 30)))  # d loss / d score of the data
        e = pred @ qn.T + (p["b"][noise] - self.log_noise[noise])
        e = 1 / (1 + np.exp(-np.clip(e, -30, 30)))  # and of the noise
        dpred = d[:, None] * qw + e @ qn
        gq = _summed(w, d[:, None] * pred, size)
        np.add.at(gq, noise, e.T @ pred)
        gb = np.bincount(w, d, size).astype(np.float32)
        np.add.at(gb, noise, e.sum(0))
        gr = _summed(one, dpred @ p["c1"].T, size + 1) + _summed(two, dpred @ p["c2"].T, size + 1)
        for name, g in (("r", gr), ("c1", r1.T @ dpred), ("c2", r2.T @ dpred), ("q", gq), ("b", gb)):
            g /= n
            self.g2[name] += g * g
            p[name] -= RATE * 0.1 * g / np.sqrt(self.g2[name]) if name in ("c1", "c2") else RATE * g / np.sqrt(self.g2[name])


NAMES = ("r", "c1", "c2", "q", "b")


def _pack(p: dict[str, np.ndarray], weight: float) -> bytes:
    return np.concatenate([[weight], *(p[k].ravel().astype(np.float64) * weight for k in NAMES)]).tobytes()


def _unpack(total: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 1
    for k in NAMES:
        out[k] = (total[at : at + like[k].size] / total[0]).reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def _chunks(batches: Iterator[pa.RecordBatch], least: int = CHUNK) -> Iterator[pa.Array]:
    """The first column's rows in pieces that end with the row that completes ``least`` tokens, wherever batches end."""
    held = None
    for batch in batches:
        rows = batch.column(0) if held is None else pa.concat_arrays([held, batch.column(0)])
        upto = np.cumsum(pc.binary_length(rows).to_numpy(zero_copy_only=False) // 2)
        at, base = 0, 0
        while (cut := int(np.searchsorted(upto, base + least)) + 1) < len(rows):
            yield rows.slice(at, cut - at)
            at, base = cut, int(upto[cut - 1])
        held = rows.slice(at)
    if held is not None and len(held):
        yield held


def _learned(shared, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, class_tokens = shared.value
        learner, deals = Learner(p, class_tokens, seed), []

        def seen() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    deals[:] = deals or [batch.column(1)[0].as_py()]
                    yield batch

        for rows in _chunks(seen()):  # a partition is a learner's share, in the order of the hashes
            learner.learn(*_contexts(rows, len(class_tokens))[:3])
        if deals:
            yield pa.RecordBatch.from_arrays([pa.array(deals, pa.int32()), pa.array([_pack(learner.p, float(learner.seen))], pa.binary())], ["deal", "p"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, first = None, None
    for batch in batches:
        for deal, x in zip(batch.column(0), batch.column(1), strict=True):
            v = np.frombuffer(x.as_buffer(), np.float64)
            first = deal.as_py() if first is None else first
            total = v.copy() if total is None else total + v
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["deal", "p"])


def train(prepared: DataFrame, vocab: Vocabulary, share: int = SHARE) -> dict[str, np.ndarray]:
    """Parameters from all training documents (h, classes), in rounds of learners whose parameters are averaged.

    Which learner has a document, in which order, hangs on its hash alone; sums go in the order of the learners' numbers."""
    spark = prepared.sparkSession
    p = start_parameters(vocab.class_tokens)
    own = prepared.where("not held_out").select("classes", "h")
    sixteenth = F.pmod("h", F.lit(16))
    for k, (a, b) in enumerate(ROUNDS):
        share_of = vocab.total * (b - a) / 16
        learners = max(1, min(LEARNERS, -(-int(share_of) // share)))
        shared = spark.sparkContext.broadcast((p, vocab.class_tokens))
        deal = F.pmod(F.shiftright("h", 4), F.lit(learners)).cast("int").alias("deal")
        rows = own.where((sixteenth >= a) & (sixteenth < b)).select("classes", deal, "h")
        dealt = rows.repartitionById(learners, F.col("deal")).sortWithinPartitions("deal", "h").drop("h")
        parts = dealt.mapInArrow(_learned(shared, k), "deal int, p binary")
        few = int(np.ceil(np.sqrt(learners)))
        added = parts.repartitionById(few, F.expr(f"deal div {few}").cast("int")).sortWithinPartitions("deal").mapInArrow(_added, "deal int, p binary")
        sums = sorted(added.collect(), key=lambda r: r.deal)  # the root of the number of learners at most
        if sums:
            p = _unpack(np.sum([np.frombuffer(r.p, np.float64) for r in sums], 0), p)
    return p


class Tables:
    """log10 probabilities of classes: tables of either context position and the normaliser of all pairs."""

    def __init__(self, p: dict[str, np.ndarray], part: int = 64):
        self.one = (p["r"] @ p["c1"]) @ p["q"].T + p["b"]
        self.two = (p["r"] @ p["c2"]) @ p["q"].T
        e1 = np.exp(self.one - self.one.max(1, keepdims=True))
        top = self.one.max(1)
        n = len(p["r"])
        self.norm = np.empty((n, n), np.float32)  # [two, one]
        for i in range(0, n, part):  # exp(a + b) = exp(a) exp(b): a matrix product over classes
            t = self.two[i : i + part]
            m = t.max(1, keepdims=True)
            self.norm[i : i + part] = np.log(np.exp((t - m).astype(np.float64)) @ e1.T.astype(np.float64)) + m + top
        self.one, self.two = self.one.astype(np.float32), self.two.astype(np.float32)

    def logs(self, two: np.ndarray, one: np.ndarray, w: np.ndarray) -> np.ndarray:
        return (self.two[two, w] + self.one[one, w] - self.norm[two, one]) / np.float32(np.log(10))


def _class_scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: Tables = shared.value
        for batch in batches:
            out = []
            step = 1000
            for i in range(0, batch.num_rows, step):
                two, one, w, first = _contexts(batch.column(batch.schema.get_field_index("classes")).slice(i, step), len(tables.norm) - 1)
                total = np.concatenate([[0.0], np.cumsum(tables.logs(two, one, w), dtype=np.float64)])
                out.append(total[first[1:]] - total[first[:-1]])
            keep = [k for k, n in enumerate(batch.schema.names) if n != "classes"]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(np.concatenate(out) if out else [], pa.float64())], [*(batch.schema.names[k] for k in keep), "class_logs"])

    return run


def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tail = batch.column(1).cast(pa.large_binary())
        if not len(tail):
            continue
        offs = np.frombuffer(tail.buffers()[1], np.int64)[tail.offset : tail.offset + len(tail) + 1]
        keys = np.frombuffer(tail.buffers()[2], np.int64)[offs[0] // 8 : offs[-1] // 8] if tail.buffers()[2] else np.zeros(0, np.int64)
        rid = np.repeat(batch.column(0).to_numpy(), np.diff(offs) // 8)
        order = np.lexsort((keys, rid))
        rid, keys = rid[order], keys[order]
        new = np.ones(len(rid), bool)
        new[1:] = (rid[1:] != rid[:-1]) | (keys[1:] != keys[:-1])
        at = np.flatnonzero(new)
        yield pa.RecordBatch.from_arrays([pa.array(rid[at]), pa.array(keys[at]), pa.array(np.diff(np.append(at, len(rid))))], ["rid", "key", "m"])


def scored(docs: DataFrame, held_out: F.Column, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.xxhash64("doc_id", F.col("text").cast("string")).alias("h"), "doc_id", held_out.alias("held_out"), F.col("text").cast("string"))
    counts = written(word_counts(rows.where("not held_out").select("text")), "counts")
    vocab = vocabulary(counts, head)
    shared = spark.sparkContext.broadcast(vocab)
    kind = dict(docs.dtypes)["doc_id"]
    prepared = written(
        rows.mapInArrow(_prepared(shared), f"rid long, h long, doc_id {kind}, held_out boolean, n_tokens long, n_head long, head_logs double, inside double, classes binary, tail binary"),
        "classes",
    )
    tables = spark.sparkContext.broadcast(Tables(train(prepared, vocab)))
    by_class = prepared.drop("tail", "h").mapInArrow(
        _class_scores(tables), f"rid long, doc_id {kind}, held_out boolean, n_tokens long, n_head long, head_logs double, inside double, class_logs double"
    )
    tail = prepared.where(F.octet_length("tail") > 0).select("rid", "tail").mapInArrow(_tails, "rid long, key long, m long")
    rare = counts.where((F.col("c") < vocab.bound) & (F.col("shape") >= 0)).select("key", "c")
    tail = tail.join(rare, "key", "left").groupBy("rid").agg(
        F.sum(F.col("m") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("tail_logs"), F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("tail_known")
    )
    logs = F.coalesce("tail_logs", F.lit(0.0))
    return by_class.join(tail, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("head_logs") + logs - F.col("n_tokens") * F.lit(float(np.log10(vocab.total + vocab.distinct + 1)))).alias("base_score"),
        (F.col("class_logs") + F.col("inside") + logs).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: all documents, learned from those whose remainder modulo 7 is not 2."""
    return scored(table(spark, sf_dir, "documents"), remainder(7) == 2)
