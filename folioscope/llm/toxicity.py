"""Toxicity: a bidirectional gated recurrent network with attention pooling, over words and their characters.

A word's input is the sum of a vector for its hash and the mean of vectors for its runs of three and of five bytes (with
borders), ASCII letters in lower case and ASCII punctuation cut off as white space. Every whole text is cut into windows of
``WINDOW`` words, one every ``STRIDE``, so each place lies in the midst of some window. A window runs through a GRU in
either direction; attention pools its states, a logistic unit scores the pooled state. A text's score is that of its
worst window, and all windows of all texts are scored. Inputs are projected once for each distinct word of a slice.

Learning, on the driver, in numpy: at most ``SAMPLE`` labelled documents of each class with at most ``WINDOWS`` windows
together (those with the least hash of doc_id), whose words and windows are prepared where the texts are; no text comes to
the driver. Adam, cross-entropy of the worst window: windows that count are chosen anew in each epoch by the model as it
stands, with some at random, so that one toxic word in a long text is found and a long harmless text isn't accused. Last,
the logit is calibrated (Platt) to the share of the classes among all labelled documents.

Defined results: a null or empty text has one window without a word. Without labels, or with one class of them, the score
is the smoothed share of toxic ones (0.5 without any). Null labels and labels without a document teach nothing; a null
doc_id counts as an empty text in the split; rows stand for themselves, also repeated ones, and a doc_id that repeats
teaches with each of its texts, within the bounds. Of windows with equal scores (ties) the first counts. A very long text
is scored by one task, in whole, a slice of its windows at a time. Without documents the result is empty. Labels, language,
source and doc_id are no inputs; columns other than doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import textbuf as tb
from folioscope.llm.decontaminate import _PLAIN
from folioscope.llm.quality import labelled, remainder
from folioscope.llm.store import dropped, table, written

SAMPLE, WINDOWS, WINDOW, STRIDE = 3000, 1 << 17, 24, 12
WORDS, CHARS, DIM, HIDDEN, EPOCHS, UPDATES, BATCH, RATE = 1 << 13, 1 << 14, 12, 8, 6, 600, 64, 0.01
CUT = 0.7
NAMES = ("word", "char", "wf", "uf", "bf", "wb", "ub", "bb", "att", "att_b", "query", "out", "out_b")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Words:
    """The distinct words of some texts, and their windows. Number 0 is no word."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, window: int = WINDOW, stride: int = STRIDE):
        plain = _PLAIN[buf]
        starts, ends, first = tb.words(plain, offs)
        h = tb.hashes(plain, starts, ends)
        keys, at, number = np.unique(h, return_index=True, return_inverse=True)
        self.keys = keys
        self.bucket = (keys >> np.uint64(20)).astype(np.int64) % WORDS
        # the distinct words' bytes with a border before each and four after, then three and five bytes from each border or byte on
        s, n = starts[at], (ends - starts)[at]
        room = np.concatenate([[0], np.cumsum(n + 5)]).astype(np.int64)
        text = np.full(room[-1] + 5, 32, np.uint64)
        inner = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        text[np.repeat(room[:-1] + 1 - inner[:-1], n) + np.arange(inner[-1])] = plain[np.repeat(s - inner[:-1], n) + np.arange(inner[-1])]
        self.n = 2 * n
        self.split = np.concatenate([[0], np.cumsum(self.n)]).astype(np.int64)
        k = np.arange(self.split[-1]) - np.repeat(self.split[:-1], self.n)
        where = np.repeat(room[:-1], self.n) + k // 2
        key = text[where] + (text[where + 1] << np.uint64(8)) + (text[where + 2] << np.uint64(16))
        key += np.where(k % 2 == 1, (text[where + 3] << np.uint64(24)) + (text[where + 4] << np.uint64(32)) + np.uint64(1 << 40), np.uint64(0))
        self.tri = (tb.mix(key) >> np.uint64(30)).astype(np.int64) % CHARS
        count = np.diff(first)
        per = np.maximum(1, -(-np.maximum(count - window, 0) // stride) + 1)
        self.text = np.repeat(np.arange(len(count)), per)  # of each window
        self.first = np.concatenate([[0], np.cumsum(per)])
        k = np.arange(len(self.text)) - self.first[self.text]
        place = first[:-1][self.text][:, None] + (k * stride)[:, None] + np.arange(window)
        inside = place < first[1:][self.text][:, None]
        ids = np.zeros(place.shape, np.int32)
        ids[inside] = number[place[inside]] + 1
        self.windows = ids

    def packed(self) -> tuple[bytes, bytes]:
        """A single text's words, by their hashes, and its windows of them, as bytes."""
        return self.keys.tobytes(), self.windows.astype(np.uint16 if len(self.keys) < 1 << 16 else np.int32).tobytes()

    @classmethod
    def unpacked(cls, keys: bytes, windows: bytes, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Words:
        """table: the hashes of all words of all texts, ascending, where their runs begin, and the runs."""
        out = cls.__new__(cls)
        out.keys, out.table = np.frombuffer(keys, np.uint64), table
        out.windows = np.frombuffer(windows, np.uint16 if len(out.keys) < 1 << 16 else np.int32).reshape(-1, WINDOW)
        out.text, out.first = np.zeros(len(out.windows), np.int64), np.array([0, len(out.windows)])
        return out

    @classmethod
    def joined(cls, parts: list[Words]) -> Words:
        """The words and windows of several groups of texts as one."""
        out = cls.__new__(cls)
        keys, split, runs = parts[0].table if hasattr(parts[0], "table") else cls._runs(parts)
        out.keys = np.unique(np.concatenate([w.keys for w in parts]))
        at = np.searchsorted(keys, out.keys)
        out.bucket, out.n = (out.keys >> np.uint64(20)).astype(np.int64) % WORDS, split[at + 1] - split[at]
        out.split = np.concatenate([[0], np.cumsum(out.n)]).astype(np.int64)
        out.tri = runs[np.repeat(split[at] - out.split[:-1], out.n) + np.arange(out.split[-1])]
        out.windows = np.concatenate([np.concatenate([[0], np.searchsorted(out.keys, w.keys) + 1]).astype(np.int32)[w.windows] for w in parts])
        texts = np.concatenate([[0], np.cumsum([len(w.first) - 1 for w in parts])])
        out.text = np.concatenate([w.text + k for w, k in zip(parts, texts[:-1], strict=True)])
        out.first = np.concatenate([[0], np.cumsum(np.bincount(out.text, minlength=texts[-1]))])
        return out

    @staticmethod
    def _runs(parts: list[Words]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The table of parts that have their words with them."""
        keys, at = np.unique(np.concatenate([w.keys for w in parts]), return_index=True)
        n = np.concatenate([w.n for w in parts])
        old, n = np.concatenate([[0], np.cumsum(n)])[at], n[at]
        split = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        return keys, split, np.concatenate([w.tri for w in parts])[np.repeat(old - split[:-1], n) + np.arange(split[-1])]

    def vectors(self, p: dict) -> np.ndarray:
        """The input of each distinct word; that of no word is 0."""
        out = np.zeros((len(self.bucket) + 1, p["word"].shape[1]), np.float32)
        if len(self.bucket):
            out[1:] = np.add.reduceat(p["char"][self.tri], self.split[:-1]) / self.n[:, None] + p["word"][self.bucket]
        return out


def new_parameters(seed: int = 7) -> dict:
    rnd = np.random.default_rng(seed)
    shape = {
        "word": (WORDS, DIM), "char": (CHARS, DIM), "wf": (DIM, 3 * HIDDEN), "uf": (HIDDEN, 3 * HIDDEN), "bf": (3 * HIDDEN,), "wb": (DIM, 3 * HIDDEN),
        "ub": (HIDDEN, 3 * HIDDEN), "bb": (3 * HIDDEN,), "att": (2 * HIDDEN, HIDDEN), "att_b": (HIDDEN,), "query": (HIDDEN,), "out": (2 * HIDDEN,), "out_b": (1,),
    }
    scale = {"word": 0.1, "char": 0.3}
    return {k: (rnd.standard_normal(s) * (0 if k.endswith("b") and len(s) == 1 and k != "out" else scale.get(k, 1 / np.sqrt(s[0])))).astype(np.float32) for k, s in shape.items()}


def _run(xp: np.ndarray, ids: np.ndarray, u: np.ndarray, back: bool, keep: list | None) -> np.ndarray:
    """Hidden states (steps, windows, HIDDEN) of one direction; xp: projected inputs of the distinct words."""
    n, steps = ids.shape
    hid = u.shape[0]
    h = np.zeros((n, hid), np.float32)
    out = np.empty((steps, n, hid), np.float32)
    for t in range(steps - 1, -1, -1) if back else range(steps):
        w = ids[:, t]
        x, g = xp[w], h @ u
        zr = x[:, : 2 * hid] + g[:, : 2 * hid]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        z, r = zr[:, :hid], zr[:, hid:]
        c = np.tanh(x[:, 2 * hid :] + r * g[:, 2 * hid :])
        m = (w > 0)[:, None]
        new = np.where(m, c + z * (h - c), h)
        if keep is not None:
            keep.append((t, h, g, z, r, c, m))
        h = new
        out[t] = h
    return out


def forward(p: dict, vectors: np.ndarray, ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logits of windows."""
    kf, kb = ([], []) if keep is not None else (None, None)
    hf = _run(vectors @ p["wf"] + p["bf"], ids, p["uf"], False, kf)
    hb = _run(vectors @ p["wb"] + p["bb"], ids, p["ub"], True, kb)
    h = np.concatenate([hf, hb], 2)
    a = np.tanh(h @ p["att"] + p["att_b"])
    e = a @ p["query"]
    e[(ids == 0).T] = -30
    e = np.exp(e - e.max(0))
    e /= e.sum(0)
    pooled = np.einsum("tn,tnk->nk", e, h)
    if keep is not None:
        keep.update(kf=kf, kb=kb, h=h, a=a, e=e, pooled=pooled)
    return pooled @ p["out"] + p["out_b"][0]


def _summed(at: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
    """Rows added to out by index."""
    if len(at):
        order = np.argsort(at, kind="stable")
        s = at[order]
        new = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        out[s[new]] += np.add.reduceat(rows[order], new, axis=0)


def _back(p: dict, g: dict, kept: list, dh_all: np.ndarray, names: tuple, vectors: np.ndarray, ids: np.ndarray, dvec: np.ndarray) -> None:
    """Gradients of one direction, added to g and to those of the words' vectors."""
    wn, un, bn = names
    u, hid = p[un], p[un].shape[0]
    dh = np.zeros_like(dh_all[0])
    dxp = np.zeros((len(vectors), 3 * hid), np.float32)
    steps = []
    for t, h, gates, z, r, c, m in reversed(kept):
        dh = dh + dh_all[t]
        d = dh * m
        dz = d * (h - c) * z * (1 - z)
        dc = d * (1 - z) * (1 - c * c)
        dr = dc * gates[:, 2 * hid :] * r * (1 - r)
        dg = np.concatenate([dz, dr, dc * r], 1)
        steps.append((ids[:, t], np.concatenate([dz, dr, dc], 1)))
        g[un] += h.T @ dg
        dh = dh * ~m + d * z + dg @ u.T
    _summed(*(np.concatenate(x) for x in zip(*steps, strict=True)), dxp)
    dxp[0] = 0
    g[wn] += vectors.T @ dxp
    g[bn] += dxp.sum(0)
    dvec += dxp @ p[wn].T


def gradients(p: dict, words: Words, ids: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
    """Cross-entropy of windows and its gradient."""
    g = {k: np.zeros_like(v) for k, v in p.items()}
    vectors, keep = words.vectors(p), {}
    prob = _sigmoid(forward(p, vectors, ids, keep))
    d = ((prob - y) * weight).astype(np.float32)
    h, a, e = keep["h"], keep["a"], keep["e"]
    g["out"] += d @ keep["pooled"]
    g["out_b"] += d.sum()
    dp = d[:, None] * p["out"]
    dh = e[:, :, None] * dp
    de = np.einsum("tnk,nk->tn", h, dp)
    de = e * (de - (e * de).sum(0))
    de[(ids == 0).T] = 0
    g["query"] += np.einsum("tn,tnk->k", de, a)
    da = de[:, :, None] * p["query"] * (1 - a * a)
    g["att"] += np.einsum("tnk,tnj->kj", h, da)
    g["att_b"] += da.sum((0, 1))
    dh += da @ p["att"].T
    hid = p["uf"].shape[0]
    dvec = np.zeros_like(vectors)
    _back(p, g, keep["kf"], dh[:, :, :hid], ("wf", "uf", "bf"), vectors, ids, dvec)
    _back(p, g, keep["kb"], dh[:, :, hid:], ("wb", "ub", "bb"), vectors, ids, dvec)
    used = np.flatnonzero(np.abs(dvec[1:]).sum(1))
    _summed(words.bucket[used], dvec[1 + used], g["word"])
    n = words.n[used]
    tri = np.repeat(words.split[:-1][used] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    _summed(words.tri[tri], np.repeat(dvec[1 + used] / n[:, None], n, axis=0), g["char"])
    loss = -np.log(np.where(y == 1, prob, 1 - prob) + 1e-9)
    return float((loss * weight).sum()), g


class Model:
    """Parameters and the calibration (scale, shift) of the worst window's logit."""

    def __init__(self, p: dict | None = None, scale: float = 0.0, shift: float = 0.0):
        self.p, self.scale, self.shift = p, scale, shift

    def worst(self, words: Words, part: int = 8192) -> np.ndarray:
        """The largest logit of each text's windows."""
        vectors = words.vectors(self.p)
        logits = np.concatenate([forward(self.p, vectors, words.windows[i : i + part]) for i in range(0, len(words.windows), part)])
        return logits

    def score(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        if self.p is None:
            return np.full(len(offs) - 1, float(_sigmoid(np.array(self.shift))))
        words = Words(buf, offs)
        top = np.maximum.reduceat(self.worst(words), words.first[:-1])
        return _sigmoid(self.scale * top.astype(np.float64) + self.shift)


def _platt(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one variable with smoothed targets, by Newton steps that are halved until they help."""
    mid = (x[y == 1].mean() + x[y == 0].mean()) / 2 if 0 < y.sum() < len(y) else x.mean()
    wide = x.std() or 1.0
    z = np.stack([(x - mid) / wide, np.ones_like(x)], 1)
    soft = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))

    def loss(v: np.ndarray) -> float:
        t = z @ v
        return float((weight * (np.logaddexp(0, t) - soft * t)).sum() + 0.5e-3 * v @ v)

    v = np.array([1.0, 0.0])
    for _ in range(100):
        q = _sigmoid(z @ v)
        grad = z.T @ ((q - soft) * weight) + 1e-3 * v
        hess = (z * (q * (1 - q) * weight)[:, None]).T @ z + 1e-3 * np.eye(2)
        step, now = np.linalg.solve(hess, grad), loss(v)
        while np.abs(step).max() > 1e-9 and loss(v - step) > now:
            step = step / 2
        v = v - step
        if np.abs(step).max() < 1e-7:
            break
    scale = max(float(v[0]), 0.05) / wide
    return scale, float(v[1]) - scale * float(mid)


def fit(texts: list[Words], y: np.ndarray, share: float, seed: int = 11) -> Model:
    """From labelled texts. share: of toxic ones among all labelled documents, to which the scores are calibrated.

    At least EPOCHS epochs, and as many more as small samples need for UPDATES steps, up to four times that."""
    bad = float(y.sum())
    if not 0 < bad < len(y):
        return Model(None, 0.0, float(np.log((bad + 1) / (len(y) - bad + 1))))
    rnd = np.random.default_rng(seed)
    order = rnd.permutation(len(y))
    held = order[: len(y) // 5]  # for the calibration alone
    own = order[len(y) // 5 :]

    def prepared(rows: np.ndarray) -> Words:
        return Words.joined([texts[i] for i in rows])

    words, target = prepared(own), y[own]
    p = new_parameters(seed)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    model, t = Model(p, 1.0, 0.0), 0
    n_bad, n_good = max(1.0, target.sum()), max(1.0, (1 - target).sum())
    epochs = min(4 * EPOCHS, max(EPOCHS, -(-UPDATES * BATCH // (2 * len(own)))))
    for epoch in range(epochs):
        logits = model.worst(words)
        rows, weights = [], []
        for i in range(len(own)):
            a, b = words.first[i], words.first[i + 1]
            weight = 0.5 / n_bad if target[i] else 0.5 / n_good
            some = rnd.integers(a, b, min(2, b - a)) if (epoch == 0 or not target[i]) else np.zeros(0, np.int64)
            top = a + np.argsort(-logits[a:b], kind="stable")[: 1 if epoch else 2]
            pick = np.unique(np.concatenate([top, some]))
            rows.append(pick)
            weights.append(np.full(len(pick), weight / len(pick)))
        rows, weights = np.concatenate(rows), np.concatenate(weights)
        weights *= len(rows) / weights.sum()
        for part in np.array_split(rnd.permutation(len(rows)), max(1, len(rows) // BATCH)):
            ids = words.windows[rows[part]]
            used, local = np.unique(ids, return_inverse=True)
            local = local.reshape(ids.shape)
            if used[0] != 0:
                used, local = np.concatenate([[0], used]), local + 1
            few = _subset(words, used[1:])
            _, g = gradients(p, few, local, target[words.text[rows[part]]], weights[part] / len(part))
            t += 1
            rate = RATE * (0.3 if epoch >= epochs - 2 else 1.0)
            for k in p:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.001 * (g[k] ** 2 - v[k])
                p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-7)
    calm = prepared(held) if len(held) > 20 else words
    truth = y[held] if len(held) > 20 else target
    top = np.maximum.reduceat(model.worst(calm), calm.first[:-1]).astype(np.float64)
    weight = np.where(truth == 1, share / max(1, truth.sum()), (1 - share) / max(1, (1 - truth).sum())) * len(truth)
    model.scale, model.shift = _platt(top, truth, weight)
    return model


def _subset(words: Words, numbers: np.ndarray) -> Words:
    """Only the words with these numbers (from 1), renumbered in that order."""
    few = Words.__new__(Words)
    k = numbers - 1
    few.bucket, few.n = words.bucket[k], words.n[k]
    few.split = np.concatenate([[0], np.cumsum(few.n)]).astype(np.int64)
    at = np.repeat(words.split[:-1][k] - few.split[:-1], few.n) + np.arange(few.split[-1])
    few.tri = words.tri[at]
    return few


def _windowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What learning needs of each text: its distinct words, as hashes, its windows of them, and the words' hashed runs of bytes."""
    for batch in batches:
        texts = batch.column(2).cast(pa.large_binary()).fill_null(b"")
        rows, size, runs = [], [], []
        for k in range(len(texts)):
            buf = np.frombuffer(texts[k].as_buffer(), np.uint8)
            own = Words(buf, np.array([0, len(buf)]))
            tri = own.tri.astype(np.uint16)
            rows.append(own.packed())
            size.append(len(own.windows))
            runs.append([(x, tri[a:b].tobytes()) for x, a, b in zip(own.keys.view(np.int64).tolist(), own.split[:-1].tolist(), own.split[1:].tolist(), strict=True)])
        columns = [pa.array(size, pa.int64()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1)), pa.array(runs, pa.list_(pa.struct([("key", pa.int64()), ("runs", pa.binary())])))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), *columns], ["n", "h", "label", "size", "keys", "windows", "words"])


def chosen(sizes: list[tuple], most: int, windows: int) -> list[int]:
    """Numbers of the rows (h, size, n) to learn from: those with the least h, at most ``most``, with ``windows`` windows together."""
    out, left = [], windows
    for _, size, n in sorted(sizes):
        if len(out) < most and size <= left:
            out.append(n)
            left -= size
    return out


def candidates(held: DataFrame, most: int) -> DataFrame:
    """(label, h, size, n) of the ``most`` rows of each label with the least h: the driver's share, also where a doc_id repeats."""
    parts = [held.where(F.col("label") == k).select("label", "h", "size", "n").orderBy("h", "size", "n").limit(most) for k in (0, 1)]
    return parts[0].union(parts[1])


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, windows: int = WINDOWS) -> Model:
    """The model, learned from labels whose remainder modulo 3 is not 1. The driver gets windows, no texts."""
    learn = remainder(3) != 1
    parts = [labelled(docs, labels.where(F.col("toxic") == k), "toxic", learn, most) for k in (0, 1)]
    rows = parts[0].union(parts[1]).select(F.monotonically_increasing_id().alias("n"), "h", "text", "label")
    shape = "n long, h long, label int, size long, keys binary, windows binary, words array<struct<key: long, runs: binary>>"
    held = written(rows.mapInArrow(_windowed, shape), "windows")
    light = candidates(held, most).collect()
    pick = [n for k in (0, 1) for n in chosen([(r.h, r.size, r.n) for r in light if r.label == k], most, windows)]
    wanted = held.join(F.broadcast(docs.sparkSession.createDataFrame([(n,) for n in pick], "n long")), "n")
    table_ = wanted.select("h", "label", "keys", "windows").toArrow()  # 2 * windows windows at the most
    table_ = table_.sort_by([("h", "ascending"), ("label", "ascending"), ("keys", "ascending"), ("windows", "ascending")])
    words = wanted.select(F.explode("words").alias("w")).groupBy("w.key").agg(F.first("w.runs").alias("runs")).toArrow()  # each word of them once
    keys = words["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    runs = [np.frombuffer(x, np.uint16) for x in words["runs"].combine_chunks().take(pa.array(order)).to_pylist()]
    lookup = keys[order], np.concatenate([[0], np.cumsum([len(x) for x in runs])]).astype(np.int64), np.concatenate([np.zeros(0, np.uint16), *runs])
    texts = [Words.unpacked(k.as_py(), w.as_py(), lookup) for k, w in zip(table_["keys"].combine_chunks(), table_["windows"].combine_chunks(), strict=True)]
    y = table_["label"].to_numpy().astype(np.float64)
    dropped(held)
    n = labels.where(learn & F.col("toxic").isin(0, 1)).agg(F.avg("toxic").alias("share")).first().share
    return fit(texts, y, float(n or 0.0))


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at, buf, offs in tb.slices(batch.column(1)):
                p = model.score(buf, offs)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(p)), pa.array(p)], ["doc_id", "score"])

    return run


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_scored(shared), f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
