"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy (operator 8)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Numbering, slices, utf8, words

#: Words of a window and words between the starts of windows: neighbours share a quarter.
WINDOW, STRIDE = 32, 24
#: Rows of the hashed word and character tables, their width, and the width of each direction's state.
WORD_ROWS, CHAR_ROWS, DIMS, STATE = 8_192, 8_192, 8, 8
#: Training sample: at most so many labelled texts of each label, by hash of the id, and so many words of them in all.
TRAIN_TEXTS, TRAIN_WORDS = 1_500, 1_200_000
EPOCHS, ANY_WINDOW_EPOCHS, BATCH, RATE, SEED = 14, 3, 128, 0.01, 11
#: Small samples go round more often, up to about so many steps.
LEAST_STEPS, MOST_EPOCHS = 400, 60


def spans(n: int) -> np.ndarray:
    """Starts of the overlapping windows of a text of ``n`` words; a text without words has one empty window."""
    return np.arange(0, max(n - (WINDOW - STRIDE), 1), STRIDE)


class Vocabulary:
    """Distinct words of some texts with their rows in the word table and in the table of character trigrams."""

    def __init__(self, texts: list[list[bytes]]):
        known = Numbering()
        self.codes = np.fromiter(map(known.__getitem__, chain.from_iterable(texts)), np.int32)
        self.lengths = np.array([len(ws) for ws in texts], np.int64)
        self.size = len(known)
        self.word = np.fromiter((zlib.crc32(w) % WORD_ROWS for w in known), np.int64, self.size)
        # Trigrams of <word> for all words at once: < and > can't be in a word.
        raw = np.frombuffer(b"<" + b"><".join(known) + b">", np.uint8).astype(np.int64)
        begins = np.flatnonzero(raw == ord("<"))
        tri = (raw[:-2] * 961 + raw[1:-1]) * 961 + raw[2:]
        inside = np.ones(len(tri), bool)
        inside[begins[1:] - 1] = inside[begins[1:] - 2] = False  # those that reach into the next word
        self.char = ((tri * 0x9E3779B1 & 0xFFFFFFFF) >> 7)[inside] % CHAR_ROWS if self.size else np.zeros(0, np.int64)
        sizes = np.fromiter((len(w) for w in known), np.int64, self.size)  # <word> has as many trigrams as the word has bytes
        self.of = np.repeat(np.arange(self.size), sizes)
        self.each = sizes

    def inputs(self, p: dict[str, np.ndarray]) -> np.ndarray:
        """One row for each distinct word: its word vector and the mean of its trigrams' vectors."""
        if not self.size:
            return np.zeros((0, 2 * DIMS), np.float32)
        begins = np.concatenate([[0], np.cumsum(self.each)[:-1]])
        chars = np.add.reduceat(p["char"][self.char], begins, axis=0) / self.each[:, None].astype(np.float32)
        return np.concatenate([p["word"][self.word], chars], 1)


def windows_of(v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first position in ``v.codes`` and length of each window."""
    starts = [spans(int(n)) for n in v.lengths]
    doc = np.repeat(np.arange(len(starts)), [len(s) for s in starts])
    at = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum(v.lengths)])[:-1]
    return doc, at + offsets[doc], np.minimum(v.lengths[doc] - at, WINDOW)


def new_parameters(rng: np.random.Generator) -> dict[str, np.ndarray]:
    wide = lambda *shape: (rng.standard_normal(shape) * (1 / np.sqrt(shape[0]))).astype(np.float32)
    p = {"word": wide(WORD_ROWS, DIMS) * np.float32(np.sqrt(WORD_ROWS) * 0.1), "char": wide(CHAR_ROWS, DIMS) * np.float32(np.sqrt(CHAR_ROWS) * 0.1)}
    for side in "fb":
        p |= {f"w{side}": wide(2 * DIMS, 3 * STATE), f"u{side}": wide(STATE, 3 * STATE), f"b{side}": np.zeros(3 * STATE, np.float32)}
    return p | {"wa": wide(2 * STATE, STATE), "ba": np.zeros(STATE, np.float32), "va": wide(STATE), "wo": wide(2 * STATE), "bo": np.full(1, -1.0, np.float32)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _run(g: np.ndarray, u: np.ndarray, mask: np.ndarray | None, order: range, keep: list | None = None) -> np.ndarray:
    """States (T, n, STATE) of one direction; g: gate inputs (T, n, 3 STATE). ``keep`` gets what the gradient needs."""
    h = np.zeros((g.shape[1], STATE), np.float32)
    out = np.empty((len(order), g.shape[1], STATE), np.float32)
    for t in order:
        a = h @ u
        zr = _sigmoid(g[t, :, : 2 * STATE] + a[:, : 2 * STATE])
        z, r = zr[:, :STATE], zr[:, STATE:]
        cand = np.tanh(g[t, :, 2 * STATE :] + r * a[:, 2 * STATE :])
        new = cand + z * (h - cand)
        if keep is not None:
            keep.append((t, h, z, r, cand, a[:, 2 * STATE :]))
        h = new if mask is None else np.where(mask[t][:, None], new, h)
        out[t] = h
    return out


def _pool(hidden: np.ndarray, mask: np.ndarray | None, p: dict) -> tuple[np.ndarray, ...]:
    s = np.tanh(hidden @ p["wa"] + p["ba"])
    e = s @ p["va"]
    if mask is not None:
        e = np.where(mask, e, -1e9)
    a = np.exp(e - e.max(0))
    if mask is not None:
        a = a * mask
    a /= np.maximum(a.sum(0), 1e-9)
    c = np.einsum("tn,tnh->nh", a, hidden)
    return s, a, c, c @ p["wo"] + p["bo"][0]


def logits(v: Vocabulary, at: np.ndarray, n: np.ndarray, p: dict[str, np.ndarray], chunk: int = 4_096) -> np.ndarray:
    """One for each window. Gate inputs are made once for each distinct word; windows run in chunks, full ones first."""
    x = v.inputs(p)
    none = np.zeros((1, 2 * DIMS), np.float32)
    gates = {side: np.concatenate([x, none]) @ p[f"w{side}"] + p[f"b{side}"] for side in "fb"}
    codes = np.concatenate([v.codes, np.full(WINDOW, v.size, np.int32)])
    out = np.empty(len(at), np.float32)
    whole = n == WINDOW
    for of, full in ((np.flatnonzero(whole), True), (np.flatnonzero(~whole), False)):
        for k in range(0, len(of), chunk):
            some = of[k : k + chunk]
            steps = WINDOW if full else max(1, int(n[some].max()))
            c = codes[at[some][None, :] + np.arange(steps)[:, None]]
            mask = None if full else np.arange(steps)[:, None] < n[some][None, :]
            f = _run(np.take(gates["f"], c, 0), p["uf"], mask, range(steps))
            b = _run(np.take(gates["b"], c, 0), p["ub"], mask, range(steps - 1, -1, -1))
            out[some] = _pool(np.concatenate([f, b], 2), mask, p)[3]
    return out


def gradients(v: Vocabulary, at: np.ndarray, n: np.ndarray, y: np.ndarray, p: dict[str, np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
    """Mean log loss of the windows and its gradient."""
    x = v.inputs(p)
    padded = np.concatenate([x, np.zeros((1, 2 * DIMS), np.float32)])
    codes = np.concatenate([v.codes, np.full(WINDOW, v.size, np.int32)])[at[None, :] + np.arange(WINDOW)[:, None]]
    mask = np.arange(WINDOW)[:, None] < n[None, :]
    xs = padded[codes]
    kept: dict[str, list] = {"f": [], "b": []}
    sides = {"f": range(WINDOW), "b": range(WINDOW - 1, -1, -1)}
    states = [_run(xs @ p[f"w{s}"] + p[f"b{s}"], p[f"u{s}"], mask, sides[s], kept[s]) for s in "fb"]
    hidden = np.concatenate(states, 2)
    s, a, c, logit = _pool(hidden, mask, p)
    prob = _sigmoid(logit)
    loss = float(-np.mean(y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9)))
    d = ((prob - y) / len(y)).astype(np.float32)
    g = {"wo": c.T @ d, "bo": np.array([d.sum()], np.float32)}
    dc = d[:, None] * p["wo"]
    dh = a[:, :, None] * dc
    da = np.einsum("nh,tnh->tn", dc, hidden)
    de = a * (da - (a * da).sum(0))
    g["va"] = np.einsum("tn,tnk->k", de, s)
    ds = de[:, :, None] * p["va"] * (1 - s * s)
    g["wa"], g["ba"] = np.einsum("tnh,tnk->hk", hidden, ds), ds.sum((0, 1))
    dh = dh + ds @ p["wa"].T
    dx = np.zeros_like(xs)
    for k, side in enumerate("fb"):
        u = p[f"u{side}"]
        du, back = np.zeros_like(u), np.zeros((len(y), STATE), np.float32)
        dg = np.zeros((WINDOW, len(y), 3 * STATE), np.float32)
        for t, h, z, r, cand, un in reversed(kept[side]):
            total = dh[t, :, k * STATE : (k + 1) * STATE] + back
            m = mask[t][:, None]
            new = total * m
            dcand = new * (1 - z) * (1 - cand * cand)
            dz, dr = new * (h - cand) * z * (1 - z), dcand * un * r * (1 - r)
            inner = np.concatenate([dz, dr, dcand * r], 1)
            du += h.T @ inner
            dg[t] = np.concatenate([dz, dr, dcand], 1)
            back = total * ~m + new * z + inner @ u.T
        g[f"u{side}"], g[f"b{side}"] = du, dg.sum((0, 1))
        g[f"w{side}"] = np.einsum("tni,tnj->ij", xs, dg)
        dx += dg @ p[f"w{side}"].T
    by_word = np.zeros((v.size + 1, 2 * DIMS), np.float32)
    np.add.at(by_word, codes.ravel(), dx.reshape(-1, 2 * DIMS))
    g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
    np.add.at(g["word"], v.word, by_word[:-1, :DIMS])
    np.add.at(g["char"], v.char, (by_word[:-1, DIMS:] / np.maximum(v.each, 1)[:, None])[v.of])
    return loss, g


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m = {k: np.zeros_like(x) for k, x in p.items()}
        self.v = {k: np.zeros_like(x) for k, x in p.items()}

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, x in self.p.items():
            self.m[k] += 0.1 * (g[k] - self.m[k])
            self.v[k] += 0.001 * (g[k] ** 2 - self.v[k])
            x -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def train(texts: list[list[bytes]], labels: list[int], epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """Multiple-instance training: a text is as toxic as its most toxic window, so after a few rounds on any windows the
    network sees each text's highest-scoring one (and one more of clean texts)."""
    rng = np.random.default_rng(SEED)
    p = new_parameters(rng)
    if not texts or len(set(labels)) < 2:
        p["wo"] *= 0
        p["bo"][:] = 4.0 if labels and min(labels) == 1 else -4.0
        return p
    v, y = Vocabulary(texts), np.array(labels, np.float32)
    doc, at, n = windows_of(v)
    first = np.searchsorted(doc, np.arange(len(texts)))
    count = np.bincount(doc, minlength=len(texts))
    adam = Adam(p, RATE)
    epochs = max(epochs, min(MOST_EPOCHS, LEAST_STEPS * BATCH // len(texts)))
    for epoch in range(epochs):
        some = first + (rng.random(len(texts)) * count).astype(int)
        if epoch < ANY_WINDOW_EPOCHS:
            more = [first + (rng.random(len(texts)) * count).astype(int) for _ in range(3)]
            chosen = np.concatenate([some, *more])
        else:
            z = logits(v, at, n, p)
            best = np.lexsort((-z, doc))[first]
            chosen = np.concatenate([best, some[y == 0]])
        chosen = rng.permutation(chosen)
        if epoch == epochs * 2 // 3:
            adam.rate /= 4
        for k in range(0, len(chosen), BATCH):
            w = chosen[k : k + BATCH]
            # The batch's own words, so that its gradient touches few rows.
            part = [v.codes[at[i] : at[i] + n[i]] for i in w]
            own, codes = np.unique(np.concatenate(part), return_inverse=True)
            small = _subset(v, own, codes.astype(np.int32))
            sizes = np.array([len(x) for x in part])
            begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            adam.step(gradients(small, begin, sizes, y[doc[w]], p)[1])
    return p


def _subset(v: Vocabulary, own: np.ndarray, codes: np.ndarray) -> Vocabulary:
    out = object.__new__(Vocabulary)
    begins = np.concatenate([[0], np.cumsum(v.each)])
    out.codes, out.size, out.word, out.each = codes, len(own), v.word[own], v.each[own]
    out.char = np.concatenate([v.char[begins[i] : begins[i + 1]] for i in own]) if len(own) else v.char[:0]
    out.of = np.repeat(np.arange(len(own)), out.each)
    return out


def score_texts(texts: list[list[bytes]], p: dict[str, np.ndarray]) -> np.ndarray:
    """The highest window score of each text."""
    if not texts:
        return np.zeros(0)
    v = Vocabulary(texts)
    doc, at, n = windows_of(v)
    z = logits(v, at, n, p)
    top = np.full(len(texts), -np.inf, np.float32)
    np.maximum.at(top, doc, z)
    return _sigmoid(top.astype(np.float64))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[list[list[bytes]], list[int]]:
    """Words and labels of a bounded sample; a text with contrary labels counts as toxic. Of rows with one id the first text
    in order counts, so the sample is the same in every run."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__of")).agg(F.max(label_col).cast("int").alias("__y"))
    counts = {r[0]: r[1] for r in known.groupBy("__y").count().collect()}
    unit = F.pmod(F.xxhash64(F.lit("toxicity"), "__of"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("__y") == 1, min(1.0, 1.1 * TRAIN_TEXTS / max(counts.get(1, 0), 1))).otherwise(min(1.0, 1.1 * TRAIN_TEXTS / max(counts.get(0, 0), 1)))
    picked = known.withColumn("__u", unit).where(F.col("__u") < share)  # at most about 2.2 * TRAIN_TEXTS ids, whatever the input
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("t"))
    rows = texts.join(F.broadcast(picked), F.col("__id") == F.col("__of")).where("t is not null").groupBy("__of", "__y", "__u").agg(F.min("t").alias("t")).select("__y", "__u", "t").collect()
    texts, ys, total, of = [], [], 0, {0: 0, 1: 0}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        w = words(r[2].encode())
        if of[r[0]] < TRAIN_TEXTS and w and (total + len(w) <= TRAIN_WORDS):
            texts.append(w)
            ys.append(r[0])
            total += len(w)
            of[r[0]] += 1
    return texts, ys


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Toxicity of each whole text, learned from ``labels`` on a bounded sample of labelled texts.

    Columns: the id, ``score`` double (0 to 1, the highest of all overlapping windows), ``predicted`` int (1 from 0.5 up).

    Null texts and texts without words score 0. Labels that are null or neither 0 nor 1 teach nothing; with one label only,
    or none, every text gets one constant score. Repeated rows give repeated results, null ids stay, other columns are not
    read, an empty table gives no rows. The network (0.6 MB) is broadcast; scoring is one pass without shuffle.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(*training_sample(docs, labels, id_col, text_col, label_col)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            texts = [words(t) for t in utf8(batch.column(1))]
            s = np.where([len(t) > 0 for t in texts], score_texts(texts, model.value), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[id_col, "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(score, f"`{id_col}` {kind}, score double, predicted int")
