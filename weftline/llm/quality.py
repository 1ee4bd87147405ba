"""Quality classifier: an interpolated modified Kneser-Ney model of word pairs, with language-specific thresholds (operator 6).

The log probability of a text is a sum over its words and pairs, as in back-off tables: a word gives its lower-order
probability, a context the weight of the lower order after it, and a pair that the trusted texts hold what its own share
adds. Counting and scoring are joins of shards of packed pairs, whatever the model's size:

1. Pairs of the trusted texts are counted by shards of their second word, so a shard knows in how many contexts each of its
   words stands: all that the lower order needs.
2. The counts go on to shards of their first word, with the second words' numbers of contexts, and meet what the texts ask
   there. A shard knows all pairs of its contexts, so it makes the pairs' values itself.

Frequent words and pairs (a bounded number) are known to all tasks: frequent words' pairs are dealt by both words, so no
shard is larger than others, and texts look frequent ones up where they are.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, Numbering, in_small_batches, materialise, mix64, slices, utf8, words

#: Texts above this quantile of the perplexities of trusted texts of their language are rejected.
QUANTILE = 0.99
#: One trusted text in this many isn't counted, and serves for the thresholds. Equal texts are on the same side.
CALIBRATE = 10
#: Relative accuracy of the quantile sketch.
ACCURACY = 10_000
#: Bytes of text by shard, and the least number of shards.
SHARD_BYTES, SHARDS = 40_000_000, 16
#: Words of a block of texts, which is worked on at once.
BLOCK = 2_500_000
#: Words and pairs with at least this share of all words are known to all tasks: at most 2 / HOT of each, however large the input.
HOT = 1e-5
#: Bytes of a word's number: of a hundred million words, one in ten thousand shares its number with another.
WORD_BYTES = 5
# Numbers of no word: start and end of a text, and the second half of a word that comes alone.
START, END, ALONE, FIRST_WORD = 0, 1, 2, 3
_EMPTY = np.zeros(0, np.uint64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes, each with the first bytes of all its numbers first, then the second bytes, and so on."""
    raw = [np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes() for x in arrays]
    return zstandard.compress(pickle.dumps(([(x.dtype.str, len(x)) for x in arrays], raw)))


def unpack(data: bytes) -> list[np.ndarray]:
    kinds, raw = pickle.loads(zstandard.decompress(data))
    return [np.frombuffer(r, np.uint8).reshape(-1, n).T.copy().view(d).ravel() if n else np.zeros(0, d) for (d, n), r in zip(kinds, raw)]


def pack_pairs(names: np.ndarray, a: np.ndarray, b: np.ndarray, more: list[np.ndarray], of_names: list[np.ndarray]) -> bytes:
    """Pairs of places in the sorted ``names``, in order, with ``more`` of each pair and ``of_names`` of each name used."""
    used = np.zeros(len(names), bool)
    used[a] = used[b] = True
    place = np.cumsum(used) - 1
    codes = place[a] * int(used.sum()) + place[b]
    order = np.argsort(codes, kind="stable")
    return pack(np.diff(names[used], prepend=np.uint64(0)), np.diff(codes[order], prepend=0), *[x[order] for x in more], *[x[used] for x in of_names])


def unpack_pairs(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    gaps, codes, *more = unpack(data)
    names, codes = np.cumsum(gaps, dtype=np.uint64), np.cumsum(codes)
    return names, codes // max(1, len(names)), codes % max(1, len(names)), more


def places(sought: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the sorted ``names`` hold what is sought, and whether they do."""
    at = np.searchsorted(names, sought)
    at[at == len(names)] = 0
    return at, (names[at] == sought) if len(names) else np.zeros(len(sought), bool)


def shard_of(first: np.ndarray, second: np.ndarray, often: np.ndarray, shards: int) -> np.ndarray:
    """Shards by the first words, of those that are frequent by both."""
    h = mix64(first)
    return (np.where(often, mix64(h + second), h) % np.uint64(shards)).astype(np.int64)


def tokens_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all texts' words, the number of the text of each, and the words of each text.

    A text's words stand between a start and an end; a text without words has none of these. A word's number is the first
    ``WORD_BYTES`` bytes of its hash.
    """
    sequences = [(b" start", *w, b" end") if (w := words(t)) else () for t in texts]
    known = Numbering()
    codes = np.fromiter(map(known.__getitem__, chain.from_iterable(sequences)), np.int64)
    raw = np.zeros((len(known), 8), np.uint8)
    raw[:, :WORD_BYTES] = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=WORD_BYTES).digest() for w in known), np.uint8).reshape(-1, WORD_BYTES)
    table = raw.view("<u8").ravel()
    table[table < FIRST_WORD] += np.uint64(FIRST_WORD)
    for special, number in ((b" start", START), (b" end", END)):
        if special in known:
            table[known[special]] = number
    sizes = np.fromiter(map(len, sequences), np.int64)
    return table[codes], np.repeat(np.arange(len(texts), dtype=np.uint32), sizes), np.maximum(sizes - 2, 0)


class Block:
    """Texts of about ``BLOCK`` words: their rows without the text, words, and pairs as places in ``names``."""

    def __init__(self, held: list[tuple]):
        self.rows = pa.Table.from_batches([h[0] for h in held])
        h, of, self.sizes = (np.concatenate([x[i] for x in held]) for i in (1, 2, 3))
        self.names, codes = np.unique(h, return_inverse=True)
        inside = h[:-1] != END
        self.a, self.b, self.of = codes[:-1][inside], codes[1:][inside], of[:-1][inside]
        self.codes = codes


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks of the rows; the last column is the text."""
    held, size, rows = [], 0, 0
    for batch in slices(batches, -1):
        h, of, n = tokens_of(utf8(batch.column(batch.num_columns - 1)))
        held.append((batch.select(list(range(batch.num_columns - 1))), h, of + np.uint32(rows), n))
        size, rows = size + len(h), rows + batch.num_rows
        if size >= BLOCK:
            yield Block(held)
            held, size, rows = [], 0, 0
    if held:
        yield Block(held)


def _row(names: list[str], *values) -> pa.RecordBatch:
    types = {"shard": pa.int32(), "block": pa.int64(), "meta": pa.binary(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([v], types[n]) for n, v in zip(names, values)], names=names)


def _parts(at: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard and the places of its pairs."""
    order = np.argsort(at, kind="stable")
    edges = np.searchsorted(at[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(edges)).tolist():
        yield s, order[edges[s] : edges[s + 1]]


def _chunks(kind: list[np.ndarray], columns: list[str]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(kind[0]), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000].astype(np.int64)) for x in kind], names=columns)


def frequent(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words with a share of at least ``HOT`` of all words, and pairs with as much (two columns); perhaps some
    with half of it. Start and end are among the words.

    What has that share has half of it in so many blocks that those hold at least half of its occurrences.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in blocks(batches):
            least = HOT / 2 * len(x.codes)
            n = np.bincount(x.codes, minlength=len(x.names))
            often = n >= least
            # A pair is no more frequent than its words.
            both = often[x.a] & often[x.b]
            pairs, m = np.unique(x.a[both] * len(x.names) + x.b[both], return_counts=True)
            pairs, m = pairs[m >= least], m[m >= least]
            words_at = np.flatnonzero(often)
            a = np.concatenate([x.names[words_at], x.names[pairs // max(1, len(x.names))], [START]])
            b = np.concatenate([np.full(len(words_at), ALONE), x.names[pairs % max(1, len(x.names))], [START]])
            yield from _chunks([a, b, np.concatenate([n[words_at], m, [len(x.codes)]])], ["a", "b", "n"])

    sums = materialise(texts.select("text").mapInArrow(count, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")))
    whole = (F.col("a") == START) & (F.col("b") == START)
    total = sums.where(whole).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = sums.where(~whole & (F.col("n") >= HOT / 2 * total)).select("a", "b").toPandas()  # at most 4 / HOT rows
    a, b = found["a"].to_numpy(np.uint64), found["b"].to_numpy(np.uint64)
    return np.union1d(a[b == ALONE], np.array([START, END], np.uint64)), np.stack([a[b != ALONE], b[b != ALONE]], 1)


def count_pairs(texts: DataFrame, shards: int, hot: np.ndarray) -> DataFrame:
    """``(shard, payload)``: the distinct pairs of a shard of second words and how often all texts hold them, packed."""
    shared = texts.sparkSession.sparkContext.broadcast(hot)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in blocks(batches):
            codes, n = np.unique(x.a * len(x.names) + x.b, return_counts=True)
            a, b = codes // max(1, len(x.names)), codes % max(1, len(x.names))
            often = places(x.names, shared.value)[1]
            for s, part in _parts(shard_of(x.names[b], x.names[a], often[b], shards), shards):
                yield _row(["shard", "payload"], s, pack_pairs(x.names, a[part], b[part], [n[part].astype(np.uint32)], []))

    def merge(group: pa.Table) -> pa.Table:
        names, a, b, (n,) = joined(group["payload"].to_pylist(), 1)
        codes, of = np.unique(a * len(names) + b, return_inverse=True)
        n = np.bincount(of, weights=n).astype(np.int64)
        return pa.Table.from_batches([_row(["shard", "payload"], group["shard"][0].as_py(), pack_pairs(names, codes // len(names), codes % len(names), [n], []))])

    schema = "shard int, payload binary"
    return texts.select("text").mapInArrow(count, schema).groupBy("shard").applyInArrow(merge, schema)


def joined(payloads: list[bytes], more: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """The pairs of several packs over common names, with the first ``more`` arrays; what belongs to names comes after them,
    the largest of each name."""
    parts = [unpack_pairs(p) for p in payloads]
    names = np.unique(np.concatenate([_EMPTY, *[p[0] for p in parts]]))
    at = [np.searchsorted(names, p[0]) for p in parts]
    none = np.zeros(0, np.int64)
    a, b = (np.concatenate([none, *[w[p[k]] for w, p in zip(at, parts)]]) for k in (1, 2))
    out = [np.concatenate([none, *[p[3][i] for p in parts]]) for i in range(more)]
    for i in range(more, len(parts[0][3]) if parts else more):
        own = np.zeros(len(names), np.int64)
        for w, p in zip(at, parts):
            own[w] = np.maximum(own[w], p[3][i])
        out.append(own)
    return names, a, b, out


def _discounts(n: list[int]) -> list[float]:
    """D1, D2 and D3+ of modified Kneser-Ney from the numbers of grams that occur once to four times."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    return [min(k, max(0.1 * k, k - (k + 1) * y * n[k] / n[k - 1])) if n[k - 1] and n[k] else 0.5 * k for k in (1, 2, 3)]


def _cut(n: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(n, 3)]


class Model:
    """What all tasks know: discounts, the lower order's totals, and the frequent words and pairs."""

    def __init__(self, hot: np.ndarray, hot_pairs: np.ndarray, counts: DataFrame):
        self.hot = hot
        shared = counts.sparkSession.sparkContext.broadcast((hot, hot_pairs))
        found = materialise(counts.mapInArrow(lambda batches: _statistics(batches, *shared.value), "kind long, a long, b long, n1 long, n2 long, n3 long, n4 long, more long"))
        sums = found.groupBy("kind", "a", "b").agg(*[F.sum(c).alias(c) for c in ("n1", "n2", "n3", "n4", "more")]).toPandas()  # a few rows, and at most 8 / HOT
        kind = {k: sums[sums["kind"] == k] for k in range(5)}
        four = lambda rows: [int(rows[c].sum()) for c in ("n1", "n2", "n3", "n4")]
        self.pairs = _discounts(four(kind[0]))
        self.types = np.zeros(len(hot), np.int64)
        self.types[np.searchsorted(hot, kind[2]["a"].to_numpy(np.uint64))] = kind[2]["more"].to_numpy(np.int64)
        own = [int((self.types == k).sum()) for k in (1, 2, 3, 4)]
        self.lower = _discounts([x + y for x, y in zip(four(kind[1]), own)])
        # Words by their numbers of contexts: those of one, of two and of more, whatever these are.
        n1, n2 = kind[1]["n1"].sum() + own[0], kind[1]["n2"].sum() + own[1]
        n = int(kind[1]["more"].sum() + (self.types > 0).sum())
        self.total = float(kind[0]["more"].sum())
        removed = self.lower[0] * n1 + self.lower[1] * n2 + self.lower[2] * (n - n1 - n2)
        self.unknown = (removed / self.total if self.total else 1.0) / (n + 1)
        # Contexts: sums of discounts and of occurrences.
        self.removed, self.seen = np.zeros(len(hot)), np.zeros(len(hot))
        at = np.searchsorted(hot, kind[3]["a"].to_numpy(np.uint64))
        self.removed[at] = sum(d * kind[3][c].to_numpy(float) for d, c in zip(self.pairs, ("n1", "n2", "n3")))
        self.seen[at] = kind[3]["more"].to_numpy(float)
        self.word = self.gain(self.types)
        self.weight = np.where(self.seen > 0, np.log(np.maximum(self.removed, 1e-300) / np.maximum(self.seen, 1)), 0)
        # Frequent pairs, those that the trusted texts don't hold among them, by the places of their words.
        a, b = np.searchsorted(hot, hot_pairs[:, 0]), np.searchsorted(hot, hot_pairs[:, 1])
        codes = a * len(hot) + b
        self.pair_codes = np.sort(codes)
        self.pair_values = np.zeros(len(codes))
        a, b = (np.searchsorted(hot, kind[4][c].to_numpy(np.uint64)) for c in ("a", "b"))
        self.pair_values[np.searchsorted(self.pair_codes, a * len(hot) + b)] = self.value(kind[4]["more"].to_numpy(np.int64), self.removed[a], self.types[b])

    def probability(self, types: np.ndarray) -> np.ndarray:
        return (types - _cut(types, self.lower)) / (self.total or 1.0) + self.unknown

    def gain(self, types: np.ndarray) -> np.ndarray:
        """Log probability of words that stand in so many contexts, relative to an unknown word's."""
        return np.log(self.probability(types) / self.unknown)

    def value(self, n: np.ndarray, removed: np.ndarray, types: np.ndarray) -> np.ndarray:
        """What pairs that occur ``n`` times add to the lower order, given their contexts' sums of discounts."""
        return np.log1p((n - _cut(n, self.pairs)) / (removed * self.probability(types)))


def _types(names: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bincount(b, minlength=len(names))


def _statistics(batches: Iterator[pa.RecordBatch], hot: np.ndarray, hot_pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums over shards of second words. Kinds: 0 all pairs, 1 second words that aren't frequent, 2 those that are, 3 frequent
    contexts, 4 frequent pairs."""
    columns = ["kind", "a", "b", "n1", "n2", "n3", "n4", "more"]
    codes = np.sort(np.searchsorted(hot, hot_pairs[:, 0]) * len(hot) + np.searchsorted(hot, hot_pairs[:, 1]))
    for batch in batches:
        for data in batch.column(batch.schema.get_field_index("payload")).to_pylist():
            names, a, b, (n,) = unpack_pairs(data)
            at, often = places(names, hot)
            types = _types(names, b)
            mine = types[~often]
            ones = lambda x, w=None: [np.bincount(w, weights=x == k, minlength=len(hot)) if w is not None else np.array([(x == k).sum()]) for k in (1, 2, 3, 4)]
            one = np.zeros(1, np.int64)
            yield from _chunks([one, one, one, *ones(n), np.array([len(n)])], columns)
            yield from _chunks([one + 1, one, one, *ones(mine), np.array([(mine > 0).sum()])], columns)
            seconds = np.flatnonzero(often & (types > 0))
            zero = np.zeros(len(seconds))
            yield from _chunks([zero + 2, names[seconds], zero, zero, zero, zero, zero, types[seconds]], columns)
            of_hot = often[a]
            w, m = at[a[of_hot]], n[of_hot]
            n1, n2 = (np.bincount(w, weights=m == k, minlength=len(hot)) for k in (1, 2))
            n3, total = np.bincount(w, weights=m > 2, minlength=len(hot)), np.bincount(w, weights=m, minlength=len(hot))
            here = np.flatnonzero(total)
            zero = np.zeros(len(here))
            yield from _chunks([zero + 3, hot[here], zero, n1[here], n2[here], n3[here], zero, total[here]], columns)
            both = often[a] & often[b]
            a, b, n = a[both], b[both], n[both]
            known = places(at[a] * len(hot) + at[b], codes)[1]
            zero = np.zeros(int(known.sum()))
            yield from _chunks([zero + 4, names[a[known]], names[b[known]], zero, zero, zero, zero, n[known]], columns)


def perplexities(docs: DataFrame, trusted: DataFrame, keep_cols: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """``keep_cols`` and ``perplexity`` (by word) of each ``text`` under a model of all ``trusted`` texts; null for texts
    without words. Texts must be read from a table, so that a task that runs again sees the same rows."""
    sc = in_small_batches(docs).sparkSession.sparkContext
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(SHARDS, math.ceil(size / SHARD_BYTES))
    hot, hot_pairs = frequent(docs)
    counts = materialise(count_pairs(trusted, shards, hot))
    model = Model(hot, hot_pairs, counts)
    shared = sc.broadcast(model)
    of_shard, of_block = ["shard", "block", "meta", "payload"], ["block", "meta", "payload"]

    def by_first_word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs with how often they occur and their words' numbers of contexts; each word alone with that number too."""
        m = shared.value
        for batch in batches:
            for data in batch.column(batch.schema.get_field_index("payload")).to_pylist():
                names, a, b, (n,) = unpack_pairs(data)
                at, often = places(names, m.hot)
                types = _types(names, b)
                types[often] = m.types[at[often]]
                alone = np.flatnonzero((types > 0) & ~often)
                names = np.append(names, np.uint64(ALONE)) if ALONE not in names else names
                order = np.argsort(names)
                place = np.empty(len(names), np.int64)
                place[order] = np.arange(len(names))
                names, types, often = names[order], np.append(types, 0)[order], np.append(often, False)[order]
                a, b, n = place[np.concatenate([a, alone])], place[np.concatenate([b, np.full(len(alone), len(order) - 1)])], np.concatenate([n, np.ones(len(alone), np.int64)])
                for s, part in _parts(shard_of(names[a], names[b], often[a], shards), shards):
                    yield _row(["shard", "payload"], s, pack_pairs(names, a[part], b[part], [n[part]], [types]))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        first = TaskContext.get().partitionId() << 32
        for i, x in enumerate(blocks(batches)):
            at, often = places(x.names, m.hot)
            word, weight = np.where(often, m.word[at], 0), np.where(often, m.weight[at], 0)
            both = often[x.a] & often[x.b]
            where, known = places(at[x.a[both]] * len(m.hot) + at[x.b[both]], m.pair_codes)
            here = np.zeros(len(x.a), bool)
            here[np.flatnonzero(both)[known]] = True
            own = np.bincount(x.of, weights=word[x.b] + weight[x.a], minlength=x.rows.num_rows)
            own += np.bincount(x.of[here], weights=m.pair_values[where[known]], minlength=x.rows.num_rows)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, x.rows.schema) as writer:
                writer.write_table(x.rows)
            yield _row(of_shard, (first + i) % shards, first + i, pickle.dumps((sink.getvalue().to_pybytes(), own, x.sizes)), None)
            a, b, of = x.a[~here], x.b[~here], x.of[~here]
            for s, part in _parts(shard_of(x.names[a], x.names[b], often[a], shards), shards):
                yield _row(of_shard, s, first + i, None, pack_pairs(x.names, a[part], b[part], [of[part]], []))

    def answer(asked: pa.Table, counted: pa.Table) -> pa.Table:
        m = shared.value
        names, a, b, (n, types) = joined(counted["payload"].to_pylist(), 1) if counted.num_rows else (_EMPTY, *[np.zeros(0, np.int64)] * 2, [np.zeros(0, np.int64)] * 2)
        alone = names[b] == ALONE
        at, often = places(names, m.hot)
        # Contexts of this shard, and frequent ones.
        removed = np.bincount(a, weights=np.where(alone, 0, _cut(n, m.pairs)), minlength=len(names))
        seen = np.bincount(a, weights=np.where(alone, 0, n), minlength=len(names))
        removed[often] = m.removed[at[often]]
        # Each occurrence of a word that isn't frequent is the first of one pair: its own probability is added there.
        weight = np.where((seen > 0) & ~often, np.log(np.maximum(removed, 1e-300) / np.maximum(seen, 1)), 0)
        weight[a[alone]] += m.gain(types[a[alone]])
        a, b, n = a[~alone], b[~alone], n[~alone]
        codes = a * len(names) + b
        order = np.argsort(codes)
        codes, value = codes[order], m.value(n, removed[a], types[b])[order]
        out = []
        for block, meta, data in zip(asked["block"].to_pylist(), asked["meta"].to_pylist(), asked["payload"].to_pylist()):
            if meta is None:
                some, p, q, (of,) = unpack_pairs(data)
                where, known = places(some, names)
                there, hit = places(where[p] * len(names) + where[q], codes)
                hit &= known[p] & known[q]
                gain = np.where(hit, value[there] if len(value) else 0, 0) + np.where(known[p], weight[where[p]] if len(weight) else 0, 0)
                sums = np.bincount(of, weights=gain)
                which = np.flatnonzero(sums)
                if not len(which):
                    continue
                data = pack(which.astype(np.uint32), sums[which].astype(np.float32))
            out.append(_row(of_block, block, meta, data))
        return pa.Table.from_batches(out, pa.schema([("block", pa.int64()), ("meta", pa.binary()), ("payload", pa.binary())]))

    def collect(group: pa.Table) -> pa.Table:
        meta = next(m for m in group["meta"].to_pylist() if m is not None)
        raw, total, n = pickle.loads(meta)
        for data in sorted(p for p in group["payload"].to_pylist() if p is not None):
            which, sums = unpack(data)
            total[which] += sums
        bits = -(total / (n + 1) + math.log(shared.value.unknown))
        return pa.ipc.open_stream(raw).read_all().append_column("perplexity", pa.array(np.exp(bits), mask=n == 0))

    asked = docs.select(*keep_cols, "text").mapInArrow(ask, "shard int, block long, meta binary, payload binary")
    counted = counts.mapInArrow(by_first_word, "shard int, payload binary")
    answers = asked.groupBy("shard").cogroup(counted.groupBy("shard")).applyInArrow(answer, "block long, meta binary, payload binary")
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep_cols)
    return answers.groupBy("block").applyInArrow(collect, f"{schema}, perplexity double")


def quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality") -> DataFrame:
    """Perplexity of each whole text under a model of the trusted texts, and whether it is good enough.

    Columns: the id, ``perplexity`` double, ``threshold`` double (the ``quantile`` of the perplexities of trusted texts of
    the language) and ``good`` boolean (perplexity is at most the threshold). Trusted are all texts with label 1. One in
    ``CALIBRATE`` of them, by the text's hash, isn't counted; thresholds come from those, so that they hold for texts that
    the model hasn't seen. A language without such texts takes the threshold of its counted ones.

    Null, empty and wordless texts have no perplexity and aren't good. A language without trusted texts takes the threshold
    of all trusted texts; a null language is one of its own; without trusted texts every other text is good. Repeated rows
    give repeated results; texts with contrary labels are trusted; other columns are not read; an empty table gives no rows.

    Trusted ids under a checked bound are broadcast; beyond it the trusted texts, and later every document's perplexity, are
    shuffled by the id to meet them.
    """
    good = materialise(labels.where((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__of")).distinct())
    few = good.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    good = F.broadcast(good) if few else good
    held = F.coalesce(F.crc32("text") % CALIBRATE == 0, F.lit(False))
    plain = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).withColumn("held", held)
    trusted = plain.where("not held").select("id", "text").join(good, F.col("id") == F.col("__of"), "left_semi")
    marks = good.withColumn("trusted", F.lit(True))
    scored = perplexities(plain, trusted, ("id", "lang", "held")).join(F.broadcast(marks) if few else marks, F.col("id") == F.col("__of"), "left").drop("__of")
    scored = materialise(scored)
    known = scored.where("trusted and perplexity is not null")
    of = lambda rows: F.percentile_approx(rows, quantile, ACCURACY)
    cut = F.coalesce(of(F.when(F.col("held"), F.col("perplexity"))), of(F.col("perplexity")))
    own = known.groupBy(F.col("lang").alias("__lang")).agg(cut.alias("__own"))
    every = known.agg(cut.alias("__all"))
    out = scored.join(own, F.col("lang").eqNullSafe(F.col("__lang")), "left").crossJoin(F.broadcast(every))  # `every` is one row
    threshold = F.coalesce("__own", "__all")
    return out.select(F.col("id").alias(id_col), "perplexity", threshold.alias("threshold"), (F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= threshold, F.lit(True))).alias("good"))
