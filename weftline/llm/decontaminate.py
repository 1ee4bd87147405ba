"""Benchmark decontamination by normalised word windows (operator 1)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, keep_where, slices, utf8, with_ids, words

#: Window sets of up to so many bytes are broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 64_000_000

_WORD_BYTES = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def windows(benchmark: DataFrame, size: int, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct ``(size, gram, item)``: each run of ``size`` words of an item, or all its words if there are fewer."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 200_000):
            row, sizes, grams = [], [], []
            for i, text in enumerate(utf8(batch.column(1))):
                w = words(text)
                n = min(size, len(w))
                for p in range(len(w) - n + 1 if n else 0):
                    row.append(i)
                    sizes.append(n)
                    grams.append(b" ".join(w[p : p + n]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(sizes, pa.int32()), pa.array(grams, pa.binary()), batch.column(0).take(pa.array(row, pa.int64()))], names=["size", "gram", "item"]
            )

    kind = benchmark.schema[item_col].dataType.simpleString()
    return benchmark.select(item_col, text_col).mapInArrow(cut, f"size int, gram binary, item {kind}").distinct()


class Matcher:
    """Finds the windows in a text. Words become ids of the windows' own vocabulary, so equal ids are equal words."""

    def __init__(self, rows: list[tuple[int, bytes, str | None]]):
        self.vocab: dict[bytes, int] = {}
        self.tables: dict[int, dict[bytes, list[str]]] = {}
        for size, gram, item in rows:
            ids = np.array([self.vocab.setdefault(w, len(self.vocab)) for w in gram.split(b" ")], np.int32)
            items = self.tables.setdefault(size, {}).setdefault(ids.tobytes(), [])
            if item is not None:
                items.append(item)

    def hits(self, w: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words lie in an occurrence of a window, and the items with occurring windows."""
        hit, items = np.zeros(len(w) + 1, np.int32), set()
        get = self.vocab.get
        ids = np.fromiter((get(x, -1) for x in w), np.int32, len(w))
        unknown = np.concatenate([[0], np.cumsum(ids < 0)])
        for size, table in self.tables.items():
            for p in np.flatnonzero(unknown[size:] == unknown[: len(w) + 1 - size]) if len(w) >= size else ():
                found = table.get(ids[p : p + size].tobytes())
                if found is not None:
                    hit[p] += 1
                    hit[p + size] -= 1
                    items.update(found)
        return np.cumsum(hit[:-1]) > 0, items


def _digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Overlap of each document with the benchmark.

    Columns: the id, ``n_words``, ``n_hit`` (words inside any occurrence of a window), ``n_items`` long, ``items_sha256``
    (hex digest of the sorted, comma-joined item ids) and ``contaminated`` (``n_hit > 0``).

    A null text has no words, so no hits; neither has an empty benchmark. An item with a null id marks words but is not
    counted; items with equal ids count once. Repeated rows give repeated results and null ids stay; other columns are not
    read. The window set is broadcast only if its measured size is at most ``broadcast_bytes``; beyond that, windows of
    the texts are joined with it by shuffle, where adaptive execution splits hot windows.
    """
    gram = windows(benchmark, size)
    bytes_all = gram.agg(F.sum(F.length("gram") + 64)).first()[0] or 0
    if bytes_all > broadcast_bytes:
        return _by_join(docs, gram, id_col, text_col)
    rows = [(r[0], bytes(r[1]), r[2]) for r in gram.select("size", "gram", F.col("item").cast("string")).collect()]
    shared = docs.sparkSession.sparkContext.broadcast(rows)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        for batch in slices(batches, 1):
            n, hit, found = [], [], []
            for text in utf8(batch.column(1)):
                w = words(text)
                mask, items = matcher.hits(w)
                n.append(len(w))
                hit.append(int(mask.sum()))
                found.append(items)
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in found], pa.int64())]
            arrays += [pa.array([_digest(x) for x in found], pa.string()), pa.array([x > 0 for x in hit], pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    names = [id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    return in_small_batches(docs).select(id_col, text_col).mapInArrow(scan, schema)


def _hits(keyed: DataFrame, gram: DataFrame) -> DataFrame:
    """``key``, ``pos``, ``n`` and ``item`` of the windows in texts, given as key and text: an equi-join on the windows."""
    sizes = sorted(r[0] for r in gram.select("size").distinct().collect())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 200_000):
            row, pos, grams, n = [], [], [], []
            for i, text in enumerate(utf8(batch.column(1))):
                w = words(text)
                for size in sizes:
                    for p in range(len(w) - size + 1):
                        row.append(i)
                        pos.append(p)
                        grams.append(b" ".join(w[p : p + size]))
                        n.append(size)
            keys = batch.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(pos, pa.int32()), pa.array(n, pa.int32()), pa.array(grams, pa.binary())], names=["key", "pos", "n", "g"])

    grams = keyed.mapInArrow(cut, "key string, pos int, n int, g binary")
    return grams.join(gram, (F.col("g") == F.col("gram")) & (F.col("n") == F.col("size"))).select("key", "pos", "n", F.col("item").cast("string").alias("item")).distinct()


def _by_join(docs: DataFrame, gram: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``contamination`` for a window set of any size: an equi-join on the windows, each distinct text's once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            n = pa.array([len(words(t)) for t in utf8(batch.column(2))], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], names=[id_col, "__key", "n_words"])

    kind = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(F.col(id_col), F.sha2(text_col, 256).alias("__key"), F.col(text_col))
    hits = _hits(keyed.select("__key", text_col).dropDuplicates(["__key"]), gram)
    spans = hits.select("key", F.explode(F.expr("sequence(pos, pos + n - 1)")).alias("at")).distinct().groupBy("key").agg(F.count("*").alias("n_hit"))
    items = hits.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = spans.join(items, "key").select(F.col("key").alias("__of"), "n_hit", "items")
    counted = keyed.mapInArrow(count, f"`{id_col}` {kind}, __key string, n_words long")
    none = F.array().cast("array<string>")
    return counted.join(found, F.col("__key") == F.col("__of"), "left").select(
        id_col, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10, text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents that hold no window of the benchmark, with their columns as they were.

    Each row is judged by its own text, so null and repeated ids take no other rows with them; null texts stay. Window
    sets up to ``broadcast_bytes`` are broadcast and the rows filtered in one pass; beyond that, the digests of the texts
    that hold windows are found by join.
    """
    gram = windows(benchmark, size)
    if (gram.agg(F.sum(F.length("gram") + 64)).first()[0] or 0) > broadcast_bytes:
        own = next(name for k in range(len(docs.columns) + 1) if (name := f"__digest{k}") not in docs.columns)
        keyed = docs.withColumn(own, F.sha2(F.col(text_col), 256))
        hit = _by_join(keyed, gram, own, text_col).where("contaminated").select(own)
        return with_ids(keyed, hit, False, own).drop(own)
    rows = [(r[0], bytes(r[1]), "") for r in gram.select("size", "gram").distinct().collect()]
    shared = docs.sparkSession.sparkContext.broadcast(rows)

    def accepts() -> Callable[[bytes | None], bool]:
        matcher = Matcher(shared.value)
        return lambda text: not matcher.hits(words(text))[1]

    return keep_where(docs, text_col, accepts)


def cut_spans(text: bytes, hit: np.ndarray) -> bytes:
    """The text without its runs of hit words, from the first byte of a run to the last."""
    spans = [m.span() for m in _WORD_BYTES.finditer(text)]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    out, at = [], 0
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        out.append(text[at : spans[a][0]])
        at = spans[b - 1][1]
    return b"".join([*out, text[at:]])


def remove_spans(docs: DataFrame, benchmark: DataFrame, size: int = 10, text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """All documents, without the words that ``contamination`` counts as hit and what stands between them; other columns as
    they were.

    Null texts stay null, and an empty benchmark or table changes nothing. Each row is cut by its own text, so repeated rows
    give repeated results. Window sets up to ``broadcast_bytes`` are broadcast; beyond that, texts meet their hits by join.
    """
    gram = windows(benchmark, size)
    names = docs.columns
    at = names.index(text_col)
    if (gram.agg(F.sum(F.length("gram") + 64)).first()[0] or 0) > broadcast_bytes:
        keyed = docs.select(F.sha2(text_col, 256).alias("__key"), text_col).distinct()
        hits = _hits(keyed, gram).groupBy(F.col("key").alias("__key")).agg(F.collect_set(F.struct("pos", "n")).alias("__hits"))
        met = docs.join(hits, F.sha2(docs[text_col], 256) == hits["__key"], "left").select(*[docs[c] for c in docs.columns], "__hits")

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, at):
                lists = batch.column(batch.num_columns - 1).to_pylist()
                out = utf8(batch.column(at))
                for i, found in enumerate(lists):
                    if found:
                        edges = np.zeros(len(words(out[i])) + 1, np.int32)
                        for x in found:
                            edges[x["pos"]] += 1
                            edges[x["pos"] + x["n"]] -= 1
                        out[i] = cut_spans(out[i], np.cumsum(edges[:-1]) > 0)
                yield batch.select(names).set_column(at, text_col, _texts(out, batch.column(at)))

        return met.mapInArrow(cut, docs.schema)
    shared = docs.sparkSession.sparkContext.broadcast([(r[0], bytes(r[1]), None) for r in gram.select("size", "gram").distinct().collect()])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        for batch in slices(batches, at):
            out = utf8(batch.column(at))
            for i, text in enumerate(out):
                mask, _ = matcher.hits(words(text))
                if mask.any():
                    out[i] = cut_spans(text, mask)
            yield batch.set_column(at, text_col, _texts(out, batch.column(at)))

    return docs.mapInArrow(clean, docs.schema)


def _texts(raw: list[bytes | None], like: pa.Array) -> pa.Array:
    return pa.array(raw, pa.binary() if pa.types.is_string(like.type) else pa.large_binary()).cast(like.type)
