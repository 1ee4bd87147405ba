"""Best-fit packing by minimum bin slack (operator 2)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import in_small_batches, materialise, slices, utf8
from .tokens import ByteBpe, load_vocabulary

#: Rows that one window partition ranks, about: lengths are split into so many parts that this holds for the mean.
RANK_ROWS = 50_000


def fullest(counts: dict[int, int], size: int) -> dict[int, int]:
    """Lengths and how often each is taken, so that their sum is the largest possible up to ``size``.

    Bit s of a row of the table tells if the sum s can be reached. The longest length there is always takes part, and of
    equally full choices the one with the longest lengths is taken: short ones fill later gaps.
    """
    seed = max(counts)
    room = size - seed
    fits = sorted(x for x in counts if x <= room)
    mask, reach, rows = (1 << (room + 1)) - 1, 1, []
    for x in fits:
        rows.append(reach)
        left = min(counts[x] - (x == seed), room // x)
        step = 1
        while left > 0:  # binary splitting: 1, 2, 4, ... copies
            take = min(step, left)
            reach |= (reach << (x * take)) & mask
            left -= take
            step *= 2
    at = reach.bit_length() - 1
    taken = {seed: 1}
    for x, before in zip(reversed(fits), reversed(rows)):
        left = min(counts[x] - (x == seed), room // x)
        # The most copies of x after which the rest can still be reached without x.
        k = next(k for k in range(min(left, at // x), -1, -1) if before >> (at - k * x) & 1)
        if k:
            taken[x] = taken.get(x, 0) + k
            at -= k * x
    return taken


def plan(counts: dict[int, int], size: int) -> list[tuple[dict[int, int], int]]:
    """Bin contents with the number of bins of each: the fullest combination is taken out as often as the counts allow."""
    left = {x: n for x, n in counts.items() if n > 0}
    out = []
    while left:
        taken = fullest(left, size)
        times = min(left[x] // k for x, k in taken.items())
        out.append((taken, times))
        for x, k in taken.items():
            left[x] -= k * times
            if not left[x]:
                del left[x]
    return out


def place(steps: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: where ranks begin a new step, and that step's first bin, pieces of this length a bin, and offset."""
    out: dict[int, list[list[int]]] = {}
    seen: dict[int, int] = {}
    bins = 0
    for taken, times in steps:
        offset = 0
        for x in sorted(taken, reverse=True):
            rank = seen.get(x, 0)
            out.setdefault(x, []).append([rank, bins, taken[x], offset])
            seen[x] = rank + taken[x] * times
            offset += x * taken[x]
        bins += times
    return {x: tuple(np.array(rows, np.int64).T) for x, rows in out.items()}


def pieces(docs: DataFrame, size: int, vocabulary: str | None, end_id: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """Token ids of each whole text and ``end_id``, cut into pieces of at most ``size``; what is left over comes first."""
    spec = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))
    names = [id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.of(spec.value)
        for batch in slices(batches, 1):
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            for i, text in enumerate(utf8(batch.column(1))):
                ids = bpe.ids(text.decode() if text else "")
                ids.append(end_id)
                raw, n = ids.tobytes(), len(ids)
                at, k = 0, 0
                while at < n:
                    to = at + (n % size or size) if k == 0 else at + size
                    part = raw[4 * at : 4 * to]
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(to - at)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        kept.append(np.frombuffer(part, np.int32))
                    at, k = to, k + 1
            arrays = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                arrays.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return in_small_batches(docs).select(id_col, text_col).mapInArrow(encode, schema)


def pack(docs: DataFrame, size: int = 1024, vocabulary: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Packs all documents into few sequences of at most ``size`` tokens.

    Columns: the id, ``piece`` int, ``start``, ``length``, ``ids_crc32`` long (little-endian unsigned 32-bit ids),
    ``sequence_id``, ``offset`` long, and ``ids`` with ``with_ids``. Documents longer than ``size`` are cut, the first
    piece being the remainder; other pieces are whole documents.

    Method: texts are encoded once and the pieces written out. The number of pieces of each length (at most ``size``
    numbers, whatever the input) is all that reaches the driver, where minimum bin slack decides bin contents for whole
    runs of equal bins. Pieces then look up their bin by length and rank among their length; ranks come from windows over
    (length, part), with the parts' sizes added up, so that a length that a third of all pieces share is many tasks' work.

    A null text counts as empty: its one token is ``end_id``. Rows with equal or null ids are packed each for itself;
    other columns are not read; an empty table gives no rows.
    """
    cut = materialise(pieces(docs, size, vocabulary, end_id, id_col, text_col, with_ids))
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}
    total = sum(counts.values())
    bins = docs.sparkSession.sparkContext.broadcast(place(plan(counts, size)))
    parts = max(16, -(-total // RANK_ROWS))

    keyed = cut.withColumn("__part", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    sizes = keyed.groupBy("length", "__part").agg(F.count("*").alias("__n"))
    before = sizes.select(
        F.col("length").alias("__length"), F.col("__part").alias("__of"),
        (F.sum("__n").over(W.partitionBy("length").orderBy("__part")) - F.col("__n")).alias("__before"),
    )
    rank = F.row_number().over(W.partitionBy("length", "__part").orderBy(F.col(id_col), "piece", "ids_crc32")) - 1
    ranked = (
        keyed.withColumn("__rank", rank)
        .join(before, (F.col("length") == F.col("__length")) & (F.col("__part") == F.col("__of")))
        .withColumn("__rank", F.col("__rank") + F.col("__before"))
        .drop("__part", "__length", "__of", "__before")
    )

    @F.pandas_udf("sequence_id long, offset long")
    def where(length, rank):  # the plan's rows are at most a few for each length
        import pandas as pd

        x, r = length.to_numpy(), rank.to_numpy()
        seq, off = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for n in np.unique(x):
            begins, first, each, base = bins.value[int(n)]
            of = np.flatnonzero(x == n)
            step = np.searchsorted(begins, r[of], side="right") - 1
            k = r[of] - begins[step]
            seq[of] = first[step] + k // each[step]
            off[of] = base[step] + k % each[step] * n
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    out = [id_col, "piece", "start", "length", "ids_crc32", F.col("__at.sequence_id").alias("sequence_id"), F.col("__at.offset").alias("offset")]
    return ranked.withColumn("__at", where("length", "__rank")).select(*out, *(["ids"] * with_ids))
