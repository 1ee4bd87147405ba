"""Text rules, scratch tables and small helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Id sets up to this many rows (about 16 MB) are broadcast; larger ones are joined by shuffle.
BROADCAST_IDS = 1_000_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORD = bytes(c if (c := _LOWER[b]) >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for b in range(256))
_SPACED = bytes(32 if b == 32 or 9 <= b <= 13 else _LOWER[b] for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text after A-Z are lower-cased; none for null."""
    return text.translate(_WORD).split() if text else []


def spaced_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text after A-Z are lower-cased; none for null."""
    # bytes.split() also splits on nothing else: its white space is exactly 0x20 and 0x09-0x0D.
    return text.translate(_SPACED).split() if text else []


def utf8(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], text_at: int, size: int = 1_500_000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about ``size`` bytes of text, so that lists of words of a whole part fit a small worker."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(at, to - at)
            at = to


#: Rows of a batch that Spark sends to a Python worker: texts of 3 KB make 3 MB, not the 30 MB of Spark's default.
BATCH_ROWS = 1_000


def in_small_batches(df: DataFrame) -> DataFrame:
    """The same table; its session sends rows to Python ``BATCH_ROWS`` at a time, unless another number than Spark's default is set."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":
        conf.set(name, str(BATCH_ROWS))
    return df


def free(name: str, columns: list[str]) -> str:
    """``name``, with as many lines under it as it takes to differ from all of ``columns`` in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_scratch: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; where that is unset on one machine, as in tests, one of our
    own. A cluster must name it: other machines don't see a folder of the driver's."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    sc = spark.sparkContext
    if not sc.getCheckpointDir() and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="weftline-"))
    return sc.getCheckpointDir()


def materialise(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftline-{uuid.uuid4().hex}"
    writer = df.write.mode("error")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    _scratch[path] = spark
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _sweep() -> None:
    for path, spark in _scratch.items():
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended before us: the files stay for the cluster's own cleaning
            return


def with_ids(docs: DataFrame, ids: DataFrame, keep: bool, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id is (``keep``) or isn't in ``ids``; columns as before. Null ids compare equal.

    ``ids`` (one column, any name) is written out once and counted: up to ``BROADCAST_IDS`` rows it is broadcast, so
    texts stay where they are; beyond that both sides are shuffled by the id.
    """
    ids = materialise(ids.toDF("__id").distinct())
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    on = docs[id_col].eqNullSafe(ids["__id"])
    return docs.join(F.broadcast(ids) if small else ids, on, "left_semi" if keep else "left_anti")


#: Keys with this share of all rows (at most ``1 / HOT_SHARE`` keys) are dealt to ``SALTS`` tasks by ``join_spread``.
HOT_SHARE, SALTS = 1e-3, 64


def join_spread(rows: DataFrame, key: str, table: DataFrame, table_key: str, count: str, total: int, by: list[str]) -> DataFrame:
    """``rows`` joined with ``table`` (one row a key) where the keys are equal; ``count`` says how many rows have a key.

    The few keys with a large share of the ``total`` are known to all tasks, so that their rows can be dealt by ``by``.
    """
    often = F.col(count) >= max(2, HOT_SHARE * total)
    hot = table.where(often).select(F.col(table_key).alias("__hot"))
    salt = F.when(F.col("__hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(*by), F.lit(SALTS))).cast("int")
    dealt = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left").withColumn("__salt", salt).drop("__hot")
    target = table.withColumn("__to", F.explode(F.sequence(F.lit(0), F.when(often, SALTS - 1).otherwise(0))))
    return dealt.join(target, (F.col(key) == F.col(table_key)) & (F.col("__salt") == F.col("__to"))).drop("__salt", "__to")


def keep_where(docs: DataFrame, text_col: str, accepts: Callable[[], Callable[[bytes | None], bool]]) -> DataFrame:
    """Rows whose text is accepted, in one pass without a join, so that null and repeated ids are each judged for themselves.

    ``accepts`` is called once in each task and gives the test, which takes the text as UTF-8 or null.
    """
    at = in_small_batches(docs).columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accepted = accepts()
        for batch in slices(batches, at):
            yield batch.filter(pa.array([accepted(t) for t in utf8(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


class Numbering(dict):
    """Numbers keys from 0 in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser, element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x
