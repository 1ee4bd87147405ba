"""Append-only logs: ratings of judges, key-value lines, caches of encoded texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import core

#: What a judge may say of a recommendation.
JUDGMENTS = (2, 1, 0, -1)


def append_judgments(rows: DataFrame, path: str) -> None:
    """Appends ``rater, query, item, rating, rated_at``; nothing is written if a rating isn't one of ``JUDGMENTS``."""
    if not rows.where(~F.coalesce(F.col("rating").isin(*JUDGMENTS), F.lit(False))).isEmpty():
        raise ValueError(f"ratings are {JUDGMENTS}")
    rows.select("rater", "query", "item", "rating", "rated_at").write.mode("append").parquet(path)


def judgments(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """The latest rating of each rater, query and item; of raters in ``known`` (one column) if it is given."""
    rows = spark.read.parquet(path)
    if known is not None:
        rows = rows.join(known.toDF("rater").distinct(), "rater", "left_semi")
    return core.latest(rows, ["rater", "query", "item"], F.desc("rated_at"), "rating").select("rater", "query", "item", "rating")


def compact_lines(spark: SparkSession, path: str, key_type: str = "string") -> DataFrame:
    """``k, v`` of a log of JSON lines ``{k, v, ts}``: the last value of each key. Lines that were cut off are left out."""
    rows = spark.read.schema(f"k {key_type}, v string, ts long").option("mode", "DROPMALFORMED").json(path).where("k is not null")
    return rows.groupBy("k").agg(F.max_by("v", "ts").alias("v"))


def update_cache(texts: DataFrame, cache: DataFrame, encode: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``text_key, vector, fresh``: the cache with what ``encode`` makes of the texts whose key (SHA-1) it doesn't hold.

    ``encode`` takes ``text_key, text`` and returns ``text_key, vector``. Null texts have no key.
    """
    keyed = texts.select(F.sha1(F.col("text").cast("binary")).alias("text_key"), "text").where("text is not null").dropDuplicates(["text_key"])
    new = encode(keyed.join(cache.select("text_key"), "text_key", "left_anti"))
    return cache.select("text_key", "vector", F.lit(False).alias("fresh")).unionByName(new.select("text_key", "vector", F.lit(True).alias("fresh")))
