"""Splits, evaluation cases, ranking metrics, bootstrap and gates."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import materialise
from . import core


def holdout_groups(inter: DataFrame, groups: int = 4, share: float = 0.06, least: int = 2) -> DataFrame:
    """``(user_id, grp)``: disjoint groups of bridge users, by where md5 puts the user on a line from 0 to 1."""
    users = core.bridge_users(inter, least)
    at = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("group"), F.col("user_id").cast("string")).cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)
    return users.withColumn("grp", F.floor(at / share).cast("int")).where(F.col("grp") < groups)


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """Recall, hit, NDCG and MAP at ``k`` of each user with relevant items; ``ranked`` has user_id, item_id, rank from 1."""
    n = relevant.groupBy("user_id").agg(F.least(F.count("*"), F.lit(k)).alias("best"))
    hits = ranked.where(F.col("rank") <= k).join(relevant.select("user_id", "item_id"), ["user_id", "item_id"])
    hits = hits.withColumn("nth", F.row_number().over(W.partitionBy("user_id").orderBy("rank")))
    per = hits.groupBy("user_id").agg(F.count("*").alias("hits"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"), F.sum(F.col("nth") / F.col("rank")).alias("ap"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("best").cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0))
    return n.join(per, "user_id", "left").na.fill(0, ["hits", "dcg", "ap"]).select(
        "user_id", (F.col("hits") / F.col("best")).alias("recall"), (F.col("hits") > 0).cast("int").alias("hit"),
        (F.col("dcg") / ideal).alias("ndcg"), (F.col("ap") / F.col("best")).alias("map"),
    )


def diversity(ranked: DataFrame, vectors: DataFrame, k: int = 10) -> DataFrame:
    """1 minus the mean cosine of all pairs of a list (at most k(k-1)/2 of them), 0 for lists under two."""
    rows = ranked.where(F.col("rank") <= k).join(vectors, "item_id").select("user_id", "item_id", "v")
    a, b = rows.select("user_id", F.col("item_id").alias("i"), F.col("v").alias("a")), rows.select("user_id", F.col("item_id").alias("j"), F.col("v").alias("b"))
    cos = core.dot(F.col("a"), F.col("b")) / (core.norm(F.col("a")) * core.norm(F.col("b")))
    pairs = a.join(b, "user_id").where("i < j").groupBy("user_id").agg((1 - F.avg(cos)).alias("diversity"))
    return rows.select("user_id").distinct().join(pairs, "user_id", "left").na.fill(0, ["diversity"])


def novelty(ranked: DataFrame, pop: DataFrame, n_users: int) -> DataFrame:
    rows = ranked.join(pop, "item_id", "left").na.fill(0, ["popularity"])
    return rows.groupBy("user_id").agg(F.avg(-F.log2((F.col("popularity") + 1) / (n_users + 1))).alias("novelty"))


def _lifts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("task").agg(F.count("*").alias("n"), F.avg("diff").alias("lift"), (F.avg("diff") / F.nullif(F.avg("base"), F.lit(0.0))).alias("relative_lift"))


def _intervals(n: DataFrame, means: DataFrame) -> DataFrame:
    ci = means.groupBy("task").agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    return n.join(ci, "task").select("task", "n", "lift", "relative_lift", "low", "high", ((F.col("low") > 0) | (F.col("high") < 0)).alias("significant"))


#: Rows of a task that its draws are looked up in at once; draws that a call makes, about, and resamples at most.
BLOCK_ROWS, CALL_DRAWS, CALL_RESAMPLES, TEXTS = 4_000_000, 1_000_000, 250, 65_536


def paired_bootstrap(pairs: DataFrame, draws: int = 2000) -> DataFrame:
    """Mean lift of each task, its 95 % interval over resamples of the users, and whether that excludes 0.

    ``pairs`` has task, user_id, diff and base, what diff is against. A resample has as many draws as the task has rows; draw i of
    resample b takes row md5(task|b|i) mod n, in the order of the users. Draws are made where some of the resamples meet a block of
    the rows, and only sums are shuffled. A task of more than ``BLOCK_ROWS`` rows makes its draws once for each block.
    """
    n = materialise(_lifts(pairs))
    rows = pairs.select(F.struct("task", F.col("user_id").isNull().alias("none"), "user_id", "diff").alias("key"))
    rows = core.numbered(rows, "key").select("key.task", "key.diff", "at")
    first = rows.groupBy("task").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    placed = rows.join(first, "task").withColumn("at", F.col("at") - F.col("first")).withColumn("start", F.col("at") - F.col("at") % BLOCK_ROWS)
    own = placed.groupBy("task", "n", "start").agg(F.array_sort(F.collect_list(F.struct("at", "diff"))).alias("x"))
    blocks = materialise(own.select("task", "n", "start", F.transform("x", lambda x: x["diff"]).alias("diffs")))
    spark = pairs.sparkSession
    most, total, some = blocks.agg(F.max("n"), F.sum(F.size("diffs")), F.count("*")).first()
    calls = max(1, min(CALL_RESAMPLES, CALL_DRAWS // (most or 1), draws))
    width, size, kind = max(1, min(some, -(-(total or 0) // CALL_DRAWS) + spark.sparkContext.defaultParallelism)), TEXTS, pairs.schema["task"].dataType.simpleString()

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = 256 ** np.arange(5, -1, -1)
        for batch in batches:
            for row in range(batch.num_rows):
                task, of, start, begin = (batch.column(c)[row].as_py() for c in ("task", "n", "start", "b"))
                diffs = batch.column("diffs").slice(row, 1).flatten()
                known, values = diffs.is_valid().to_numpy(zero_copy_only=False), diffs.fill_null(0.0).to_numpy(zero_copy_only=False)
                asked = range(begin, min(begin + calls, draws))
                opening = [hashlib.md5(f"{task}|{b}|".encode()) for b in asked]
                sums, counts = np.zeros(len(asked)), np.zeros(len(asked), np.int64)
                for i in range(0, of, size):
                    texts = [b"%d" % x for x in range(i, min(i + size, of))]
                    for k, head in enumerate(opening):
                        digests = []
                        for text in texts:
                            one = head.copy()
                            one.update(text)
                            digests.append(one.digest())
                        at = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 16)[:, :6].astype(np.int64) @ places % of - start
                        at = at[(at >= 0) & (at < len(values))]
                        sums[k] += values[at].sum()
                        counts[k] += known[at].sum()
                yield pa.RecordBatch.from_arrays([pa.array([task] * len(asked)), pa.array(asked, pa.int64()), pa.array(sums), pa.array(counts)], ["task", "b", "s", "k"])

    resamples = spark.range(0, draws, calls, 1).select(F.col("id").alias("b")).repartition(-(-draws // calls), "b")
    met = blocks.repartition(width).hint("shuffle_replicate_nl").crossJoin(resamples)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "1")  # a row holds a block
    try:
        sums = materialise(met.mapInArrow(draw, f"task {kind}, b long, s double, k long"))
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return _intervals(n, sums.groupBy("task", "b").agg((F.sum("s") / F.nullif(F.sum("k"), F.lit(0))).alias("m")))


#: Draws that one md5 gives: eight times 16 bits. ``LAW``: from which of the 65,536 values a row is drawn once, twice, ...: Poisson(1).
DRAWS_A_HASH = 8
LAW = [int(65_536 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(8)]


def poisson_bootstrap(pairs: DataFrame, draws: int = 2000) -> DataFrame:
    """Another form of ``paired_bootstrap``: in a resample every row counts as often as a hash of task, user and resample says, by a
    Poisson law of mean 1. So rows stay where they lie, and ``draws`` sums are shuffled, whatever the number of rows."""
    n = _lifts(pairs)
    each = pairs.select("task", "user_id", "diff", F.explode(F.sequence(F.lit(0), F.lit(-(-draws // DRAWS_A_HASH) - 1))).alias("part"))
    digest = F.md5(F.concat_ws("|", "task", F.col("user_id").cast("string"), F.col("part").cast("string")).cast("binary"))
    drawn = lambda u: sum(((u >= t).cast("int") for t in LAW[1:]), (u >= LAW[0]).cast("int"))
    rows = each.withColumn("h", digest).select("task", "part", "diff", *[F.conv(F.substring("h", 4 * k + 1, 4), 16, 10).cast("int").alias(f"u{k}") for k in range(DRAWS_A_HASH)])
    rows = rows.select("task", "part", "diff", *[drawn(F.col(f"u{k}")).alias(f"w{k}") for k in range(DRAWS_A_HASH)])
    sums = rows.groupBy("task", "part").agg(*[F.sum(F.col(f"w{k}") * F.col("diff")).alias(f"s{k}") for k in range(DRAWS_A_HASH)], *[F.sum(f"w{k}").alias(f"w{k}") for k in range(DRAWS_A_HASH)])
    one = F.explode(F.array(*[F.struct((F.col("part") * DRAWS_A_HASH + k).alias("b"), (F.col(f"s{k}") / F.nullif(F.col(f"w{k}"), F.lit(0))).alias("m")) for k in range(DRAWS_A_HASH)]))
    means = sums.select("task", one.alias("x")).where(F.col("x.b") < draws).select("task", "x.m")
    return _intervals(n, means)


def promotion_gate(old: DataFrame, new: DataFrame, primary: str, primary_drop: float = 0.02, other_drop: float = 0.10) -> DataFrame:
    """``(metric, ok, reason)`` for tables ``(metric, value, dataset)``, and a last row ``verdict``: every metric holds, on the
    same data. Metrics that one side lacks, and values of different data, are reasons against."""
    allowed = F.when(F.col("metric") == primary, 1 - primary_drop).otherwise(1 - other_drop)
    was, now = (x.select("metric", F.col("value").alias(v), F.col("dataset").alias(d)) for x, v, d in ((old, "was", "d0"), (new, "now", "d1")))
    rows = was.join(now, "metric", "full")
    lost, moved = F.col("was").isNull() | F.col("now").isNull(), ~F.col("d0").eqNullSafe(F.col("d1"))
    reason = F.when(lost, "missing").when(moved, "other data").when(F.col("now") < F.col("was") * allowed, "dropped").otherwise("")
    rows = rows.select("metric", (reason == "").alias("ok"), reason.alias("reason"))
    against = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.concat_ws(" ", "metric", "reason")))), ", ")
    return rows.unionByName(rows.agg(F.bool_and("ok").alias("ok"), against.alias("reason")).select(F.lit("verdict").alias("metric"), "ok", "reason"))


def graded_ndcg(lists: DataFrame, ratings: DataFrame, k: int) -> DataFrame:
    """``lists`` query, item, rank; ``ratings`` query, item, rating: gains 2^r - 1 against the ideal over all judged items."""
    gain = F.pow(F.lit(2.0), F.greatest(F.col("rating"), F.lit(0))) - 1
    dcg = lists.where(F.col("rank") <= k).join(ratings, ["query", "item"]).groupBy("query").agg(F.sum(gain / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = core.top(ratings, ["query"], k, F.desc("rating"), "item", name="r").groupBy("query").agg(F.sum(gain / F.log2(F.col("r") + 1)).alias("ideal"))
    return ideal.join(dcg, "query", "left").select("query", F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0).alias("ndcg"))


def ring_quality(served: DataFrame, popularity: DataFrame, n_items: int, size: int = 20_000) -> DataFrame:
    """``source, event_id, coverage, popularity`` after each served item, over the source's last ``size`` of them.

    Distinct items come from where each item is next served: it counts in all rings from its place to the one before that, or
    until it falls out. So the number is a running sum of +1 and -1, and no ring is ever gathered. A source's items are one
    window partition. ``streaming.jobs.ring_quality`` is the same over a stream.
    """
    order = W.partitionBy("source").orderBy("ts", "event_id")
    rows = served.where("item is not null").join(popularity, "item", "left").withColumn("at", F.row_number().over(order)).withColumn("n", F.count("*").over(W.partitionBy("source")))
    # Exact running sums: a frame that moves would be added up anew at each row.
    rows = rows.withColumn("total", F.sum(F.coalesce("pct", F.lit(0.0)).cast("decimal(20,18)")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("before", F.coalesce(F.lag("total", size).over(order), F.lit(0)))
    rows = rows.withColumn("until", F.least(F.lead("at").over(W.partitionBy("source", "item").orderBy("at")), F.col("at") + size))
    mean = (F.col("total") - F.col("before")).cast("double") / F.least(F.col("at"), F.lit(size))
    rows = rows.select("source", "event_id", "at", F.coalesce("until", F.col("at") + size).alias("until"), "n", mean.alias("popularity"))
    leave = rows.where("until <= n").groupBy("source", F.col("until").alias("at")).agg(F.count("*").alias("left"))
    met = rows.join(leave, ["source", "at"], "left")
    distinct = F.sum(1 - F.coalesce("left", F.lit(0))).over(W.partitionBy("source").orderBy("at"))
    return met.select("source", "event_id", (distinct / F.lit(float(n_items))).alias("coverage"), "popularity")
