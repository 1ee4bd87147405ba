"""Candidates, features, rankers and what follows the ranker."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import core

RANK_CAP = 1000


def source_ranks(scores: DataFrame) -> DataFrame:
    """``rank`` from 0 of each item in each user's source, capped. Rows: user_id, source, item_id, score."""
    ordered = core.ranked(scores.where("score <> 0"), ["user_id", "source"], F.desc("score"), "item_id")
    return ordered.withColumn("rank", F.least(F.col("rank") - 1, F.lit(RANK_CAP)))


#: Unseen items that each source names, and what sources name fewer.
PER_SOURCE, FEWER = 100, {"popularity": 50}


def candidates(scores: DataFrame, seen: DataFrame, k: int = PER_SOURCE, fewer: dict[str, int] = FEWER) -> DataFrame:
    """``(user_id, item_id, sources)``: the ``k`` best unseen items of every source with the sources that name them; of the sources
    in ``fewer`` so many. A source without a score other than 0 names nothing."""
    new = scores.where("score <> 0").join(seen.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    best = core.top(new, ["user_id", "source"], k, F.desc("score"), "item_id")
    for source, most in fewer.items():
        best = best.where((F.col("source") != source) | (F.col("rank") <= most))
    return best.groupBy("user_id", "item_id").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def rrf(cands: DataFrame, ranks: DataFrame, sources: list[str]) -> DataFrame:
    """Sum over all sources of 1 / (60 + rank); an item a source doesn't score has the capped rank there."""
    known = ranks.groupBy("user_id", "item_id").agg(F.sum(1 / (60 + F.col("rank"))).alias("s"), F.count("*").alias("n"))
    rows = cands.join(known, ["user_id", "item_id"], "left").na.fill(0, ["s", "n"])
    return rows.select("user_id", "item_id", "sources", (F.col("s") + (len(sources) - F.col("n")) / (60.0 + RANK_CAP)).alias("score"))


def fused(scores: DataFrame, seen: DataFrame, sources: list[str], k: int = PER_SOURCE, fewer: dict[str, int] = FEWER) -> DataFrame:
    """``rrf`` of ``candidates`` by ``source_ranks``, of written tables: all rows are dealt once by user, some ``core.DEALT_ROWS`` a part,
    and marked, ranked and added up there."""
    told = scores.where("score <> 0").select("user_id", "item_id", "source", "score")
    known = seen.where("user_id is not null and item_id is not null").select("user_id", "item_id", F.lit(None).cast("string").alias("source"), F.lit(None).cast("double").alias("score"))
    rows = core.dealt(told.unionByName(known), scores.count() + seen.count(), "user_id")
    rows = rows.withColumn("old", F.max(F.col("source").isNull()).over(W.partitionBy("user_id", "item_id"))).where("source is not null")
    rows = core.ranked(rows, ["user_id", "source"], F.desc("score"), "item_id")
    rows = core.ranked(rows, ["user_id", "source", "old"], F.desc("score"), "item_id", name="place")
    most = F.lit(k)
    for source, n in fewer.items():
        most = F.when(F.col("source") == source, min(n, k)).otherwise(most)
    new = ~F.col("old") & (F.col("place") <= most)
    each = rows.groupBy("user_id", "item_id").agg(
        F.array_sort(F.collect_set(F.when(new, F.col("source")))).alias("sources"), F.sum(1 / (60 + F.least(F.col("rank") - 1, F.lit(RANK_CAP)))).alias("s"), F.count("*").alias("n"),
    )
    return each.where(F.size("sources") > 0).select("user_id", "item_id", "sources", (F.col("s") + (len(sources) - F.col("n")) / (60.0 + RANK_CAP)).alias("score"))


def taste_blend(rows: DataFrame, taste: float) -> DataFrame:
    own = ["user_id"]
    blend = (1 - taste) * core.percentile_rank(F.col("score"), own, "item_id") + taste * core.percentile_rank(F.col("sim"), own, "item_id")
    return rows.withColumn("blended", blend)


def intent_tiers(rows: DataFrame, k: int) -> DataFrame:
    """Adds 1000 for each match with what was asked for, if at least ``k`` candidates match at all."""
    enough = F.count_if(F.col("n_match") > 0).over(W.partitionBy("user_id")) >= k
    return rows.withColumn("tiered", F.col("score") + F.when(enough, 1000.0 * F.col("n_match")).otherwise(0.0))


def domain_quota(ranked: DataFrame, share: DataFrame, k: int) -> DataFrame:
    """``k`` items by score with a quota for each domain: the profile's share within 0.3 to 0.7, rounded half to even;
    places that a domain can't fill go to the best of the rest. ``share`` has ``user_id, movie_share``."""
    movie = F.bround(F.greatest(F.least(F.col("movie_share"), F.lit(0.7)), F.lit(0.3)) * k).cast("int")
    rows = ranked.join(share.select("user_id", movie.alias("m")), "user_id").withColumn("quota", F.when(F.col("domain") == "movie", F.col("m")).otherwise(k - F.col("m")))
    rows = core.ranked(rows, ["user_id", "domain"], F.desc("score"), "item_id", name="r")
    rows = rows.withColumn("inside", F.col("r") <= F.col("quota"))
    filled = F.count_if("inside").over(W.partitionBy("user_id"))
    rest = F.row_number().over(W.partitionBy("user_id", "inside").orderBy(F.desc("score"), "item_id"))
    kept = rows.withColumn("short", k - filled).withColumn("q", rest).where("inside or q <= short")
    return core.ranked(kept, ["user_id"], F.desc("score"), "item_id").select("user_id", "item_id", "domain", "score", "rank")


#: Pools that a task chooses for at once.
CHOSEN = 256


def mmr(rows: DataFrame, k: int, weight: float = 0.15, same_creator: float = 0.05, by: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Greedy maximal marginal relevance of each pool (user_id, item_id, score, creator, v; a pool for each of ``by``): at most max(5k,
    50) rows of a pool are looked at. Items without a vector are like no other; no creator is never the same creator.

    Rows come ordered by pool, so tasks choose for all pools of a batch at once and carry the last one on.
    """
    most = max(5 * k, 50)
    pool = core.top(rows.select(*by, "item_id", "score", "creator", "v").repartition(*by), list(by), most, F.desc("score"), "item_id", name="__r").drop("__r").sortWithinPartitions(*by, F.desc("score"), "item_id")
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (*by, "item_id")}

    def pools(table: pa.Table) -> np.ndarray:
        """Where pools begin."""
        new = np.zeros(len(table), bool)
        new[:1] = True
        for c in by:
            codes = table.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        return np.flatnonzero(new)

    def choose(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        sizes = np.diff([*starts, len(table)])
        n, width = len(starts), int(sizes.max())
        at = starts[:, None] + np.minimum(np.arange(width), sizes[:, None] - 1)
        real = np.arange(width) < sizes[:, None]
        s = table.column("score").to_numpy()[at]
        rel = (s - s.min(1, keepdims=True)) / (s.max(1, keepdims=True) - s.min(1, keepdims=True) + 1e-9)
        lists = table.column("v").combine_chunks()
        have = lists.is_valid().to_numpy(zero_copy_only=False)
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        v = np.zeros((len(table), max(1, len(flat) // max(1, int(have.sum())))))
        if len(flat):
            v[have] = flat.reshape(int(have.sum()), -1)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        v = v[at]
        maker = table.column("creator").fill_null("").combine_chunks().dictionary_encode()
        codes = maker.indices.to_numpy()
        codes = np.where(np.array([bool(x) for x in maker.dictionary.to_pylist()], bool)[codes], codes, -1)[at]
        near, same, free, each = np.full((n, width), -np.inf), np.zeros((n, width)), real.copy(), np.arange(n)
        chosen, ranks = [], []
        for step in range(min(k, width)):
            value = np.where(free, rel - weight * (near if step else 0) - same_creator * same, -np.inf)
            i = value.argmax(1)
            on = free[each, i]
            chosen.append(at[each, i][on])
            ranks.append(np.full(int(on.sum()), step + 1, np.int32))
            free[each, i] = False
            near = np.maximum(near, np.einsum("npd,nd->np", v, v[each, i]))
            own = codes[each, i][:, None]
            same += (codes == own) & (own >= 0)
        took = pa.array(np.concatenate(chosen))
        columns = [table.column(c).combine_chunks().take(took) for c in (*by, "item_id")]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(ranks))], [*by, "item_id", "rank"])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            starts = pools(table)
            last = int(starts[-1])
            for begin in range(0, len(starts) - 1, CHOSEN):  # pools of a slice
                some = starts[begin : min(begin + CHOSEN, len(starts) - 1)]
                end = int(starts[min(begin + CHOSEN, len(starts) - 1)])
                yield choose(table.slice(int(some[0]), end - int(some[0])), some - some[0])
            rest = table.slice(last)
        if rest is not None:
            yield choose(rest, np.zeros(1, np.int64))

    return pool.mapInArrow(pick, ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", rank int")


def pairwise_ranker(rows: DataFrame, features: list[str]):
    """A linear ranker from feature differences of (relevant, other) pairs of a query, weighted by the gain a swap changes.

    ``rows`` has user_id, label, score (the order before) and the features. Each relevant row meets at most 20 others of
    its query, by score, so pairs grow with the rows.
    """
    at = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("score"), "item_id"))
    gain = rows.withColumn("g", 1 / F.log2(1 + at))
    pos = gain.where("label = 1").select("user_id", F.col("item_id").alias("p"), F.col("g").alias("gp"), *[F.col(f).alias(f"p_{f}") for f in features])
    neg = core.top(gain.where("label = 0"), ["user_id"], 20, F.desc("score"), "item_id", name="__r").select("user_id", F.col("item_id").alias("n"), F.col("g").alias("gn"), *[F.col(f).alias(f"n_{f}") for f in features])
    pairs = pos.join(neg, "user_id")
    flip = F.when(F.pmod(F.xxhash64("user_id", "p", "n"), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    diff = pairs.select(((flip + 1) / 2).alias("y"), F.abs(F.col("gp") - F.col("gn")).alias("w"), *[(flip * (F.col(f"p_{f}") - F.col(f"n_{f}"))).alias(f) for f in features])
    data = VectorAssembler(inputCols=features, outputCol="x").transform(diff).where("w > 0")
    return LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", fitIntercept=False, regParam=0.01, maxIter=20).fit(data)


#: Of the queries, those that stop the trees; rounds, depth and step of the trees.
HELD_BACK, ROUNDS, DEPTH, STEP = 0.15, 60, 4, 0.1


def held_back(query: Column, share: float = HELD_BACK) -> Column:
    """Whole queries, by hash of their id."""
    return F.pmod(F.xxhash64(F.lit("held back"), query), F.lit(10_000)) < int(10_000 * share)


def tree_ranker(rows: DataFrame, features: list[str], rounds: int = ROUNDS, depth: int = DEPTH, step: float = STEP, seed: int = 7):
    """Boosted trees over ``features`` (nulls count as 0), which stop where the loss on held-back queries falls no more.

    ``rows`` as for ``pairwise_ranker``. Queries weigh the same, and in each the relevant rows as much as all others together.
    """
    own = W.partitionBy("user_id", "label")
    rows = rows.na.fill(0.0, features).withColumns({"__w": 1.0 / F.count("*").over(own), "__held": held_back(F.col("user_id")), "__y": F.col("label").cast("double")})
    data = VectorAssembler(inputCols=features, outputCol="x").transform(rows)
    trees = GBTClassifier(featuresCol="x", labelCol="__y", weightCol="__w", maxIter=rounds, maxDepth=depth, stepSize=step, subsamplingRate=0.8, seed=seed, validationIndicatorCol="__held")
    return trees.fit(data)


def tree_scores(rows: DataFrame, model, features: list[str], out: str = "ranked") -> DataFrame:
    """``rows`` with the trees' probability that a row is relevant."""
    data = VectorAssembler(inputCols=features, outputCol="__x").transform(rows.na.fill(0.0, features))
    scored = model.setFeaturesCol("__x").setPredictionCol("__prediction").setProbabilityCol("__probability").setRawPredictionCol("__raw").transform(data)
    return scored.withColumn(out, vector_to_array("__probability")[1]).drop("__x", "__prediction", "__probability", "__raw")


def linear_score(features: list[str], weights: list[float]) -> Column:
    return sum((F.col(f) * float(w) for f, w in zip(features, weights, strict=True)), F.lit(0.0))


def quota_lists(rows: DataFrame, share: DataFrame, k: int) -> DataFrame:
    """``k`` items of each user: diverse lists of each domain, cut by ``domain_quota``. Rows as for ``mmr``, with ``domain``."""
    lists = mmr(rows.where(F.col("domain").isin(*core.DOMAINS)), k, by=("user_id", "domain"))
    ordered = lists.select("user_id", "item_id", "domain", (-F.col("rank")).cast("double").alias("score"))
    return domain_quota(ordered, share, k).select("user_id", "item_id", "domain", "rank")


def routed(rows: DataFrame) -> DataFrame:
    """``route``: ``cross`` for queries all of whose candidates lie where the user has no history (``n_hist_same`` is 0)."""
    most = F.max("n_hist_same").over(W.partitionBy("user_id"))
    return rows.withColumn("route", F.when(most == 0, "cross").otherwise("main"))


def routed_rank(rows: DataFrame, features: list[str], k: int) -> DataFrame:
    """The first ``k`` of each query by the model of its route. A route none of whose queries has both relevant and other rows takes
    the main model; where the main one has none either, the order before stays.

    Rows as for ``pairwise_ranker``, with ``route``.
    """
    weights, out = None, None
    for route in ("main", "cross"):
        own = rows.where(F.col("route") == route)
        has = own.groupBy("user_id").agg(F.max("label").alias("high"), F.min("label").alias("low")).where("high = 1 and low = 0")
        if not has.isEmpty():
            weights = list(pairwise_ranker(own, features).coefficients.toArray())
        order = F.col("score") if weights is None else linear_score(features, weights)
        one = core.top(own.withColumn("ranked", order), ["user_id"], k, F.desc("ranked"), "item_id")
        out = one if out is None else out.unionByName(one)
    return out
