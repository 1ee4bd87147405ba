"""Filters, aggregates, windows and set operations on interaction tables.

Tables are ``interactions(user_id, item_id, domain, rating, timestamp)`` and ``items(item_id, domain, title, genres,
creator, year)``. Every ranking ends in an id, so results don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import materialise

POSITIVE = 4.0
DOMAINS = ("movie", "game")


def positives(inter: DataFrame, least: float = POSITIVE) -> DataFrame:
    return inter.where(F.col("rating") >= least)


def signed_weight(rating: Column) -> Column:
    """5 counts 1, 4 counts 0.75, 3 nothing, less is a dislike."""
    return F.when(rating >= 5, 1.0).when(rating >= 4, 0.75).when(rating >= 3, 0.0).otherwise(-1.0)


def pseudonym(user: Column) -> Column:
    return F.concat(F.lit("u"), F.substring(F.sha1(user.cast("string").cast("binary")), 1, 12))


def ranked(df: DataFrame, by: list[str], *order: Column | str, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def top(df: DataFrame, by: list[str], k: int, *order: Column | str, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group with their rank from 1. Spark keeps only ``k`` rows of each task before the shuffle."""
    return ranked(df, by, *order, name=name).where(F.col(name) <= k)


#: Rows that one task of ``dealt`` gets, about.
DEALT_ROWS = 250_000


def parts_of(df: DataFrame, rows: int) -> int:
    """Parts of about ``DEALT_ROWS`` rows each, one a core at least."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // DEALT_ROWS))


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """``df``, of about ``rows`` rows, by hash of ``by`` in as many parts as keep a task's sorts small. Spark joins small parts by
    their size in files, where rows of few users and items take a fiftieth of what they take in memory; these stay as they are."""
    return df.repartition(parts_of(df, rows), *by)


def hash_sample(df: DataFrame, n: int, key: str, seed: str, by: list[str] | None = None) -> DataFrame:
    """``n`` rows (of each group) in the order of md5(seed|key): a sample without replacement that can be repeated."""
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")).cast("binary"))
    if by:
        return top(df, by, n, order, F.col(key), name="__rank").drop("__rank")
    return df.orderBy(order, key).limit(n)


def user_domain_counts(inter: DataFrame) -> DataFrame:
    return inter.groupBy("user_id").pivot("domain", list(DOMAINS)).count().na.fill(0, list(DOMAINS))


def bridge_users(inter: DataFrame, least: int = 1) -> DataFrame:
    """Users with at least ``least`` positives in both domains."""
    return user_domain_counts(positives(inter)).where(" AND ".join(f"{d} >= {least}" for d in DOMAINS)).select("user_id")


def user_pools(inter: DataFrame, least: int = 1, single: int = 5, cap: int | None = None) -> DataFrame:
    """``user_id, pool``: ``bridge`` with ``least`` positives in both domains, ``<domain>_only`` with ``single`` in one and
    none in the other; of each pool the ``cap`` users that come first by hash, if there is a cap."""
    n = user_domain_counts(positives(inter))
    movie, game = (F.col(d) for d in DOMAINS)
    pool = F.when((movie >= least) & (game >= least), "bridge").when((movie >= single) & (game == 0), "movie_only").when((game >= single) & (movie == 0), "game_only")
    pools = n.select("user_id", pool.alias("pool")).where("pool is not null")
    return pools if cap is None else hash_sample(pools, cap, "user_id", "pool", ["pool"])


def funnel(raw: DataFrame, inter: DataFrame, items: DataFrame) -> DataFrame:
    """``(metric, value)``: rows, users and works before and after editions are merged, by domain, and what they share."""
    metric = lambda df, **aggs: df.agg(*[a.cast("double").alias(m) for m, a in aggs.items()]).unpivot([], list(aggs), "metric", "value")
    by = {}
    for d in DOMAINS:
        by |= {f"rows_{d}": F.count_if(F.col("domain") == d), f"works_{d}": F.countDistinct(F.when(F.col("domain") == d, F.col("item_id")))}
    movie, game = (F.col(d) > 0 for d in DOMAINS)
    return (
        metric(raw, raw_rows=F.count("*"), raw_users=F.countDistinct("user_id"))
        .unionByName(metric(inter, rows=F.count("*"), works=F.countDistinct("item_id"), positive_rate=F.avg((F.col("rating") >= POSITIVE).cast("int")), **by))
        .unionByName(metric(user_domain_counts(inter), users=F.count("*"), users_movie=F.count_if(movie), users_game=F.count_if(game), users_both=F.count_if(movie & game)))
        .unionByName(metric(items, themed_share=F.avg((F.size("genres") > 0).cast("int"))))
    )


def year_suffix(items: DataFrame) -> DataFrame:
    """Games whose title another game has get their year, unless the title ends in one."""
    same = F.count("*").over(W.partitionBy("domain", F.lower("title")))
    suffixed = F.concat("title", F.lit(" ("), F.col("year").cast("string"), F.lit(")"))
    clashes = (F.col("domain") == "game") & (same > 1) & ~F.col("title").rlike(r"\(\d{4}\)$")
    return items.withColumn("title", F.when(clashes, suffixed).otherwise(F.col("title")))


def iterative_prune(inter: DataFrame, item_floor: int = 5, user_floor: int = 3, rounds: int = 3) -> DataFrame:
    """Three rounds, no fixed point: items with enough positives, then users with enough positives."""
    for _ in range(rounds):
        good = positives(inter)
        inter = inter.join(good.groupBy("item_id").count().where(F.col("count") >= item_floor), "item_id", "left_semi")
        good = positives(inter)
        inter = inter.join(good.groupBy("user_id").count().where(F.col("count") >= user_floor), "user_id", "left_semi")
    return inter.select("user_id", "item_id", "domain", "rating", "timestamp")


def merge_editions(rows: DataFrame) -> DataFrame:
    """One row for each user and work: largest rating, earliest time."""
    return rows.groupBy("user_id", "item_id").agg(F.min("domain").alias("domain"), F.max("rating").alias("rating"), F.min("timestamp").alias("timestamp"))


def item_stats(inter: DataFrame) -> DataFrame:
    liked = F.count_if(F.col("rating") >= POSITIVE)
    return inter.groupBy("item_id").agg(liked.alias("popularity"), F.avg("rating").alias("rating_mean"), F.count("*").alias("rating_count"))


def chronological_split(inter: DataFrame, test: float = 0.2, val: float = 0.1, least: int = 5) -> DataFrame:
    """``part`` of each row: a user's last share is test, the one before validation, the rest (and short histories) train.
    Shares are rounded half to even, one row at least."""
    own = W.partitionBy("user_id")
    n, at = F.count("*").over(own), F.row_number().over(own.orderBy("timestamp", "item_id")) - 1
    n_test = F.greatest(F.lit(1), F.bround(n * test).cast("int"))
    n_val = F.greatest(F.lit(1), F.bround(n * val).cast("int"))
    part = F.when(n < least, "train").when(at >= n - n_test, "test").when(at >= n - n_test - n_val, "val").otherwise("train")
    return inter.withColumn("part", part)


def percentile_rank(order: Column, by: list[str], *ties: str) -> Column:
    """Position over n - 1 without shared ranks; 0 for a group of one."""
    own = W.partitionBy(*by)
    n = F.count("*").over(own)
    return (F.row_number().over(own.orderBy(order, *ties)) - 1) / F.greatest(n - 1, F.lit(1))


def zscore(value: Column, by: list[str]) -> Column:
    own = W.partitionBy(*by)
    sd = F.stddev_pop(value).over(own)
    return F.when(sd > 0, (value - F.avg(value).over(own)) / sd).otherwise(0.0)


def minmax(value: Column, by: list[str]) -> Column:
    own = W.partitionBy(*by)
    low = F.min(value).over(own)
    return (value - low) / (F.max(value).over(own) - low + 1e-9)


def gini(counts: DataFrame, by: str, value: str) -> DataFrame:
    """Gini coefficient of ``value`` in each group, and ``top_share``, what the top hundredth holds. Equal values are counted first, so no window sees single rows."""
    levels = counts.groupBy(by, value).agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(W.partitionBy(by).orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # The ranks before+1 .. before+m of one level add up to m*before + m(m+1)/2.
    rows = levels.withColumn("ranks", F.col("m") * before + F.col("m") * (F.col("m") + 1) / 2)
    # Of a level, what is among the hundredth of all with the largest values.
    n = F.sum("m").over(W.partitionBy(by))
    rows = rows.withColumn("first", F.greatest(F.lit(0), F.least(F.col("m"), F.ceil(0.01 * n) - (n - before - F.col("m")))))
    total = rows.groupBy(by).agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col(value)).alias("s"), F.sum(F.col("ranks") * F.col(value)).alias("r"), F.sum(F.col("first") * F.col(value)).alias("t"))
    return total.select(by, ((2 * F.col("r") - (F.col("n") + 1) * F.col("s")) / (F.col("n") * F.col("s"))).alias("gini"), (F.col("t") / F.col("s")).alias("top_share"))


def missing_columns(df: DataFrame, *needed: str) -> DataFrame:
    """One row ``(required_columns, violations)``: how many of the columns are missing."""
    return df.sparkSession.range(1).select(F.lit("required_columns").alias("rule"), F.lit(len(set(needed) - set(df.columns))).cast("long").alias("violations"))


def contract_interactions(inter: DataFrame, items: DataFrame) -> DataFrame:
    """``(rule, violations)``: required columns, nulls, rating range, domains, times, unique keys, known items. With columns
    missing that is the only rule."""
    schema = missing_columns(inter, "user_id", "item_id", "domain", "rating", "timestamp")
    if not {"user_id", "item_id", "domain", "rating", "timestamp"} <= set(inter.columns):
        return schema
    one = inter.agg(
        F.count_if(F.col("user_id").isNull() | F.col("item_id").isNull() | F.col("rating").isNull()).alias("null_values"),
        F.count_if(~F.col("rating").between(1, 5)).alias("rating_range"),
        F.count_if(~F.col("domain").isin(*DOMAINS)).alias("domain_set"),
        F.count_if(F.col("timestamp") <= 0).alias("timestamp_positive"),
    )
    rules = one.unpivot([], ["null_values", "rating_range", "domain_set", "timestamp_positive"], "rule", "violations")
    twice = inter.groupBy("user_id", "item_id").count().where("count > 1").agg(F.count("*").alias("violations")).select(F.lit("unique_key").alias("rule"), "violations")
    unknown = inter.join(items.select("item_id"), "item_id", "left_anti").agg(F.count("*").alias("violations")).select(F.lit("known_items").alias("rule"), "violations")
    return rules.unionByName(twice).unionByName(unknown).unionByName(schema)


def contract_items(items: DataFrame) -> DataFrame:
    """``(rule, violations)``: required columns, domains, titles, unique ids. With columns missing that is the only rule."""
    schema = missing_columns(items, "item_id", "domain", "title", "genres", "year")
    if not {"item_id", "domain", "title", "genres", "year"} <= set(items.columns):
        return schema
    one = items.agg(
        F.count_if(~F.col("domain").isin(*DOMAINS)).alias("domain_set"),
        F.count_if(F.col("title").isNull() | (F.trim("title") == "")).alias("title_present"),
    ).unpivot([], ["domain_set", "title_present"], "rule", "violations")
    twice = items.groupBy("item_id").count().where("count > 1").agg(F.count("*").alias("violations")).select(F.lit("unique_key").alias("rule"), "violations")
    return one.unionByName(twice).unionByName(schema)


#: Rows of a range that is numbered by itself.
RANGE_ROWS = 1_000_000


def numbered(rows: DataFrame, by: str, name: str = "at") -> DataFrame:
    """``rows`` with ``name``, long: their places in the order of ``by`` (unlike values), from 0, without one window over all rows.

    Rows are cut into ranges, which are written out, counted, and numbered each by itself.
    """
    ranges = max(1, -(-rows.count() // RANGE_ROWS))
    parts = materialise(rows.repartitionByRange(ranges, by).withColumn("__part", F.spark_partition_id()))
    before = parts.groupBy(F.col("__part").alias("__p")).count().select("__p", (F.sum("count").over(W.orderBy("__p")) - F.col("count")).alias("__before"))  # a row a range
    local = F.row_number().over(W.partitionBy("__part").orderBy(by)) - 1
    told = parts.withColumn("__i", local).join(F.broadcast(before), F.col("__part") == F.col("__p"))
    return told.select(*rows.columns, (F.col("__i") + F.col("__before")).cast("long").alias(name))


def latest(rows: DataFrame, key: list[str], *order: Column | str) -> DataFrame:
    """The last row of each key."""
    return top(rows, key, 1, *order, name="__rank").drop("__rank")


def year_clusters(rows: DataFrame, key: list[str], year: str = "year", tolerance: int = 3) -> DataFrame:
    """Single-linkage clusters of the years of each key: a gap above ``tolerance`` begins the next cluster."""
    own = W.partitionBy(*key).orderBy(year)
    years = rows.select(*key, year).distinct()
    new = F.when(F.col(year) - F.lag(year).over(own) > tolerance, 1).otherwise(0)
    return years.withColumn("__new", new).withColumn("cluster", F.sum("__new").over(own).cast("int")).drop("__new")


def fingerprint(df: DataFrame, *cols: str) -> DataFrame:
    """Row count and an order-independent sum of 60-bit hash prefixes."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in cols])
    part = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n_rows"), F.sum(part).cast("string").alias("digest"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def minmax_in_group(df: DataFrame, group: str, value: str) -> DataFrame:
    """``score``: the value's place between the group's smallest and largest, from two aggregates of the group joined back."""
    ends = df.groupBy(F.col(group).alias("__group")).agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    joined = df.join(ends, F.col(group).eqNullSafe(F.col("__group")))
    return joined.withColumn("score", (F.col(value) - F.col("__low")) / (F.col("__high") - F.col("__low") + 1e-9)).drop("__group", "__low", "__high")


def links_topk(members: DataFrame, group: str, most: int = 24) -> DataFrame:
    """``item_id, linked_id, rank``: the most popular other members of each item's group, ties by id.

    Only the first ``most + 1`` members of a group can be linked, so each item meets those and never the whole group.
    """
    top = members.withColumn("__rank", F.row_number().over(W.partitionBy(group).orderBy(F.desc("popularity"), "item_id"))).where(F.col("__rank") <= most + 1)
    top = top.select(F.col(group).alias("__group"), F.col("item_id").alias("linked_id"), "__rank")
    own = top.select(F.col("linked_id").alias("item_id"), F.col("__rank").alias("__own"))
    met = members.select("item_id", group).join(top, F.col(group) == F.col("__group")).where(F.col("item_id") != F.col("linked_id")).join(own, "item_id", "left")
    # An item that is itself among the first leaves its place to those after it.
    rank = F.col("__rank") - F.when(F.col("__own") < F.col("__rank"), 1).otherwise(0)
    return met.select("item_id", "linked_id", rank.cast("int").alias("rank")).where(F.col("rank") <= most)
