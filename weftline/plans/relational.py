"""Projections, filters, joins, aggregates, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import core, logs
from ..sources.scratch import shared_path
from ..sources.tables import interactions, items, raw_ratings, read_table
from .registry import query


@query("WITH {R} SELECT domain, count(*) AS n_rows, count(DISTINCT user_id) AS n_users, avg(rating) AS mean_rating FROM raw GROUP BY 1")
def scan_parquet(spark: SparkSession, sf: str) -> DataFrame:
    return raw_ratings(spark, sf).groupBy("domain").agg(F.count("*").alias("n_rows"), F.countDistinct("user_id").alias("n_users"), F.avg("rating").alias("mean_rating"))


@query("WITH {I} SELECT user_id, item_id, domain, rating, timestamp FROM inter WHERE rating >= 4")
def positives(spark, sf):
    return core.positives(interactions(spark, sf)).select("user_id", "item_id", "domain", "rating", "timestamp")


@query("WITH {I} SELECT user_id, item_id, CASE WHEN rating >= 5 THEN 1.0::DOUBLE WHEN rating >= 4 THEN 0.75::DOUBLE WHEN rating >= 3 THEN 0.0::DOUBLE ELSE -1.0::DOUBLE END AS weight FROM inter")
def signed_weights(spark, sf):
    return interactions(spark, sf).select("user_id", "item_id", core.signed_weight(F.col("rating")).alias("weight"))


@query("SELECT DISTINCT o_custkey AS user_id, 'u' || substr(sha1(o_custkey::VARCHAR), 1, 12) AS pseudonym FROM orders")
def pseudonymise(spark, sf):
    return read_table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id")).distinct().withColumn("pseudonym", core.pseudonym(F.col("user_id")))


@query("""WITH {I} SELECT 'null_values' AS rule, count(*) FILTER (user_id IS NULL OR item_id IS NULL OR rating IS NULL) AS violations FROM inter
UNION ALL SELECT 'rating_range', count(*) FILTER (rating NOT BETWEEN 1 AND 5) FROM inter UNION ALL SELECT 'domain_set', count(*) FILTER (domain NOT IN ('movie', 'game')) FROM inter
UNION ALL SELECT 'timestamp_positive', count(*) FILTER (timestamp <= 0) FROM inter UNION ALL SELECT 'unique_key', count(*) FROM (SELECT 1 FROM inter GROUP BY user_id, item_id HAVING count(*) > 1)
UNION ALL SELECT 'known_items', count(*) FROM inter WHERE item_id NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT 'required_columns', 0""")
def contract_interactions(spark, sf):
    return core.contract_interactions(interactions(spark, sf), items(spark, sf))


@query("""WITH {T} SELECT 'domain_set' AS rule, count(*) FILTER (domain NOT IN ('movie', 'game')) AS violations FROM items UNION ALL
SELECT 'title_present', count(*) FILTER (title IS NULL OR trim(title) = '') FROM items UNION ALL SELECT 'unique_key', count(*) FROM (SELECT 1 FROM items GROUP BY item_id HAVING count(*) > 1) UNION ALL SELECT 'required_columns', 0""")
def contract_items(spark, sf):
    return core.contract_items(items(spark, sf))


@query("WITH ids AS (SELECT DISTINCT p_partkey AS item_id FROM part) SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS item_index FROM ids")
def index_items(spark, sf):
    """Dense numbers of the items in the order of their ids."""
    return core.numbered(items(spark, sf).select("item_id").distinct(), "item_id", "item_index")


@query("WITH {I}, {T} SELECT inter.domain, creator, count(*) AS n FROM inter JOIN items USING (item_id) GROUP BY 1, 2")
def join_canonical(spark, sf):
    return interactions(spark, sf).join(items(spark, sf).select("item_id", "creator"), "item_id").groupBy("domain", "creator").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS item_id, vec_id, label FROM part JOIN embeddings ON p_partkey = vec_id")
def join_meta_map(spark, sf):
    return items(spark, sf).select("item_id").join(read_table(spark, sf, "embeddings").select("vec_id", "label"), F.col("item_id") == F.col("vec_id"))


@query("WITH {I} SELECT user_id, item_id, rating FROM inter WHERE user_id IN (SELECT user_id FROM inter WHERE rating >= 4 GROUP BY 1 HAVING count(*) >= 5)")
def semi_keep(spark, sf):
    inter = interactions(spark, sf)
    busy = core.positives(inter).groupBy("user_id").count().where("count >= 5")
    return inter.join(busy, "user_id", "left_semi").select("user_id", "item_id", "rating")


@query("WITH {I} SELECT user_id, item_id FROM inter WHERE item_id NOT IN (SELECT vec_id FROM embeddings)")
def anti_unknown(spark, sf):
    known = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"))
    return interactions(spark, sf).join(known, "item_id", "left_anti").select("user_id", "item_id")


@query("""WITH {I}, {T}, s AS (SELECT item_id, count(*) FILTER (rating >= 4) AS popularity, avg(rating) AS rating_mean, count(*) AS rating_count FROM inter GROUP BY 1)
SELECT items.item_id, title, coalesce(popularity, 0)::BIGINT AS popularity, coalesce(rating_mean, 0)::DOUBLE AS rating_mean, coalesce(rating_count, 0)::BIGINT AS rating_count FROM items LEFT JOIN s USING (item_id)""")
def lookup_stats(spark, sf):
    cols = ["popularity", "rating_mean", "rating_count"]
    return items(spark, sf).select("item_id", "title").join(core.item_stats(interactions(spark, sf)), "item_id", "left").na.fill(0, cols)


@query("WITH {R} SELECT user_id, item_id, rating, timestamp FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY timestamp DESC, rating DESC) AS r FROM raw) WHERE r = 1")
def latest_rating(spark, sf):
    return core.latest(raw_ratings(spark, sf), ["user_id", "item_id"], F.desc("timestamp"), F.desc("rating")).select("user_id", "item_id", "rating", "timestamp")


@query("WITH {I} SELECT user_id, count(*) FILTER (domain = 'movie') AS movie, count(*) FILTER (domain = 'game') AS game FROM inter GROUP BY 1")
def user_domain_pivot(spark, sf):
    return core.user_domain_counts(interactions(spark, sf))


@query("WITH {I} SELECT user_id, item_id, domain, rating, timestamp FROM inter")
def merge_editions(spark, sf):
    return core.merge_editions(raw_ratings(spark, sf))


@query("""WITH {I}, n AS (SELECT user_id, count(*) FILTER (domain = 'movie') AS m, count(*) FILTER (domain = 'game') AS g FROM inter WHERE rating >= 4 GROUP BY 1),
p AS (SELECT user_id, CASE WHEN m >= 1 AND g >= 1 THEN 'bridge' WHEN m >= 5 AND g = 0 THEN 'movie_only' WHEN g >= 5 AND m = 0 THEN 'game_only' END AS pool FROM n)
SELECT user_id, pool FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY md5('pool|' || user_id), user_id) AS k FROM p WHERE pool IS NOT NULL) WHERE k <= 1000""")
def bridge_users(spark, sf):
    return core.user_pools(interactions(spark, sf), cap=1000)


_ROUND = """r{n}i AS (SELECT * FROM r{p} WHERE item_id IN (SELECT item_id FROM r{p} WHERE rating >= 4 GROUP BY 1 HAVING count(*) >= {f})),
r{n} AS (SELECT * FROM r{n}i WHERE user_id IN (SELECT user_id FROM r{n}i WHERE rating >= 4 GROUP BY 1 HAVING count(*) >= {u}))"""


@query("WITH {I}, r0 AS (SELECT * FROM inter), " + ", ".join(_ROUND.format(n=k, p=k - 1, f=5, u=3) for k in (1, 2, 3)) + " SELECT user_id, item_id, domain, rating, timestamp FROM r3")
def iterative_prune(spark, sf):
    return core.iterative_prune(interactions(spark, sf), 5, 3)


@query("WITH {I} SELECT item_id, count(*) AS popularity FROM inter WHERE rating >= 4 GROUP BY 1")
def item_popularity(spark, sf):
    return core.positives(interactions(spark, sf)).groupBy("item_id").agg(F.count("*").alias("popularity"))


@query("WITH {I} SELECT item_id, avg(rating) AS rating_mean, count(*) AS rating_count FROM inter GROUP BY 1")
def item_rating_stats(spark, sf):
    return core.item_stats(interactions(spark, sf)).select("item_id", "rating_mean", "rating_count")


@query("""WITH {I}, {T}, d AS (SELECT user_id, count(*) FILTER (domain = 'movie') AS m, count(*) FILTER (domain = 'game') AS g FROM inter GROUP BY 1)
SELECT 'raw_rows' AS metric, count(*)::DOUBLE AS value FROM raw UNION ALL SELECT 'raw_users', count(DISTINCT user_id) FROM raw UNION ALL SELECT 'rows', count(*) FROM inter UNION ALL SELECT 'works', count(DISTINCT item_id) FROM inter
UNION ALL SELECT 'rows_movie', count(*) FROM inter WHERE domain = 'movie' UNION ALL SELECT 'rows_game', count(*) FROM inter WHERE domain = 'game' UNION ALL SELECT 'works_movie', count(DISTINCT item_id) FROM inter WHERE domain = 'movie' UNION ALL SELECT 'works_game', count(DISTINCT item_id) FROM inter WHERE domain = 'game'
UNION ALL SELECT 'positive_rate', avg((rating >= 4)::INT) FROM inter UNION ALL SELECT 'users', count(*) FROM d UNION ALL SELECT 'users_movie', count(*) FROM d WHERE m > 0 UNION ALL SELECT 'users_game', count(*) FROM d WHERE g > 0 UNION ALL SELECT 'users_both', count(*) FROM d WHERE m > 0 AND g > 0
UNION ALL SELECT 'themed_share', avg((len(genres) > 0)::INT) FROM items""")
def funnel_report(spark, sf):
    return core.funnel(raw_ratings(spark, sf), interactions(spark, sf), items(spark, sf))


@query("WITH {I} SELECT rating, count(*) / sum(count(*)) OVER () AS share FROM inter GROUP BY 1")
def rating_distribution(spark, sf):
    by = interactions(spark, sf).groupBy("rating").agg(F.count("*").alias("n"))
    return by.crossJoin(F.broadcast(by.agg(F.sum("n").alias("total")))).select("rating", (F.col("n") / F.col("total")).alias("share"))  # the total is one row


@query("WITH {I}, n AS (SELECT user_id, count(*) AS n FROM inter GROUP BY 1) SELECT quantile_cont(n, 0.5)::DOUBLE AS median, quantile_cont(n, 0.9)::DOUBLE AS p90, quantile_cont(n, 0.75)::DOUBLE AS heavy_cut, max(n) AS most FROM n")
def activity_quantiles(spark, sf):
    # percentile counts equal values first: its state grows with the distinct activity levels, not with the users.
    n = interactions(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"))
    return n.agg(F.percentile("n", 0.5).alias("median"), F.percentile("n", 0.9).alias("p90"), F.percentile("n", 0.75).alias("heavy_cut"), F.max("n").alias("most"))


@query("""WITH {I}, p AS (SELECT domain, item_id, count(*) AS x FROM inter WHERE rating >= 4 GROUP BY ALL), r AS (SELECT domain, x, row_number() OVER (PARTITION BY domain ORDER BY x, item_id) AS i, count(*) OVER (PARTITION BY domain) AS n FROM p)
SELECT domain, sum((2 * i - n - 1) * x) / (max(n) * sum(x)) AS gini, sum(x) FILTER (i > n - ceil(0.01 * n)) / sum(x) AS top_share FROM r GROUP BY 1""")
def gini_concentration(spark, sf):
    pop = core.positives(interactions(spark, sf)).groupBy("domain", "item_id").agg(F.count("*").alias("x"))
    return core.gini(pop, "domain", "x")


@query("WITH {I} SELECT domain, count(*) / (count(DISTINCT user_id) * count(DISTINCT item_id)) AS density FROM inter GROUP BY 1")
def density(spark, sf):
    return interactions(spark, sf).groupBy("domain").agg((F.count("*") / (F.countDistinct("user_id") * F.countDistinct("item_id"))).alias("density"))


@query("""WITH {I}, s AS (SELECT item_id, avg(rating) AS m, count(*) AS n FROM inter GROUP BY 1) SELECT item_id, (m * n + (SELECT avg(m) FROM s) * 10) / (n + 10) AS bayes_rating FROM s""")
def bayes_rating(spark, sf):
    s = core.item_stats(interactions(spark, sf))
    prior = s.agg(F.avg("rating_mean").alias("prior"))  # one row
    return s.crossJoin(F.broadcast(prior)).select("item_id", ((F.col("rating_mean") * F.col("rating_count") + F.col("prior") * 10) / (F.col("rating_count") + 10)).alias("bayes_rating"))


@query("""WITH {I}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp, item_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM inter),
k AS (SELECT *, greatest(1, round_even(n * 0.2, 0)::INT) AS nt, greatest(1, round_even(n * 0.1, 0)::INT) AS nv FROM r)
SELECT user_id, item_id, CASE WHEN n < 5 THEN 'train' WHEN pos >= n - nt THEN 'test' WHEN pos >= n - nt - nv THEN 'val' ELSE 'train' END AS part FROM k""")
def chronological_split(spark, sf):
    return core.chronological_split(interactions(spark, sf)).select("user_id", "item_id", "part")


@query("WITH {I} SELECT user_id, item_id, pow(0.5, (row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, item_id DESC) - 1) / 20.0) AS decay FROM inter")
def recency_weights(spark, sf):
    r = core.ranked(interactions(spark, sf), ["user_id"], F.desc("timestamp"), F.desc("item_id"))
    return r.select("user_id", "item_id", F.pow(F.lit(0.5), (F.col("rank") - 1) / 20.0).alias("decay"))


@query("WITH {I} SELECT user_id, item_id, r::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, item_id DESC) AS r FROM inter) WHERE r <= 20")
def last_n_history(spark, sf):
    return core.top(interactions(spark, sf), ["user_id"], 20, F.desc("timestamp"), F.desc("item_id")).select("user_id", "item_id", "rank")


@query("WITH {I}, p AS (SELECT domain, item_id, count(*) AS n FROM inter GROUP BY ALL) SELECT domain, item_id, (row_number() OVER (PARTITION BY domain ORDER BY n, item_id) - 1) / greatest(count(*) OVER (PARTITION BY domain) - 1, 1) AS pct FROM p")
def percentile_rank(spark, sf):
    n = interactions(spark, sf).groupBy("domain", "item_id").agg(F.count("*").alias("n"))
    return n.select("domain", "item_id", core.percentile_rank(F.col("n"), ["domain"], "item_id").alias("pct"))


@query("WITH {T}, y AS (SELECT DISTINCT title, year FROM items), g AS (SELECT *, CASE WHEN year - lag(year) OVER w > 3 THEN 1 ELSE 0 END AS nw FROM y WINDOW w AS (PARTITION BY title ORDER BY year)) SELECT title, year, (sum(nw) OVER (PARTITION BY title ORDER BY year))::INTEGER AS cluster FROM g")
def year_clusters(spark, sf):
    return core.year_clusters(items(spark, sf), ["title"])


@query("WITH {I} SELECT user_id, item_id, CASE WHEN stddev_pop(rating) OVER w > 0 THEN (rating - avg(rating) OVER w) / stddev_pop(rating) OVER w ELSE 0 END AS z, (rating - min(rating) OVER w) / (max(rating) OVER w - min(rating) OVER w + 1e-9) AS scaled FROM inter WINDOW w AS (PARTITION BY user_id)")
def zscore_in_query(spark, sf):
    return interactions(spark, sf).select("user_id", "item_id", core.zscore(F.col("rating"), ["user_id"]).alias("z"), core.minmax(F.col("rating"), ["user_id"]).alias("scaled"))


@query(r"""WITH {T}, d AS (SELECT item_id, domain, year, CASE WHEN item_id % 10 = 3 THEN title || ' (1999)' ELSE title END AS title FROM items), c AS (SELECT *, count(*) OVER (PARTITION BY domain, lower(title)) AS same FROM d)
SELECT item_id, CASE WHEN domain = 'game' AND same > 1 AND NOT regexp_matches(title, '\(\d{4}\)$') THEN title || ' (' || year || ')' ELSE title END AS title FROM c""")
def collision_year_suffix(spark, sf):
    dated = F.when(F.col("item_id") % 10 == 3, F.concat("title", F.lit(" (1999)"))).otherwise(F.col("title"))
    return core.year_suffix(items(spark, sf).withColumn("title", dated)).select("item_id", "title")


@query("WITH {I}, {T}, m AS (SELECT user_id, median(year) AS y FROM inter JOIN items USING (item_id) WHERE rating >= 5 GROUP BY 1) SELECT user_id, inter.item_id, abs(items.year - y)::DOUBLE AS gap FROM inter JOIN items USING (item_id) LEFT JOIN m USING (user_id)")
def median_year_gap(spark, sf):
    inter, years = interactions(spark, sf), items(spark, sf).select("item_id", "year")
    rows = inter.join(years, "item_id")
    mid = rows.where("rating >= 5").groupBy("user_id").agg(F.median("year").alias("y"))
    return rows.join(mid, "user_id", "left").select("user_id", "item_id", F.abs(F.col("year") - F.col("y")).alias("gap"))


@query("WITH {I}, p AS (SELECT domain, item_id, count(*) AS n FROM inter WHERE rating >= 4 GROUP BY ALL) SELECT domain, item_id, n, r::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY n DESC, item_id) AS r FROM p) WHERE r <= 50")
def top_k(spark, sf):
    n = core.positives(interactions(spark, sf)).groupBy("domain", "item_id").agg(F.count("*").alias("n"))
    return core.top(n, ["domain"], 50, F.desc("n"), "item_id")


@query("WITH {I} SELECT item_id, count(*) AS n FROM inter WHERE rating >= 4 GROUP BY 1 ORDER BY n DESC, item_id LIMIT 100")
def global_topk(spark, sf):
    return core.positives(interactions(spark, sf)).groupBy("item_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item_id").limit(100)


@query("WITH u AS (SELECT DISTINCT o_custkey AS user_id FROM orders) SELECT user_id FROM u ORDER BY md5('holdout|' || user_id), user_id LIMIT 100")
def hash_sample(spark, sf):
    return core.hash_sample(read_table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id")).distinct(), 100, "user_id", "holdout")


@query("SELECT source, doc_id, r::INTEGER AS rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha1(source || '|' || doc_id), doc_id) AS r FROM documents)")
def blind_order(spark, sf):
    order = F.sha1(F.concat_ws("|", "source", F.col("doc_id").cast("string")).cast("binary"))
    return core.ranked(read_table(spark, sf, "documents").select("source", "doc_id"), ["source"], order, "doc_id")


@query("WITH {I} SELECT user_id, item_id, 'movie' AS source FROM inter WHERE domain = 'movie' UNION ALL SELECT user_id, item_id, 'game' FROM inter WHERE domain = 'game'")
def union_all(spark, sf):
    inter = interactions(spark, sf)
    one = [inter.where(F.col("domain") == d).select("user_id", "item_id", F.lit(d).alias("source")) for d in core.DOMAINS]
    return one[0].unionByName(one[1])


@query("WITH {I} SELECT user_id FROM inter WHERE domain = 'movie' INTERSECT SELECT user_id FROM inter WHERE domain = 'game'")
def users_in_both(spark, sf):
    inter = interactions(spark, sf)
    return inter.where("domain = 'movie'").select("user_id").intersect(inter.where("domain = 'game'").select("user_id"))


@query("WITH {R}, c AS (SELECT user_id, max(timestamp) AS cut FROM raw GROUP BY 1), x AS (SELECT raw.*, cut FROM raw JOIN c USING (user_id)) SELECT user_id, item_id FROM x WHERE timestamp = cut AND rating >= 4 EXCEPT SELECT user_id, item_id FROM x WHERE timestamp < cut")
def relevant_minus_history(spark, sf):
    """Of each user what they liked on their last day and hadn't rated before."""
    rows = raw_ratings(spark, sf).withColumn("cut", F.max("timestamp").over(W.partitionBy("user_id")))
    key = ["user_id", "item_id"]
    return rows.where("timestamp = cut and rating >= 4").select(*key).distinct().join(rows.where("timestamp < cut").select(*key), key, "left_anti")


@query("SELECT DISTINCT ON (title) p_name AS title, p_partkey AS item_id FROM part ORDER BY title, item_id")
def distinct_rows(spark, sf):
    return items(spark, sf).groupBy("title").agg(F.min("item_id").alias("item_id"))


@query("WITH {I} SELECT item_id FROM inter WHERE rating < 2 UNION SELECT p_partkey FROM part WHERE p_size > 40 UNION SELECT (props->>'k')::INTEGER FROM events WHERE event_type = 'purchase'")
def blocked_union(spark, sf):
    """Ineligible items, compilations and what a user has excluded, here poorly rated, new and bought ones."""
    bought = read_table(spark, sf, "events").where("event_type = 'purchase'").select(F.get_json_object("props", "$.k").cast("int").alias("item_id"))
    return interactions(spark, sf).where("rating < 2").select("item_id").union(items(spark, sf).where("year > 2010").select("item_id")).union(bought).distinct()


@query("WITH {T} SELECT item_id, title, false AS new FROM items UNION ALL SELECT 1000000 + vec_id, 'new ' || label, true FROM embeddings")
def combined_items(spark, sf):
    new = read_table(spark, sf, "embeddings").select((1000000 + F.col("vec_id")).alias("item_id"), F.concat(F.lit("new "), F.col("label").cast("string")).alias("title"), F.lit(True).alias("new"))
    return items(spark, sf).select("item_id", "title", F.lit(False).alias("new")).unionByName(new)


@query("""WITH t AS (SELECT DISTINCT label AS ext_id FROM embeddings UNION SELECT DISTINCT p_size FROM part) SELECT ext_id::BIGINT AS ext_id FROM t WHERE ext_id >= 0""")
def score_targets(spark, sf):
    a = read_table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("ext_id"))
    b = read_table(spark, sf, "part").select(F.col("p_size").cast("long").alias("ext_id"))
    return a.unionByName(b).where("ext_id >= 0").dropDuplicates()


@query("""SELECT count(*) AS n_rows, sum(('0x' || substr(md5(p_partkey || '|' || p_name || '|' || p_brand), 1, 15))::HUGEINT)::VARCHAR AS digest FROM part""")
def dataset_fingerprint(spark, sf):
    return core.fingerprint(read_table(spark, sf, "part"), "p_partkey", "p_name", "p_brand")


@query("""SELECT doc_id % 3 AS rater, source AS query, doc_id AS item, CASE WHEN doc_id % 4 = 0 THEN -toxic ELSE 2 * quality - toxic END AS rating
FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL AND doc_id % 3 <> 2""")
def judgment_log(spark, sf):
    """Two appended batches, the second with new ratings of a quarter of the rows; two of three raters are known."""
    rows = read_table(spark, sf, "labels").where("quality is not null and toxic is not null").join(read_table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    log = lambda rating, at: rows.select((F.col("doc_id") % 3).alias("rater"), F.col("source").alias("query"), F.col("doc_id").alias("item"), rating.alias("rating"), F.lit(at).alias("rated_at"))
    path = shared_path(spark)
    logs.append_judgments(log(2 * F.col("quality") - F.col("toxic"), 1), path)
    logs.append_judgments(log(-F.col("toxic"), 2).where("item % 4 = 0"), path)
    return logs.judgments(spark, path, rows.select(F.col("doc_id") % 3).where("`(doc_id % 3)` <> 2"))


@query("SELECT conv_id AS k, arg_max(text, turn) AS v FROM conversations GROUP BY 1")
def compact_kv_log(spark, sf):
    """A log of JSON lines, some of them cut off in the middle."""
    rows = read_table(spark, sf, "conversations")
    line = F.to_json(F.struct(F.col("conv_id").alias("k"), F.col("text").alias("v"), F.col("turn").cast("long").alias("ts")))
    path = shared_path(spark)
    cut = rows.where("turn % 3 = 0").select(F.substring(line, F.lit(1), (F.length(line) / 2).cast("int")).alias("value"))
    rows.select(line.alias("value")).unionByName(cut).write.text(path)
    return logs.compact_lines(spark, path, rows.schema["conv_id"].dataType.simpleString())


@query("""SELECT count(*) AS n, avg((2 * quality = 2 * (1 - toxic))::INT) AS exact, avg((abs(2 * quality - 2 * (1 - toxic)) <= 1)::INT) AS within_one, avg((abs(2 * quality - 2 * (1 - toxic)) >= 2)::INT) AS opposite FROM labels""")
def rater_agreement(spark, sf):
    lab = read_table(spark, sf, "labels")
    a, b = lab.select("doc_id", (2 * F.col("quality")).alias("a")), lab.select("doc_id", (2 * (1 - F.col("toxic"))).alias("b"))
    gap = F.abs(F.col("a") - F.col("b"))
    return a.join(b, "doc_id").agg(F.count("*").alias("n"), F.avg((gap == 0).cast("int")).alias("exact"), F.avg((gap <= 1).cast("int")).alias("within_one"), F.avg((gap >= 2).cast("int")).alias("opposite"))


@query("""WITH r AS (SELECT doc_id, 2 * quality AS rating, 0 AS pref FROM labels UNION ALL SELECT doc_id, 2 * (1 - toxic), 1 FROM labels) SELECT doc_id, rating FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pref) AS k FROM r) WHERE k = 1""")
def combined_ratings(spark, sf):
    lab = read_table(spark, sf, "labels")
    rows = lab.select("doc_id", (2 * F.col("quality")).alias("rating"), F.lit(0).alias("pref")).unionByName(lab.select("doc_id", (2 * (1 - F.col("toxic"))).alias("rating"), F.lit(1).alias("pref")))
    return core.latest(rows, ["doc_id"], "pref").select("doc_id", "rating")


@query("SELECT event_type AS event, count(*) AS n FROM events GROUP BY 1")
def feedback_counts(spark, sf):
    return read_table(spark, sf, "events").groupBy(F.col("event_type").alias("event")).agg(F.count("*").alias("n"))


@query("SELECT event_type AS source, count(*) / (SELECT count(*) FROM events) AS share FROM events GROUP BY 1")
def source_mix(spark, sf):
    ev = read_table(spark, sf, "events")
    total = ev.agg(F.count("*").alias("total"))  # one row
    return ev.groupBy(F.col("event_type").alias("source")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("source", (F.col("n") / F.col("total")).alias("share"))


@query("SELECT e.user_id, e.event_id, (e.props->>'k')::INTEGER AS item, p_name AS title FROM events e JOIN part ON p_partkey = (e.props->>'k')::INTEGER WHERE event_type = 'purchase'")
def log_lookup(spark, sf):
    ev = read_table(spark, sf, "events").where("event_type = 'purchase'").select("user_id", "event_id", F.get_json_object("props", "$.k").cast("int").alias("item"))
    return ev.join(items(spark, sf).select("item_id", "title"), F.col("item") == F.col("item_id")).select("user_id", "event_id", "item", "title")


@query("WITH {I} SELECT user_id, list(struct_pack(ts := timestamp, item := item_id) ORDER BY timestamp, item_id) AS history FROM inter WHERE rating >= 5 GROUP BY 1")
def user_histories(spark, sf):
    rows = interactions(spark, sf).where("rating >= 5")
    return rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(F.col("timestamp").alias("ts"), F.col("item_id").alias("item")))).alias("history"))


@query("""WITH {I}, m AS (SELECT *, CASE WHEN item_id % 7 = 0 THEN item_id - 7 ELSE item_id END AS target FROM inter)
SELECT user_id, target AS item_id, max(rating) AS rating, min(timestamp) AS timestamp FROM m GROUP BY ALL""")
def apply_remap(spark, sf):
    remap = items(spark, sf).where("item_id % 7 = 0").select(F.col("item_id").alias("source"), (F.col("item_id") - 7).alias("target"))
    rows = interactions(spark, sf).join(remap, F.col("item_id") == F.col("source"), "left").withColumn("item_id", F.coalesce("target", "item_id"))
    return core.merge_editions(rows).select("user_id", "item_id", "rating", "timestamp")


@query("""WITH {I}, {T}, p AS (SELECT item_id, count(*) FILTER (rating >= 4) AS pop FROM inter GROUP BY 1), r AS (SELECT items.item_id, first_value(items.item_id) OVER (PARTITION BY domain, title, year ORDER BY coalesce(pop, 0) DESC, items.item_id) AS target FROM items LEFT JOIN p USING (item_id))
SELECT item_id AS source, target FROM r WHERE item_id <> target""")
def edition_merge_map(spark, sf):
    pop = core.item_stats(interactions(spark, sf)).select("item_id", "popularity")
    rows = items(spark, sf).join(pop, "item_id", "left").na.fill(0, ["popularity"])
    own = W.partitionBy("domain", "title", "year").orderBy(F.desc("popularity"), "item_id")
    return rows.select(F.col("item_id").alias("source"), F.first("item_id").over(own).alias("target")).where("source <> target")


@query("""WITH {T} SELECT domain, item_id, title FROM (SELECT *, row_number() OVER (PARTITION BY domain, (year >= 1995) ORDER BY md5('audit|' || item_id), item_id) AS r FROM items) WHERE r <= 20""")
def stratified_audit_sample(spark, sf):
    rows = items(spark, sf).withColumn("stratum", F.col("year") >= 1995)
    return core.hash_sample(rows, 20, "item_id", "audit", ["domain", "stratum"]).select("domain", "item_id", "title")


@query("SELECT d.source AS stratum, avg(quality) AS precision, count(*) AS n FROM labels JOIN documents d USING (doc_id) WHERE quality IN (0, 1) GROUP BY 1")
def audit_precision(spark, sf):
    lab = read_table(spark, sf, "labels").where(F.col("quality").isin(0, 1))
    return lab.join(read_table(spark, sf, "documents").select("doc_id", "source"), "doc_id").groupBy(F.col("source").alias("stratum")).agg(F.avg("quality").alias("precision"), F.count("*").alias("n"))

