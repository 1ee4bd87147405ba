"""Streaming jobs, replayed over the event log; SQL says what the whole log gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics
from ..operators.publish import load_version
from ..sources.scratch import materialise, shared_path
from ..sources.tables import read_table
from ..streaming import jobs
from .registry import query

_WIN = "SELECT s AS start, event_type, {agg} FROM events, unnest(range({n})) t(k), LATERAL (SELECT (floor(epoch(ts) / {slide})::BIGINT - k) * {slide} AS s) GROUP BY 1, 2"


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('view', 'click', 'purchase', 'signup') GROUP BY 1")
def stream_feedback_counts(spark, sf):
    return jobs.replay(jobs.feedback_counts(jobs.events(spark, sf)), "complete")


@query(_WIN.format(agg="count(*) / 300.0::DOUBLE AS rate", n=5, slide=60))
def stream_request_rate(spark, sf):
    return jobs.replay(jobs.request_rate(jobs.events(spark, sf)), "complete")


@query("SELECT (floor(epoch(ts) / 3600) * 3600)::BIGINT AS start, avg((event_type = 'error')::INT) AS error_rate FROM events GROUP BY 1")
def stream_error_rate(spark, sf):
    return jobs.replay(jobs.error_rate(jobs.events(spark, sf)), "complete")


@query("SELECT (floor(epoch(ts) / 21600) * 21600)::BIGINT AS start, event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99 FROM events GROUP BY 1, 2")
def stream_latency_quantiles(spark, sf):
    return jobs.replay(jobs.latency_quantiles(jobs.events(spark, sf)), "complete")


@query(_WIN.format(agg="count(*) AS n", n=3, slide=300))
def stream_source_mix(spark, sf):
    return jobs.replay(jobs.source_mix(jobs.events(spark, sf)), "complete")


@query(_WIN.format(agg="count(*) AS n", n=3, slide=300).replace("event_type,", "user_id % 2 = 0 AS mode,"))
def stream_recs_by_mode(spark, sf):
    ev = jobs.events(spark, sf).withColumn("mode", F.col("user_id") % 2 == 0)
    rows, by = jobs.windowed(ev, "15 minutes", "5 minutes", "mode")
    return jobs.replay(rows.groupBy(*by).agg(F.count("*").alias("n")).select(F.unix_seconds("w.start").alias("start"), "mode", "n"), "complete")


@query("SELECT (floor(epoch(ts) / 86400) * 86400)::BIGINT AS start, count(*) FILTER (event_type = 'signup') AS cold_starts, count(*) FILTER ((props->>'k')::INTEGER >= 90) AS unknown_items FROM events GROUP BY 1")
def stream_coldstart_unknown(spark, sf):
    return jobs.replay(jobs.coldstart_unknown(jobs.events(spark, sf), 90), "complete")


@query("SELECT (floor(epoch(ts) / 86400) * 86400)::BIGINT AS start, count(DISTINCT (props->>'k')::INTEGER) / 100.0::DOUBLE AS coverage FROM events GROUP BY 1")
def stream_coverage(spark, sf):
    return jobs.replay(jobs.coverage(jobs.events(spark, sf), 100), "complete")


_RING = """WITH e AS (SELECT event_type AS source, event_id, ts, (props->>'k')::INTEGER AS item FROM events), pop AS (SELECT item, count(*) AS n FROM e WHERE item IS NOT NULL GROUP BY 1),
pct AS (SELECT item, (row_number() OVER (ORDER BY n, item) - 1) / (SELECT count(*) FROM pop)::DOUBLE AS pct FROM pop)
SELECT source, event_id, round(count(DISTINCT item) OVER w / 100.0::DOUBLE, 9) AS coverage, round(avg(pct) OVER w, 9) AS popularity FROM e JOIN pct USING (item)
WINDOW w AS (PARTITION BY source ORDER BY ts, event_id ROWS BETWEEN 19999 PRECEDING AND CURRENT ROW)"""


def _percentiles(spark, sf):
    """``item, pct``: the share of items that are served less often; as many rows as there are items."""
    pop = jobs.events(spark, sf, streaming=False).where("item is not null").groupBy("item").agg(F.count("*").alias("n"))
    return materialise(pop.select("item", (F.expr("(row_number() OVER (ORDER BY n, item) - 1)") / pop.count()).alias("pct")))


def _rounded(rows):
    return rows.select("source", "event_id", F.round("coverage", 9).alias("coverage"), F.round("popularity", 9).alias("popularity"))


@query(_RING)
def stream_ring_quality(spark, sf):
    """After each served item: coverage and mean popularity percentile of the source's last 20,000, from a stream's state."""
    served = jobs.events(spark, sf).withColumnRenamed("event_type", "source")
    with jobs.with_rocksdb(spark):
        return _rounded(jobs.replay(jobs.ring_quality(served, _percentiles(spark, sf), 100), "append"))


@query(_RING)
def ring_quality(spark, sf):
    """The same from the table of events."""
    return _rounded(metrics.ring_quality(jobs.events(spark, sf, streaming=False).withColumnRenamed("event_type", "source"), _percentiles(spark, sf), 100))


@query("SELECT DISTINCT event_id, user_id, event_type FROM events")
def stream_dedupe_log(spark, sf):
    return jobs.replay(jobs.dedupe_log(jobs.events(spark, sf)), "append")


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def stream_latest_rating(spark, sf):
    return jobs.replay(jobs.latest_value(jobs.events(spark, sf)), "complete")


@query()
def recommendation_ttl(spark, sf):
    return jobs.replay(jobs.ttl_requests(jobs.events(spark, sf)), "append")


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'")
def recommendation_log(spark, sf):
    ev = jobs.events(spark, sf).where("event_type = 'purchase'").select("event_id", "user_id", "value")
    return jobs.replay(ev, "append")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('view', 'click', 'purchase', 'signup')")
def feedback_log(spark, sf):
    ev = jobs.events(spark, sf).where(F.col("event_type").isin(*jobs.FEEDBACK)).select("event_id", "user_id", "event_type")
    return jobs.replay(ev, "append")


@query("SELECT count(*) AS n_events, count(DISTINCT (props->>'k')::INTEGER) AS n_items, quantile_cont(value, 0.95) AS p95 FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 2000)")
def rolling_quality(spark, sf):
    last = jobs.events(spark, sf, streaming=False).orderBy(F.desc("ts"), F.desc("event_id")).limit(2000)
    return last.agg(F.count("*").alias("n_events"), F.countDistinct("item").alias("n_items"), F.percentile("value", 0.95).alias("p95"))


@query("SELECT p_partkey AS item_id, p_name AS title, p_size AS updated FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_partkey % 25 = 0)")
def stream_new_titles(spark, sf):
    """Titles that land as JSON files, several batches of them, without those that the catalogue knows: here by maker. Each batch
    publishes a version; the result is the live one."""
    landing, root, checkpoint = shared_path(spark), shared_path(spark), shared_path(spark)
    part = read_table(spark, sf, "part")
    rows = part.select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("key"), F.col("p_name").alias("title"), F.col("p_size").cast("long").alias("updated"))
    rows.repartition(4, "item_id").write.json(landing)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).json(landing)
    jobs.publish_new_titles(stream, part.where("p_partkey % 25 = 0").select("p_brand"), root, checkpoint)
    live = load_version(spark, root)
    return (rows.limit(0) if live is None else live).select("item_id", "title", "updated")


@query(_WIN.format(agg="count(*) / 900.0 AS rate", n=3, slide=300) + " HAVING event_type IN ('click', 'purchase')")
def stream_feedback_rate(spark, sf):
    return jobs.replay(jobs.feedback_rate(jobs.events(spark, sf)), "complete")
