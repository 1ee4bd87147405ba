"""Streaming jobs; each takes a streaming (or static) DataFrame ``event_id, ts, user_id, event_type, value, item``."""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import core
from ..operators.publish import load_version, publish_version

from ..sources.scratch import shared_path

LATENESS = "10 minutes"
FEEDBACK = ("view", "click", "purchase", "signup")


def events(spark: SparkSession, sf_dir: str, streaming: bool = True) -> DataFrame:
    """The event log as a stream of its files, or as a table."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = spark.readStream.schema(table.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir) if streaming else table
    item = F.get_json_object("props", "$.k").cast("int")
    return rows.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", item.alias("item"))


def feedback_counts(ev: DataFrame) -> DataFrame:
    return ev.where(F.col("event_type").isin(*FEEDBACK)).groupBy("event_type").agg(F.count("*").alias("n"))


def windowed(ev: DataFrame, length: str, slide: str, *keys: str) -> tuple[DataFrame, list]:
    by = [F.window("ts", length, slide).alias("w"), *keys]
    return ev.withWatermark("ts", LATENESS), by


def request_rate(ev: DataFrame) -> DataFrame:
    rows, by = windowed(ev, "5 minutes", "1 minute", "event_type")
    return rows.groupBy(*by).agg((F.count("*") / 300.0).alias("rate")).select(F.unix_seconds("w.start").alias("start"), "event_type", "rate")


def error_rate(ev: DataFrame) -> DataFrame:
    rows, by = windowed(ev, "1 hour", "1 hour")
    return rows.groupBy(*by).agg(F.avg((F.col("event_type") == "error").cast("int")).alias("error_rate")).select(F.unix_seconds("w.start").alias("start"), "error_rate")


def latency_quantiles(ev: DataFrame) -> DataFrame:
    rows, by = windowed(ev, "6 hours", "6 hours", "event_type")
    return rows.groupBy(*by).agg(F.percentile("value", 0.5).alias("p50"), F.percentile("value", 0.95).alias("p95"), F.percentile("value", 0.99).alias("p99")).select(F.unix_seconds("w.start").alias("start"), "event_type", "p50", "p95", "p99")


def source_mix(ev: DataFrame) -> DataFrame:
    rows, by = windowed(ev, "15 minutes", "5 minutes", "event_type")
    return rows.groupBy(*by).agg(F.count("*").alias("n")).select(F.unix_seconds("w.start").alias("start"), "event_type", "n")


def feedback_rate(ev: DataFrame) -> DataFrame:
    """Feedback a second by event: clicks and purchases."""
    rows, by = windowed(ev.where(F.col("event_type").isin("click", "purchase")), "15 minutes", "5 minutes", "event_type")
    return rows.groupBy(*by).agg((F.count("*") / 900.0).alias("rate")).select(F.unix_seconds("w.start").alias("start"), "event_type", "rate")


def coldstart_unknown(ev: DataFrame, known: int) -> DataFrame:
    rows, by = windowed(ev, "1 day", "1 day")
    return rows.groupBy(*by).agg(F.count_if(F.col("event_type") == "signup").alias("cold_starts"), F.count_if(F.col("item") >= known).alias("unknown_items")).select(F.unix_seconds("w.start").alias("start"), "cold_starts", "unknown_items")


def coverage(ev: DataFrame, n_items: int) -> DataFrame:
    """Distinct served items of each window over all items; a window holds at most ``n_items`` of them."""
    rows, by = windowed(ev, "1 day", "1 day")
    return rows.groupBy(*by).agg((F.size(F.collect_set("item")) / float(n_items)).alias("coverage")).select(F.unix_seconds("w.start").alias("start"), "coverage")


#: Served items of a ring, the newest ones.
RING = 20_000


class _Ring(StatefulProcessor):
    """State of a key: its last ``size`` served items with their popularity percentiles, oldest first, as a list."""

    def __init__(self, n_items: int, size: int):
        self.n_items, self.size = n_items, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", "item int, pct double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        ring = deque(self.ring.get())
        count, total = Counter(item for item, _ in ring), sum(pct for _, pct in ring)
        coverage, mean = [], []
        for item, pct in zip(new["item"].tolist(), new["pct"].tolist()):
            ring.append((item, pct))
            count[item] += 1
            total += pct
            if len(ring) > self.size:
                item, pct = ring.popleft()
                count[item] -= 1
                total -= pct
                if not count[item]:
                    del count[item]
            coverage.append(len(count) / self.n_items)
            mean.append(total / len(ring))
        self.ring.put(list(ring))
        yield pd.DataFrame({"source": [key[0]] * len(new), "event_id": new["event_id"], "coverage": coverage, "popularity": mean})

    def close(self) -> None:
        pass


def ring_quality(served: DataFrame, popularity: DataFrame, n_items: int, size: int = RING) -> DataFrame:
    """``source, event_id, coverage, popularity`` after each served item: the share of all items among the source's last ``size``,
    and their mean popularity percentile. ``served``: source, event_id, ts, item; ``popularity``: item, pct (0 where it lacks one).

    A source's ring is its state; in a batch its items count in the order of time and id. ``metrics.ring_quality`` is the same
    over a table. The state store must be RocksDB (``with_rocksdb``).
    """
    rows = served.where("item is not null").join(popularity, "item", "left").select("source", "event_id", "ts", "item", F.coalesce("pct", F.lit(0.0)).alias("pct"))
    out = "source string, event_id long, coverage double, popularity double"
    return rows.groupBy("source").transformWithStateInPandas(_Ring(n_items, size), out, "Append", "none")


@contextmanager
def with_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB; afterwards the session is as it was."""
    name, of = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, of)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def dedupe_log(ev: DataFrame) -> DataFrame:
    return ev.withWatermark("ts", LATENESS).dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id", "event_type")


def latest_value(rows: DataFrame) -> DataFrame:
    """Latest value of each user and type; equal times go to the larger event id."""
    return rows.groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


#: Groups that users and items are dealt to by hash; each keeps the times of its own.
TTL_GROUPS = 256


def ttl_requests(ev: DataFrame, seconds: int = 300) -> DataFrame:
    """Events that aren't a repeat of the same user and item within ``seconds`` of the last one that was served: a cached
    answer lives that long. State is one time for each user and item and expires with the watermark; users and items share
    ``TTL_GROUPS`` states, so Python is called once a group and batch, not once for each of them."""

    def serve(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        users, items, lasts = state.get if state.exists else ([], [], [])
        ended = state.getCurrentWatermarkMs()
        served = {(u, i): at for u, i, at in zip(users, items, lasts) if (at + seconds) * 1000 >= ended}
        kept = []
        if not state.hasTimedOut:
            rows = pd.concat(list(batches)).sort_values(["at", "ts", "event_id"])
            for u, i, at, event in zip(rows["user"].tolist(), rows["item"].tolist(), rows["at"].tolist(), rows["event_id"].tolist()):
                last = served.get((u, i))
                if last is None or at - last >= seconds:
                    kept.append((u, i, event))
                    served[u, i] = at
        if served:
            state.update(([u for u, _ in served], [i for _, i in served], list(served.values())))
            state.setTimeoutTimestamp(max(ended, min(served.values()) * 1000) + seconds * 1000 + 1)
        elif state.exists:
            state.remove()
        if kept:
            yield pd.DataFrame(kept, columns=["user", "item", "event_id"])

    # Ids travel as text, so that an unknown user stays apart from all others.
    rows = ev.where("item is not null").withWatermark("ts", LATENESS).select(
        F.pmod(F.xxhash64("user_id", "item"), F.lit(TTL_GROUPS)).cast("int").alias("group"), F.coalesce(F.col("user_id").cast("string"), F.lit("")).alias("user"), "item", "ts", F.unix_seconds("ts").alias("at"), "event_id"
    )
    kept = rows.groupBy("group").applyInPandasWithState(serve, "user string, item int, event_id long", "users array<string>, items array<int>, lasts array<long>", "append", "EventTimeTimeout")
    return kept.select(F.nullif("user", F.lit("")).cast("long").alias("user_id"), "item", "event_id")


def publish_new_titles(landing: DataFrame, known: DataFrame, root: str, checkpoint: str, keep: int = 3) -> None:
    """Publishes a version of the new-title table for each micro-batch of landed titles, and ends when all are in.

    ``landing``: a stream of item_id, key, vector, updated. Titles whose ``key`` is in ``known`` (one column) are left out; what is
    live stays, and of rows with one item_id the latest counts. A version is named by its batch, so that a batch which runs again
    after a failure publishes once; a batch that changes nothing publishes nothing. Readers see whole versions only.
    """
    spark = landing.sparkSession
    names = known.toDF("key").distinct()

    def publish(batch: DataFrame, number: int) -> None:
        fresh = batch.join(names, "key", "left_anti")
        if fresh.isEmpty():
            return
        live = load_version(spark, root)
        rows = fresh if live is None else live.unionByName(fresh)
        publish_version(core.latest(rows, ["item_id"], F.desc("updated"), "key").select(*batch.columns), root, version=f"batch-{number:010d}", keep=keep)

    query = landing.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def replay(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all that is there and gives its result: what ``complete`` last wrote, or all that was appended."""
    spark = stream.sparkSession
    out, check = shared_path(spark), shared_path(spark)

    def write(batch: DataFrame, number: int) -> None:
        # A batch that is run again after a failure replaces its own folder: each batch counts once.
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination()
    done = spark.read.schema(stream.schema).parquet(out)
    return done.select(*stream.columns)
