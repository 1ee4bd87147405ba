"""Products by blocks, lists by streams of rows, and plans that don't grow with repeated titles."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from weftline.functions import text as T
from weftline.operators import models, ranking
from weftline.plans import QUERIES
from weftline.sources.scratch import materialise


def test_profile_vectors_are_decayed_sums(spark):
    """Whole vectors, of unlike lengths and with nulls, give what their single numbers give; nothing is exploded on the way."""
    history = spark.createDataFrame([(1, 10, 3, 1.0), (1, 11, 2, -1.0), (2, 12, 1, 0.75), (3, 13, 1, 1.0)], "user_id long, item_id long, timestamp long, weight double")
    vectors = spark.createDataFrame([(10, [1.0, 2.0, 0.0]), (11, [0.5, 0.0, 1.0]), (12, [3.0, None])], "item_id long, v array<double>")
    got = {r.user_id: r.v for r in models.profile_vectors(history, vectors).collect()}
    want = np.array([1.0, 2.0, 0.0]) - 0.5 ** (1 / 20) * np.array([0.5, 0.0, 1.0])
    assert np.allclose(got[1], want / np.linalg.norm(want)) and got[2] == [1.0, None] and set(got) == {1, 2}
    plan = models.profile_vectors(history, vectors)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def test_a_task_keeps_k_items_of_each_user_over_all_blocks(spark, monkeypatch):
    """What is passed on doesn't grow with the blocks of items: one list a user and run of blocks."""
    monkeypatch.setattr(models, "BLOCK_ITEMS", 8)
    monkeypatch.setattr(models, "RUN", 1_000)
    rng = np.random.default_rng(1)
    u, x = rng.standard_normal((5_000, 4)), rng.standard_normal((200, 4))
    users = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(u)], "user_id long, v array<double>")
    vectors = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "item_id long, v array<double>")
    seen, kept = models.blockwise, []
    monkeypatch.setattr(models, "blockwise", lambda *a: kept.append(seen(*a)) or kept[-1])
    got = {(r.user_id, r["rank"]): r.item_id for r in models.best_by_vector(users, vectors, 3).collect()}
    want = np.argsort(-np.round(u @ x.T, 9), axis=1, kind="stable")[:, :3]
    assert got == {(k, r + 1): int(want[k, r]) for k in range(5_000) for r in range(3)}
    cores = spark.sparkContext.defaultParallelism
    assert kept[0].count() <= 5_000 * 3 * max(1, cores // 4)  # 25 blocks


def test_families_first_then_others_then_unknown(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.9, 0.0], 2), (2, [0.1, 0.0], 1), (3, [0.5, 0.0], None), (4, [0.9, 0.0], 2)]
    v = spark.createDataFrame(rows, "id long, v array<double>, label long")
    got = [(r.item_id, r["rank"]) for r in models.best_of_family(v.where("id = 0"), v, 4).orderBy("rank").collect()]
    assert got == [(2, 1), (1, 2), (4, 3), (3, 4)]
    assert [r.item_id for r in models.best_of_family(v.where("id = 3"), v, 2).orderBy("rank").collect()] == [0, 1]


def test_factors_are_checkpointed(spark, monkeypatch):
    """Shuffles of earlier rounds can go while the factors are still learned."""
    made = []
    monkeypatch.setattr(models, "ALS", lambda **of: made.append(of) or type("Fit", (), {"fit": lambda self, rows: rows})())
    models.als(spark.createDataFrame([(1, 2)], "user_id long, item_id long"))
    assert made[0]["checkpointInterval"] == 2


def test_compressed_tables_are_not_broadcast_by_their_files(spark):
    """Fifty popular items of each user: a file of a few MB, some hundred MB of rows."""
    rows = spark.range(3_000_000).select((F.col("id") / 50).cast("long").alias("user_id"), (F.col("id") % 50).alias("item_id"), F.lit("popularity").alias("source"))
    rows = materialise(rows)
    size = rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert int(str(size)) > 10 << 20
    joined = rows.join(rows.withColumnRenamed("source", "other"), ["user_id", "item_id"])
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().sparkPlan().toString()


def test_equal_titles_are_cleaned_once(spark):
    """Rows with equal keys, nulls too, share what is worked out, and rounds that change nothing are left out."""
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "b")], "id long, t string")
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(t):
        calls.add(1)
        return f"{t}!"

    assert {(r.id, r.x) for r in T.once(rows, ["t"], x=told("t")).collect()} == {(1, "a!"), (2, "a!"), (3, "None!"), (4, "b!")}
    assert calls.value == 3
    got = rows.select("id", T.settled(F.col("t"), 4, lambda t: F.when(F.length(t) < 3, F.concat(t, F.lit("x"))).otherwise(t)).alias("t")).collect()
    assert {(r.id, r.t) for r in got} == {(1, "axx"), (2, "axx"), (3, None), (4, "bxx")}


def test_prefix_search_explodes_titles_once(spark, small):
    """Items that share a title share its prefixes: what is exploded grows with titles."""
    plan = QUERIES["prefix_search"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert all("p_partkey" not in line for line in plan.splitlines() if "Generate" in line)


@pytest.mark.parametrize("size", [1, 3, 10_000])
def test_lists_of_many_pools_like_a_loop(spark, size):
    """Pools that begin in one batch and end in another, unlike sizes, rows without vectors or makers."""
    rng = np.random.default_rng(5)
    rows = [(u, i, float(rng.random()), [None, "", "a", "b"][int(rng.integers(4))], rng.standard_normal(3).tolist() if rng.random() < 0.7 else None) for u in range(12) for i in range(1 + 5 * (u % 4))]
    df = spark.createDataFrame(rows, "user_id long, item_id long, score double, creator string, v array<double>")
    key, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(key, str(size))
    got = {(r.user_id, r["rank"]): r.item_id for r in ranking.mmr(df, 4).collect()}
    spark.conf.set(key, before)
    want = {}
    for u in range(12):
        pool = sorted((r for r in rows if r[0] == u), key=lambda r: (-r[2], r[1]))
        s = np.array([r[2] for r in pool])
        rel, v = (s - s.min()) / (s.max() - s.min() + 1e-9), [np.array(r[4] or [0.0] * 3) for r in pool]
        v, taken = [x / max(np.linalg.norm(x), 1e-12) for x in v], []
        while len(taken) < min(4, len(pool)):
            value = [-np.inf if i in taken else rel[i] - 0.15 * max((v[i] @ v[j] for j in taken), default=0) - 0.05 * sum(bool(pool[j][3]) and pool[j][3] == pool[i][3] for j in taken) for i in range(len(pool))]
            taken.append(int(np.argmax(value)))
            want[u, len(taken)] = pool[taken[-1]][1]
    assert got == want
