"""Queries that do their whole job: no sample, no cap, no narrower rule."""

import difflib
import hashlib
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from weftline.operators import core, features, matching, metrics, models, ranking, two_tower
from weftline.plans import QUERIES, retrieval
from weftline.sources.scratch import materialise, shared_path
from weftline.sources.tables import interactions


def test_ranker_data_hold_every_candidate(spark, small):
    """All candidates of a query that has a hit, not sixty of those without one."""
    parts = core.chronological_split(interactions(spark, small))
    train, hits = parts.where("part = 'train'"), core.positives(parts.where("part = 'val'")).select("user_id", "item_id")
    cands = materialise(ranking.candidates(retrieval._sources_of(train), train).select("user_id", "item_id"))
    want = cands.join(cands.join(hits, ["user_id", "item_id"]).select("user_id").distinct(), "user_id")
    rows = materialise(QUERIES["rank_dataset"](spark, small))
    told = {(r.user_id, r.item_id): r.label for r in rows.collect()}
    assert set(told) == {tuple(r) for r in want.select("user_id", "item_id").collect()}
    assert {k for k, label in told.items() if label} == {tuple(r) for r in cands.join(hits, ["user_id", "item_id"]).select("user_id", "item_id").collect()}
    assert rows.where("label = 0").groupBy("user_id").count().agg(F.max("count")).first()[0] > 60


def test_resamples_have_as_many_draws_as_rows(spark, monkeypatch):
    """Draw i of resample b takes row md5(task|b|i) mod n in the order of the users, in whatever blocks and calls."""
    rng = random.Random(4)
    rows = [(t, u, None if rng.random() < 0.1 else rng.gauss(0.1, 1.0), 1.0) for t, n in (("a", 37), ("b", 1), ("c|d", 90)) for u in rng.sample(range(1_000), n)]
    monkeypatch.setattr(metrics, "BLOCK_ROWS", 16)
    monkeypatch.setattr(metrics, "CALL_DRAWS", 1_000)
    monkeypatch.setattr(metrics, "TEXTS", 20)
    got = {r.task: (r.low, r.high) for r in metrics.paired_bootstrap(spark.createDataFrame(rows, "task string, user_id long, diff double, base double"), 60).collect()}
    for task in ("a", "b", "c|d"):
        own = [r[2] for r in sorted(r for r in rows if r[0] == task)]
        means = []
        for b in range(60):
            at = [int(hashlib.md5(f"{task}|{b}|{i}".encode()).hexdigest()[:12], 16) % len(own) for i in range(len(own))]
            drawn = [own[i] for i in at if own[i] is not None]
            means += [sum(drawn) / len(drawn)] if drawn else []
        assert got[task] == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])))


def test_every_name_of_a_block_is_compared(spark, monkeypatch):
    """A block larger than any shortlist: the alike name has the fewest votes; and all pairs of a block against a loop."""
    many = spark.range(1_500).select(F.col("id").alias("ext_id"), F.lit("movie").alias("kind"), F.concat(F.lit("harbour "), F.md5(F.col("id").cast("string"))).alias("title"), F.lit(None).cast("string").alias("original_title"), F.lit(1990).alias("year"), (F.col("id") + 10).alias("votes"))
    lone = spark.createDataFrame([(9_999, "movie", "harbour of the quiet lanterns", None, 1990, 0)], many.schema)
    items = spark.createDataFrame([(1, "Harbour of the quiet lantern", 1990, None), (2, "Harbour of the quiet lantern", 1990, None)], "item_id long, title string, year int, tv_hint boolean")
    assert {(r.item_id, r.ext_id) for r in matching.match_films(items, many.unionByName(lone)).collect()} == {(1, 9_999), (2, 9_999)}
    monkeypatch.setattr(matching, "SLICE", 30)
    monkeypatch.setattr(matching, "STEP", 7)
    rng = random.Random(8)
    words = ["harbour", "harbours", "harbourś", "lanterns", "lantern", "of", "tin", "tins", "x" * 300]
    left, right = ({" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(200)} for _ in range(2))
    blocks = lambda t: {w[:4] for w in t.split() if len(w) >= 3}
    want = {(a, b, cap) for a in left for b in right for cap in (1.0, 0.95) if blocks(a) & blocks(b) and cap * (1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio()) >= matching.MATCH}
    got = matching.similar_keys(spark.createDataFrame([(a,) for a in left], "key string"), spark.createDataFrame([(b, cap) for b in right for cap in (1.0, 0.95)], "name string, cap double")).collect()
    assert {(r.key, r.name, r.cap) for r in got} == want and len(got) == len(want) > 300


def test_parts_stream_their_items(spark, monkeypatch):
    """Items come a batch at a time and go out so, in files between; turns don't change what is learned."""
    monkeypatch.setattr(two_tower, "TOLD", 16)
    history = [(u, i, "movie" if i % 2 else "game", i, 1.0) for u in range(40) for i in range(u % 5, 60, 5)]
    df = spark.createDataFrame(history, "user_id long, item_id long, domain string, timestamp long, weight double")
    it = spark.createDataFrame([(i, "movie" if i % 2 else "game", [1.0, float(i % 3)] if i % 4 else None) for i in range(60)], "item_id long, domain string, x array<double>")
    learned = []
    for turn in (1, 3_000_000):
        monkeypatch.setattr(two_tower, "TURN_ITEMS", turn)
        learned.append({r.item_id: r.v + [r.b] for r in two_tower.fit(df, it, dims=4, epochs=2, batch=4, part_examples=12).vectors().collect()})
    assert all(np.allclose(learned[0][i], learned[1][i], rtol=1e-4, atol=1e-6) for i in range(60))
    single = lambda n: pa.array([[0.1 * k, 0.2] for k in range(n)], pa.list_(pa.float32()))
    context = pa.struct([("item_id", pa.int64()), ("a", pa.float64())])
    nothing = {"target": pa.nulls(40, pa.int64()), "context": pa.nulls(40, pa.list_(context)), "negatives": pa.nulls(40, pa.list_(pa.int64()))}
    items = pa.RecordBatch.from_pydict({"part": np.zeros(40, np.int32), "item_id": np.arange(40), "domain": ["movie"] * 40, "x": pa.array([[1.0]] + [None] * 39, pa.list_(pa.float32())), "e": single(40), "ge": single(40), "b": np.zeros(40), "gb": np.ones(40), **nothing})
    one = pa.RecordBatch.from_pydict({"part": np.zeros(1, np.int32), "target": [3], "context": pa.array([[{"item_id": 5, "a": 1.0}]], pa.list_(context)), "negatives": [[7, 8]]})
    state = (np.ones((2, 1, 2)), np.zeros((2, 2)), np.ones((2, 1, 2)), np.ones((2, 2)))
    told = list(two_tower._learner(state, 0.05, 4)(iter([items.slice(0, 7), items.slice(7), one])))
    assert [b.num_rows for b in told] == [16, 16, 8, 5] and told[-1].column("gb").to_pylist()[-1] == 1.0
    e = np.concatenate([b.column("e").flatten().to_numpy().reshape(-1, 2) for b in told[:-1]])
    assert set(np.flatnonzero((e != single(40).flatten().to_numpy().reshape(-1, 2)).any(1))) == {3, 5, 7, 8}


def test_features_are_dealt_by_user(spark, small):
    """What is known of candidates is written in steps, whose shuffles and tables go; what is read in the end is one table."""
    folder = Path(shared_path(spark).removeprefix("file:")).parent
    inter = materialise(interactions(spark, small))
    scores, of = materialise(retrieval._sources_of(inter)), retrieval._history_inputs(spark, small, inter)
    before = set(folder.glob("weftline-*"))
    rows = features.features(ranking.candidates(scores, inter), scores, retrieval.SOURCES, **of)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert len(set(folder.glob("weftline-*")) - before) == 1 and rows.count() == ranking.candidates(scores, inter).count()


def test_batch_counts_pairs_once(spark, small, monkeypatch):
    """Pairs liked together are made once for training histories' neighbours, once for their features, and once for all the rest."""
    made, real = [], retrieval.models.cooccurrence
    monkeypatch.setattr(retrieval.models, "cooccurrence", lambda *of, **by: made.append(1) or real(*of, **by))
    assert QUERIES["recommend_batch"](spark, small).columns == ["user_id", "item_id", "domain", "rank", "anchor", "liked_together"] and len(made) == 3


def test_factors_have_blocks_by_likes(spark, monkeypatch):
    made = []
    monkeypatch.setattr(models, "ALS", lambda **of: made.append(of) or type("Fit", (), {"fit": lambda self, rows: rows})())
    monkeypatch.setattr(models, "ALS_LIKES", 20)
    for n in (5, 1_000):
        models.als(spark.range(n).select(F.col("id").alias("user_id"), F.col("id").alias("item_id")))
    assert [(m["numUserBlocks"], m["numItemBlocks"]) for m in made] == [(10, 10), (50, 50)]
