"""States, joins and windows that grow with the rows alone, against plain Python."""

import random
import threading
import time

import numpy as np
from pyspark.sql import functions as F
from weftline.functions import text as T
from weftline.operators import franchise, metrics, models, ranking, two_tower, works
from weftline.plans import QUERIES
from weftline.sources.scratch import shared_path, shuffles_deleted
from weftline.streaming import jobs


def test_ttl_state_is_a_row_a_group(spark):
    """Thousands of users and items over three batches, one of them unknown: answers as from a loop, states one a group."""
    rng = random.Random(3)
    log = [(k, rng.choice([*range(1_000), None]), rng.randrange(3), 1_000 + k // 4) for k in range(3_000)]
    kind, landing, out, check = "event_id long, user_id long, item int, at long", *(shared_path(spark) for _ in range(3))
    for k in range(0, 3_000, 1_000):
        spark.createDataFrame(log[k : k + 1_000], kind).coalesce(1).write.mode("append").json(landing)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(landing).withColumn("ts", F.timestamp_seconds("at")).drop("at")
    q = jobs.ttl_requests(stream, 100).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination()
    last, want = {}, set()
    for event, user, item, at in log:
        if at - last.get((user, item), 0) >= 100:
            want.add((user, item, event))
            last[user, item] = at
    assert {tuple(r) for r in spark.read.parquet(out).collect()} == want
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= jobs.TTL_GROUPS


def test_rings_are_running_sums(spark):
    """No frame of the ring's length is added up at each row."""
    served = spark.createDataFrame([("a", 1, 1), ("a", 2, 2)], "source string, event_id long, item int").withColumn("ts", F.timestamp_seconds("event_id"))
    plan = metrics.ring_quality(served, spark.createDataFrame([(1, 0.5)], "item int, pct double"), 2, 7)._jdf.queryExecution().optimizedPlan().toString()
    assert "-6" not in plan and "unboundedpreceding" in plan


def test_themes_look_for_each_pattern_once(spark):
    lexicon = {"sea": "sea|ship", "war": "war", "love": "love", "epic": "epic"}
    texts = ["a ship at sea, a war", "love and love and epic epic", "epic epic epic war", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").coalesce(1)
    out = df.select("id", T.item_themes(F.array(F.lit("Love")), F.col("t"), lexicon, ["epic"]).alias("themes"))
    assert {r.id: r.themes for r in out.collect()} == {0: ["love", "sea", "war"], 1: ["love"], 2: ["love", "epic", "war"], 3: ["love"], 4: ["love"]}
    plan = out._jdf.queryExecution().optimizedPlan().toString()  # one search in the text and one in the label, at most
    assert len(lexicon) <= plan.count("regexp_extract_all") <= 2 * len(lexicon)


def test_sources_of_one_title(spark):
    """Titles that many rows share, with and without years, like a loop over all pairs; no pair of years is compared."""
    rng = random.Random(5)
    kind = "item_id string, domain string, kind string, title string, year int, genres array<string>"
    year = lambda: rng.choice([None, *range(1990, 2000)])
    rows = [(f"r{i:03}", "movie", rng.choice(["tv", "movie"]), rng.choice(["Tin", "Kite"]), year(), []) for i in range(12)]
    more = [(f"m{i:03}", "movie", rng.choice(["tv", "movie"]), "x", year(), ["Anime"], rng.sample(["Tin", "Kite", "Oar"], 2)) for i in range(60)]
    out = works.merge_sources(spark.createDataFrame(rows, kind), spark.createDataFrame(more, kind + ", names array<string>"))
    tagged, rest = set(), set()
    for m in more:
        fit = [r[0] for r in rows if r[2] == m[2] and r[3] in m[6] and (r[4] is None or m[4] is None or abs(r[4] - m[4]) <= 1)]
        (tagged if fit else rest).add(min(fit) if fit else m[0])
    got = {r.item_id: r.genres for r in out.collect()}
    assert {i for i, g in got.items() if i[0] == "r" and g == ["Anime"]} == tagged and {i for i in got if i[0] == "m"} == rest
    assert "abs(" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_lists_without_repeated_works_are_dealt_once(spark, small):
    plan = QUERIES["dedupe_works"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(user_id") == 2 and "REPARTITION_BY_NUM" in plan  # the one of interactions, and that of all windows


def test_terms_are_counted_where_documents_lie(spark):
    """Two documents with one id count as one; null and empty texts have no terms."""
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, None), (1, ["b", "c"]), (4, ["a"])], "doc_id int, w array<string>")
    told = lambda rows: {r.id: dict(zip(r.terms, r.counts)) for r in rows.collect()}
    assert told(models.counted_terms(df, F.col("w"))) == {1: {"a": 2, "b": 2, "c": 1}, 2: {}, 3: {}, 4: {"a": 1}}
    assert told(models.counted_terms(df.where("doc_id <> 1"), F.col("w"))) == {2: {}, 3: {}, 4: {"a": 1}}


def test_best_of_a_first_block_without_sorting_it(monkeypatch):
    """Numbers that can't be among the k best are neither sorted nor rounded, in the first block either; ties go to smaller ids."""
    monkeypatch.setattr(models, "_best", None)
    rng = np.random.default_rng(3)
    for kind in (float, np.float32):
        u, x = rng.integers(-3, 4, (50, 4)).astype(kind), rng.integers(-3, 4, (900, 4)).astype(kind)
        running, names = models._Running(np.arange(50), u, 7), rng.permutation(900)
        for part in np.array_split(np.arange(900), [5, 400]):  # a block of fewer than k
            running.meet(names[part], x[part])
        s = u @ x.T
        want = [np.lexsort((names, -s[i]))[:7] for i in range(50)]
        out = running.table()
        assert out.column("item_id").to_pylist() == [int(names[j]) for w in want for j in w]
        assert out.column("score").to_pylist() == [float(s[i, j]) for i, w in enumerate(want) for j in w]


def test_factor_shuffles_are_deleted_early(spark, monkeypatch):
    """Factors are written each round, and files of a shuffle that nothing refers to are gone inside ``shuffles_deleted``."""
    seen = []
    monkeypatch.setattr(models.ALS, "fit", lambda self, df: seen.append(self.getCheckpointInterval()))
    models.als(spark.createDataFrame([(1, 2)], "user_id long, item_id long"))
    assert seen == [1]
    asked = []
    with shuffles_deleted(spark, 0.05):
        spark.range(100).repartition(3).count()
        time.sleep(0.5)
        asked = [t.is_alive() for t in threading.enumerate() if "collect" in t.name]
    assert asked == [True] and not any("collect" in t.name for t in threading.enumerate())


def test_two_tower_keeps_few_tables(spark):
    """More parts than cores learn in turns; of all that epochs write only the law's and the last items stay, and users come as vectors."""
    from pathlib import Path

    history = [(u, i, "movie" if i % 2 else "game", i, 1.0) for u in range(40) for i in range(u % 5, 30, 5)]
    df = spark.createDataFrame(history, "user_id long, item_id long, domain string, timestamp long, weight double")
    it = spark.createDataFrame([(i, "movie" if i % 2 else "game", [1.0]) for i in range(30)], "item_id long, domain string, x array<double>")
    folder = Path(shared_path(spark).removeprefix("file:")).parent
    before = set(folder.glob("weftline-*"))
    model = two_tower.fit(df, it, dims=4, epochs=2, batch=4, part_examples=4)
    assert len(set(folder.glob("weftline-*")) - before) == 3  # two of the law
    assert len(model.losses) == 2 and model.losses[1] < model.losses[0] and model.users(df, model.vectors()).columns == ["user_id", "v"]


def test_fusion_deals_rows_once(spark):
    """The same as fused ranks of the union of candidates, with one exchange."""
    rng = random.Random(9)
    rows = [(u, i, s, float(rng.randint(0, 6))) for u in range(6) for s in ("a", "b") for i in rng.sample(range(60), 40)]
    scores = spark.createDataFrame(rows, "user_id long, item_id long, source string, score double")
    seen = spark.createDataFrame([(u, i) for u in range(5) for i in rng.sample(range(60), 20)], "user_id long, item_id long")
    told = lambda df: {(r.user_id, r.item_id): (tuple(r.sources), r.score) for r in df.collect()}
    want = told(ranking.rrf(ranking.candidates(scores, seen, 9, {"b": 4}), ranking.source_ranks(scores), ["a", "b"]))
    out = ranking.fused(scores, seen, ["a", "b"], 9, {"b": 4})
    assert told(out) == want and len(want) > 60
    assert out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1


def test_neighbours_of_wanted_items(spark):
    """Those of all, kept for the wanted, and pairs are made for these alone."""
    rng = random.Random(4)
    likes = spark.createDataFrame([(u, i) for u in range(40) for i in rng.sample(range(25), 8)], "user_id long, item_id long")
    wanted = spark.createDataFrame([(3,), (7,), (7,), (99,)], "item_id long")
    told = lambda df: {(r.i, r.j): (r.sim, r["rank"]) for r in df.collect()}
    want = {k: v for k, v in told(models.item_knn(likes)).items() if k[0] in (3, 7)}
    assert told(models.item_knn(likes, wanted=wanted)) == want and len(want) > 20


def test_equal_names_are_cut_into_slices(spark, monkeypatch):
    """A name that many share meets itself in several tasks; titles without a name or medium have no links."""
    monkeypatch.setattr(franchise, "SLICE", 2)
    rows = [(i, [True, False, None][i % 3], [None, "a", "a", "b"][i % 4]) for i in range(48)]
    out = franchise.equal_names(spark.createDataFrame(rows, "item_id long, game boolean, name string"))
    want = sorted((x[0], y[0]) for x in rows for y in rows if x[2] and x[2] == y[2] and {x[1], y[1]} == {True, False})
    assert sorted((r.src, r.dst) for r in out.collect()) == want
