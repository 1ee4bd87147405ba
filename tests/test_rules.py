"""Rules that the tables of the test data don't reach by themselves."""

import pytest
from pyspark.sql import functions as F
from weftline.functions import kinds
from weftline.operators import core, logs, models, ranking, tasks


def test_kinds(spark):
    rows = [("movie", None, "Some Series", ""), ("movie", "movie", "Season 3", ""), ("movie", None, "Plain", "x" * 1500 + " season episode sitcom"), ("movie", None, "Plain", "A season, an episode; one sitcom"), ("game", "tv", "Season", None), ("movie", None, None, None)]
    df = spark.createDataFrame(rows, "domain string, external string, title string, text string")
    cols = [F.col(c) for c in ("domain", "external", "title", "text")]
    assert [r[0] for r in df.select(kinds.item_kind(*cols)).collect()] == ["tv", "movie", "movie", "tv", "game", "movie"]
    goods = [("game", "Poster", "", True, True), ("game", "Poster + Game", "", True, False), ("game", "The Art Book", "", False, True), ("game", "The Art Book", "", True, False), ("game", "Odd", "new in hardcover", False, True), ("movie", "Poster", "", False, False), ("game", None, None, None, False)]
    df = spark.createDataFrame(goods, "domain string, title string, text string, matched boolean, want boolean")
    assert df.where(kinds.ineligible(*[F.col(c) for c in ("domain", "title", "text", "matched")]) != F.col("want")).isEmpty()


def test_contracts_name_missing_columns(spark):
    df = spark.createDataFrame([(1, 2)], "user_id int, item_id int")
    assert [tuple(r) for r in core.contract_interactions(df, df).collect()] == [("required_columns", 3)]
    assert [tuple(r) for r in core.contract_items(df).collect()] == [("required_columns", 4)]


def test_year_suffix(spark):
    rows = [(1, "game", "Rush", 1999), (2, "game", "rush", 2005), (3, "game", "Rush (2005)", 2006), (4, "game", "rush (2005)", 2007), (5, "movie", "Rush", 2013)]
    got = core.year_suffix(spark.createDataFrame(rows, "item_id int, domain string, title string, year int")).orderBy("item_id").collect()
    assert [r.title for r in got] == ["Rush (1999)", "rush (2005)", "Rush (2005)", "rush (2005)", "Rush"]


def test_judgments_and_lines(spark, tmp_path):
    log = lambda rating, at: spark.createDataFrame([("a", "q", 1, rating, at), ("b", "q", 1, 0, at)], "rater string, query string, item int, rating int, rated_at int")
    path = f"{tmp_path}/log"
    logs.append_judgments(log(2, 1), path)
    logs.append_judgments(log(-1, 2), path)
    with pytest.raises(ValueError):
        logs.append_judgments(log(3, 3), path)
    assert [tuple(r) for r in logs.judgments(spark, path, spark.createDataFrame([("a",)], "x string")).collect()] == [("a", "q", 1, -1)]
    (tmp_path / "kv.json").write_text('{"k": "a", "v": "old", "ts": 1}\n{"k": "a", "v": "new", "ts": 2}\n{"k": "a", "v": "cut", "t')
    assert [tuple(r) for r in logs.compact_lines(spark, f"{tmp_path}/kv.json").collect()] == [("a", "new")]


def test_routes_and_quotas(spark):
    rows = [(u, i, float(-i if u < 20 else i), int(i == (5 if u < 20 else 0)), 0.0 if u < 20 else float(i % 2)) for u in range(40) for i in range(6)]
    routed = ranking.routed(spark.createDataFrame(rows, "user_id int, item_id int, score double, label int, n_hist_same double"))
    assert {(r.user_id < 20, r.route) for r in routed.collect()} == {(True, "cross"), (False, "main")}
    first = ranking.routed_rank(routed, ["score"], 1).collect()
    # Each route learns its own direction of the same feature.
    assert {(r.user_id < 20, r.item_id) for r in first} == {(True, 5), (False, 0)}
    pool = [(1, i, "movie" if i < 8 else "game", 1.0 - i / 20, "", [1.0, 0.0] if i % 3 else None) for i in range(12)]
    lists = ranking.quota_lists(spark.createDataFrame(pool, "user_id int, item_id int, domain string, score double, creator string, v array<double>"), spark.createDataFrame([(1, 0.9)], "user_id int, movie_share double"), 10).collect()
    assert len(lists) == 10 and sum(r.domain == "movie" for r in lists) == 7 and sorted(r.rank for r in lists) == list(range(1, 11))


def test_routes_without_a_hit_keep_their_order(spark):
    """No candidate of the main route, or none at all, is among the hits: nothing can be fitted there."""
    rows = [(u, i, float(-i), int(u < 10 and i == 2), 0.0 if u < 20 else 1.0) for u in range(40) for i in range(3)]
    routed = ranking.routed(spark.createDataFrame(rows, "user_id int, item_id int, score double, label int, n_hist_same double"))
    first = ranking.routed_rank(routed, ["score"], 1).collect()
    assert {(r.route, r.item_id) for r in first} == {("cross", 2), ("main", 0)} and len(first) == 40
    first = ranking.routed_rank(routed.withColumn("label", F.lit(0)), ["score"], 1).collect()
    assert {(r.route, r.item_id) for r in first} == {("cross", 0), ("main", 0)} and len(first) == 40
    assert ranking.routed_rank(routed.where("user_id < 0"), ["score"], 1).isEmpty()


def test_best_by_vector_in_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    u, x = rng.standard_normal((7, 4)), rng.standard_normal((30, 4))
    users = spark.createDataFrame([(k, d, float(v)) for k, row in enumerate(u) for d, v in enumerate(row)], "user_id int, dim int, x double")
    vectors = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(np.vstack([x, x[:3]]))], "item_id long, v array<double>")
    want = {(k, r + 1, int(j)) for k in range(7) for r, j in enumerate(np.lexsort((np.arange(33), -np.round(u[k] @ np.vstack([x, x[:3]]).T, 9)))[:5])}
    for size in (8_192, 4):
        monkeypatch.setattr(models, "BLOCK_ITEMS", size)
        monkeypatch.setattr(models, "BLOCK_USERS", size)
        assert {(r.user_id, r["rank"], r.item_id) for r in models.best_by_vector(users, vectors, 5).collect()} == want


def test_cooccurrence_of_a_heavy_user(spark, monkeypatch):
    likes = spark.createDataFrame([(u, i) for u in (1, 2) for i in range(25)] + [(3, 0), (3, 1)], "user_id int, item_id int")
    one = {tuple(r) for r in models.cooccurrence(likes).collect()}
    monkeypatch.setattr(models, "SLICE", 4)
    assert {tuple(r) for r in models.cooccurrence(likes).collect()} == one and len(one) == 25 * 24 and (0, 1, 3) in one


def test_benchmark_tells_good_systems_from_bad(spark):
    """A system that knows what is to be found has full marks, one that names seen items has no list."""
    inter = spark.createDataFrame([(u, i, "movie" if i % 2 else "game", 5.0, i) for u in range(30) for i in range(u % 3, 20)], "user_id int, item_id int, domain string, rating double, timestamp int")
    cases = tasks.eval_tables(inter)
    relevant = cases[1].select(F.concat_ws("|", "task", F.col("user_id").cast("string")).alias("case"), "item_id", F.lit(1.0).alias("score"))
    seen = cases[2].select(F.concat_ws("|", "task", F.col("user_id").cast("string")).alias("case"), "item_id", F.lit(1.0).alias("score"))
    segments = inter.select("user_id").distinct().withColumn("segment", F.lit("all"))
    got = tasks.benchmark({"oracle": lambda asked: relevant, "seen": lambda asked: seen}, cases, inter.select("item_id", "domain").distinct(), segments).collect()
    assert {r.system for r in got} == {"oracle"} and {r.task for r in got} >= {"within_movie", "within_game", "mixed", "cold_start"} and all(abs(r.ndcg - 1) < 1e-9 for r in got)
    assert cases[0].where("task = 'cold_start'").isEmpty()
