"""Small cases for what SQL can't say."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from weftline.functions import text as T
from weftline.operators import models, publish, ranking

TITLES = [
    ("Harbour Lights 3000 [4K + DVD]", "movie", "harbour lights 3000"),
    ("The Copper Knights 2: Long Road - Deluxe Edition - Xbox 360", "game", "copper knights 2 long road"),
    ("Night Ferry: Volume Two", "movie", "night ferry"),
    ("Kite Racers (PC Download)", "game", "kite racers"),
    ("The Switch of Fate", "movie", "switch of fate"),
    ("1917 (2003) [VHS]", "movie", "1917"),
    ("Tin Forest IV Ultra HD", "movie", "tin forest 4"),
    ("Iron Tide IX", "game", "iron tide 9"),
    ("V for Violet", "movie", "v for violet"),
    ("A Limited Time", "movie", "limited time"),
    ("Ultimate", "movie", "ultimate"),
    ("Old Roads - The Complete Eleventh Series", "movie", "old roads"),
    ("River Town: Complete Thirty-Second Season", "movie", "river town"),
    ("River Town - Seasons Three to Five", "movie", "river town"),
    ("Widescreen", "movie", "widescreen"),
    ("Kill Bill, Vol. Two", "movie", "kill bill 2"),
    ("Lantern & Loom, The: Director's Cut", "movie", "lantern and loom"),
    ("Nintendo Selects: Kite Racers", "game", "kite racers"),
    ("Kite Racers Hits", "game", "kite racers"),
    ("Čapek's Robots 3-Disc Set", "movie", "capeks robots"),
    ("Kite Racers 10th Anniversary Edition", "game", "kite racers"),
]


def test_titles(spark):
    rows = spark.createDataFrame(TITLES, "title string, domain string, want string").withColumn("got", T.normalize_title(F.col("title"), F.col("domain")))
    assert [(r.title, r.got) for r in rows.collect() if r.got != r.want] == []


def test_year_and_root(spark):
    r = spark.createDataFrame([("Tin Forest (1984)", "1917", "The Copper Road Part II: Rebuilt (2024)")], "a string, b string, c string")
    r = r.select(T.extract_year(F.col("a")), T.extract_year(F.col("b")), T.title_root(F.col("c"))).first()
    assert tuple(r) == (1984, None, "copper road")


def test_fold_in_is_the_closed_form(spark):
    rng = np.random.default_rng(0)
    y = rng.standard_normal((5, 3))
    factors = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(y)], "id int, features array<float>")
    history = spark.createDataFrame([(1, 0, 1.0), (1, 3, 0.75), (1, 4, -1.0)], "user_id int, item_id int, weight double")
    got = np.array(models.fold_in(history, factors).first()["vector"])
    y32 = y.astype(np.float32).astype(float)
    c = np.zeros(5)
    c[[0, 3]] = 1 + 10 * np.array([1.0, 0.75])
    left = y32.T @ y32 + (y32 * np.where(c > 0, c - 1, 0)[:, None]).T @ y32 + 0.05 * np.eye(3)
    assert np.allclose(got, np.linalg.solve(left, y32.T @ c))


def test_mmr_spreads_equal_items(spark):
    rows = spark.createDataFrame([(1, 1, 1.0, "a", [1.0, 0.0]), (1, 2, 0.99, "a", [1.0, 0.0]), (1, 3, 0.95, "b", [0.0, 1.0]), (1, 4, 0.0, "c", [0.0, 1.0])], "user_id int, item_id int, score double, creator string, v array<double>")
    assert [r.item_id for r in ranking.mmr(rows, 2).orderBy("rank").collect()] == [1, 3]


def test_publish_refuses_a_shrunken_version(spark, tmp_path):
    root = str(tmp_path / "index")
    publish.publish_version(spark.range(10), root)
    with pytest.raises(ValueError):
        publish.publish_version(spark.range(3), root)
    assert publish.load_version(spark, root).count() == 10
    publish.publish_version(spark.range(3), root, force=True)
    assert publish.load_version(spark, root).count() == 3


def test_power_user_pairs(spark):
    likes = spark.createDataFrame([(u, i) for u in range(3) for i in range(4)], "user_id int, item_id int")
    rows = models.cooccurrence(likes, 2).collect()
    assert len(rows) == 12 and {r.c for r in rows} == {3}
