"""Every registered query against its SQL on the smallest tables."""

import glob
import math
import re
from collections import Counter
from difflib import SequenceMatcher
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F
from weftline.operators import core, models
from weftline.plans import ORACLE_SQL, QUERIES
from weftline.sources.tables import interactions, items, read_table


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, dict):
        return tuple(map(plain, v.values()))
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    cols = sorted(df.columns)
    got = Counter(repr([plain(r[c]) for c in cols]) for r in df.collect())
    ran = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in ran.description]
    assert sorted(names) == cols
    want = Counter(repr([plain(r[names.index(c)]) for c in cols]) for r in ran.fetchall())
    assert got == want


@pytest.mark.parametrize("name", ["als_fold_in", "mmr_diversify", "two_tower_fit", "recommendation_ttl", "item_themes", "new_titles_for_profile", "routed_rank", "feature_importance", "content_query"])
def test_runs(spark, small, name):
    assert not QUERIES[name](spark, small).isEmpty()


@pytest.mark.parametrize("domain, name", [("movie", "fuzzy_match_movie"), ("game", "fuzzy_match_game")])
def test_fuzzy_matches_every_item(spark, small, domain, name):
    """Brute force over all items of the domain against all works, titles being known without their noise."""
    n = {r.item_id: r.rating_count for r in core.item_stats(interactions(spark, small)).collect()}
    own = [r for r in items(spark, small).collect() if r.domain == domain]
    works = []
    for r in own:
        kind = "game" if domain == "game" else "tv" if r.item_id % 2 == 0 else "movie"
        full = f"{r.creator}: {r.title}" if r.item_id % 3 == 0 else r.title
        works.append((r.item_id, kind, [(" ".join(re.findall("[a-z0-9]+", full.lower())), 1.0)] + [(r.title, 0.95)] * (r.item_id % 3 == 0), r.year, n.get(r.item_id, 0)))
    best = {}
    for title in {r.title for r in own}:
        best[title] = [(w, max(cap if title == x else cap * SequenceMatcher(None, title, x).ratio() for x, cap in w[2])) for w in works]
    want = {}
    for r in own:
        found = []
        for (ext, kind, _, year, votes), sim in best[r.title]:
            if sim >= 0.88 and (domain == "game" or abs(year - r.year) <= 1):
                near = 0.15 if abs(year - r.year) <= 1 else 0
                hint = 0.2 if (kind == "tv") == (r.item_id % 2 == 0) else 0
                found.append((-round(sim + near + 0.03 * math.log1p(votes) + hint, 9), ext, round(sim, 3)))
        if found:
            want[r.item_id] = min(found)[1:]
    got = QUERIES[name](spark, small).collect()
    assert {r.item_id: (r.ext_id, r.similarity) for r in got} == want and len(got) == len(want) > 50


@pytest.mark.parametrize("name", ["explain", "evidence_summary"])
def test_explains_users_without_likes(spark, name):
    """The next larger tables hold users whose ratings are all middling."""
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = Counter(repr([plain(r[c]) for c in cols]) for r in df.collect())
    ran = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in ran.description]
    assert got == Counter(repr([plain(r[names.index(c)]) for c in cols]) for r in ran.fetchall())


def test_new_titles_for_every_profile(spark, small):
    """Every user with a vector among the likes has five titles, chosen from all."""
    v = read_table(spark, small, "embeddings").select(F.col("vec_id").alias("item_id"))
    users = models.signed_history(interactions(spark, small)).where("weight > 0").join(v, "item_id").select("user_id").distinct()
    got = QUERIES["new_titles_for_profile"](spark, small).collect()
    assert {r.user_id for r in got} == {r.user_id for r in users.collect()} and len(got) == 5 * users.count()
    assert {r.item_id % 3 for r in got} == {0, 1, 2}
