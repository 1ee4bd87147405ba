"""Titles, matching, works, versions and rings against plain Python."""

import difflib
import random
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F
from weftline.functions import text as T
from weftline.operators import matching, metrics, publish, works
from weftline.sources.scratch import shared_path
from weftline.streaming import jobs

DISPLAYED = [
    ("Harbour Lights [Blu-ray + DVD]", "movie", "Harbour Lights"),
    ("Harbour Lights, The (DVD)", "movie", "The Harbour Lights"),
    ("Paper Moons [1987] [Region 2]", "movie", "Paper Moons (1987)"),
    ("Ten Quiet Years (Director's Cut) - Special Edition", "movie", "Ten Quiet Years"),
    ("Night Ferry: The Complete Third Season DVD", "movie", "Night Ferry"),
    ("Guardians of the Galaxy Vol. 2 4K Ultra HD", "movie", "Guardians of the Galaxy Vol. 2"),
    ("Unrated", "movie", "Unrated"),
    ("PS4 Copper Knights", "game", "Copper Knights"),
    ("Copper Knights - Xbox One Deluxe Edition", "game", "Copper Knights"),
    ("Copper Knights w/ bonus map", "game", "Copper Knights"),
    ("Kite Racers 3D - Nintendo 3DS", "game", "Kite Racers 3D"),
    ("The Switch", "game", "The Switch"),
    ("   ", "movie", "   "),
    (None, "movie", None),
]
SEARCHED = [
    ("Disney's Tin Forest (2004) [DVD]", "movie", "Tin Forest", 2004),
    ("Copper Knights 4 - Xbox 360", "game", "Copper Knights 4", None),
    ("Copper Knights - Rise of the Anvil", "game", "Copper Knights - Rise of the Anvil", None),
]


def test_display_and_search_titles(spark):
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(DISPLAYED)], "i int, title string, domain string, want string")
    got = rows.withColumn("got", T.display_title(F.col("title"), F.col("domain"))).orderBy("i").collect()
    assert [(r.title, r.got) for r in got] == [(t, w) for t, _, w in DISPLAYED]
    rows = spark.createDataFrame(SEARCHED, "title string, domain string, want string, year int")
    got = rows.select("want", T.search_title(F.col("title"), F.col("domain")), "year", T.title_year(F.col("title"), F.col("domain"))).collect()
    assert all(r[0] == r[1] and r[2] == r[3] for r in got)


def test_accents_by_unicode(spark):
    row = spark.createDataFrame([("Ǆ Ålesund Čapek ﬁ été Ｆｕｌｌ ệ œ",)], "t string").select(T.strip_accents(F.col("t"))).first()[0]
    assert row == "Ǆ Alesund Capek ﬁ ete Full e œ"


def test_ratio_is_ratcliff_obershelp(spark):
    rng = random.Random(1)
    pairs = [("".join(rng.choices("abc ", k=rng.randint(0, 12))), "".join(rng.choices("abc ", k=rng.randint(0, 12)))) for _ in range(300)] + [("", ""), (None, "a")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", matching.ratio("a", "b").alias("r")).collect()
    assert all(r.r == (None if r.a is None else difflib.SequenceMatcher(None, r.a, r.b).ratio()) for r in got) and len(got) == 302


def test_matches_by_rule(spark):
    works_of = spark.createDataFrame([
        (1, "movie", "Harbour Lights", None, 1990, 10), (2, "movie", "Harbour Lights", None, 2001, 5_000), (3, "tv", "Harbour Lights", None, 1990, 10), (4, "movie", "Harbour Lights", None, 2025, 90_000),
        (5, "movie", "Sea Stories: Night Ferry", None, 1970, 3), (6, "movie", "Luces del puerto", "Copper Rain", 1999, 3), (7, "movie", "Harbor Light", None, 1990, 2),
    ], "ext_id long, kind string, title string, original_title string, year int, votes long")
    items = spark.createDataFrame([
        (10, "Harbour Lights (1990) [DVD]", 2010, None), (11, "Harbour Lights [Blu-ray]", 1990, True), (12, "Night Ferry", None, None), (13, "Copper Rain [VHS]", None, None), (14, "Something Else", 1990, None), (15, "", 1990, None),
    ], "item_id long, title string, year int, tv_hint boolean")
    got = {r.item_id: (r.ext_id, r.similarity, r.pool) for r in matching.match_films(items, works_of).collect()}
    # 10: the year in the title rules 2 out; 11: near year and format beat votes; 12: by subtitle; 13: by original title.
    assert got == {10: (1, 1.0, 0), 11: (3, 1.0, 0), 12: (5, 0.95, 0), 13: (6, 1.0, 0)}
    games = spark.createDataFrame([(1, "game", "Copper Knights", None, 2012, 5), (2, "game", "2K Golf", None, 2012, 5), (3, "game", "Ox", None, 2012, 5)], works_of.schema)
    items = spark.createDataFrame([(20, "Konami Copper Knights - PS3", 2012, None), (21, "2K Golf", 2012, None), (22, "Ox", 2012, None), (23, "Copper Knights (2016)", None, None)], items.schema)
    got = {r.item_id: (r.ext_id, r.pool) for r in matching.match_games(items, games).collect()}
    assert got == {20: (1, 2), 21: (2, 0), 22: (3, 1)}
    found = spark.createDataFrame([(1, "movie", "tv", 9, 1.0), (2, "movie", "tv", 9, 0.96), (3, "movie", "tv", 9, 0.9), (4, "game", "game", 9, 1.0), (5, "movie", "movie", 9, 1.0)], "item_id long, domain string, kind string, ext_id long, similarity double")
    popular = spark.createDataFrame([(1, 5), (2, 7)], "item_id long, popularity long")
    assert [tuple(r) for r in matching.merge_map(found, popular).collect()] == [(1, 2)]


def test_matching_a_large_block_ends(spark):
    """100,000 works that share a first word: 1,000 of them meet each key."""
    many = spark.range(100_000).select(F.col("id").alias("ext_id"), F.lit("movie").alias("kind"), F.concat(F.lit("harbour "), F.md5(F.col("id").cast("string"))).alias("title"), F.lit(None).cast("string").alias("original_title"), F.lit(1990).alias("year"), F.col("id").alias("votes"))
    best = many.where("ext_id = 99999").first()["title"]
    items = spark.createDataFrame([(1, best, 1990, None)], "item_id long, title string, year int, tv_hint boolean")
    assert [(r.item_id, r.ext_id) for r in matching.match_films(items, many).collect()] == [(1, 99_999)]


def test_suggestions_like_a_loop(spark):
    rng = random.Random(5)
    names = [" ".join(rng.choices(["copper", "coppice", "knight", "knitting", "harbour", "harbinger", "of", "tin"], k=3)) for _ in range(150)]
    titles = [(i, n, rng.randint(0, 9)) for i, n in enumerate(names)]
    asked = ["coper knights", "copper harbr", "harbour tin tin", "zzzz", ""]
    got = {}
    for r in matching.suggest(spark.createDataFrame([(q,) for q in asked], "q string"), spark.createDataFrame(titles, "item_id long, title string, popularity int"), most=40).orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append(r.item_id)
    want = {}
    for q in asked:
        blocks = {w[:4] for w in q.split() if len(w) >= 3}
        pool = sorted((t for t in titles if blocks & {w[:4] for w in t[1].split() if len(w) >= 3}), key=lambda t: (-t[2], -t[0]))[:40]
        best = sorted(((difflib.SequenceMatcher(None, q, t[1]).ratio(), t[2], t[0]) for t in pool), reverse=True)[:3]
        if any(s >= 0.5 for s, _, _ in best):
            want[q] = [i for s, _, i in best if s >= 0.5]
    assert got == want and len(want) == 3


def test_canonical_years(spark):
    rows = [
        (1, "movie", "Paper Moons (1954)", 1999), (2, "movie", "Paper Moons (1955) [DVD]", None), (3, "movie", "Paper Moons (1998)", None), (4, "movie", "Paper Moons", 1998),
        (5, "game", "Kite Racers - PS2", 2002), (6, "game", "Kite Racers", 2005), (7, "game", "Kite Racers", 2016), (8, "game", "Kite Racers", None), (9, "game", "Tin", 2001), (10, "game", "Tin (DVD)", 2003), (11, "movie", None, 2000), (12, "movie", "[]", 2000),
    ]
    got = works.canonicalize(spark.createDataFrame(rows, "item_id long, domain string, title string, year int")).collect()
    assert {r.item_id: r.cluster for r in got} == {1: 1954, 2: 1954, 3: 1998, 4: 1954, 5: 2002, 6: 2002, 7: 2016, 8: 2002, 9: None, 10: None}
    by = {r.item_id: r.work_id for r in got}
    assert by[1] == by[2] == by[4] != by[3] and by[5] == by[6] == by[8] != by[7] and by[9] == by[10] and by[9].startswith("g_")


def test_sources_merge(spark):
    kind = "item_id string, domain string, kind string, title string, year int, genres array<string>"
    rows = spark.createDataFrame([("a", "movie", "tv", "Traveller's End", 2020, ["Drama"]), ("b", "movie", "movie", "Traveller's End", 2020, []), ("c", "game", "tv", "Sky Tin", 2020, []), ("d", "movie", "tv", "Old Song", None, ["Anime"])], kind)
    more = [("x", "movie", "tv", "Tabi no Owari", 2021, ["Anime"], ["Tabi no Owari", "Traveller’s End"]), ("y", "movie", "tv", "Sky Tin", 2020, ["Anime"], ["Sky Tin"]), ("z", "movie", "tv", "Traveller's End", 2024, ["Anime"], ["Traveller's End"]), ("w", "movie", "tv", "Old Song", 2000, ["Anime"], ["Old Song"])]
    got = {r.item_id: r.genres for r in works.merge_sources(rows, spark.createDataFrame(more, kind + ", names array<string>")).collect()}
    assert got == {"a": ["Anime", "Drama"], "b": [], "c": [], "d": ["Anime"], "y": ["Anime"], "z": ["Anime"]}


def test_dedupe_like_a_loop(spark):
    rng = random.Random(8)
    rows = [(u, i, rng.choice("mg"), rng.choice("abcdef"), rng.choice(["p", "q", "r", "", None]), k + 1) for u in range(20) for k, i in enumerate(rng.sample(range(100), 25))]
    got = works.dedupe_works(spark.createDataFrame(rows, "user_id int, item_id int, kind string, key string, family string, rank int"), 6).orderBy("user_id", "rank").collect()
    want = []
    for u in range(20):
        first, kept = set(), []
        for r in (r for r in rows if r[0] == u):
            if r[2:4] not in first:
                first.add(r[2:4])
                kept.append(r)
        families, out = set(), []
        for r in kept:
            if not r[4] or r[4] not in families:
                families.add(r[4])
                out.append(r)
        want += [(u, r[1], n + 1) for n, r in enumerate(out[:6])]
    assert [(r.user_id, r.item_id, r.rank) for r in got] == want


def test_versions(spark):
    root = shared_path(spark)
    table = lambda n, width=2: spark.range(n).select(F.col("id").alias("item_id"), F.array_repeat(F.lit(0.5), width).alias("vector"))
    names = [publish.publish_version(table(10 + i), root, model="m") for i in range(5)]
    assert publish.versions(spark, root) == names[:1:-1] and publish.load_version(spark, root).count() == 14
    with pytest.raises(ValueError):
        publish.publish_version(table(3), root, model="m")
    assert publish.versions(spark, root) == names[:1:-1] and publish.load_version(spark, root).count() == 14
    publish.publish_version(table(3, 4), root, force=True, version="odd", model="other")
    publish.publish_version(table(3, 4), root, version="odd")  # once
    assert publish.load_version(spark, root, model="other").count() == 3 and publish.versions(spark, root)[0] == "odd"
    # The live one is unfit: the newest that fits is taken.
    assert publish.load_version(spark, root, width=2).count() == 14 and publish.load_version(spark, root, width=2, known=table(14)).count() == 14
    assert publish.load_version(spark, root, width=3) is None and publish.load_version(spark, shared_path(spark)) is None
    # A live version that lost its marker is not read.
    files = publish._Files(spark, root)
    files.delete(f"{root}/versions/odd/_SUCCESS")
    assert publish.load_version(spark, root).count() == 14


def test_new_titles_publish_once_a_batch(spark):
    landing, root, check = (shared_path(spark) for _ in range(3))
    kind = "item_id long, key string, updated long"
    for i, rows in enumerate([[(1, "a", 1), (2, "known", 1), (3, "c", 1)], [(1, "b", 2), (4, "d", 1)], [(9, "known", 9)]]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").json(landing)
        known = spark.createDataFrame([("known",)], "key string")
        jobs.publish_new_titles(spark.readStream.schema(kind).json(landing), known, root, check)
        assert len(publish.versions(spark, root)) == min(i + 1, 2)
    assert {tuple(r) for r in publish.load_version(spark, root).collect()} == {(1, "b", 2), (3, "c", 1), (4, "d", 1)}
    jobs.publish_new_titles(spark.readStream.schema(kind).json(landing), known, root, check)
    assert len(publish.versions(spark, root)) == 2


def test_rings(spark):
    """Stream over several batches and table against a deque; rings of seven items."""
    rng = random.Random(4)
    log = [(s, i, i // 3, rng.choice([*range(12), None])) for i, s in enumerate(rng.choices("ab", k=90))]
    kind, pct = "source string, event_id long, at long, item int", {i: i / 12 for i in range(10)}
    popularity = spark.createDataFrame(list(pct.items()), "item int, pct double")
    want, rings = {}, {"a": deque(maxlen=7), "b": deque(maxlen=7)}
    for s, i, _, item in log:
        if item is not None:
            rings[s].append(item)
            want[i] = (s, round(len(set(rings[s])) / 12, 9), round(sum(pct.get(x, 0) for x in rings[s]) / len(rings[s]), 9))
    told = lambda df: {r.event_id: (r.source, round(r.coverage, 9), round(r.popularity, 9)) for r in df.collect()}
    shaped = lambda df: df.withColumn("ts", F.timestamp_seconds("at")).drop("at")
    assert told(metrics.ring_quality(shaped(spark.createDataFrame(log, kind)), popularity, 12, 7)) == want
    landing = shared_path(spark)
    for k in range(0, 90, 30):
        spark.createDataFrame(log[k : k + 30], kind).coalesce(1).write.mode("append").json(landing)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(landing)
    with jobs.with_rocksdb(spark):
        assert told(jobs.replay(jobs.ring_quality(shaped(stream), popularity, 12, 7), "append")) == want


def test_bootstrap_counts_are_poisson():
    cdf = [t / 65_536 for t in metrics.LAW]
    assert abs(sum(1 - c for c in cdf) - 1) < 2e-3  # the mean number of draws
    assert Counter(a < b for a, b in zip(cdf, cdf[1:]))[True] >= 6


def test_bootstrap_interval_covers_the_mean(spark):
    rng = random.Random(6)
    rows = [("t", i, rng.gauss(0.5, 2.0), 1.0) for i in range(1_000)]
    r = metrics.paired_bootstrap(spark.createDataFrame(rows, "task string, user_id long, diff double, base double")).first()
    sd = (sum((x[2] - r.lift) ** 2 for x in rows) / 1_000) ** 0.5 / 1_000**0.5
    assert abs(r.low - (r.lift - 1.96 * sd)) < 0.15 * sd + 0.01 and abs(r.high - (r.lift + 1.96 * sd)) < 0.15 * sd + 0.01 and r.significant
