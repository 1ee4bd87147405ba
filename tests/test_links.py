"""Franchise links against brute force over all pairs; explanations in odd cases."""

import math
import random
import re

from weftline.operators import explain, franchise
from weftline.plans import QUERIES

SCHEMA = "item_id int, kind string, title string, franchises array<string>, flagged boolean, blocked boolean, popularity long, extra int"


def root_of(title):
    t = re.sub(r"[^a-z0-9]+", " ", re.split(r":| - ", title, maxsplit=1)[0].lower()).strip()
    t = re.sub(r"( (\d+|ii|iii))+$", "", t)
    t = re.sub(r"^(the|a|an) ", "", t)
    return t if len(t) >= 4 else ""


def brute(rows, most):
    rows = [r for r in rows if not r[5] and len(set(r[3] or [])) <= 4]
    links = {r[0]: set() for r in rows}
    names = {r[0]: {n for n in r[3] or [] if n} for r in rows}
    roots = {r[0]: root_of(r[2] or "") for r in rows}
    game = {r[0]: r[1] == "game" for r in rows}
    for i, _, title, _, flagged, *_ in rows:
        own = names[i] | {roots[i]} - {""}
        others = [j for j in game if game[j] != game[i]]
        hit = {j for j in others if own & names[j]}
        new = {j for j in others if names[i] & names[j]}
        if len(roots[i]) >= 6 and re.search(r"\S\s*(?::| - )\s*\S", title or ""):
            new |= {j for j in others if roots[i] in names[j]}
        if flagged:
            new |= hit | {j for j in others if roots[j] in own}
            if not hit:
                w = re.findall("[a-z0-9]+", (title or "").lower())
                spans = {" ".join(w[a:b]) for a in range(len(w)) for b in range(a + 1, len(w) + 1)}
                new |= {j for j in others if spans & names[j]}
        for j in new:
            links[i].add(j)
            links[j].add(i)
    pop = {r[0]: r[6] or 0 for r in rows}
    return {(i, j, n + 1) for i, js in links.items() for n, j in enumerate(sorted(js, key=lambda j: (-pop[j], j))[:most])}


def test_franchise_links(spark):
    pick = random.Random(5)
    words = ["mario", "witcher", "destiny", "night city", "dinosaurs", "rage"]
    rows = []
    for i in range(400):
        title = pick.choice(["The {} Movie", "{}: Origins", "{} 2", "Super {}", "{}", "{} - Dawn"]).format(pick.choice(words).title())
        rows.append((i, pick.choice(["game", "movie", "tv", None]), pick.choice([title] * 9 + [None, ""]), pick.choice([None, [], [pick.choice(words)], pick.sample(words, 2), ["", pick.choice(words)], words]),
                     pick.choice([True, False, None]), pick.choice([False, False, None, True]), pick.choice([None, 1, 2, 3]), 0))
    rows = [r for r in rows if r[1]] + [(900, None, "Rage", ["rage"], True, None, 5, 1)]
    got = {tuple(r) for r in franchise.franchise_links(spark.createDataFrame(rows, SCHEMA), 7).collect()}
    assert got == brute(rows, 7)
    assert any(r[3] and len(r[3]) > 4 for r in rows)
    assert franchise.franchise_links(spark.createDataFrame([], SCHEMA)).isEmpty()


def test_flagged_title_without_a_hit_links_by_its_words(spark):
    rows = [(1, "movie", "Super Mario Bros", [], True, False, 1, 0), (2, "game", "Mario Kart", ["mario"], False, False, 1, 0), (3, "game", "Dinosaurs", [], False, False, 1, 0)]
    got = {(r.src, r.dst) for r in franchise.franchise_links(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, 2), (2, 1)}


def test_evidence_without_likes_vectors_or_themes(spark):
    recs = spark.createDataFrame([(1, 10), (2, 10), (3, 99)], "user_id int, item_id int")
    history = spark.createDataFrame([(1, 20, 1.0), (1, 30, -1.0), (3, 20, 1.0)], "user_id int, item_id int, weight double")
    themes = spark.createDataFrame([(10, ["war", "space"]), (20, ["space"]), (30, ["war"]), (40, None)], "item_id int, themes array<string>")
    likes = spark.createDataFrame([(20, 10, 25)], "i int, j int, c long")
    vectors = spark.createDataFrame([(10, [1.0, 0.0]), (20, [0.0, 0.0])], "item_id int, v array<double>")
    titles = spark.createDataFrame([(20, "Star")], "item_id int, title string")
    out = explain.evidence(recs, history, themes, likes, vectors, titles)
    got = {r.user_id: r for r in out.withColumn("text", explain.summary("it fits")).collect()}
    assert len(got) == 3
    assert [s.theme for s in got[1].shared] == ["space"] and got[1].disliked == ["war"] and got[1].confidence == "high"
    assert got[1].co_likes == 25 and got[1].similarity == 0 and got[1].overlap == 0.5
    assert got[1].text == "Chosen since 25 people liked both this and Star. It has themes you rated low: war."
    assert got[2].anchors is None and got[2].confidence == "low" and got[2].text == "Chosen since it fits."
    assert not got[3].shared and got[3].co_likes == 0 and got[3].confidence == "low"


def test_anchors_are_rows_only_where_something_is_known(spark, small):
    """Against a loop over all liked titles; interactions are read once, and pairs are made of titles liked together or with vectors."""
    pick = random.Random(9)
    recs = [(u, i) for u in range(30) for i in pick.sample(range(40), 3)]
    history = [(u, i, pick.choice([1.0, 0.75, 0.75, -1.0])) for u in range(30) for i in pick.sample(range(40), pick.randrange(1, 12))]
    likes = {(i, j): pick.randrange(2, 9) for i in range(40) for j in pick.sample(range(40), i % 3 * 4)}
    vectors = {i: [pick.choice([-1.0, 0.5, 0.0]) for _ in range(2)] for i in range(0, 40, 2)} | {0: [1.0, 0.0], 2: [-1.0, 0.0]}
    recs, history = [*recs, (30, 0)], [*history, (30, 2, 1.0)]  # nothing but what is far

    def cosine(i, j):
        a, b = vectors.get(i, [0.0, 0.0]), vectors.get(j, [0.0, 0.0])
        size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return round((a[0] * b[0] + a[1] * b[1]) / size, 6) if size else 0.0

    want = {}
    for u, i in recs:
        of = [(likes.get((a, i), 0), cosine(i, a), a) for v, a, w in history if v == u and w > 0]
        best = sorted((-round(math.log1p(c) + 2 * s, 6), a, c, s) for c, s, a in of)[:3]
        if of:
            want[u, i] = (max(c for c, _, _ in of), max(s for _, s, _ in of), [(k + 1, a, f"t{a}", c, s) for k, (_, a, c, s) in enumerate(best)])
    frames = [
        spark.createDataFrame(recs, "user_id int, item_id int"), spark.createDataFrame(history, "user_id int, item_id int, weight double"),
        spark.createDataFrame([(*k, c) for k, c in likes.items()], "i int, j int, c long"), spark.createDataFrame(list(vectors.items()), "item_id int, v array<double>"),
        spark.createDataFrame([(i, f"t{i}") for i in range(40)], "item_id int, title string"),
    ]
    got = {(r.user_id, r.item_id): (r.co_likes, r.similarity, [tuple(x) for x in r.anchors]) for r in explain.anchors(*frames).collect()}
    assert got == want and any(s < 0 for _, s, _ in want.values())
    plan = QUERIES["evidence_summary"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_partkey" not in plan  # written once
