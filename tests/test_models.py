"""Text vectors, features and rankers against dense algebra and plain loops."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from weftline.operators import content, core, features, ranking, two_tower
from weftline.plans import QUERIES

WORDS = "copper knights harbour lights winter ferry violet stone lantern loom river town paper moons iron tide forest anvil".split()


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randint(4, 30))) + (" the and" if i % 3 else ""), rng.sample(["sea", "war", "love"], i % 3)) for i in range(60)]
    return spark.createDataFrame(rows + [(60, None, None), (61, "", ["sea"]), (62, "unknown words only", [])], "doc_id long, text string, themes array<string>")


def dense(rows, stop, themes, k, min_df=2, max_df=0.5):
    def cut(t):
        w = [x for x in (t or "").lower().split() if len(x) > 1 and x not in stop]
        return w + [f"{a} {b}" for a, b in zip(w, w[1:])]

    tf = [Counter(cut(r.text)) for r in rows]
    df, n = Counter(t for c in tf for t in c), len(rows)
    terms = sorted(t for t, d in df.items() if min_df <= d <= max_df * n)
    a = np.array([[(1 + math.log(c[t])) * (math.log((1 + n) / (1 + df[t])) + 1) if c[t] else 0.0 for t in terms] for c in tf])
    a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    theme = np.array([[float(t in (r.themes or [])) for t in themes] for r in rows])
    return terms, s, unit(np.hstack([unit(a @ vt[:k].T), 0.6 * unit(theme)]))


def test_content_vectors_are_a_truncated_svd(spark, texts):
    stop, themes = ["the", "and"], ["love", "sea", "war"]
    model = content.fit_content(texts, stop, themes, dims=12)
    assert np.allclose(model.projection.T @ model.projection, np.eye(12), atol=1e-8)
    rows = model.transform(texts, themes_col="themes").orderBy("doc_id").collect()
    terms, s, want = dense(rows, stop, themes, 12)
    assert model.vocabulary == terms and np.allclose(model.singular, s[:12], rtol=1e-6)
    got = np.array([r.vector for r in rows])
    assert np.allclose(got @ got.T, want @ want.T, atol=1e-6)
    assert not got[60].any() and not got[61][:12].any() and got[61][13] == 1 and not got[62].any()
    # Fitted once, applied to other rows, in any partitioning: the same vectors.
    some = {r.doc_id: r.vector for r in model.transform(texts.where("doc_id % 7 = 0").repartition(5), themes_col="themes").collect()}
    assert all(np.array_equal(some[r.doc_id], r.vector) for r in rows if r.doc_id in some) and len(some) == 9
    assert np.allclose(model.query(spark, rows[3].text, []), got[3] if not rows[3].themes else model.query(spark, rows[3].text, []))
    wish = model.query(spark, "copper knights", ["sea"])
    assert abs(np.linalg.norm(wish) - 1) < 1e-9 and wish[13] > 0
    empty = content.fit_content(texts.limit(0), stop, themes)
    assert empty.vocabulary == [] and empty.transform(texts, themes_col="themes").count() == 63


def test_vocabulary_is_bounded(spark, texts):
    model = content.fit_content(texts, [], [], dims=3, vocabulary=5)
    assert len(model.vocabulary) == 5 and model.projection.shape == (5, 3)


def test_encoders(spark, texts):
    rows = texts.select("doc_id", "text")
    one = {r.doc_id: r.vector for r in content.encode_texts(rows.repartition(1)).collect()}
    many = {r.doc_id: r.vector for r in content.encode_texts(rows.repartition(9)).collect()}
    assert one == many and one[60] is None and abs(np.linalg.norm(one[0]) - 1) < 1e-9 and len(one[0]) == 256

    def lengths():
        return lambda found: np.array([[len(t), t.count("e")] for t in found], float)

    got = content.encode_texts(rows, lengths).collect()
    assert all(r.vector == (None if r.text is None else [len(r.text), r.text.count("e")]) for r in got)


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(2)
    items = [(i, rng.choice(["movie", "game"]), rng.choice([None, *range(1990, 2020)]), rng.choice(["", "ann", "bo", "cy"]), rng.sample(["sea", "war", "love", "ice", "sun"], rng.randint(0, 4))) for i in range(40)]
    history = [(u, i, rng.choice([1.0, 0.75, -1.0])) for u in range(6) for i in rng.sample(range(40), rng.randint(1, 15))]
    vectors = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(36)]
    stats = [(i, rng.randint(0, 50), rng.uniform(1, 5), rng.randint(1, 60)) for i in range(38)]
    scores = [(u, s, i, round(rng.uniform(-1, 1), 3)) for u in range(7) for s in ("near", "far") for i in rng.sample(range(40), 12)]
    pairs = [(i, j, rng.randint(1, 9)) for i in range(40) for j in range(40) if i != j and rng.random() < 0.2]
    return {
        "items": (items, "item_id long, domain string, year int, creator string, themes array<string>"), "history": (history, "user_id long, item_id long, weight double"), "vectors": (vectors, "item_id long, v array<double>"),
        "stats": (stats, "item_id long, popularity long, rating_mean double, rating_count long"), "scores": (scores, "user_id long, source string, item_id long, score double"), "pairs": (pairs, "i long, j long, c long"),
    }


def test_features_by_loops(spark, world, monkeypatch):
    df = {k: spark.createDataFrame(*v) for k, v in world.items()}
    monkeypatch.setattr(features, "SLICE", 4)  # histories come in several slices
    cands = ranking.candidates(df["scores"], df["history"], 8, {"far": 3})
    got = {(r.user_id, r.item_id): r for r in features.features(cands, sources=["near", "far"], **df).collect()}
    items, stats = {r[0]: r for r in world["items"][0]}, {r[0]: r for r in world["stats"][0]}
    prior = np.mean([r[2] for r in stats.values()])
    vectors = {i: np.array(v) / np.linalg.norm(v) for i, v in world["vectors"][0]}
    co = {(i, j): c for i, j, c in world["pairs"][0]}
    asked = cands.collect()
    assert set(got) == {(r.user_id, r.item_id) for r in asked} and len(got) == len(asked)
    cos = lambda a, b: float(vectors[a] @ vectors[b]) if a in vectors and b in vectors else 0.0
    for r in asked:
        u, i, f = r.user_id, r.item_id, got[r.user_id, r.item_id]
        hist = [h for h in world["history"][0] if h[0] == u]
        pos, neg = [h[1] for h in hist if h[2] > 0], [h[1] for h in hist if h[2] < 0]
        prof = Counter(t for p in pos for t in items[p][4][:4])
        top = {t for t, _ in sorted(prof.items(), key=lambda x: (-x[1], x[0]))[:6]}
        bad, own = {t for p in neg for t in items[p][4][:3]}, set(items[i][4])
        same = sum(items[p][1] == items[i][1] for p in pos)
        years = [items[p][2] for p in pos if items[p][2]]
        st = stats.get(i)
        want = {
            "n_sources": len(r.sources), "is_game": items[i][1] == "game", "n_hist": len(hist), "n_hist_same": same, "n_hist_other": len(pos) - same, "cross_domain_frac": (len(pos) - same) / max(len(pos), 1), "n_dislikes": len(neg),
            "log_pop": math.log1p(st[1]) if st else 0, "bayes_rating": (st[2] * st[3] + prior * 10) / (st[3] + 10) if st else prior, "log_rating_count": math.log1p(st[3]) if st else 0,
            "theme_affinity": sum(prof[t] for t in own) / max(sum(prof.values()), 1), "theme_jaccard": len(own & top) / len(own | top) if own and top else 0, "disliked_theme_overlap": len(own & bad) / len(own) if own else 0,
            "max_sim_pos": max([cos(i, p) for p in pos], default=0), "mean_sim_pos": np.mean([cos(i, p) for p in pos]) if pos else 0, "max_sim_neg": max([cos(i, p) for p in neg], default=0),
            "max_colikes": max([co.get((p, i), 0) for p in pos], default=0), "log_sum_colikes": math.log1p(sum(co.get((p, i), 0) for p in pos)),
            "creator_match": bool(items[i][3]) and items[i][3] in {items[p][3] for p in pos}, "cold_start": not hist,
        }
        assert {k: round(float(f[k]), 9) for k in want} == {k: round(float(v), 9) for k, v in want.items()}
        assert f.year_gap == (abs(items[i][2] - np.median(years)) if items[i][2] and years else None)
        for s in ("near", "far"):
            given = sorted((x for x in world["scores"][0] if x[0] == u and x[1] == s and x[3] != 0), key=lambda x: (-x[3], x[2]))
            at = {x[2]: (x[3], n) for n, x in enumerate(given)}
            of = [at.get(y.item_id, (0.0, 1000))[0] for y in asked if y.user_id == u]
            z = (at.get(i, (0.0, 0))[0] - np.mean(of)) / np.std(of) if np.std(of) > 0 else 0
            assert (f[f"{s}_score"], round(f[f"{s}_rank"], 9)) == (at.get(i, (0.0, 0))[0], round(math.log1p(at.get(i, (0, 1000))[1]), 9)) and abs(f[f"{s}_z"] - z) < 1e-9


def ndcg(rows, score):
    """Mean over the queries of the held-back part."""
    out = []
    for u in {r.user_id for r in rows}:
        own = sorted((r for r in rows if r.user_id == u), key=lambda r: (-score(r), r.item_id))
        ideal = sum(1 / math.log2(k + 2) for k in range(sum(r.label for r in own)))
        out.append(sum(r.label / math.log2(k + 2) for k, r in enumerate(own)) / ideal)
    return np.mean(out)


def test_trees_beat_the_linear_ranker(spark):
    """What makes a row relevant is an interaction that no sum of features tells."""
    rng = random.Random(3)
    rows = []
    for u in range(150):
        for i in range(20):
            a, b, score = rng.random(), rng.random(), rng.random()
            rows.append((u, i, int((a > 0.5) != (b > 0.5) and score > 0.4 or i == 0), score, a, b if rng.random() > 0.02 else None))
    df = spark.createDataFrame(rows, "user_id long, item_id long, label int, score double, a double, b double")
    model = ranking.tree_ranker(df, ["score", "a", "b"], rounds=25)
    w = ranking.pairwise_ranker(df.na.fill(0.0), ["score", "a", "b"]).coefficients.toArray()
    scored = ranking.tree_scores(df, model, ["score", "a", "b"])
    assert scored.columns == [*df.columns, "ranked"]
    held = scored.where(ranking.held_back(F.col("user_id"))).collect()
    assert 0.05 < len(held) / len(rows) < 0.3
    trees, linear, fused = ndcg(held, lambda r: r.ranked), ndcg(held, lambda r: r.score * w[0] + r.a * w[1] + (r.b or 0) * w[2]), ndcg(held, lambda r: r.score)
    assert trees > linear + 0.05 and trees > fused + 0.05


def test_recommend_batch_fills_every_list(spark, small):
    rows = QUERIES["recommend_batch"](spark, small).collect()
    per = Counter(r.user_id for r in rows)
    assert set(per.values()) == {10} and {(r.user_id, r["rank"]) for r in rows} == {(u, k) for u in per for k in range(1, 11)}
    assert len({(r.user_id, r.item_id) for r in rows}) == len(rows) and any(r.anchor is not None for r in rows)


def test_two_tower_learns_and_scores(spark):
    """Two tastes: users like items of one half alone. Loss falls each epoch, scores are u v + b, and lists keep to the half."""
    rng = random.Random(1)
    items = [(i, "movie" if i % 2 else "game", [1.0, 0.0] if i < 20 else [0.0, 1.0]) for i in range(40)] + [(40, "movie", None)]
    history = []
    for u in range(120):
        half = range(20) if u % 2 else range(20, 40)
        history += [(u, i, items[i][1], rng.randint(0, 999), rng.choice([1.0, 0.75])) for i in rng.sample(half, 8)]
        history += [(u, i, items[i][1], rng.randint(0, 999), -1.0) for i in rng.sample([i for i in range(40) if i not in half], 2)]
    df = spark.createDataFrame(history, "user_id long, item_id long, domain string, timestamp long, weight double")
    it = spark.createDataFrame(items, "item_id long, domain string, x array<double>")
    law = two_tower.negatives_law(it, df.where("weight > 0")).collect()
    for kind in ("uniform", "popular"):
        for domain in core.DOMAINS:
            line = sorted((r.low, r.high) for r in law if r.law == kind and r.domain == domain)
            assert line[0][0] == 0 and abs(line[-1][1] - 1) < 1e-12 and all(abs(a[1] - b[0]) < 1e-12 for a, b in zip(line, line[1:]))
    told = two_tower.examples(df, two_tower.negatives_law(it, df.where("weight > 0"))).collect()
    of = {i: d for i, d, _ in items}
    assert len(told) == 120 and all(len(r.negatives) == 16 and {of[n] for n in r.negatives} == {of[r.target]} for r in told)
    assert all(r.target not in {s.item_id for s in r.context} for r in told)
    crossed = [r for r in told if all(of[s.item_id] != of[r.target] for s in r.context)]
    assert 0.3 < len(crossed) / 120 < 0.75
    model = two_tower.fit(df, it, dims=8, epochs=5, batch=16, part_examples=60)
    assert all(a > b for a, b in zip(model.losses, model.losses[1:])), model.losses
    v = {r.item_id: (np.array(r.v), r.b, r.domain) for r in model.vectors().collect()}
    raw = {r.item_id: (np.array(r.e), np.array(r.x)) for r in model.items.collect()}
    assert all(np.allclose(v[i][0], raw[i][0] + raw[i][1] @ model.w[core.DOMAINS.index(v[i][2])]) for i in v) and len(v) == 41
    best = model.best(df, 5).collect()
    for u in (0, 1, 77):
        newest = sorted((h for h in history if h[0] == u), key=lambda h: (-h[3], -h[1]))[:50]
        a = np.array([h[4] * 0.5 ** (k / 20) for k, h in enumerate(newest)])
        mix = np.array([sum(abs(x) for x, h in zip(a, newest) if h[2] == d) for d in core.DOMAINS]) / (np.abs(a).sum() + 1e-6)
        user = sum(x * v[h[1]][0] for x, h in zip(a, newest)) / (np.abs(a).sum() + 1e-6) + mix @ model.d
        want = sorted(((round(float(user @ x + b), 9), i) for i, (x, b, _) in v.items()), key=lambda s: (-s[0], s[1]))[:5]
        got = [(r.score, r.item_id) for r in sorted((r for r in best if r.user_id == u), key=lambda r: r["rank"])]
        assert [i for _, i in got] == [i for _, i in want] and np.allclose([s for s, _ in got], [s for s, _ in want], atol=1e-7)
    inside = [(r.item_id < 20) == bool(r.user_id % 2) for r in best]
    assert sum(inside) / len(inside) > 0.9


@pytest.mark.parametrize("have", [[], [1], [1, 2]])
def test_similarities_of_users_without_vectors(spark, have):
    """A user none of whose titles has a vector makes a group without any: cosines are 0."""
    cands = spark.createDataFrame([(1, 1), (2, 3)], "user_id long, item_id long")
    history = spark.createDataFrame([(1, 2, 1.0), (2, 4, 1.0)], "user_id long, item_id long, weight double")
    vectors = spark.createDataFrame([(i, [1.0, 0.0]) for i in have], "item_id long, v array<double>")
    got = {(r.user_id, r.item_id): r.max_sim_pos for r in features.similarities(cands, history, vectors).collect()}
    assert got == {(1, 1): 1.0 if len(have) == 2 else 0.0, (2, 3): 0.0}
