"""Models, candidates, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import content, core, features, metrics, models, ranking, two_tower
from ..sources.scratch import forget, materialise, written_only
from ..sources.tables import interactions, items, read_table
from .registry import query

LIKES = "{I}, likes AS (SELECT * FROM inter WHERE rating >= 4), pop AS (SELECT item_id, count(*) AS p FROM likes GROUP BY 1)"
CO = LIKES + """, co AS (SELECT a.item_id AS i, b.item_id AS j, count(*) AS c FROM likes a JOIN likes b ON a.user_id = b.user_id AND a.item_id <> b.item_id GROUP BY 1, 2 HAVING count(*) >= 2),
sims AS (SELECT i, j, c / (sqrt(x.p * y.p) + 10) AS sim FROM co JOIN pop x ON i = x.item_id JOIN pop y ON j = y.item_id),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS rank FROM sims) WHERE rank <= 100)"""
HIST = ", hist AS (SELECT user_id, item_id, timestamp, CASE WHEN rating >= 5 THEN 1.0 WHEN rating >= 4 THEN 0.75 ELSE -1.0 END::DOUBLE AS weight FROM inter WHERE rating >= 4 OR rating < 3)"
KNN = CO + HIST + ", scores AS (SELECT user_id, j AS item_id, sum(weight * sim) AS score FROM hist JOIN knn ON item_id = i GROUP BY 1, 2)"
NEW = ", fresh AS (SELECT * FROM scores WHERE abs(score) > 1e-12 AND NOT EXISTS (SELECT 1 FROM inter x WHERE x.user_id = scores.user_id AND x.item_id = scores.item_id))"
BRIDGE = LIKES + """, bridge AS (SELECT user_id FROM likes GROUP BY 1 HAVING count(*) FILTER (domain = 'movie') >= 1 AND count(*) FILTER (domain = 'game') >= 1),
bl AS (SELECT * FROM likes WHERE user_id IN (SELECT user_id FROM bridge)), bp AS (SELECT item_id, count(*) AS p FROM bl GROUP BY 1),
mg AS (SELECT m.item_id AS movie, g.item_id AS game, count(*) AS c FROM bl m JOIN bl g ON m.user_id = g.user_id AND m.domain = 'movie' AND g.domain = 'game' GROUP BY 1, 2 HAVING count(*) >= 3)"""


def _likes(spark: SparkSession, sf: str) -> DataFrame:
    return core.positives(interactions(spark, sf))


def _scores_of(inter: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    return models.score(models.signed_history(inter), models.item_knn(core.positives(inter), pairs=pairs)).where("abs(score) > 1e-12")


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scores_of(interactions(spark, sf))


def recommended(inter: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """The ten best of every user by item neighbours; ``pairs`` of items liked together may be written already."""
    return models.recommend(_scores_of(inter, pairs).withColumn("score", F.round("score", 9)), inter).select("user_id", "item_id", "rank")


@query(f"WITH {CO} SELECT i, j, c FROM co")
def cooccurrence(spark, sf):
    return models.cooccurrence(_likes(spark, sf))


@query(f"WITH {CO} SELECT i, j, sim, rank::INTEGER AS rank FROM knn")
def item_knn(spark, sf):
    return models.item_knn(_likes(spark, sf))


@query(f"WITH {CO} SELECT i, j, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY c DESC, j) AS rank FROM co) WHERE rank <= 5")
def neighbour_topk(spark, sf):
    return core.top(models.cooccurrence(_likes(spark, sf)), ["i"], 5, F.desc("c"), "j").select("i", "j", "rank")


@query(f"WITH {KNN} SELECT user_id, item_id, score FROM scores WHERE abs(score) > 1e-12")
def score_join(spark, sf):
    return _scores(spark, sf)


@query(f"WITH {KNN}{NEW} SELECT user_id, item_id, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM fresh) WHERE rank <= 10")
def recommend_item_knn(spark, sf):
    return recommended(interactions(spark, sf))


@query(f"WITH {KNN}{NEW} SELECT user_id, item_id, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM fresh WHERE item_id NOT IN (SELECT p_partkey FROM part WHERE p_size > 40)) WHERE rank <= 20")
def exclude_history(spark, sf):
    """The best twenty that are neither in the user's history nor blocked, here items after 2010."""
    inter = interactions(spark, sf)
    blocked = items(spark, sf).where("year > 2010").select("item_id")
    scores = _scores(spark, sf).withColumn("score", F.round("score", 9)).join(inter.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti").join(blocked, "item_id", "left_anti")
    return core.top(scores, ["user_id"], 20, F.desc("score"), "item_id").select("user_id", "item_id", "rank")


@query(f"WITH {BRIDGE} SELECT movie, game, c FROM mg")
def bipartite_colikes(spark, sf):
    inter = interactions(spark, sf)
    return models.bipartite(core.positives(inter).join(core.bridge_users(inter), "user_id", "left_semi"))


@query(f"""WITH {BRIDGE}, both_ways AS (SELECT movie AS i, game AS j, c FROM mg UNION ALL SELECT game, movie, c FROM mg),
s AS (SELECT i, j, c / (sqrt(x.p) * pow(y.p, 0.5) + 1e-9) AS sim FROM both_ways JOIN bp x ON i = x.item_id JOIN bp y ON j = y.item_id)
SELECT i, j, sim, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j)::INTEGER AS rank FROM s""")
def copreference(spark, sf):
    return models.copreference(interactions(spark, sf))


@query(f"""WITH {LIKES}, mg AS (SELECT m.item_id AS movie, g.item_id AS game, count(*) AS c FROM likes m JOIN likes g ON m.user_id = g.user_id AND m.domain = 'movie' AND g.domain = 'game' GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT movie, game, c, c * (SELECT count(DISTINCT user_id) FROM likes) / (x.p * y.p) AS lift FROM mg JOIN pop x ON movie = x.item_id JOIN pop y ON game = y.item_id ORDER BY lift DESC, movie, game LIMIT 25""")
def pair_lift(spark, sf):
    return models.pair_lift(_likes(spark, sf), 2, 25)


@query(f"WITH {LIKES}, {{T}} SELECT item_id, ln(1 + coalesce(p, 0)) + 0.5 * len(list_intersect(genres, ['PROMO BRUSHED TIN', 'SMALL PLATED COPPER', 'ECONOMY ANODIZED STEEL'])) AS score FROM items LEFT JOIN pop USING (item_id)")
def popularity_scores(spark, sf):
    """Popularity, and half a point for each theme that a new user asks for and the item has."""
    return models.popularity(_likes(spark, sf), items(spark, sf), ["PROMO BRUSHED TIN", "SMALL PLATED COPPER", "ECONOMY ANODIZED STEEL"])


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v"))


VEC = "{I}" + HIST + """, v AS (SELECT vec_id AS item_id, unnest(embedding)::DOUBLE AS c, generate_subscripts(embedding, 1) AS dim FROM embeddings),
dec AS (SELECT *, weight * pow(0.5, (row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, item_id DESC) - 1) / 20.0) AS a FROM hist),
cells AS (SELECT user_id, dim, sum(a * c) AS x FROM dec JOIN v USING (item_id) GROUP BY 1, 2), len AS (SELECT user_id, sqrt(sum(x * x)) AS l FROM cells GROUP BY 1),
prof AS (SELECT user_id, dim, x / greatest(l, 1e-12) AS x FROM cells JOIN len USING (user_id))"""


@query(f"WITH {VEC} SELECT user_id, dim::INTEGER AS dim, round(x, 5) + 0::DOUBLE AS x FROM prof")
def signed_vector_mean(spark, sf):
    inter = interactions(spark, sf)
    rows = models.profiles(models.signed_history(inter), _vectors(spark, sf))
    return rows.select("user_id", (F.col("dim") + 1).alias("dim"), (F.round("x", 5) + 0.0).alias("x"))


@query(f"WITH {VEC}, s AS (SELECT user_id, v.item_id, round(sum(x * c), 9) AS score FROM prof JOIN v USING (dim) GROUP BY 1, 2) SELECT user_id, item_id, rank::INTEGER AS rank, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM s) WHERE rank <= 20")
def content_scores(spark, sf):
    inter = interactions(spark, sf)
    best = models.best_by_vector(models.profile_vectors(models.signed_history(inter), _vectors(spark, sf)), _vectors(spark, sf), 20)
    return best.select("user_id", "item_id", "rank", F.round("score", 5).alias("score"))


@query(f"WITH {VEC.replace('FROM dec JOIN', 'FROM dec JOIN liked USING (user_id, item_id) JOIN')}, s AS (SELECT user_id, v.item_id, round(sum(x * c), 9) AS score FROM prof JOIN v USING (dim) GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM s) SELECT user_id, item_id, rank::INTEGER AS rank FROM t WHERE rank <= 10 AND score > 0.3".replace("dec AS (", "liked AS (SELECT user_id, item_id FROM inter WHERE rating >= 4), dec AS ("))
def semantic_scores(spark, sf):
    """By sentence vectors of what a user likes: those that are close, ten at most."""
    inter = interactions(spark, sf)
    best = models.best_by_vector(models.profile_vectors(models.signed_history(inter), _vectors(spark, sf), liked_only=True), _vectors(spark, sf), 10)
    return best.where("score > 0.3").select("user_id", "item_id", "rank")


@query("SELECT a.vec_id AS i, b.vec_id AS j, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0")
def dense_score(spark, sf):
    """The products of one vector in twenty with all of them."""
    v = read_table(spark, sf, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return models.products(v.where("id % 20 = 0"), v)


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS length FROM embeddings")
def vector_math(spark, sf):
    return read_table(spark, sf, "embeddings").select("vec_id", F.round(core.norm(F.col("embedding")), 6).alias("length"))


@query(r"""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}'), lambda x: x NOT IN ('the', 'and', 'of', 'to', 'der', 'die', 'le', 'la')) AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS term FROM w UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM documents), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
raw AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), n WHERE df >= 2 AND df <= 0.5 * n),
l AS (SELECT doc_id, sqrt(sum(w * w)) AS l FROM raw GROUP BY 1) SELECT doc_id, count(*) AS n_terms, round(max(w / l), 6) AS top FROM raw JOIN l USING (doc_id) GROUP BY 1""")
def content_terms(spark, sf):
    """TF-IDF of words and word pairs: how many terms a document has and the largest weight among them."""
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    rows = models.tf_idf(docs, ["the", "and", "of", "to", "der", "die", "le", "la"])
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.round(F.max("weight"), 6).alias("top"))


def _item_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Items with their text and themes: title, type and maker, and the words of the type."""
    return items(spark, sf).select("item_id", F.concat_ws(". ", "title", F.array_join("genres", ", "), "creator").alias("text"), F.split(F.col("genres")[0], " ").alias("themes"))


def _content_model(spark: SparkSession, sf: str) -> tuple[DataFrame, content.ContentModel]:
    rows = _item_texts(spark, sf)
    themes = sorted(r["t"] for r in rows.select(F.explode("themes").alias("t")).distinct().limit(1_000).collect())  # types are made of fifteen words
    return rows, content.fit_content(rows, ["the", "and", "of", "to"], themes, "item_id")


@query()
def content_embeddings(spark, sf):
    """Every item's vector: the text's projection on the singular vectors of all texts, and its themes."""
    rows, model = _content_model(spark, sf)
    return model.transform(rows, themes_col="themes").select("item_id", "vector")


@query()
def content_query(spark, sf):
    """The twenty items nearest to wishes in free words and themes, here one for each maker: its name and the type it makes most."""
    rows, model = _content_model(spark, sf)
    kinds = core.top(items(spark, sf).groupBy("creator", F.col("genres")[0].alias("kind")).count(), ["creator"], 1, F.desc("count"), "kind")
    asked = kinds.select("creator", F.concat_ws(" ", F.lit("something by"), "creator").alias("words"), F.split("kind", " ").alias("themes"))
    asked = asked.withColumn("text", F.concat_ws(" ", "words", F.array_join("themes", " ")))
    wishes = model.transform(asked, themes_col="themes").select(F.xxhash64("creator").alias("user_id"), "creator", F.posexplode("vector").alias("dim", "x"))
    wishes = materialise(wishes)
    best = models.best_by_vector(wishes.drop("creator"), model.transform(rows, themes_col="themes").select("item_id", F.col("vector").alias("v")), 20)
    return best.join(wishes.select("user_id", "creator").distinct(), "user_id").select("creator", "item_id", "rank", F.round("score", 6).alias("score"))


@query()
def encode_texts(spark, sf):
    """Vectors of the items' texts by an encoder that each task makes for itself."""
    return content.encode_texts(_item_texts(spark, sf)).select("item_id", "vector")


def _als(spark: SparkSession, sf: str, domain: str | None) -> DataFrame:
    likes = _likes(spark, sf)
    model = models.als(likes.where(F.col("domain") == domain) if domain else likes)
    users, titles = (f.select(F.col("id").alias(name), F.col("features").alias("v")) for f, name in ((model.userFactors, "user_id"), (model.itemFactors, "item_id")))
    return models.best_by_vector(users, titles, 10, single=True).select("user_id", "item_id", "score")


@query()
def als_joint(spark, sf):
    return _als(spark, sf, None)


@query()
def als_movie(spark, sf):
    return _als(spark, sf, "movie")


@query()
def als_game(spark, sf):
    return _als(spark, sf, "game")


@query()
def als_fold_in(spark, sf):
    inter = interactions(spark, sf)
    model = models.als(core.positives(inter))
    return models.fold_in(models.signed_history(inter), model.itemFactors)


def _signed(inter: DataFrame) -> DataFrame:
    return inter.select("user_id", "item_id", "domain", "timestamp", core.signed_weight(F.col("rating")).alias("weight")).where("weight <> 0")


def _tower_items(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).select("item_id", "domain").join(_vectors(spark, sf).withColumnRenamed("v", "x"), "item_id", "left")


_DIGIT = "('0x' || substr(md5({}), 1, 12))::BIGINT / 281474976710656.0::DOUBLE"


@query("WITH {I}, h AS (SELECT user_id, item_id, domain, rating >= 4 AS liked FROM inter WHERE rating >= 4 OR rating < 3), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY " + _DIGIT.format("'target|0|' || user_id || '|' || item_id") + """, item_id) AS pick FROM h WHERE liked),
t AS (SELECT user_id, item_id AS target, domain AS dom FROM k WHERE pick = 1), o AS (SELECT h.user_id, target, domain <> dom AS other, """ + _DIGIT.format("'cross|0|' || h.user_id") + """ < 0.5 AND bool_or(domain <> dom) OVER (PARTITION BY h.user_id) AS alone FROM h JOIN t ON h.user_id = t.user_id WHERE item_id <> target)
SELECT user_id, target, least(count(*), 50)::INTEGER AS n_context, 16::INTEGER AS n_negatives FROM o WHERE other OR NOT alone GROUP BY 1, 2""")
def two_tower_examples(spark, sf):
    history = materialise(_signed(interactions(spark, sf)))
    law = two_tower.negatives_law(items(spark, sf), history.where("weight > 0"))
    return two_tower.examples(history, law).select("user_id", "target", F.size("context").alias("n_context"), F.size("negatives").alias("n_negatives"))


@query()
def two_tower_fit(spark, sf):
    """Every item's vector and bias after two epochs."""
    return two_tower.fit(materialise(_signed(interactions(spark, sf))), _tower_items(spark, sf), epochs=2).vectors().select("item_id", F.col("v").alias("vector"), F.col("b").alias("bias"))


@query()
def two_tower_scores(spark, sf):
    """The ten best items of each user by the model."""
    history = materialise(_signed(interactions(spark, sf)))
    return two_tower.fit(history, _tower_items(spark, sf), epochs=2).best(history, 10).select("user_id", "item_id", "score", "rank")


@query(f"""WITH {CO}, z AS (SELECT i, j, (sim - avg(sim) OVER w) / nullif(stddev_pop(sim) OVER w, 0) AS z FROM knn WINDOW w AS (PARTITION BY i))
SELECT i, j, rank::INTEGER AS rank FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY round(coalesce(z, 0), 6) DESC, j) AS rank FROM z) WHERE rank <= 5""")
def similar_items(spark, sf):
    knn = models.item_knn(_likes(spark, sf)).drop("rank")
    z = knn.withColumn("z", F.round(core.zscore(F.col("sim"), ["i"]), 6))
    return core.top(z, ["i"], 5, F.desc("z"), "j").select("i", "j", "rank")


SRC = KNN + """, popsrc AS (SELECT user_id, pop.item_id, ln(1 + p) AS score FROM (SELECT DISTINCT user_id FROM inter), (SELECT * FROM pop ORDER BY p DESC, item_id LIMIT 50) pop),
allsrc AS (SELECT user_id, item_id, 'item_knn' AS source, round(score, 9) AS score FROM scores WHERE abs(score) > 1e-12 UNION ALL SELECT user_id, item_id, 'popularity', round(score, 9) FROM popsrc),
unseen AS (SELECT * FROM allsrc a WHERE NOT EXISTS (SELECT 1 FROM inter x WHERE x.user_id = a.user_id AND x.item_id = a.item_id)),
cand AS (SELECT user_id, item_id, list_sort(list(source)) AS sources FROM (SELECT *, row_number() OVER (PARTITION BY user_id, source ORDER BY score DESC, item_id) AS r FROM unseen) WHERE r <= CASE WHEN source = 'popularity' THEN 50 ELSE 100 END GROUP BY 1, 2)"""
RRF = SRC + """, rk AS (SELECT *, least(row_number() OVER (PARTITION BY user_id, source ORDER BY score DESC, item_id) - 1, 1000) AS rank FROM allsrc WHERE score <> 0),
kn AS (SELECT user_id, item_id, sum(1 / (60 + rank)) AS s, count(*) AS n FROM rk GROUP BY 1, 2),
fused AS (SELECT cand.user_id, cand.item_id, sources, coalesce(s, 0) + (2 - coalesce(n, 0)) / 1060.0 AS score FROM cand LEFT JOIN kn USING (user_id, item_id))"""


def _sources_of(inter: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """``user_id, item_id, source, score`` of neighbours and popularity; ``pairs`` of items liked together may be written already."""
    best = core.positives(inter).groupBy("item_id").agg(F.count("*").alias("p")).orderBy(F.desc("p"), "item_id").limit(50)  # fifty rows, whatever the input
    popular = inter.select("user_id").distinct().crossJoin(F.broadcast(best)).select("user_id", "item_id", F.lit("popularity").alias("source"), F.round(F.log1p(F.col("p").cast("double")), 9).alias("score"))
    near = models.score(models.signed_history(inter), models.item_knn(core.positives(inter), pairs=pairs)).where("abs(score) > 1e-12")
    return near.select("user_id", "item_id", F.lit("item_knn").alias("source"), F.round("score", 9).alias("score")).unionByName(popular)


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    return _sources_of(materialise(interactions(spark, sf)))


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.candidates(_sources(spark, sf), interactions(spark, sf))


def _fused(spark: SparkSession, sf: str) -> DataFrame:
    inter = materialise(interactions(spark, sf))  # read for each source and once more
    return ranking.fused(materialise(_sources_of(inter)), inter, ["item_knn", "popularity"])


@query(f"WITH {SRC} SELECT user_id, item_id, array_to_string(sources, ',') AS sources FROM cand")
def candidates(spark, sf):
    return _candidates(spark, sf).withColumn("sources", F.array_join("sources", ","))


@query(f"WITH {SRC} SELECT user_id, item_id, len(sources)::INTEGER AS n_sources, sources[1] AS first_source FROM cand")
def candidate_union(spark, sf):
    return _candidates(spark, sf).select("user_id", "item_id", F.size("sources").alias("n_sources"), F.element_at("sources", 1).alias("first_source"))


@query(f"WITH {SRC} SELECT user_id, source, item_id, least(row_number() OVER (PARTITION BY user_id, source ORDER BY score DESC, item_id) - 1, 1000)::INTEGER AS rank FROM allsrc WHERE score <> 0")
def retriever_ranks(spark, sf):
    return ranking.source_ranks(_sources(spark, sf)).select("user_id", "source", "item_id", "rank")


@query(f"WITH {RRF} SELECT user_id, item_id, score FROM fused")
def rrf(spark, sf):
    return _fused(spark, sf).select("user_id", "item_id", "score")


@query(f"""WITH {RRF}, q AS (SELECT user_id, item_id, round(score, 9) AS score, len(sources) AS sim FROM fused),
b AS (SELECT user_id, item_id, 0.2 * (row_number() OVER (PARTITION BY user_id ORDER BY score, item_id) - 1) / greatest(count(*) OVER (PARTITION BY user_id) - 1, 1) + 0.8 * (row_number() OVER (PARTITION BY user_id ORDER BY sim, item_id) - 1) / greatest(count(*) OVER (PARTITION BY user_id) - 1, 1) AS blended FROM q)
SELECT user_id, item_id, round(blended, 9) AS blended FROM b""")
def taste_blend(spark, sf):
    rows = _fused(spark, sf).select("user_id", "item_id", F.round("score", 9).alias("score"), F.size("sources").alias("sim"))
    return ranking.taste_blend(rows, 0.8).select("user_id", "item_id", F.round("blended", 9).alias("blended"))


@query(f"""WITH {RRF}, q AS (SELECT user_id, item_id, score, (item_id % 6 = 0)::INT AS m FROM fused) SELECT user_id, item_id, score + CASE WHEN count(*) FILTER (m > 0) OVER (PARTITION BY user_id) >= 5 THEN 1000.0 * m ELSE 0 END AS tiered FROM q""")
def intent_tiers(spark, sf):
    rows = _fused(spark, sf).withColumn("n_match", (F.col("item_id") % 6 == 0).cast("int"))
    return ranking.intent_tiers(rows, 5).select("user_id", "item_id", "tiered")


@query(f"""WITH {RRF}, sh AS (SELECT user_id, avg((domain = 'movie')::INT) AS ms FROM inter GROUP BY 1),
q AS (SELECT f.user_id, item_id, CASE WHEN item_id % 5 < 3 THEN 'movie' ELSE 'game' END AS domain, round(score, 9) AS score, round_even(greatest(least(ms, 0.7), 0.3) * 10, 0)::INT AS m FROM fused f JOIN sh USING (user_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, domain ORDER BY score DESC, item_id) <= CASE WHEN domain = 'movie' THEN m ELSE 10 - m END AS ins FROM q),
s AS (SELECT *, 10 - count(*) FILTER (ins) OVER (PARTITION BY user_id) AS short, row_number() OVER (PARTITION BY user_id, ins ORDER BY score DESC, item_id) AS k FROM r)
SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id)::INTEGER AS rank FROM s WHERE ins OR k <= short""")
def domain_quota(spark, sf):
    share = interactions(spark, sf).groupBy("user_id").agg(F.avg((F.col("domain") == "movie").cast("int")).alias("movie_share"))
    rows = _fused(spark, sf).select("user_id", "item_id", F.when(F.col("item_id") % 5 < 3, "movie").otherwise("game").alias("domain"), F.round("score", 9).alias("score"))
    return ranking.domain_quota(rows, share, 10).select("user_id", "item_id", "rank")


@query(f"WITH {SRC}, {{T}}, w AS (SELECT DISTINCT user_id, genres[1] AS g FROM inter JOIN items USING (item_id) WHERE rating >= 5) SELECT cand.user_id, cand.item_id, count(w.g) AS n_match FROM cand JOIN items USING (item_id) LEFT JOIN w ON w.user_id = cand.user_id AND list_contains(genres, g) GROUP BY 1, 2")
def theme_match(spark, sf):
    """How many of the themes that a user asks for each candidate carries: here themes of what they rated best."""
    it = items(spark, sf).select("item_id", F.explode(F.array_distinct("genres")).alias("g"))
    wanted = interactions(spark, sf).where("rating >= 5").join(it, "item_id").select("user_id", "g").distinct().withColumn("hit", F.lit(1))
    return _candidates(spark, sf).select("user_id", "item_id").join(it, "item_id", "left").join(wanted, ["user_id", "g"], "left").groupBy("user_id", "item_id").agg(F.count("hit").alias("n_match"))


SOURCES = ["item_knn", "popularity"]
_HIST = """, hf AS (SELECT user_id, count(*)::DOUBLE AS n_hist, count(*) FILTER (weight > 0) AS n_pos, count(*) FILTER (weight > 0 AND d = 'movie') AS n_movie, count(*) FILTER (weight > 0 AND d = 'game') AS n_game, count(*) FILTER (weight < 0)::DOUBLE AS n_dislikes,
 median(year) FILTER (weight > 0) AS mid, list_distinct(list(creator) FILTER (weight > 0)) AS creators, list_distinct(flatten(list(themes[1:3]) FILTER (weight < 0))) AS avoided
 FROM hist JOIN (SELECT item_id, domain AS d, year, creator, string_split(genres[1], ' ') AS themes FROM items) USING (item_id) GROUP BY 1),
pt AS (SELECT user_id, theme, count(*) AS n FROM (SELECT user_id, unnest(string_split(genres[1], ' ')[1:4]) AS theme FROM hist JOIN items USING (item_id) WHERE weight > 0) GROUP BY 1, 2),
pf AS (SELECT user_id, list(theme) AS known, sum(n) AS total, list(theme ORDER BY n DESC, theme)[1:6] AS top FROM pt GROUP BY 1),
st AS (SELECT item_id, count(*) FILTER (rating >= 4) AS pop, avg(rating) AS m, count(*) AS n FROM inter GROUP BY 1),
e AS (SELECT vec_id AS item_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM embeddings),
sm AS (SELECT c.user_id, c.item_id, max(x) FILTER (weight > 0) AS hi, avg(x) FILTER (weight > 0) AS mean, max(x) FILTER (weight < 0) AS lo
 FROM (SELECT c.user_id, c.item_id, weight, CASE WHEN a.l > 0 AND b.l > 0 THEN list_dot_product(a.v, b.v) / (a.l * b.l) ELSE 0 END AS x FROM cand c JOIN hist h USING (user_id) LEFT JOIN e a ON a.item_id = c.item_id LEFT JOIN e b ON b.item_id = h.item_id) c GROUP BY 1, 2),
cl AS (SELECT c.user_id, c.item_id, max(co.c) AS hi, sum(co.c) AS total FROM cand c JOIN hist h ON h.user_id = c.user_id AND weight > 0 JOIN co ON i = h.item_id AND j = c.item_id GROUP BY 1, 2),
sp AS (SELECT c.user_id, c.item_id, coalesce(max(a.score) FILTER (a.source = 'item_knn'), 0) AS item_knn_score, coalesce(max(a.score) FILTER (a.source = 'popularity'), 0) AS popularity_score,
 ln(1 + coalesce(min(a.rank) FILTER (a.source = 'item_knn'), 1000)) AS item_knn_rank, ln(1 + coalesce(min(a.rank) FILTER (a.source = 'popularity'), 1000)) AS popularity_rank FROM cand c LEFT JOIN rk a ON a.user_id = c.user_id AND a.item_id = c.item_id GROUP BY 1, 2),
fz AS (SELECT *, CASE WHEN stddev_pop(item_knn_score) OVER w > 0 THEN (item_knn_score - avg(item_knn_score) OVER w) / stddev_pop(item_knn_score) OVER w ELSE 0 END AS item_knn_z,
 CASE WHEN stddev_pop(popularity_score) OVER w > 0 THEN (popularity_score - avg(popularity_score) OVER w) / stddev_pop(popularity_score) OVER w ELSE 0 END AS popularity_z FROM sp WINDOW w AS (PARTITION BY user_id)),
own AS (SELECT c.user_id, c.item_id, len(sources) AS n_sources, domain, year, creator, list_distinct(string_split(genres[1], ' ')) AS own FROM cand c JOIN items USING (item_id)),
af AS (SELECT o.user_id, o.item_id, sum(pt.n) AS n FROM (SELECT user_id, item_id, unnest(own) AS theme FROM own) o JOIN pt ON pt.user_id = o.user_id AND pt.theme = o.theme GROUP BY 1, 2)"""


def _history_inputs(spark: SparkSession, sf: str, inter: DataFrame, pairs: DataFrame | None = None) -> dict[str, DataFrame]:
    """What features are made of besides candidates and scores."""
    return {
        "history": models.signed_history(inter), "items": items(spark, sf).withColumn("themes", F.split(F.col("genres")[0], " ")), "stats": core.item_stats(inter),
        "vectors": _vectors(spark, sf), "pairs": models.cooccurrence(core.positives(inter)) if pairs is None else pairs,
    }


def _features(spark: SparkSession, sf: str) -> DataFrame:
    with written_only(spark):
        inter = materialise(interactions(spark, sf))
        scores = materialise(_sources_of(inter))
    return features.features(ranking.candidates(scores, inter), scores, SOURCES, **_history_inputs(spark, sf, inter))


@query(f"""WITH {RRF}, {{T}}{_HIST}
SELECT fz.user_id, fz.item_id, item_knn_score, item_knn_rank, round(item_knn_z, 5) + 0::DOUBLE AS item_knn_z, popularity_score, popularity_rank, round(popularity_z, 5) + 0::DOUBLE AS popularity_z, n_sources::DOUBLE AS n_sources, (domain = 'game')::INT::DOUBLE AS is_game,
 coalesce(CASE WHEN domain = 'game' THEN n_movie ELSE n_game END, 0) / greatest(coalesce(n_pos, 0), 1) AS cross_domain_frac, coalesce(n_hist, 0) AS n_hist, coalesce(CASE WHEN domain = 'game' THEN n_game ELSE n_movie END, 0)::DOUBLE AS n_hist_same,
 coalesce(CASE WHEN domain = 'game' THEN n_movie ELSE n_game END, 0)::DOUBLE AS n_hist_other, coalesce(n_dislikes, 0) AS n_dislikes, ln(1 + coalesce(pop, 0)) AS log_pop,
 coalesce((m * st.n + (SELECT avg(m) FROM st) * 10) / (st.n + 10), (SELECT avg(m) FROM st)) AS bayes_rating, ln(1 + coalesce(st.n, 0)) AS log_rating_count, coalesce(af.n / pf.total, 0) AS theme_affinity,
 CASE WHEN top IS NULL THEN 0 ELSE len(list_intersect(own, top)) / len(list_distinct(list_concat(own, top))) END AS theme_jaccard, coalesce(len(list_intersect(own, avoided)) / len(own), 0) AS disliked_theme_overlap,
 coalesce(round(sm.hi, 5), 0) + 0::DOUBLE AS max_sim_pos, coalesce(round(sm.mean, 5), 0) + 0::DOUBLE AS mean_sim_pos, coalesce(round(sm.lo, 5), 0) + 0::DOUBLE AS max_sim_neg, coalesce(cl.hi, 0)::DOUBLE AS max_colikes, ln(1 + coalesce(cl.total, 0)) AS log_sum_colikes,
 abs(year - mid)::DOUBLE AS year_gap, coalesce(list_contains(creators, creator), false)::INT::DOUBLE AS creator_match, (coalesce(n_hist, 0) = 0)::INT::DOUBLE AS cold_start
FROM fz JOIN own USING (user_id, item_id) LEFT JOIN hf ON hf.user_id = fz.user_id LEFT JOIN pf ON pf.user_id = fz.user_id LEFT JOIN st ON st.item_id = fz.item_id LEFT JOIN sm ON sm.user_id = fz.user_id AND sm.item_id = fz.item_id
 LEFT JOIN cl ON cl.user_id = fz.user_id AND cl.item_id = fz.item_id LEFT JOIN af ON af.user_id = fz.user_id AND af.item_id = fz.item_id""")
def rank_features(spark, sf):
    """27 columns for each candidate of two sources; a source more is three columns more."""
    rounded = {c: F.round(c, 5) + 0.0 for c in (  # no negative zeros
        "item_knn_z", "popularity_z", "max_sim_pos", "mean_sim_pos", "max_sim_neg")}
    return _features(spark, sf).withColumns(rounded)


RANKED = features.names(SOURCES)


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    """All candidates of training histories with their features and ``label`` 1 for those among the validation rows; queries without
    a hit among their candidates go. ``score`` is the fused one, the order before ranking."""
    with written_only(spark):
        parts = materialise(core.chronological_split(interactions(spark, sf)).select("user_id", "item_id", "domain", "rating", "timestamp", "part"))
        train, hits = parts.where("part = 'train'").drop("part"), core.positives(parts.where("part = 'val'")).select("user_id", "item_id").withColumn("label", F.lit(1))
        scores = materialise(_sources_of(train))
        cands = materialise(ranking.candidates(scores, train))
        asked = materialise(cands.join(hits, ["user_id", "item_id"], "left_semi").select("user_id").distinct())
        cands, scores = cands.join(asked, "user_id", "left_semi"), materialise(scores.join(asked, "user_id", "left_semi"))
        fused = ranking.rrf(cands, ranking.source_ranks(scores), SOURCES).join(hits, ["user_id", "item_id"], "left").na.fill(0, ["label"])
        kept = materialise(fused)
        of = _history_inputs(spark, sf, train)
        of["history"] = of["history"].join(asked, "user_id", "left_semi")
    told = features.features(kept.select("user_id", "item_id", "sources"), scores, SOURCES, **of)
    return kept.select("user_id", "item_id", "score", "label").join(told, ["user_id", "item_id"])


@query()
def rank_dataset(spark, sf):
    return _labelled(spark, sf)


@query()
def rank_model(spark, sf):
    """Boosted trees over all features, stopped by held-back queries; the ten best of each query."""
    rows = materialise(_labelled(spark, sf))
    scored = ranking.tree_scores(rows, ranking.tree_ranker(rows, RANKED), RANKED)
    return core.top(scored.withColumn("held_back", ranking.held_back(F.col("user_id"))), ["user_id"], 10, F.desc("ranked"), "item_id").select("user_id", "item_id", "ranked", "rank", "label", "held_back")


@query()
def feature_importance(spark, sf):
    """Each feature's share in what the trees' splits gain."""
    model = ranking.tree_ranker(materialise(_labelled(spark, sf)), RANKED)
    return spark.createDataFrame([(f, float(x)) for f, x in zip(RANKED, model.featureImportances.toArray(), strict=True)], "feature string, importance double")


def _cross_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of training histories with labels; hold-out users are asked for the domain that they have no history in."""
    from .evaluation import _train_of

    inter = materialise(interactions(spark, sf))
    train = materialise(inter.join(_train_of(inter).select("user_id", "item_id"), ["user_id", "item_id"], "left_semi"))
    hidden = metrics.holdout_groups(inter).select("user_id", F.when(F.col("grp") % 2 == 0, "game").otherwise("movie").alias("asked"))
    scores = models.score(models.signed_history(train), models.item_knn(core.positives(train))).where("abs(score) > 1e-12").join(train.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    scores = scores.join(items(spark, sf).select("item_id", "domain"), "item_id").join(hidden, "user_id", "left").where("asked is null or domain = asked")
    own = train.groupBy("user_id", "domain").agg(F.count("*").cast("double").alias("n_hist_same"))
    pop = core.positives(train).groupBy("item_id").agg(F.log1p(F.count("*").cast("double")).alias("log_popularity"))
    hit = core.positives(inter).join(train.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti").select("user_id", "item_id").withColumn("label", F.lit(1))
    best = core.top(scores, ["user_id"], 50, F.desc("score"), "item_id")
    rows = best.join(own, ["user_id", "domain"], "left").join(pop, "item_id", "left").join(hit, ["user_id", "item_id"], "left").na.fill(0, ["n_hist_same", "log_popularity", "label"])
    return rows.select("user_id", "item_id", "score", "log_popularity", F.log1p(F.col("rank").cast("double")).alias("log_rank"), "n_hist_same", "label")


@query()
def routed_rank(spark, sf):
    """Queries whose candidates all lie in a domain without history go to a model fitted on such queries, others to the main one."""
    rows = materialise(ranking.routed(_cross_cases(spark, sf)))
    return ranking.routed_rank(rows, ["score", "log_popularity", "log_rank"], 10).select("user_id", "item_id", "route", "rank")


@query()
def train_report(spark, sf):
    """What the ranker is fitted on: rows, queries, the share of relevant rows."""
    rows = _labelled(spark, sf)
    return rows.agg(F.count("*").cast("double").alias("rows"), F.countDistinct("user_id").cast("double").alias("queries"), F.avg("label").alias("positive_rate")).unpivot([], ["rows", "queries", "positive_rate"], "metric", "value")


def _diverse(spark: SparkSession, sf: str) -> DataFrame:
    v = _vectors(spark, sf)
    rows = _fused(spark, sf).join(v, "item_id", "left").join(items(spark, sf).select("item_id", "creator", "domain"), "item_id")
    return rows.select("user_id", "item_id", "domain", "score", "creator", "v")


@query()
def mmr_diversify(spark, sf):
    return ranking.mmr(_diverse(spark, sf), 5)


@query()
def quota_lists(spark, sf):
    """Diverse lists of each domain, of which each user gets as many as the shares of the domains in the history say."""
    share = interactions(spark, sf).groupBy("user_id").agg(F.avg((F.col("domain") == "movie").cast("int")).alias("movie_share"))
    return ranking.quota_lists(_diverse(spark, sf), share, 10)


@query()
def recommend_batch(spark, sf):
    """Ten items for every user: candidates of all sources, trees over all features, blend with the taste vector, diverse lists by
    quota, and for each item the liked title that most people like with it."""
    with written_only(spark):
        rows = materialise(_labelled(spark, sf))
    model = ranking.tree_ranker(rows, RANKED)
    with written_only(spark):
        inter, it = materialise(interactions(spark, sf)), items(spark, sf)
        pairs = materialise(models.cooccurrence(core.positives(inter)))  # read for neighbours, features and reasons
        scores, of = materialise(_sources_of(inter, pairs)), _history_inputs(spark, sf, inter, pairs)
        told = features.features(ranking.candidates(scores, inter), scores, SOURCES, **of)
        forget(scores)
        history, vectors = of["history"], of["vectors"]
        ranked = ranking.tree_scores(told, model, RANKED, "score").select("user_id", "item_id", "score")
        near = materialise(ranked.join(it.select("item_id", "domain", "creator"), "item_id").join(vectors, "item_id", "left"))
        forget(told)
        taste = materialise(models.profile_vectors(history, vectors).withColumnRenamed("v", "p"))
        parts = core.parts_of(near, near.count())
        rows = near.repartition(parts, "user_id").join(taste.repartition(parts, "user_id"), "user_id", "left")
        rows = rows.withColumn("sim", F.coalesce(core.dot(F.col("p"), F.col("v")), F.lit(0.0))).drop("p")
        blended = materialise(ranking.taste_blend(rows, 0.5).drop("score", "sim").withColumnRenamed("blended", "score"))
        forget(near)
        share = inter.groupBy("user_id").agg(F.avg((F.col("domain") == "movie").cast("int")).alias("movie_share"))
        lists = materialise(ranking.quota_lists(blended, share, 10))
        forget(blended)
    liked = history.where("weight > 0").select("user_id", F.col("item_id").alias("anchor"))
    both = lists.select("user_id", "item_id").join(liked, "user_id").join(pairs, (F.col("anchor") == F.col("i")) & (F.col("item_id") == F.col("j")))
    why = core.latest(both, ["user_id", "item_id"], F.desc("c"), "anchor").select("user_id", "item_id", "anchor", F.col("c").alias("liked_together"))
    return lists.join(why, ["user_id", "item_id"], "left").select("user_id", "item_id", "domain", "rank", "anchor", "liked_together")
