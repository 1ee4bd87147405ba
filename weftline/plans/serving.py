"""Explanations, franchise serving, new titles, versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import core, models, works
from ..operators import explain as explaining
from ..operators.publish import load_version, publish_version
from ..sources.scratch import materialise, shared_path
from ..sources.tables import interactions, items, read_table
from .registry import query
from .retrieval import KNN, NEW, recommended

EVIDENCE = f"""WITH {KNN}{NEW}, {{T}}, rec AS (SELECT user_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS r FROM fresh) WHERE r <= 10),
tt AS (SELECT item_id, unnest(string_split(genres[1] || ' ' || title, ' ')) AS theme, generate_subscripts(string_split(genres[1] || ' ' || title, ' '), 1) AS pos FROM items),
df AS (SELECT theme, count(DISTINCT item_id) / (SELECT count(*) FROM items) AS share FROM tt GROUP BY 1),
pr AS (SELECT user_id, theme, count(*) AS n FROM hist JOIN tt USING (item_id) WHERE weight > 0 AND pos <= 4 GROUP BY 1, 2),
six AS (SELECT user_id, theme FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, theme) AS r FROM pr) WHERE r <= 6), n6 AS (SELECT user_id, count(*) AS n6 FROM six GROUP BY 1),
bad AS (SELECT DISTINCT user_id, theme FROM hist JOIN tt USING (item_id) WHERE weight < 0 AND pos <= 3),
own AS (SELECT rec.user_id, rec.item_id, t.theme, share, pr.theme IS NOT NULL AS known, six.theme IS NOT NULL AS main, bad.theme IS NOT NULL AS low FROM rec JOIN (SELECT DISTINCT item_id, theme FROM tt) t USING (item_id)
 JOIN df ON df.theme = t.theme LEFT JOIN pr ON pr.user_id = rec.user_id AND pr.theme = t.theme LEFT JOIN six ON six.user_id = rec.user_id AND six.theme = t.theme LEFT JOIN bad ON bad.user_id = rec.user_id AND bad.theme = t.theme),
tags AS (SELECT user_id, item_id, coalesce(list({{'share': share, 'theme': theme}} ORDER BY share, theme) FILTER (known), [])[1:5] AS rare,
 coalesce(list(theme ORDER BY theme) FILTER (low), []) AS disliked, CASE WHEN any_value(coalesce(n6, 0)) = 0 THEN 0 ELSE round(count(*) FILTER (main) / (count(*) + any_value(n6) - count(*) FILTER (main)), 3) END AS overlap FROM own LEFT JOIN n6 USING (user_id) GROUP BY 1, 2),
u AS (SELECT vec_id AS item_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM embeddings),
facts AS (SELECT rec.user_id, rec.item_id, h.item_id AS anchor, coalesce(c, 0) AS co, CASE WHEN a.l > 0 AND b.l > 0 THEN round(list_dot_product(a.v, b.v) / (a.l * b.l), 6) ELSE 0 END AS sim FROM rec JOIN hist h ON h.user_id = rec.user_id AND weight > 0
 LEFT JOIN co ON i = h.item_id AND j = rec.item_id LEFT JOIN u a ON a.item_id = rec.item_id LEFT JOIN u b ON b.item_id = h.item_id),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY round(ln(1 + co) + 2 * sim, 6) DESC, anchor) AS r FROM facts),
best AS (SELECT user_id, item_id, max(co) AS co_likes, max(sim) AS similarity, string_agg(anchor::VARCHAR, ',' ORDER BY r) FILTER (r <= 3) AS anchors, arg_max(r, (co, -r)) FILTER (r <= 3) AS rc, arg_max(r, (sim, -r)) FILTER (r <= 3) AS rs,
 max(co) FILTER (r <= 3) AS tc, max(sim) FILTER (r <= 3) AS ts FROM f GROUP BY 1, 2)"""


def _evidence(spark, sf):
    """Evidence for the ten best of every user by item neighbours; themes are the words of an item's type and title."""
    inter, it = materialise(interactions(spark, sf)), items(spark, sf)
    pairs = materialise(models.cooccurrence(core.positives(inter)))  # for neighbours and for what liked titles have in common
    vectors = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v"))
    themes = it.select("item_id", F.split(F.concat_ws(" ", F.col("genres")[0], "title"), " ").alias("themes"))
    return explaining.evidence(materialise(recommended(inter, pairs)), models.signed_history(inter), themes, pairs, vectors, it)


@query(EVIDENCE + """ SELECT user_id, item_id, array_to_string(list_transform(rare, lambda x: x.theme), ',') AS shared, overlap::DOUBLE AS overlap, coalesce(co_likes, 0) AS co_likes, coalesce(similarity, 0) AS similarity, anchors, array_to_string(disliked, ',') AS disliked,
CASE WHEN (best.co_likes >= 20 OR best.similarity >= 0.6) AND len(rare) > 0 THEN 'high' WHEN best.co_likes >= 5 OR best.similarity >= 0.4 OR len(rare) > 0 THEN 'medium' ELSE 'low' END AS confidence FROM tags LEFT JOIN best USING (user_id, item_id)""")
def explain(spark, sf):
    ids = F.array_join(F.transform("anchors", lambda s: s["anchor"].cast("string")), ",").alias("anchors")
    shared = F.array_join(F.transform("shared", lambda s: s["theme"]), ",").alias("shared")
    return _evidence(spark, sf).select("user_id", "item_id", shared, "overlap", "co_likes", "similarity", ids, F.array_join("disliked", ",").alias("disliked"), "confidence")


@query(EVIDENCE + """, s AS (SELECT tags.*, list_transform(list_filter(rare, lambda x: x.share <= 0.2), lambda x: x.theme)[1:3] AS telling, tc, ts, rc, rs, x.title AS ct, y.title AS st FROM tags LEFT JOIN best USING (user_id, item_id) LEFT JOIN f c ON c.user_id = tags.user_id AND c.item_id = tags.item_id AND c.r = rc LEFT JOIN f d ON d.user_id = tags.user_id AND d.item_id = tags.item_id AND d.r = rs
 LEFT JOIN items x ON x.item_id = c.anchor LEFT JOIN items y ON y.item_id = d.anchor),
k AS (SELECT *, list_filter([CASE WHEN tc >= 3 THEN tc || ' people liked both this and ' || ct END, CASE WHEN ts >= 0.35 AND (tc < 3 OR rc <> rs) THEN 'it is close to ' || st END, CASE WHEN len(telling) > 0 THEN 'you like ' || array_to_string(telling, ', ') END], lambda x: x IS NOT NULL) AS claims FROM s)
SELECT user_id, item_id, 'Chosen since ' || CASE WHEN len(claims) > 0 THEN array_to_string(claims, '; ') ELSE 'people who liked your titles liked it too' END || '.' || CASE WHEN len(disliked) > 0 THEN ' It has themes you rated low: ' || array_to_string(disliked, ', ') || '.' ELSE '' END AS summary FROM k""")
def evidence_summary(spark, sf):
    return _evidence(spark, sf).select("user_id", "item_id", explaining.summary("people who liked your titles liked it too").alias("summary"))


UNI = """WITH {I}, {T}, lk AS (SELECT user_id, item_id FROM inter WHERE rating >= 5), l AS (SELECT lk.user_id, b.item_id, b.title, min(lk.item_id) AS via FROM lk JOIN items a USING (item_id) JOIN items b ON a.title = b.title AND a.domain <> b.domain GROUP BY 1, 2, 3)"""


@query(UNI + " SELECT user_id, title, item_id, via FROM (SELECT *, row_number() OVER (PARTITION BY user_id, title ORDER BY item_id) AS r FROM l) WHERE r = 1")
def same_universe(spark, sf):
    it = items(spark, sf)
    liked = interactions(spark, sf).where("rating >= 5").select("user_id", "item_id").join(it.select("item_id", "title", "domain"), "item_id")
    other = it.groupBy("title", F.col("domain").alias("d2")).agg(F.min("item_id").alias("dst"))  # no other of them can be first
    links = liked.join(other, "title").where("domain <> d2").groupBy("user_id", "title", "dst").agg(F.min("item_id").alias("via"))
    return core.top(links, ["user_id", "title"], 1, "dst").select("user_id", "title", F.col("dst").alias("item_id"), "via")


@query("""WITH {I}, {T}, o AS (SELECT user_id, items.item_id, items.creator, row_number() OVER (PARTITION BY user_id, items.domain, title ORDER BY rating DESC, items.item_id) AS r, rating FROM inter JOIN items USING (item_id)),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id, creator ORDER BY rating DESC, item_id) AS q FROM o WHERE r = 1) SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY rating DESC, item_id)::INTEGER AS rank FROM f WHERE q = 1""")
def dedupe_works(spark, sf):
    """Each user's ratings, best first: one for each kind and title, then one for each maker."""
    it = items(spark, sf).select("item_id", F.col("domain").alias("kind"), F.col("title").alias("key"), F.col("creator").alias("family"))
    rated = interactions(spark, sf).select("user_id", "item_id", "rating").join(it, "item_id")
    own = core.dealt(rated, read_table(spark, sf, "lineitem").count(), "user_id")  # for all windows
    rows = core.ranked(own, ["user_id"], F.desc("rating"), "item_id")
    return works.dedupe_works(rows).select("user_id", "item_id", "rank")


@query("""WITH {I}, s AS (SELECT p_partkey AS item_id, p_partkey + 1 AS alt FROM part WHERE p_partkey % 11 = 0), k AS (SELECT user_id, item_id, rating FROM inter WHERE item_id NOT IN (SELECT item_id FROM s))
SELECT * FROM k UNION ALL SELECT user_id, alt, max(least(rating, 4)) FROM inter JOIN s USING (item_id) WHERE (user_id, alt) NOT IN (SELECT (user_id, item_id) FROM k) GROUP BY 1, 2""")
def expand_profile(spark, sf):
    """New titles in a profile give way to their stand-ins, at most rated 4, unless these are there already."""
    inter = interactions(spark, sf)
    s = items(spark, sf).where("item_id % 11 = 0").select("item_id", (F.col("item_id") + 1).alias("alt"))
    kept = inter.join(s, "item_id", "left_anti").select("user_id", "item_id", "rating")
    moved = inter.join(s, "item_id").groupBy("user_id", F.col("alt").alias("item_id")).agg(F.max(F.least("rating", F.lit(4.0))).alias("rating"))
    return kept.unionByName(moved.join(kept, ["user_id", "item_id"], "left_anti").select("user_id", "item_id", "rating"))


@query("""WITH s AS (SELECT a.vec_id AS new_id, b.vec_id AS item_id, a.label = b.label AS family, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.vec_id % 20 = 0)
SELECT new_id, item_id, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY family DESC, sim DESC, item_id) AS rank FROM s) WHERE rank <= 2""")
def stand_ins(spark, sf):
    v = read_table(spark, sf, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("long"))
    return models.best_of_family(v.where("id % 20 = 0"), v, 2)


@query()
def new_titles_for_profile(spark, sf):
    v = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v"))
    profiles = models.profile_vectors(models.signed_history(interactions(spark, sf)).where("weight > 0"), v)
    return models.best_by_vector(profiles, v, 5)


@query("SELECT vec_id AS item_id, len(embedding)::INTEGER AS width FROM embeddings")
def publish_version_round_trip(spark, sf):
    root = shared_path(spark)
    table = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    publish_version(table, root)
    live = load_version(spark, root, 64, table.select("item_id"))
    return live.select("item_id", F.size("vector").alias("width"))


@query()
def new_title_index(spark, sf):
    v = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v"))
    return v.join(items(spark, sf).select("item_id", "title"), "item_id").select("item_id", "title", core.norm(F.col("v")).alias("length"))
