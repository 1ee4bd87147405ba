"""Splits, metrics, judgments, comparison of systems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import core, metrics, models, tasks
from ..sources.scratch import materialise
from ..sources.tables import interactions, items, read_table
from .registry import query

# Two simple systems over the same users, so that every metric has an exact twin in SQL: the most popular items of the other
# domain than the user's id says, and a hash order of the items.
SYS = """{I}, pop AS (SELECT item_id, count(*) FILTER (rating >= 4) AS popularity FROM inter GROUP BY 1), best AS (SELECT item_id, row_number() OVER (ORDER BY popularity DESC, item_id) AS rank FROM pop QUALIFY rank <= 10),
users AS (SELECT DISTINCT user_id FROM inter), ranked AS (SELECT user_id, item_id, rank FROM users, best),
rel AS (SELECT user_id, item_id FROM inter WHERE rating >= 5), nrel AS (SELECT user_id, least(count(*), 10) AS best FROM rel GROUP BY 1),
hits AS (SELECT user_id, rank, row_number() OVER (PARTITION BY user_id ORDER BY rank) AS nth FROM ranked JOIN rel USING (user_id, item_id)),
per AS (SELECT user_id, count(*) AS hits, sum(1 / log2(rank + 1)) AS dcg, sum(nth / rank) AS ap FROM hits GROUP BY 1),
m AS (SELECT user_id, coalesce(hits, 0) / best AS recall, (coalesce(hits, 0) > 0)::INTEGER AS hit, coalesce(dcg, 0) / list_sum(list_transform(range(1, best + 1), lambda r: 1 / log2(r + 1))) AS ndcg, coalesce(ap, 0) / best AS map FROM nrel LEFT JOIN per USING (user_id))"""


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    inter = interactions(spark, sf)
    best = core.item_stats(inter).orderBy(F.desc("popularity"), "item_id").limit(10).select("item_id", F.row_number().over(core.W.orderBy(F.desc("popularity"), "item_id")).alias("rank"))  # ten rows
    return inter.select("user_id").distinct().crossJoin(F.broadcast(best))


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    relevant = interactions(spark, sf).where("rating >= 5").select("user_id", "item_id")
    return metrics.ranking_metrics(_ranked(spark, sf), relevant)


@query(f"WITH {SYS} SELECT user_id, recall, hit FROM m")
def recall_hit(spark, sf):
    return _metrics(spark, sf).select("user_id", "recall", "hit")


@query(f"WITH {SYS} SELECT user_id, ndcg FROM m")
def ndcg(spark, sf):
    return _metrics(spark, sf).select("user_id", "ndcg")


@query(f"WITH {SYS} SELECT user_id, map FROM m")
def map_at_k(spark, sf):
    return _metrics(spark, sf).select("user_id", "map")


@query(f"WITH {SYS} SELECT user_id, avg(-log2((popularity + 1) / ((SELECT count(*) FROM users) + 1))) AS novelty FROM ranked JOIN pop USING (item_id) GROUP BY 1")
def novelty(spark, sf):
    inter = interactions(spark, sf)
    n = inter.select("user_id").distinct().count()
    return metrics.novelty(_ranked(spark, sf), core.item_stats(inter).select("item_id", "popularity"), n)


@query(f"WITH {SYS}, pct AS (SELECT item_id, (row_number() OVER (ORDER BY popularity, item_id) - 1) / (count(*) OVER () - 1) AS pct FROM pop) SELECT user_id, avg(pct) AS bias FROM ranked JOIN pct USING (item_id) GROUP BY 1")
def popularity_bias(spark, sf):
    pop = core.item_stats(interactions(spark, sf)).select("item_id", "popularity")
    # Ranks among all items from counts of equal popularities: no window over all rows but the levels.
    levels = pop.groupBy("popularity").agg(F.count("*").alias("m"))
    before = levels.select("popularity", (F.sum("m").over(core.W.orderBy("popularity")) - F.col("m")).alias("before"))
    total = pop.agg(F.count("*").alias("n"))  # one row
    at = core.ranked(pop, ["popularity"], "item_id", name="k").join(before, "popularity").crossJoin(F.broadcast(total))
    pct = at.select("item_id", ((F.col("before") + F.col("k") - 1) / (F.col("n") - 1)).alias("pct"))
    return _ranked(spark, sf).join(pct, "item_id").groupBy("user_id").agg(F.avg("pct").alias("bias"))


@query("""SELECT d.source AS user_id, round(1 - avg(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))), 6) AS diversity
FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)) d JOIN embeddings a ON d.doc_id = a.vec_id
JOIN (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)) e ON d.source = e.source AND d.doc_id < e.doc_id JOIN embeddings b ON e.doc_id = b.vec_id WHERE d.r <= 10 AND e.r <= 10 GROUP BY 1""")
def intra_list_diversity(spark, sf):
    v = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v"))
    docs = read_table(spark, sf, "documents").select(F.col("source").alias("user_id"), F.col("doc_id").alias("item_id")).join(v.select("item_id"), "item_id", "left_semi")
    lists = core.top(docs, ["user_id"], 10, "item_id")
    return metrics.diversity(lists, v).withColumn("diversity", F.round("diversity", 6))


GROUPS = """{I}, likes AS (SELECT * FROM inter WHERE rating >= 4), br AS (SELECT user_id FROM likes GROUP BY 1 HAVING count(*) FILTER (domain = 'movie') >= 2 AND count(*) FILTER (domain = 'game') >= 2),
g AS (SELECT user_id, floor((('0x' || substr(md5('group|' || user_id), 1, 12))::BIGINT / 281474976710656.0) / 0.06)::INTEGER AS grp FROM br), grp AS (SELECT * FROM g WHERE grp < 4)"""


@query(f"WITH {GROUPS} SELECT user_id, grp FROM grp")
def holdout_groups(spark, sf):
    return metrics.holdout_groups(interactions(spark, sf))


TRAIN = GROUPS + """, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp, item_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM inter),
parts AS (SELECT *, CASE WHEN n < 5 THEN 'train' WHEN pos >= n - greatest(1, round_even(n * 0.2, 0)::INT) THEN 'test' WHEN pos >= n - greatest(1, round_even(n * 0.2, 0)::INT) - greatest(1, round_even(n * 0.1, 0)::INT) THEN 'val' ELSE 'train' END AS part FROM r),
train AS (SELECT user_id, item_id, domain, rating FROM parts WHERE part = 'train' AND user_id NOT IN (SELECT user_id FROM grp) UNION ALL SELECT i.user_id, item_id, domain, rating FROM inter i JOIN grp USING (user_id) WHERE domain = CASE WHEN grp % 2 = 0 THEN 'movie' ELSE 'game' END)"""


def _train(spark: SparkSession, sf: str) -> DataFrame:
    return _train_of(interactions(spark, sf))


def _train_of(inter: DataFrame) -> DataFrame:
    """Earlier rows of other users, and of hold-out users the domain that their group leaves visible."""
    grp = metrics.holdout_groups(inter)
    rest = core.chronological_split(inter).where("part = 'train'").join(grp, "user_id", "left_anti")
    seen = F.when(F.col("grp") % 2 == 0, "movie").otherwise("game")
    held = inter.join(grp, "user_id").where(F.col("domain") == seen)
    cols = ["user_id", "item_id", "domain", "rating"]
    return rest.select(*cols).unionByName(held.select(*cols))


@query(f"WITH {TRAIN} SELECT user_id, item_id, domain, rating FROM train")
def split_train(spark, sf):
    return _train(spark, sf)


@query(f"WITH {TRAIN} SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_users, (SELECT count(*) FROM grp) AS n_holdout FROM train")
def split_summary(spark, sf):
    grp = metrics.holdout_groups(interactions(spark, sf)).agg(F.count("*").alias("n_holdout"))  # one row
    return _train(spark, sf).agg(F.count("*").alias("n_rows"), F.countDistinct("user_id").alias("n_users")).crossJoin(F.broadcast(grp))


@query(f"""WITH {TRAIN}, v AS (SELECT user_id, CASE WHEN grp % 2 = 0 THEN 'movie' ELSE 'game' END AS seen FROM grp)
SELECT (SELECT count(*) FROM train JOIN v USING (user_id) WHERE domain <> seen) AS hidden_rows,
 (SELECT count(*) FROM inter i JOIN v USING (user_id) JOIN train t USING (user_id, item_id) WHERE i.domain <> seen AND i.rating >= 4) AS relevant_in_history""")
def leakage_check(spark, sf):
    """Rows of hidden domains in the training rows, and relevant items in the histories: both must be 0."""
    inter = interactions(spark, sf)
    seen = metrics.holdout_groups(inter).select("user_id", F.when(F.col("grp") % 2 == 0, "movie").otherwise("game").alias("seen"))
    train = _train(spark, sf)
    hidden = train.join(seen, "user_id").where("domain <> seen").agg(F.count("*").alias("hidden_rows"))
    relevant = core.positives(inter).join(seen, "user_id").where("domain <> seen").select("user_id", "item_id")
    both = relevant.join(train.select("user_id", "item_id"), ["user_id", "item_id"], "left_semi").agg(F.count("*").alias("relevant_in_history"))
    return hidden.crossJoin(F.broadcast(both))  # one row each


CASES = GROUPS + """, parts AS (SELECT *, CASE WHEN n < 5 THEN 'train' WHEN pos >= n - greatest(1, round_even(n * 0.2, 0)::INT) THEN 'test' ELSE 'train' END AS part FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp, item_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM inter) WHERE user_id NOT IN (SELECT user_id FROM grp)),
old AS (SELECT * FROM parts WHERE part = 'train'), fut AS (SELECT * FROM parts WHERE part = 'test' AND rating >= 4), two AS (SELECT user_id FROM old WHERE rating >= 4 GROUP BY 1 HAVING count(DISTINCT domain) = 2),
x AS (SELECT inter.*, CASE WHEN grp % 2 = 0 THEN 'movie' ELSE 'game' END AS src FROM inter JOIN grp USING (user_id) WHERE grp IN (2, 3)),
h AS (SELECT 'within_' || domain AS task, user_id, item_id, rating, true AS shown FROM old UNION ALL SELECT 'mixed', user_id, item_id, rating, true FROM old WHERE user_id IN (SELECT user_id FROM two) UNION ALL SELECT 'cold_start', user_id, item_id, rating, false FROM old
 UNION ALL SELECT src || '_to_' || CASE src WHEN 'movie' THEN 'game' ELSE 'movie' END, user_id, item_id, rating, true FROM x WHERE domain = src),
r AS (SELECT 'within_' || domain AS task, user_id, item_id FROM fut UNION ALL SELECT 'mixed', user_id, item_id FROM fut WHERE user_id IN (SELECT user_id FROM two) UNION ALL SELECT 'cold_start', user_id, item_id FROM fut UNION ALL SELECT src || '_to_' || domain, user_id, item_id FROM x WHERE domain <> src AND rating >= 4)"""


@query(f"""WITH {CASES}, a AS (SELECT task, user_id, count(*) FILTER (shown) AS n_history, count(*) AS n_seen, count(*) FILTER (rating >= 4) AS liked FROM h GROUP BY 1, 2), b AS (SELECT task, user_id, count(*) AS n_relevant FROM r GROUP BY 1, 2)
SELECT task, user_id, n_history, n_seen, n_relevant FROM a JOIN b USING (task, user_id) WHERE liked > 0""")
def eval_cases(spark, sf):
    """Six tasks with their histories, seen and relevant items."""
    history, relevant, seen = tasks.eval_tables(interactions(spark, sf))
    key = ["task", "user_id"]
    n = lambda df, name: df.groupBy(*key).agg(F.count("*").alias(name))
    return n(seen, "n_seen").join(n(relevant, "n_relevant"), key).join(n(history, "n_history"), key, "left").na.fill(0, ["n_history"])


SEG = """{I}, n AS (SELECT user_id, count(*) AS n, count(DISTINCT domain) AS d FROM inter GROUP BY 1), cut AS (SELECT quantile_cont(n, 0.75) AS c FROM n),
seg AS (SELECT user_id, CASE WHEN n >= c THEN 'heavy' WHEN n <= 5 THEN 'sparse' ELSE 'medium' END AS activity, d = 2 AS bridge FROM n, cut)"""


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    n = interactions(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"), (F.min("domain") != F.max("domain")).alias("bridge"))
    cut = n.agg(F.percentile("n", 0.75).alias("c"))  # one row
    activity = F.when(F.col("n") >= F.col("c"), "heavy").when(F.col("n") <= 5, "sparse").otherwise("medium")
    return n.crossJoin(F.broadcast(cut)).select("user_id", activity.alias("activity"), "bridge")


@query(f"WITH {SEG} SELECT user_id, activity, bridge FROM seg")
def user_segments(spark, sf):
    return _segments(spark, sf)


@query(f"WITH {SYS}, {SEG.replace('{I}, ', '')}, x AS (SELECT user_id, activity AS segment FROM seg UNION ALL SELECT user_id, 'bridge' FROM seg WHERE bridge UNION ALL SELECT user_id, 'all' FROM seg) SELECT segment, avg(ndcg) AS ndcg, avg(recall) AS recall, count(*) AS n FROM m JOIN x USING (user_id) GROUP BY 1")
def segment_metrics(spark, sf):
    seg = _segments(spark, sf).select("user_id", F.explode(F.array_compact(F.array("activity", F.when(F.col("bridge"), "bridge"), F.lit("all")))).alias("segment"))
    return _metrics(spark, sf).join(seg, "user_id").groupBy("segment").agg(F.avg("ndcg").alias("ndcg"), F.avg("recall").alias("recall"), F.count("*").alias("n"))


@query(f"WITH {SYS}, {SEG.replace('{I}, ', '')} SELECT bridge, avg(ndcg) FILTER (activity = 'heavy') AS heavy, avg(ndcg) FILTER (activity = 'medium') AS medium, avg(ndcg) FILTER (activity = 'sparse') AS sparse FROM m JOIN seg USING (user_id) GROUP BY 1")
def segment_pivot(spark, sf):
    return _metrics(spark, sf).join(_segments(spark, sf), "user_id").groupBy("bridge").pivot("activity", ["heavy", "medium", "sparse"]).agg(F.avg("ndcg"))


@query(f"WITH {SYS} SELECT avg(ndcg) AS ndcg, avg(recall) AS recall, avg(hit) AS hit, avg(map) AS map FROM m")
def headline_metrics(spark, sf):
    return _metrics(spark, sf).agg(*[F.avg(c).alias(c) for c in ("ndcg", "recall", "hit", "map")])


@query("""WITH p AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS task, doc_id AS user_id, (quality - toxic)::DOUBLE AS diff, toxic::DOUBLE AS base FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL),
n AS (SELECT task, count(*) AS n, avg(diff) AS lift, avg(diff) / nullif(avg(base), 0) AS relative_lift FROM p GROUP BY 1),
r AS (SELECT task, row_number() OVER (PARTITION BY task ORDER BY user_id) - 1 AS pos, diff FROM p), g AS (SELECT task, n, b, unnest(range(0, n)) AS i FROM n, range(0, 2000) t(b)),
d AS (SELECT task, b, ('0x' || substr(md5(task || '|' || b || '|' || i), 1, 12))::BIGINT % n AS pos FROM g), m AS (SELECT task, b, avg(diff) AS m FROM d JOIN r USING (task, pos) GROUP BY 1, 2),
c AS (SELECT task, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY 1) SELECT task, n, lift, relative_lift, low, high, low > 0 OR high < 0 AS significant FROM n JOIN c USING (task)""")
def paired_bootstrap(spark, sf):
    labels = read_table(spark, sf, "labels").where("quality is not null and toxic is not null")
    p = labels.select(F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd").alias("task"), F.col("doc_id").alias("user_id"), (F.col("quality") - F.col("toxic")).cast("double").alias("diff"), F.col("toxic").cast("double").alias("base"))
    return metrics.paired_bootstrap(p)


@query("""WITH a AS (SELECT event_type AS metric, avg(value) AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type AS metric, avg(value) AS v, CASE WHEN event_type = 'signup' THEN 'other' ELSE 'one' END AS d FROM events WHERE event_id % 2 = 1 AND event_type <> 'error' GROUP BY ALL),
r AS (SELECT metric, CASE WHEN a.v IS NULL OR b.v IS NULL THEN 'missing' WHEN d <> 'one' THEN 'other data' WHEN b.v < a.v * CASE WHEN metric = 'click' THEN 0.98 ELSE 0.9 END THEN 'dropped' ELSE '' END AS reason FROM a FULL JOIN b USING (metric))
SELECT metric, reason = '' AS ok, reason FROM r UNION ALL SELECT 'verdict', bool_and(reason = ''), coalesce(string_agg(metric || ' ' || reason, ', ' ORDER BY metric || ' ' || reason) FILTER (reason <> ''), '') FROM r""")
def promotion_gate(spark, sf):
    ev = read_table(spark, sf, "events")
    side = lambda k: ev.where(F.col("event_id") % 2 == k).groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    new = side(1).where("metric <> 'error'").withColumn("dataset", F.when(F.col("metric") == "signup", "other").otherwise("one"))
    return metrics.promotion_gate(side(0).withColumn("dataset", F.lit("one")), new, "click")


@query("SELECT event_type AS task, avg(value) FILTER (user_id % 3 = 0) AS low, avg(value) FILTER (user_id % 3 = 1) AS mid, avg(value) FILTER (user_id % 3 = 2) AS high FROM events GROUP BY 1")
def settings_comparison(spark, sf):
    setting = F.element_at(F.array(F.lit("low"), F.lit("mid"), F.lit("high")), (F.col("user_id") % 3 + 1).cast("int"))
    return read_table(spark, sf, "events").withColumn("setting", setting).groupBy(F.col("event_type").alias("task")).pivot("setting", ["low", "mid", "high"]).agg(F.avg("value"))


JUDGED = """d AS (SELECT source AS query, doc_id AS item, 2 * quality AS rating FROM labels JOIN documents USING (doc_id)), l AS (SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY md5('list|' || item), item) AS rank FROM (SELECT source AS query, doc_id AS item FROM documents)),
dcg AS (SELECT query, sum((pow(2.0, rating) - 1) / log2(rank + 1)) AS dcg FROM l JOIN d USING (query, item) WHERE rank <= 5 GROUP BY 1),
ideal AS (SELECT query, sum((pow(2.0, rating) - 1) / log2(r + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rating DESC, item) AS r FROM d) WHERE r <= 5 GROUP BY 1)"""


def _judged(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = read_table(spark, sf, "documents").select(F.col("source").alias("query"), F.col("doc_id").alias("item"))
    ratings = read_table(spark, sf, "labels").select(F.col("doc_id").alias("item"), (2 * F.col("quality")).alias("rating")).join(docs, "item")
    return core.ranked(docs, ["query"], F.md5(F.concat_ws("|", F.lit("list"), F.col("item").cast("string")).cast("binary")), "item"), ratings


@query(f"WITH {JUDGED} SELECT query, CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal ELSE 0 END AS ndcg FROM ideal LEFT JOIN dcg USING (query)")
def graded_ndcg(spark, sf):
    return metrics.graded_ndcg(*_judged(spark, sf), 5)


@query(f"WITH {JUDGED} SELECT query, avg((rating >= 2)::INT) AS good, avg((rating <= 0)::INT) AS bad, count(rating) / count(*) AS judged FROM l LEFT JOIN d USING (query, item) WHERE rank <= 5 GROUP BY 1")
def judged_scores(spark, sf):
    lists, ratings = _judged(spark, sf)
    rows = lists.where("rank <= 5").join(ratings, ["query", "item"], "left")
    return rows.groupBy("query").agg(F.avg((F.col("rating") >= 2).cast("int")).alias("good"), F.avg((F.col("rating") <= 0).cast("int")).alias("bad"), (F.count("rating") / F.count("*")).alias("judged"))


@query("""WITH r AS (SELECT source AS query, doc_id - doc_id % 3 AS item, 2 * quality AS one, 2 * (1 - toxic) AS two FROM labels JOIN documents USING (doc_id)),
j AS (SELECT 'combined' AS raters, query, item, greatest(max(one), max(two)) AS rating FROM r GROUP BY ALL UNION ALL SELECT 'single', query, item, max(one) FROM r GROUP BY ALL),
l AS (SELECT s AS setting, source AS query, doc_id AS item, row_number() OVER (PARTITION BY source, s ORDER BY md5('list' || s || '|' || doc_id), doc_id) AS rank FROM documents, range(0, 2) t(s)),
m AS (SELECT setting, query, item - item % 3 AS item, min(rank) AS rank FROM l WHERE rank <= 10 GROUP BY ALL)
SELECT setting::INTEGER AS setting, raters, m.query, avg((rating >= 2)::INT) AS good, avg((rating <= 0)::INT) AS bad, count(rating) / count(*) AS judged
FROM m CROSS JOIN (VALUES ('combined'), ('single')) x(raters) LEFT JOIN j USING (raters, query, item) GROUP BY ALL""")
def judged_by_setting(spark, sf):
    """Shares of good, bad and judged items among each setting's first ten, after a remap, by one rater or both."""
    docs = read_table(spark, sf, "documents").select("doc_id", F.col("source").alias("query"))
    work = lambda c: F.col(c) - F.col(c) % 3
    r = read_table(spark, sf, "labels").join(docs, "doc_id").select("query", work("doc_id").alias("item"), (2 * F.col("quality")).alias("one"), (2 * (1 - F.col("toxic"))).alias("two"))
    by = r.groupBy("query", "item").agg(F.max("one").alias("single"), F.greatest(F.max("one"), F.max("two")).alias("combined"))
    rated = by.unpivot(["query", "item"], ["single", "combined"], "raters", "rating")
    lists = docs.withColumn("setting", F.explode(F.array(F.lit(0), F.lit(1))))
    order = F.md5(F.concat(F.lit("list"), F.col("setting").cast("string"), F.lit("|"), F.col("doc_id").cast("string")).cast("binary"))
    shown = core.top(lists, ["query", "setting"], 10, order, "doc_id").select("setting", "query", work("doc_id").alias("item")).distinct()
    rows = shown.withColumn("raters", F.explode(F.array(F.lit("combined"), F.lit("single")))).join(rated, ["raters", "query", "item"], "left")
    share = lambda c: F.avg(c.cast("int"))
    return rows.groupBy("setting", "raters", "query").agg(share(F.col("rating") >= 2).alias("good"), share(F.col("rating") <= 0).alias("bad"), (F.count("rating") / F.count("*")).alias("judged"))


@query("""WITH s AS (SELECT source AS query, doc_id AS item, row_number() OVER (PARTITION BY source, k ORDER BY md5('setting' || k || '|' || doc_id), doc_id) AS rank FROM documents, range(0, 3) t(k)), p AS (SELECT DISTINCT query, item FROM s WHERE rank <= 5)
SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY sha1(query || '|' || item), item)::INTEGER AS rank FROM p""")
def rating_pool(spark, sf):
    """The first five of each query's lists under three settings, each item once, in an order that doesn't tell where it came from."""
    docs = read_table(spark, sf, "documents").select(F.col("source").alias("query"), F.col("doc_id").alias("item"))
    lists = None
    for k in range(3):
        order = F.md5(F.concat_ws("|", F.lit(f"setting{k}"), F.col("item").cast("string")).cast("binary"))
        one = core.top(docs, ["query"], 5, order, "item").select("query", "item")
        lists = one if lists is None else lists.unionByName(one)
    blind = F.sha1(F.concat_ws("|", "query", F.col("item").cast("string")).cast("binary"))
    return core.ranked(lists.dropDuplicates(["query", "item"]), ["query"], blind, "item")


THEME = """{I}, {T}, th AS (SELECT user_id, genres[1] AS theme, count(*) AS n FROM inter JOIN items USING (item_id) WHERE rating >= 4 GROUP BY 1, 2)"""


def _themes(spark: SparkSession, sf: str) -> DataFrame:
    it = items(spark, sf).select("item_id", F.explode("genres").alias("theme"))
    return core.positives(interactions(spark, sf)).join(it, "item_id").groupBy("user_id", "theme").agg(F.count("*").alias("n"))


@query(f"WITH {THEME} SELECT user_id, theme, n, r::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, theme) AS r FROM th) WHERE r <= 6")
def theme_profile(spark, sf):
    return core.top(_themes(spark, sf), ["user_id"], 6, F.desc("n"), "theme")


@query(f"WITH {THEME} SELECT user_id, list(theme ORDER BY n DESC, theme)[1:3] AS preferences FROM th GROUP BY 1")
def top_preferences(spark, sf):
    best = core.top(_themes(spark, sf), ["user_id"], 3, F.desc("n"), "theme")
    return best.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "theme"))), lambda s: s["theme"]).alias("preferences"))


@query("WITH {T} SELECT g AS theme, count(*) / (SELECT count(*) FROM items) AS df FROM (SELECT unnest(list_distinct(genres)) AS g FROM items) GROUP BY 1")
def theme_document_frequency(spark, sf):
    it = items(spark, sf)
    n = it.agg(F.count("*").alias("n"))  # one row
    return it.select(F.explode(F.array_distinct("genres")).alias("theme")).groupBy("theme").agg(F.count("*").alias("k")).crossJoin(F.broadcast(n)).select("theme", (F.col("k") / F.col("n")).alias("df"))


@query(f"WITH {SYS} SELECT user_id, string_agg(item_id::VARCHAR, ',' ORDER BY rank) AS recommended FROM ranked WHERE user_id IN (SELECT user_id FROM users ORDER BY md5('error|' || user_id), user_id LIMIT 20) GROUP BY 1")
def error_cases(spark, sf):
    ranked = _ranked(spark, sf)
    users = core.hash_sample(ranked.select("user_id").distinct(), 20, "user_id", "error")
    return ranked.join(users, "user_id", "left_semi").groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item_id"))), lambda s: s["item_id"].cast("string")), ",").alias("recommended"))


@query()
def benchmark(spark, sf):
    """Systems by task by segment: popularity, best rated, item-kNN, content, their fusion, and a random order by hash. Systems
    that need a history have no lists for new users."""
    inter, it = materialise(interactions(spark, sf)), items(spark, sf)
    train = materialise(inter.join(_train_of(inter).select("user_id", "item_id"), ["user_id", "item_id"], "left_semi"))
    cases = tuple(materialise(t) for t in tasks.eval_tables(inter, cap=200))
    case = F.concat_ws("|", "task", F.col("user_id").cast("string"))
    history = models.signed_history(cases[0].withColumn("user_id", case))
    stats = core.item_stats(train).join(it.select("item_id", "domain"), "item_id")
    mean = stats.agg(F.avg("rating_mean").alias("prior"))  # one row
    stats = materialise(stats.crossJoin(F.broadcast(mean)).withColumn("bayes", (F.col("rating_mean") * F.col("rating_count") + 10 * F.col("prior")) / (F.col("rating_count") + 10)))

    def fixed(order):
        """The first hundred of each domain for everyone."""
        best = F.broadcast(core.top(stats.withColumn("score", order), ["domain"], 100, F.desc("score"), "item_id").select("item_id", "score"))
        return lambda asked: asked.select("case").crossJoin(best)

    knn = materialise(core.top(models.score(history, models.item_knn(core.positives(train), wanted=history)).where("score > 0"), ["user_id"], 200, F.desc("score"), "item_id").select(F.col("user_id").alias("case"), "item_id", "score"))
    vectors = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v")).join(it.select("item_id"), "item_id", "left_semi")
    numbered = materialise(history.select("user_id").distinct().select(F.col("user_id").alias("case"), F.xxhash64("user_id").alias("n")))
    taste = models.profile_vectors(history.join(numbered, F.col("user_id") == F.col("case")).drop("user_id", "case").withColumnRenamed("n", "user_id"), vectors)
    content = materialise(models.best_by_vector(taste, vectors, 100).join(numbered, F.col("user_id") == F.col("n")).select("case", "item_id", "score"))
    popular = fixed(F.log1p(F.col("popularity").cast("double")))
    order = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("sys"), F.col("item_id").cast("string")).cast("binary")), 1, 8), 16, 10).cast("double")

    def fused(asked):
        ranks = None
        for one in (popular(asked), knn, content):
            r = core.ranked(one, ["case"], F.desc("score"), "item_id").select("case", "item_id", (1 / (60.0 + F.col("rank"))).alias("s"))
            ranks = r if ranks is None else ranks.unionByName(r)
        return ranks.groupBy("case", "item_id").agg(F.sum("s").alias("score"))

    systems = {"popularity": popular, "best_rated": fixed(F.col("bayes")), "random": fixed(order), "item_knn": lambda asked: knn, "content": lambda asked: content, "fusion": fused}
    seg = _segments(spark, sf).select("user_id", F.explode(F.array_compact(F.array("activity", F.when(F.col("bridge"), "bridge"), F.lit("all")))).alias("segment"))
    return tasks.benchmark(systems, cases, it, seg)
