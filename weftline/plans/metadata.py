"""Product metadata, search input and ranked links over the parts and interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metadata as M
from ..functions import text as T
from ..operators import core
from ..sources.tables import interactions, items, read_table
from .registry import query


def _products(spark: SparkSession, sf: str) -> DataFrame:
    """Records of nested metadata made from the columns of parts."""
    part, n = read_table(spark, sf, "part"), F.col("p_partkey")
    year = lambda k: (1970 + k + F.col("p_size")).cast("string")
    image = lambda v, large, thumb: F.struct(F.lit(v).alias("variant"), large.alias("large"), F.lit(None).cast("string").alias("hi_res"), thumb.alias("thumb"))
    url = lambda kind: F.concat(F.lit(f"https://{kind}/"), n.cast("string"))
    return part.select(
        n.alias("item_id"), F.when(n % 5 < 3, "movie").otherwise("game").alias("domain"),
        F.concat("p_name", F.when(n % 7 == 0, " Trilogy").when(n % 7 == 1, " Series Trilogy").when(n % 7 == 2, " USB").otherwise(""), F.lit(" ("), year(2), F.lit(")")).alias("title"),
        F.array(F.col("p_type"), F.when(n % 3 == 0, F.concat(F.lit(" "), year(0)))).alias("features"),
        F.create_map(F.lit("Release Date"), F.when(n % 3 == 1, F.concat(F.lit("May 1, "), year(1))), F.lit("Studio"), F.when(n % 4 == 0, F.col("p_brand"))).alias("details"),
        F.when(n % 4 == 1, F.lit("Format: DVD")).when(n % 4 == 2, F.col("p_type")).alias("store"),
        F.when(n % 11 == 0, "Prime Video").otherwise("Video Games").alias("main_category"),
        F.array(F.lit("Video Games"), F.when(n % 2 == 0, "Games").otherwise("PC"), F.col("p_type"), F.when(n % 13 == 0, "Consoles").otherwise("Sony PlayStation")).alias("categories"),
        F.array(F.lit("First One"), F.lit("Second One"), F.lit("Third One")).alias("directors"),
        F.array(image("PT01", url("side"), url("s")), image("MAIN", F.when(n % 2 == 0, url("main")), F.when(n % 3 > 0, url("small")))).alias("images"),
        F.array(*[F.struct(F.col(c).cast("string").alias("name"), ((n * k) % 17).cast("int").alias("rank"), (n % k == 0).alias("is_spoiler")) for c, k in (("p_type", 3), ("p_brand", 5), ("p_name", 7))]).alias("tags"),
    )


@query("SELECT p_partkey AS item_id, (1970 + p_partkey % 3 + p_size)::INTEGER AS year FROM part")
def year_from_metadata(spark, sf):
    return _products(spark, sf).select("item_id", M.year_from_metadata(F.col("features"), F.col("details"), F.col("title")).alias("year"))


@query("SELECT p_partkey AS item_id, substr(p_type || ' ' || CASE WHEN p_partkey % 3 = 0 THEN ' ' || (1970 + p_size) ELSE '' END, 1, 12) AS text FROM part")
def flatten_text(spark, sf):
    return _products(spark, sf).select("item_id", M.flatten_text(F.col("features"), 12).alias("text"))


@query("SELECT p_partkey AS item_id, p_partkey % 7 = 2 AS accessory FROM part")
def is_accessory(spark, sf):
    return _products(spark, sf).select("item_id", M.is_accessory(F.col("title")).alias("accessory"))


@query("SELECT p_partkey AS item_id, p_partkey % 11 <> 0 AND p_partkey % 4 <> 1 AND p_partkey % 13 <> 0 AND (p_partkey % 2 = 0 OR p_partkey % 7 <> 2) AS game FROM part")
def is_game(spark, sf):
    c = [F.col(x) for x in ("title", "categories", "main_category", "store", "details")]
    return _products(spark, sf).select("item_id", M.is_game(*c).alias("game"))


@query("SELECT p_partkey AS item_id, 'https://' || CASE WHEN p_partkey % 2 = 0 THEN 'main' WHEN p_partkey % 3 > 0 THEN 'small' ELSE 'side' END || '/' || p_partkey AS image FROM part")
def main_image(spark, sf):
    return _products(spark, sf).select("item_id", M.main_image(F.col("images")).alias("image"))


@query("SELECT p_partkey AS item_id, CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 2 THEN p_type ELSE 'First One, Second One' END AS creator FROM part")
def creator(spark, sf):
    return _products(spark, sf).select("item_id", M.creator(F.col("details"), F.col("store"), F.col("directors")).alias("creator"))


@query("""SELECT p_partkey AS item_id, array_to_string(list_filter([p_type, CASE WHEN p_partkey % 13 = 0 THEN 'Consoles' ELSE 'Sony PlayStation' END],
 lambda x: p_partkey % 5 < 3 OR x <> 'Sony PlayStation'), ',') AS genres FROM part""")
def genre_labels(spark, sf):
    return _products(spark, sf).select("item_id", F.array_join(M.genre_labels(F.col("categories"), F.col("domain")), ",").alias("genres"))


@query("SELECT p_partkey AS item_id, p_partkey % 7 = 0 AND p_partkey % 5 < 3 AS compilation FROM part")
def compilations(spark, sf):
    return _products(spark, sf).select("item_id", M.is_compilation(F.col("title"), F.col("domain")).alias("compilation"))


@query("""SELECT item_id, string_agg(name, ',' ORDER BY rank DESC, i) AS keywords FROM (
 SELECT p_partkey AS item_id, p_type AS name, p_partkey * 3 % 17 AS rank, 0 AS i, p_partkey % 3 = 0 AS spoiler FROM part UNION ALL
 SELECT p_partkey, p_brand, p_partkey * 5 % 17, 1, p_partkey % 5 = 0 FROM part UNION ALL SELECT p_partkey, p_name, p_partkey * 7 % 17, 2, p_partkey % 7 = 0 FROM part)
WHERE NOT spoiler GROUP BY 1""")
def ranked_keywords(spark, sf):
    # Items whose tags all give something away have no keywords and no row.
    found = _products(spark, sf).select("item_id", M.ranked_keywords(F.col("tags")).alias("k")).where(F.size("k") > 0)
    return found.select("item_id", F.array_join("k", ",").alias("keywords"))


@query("""WITH {T} SELECT item_id, title, CASE item_id % 3 WHEN 0 THEN 'game' WHEN 1 THEN 'movie' END AS domain, CASE WHEN item_id % 2 = 0 THEN year END AS year FROM items""")
def parse_title_query(spark, sf):
    n = F.col("item_id")
    typed = F.concat(F.when(n % 3 == 0, " Game : ").when(n % 3 == 1, "film:").otherwise(""), "title", F.when(n % 2 == 0, F.concat(F.lit(" ("), F.col("year").cast("string"), F.lit(") "))).otherwise(""))
    return items(spark, sf).select("item_id", M.parse_title_query(typed).alias("q")).select("item_id", "q.*")


@query("""WITH w AS (SELECT DISTINCT p_partkey AS item_id, unnest(regexp_extract_all(lower(p_name || ' ' || p_brand), '[a-z0-9]+')) AS w FROM part)
SELECT DISTINCT item_id, substr(w, 1, n) AS token FROM (SELECT item_id, w, unnest(range(1, least(length(w), 12) + 1)) AS n FROM w)""")
def prefix_tokens(spark, sf):
    return items(spark, sf).select("item_id", F.explode(M.prefix_tokens(T.norm_words(F.concat_ws(" ", "title", "creator")))).alias("token"))


@query("""WITH w AS (SELECT p_partkey AS item_id, regexp_extract_all(lower(p_name || ' ' || p_brand), '[a-z0-9]+') AS w FROM part),
s AS (SELECT item_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)
SELECT DISTINCT item_id, array_to_string(w[i : j], ' ') AS span FROM (SELECT item_id, w, i, unnest(range(i, len(w) + 1)) AS j FROM s)""")
def word_spans(spark, sf):
    return items(spark, sf).select("item_id", F.explode(M.word_spans(T.norm_words(F.concat_ws(" ", "title", "creator")))).alias("span"))


@query("""WITH {I} SELECT user_id, item_id, (rating - min(rating) OVER u) / (max(rating) OVER u - min(rating) OVER u + 1e-9) AS score FROM inter WINDOW u AS (PARTITION BY user_id)""")
def minmax_in_query(spark, sf):
    return core.minmax_in_group(interactions(spark, sf), "user_id", "rating").select("user_id", "item_id", "score")


@query("""WITH {I}, {T}, p AS (SELECT item_id, creator, coalesce(n, 0) AS popularity FROM items LEFT JOIN (SELECT item_id, count(*) AS n FROM inter GROUP BY 1) USING (item_id))
SELECT a.item_id, b.item_id AS linked_id, row_number() OVER (PARTITION BY a.item_id ORDER BY b.popularity DESC, b.item_id)::INTEGER AS rank
FROM p a JOIN p b ON a.creator = b.creator AND a.item_id <> b.item_id QUALIFY rank <= 24""")
def links_topk(spark, sf):
    popular = interactions(spark, sf).groupBy("item_id").agg(F.count("*").alias("n"))
    members = items(spark, sf).select("item_id", "creator").join(popular, "item_id", "left").select("item_id", "creator", F.coalesce("n", F.lit(0)).alias("popularity"))
    return core.links_topk(members, "creator")
