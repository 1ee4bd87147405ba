"""Products as editions of works, new titles from several sources, and lists without repeated works."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import materialise
from . import core

# Years that editions of one work may lie apart, where the title states a year and where it doesn't; the genre of anime.
STATED, OTHERWISE = 1, 3
ANIME = "Anime"


def canonicalize(rows: DataFrame) -> DataFrame:
    """``rows`` (domain, title, year) with ``norm_title``, ``cluster`` (the first year of the row's cluster where its title has
    several, else null) and ``work_id``; rows whose title has no key are left out.

    The year that counts is the one in the title; for games without one, the metadata's. Years of one title that lie further
    apart than its tolerance are different works: ``STATED`` if any of the titles states a year, else ``OTHERWISE``. Rows without a year
    go to the cluster with most rows, ties to the earliest. Titles of one cluster have the same id as without years.
    """
    stated = T.extract_year(F.col("title"))
    known = rows.withColumn("norm_title", T.normalize_title(F.col("title"), F.col("domain"))).where("norm_title <> ''").withColumn("__year", F.coalesce(stated, F.when(F.col("domain") == "game", F.col("year"))))
    own = ["domain", "norm_title"]
    tolerance = known.groupBy(*own).agg(F.min(F.when(stated.isNotNull(), STATED).otherwise(OTHERWISE)).alias("tolerance"))
    years = known.where("__year is not null").groupBy(*own, "__year").agg(F.count("*").alias("n")).join(tolerance, own)
    order = W.partitionBy(*own).orderBy("__year")
    years = years.withColumn("c", F.when(F.col("__year") - F.lag("__year").over(order) > F.col("tolerance"), 1).otherwise(0)).withColumn("c", F.sum("c").over(order))
    cluster = W.partitionBy(*own, "c")
    years = years.withColumn("first", F.min("__year").over(cluster)).withColumn("size", F.sum("n").over(cluster))
    heads = years.groupBy(*own).agg(F.countDistinct("first").alias("clusters"), F.max_by("first", F.struct("size", -F.col("first"))).alias("largest"))
    placed = known.join(years.select(*own, "__year", "first"), [*own, "__year"], "left").join(heads, own, "left")
    at = F.when(F.col("clusters") > 1, F.coalesce("first", "largest"))
    key = F.when(at.isNull(), F.col("norm_title")).otherwise(F.concat_ws("|", "norm_title", at.cast("string")))
    return placed.select(*rows.columns, "norm_title", at.alias("cluster"), T.stable_id(F.col("domain"), key).alias("work_id"))


def merge_sources(rows: DataFrame, more: DataFrame, tag: str = ANIME) -> DataFrame:
    """``rows`` and those of ``more`` that aren't among them; columns of ``rows``.

    ``rows``: item_id, domain, kind, title, year, genres (array) and others; ``more``: the same and ``names``, all its names. A row of
    ``more`` is the film or series with one of its names as key, the same kind and a year within one (null years fit): of several
    the first by item_id, whose genres then begin with ``tag``. Names are exploded and joined by key, so no pairs are made.
    """
    plain = lambda c: T.norm_words(F.regexp_replace(c, "['’‘`]", ""))
    named = more.select(F.col("item_id").alias("__of"), F.col("kind").alias("__kind"), F.col("year").alias("__year"), F.explode("names").alias("__name")).withColumn("__key", plain(F.col("__name"))).drop("__name")
    named = materialise(named)
    # Of the rows with one key, kind and year only the first can be found, so names meet a row a year and never all of a frequent title.
    own = rows.where("domain = 'movie'").select("item_id", F.col("kind").alias("__kind"), F.col("year").alias("__year"), plain(F.col("title")).alias("__key"))
    same, first = ["__kind", "__key"], F.min("item_id").alias("__same")
    own = materialise(own.groupBy(*same, "__year").agg(F.min("item_id").alias("item_id")))
    close = own.withColumn("__year", F.explode(F.array(*[F.col("__year") + d for d in (-1, 0, 1)])))
    met = [
        named.join(close.groupBy(*same, "__year").agg(first), [*same, "__year"]),
        named.join(own.where("__year is null").groupBy(*same).agg(first), same),
        named.where("__year is null").join(own.groupBy(*same).agg(first), same),
    ]
    found = reduce(DataFrame.unionByName, [m.select("__of", "__same") for m in met]).groupBy("__of").agg(F.min("__same").alias("__same"))
    tagged = found.select(F.col("__same").alias("item_id")).distinct().withColumn("__tagged", F.lit(True))
    has = F.array_contains("genres", tag)
    kept = rows.join(tagged, "item_id", "left").withColumn("genres", F.when(F.col("__tagged") & ~has, F.concat(F.array(F.lit(tag)), "genres")).otherwise(F.col("genres"))).select(*rows.columns)
    rest = more.join(found, more["item_id"] == found["__of"], "left_anti").select(*rows.columns)
    return kept.unionByName(rest)


def new_titles(rows: DataFrame, known: DataFrame, catalog_titles: DataFrame, last_year: int = 2023) -> DataFrame:
    """New titles, most voted for first: those that the catalogue doesn't have, one row an item_id.

    Known are ids among ``known`` (source, ext_id), and, for works out by ``last_year`` or without a year, titles among
    ``catalog_titles`` (domain, title) by their words. Rows without a title go.
    """
    rows = materialise(rows)
    n = rows.count()
    by_id = rows.where(F.trim("title") != "").join(known.select("source", "ext_id").distinct(), ["source", "ext_id"], "left_anti")
    names = catalog_titles.select(F.col("domain").alias("__domain"), T.norm_words(F.col("title")).alias("__key")).distinct()
    old = F.coalesce(F.col("year"), F.lit(0)) <= last_year
    left = by_id.join(names, (F.col("domain") == F.col("__domain")) & (T.norm_words(F.col("title")) == F.col("__key")) & old, "left_anti")
    first = core.latest(core.dealt(left, n, "item_id"), ["item_id"], F.desc("votes"), "title").withColumn("year", F.coalesce("year", F.lit(0)))
    order = [F.desc("votes"), "item_id"]
    return first.repartitionByRange(core.parts_of(first, n), *order).sortWithinPartitions(*order)  # in order as a whole


#: What landed responses of each source look like.
SHAPES = {
    "film": "id long, title string, release_date string, vote_count long, genres array<struct<name: string>>, overview string",
    "series": "id long, name string, first_air_date string, vote_count long, genres array<struct<name: string>>, overview string",
    "game": "id long, name string, first_release_date long, total_rating_count long, genres array<struct<name: string>>, themes array<struct<name: string>>, summary string",
    "anime": "id long, title struct<english: string, romaji: string>, synonyms array<string>, startDate struct<year: int>, format string, popularity long, genres array<string>, description string",
}


def flatten_titles(landed: DataFrame, shape: str) -> DataFrame:
    """Landed responses (``json``) of one source as rows: item_id, source, ext_id, domain, kind, title, names, year, votes, genres,
    text. Responses without an id or title go; lists that are missing are empty."""
    r = landed.select(F.from_json("json", SHAPES[shape]).alias("r")).select("r.*").where("id is not null")
    names = lambda c: F.coalesce(F.transform(c, lambda g: g["name"]), F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    if shape in ("film", "series"):
        title, date = ("title", "release_date") if shape == "film" else ("name", "first_air_date")
        told: dict[str, Column] = {
            "source": F.lit("screen"), "domain": F.lit("movie"), "kind": F.lit("movie" if shape == "film" else "tv"), "title": F.col(title), "names": F.array(title), "year": T.release_year(F.col(date)),
            "votes": F.col("vote_count"), "genres": names("genres"), "text": F.col("overview"),
        }
    elif shape == "game":
        told = {
            "source": F.lit("games"), "domain": F.lit("game"), "kind": F.lit("game"), "title": F.col("name"), "names": F.array("name"), "year": T.release_year(F.col("first_release_date").cast("string")),
            "votes": F.col("total_rating_count"), "genres": F.array_distinct(F.concat(names("genres"), names("themes"))), "text": F.col("summary"),
        }
    else:
        own = F.array_distinct(F.array_compact(F.concat(F.array("title.english", "title.romaji"), F.coalesce("synonyms", none))))
        told = {
            "source": F.lit("anime"), "domain": F.lit("movie"), "kind": F.when(F.col("format") == "MOVIE", "movie").otherwise("tv"), "title": F.coalesce("title.english", "title.romaji"), "names": own,
            "year": F.col("startDate.year"), "votes": F.col("popularity"), "genres": F.array_distinct(F.concat(F.array(F.lit(ANIME)), F.coalesce("genres", none))), "text": T.clean_markup(F.col("description")),
        }
    rows = r.select("id", *[c.alias(k) for k, c in told.items()]).where(F.trim("title") != "")
    return rows.select(
        F.concat_ws("_", "source", "kind", F.col("id").cast("string")).alias("item_id"), "source", F.col("id").alias("ext_id"), "domain", "kind", "title", "names", F.col("year").cast("int").alias("year"),
        F.coalesce("votes", F.lit(0)).cast("long").alias("votes"), "genres", F.coalesce("text", F.lit("")).alias("text"),
    )


def dedupe_works(ranked: DataFrame, k: int | None = None) -> DataFrame:
    """Each user's list (user_id, item_id, kind, key, family, rank) without repeated works: of those with one kind and key the first
    stays, then of those of one family; the rest is ranked anew and cut at ``k``. Null and empty families are nobody's."""
    first = core.latest(ranked, ["user_id", "kind", "key"], "rank", "item_id")
    family = F.coalesce(F.nullif("family", F.lit("")), F.concat(F.lit("\x00"), F.col("kind"), F.lit("|"), F.coalesce("key", F.lit("")), F.lit("|"), F.col("item_id").cast("string")))
    left = core.latest(first.withColumn("__family", family), ["user_id", "__family"], "rank", "item_id").drop("__family")
    out = core.ranked(left, ["user_id"], "rank", "item_id", name="__rank")
    out = out.where(F.col("__rank") <= k) if k else out
    return out.drop("rank").withColumnRenamed("__rank", "rank")
