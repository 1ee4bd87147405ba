"""Evidence for recommendations: shared themes, liked titles that lead to them, confidence, and a sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import core

# Bounds of the claims.
HIGH_LIKES, SOME_LIKES, CLAIMED_LIKES = 20, 5, 3
HIGH_SIM, SOME_SIM, CLAIMED_SIM = 0.6, 0.4, 0.35
GENERIC_SHARE = 0.2


def theme_shares(themes: DataFrame) -> DataFrame:
    """``item_id, rare``: each item's ``themes``, the least frequent in the catalogue first, with their share of it."""
    each = themes.select("item_id", F.explode(F.array_distinct("themes")).alias("theme"))
    total = themes.agg(F.count("*").alias("total"))
    share = each.groupBy("theme").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("theme", (F.col("n") / F.col("total")).alias("share"))
    return each.join(share, "theme").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("share", "theme"))).alias("rare"))


def taste(history: DataFrame, themes: DataFrame) -> DataFrame:
    """``user_id, profile, avoided``: themes of liked items by count, and those of the disliked ones."""
    liked, low = F.col("weight") > 0, F.col("weight") < 0
    rows = history.join(themes.select("item_id", F.slice("themes", 1, 4).alias("t")), "item_id").select("user_id", "weight", "t").repartition("user_id")  # for both groupings
    each = rows.select("user_id", "weight", F.explode(F.when(liked, F.col("t")).when(low, F.slice("t", 1, 3))).alias("theme"))
    counts = each.groupBy("user_id", "theme").agg(F.count_if(liked).alias("n"), F.count_if(low).alias("n_low"))
    return counts.groupBy("user_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct((-F.col("n")).alias("n"), "theme")))), lambda s: s["theme"]).alias("profile"),
        F.collect_set(F.when(F.col("n_low") > 0, F.col("theme"))).alias("avoided"),
    )


def liked_together(recs: DataFrame, liked: DataFrame, likes: DataFrame) -> DataFrame:
    """``user_id, item_id, anchor, co``: the user's liked titles that stand with the item in ``likes``.

    An item with fewer partners than the user has liked titles meets its partners, another one the liked titles, so that no more
    rows are made than the smaller side has.
    """
    co = likes.select(F.col("j").alias("item_id"), F.col("i").alias("anchor"), F.col("c").alias("co"))
    known = recs.join(co.groupBy("item_id").agg(F.count("*").alias("partners")), "item_id").join(liked.groupBy("user_id").agg(F.count("*").alias("titles")), "user_id")
    few, many = (known.where(c).select("user_id", "item_id") for c in ("partners <= titles", "partners > titles"))
    return few.join(co, "item_id").join(liked, ["user_id", "anchor"]).unionByName(many.join(liked, "user_id").join(co, ["item_id", "anchor"]))


def alike(recs: DataFrame, liked: DataFrame, vectors: DataFrame) -> DataFrame:
    """``user_id, item_id, anchor, sim``: cosines of items and liked titles that both have a vector other than 0. Vectors are dealt to
    the user's items and titles before these are paired, not to pairs."""
    known = vectors.select("item_id", "v", core.norm(F.col("v")).alias("l")).where("l > 0")
    a = recs.join(known.withColumnsRenamed({"v": "a", "l": "la"}), "item_id")
    b = liked.join(known.select(F.col("item_id").alias("anchor"), F.col("v").alias("b"), F.col("l").alias("lb")), "anchor")
    return a.join(b, "user_id").select("user_id", "item_id", "anchor", F.round(core.dot(F.col("a"), F.col("b")) / (F.col("la") * F.col("lb")), 6).alias("sim"))


def anchors(recs: DataFrame, history: DataFrame, likes: DataFrame, vectors: DataFrame, titles: DataFrame) -> DataFrame:
    """``user_id, item_id, co_likes, similarity, anchors``: the best of all liked titles, and the three strongest.

    ``likes`` holds pairs ``i, j, c`` of items liked together, ``vectors`` ``item_id, v``; missing ones count as 0. Rows are made of
    liked titles with one or the other; of the rest, which are all as strong, only the first three can be among the strongest.
    """
    liked = history.where("weight > 0").select("user_id", F.col("item_id").alias("anchor"))
    recs = recs.select("user_id", "item_id")
    some = liked_together(recs, liked, likes).withColumn("sim", F.lit(None).cast("double")).unionByName(alike(recs, liked, vectors).withColumn("co", F.lit(None).cast("long")))
    some = some.groupBy("user_id", "item_id", "anchor").agg(F.coalesce(F.max("co"), F.lit(0)).alias("co"), F.coalesce(F.max("sim"), F.lit(0.0)).alias("sim"))
    place = lambda co, sim, anchor: F.struct((-F.round(F.log1p(co) + 2 * sim, 6)).alias("place"), anchor.alias("anchor"), co.alias("co"), sim.alias("sim"))
    some = some.groupBy("user_id", "item_id").agg(F.max("co").alias("co"), F.max("sim").alias("sim"), F.array_sort(F.collect_list(place(F.col("co"), F.col("sim"), F.col("anchor")))).alias("some"))
    own = liked.groupBy("user_id").agg(F.array_sort(F.collect_set("anchor")).alias("liked"))
    none = F.transform(
        F.slice(F.array_except(F.slice("liked", F.lit(1), 3 + F.size("some")), F.transform("some", lambda s: s["anchor"])), 1, 3),
        lambda x: place(F.lit(0).cast("long"), F.lit(0.0), x),
    )
    rows = recs.join(own, "user_id").join(some, ["user_id", "item_id"], "left")
    rows = rows.withColumn("some", F.coalesce("some", F.array().cast(some.schema["some"].dataType)))
    best = rows.select(
        "user_id", "item_id", F.coalesce("co", F.lit(0)).alias("co_likes"), F.when(F.size("some") < F.size("liked"), F.greatest("sim", F.lit(0.0))).otherwise(F.col("sim")).alias("similarity"),
        F.slice(F.array_sort(F.concat(F.slice("some", 1, 3), none)), 1, 3).alias("three"),
    )
    three = best.select("user_id", "item_id", "co_likes", "similarity", F.posexplode("three").alias("at", "s")).select("user_id", "item_id", "co_likes", "similarity", (F.col("at") + 1).alias("rank"), "s.anchor", "s.co", "s.sim")
    named = three.join(titles.select(F.col("item_id").alias("anchor"), "title"), "anchor", "left")
    return named.groupBy("user_id", "item_id").agg(
        F.first("co_likes").alias("co_likes"), F.first("similarity").alias("similarity"), F.array_sort(F.collect_list(F.struct("rank", "anchor", "title", "co", "sim"))).alias("anchors"),
    )


def evidence(recs: DataFrame, history: DataFrame, themes: DataFrame, likes: DataFrame, vectors: DataFrame, titles: DataFrame) -> DataFrame:
    """One row for each of ``recs`` (user_id, item_id), whatever is known of the user or the item.

    ``shared``: up to five of the item's themes that the user's liked titles have, rarest first, as (share, theme); ``overlap``:
    of its themes with the user's six most frequent; ``co_likes``, ``similarity``, ``anchors``: see above; ``disliked``: its
    themes that disliked titles have; ``confidence``. A user without likes has no anchors, zeros and low confidence.
    """
    out = recs.select("user_id", "item_id").join(theme_shares(themes), "item_id", "left").join(taste(history, themes), "user_id", "left")
    for column in ("profile", "avoided"):
        out = out.withColumn(column, F.coalesce(column, F.array().cast("array<string>")))
    rare = F.coalesce("rare", F.array().cast("array<struct<share:double,theme:string>>"))
    own = F.transform(rare, lambda s: s["theme"])
    first = F.slice("profile", 1, 6)
    overlap = F.when((F.size(own) == 0) | (F.size(first) == 0), 0.0).otherwise(F.round(F.size(F.array_intersect(own, first)) / F.size(F.array_union(own, first)), 3))
    out = out.select(  # before the join of anchors, which then carries no profiles
        "user_id", "item_id", F.slice(F.filter(rare, lambda s: F.array_contains("profile", s["theme"])), 1, 5).alias("shared"), overlap.alias("overlap"),
        F.array_sort(F.array_intersect(own, "avoided")).alias("disliked"),
    )
    out = out.join(anchors(recs, history, likes, vectors, titles), ["user_id", "item_id"], "left")
    out = out.select("user_id", "item_id", "shared", "overlap", F.coalesce("co_likes", F.lit(0)).alias("co_likes"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"), "anchors", "disliked")
    some = F.size("shared") > 0
    high = ((F.col("co_likes") >= HIGH_LIKES) | (F.col("similarity") >= HIGH_SIM)) & some
    medium = (F.col("co_likes") >= SOME_LIKES) | (F.col("similarity") >= SOME_SIM) | some
    return out.withColumn("confidence", F.when(high, "high").when(medium, "medium").otherwise("low"))


def summary(fallback: str) -> Column:
    """A sentence over the columns of ``evidence``; ``fallback`` tells what found the item where no claim holds."""
    by_likes = F.array_max(F.transform("anchors", lambda s: F.struct(s["co"].alias("n"), (-s["rank"]).alias("place"), s["title"].alias("title"))))
    by_sim = F.array_max(F.transform("anchors", lambda s: F.struct(s["sim"].alias("n"), (-s["rank"]).alias("place"), s["title"].alias("title"))))
    liked = by_likes["n"] >= CLAIMED_LIKES
    alike = (by_sim["n"] >= CLAIMED_SIM) & (~liked | (by_sim["place"] != by_likes["place"]))
    telling = F.slice(F.filter("shared", lambda s: s["share"] <= GENERIC_SHARE), 1, 3)
    claims = F.array_compact(F.array(
        F.when(liked, F.concat(by_likes["n"].cast("string"), F.lit(" people liked both this and "), by_likes["title"])),
        F.when(alike, F.concat(F.lit("it is close to "), by_sim["title"])),
        F.when(F.size(telling) > 0, F.concat(F.lit("you like "), F.array_join(F.transform(telling, lambda s: s["theme"]), ", "))),
    ))
    warning = F.when(F.size("disliked") > 0, F.concat(F.lit(" It has themes you rated low: "), F.array_join("disliked", ", "), F.lit("."))).otherwise("")
    return F.concat(F.lit("Chosen since "), F.when(F.size(claims) > 0, F.array_join(claims, "; ")).otherwise(fallback), F.lit("."), warning)
