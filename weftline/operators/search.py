"""Order of search results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import core


def search_order(found: DataFrame, k: int = 20, partial: int = 2) -> DataFrame:
    """``q, item_id, rank`` of the first ``k`` of ``found`` (q, item_id, exact, same_year, prefix, new booleans, popularity).

    Exact catalogue titles come first, then exact new ones, then the best ``partial`` other new ones, then the rest; inside
    each by same year, prefix, popularity and id.
    """
    inside = [F.desc("same_year"), F.desc("prefix"), F.desc("popularity"), F.col("item_id")]
    place = F.row_number().over(W.partitionBy("q", "exact", "new").orderBy(*inside))
    tier = F.when(F.col("exact") & ~F.col("new"), 0).when(F.col("exact"), 1).when(F.col("new") & (place <= partial), 2).otherwise(3)
    return core.top(found.withColumn("tier", tier), ["q"], k, "tier", *inside).select("q", "item_id", "rank")
