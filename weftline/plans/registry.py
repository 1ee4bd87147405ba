"""Where queries and their SQL are gathered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The derived tables as common table expressions; see ``weftline.sources.tables``.
RAW = """raw AS (SELECT o_custkey AS user_id, l_partkey AS item_id, CASE WHEN l_partkey % 5 < 3 THEN 'movie' ELSE 'game' END AS domain,
 (1 + floor((l_quantity - 1) / 10))::DOUBLE AS rating, epoch(o_orderdate)::BIGINT AS timestamp FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
INTER = RAW + """, inter AS (SELECT user_id, item_id, domain, max(rating) AS rating, min(timestamp) AS timestamp FROM raw GROUP BY ALL)"""
ITEMS = """items AS (SELECT p_partkey AS item_id, CASE WHEN p_partkey % 5 < 3 THEN 'movie' ELSE 'game' END AS domain, p_name AS title,
 [p_type] AS genres, p_brand AS creator, (1970 + p_size)::INTEGER AS year FROM part)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name. ``{I}``, ``{R}`` and ``{T}`` in the SQL stand for the derived tables."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.replace("{I}", INTER).replace("{R}", RAW).replace("{T}", ITEMS)
        return f

    return add
