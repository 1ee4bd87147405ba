"""Approximate nearest neighbours by score-aware quantisation (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: The codebooks are fitted on about so many rows, taken by hash of the id. Every row is indexed.
TRAIN_ROWS = 20_000
#: Two dimensions a codebook, 16 centres (four bits) each.
SUB_DIMS, CENTRES = 2, 16
#: Weight of the residual along the vector against the residual across it, for inner products of at least this cosine.
THRESHOLD = 0.2
#: Rows of a block of the index, queries of a block, and candidates that each block first scores exactly for a query.
BLOCK_ROWS, BLOCK_QUERIES, RERANK = 8_192, 16_384, 64


def parallel_weight(dims: int) -> float:
    """How much more an error along a unit vector costs, if only scores from ``THRESHOLD`` up matter (score-aware loss)."""
    t2 = THRESHOLD**2
    return max(1.0, (dims - 1) * t2 / (1 - t2))


def fit(x: np.ndarray, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Codebooks (parts, 16, SUB_DIMS) that make the score-aware error small on the rows of ``x``.

    The error of a row is |r|^2 + (h - 1) (r.u)^2 with r its residual and u its direction. Rounds alternate codes (each part
    in turn against the others' residual along u) and centres (the least-squares solution for each part given the rest).
    """
    rng = np.random.default_rng(seed)
    n, dims = x.shape
    parts = dims // SUB_DIMS
    h = parallel_weight(dims) - 1
    sub = x.reshape(n, parts, SUB_DIMS)
    unit = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).reshape(n, parts, SUB_DIMS)
    books = np.stack([sub[rng.choice(n, CENTRES, replace=n < CENTRES), p] for p in range(parts)])
    for turn in range(rounds):
        codes = encode(x, books, sweeps=1)
        along = np.einsum("npd,npd->n", sub - books[np.arange(parts), codes], unit)
        for p in range(parts):
            r = sub[:, p] - books[p, codes[:, p]]
            others = along - np.einsum("nd,nd->n", r, unit[:, p])
            for c in range(CENTRES):
                of = np.flatnonzero(codes[:, p] == c)
                if not len(of):
                    books[p, c] = sub[rng.integers(n), p]
                    continue
                u = unit[of, p]
                a = len(of) * np.eye(SUB_DIMS) + h * u.T @ u
                b = sub[of, p].sum(0) + h * (u * (others[of] + np.einsum("nd,nd->n", sub[of, p], u))[:, None]).sum(0)
                books[p, c] = np.linalg.solve(a, b)
            along = others + np.einsum("nd,nd->n", sub[:, p] - books[p, codes[:, p]], unit[:, p])
    return books


def encode(x: np.ndarray, books: np.ndarray, sweeps: int = 2) -> np.ndarray:
    """Four-bit codes by coordinate descent on the score-aware error, from the nearest centres."""
    n, dims = x.shape
    parts = len(books)
    h = parallel_weight(dims) - 1
    sub = x.reshape(n, parts, SUB_DIMS)
    unit = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).reshape(n, parts, SUB_DIMS)
    # plain[n, p, c] = |x_p - centre|^2 and part[n, p, c] = (x_p - centre).u_p
    plain = ((sub[:, :, None, :] - books[None]) ** 2).sum(-1)
    part = np.einsum("npd,npd->np", sub, unit)[:, :, None] - np.einsum("pcd,npd->npc", books, unit)
    codes = plain.argmin(2)
    rows = np.arange(n)
    along = np.take_along_axis(part, codes[:, :, None], 2)[:, :, 0].sum(1)
    for _ in range(sweeps):
        for p in range(parts):
            others = along - part[rows, p, codes[:, p]]
            codes[:, p] = (plain[:, p] + h * (others[:, None] + part[:, p]) ** 2).argmin(1)
            along = others + part[rows, p, codes[:, p]]
    return codes.astype(np.uint8)


def packed(codes: np.ndarray) -> np.ndarray:
    """Two codes a byte; an odd last one stands alone."""
    even = codes if codes.shape[1] % 2 == 0 else np.pad(codes, ((0, 0), (0, 1)))
    return even[:, 0::2] | even[:, 1::2] << 4


def unpacked(codes: np.ndarray, parts: int) -> np.ndarray:
    """One row for each part, so that a scan reads a part's codes one after the other."""
    out = np.empty((2 * codes.shape[1], len(codes)), np.uint8)
    out[0::2], out[1::2] = codes.T & 15, codes.T >> 4
    return out[:parts]


def usable(vector: Column) -> Column:
    """Not null, not all zero, and without null or non-finite components."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda v: v != 0), F.lit(False))


def nearest(embeddings: DataFrame, queries: DataFrame, k: int = 20, rerank: int = RERANK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` rows with the largest inner product found for each query, the query's own row aside.

    Columns: ``query_id``, ``rank`` int (from 1), the id, ``score`` double (exact, on the original vectors); equal scores go
    to the smaller id. Rows whose vector is null, all zero or holds null or non-finite components, or whose id is null, take
    no part, nor do vectors of another length than most in the training sample. Rows that repeat an id are one candidate, with
    the largest of their scores; a query that repeats asks with the smallest of its vectors, component by component. Other
    columns are not read; an empty table gives no rows.

    Codebooks are fitted on a bounded sample and broadcast (a few KB). Every row is coded once, two codes a byte, and dealt
    to a block of the index by hash, so equal vectors spread over blocks; queries come in large blocks too, and each pair of
    blocks is one group: tables of the queries' products with the centres are scanned by code, the best ``rerank`` rows of
    the block (and all that equal the last of them) are scored exactly, then twice as many, and so on until a slice adds
    nothing to the best ``k``, which go on. So near copies, whose rough scores say little about their order, are all scored.
    Blocks have about the same size at any input; rows are sent once for every 16,384 queries, queries once for every 8,192
    rows.
    """
    spark = embeddings.sparkSession
    base = embeddings.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(usable(F.col("v")) & F.col("id").isNotNull())
    asked = queries.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(usable(F.col("v")) & F.col("id").isNotNull()).groupBy("id").agg(F.min("v").alias("v"))
    n, m = base.count(), asked.count()
    share = min(1.0, TRAIN_ROWS / max(n, 1))
    sample = base.where(F.pmod(F.xxhash64(F.lit("train"), "id"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * TRAIN_ROWS).collect()
    sizes = [len(r["v"]) for r in sample]
    dims = max(set(sizes), key=lambda s: (sizes.count(s), s)) if sizes else 0
    kind = embeddings.schema[id_col].dataType.simpleString()
    schema = f"query_id {kind}, id {kind}, score double"
    if not dims:
        return spark.createDataFrame([], f"query_id {kind}, rank int, `{id_col}` {kind}, score double")
    width = -(-dims // SUB_DIMS) * SUB_DIMS

    def matrix(vectors: pa.Array) -> np.ndarray:
        """Rows as a matrix, with zeros up to a whole number of parts."""
        out = np.zeros((len(vectors), width))
        out[:, :dims] = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        return out

    x = np.zeros((sum(s == dims for s in sizes), width))
    x[:, :dims] = [r["v"] for r in sample if len(r["v"]) == dims]
    books = spark.sparkContext.broadcast(fit(x))
    blocks, query_blocks = max(1, -(-n // BLOCK_ROWS)), max(1, -(-m // BLOCK_QUERIES))
    cut = lambda name, count: F.pmod(F.xxhash64(F.lit(name), "id"), F.lit(count)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_048):
                some = batch.slice(at, 2_048)
                codes = packed(encode(matrix(some.column(1)), books.value))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "v", "code"])

    coded = base.where(F.size("v") == dims).mapInArrow(code, f"id {kind}, v array<double>, code binary")
    # A query block meets every block of the index; queries are the rows without a code.
    rows = coded.withColumn("block", cut("row", blocks)).withColumn("group", each(query_blocks))
    asks = asked.where(F.size("v") == dims).withColumn("code", F.lit(None).cast("binary")).withColumn("group", cut("query", query_blocks)).withColumn("block", each(blocks))

    def search(table: pa.Table) -> pa.Table:
        is_query = table.column("code").is_null().to_numpy()
        v = matrix(table.column("v").combine_chunks())
        q, d = v[is_query], v[~is_query]
        ids = table.column("id").combine_chunks()
        q_ids, d_ids = ids.filter(pa.array(is_query)), ids.filter(pa.array(~is_query))
        if not len(q) or not len(d):
            return pa.table({"query_id": q_ids[:0], "id": d_ids[:0], "score": pa.array([], pa.float64())})
        order = np.argsort(d_ids.to_numpy(zero_copy_only=False), kind="stable")
        d, d_ids = d[order], d_ids.take(pa.array(order))
        raw = b"".join(table.column("code").filter(pa.array(~is_query)).to_pylist())
        codes = unpacked(np.frombuffer(raw, np.uint8).reshape(len(d), -1)[order], len(books.value))
        q_names, d_names = (x.to_numpy(zero_copy_only=False) for x in (q_ids, d_ids))
        out_q, out_d, out_s = [], [], []
        top, repeated = min(rerank, len(d)), bool((d_names[1:] == d_names[:-1]).any())
        for at in range(0, len(q), 64):
            some = q[at : at + 64]
            luts = np.einsum("qpd,pcd->pqc", some.reshape(len(some), -1, SUB_DIMS), books.value).astype(np.float32)
            rough = np.zeros((len(some), len(d)), np.float32)
            for p in range(len(codes)):
                rough += luts[p][:, codes[p]]
            for i, scores in enumerate(rough):
                best, s, size, done = np.zeros(0, int), np.zeros(0), top, np.zeros(len(d), bool)
                while True:
                    near = scores >= np.partition(scores, len(d) - size)[len(d) - size]
                    more = np.flatnonzero(near & ~done)
                    more = more[d_names[more] != q_names[at + i]]
                    # Row by row, so that equal vectors have equal scores; these go to the smaller ids, whose order the rows have.
                    best, s, seen = np.concatenate([best, more]), np.concatenate([s, (d[more] * some[i]).sum(1)]), len(s)
                    kept = np.lexsort((best, -s))
                    if repeated:  # the first, and best, of each id
                        kept = kept[np.sort(np.unique(d_names[best[kept]], return_index=True)[1])]
                    kept = kept[:k]
                    best, s = best[kept], s[kept]
                    if size == len(d) or (len(s) == k and (kept < seen).all()):
                        break
                    done, size = near, min(2 * max(size, int(near.sum())), len(d))
                out_q.append(np.full(len(best), at + i))
                out_d.append(best)
                out_s.append(s)
        qi, di, s = map(np.concatenate, (out_q, out_d, out_s))
        return pa.table({"query_id": q_ids.take(pa.array(qi)), "id": d_ids.take(pa.array(di)), "score": pa.array(s)})

    near = rows.unionByName(asks).groupBy("block", "group").applyInArrow(search, schema).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
