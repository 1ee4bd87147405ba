"""Near-duplicate groups by b-bit MinHash (operator 5)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, Numbering, free, in_small_batches, materialise, mix64, slices, spaced_words, utf8, with_ids
from .components import components

#: Minima of a signature, in bands of ROWS: a pair at similarity 0.8 shares no band with a chance of 5e-8.
BANDS, ROWS = 32, 4
MINIMA = BANDS * ROWS
#: Low bits kept of each minimum.
BITS = 4
#: Pairs whose estimate is lower than the threshold by this much aren't compared: about 4 standard deviations, beyond which
#: lies one link in 21,000 of those at a similarity of exactly 0.8. A slack of 1 compares all that share a band.
SLACK = 0.15
#: Documents of a bucket's block, and shingles and documents of a block of a candidate group.
BUCKET_ROWS, BLOCK_SHINGLES, BLOCK_NODES = 1_024, 2_000_000, 4_096
#: Documents that stand for the largest cluster of a block when blocks are tied to each other.
SPEAKERS = 16

_rng = np.random.default_rng(20)
_ADD = _rng.integers(0, 1 << 32, MINIMA, dtype=np.uint32)
_TIMES = _rng.integers(0, 1 << 31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_WORD_TIMES = mix64(np.arange(1, 65))


def word_hashes(batch_words: list[list[bytes]]) -> np.ndarray:
    """64-bit hashes of all words of a batch, one after the other; each distinct word is hashed once."""
    known = Numbering()
    codes = np.fromiter(map(known.__getitem__, chain.from_iterable(batch_words)), np.int64)
    table = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in known), np.uint64)
    return table[codes] if len(codes) else np.zeros(0, np.uint64)


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``n`` words; of the whole sequence if it is shorter; none without words."""
    size = min(n, len(hashes))
    if not size:
        return np.zeros(0, np.uint64)
    k = len(hashes) - size + 1
    h = np.full(k, size, np.uint64)
    for i in range(size):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + k])
    return np.unique(h)


def sketch(sets: np.ndarray) -> np.ndarray:
    """Minima of the set under each hash function."""
    x = (sets ^ (sets >> np.uint64(32))).astype(np.uint32)
    out = np.empty(MINIMA, np.uint32)
    for at in range(0, MINIMA, 16):
        out[at : at + 16] = ((x[None, :] + _ADD[at : at + 16, None]) * _TIMES[at : at + 16, None]).min(1)
    return out


def packed(minima: np.ndarray) -> np.ndarray:
    """The low ``BITS`` bits of each minimum, two minima a byte."""
    low = (minima & np.uint32((1 << BITS) - 1)).astype(np.uint8)
    return low[0::2] | (low[1::2] << BITS)


def estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity of a packed signature to each of many from equal bit groups, corrected for chance collisions."""
    x = one[None, :] ^ many
    x |= x >> 1 & 0x77
    x |= x >> 2 & 0x33
    equal = 1 - np.bitwise_count(x & 0x11).sum(1, dtype=np.int64) / MINIMA
    return (equal - 2.0**-BITS) / (1 - 2.0**-BITS)


def band_keys(minima: np.ndarray) -> np.ndarray:
    rows = minima.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return h.view(np.int64)


def _sets(batch: pa.RecordBatch, text_at: int, n: int) -> list[np.ndarray]:
    ws = [spaced_words(t) for t in utf8(batch.column(text_at))]
    ends = np.cumsum([len(w) for w in ws])
    return [shingles(h, n) for h in np.split(word_hashes(ws), ends[:-1])] if ws else []


def signatures(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """The id, ``n_shingles``, ``digest`` of the set (null if empty), band ``keys`` and packed signature ``sig``."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            size, digest, keys, sig = [], [], [], []
            for s in _sets(batch, 1, n):
                size.append(len(s))
                m = sketch(s) if len(s) else None
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                keys.append(band_keys(m) if len(s) else None)
                sig.append(packed(m).tobytes() if len(s) else None)
            arrays = [batch.column(0), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "n_shingles", "digest", "keys", "sig"])

    kind = docs.schema[id_col].dataType.simpleString()
    return in_small_batches(docs).select(id_col, text_col).mapInArrow(sign, f"`{id_col}` {kind}, n_shingles long, digest binary, keys array<long>, sig binary")


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j

    def roots(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.up))], np.int64)


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of rows with equal keys, which come together; a run may span batches. Runs are bounded by their blocks."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(x).to_numpy(zero_copy_only=False) for x in keys], 1)
        edges = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1).tolist(), len(k)]
        for a, b in zip(edges, edges[1:]):
            key = tuple(k[a])
            if kept and key != last:
                yield pa.Table.from_batches(kept)
                kept = []
            kept.append(batch.slice(a, b - a))
            last = key
    if kept:
        yield pa.Table.from_batches(kept)


def _bytes_matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def similar_in_buckets(buckets: DataFrame, least: float) -> DataFrame:
    """Edges ``(a, b)`` that tie together what the signatures call similar, inside each block of a bucket.

    A block has up to about ``BUCKET_ROWS`` documents; every block of a divided bucket also holds the bucket's speakers,
    the documents with the smallest hashes, so its blocks hang together where these are alike.
    """

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_out, b_out = [], []
        for run in _runs(batches, ["key", "block"]):
            node = run.column("node").to_numpy()
            sig = _bytes_matrix(run.column("sig"), MINIMA * BITS // 8)
            forest = Forest(len(node))
            for i in range(1, len(node)):
                for j in np.flatnonzero(estimate(sig[i], sig[:i]) >= least):
                    if forest.join(i, int(j)):
                        a_out.append(node[i])
                        b_out.append(node[j])
            if len(a_out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])
                a_out, b_out = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    return buckets.repartition("key", "block").sortWithinPartitions("key", "block").select("key", "block", "node", "sig").mapInArrow(link, "a long, b long").where("a != b").distinct()


def similar_across_blocks(rows: DataFrame, least: float) -> DataFrame:
    """Edges ``(a, b)`` between what the blocks of divided buckets left apart. Rows: ``key``, ``node``, ``label`` (what is tied
    already has one), ``sig``. Nodes outside a bucket's largest label are compared with the whole bucket, a slice of them
    with a slice of it in each task."""
    top = rows.groupBy("key", "label").count().groupBy("key").agg(F.max(F.struct("count", "label")).alias("x"), F.sum("count").alias("m"))
    top = top.select("key", F.col("x.label").alias("top"), F.ceil(F.col("m") / BUCKET_ROWS).cast("int").alias("blocks"), F.ceil((F.col("m") - F.col("x.count")) / BUCKET_ROWS).cast("int").alias("ask_blocks"))
    marked = rows.join(top, "key").where("ask_blocks > 0")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, ["key", "ask_block", "block"]):
            order = np.argsort(~run.column("asks").to_numpy(), kind="stable")
            run = run.take(pa.array(order))
            node, asking = run.column("node").to_numpy(), int(run.column("asks").to_numpy().sum())
            sig = _bytes_matrix(run.column("sig"), MINIMA * BITS // 8)
            _, label = np.unique(run.column("label").to_numpy(), return_inverse=True)
            forest, a_out, b_out = Forest(int(label.max()) + 1), [], []
            for i in range(asking):
                near = asking + np.flatnonzero(estimate(sig[i], sig[asking:]) >= least)
                # One link to each label is enough.
                for at in near[np.unique(label[near], return_index=True)[1]].tolist():
                    if forest.join(int(label[i]), int(label[at])):
                        a_out.append(node[i])
                        b_out.append(node[at])
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    return _dealt(marked.withColumn("asks", F.col("label") != F.col("top")), ["key"], ["node", "label", "sig"]).mapInArrow(link, "a long, b long")


def _dealt(marked: DataFrame, group: list[str], cols: list[str]) -> DataFrame:
    """For each slice of a group's asking rows and each slice of the group its rows together, those of the first with ``asks``."""
    deal = lambda blocks: F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    asking = marked.where("asks").withColumn("ask_block", deal("ask_blocks")).withColumn("block", each("blocks"))
    asked = marked.withColumn("asks", F.lit(False)).withColumn("block", deal("blocks")).withColumn("ask_block", each("ask_blocks"))
    keys = [*group, "ask_block", "block"]
    return asking.unionByName(asked).select(*keys, *cols, "asks").repartition(*keys).sortWithinPartitions(*keys)


def exact_links(members: DataFrame, percent: int, least: float) -> DataFrame:
    """Edges that tie the exact clusters of each ``(group, ask_block, block)``; rows with ``asks`` are compared with all others,
    others only with rows that ask. ``cluster`` says what is tied already. Other columns: node, n, sig, items. Rows with equal
    keys come together.
    """

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, ["group", "ask_block", "block"]):
            asks = run.column("asks").to_numpy()
            order = np.argsort(~asks, kind="stable")
            run = run.take(pa.array(order))
            node, size = run.column("node").to_numpy(), run.column("n").to_numpy()
            sig = _bytes_matrix(run.column("sig"), MINIMA * BITS // 8)
            items = np.frombuffer(b"".join(run.column("items").to_pylist()), np.uint64)
            values, code = np.unique(items, return_inverse=True)
            ends = np.cumsum(size)
            begins = ends - size
            present = np.zeros(len(values), bool)
            _, cluster = np.unique(run.column("cluster").to_numpy(), return_inverse=True)
            up = np.arange(cluster.max() + 1)  # every cluster's root
            a_out, b_out = [], []
            for i in range(int(asks.sum())):
                mine = up[cluster[i]]
                near = (up[cluster] != mine) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i]))
                found = np.flatnonzero(near)
                found = found[estimate(sig[i], sig[found]) >= least]
                if not len(found):
                    continue
                present[code[begins[i] : ends[i]]] = True
                for j in found:
                    if up[cluster[j]] == up[cluster[i]]:
                        continue
                    both = int(present[code[begins[j] : ends[j]]].sum())
                    if 100 * both >= percent * (size[i] + size[j] - both):
                        a_out.append(node[i])
                        b_out.append(node[j])
                        x, y = up[cluster[i]], up[cluster[j]]
                        up[up == max(x, y)] = min(x, y)
                present[code[begins[i] : ends[i]]] = False
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    return members.mapInArrow(link, "a long, b long")


def _blocks(rows: int | str, shingles: str):
    """How many blocks hold so many documents and shingles."""
    return F.greatest(F.ceil(F.col(rows) / BLOCK_NODES), F.ceil(F.col(shingles) / BLOCK_SHINGLES)).cast("int")


def _ask(members: DataFrame, percent: int, least: float) -> DataFrame:
    """``exact_links`` of the members with ``asks`` and all others of their group, slice by slice."""
    own = members.groupBy("group").agg(F.count("*").alias("rows"), F.sum("n").alias("size"), F.count_if("asks").alias("ask_rows"), F.sum(F.when(F.col("asks"), F.col("n"))).alias("ask_size"))
    own = own.where("ask_rows > 0").select("group", _blocks("rows", "size").alias("blocks"), _blocks("ask_rows", "ask_size").alias("ask_blocks"))
    marked = members.drop("blocks").join(own, "group")
    return exact_links(_dealt(marked, ["group"], ["node", "cluster", "n", "sig", "items"]), percent, least)


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", slack: float = SLACK) -> DataFrame:
    """Groups of documents linked by shingle sets with ``100 * intersection >= percent * union``.

    Columns: the id (an integer), ``n_shingles`` long (distinct runs of ``n`` words; the whole sequence if shorter),
    ``component_id`` (smallest id reachable by links, itself included), ``kept`` boolean (id equals ``component_id``).

    Empty sets (null text, no words) link with nothing. Rows with a null id link with nothing: ``component_id`` is null and
    they are kept. Rows that repeat an id are one vertex, and all kept or all dropped. Other columns are not read; an empty
    table gives no rows.

    1. One pass makes signatures. Documents with equal sets are one node from here on (a partial minimum by digest).
    2. Bands shared by two or more nodes are buckets; in blocks of bounded size, signatures' bit counts estimate similarity,
       and what is alike, with slack, forms candidate groups (connected components). Where a bucket has several blocks, what
       is outside its largest group then is compared with the whole bucket.
    3. Only nodes in candidate groups are read again. Inside blocks of a group, pairs that no link ties yet are compared on
       full sets. Where a group has several blocks, the largest clusters of the blocks are tied through speakers, and then
       every node outside the group's largest cluster is compared with all blocks: no link between clusters is lost.
    4. Components of the confirmed links give the result.

    Every task holds one slice of those that ask and one of those asked, however large a bucket or group is. Pairs whose
    estimate is ``slack`` below the threshold are taken as not linked; with a slack of 1 all candidates are compared on full sets.
    """
    least = percent / 100 - slack
    signed = materialise(signatures(docs, n, id_col, text_col))
    nodes = materialise(
        signed.where(F.col("digest").isNotNull() & F.col(id_col).isNotNull())
        .groupBy("digest")
        .agg(F.min(F.struct(F.col(id_col).cast("long").alias("node"), "n_shingles", "keys", "sig")).alias("x"))
        .select("digest", "x.node", F.col("x.n_shingles").alias("n"), "x.keys", "x.sig")
    )
    # Sets of different documents with one id share a node number; one of them stands for the vertex in a bucket's rows.
    rows = nodes.select("node", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    hashed = lambda *x: F.pmod(F.xxhash64(*x), F.lit(1 << 30))
    many = rows.join(shared, "key").withColumn("blocks", F.ceil(F.col("m") / BUCKET_ROWS).cast("int"))
    many = many.withColumn("speaks", (F.col("blocks") > 1) & (hashed(F.lit("s"), "node") * F.col("m") < (1 << 30) * 2 * SPEAKERS))
    own = F.array(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    many = many.withColumn("block", F.explode(F.when(F.col("speaks"), every).otherwise(own)))
    buckets = many.join(nodes.select("node", "sig"), "node")
    alike = materialise(similar_in_buckets(buckets, least))
    groups = materialise(components(alike))
    wide = many.where("blocks > 1").select("key", "node").distinct()
    if not wide.isEmpty():
        labelled = wide.join(groups, "node", "left").join(nodes.groupBy("node").agg(F.first("sig").alias("sig")), "node")
        more = materialise(similar_across_blocks(labelled.select("key", "node", F.coalesce("component", "node").alias("label"), "sig"), least))
        if not more.isEmpty():
            groups = materialise(components(alike.union(more)))
    groups = groups.withColumnRenamed("component", "group")

    # Full sets of the candidates' rows alone.
    heads = nodes.join(groups, "node")
    sizes = heads.groupBy("group").agg(F.count("*").alias("rows"), F.sum("n").alias("size")).select("group", _blocks("rows", "size").alias("blocks"))
    few = groups.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    wanted = heads.join(sizes, "group").select("node", "digest", "group", "blocks", "sig")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    texts = texts.join(F.broadcast(groups.select(F.col("node").alias("id")).distinct()) if few else groups.select(F.col("node").alias("id")).distinct(), "id", "left_semi")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            raw = [s.tobytes() for s in _sets(batch, 1, n)]
            digest = [hashlib.blake2b(x, digest_size=16).digest() for x in raw]
            size = [len(x) // 8 for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest, pa.binary()), pa.array(size, pa.int64()), pa.array(raw, pa.binary())], names=["id", "set", "n", "items"])

    sets = texts.select("id", "text").mapInArrow(full, "id long, set binary, n long, items binary")
    members = materialise(
        sets.join(wanted, (F.col("id") == F.col("node")) & (F.col("set") == F.col("digest")))
        .dropDuplicates(["digest"])
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .select("group", "blocks", "block", "node", F.col("node").alias("cluster"), "n", "sig", "items")
    )
    inside = members.withColumns({"asks": F.lit(True), "ask_block": F.lit(0)}).repartition("group", "block").sortWithinPartitions("group", "block")
    links = materialise(exact_links(inside, percent, least))
    links = _across_blocks(members, links, percent, least)
    labels = components(links)

    # Digest to component: a node without links is its own.
    of_set = nodes.select("digest", "node").join(labels, "node", "left").select(F.col("digest").alias("__set"), F.coalesce("component", "node").alias("__low"))
    kind = docs.schema[id_col].dataType.simpleString()
    return signed.select(id_col, "n_shingles", "digest").join(of_set, F.col("digest") == F.col("__set"), "left").select(
        id_col, "n_shingles",
        F.when(F.col(id_col).isNotNull(), F.coalesce(F.col("__low").cast(kind), F.col(id_col))).alias("component_id"),
    ).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def _across_blocks(members: DataFrame, links: DataFrame, percent: int, least: float) -> DataFrame:
    """``links`` with those between different blocks of groups that have several."""
    wide = members.where("blocks > 1")
    if wide.isEmpty():
        return links
    order = F.xxhash64("node")

    def clustered(links: DataFrame) -> DataFrame:
        labels = components(links)
        return wide.drop("cluster").join(labels, "node", "left").withColumn("cluster", F.coalesce("component", "node")).drop("component")

    # The largest clusters of the blocks meet through their speakers.
    now = clustered(links)
    largest = now.groupBy("group", "block", "cluster").count().groupBy("group", "block").agg(F.max(F.struct("count", "cluster")).alias("x"))
    heads = now.join(largest.select("group", "block", F.col("x.cluster").alias("cluster"), F.col("x.count").alias("count")), ["group", "block", "cluster"])
    share = F.pmod(order, F.lit(1 << 30)) * F.col("count") < (1 << 30) * SPEAKERS
    speakers = heads.where(share).withColumn("asks", F.lit(True)).drop("count")
    links = materialise(links.union(_ask(speakers, percent, least)))

    # Whatever is outside the group's largest cluster asks every block.
    now = materialise(clustered(links))
    largest = now.groupBy("group", "cluster").count().groupBy("group").agg(F.max(F.struct("count", "cluster")).alias("x")).select("group", F.col("x.cluster").alias("top"))
    marked = now.join(largest, "group").withColumn("asks", F.col("cluster") != F.col("top")).drop("top")
    return materialise(links.union(_ask(marked, percent, least)))


def drop_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", slack: float = SLACK) -> DataFrame:
    """One document of each group, the one with the smallest id; columns as before, which stay as they are.

    Rows with a null id, or without words, all stay. Of rows with equal id and text one stays. Rows that share an id but
    differ in text are documents of their own; in a group they come before those whose ids are unlike. An empty table gives
    no rows.
    """
    key = F.xxhash64(text_col)
    of, unlike, vertex = (free(name, docs.columns) for name in ("__of", "__unlike", "__vertex"))
    several = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(of)).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).where("n > 1")
    several = materialise(several.select(of, (~F.col("low").eqNullSafe(F.col("high"))).alias(unlike)))
    if several.isEmpty():
        gone = near_duplicates(docs.select(id_col, text_col), n, percent, id_col, text_col, slack).where("not kept").select(id_col)
        return with_ids(docs, gone, False, id_col)
    single = with_ids(docs, several.select(of), False, id_col).withColumn(vertex, F.col(id_col).cast("long"))
    again = with_ids(docs, several.select(of), True, id_col).dropDuplicates([id_col, text_col])
    again = again.join(several, again[id_col] == several[of]).withColumn(vertex, F.when(F.col(unlike), F.lit(-(1 << 63)) + F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 62))).otherwise(F.col(id_col)).cast("long"))
    told = materialise(single.unionByName(again.drop(of, unlike)))
    gone = near_duplicates(told.select(vertex, text_col), n, percent, vertex, text_col, slack).where("not kept").select(vertex)
    return with_ids(told, gone, False, vertex).drop(vertex)
