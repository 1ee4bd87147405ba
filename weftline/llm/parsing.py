"""Repeated byte strings by prefix-free parsing (operator 13).

A rolling hash runs over every text. Of each string of ``length`` bytes the ``GRAM`` bytes with the least hash are its trigger,
and adjacent strings with one trigger make a phrase. So phrases depend on what stands near them alone, however texts are cut,
none is longer than ``2 * length`` bytes, and every string stands in one phrase: neighbours share ``length - 1`` bytes, where
the usual parse shares a trigger, and strings need no look at the phrase that follows.

The parse is the list of phrases by document and place; the dictionary holds each phrase once. What the parse repeats is
repeated as a whole. Strings that different phrases share have the same trigger; so the phrases of the dictionary that share
one are gathered, suffix arrays over them (by prefix doubling on bytes) bring equal strings together, and the order of the
parse says which of them comes first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free, in_small_batches, materialise, mix64, slices, utf8

#: Bytes of a repeated string, and of a trigger. Longer triggers stand in fewer places by chance but make shorter phrases.
LENGTH, GRAM = 100, 32
#: Positions among the bytes that are hashed at once have so many bits.
PLACE_BITS = 20


class Limits(NamedTuple):
    """What a task holds at once; results don't depend on it."""

    #: Bytes that are hashed at once, at most half of what ``PLACE_BITS`` can number.
    piece: int = 400_000
    #: Phrases a task looks through for repeats before it sends what is left.
    held: int = 1_000_000
    #: Bytes of phrases that are sorted at once.
    sorted_bytes: int = 1_500_000
    #: Triggers with more different phrases send the digests of their strings instead, each once for a slice of texts.
    sorted_phrases: int = 4_096
    #: So do triggers with at least ``crowd`` different phrases among the ones a task holds, and 1 in ``crowd_share`` of them;
    #: the ``crowds`` most frequent of these are known to all tasks.
    crowd: int = 16
    crowd_share: int = 4_096
    crowds: int = 10_000


_BASE = 0x9E3779B97F4A7C15


def rolling_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` bytes: polynomials modulo 2^64, put together from runs of 1, 2, 4, ... bytes, and mixed."""
    power = lambda k: np.uint64(pow(_BASE, k, 1 << 64))
    runs, out, n, k = data.astype(np.uint64) + np.uint64(1), None, 0, 1
    while k <= size:
        if size & k:
            out = runs if out is None else out[: max(0, len(runs) - n)] * power(k) + runs[n:]
            n += k
        runs = runs[:-k] * power(k) + runs[k:] if len(runs) > k else runs[:0]
        k *= 2
    return mix64(out[: max(0, len(data) - size + 1)])


def sliding_least(x: np.ndarray, size: int) -> np.ndarray:
    """The least of each run of ``size`` numbers."""
    k = 1
    while 2 * k <= size:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (size - k)], x[size - k :]) if size > k else x


def parse(texts: list[bytes | None], length: int = LENGTH, gram: int = GRAM, piece: int = Limits().piece) -> Iterator[tuple[np.ndarray, ...]]:
    """Phrases of the texts, a piece at a time: number of the text, first start, number of starts, trigger and digest.

    A phrase with n starts has the ``n + length - 1`` bytes from its first. Equal strings of ``length`` bytes have equal triggers.
    """
    gram = min(gram, length)
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for i, text in enumerate(texts):
        # Long texts come in parts that share length - 1 bytes.
        for at in range(0, max(0, len(text or b"") - length + 1), piece):
            part = text[at : at + piece + length - 1]
            if size + len(part) > piece and held:
                yield _parsed(held, length, gram)
                held, size = [], 0
            held.append((i, at, part))
            size += len(part)
    if held:
        yield _parsed(held, length, gram)


def _parsed(held: list[tuple[int, int, bytes]], length: int, gram: int) -> tuple[np.ndarray, ...]:
    data = b"".join(part for _, _, part in held)
    sizes = np.array([len(part) for _, _, part in held])
    base = np.cumsum(sizes) - sizes
    hashes = rolling_hashes(np.frombuffer(data, np.uint8), gram)
    low = np.uint64((1 << PLACE_BITS) - 1)
    place = np.arange(len(hashes), dtype=np.uint64)
    trigger = (sliding_least(hashes & ~low | place, length - gram + 1) & low).astype(np.int64)
    # Starts of whole strings in each part; where the trigger or the part changes a phrase begins.
    starts = sizes - length + 1
    owner = np.repeat(np.arange(len(held)), starts)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(starts) - starts, starts)
    where = base[owner] + at
    trigger = trigger[where]
    first = np.flatnonzero(np.append(True, (trigger[1:] != trigger[:-1]) | (owner[1:] != owner[:-1])))
    n = np.diff(np.append(first, len(owner)))
    begin = where[first]
    view = memoryview(data)
    digest = np.array([xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(begin.tolist(), (begin + n + length - 1).tolist())], np.uint64)
    row, offset = np.array([i for i, _, _ in held]), np.array([a for _, a, _ in held])
    return row[owner[first]], offset[owner[first]] + at[first], n, hashes[trigger[first]].view(np.int64), digest.view(np.int64)


def _ranked(docs: list[tuple]) -> np.ndarray:
    """A number for each ``(id, row_key)``, in their order; equal ones share it. Null ids come first."""
    order = {doc: i for i, doc in enumerate(sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0 if not isinstance(d[0], str) else d[0], d[1])))}
    return np.array([order[d] for d in docs], np.int64)


def phrases(docs: DataFrame, length: int, gram: int, limits: Limits, id_col: str, text_col: str) -> DataFrame:
    """The parse: ``id``, ``row_key`` (64 bits of the text), ``at``, ``n`` (first start, number of starts), ``trigger``, ``digest``,
    and ``crowd`` (how many different phrases of a frequent trigger the task holds, else null).

    A task looks for repeated phrases itself: ``trigger`` and ``digest`` are null where the same phrase stands earlier.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, row_key long, at int, n int, trigger long, digest long, crowd int"

    def out(ids: list, keys: list, row: np.ndarray, at: np.ndarray, n: np.ndarray, trigger: np.ndarray, digest: np.ndarray, id_type: pa.DataType) -> pa.RecordBatch:
        rank = _ranked(list(zip(ids, keys)))[row]
        order = np.lexsort((at, rank, digest, trigger))
        t, d, r, a = trigger[order], digest[order], rank[order], at[order]
        new = np.append(True, (t[1:] != t[:-1]) | (d[1:] != d[:-1]))
        again = ~new & np.append(True, (r[1:] != r[:-1]) | (a[1:] != a[:-1]))  # not the same place of a repeated row
        kept = order[new | again]
        is_new = new[new | again]
        edge = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        differ = np.repeat(np.add.reduceat(new, edge), np.diff(np.append(edge, len(t))))[new | again]
        crowd = np.where(is_new & (differ >= max(limits.crowd, len(t) // limits.crowd_share)), differ, 0)
        back = np.argsort(kept, kind="stable")  # by document again
        kept, is_new, crowd = kept[back], is_new[back], crowd[back]
        of = row[kept]
        arrays = [
            pa.array(ids, id_type).take(pa.array(of)), pa.array(keys, pa.int64()).take(pa.array(of)), pa.array(at[kept], pa.int32()), pa.array(n[kept], pa.int32()),
            pa.array(trigger[kept], mask=~is_new), pa.array(digest[kept], mask=~is_new), pa.array(crowd.astype(np.int32), mask=crowd == 0),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=["id", "row_key", "at", "n", "trigger", "digest", "crowd"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys, parts, count, id_type = [], [], [], 0, None
        for batch in batches:
            id_type = batch.column(0).type
            for part in slices(iter([batch]), 1):
                before = len(ids)
                ids += part.column(0).to_pylist()
                keys += part.column(2).to_pylist()
                for row, *rest in parse(utf8(part.column(1)), length, gram, limits.piece):
                    parts.append((row + before, *rest))
                    count += len(row)
                if count >= limits.held:
                    yield out(ids, keys, *map(np.concatenate, zip(*parts)), id_type)
                    ids, keys, parts, count = [], [], [], 0
        if parts:
            yield out(ids, keys, *map(np.concatenate, zip(*parts)), id_type)

    return in_small_batches(docs).select(id_col, text_col, F.xxhash64(text_col)).mapInArrow(cut, schema)


def suffix_ranks(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each start the rank of its ``length`` bytes among all of them, equal ones sharing it: a suffix array's order, cut
    at ``length``, by prefix doubling. ``data`` goes on for ``length`` bytes from each start."""

    def rank(x: np.ndarray) -> np.ndarray:
        return np.unique(x, return_inverse=True)[1].astype(np.uint64)

    def both(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return rank(x << np.uint64(32) | y)

    known, size = data.astype(np.uint64), 1
    while 2 * size <= min(length, 32):
        x, y = known[:-size], known[size:]
        known = x << np.uint64(8 * size) | y if size < 4 else both(x, y) if size > 4 else rank(x << np.uint64(32) | y)
        size *= 2
    places = [starts + at for at in [*range(0, length - size, size), length - size]]
    level = [known[p] for p in places]
    while len(level) > 1:
        level = [both(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return rank(level[0])


def repeats_of_dictionary(entries: DataFrame, length: int, limits: Limits) -> DataFrame:
    """``id, row_key, a, b``: starts from ``a`` up to ``b`` in phrases of the dictionary whose strings come earlier too.

    Rows: ``trigger, id, row_key, at, n, bytes``. Phrases with one trigger come to one task; groups are sorted
    together up to ``sorted_bytes``.
    """
    kind = entries.schema["id"].dataType.simpleString()

    def sort(rows: list[tuple[list, ...]], id_type: pa.DataType) -> pa.RecordBatch:
        ids, keys, at, n, texts = ([x for part in column for x in part] for column in zip(*rows))
        at, n = np.array(at, np.int64), np.array(n, np.int64)
        base = np.cumsum(n + length - 1) - (n + length - 1)
        of = np.repeat(np.arange(len(n)), n)
        within = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        ranks = suffix_ranks(np.frombuffer(b"".join(texts), np.uint8), base[of] + within, length)
        doc, place = _ranked(list(zip(ids, keys)))[of], at[of] + within
        order = np.lexsort((place, doc, ranks))
        r, d, p = ranks[order], doc[order], place[order]
        edge = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        first = np.repeat(edge, np.diff(np.append(edge, len(r))))
        later = np.zeros(len(of), bool)
        later[order] = (d != d[first]) | (p != p[first])
        begin = np.flatnonzero(later & ~np.append(False, later[:-1] & (of[1:] == of[:-1])))
        end = np.flatnonzero(later & ~np.append(later[1:] & (of[1:] == of[:-1]), False))
        arrays = [pa.array(ids, id_type).take(pa.array(of[begin])), pa.array(keys, pa.int64()).take(pa.array(of[begin])), pa.array(place[begin], pa.int32()), pa.array(place[end] + 1, pa.int32())]
        return pa.RecordBatch.from_arrays(arrays, names=["id", "row_key", "a", "b"])

    def sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list, ...]] = []
        size, last, id_type = 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            id_type = batch.column(1).type
            trigger = batch.column(0).to_numpy()
            length_of = np.cumsum(batch.column(4).to_numpy() + length - 1)
            cuts = [0, *(np.flatnonzero(trigger[1:] != trigger[:-1]) + 1).tolist(), len(trigger)]
            at = 0
            for low, high in zip(cuts, cuts[1:]):
                # A group that would exceed the size begins the next lot; one that goes on from the last batch stays.
                waiting = size + (length_of[low - 1] if low else 0) - (length_of[at - 1] if at else 0)
                if waiting >= limits.sorted_bytes and not (low == 0 and trigger[0] == last):
                    if low > at:
                        held.append(tuple(batch.column(c).slice(at, low - at).to_pylist() for c in range(1, 6)))
                    yield sort(held, id_type)
                    held, size, at = [], 0, low
            held.append(tuple(batch.column(c).slice(at).to_pylist() for c in range(1, 6)))
            size += int(length_of[-1] - (length_of[at - 1] if at else 0))
            last = trigger[-1]
        if held:
            yield sort(held, id_type)

    rows = entries.select("trigger", "id", "row_key", "at", "n", "bytes").repartition("trigger").sortWithinPartitions("trigger")
    return rows.mapInArrow(sorted_groups, f"id {kind}, row_key long, a int, b int")


def repeated_starts(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, row_key, a, b``: starts from ``a`` up to ``b`` (bytes) whose ``length`` bytes also start earlier."""
    key = F.xxhash64(text_col)
    if not docs.groupBy(id_col, key).count().where("count > 1").isEmpty():  # equal rows are one document
        docs = materialise(docs.select(id_col, text_col).withColumn("__key", key).dropDuplicates([id_col, "__key"]).drop("__key"))
    place = ["id", "row_key", "at"]
    parsed = materialise(phrases(docs, length, gram, limits, id_col, text_col))
    span = [F.col("id"), F.col("row_key"), F.col("at").alias("a"), (F.col("at") + F.col("n")).alias("b")]
    found = [parsed.where("trigger is null").select(span)]

    crowds = parsed.where("crowd is not null").groupBy("trigger").agg(F.sum("crowd").alias("crowd")).orderBy(F.desc("crowd")).limit(limits.crowds)
    crowds = materialise(crowds.select(F.col("trigger").alias("__trigger")))
    marked = parsed.where("trigger is not null").drop("crowd").join(F.broadcast(crowds), F.col("trigger") == F.col("__trigger"), "left")
    # The dictionary, by trigger: the first of each phrase stays, and how many phrases the trigger has says what they need.
    same, of = W.partitionBy("trigger", "digest").orderBy(*place), W.partitionBy("trigger")
    told = marked.where("__trigger is null").repartition("trigger").withColumn("nth", F.rank().over(same)).withColumn("differ", F.count_if(F.col("nth") == 1).over(of))
    told = materialise(told.where("nth > 1 or differ > 1").select(*place, "n", "trigger", "nth", (F.col("differ") > limits.sorted_phrases).alias("crowded")))
    found.append(told.where("nth > 1").select(span))
    wanted = told.where("nth = 1").select(*place, "n", "trigger", "crowded")
    if not crowds.isEmpty():
        wanted = wanted.unionByName(marked.where("__trigger is not null").select(*place, "n", "trigger", F.lit(True).alias("crowded")))

    by_doc = wanted.groupBy(F.col("id").alias("__id"), "row_key").agg(F.collect_list(F.struct("at", "n", "trigger", "crowded")).alias("wanted"))
    texts = docs.select(F.col(id_col).alias("id"), key.alias("__key"), F.col(text_col).alias("text"))
    met = by_doc.join(texts, F.col("__id").eqNullSafe(F.col("id")) & (F.col("row_key") == F.col("__key"))).select("id", "row_key", "text", "wanted")
    kind = docs.schema[id_col].dataType.simpleString()

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bytes of phrases with their trigger; for those of crowded triggers, digests of strings, each in its first place of
        the slice alone, and without bytes the spans of starts that repeat those."""
        names = ["trigger", "id", "row_key", "at", "n", "bytes"]
        for batch in slices(batches, 2):
            row, at, n, trigger, content = [], [], [], [], []

            def add(*values) -> None:
                for column, value in zip((row, at, n, trigger, content), values):
                    column.append(value)

            strings = []
            order = _ranked(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))) if batch.num_rows else []
            for i, (text, asked) in enumerate(zip(utf8(batch.column(2)), batch.column(3).to_pylist())):
                for x in asked:
                    if x["crowded"]:
                        strings += [(order[i], start, i, hashlib.blake2b(text[start : start + length], digest_size=16).digest()) for start in range(x["at"], x["at"] + x["n"])]
                    else:
                        add(i, x["at"], x["n"], x["trigger"], text[x["at"] : x["at"] + x["n"] + length - 1])
            seen: set[bytes] = set()
            span = None  # row, first start and number of starts of what repeats
            for _, start, i, digest in sorted(strings):
                if digest not in seen:
                    seen.add(digest)
                    add(i, start, 1, None, digest)
                elif span and span[0] == i and span[1] + span[2] == start:
                    span[2] += 1
                else:
                    if span:
                        add(*span, None, None)
                    span = [i, start, 1]
            if span:
                add(*span, None, None)
            of = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(trigger, pa.int64()), batch.column(0).take(of), batch.column(1).take(of), pa.array(at, pa.int32()), pa.array(n, pa.int32()), pa.array(content, pa.binary())], names=names)

    fetched = met.mapInArrow(fetch, f"trigger long, id {kind}, row_key long, at int, n int, bytes binary")
    if wanted.where("crowded").isEmpty():
        found.append(repeats_of_dictionary(fetched, length, limits))
    else:
        fetched = materialise(fetched)
        found.append(repeats_of_dictionary(fetched.where("trigger is not null"), length, limits))
        found.append(fetched.where("bytes is null").select(span))
        strings = fetched.where("trigger is null and bytes is not null")
        # A string is one row for each slice of texts that holds it, however often it stands there.
        nth = F.rank().over(W.partitionBy("bytes").orderBy(*place))
        found.append(strings.withColumn("nth", nth).where("nth > 1").select(span))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents with ``n_bytes`` long, ``spans`` (array of ``start``, ``end`` in bytes, maximal and in order) and ``kept``
    binary (the other bytes, which may end inside a character): a byte is in a span if a string of ``length`` bytes covers it
    that also starts earlier, in a document with a smaller id or earlier in the same one.

    Strings don't cross documents; those that overlap count; all is judged on the texts as they come. Texts are UTF-8, null ones
    empty, and those shorter than ``length`` lose nothing. Null ids come first. Rows that share an id, or have none, rank by a
    hash of their text; equal rows are one document. Other columns stay as they are (``n_bytes``, ``spans`` and ``kept`` are
    replaced); an empty table gives no rows.

    Texts are shuffled twice by document, to meet the phrases that are asked for and what they lose; a document's own phrases
    are the largest group. Phrases are shuffled once, by trigger, after each task has taken out its own repeats. Equality is
    that of the bytes; for whole phrases, of 64 bits of hash beside the trigger's 64; for strings of triggers with more than
    ``sorted_phrases`` phrases, of 128 bits of digest.
    """
    docs = docs.drop("n_bytes", "spans", "kept")
    names = docs.columns
    at = names.index(text_col)
    starts = repeated_starts(docs, length, gram, limits, id_col, text_col)
    lists = starts.groupBy(F.col("id").alias("__of"), F.col("row_key").alias("__row_key")).agg(F.collect_list(F.struct("a", "b")).alias("__spans"))
    met = docs.join(lists, docs[id_col].eqNullSafe(lists["__of"]) & (F.xxhash64(docs[text_col]) == lists["__row_key"]), "left").select(*[docs[c] for c in names], lists["__spans"].alias(free("__spans", names)))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields], "n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in slices(batches, at):
            size, spans, kept = [], [], []
            lists = batch.column(len(names))
            for text, starts in zip(utf8(batch.column(at)), (x.values if x.is_valid else None for x in lists)):
                text = text or b""
                size.append(len(text))
                if starts is None:
                    spans.append([])
                    kept.append(text)
                    continue
                a = starts.field(0).to_numpy().astype(np.int64)
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.maximum.accumulate(starts.field(1).to_numpy()[order].astype(np.int64) + length - 1)
                new = np.append(True, a[1:] > b[:-1])
                low, high = a[new], b[np.append(new[1:], True)]
                spans.append([{"start": x, "end": y} for x, y in zip(low.tolist(), high.tolist())])
                kept.append(b"".join(text[x:y] for x, y in zip([0, *high.tolist()], [*low.tolist(), len(text)])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(size, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=[*names, "n_bytes", "spans", "kept"])

    return in_small_batches(met).mapInArrow(cut, schema)
