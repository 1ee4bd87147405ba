"""Substring dedup by hashing lines, and sentences inside them (operator 10).

Two kinds of units are hashed, and the digests of each kind are grouped over all documents; the earliest unit of a digest
stays. A whole line that repeats an earlier one goes if it has ``LINE_WORDS`` words, or if it is so common that chance can't
explain it. Passages also begin and end inside lines, so lines are cut at ``.``, ``!`` and ``?`` too: sentences that repeat
earlier ones go where they stand side by side and hold ``MIN_RUN_WORDS`` words together, since single short ones repeat by
chance. With ``min_words=1`` nothing that repeats is left.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, in_small_batches, join_spread, materialise, slices, utf8, words

#: Adjacent repeated units go if they hold so many words together. A passage of 50 words that begins and ends inside a
#: sentence holds about as many in its whole sentences.
MIN_RUN_WORDS = 30
#: A repeated whole line goes if it has so many words, or if it stands in the tables at least ``COMMON`` times and once for
#: every ``1 / COMMON_SHARE`` documents.
LINE_WORDS, COMMON, COMMON_SHARE = 10, 20, 0.05
_PIECE = re.compile(rb"\n|[^.!?\n]+[.!?]*|[.!?]+")


def pieces_of(text: bytes | None) -> list[bytes]:
    """The text in pieces that make it up: line ends, and sentences or parts of them with their end marks."""
    return _PIECE.findall(text) if text else []


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sentences, and whole lines, with words: the id, ``row_key``, 64 bits of the whole text, which tells apart the rows of one
    id, ``unit`` int (the sentence's number in its text from 0, or the line's first one), ``span`` int (0, or the line's number
    of sentences), ``n_words`` int, and ``digest``, 128 bits of the lower-cased words joined by single spaces; lines and
    sentences don't share digests."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row, unit, span, n, digest = [], [], [], [], []

            def add(i: int, at: int, sentences: int, w: list[bytes]) -> None:
                row.append(i)
                unit.append(at)
                span.append(sentences)
                n.append(len(w))
                digest.append(hashlib.blake2b(b" ".join(w), digest_size=16, person=b"line" if sentences else b"").digest())

            for i, text in enumerate(utf8(batch.column(1))):
                k, line, first = 0, [], 0
                for piece in [*pieces_of(text), b"\n"]:
                    if w := words(piece):
                        add(i, k, 0, w)
                        line += w
                        k += 1
                    elif piece == b"\n":
                        if line:
                            add(i, first, k - first, line)
                        line, first = [], k
            rows = pa.array(row, pa.int64())
            arrays = [batch.column(0).take(rows), batch.column(2).take(rows), *(pa.array(x, pa.int32()) for x in (unit, span, n)), pa.array(digest, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "row_key", "unit", "span", "n_words", "digest"])

    kind = docs.schema[id_col].dataType.simpleString()
    keyed = in_small_batches(docs).select(id_col, text_col, F.xxhash64(text_col))
    return keyed.mapInArrow(cut, f"`{id_col}` {kind}, row_key long, unit int, span int, n_words int, digest binary")


def later_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every unit but the earliest of its digest: the id, ``row_key``, ``unit``, ``span``, ``n_words``, the earliest one's
    ``first_doc_id`` and ``first_unit``, and ``n``, how often the digest stands there. Units rank by id, text and place.

    Digests are grouped with partial minima. The join by digest deals each frequent digest to many tasks.
    """
    every = units(docs, id_col, text_col)
    place = F.struct(F.col(id_col).alias("d"), F.col("row_key").alias("r"), F.col("unit").alias("u"))
    firsts = materialise(every.groupBy(F.col("digest").alias("__digest")).agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"))
    total = firsts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    met = join_spread(every, "digest", firsts, "__digest", "n", total, [id_col, "row_key", "unit"])
    same = F.col(id_col).eqNullSafe(F.col("first.d")) & (F.col("row_key") == F.col("first.r")) & (F.col("unit") == F.col("first.u"))
    return met.where(~same).select(id_col, "row_key", "unit", "span", "n_words", "n", F.col("first.d").alias("first_doc_id"), F.col("first.u").alias("first_unit"))


def without_runs(text: bytes, later: dict[int, int], min_words: int, lines: set[int] | frozenset = frozenset()) -> tuple[bytes, list[tuple[int, int, int]]]:
    """The text without the units ``lines`` and its runs of later units (their numbers, each with its number of words) that
    hold ``min_words`` words, and the units taken out: number, start and end in characters.

    What stands without words between two units that go goes with them. What follows them goes if they begin a line.
    """
    going, run = set(lines), []
    for u in [*sorted(later), -1]:
        if run and u != run[-1] + 1:
            if sum(later[x] for x in run) >= min_words:
                going.update(run)
            run = []
        run.append(u)
    if not going:
        return text, []
    kept, spans = [], []
    at, unit, line_start, before, gone = 0, -1, False, b"\n", False
    waiting: list[bytes] = []  # wordless pieces after a unit that goes: they go if the next unit goes too
    for piece in pieces_of(text):
        size = len(piece) if piece.isascii() else len(piece.decode())
        if words(piece):
            unit += 1
            goes = unit in going
            if goes and not gone:
                line_start = before == b"\n"
            if not goes and gone and not line_start:
                kept += waiting
            waiting, gone = [], goes
            if goes:
                spans.append((unit, at, at + size))
            else:
                kept.append(piece)
        elif gone:
            waiting.append(piece)
        else:
            kept.append(piece)
        at, before = at + size, piece
    if gone and not line_start:
        kept += waiting
    return b"".join(kept), spans


def dedup(docs: DataFrame, min_words: int = MIN_RUN_WORDS, id_col: str = "doc_id", text_col: str = "text", line_words: int = LINE_WORDS, common_share: float = COMMON_SHARE) -> DataFrame:
    """All documents, their texts without passages that repeat an earlier one, and ``removed``: what was taken out.

    ``removed`` is an array, in order, of ``start`` and ``end`` (characters of the original text), ``first_doc_id`` and
    ``first_unit`` (the kept occurrence: its document, and which of that document's sentences it is, from 0, or begins with).
    What goes: whole lines that repeat an earlier whole line and have ``line_words`` words, or stand in the table once for
    every ``1 / common_share`` documents (and ``COMMON`` times at least); and runs of adjacent sentences that each repeat an
    earlier one, with ``min_words`` words together. Lines and sentences are equal if their lower-cased words are, and rank by
    id, text and place. So each one's earliest occurrence stays.

    With ``min_words=1`` all repeats go. Otherwise lone repeated sentences stay, and short lines that aren't common.

    Null and empty texts lose nothing; a document that loses all its text stays with an empty one. Null ids rank first. Rows
    that share an id (or have none) but differ in text lose each their own; equal rows are one document. Other columns stay
    as they were (one named ``removed`` is replaced); an empty table gives no rows.

    Texts are shuffled once, by document, to meet what they lose. A document's own units are the largest group.
    """
    docs = docs.drop("removed")
    at, names = docs.columns.index(text_col), docs.columns
    common = max(COMMON, common_share * docs.count())
    units_later = later_units(docs, id_col, text_col).where((F.col("span") == 0) | (F.col("n_words") >= line_words) | (F.col("n") >= common))
    each = units_later.withColumn("line", F.col("span") > 0).withColumn("unit", F.explode(F.sequence("unit", F.col("unit") + F.greatest("span", F.lit(1)) - 1)))
    lost = F.collect_set(F.struct("unit", "line", "n_words", "first_doc_id", "first_unit")).alias("__later")
    later = each.groupBy(F.col(id_col).alias("__of"), F.col("row_key").alias("__row_key")).agg(lost)
    later = later.where(F.exists("__later", lambda x: x["line"]) | (F.aggregate("__later", F.lit(0), lambda s, x: s + x["n_words"]) >= min_words))
    met = docs.join(later, docs[id_col].eqNullSafe(later["__of"]) & (F.xxhash64(docs[text_col]) == later["__row_key"]), "left")
    kind = docs.schema[id_col].dataType.simpleString()
    removed = f"array<struct<start:bigint,end:bigint,first_doc_id:{kind},first_unit:int>>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            arrays, lists = batch.columns[:-1], batch.column(len(names))
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            hit = np.flatnonzero(pc.is_valid(lists).to_numpy(zero_copy_only=False)).tolist()
            if hit:
                texts = utf8(arrays[at])
                for i in hit:
                    found = lists[i].as_py()
                    of = {x["unit"]: x for x in sorted(found, key=lambda x: x["line"])}  # a line's place is told before a sentence's
                    texts[i], gone = without_runs(texts[i], {x["unit"]: x["n_words"] for x in found if not x["line"]}, min_words, {x["unit"] for x in found if x["line"]})
                    spans[i] = [{"start": a, "end": b, "first_doc_id": of[u]["first_doc_id"], "first_unit": of[u]["first_unit"]} for u, a, b in gone]
                arrays[at] = pa.array(texts, pa.binary() if pa.types.is_string(arrays[at].type) else pa.large_binary()).cast(arrays[at].type)
            element = lists.type.value_type
            of_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("first_doc_id", element.field("first_doc_id").type), ("first_unit", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(spans, of_type)], names=[*names, "removed"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields], f"removed {removed}"])
    return met.select(*[docs[c] for c in names], later["__later"].alias(free("__later", names))).mapInArrow(cut, schema)


def removed_text(column: str = "removed"):
    """``removed`` as text: ``start-end:document.sentence``, comma-joined."""
    one = lambda x: F.concat(x["start"], F.lit("-"), x["end"], F.lit(":"), F.coalesce(x["first_doc_id"].cast("string"), F.lit("")), F.lit("."), x["first_unit"])
    return F.array_join(F.transform(column, one), ",")


def drop_repeated(docs: DataFrame, min_words: int = MIN_RUN_WORDS, id_col: str = "doc_id", text_col: str = "text", line_words: int = LINE_WORDS, common_share: float = COMMON_SHARE) -> DataFrame:
    """``dedup`` with the columns of ``docs`` alone."""
    aside = [F.col(f"`{c}`").alias("__removed" if c == "removed" else c) for c in docs.columns]
    out = dedup(docs.select(*aside), min_words, id_col, text_col, line_words, common_share)
    return out.select(*[F.col("__removed").alias(c) if c == "removed" else F.col(f"`{c}`") for c in docs.columns])
