"""Spelling variants by edits that a Bloom filter lets through (operator 11).

Every word's edits of one code point are generated and looked up in Bloom filters of the vocabulary, one for each length, that
all tasks hold; what passes is shuffled to meet the vocabulary itself, which takes out the false positives. Deletions stand
for insertions too, read the other way round, and a replacement is generated from the smaller of the two characters alone.

Hashes of edits come from the word's own: a word's hash is the exclusive or of a number for each character and place, so a
replacement exchanges one number, and a deletion joins the hash of what stands before with that of what follows, one place
earlier.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, in_small_batches, materialise, mix64, slices, utf8

#: Letters of a word, A-Z being lower-cased before; shorter and rarer words are no words here.
RUN = re.compile("[a-zÀ-ÿ]+")
LETTERS, OCCURRENCES = 5, 3
#: One run in so many loses a character, as told by a checksum of document and run.
MISSPELT = 97
#: A form is at least so many times as frequent as the word.
FORM_SHARE = 2
#: A filter has blocks of 512 bits, in each of which a word sets ``PROBES`` bits; ``BLOCK_WORDS`` words a block. A shard is the
#: filter of the words of one length and one range of hashes, of at most ``SHARD_BLOCKS`` blocks or 2 MB; a pass over the words
#: broadcasts ``PASS_BLOCKS`` blocks or 64 MB of shards at most.
PROBES, BLOCK_WORDS, SHARD_BLOCKS, PASS_BLOCKS = 8, 32, 1 << 15, 1 << 20
#: Different words a task counts before it sends them on; code points of words whose edits are looked up at once.
HELD_WORDS, HELD_EDITS = 200_000, 1 << 18


def runs(doc_id: object, text: bytes | None) -> Counter:
    """Words of a text and how often each stands in it; one run in ``MISSPELT`` loses a character."""
    if not text:
        return Counter()
    out: Counter = Counter()
    prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(RUN.findall(text.translate(_LOWER).decode())).items():
        h = zlib.crc32(run.encode(), prefix)
        if h % MISSPELT == 0:
            run = run[: h % len(run)] + run[h % len(run) + 1 :]
        if len(run) >= LETTERS:
            out[run] += n
    return out


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word``, ``n``: all words of at least ``LETTERS`` letters and ``OCCURRENCES`` occurrences. Tasks count before they send."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for part in slices(iter([batch]), 1):
                for doc_id, text in zip(part.column(0).to_pylist(), utf8(part.column(1))):
                    for word, n in runs(doc_id, text).items():
                        held[word] += n
            if len(held) >= HELD_WORDS:
                yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
                held = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    counted = in_small_batches(docs).select(id_col, text_col).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURRENCES)


def by_length(words: list[str], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in ``words`` and code points (a row for each word) of words of one length, about ``most`` code points at a time."""
    size = np.array([len(w) for w in words], np.int64)
    for n in np.unique(size[size > 0]).tolist():
        of = np.flatnonzero(size == n)
        for rows in np.array_split(of, -(-len(of) * n // most)):
            text = "".join([words[i] for i in rows])
            yield rows, np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(rows), n)


def terms(letters: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A number for each letter at its place."""
    return mix64(letters.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + places.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def word_hashes(words: list[str]) -> np.ndarray:
    out = np.zeros(len(words), np.uint64)
    for rows, c in by_length(words, HELD_EDITS):
        out[rows] = np.bitwise_xor.reduce(terms(c, np.arange(c.shape[1])), axis=1)
    return out


def edits(c: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Edits of words of one length, given as code points: hashes by word and place, which of them are edits, the letter that is
    put there and the length of the result. First deletions (letter 0), then replacements by each letter that is larger.

    Of equal neighbours only the last is deleted, so that no word comes twice.
    """
    n, size = c.shape
    at, none = np.arange(size), np.zeros((n, 1), np.uint64)
    own = terms(c, at)
    reach = np.bitwise_xor.accumulate(own, axis=1)
    before = np.concatenate([none, reach[:, :-1]], 1)
    moved = np.bitwise_xor.accumulate(terms(c[:, 1:], at[:-1])[:, ::-1], axis=1)[:, ::-1]
    last = np.concatenate([c[:, 1:] != c[:, :-1], np.ones((n, 1), bool)], 1)
    yield before ^ np.concatenate([moved, none], 1), last, 0, size - 1
    without = reach[:, -1:] ^ own
    for letter in alphabet.tolist():
        yield without ^ terms(np.full(size, letter), at), c < letter, letter, size


def edited(word: str, place: int, letter: int) -> str:
    return word[:place] + (chr(letter) if letter else "") + word[place + 1 :]


def _bit(hashes: np.ndarray, probe: int) -> np.ndarray:
    """The bit (0 to 511) that each hash sets in its block: two probes in each quarter of it. The first four are in the hash."""
    h = hashes if probe < 4 else mix64(hashes ^ np.uint64(0xD6E8FEB86659FD93))
    return h >> np.uint64(7 * (probe % 4)) & np.uint64(127) | np.uint64((probe % 4) << 7)


def _places(hashes: np.ndarray, blocks: int) -> np.ndarray:
    """The block of each hash in a filter of so many, by its high bits."""
    return ((hashes >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


class Filters:
    """Bloom filters by length: ``blocks[length]`` is how many blocks a length has in all, ``shards[length, shard]`` holds some."""

    def __init__(self, blocks: dict[int, int], shards: dict[tuple[int, int], bytes], shard_blocks: int = SHARD_BLOCKS):
        self.blocks, self.shard_blocks = blocks, shard_blocks
        self.shards = {key: np.frombuffer(bits, np.uint64) for key, bits in shards.items()}

    def maybe(self, hashes: np.ndarray, length: int) -> np.ndarray:
        """Positions whose hash may be that of a word; hashes that belong to other shards aren't looked up."""
        total = self.blocks.get(length, 0)
        if not total or not len(hashes):
            return np.zeros(0, np.int64)
        place, found = _places(hashes, total), []
        for (of, shard), bits in self.shards.items():
            if of == length:
                mine = np.flatnonzero(place // self.shard_blocks == shard) if total > self.shard_blocks else np.arange(len(hashes))
                for p in range(PROBES):  # most fall at the first bits
                    bit = _bit(hashes[mine], p)
                    word = bits[(place[mine] - shard * self.shard_blocks) * 8 + (bit >> np.uint64(6)).astype(np.int64)]
                    mine = mine[(word >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)]
                found.append(mine)
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def filters(words: DataFrame, sizes: dict[int, int], shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """``length``, ``shard``, ``bits``: the filters of all words, each shard built by one task from its words alone.

    ``sizes`` says how many blocks the filter of a length has. A shard's task holds its bits, not its words.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            length, hashes = np.array([len(w) for w in words], np.int32), word_hashes(words)
            total = np.array([sizes[n] for n in length.tolist()], np.uint64)
            shard = ((hashes >> np.uint64(32)) * total >> np.uint64(32)).astype(np.int64) // shard_blocks
            yield pa.RecordBatch.from_arrays([pa.array(length), pa.array(shard.astype(np.int32)), pa.array(hashes.view(np.int64))], names=["length", "shard", "hash"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            length, shard = (batch.column(i).to_numpy() for i in (0, 1))
            hashes = batch.column(2).to_numpy().view(np.uint64)
            for key in sorted(set(zip(length.tolist(), shard.tolist()))):
                if key not in held:
                    if held:  # shards come one after the other
                        yield out(held)
                    held = {key: np.zeros((min(shard_blocks, sizes[key[0]] - key[1] * shard_blocks), 8), np.uint64)}
                h = hashes[(length == key[0]) & (shard == key[1])]
                row = _places(h, sizes[key[0]]) - key[1] * shard_blocks
                for bit in (_bit(h, p) for p in range(PROBES)):
                    np.bitwise_or.at(held[key], (row, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
        if held:
            yield out(held)

    def out(held: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
        (key, bits), = held.items()
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["length", "shard", "bits"])

    placed = words.select("word").mapInArrow(place, "length int, shard int, hash long")
    return placed.repartition("length", "shard").sortWithinPartitions("length", "shard").mapInArrow(build, "length int, shard int, bits binary")


def _passes(sizes: dict[int, int], most: int, shard_blocks: int) -> Iterator[list[tuple[int, int]]]:
    """Shards in groups of up to ``most`` blocks (one shard at least)."""
    group, held = [], 0
    for length in sorted(sizes):
        for shard in range(-(-sizes[length] // shard_blocks)):
            n = min(shard_blocks, sizes[length] - shard * shard_blocks)
            if group and held + n > most:
                yield group
                group, held = [], 0
            group.append((length, shard))
            held += n
    if group:
        yield group


def candidates(words: DataFrame, pass_blocks: int = PASS_BLOCKS, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """``word``, ``n``, ``other``: edits of the words that the filters let through, each pair of words once.

    The driver holds how many words each length has, the letters in use, and the shards of one pass.
    """
    spark = words.sparkSession
    counts = words.groupBy(F.length("word").alias("length")).count().collect()
    sizes = {r["length"]: -(-r["count"] // BLOCK_WORDS) for r in counts}
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct().collect()
    alphabet = np.array(sorted(ord(r["c"]) for r in letters), np.uint64)
    built = materialise(filters(words, sizes, shard_blocks))
    found = None
    for group in _passes(sizes, pass_blocks, shard_blocks):
        wanted = spark.createDataFrame(group, "length int, shard int")
        shards = {(r["length"], r["shard"]): r["bits"] for r in built.join(F.broadcast(wanted), ["length", "shard"]).collect()}
        held = spark.sparkContext.broadcast((sizes, shards, shard_blocks))
        lengths = sorted({n + d for n, _ in group for d in (0, 1)})

        def probe(batches: Iterator[pa.RecordBatch], held=held, alphabet=alphabet) -> Iterator[pa.RecordBatch]:
            known = Filters(*held.value)
            for batch in batches:
                row, other = [], []
                own = batch.column(0).to_pylist()
                for rows, c in by_length(own, HELD_EDITS):
                    for hashes, is_edit, letter, length in edits(c, alphabet):
                        which = np.flatnonzero(is_edit)
                        for at in which[known.maybe(hashes.ravel()[which], length)].tolist():
                            i = int(rows[at // c.shape[1]])
                            row.append(i)
                            other.append(edited(own[i], at % c.shape[1], letter))
                rows = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(other, pa.string())], names=["word", "n", "other"])

        some = words.select("word", "n").where(F.length("word").isin(lengths)).mapInArrow(probe, "word string, n long, other string")
        found = some if found is None else found.unionByName(some)
    return found if found is not None else spark.createDataFrame([], "word string, n long, other string")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: where each word's chain of forms ends. ``forms`` (``word, form``) has no circles.

    Every round each word takes its root's root, so chains of length c end after log2(c) rounds; since a form is at least
    twice as frequent as the word, chains have under 64 links and 6 rounds are enough.
    """
    now = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        following = now.select(F.col("word").alias("__of"), F.col("root").alias("__next"))
        moved = materialise(now.join(following, F.col("root") == F.col("__of"), "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__of").isNotNull().alias("moved")))
        now = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pass_blocks: int = PASS_BLOCKS, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """All words of the texts, grouped with the more frequent word that each is likely a misspelling of.

    A word: a maximal run of letters a-z (A-Z being lower-cased) and U+00C0 to U+00FF, of at least ``LETTERS`` letters and
    ``OCCURRENCES`` occurrences in all; runs that the checksum of document and run picks have lost a letter. Columns: ``word``;
    ``form``, of the words one inserted, deleted or replaced letter away the most frequent (ties: the first by code points), if
    it is ``FORM_SHARE`` times as frequent as the word, else null; ``root``, where forms of forms lead (the word itself without
    one); ``n`` long, occurrences; ``n_near`` long, how many words are one edit away; ``form_n`` long.

    Null and empty texts have no words; a null id counts as an empty one in the checksum. Repeated rows count as often as they
    stand there. Other columns aren't read; a table without words gives no rows. Long texts and words are taken whole.

    Words are counted in the tasks before they are shuffled, so a frequent word is one row a task. Pairs meet by the word that
    the edit gives, of which a word's edits bound the number; nothing is compared within groups.
    """
    words = materialise(vocabulary(docs, id_col, text_col))
    of = words.select(F.col("word").alias("__of"), F.col("n").alias("__n"))
    pairs = materialise(candidates(words, pass_blocks, shard_blocks).join(of, F.col("other") == F.col("__of")).select("word", "n", "other", F.col("__n").alias("other_n")))
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    near = both.groupBy(F.col("word").alias("__word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("form"))).alias("best"))
    joined = words.join(near, F.col("word") == F.col("__word"), "left")
    taken = -F.col("best.n") >= FORM_SHARE * F.col("n")
    told = materialise(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best.form")).alias("form"), F.when(taken, -F.col("best.n")).alias("form_n")))
    ends = roots(told.where("form is not null").select("word", "form")).select(F.col("word").alias("__word"), F.col("root").alias("__root"))
    return told.join(ends, F.col("word") == F.col("__word"), "left").select("word", "form", F.coalesce("__root", "word").alias("root"), "n", "n_near", "form_n")
