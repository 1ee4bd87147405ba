"""Language identification by compression with per-language dictionaries (operator 7)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import in_small_batches, keep_where, slices, utf8

#: Training sample: of each language, about so many snippets of so many characters, taken by hash of the id and text.
SNIPPETS, SNIPPET_CHARS = 600, 600
#: Dictionaries of a language, each from other snippets, and their size. The first decides alone unless its margin is
#: narrow; then all of them do, at a level that searches longer.
DICTIONARIES, DICTIONARY_BYTES = 3, 110_000
LEVELS, NARROW = (6, 12), 0.03
#: Bytes of all dictionaries together, which are broadcast: with over 128 languages each one's are smaller.
ALL_BYTES = 43_000_000
#: Texts are compressed in pieces of so many bytes, each from the dictionary alone, so margins don't fade with length.
PIECE_BYTES = 2_000
#: Rejected: a best language that saves less than this share of the second's bytes.
MIN_MARGIN = 0.002

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def letters(text: str) -> bytes:
    """Lower-cased text with everything in ASCII that isn't a letter as single spaces."""
    return b" ".join(text.lower().encode().translate(_LETTERS).split())


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _share(*cols: Column) -> Column:
    """A number from 0 to 1 that depends on the row's content alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / float(1 << 30)


def dictionaries(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, list[bytes]]:
    """Raw-content dictionaries of each language, fitted on a bounded sample of the rows with a language and a letter.

    Distinct texts of each language are counted over all rows (nearly: by a sketch); then texts whose hash falls under that
    language's share are read, a snippet of each, at a place by hash, so copies count once. About ``SNIPPETS`` come to the
    driver for each language, whatever the input, and fewer where ``ALL_BYTES`` hold fewer.
    """
    rows = train.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    counts = rows.groupBy(lang_col).agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64(text_col), 0.02).alias("texts"))
    counts = counts.orderBy(F.desc("n"), lang_col).collect()  # a row a language
    if not counts:
        return {}
    size = min(DICTIONARY_BYTES, ALL_BYTES // (DICTIONARIES * len(counts)))
    wanted = max(1, min(SNIPPETS, 3 * DICTIONARIES * size // SNIPPET_CHARS))
    shares = train.sparkSession.createDataFrame([(r[0], min(1.0, 1.5 * wanted / max(1, r[2]))) for r in counts], f"__lang {train.schema[lang_col].dataType.simpleString()}, __share double")
    begin = (_share(F.lit("at"), text_col) * F.greatest(F.length(text_col) - SNIPPET_CHARS, F.lit(0))).cast("int") + 1
    # A text twice in the sample helps nothing: copies share their hash.
    picked = rows.join(F.broadcast(shares), F.col(lang_col) == F.col("__lang")).where(_share(F.lit("row"), text_col) < F.col("__share"))
    sample = picked.select(F.col("__lang").alias("lang"), _share(F.lit("order"), text_col).alias("o"), F.substring(F.col(text_col), begin, F.lit(SNIPPET_CHARS)).alias("s")).distinct()
    rank = F.row_number().over(W.partitionBy("lang").orderBy("o", "s"))
    by: dict[str, list[tuple[float, bytes]]] = {}
    for r in sample.withColumn("k", rank).where(F.col("k") <= 4 * wanted).collect():
        by.setdefault(r["lang"], []).append((r["o"], letters(r["s"])))
    out = {}
    for lang in (r[0] for r in counts if r[0] in by):
        found = sorted(by[lang])
        parts = [b" ".join(s for _, s in found[k::DICTIONARIES])[-size:] for k in range(DICTIONARIES)]
        out[lang] = [p for p in parts if len(p) >= 8] or [b" ".join(s for _, s in found).ljust(8)]
    return out


class Identifier:
    """Smallest encoding wins; equal sums go to the language with more training texts, which stands first."""

    def __init__(self, dicts: dict[str, list[bytes]]):
        self.langs = list(dicts)
        self.quick = [[self._coder(dicts[lang][0], LEVELS[0])] for lang in self.langs]
        self.slow = [[self._coder(raw, LEVELS[1]) for raw in dicts[lang]] for lang in self.langs]

    @staticmethod
    def _coder(raw: bytes, level: int):
        import zstandard

        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)

    @staticmethod
    def _margin(raw: bytes, coders: list[list]) -> tuple[int, float]:
        """The language with the smallest encoding, and the share that it saves against the second."""
        sizes = np.zeros(len(coders))
        for at in range(0, max(len(raw), 1), PIECE_BYTES):
            piece = raw[at : at + PIECE_BYTES]
            for k, own in enumerate(coders):
                sizes[k] += sum(len(c.compress(piece)) for c in own) / len(own)
        best, second = int(np.argmin(sizes)), np.partition(sizes, 1)[1]
        return best, float((second - sizes[best]) / second)

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the text is rejected."""
        if not text or not self.langs or not has_letter(text):
            return "und", 0.0, True
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        raw = letters(text)
        best, margin = self._margin(raw, self.quick)
        if margin < NARROW:
            best, margin = self._margin(raw, self.slow)
        return self.langs[best], float(1 / (1 + np.exp(-20 * margin))), margin < MIN_MARGIN


def identify(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Predicted language of each whole text.

    Columns: the id, ``lang_pred`` (a language of ``train``; ``und`` if the text is null or has no letter, or nothing was
    learned), ``score`` (0.5 for a tie, rising with the margin between the two smallest encodings; 0 with ``und``) and
    ``rejected`` (``und``, or a margin under ``MIN_MARGIN``). Only ``text_col`` of ``docs`` is an input of a prediction.

    Equal sizes go to the language with more training texts. Repeated rows give repeated results, null ids stay, other columns are
    not read, an empty table gives no rows. The dictionaries, broadcast, are bounded by the parameters above.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries(train, id_col, text_col, lang_col))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        which = Identifier(shared.value)
        for batch in slices(batches, 1):
            found = [which(t.decode() if t else None) for t in utf8(batch.column(1))]
            lang, score, rejected = map(list, zip(*found, strict=True)) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=names)

    names = [id_col, "lang_pred", "score", "rejected"]
    kind = docs.schema[id_col].dataType.simpleString()
    return in_small_batches(docs).select(id_col, text_col).mapInArrow(predict, f"`{id_col}` {kind}, lang_pred string, score double, rejected boolean")


def drop_rejected(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents that ``identify`` doesn't reject, with their columns as they were; each row is judged by its own text."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries(train, id_col, text_col, lang_col))

    def accepts() -> Callable[[bytes | None], bool]:
        which = Identifier(shared.value)
        return lambda text: not which(text.decode() if text else None)[2]

    return keep_where(docs, text_col, accepts)


def held_out(id_col: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """Whether crc32 of the id as text leaves ``part``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))
