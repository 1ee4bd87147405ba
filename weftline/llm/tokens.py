"""Byte-level BPE inside tasks, with the ids of a ``tokenizers`` vocabulary file, and token counts by section (operator 9).

The vocabulary file is read once on the driver and shipped whole (a few MB, whatever the corpus). Its merges are in the
order of their ids, so the same merges can be run by ``tiktoken``, which takes a fifth of the time of ``tokenizers``;
``ByteBpe`` checks that order, leaves texts that hold a special token's string to ``tokenizers`` itself, and tests compare
the two on random texts.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_small_batches, slices, utf8

# The split patterns of this public vocabulary family. LIGHT differs only where white space meets white space.
FULL_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LIGHT_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"""

#: A text is encoded in one call up to so many characters; a longer one is cut where no pre-token can cross.
CALL_CHARS = 200_000
DEFAULT_VOCABULARY = "byte_bpe_50k.json"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_VOCABULARY)


def _byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in such a vocabulary: itself where printable, else the next free code point."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Encodes as ``Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids`` does."""

    _made: dict[int, ByteBpe] = {}

    def __init__(self, spec: bytes):
        import tiktoken
        from tokenizers import Tokenizer

        model = json.loads(spec)
        symbol, special = _byte_symbols(), {t["content"] for t in model["added_tokens"]}
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        raw = {bytes(symbol[c] for c in tok): i for tok, i in vocab.items() if tok not in special}
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        self.ordered = all(a < b for a, b in zip(made, made[1:]))
        self.exact = Tokenizer.from_str(spec.decode())
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.blank_pair = re.compile(r"\s\s")
        self.cut = re.compile(r"(?<=\S) (?=\S)")
        self.full = tiktoken.Encoding("full", pat_str=FULL_SPLIT, mergeable_ranks=raw, special_tokens={})
        self.light = tiktoken.Encoding("light", pat_str=LIGHT_SPLIT, mergeable_ranks=raw, special_tokens={})
        self.lengths = np.zeros(max([*vocab.values(), *(t["id"] for t in model["added_tokens"])]) + 1, np.int64)
        for tok, i in raw.items():
            self.lengths[i] = len(tok)
        for t in model["added_tokens"]:
            self.lengths[t["id"]] = len(t["content"].encode())

    @classmethod
    def of(cls, spec: bytes) -> ByteBpe:
        """One for each vocabulary and worker process."""
        key = hash(spec)
        if key not in cls._made:
            cls._made[key] = cls(spec)
        return cls._made[key]

    def ids(self, text: str) -> array:
        """Ids of the whole text, as unsigned 32-bit numbers."""
        if not self.ordered or (self.special and self.special.search(text)):
            return array("I", self.exact.encode(text, add_special_tokens=False).ids)
        coder = self.full if self.blank_pair.search(text) else self.light
        if len(text) <= CALL_CHARS:
            return array("I", coder.encode_ordinary(text))
        out, at = array("I"), 0
        while at < len(text):
            # A single space between two other characters belongs to what follows it: no pre-token crosses such a place.
            found = self.cut.search(text, at + CALL_CHARS)
            end = found.start() if found else len(text)
            out.extend(coder.encode_ordinary(text[at:end]))
            at = end
        return out


def load_vocabulary(path: str | None) -> bytes:
    return Path(path or default_vocabulary()).read_bytes()


RULES = ("start", "end", "majority")


def section_counts(text: bytes, ids: np.ndarray, lengths: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Section starts (characters, with the text's length last), tokens of each section, and tokens that cross a boundary.

    A section is a line with its line end. Each token has the span of bytes it stands for; it goes to the section that
    holds its first byte (``start``), its last byte (``end``) or most of its bytes, the earlier one if equal (``majority``).
    """
    raw = np.frombuffer(text, np.uint8)
    breaks = np.flatnonzero(raw == 10) + 1
    starts = np.concatenate([[0], breaks[breaks < len(raw)]]).astype(np.int64)
    ends = np.cumsum(lengths[ids])
    begins = ends - lengths[ids]
    first = np.searchsorted(starts, begins, side="right") - 1
    last = np.searchsorted(starts, np.maximum(ends - 1, begins), side="right") - 1
    owner = first
    if rule == "end":
        owner = last
    elif rule == "majority" and len(ids):
        owner = first.copy()
        for i in np.flatnonzero(first != last):
            edges = np.concatenate([[begins[i]], starts[first[i] + 1 : last[i] + 1], [ends[i]]])
            owner[i] = first[i] + int(np.argmax(np.diff(edges)))
    counts = np.bincount(owner, minlength=len(starts))
    crossing = np.bincount(first[first != last], minlength=len(starts))
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return chars[np.concatenate([starts, [len(raw)]])], counts, crossing


def token_counts(docs: DataFrame, vocabulary: str | None = None, rule: str = "start", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of each line of each text, every text encoded whole and once.

    Columns: the id, ``section`` int (from 0), ``start`` and ``end`` long (characters), ``n_tokens`` long, ``n_crossing``
    long (tokens that begin here and end in a later section), ``doc_tokens`` long. Tokens that cross a boundary go by
    ``rule`` (see ``section_counts``), so a document's ``n_tokens`` sum to ``doc_tokens``.

    A null or empty text gives one empty section with no tokens. Repeated rows give repeated results; rows with a null id
    keep it; other columns are not read; an empty table gives no rows. A pass without shuffle: memory is a slice of an Arrow batch.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    spec = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.of(spec.value)
        for batch in slices(batches, 1):
            row, section, start, end, n, over, total = [], [], [], [], [], [], []
            for i, text in enumerate(utf8(batch.column(1))):
                ids = np.frombuffer(bpe.ids(text.decode()), np.uint32) if text else np.zeros(0, np.uint32)
                at, counts, crossing = section_counts(text or b"", ids, bpe.lengths, rule)
                k = len(counts)
                row.append(np.full(k, i))
                section.append(np.arange(k, dtype=np.int32))
                start.append(at[:-1])
                end.append(at[1:])
                n.append(counts)
                over.append(crossing)
                total.append(np.full(k, len(ids)))
            if row:
                ids_out = batch.column(0).take(pa.array(np.concatenate(row)))
                rest = [pa.array(np.concatenate(x)) for x in (section, start, end, n, over, total)]
                yield pa.RecordBatch.from_arrays([ids_out, *rest], names=names)

    names = [id_col, "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, section int, start long, end long, n_tokens long, n_crossing long, doc_tokens long"
    return in_small_batches(docs).select(id_col, text_col).mapInArrow(count, schema)
