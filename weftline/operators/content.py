"""Text vectors: a fitted TF-IDF projection with theme parts, and encoders that tasks make for themselves."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.mllib.linalg import Vectors, VectorUDT
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from ..sources.scratch import materialise
from .models import WORD, counted_terms

#: Terms of the vocabulary at most; with the dimensions it bounds what the driver and tasks hold: 60,000 x 128 doubles, 61 MB.
VOCABULARY, DIMS = 60_000, 128
#: Weight of the theme part against the text part, each of length 1.
THEME_WEIGHT = 0.6


def terms(text: Column, stop: list[str]) -> Column:
    """Lower-cased words of two letters or more that aren't stop words, then pairs of neighbours among them."""
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), 1), lambda w: ~w.isin(stop) if stop else F.lit(True))
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, F.filter(pairs, lambda p: p.isNotNull()))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class ContentModel:
    """A fitted transform from text and themes to vectors. ``projection`` has a row for each of ``vocabulary``'s terms."""

    vocabulary: list[str]
    idf: np.ndarray
    projection: np.ndarray
    themes: list[str]
    stop: list[str]
    singular: np.ndarray
    theme_weight: float = THEME_WEIGHT

    def vectors_of(self) -> Callable[[pd.Series, pd.Series], np.ndarray]:
        """What a task does with lists of terms and of themes."""
        at = {t: i for i, t in enumerate(self.vocabulary)}
        theme_at = {t: i for i, t in enumerate(self.themes)}

        def vectors(lists: pd.Series, themes: pd.Series) -> np.ndarray:
            text, theme = np.zeros((len(lists), self.projection.shape[1])), np.zeros((len(lists), len(self.themes)))
            for row, (found, named) in enumerate(zip(lists, themes)):
                places, counts = np.unique([at[t] for t in found if t in at], return_counts=True)
                if len(places):
                    places = places.astype(np.int64)
                    text[row] = _unit((1 + np.log(counts)) * self.idf[places]) @ self.projection[places]
                for t in named if named is not None else ():
                    if t in theme_at:
                        theme[row, theme_at[t]] = 1
            return _unit(np.hstack([_unit(text), self.theme_weight * _unit(theme)]))

        return vectors

    def transform(self, rows: DataFrame, text_col: str = "text", themes_col: str | None = None, out: str = "vector") -> DataFrame:
        """``rows`` with ``out``, array<double> of length 1: the text part, then the theme part.

        Unseen texts are taken like those of the fit; terms that the vocabulary lacks count for nothing, and a text without any
        (null, empty) has an all-zero text part; with no theme either, the vector is zero. Nothing is shuffled: tasks hold the
        model, which is bounded by ``VOCABULARY`` and ``DIMS``.
        """
        shared = rows.sparkSession.sparkContext.broadcast(self)

        @pandas_udf("array<double>")
        def embed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            vectors = shared.value.vectors_of()
            for lists, themes in batches:
                yield pd.Series(list(vectors(lists, themes)))

        named = F.col(themes_col).cast("array<string>") if themes_col else F.array().cast("array<string>")
        return rows.withColumn(out, embed(terms(F.col(text_col), self.stop), named))

    def query(self, spark, text: str = "", themes: list[str] | None = None) -> np.ndarray:
        """The vector of a wish in free words and themes, for users without a history. Themes count as words too."""
        asked = list(dict.fromkeys(themes or []))
        row = spark.createDataFrame([(" ".join([text, *asked]), asked)], "text string, themes array<string>")
        return np.array(self.transform(row, themes_col="themes").first()["vector"])


def fit_content(docs: DataFrame, stop: list[str], themes: list[str], id_col: str = "doc_id", text_col: str = "text", dims: int = DIMS, vocabulary: int = VOCABULARY, min_df: int = 2, max_df: float = 0.5) -> ContentModel:
    """TF-IDF of words and word pairs (1 + ln tf, smooth idf, rows of length 1) and its first right singular vectors.

    The vocabulary: of the terms in at least ``min_df`` documents and at most the share ``max_df`` of them, the ``vocabulary``
    most frequent. Where none is left, all terms count. The decomposition multiplies the distributed rows by vectors as long as
    the vocabulary, until ``dims`` singular vectors have converged. Their signs are such that the largest entry is positive.
    """
    tf = counted_terms(docs, terms(F.col(text_col), stop), id_col)
    n = docs.count()
    each = tf.select(F.explode(F.arrays_zip("terms", "counts")).alias("x"))
    df = materialise(each.groupBy(F.col("x.terms").alias("term")).agg(F.count("*").alias("df"), F.sum("x.counts").alias("total")))
    kept = df.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
    if kept.isEmpty():
        kept = df
    chosen = sorted((r["term"], r["df"]) for r in kept.orderBy(F.desc("total"), "term").limit(vocabulary).collect())
    words, idf = [t for t, _ in chosen], np.array([np.log((1 + n) / (1 + d)) + 1 for _, d in chosen])
    if not words:
        return ContentModel([], idf, np.zeros((0, 0)), themes, stop, np.zeros(0))
    spark = docs.sparkSession
    shared, size = spark.sparkContext.broadcast(({t: i for i, t in enumerate(words)}, idf)), len(words)

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of length 1 over the vocabulary; documents without any of its terms go."""
        places, law = shared.value
        for rows in batches:
            out = []
            for found, counts in zip(rows["terms"], rows["counts"]):
                cells = sorted((places[t], c) for t, c in zip(found, counts) if t in places)
                if cells:
                    at, c = (np.array(x, np.int64) for x in zip(*cells))
                    out.append((at, _unit((1 + np.log(c)) * law[at])))
            yield pd.DataFrame(out, columns=["at", "w"])

    sparse = F.udf(lambda at, w: Vectors.sparse(size, at, w), VectorUDT())
    rows = materialise(tf.select("terms", "counts").mapInPandas(weigh, "at array<int>, w array<double>"))
    matrix = rows.select(sparse("at", "w").alias("row")).persist()
    k = max(1, min(dims, size - 1, matrix.count() - 1))
    found = RowMatrix(matrix).computeSVD(k)
    v, s = found.V.toArray(), found.s.toArray()
    matrix.unpersist()
    v = v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1.0, 1.0)
    return ContentModel(words, idf, v, themes, stop, s)


#: What encodes a list of texts as rows of a matrix.
Encoder = Callable[[list[str]], np.ndarray]


def hashed_ngrams(dims: int = 256, sizes: tuple[int, ...] = (3, 4, 5)) -> Encoder:
    """Character n-grams of ``<text>`` hashed to signed dimensions, rows of length 1; needs no model file and no fit."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims))
        for row, text in enumerate(texts):
            c = np.frombuffer(f"<{text.lower()}>".encode("utf-32-le"), np.uint32).astype(np.uint64)
            for n in sizes:
                if len(c) >= n:
                    h = np.full(len(c) - n + 1, n, np.uint64)
                    for i in range(n):
                        h = (h ^ c[i : len(c) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
                        h ^= h >> np.uint64(29)
                    np.add.at(out[row], (h % np.uint64(dims)).astype(np.int64), np.where(h >> np.uint64(63), -1.0, 1.0))
        return _unit(out)

    return encode


def encode_texts(rows: DataFrame, make: Callable[[], Encoder] = hashed_ngrams, text_col: str = "text", out: str = "vector") -> DataFrame:
    """``rows`` with ``out``, the text's vector (array<double>); null texts have none.

    ``make`` is called once in each task, so an encoder may load what it needs there. Of equal texts in a batch one is encoded.
    """

    @pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make()
        for texts in batches:
            codes, known = pd.factorize(texts)
            vectors = [np.asarray(v, float) for v in encoder(list(known))] if len(known) else []
            yield pd.Series([vectors[c] if c >= 0 else None for c in codes], dtype=object)

    return rows.withColumn(out, encode(F.col(text_col)))
