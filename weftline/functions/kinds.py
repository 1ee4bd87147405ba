"""What a title is: game, series or film, and what is never recommended."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of series in titles and in descriptions; a description counts with ``TV_WORDS`` of them in its beginning.
TV_TITLE = r"(?i)\b(?:seasons?|series|episodes?)\b"
TV_TEXT = r"(?i)\b(?:seasons?|series|episodes?|sitcom|broadcast)\b"
TV_WORDS, BEGINNING = 3, 1500
#: Goods around games that aren't games, books about games, and words of the book trade.
GOODS = r"(?i)\b(?:soundtrack|poster|figurine|gift card|keychain)\b"
GUIDE = r"(?i)\b(?:strategy guide|walkthrough|art book)\b"
BOOK_TRADE = r"(?i)\b(?:paperback|hardcover|isbn)\b"


def tv_title(title: Column) -> Column:
    return F.coalesce(title.rlike(TV_TITLE), F.lit(False))


def item_kind(domain: Column, external: Column, title: Column, text: Column) -> Column:
    """``game``, or the kind that a matched title has elsewhere, or ``tv`` by title or description, else ``movie``."""
    described = F.regexp_count(F.substring(F.coalesce(text, F.lit("")), 1, BEGINNING), F.lit(TV_TEXT)) >= TV_WORDS
    return F.when(domain == "game", "game").when(external.isNotNull(), external).when(tv_title(title) | described, "tv").otherwise("movie")


def ineligible(domain: Column, title: Column, text: Column, matched: Column) -> Column:
    """Games that are goods and no bundle, or that match no known title and are books by their text or title."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    goods = yes(title.rlike(GOODS)) & ~yes(F.contains(title, F.lit(" + ")))
    book = ~yes(matched) & (yes(text.rlike(BOOK_TRADE)) | yes(title.rlike(GUIDE)))
    return (domain == "game") & (goods | book)


def wanted_kind(kind: Column, target: str | None) -> Column:
    """Whether a kind is asked for: ``film`` is a movie or a series, no target is everything."""
    return F.lit(True) if target is None else kind.isin("movie", "tv") if target == "film" else kind == target
