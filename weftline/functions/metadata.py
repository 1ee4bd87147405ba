"""Product metadata and search input as column expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import extract_year

# Detail keys that may hold a date, first one first.
DATE_KEYS = ("Release date", "Release Date", "Original Release Date", "Date First Available")
# Shelves that say nothing of the genre.
SHELVES = (
    "movies & tv", "movies", "tv", "prime video", "video games", "games", "pc", "mac", "featured categories", "genre for featured categories", "boxed sets",
    "independently distributed", "studio specials", "blu-ray", "4k ultra hd", "all titles", "digital games", "online game services", "legacy systems",
)
# Labels of platforms.
PLATFORM_LABEL = r"(?i)playstation|xbox|nintendo|wii|pc|mac|sega|ds\b"
# Main categories and details of films and music that are filed under games.
MEDIA_CATEGORIES = ("Movies & TV", "Digital Music", "Prime Video")
MEDIA_STORE = r"(?i)Format:\s*(DVD|Blu-ray|Audio CD|VHS|Prime Video|MP3)|\(Actor"
MEDIA_TYPES = ("blu-ray", "dvd", "vhs")
# Categories of hardware, words that only hardware has, and words of accessories.
HARDWARE_CATEGORY = "accessor|consoles|virtual reality|hardware"
HARDWARE = (
    r"hdmi|splitter|cable|charger|charging|controller|headset|adapter|memory card|gift card|power supply|membership|subscription|console bundle|"
    r"fight ?stick|arcade stick|neo ?geo mini|go plus|light gun"
)
ACCESSORY = (
    r"controller|gamepad|joystick|headset|headphones?|charger|charging|cable|adapter|case|skin|sticker|decal|stand|mount|grip|thumb\s*grips?|memory\s*card|"
    r"hard\s*drive|ssd|power\s*supply|battery|batteries|keyboard|mouse|mice|mousepad|mouse\s*pad|gift\s*card|membership|subscription|console(?!\s*game)|"
    r"faceplate|cooling|fan|remote|sensor|camera|steering\s*wheel|pedals|protector|screen\s*protector|carrying|travel\s*bag|dock|amiibo|figure|poster|"
    r"t-?shirt|hoodie|mug|replacement|repair|tool\s*kit|vr\s*headset|guitar\s*strap|hdmi|splitter|usb|bluetooth|fight\s*stick|arcade\s*stick|"
    r"neo\s*geo\s*mini|go\s*plus"
)
# Words of box sets, and those of series, which are no compilations.
BOX_SET = (
    r"\b(?:\d+|two|three|four|five|six|seven|eight|nine|ten)[\s-]*(?:film|movie|feature)s?\b|\btrilogy\b|\bquadrilogy\b|\banthology\b|"
    r"\b(?:double|triple)\s+feature\b|\bfavorites\b|\bbox\s*set\b|\bmovie\s+collection\b|\bcomplete\s+(?:saga|collection)\b|\bcollection\s*(?:\(|$)|\s/\s.+\s/\s"
)
SERIES = r"\bseasons?\b|\bseries\b"


def year_from_metadata(features: Column, details: Column, title: Column) -> Column:
    """A feature that is a year; else the first date among the details that has one; else the year in the title's brackets."""
    of_feature = F.get(F.filter(F.transform(features, lambda f: F.trim(f)), lambda f: f.rlike(r"^(19[2-9]\d|20[0-3]\d)$")), F.lit(0))
    dates = [F.nullif(F.regexp_extract(details[k], r"\b(19[2-9]\d|20[0-3]\d)\b", 1), F.lit("")) for k in DATE_KEYS]
    return F.coalesce(F.coalesce(of_feature, *dates).cast("int"), extract_year(title))


def flatten_text(parts: Column, most: int) -> Column:
    """Strings of an array in one, up to ``most`` characters; nulls count as empty, a null array as ''."""
    return F.substring(F.coalesce(F.array_join(parts, " ", ""), F.lit("")), 1, most)


def is_accessory(title: Column) -> Column:
    return title.rlike(rf"(?i)\b(?:{ACCESSORY})\b")


def is_game(title: Column, categories: Column, main_category: Column, store: Column, details: Column) -> Column:
    """Neither misfiled media nor hardware. Where the categories say "Games", only words of hardware count against it."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    media = yes(main_category.isin(*MEDIA_CATEGORIES)) | yes(store.rlike(MEDIA_STORE)) | yes(F.lower(details["Type of item"]).isin(*MEDIA_TYPES)) | yes(F.map_contains_key(details, "MPAA rating"))
    device = yes(F.exists(categories, lambda c: F.lower(c).rlike(HARDWARE_CATEGORY)))
    named = F.when(yes(F.array_contains(categories, "Games")), title.rlike(rf"(?i)\b(?:{HARDWARE})\b")).otherwise(is_accessory(title))
    return ~media & ~device & ~yes(named)


def main_image(images: Column) -> Column:
    """Address of the first image over https, the main variant first; of each, the largest size there is. '' if none."""
    address = lambda i: F.coalesce(*[F.nullif(i[size], F.lit("")) for size in ("large", "hi_res", "thumb")])
    main = lambda i: F.coalesce(i["variant"] == "MAIN", F.lit(False))
    order = F.concat(F.filter(images, main), F.filter(images, lambda i: ~main(i)))
    return F.coalesce(F.get(F.filter(F.transform(order, address), lambda u: u.startswith("https://")), F.lit(0)), F.lit(""))


def creator(details: Column, store: Column, directors: Column) -> Column:
    """Studio, maker, store or up to two directors, whichever comes first; a store that is a format is passed over."""
    people = F.coalesce(F.array_join(F.slice(directors, 1, 2), ", "), F.lit(""))
    named = F.coalesce(*[F.nullif(c, F.lit("")) for c in (details["Studio"], details["Manufacturer"], store)], people)
    return F.substring(F.when(named.startswith("Format:"), people).otherwise(named), 1, 120)


def genre_labels(categories: Column, domain: Column, most: int = 6) -> Column:
    """The first categories that are neither shelves nor, for games, platforms."""
    kept = F.filter(categories, lambda c: ~F.lower(c).isin(*SHELVES) & ~((domain == "game") & c.rlike(PLATFORM_LABEL)))
    return F.slice(kept, 1, most)


def is_compilation(title: Column, domain: Column) -> Column:
    """A film box set. Seasons and series are works of their own."""
    return (domain == "movie") & title.rlike(f"(?i){BOX_SET}") & ~title.rlike(f"(?i){SERIES}")


def parse_title_query(text: Column) -> Column:
    """``title``, ``domain`` and ``year`` of input such as "game: Title (2005)"; the hints are null where absent."""
    prefix = F.lower(F.regexp_extract(text, r"(?i)^\s*(movie|film|tv|show|game)\s*:", 1))
    year = F.regexp_extract(text, r"[(\[]\s*((?:18|19|20)\d\d)\s*[)\]]\s*$", 1)
    title = F.regexp_replace(F.regexp_replace(text, r"(?i)^\s*(movie|film|tv|show|game)\s*:\s*", ""), r"\s*[(\[]\s*(?:18|19|20)\d\d\s*[)\]]\s*$", "")
    domain = F.when(prefix == "game", "game").when(prefix != "", "movie")
    return F.struct(F.trim(title).alias("title"), domain.alias("domain"), F.when(year != "", year.cast("int")).alias("year"))


def ranked_keywords(tags: Column, most: int = 30) -> Column:
    """Names of tags that give nothing away, by falling rank; equal ranks keep their order."""
    open_tags = F.filter(tags, lambda t: ~F.coalesce(t["is_spoiler"], F.lit(False)) & t["name"].isNotNull())
    keyed = F.transform(open_tags, lambda t, i: F.struct((-F.coalesce(t["rank"], F.lit(0))).alias("r"), i.alias("i"), t["name"].alias("name")))
    return F.slice(F.transform(F.array_sort(keyed), lambda t: t["name"]), 1, most)


def prefix_tokens(words: Column, most: int = 12) -> Column:
    """Distinct beginnings, up to ``most`` letters, of the words of a normalised title."""
    each = F.transform(F.filter(F.split(words, " "), lambda w: w != ""), lambda w: F.transform(F.sequence(F.lit(1), F.least(F.length(w), F.lit(most))), lambda n: F.substring(w, F.lit(1), n)))
    return F.array_distinct(F.flatten(each))


def word_spans(words: Column) -> Column:
    """Distinct runs of consecutive words of a normalised title."""
    w = F.filter(F.split(words, " "), lambda x: x != "")
    runs = F.transform(w, lambda _, i: F.transform(F.sequence(F.lit(1), F.size(w) - i), lambda n: F.array_join(F.slice(w, i + 1, n), " ")))
    return F.array_distinct(F.flatten(runs))
