"""Column functions on text."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# --- fixed values: patterns of structural noise ---
BREAK = r"(?iu)(?:andlt|&lt;)\s*br\s*/?\s*(?:andgt|&gt;)"
TAG = r"<[^>]+>"
MANGLED_ENTITY = r"(?i)and(?:lt|gt|amp|quot|apos)"
BREAK_REMNANT = r"(?i)\bbr\s*/|/\s*br\b"
AWARD_PREFIX = r"^\s*(\d{5,})[\s.:\-]+"
NAME = r"[A-Z][A-Za-z'’.\-]+,\s+[A-Z][A-Za-z'’.\-]+(?:\s+[A-Z]\.?)?"
NAMES_PREFIX = rf"^((?:{NAME})(?:\s*(?:;|,|and|&)\s*(?:{NAME}))*)\s+"
BOILERPLATE = r"reflects\s+NSF['’]s\s+statutory\s+mission|intellectual\s+merit\s+and\s+broader\s+impacts\s+review\s+criteria|deemed\s+worthy\s+of\s+support\s+through\s+evaluation"
TOKEN = r"([a-z][a-z\-]{2,})"
PHRASE_TOKEN = r"([a-z][a-z]{2,})"
SUB_AWARD = r"(?i)\s*-\s*Sub\s*Award$"


#: What str.isspace of Python is true for.
_SPACES = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def clean_ws(c) -> Column:
    """White space runs (Unicode's and U+001C to U+001F) become one space, none at the ends; null becomes empty. Single
    spaces are no matches, for most texts have nothing else; visible ASCII is passed over by one comparison."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?![!-~])(?: [{_SPACES}]+|[{_SPACES}&&[^ ]][{_SPACES}]*)", " "))


@F.pandas_udf(StringType())
def _collapsed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: "" if t is None else " ".join(t.split()))


def clean_long(c) -> Column:
    """``clean_ws`` for whole texts: Python's split knows the same white space and costs a tenth of the pattern."""
    return _collapsed(c)


def parse_year(c) -> Column:
    """A whole number from 1950 to 2100, else null; digits other than 0-9 give null."""
    text = clean_ws(c)
    year = F.when(text.rlike("^[0-9]+$"), text.try_cast("int"))
    return F.when(year.between(1950, 2100), year)


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or "&" not in t else html.unescape(t))


def sanitize(c, entities: bool = True) -> Column:
    """Breaks, tags, mangled entities and remnants of breaks become spaces; entities are resolved before tags go."""
    text = F.regexp_replace(c, BREAK, " ")
    text = _unescape(text) if entities else text
    for pattern in (TAG, MANGLED_ENTITY, BREAK_REMNANT):
        text = F.regexp_replace(text, pattern, " ")
    return text


def strip_structural(df, column: str, entities: bool = True):
    """df with ``column`` cleaned, and flags had_award and had_boiler.

    A leading award number goes, and only after one a list of names; then each sentence with boilerplate goes. Sentences
    are tried from their start alone: from each of their places, it would cost the square of a sentence's length.
    """
    df = df.withColumn("_a", sanitize(F.col(column), entities)).withColumn("had_award", F.col("_a").rlike(AWARD_PREFIX))
    rest = F.regexp_replace(F.regexp_replace("_a", AWARD_PREFIX, ""), NAMES_PREFIX, "")
    df = df.withColumn("_b", F.when(F.col("had_award"), rest).otherwise(F.col("_a"))).withColumn("had_boiler", F.col("_b").rlike(f"(?i){BOILERPLATE}"))
    text = F.when(F.col("had_boiler"), F.regexp_replace("_b", rf"(?i)(?<![^.])[^.]*?(?:{BOILERPLATE})[^.]*(?:\.|$)", " ")).otherwise(F.col("_b"))
    return df.withColumn(column, clean_ws(text)).drop("_a", "_b")


def tokens(c) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(1))


def phrase_tokens(c) -> Column:
    return F.regexp_extract_all(c, F.lit(PHRASE_TOKEN), F.lit(1))


def clean_phrase(c) -> Column:
    """Hyphens set apart are joined, white space collapses, spaces and hyphens go from the ends."""
    return F.btrim(F.regexp_replace(F.regexp_replace(c, " - ", "-"), r"(?U)[\s\x1c-\x1f]+", " "), F.lit(" -"))


def is_phrase(c) -> Column:
    """At least two characters, one of them a letter."""
    return (F.length(c) >= 2) & c.rlike(r"\p{L}")


def escape_html(c) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return c


def escape_pattern(c) -> Column:
    return F.regexp_replace(c, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def font_size(count, most, low: float = 9, high: float = 64, power: float = 0.35) -> Column:
    """Size between low and high on a power scale from 1 to most; halfway where most is 1."""
    at = (F.pow(count, F.lit(power)) - 1) / (F.pow(most, F.lit(power)) - 1)
    return F.when(most <= 1, F.lit((low + high) / 2)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), low + (high - low) * at)))


def word_count(c) -> Column:
    return F.size(F.split(F.trim(c), r"(?U)\s+"))


def routed(c, words: int = 8) -> Column:
    """Text with the prefix that an embedding model of queries and passages expects: over ``words`` words, a passage."""
    return F.when(word_count(c) > words, F.concat(F.lit("passage: "), c)).otherwise(F.concat(F.lit("query: "), c))


def ramp_position(count, most, floor: float = 0.16) -> Column:
    """Where a count stands on a colour ramp: from floor to 1, by its share of the greatest; null for none."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), count / F.greatest(most, F.lit(1))))
    return F.when(count > 0, floor + (1 - floor) * share)


def place_in(seed, length: float, margin: float = 180.0) -> Column:
    """A coordinate from 0 to 1 within a side of that length, less the margins."""
    return margin + seed * (length - 2 * margin)


def box_radius(width, height, room: float = 22.0) -> Column:
    """The radius that holds a box and its title."""
    return 0.5 * F.hypot(width, height) + room
