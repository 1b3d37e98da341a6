"""Scale words: thousand, lakh, crore, million and their kin."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import SCALE, escape, found, lookup

#: Word and power of ten.
SCALE_WORDS = {
    "thousand crore": 10,
    "lakh crore": 12,
    "thousand": 3,
    "lakhs": 5,
    "lakh": 5,
    "lacs": 5,
    "lac": 5,
    "crores": 7,
    "crore": 7,
    "cr": 7,
    "millions": 6,
    "million": 6,
    "mn": 6,
    "mln": 6,
    "billions": 9,
    "billion": 9,
    "bn": 9,
    "trillion": 12,
    "tn": 12,
    "units": 0,
    "absolute": 0,
}
_MULTIPLIERS = {w: str(10**p) for w, p in SCALE_WORDS.items()}
_WORD = r"(?iU)\b(" + "|".join(escape(w) for w in sorted(SCALE_WORDS, key=len, reverse=True)) + r")\b"

#: Fixed value: the captions above a table, such as "(Rs. in millions)" or "figures in ' 000".
_CAPTION = (
    r"(?i)(?:\(|\b)(?:all\s+)?(?:amounts?|figures?|numbers?|values?|₹|rs\.?|inr|usd|\$)?\s*(?:in|are\s+in)\s+"
    r"(?:₹\s*|rs\.?\s*|inr\s*|usd\s*|\$\s*)?(thousand|lakhs?|lacs?|crores?|millions?|billions?|mn|bn|cr|'?\s?000)"
)


def parse_scale(text: Column) -> Column:
    """Multiplier of the first scale word, or null."""
    return lookup(F.lower(found(text, _WORD, 1)), _MULTIPLIERS, SCALE)


def scale_from_header(text: Column) -> Column:
    """Multiplier that a caption states, or null."""
    word = F.regexp_replace(F.lower(found(text, _CAPTION, 1)), "[' ]", "")
    plain = F.coalesce(lookup(word, _MULTIPLIERS, SCALE), lookup(F.regexp_replace(word, "s+$", ""), _MULTIPLIERS, SCALE))
    return F.when(word == "000", F.lit(1000).cast(SCALE)).otherwise(plain)
