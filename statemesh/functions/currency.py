"""Currency symbols and words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import escape, first_of, found, lookup

#: Fixed values, in the order in which symbols are looked for.
SYMBOLS = {"₹": "INR", "रु": "INR", "$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY"}
#: Fixed values.
WORDS = {
    "inr": "INR",
    "rs": "INR",
    "rs.": "INR",
    "rupees": "INR",
    "rupee": "INR",
    "usd": "USD",
    "us$": "USD",
    "dollars": "USD",
    "dollar": "USD",
    "eur": "EUR",
    "euro": "EUR",
    "euros": "EUR",
    "gbp": "GBP",
    "sterling": "GBP",
    "jpy": "JPY",
    "yen": "JPY",
}
_WORD = r"(?i)(?<![A-Za-z])(" + "|".join(escape(w) for w in sorted(WORDS, key=len, reverse=True)) + r")(?![A-Za-z])"


def detect_currency(text: Column) -> Column:
    """Code of the first symbol in the table's order that occurs, else of the first currency word, else null."""
    by_symbol = first_of([(text.contains(s), F.lit(code)) for s, code in SYMBOLS.items()])
    return F.coalesce(by_symbol, lookup(F.lower(found(text, _WORD, 1)), WORDS))
