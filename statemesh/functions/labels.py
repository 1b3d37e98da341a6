"""Names of subjects and predicates: keys, referring expressions, validity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import first_of, found, has, strip

#: Suffixes of corporations, left out of an entity's key.
SUFFIXES = [
    "limited",
    "ltd",
    "private",
    "pvt",
    "public",
    "plc",
    "incorporated",
    "inc",
    "corporation",
    "corp",
    "company",
    "co",
    "llp",
    "llc",
    "gmbh",
    "sa",
    "nv",
]
#: Expressions that refer to an entity without naming it.
REFERRING = [
    "the company",
    "the group",
    "the issuer",
    "the bank",
    "we",
    "us",
    "our company",
    "it",
    "the corporation",
    "the firm",
    "the entity",
]
#: The same for subjects of prose.
REFERRING_IN_PROSE = [
    "we",
    "us",
    "our",
    "the company",
    "our company",
    "the company's",
    "the group",
    "our group",
    "the parent",
    "the issuer",
    "the bank",
    "the corporation",
    "it",
    "they",
    "the organisation",
    "the organization",
]
#: Predicates that are no properties.
BOILERPLATE = (
    r"(?iU)\b(give a true and fair|in accordance with|conducted in|responsibility for|basis for|we believe|referred to in|in our opinion)\b"
)
LEADING_VERB = (
    r"(?iU)^(is|are|was|were|be|been|has|have|had|does|do|did|will|would|shall|should|may|might|can|could|"
    r"gives?|give|includes?|include|represents?|comprises?)\b"
)
TRAILING_WORDS = [" in", " of", " to", " at", " on", " with", " the", " and"]
#: Answers that stand for nothing.
NOTHING = ["", "null", "none", "n/a", "unknown", "-"]


def normalise_label(text: Column, strip_suffixes: bool = False) -> Column:
    """Lower case, punctuation to blanks, corporate suffixes left out if asked, single blanks."""
    s = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w\s]", " ")
    if strip_suffixes:
        s = F.regexp_replace(s, rf"(?iU)\b(?:{'|'.join(SUFFIXES)})\b\.?", " ")
    return strip(F.regexp_replace(s, r"(?U)\s+", " "))


def is_referring(text: Column) -> Column:
    return F.lower(strip(text)).isin(REFERRING)


def resolve_subject(subject: Column, entity: Column) -> Column:
    """The document's entity where the subject only refers to it."""
    plain = F.regexp_replace(F.lower(strip(subject)), "[.,;:]+$", "")
    refers = plain.isin(REFERRING_IN_PROSE) & F.coalesce(entity != "", F.lit(False))
    return F.when(refers, entity).otherwise(subject)


def names_something(predicate: Column) -> Column:
    """A numeric predicate has two letters in a row."""
    return has(predicate, "[A-Za-z]{2}")


def words(text: Column) -> Column:
    """Number of words."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def is_a_property(predicate: Column, value: Column) -> Column:
    """Reads as (property, value) rather than as a sentence cut in half."""
    p = strip(predicate)
    tail = F.lit(False)
    for word in TRAILING_WORDS:
        tail = tail | p.endswith(word)
    return words(p).between(1, 5) & (words(value) <= 12) & ~has(p, BOILERPLATE) & ~has(p, LEADING_VERB) & ~tail


def cleaned(text: Column) -> Column:
    """text, or null where it stands for nothing."""
    t = strip(text)
    return F.when(~F.lower(t).isin(NOTHING), t)


def coerced(text: Column, allowed: list[str], default: str) -> Column:
    """The allowed value in lower case, else the default."""
    low = F.lower(strip(text))
    return F.when(low.isin(allowed), low).otherwise(F.lit(default))


def accounting_standard(text: Column) -> Column:
    """IND_AS, IFRS or US_GAAP by what the text contains; else unknown."""
    up = F.replace(F.upper(F.coalesce(cleaned(text), F.lit(""))), F.lit(" "), F.lit(""))
    names = {"IND": "IND_AS", "IFRS": "IFRS", "GAAP": "US_GAAP"}
    return first_of([(up.contains(k), F.lit(v)) for k, v in names.items()], F.lit("unknown"))


def basis_from_label(text: Column) -> Column:
    """consolidated or standalone by the first such word, else null."""
    word = F.lower(found(text, r"(?iU)\b(consolidated|standalone|stand-alone)\b", 1))
    return F.when(word.startswith("stand"), F.lit("standalone")).when(word.isNotNull(), F.lit("consolidated"))


#: Fixed value: how a document defines its own subject.
SELF_DEFINITION = (
    r"([A-Z][A-Za-z0-9&.\-]*(?:\s+[A-Z][A-Za-z0-9&.\-]*){0,5}?\s+(?:Limited|Ltd\.?|Inc\.?|Corporation|Corp\.?|PLC|LLP))"
    r"\s*[(\[]\s*[‘’“”'\"]*\s*(?:the\s+)?(?:Company|Issuer|Bank|Group|Corporation)\b"
)


def entity_from_self_definition(text: Column) -> Column:
    """The name in "Acme Limited (the Company)", or null."""
    return strip(found(text, SELF_DEFINITION, 1))


def entity_fallback(head: Column, title: Column, filename: Column) -> Column:
    """A document's entity: its self-definition, else a usable title, else its file name without number and dashes."""
    t = strip(title)
    usable = (F.length(t) > 3) & (F.length(t) < 60) & ~F.lower(t).rlike(r"\.(pdf|docx)$")
    stem = F.regexp_replace(F.regexp_replace(filename, r"\.[^.]*$", ""), r"^\d+[-_ ]+", "")
    name = F.initcap(F.substr(strip(F.regexp_replace(stem, "[-_]+", " ")), F.lit(1), F.lit(80)))
    return F.coalesce(F.substr(entity_from_self_definition(head), F.lit(1), F.lit(80)), F.when(usable, t), F.nullif(name, F.lit("")))
