"""Period expressions and what can be said about them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import all_of, any_of, first_of, found, has, let, lookup, strip

#: Names of months.
MONTHS = {
    "jan": 1,
    "january": 1,
    "feb": 2,
    "february": 2,
    "mar": 3,
    "march": 3,
    "apr": 4,
    "april": 4,
    "may": 5,
    "jun": 6,
    "june": 6,
    "jul": 7,
    "july": 7,
    "aug": 8,
    "august": 8,
    "sep": 9,
    "sept": 9,
    "september": 9,
    "oct": 10,
    "october": 10,
    "nov": 11,
    "november": 11,
    "dec": 12,
    "december": 12,
}
#: How many months a word counts.
COUNTS = {"three": 3, "six": 6, "nine": 9, "twelve": 12, "3": 3, "6": 6, "9": 9, "12": 12}
_MONTH = "|".join(sorted(MONTHS, key=len, reverse=True))
_FLAGS = "(?iU)"
#: One glued character is let pass, a real word is not.
_GLUE = r"(?<![A-Za-z]{2})"
_DAY_MONTH = rf"(?:(\d{{1,2}})\s+({_MONTH})|({_MONTH})\s+(\d{{1,2}}))[,\s]+(\d{{4}})"

#: The eleven forms of a period, in the order in which they are tried.
PATTERNS = {
    "q_fy": rf"{_GLUE}Q([1-4])\s*[-/ ]?\s*FY\s*[-']?\s*(\d{{2,4}})\b",
    "nm_fy": rf"{_GLUE}(3|6|9|12)\s*M\s*[-/ ]?\s*FY\s*[-']?\s*(\d{{2,4}})\b",
    "h_fy": rf"{_GLUE}H([12])\s*[-/ ]?\s*FY\s*[-']?\s*(\d{{2,4}})\b",
    "h_cy": rf"{_GLUE}H([12])\s*[-/ ]?\s*CY\s*[-']?\s*(\d{{2,4}})\b",
    "n_months": rf"\b(three|six|nine|twelve|3|6|9|12)\s+months?\s+ende[dr]\s+{_DAY_MONTH}",
    "year_ended": rf"\b(?:for\s+the\s+)?(?:financial\s+|fiscal\s+)?(?:year|FY|period)\s+ende[dr]\s+{_DAY_MONTH}",
    "as_at": (
        rf"\bas\s+(?:at|on|of)\s+(?:(\d{{1,2}})\s+({_MONTH})[,\s]+(\d{{4}})|({_MONTH})\s+(\d{{1,2}})[,\s]+(\d{{4}})"
        r"|(\d{1,2})[./-](\d{1,2})[./-](\d{4}))"
    ),
    "cy_one": rf"{_GLUE}(?:CY|calendar\s+year)\s*[-']?\s*(\d{{2,4}})\b",
    "fy_span": r"\b(?:FY|fiscal)?\s*[-']?\s*(\d{4}|\d{2})\s*[-–—/]\s*(\d{2,4})\b",
    "fy_one": rf"{_GLUE}(?:FY|fiscal(?:\s+year)?)\s*[-']?\s*(\d{{2,4}})\b",
    "q_cy": r"\bQ([1-4])\s*[-/ ]?\s*(?:CY\s*)?(\d{4})\b",
}
#: What each form cannot do without, in lower case: any of these in every part. Less work than the patterns, which are tried
#: only where it is there. (Of letters only those that no others are equal to when case is passed over: not i, k and s.)
_NEEDS = {
    "q_fy": [["q"], ["fy"]],
    "nm_fy": [["m"], ["fy"]],
    "h_fy": [["h"], ["fy"]],
    "h_cy": [["h"], ["cy"]],
    "n_months": [["ende"]],
    "year_ended": [["ende"]],
    "as_at": [["a"]],
    "cy_one": [["cy", "calendar"]],
    "fy_span": [["-", "–", "—", "/"]],
    "fy_one": [["f"]],
    "q_cy": [["q"]],
}
#: Stands between the groups of a form: no form can have it in itself.
_BETWEEN = "\x01"
PERIOD = "struct<kind:string,label:string,start:date,end:date,convention:string>"
FISCAL, CALENDAR, UNKNOWN = "IN_APR_MAR", "CALENDAR", "unknown"


def expand_year(year: Column) -> Column:
    """Two digits are of this century."""
    return let(year, lambda y: F.when(y < 100, y + 2000).otherwise(y))


def unknown_period() -> Column:
    return period("unknown", F.lit(None), F.lit(None), F.lit(None), UNKNOWN)


def period(kind: str, label: Column, start: Column, end: Column, convention: Column | str) -> Column:
    convention = convention if isinstance(convention, Column) else F.lit(convention)
    return F.struct(
        F.lit(kind).alias("kind"),
        label.cast("string").alias("label"),
        start.cast("date").alias("start"),
        end.cast("date").alias("end"),
        convention.alias("convention"),
    )


#: Every form in one pattern: where it has no match, parse_period finds no period.
ANY_FORM = "|".join(f"(?:{p})" for p in PATTERNS.values())


def names_period(text: Column) -> Column:
    """Whether some form of a period occurs in the text; much less work than parse_period. (A form can still name a day that
    does not exist.)"""
    return has(text, _FLAGS + ANY_FORM)


#: Forms with a day, which need not exist.
_WITH_DAY = "|".join(f"(?:{PATTERNS[n]})" for n in ("n_months", "year_ended", "as_at"))


def has_period(text: Column) -> Column:
    """Whether parse_period finds a period. Only days that may not exist, and the year 0, have to be parsed for that."""
    plain = names_period(text) & ~has(text, _FLAGS + _WITH_DAY) & ~text.contains("0000")
    return plain | (names_period(text) & (parse_period(text)["kind"] != "unknown"))


#: What a form says before dates are made of it: months from the year 0 on and how many, or a day and how many months it ends.
_SAID = {"label": "string", "convention": "string", "since": "int", "count": "int", "y": "int", "m": "int", "d": "int"}


def _said(**fields: Column | str | int) -> Column:
    known = {k: v if isinstance(v, Column) else F.lit(v) for k, v in fields.items()}
    return F.struct(*((known.get(k, F.lit(None))).cast(kind).alias(k) for k, kind in _SAID.items()))


def _day(y: Column, m: Column, d: Column) -> Column:
    """The date, or null where there is no such day."""
    first = F.when(y.between(1, 9999) & m.between(1, 12), F.make_date(y, m, F.lit(1)))
    return let(first, lambda f: F.when(d.between(1, F.dayofmonth(F.last_day(f))), F.date_add(f, d - 1)))


def _dates(x: Column) -> Column:
    """PERIOD of what a form says."""

    def months(since: Column) -> Column:
        year = F.floor(since / 12).cast("int")
        start = F.when(year.between(1, 9999), F.make_date(year, since % 12 + 1, F.lit(1)))
        return let(start, lambda s: period("interval", x["label"], s, F.last_day(F.add_months(s, x["count"] - 1)), x["convention"]))

    def ended(day: Column) -> Column:
        by_month = period("interval", x["label"], F.add_months(F.trunc(day, "MM"), 1 - x["count"]), day, x["convention"])
        by_year = period("interval", x["label"], F.date_add(F.add_months(day, -12), 1), day, x["convention"])
        return F.when(x["count"] == 0, period("instant", x["label"], day, day, x["convention"])).when(x["count"] < 0, by_year).otherwise(by_month)

    return F.when(x["since"].isNotNull(), months(x["since"])).otherwise(let(_day(x["y"], x["m"], x["d"]), ended))


def parse_period(text: Column) -> Column:
    """PERIOD of the first form that occurs in the text, its leftmost place; kind 'unknown' where none does.

    A day that does not exist gives an unknown period. The form is chosen first; only its own groups are then taken out, each
    once, as numbers, and dates are made of those.
    """

    def parsed(x: Column) -> Column:
        t, low = x["t"], x["low"]

        def occurs(name: str) -> Column:
            return all_of([any_of([low.contains(w) for w in words]) for words in _NEEDS[name]] + [has(t, _FLAGS + PATTERNS[name])])

        def read(name: str, value) -> tuple[Column, Column]:
            """(whether the form occurs, value(g, n)): its groups are taken out in one go. g(i) is empty where the group took no part;
            n(i, j, ...) is the number in that one of the groups that took part."""
            n_groups = re.compile(PATTERNS[name]).groups
            shown = _BETWEEN.join(f"${i}" for i in range(1, n_groups + 2))
            groups = F.split(F.regexp_replace(t, rf"(?iUs)^.*?({PATTERNS[name]}).*\z", shown), _BETWEEN)

            def of(found_groups: Column) -> Column:
                g = lambda i: F.get(found_groups, i)
                # a cast that fails is dear, and groups that took no part are many
                number = lambda *i: let(F.concat(*map(g, i)), lambda v: F.when(v != "", v.try_cast("int")))
                return value(g, number)

            return occurs(name), let(groups, of)

        def month(word: Column) -> Column:
            return lookup(F.lower(word), MONTHS, "int")

        def fiscal(g, year: Column, first: Column | int, count: Column | int) -> Column:
            """Months from April of the year before on."""
            return _said(label=strip(g(0)), convention=FISCAL, since=(year - 1) * 12 + 3 + first, count=count)

        def calendar(g, year: Column, first: Column | int, count: Column | int) -> Column:
            return _said(label=strip(g(0)), convention=CALENDAR, since=year * 12 + first, count=count)

        def dated(g, n, first: int, count: Column | int, convention) -> Column:
            """The day-month or month-day form whose groups begin at first."""
            at = month(F.concat(g(first + 1), g(first + 2)))
            day = n(first, first + 3)
            return let(at, lambda m: _said(label=strip(g(0)), convention=convention(m), count=count, y=n(first + 4), m=m, d=day))

        def as_at(g, n) -> Column:
            day = n(1, 5, 7)
            at = F.coalesce(month(F.concat(g(2), g(4))), n(8))
            parts = F.struct(n(3, 6, 9).alias("y"), at.alias("m"), day.alias("d"))
            convention = lambda x: F.when((x["m"] == 3) & (x["d"] == 31), F.lit(FISCAL)).otherwise(F.lit(UNKNOWN))
            return let(parts, lambda x: _said(label=strip(g(0)), convention=convention(x), count=0, y=x["y"], m=x["m"], d=x["d"]))

        def span_year(a: Column, b: Column) -> Column:
            joined = (F.length(a) == 4) & (F.length(b) == 2)
            return F.when(joined, F.concat(F.substr(a, F.lit(1), F.lit(2)), b).try_cast("int")).otherwise(expand_year(b.try_cast("int")))

        march = lambda m: F.when(m == 3, F.lit(FISCAL)).otherwise(F.lit(UNKNOWN))
        year_end = lambda m: first_of([(m == 3, F.lit(FISCAL)), (m == 12, F.lit(CALENDAR))], F.lit(UNKNOWN))
        forms = [
            read("q_fy", lambda g, n: fiscal(g, expand_year(n(2)), (n(1) - 1) * 3, 3)),
            read("nm_fy", lambda g, n: fiscal(g, expand_year(n(2)), 0, n(1))),
            read("h_fy", lambda g, n: fiscal(g, expand_year(n(2)), (n(1) - 1) * 6, 6)),
            read("h_cy", lambda g, n: calendar(g, expand_year(n(2)), (n(1) - 1) * 6, 6)),
            read("n_months", lambda g, n: dated(g, n, 2, lookup(F.lower(g(1)), COUNTS, "int"), march)),
            read("year_ended", lambda g, n: dated(g, n, 1, -1, year_end)),
            read("as_at", as_at),
            read("cy_one", lambda g, n: calendar(g, expand_year(n(1)), 0, 12)),
            read("fy_span", lambda g, n: fiscal(g, span_year(g(1), g(2)), 0, 12)),
            read("fy_one", lambda g, n: fiscal(g, expand_year(n(1)), 0, 12)),
            read("q_cy", lambda g, n: calendar(g, n(2), (n(1) - 1) * 3, 3)),
        ]
        got = let(first_of(forms), _dates)
        return let(got, lambda p: F.when(p["start"].isNotNull(), p).otherwise(unknown_period()))

    # every form but the as-at date names its period by letters or spans years; a text without a digit has none
    return F.when(has(text, r"(?U)\d"), let(strip(text), lambda t: let(F.struct(t.alias("t"), F.lower(t).alias("low")), parsed))).otherwise(unknown_period())


def overlaps(a: Column, b: Column) -> Column:
    """Closed intervals meet; false where a bound is missing."""
    return F.coalesce((a["start"] <= b["end"]) & (b["start"] <= a["end"]), F.lit(False))


def same_period(a: Column, b: Column) -> Column:
    """Both known and equal."""
    return F.coalesce((a["start"] == b["start"]) & (a["end"] == b["end"]), F.lit(False))


def period_is_possible(end: Column, published: Column) -> Column:
    """A document cannot report on what lies after it; unknown dates are let pass."""
    return F.coalesce(end <= published, F.lit(True))


def enforce_plausibility(scope: Column) -> Column:
    """scope without the dates of an impossible period; label, kind and convention stay."""
    possible = period_is_possible(scope["period"]["end"], scope["vintage"])
    none = F.lit(None).cast("date")
    cleared = scope.withField("period.start", none).withField("period.end", none)
    return F.when(possible, scope).otherwise(cleared)


def iso_date(text: Column) -> Column:
    """The date in the first ten characters, or null."""
    return F.try_to_date(F.substr(text, F.lit(1), F.lit(10)), "yyyy-MM-dd")


def duration_seconds(text: Column) -> Column:
    """Seconds of "7.66s", "1m2.5s" or "120ms"; 0 for milliseconds that are no number."""
    t = strip(text)
    minutes = F.coalesce(found(t, r"([0-9.]+)m", 1).try_cast("double"), F.lit(0.0)) * 60
    seconds = F.coalesce(found(t, r"([0-9.]+)s?$", 1).try_cast("double"), F.lit(0.0))
    milli = F.coalesce(found(t, r"^([0-9.]+)ms$", 1).try_cast("double"), F.lit(0.0)) / 1000
    return F.when(t.endswith("ms"), milli).otherwise(minutes + seconds)
