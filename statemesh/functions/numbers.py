"""Numerals, ranges, ratios and typed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import CANONICAL, FACTOR, RAW, first_of, found, has, let, strip
from .currency import detect_currency
from .scale import parse_scale

#: Tokens that state a nil amount.
NIL = ["nil", "n.i.l", "none", "—", "–", "-", "‐", "0", "0.0", "na", "n.a.", "n/a", "not applicable", "not available"]
#: Patterns of numerals, ranges and ratios.
NUMBER = r"(?U)\d+(?:,\d{2,3})*(?:\.\d+)?|\.\d+"
_N = r"(?:\d+(?:,\d{2,3})*(?:\.\d+)?|\.\d+)"
RANGE = rf"(?iU)(?:between\s+)?({_N})\s*(?:to|and|–|—|-|~)\s*({_N})"
PERCENT = r"(?iU)%|\bper\s*cent(?:age)?\b|\bpercent\b"
BPS = r"(?iU)\bbps\b|\bbasis\s+points?\b"
MULTIPLE = r"(?iU)(?<=\d)\s*x\b"
_PARENTHESES = r"(?U)\(\s*([^()]*\d[^()]*)\s*\)"
_TRAILING_MINUS = r"(?U)\d\s*-\s*$"
_LEADING_MINUS = r"(?U)(?<![\w.])-\s*\d"
#: A numeral and nothing else, as most are: what it means is read off without looking for signs, words or ranges.
_PLAIN = r"^[0-9]+(?:,[0-9]{2,3})*(?:\.[0-9]+)?\z"
_GROUPED = "(?U)\\d[,\u2009\u00a0]\\d\\d\\d"
#: Units in the order in which they are looked for.
UNIT_WORDS = [
    ("tonne", "t"),
    ("tonnes", "t"),
    ("kg", "kg"),
    ("km", "km"),
    ("sq ft", "sqft"),
    ("square feet", "sqft"),
    ("sq. ft", "sqft"),
    ("employees", "count"),
    ("shipments", "count"),
    ("parcels", "count"),
    ("customers", "count"),
    ("shares", "count"),
    ("people", "count"),
]
VALUE = (
    "struct<kind:string,raw:string,canonical_magnitude:decimal(38,10),currency:string,unit:string,ratio_basis:string,"
    "date_value:date,text_value:string,bool_value:boolean,range_low:decimal(38,10),range_high:decimal(38,10)>"
)


def _decimal(numeral: Column) -> Column:
    return F.replace(numeral, F.lit(","), F.lit("")).try_cast(RAW)


def parse_number(text: Column) -> Column:
    """The first number, signed; nil words are 0; null where there is none. Blanks within a numeral are dropped."""

    def signed(x: Column) -> Column:
        inner = F.nullif(x["inner"], F.lit(""))
        negative = inner.isNotNull() | has(x["s"], _TRAILING_MINUS) | has(x["s"], _LEADING_MINUS)
        value = _decimal(F.regexp_extract(F.replace(F.coalesce(inner, x["s"]), F.lit(" "), F.lit("")), NUMBER, 0))
        return let(value, lambda v: F.when(negative, -v).otherwise(v).cast(RAW))

    def read(s: Column) -> Column:
        zero = F.lit(0).cast(RAW)
        return F.when(F.lower(s).isin(NIL), zero).otherwise(let(F.struct(s.alias("s"), F.regexp_extract(s, _PARENTHESES, 1).alias("inner")), signed))

    return F.when(has(text, _PLAIN), _decimal(text)).otherwise(let(strip(text), read))


def parse_range(text: Column) -> Column:
    """struct(low, high) of "A to B" and its like, or null; pairs more than tenfold apart are no ranges."""

    def ordered(x: Column) -> Column:
        low, high = F.least(x["a"], x["b"]), F.greatest(x["a"], x["b"])
        wide = (low != 0) & (high != 0) & (F.try_divide(high, low) > 10)
        return F.when(x["a"].isNotNull() & x["b"].isNotNull() & ~wide, F.struct(low.alias("low"), high.alias("high")))

    ends = F.struct(_decimal(found(text, RANGE, 1)).alias("a"), _decimal(found(text, RANGE, 2)).alias("b"))
    return let(ends, ordered)


def classify_ratio(text: Column) -> Column:
    """bps, percent, multiple or null, tried in this order."""
    return first_of([(has(text, BPS), F.lit("bps")), (has(text, PERCENT), F.lit("percent")), (has(text, MULTIPLE), F.lit("multiple"))])


def to_canonical_ratio(magnitude: Column, basis: Column) -> Column:
    """The plain fraction that a percentage, basis points or a multiple stands for."""
    wide = magnitude.cast(RAW)
    scaled = lambda f: (wide * F.lit(f).cast(FACTOR)).cast(CANONICAL)
    return first_of([(basis == "percent", scaled("0.01")), (basis == "bps", scaled("0.0001"))], wide.cast(CANONICAL))


def unit_hint(text: Column) -> Column:
    """Unit of the first of the table's words that the text contains, or null."""
    low = F.lower(text)
    return first_of([(low.contains(word), F.lit(unit)) for word, unit in UNIT_WORDS])


def counts_what_follows(raw: Column, context: Column) -> Column:
    """The unit within 40 characters after the first occurrence of raw in context, or null."""
    at = F.instr(context, raw)
    return F.when(at > 0, unit_hint(F.substr(context, at + F.length(raw), F.lit(40))))


def significant_digits(raw: Column) -> Column:
    """Digits as written, without leading zeros; at least 1."""
    return F.greatest(F.length(F.regexp_replace(F.regexp_replace(raw, r"(?U)\D", ""), "^0+", "")), F.lit(1))


def value_bucket(kind: Column, magnitude: Column, digits: int = 3) -> Column:
    """Kind and magnitude to three significant digits (half to even), or null for none and zero.

    On the digits as text: a rounding to a varying place is then exact for any decimal.
    """

    def rounded(x: Column) -> Column:
        head = F.rpad(F.substr(x["d"], F.lit(1), F.lit(digits)), digits, "0").cast("int")
        tail = F.regexp_replace(F.substr(x["d"], F.lit(digits + 1)), "0+$", "")
        up = (tail > "5") | ((tail == "5") & (head % 2 == 1))
        value = head + up.cast("int")
        over = value == 10**digits
        exponent = x["e"] - digits + 1 + over.cast("int")
        shown = F.when(over, F.lit(10 ** (digits - 1))).otherwise(value)
        return F.concat_ws(":", kind, (shown * F.signum(magnitude).cast("int")).cast("string"), exponent.cast("string"))

    text = F.abs(magnitude).cast("decimal(38,10)").cast("string")
    plain = F.regexp_replace(F.replace(text, F.lit("."), F.lit("")), "^0+", "")
    return F.when(magnitude.isNotNull() & (magnitude != 0), let(F.struct(plain.alias("d"), adjusted(magnitude).alias("e")), rounded))


def adjusted(magnitude: Column) -> Column:
    """Exponent of the leading digit of a decimal that is not zero."""
    text = F.abs(magnitude).cast("decimal(38,10)").cast("string")
    whole = F.length(F.regexp_extract(text, r"^0*(\d*)\.?", 1))
    zeros = F.length(F.regexp_extract(text, r"^0*\.(0*)", 1))
    return F.when(whole > 0, whole - 1).otherwise(-zeros - 1)


def rounding_tolerance(magnitude: Column, raw: Column) -> Column:
    """One unit in the last place that was written; 0 for zero."""
    exponent = adjusted(magnitude) - significant_digits(raw) + 1
    unit = F.concat(F.lit("1e"), exponent.cast("string")).try_cast(CANONICAL)
    return F.when(magnitude == 0, F.lit(0).cast(CANONICAL)).otherwise(unit)


def _typed(kind: Column | str, raw: Column, magnitude: Column, **fields: Column) -> Column:
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    text = lambda n: fields.get(n, F.lit(None)).cast("string").alias(n)
    number = lambda n: fields.get(n, F.lit(None)).cast(CANONICAL).alias(n)
    return F.struct(
        kind.alias("kind"),
        raw.alias("raw"),
        magnitude.cast(CANONICAL).alias("canonical_magnitude"),
        text("currency"),
        text("unit"),
        text("ratio_basis"),
        fields.get("date_value", F.lit(None)).cast("date").alias("date_value"),
        text("text_value"),
        fields.get("bool_value", F.lit(None)).cast("boolean").alias("bool_value"),
        number("range_low"),
        number("range_high"),
    )


def parse_value(raw: Column, context: Column | None = None, inherited: Column | None = None) -> Column:
    """A typed value with its unit, scale and currency (VALUE), or null where there is no number.

    context stands next to the number; inherited is what its page or document says about itself. A count keeps to what
    is adjacent, and an inherited ratio only holds where the adjacent text names neither currency nor scale.
    """
    text = strip(raw)
    adjacent = F.coalesce(context, F.lit("")) if context is not None else F.lit("")
    above = F.coalesce(inherited, F.lit("")) if inherited is not None else F.lit("")
    both = F.when(above == "", adjacent).when(adjacent == "", above).otherwise(F.concat(adjacent, F.lit(" "), above))
    given = F.struct(text.alias("raw"), adjacent.alias("near"), above.alias("above"), both.alias("ctx"))

    def signs(x: Column) -> Column:
        grouped = has(x["raw"], _GROUPED)
        silent = detect_currency(x["near"]).isNull() & parse_scale(x["near"]).isNull()
        basis = F.coalesce(
            classify_ratio(x["raw"]),
            F.when(~grouped, classify_ratio(x["near"])),
            F.when(~grouped & (x["above"] != "") & silent, classify_ratio(x["above"])),
        )
        counted = F.coalesce(unit_hint(x["raw"]), counts_what_follows(x["raw"], x["ctx"]))
        kept_to = F.coalesce(counted == "count", F.lit(False)) & (x["above"] != "") & detect_currency(x["raw"]).isNull()
        reach = F.when(kept_to, x["near"]).otherwise(x["ctx"])
        return let(
            F.struct(x["raw"].alias("raw"), x["ctx"].alias("ctx"), basis.alias("basis"), reach.alias("reach")), typed
        )

    def typed(x: Column) -> Column:
        scale = F.coalesce(parse_scale(x["raw"]), parse_scale(x["reach"]), F.lit(1).cast("decimal(13,0)"))
        currency = F.coalesce(detect_currency(x["raw"]), detect_currency(x["reach"]))
        parts = F.struct(
            x["raw"].alias("raw"),
            x["ctx"].alias("ctx"),
            x["basis"].alias("basis"),
            scale.alias("scale"),
            currency.alias("currency"),
            parse_number(x["raw"]).alias("number"),
            parse_range(x["raw"]).alias("range"),
        )
        return let(parts, built)

    def built(x: Column) -> Column:
        low, high = x["range"]["low"], x["range"]["high"]
        ratio = lambda v: to_canonical_ratio(v, x["basis"])
        exact = ratio(x["number"])
        outside = x["range"].isNotNull() & F.coalesce(~exact.between(ratio(low), ratio(high)), F.lit(True))
        middle = ((ratio(low).cast("decimal(28,10)") + ratio(high).cast("decimal(28,10)")) / 2).cast(CANONICAL)
        as_ratio = _typed(
            "ratio", x["raw"], F.when(outside, middle).otherwise(exact), ratio_basis=x["basis"], range_low=ratio(low), range_high=ratio(high)
        )
        scaled = lambda v: (v * x["scale"]).try_cast(CANONICAL)
        unit = F.when(x["currency"].isNull(), unit_hint(F.concat_ws(" ", x["raw"], x["ctx"])))
        kind = F.when(x["currency"].isNotNull(), F.lit("money")).otherwise(F.lit("quantity"))
        amount = _typed(
            kind, x["raw"], scaled(x["number"]), currency=x["currency"], unit=unit, range_low=scaled(low), range_high=scaled(high)
        )
        something = x["number"].isNotNull() | x["range"].isNotNull()
        return F.when(x["basis"].isNotNull() & something, as_ratio).when(x["number"].isNotNull(), amount)

    found_in_text = F.when(text != "", let(given, signs))
    # a plain numeral names neither ratio nor unit, scale or currency, and is no range: only what stands around it is looked at
    basis, reach = classify_ratio(adjacent), adjacent
    if inherited is not None:
        silent = detect_currency(adjacent).isNull() & parse_scale(adjacent).isNull()
        counted = F.coalesce(counts_what_follows(raw, both) == "count", F.lit(False))
        basis = F.coalesce(basis, F.when((above != "") & silent, classify_ratio(above)))
        reach = F.when((above != "") & ~counted, both).otherwise(adjacent)
    plain = F.struct(
        raw.alias("raw"),
        both.alias("ctx"),
        F.when(~has(raw, ",[0-9]{3}"), basis).alias("basis"),
        F.coalesce(parse_scale(reach), F.lit(1).cast("decimal(13,0)")).alias("scale"),
        detect_currency(reach).alias("currency"),
        _decimal(raw).alias("number"),
        F.lit(None).cast(f"struct<low:{RAW},high:{RAW}>").alias("range"),
    )
    return F.when(has(raw, _PLAIN), let(plain, built)).otherwise(found_in_text)


def text_value(raw: Column) -> Column:
    """A VALUE of kind text."""
    return _typed("text", raw, F.lit(None), text_value=raw)


def typed_value(kind: Column, raw: Column, date: Column) -> Column:
    """A VALUE of a stated kind (bool, date, entity or text) from text as it was written."""
    truth = F.lower(strip(raw)).isin("yes", "true", "active", "listed", "approved")
    return _typed(
        kind,
        raw,
        F.lit(None),
        date_value=F.when(kind == "date", date),
        text_value=F.when(kind != "bool", raw),
        bool_value=F.when(kind == "bool", truth),
    )
