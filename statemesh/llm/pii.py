"""Format-preserving Feistel pseudonyms for personal data, in DataFrame functions only.

Personal values are found by one pattern, validated by kind, and permuted within their own format by a keyed Feistel
network: the value is a list of symbols, each with its own alphabet; in each round one half is shifted, symbol by symbol,
by a keyed hash of the other half. This is a permutation of the format for any key, so different values get different
pseudonyms, equal values get equal ones in every document, and whoever has the key can turn them back.

Kinds: card numbers (13 to 19 digits, valid check digit before and after; first digit kept; a usual grouping is told from
digits beside it), IBANs (valid check digits before and after; country kept), social security numbers (area, group and serial
numbers stay in the valid ranges), phone numbers (country code kept; a North American area or exchange code goes on starting
with 2 to 9, and such a number has one pseudonym with and without its +1), IPv4 addresses, dates of 1900 to 2099 (year, day or
month first; a day has one pseudonym in all spellings, and a day up to the 12th, to the 28th or after it stays one, so that
the order of day and month can be read as before), e-mail addresses (the local part, classes of characters kept), and access
keys and passwords that are named as such. What does not validate is left as it is. Blanks and punctuation within a value stay.

Only rows with what a value can start from (a digit, an @, a key's AKIA, a secret's name followed by = or :) meet the long
pattern. Nothing leaves the row: the plan is a scan and a projection. The key has no default; it is a literal of the plan, so
plans and event logs are as secret as the key is.

Defined cases: null text stays null and empty text empty; rows repeat as they do; other columns are kept; a column
``n_private`` of the input is replaced; an empty table gives no rows. Every text is processed whole.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 10
DIGITS, UPPER, LOWER, HEX = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"

#: Patterns by kind, in the order in which they are tried at a place. Java matches repeated groups by recursion, so every one is
#: bounded: a domain has 127 labels at most.
EMAIL = r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){0,125}\.[A-Za-z]{2,}"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"(?<![0-9.])(?<!\b[vV]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?[0-9])"
DATE = r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
#: Card numbers as they are usually grouped. The first may have up to three more digits, so that it is looked for first.
_FOURS = "[0-9]{4}(?:[ -][0-9]{4}){3}"
_SIXES = "[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}"
GROUPINGS = (_FOURS + "[ -][0-9]{3}", _FOURS, _SIXES, "[0-9]{13,19}")
_USUAL = f"(?:{_FOURS}|{_SIXES}|[0-9]{{14,16}})(?![0-9])"
# A usual grouping with a few more digits on either side (after it so many that three other fours may come before a card), or digits in any grouping that do not run into a usual one.
_AROUND = rf"(?:[0-9](?:[ -]?[0-9]){{0,4}}[ -])??{_USUAL}(?:[ -](?!{_USUAL})[0-9](?:(?:[ -](?!{_USUAL}))?[0-9]){{0,11}}(?![0-9-])(?![./][0-9]))?"
_OPEN = f"[0-9](?:(?:[ -](?!{_USUAL}))?[0-9]){{12,18}}"
CARD = f"(?<![0-9.+-])(?:{_AROUND}|{_OPEN})(?![0-9-])"
_AMERICAN = r"(?<![0-9])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|(?<![0-9.-])(?:[0-9]{3}-[0-9]{3}-[0-9]{4}|[0-9]{3}\.[0-9]{3}\.[0-9]{4}(?!\.[0-9]))"
_LONG = r"(?<![A-Za-z0-9])(?=\+(?:[ .()-]{0,3}[0-9]){7})\+[1-9](?:[0-9]{7,14}|[0-9]{0,2}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?(?:[0-9]{6,12}|[0-9]{1,5}(?:[ .-][0-9]{2,8}){1,4}))(?![0-9])"
_SHORT = r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}"
PHONE = f"(?:{_LONG}|{_SHORT}|{_AMERICAN})(?![0-9])"
#: Country codes of numbers whose first digits are not set apart.
COUNTRY = r"^\+([0-9]{1,3}(?![0-9])|1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
_NAMES = "(?i:password|passwd|token|secret|api[_-]?key) {0,2}"
# A token after the word Bearer has a digit in it, which prose seldom has.
_BEARER = r"(?<=\b[Bb]earer {1,2})(?=[A-Za-z_-]{0,40}[0-9])[A-Za-z0-9_-]{16,64}(?![A-Za-z0-9_-])"
SECRET = rf"(?<![A-Z0-9])AKIA[A-Z0-9]{{16}}(?![A-Z0-9])|(?<={_NAMES}[=:] {{0,2}}\"?)[A-Za-z0-9_-]{{8,64}}|{_BEARER}"
ANY = "|".join([EMAIL, IPV4, DATE, SSN, IBAN, CARD, PHONE, SECRET])
#: No text without this has a match of ANY.
HINT = rf"[0-9@]|AKIA|[=:](?<={_NAMES}[=:])"

#: Setting that holds the key of the registered query and the pipeline.
KEY_SETTING = "spark.statemesh.pseudonymKey"
FIRST_YEAR, YEARS = 1900, 200
#: Days after the 28th of all months, as month * 100 + day, but for 29 February.
LATE_DAYS = [m * 100 + d for m in range(1, 13) for d in (29, 30, 31) if m != 2 and (d < 31 or m not in (4, 6, 9, 11))]


def _is(value: Column, pattern: str) -> Column:
    return value.rlike(f"^(?:{pattern})$")


def let(value: Column, body) -> Column:
    """body(value), with value computed once and named, so that expressions stay as long as they are written."""
    return F.get(F.transform(F.array(value), body), 0)


def permuted(values: Column, radices: Column, key: str | Column, backwards: bool = False) -> Column:
    """The keyed permutation of a list of numbers, value i below radix i (arrays of int)."""
    order = list(range(ROUNDS))[:: -1 if backwards else 1]

    def network(x: Column) -> Column:
        half = F.floor(F.size(x["v"]) / 2).cast("int")
        low = lambda c: F.slice(c, F.lit(1), half)
        high = lambda c: F.slice(c, half + 1, F.size(c) - half)
        start = F.struct(low(x["v"]).alias("a"), high(x["v"]).alias("b"))

        def run(fixed: Column) -> Column:
            def round_of(state: Column, i: Column) -> Column:
                even = i % 2 == 0
                other = F.when(even, state["b"]).otherwise(state["a"])
                seed = F.concat_ws("|", F.lit(key), i.cast("string"), fixed["shape"], F.array_join(other.cast("array<string>"), ","))

                def shifted(side: Column, radix: Column, stream: Column) -> Column:
                    def one(v: Column, j: Column) -> Column:
                        step = F.conv(F.substr(stream, j * 4 + 1, F.lit(4)), 16, 10).cast("int")
                        return F.pmod(v - step if backwards else v + step, F.get(radix, j)).cast("int")

                    return F.transform(side, one)

                def both(stream: Column) -> Column:
                    return F.struct(
                        F.when(even, shifted(state["a"], fixed["a"], stream)).otherwise(state["a"]).alias("a"),
                        F.when(even, state["b"]).otherwise(shifted(state["b"], fixed["b"], stream)).alias("b"),
                    )

                return let(F.sha2(seed, 512), both)

            return F.aggregate(F.array(*map(F.lit, order)), start, round_of, lambda s: F.concat(s["a"], s["b"]))

        shape = F.array_join(x["r"].cast("array<string>"), ",")
        return let(F.struct(low(x["r"]).alias("a"), high(x["r"]).alias("b"), shape.alias("shape")), run)

    return let(F.struct(values.alias("v"), radices.alias("r")), network)


def _letters(value: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(value), F.lit(1))), lambda i: F.substr(value, i, F.lit(1)))


def _permuted_text(value: Column, alphabet, key: str | Column, backwards: bool) -> Column:
    """value with each character replaced within alphabet(character, its place from 0); an alphabet of one keeps it."""

    def shift(x: Column) -> Column:
        values = F.zip_with(x["alphabets"], x["letters"], lambda a, c: F.instr(a, c) - 1)
        new = permuted(values, F.transform(x["alphabets"], lambda a: F.length(a)), key, backwards)
        return F.array_join(F.zip_with(x["alphabets"], new, lambda a, v: F.substr(a, v + 1, F.lit(1))), "")

    return let(_letters(value), lambda c: let(F.struct(c.alias("letters"), F.transform(c, alphabet).alias("alphabets")), shift))


def _own_class(c: Column, _i: Column | None = None) -> Column:
    return (
        F.when(c.rlike("[0-9]"), F.lit(DIGITS)).when(c.rlike("[A-Z]"), F.lit(UPPER)).when(c.rlike("[a-z]"), F.lit(LOWER)).otherwise(c)
    )


def _bare(value: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(value, "[^A-Za-z0-9]", "")


def _refilled(value: Column, new: Column) -> Column:
    """value's punctuation with the letters and digits of new."""

    def one(i: Column) -> Column:
        c = F.substr(value, i, F.lit(1))
        place = F.length(_bare(F.substr(value, F.lit(1), i)))
        return F.when(c.rlike("[A-Za-z0-9]"), F.substr(new, place, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), one), "")


def _luhn(digits: Column) -> Column:
    """Sum of the check rule: doubled from the right, every second digit from the last but one."""
    n = F.length(digits)

    def weight(c: Column, i: Column) -> Column:
        v = c.cast("int")
        twice = v * 2
        return F.when((n - i) % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(v)

    return F.aggregate(F.transform(_letters(digits), weight), F.lit(0), lambda s, v: s + v)


def _mod97(text: Column) -> Column:
    """Remainder of an IBAN's digits (letters count from 10)."""

    def step(s: Column, c: Column) -> Column:
        v = F.instr(F.lit(DIGITS + UPPER), c) - 1
        return (F.when(v > 9, s * 100 + v).otherwise(s * 10 + v) % 97).cast("int")

    return F.aggregate(_letters(text), F.lit(0), step)


def _card(m: Column, key: str, backwards: bool) -> tuple[Column, Column]:
    """The first part of the match that is a valid number: in a usual grouping, else all of it."""

    def chosen(text: Column) -> Column:
        """(at, old): the valid part and its place from 1; null if there is none."""
        even = F.translate(F.concat(F.lit(" "), text), "-", " ")
        usual = [F.regexp_extract_all(text, F.lit(f"(?<![0-9])(?=({form})(?![0-9]))"), F.lit(1)) for form in GROUPINGS]
        whole = F.when(F.length(_bare(text)) <= 19, F.array(text)).otherwise(F.array().cast("array<string>"))
        sound = F.filter(F.concat(*usual, whole), lambda c: let(_bare(c), lambda d: _luhn(d) % 10 == 0))
        return let(F.get(sound, 0), lambda c: F.when(c.isNotNull(), F.struct(F.instr(even, F.translate(F.concat(F.lit(" "), c), "-", " ")).alias("at"), c.alias("old"))))

    def shift(d: Column) -> Column:
        body = F.substr(d, F.lit(1), F.length(d) - 1)
        new = _permuted_text(body, lambda c, i: F.when(i == 0, c).otherwise(F.lit(DIGITS)), key + "/card", backwards)
        check = lambda x: F.pmod(10 - _luhn(F.concat(x, F.lit("0"))) % 10, F.lit(10)).cast("string")
        return let(new, lambda x: F.concat(x, check(x)))

    def put(part: Column) -> Column:
        old, end = part["old"], part["at"] + F.length(part["old"])
        new = let(let(_bare(old), shift), lambda x: _refilled(old, x))
        return F.concat(F.substr(m, F.lit(1), part["at"] - 1), new, F.substr(m, end))

    return _is(m, CARD) & chosen(m).isNotNull(), let(chosen(m), put)


def _iban(m: Column, key: str, backwards: bool) -> tuple[Column, Column]:
    def shift(bare: Column) -> Column:
        country = F.substr(bare, F.lit(1), F.lit(2))
        check = lambda x: F.lpad((98 - _mod97(F.concat(x, country, F.lit("00")))).cast("string"), 2, "0")
        new = _permuted_text(F.substr(bare, F.lit(5)), _own_class, key + "/iban", backwards)
        return let(new, lambda x: F.concat(country, check(x), x))

    def sound(bare: Column) -> Column:
        remainder = _mod97(F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4))))
        return F.length(bare).between(15, 34) & (remainder == 1)

    return _is(m, IBAN) & let(_bare(m), sound), let(let(_bare(m), shift), lambda x: _refilled(m, x))


def _ssn(m: Column, key: str, backwards: bool) -> tuple[Column, Column]:
    part = [F.split_part(m, F.lit("-"), F.lit(i)).cast("int") for i in (1, 2, 3)]
    valid = part[0].between(1, 899) & (part[0] != 666) & (part[1] > 0) & (part[2] > 0)
    area = F.when(part[0] > 666, part[0] - 2).otherwise(part[0] - 1)
    new = permuted(F.array(area, part[1] - 1, part[2] - 1), F.array(F.lit(898), F.lit(99), F.lit(9999)), key + "/ssn", backwards)

    def shown(x: Column) -> Column:
        number = F.when(F.get(x, 0) >= 665, F.get(x, 0) + 2).otherwise(F.get(x, 0) + 1)
        return F.format_string("%03d-%02d-%04d", number, F.get(x, 1) + 1, F.get(x, 2) + 1)

    return _is(m, SSN) & valid, let(new, shown)


def _phone(m: Column, key: str, backwards: bool) -> tuple[Column, Column]:
    def shift(x: Column) -> Column:
        d, code = x["d"], x["code"]
        national = F.substr(d, code + 1)
        american = ((code == 1) & d.startswith("1") & (F.length(d) == 11)) | ((code == 0) & (F.length(d) == 10))
        country = F.when(american, F.lit("1")).otherwise(F.substr(d, F.lit(1), code))

        def alphabet(c: Column, i: Column) -> Column:
            lead = american & ((i == 0) | (i == 3))
            return F.when(lead & (c >= "2"), F.lit("23456789")).when(lead, c).otherwise(F.lit(DIGITS))

        new = _permuted_text(national, alphabet, F.concat(F.lit(key + "/phone/"), country), backwards)
        return F.concat(F.substr(d, F.lit(1), code), new)

    parts = F.struct(_bare(m).alias("d"), F.length(F.regexp_extract(m, COUNTRY, 1)).alias("code"))
    return _is(m, PHONE), let(let(parts, shift), lambda x: _refilled(m, x))


def _ipv4(m: Column, key: str, backwards: bool) -> tuple[Column, Column]:
    def shift(octets: Column) -> Column:
        first = F.get(octets, 0)
        usual = first.between(1, 223)
        values = F.concat(F.array(F.when(usual, first - 1).otherwise(F.lit(0))), F.slice(octets, 2, 3))
        radices = F.concat(F.array(F.when(usual, F.lit(223)).otherwise(F.lit(1))), F.array(*[F.lit(256)] * 3))
        lead = lambda x: F.when(usual, F.get(x, 0) + 1).otherwise(first).cast("string")
        new = permuted(values, radices, key + "/ipv4", backwards)
        return let(new, lambda x: F.concat_ws(".", lead(x), F.slice(x, 2, 3).cast("array<string>")))

    return _is(m, IPV4), let(F.transform(F.split(m, r"\."), lambda x: x.cast("int")), shift)


def _date(m: Column, key: str, backwards: bool) -> tuple[Column, Column]:
    """A slashed date is read day first, and month first where that is the only way."""
    numbers = F.transform(F.split(m, "[-./]"), lambda x: x.cast("int"))

    def parts(n: Column) -> Column:
        iso, month_first = m.contains("-"), m.contains("/") & (F.get(n, 1) > 12)
        year, other = F.when(iso, F.get(n, 0)).otherwise(F.get(n, 2)), F.when(iso, F.get(n, 2)).otherwise(F.get(n, 0))
        month = F.when(month_first, F.get(n, 0)).otherwise(F.get(n, 1))
        day = F.when(month_first, F.get(n, 1)).otherwise(other)
        return F.struct(year.alias("y"), month.alias("m"), day.alias("d"), month_first.alias("month_first"))

    def shift(x: Column) -> Column:
        """(y, m, d) anew; each class of days is a product of ranges."""
        year, month, day = x["y"] - FIRST_YEAR, x["m"] - 1, x["d"]
        late = F.array(*map(F.lit, LATE_DAYS))
        turn = lambda name, values, radices: permuted(F.array(*values), F.array(*map(F.lit, radices)), f"{key}/date/{name}", backwards)
        ymd = lambda y, mm, d: F.struct(y.cast("int").alias("y"), mm.cast("int").alias("m"), d.cast("int").alias("d"))
        nth_leap = F.floor(year / 4).cast("int") - 1
        leap = turn("leap", [F.floor(nth_leap / 7).cast("int"), (nth_leap % 7).cast("int")], [7, 7])
        place = (F.array_position(late, x["m"] * 100 + day) - 1).cast("int")
        return (
            F.when(day <= 12, let(turn("early", [year, month, day - 1], [YEARS, 12, 12]), lambda v: ymd(F.get(v, 0) + FIRST_YEAR, F.get(v, 1) + 1, F.get(v, 2) + 1)))
            .when(day <= 28, let(turn("middle", [year, month, day - 13], [YEARS, 12, 16]), lambda v: ymd(F.get(v, 0) + FIRST_YEAR, F.get(v, 1) + 1, F.get(v, 2) + 13)))
            .when(month == 1, let(leap, lambda v: ymd((F.get(v, 0) * 7 + F.get(v, 1) + 1) * 4 + FIRST_YEAR, F.lit(2), F.lit(29))))
            .otherwise(
                let(
                    turn("late", [year, place], [YEARS, len(LATE_DAYS)]),
                    lambda v: let(F.get(late, F.get(v, 1)), lambda day: ymd(F.get(v, 0) + FIRST_YEAR, F.floor(day / 100), day % 100)),
                )
            )
        )

    def shown(x: Column) -> Column:
        def written(new: Column) -> Column:
            y, mm, d = new["y"], new["m"], new["d"]
            slashed = F.when(x["month_first"], F.format_string("%02d/%02d/%04d", mm, d, y)).otherwise(F.format_string("%02d/%02d/%04d", d, mm, y))
            return F.when(m.contains("-"), F.format_string("%04d-%02d-%02d", y, mm, d)).when(m.contains("/"), slashed).otherwise(
                F.format_string("%02d.%02d.%04d", d, mm, y)
            )

        return let(shift(x), written)

    def real(x: Column) -> Column:
        text = F.format_string("%04d-%02d-%02d", x["y"], x["m"], x["d"])
        return x["y"].between(FIRST_YEAR, FIRST_YEAR + YEARS - 1) & F.try_to_date(text, "yyyy-MM-dd").isNotNull()

    return _is(m, DATE) & let(let(numbers, parts), real), let(let(numbers, parts), shown)


def _email(m: Column, key: str, backwards: bool) -> tuple[Column, Column]:
    local = F.split_part(m, F.lit("@"), F.lit(1))
    new = _permuted_text(_bare(local), _own_class, key + "/email", backwards)
    return _is(m, EMAIL) & (_bare(local) != ""), F.concat(
        let(new, lambda x: _refilled(local, x)), F.lit("@"), F.split_part(m, F.lit("@"), F.lit(2))
    )


def _secret(m: Column, key: str, backwards: bool) -> tuple[Column, Column]:
    named = m.rlike("^AKIA[A-Z0-9]{16}$")
    hexadecimal = m.rlike("^[0-9a-f]+$")

    def alphabet(c: Column, i: Column) -> Column:
        return F.when(named & (i < 4), c).when(hexadecimal, F.lit(HEX)).otherwise(_own_class(c))

    new = let(_bare(m), lambda bare: _permuted_text(bare, alphabet, key + "/secret", backwards))
    other = _is(m, "|".join([CARD, SSN, DATE, IBAN]))  # a value of another kind that did not validate
    return _is(m, r"[A-Za-z0-9_-]{8,64}") & (_bare(m) != "") & ~other, let(new, lambda x: _refilled(m, x))


KINDS = (_email, _ipv4, _date, _ssn, _iban, _card, _phone, _secret)


def pseudonym(match: Column, key: str, backwards: bool = False) -> Column:
    """A match's pseudonym, or null if no kind finds it valid."""
    out: Column | None = None
    for kind in KINDS:
        valid, new = kind(match, key, backwards)
        out = F.when(valid, new) if out is None else out.when(valid, new)
    return out


def key_of(spark: SparkSession) -> str:
    """The session's key (KEY_SETTING); without one a new key, so that pseudonyms are linked within one call only."""
    return spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32)


def pseudonymise(docs: DataFrame, key: str, column: str = "text", backwards: bool = False) -> DataFrame:
    """docs with the personal values of the column replaced, and n_private, the number of values replaced.

    key: whoever has it can turn pseudonyms back; the empty key is refused.
    backwards: turn pseudonyms of the same key into the values they stand for. A card with other digits right beside it comes
    back only if its pseudonym is still the first valid number among them: a card has one pseudonym, whatever stands beside it.
    """
    if not key:
        raise ValueError("a key is needed")
    text = F.col(column)

    def replaced(x: Column) -> Column:
        shown = F.zip_with(x["old"], x["new"], lambda m, p: F.coalesce(p, m))
        pieces = F.zip_with(F.concat(F.array(F.lit("")), shown), F.split(text, ANY, -1), lambda a, b: F.concat(a, b))
        count = F.size(F.filter(x["new"], lambda p: p.isNotNull())).cast("long")
        return F.struct(F.array_join(pieces, "").alias("text"), count.alias("n"))

    def looked_up(matches: Column) -> Column:
        new = F.transform(matches, lambda m: pseudonym(m, key, backwards))
        return let(F.struct(matches.alias("old"), new.alias("new")), replaced)

    found = F.when(text.rlike(HINT), let(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), looked_up))
    rest = [c for c in docs.columns if c not in (column, "n_private")]
    work = docs.select(*rest, text, found.alias("_found"))
    outcome = {
        column: F.coalesce("_found.text", text).alias(column),
        "n_private": F.coalesce("_found.n", F.lit(0)).cast("long").alias("n_private"),
    }
    order = [c for c in docs.columns if c != "n_private"]
    return work.select(*(outcome.get(c, F.col(c)) for c in order), outcome["n_private"])
