"""From candidates to claims, by rules and by given answers; and facts from prose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import escape, first_of, found, has, let, strip
from ..functions.labels import accounting_standard, basis_from_label, cleaned, coerced, is_a_property, names_something, resolve_subject, words
from ..functions.numbers import parse_value, typed_value
from ..functions.periods import enforce_plausibility, iso_date, parse_period
from ..functions.scale import parse_scale
from ..functions.text import is_prose

#: Words that do not belong to a label's ends.
STOP_WORDS = [
    "of", "in", "for", "the", "a", "an", "and", "or", "to", "by", "at", "on", "was", "were", "is", "are", "from",
    "with", "as", "that", "which", "during", "increased", "decreased", "grew", "rose", "fell", "stood", "reached",
    "million", "millions", "mn", "billion", "billions", "bn", "crore", "crores", "cr", "lakh", "lakhs", "lacs",
    "thousand", "trillion", "rs", "inr", "usd", "rupees", "rupee", "dollars", "amount", "amounts", "total", "value",
    "figures", "nos", "no", "units", "unit", "per", "cent", "percent", "bps",
]
#: Confidence of rules, of answers, and of answers whose scale was inherited; answers asked for at once.
BY_RULE, ANSWERED, INHERITED, BATCH = 0.45, 0.85, 0.6, 24


def trimmed(items: Column) -> Column:
    """Words without stop words at both ends."""
    stop = lambda w: F.lower(w).isin(STOP_WORDS)
    none = F.array().cast("array<string>")

    def cut(x: Column) -> Column:
        first, last = F.array_min(x["ordinary"]), F.array_max(x["ordinary"])
        return F.when(F.size(x["ordinary"]) > 0, F.slice(x["items"], first, last - first + 1)).otherwise(none)

    def marked(given: Column) -> Column:
        ordinary = F.filter(F.transform(given, lambda w, i: F.when(~stop(w), i + 1)), lambda i: i.isNotNull())
        return let(F.struct(given.alias("items"), ordinary.alias("ordinary")), cut)

    return let(items, marked)


def label_before(text: Column, offset: Column, most: int = 8) -> Column:
    """The last words before an offset, back to the last break of a sentence or line, without stop words at the ends."""
    head = F.substr(text, F.lit(1), offset)
    fragment = F.regexp_extract(head, r"(?s)([^.;:!?•·\n]*)$", 1)
    all_words = F.regexp_extract_all(fragment, F.lit(r"[A-Za-z][A-Za-z&/'\-]*"), F.lit(0))
    last = let(all_words, lambda w: F.slice(w, F.greatest(F.size(w) - most + 1, F.lit(1)), F.lit(most)))
    return F.array_join(trimmed(last), " ")


def row_label(text: Column, offset: Column, token: Column) -> Column:
    """The block's first line, if the value stands alone on a later line and that line has two words or more."""
    before = F.substr(text, F.lit(1), offset)
    first = F.regexp_extract(text, r"^([^\n]*)\n", 1)
    own = F.concat(F.regexp_extract(before, r"(?s)([^\n]*)$", 1), F.regexp_extract(F.substr(text, offset + 1), r"^([^\n]*)", 1))
    alone = ~F.replace(own, token, F.lit("")).rlike("[A-Za-z]")
    two = F.size(F.regexp_extract_all(first, F.lit(r"[A-Za-z][A-Za-z&/'\-]*"), F.lit(0))) >= 2
    return F.when(before.contains("\n") & alone & two, strip(first)).otherwise(F.lit(""))


def period_near(*sources: Column) -> Column:
    """The first source that names a period."""
    parsed = [parse_period(F.coalesce(s, F.lit(""))) for s in sources]
    return F.coalesce(*(let(p, lambda x: F.when(x["kind"] != "unknown", x)) for p in parsed[:-1]), parsed[-1])


def once(value: Column) -> Column:
    """value as a column that filters and fields are read from: without this a filter, and each field of a struct, would compute
    it again. (What a generator gives is not merged into the expressions that name it.)"""
    return F.explode(F.array(value))


def _scope(period: Column, basis: Column, segment: Column, geography: Column, accounting: Column, modality: Column, vintage: Column) -> Column:
    text = lambda c, n: c.cast("string").alias(n)
    return F.struct(
        period.alias("period"), text(basis, "basis"), text(segment, "segment"), text(geography, "geography"), text(accounting, "accounting"), text(modality, "modality"), vintage.cast("date").alias("vintage")
    )


def by_rules(candidates: DataFrame) -> DataFrame:
    """Claims read without a model from candidates with columns: document_id, page, block_text, in_block, at, until, text,
    tight, spot_kind, noise_hint, and - may be null - header_path, column_header, row_label, caption, subject, context, vintage.

    References and dates are left out first; a value must be money or a ratio or have a unit or scale beside it.
    """
    usable = candidates.where("not noise_hint and spot_kind not in ('date', 'duration')")
    c = F.col
    header = F.coalesce(c("column_header"), c("header_path"))
    inherited = F.concat_ws(" ", header, c("caption"), c("context"))
    typed = usable.withColumn("value", once(parse_value(c("text"), c("tight"), inherited))).where("value is not null")
    stated = c("value.kind").isin("money", "ratio") | c("value.unit").isNotNull() | parse_scale(c("tight")).isNotNull()
    before = label_before(c("block_text"), c("in_block"))
    own = row_label(c("block_text"), c("in_block"), c("text"))
    label = F.coalesce(F.nullif(c("row_label"), F.lit("")), let(before, lambda x: F.when(x != "", x)), own)
    named = typed.where(stated).withColumn("predicate_raw", once(label)).where((F.length("predicate_raw") >= 3) & (words(c("predicate_raw")) >= 2))
    near = F.coalesce(c("block_text"), F.lit(""))
    scope = _scope(
        period_near(c("column_header"), c("header_path"), near),
        F.coalesce(basis_from_label(header), F.lit("unknown")),
        F.lit(None),
        F.lit(None),
        F.lit("unknown"),
        F.lit("unknown"),
        c("vintage"),
    )
    return named.withColumn("_scope", once(scope)).select(
        c("document_id"),
        "page",
        c("at").alias("char_start"),
        c("until").alias("char_end"),
        c("subject").alias("subject_raw"),
        "predicate_raw",
        "value",
        enforce_plausibility(c("_scope")).alias("scope"),
        F.lit(BY_RULE).alias("confidence"),
        F.lit(False).alias("scale_inferred"),
    )


def marked(text: Column, start: Column, end: Column, in_table: Column, most: int = 400) -> Column:
    """text with the value between « and », at most so many characters around it; in tables only the value's own row."""
    row_start = F.when(in_table, F.length(F.regexp_extract(F.substr(text, F.lit(1), start), r"(?s)^(.*\n)", 1))).otherwise(F.lit(0))
    tail = F.substr(text, end + 1)
    after = F.when(in_table, F.regexp_extract(tail, r"^([^\n]*)", 1)).otherwise(tail)
    room = F.greatest((F.lit(most) - (end - start)) / 2, F.lit(0)).cast("int")
    first = F.greatest(row_start, start - room)
    before = F.substr(text, first + 1, start - first)
    return F.concat(before, F.lit("«"), F.substr(text, start + 1, end - start), F.lit("»"), F.substr(after, F.lit(1), room))


def batches(candidates: DataFrame, size: int = BATCH) -> DataFrame:
    """candidates with their place in a page's batches, as they are put to a model."""
    order = Window.partitionBy("document_id", "page").orderBy("at", "until")
    n = F.row_number().over(order) - 1
    return candidates.withColumns({"batch": F.floor(n / size).cast("int"), "i": (n % size).cast("int")})


def by_answers(batched: DataFrame, answers: DataFrame) -> DataFrame:
    """Claims of batched candidates and a model's answers(document_id, page, batch, i, p, s, t, b, g, m, accounting).

    Answers are a table, whoever gave them: indices outside the batch and predicates that name nothing are dropped. A
    value whose scale came from the page or the document counts less.
    """
    c = F.col
    joined = batched.join(answers, ["document_id", "page", "batch", "i"])
    inherited = F.concat_ws(" ", c("caption"), c("context"))
    predicate, subject = cleaned(c("p")), F.coalesce(cleaned(c("s")), c("subject"))
    typed = joined.withColumns({"predicate_raw": predicate, "subject_raw": subject, "value": parse_value(c("text"), c("tight"), inherited)})
    sound = typed.where("value is not null and subject_raw is not null").where(names_something(c("predicate_raw")))
    inferred = parse_scale(c("text")).isNull() & parse_scale(c("tight")).isNull() & parse_scale(inherited).isNotNull() & (c("value.kind") != "ratio")
    modalities = ["reported", "restated", "estimated", "provisional", "projected", "guidance"]
    scope = _scope(
        period_near(c("t"), c("column_header"), c("tight")),
        coerced(c("b"), ["consolidated", "standalone", "segment"], "unknown"),
        cleaned(c("g")),
        F.lit(None),
        accounting_standard(c("accounting")),
        coerced(c("m"), modalities, "unknown"),
        c("vintage"),
    )
    return sound.select(
        "document_id",
        "page",
        c("at").alias("char_start"),
        c("until").alias("char_end"),
        "subject_raw",
        "predicate_raw",
        "value",
        enforce_plausibility(scope).alias("scope"),
        F.when(inferred, F.lit(INHERITED)).otherwise(F.lit(ANSWERED)).alias("confidence"),
        inferred.alias("scale_inferred"),
    )


def document_context(pages: DataFrame, answers: DataFrame, first_pages: int = 4, chars: int = 2500) -> DataFrame:
    """(document_id, entity, currency, scale, basis, standard, published): a document's own words about itself.

    A standard counts only where its name stands near a phrase of preparation; see evidenced_standards().
    """
    head = pages.where(F.col("page") <= first_pages).groupBy("document_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", F.substr("text", F.lit(1), F.lit(chars)).alias("t")))), lambda x: x["t"]), "\n").alias("head")
    )
    answered = answers.withColumn("standard", accounting_standard(F.col("standard")))
    evidenced = evidenced_standards(head.withColumnRenamed("head", "text")).withColumn("_sound", F.lit(True))
    joined = head.join(answered, "document_id", "left").join(evidenced, ["document_id", "standard"], "left")
    return joined.select(
        "document_id",
        cleaned(F.col("entity")).alias("entity"),
        cleaned(F.col("currency")).alias("currency"),
        cleaned(F.col("scale")).alias("scale"),
        coerced(F.col("basis"), ["consolidated", "standalone"], "unknown").alias("basis"),
        F.when(F.col("_sound"), F.col("standard")).otherwise(F.lit("unknown")).alias("standard"),
        iso_date(F.col("published_on")).alias("published"),
    )


#: How documents write the standards, and phrases that assert one as the basis of preparation.
STANDARD_NAMES = {
    "IND_AS": ["ind as", "ind-as", "indian accounting standard"],
    "IFRS": ["ifrs", "international financial reporting standard"],
    "US_GAAP": ["us gaap", "u.s. gaap", "generally accepted accounting"],
}
PREPARED = [
    "prepared in accordance with",
    "prepared under",
    "in compliance with",
    "basis of preparation",
    "accounting standards specified under",
    "notified under section 133",
    "comply in all material respects with",
    "presented in accordance with",
]
#: Fixed value: characters between the start of a name and the start of a phrase, at most.
REACH = 240


def places(text: Column, word: str) -> Column:
    """Where the word occurs, from 0: what is before it in the pieces that it parts the text into."""
    pieces = F.split(text, escape(word), -1)
    lengths = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.length(p))
    ends = F.aggregate(lengths, F.expr("cast(array() as array<int>)"), lambda s, n: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)) + len(word), F.lit(0)) + n)))
    return F.when(text.contains(word), ends).otherwise(F.expr("cast(array() as array<int>)"))


def evidenced_standards(texts: DataFrame, reach: int = REACH) -> DataFrame:
    """(document_id, standard): the standards that texts(document_id, text) assert as their basis of preparation.

    A band join: names and phrases are rows with their places; a phrase is in one bin of ``reach`` characters, a name in the
    three around it, and what shares a bin is compared by distance.
    """
    low = texts.select("document_id", F.lower("text").alias("t"))
    spots = lambda words: F.flatten(F.array(*(places(F.col("t"), w) for w in words)))
    bin_of = lambda at: F.floor(at / reach)
    phrases = low.select("document_id", F.explode(spots(PREPARED)).alias("phrase")).withColumn("bin", bin_of(F.col("phrase")))
    each = F.array(*(F.struct(F.lit(k).alias("standard"), spots(v).alias("at")) for k, v in STANDARD_NAMES.items()))
    names = low.select("document_id", F.explode(each).alias("n")).select("document_id", "n.standard", F.explode("n.at").alias("name"))
    around = names.withColumn("bin", F.explode(F.sequence(bin_of(F.col("name")) - 1, bin_of(F.col("name")) + 1)))
    near = around.join(phrases, ["document_id", "bin"]).where(F.abs(F.col("name") - F.col("phrase")) <= reach)
    return near.select("document_id", "standard").distinct()


def prose_blocks(blocks: DataFrame, most: int = 8) -> DataFrame:
    """The first blocks of each page that are worth reading for facts."""
    order = Window.partitionBy("document_id", "page").orderBy("ord")
    return blocks.where(is_prose(F.col("text"), F.col("kind"))).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def prose_ranking(blocks: DataFrame, most: int = 5) -> DataFrame:
    """(document_id, page, chars, rank): the pages with the most prose."""
    order = Window.partitionBy("document_id").orderBy(F.desc("chars"), "page")
    sums = prose_blocks(blocks).groupBy("document_id", "page").agg(F.sum(F.length("text")).alias("chars"))
    return sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def located(text: Column, value: Column) -> Column:
    """Offset of value in text, white space aside, from 0; null if it is not there verbatim."""
    exact = F.instr(text, value)
    loose = F.regexp_replace(text, r"(?U)\s+", " ").contains(F.regexp_replace(strip(value), r"(?U)\s+", " "))
    return F.when(strip(value) == "", F.lit(None)).when(exact > 0, exact - 1).when(loose, F.lit(-1))


def facts(blocks: DataFrame, answers: DataFrame, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(claims, rejected answers) of prose blocks and answers(document_id, page, ord, n, s, p, v, k).

    At most four facts a block; of equal facts of a page the first; a value that is not there verbatim is refused.
    """
    c = F.col
    joined = blocks.join(answers.where(F.col("n") < most), ["document_id", "page", "ord"])
    property_ = is_a_property(c("p"), c("v"))
    once = Window.partitionBy("document_id", "page", F.lower("s"), F.lower("p"), F.lower("v")).orderBy("ord", "n")
    valid = joined.where(property_).withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")
    at = located(c("text"), c("v"))
    subject = resolve_subject(c("s"), c("entity")) if "entity" in blocks.columns else c("s")
    value = typed_value(c("k"), c("v"), parse_period(c("v"))["start"])
    placed = valid.withColumn("_at", at)
    claims = placed.where("_at is not null").select(
        "document_id", "page", "ord", strip(subject).alias("subject_raw"), strip(F.lower("p")).alias("predicate_raw"), value.alias("value"), F.lit(0.9).alias("confidence"), c("text").alias("quote")
    )
    refused = joined.where(~property_).withColumn("why", F.lit("not a property")).select("document_id", "page", "ord", "n", "why")
    return claims, refused.unionByName(placed.where("_at is null").select("document_id", "page", "ord", "n", F.lit("not verbatim").alias("why")))


def adjudicated(edges: DataFrame, answers: DataFrame, most: int = 50) -> DataFrame:
    """Ambiguous edges, the most confident first, with a model's answers(a_id, b_id, relation, axis, confidence) let through
    where the scopes allow it: a reconciling axis must really differ, a contradiction needs both periods; confidence is at
    most 0.7. edges need diffs (array of axes) and dated (both periods start)."""
    c = F.col
    top = edges.where("relation = 'ambiguous'").orderBy(F.desc("confidence"), "a_seq", "b_seq").limit(most)
    said = answers.select("a_id", "b_id", c("relation").alias("_r"), c("axis").alias("_x"), c("confidence").alias("_c"))
    joined = top.join(said, ["a_id", "b_id"], "left")
    real_axis = F.array_contains("diffs", c("_x"))
    allowed = first_of([(c("_r") == "reconciled", F.coalesce(real_axis, F.lit(False))), (c("_r") == "contradiction", c("dated"))], c("_r").isin("corroboration", "ambiguous"))
    passed = c("_r").isNotNull() & F.coalesce(allowed, F.lit(False))
    return joined.withColumns(
        {
            "decided_by": F.when(passed, F.lit("adjudicator")).otherwise(F.lit("rules")),
            "refused": c("_r").isNotNull() & ~passed,
            "axis": F.when(passed & (c("_r") == "reconciled"), c("_x")).when(~passed, c("axis")),
            "relation": F.when(passed, c("_r")).otherwise(c("relation")),
            "confidence": F.when(passed, F.least(c("_c"), F.lit(0.7))).otherwise(c("confidence")),
        }
    ).drop("_r", "_x", "_c")


#: What prose says where it asserts a relation, in the order in which it is looked for.
ASSERTS = {
    "contradiction": [r"\bcontradict", r"\bconflict", r"\binconsisten", r"\bcannot both\b", r"\bdisagree"],
    "corroboration": [r"\bcorroborat", r"\bagree", r"\bconfirm", r"\bconsistent\b", r"\bthe same figure\b"],
    "reconciled": [r"\breconcil", r"\bexplained by\b", r"\bdifference is due\b", r"\baccounted for by\b"],
    "unrelated": [r"\bunrelated\b", r"\bnot comparable\b", r"\bdifferent quantit"],
}


def other_verdict(prose: Column, relation: Column) -> Column:
    """Why the prose cannot stand: it has the words of another relation and none of its own. Null where it can."""

    def judged(said: Column) -> Column:
        own = F.exists(said, lambda x: x["relation"] == relation)
        first = F.get(said, 0)
        reason = F.concat(F.lit("prose used the language of "), first["relation"], F.lit(" ('"), first["hit"], F.lit("') under a "), relation, F.lit(" verdict"))
        return F.when(~own & (F.size(said) > 0), reason)

    def all_said(low: Column) -> Column:
        each = [F.struct(F.lit(r).alias("relation"), F.coalesce(*(found(low, p) for p in patterns)).alias("hit")) for r, patterns in ASSERTS.items()]
        return F.filter(F.array(*each), lambda x: x["hit"].isNotNull())

    return let(let(F.lower(prose), all_said), judged)


def contradicts_verdict(prose: Column, relation: Column) -> Column:
    """The prose speaks of another relation and not of its own."""
    return other_verdict(prose, relation).isNotNull()


def explained(edges: DataFrame, prose: DataFrame, fallback: Column) -> DataFrame:
    """edges with explanation: the prose(a_id, b_id, text) given for a pair unless it contradicts the verdict."""
    joined = edges.join(prose.select("a_id", "b_id", F.col("text").alias("_t")), ["a_id", "b_id"], "left")
    usable = F.col("_t").isNotNull() & ~contradicts_verdict(F.col("_t"), F.col("relation"))
    return joined.withColumn("explanation", F.when(usable, F.col("_t")).otherwise(fallback)).drop("_t")
