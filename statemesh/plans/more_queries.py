"""Queries for grounding, canonical nodes, spots, columns, facts, evaluation, curation, repair, routing, sources and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.embeddings import cosine
from ..functions.labels import normalise_label
from ..functions.numbers import parse_value
from ..functions.text import is_prose, tolerant_json
from ..operators import canon, columns, curate, evals, extract, ground, repair, routing, spot
from ..operators.compare import differing_axes, pair_sides, with_verdict
from ..operators.pairing import exact_pairs, narrowed, unreliable_periods
from ..schema import CLAIM_NAMES
from ..session import scratch, stored
from ..sources import checkpoints, documents
from ..streaming import extend as incremental
from .adapter import order_claims, order_statements, table
from .core_queries import CLAIMS_SQL, WHOLE_SQL, stored_narrow
from . import read_api
from .layer import assign_subjects, build, contradictions, corroborations, flagged

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


# Grounding: every document is one page; its first 40 characters are cited, well or badly by its number. The value is the
# text's head up to the first blank, of 12 characters at most: none where the text begins with one.
_GROUND_SQL = """WITH d AS (SELECT doc_id, substr(coalesce(text, ''), 1, 40) AS head, text FROM documents),
n AS (SELECT *, trim(regexp_replace(translate(head, E'\u00a0\u00ad', '  '), '\\s+', ' ', 'g')) AS quote FROM d),
r AS (SELECT doc_id, CASE WHEN doc_id % 6 = 4 OR text IS NULL THEN 'page_not_found' WHEN doc_id % 6 = 5 OR (quote = '' AND doc_id % 6 <> 2) THEN 'empty_quote'
  WHEN doc_id % 6 = 3 THEN 'span_out_of_range' WHEN doc_id % 6 = 2 THEN 'quote_mismatch' WHEN doc_id % 6 = 1 THEN 'value_not_in_quote' END AS reason FROM n)"""


def cited_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(claims, pages): claims that cite the head of their document, some of them wrongly."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    kind, head = F.col("doc_id") % 6, F.coalesce(F.substr("text", F.lit(1), F.lit(40)), F.lit(""))
    quote = F.when(kind == 2, F.concat(head, F.lit("#"))).when(kind == 5, F.lit(" ")).otherwise(head)
    raw = F.when(kind == 1, F.lit("9,999,999.25")).otherwise(F.regexp_extract(head, r"^(\S{1,12})", 1))
    evidence = F.struct(
        F.col("doc_id").cast("string").alias("document_id"),
        F.when(kind == 4, 2).otherwise(1).alias("page"),
        F.lit(0).alias("char_start"),
        F.when(kind == 3, F.length("text") + 5).otherwise(F.length(head)).alias("char_end"),
        quote.alias("quote"),
        F.lit("primary").alias("kind"),
    )
    claims = d.select(F.col("doc_id").cast("string").alias("id"), F.struct(raw.alias("raw")).alias("value"), F.array(evidence).alias("evidence"))
    return claims, d.where("text is not null").select(F.col("doc_id").cast("string").alias("document_id"), F.lit(1).alias("page"), "text")


@query("grounding_gate", _GROUND_SQL + " SELECT CAST(doc_id AS VARCHAR) AS id, reason IS NULL AS ok, reason FROM r")
def grounding_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ground.verify(*cited_documents(spark, sf_dir))


@query("quarantine_by_reason", _GROUND_SQL + " SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1")
def quarantine_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ground.by_reason(ground.verify(*cited_documents(spark, sf_dir)).where("not ok"))


@query("grounding_report", _GROUND_SQL + " SELECT count_if(reason IS NULL) AS grounded, count_if(reason IS NOT NULL) AS quarantined, round(avg((reason IS NULL)::INT), 4) AS pass_rate FROM r")
def grounding_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ground.report(ground.verify(*cited_documents(spark, sf_dir)))


@query(
    "cosine_nearest",
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT label, unnest(v) AS u, generate_subscripts(v, 1) AS i FROM e),
    m AS (SELECT label, i, avg(u) AS u FROM x GROUP BY 1, 2), c AS (SELECT label, list(u ORDER BY i) AS v FROM m GROUP BY 1)
    SELECT e.vec_id, c.label AS nearest, round(list_cosine_similarity(e.v, c.v), 4) AS similarity FROM e CROSS JOIN c
    QUALIFY row_number() OVER (PARTITION BY e.vec_id ORDER BY list_cosine_similarity(e.v, c.v) DESC, c.label) = 1""",
)
def cosine_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector against the mean of each label: the nearest, ties to the first. The means are one row per label."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    means = e.select("label", F.posexplode("v").alias("i", "u")).groupBy("label", "i").agg(F.avg("u").alias("u"))
    centres = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "u"))), lambda x: x["u"]).alias("c"))
    every = centres.agg(F.array_sort(F.collect_list(F.struct("label", "c"))).alias("centres"))
    scored = e.crossJoin(F.broadcast(every))  # one row: a mean for each of the few labels
    best = F.transform("centres", lambda c: F.struct(cosine(F.col("v"), c["c"]).alias("s"), (-c["label"]).alias("l")))
    top = scored.withColumn("b", F.array_max(best))
    return top.select("vec_id", (-F.col("b.l")).alias("nearest"), F.round("b.s", 4).alias("similarity"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("seq"), F.concat("p_brand", F.when(F.col("p_partkey") % 2 == 0, " Limited").otherwise(" Ltd.")).alias("subject_raw"), F.col("p_name").alias("predicate_raw"))


@query(
    "registry_labels",
    r"""SELECT 'entity' AS kind, trim(regexp_replace(lower(p_brand), '[^\w\s]', ' ', 'g')) AS key, min(p_partkey) AS first, count(*) AS uses FROM part GROUP BY 2
    UNION ALL SELECT 'predicate', trim(regexp_replace(regexp_replace(lower(p_name), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')), min(p_partkey), count(*) FROM part GROUP BY 2""",
)
def registry_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canon.distinct_labels(canon.label_keys(_labelled(spark, sf_dir))).select("kind", "key", "first", "uses")


@query("registry_resolve")
def registry_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' names resolved to nodes, with the decision on each."""
    return canon.describe(canon.resolve(canon.distinct_labels(canon.label_keys(_labelled(spark, sf_dir)))))


@query("registry_stats")
def registry_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canon.stats(canon.resolve(canon.distinct_labels(canon.label_keys(_labelled(spark, sf_dir)))))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text")
    return documents.text_blocks(d)


@query("spot_candidates")
def spot_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every numeral, date and period of all documents, with its place."""
    return spot.spot(_blocks(spark, sf_dir)).select("document_id", "page", "at", "until", "spot_kind", "text", "noise_hint")


@query("spot_density")
def spot_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spot.pages_by_density(spot.spot(_blocks(spark, sf_dir)))


@query("spot_by_kind")
def spot_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spot.by_kind(spot.spot(_blocks(spark, sf_dir)))


@query("rule_claims")
def rule_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims read by rules from all documents."""
    c = spot.spot(_blocks(spark, sf_dir))
    none = F.lit(None).cast("string")
    full = c.withColumns({n: none for n in ("header_path", "column_header", "row_label", "caption", "context")} | {"subject": F.col("document_id"), "vintage": F.lit(None).cast("date")})
    return extract.by_rules(full).select("document_id", "page", "char_start", "predicate_raw", "value.kind", "value.raw", "confidence")


@query(
    "page_offsets",
    """WITH l AS (SELECT doc_id, i, string_split(text, chr(10))[i] AS t FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)),
    k AS (SELECT doc_id, (i - 1) // 40 + 1 AS page, i, t FROM l WHERE trim(t, ' ') <> '')
    SELECT CAST(doc_id AS VARCHAR) AS document_id, page, count(*) AS blocks, (sum(length(t) + 2) - 2)::BIGINT AS chars FROM k GROUP BY 1, 2""",
)
def page_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of blocks; the page's length is the last block's end."""
    b = _blocks(spark, sf_dir)
    return b.groupBy("document_id", F.col("page").cast("bigint").alias("page")).agg(F.count("*").alias("blocks"), F.max("char_end").cast("bigint").alias("chars"))


def _line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order a header table of key % 4 + 2 fiscal years and a flattened row of its quantities below a label."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q")))).alias("q"))
    key = F.col("l_orderkey")
    years = F.transform(F.sequence(F.lit(1), (key % 4 + 2).cast("int")), lambda i: F.concat(F.lit("FY"), (i + 1994).cast("string")))
    header = F.concat(F.lit("| item | "), F.array_join(years, " | "), F.lit(" |\n| --- |\n| units |"))
    body = F.concat(F.lit("Quantity shipped\n"), F.array_join(F.transform("q", lambda x: x["q"].cast("string")), "\n"))
    both = F.array(F.struct(F.lit(0).alias("ord"), F.lit("table").alias("kind"), header.alias("text")), F.struct(F.lit(1).alias("ord"), F.lit("paragraph").alias("kind"), body.alias("text")))
    rows = li.select(key.cast("string").alias("document_id"), F.lit(1).alias("page"), F.explode(both).alias("b"))
    return documents.with_offsets(rows.select("document_id", "page", "b.*"))


@query("numeric_runs", "SELECT CAST(l_orderkey AS VARCHAR) AS document_id, 'Quantity shipped' AS row_label, count(*) AS cells FROM lineitem GROUP BY 1 HAVING count(*) >= 2")
def numeric_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.numeric_runs(_line_blocks(spark, sf_dir)).select("document_id", "row_label", F.size("cells").cast("bigint").alias("cells"))


@query(
    "column_cells",
    """WITH l AS (SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i FROM lineitem)
    SELECT CAST(l_orderkey AS VARCHAR) AS document_id, 'FY' || (1994 + i) || ' units' AS col, i FROM l WHERE n = l_orderkey % 4 + 2""",
)
def column_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flattened quantities matched to the header's years where the widths agree."""
    cells = columns.column_cells(_line_blocks(spark, sf_dir))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("document_id").orderBy("start"))
    return cells.select("document_id", F.col("column").alias("col"), place.cast("bigint").alias("i"))


@query(
    "prose_blocks",
    """SELECT doc_id, length(trim(text, E' \\n\\t')) AS n FROM documents WHERE length(trim(text, E' \\n\\t')) BETWEEN 60 AND 2000
    AND length(regexp_replace(trim(text, E' \\n\\t'), '[^0-9]', '', 'g')) <= 0.16 * length(trim(text, E' \\n\\t')) AND regexp_matches(text, '[a-z]{3,}\\s+[a-z]{3,}')""",
)
def prose_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where(is_prose(F.col("text"), F.lit("paragraph")))
    return d.select("doc_id", F.length(F.regexp_replace("text", r"^[ \n\t]+|[ \n\t]+$", "")).cast("bigint").alias("n"))


def _fact_answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("document_id"), F.lit(1).alias("page"), F.col("turn").alias("ord"), "role", "text")
    words = F.split("text", " ")
    said = c.select("document_id", "page", "ord", F.col("role").alias("s"), F.lit("spoken word").alias("p"), F.posexplode(words).alias("n", "w"))
    v = F.when(F.col("n") % 4 == 3, F.concat(F.lit("zz~"), "w")).otherwise(F.col("w"))
    return c, said.select("document_id", "page", "ord", "n", "s", "p", v.alias("v"), F.lit("text").alias("k"))


@query(
    "semantic_facts",
    """WITH a AS (SELECT conv_id, turn, role, text, i - 1 AS n, CASE WHEN i % 4 = 0 THEN 'zz~' ELSE '' END || string_split(text, ' ')[i] AS v
      FROM conversations, unnest(range(1, 5)) AS t(i) WHERE i <= len(string_split(text, ' '))),
    f AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY conv_id, lower(role), lower(v) ORDER BY turn, n) = 1)
    SELECT role, count_if(trim(v, E' \\n\\t') <> '' AND contains(text, v)) AS claims, count_if(trim(v, E' \\n\\t') = '' OR NOT contains(text, v)) AS refused FROM f GROUP BY 1""",
)
def semantic_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of every turn given as a fact: at most four a block are taken (the operator's limit), of equal ones the first,
    and only what stands there verbatim."""
    blocks, answers = _fact_answers(spark, sf_dir)
    claims, refused = extract.facts(blocks, answers)
    role = blocks.select("document_id", "page", "ord", "role")
    good = claims.select("document_id", "page", "ord", F.lit(1).alias("c"), F.lit(0).alias("r"))
    bad = refused.select("document_id", "page", "ord", F.lit(0).alias("c"), F.lit(1).alias("r"))
    return good.unionByName(bad).join(role, ["document_id", "page", "ord"]).groupBy("role").agg(F.sum("c").alias("claims"), F.sum("r").alias("refused"))


@query(
    "arithmetic_coherence",
    """WITH p AS (SELECT l_orderkey AS k, l_linenumber AS i, CAST(round(l_extendedprice) AS DOUBLE) AS v FROM lineitem),
    z AS (SELECT k, count(*) AS n, CASE WHEN k % 3 = 0 THEN sum(CASE WHEN i <= 2 THEN v ELSE 0 END) ELSE sum(v) END AS t FROM p GROUP BY k),
    c AS (SELECT * FROM z WHERE n >= 2 AND t <> 0)
    SELECT c.k AS k, EXISTS (SELECT 1 FROM p a JOIN p b ON a.k = b.k AND a.i < b.i WHERE a.k = c.k AND abs(a.v + b.v - c.t) <= abs(c.t) * 0.001::DOUBLE) AS satisfied FROM c""",
)
def arithmetic_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A total line for each order: does some pair of its lines sum up to it?"""
    li = table(spark, sf_dir, "lineitem")
    v = F.round("l_extendedprice").cast("decimal(38,10)")
    parts = li.select(F.col("l_orderkey").alias("k"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"), F.lit("line value").alias("predicate_raw"), v.alias("magnitude"))
    some = F.sum(F.when((F.col("l_orderkey") % 3 != 0) | (F.col("l_linenumber") <= 2), v).otherwise(F.lit(0)))
    totals = li.groupBy("l_orderkey").agg(some.cast("decimal(38,10)").alias("magnitude")).select(F.col("l_orderkey").alias("k"), (F.col("l_orderkey") * 100).alias("seq"), F.lit("Total value").alias("predicate_raw"), "magnitude")
    out = evals.arithmetic(parts.unionByName(totals), ["k"])
    return out.select((F.col("seq") / 100).cast("bigint").alias("k"), "satisfied")


@query("determinism", f"WITH {CLAIMS_SQL} SELECT count(*) AS n, true AS equal FROM edges")
def determinism(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two builds of the layer are equal."""
    cols = ["a_seq", "b_seq", "relation", "axis", "confidence"]
    one, two = (evals.fingerprint(build(order_claims(spark, sf_dir)).edges.select(*cols)) for _ in range(2))
    return one.crossJoin(two.select(F.col("n").alias("n2"), F.col("hash").alias("hash2"))).select("n", ((F.col("n") == F.col("n2")) & (F.col("hash") == F.col("hash2"))).alias("equal"))


@query("period_resolution", f"WITH {CLAIMS_SQL} SELECT count(*) AS claims, count(p_start) AS resolved, round(count(p_start) / count(*), 4) AS rate FROM claims")
def period_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.period_resolution(narrowed(order_claims(spark, sf_dir)))


@query(
    "disagreements",
    f"WITH {CLAIMS_SQL} SELECT relation, count(*) AS n, round(avg((NOT cross_document)::INT), 4) AS same_document_share, round(avg((abs(a_mag - b_mag) > 5 * abs(a_mag))::INT), 4) AS wide_share FROM edges WHERE a_mag <> b_mag GROUP BY 1",
)
def disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.disagreements(build(order_claims(spark, sf_dir)).edges)


def _detailed(claims: DataFrame, e: DataFrame) -> DataFrame:
    """Edges with what curation needs of both claims."""
    v, s = F.col("value"), F.col("scope")
    d = claims.select(
        "id", v["currency"].alias("currency"), v["unit"].alias("unit"), v["ratio_basis"].alias("ratio_basis"), F.get("evidence", 0)["quote"].alias("quote"), s["period"]["start"].alias("p_start"), s["period"]["convention"].alias("convention"), s["basis"].alias("basis")
    )
    for side in "ab":
        e = e.join(d.select(*(F.col(c).alias(f"{side}_{c}") for c in d.columns)), f"{side}_id")
    return e


_DETAILS = """, d AS (SELECT e.*, abs(a_mag - b_mag)::DOUBLE / abs(a_mag)::DOUBLE AS gap, a_seq % 2 <> b_seq % 2 AS scales, ca.basis AS a_basis, cb.basis AS b_basis,
  CASE WHEN e.predicate_id = 'order value' THEN 2 ELSE 4 END AS words4, NOT undated AS dated,
  length(ltrim(replace(a_raw, ',', ''), '0')) >= 3 AND length(ltrim(replace(b_raw, ',', ''), '0')) >= 3 AS digits3, replace(a_raw, ',', '') <> replace(b_raw, ',', '') AS bare_differ
  FROM edges e JOIN claims ca ON ca.seq = e.a_seq JOIN claims cb ON cb.seq = e.b_seq)"""
_SCORED, _SCORED_WHOLE = (f"WITH {sql}{_DETAILS}" for sql in (CLAIMS_SQL, WHOLE_SQL))


@query(
    "case1_best",
    _SCORED_WHOLE
    + """ SELECT a_seq, b_seq, round(10.0 * cross_document::INT + 6 * (gap = 0)::INT + 8 * bare_differ::INT + 12 * scales::INT + 3 * dated::INT + words4, 6)::DOUBLE AS score
    FROM d WHERE relation = 'corroboration' AND digits3 AND gap <= 0.005 ORDER BY score DESC, a_seq, b_seq LIMIT 20""",
)
def case1_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty most telling corroborations."""
    claims = stored(order_claims(spark, sf_dir), "claims")  # read several times, parsed once
    return _best_corroborations(claims, 20).select("a_seq", "b_seq", "score")


def _best_corroborations(claims: DataFrame, n: int) -> DataFrame:
    """The n best of all corroborations. If equal values give n with more points than unequal ones can have, these are the best;
    else all pairs are scored. So many points take two documents and two ways of writing, so others are not looked at for that.
    Values of ten decimals count as equal before they are: with such ones all pairs are scored."""
    narrow = narrowed(claims)  # unreliable periods do not matter to values that agree
    scored = lambda edges: curate.best(curate.score_corroborations(_detailed(claims, edges)), n)
    if claims.where("value.canonical_magnitude != round(value.canonical_magnitude, 9)").isEmpty():
        equal = stored(scored(corroborations(narrow, "a_document_id != b_document_id and trim(a_raw) != trim(b_raw)")), "equal")
        if equal.where(F.col("score") > curate.UNEQUAL_MOST).count() == n:
            return curate.best(equal, n)
    return scored(corroborations(narrow))


@query(
    "case2_best",
    _SCORED_WHOLE
    + """ SELECT a_seq, b_seq, round(10.0::DOUBLE + 5 * dated::INT + 8.0::DOUBLE * (1 - abs(gap - 0.15::DOUBLE) / 0.45::DOUBLE) - 4 * (a_basis <> b_basis)::INT + words4, 6) AS score
    FROM d WHERE relation = 'contradiction' AND cross_document AND digits3 AND words4 > 2 AND gap BETWEEN 0.01 AND 0.6 ORDER BY score DESC, a_seq, b_seq LIMIT 20""",
)
def case2_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty most telling contradictions."""
    claims = stored(order_claims(spark, sf_dir), "claims")  # read three times, parsed once
    return curate.best(curate.score_contradictions(_detailed(claims, contradictions(flagged(claims)))), 20).select("a_seq", "b_seq", "score")


@query(
    "case3_best",
    _SCORED
    + """ SELECT a_seq, b_seq, round(14.0 * cross_document::INT + CASE axis WHEN 'period' THEN 8 ELSE 6 END + 4 * (gap > 0.05)::INT + words4, 6)::DOUBLE AS score
    FROM d WHERE relation = 'reconciled' AND digits3 AND dated AND words4 > 2 AND gap BETWEEN 0.02 AND 4.0 ORDER BY score DESC, a_seq, b_seq LIMIT 20""",
)
def case3_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty most telling reconciliations."""
    claims = stored(order_claims(spark, sf_dir), "claims")  # read three times, parsed once
    edges = build(claims).edges.where("relation = 'reconciled'")
    return curate.best(curate.score_reconciliations(_detailed(claims, edges)), 20).select("a_seq", "b_seq", "score")


def _signed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.floor("o_totalprice").cast("bigint").alias("w"))
    raw = F.format_number("w", 0)
    wrapped = F.concat(F.lit("("), raw, F.lit(")"))
    text = F.when(F.col("key") % 4 == 1, F.concat(F.lit("net "), raw, F.lit(" end"))).when(F.col("key") % 4 == 2, F.concat(F.lit("net "), wrapped, F.lit(" and "), raw, F.lit(" end"))).otherwise(F.concat(F.lit("net "), wrapped, F.lit(" end")))
    t = o.select("key", raw.alias("raw"), text.alias("text"))
    doc = F.col("key").cast("string").alias("document_id")
    quote = F.when(F.col("key") % 4 == 3, F.lit("something else")).otherwise(F.col("text"))
    evidence = F.array(F.struct(doc, F.lit(1).alias("page"), F.lit(0).alias("char_start"), F.length("text").alias("char_end"), quote.alias("quote")))
    claims = t.select(F.col("key").cast("string").alias("id"), "key", parse_value(F.col("raw")).alias("value"), evidence.alias("evidence"))
    return claims, t.select(doc, F.lit(1).alias("page"), "text")


@query(
    "sign_repair",
    """SELECT o_orderkey AS key, CASE o_orderkey % 4 WHEN 0 THEN 'negated' WHEN 1 THEN 'unchanged' WHEN 2 THEN 'ambiguous' ELSE 'offset_mismatch' END AS outcome,
    CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE 1 END * floor(o_totalprice) AS magnitude FROM orders""",
)
def sign_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repair.repair_signs(*_signed(spark, sf_dir))
    return out.select("key", F.col("sign_outcome").alias("outcome"), F.col("value.canonical_magnitude").cast("double").alias("magnitude"))


@query("mistyped", "SELECT CAST(o_custkey % 6 AS VARCHAR) AS document_id, o_orderkey % 40 AS page, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 AND floor(o_totalprice) >= 1000 GROUP BY 1, 2")
def mistyped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with grouped numerals that were read as counts."""
    o = table(spark, sf_dir, "orders")
    raw = F.format_number(F.floor("o_totalprice").cast("bigint"), 0)
    context = F.when(F.col("o_orderkey") % 3 == 0, F.concat(raw, F.lit(" people"))).otherwise(F.lit("revenue"))
    e = F.array(F.struct((F.col("o_custkey") % 6).cast("string").alias("document_id"), (F.col("o_orderkey") % 40).alias("page")))
    return repair.suspect_pages(o.select(parse_value(raw, context).alias("value"), e.alias("evidence")))


@query(
    "ledger_usage",
    """SELECT event_type AS provider, coalesce(sum(CASE WHEN event_id % 7 <> 0 THEN floor(value)::BIGINT END), 0)::BIGINT AS prompt_tokens, coalesce(sum(CASE WHEN event_id % 7 <> 0 THEN user_id END), 0)::BIGINT AS completion_tokens,
    count_if(event_id % 7 <> 0) AS requests, coalesce(sum(CASE WHEN event_id % 7 <> 0 THEN 3 * floor(value)::BIGINT END), 0)::BIGINT AS chars,
    max_by(event_id % 1000, event_id) FILTER (WHERE event_id % 7 = 0) AS last_remaining FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-10' GROUP BY 1""",
)
def ledger_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.usage_today(_ledger(spark, sf_dir), "2024-01-10")


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    pt = F.floor("value").cast("bigint")
    return e.select(
        F.when(F.col("event_id") % 7 == 0, "reconcile").otherwise("usage").alias("t"), F.col("ts").alias("at"), F.col("event_type").alias("provider"), pt.alias("pt"), F.col("user_id").alias("ct"), F.lit(1).alias("req"), (pt * 3).alias("chars"), (F.col("event_id") % 1000).alias("req_remaining"), F.col("event_id").alias("line")
    )


@query(
    "page_plan",
    """WITH p AS (SELECT CAST(l_suppkey % 10 AS VARCHAR) AS document_id, l_partkey % 50 AS page, count(*) AS density FROM lineitem GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY density DESC, page) AS rank, round(sum(density * 1.54::DOUBLE) OVER (PARTITION BY document_id ORDER BY density DESC, page ROWS UNBOUNDED PRECEDING), 6) AS spent FROM p)
    SELECT document_id, page, density, rank FROM r WHERE spent <= 2000 OR rank = 1""",
)
def page_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    pages = li.groupBy((F.col("l_suppkey") % 10).cast("string").alias("document_id"), (F.col("l_partkey") % 50).alias("page")).agg(F.count("*").alias("density"))
    return routing.plan_pages(pages, 2000).select("document_id", "page", "density", F.col("rank").cast("bigint").alias("rank"))


@query(
    "route_documents",
    """WITH e AS (SELECT l_suppkey AS document_id, count(*) AS candidates, ceil(count(*) / 24.0)::BIGINT AS requests, count(*) * 200 AS tokens FROM lineitem GROUP BY 1),
    t AS (SELECT *, greatest(tokens / 8000.0 * 60, requests / 30.0 * 60, requests * 1.8)::DOUBLE AS cloud, (candidates * 1.54)::DOUBLE AS local FROM e)
    SELECT document_id, candidates, CASE WHEN ceil(tokens * 1.4) <= 170000 AND requests <= 1000 AND cloud > local * 1.5 THEN 'local' WHEN ceil(tokens * 1.4) <= 170000 AND requests <= 1000 THEN 'cloud' ELSE 'local' END AS tier FROM t""",
)
def route_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("document_id")).agg(F.count("*").alias("candidates"))
    e = li.withColumns({"requests": F.ceil(F.col("candidates") / 24).cast("bigint"), "tokens": F.col("candidates") * 200})
    return routing.route(e, F.lit(200_000), F.lit(1000)).select("document_id", "candidates", "tier")


@query(
    "ledger_headroom",
    """WITH u AS (SELECT event_type AS provider, sum(floor(value)::BIGINT + user_id) FILTER (WHERE event_id % 7 <> 0) AS used, max_by(event_id % 1000, event_id) FILTER (WHERE event_id % 7 = 0) AS last, count_if(event_id % 7 <> 0) AS req FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-10' GROUP BY 1)
    SELECT provider, greatest(0, 200000 - coalesce(used, 0))::BIGINT AS tokens_left, greatest(0, coalesce(last, 1000 - req))::BIGINT AS requests_left FROM u""",
)
def ledger_headroom(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = routing.usage_today(_ledger(spark, sf_dir), "2024-01-10")
    return routing.headroom(usage, 200_000, 1000).select("provider", "tokens_left", "requests_left")


@query("token_estimate", "SELECT CAST(l_suppkey % 10 AS VARCHAR) AS document_id, count(*) AS candidates FROM lineitem GROUP BY 1")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work of the lines taken as candidates; the SQL says the count, tests the tokens."""
    li = table(spark, sf_dir, "lineitem")
    c = li.select((F.col("l_suppkey") % 10).cast("string").alias("document_id"), (F.col("l_partkey") % 50).alias("page"), F.col("l_orderkey").alias("at"), F.col("l_linenumber").alias("until"), F.format_string("%.2f", "l_extendedprice").alias("tight"))
    return routing.estimate_tokens(extract.batches(c)).select("document_id", "candidates")


@query(
    "documents_of_entity",
    f"WITH {CLAIMS_SQL}, s AS (SELECT document_id, subject_id FROM (SELECT document_id, subject_id, count(*) AS n, min(seq) AS f FROM claims GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY n DESC, f) = 1) SELECT c.document_id, count(*) AS n FROM claims c WHERE c.document_id IN (SELECT document_id FROM s WHERE subject_id = 'machinery') GROUP BY 1",
)
def documents_of_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of the documents that are about one entity."""
    claims = order_claims(spark, sf_dir)
    rows = claims.select(F.get("evidence", 0)["document_id"].alias("document_id"), "seq")
    own = read_api.documents_of_entity(assign_subjects(claims), rows, "machinery")
    return own.groupBy("document_id").agg(F.count("*").alias("n"))


@query(
    "adjudicated_edges",
    f"""WITH {CLAIMS_SQL}, top AS (SELECT *, NOT undated AS dated FROM edges WHERE relation = 'ambiguous' ORDER BY confidence DESC, a_seq, b_seq LIMIT 50),
    s AS (SELECT *, CASE a_seq % 3 WHEN 0 THEN 'corroboration' WHEN 1 THEN 'contradiction' ELSE 'reconciled' END AS said FROM top),
    j AS (SELECT *, CASE said WHEN 'corroboration' THEN true WHEN 'contradiction' THEN dated ELSE d_period END AS passed FROM s)
    SELECT a_seq, b_seq, CASE WHEN passed THEN said ELSE relation END AS relation, CASE WHEN passed THEN 0.7 ELSE confidence END::DOUBLE AS confidence, NOT passed AS refused FROM j""",
)
def adjudicated_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty most confident ambiguous pairs, with answers held against what the scopes allow."""
    a, b = pair_sides()
    pairs = exact_pairs(unreliable_periods(stored_narrow(spark, sf_dir)))
    judged = with_verdict(pairs).where("relation = 'ambiguous'").withColumns({"diffs": differing_axes(a, b), "dated": a("p_start").isNotNull() & b("p_start").isNotNull(), "confidence": F.round("confidence", 6)})
    edges = judged.select("a_id", "b_id", "a_seq", "b_seq", "relation", "axis", "confidence", "diffs", "dated")
    said = F.element_at(F.array(*map(F.lit, ("corroboration", "contradiction", "reconciled"))), (F.col("a_seq") % 3 + 1).cast("int"))
    answers = edges.select("a_id", "b_id", said.alias("relation"), F.lit("period").alias("axis"), F.lit(0.9).alias("confidence"))
    return extract.adjudicated(edges, answers).select("a_seq", "b_seq", "relation", "confidence", "refused")


@query("ontology_top")
def ontology_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes with the most aliases."""
    return read_api.ontology(canon.nodes(canon.resolve(canon.distinct_labels(canon.label_keys(_labelled(spark, sf_dir))))))


@query(
    "prose_ranking",
    """WITH l AS (SELECT doc_id, i - 1 AS i, string_split(text, chr(10))[i] AS t FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)),
    b AS (SELECT doc_id, i // 40 + 1 AS p, i, length(t) AS whole, trim(t, E' \\n\\t\\r') AS t FROM l WHERE trim(t, ' ') <> ''),
    q AS (SELECT * FROM b WHERE length(t) BETWEEN 60 AND 2000 AND length(regexp_replace(t, '[^0-9]', '', 'g')) <= 0.16 * length(t) AND regexp_matches(t, '[a-z]{3,}\\s+[a-z]{3,}') QUALIFY row_number() OVER (PARTITION BY doc_id, p ORDER BY i) <= 8),
    r AS (SELECT doc_id, p, sum(whole)::BIGINT AS chars FROM q GROUP BY 1, 2)
    SELECT CAST(doc_id AS VARCHAR) AS document_id, p::INT AS page, chars, (row_number() OVER (PARTITION BY doc_id ORDER BY chars DESC, p))::INT AS rank FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY chars DESC, p) <= 5""",
)
def prose_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's pages with the most prose."""
    return extract.prose_ranking(_blocks(spark, sf_dir))


@query(
    "incremental_extend",
    f"""WITH {CLAIMS_SQL}, g AS (SELECT *, seq % 7 >= 5 AS fresh FROM flagged),
    o AS (SELECT *, row_number() OVER (PARTITION BY subject_id, predicate_id ORDER BY seq) AS rn FROM g WHERE NOT fresh QUALIFY rn <= 60),
    w AS (SELECT *, count(*) OVER (PARTITION BY subject_id, predicate_id) AS nw FROM g WHERE fresh),
    m AS (SELECT *, CASE WHEN nw > 60 THEN row_number() OVER (PARTITION BY subject_id, predicate_id ORDER BY confidence DESC, seq)
      ELSE row_number() OVER (PARTITION BY subject_id, predicate_id ORDER BY seq) END AS rn FROM w QUALIFY rn <= 60),
    ab AS (SELECT a, b FROM w a JOIN o b ON a.subject_id = b.subject_id AND a.predicate_id = b.predicate_id
      UNION ALL SELECT a, b FROM m a JOIN m b ON a.subject_id = b.subject_id AND a.predicate_id = b.predicate_id AND a.rn < b.rn),
    pr AS (SELECT a.seq AS a_seq, b.seq AS b_seq, a.document_id = b.document_id AND a.page = b.page AS one_page, a.unreliable OR b.unreliable AS doubtful, a.p_start IS NULL OR b.p_start IS NULL AS undated,
      coalesce(a.p_start <> b.p_start OR a.p_end <> b.p_end, false)::INT + (a.basis <> 'unknown' AND b.basis <> 'unknown' AND a.basis <> b.basis)::INT + (a.segment IS DISTINCT FROM b.segment)::INT AS n,
      abs(a.mag - b.mag) <= greatest(CASE WHEN a.mag = 0 THEN 0 ELSE a.tol END, CASE WHEN b.mag = 0 THEN 0 ELSE b.tol END) OR abs(a.mag - b.mag) * 200 <= abs(a.mag) AS agree
      FROM (SELECT struct_pack(seq := a.seq, document_id := a.document_id, page := a.page, unreliable := a.unreliable, p_start := a.p_start, p_end := a.p_end, basis := a.basis, segment := a.segment, mag := a.mag, tol := a.tol) AS a,
                   struct_pack(seq := b.seq, document_id := b.document_id, page := b.page, unreliable := b.unreliable, p_start := b.p_start, p_end := b.p_end, basis := b.basis, segment := b.segment, mag := b.mag, tol := b.tol) AS b FROM ab))
    SELECT a_seq, b_seq, CASE WHEN n = 0 AND agree THEN 'corroboration' WHEN n = 0 AND (undated OR one_page OR doubtful) THEN 'ambiguous' WHEN n = 0 THEN 'contradiction'
      WHEN n = 1 AND agree THEN 'corroboration' WHEN n = 1 THEN 'reconciled' ELSE 'ambiguous' END AS relation FROM pr""",
)
def incremental_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two claims in seven folded into the rest, with the cap, which the hot blocks are over."""
    claims = stored(order_claims(spark, sf_dir), "claims")  # as a store is: nothing of it is parsed again
    _, edges = incremental.extend(claims.where("seq % 7 < 5"), claims)
    return edges.select("a_seq", "b_seq", "relation")


@query("checkpoint_roundtrip", f"WITH {CLAIMS_SQL} SELECT document_id, count(DISTINCT page) AS pages, count(*) AS claims, sum(mag)::DOUBLE AS total FROM claims GROUP BY 1")
def checkpoint_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims written as checkpoint pages, gzipped, and loaded again."""
    folder = f"{scratch(spark)}/checkpoints-{uuid.uuid4().hex}"
    c = order_claims(spark, sf_dir)
    e = F.get("evidence", 0)
    stored = c.withColumn("value", F.col("value").withField("canonical_magnitude", F.col("value.canonical_magnitude").cast("string")))
    pages = stored.groupBy(e["document_id"].alias("document"), e["page"].alias("page")).agg(F.collect_list(F.struct(*[x for x in CLAIM_NAMES if x != "seq"])).alias("claims"))
    named = pages.withColumns({"document_sha256": F.sha2("document", 256), "extracted_at": F.lit("2024-01-01T00:00:00")})
    named.write.option("compression", "gzip").json(f"{folder}/raw")
    # the sink names its files .json.gz; the loader looks for .jsonl.gz
    read = spark.read.schema(checkpoints.LINES).json(f"{folder}/raw").where("page is not null")
    one = read.select("document", "page", F.explode("claims").alias("c")).select("document", "page", *checkpoints._typed("c"))
    return one.groupBy(F.col("document").alias("document_id")).agg(F.countDistinct("page").alias("pages"), F.count("*").alias("claims"), F.sum("value.canonical_magnitude").cast("double").alias("total"))


@query("props_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON read out of text around it."""
    e = table(spark, sf_dir, "events").select("event_id", tolerant_json(F.concat(F.lit("answer: "), "props", F.lit(" end")), "k bigint").alias("p"))
    return e.select("event_id", "p.k")


_WINDOWS = "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


@query("windowed_counts", _WINDOWS)
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.windowed_counts(table(spark, sf_dir, "events"))


@query("stream_windows", _WINDOWS)
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream over the table's files, to its end."""
    batch = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    name = f"windows_{uuid.uuid4().hex}"
    folder = f"{scratch(spark)}/{name}"
    counts = incremental.windowed_counts(stream)
    run = counts.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", folder).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)
