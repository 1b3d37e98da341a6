"""Queries over the order statements: parsing, pairing, comparing, reading. Each has its SQL beside it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.common import CANONICAL
from ..functions.labels import normalise_label
from ..functions.numbers import classify_ratio, parse_range, parse_value
from ..functions.periods import enforce_plausibility, overlaps, parse_period, period_is_possible
from ..operators.compare import edge_order, fallback_explanation
from ..operators.pairing import all_pairs, incremental_pairs, narrowed, pairing_report, pairs_by_reason, unreliable_periods, value_pairs
from ..session import spread, stored
from . import read_api
from .adapter import order_claims, order_statements, period_text, table
from .layer import Layer, assign_subjects, build, contradictions, flagged, layer_stats, relation_by_axis, whole_counts

#: The same claims, derived from numbers rather than from texts.
CLAIMS_SQL = r"""
base AS (
  SELECT o_orderkey AS key, o_custkey, o_orderstatus AS st, lower(o_orderpriority) AS prio, c_mktsegment AS market,
         CAST(floor(o_totalprice) AS BIGINT) AS w, year(o_orderdate) AS y, k
  FROM orders JOIN customer ON o_custkey = c_custkey CROSS JOIN (VALUES (0), (1)) t(k)
),
claims AS (
  SELECT key * 2 + k AS seq, lower(market) AS subject_id, market || CASE k WHEN 0 THEN ' Limited' ELSE ' Ltd' END AS subject_raw,
         CASE WHEN key % 10 = 0 THEN 'order value' ELSE 'order value ' || prio || ' lot ' || (key % 40) END AS predicate_id,
         CASE k WHEN 0 THEN w * 1000000 ELSE ((w + 5) // 10) * 10000000 END AS mag,
         CASE k WHEN 0 THEN format('{:,}', w) ELSE CAST((w + 5) // 10 AS VARCHAR) END AS raw,
         CASE k WHEN 0 THEN 1000000 ELSE 10000000 END AS tol,
         CASE WHEN key % 7 = 0 THEN NULL ELSE make_date(y - 1, 4, 1) END AS p_start,
         CASE WHEN key % 7 = 0 THEN NULL ELSE make_date(y, 3, 31) END AS p_end,
         CASE WHEN k = 1 AND key % 5 = 0 THEN 'unknown' WHEN st = 'O' THEN 'consolidated' WHEN st = 'F' THEN 'standalone' ELSE 'unknown' END AS basis,
         CASE WHEN key % 11 = 0 THEN 'Express' END AS segment,
         CAST((o_custkey + k) % 6 AS VARCHAR) AS document_id, CAST(key % 40 AS INT) AS page,
         CASE key % 4 WHEN 0 THEN 0.45 WHEN 1 THEN 0.6 WHEN 2 THEN 0.85 ELSE 0.9 END::DOUBLE AS confidence
  FROM base
),
flagged AS (
  SELECT c.*, coalesce(m.seq_n > 1, false) AS unreliable FROM claims c LEFT JOIN (
    SELECT document_id, page, predicate_id, p_start, p_end, count(DISTINCT mag) AS seq_n FROM claims GROUP BY ALL) m
  ON c.document_id = m.document_id AND c.page = m.page AND c.predicate_id = m.predicate_id
     AND c.p_start IS NOT DISTINCT FROM m.p_start AND c.p_end IS NOT DISTINCT FROM m.p_end
),
sized AS (SELECT *, count(*) OVER (PARTITION BY subject_id, predicate_id) AS n FROM flagged),
members AS (
  SELECT *, CASE WHEN n > 60 THEN row_number() OVER (PARTITION BY subject_id, predicate_id ORDER BY confidence DESC, seq)
                 ELSE row_number() OVER (PARTITION BY subject_id, predicate_id ORDER BY seq) END AS rn
  FROM sized QUALIFY rn <= 60
),
pairs AS (
  SELECT a.seq AS a_seq, b.seq AS b_seq, a.document_id AS a_document_id, b.document_id AS b_document_id, a.raw AS a_raw, b.raw AS b_raw,
         a.mag AS a_mag, b.mag AS b_mag, a.subject_id, a.predicate_id, a.page = b.page AND a.document_id = b.document_id AS one_page,
         a.unreliable OR b.unreliable AS doubtful, a.p_start IS NULL OR b.p_start IS NULL AS undated, least(a.confidence, b.confidence) AS least_confidence,
         coalesce(a.p_start <> b.p_start OR a.p_end <> b.p_end, false) AS d_period,
         a.basis <> 'unknown' AND b.basis <> 'unknown' AND a.basis <> b.basis AS d_basis,
         a.segment IS DISTINCT FROM b.segment AS d_segment,
         abs(a.mag - b.mag) <= greatest(CASE WHEN a.mag = 0 THEN 0 ELSE a.tol END, CASE WHEN b.mag = 0 THEN 0 ELSE b.tol END) OR abs(a.mag - b.mag) * 200 <= abs(a.mag) AS agree
  FROM members a JOIN members b ON a.subject_id = b.subject_id AND a.predicate_id = b.predicate_id AND a.rn < b.rn
),
judged AS (
  SELECT *, d_period::INT + d_basis::INT + d_segment::INT AS n_diff,
         CASE WHEN d_period THEN 'period' WHEN d_basis THEN 'basis' WHEN d_segment THEN 'segment' END AS first_axis FROM pairs
),
edges AS (
  SELECT *, CASE WHEN n_diff = 0 AND agree THEN 'corroboration' WHEN n_diff = 0 AND (undated OR one_page OR doubtful) THEN 'ambiguous'
                 WHEN n_diff = 0 THEN 'contradiction' WHEN n_diff = 1 AND agree THEN 'corroboration' WHEN n_diff = 1 THEN 'reconciled' ELSE 'ambiguous' END AS relation,
         CASE WHEN n_diff = 1 THEN first_axis END AS axis,
         round(CASE WHEN n_diff = 0 AND agree THEN least_confidence WHEN n_diff = 0 AND (undated OR one_page OR doubtful) THEN least_confidence * 0.5
              WHEN n_diff = 0 THEN least_confidence WHEN n_diff = 1 AND agree THEN least_confidence * 0.8::DOUBLE WHEN n_diff = 1 THEN least_confidence
              ELSE least_confidence * 0.6::DOUBLE END, 6) AS confidence,
         a_document_id <> b_document_id AS cross_document
  FROM judged
)
"""

#: The same without the cap: members of whole blocks, in load order.
WHOLE_SQL = re.sub(
    r"members AS \(.*?\n\),",
    "members AS (SELECT *, row_number() OVER (PARTITION BY subject_id, predicate_id ORDER BY seq) AS rn FROM flagged),",
    CLAIMS_SQL,
    flags=re.DOTALL,
)


def _with(select: str) -> str:
    return f"WITH {CLAIMS_SQL} {select}"


def _whole(select: str) -> str:
    return f"WITH {WHOLE_SQL} {select}"


QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where there is one, its SQL."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


@query(
    "parse_value_roundtrip",
    _with(
        """SELECT seq, 'money' AS kind, 'INR' AS currency, CAST(mag AS DOUBLE) AS magnitude, length(regexp_replace(raw, ',', '', 'g')) AS digits FROM claims"""
    ),
)
def parse_value_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.numbers import significant_digits

    s = order_statements(spark, sf_dir).withColumn("v", parse_value(F.col("raw"), F.col("context")))
    return s.select("seq", "v.kind", "v.currency", F.col("v.canonical_magnitude").cast("double").alias("magnitude"), significant_digits(F.col("raw")).cast("bigint").alias("digits"))


@query(
    "ratio_normalise",
    """SELECT l_orderkey, l_linenumber, f.form, CASE WHEN f.form = 2 THEN 'bps' WHEN f.form = 3 THEN 'multiple' ELSE 'percent' END AS basis,
       CAST(round(l_discount * 100) AS BIGINT) / 100.0::DOUBLE AS fraction
       FROM lineitem CROSS JOIN (VALUES (0), (1), (2), (3)) f(form)""",
)
def ratio_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounts written as percentages (two spellings), basis points and multiples, and read back."""
    n = F.round(F.col("l_discount") * 100).cast("bigint")
    forms = [
        F.concat(n.cast("string"), F.lit("%")),
        F.concat(n.cast("string"), F.lit(" per cent")),
        F.concat((n * 100).cast("string"), F.lit(" bps")),
        F.concat(F.format_string("%d.%02d", (n / 100).cast("int"), (n % 100).cast("int")), F.lit("x")),
    ]
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.posexplode(F.array(*forms)).alias("form", "raw"))
    v = lines.withColumn("v", parse_value(F.col("raw")))
    return v.select("l_orderkey", "l_linenumber", "form", classify_ratio(F.col("raw")).alias("basis"), F.col("v.canonical_magnitude").cast("double").alias("fraction"))


@query(
    "range_parse_containment",
    """SELECT p_partkey, p_size::DOUBLE AS low, (p_size + 5)::DOUBLE AS high, p_size + 3 BETWEEN p_size AND p_size + 5 AS inside
       FROM part WHERE (p_size + 5) <= 10 * p_size""",
)
def range_parse_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    raw = F.concat(F.lit("between "), (F.col("p_size") + 5).cast("string"), F.lit(" and "), size)
    r = table(spark, sf_dir, "part").select("p_partkey", "p_size", parse_range(raw).alias("r")).where("r is not null")
    inside = (F.col("p_size") + 3).between(F.col("r.low"), F.col("r.high"))
    return r.select("p_partkey", F.col("r.low").cast("double").alias("low"), F.col("r.high").cast("double").alias("high"), inside.alias("inside"))


@query(
    "period_resolve",
    """WITH o AS (SELECT o_orderkey AS key, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, CAST(o_orderdate AS DATE) AS dt FROM orders),
    f AS (SELECT o.*, form FROM o CROSS JOIN (SELECT unnest(range(11)) AS form) t)
    SELECT key, form,
      CASE WHEN form = 5 THEN 'instant' ELSE 'interval' END AS kind,
      CASE form WHEN 0 THEN make_date(y - 1, 4, 1) + to_months(CAST(3 * (key % 4) AS INT)) WHEN 1 THEN make_date(y - 1, 4, 1)
        WHEN 2 THEN make_date(y - 1, 4, 1) + to_months(CAST(6 * (key % 2) AS INT)) WHEN 3 THEN make_date(y, 1, 1) + to_months(CAST(6 * (key % 2) AS INT))
        WHEN 4 THEN date_trunc('month', dt) - INTERVAL 2 MONTH WHEN 5 THEN dt WHEN 6 THEN make_date(y, 1, 1) WHEN 7 THEN make_date(y - 1, 4, 1)
        WHEN 8 THEN make_date(y - 1, 4, 1) WHEN 9 THEN make_date(y, 1, 1) + to_months(CAST(3 * (key % 4) AS INT)) ELSE make_date(y - 1, 4, 1) END::DATE AS p_start,
      CASE form WHEN 0 THEN last_day(make_date(y - 1, 6, 1) + to_months(CAST(3 * (key % 4) AS INT))) WHEN 1 THEN make_date(y - 1, 12, 31)
        WHEN 2 THEN last_day(make_date(y - 1, 9, 1) + to_months(CAST(6 * (key % 2) AS INT))) WHEN 3 THEN last_day(make_date(y, 6, 1) + to_months(CAST(6 * (key % 2) AS INT)))
        WHEN 4 THEN dt WHEN 5 THEN dt WHEN 6 THEN make_date(y, 12, 31) WHEN 7 THEN make_date(y, 3, 31)
        WHEN 8 THEN make_date(y, 3, 31) WHEN 9 THEN last_day(make_date(y, 3, 1) + to_months(CAST(3 * (key % 4) AS INT))) ELSE make_date(y, 3, 31) END::DATE AS p_end,
      CASE WHEN form IN (3, 6, 9) THEN 'CALENDAR' WHEN form = 4 THEN CASE WHEN m = 3 THEN 'IN_APR_MAR' ELSE 'unknown' END
        WHEN form = 5 THEN CASE WHEN m = 3 AND d = 31 THEN 'IN_APR_MAR' ELSE 'unknown' END ELSE 'IN_APR_MAR' END AS convention
    FROM f""",
)
def period_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written in all eleven forms of a period and resolved."""
    key, d = F.col("o_orderkey"), F.col("o_orderdate")
    year, before = F.date_format(d, "yyyy"), F.format_string("%04d", (F.year(d) - 1).cast("int"))
    quarter, half = (key % 4 + 1).cast("string"), (key % 2 + 1).cast("string")
    forms = [
        F.concat(F.lit("Q"), quarter, F.lit(" FY"), year),
        F.concat(F.lit("9M FY"), year),
        F.concat(F.lit("H"), half, F.lit("FY"), year),
        F.concat(F.lit("H"), half, F.lit(" CY"), year),
        F.concat(F.lit("three months ended "), F.date_format(d, "MMMM d, yyyy")),
        F.concat(F.lit("as at "), F.date_format(d, "d MMMM yyyy")),
        F.concat(F.lit("CY"), year),
        F.concat(before, F.lit("-"), year),
        F.concat(F.lit("fiscal year "), year),
        F.concat(F.lit("Q"), quarter, F.lit(" "), year),
        F.concat(F.lit("for the year ended March 31, "), year),
    ]
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"))
    o = orders.select(key.alias("key"), F.posexplode(F.array(*forms)).alias("form", "text"))
    p = o.withColumn("p", parse_period(F.col("text")))
    return p.select("key", F.col("form").cast("bigint").alias("form"), "p.kind", F.col("p.start").alias("p_start"), F.col("p.end").alias("p_end"), "p.convention")


@query(
    "period_plausibility",
    """SELECT o_orderkey AS key, coalesce(make_date(year(o_orderdate), 3, 31) <= CAST(o_orderdate AS DATE), true) OR o_orderkey % 7 = 0 AS possible,
       CASE WHEN o_orderkey % 7 <> 0 AND make_date(year(o_orderdate), 3, 31) <= CAST(o_orderdate AS DATE) THEN make_date(year(o_orderdate), 3, 31) END AS p_end FROM orders""",
)
def period_plausibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fiscal years held against the day of the order as the day of publication; impossible ones lose their dates."""
    o = table(spark, sf_dir, "orders")
    s = o.select("o_orderkey", parse_period(period_text(F.col("o_orderkey"), F.year("o_orderdate"))).alias("period"), F.to_date("o_orderdate").alias("vintage"))
    scope = F.struct("period", "vintage")
    out = s.select("o_orderkey", period_is_possible(F.col("period.end"), F.col("vintage")).alias("possible"), enforce_plausibility(scope).alias("scope"))
    return out.select(F.col("o_orderkey").alias("key"), "possible", F.col("scope.period.end").alias("p_end"))


@query(
    "period_overlap",
    """SELECT year(o_orderdate) AS y, count_if(make_date(year(o_orderdate), 3, 31) >= date_trunc('quarter', o_orderdate)) AS n_overlap, count(*) AS n FROM orders GROUP BY 1""",
)
def period_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the fiscal year that ends in the order's year meets the order's calendar quarter."""
    o = table(spark, sf_dir, "orders").select("o_orderdate")
    year = F.date_format("o_orderdate", "yyyy")
    p = o.select(
        F.year("o_orderdate").cast("bigint").alias("y"),
        parse_period(F.concat(F.lit("FY"), year)).alias("a"),
        parse_period(F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string"), F.lit(" "), year)).alias("b"),
    )
    return p.groupBy("y").agg(F.count_if(overlaps(F.col("a"), F.col("b"))).alias("n_overlap"), F.count("*").alias("n"))


@query(
    "label_keys",
    r"""WITH l AS (SELECT 'customer' AS src, c_mktsegment || ' Private Limited' AS label FROM customer UNION ALL SELECT 'supplier', s_name || ' Corp.' FROM supplier
        UNION ALL SELECT 'part', p_name FROM part)
    SELECT src, trim(regexp_replace(regexp_replace(regexp_replace(lower(label), '[^\w\s]', ' ', 'g'), '\b(limited|ltd|private|pvt|public|plc|incorporated|inc|corporation|corp|company|co|llp|llc|gmbh|sa|nv)\b\.?', ' ', 'g'), '\s+', ' ', 'g')) AS key, count(*) AS n
    FROM l GROUP BY 1, 2""",
)
def label_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("src"), F.concat("c_mktsegment", F.lit(" Private Limited")).alias("label"))
    s = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("src"), F.concat("s_name", F.lit(" Corp.")).alias("label"))
    p = table(spark, sf_dir, "part").select(F.lit("part").alias("src"), F.col("p_name").alias("label"))
    labels = c.unionByName(s).unionByName(p)
    return labels.groupBy("src", normalise_label(F.col("label"), strip_suffixes=True).alias("key")).agg(F.count("*").alias("n"))


def stored_narrow(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The claims flat and narrow (or the columns named), parsed once and written: what is read from them several times is not
    parsed again, and what is not asked for is not parsed at all."""
    narrow = narrowed(order_claims(spark, sf_dir))
    return stored(narrow.select(*columns) if columns else narrow, "narrow")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(order_claims(spark, sf_dir)).edges


@query("relation_counts", _whole("SELECT r.relation, count(e.relation) AS n FROM (VALUES ('corroboration'), ('contradiction'), ('reconciled'), ('ambiguous'), ('unrelated')) r(relation) LEFT JOIN edges e USING (relation) GROUP BY 1"))
def relation_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs of whole blocks stand in each relation."""
    return whole_counts(flagged(order_claims(spark, sf_dir)))


@query("relation_by_axis", _with("SELECT relation, coalesce(axis, 'none') AS axis, count(*) AS n FROM edges GROUP BY 1, 2"))
def relation_by_axis_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs of statements corroborate, contradict or are reconciled, by axis."""
    return relation_by_axis(_edges(spark, sf_dir))


@query("edges_all", _with("SELECT a_seq, b_seq, relation, axis, confidence, cross_document FROM edges"))
def edges_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).select("a_seq", "b_seq", "relation", "axis", "confidence", "cross_document")


@query(
    "pair_report",
    _with(
        """, blocks AS (SELECT count(*) AS n FROM claims GROUP BY subject_id, predicate_id),
    b AS (SELECT mag, CAST(floor(log10(mag::DOUBLE)) AS INT) - 2 AS e FROM claims WHERE mag <> 0)
    SELECT (SELECT count(*) FROM claims) AS claims, count(*) AS exact_blocks,
      (SELECT count(DISTINCT round_even(mag::DOUBLE / pow(10.0, e), 0)::BIGINT * pow(10, e)::BIGINT) FROM b) AS value_blocks,
      sum(least(n, 60) * (least(n, 60) - 1) // 2)::BIGINT AS pairs, count_if(n > 60) AS oversized_blocks,
      coalesce(sum(CASE WHEN n > 60 THEN n * (n - 1) // 2 END), 0)::BIGINT AS skipped_for_size FROM blocks"""
    ),
)
def pair_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing_report(stored_narrow(spark, sf_dir))


@query(
    "value_bucket_pairs",
    _with(
        """, b AS (SELECT *, round_even(mag::DOUBLE / pow(10.0, floor(log10(mag::DOUBLE)) - 2), 0)::BIGINT * pow(10, floor(log10(mag::DOUBLE)) - 2)::BIGINT AS bucket FROM claims WHERE mag <> 0)
    SELECT x.seq AS a_seq, y.seq AS b_seq FROM b x JOIN b y ON x.bucket = y.bucket AND x.seq < y.seq AND x.subject_id = y.subject_id AND x.predicate_id <> y.predicate_id"""
    ),
)
def value_bucket_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of every bucket."""
    narrow = stored_narrow(spark, sf_dir, "seq", "subject_id", "predicate_id", "kind", "magnitude")
    return value_pairs(narrow, cap=None).select("a_seq", "b_seq")


@query(
    "pairs_deduplicated",
    _with(
        """, b AS (SELECT *, round_even(mag::DOUBLE / pow(10.0, floor(log10(mag::DOUBLE)) - 2), 0)::BIGINT * pow(10, floor(log10(mag::DOUBLE)) - 2)::BIGINT AS bucket FROM claims WHERE mag <> 0),
    s AS (SELECT bucket FROM b GROUP BY 1 HAVING count(*) BETWEEN 2 AND 60)
    SELECT 'same subject and predicate' AS reason, count(*) AS n FROM pairs WHERE a_document_id <> b_document_id
    UNION ALL SELECT 'same subject, equal value under different predicates', count(*) FROM b x JOIN b y ON x.bucket = y.bucket AND x.seq < y.seq AND x.subject_id = y.subject_id AND x.predicate_id <> y.predicate_id
    WHERE x.bucket IN (SELECT bucket FROM s) AND x.document_id <> y.document_id"""
    ),
)
def pairs_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and value pairs across documents, each pair once."""
    return pairs_by_reason(all_pairs(stored_narrow(spark, sf_dir), cross_document=True))


@query("unreliable_period_claims", _with("SELECT seq FROM flagged WHERE unreliable"))
def unreliable_period_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unreliable_periods(stored_narrow(spark, sf_dir)).where("unreliable").select("seq")


@query("contradictions_top", _with("SELECT a_seq, b_seq, confidence, cross_document FROM edges WHERE relation = 'contradiction' ORDER BY cross_document DESC, confidence DESC, a_seq, b_seq LIMIT 50"))
def contradictions_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's fifty first contradictions."""
    return edge_order(_edges(spark, sf_dir).where("relation = 'contradiction'")).limit(50).select("a_seq", "b_seq", "confidence", "cross_document")


@query(
    "edges_page",
    _with("SELECT a_seq, b_seq, relation, confidence FROM edges WHERE relation = 'reconciled' AND cross_document AND (a_document_id = '2' OR b_document_id = '2') ORDER BY confidence DESC, a_seq, b_seq LIMIT 100 OFFSET 50"),
)
def edges_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the relations of one document across documents."""
    page = read_api.relations(_edges(spark, sf_dir), document_id="2", relation="reconciled", cross_document=True, limit=100, offset=50)
    return page.select("a_seq", "b_seq", "relation", "confidence")


@query("claims_search", _with("SELECT seq, raw, predicate_id AS predicate FROM claims WHERE subject_id = 'building' AND predicate_id LIKE '%urgent%' AND basis = 'consolidated' ORDER BY seq LIMIT 200"))
def claims_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_api.claims(order_claims(spark, sf_dir), entity_id="building", predicate="URGENT", basis="consolidated", limit=200)
    return found.select("seq", F.col("value.raw").alias("raw"), F.col("predicate_raw").alias("predicate"))


@query("claim_with_edges", _with("SELECT a_seq, b_seq, relation FROM edges WHERE a_seq = 2 OR b_seq = 2 ORDER BY cross_document DESC, confidence DESC, a_seq, b_seq LIMIT 50"))
def claim_with_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_api.edges_of_claim(_edges(spark, sf_dir), "2").select("a_seq", "b_seq", "relation")


@query(
    "layer_stats",
    _whole("SELECT (SELECT count(*) FROM claims) AS claims, (SELECT count(DISTINCT document_id) FROM claims) AS documents, count_if(relation = 'corroboration') AS corroboration, count_if(relation = 'contradiction') AS contradiction, count_if(relation = 'reconciled') AS reconciled, count_if(relation = 'ambiguous') AS ambiguous, count_if(relation = 'unrelated') AS unrelated, 0::BIGINT AS quarantined, 1.0::DOUBLE AS pass_rate FROM edges"),
)
def layer_stats_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of the layer, with the relations of all pairs of whole blocks."""
    claims = order_claims(spark, sf_dir)
    narrow = flagged(claims)
    return layer_stats(Layer(claims, narrow, None), whole_counts(narrow))


@query(
    "document_subjects",
    _with("SELECT document_id, subject_id, n FROM (SELECT document_id, subject_id, count(*) AS n, min(seq) AS f FROM claims GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY n DESC, f) = 1"),
)
def document_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_subjects(order_claims(spark, sf_dir))


@query(
    "incremental_pairs",
    _with(
        """, old AS (SELECT *, row_number() OVER (PARTITION BY subject_id, predicate_id ORDER BY seq) AS r FROM claims WHERE seq % 10 <> 3)
    SELECT a.seq AS a_seq, b.seq AS b_seq FROM claims a JOIN old b ON a.subject_id = b.subject_id AND a.predicate_id = b.predicate_id AND b.r <= 60 WHERE a.seq % 10 = 3"""
    ),
)
def incremental_pairs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New claims against what is known."""
    n = stored_narrow(spark, sf_dir, "seq", "subject_id", "predicate_id")
    return incremental_pairs(n.where("seq % 10 = 3"), n.where("seq % 10 != 3")).select("a_seq", "b_seq")


@query(
    "explained_contradictions",
    _whole("SELECT a_seq, b_seq, '''' || a_raw || ''' and ''' || b_raw || ''' disagree, and no difference in scope explains it.' AS sentence FROM edges WHERE relation = 'contradiction'"),
)
def explained_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All contradictions of whole blocks, each in a sentence."""
    e = contradictions(flagged(order_claims(spark, sf_dir)))
    return e.select("a_seq", "b_seq", fallback_explanation(F.col("relation"), F.col("axis"), F.col("a_raw"), F.col("b_raw")).alias("sentence"))
