"""Queries over texts that are written from numbers, so that SQL can say what has to be read back from them."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as names
from ..functions.numbers import unit_hint
from ..functions.periods import duration_seconds, iso_date
from ..functions.text import header_path, markdown_table, normalise_rect
from ..operators import canon, columns, evals, extract, repair, routing, spot
from ..operators.evidence import evidence_bounds
from ..plans import read_api
from ..schema import CLAIM_NAMES
from ..session import scratch, stored
from ..sources import checkpoints, documents, ledger
from ..streaming.extend import RegistryStore
from .adapter import order_claims, table
from .core_queries import CLAIMS_SQL
from .layer import build

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str):
    def put(f):
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return put


# Statements of orders: a block each, on the pages of a few documents; what stands where follows from the pieces' lengths.
_STATED = """WITH o AS (SELECT o_orderkey AS k, CAST(o_custkey % 7 AS VARCHAR) AS d, CAST(o_orderkey // 50 AS INT) AS p, format('{:,}', floor(o_totalprice)::BIGINT) AS raw, floor(o_totalprice)::BIGINT AS w,
    strftime(o_orderdate, '%d-%m-%Y') AS dt, CAST(year(o_orderdate) AS VARCHAR) AS y, CAST(10 + o_orderkey % 80 AS VARCHAR) AS pg, o_orderkey % 3 = 0 AS wrapped, o_orderkey % 5 = 0 AS rated FROM orders),
a AS (SELECT *, CASE WHEN wrapped THEN '(' || raw || ')' ELSE raw END AS shown FROM o),
t AS (SELECT *, 'net revenue of ' || shown || ' on ' || dt || ', see page ' || pg || ' for FY' || y || ' items' || CASE WHEN rated THEN ' up ' || pg || '%' ELSE '' END AS text FROM a),
b AS (SELECT *, sum(length(text) + 2) OVER (PARTITION BY d, p ORDER BY k) - 2 - length(text) AS z FROM t),
s AS (
  SELECT d, p, z + 15 AS pos, shown AS text, 'money' AS kind, 'net revenue of ' || shown || ' on ' AS tight, false AS noise FROM b
  UNION ALL SELECT d, p, z + 19 + length(shown), dt, 'date', CASE WHEN wrapped THEN ') on ' ELSE 'on ' END || dt || ', see page ', false FROM b
  UNION ALL SELECT d, p, z + 40 + length(shown), pg, 'quantity', ', see page ' || pg || ' for FY', true FROM b
  UNION ALL SELECT d, p, z + 47 + length(shown), 'FY' || y, 'duration', 'for FY' || y || ' items' || CASE WHEN rated THEN ' up ' ELSE '' END, false FROM b
  UNION ALL SELECT d, p, z + 63 + length(shown), pg, 'percent', 'items up ' || pg || '%', false FROM b WHERE rated)
"""


def stated_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    raw, page = F.format_number(F.floor("o_totalprice").cast("bigint"), 0), (key % 80 + 10).cast("string")
    shown = F.when(key % 3 == 0, F.concat(F.lit("("), raw, F.lit(")"))).otherwise(raw)
    lit = F.lit
    text = F.concat(
        lit("net revenue of "), shown, lit(" on "), F.date_format("o_orderdate", "dd-MM-yyyy"), lit(", see page "), page, lit(" for FY"), F.date_format("o_orderdate", "yyyy"), lit(" items"),
        F.when(key % 5 == 0, F.concat(lit(" up "), page, lit("%"))).otherwise(lit("")),
    )
    rows = o.select((F.col("o_custkey") % 7).cast("string").alias("document_id"), F.floor(key / 50).cast("int").alias("page"), key.cast("int").alias("ord"), lit("paragraph").alias("kind"), text.alias("text"))
    return documents.with_offsets(rows)


@query("stated_spots", _STATED + "SELECT d AS document_id, p AS page, pos::INT AS char_start, (pos + length(text))::INT AS until, kind, text, tight, noise FROM s")
def stated_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every numeral, date and period of the statements, with its place on the page, what is bound to it and its kind."""
    found = spot.spot(stated_blocks(spark, sf_dir))
    return found.select("document_id", "page", F.col("at").alias("char_start"), "until", F.col("spot_kind").alias("kind"), "text", "tight", F.col("noise_hint").alias("noise"))


@query("stated_kinds", _STATED + "SELECT kind AS spot_kind, count(*) AS n FROM s GROUP BY 1")
def stated_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spot.by_kind(spot.spot(stated_blocks(spark, sf_dir)))


@query(
    "stated_pages",
    _STATED + "SELECT d AS document_id, p AS page, count(*) AS total, count_if(NOT noise) AS density, row_number() OVER (PARTITION BY d ORDER BY count_if(NOT noise) DESC, p) AS rank FROM s GROUP BY 1, 2 QUALIFY rank <= 20",
)
def stated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's twenty densest pages."""
    return spot.pages_by_density(spot.spot(stated_blocks(spark, sf_dir)), 20).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "stated_windows",
    _STATED + ", g AS (SELECT d, p, string_agg(text, chr(10) || chr(10) ORDER BY k) AS page FROM b GROUP BY 1, 2) SELECT s.d AS document_id, s.p AS page, s.pos::INT AS char_start, substr(g.page, greatest(pos - 220, 0)::INT + 1, (pos + length(text) + 220 - greatest(pos - 220, 0))::INT) AS around FROM s JOIN g ON s.d = g.d AND s.p = g.p",
)
def stated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page's text around each of them."""
    blocks = stated_blocks(spark, sf_dir)
    return spot.with_window(spot.spot(blocks), documents.page_texts(blocks)).select("document_id", "page", F.col("at").alias("char_start"), F.col("window").alias("around"))


@query("stated_batches", _STATED.rstrip() + ", r AS (SELECT d, p, pos, row_number() OVER (PARTITION BY d, p ORDER BY pos) - 1 AS n FROM s) SELECT d AS document_id, p AS page, pos::INT AS char_start, (n // 24)::INT AS batch, (n % 24)::INT AS i FROM r")
def stated_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates as they are put to a model, 24 at a time."""
    return extract.batches(spot.spot(stated_blocks(spark, sf_dir))).select("document_id", "page", F.col("at").alias("char_start"), "batch", "i")


@query(
    "spot_conversion",
    _STATED + ", c AS (SELECT d, p, count(*) AS n FROM s WHERE kind = 'money' AND p % 2 = 0 GROUP BY 1, 2) SELECT s.d AS document_id, (SELECT sum(n) FROM c WHERE c.d = s.d)::BIGINT AS claims, count_if(NOT noise) AS candidates, round((SELECT sum(n) FROM c WHERE c.d = s.d) / count_if(NOT noise), 4) AS rate FROM s JOIN c ON s.d = c.d AND s.p = c.p GROUP BY 1",
)
def spot_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims for each candidate that is no reference, if the money of every second page became claims."""
    swept = spot.spot(stated_blocks(spark, sf_dir)).select("document_id", "page", "spot_kind", "noise_hint")
    found = stored(swept, "spots")  # the evaluation reads them three times
    return evals.spot_conversion(found.where("spot_kind = 'money' and page % 2 = 0").select("document_id", "page"), found)


@query(
    "prose_pages",
    """WITH b AS (SELECT CAST(conv_id AS VARCHAR) AS d, turn // 3 AS p, turn, length(text) AS whole, trim(text, E' \\n\\t') AS t FROM conversations),
    q AS (SELECT * FROM b WHERE length(t) BETWEEN 60 AND 2000 AND length(regexp_replace(t, '[^0-9]', '', 'g')) <= 0.16 * length(t) AND regexp_matches(t, '[a-z]{3,}\\s+[a-z]{3,}') QUALIFY row_number() OVER (PARTITION BY d, p ORDER BY turn) <= 8),
    r AS (SELECT d, p, sum(whole) AS chars FROM q GROUP BY 1, 2)
    SELECT d AS document_id, p AS page, chars::BIGINT AS chars, row_number() OVER (PARTITION BY d ORDER BY chars DESC, p) AS rank FROM r QUALIFY rank <= 5""",
)
def prose_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's five pages, of three turns, with the most prose."""
    c = table(spark, sf_dir, "conversations")
    blocks = c.select(F.col("conv_id").cast("string").alias("document_id"), F.floor(F.col("turn") / 3).cast("bigint").alias("page"), F.col("turn").alias("ord"), F.lit("paragraph").alias("kind"), "text")
    return extract.prose_ranking(blocks).withColumn("rank", F.col("rank").cast("bigint"))


_RULES = """WITH o AS (SELECT o_orderkey AS k, format('{:,}', floor(o_totalprice)::BIGINT) AS raw, floor(o_totalprice)::BIGINT AS w, year(o_orderdate) AS y FROM orders)
SELECT CAST(k AS VARCHAR) AS document_id, 29::INT AS char_start, (29 + length(raw))::INT AS char_end, 'Revenue from operations' AS predicate, 'Acme' AS subject, 'money' AS kind, 'INR' AS currency, (w * 1000000)::DOUBLE AS magnitude,
  CASE WHEN k % 4 = 0 THEN NULL ELSE make_date(y, 3, 31) END AS p_end, CASE WHEN k % 2 = 0 THEN 'consolidated' ELSE 'unknown' END AS basis, 0.45::DOUBLE AS confidence FROM o"""


@query("rule_statements", _RULES)
def rule_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims read by rules: label, money with its scale, period (cleared where the document is older) and basis."""
    o, lit = table(spark, sf_dir, "orders"), F.lit
    key, year = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy")
    text = F.concat(lit("Revenue from operations was ₹"), F.format_number(F.floor("o_totalprice").cast("bigint"), 0), lit(" million in FY"), year, lit(". See page "), (key % 80 + 10).cast("string"), lit("."))
    blocks = documents.with_offsets(o.select(key.cast("string").alias("document_id"), lit(1).alias("page"), lit(0).alias("ord"), lit("paragraph").alias("kind"), text.alias("text"), key.alias("k"), F.year("o_orderdate").alias("y")))
    none = lit(None).cast("string")
    header = F.when(F.col("k") % 2 == 0, lit("Consolidated"))
    vintage = F.when(F.col("k") % 4 == 0, F.make_date(F.col("y"), lit(1), lit(15))).otherwise(F.make_date(F.col("y"), lit(12), lit(31)))
    c = spot.spot(blocks).withColumns({n: none for n in ("column_header", "row_label", "caption", "context")} | {"header_path": header, "subject": lit("Acme"), "vintage": vintage})
    v, s = F.col("value"), F.col("scope")
    return extract.by_rules(c).select(
        "document_id", "char_start", "char_end", F.col("predicate_raw").alias("predicate"), F.col("subject_raw").alias("subject"), v["kind"].alias("kind"), v["currency"].alias("currency"), v["canonical_magnitude"].cast("double").alias("magnitude"), s["period"]["end"].alias("p_end"), s["basis"].alias("basis"), "confidence"
    )


@query(
    "answered_statements",
    """WITH o AS (SELECT o_orderkey AS k, floor(o_totalprice)::BIGINT AS w FROM orders WHERE o_orderkey % 5 <> 0)
    SELECT CAST(k AS VARCHAR) AS document_id, 'order value' AS predicate, CASE WHEN k % 3 = 0 THEN 'Acme' ELSE 'Beta' END AS subject, (CASE WHEN k % 2 = 0 THEN w * 1000000 ELSE w * 10000000 END)::DOUBLE AS magnitude,
      k % 2 = 0 AS inferred, CASE WHEN k % 2 = 0 THEN 0.6 ELSE 0.85 END::DOUBLE AS confidence, CASE WHEN k % 4 = 1 THEN 'standalone' ELSE 'unknown' END AS basis, CASE k % 7 WHEN 0 THEN 'IND_AS' WHEN 1 THEN 'IFRS' WHEN 2 THEN 'US_GAAP' ELSE 'unknown' END AS accounting,
      CASE WHEN k % 6 = 1 THEN 'projected' ELSE 'unknown' END AS modality, CASE WHEN k % 11 = 0 THEN 'Express' END AS segment FROM o""",
)
def answered_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's answers put to candidates: those that name nothing are dropped, a scale from the caption counts less."""
    o, lit, key = table(spark, sf_dir, "orders"), F.lit, F.col("o_orderkey")
    text = F.concat(lit("it came to "), F.format_number(F.floor("o_totalprice").cast("bigint"), 0), F.when(key % 2 == 0, lit("")).otherwise(lit(" crore")))
    doc = key.cast("string").alias("document_id")
    blocks = documents.with_offsets(o.select(doc, lit(1).alias("page"), lit(0).alias("ord"), lit("paragraph").alias("kind"), text.alias("text"), key.alias("k")))
    none = lit(None).cast("string")
    c = spot.spot(blocks).withColumns({"caption": F.when(F.col("k") % 2 == 0, lit("(₹ in million)")), "context": lit("INR"), "column_header": none, "subject": lit("Acme"), "vintage": lit(None).cast("date")})
    answers = o.select(
        doc, lit(1).alias("page"), lit(0).alias("batch"), lit(0).alias("i"), F.when(key % 5 == 0, lit("7")).otherwise(lit(" order value ")).alias("p"), F.when(key % 3 == 0, lit("n/a")).otherwise(lit("Beta")).alias("s"), lit("FY2020").alias("t"),
        F.when(key % 4 == 1, lit(" Standalone")).otherwise(lit("both")).alias("b"), F.when(key % 11 == 0, lit("Express")).otherwise(lit("None")).alias("g"), F.when(key % 6 == 1, lit("Projected")).otherwise(lit("sure")).alias("m"),
        F.element_at(F.array(lit("Ind AS"), lit("ifrs"), lit("US GAAP"), none, lit("-"), lit("local"), lit("")), (key % 7 + 1).cast("int")).alias("accounting"),
    )
    out = extract.by_answers(extract.batches(c), answers)
    s = F.col("scope")
    return out.select("document_id", F.col("predicate_raw").alias("predicate"), F.col("subject_raw").alias("subject"), F.col("value.canonical_magnitude").cast("double").alias("magnitude"), F.col("scale_inferred").alias("inferred"), "confidence", s["basis"].alias("basis"), s["accounting"].alias("accounting"), s["modality"].alias("modality"), s["segment"].alias("segment"))


# The registry with an embedder that SQL can repeat: counts of the letters a to z.
def letters(text: str) -> np.ndarray:
    low = (text or "").lower()
    counts = np.array([low.count(chr(c)) for c in range(97, 123)], np.float64)
    return counts / (np.sqrt((counts * counts).sum()) or 1.0)


_PARTS_SQL = r"""
  SELECT 'entity' AS kind, trim(regexp_replace(lower(p_brand), '[^\w\s]', ' ', 'g')) AS key, p_brand || CASE WHEN p_partkey % 2 = 0 THEN ' Limited' ELSE ' Ltd.' END AS label, p_partkey AS seq FROM part
  UNION ALL SELECT 'predicate', trim(regexp_replace(regexp_replace(lower(p_name), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')), p_name, p_partkey FROM part"""
_NAMES_SQL = "SELECT 'predicate' AS kind, 'sales of ' || translate(substr(md5(CAST(c_custkey AS VARCHAR)), 1, 14), '0123456789', 'ghijklmnop') AS key, key AS label, c_custkey AS seq FROM customer"


def _registry(mentions: str) -> str:
    """SQL of the decisions (d) on mentions m(kind, key, label, seq)."""
    return f"WITH RECURSIVE m AS ({mentions})," + r"""
k AS (SELECT kind, key, min_by(label, seq) AS label, min(seq) AS first FROM m GROUP BY 1, 2),
l AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY first) AS i, list_transform(range(97, 123), lambda c: (length(label) - length(replace(lower(label), chr(c::INT), '')))::DOUBLE) AS v FROM k),
s AS (
  SELECT DISTINCT kind, 0::BIGINT AS i, []::STRUCT(label VARCHAR, key VARCHAR, v DOUBLE[])[] AS founders, NULL::VARCHAR AS key, NULL::VARCHAR AS label, NULL::BIGINT AS first, NULL::DOUBLE AS best, NULL::VARCHAR AS nearest, NULL::VARCHAR AS nearest_key FROM l
  UNION ALL
  SELECT kind, i, CASE WHEN best >= 0.92 THEN founders ELSE list_append(founders, struct_pack(label := label, key := key, v := v)) END, key, label, first, coalesce(best, 0), CASE WHEN best > 0 THEN founders[pos].label END, CASE WHEN best > 0 THEN founders[pos].key END
  FROM (SELECT *, list_max(sims) AS best, list_position(sims, list_max(sims)) AS pos FROM (
    SELECT s.kind, l.i, s.founders, l.key, l.label, l.first, l.v, list_transform(s.founders, lambda f: round(list_cosine_similarity(f.v, l.v), 12)) AS sims FROM s JOIN l ON l.kind = s.kind AND l.i = s.i + 1))),
d AS (SELECT kind, key, label, first, round(best, 6) AS similarity, nearest, CASE WHEN best >= 0.92 THEN 'merged' WHEN best >= 0.72 THEN 'ambiguous_defaulted_to_new' ELSE 'created' END AS action,
  CASE WHEN best >= 0.92 THEN nearest ELSE label END AS node_label, CASE WHEN best >= 0.92 THEN nearest_key ELSE key END AS node_key FROM s WHERE i > 0)
"""


_REGISTRY = _registry(_PARTS_SQL)


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("seq"), F.concat("p_brand", F.when(F.col("p_partkey") % 2 == 0, " Limited").otherwise(" Ltd.")).alias("subject_raw"), F.col("p_name").alias("predicate_raw"))


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canon.resolve(canon.distinct_labels(canon.label_keys(_parts(spark, sf_dir))), embed=letters, batch=32, floor=0.0)


@query("letter_registry", _REGISTRY + "SELECT kind, key, label, first, sha1(kind || '|' || node_key) AS node_id, node_label, action, similarity, nearest AS nearest_label FROM d")
def letter_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' names resolved to nodes in rounds of 32 keys: the decision on each."""
    return _decided(spark, sf_dir).withColumn("similarity", F.round("similarity", 6))


@query("letter_sentences", _REGISTRY + """SELECT kind, key, CASE action WHEN 'merged' THEN '''' || label || ''' merged into ''' || node_label || ''' (similarity ' || format('{:.3f}', similarity) || ')'
  WHEN 'created' THEN '''' || label || ''' is new' ELSE '''' || label || ''' is close to ''' || nearest || ''' (similarity ' || format('{:.3f}', similarity) || '): new, for review' END AS description FROM d""")
def letter_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canon.describe(_decided(spark, sf_dir)).select("kind", "key", "description")


@query("letter_registry_stats", _REGISTRY + "SELECT kind, count(DISTINCT node_key) AS nodes, count(*) AS labels, count_if(action = 'ambiguous_defaulted_to_new') AS pending_review FROM d GROUP BY 1")
def letter_registry_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canon.stats(_decided(spark, sf_dir))


@query("letter_review", _REGISTRY + "SELECT kind, key, nearest AS nearest_label FROM d WHERE action = 'ambiguous_defaulted_to_new'")
def letter_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that wait for review."""
    return canon.pending_review(_decided(spark, sf_dir)).select("kind", "key", "nearest_label")


@query(
    "letter_mentions",
    _REGISTRY + "SELECT m.kind, CASE WHEN m.seq = d.first THEN d.action WHEN d.node_key = d.key THEN 'exact' ELSE 'alias' END AS action, count(*) AS n FROM m JOIN d ON m.kind = d.kind AND m.key = d.key GROUP BY 1, 2",
)
def letter_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was decided over all mentions."""
    return canon.alias_decisions(canon.label_keys(_parts(spark, sf_dir)), _decided(spark, sf_dir))


@query(
    "letter_canonical",
    _REGISTRY + "SELECT e.seq, sha1('entity|' || de.node_key) AS subject_id, sha1('predicate|' || dp.node_key) AS predicate_id FROM m e JOIN m p ON e.seq = p.seq AND e.kind = 'entity' AND p.kind = 'predicate' JOIN d de ON de.kind = 'entity' AND de.key = e.key JOIN d dp ON dp.kind = 'predicate' AND dp.key = p.key",
)
def letter_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part with its nodes; labels that refer to something else are set aside and do not found nodes."""
    p = _parts(spark, sf_dir)
    odd = spark.createDataFrame([(-1, "the Company", "x"), (-2, " ", "x"), (-3, "Acme", "..."), (-4, None, "x")], "seq bigint, subject_raw string, predicate_raw string")
    claims, _, _ = canon.canonicalise(p.unionByName(odd.withColumn("seq", F.col("seq").cast(p.schema["seq"].dataType))), embed=letters, batch=32, floor=0.0)
    return claims.select("seq", "subject_id", "predicate_id")


@query(
    "letter_failures",
    "SELECT CASE s_suppkey % 4 WHEN 0 THEN 'subject is a referring expression' WHEN 1 THEN 'empty subject' WHEN 2 THEN 'empty predicate' ELSE 'subject normalises to nothing' END AS failure, count(*) AS n FROM supplier GROUP BY 1",
)
def letter_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why labels cannot be resolved."""
    s, k, lit = table(spark, sf_dir, "supplier"), F.col("s_suppkey") % 4, F.lit
    subject = F.when(k == 0, lit("The Company ")).when(k == 1, lit("  ")).when(k == 2, F.col("s_name")).otherwise(lit("Ltd."))
    rows = s.select(F.col("s_suppkey").alias("seq"), subject.alias("subject_raw"), F.when(k == 2, lit("...")).otherwise(lit("sales")).alias("predicate_raw"))
    return canon.label_keys(rows).groupBy("failure").agg(F.count("*").alias("n"))


@query(
    "letter_ontology",
    _REGISTRY + "SELECT kind, sha1(kind || '|' || node_key) AS node_id, min_by(node_label, first) AS label, array_to_string(list_sort(list(DISTINCT label)), '|') AS aliases, count(*) AS n_labels FROM d GROUP BY 1, 2",
)
def letter_ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes with their aliases."""
    return canon.nodes(_decided(spark, sf_dir)).withColumn("aliases", F.array_join("aliases", "|"))


@query("registry_batches", _REGISTRY + "SELECT kind, key, label, first, sha1(kind || '|' || node_key) AS node_id, node_label, action, similarity, nearest AS nearest_label FROM d")
def registry_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts' names folded into a stored registry in three batches, one of which is run twice: the decisions of one resolution."""
    store = RegistryStore(spark, f"{scratch(spark)}/registry-{uuid.uuid4().hex}", letters, floor=0.0, batch=64)
    parts = _parts(spark, sf_dir)
    ends = [r for r in parts.agg(F.percentile_approx("seq", [0.2, 0.6])).first()[0]]
    for n, (low, high) in enumerate(zip([-1, *ends], [*ends, 1 << 62])):
        labels = canon.distinct_labels(canon.label_keys(parts.where((F.col("seq") > low) & (F.col("seq") <= high))))
        for _ in range(1 + (n == 1)):
            store.fold_in(labels, n)
    return store.decisions().withColumn("similarity", F.round("similarity", 6))


@query(
    "registry_many",
    _registry(_NAMES_SQL) + "SELECT key, sha1(kind || '|' || node_key) AS node_id, action, CASE WHEN similarity >= 0.72 THEN similarity ELSE 0 END AS similarity, CASE WHEN similarity >= 0.72 THEN nearest END AS nearest_label FROM d",
)
def registry_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label for each customer: stretches of 100, 300, 1,200 ... keys, of which each looks up the nodes of those before it."""
    c = table(spark, sf_dir, "customer")
    key = F.concat(F.lit("sales of "), F.translate(F.substring(F.md5(F.col("c_custkey").cast("string").cast("binary")), 1, 14), "0123456789", "ghijklmnop"))
    labels = c.select(F.lit("predicate").alias("kind"), key.alias("key"), key.alias("label"), F.col("c_custkey").alias("first"))
    return canon.resolve(labels, embed=letters, batch=100).select("key", "node_id", "action", F.round("similarity", 6).alias("similarity"), "nearest_label")


# Words and labels: pieces chosen by a row's number, so that SQL knows what each function has to say.
@query(
    "label_rules",
    """WITH p AS (SELECT p_partkey AS k, p_brand, p_name FROM part)
    SELECT k, CASE k % 4 WHEN 0 THEN 'Acme' WHEN 1 THEN 'Acme' WHEN 2 THEN p_brand ELSE 'Our Group.' END AS subject, k % 3 <> 0 AS named,
      k % 6 IN (0, 1) AS property, CASE WHEN k % 5 < 4 THEN NULL ELSE p_brand END AS cleaned, CASE k % 3 WHEN 0 THEN 'standalone' WHEN 1 THEN 'consolidated' ELSE 'unknown' END AS basis,
      CASE k % 5 WHEN 0 THEN 'IND_AS' WHEN 1 THEN 'IFRS' WHEN 2 THEN 'US_GAAP' ELSE 'unknown' END AS standard, CASE k % 3 WHEN 0 THEN 'consolidated' WHEN 1 THEN 'standalone' END AS label_basis,
      CASE WHEN k % 2 = 0 THEN 'Acme Brand' || (k % 9) || ' Limited' END AS entity, CASE WHEN k % 2 = 0 THEN 'Acme Brand' || (k % 9) || ' Limited' WHEN k % 3 = 0 THEN p_name ELSE 'Annual Report' END AS fallback, k % 2 = 0 AS refers FROM p""",
)
def label_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k, lit = table(spark, sf_dir, "part"), F.col("p_partkey"), F.lit
    pick = lambda n, *values: F.element_at(F.array(*(v if not isinstance(v, (str, type(None))) else lit(v).cast("string") for v in values)), (k % n + 1).cast("int"))
    subject, entity = pick(4, "The Company.", " we ", F.col("p_brand"), "Our Group."), F.when(k % 4 == 3, lit("")).otherwise(lit("Acme"))
    predicate = pick(6, "net margin", "share of sales", "is rising", "we believe in growth", "share of", "one two three four five six")
    head = F.when(k % 2 == 0, F.concat(lit("this is Acme Brand"), (k % 9).cast("string"), lit(' Limited ("the Company") and more'))).otherwise(lit("no name here"))
    title = F.when(k % 3 == 0, F.col("p_name")).otherwise(pick(2, "abc", "Report.pdf"))
    return p.select(
        k.alias("k"),
        names.resolve_subject(subject, entity).alias("subject"),
        names.names_something(pick(3, "5 %", "EBITDA", "x1 yz")).alias("named"),
        names.is_a_property(predicate, F.col("p_name")).alias("property"),
        names.cleaned(pick(5, " null", "N/A", "-", "", F.col("p_brand"))).alias("cleaned"),
        names.coerced(pick(3, " Standalone", "CONSOLIDATED", "both"), ["standalone", "consolidated"], "unknown").alias("basis"),
        names.accounting_standard(pick(5, "Ind AS 115", "ifrs", "U S GAAP", "none", None)).alias("standard"),
        names.basis_from_label(pick(3, "FY24 Consolidated | FY23", "Stand-alone results", "inconsolidatedly")).alias("label_basis"),
        names.entity_from_self_definition(head).alias("entity"),
        names.entity_fallback(head, title, lit("03-annual_report.pdf")).alias("fallback"),
        names.is_referring(pick(2, " the GROUP ", "group")).alias("refers"),
    )


@query(
    "days_durations_units",
    """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 100 + 0.5 WHEN 1 THEN (o_orderkey % 10) * 60 + 2.5 WHEN 2 THEN (o_orderkey % 1000) / 1000.0 ELSE 0 END::DOUBLE AS seconds,
       CASE o_orderkey % 5 WHEN 0 THEN 't' WHEN 1 THEN 'kg' WHEN 2 THEN 'sqft' WHEN 3 THEN 'count' END AS unit FROM orders""",
)
def days_durations_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates at the head of a text, durations in three spellings, and units by the first word found."""
    o, k, lit = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.lit
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    n = lambda m: (k % m).cast("string")
    duration = F.when(k % 4 == 0, F.concat(n(100), lit(".5s"))).when(k % 4 == 1, F.concat(n(10), lit("m2.5s"))).when(k % 4 == 2, F.concat(n(1000), lit("ms"))).otherwise(lit("xms"))
    unit = F.element_at(F.array(lit("Tonnes sold"), lit("background"), lit("12 sq ft"), lit("people"), lit("litres")), (k % 5 + 1).cast("int"))
    return o.select(k.alias("k"), iso_date(F.when(k % 3 == 0, F.concat(lit("x"), day)).otherwise(F.concat(day, lit("T10:00")))).alias("day"), duration_seconds(duration).alias("seconds"), unit_hint(unit).alias("unit"))


@query(
    "content_ids",
    """WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS s FROM documents), u AS (SELECT *, sha1(unhex('6f4a1c2e9d3b4e578a102c5f7b91d0a4') || encode(s)) AS h FROM h)
    SELECT doc_id, s AS sha256, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (CAST('0x' || substr(h, 17, 1) AS INT) & 3) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS document_id FROM u""",
)
def content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' hashes and the identifiers that follow from them."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha256"))
    return documents.with_document_id(d)


@query(
    "upload_refusals",
    """WITH d AS (SELECT doc_id, source, CASE WHEN doc_id % 5 = 1 THEN '' ELSE coalesce(text, '') END AS c FROM documents), k AS (SELECT DISTINCT sha256(coalesce(text, '')) AS s FROM documents WHERE doc_id % 7 = 0)
    SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'not_pdf' WHEN c = '' THEN 'empty' WHEN sha256(c) IN (SELECT s FROM k) THEN 'duplicate' END AS refusal, 'my-file-' || doc_id AS stem FROM d""",
)
def upload_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads judged: by name, by size and by what is there already."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    text = F.coalesce("text", F.lit("")).cast("binary")
    name = F.concat(F.lit("in box/my file "), k.cast("string"), F.when(k % 5 == 0, F.lit(".doc")).otherwise(F.lit(".PDF")))
    ups = d.select("doc_id", name.alias("filename"), F.when(k % 5 == 1, F.lit(b"")).otherwise(text).alias("content"))
    known = d.where("doc_id % 7 = 0").select(F.sha2(text, 256).alias("sha256"))
    return documents.judge_uploads(ups, known).select("doc_id", "refusal", "stem")


@query(
    "markdown_tables",
    """SELECT s_suppkey AS k, '| name | ' || s_suppkey || ' |\n| --- | --- |\n| a b | c |\n| only |  |' AS shown, 'name | ' || s_suppkey AS path, least(1.0, greatest(0.0, (s_suppkey - 20) / 50.0))::DOUBLE AS x0, 0.5::DOUBLE AS y1 FROM supplier""".replace("\\n", "' || chr(10) || '"),
)
def markdown_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells as a pipe table with its header's path, and a box as shares of its page."""
    s, lit, k = table(spark, sf_dir, "supplier"), F.lit, F.col("s_suppkey")
    rows = F.array(F.array(lit(" name"), k.cast("string")), F.array(lit("a\nb"), lit("c ")), F.array(lit("only")))
    box = normalise_rect(F.struct((k - 20).cast("double").alias("x0"), lit(0.0).alias("y0"), lit(90.0).alias("x1"), lit(40.0).alias("y1")), lit(50.0), lit(80.0))
    return s.select(k.alias("k"), markdown_table(rows).alias("shown"), header_path(rows).alias("path"), box["x0"].alias("x0"), box["y1"].alias("y1"))


@query(
    "evidence_spans",
    """WITH o AS (SELECT o_orderkey AS k, CAST(floor(o_totalprice)::BIGINT AS VARCHAR) AS raw FROM orders)
    SELECT k, CASE k % 3 WHEN 0 THEN 0 WHEN 1 THEN 13 ELSE 0 END::INT AS s, CASE k % 3 WHEN 0 THEN 32 + length(raw) WHEN 1 THEN 36 + length(raw) ELSE 410 END::INT AS e FROM o""",
)
def evidence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to show around a value: a short table whole, a sentence of prose from the last one's end to its line's, a long table's own line."""
    o, lit, k = table(spark, sf_dir, "orders"), F.lit, F.col("o_orderkey")
    raw = F.floor("o_totalprice").cast("string")
    cases = [
        F.concat(lit("| year | value |\n| 1999 | "), raw, lit(" |\nend")),
        F.concat(lit("It was early.\nThe sum came to "), raw, lit(" then.\nLater it rained.")),
        F.concat(F.rpad(F.concat(lit("| value | "), raw, lit(" ")), 410, "-"), lit("\n"), F.repeat(lit("more text\n"), 50)),
    ]
    text = F.when(k % 3 == 0, cases[0]).when(k % 3 == 1, cases[1]).otherwise(cases[2])
    at = F.instr(text, raw) - 1
    b = o.select(k.alias("k"), evidence_bounds(text, at, at + F.length(raw), k % 3 != 1).alias("b"))
    return b.select("k", F.col("b.start").alias("s"), F.col("b.end").alias("e"))


@query(
    "scale_captions",
    """SELECT CAST(s_suppkey AS VARCHAR) AS document_id, CASE WHEN s_suppkey % 2 = 0 THEN '(Rs. in crore)' ELSE 'USD million' END AS caption FROM supplier WHERE s_suppkey % 3 <> 0""",
)
def scale_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first short line of each page that names a scale."""
    s, lit, k = table(spark, sf_dir, "supplier"), F.lit, F.col("s_suppkey")
    named = F.when(k % 3 == 0, lit("plain words")).when(k % 2 == 0, lit(" (Rs. in crore) ")).otherwise(lit("USD million"))
    texts = F.array(lit("A heading"), F.concat(lit("a line that names no less than a million of things and goes on, "), F.repeat(lit("and on "), 6)), named, lit("(₹ in lakh)\nsecond line"))
    b = s.select(k.cast("string").alias("document_id"), lit(1).alias("page"), F.posexplode(texts).alias("ord", "text"))
    return columns.page_scale_captions(b.withColumn("kind", lit("paragraph"))).select("document_id", "caption")


@query(
    "attached_columns",
    """WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, CAST(l_quantity AS INT) AS q FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n, q) AS i, count(*) OVER (PARTITION BY k) AS c FROM l)
    SELECT CAST(k AS VARCHAR) AS document_id, CASE WHEN c = k % 4 + 2 THEN 'FY' || (1994 + i) || ' units' END AS col, CASE WHEN c = k % 4 + 2 THEN 'Quantity shipped' END AS label, CAST(q AS VARCHAR) AS text FROM r WHERE q >= 10
    UNION ALL SELECT CAST(k AS VARCHAR), NULL, NULL, 'FY' || (1994 + i) FROM (SELECT DISTINCT k FROM l), unnest(range(1, k % 4 + 3)) t(i)""",
)
def attached_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numerals of all blocks with the column and the row that they stand in; periods of headers stand in none."""
    from .more_queries import _line_blocks

    blocks = _line_blocks(spark, sf_dir)
    c = columns.attach_columns(spot.spot(blocks), columns.column_cells(blocks))
    return c.select("document_id", F.col("column_header").alias("col"), F.col("row_label").alias("label"), "text")


def _stored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page lines of the order claims: a hundred claims a page, one page in five with a refused claim."""
    c = order_claims(spark, sf_dir)
    e = F.get("evidence", 0)
    paged = c.withColumn("_page", F.floor(F.col("seq") / 100).cast("int")).withColumn("value", F.col("value").withField("canonical_magnitude", F.col("value.canonical_magnitude").cast("string")))
    paged = paged.withColumn("provenance", F.struct(F.lit("rule").alias("extractor"), F.when(F.col("_page") % 2 == 0, "v2").otherwise("v1").alias("prompt_version"), F.lit("run").alias("pipeline_run_id"), F.lit(None).cast("timestamp").alias("extracted_at")))
    one = F.struct(*[x for x in CLAIM_NAMES if x != "seq"])
    paged = paged.withColumns({"stem": F.concat(F.lit("doc "), e["document_id"]), "document": e["document_id"]})
    # by stem and page, as pages that are done are
    pages = paged.groupBy("stem", F.col("_page").alias("page")).agg(F.max("document").alias("document"), F.array_sort(F.collect_list(F.struct("seq", one.alias("c")))).alias("claims"))
    refused = F.when(F.col("page") % 5 == 0, F.array(F.struct(F.get("claims", 0)["c"].alias("claim"), F.lit("quote_mismatch").alias("reason"), F.lit("").alias("detail"))))
    return pages.select("stem", "document", "page", F.transform("claims", lambda x: x["c"]).alias("claims"), refused.alias("quarantined"))


_PAGED = f"WITH {CLAIMS_SQL}, p AS (SELECT document_id, seq // 100 AS page, count(*) AS n, sum(mag) AS total FROM claims GROUP BY 1, 2)"


@query(
    "checkpoint_store",
    _PAGED + " SELECT document_id, 'doc ' || document_id AS stem, count(*) AS pages, sum(n)::BIGINT AS claims, count_if(page % 5 = 0) AS quarantined, (SELECT sum(mag)::DOUBLE FROM claims c WHERE c.document_id = p.document_id) AS total FROM p GROUP BY 1",
)
def checkpoint_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages appended in two goes (the second repeats the first's, which are left out), snapped, and loaded from the snapshot."""
    folder = f"{scratch(spark)}/store-{uuid.uuid4().hex}"
    pages = _stored_pages(spark, sf_dir)
    checkpoints.append_pages(pages.where("page % 3 = 0"), f"{folder}/pages")
    checkpoints.append_pages(pages, f"{folder}/pages", checkpoints.pages_done(spark, f"{folder}/pages"))
    checkpoints.snapshot(spark, f"{folder}/pages", f"{folder}/snapshot")
    claims, _, docs = checkpoints.load_claims(spark, f"{folder}/snapshot")
    total = claims.groupBy(F.get("evidence", 0)["document_id"].alias("document_id")).agg(F.sum("value.canonical_magnitude").cast("double").alias("total"))
    return docs.select("document_id", "stem", "pages", "claims", "quarantined").join(total, "document_id")


@query("checkpoint_refused", _PAGED + " SELECT 'doc ' || document_id AS stem, page::INT AS page, 'quote_mismatch' AS reason FROM p WHERE page % 5 = 0")
def checkpoint_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch(spark)}/store-{uuid.uuid4().hex}"
    checkpoints.append_pages(_stored_pages(spark, sf_dir), folder)
    return checkpoints.load_claims(spark, folder)[1].select("stem", "page", "reason")


@query("checkpoint_versions", _PAGED + " SELECT 'doc ' || document_id AS stem, page::INT AS page FROM p WHERE page % 2 = 1")
def checkpoint_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that have yet to be read again by the second version."""
    folder = f"{scratch(spark)}/store-{uuid.uuid4().hex}"
    checkpoints.append_pages(_stored_pages(spark, sf_dir), folder)
    return checkpoints.pages_todo(checkpoints.pages_done(spark, folder), checkpoints.pages_done(spark, folder, "v2"))


@query("checkpoint_index", _PAGED + " SELECT DISTINCT document_id, document_id AS document FROM p")
def checkpoint_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the first line of each store file; plain files shadow gzipped ones."""
    folder = f"{scratch(spark)}/store-{uuid.uuid4().hex}"
    checkpoints.append_pages(_stored_pages(spark, sf_dir), folder)
    return checkpoints.first_line_index(spark, folder)


@query("ledger_compacted", "SELECT event_type AS provider, count(*) AS n FROM events WHERE CAST(ts AS DATE) > DATE '2024-01-20' - 7 GROUP BY 1")
def ledger_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger that was appended to, read back and, being large, cut to its last days."""
    path = f"{scratch(spark)}/ledger-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events").select(F.lit("usage").alias("t"), F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("provider"), F.lit(1).alias("pt"))
    ledger.append_usage(e, path)
    return ledger.compacted(ledger.read_ledger(spark, path), "2024-01-20", 600_000).groupBy("provider").agg(F.count("*").alias("n"))


@query(
    "repaired_claims",
    f"""WITH {CLAIMS_SQL} SELECT seq, p_end IS NOT NULL AND seq % 2 = 0 AS was_impossible, CASE WHEN seq % 2 = 0 THEN NULL ELSE p_end END AS p_end, CASE WHEN seq % 3 = 0 AND document_id IN ('0', '2', '4') THEN 'IFRS' ELSE 'unknown' END AS accounting,
    CASE WHEN seq % 5 = 0 THEN NULL WHEN seq % 5 = 1 THEN 'cloud:big' ELSE 'rule' END AS extractor FROM claims WHERE seq % 5 <> 2""",
)
def repaired_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored claims after the repairs: impossible periods, unevidenced standards, extractors' names, a version dropped."""
    c, lit, seq = order_claims(spark, sf_dir), F.lit, F.col("seq")
    vintage = F.when(seq % 2 == 0, lit("1980-01-01")).otherwise(lit("2020-01-01")).cast("date")
    scope = F.col("scope").withField("vintage", vintage).withField("accounting", F.when(seq % 3 == 0, lit("IFRS")).otherwise(lit("US_GAAP")))
    made = F.struct(F.when(seq % 5 == 1, lit("cloud")).otherwise(lit("rule")).alias("extractor"), F.when(seq % 5 == 2, lit("bad")).otherwise(lit("v1")).alias("prompt_version"))
    old = c.withColumn("scope", scope).withColumn("provenance", F.when(seq % 5 != 0, made))
    standards = spark.createDataFrame([(str(i), ["IFRS"]) for i in (0, 2, 4)] + [("1", ["IND_AS"])], "document_id string, standards array<string>")
    new = repair.drop_version(repair.name_extractors(repair.clear_unevidenced_accounting(repair.clear_impossible_periods(old), standards), {"cloud": "big"}), "bad")
    return new.select("seq", "was_impossible", F.col("scope.period.end").alias("p_end"), F.col("scope.accounting").alias("accounting"), F.col("provenance.extractor").alias("extractor"))


@query(
    "traced_edges",
    f"""WITH {CLAIMS_SQL} SELECT a_seq, b_seq, CASE WHEN n_diff = 0 THEN 'scopes are identical on every axis' ELSE 'scope differs on: ' || array_to_string(list_filter([CASE WHEN d_period THEN 'period' END, CASE WHEN d_basis THEN 'basis' END, CASE WHEN d_segment THEN 'segment' END], lambda x: x IS NOT NULL), ', ') END AS scopes,
    CASE WHEN agree THEN 'agree' ELSE 'disagree' END AS said, CASE WHEN n_diff = 0 AND agree THEN 'corroboration' WHEN n_diff = 0 AND (undated OR one_page OR doubtful) THEN 'ambiguous' WHEN n_diff = 0 THEN 'contradiction' WHEN n_diff = 1 AND agree THEN 'corroboration across a difference in ' || first_axis
      WHEN n_diff = 1 THEN 'reconciled' ELSE 'ambiguous' END AS last FROM edges WHERE cross_document""",
)
def traced_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparator's own account of each pair across documents."""
    e = build(order_claims(spark, sf_dir), cross_document=True, with_trace=True).edges
    last = F.element_at("trace", -1)
    shown = F.when(last.startswith("→ corroboration across"), F.substr(last, F.lit(3))).otherwise(F.regexp_extract(last, "^→ ([a-z]+)", 1))
    return e.select("a_seq", "b_seq", F.get("trace", 2).alias("scopes"), F.regexp_extract(F.get("trace", 3), "^values ([a-z]+)", 1).alias("said"), shown.alias("last"))


@query(
    "grounding_layers",
    f"WITH {CLAIMS_SQL} SELECT count_if(seq % 50 <> 0) AS grounded, count_if(seq % 50 = 0) AS quarantined, round(count_if(seq % 50 <> 0) / count(*), 4) AS pass_rate, count_if(seq % 50 <> 0) / count(*) >= 0.95 AS passed, round(count_if(seq % 50 <> 0 AND seq % 3 = 0) / count_if(seq % 50 <> 0), 4) AS inferred FROM claims",
)
def grounding_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = order_claims(spark, sf_dir).withColumn("scale_inferred", F.col("seq") % 3 == 0)
    return evals.grounding_layer(c.where("seq % 50 != 0"), c.where("seq % 50 = 0"))


@query(
    "estimated_tokens",
    """WITH c AS (SELECT l_suppkey % 10 AS d, l_partkey % 50 AS p, l_orderkey AS o, l_linenumber AS l, length(format('{:.2f}', l_extendedprice)) AS n FROM lineitem),
    b AS (SELECT *, (row_number() OVER (PARTITION BY d, p ORDER BY o, l, n) - 1) // 24 AS b FROM c), g AS (SELECT d, p, b, count(*) AS n, sum(n) AS chars FROM b GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY p, b) - 1 AS i, count(*) OVER (PARTITION BY d) AS k FROM g)
    SELECT CAST(d AS VARCHAR) AS document_id, sum(n)::BIGINT AS candidates, count(*) AS requests,
      ceil(count(*) * avg(CASE WHEN k <= 12 OR i = 0 OR i * 12 // k <> (i - 1) * 12 // k THEN chars + 1200 END) / 3.4 + sum(n) * 58)::BIGINT AS tokens FROM r GROUP BY 1""",
)
def estimated_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the lines taken as candidates, from at most twelve batches of each document."""
    li = table(spark, sf_dir, "lineitem")
    tight = F.format_string("%.2f", "l_extendedprice")
    c = li.select((F.col("l_suppkey") % 10).cast("string").alias("document_id"), (F.col("l_partkey") % 50).alias("page"), F.col("l_orderkey").alias("at"), F.col("l_linenumber").alias("until"), tight.alias("tight"))
    return routing.estimate_tokens(extract.batches(c))


@query("measured_chars_per_token", "SELECT l_suppkey AS k, CASE WHEN sum(l_partkey) >= 2000 THEN round(count(*) * 1000 / sum(l_partkey), 6) END AS rate FROM lineitem GROUP BY 1")
def measured_chars_per_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters for each prompt token, where enough tokens were counted."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.sum("l_partkey").alias("t"), F.count("*").alias("n"))
    return li.select("k", F.round(routing.chars_per_token(F.col("n") * 1000, F.col("t")), 6).alias("rate"))


@query(
    "ontology_page",
    _REGISTRY + ", n AS (SELECT kind, sha1(kind || '|' || node_key) AS node_id, min_by(node_label, first) AS label, count(DISTINCT label) AS n FROM d GROUP BY 1, 2) SELECT kind, node_id, label FROM n WHERE kind = 'predicate' ORDER BY n DESC, label LIMIT 10",
)
def ontology_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten measures with the most names."""
    return read_api.ontology(canon.nodes(_decided(spark, sf_dir)), "predicate", 10).select("kind", "node_id", "label")
