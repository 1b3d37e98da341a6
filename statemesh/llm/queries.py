"""Queries of this subpackage over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .katz import katz_scores

    return katz_scores(_table(spark, sf_dir, "documents"), order=3)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), _path("byte_bpe_50k.json"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import STATISTICS, quality_rules

    judged = quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), columns=["doc_id"])
    return judged.select("doc_id", *STATISTICS, "base_failed", "kept", "anomaly")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import key_of, pseudonymise

    return pseudonymise(_table(spark, sf_dir, "documents"), key_of(spark)).select("doc_id", "text", "n_private")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), _path("word_bpe_49k.json"), with_ids=False)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .wu_manber import decontaminate

    found = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), columns=["doc_id"])
    return found.drop("spans")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import page_round_trip

    return page_round_trip(_table(spark, sf_dir, "pages"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(_table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"), with_text=False)


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op11_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .debruijn import remove_passages

    return remove_passages(_table(spark, sf_dir, "documents"), with_text=False)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_middle import fill_middle, restored

    made = fill_middle(_table(spark, sf_dir, "documents"), columns=["doc_id"])
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    text = F.col("output")
    digests = sha(text).alias("output_sha256"), sha(restored(text, F.col("form"))).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import verified_rows

    return verified_rows(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op4_pii": op4_pii,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_near_dup": op10_near_dup,
    "op1_katz": op1_katz,
    "op2_token_counts": op2_token_counts,
    "op3_quality_rules": op3_quality_rules,
    "op5_packing": op5_packing,
    "op6_decontamination": op6_decontamination,
    "op7_warc": op7_warc,
    "op8_sharding": op8_sharding,
    "op11_passages": op11_passages,
    "op12_fill_middle": op12_fill_middle,
    "op13_merkle": op13_merkle,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Where SQL can say the whole result. The others are held against plain versions in the tests.
ORACLE: dict[str, str] = {
    "op6_decontamination": f"""
WITH i AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS l, array_to_string(ws[k : k + least(len(ws), 10) - 1], ' ') AS g
  FROM i, unnest(range(1, greatest(1, len(ws) - 9) + 1)) t(k) WHERE len(ws) > 0),
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
dw AS (SELECT doc_id, k, z.l, array_to_string(ws[k : k + z.l - 1], ' ') AS g FROM d CROSS JOIN (SELECT DISTINCT l FROM iw) z, unnest(range(1, len(ws) - z.l + 2)) t(k)),
h AS (SELECT doc_id, k, dw.l, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.l = iw.l),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM h, unnest(range(k, k + l)) t(j) GROUP BY 1),
o AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM h GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN o USING (doc_id)""",
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), q AS (SELECT *, sha1(h) AS s, min(page_id) OVER (PARTITION BY h) AS f FROM p),
c AS (SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substr(s, CAST(i * 5 + 1 AS INT), 5) AS INT)) AS v FROM q)
SELECT page_id, strlen(h) AS payload_bytes, array_to_string(list_transform(v, lambda x: array_to_string(list_transform([15, 10, 5, 0],
  lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> b) & 31) + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to FROM c""",
    "op9_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, k, substr(h, 2 * k - 1, 200) AS g FROM d, unnest(range(1, n - 98)) t(k) WHERE n >= 100),
f AS (SELECT doc_id, k FROM w QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, k) > 1),
b AS (SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM f),
i AS (SELECT doc_id, k, sum(CASE WHEN before IS NULL OR k > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM b),
r AS (SELECT doc_id, run, min(k) AS s, max(k) + 100 AS e FROM i GROUP BY 1, 2),
p AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 1) AS prior FROM r),
a AS (SELECT doc_id, string_agg(substr(h, 2 * prior - 1, 2 * (s - prior)), '' ORDER BY s) AS head, max(e) AS last, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans
  FROM p JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 1) - 1))) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)""",
    "op10_near_dup": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[k : k + 4], ' ') AS g FROM w, unnest(range(1, greatest(1, len(ws) - 4) + 1)) t(k) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.m = e.a),
c AS (SELECT doc_id, min(m) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)""",
    "op11_passages": """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, k, array_to_string(ws[k : k + 34], ' ') AS g FROM w, unnest(range(1, len(ws) - 33)) t(k) WHERE len(ws) >= 35),
f AS (SELECT doc_id, k FROM g QUALIFY count(*) OVER (PARTITION BY g) > 1),
c AS (SELECT DISTINCT doc_id, j FROM f, unnest(range(k, k + 35)) t(j)),
u AS (SELECT doc_id, j, ws[j] AS v FROM w, unnest(range(1, len(ws) + 1)) t(j)),
r AS (SELECT doc_id, count(*) AS n FROM c GROUP BY 1),
o AS (SELECT u.doc_id, string_agg(v, ' ' ORDER BY j) AS kept FROM u ANTI JOIN c ON u.doc_id = c.doc_id AND u.j = c.j GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(r.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN r USING (doc_id) LEFT JOIN o USING (doc_id)""",
    "op12_fill_middle": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS x, sha256('42:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS ts FROM documents),
n AS (SELECT doc_id, x, ts, len(ts) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS v FROM d),
f AS (SELECT *, least(v[1] % (n + 1), v[2] % (n + 1)) AS a, greatest(v[1] % (n + 1), v[2] % (n + 1)) AS b,
  CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR v[3] % 100 >= 50 THEN 'plain' WHEN v[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT doc_id, x, n, form, array_to_string(ts[1 : a], '') AS pre, array_to_string(ts[a + 1 : b], '') AS mid, array_to_string(ts[b + 1 :], '') AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(x) AS restored_sha256 FROM p""",
    "op13_merkle": """
WITH RECURSIVE c AS (SELECT *, CASE WHEN list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ord(s) AS BIGINT))),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)) IS NULL THEN false
  ELSE xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ord(s) AS BIGINT))),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) % 7 = 0 END AS hit FROM documents),
e AS (SELECT doc_id, lang, n_chars, hit, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
  coalesce(strlen(text) || ':' || text, '-') AS body FROM c),
d AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || body) AS leaf,
  sha256(head || coalesce(strlen(CAST(n_chars + CAST(hit AS INT) AS VARCHAR)) || ':' || (n_chars + CAST(hit AS INT)), '-') || body) AS changed,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS idx FROM e),
l(lang, k, nodes) AS (SELECT lang, 0, list(leaf ORDER BY idx) FROM d GROUP BY lang UNION ALL
  SELECT lang, k + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM l WHERE len(nodes) > 1),
s AS (SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM l WHERE len(nodes) = 1),
u(k, nodes) AS (SELECT 0, list(subroot ORDER BY g) FROM s UNION ALL
  SELECT k + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM u WHERE len(nodes) > 1),
p AS (SELECT doc_id, k, idx >> k AS i, nodes FROM d JOIN l ON d.lang IS NOT DISTINCT FROM l.lang WHERE len(nodes) > 1
  UNION ALL SELECT doc_id, k + 1000, g >> k, nodes FROM d JOIN s ON d.lang IS NOT DISTINCT FROM s.lang JOIN u ON len(u.nodes) > 1),
q AS (SELECT doc_id, k, CASE WHEN i % 2 = 1 THEN nodes[i] ELSE '' END AS b, CASE WHEN i % 2 = 0 THEN coalesce(nodes[i + 2], '') ELSE '' END AS a FROM p),
t AS (SELECT doc_id, string_agg(b || a, '' ORDER BY k) AS proof, list({'b': b, 'a': a} ORDER BY k) AS steps FROM q GROUP BY 1),
o AS (SELECT d.doc_id, leaf, subroot, (SELECT nodes[1] FROM u WHERE len(nodes) = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
  struct_extract(list_reduce(list_prepend({'b': changed, 'a': ''}, coalesce(steps, [])), lambda x, y: {'b': sha256(y.b || x.b || y.a), 'a': ''}), 'b') AS folded_root
  FROM d JOIN s ON d.lang IS NOT DISTINCT FROM s.lang LEFT JOIN t USING (doc_id))
SELECT *, folded_root = root AS verified FROM o""",
}
