
import random

import pytest
from pyspark.sql import functions as F

from statemesh.functions.numbers import parse_value, rounding_tolerance, value_bucket
from statemesh.functions.periods import parse_period
from statemesh.operators import curate, tally
from statemesh.operators.compare import compare_pairs
from statemesh.operators.pairing import NARROW, all_pairs, capped_blocks, exact_pairs, incremental_pairs, pairing_report, unreliable_periods, value_pairs, whole_pairs
from statemesh.plans import more_queries
from statemesh.plans.layer import contradictions, corroborations

DEFAULT = dict(raw="61,451", context="(Rs. in millions)", period="FY24", basis="unknown", segment=None, geography=None, accounting="unknown", modality="unknown", document="d1", page=1, confidence=0.9, subject="acme", predicate="revenue from operations", unreliable=False)
FIELDS = ", ".join(f"{k} {'int' if k == 'page' else 'double' if k == 'confidence' else 'boolean' if k == 'unreliable' else 'string'}" for k in DEFAULT)


def claims(spark, *given):
    rows = [(i, *{**DEFAULT, "page": i, **g}.values()) for i, g in enumerate(given, 1)]
    df = spark.createDataFrame(rows, f"seq bigint, {FIELDS}")
    v, p = parse_value(F.col("raw"), F.col("context")), parse_period(F.col("period"))
    full = df.withColumns({"v": v, "p": p})
    return full.select(
        F.col("seq").cast("string").alias("id"),
        "seq",
        F.col("subject").alias("subject_id"),
        F.col("predicate").alias("predicate_id"),
        F.col("subject").alias("subject_raw"),
        F.col("predicate").alias("predicate_raw"),
        "v.kind",
        "raw",
        F.col("v.canonical_magnitude").alias("magnitude"),
        rounding_tolerance(F.col("v.canonical_magnitude"), F.col("raw")).alias("tolerance"),
        "v.currency",
        F.col("v.date_value").alias("date_value"),
        F.col("v.text_value").alias("text_value"),
        F.col("v.bool_value").alias("bool_value"),
        F.col("v.range_low").alias("range_low"),
        F.col("v.range_high").alias("range_high"),
        F.col("p.start").alias("p_start"),
        F.col("p.end").alias("p_end"),
        "basis",
        "segment",
        "geography",
        "accounting",
        "modality",
        F.col("document").alias("document_id"),
        "page",
        "confidence",
        "unreliable",
    ).select(*NARROW)


def judge(spark, a, b):
    return compare_pairs(exact_pairs(claims(spark, a, b)), with_trace=True).first()


CASES = [
    ({}, dict(raw="6,145", context="(₹ in crore)"), "corroboration", None, 0.9),
    (dict(basis="consolidated"), dict(raw="81,400", basis="consolidated"), "contradiction", None, 0.9),
    (dict(period="FY23"), dict(raw="81,400"), "reconciled", "period", 0.9),
    (dict(basis="consolidated"), dict(raw="81,400", basis="standalone"), "reconciled", "basis", 0.9),
    (dict(modality="reported"), dict(raw="81,400", modality="projected"), "reconciled", "modality", 0.9),
    (dict(segment="Express"), dict(raw="81,400"), "reconciled", "segment", 0.9),
    (dict(segment=""), {}, "corroboration", None, 0.9),
    (dict(period="9MFY24"), dict(raw="81,400"), "reconciled", "period", 0.9),
    (dict(period="FY23"), {}, "corroboration", "period", 0.72),
    (dict(period="FY23", segment="Express"), dict(raw="81,400"), "ambiguous", None, 0.54),
    (dict(period=""), dict(raw="81,400"), "ambiguous", None, 0.45),
    (dict(page=7), dict(raw="81,400", page=7), "ambiguous", None, 0.45),
    (dict(page=7), dict(raw="81,400", page=7, document="d2"), "contradiction", None, 0.9),
    (dict(unreliable=True), dict(raw="81,400"), "ambiguous", None, 0.45),
    (dict(raw="6.3 to 6.8 per cent", context=""), dict(raw="6.5%", context=""), "corroboration", None, 0.9),
    (dict(raw="6.3 to 6.8 per cent", context=""), dict(raw="5.1%", context=""), "contradiction", None, 0.9),
    (dict(raw="6.5%", context=""), dict(raw="6.4%", context=""), "contradiction", None, 0.9),
    (dict(raw="8.2%", context=""), dict(raw="820 bps", context=""), "corroboration", None, 0.9),
    (dict(raw="1,000", context="₹"), dict(raw="1,000", context="$"), "contradiction", None, 0.9),
    (dict(raw="NIL", context="INR"), dict(raw="1,200 crore", context="INR"), "contradiction", None, 0.9),
    (dict(confidence=0.5), {}, "corroboration", None, 0.5),
]


@pytest.mark.parametrize("a,b,relation,axis,confidence", CASES)
def test_relations(spark, a, b, relation, axis, confidence):
    e = judge(spark, a, b)
    assert (e["relation"], e["axis"]) == (relation, axis)
    assert e["confidence"] == pytest.approx(confidence)
    assert len(e["trace"]) == 7 and e["trace"][-1].startswith("→")


def test_other_subjects_and_predicates_never_meet(spark):
    n = claims(spark, {}, dict(subject="other"), dict(predicate="profit"), dict(subject=None))
    assert exact_pairs(n).count() == 0
    edges = compare_pairs(all_pairs(n), keep_unrelated=True).collect()
    assert {e["relation"] for e in edges} == {"unrelated"} and len(edges) == 1


def test_a_page_with_two_values_for_one_period_is_unreliable(spark):
    n = claims(spark, dict(page=3), dict(page=3, raw="81,400"), dict(page=3, period="FY23", raw="5"), dict(page=4))
    assert [r["unreliable"] for r in unreliable_periods(n).orderBy("seq").collect()] == [True, True, False, False]


def test_large_blocks_are_cut_to_the_most_confident(spark):
    n = claims(spark, *(dict(confidence=0.1 + i / 100) for i in range(8)), dict(predicate="profit"))
    kept = capped_blocks(n, cap=3).where("predicate_id != 'profit'").orderBy("rn").collect()
    assert [r["seq"] for r in kept] == [8, 7, 6]
    assert exact_pairs(n, cap=3).count() == 3
    r = pairing_report(n, cap=3).first().asDict()
    assert r == {"claims": 9, "exact_blocks": 2, "value_blocks": 1, "pairs": 3, "oversized_blocks": 1, "skipped_for_size": 28}
    assert [x["seq"] for x in capped_blocks(n, cap=60).where("predicate_id != 'profit'").orderBy("rn").collect()] == list(range(1, 9))


def test_new_claims_come_first_and_meet_the_first_known(spark):
    n = claims(spark, {}, {}, {}, {})
    pairs = incremental_pairs(n.where("seq = 4"), n.where("seq < 4"), cap=2).collect()
    assert sorted((p["a_seq"], p["b_seq"]) for p in pairs) == [(4, 1), (4, 2)]


def test_value_buckets_round_half_to_even(spark):
    data = ["61451000000", "61450000000", "61550000000", "0.08245", "0.08255", "9999", "10000", "-61451000000", "0"]
    df = spark.createDataFrame([(m,) for m in data], "m string")
    got = [r[0] for r in df.select(value_bucket(F.lit("money"), F.col("m").cast("decimal(38,10)"))).collect()]
    assert got == ["money:615:8", "money:614:8", "money:616:8", "money:824:-4", "money:826:-4", "money:100:2", "money:100:2", "money:-615:8", None]


def test_empty_claims(spark):
    n = claims(spark, {}).limit(0)
    assert compare_pairs(exact_pairs(n)).count() == 0
    assert pairing_report(n).first()["pairs"] == 0


def test_value_buckets_beyond_the_cap_give_all_pairs(spark):
    n = claims(spark, *(dict(predicate=f"measure {i % 4}") for i in range(70)), dict(subject="other", predicate="measure 9"))
    want = {(a, b) for a in range(1, 71) for b in range(a + 1, 71) if (a - b) % 4}
    assert value_pairs(n).count() == 0
    pairs = value_pairs(n, cap=None).select("a_seq", "b_seq").collect()
    assert len(pairs) == len(want) and {tuple(p) for p in pairs} == want


def test_whole_blocks_in_tiles_give_each_pair_once(spark):
    n = claims(spark, *(dict(confidence=0.1 + i / 200) for i in range(65)), dict(segment="Express"), dict(subject=None))
    want = {(a, b) for a in range(1, 66) for b in range(a + 1, 66)}
    for tile in (7, 65, 1000):
        pairs = whole_pairs(n, ["subject_id", "segment"], tile).select("a_seq", "b_seq").collect()
        assert len(pairs) == len(want) and {tuple(p) for p in pairs} == want
    assert exact_pairs(n, cap=None).count() == 66 * 65 // 2


def _many(spark, n, seed):
    """Claims near each other's limits, coarse and fine, on few pages, with some that are no plain numbers."""
    pick = random.Random(seed).choice
    raws = ["61,451", "61,452", "61,758", "61,759", "61,144", "61,145", "61,146", "6,145", "0", "0.0", "7", "8", "9", "(7)", "-61,451", "(61,758)", "200", "201", "199", "1", "200.0", "201.0", "199.0", "0.5", "100,000", "100,500", "100,501", "99,500", "1,00,502"]
    odd = ["6.5%", "6.3 to 6.8 per cent", "10 to 20", "12", "no number"]
    given = [
        dict(
            raw=pick(raws) if pick(range(9)) else pick(odd),
            context=pick(["(Rs. in millions)", "(Rs. in millions)", "(₹ in crore)", "$", ""]),
            period=pick(["FY24", "FY24", "FY23", ""]),
            basis=pick(["unknown", "consolidated", "standalone"]),
            segment=pick([None, "", "Express"]),
            document=pick(["d1", "d2", "d3", None]),
            page=pick([1, 2]),
            unreliable=pick([False, False, True]),
            subject=pick(["acme", "acme", "acme", "other", None]),
        )
        for _ in range(n)
    ]
    return claims(spark, *given)


@pytest.mark.parametrize("seed,size,tile", [(1, 50_000, 20_000), (2, 10, 40), (3, 1, 20_000)])
def test_relations_are_counted_as_they_are_formed(spark, monkeypatch, seed, size, tile):
    n = _many(spark, 260, seed).cache()
    monkeypatch.setattr(tally, "AT_ONCE", 100)
    formed = {r["relation"]: r["count"] for r in compare_pairs(exact_pairs(n, cap=None)).groupBy("relation").count().collect()}
    counted = {r["relation"]: r["n"] for r in tally.relation_totals(n, size, tile).collect() if r["n"]}
    assert counted == formed and len(formed) == 4 and sum(formed.values()) > 60 * 59 // 2


def test_counts_of_no_claims(spark):
    assert tally.relation_totals(claims(spark, {}).limit(0)).where("n != 0").count() == 0


def test_contradictions_and_corroborations_are_those_of_whole_blocks(spark):
    n = _many(spark, 260, 4).cache()
    gap = F.expr("try_divide(cast(abs(a_magnitude - b_magnitude) as double), cast(abs(a_magnitude) as double))")
    formed = compare_pairs(exact_pairs(n, cap=None)).withColumn("gap", gap).cache()
    capped = compare_pairs(exact_pairs(n))
    shown = lambda df: sorted((r["a_seq"], r["b_seq"], r["axis"], r["confidence"]) for r in df.collect())
    want = shown(formed.where("relation = 'contradiction'"))
    assert shown(contradictions(n)) == want and len(want) > capped.where("relation = 'contradiction'").count()
    near = shown(formed.where("relation = 'corroboration' and gap <= 0.005"))
    assert shown(corroborations(n)) == near and len(near) > capped.where("relation = 'corroboration'").count()
    across = "a_document_id != b_document_id"
    assert shown(corroborations(n, across)) == shown(formed.where(f"relation = 'corroboration' and a_magnitude = b_magnitude and gap = 0 and {across}"))


def test_the_best_are_the_best_of_all(spark, monkeypatch):
    some = more_queries.case1_best(spark, "/root/testdata/sf0.001").collect()
    monkeypatch.setattr(curate, "UNEQUAL_MOST", 1000)  # so that equal values alone never settle it
    assert more_queries.case1_best(spark, "/root/testdata/sf0.001").collect() == some and len(some) == 20
