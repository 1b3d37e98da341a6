from pyspark.sql import functions as F

from statemesh.operators import canon, columns, evals, extract, ground, repair, routing, spot
from statemesh.operators.evidence import evidence_span
from statemesh.sources import documents

PAGE = "Revenue from operations stood at 61,451 million in FY24, against 57,902 million."


def claim(i, raw, quote, start=0, end=None, page=1, kind="primary"):
    e = (dict(document_id="d", page=page, char_start=start, char_end=len(quote) if end is None else end, quote=quote, kind=kind),)
    return (str(i), {"raw": raw}, list(e))


CLAIM = "id string, value struct<raw:string>, evidence array<struct<document_id:string,page:int,char_start:int,char_end:int,quote:string,kind:string>>"


def test_grounding(spark):
    rows = [
        claim(1, "61,451", PAGE),
        claim(2, "61 451", PAGE),
        claim(3, "99,999", PAGE),
        claim(4, "61,451", PAGE.replace("stood at", "was")),
        claim(5, "61,451", PAGE, end=500),
        claim(6, "61,451", PAGE, page=9),
        claim(7, "61,451", "  ", end=3),
        ("8", {"raw": "61,451"}, []),
        claim(9, "61,451", PAGE.replace(" in ", "\n in  "), end=len(PAGE)),
        ("10", {"raw": "61,451"}, claim(0, "", PAGE, page=9)[2] + claim(0, "", PAGE)[2]),
        ("11", {"raw": "61,451"}, None),
    ]
    pages = spark.createDataFrame([("d", 1, PAGE)], "document_id string, page int, text string")
    got = {r["id"]: r["reason"] for r in ground.verify(spark.createDataFrame(rows, CLAIM), pages).collect()}
    assert got == {"1": None, "2": None, "3": "value_not_in_quote", "4": "quote_mismatch", "5": "span_out_of_range", "6": "page_not_found", "7": "empty_quote", "8": "no_evidence", "9": None, "10": None, "11": "no_evidence"}
    good, bad = ground.gate(spark.createDataFrame(rows, CLAIM), pages)
    assert (good.count(), bad.count()) == (4, 7)
    assert ground.report(ground.verify(spark.createDataFrame([], CLAIM), pages)).first()["pass_rate"] == 0


def test_registry(spark):
    names = ["Northwind Limited", "Northwind Ltd", "the Company", "", "Acme Corp", "Northwind Limitd", None]
    rows = [(i, n, "revenue from operations") for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "seq bigint, subject_raw string, predicate_raw string")
    claims, failed, decisions = canon.canonicalise(df, merge=0.7, create=0.3)
    ids = {r["seq"]: r["subject_id"] for r in claims.collect()}
    assert ids[0] == ids[1] == ids[5] != ids[4]
    assert {r["seq"] for r in failed.collect()} == {2, 3, 6}
    d = {(r["kind"], r["key"]): r["action"] for r in decisions.collect()}
    assert d[("entity", "northwind limitd")] == "merged" and d[("entity", "northwind")] == "created"
    counts = {(r["kind"], r["action"]): r["n"] for r in canon.alias_decisions(canon.label_keys(df), decisions).collect()}
    assert counts[("entity", "exact")] == 1 and counts[("predicate", "exact")] == 3
    assert canon.nodes(decisions).where("kind = 'entity'").count() == 2


def test_rounds_give_the_decisions_of_one_pass(spark):
    import random

    import pandas as pd

    from statemesh.functions.embeddings import hashed_trigrams

    r = random.Random(2)
    words = ["revenue", "revenues", "profit", "profits", "net", "gross", "total", "operations", "operating", "margin"]
    names = list(dict.fromkeys(" ".join(r.choices(words, k=r.randint(1, 3))) for _ in range(150)))
    rows = [(kind, f"k {n}", n, 10 * i + (kind == "predicate")) for kind in ("entity", "predicate") for i, n in enumerate(names[:: 1 if kind == "entity" else 3])]
    labels = spark.createDataFrame(rows, "kind string, key string, label string, first bigint")
    shown = ["kind", "key", "node_label", "action", "similarity", "nearest_label"]
    one, many = (sorted(map(tuple, canon.resolve(labels, batch=b, floor=0.0).select(*shown).collect()), key=str) for b in (4096, 11))
    assert one == many and len({x[3] for x in one}) == 3
    plain = canon.leader_pass(pd.DataFrame([x[1:] for x in rows if x[0] == "entity"], columns=["key", "label", "first"]), hashed_trigrams)
    assert sorted(zip(plain["key"], plain["action"])) == sorted((x[1], x[3]) for x in one if x[0] == "entity")


def test_registry_asks_between_the_thresholds(spark):
    import pandas as pd

    from statemesh.functions.embeddings import hashed_trigrams

    labels = pd.DataFrame({"key": ["a", "b"], "label": ["revenue from operations", "revenue from contracts"], "first": [1, 2]})
    actions = [list(canon.leader_pass(labels, hashed_trigrams, 0.99, 0.1, f)["action"]) for f in (None, lambda a, b: True, lambda a, b: False)]
    assert actions == [["created", "ambiguous_defaulted_to_new"], ["created", "llm_merged"], ["created", "llm_created"]]


def spotted(text):
    return [(s[3], s[2]) for s in spot.spots_of(text)]


def test_spots():
    assert spotted("on 31.03.2024 in Q4 FY24 we had 1,23,456 and 7 left") == [("31.03.2024", "date"), ("Q4 FY24", "duration"), ("1,23,456", "quantity")]
    assert spotted("grew 12.4% to Rs. 6,145 crore") == [("12.4", "percent"), ("6,145", "money")]
    assert spotted("2.8 Bn shipments") == [("2.8", "quantity")]
    assert [s[5] for s in spot.spots_of("see page 47 and 58 others")] == [True, False]
    assert spotted("a loss of (2,345) million") == [("(2,345)", "money")]
    tight = spot.spots_of("Rs. 6,145 crore, an increase of 12.4% over")[0][4]
    assert "%" not in tight and "crore" in tight


BLOCK = "document_id string, page int, ord int, kind string, text string"
HEADER = "| Particulars | Standalone | | Consolidated | |\n| --- | --- | --- | --- | --- |\n| | FY24 | FY23 | FY24 | FY23 |"


def test_columns(spark):
    body = "Revenue from operations\n6,204.50\n6,658.00\n8,141.54\n6,145.30\nOther income\n1,000\n2,000"
    df = documents.with_offsets(spark.createDataFrame([("d", 1, 0, "table", HEADER), ("d", 1, 1, "paragraph", body), ("d", 1, 2, "paragraph", "(Rs. in millions)")], BLOCK))
    cells = columns.column_cells(df).orderBy("start").collect()
    assert [c["column"] for c in cells] == ["Standalone FY24", "Standalone FY23", "Consolidated FY24", "Consolidated FY23"]
    assert {c["row_label"] for c in cells} == {"Revenue from operations"}
    text = documents.page_texts(df).first()["text"]
    assert [text[c["start"] : c["end"]] for c in cells] == ["6,204.50", "6,658.00", "8,141.54", "6,145.30"]
    assert sorted(len(r["cells"]) for r in columns.numeric_runs(df).collect()) == [2, 4]
    assert columns.page_scale_captions(df).first()["caption"] == "(Rs. in millions)"
    c = columns.attach_columns(spot.spot(df.where("ord = 1")), columns.column_cells(df))
    assert c.where("text = '8,141.54'").first()["column_header"] == "Consolidated FY24"


def test_rule_claims(spark):
    text = "Revenue from operations was ₹61,451 million in FY24. See page 47."
    blocks = documents.with_offsets(spark.createDataFrame([("d", 1, 0, "paragraph", text)], BLOCK))
    none = F.lit(None).cast("string")
    c = spot.spot(blocks).withColumns({n: none for n in ("header_path", "column_header", "row_label", "caption", "context")} | {"subject": F.lit("Acme"), "vintage": F.lit(None).cast("date")})
    got = extract.by_rules(c).collect()
    assert [(r["predicate_raw"], r["value"]["kind"], float(r["value"]["canonical_magnitude"]), str(r["scope"]["period"]["end"])) for r in got] == [("Revenue from operations", "money", 61451e6, "2024-03-31")]
    assert extract.by_rules(c.limit(0)).count() == 0


def test_answers_and_facts(spark):
    blocks = documents.with_offsets(spark.createDataFrame([("d", 1, 0, "paragraph", "Margin was 12.5% of sales and 1,200 people left")], BLOCK))
    c = spot.spot(blocks).withColumns({n: F.lit(None).cast("string") for n in ("column_header", "caption", "context")} | {"subject": F.lit("Acme"), "vintage": F.lit(None).cast("date")})
    a = spark.createDataFrame([("d", 1, 0, 0, "margin", None, "FY24", "Consolidated", None, "reported", "IFRS"), ("d", 1, 0, 1, "5", None, None, None, None, None, None), ("d", 1, 0, 9, "x y", None, None, None, None, None, None)], "document_id string, page int, batch int, i int, p string, s string, t string, b string, g string, m string, accounting string")
    got = extract.by_answers(extract.batches(c), a).collect()
    assert [(r["predicate_raw"], r["subject_raw"], r["scope"]["basis"], r["scope"]["accounting"], r["confidence"]) for r in got] == [("margin", "Acme", "consolidated", "IFRS", 0.85)]
    prose = spark.createDataFrame([("d", 1, 0, "Deloitte is the auditor\nof the Company", "Acme")], "document_id string, page int, ord int, text string, entity string")
    said = spark.createDataFrame([("d", 1, 0, 0, "the Company", "auditor", "Deloitte", "entity"), ("d", 1, 0, 1, "THE company", "Auditor", "deloitte", "entity"), ("d", 1, 0, 2, "x", "auditor", "KPMG", "entity"), ("d", 1, 0, 3, "x", "is the", "Deloitte", "text")], "document_id string, page int, ord int, n int, s string, p string, v string, k string")
    claims, refused = extract.facts(prose, said)
    assert [(r["subject_raw"], r["value"]["kind"]) for r in claims.collect()] == [("Acme", "entity")]
    assert sorted(r["why"] for r in refused.collect()) == ["not a property", "not verbatim"]


def test_adjudicator_guards(spark):
    e = spark.createDataFrame([("1", "2", 1, 2, "ambiguous", None, 0.5, ["period"], True), ("1", "3", 1, 3, "ambiguous", None, 0.4, ["basis"], False), ("2", "3", 2, 3, "ambiguous", None, 0.3, [], False)], "a_id string, b_id string, a_seq int, b_seq int, relation string, axis string, confidence double, diffs array<string>, dated boolean")
    a = spark.createDataFrame([("1", "2", "reconciled", "period", 0.95), ("1", "3", "reconciled", "period", 0.6), ("2", "3", "contradiction", None, 0.6)], "a_id string, b_id string, relation string, axis string, confidence double")
    got = {(r["a_id"], r["b_id"]): (r["relation"], r["axis"], r["confidence"], r["refused"]) for r in extract.adjudicated(e, a).collect()}
    assert got == {("1", "2"): ("reconciled", "period", 0.7, False), ("1", "3"): ("ambiguous", None, 0.4, True), ("2", "3"): ("ambiguous", None, 0.3, True)}
    prose = spark.createDataFrame([("They conflict.", "corroboration"), ("They agree.", "corroboration")], "t string, r string")
    assert [x[0] for x in prose.select(extract.contradicts_verdict(F.col("t"), F.col("r"))).collect()] == [True, False]


def test_evidence_span():
    text = "First is here.\nSecond has 61,451\nin it. Third ends.\n" + "More words follow here.\n" * 20
    a, b = evidence_span(text, text.index("61"), text.index("61") + 6, False)
    assert text[a:b].strip() == "Second has 61,451\nin it."
    assert evidence_span("short 72", 6, 8, False) == (0, 8)
    assert evidence_span("| a |\n| 72 |", 8, 10, True) == (0, 12)
    long = "\n".join(f"line {i} has words" for i in range(60))
    a, b = evidence_span(long, long.index("line 30"), long.index("line 30") + 7, False)
    assert b - a <= 340 and "line 30 has words" in long[a:b] and a > 0


def test_repairs(spark):
    df = spark.createDataFrame([("a (1,234) b", "1,234"), ("a 1,234 b", "1,234"), ("a (1,234) 1,234", "1,234")], "t string, r string")
    assert [x[0] for x in df.select(repair.sign_outcome(F.col("t"), F.col("t"), F.col("r"))).collect()] == ["negated", "unchanged", "ambiguous"]
    assert df.select(repair.occurrences(F.col("t"), F.lit(""))).first()[0] == 0


def test_routing(spark):
    pages = spark.createDataFrame([("d", 1, 5), ("d", 2, 200), ("d", 3, 40), ("d", 4, 0)], "document_id string, page int, density int")
    plan = lambda s: [r["page"] for r in routing.plan_pages(pages, s).orderBy("rank").collect()]
    assert plan(1e9) == [2, 3, 1] and plan(1) == [2]
    c = spark.createDataFrame([("d", 1, i // 24, "x" * 100) for i in range(48)], "document_id string, page int, batch int, tight string")
    e = routing.estimate_tokens(c).first()
    assert (e["candidates"], e["requests"]) == (48, 2)
    tiers = lambda left, **k: routing.route(routing.estimate_tokens(c), F.lit(left), F.lit(10), **k).first()["tier"]
    assert (tiers(10**6), tiers(0), tiers(0, local=False)) == ("cloud", "local", "rules")


def test_arithmetic_ignores_small_and_oversized_groups(spark):
    rows = [("g", 1, "total", 30.0), ("g", 2, "a", 10.0), ("g", 3, "b", 20.0), ("h", 4, "total", 1.0), ("h", 5, "a", 1.0)]
    rows += [(None, 10, "aggregate", 5.0), (None, 11, "a", 2.0), (None, 12, "b", 2.0)]
    rows += [("big", 100 + i, "total" if i == 0 else "x", 1.0) for i in range(61)]
    df = spark.createDataFrame(rows, "k string, seq bigint, predicate_raw string, m double").withColumn("magnitude", F.col("m").cast("decimal(38,10)"))
    assert {(r["seq"], r["satisfied"]) for r in evals.arithmetic(df, ["k"]).collect()} == {(1, True), (10, False)}


def test_uploads(spark):
    rows = [("a.pdf", b"x"), ("b.txt", b"y"), ("c.pdf", b""), ("dir\\d e.pdf", b"known")]
    known = spark.createDataFrame([("0" * 64,)], "sha256 string").unionByName(spark.createDataFrame([(bytearray(b"known"),)], "c binary").select(F.sha2("c", 256).alias("sha256")))
    got = {r["filename"]: (r["refusal"], r["stem"]) for r in documents.judge_uploads(spark.createDataFrame([(a, bytearray(b)) for a, b in rows], "filename string, content binary"), known).collect()}
    assert got == {"a.pdf": (None, "a"), "b.txt": ("not_pdf", "b"), "c.pdf": ("empty", "c"), "dir\\d e.pdf": ("duplicate", "d-e")}


def test_pairs_by_reason_names_a_reason_without_pairs(spark):
    from statemesh.operators.pairing import SAME_BLOCK, SAME_VALUE, pairs_by_reason

    pairs = spark.createDataFrame([(SAME_BLOCK,), (SAME_BLOCK,)], "reason string")
    assert {r["reason"]: r["n"] for r in pairs_by_reason(pairs).collect()} == {SAME_BLOCK: 2, SAME_VALUE: 0}


def nodes_of(df, name):
    """How often a physical operator stands in the plan."""
    return df._jdf.queryExecution().executedPlan().toString().count(name)


def test_candidates_are_swept_once_for_their_columns(spark):
    body = "Units\n10\n20\n30"
    df = documents.with_offsets(spark.createDataFrame([("d", 1, 0, "table", "| a | FY24 | FY23 | FY22 |\n| - |\n| b |"), ("d", 1, 1, "paragraph", body)], BLOCK))
    cells = columns.column_cells(df)
    # of cells that meet, the first counts
    cells = cells.unionByName(cells.withColumns({"start": F.col("start") - 1, "column": F.concat("column", F.lit(" first"))}).where("column = 'FY23 b first'"))
    c = columns.attach_columns(spot.spot(df), cells)
    assert nodes_of(c, "MapInArrow") == 1
    got = {(r["text"], r["column_header"], r["row_label"]) for r in c.collect()}
    assert got == {("10", "FY24 b", "Units"), ("20", "FY23 b first", "Units"), ("30", "FY22 b", "Units"), ("FY24", None, None), ("FY23", None, None), ("FY22", None, None)}


def test_headers_of_odd_tables(spark):
    rows = [("| a |\n| b |", None), ("no table", None), ("| x | FY24 |\n| y |", None), ("| x | FY24 | FY23 |", None), ("| x | FY24 | | FY23 |\n| | a | b |", ["FY24 a", "FY24 b", "FY23 b"]), ("", None)]
    df = spark.createDataFrame([(str(i), 1, 0, "table", t) for i, (t, _) in enumerate(rows)], BLOCK)
    grid = df.select("document_id", columns.combined_header(columns.header_cells(F.col("text"))).alias("x"))
    assert {r["document_id"]: r["x"] for r in grid.collect()}["4"] == rows[4][1]
    assert {r["document_id"]: r["labels"] for r in columns.header_layouts(df).collect()} == {"4": ["FY24 a", "FY24 b", "FY23 b"]}


def test_odd_spots():
    found = [("2020-21", "duration"), ("3M FY21", "duration"), ("22", "quantity"), ("FY23", "duration"), ("5 Mays 2020", "date"), ("ſep. 12 2020", "date"), ("1-2-2020", "date")]
    assert spotted("12020-21 13M FY21 xxFY22 aFY23 5 Mays 2020 7 ſep. 12 2020 1-2-2020-3") == found
    assert spot.spots_of("Row\n12%  34")[1][4] == "Row\n  34"
    assert [s[4] for s in spot.spots_of("(12 bn) 34")] == ["(12 bn) ", ") 34"]
    assert [s[5] for s in spot.spots_of("page" + " " * 300 + "12 " + "x" * 300 + " 13")] == [True, False]


def test_kinds_are_searched_only_where_signs_stand(monkeypatch):
    class Counted:
        def __init__(self, pattern):
            self.pattern, self.calls = pattern, 0

        def search(self, *a):
            self.calls += 1
            return self.pattern.search(*a)

    counted = [(name, Counted(pattern)) for name, pattern in spot._KINDS]
    monkeypatch.setattr(spot, "_KINDS", counted)
    assert spotted("sold 12,345 of 67,890 units") == [("12,345", "quantity"), ("67,890", "quantity")]
    assert [c.calls for _, c in counted] == [0, 0]
    assert spotted("cash of 12,345") == [("12,345", "money")] and spotted("é ₹12,345") == [("12,345", "money")]


def test_conversion_sweeps_once(spark, monkeypatch):
    from statemesh.plans import checked_queries

    swept = []
    monkeypatch.setattr(checked_queries, "stored", lambda df, name: swept.append(name) or df.localCheckpoint())
    got = checked_queries.spot_conversion(spark, "/root/testdata/sf0.001")
    assert swept == ["spots"] and nodes_of(got, "MapInArrow") == 0


def test_rules_read_each_value_once(spark):
    """What filters and fields are read from is no expression that each of them computes again."""
    blocks = documents.with_offsets(spark.createDataFrame([("d", 1, 0, "paragraph", PAGE)], BLOCK))
    none = F.lit(None).cast("string")
    c = spot.spot(blocks).withColumns({n: none for n in ("header_path", "column_header", "row_label", "caption", "context")} | {"subject": F.lit("Acme"), "vintage": F.lit(None).cast("date")})
    plan = extract.by_rules(c)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("thousand crore") < 20  # scale words: 39 where filters and fields have each value anew
    assert plan.count("regexp_extract_all(") < 6
