import gzip
import json

from statemesh.schema import CLAIM_FIELDS, CLAIM_NAMES
from statemesh.sources import checkpoints, ledger
from statemesh.streaming.extend import LayerStore, extend, stream_claims


def stored_claim(i, magnitude="1E+3", document="doc-a", page=1):
    return {
        "id": f"c{i}",
        "subject_raw": "Acme",
        "predicate_raw": "revenue",
        "value": {"kind": "money", "raw": "1,000", "canonical_magnitude": magnitude},
        "scope": {"period": {"kind": "unknown"}, "basis": "unknown"},
        "evidence": [{"document_id": document, "page": page, "quote": "1,000"}],
        "confidence": 0.5,
    }


def line(page, claims, document="A", quarantined=()):
    return json.dumps({"page": page, "document": document, "document_sha256": "x", "claims": claims, "quarantined": list(quarantined)})


def test_checkpoints(spark, tmp_path):
    torn = '{"page": 3, "claims": [{"id": "c'
    (tmp_path / "a.jsonl").write_text("\n".join([line(1, [stored_claim(1), stored_claim(2, None)]), line(2, [], quarantined=[{"claim": stored_claim(9), "reason": "empty_quote"}]), torn]))
    for stem, text in (("a", line(1, [stored_claim(5)])), ("b", line(1, [stored_claim(3, document="doc-b")], "B"))):
        with gzip.open(tmp_path / f"{stem}.jsonl.gz", "wt") as f:
            f.write(text)
    claims, refused, docs = checkpoints.load_claims(spark, str(tmp_path))
    rows = claims.orderBy("seq").collect()
    assert [r["id"] for r in rows] == ["c1", "c2", "c3"]
    assert rows[0]["value"]["canonical_magnitude"] == 1000 and rows[1]["value"]["canonical_magnitude"] is None
    assert [(r["page"], r["reason"]) for r in refused.collect()] == [(2, "empty_quote")]
    assert {(r["stem"], r["document_id"], r["pages"], r["claims"], r["quarantined"]) for r in docs.collect()} == {("a", "doc-a", 2, 2, 1), ("b", "doc-b", 1, 1, 0)}
    assert {tuple(r) for r in checkpoints.first_line_index(spark, str(tmp_path)).collect()} == {("doc-a", "A"), ("doc-b", "B")}
    assert [r["name"] for r in checkpoints.signature(spark, str(tmp_path)).collect()] == ["a.jsonl"]
    done = checkpoints.pages_done(spark, str(tmp_path))
    pages = spark.createDataFrame([("a", 1), ("a", 7)], "stem string, page int")
    assert [tuple(r) for r in checkpoints.pages_todo(pages, done).collect()] == [("a", 7)]
    checkpoints.snapshot(spark, str(tmp_path), str(tmp_path / "snap"))
    assert spark.read.schema(checkpoints.LINES).json(str(tmp_path / "snap")).where("page is not null").count() == 3


def test_appended_pages_are_gzipped_and_placed_pages_stay(spark, tmp_path):
    pages = spark.sql("select 'a' as stem, cast(id as int) as page, 'A' as document from range(9)").repartition("stem", "page")
    checkpoints.append_pages(pages.where("page < 4"), str(tmp_path))
    checkpoints.append_pages(pages, str(tmp_path), checkpoints.pages_done(spark, str(tmp_path)))
    names = [f.name for f in tmp_path.rglob("*.json*") if not f.name.startswith(".")]
    assert names and all(n.endswith(".json.gz") for n in names)
    assert sorted(r["page"] for r in checkpoints.pages_done(spark, str(tmp_path)).collect()) == list(range(9))
    docs = checkpoints.load_claims(spark, str(tmp_path))[2]
    assert "Window" not in docs._jdf.queryExecution().executedPlan().toString()
    assert [(r["document_id"], r["pages"]) for r in docs.collect()] == [("a", 9)]


def test_an_empty_folder(spark, tmp_path):
    (tmp_path / "x.txt").write_text("no checkpoint")
    claims, refused, docs = checkpoints.load_claims(spark, str(tmp_path))
    assert claims.count() == refused.count() == docs.count() == 0


def test_ledger(spark, tmp_path):
    p = tmp_path / "l.jsonl"
    p.write_text("\n".join(['{"t":"usage","at":"2024-01-10T01:00:00","provider":"g","pt":5,"ct":2,"req":1,"chars":20}', "torn {", '{"t":"reconcile","at":"2024-01-01T02:00:00","provider":"g","req_remaining":7}']))
    df = ledger.read_ledger(spark, str(p))
    assert df.count() == 2
    assert ledger.compacted(df, "2024-01-10", 1_000_000).count() == 1 and ledger.compacted(df, "2024-01-10", 10).count() == 2


def claims_frame(spark, ids):
    rows = [(str(i), i, "acme", "revenue", "Acme", "revenue", f"{1000 + i},000", float(1000 + i) * 1e3) for i in ids]
    df = spark.createDataFrame(rows, "id string, seq bigint, subject_id string, predicate_id string, subject_raw string, predicate_raw string, raw string, m double")
    return df.selectExpr(
        "id",
        "seq",
        "subject_id",
        "predicate_id",
        "subject_raw",
        "predicate_raw",
        "named_struct('kind','money','raw',raw,'canonical_magnitude',cast(m as decimal(38,10)),'currency','INR','unit',cast(null as string),'ratio_basis',cast(null as string),'date_value',cast(null as date),'text_value',cast(null as string),'bool_value',cast(null as boolean),'range_low',cast(null as decimal(38,10)),'range_high',cast(null as decimal(38,10))) as value",
        "named_struct('period',named_struct('kind','interval','label','FY24','start',date'2023-04-01','end',date'2024-03-31','convention','IN_APR_MAR'),'basis','unknown','segment',cast(null as string),'geography',cast(null as string),'accounting','unknown','modality','unknown','vintage',cast(null as date)) as scope",
        "array(named_struct('document_id',cast(seq % 2 as string),'page',cast(seq as int),'char_start',0,'char_end',1,'quote','q','rects',cast(array() as array<struct<x0:double,y0:double,x1:double,y1:double>>),'block_id',cast(null as string),'kind','primary')) as evidence",
        "0.9D as confidence",
        "false as scale_inferred",
        "cast(null as struct<extractor:string,prompt_version:string,pipeline_run_id:string,extracted_at:timestamp>) as provenance",
    ).select(*CLAIM_NAMES)


def edge_set(df):
    return {(min(r["a_seq"], r["b_seq"]), max(r["a_seq"], r["b_seq"]), r["relation"]) for r in df.collect()}


def test_extend_equals_rebuild_and_knows_what_it_knows(spark):
    from statemesh.plans.layer import build

    every = claims_frame(spark, range(12))
    _, one = extend(claims_frame(spark, []), every.where("seq < 7"))
    fresh, two = extend(every.where("seq < 7"), every)
    assert fresh.count() == 5
    assert edge_set(one) | edge_set(two) == edge_set(build(every).edges)
    again, none = extend(every, every)
    assert again.count() == 0 and none.count() == 0


def test_a_stream_of_claims_folds_in_and_repeats_change_nothing(spark, tmp_path):
    from statemesh.plans.layer import build

    source, store = str(tmp_path / "in"), LayerStore(spark, str(tmp_path / "layer"))
    claims_frame(spark, range(5)).write.parquet(source)
    stream = spark.readStream.schema(CLAIM_FIELDS).parquet(source)
    stream_claims(stream, store, str(tmp_path / "cp")).awaitTermination()
    claims_frame(spark, range(3, 9)).write.mode("append").parquet(source)
    stream_claims(spark.readStream.schema(CLAIM_FIELDS).parquet(source), store, str(tmp_path / "cp")).awaitTermination()
    assert store.claims().count() == 9
    want = edge_set(build(claims_frame(spark, range(9))).edges)
    assert edge_set(store.edges()) == want
    store.fold_in(claims_frame(spark, range(3, 9)), 1)
    assert edge_set(store.edges()) == want and store.claims().count() == 9


def test_what_was_stored_can_be_dropped(spark):
    from statemesh.session import clear_stored, stored, stored_by

    df = spark.createDataFrame([(1, "a"), (2, "b")], "k bigint, v string")
    one, two = stored(df, "one"), stored_by(df, "two", "k", 2)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect())) == [(1, "a"), (2, "b")]
    files = one.inputFiles()
    assert clear_stored(spark) >= 2 and clear_stored(spark) == 0
    import os

    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)
