"""Layouts, standards, cells by bins, and what arrives in streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from statemesh.operators import columns, extract
from statemesh.sources import checkpoint_stream, layout
from statemesh.streaming import events as streams
from statemesh.streaming import pacing

SPANS = "document_id string, page int, block int, line int, span int, text string, bold boolean, size double, x0 double, y0 double, x1 double, y1 double"
PAGES = "document_id string, page int, x0 double, y0 double, x1 double, y1 double"
TABLES = "document_id string, page int, table int, rows array<array<string>>, x0 double, y0 double, x1 double, y1 double"


def share(a, b):
    w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
    area = (a[2] - a[0]) * (a[3] - a[1])
    return w * h / area if area else 0


def test_text_within_tables_is_found_as_by_all_pairs(spark):
    r = random.Random(6)
    box = lambda most: (x := r.randint(-20, 620), y := r.randint(-20, 820), x + r.randint(0, most), y + r.randint(0, most))
    blocks = [(f"d{r.randint(0, 2)}", 1, i, box(120)) for i in range(300)] + [("d0", 1, 900, (5, 5, 5, 9)), ("none", 1, 901, (0, 0, 9, 9))]
    tables = [(f"d{r.randint(0, 2)}", 1, i, box(400)) for i in range(20)]
    frame = lambda rows, name: spark.createDataFrame(rows, f"document_id string, page int, {name} int, box struct<x0:double,y0:double,x1:double,y1:double>")
    floats = lambda rows: [(*x[:3], tuple(map(float, x[3]))) for x in rows]
    pages = spark.createDataFrame([(f"d{i}", 1, 0.0, 0.0, 600.0, 800.0) for i in range(3)], PAGES)
    found = layout.within_tables(frame(floats(blocks), "block"), frame(floats(tables), "table"), pages).collect()
    want = {(b[0], b[2], t[2]) for b in blocks for t in tables if b[0] == t[0] and share(b[3], t[3]) > 0.6}
    assert len(found) == len(want) > 5 and {(r["document_id"], r["block"], r["table"]) for r in found} == want

    told = layout.with_inside(frame(floats(blocks), "block"), frame(floats(tables), "table"), pages).collect()
    inside = {(d, b) for d, b, _ in want}
    assert len(told) == len(blocks) and {(r["document_id"], r["block"]) for r in told if r["inside"]} == inside


def test_text_is_moved_once_for_a_page_layout(spark):
    from statemesh.plans import round_queries

    for name in ("page_layout", "text_in_tables"):
        plan = round_queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "Reused" not in line]
        assert len(moved) <= 6 and not any("block" in line.split("hashpartitioning")[1] for line in moved)


def test_blocks_of_a_page(spark):
    spans = [
        ("d", 1, 0, 0, 0, "Title", True, 10.0, 60.0, 50.0, 160.0, 60.0),
        ("d", 1, 1, 1, 1, "b", False, 9.0, 60.0, 70.0, 70.0, 80.0),
        ("d", 1, 1, 1, 0, "a", False, 9.0, 50.0, 70.0, 60.0, 80.0),
        ("d", 1, 1, 0, 0, " ", False, 9.0, 50.0, 60.0, 60.0, 70.0),
        ("d", 1, 2, 0, 0, "cell", False, 9.0, 210.0, 310.0, 230.0, 320.0),
        ("d", 1, 3, 0, 0, " \n", None, None, 10.0, 10.0, 20.0, 20.0),
        ("d", 1, 4, 0, 0, "x" * 121, True, 20.0, 10.0, 700.0, 20.0, 710.0),
    ]
    tables = [("d", 1, 0, [["a", None], ["1", "2"]], 200.0, 300.0, 400.0, 500.0), ("d", 1, 1, [], 0.0, 0.0, 600.0, 800.0)]
    pages = spark.createDataFrame([("d", 1, 10.0, 0.0, 610.0, 800.0), ("e", 1, 0.0, 0.0, 0.0, 0.0)], PAGES)
    found = layout.page_blocks(spark.createDataFrame(spans, SPANS), spark.createDataFrame(tables, TABLES), pages).orderBy("ord").collect()
    assert [(r["ord"], r["kind"], r["text"]) for r in found] == [(0, "table", "| a |  |\n| --- | --- |\n| 1 | 2 |"), (1, "heading", "Title"), (2, "paragraph", "ab"), (3, "paragraph", "x" * 121)]
    text = "\n\n".join(r["text"] for r in found)
    assert all(text[r["char_start"] : r["char_end"]] == r["text"] for r in found)
    assert found[1]["rect"]["x0"] == pytest.approx(50 / 600) and found[0]["header_path"] == "a"


def test_a_candidate_gets_the_first_cell_that_holds_it(spark):
    r = random.Random(2)
    cells, at = [], 0
    for i in range(60):
        n = r.choice([1, 5, 40, 700])
        cells.append(("d", 1 + i % 2, at, at + n, f"c{i}", f"r{i}"))
        at += n + r.randint(0, 3)
    cells += [("d", 1, 10, 4000, "wide", "wide"), ("d", 1, 7, 7, "empty", "empty")]
    asked = [("d", p, x, x + 1) for p in (1, 2, 3) for x in range(0, at, 37)]
    c = spark.createDataFrame(cells, "document_id string, page int, start bigint, end bigint, column string, row_label string")
    a = spark.createDataFrame(asked, "document_id string, page int, at int, until int").withColumn("row_label", F.lit("old"))
    found = {(r["page"], r["at"]): r["column_header"] for r in columns.attach_columns(a, c).collect()}
    first = lambda p, x: min(((s, n) for _, q, s, e, n, _ in cells if q == p and s <= x < e), default=(0, None))[1]
    assert found == {(p, x): first(p, x) for _, p, x, _ in asked}


def test_standards_near_phrases(spark):
    text = lambda n: "prepared under" + "x" * (n - 14) + "ifrs"
    rows = [("a", text(239)), ("b", text(240)), ("c", text(241)), ("d", "IFRS is named here"), ("e", None), ("f", ""), ("g", "US GAAP, basis of preparation"), ("h", "ind as " * 3 + "in compliance with")]
    found = sorted(map(tuple, extract.evidenced_standards(spark.createDataFrame(rows, "document_id string, text string")).collect()))
    assert found == [("a", "IFRS"), ("b", "IFRS"), ("g", "US_GAAP"), ("h", "IND_AS")]


def read_on(spark, folder, out):
    lines = spark.readStream.format("statemesh_checkpoints").option("path", str(folder)).load()
    rows = checkpoint_stream.pages(lines).select("stem", "at", "page", "document")
    rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return sorted((r["stem"], r["page"], r["document"]) for r in spark.read.schema(rows.schema).parquet(f"{out}/rows").collect())


def test_a_torn_line_is_read_once_it_is_complete(spark, tmp_path):
    spark.dataSource.register(checkpoint_stream.CheckpointSource)
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    line = lambda n: json.dumps({"page": n, "document": f"é {n}", "claims": []}, ensure_ascii=False).encode() + b"\n"
    a, b = folder / "a.jsonl", folder / "b.jsonl"
    a.write_bytes(line(1) + line(2)[:13])
    b.write_bytes(line(7)[:-1])
    assert read_on(spark, folder, out) == [("a", 1, "é 1")]
    a.write_bytes(line(1) + line(2) + b"not json\n\n" + line(3))
    b.write_bytes(line(7) + line(8)[:20])
    (folder / "c.txt").write_bytes(line(9))
    seen = [("a", 1, "é 1"), ("a", 2, "é 2"), ("a", 3, "é 3"), ("b", 7, "é 7")]
    assert read_on(spark, folder, out) == seen == read_on(spark, folder, out)
    b.write_bytes(line(7) + line(8))
    assert read_on(spark, folder, out) == [*seen, ("b", 8, "é 8")]


@pytest.mark.parametrize("piece", [7, 50, 1 << 20])
def test_pieces_of_a_file_have_each_line_once(tmp_path, monkeypatch, piece):
    monkeypatch.setattr(checkpoint_stream, "PIECE", piece)
    monkeypatch.setattr(checkpoint_stream, "BACK", 11)
    r = random.Random(piece)
    lines = ["x" * r.randint(1, 30) for _ in range(40)]
    (tmp_path / "f.jsonl").write_text("\n".join(lines) + "\n" + "torn")
    reader = checkpoint_stream._Reader({"path": str(tmp_path)})
    end = reader.latestOffset()
    got = [x for p in reader.partitions(reader.initialOffset(), end) for x in reader.read(p)]
    assert [x[2] for x in got] == lines and len({x[1] for x in got}) == 40
    assert list(end.values()) == [len("\n".join(lines)) + 1] and reader.partitions(end, end) == []
    short = {k: v + 100 for k, v in end.items()}
    assert len([x for p in reader.partitions(short, end) for x in reader.read(p)]) == 40  # it got shorter: read anew


def test_streams_and_tables_give_the_same_rows(spark):
    rows = [(1, 0, 7, 1.0), (2, 100, 7, 2.0), (3, 5000, 7, 4.0), (1, 0, 7, 1.0), (4, 200, 8, None)]
    e = spark.createDataFrame(rows, "event_id bigint, s bigint, user_id bigint, value double").withColumn("ts", F.timestamp_seconds("s"))
    assert streams.first_deliveries(e, ["event_id"]).count() == 4
    one = streams.first_deliveries(e, ["event_id"])
    assert sorted((r["user_id"], r["n"]) for r in streams.sessions(one, ["user_id"]).collect()) == [(7, 1), (7, 2), (8, 1)]
    assert streams.sliding_counts(one, ["user_id"]).agg(F.sum("n")).first()[0] == 16
    assert sorted((r["first_id"], r["then_id"]) for r in streams.followed(one, one, ["user_id"]).collect()) == [(1, 1), (1, 2), (2, 2), (3, 3), (4, 4)]


def test_paced_calls_are_those_of_one_client_a_provider(spark, tmp_path):
    r = random.Random(21)
    base, maybe = 1_700_000_000_000_000, lambda v, p: None if r.random() < p else v
    calls = [("hot" if r.random() < 0.6 else f"p{r.randint(0, 3)}", i, base + i * 20_000_000 + r.randint(0, 3) * 500, r.randint(0, 4000), maybe(r.randint(0, 9000), 0.2), maybe(r.randint(0, 200) * 1_000_000, 0.2)) for i in range(400)]
    calls += [("hot", 400 + i, calls[7][2], 900, 0, 5_000_000) for i in range(5)]  # ties in time
    calls += [(None, 900, base, 1, 1, 1), ("p1", 901, None, 1, 1, 1)]  # neither provider nor time: left out
    ddl = "provider string, call_id bigint, at timestamp, needed bigint, remaining bigint, reset_us bigint"
    frame = lambda rows: spark.createDataFrame(rows, ddl.replace("at timestamp", "us bigint")).select("provider", "call_id", F.timestamp_micros("us").alias("at"), "needed", "remaining", "reset_us")
    parts = [calls[:150], calls[150:300], calls[300:], [("end", 999, base + 10**12, 0, None, None)]]
    for part in parts:  # each file is out of order
        frame(r.sample(part, len(part))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with pacing.with_state_store(spark):
        run = pacing.paced(stream, "3 hours").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        run.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {(x["provider"], x["call_id"]): (x["waited_us"], x["starts_us"]) for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {}
    for provider in {c[0] for c in calls if c[0]}:
        left = resets = None
        clock = 0
        for _, i, at, needed, remaining, reset in sorted((c for c in calls if c[0] == provider and c[2]), key=lambda c: (c[2], c[1])):
            clock = max(clock, at)
            if left is not None and not left > 2 * needed and resets is not None and clock < resets:
                clock, left = clock + min(resets - clock + 250_000, 70_000_000), None
            left = remaining if remaining is not None else left
            resets = clock + reset if reset is not None else resets
            want[provider, i] = (clock - at, clock)
    assert {k: v for k, v in got.items() if k[0] != "end"} == want
    assert sum(w > 0 for w, _ in want.values()) > 40
