"""The pipeline's stages, each on a small table with nulls, repeats and clashing columns."""

import corpus_pipeline
from test_dedup import brute_components

from statemesh.llm.exchange import stored

ITEM = "the quick brown fox jumps over a lazy dog near the old river bank today"


def text(seed):
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(3, 8))) for _ in range(60))


def tables(spark, folder):
    rows = [(i, text(i), "en", "s", 1, "mine") for i in range(60)]
    rows += [(100, text(1), "en", "s", 1, "mine"), (101, text(2) + " more", "en", "s", 1, "mine")]
    rows += [(102, text(900) + " " + ITEM, "en", "s", 1, "mine"), (103, text(901) + " card 4337166598464399", "en", "s", 5, "mine")]
    rows += [(104, "too short", None, None, None, None), (105, None, "en", "s", 1, "mine"), (None, text(902), "en", "s", 1, "mine"), (7, text(7), "en", "s", 1, "mine")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages(spark, tmp_path):
    folder = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, folder), "stage")
        assert docs.columns == columns
        ids[name] = sorted((r["doc_id"] for r in docs.collect()), key=str)
    assert ids["quality_rules"] == sorted([*range(60), 100, 101, 102, 103, None, 7], key=str)
    assert ids["near_duplicates"] == sorted([*range(60), 102, 103, None], key=str)
    assert ids["decontamination"] == sorted([*range(60), 103, None], key=str)
    row = docs.where("doc_id = 103").first()
    assert "4337166598464399" not in row["text"] and row["n_chars"] == len(row["text"]) and row["kept"] == "mine"
    assert docs.where("doc_id = 3").first()["n_chars"] == 1
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {p["doc_id"] for p in pieces} == {*range(60), 103, None}
    assert sum(p["length"] for p in pieces) == sum({p["doc_id"]: p["doc_tokens"] for p in pieces}.values())


def test_an_empty_table(spark, tmp_path):
    folder = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, folder), "stage")
    assert docs.count() == 0


def test_near_copies_down_to_four_fifths_go(spark):
    """With the last k of 60 words changed the similarity is (56 - k) / (56 + k): 0.806 at 6, 0.778 at 7."""
    rows = [(i, text(i)) for i in range(40)]
    rows += [(100 + 10 * i + k, " ".join([*text(i).split()[:-k], *text(500 + i).split()[:k]])) for i in range(40) for k in (4 + i % 4,)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert kept == sorted(d for d, _, c in brute_components(rows, 80) if d == c)
    assert kept == [*range(40), *(100 + 10 * i + 7 for i in range(3, 40, 4))]


def test_other_texts_under_one_id_stay(spark):
    near = text(1) + " more"
    rows = [(1, text(1)), (1, text(2)), (1, near), (2, text(2)), (3, text(3)), (3, text(3)), (4, near)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(d for d, _ in kept) == [1, 1, 3]
    assert (1, text(2)) in kept and (3, text(3)) in kept and len({(1, text(1)), (1, near)} & set(kept)) == 1
