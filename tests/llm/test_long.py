"""Very long texts: every operator works on all of them."""

import random

import public_tokenizers
import pytest

from statemesh.llm import katz, near_dup, packing, pii, quality_rules, sharding, suffix_dedup, token_counts, warc, wu_manber

DOCS = "doc_id bigint, text string"
ITEM = "ten plain words that stand at the very end here"


@pytest.fixture(scope="module")
def long_text():
    r = random.Random(1)
    return " ".join("".join(r.choices("abcdefghij", k=6)) for _ in range(200_000)) + f" {ITEM} 4337166598464399"


@pytest.fixture(scope="module")
def docs(spark, long_text):
    return spark.createDataFrame([(1, long_text), (2, "short")], DOCS)


def row(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}[1]


def test_models(spark, docs, long_text):
    n = len(long_text.split())
    assert row(katz.katz_scores(docs))["n_tokens"] == n + 1
    assert row(token_counts.token_counts(docs, str(public_tokenizers.path("byte_bpe_50k.json"))))["n_bytes"] == len(long_text)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert row(quality_rules.quality_rules(docs, labels))["n_words"] == n


def test_searches(spark, docs, long_text):
    found = row(wu_manber.decontaminate(docs, spark.createDataFrame([(7, ITEM)], "item_id bigint, text string")))
    assert (found["n_hit"], found["n_items"]) == (10, 1)
    assert row(near_dup.near_duplicates(docs))["n_shingles"] == len(long_text.split()) - 4
    assert row(suffix_dedup.remove_repeats(docs, with_text=False))["n_removed"] == 0
    period = spark.createDataFrame([(1, "abcdefghij\n" * 100_000)], DOCS)
    assert row(suffix_dedup.remove_repeats(period, with_text=False))["n_removed"] == 1_100_000 - 11


def test_formats(spark, docs, long_text):
    pieces = packing.pack_documents(docs, str(public_tokenizers.path("word_bpe_49k.json")), with_ids=False).collect()
    own = [p for p in pieces if p["doc_id"] == 1]
    assert sum(p["length"] for p in own) == own[0]["doc_tokens"] > 200_000
    assert row(sharding.shard_documents(docs))["size"] == len(long_text) + 8
    assert "4337166598464399" not in row(pii.pseudonymise(docs, "k"))["text"]
    pages = spark.createDataFrame([(1, "u", long_text)], "page_id bigint, url string, html string")
    assert row(warc.page_round_trip(pages), "page_id")["payload_digest"] == warc.digest_of(long_text.encode())


#: Runs of the characters that the patterns of personal values repeat, each 10,000 times.
RUNS = ["a", "0", "1 ", "12-", "a.", "1.", "x@", "x@a.", "@", ".", "-", "+1 ", "(1) ", "A", "A1", "AB12 ", "DE12 ABCD ", "AKIA", "token=", "Bearer ", "password: a", "4111 1111 1111 ", "é", "2024-01-", "=", "_"]


@pytest.mark.parametrize("before", ["", "x@", "see ", "+1", "token="])
def test_no_run_of_characters_stops_the_search_for_personal_values(spark, before):
    rows = [(i, before + r * 10_000 + "com") for i, r in enumerate(RUNS)] + [(99, "mail jo@a.example.com")]
    out = {r["doc_id"]: r["text"] for r in pii.pseudonymise(spark.createDataFrame(rows, DOCS), "k").collect()}
    assert len(out) == len(rows) and all(len(out[i]) == len(t) for i, t in rows) and "jo@" not in out[99]


def test_the_pipeline_takes_runs_of_characters(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, f"some words before it {i} " + "x@" + r * 10_000 + "com", "en", "s", 1) for i, r in enumerate(["a.", "1.", "-"])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert corpus_pipeline.pseudonyms(spark, docs, "").count() == 3
