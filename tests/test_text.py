import hashlib
import unicodedata
import uuid

import numpy as np
from pyspark.sql import functions as F

from statemesh.functions.embeddings import cosine, embed, hashed_trigrams
from statemesh.functions.labels import accounting_standard, basis_from_label, cleaned, entity_fallback, entity_from_self_definition, is_a_property, normalise_label, resolve_subject
from statemesh.functions.text import header_path, markdown_table, normalise_text, numeric_key, tolerant_json, uuid5


def one(spark, column, *values, ddl="a string, b string"):
    width = len(ddl.split(", "))
    df = spark.createDataFrame([tuple(values) + (None,) * (width - len(values))], ddl)
    return df.select(column.alias("x")).first()["x"]


def test_labels(spark):
    df = spark.createDataFrame([("Northwind Limited",), ("Northwind Private Ltd.",), ("ACME Corp",), ("The  Acme, Corporation",), (None,)], "t string")
    assert [r[0] for r in df.select(normalise_label(F.col("t"), True)).collect()] == ["northwind", "northwind", "acme", "the acme", ""]


def test_properties(spark):
    good = [("auditor", "Deloitte"), ("registered office", "Mumbai")]
    bad = [("is the auditor", "x"), ("director of", "x"), ("we believe that", "x"), ("one two three four five six", "x"), ("a", " ".join("x" * 13))]
    df = spark.createDataFrame(good + bad, "p string, v string")
    assert [r[0] for r in df.select(is_a_property(F.col("p"), F.col("v"))).collect()] == [True] * 2 + [False] * 5


def test_subjects_and_words(spark):
    assert one(spark, resolve_subject(F.col("a"), F.col("b")), "the Company.", "Acme") == "Acme"
    assert one(spark, resolve_subject(F.col("a"), F.col("b")), "Bolt Ltd", "Acme") == "Bolt Ltd"
    assert one(spark, cleaned(F.col("a")), " N/A ") is None
    assert one(spark, accounting_standard(F.col("a")), "Ind AS 115") == "IND_AS"
    assert one(spark, basis_from_label(F.col("a")), "Stand-alone results") == "standalone"
    assert one(spark, entity_from_self_definition(F.col("a")), 'issued by Acme Widgets Limited ("the Company") on') == "Acme Widgets Limited"
    assert one(spark, entity_fallback(F.col("a"), F.lit(""), F.col("b")), "no name", "012-acme_report-2024.pdf") == "Acme Report 2024"


def test_normalised_text_and_numeric_keys(spark):
    text = " ﬁnance​  ７２,２５１\n"
    assert one(spark, normalise_text(F.col("a")), text) == " ".join(unicodedata.normalize("NFKC", text.replace("​", " ").replace(" ", " ")).split())
    df = spark.createDataFrame([("61,451",), ("61 451",), ("+61451.",)], "t string")
    assert {r[0] for r in df.select(numeric_key(F.col("t"))).collect()} == {"61451"}


def test_json_tables_and_ids(spark):
    assert one(spark, tolerant_json(F.col("a"), "k bigint"), 'Sure: {"k": 5} done')["k"] == 5
    rows = F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("1")))
    assert one(spark, markdown_table(rows), "x") == "| a | b |\n| --- | --- |\n| 1 |  |"
    assert one(spark, header_path(rows), "x") == "a | b"
    sha = hashlib.sha256(b"x").hexdigest()
    assert one(spark, uuid5(F.col("a")), sha) == str(uuid.uuid5(uuid.UUID("6f4a1c2e-9d3b-4e57-8a10-2c5f7b91d0a4"), sha))


def test_embeddings(spark):
    df = spark.createDataFrame([("Northwind Ltd", "Northwind Limited")], "a string, b string").select(embed(F.col("a")).alias("a"), embed(F.col("b")).alias("b"))
    got = df.select(cosine(F.col("a"), F.col("b")).alias("s")).first()["s"]
    assert abs(got - float(hashed_trigrams("Northwind Ltd") @ hashed_trigrams("Northwind Limited"))) < 1e-6
    z = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), ([], [])], "a array<float>, b array<float>")
    assert [r[0] for r in z.select(cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 0.0, 0.0]
    assert np.isclose(np.linalg.norm(hashed_trigrams("abc")), 1)
