"""The registry: joins by similarity, stretches, and batches that are folded in."""

import random

import numpy as np
import pandas as pd
import pytest

from statemesh.functions.embeddings import hashed_trigrams
from statemesh.operators import canon, similar
from statemesh.streaming.extend import LayerStore, RegistryStore

LABELS = "kind string, key string, label string, first bigint"
SHOWN = ["kind", "key", "node_label", "action", "similarity", "nearest_label"]


def names(n, seed=3):
    r = random.Random(seed)
    words = ["revenue", "revenues", "profit", "profits", "net", "gross", "total", "operations", "operating", "margin", "a", "b"]
    return list(dict.fromkeys(" ".join(r.choices(words, k=r.randint(1, 4))) for _ in range(n)))


def plain(rows, **options):
    df = pd.DataFrame([x[1:] for x in rows], columns=["key", "label", "first"])
    d = canon.leader_pass(df, hashed_trigrams, **options)
    return sorted((r.key, r.node_label, r.action, r.similarity, r.nearest_label) for r in d.itertuples())


@pytest.mark.parametrize("options", [{"floor": 0.0}, {"floor": 0.72}, {"floor": 0.0, "merge": 0.8, "create": 0.5}, {"floor": 0.6, "create": 0.6, "adjudicate": lambda a, b: (len(a) + len(b)) % 2 == 0}])
def test_stretches_decide_as_one_pass(spark, options):
    rows = [("predicate", f"k {n}", n, 3 * i) for i, n in enumerate(names(140))]
    found = canon.resolve(spark.createDataFrame(rows, LABELS).repartition(3), batch=7, **options).collect()
    assert sorted((r["key"], r["node_label"], r["action"], r["similarity"], r["nearest_label"]) for r in found) == plain(rows, **options)


def test_nearest_and_links_in_small_blocks(spark):
    rows = [("predicate", str(i), n, i) for i, n in enumerate(names(90, 5))]
    f = similar.features(spark.createDataFrame(rows, LABELS), hashed_trigrams).cache()
    order = similar.order_of(f)
    v = np.stack([hashed_trigrams(x[2]) for x in rows])
    s = np.round(v @ v.T, 12)
    found = {(r["a"], r["b"]): r["score"] for r in similar.links(f, order, 0.6, block=7).collect()}
    assert found == {(str(i), str(j)): s[i, j] for j in range(len(rows)) for i in range(j) if s[i, j] >= 0.6}
    best = {r["key"]: (r["known_key"], r["known_score"]) for r in similar.nearest(f, f, order, 0.6, block=7).collect()}
    want = {str(j): (str(int(s[:j, j].argmax())), s[:j, j].max()) for j in range(1, len(rows)) if s[:j, j].max() >= 0.6}
    assert best == want


def test_no_labels(spark):
    assert canon.resolve(spark.createDataFrame([], LABELS)).collect() == []


def test_batches_decide_as_one_resolution(spark, tmp_path):
    rows = [(kind, f"k {n}", n, 3 * i) for kind in ("entity", "predicate") for i, n in enumerate(names(120, 8))]
    store = RegistryStore(spark, str(tmp_path), batch=9, floor=0.0)
    cuts = [0, 100, 101, 250, 10**9]
    for n, (low, high) in enumerate(zip(cuts, cuts[1:])):
        part = [x for x in rows if low <= x[3] < high] + ([rows[0]] if n == 2 else [])
        for _ in range(1 + (n == 1)):  # one is run twice
            given = store.fold_in(spark.createDataFrame(part, LABELS), n)
        assert given.count() == len(part)
    one = canon.resolve(spark.createDataFrame(rows, LABELS), floor=0.0)
    both = (sorted(map(tuple, d.select(*SHOWN, "node_id").collect()), key=str) for d in (store.decisions(), one))
    assert next(both) == next(both)


def test_a_layer_gives_new_claims_their_nodes(spark, tmp_path):
    from pyspark.sql import functions as F

    from test_sources import claims_frame

    raw = claims_frame(spark, range(12)).withColumns({"subject_id": F.lit(None).cast("string"), "predicate_id": F.lit(None).cast("string")})
    raw = raw.withColumn("subject_raw", F.when(F.col("seq") == 5, "the Company").when(F.col("seq") > 7, "Northwind Ltd").otherwise("Northwind Limited")).withColumn("predicate_raw", F.lit("revenue"))
    store = LayerStore(spark, str(tmp_path / "layer"), RegistryStore(spark, str(tmp_path / "registry")))
    for n, (low, high) in enumerate([(0, 8), (8, 12), (8, 12)]):
        store.fold_in(raw.where(F.col("seq").between(low, high - 1)), min(n, 1))
    claims = store.claims().collect()
    assert len(claims) == 11 and len({(r["subject_id"], r["predicate_id"]) for r in claims}) == 1
    assert [r["failure"] for r in store.set_aside().collect()] == ["subject is a referring expression"]
    assert store.edges().count() == 11 * 10 // 2
