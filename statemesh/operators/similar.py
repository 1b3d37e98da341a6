"""Joins of vectors by cosine similarity, for thresholds, without holding all against all.

Vectors are unit vectors, kept as their dimensions that are not 0. Dimensions have one order, rare ones first. If what follows a
vector's leading dimensions in that order has a norm below the threshold, then every vector that is similar enough has one of
the leading dimensions among its own leading ones (else all that both have would lie in what follows one of them). So vectors
are exposed at their leading dimensions only, and meet there. A dimension that many vectors lead with is cut to blocks, and
each block of one side meets each block of the other: a task holds two bounded blocks, compares them as matrices, and gives
back at most one row for each vector that asks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, stored

FEATURES = "kind string, key string, label string, batch bigint, first bigint, at array<int>, weight array<double>"
EXPOSED = f"dim int, {FEATURES}"
#: Vectors of one side in a block.
BLOCK = 2000
Order = dict[str, dict[int, int]]


def features(labels: DataFrame, embed: Callable[[str], np.ndarray], batch: int = 0) -> DataFrame:
    """FEATURES of labels(kind, key, label, first)."""
    ship(labels.sparkSession)

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            vectors = [np.asarray(embed(x), np.float64) for x in p["label"]]
            at = [np.flatnonzero(v) for v in vectors]
            yield p.assign(batch=batch, at=at, weight=[v[a] for v, a in zip(vectors, at)])[["kind", "key", "label", "batch", "first", "at", "weight"]]

    return labels.select("kind", "key", "label", "first").mapInPandas(read, FEATURES)


def order_of(rows: DataFrame) -> Order:
    """In how many vectors of a kind each dimension is: a number for each dimension of the embedder, so bounded by it."""
    counts = rows.select("kind", F.explode("at").alias("dim")).groupBy("kind", "dim").count().collect()
    order: Order = {}
    for r in counts:
        order.setdefault(r["kind"], {})[r["dim"]] = r["count"]
    return order


def leading(at: np.ndarray, weight: np.ndarray, counts: dict[int, int], threshold: float) -> np.ndarray:
    """The leading dimensions; dimensions that were not counted come first, all alike in every vector."""
    by = np.lexsort([at, [counts.get(int(d), 0) for d in at]])
    rest = np.sqrt(np.maximum(0.0, (weight**2).sum() - np.cumsum(weight[by] ** 2)))
    short = np.flatnonzero(rest < threshold - 1e-9)
    return at[by[: short[0] + 1]] if len(short) else at[by]


def exposed(rows: DataFrame, order: Order, threshold: float) -> DataFrame:
    """EXPOSED rows: each vector once for each of its leading dimensions."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            p = p.assign(dim=[leading(np.asarray(a), np.asarray(w), order.get(k, {}), threshold) for k, a, w in zip(p["kind"], p["at"], p["weight"])])
            p = p.explode("dim").dropna(subset=["dim"])
            yield p.assign(dim=p["dim"].astype("int32"))[[c.split()[0] for c in EXPOSED.split(", ")]]

    return rows.mapInPandas(read, EXPOSED)


def _matrix(rows: pd.DataFrame, columns: dict[int, int]) -> np.ndarray:
    out = np.zeros((len(rows), len(columns)))
    for i, (at, weight) in enumerate(zip(rows["at"], rows["weight"])):
        out[i, [columns[d] for d in at]] = weight
    return out


def _compared(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    """Similarities, to twelve places, so that they do not depend on how rows are grouped; -1 unless the row of a comes first."""
    columns = {d: i for i, d in enumerate(sorted({d for rows in (a, b) for at in rows["at"] for d in at}))}
    similar = np.round(_matrix(a, columns) @ _matrix(b, columns).T, 12)
    both = pd.concat([a[["batch", "first", "key"]], b[["batch", "first", "key"]]])
    place = both.groupby(["batch", "first", "key"], sort=True).ngroup().to_numpy()
    similar[place[: len(a), None] >= place[None, len(a) :]] = -1.0
    return similar


def _meet(left: DataFrame, right: DataFrame, judge, schema: str, block: int) -> DataFrame:
    """judge(left block, right block) for all pairs of blocks of EXPOSED rows with one kind and dimension."""
    size = lambda df, name: df.groupBy("kind", "dim").agg(F.ceil(F.count("*") / block).alias(name))
    blocks = F.broadcast(size(left, "n").join(size(right, "m"), ["kind", "dim"]))  # a row for each dimension of the embedder
    own = lambda n: F.pmod(F.xxhash64("key"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    a = left.join(blocks, ["kind", "dim"]).withColumn("i", own("n")).withColumn("j", each("m"))
    right, blocks = right.toDF(*right.columns), F.broadcast(blocks.toDF(*blocks.columns))  # both sides may be one table
    b = right.join(blocks, ["kind", "dim"]).withColumn("j", own("m")).withColumn("i", each("n"))
    by = ["kind", "dim", "i", "j"]
    return a.groupBy(by).cogroup(b.groupBy(by)).applyInPandas(judge, schema)


NEAREST = "kind string, key string, known_key string, known_label string, known_score double, known_batch bigint, known_first bigint"


def nearest(left: DataFrame, right: DataFrame, order: Order, threshold: float, block: int = BLOCK, left_exposed: bool = False) -> DataFrame:
    """NEAREST: for each row of right the most similar of the rows of left that come before it, if it reaches the threshold and
    is above 0; of equals the first. left may be EXPOSED already (for a threshold that is not higher)."""
    names = [c.split()[0] for c in NEAREST.split(", ")]

    def judge(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame(columns=names)
        a = a.sort_values(["batch", "first", "key"])
        similar = _compared(a, b)
        at = similar.argmax(0)
        best = similar[at, np.arange(len(b))]
        met = a.iloc[at]
        columns = [b["kind"], b["key"], met["key"], met["label"], best, met["batch"], met["first"]]
        return pd.DataFrame({n: np.asarray(c) for n, c in zip(names, columns)})[(best >= threshold) & (best > 0)]

    left = left if left_exposed else stored(exposed(left, order, threshold), "exposed")
    met = _meet(left, stored(exposed(right, order, threshold), "exposed"), judge, NEAREST, block)
    best = F.max_by(F.struct(*names[2:]), F.struct("known_score", -F.col("known_batch"), -F.col("known_first")))
    return met.groupBy("kind", "key").agg(best.alias("n")).select("kind", "key", "n.*")


LINKS = "kind string, a string, b string, score double"


def links(rows: DataFrame, order: Order, threshold: float, block: int = BLOCK) -> DataFrame:
    """LINKS of all pairs of rows that reach the threshold, a before b."""

    def judge(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame(columns=["kind", "a", "b", "score"])
        similar = _compared(a, b)
        x, y = np.nonzero((similar >= threshold) & (similar > 0))
        keys = a["key"].to_numpy()[x], b["key"].to_numpy()[y]
        return pd.DataFrame({"kind": a["kind"].iloc[0], "a": keys[0], "b": keys[1], "score": similar[x, y]})

    each = stored(exposed(rows, order, threshold), "exposed")
    return _meet(each, each, judge, LINKS, block).distinct()
