"""Quality rules with an isolation forest on rule statistics.

Every document gets the statistics of the classic rules (words, word characters, symbols, repeated lines, repeated
windows). Two fixed rules reject outright (``base_failed``). The rest goes to an isolation forest: random splits isolate
unusual documents after few steps, so a short mean path length means an anomaly. The forest is grown on the statistics of one half
of a bounded sample of labelled rows (``max_labelled``, by hash of the id), whose labels it does not see, among a uniform
background. The anomaly threshold is calibrated on the labels of the other half: the value with the best balanced accuracy
that keeps at least ``keep_good`` of the good rows. Everything else covers all rows.

Defined cases: null text has no words and fails the base rules; without labelled rows of both kinds nothing but the base
rules rejects; a repeated label row counts once, and so do documents that share a labelled id (the one with the least
statistics stands for them); repeated documents get equal verdicts; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .exchange import WHITE, mix, release_memory

SYMBOLS = b"#*$%&|<>"
#: Deleted from UTF-8, one byte for each code point of a word remains.
_NOT_COUNTED = WHITE + bytes(range(0x80, 0xC0))
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def repeat_words(split: list[list[bytes]], window: int = 5) -> np.ndarray:
    """For each list of words: how many lie in windows that occur twice or more in the same list."""
    out = np.zeros(len(split), np.int64)
    lengths = np.array([len(w) for w in split], np.int64)
    total = int(lengths.sum())
    if total < window:
        return out
    number = _Ids()
    get = number.__getitem__
    ids = np.fromiter((get(w) for words in split for w in words), np.uint64, total)
    doc = np.repeat(np.arange(len(split), dtype=np.int64), lengths)
    n = total - window + 1
    whole = doc[:n] == doc[window - 1 :]  # the window ends in the document where it starts
    key = doc[:n].astype(np.uint64)
    for k in range(window):
        key = mix(key, ids[k : k + n])
    at = np.flatnonzero(whole)
    order = at[np.argsort(key[at], kind="stable")]
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, order[twice], 1)
    np.add.at(edge, order[twice] + window, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(doc[covered], minlength=len(split)).astype(np.int64)


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row for each text, columns STATISTICS."""
    split = [t.split() for t in texts]
    rows = np.zeros((len(texts), len(STATISTICS)), np.int64)
    for i, (t, words) in enumerate(zip(texts, split)):
        lines = [x for x in t.split(b"\n") if x and not x.isspace()]
        rows[i, :4] = (
            len(words),
            len(t.translate(None, _NOT_COUNTED)),
            len(t) - len(t.translate(None, SYMBOLS)),
            sum(c - 1 for c in Counter(lines).values()) if len(lines) > 1 else 0,
        )
    at = 0
    while at < len(texts):  # stretches of bounded size
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(split[end]) <= 400_000):
            size += len(split[end])
            end += 1
        rows[at:end, 4] = repeat_words(split[at:end])
        at = end
    return rows


def base_failed(rows: np.ndarray) -> np.ndarray:
    return (rows[:, 0] < 10) | (100 * rows[:, 4] > 20 * rows[:, 0])


def features(rows: np.ndarray, prior: float = 100.0) -> np.ndarray:
    """What the forest sees, each within 0 to 1: mean word length (drawn to 5.5 for short texts) and shares of the words."""
    words = np.maximum(rows[:, 0], 1).astype(np.float64)
    return np.column_stack(
        [
            np.minimum((rows[:, 1] + 5.5 * prior) / (words + prior) / 12, 1),
            np.minimum(np.sqrt(rows[:, 2] / words), 1),
            np.minimum(rows[:, 3] / words, 1),
            rows[:, 4] / words,
        ]
    )


def _average_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary search tree of n keys."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2.0 * (np.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


class IsolationForest:
    """Trees as flat arrays: feature (-1 at a leaf), value, children, path length at the leaf."""

    def __init__(self, x: np.ndarray, trees: int = 200, sample: int = 256, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.sample = min(sample, len(x))
        self.depth = max(1, int(np.ceil(np.log2(max(self.sample, 2)))))
        self.trees = [self._grow(x[rng.choice(len(x), self.sample, replace=False)], rng) for _ in range(trees)]

    def _grow(self, x: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        feature, value, left, right, path = [], [], [], [], []

        def node(rows: np.ndarray, depth: int) -> int:
            k = len(feature)
            for column in (feature, value, left, right, path):
                column.append(-1)
            low, high = rows.min(0), rows.max(0)
            usable = np.flatnonzero(high > low)
            if depth == self.depth or len(rows) <= 1 or not len(usable):
                path[k] = depth + _average_path(len(rows))
                return k
            f = int(rng.choice(usable))
            v = rng.uniform(low[f], high[f])
            feature[k], value[k] = f, v
            under = rows[:, f] < v
            left[k] = node(rows[under], depth + 1)
            right[k] = node(rows[~under], depth + 1)
            return k

        node(x, 0)
        return tuple(np.array(c, t) for c, t in zip((feature, value, left, right, path), (int, float, int, int, float)))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1): 2 ** -(mean path length / expected path length)."""
        total = np.zeros(len(x))
        for feature, value, left, right, path in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                inner = f >= 0
                under = x[np.arange(len(x)), np.maximum(f, 0)] < value[at]
                at = np.where(inner, np.where(under, left[at], right[at]), at)
            total += path[at]
        return 2.0 ** -(total / len(self.trees) / max(_average_path(self.sample), 1e-9))


def calibrated(scores: np.ndarray, good: np.ndarray, keep_good: float) -> float:
    """The threshold (reject above) with the best balanced accuracy among those that keep enough good rows."""
    if not good.any() or good.all():
        return np.inf
    levels = np.unique(scores)
    middle = np.concatenate([(levels[1:] + levels[:-1]) / 2, levels[-1:]])
    g, b = np.sort(scores[good]), np.sort(scores[~good])
    kept = np.searchsorted(g, middle, "right") / len(g)
    caught = 1 - np.searchsorted(b, middle, "right") / len(b)
    value = np.where(kept >= keep_good, kept + caught, -1)
    return float(middle[int(np.argmax(value))])


STAT_SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in STATISTICS])


def _stat_batches(batches: Iterator[pa.RecordBatch], step: int = 512):
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part, statistics([t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()])
    release_memory()


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, keep_good: float = 0.9995) -> tuple:
    """(forest or None, threshold) from at most max_labelled labelled rows."""
    sample = (
        labels.where("doc_id is not null and quality is not null")
        .select("doc_id", "quality")
        .orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id", "quality")
        .limit(max_labelled)
    )
    sample = sample.distinct().withColumn("grows", F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(2)) == 0)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    own = ["doc_id", "quality", "grows"]
    schema = T.StructType([*(texts.schema[c] for c in own), *STAT_SCHEMA.fields])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _stat_batches(batches):
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), *(pa.array(c) for c in rows.T)], names=schema.names)

    measured = texts.mapInArrow(measure, schema).groupBy(*own).agg(F.min(F.struct(*STATISTICS)).alias("s"))
    found = measured.select("quality", "grows", "s.*").toPandas()  # at most max_labelled rows
    rows = found[list(STATISTICS)].to_numpy(np.int64).reshape(-1, len(STATISTICS))
    return grown(rows, found["quality"].to_numpy() == 1, found["grows"].to_numpy(bool), keep_good)


def grown(rows: np.ndarray, good: np.ndarray, grows: np.ndarray, keep_good: float) -> tuple:
    """(forest or None, threshold): the forest from the rows that grow it, the threshold from the labels of the others."""
    judged = ~base_failed(rows)
    rows, good, grows = rows[judged], good[judged], grows[judged]
    order = np.lexsort([*rows.T, good, grows])  # the same forest however the rows arrive
    rows, good, grows = rows[order], good[order], grows[order]
    rest = good[~grows]
    if grows.sum() < 2 or not len(rest) or rest.all() or not rest.any():
        return None, np.inf
    x = features(rows)
    # Random splits can only part what varies among the rows they see, and sound rows hardly vary in some statistics.
    # A uniform background makes every region of the space splittable: rows are held against noise, and only where many
    # documents are alike does it take many splits to isolate one.
    background = np.random.default_rng(5).uniform(0, 1, (4 * int(grows.sum()), x.shape[1]))
    forest = IsolationForest(np.concatenate([x[grows], background]))
    return forest, calibrated(forest.score(x[~grows]), rest, keep_good)


def quality_rules(
    docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, keep_good: float = 0.9995, columns: list[str] | None = None
) -> DataFrame:
    """The columns of docs (or those named) with STATISTICS, base_failed, anomaly (score) and kept.

    Own columns with the names of new ones are replaced.
    """
    ship(docs.sparkSession)
    added = [*STATISTICS, "base_failed", "anomaly", "kept"]
    own = [c for c in (docs.columns if columns is None else columns) if c not in added]
    forest, threshold = fit(docs, labels, max_labelled, keep_good)
    shared = docs.sparkSession.sparkContext.broadcast((forest, threshold))
    schema = T.StructType(
        [
            *(docs.schema[c] for c in own),
            *STAT_SCHEMA.fields,
            T.StructField("base_failed", T.BooleanType()),
            T.StructField("anomaly", T.DoubleType()),
            T.StructField("kept", T.BooleanType()),
        ]
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, most = shared.value
        for part, rows in _stat_batches(batches):
            failed = base_failed(rows)
            score = model.score(features(rows)) if model else np.zeros(len(rows))
            new = [*(pa.array(c) for c in rows.T), pa.array(failed), pa.array(score), pa.array(~failed & (score <= most))]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), *new], names=schema.names)

    return docs.select(*dict.fromkeys([*own, "text"])).mapInArrow(judge, schema)
