"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of consecutive item words. The alphabet is words: a block is two words, up to five for many patterns
(no more than the shortest pattern has), so that a block of a text is seldom in a pattern by chance. ``shift`` maps a block to
how far the window may move; a block in no pattern moves it past the block altogether, so most positions are never looked at.
Where the shift is 0, the block's bucket (hash of the pattern's suffix) names the test strings, a large bucket only those that
start as the text does, and words are compared directly. Patterns go by length: windows of full length together, shorter items
together, each with tables over the shortest pattern among them.

The pattern set is broadcast in blocks of at most ``max_words`` words; each block's windows are found over all documents and
their hits united, so the benchmark may grow without the broadcast growing. Documents are never shuffled when one block
holds the benchmark.

Defined cases: null or wordless documents have no hits; null or wordless items have no window; equal windows of several
items count for each of them; an item without id hits words but is not counted or listed; an empty benchmark contaminates nothing; an empty documents table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .exchange import release_memory

#: Lower-cases A-Z; of ASCII keeps letters and digits; other ASCII parts words; bytes above 7F stay.
WORDS = bytes(b if b >= 0x80 else (b | 0x20 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20) for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def windows_of(words: list[bytes], window: int) -> Iterator[tuple[bytes, ...]]:
    """All windows of consecutive words; an item shorter than one, but not empty, is one window."""
    if words:
        for i in range(max(1, len(words) - window + 1)):
            yield tuple(words[i : i + window])


#: Patterns from which blocks have one word more, and patterns of a bucket up to which each is compared.
WIDER = (1_000, 10_000, 100_000)
SMALL = 4


class WuManber:
    """Shift tables and suffix buckets for patterns of words, of any lengths from 1."""

    def __init__(self, patterns: Iterable[tuple[bytes, ...]]):
        self.patterns = sorted(set(patterns))
        self.least = min(map(len, self.patterns), default=0)
        self.block = min(2 + sum(len(self.patterns) > n for n in WIDER), self.least)
        self.shift: dict = {}
        buckets: dict = defaultdict(list)
        for k, p in enumerate(self.patterns):
            for end in range(self.block, self.least + 1):
                block = p[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.least), self.least - end)
            buckets[p[self.least - self.block : self.least]].append(k)
        self.bucket = {block: numbers if len(numbers) <= SMALL else self._by_start(numbers) for block, numbers in buckets.items()}

    def _by_start(self, numbers: list[int]) -> dict[tuple, list[int]]:
        """The patterns of a large bucket by their words up to the shortest pattern's length."""
        found: dict = defaultdict(list)
        for k in numbers:
            found[self.patterns[k][: self.least]].append(k)
        return dict(found)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """(start, pattern number) of every occurrence."""
        least, n = self.least, len(words)
        if not least or n < least:
            return
        shift, bucket, wide = self.shift.get, self.bucket, self.block
        skip, at = least - wide + 1, least - 1
        while at < n:
            block = (words[at - 1], words[at]) if wide == 2 else tuple(words[at - wide + 1 : at + 1])
            move = shift(block, skip)
            if move:
                at += move
                continue
            yield from self._compare(words, at, bucket[block])
            at += 1

    def _compare(self, words: list[bytes], at: int, numbers: list[int] | dict[tuple, list[int]]) -> Iterator[tuple[int, int]]:
        start = at - self.least + 1
        if isinstance(numbers, dict):
            numbers = numbers.get(tuple(words[start : at + 1]), ())
        for k in numbers:
            p = self.patterns[k]
            if tuple(words[start : start + len(p)]) == p:
                yield start, k


def searchers(items: list[tuple], window: int) -> list[tuple[WuManber, list[list]]]:
    """For full windows and for shorter items, the search and each pattern's item ids."""
    owners: dict[bool, dict[tuple, set]] = {True: defaultdict(set), False: defaultdict(set)}
    for item, text in items:
        for w in windows_of(words_of(text or b""), window):
            owners[len(w) == window][w].add(item)
    found = []
    for group in owners.values():
        if group:
            search = WuManber(group)
            found.append((search, [list(group[p]) for p in search.patterns]))
    return found


def blocks_of(benchmark: DataFrame, max_words: int) -> Iterator[list[tuple]]:
    """Items (item_id, text) in blocks of bounded size, streamed through the driver one partition at a time."""
    held, size = [], 0
    for row in benchmark.select("item_id", F.col("text").cast("binary").alias("text")).toLocalIterator():
        text = bytes(row["text"] or b"")
        if held and size + len(text) > 8 * max_words:
            yield held
            held, size = [], 0
        held.append((row["item_id"], text))
        size += len(text)
    if held:
        yield held


#: Texts that are taken apart into words together.
SLICE = 256
RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("contaminated", T.BooleanType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
    ]
)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, max_words: int = 2_000_000, columns: list[str] | None = None
) -> DataFrame:
    """The columns of docs (or those named) with RESULT; spans are the maximal runs of hit words as (first, end).

    Own columns with the names of new ones are replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = [spark.sparkContext.broadcast(searchers(b, window)) for b in blocks_of(benchmark, max_words)]
    own_columns = [c for c in (docs.columns if columns is None else columns) if c not in RESULT.names]
    schema = T.StructType([*(docs.schema[c] for c in own_columns), *RESULT.fields])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            counts, runs = [0] * len(texts), [[] for _ in texts]
            items: list[set] = [set() for _ in texts]
            for block in shared or [None]:  # one block of patterns and the words of a few texts in memory at a time
                for at in range(0, len(texts), SLICE):
                    split = [words_of(t) for t in texts[at : at + SLICE]]
                    counts[at : at + SLICE] = map(len, split)
                    for search, owners in block.value if block else []:
                        for i, words in enumerate(split, at):
                            for start, k in search.search(words):
                                items[i].update(owners[k])
                                runs[i].append((start, start + len(search.patterns[k])))
                    del split
                if len(shared) > 1:
                    del block._value  # the worker's copy; the file of the broadcast stays
            for n, found, own in zip(counts, runs, items):
                own.discard(None)
                spans: list[list[int]] = []
                for a, b in sorted(found):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                hit = sum(b - a for a, b in spans)
                digest = hashlib.sha256(",".join(sorted(map(str, own))).encode()).hexdigest()
                for c, v in zip(cols, (n, hit, len(own), digest, hit > 0, spans)):
                    c.append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.list_(pa.int64()))]
            new = [pa.array(c, t) for c, t in zip(cols, types)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own_columns), *new], names=schema.names)
        release_memory()

    return docs.select(*dict.fromkeys([*own_columns, "text"])).mapInArrow(scan, schema)
