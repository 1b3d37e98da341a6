"""Removal of long repeated passages by compaction of a De Bruijn graph of words.

A window of k words is an edge of the graph, from its first k - 1 words to its last k - 1. Edges that occur more than once are
kept; where every occurrence of an edge is followed by one and the same edge, and each occurrence of that one is preceded by
it, the node between them does not branch, and both belong to one path. (A text that begins or ends at a node counts as a
branch.) So a path is a passage that all its sources hold as a whole, and one digest of its words verifies each of them.

1. Runs. Consecutive windows mostly share their minimizer, the least hash of the 12-word grams in them (leftmost). A run of
   windows with one minimizer travels together, and only if its minimizer occurs in another run too: most of a corpus is never
   moved. All occurrences of an edge have one minimizer, so they meet in one bucket.
2. Edges. A bucket counts its edges, notes what follows and precedes each, and joins what does not branch within runs to segments.
3. Compaction. Segments are joined end to start by Spark, then each follows its link to the left by pointer doubling: a path of
   n segments takes log2 n joins, in which only those take part that have not arrived at the head of their path.
4. Verification. The chunks that hold the head of a path read the path's words at the source's own coordinates. A digest that
   two sources share is a repeated passage. Where the sources of a path differ (hashes met), its windows are judged one by one.

Edges are known by 64 bits (the minimizer, its place in the window, 32 bits of the window's own), which only ever makes too many
candidates: two equal windows always have equal bits. What is removed has equal digests of 128 bits.

A chunk sends equal runs once, and a bucket names a segment once for each chunk, so a passage that a third of all documents
share costs a bucket one narrow row a chunk. Requests go by exchange.Route, whose rows follow the corpus and not its square.

Defined cases: null text has no words; windows never cross documents; ids may repeat, be null or of any type; texts shorter than
a window lose nothing; of a repeated window every occurrence goes, the first one too; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .exchange import ROUTED, WHITE, Route, as_batch, joined, mix, n_partitions, release_memory, replied, stored, stored_by_chunk, unpack, unseal
from .suffix_dedup import chunked, digit_replies

#: Words in the grams whose least hash is a window's minimizer.
GRAM = 12
_P = 0x9E3779B97F4A7C15
_INVERSE = pow(_P, -1, 1 << 64)
_LETTERS = np.random.default_rng(1135).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_WHITE = np.isin(np.arange(256), list(WHITE))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_bounds(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end; a document's begin parts words as white space does."""
    inside = ~_IS_WHITE[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cut = begins[(begins > 0) & (begins < len(data))]
    starts[cut] = inside[cut]
    ends[cut - 1] = inside[cut - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """A hash of each word's bytes."""
    out = np.empty(len(starts), np.uint64)
    power = powers(_P, int((ends - starts).max(initial=0)))
    for at in range(0, len(starts), block):
        a, n = starts[at : at + block], (ends - starts)[at : at + block]
        first = np.cumsum(n) - n
        step = np.arange(int(n.sum())) - np.repeat(first, n)
        letters = _LETTERS[data[np.repeat(a, n) + step]] * power[step]
        out[at : at + block] = mix(np.add.reduceat(letters, first), n.astype(np.uint64))
    return out


def rolled(x: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` values from each place."""
    if len(x) < length:
        return np.empty(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * powers(_P, len(x)), dtype=np.uint64)])
    return (total[length:] - total[:-length]) * powers(_INVERSE, len(x) - length + 1)


def least_places(x: np.ndarray, span: int, block: int = 1 << 20) -> np.ndarray:
    """For each stretch of ``span`` values the place of its least one (of 40 bits; leftmost)."""
    n, out = len(x) - span + 1, []
    low = np.uint64((1 << 24) - 1)
    for at in range(0, max(n, 0), block):
        m = min(block, n - at)
        part = x[at : at + m + span - 1]
        key, size = (part & ~low) | np.arange(len(part), dtype=np.uint64), 1
        while 2 * size <= span:
            key = np.minimum(key[: len(key) - size], key[size:])
            size *= 2
        out.append((np.minimum(key[:m], key[span - size : span - size + m]) & low).astype(np.int64) + at)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def edge_ids(digit: np.ndarray, offset: np.ndarray, low: np.ndarray) -> np.ndarray:
    return mix(mix(digit, offset.astype(np.uint64)), low.astype(np.uint64))


class Chunk:
    """A chunk opened: its words, its windows (``at``: the word each starts with) and their runs."""

    def __init__(self, row: dict, k: int):
        self.k = k
        self.ids = pa.ipc.open_stream(row["doc_ids"]).read_all().column(0).combine_chunks()
        lengths = unpack(row["lengths"], np.int64)
        self.text = zstandard.ZstdDecompressor().decompress(row["text"], max_output_size=max(1, row["n_bytes"]))
        data = np.frombuffer(self.text, np.uint8)
        self.ends = np.cumsum(lengths)
        self.begins = self.ends - lengths
        self.starts, self.stops = word_bounds(data, self.begins)
        #: The words of each document.
        self.first, self.last = np.searchsorted(self.starts, self.begins), np.searchsorted(self.starts, self.ends)

    def windows(self) -> Chunk:
        k, data = self.k, np.frombuffer(self.text, np.uint8)
        words = word_hashes(data, self.starts, self.stops)
        n = np.maximum(self.last - self.first - k + 1, 0)
        self.at = np.repeat(self.first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        gram = min(GRAM, k)
        grams = mix(rolled(words, gram), np.uint64(9))
        place = least_places(grams, k - gram + 1)[self.at]
        self.low = (mix(rolled(words, k), np.uint64(5)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)[self.at]
        new = np.ones(len(self.at), bool)
        new[1:] = (place[1:] != place[:-1]) | (self.at[1:] != self.at[:-1] + 1)
        self.run = np.flatnonzero(new)
        self.size = np.diff(np.concatenate([self.run, [len(self.at)]]))
        self.offset = (place - self.at)[self.run]
        digit = mix(grams[place], np.uint64(31))  # least hashes are small: spread them over all buckets again
        self.digit = digit[self.run]
        edge = edge_ids(digit, place - self.at, self.low)
        follows = self.at[1:] == self.at[:-1] + 1 if len(edge) else np.empty(0, bool)
        before, after = np.zeros(len(edge), np.uint64), np.zeros(len(edge), np.uint64)
        before[1:], after[:-1] = np.where(follows, edge[:-1], 0), np.where(follows, edge[1:], 0)
        self.before, self.after = before[self.run], after[self.run + self.size - 1]
        return self

    def distinct(self, repeated: np.ndarray) -> tuple[np.ndarray, dict[int, list[int]]]:
        """Of the runs with repeated minimizers the first of each that are equal (with what is before and after), and all runs by it."""
        runs = np.flatnonzero(repeated)
        head = np.stack([self.digit[runs], self.before[runs], self.after[runs], self.offset[runs].astype(np.uint64)], axis=1).tobytes()
        low, seen, equal = self.low.tobytes(), {}, {}
        for i, (r, a, n) in enumerate(zip(runs.tolist(), self.run[runs].tolist(), self.size[runs].tolist())):
            lead = seen.setdefault(head[32 * i : 32 * i + 32] + low[4 * a : 4 * (a + n)], r)
            equal.setdefault(lead, []).append(r)
        return np.array(list(equal), np.int64), equal

    def words(self, a: int, b: int) -> bytes:
        """Words a to b - 1, joined by one space."""
        return b" ".join(self.text[self.starts[a] : self.stops[b - 1]].split())


def digest(words: bytes) -> bytes:
    return hashlib.blake2b(words, digest_size=16).digest()


def minimizer_requests(chunks: DataFrame, k: int, route: Route) -> DataFrame:
    """Each chunk's distinct minimizers and whether they have more than one run there."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, n = np.unique(Chunk(row, k).windows().digit, return_counts=True)
                yield as_batch(route.letters(0, {"key": keys, "chunk": np.full(len(keys), row["chunk"]), "many": (n > 1).astype(np.uint8)}), ROUTED)
        release_memory()

    return chunks.mapInArrow(ask, ROUTED)


def _repeated(chunk: Chunk, replies: list[dict]) -> np.ndarray:
    """For each run whether its minimizer has another run anywhere."""
    keys, at = np.unique(chunk.digit, return_inverse=True)
    again = replied(replies)["again"] if replies else np.empty(0, np.uint8)
    assert len(again) == len(keys), "a reply is missing"
    return again.astype(bool)[at]


def run_requests(chunks: DataFrame, replies: DataFrame, k: int, route: Route) -> DataFrame:
    """Each chunk's distinct runs whose minimizer is repeated."""

    def ask(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for row in left.to_pylist():
            chunk = Chunk(row, k).windows()
            runs, equal = chunk.distinct(_repeated(chunk, right.to_pylist()))
            runs = runs[np.argsort(chunk.digit[runs], kind="stable")]
            low = chunk.low.tobytes()
            entries = {
                "key": chunk.digit[runs],
                "chunk": np.full(len(runs), row["chunk"]),
                "run": runs.astype(np.uint32),
                "offset": chunk.offset[runs].astype(np.uint8),
                "many": np.array([len(equal[r]) > 1 for r in runs.tolist()], np.uint8),
                "before": chunk.before[runs],
                "after": chunk.after[runs],
                "low": pa.array([low[4 * a : 4 * (a + n)] for a, n in zip(chunk.run[runs].tolist(), chunk.size[runs].tolist())], pa.binary()),
            }
            out += route.letters(1, entries)
            del chunk, entries
            release_memory()
        return pa.Table.from_batches([as_batch(out, ROUTED)])

    return chunks.groupBy("chunk").cogroup(_by_chunk(replies)).applyInArrow(ask, ROUTED)


def _by_chunk(replies: DataFrame):
    return replies.withColumnRenamed("sender", "chunk").groupBy("chunk")


#: A segment (visited false): its first and last edge, windows, and the only edge before and after it (0: none, or several).
#: A visit: the runs of a chunk in which the segment is, each with its first window there (run * 256 + window).
SEGMENTS = "visited boolean, segment bigint, tail bigint, before bigint, after bigint, windows bigint, chunk bigint, places array<bigint>"


def _only(values: np.ndarray, order: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The value of each group if all its members agree, else 0."""
    least, most = np.minimum.reduceat(values[order], heads), np.maximum.reduceat(values[order], heads)
    return np.where(least == most, least, 0)


def segments_of(entries: dict) -> pa.Table:
    """SEGMENTS rows of a bucket's runs."""
    low = entries["low"]
    size = np.array([len(x) // 4 for x in low.to_pylist()], np.int64)
    run, begin = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
    step = np.arange(len(run)) - begin[run]
    own = np.frombuffer(b"".join(low.to_pylist()), np.uint32)
    edge = edge_ids(entries["key"][run], entries["offset"].astype(np.int64)[run] - step, own)
    before, after = np.empty_like(edge), np.empty_like(edge)
    before[1:], after[:-1] = edge[:-1], edge[1:]
    before[begin], after[begin + size - 1] = entries["before"], entries["after"]
    order = np.argsort(edge, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], edge[order][1:] != edge[order][:-1]]))
    group = np.empty(len(edge), np.int64)
    group[order] = np.repeat(np.arange(len(heads)), np.diff(np.concatenate([heads, [len(edge)]])))
    total = np.bincount(group, weights=(1 + entries["many"].astype(np.int64))[run])
    left, right = _only(before, order, heads), _only(after, order, heads)
    glued = np.zeros(len(edge), bool)  # to the window before it in its run
    glued[1:] = (step[1:] > 0) & (right[group[:-1]] != 0) & (left[group[1:]] != 0)
    repeated = total[group] > 1
    start = np.flatnonzero(repeated & ~glued)
    # a segment goes on to where the next window is not glued
    stop = np.append(np.flatnonzero(~glued), len(edge))
    end = stop[np.searchsorted(stop, start, "right")]
    first = start[np.unique(edge[start], return_index=True)[1]]
    last = end[np.searchsorted(start, first)]
    name = lambda x: pa.array(x.view(np.int64))
    kinds = [pa.bool_(), *[pa.int64()] * 6, pa.list_(pa.int64())]
    columns = [c.split()[0] for c in SEGMENTS.split(", ")]
    blank = lambda n, *at: {columns[i]: pa.nulls(n, kinds[i]) for i in at}
    whole = {
        "visited": pa.array(np.zeros(len(first), bool)), "segment": name(edge[first]), "tail": name(edge[last - 1]),
        "before": name(left[group[first]]), "after": name(right[group[last - 1]]), "windows": pa.array(last - first),
    } | blank(len(first), 6, 7)
    chunk = entries["chunk"][run[start]]
    by = np.lexsort([chunk, edge[start]])
    edges, chunks = edge[start][by], chunk[by]
    new = np.flatnonzero(np.concatenate([[True], (edges[1:] != edges[:-1]) | (chunks[1:] != chunks[:-1])])) if len(by) else np.empty(0, np.int64)
    places = (entries["run"].astype(np.int64)[run[start]] * 256 + step[start])[by]
    lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(by)).astype(np.int32)), pa.array(places))
    visits = {"visited": pa.array(np.ones(len(new), bool)), "segment": name(edges[new]), "chunk": pa.array(chunks[new]), "places": lists} | blank(len(new), 2, 3, 4, 5)
    return pa.concat_tables([pa.table({c: x[c] for c in columns}) for x in (whole, visits)])


def segments(requests: DataFrame) -> DataFrame:
    """SEGMENTS rows of all buckets."""

    def judge(group: pa.Table) -> pa.Table:
        found = segments_of(joined([unseal(b.as_py()) for b in group.column("body")]))
        release_memory()
        return found

    return requests.groupBy("lane", "range").applyInArrow(judge, SEGMENTS)


def compacted(pieces: DataFrame) -> DataFrame:
    """(path, windows, segments): the segments joined end to start as long as nothing branches; a path has its first edge's name.

    There are no circles: a text has an end, which is a branch.
    """
    ends = pieces.where("after != 0").select(F.col("after").alias("segment"), F.col("tail").alias("before"), F.col("segment").alias("link"))
    linked = pieces.select("segment", "before", "windows").join(ends, ["segment", "before"], "left")
    rows = stored(linked.select("segment", "link", "windows", F.lit(False).alias("arrived")), "links")
    heads = rows.where("link is null").select(F.col("segment").alias("path"), "windows")
    rows = rows.where("link is not null")
    while rows.where("not arrived").limit(1).count():
        further = rows.select(F.col("segment").alias("link"), F.col("link").alias("next"), F.col("arrived").alias("over"))
        on = rows.where("not arrived").drop("arrived").join(further, "link", "left")  # heads are not among the rows
        on = on.select("segment", F.coalesce("next", "link").alias("link"), "windows", F.coalesce("over", F.lit(True)).alias("arrived"))
        rows = stored(rows.where("arrived").unionByName(on), "links")
    every = heads.unionByName(rows.select(F.col("link").alias("path"), "windows"))
    return every.groupBy("path").agg(F.sum("windows").alias("windows"), F.count("*").alias("segments"))


#: Where a path is: the word in the chunk that it starts with, its windows, and the digest of its words.
SPANS = "chunk bigint, path bigint, word bigint, windows bigint, digest binary"


def source_spans(chunks: DataFrame, replies: DataFrame, heads: DataFrame, k: int) -> DataFrame:
    """SPANS of the paths in all documents; heads(chunk, path, windows, places): the runs in which paths begin."""

    def read(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = right.to_pylist()
        found: list[tuple] = []
        for row in left.to_pylist():
            paths = [r for r in rows if r["path"] is not None]
            if not paths:
                continue
            chunk = Chunk(row, k).windows()
            _, equal = chunk.distinct(_repeated(chunk, [r for r in rows if r["path"] is None]))
            last = chunk.last - k + 1  # the end of the windows of each document
            for r in paths:
                for place in r["places"]:
                    for run in equal[place >> 8]:
                        word = int(chunk.at[chunk.run[run] + (place & 255)])
                        document = int(np.searchsorted(chunk.last, word, "right"))
                        n = min(r["windows"], int(last[document]) - word)
                        found.append((row["chunk"], r["path"], word, n, digest(chunk.words(word, word + n + k - 1))))
            del chunk, equal
            release_memory()
        kinds = [pa.int64()] * 4 + [pa.binary()]
        columns = list(zip(*found)) or [()] * 5
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[c.split()[0] for c in SPANS.split(", ")])

    lane = replies.withColumnRenamed("sender", "chunk").withColumns({c: F.lit(None).cast("bigint") for c in ("path", "windows")}).withColumn("places", F.lit(None).cast("array<bigint>"))
    both = lane.unionByName(heads, allowMissingColumns=True)
    return chunks.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(read, SPANS)


def single_windows(chunks: DataFrame, spans: DataFrame, k: int) -> DataFrame:
    """SPANS of one window each, of all windows of the given spans."""

    def read(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        found: set[tuple] = set()
        for row in left.to_pylist() if right.num_rows else []:
            chunk = Chunk(row, k)
            for r in right.to_pylist():
                for word in range(r["word"], r["word"] + r["windows"]):
                    found.add((row["chunk"], 0, word, 1, digest(chunk.words(word, word + k))))
        kinds = [pa.int64()] * 4 + [pa.binary()]
        columns = list(zip(*found)) or [()] * 5
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[c.split()[0] for c in SPANS.split(", ")])

    return chunks.groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInArrow(read, SPANS)


def verified(chunks: DataFrame, spans: DataFrame, k: int) -> DataFrame:
    """The spans whose words another span has too."""
    sources = stored(spans.groupBy("path", "digest").agg(F.count("*").alias("n")), "sources")
    unlike = sources.groupBy("path").agg(F.count("*").alias("digests"), F.min("n").alias("least")).where("digests > 1 or least < 2").select("path")
    if not unlike.limit(1).count():
        return spans
    unlike = stored(unlike, "unlike")
    one = stored(single_windows(chunks, spans.join(unlike, "path", "left_semi"), k), "windows")
    again = one.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    return spans.join(unlike, "path", "left_anti").unionByName(one.join(again, "digest", "left_semi"))


def remove_passages(
    docs: DataFrame, words: int = 35, chunk_bytes: int = 4_000_000, with_text: bool = True, bucket_bytes: int = 3_000_000, fan: int = 256
) -> DataFrame:
    """(doc_id, n_words, n_removed and the kept words joined by one space, or, without texts, their sha256) for every row of docs."""
    if not 2 <= words <= 200:
        raise ValueError("a window has 2 to 200 words")
    spark = docs.sparkSession
    ship(spark)
    chunks = stored_by_chunk(chunked(docs, chunk_bytes), "passages", n_partitions(spark))
    sizes = chunks.agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("chunks")).first()
    route = Route.of(sizes["chunks"], max(4, -(-(sizes["bytes"] or 0) // bucket_bytes)), fan)
    replies = stored(digit_replies(route.forward(minimizer_requests(chunks, words, route))), "minimizers")
    if route.meets:
        replies = stored(route.backward(replies), "minimizers")
    pieces = stored(segments(route.forward(run_requests(chunks, replies, words, route))), "segments", ("visited",))
    paths = compacted(pieces.where("not visited"))
    heads = pieces.where("visited").select(F.col("segment").alias("path"), "chunk", "places").join(paths.select("path", "windows"), "path")
    spans = stored_by_chunk(source_spans(chunks, replies, heads, words), "spans", n_partitions(spark))
    sound = verified(chunks, spans, words)
    kinds = [docs.schema["doc_id"].dataType, T.LongType(), T.LongType(), T.StringType()]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(["doc_id", "n_words", "n_removed", "kept" if with_text else "kept_sha256"], kinds)])

    def apply(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        tables = []
        at, n = (right.column(c).to_numpy() for c in ("word", "windows"))
        for row in left.to_pylist():
            chunk = Chunk(row, words)
            edge = np.zeros(len(chunk.starts) + 1, np.int32)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + n + words - 1, -1)
            gone = np.cumsum(edge[:-1]) > 0
            removed, kept = [], []
            for a, b, x, y in zip(chunk.begins.tolist(), chunk.ends.tolist(), chunk.first.tolist(), chunk.last.tolist()):
                own, split = gone[x:y], chunk.text[a:b].split()
                removed.append(int(np.count_nonzero(own)))
                whole = b" ".join([split[i] for i in np.flatnonzero(~own).tolist()] if removed[-1] else split)
                kept.append(whole if with_text else hashlib.sha256(whole).hexdigest())
            columns = [chunk.ids, pa.array(chunk.last - chunk.first), pa.array(removed, pa.int64()), (pa.array(kept, pa.binary()) if with_text else pa.array(kept)).cast(pa.string())]
            tables.append(pa.Table.from_arrays(columns, names=schema.names))
            del chunk, edge, gone
            release_memory()
        return pa.concat_tables(tables)

    return chunks.groupBy("chunk").cogroup(sound.select("chunk", "word", "windows").groupBy("chunk")).applyInArrow(apply, schema)
