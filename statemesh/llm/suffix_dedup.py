"""Exact removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are compared only through ``depth`` bytes (the threshold), by most-significant-digit passes. Each pass parts the
groups of suffixes that are still equal by one more digit, and suffixes that are alone leave at once; the groups left after
the last digit are exactly the repeated windows. All but the earliest window of each group are removed. A departure from the
plain form: only equality matters here, so digits are hashes of pieces, and groups come in the order of hashes, not of bytes.

The first digit is content-defined, so that one pass can deal the suffixes out without moving them all: it is the least
hash of the 48-byte strings within the window (leftmost, with its place in the window). Equal windows have equal first
digits, and consecutive windows mostly share theirs, so a run of windows travels as one stretch of text, and only where
its first digit occurs again. The next digits are hashes of 25-byte pieces; members of the last groups are compared byte by byte.

A chunk sends each distinct stretch once: its own later copies are removed in any case. A passage that a third of all
documents share thus costs one stretch a chunk, and a bucket keeps its text once. Replies are one bit a window. Documents are
stored once, bucketed by chunk; requests and replies go by exchange.Route, whose rows follow the corpus and not its square.

Defined cases: null text is empty; windows never cross documents; "earlier" is the smaller (doc_id of any type that has an
order, then scan order where ids repeat, then start), null ids last; documents shorter than the depth lose nothing; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .exchange import REPLIED, ROUTED, Route, as_batch, joined, mix, n_partitions, pack, release_memory, replied, seal, stored, stored_by_chunk, unpack, unseal

#: Length of the strings whose hashes compete for the first digit, and odd multiplier of the rolling hash.
GRAM = 48
_P = 0x9E3779B97F4A7C15
_LETTERS = np.random.default_rng(4242).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NULL_LAST = np.int64(1 << 62)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_P, n, 1 << 64))


def string_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` bytes from each position, by doubling; only the powers of two in the length are kept."""
    with np.errstate(over="ignore"):
        x, n, kept = _LETTERS[data], 1, {}
        while True:
            if length & n:
                kept[n] = x
            if 2 * n > length:
                break
            x = x[: len(x) - n] * _power(n) + x[n:]
            n *= 2
        out, done = None, 0
        for size in sorted(kept, reverse=True):
            x = kept.pop(size)
            out = x if out is None else out[: len(data) - done - size + 1] * _power(size) + x[done:]
            done += size
    return out


def first_digits(data: np.ndarray, depth: int, block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one first digit: (first window, place of the least string, its hash). Windows start at 0..n-depth."""
    span, n = depth - GRAM + 1, len(data) - depth + 1
    starts, places, digits = [], [], []
    low = np.uint64((1 << 24) - 1)
    for at in range(0, max(n, 0), block):
        m = min(block, n - at)
        x = string_hashes(data[at : at + m + depth - 1], GRAM)
        x = mix(x, np.uint64(9))
        key = (x & ~low) | np.arange(len(x), dtype=np.uint64)
        size = 1
        while 2 * size <= span:
            key = np.minimum(key[: len(key) - size], key[size:])
            size *= 2
        key = np.minimum(key[:m], key[span - size : span - size + m])
        place = (key & low).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        starts.append(new + at)
        places.append(place[new] + at)
        digits.append(mix(x[place[new]], np.uint64(31)))  # least hashes are small: spread them over all buckets again
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(starts), np.concatenate(places), np.concatenate(digits)


CHUNKS = "chunk bigint, doc_ids binary, lengths binary, text binary, n_bytes bigint"


def chunked(docs: DataFrame, most: int) -> DataFrame:
    """CHUNKS of docs(doc_id, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number = TaskContext.get().partitionId() << 32, 0
        ids, texts, size = [], [], 0

        def chunk() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            column = pa.array(ids, id_type)
            with pa.ipc.new_stream(sink, pa.schema([("doc_id", id_type)])) as w:
                w.write_batch(pa.RecordBatch.from_arrays([column], names=["doc_id"]))
            row = (
                first + number,
                sink.getvalue().to_pybytes(),
                pack(np.array([len(t) for t in texts], np.int64)),
                zstandard.ZstdCompressor(level=1).compress(b"".join(texts)),
                size,
            )
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=["chunk", "doc_ids", "lengths", "text", "n_bytes"])

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("body").to_pylist()):
                    text = text or b""
                    if ids and size + len(text) > most:
                        yield chunk()
                        ids, texts, size, number = [], [], 0, number + 1
                    ids.append(doc_id)
                    texts.append(text)
                    size += len(text)
        if ids:
            yield chunk()

    return docs.select("doc_id", F.col("text").cast("binary").alias("body")).mapInArrow(rows, CHUNKS)


class Chunk:
    """A chunk opened, with its runs of windows; runs end where the first digit or the document changes."""

    def __init__(self, row: dict, depth: int):
        self.depth = depth
        self.ids = pa.ipc.open_stream(row["doc_ids"]).read_all().column(0).combine_chunks()
        self.lengths = unpack(row["lengths"], np.int64)
        self.text = zstandard.ZstdDecompressor().decompress(row["text"], max_output_size=max(1, row["n_bytes"]))
        self.ends = np.cumsum(self.lengths)
        self.begins = self.ends - self.lengths
        start, place, digit = first_digits(np.frombuffer(self.text, np.uint8), depth)
        stop = np.concatenate([start[1:], [max(0, len(self.text) - depth + 1)]]) if len(start) else start
        # cut at documents: windows that start in a document and end in it
        fits = np.flatnonzero(self.lengths >= depth)
        low, high = self.begins[fits], self.ends[fits] - depth + 1
        if len(start) and len(fits):
            a, b = np.searchsorted(stop, low, "right"), np.searchsorted(start, high, "left")
            run = np.concatenate([np.arange(x, y) for x, y in zip(a, b)]) if len(a) else np.empty(0, np.int64)
            doc = np.repeat(np.arange(len(fits)), b - a)
            self.start, self.stop = np.maximum(start[run], low[doc]), np.minimum(stop[run], high[doc])
            self.place, self.digit, self.doc = place[run], digit[run], fits[doc]
        else:
            self.start = self.stop = self.place = self.doc = np.empty(0, np.int64)
            self.digit = np.empty(0, np.uint64)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct first digits, and for each run the number of its digit."""
        return np.unique(self.digit, return_inverse=True)

    def stretches(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the runs whose digit is repeated: the first run of each distinct stretch, and the runs that copy another.

        First means least in the order of removal, so that a copy always has an earlier equal.
        """
        runs = np.flatnonzero(repeated)
        ids = order_key(self.ids)
        runs = runs[np.lexsort([self.start[runs], self.doc[runs], ids[self.doc[runs]]])]
        seen, first, copies = set(), [], []
        text, depth = self.text, self.depth
        for r, a, b, p in zip(runs.tolist(), self.start[runs].tolist(), self.stop[runs].tolist(), self.place[runs].tolist()):
            key = (p - a, xxhash.xxh3_128_digest(text[a : b + depth - 1]))
            if key in seen:
                copies.append(r)
            else:
                seen.add(key)
                first.append(r)
        return np.array(first, np.int64), np.array(copies, np.int64)


def order_key(ids: pa.Array) -> np.ndarray:
    """Numbers in the order of the ids, nulls last: whole numbers as they are, others by their rank among these."""
    if pa.types.is_integer(ids.type):
        return ids.cast(pa.int64()).fill_null(int(_NULL_LAST)).to_numpy(zero_copy_only=False)
    return pc.rank(ids, "ascending", null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)


def digit_requests(chunks: DataFrame, depth: int, route: Route) -> DataFrame:
    """Each chunk's distinct first digits and whether they occur there in more than one run."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, at = Chunk(row, depth).distinct()
                many = (np.bincount(at, minlength=len(keys)) > 1).astype(np.uint8)
                yield as_batch(route.letters(0, {"key": keys, "chunk": np.full(len(keys), row["chunk"]), "many": many}), ROUTED)

    return chunks.mapInArrow(ask, ROUTED)


def _replies(lane: int, bucket: int, given: list[tuple[int, int]], columns: dict) -> pa.Table:
    out, first = [], 0
    for sender, n in given:
        out.append((lane, bucket, sender, seal({name: c[first : first + n] for name, c in columns.items()})))
        first += n
    return pa.Table.from_batches([as_batch(out, REPLIED)])


def digit_replies(requests: DataFrame) -> DataFrame:
    """For each chunk's digits: whether it occurs again, here or elsewhere."""

    def judge(group: pa.Table) -> pa.Table:
        rows = group.select(["range", "sender", "body"]).to_pylist()
        parts = [unseal(r["body"]) for r in rows]
        _, at = np.unique(np.concatenate([p["key"] for p in parts]), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([p["many"] for p in parts]) + 1)
        given = [(r["sender"], len(p["key"])) for r, p in zip(rows, parts)]
        return _replies(0, rows[0]["range"], given, {"chunk": np.concatenate([p["chunk"] for p in parts]), "again": (n[at] > 1).astype(np.uint8)})

    return requests.groupBy("lane", "range").applyInArrow(judge, REPLIED)


def _lane(replies: list[dict], lane: int, name: str, kind) -> np.ndarray:
    own = [r for r in replies if r["lane"] == lane]
    return replied(own)[name] if own else np.empty(0, kind)


def _repeated(chunk: Chunk, replies: list[dict]) -> np.ndarray:
    return _lane(replies, 0, "again", np.uint8).astype(bool)[chunk.distinct()[1]]


def _sent(chunk: Chunk, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs that the chunk sends, by digit, and the runs that copy one of them."""
    first, copies = chunk.stretches(repeated)
    return first[np.argsort(chunk.digit[first], kind="stable")], copies


def stretch_requests(chunks: DataFrame, replies: DataFrame, depth: int, route: Route) -> DataFrame:
    """Each chunk's distinct stretches with a repeated first digit: digits, place, length, order (doc, row, start), text."""

    def ask(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for row in left.to_pylist():
            chunk = Chunk(row, depth)
            runs, _ = _sent(chunk, _repeated(chunk, right.to_pylist()))
            a, z, doc = chunk.start[runs], chunk.stop[runs] + depth - 1, chunk.doc[runs]
            entries = {
                "key": chunk.digit[runs],
                "chunk": np.full(len(runs), row["chunk"]),
                "shape": (chunk.place[runs] - a).astype(np.uint32) << np.uint32(16) | (z - a).astype(np.uint32),
                "doc": order_key(chunk.ids)[doc] if pa.types.is_integer(chunk.ids.type) else chunk.ids.take(pa.array(doc)),
                "row": doc.astype(np.int64),
                "start": a - chunk.begins[doc],
                "text": pa.array([chunk.text[x:y] for x, y in zip(a.tolist(), z.tolist())], pa.binary()),
            }
            out += route.letters(1, entries)
            del chunk, runs, a, z, doc, entries
            release_memory()
        return pa.Table.from_batches([as_batch(out, ROUTED)])

    return chunks.groupBy("chunk").cogroup(_by_chunk(replies)).applyInArrow(ask, ROUTED)


def _by_chunk(replies: DataFrame):
    return replies.withColumnRenamed("sender", "chunk").groupBy("chunk")


def equal_windows(data: np.ndarray, at: np.ndarray, group: np.ndarray, depth: int, piece: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Most-significant-digit passes over the windows data[at : at + depth], already parted by ``group``.

    Returns (window numbers, group numbers) of the windows that are equal to another one.
    """
    hashes = string_hashes(data, piece) if len(data) >= piece else np.empty(0, np.uint64)
    window = np.arange(len(at))

    def refined(window: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key, kind="stable")
        window, key = window[order], key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.empty(0, bool)
        number = np.cumsum(new) - 1
        alone = np.bincount(number, minlength=1)[number] == 1 if len(number) else new
        return window[~alone], number[~alone].astype(np.uint64)

    window, number = refined(window, group)
    for done in range(0, depth, piece):
        window, number = refined(window, mix(number, hashes[at[window] + min(done, depth - piece)]))
    # the last word has the text itself
    same = np.ones(len(window), bool)
    head = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(number) else np.empty(0, np.int64)
    lead = window[np.repeat(head, np.diff(np.concatenate([head, [len(window)]])))]
    steps = np.arange(depth)
    for s in range(0, len(window), 1 << 14):
        x, y = at[window[s : s + (1 << 14)]], at[lead[s : s + (1 << 14)]]
        same[s : s + (1 << 14)] = (data[x[:, None] + steps] == data[y[:, None] + steps]).all(1)
    if same.all():
        return window, number
    names: dict = {}  # hashes met: name each window's group by its text
    number = np.array([names.setdefault(data[at[w] : at[w] + depth].tobytes(), len(names)) for w in window], np.uint64)
    return refined(window, number)[0], refined(window, number)[1]


def stretch_replies(requests: DataFrame, depth: int) -> DataFrame:
    """For each stretch 64 bits: which of its windows have an equal one that is earlier."""

    def judge(group: pa.Table) -> pa.Table:
        bodies, parts, texts, met, same = group.column("body"), [], [], {}, []
        for body in bodies:  # a text that many chunks sent is kept once
            part = unseal(body.as_py())
            for shape, text in zip(part["shape"].tolist(), part.pop("text").to_pylist()):
                name = (shape, xxhash.xxh3_128_digest(text))
                if name not in met:
                    met[name] = len(texts)
                    texts.append(text)
                same.append(met[name])
            parts.append(part)
        del met
        entries, same = joined(parts), np.array(same, np.int64)
        digit, shape = entries["key"], entries["shape"]
        size, place = (shape & np.uint32(0xFFFF)).astype(np.int64), (shape >> np.uint32(16)).astype(np.int64)
        lengths = np.array([len(t) for t in texts], np.int64)
        data, begin = np.frombuffer(b"".join(texts), np.uint8), (np.cumsum(lengths) - lengths)[same]
        del texts
        doc = entries["doc"] if isinstance(entries["doc"], np.ndarray) else order_key(entries["doc"])
        rank = np.empty(len(digit), np.int64)
        rank[np.lexsort([entries["start"], entries["row"], entries["chunk"], doc])] = np.arange(len(digit))
        windows = size - depth + 1
        # stretches that equal an earlier one as a whole need no sorting: all their windows go
        order = np.argsort(rank)
        kept = np.sort(order[np.unique(same[order], return_index=True)[1]])
        later = (np.uint64(1) << windows.astype(np.uint64)) - np.uint64(1)
        later[kept] = 0
        by_digit = kept[np.argsort(digit[kept], kind="stable")]
        # bounded slices of whole groups
        edge = np.flatnonzero(np.concatenate([[True], digit[by_digit][1:] != digit[by_digit][:-1]]))
        total = np.cumsum(windows[by_digit])
        lo = 0
        while lo < len(by_digit):
            done = total[lo - 1] if lo else 0
            hi = int(np.searchsorted(total, done + 250_000, "right"))
            after = edge[np.searchsorted(edge, max(hi, lo + 1), "left") :]
            hi = int(after[0]) if len(after) else len(by_digit)
            own = by_digit[lo:hi]
            n = windows[own]
            stretch = np.repeat(own, n)
            step = np.arange(len(stretch)) - np.repeat(np.cumsum(n) - n, n)
            # the slice's own text, so that hashes are made once and only for it
            long = size[own]
            first = np.cumsum(long) - long
            part = data[np.repeat(begin[own] - first, long) + np.arange(int(long.sum()))]
            at = np.repeat(first, n) + step
            w, g = equal_windows(part, at, mix(digit[stretch], (place[stretch] - step).astype(np.uint64)), depth)
            # within a group all but the least go; a stretch's rank orders windows of different stretches, as in one
            # stretch windows at other steps have another place of the first digit, so they are never equal
            order = np.lexsort([rank[stretch[w]], g])
            w, g = w[order], g[order]
            gone = w[np.concatenate([[False], g[1:] == g[:-1]])] if len(w) else w
            np.bitwise_or.at(later, stretch[gone], np.uint64(1) << step[gone].astype(np.uint64))
            lo = hi
        given = [(sender.as_py(), len(p["key"])) for sender, p in zip(group.column("sender"), parts)]
        release_memory()
        return _replies(1, group.column("range")[0].as_py(), given, {"chunk": entries["chunk"], "later": later})

    return requests.groupBy("lane", "range").applyInArrow(judge, REPLIED)


def removed_spans(chunk: Chunk, replies: list[dict]) -> np.ndarray:
    """True for each byte of the chunk's text that is covered by a window with an earlier equal."""
    runs, copies = _sent(chunk, _repeated(chunk, replies))
    edge = np.zeros(len(chunk.text) + 1, np.int32)
    bits = _lane(replies, 1, "later", np.uint64)
    assert len(bits) == len(runs), "a reply is missing"
    some = np.flatnonzero(bits)
    steps = np.unpackbits(bits[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    which, step = np.nonzero(steps)
    at = chunk.start[runs[some[which]]] + step
    np.add.at(edge, at, 1)
    np.add.at(edge, at + chunk.depth, -1)
    np.add.at(edge, chunk.start[copies], 1)
    np.add.at(edge, chunk.stop[copies] + chunk.depth - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, depth: int = 100, chunk_bytes: int = 4_000_000, with_text: bool = True, bucket_bytes: int = 3_000_000, fan: int = 256) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked, kept bytes) for every row of docs(doc_id, text)."""
    if not GRAM + 1 <= depth <= GRAM + 63:
        raise ValueError(f"depth must be {GRAM + 1} to {GRAM + 63}")
    spark = docs.sparkSession
    ship(spark)
    chunks = stored_by_chunk(chunked(docs, chunk_bytes), "suffixes", n_partitions(spark))
    sizes = chunks.agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("chunks")).first()
    route = Route.of(sizes["chunks"], max(4, -(-(sizes["bytes"] or 0) // bucket_bytes)), fan)

    def returned(answers: DataFrame, name: str) -> DataFrame:
        answers = stored(answers, name)
        return stored(route.backward(answers), name) if route.meets else answers

    replies = returned(digit_replies(route.forward(digit_requests(chunks, depth, route))), "digits")
    later = returned(stretch_replies(route.forward(stretch_requests(chunks, replies, depth, route)), depth), "stretches")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]
    kinds = [docs.schema["doc_id"].dataType, *[T.LongType()] * 3, T.StringType(), T.BinaryType()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])

    def apply(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        tables = []
        for row in left.to_pylist():
            chunk = Chunk(row, depth)
            gone = removed_spans(chunk, right.to_pylist())
            data = np.frombuffer(chunk.text, np.uint8)
            rows: list[list] = [[], [], [], []]
            for a, b in zip(chunk.begins.tolist(), chunk.ends.tolist()):
                own = gone[a:b]
                n = int(np.count_nonzero(own))
                kept = data[a:b][~own].tobytes() if n else chunk.text[a:b]
                spans = int(np.count_nonzero(own[1:] & ~own[:-1]) + own[0]) if n else 0
                for c, v in zip(rows, (n, spans, hashlib.sha256(kept).hexdigest(), kept)):
                    c.append(v)
            columns = [chunk.ids, pa.array(chunk.lengths), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2])]
            columns += [pa.array(rows[3], pa.binary())] if with_text else []
            tables.append(pa.Table.from_arrays(columns, names=names))
            del chunk, gone, data, rows, columns
            release_memory()
        return pa.concat_tables(tables)

    both = replies.unionByName(later)
    return chunks.groupBy("chunk").cogroup(_by_chunk(both)).applyInArrow(apply, schema)
