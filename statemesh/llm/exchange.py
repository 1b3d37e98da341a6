"""Shared plumbing of the operators that look up corpus-wide facts for many keys.

A *chunk* is a bounded run of documents held as one table row. Each chunk sorts its distinct 64-bit keys, and a *bucket*
answers all chunks for one range of keys. A key costs one entry per chunk, so a hot key cannot fill a bucket. Entries travel
as packed columns, about five bytes a key, in few rows; replies travel back by chunk.

A row per chunk and bucket would make the rows grow with the square of the corpus. So a ``Route`` has a fixed fan-out: with
more chunks than that, chunks meet in groups of about ``fan`` at about ``fan`` coarse ranges first, and the groups' entries
are put together and cut finer, level by level, like the passes of a radix sort. At each level there are about as many
meetings as chunks, so one holds about as many entries as a chunk. Each level makes at most ``fan`` rows a
chunk and the number of levels is the logarithm of the number of chunks: rows and bytes follow the corpus.

Chunks are written once to the shared folder, bucketed by chunk id, before anything is derived from them. Later
stages read that table again: they never depend on a repeated run of the tokenising stage having dealt rows alike.
"""

from __future__ import annotations

import ctypes
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch, stored, stored_by

__all__ = ["scratch", "stored"]  # for the operators, with what is defined here

#: Bytes that separate words: space and 09-0D. ``bytes.split()`` splits on exactly these.
WHITE = b" \t\n\x0b\x0c\r"


def stored_by_chunk(df: DataFrame, name: str, buckets: int) -> DataFrame:
    """Like stored(), bucketed by chunk: later groupings by chunk read it without moving the documents again."""
    return stored_by(df, name, "chunk", buckets)


#: A row's place: 24 bits for the task that wrote its chunk, 20 for the chunk in the task, 18 for the row in the chunk.
IN_TASK, IN_CHUNK = 20, 18
LOCATED = "chunk bigint, rows binary"


def located(df: DataFrame, most_bytes: int = 4_000_000, most_rows: int = 1 << 16) -> DataFrame:
    """LOCATED chunks of df's rows, to be stored: from then on every row has a place of its own, whatever its ids are."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number, held, size, n = TaskContext.get().partitionId() << IN_TASK, 0, [], 0, 0

        def chunk() -> pa.RecordBatch:
            if number >= 1 << IN_TASK:
                raise ValueError("too many chunks in one task: read the input in smaller splits")
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                for b in held:
                    w.write_batch(b)
            return pa.RecordBatch.from_arrays([pa.array([first + number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "rows"])

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                if held and (size + part.nbytes > most_bytes or n + part.num_rows > most_rows):
                    yield chunk()
                    held, size, n, number = [], 0, 0, number + 1
                held.append(part)
                size, n = size + part.nbytes, n + part.num_rows
        if held:
            yield chunk()
        release_memory()

    return df.mapInArrow(cut, LOCATED)


def rows_of(chunk: bytes) -> pa.Table:
    return pa.ipc.open_stream(chunk).read_all()


def chunk_of(place):
    """The chunk of a row's place."""
    return F.shiftright(place, IN_CHUNK)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pack(a: np.ndarray) -> bytes:
    """Any integer or float array, its bytes regrouped by significance and compressed."""
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T if len(a) else np.empty(0, np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(b: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype)


def pack_sorted(a: np.ndarray) -> bytes:
    """Ascending uint64 keys as packed differences."""
    d = a.copy()
    d[1:] -= a[:-1]
    return pack(d)


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, np.uint64), dtype=np.uint64)


def cuts(keys: np.ndarray, buckets: int, step: int = 1) -> np.ndarray:
    """Where sorted keys are cut by ranges of ``step`` buckets: range i has keys[cuts[i]:cuts[i + 1]]."""
    first = np.array([(i << 64) // buckets for i in range(step, buckets, step)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, first), [len(keys)]]).astype(np.int64)


def pack_floats(a: np.ndarray) -> tuple:
    """Floats, of which many are 0 or equal: which are not 0, then those, or codes of them where few differ."""
    some = a != 0
    held = a[some]
    values, codes = held, None
    if len(np.unique(held[:4096])) <= 256:
        distinct, at = np.unique(held, return_inverse=True)
        if len(distinct) < 1 << 16:
            values, codes = distinct, pack(at.astype(np.uint16))
    return len(a), pack(np.packbits(some)), pack(values), codes


def unpack_floats(packed: tuple) -> np.ndarray:
    n, some, values, codes = packed
    out, held = np.zeros(n), unpack(values, np.float64)
    out[np.unpackbits(unpack(some, np.uint8), count=n).astype(bool)] = held if codes is None else held[unpack(codes, np.uint16)]
    return out


Columns = dict[str, "np.ndarray | pa.Array"]


def seal(columns: Columns) -> bytes:
    """Columns of entries as bytes: numbers packed (the column ``key`` ascends), Arrow arrays as compressed streams."""
    out: dict[str, tuple] = {}
    for name, c in columns.items():
        if isinstance(c, np.ndarray) and c.dtype == np.float64:
            out[name] = ("floats", pack_floats(c))
        elif isinstance(c, np.ndarray):
            out[name] = (c.dtype.str, pack_sorted(c) if name == "key" else pack(c))
        else:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([(name, c.type)]), options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(pa.RecordBatch.from_arrays([c], names=[name]))
            out[name] = ("arrow", sink.getvalue().to_pybytes())
    return pickle.dumps(out, protocol=5)


def unseal(body: bytes) -> Columns:
    found: Columns = {}
    for name, (kind, raw) in pickle.loads(body).items():
        if kind == "arrow":
            c = pa.ipc.open_stream(raw).read_all().column(0).combine_chunks()
            found[name] = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
        elif kind == "floats":
            found[name] = unpack_floats(raw)
        else:
            found[name] = unpack_sorted(raw) if name == "key" else unpack(raw, np.dtype(kind))
    return found


def joined(parts: list[Columns]) -> Columns:
    """Entries of several rows, one after the other."""
    return {n: (np.concatenate if isinstance(c, np.ndarray) else pa.concat_arrays)([p[n] for p in parts]) for n, c in parts[0].items()}


def taken(columns: Columns, at: np.ndarray) -> Columns:
    return {n: c[at] if isinstance(c, np.ndarray) else c.take(pa.array(at)) for n, c in columns.items()}


ROUTED = "lane int, range bigint, meet bigint, sender bigint, body binary"
REPLIED = "lane int, range bigint, sender bigint, body binary"


def as_batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in ddl.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


@dataclass(frozen=True)
class Route:
    """How entries get from chunks to buckets of keys and back. ``meets``: the number of groups of chunks at each level."""

    buckets: int
    meets: tuple[int, ...]
    fan: int

    @classmethod
    def of(cls, chunks: int, buckets: int, fan: int = 256) -> Route:
        meets = []
        while chunks > fan:
            chunks = -(-chunks // fan)
            meets.append(chunks)
        return cls(max(1, buckets), tuple(meets), fan)

    @property
    def steps(self) -> tuple[int, ...]:
        """Buckets in a range at each level. Each step divides the one before, and all the meetings of a level are about as many
        as the chunks: groups are cut by as much as senders have been put together."""
        steps = [1]
        for level in reversed(range(len(self.meets))):
            wanted = -(-self.buckets // self.fan ** (level + 1))
            steps.append(steps[-1] * max(1, -(-wanted // steps[-1])))
        return tuple(reversed(steps))

    def meeting(self, chunks: np.ndarray, level: int) -> np.ndarray:
        """The group of each chunk at a level; -1 is the chunk itself, and on the last level all meet."""
        if level < 0:
            return chunks
        if level == len(self.meets):
            return np.zeros(len(chunks), np.int64)
        at = (mix(chunks.astype(np.int64).view(np.uint64), np.uint64(3)) >> np.uint64(1)).astype(np.int64)
        for n in self.meets[: level + 1]:
            at = at % n
        return at

    def letters(self, lane: int, columns: Columns, level: int = 0) -> list[tuple]:
        """ROUTED rows of entries that are sorted by key and come from one sender."""
        if not len(columns["key"]):
            return []
        at = cuts(columns["key"], self.buckets, self.steps[level])
        one = columns["chunk"][:1]
        meet, sender = int(self.meeting(one, level)[0]), int(self.meeting(one, level - 1)[0])
        some = np.flatnonzero(np.diff(at)).tolist()
        return [(lane, i, meet, sender, seal({n: c[at[i] : at[i + 1]] for n, c in columns.items()})) for i in some]

    def forward(self, requests: DataFrame) -> DataFrame:
        """ROUTED rows as they reach the buckets: to be grouped by lane and range, which is the bucket now."""

        def hop(level: int):
            def put_together(group: pa.Table) -> pa.Table:
                columns = joined([unseal(b.as_py()) for b in group.column("body")])
                columns = taken(columns, np.argsort(columns["key"], kind="stable"))
                rows = self.letters(group.column("lane")[0].as_py(), columns, level)
                release_memory()
                return pa.Table.from_batches([as_batch(rows, ROUTED)])

            return put_together

        for level in range(1, len(self.meets) + 1):
            requests = requests.groupBy("lane", "range", "meet").applyInArrow(hop(level), ROUTED)
        return requests

    def backward(self, replies: DataFrame) -> DataFrame:
        """REPLIED rows of buckets, with the chunk of each entry, as they reach the chunks (sender); ranges ascend with the keys."""

        def hop(level: int, finer: int):
            def part(group: pa.Table) -> pa.Table:
                rows = sorted(group.select(["lane", "range", "sender", "body"]).to_pylist(), key=lambda r: r["range"])
                columns = joined([unseal(r["body"]) for r in rows])
                to = self.meeting(columns["chunk"], level - 1)
                order = np.argsort(to, kind="stable")
                edge = np.concatenate([np.flatnonzero(np.diff(to[order], prepend=to[order][0] - 1)), [len(to)]])
                lane, at = rows[0]["lane"], rows[0]["range"] // finer
                out = [(lane, at, int(to[order[a]]), seal(taken(columns, order[a:b]))) for a, b in zip(edge[:-1], edge[1:])]
                release_memory()
                return pa.Table.from_batches([as_batch(out, REPLIED)])

            return part

        for level in reversed(range(len(self.meets))):
            finer = self.steps[level] // self.steps[level + 1]
            coarse = F.floor(F.col("range") / finer).alias("coarse")
            replies = replies.groupBy("lane", coarse, "sender").applyInArrow(hop(level, finer), REPLIED)
        return replies


def replied(rows: list[dict]) -> Columns:
    """What came back to one chunk in one lane, in the order of its sorted distinct keys."""
    return joined([unseal(r["body"]) for r in sorted(rows, key=lambda r: r["range"])])


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of two 64-bit values (order matters)."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(29)
    return x


def release_memory() -> None:
    """Give freed memory back to the system. Workers live on between tasks, and the allocators would keep it for them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass
