"""Katz backoff language model: training and scoring of whole corpora.

Model. Counts c of n-grams over the training documents; every document is its words and one end token, preceded by
``order - 1`` start symbols that are context only. Counts up to ``k`` are multiplied by Good-Turing discounts d_c from the
counts of counts of their order. For a context h with D = sum of d_c * c over its seen continuations and leftover
L = max(sum of c - D, 0.5):

    P(w | h) = d_c * c / (D + L)                    if hw was seen
             = alpha(h) * P(w | h without its oldest word)   if h was seen, but not hw
             = P(w | h without its oldest word)              if h was never seen
    alpha(h) = (L / (D + L)) / (1 - sum over seen w of P(w | h without its oldest word))

At the lowest order the leftover belongs to the one symbol for unknown words. Every context's probabilities thus sum to
one exactly, over the vocabulary and that symbol. Evaluation recurs from the highest order down, token by token.

Tables. N-grams are 64-bit hashes; counts and backoff weights are stored in the shared folder, partitioned by kind and
order, as packed runs by chunk and key range. One chunk owns each n-gram, and its runs hold the n-gram's count and, as in ARPA
files, the weight of the context that it is. Runs have no keys: they follow the chunk's sorted distinct n-grams, which its stored
tokens give again (``ngrams`` puts all together as a table). What a chunk looks up without owning it stands in its runs as well.
Alphas that are only owned have 32 bits; those that score are exact. Keys are counted, and contexts weighed, in
passes over parts of their range, and each pass's shuffle files go once its answers are stored. A chunk of documents asks for each distinct n-gram once, so what is moved
follows the distinct n-grams of chunks, not the tokens; a frequent n-gram costs one entry a chunk. A bucket answers every
chunk in the pass that adds its counts up, and says which chunk owns each n-gram: owners add up the context
sums, so no second shuffle of the n-gram table is needed. It also numbers its n-grams in their order, from where its range begins:
contexts go by those numbers later, which lie as the keys do and pack to a fraction of their bytes. Requests and answers
go by exchange.Route, whose rows follow the corpus and not its square. Nothing but counts of counts comes to the driver.

Defined cases: null text is one end token; a null id is hashed as the empty text, which holds it out; without any
training document every token is unknown; repeated rows train and are scored each; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .exchange import REPLIED, ROUTED, Route, as_batch, joined, mix, n_partitions, pack, pack_sorted, release_memory, replied, seal, stored, stored_by_chunk, unpack, unpack_sorted, unseal

#: Hashes of symbols that no word can equal: words hold no blank.
END = np.uint64(xxhash.xxh3_64_intdigest(b" end"))
START = np.uint64(xxhash.xxh3_64_intdigest(b" start"))


class _Numbers(dict):
    """Numbers of words as they come."""

    def __missing__(self, word: bytes | None) -> int:
        n = self[word] = len(self)
        return n


def _sorting(a: np.ndarray) -> np.ndarray:
    """np.argsort of uint64, by sorting what tells keys apart together with their places, which is much quicker."""
    if not len(a):
        return np.empty(0, np.int64)
    low, bits = a.min(), (len(a) - 1).bit_length()
    drop = max(0, int(a.max() - low).bit_length() + bits - 64)
    both = ((a - low) >> np.uint64(drop) << np.uint64(bits)) | np.arange(len(a), dtype=np.uint64)
    both.sort()
    order = (both & np.uint64((1 << bits) - 1)).view(np.int64)
    if drop:
        ascending = a[order]
        if (ascending[1:] < ascending[:-1]).any():  # keys that differ in dropped bits only
            return np.argsort(a, kind="stable")
    return order


def _distinct(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and each entry's place among them."""
    order = _sorting(a)
    ascending = a[order]
    new = np.ones(len(a), bool)
    new[1:] = ascending[1:] != ascending[:-1]
    at = np.empty(len(a), np.int64)
    at[order] = np.cumsum(new) - 1
    return ascending[new], at


def _by_chunks(chunks: np.ndarray) -> np.ndarray | slice:
    """What puts entries in the order of their chunks."""
    return slice(None) if (chunks[1:] >= chunks[:-1]).all() else np.argsort(chunks, kind="stable")


@dataclass(frozen=True)
class Pass:
    """Part ``i`` of ``n`` of the range of keys, cut where buckets are."""

    i: int
    n: int
    buckets: int

    def bound(self, i: int) -> int:
        return (self.buckets * i // self.n << 64) // self.buckets

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Which keys are in this part."""
        inside = keys >= np.uint64(self.bound(self.i))
        return inside & (keys < np.uint64(self.bound(self.i + 1))) if self.i + 1 < self.n else inside

    def span(self, ascending: np.ndarray) -> slice:
        """Where sorted keys are in this part."""
        end = np.searchsorted(ascending, np.uint64(self.bound(self.i + 1))) if self.i + 1 < self.n else len(ascending)
        return slice(int(np.searchsorted(ascending, np.uint64(self.bound(self.i)))), int(end))


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written meanwhile are removed with the end of each write, not with the next collection."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@dataclass
class Discounts:
    """Of one order: Good-Turing factors by count (1 beyond k), for any array of counts."""

    factors: np.ndarray

    def of(self, counts: np.ndarray) -> np.ndarray:
        return self.factors[np.minimum(counts, len(self.factors) - 1)]


def good_turing(count_of: dict[int, int], k: int) -> Discounts:
    """Factors d_1..d_k from n_1..n_(k+1); where those are too thin to give factors in (0, 1], absolute ones."""
    n = [0] + [count_of.get(r, 0) for r in range(1, k + 2)]
    factors = np.ones(k + 2)
    factors[0] = 0.0
    if n[1] and n[2]:
        absolute = n[1] / (n[1] + 2 * n[2])
        tail = (k + 1) * n[k + 1] / n[1]
        for r in range(1, k + 1):
            d = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if n[r] and tail < 1 else 0.0
            factors[r] = d if 0 < d <= 1 else max(r - absolute, 0.1) / r
    elif n[1]:
        factors[1] = 0.5
    return Discounts(factors)


CHUNKS = T.StructType(
    [
        T.StructField("chunk", T.LongType()),
        T.StructField("doc_ids", T.BinaryType()),  # an Arrow stream: ids of any type
        T.StructField("lengths", T.BinaryType()),
        T.StructField("held", T.BinaryType()),
        T.StructField("words", T.BinaryType()),
        T.StructField("tokens", T.BinaryType()),
        T.StructField("n_tokens", T.LongType()),
    ]
)


def _stream(ids: pa.Array) -> bytes:
    batch = pa.RecordBatch.from_arrays([ids], names=["doc_id"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _ids(stream: bytes) -> pa.Array:
    return pa.ipc.open_stream(stream).read_all().column(0).combine_chunks()


def tokenised(docs: DataFrame, fold: int, max_tokens: int) -> DataFrame:
    """CHUNKS of docs(doc_id, text): word hashes, the frequent first, and tokens as numbers of those."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, number = _Numbers(), 0
        get = seen.__getitem__
        first = TaskContext.get().partitionId() << 32
        ids, lengths, held, pieces, size = [], [], [], [], 0

        def chunk() -> pa.RecordBatch:
            tokens = np.concatenate(pieces)
            words = np.fromiter((END if w is None else xxhash.xxh3_64_intdigest(w) for w in seen), np.uint64, len(seen))
            # numbers are small for frequent words, and hashes ascend among words that are about as frequent
            order = np.lexsort((words, -np.frexp(np.bincount(tokens, minlength=len(words)))[1]))
            place = np.empty(len(words), np.uint32)
            place[order] = np.arange(len(words))
            row = (
                first + number,
                _stream(pa.concat_arrays(ids)),
                pack(np.array(lengths, np.int64)),
                pack(np.array(held, np.uint8)),
                pack_sorted(words[order]),
                pack(place[tokens]),
                len(tokens),
            )
            kinds = [pa.int64(), *[pa.binary()] * 5, pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=CHUNKS.names)

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                if size >= max_tokens:
                    yield chunk()
                    ids, lengths, held, pieces, size, number = [], [], [], [], 0, number + 1
                    seen.clear()
                flat: list[int] = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("body").to_pylist()):
                    before = len(flat)
                    flat += map(get, (text or b"").lower().split())
                    flat.append(get(None))
                    lengths.append(len(flat) - before)
                    held.append(zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % fold == 0)
                ids.append(part.column("doc_id"))
                pieces.append(np.array(flat, np.uint32))
                size += len(flat)
        if pieces:
            yield chunk()
        seen.clear()
        release_memory()

    return docs.select("doc_id", F.col("text").cast("binary").alias("body")).mapInArrow(rows, CHUNKS)


def lead(m: int) -> np.uint64:
    """The context of order m before a document's first token."""
    at = np.array([START])
    for _ in range(m - 2):
        at = mix(at, np.array([START]))
    return at[0]


class Chunk:
    """A chunk opened: grams(m) are the m-gram hashes by token, contexts(m) those of the m-1 tokens before."""

    def __init__(self, row: dict):
        self.lengths = unpack(row["lengths"], np.int64)
        self.held = unpack(row["held"], np.uint8).astype(bool)
        self.words, self.numbers = unpack_sorted(row["words"]), unpack(row["tokens"], np.uint32)
        self.tokens = self.words[self.numbers]
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.trained = ~np.repeat(self.held, self.lengths)
        self._grams = {0: np.zeros(len(self.tokens), np.uint64), 1: self.tokens}

    def contexts(self, m: int) -> np.ndarray:
        """Hash of the m-1 symbols before each token (start symbols before the first)."""
        if m == 1:
            return self._grams[0]
        before = np.empty_like(self.tokens)
        g = self.grams(m - 1)
        before[1:] = g[:-1]
        before[self.starts] = lead(m)
        return before

    def grams(self, m: int) -> np.ndarray:
        if m not in self._grams:
            self._grams[m] = mix(self.contexts(m), self.tokens)
        return self._grams[m]

    def asked(self, m: int, order: int) -> tuple[np.ndarray, np.ndarray]:
        """What is looked up of order m in a model of an order, and how often in training: words, else the m-gram of each token;
        then, as it is a context, the lead."""
        if m == 1:
            grams, times = self.words, np.bincount(self.numbers[self.trained], minlength=len(self.words))
        else:
            grams, times = self.grams(m), self.trained.astype(np.int64)
        return (grams, times) if m == order else (np.append(grams, lead(m + 1)), np.append(times, 0))


ANSWER = f"kind string, {REPLIED}"


def _given(group: pa.Table) -> tuple[int, int, list[tuple[int, int]], dict]:
    """(lane, bucket, (sender, entries) of each row, all entries)."""
    rows = sorted(group.select(["lane", "range", "sender", "body"]).to_pylist(), key=lambda r: r["sender"])
    parts = [unseal(r["body"]) for r in rows]
    return rows[0]["lane"], rows[0]["range"], [(r["sender"], len(p["key"])) for r, p in zip(rows, parts)], joined(parts)


def _answers(kind: str, lane: int, bucket: int, given: list[tuple[int, int]], columns: dict) -> list[tuple]:
    out, first = [], 0
    for sender, n in given:
        out.append((kind, lane, bucket, sender, seal({name: c[first : first + n] for name, c in columns.items()})))
        first += n
    return out


def count_requests(chunks: DataFrame, order: int, route: Route, part: Pass) -> DataFrame:
    """ROUTED rows: each chunk's distinct n-grams of orders 1 to order in that part, with their counts in training documents."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row)
                for m in range(1, order + 1):
                    grams, times = chunk.asked(m, order)
                    some = part.of(grams)
                    keys, at = _distinct(grams[some])
                    counts = np.bincount(at, weights=times[some], minlength=len(keys)).astype(np.uint32)
                    entries = {"key": keys, "chunk": np.full(len(keys), row["chunk"]), "n": counts}
                    yield as_batch(route.letters(m, entries), ROUTED)
                del chunk, grams, times, some, keys, at, counts, entries
                release_memory()

    return chunks.mapInArrow(ask, ROUTED)


def count_answers(requests: DataFrame, k: int, order: int, route: Route) -> DataFrame:
    """ANSWER rows: 'reply' (totals for a chunk, doubled, plus 1 where it owns the n-gram; below the model's order also numbers), 'stats'."""

    def add_up(group: pa.Table) -> pa.Table:
        m, bucket, given, entries = _given(group)
        counts = entries["n"].astype(np.int64)
        keys, at = _distinct(entries["key"])
        totals = np.bincount(at, weights=counts, minlength=len(keys)).astype(np.uint64)
        nonzero = np.flatnonzero(counts)
        nonzero = nonzero[_by_chunks(entries["chunk"][nonzero])][::-1]
        owner = np.empty(len(keys), np.int64)
        owner[at[nonzero]] = nonzero  # what is put last stays: the first chunk with the n-gram in training
        reply = totals[at] * np.uint64(2)
        reply[owner[totals > 0]] += np.uint64(1)
        numbers = {"key": np.uint64((bucket << 64) // route.buckets) + at.astype(np.uint64)} if m < order else {}
        out = _answers("reply", m, bucket, given, {"chunk": entries["chunk"], **numbers, "v": reply})
        release_memory()
        stats = np.concatenate([[(totals > 0).sum(), totals.sum()], np.bincount(np.minimum(totals, k + 2).astype(np.int64), minlength=k + 3)])
        out.append(("stats", m, bucket, 0, stats.astype(np.int64).tobytes()))
        return pa.Table.from_batches([as_batch(out, ANSWER)])

    return requests.groupBy("lane", "range").applyInArrow(add_up, ANSWER)


def statistics_of(answers: DataFrame, k: int) -> dict[int, np.ndarray]:
    """By order: distinct n-grams, tokens, then counts of counts 0..k+2 (the last: and above). Added up in the cluster."""
    rows = answers.where("kind = 'stats'").select("lane", "body")
    width = k + 5
    schema = "order int, i int, v bigint"

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(o, i, int(v)) for o, a in zip(*map(pa.Array.to_pylist, batch.columns)) for i, v in enumerate(np.frombuffer(a, np.int64))]
            yield as_batch(out, schema)

    found: dict[int, np.ndarray] = {}
    for r in rows.mapInArrow(spread, schema).groupBy("order", "i").agg(F.sum("v").alias("v")).collect():  # orders x (k+5) rows
        found.setdefault(r["order"], np.zeros(width, np.int64))[r["i"]] = r["v"]
    return found


class Evaluation:
    """What one chunk knows, up to an order: totals by n-gram (from order ``first`` on) and, where the context sums are known,
    context weights."""

    def __init__(self, row: dict, replies: list[dict], model: dict, order: int, first: int = 1):
        self.chunk, self.model = Chunk(row), model
        by: dict[tuple, list] = {}
        for r in replies:
            by.setdefault((r["kind"], r["lane"]), []).append(r)
        self.keys, self.index, self.lead, self.count, self.owner, self.number, self.weight = {}, {}, {}, {}, {}, {}, {}
        for m in range(1, order + 1):
            self.keys[m], at = _distinct(self.chunk.asked(m, model["order"])[0])
            self.index[m] = at[self.chunk.numbers] if m == 1 else at[: len(self.chunk.tokens)]
            self.lead[m] = int(at[-1])  # if m is below the model's order
        for m in range(first, order + 1):
            found = replied(by[("reply", m)])
            v = found["v"]
            assert len(v) == len(self.keys[m]), "a reply is missing"
            self.count[m], self.owner[m] = (v >> np.uint64(1)).astype(np.int64), (v & np.uint64(1)).astype(bool)
            if m < model["order"]:
                self.number[m] = found["key"]
        for m in range(2, order + 1):
            if ("weights", m) in by:
                self.weight[m] = replied(by[("weights", m)])
                assert len(self.weight[m]["total"]) == len(self.keys[m - 1]), "a weight is missing"

    def counts(self, m: int) -> np.ndarray:
        """The total of the m-gram that each token ends."""
        return self.count[m][self.index[m]]

    def contexts(self, m: int) -> np.ndarray:
        """Each token's context of order m among keys[m - 1]."""
        at = np.empty_like(self.index[m - 1])
        at[1:] = self.index[m - 1][:-1]
        at[self.chunk.starts] = self.lead[m - 1]
        return at

    def probability_of_seen(self, m: int) -> np.ndarray:
        """P of each token given its m-1 symbols before, where they were seen together; 0 elsewhere."""
        counts = self.counts(m)
        discounted = self.model["discounts"][m].of(counts) * counts
        if m == 1:
            return discounted / self.model["total"]
        total = self.weight[m]["total"][self.contexts(m)]
        return discounted / np.where(total > 0, total, 1.0)

    def probability(self, m: int) -> np.ndarray:
        """P of each token given its m-1 symbols before: recurs to the lower orders."""
        seen, own = self.counts(m) > 0, self.probability_of_seen(m)
        if m == 1:
            return np.where(seen, own, self.model["unknown"] / self.model["total"])
        at = self.contexts(m)
        total, alpha = self.weight[m]["total"][at], self.weight[m]["alpha"][at]
        return np.where(seen, own, np.where(total > 0, alpha, 1.0) * self.probability(m - 1))


#: What a chunk says of a context: a held-out token follows it, or it is the lead; it is an n-gram that the chunk owns.
ASKS, OWNS = 1, 2


def context_requests(chunks: DataFrame, replies: DataFrame, model: dict, m: int, route: Route, part: Pass) -> DataFrame:
    """ROUTED rows: each chunk's contexts of order m in that part; over the m-grams it owns the sums of c, of d_c * c and of lower P
    (in units of 2^-48: rounding of sums near one is of that size).

    Contexts go by their numbers. Only where a held-out token follows, an m-gram can be unseen: only there a backoff weight is
    asked for; owners keep one.
    """

    def ask(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for row in left.to_pylist():
            e = Evaluation(row, right.to_pylist(), model, m, m - 1)
            keys, at = e.number[m - 1], e.contexts(m)
            first = np.zeros(len(e.count[m]), np.int64)
            first[e.index[m][::-1]] = np.arange(len(at))[::-1]  # a token that stands for each distinct m-gram
            own = np.flatnonzero(e.owner[m])
            c, context = e.count[m][own], at[first[own]]
            lower = np.rint(e.probability_of_seen(m - 1)[first[own]] * 2.0**48) / 2.0**48
            sums = [np.bincount(context, weights=w, minlength=len(keys)) for w in (c, model["discounts"][m].of(c) * c, lower)]
            says = np.where(e.owner[m - 1], OWNS, 0).astype(np.uint8)
            says[at[~e.chunk.trained]] |= ASKS
            says[e.lead[m - 1]] |= ASKS
            some = part.span(keys)
            entries = {"key": keys[some], "chunk": np.full(some.stop - some.start, row["chunk"]), "says": says[some]}
            out += route.letters(m, entries | {"count": sums[0][some].astype(np.uint64), "kept": sums[1][some], "lower": sums[2][some]})
            del e, keys, at, first, own, c, context, lower, sums, says, entries
            release_memory()
        return pa.Table.from_batches([as_batch(out, ROUTED)])

    lane = F.col("lane")
    used = replies.where(((F.col("kind") == "reply") & lane.isin(m - 1, m)) | ((F.col("kind") == "weights") & (lane == m - 1)))
    return chunks.groupBy("chunk").cogroup(_by_chunk(used)).applyInArrow(ask, ROUTED)


def _by_chunk(replies: DataFrame):
    return replies.withColumnRenamed("sender", "chunk").groupBy("chunk")


def context_answers(requests: DataFrame) -> DataFrame:
    """ANSWER rows: 'weights' for each chunk (D + L, 0 for unseen contexts; alpha where asked, with 32 bits where only owned)."""

    def add_up(group: pa.Table) -> pa.Table:
        order, bucket, given, entries = _given(group)
        # chunks add in one order, whatever the order of arrival
        by = _by_chunks(entries["chunk"])
        keys, at = _distinct(entries["key"])
        count, kept, lower = (np.bincount(at[by], weights=entries[c][by].astype(np.float64), minlength=len(keys)) for c in ("count", "kept", "lower"))
        seen = count > 0
        left = np.maximum(count - kept, 0.5)
        total = np.where(seen, kept + left, 0.0)
        alpha = np.where(seen, left / np.where(seen, total, 1.0) / np.maximum(1.0 - lower, 1e-12), 1.0)
        kept_alpha = np.where(entries["says"] & OWNS, alpha.astype(np.float32)[at], 0.0)
        wanted = np.where(entries["says"] & ASKS, alpha[at], kept_alpha)
        out = _answers("weights", order, bucket, given, {"chunk": entries["chunk"], "total": total[at], "alpha": wanted})
        release_memory()
        return pa.Table.from_batches([as_batch(out, ANSWER)])

    return requests.groupBy("lane", "range").applyInArrow(add_up, ANSWER)


@dataclass
class KatzModel:
    """Stored tables and the few numbers that the driver holds."""

    chunks: DataFrame
    replies: DataFrame
    numbers: dict


def _returned(answers: DataFrame, kind: str, route: Route) -> DataFrame:
    """(kind, lane, range, sender, body) of one kind, by chunk."""
    back = route.backward(answers.where(F.col("kind") == kind).drop("kind"))
    if route.meets:
        back = stored(back, f"katz-{kind}")
    return back.select(F.lit(kind).alias("kind"), *REPLIED_NAMES)


REPLIED_NAMES = [f.split()[0] for f in REPLIED.split(", ")]


def _in_passes(make: Callable[[Pass], DataFrame], passes: int, route: Route, name: str) -> DataFrame:
    """ANSWER rows of all passes, each stored before the next begins."""
    n = min(passes, route.buckets)
    made = [stored(make(Pass(i, n, route.buckets)), name, ("kind", "lane")) for i in range(n)]
    return reduce(DataFrame.unionByName, made)


def fit(
    docs: DataFrame, order: int = 3, k: int = 5, fold: int = 10, max_tokens: int = 1_500_000, bucket_keys: int = 2_000_000, fan: int = 256, passes: int = 2
) -> KatzModel:
    """Train on documents whose crc32(doc_id as text) mod fold is not 0; all documents' look-ups are prepared.

    passes: into how many parts keys are dealt that are exchanged one part after the other at each level of the exchange, half as
    many for contexts; more take less disk and more time.
    """
    with _shuffles_go(docs.sparkSession):
        return _fit(docs, order, k, fold, max_tokens, bucket_keys, fan, passes)


def _fit(docs: DataFrame, order: int, k: int, fold: int, max_tokens: int, bucket_keys: int, fan: int, passes: int) -> KatzModel:
    spark = docs.sparkSession
    ship(spark)
    parts = n_partitions(spark)
    chunks = stored_by_chunk(tokenised(docs, fold, max_tokens), "katz", parts)
    sizes = chunks.agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("chunks")).first()
    route = Route.of(sizes["chunks"], max(4, -(-(sizes["tokens"] or 0) // bucket_keys)), fan)
    counted = lambda part: count_answers(route.forward(count_requests(chunks, order, route, part)), k, order, route)
    levels = 1 + len(route.meets)
    answers = _in_passes(counted, passes * levels, route, "katz-counts")
    stats = statistics_of(answers, k)
    empty = np.zeros(k + 5, np.int64)
    discounts = {m: good_turing(dict(enumerate(map(int, stats.get(m, empty)[2:]))), k) for m in range(1, order + 1)}
    # the lowest order: n_1..n_k are scaled by their factors, larger counts stay whole
    n = stats.get(1, empty)
    total = int(n[1])
    kept = total - sum(r * int(n[2 + r]) * (1 - discounts[1].factors[r]) for r in range(1, k + 1))
    unknown = max(total - kept, 0.5)
    numbers = {"order": order, "discounts": discounts, "unknown": unknown, "total": kept + unknown, "tokens": total, "distinct": int(n[0])}
    replies = _returned(answers, "reply", route)
    for m in range(2, order + 1):
        weighed = lambda part, m=m, replies=replies: context_answers(route.forward(context_requests(chunks, replies, numbers, m, route, part)))
        n_passes = -(-passes // 2) * levels if m > 2 else 1  # contexts of order 2 are words
        weights = _in_passes(weighed, n_passes, route, f"katz-weights-{m}")
        replies = replies.unionByName(_returned(weights, "weights", route))
    return KatzModel(chunks, replies, numbers)


def ngrams(model: KatzModel, m: int) -> DataFrame:
    """The model as a table: (key, count, total, alpha) of the n-grams of order m; total is 0 and alpha 1 of what is no context.
    Contexts of the highest order have no longer ones: their weights are null."""
    schema = "key bigint, count bigint, total double, alpha float"
    numbers, top = model.numbers, m == model.numbers["order"]

    def opened(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        tables = []
        for row in left.to_pylist():
            e = Evaluation(row, right.to_pylist(), numbers, m if top else m + 1)
            own = e.owner[m]
            weights = [pa.nulls(int(own.sum()), t) if top else pa.array(e.weight[m + 1][c][own], t) for c, t in (("total", pa.float64()), ("alpha", pa.float32()))]
            columns = [pa.array(e.keys[m][own].view(np.int64)), pa.array(e.count[m][own]), *weights]
            tables.append(pa.Table.from_arrays(columns, names=["key", "count", "total", "alpha"]))
            del e, own, weights, columns
            release_memory()
        return pa.concat_tables(tables)

    return model.chunks.groupBy("chunk").cogroup(_by_chunk(model.replies)).applyInArrow(opened, schema)


def score(model: KatzModel, id_type: T.DataType) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    numbers = model.numbers
    schema = T.StructType(
        [
            T.StructField("doc_id", id_type),
            T.StructField("held_out", T.BooleanType()),
            *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")),
            T.StructField("base_score", T.DoubleType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    shown = pa.schema([("doc_id", pa.null()), ("held_out", pa.bool_()), *((c, pa.int64()) for c in schema.names[2:5]), ("base_score", pa.float64()), ("score", pa.float64())])

    def evaluate(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        tables = []
        for row in left.to_pylist():
            e = Evaluation(row, right.to_pylist(), numbers, numbers["order"])
            c = e.counts(1)
            add = lambda v: np.add.reduceat(v, e.chunk.starts)  # noqa: E731  every document has a token
            base = np.log10((c + 0.1) / (numbers["tokens"] + 0.1 * (numbers["distinct"] + 1)))
            n = len(e.chunk.lengths)
            columns = [
                _ids(row["doc_ids"]),
                pa.array(e.chunk.held),
                pa.array(e.chunk.lengths),
                pa.array(add((c > 0).astype(np.int64))),
                pa.array(np.full(n, numbers["tokens"], np.int64)),
                pa.array(add(base)),
                pa.array(add(np.log10(e.probability(numbers["order"])))),
            ]
            tables.append(pa.Table.from_arrays(columns, names=shown.names))
            del e, c, base, columns, add
            release_memory()
        return pa.concat_tables(tables)

    return model.chunks.groupBy("chunk").cogroup(_by_chunk(model.replies)).applyInArrow(evaluate, schema)


def katz_scores(docs: DataFrame, order: int = 3, k: int = 5, fold: int = 10, max_tokens: int = 1_500_000, **sizes: int) -> DataFrame:
    """Train on the documents that are not held out and score every one. sizes: bucket_keys and fan, see fit()."""
    return score(fit(docs, order, k, fold, max_tokens, **sizes), docs.schema["doc_id"].dataType)
