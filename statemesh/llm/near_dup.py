"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

1. Each document becomes the set of its word shingles (64-bit hashes). Circulant MinHash draws all signature coordinates
   from two permutations: sigma spreads the shingles over D positions, and coordinate k is the least pi[(sigma(x) + k) mod D],
   the same pi shifted circularly. Bands of coordinates are hashed to band keys. The threshold decides how many: with 44
   bands of 8 rows a pair at 0.85 shares no band with probability 8e-7, and so does one at 0.80 with 46 bands of 6.
2. Documents are stored in chunks, so that each row has a place (chunk and row) of its own. Documents with equal sets form
   one class, named by its least place; only classes go on, so copies cost nothing further.
3. In each band bucket the classes are joined to the least of them, the hub (a star, not all pairs). A class is replaced by
   its least hub at once, so what goes on are distinct pairs of hubs. The connected parts of the stars hold every pair that
   shares a bucket; their sets are fetched once, by place, without moving the other documents.
4. Inside a part, links are confirmed on full sets. A prefix of rare shingles that any partner must share gives the
   candidates, and pairs that are already connected are skipped, so a group of near copies costs about one comparison each.
5. A part that is too large for one task is dealt to blocks. Blocks are solved alone, and their main groups are joined by
   one representative each. Then only band buckets that still hold several components are solved again: the classes outside
   a bucket's main component are held against all of its members. Pairs within one component need no check, so no link
   between components is lost, at any size.
6. Components of the confirmed links are labelled by the smallest doc_id. They are found by contraction: each round every
   node is replaced by the least of its neighbours in a new random order, so that the edges shrink from round to round.

Defined cases: null or wordless documents are linked with nothing; with fewer words than a shingle the whole sequence is
the one shingle; rows with equal texts share a class whatever their ids; a null doc_id takes part, but names a component
only if it has no other member; ``kept`` is true for each row whose doc_id is the component's; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .exchange import IN_CHUNK, chunk_of, located, mix, n_partitions, pack_sorted, release_memory, rows_of, stored, stored_by_chunk, unpack_sorted

BANDS, ROWS = 44, 8
#: Positions of the two permutations.
D = 1 << 22
_PI: list[np.ndarray] = []


def banding(percent: int, missed: float = 1e-6, most: int = 48) -> tuple[int, int]:
    """(bands, rows): as many rows, up to ROWS, as let most bands miss a pair at the threshold with this probability at most."""
    for rows in range(ROWS, 0, -1):
        bands = 1 if percent >= 100 else math.ceil(math.log(missed) / math.log1p(-((percent / 100) ** rows)))
        if bands <= most or rows == 1:
            return bands, rows


def circulant(bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """pi, continued by its first coordinates so that each shift is one contiguous run."""
    k = bands * rows
    if not _PI or len(_PI[0]) != D + k:
        pi = np.random.default_rng(20240229).permutation(D).astype(np.uint32)
        _PI[:] = [np.concatenate([pi, pi[:k]])]
    return _PI[0]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 250_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_sets(texts: list[bytes], hashes: dict, words: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    get = hashes.__getitem__
    out = []
    for text in texts:
        h = np.array(list(map(get, text.lower().split())), np.uint64)
        if len(h) > words:
            key = h[: len(h) - words + 1]
            for k in range(1, words):
                key = mix(key, h[k : len(h) - words + 1 + k])
            out.append(np.unique(key))
        elif len(h):
            key = h[:1]
            for k in range(1, len(h)):
                key = mix(key, h[k : k + 1])
            out.append(key if len(h) == words else mix(key, np.array([len(h)], np.uint64)))
        else:
            out.append(h)
    return out


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs."""
    a, b = mix(s, np.uint64(1)), mix(s, np.uint64(2))
    with np.errstate(over="ignore"):
        return int(a.sum(dtype=np.uint64).view(np.int64)), int((b.sum(dtype=np.uint64) ^ np.bitwise_xor.reduce(b)).view(np.int64))


def signature(s: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """All coordinates: for each shift the least value over the set."""
    k = bands * rows
    pi = circulant(bands, rows)
    shifts = np.lib.stride_tricks.sliding_window_view(pi, k)
    at = (mix(s, np.uint64(77)) % np.uint64(D)).astype(np.int64)
    least = shifts[at[:256]].min(0)
    for i in range(256, len(at), 256):
        np.minimum(least, shifts[at[i : i + 256]].min(0), out=least)
    return least


def band_keys(s: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    sig = signature(s, bands, rows).reshape(bands, rows).astype(np.uint64)
    key = np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        key = mix(key, sig[:, r])
    return key.view(np.int64)


def sketches(chunks: DataFrame, id_type: T.DataType, words: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(place, doc_id, n_shingles, h1, h2, bands) for every row of the chunks."""
    schema = T.StructType(
        [
            T.StructField("place", T.LongType()),
            T.StructField("doc_id", id_type),
            *(T.StructField(c, T.LongType()) for c in ("n_shingles", "h1", "h2")),
            T.StructField("bands", T.ArrayType(T.LongType())),
        ]
    )

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            for chunk, body in zip(batch.column("chunk").to_pylist(), batch.column("rows")):
                table = rows_of(body.as_py()).select(["doc_id", "text"])
                for at in range(0, table.num_rows, 256):
                    part = table.slice(at, 256).combine_chunks()
                    sets = shingle_sets([t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()], hashes, words)
                    keys = [set_key(s) if len(s) else (0, 0) for s in sets]
                    ids = part.column("doc_id")
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array((chunk << IN_CHUNK) + at + np.arange(len(sets))),
                            ids.chunk(0) if ids.num_chunks else pa.array([], ids.type),
                            pa.array([len(s) for s in sets], pa.int64()),
                            pa.array([k[0] for k in keys], pa.int64()),
                            pa.array([k[1] for k in keys], pa.int64()),
                            pa.array([band_keys(s, bands, rows) if len(s) else None for s in sets], pa.list_(pa.int64())),
                        ],
                        names=schema.names,
                    )
        hashes.clear()
        release_memory()

    return chunks.mapInArrow(sketch, schema)


def _order(node: Column, number: int, back: bool = False) -> Column:
    """A one-to-one map of longs: bits rotated and some flipped, others for each number; back: its inverse."""
    turn, flip = 1 + 23 * number % 63, (0x9E3779B97F4A7C15 * (number + 1)) % (1 << 63)
    rotated = lambda x, n: F.shiftleft(x, n).bitwiseOR(F.shiftrightunsigned(x, 64 - n))
    return rotated(node.bitwiseXOR(F.lit(flip)), 64 - turn) if back else rotated(node, turn).bitwiseXOR(F.lit(flip))


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label): the least node that each node of links(a, b) is connected with; loops are left out.

    Rounds of contraction: nodes go over to the least neighbour in a random order, and edges are taken between what their
    ends went over to, without loops and repetitions. Both are written to the shared folder each round; they shrink by a
    constant factor, so all rounds together cost a few times the first one.
    """
    pair = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
    edges = stored(links.where("a != b").select(*pair("a", "b")).distinct(), "edges")
    moves: list[DataFrame] = []
    while edges.limit(1).count():
        if len(moves) == most_rounds:
            raise RuntimeError("components did not settle")
        k = len(moves)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.min(_order(F.col("b"), k)).alias("least"))
        to = _order(F.least("least", _order(F.col("a"), k)), k, back=True)
        moves.append(stored(nearest.select(F.col("a").alias("node"), to.alias("label")), "moves"))
        of_a = moves[-1].select(F.col("node").alias("a"), F.col("label").alias("to_a"))
        of_b = moves[-1].select(F.col("node").alias("b"), F.col("label").alias("to_b"))
        moved = edges.join(of_a, "a").join(of_b, "b").where("to_a != to_b")
        edges = stored(moved.select(*pair("to_a", "to_b")).distinct(), "edges")
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    while len(moves) > 1:
        later = moves.pop().select(F.col("node").alias("via"), F.col("label").alias("over"))
        before = moves.pop().join(later, F.col("label") == F.col("via"), "left")
        moves.append(stored(before.select("node", F.coalesce("over", "label").alias("label")), "moves"))
    found = moves[0]
    least = found.groupBy("label").agg(F.least(F.min("node"), F.col("label")).alias("least"))
    return stored(found.join(least, "label").select("node", F.col("least").alias("label")), "components")


class _Forest:
    """Union-find with whole-array labels: label[i] is the component of i."""

    def __init__(self, labels: np.ndarray):
        self.label = labels
        self.members: dict[int, list[int]] = {}
        for i, c in enumerate(labels.tolist()):
            self.members.setdefault(c, []).append(i)

    def union(self, a: int, b: int) -> None:
        la, lb = int(self.label[a]), int(self.label[b])
        if la == lb:
            return
        if len(self.members[la]) < len(self.members[lb]):
            la, lb = lb, la
        moved = self.members.pop(lb)
        self.label[moved] = la
        self.members[la] += moved


def confirmed(sets: list[np.ndarray], labels: np.ndarray, against: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect what is linked: pairs (i, j) with 100 * common >= percent * union, none within one label.

    Only pairs with at least one side in ``against`` are looked at. The prefix of a set, its rarest shingles first, is so
    long that any partner must share one of it; candidates come from the prefixes' postings.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    flat = np.concatenate(sets)
    _, ids, df = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(df))
    order = np.lexsort([rank[ids], owner])
    ids = ids[order]  # by document, rarest first
    starts = np.concatenate([[0], np.cumsum(sizes)])
    need = -(-percent * sizes // 100)
    prefix = sizes - need + 1
    place = np.arange(len(ids)) - np.repeat(starts[:-1], sizes)
    posted = np.flatnonzero((place < np.repeat(prefix, sizes)) & (df[ids] > 1))
    by = posted[np.lexsort([owner[posted], ids[posted]])]
    p_ids, p_docs = ids[by], owner[by]
    first = np.searchsorted(p_ids, np.arange(len(df) + 1))
    mark = np.zeros(len(df), bool)
    forest, links = _Forest(labels), []
    mine = np.split(posted, np.searchsorted(owner[posted], np.arange(1, n)))
    for x in range(n):
        own = ids[mine[x]]
        if not len(own):
            continue
        near = np.concatenate([p_docs[first[s] : first[s + 1]] for s in own])
        near = near[forest.label[near] != forest.label[x]]
        near = near[near != x]
        if not against[x]:
            near = near[against[near]]
        else:
            near = near[(near < x) | ~against[near]]  # each pair once
        near = near[100 * np.minimum(sizes[near], sizes[x]) >= percent * np.maximum(sizes[near], sizes[x])]
        if not against[x] and len(near):
            continue  # the other side looks at this pair
        if not len(near):
            continue
        near, shared = np.unique(near, return_counts=True)
        near = near[np.argsort(-shared, kind="stable")]
        mark[ids[starts[x] : starts[x + 1]]] = True
        step = 4
        while len(near):
            some, near = near[:step], near[step:]
            step = 256
            spans = np.concatenate([ids[starts[y] : starts[y + 1]] for y in some])
            common = np.add.reduceat(mark[spans].astype(np.int64), np.concatenate([[0], np.cumsum(sizes[some])[:-1]]))
            for y in some[100 * common >= percent * (sizes[some] + sizes[x] - common)].tolist():
                if forest.label[y] != forest.label[x]:
                    forest.union(x, y)
                    links.append((x, y))
            near = near[forest.label[near] != forest.label[x]]
        mark[ids[starts[x] : starts[x + 1]]] = False
    return links


LINKS = "a bigint, b bigint"
#: What _confirm() reads besides its groups' keys.
SOLVED = ("node", "label", "against", "shingles")


def _confirm(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """LINKS of groups of rows(task, *keys, *SOLVED); a task solves its groups one by one."""

    def solve(group: pa.Table) -> pa.Table:
        a, b = [], []
        found: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(*(group.column(k).to_pylist() for k in keys))):
            found.setdefault(key, []).append(i)
        node, label = group.column("node").to_numpy(), group.column("label").to_numpy()
        against, blobs = group.column("against").to_pylist(), group.column("shingles")
        for own in found.values():
            one = list({int(node[i]): i for i in sorted(own, key=lambda i: against[i])}.values())  # a node once
            if len(one) < 2:
                continue
            sets = [unpack_sorted(blobs[i].as_py()) for i in one]
            _, at = np.unique(label[one], return_inverse=True)
            for x, y in confirmed(sets, at.astype(np.int64), np.array([against[i] for i in one]), percent):
                a.append(int(node[one[x]]))
                b.append(int(node[one[y]]))
        release_memory()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("task").applyInArrow(solve, LINKS)


def _task(parts: int, *keys: str):
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).alias("task")


def _grouped(chunks: DataFrame, id_type: T.DataType, percent: int, words: int, block_sets: int, block_shingles: int) -> DataFrame:
    """(place, doc_id, n_shingles, group, component_id) for every row of the chunks; group is null for wordless texts."""
    spark = chunks.sparkSession
    sketched = stored(sketches(chunks, id_type, words, *banding(percent)), "sketches")
    key = ["n_shingles", "h1", "h2"]
    filled = sketched.where("n_shingles > 0")
    banded = filled.groupBy(*key).agg(F.min("place").alias("node"), F.first("bands").alias("bands")).select("node", F.explode("bands").alias("band"))
    classes = stored(filled.groupBy(*key).agg(F.min("place").alias("node"), F.min("doc_id").alias("rep")), "classes")
    hubs = banded.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").select("band", "hub")
    stars = banded.join(hubs, "band").select("node", "hub")
    # at most one hub a band: from here on a class stands for its least hub
    met = stored(stars.groupBy("node").agg(F.min("hub").alias("least"), F.collect_set("hub").alias("hubs")), "stars")
    parts = components(met.select(F.col("least").alias("a"), F.explode("hubs").alias("b")).where("a != b").distinct())
    parts = parts.select(F.col("node").alias("least"), F.col("label").alias("part"))
    of_part = met.select("node", "least").join(parts, "least", "left").select("node", F.coalesce("part", "least").alias("part"))
    of_part = of_part.join(classes.select("node", "n_shingles"), "node")
    sized = of_part.groupBy("part").agg(F.count("*").alias("_c"), F.sum("n_shingles").alias("_s"))
    sized = sized.select("part", F.greatest(F.ceil(F.col("_c") / block_sets), F.ceil(F.col("_s") / block_shingles)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int").alias("block")
    wanted = stored(of_part.join(sized, "part").select(chunk_of("node").alias("chunk"), "node", "part", block, "blocks", "n_shingles"), "wanted")
    total = wanted.agg(F.sum("n_shingles").alias("s"), F.max("blocks").alias("b")).first()
    tasks = max(n_partitions(spark), -(-(total["s"] or 0) // block_shingles))

    def fetch(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        asked = right.select(["node", "part", "block", "blocks"])
        blobs: list[bytes] = []
        if asked.num_rows:
            texts = rows_of(left.column("rows")[0].as_py()).column("text")
            at = pa.array(asked.column("node").to_numpy() & ((1 << IN_CHUNK) - 1))
            hashes = _Hashes()
            blobs = [pack_sorted(s) for s in shingle_sets(texts.cast(pa.binary()).take(at).to_pylist(), hashes, words)]
            release_memory()
        return asked.append_column("shingles", pa.array(blobs, pa.binary()))

    own = chunks.groupBy("chunk").cogroup(wanted.groupBy("chunk"))
    sets = stored(own.applyInArrow(fetch, "node bigint, part bigint, block int, blocks int, shingles binary"), "sets")
    alone = sets.withColumns({"label": F.col("node"), "against": F.lit(True)})
    links = stored(_confirm(alone.select(_task(tasks, "part", "block"), "part", "block", *SOLVED), ["part", "block"], percent), "links")
    if (total["b"] or 0) > 1:
        links = links.unionByName(_across(sets.where("blocks > 1"), sketched, links, percent, tasks, block_sets, block_shingles))
    named = classes.join(components(links), "node", "left").withColumn("group", F.coalesce("label", "node"))
    smallest = named.groupBy("group").agg(F.min("rep").alias("component_id"))
    by_class = named.join(smallest, "group").select(*key, "component_id", "group")
    out = sketched.select("place", "doc_id", *key).join(by_class, key, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("place", "doc_id", "n_shingles", "group", component.alias("component_id"))


def near_duplicates(docs: DataFrame, percent: int = 85, words: int = 5, block_sets: int = 4096, block_shingles: int = 4_000_000) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text)."""
    ship(docs.sparkSession)
    chunks = stored_by_chunk(located(docs.select("doc_id", "text")), "documents", n_partitions(docs.sparkSession))
    found = _grouped(chunks, docs.schema["doc_id"].dataType, percent, words, block_sets, block_shingles)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = 85, words: int = 5, block_sets: int = 4096, block_shingles: int = 4_000_000) -> DataFrame:
    """The rows of docs (all columns, with doc_id and text) that stay: one of each component.

    It is the row with the smallest doc_id, of several the first place; rows without id come last. Wordless rows stay.
    """
    ship(docs.sparkSession)
    chunks = stored_by_chunk(located(docs), "documents", n_partitions(docs.sparkSession))
    found = _grouped(chunks, docs.schema["doc_id"].dataType, percent, words, block_sets, block_shingles)
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("place"))
    chosen = found.where(F.col("group").isNotNull()).groupBy("group").agg(F.min_by("place", rank).alias("place")).select("place")
    chosen = chosen.unionByName(found.where(F.col("group").isNull()).select("place"))
    kept = chosen.select(chunk_of("place").alias("chunk"), "place")

    def pick(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = rows_of(left.column("rows")[0].as_py())
        kept_rows = rows.take(pa.array(np.sort(right.column("place").to_numpy() & ((1 << IN_CHUNK) - 1))))
        release_memory()
        return kept_rows

    return chunks.groupBy("chunk").cogroup(kept.groupBy("chunk")).applyInArrow(pick, docs.schema)


def _across(sets: DataFrame, sketched: DataFrame, links: DataFrame, percent: int, tasks: int, block_sets: int, block_shingles: int) -> DataFrame:
    """Links between the blocks of parts that have several."""

    def labelled(nodes: DataFrame, found: DataFrame) -> DataFrame:
        joined = nodes.join(components(found), "node", "left")
        return joined.withColumn("label", F.coalesce("label", "node"))

    # one representative of each block's main group; representatives meet in blocks again, level by level
    now = labelled(sets, links).withColumn("against", F.lit(True))
    groups = now.groupBy("part", "block", "label").agg(F.count("*").alias("n"), F.min("node").alias("one"))
    main = groups.groupBy("part", "block").agg(F.max_by("one", F.struct("n", "label")).alias("node")).select("node")
    heads = stored(now.join(main, "node").select("part", *SOLVED), "heads")
    more, level = None, 0
    while True:
        sizes = heads.groupBy("part").agg(F.ceil(F.count("*") / block_sets).cast("int").alias("cuts"))
        cut = heads.join(sizes, "part").withColumn("cut", F.pmod(F.xxhash64("node", F.lit(100 + level)), F.col("cuts")).cast("int"))
        tried = cut.select(_task(tasks, "part", "cut"), "part", "cut", *SOLVED)
        met = stored(_confirm(tried, ["part", "cut"], percent), "links-heads")
        more = met if more is None else more.unionByName(met)
        if (sizes.agg(F.max("cuts")).first()[0] or 0) <= 1:
            break
        heads = stored(cut.groupBy("part", "cut").agg(F.min_by(F.struct(*SOLVED), "node").alias("h")).select("part", "h.*"), "heads")
        level += 1
    # band buckets with several components: who is outside the bucket's main one is held against all its members
    own = labelled(sets.select("node"), links.unionByName(more))
    banded = sketched.select(F.col("place").alias("node"), "bands", "n_shingles").join(own, "node")
    banded = stored(banded.select("node", "label", "n_shingles", F.explode("bands").alias("band")), "buckets")
    counts = banded.groupBy("band", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    mixed = counts.groupBy("band").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("k"))
    subs = F.greatest(F.ceil(F.col("n") / block_sets), F.ceil(F.col("s") / block_shingles)).cast("int").alias("subs")
    members = banded.join(mixed.where("k > 1").select("band", "main", subs), "band").withColumn("against", F.col("label") != F.col("main"))
    all_subs = F.sequence(F.lit(0), F.col("subs") - 1)
    one_sub = F.array(F.pmod(F.xxhash64("node", F.lit(4)), F.col("subs")).cast("int"))
    members = stored(members.withColumn("sub", F.explode(F.when(F.col("against"), all_subs).otherwise(one_sub))), "members")
    weight = members.agg(F.sum("n_shingles")).first()[0] or 0
    tasks = max(tasks, -(-weight // block_shingles))
    asked = members.join(sets.select("node", "shingles"), "node").select(_task(tasks, "band", "sub"), "band", "sub", *SOLVED)
    return more.unionByName(stored(_confirm(asked, ["band", "sub"], percent), "links-across"))
