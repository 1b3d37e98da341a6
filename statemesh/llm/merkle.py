"""A Merkle manifest of a dataset, level by level as DataFrames.

Each row is a leaf. Rows are numbered within their group (range partitions, ranks within them, prefix sums over the
partitions' counts), and a level's parents are its nodes grouped by their number divided by the fanout: the sorted array of a
run's children is hashed into its parent. A group's last node is its subroot; subroots, numbered in the order of their groups,
are the leaves of the tree above. Then proofs go down again: each level's runs are joined with the paths of their parents, and
every child puts its siblings before them. A level has a fanout-th of the rows of the one below, going up and coming down, so
all levels together move about as many rows as the leaves; a row for each leaf is made only once, at the end.

Only built-in functions are used. A group of any size is spread over all tasks: it is never one task's, not even for numbering.
Each level is written once to the shared folder, so a lost executor costs a part of one level.

Defined cases: a null value is ``-``; null groups come first, and null ids come first in their group; rows with equal ids go by
their digests, so that the tree is the same in every run; a group of one row is its own subroot; a single group's subroot is
still hashed no further (it is the root); other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exchange import stored

PATH = "array<struct<before:string,after:string>>"


def digest_of(values: list[Column]) -> Column:
    """sha256 of the values, each with its length in bytes before it."""
    text = [v.cast("string") for v in values]
    each = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]
    return F.sha2(F.concat(*each), 256)


def _hashed(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, ""), 256)


def numbered(leaves: DataFrame) -> DataFrame:
    """leaves(named, name, doc_id, leaf, row, ...) with g and idx, both from 0, and n: the group's place among groups, the row's
    place in its group and the rows of the group."""
    order = [F.col(c).asc_nulls_first() for c in ("named", "name", "doc_id", "leaf", "row")]
    ranged = stored(leaves.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "merkle-ranges")
    counts = ranged.groupBy("named", "name", "part").agg(F.count("*").alias("own"))
    # a row for each task and group: the windows below go over as many rows as there are tasks with rows of a group
    by_group = Window.partitionBy("named", "name")
    counts = counts.select(
        "*",
        (F.sum("own").over(by_group.orderBy("part")) - F.col("own")).alias("before"),
        F.sum("own").over(by_group).alias("n"),
        F.min("part").over(by_group).alias("starts"),
    )
    # groups ascend with the parts: a group's place is the groups that start in earlier parts, and those before it in its own
    begun = counts.where("part = starts").groupBy("starts").agg(F.count("*").alias("groups"))
    earlier = begun.select("starts", (F.sum("groups").over(Window.orderBy("starts")) - F.col("groups")).alias("earlier"))
    within = F.dense_rank().over(Window.partitionBy("starts").orderBy("named", "name"))
    placed = counts.join(earlier, "starts").select("named", "name", "part", "before", "n", (F.col("earlier") + within - 1).alias("g"))
    rank = F.row_number().over(Window.partitionBy("named", "name", "part").orderBy(*order[2:]))
    rows = ranged.withColumn("rank", rank).join(placed, ["named", "name", "part"])
    return rows.withColumn("idx", F.col("before") + F.col("rank") - 1)


def runs_of(nodes: DataFrame, fanout: int, kept: list[str]) -> DataFrame:
    """Parents of the nodes(g, idx, n, digest, ...) of groups that have several: g, idx, n, digest, and their sorted children."""
    parent = F.floor(F.col("idx") / fanout).alias("idx")
    grouped = nodes.where("n > 1").groupBy("g", parent).agg(
        F.sort_array(F.collect_list(F.struct("idx", "digest", *kept))).alias("children"),
        F.ceil(F.first("n") / fanout).alias("n"),
    )
    return grouped.withColumn("digest", _hashed(F.col("children.digest")))


def levels_of(nodes: DataFrame, fanout: int, most: int, kept: list[str], name: str) -> list[DataFrame]:
    """The runs of every level, from the lowest on; most: the nodes of the largest group."""
    levels = []
    while most > 1:
        levels.append(stored(runs_of(levels[-1] if levels else nodes, fanout, [] if levels else kept), f"merkle-{name}"))
        most = -(-most // fanout)
    return levels


def children_of(runs: DataFrame, paths: DataFrame, fanout: int, kept: list[str]) -> DataFrame:
    """(g, idx, path, kept...) of the children of runs whose own paths are known."""
    known = runs.select("g", "idx", "children").join(paths, ["g", "idx"])
    others = [c for c in known.columns if c not in ("idx", "children", "path")]
    hashes = F.col("children.digest")
    each = known.select(*others, "path", hashes.alias("hashes"), F.posexplode("children").alias("at", "child"))
    step = F.struct(
        F.array_join(F.slice("hashes", F.lit(1), F.col("at")), "").alias("before"),
        F.array_join(F.slice("hashes", F.col("at") + 2, F.lit(fanout)), "").alias("after"),
    )
    taken = [F.col(f"child.{c}").alias(c) for c in ("idx", *kept)]
    return each.select(*others, *taken, F.concat(F.array(step), "path").alias("path"))


def downward(levels: list[DataFrame], tops: dict[int, DataFrame], fanout: int, kept: list[str]) -> DataFrame | None:
    """(g, idx, path, ...) of all leaves that have siblings; tops: (g, path, ...) of the groups that end at a level."""
    paths = None
    for k in range(len(levels), 0, -1):
        if k in tops:
            own = tops[k].withColumn("idx", F.lit(0).cast("long"))
            paths = own if paths is None else paths.unionByName(own)
        paths = children_of(levels[k - 1], paths, fanout, kept if k == 1 else [])
        if k > 1 and k % 6 == 1:  # so that plans stay short however many levels there are
            paths = stored(paths, "merkle-paths")
    return paths


def manifest(
    rows: DataFrame,
    values: list[Column],
    group: str,
    row_id: str = "doc_id",
    tampered: tuple[Column, list[Column]] | None = None,
    fanout: int = 2,
) -> DataFrame:
    """(doc_id, leaf, subroot, root, path, changed) for every row: path holds the siblings before and after the node at each
    level up to the root; changed is the leaf of ``tampered`` values where its condition holds, else the leaf."""
    if fanout < 2:
        raise ValueError("fanout must be 2 or more")
    leaf = digest_of(values)
    changed = leaf if tampered is None else F.when(F.coalesce(tampered[0], F.lit(False)), digest_of(tampered[1])).otherwise(leaf)
    leaves = rows.select(
        F.col(group).isNotNull().alias("named"),
        F.coalesce(F.col(group).cast("string"), F.lit("")).alias("name"),
        F.col(row_id).alias("doc_id"),
        leaf.alias("leaf"),
        changed.alias("changed"),
        F.monotonically_increasing_id().alias("row"),
    )
    placed = numbered(stored(leaves, "merkle-leaves"))
    nodes = stored(placed.select("g", "idx", "n", F.col("leaf").alias("digest"), "doc_id", "changed"), "merkle-nodes")
    kept = ["doc_id", "changed"]
    found = nodes.agg(F.max("n").alias("most"), F.max("g").alias("last")).first()
    most, groups = found["most"] or 0, (-1 if found["last"] is None else found["last"]) + 1
    levels = levels_of(nodes, fanout, most, kept, "level")
    ends = [x.where("n = 1").select("g", "digest") for x in [nodes, *levels]]  # of the groups that end at each level
    subroots = reduce(DataFrame.unionByName, ends)
    # the tree over the subroots
    zero, none = F.lit(0).cast("long"), F.expr(f"cast(array() as {PATH})").alias("path")
    above = stored(subroots.select(zero.alias("g"), F.col("g").alias("idx"), F.lit(groups).cast("long").alias("n"), "digest"), "merkle-subroots")
    upper = levels_of(above, fanout, groups, [], "upper")
    head = (upper[-1] if upper else above).select("digest").first()
    root = F.lit(head["digest"] if head else None).cast("string")
    top = {len(upper): rows.sparkSession.range(1).select(zero.alias("g"), none)}
    over = downward(upper, top, fanout, []) if upper else above.select("idx", none)
    paths = stored(over.select(F.col("idx").alias("g"), "path").join(subroots.withColumnRenamed("digest", "subroot"), "g"), "merkle-over")
    tops = {k: paths.join(t.select("g"), "g") for k, t in enumerate(ends)}
    out = ["doc_id", "digest", "subroot", "path", "changed"]
    alone = nodes.where("n = 1").select("g", "digest", *kept).join(paths, "g").select(*out)
    rest = downward(levels, tops, fanout, ["digest", *kept])
    whole = alone if rest is None else alone.unionByName(rest.select(*out))
    return whole.select("doc_id", F.col("digest").alias("leaf"), "subroot", root.alias("root"), "path", "changed")


def proof_digest(path: Column) -> Column:
    """sha256 of all siblings, from the leaf up."""
    return _hashed(F.transform(path, lambda s: F.concat(s["before"], s["after"])))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda x, s: F.sha2(F.concat(s["before"], x, s["after"]), 256))


def verified_rows(docs: DataFrame, fanout: int = 2) -> DataFrame:
    """The manifest of documents by language, with every row's proof folded; rows of which the checksum of the id is divisible by
    seven are tampered with (one more in n_chars) before that."""
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    values = [F.col(c) for c in names]
    other = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in names]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    rows = manifest(docs.select(*names), values, "lang", tampered=(hit, other), fanout=fanout)
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded(F.col("changed"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
