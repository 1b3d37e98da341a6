"""How many pairs of a block stand in each relation, counted without forming the pairs: for whole blocks of any size.

Two numbers agree only if they lie close together, and everything else that a verdict goes by is a claim's profile: scope, kind,
currency and whether its period is unreliable. So pairs are counted by profile, those that agree are counted in the
order of values, and the comparator is asked once for each two profiles that meet. Values lie in bins of a block's order, which a
claim enters if its reach does, so that no task holds a block. Doubles only tell what is sure: pairs near a limit
go to the comparator itself. Claims without a plain number (ratios, ranges, dates, texts) are compared pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import CANONICAL
from ..session import ship, stored
from .compare import RELATIVE, currencies_clash, pair_sides, values_agree, with_verdict
from .pairing import TILE, whole_pairs

BLOCK, PLACE = ["subject_id", "predicate_id"], ["document_id", "page"]
#: What a verdict goes by, beside values, pages and unreliable periods.
SCOPE = ["p_start", "p_end", "basis", "segment", "geography", "accounting", "modality", "kind", "currency"]
#: Claims of a bin, about; pairs that are looked at at once; ratio of the steps that bins are made of.
BIN, AT_ONCE, STEP = 50_000, 1_000_000, 1.01
#: Margins within which doubles leave a comparison to decimals, and by which reaches are widened.
SHARE, LEAST, WIDER = 1e-9, 1e-8, 1.01
_ROWS = f"p bigint, q bigint, n bigint, a_magnitude {CANONICAL}, b_magnitude {CANONICAL}, a_tolerance {CANONICAL}, b_tolerance {CANONICAL}"


def is_plain(c=F.col) -> Column:
    """A single number of money or quantity, whose distances doubles can judge."""
    ranged = c("range_low").isNotNull() & c("range_high").isNotNull()
    return F.coalesce(c("kind").isin("money", "quantity") & (F.abs(c("magnitude").cast("double")) < 1e24) & ~ranged, F.lit(False))


def _step(x: Column) -> Column:
    """The step of a value: whole numbers in the order of values, the same for values closer than STEP."""
    steps = F.floor(F.greatest(F.log(F.greatest(F.abs(x), F.lit(1e-300)) * 1e10), F.lit(0.0)) / np.log(STEP)) + 1
    return F.when(x == 0, F.lit(0)).when(x > 0, steps).otherwise(-steps).cast("int")


def near_pairs(members: DataFrame, keys: list[str], tile: int = TILE) -> DataFrame:
    """All pairs of members with equal keys whose magnitudes lie within STEP of each other (and some others): those of
    one step of values and of two that follow each other."""
    step = _step(F.col("magnitude").cast("double"))
    places = F.array(F.struct(step.alias("step"), F.lit(False).alias("above")), F.struct((step - 1).alias("step"), F.lit(True).alias("above")))
    placed = members.where("magnitude is not null").withColumn("_at", F.explode(places)).withColumns({"_step": F.col("_at.step"), "_above": F.col("_at.above")}).drop("_at")
    pairs = whole_pairs(placed, [*keys, "_step"], tile).where("not (a__above and b__above)")
    return pairs.drop(*(f"{s}__{c}" for s in "ab" for c in ("step", "above")))


def _spans(first: np.ndarray, until: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) for all j of each span first[i] <= j < until[i], some AT_ONCE at a time."""
    sizes = np.maximum(until - first, 0)
    i, before = 0, np.concatenate([[0], np.cumsum(sizes)])
    while i < len(sizes):
        k = max(int(np.searchsorted(before, before[i] + AT_ONCE, "right")) - 1, i + 1)
        if k == i + 1 and sizes[i] > AT_ONCE:
            for at in range(first[i], until[i], AT_ONCE):
                j = np.arange(at, min(at + AT_ONCE, until[i]))
                yield np.full(len(j), i), j
        else:
            rows = np.repeat(np.arange(i, k), sizes[i:k])
            yield rows, np.arange(len(rows)) - np.repeat(before[i:k] - before[i], sizes[i:k]) + np.repeat(first[i:k], sizes[i:k])
        i = k


class _Bin:
    """Claims of a bin: its own and those whose reach enters it. counts[p, q] are pairs that agree, doubtful those left over."""

    def __init__(self, table: pa.Table):
        column = lambda n: table[n].to_numpy()
        self.m, self.tolerance, self.reach, self.seq = (column(n) for n in ("m", "tol", "reach", "seq"))
        self.own, self.coarse = column("own"), column("coarse")
        self.names, self.p = np.unique(column("p"), return_inverse=True)
        self.size = np.abs(self.m)
        self.counts = np.zeros(len(self.names) ** 2, np.int64)
        self.doubtful: list[np.ndarray] = []

    def judge(self, i: np.ndarray, j: np.ndarray) -> None:
        """Count the pairs that are sure to agree and keep those that are near a limit."""
        first = np.where(self.seq[i] < self.seq[j], i, j)
        gap = np.abs(self.m[i] - self.m[j])
        bound = np.maximum(np.maximum(self.tolerance[i], self.tolerance[j]), self.size[first] / RELATIVE)
        sure = gap <= bound * (1 - SHARE) - LEAST
        self.add(i[sure], j[sure])
        near = ~sure & (gap <= bound * (1 + SHARE) + LEAST)
        if near.any():
            self.doubtful.append(np.stack([first[near], np.where(first == i, j, i)[near]]))

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        self.counts += np.bincount(self.p[i] * len(self.names) + self.p[j], minlength=len(self.counts))

    def fine(self, rows: np.ndarray) -> None:
        """Pairs of claims whose reach is a share of their value, all of one sign: each own claim with those after it in the order of
        size. Up to its own share they agree whichever was stated first; what follows, to the share of the larger, is judged."""
        rows = rows[np.lexsort((self.seq[rows], self.size[rows]))]
        size, at = self.size[rows], np.flatnonzero(self.own[rows])
        mine = size[at]
        sure = np.where(mine == 0, 0.0, mine * ((1 - SHARE) / RELATIVE) - LEAST)
        until = np.maximum(np.searchsorted(size, mine + sure, "right"), at + 1)
        until = np.where(sure < 0, at + 1, until)
        last = np.maximum(np.searchsorted(size, mine / (1 - 1 / RELATIVE) * (1 + SHARE) + 2 * LEAST, "right"), until)
        p, many = self.p[rows], len(self.names)
        if (until - at - 1).sum() <= len(rows) * many:
            for i, j in _spans(at + 1, until):
                self.add(rows[at[i]], rows[j])
        else:
            for q in np.unique(p):
                before = np.concatenate([[0], np.cumsum(p == q)])
                met = np.bincount(p[at], weights=before[until] - before[at + 1], minlength=many)
                self.counts[q::many] += met.astype(np.int64)
        for i, j in _spans(until, last):
            self.judge(rows[at[i]], rows[j])

    def rough(self) -> None:
        """Pairs with a claim whose tolerance is wider than its share: the one of less reach is in its own bin."""
        ahead = lambda i, j: (self.reach[i] < self.reach[j]) | ((self.reach[i] == self.reach[j]) & (self.seq[i] < self.seq[j]))
        wide, mine = np.flatnonzero(self.coarse), np.flatnonzero(self.own)
        mine = mine[np.argsort(self.m[mine], kind="stable")]
        low, high = self.m[wide] - self.reach[wide], self.m[wide] + self.reach[wide]
        for j, i in _spans(np.searchsorted(self.m[mine], low, "left"), np.searchsorted(self.m[mine], high, "right")):
            i, j = mine[i], wide[j]
            kept = ahead(i, j)
            self.judge(i[kept], j[kept])
        narrow, wide = np.flatnonzero(~self.coarse), wide[self.own[wide]]
        narrow = narrow[np.argsort(self.m[narrow], kind="stable")]
        # whoever reaches x lies between x less and x more this share of it
        far = self.size[wide] * (WIDER / RELATIVE / (1 - WIDER / RELATIVE) * (1 + SHARE)) + LEAST
        low, high = self.m[wide] - far, self.m[wide] + far
        for i, j in _spans(np.searchsorted(self.m[narrow], low, "left"), np.searchsorted(self.m[narrow], high, "right")):
            i, j = wide[i], narrow[j]
            kept = ahead(i, j)
            self.judge(i[kept], j[kept])


def _agreeing_of(table: pa.Table) -> pa.Table:
    b = _Bin(table)
    for sign in (b.m < 0, b.m >= 0):
        b.fine(np.flatnonzero(sign & ~b.coarse))
    if b.coarse.any():
        b.rough()
    many, at = len(b.names), np.flatnonzero(b.counts)
    left = np.concatenate(b.doubtful, axis=1) if b.doubtful else np.zeros((2, 0), np.int64)
    p, q = (np.concatenate(x) for x in zip((b.names[at // many], b.names[at % many]), (b.names[b.p[left[0]]], b.names[b.p[left[1]]])))
    n = pa.concat_arrays([pa.array(b.counts[at]), pa.nulls(left.shape[1], pa.int64())])
    decimal = lambda c, i: pa.concat_arrays([pa.nulls(len(at), pa.decimal128(38, 10)), pc.take(table[c].combine_chunks(), pa.array(left[i])).cast(pa.decimal128(38, 10))])
    sides = [decimal(c, i) for c in ("magnitude", "tolerance") for i in (0, 1)]
    return pa.table([pa.array(p.astype(np.int64)), pa.array(q.astype(np.int64)), n, *sides], names=["p", "q", "n", "a_magnitude", "b_magnitude", "a_tolerance", "b_tolerance"])


def _agreeing(values: DataFrame, keys: list[str], size: int) -> DataFrame:
    """(p, q, t, a): pairs of a group whose numbers agree, by profile; t is 0."""
    step, m, reach = F.col("step"), F.col("m"), F.col("reach")
    steps = values.groupBy(*keys, "step").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*keys).orderBy("step")
    placed = steps.withColumn("bin", F.floor((F.sum("n").over(order) - F.col("n")) / size).cast("int"))
    bins = placed.groupBy(*keys, "bin").agg(F.min("step").alias("low"), F.max("step").alias("high"))
    bins = bins.groupBy(*keys).agg(F.collect_list(F.struct("bin", "low", "high")).alias("bins"))
    # most groups are one bin, which all of their claims are in
    inside = lambda b: (b["high"] >= _step(m - reach)) & (b["low"] <= _step(m + reach))
    entered = F.when(F.size("bins") == 1, F.col("bins")).otherwise(F.filter("bins", inside))
    rows = values.join(bins, keys).withColumn("b", F.explode(entered))
    rows = rows.select(*keys, F.col("b.bin").alias("bin"), step.between(F.col("b.low"), F.col("b.high")).alias("own"), "p", "seq", "m", "tol", "reach", "coarse", "magnitude", "tolerance")
    found = rows.groupBy(*keys, "bin").applyInArrow(_agreeing_of, _ROWS)
    none = F.lit(None)
    number = {f"{s}_{c}": none.cast(t) for s in "ab" for c, t in (("date_value", "date"), ("text_value", "string"), ("bool_value", "boolean"), ("range_low", CANONICAL), ("range_high", CANONICAL), ("currency", "string"), ("raw", "string"))}
    judged = found.withColumns(number | {f"{s}_kind": F.lit("quantity") for s in "ab"})
    agreed = F.coalesce("n", values_agree(*pair_sides()).cast("bigint"))
    return judged.select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), F.lit(0).cast("bigint").alias("t"), agreed.alias("a"))


def _met(values: DataFrame, keys: list[str]) -> DataFrame:
    """(p, q, t, a): all pairs of a group, by profile; a is 0."""
    held = values.groupBy(*keys, "p").agg(F.count("*").alias("n"))
    other = held.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("p").alias("q"), F.col("n").alias("m"))
    both = held.join(other, reduce(lambda x, y: x & y, (F.col(k) == F.col(f"_{k}") for k in keys)) & (F.col("p") <= F.col("q")))
    pairs = F.when(F.col("p") < F.col("q"), F.col("n") * F.col("m")).otherwise(F.expr("n * (n - 1) div 2"))
    return both.select("p", "q", pairs.alias("t"), F.lit(0).cast("bigint").alias("a"))


def _judged(pairs: DataFrame, scopes: DataFrame) -> DataFrame:
    """(relation, n) of pairs (p, q, t, a, one_page): of t pairs a agree."""
    for side, name in (("a", "p"), ("b", "q")):
        own = scopes.select(F.col("scope").alias(f"{side}_scope"), *(F.col(c).alias(f"{side}_{c}") for c in SCOPE))
        pairs = pairs.withColumns({f"{side}_scope": F.floor(F.col(name) / 2), f"{side}_unreliable": F.col(name) % 2 == 1}).join(own, f"{side}_scope")
        same = {"subject_id": F.lit(""), "predicate_id": F.lit(""), "document_id": F.when(F.col("one_page"), ""), "page": F.lit(0), "confidence": F.lit(1.0)}
        pairs = pairs.withColumns({f"{side}_{k}": v for k, v in same.items()})
    agreed = F.when(currencies_clash(*pair_sides()), F.lit(0)).otherwise(F.col("a"))
    ways = F.array(F.struct(F.lit(True).alias("agree"), agreed.alias("n")), F.struct(F.lit(False).alias("agree"), (F.col("t") - agreed).alias("n")))
    split = pairs.withColumn("way", F.explode(ways)).withColumns({"agree": F.col("way.agree"), "n": F.col("way.n")})
    return with_verdict(split, agree=F.col("agree")).select("relation", "n")


def relation_totals(narrow: DataFrame, size: int = BIN, tile: int = TILE) -> DataFrame:
    """(relation, n) of all pairs of whole blocks, as compare_pairs(exact_pairs(narrow, None)) would have them; relations
    without pairs may be missing or 0."""
    ship(narrow.sparkSession)
    known = narrow.where("subject_id is not null and predicate_id is not null")
    numbers = known.where(is_plain())
    scopes = stored(numbers.select(*SCOPE).distinct().withColumn("scope", F.monotonically_increasing_id()), "scopes")
    own = scopes.select("scope", *(F.col(c).alias(f"_{c}") for c in SCOPE))
    named = numbers.join(own, reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in SCOPE)))
    m = F.col("magnitude").cast("double")
    tolerance = F.coalesce(F.col("tolerance").cast("double"), F.lit(0.0))
    sized = named.select(*BLOCK, *PLACE, "seq", (F.col("scope") * 2 + F.col("unreliable").cast("int")).alias("p"), "magnitude", "tolerance", m.alias("m"), tolerance.alias("tol"), (F.col("p_start").isNotNull() & ~F.col("unreliable")).alias("clean"))
    sized = sized.withColumns({"reach": F.greatest("tol", F.abs("m") / RELATIVE) * WIDER, "coarse": F.col("tol") * RELATIVE > F.abs("m"), "step": _step(F.col("m"))})
    values = stored(sized, "values")
    spread = _met(values, BLOCK).unionByName(_agreeing(values, BLOCK, size))
    # a page tells apart only pairs that would contradict each other: what was taken for that is taken back
    paged = values.where("clean and document_id is not null and page is not null")
    shared = _met(paged, BLOCK + PLACE).unionByName(_agreeing(paged, BLOCK + PLACE, size))
    signs = F.array(F.struct(F.lit(-1).alias("sign"), F.lit(False).alias("one_page")), F.struct(F.lit(1).alias("sign"), F.lit(True).alias("one_page")))
    moved = shared.select("p", "q", "t", "a", F.explode(signs).alias("s")).select("p", "q", (F.col("t") * F.col("s.sign")).alias("t"), (F.col("a") * F.col("s.sign")).alias("a"), "s.one_page")
    pairs = spread.withColumn("one_page", F.lit(False)).unionByName(moved).groupBy("p", "q", "one_page").agg(F.sum("t").alias("t"), F.sum("a").alias("a"))
    total = _judged(stored(pairs, "tally"), scopes)
    odd = known.where(~is_plain())
    if not odd.select(*BLOCK).distinct().isEmpty():
        total = total.unionByName(_odd_pairs(known, odd, tile))
    return total.groupBy("relation").agg(F.sum("n").alias("n"))


def _odd_pairs(known: DataFrame, odd: DataFrame, tile: int) -> DataFrame:
    """(relation, n) of the pairs with a claim that is no plain number, in the blocks that have such claims."""
    there = known.join(odd.select(*BLOCK).distinct(), BLOCK, "left_semi").select(*known.columns)
    pairs = whole_pairs(there.withColumn("plain", is_plain()), BLOCK, tile).where("not (a_plain and b_plain)")
    return with_verdict(pairs).groupBy("relation").agg(F.count("*").alias("n"))
