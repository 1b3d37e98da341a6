"""Canonical nodes for subjects and predicates.

Resolution depends on order: a label is held against the nodes that exist when it is met. Only a key that was not seen
before can add a node, so it is enough to resolve distinct keys in the order of their first occurrence: that reduction is a
native aggregation over all claims. What is left, one row per distinct key, goes through the leader pass, kind by kind.
Vectors are compared with the founding label's only.

A key founds a node unless a node before it is similar enough to take it: the nodes are the greedy independent set of the
keys, in their order, under similarity. So the leader pass is not walked through. The first ``batch`` keys go through one task.
Then come stretches four times as long as all before them. The keys of a stretch look up their nearest among the nodes so far,
which takes nearly all keys of crowded neighbourhoods, so that the links among the others are few. These are settled in
parallel rounds: a key is decided once no key before it that it is linked with is open. Rounds grow with the logarithm of the
keys; decisions are those of one pass for any ``batch``. The lookups are joins by threshold (``similar``); nothing but the
counts of the embedder's dimensions goes to the driver.

Nodes can come from earlier batches of claims: ``known`` has them exposed for lookup (streaming.extend keeps that index).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import first_of, strip
from ..functions.embeddings import hashed_trigrams
from ..functions.labels import is_referring, normalise_label
from ..session import ship, stored
from . import similar

#: Similarity from which a label merges, and below which it founds a node without doubt.
MERGE, CREATE = 0.92, 0.72
DECISIONS = "kind string, key string, label string, first bigint, node_id string, node_label string, action string, similarity double, nearest_label string"


def label_keys(claims: DataFrame) -> DataFrame:
    """claims with subject_key, predicate_key and, where they cannot be resolved, failure."""
    s, p = F.col("subject_raw"), F.col("predicate_raw")
    bare = F.when(is_referring(normalise_label(s)), F.lit("")).otherwise(normalise_label(s, strip_suffixes=True))
    keyed = claims.withColumns({"subject_key": bare, "predicate_key": normalise_label(p)})
    failure = first_of(
        [
            (strip(F.coalesce(s, F.lit(""))) == "", F.lit("empty subject")),
            (is_referring(normalise_label(s)), F.lit("subject is a referring expression")),
            (F.col("subject_key") == "", F.lit("subject normalises to nothing")),
            (F.col("predicate_key") == "", F.lit("empty predicate")),
        ]
    )
    return keyed.withColumn("failure", failure)


def distinct_labels(keyed: DataFrame) -> DataFrame:
    """(kind, key, label, first, uses): each key with the label of its first occurrence."""
    sound = keyed.where("failure is null")

    def of(kind: str, what: str) -> DataFrame:
        found = sound.groupBy(F.col(f"{what}_key").alias("key")).agg(
            F.min_by(strip(F.col(f"{what}_raw")), "seq").alias("label"), F.min("seq").alias("first"), F.count("*").alias("uses")
        )
        return found.withColumn("kind", F.lit(kind))

    return of("entity", "subject").unionByName(of("predicate", "predicate")).select("kind", "key", "label", "first", "uses")


def leader_pass(
    labels: pd.DataFrame,
    embed: Callable[[str], np.ndarray],
    merge: float = MERGE,
    create: float = CREATE,
    adjudicate: Callable[[str, str], bool] | None = None,
    floor: float = 0.0,
) -> pd.DataFrame:
    """Decisions for the keys of one kind, in order of first occurrence. Ties go to the earliest node.

    A similarity below ``floor`` is given as 0, of no label.
    Columns known_key, known_label and known_score, if there are any, name the nearest of the nodes that exist already.
    Similarities are taken to twelve places, so that they do not depend on how rows are grouped.
    """
    labels = labels.sort_values(["first", "key"], kind="stable")
    n = len(labels)
    known = [labels[f"known_{c}"] if f"known_{c}" in labels else [None] * n for c in ("key", "label", "score")]
    vectors, founders, out = None, [], []
    for key, label, first, *earlier in zip(labels["key"], labels["label"], labels["first"], *known):
        v = np.asarray(embed(label), np.float64)
        vectors = np.zeros((n, len(v))) if vectors is None else vectors
        nearest, score = (None, 0.0) if pd.isna(earlier[2]) else (tuple(earlier[:2]), earlier[2])
        if founders:
            similar = np.round(vectors[: len(founders)] @ v, 12)
            best = int(np.argmax(similar))
            if similar[best] > score:
                nearest, score = founders[best], float(similar[best])
        if score < floor:
            nearest, score = None, 0.0
        node, action = None, "created"
        if nearest and score >= merge:
            node, action = nearest, "merged"
        elif nearest and score >= create:
            action = "ambiguous_defaulted_to_new"
            if adjudicate is not None:
                same = adjudicate(label, nearest[1])
                node, action = (nearest, "llm_merged") if same else (None, "llm_created")
        founds = node is None
        if founds:
            node = (key, label)
            vectors[len(founders)] = v
            founders.append(node)
        out.append((key, label, first, node[0], node[1], action, score, nearest[1] if nearest else None))
    return pd.DataFrame(out, columns=["key", "label", "first", "node_key", "node_label", "action", "similarity", "nearest_label"])


def _verdicts(rows: DataFrame, merge: float, create: float, adjudicate) -> DataFrame:
    """rows(label, known_label, known_score, ready, taken, ...) with ``taken`` where an adjudicator says so of those that are ready."""
    if adjudicate is None:
        return rows

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            open_ = p["ready"] & ~p["taken"] & (p["known_score"] >= create)
            p["taken"] = p["taken"] | [bool(o and adjudicate(a, b)) for o, a, b in zip(open_, p["label"], p["known_label"])]
            yield p

    return rows.mapInPandas(ask, rows.schema)


def settled(rows: DataFrame, links: DataFrame, merge: float, create: float, adjudicate=None) -> DataFrame:
    """(kind, key) of the rows(kind, key, label, first, known_label, known_score, known_batch, known_first) that found a node;
    links(kind, a, b, score): a comes before b, and all links count that could take b."""
    state = rows.select("kind", "key", "label", "first", "known_label", "known_score", "known_batch", "known_first", F.lit("open").alias("state"))
    state = stored(state.withColumn("state", F.when(F.col("known_score") >= merge, "taken").otherwise(F.col("state"))), "settling")
    while state.where("state = 'open'").limit(1).count():
        earlier = state.select("kind", F.col("key").alias("a"), F.col("label").alias("a_label"), F.col("first").alias("a_first"), F.col("state").alias("a_state"))
        found = F.col("a_state") == "founds"
        # the nearest node among the linked: of equals the first
        near = F.max_by(F.when(found, F.struct("a_label", "score", "a_first")), F.when(found, F.struct("score", -F.col("a_first"))))
        met = links.join(earlier, ["kind", "a"]).groupBy("kind", F.col("b").alias("key")).agg(F.bool_or(F.col("a_state") == "open").alias("waits"), near.alias("near"))
        at = state.join(met, ["kind", "key"], "left")
        nearer = F.coalesce(F.col("near.score") > F.col("known_score"), F.lit(False))
        at = at.select(
            "kind", "key", "label", "first", F.col("state").alias("before"),
            F.when(nearer, F.col("near.a_label")).otherwise(F.col("known_label")).alias("known_label"), F.when(nearer, F.col("near.score")).otherwise(F.col("known_score")).alias("known_score"),
            "known_batch", "known_first", (~F.coalesce("waits", F.lit(False))).alias("ready"),
        )
        at = _verdicts(at.withColumn("taken", F.col("known_score") >= merge), merge, create, adjudicate)
        after = F.when(F.col("before") != "open", F.col("before")).when(F.col("taken"), "taken").when(F.col("ready"), "founds").otherwise("open")
        state = stored(at.withColumn("state", after).select(*state.columns), "settling")
    return state.where("state = 'founds'").select("kind", "key")


def _bounds(todo: DataFrame, batch: int) -> list[dict[str, int]]:
    """For each stretch the last ``first`` of each kind: the first ``batch`` keys of a kind, then four times as many as before."""
    sizes = {r["kind"]: r["count"] for r in todo.groupBy("kind").count().collect()}
    stretches, n = [], batch
    while n < max(sizes.values(), default=0):
        stretches.append(n)
        n *= 4
    ends: dict[str, list] = {}
    for kind, size in sizes.items():
        shares = [min(1.0, x / size) for x in stretches]
        ends[kind] = todo.where(F.col("kind") == kind).agg(F.percentile_approx("first", shares, 100_000)).first()[0] if shares else []
    return [{kind: ends[kind][i] for kind in sizes} for i in range(len(stretches))]


def resolve(
    labels: DataFrame,
    embed: Callable[[str], np.ndarray] = hashed_trigrams,
    merge: float = MERGE,
    create: float = CREATE,
    adjudicate: Callable[[str, str], bool] | None = None,
    batch: int = 4096,
    floor: float | None = None,
    known: DataFrame | None = None,
    order: similar.Order | None = None,
    number: int = 0,
) -> DataFrame:
    """DECISIONS for labels(kind, key, label, first). Node ids are hashes of the founding key, the same in every run.

    floor: similarities from here on are looked up (``create``, unless a lower one is asked for). Below it a key founds a node
    whatever else exists, and its nearest is not named.
    known, order: nodes that exist already (EXPOSED for the floor in that order); number: that of this batch of labels.
    """
    floor = min(create, merge) if floor is None else min(floor, create, merge)
    ship(labels.sparkSession)
    todo = stored(similar.features(labels, embed, number), "features")
    order = similar.order_of(todo) if order is None else order
    ends = _bounds(todo, batch)
    shown = "kind string, key string, label string, first bigint, node_key string, node_label string, action string, similarity double, nearest_label string"
    names = [c.split()[0] for c in shown.split(", ")]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return leader_pass(group, embed, merge, create, adjudicate, floor).assign(kind=group["kind"].iloc[0])[names]

    first = F.col("first")
    decided: list[DataFrame] = []
    nodes: list[DataFrame] = []  # EXPOSED, of each stretch
    for k in range(len(ends) + 1):
        within = F.lit(not ends)
        for kind in ends[0] if ends else []:
            over = first > ends[k - 1][kind] if k else F.lit(True)
            within = within | ((F.col("kind") == kind) & over & (first <= ends[k][kind] if k < len(ends) else F.lit(True)))
        own = todo.where(within)
        before = ([] if known is None else [known]) + nodes
        asked = own
        if before:
            found = similar.nearest(reduce(DataFrame.unionByName, before), own, order, floor, left_exposed=True)
            asked = stored(own.join(found, ["kind", "key"], "left"), "asked")
        if not k:
            done = asked.drop("at", "weight").groupBy("kind").applyInPandas(run, shown)
        else:
            done = _stretch(asked, order, merge, create, adjudicate, floor)
        done = stored(done.select(*names), "decisions")
        decided.append(done)
        if k < len(ends):
            founders = own.join(done.where("key = node_key").select("kind", "key"), ["kind", "key"], "left_semi")
            nodes.append(stored(similar.exposed(founders, order, floor), "nodes"))
    node = F.sha1(F.concat_ws("|", "kind", "node_key"))
    return reduce(DataFrame.unionByName, decided).withColumn("node_id", node).select(*(c.split()[0] for c in DECISIONS.split(", ")))


def _stretch(asked: DataFrame, order: similar.Order, merge: float, create: float, adjudicate, floor: float) -> DataFrame:
    """Decisions on keys whose nearest earlier node (known_...) has been looked up."""
    score = F.coalesce("known_score", F.lit(0.0))
    rows = asked.withColumn("known_score", score)
    free = rows.where(score < merge).select(*(c.split()[0] for c in similar.FEATURES.split(", ")))
    links = stored(similar.links(free, order, merge if adjudicate is None else create), "links")
    founders = stored(settled(rows, links, merge, create, adjudicate), "founders")
    made = rows.join(founders, ["kind", "key"], "left_semi").select(*free.columns)
    near = similar.nearest(made, rows.select(*free.columns), order, floor)
    near = near.select("kind", "key", *(F.col(f"known_{c}").alias(f"near_{c}") for c in ("key", "label", "score")))
    all_ = rows.join(near, ["kind", "key"], "left").join(founders.withColumn("founds", F.lit(True)), ["kind", "key"], "left")
    nearer = F.coalesce(F.col("near_score") > F.col("known_score"), F.lit(False))
    best = {c: F.when(nearer, F.col(f"near_{c}")).otherwise(F.col(f"known_{c}")) for c in ("key", "label", "score")}
    all_ = all_.withColumns({"n_key": best["key"], "n_label": best["label"], "n_score": best["score"]})
    founds, s = F.coalesce("founds", F.lit(False)), F.col("n_score")
    new = F.when(s < create, "created").otherwise("ambiguous_defaulted_to_new" if adjudicate is None else "llm_created")
    return all_.select(
        "kind", "key", "label", "first", F.when(founds, F.col("key")).otherwise(F.col("n_key")).alias("node_key"), F.when(founds, F.col("label")).otherwise(F.col("n_label")).alias("node_label"),
        F.when(founds, new).when(s >= merge, "merged").otherwise("llm_merged").alias("action"), s.alias("similarity"), F.col("n_label").alias("nearest_label"),
    )


def canonicalise(claims: DataFrame, decisions: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(claims with subject_id and predicate_id, claims set aside with their failure, decisions)."""
    keyed = label_keys(claims.drop("subject_id", "predicate_id"))
    if decisions is None:
        decisions = resolve(distinct_labels(keyed), **options)
    ids = lambda kind, what: decisions.where(F.col("kind") == kind).select(F.col("key").alias(f"{what}_key"), F.col("node_id").alias(f"{what}_id"))
    sound = keyed.where("failure is null").drop("failure").join(ids("entity", "subject"), "subject_key").join(ids("predicate", "predicate"), "predicate_key")
    columns = [c for c in claims.columns if c not in ("subject_id", "predicate_id")]
    return sound.select(*columns, "subject_id", "predicate_id"), keyed.where("failure is not null").select(*columns, "failure"), decisions


def nodes(decisions: DataFrame) -> DataFrame:
    """(kind, node_id, label, aliases, n_labels): the ontology."""
    return decisions.groupBy("kind", "node_id").agg(F.min_by("node_label", "first").alias("label"), F.array_sort(F.collect_set("label")).alias("aliases"), F.count("*").alias("n_labels"))


def alias_decisions(keyed: DataFrame, decisions: DataFrame) -> DataFrame:
    """Counts of actions over all mentions: later mentions of a founding key are exact, of a merged key aliases."""
    d = decisions.select("kind", "key", "action", "first", (F.sha1(F.concat_ws("|", "kind", "key")) == F.col("node_id")).alias("founding"))
    mentions = keyed.where("failure is null").select(F.explode(F.array(
        F.struct(F.lit("entity").alias("kind"), F.col("subject_key").alias("key"), F.col("seq")),
        F.struct(F.lit("predicate").alias("kind"), F.col("predicate_key").alias("key"), F.col("seq")),
    )).alias("m")).select("m.*")
    met = mentions.join(d, ["kind", "key"])
    action = F.when(F.col("seq") == F.col("first"), F.col("action")).when(F.col("founding"), F.lit("exact")).otherwise(F.lit("alias"))
    return met.groupBy("kind", action.alias("action")).agg(F.count("*").alias("n"))


def describe(decisions: DataFrame) -> DataFrame:
    """decisions with one sentence each."""
    lit = F.lit
    s = F.format_number("similarity", 3)
    q = lambda c: F.concat(lit("'"), F.col(c), lit("'"))
    text = first_of(
        [
            (F.col("action") == "merged", F.concat(q("label"), lit(" merged into "), q("node_label"), lit(" (similarity "), s, lit(")"))),
            (F.col("action") == "llm_merged", F.concat(q("label"), lit(" merged into "), q("node_label"), lit(" by the adjudicator"))),
            (F.col("action") == "llm_created", F.concat(q("label"), lit(" kept apart from "), q("nearest_label"), lit(" by the adjudicator"))),
            (F.col("action") == "ambiguous_defaulted_to_new", F.concat(q("label"), lit(" is close to "), q("nearest_label"), lit(" (similarity "), s, lit("): new, for review"))),
        ],
        F.concat(q("label"), lit(" is new")),
    )
    return decisions.withColumn("description", text)


def stats(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("kind").agg(
        F.countDistinct("node_id").alias("nodes"), F.count("*").alias("labels"), F.count_if(F.col("action") == "ambiguous_defaulted_to_new").alias("pending_review")
    )


def pending_review(decisions: DataFrame) -> DataFrame:
    return decisions.where("action = 'ambiguous_defaulted_to_new'")
