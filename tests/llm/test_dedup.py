"""Near duplicates, exact substrings and decontamination against plain versions."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from statemesh.llm import near_dup, suffix_dedup, wu_manber

DOCS = "doc_id bigint, text string"


def brute_components(rows, percent=85):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        for j, k in Counter(j for g in s for j in where[g] if j < i).items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), 1 << 60), d)
    return sorted((d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows))


def near_rows(seed=3, hot=120):
    r = random.Random(seed)
    rows = [(i, " ".join(str(r.randint(0, 99)) for _ in range(r.randint(0, 60)))) for i in range(150)]
    base = [str(r.randint(0, 9999)) for _ in range(200)]
    for k in range(hot):  # a hot group of near copies of one text
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(200)] = f"x{r.randint(0, 99999)}"
        rows.append((5000 + k, " ".join(w)))
    chain = list(base)
    for k in range(25):  # a chain: neighbours are linked, its ends are not
        chain[k * 3] = f"y{k}"
        rows.append((8000 + k, " ".join(chain)))
    line = "one line that all of these share with one another today"
    rows += [(9000 + k, f"{line} {k} {k * 7} {k * 13}") for k in range(60)]
    return rows + [(1, "a b"), (2, "A b"), (3, ""), (4, None), (10_000, rows[0][1]), (10_001, " ".join(base))]


@pytest.mark.parametrize("block_sets", [4096, 40, 5])
def test_near_duplicates_equal_all_pairs(spark, block_sets):
    rows = near_rows()
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    found = near_dup.near_duplicates(docs, block_sets=block_sets).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == brute_components(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_near_duplicates_with_nulls_repeats_and_nothing(spark):
    rows = [(None, None), (1, ""), (2, "a b"), (3, "A b"), (4, "a b c d e f"), (None, "a b"), (2, "q r s"), (2, "a b")]
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect())
    assert got == Counter({(None, 0, None): 1, (1, 0, 1): 1, (2, 1, 2): 3, (3, 1, 2): 1, (4, 2, 4): 1, (None, 1, 2): 1})
    assert near_dup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    extra = spark.createDataFrame([(1, "a", 7, "n")], DOCS + ", n_shingles int, node string")
    assert near_dup.near_duplicates(extra).first()["component_id"] == 1


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(1)
    s = np.unique(rng.integers(0, 1 << 62, 1000, dtype=np.uint64))
    t = np.unique(np.concatenate([s[100:], rng.integers(0, 1 << 62, 100, dtype=np.uint64)]))
    jaccard = len(np.intersect1d(s, t)) / len(np.union1d(s, t))
    assert abs((near_dup.signature(s) == near_dup.signature(t)).mean() - jaccard) < 0.08


def test_bands_fit_the_threshold():
    assert near_dup.banding(85) == (near_dup.BANDS, near_dup.ROWS)
    for percent in (100, 95, 85, 80, 70, 50):
        bands, rows = near_dup.banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= 1e-6


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a bigint, b bigint")
    got = {r["node"]: r["label"] for r in near_dup.components(links).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def brute_removed(rows, depth=100):
    first, out = set(), []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - depth + 1):
            w = b[i : i + depth]
            if w in first:
                gone[i : i + depth] = True
            first.add(w)
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        out.append((d, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def removed(spark, rows, **options):
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    return sorted((tuple(r) for r in suffix_dedup.remove_repeats(docs, with_text=False, **options).collect()), key=str)


@pytest.mark.parametrize("chunk_bytes", [6_000_000, 3_000])
def test_repeats_are_removed_exactly(spark, chunk_bytes):
    r = random.Random(9)
    text = lambda n: "".join(r.choices("abcdefgh é", k=n))
    passage, shared = text(260), text(130)
    rows = [(i, text(r.randint(0, 400)) + (shared if i % 3 == 0 else "") + text(30)) for i in range(60)]
    rows += [(100, passage + text(50) + passage), (101, text(20) + passage[7:]), (102, passage), (50_000, passage[:99]), (103, passage[:100])]
    rows += [(104, "a" * 3000), (105, "a" * 99), (106, "a" * 100), (107, None), (108, ""), (109, "xy" * 400), (110, rows[0][1])]
    assert removed(spark, rows, chunk_bytes=chunk_bytes) == brute_removed(rows)


@pytest.mark.parametrize("fan", [2, 4])
def test_repeats_do_not_depend_on_the_levels_of_the_exchange(spark, fan):
    r = random.Random(10)
    text = lambda n: "".join(r.choices("abcdefgh ", k=n))
    shared = [text(180) for _ in range(4)]
    rows = [(i, text(r.randint(0, 200)) + r.choice(shared)[: r.randint(90, 180)] + text(40)) for i in range(80)]
    assert removed(spark, rows, chunk_bytes=500, bucket_bytes=400, fan=fan) == brute_removed(rows)


def test_repeats_with_ids_that_are_texts(spark):
    text = "".join(random.Random(2).choices("abcdef", k=300))
    rows = [("b", text), ("a\u00e9", text + "z"), (None, text), ("a", "x" + text[50:]), ("", text[:120])]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id string, text string, chunk int").repartition(3)
    got = {x["doc_id"]: x["n_removed"] for x in suffix_dedup.remove_repeats(docs, with_text=False, chunk_bytes=200).collect()}
    numbered = sorted(rows, key=lambda x: (x[0] is None, (x[0] or "").encode()))
    want = {x[0]: w[2] for x, w in zip(numbered, brute_removed([(k, t) for k, (_, t) in enumerate(numbered)]))}
    assert got == want


def test_repeats_with_null_ids_repeated_rows_and_nothing(spark):
    text = "".join(random.Random(2).choices("abcdef", k=300))
    got = removed(spark, [(None, text), (4, text), (4, text)])
    assert sorted(g[2] for g in got if g[0] == 4) == [0, 300] and [g[2] for g in got if g[0] is None] == [300]
    assert removed(spark, [(1, "a")])[0][2] == 0
    docs = spark.createDataFrame([], DOCS)
    assert suffix_dedup.remove_repeats(docs).count() == 0
    kept = suffix_dedup.remove_repeats(spark.createDataFrame([(1, text), (2, text + "z")], DOCS)).orderBy("doc_id").collect()
    assert bytes(kept[1]["kept"]) == b"z"
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(docs, depth=20)


def test_equal_windows_are_compared_byte_by_byte():
    data = np.frombuffer(b"a" * 100 + b"b" * 100 + b"a" * 100, np.uint8)
    at = np.array([0, 100, 200])
    w, g = suffix_dedup.equal_windows(data, at, np.zeros(3, np.uint64), 100)
    assert sorted(w.tolist()) == [0, 2] and len(set(g.tolist())) == 1


WORD = st.sampled_from([b"a", b"b", b"c"])


@settings(max_examples=150, deadline=None)
@given(st.lists(WORD, max_size=40), st.lists(st.lists(WORD, min_size=1, max_size=5), max_size=6))
def test_wu_manber_finds_every_occurrence(text, patterns):
    search = wu_manber.WuManber(tuple(p) for p in patterns)
    got = sorted((at, search.patterns[k]) for at, k in search.search(text))
    distinct = {tuple(p) for p in patterns}
    assert got == sorted((i, p) for p in distinct for i in range(len(text) - len(p) + 1) if tuple(text[i : i + len(p)]) == p)


@pytest.mark.parametrize(("wider", "small"), [((0,), 0), ((1, 2), 1), ((0, 0, 0), 0)])
def test_wide_blocks_and_large_buckets_find_every_occurrence(monkeypatch, wider, small):
    monkeypatch.setattr(wu_manber, "WIDER", wider)
    monkeypatch.setattr(wu_manber, "SMALL", small)
    r = random.Random(4)
    for _ in range(300):
        text = [bytes([97 + r.randrange(3)]) for _ in range(r.randrange(60))]
        patterns = {tuple(bytes([97 + r.randrange(3)]) for _ in range(r.randint(k, 7))) for k in [r.randint(1, 6)] for _ in range(8)}
        search = wu_manber.WuManber(patterns)
        got = sorted((at, search.patterns[k]) for at, k in search.search(text))
        assert got == sorted((i, p) for p in patterns for i in range(len(text) - len(p) + 1) if tuple(text[i : i + len(p)]) == p)


def brute_hits(docs, items, window=10):
    out = []
    for d, t in docs:
        w = wu_manber.words_of((t or "").encode())
        hit, found = set(), set()
        for item, text in items:
            for p in wu_manber.windows_of(wu_manber.words_of((text or "").encode()), window):
                for i in range(len(w) - len(p) + 1):
                    if tuple(w[i : i + len(p)]) == p:
                        hit |= set(range(i, i + len(p)))
                        found.add(item)
        found.discard(None)
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("max_words", [2_000_000, 20])
def test_decontamination(spark, max_words):
    r = random.Random(4)
    items = [(i, " ".join(r.choices(["Ab", "cd", "e", "f!", "ü"], k=n))) for i, n in enumerate([30, 12, 10, 9, 3, 1, 25])]
    items += [(7, None), (8, "..."), (10, items[0][1]), (None, "alone nobody knows")]
    docs = [(i, " ".join(r.choices(["ab", "CD", "e,", "f", "ü"], k=r.randint(0, 60)))) for i in range(60)]
    docs += [(100, "x " + items[0][1].lower() + " y"), (101, None), (102, "!!"), (None, items[1][1]), (103, "ALONE nobody-knows"), (103, "ALONE nobody-knows")]
    found = wu_manber.decontaminate(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id bigint, text string"), max_words=max_words)
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted((tuple(r) for r in found.select(*names).collect()), key=str) == brute_hits(docs, items)


def test_decontamination_with_nothing(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "a", "own")], DOCS + ", n_hit string")
    row = wu_manber.decontaminate(docs, none).first()
    assert (row["n_hit"], row["contaminated"], row["items_sha256"]) == (0, False, hashlib.sha256(b"").hexdigest())
    assert wu_manber.decontaminate(docs.limit(0), none).count() == 0
