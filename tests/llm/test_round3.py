"""Long passages, fill-in-middle and the Merkle manifest against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statemesh.llm import debruijn, fill_middle, merkle
from statemesh.llm.queries import QUERIES

DOCS = "doc_id bigint, text string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- passages


def plain_passages(rows, k):
    words = [WORD.findall(t or "") for _, t in rows]
    met = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for (doc_id, _), w in zip(rows, words):
        gone = {j for i in range(len(w) - k + 1) if met[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
        out.append((doc_id, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=repr)


def passage_rows(seed):
    r = random.Random(seed)
    word = lambda n=40: f"w{r.randint(0, n)}"
    shared = [[word(400) for _ in range(r.randint(30, 90))] for _ in range(6)]
    rows = []
    for i in range(120):
        w = [word(3000) for _ in range(r.randint(0, 80))]
        for _ in range(r.randint(0, 3)):
            p = list(r.choice(shared))
            if r.random() < 0.4:
                p[r.randrange(len(p))] = word(9)
            a = r.randint(0, len(w))
            w[a:a] = p[r.randint(0, 10) : len(p) - r.randint(0, 10)]
        rows.append((i, r.choice([" ", "\n", " \t "]).join(w)))
    rows += [(200 + i, " ".join(shared[0])) for i in range(60)]  # a hot passage and copies
    rows += [(300, None), (301, ""), (302, " \n "), (303, "a " * 300), (304, "a b " * 200), (305, " é ß " * 50), (305, " é ß " * 50)]
    return rows + [(None, rows[3][1]), (None, None), (5, rows[5][1])]


@pytest.mark.parametrize(("seed", "k", "chunk", "bucket", "fan"), [(1, 35, 4_000_000, 3_000_000, 256), (2, 35, 2_000, 3_000, 2), (3, 13, 1_000, 500, 3), (4, 5, 700, 900, 256)])
def test_passages(spark, seed, k, chunk, bucket, fan):
    rows = passage_rows(seed)
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    found = debruijn.remove_passages(docs, k, chunk, True, bucket, fan)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_passages(rows, k)


def test_passages_of_odd_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert debruijn.remove_passages(empty).collect() == []
    rows = [("x", "a " * 80, 1, 2), ("y", None, 3, 4)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, n_words int, chunk int")
    assert sorted(map(tuple, debruijn.remove_passages(docs).collect())) == [("x", 80, 80, ""), ("y", 0, 0, "")]
    with pytest.raises(ValueError):
        debruijn.remove_passages(docs, 1)


def test_long_passages(spark):
    r = random.Random(5)
    long = " ".join(f"v{r.randint(0, 10**9)}" for _ in range(60_000))
    rows = [(1, long), (2, "start " + long + " end"), (3, "q" * 500_000)]
    found = {r["doc_id"]: r for r in debruijn.remove_passages(spark.createDataFrame(rows, DOCS), with_text=False).collect()}
    assert found[1]["n_removed"] == found[2]["n_removed"] == 60_000 and found[3]["n_removed"] == 0
    assert found[2]["kept_sha256"] == sha("start end") and found[1]["kept_sha256"] == sha("")


def test_sources_that_only_share_hashes_are_told_apart(spark):
    """Where the sources of a path have other words, its windows are judged one by one."""
    rows = [(1, "aa bb cc dd ee ff gg"), (2, "aa bb cc dd ee ff hh"), (3, "zz bb cc dd ee ff gg"), (4, "xx yy xx yy zz ww vv"), (5, "k l m n o")]
    k = 5
    docs = spark.createDataFrame(rows, DOCS).coalesce(1)
    chunks = debruijn.stored_by_chunk(debruijn.chunked(docs, 1000), "t", 2)
    row = chunks.first().asDict()
    chunk = debruijn.Chunk(row, k)
    span = lambda at, n: (row["chunk"], 7, at, n, debruijn.digest(chunk.words(at, at + n + k - 1)))
    spans = spark.createDataFrame([span(int(f), 3) for f in chunk.first[:4]], debruijn.SPANS)
    kept = {(r["word"], r["windows"]) for r in debruijn.verified(chunks, spans, k).collect()}
    assert kept == {(0, 1), (1, 1), (2, 1), (7, 1), (8, 1), (15, 1), (16, 1)}
    assert debruijn.verified(chunks, spans.limit(0), k).count() == 0


def test_paths_are_compacted_to_their_heads(spark):
    """A long chain, a branch and a piece of its own."""
    n = 45
    chain = [(False, 10 * i, 10 * i + 1, 10 * i - 9 if i else 0, 10 * i + 10 if i < n - 1 else 0, 2) for i in range(n)]
    chain[n // 2] = (*chain[n // 2][:3], 0, *chain[n // 2][4:])  # several edges come before this one
    rows = [*chain, (False, 9000, 9001, 0, 0, 5)]
    pieces = spark.createDataFrame([(*r, None, None) for r in rows], debruijn.SEGMENTS)
    found = sorted(map(tuple, debruijn.compacted(pieces).collect()))
    assert found == [(0, 44, 22), (220, 46, 23), (9000, 5, 1)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=" \t\nabé ", max_size=30), min_size=1, max_size=6))
def test_words_in_bytes(texts):
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(t) for t in raw])
    starts, stops = debruijn.word_bounds(data, ends - [len(t) for t in raw])
    assert [data[a:b].tobytes() for a, b in zip(starts, stops)] == [w.encode() for t in texts for w in WORD.findall(t)]


# --- fill in the middle

TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def plain_middle(doc_id, text, seed=42, percent=50, spm_percent=80):
    x = text or ""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    t = TOKEN.findall(x)
    n = len(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(t[:a]), "".join(t[a:b]), "".join(t[b:])
    if not x or any(m in x for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
        return doc_id, n, "plain", None, None, x
    spm = h4 % 100 < spm_percent
    return doc_id, n, "spm" if spm else "psm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}" if spm else f"<P>{pre}<S>{suf}<M>{mid}"


def middle_rows():
    r = random.Random(8)
    pieces = ["a", "bc", "déf", "日本", " ", "\x1c", " ", "  ", "\n", "\t", "<", ">", "<P", "S>", "𝔘"]
    rows = [(i, "".join(r.choices(pieces, k=r.randint(0, 60)))) for i in range(700)]
    rows += [(1000 + i, " ".join(r.choices(pieces, k=40)) + r.choice(["<P>", "<S>", "<M>"])) for i in range(20)]
    return [*rows, (2000, None), (2001, ""), (2002, "  "), (None, "a b c d"), (3, rows[3][1]), (7000, "word " * 100_000), (7001, "x" * 300_000), (7002, " " * 70_000)]


@pytest.mark.parametrize(("percent", "spm"), [(50, 80), (100, 50), (100, 0), (0, 80)])
def test_fill_middle(spark, percent, spm):
    rows = middle_rows()
    docs = spark.createDataFrame([(*r, 5, "k") for r in rows], f"{DOCS}, n int, other string").repartition(3)
    made = fill_middle.fill_middle(docs, percent=percent, spm_percent=spm)
    assert made.columns == ["doc_id", "text", "other", "n", "form", "prefix_chars", "middle_chars", "output"]
    back = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert all(r["back"] == (r["text"] or "") and r["other"] == "k" for r in back)
    found = [(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in back]
    assert sorted(found, key=repr) == sorted((plain_middle(*r, percent=percent, spm_percent=spm) for r in rows), key=repr)
    assert fill_middle.fill_middle(docs.limit(0)).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.booleans(), max_size=2500))
def test_rank_and_select(bits):
    b = np.array(bits, bool)
    v = fill_middle.BitVector(b)
    at = np.arange(len(b) + 1)
    assert v.rank(at).tolist() == np.concatenate([[0], np.cumsum(b)]).tolist()
    ones = np.flatnonzero(b)
    assert v.ones == len(ones) and v.select(np.arange(len(ones))).tolist() == ones.tolist()


# --- the manifest


def H(*parts):
    return sha("".join(parts))


def plain_manifest(rows, fanout=2):
    """rows: (doc_id, source, lang, n_chars, text) -> {(doc_id, leaf): (subroot, root, proof, folded)} as a list."""
    code = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: H(*map(code, r))
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))

    def up(nodes):
        steps = [[] for _ in nodes]
        at, level = list(range(len(nodes))), list(nodes)
        while len(level) > 1:
            for i, a in enumerate(at):
                first = a - a % fanout
                run = level[first : first + fanout]
                steps[i].append(("".join(run[: a - first]), "".join(run[a - first + 1 :])))
            level = [H(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
            at = [a // fanout for a in at]
        return level[0], steps

    done = {}
    for g in names:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        done[g] = (own, *up([leaf(r) for r in own]))
    root, above = up([done[g][1] for g in names])
    out = []
    for g, over in zip(names, above):
        own, subroot, steps = done[g]
        for r, s in zip(own, steps):
            path = s + over
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            x = leaf((*r[:3], r[3] if r[3] is None or not hit else r[3] + 1, r[4]))
            for a, b in path:
                x = H(a, x, b)
            out.append((r[0], leaf(r), subroot, root, H(*(a + b for a, b in path)), x, x == root))
    return sorted(out, key=repr)


ROWS = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def manifest_rows(n, seed=1):
    r = random.Random(seed)
    rows = [(i, r.choice(["web", "é", None]), r.choice(["en"] * 6 + ["de", "é", None, ""]), r.choice([None, i * 3]), r.choice([None, "", f"t{i}é"])) for i in range(n)]
    rows += [(None, None, None, None, None), (None, "web", "xx", 1, "lone"), (n + 5, "w", "zz", 4, "pair"), (n + 6, "w", "zz", 4, "pair")]
    return rows + [rows[0], rows[0], (rows[1][0], "other", "en", 9, "same id"), (None, "w", "en", 7, "no id")]


@pytest.mark.parametrize(("n", "fanout"), [(200, 2), (77, 2), (150, 3), (60, 16)])
def test_manifest(spark, n, fanout):
    rows = manifest_rows(n)
    docs = spark.createDataFrame(rows, ROWS).withColumns({c: F.lit("clash") for c in ("g", "idx", "leaf", "root", "path")}).repartition(4)
    found = merkle.verified_rows(docs, fanout).collect()
    assert sorted((tuple(r) for r in found), key=repr) == plain_manifest(rows, fanout)


@pytest.mark.parametrize("rows", [[], [(7, "s", "en", 3, "one")], [(1, "s", "en", 3, "a"), (2, "s", "en", 3, "b")], [(1, "s", None, None, "a"), (2, "s", "en", 3, None)], [(5, "s", "en", 1, "same")] * 40])
def test_small_manifests(spark, rows):
    found = merkle.verified_rows(spark.createDataFrame(rows, ROWS)).collect()
    assert sorted((tuple(r) for r in found), key=repr) == (plain_manifest(rows) if rows else [])


def test_very_long_rows(spark):
    rows = [(1, "s", "en", 3, "x" * 2_000_000), (2, "s", "en", 3, "y" * 10)]
    assert sorted(map(tuple, merkle.verified_rows(spark.createDataFrame(rows, ROWS)).collect()), key=repr) == plain_manifest(rows)
    with pytest.raises(ValueError):
        merkle.verified_rows(spark.createDataFrame(rows, ROWS), 1)


def test_queries_return_the_columns_of_the_contract(spark):
    want = {
        "op11_passages": ["doc_id", "n_words", "n_removed", "kept_sha256"],
        "op12_fill_middle": ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
        "op13_merkle": ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
    }
    for name, columns in want.items():
        assert QUERIES[name](spark, "/root/testdata/sf0.001").columns == columns
