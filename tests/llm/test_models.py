"""Language-model scores, quality rules and token counts against plain versions."""

import collections
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from statemesh.llm import exchange, katz, quality_rules, token_counts

DOCS = "doc_id bigint, text string"


def brute_katz(rows, order, k=5):
    tokens = lambda t: [*(t or "").encode().lower().split(), b" end"]
    train = [tokens(t) for i, t in rows if zlib.crc32(b"" if i is None else str(i).encode()) % 10]
    counts = {m: collections.Counter() for m in range(1, order + 1)}
    for d in train:
        s = [b" start"] * (order - 1) + d
        for m in counts:
            counts[m].update(tuple(s[j + order - m : j + order]) for j in range(len(d)))
    d_of = {m: katz.good_turing(collections.Counter(counts[m].values()), k).factors for m in counts}
    dc = lambda m, c: d_of[m][min(c, k + 1)] * c
    kept = sum(dc(1, c) for c in counts[1].values())
    unknown = max(sum(counts[1].values()) - kept, 0.5)
    after = {m: collections.defaultdict(list) for m in counts}
    for m in counts:
        for g in counts[m]:
            after[m][g[:-1]].append(g[-1])

    def p(w, h):
        m = len(h) + 1
        if m == 1:
            return (dc(1, counts[1][(w,)]) if (w,) in counts[1] else unknown) / (kept + unknown)
        if h not in after[m]:
            return p(w, h[1:])
        seen = [counts[m][(*h, x)] for x in after[m][h]]
        total = sum(dc(m, c) for c in seen)
        left = max(sum(seen) - total, 0.5)
        if w in after[m][h]:
            return dc(m, counts[m][(*h, w)]) / (total + left)
        return left / (total + left) / (1 - sum(p(x, h[1:]) for x in after[m][h])) * p(w, h[1:])

    vocabulary = [g[0] for g in counts[1]] + [b" unknown"]
    for h in list(after[order])[:15]:
        assert sum(p(w, h) for w in vocabulary) == pytest.approx(1, abs=1e-9)
    out = []
    for i, t in rows:
        d = tokens(t)
        s = [b" start"] * (order - 1) + d
        known = sum((w,) in counts[1] for w in d)
        out.append((i, len(d), known, sum(math.log10(p(s[j + order - 1], tuple(s[j : j + order - 1]))) for j in range(len(d)))))
    return sorted(out, key=str)


def words(seed, n):
    r = random.Random(seed)
    return [(i, " ".join(r.choices([*"abcdeF", "gg", *(f"w{r.randint(0, 30)}" for _ in range(4))], k=r.randint(0, 12)))) for i in range(n)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_katz_equals_the_plain_model_and_sums_to_one(spark, order):
    rows = words(1, 90) + [(None, None), (5, "zzz a"), (777, ""), (6, "a\x0bb\x1fc"), (6, "a\x0bb\x1fc")]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["score"]) for r in katz.katz_scores(docs, order, max_tokens=150).collect()), key=str)
    want = brute_katz(rows, order)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-9)


@pytest.mark.parametrize("fan", [2, 5])
def test_katz_does_not_depend_on_the_levels_of_its_exchange(spark, fan):
    rows = words(4, 80)
    docs = spark.createDataFrame(rows, DOCS).repartition(8).sortWithinPartitions("doc_id")
    small = katz.katz_scores(docs, 2, max_tokens=20, bucket_keys=30, fan=fan)
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["score"]) for r in small.collect()), key=str)
    want = brute_katz(rows, 2)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-9)


def test_a_route_brings_every_answer_back(spark):
    r = np.random.default_rng(1)
    sent = {c: np.unique(r.integers(0, 1 << 63, 40, dtype=np.uint64) << np.uint64(1)) for c in range(30)}
    route = exchange.Route.of(30, 50, fan=3)
    assert len(route.meets) == 3
    one = lambda c, k: {"key": k, "chunk": np.full(len(k), c), "name": pa.array([str(x) for x in k])}
    rows = [x for c, k in sent.items() for x in route.letters(0, one(c, k))]
    assert len(rows) <= 30 * 3
    there = route.forward(spark.createDataFrame(rows, exchange.ROUTED)).collect()
    assert sorted({x["range"] for x in there}) == sorted({int(k) * 50 >> 64 for ks in sent.values() for k in ks})
    answers = []
    for x in there:
        body = exchange.unseal(x["body"])
        assert body["name"].to_pylist() == [str(k) for k in body["key"]]
        answers.append((x["lane"], x["range"], x["sender"], exchange.seal({"chunk": body["chunk"], "half": body["key"] >> np.uint64(1)})))
    back = route.backward(spark.createDataFrame(answers, exchange.REPLIED)).collect()
    for c, k in sent.items():
        got = exchange.replied([x.asDict() for x in back if x["sender"] == c])
        assert (got["half"] << np.uint64(1)).tolist() == k.tolist()


@pytest.mark.parametrize(("chunks", "buckets", "fan"), [(40, 30, 16), (700, 525, 256), (3000, 2400, 16)])
def test_no_meeting_of_a_route_is_much_larger_than_a_chunk(chunks, buckets, fan):
    route = exchange.Route.of(chunks, buckets, fan)
    assert all(a % b == 0 for a, b in zip(route.steps, route.steps[1:])) and route.steps[-1] == 1
    # a thousand keys a chunk, dealt evenly: how many meet at each level
    senders = np.arange(chunks)
    for level in range(len(route.meets)):
        together = np.bincount(route.meeting(senders, level)).max()
        assert together * 1000 * min(1.0, route.steps[level] / buckets) <= 4 * 1000
        assert -(-buckets // route.steps[0]) <= fan


def test_katz_base_and_folds(spark):
    rows = words(2, 40)
    got = {r["doc_id"]: r for r in katz.katz_scores(spark.createDataFrame(rows, DOCS)).collect()}
    counts = collections.Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 10 for w in [*t.lower().split(), None])
    n = sum(counts.values())
    for i, t in rows:
        want = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (len(counts) + 1))) for w in [*t.lower().split(), None])
        assert got[i]["base_score"] == pytest.approx(want)
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0) and got[i]["train_tokens"] == n


@pytest.mark.parametrize("values", [[], [0.0, 0.0], [1.5], [0.0, 2.5, 2.5, 0.0, -1.0] * 999, [float(i) / 7 for i in range(9000)], [0.25] * 5000 + [float(i) for i in range(70000)]])
def test_floats_are_sealed_as_they_are(values):
    a = np.array(values, np.float64)
    assert (exchange.unseal(exchange.seal({"x": a}))["x"] == a).all()


@pytest.mark.parametrize("passes", [1, 3])
def test_katz_tables_have_counts_and_the_weights_of_contexts(spark, passes):
    rows = words(4, 200)
    model = katz.fit(spark.createDataFrame(rows, DOCS), 3, max_tokens=150, bucket_keys=60, passes=passes)
    train = [[*t.encode().lower().split(), b" end"] for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    hashed = lambda w: np.array([katz.xxhash.xxh3_64_intdigest(w)], np.uint64)
    signed = lambda a: int(a.view(np.int64)[0])
    ones = collections.Counter(w for d in train for w in d)
    twos = collections.Counter(p for d in train for p in zip([b" start", *d], d))
    got = {r["key"]: r for r in katz.ngrams(model, 1).collect()}
    assert {k: r["count"] for k, r in got.items()} == {signed(hashed(w)): c for w, c in ones.items()}
    assert {r["key"]: r["count"] for r in katz.ngrams(model, 2).collect()} == {signed(exchange.mix(*map(hashed, p))): c for p, c in twos.items()}
    assert all(r["total"] is None for r in katz.ngrams(model, 3).collect())
    d = model.numbers["discounts"]
    p1 = {w: float(d[1].of(np.array(c))) * c / model.numbers["total"] for w, c in ones.items()}
    for h in ones:
        after = {w: c for (v, w), c in twos.items() if v == h}
        kept = sum(float(d[2].of(np.array(c))) * c for c in after.values())
        left = max(sum(after.values()) - kept, 0.5)
        want = (kept + left, left / (kept + left) / (1 - sum(p1[w] for w in after))) if after else (0, 1)
        assert (got[signed(hashed(h))]["total"], got[signed(hashed(h))]["alpha"]) == pytest.approx(want, rel=1e-6)


def test_katz_stores_no_keys_and_contexts_go_by_numbers(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choices([f"w{j}" for j in range(900)], k=60))) for i in range(90)]
    model = katz.fit(spark.createDataFrame(rows, DOCS).repartition(2), 3, max_tokens=1500, bucket_keys=1000)
    replies: dict = {}
    for x in model.replies.collect():
        assert x["kind"] in ("reply", "weights")
        replies.setdefault(x["sender"], []).append(x.asDict())
    for row in map(lambda x: x.asDict(), model.chunks.collect()):
        e = katz.Evaluation(row, replies[row["chunk"]], model.numbers, 3)
        buckets = max(4, -(-sum(len(t.split()) + 1 for _, t in rows) // 1000))
        for m in (1, 2):
            assert (exchange.cuts(e.number[m], buckets) == exchange.cuts(e.keys[m], buckets)).all() and (e.number[m][1:] > e.number[m][:-1]).all()
        assert len(exchange.pack_sorted(e.number[2])) < 0.4 * len(exchange.pack_sorted(e.keys[2]))


def test_katz_sorts_keys_that_differ_in_their_last_bits():
    r = np.random.default_rng(2)
    for keys in (r.integers(0, 1 << 64, 5000, dtype=np.uint64, endpoint=False) // np.uint64(9), np.array([1 << 63, 3, 2, 3, 1, 2], np.uint64), np.array([], np.uint64), np.array([7], np.uint64)):
        found, at = katz._distinct(keys)
        assert (found == np.unique(keys)).all() and (found[at] == keys).all()


def test_katz_of_order_3_over_levels_of_the_exchange(spark):
    rows = words(5, 50)
    docs = spark.createDataFrame(rows, DOCS).repartition(8).sortWithinPartitions("doc_id")
    got = sorted(((r["doc_id"], r["score"]) for r in katz.katz_scores(docs, 3, max_tokens=20, bucket_keys=30, fan=3).collect()))
    want = sorted((w[0], w[3]) for w in brute_katz(rows, 3))
    assert [g[0] for g in got] == [w[0] for w in want] and [g[1] for g in got] == pytest.approx([w[1] for w in want], abs=1e-9)


def test_katz_on_little_and_nothing(spark):
    docs = spark.createDataFrame(words(1, 3), DOCS)
    assert katz.katz_scores(docs.limit(0)).count() == 0
    held = spark.createDataFrame([(i, "a b") for i in range(300) if zlib.crc32(str(i).encode()) % 10 == 0], DOCS)
    rows = katz.katz_scores(held).collect()
    assert {(r["n_known"], r["train_tokens"]) for r in rows} == {(0, 0)} and all(math.isfinite(r["score"]) for r in rows)


def test_katz_predicts_held_out_text_better_than_the_base(spark):
    r = random.Random(5)
    follow = {w: r.sample("abcdefghijklmnop", 2) for w in "abcdefghijklmnop"}
    rows = []
    for i in range(300):
        w, text = r.choice("abcdefghijklmnop"), []
        for _ in range(30):
            text.append(w)
            w = r.choice(follow[w])
        rows.append((i, " ".join(text)))
    got = [x for x in katz.katz_scores(spark.createDataFrame(rows, DOCS)).collect() if x["held_out"]]
    assert sum(x["score"] for x in got) > 0.6 * sum(x["base_score"] for x in got)


def brute_statistics(text):
    w = (text or "").encode().split()
    chars = sum(len(x.decode()) for x in w)
    lines = [x for x in (text or "").encode().split(b"\n") if x.split()]
    windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return [len(w), chars, sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)]


TEXTS = [None, "", "  \n\t", "é ü\x0bx", "a\na\n\nb \na", "a b c d e f a b c d e g", "x " * 40, "# * $ % & | < >", "1 2 3 4", "a b c d e", "na na na na na na", " a b c d", "aa b\r\naa b\r\n" * 3]


def test_rule_statistics(spark):
    got = quality_rules.statistics([(t or "").encode() for t in TEXTS]).tolist()
    assert got == [brute_statistics(t) for t in TEXTS]


def quality_rows():
    r = random.Random(3)
    good = [(i, " ".join("".join(r.choices("abcdefgh", k=r.randint(3, 8))) for _ in range(r.randint(20, 200)))) for i in range(400)]
    bad = [(1000 + i, " ".join("".join(r.choices("abcdefgh", k=4)) + "###" for _ in range(r.randint(20, 200)))) for i in range(40)]
    return good, bad


def test_quality_catches_anomalies_and_keeps_good_documents(spark):
    good, bad = quality_rows()
    docs = spark.createDataFrame(good + bad + [(None, None), (7, good[7][1])], DOCS)
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good[:300]] + [(i, 0, 0) for i, _ in bad[:20]] + [(None, 1, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int")
    rows = quality_rules.quality_rules(docs, labels).collect()
    kept = {r["doc_id"] for r in rows if r["kept"]}
    assert len(rows) == 442 and len([i for i, _ in good if i in kept]) >= 395
    assert not kept & {i for i, _ in bad} and None not in kept


def plain_path(tree, x, node=0, depth=0):
    feature, value, left, right, path = tree
    if feature[node] < 0:
        return path[node]
    return plain_path(tree, x, left[node] if x[feature[node]] < value[node] else right[node], depth + 1)


def test_the_verdict_is_that_of_plainly_walked_trees(spark):
    good, bad = quality_rows()
    docs = spark.createDataFrame([*good, *bad], DOCS)
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good[:300]] + [(i, 0, 0) for i, _ in bad[:20]], "doc_id bigint, quality int, toxic int")
    forest, most = quality_rules.fit(docs, labels)
    sizes, paths = forest.sample, []
    expected = 2 * (math.log(sizes - 1) + 0.5772156649) - 2 * (sizes - 1) / sizes
    for r in quality_rules.quality_rules(docs, labels).collect():
        x = quality_rules.features(np.array([[r[c] for c in quality_rules.STATISTICS]]))[0]
        paths.append(sum(plain_path(t, x) for t in forest.trees) / len(forest.trees))
        score = 2 ** -(paths[-1] / expected)
        assert r["anomaly"] == pytest.approx(score, abs=1e-12)
        assert r["kept"] == (not r["base_failed"] and score <= most)
    assert min(paths) < max(paths)


def test_the_threshold_comes_from_rows_that_did_not_grow_the_forest():
    r = np.random.default_rng(0)
    rows = np.column_stack([r.integers(50, 200, 400), r.integers(300, 900, 400), r.integers(0, 3, 400), np.zeros(400, int), np.zeros(400, int)])
    good, grows = np.ones(400, bool), np.arange(400) % 2 == 0
    good[1:80:2], rows[:80, 2] = False, 60
    forest, most = quality_rules.grown(rows, good, grows, 0.99)
    other = good.copy()
    other[grows] = ~other[grows]  # labels of the rows that grow it do not matter
    again, same = quality_rules.grown(rows, other, grows, 0.99)
    assert same == most and all((a == b).all() for s, t in zip(forest.trees, again.trees) for a, b in zip(s, t))
    assert quality_rules.grown(rows, np.ones(400, bool), grows, 0.99) == (None, np.inf)


def test_quality_without_labels_and_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l", "mine"), (2, "a", "mine")], "doc_id bigint, text string, kept string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert [(r["doc_id"], r["kept"]) for r in quality_rules.quality_rules(docs, labels).orderBy("doc_id").collect()] == [(1, True), (2, False)]
    assert quality_rules.quality_rules(docs.limit(0), labels).count() == 0


def test_isolation_scores_and_thresholds():
    x = np.random.default_rng(1).normal(0, 0.1, (500, 2))
    forest = quality_rules.IsolationForest(x)
    assert forest.score(np.array([[0.0, 0.0]]))[0] < forest.score(np.array([[3.0, 3.0]]))[0]
    assert quality_rules.calibrated(np.array([0.1, 0.2, 0.9]), np.array([True, True, False]), 0.9) == pytest.approx(0.55)
    assert quality_rules.calibrated(np.array([0.1]), np.array([True]), 0.9) == np.inf


ODD = [None, "", " ", "a  b\n\n c\t", "<|endoftext|>x<|endoftext|>", "don't WON'T 's", "日本語 １２３ ½", "é́ ☃" * 3, "x" * 5000, "\x1c\x85 a", "tail   ", "Repeat repeat"]


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    tok = Tokenizer.from_file(path)
    docs = spark.createDataFrame([*enumerate(ODD), (None, "a"), (3, "a")], DOCS).repartition(3)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(docs, path, limit=5).collect())
    n = lambda t: len(tok.encode(t or "", add_special_tokens=False).ids)
    want = sorted((-1 if i is None else i, len((t or "").encode()), n(t), n(t) > 5) for i, t in [*enumerate(ODD), (None, "a"), (3, "a")])
    assert got == want
    assert token_counts.token_counts(docs.limit(0), path).count() == 0


def test_the_token_table_is_bounded_and_caches_are_emptied():
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    with pytest.raises(ValueError):
        token_counts.length_table(path, max_table=10)
    cache = token_counts._Cache({" the": 1}, Tokenizer.from_file(path), max_cache=3, max_key=8)
    for i in range(10):
        assert cache[f" qz{i}x"] > 1
    assert len(cache) <= 4 and cache[" the"] == 1 and cache["y" * 50] and "y" * 50 not in cache


def test_the_registered_katz_query_is_of_order_3(spark, tmp_path):
    from statemesh.llm import katz, queries

    rows = [(i, "a b c d a b c e a b f"[: 9 + i % 12]) for i in range(60)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    scores = lambda df: {r["doc_id"]: round(r["score"], 6) for r in df.collect()}
    got = scores(queries.op1_katz(spark, str(tmp_path)))
    assert got == scores(katz.katz_scores(docs, order=3)) != scores(katz.katz_scores(docs, order=2))


def test_columns_with_clashing_names(spark):
    rows = words(3, 12)
    plain = spark.createDataFrame(rows, DOCS)
    odd = spark.createDataFrame([(*r, "x", 7, None, b"z") for r in rows], DOCS + ", chunk string, n_tokens int, body string, score binary")
    shown = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert shown(katz.katz_scores(odd)) == shown(katz.katz_scores(plain))
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    assert shown(token_counts.token_counts(odd, path)) == shown(token_counts.token_counts(plain, path))
