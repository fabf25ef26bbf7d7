"""Components of the Jaccard join against all pairs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from podspark.llm import common, near_join

SCHEMA = "doc_id bigint, text string, node bigint, key string, hash string, sig int"


def brute(docs):
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(docs))


def made(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    docs = []
    passage = text(40)
    for _ in range(25):
        base = text(rng.choice([3, 6, 9, 15, 30, 60, 150, 400])) + (passage if rng.random() < 0.3 else [])
        docs.append(base)
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 40))):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randint(0, 1)] = text(rng.randint(0, 1))
            docs.append(copy)
    chain = text(120)
    for _ in range(12):
        chain = list(chain)
        chain[rng.randrange(120)] = rng.choice(vocabulary)
        docs.append(chain)
    rng.shuffle(docs)
    out = [(k * 3, " ".join(d).upper() if k % 7 == 0 else " ".join(d)) for k, d in enumerate(docs)]
    return [*out, (9001, None), (9002, ""), (9003, " \n"), (9004, "one"), (9005, "One"), (9006, "a b c d " * 300), (9007, "a b c d " * 400)]


def test_equals_all_pairs(spark):
    for seed in (1,):
        docs = made(seed)
        df = spark.createDataFrame([(i, t, 1, "k", "h", 2) for i, t in docs], SCHEMA).repartition(3)
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_join.join(df).collect())
        assert got == brute(docs)


def test_any_way_of_comparing_finds_the_same(spark, monkeypatch):
    docs = made(3)
    df = spark.createDataFrame([(i, t, 1, "k", "h", 2) for i, t in docs], SCHEMA).repartition(3)
    want = brute(docs)
    # Groups alone; blocks alone; new signatures, then blocks; streams of one partner.
    for rounds, block, levels, partners in ((0, 256, 4, 512), (0, 3, 1, 512), (1, 2, 3, 1)):
        for name, value in (("ROUNDS", rounds), ("BLOCK", block), ("LEVELS", levels), ("PARTNERS", partners)):
            monkeypatch.setattr(near_join, name, value)
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_join.join(df).collect()) == want


def test_repeated_rows_other_keys_and_empty_table(spark):
    text = "w1 w2 w3 w4 w5 w6 w7 w8"
    df = spark.createDataFrame([(5, text, 1, "", "", 1), (5, text, 1, "", "", 1), (4, text.upper(), 1, "", "", 1), (None, text, 1, "", "", 1), (5, "other words", 1, "", "", 1), (None, "only null keys", 1, "", "", 1), (None, None, 1, "", "", 1)], SCHEMA)
    want = [(4, 5, 4), (5, 1, 5), (5, 5, 4), (5, 5, 4), (None, 0, None), (None, 1, None), (None, 5, 4)]
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_join.join(df).collect()), key=str) == want
    named = near_join.join(df.selectExpr("concat('d', doc_id) AS id", "text AS body"), key="id", text="body").collect()
    assert sorted(((r.id, r.component_id) for r in named), key=str)[:3] == [("d4", "d4"), ("d5", "d4"), ("d5", "d4")]
    assert near_join.join(spark.createDataFrame([], SCHEMA)).collect() == []


def test_similar_sets_share_a_signature():
    """Down to the exact threshold, at every size and level."""
    rng = np.random.default_rng(3)
    for size in [*range(7, 60), 100, 333, 1000, 4000]:
        for turn in range(6):
            a = rng.integers(1, 1 << 62, size, dtype=np.uint64)
            drop = int(rng.integers(0, size // 6 + 1))
            b = a[drop:]
            while 100 * (len(b) - 0) >= 85 * (size + len(b) - (size - drop) + 1) and rng.random() < 0.9:
                b = np.append(b, rng.integers(1, 1 << 62, 1, dtype=np.uint64))
            both = size - drop
            if 100 * both < 85 * (size + len(b) - both):
                continue
            a, b = np.sort(a), np.sort(b)
            sig, of = near_join.signatures(np.r_[a, b], np.array([0, len(a), len(a) + len(b)]), level=turn % 3)
            assert set(sig[of == 0]) & set(sig[of == 1]), (size, drop, len(b))


def test_sets_at_the_threshold_share_a_signature_for_80_percent():
    rng = np.random.default_rng(4)
    for size in [*range(5, 60), 200, 900]:
        for _ in range(6):
            a = rng.integers(1, 1 << 62, size, dtype=np.uint64)
            drop = size // 9  # as many go as come: (s - d) / (s + d) >= 0.8
            b = np.r_[a[drop:], rng.integers(1, 1 << 62, drop, dtype=np.uint64)]
            sig, of = near_join.signatures(np.r_[np.sort(a), np.sort(b)], np.array([0, size, 2 * size]), percent=80)
            assert size // 9 == 0 or set(sig[of == 0]) & set(sig[of == 1])


def licences(n_alike, n_other, seed=5):
    """One base with endings: ``n_other`` with eight words of their own (no links), ``n_alike`` with two (linked with each other)."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(9))
    base = [word() for _ in range(80)]
    docs = [" ".join(base + [word() for _ in range(8)]) for _ in range(n_other)]
    docs += [" ".join(base[:70] + [word() for _ in range(2)] + base[70:]) for _ in range(n_alike)]
    return list(enumerate(docs))


def test_members_with_many_shingles_of_their_own_are_not_paired(spark, monkeypatch):
    monkeypatch.setattr(near_join, "BLOCK", 8)
    monkeypatch.setattr(near_join, "ROUNDS", 0)
    met = []
    plain = near_join.possible_in_blocks
    monkeypatch.setattr(near_join, "possible_in_blocks", lambda left, *more: met.append(left.count()) or plain(left, *more))
    docs = licences(0, 120)
    got = near_join.join(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(i, i) for i, _ in docs]
    assert sum(met) == 0
    # Some that link with each other among many that do not.
    docs = licences(5, 90)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_join.join(df).collect()) == brute(docs)


def test_own_shingles_against_a_plain_count(spark):
    texts = ["a b c d e f", "a b c d x y", "x y z", "", "q r s t", "b c d e f"]
    sets = [{tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set() for w in map(str.split, texts)]
    want = {k: n for k, s in enumerate(sets) if (n := sum(all(x not in o for j, o in enumerate(sets) if j != k) for x in s))}
    for parts in (1, 4):
        rows = near_join.own_shingles(spark.createDataFrame(list(enumerate(texts)), "node bigint, text string").repartition(parts)).collect()
        assert {r.node: r.own for r in rows} == want
        some = near_join.own_shingles(spark.createDataFrame(list(enumerate(texts)), "node bigint, text string").repartition(parts), every=2).collect()
        assert all(0 < r.own <= want[r.node] for r in some)


def test_short_sketches_lose_no_pair_and_rule_most_others_out():
    rng = np.random.default_rng(6)
    for size in [*range(1, 40), 100, 333, 1000, 30_000]:
        for _ in range(3):
            a = rng.integers(1, 1 << 62, size, dtype=np.uint64)
            drop = size // 9  # the threshold for 80 %
            b = np.r_[a[drop:], rng.integers(1, 1 << 62, drop, dtype=np.uint64)]
            other = rng.integers(1, 1 << 62, size, dtype=np.uint64)
            long = near_join.sketches(np.r_[a, b, other], np.array([0, size, 2 * size, 3 * size]))
            x, y, z = (near_join.coarse(s, size) for s in long)
            assert len(x) <= max(8, 3 * size / 16) and len(x) <= len(long[0])
            assert 180 * near_join.sketch_distance(x, y) <= 20 * 2 * size
            assert size < 30 or size > 20_000 or 180 * near_join.sketch_distance(x, z) > 20 * 2 * size


def test_texts_of_classes_of_one_row_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "f g h i j"), (2, "f g h i j"), (3, "k l m n o")], "doc_id long, text string")
    rows = near_join._keyed(docs, "doc_id", "text")
    nodes = spark.createDataFrame([(10, 1, 1), (20, 2, 2)], "node long, key long, rows long").join(rows.dropDuplicates(["key"]), "key").selectExpr("node", "struct(key, hash) AS rep", "rows")
    got = near_join.texts_of(nodes.select("node"), rows, nodes, many=True)
    assert sorted(map(tuple, got.collect())) == [(10, "a b c d e"), (20, "f g h i j")]
    single, several = got._jdf.queryExecution().optimizedPlan().toString().split("Union")[1].split("Aggregate")
    assert "rows" in single and "first(text" in several


def test_a_filter_of_keys_is_small_and_loses_none(spark):
    keys = spark.range(40_000).selectExpr("xxhash64(id) AS hash", "id")
    for most, wrong in ((common.FILTER_WORDS, 300), (1 << 12, 20_000)):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(common, "FILTER_WORDS", most)
            found = common.key_filter(keys.filter("id < 20000"), "hash", 20_000)
            sizes = [len(r.bits) for r in found[0].collect()]
            assert sum(sizes) == found[1] <= min(most, 20_000) and max(sizes) <= common.FILTER_ROW
            hit = [r.id for r in common.held(keys, "hash", found).collect()]
            assert set(range(20_000)) <= set(hit) and len(hit) == len(set(hit)) <= 20_000 + wrong
            assert {r.id for r in common.held(keys, "hash", found, "left_anti").collect()} == set(range(40_000)) - set(hit)


def test_no_table_of_keys_is_broadcast(spark, monkeypatch):
    """Beyond ``BROADCAST_KEYS`` only filters are, also when they let many others through."""
    docs = made(3)
    df = spark.createDataFrame([(i, t, 1, "k", "h", 2) for i, t in docs], SCHEMA).repartition(3)
    for name, value in (("ROUNDS", 1), ("BLOCK", 2), ("LEVELS", 3), ("BROADCAST_KEYS", 0)):
        monkeypatch.setattr(near_join, name, value)
    monkeypatch.setattr(common, "FILTER_WORDS", 8)
    sent = []
    plain = F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda rows: sent.append(rows.columns) or plain(rows))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_join.join(df).collect()) == brute(docs)
    assert sent and all(columns == ["place", "bits"] for columns in sent)


def test_members_that_share_two_thirds_make_few_pairs(spark):
    rng = random.Random(8)
    base = [f"w{k}" for k in range(150)]
    docs = []
    for k in range(60):
        own = rng.sample(range(150), 3)
        docs.append((k, " ".join(f"own{k}x{n}" if n in own else w for n, w in enumerate(base))))
    rows = near_join._keyed(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text")
    nodes = near_join.with_coarse(near_join.classes(rows, 5).withColumnRenamed("n_shingles", "n"))
    met = nodes.selectExpr("1 AS sig", "node", "node AS root")
    assert near_join.possible_in_groups(met, nodes, 80).count() < 20
    # Of sets at the threshold none is lost.
    for size in [*range(5, 300, 7), 1000, 30_000]:
        a = np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        drop = size // 9
        b = np.r_[a[drop:], (a + np.uint64(1))[:drop]]
        x, y = (near_join.clear(s, size) for s in near_join.sketches(np.r_[a, b], np.array([0, size, 2 * size])))
        assert 180 * near_join.sketch_distance(x, y) <= 20 * 2 * size and len(x) <= max(64, 3 * size / 16)
