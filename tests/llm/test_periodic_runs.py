"""Runs, extensions and collapsed texts against plain word-by-word versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from podspark.llm import periodic_runs, queries
from podspark.llm.periodic_runs import Extensions, find_runs

DATA = "/root/testdata/sf0.001"


def brute(w):
    """Every run of the words, by start, then period; each stretch with its least period."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def random_text(rng):
    w = [rng.choice("abcdefgh"[: rng.randrange(1, 9)]) for _ in range(rng.randrange(60))]
    for _ in range(rng.randrange(4)):
        p = [rng.choice("abcd") for _ in range(rng.randrange(1, 12))]
        at = rng.randrange(len(w) + 1)
        w[at:at] = (p * 9)[: rng.randrange(1, 8 * len(p) + 1)]
    return w


def test_extensions_equal_plain_comparison():
    rng = np.random.default_rng(2)
    for k in range(60):
        n = int(rng.integers(2, 400))
        words = rng.integers(0, rng.integers(1, 5), n)
        if k % 3 == 0:
            words = np.tile(words[: max(1, n // 7)], 9)[:n]
        n, words[-1] = len(words), words.max() + 1
        near = Extensions(words)
        a, b = rng.integers(0, n, 300), rng.integers(0, n, 300)
        a, b = a[a != b], b[a != b]
        for x, y, got in zip(a.tolist(), b.tolist(), near.of(a, b).tolist(), strict=True):
            want = 0
            while max(x, y) + want < n and words[x + want] == words[y + want]:
                want += 1
            assert got == want


@pytest.mark.parametrize("pairs", [40, periodic_runs.PAIRS])
def test_runs_equal_plain_search(monkeypatch, pairs):
    monkeypatch.setattr(periodic_runs, "PAIRS", pairs)
    rng = random.Random(8)
    for _ in range(80):
        texts = [random_text(rng) for _ in range(rng.randrange(1, 9))]
        ids = np.array([ord(x) for w in texts for x in w], np.int64)
        bounds = np.cumsum([0, *map(len, texts)])
        got = [[] for _ in texts]
        for t, s, n, q in zip(*(v.tolist() for v in find_runs(ids, bounds)), strict=True):
            got[t].append((s, n, q))
        assert got == [brute(w) for w in texts]


def test_words_of_one_kind_and_long_periods():
    ids = np.concatenate([np.zeros(5000, np.int64), np.tile(np.arange(700), 5)[:3400], np.arange(900)])
    found = find_runs(ids, np.array([0, 5000, 8400, 9300]))
    assert [v.tolist() for v in found] == [[0, 1], [0, 0], [5000, 3400], [1, 700]]


def test_query_equals_plain_search(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    planted = 0
    for r in queries.op13_periodic_runs(spark, DATA).collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id] or "")
        h = zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and w:
            a, g = h // 10 % len(w), h // 10
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
            planted += 1
        runs = brute(w)
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (best[1] * 1000 // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
    assert planted > 10


def test_odd_rows(spark):
    long = "na " * 40_000 + "end"
    rows = [(None, None, 1), (1, "", 1), (2, " \n\t", 1), (3, "a b " * 4, 2), (3, "a b " * 4, 2), (4, long, 3), (5, "é" * 300_000 + " x x x x x x", 4), (6, "no run in here at all", 5)]
    frame = spark.createDataFrame(rows, "doc_id int, text string, Runs int")
    got = periodic_runs.periodic_runs(frame, keep=("doc_id", "Runs")).orderBy("doc_id").collect()
    assert [len(r.runs) for r in got] == [0, 0, 0, 1, 1, 1, 1, 0]
    assert got[3].collapsed == "a b" and got[5].collapsed == "na end" and got[6].collapsed.endswith("é x") and got[0].collapsed == "" == got[2].collapsed
    assert tuple(got[5].runs[0]) == (0, 40_000, 1) and got[7].n_words == 6
    assert periodic_runs.periodic_runs(spark.createDataFrame([], "doc_id int, text string")).collect() == []
