"""Byte and word repeats against plain dictionaries."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from podspark.llm import repeats, substring_dedup, suffix_dedup
from podspark.llm.suffix_dedup import common_prefixes, suffix_array

SCHEMA = "doc_id bigint, text string, key string, content string, gram int, lo int"


def brute(docs, width, split, join):
    """What the contract says, window by window; ``docs`` are (id, text, hash of the text), and rows equal in all three are one document."""
    order = sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0, d[2]))
    first = {}
    windows = lambda seq: [seq[s : s + width] if isinstance(seq, bytes) else tuple(seq[s : s + width]) for s in range(len(seq) - width + 1)]
    for at, (_, t, _) in enumerate(order):
        for s, w in enumerate(windows(split(t or ""))):
            first.setdefault(w, (at, s))
    out = []
    for d in docs:
        at, seq = order.index(d), split(d[1] or "")
        cover = {p for s, w in enumerate(windows(seq)) if first[w] < (at, s) for p in range(s, s + width)}
        kept = join([seq[p : p + 1] if isinstance(seq, bytes) else seq[p] for p in range(len(seq)) if p not in cover])
        out.append((d[0], len(seq), len(cover), sum(1 for p in cover if p - 1 not in cover), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def made(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [text(60) for _ in range(4)]
    docs = []
    for k in range(60):
        t = text(rng.randint(0, 80))
        for s in rng.sample(shared, rng.randint(0, 3)):
            parts = s.split(" ")
            a, b = sorted(rng.sample(range(len(parts)), 2))
            t += rng.choice([" ", "\n"]) + " ".join(parts[a:b]) + " " + text(rng.randint(0, 10))
        docs.append((k, t))
    docs += [(100, docs[3][1]), (101, docs[5][1]), (102, None), (103, ""), (104, "a" * 700), (105, "ab" * 400), (106, "x y " * 90), (107, "\x00" * 150 + "q" + "\x00" * 150), (100, docs[3][1]), (None, shared[0])]
    if seed == 2:  # other texts under keys that are there already
        docs += [(5, shared[1] + " " + text(60)), (5, text(60)), (None, shared[2] + " " + text(50)), (None, None)]
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "k", "c", 1, 2) for i, t in docs], SCHEMA).repartition(3)


def hashed(df):
    return [(r.doc_id, r.text, r.h) for r in df.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) AS h").collect()]


@pytest.mark.parametrize(("seed", "hot"), [(1, 4096), (2, 4096), (2, 1)])
def test_bytes_equal_brute_force(spark, seed, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    df = frame(spark, made(seed))
    got = suffix_dedup.dedup(df).collect()
    want = brute(hashed(df), 100, lambda t: t.encode(), b"".join)
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], key=str) == want


@pytest.mark.parametrize(("seed", "hot"), [(1, 4096), (2, 4096), (2, 1)])
def test_words_equal_brute_force(spark, seed, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", hot)
    df = frame(spark, made(seed))
    got = substring_dedup.dedup(df).collect()
    want = [(i, n, r, h) for i, n, r, _, h in brute(hashed(df), 20, lambda t: t.encode().split(), b" ".join)]
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=str) == sorted(want, key=str)


def test_keys_of_other_types_and_texts_under_one_key(spark):
    one, two, three = "first unit " + "x1 y2 z3 " * 30, "another text " + " ".join(f"v{k}" for k in range(60)), " ".join(f"u{k}" for k in range(60))
    rows = [("b", one), ("a", two), ("b", three), ("c", f"{two} end"), (None, three)]
    df = spark.createDataFrame(rows, "id string, body string")
    for got in (suffix_dedup.dedup(df, key="id", text="body").collect(), substring_dedup.dedup(df, key="id", text="body").collect()):
        removed = sorted((r.id or "", r.n_removed > 0) for r in got)
        assert [r for r in removed if r[0] in ("", "a", "c")] == [("", False), ("a", False), ("c", True)]
    # Of one key the text that stands nowhere else stays whole, whatever the other one loses.
    alone = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(5, f"{two} {alone}"), (5, alone[:-3] + "q"), (1, two), (5, "p " * 5)], "doc_id int, text string")
    want = brute(hashed(df), 20, lambda t: t.encode().split(), b" ".join)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup(df).collect()), key=str) == sorted(((i, n, r, h) for i, n, r, _, h in want), key=str)


def spans_under_one_gram():
    """Forty spans around one gram, as ``settle`` gets them."""
    rng = random.Random(4)
    rows = []
    for k in range(40):
        left = [rng.choice("ab") for _ in range(4)]
        words = [*left, *"cdefghij", *(rng.choice("xy") for _ in range(4))]
        rows.append((k, words))
    return rows


def test_small_shards_are_merged():
    """One gram over many shards gives the same repeats as one shard, and pairs of stretches are told to agree or not."""
    names = ["gram", "pair", "second", "doc", "lo", "hi", "place", "content"]
    results = []
    for module, unit in ((suffix_dedup, 1), (substring_dedup, 8)):
        raw = lambda words: b"".join(w.encode() if unit == 1 else np.array([ord(w)], np.uint64).tobytes() for w in words)  # noqa: B023, E731
        rows = [(5, False, False, k, 0, 4, 4, raw(words)) for k, words in spans_under_one_gram()]
        one, other = "abcdefghijklmnopqrstuvwxyz", "abcdefghijklm?opqrstuvwxyz"
        rows += [(7, True, False, 90, 0, 14, 0, raw(one)), (7, True, True, 91, 3, 17, 3, raw(one)), (8, True, False, 90, 0, 14, 0, raw(one)), (8, True, True, 92, 5, 19, 5, raw(other))]
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in map(list, zip(*rows, strict=True))], names)
        for shard in (1, 60, 1 << 20):
            extra = {} if unit == 1 else {"size": 8}
            marked, agreed = set(), []
            for out in module.settle(iter([batch]), width=12, shard=shard, **extra):
                for d, lo, hi, d0, lo0 in zip(*(out.column(c).to_pylist() for c in out.schema.names), strict=True):
                    if d is None:
                        agreed.append((d0, lo0))
                    else:
                        marked.update((d, p) for p in range(lo, hi))
            results.append((marked, agreed))
    assert all(r == results[0] for r in results) and results[0][1] == [(91, 3)]
    assert {p for d, p in results[0][0] if d == 92} == {*range(5, 18), *range(19, 31)} and any(d < 40 for d, _ in results[0][0])


def test_suffix_array_and_common_prefixes():
    rng = random.Random(9)
    for alphabet in (b"ab", b"a", b"abcdefgh"):
        data = bytes(rng.choice(alphabet) for _ in range(700))
        a = np.frombuffer(data, np.uint8)
        sa, rank = suffix_array(a)
        assert sa.tolist() == sorted(range(700), key=lambda p: data[p:]) and all(sa[rank] == np.arange(700))
        lcp = common_prefixes(a, sa, rank, 100)
        for k in range(1, 700):
            x, y = data[sa[k - 1] :], data[sa[k] :]
            n = next((j for j, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
            assert lcp[k] == min(n, 100)


def test_long_runs_are_cut_without_losing_windows(monkeypatch):
    rng = np.random.default_rng(5)
    codes = rng.integers(1, 4, 3000).astype(np.uint64)
    at = np.array([0, 700, 700, 705, 1900, 3000])
    starts = lambda spans: sorted(p for lo, hi, *_ in zip(*spans, strict=True) for p in range(lo, hi + 1))
    whole = repeats.spans_of(codes, at, 20, 8)
    monkeypatch.setattr(repeats, "SEGMENT", 64)
    cut = repeats.spans_of(codes, at, 20, 8)
    want = [p for a, b in zip(at[:-1], at[1:], strict=True) for p in range(a, b - 19)]
    assert starts(whole) == starts(cut) == want
    gram = lambda spans: {p: g for lo, hi, _, g, _ in zip(*spans, strict=True) for p in range(lo, hi + 1)}
    assert gram(whole) == gram(cut)


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup.dedup(none).collect() == [] and substring_dedup.dedup(none).collect() == []
