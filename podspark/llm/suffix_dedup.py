"""Removal of repeated byte strings by suffix arrays.

What may repeat is brought together in shards by ``repeats``: all spans around one gram stand in
one stream.  Each shard of the stream gets a suffix array by Larsson-Sadakane refinement (groups of
equal prefixes are split by the rank of the suffix ``h`` further on, ``h`` doubling, and only groups
that are still open are touched), common prefixes by Kasai's rule in parallel lanes, and runs of
suffixes that share ``width`` bytes give the repeats.  If the spans of one gram fill several shards,
later shards are merged with the earlier ones by binary search over their sorted windows.

Defined results: a null or empty text has no bytes and nothing removed; texts shorter than
``width`` are kept whole; repeated rows are one document, rows with one key and different texts are several
(see ``repeats``); an empty table gives an empty result; texts of any length are judged whole; other input columns are
dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from podspark.llm.arrow_text import byte_codes, slices
from podspark.llm.repeats import first_of, merge, removed, repeats, settled_batch

WIDTH = 100
GRAM = 32
#: Bytes of content in one suffix array.
SHARD = 1 << 20


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one big-endian number; zeros stand after the end."""
    x = np.zeros(len(data) + 8, np.uint64)
    x[: len(data)] = data
    for have in (1, 2, 4):
        x[:-have] = x[:-have] << np.uint64(8 * have) | x[have:]
    return x[: len(data)]


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the rank of each."""
    n = len(data)
    words = _words(data)
    sa = np.argsort(words, kind="stable")
    new = np.ones(n, bool)
    new[1:] = words[sa[1:]] != words[sa[:-1]]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    last = np.r_[np.flatnonzero(new)[1:], n] - 1  # a group's rank is its last place
    rank[sa] = last[np.cumsum(new) - 1]
    h = 8
    while True:
        single = new.copy()
        single[:-1] &= new[1:]
        slots = np.flatnonzero(~single)
        if not len(slots):
            break
        who = sa[slots]
        far = rank[np.minimum(who + h, n)]
        order = np.argsort(rank[who] * np.int64(n + 1) + far + 1, kind="stable")
        who, far, group = who[order], far[order], rank[who[order]]
        sa[slots] = who
        split = np.ones(len(who), bool)
        split[1:] = (group[1:] != group[:-1]) | (far[1:] != far[:-1])
        new[slots] |= split
        edge = np.flatnonzero(split)
        ends = slots[np.r_[edge[1:], len(slots)] - 1]
        rank[who] = ends[np.cumsum(split) - 1]
        h *= 2
    return sa, rank[:n]


def common_prefixes(data: np.ndarray, sa: np.ndarray, rank: np.ndarray, most: int, lane: int = 64) -> np.ndarray:
    """Bytes (``most`` at the most) that each suffix in ``sa`` shares with the one before it.

    Kasai's rule: going from a place to the next, at most one byte of the common prefix is lost.
    Many lanes of ``lane`` consecutive places advance together.
    """
    n = len(data)
    out = np.zeros(n, np.int64)
    words = np.r_[_words(data), np.zeros(most + 16, np.uint64)]
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    start = np.arange(0, n, lane)
    h = np.zeros(len(start), np.int64)
    for step in range(lane):
        i = start + step
        live = i < n
        i, h = i[live], h[live]
        start = start[live]
        j = before[i]
        h = np.where(j < 0, 0, h)
        open_ = np.flatnonzero(j >= 0)
        while len(open_):
            x = words[i[open_] + h[open_]] ^ words[j[open_] + h[open_]]
            # Leading zero bytes of the difference, the end of the data being the limit; without a bit
            # below each set bit, no rounding reaches the next power of two.
            x &= ~(x >> np.uint64(1))
            same = np.where(x == 0, 8, (64 - np.frexp(x.astype(np.float64))[1]) // 8)
            room = np.minimum(n - np.maximum(i[open_], j[open_]), most) - h[open_]
            gain = np.minimum(np.maximum(same, 0), np.maximum(room, 0))
            h[open_] += gain
            open_ = open_[(gain == 8) & (room > 8)]
        out[rank[i]] = h
        h = np.maximum(h - 1, 0)
    return out


def _windows(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The windows at given places as fixed-width strings; a closing byte keeps zeros at the end."""
    block = np.ones((len(at), width + 1), np.uint8)
    block[:, :width] = np.lib.stride_tricks.sliding_window_view(data, width)[at]
    return block.view(f"S{width + 1}")[:, 0]


def settle(batches: Iterator[pa.RecordBatch], width: int = WIDTH, shard: int = SHARD) -> Iterator[pa.RecordBatch]:
    """Repeats among spans that come in the order of gram, document and start."""
    names = ("gram", "doc", "lo", "hi", "content", "second")
    rows: list[tuple] = []
    size = 0
    earlier: tuple[int, list[np.ndarray]] = (0, [])

    def close() -> pa.RecordBatch:
        nonlocal earlier
        grams, docs, lo, hi, content, second = (list(x) for x in zip(*rows, strict=True))
        data = np.frombuffer(b"".join(content), np.uint8)
        count = np.array(hi) - np.array(lo) + 1
        base = np.cumsum([0, *map(len, content)])[:-1]
        sa, rank = suffix_array(data)
        shared = common_prefixes(data, sa, rank, width)
        run = np.cumsum(shared < width)
        # The places where windows start, each with its document and start.
        inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        place = np.repeat(base, count) + inner
        of = np.repeat(np.arange(len(rows)), count)
        gram, doc, start = np.array(grams)[of], np.array(docs)[of], np.array(lo)[of] + inner
        group = run[rank[place]]
        # A shard may hold several grams; a window and its repeats have the same one.
        first = first_of([group], doc, start)
        if earlier[1]:
            # Merging with earlier shards of the same gram: what they have starts earlier.
            mine = np.flatnonzero(first & (gram == earlier[0]))
            for known in earlier[1]:
                if len(mine):
                    asked = _windows(data, place[mine], width)
                    there = np.minimum(np.searchsorted(known, asked), len(known) - 1)
                    found = known[there] == asked
                    first[mine[found]] = False
                    mine = mine[~found]
        last = grams[-1]
        ours = first & (gram == last)
        kept = earlier[1] if earlier[0] == last else []
        if ours.any():
            kept = [*kept, np.sort(_windows(data, place[ours], width))]
            if len(kept) > 16:
                kept = [np.sort(np.concatenate(kept))]
        earlier = (last, kept)
        owner, begin, end = merge(doc[~first], start[~first], start[~first] + width)
        whole = (np.bincount(of[~first], minlength=len(rows)) == count).tolist()
        return settled_batch(owner, begin, end, [(docs[k], lo[k]) for k in range(len(rows)) if second[k] and whole[k]])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            rows.append(row)
            size += len(row[4])
            if size >= shard:
                yield close()
                rows, size = [], 0
    if rows:
        yield close()


def _pick(data: np.ndarray, lo: np.ndarray, end: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(lo.tolist(), end.tolist(), strict=True)]


def _encode(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return byte_codes(7)[data], at


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM, kept_text: bool = False) -> DataFrame:
    """Per document: key, n_bytes, n_removed, n_spans, kept_sha256, and with ``kept_text`` the bytes that are left."""
    found = repeats(docs, key, text, width, gram, 1, _encode, _pick, partial(settle, width=width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 4 << 20):
            out: list[list] = [[], [], [], [], []]
            for value, spans in zip(part.column("text").to_pylist(), part.column("spans"), strict=True):
                raw = (value or "").encode("utf-8", "surrogatepass")
                start, end = removed(spans, len(raw))
                kept = b"".join(raw[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(raw)], strict=True))
                for col, x in zip(out, (len(raw), int((end - start).sum()), len(start), hashlib.sha256(kept).hexdigest(), kept if kept_text else None), strict=True):
                    col.append(x)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("key"), *map(pa.array, out, types)], ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    schema = found.select("key").schema
    for name, kind in (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string"), ("kept", "binary")):
        schema = schema.add(name, kind)
    rows = found.mapInArrow(run, schema).withColumnRenamed("key", key)
    return rows if kept_text else rows.drop("kept")
