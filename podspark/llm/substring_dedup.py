"""Removal of repeated word sequences by seed and extend.

Documents meet on winnowed anchors (see ``repeats``).  Around a shared anchor all occurrences are
lined up and extended word by word to both sides at once: the class of an occurrence after j words
is its class after j - 1 words split by the next word.  A window with o words before the anchor
repeats if another occurrence has the same class o words to the left and the rest to the right; so
every match is followed as far as it goes, and what is marked are its maximal repeats of at least
``width`` words.

Defined results: a null or empty text has no words; texts of fewer than ``width`` words are kept;
repeated rows are one document, rows with one key and different texts are several (see ``repeats``); words
are compared by 64-bit hashes; an empty table gives an empty result; texts of any
length are judged whole; other input columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from podspark.llm.arrow_text import slices, word_hashes
from podspark.llm.repeats import first_of, merge, removed, repeats, settled_batch

WIDTH = 20
GRAM = 8
#: Words of content that are extended together.
SHARD = 1 << 18


def _classes(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Numbers of the distinct pairs (class so far, next word)."""
    order = np.lexsort((word, before))
    b, w = before[order], word[order]
    new = np.ones(len(b), bool)
    new[1:] = (b[1:] != b[:-1]) | (w[1:] != w[:-1])
    out = np.empty(len(b), np.int64)
    out[order] = np.cumsum(new)
    return out


def extend(group: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, anchor: np.ndarray, words: np.ndarray, at: np.ndarray, width: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows that repeat among occurrences whose words stand in ``words`` from ``at`` on: the occurrence each is of, and its start.

    The gram of an occurrence stands ``anchor`` words behind its first word; ``lo`` and ``hi`` are the
    starts of the first and last window that chose it.
    """
    n, most = len(group), width - size
    none = np.uint64(0)

    def word(i: np.ndarray) -> np.ndarray:
        """The word at a place of each occurrence, or a mark of its own where the occurrence ends."""
        there = (i >= at[:-1]) & (i < at[1:])
        return np.where(there, words[np.clip(i, 0, len(words) - 1)], none)

    # The gram's own words first: their hash alone has brought them together.
    first = group.view(np.uint64)
    middle = _classes(np.zeros(n, np.int64), first)
    for step in range(size):
        middle = _classes(middle, word(at[:-1] + anchor + step))
    left, right = [middle], [middle]
    for step in range(1, most + 1):
        left.append(_classes(left[-1], word(at[:-1] + anchor - step)))
        right.append(_classes(right[-1], word(at[:-1] + anchor + size - 1 + step)))
    out_of, out_start = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for o in range(most + 1):
        # The window with o words before the gram starts at lo + anchor - o.
        start = lo + anchor - o
        rows = np.flatnonzero((start >= lo) & (start <= hi))
        if len(rows):
            again = ~first_of([left[o][rows], right[most - o][rows]], doc[rows], start[rows])
            out_of.append(rows[again])
            out_start.append(start[rows][again])
    return np.concatenate(out_of), np.concatenate(out_start)


def along(first: bytes, second: bytes, width: int) -> tuple[np.ndarray, bool]:
    """Two stretches extended along each other: the windows of the second one that agree with the first one's, and whether all do."""
    x, y = np.frombuffer(first, np.uint64), np.frombuffer(second, np.uint64)
    # Places since the last difference, the place itself included.
    place = np.arange(1, len(y) + 1)
    run = place - np.maximum.accumulate(np.where(x == y, 0, place))
    start = np.flatnonzero(run >= width) - (width - 1)
    return start, len(start) == len(y) - width + 1


def settle(batches: Iterator[pa.RecordBatch], width: int = WIDTH, size: int = GRAM, shard: int = SHARD) -> Iterator[pa.RecordBatch]:
    """Repeats among spans that come in the order of gram, document and start.

    If a gram goes on in the next shard, its occurrences that hold a window seen for the first time go along.
    """
    names = ("gram", "doc", "lo", "hi", "place", "content", "pair", "second")
    rows: list[tuple] = []
    carried = weight = 0

    def close() -> tuple[pa.RecordBatch, list[tuple]]:
        spans = [r for r in rows if not r[6]]
        owner, begin, agreed, kept = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [], []
        if spans:
            gram, doc, lo, hi, place, content, _, _ = (list(x) for x in zip(*spans, strict=True))
            words = np.frombuffer(b"".join(content), np.uint64)
            at = np.cumsum([0, *(len(c) // 8 for c in content)])
            doc, lo, hi = np.array(doc), np.array(lo), np.array(hi)
            of, start = extend(np.array(gram), doc, lo, hi, np.array(place) - lo, words, at, width, size)
            repeated = np.bincount(of, minlength=len(spans))
            new = of >= carried
            owner.append(doc[of[new]])
            begin.append(start[new])
            kept = [spans[k] for k in np.flatnonzero((repeated < hi - lo + 1) & (np.array(gram) == gram[-1])).tolist()]
        # The two stretches of a pair follow one another; if the shard ends between them, the first one waits.
        waits = None
        for r in (r for r in rows if r[6]):
            if waits is None or waits[0] != r[0]:
                waits = r
                continue
            a, b = (waits, r) if r[7] else (r, waits)
            start, whole = along(a[5], b[5], width)
            owner.append(np.full(len(start), b[1]))
            begin.append(b[2] + start)
            if whole:
                agreed.append((b[1], b[2]))
            waits = None
        key, at_ = np.concatenate(owner), np.concatenate(begin)
        return settled_batch(*merge(key, at_, at_ + width), agreed), kept + ([waits] if waits else [])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            rows.append(row)
            weight += len(row[5]) // 8
            if weight >= shard:
                out, rows = close()
                carried, weight = sum(not r[6] for r in rows), 0
                yield out
    if rows:
        yield close()[0]


def _encode(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(data, at)


def _pick(data: np.ndarray, lo: np.ndarray, end: np.ndarray) -> list[bytes]:
    words, _ = word_hashes(data, np.array([0, len(data)]))
    return [words[a:b].tobytes() for a, b in zip(lo.tolist(), end.tolist(), strict=True)]


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM, kept_text: bool = False) -> DataFrame:
    """Per document: key, n_words, n_removed, kept_sha256, and with ``kept_text`` the words that are left."""
    found = repeats(docs, key, text, width, gram, 8, _encode, _pick, partial(settle, width=width, size=gram))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 4 << 20):
            out: list[list] = [[], [], [], []]
            for value, spans in zip(part.column("text").to_pylist(), part.column("spans"), strict=True):
                words = (value or "").encode("utf-8", "surrogatepass").split()
                start, end = removed(spans, len(words))
                kept = [w for a, b in zip([0, *end.tolist()], [*start.tolist(), len(words)], strict=True) for w in words[a:b]] if len(start) else words
                joined = b" ".join(kept)
                for col, x in zip(out, (len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined if kept_text else None), strict=True):
                    col.append(x)
            types = (pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("key"), *map(pa.array, out, types)], ["key", "n_words", "n_removed", "kept_sha256", "kept"])

    schema = found.select("key").schema
    for name, kind in (("n_words", "long"), ("n_removed", "long"), ("kept_sha256", "string"), ("kept", "binary")):
        schema = schema.add(name, kind)
    rows = found.mapInArrow(run, schema).withColumnRenamed("key", key)
    return rows if kept_text else rows.drop("kept")
