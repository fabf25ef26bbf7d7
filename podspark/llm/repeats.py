"""Repeated windows over all documents: winnowed anchors, and the frame that suffix arrays and seed-and-extend share.

A sequence (bytes or words) has one window of ``width`` elements at each start.  Every window picks
the least hash among its grams of ``gram`` elements, the leftmost of equal ones, so equal windows
pick the same gram at the same place.  Consecutive windows that pick the same gram form a span.
A window can only repeat if its gram repeats, and then the two spans meet under that gram's hash:

1. spans are made per task; of spans with equal hashes there the first two stand for the others;
2. one shuffle on the gram hash: of spans with equal hashes everywhere the first two stand for the
   others, and spans whose gram nobody else has are done;
3. what is left is compared by content (``settle``), which is read from the texts by document: under a gram
   that has several surroundings the first span of each, window by window; and the second of equal
   spans with the first one, where neighbours that meet the same document at the same distance make one pair of
   stretches, of at most ``STRETCH`` windows.
   A gram with more than ``HOT`` different surroundings is split: its windows are dealt out by the gram and half of what
   is free beside it, left or right, whichever is the longer side of a window; so equal windows stay
   together.  A part that is still too large is split again, until nothing of a window is free;
4. spans whose hash equals that of a second one are repeats if all windows of that one's stretch were found to be;
5. the repeats of each document are joined to its text.

The order of occurrences is (key, start).  A document is a row: rows with the same key and text are one
document, rows with the same key and different texts are different ones, ordered by a hash of the
text.  A null key orders first; keys may be of any type that can be ordered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from podspark.llm.arrow_text import SpanHash, mix64, slices, text_bytes
from podspark.llm.common import stored, stored_small

PART = 4 << 20
#: Window starts that are worked on at a time; a longer run of elements is cut, which only cuts spans.
SEGMENT = 1 << 24
#: Different surroundings of a gram, from which on it is split.
HOT = 4096
#: Windows of a pair of stretches.
STRETCH = 1 << 16
#: Rows that are broadcast at most: hot grams, and spans of which two have been found equal.
BROADCAST_GRAMS = 200_000
NULL_KEY = -(1 << 63)
#: bytes and offsets of texts -> one 64-bit code per element, and offsets in elements
Encode = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def spans_of(codes: np.ndarray, at: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start and the gram's place (absolute), gram hash and content hash of every span."""
    n = len(codes)
    none = np.empty(0, np.int64)
    if n - width >= SEGMENT:
        parts = []
        for s in range(0, n - width + 1, SEGMENT):
            part = codes[s : s + SEGMENT + width - 1]
            lo, hi, place, grams, content = spans_of(part, np.unique(np.clip(at - s, 0, len(part))), width, gram)
            parts.append((lo + s, hi + s, place + s, grams, content))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    if n < width:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    hashes = SpanHash(codes)
    place = np.arange(n - gram + 1)
    low = np.uint64((1 << 26) - 1)
    least = (hashes.of(place, place + gram) & ~low) | place.astype(np.uint64)
    choices, have = width - gram + 1, 1
    while have * 2 <= choices:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    count = n - width + 1
    chosen = (np.minimum(least[:count], least[choices - have : choices - have + count]) & low).astype(np.int64)
    inside = np.zeros(n + 1, np.int32)
    length = np.diff(at)
    np.add.at(inside, at[:-1][length >= width], 1)
    np.add.at(inside, at[1:][length >= width] - width + 1, -1)
    start = np.flatnonzero(np.cumsum(inside[:count]) > 0)
    if not len(start):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    chosen = chosen[start]
    edge = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (start[1:] != start[:-1] + 1)])
    lo, hi, at_gram = start[edge], start[np.r_[edge[1:], len(start)] - 1], chosen[edge]
    content = hashes.of(lo, hi + width) ^ mix64((at_gram - lo).astype(np.uint64) + (hi - lo).astype(np.uint64) * np.uint64(1 << 20))
    return lo, hi, at_gram, hashes.of(at_gram, at_gram + gram), content


def merge(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of intervals per owner; touching ones become one."""
    if not len(owner):
        return owner, start, end
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    new_owner = np.r_[True, owner[1:] != owner[:-1]]
    # A running maximum per owner: shift every owner above all ends of the one before.
    rank = np.cumsum(new_owner) - 1
    high = np.int64(end.max() + 1)
    reach = np.maximum.accumulate(end + rank * high) - rank * high
    edge = np.flatnonzero(np.r_[True, new_owner[1:] | (start[1:] > reach[:-1])])
    return owner[edge], start[edge], reach[np.r_[edge[1:], len(owner)] - 1]


def first_of(groups: list[np.ndarray], key: np.ndarray, start: np.ndarray) -> np.ndarray:
    """True where (key, start) is the least of its group; the least itself may be there more than once."""
    n = len(key)
    order = np.lexsort((start, key, *groups))
    new = np.zeros(n, bool)
    new[:1] = True
    for g in groups:
        s = g[order]
        new[1:] |= s[1:] != s[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    same = (key[order] == key[order][head]) & (start[order] == start[order][head])
    out = np.empty(n, bool)
    out[order] = same
    return out


def numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``doc`` (a number that orders the documents), ``key`` and ``text`` of every row.

    A whole number that names one text only is its own number; else documents are sorted and counted.
    """
    hashed = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"))
    if isinstance(docs.schema[key].dataType, IntegralType):
        names = hashed.groupBy("key").agg(F.min("hash").alias("a"), F.max("hash").alias("b"))
        if names.filter("a <> b").isEmpty():
            return hashed.select(F.coalesce(F.col("key").cast("long"), F.lit(NULL_KEY)).alias("doc"), "key", "text")
    order = hashed.select("key", "hash").distinct().orderBy(F.col("key").asc_nulls_first(), "hash")
    order = stored(order.select("key", "hash", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")))
    # One row per task says how many documents the tasks before it have.
    sizes = {r.part: r.n for r in order.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before, total = {}, 0
    for part in sorted(sizes):
        before[part], total = total, total + sizes[part]
    starts = docs.sparkSession.createDataFrame(list(before.items()), "part int, start bigint")
    numbers = order.join(F.broadcast(starts), "part").select(F.col("key").alias("_key"), F.col("hash").alias("_hash"), (F.col("start") + F.col("at")).alias("doc"))
    return hashed.join(numbers, F.col("key").eqNullSafe(F.col("_key")) & (F.col("hash") == F.col("_hash"))).select("doc", "key", "text")


def _spans(rows: DataFrame, encode: Encode, width: int, gram: int) -> DataFrame:
    """``gram``, ``content``, ``doc``, ``lo``, ``shape`` (windows but one, and the gram's place), ``kind``: 0 or 1 where the span is the first or second of its kind in a task, else 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", PART):
            codes, at = encode(*text_bytes(part.column("text")))
            lo, hi, place, grams, content = spans_of(codes, at, width, gram)
            if not len(lo):
                continue
            of = np.searchsorted(at, lo, "right") - 1
            doc = part.column("doc").to_numpy()[of]
            shape = (hi - lo) << 20 | (place - lo)
            order = np.lexsort((lo, doc, content, grams))
            new = np.r_[True, (grams[order][1:] != grams[order][:-1]) | (content[order][1:] != content[order][:-1])]
            turn = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            columns = (grams.view(np.int64), content.view(np.int64), doc, lo - at[of], shape)
            yield pa.RecordBatch.from_arrays([*(pa.array(c[order]) for c in columns), pa.array(np.minimum(turn, 2).astype(np.int8))], ["gram", "content", "doc", "lo", "shape", "kind"])

    return rows.select("doc", "text").mapInArrow(run, "gram bigint, content bigint, doc bigint, lo bigint, shape bigint, kind tinyint")


def _marks(spans: DataFrame) -> DataFrame:
    """The spans that may repeat, with ``turn``: 1 is the first of its kind under a gram with several kinds, 2 the second of its kind with the first one's ``doc0`` and ``lo0``, 3 a later one."""
    # A passage in a third of all documents sends two rows per part of a task to its gram's place; the others are spread.
    dealt = spans.withColumn("salt", F.when(F.col("kind") == 2, F.col("doc")).otherwise(F.lit(0))).repartition("gram", "salt")
    alike, by_gram = Window.partitionBy("gram", "salt", "content").orderBy("doc", "lo"), Window.partitionBy("gram", "salt")
    seen = dealt.select(
        "*", F.row_number().over(alike).alias("n"), F.first("doc").over(alike).alias("doc0"), F.first("lo").over(alike).alias("lo0"),
        F.min("content").over(by_gram).alias("a"), F.max("content").over(by_gram).alias("b"),
    )
    turn = F.when(F.col("kind") == 2, 3).otherwise(F.least("n", F.lit(3)))
    return stored(seen.withColumn("turn", turn).filter("turn > 1 or a <> b").select("gram", "content", "doc", "lo", "shape", "turn", "doc0", "lo0"))


def _stretches(marks: DataFrame) -> DataFrame:
    """Seconds of their kind with the ``start`` of the stretch they belong to: ``gram``, ``content``, ``doc``, ``start``, ``hi``, ``doc0``, ``off`` (start here less start there)."""
    by_doc = Window.partitionBy("doc").orderBy("lo")
    rows = marks.filter("turn = 2").select("gram", "content", "doc", "lo", (F.col("lo") + F.shiftright("shape", 20)).alias("hi"), "doc0", (F.col("lo") - F.col("lo0")).alias("off"))
    here = lambda c: F.lag(c).over(by_doc)
    on = (here("hi") + 1 == F.col("lo")) & (here("doc0") == F.col("doc0")) & (here("off") == F.col("off")) & (F.floor(here("lo") / STRETCH) == F.floor(F.col("lo") / STRETCH))
    begins = rows.withColumn("start", F.when(~F.coalesce(on, F.lit(False)), F.col("lo")))
    return stored(begins.withColumn("start", F.max("start").over(by_doc)).drop("lo"))


CONTENTS = "gram bigint, pair boolean, second boolean, doc bigint, lo bigint, hi bigint, place bigint, left int, right int, content binary"
_NAMES = [c.split()[0] for c in CONTENTS.split(", ")]


def _contents(texts: DataFrame, asked: DataFrame, width: int, pick) -> DataFrame:
    """The spans to be compared, with their content: of an element a fixed number of bytes in ``content``."""
    by_doc = asked.groupBy("doc").agg(F.collect_list(F.struct("gram", "pair", "second", "lo", "hi", "place")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", PART):
            docs, lists = part.column("doc").to_pylist(), part.column("asked")
            data, at = text_bytes(part.column("text"))
            for k in range(part.num_rows):
                struct = lists[k].values
                g, pair, second, lo, hi, place = (struct.field(x) for x in ("gram", "pair", "second", "lo", "hi", "place"))
                none = pa.array(np.zeros(len(g), np.int32))
                content = pa.array(pick(data[at[k] : at[k + 1]], lo.to_numpy(), hi.to_numpy() + width), pa.binary())
                yield pa.RecordBatch.from_arrays([g, pair, second, pa.array(np.full(len(g), docs[k])), lo, hi, place, none, none, content], _NAMES)

    return texts.join(by_doc, "doc").select("doc", "text", "asked").mapInArrow(run, CONTENTS)


def halves(rows: list[dict], width: int, gram: int, unit: int) -> list[dict]:
    """Spans of one split gram cut in two: windows with more to the left of what is fixed, and the others.

    ``left`` and ``right`` say how far beyond the gram all windows under a hash are known to agree.
    """
    out = []
    for r in rows:
        free = width - gram - r["left"] - r["right"]
        if not free:
            out.append(r)
            continue
        half = (free + 1) // 2
        begin, end = r["place"] - r["left"], r["place"] + gram + r["right"]
        for side, lo, hi, a, b in (("left", r["lo"], min(r["hi"], begin - half), begin - half, begin), ("right", max(r["lo"], begin - half + 1), r["hi"], end, end + half)):
            if lo > hi:
                continue
            beside = r["content"][(a - r["lo"]) * unit : (b - r["lo"]) * unit]
            name = xxhash.xxh64_intdigest(f"{r['gram']} {side} ".encode() + beside) - (1 << 63)
            out.append({**r, "gram": name, "lo": lo, "hi": hi, side: r[side] + half, "content": r["content"][(lo - r["lo"]) * unit : (hi + width - r["lo"]) * unit]})
    return out


def _split(contents: DataFrame, width: int, gram: int, unit: int) -> DataFrame:
    """The contents, with grams that have more than ``HOT`` surroundings split as far as needed."""
    free = ~F.col("pair") & (F.col("left") + F.col("right") < width - gram)
    done = None
    while True:
        hot = contents.filter(free).groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("gram")
        hot = stored_small(hot, BROADCAST_GRAMS)
        if hot.isEmpty():
            return contents if done is None else done.unionByName(contents)
        calm = contents.join(hot, "gram", "left_anti")
        done = calm if done is None else done.unionByName(calm)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 2000):
                    yield pa.RecordBatch.from_pylist(halves(batch.slice(lo, 2000).to_pylist(), width, gram, unit), batch.schema)

        contents = stored(contents.join(hot, "gram", "left_semi").select(*_NAMES).mapInArrow(run, CONTENTS))


#: What ``settle`` returns: repeats (doc, lo, hi), and per pair of stretches that agree the place of the second one (doc0, lo0; doc null).
SETTLED = "doc bigint, lo bigint, hi bigint, doc0 bigint, lo0 bigint"


def settled_batch(owner: np.ndarray, start: np.ndarray, end: np.ndarray, agreed: list[tuple[int, int]]) -> pa.RecordBatch:
    n, m = len(owner), len(agreed)
    d, s = (list(x) for x in zip(*agreed, strict=True)) if m else ([], [])
    first = [pa.concat_arrays([pa.array(x, pa.int64()), pa.nulls(m, pa.int64())]) for x in (owner, start, end)]
    last = [pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(x, pa.int64())]) for x in (d, s)]
    return pa.RecordBatch.from_arrays([*first, *last], ["doc", "lo", "hi", "doc0", "lo0"])


def repeats(docs: DataFrame, key: str, text: str, width: int, gram: int, unit: int, encode: Encode, pick: Callable[[np.ndarray, np.ndarray, np.ndarray], list[bytes]], settle: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Every document once more, with what repeats in it: ``key``, ``text``, ``spans`` (array of lo, hi; null if none).

    ``pick`` cuts the content of spans (first and last element) out of one text, ``unit`` bytes for an
    element; ``settle`` gets rows of ``CONTENTS`` in the order of gram, doc and lo, all of a gram in one
    stream (a pair of stretches has a gram of its own), and returns ``SETTLED``.
    """
    rows = numbered(docs, key, text)
    marks = _marks(_spans(rows, encode, width, gram))
    texts = rows.repartition("doc")
    seconds = _stretches(marks)
    firsts = marks.filter("turn = 1").select("gram", F.lit(False).alias("pair"), F.lit(False).alias("second"), "doc", "lo", (F.col("lo") + F.shiftright("shape", 20)).alias("hi"), (F.col("lo") + F.col("shape").bitwiseAND(F.lit((1 << 20) - 1))).alias("place"))
    pairs = seconds.groupBy("doc", "start").agg(F.max("hi").alias("hi"), F.first("doc0").alias("doc0"), F.first("off").alias("off"))
    name, back = F.xxhash64("doc", "start").alias("gram"), lambda c: F.col(c) - F.col("off")
    here = pairs.select(name, F.lit(True).alias("pair"), F.lit(True).alias("second"), "doc", F.col("start").alias("lo"), "hi", F.col("start").alias("place"))
    there = pairs.select(name, F.lit(True).alias("pair"), F.lit(False).alias("second"), F.col("doc0").alias("doc"), back("start").alias("lo"), back("hi").alias("hi"), back("start").alias("place"))
    contents = _contents(texts, firsts.unionByName(here).unionByName(there), width, pick)
    # Only a gram with many spans can be hot; most tables have none, and then contents are made once.
    counts = marks.filter("turn = 1").groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") > HOT)
    if not counts.isEmpty():
        contents = _split(stored(contents), width, gram, unit)
    settled = stored(contents.repartition("gram").sortWithinPartitions("gram", "doc", "lo").mapInArrow(settle, SETTLED))
    agreed = settled.filter("doc is null").select(F.col("doc0").alias("doc"), F.col("lo0").alias("start"))
    equal = stored_small(seconds.join(agreed, ["doc", "start"]).select("gram", "content"), BROADCAST_GRAMS)
    later = marks.filter("turn = 3").join(equal, ["gram", "content"]).select("doc", "lo", (F.col("lo") + F.shiftright("shape", 20) + width).alias("hi"))
    found = later.unionByName(settled.filter("doc is not null").select("doc", "lo", "hi")).groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    return texts.join(found, "doc", "left").select("key", "text", "spans")


def removed(spans: pa.Scalar, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal removed runs of one document."""
    if not spans.is_valid:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    lo, hi = (spans.values.field(c).to_numpy() for c in ("lo", "hi"))
    hi = np.minimum(hi, length)
    _, start, end = merge(np.zeros(len(lo), np.int64)[lo < hi], lo[lo < hi], hi[lo < hi])
    return start, end
