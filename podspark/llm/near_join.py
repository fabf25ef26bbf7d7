"""Jaccard similarity join over word shingles with PartEnum signatures, and its connected components.

Two sets of a and b shingles reach the threshold t only if they differ in at most
(1 - t) / (1 + t) * (a + b) shingles.  Sizes are cut into bands; for the larger set's band that
bound is a number k.  The shingle domain is hashed into n partitions of m parts each; two similar sets
differ in few enough shingles that in at least one partition at most j parts differ, so for every choice
of m - j parts of a partition there is a signature, and the two sets share one.  A set signs for its own band, and
for the next one if a partner there can be similar.  For each band (n, m, j) is the cheapest choice with which
hardly any set has a signature of no shingles; where n is large, two more partitions than needed let
every set leave out one partition in which it has such a signature.

Sets are classes of equal shingle sets, so copies never meet, and of the signatures that just the same classes
share one stays.  Classes that share a signature are compared with its centre, the class that shares most
signatures overall, and with the next one; links join components, and only members of different components go on, so a large group
of near copies costs about one comparison per member.  What is left of a signature is compared in one task if it has at most
``BLOCK`` members; if all but so many are in one component already, the others are compared with parts of that one.
Of what is larger still, members leave whose own shingles, which no other has, rule out every partner, and two sets with
many of their own are not compared (``with_partners``).  If at most ``BLOCK`` members with few of their own are left, the
others are compared with these.  The rest signs again, with the domain hashed in another way: two similar
classes share a signature then as well, while those that had met by chance are dealt out anew.  Only what
is still too large after ``LEVELS`` such turns is compared block by block.

Before texts are compared, sketches are: the parities of the shingles' hash counts.  Sets that differ in d
shingles differ in at most d parities, so a pair beyond the bound is none; the others are verified exactly.
This holds for folded sketches as well: rows that meet carry a short one (``coarse``, or ``clear`` where all members of
a signature meet), and the long ones are read for the few pairs that it allows.

Which texts, sketches or classes a step needs is told by a filter of bounded size (``common.held``), not by a broadcast of
their keys: the driver holds a few bytes a key and some MB at most.  What passes it wrongly is dropped by a join, or
takes part without changing the result.

Defined results: null, empty and wordless texts have size 0, no links and their own component; fewer words
than a shingle has make one shingle; every row counts by its own text, so rows with the same key and different
texts link as their texts do; a component is named after its least key that is not null, one of null keys alone
by null; keys may be of any type that can be ordered; an empty table gives an empty result; texts of any length
are read whole; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from podspark.llm.arrow_text import LOWER, SpanHash, byte_codes, mix64, slices, text_bytes, word_bounds
from podspark.llm.common import held, key_filter, stored

WORDS = 4
PERCENT = 85
#: Bands of set sizes: each reaches to this multiple of its start.
RATIO = 1.4
#: Signatures that a set of a low band may have, and how many of them may hold no shingle, on average.
MOST_SIGNATURES = 64
MOST_EMPTY = 0.01
#: Rounds with one centre per signature in a turn, members of a signature compared in one task, and turns of new signatures.
ROUNDS = 2
BLOCK = 256
LEVELS = 6
#: Of the shingles of a large signature's members one in so many is counted first.
FIRST = 4
#: Texts that have to be compared are picked by a broadcast of their keys only up to this number, else by a filter of them.
BROADCAST_KEYS = 20_000
#: Partners of one class that are compared with it in one task.
PARTNERS = 512
#: Rows of the small tables (members, pairs, components) that a task writes.
ROWS = 50_000
#: Bytes of text that a task works on at a time, and of a sketch at most.
PART = 1 << 20
SKETCH = 2048
#: Bytes of a sketch that are kept where many are compared in one task.
CLEAR = 64


def shingles(data: np.ndarray, at: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted within it, and offsets per text."""
    low = LOWER[data]
    start, end, index = word_bounds(low, at)
    if not len(start):
        return np.empty(0, np.uint64), np.zeros(len(at), np.int64)
    hashes = SpanHash(byte_codes(11)[low]).of(start, end)
    count = np.diff(index)
    number = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    first = np.repeat(index[:-1], number) + np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number)
    size = np.repeat(np.minimum(count, words), number)
    every = SpanHash(hashes).of(first, first + size) ^ mix64(size.astype(np.uint64))
    text = np.repeat(np.arange(len(count)), number)
    order = np.lexsort((every, text))
    every, text = every[order], text[order]
    new = np.ones(len(every), bool)
    new[1:] = (every[1:] != every[:-1]) | (text[1:] != text[:-1])
    return every[new], np.searchsorted(text[new], np.arange(len(count) + 1))


@lru_cache(maxsize=8)
def bands(ratio: float = RATIO, upto: int = 1 << 40) -> np.ndarray:
    """Starts of the size bands."""
    out = [1]
    while out[-1] < upto:
        out.append(max(out[-1] + 1, int(out[-1] * ratio)))
    return np.array(out)


@lru_cache(maxsize=8)
def plans(percent: int = PERCENT, ratio: float = RATIO) -> tuple[tuple[int, int, int, int], ...]:
    """For each band (but the last) the partitions, parts, parts left out, and partitions a set may leave out.

    No partitions where only equal sets can be similar.
    """
    start = bands(ratio)
    out = []
    for low, high in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
        most = 2 * (high - 1) * (100 - percent) // (100 + percent)
        least = -(-low * percent // 100)  # the smallest set that signs for this band
        if not most:
            out.append((0, 3, 1, 0))
            continue
        need = (most + 2) // 2
        if need >= 6:
            out.append((need + 2, 3, 1, 1))
            continue
        ways = []
        for j in range(5):
            n = -(-(most + 1) // (j + 1))
            for m in range(j + 1, j + 6):
                empty = (1 - (m - j) / (n * m)) ** least
                if n * comb(m, j) <= MOST_SIGNATURES:
                    many = n * comb(m, j) * empty > MOST_EMPTY
                    ways.append((many, empty if many else 0.0, n * comb(m, j), n, m, j))
        out.append((*min(ways)[3:], 0))
    return tuple(out)


def _signatures_of(plan: tuple[int, int, int, int], salt: np.ndarray, items: np.ndarray, of: np.ndarray, n_sets: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets (``items``, each in set ``of``) under one plan."""
    n, m, j, may_leave = plan
    place = mix64(items ^ salt)
    part = ((place >> np.uint64(20)) % np.uint64(n)).astype(np.int64)
    cell = (of * n + part) * m + ((place & np.uint64(0xFFFFF)) % np.uint64(m)).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    edge = np.flatnonzero(np.r_[True, np.diff(cell[order]) != 0])
    total, full = np.zeros(n_sets * n * m, np.uint64), np.zeros(n_sets * n * m, bool)
    total[cell[order][edge]] = np.add.reduceat(mix64(place + np.uint64(1))[order], edge)
    full[cell] = True
    total, full = total.reshape(-1, m), full.reshape(-1, m)
    row_set, row_part = np.repeat(np.arange(n_sets), n), np.tile(np.arange(n), n_sets)
    choices = list(combinations(range(m), m - j))
    keep = np.ones(len(row_set), bool)
    if may_leave:
        # The first partition with an empty signature is left out.
        empty = np.zeros(len(row_set), bool)
        for c in choices:
            empty |= ~full[:, c].any(1)
        e = np.flatnonzero(empty)
        if len(e):
            keep[e[np.r_[True, np.diff(row_set[e]) != 0]]] = False
    name = mix64(salt + row_part.astype(np.uint64) * np.uint64(1000))
    sigs = [mix64(total[keep][:, c].sum(1, dtype=np.uint64) ^ mix64(name[keep] + np.uint64(x))) for x, c in enumerate(choices)]
    return np.concatenate(sigs), np.tile(row_set[keep], len(choices))


def signatures(sets: np.ndarray, at: np.ndarray, percent: int = PERCENT, ratio: float = RATIO, level: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of every set, and the number of the set each belongs to; another ``level`` hashes the domain in another way."""
    size = np.diff(at)
    start, plan = bands(ratio), plans(percent, ratio)
    own = np.searchsorted(start, size, "right") - 1
    out_sig, out_set = [], []
    for following in (0, 1):
        band = own + following
        # A larger partner in the next band has at most size * 100 / percent shingles.
        uses = (size > 0) & (size * 100 >= start[band] * percent if following else True)
        for b in np.unique(band[uses]).tolist():
            if not plan[b][0]:
                continue
            who = np.flatnonzero(uses & (band == b))
            items = np.concatenate([sets[x:y] for x, y in zip(at[who], at[who + 1], strict=True)])
            salt = mix64(np.array([b + 77 + 1_000_003 * level], np.uint64))
            sig, of = _signatures_of(plan[b], salt, items, np.repeat(np.arange(len(who)), size[who]), len(who))
            out_sig.append(sig)
            out_set.append(who[of])
    if not out_sig:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(out_sig), np.concatenate(out_set)


def _names(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One number for each set: equal sets, equal numbers; 0 for an empty set."""
    sums = np.r_[np.uint64(0), np.cumsum(mix64(sets + np.uint64(5)))]
    size = np.diff(at)
    return np.where(size > 0, mix64(sums[at[1:]] - sums[at[:-1]] + size.astype(np.uint64)), np.uint64(0)).view(np.int64)


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"), F.col(text).alias("text"))


def sketches(sets: np.ndarray, at: np.ndarray) -> list[bytes]:
    """A bit for each of about four hash values per shingle: the parity of the shingles that have it."""
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        bits = min(8 * SKETCH, max(64, 1 << (4 * (b - a) - 1).bit_length())) if b > a else 64
        odd = np.bincount((sets[a:b] & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(odd.astype(bool)).tobytes())
    return out


def fold(sketch: bytes, size: int) -> np.ndarray:
    """A sketch folded to ``size`` bytes."""
    x = np.frombuffer(sketch, np.uint8)
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def sketch_distance(x: bytes, y: bytes) -> int:
    """Parities in which two sketches differ; the longer one is folded to the length of the other."""
    size = min(len(x), len(y))
    return int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum())


def coarse(sketch: bytes, n: int) -> bytes:
    """The sketch of a set of ``n`` shingles folded to three bits or more for four of them: enough to tell sets apart that share little."""
    return fold(sketch, max(64, 1 << (-(-3 * n // 4) - 1).bit_length() if n > 1 else 64) // 8).tobytes()


def clear(sketch: bytes, n: int) -> bytes:
    """The sketch folded to no less than ``CLEAR`` bytes: small sets that share two thirds are told apart as well."""
    short = coarse(sketch, n)
    return short if len(short) >= CLEAR else fold(sketch, CLEAR).tobytes()


def classes(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """Per row: ``key``, ``hash`` of the text, ``n_shingles``, ``node`` (its class of equal sets; null for an empty set), ``sketch``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", PART):
            sets, at = shingles(*text_bytes(part.column("text")), words)
            size = np.diff(at)
            columns = [part.column("key"), part.column("hash"), pa.array(size), pa.array(_names(sets, at), mask=size == 0), pa.array(sketches(sets, at), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "hash", "n_shingles", "node", "sketch"])

    schema = rows.select("key", "hash").schema.add("n_shingles", "long").add("node", "long").add("sketch", "binary")
    return rows.mapInArrow(run, schema)


def with_coarse(nodes: DataFrame) -> DataFrame:
    """The classes with their ``coarse`` sketch and their ``clear`` one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            long = list(zip(batch.column("sketch").to_pylist(), batch.column("n").to_pylist(), strict=True))
            folded = [pa.array([f(x, n) for x, n in long], pa.binary()) for f in (coarse, clear)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *folded], [*batch.schema.names, "coarse", "clear"])

    return nodes.mapInArrow(run, StructType([*nodes.schema.fields, StructField("coarse", BinaryType()), StructField("clear", BinaryType())]))


def members(texts: DataFrame, words: int = WORDS, percent: int = PERCENT, level: int = 0) -> DataFrame:
    """Classes that share a signature with others: ``sig``, ``node``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", PART):
            sets, at = shingles(*text_bytes(part.column("text")), words)
            # Of equal sets in a task one signs.
            names = _names(sets, at)
            _, first = np.unique(names, return_index=True)
            size = np.zeros(len(names), np.int64)
            size[first] = np.diff(at)[first]
            keep = np.repeat(size > 0, np.diff(at))
            sig, of = signatures(sets[keep], np.r_[0, np.cumsum(size)], percent, level=level)
            if not len(sig):
                continue
            # Of the classes here that share a signature, the first asks whether others have it; the rest are known to share it.
            order = np.argsort(sig, kind="stable")
            sig, node = sig[order].view(np.int64), names[of[order]]
            new = np.r_[True, np.diff(sig) != 0]
            several = ~new
            several[:-1] |= ~new[1:]
            kind = np.where(new, several.astype(np.int8), np.int8(2))
            for lo in range(0, len(sig), 200_000):
                cut = slice(lo, lo + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(sig[cut]), pa.array(node[cut]), pa.array(kind[cut])], ["sig", "node", "kind"])

    # A hot signature sends one row per part of a task to the place where it is asked about; its other rows are spread.
    signed = texts.select("text").mapInArrow(run, "sig bigint, node bigint, kind tinyint").withColumn("salt", F.when(F.col("kind") == 2, F.col("node")).otherwise(F.lit(0)))
    together = Window.partitionBy("sig", "salt")
    asked = signed.repartition("sig", "salt").withColumns({"lo": F.min("node").over(together), "hi": F.max("node").over(together), "known": F.max("kind").over(together)})
    return asked.filter("lo <> hi or known > 0").select("sig", "node").dropDuplicates()


def groups_of(shared: DataFrame) -> DataFrame:
    """Each set of classes that share a signature once: ``sig``, ``node``, ``times`` (signatures with just these classes), ``m`` (classes).

    Near copies share most of their signatures, so this is a small part of the rows of ``shared``.
    """
    sets = shared.groupBy("sig").agg(F.count("*").alias("m"), F.expr("bit_xor(xxhash64(node))").alias("x"), F.expr("bit_xor(xxhash64(node, 7))").alias("y"))
    kept = sets.groupBy("m", "x", "y").agg(F.min("sig").alias("sig"), F.count("*").alias("times"))
    return shared.join(kept.select("sig", "times", "m"), "sig")


def possible(pairs: DataFrame, nodes: DataFrame, percent: int = PERCENT, sketch: str = "sketch") -> DataFrame:
    """The pairs (a, b) that sizes and sketches allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "s_a", "s_b")), strict=True):
                keep.append((100 + percent) * sketch_distance(x, y) <= (100 - percent) * (n + m))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col(sketch).alias(f"s_{c}"))
    sized = pairs.join(side("b"), "b").join(side("a"), "a").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return sized.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a bigint, b bigint")


def _compare(percent: int):
    """Pairs of one group that sketches allow, between different roots; of two blocks only pairs across them."""

    def compare(table: pa.Table) -> pa.Table:
        node, root, n, block = (table.column(c).to_numpy() for c in ("node", "root", "n", "block"))
        raw = table.column("sketch").to_pylist()
        least = min(map(len, raw))
        bits = np.stack([fold(x, least) for x in raw]).view(np.uint64)
        a, b = [], []
        same = len(set(block.tolist())) == 1
        for k in range(len(node)):
            rest = np.arange(k + 1, len(node)) if same else np.flatnonzero(block > block[k])
            rest = rest[(root[rest] != root[k]) & (100 * np.minimum(n[rest], n[k]) >= percent * np.maximum(n[rest], n[k]))]
            far = np.bitwise_count(bits[rest] ^ bits[k]).sum(1, dtype=np.int64)
            rest = rest[(100 + percent) * far <= (100 - percent) * (n[rest] + n[k])]
            a.append(np.minimum(node[rest], node[k]))
            b.append(np.maximum(node[rest], node[k]))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return compare


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))


def possible_by_sketch(pairs: DataFrame, nodes: DataFrame, percent: int = PERCENT, count: int | None = None) -> DataFrame:
    """Of pairs (``count`` at most) that coarse sketches allow those that the long ones do; hardly more sketches than are asked for are moved."""
    asked = key_filter(_ends(pairs), "node", 2 * (pairs.count() if count is None else count))
    return possible(pairs, held(nodes, "node", asked), percent)


def possible_in_groups(open_: DataFrame, nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) within signatures of at most ``BLOCK`` members and between components that sketches allow."""
    rows = open_.join(nodes.select("node", "n", F.col("clear").alias("sketch")), "node").select("sig", "node", "root", "n", "sketch", F.lit(0).alias("block"))
    return rows.groupBy("sig").applyInArrow(_compare(percent), "a bigint, b bigint").distinct()


def possible_with_major(left: DataFrame, nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The same for larger signatures of which one component has all but at most ``BLOCK`` members.

    ``left`` has the ``major`` component of each signature.  Its members are dealt out to parts, and the others go
    to every part, so there are no more than twice as many rows as members.
    """
    parts = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.array(F.pmod(F.xxhash64("node"), parts).cast("int"))
    dealt = left.select("sig", "node", "root", F.explode(F.when(F.col("root") == F.col("major"), own).otherwise(F.sequence(F.lit(0), parts - 1))).alias("part"))
    rows = dealt.join(nodes.select("node", "n", F.col("clear").alias("sketch")), "node").select("sig", "part", "node", "root", "n", "sketch", F.lit(0).alias("block"))
    return rows.groupBy("sig", "part").applyInArrow(_compare(percent), "a bigint, b bigint").distinct()


def own_shingles(texts: DataFrame, words: int = WORDS, every: int = 1) -> DataFrame:
    """``node`` and ``own``, the number of its shingles that no other class of ``texts`` holds; only classes with such.

    Only shingles whose hash is a multiple of ``every`` are counted, so ``own`` is then less than or equal to the true number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", PART):
            sets, at = shingles(*text_bytes(part.column("text")), words)
            if not len(sets):
                continue
            of, size = part.column("node").to_numpy(), np.diff(at)
            node = np.repeat(of, size)
            # A class that is here more than once counts once.
            once = np.zeros(len(of), bool)
            once[np.unique(of, return_index=True)[1]] = True
            if not once.all():
                once = np.repeat(once, size)
                sets, node = sets[once], node[once]
            if every > 1:
                counted = sets % np.uint64(every) == 0
                sets, node = sets[counted], node[counted]
                if not len(sets):
                    continue
            order = np.argsort(sets, kind="stable")
            edge = np.flatnonzero(np.r_[True, np.diff(sets[order]) != 0])
            # A shingle of several has no node; those of one set stand together, which packs well.
            several = np.diff(np.r_[edge, len(sets)]) > 1
            by_set = np.argsort(order[edge], kind="stable")
            cuts, several = order[edge][by_set], several[by_set]
            for lo in range(0, len(cuts), 200_000):
                cut = cuts[lo : lo + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(sets[cut].view(np.int64)), pa.array(node[cut], mask=several[lo : lo + 200_000])], ["shingle", "node"])

    # A part of a task has a shingle once, so there is little to sum up before rows are dealt out.
    dealt = texts.select("node", "text").mapInArrow(run, "shingle bigint, node bigint").repartition("shingle")
    alone = dealt.groupBy("shingle").agg(F.count_if(F.col("node").isNull()).alias("shared"), F.min("node").alias("node"), F.max("node").alias("last")).filter("shared = 0 and node = last")
    return alone.groupBy("node").agg(F.count("*").alias("own"))


def with_partners(hot: DataFrame, texts: DataFrame, nodes: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The members of large signatures that may have a partner there: ``sig``, ``node``, ``root``, ``low``, ``lows``, ``m``.

    A set of n shingles, u of them its own, shares at most n - u with a set that has v of its own, and together they
    have at least n + v; so 100 * (n - u) >= percent * (n + v) or they are no pair.  A member for which the least v of its
    signature is too many leaves, and so does a signature in which all are. ``low`` are those with few enough of
    their own to be a partner of their like: of two others none is one of the other.  As members leave,
    more shingles are the own ones of who stays, so this goes on while a tenth leaves.  Texts that pass the filter wrongly make fewer
    shingles their members' own, so none leaves for it.  The first time one shingle in
    ``FIRST`` is counted: most members have many more own ones than needed, and fewer than there are let none leave wrongly.
    """
    left, count, every = hot, hot.count(), FIRST
    while True:
        mine = held(texts, "node", key_filter(left, "node", count))
        sized = left.join(nodes.select("node", "n"), "node").join(own_shingles(mine, words, every), "node", "left").withColumn("own", F.coalesce("own", F.lit(0)))
        sized = written(sized.withColumn("low", (100 + percent) * F.col("own") <= (100 - percent) * F.col("n")), count)
        least = sized.groupBy("sig").agg(F.min("own").alias("least"), F.max("low").alias("some")).filter("some").drop("some")
        stay = written(sized.join(least, "sig").filter(100 * (F.col("n") - F.col("own")) >= percent * (F.col("n") + F.col("least"))).select("sig", "node", "root", "low"), count)
        again = _unsettled(stay, F.count("*").alias("m"), F.count_if("low").alias("lows"))
        found = written(stay.join(again.filter("lows > 0"), "sig"), count)
        before, count = count, found.count()
        if not count or every == 1 and count > 0.9 * before:
            return found
        every = 1
        left = found.select("sig", "node", "root")


def possible_in_blocks(left: DataFrame, nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The same for signatures of any size, as ``with_partners`` leaves them.

    Low members are dealt out to blocks, and so are the others; a block of low members meets every block, in one group of
    about twice ``BLOCK``.  Two blocks of others do not meet.
    """
    lows = F.ceil(F.col("lows") / BLOCK).cast("int")
    rest = F.ceil((F.col("m") - F.col("lows")) / BLOCK).cast("int")
    deal = lambda blocks: F.pmod(F.xxhash64("node"), blocks).cast("int")
    dealt = left.withColumn("block", F.when(F.col("low"), deal(lows)).otherwise(lows + deal(rest)))
    others = F.explode(F.sequence(F.lit(0), F.when(F.col("low"), lows + rest).otherwise(lows) - 1)).alias("other")
    met = dealt.select("sig", "node", "root", "block", others).select("sig", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "node", "root", "block")
    rows = met.join(nodes.select("node", "n", F.col("clear").alias("sketch")), "node").select("sig", "x", "y", "block", "node", "root", "n", "sketch")
    return rows.groupBy("sig", "x", "y").applyInArrow(_compare(percent), "a bigint, b bigint").distinct()


def named(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """``node`` and ``text`` of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", PART):
            sets, at = shingles(*text_bytes(part.column("text")), words)
            yield pa.RecordBatch.from_arrays([pa.array(_names(sets, at)), part.column("text")], ["node", "text"])

    return texts.select("text").mapInArrow(run, "node bigint, text string")


def _keys_of(wanted: DataFrame, nodes: DataFrame) -> tuple[DataFrame, int]:
    """Key and hash of the representatives of the nodes in ``wanted``, and their number."""
    keys = stored(wanted.join(nodes, "node").select("node", F.col("rep.key").alias("_key"), F.col("rep.hash").alias("hash"), "rows"))
    return keys, keys.count()


def _texts_of_few(keys: DataFrame, rows: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(keys), "hash").filter(F.col("key").eqNullSafe(F.col("_key"))).select("node", "text", "rows")


def _once(texts: DataFrame, *by: str) -> DataFrame:
    return texts.groupBy(*by).agg(F.first("text").alias("text"))


def texts_of(wanted: DataFrame, rows: DataFrame, nodes: DataFrame, many: bool = False, words: int = WORDS) -> DataFrame:
    """``node`` and the text of its representative, once, for the nodes in ``wanted``.

    With ``many`` the texts of classes of one row are not moved, rows are read twice for that, and if there are more than
    ``BROADCAST_KEYS`` classes some others may be among them, and some twice.
    """
    if not many:
        return with_texts(wanted.select("node"), rows, nodes)
    keys, count = _keys_of(wanted, nodes)
    if count <= BROADCAST_KEYS:
        found = _texts_of_few(keys, rows)
        return found.filter("rows = 1").select("node", "text").unionByName(_once(found.filter("rows > 1"), "node"))
    alone = held(rows, "hash", key_filter(keys.filter("rows = 1"), "hash", count)).select("text")
    several = _once(held(rows, "hash", key_filter(keys.filter("rows > 1"), "hash", count)), "hash").select("text")
    return named(alone.unionByName(several), words)


def with_texts(asked: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``asked`` with the ``text`` of their ``node``; a text is moved once, and hardly one that is not asked for."""
    keys, count = _keys_of(asked.select("node").distinct(), nodes)
    if count <= BROADCAST_KEYS:
        return asked.join(_once(_texts_of_few(keys, rows), "node"), "node")
    picked = _once(held(rows, "hash", key_filter(keys, "hash", count)), "hash", "key").withColumnRenamed("hash", "_hash")
    return asked.join(keys.drop("rows"), "node").join(picked, (F.col("hash") == F.col("_hash")) & F.col("key").eqNullSafe(F.col("_key"))).drop("hash", "_hash", "key", "_key")


def verified(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, words: int = WORDS, percent: int = PERCENT, count: int | None = None) -> DataFrame:
    """The pairs (a, b), ``count`` at most, whose sets reach the threshold, by exact counts over whole texts.

    A class and its partners come together in one stream, first the class itself; the partners of a class
    that has very many are dealt out to several such streams.
    """
    dealt = pairs.select("a", "b", F.lit(0).cast("bigint").alias("part"))
    if count is None or count > PARTNERS:
        many = stored(pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("streams")).filter("streams > 1"))
        if not many.isEmpty():
            dealt = pairs.join(many, "a", "left").select("a", "b", F.coalesce(F.pmod(F.col("b"), F.col("streams")), F.lit(0)).alias("part"))
    heads = dealt.select("a", "part").distinct().select(F.col("a").alias("node"), "a", "part", F.lit(None).cast("bigint").alias("b"))
    both = with_texts(heads.unionByName(dealt.select(F.col("b").alias("node"), "a", "part", "b")), rows, nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.empty(0, np.uint64)
        for part in slices(batches, "text", PART):
            sets, at = shingles(*text_bytes(part.column("text")), words)
            ok = []
            for k, b in enumerate(part.column("b").to_pylist()):
                if b is None:
                    mine = sets[at[k] : at[k + 1]].copy()
                    ok.append(False)
                    continue
                both = len(np.intersect1d(mine, sets[at[k] : at[k + 1]], assume_unique=True))
                ok.append(both > 0 and 100 * both >= percent * (len(mine) + int(at[k + 1] - at[k]) - both))
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).select("a", "b", "text").mapInArrow(run, "a bigint, b bigint")


def written(df: DataFrame, rows: int) -> DataFrame:
    """Stored by as many tasks as its rows, ``rows`` at the most, are worth."""
    return stored(df.coalesce(max(1, -(-rows // ROWS))))


def components(links: DataFrame, count: int | None = None) -> DataFrame:
    """``node`` and ``root`` (the least node reachable) for every node with a link; ``count`` links at most."""
    count = 2 * (links.count() if count is None else count)
    edges = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), count)
    roots = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), count)
    while True:
        near = edges.join(roots, edges.b == roots.node).groupBy("a").agg(F.min("root").alias("near"))
        hooked = roots.join(near, roots.node == near.a).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        # Follow the root's own root, which halves the way that is left.
        jump = hooked.select(F.col("node").alias("at"), F.col("root").alias("next"))
        new = written(hooked.join(jump, hooked.root == jump["at"], "left").select("node", "old", F.least("root", F.coalesce("next", "root")).alias("root")), count)
        roots = new.select("node", "root")
        if new.filter("old <> root").isEmpty():
            return roots


def joined(roots: DataFrame | None, links: DataFrame, count: int) -> DataFrame:
    """The components after more links, ``count`` at most: only what the links join is worked on, by the roots known so far."""
    if roots is None:
        return components(links, count)
    root_of = lambda df, c: df.join(roots.select(F.col("node").alias(c), F.col("root").alias("_root")), c, "left").withColumn(c, F.coalesce("_root", c)).drop("_root")
    moved = components(written(root_of(root_of(links, "a"), "b").filter("a <> b").select("a", "b"), count), count)
    lifted = roots.join(moved.select(F.col("node").alias("root"), F.col("root").alias("_to")), "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
    return written(lifted.unionByName(moved.join(roots, "node", "left_anti")), roots.count() + 2 * count)


def _rooted(members_: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The members with their current ``root``."""
    if roots is None:
        return members_.withColumn("root", F.col("node"))
    return members_.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _unsettled(open_: DataFrame, *more) -> DataFrame:
    """Signatures whose members are in different components, with further aggregates."""
    return open_.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), *more).filter("lo <> hi").drop("lo", "hi")


def similar_classes(rows: DataFrame, nodes: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame | None:
    """``node`` and ``root`` of every class that is joined with another; None if there is none."""
    roots: DataFrame | None = None

    def compare(pairs: DataFrame, count: int) -> None:
        nonlocal roots
        pairs = written(pairs, count)
        if not (met := pairs.count()):
            return
        likely = written(possible_by_sketch(pairs, nodes, percent, met), met)
        if not (met := likely.count()):
            return
        new = stored(verified(likely, rows, nodes, words, percent, met))
        if met := new.count():
            roots = joined(roots, new, met)

    texts, all_texts, count = rows, None, None
    for level in range(LEVELS):
        groups = stored(groups_of(stored(members(texts, words, percent, level))))
        most = groups.count()
        # How much a class shares overall decides who is the centre of a signature.
        weight = groups.groupBy("node").agg(F.sum(F.col("times") * (F.col("m") - 1)).alias("weight")).join(nodes.select("node", "n"), "node")
        open_ = _rooted(groups.select("sig", "node").join(weight, "node"), roots)
        for _ in range(ROUNDS):
            open_ = written(open_, most)
            met = written(open_.join(_unsettled(open_, F.max(F.struct("weight", "node", "root", "n")).alias("centre")), "sig"), most)
            sized = 100 * F.least("centre.n", "n") >= percent * F.greatest("centre.n", "n")
            pairs = met.filter("centre.root <> root").filter(sized).select(F.least("centre.node", "node").alias("a"), F.greatest("centre.node", "node").alias("b")).distinct()
            compare(possible(written(pairs, most), nodes, percent, "coarse"), most)
            # A centre has met all others of its signature.
            open_ = _rooted(met.filter("centre.node <> node").select("sig", "node", "weight", "n"), roots)
        open_ = written(open_, most)
        # Per signature its members, and how many of them the component with most of them has.
        sizes = _unsettled(open_.groupBy("sig", "root").agg(F.count("*").alias("k")), F.sum("k").alias("m"), F.max(F.struct("k", "root")).alias("top"))
        left = written(open_.join(sizes, "sig").select("sig", "node", "root", "m", F.col("top.root").alias("major"), (F.col("m") - F.col("top.k")).alias("others")), most)
        small, mixed = F.col("m") <= BLOCK, F.col("others") <= BLOCK
        n_small, n_mixed, n_hot = left.agg(F.count_if(small), F.count_if(~small & mixed), F.count_if(~small & ~mixed)).first()
        if n_small:
            compare(possible_in_groups(left.filter(small), nodes, percent), most)
        if n_mixed:
            compare(possible_with_major(left.filter(~small & mixed), nodes, percent), most)
        if not n_hot:
            break
        hot = written(_rooted(left.filter(~small & ~mixed).select("sig", "node"), roots), most)
        if all_texts is None:
            all_texts = stored(texts_of(hot.select("node").distinct(), rows, nodes, many=True, words=words))
        hot = with_partners(hot, all_texts, nodes, words, percent)
        again = written(hot.filter(F.col("lows") > BLOCK).select("node").distinct(), most)
        before, count = count, again.count()
        last = level == LEVELS - 1 or before is not None and count > 0.8 * before
        compare(possible_in_blocks(hot if last else hot.filter(F.col("lows") <= BLOCK), nodes, percent), most)
        if last or not count:
            break
        texts = held(all_texts, "node", key_filter(again, "node", count))
    return roots


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row: key, n_shingles, component_id (the least key reachable)."""
    rows = _keyed(docs, key, text)
    own = stored(classes(rows, words))
    # A class has one representative.
    nodes = own.filter("node is not null").groupBy("node").agg(F.min(F.struct("key", "hash", "sketch")).alias("rep"), F.min("key").alias("least"), F.first("n_shingles").alias("n"), F.count("*").alias("rows"))
    nodes = stored(with_coarse(nodes.select("node", F.struct("rep.key", "rep.hash").alias("rep"), "least", "n", "rows", F.col("rep.sketch").alias("sketch"))))
    ids = nodes.select("node", F.col("least").alias("component_id"))
    roots = similar_classes(rows, nodes, words, percent)
    if roots is not None:
        least = roots.join(ids, "node").groupBy("root").agg(F.min("component_id").alias("_least"))
        linked = roots.join(least, "root").select("node", F.lit(True).alias("_linked"), "_least")
        ids = ids.join(linked, "node", "left").select("node", F.when(F.col("_linked"), F.col("_least")).otherwise(F.col("component_id")).alias("component_id"))
    found = own.select("key", "n_shingles", "node").join(ids, "node", "left")
    return found.select(F.col("key").alias(key), "n_shingles", F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id"))
