"""Runs of words that repeat with a period, by longest common extensions over a difference cover.

The words of a batch of texts become numbers.  ``Extensions`` answers how many words two places
have in common: only suffixes that begin in a difference cover (``COVER`` modulo ``MODULUS``) are
sorted, first by their next ``MODULUS`` words, then by doubling, where only suffixes that still
agree are sorted again; the common prefixes of neighbours in that order go into a sparse table of
minima.  Two places reach sampled places after the same few words, as every difference modulo
``MODULUS`` is one of the cover; those words are compared, and the table tells the rest.

For every period q the places 2q apart (a harmonic grid: n/2 + n/4 + n/6 ... of them) are compared
with the places q further.  A run of at least four periods holds such a place with q words to go,
and the extension says where the run ends; the least place with that end is moved back by bisection,
again by extensions, to where the run begins.  Of the same stretch the least period is kept.

Per row: the words' number, all runs (start, length, period; by start, then period), and the words
left when each run is collapsed to its first period.  A run is a stretch with smallest period q, of
``max(MIN_WORDS, MIN_PERIODS * q)`` words or more, which no neighbouring word extends.

A text is worked on by one task as a whole, which takes about 500 bytes of memory a word; shorter texts
share a batch.  Nothing is shuffled.  Defined results: a null text, like an empty one or one of white
space, has no words, no runs and the collapsed text ''; rows without an id and repeated rows are worked
on like any other; very long words are words; an empty table gives an empty result; of the other
input columns those asked for are returned, unless their name is that of a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from podspark.llm.arrow_text import slices, text_bytes, word_bounds

MODULUS = 13
#: Every number modulo 13 is a difference of two of these.
COVER = (0, 1, 3, 9)
MIN_WORDS = 6
MIN_PERIODS = 4
BATCH_BYTES = 2 << 20
#: Pairs of places that are compared at once.
PAIRS = 1 << 20
RUN = StructType([StructField(name, LongType()) for name in ("start", "length", "period")])


def _shifts() -> np.ndarray:
    """For each pair of residues, the fewest words after which both are in the cover."""
    held = np.isin(np.arange(2 * MODULUS) % MODULUS, COVER)
    return np.array([[next(d for d in range(MODULUS) if held[a + d] and held[b + d]) for b in range(MODULUS)] for a in range(MODULUS)])


SHIFT = _shifts()


class Extensions:
    """Longest common extensions of places in a sequence of small numbers, to the right.

    ``words`` must end in a number that occurs nowhere else, or places be compared only within stretches
    that end so.
    """

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.words = np.concatenate([words.astype(np.int64), np.full(2 * MODULUS, -1, np.int64)])
        places = np.arange(n)
        self.places = places[np.isin(places % MODULUS, COVER)]
        self.number = np.full(n + 2 * MODULUS, -1, np.int64)
        self.number[self.places] = np.arange(len(self.places))
        self._sort(n)
        self._minima()

    def _sort(self, n: int) -> None:
        """Ranks of the sampled suffixes after 1, 2, 4 ... times MODULUS words, and their order."""
        at, m = self.places, len(self.places)
        bits = max(1, int(self.words.max(initial=0) + 2).bit_length())
        per = max(1, 62 // bits)
        keys = []
        for lo in range(0, MODULUS, per):
            key = np.zeros(m, np.int64)
            for k in range(lo, min(lo + per, MODULUS)):
                key = key << bits | self.words[at + k] + 1
            keys.append(key)
        order = np.lexsort(keys[::-1])
        rank = self._ranks(order, [k[order] for k in keys])
        self.levels = [rank]
        step = MODULUS
        while True:
            # Suffixes that share their rank are sorted by the rank of what follows; all others are settled.
            counts = np.bincount(rank, minlength=m)
            open_ = order[counts[rank[order]] > 1]
            if not len(open_) or step > n:
                break
            follow = self._rank_at(rank, at[open_] + step)
            again = np.lexsort((follow, rank[open_]))
            spots = np.flatnonzero(counts[rank[order]] > 1)
            open_, follow = open_[again], follow[again]
            order[spots] = open_
            new = rank.copy()
            fresh = np.ones(len(open_), bool)
            fresh[1:] = (rank[open_][1:] != rank[open_][:-1]) | (follow[1:] != follow[:-1])
            new[open_] = np.maximum.accumulate(np.where(fresh, spots, 0))
            rank = new
            self.levels.append(rank)
            step *= 2
        self.order = order
        self.rank = np.empty(m, np.int64)
        self.rank[order] = np.arange(m)

    @staticmethod
    def _ranks(order: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
        """The place in the order of the first of all that are equal."""
        fresh = np.ones(len(order), bool)
        fresh[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
        return rank

    def _rank_at(self, rank: np.ndarray, places: np.ndarray) -> np.ndarray:
        number = self.number[np.minimum(places, len(self.number) - 1)]
        return np.where(number < 0, -1, rank[number])

    def _plain(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words in common from ``a`` and ``b``, compared one after the other, ``most`` of them at most."""
        found = np.zeros(len(a), np.int64)
        going = np.flatnonzero(most > 0)
        for k in range(int(most.max(initial=0))):
            going = going[(most[going] > k)]
            going = going[self.words[a[going] + k] == self.words[b[going] + k]]
            if not len(going):
                break
            found[going] += 1
        return found

    def _minima(self) -> None:
        """Common prefixes of neighbours in the order, and minima of 1, 2, 4 ... of them."""
        a, b = self.places[self.order[:-1]], self.places[self.order[1:]]
        common = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            x, y = self._rank_at(self.levels[k], a + common), self._rank_at(self.levels[k], b + common)
            common += np.where((x >= 0) & (x == y), MODULUS << k, 0)
        common += self._plain(a + common, b + common, np.full(len(a), MODULUS))
        del self.levels
        self.table = [common]
        while 2 << len(self.table) - 1 <= len(common):
            last, half = self.table[-1], 1 << len(self.table) - 1
            self.table.append(np.minimum(last[:-half], last[half:]))

    def _sampled(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common words of sampled places that differ."""
        x, y = self.rank[self.number[a]], self.rank[self.number[b]]
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level).tolist():
            mine = np.flatnonzero(level == k)
            row = self.table[k]
            out[mine] = np.minimum(row[lo[mine]], row[hi[mine] - (1 << k)])
        return out

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal words from ``a`` and from ``b`` on, which differ."""
        shift = SHIFT[a % MODULUS, b % MODULUS]
        found = self._plain(a, b, shift)
        far = np.flatnonzero(found == shift)
        x, y = a[far] + shift[far], b[far] + shift[far]
        inside = (self.number[x] >= 0) & (self.number[y] >= 0)
        found[far[inside]] += self._sampled(x[inside], y[inside])
        return found


def find_runs(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start, length and period of every run; ``bounds`` are n + 1 offsets of texts in ``words``, numbers from 0."""
    sizes = np.diff(bounds)
    # Each text is followed by a number of its own, so that nothing extends beyond it.
    texts = len(sizes)
    place = np.arange(len(words)) + np.repeat(np.arange(texts), sizes)
    ids = np.empty(len(words) + texts, np.int64)
    ids[place] = words
    starts = bounds[:-1] + np.arange(texts)
    ends = starts + sizes
    ids[ends] = int(words.max(initial=-1)) + 1 + np.arange(texts)
    longest = int(sizes.max(initial=0)) // MIN_PERIODS
    if int(sizes.max(initial=0)) < MIN_WORDS:
        return (np.empty(0, np.int64),) * 4
    near = Extensions(ids)
    out: list[np.ndarray] = []
    waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0

    def close() -> None:
        text, at, period = (np.concatenate(x) for x in zip(*waiting, strict=True))
        ahead = near.of(at, at + period)
        good = ahead >= period
        text, at, period, ahead = text[good], at[good], period[good], ahead[good]
        # The least place of each period and end: what comes before it is less than two periods long.
        first = np.lexsort((at, at + ahead, period))
        same = np.zeros(len(first), bool)
        same[1:] = (period[first][1:] == period[first][:-1]) & ((at + ahead)[first][1:] == (at + ahead)[first][:-1])
        first = first[~same]
        text, at, period, ahead = text[first], at[first], period[first], ahead[first]
        lo, hi = np.zeros(len(at), np.int64), np.minimum(at - starts[text], 2 * period - 1)
        while (lo < hi).any():
            half = (lo + hi + 1) // 2
            back = near.of(at - half, at - half + period) >= half
            lo, hi = np.where(back, half, lo), np.where(back, hi, half - 1)
        length = lo + ahead + period
        long = length >= np.maximum(MIN_WORDS, MIN_PERIODS * period)
        out.append(np.stack([text, at - lo, length, period])[:, long])
        waiting.clear()

    order = np.argsort(-sizes, kind="stable")
    upto = -sizes[order]
    q = 1
    while q <= longest:
        # Texts long enough for this period; a few periods are taken together as the places become few.
        some = order[: int(np.searchsorted(upto, -max(MIN_WORDS, MIN_PERIODS * q), "right"))]
        few = int((sizes[some] // (2 * q)).sum())
        periods = np.arange(q, min(longest, q + PAIRS // 16 // max(few, 1)) + 1)
        q = int(periods[-1]) + 1
        # In each, the places 2q apart that can have q words to go.
        counts = np.where(sizes[some][:, None] >= np.maximum(MIN_WORDS, MIN_PERIODS * periods), sizes[some][:, None] // (2 * periods), 0).ravel()
        text, period = np.repeat(np.repeat(some, len(periods)), counts), np.repeat(np.tile(periods, len(some)), counts)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = starts[text] + 2 * period * nth
        alike = ids[at] == ids[at + period]
        text, at, period = text[alike], at[alike], period[alike]
        alike = ids[at + period - 1] == ids[at + 2 * period - 1]
        if alike.any():
            waiting.append((text[alike], at[alike], period[alike]))
            held += len(waiting[-1][0])
            if held >= PAIRS:
                close()
                held = 0
    if waiting:
        close()
    if not out:
        return (np.empty(0, np.int64),) * 4
    text, start, length, period = np.concatenate(out, axis=1)
    order = np.lexsort((period, length, start, text))
    text, start, length, period = text[order], start[order], length[order], period[order]
    repeat = np.zeros(len(text), bool)
    repeat[1:] = (text[1:] == text[:-1]) & (start[1:] == start[:-1]) & (length[1:] == length[:-1])
    text, start, length, period = text[~repeat], start[~repeat], length[~repeat], period[~repeat]
    order = np.lexsort((period, start, text))
    return text[order], start[order] - starts[text[order]], length[order], period[order]


def _numbered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each word, equal for equal words, and the words' bytes end to end with their n + 1 offsets."""
    sizes = end - start
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    solid = data[np.repeat(start - offsets[:-1], sizes) + np.arange(offsets[-1])]
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(solid)])
    return np.asarray(words.dictionary_encode().indices, np.int64), solid, offsets


def _collapsed(solid: np.ndarray, offsets: np.ndarray, bounds: np.ndarray, keep: np.ndarray) -> pa.Array:
    """The kept words of each text joined by one space."""
    sizes = np.diff(offsets)[keep] + 1
    kept = np.concatenate([[0], np.cumsum(keep)])[bounds]
    at = np.concatenate([[0], np.cumsum(sizes)])
    joined = np.full(int(at[-1]), 0x20, np.uint8)
    solid_at = np.ones(len(joined), bool)
    solid_at[at[1:] - 1] = False
    joined[solid_at] = solid[np.repeat(keep, np.diff(offsets))]
    raw = joined.tobytes()
    lo, hi = at[kept[:-1]].tolist(), at[kept[1:]].tolist()
    return pa.array([raw[a : b - 1].decode("utf-8", "surrogatepass") if b > a else "" for a, b in zip(lo, hi, strict=True)], pa.string())


def periodic_runs(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: the columns of ``keep``, n_words, runs, collapsed."""
    results = ("n_words", "runs", "collapsed")
    kept = [c for c in keep if c.lower() not in results]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text", BATCH_BYTES):
            data, at = text_bytes(part.column("_text"))
            start, end, bounds = word_bounds(data, at)
            ids, solid, offsets = _numbered(data, start, end)
            owner, first, length, period = find_runs(ids, bounds)
            # Words after the first period of a run are covered.
            edges = np.zeros(len(ids) + 1, np.int64)
            np.add.at(edges, bounds[owner] + first + period, 1)
            np.add.at(edges, bounds[owner] + first + length, -1)
            left = np.cumsum(edges)[:-1] == 0
            lists = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(owner, np.arange(part.num_rows + 1)), pa.int32()),
                pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in (first, length, period)], ["start", "length", "period"]),
            )
            columns = [*(part.column(k) for k in range(len(kept))), pa.array(np.diff(bounds), pa.int64()), lists, _collapsed(solid, offsets, bounds, left)]
            yield pa.RecordBatch.from_arrays(columns, [*(f"k{k}" for k in range(len(kept))), *results])

    rows = docs.select(*(F.col(f"`{c}`").alias(f"k{k}") for k, c in enumerate(kept)), F.col(f"`{text}`").alias("_text"))
    schema = rows.drop("_text").schema.add("n_words", "long").add("runs", ArrayType(RUN)).add("collapsed", "string")
    found = rows.mapInArrow(run, schema)
    return found.select(*(F.col(f"k{k}").alias(c) for k, c in enumerate(kept)), *results)


def strongest(runs: F.Column) -> F.Column:
    """The run with the greatest exact length / period; of equals the first by start, then period."""
    none = F.lit(None).cast(RUN)
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))
