"""Language-model scores by online logistic context mixing.

A text is scored in lower case (A-Z), as words that are each ended by one symbol: white space or the end
of the text.  A symbol is a few binary events: the steps down a weight-balanced tree over byte values, in
which all ends of a word are one leaf, below which a small tree tells them apart.  Predictors look up every
event under a hash of their context: the last byte and the last three bytes inside the word, the whole word so far,
and for the first two symbols of a word the end of the word before it.
What they have counted over the training texts is turned into log-odds, which shrink where counts are small.  A gate, chosen by
how much the word so far has been seen, holds the weights that add the log-odds up; a final stage scales and
shifts the sum.  Weights and final stage are refined while a text is read: after each block of it
they move against the gradient at their current predictions, so every prediction depends on what came
earlier only, and the bits of a text are those of a proper code.

All counts follow from the words with their numbers of occurrences, a Spark table that grows with the corpus.  For the
whole-word context it is sorted by word and cut into runs: an event's counts are those of a stretch of
sorted words, taken within its run, or, for the few beginnings of words that go beyond one run, from sums over
runs.  So every word, however rare, has exact log-odds of its own.  The short contexts are summed in ``1 << BITS`` slots each.
The most frequent words (at most ``BROADCAST_TOKENS``, with ``BROADCAST_BYTES`` of log-odds) go to all executors with their log-odds; those of all
other words are joined to the texts that hold them.

The few starting weights are fitted on every event of all training texts, each by the log-odds that it has without
itself, as a model has to learn what unseen words are like.  An event's inputs follow from the beginning of its word,
and those of a word's first two symbols from the end of the word before as well, so events are summed up over the
table of words and the counts of such symbols, by inputs rounded to halves, and Newton steps take gradients over these sums.

The base score counts words: counts of all training tokens are summed by 64-bit token hash.

Defined results: a null or empty text has the end token alone; without training texts every count is 0 (the
base score then takes N = V = 0 as given) and the model predicts every event with odds of one; repeated rows are
scored alike and each counts in training; an empty table gives an empty result; texts of any length
are read whole; a row whose ``train`` is null teaches nothing; other input columns are dropped, and may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podspark.llm.arrow_text import LOWER, SPACE, SpanHash, byte_codes, mix64, slices, text_bytes
from podspark.llm.common import stored

BITS = 19
BROADCAST_TOKENS = 1 << 19
#: Bytes of the log-odds that are broadcast.
BROADCAST_BYTES = 96 << 20
#: They pass through the driver in so many parts, one after the other.
BROADCAST_PARTS = 6
#: Sorted words in a run, and bytes of them, of which the last word may have more; coding takes about 800 bytes of memory a byte.
RUN, RUN_BYTES = 50_000, 1 << 18
#: Bytes of text that a task works on at a time, bytes of text between two refinements, and their rates.
PART = 1 << 19
BLOCK = 64
RATE, TAIL_RATE = 2.0, 1.0
ORDERS = (1, 3)
#: Slots for the end of the word before, the context of a word's first symbol, and as many for that and the first byte, the context of its second symbol.
FIRST_BITS = 13
INPUTS = 2 + len(ORDERS)
#: Gates: how often the word so far has been seen, times for how many steps it has had one way to go on only; the last is for events among ends of words.
SEEN = np.array([1, 2, 4, 16])
RUNS = np.array([1, 5, 14])
GATES = (len(SEEN) + 1) * (len(RUNS) + 1) + 1
#: Added to the counts of either outcome.
PRIOR = 0.25
_END, _EMPTY = np.uint64(0x5EED), np.uint64(0xE331)
_ENDS = 1 << 40
#: Above it a pair of slot and class has the word's first byte between them.
_SECOND = 1 << 29
#: A step's code: log-odds in tenths, and above them its gate.
_TENTHS = 10
_MIDDLE = 128


class Code(NamedTuple):
    """The code tree: per symbol (bytes, then the end) the nodes passed and the bits taken, flat, with offsets.

    Of a symbol's ``length`` steps the first ``inner`` are among classes: class 0 is any end of a word, the
    others are the bytes of words in order.  Those steps split classes ``low`` to ``high`` at ``mid``.
    """

    node: np.ndarray
    bit: np.ndarray
    low: np.ndarray
    mid: np.ndarray
    high: np.ndarray
    start: np.ndarray
    length: np.ndarray
    inner: np.ndarray
    cls: np.ndarray


def code_tree(counts: np.ndarray) -> Code:
    """From the counts of the 257 symbols."""
    ends = [*np.flatnonzero(SPACE).tolist(), 256]
    inside = [b for b in range(256) if not SPACE[b]]
    weights = [float(sum(counts[e] for e in ends)), *(float(counts[b]) for b in inside)]
    number = 0

    def balanced(weights: list[float]) -> list[list[tuple[int, int, int, int, int]]]:
        """The path to each leaf: steps (node, bit, low, mid, high)."""
        nonlocal number
        sums = np.r_[0.0, np.cumsum(np.array(weights) + 0.01)]
        paths: list[list] = [[] for _ in weights]
        todo = [(0, len(weights))]
        while todo:
            a, b = todo.pop()
            if b - a < 2:
                continue
            mid = int(np.clip(np.searchsorted(sums, (sums[a] + sums[b]) / 2), a + 1, b - 1))
            if mid > a + 1 and abs(sums[mid - 1] * 2 - sums[a] - sums[b]) < abs(sums[mid] * 2 - sums[a] - sums[b]):
                mid -= 1
            for leaf in range(a, b):
                paths[leaf].append((number, int(leaf >= mid), a, mid, b))
            number += 1
            todo += [(a, mid), (mid, b)]
        return paths

    classes, last = balanced(weights), balanced([float(counts[e]) for e in ends])
    paths = [[]] * 257
    for k, b in enumerate(inside):
        paths[b] = classes[k + 1]
    for k, e in enumerate(ends):
        paths[e] = classes[0] + last[k]
    flat = np.array([step for p in paths for step in p], np.int64)
    length = np.array([len(p) for p in paths], np.int64)
    inner = length.copy()
    inner[ends] = len(classes[0])
    cls = np.zeros(257, np.int64)
    cls[inside] = np.arange(1, len(inside) + 1)
    return Code(flat[:, 0].astype(np.uint32), flat[:, 1].astype(bool), *(flat[:, k].copy() for k in (2, 3, 4)), np.r_[0, np.cumsum(length)[:-1]], length, inner, cls)


def end_odds(code: Code, counts: np.ndarray) -> np.ndarray:
    """Per node of the tree the log-odds of its steps, for those among ends of words."""
    sums = np.zeros((int(code.node.max()) + 1, 2))
    for symbol in np.flatnonzero(code.cls == 0):
        for k in range(code.start[symbol] + code.inner[symbol], code.start[symbol] + code.length[symbol]):
            sums[code.node[k], int(code.bit[k])] += counts[symbol]
    return np.log((sums[:, 1] + PRIOR) / (sums[:, 0] + PRIOR)).astype(np.float32)


def first_odds(code: Code, counts: np.ndarray) -> np.ndarray:
    """Log-odds per slot and node from counts per slot and class."""
    out = np.zeros((len(counts), int(code.node.max()) + 1), np.float32)
    _, step = np.unique(code.node, return_index=True)
    inner = np.zeros(len(code.node), bool)
    inner[_ranges(code.start, code.inner)] = True
    for lo in range(0, len(counts), 1024):  # few at a time, as sums take more memory than the result
        below = _below(counts[lo : lo + 1024])
        for k in step[inner[step]]:
            ones, zeros = below[:, code.high[k]] - below[:, code.mid[k]], below[:, code.mid[k]] - below[:, code.low[k]]
            out[lo : lo + 1024, code.node[k]] = np.log((ones + PRIOR) / (zeros + PRIOR))
    return out


def _below(counts: np.ndarray) -> np.ndarray:
    """Per row the sums of the counts of all classes before each."""
    out = np.zeros((len(counts), counts.shape[1] + 1))
    np.cumsum(counts, 1, np.float64, out[:, 1:])
    return out


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each stretch, end to end."""
    ends = np.cumsum(length)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - length), length)


# ---------------------------------------------------------------- words and their log-odds


class Words(NamedTuple):
    """Words end to end, each followed by the class of its end: classes, and the place of each word's first."""

    data: np.ndarray  # bytes of the words, without ends
    at: np.ndarray  # n + 1 offsets into data
    cls: np.ndarray  # per byte and end
    place: np.ndarray  # n + 1 offsets into cls


def words_of(code: Code, data: np.ndarray, at: np.ndarray) -> Words:
    n = len(at) - 1
    cls = np.zeros(len(data) + n, np.int64)
    place = at + np.arange(n + 1)
    cls[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(at))] = code.cls[data]
    return Words(data, at, cls, place)


def _symbol_of(code: Code) -> np.ndarray:
    """A symbol of each class."""
    symbol = np.zeros(int(code.cls.max()) + 1, np.int64)
    symbol[code.cls[:256]] = np.arange(256)
    return symbol


def _steps(code: Code, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of each class's steps in the tree, flat, and how many each has."""
    symbol = _symbol_of(code)  # for class 0 some end; its inner steps are the same for all
    length = code.inner[symbol[cls]]
    return _ranges(code.start[symbol[cls]], length), length


def shared_prefixes(w: Words) -> np.ndarray:
    """Bytes that each word (sorted) shares with the one before it; -1 for the first, and behind the last."""
    n = len(w.at) - 1
    out = np.zeros(n + 1, np.int64)
    out[0] = out[n] = -1
    size = np.diff(w.at)
    open_ = np.arange(1, n)
    d = 0
    while len(open_):
        open_ = open_[(size[open_] > d) & (size[open_ - 1] > d)]
        open_ = open_[w.data[w.at[open_] + d] == w.data[w.at[open_ - 1] + d]]
        d += 1
        out[open_] = d
    return out


def edges(w: Words, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every beginning of the first and of the last word: its hash and length, and per class that follows here its counts.

    ``m`` are the words' counts, one row for each kind of count.
    """
    n = m.shape[1]
    lcp = shared_prefixes(w)
    rows: list[tuple[np.ndarray, ...]] = []
    for k in {0, n - 1}:
        size = int(w.at[k + 1] - w.at[k])
        hashes = _beginnings(w.data[w.at[k] : w.at[k + 1]])
        beside = int(lcp[1]) if k == 0 else int(lcp[n - 1])
        shared = min(size, beside) if n > 1 else -1
        for d in range(shared + 1):
            # All words here that begin alike.
            same = np.flatnonzero(lcp[1:n] < d)
            lo, hi = (0, int(same[0]) + 1 if len(same) else n) if k == 0 else (int(same[-1]) + 1 if len(same) else 0, n)
            sums = np.stack([np.bincount(w.cls[w.place[lo:hi] + d], x[lo:hi], 256) for x in m])
            c = np.unique(w.cls[w.place[lo:hi] + d])  # with classes that only words without a count have
            rows.append((np.full(len(c), hashes[d]), np.full(len(c), d), c, sums[:, c].T))
        alone = np.arange(shared + 1, size + 1)
        rows.append((hashes[alone], alone, w.cls[w.place[k] + alone], np.tile(m[:, k].astype(float), (len(alone), 1))))
    h, d, c, s = (np.concatenate(x) for x in zip(*rows, strict=True))
    # If one beginning is both words', it has been summed twice.
    _, first = np.unique(np.stack([h.astype(np.int64), d, c]), axis=1, return_index=True)
    return h[first], d[first], c[first], s[first].T


def _beginnings(word: np.ndarray) -> np.ndarray:
    d = np.arange(len(word) + 1)
    return (SpanHash(byte_codes(23)[word]).of(np.zeros(len(d), np.int64), d) ^ mix64(d.astype(np.uint64))).view(np.int64)


def quantized(zeros: np.ndarray, ones: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The codes of steps with these counts; ``at`` says where each word's steps begin."""
    total = zeros + ones
    logit = np.log((ones + PRIOR) / (zeros + PRIOR))
    # Steps since a word so far last had another way to go on: the total has been the same since.
    place = np.arange(len(total))
    fresh_ = np.ones(len(total), bool)
    fresh_[1:] = total[1:] != total[:-1]
    fresh_[at[:-1][at[:-1] < len(total)]] = True
    run = place - np.maximum.accumulate(np.where(fresh_, place, 0))
    gate = np.searchsorted(SEEN, total, "right") * (len(RUNS) + 1) + np.searchsorted(RUNS, run, "right")
    return (gate << 8 | np.clip(np.rint(_TENTHS * logit) + _MIDDLE, 0, 255).astype(np.int64)).astype(np.uint16)


#: By hash and length of a beginning: classes that follow, and their counts.
Spanning = dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]


def word_codes(code: Code, w: Words, m: np.ndarray, spanning: Spanning) -> tuple[np.ndarray, np.ndarray]:
    """The code (see ``quantized``) of every step of every word of a sorted run, and n + 1 offsets."""
    zeros, ones, at = step_counts(code, w, m, spanning)
    return quantized(zeros, ones, at), at


def step_counts(code: Code, w: Words, m: np.ndarray, spanning: Spanning) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How often either way was taken at every step of every word of a sorted run, and n + 1 offsets."""
    n = len(m)
    size = np.diff(w.at)
    steps, length = _steps(code, w.cls)
    step_at = np.r_[0, np.cumsum(length)]
    word = np.repeat(np.arange(n), size + 1)
    # A word alone in its group is certain of its own way.
    alone = np.repeat(m[word].astype(np.float64), length)
    ones = np.where(code.bit[steps], alone, 0.0)
    zeros = alone - ones
    lcp = shared_prefixes(w)
    for end, k in ((0, 0), (n, n - 1)):
        hashes = _beginnings(w.data[w.at[k] : w.at[k + 1]])
        d = 0
        while d < len(hashes) and (int(hashes[d]), d) in spanning:
            lcp[end] = d
            d += 1
    reach = np.minimum(np.maximum(lcp[:-1], lcp[1:]), size)
    depth = 0
    active = np.flatnonzero(reach >= 0)
    while len(active):
        group = np.cumsum(lcp[:-1] < depth)[active] if depth else np.zeros(len(active), np.int64)
        place = w.place[active] + depth
        key = group * 256 + w.cls[place]
        edge = np.flatnonzero(np.r_[True, np.diff(key) != 0])
        known, weight = key[edge], np.add.reduceat(m[active].astype(np.float64), edge)
        # Sums over all runs for the groups at the ends that go on beyond them.
        for end, k in ((0, 0), (n, n - 1)):
            if lcp[end] >= depth:
                g = group[0] if end == 0 else group[-1]
                c, s = spanning[int(_beginnings(w.data[w.at[k] : w.at[k] + depth])[depth]), depth]
                lo, hi = np.searchsorted(known, (g * 256, g * 256 + 256))
                known, weight = np.r_[known[:lo], g * 256 + c, known[hi:]], np.r_[weight[:lo], s, weight[hi:]]
        below = np.r_[0.0, np.cumsum(weight)]
        rows = key[edge]
        steps_u, length_u = _steps(code, rows & 255)
        base = np.repeat(rows >> 8 << 8, length_u)
        upto = lambda x: below[np.searchsorted(known, base + x[steps_u])]  # noqa: B023, E731
        low, mid, high = upto(code.low), upto(code.mid), upto(code.high)
        u = np.cumsum(np.r_[False, np.diff(key) != 0])
        take = _ranges((np.cumsum(length_u) - length_u)[u], length_u[u])
        put = _ranges(step_at[place], length[place])
        zeros[put], ones[put] = (mid - low)[take], (high - mid)[take]
        depth += 1
        active = active[reach[active] >= depth]
    return zeros, ones, step_at[w.place]


def word_slots(code: Code, w: Words, bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The slots of every step of every word for each short context, and the steps' places in the tree."""
    steps, length = _steps(code, w.cls)
    n = len(w.at) - 1
    # The byte before each place in its word; 0 at the start.
    last = np.zeros(len(w.cls), np.uint32)
    of = np.arange(len(w.data)) + np.repeat(np.arange(n), np.diff(w.at))
    last[of + 1] = w.data

    def before(x: np.ndarray) -> np.ndarray:
        out = np.zeros_like(x)
        out[1:] = x[:-1]
        out[w.place[:-1]] = 0
        return out

    one = last
    one[w.place[:-1]] = 0
    two = before(one)
    three = one | two << np.uint32(8) | before(two) << np.uint32(16)
    node = (code.node[steps] + np.uint32(1)) * np.uint32(0x9E3779B1)
    slots = []
    for k, context in enumerate((one, three)):
        x = np.repeat((context + np.uint32(k + 1)) * np.uint32(0x165667B1), length) ^ node
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x297A2D39)
        slots.append(x >> np.uint32(32 - bits))
    return slots, steps


# ---------------------------------------------------------------- the mixer


class Model(NamedTuple):
    code: Code
    bits: int
    odds: np.ndarray  # (short contexts, slots) float32
    ends: np.ndarray  # per node of the tree: log-odds among ends of words
    first: np.ndarray  # (slots of both kinds, nodes) log-odds of a word's first and second symbol
    weights: np.ndarray  # (gates, inputs) float32


class Events(NamedTuple):
    """The binary events of texts: inputs, gate and outcome of each, and per symbol how many it has."""

    inputs: np.ndarray  # (inputs, events) float32
    gate: np.ndarray
    bit: np.ndarray
    per_symbol: np.ndarray


def events_of(m: Model, t: Tokens, words: Words, codes: np.ndarray, code_at: np.ndarray) -> Events:
    """Events of texts whose distinct words are ``words``, with their ``codes``."""
    symbols, word = t.symbols, t.word
    length = m.code.length[symbols]
    steps = _ranges(m.code.start[symbols], length)
    # The steps inside words are, in order, those of the words; the others choose among ends.
    inside = np.ones(len(steps), bool)
    ends = np.flatnonzero(m.code.cls[symbols] == 0)
    at = np.cumsum(length) - length
    more = (length - m.code.inner[symbols])[ends]
    inside[_ranges((at + m.code.inner[symbols])[ends], more)] = False
    take = _ranges(code_at[word], np.diff(code_at)[word])
    step = np.full(len(steps), (GATES - 1) << 8, np.int64)
    step[inside] = codes[take]
    inputs = np.zeros((INPUTS, len(steps)), np.float32)
    inputs[0] = ((step & 255) - _MIDDLE) / np.float32(_TENTHS)
    inputs[0, ~inside] = m.ends[m.code.node[steps[~inside]]]
    slots, _ = word_slots(m.code, words, m.bits)
    for k, s in enumerate(slots):
        inputs[k + 1, inside] = m.odds[k][s][take]
    more = np.flatnonzero(t.second >= 0)
    for place, slot in ((t.begin, t.context), (t.begin[more] + 1, t.second[more])):
        begun = m.code.inner[symbols[place]]
        rows = _ranges(at[place], begun)
        inputs[INPUTS - 1, rows] = m.first[np.repeat(slot, begun), m.code.node[steps[rows]]]
    return Events(inputs, step >> 8, m.code.bit[steps], length)


def bits_of(m: Model, e: Events, at: np.ndarray) -> np.ndarray:
    """Total bits of each text (symbols ``at[k]`` to ``at[k + 1]``)."""
    n = len(at) - 1
    size = np.diff(at)
    weights = np.repeat(m.weights[None], n, 0).reshape(n * GATES, INPUTS)
    tail = np.tile(np.array([1, 0], np.float32), (n, 1))
    text = np.repeat(np.arange(n), size)
    block = (np.arange(len(text)) - np.repeat(at[:-1], size)) // BLOCK
    order = np.argsort(block, kind="stable")
    # All texts' first blocks, then all second ones, and so on: each step of the loop is one stretch.
    per = e.per_symbol[order]
    events = _ranges((np.cumsum(e.per_symbol) - e.per_symbol)[order], per)
    of = np.repeat(text[order], per)
    steps = np.bincount(block, e.per_symbol).astype(np.int64) if len(block) else np.zeros(0, np.int64)
    spent = np.zeros(n)
    lo = 0
    for hi in np.cumsum(steps).tolist():
        rows, who = events[lo:hi], of[lo:hi]
        x, bit = e.inputs[:, rows], e.bit[rows]
        cell = who * GATES + e.gate[rows]
        w = weights[cell]
        z = (w * x.T).sum(1)
        scale, shift = tail[who, 0], tail[who, 1]
        final = np.clip(scale * z + shift, -13, 13)
        p = 1 / (1 + np.exp(-final))
        spent += np.bincount(who, -np.log(np.where(bit, p, 1 - p)), n)
        # Gradients at the current predictions; each gate moves by its own mean.
        error = (p - bit).astype(np.float32)
        count = np.bincount(cell, minlength=n * GATES) + 8.0
        inner = error * scale
        for k in range(INPUTS):
            weights[:, k] -= RATE * np.bincount(cell, inner * x[k], n * GATES) / count / 4
        seen = np.bincount(who, minlength=n) + 64.0
        tail[:, 0] -= TAIL_RATE * np.bincount(who, error * z, n) / seen / 4
        tail[:, 1] -= TAIL_RATE * np.bincount(who, error, n) / seen
        lo = hi
    return spent / math.log(2)


# ---------------------------------------------------------------- Spark stages


class Tokens(NamedTuple):
    """The words of texts: per end of a word (white space or end of text) the word before it, by its distinct number."""

    symbols: np.ndarray
    at: np.ndarray  # n + 1 offsets into symbols
    word: np.ndarray  # per end, in order: which distinct word it ends
    names: np.ndarray  # hashes of the distinct words; that of the empty one is _EMPTY
    data: np.ndarray  # their bytes
    data_at: np.ndarray
    text: np.ndarray  # per end: its text
    begin: np.ndarray  # per end: where its word begins in symbols
    end: np.ndarray  # and where it stands itself
    context: np.ndarray  # per end: slot of the end of the word before its word
    second: np.ndarray  # per end: slot of that and the word's first byte; -1 for the empty word


def tokens_of(column: pa.Array) -> Tokens:
    data, at = text_bytes(column)
    low = LOWER[data]
    n = len(at) - 1
    # The end symbol stands behind each text.
    symbols = np.insert(low.astype(np.int64), at[1:], 256)
    at = at + np.arange(n + 1)
    space = np.r_[SPACE, True]
    ends = np.flatnonzero(space[symbols])
    begins = np.r_[0, ends[:-1] + 1] if len(ends) else ends
    text = np.searchsorted(at, ends, "right") - 1
    # In the bytes without end symbols a place moves by the number of texts before it.
    a, b = begins - text, ends - text
    hashes = np.where(b > a, SpanHash(byte_codes(11)[low]).of(a, b), _EMPTY) if len(ends) else np.empty(0, np.uint64)
    names, first, word = np.unique(hashes, return_index=True, return_inverse=True)
    size = (b - a)[first]
    last = np.zeros(len(ends), np.uint32)
    for k in (1, 2, 3):
        has = b - a >= k
        last[has] = last[has] << np.uint32(8) | low[b[has] - k]
    last = (last + np.uint32(1)) * np.uint32(0x9E3779B1) >> np.uint32(32 - FIRST_BITS)
    context = np.r_[last[:1] * 0, last[:-1]]
    context[np.r_[True, np.diff(text) != 0][: len(ends)]] = 0
    second = np.full(len(ends), -1)
    some = np.flatnonzero(b > a)
    mixed = (context[some] * np.uint32(257) + low[a[some]] + np.uint32(1)) * np.uint32(0x85EBCA6B)
    second[some] = (mixed ^ mixed >> np.uint32(15)) * np.uint32(0x9E3779B1) >> np.uint32(32 - FIRST_BITS)
    second[some] += 1 << FIRST_BITS
    return Tokens(symbols, at, word, names, low[_ranges(a[first], size)], np.r_[0, np.cumsum(size)], text, begins, ends, context, second)


def token_counts(rows: DataFrame) -> DataFrame:
    """``token`` hash, ``word`` and ``n`` (training count) of all words of all texts; ``m`` counts what is no word.

    The end is a token without a word; the empty word counts ends that follow an end, in ``m`` only.  Rows without
    a word and with a negative ``token`` count, in ``m``, kinds of ends, and first and second symbols behind the end of another word,
    the second ones by the first byte as well.
    """
    kinds = pa.schema([("token", pa.int64()), ("word", pa.binary()), ("n", pa.int64()), ("m", pa.int64())])
    cls = code_tree(np.zeros(257)).cls

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0

        def summed() -> pa.Table:
            t = pa.Table.from_batches(held).group_by(["token", "word"], use_threads=False).aggregate([("n", "sum"), ("m", "sum")])
            return t.select(["token", "word", "n_sum", "m_sum"]).rename_columns(kinds.names)

        for part in slices(batches, "text", 1 << 20):
            t = tokens_of(part.column("text"))
            train = np.array(part.column("train").to_pylist(), bool)[t.text]
            n, empty = np.bincount(t.word, train, len(t.names)), t.names == _EMPTY
            m = np.where(empty, n, 0)
            n[empty] = 0
            words = pa.array(np.array([b""] * len(t.names), object)) if not len(t.data) else pa.Array.from_buffers(pa.large_binary(), len(t.names), [None, pa.py_buffer(t.data_at.astype(np.int64)), pa.py_buffer(t.data.tobytes())]).cast(pa.binary())
            held.append(pa.RecordBatch.from_arrays([pa.array(t.names.view(np.int64)), words, pa.array(n.astype(np.int64)), pa.array(m.astype(np.int64))], schema=kinds))
            all_n = int(np.array(part.column("train").to_pylist(), bool).sum())
            held.append(pa.RecordBatch.from_arrays([pa.array([int(_END)]), pa.array([None], pa.binary()), pa.array([all_n]), pa.array([0])], schema=kinds))
            # A negative name without a word stands for a kind of end, or below.
            ends, times = np.unique(t.symbols[t.end][train], return_counts=True)
            held.append(pa.RecordBatch.from_arrays([pa.array(-1 - _ENDS - ends), pa.nulls(len(times), pa.binary()), pa.array(np.zeros(len(times), np.int64)), pa.array(times)], schema=kinds))
            # for a slot and the class of a word's first or second symbol.
            more = np.flatnonzero(train & (t.second >= 0))
            seconds = t.second[more] << 16 | t.symbols[t.begin[more]] << 8 | cls[t.symbols[t.begin[more] + 1]]
            pair = np.r_[(t.context.astype(np.int64) << 8 | cls[t.symbols[t.begin]])[train], seconds]
            pair, times = np.unique(pair, return_counts=True)
            held.append(pa.RecordBatch.from_arrays([pa.array(-1 - pair), pa.nulls(len(pair), pa.binary()), pa.array(np.zeros(len(pair), np.int64)), pa.array(times)], schema=kinds))
            count += len(t.names)
            if count > 1_000_000:
                merged = summed()
                if merged.num_rows > 500_000:
                    yield from merged.to_batches(max_chunksize=100_000)
                    held, count = [], 0
                else:
                    held, count = merged.to_batches(), merged.num_rows
        if held:
            yield from summed().to_batches(max_chunksize=100_000)

    counts = rows.select("text", "train").mapInArrow(run, "token bigint, word binary, n bigint, m bigint")
    return counts.groupBy("token", "word").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def symbol_counts(counts: DataFrame) -> np.ndarray:
    """Occurrences of the 257 symbols in the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(257)
        for batch in batches:
            data = batch.column("word").cast(pa.large_binary())
            _, offsets, raw = data.buffers()
            at = np.frombuffer(offsets, np.int64)[data.offset : data.offset + len(data) + 1]
            if raw is not None and len(at) and at[-1] > at[0]:
                total[:256] += np.bincount(np.frombuffer(raw, np.uint8)[at[0] : at[-1]], np.repeat(batch.column("n").to_numpy().astype(float), np.diff(at)), 256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(257)), pa.array(total)], ["s", "n"])

    out = np.zeros(257)
    of_words = counts.filter("word is not null and n > 0").select("word", "n").mapInArrow(run, "s bigint, n double")
    for r in of_words.groupBy("s").agg(F.sum("n").alias("n")).collect():
        out[r.s] += r.n
    for r in counts.filter("word is null").filter(F.col("token") < -_ENDS).select("token", "m").collect():  # seven kinds of ends
        out[-1 - _ENDS - r.token] += r.m
    return out


def _run_words(code: Code, words: pa.Array) -> Words:
    data = words.cast(pa.large_binary())
    _, offsets, raw = data.buffers()
    at = np.frombuffer(offsets, np.int64)[data.offset : data.offset + len(data) + 1]
    return words_of(code, np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None else np.empty(0, np.uint8), at - at[0])


def _in_runs(counts: DataFrame) -> DataFrame:
    """All words in order, cut into runs: ``run``, ``pos``, ``token``, ``word``, ``n``, ``m``."""
    most, most_bytes = RUN, RUN_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, words, size, task = 0, 0, 0, TaskContext.get().partitionId()
        for batch in batches:
            lengths = pc.binary_length(batch.column("word")).to_numpy(zero_copy_only=False).astype(np.int64)
            ends, lo = np.cumsum(lengths), 0
            while lo < batch.num_rows:
                # As many words as the run has room for.
                before = int(ends[lo - 1]) if lo else 0
                hi = min(lo + most - words, int(np.searchsorted(ends, before + most_bytes - size, "left")) + 1, batch.num_rows)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(hi - lo, (task << 32) + number)), pa.array(np.arange(words, words + hi - lo)), *part.columns], ["run", "pos", *part.schema.names])
                words, size, lo = words + hi - lo, size + int(ends[hi - 1]) - before, hi
                if words == most or size >= most_bytes:
                    number, words, size = number + 1, 0, 0

    ordered = counts.filter("word is not null").repartitionByRange("word").sortWithinPartitions("word").select("token", "word", "n", "m")
    return stored(ordered.mapInArrow(run, "run bigint, pos bigint, token bigint, word binary, n bigint, m bigint"))


def _counts(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    """The counts of a run's words."""
    return table.column("n").to_numpy() + table.column("m").to_numpy()


def spanning_of(runs: DataFrame, code: Code) -> Spanning:
    """Counts of what follows those beginnings of words that stand in several runs; some rows per run."""
    shared = runs.sparkSession.sparkContext.broadcast(code)

    def ends(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos").combine_chunks()
        h, d, c, s = edges(_run_words(shared.value, table.column("word").chunk(0)), _counts(table)[None])
        return pa.table({"h": h, "d": d, "c": c, "s": s[0], "run": np.full(len(h), table.column("run")[0].as_py())})

    found = stored(runs.groupBy("run").applyInArrow(ends, "h bigint, d bigint, c bigint, s double, run bigint"))
    across = found.groupBy("h", "d").agg(F.min("run").alias("a"), F.max("run").alias("b")).filter("a <> b").select("h", "d")
    got = found.join(across, ["h", "d"]).groupBy("h", "d", "c").agg(F.sum("s").alias("s")).orderBy("h", "d", "c").toArrow()
    h, d, c, s = (got.column(k).to_numpy() for k in ("h", "d", "c", "s"))
    if not len(h):
        return {}
    edge = np.flatnonzero(np.r_[True, (np.diff(h) != 0) | (np.diff(d) != 0)])
    return {(int(h[a]), int(d[a])): (c[a:b], s[a:b]) for a, b in zip(edge, np.r_[edge[1:], len(h)], strict=True)}


def coded_words(runs: DataFrame, code: Code, slots: np.ndarray) -> DataFrame:
    """``token``, ``n`` and ``codes`` (see ``word_codes``) of all words; in rows without a token ``cell`` and ``times`` of training events.

    The cells are those of the third and all further symbols of words; ``slots`` are the counts of the short contexts.
    """
    shared = runs.sparkSession.sparkContext.broadcast((code, spanning_of(runs, code), slots))

    def coded(table: pa.Table) -> pa.Table:
        code, spanning, slots = shared.value
        table = table.sort_by("pos").combine_chunks()
        words, counts = _run_words(code, table.column("word").chunk(0)), _counts(table)
        zeros, ones, at = step_counts(code, words, counts, spanning)
        raw, ends = quantized(zeros, ones, at).tobytes(), (2 * at).tolist()
        codes = pa.array([raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
        cell, times = word_cells(code, words, counts, zeros, ones, at, slots)
        both = lambda x, n, kind: pa.chunked_array([x, pa.nulls(n, kind)])
        columns = {"token": table.column("token").chunk(0), "n": table.column("n").chunk(0), "codes": codes}
        out = {name: both(x, len(cell), x.type) for name, x in columns.items()}
        for name, x in (("cell", pa.array(cell)), ("times", pa.array(times))):
            out[name] = pa.chunked_array([pa.nulls(table.num_rows, x.type), x])
        return pa.table(out).combine_chunks()

    return runs.groupBy("run").applyInArrow(coded, "token bigint, n bigint, codes binary, cell bigint, times double")


def _cut(batch: pa.RecordBatch, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most so many rows and, but for the last of them, bytes of words."""
    ends, lo = np.cumsum(pc.binary_length(batch.column("word")).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while lo < batch.num_rows:
        hi = min(lo + rows, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, "left")) + 1, batch.num_rows)
        yield batch.slice(lo, hi - lo)
        lo = hi


def slot_counts(runs: DataFrame, code: Code, bits: int) -> DataFrame:
    """``slot`` (context times slots plus slot), ``zeros`` and ``ones`` over all words that the model counts."""
    shared = runs.sparkSession.sparkContext.broadcast(code)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(ORDERS), 2 << bits))  # zeros and ones of a slot stand next to each other
        for batch in batches:
            for part in _cut(batch, 5000, 1 << 17):
                w = _run_words(shared.value, part.column("word"))
                slots, steps = word_slots(shared.value, w, bits)
                _, length = _steps(shared.value, w.cls)
                times = np.repeat(np.repeat(_counts(part).astype(float), np.diff(w.place)), length)
                for k, s in enumerate(slots):
                    sums[k] += np.bincount(s.astype(np.int64) << 1 | shared.value.bit[steps], times, 2 << bits)
        for k in range(len(ORDERS)):
            pair = sums[k].reshape(-1, 2)
            used = np.flatnonzero(pair.any(1))
            for lo in range(0, len(used), 200_000):
                u = used[lo : lo + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(u + (k << bits)), pa.array(pair[u, 0]), pa.array(pair[u, 1])], ["slot", "zeros", "ones"])

    found = runs.filter("n > 0 or m > 0").select("token", "word", "n", "m").mapInArrow(run, "slot bigint, zeros double, ones double")
    return found.groupBy("slot").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))


def found_in(known: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each name is among sorted ones, and whether it is there."""
    if not len(known):
        return np.zeros(len(names), np.int64), np.zeros(len(names), bool)
    place = np.minimum(np.searchsorted(known, names), len(known) - 1)
    return place, known[place] == names


class Known(NamedTuple):
    """Words with their training counts and codes, sorted by hash."""

    names: np.ndarray
    n: np.ndarray
    codes: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, names: np.ndarray, n: np.ndarray, codes: pa.Array) -> Known:
        order = np.argsort(names, kind="stable")
        codes = codes.cast(pa.large_binary()).take(pa.array(order))
        _, offsets, raw = codes.buffers()
        at = np.frombuffer(offsets, np.int64)[codes.offset : codes.offset + len(codes) + 1] if len(codes) else np.zeros(1, np.int64)
        data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw is not None and len(codes) else np.empty(0, np.uint8)
        return cls(names[order], n[order], np.frombuffer(data.tobytes(), np.uint16), (at - at[0]) // 2)

    def find(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each name is, and whether it is there."""
        return found_in(self.names, names)


def _gathered(t: Tokens, code: Code, known: list[Known]) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words]:
    """Training counts and codes of a part's distinct words, from whichever of ``known`` has them."""
    words = words_of(code, t.data, t.data_at)
    _, length = _steps(code, words.cls)
    code_at = np.r_[0, np.cumsum(length)][words.place]
    codes = np.full(int(code_at[-1]), np.uint16(_MIDDLE))  # never seen, no opinion
    n = np.zeros(len(t.names), np.int64)
    for k in known:
        place, there = k.find(t.names.view(np.int64))
        mine = np.flatnonzero(there)
        n[mine] = k.n[place[mine]]
        codes[_ranges(code_at[mine], np.diff(code_at)[mine])] = k.codes[_ranges(k.at[place[mine]], np.diff(k.at)[place[mine]])]
    return n, codes, code_at, words


def _by_length(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Rows of a batch by length of their text, so that texts that are read together end together."""
    for batch in batches:
        _, at = text_bytes(batch.column(text))
        yield batch.take(pa.array(np.argsort(np.diff(at), kind="stable")))


# ---------------------------------------------------------------- starting weights


def cells_of(step: np.ndarray, others: list[np.ndarray], bit: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Events by gate, inputs rounded to halves, and outcome: a number for each such cell, and how many events it has.

    ``step`` are codes (see ``quantized``), ``others`` the inputs but for the first; those that are not given are 0.
    """
    cell = step.astype(np.int64) >> 8
    for x in ((step.astype(np.int64) & 255) - _MIDDLE) / _TENTHS, *others, *[np.zeros(1)] * (INPUTS - 1 - len(others)):
        cell = cell << 6 | (np.clip(np.rint(2 * x), -31, 31).astype(np.int64) + 32)
    cell, where = np.unique(cell << 1 | bit, return_inverse=True)
    return cell, np.bincount(where, times, len(cell)).astype(float)


def _without(zeros: np.ndarray, ones: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The counts at steps without the event itself."""
    return np.maximum(zeros - ~bit, 0), np.maximum(ones - bit, 0)


def _odds_without(zeros: np.ndarray, ones: np.ndarray, bit: np.ndarray) -> np.ndarray:
    zeros, ones = _without(zeros, ones, bit)
    return np.log((ones + PRIOR) / (zeros + PRIOR))


def word_cells(code: Code, w: Words, m: np.ndarray, zeros: np.ndarray, ones: np.ndarray, at: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the training events of a run's words, from their third symbols on, with all that share a word counted at once."""
    places, steps = word_slots(code, w, int(slots.shape[1]).bit_length() - 1)
    bit = code.bit[steps]
    _, length = _steps(code, w.cls)
    depth = np.arange(len(w.cls)) - np.repeat(w.place[:-1], np.diff(w.place))
    mine = np.flatnonzero(np.repeat((depth >= 2) & np.repeat(m > 0, np.diff(w.place)), length))
    step = quantized(*_without(zeros, ones, bit), at)[mine]
    bit = bit[mine]
    others = [_odds_without(*counts[s[mine]].T, bit) for counts, s in zip(slots, places, strict=True)]
    return cells_of(step, others, bit, np.repeat(m, np.diff(at))[mine])


def begin_cells(code: Code, pair: np.ndarray, times: np.ndarray, slots: np.ndarray, firsts: np.ndarray, seconds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of first and second symbols of words.

    ``pair`` says what they are, as in ``token_counts``; ``firsts`` has counts by slot and class, ``seconds`` by first byte and class.
    """
    late = pair >= _SECOND
    cls, slot = pair & 255, np.where(late, pair >> 16, pair >> 8)
    byte = np.where(late, pair >> 8 & 255, 0)
    n = len(pair)
    # The symbol in a word that begins so: its first byte, if it has to have one, and the byte of the class, if that is no end.
    has = np.c_[late, cls > 0]
    data = np.c_[byte, _symbol_of(code)[cls]][has].astype(np.uint8)
    w = words_of(code, data, np.r_[0, np.cumsum(has.sum(1))])
    places, steps = word_slots(code, w, int(slots.shape[1]).bit_length() - 1)
    _, length = _steps(code, w.cls)
    depth = np.arange(len(w.cls)) - np.repeat(w.place[:-1], np.diff(w.place))
    word = np.repeat(np.arange(n), np.diff(w.place))
    # Counts at the root, then those behind the first byte; what comes after the symbol is left out.
    table = _below(np.concatenate([firsts[: 1 << FIRST_BITS].sum(0, dtype=np.float64)[None], seconds]))
    row = np.where(depth == 0, 0, byte[word] + 1)
    used = np.repeat(depth <= late[word], length)
    own, row = np.repeat(depth == late[word], length)[used], np.repeat(row, length)[used]
    steps = steps[used]
    between = lambda t, r: (t[r, code.mid[steps]] - t[r, code.low[steps]], t[r, code.high[steps]] - t[r, code.mid[steps]])
    bit = code.bit[steps]
    at = np.r_[0, np.cumsum(np.bincount(np.repeat(word, length)[used], minlength=n))]
    step = quantized(*_without(*between(table, row), bit), at)
    names, where = np.unique(slot, return_inverse=True)
    last = between(_below(firsts[names]), np.repeat(where, np.diff(at)))
    others = [counts[s[used]].T for counts, s in zip(slots, places, strict=True)]
    inputs = [_odds_without(zeros, ones, bit)[own] for zeros, ones in (*others, last)]
    return cells_of(step[own], inputs, bit[own], np.repeat(times, np.diff(at))[own])


def end_cells(code: Code, counts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of events among ends of words, from the counts of symbols and the log-odds of these steps."""
    symbols = np.flatnonzero(code.cls == 0)
    more = (code.length - code.inner)[symbols]
    steps = _ranges((code.start + code.inner)[symbols], more)
    x = np.clip(np.rint(_TENTHS * ends[code.node[steps]]) + _MIDDLE, 0, 255).astype(np.int64)
    return cells_of((GATES - 1) << 8 | x, [], code.bit[steps], np.repeat(counts[symbols], more))


_CURVE = np.triu_indices(INPUTS)


def slopes(weights: np.ndarray, cell: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Per gate the gradient and the upper half of the curvature of the cost of the events in these cells."""
    bit, rest = cell & 1, cell >> 1
    x = np.stack([((rest >> 6 * (INPUTS - 1 - k)) & 63) - 32 for k in range(INPUTS)]) / 2
    gate = rest >> 6 * INPUTS
    p = 1 / (1 + np.exp(-np.clip((weights[gate].T * x).sum(0), -13, 13)))
    error, curve = times * (p - bit), times * p * (1 - p)
    return np.stack([*(np.bincount(gate, error * a, GATES) for a in x), *(np.bincount(gate, curve * x[a] * x[b], GATES) for a, b in zip(*_CURVE, strict=True))], 1)


def fitted(weights: np.ndarray, cells: DataFrame, more: tuple[np.ndarray, np.ndarray], turns: int = 8, keep: float = 20.0) -> np.ndarray:
    """Starting weights by Newton steps, for each gate those that predict the events of all cells best; ``keep`` holds them near the given ones."""
    start = weights.astype(np.float64)
    weights = start.copy()
    for _ in range(turns):
        now = weights.copy()

        def run(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            total = np.zeros((GATES, INPUTS + len(_CURVE[0])))
            for batch in batches:
                total += slopes(now, batch.column("cell").to_numpy(), batch.column("times").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.reshape(-1))], ["k", "x"])

        sums = slopes(now, *more)
        for r in cells.mapInArrow(run, "k bigint, x double").groupBy("k").agg(F.sum("x").alias("x")).collect():  # a few hundred numbers
            sums.reshape(-1)[r.k] += r.x
        for g in range(GATES):
            curve = np.zeros((INPUTS, INPUTS))
            curve[_CURVE] = curve.T[_CURVE] = sums[g, INPUTS:]
            weights[g] -= np.clip(np.linalg.solve(curve + keep * np.eye(INPUTS), sums[g, :INPUTS] + keep * (now[g] - start[g])), -0.5, 0.5)
        if np.abs(weights - now).max() < 0.002:
            break
    return weights.astype(np.float32)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", train_on: str = "train", bits: int = BITS) -> DataFrame:
    """Per row: key, ``train``, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities), n_bytes."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(train_on), F.lit(False)).alias("train"))
    rows = rows.withColumn("hash", F.xxhash64("text"))

    counts = stored(token_counts(rows))
    all_tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    symbols = symbol_counts(counts)
    code = code_tree(symbols)
    runs = _in_runs(counts)
    slots = np.zeros((len(ORDERS), 1 << bits, 2), np.float32)
    got = slot_counts(runs, code, bits).toArrow()  # at most so many rows, whatever the size of the corpus
    slots.reshape(-1, 2)[got.column("slot").to_numpy()] = np.c_[got.column("zeros").to_numpy(), got.column("ones").to_numpy()]
    del got
    coded = stored(coded_words(runs, code, slots))
    cells, coded = coded.filter("cell is not null").select("cell", "times"), coded.filter("token is not null").select("token", "n", "codes")

    firsts, seconds = np.zeros((2 << FIRST_BITS, 256), np.float32), np.zeros((256, 256))
    begins = counts.filter("word is null and token < 0").filter(F.col("token") >= -_ENDS).select((-1 - F.col("token")).alias("pair"), F.col("m").alias("times"))
    late = F.col("pair") >= _SECOND
    slot = F.when(late, F.shiftleft(F.shiftright("pair", 16), 8).bitwiseOR(F.col("pair").bitwiseAND(255))).otherwise(F.col("pair"))
    for table, some, at in ((firsts, begins, slot), (seconds, begins.filter(late), F.col("pair").bitwiseAND(65535))):
        got = some.groupBy(at.alias("at")).agg(F.sum("times").alias("times")).toArrow()  # at most slots times classes
        table.reshape(-1)[got.column("at").to_numpy()] = got.column("times").to_numpy()
        del got
    # Sums and log-odds of what is counted by slots, then all that the events of all training texts say on weights.
    ends = end_odds(code, symbols)
    weights = np.tile(np.eye(1, INPUTS, dtype=np.float32), (GATES, 1))
    if all_tokens:
        about = spark.sparkContext.broadcast((code, slots, firsts, seconds))

        def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in begin_cells(about.value[0], batch.column("pair").to_numpy(), batch.column("times").to_numpy(), *about.value[1:])], ["cell", "times"])

        every = cells.unionByName(begins.mapInArrow(begun, "cell bigint, times double"))
        every = stored(every.groupBy("cell").agg(F.sum("times").alias("times")))
        weights = fitted(weights, every, end_cells(code, symbols, ends))
        about.destroy()
    model = Model(code, bits, np.log((slots[..., 1] + PRIOR) / (slots[..., 0] + PRIOR)), ends, first_odds(code, firsts), weights)
    del slots, firsts

    # The lowest count at which the words still fit: at most 64 bins per power of two come to the driver.
    sized = [F.count("*").alias("k"), F.coalesce(F.sum(F.octet_length("codes")), F.lit(0)).alias("size")]
    bins = coded.filter("n > 0").groupBy(F.floor(F.log2("n") * 64).alias("bin")).agg(*sized, F.min("n").alias("least")).collect()
    room, space, least = BROADCAST_TOKENS, BROADCAST_BYTES, None
    for b in sorted(bins, key=lambda r: -r.bin):
        room, space = room - b.k, space - b.size
        if min(room, space) < 0:
            break
        least = b.least
    unseen = coded.filter("n = 0").agg(*sized).first()
    few = min(room, space) >= 0 and unseen.k <= room and unseen.size <= space
    frequent = coded if few else coded.filter(F.col("n") >= least) if least is not None else None
    common, names = [], []
    for part in range(BROADCAST_PARTS if frequent is not None else 0):
        table = frequent.filter(F.pmod("token", F.lit(BROADCAST_PARTS)) == part).toArrow().combine_chunks()
        if table.num_rows:
            known = Known.of(table.column("token").to_numpy(), table.column("n").to_numpy(), table.column("codes").chunk(0))
            common.append(spark.sparkContext.broadcast(known))
            names.append(known.names)
            del known
        del table
    rare = None if few else coded.filter(F.col("n") < least) if least is not None else coded
    shared = spark.sparkContext.broadcast(model)
    del model

    body = rows.select("key", "hash", "train", "text")
    if rare is None:
        body = body.withColumn("rare", F.lit(None).cast("array<struct<token: bigint, n: bigint, codes: binary>>"))
    else:
        # Who asks needs no log-odds: only names go to these tasks.
        having = spark.sparkContext.broadcast(names)

        def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, "text", 1 << 20):
                t = tokens_of(part.column("text"))
                there = np.zeros(len(t.names), bool)
                for known in having.value:
                    there |= found_in(known, t.names.view(np.int64))[1]
                hashes = part.column("hash").to_numpy()[t.text]
                pairs = pa.table({"hash": hashes[~there[t.word]], "token": t.names.view(np.int64)[t.word[~there[t.word]]]})
                yield from pairs.group_by(["hash", "token"], use_threads=False).aggregate([]).select(["hash", "token"]).to_batches(max_chunksize=100_000)

        lists = body.select("hash", "text").mapInArrow(asked, "hash bigint, token bigint").join(rare, "token").groupBy("hash").agg(F.collect_list(F.struct("token", "n", "codes")).alias("rare"))
        body = body.join(lists, "hash", "left")

    constant = math.log10(all_tokens + 0.5 * (distinct + 1))
    end_times = counts.filter(F.col("token") == int(_END)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, m = [b.value for b in common], shared.value
        for part in slices(_by_length(batches, "text"), "text", PART):
            t = tokens_of(part.column("text"))
            here = [*known]
            lists = part.column("rare").combine_chunks() if isinstance(part.column("rare"), pa.ChunkedArray) else part.column("rare")
            if lists.null_count < len(lists):
                found = lists.flatten()
                names = found.field("token").to_numpy()
                _, first = np.unique(names, return_index=True)
                here.append(Known.of(names[first], found.field("n").to_numpy()[first], found.field("codes").take(pa.array(first))))
            n, codes, code_at, words = _gathered(t, m.code, here)
            spent = bits_of(m, events_of(m, t, words, codes, code_at), t.at)
            real = t.names[t.word] != _EMPTY
            times = n[t.word][real]
            rows_ = part.num_rows
            sums = lambda x: np.bincount(t.text[real], x, rows_)  # noqa: B023, E731
            n_tokens = np.bincount(t.text[real], minlength=rows_) + 1
            logs = sums(np.log10(times + 0.5)) + math.log10(end_times + 0.5) - n_tokens * constant
            size = np.diff(t.at) - 1
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), part.column("train"), pa.array(n_tokens), pa.array((sums(times > 0) + (end_times > 0)).astype(np.int64)), pa.array(logs), pa.array(-spent * math.log10(2)), pa.array(size)],
                ["key", "train", "n_tokens", "n_known", "base_score", "score", "n_bytes"],
            )

    schema = body.select("key").schema
    for name, kind in (("train", "boolean"), ("n_tokens", "long"), ("n_known", "long"), ("base_score", "double"), ("score", "double"), ("n_bytes", "long")):
        schema = schema.add(name, kind)
    parts = body.select("key", "train", "text", "rare").mapInArrow(run, schema)
    return parts.select(F.col("key").alias(key), "train", "n_tokens", "n_known", F.lit(int(all_tokens)).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes")
