"""Language identification: first the family, then one-versus-one linear support vector machines inside it.

Texts become relative frequencies of hashed letter bigrams and trigrams (ASCII letters in lower
case, everything that is no letter as one gap, bytes outside ASCII as they are).  Families are
told apart by one-versus-one machines too; a family of one language needs none.

The machines are fitted on a bounded sample: at most ``PER_LANGUAGE`` labelled rows of each of the
``LANGUAGES`` languages that have most labelled rows, those with the lowest hash of their key, whole
texts.  Prediction covers every row.

Defined results: a null text, or one without a letter, is ``und`` with score 0; rows whose
language is null teach nothing; with no labelled row at all every text is ``und``; with a single
language every text with a letter gets it with score 1; repeated rows are predicted alike; an
empty table gives an empty result; other input columns are dropped.  Texts of any length are
read whole.

Every text with a letter gets the nearest language that was learnt.  Whether it is in that language
at all is another question, which ``profile`` and ``identify_known`` answer: the letter trigrams of all
labelled rows are counted by language, and a text's mean log-probability under its language's counts
must come nearer to that of the language's own texts than to that of the other languages' texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podspark.llm.arrow_text import LOWER, slices, text_bytes
from podspark.llm.common import fresh

#: Families by language code. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb yi".split(),
    "romance": "fr es it pt ro ca gl oc la".split(),
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs".split(),
    "indic": "hi bn ur mr pa gu ne si".split(),
    "turkic": "tr az kk ky uz tk tt".split(),
    "uralic": "fi et hu".split(),
    "semitic": "ar he am mt".split(),
}
PER_LANGUAGE = 400
LANGUAGES = 100
BITS = 12
UNKNOWN = "und"
#: Bits of a profile's trigram hash, and what an unseen trigram counts.
PROFILE_BITS = 14
UNSEEN = 0.1
#: How far on the way from its language's own mean to the other languages' mean a text may lie, and
#: the standard errors by which a short text may lie farther.
FAR = 0.8
ERRORS = 2.0
#: Part of a language's mean share of letters that a text must have.
LETTERS = 1 / 3


def family(lang: str) -> str:
    return next((name for name, langs in FAMILIES.items() if lang in langs), lang)


_CLASS = np.zeros(256, np.uint32)
_CLASS[0x61:0x7B] = np.arange(1, 27)
_CLASS[0x80:] = np.arange(32, 160)


def grams(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed bigram and trigram ending at each byte, in separate halves of the feature space.

    Bytes before a text count as gaps, so a text has the same grams wherever it stands.
    """
    c = _CLASS[LOWER[data]]
    before, earlier = np.zeros_like(c), np.zeros_like(c)
    before[1:] = c[:-1]
    before[starts] = 0
    earlier[1:] = before[:-1]
    earlier[starts] = 0
    two = c + before * np.uint32(160)
    three = two + earlier * np.uint32(25600)
    shift = np.uint32(32 - (BITS - 1))
    hashed = lambda x: (x * np.uint32(2654435761)) >> shift
    return hashed(two), hashed(three) + np.uint32(1 << (BITS - 1))


def features(column: pa.Array) -> np.ndarray:
    """A row of relative gram frequencies per text."""
    data, at = text_bytes(column)
    size = 1 << BITS
    out = np.zeros((len(at) - 1, size), np.float32)
    for k in range(len(at) - 1):
        if at[k + 1] > at[k]:
            for index in grams(data[at[k] : at[k + 1]], np.zeros(1, np.int64)):
                out[k] += np.bincount(index, minlength=size)
            out[k] /= at[k + 1] - at[k]
    return out


class Machine(NamedTuple):
    """Positive side says ``a``, negative side says ``b``."""

    a: str
    b: str
    weights: np.ndarray
    bias: float


def fit_pair(x: np.ndarray, y: np.ndarray, rounds: int = 300, keep: float = 1e-4) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, classes weighed alike, by accelerated gradient descent."""
    scale = 1 / np.sqrt(x.mean(0) + 1e-4)
    z = np.c_[x * scale, np.ones(len(x), np.float32)]
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    step = 1 / (2 * float((share * (z * z).sum(1)).sum()) + keep)
    w = np.zeros(z.shape[1], np.float32)
    ahead = w
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (z @ ahead))
        new = ahead - step * (keep * ahead - 2 * z.T @ (share * y * slack))
        ahead = new + k / (k + 3) * (new - w)
        w = new
    return (w[:-1] * scale).astype(np.float32), float(w[-1])


class Model(NamedTuple):
    families: dict[str, list[str]]
    between: list[Machine]
    within: dict[str, list[Machine]]


def fit(langs: list[str], x: np.ndarray) -> Model:
    names = np.array(langs, dtype=object)
    groups: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        groups.setdefault(family(lang), []).append(lang)

    def machines(label: np.ndarray, classes: list[str]) -> list[Machine]:
        out = []
        for a, b in combinations(classes, 2):
            rows = (label == a) | (label == b)
            out.append(Machine(a, b, *fit_pair(x[rows], np.where(label[rows] == a, 1, -1).astype(np.float32))))
        return out

    kin = np.array([family(lang) for lang in langs], dtype=object)
    return Model(groups, machines(kin, sorted(groups)), {f: machines(names, members) for f, members in groups.items()})


def _vote(margins: dict[tuple[str, str], np.ndarray], classes: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Winner by one-versus-one votes (ties: by summed margins), and how sure its closest contest was."""
    if len(classes) == 1:
        return np.zeros(n, np.int64), np.ones(n)
    votes, total, least = (np.full((len(classes), n), v) for v in (0.0, 0.0, np.inf))
    for (a, b), m in margins.items():
        for name, s in ((a, m), (b, -m)):
            k = classes.index(name)
            votes[k] += s > 0
            total[k] += np.tanh(s)
            least[k] = np.minimum(least[k], s)
    best = np.argmax(votes + total / (4 * len(classes)), axis=0)
    return best, 1 / (1 + np.exp(-3 * np.clip(least[best, np.arange(n)], -20, 20)))


def predict(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; a text without grams gets the first language and a low score."""
    data, at = text_bytes(column)
    n = len(at) - 1
    length = np.maximum(at[1:] - at[:-1], 1)
    filled = np.flatnonzero(at[1:] > at[:-1])
    two, three = grams(data, at[filled])

    def margin(m: Machine) -> np.ndarray:
        out = np.full(n, m.bias)
        if len(filled):
            out[filled] += np.add.reduceat((m.weights[two] + m.weights[three]).astype(np.float64), at[filled]) / length[filled]
        return out

    groups = sorted(model.families)
    kin, sure = _vote({(m.a, m.b): margin(m) for m in model.between}, groups, n)
    out, score = np.empty(n, dtype=object), np.zeros(n)
    for k, name in enumerate(groups):
        rows = kin == k
        if rows.any():
            members = model.families[name]
            best, inner = _vote({(m.a, m.b): margin(m)[rows] for m in model.within[name]}, members, int(rows.sum()))
            out[rows] = np.array(members, dtype=object)[best]
            score[rows] = sure[rows] * inner
    return out.tolist(), score


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, languages: int = LANGUAGES) -> Model | None:
    """Fits the machines on at most ``per_language`` rows, with the lowest hash of their key, of the ``languages`` most frequent languages."""
    marked = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter("lang is not null and key is not null")
    frequent = marked.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(languages).select("lang")
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.col("key").cast("string")), "key")
    labelled = marked.select("key", "lang").join(F.broadcast(frequent), "lang")
    chosen = labelled.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_language).select("key", "lang").distinct()
    sample = marked.join(chosen, ["key", "lang"], "left_semi").select("lang", "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 21):
            x = features(part.column("text")).astype(np.float16)
            yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])

    got = sorted((r.lang, bytes(r.x)) for r in sample.mapInArrow(rows, "lang string, x binary").collect())
    if not got:
        return None
    return fit([g[0] for g in got], np.array([np.frombuffer(g[1], np.float16) for g in got]).astype(np.float32))


def identify(docs: DataFrame, model: Model | None, keep: list[str | Column], text: str = "text") -> DataFrame:
    """The columns ``keep`` of every row, with ``lang_pred`` and ``score``."""
    body = F.when(F.col(text).rlike(r"\p{L}"), F.col(text))
    (name,) = fresh(docs, "_text")
    rows = docs.select(*keep, body.alias(name))
    if model is None:
        return rows.select(*rows.columns[:-1], F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, name, 1 << 20):
            column = part.column(name)
            langs, score = predict(shared.value, column)
            known = np.asarray(column.is_valid())
            langs = [x if ok else UNKNOWN for x, ok in zip(langs, known, strict=True)]
            columns = [part.column(c) for c in part.schema.names if c != name]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(langs, pa.string()), pa.array(np.where(known, score, 0.0), pa.float64())],
                [*(c for c in part.schema.names if c != name), "lang_pred", "score"],
            )

    schema = rows.drop(name).schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(run, schema)


class Profile(NamedTuple):
    """By language: log-probabilities of trigrams, least mean of a text, spread of one trigram, least share of letters."""

    langs: list[str]
    logs: np.ndarray
    least: np.ndarray
    spread: np.ndarray
    letters: np.ndarray


def letter_trigrams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams ending at a letter, the text each belongs to, and letters and other visible bytes per text."""
    n = len(at) - 1
    c = _CLASS[LOWER[data]]
    starts = at[:-1][at[1:] > at[:-1]]
    before, earlier = np.zeros_like(c), np.zeros_like(c)
    before[1:] = c[:-1]
    before[starts] = 0
    earlier[1:] = before[:-1]
    earlier[starts] = 0
    hashed = ((c + before * np.uint32(160) + earlier * np.uint32(25600)) * np.uint32(2654435761)) >> np.uint32(32 - PROFILE_BITS)
    of = np.repeat(np.arange(n), np.diff(at))
    letter = c > 0
    return hashed[letter], of[letter], np.bincount(of[letter], minlength=n), np.bincount(of[~letter & (data > 0x20)], minlength=n)


def profile(docs: DataFrame, text: str = "text", lang: str = "lang") -> Profile | None:
    """Trigram profiles of all labelled rows, and the bounds that they give."""
    size = 1 << PROFILE_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 4 << 20):
            names, label = np.unique(np.array(part.column("lang").to_pylist(), dtype=object).astype(str), return_inverse=True)
            grams_, of, _, others = letter_trigrams(*text_bytes(part.column("text")))
            # The last place counts what is visible and no letter.
            counts = np.zeros((len(names), size + 1), np.int64)
            for k in range(len(names)):
                counts[k, :size] = np.bincount(grams_[label[of] == k], minlength=size)
                counts[k, size] = others[label == k].sum()
            row, gram = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(names[row].tolist(), pa.string()), pa.array(gram), pa.array(counts[row, gram])], ["lang", "gram", "n"])

    labelled = docs.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    got = labelled.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs, row = np.unique(np.array(got.column("lang").to_pylist(), dtype=object).astype(str), return_inverse=True)
    if not len(langs):
        return None
    counts = np.zeros((len(langs), size + 1))
    counts[row, got.column("gram").to_numpy()] = got.column("n").to_numpy()
    counts, others = counts[:, :size], counts[:, size]
    total = counts.sum(1)
    room = np.log(total + UNSEEN * size)[:, None]
    logs = np.log(counts + UNSEEN) - room
    # A language's own occurrences are each judged by the counts without it.
    own = np.log(np.maximum(counts - 1, 0) + UNSEEN) - room
    each = np.maximum(total, 1)
    mean = (counts * own).sum(1) / each
    spread = np.sqrt((counts * (own - mean[:, None]) ** 2).sum(1) / each)
    # How the other languages' texts look here, languages weighed alike; with no other one, letters at random.
    shares = counts[total > 0] / total[total > 0, None]
    under = logs @ shares.T
    others_mean = logs.mean(1)
    for k in range(len(langs)):
        rest = under[k][np.flatnonzero(total > 0) != k]
        if len(rest):
            others_mean[k] = rest.mean()
    return Profile(langs.tolist(), logs.astype(np.float32), mean + FAR * (others_mean - mean), spread, LETTERS * total / np.maximum(total + others, 1))


def fits(known: Profile, langs: list[str], column: pa.Array) -> np.ndarray:
    """Whether each text is in the language it is said to be in."""
    place = {name: k for k, name in enumerate(known.langs)}
    lang = np.array([place.get(x, -1) for x in langs], np.int64)
    grams_, of, letters, others = letter_trigrams(*text_bytes(column))
    mean = np.bincount(of, known.logs[lang[of], grams_], len(lang)) / np.maximum(letters, 1)
    ok = (lang >= 0) & (letters > 0)
    ok &= mean >= known.least[lang] - ERRORS * known.spread[lang] / np.sqrt(np.maximum(letters, 1))
    return ok & (letters >= known.letters[lang] * (letters + others))


def identify_known(docs: DataFrame, model: Model | None, known: Profile | None, text: str = "text") -> DataFrame:
    """The rows whose text is in a language that was learnt, unchanged; one pass predicts and judges."""
    if model is None or known is None:
        return docs.limit(0)
    shared = docs.sparkSession.sparkContext.broadcast((model, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value
        for part in slices(batches, text, 1 << 20):
            column = part.column(text)
            yield part.filter(pa.array(fits(known, predict(model, column)[0], column)))

    return docs.filter(F.col(text).rlike(r"\p{L}")).mapInArrow(run, docs.schema)
