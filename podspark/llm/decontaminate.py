"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

Items are cut into windows of ``width`` consecutive words (an item of fewer words is one window).
A document holds a window only if it holds the window's rarest word, so that word is the prefix
that must match: words are ordered by how often they occur in all documents, each window is
joined by its rarest word, the implied start must lie inside the document (positional bound) and
leave room for the window (length bound), and what is left is compared word by word.

Defined results: null and empty texts have no words; null and wordless items have no windows;
repeated documents get a row each, and rows with one key are judged each by its own text; keys may be
null; repeated items are counted by ``item_id``; an empty benchmark leaves every document clean; other
input columns are dropped.  A document's words are one array in one row, so a text has to fit into
a task's memory several times over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podspark.llm.common import ascii_lower, broadcast_if_small, stored, stored_small, words_of

#: ASCII letters and digits, and everything outside ASCII.
TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH = 10
#: Windows (up to ``width`` words each) are broadcast only up to this number; beyond it they are shuffled.
BROADCAST_WINDOWS = 50_000
#: Single words are broadcast only up to this number.
BROADCAST_WORDS = 500_000


def tokens(text: Column) -> Column:
    return words_of(ascii_lower(text), TOKEN)


def windows_of(items: DataFrame, item: str = "item_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """The windows of every item, each once: ``item``, ``window`` (array)."""
    words, n = F.col("words"), F.size("words")
    starts = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(n - (width - 1), F.lit(1))))
    return (
        items.select(F.col(item).cast("string").alias("item"), tokens(F.col(text)).alias("words"))
        .select("item", F.explode(F.transform(starts, lambda i: F.slice(words, i, width))).alias("window"))
        .distinct()
    )


def _rarest(windows: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """Each window with its rarest word and that word's offset, by counts over the words of all documents."""
    vocabulary = stored_small(windows.select(F.explode("window").alias("word")).distinct(), BROADCAST_WORDS)
    counts = docs.select(F.explode(tokens(F.col(text))).alias("word")).join(vocabulary, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    first = (
        windows.select("window", F.posexplode("window").alias("offset", "word"))
        .join(counts, "word", "left")
        .groupBy("window")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "offset")).alias("first"))
    )
    return first.filter("first.n > 0").select("window", F.col("first.word").alias("word"), F.col("first.offset").alias("offset"))


def matches(docs: DataFrame, windows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per occurrence of one of ``windows`` (``window``): key, ``text_hash``, ``start`` (0-based word), ``length``, ``window``."""
    prefix, small = broadcast_if_small(stored(_rarest(stored(windows.select("window").distinct()), docs, text)), BROADCAST_WINDOWS)
    body = docs.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), tokens(F.col(text)).alias("words"))
    start, fits = F.col("pos") - F.col("offset"), (F.col("pos") >= F.col("offset")) & (F.col("pos") - F.col("offset") + F.size("window") <= F.col("n_words"))
    if small:
        at = body.select("*", F.size("words").alias("n_words"), F.posexplode("words").alias("pos", "word")).join(prefix, "word").filter(fits)
    else:
        # Only words that are some window's rarest are shuffled; the words of a text follow for what is left.
        asked = stored_small(prefix.select("word").distinct(), BROADCAST_WORDS)
        found = body.select("key", "text_hash", F.size("words").alias("n_words"), F.posexplode("words").alias("pos", "word")).join(asked, "word", "left_semi")
        at = found.join(prefix, "word").filter(fits).select("key", "text_hash", "pos", "offset", "window")
        # By the text alone: a null key equals nothing in a join.
        at = at.join(body.select("text_hash", "words").dropDuplicates(["text_hash"]), "text_hash")
    hits = at.filter(F.slice("words", start + 1, F.size("window")) == F.col("window"))
    return hits.select(F.col("key").alias(key), "text_hash", start.alias("start"), F.size("window").alias("length"), "window")


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Per document: key, n_words, n_hit, ``items`` (sorted item ids), contaminated."""
    windows = stored(windows_of(items, text=text, width=width))
    found = stored(matches(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), windows, "_key", "_text").withColumnRenamed("text_hash", "_hash"))
    places = F.flatten(F.transform(F.col("spans"), lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)))
    hit = found.groupBy("_key", "_hash").agg(F.collect_set(F.struct("start", "length")).alias("spans")).select("_key", "_hash", F.size(F.array_distinct(places)).cast("long").alias("n_hit"))
    # The items of a window are looked up for what has been found only.
    had = found.select("_key", "_hash", "window").distinct().join(windows, "window").select("_key", "_hash", "item").distinct()
    had = had.groupBy("_key", "_hash").agg(F.array_sort(F.collect_list("item")).alias("items"))
    same = lambda a, b: a["_key"].eqNullSafe(b["_key"]) & (a["_hash"] == b["_hash"])
    both = stored_small(hit.alias("h").join(had.alias("i"), F.col("h._key").eqNullSafe(F.col("i._key")) & (F.col("h._hash") == F.col("i._hash"))).select("h.*", "items"), BROADCAST_WORDS)
    body = F.coalesce(F.col(text), F.lit(""))
    every = docs.select(F.col(key).alias("_key"), F.xxhash64(body).alias("_hash"), F.regexp_count(ascii_lower(body), F.lit(TOKEN)).cast("long").alias("n_words"))
    return every.join(both, same(every, both), "left").select(
        every["_key"].alias(key),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )
