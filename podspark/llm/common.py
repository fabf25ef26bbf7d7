"""Helpers shared by the training-data operators: word patterns, checked broadcasts, lineage cuts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from podspark.sources.tables import broadcast_if_small, checkpoint_root, shared_folder, stored

__all__ = ["SPACES", "UPPER", "WORD", "ascii_lower", "broadcast_if_small", "cut", "fresh", "held", "key_filter", "let", "shared_folder", "stored", "stored_small", "table", "words_of"]

#: Words are maximal runs of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The same white space as plain characters, for translate().
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Filters of keys: at most so many words of 64 bits (4 MB), words that stand in one row, keys that share a word when there are fewer, bits that a key sets.
FILTER_WORDS, FILTER_ROW, KEYS_A_WORD, KEY_BITS = 1 << 19, 1 << 9, 2, 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text, UPPER, UPPER.lower())


def words_of(text: Column, pattern: str = WORD) -> Column:
    """Array of the words of a text; null counts as empty."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it any number of times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def cut(df: DataFrame) -> DataFrame:
    """Store a DataFrame in the shared checkpoint folder and go on from there."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def stored_small(df: DataFrame, max_rows: int) -> DataFrame:
    """The DataFrame written down once, then marked for broadcast if it has at most ``max_rows`` rows."""
    return broadcast_if_small(stored(df), max_rows)[0]


def _key_mask(key: Column) -> Column:
    mask = F.lit(0).cast("bigint")
    for k in range(KEY_BITS):
        place = F.shiftrightunsigned(key, 20 + 6 * k).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), place))
    return mask


def key_filter(keys: DataFrame, key: str, count: int) -> tuple[DataFrame, int]:
    """A filter of ``count`` keys, which are 64-bit hashes, marked for broadcast, and its number of words.

    It has about four bytes a key and at most ``FILTER_WORDS`` words, whatever the keys number, so the driver never holds
    a table of keys.  See ``held``.
    """
    words = min(FILTER_WORDS, 1 << max(6, (count // KEYS_A_WORD).bit_length()))
    spark = keys.sparkSession
    word = F.col(f"`{key}`").bitwiseAND(F.lit(words - 1))
    none = spark.range(0, words, 1, 1 + (words >> 17)).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    every = keys.select(word.alias("word"), _key_mask(F.col(f"`{key}`")).alias("bits")).unionByName(none).withColumn("place", F.shiftright("word", FILTER_ROW.bit_length() - 1))
    full = every.repartition("place").groupBy("place", "word").agg(F.bit_or("bits").alias("bits"))
    rows = full.groupBy("place").agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("bits"))
    return F.broadcast(stored(rows.coalesce(1))), words


def held(df: DataFrame, key: str, found: tuple[DataFrame, int], how: str = "left_semi") -> DataFrame:
    """The rows of ``df`` whose ``key`` is in a filter: all whose key is among its keys, and few others. With ``left_anti`` the rest."""
    rows, words = found
    mine = F.col(f"_rows.`{key}`")
    word = mine.bitwiseAND(F.lit(words - 1))
    mask = _key_mask(mine)
    bits = F.col("_filter.bits")[word.bitwiseAND(F.lit(FILTER_ROW - 1)).cast("int")]
    return df.alias("_rows").join(rows.alias("_filter"), (F.shiftright(word, FILTER_ROW.bit_length() - 1) == F.col("_filter.place")) & (bits.bitwiseAND(mask) == mask), how)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of ``df`` has, whatever its letter case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
