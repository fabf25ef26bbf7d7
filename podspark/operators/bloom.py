"""Key filters before anti-joins: which rows surely have no parent, without moving them.

A filter is a table of at most ``words`` rows (``word``, ``bits``): a parent key sets ``BITS`` bits of one 64-bit
word, and partial aggregation takes the bits of a task together before anything is shuffled.  Its size is
bounded by the number of words whatever the parents number, so it can always be broadcast.  A key without all its
bits is in no parent; a key with them may be a wrong hit, which is settled by an anti-join of the distinct keys
that hit.  So rows of the child are not shuffled, its keys only, once each per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, FractionalType, IntegralType

from podspark.sources.tables import broadcast_if_small, stored

#: Words of a filter (16 bytes each with their number), and parent keys that share a word when there are fewer.
MAX_WORDS, KEYS_A_WORD = 1 << 20, 4
#: Bits that a key sets.
BITS = 5
#: Wrong hits are broadcast only up to this number.
BROADCAST_KEYS = 1_000_000


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), key.cast("string")), F.lit(words))


def _mask(key: Column) -> Column:
    """Up to ``BITS`` bits, each from six bits of a second hash."""
    hash_ = F.xxhash64(F.lit(2), key.cast("string"))
    mask = F.lit(0).cast("bigint")
    for k in range(BITS):
        place = F.shiftrightunsigned(hash_, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), place))
    return mask


def words_for(keys: int, most: int = MAX_WORDS) -> int:
    """The number of words for so many keys: a power of two, at most ``most``."""
    return min(most, 1 << max(6, (keys // KEYS_A_WORD).bit_length()))


def key_filter(parent: DataFrame, key: str, words: int) -> DataFrame:
    """``word``, ``bits`` of all keys that are not null; at most ``words`` rows."""
    keys = parent.filter(F.col(key).isNotNull()).select(_word(F.col(key), words).alias("word"), _mask(F.col(key)).alias("mask"))
    return keys.groupBy("word").agg(F.bit_or("mask").alias("bits"))


def _hit(key: Column, words: int) -> Column:
    mask = _mask(key)
    return (_word(key, words) == F.col("_bloom.word")) & (F.col("_bloom.bits").bitwiseAND(mask) == mask)


def _check_types(child: DataType, parent: DataType) -> None:
    whole = isinstance(child, IntegralType) and isinstance(parent, IntegralType)
    if not whole and (child != parent or isinstance(child, FractionalType)):
        raise ValueError(f"keys of types {child.simpleString()} and {parent.simpleString()} may be equal under different texts")


def missing(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, most: int = MAX_WORDS, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Rows of ``child`` whose key is set but not in ``parent``: the same rows as by ``integrity.orphans``.

    Rows with a null key are left out; repeated rows are kept; without parents every row with a key is in
    the result; other columns may have any names.  Keys are whole numbers, or of one type that is no fraction.
    ``child`` is read twice: for its keys, and for the rows that go out.
    """
    _check_types(child.schema[child_key].dataType, parent.schema[parent_key].dataType)
    words = words_for(parent.count(), most)
    found = F.broadcast(stored(key_filter(parent, parent_key, words))).alias("_bloom")
    rows = child.filter(F.col(child_key).isNotNull()).alias("_rows")
    key, wrong_key = F.col(f"_rows.`{child_key}`"), F.col("_wrong._key")
    hits = rows.join(found, _hit(key, words), "left_semi").select(key.alias("_key")).distinct().alias("_wrong")
    parents = parent.select(F.col(parent_key).alias("_parent"))
    wrong, _ = broadcast_if_small(stored(hits.join(parents, wrong_key == F.col("_parent"), "left_anti")), broadcast_keys)
    sure = rows.join(found, _hit(key, words), "left_anti")
    return sure.unionByName(rows.join(wrong.alias("_wrong"), key == wrong_key, "left_semi"))
