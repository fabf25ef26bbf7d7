"""Contiguous shards of nearly equal bytes by global prefix sums.

Documents are put in the order of their ids by a range exchange.  Each range is numbered; its
total of bytes and rows is one row of a small table whose prefix sums say where the range begins
in the whole.  Running sums inside the ranges, which are worked out side by side, then give every
document its first byte in the whole, and the shard is the one of ``shards`` equal stretches of
bytes that holds the document's middle.  So shards are contiguous in the order of ids, and each
differs from an equal share by less than its two border documents.

The order is id (null first), checksum, size, and then the place in the input, which only decides
between rows whose result is the same; so one id, or none, in a third of all rows is spread over
ranges like any other, and reruns give the same rows.  Only ids, sizes and checksums are moved
unless the documents are to be written.

Defined results: a null or empty text has size 1 and checksum 0; rows without an id come first;
repeated rows are documents of their own; with fewer documents than shards some shards stay empty;
an empty table gives an empty result; other input columns are dropped by ``assign`` and kept,
whatever their names, by ``write_shards``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from podspark.llm.common import broadcast_if_small, stored

SHARDS = 8
LAW = "bytes"
#: The table of range totals has one row per shuffle partition; it is broadcast up to this number.
BROADCAST_RANGES = 1_000_000


def _placed(docs: DataFrame, key: str, text: str, shards: int, whole_rows: bool) -> DataFrame:
    """Rows with key, size, crc, shard and slot, and with ``whole_rows`` the row itself."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    value = F.col(f"`{text}`")
    columns = [
        F.col(f"`{key}`").alias("key"),
        (F.coalesce(F.octet_length(value), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(value), F.lit(0)).cast("long").alias("crc"),
    ]
    if whole_rows:
        columns.append(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    order = ["key", "crc", "size", "at"]
    ranged = stored(docs.select(*columns).withColumn("at", F.monotonically_increasing_id()).repartitionByRange(*order).withColumn("part", F.spark_partition_id()))

    # Prefix sums over one row per range.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    bases = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base_bytes"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base_rows"),
        F.sum("bytes").over(Window.partitionBy()).alias("total"),
    )
    bases, _ = broadcast_if_small(stored(bases), BROADCAST_RANGES)

    # Running sums inside each range; twice the byte in the middle of a document says which stretch it is in.
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = (
        ranged.withColumn("upto", F.sum("size").over(inside))
        .withColumn("nth", F.count("*").over(inside))
        .join(bases, "part")
        .withColumn("middle", 2 * (F.col("base_bytes") + F.col("upto")) - F.col("size"))
        .withColumn("shard", F.expr(f"CAST(middle * {shards} DIV (2 * total) AS INT)"))
        .withColumn("index", F.col("base_rows") + F.col("nth") - 1)
    )
    first = stored(numbered.groupBy("shard").agg(F.min("index").alias("first")))
    first, _ = broadcast_if_small(first, BROADCAST_RANGES)
    kept = ["key", "size", "crc", "shard", *(["row"] if whole_rows else [])]
    return numbered.join(first, "shard").select(*kept, (F.col("index") - F.col("first")).alias("slot"))


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """Per document: its id (named ``key``), size, text_crc32, law, shard, slot (gapless from 0 in each shard)."""
    found = _placed(docs, key, text, shards, False)
    return found.select(F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit(LAW).alias("law"), "shard", "slot")


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", shards: int = SHARDS, rows_per_file: int = 1_000_000) -> None:
    """The whole rows as Parquet, one folder ``shard=N`` per shard, with ``slot`` as their order in it.

    Each row is written as ``row`` (the input columns) and ``slot``; files hold ``rows_per_file`` rows at most.
    """
    found = _placed(docs, key, text, shards, True).select("row", "slot", "shard")
    found.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)
