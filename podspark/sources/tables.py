"""Tables as Parquet in hash buckets of the key, so that an upsert rewrites the buckets it touches.

Also what jobs share: folders for intermediate tables, tables stored in them, and broadcasts of a checked size.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

BUCKETS = 256


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """A table without rows that Spark knows to be empty, so that what joins or merges it is left out of a plan."""
    return spark.range(1).filter(F.lit(False)).select(F.from_json(F.lit("{}"), schema).alias("s")).select("s.*")


def write_table(df: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """The whole table, one partition folder per bucket."""
    df.withColumn("bucket", bucket_of(F.col(key), buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, bucket int").parquet(path).drop("bucket")


def touched(spark: SparkSession, path: str, schema: str, keys: DataFrame, key: str, buckets: int = BUCKETS) -> tuple[DataFrame, list[int]]:
    """Rows of the buckets that hold any of ``keys``, and the numbers of those buckets (at most ``buckets``)."""
    numbers = sorted(r[0] for r in keys.select(bucket_of(F.col(key), buckets)).distinct().collect())
    rows = spark.read.schema(f"{schema}, bucket int").parquet(path).filter(F.col("bucket").isin(numbers)).drop("bucket")
    return rows, numbers


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder, wherever Spark reads it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def overwrite_buckets(df: DataFrame, path: str, key: str, numbers: list[int], buckets: int = BUCKETS) -> None:
    """Replaces the touched buckets ``numbers`` by ``df``, which was read from them; a bucket that ``df`` has no row for becomes empty.

    ``df`` is staged in a folder of its own next to the table first.  If a run breaks off between the steps, the
    buckets written so far are complete, and the same run made again ends with the same table.
    """
    staged = f"{path}_staged/{uuid.uuid4()}"
    spark = df.sparkSession
    df.withColumn("bucket", bucket_of(F.col(key), buckets)).repartition("bucket").write.partitionBy("bucket").parquet(staged)
    rows = spark.read.schema(StructType([*df.schema.fields, StructField("bucket", IntegerType())])).parquet(staged)
    filled = {r[0] for r in rows.select("bucket").distinct().collect()}
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    for number in numbers:
        if number not in filled:
            remove(spark, f"{path}/bucket={number}")
    remove(spark, staged)


def write_documents(documents: DataFrame, path: str) -> None:
    """The search documents in one bulk write."""
    documents.write.mode("overwrite").json(path)


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only where none is set and all runs on this machine."""
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if context.master.partition("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
        known = context._jsc.sc().getCheckpointDir()
    return known.get()


def _own_root(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/{spark.sparkContext.applicationId}"


def shared_folder(spark: SparkSession) -> str:
    """A new folder for intermediate data, below the shared checkpoint folder and there below this application's."""
    return f"{_own_root(spark)}/{uuid.uuid4()}"


def clear_intermediates(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application; to be called when no result that reads them is needed any more."""
    remove(spark, _own_root(spark))


def stored(df: DataFrame) -> DataFrame:
    """Written as a table into the shared folder and read from there: what is costly is computed once."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def broadcast_if_small(df: DataFrame, max_rows: int) -> tuple[DataFrame, bool]:
    """Mark ``df`` for broadcast only after counting that it has at most ``max_rows`` rows."""
    small = df.limit(max_rows + 1).count() <= max_rows
    return (F.broadcast(df) if small else df), small
