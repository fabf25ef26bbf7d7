"""Episode link lists: CSV files per show and JSON batches."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from podspark import schemas
from podspark.functions import text as T
from podspark.operators.dedupe import first_occurrences
from podspark.sources.tables import broadcast_if_small

#: Names of link files are broadcast only up to this number.
BROADCAST_FILES = 100_000
_LINK = "file_rank int, line_no bigint, video_id string, title string, duration_seconds int, podcast string, url string"


def read_lines(spark: SparkSession, path: str, podcast: str | None, rank: int) -> DataFrame:
    """Lines of one headerless CSV file; a missing file has none.

    A file is read as one split (quotes may hold line ends), so ids grow with the lines.
    """
    try:
        raw = spark.read.csv(path, schema=schemas.SEED_CSV, multiLine=True, quote='"', escape='"', mode="PERMISSIVE")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _LINK)
    show: Column = F.lit(podcast) if podcast else T.infer_podcast(F.lit(path))
    return raw.withColumn("line_no", F.monotonically_increasing_id()).select(*link_columns(show, F.lit(rank)))


def link_columns(podcast: Column, rank: Column) -> list[Column]:
    """Columns of a link out of url, duration, title and line_no."""
    url = T.strip(F.coalesce("url", F.lit("")))
    return [rank.cast("int").alias("file_rank"), F.col("line_no").cast("bigint").alias("line_no"), T.extract_video_id(url).alias("video_id"), F.coalesce("title", F.lit("")).alias("title"), T.parse_duration(F.coalesce("duration", F.lit(""))).alias("duration_seconds"), podcast.alias("podcast"), url.alias("url")]


def read_seed_csv(spark: SparkSession, path: str, podcast: str | None = None, least: int = schemas.MIN_DURATION) -> DataFrame:
    return first_occurrences(read_lines(spark, path, podcast, 0), least)


def read_seed_csvs(spark: SparkSession, paths: Mapping[str, str] | None = None, least: int = schemas.MIN_DURATION) -> DataFrame:
    """All files in the order of the mapping, without one those at the default places; the first occurrence of a video wins."""
    rows = spark.createDataFrame([], _LINK)
    for rank, (podcast, path) in enumerate((paths or schemas.DEFAULT_CSVS).items()):
        rows = rows.unionByName(read_lines(spark, path, podcast, rank))
    return first_occurrences(rows, least)


def links_of(batches: DataFrame, rank: Column | None = None) -> DataFrame:
    """Rows of JSON batches already read with the batch schema, with defaults and ``seq``.

    ``rank`` is the place of a row's batch among all batches (below 2^31); a batch holds at most 2^32 links.
    """
    rows = batches.select((F.lit(0) if rank is None else rank).cast("bigint").alias("rank"), F.posexplode("links").alias("pos", "l"))
    text = lambda c: F.coalesce(F.col(f"l.{c}"), F.lit("")).alias(c)
    return rows.select("l.video_id", "l.podcast", text("title"), "l.duration_seconds", text("url"), (F.col("rank") * (1 << 32) + F.col("pos")).alias("seq"))


def read_link_batches(spark: SparkSession, path: str) -> DataFrame:
    """The batches of a folder, one per file, in the order of the files' names."""
    read = spark.read.schema(schemas.LINK_BATCH).json(path, multiLine=True).select("links", F.col("_metadata.file_path").alias("file"))
    # One row per file is ranked, not the links.
    files = read.select("file").distinct().withColumn("rank", F.row_number().over(Window.orderBy("file")))
    files, _ = broadcast_if_small(files, BROADCAST_FILES)
    return links_of(read.join(files, "file"), F.col("rank"))
