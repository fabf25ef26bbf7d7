"""First occurrences and latest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from podspark.functions import text as T


def first_occurrences(rows: DataFrame, least: int) -> DataFrame:
    """One row per video from rows with file_rank, line_no, video_id, duration_seconds.

    In a file the first line of an id stands for it, even if it is then too short; of the files in
    which an id is left the first one wins.  Both steps use one partitioning on video_id.
    """
    by_file = Window.partitionBy("video_id", "file_rank").orderBy("line_no")
    by_id = Window.partitionBy("video_id").orderBy("file_rank", "line_no")
    kept = rows.filter(F.col("video_id").isNotNull()).repartition("video_id").withColumn("_n", F.row_number().over(by_file)).filter("_n = 1")
    kept = kept.filter(T.long_enough(F.col("duration_seconds"), least))
    return kept.withColumn("_n", F.row_number().over(by_id)).filter("_n = 1").drop("_n")


def latest_per_channel(videos: DataFrame, n: int) -> DataFrame:
    """The newest n videos of each channel; Spark limits each task's groups before it shuffles."""
    newest = Window.partitionBy("channel_id").orderBy(F.col("published_at").desc_nulls_last(), F.col("video_id"))
    return videos.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= n).drop("_n")
