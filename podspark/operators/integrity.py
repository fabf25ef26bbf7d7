"""Referential checks and deletes that cascade."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of ``child`` whose key is set but not in ``parent``."""
    keys = parent.select(F.col(parent_key).alias("_parent"))
    return child.filter(F.col(child_key).isNotNull()).join(keys, F.col(child_key) == F.col("_parent"), "left_anti")


def orphan_report(videos: DataFrame, transcriptions: DataFrame, segments: DataFrame, insights: DataFrame) -> DataFrame:
    """Orphans per relation."""
    checks = {
        "transcriptions": orphans(transcriptions, videos, "video_id", "video_id"),
        "segments": orphans(segments, transcriptions, "transcription_id", "id"),
        "insights": orphans(insights, videos, "video_id", "video_id"),
    }
    counts = [rows.agg(F.count("*").alias("orphans")).select(F.lit(name).alias("relation"), "orphans") for name, rows in checks.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def cascade_delete(videos: DataFrame, transcriptions: DataFrame, segments: DataFrame, insights: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The four tables without the videos of ``deleted`` (video_id) and all that hangs on them."""
    keys = deleted.select("video_id").distinct()
    gone = transcriptions.join(keys, "video_id", "left_semi").select(F.col("id").alias("transcription_id"))
    without = lambda df: df.join(keys, "video_id", "left_anti").select(*df.columns)
    return without(videos), without(transcriptions), segments.join(gone, "transcription_id", "left_anti").select(*segments.columns), without(insights)
