"""Incremental sync: landed speech-to-text responses are processed once each.

Each micro-batch drops what already has a transcription, so a replayed file changes nothing.
Insights are written before transcriptions: a run that breaks off in between leaves the video in the
backlog.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from podspark import schemas
from podspark.functions import text as T
from podspark.plans import jobs
from podspark.sources import tables as S

LANDED = "video_id string, podcast string, response string"
_TABLES = {"videos": (schemas.VIDEOS, "video_id"), "transcriptions": (schemas.TRANSCRIPTIONS, "video_id"), "segments": (schemas.SEGMENTS, "transcription_id"), "insights": (schemas.INSIGHTS, "video_id"), "seed_links": (schemas.SEED_LINKS, "video_id")}
#: In this order; what marks a video as done comes last.
_WRITTEN = ("insights", "segments", "videos", "transcriptions")


def create_tables(spark: SparkSession, root: str, buckets: int = S.BUCKETS) -> None:
    """Empty tables below ``root``."""
    for name, (schema, key) in _TABLES.items():
        S.write_table(spark.createDataFrame([], schema), f"{root}/{name}", key, buckets)


def read_tables(spark: SparkSession, root: str) -> jobs.Tables:
    return jobs.Tables(**{name: S.read_table(spark, f"{root}/{name}", schema) for name, (schema, _) in _TABLES.items()})


def process_batch(spark: SparkSession, root: str, landed: DataFrame, templates: dict[str, Column], answer: Callable[[str, str], str], now: Column, buckets: int = S.BUCKETS) -> None:
    """One micro-batch; of every table only the buckets that the batch touches are read and written."""
    # Of several responses for a video one is taken, the same one however often this is computed.
    one = S.stored(landed.filter("video_id is not null").groupBy("video_id").agg(F.min(F.struct("podcast", "response")).alias("r")).select("video_id", "r.podcast", "r.response"))
    keys = {"video_id": one.select("video_id"), "transcription_id": one.select(T.deterministic_id(F.lit("transcription"), F.col("video_id")).alias("transcription_id"))}
    parts, numbers = {}, {}
    for name in _WRITTEN:
        schema, key = _TABLES[name]
        parts[name], numbers[name] = S.touched(spark, f"{root}/{name}", schema, keys[key], key, buckets)
    old = jobs.Tables(**parts, seed_links=S.empty(spark, schemas.SEED_LINKS))
    open_ = one.join(old.transcriptions.select("video_id"), "video_id", "left_anti")
    new, _ = jobs.process(old, open_, templates, answer, now)
    for name in _WRITTEN:
        S.overwrite_buckets(getattr(new, name), f"{root}/{name}", _TABLES[name][1], numbers[name], buckets)


def sync(spark: SparkSession, landing: str, root: str, checkpoint: str, templates: dict[str, Column], answer: Callable[[str, str], str], buckets: int = S.BUCKETS) -> StreamingQuery:
    """Processes everything that has landed since the last run, then stops."""
    stream = spark.readStream.schema(LANDED).json(landing)
    return (
        stream.writeStream.foreachBatch(lambda df, _: process_batch(df.sparkSession, root, df, templates, answer, F.current_timestamp(), buckets))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
