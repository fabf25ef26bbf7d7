"""Channel listings and video details as they landed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podspark import schemas
from podspark.functions import text as T
from podspark.operators.dedupe import latest_per_channel


def default_handles(spark: SparkSession) -> DataFrame:
    """podcast and handle of the shows known from the start."""
    return spark.createDataFrame(list(schemas.DEFAULT_HANDLES.items()), "podcast string, handle string")


def channels_of(podcasts: DataFrame, overrides: DataFrame, defaults: DataFrame | None, channels: DataFrame) -> DataFrame:
    """podcast and channel_id; shows without a handle, or whose handle no channel has, are left out.

    Without ``defaults`` those of ``default_handles`` hold.  All four tables are a few rows per show: overrides and defaults (podcast, handle), channels (handle, channel_id).
    """
    defaults = default_handles(podcasts.sparkSession) if defaults is None else defaults
    named = podcasts.select("podcast").distinct()
    named = named.join(overrides.select("podcast", F.col("handle").alias("own")), "podcast", "left").join(defaults.select("podcast", F.col("handle").alias("usual")), "podcast", "left")
    handles = named.withColumn("handle", T.channel_handle(F.col("own"), F.col("usual"))).filter("handle <> ''")
    return handles.join(channels, "handle").select("podcast", "channel_id")


def listed_of(listings: DataFrame) -> DataFrame:
    """Listed videos: channel_id, podcast, video_id."""
    return listings.select("channel_id", "podcast", F.explode("items").alias("i")).select("channel_id", "podcast", F.col("i.id.videoId").alias("video_id")).filter("video_id is not null and video_id <> ''")


def described_of(details: DataFrame) -> DataFrame:
    """Details of videos: channel_id, video_id, title, duration_seconds, published_at."""
    return details.select("channel_id", F.explode("items").alias("d")).select(
        "channel_id", F.col("d.id").alias("video_id"), F.coalesce("d.snippet.title", F.lit("")).alias("title"), T.parse_iso8601_duration(F.col("d.contentDetails.duration")).alias("duration_seconds"), F.col("d.snippet.publishedAt").try_cast("timestamp").alias("published_at")
    )


def videos_of(listings: DataFrame, details: DataFrame) -> DataFrame:
    """Listed videos with details: video_id, title, duration_seconds, channel_id, podcast, published_at."""
    return listed_of(listings).join(described_of(details), ["channel_id", "video_id"]).select("video_id", "title", "duration_seconds", "channel_id", "podcast", "published_at")


def fetched(listings: DataFrame, details: DataFrame, n: int = schemas.LATEST) -> DataFrame:
    """The newest n videos of each channel, too short ones still among them."""
    return latest_per_channel(videos_of(listings, details), n)


def fetch_summary(latest: DataFrame, least: int = schemas.MIN_DURATION) -> DataFrame:
    """Per show, and with a null show over all: videos fetched, and those long enough to be stored."""
    return latest.rollup("podcast").agg(F.count("*").alias("fetched"), F.count_if(T.long_enough(F.col("duration_seconds"), least)).alias("upserted"))
