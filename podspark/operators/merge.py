"""Keyed upserts and replacements, set by set.

An upsert folds new rows in the order of ``seq`` into the old ones with one aggregation, so that
partial sums take the load off keys that occur very often.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podspark import schemas
from podspark.functions import text as T


def acceptable_links(rows: DataFrame) -> DataFrame:
    """Rows with a video id and a podcast, both stripped; titles and links cut to size."""
    rows = rows.withColumns({c: T.strip(F.coalesce(c, F.lit(""))) for c in ("video_id", "podcast")}).filter("video_id <> '' and podcast <> ''")
    sizes = {"title": schemas.TITLE_CHARS, "url": schemas.URL_CHARS}
    return rows.withColumns({c: F.substring(F.coalesce(c, F.lit("")), 1, n) for c, n in sizes.items() if c in rows.columns})


_NEW = "not is_old"


def _last_text(c: str, blank: Column) -> Column:
    """The last new text that is not empty, else the old one, else ``blank``."""
    newest = F.max_by(c, F.when(F.expr(f"{_NEW} and {c} <> ''"), F.col("seq")))
    old = F.when(F.bool_or("is_old"), F.max(F.when(F.col("is_old"), F.col(c)))).otherwise(blank)
    return F.coalesce(newest, old)


def _last_known(c: str) -> Column:
    """The last value that is not null; old rows come before all new ones."""
    return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))


def _both(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    kinds = {f.name: f.dataType for f in old.schema}
    was = old.select(*columns, "id", "created_at", "updated_at").withColumns({"seq": F.lit(-1).cast("bigint"), "is_old": F.lit(True)})
    now = new.select(*[F.col(c).cast(kinds[c]).alias(c) for c in columns], F.col("seq").cast("bigint").alias("seq")).withColumns(
        {"id": F.lit(None).cast("string"), "created_at": F.lit(None).cast("timestamp"), "updated_at": F.lit(None).cast("timestamp"), "is_old": F.lit(False)}
    )
    return was.unionByName(now)


def _stamps(now: Column, *key: str) -> list[Column]:
    fresh = F.bool_or(~F.col("is_old"))
    return [
        F.coalesce(F.max("id"), T.deterministic_id(*[F.col(k) for k in key])).alias("id"),
        F.when(F.bool_or("is_old"), F.max("created_at")).otherwise(F.max(now)).alias("created_at"),
        F.when(fresh, F.max(now)).otherwise(F.max("updated_at")).alias("updated_at"),
    ]


def upsert_seed_links(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """New rows: video_id, podcast, title, duration_seconds, url, seq; key (video_id, podcast)."""
    rows = _both(old, acceptable_links(new), ["video_id", "podcast", "title", "duration_seconds", "url"])
    merged = rows.groupBy("video_id", "podcast").agg(
        _last_text("title", F.lit("")).alias("title"), _last_known("duration_seconds").alias("duration_seconds"), _last_text("url", F.lit("")).alias("url"), *_stamps(now, "video_id", "podcast")
    )
    return merged.select(*old.columns)


def upsert_videos(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """New rows: video_id, title, duration_seconds, channel_id, podcast, published_at, seq; key video_id. The last podcast wins."""
    rows = _both(old, new.withColumn("title", F.coalesce("title", F.lit(""))), ["video_id", "podcast", "title", "duration_seconds", "channel_id", "published_at"])
    merged = rows.groupBy("video_id").agg(
        F.max_by("podcast", "seq").alias("podcast"), _last_text("title", F.lit("")).alias("title"), *[_last_known(c).alias(c) for c in ("duration_seconds", "channel_id", "published_at")], *_stamps(now, "video_id")
    )
    return merged.select(*old.columns)


def upsert_stored_videos(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """As ``upsert_videos``, for an ``old`` that is stored in buckets of video_id: the new rows are folded and join it there, and ``old`` is not shuffled."""
    known = ("duration_seconds", "channel_id", "published_at")
    kinds = {f.name: f.dataType for f in old.schema}
    folded = new.withColumn("title", F.coalesce("title", F.lit(""))).groupBy("video_id").agg(
        F.max_by("podcast", "seq").alias("_podcast"),
        F.max_by("title", F.when(F.col("title") != "", F.col("seq"))).alias("_title"),
        *[_last_known(c).cast(kinds[c]).alias(f"_{c}") for c in known],
        F.lit(True).alias("_new"),
    )
    is_old, is_new = F.col("id").isNotNull(), F.col("_new").isNotNull()
    rows = old.join(folded, "video_id", "full")
    return rows.withColumns(
        {
            "podcast": F.when(is_new, F.col("_podcast")).otherwise(F.col("podcast")),
            "title": F.coalesce("_title", F.when(is_old, F.col("title")).otherwise(F.lit(""))),
            **{c: F.coalesce(f"_{c}", c) for c in known},
            "created_at": F.when(is_old, F.col("created_at")).otherwise(now),
            "updated_at": F.when(is_new, now).otherwise(F.col("updated_at")),
            "id": F.coalesce("id", T.deterministic_id(F.col("video_id"))),
        }
    ).select(*old.columns)


def videos_from_links(videos: DataFrame, links: DataFrame, now: Column) -> DataFrame:
    """Seed links into videos; of two podcasts for one video the one touched last wins, then the greater name."""
    order = F.struct(F.col("updated_at"), F.col("podcast"))
    ranked = links.withColumn("_at", order)
    # One row per video carries the fold, so the order needs no global numbering.
    folded = ranked.groupBy("video_id").agg(
        F.max_by("podcast", "_at").alias("podcast"),
        F.coalesce(F.max_by("title", F.when(F.col("title") != "", F.col("_at"))), F.lit("")).alias("title"),
        F.max_by("duration_seconds", F.when(F.col("duration_seconds").isNotNull(), F.col("_at"))).alias("duration_seconds"),
    )
    new = folded.withColumns({"channel_id": F.lit(None).cast("string"), "published_at": F.lit(None).cast("timestamp"), "seq": F.lit(0).cast("bigint")})
    return upsert_videos(videos, new, now)


def replace_by_key(old: DataFrame, new: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``old`` without the rows of ``keys``, and ``new``; keys without new rows are emptied all the same."""
    return old.join(keys.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def replace_transcripts(transcriptions: DataFrame, segments: DataFrame, new: DataFrame, new_segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per video of ``new`` its transcription and the segments below it."""
    gone = transcriptions.join(new.select("video_id").distinct(), "video_id", "left_semi").select(F.col("id").alias("transcription_id"))
    keys = gone.unionByName(new.select(F.col("id").alias("transcription_id")))
    return replace_by_key(transcriptions, new, new, "video_id"), replace_by_key(segments, new_segments, keys, "transcription_id")


def replace_insights(insights: DataFrame, new: DataFrame, processed: DataFrame) -> DataFrame:
    return replace_by_key(insights, new, processed, "video_id")
