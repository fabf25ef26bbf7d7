"""Seeding, fetching, backlog, processing and backfill as set-based jobs.

Every job takes and returns DataFrames; ``now`` is a column, so a rerun can repeat a timestamp.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from podspark import schemas
from podspark.functions import text as T
from podspark.operators import insights as I
from podspark.operators import merge
from podspark.operators.chunks import chunks
from podspark.operators.transcripts import parse_responses, segments_of, transcriptions_of
from podspark.sources import listings as L
from podspark.sources import seeds as S
from podspark.sources.tables import broadcast_if_small, stored

#: Shows with a channel are broadcast only up to this number.
BROADCAST_CHANNELS = 100_000


class Tables(NamedTuple):
    videos: DataFrame
    transcriptions: DataFrame
    segments: DataFrame
    insights: DataFrame
    seed_links: DataFrame


def _as_videos(links: DataFrame) -> DataFrame:
    """Links with file_rank and line_no as new rows for the videos table."""
    return links.select("video_id", "title", "duration_seconds", F.lit(None).cast("string").alias("channel_id"), "podcast", F.lit(None).cast("timestamp").alias("published_at"), F.lit(0).cast("bigint").alias("seq"))


def seed_csvs(tables: Tables, links: DataFrame, now: Column) -> Tables:
    """Deduplicated CSV links straight into videos."""
    return tables._replace(videos=merge.upsert_videos(tables.videos, _as_videos(links), now))


def seed_links(tables: Tables, links: DataFrame, now: Column) -> tuple[Tables, DataFrame]:
    """Link rows with ``seq`` into seed_links; also one row with the number of rows ``accepted``."""
    accepted = merge.acceptable_links(links).agg(F.count("*").alias("accepted"))
    return tables._replace(seed_links=merge.upsert_seed_links(tables.seed_links, links, now)), accepted


def seed_csvs_to_links(tables: Tables, links: DataFrame, now: Column) -> tuple[Tables, DataFrame]:
    """Deduplicated CSV links into seed_links."""
    return seed_links(tables, links.withColumn("seq", F.lit(0).cast("bigint")), now)


def seed_from_links(tables: Tables, now: Column) -> Tables:
    return tables._replace(videos=merge.videos_from_links(tables.videos, tables.seed_links, now))


def fetch_new(tables: Tables, listings: DataFrame, details: DataFrame, channels: DataFrame, now: Column, least: int = schemas.MIN_DURATION, n: int = schemas.LATEST) -> tuple[Tables, DataFrame]:
    """The newest videos of each show's channel into videos; also the summary per show and over all (``podcast`` null)."""
    known, _ = broadcast_if_small(channels.select("podcast", "channel_id"), BROADCAST_CHANNELS)
    latest = stored(L.fetched(listings.drop("podcast").join(known, "channel_id"), details, n))
    new = latest.filter(T.long_enough(F.col("duration_seconds"), least)).withColumn("seq", F.lit(0).cast("bigint"))
    return tables._replace(videos=merge.upsert_videos(tables.videos, new, now)), L.fetch_summary(latest, least)


def backlog(videos: DataFrame, transcriptions: DataFrame, ordered: bool = True) -> DataFrame:
    """Videos without a transcription, newest first."""
    rows = videos.join(transcriptions.select("video_id"), "video_id", "left_anti").select("video_id", "podcast", "title", "published_at", "created_at")
    return rows.orderBy(F.col("published_at").desc_nulls_last(), F.col("created_at").desc(), "video_id") if ordered else rows


def _asked_in_rows(parsed: DataFrame, templates: dict[str, Column], answer: Callable[[str, str], str], now: Column) -> tuple[DataFrame, DataFrame]:
    """A row per insight, and those of the insights table; every answer stays with the row that asked, only the time ranges, which need the whole transcript, are joined."""
    framed = stored(I.titled_and_framed(chunks(parsed, "raw_text", ["video_id", "podcast"]), templates, answer))
    # A transcript goes to the model's worker once for its video.
    times = I.ask_by_video(I.told_by_video(framed, parsed, templates["timestamp_extraction"]), answer)
    times = stored(times.select("video_id", "chunk_no", "pos", F.col("raw").alias("timestamps_raw")))
    return framed, I.insight_rows(framed.join(times, ["video_id", "chunk_no", "pos"], "left"), now)


def _asked_by_requests(parsed: DataFrame, templates: dict[str, Column], answer: Callable[[str, str], str], now: Column, ask: Callable[[DataFrame, Callable[[str, str], str]], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The same by requests and answers, for an ``ask`` that works on tables of them, such as one that keeps answers by the hash of their prompts."""
    pieces = chunks(parsed, "raw_text", ["video_id"])
    # The answers are written before they are read by several steps.
    first = I.insight_requests(pieces, templates["extract_insights_system"])
    found = stored(I.insights_of(first, stored(ask(first, answer)), pieces))
    titles = I.title_requests(found, templates["title_generation"])
    titled = stored(I.with_titles(found, titles, stored(ask(titles, answer))))
    more = I.timestamp_requests(titled, parsed, templates["timestamp_extraction"]).unionByName(I.framework_requests(titled, templates["make_framework_content"]))
    return titled, I.completed(titled, more, stored(ask(more, answer)), parsed.select("video_id", "podcast").distinct(), now)


def process(tables: Tables, responses: DataFrame, templates: dict[str, Column], answer: Callable[[str, str], str], now: Column, ask: Callable[[DataFrame, Callable[[str, str], str]], DataFrame] = I.ask) -> tuple[Tables, DataFrame]:
    """Responses (video_id, podcast, response) of many videos at once; also the number of insights per video.

    ``ask`` runs the model over requests; ``answers.ask_kept`` on a store asks only what has no answer yet.

    A video whose text is empty stays in the backlog: nothing of it is written but the video itself.
    Every model step runs once: its answers are stored in the shared folder before they are used.
    """
    touch = responses.select("video_id", F.lit("").alias("title"), F.lit(None).cast("int").alias("duration_seconds"), F.lit(None).cast("string").alias("channel_id"), "podcast", F.lit(None).cast("timestamp").alias("published_at"), F.lit(0).alias("seq"))
    videos = merge.upsert_videos(tables.videos, touch, now)
    parsed = stored(parse_responses(responses).filter(F.length("raw_text") > 0).select("video_id", "podcast", "raw_text", "utterances", "timestamped"))
    transcriptions, segments = merge.replace_transcripts(tables.transcriptions, tables.segments, transcriptions_of(parsed, now), segments_of(parsed, now))

    found, done = _asked_in_rows(parsed, templates, answer, now) if ask is I.ask else _asked_by_requests(parsed, templates, answer, now, ask)
    insights = merge.replace_insights(tables.insights, done, parsed)
    return Tables(videos, transcriptions, segments, insights, tables.seed_links), I.insights_per_video(parsed, found)


def process_new(tables: Tables, landed: DataFrame, templates: dict[str, Column], answer: Callable[[str, str], str], now: Column) -> tuple[Tables, DataFrame]:
    """Processes the backlog as far as responses (video_id, response) have landed; also the insights per processed video."""
    open_ = backlog(tables.videos, tables.transcriptions, ordered=False).select("video_id", "podcast")
    # Of several responses for a video one is taken, the same one however often this is computed.
    one = landed.groupBy("video_id").agg(F.min("response").alias("response"))
    return process(tables, open_.join(one, "video_id"), templates, answer, now)


def seed(tables: Tables, now: Column, links: DataFrame | None = None, csv_links: DataFrame | None = None) -> tuple[Tables, DataFrame]:
    """Seeds videos from given links, from CSV links, or else from the stored links; also one row ``seeded``.

    An empty table of links seeds nothing new of its own; what is stored is seeded with it.
    """
    if links is not None:
        tables = seed_from_links(seed_links(tables, links, now)[0], now)
    elif csv_links is not None:
        return seed_csvs(tables, csv_links, now), csv_links.agg(F.count("*").alias("seeded"))
    else:
        tables = seed_from_links(tables, now)
    return tables, tables.seed_links.agg(F.count("*").alias("seeded"))


def backfill(
    tables: Tables, landed: DataFrame, templates: dict[str, Column], answer: Callable[[str, str], str], now: Column, links: DataFrame | None = None, csv_links: DataFrame | None = None
) -> tuple[Tables, DataFrame, DataFrame]:
    """Seed, then process the backlog; also the insights per processed video and the summary of the run."""
    tables, seeded = seed(tables, now, links, csv_links)
    tables, per_video = process_new(tables._replace(videos=stored(tables.videos)), landed, templates, answer, now)
    return tables, per_video, run_summary(seeded, per_video)


def backfill_default_csvs(spark: SparkSession, tables: Tables, landed: DataFrame, templates: dict[str, Column], answer: Callable[[str, str], str], now: Column) -> tuple[Tables, DataFrame, DataFrame]:
    """Backfill from the CSV files at their default places."""
    return backfill(tables, landed, templates, answer, now, csv_links=S.read_seed_csvs(spark))


def sync(tables: Tables, listings: DataFrame, details: DataFrame, channels: DataFrame, landed: DataFrame, templates: dict[str, Column], answer: Callable[[str, str], str], now: Column) -> tuple[Tables, DataFrame, DataFrame]:
    """Fetch, then process the backlog; also the fetch summary and the insights per processed video."""
    tables, fetched = fetch_new(tables, listings, details, channels, now)
    tables, per_video = process_new(tables._replace(videos=stored(tables.videos)), landed, templates, answer, now)
    return tables, fetched, per_video


def run_summary(seeded: DataFrame, per_video: DataFrame) -> DataFrame:
    """One row: ``seeded`` links (one row), processed videos, insights; the video ids stay in ``per_video``."""
    return seeded.crossJoin(per_video.agg(F.count("*").alias("processed"), F.coalesce(F.sum("insights"), F.lit(0)).alias("insights")))
