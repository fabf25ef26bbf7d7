"""The jobs on stored tables: each reads the buckets it needs and leaves one commit behind.

Beside the five tables there are four that carry what one run leaves to the next: listed videos whose
details have not come (``listed``), details of videos not listed yet (``described``), the newest videos
of each channel (``newest``) and responses for videos that are not known yet (``waiting``); then the
videos to be processed (``backlog``), and responses that gave no text (``rejected``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from podspark import schemas
from podspark.functions import text as T
from podspark.operators import insights as I
from podspark.operators import merge
from podspark.operators.dedupe import latest_per_channel
from podspark.operators.transcripts import rejected
from podspark.plans import jobs
from podspark.sources import listings as L
from podspark.sources.store import Change, Snapshot, Store
from podspark.sources.tables import BUCKETS, broadcast_if_small, stored

BACKLOG = "video_id string, podcast string, title string, published_at timestamp, created_at timestamp"
DESCRIBED = "channel_id string, video_id string, title string, duration_seconds int, published_at timestamp"
NEWEST = "channel_id string, podcast string, video_id string, title string, duration_seconds int, published_at timestamp"
TABLES = {
    "videos": (schemas.VIDEOS, "video_id"),
    "transcriptions": (schemas.TRANSCRIPTIONS, "video_id"),
    "segments": (schemas.SEGMENTS, "transcription_id"),
    "insights": (schemas.INSIGHTS, "video_id"),
    "seed_links": (schemas.SEED_LINKS, "video_id"),
    "listed": ("channel_id string, podcast string, video_id string", "video_id"),
    "described": (DESCRIBED, "video_id"),
    "newest": (NEWEST, "channel_id"),
    "waiting": ("video_id string, response string", "video_id"),
    "backlog": (BACKLOG, "video_id"),
    "rejected": ("video_id string, reason string, response string", "video_id"),
}
#: How far the seeding of videos has read the changes of links and videos.
SEEDED = "seeded"


def open_store(spark: SparkSession, root: str, buckets: int = BUCKETS) -> Store:
    return Store(spark, root, TABLES, buckets)


def _open_videos(videos: DataFrame, transcriptions: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the backlog among ``ids``; all three tables hold the same buckets."""
    return jobs.backlog(videos.join(ids, "video_id", "left_semi"), transcriptions, ordered=False)


def backlog(store: Store, ordered: bool = True) -> DataFrame:
    """Videos without a transcription, newest first: read, not worked out again."""
    rows = store.read("backlog")
    return rows.orderBy(F.col("published_at").desc_nulls_last(), F.col("created_at").desc(), "video_id") if ordered else rows


def seed_links(store: Store, links: DataFrame, now: Column) -> Snapshot:
    """Link rows with ``seq`` into the stored links; only their buckets are read and written."""
    was = store.snapshot()
    links = stored(merge.acceptable_links(links))
    old = store.touched(was, "seed_links", links)
    return store.commit(was, {"seed_links": Change(merge.upsert_seed_links(old.rows, links, now), old.numbers)})


def seed_from_links(store: Store, now: Column) -> Snapshot:
    """Stored links into the stored videos, as far as a link or its video has changed since the last time.

    Each such video is folded from all its links again, so the videos are those of seeding from all links; only
    ``updated_at`` of videos without news stays.
    """
    was = store.snapshot()
    if not any(store.unseen(was, name, SEEDED) for name in ("seed_links", "videos")):
        return was
    above = was.marks.get(SEEDED, 0)
    ids = stored(store.changes(was, "seed_links", above).select("video_id").unionByName(store.changes(was, "videos", above).select("video_id")).distinct())
    links = store.touched(was, "seed_links", ids).rows.join(ids, "video_id", "left_semi")
    links = stored(links)
    ids = links.select("video_id").distinct()
    old = store.touched(was, "videos", ids)
    videos = stored(merge.videos_from_links(old.rows, links, now))
    waiting = store.read("backlog", was, old.numbers)
    fresh = _open_videos(videos, store.read("transcriptions", was, old.numbers), ids)
    changes = {"videos": Change(videos, old.numbers), "backlog": Change(merge.replace_by_key(waiting, fresh, ids, "video_id"), old.numbers)}
    return store.commit(was, changes, [SEEDED])


def _newest_of(old: DataFrame, new: DataFrame, columns: list[str], key: list[str]) -> DataFrame:
    """One row per key, of the new ones if there are any; of several the greatest, so that the order of arrival decides nothing."""
    rows = old.select(*columns, F.lit(0).alias("_n")).unionByName(new.select(*columns, F.lit(1).alias("_n")))
    rest = [c for c in columns if c not in key]
    return rows.groupBy(*key).agg(F.max(F.struct("_n", *rest)).alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def sync_batch(
    store: Store, listings: DataFrame, details: DataFrame, responses: DataFrame, channels: DataFrame, templates: dict[str, Column], answer: Callable[[str, str], str], now: Column,
    batch: tuple[str, int] | None = None, ask: Callable[[DataFrame, Callable[[str, str], str]], DataFrame] = I.ask, least: int = schemas.MIN_DURATION, n: int = schemas.LATEST,
) -> Snapshot:
    """What has landed (channel listings, details, responses) into all tables, in one commit.

    A listing waits for its details, details for their listing, and a response for its video, in whatever order
    and batches they come; the newest videos of a channel are kept, so older listings are not read again.  A batch
    that has been committed is left out.
    """
    was = store.snapshot()
    if batch and store.done(was, batch):
        return was
    changes: dict[str, Change] = {}

    # Listings meet details, those of earlier batches included.
    known, _ = broadcast_if_small(channels.select("podcast", "channel_id"), jobs.BROADCAST_CHANNELS)
    listed = stored(L.listed_of(listings.drop("podcast").join(known, "channel_id")).select("channel_id", "podcast", "video_id").distinct())
    described = stored(L.described_of(details))
    numbers = store.numbers(listed.select("video_id").unionByName(described.select("video_id")), "video_id")
    all_listed = stored(store.read("listed", was, numbers).unionByName(listed).distinct())
    all_described = stored(_newest_of(store.read("described", was, numbers), described, described.columns, ["channel_id", "video_id"]))
    pair = ["channel_id", "video_id"]
    changes["listed"] = Change(all_listed.join(all_described, pair, "left_anti"), numbers)
    changes["described"] = Change(all_described.join(all_listed, pair, "left_anti"), numbers)
    matched = stored(all_listed.join(all_described, pair))

    # The newest of each channel, from those kept and the new ones.
    old_newest = store.touched(was, "newest", matched)
    columns = store.read("newest", was, []).columns
    newest = stored(latest_per_channel(_newest_of(old_newest.rows, matched, columns, ["channel_id", "podcast", "video_id"]), n))
    changes["newest"] = Change(newest, old_newest.numbers)
    fetched = newest.join(matched.select("channel_id", "podcast", "video_id"), ["channel_id", "podcast", "video_id"], "left_semi")
    fetched = stored(fetched.filter(T.long_enough(F.col("duration_seconds"), least)).withColumn("seq", F.lit(0).cast("bigint")))

    # Videos that are new, and videos that are heard, meet in their buckets.
    heard = stored(responses.filter("video_id is not null").groupBy("video_id").agg(F.min("response").alias("response")))
    ids = stored(fetched.select("video_id").unionByName(heard.select("video_id")).distinct())
    numbers = store.numbers(ids, "video_id")
    old = {name: store.read(name, was, numbers) for name in ("videos", "transcriptions", "insights", "backlog", "waiting", "rejected")}
    videos = stored(merge.upsert_videos(old["videos"], fetched, now))
    open_ = _open_videos(videos, old["transcriptions"], ids)
    told = stored(old["waiting"].join(ids, "video_id", "left_semi").unionByName(heard.select("video_id", "response")).groupBy("video_id").agg(F.min("response").alias("response")))
    ready = stored(open_.select("video_id", "podcast").join(told, "video_id"))
    left = told.join(videos, "video_id", "left_anti")
    changes["waiting"] = Change(merge.replace_by_key(old["waiting"], left, ids, "video_id"), numbers)

    transcriptions = old["transcriptions"]
    if not ready.isEmpty():
        segment_numbers = store.numbers(ready.select(T.deterministic_id(F.lit("transcription"), F.col("video_id")).alias("transcription_id")), "transcription_id")
        tables = jobs.Tables(videos, transcriptions, store.read("segments", was, segment_numbers), old["insights"], store.read("seed_links", was, []))
        done, _ = jobs.process(tables, ready, templates, answer, now, ask)
        videos, transcriptions = stored(done.videos), stored(done.transcriptions)
        bad = rejected(ready).select("video_id", "reason", "response")
        changes |= {
            "rejected": Change(merge.replace_by_key(old["rejected"], bad, ready, "video_id"), numbers),
            "transcriptions": Change(transcriptions, numbers),
            "segments": Change(done.segments, segment_numbers),
            "insights": Change(done.insights, numbers),
        }
    still = _open_videos(videos, transcriptions, ids)
    changes |= {"videos": Change(videos, numbers), "backlog": Change(merge.replace_by_key(old["backlog"], still, ids, "video_id"), numbers)}
    return store.commit(was, changes, batch=batch)


def read_all(store: Store) -> dict[str, DataFrame]:
    """All tables as of one commit."""
    now = store.snapshot()
    return {name: store.read(name, now) for name in store.tables}
