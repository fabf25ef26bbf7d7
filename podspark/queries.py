"""Every operator bound to the shared tables, with DuckDB SQL that says the same.

The shared tables hold no podcasts, so each query first shapes its input out of them: events become
link lists, conversations become speech-to-text and model responses, documents become transcripts
and insights.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from podspark import schemas
from podspark.functions import text as T
from podspark.operators import insights as I
from podspark.operators import bloom, integrity, merge, search
from podspark.operators.chunks import chunks
from podspark.operators.dedupe import first_occurrences, latest_per_channel
from podspark.operators.parse import parse_insights
from podspark.operators.transcripts import parse_responses, rejected, segments_of, transcriptions_of
from podspark.plans import jobs
from podspark.plans import stored as stored_jobs
from podspark.sources import colocated, listings, prompts, seeds
from podspark.sources import tables as S
from podspark.streaming import fetch, sync

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
THEN, NOW = "timestamp'2023-01-01 00:00:00'", "timestamp'2024-01-01 00:00:00'"


def _query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---------------------------------------------------------------- scalar functions

_SECONDS = "(event_id * 7919) % 9000"
_CLOCK = {
    "h": "CAST(floor(s / 3600) AS BIGINT)",
    "m": "CAST(floor((s % 3600) / 60) AS BIGINT)",
    "c": "s % 60",
}


def _clock(cast: str) -> str:
    """SQL of a duration text in five shapes."""
    t = lambda x: f"CAST({x} AS {cast})"
    pad = lambda x: f"lpad({t(x)}, 2, '0')"
    return f"""CASE event_id % 5 WHEN 0 THEN concat({t(_CLOCK["h"])}, ':', {pad(_CLOCK["m"])}, ':', {pad(_CLOCK["c"])})
      WHEN 1 THEN concat({t("CAST(floor(s / 60) AS BIGINT)")}, ':', {pad(_CLOCK["c"])}) WHEN 2 THEN {t("s")} WHEN 3 THEN '' ELSE concat('about ', {t(_CLOCK["m"])}, ' min') END"""


def _timed(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "events").select("event_id", "user_id", "event_type", F.expr(_SECONDS).alias("s")).withColumn("clock", F.expr(_clock("string")))


@_query(f"""SELECT event_id, CAST(CASE WHEN event_id % 5 < 3 THEN s WHEN event_id % 5 = 4 THEN {_CLOCK['m']} END AS DOUBLE) AS seconds,
  CAST(CASE WHEN event_id % 5 < 3 THEN s WHEN event_id % 5 = 4 THEN {_CLOCK['m']} END AS DOUBLE) AS time FROM (SELECT event_id,
  {_SECONDS} AS s FROM events)""")
def f1_f3_clock_times(spark: SparkSession, d: str) -> DataFrame:
    return _timed(spark, d).select("event_id", T.parse_duration(F.col("clock")).cast("double").alias("seconds"), T.parse_time(F.col("clock")).alias("time"))


@_query(f"""SELECT event_id,
  CAST(CASE event_id % 4 WHEN 0 THEN s WHEN 1 THEN {_CLOCK["m"]} * 60 WHEN 2 THEN 0 END AS DOUBLE) AS seconds FROM (SELECT event_id,
  {_SECONDS} AS s FROM events)""")
def f2_iso_durations(spark: SparkSession, d: str) -> DataFrame:
    iso = f"CASE event_id % 4 WHEN 0 THEN concat('PT', {_CLOCK['h']}, 'H', {_CLOCK['m']}, 'M', {_CLOCK['c']}, 's') WHEN 1 THEN concat('PT', {_CLOCK['m']}, 'm') WHEN 2 THEN 'PT' ELSE concat('P1DT', {_CLOCK['h']}, 'H') END"
    return _timed(spark, d).select("event_id", T.parse_iso8601_duration(F.expr(iso)).cast("double").alias("seconds"))


_URL = "CASE event_id % 6 WHEN 0 THEN concat('https://www.youtube.com/watch?v=', k) WHEN 1 THEN concat('https://youtu.be/', k, 'xyz') WHEN 2 THEN concat(' https://www.youtube.com/embed/', k) WHEN 3 THEN concat('https://www.youtube.com/shorts/', k) WHEN 4 THEN substr(concat('https://youtu.be/', k), 1, 25) ELSE NULL END"


@_query(f"""WITH e AS (SELECT event_id, substr(md5(CAST(user_id AS VARCHAR)), 1, 11) AS k FROM events), u AS (SELECT event_id, k, {_URL} AS url FROM e)
SELECT event_id, CASE WHEN event_id % 6 < 3 THEN k END AS video_id, CASE WHEN event_id % 6 < 3 THEN 'https://www.youtube.com/watch?v=' || k END AS link FROM u
UNION ALL SELECT -1 - page_id, nullif(regexp_extract(url, '(?:v=|youtu\\.be/|/embed/)([A-Za-z0-9_-]{{11}})', 1), ''),
  'https://www.youtube.com/watch?v=' || nullif(regexp_extract(url, '(?:v=|youtu\\.be/|/embed/)([A-Za-z0-9_-]{{11}})', 1), '') FROM pages""")
def f4_f13_video_ids(spark: SparkSession, d: str) -> DataFrame:
    made = _table(spark, d, "events").select("event_id", F.expr("substr(md5(cast(user_id as string)), 1, 11)").alias("k")).select("event_id", F.expr(_URL).alias("url"))
    rows = made.unionByName(_table(spark, d, "pages").select((-1 - F.col("page_id")).alias("event_id"), "url"))
    video = T.extract_video_id(F.col("url"))
    return rows.select("event_id", video.alias("video_id"), T.watch_url(video).alias("link"))


_PATH = "concat(url, CASE page_id % 5 WHEN 0 THEN '/Marketing_Operators.csv' WHEN 1 THEN '/FINANCE-operators.csv' WHEN 2 THEN '/marketing.csv' ELSE '/x.csv' END)"


@_query(f"""SELECT page_id,
  CASE WHEN lower(p) LIKE '%marketing%' AND lower(p) LIKE '%operators%' THEN 'marketing_operator' WHEN lower(p) LIKE '%finance%' AND lower(p) LIKE '%operators%' THEN 'finance_operators' ELSE '9operators' END AS podcast FROM (SELECT page_id,
  {_PATH} AS p FROM pages)""")
def f5_podcast_of_path(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "pages").select("page_id", T.infer_podcast(F.expr(_PATH)).alias("podcast"))


_HMS_SQL = "CASE WHEN {s} < 360000 THEN lpad(CAST({s} // 3600 AS VARCHAR), 2, '0') ELSE CAST({s} // 3600 AS VARCHAR) END || ':' || lpad(CAST(({s} % 3600) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({s} % 60 AS VARCHAR), 2, '0')"


@_query(f"""SELECT event_id, {_HMS_SQL.format(s="s")} AS hms,
  {_HMS_SQL.format(s="s")} || ' ' || CASE WHEN event_id % 4 < 2 OR event_id % 4 = 3 AND event_type = '' THEN 'Speaker' ELSE sp END || ': ' || event_type AS line,
  CASE WHEN event_id % 4 < 2 THEN '' ELSE sp END AS label, CAST(CAST(s + 0.25 AS DECIMAL(10, 2)) AS DOUBLE) AS seconds
FROM (SELECT event_id, event_type, event_id * 37 AS s, CASE event_id % 4 WHEN 1 THEN '0' WHEN 2 THEN '1' WHEN 3 THEN event_type END AS sp FROM events)""")
def f6_f7_f8_f15_utterance_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "events").select("event_id", "event_type", (F.col("event_id") * 37 + 0.25).cast("double").alias("s"), F.expr("CASE event_id % 4 WHEN 1 THEN '0' WHEN 2 THEN '1' WHEN 3 THEN event_type END").alias("sp"))
    padded = F.concat(F.lit("\t "), F.col("event_type"), F.lit(" \n"))
    return rows.select("event_id", T.format_hms(F.col("s")).alias("hms"), T.utterance_line(F.col("s"), F.col("sp"), padded).alias("line"), T.speaker_label(F.col("sp")).alias("label"), T.seconds(F.col("s")).cast("double").alias("seconds"))


_RAW = "CASE doc_id % 4 WHEN 0 THEN concat('x <title> ', h, ' </title> <title>no</title>') WHEN 1 THEN concat('<start_time>1:02:', doc_id % 60, '</start_time><end_time></end_time><FrameWork>\n## ', h, '\n</FrameWork></FrameWork>') WHEN 2 THEN concat('  ', h, h, h, h, h, ' ') ELSE '' END"


@_query(f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN h WHEN 1 THEN substr(trim(raw), 1, 120) WHEN 2 THEN substr(h || h || h || h || h, 1, 120) ELSE '' END AS title,
  CAST(CASE WHEN doc_id % 4 = 1 THEN 3720 + doc_id % 60 END AS DOUBLE) AS start_time, CAST(NULL AS DOUBLE) AS end_time,
  CASE doc_id % 4 WHEN 0 THEN trim(raw) WHEN 1 THEN '## ' || h WHEN 2 THEN h || h || h || h || h ELSE '' END AS framework
FROM (SELECT doc_id, h, {_RAW} AS raw FROM (SELECT doc_id, md5(text) AS h FROM documents))""")
def f9_answer_tags(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "documents").select("doc_id", F.md5("text").alias("h")).select("doc_id", F.expr(_RAW).alias("raw"))
    raw = F.col("raw")
    return rows.select("doc_id", T.title_of(raw).alias("title"), T.start_time_of(raw).alias("start_time"), T.end_time_of(raw).alias("end_time"), T.framework_of(raw).alias("framework"))


@_query("""SELECT doc_id, md5('Say: ' || replace(t, '{insight}', lang) || ' / ' || lang) AS prompt, substr(t, 1, 2048) AS cut,
  CAST(length(t) AS BIGINT) AS n FROM (SELECT doc_id, lang, text || CASE WHEN doc_id % 2 = 0 THEN '{insight}' ELSE '' END AS t FROM documents)""")
def f10_f11_templates(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "documents").select("doc_id", "lang", F.expr("concat(text, CASE WHEN doc_id % 2 = 0 THEN '{insight}' ELSE '' END)").alias("t"))
    prompt = T.render(F.lit("Say: {transcript} / {insight}"), {"transcript": F.col("t"), "insight": F.col("lang")})
    return rows.select("doc_id", F.md5(prompt).alias("prompt"), F.substring("t", 1, schemas.TITLE_CHARS).alias("cut"), F.length("t").cast("bigint").alias("n"))


@_query(r"""SELECT doc_id, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS stripped FROM documents""")
def f14_strip(spark: SparkSession, d: str) -> DataFrame:
    around = F.concat(F.lit("  \t\x1c"), F.col("text"), F.lit("\n \x1f "))
    return _table(spark, d, "documents").select("doc_id", F.md5(T.strip(around)).alias("stripped"))


# ---------------------------------------------------------------- links, catalogue, backlog

_LINK_SQL = f"""WITH e AS (SELECT event_id, {_SECONDS} AS s, substr(md5(CAST(user_id AS VARCHAR)), 1, 11) AS k FROM events),
l AS (SELECT event_id AS line_no, CAST(event_id % 3 AS INT) AS file_rank, CASE WHEN event_id % 7 > 0 THEN k END AS video_id,
  CASE WHEN event_id % 5 < 3 THEN s % 700 WHEN event_id % 5 = 4 THEN CAST(floor(s % 700 / 60) AS BIGINT) END AS dur FROM e),
f AS (SELECT *, row_number() OVER (PARTITION BY video_id, file_rank ORDER BY line_no) AS n FROM l WHERE video_id IS NOT NULL),
k AS (SELECT * FROM f WHERE n = 1 AND (dur IS NULL OR dur >= 300)),
g AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY file_rank, line_no) AS r FROM k)
SELECT video_id, ['9operators', 'marketing_operator', 'finance_operators'][file_rank + 1] AS podcast, CAST(dur AS DOUBLE) AS seconds,
  'T' || line_no AS title, 'https://youtu.be/' || video_id AS url FROM g WHERE r = 1"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Events as lines of three CSV files: url, c2, duration, title, file_rank, line_no."""
    e = _table(spark, d, "events").select("event_id", F.expr(f"({_SECONDS}) % 700").alias("s"), F.expr("substr(md5(cast(user_id as string)), 1, 11)").alias("k"))
    return e.select(
        F.expr("CASE WHEN event_id % 7 > 0 THEN concat('https://youtu.be/', k) ELSE concat('https://www.youtube.com/shorts/', k) END").alias("url"), F.lit("x").alias("c2"),
        F.expr(_clock("string")).alias("duration"), F.concat(F.lit("T"), F.col("event_id")).alias("title"), (F.col("event_id") % 3).cast("int").alias("file_rank"), F.col("event_id").alias("line_no"),
    )


def _links_out(links: DataFrame) -> DataFrame:
    return links.select("video_id", "podcast", F.col("duration_seconds").cast("double").alias("seconds"), "title", "url")


def _links(spark: SparkSession, d: str) -> DataFrame:
    podcast = F.element_at(F.array(*map(F.lit, schemas.PODCASTS)), F.col("file_rank") + 1)
    return _lines(spark, d).select(*seeds.link_columns(podcast, F.col("file_rank")))


@_query(_LINK_SQL)
def w1_u1_p1_first_occurrences(spark: SparkSession, d: str) -> DataFrame:
    return _links_out(first_occurrences(_links(spark, d), schemas.MIN_DURATION))


@_query(_LINK_SQL)
def s1_s2_k1_seed_csvs(spark: SparkSession, d: str) -> DataFrame:
    """The same links by way of CSV files: one file per show, its lines in order."""
    folder = S.shared_folder(spark)
    lines = _lines(spark, d)
    for rank, podcast in enumerate(schemas.PODCASTS):
        # One file in line order, as a show's list is one file.
        lines.filter(F.col("file_rank") == rank).coalesce(1).sortWithinPartitions("line_no").select("url", "c2", "duration", "title").write.csv(f"{folder}/{podcast}", quote='"', escape='"')
    return _links_out(seeds.read_seed_csvs(spark, {p: f"{folder}/{p}" for p in schemas.PODCASTS}))


_OLD_LINKS = f"""SELECT 'v' || user_id AS video_id, event_type AS podcast, CASE WHEN min(event_id) % 7 = 0 THEN NULL ELSE 'old' || min(event_id) END AS title,
  CAST(CASE WHEN min(event_id) % 2 = 0 THEN min(event_id) % 500 END AS INT) AS duration_seconds, 'o' || min(event_id) AS url,
  'id' || min(event_id) AS id, {THEN} AS created_at, {THEN} AS updated_at FROM events WHERE event_id % 3 = 0 GROUP BY user_id, event_type"""
_NEW_LINKS = """SELECT 'v' || user_id AS video_id, event_type AS podcast, CASE WHEN event_id % 5 = 0 THEN '' ELSE 't' || event_id END AS title,
  CAST(CASE WHEN event_id % 4 = 0 THEN event_id % 1000 END AS INT) AS duration_seconds,
  CASE WHEN event_id % 2 = 0 THEN NULL ELSE 'u' || event_id END AS url, event_id AS seq FROM events WHERE event_id % 3 > 0 AND event_type <> ''"""
_M1 = f"""WITH o AS ({_OLD_LINKS}), n AS ({_NEW_LINKS}),
a AS (SELECT video_id, podcast, title, duration_seconds, url, id, -1 AS seq, true AS is_old FROM o UNION ALL SELECT video_id, podcast, title,
  duration_seconds, coalesce(url, ''), NULL, seq, false FROM n)
SELECT video_id, podcast, coalesce(arg_max(title, seq) FILTER (WHERE title <> '' AND NOT is_old),
  CASE WHEN bool_or(is_old) THEN max(title) FILTER (WHERE is_old) ELSE '' END) AS title,
  CAST(arg_max(duration_seconds, seq) FILTER (WHERE duration_seconds IS NOT NULL) AS DOUBLE) AS seconds,
  coalesce(arg_max(url, seq) FILTER (WHERE url <> '' AND NOT is_old), CASE WHEN bool_or(is_old) THEN max(url) FILTER (WHERE is_old) ELSE '' END) AS url,
  coalesce(max(id), sha256(video_id || '|' || podcast)) AS id, CASE WHEN bool_or(is_old) THEN '2023' ELSE '2024' END AS created,
  CASE WHEN bool_and(is_old) THEN '2023' ELSE '2024' END AS updated FROM a GROUP BY video_id, podcast"""


def _year(c: str, name: str):
    return F.date_format(c, "yyyy").alias(name)


def _sql(spark: SparkSession, d: str, statement: str) -> DataFrame:
    """A statement over one table, with the table given as an argument."""
    name = statement.split(" FROM ")[-1].split()[0]
    return spark.sql(statement.replace(f" FROM {name}", " FROM {src}"), src=_table(spark, d, name))


def _seed_links(spark: SparkSession, d: str) -> DataFrame:
    return _sql(spark, d, _OLD_LINKS).select("id", "video_id", "podcast", "title", "duration_seconds", "url", "created_at", "updated_at")


@_query(_M1)
def m1_k2_upsert_seed_links(spark: SparkSession, d: str) -> DataFrame:
    merged = merge.upsert_seed_links(_seed_links(spark, d), _sql(spark, d, _NEW_LINKS), F.expr(NOW))
    return merged.select("video_id", "podcast", "title", F.col("duration_seconds").cast("double").alias("seconds"), "url", "id", _year("created_at", "created"), _year("updated_at", "updated"))


@_query(_M1)
def s3_link_batches(spark: SparkSession, d: str) -> DataFrame:
    """The same rows landed as JSON batches, one per user, then upserted."""
    folder = S.shared_folder(spark)
    new = _sql(spark, d, _NEW_LINKS)
    batches = new.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("seq", "video_id", "podcast", "title", "duration_seconds", "url"))).alias("b"))
    one = batches.select(F.to_json(F.struct(F.transform("b", lambda x: F.struct(x["video_id"].alias("video_id"), x["podcast"].alias("podcast"), x["title"].alias("title"), x["duration_seconds"].alias("duration_seconds"), x["url"].alias("url"))).alias("links"))))
    one.write.text(folder)
    links = seeds.links_of(spark.read.schema(schemas.LINK_BATCH).json(folder))
    merged = merge.upsert_seed_links(_seed_links(spark, d), links, F.expr(NOW))
    return merged.select("video_id", "podcast", "title", F.col("duration_seconds").cast("double").alias("seconds"), "url", "id", _year("created_at", "created"), _year("updated_at", "updated"))


@_query(f"""WITH l AS ({_NEW_LINKS}), w AS ({_LINK_SQL})
SELECT (SELECT count(*) FROM l) AS accepted, (SELECT count(*) FROM (SELECT DISTINCT video_id, podcast FROM l)) AS stored,
  (SELECT count(*) FROM w) AS from_csvs, (SELECT count(DISTINCT video_id) FROM l) AS videos""")
def k2_k3_seed_links_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Links and CSV links into seed_links, and the stored links into videos, as jobs."""
    tables, accepted = jobs.seed_links(_empty(spark), _sql(spark, d, _NEW_LINKS), F.expr(NOW))
    number = lambda df, name: df.agg(F.count("*").alias(name))
    _, from_csvs = jobs.seed_csvs_to_links(_empty(spark), first_occurrences(_links(spark, d), schemas.MIN_DURATION), F.expr(NOW))
    seeded = jobs.seed_from_links(tables, F.expr(NOW))
    for one in (number(tables.seed_links, "stored"), from_csvs.withColumnRenamed("accepted", "from_csvs"), number(seeded.videos, "videos")):
        accepted = accepted.crossJoin(one)  # one row each
    return accepted


@_query("""SELECT CAST(count(*) AS BIGINT) AS accepted,
  count(DISTINCT v) AS videos FROM (SELECT CASE event_id % 4 WHEN 0 THEN '' ELSE 'v' || user_id END AS v,
  CASE event_id % 6 WHEN 1 THEN '' ELSE event_type END AS p FROM events) WHERE v <> '' AND p <> ''""")
def p2_accepted_links(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "events").select(F.expr("CASE event_id % 4 WHEN 0 THEN '\t  ' ELSE concat(' v', user_id, '\n') END").alias("video_id"), F.expr("CASE event_id % 6 WHEN 1 THEN NULL ELSE event_type END").alias("podcast"))
    return merge.acceptable_links(rows).agg(F.count("*").alias("accepted"), F.count_distinct("video_id").alias("videos"))


_OLD_VIDEOS = f"""SELECT 'v' || user_id AS video_id, min(event_type) AS podcast, 'old' || min(event_id) AS title,
  CAST(CASE WHEN min(event_id) % 2 = 0 THEN 700 END AS INT) AS duration_seconds, CASE WHEN min(event_id) % 3 = 0 THEN 'c1' END AS channel_id,
  CASE WHEN min(event_id) % 4 > 0 THEN max(ts) END AS published_at, 'id' || min(event_id) AS id, {THEN} AS created_at,
  {THEN} AS updated_at FROM events WHERE event_id % 3 = 0 GROUP BY user_id"""
_NEW_VIDEOS = """SELECT 'v' || user_id AS video_id, event_type AS podcast, CASE WHEN event_id % 5 = 0 THEN '' ELSE 't' || event_id END AS title,
  CAST(CASE WHEN event_id % 4 = 0 THEN event_id % 1000 END AS INT) AS duration_seconds,
  CASE WHEN event_id % 2 = 0 THEN 'c' || event_id END AS channel_id, CASE WHEN event_id % 5 = 1 THEN ts END AS published_at,
  event_id AS seq FROM events WHERE event_id % 3 > 0"""


def _videos(spark: SparkSession, d: str) -> DataFrame:
    return _sql(spark, d, _OLD_VIDEOS).select("id", "video_id", "title", "duration_seconds", "channel_id", "podcast", "published_at", "created_at", "updated_at")


def _videos_out(v: DataFrame) -> DataFrame:
    return v.select("video_id", "podcast", "title", F.col("duration_seconds").cast("double").alias("seconds"), "channel_id", F.unix_seconds(F.col("published_at").cast("timestamp")).cast("double").alias("published"), "id", _year("created_at", "created"), _year("updated_at", "updated"))


@_query(f"""WITH o AS ({_OLD_VIDEOS}), n AS ({_NEW_VIDEOS}),
a AS (SELECT video_id, podcast, title, duration_seconds, channel_id, published_at, id, -1 AS seq, true AS is_old FROM o UNION ALL SELECT video_id,
  podcast, title, duration_seconds, channel_id, published_at, NULL, seq, false FROM n)
SELECT video_id, arg_max(podcast, seq) AS podcast, coalesce(arg_max(title, seq) FILTER (WHERE title <> '' AND NOT is_old),
  CASE WHEN bool_or(is_old) THEN max(title) FILTER (WHERE is_old) ELSE '' END) AS title,
  CAST(arg_max(duration_seconds, seq) FILTER (WHERE duration_seconds IS NOT NULL) AS DOUBLE) AS seconds, arg_max(channel_id,
  seq) FILTER (WHERE channel_id IS NOT NULL) AS channel_id,
  CAST(floor(epoch(arg_max(published_at, seq) FILTER (WHERE published_at IS NOT NULL))) AS DOUBLE) AS published, coalesce(max(id), sha256(video_id)) AS id,
  CASE WHEN bool_or(is_old) THEN '2023' ELSE '2024' END AS created, CASE WHEN bool_and(is_old) THEN '2023' ELSE '2024' END AS updated FROM a GROUP BY video_id""")
def m2_upsert_videos(spark: SparkSession, d: str) -> DataFrame:
    return _videos_out(merge.upsert_videos(_videos(spark, d), _sql(spark, d, _NEW_VIDEOS), F.expr(NOW)))


@_query(f"""WITH o AS ({_OLD_VIDEOS}), n AS ({_OLD_LINKS.replace("event_id % 3 = 0", "event_id % 3 > 0")}),
f AS (SELECT video_id, max(podcast) AS podcast, coalesce(arg_max(title, podcast) FILTER (WHERE title <> ''), '') AS title, arg_max(duration_seconds,
  podcast) FILTER (WHERE duration_seconds IS NOT NULL) AS duration_seconds FROM n GROUP BY video_id)
SELECT coalesce(f.video_id, o.video_id) AS video_id, coalesce(f.podcast, o.podcast) AS podcast, coalesce(nullif(f.title, ''), o.title, '') AS title,
  CAST(coalesce(f.duration_seconds, o.duration_seconds) AS DOUBLE) AS seconds, o.channel_id,
  CAST(floor(epoch(o.published_at)) AS DOUBLE) AS published, coalesce(o.id, sha256(f.video_id)) AS id,
  CASE WHEN o.id IS NULL THEN '2024' ELSE '2023' END AS created,
  CASE WHEN f.video_id IS NULL THEN '2023' ELSE '2024' END AS updated FROM f FULL JOIN o USING (video_id)""")
def m3_k3_videos_from_links(spark: SparkSession, d: str) -> DataFrame:
    links = _sql(spark, d, _OLD_LINKS.replace("event_id % 3 = 0", "event_id % 3 > 0"))
    return _videos_out(merge.videos_from_links(_videos(spark, d), links, F.expr(NOW)))


@_query("""SELECT 'd' || doc_id AS video_id, source AS podcast, CAST(CASE WHEN doc_id % 5 > 0 THEN n_chars END AS DOUBLE) AS published,
  doc_id % 97 AS created FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)""")
def k5_j1_o1_backlog(spark: SparkSession, d: str) -> DataFrame:
    """Documents without a label as videos without a transcription, newest first."""
    docs = _table(spark, d, "documents")
    videos = docs.select(F.concat(F.lit("d"), "doc_id").alias("video_id"), F.col("source").alias("podcast"), F.lit("").alias("title"), F.when(F.col("doc_id") % 5 > 0, F.timestamp_seconds("n_chars")).alias("published_at"), F.timestamp_seconds(F.col("doc_id") % 97).alias("created_at"))
    open_ = jobs.backlog(videos, _table(spark, d, "labels").select(F.concat(F.lit("d"), "doc_id").alias("video_id")))
    return open_.select("video_id", "podcast", F.unix_seconds("published_at").cast("double").alias("published"), F.unix_seconds("created_at").alias("created"))


@_query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST,
  CAST(o_orderkey AS VARCHAR)) AS n FROM orders) WHERE n <= 5""")
def w2_latest_per_channel(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "orders").select(F.col("o_custkey").alias("channel_id"), F.col("o_orderkey").cast("string").alias("video_id"), F.col("o_orderdate").alias("published_at"))
    return latest_per_channel(rows, 5).select(F.col("channel_id").alias("o_custkey"), F.col("video_id").cast("bigint").alias("o_orderkey"))


def _landed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders of a customer as a channel's listing and details in landed form; nations as shows."""
    orders = _table(spark, d, "orders").join(_table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    key = F.concat(F.lit("c"), "o_custkey")
    listing = orders.groupBy(key.alias("channel_id")).agg(F.concat(F.lit("p"), F.first("c_nationkey")).alias("podcast"), F.collect_list(F.struct(F.struct(F.when(F.col("o_orderkey") % 9 > 0, F.col("o_orderkey").cast("string")).alias("videoId")).alias("id"))).alias("items"))
    iso = F.concat(F.lit("PT"), (F.col("o_orderkey") % 12).cast("string"), F.lit("M"))
    detail = F.struct(F.col("o_orderkey").cast("string").alias("id"), F.struct(F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderpriority")).alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt")).alias("snippet"), F.struct(iso.alias("duration")).alias("contentDetails"))
    details = orders.filter("o_orderkey % 5 > 0").groupBy(key.alias("channel_id")).agg(F.collect_list(detail).alias("items"))
    channels = _table(spark, d, "customer").select(F.concat(F.lit("p"), "c_nationkey").alias("podcast"), F.concat(F.lit("c"), "c_custkey").alias("channel_id")).filter("podcast <> 'p3'")
    from_text = lambda df, schema: df.select(F.from_json(F.to_json(F.struct(*df.columns)), schema).alias("x")).select("x.*")
    return from_text(listing, schemas.LISTING), from_text(details, schemas.DETAILS), channels


_LISTED = """SELECT CAST(o_orderkey AS VARCHAR) AS video_id, coalesce(CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END, '') AS title,
  CAST(o_orderkey % 12 * 60 AS DOUBLE) AS seconds, 'c' || o_custkey AS channel_id, 'p' || c_nationkey AS podcast,
  o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 9 > 0 AND o_orderkey % 5 > 0"""


@_query(f"SELECT video_id, title, seconds, channel_id, podcast, CAST(floor(epoch(o_orderdate)) AS DOUBLE) AS published FROM ({_LISTED})")
def s4_j2_channel_listings(spark: SparkSession, d: str) -> DataFrame:
    listing, details, _ = _landed(spark, d)
    return listings.videos_of(listing, details).select("video_id", "title", F.col("duration_seconds").cast("double").alias("seconds"), "channel_id", "podcast", F.unix_seconds(F.col("published_at").cast("timestamp")).cast("double").alias("published"))


_FETCHED = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY o_orderdate DESC NULLS LAST,
  video_id) AS n FROM ({_LISTED}) WHERE podcast <> 'p3') WHERE n <= 4"""


@_query(f"SELECT podcast, count(*) AS fetched, count(*) FILTER (WHERE seconds >= 300) AS upserted FROM ({_FETCHED}) GROUP BY ROLLUP (podcast)")
def a2_k4_fetch_summary(spark: SparkSession, d: str) -> DataFrame:
    listing, details, channels = _landed(spark, d)
    return jobs.fetch_new(_empty(spark), listing, details, channels, F.expr(NOW), n=4)[1]


@_query(f"SELECT video_id, title, seconds, channel_id, podcast FROM ({_FETCHED}) WHERE seconds >= 300")
def k4_fetch_new(spark: SparkSession, d: str) -> DataFrame:
    listing, details, channels = _landed(spark, d)
    tables, _ = jobs.fetch_new(_empty(spark), listing, details, channels, F.expr(NOW), n=4)
    return tables.videos.select("video_id", "title", F.col("duration_seconds").cast("double").alias("seconds"), "channel_id", "podcast")


@_query("""SELECT 'p' || n_nationkey AS podcast, 'ch' || n_nationkey AS channel_id FROM nation WHERE n_nationkey % 5 <> 3""")
def j3_f12_channels(spark: SparkSession, d: str) -> DataFrame:
    """Nations as shows: an override with at-signs, a blank one, a default, or no handle at all."""
    n = _table(spark, d, "nation")
    show = F.concat(F.lit("p"), "n_nationkey").alias("podcast")
    k, handle = F.col("n_nationkey"), F.concat(F.lit("h"), "n_nationkey")
    own = n.filter(k % 5 < 3).select(show, F.when(k % 5 == 0, F.concat(F.lit(" @@"), handle)).when(k % 5 == 1, F.lit(" \t")).otherwise(handle).alias("handle"))
    usual = n.filter((k % 5 == 1) | (k % 5 == 4)).select(show, handle.alias("handle"))
    return listings.channels_of(n.select(show), own, usual, n.select(handle.alias("handle"), F.concat(F.lit("ch"), "n_nationkey").alias("channel_id")))


# ---------------------------------------------------------------- transcripts


def _empty(spark: SparkSession) -> jobs.Tables:
    return jobs.Tables(*(S.empty(spark, s) for s in (schemas.VIDEOS, schemas.TRANSCRIPTIONS, schemas.SEGMENTS, schemas.INSIGHTS, schemas.SEED_LINKS)))


def _responses(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as speech-to-text responses: turns become utterances, roles become speakers."""
    c = _table(spark, d, "conversations").withColumn("speaker", F.when(F.col("role") == "user", "0").otherwise(F.col("role")))
    said = F.struct("turn", F.when(F.col("turn") % 7 != 6, F.col("turn") * 754.5).alias("start"), (F.col("turn") * 754.5 + 10).alias("end"), F.concat(F.lit(" "), "text", F.lit("\n")).alias("transcript"), "speaker")
    g = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(said)).alias("u"))
    text = F.array_join(F.transform("u", lambda u: F.trim(F.regexp_replace(u["transcript"], "\n", " "))), " ")
    results = F.struct(F.array(F.struct(F.array(F.struct(text.alias("transcript"))).alias("alternatives"))).alias("channels"))
    utterances = F.when(F.col("conv_id") % 5 > 0, F.transform("u", lambda u: F.struct(u["start"].alias("start"), u["end"].alias("end"), u["transcript"].alias("transcript"), u["speaker"].alias("speaker"))))
    response = F.when(F.col("conv_id") % 9 == 8, F.lit('{"results": {"channels": []}}')).otherwise(F.to_json(F.struct(results.alias("results"), utterances.alias("utterances"))))
    return g.select(F.concat(F.lit("v"), "conv_id").alias("video_id"), F.element_at(F.array(*map(F.lit, schemas.PODCASTS)), (F.col("conv_id") % 3 + 1).cast("int")).alias("podcast"), response.alias("response"))


_STRIP = r"regexp_replace(regexp_replace(text, '\n', ' ', 'g'), '^ +| +$', '', 'g')"
_SPOKEN = f"""SELECT conv_id, turn, text, CASE WHEN turn % 7 <> 6 THEN turn * 754.5 END AS st, turn * 754.5 + 10 AS en,
  CASE WHEN role = 'user' THEN '' ELSE role END AS sp, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS said FROM conversations"""
_RAW_TEXTS = f"""SELECT conv_id, CASE WHEN conv_id % 9 = 8 THEN '' ELSE regexp_replace(string_agg({_STRIP}, ' ' ORDER BY turn), '^\\s+|\\s+$', '',
  'g') END AS raw FROM conversations GROUP BY conv_id"""


@_query(f"""WITH s AS ({_SPOKEN}), r AS ({_RAW_TEXTS}),
t AS (SELECT conv_id,
  string_agg({_HMS_SQL.format(s="CAST(floor(st) AS BIGINT)")} || ' ' || CASE WHEN sp = '' THEN 'Speaker' ELSE sp END || ': ' || said,
  chr(10) ORDER BY turn) AS lines FROM s WHERE st IS NOT NULL AND said <> '' GROUP BY conv_id)
SELECT 'v' || conv_id AS video_id, CAST(length(raw) AS BIGINT) AS n_chars, md5(raw) AS raw_md5,
  md5(CASE WHEN conv_id % 9 = 8 OR conv_id % 5 = 0 THEN raw ELSE coalesce(lines, '') END) AS timestamped_md5 FROM r LEFT JOIN t USING (conv_id)""")
def s5_s6_a1_p4_transcripts(spark: SparkSession, d: str) -> DataFrame:
    parsed = parse_responses(_responses(spark, d))
    return parsed.select("video_id", F.length("raw_text").cast("bigint").alias("n_chars"), F.md5("raw_text").alias("raw_md5"), F.md5("timestamped").alias("timestamped_md5"))


_SEGMENTS = f"""SELECT 'v' || conv_id AS video_id, CAST(st AS DOUBLE) AS st, CAST(en AS DOUBLE) AS en, said,
  sp FROM ({_SPOKEN}) JOIN ({_RAW_TEXTS}) USING (conv_id) WHERE st IS NOT NULL AND conv_id % 5 > 0 AND raw <> ''"""


@_query(f"SELECT sha256('transcription|' || video_id) AS transcription_id, st AS start_time, en AS end_time, md5(said) AS text_md5, sp AS speaker_label FROM ({_SEGMENTS})")
def g4_p3_segments(spark: SparkSession, d: str) -> DataFrame:
    rows = segments_of(parse_responses(_responses(spark, d)), F.expr(NOW))
    return rows.select("transcription_id", F.col("start_time_sec").cast("double").alias("start_time"), F.col("end_time_sec").cast("double").alias("end_time"), F.md5("text").alias("text_md5"), "speaker_label")


_OLD_TRANSCRIPTS = "SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 4 = 0 OR conv_id % 9 = 8"


@_query(f"""WITH r AS (SELECT * FROM ({_RAW_TEXTS}) WHERE raw <> ''), o AS ({_OLD_TRANSCRIPTS}), s AS ({_SEGMENTS})
SELECT 'v' || coalesce(r.conv_id, o.conv_id) AS video_id, CASE WHEN r.conv_id IS NULL THEN 'old' ELSE md5(raw) END AS raw_md5,
  CAST(CASE WHEN r.conv_id IS NULL THEN 1 ELSE coalesce(n, 0) END AS BIGINT) AS segments
FROM r FULL JOIN o ON r.conv_id = o.conv_id LEFT JOIN (SELECT video_id, count(*) AS n FROM s GROUP BY video_id) c ON c.video_id = 'v' || r.conv_id""")
def m4_p5_replace_transcripts(spark: SparkSession, d: str) -> DataFrame:
    old = _sql(spark, d, _OLD_TRANSCRIPTS).select(F.concat(F.lit("v"), "conv_id").alias("video_id"))
    then = F.expr(THEN)
    transcriptions = old.select(F.concat(F.lit("t"), "video_id").alias("id"), "video_id", F.lit("old").alias("raw_text"), F.lit("en").alias("language"), then.alias("created_at"))
    zero = F.lit(0).cast("decimal(10,2)")
    segments = old.select(F.concat(F.lit("s"), "video_id").alias("id"), F.concat(F.lit("t"), "video_id").alias("transcription_id"), zero.alias("start_time_sec"), zero.alias("end_time_sec"), F.lit("x").alias("text"), F.lit("").alias("speaker_label"), then.alias("created_at"))
    parsed = parse_responses(_responses(spark, d))
    new_t, new_s = merge.replace_transcripts(transcriptions, segments, transcriptions_of(parsed, F.expr(NOW)), segments_of(parsed, F.expr(NOW)))
    counts = new_s.groupBy(F.col("transcription_id").alias("id")).agg(F.count("*").alias("segments"))
    return new_t.join(counts, "id", "left").select("video_id", F.when(F.col("raw_text") == "old", "old").otherwise(F.md5("raw_text")).alias("raw_md5"), F.coalesce("segments", F.lit(0)).alias("segments"))


@_query("""SELECT doc_id, CAST(i AS BIGINT) AS chunk_no, md5(substring(text, CAST(i * 5500 + 1 AS BIGINT), 6000)) AS chunk_md5
FROM (SELECT doc_id, text, unnest(range(CASE WHEN length(text) = 0 THEN 0 ELSE 1 + CAST(ceil(greatest(0,
  length(text) - 6000) / 5500) AS BIGINT) END)) AS i FROM documents WHERE text IS NOT NULL)""")
def g1_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunks(_table(spark, d, "documents"), "text", ["doc_id"]).select("doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.md5("chunk").alias("chunk_md5"))


# ---------------------------------------------------------------- model responses

_ANSWER_LINE = """CASE WHEN turn % 4 = 2 AND conv_id % 3 > 0 THEN concat('Part ', turn, ':') WHEN turn % 4 = 3 THEN concat('* "', substr(h, 1, 8), '" – ', substr(h, 9, 6))
  WHEN turn % 4 = 1 AND turn > 1 THEN concat('*', substr(h, 1, 10), ': ', substr(h, 11, 9), ': more') WHEN turn % 4 = 0 THEN concat(' * ', substr(h,
  1, 12), ' ') ELSE concat('Note ', substr(h, 1, 5)) END"""
_ANSWER = f"concat(CASE WHEN turn % 5 = 4 THEN '---\n' ELSE '' END, CASE WHEN conv_id % 11 = 0 AND turn = 3 THEN '*(None)*\n' ELSE '' END, {_ANSWER_LINE})"


def _answers(spark: SparkSession, d: str) -> DataFrame:
    c = _table(spark, d, "conversations").select("conv_id", "turn", F.md5("text").alias("h"))
    lines = c.select("conv_id", "turn", F.expr(_ANSWER).alias("line")).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "line"))).alias("l"))
    return lines.select("conv_id", F.concat(F.lit("---\n"), F.array_join("l.line", "\n"), F.lit("\n---")).alias("raw"))


_PARSED = f"""WITH c AS (SELECT conv_id, turn, md5(text) AS h FROM conversations), r AS (SELECT conv_id, string_agg({_ANSWER},
  chr(10) ORDER BY turn) AS raw FROM c GROUP BY conv_id),
b0 AS (SELECT conv_id, string_split_regex(regexp_replace(raw, '^\\s*---+\\s*\\n?', ''), '\\n---+\\n') AS bl FROM r), b1 AS (SELECT conv_id,
  unnest(range(1, len(bl) + 1)) AS block_no, bl FROM b0),
b AS (SELECT conv_id, block_no, string_split(trim(bl[block_no], E' \\n'), chr(10)) AS ls FROM b1 WHERE trim(bl[block_no],
  E' \\n') <> '' AND lower(bl[block_no]) NOT LIKE '%(none)%'),
l0 AS (SELECT conv_id, block_no, unnest(range(1, len(ls) + 1)) AS line_no, ls FROM b), l AS (SELECT conv_id, block_no, line_no,
  trim(ls[line_no]) AS line, trim(ls[1]) AS first_line FROM l0),
h AS (SELECT *, line LIKE '*%' AS star, CASE WHEN line NOT LIKE '*%' AND line LIKE '%:' THEN trim(rtrim(line, ':')) END AS header FROM l),
f AS (SELECT *, last_value(header IGNORE NULLS) OVER (PARTITION BY conv_id, block_no ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cat FROM h),
s AS (SELECT conv_id, block_no, count(*) FILTER (WHERE star AND coalesce(cat, '') <> '') AS normal, max(header) IS NULL AS headless,
  any_value(first_line) AS first_line, count(*) FILTER (WHERE star AND line_no > 1) AS later FROM f GROUP BY conv_id, block_no),
u AS (SELECT *, sum(normal) OVER (PARTITION BY conv_id ORDER BY block_no) AS before FROM s),
g AS (SELECT conv_id, min(block_no) AS block_no, arg_min(first_line,
  block_no) AS first_line FROM u WHERE before = 0 AND headless AND first_line NOT LIKE '*%' AND later > 0 GROUP BY conv_id),
o AS (SELECT f.conv_id, f.block_no, f.line_no, f.line, coalesce(nullif(cat, ''), trim(rtrim(g.first_line,
  ':'))) AS category FROM f LEFT JOIN g ON f.conv_id = g.conv_id AND f.block_no = g.block_no AND f.line_no > 1
  WHERE star AND (coalesce(cat, '') <> '' OR g.conv_id IS NOT NULL)),
t AS (SELECT *, trim(substr(line, 2)) AS body, row_number() OVER (PARTITION BY conv_id ORDER BY block_no, line_no) - 1 AS pos FROM o)
SELECT conv_id, CAST(pos AS BIGINT) AS pos, category, CASE WHEN body LIKE '"%" – %' THEN regexp_extract(body, '" – (.*)$',
  1) WHEN body LIKE '%: %' THEN split_part(body, ': ', 1) ELSE body END AS title,
  CASE WHEN body LIKE '"%" – %' THEN regexp_extract(body, '^"([^"]*)"', 1) WHEN body LIKE '%: %' THEN substr(body, strpos(body, ': ') + 2) ELSE '' END AS description FROM t"""


@_query(_PARSED)
def g2_g3_w3_parsed_insights(spark: SparkSession, d: str) -> DataFrame:
    return parse_insights(_answers(spark, d), ["conv_id"]).withColumn("pos", F.col("pos").cast("bigint"))


@_query(f"SELECT category, count(*) AS insights, count(DISTINCT conv_id) AS videos FROM ({_PARSED}) GROUP BY category")
def a5_insights_by_category(spark: SparkSession, d: str) -> DataFrame:
    return parse_insights(_answers(spark, d), ["conv_id"]).groupBy("category").agg(F.count("*").alias("insights"), F.count_distinct("conv_id").alias("videos"))


def _found(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents").filter("text is not null and text <> ''")
    title = F.expr("CASE doc_id % 4 WHEN 0 THEN 'ab' WHEN 1 THEN substr(text, 1, 200) WHEN 2 THEN '' ELSE concat('T', doc_id) END")
    return docs.select(F.concat(F.lit("d"), "doc_id").alias("video_id"), F.lit(0).alias("chunk_no"), F.lit(0).alias("pos"), F.expr("CASE WHEN doc_id % 3 = 0 THEN 'Frameworks and exercises' ELSE 'Quotes' END").alias("category"), T.strip(title).alias("title"), F.expr("CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat('D', doc_id) END").alias("description"), F.col("text").alias("chunk"))


_FOUND_SQL = r"SELECT doc_id, regexp_replace(CASE doc_id % 4 WHEN 0 THEN 'ab' WHEN 1 THEN substr(text, 1, 200) WHEN 2 THEN '' ELSE 'T' || doc_id END, '^\s+|\s+$', '', 'g') AS title, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'D' || doc_id END AS description, text AS chunk, text AS told FROM documents WHERE text <> ''"


@_query(f"""WITH f AS ({_FOUND_SQL})
SELECT 'd' || doc_id AS video_id, 'title' AS kind, md5('Title of ' || coalesce(nullif(description, ''), title)) AS prompt_md5 FROM f WHERE length(title) < 3 OR length(title) > 120
UNION ALL SELECT 'd' || doc_id, 'timestamps', md5(told || ' # ' || coalesce(nullif(description, ''), title)) FROM f
UNION ALL SELECT 'd' || doc_id, 'framework', md5(coalesce(nullif(title, ''), 'Framework') || ' in ' || chunk) FROM f WHERE doc_id % 3 = 0""")
def p6_p7_j4_j5_requests(spark: SparkSession, d: str) -> DataFrame:
    found = _found(spark, d)
    told = _table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("video_id"), F.col("text").alias("timestamped"))
    asked = I.title_requests(found, F.lit("Title of {insight}")).unionByName(I.timestamp_requests(found, told, F.lit("{transcript} # {insight}"))).unionByName(I.framework_requests(found, F.lit("{topic} in {raw_transcript}")))
    return asked.select("video_id", "kind", F.md5("prompt").alias("prompt_md5"))


@_query(f"""WITH f AS ({_FOUND_SQL})
SELECT 'd' || doc_id AS video_id, CASE WHEN length(title) BETWEEN 3 AND 120 THEN title WHEN doc_id % 7 = 0 THEN '' ELSE 'New ' || doc_id END AS title,
  CAST(CASE WHEN doc_id % 2 = 0 THEN doc_id % 60 + 60 END AS DOUBLE) AS start_time,
  CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'F' || doc_id END AS framework, md5(substr(chunk, 1, 8000)) AS chunk_md5 FROM f""")
def j6_f9_completed_insights(spark: SparkSession, d: str) -> DataFrame:
    """Answers from a table: some are missing."""
    found = _found(spark, d)
    told = found.select("video_id", F.lit("x").alias("timestamped"))
    titles = I.title_requests(found, F.lit("{insight}"))
    number = F.expr("cast(substr(video_id, 2) as bigint)")
    given = titles.filter(number % 7 > 0).select("request_id", F.concat(F.lit("<title>New "), number, F.lit(" </title>")).alias("raw"))
    titled = I.with_titles(found, titles, given)
    more = I.timestamp_requests(titled, told, F.lit("{insight}")).unionByName(I.framework_requests(titled, F.lit("{topic}")))
    raw = F.when(F.col("kind") == "framework", F.concat(F.lit("<FrameWork>F"), number, F.lit("</FrameWork>"))).otherwise(F.concat(F.lit("<start_time>1:"), number % 60, F.lit("</start_time>")))
    answers = more.filter(number % 2 == 0).select("request_id", raw.alias("raw"))
    rows = I.completed(titled, more, answers, found.select("video_id", F.lit("p").alias("podcast")), F.expr(NOW))
    return rows.select("video_id", "title", F.col("start_time_sec").cast("double").alias("start_time"), F.col("framework_markdown").alias("framework"), F.md5("source_chunk").alias("chunk_md5"))


def stub_answer(kind: str, prompt: str) -> str:
    """A model that always says the same kind of thing; used where a run needs one."""
    return {
        "insights": f"---\nFrameworks and exercises:\n* {len(prompt)} chars: seen\nPoints of view:\n* ab: said\n---",
        "title": "<title>A better title</title>",
        "timestamps": "<start_time>1:00</start_time><end_time>2:30</end_time>",
        "framework": "<FrameWork>\n# Steps\n</FrameWork>",
    }[kind]


_TEMPLATES = {"extract_insights_system": "Find: {transcript}", "title_generation": "Name: {insight}", "timestamp_extraction": "When: {insight} in {transcript}", "make_framework_content": "Make {topic} of {raw_transcript}"}


@_query(f"""WITH r AS (SELECT * FROM ({_RAW_TEXTS}) WHERE raw <> ''), n AS (SELECT conv_id, 1 + CAST(ceil(greatest(0, length(raw) - 6000) / 5500) AS BIGINT) AS k FROM r)
SELECT 'v' || conv_id AS video_id, 2 * k AS insights, k AS frameworks, k AS better_titles, 60.0::DOUBLE * 2 * k AS starts, 150.0::DOUBLE * 2 * k AS ends FROM n""")
def k6_x1_m5_process(spark: SparkSession, d: str) -> DataFrame:
    """The whole job over all conversations with a fixed model."""
    tables, _ = jobs.process(_empty(spark), _responses(spark, d), {k: F.lit(v) for k, v in _TEMPLATES.items()}, stub_answer, F.expr(NOW))
    return tables.insights.groupBy("video_id").agg(
        F.count("*").alias("insights"), F.count("framework_markdown").alias("frameworks"), F.count_if(F.col("title") == "A better title").alias("better_titles"), F.sum("start_time_sec").cast("double").alias("starts"), F.sum("end_time_sec").cast("double").alias("ends")
    )


@_query("""SELECT 'd' || doc_id AS video_id,
  CAST(CASE WHEN quality IS NULL THEN 3 ELSE quality END AS BIGINT) AS insights FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality > 0""")
def m5_replace_insights(spark: SparkSession, d: str) -> DataFrame:
    """Three old insights per document; the labelled ones are processed and get as many as their label says."""
    docs = _table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("video_id"))
    kinds = spark.createDataFrame([], schemas.INSIGHTS)
    full = lambda df: df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.dtypes])
    old = full(docs.select("video_id", F.explode(F.array(F.lit("1"), F.lit("2"), F.lit("3"))).alias("id")))
    labels = _table(spark, d, "labels").select(F.concat(F.lit("d"), "doc_id").alias("video_id"), "quality")
    new = full(labels.filter("quality > 0").select("video_id", F.explode(F.transform(F.sequence(F.lit(1), "quality"), lambda k: k.cast("string"))).alias("id")))
    return merge.replace_insights(old, new, labels).groupBy("video_id").agg(F.count("*").alias("insights"))


@_query("""SELECT 'd' || doc_id AS video_id, CAST(20 * k AS INT) AS chunk_no, md5('timestamps' || 'In ' || text || ' find D' || doc_id || '-' || k || '.') AS raw
FROM documents, (VALUES (0), (1), (2)) AS n(k) WHERE text IS NOT NULL""")
def j4_x1_asked_by_video(spark: SparkSession, d: str) -> DataFrame:
    """Three insights of every document in two stretches; each stretch sends the document's text to the model once."""
    docs = _table(spark, d, "documents").filter("text IS NOT NULL").withColumn("video_id", F.concat(F.lit("d"), "doc_id"))
    found = docs.select("doc_id", "video_id", F.explode(F.array(*map(F.lit, range(3)))).alias("k"))
    found = found.select("video_id", (F.col("k") * 20).alias("chunk_no"), F.lit(0).alias("pos"), F.lit("t").alias("title"), F.concat(F.lit("D"), "doc_id", F.lit("-"), "k").alias("description"))
    told, template = docs.select("video_id", F.col("text").alias("timestamped")), F.lit("In {transcript} find {insight}.")
    answers = I.ask_by_video(I.told_by_video(found, told, template), lambda kind, prompt: hashlib.md5((kind + prompt).encode()).hexdigest())
    return answers.select("video_id", "chunk_no", "raw")


# ---------------------------------------------------------------- integrity


@_query("""SELECT 'lineitem' AS relation, l_orderkey AS id, CAST(l_linenumber AS BIGINT) AS part FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderkey % 3 > 0)
UNION ALL SELECT 'documents', doc_id, 0 FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)""")
def j1_j7_missing_by_filter(spark: SparkSession, d: str) -> DataFrame:
    """Lines without an order and documents without a label, found through a filter of the parents' keys."""
    lines = _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    a = bloom.missing(lines, _table(spark, d, "orders").select("o_orderkey").filter("o_orderkey % 3 > 0"), "l_orderkey", "o_orderkey")
    b = bloom.missing(_table(spark, d, "documents").select("doc_id"), _table(spark, d, "labels").select("doc_id"), "doc_id", "doc_id")
    named = lambda df, relation, key, part: df.select(F.lit(relation).alias("relation"), F.col(key).alias("id"), part.cast("bigint").alias("part"))
    return named(a, "lineitem", "l_orderkey", F.col("l_linenumber")).unionByName(named(b, "documents", "doc_id", F.lit(0)))


@_query("""SELECT 'lineitem' AS relation, count(*) AS orphans FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderkey % 3 > 0)
UNION ALL SELECT 'labels', count(*) FROM labels WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = labels.doc_id AND d.doc_id % 4 > 0)""")
def j7_orphans(spark: SparkSession, d: str) -> DataFrame:
    a = integrity.orphans(_table(spark, d, "lineitem"), _table(spark, d, "orders").filter("o_orderkey % 3 > 0"), "l_orderkey", "o_orderkey")
    b = integrity.orphans(_table(spark, d, "labels"), _table(spark, d, "documents").filter("doc_id % 4 > 0"), "doc_id", "doc_id")
    count = lambda df, name: df.agg(F.count("*").alias("orphans")).select(F.lit(name).alias("relation"), "orphans")
    return count(a, "lineitem").unionByName(count(b, "labels"))


@_query("""WITH t AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 > 0), v AS (SELECT c_custkey FROM customer WHERE c_custkey % 4 > 0)
SELECT 'transcriptions' AS relation, count(*) AS orphans FROM t WHERE o_custkey NOT IN (SELECT c_custkey FROM v)
UNION ALL SELECT 'segments', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM t)
UNION ALL SELECT 'insights', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM v)""")
def j7_orphan_report(spark: SparkSession, d: str) -> DataFrame:
    """Customers as videos, orders as transcriptions and insights, lines as segments; some parents are missing."""
    orders = _table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("video_id"))
    videos = _table(spark, d, "customer").filter("c_custkey % 4 > 0").select(F.col("c_custkey").alias("video_id"))
    lines = _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("transcription_id"))
    return integrity.orphan_report(videos, orders.filter("id % 3 > 0"), lines, orders)


@_query("""WITH gone AS (SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0)
SELECT 'videos' AS relation, count(*) AS n FROM customer WHERE c_custkey % 5 > 0 UNION ALL SELECT 'transcriptions', count(*) FROM orders WHERE o_custkey % 5 > 0
UNION ALL SELECT 'segments', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 5 > 0 UNION ALL SELECT 'insights',
  count(*) FROM orders WHERE o_custkey % 5 > 0""")
def j8_cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """Customers as videos, their orders as transcriptions and insights, the lines as segments."""
    videos = _table(spark, d, "customer").select(F.col("c_custkey").alias("video_id"))
    orders = _table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("video_id"))
    lines = _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("transcription_id"))
    left = integrity.cascade_delete(videos, orders, lines, orders, videos.filter("video_id % 5 = 0"))
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), "n") for name, df in zip(("videos", "transcriptions", "segments", "insights"), left, strict=True)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


# ---------------------------------------------------------------- search

_DOCUMENT = "CAST(doc_id AS {s}) AS id, concat('v', doc_id % 100) AS video_id, source AS podcast, lang AS category, substr(text, 1, 60) AS title, text AS description, CAST(doc_id % 50 AS DOUBLE) AS start_time_sec, CASE WHEN doc_id % 3 = 0 THEN text END AS framework_markdown"
_TERMS = "regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}]+')"
_HELD = ", ".join(f"{_TERMS.format(c=c)} AS t{k}" for k, c in enumerate(search.ATTRIBUTES))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("SELECT " + _DOCUMENT.format(s="STRING") + " FROM {src} WHERE text IS NOT NULL", src=_table(spark, d, "documents"))


def _counts(asked: str) -> str:
    return ", ".join(f"len([x FOR x IN t{k} IF list_contains({asked}, x)]) AS n{k}" for k in range(3))


_RANK = "CASE WHEN n0 > 0 THEN 0 WHEN n1 > 0 THEN 1 WHEN n2 > 0 THEN 2 ELSE 0 END"


@_query(f"""WITH d AS (SELECT {_DOCUMENT.format(s="VARCHAR")} FROM documents WHERE text IS NOT NULL), h AS (SELECT *, {_HELD} FROM d WHERE category = 'en'),
m AS (SELECT id, title, start_time_sec, {_counts("['the', 'of']")} FROM h WHERE list_has_all(list_concat(t0, t1, t2), ['the', 'of'])),
r AS (SELECT id, {_RANK} AS attribute, n0 + n1 + n2 AS occurrences, start_time_sec, title, count(*) OVER () AS total FROM m)
SELECT id, CAST(attribute AS BIGINT) AS attribute, CAST(occurrences AS BIGINT) AS occurrences,
  CAST(total AS BIGINT) AS total FROM r ORDER BY start_time_sec DESC NULLS LAST, title, attribute, occurrences DESC, id LIMIT 100""")
def k9_p8_o2_o3_a4_search(spark: SparkSession, d: str) -> DataFrame:
    hits = search.search(_documents(spark, d), "The of, THE", {"category": "en", "podcast": ""}, "start_time_sec:desc, title:asc", 500)
    return hits.select("id", *[F.col(c).cast("bigint").alias(c) for c in ("attribute", "occurrences", "total")])


@_query(f"""WITH d AS (SELECT {_DOCUMENT.format(s="VARCHAR")} FROM documents WHERE text IS NOT NULL), h AS (SELECT id, {_HELD} FROM d),
q AS (SELECT item_id AS query_id, list_distinct({_TERMS.format(c="text")}) AS asked FROM benchmark),
m AS (SELECT query_id, id, {_counts("asked")} FROM h, q WHERE len(asked) > 0 AND list_has_all(list_concat(t0, t1, t2), asked)),
r AS (SELECT query_id, id, {_RANK} AS attribute, n0 + n1 + n2 AS occurrences FROM m), p AS (SELECT *,
  row_number() OVER (PARTITION BY query_id ORDER BY attribute, occurrences DESC, id) AS place FROM r)
SELECT query_id, id, CAST(attribute AS BIGINT) AS attribute, CAST(occurrences AS BIGINT) AS occurrences, place FROM p WHERE place <= 20""")
def k10_batch_search(spark: SparkSession, d: str) -> DataFrame:
    asked = _table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
    return search.batch_search(_documents(spark, d), asked).select("query_id", "id", *[F.col(c).cast("bigint").alias(c) for c in ("attribute", "occurrences", "place")])


@_query(f"""SELECT id, video_id, podcast, category, md5(title) AS title_md5, md5(description) AS description_md5, start_time_sec, md5(nullif(framework_markdown,
  '')) AS framework_md5 FROM (SELECT {_DOCUMENT.format(s='VARCHAR')} FROM documents WHERE text IS NOT NULL)""")
def s8_search_documents(spark: SparkSession, d: str) -> DataFrame:
    """The documents by way of the bulk sink."""
    rows = _documents(spark, d).withColumn("end_time_sec", F.lit(None).cast("decimal(10,2)"))
    S.write_documents(I.search_documents(rows), folder := S.shared_folder(spark))
    schema = ", ".join(f"{c} {'double' if c.endswith('_sec') else 'string'}" for c in schemas.SEARCH_FIELDS)
    back = spark.read.schema(schema).json(folder)
    return back.select("id", "video_id", "podcast", "category", F.md5("title").alias("title_md5"), F.md5("description").alias("description_md5"), "start_time_sec", F.md5("framework_markdown").alias("framework_md5"))


# ---------------------------------------------------------------- tables, prompts, composite jobs


@_query("""SELECT o_orderkey, CASE WHEN o_orderkey % 1000 = 7 THEN 0 ELSE o_custkey END AS o_custkey FROM orders
WHERE o_orderkey % 1000 = 7 OR NOT (o_custkey % 4 = 0 AND o_orderkey % 50 = 0)""")
def s7_bucketed_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a bucketed table: some get another customer, some are deleted; only touched buckets are written again."""
    folder, schema = S.shared_folder(spark), "o_orderkey bigint, o_custkey bigint"
    orders = _table(spark, d, "orders").select("o_orderkey", "o_custkey")
    S.write_table(orders, folder, "o_orderkey", 64)
    new = orders.filter("o_orderkey % 1000 = 7").withColumn("o_custkey", F.lit(0).cast("bigint"))
    gone = orders.filter("o_custkey % 4 = 0 and o_orderkey % 50 = 0")
    keys = new.unionByName(gone).select("o_orderkey")
    old, numbers = S.touched(spark, folder, schema, keys, "o_orderkey", 64)
    S.overwrite_buckets(merge.replace_by_key(old, new, keys, "o_orderkey"), folder, "o_orderkey", numbers, 64)
    return S.read_table(spark, folder, schema)


@_query("""SELECT n_name AS prompt_set, 'a' AS name,
  CASE WHEN n_nationkey % 2 = 0 THEN 'own ' || n_nationkey ELSE 'default a' END AS template FROM nation UNION ALL SELECT n_name, 'b',
  CASE WHEN n_nationkey % 3 = 0 THEN 'b ' || n_nationkey ELSE '' END FROM nation""")
def s9_prompt_templates(spark: SparkSession, d: str) -> DataFrame:
    n = _table(spark, d, "nation")
    own = n.filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("prompt_set"), F.lit("a").alias("name"), F.concat(F.lit("own "), "n_nationkey").alias("template"))
    own = own.unionByName(n.filter("n_nationkey % 3 = 0").select(F.col("n_name").alias("prompt_set"), F.lit("b").alias("name"), F.concat(F.lit("b "), "n_nationkey").alias("template")))
    usual = n.limit(1).select(F.lit(prompts.DEFAULT_SET).alias("prompt_set"), F.lit("a").alias("name"), F.lit("default a").alias("template"))
    asked = n.select(F.col("n_name").alias("prompt_set"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("name"))
    return prompts.resolve(own.unionByName(usual), asked)


def _said(text: str) -> Column:
    """A speech-to-text response with one transcript, given as an SQL expression."""
    transcript = F.struct(F.expr(text).alias("transcript"))
    return F.to_json(F.struct(F.struct(F.array(F.struct(F.array(transcript).alias("alternatives"))).alias("channels")).alias("results")))


def _heard(spark: SparkSession, d: str) -> DataFrame:
    """Responses for the videos of most users, by both kinds of id; for some videos there are several."""
    users = _table(spark, d, "events").filter("user_id % 4 > 0").select("user_id", "event_type").distinct()
    ids = F.explode(F.array(F.concat(F.lit("v"), "user_id"), F.expr("substr(md5(cast(user_id as string)), 1, 11)")))
    return users.select(ids.alias("video_id"), _said("concat('heard ', user_id, event_type)").alias("response"))


@_query(f"""WITH w AS ({_LINK_SQL}), l AS ({_NEW_LINKS}), o AS ({_OLD_LINKS}), u AS (SELECT DISTINCT user_id FROM events WHERE user_id % 4 > 0),
h AS (SELECT 'v' || user_id AS video_id FROM u UNION ALL SELECT substr(md5(CAST(user_id AS VARCHAR)), 1, 11) FROM u),
b AS (SELECT 'csv' AS branch, (SELECT count(*) FROM w) AS seeded, (SELECT count(*) FROM h WHERE video_id IN (SELECT video_id FROM w)) AS processed
  UNION ALL SELECT 'links', (SELECT count(*) FROM (SELECT DISTINCT video_id, podcast FROM l)), (SELECT count(*) FROM h WHERE video_id IN (SELECT video_id FROM l))
  UNION ALL SELECT 'stored', (SELECT count(*) FROM o), (SELECT count(*) FROM h WHERE video_id IN (SELECT video_id FROM o)))
SELECT branch, seeded, processed, 2 * processed AS insights FROM b""")
def k7_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Seed, backlog, processing and summary: from CSV links, from given links, and from the stored links."""
    templates = {k: F.lit(v) for k, v in _TEMPLATES.items()}
    heard = _heard(spark, d)
    branches = {
        "csv": (_empty(spark), {"csv_links": first_occurrences(_links(spark, d), schemas.MIN_DURATION)}),
        "links": (_empty(spark), {"links": _sql(spark, d, _NEW_LINKS)}),
        "stored": (_empty(spark)._replace(seed_links=_seed_links(spark, d)), {}),
    }
    out = None
    for name, (tables, given) in branches.items():
        _, _, summary = jobs.backfill(tables, heard, templates, stub_answer, F.expr(NOW), **given)
        row = summary.select(F.lit(name).alias("branch"), "seeded", "processed", "insights")
        out = row if out is None else out.unionByName(row)
    return out


@_query(f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY o_orderdate DESC NULLS LAST, video_id) AS n FROM ({_LISTED}) WHERE podcast <> 'p3'),
k AS (SELECT * FROM f WHERE n <= 50), p AS (SELECT podcast, count(*) AS fetched, count(*) FILTER (WHERE seconds >= 300) AS upserted,
  count(*) FILTER (WHERE seconds >= 300 AND CAST(video_id AS BIGINT) % 7 > 0) AS processed FROM k GROUP BY podcast)
SELECT podcast, fetched, upserted, processed, 2 * processed AS insights FROM p""")
def k8_sync(spark: SparkSession, d: str) -> DataFrame:
    """Fetch, backlog and processing in one run: customers as channels, orders as videos, most of which have been heard."""
    listing, details, channels = _landed(spark, d)
    heard = _table(spark, d, "orders").filter("o_orderkey % 7 > 0").select(F.col("o_orderkey").cast("string").alias("video_id"), _said("concat('order ', o_orderkey)").alias("response"))
    templates = {k: F.lit(v) for k, v in _TEMPLATES.items()}
    tables, fetched, per_video = jobs.sync(_empty(spark), listing, details, channels, heard, templates, stub_answer, F.expr(NOW))
    done = per_video.join(tables.videos.select("video_id", "podcast"), "video_id").groupBy("podcast").agg(F.count("*").alias("processed"), F.sum("insights").alias("insights"))
    shows = fetched.filter("podcast is not null").join(done, "podcast", "left")
    return shows.select("podcast", "fetched", "upserted", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("processed", "insights")])


@_query(f"""WITH r AS (SELECT * FROM ({_RAW_TEXTS}) WHERE raw <> ''), n AS (SELECT 2 * (1 + CAST(ceil(greatest(0, length(raw) - 6000) / 5500) AS BIGINT)) AS k FROM r)
SELECT (SELECT count(DISTINCT conv_id) FROM conversations) AS seeded, count(*) AS processed, CAST(coalesce(sum(k), 0) AS BIGINT) AS insights FROM n""")
def a3_run_summary(spark: SparkSession, d: str) -> DataFrame:
    responses = _responses(spark, d)
    _, per_video = jobs.process(_empty(spark), responses, {k: F.lit(v) for k, v in _TEMPLATES.items()}, stub_answer, F.expr(NOW))
    return jobs.run_summary(responses.agg(F.count("*").alias("seeded")), per_video)


@_query(f"""WITH r AS (SELECT * FROM ({_RAW_TEXTS}) WHERE raw <> ''), n AS (SELECT conv_id, 2 * (1 + CAST(ceil(greatest(0, length(raw) - 6000) / 5500) AS BIGINT)) AS k FROM r)
SELECT 'v' || conv_id AS video_id, k AS insights, 1 AS transcriptions FROM n""")
def t1_k8_sync(spark: SparkSession, d: str) -> DataFrame:
    """Responses land in two lots, the second with some of the first again; each is processed once."""
    folder = S.shared_folder(spark)
    responses = _responses(spark, d)
    sync.create_tables(spark, f"{folder}/tables", 8)
    templates = {k: F.lit(v) for k, v in _TEMPLATES.items()}
    half = F.crc32("video_id") % 2 == 0
    for lot in (responses.filter(half), responses.filter(~half | (F.crc32("video_id") % 10 == 0))):
        lot.write.mode("append").json(f"{folder}/landing")
        sync.sync(spark, f"{folder}/landing", f"{folder}/tables", f"{folder}/checkpoint", templates, stub_answer, 8).awaitTermination()
    tables = sync.read_tables(spark, f"{folder}/tables")
    stored = tables.transcriptions.groupBy("video_id").agg(F.count("*").alias("transcriptions"))
    return I.insights_per_video(tables.transcriptions, tables.insights).join(stored, "video_id")


_LANDED_SQL = """SELECT CAST(o_orderkey AS VARCHAR) AS video_id, 'p' || c_nationkey AS podcast, o_orderkey % 9 > 0 AND c_nationkey <> 3 AS listed,
  o_orderkey % 5 > 0 AS described, o_orderkey % 12 * 60 >= 300 AS long, o_orderkey % 7 > 0 AS heard FROM orders JOIN customer ON o_custkey = c_custkey"""


@_query(f"""WITH o AS ({_LANDED_SQL})
SELECT podcast, count(*) FILTER (WHERE listed AND described) AS newest, count(*) FILTER (WHERE listed AND described AND long) AS videos,
  count(*) FILTER (WHERE listed AND described AND long AND heard) AS transcriptions, 2 * count(*) FILTER (WHERE listed AND described AND long AND heard) AS insights,
  count(*) FILTER (WHERE listed AND described AND long AND NOT heard) AS backlog FROM o GROUP BY podcast HAVING count(*) FILTER (WHERE listed AND described) > 0
UNION ALL SELECT '(waiting)', count(*) FILTER (WHERE listed AND NOT described), count(*) FILTER (WHERE described AND NOT listed),
  count(*) FILTER (WHERE heard AND NOT (listed AND described AND long)), 2, 1 FROM o""")
def t1_s7_k8_fetch_sync(spark: SparkSession, d: str) -> DataFrame:
    """Listings, details and responses land in two lots, most of them apart; each lot is one commit of all tables.

    The row ``(waiting)`` has listings without details, details without listing, responses without video, commits and batches' last number.
    """
    folder = S.shared_folder(spark)
    listing, details, channels = _landed(spark, d)
    heard = _table(spark, d, "orders").filter("o_orderkey % 7 > 0").select(F.col("o_orderkey").cast("string").alias("video_id"), _said("concat('order ', o_orderkey)").alias("response"))
    store = stored_jobs.open_store(spark, f"{folder}/tables", 8)
    templates = {k: F.lit(v) for k, v in _TEMPLATES.items()}
    lot = lambda key, n: F.crc32(F.concat(F.lit(n), key)) % 2 == 0
    rows = {"listings": (listing, lot("channel_id", "l")), "details": (details, lot("channel_id", "d")), "responses": (heard, lot("video_id", "r"))}
    for number in range(2):
        for name, (df, first) in rows.items():
            df.filter(first if number == 0 else ~first).write.mode("append").json(f"{folder}/landing/{name}")
        fetch.sync(spark, f"{folder}/landing", store, f"{folder}/checkpoint", channels, templates, stub_answer, F.expr(NOW)).awaitTermination()
    now = store.snapshot()
    show = store.read("videos", now).select("video_id", "podcast")
    counts = store.read("newest", now).groupBy("podcast").agg(F.count("*").alias("newest"))
    for name in ("videos", "transcriptions", "insights", "backlog"):
        keyed = store.read(name, now).select("video_id").join(show, "video_id")
        counts = counts.join(keyed.groupBy("podcast").agg(F.count("*").alias(name)), "podcast", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    number = lambda name: store.read(name, now).agg(F.count("*").alias(name))
    waiting = number("listed").crossJoin(number("described")).crossJoin(number("waiting"))  # one row each
    return counts.union(waiting.select(F.lit("(waiting)"), "listed", "described", "waiting", F.lit(now.version).cast("bigint"), F.lit(now.batches[fetch.STREAM]).cast("bigint")))


@_query(f"SELECT * FROM ({ORACLE_SQL['m2_upsert_videos']}) v WHERE video_id NOT IN (SELECT DISTINCT 'v' || user_id FROM events WHERE user_id % 4 = 0)")
def k5_m2_s7_colocated(spark: SparkSession, d: str) -> DataFrame:
    """Videos and transcriptions as tables in the same buckets; the upsert shuffles the new videos only, the backlog nothing."""
    name = f"podspark_{uuid.uuid4().hex}"
    old = colocated.save(_videos(spark, d), f"{name}_old", "video_id", 8)
    merged = merge.upsert_stored_videos(old, _sql(spark, d, _NEW_VIDEOS), F.expr(NOW))
    videos = colocated.save(merged, f"{name}_videos", "video_id", 8, placed=True)
    heard = _table(spark, d, "events").filter("user_id % 4 = 0").select(F.concat(F.lit("v"), "user_id").alias("video_id")).distinct()
    heard = colocated.save(heard, f"{name}_transcriptions", "video_id", 8)
    ids = jobs.backlog(videos, heard, ordered=False).select("video_id")
    return _videos_out(videos.join(ids, "video_id", "left_semi"))


@_query(f"""SELECT 'v' || conv_id AS video_id, CASE conv_id % 3 WHEN 0 THEN 'broken' ELSE 'empty' END AS reason FROM (SELECT DISTINCT conv_id FROM conversations)
WHERE conv_id % 3 = 0 OR conv_id % 3 = 1 AND conv_id % 5 < 2""")
def s5_s6_rejected_responses(spark: SparkSession, d: str) -> DataFrame:
    """Responses cut off in the middle, with blanks for a transcript or without one, beside whole ones."""
    said = F.expr("CASE WHEN conv_id % 5 = 0 THEN '' WHEN conv_id % 5 = 1 THEN ' \t\n' ELSE concat('said ', conv_id) END")
    whole = _table(spark, d, "conversations").select("conv_id").distinct().withColumn("said", said).withColumn("response", _said("said"))
    cut = F.when(F.col("conv_id") % 3 == 0, F.expr("substr(response, 1, length(response) - 3)")).otherwise(F.when((F.col("conv_id") % 3 == 1) & (F.col("conv_id") % 5 == 0), "{}").otherwise(F.col("response")))
    rows = whole.filter("conv_id % 3 < 2").select(F.concat(F.lit("v"), "conv_id").alias("video_id"), cut.alias("response"))
    return rejected(rows).select("video_id", "reason")


@_query(f"""WITH l AS (SELECT * FROM ({_M1}) WHERE podcast <> '')
SELECT video_id, arg_max(podcast, updated || podcast) AS podcast, coalesce(arg_max(title, updated || podcast) FILTER (WHERE title <> ''), '') AS title,
  arg_max(seconds, updated || podcast) FILTER (WHERE seconds IS NOT NULL) AS seconds, true AS in_backlog FROM l GROUP BY video_id""")
def m3_k5_seed_by_changes(spark: SparkSession, d: str) -> DataFrame:
    """Links come in two lots; after each, videos are seeded from the links that changed, and the backlog is kept with them."""
    store = stored_jobs.open_store(spark, f"{S.shared_folder(spark)}/tables", 8)
    lots = ((_seed_links(spark, d).withColumn("seq", F.lit(0)), THEN), (_sql(spark, d, _NEW_LINKS), NOW))
    for links, at in lots:
        stored_jobs.seed_links(store, links, F.expr(at))
        stored_jobs.seed_from_links(store, F.expr(at))
    open_ = stored_jobs.backlog(store, ordered=False).select("video_id", F.lit(True).alias("open"))
    rows = store.read("videos").join(open_, "video_id", "left")
    return rows.select("video_id", "podcast", "title", F.col("duration_seconds").cast("double").alias("seconds"), F.coalesce("open", F.lit(False)).alias("in_backlog"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Insights by category out of model responses over chunked transcripts."""
    return QUERIES["a5_insights_by_category"](spark, d)
