"""Prompts for insights, and insights completed by the answers: titles, time ranges, frameworks.

A request is a row (request_id, kind, video_id, chunk_no, pos, prompt); an answer is (request_id,
raw).  Answers come from any function or table; a missing answer counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podspark import schemas
from podspark.functions import text as T
from podspark.operators.parse import parse_insights

#: Chunks of a video whose requests go to the model in one row.
CHUNKS_A_ROW = 32
#: Answers, and characters of them, that leave the model's worker together.
ANSWERS, ANSWER_CHARS = 10_000, 1 << 20


def needs_title(title: Column) -> Column:
    return (F.length(T.strip(title)) < 3) | (F.length(T.strip(title)) > 120)


def needs_framework(category: Column) -> Column:
    return category.contains("ramework")


def _described(description: Column, title: Column) -> Column:
    return F.when(description != "", description).otherwise(title)


def _request(kind: str, prompt: Column, *key: str) -> list[Column]:
    parts = [F.col(k) if k in key else F.lit(None).cast("int") for k in ("chunk_no", "pos")]
    named = T.deterministic_id(F.lit(kind), F.col("video_id"), *[F.coalesce(p, F.lit(-1)) for p in parts])
    return [named.alias("request_id"), F.lit(kind).alias("kind"), F.col("video_id"), parts[0].cast("int").alias("chunk_no"), parts[1].cast("int").alias("pos"), prompt.alias("prompt")]


def insight_requests(chunks: DataFrame, template: Column) -> DataFrame:
    """One request per chunk; none without a template."""
    return chunks.filter(template != "").select(*_request("insights", T.render(template, {"transcript": F.col("chunk")}), "chunk_no"))


def title_requests(insights: DataFrame, template: Column) -> DataFrame:
    prompt = T.render(template, {"insight": _described(F.col("description"), F.col("title"))})
    return insights.filter(needs_title(F.col("title")) & (template != "")).select(*_request("title", prompt, "chunk_no", "pos"))


def timestamp_requests(insights: DataFrame, parsed: DataFrame, template: Column) -> DataFrame:
    """Each insight with the whole timestamped transcript of its video, which meets its insights once and is put into the prompts there."""
    told = insights.join(parsed.select("video_id", "timestamped"), "video_id")
    prompt = T.render(template, {"transcript": F.col("timestamped"), "insight": _described(F.col("description"), F.col("title"))})
    return told.filter(template != "").select(*_request("timestamps", prompt, "chunk_no", "pos"))


def framework_requests(insights: DataFrame, template: Column) -> DataFrame:
    topic = F.when(F.col("title") != "", F.col("title")).otherwise("Framework")
    prompt = T.render(template, {"topic": topic, "raw_transcript": F.col("chunk")})
    return insights.filter(needs_framework(F.col("category")) & (template != "")).select(*_request("framework", prompt, "chunk_no", "pos"))


def ask(requests: DataFrame, answer: Callable[[str, str], str]) -> DataFrame:
    """Runs a function (kind, prompt) -> text over all requests, in batches.

    Prompts are rendered in the stage that asks: nothing is shuffled after a template has been filled.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"request_id": frame["request_id"], "raw": [answer(k, p) for k, p in zip(frame["kind"], frame["prompt"], strict=True)]})

    return requests.select("request_id", "kind", "prompt").mapInPandas(run, "request_id string, raw string")


def ask_rows(rows: DataFrame, kind: str, prompt: Column, answer: Callable[[str, str], str], name: str) -> DataFrame:
    """The rows with the answer to each one's ``prompt`` in the column ``name``; null where the prompt is. Nothing is joined or shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [None if p is None else answer(kind, p) for p in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(raw, pa.string())], [*batch.schema.names[:-1], name])

    return rows.select("*", prompt.alias(name)).mapInArrow(run, rows.schema.add(name, "string"))


def told_by_video(insights: DataFrame, parsed: DataFrame, template: Column) -> DataFrame:
    """The timestamp requests of a video in one row: ``video_id``, ``template``, ``timestamped`` and ``asked``, an array of (request_id, chunk_no, pos, insight).

    A transcript is in one row, however many insights ask about it; of a very long video it is in one for every
    ``CHUNKS_A_ROW`` chunks, so that several tasks ask about it.
    """
    request, _, _, chunk_no, pos, _ = _request("timestamps", F.lit(None), "chunk_no", "pos")
    asked = insights.select("video_id", F.floor(F.col("chunk_no") / CHUNKS_A_ROW).alias("stretch"), F.struct(request, chunk_no, pos, _described(F.col("description"), F.col("title")).alias("insight")).alias("one"))
    lists = asked.groupBy("video_id", "stretch").agg(F.collect_list("one").alias("asked"))
    return lists.join(parsed.select("video_id", "timestamped"), "video_id").select("video_id", template.alias("template"), "timestamped", "asked").filter("template <> ''")


def ask_by_video(told: DataFrame, answer: Callable[[str, str], str]) -> DataFrame:
    """As ``ask`` on the timestamp requests: request_id and raw, and video_id, chunk_no and pos, so that no request has to be joined to its answer.

    Prompts are filled where the model is asked, as by ``text.render``.  The answers of many videos leave the worker together.
    """
    names = ["request_id", "video_id", "chunk_no", "pos", "raw"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one = batch.column("asked").flatten()
            held, chars, sent = [], 0, 0
            videos = np.repeat(np.arange(batch.num_rows), batch.column("asked").value_lengths().to_numpy(zero_copy_only=False))
            insights = one.field("insight").to_pylist()
            row = -1
            for k, video in enumerate(videos.tolist()):
                if video != row:
                    row, template, timestamped = video, batch.column("template")[video].as_py(), batch.column("timestamped")[video].as_py()
                    begun = None if timestamped is None else template.replace("{transcript}", timestamped)
                said = answer("timestamps", None if begun is None or insights[k] is None else begun.replace("{insight}", insights[k]))
                held.append(said)
                chars += len(said or "")
                if k + 1 == len(videos) or len(held) >= ANSWERS or chars >= ANSWER_CHARS:
                    part = slice(sent, k + 1)
                    keys = [one.field("request_id")[part], batch.column("video_id").take(pa.array(videos[part])), one.field("chunk_no")[part], one.field("pos")[part]]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(held, pa.string())], names)
                    held, chars, sent = [], 0, k + 1

    return told.select("video_id", "template", "timestamped", "asked").mapInArrow(run, "request_id string, video_id string, chunk_no int, pos int, raw string")


def answered(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Requests without their prompts, with ``raw``; empty where no answer came."""
    return requests.drop("prompt").join(answers.select("request_id", "raw"), "request_id", "left").withColumn("raw", F.coalesce("raw", F.lit("")))


def insights_of(requests: DataFrame, answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """Parsed insights with the chunk they come from: video_id, chunk_no, pos, category, title, description, chunk."""
    raw = answered(requests.filter("kind = 'insights'"), answers).select("video_id", "chunk_no", "raw")
    return parse_insights(raw, ["video_id", "chunk_no"]).join(chunks.select("video_id", "chunk_no", "chunk"), ["video_id", "chunk_no"])


def _by_kind(requests: DataFrame, answers: DataFrame, kind: str) -> DataFrame:
    return answered(requests.filter(F.col("kind") == kind), answers).select("video_id", "chunk_no", "pos", F.col("raw").alias(f"{kind}_raw"))


def with_titles(insights: DataFrame, requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Titles that were too short or too long give way to the answer; without a request they become empty."""
    return _with_title(insights.join(_by_kind(requests, answers, "title"), ["video_id", "chunk_no", "pos"], "left"))


def titled_and_framed(chunks: DataFrame, templates: Mapping[str, Column], answer: Callable[[str, str], str]) -> DataFrame:
    """Chunks (video_id, podcast, chunk_no, chunk) to their insights with titles and ``framework_raw``: every answer stays in the row that asked for it."""
    keep = ["video_id", "podcast", "chunk_no", "chunk"]
    template = templates["extract_insights_system"]
    asked = ask_rows(chunks.select(*keep), "insights", F.when(template != "", T.render(template, {"transcript": F.col("chunk")})), answer, "raw")
    found = parse_insights(asked, keep)
    template = templates["title_generation"]
    prompt = T.render(template, {"insight": _described(F.col("description"), F.col("title"))})
    titled = ask_rows(found, "title", F.when(needs_title(F.col("title")) & (template != ""), prompt), answer, "title_raw")
    titled = _with_title(titled)
    template = templates["make_framework_content"]
    topic = F.when(F.col("title") != "", F.col("title")).otherwise("Framework")
    prompt = T.render(template, {"topic": topic, "raw_transcript": F.col("chunk")})
    return ask_rows(titled, "framework", F.when(needs_framework(F.col("category")) & (template != ""), prompt), answer, "framework_raw")


def _with_title(rows: DataFrame) -> DataFrame:
    return rows.withColumn("title", F.when(needs_title(F.col("title")), F.coalesce(T.title_of(F.col("title_raw")), F.lit(""))).otherwise(F.col("title"))).drop("title_raw")


def completed(insights: DataFrame, requests: DataFrame, answers: DataFrame, podcasts: DataFrame, now: Column) -> DataFrame:
    """Rows of the insights table; ``podcasts`` has video_id and podcast."""
    key = ["video_id", "chunk_no", "pos"]
    rows = insights.join(_by_kind(requests, answers, "timestamps"), key, "left").join(_by_kind(requests, answers, "framework"), key, "left")
    return insight_rows(rows.join(podcasts.select("video_id", "podcast"), "video_id"), now)


def insight_rows(rows: DataFrame, now: Column) -> DataFrame:
    """Insights with their podcast, ``timestamps_raw`` and ``framework_raw`` as rows of the insights table."""
    return rows.select(
        T.deterministic_id(F.lit("insight"), F.col("video_id"), F.col("chunk_no"), F.col("pos")).alias("id"), "video_id", "podcast", "category", "title", "description",
        T.seconds(T.start_time_of(F.col("timestamps_raw"))).alias("start_time_sec"), T.seconds(T.end_time_of(F.col("timestamps_raw"))).alias("end_time_sec"),
        F.nullif(T.framework_of(F.col("framework_raw")), F.lit("")).alias("framework_markdown"), F.substring("chunk", 1, schemas.CHUNK_CHARS).alias("source_chunk"), now.alias("created_at"),
    )


def search_documents(insights: DataFrame) -> DataFrame:
    """The nine fields of the search index; an empty framework is none."""
    rows = insights.withColumn("framework_markdown", F.nullif("framework_markdown", F.lit("")))
    return rows.withColumns({c: F.col(c).cast("double") for c in ("start_time_sec", "end_time_sec")}).select(*schemas.SEARCH_FIELDS)


def insights_per_video(processed: DataFrame, insights: DataFrame) -> DataFrame:
    """Number of insights of every processed video, 0 included."""
    counts = insights.groupBy("video_id").agg(F.count("*").alias("insights"))
    return processed.select("video_id").distinct().join(counts, "video_id", "left").withColumn("insights", F.coalesce("insights", F.lit(0)))
