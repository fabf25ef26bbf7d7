"""Transcripts, timestamped text and segments out of speech-to-text responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podspark import schemas
from podspark.functions import text as T


def parse_responses(rows: DataFrame, response: str = "response") -> DataFrame:
    """Adds ``raw_text``, ``utterances`` and ``timestamped`` to rows with a response as JSON text."""
    parsed = F.from_json(F.coalesce(F.col(response), F.lit("")), schemas.SPEECH)
    first = F.get(F.get(F.col("_r.results.channels"), F.lit(0))["alternatives"], F.lit(0))["transcript"]
    said = F.transform(F.coalesce("_r.utterances", F.array()), lambda u: F.struct(u["start"].alias("start"), u["end"].alias("end"), T.strip(F.coalesce(u["transcript"], F.lit(""))).alias("text"), u["speaker"].alias("speaker")))
    kinds = "array<struct<start:double,end:double,text:string,speaker:string>>"
    return rows.withColumn("_r", parsed).withColumns({"raw_text": T.strip(F.coalesce(first, F.lit(""))), "utterances": said.cast(kinds)}).drop("_r").withColumn("timestamped", timestamped(F.col("utterances"), F.col("raw_text")))


def rejected(rows: DataFrame, response: str = "response") -> DataFrame:
    """Rows whose response gives no text, with ``reason``: 'broken' if it is no JSON of the expected kind, else 'empty'."""
    kind = f"{schemas.SPEECH}, _broken string"
    read = rows.withColumn("_r", F.from_json(F.col(response), kind, {"columnNameOfCorruptRecord": "_broken"}))
    first = F.get(F.get(F.col("_r.results.channels"), F.lit(0))["alternatives"], F.lit(0))["transcript"]
    reason = F.when(F.col("_r._broken").isNotNull(), "broken").when(T.strip(F.coalesce(first, F.lit(""))) == "", "empty")
    return read.withColumn("reason", reason).filter("reason is not null").drop("_r")


def printable(u: Column) -> Column:
    return u["start"].isNotNull() & (F.length(u["text"]) > 0)


def timestamped(utterances: Column, raw: Column) -> Column:
    """Lines "HH:MM:SS speaker: text" in the order given; the plain text if there is no utterance at all."""
    lines = F.transform(F.filter(utterances, printable), lambda u: T.utterance_line(u["start"], u["speaker"], u["text"]))
    return F.when(F.size(utterances) > 0, F.array_join(lines, "\n")).otherwise(raw)


def transcriptions_of(parsed: DataFrame, now: Column) -> DataFrame:
    """One row per video with a text that is not empty."""
    return parsed.filter(F.length("raw_text") > 0).select(T.deterministic_id(F.lit("transcription"), F.col("video_id")).alias("id"), "video_id", "raw_text", F.lit("en").alias("language"), now.alias("created_at"))


def segments_of(parsed: DataFrame, now: Column) -> DataFrame:
    """A row per utterance with start and end; no shuffle, as the transcription's id follows from the video's."""
    rows = parsed.filter(F.length("raw_text") > 0).select("video_id", F.posexplode("utterances").alias("pos", "u")).filter("u.start is not null and u.end is not null")
    transcription = T.deterministic_id(F.lit("transcription"), F.col("video_id"))
    return rows.select(
        T.deterministic_id(F.lit("segment"), F.col("video_id"), F.col("pos")).alias("id"),
        transcription.alias("transcription_id"),
        T.seconds(F.col("u.start")).alias("start_time_sec"),
        T.seconds(F.col("u.end")).alias("end_time_sec"),
        F.col("u.text").alias("text"),
        T.speaker_label(F.col("u.speaker")).alias("speaker_label"),
        now.alias("created_at"),
    )
