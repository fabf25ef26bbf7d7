"""Prompt templates: one text file per set and name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_SET = "operators"
#: The four prompts.
NAMES = ("extract_insights_system", "title_generation", "timestamp_extraction", "make_framework_content")


def read_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """prompt_set, name, template of every ``folder/set/name.md``."""
    raw = spark.read.text(f"{folder}/*/*.md", wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    piece = lambda k: F.regexp_extract("path", r"([^/]+)/([^/]+)\.md$", k)
    return raw.select(piece(1).alias("prompt_set"), piece(2).alias("name"), F.col("value").alias("template"))


def resolve(prompts: DataFrame, requested: DataFrame, default_set: str = DEFAULT_SET) -> DataFrame:
    """``requested`` (prompt_set, name) with ``template``: of the set, else of the default set, else empty."""
    usual = prompts.filter(F.col("prompt_set") == default_set).select("name", F.col("template").alias("_usual"))
    rows = requested.join(prompts, ["prompt_set", "name"], "left").join(usual, "name", "left")
    return rows.select("prompt_set", "name", F.coalesce("template", "_usual", F.lit("")).alias("template"))


def templates(prompts: DataFrame, prompt_set: str = DEFAULT_SET) -> dict[str, Column]:
    """The four templates as literals: four rows come to the driver, whatever the number of sets."""
    asked = prompts.sparkSession.createDataFrame([(prompt_set, n) for n in NAMES], "prompt_set string, name string")
    return {r["name"]: F.lit(r["template"]) for r in resolve(prompts, asked).collect()}
