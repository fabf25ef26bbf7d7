"""Incremental sync with the fetch: listings, details and responses land apart and are taken up together.

Three landing folders make one stream, so a micro-batch has one number for all of them and becomes one
commit of all tables.  A batch that breaks off leaves the tables as they were and is sent again; one that
was committed before the stream noted it is recognised by its number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from podspark import schemas
from podspark.operators import insights as I
from podspark.plans import stored as jobs
from podspark.sources import tables as S
from podspark.sources.store import Store

#: Folder below the landing place, and the schema of its JSON lines.
LANDING = {"listings": schemas.LISTING, "details": schemas.DETAILS, "responses": "video_id string, response string"}
#: The name under which the ledger keeps this stream's last batch.
STREAM = "sync"


def landed(spark: SparkSession, landing: str) -> DataFrame:
    """One stream of rows with ``kind`` and a struct column per kind."""
    parts = []
    for name, schema in LANDING.items():
        rows = spark.readStream.schema(schema).json(f"{landing}/{name}")
        parts.append(rows.select(F.lit(name).alias("kind"), F.struct(*rows.columns).alias(name)))
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)


def take_up(store: Store, rows: DataFrame, channels: DataFrame, templates: dict[str, Column], answer: Callable[[str, str], str], now: Column, number: int, ask: Callable = I.ask) -> None:
    """One micro-batch into the store."""
    if store.done(store.snapshot(), (STREAM, number)):
        return
    # Written once: the files that landed are read one time only.
    rows = S.stored(rows)
    kinds = [rows.filter(F.col("kind") == name).select(f"{name}.*") for name in LANDING]
    jobs.sync_batch(store, *kinds, channels, templates, answer, now, (STREAM, number), ask)


def sync(spark: SparkSession, landing: str, store: Store, checkpoint: str, channels: DataFrame, templates: dict[str, Column], answer: Callable[[str, str], str], now: Column | None = None, ask: Callable = I.ask) -> StreamingQuery:
    """Takes up everything that has landed since the last run, then stops."""
    at = F.current_timestamp() if now is None else now
    return (
        landed(spark, landing).writeStream.foreachBatch(lambda rows, number: take_up(store, rows, channels, templates, answer, at, number, ask))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
