"""Model answers that are kept: what was asked once is not asked again.

An answer is stored under the hash of its kind and prompt, so equal prompts are asked once, whichever
video they come from.  Requests without an answer are asked lot by lot, a lot being some of the buckets of
the answers' table; each lot is one commit, so a run that breaks off has to ask only the rest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from podspark.operators import insights as I
from podspark.sources.store import Change, Store
from podspark.sources.tables import bucket_of, stored

TABLE = {"answers": ("request string, raw string", "request")}
BUCKETS, LOTS = 64, 8


def open_answers(spark: SparkSession, root: str, buckets: int = BUCKETS) -> Store:
    return Store(spark, root, TABLE, buckets)


def request_key() -> Column:
    """One prompt of one kind."""
    return F.sha2(F.concat_ws("|", "kind", "prompt"), 256)


def ask_kept(store: Store, requests: DataFrame, answer: Callable[[str, str], str], lots: int = LOTS) -> DataFrame:
    """As ``insights.ask``: request_id and raw of every request, from the store where it has an answer.

    Prompts are rendered once to be hashed and again only for those that are asked; hashes alone are shuffled.
    """
    keyed = requests.withColumn("request", request_key())
    wanted = stored(keyed.select("request_id", "request"))
    new = wanted.select("request").distinct().join(store.read("answers").select("request"), "request", "left_anti")
    new = stored(new.withColumn("bucket", bucket_of(F.col("request"), store.buckets)))
    # Of several requests with one prompt, one is asked.
    asked = wanted.join(new, "request").groupBy("request", "bucket").agg(F.min("request_id").alias("request_id"))
    asked = stored(asked)
    numbers = sorted(r[0] for r in asked.select("bucket").distinct().collect())
    for lot in range(lots):
        mine = [n for n in numbers if n % lots == lot]
        if mine:
            was = store.snapshot()
            lot_ids = asked.filter(F.col("bucket").isin(mine)).select("request_id", "request")
            found = stored(I.ask(requests.join(lot_ids.select("request_id"), "request_id", "left_semi"), answer))
            rows = store.read("answers", was, mine).unionByName(lot_ids.join(found, "request_id").select("request", "raw"))
            store.commit(was, {"answers": Change(rows, mine)})
    return wanted.join(store.read("answers"), "request").select("request_id", "raw")
