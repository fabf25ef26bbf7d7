"""Filtered, ranked and sorted search over insight documents, for one query and for a table of queries.

A hit holds every distinct term of the query in some searchable attribute.  It ranks by the first attribute
that holds a term, then by the number of occurrences, then by id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from podspark.sources.tables import broadcast_if_small, stored

ATTRIBUTES = ("title", "description", "framework_markdown")
FILTERS = ("podcast", "category", "video_id")
SORTABLE = ("start_time_sec", "title", "category")
DEFAULT_LIMIT, MOST = 20, 100
#: Distinct terms that are asked, and ids of documents that a query met, are broadcast only up to these numbers.
BROADCAST_TERMS, BROADCAST_IDS = 200_000, 1_000_000


def terms(c: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def filtered(documents: DataFrame, filters: dict[str, str | None]) -> DataFrame:
    """Equality on podcast, category and video_id; an empty value filters nothing."""
    for name, value in filters.items():
        if name not in FILTERS:
            raise ValueError(f"cannot filter by {name}")
        if value:
            documents = documents.filter(F.col(name) == value)
    return documents


def sort_columns(sort: str | None) -> list[Column]:
    out = []
    for part in filter(None, (p.strip() for p in (sort or "").split(","))):
        name, _, way = part.partition(":")
        if name not in SORTABLE or way not in ("asc", "desc"):
            raise ValueError(f"cannot sort by {part}")
        out.append(F.col(name).asc_nulls_last() if way == "asc" else F.col(name).desc_nulls_last())
    return out


def checked_limit(limit: int) -> int:
    if limit < 0:
        raise ValueError("limit must not be negative")
    return min(limit, MOST)


def matching(documents: DataFrame, q: str) -> DataFrame:
    """Hits with ``attribute`` (the first that holds a term) and ``occurrences``; no shuffle."""
    asked = F.array_distinct(terms(F.lit(q)))
    held = [terms(F.col(a)) for a in ATTRIBUTES]
    counts = [F.size(F.filter(h, lambda t: F.array_contains(asked, t))) for h in held]
    best = F.coalesce(*[F.when(n > 0, F.lit(k)) for k, n in enumerate(counts)], F.lit(0))
    every = F.size(F.array_except(asked, F.concat(*held))) == 0
    return documents.filter(every).withColumns({"attribute": best, "occurrences": sum(counts[1:], counts[0])})


def _observed(rows: DataFrame, kept: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
    """``kept(rows)`` written down, and the number of ``rows``, counted as they pass."""
    seen = Observation()
    out = stored(kept(rows.observe(seen, F.count(F.lit(1)).alias("n"))))
    return out, seen.get.get("n", 0)


def search(documents: DataFrame, q: str = "", filters: dict[str, str | None] | None = None, sort: str | None = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The hits in order, with ``total`` (hits before the limit) on each.

    The documents are read once: each task keeps its best ``limit`` hits and counts all, and no more than the best are written.
    """
    order = [*sort_columns(sort), F.col("attribute"), F.col("occurrences").desc(), F.col("id")]
    hits, most = matching(filtered(documents, filters or {}), q), checked_limit(limit)
    if not most:
        return hits.withColumn("total", F.lit(0).cast("bigint")).limit(0)
    best, total = _observed(hits, lambda rows: rows.orderBy(*order).limit(most))
    return best.withColumn("total", F.lit(total).cast("bigint")).orderBy(*order)


def batch_search(documents: DataFrame, queries: DataFrame, k: int = DEFAULT_LIMIT) -> DataFrame:
    """The k best hits of each query of a table (query_id, q): query_id, id, attribute, occurrences, place.

    Postings hold each asked term of a document once; a query meets a document by its rarest term, so frequent
    words are never joined on.  Only ids are moved for that; then the documents that any query met are read
    again, and the other terms are compared there.
    """
    every = F.concat(*[terms(F.col(a)) for a in ATTRIBUTES])
    asked = stored(queries.select("query_id", F.array_distinct(terms(F.col("q"))).alias("asked")).filter(F.size("asked") > 0))
    words, _ = broadcast_if_small(stored(asked.select(F.explode("asked").alias("term")).distinct()), BROADCAST_TERMS)
    postings = stored(documents.select("id", F.explode(F.array_distinct(every)).alias("term")).join(words, "term", "left_semi"))
    frequency = postings.groupBy("term").agg(F.count("*").alias("n"))
    rarest = asked.select("query_id", F.explode("asked").alias("term")).join(frequency, "term", "left").groupBy("query_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term"))["term"].alias("term"))
    met = stored(postings.join(rarest, "term").select("query_id", "id"))
    ids, _ = broadcast_if_small(stored(met.select("id").distinct()), BROADCAST_IDS)
    post = documents.select("id", *ATTRIBUTES).join(ids, "id", "left_semi").select("id", *[terms(F.col(a)).alias(f"t{j}") for j, a in enumerate(ATTRIBUTES)])
    known = met.join(asked, "query_id").join(post, "id")
    counts = [F.size(F.filter(F.col(f"t{j}"), lambda t: F.array_contains(F.col("asked"), t))) for j in range(len(ATTRIBUTES))]
    whole = F.concat(*[F.col(f"t{j}") for j in range(len(ATTRIBUTES))])
    hits = known.filter(F.size(F.array_except("asked", whole)) == 0).select(
        "query_id", "id", F.coalesce(*[F.when(n > 0, F.lit(j)) for j, n in enumerate(counts)]).alias("attribute"), sum(counts[1:], counts[0]).alias("occurrences")
    )
    best = Window.partitionBy("query_id").orderBy("attribute", F.col("occurrences").desc(), "id")
    return hits.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)
