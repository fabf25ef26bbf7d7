"""Insights out of model responses: blocks, category headers, bullets.

Blocks are separated by lines of dashes.  In a block a line that ends in a colon is a header, and the
starred lines below belong to it.  A block with "(none)" in it says nothing.  If no block up to one
without a category has given anything, that block's first line serves as its category.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podspark.functions import text as T

_QUOTE = rf'(?U)^"([^"]+)"{T.BLANK}*[–—-]{T.BLANK}*(.+)$'


def bullet(line: Column) -> Column:
    """Struct (title, description) of a starred, stripped line."""
    body = T.strip(F.substring(line, 2, 1 << 30))
    parts = F.split(body, ": ", 2)
    return (
        F.when(body.rlike(_QUOTE), F.struct(T.strip(F.regexp_extract(body, _QUOTE, 2)).alias("title"), T.strip(F.regexp_extract(body, _QUOTE, 1)).alias("description")))
        .when(body.contains(": "), F.struct(T.strip(F.get(parts, F.lit(0))).alias("title"), T.strip(F.get(parts, F.lit(1))).alias("description")))
        .otherwise(F.struct(body.alias("title"), F.lit("").alias("description")))
    )


def _header(line: Column) -> Column:
    return T.strip(F.regexp_replace(line, ":+$", ""))


def _block(lines: Column) -> Column:
    """What a block of stripped lines says: ``normal`` bullets under headers, ``later`` bullets after the first line, ``head`` and ``category``."""
    numbered = F.transform(lines, lambda line, i: F.struct(i.alias("i"), line.alias("line")))
    headers = F.transform(F.filter(numbered, lambda n: ~n["line"].startswith("*") & n["line"].endswith(":")), lambda n: F.struct(n["i"].alias("i"), _header(n["line"]).alias("category")))
    starred = F.filter(numbered, lambda n: n["line"].startswith("*"))

    def with_headers(h: Column) -> Column:
        # The last header above a line; headers are few.
        under = lambda n: F.coalesce(F.get(F.filter(h, lambda x: x["i"] < n["i"]), F.size(F.filter(h, lambda x: x["i"] < n["i"])) - 1)["category"], F.lit(""))
        normal = F.filter(F.transform(starred, lambda n: F.struct(under(n).alias("category"), n["line"].alias("line"))), lambda b: b["category"] != "")
        return F.struct(
            normal.alias("normal"),
            F.transform(F.filter(starred, lambda n: n["i"] > 0), lambda n: n["line"]).alias("later"),
            F.get(lines, F.lit(0)).alias("head"),
            F.coalesce(F.get(h, F.size(h) - 1)["category"], F.lit("")).alias("category"),
        )

    return T.let(headers, with_headers)


def _said(blocks: Column) -> Column:
    """Bullets (category, line) of all blocks, in order."""
    headless = lambda b: (F.size(b["normal"]) == 0) & (b["category"] == "") & ~b["head"].startswith("*") & (F.size(b["later"]) > 0)
    # The first line serves as the category of the first such block, if nothing was said up to it.
    first = lambda rule: F.array_min(F.filter(F.transform(blocks, lambda b, i: F.when(rule(b), i)), lambda i: i.isNotNull()))
    normal, headless_at = first(lambda b: F.size(b["normal"]) > 0), first(headless)
    legacy = F.when(normal.isNull() | (headless_at < normal), headless_at)
    unheaded = lambda b: F.transform(b["later"], lambda line: F.struct(_header(b["head"]).alias("category"), line.alias("line")))
    return T.let(F.struct(legacy.alias("at")), lambda v: F.flatten(F.transform(blocks, lambda b, i: F.when(i == v["at"], unheaded(b)).otherwise(b["normal"]))))


def parse_insights(responses: DataFrame, keep: list[str], raw: str = "raw") -> DataFrame:
    """``keep`` (which names a response), ``pos`` (order in the response), category, title, description.

    A response is parsed inside its row, over the arrays of its blocks and lines: nothing is shuffled.
    """
    body = F.regexp_replace(F.coalesce(F.col(raw), F.lit("")), rf"(?U)^{T.BLANK}*---+{T.BLANK}*\n?", "")
    body = F.regexp_replace(body, rf"(?U)\n?---+{T.BLANK}*\z", "")
    blocks = F.filter(F.transform(F.split(body, r"\n---+\n", -1), T.strip), lambda b: (b != "") & ~F.lower(b).contains("(none)"))
    blocks = F.transform(blocks, lambda b: T.let(F.transform(F.split(b, T.LINE_END, -1), T.strip), _block))
    found = responses.select(*keep, F.posexplode(T.let(blocks, _said)).alias("pos", "_s"))
    return found.withColumn("_b", bullet(F.col("_s.line"))).select(*keep, "pos", F.col("_s.category").alias("category"), F.col("_b.title").alias("title"), F.col("_b.description").alias("description"))
