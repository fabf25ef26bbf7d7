"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words: all words are shared out by cyclic weights, no source
takes more than ``cap`` times its own words, and what a capped source leaves goes to the others
by weight.  A document first gets the whole copies that are certain (target // source size); the
words still missing are drawn by Pareto order sampling: with inclusion probability pi in
proportion to its size (at most 1) and a random number u that depends on the document alone, a
document ranks at u/(1-u) * (1-pi)/pi, and the lowest ranks are taken until the missing words are
met as nearly as one document allows.

Nothing is ordered as a whole: ranks are summed in 65,536 bins per source, and only the one bin
per source in which the target is met is ordered.  The per-document table carries no text and is
stored once in the shared checkpoint folder.

Defined results: null or empty texts have size 0 and are never taken; a null source is a source
of its own, in last place; sources with no words get target 0; a document without an id draws its
random number by its text; repeated rows count as documents of their own, and as their ranks are equal
the ones at a cut are interchangeable; an empty table gives an empty result; other input columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podspark.llm.common import WORD, broadcast_if_small, stored

WEIGHTS = (5, 2, 1)
CAP = 3
BINS = 1 << 16
#: Tables of one row per source are broadcast only up to this number.
BROADCAST_SOURCES = 200_000


def unit_hash(key: Column) -> Column:
    """A number in (0, 1) that depends on the key alone; the same in every run and engine."""
    return (F.conv(F.substring(F.md5(key.cast("string")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Target words per source, from one row per source (``source``, ``source_size``)."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    # The level rises until the sources that are full first stop: order by cap * size / weight.
    fill = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    levels = (
        sources.withColumn("weight", weight)
        .withColumn("full_at", F.col("source_size") * cap / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0)))
        .withColumn("level", F.col("left") / F.sum("weight").over(after))
    )
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(Window.partitionBy())["level"]
    return levels.withColumn("level", level).select(
        "source",
        "source_size",
        F.when(F.col("full_at") <= F.col("level"), F.col("source_size") * F.lit(float(cap)))
        .otherwise(F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight"))
        .alias("target"),
    )


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per document: key, source, size, source_size, target, copies, taken."""
    sizes = stored(
        docs.select(
            F.col(key).alias("doc_id"),
            F.col(source).alias("source"),
            F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
            unit_hash(F.coalesce(F.col(key).cast("string"), F.col(text))).alias("u"),
        )
    )
    goal = stored(
        targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
        .withColumn("whole", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)))
        .withColumn("missing", F.col("target") - F.col("whole") * F.col("source_size"))
    )

    def known(df: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
        """``df`` with what is known of its source; a table of sources is counted before it is broadcast."""
        named, _ = broadcast_if_small(other.withColumnRenamed("source", "_source"), BROADCAST_SOURCES)
        return df.join(named, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")

    # pi = min(1, rate * size): the largest sizes are certain as long as their rate would pass 1.
    by_size = Window.partitionBy("source").orderBy(F.col("size").desc())
    larger, not_larger = by_size.rowsBetween(Window.unboundedPreceding, -1), by_size.rowsBetween(0, Window.unboundedFollowing)
    words, squares = F.col("size") * F.col("n"), F.col("size") * F.col("size") * F.col("n")
    rates = (
        known(sizes.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")), goal)
        .withColumn("rate", (F.col("missing") - F.coalesce(F.sum(words).over(larger), F.lit(0))) / F.sum(squares).over(not_larger))
        .filter(F.col("rate") * F.col("size") <= 1)
        .groupBy("source")
        .agg(F.max(F.struct("size", "rate"))["rate"].alias("rate"))
    )
    pi = F.least(F.lit(1.0), F.coalesce(F.col("rate"), F.lit(1.0)) * F.col("size"))
    u = F.col("u")
    rank = F.when(pi > 0, u / (1 - u) * (1 - pi) / pi)
    goal = stored(known(goal, stored(rates), "left"))
    ranked = known(sizes, goal).withColumn("rank", rank).withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * BINS))

    # Only documents that can still be drawn are summed; the bin in which the target is met is then ordered.
    drawn = (F.col("size") > 0) & (F.col("missing") > 0) & F.col("rank").isNotNull()
    up_to = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        ranked.filter(drawn).groupBy("source", "bin", "missing").agg(F.sum("size").alias("words"))
        .withColumn("before", F.coalesce(F.sum("words").over(up_to), F.lit(0)))
        .filter((F.col("before") < F.col("missing")) & (F.col("before") + F.col("words") >= F.col("missing")))
        .select("source", F.col("bin").alias("last_bin"), F.col("before").alias("last_before"))
    )
    placed = known(ranked, stored(last), "left")
    in_order = Window.partitionBy("source", "bin").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at_cut = drawn & (F.col("bin") == F.col("last_bin"))
    start = F.col("last_before") + F.coalesce(F.sum("size").over(in_order), F.lit(0))
    # The document that passes the target is taken if that ends nearer to it.
    edge = placed.filter(at_cut).withColumn("extra", ((start < F.col("missing")) & (start + F.col("size") / 2 <= F.col("missing"))).cast("int"))
    rest = placed.filter(~F.coalesce(at_cut, F.lit(False))).withColumn(
        "extra", F.coalesce((drawn & ((F.col("bin") < F.col("last_bin")) | F.col("last_bin").isNull())).cast("int"), F.lit(0))
    )
    return edge.unionByName(rest).select(
        F.col("doc_id").alias(key),
        F.col("source"),
        "size",
        "source_size",
        "target",
        (F.col("whole") + F.col("extra")).cast("long").alias("copies"),
        ((F.col("whole") + F.col("extra")) * F.col("size")).cast("long").alias("taken"),
    )
