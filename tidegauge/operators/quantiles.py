"""Exact quantiles of groups, without a task that holds a group's values and without shuffling all of them."""

from __future__ import annotations

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ranged import ranged, running

#: Accuracy of the sketches that tell where to look, and how many of their errors around a quantile that is.
ACCURACY, ERRORS = 2000, 2.0


def quantiles(df: DataFrame, groups: list[str], y: str, probs: list[float]) -> DataFrame:
    """(groups, n, mean, q0, q1, ...) of the values of ``y`` that aren't NULL, interpolated linearly.

    A first pass sketches each group (a partial aggregate of bounded size), which brackets each quantile; a
    second one counts the values within the brackets one by one, and all between two brackets as one.
    What is shuffled, put in order by ranges of (group, value) and numbered by running sums is a few
    thousandths of the rows, or fewer where values repeat. Should a quantile be outside its bracket, all
    distinct values are counted instead. The groups themselves have to be few (bins, folds,
    columns): a row for each comes to the driver and is broadcast.
    """
    spark = df.sparkSession
    known = df.where(F.col(y).isNotNull()).select(*groups, F.col(y).alias("y"))
    ends = [min(1.0, max(0.0, p + s * ERRORS / ACCURACY)) for p in probs for s in (-1, 1)]
    sketch = F.percentile_approx("y", F.array(*[F.lit(float(e)) for e in ends]), F.lit(ACCURACY)).alias("ends")
    sketched = spark.createDataFrame(known.groupBy(*groups).agg(F.avg("y").alias("mean"), sketch).toArrow())
    lo, hi = ([F.col("ends")[2 * k + s] for k in range(len(probs))] for s in (0, 1))
    inside = F.lit(False)
    for a, b in zip(lo, hi, strict=True):
        inside = inside | ((F.col("y") >= a) & (F.col("y") <= b))
    under = [F.when(F.col("y") > b, b) for b in hi]
    gap = F.coalesce(F.greatest(*under) if len(under) > 1 else under[0], F.lit(float("-inf")))  # the bracket's end that a value beyond it follows
    placed = known.join(F.broadcast(sketched.select(*groups, "ends")), groups)
    counts = placed.select(*groups, F.when(inside, F.col("y")).otherwise(gap).alias("y"), F.when(inside, 0).otherwise(1).alias("beyond")).groupBy(*groups, "y", "beyond").agg(F.count("*").alias("c"))
    picked = _picked(counts, groups, probs).toArrow()
    if pc.any(picked.column("missed")).as_py():
        counts = known.groupBy(*groups, "y").agg(F.count("*").alias("c")).withColumn("beyond", F.lit(0))
        picked = _picked(counts, groups, probs).toArrow()
    out = spark.createDataFrame(picked).join(F.broadcast(sketched.select(*groups, "mean")), groups)
    return out.select(*groups, "n", "mean", *[f"q{k}" for k in range(len(probs))])


def _picked(counts: DataFrame, groups: list[str], probs: list[float]) -> DataFrame:
    """(groups, n, missed, q0, q1, ...) from the counts of values, and of what lies ``beyond`` values, in order."""
    order = [*groups, "y", "beyond"]
    r = running(ranged(counts, *order), order, F.col("c"), "upto")
    sizes = r.groupBy(*groups).agg(F.min(F.col("upto") - F.col("c")).alias("base"), F.sum("c").alias("n"))
    of = r.join(F.broadcast(sizes), groups)
    first, last = F.col("upto") - F.col("c") - F.col("base"), F.col("upto") - F.col("base")  # ranks from 0: [first, last)
    at = lambda p: (F.col("n") - 1) * F.lit(float(p))
    holds = lambda rank: (first <= rank) & (rank < last)
    value = lambda rank: F.max(F.when(holds(rank), F.col("y").cast("double")))
    missed: Column = F.lit(False)
    for p in probs:
        missed = missed | holds(F.floor(at(p))) | holds(F.ceil(at(p)))
    ends = [e for k, p in enumerate(probs) for e in (value(F.floor(at(p))).alias(f"lo{k}"), value(F.ceil(at(p))).alias(f"hi{k}"))]
    got = of.groupBy(*groups, "n").agg(F.max(missed & (F.col("beyond") == 1)).alias("missed"), *ends)
    between = lambda k, p: F.col(f"lo{k}") + (F.col(f"hi{k}") - F.col(f"lo{k}")) * (at(p) - F.floor(at(p)))
    return got.select(*groups, "n", "missed", *[between(k, p).alias(f"q{k}") for k, p in enumerate(probs)])
