"""Nearest as-of join and the resolution of a time series.

The distinct keys of both sides meet in one range-partitioned table; within a partition the last
key behind and the first key ahead are found by one window each, across borders by a table of
one row for each partition. The matches are then joined back by key, so repeated keys (a third
of all rows may have one) never share a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ranged import nearest_known, ranged
from ..plans.schema import col, is_time, kind, micros, own, require, row_of


def gaps(df: DataFrame, key: str) -> DataFrame:
    """(k, gap): each key and its distance from the row before in order, microseconds for times; repeated keys have gap 0."""
    keys = df.where(col(key).isNotNull()).groupBy(micros(df, key).alias("k")).agg(F.count("*").alias("n"))
    near = nearest_known(ranged(keys, "k"), ["k"], F.struct("k"), "prev", strictly=True)
    rows = F.array(F.struct((F.col("k") - F.col("prev.k")).alias("gap"), F.lit(1).cast("long").alias("n")), F.struct((F.col("k") - F.col("k")).alias("gap"), (F.col("n") - 1).alias("n")))
    return near.select("k", F.inline(rows)).where("gap IS NOT NULL AND n > 0")


def resolution(df: DataFrame, key: str) -> DataFrame:
    """One row, ``resolution``: the commonest gap, the least of equals; NULL without gaps."""
    counts = gaps(df, key).groupBy("gap").agg(F.sum("n").alias("n"))
    return counts.agg(F.max_by("gap", F.struct("n", -F.col("gap"))).alias("resolution"))


def commonest_gap(df: DataFrame, key: str) -> int | None:
    """The commonest gap, of equals the one that comes first in key order."""
    counts = gaps(df, key).groupBy("gap").agg(F.sum("n").alias("n"), F.min("k").alias("first"))
    return counts.agg(F.max_by("gap", F.struct("n", -F.col("first"))).alias("gap")).first()["gap"]


def matched_keys(targets: DataFrame, right: DataFrame, tolerance: int | None) -> DataFrame:
    """(k, payload) of each distinct target k: of (k, payload) rows the nearest, backward on ties.

    Of rows with equal keys one ahead gives its first, one behind or equal its last.

    The payload is a struct, so a match with NULL values is a match.
    """
    both = targets.select("k", F.lit(1).alias("target"), F.lit(None).cast(right.schema["payload"].dataType).alias("payload"))
    both = both.unionByName(right.select("k", F.lit(0).alias("target"), "payload"))
    # a window's order is total: one row for each key
    both = both.groupBy("k").agg(F.max("target").alias("target"), F.max_by("payload", F.when(F.col("payload").isNotNull(), 1)).alias("payload"))
    known = F.when(F.col("payload").isNotNull(), F.struct("k", "payload"))
    r = ranged(both, "k")
    r = nearest_known(r, ["k"], known, "back")
    r = nearest_known(r, ["k"], known, "fore", ahead=True)
    behind, ahead = F.col("k") - F.col("back.k"), F.col("fore.k") - F.col("k")
    one = lambda side, end: F.when(F.col(side).isNotNull(), F.struct(F.col(f"{side}.k").alias("k"), F.col(f"{side}.payload.{end}").alias("payload")))
    pick = F.when(ahead.isNull() | (behind <= ahead), one("back", "last")).otherwise(one("fore", "first"))
    got = r.where("target = 1").withColumn("pick", pick)
    near = F.abs(F.col("k") - F.col("pick.k"))
    within = F.lit(True) if tolerance is None else near <= tolerance
    return got.select("k", F.when(within, F.col("pick.payload")).alias("payload"), F.when(within, F.col("pick.k")).alias("matched"))


def ends_of_key(right: DataFrame, key: Column, payload: list[Column], seq: list[Column]) -> DataFrame:
    """(k, payload): of rows with equal keys the last and the first by ``seq``, as ``payload.last`` and ``payload.first``."""
    ends = F.struct(F.max_by(F.struct(*payload), F.struct(*seq)).alias("last"), F.min_by(F.struct(*payload), F.struct(*seq)).alias("first"))
    return right.where(key.isNotNull()).groupBy(key.alias("k")).agg(ends.alias("payload"))


def nearest_asof(left: DataFrame, right: DataFrame, key: str, tolerance: int | None = None, seq: list[str] | None = None, suffix: str = "_y") -> DataFrame:
    """``left`` with the columns of the ``right`` row whose key is nearest, NULL beyond ``tolerance`` (inclusive).

    Ties in distance go to the earlier key; of rows with equal keys it is the last by ``seq`` (by
    default all other columns) if they are not ahead of the left key, else the first. Rows of ``left`` are kept, also those without a key. Names that
    both sides have get ``suffix``. Tolerance is in microseconds for times.
    """
    require(left, [key])
    require(right, [key, *(seq or [])])
    if is_time(kind(left, key)) != is_time(kind(right, key)):
        raise TypeError("keys must both be times or both be numbers")
    names = [c for c in right.columns if c != key]
    payload = [col(c).alias(f"p{k}") for k, c in enumerate(names)] or [F.lit(1).alias("p")]
    rows = ends_of_key(right, micros(right, key), payload, [col(c) for c in seq or names] or [F.lit(1)])
    keyed = left.select(row_of(left), micros(left, key).alias("k"))
    match = matched_keys(keyed.where("k IS NOT NULL").select("k").distinct(), rows, tolerance)
    out = keyed.join(match.select(F.col("k").alias("at"), "payload"), F.col("k") == F.col("at"), "left")
    taken = set(left.columns)
    return out.select(*[own(c) for c in left.columns], *[F.col(f"payload.p{k}").alias(c + suffix if c in taken else c) for k, c in enumerate(names)])
