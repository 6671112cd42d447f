"""Ordered computations over a whole table without a single-task window.

A table is range-partitioned by its order; windows run within the partitions, and what has to
cross a border (a running sum, the last known value) is a table of one row for each partition,
joined back by broadcast: its size is the number of partitions. Windows only ever look back, from the
beginning of the partition to the current row, which Spark extends row by row; what lies ahead
is looked at in descending order.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PID = "_pid"


def settled(df: DataFrame) -> DataFrame:
    """A checkpoint in the session's ``spark.checkpoint.dir`` (a temporary folder in local tests).

    Spark removes it with the table it belongs to, where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set (as in ``session.build``).
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidegauge-"))
    return df.checkpoint()


def ranged(df: DataFrame, *order: str, partitions: int | None = None) -> DataFrame:
    """``df`` range-partitioned and fixed, with the partition's number in ``_pid``; rows of equal order stay together.

    The number of partitions is given, by default ``spark.sql.shuffle.partitions``: adaptive
    execution would merge them by their bytes, and a window's work isn't told by bytes.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settled(df.repartitionByRange(n, *[F.col(c) for c in order]).withColumn(PID, F.spark_partition_id()))


def running(r: DataFrame, order: list[str], weight: Column, out: str) -> DataFrame:
    """Adds the running sum of ``weight`` up to each row (rows in ``order``, which has to be total)."""
    r = r.withColumn("_w", weight)
    offsets = r.groupBy(PID).agg(F.sum("_w").alias("_s"))
    offsets = offsets.select(PID, F.coalesce(F.sum("_s").over(W.orderBy(PID).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    own = F.sum("_w").over(W.partitionBy(PID).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return r.withColumn("_r", own).join(F.broadcast(offsets), PID).withColumn(out, F.col("_r") + F.col("_off")).drop("_w", "_r", "_off")


def numbered(df: DataFrame, *order: str, out: str = "_rn", partitions: int | None = None) -> DataFrame:
    """Row numbers from 1 in a total order."""
    return running(ranged(df, *order, partitions=partitions), list(order), F.lit(1).cast("long"), out)


def nearest_known(r: DataFrame, order: list[str], value: Column, out: str, ahead: bool = False, strictly: bool = False) -> DataFrame:
    """Adds the last value that isn't NULL up to each row, or with ``ahead`` the first from it on.

    ``value`` should be a struct where NULL fields are to count as known.
    """
    r = r.withColumn("_v", value)
    way = [F.desc(c) if ahead else F.asc(c) for c in order]
    upto = W.unboundedPreceding, -1 if strictly else 0
    own = F.last("_v", ignorenulls=True).over(W.partitionBy(PID).orderBy(*way).rowsBetween(*upto))
    best = F.min_by if ahead else F.max_by
    known = r.where(F.col("_v").isNotNull()).groupBy(PID).agg(best("_v", F.struct(*order)).alias("_k"))
    pids = r.select(PID).distinct().join(known, PID, "left")
    beyond = W.orderBy(F.desc(PID) if ahead else F.asc(PID)).rowsBetween(W.unboundedPreceding, -1)
    over = pids.select(PID, F.last("_k", ignorenulls=True).over(beyond).alias("_c"))
    return r.withColumn("_n", own).join(F.broadcast(over), PID).withColumn(out, F.coalesce("_n", "_c")).drop("_v", "_n", "_c")
