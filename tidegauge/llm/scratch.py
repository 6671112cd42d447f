"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"


def folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only where it is unset (tests), a folder of our own.

    On a cluster the setting has to name a shared folder: a machine's own temporary folder
    serves local mode alone, so without the setting any other master is refused.
    """
    named = spark.conf.get(SETTING, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"set {SETTING} to a folder that all executors share")
    own = getattr(spark.sparkContext, "_tidegauge_scratch", None)
    if own is None:
        own = spark.sparkContext._tidegauge_scratch = "file://" + tempfile.mkdtemp(prefix="tidegauge-")
    return own


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    This cuts the lineage: later stages re-read the files when an executor is lost. The files stay
    until ``forget`` or the folder's owner removes them.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    vars(spark.sparkContext).setdefault("_tidegauge_written", []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> int:
    """Removes what ``written`` has left in this session, and says how many tables; no result that reads them works after that."""
    paths = vars(spark.sparkContext).pop("_tidegauge_written", [])
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return len(paths)


def text_bytes(df: DataFrame, text_col: str) -> int:
    """The measured bytes of a column of texts, and 16 for each row: what partition counts are chosen by."""
    return df.agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + 16)).first()[0] or 0


def parts_for(size: int, each: int, least: int = 16, most: int = 1 << 22) -> int:
    """How many parts of about ``each`` make up ``size``; an odd number, within limits."""
    return min(most, max(least, size // each)) | 1
