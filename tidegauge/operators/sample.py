"""Deterministic sampling by hash rank (R1-R4): the same rows on every run, cluster and engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.schema import col, is_time, kind, micros


def hash_key(df: DataFrame, key: list[str]) -> Column:
    """The key columns as text, spelled alike everywhere: times in microseconds, numbers in hundredths."""
    parts = []
    for c in key:
        t = kind(df, c).typeName()
        x = micros(df, c) if is_time(kind(df, c)) else F.round(col(c) * 100).cast("long") if t in ("double", "float") else col(c)
        parts.append(F.coalesce(x.cast("string"), F.lit("")))
    return F.concat_ws(":", *parts)


def hash_fraction(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from a key and a seed: 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", key, F.lit(str(seed))).cast("binary")), 1, 8), 16, 10).cast("double") / float(2**32)


def split(df: DataFrame, key: list[str], test_size: float = 0.3, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(train, test): each row falls by its key's hash; no shuffle, no order needed."""
    marked = hash_fraction(hash_key(df, key), seed) < test_size
    return df.where(~marked), df.where(marked)


def subsample(df: DataFrame, key: list[str], fraction: float, seed: int = 17) -> DataFrame:
    return df.where(hash_fraction(hash_key(df, key), seed) < fraction)


def fold_of(df: DataFrame, key: list[str], n: int = 3, seed: int = 17) -> Column:
    """A row's fold for cross-validation."""
    return F.floor(hash_fraction(hash_key(df, key), seed) * n).cast("int")


def folds(df: DataFrame, key: list[str], n: int = 3, seed: int = 17, name: str = "fold") -> DataFrame:
    """Adds a fold number for cross-validation."""
    return df.withColumn(name, fold_of(df, key, n, seed))
