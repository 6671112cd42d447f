"""Feature preparation (F1): logarithms, cyclic encodings, rows with undefined values."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.schema import as_list, col, free, is_number, kind, require

HOURS, DEGREES = 24.0, 360.0


def known(df: DataFrame, name: str) -> Column:
    """Whether a value is there: not NULL, and for numbers neither NaN nor infinite."""
    c = col(name)
    if kind(df, name).typeName() in ("double", "float"):
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return c.isNotNull()


def present(df: DataFrame, name: str) -> Column:
    """Not NULL and not NaN (what a missing value is before anything is computed)."""
    c = col(name)
    return c.isNotNull() & ~F.isnan(c) if kind(df, name).typeName() in ("double", "float") else c.isNotNull()


def drop_undefined(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Drops rows with NULL, NaN or an infinity in any of the columns."""
    for c in names or df.columns:
        df = df.where(known(df, c))
    return df


def drop_missing(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Drops rows with NULL or NaN in any of the columns."""
    for c in names or df.columns:
        df = df.where(present(df, c))
    return df


def log10_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Appends ``log10_<c>`` and drops ``<c>``; a column that isn't there or isn't a number is warned about."""
    for c in names:
        if c not in df.columns or not is_number(kind(df, c)):
            warnings.warn(f"{c!r} is no numeric column of this table: it gets no logarithm", stacklevel=2)
            continue
        df = df.withColumn(f"log10_{c}", F.log10(col(c).cast("double"))).drop(c)
    return df


def cyclic_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Appends ``cos_<c>`` and ``sin_<c>`` and drops ``<c>``; the period is 360 where the largest value is over 24, else 24.

    All periods come from one aggregate of one row, which is broadcast.
    """
    good = []
    for c in names:
        if c in df.columns and is_number(kind(df, c)):
            good.append(c)
        else:
            warnings.warn(f"{c!r} is no numeric column of this table: it gets no cyclic encoding", stacklevel=2)
    if not good:
        return df
    largest = free(df.columns, *[f"m{k}" for k in range(len(good))])
    limits = df.agg(*[F.max(col(c).cast("double")).alias(m) for m, c in zip(largest, good, strict=True)])
    df = df.join(F.broadcast(limits))
    for m, c in zip(largest, good, strict=True):
        angle = col(c) * 2 * F.pi() / F.when(F.col(m) > HOURS, F.lit(DEGREES)).otherwise(F.lit(HOURS))
        df = df.withColumn(f"cos_{c}", F.cos(angle)).withColumn(f"sin_{c}", F.sin(angle)).drop(c)
    return df.drop(*largest)


def prepared(
    dat: DataFrame, feat_col: list[str], y_col: list[str], log_col: list[str] | None = None, lt_col: list[str] | None = None,
    t_col: list[str] | None = None, key: list[str] | None = None,
) -> DataFrame:
    """Features and targets in one table: missing rows go, then logarithms, encodings, undefined rows.

    ``key`` columns pass through untouched, so that parts of the table can be joined again.
    """
    as_list(feat_col, "feat_col")
    as_list(y_col, "y_col")
    if set(log_col or []) & set(y_col) or set(lt_col or []) & set(y_col):
        raise ValueError("a target column can't be logged or encoded: it would be gone")
    names = list(dict.fromkeys([*(key or []), *feat_col, *y_col, *(t_col or []), *(lt_col or [])]))
    require(dat, names)
    df = drop_missing(dat.select(*[col(c) for c in names]))
    df = log10_columns(df, log_col or [])
    df = cyclic_columns(df, lt_col or [])
    return drop_undefined(df)


def create(
    dat: DataFrame, feat_col: list[str], y_col: list[str], log_col: list[str] | None = None, lt_col: list[str] | None = None,
    t_col: list[str] | None = None, key: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(features, targets): two projections of ``prepared``; with ``key`` both have it (F1)."""
    df = prepared(dat, feat_col, y_col, log_col, lt_col, t_col, key)
    return df.drop(*y_col), df.select(*[col(c) for c in [*(key or []), *y_col]])


def residual(df: DataFrame, y_true: str, y_pred: str, name: str = "resid") -> DataFrame:
    """Appends observed minus predicted."""
    return df.withColumn(name, col(y_true) - col(y_pred))


def time_range(df: DataFrame, t_col: str, start: str | None = None, end: str | None = None, after: bool = False) -> DataFrame:
    """Rows from ``start`` (``after``: beyond it) to ``end``, both optional; reaches the scan as a pushed filter."""
    t = col(t_col)
    if start is not None:
        s = F.lit(start).cast(kind(df, t_col))
        df = df.where(t > s if after else t >= s)
    return df.where(t <= F.lit(end).cast(kind(df, t_col))) if end is not None else df
