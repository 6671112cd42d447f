"""Names and types, checked from the schema alone (no job)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(name: str) -> Column:
    """A column by its exact name, whatever characters are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def require(df: DataFrame, names: Iterable[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"no such columns: {missing}")


def free(taken: Iterable[str], *stems: str) -> list[str]:
    """A name for each stem that isn't taken (Spark's names have no case), nor by another stem."""
    used, out = {n.lower() for n in taken}, []
    for stem in stems:
        name = stem
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


#: A user's whole row as one column: beside it, helper columns of any name can't clash with the row's.
ROW = "row"


def row_of(df: DataFrame) -> Column:
    return F.struct(*[col(c) for c in df.columns]).alias(ROW)


def own(name: str) -> Column:
    """A column of the user's row in a table that has it as ``ROW``."""
    return F.col(ROW).getField(name).alias(name)


def as_list(x: object, what: str) -> list:
    if not isinstance(x, list):
        raise TypeError(f"{what} must be a list")
    return x


def kind(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_number(t: T.DataType) -> bool:
    return isinstance(t, (T.NumericType, T.BooleanType))


def is_integer(t: T.DataType) -> bool:
    return isinstance(t, T.IntegralType)


def is_time(t: T.DataType) -> bool:
    return isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType))


def numeric_columns(df: DataFrame, names: Iterable[str]) -> list[str]:
    """Those of ``names`` that are numbers or booleans."""
    return [n for n in names if is_number(kind(df, n))]


def value(df: DataFrame, name: str) -> Column:
    """A numeric column as double, with NaN and infinities as NULL."""
    if not is_number(kind(df, name)):
        raise ValueError(f"column {name!r} is not numeric")
    return finite(col(name).cast("double"))


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def micros(df: DataFrame, name: str) -> Column:
    """A time column as microseconds since the epoch; a number as it is."""
    return F.unix_micros(col(name).cast("timestamp")) if is_time(kind(df, name)) else col(name)


UNITS = {"us": 1, "ms": 1_000, "s": 1_000_000, "sec": 1_000_000, "min": 60_000_000, "m": 60_000_000, "h": 3_600_000_000, "hour": 3_600_000_000, "D": 86_400_000_000, "day": 86_400_000_000, "W": 604_800_000_000}


def duration(x: object, unit: str | None = None) -> int:
    """Microseconds of ``'90min'``, of a timedelta, or of a number of ``unit``."""
    if hasattr(x, "total_seconds"):
        return round(x.total_seconds() * 1_000_000)
    if isinstance(x, str):
        digits = x.rstrip("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ ")
        x, unit = float(digits or 1), x[len(digits) :].strip() or unit
    if unit not in UNITS:
        raise ValueError(f"unknown unit of time: {unit!r}")
    return round(x * UNITS[unit])
