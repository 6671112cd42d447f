"""Small reshaping steps of result tables, and joins on a row key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.schema import col, free, require

#: What a table may have as columns.
MOST_LABELS = 10_000


def scaled(df: DataFrame, factors: dict[str, float]) -> DataFrame:
    """Columns times constants, as doubles."""
    require(df, factors)
    return df.withColumns({c: col(c) * F.lit(float(k)) for c, k in factors.items()})


def joined_on(left: DataFrame, right: DataFrame, key: list[str], how: str = "left") -> DataFrame:
    """Tables side by side on a row key; names that both have get ``_y`` on the right."""
    require(left, key)
    require(right, key)
    taken = set(left.columns)
    keys = free([*left.columns, *right.columns, *[c + "_y" for c in right.columns]], *[f"k{i}" for i in range(len(key))])
    own = right.select(*[col(c).alias(k) for k, c in zip(keys, key, strict=True)], *[col(c).alias(c + "_y" if c in taken else c) for c in right.columns if c not in key])
    condition = None
    for k, c in zip(keys, key, strict=True):
        one = left[f"`{c}`"] == own[k]
        condition = one if condition is None else condition & one
    return left.join(own, condition, how).drop(*keys)


def transposed(df: DataFrame, label: str, names: list[str], out: str = "name") -> DataFrame:
    """Rows become columns: one row for each of ``names``, one column for each of the table's labels.

    For result tables: the labels are the new column names, in order, at most ``MOST_LABELS``.
    """
    require(df, [label, *names])
    long = df.select(col(label).alias("_label"), F.explode(F.array(*[F.struct(F.lit(c).alias("name"), col(c).cast("double").alias("value")) for c in names])).alias("e"))
    labels = sorted(r[0] for r in df.select(col(label)).distinct().where(col(label).isNotNull()).limit(MOST_LABELS + 1).collect())
    if len(labels) > MOST_LABELS:
        raise ValueError(f"{label!r} has more than {MOST_LABELS} labels, too many for columns")
    return long.groupBy(F.col("e.name").alias(out)).pivot("_label", labels).agg(F.max("e.value"))


def stacked(parts: dict[str, DataFrame], label: str = "part") -> DataFrame:
    """Tables one below the other, each under its name; columns that one lacks are NULL there."""
    result = None
    for name, df in parts.items():
        own = df.withColumn(label, F.lit(name))
        result = own if result is None else result.unionByName(own, allowMissingColumns=True)
    return result


def limits(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, least, largest) of numeric columns, from one aggregate."""
    require(df, names)
    one = df.agg(*[f(col(c).cast("double")).alias(f"{w}{k}") for k, c in enumerate(names) for f, w in ((F.min, "lo"), (F.max, "hi"))])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"lo{k}").alias("least"), F.col(f"hi{k}").alias("largest")) for k, c in enumerate(names)])))


def to_heatmap(matrix: DataFrame, label: str = "feature", drop: list[str] | None = None, absolute: bool = True) -> dict[str, list]:
    """A result matrix (a row for each label) as plotting takes it: rows, columns and values, without the labels in ``drop``."""
    names = [c for c in matrix.columns if c != label]
    rows = [r for r in matrix.collect() if r[label] not in (drop or [])]
    number = lambda v: None if v is None else abs(v) if absolute else v
    return {"rows": [r[label] for r in rows], "columns": names, "values": [[number(r[c]) for c in names] for r in rows]}
