"""Lagged features, gap filling and lagged correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ranged import nearest_known, numbered
from ..plans.schema import col, duration, kind, micros, own, require, row_of, value
from .asof import ends_of_key, matched_keys, resolution
from .corr import pearson
from .prep import drop_missing


def _periods(periods: int | list[int] | None) -> list[int]:
    if periods is None:
        return [5]
    if isinstance(periods, bool) or isinstance(periods, str):
        raise TypeError("periods must be an integer or a list of integers")
    return [periods] if isinstance(periods, int) else list(periods)


def shift_name(name: str, period: int, unit: str) -> str:
    return f"{name} {period} {unit}"


def default_tolerance(df: DataFrame, t_col: str) -> int:
    """Half the commonest gap and a second, in microseconds."""
    res = resolution(df, t_col).first()["resolution"]
    return int((res or 0) / 2 + 1_000_000)


def _shifted(df: DataFrame, t_col: str, periods: list[int], unit: str, tolerance: object, names: list[str], seq: list[str] | None) -> DataFrame:
    """(t, lag, payload): for each time and period the row nearest to the time less the period, in one as-of join."""
    tol = default_tolerance(df, t_col) if tolerance is None else duration(tolerance, "s") if not isinstance(tolerance, int) else tolerance
    rows = ends_of_key(df, micros(df, t_col), [col(c).alias(f"p{k}") for k, c in enumerate(names)], [col(c) for c in seq or names])
    times = df.select(micros(df, t_col).alias("t")).where("t IS NOT NULL").distinct()
    lags = F.explode(F.array(*[F.struct(F.lit(p).alias("lag"), F.lit(duration(p, unit)).cast("long").alias("d")) for p in periods]))
    wanted = times.select("t", lags.alias("l")).select("t", "l.lag", (F.col("t") - F.col("l.d")).alias("k"))
    match = matched_keys(wanted.select("k").distinct(), rows, tol)
    return wanted.join(match, "k").select("t", "lag", "payload")


def feat_shift(
    s_dat: DataFrame, t_col: str = "DateTime", periods: int | list[int] | None = None, unit: str = "min", tolerance: object = None,
    drop_orig: bool = False, drop_na: bool = True, seq: list[str] | None = None,
) -> DataFrame:
    """Features moved in time: ``<name> <period> <unit>`` holds the feature so much earlier (F2).

    The match is the row nearest to the moved time within ``tolerance`` (a timedelta, a string
    like ``'30s'`` or microseconds), by default half the commonest gap and a second. All periods
    are one join. The time column stays.
    """
    require(s_dat, [t_col])
    names, each = [c for c in s_dat.columns if c != t_col], _periods(periods)
    long = _shifted(s_dat, t_col, each, unit, tolerance, names, seq)
    wide = long.groupBy(F.col("t").alias("_wt")).agg(*[F.max_by("payload", F.when(F.col("lag") == p, 1)).alias(f"_l{i}") for i, p in enumerate(each)])
    out = s_dat.select(row_of(s_dat), micros(s_dat, t_col).alias("_t")).join(wide, F.col("_t") == F.col("_wt"), "left")
    moved = [F.col(f"_l{i}.p{k}").alias(shift_name(c, p, unit)) for i, p in enumerate(each) for k, c in enumerate(names)]
    out = out.select(own(t_col), *([] if drop_orig else [own(c) for c in names]), *moved)
    return drop_missing(out, [c for c in out.columns if c != t_col]) if drop_na else out


def interpolate(df: DataFrame, order: str, names: list[str], seq: list[str] | None = None) -> DataFrame:
    """Linear interpolation of gaps by row position; a leading gap stays, a trailing gap repeats the last value.

    Rows of equal ``order`` stand in the order of ``seq``, by default all other columns that have
    one, so positions don't depend on how the table is dealt to tasks.
    """
    seq = [c for c in df.columns if c != order and not isinstance(kind(df, c), (T.MapType, T.VariantType))] if seq is None else seq
    require(df, [order, *names, *seq])
    places = [f"s{k}" for k in range(len(seq))]
    values = [value(df, c).alias(f"x{k}") for k, c in enumerate(names)]
    rows = df.select(row_of(df), micros(df, order).alias("o"), *[col(c).alias(s) for c, s in zip(seq, places, strict=True)], *values)
    r = numbered(rows, "o", *places, out="at").drop("o", *places)
    for k in range(len(names)):
        known = F.when(F.col(f"x{k}").isNotNull(), F.struct("at", F.col(f"x{k}").alias("x")))
        r = nearest_known(r, ["at"], known, f"b{k}")
        r = nearest_known(r, ["at"], known, f"f{k}", ahead=True)
    out = []
    for c in df.columns:
        if c not in names:
            out.append(own(c))
            continue
        k = names.index(c)
        b, f = F.col(f"b{k}"), F.col(f"f{k}")
        share = F.try_divide(F.col("at") - b.at, f.at - b.at)
        between = b.x + (f.x - b.x) * share
        out.append(F.when(b.isNull(), None).when(f.isNull() | (b.at == f.at), b.x).otherwise(between).alias(c))
    return r.select(*out)


def lag_corr(
    f_dat: DataFrame, y_col: str, f_col: list[str], t_col: str, periods: list[int], unit: str = "min", tolerance: object = None,
) -> DataFrame:
    """(feature, lag, n, r): correlation of each feature ``lag`` earlier with the target.

    The layout stays long, (time, lag, features), and is aggregated by lag; hundreds of lags don't
    widen anything.
    """
    require(f_dat, [y_col, t_col, *f_col])
    long = _shifted(f_dat, t_col, periods, unit, tolerance, f_col, None)
    target = f_dat.select(micros(f_dat, t_col).alias("t"), value(f_dat, y_col).alias("y"))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"payload.p{k}").cast("double").alias("x")) for k, c in enumerate(f_col)]))
    rows = long.join(target, "t").select("lag", "y", each.alias("f")).select("lag", "y", "f.feature", "f.x")
    n = F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1))
    return rows.groupBy("feature", "lag").agg(n.alias("n"), pearson(F.col("x"), F.col("y")).alias("r"))


def lag_matrix(long: DataFrame, periods: list[int], unit: str = "min") -> DataFrame:
    """The result of ``lag_corr`` as features by lags, columns ``<lag> <unit>``."""
    return long.groupBy("feature").agg(*[F.max(F.when(F.col("lag") == p, F.col("r"))).alias(f"{p} {unit}") for p in periods])
