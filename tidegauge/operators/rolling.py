"""Metrics over rolling windows of rows or time.

Windows never share one task: rows are dealt to buckets of one to ``WINDOWS`` windows' length, by how
many rows a window has; each bucket also gets a halo of the neighbouring rows its windows reach
into, and only the rows that own a bucket are kept. Row windows number the rows first by running
sums over range partitions.

Means and quantiles (metrics with ``mean`` or ``quantile``) of all windows of a bucket are found together, in
n log n steps however many rows a window has: sums of halving blocks, and ranks split bit by bit. A
task holds one bucket. Other metrics are evaluated window by window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.metrics import Metric, accuracy, mse, opaque
from ..plans.ranged import numbered
from ..plans.schema import col, duration, is_integer, is_time, kind, micros, own, require, row_of

#: A bucket is so many windows long at most, and has about so many rows if it is longer than one.
WINDOWS, LEAST_ROWS = 16, 8192

#: Buckets are worked off together up to so many rows.
ROWS_AT_ONCE = 200_000

#: What a window takes of its rows: the mean (None) or a quantile of a column.
Taken = tuple[Column, float | None]


def time_bounds(window: int, center: bool, closed: str | None) -> tuple[int, int]:
    """(from, to) of a time window relative to a row, in microseconds, both included."""
    lo, hi = (-(window // 2), window - window // 2) if center else (-window, 0)
    closed = closed or "right"
    return lo + (closed in ("right", "neither")), hi - (closed in ("left", "neither"))


def row_bounds(window: int, center: bool, closed: str | None) -> tuple[int, int]:
    """(from, to) of a row window relative to a row, both included; may be empty."""
    shift = (window - 1) // 2 if center else 0
    lo, hi = shift - window + 1, shift
    closed = closed or "right"
    return lo - (closed in ("left", "both")), hi - (closed in ("left", "neither"))


def _metrics(df: DataFrame, y_true: str, roll_metric: object, native: bool) -> dict[str, Metric]:
    wrap: Callable = (lambda m: m) if native else opaque
    if roll_metric is None:
        return {"Accuracy": accuracy} if is_integer(kind(df, y_true)) else {"MSE": mse}
    if isinstance(roll_metric, dict):
        return {k: wrap(m) for k, m in roll_metric.items()}
    if isinstance(roll_metric, list):
        return {f"Metric {i:02}": wrap(m) for i, m in enumerate(roll_metric)}
    return {"Metric": wrap(roll_metric)}


def _taken(metric: Metric, t: Column, p: Column) -> Taken | None:
    """What a metric takes the mean or which quantile of, if it is one of these."""
    if hasattr(metric, "quantile"):
        of, q = metric.quantile
        return of(t, p), q
    return (metric.mean(t, p), None) if hasattr(metric, "mean") else None


def bucket_length(df: DataFrame, key: str, window: int) -> int:
    """How long a bucket of time is: one window where windows have many rows, several where they have few."""
    n, first, last = df.agg(F.count(key), F.min(key), F.max(key)).first()
    rows = (n or 0) * window / max(1, (last or 0) - (first or 0))
    return max(1, window) * int(max(1, min(WINDOWS, LEAST_ROWS // max(1, rows))))


def block_sums(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sum of x[lo:hi] for each pair, from sums of blocks of 1, 2, 4, ... within it: nothing is subtracted, so what lies outside a window can't blur its sum."""
    out, at = np.zeros(len(lo)), np.flatnonzero(lo < hi)
    lo, hi = lo[at], hi[at]
    while len(at):
        left, right = (lo & 1).astype(bool), (hi & 1).astype(bool)
        out[at[left]] += x[lo[left]]
        out[at[right]] += x[hi[right] - 1]
        lo, hi = (lo + 1) >> 1, hi >> 1
        more = lo < hi
        at, lo, hi = at[more], lo[more], hi[more]
        x = x[: len(x) // 2 * 2].reshape(-1, 2).sum(axis=1)
    return out


def block_quantiles(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, q: float) -> np.ndarray:
    """Interpolated quantile of x[lo:hi] for each pair (0 where it is empty), NaN as the greatest value.

    Ranks are split by one bit after the other, from the highest, each level in the order of the one
    before: the rows of a window stay a stretch of it, and how many have a 0 tells in which half the wanted one is.
    """
    out = np.zeros(len(lo))
    some = np.flatnonzero(lo < hi)
    if not len(some):
        return out
    lo, hi = lo[some], hi[some]
    place = (hi - lo - 1) * q
    below, above = np.floor(place).astype(np.int64), np.ceil(place).astype(np.int64)
    two = np.flatnonzero(below < above)
    k = np.concatenate([below, above[two]])
    lo, hi, found = np.concatenate([lo, lo[two]]), np.concatenate([hi, hi[two]]), np.zeros(len(k), np.int64)
    order = np.argsort(x, kind="stable")
    rank = np.empty(len(x), np.int64)
    rank[order] = np.arange(len(x))
    for bit in range((len(x) - 1).bit_length() - 1, -1, -1):
        one = (rank >> bit & 1).astype(bool)
        zeros = np.concatenate([[0], np.cumsum(~one)])
        from_, to = zeros[lo], zeros[hi]
        up = k >= to - from_
        found += up.astype(np.int64) << bit
        k = np.where(up, k - (to - from_), k)
        lo, hi = np.where(up, zeros[-1] + lo - from_, from_), np.where(up, zeros[-1] + hi - to, to)
        rank = np.concatenate([rank[~one], rank[one]])
    got = x[order][found]
    least, most = got[: len(some)], got[: len(some)].copy()
    most[two] = got[len(some) :]
    part = place - below
    with np.errstate(invalid="ignore"):
        out[some] = np.where(least == most, least, np.where(part > 0, (1 - part) * least + part * most, least))
    return out


def _swept(lo: int, hi: int, quantiles: list[float | None], names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows that come bucket by bucket in order of their key: the rows that own their bucket, with what their windows take."""

    def numbers(held: list[pa.RecordBatch], name: str, null: object) -> np.ndarray:
        return np.concatenate([b[name].fill_null(null).to_numpy(zero_copy_only=False) for b in held])

    def work(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = numbers(held, "_key", 0), numbers(held, "_mine", False)
        begin, end = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
        starts = np.flatnonzero(numbers(held, "_nth", 0) == 1)
        for a, b in zip(starts, [*starts[1:], len(key)], strict=True):
            begin[a:b] = a + np.searchsorted(key[a:b], key[a:b] + lo, "left")
            end[a:b] = a + np.searchsorted(key[a:b], key[a:b] + hi, "right")
        begin, end, means = begin[own], end[own], []
        for k, q in enumerate(quantiles):
            known = np.concatenate([b[f"_x{k}"].is_valid().to_numpy(zero_copy_only=False) for b in held])
            upto = np.concatenate([[0], np.cumsum(known)])
            x, a, b = numbers(held, f"_x{k}", 0.0)[known], upto[begin], np.maximum(upto[begin], upto[end])
            with np.errstate(invalid="ignore", over="ignore"):
                m = block_sums(x, a, b) / np.maximum(b - a, 1) if q is None else block_quantiles(x, a, b, q)
            means.append(pa.array(m, pa.float64(), mask=a == b))
        row = got = 0
        for batch in held:
            mine = own[row : row + len(batch)]
            row, n = row + len(batch), int(mine.sum())
            kept = batch.select(names).filter(pa.array(mine))
            yield pa.RecordBatch.from_arrays([*kept.columns, *[m.slice(got, n) for m in means]], [*names, *[f"_m{k}" for k in range(len(means))]])
            got += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            starts = np.flatnonzero(batch["_nth"].to_numpy(zero_copy_only=False) == 1)
            if size + len(batch) >= ROWS_AT_ONCE and len(starts) and size + starts[-1]:
                yield from work([*held, batch.slice(0, starts[-1])])
                held, size, batch = [], 0, batch.slice(starts[-1])
            held.append(batch)
            size += len(batch)
        if size:
            yield from work(held)

    return run


def windowed(df: DataFrame, key: str, lo: int, hi: int, aggs: Callable[[object], list[Column]], length: int, by: list[str], taken: dict[str, Taken] | None = None) -> DataFrame:
    """Adds the aggregates over rows whose ``key`` is within [key + lo, key + hi], in buckets with a halo (and a column ``bucket``); then what is ``taken``."""
    size = max(1, length)
    bucket = lambda c: F.floor(c / size).cast("long")
    first, last = bucket(F.col(key) - max(hi, 0)), bucket(F.col(key) - min(lo, 0))
    spread = df.withColumn("bucket", F.explode(F.sequence(first, last)))
    w = W.partitionBy(*by, "bucket").orderBy(key).rangeBetween(lo, hi)
    mine = F.col("bucket") == bucket(F.col(key))
    if not taken:
        return spread.select("*", *aggs(w)).where(mine)
    rows = spread.select("*", *aggs(w))
    kept = rows.columns
    xs = [x.cast("double").alias(f"_x{k}") for k, (x, _) in enumerate(taken.values())]
    nth = F.row_number().over(W.partitionBy(*by, "bucket").orderBy(key))  # also puts each bucket's rows together, in order
    rows = rows.select("*", F.col(key).cast("long").alias("_key"), mine.alias("_mine"), *xs, nth.alias("_nth"))
    schema = T.StructType([*[rows.schema[c] for c in kept], *[T.StructField(f"_m{k}", T.DoubleType()) for k in range(len(taken))]])
    out = rows.mapInArrow(_swept(lo, hi, [q for _, q in taken.values()], kept), schema)
    return out.withColumnsRenamed({f"_m{k}": name for k, name in enumerate(taken)})


def rolling_met(
    met_dat: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", on: str = "DateTime", roll_kwargs: dict | None = None,
    roll_metric: object = None, partition_by: list[str] | None = None, native: bool = True, ties: list[str] | None = None,
) -> DataFrame:
    """One row for each window: the metrics, then ``on`` (and ``partition_by``, whose groups roll apart).

    ``roll_kwargs``: window (rows, or a length of time), center, closed, step; partial windows
    count, ``min_periods`` has no effect, ``win_type`` is refused. ``roll_metric``: an aggregate of two
    columns, a list or a dictionary of such; with ``native=False`` functions of two arrays. ``ties``: what
    orders rows of equal ``on`` in windows of rows and for ``step``, as the columns say and before the values do.
    """
    groups = partition_by or []
    ties = ties or []
    require(met_dat, [on, y_true, y_pred, *groups, *ties])
    kw = dict(roll_kwargs or {"center": True})
    if kw.get("win_type"):
        raise ValueError("weighted windows are not supported: metrics have no weights")
    timed = is_time(kind(met_dat, on))
    window = kw.get("window", "60min" if timed else 10)
    metrics = _metrics(met_dat, y_true, roll_metric, native)
    by = [f"g{k}" for k in range(len(groups))]
    df = met_dat.select(col(on).alias("on"), col(y_true).alias("t"), col(y_pred).alias("p"), *[col(c).alias(g) for g, c in zip(by, groups, strict=True)], micros(met_dat, on).alias("k"), *[col(c).alias(f"o{k}") for k, c in enumerate(ties)])
    order = ["k", *[f"o{k}" for k in range(len(ties))], "t", "p"]
    in_time = not isinstance(window, int)
    if in_time and not timed:
        raise ValueError("a window of time needs a time column")
    if in_time:
        length = duration(window)
        lo, hi = time_bounds(length, bool(kw.get("center")), kw.get("closed"))
        key, df = "k", df.where("k IS NOT NULL")
        bucket = bucket_length(df, key, length)
    else:
        lo, hi = row_bounds(int(window), bool(kw.get("center")), kw.get("closed"))
        df = _numbered_by(df, by, order)
        key, bucket = "rn", max(LEAST_ROWS, WINDOWS * int(window))

    taken = {f"m{k}": x for k, m in enumerate(metrics.values()) if (x := _taken(m, F.col("t"), F.col("p"))) is not None}

    def aggs(w: object) -> list[Column]:
        return [(F.lit(None).cast("double") if w is None else m(F.col("t"), F.col("p")).over(w)).alias(f"m{k}") for k, m in enumerate(metrics.values()) if w is None or f"m{k}" not in taken]

    out = windowed(df, key, lo, hi, aggs, bucket, by, taken) if lo <= hi else df.select("*", *aggs(None))
    if kw.get("step"):
        out = (_numbered_by(out, by, order) if in_time else out).where((F.col("rn") - 1) % int(kw["step"]) == 0)
    return out.select(*[F.col(f"m{k}").alias(n) for k, n in enumerate(metrics)], F.col("on").alias(on), *[F.col(g).alias(c) for g, c in zip(by, groups, strict=True)])


def _numbered_by(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Row numbers in ``order``, from 1 in each group of ``by``."""
    if not by:
        return numbered(df, *order, out="rn")
    r = numbered(df, *by, *order, out="all")
    first = r.groupBy(*[F.col(c).alias(f"of_{c}") for c in by]).agg(F.min("all").alias("first"))
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in by]
    return r.join(first, same).withColumn("rn", F.col("all") - F.col("first") + 1).drop("all", "first", *[f"of_{c}" for c in by])


def rolling_mean(df: DataFrame, name: str, on: str, window: str, center: bool = False, closed: str | None = None, out: str | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """Adds the mean of a column over a window of time, trailing unless ``center``; rows without a time go."""
    length, out = duration(window), out or f"{name}_mean"
    lo, hi = time_bounds(length, center, closed)
    by = [f"g{k}" for k in range(len(partition_by or []))]
    rows = df.select(row_of(df), micros(df, on).alias("k"), col(name).alias("v"), *[col(c).alias(g) for g, c in zip(by, partition_by or [], strict=True)]).where("k IS NOT NULL")
    got = windowed(rows, "k", lo, hi, lambda w: [], bucket_length(rows, "k", length), by, {"m": (F.col("v"), None)})
    return got.select(*[own(c) for c in df.columns if c != out], F.col("m").alias(out))
