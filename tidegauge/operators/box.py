"""Box-and-whisker statistics in bins of x (F5), and of resampled metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.metrics import Metric, accuracy, mse, opaque
from ..plans.schema import as_list, col, is_integer, kind, require, value
from .bins import binned, edge_table, edges_of
from .quantiles import quantiles
from .sample import hash_key

STATS = ("mean", "med", "q1", "q3", "whislo", "whishi")
QUARTILES = [0.25, 0.5, 0.75]
#: A fold's last row is looked for among the hashes this many standard deviations around its expected place; then wider.
SIGMAS, WIDER = 6.0, 8.0
#: Greater than any hash.
TOP = "g"


def _single(y_col: list[str] | str, what: str) -> str:
    names = [y_col] if isinstance(y_col, str) else as_list(y_col, what)
    if len(names) != 1:
        raise ValueError(f"{what} must be one column")
    return names[0]


def _spread(df: DataFrame, whisker: float) -> DataFrame:
    """Quartiles as the statistics of a box."""
    q1, q3 = F.col("q0"), F.col("q2")
    return df.withColumns({"med": F.col("q1"), "whislo": q1 - whisker * (q3 - q1), "whishi": q3 + whisker * (q3 - q1)}).withColumnsRenamed({"q1": "_", "q0": "q1", "q2": "q3"}).drop("_")


def boxplot_vx(df: DataFrame, x_col: list[str], y_col: list[str] | str, bins: object = 10, xrange: object = None, whisker: float = 1.5) -> DataFrame:
    """One row for each x column and bin: edges, centre, width, n, mean, med, q1, q3, whislo, whishi.

    Quartiles are exact and interpolated; NaN and infinite y don't count; bins without y have NULL
    statistics. All x columns share one shuffle of distinct values, ordered by ranges.
    """
    as_list(x_col, "x_col")
    y = _single(y_col, "y_col")
    require(df, [*x_col, y])
    edges = edges_of(df, x_col, bins, xrange)
    stats = _spread(quantiles(binned(df, edges, value(df, y).alias("y")), ["x_col", "bin"], "y", QUARTILES), whisker)
    out = edge_table(df, edges).join(stats, ["x_col", "bin"], "left")
    return out.select("x_col", "bin", "x_lo", "x_hi", "x_centre", "x_width", F.coalesce("n", F.lit(0)).alias("n"), *STATS)


def default_metric(df: DataFrame, y_true: str, y_pred: str) -> Metric:
    """Accuracy where both are integers, else the mean squared error."""
    return accuracy if is_integer(kind(df, y_true)) and is_integer(kind(df, y_pred)) else mse


def boxplot_metvx(
    df: DataFrame, x_col: list[str], y_true: list[str] | str, y_mod: list[str] | str, key: list[str], box_metric: Metric | Callable | None = None,
    kfolds: int = 100, kfrac: float = 0.5, bins: object = 10, xrange: object = None, whisker: float = 1.5, native: bool = True,
) -> DataFrame:
    """Box statistics of a metric over ``kfolds`` samples of each bin, drawn without replacement.

    The sample of a fold is the ``kfrac`` (rounded half to even) of the bin's rows that rank first
    by a hash of ``key`` and the fold's number; ``key`` has to be unique for the sample to be of that
    size (rows of equal keys are drawn together). Bins of one row or none have all statistics 0.
    ``box_metric`` is an aggregate of two columns, or with ``native=False`` any function of two arrays.

    No row is copied or shuffled for a fold: each fold's last hash is found first (``_last_drawn``), a
    table of bins by folds rows that is broadcast, and rows up to it are aggregated where they are.
    """
    yt, yp = _single(y_true, "y_true"), _single(y_mod, "y_mod")
    require(df, [*as_list(x_col, "x_col"), yt, yp, *key])
    metric = default_metric(df, yt, yp) if box_metric is None else box_metric if native else opaque(box_metric)
    edges = edges_of(df, x_col, bins, xrange)
    rows = binned(df, edges, col(yt).alias("t"), col(yp).alias("p"), hash_key(df, key).alias("k"))
    sizes = rows.groupBy("x_col", "bin").agg(F.count("*").alias("n"), F.rint(kfrac * F.count("*")).cast("long").alias("take")).collect()  # a row for each bin
    spark = df.sparkSession
    last = spark.createDataFrame(_last_drawn(rows, [(r["x_col"], r["bin"], fold, r["n"], r["take"]) for r in sizes for fold in range(kfolds)]), "x_col string, bin int, fold int, last_h string, last_k string")
    drawn = rows.join(F.broadcast(last), ["x_col", "bin"]).where(F.struct(fold_hash().alias("h"), F.col("k").alias("k")) <= F.struct(F.col("last_h").alias("h"), F.col("last_k").alias("k")))
    keys = ["x_col", "bin", "fold"]
    if hasattr(metric, "quantile"):
        y, prob = metric.quantile
        scores = quantiles(drawn.select(*keys, y(F.col("t"), F.col("p")).alias("y")), keys, "y", [prob]).select(*keys, F.col("q0").alias("score"))
    else:
        scores = drawn.groupBy(*keys).agg(metric(F.col("t"), F.col("p")).alias("score"))
    q = F.percentile("score", F.array(*[F.lit(p) for p in QUARTILES]))  # of ``kfolds`` scores
    stats = scores.groupBy("x_col", "bin").agg(F.avg("score").alias("mean"), q.alias("q"))
    stats = _spread(stats.select("x_col", "bin", "mean", *[F.col("q")[k].alias(f"q{k}") for k in range(3)]), whisker)
    known = spark.createDataFrame([(r["x_col"], r["bin"], r["n"]) for r in sizes], "x_col string, bin int, n long")
    out = edge_table(df, edges).join(F.broadcast(known), ["x_col", "bin"], "left").join(stats, ["x_col", "bin"], "left")
    few = F.coalesce("n", F.lit(0)) <= 1
    return out.select("x_col", "bin", "x_lo", "x_hi", "x_centre", "x_width", F.coalesce("n", F.lit(0)).alias("n"), *[F.when(few, 0.0).otherwise(F.col(c)).alias(c) for c in STATS])


def fold_hash() -> Column:
    return F.md5(F.concat_ws(":", "k", "fold").cast("binary"))


def _last_drawn(rows: DataFrame, samples: list[tuple[str, int, int, int, int]]) -> list[tuple[str, int, int, str, str]]:
    """(x_col, bin, fold, hash, key) of the last row of each sample (x_col, bin, fold, rows, rows to draw).

    Hashes are uniform, so the place of the last row's is known but for a few standard deviations.
    One pass counts the rows below that stretch and ranks those within it, in the order of the
    square root of a bin's rows; a sample whose last row isn't there is looked for in a wider one.
    """
    spark, found, width = rows.sparkSession, [], SIGMAS
    text = lambda x: f"{int(x * 2**32):08x}" if x < 1 else TOP
    while samples:
        bounds = []
        for x_col, b, fold, n, take in samples:
            if take >= n:
                found.append((x_col, b, fold, TOP, ""))
            elif take > 0:
                p, s = take / n, width * (take * (n - take) / n**3) ** 0.5 + 2 / n
                bounds.append((x_col, b, fold, take, text(max(0.0, p - s)) if p > s else "", text(p + s)))
        if not bounds:
            break
        table = spark.createDataFrame(bounds, "x_col string, bin int, fold int, take long, lo string, hi string")
        near = rows.join(F.broadcast(table), ["x_col", "bin"]).withColumn("h", fold_hash()).where("h < hi")
        near = near.select("x_col", "bin", "fold", "take", F.when(F.col("h") >= F.col("lo"), F.struct("h", "k")).alias("at"))
        counts = near.groupBy("x_col", "bin", "fold", "take", "at").agg(F.count("*").alias("c"))
        upto = F.sum("c").over(W.partitionBy("x_col", "bin", "fold").orderBy(F.asc_nulls_first("at")).rowsBetween(W.unboundedPreceding, 0))
        reached = counts.withColumn("upto", upto).where("upto >= take").groupBy("x_col", "bin", "fold")
        # the first place that reaches the sample's size; where that is below the stretch it is NULL
        got = {tuple(r[:3]): r["at"] for r in reached.agg(F.min_by("at", "upto").alias("at")).collect()}  # a row for each sample
        found += [(*k, at["h"], at["k"]) for k, at in got.items() if at is not None]
        samples = [s for s in samples if 0 < s[4] < s[3] and got.get(s[:3]) is None]
        width *= WIDER
    return found


def to_bxp(stats: DataFrame) -> dict[str, dict]:
    """The result of a box plot as nested dictionaries, the form that plotting takes (a few rows for each bin)."""
    out: dict[str, dict] = {}
    for r in stats.orderBy("x_col", "bin").collect():
        own = out.setdefault(r["x_col"], {"box_stats": [], "x_edge": [r["x_lo"]], "x_centre": [], "x_width": r["x_width"]})
        own["box_stats"].append({**{c: r[c] for c in STATS}, "fliers": []})
        own["x_edge"].append(r["x_hi"])
        own["x_centre"].append(r["x_centre"])
    return out
