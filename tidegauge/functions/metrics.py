"""Metrics of (y_true, y_pred) as aggregate expressions.

Each is a function of two columns that gives an aggregate: usable in ``groupBy().agg()`` and over
windows. Rows where either side is NULL don't count. An empty group is NULL.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.schema import col

Metric = Callable[[Column, Column], Column]


def _both(yt: Column, yp: Column, x: Column) -> Column:
    return F.when(yt.isNotNull() & yp.isNotNull(), x)


def accuracy(yt: Column, yp: Column) -> Column:
    return F.avg(_both(yt, yp, (yt == yp).cast("double")))


def accuracy_count(yt: Column, yp: Column) -> Column:
    return F.sum(_both(yt, yp, (yt == yp).cast("double")))


def mse(yt: Column, yp: Column) -> Column:
    e = yt.cast("double") - yp.cast("double")
    return F.avg(e * e)


def mae(yt: Column, yp: Column) -> Column:
    return F.avg(F.abs(yt.cast("double") - yp.cast("double")))


def neg_mae(yt: Column, yp: Column) -> Column:
    return -mae(yt, yp)


def medae(yt: Column, yp: Column) -> Column:
    """Median absolute error, exact and interpolated."""
    return F.percentile(F.abs(yt.cast("double") - yp.cast("double")), F.lit(0.5))


#: For groups beyond a task's memory: what to take which exact quantile of.
medae.quantile = (lambda yt, yp: F.abs(yt.cast("double") - yp.cast("double")), 0.5)
#: For windows: what to take the mean of.
accuracy.mean = lambda yt, yp: _both(yt, yp, (yt == yp).cast("double"))
mse.mean = lambda yt, yp: (yt.cast("double") - yp.cast("double")) * (yt.cast("double") - yp.cast("double"))
mae.mean = lambda yt, yp: F.abs(yt.cast("double") - yp.cast("double"))
neg_mae.mean = lambda yt, yp: -mae.mean(yt, yp)


def r2(yt: Column, yp: Column) -> Column:
    return 1 - F.try_divide(mse(yt, yp), F.var_pop(_both(yt, yp, yt.cast("double"))))


def log_loss(yt: Column, yp: Column, eps: float = 1e-15) -> Column:
    """Binary cross-entropy of probabilities, clipped away from 0 and 1."""
    return -F.avg(_log_likelihood(yt, yp, eps))


def _log_likelihood(yt: Column, yp: Column, eps: float = 1e-15) -> Column:
    p = F.least(F.greatest(yp.cast("double"), F.lit(eps)), F.lit(1 - eps))
    y = yt.cast("double")
    return y * F.ln(p) + (1 - y) * F.ln(1 - p)


log_loss.mean = lambda yt, yp: -_log_likelihood(yt, yp)


def opaque(fn: Callable[[np.ndarray, np.ndarray], float]) -> Metric:
    """Any function of two arrays, as a vectorised aggregate (the only metrics that leave the JVM)."""

    def metric(yt: Column, yp: Column) -> Column:
        @F.pandas_udf("double")
        def run(a: pd.Series, b: pd.Series) -> float:
            ok = a.notna() & b.notna()
            return float(fn(a[ok].to_numpy(), b[ok].to_numpy())) if ok.any() else None

        return run(yt, yp)

    return metric


def homogeneity(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """One row, ``homogeneity``: 1 - H(true | predicted) / H(true), from counts of label pairs."""
    n = df.select(col(y_true).alias("t"), col(y_pred).alias("p")).na.drop().groupBy("t", "p").agg(F.count("*").cast("double").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    by_p = n.groupBy("p").agg(F.sum("n").alias("np"))
    by_t = n.groupBy("t").agg(F.sum("n").alias("nt"))
    given = n.join(by_p, "p").agg((-F.sum(F.col("n") * F.ln(F.col("n") / F.col("np")))).alias("hc"))
    alone = by_t.join(F.broadcast(total)).agg((-F.sum(F.col("nt") * F.ln(F.col("nt") / F.col("total")))).alias("ht"))
    return given.join(F.broadcast(alone)).select(F.when(F.col("ht") == 0, 1.0).otherwise(1 - F.try_divide("hc", "ht")).alias("homogeneity"))


def homogeneity_score(a: np.ndarray, b: np.ndarray) -> float:
    """The same for one group of rows; to be used with ``opaque``."""
    table = pd.crosstab(a, b).to_numpy(float)
    entropy = lambda x: -(x[x > 0] * np.log(x[x > 0] / x.sum())).sum()
    whole = entropy(table.sum(axis=1))
    return 1.0 if whole == 0 else 1 - sum(entropy(c) for c in table.T) / whole


def roc_auc(df: DataFrame, y_true: str, score: str) -> DataFrame:
    """One row, ``auc``: the Mann-Whitney statistic, ties counted half, from counts of distinct scores."""
    from ..plans.ranged import ranged, running

    own = df.select(col(y_true).cast("double").alias("y"), col(score).cast("double").alias("s")).na.drop()
    n = own.groupBy("s").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    r = running(ranged(n, "s"), ["s"], F.col("neg"), "upto")
    area = F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2))
    return r.agg(F.try_divide(area, F.sum("pos") * F.sum("neg")).alias("auc"))


NAMED: dict[str, Metric] = {
    "accuracy": accuracy, "accuracy_count": accuracy_count, "mse": mse, "mae": mae, "medae": medae, "median_absolute_error": medae, "r2": r2, "log_loss": log_loss,
    "neg_mean_absolute_error": neg_mae, "neg_mean_squared_error": lambda yt, yp: -mse(yt, yp), "neg_median_absolute_error": lambda yt, yp: -medae(yt, yp), "neg_log_loss": lambda yt, yp: -log_loss(yt, yp),
}
#: Errors: of these the least is the best.
LESS_IS_BETTER = frozenset(["mse", "mae", "medae", "median_absolute_error", "log_loss"])
