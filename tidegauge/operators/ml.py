"""Training and exhaustive grid search over ``pyspark.ml`` estimators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import product

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import Classifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.metrics import LESS_IS_BETTER, NAMED
from ..plans.schema import col, own, require, row_of
from .sample import fold_of, subsample

FEATURES = "features"

#: Rows one task of a fit has, on average: estimators keep their table by the partitions it comes in.
ROWS_A_TASK = 250_000


def assembled(df: DataFrame, f_col: list[str], out: str) -> DataFrame:
    """Adds the feature vector; rows with undefined features are refused by the assembler."""
    require(df, f_col)
    return VectorAssembler(inputCols=f_col, outputCol=out).transform(df)


def inputs(df: DataFrame, f_col: list[str], y_col: str, more: dict[str, Column] | None = None) -> tuple[DataFrame, str, str]:
    """(table, vector's name, target's name): the vector and the target under names of their own, and more columns beside them."""
    more = more or {}
    names = [f"x{k}" for k in range(len(f_col))]
    require(df, [*f_col, y_col])
    rows = df.select(*[col(c).alias(n) for n, c in zip(names, f_col, strict=True)], col(y_col).alias("target"), *[c.alias(n) for n, c in more.items()])
    return assembled(rows, names, FEATURES).select(FEATURES, "target", *more), FEATURES, "target"


def dealt(data: DataFrame) -> DataFrame:
    """All rows of the table, in more partitions where it has too few for its rows."""
    rows = data.count()
    if rows <= ROWS_A_TASK * max(1, data.rdd.getNumPartitions()):
        return data
    return data.repartition(-(-rows // ROWS_A_TASK))


def seeded(estimator: Estimator, random_state: int) -> tuple[Estimator, int]:
    """The estimator's own seed wins if it is set and not 0, else it gets ``random_state``."""
    if estimator.hasParam("seed"):
        if estimator.isSet("seed") and estimator.getOrDefault("seed"):
            return estimator, estimator.getOrDefault("seed")
        estimator = estimator.copy({estimator.getParam("seed"): random_state})
    return estimator, random_state


def grid(params: dict[str, list] | list[dict[str, list]]) -> list[dict[str, object]]:
    """All combinations; of a list of grids one after the other."""
    out = []
    for g in [params] if isinstance(params, dict) else params:
        out += [dict(zip(g, values, strict=True)) for values in product(*g.values())]
    return out


@dataclass
class GridResult:
    """Scores of every candidate: ``rows`` are (candidate, score name, mean); ``best`` is a candidate's number."""

    params: list[dict[str, object]]
    rows: list[tuple[int, str, float]] = field(default_factory=list)
    best: int = 0
    model: Model | None = None


def multi_score(scores: DataFrame) -> DataFrame:
    """(candidate, rms) of a table (candidate, score, value): each score scaled to 0..1, then root mean square.

    A score without spread, or undefined, counts 0. The best candidate is the first by rms, then number.
    """
    w = W.partitionBy("score")
    spread = F.max("value").over(w) - F.min("value").over(w)
    scaled = scores.withColumn("s", F.coalesce(F.try_divide(F.col("value") - F.min("value").over(w), spread), F.lit(0.0)))
    return scaled.groupBy("candidate").agg(F.sqrt(F.avg(F.col("s") * F.col("s"))).alias("rms"))


def best_candidate(scores: DataFrame) -> int:
    return multi_score(scores).orderBy(F.desc("rms"), "candidate").limit(1).first()["candidate"]


def scorers(estimator: Estimator, scoring: str | list[str] | dict[str, str | Callable] | None) -> dict[str, tuple[Callable, int]]:
    """(metric, sign) by the score's name: 1 where more is better, -1 for errors.

    Without ``scoring`` it is the estimator's own: accuracy for classifiers, else r2. A metric of the
    caller's own is better the greater it is. Unknown names raise ValueError.
    """
    if scoring is None:
        scoring = "accuracy" if isinstance(estimator, Classifier) else "r2"
    named = {"score": scoring} if isinstance(scoring, str) or callable(scoring) else {s: s for s in scoring} if isinstance(scoring, list) else dict(scoring)
    out = {}
    for name, m in named.items():
        if isinstance(m, str) and m not in NAMED:
            raise ValueError(f"unknown score {m!r}; known are {sorted(NAMED)}")
        out[name] = (NAMED[m], -1 if m in LESS_IS_BETTER else 1) if isinstance(m, str) else (m, 1)
    return out


def tune(
    estimator: Estimator, grid_param: dict | list[dict], df: DataFrame, f_col: list[str], y_col: str, key: list[str], cv: int = 3,
    scoring: str | list[str] | dict[str, str | Callable] | None = None, refit: bool = True, random_state: int = 17,
) -> GridResult:
    """Cross-validates every candidate on hash folds of ``key``.

    One score: its mean over the test folds decides. Several: means of train and test folds are
    combined as in ``multi_score``, errors with their sign turned. A mean is undefined (None) if a fold's
    score is, and then the worst. With ``refit`` the best candidate is fitted on all rows.
    """
    metrics = scorers(estimator, scoring)
    data, vector, label = inputs(df, f_col, y_col, {"fold": fold_of(df, key, cv, random_state)})
    data = dealt(data).cache()
    result = GridResult(grid(grid_param))
    target = {"featuresCol": vector, "labelCol": label}
    means: dict[tuple[int, str], float | None] = {}
    for c, params in enumerate(result.params):
        own = estimator.copy({estimator.getParam(k): v for k, v in {**target, **params}.items()})
        for part in range(cv):
            model = own.fit(data.where(F.col("fold") != part))
            scored = model.transform(data).groupBy((F.col("fold") == part).alias("test")).agg(*[m(F.col(label), F.col("prediction")).alias(k) for k, (m, _) in metrics.items()])
            for row in scored.collect():  # two rows
                for k in metrics:
                    which = c, f"mean_{'test' if row['test'] else 'train'}_{k}"
                    upto = means.get(which, 0.0)
                    means[which] = None if upto is None or row[k] is None else upto + row[k] / cv
    result.rows = [(c, k, v) for (c, k), v in sorted(means.items())]
    sign = {k: s for k, (_, s) in metrics.items()}
    turned = [(c, k, None if v is None else v * sign[k.split("_", 2)[2]]) for c, k, v in result.rows]
    if len(metrics) > 1:
        result.best = best_candidate(df.sparkSession.createDataFrame(turned, "candidate int, score string, value double"))
    else:
        test = {c: v for c, k, v in turned if k.startswith("mean_test_")}
        result.best = min(range(len(result.params)), key=lambda c: (test.get(c) is None, -(test.get(c) or 0.0), c))
    if refit:
        own = estimator.copy({estimator.getParam(k): v for k, v in {**target, **result.params[result.best]}.items()})
        result.model = own.fit(data)
    data.unpersist()
    return result


def train(
    df: DataFrame, f_col: list[str], y_col: str, estimator: Estimator, key: list[str], grid_params: dict | list[dict] | None = None,
    grid_kwargs: dict | None = None, grid_ratio: float | None = 0.3, random_state: int = 17,
) -> Model:
    """Fits an estimator, with ``grid_params`` after a grid search on ``grid_ratio`` of the rows (F8)."""
    require(df, [*f_col, y_col, *key])
    estimator, random_state = seeded(estimator, random_state)
    chosen: dict[str, object] = {}
    if grid_params:
        part = subsample(df, key, grid_ratio, random_state) if grid_ratio and grid_ratio < 1 else df
        found = tune(estimator, grid_params, part, f_col, y_col, key, **{"refit": False, "random_state": random_state, **(grid_kwargs or {})})
        chosen = found.params[found.best]
    data, vector, label = inputs(df, f_col, y_col)
    own = estimator.copy({estimator.getParam(k): v for k, v in {"featuresCol": vector, "labelCol": label, **chosen}.items()})
    return own.fit(dealt(data))


def predict(model: Model, df: DataFrame, f_col: list[str], y_col: str) -> DataFrame:
    """``df`` with ``<y_col>_pred``."""
    require(df, f_col)
    vector = model.getFeaturesCol()
    names = [f"x{k}" for k in range(len(f_col))]
    rows = df.select(row_of(df), *[col(c).alias(n) for n, c in zip(names, f_col, strict=True)])
    out = model.transform(assembled(rows, names, vector))
    return out.select(*[own(c) for c in df.columns], F.col("prediction").alias(f"{y_col}_pred"))
