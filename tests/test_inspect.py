"""Bins, boxes, rolling windows, sampling, metrics and training."""

import hashlib
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.functions import metrics as M
from tidegauge.operators import bins, box, ml, rolling, sample
from tidegauge.operators import quantiles as quantiles_module
from tidegauge.operators.quantiles import quantiles
from tidegauge.plans.catalogue import QUERIES
from tidegauge.plans.schema import duration


def test_bin_closure(spark):
    e = bins.Edges([0.0, 1.0, 2.0])
    df = spark.createDataFrame([(x,) for x in (-0.1, 0.0, 0.5, 1.0, 2.0, 2.1, None)], "x double")
    assert [r[0] for r in df.select(e.bin(F.col("x"))).collect()] == [None, 0, 0, 1, 1, None, None]


def test_bins_partition_the_rows_in_range(spark):
    df = spark.range(1000).select((F.rand(4) * 30 - 5).alias("x"))
    edges = bins.edges_of(df, ["x"], 7, [0, 20])
    inside = df.where("x >= 0 and x <= 20").count()
    assert bins.binned(df, edges).count() == inside
    assert bins.edges_of(spark.createDataFrame([(3.0,)], "x double"), ["x"], 2)["x"].edges == [2.5, 3.0, 3.5]


def test_boxes_equal_numpy(spark):
    rng = np.random.default_rng(2)
    p = pd.DataFrame({"x": rng.random(300) * 10, "y": rng.random(300)})
    p.loc[::17, "y"] = np.nan
    got = box.boxplot_vx(spark.createDataFrame(p), ["x"], ["y"], bins=4, xrange=[0, 10], whisker=1.0).orderBy("bin").collect()
    for k, r in enumerate(got):
        own = p[(p.x >= k * 2.5) & (p.x < (k + 1) * 2.5)].y.dropna()
        q1, med, q3 = np.percentile(own, [25, 50, 75])
        assert [r["mean"], r.med, r.q1, r.q3, r.whislo, r.whishi] == pytest.approx([own.mean(), med, q1, q3, q1 - (q3 - q1), q3 + (q3 - q1)])
        assert r.n == len(own) and r.x_centre == k * 2.5 + 1.25 and r.x_width == 2.5


def test_empty_bins_and_nested_form(spark):
    df = spark.createDataFrame([(0.5, 1.0), (0.6, 2.0)], "x double, y double")
    out = box.boxplot_vx(df, ["x"], ["y"], bins=3, xrange=[0, 3])
    nested = box.to_bxp(out)["x"]
    assert nested["x_edge"] == [0.0, 1.0, 2.0, 3.0] and nested["x_width"] == 1.0
    assert [b["med"] for b in nested["box_stats"]] == [1.5, None, None] and nested["box_stats"][0]["fliers"] == []


def test_bin_arguments(spark):
    df = spark.createDataFrame([(0.5, 1.0, 2.0)], "x double, z double, y double")
    for kw in ({"bins": [1]}, {"xrange": [0, 1]}, {"xrange": [[0, 1]]}):
        with pytest.raises(ValueError):
            box.boxplot_vx(df, ["x", "z"], ["y"], **kw)
    with pytest.raises(ValueError):
        box.boxplot_vx(df, ["x"], ["y", "z"])
    assert box.boxplot_vx(df, ["x", "z"], ["y"], bins=[2, 3], xrange=[(0, 1), None]).count() == 5


def brute_sample(keys, fold, frac=0.5):
    return sorted(keys, key=lambda k: (hashlib.md5(f"{k}:{fold}".encode()).hexdigest(), str(k)))[: round(frac * len(keys))]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 9, 3000])
def test_samples_are_the_lowest_hashes(spark, n):
    df = spark.range(n).select("id", F.lit(0.5).alias("x"), F.lit(0).alias("t"), F.pow(2.0, F.col("id") % 40).alias("p"))
    seen = []
    metric = lambda t, p: seen.append(1) or F.sum("p")
    got = box.boxplot_metvx(df, ["x"], ["t"], ["p"], ["id"], metric, kfolds=3, bins=1, xrange=[0, 1]).first()
    sums = [sum(2.0 ** (k % 40) for k in brute_sample(range(n), fold)) for fold in range(3)]
    assert got.n == n and [got["mean"], got.med] == pytest.approx([np.mean(sums), np.median(sums)] if n > 1 else [0, 0])


def test_last_rows_outside_the_first_stretch_are_found(spark, monkeypatch):
    monkeypatch.setattr(box, "SIGMAS", 0.0)
    monkeypatch.setattr(box, "WIDER", 3.0)
    rows = spark.range(2000).select(F.lit("x").alias("x_col"), F.lit(0).alias("bin"), F.col("id").cast("string").alias("k"))
    widths = []
    real = spark.createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **kw: widths.append(len(data)) or real(data, *a, **kw))
    samples = [("x", 0, fold, 2000, take) for fold, take in enumerate([0, 1, 700, 1000, 1999, 2000])]
    monkeypatch.setattr(box, "SIGMAS", 0.02)
    got = {r[2]: r[3:] for r in box._last_drawn(rows, samples)}
    for _, _, fold, _, take in samples:
        order = sorted((hashlib.md5(f"{k}:{fold}".encode()).hexdigest(), str(k)) for k in range(2000))
        assert got.get(fold) == (None if take == 0 else ("g", "") if take == 2000 else order[take - 1])
    assert len(widths) > 1


def test_rows_of_equal_keys_are_drawn_together(spark):
    df = spark.range(400).select((F.col("id") % 2).alias("k"), F.lit(0.5).alias("x"), F.lit(0).alias("t"), F.lit(1.0).alias("p"))
    got = box.boxplot_metvx(df, ["x"], ["t"], ["p"], ["k"], lambda t, p: F.sum("p"), kfolds=4, bins=1, xrange=[0, 1]).first()
    assert got["mean"] == 200.0


@pytest.mark.parametrize(("accuracy", "errors"), [(2000, 2.0), (50, 2.0), (50, 0.0), (3, -1.0)])
def test_quantiles_equal_numpy_over_many_ranges(spark, accuracy, errors, monkeypatch):
    monkeypatch.setattr(quantiles_module, "ACCURACY", accuracy)  # few of the rows are in brackets, or none: then all values are counted
    monkeypatch.setattr(quantiles_module, "ERRORS", errors)
    rng = np.random.default_rng(7)
    p = pd.DataFrame({"g": rng.choice(["hot", "b", "c"], 3000, p=[0.9, 0.08, 0.02]), "v": np.where(rng.random(3000) < 0.4, 5.0, rng.normal(size=3000).round(3))})
    p.loc[len(p)] = ["one", -3.0]
    probs = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    got = {r.g: r for r in quantiles(spark.createDataFrame(p), ["g"], "v", probs).collect()}
    assert len(got) == 4
    for g, own in p.groupby("g"):
        assert got[g].n == len(own) and got[g]["mean"] == pytest.approx(own.v.mean())
        assert [got[g][f"q{k}"] for k in range(len(probs))] == pytest.approx(np.quantile(own.v, probs).tolist())
    assert quantiles(spark.createDataFrame(p).where("false"), ["g"], "v", probs).count() == 0


def test_median_errors_of_folds_leave_the_groups_spread(spark):
    df = spark.range(600).select("id", (F.col("id") % 5 * 1.0).alias("x"), F.rand(3).alias("t"), F.rand(4).alias("p"))
    args = (df, ["x"], ["t"], ["p"], ["id"])
    a = box.boxplot_metvx(*args, M.medae, kfolds=5, bins=3).orderBy("bin").collect()
    b = box.boxplot_metvx(*args, lambda t, p: M.medae(t, p), kfolds=5, bins=3).orderBy("bin").collect()
    assert [[r[c] for c in ("n", *box.STATS)] for r in a] == [pytest.approx([r[c] for c in ("n", *box.STATS)]) for r in b]


def test_metric_boxes(spark):
    df = spark.range(200).select("id", (F.col("id") % 4).alias("t"), (F.col("id") % 2).alias("p"), (F.col("id") / 100).alias("x"))
    out = box.boxplot_metvx(df, ["x"], ["t"], ["p"], ["id"], kfolds=6, bins=4, xrange=[0, 4]).orderBy("bin").collect()
    assert [r.n for r in out] == [100, 100, 0, 0]
    assert 0.3 < out[0].med < 0.7
    assert [out[3][c] for c in box.STATS] == [0.0] * 6
    same = box.boxplot_metvx(df.repartition(5), ["x"], ["t"], ["p"], ["id"], kfolds=6, bins=4, xrange=[0, 4]).orderBy("bin").collect()
    assert same == out
    mine = box.boxplot_metvx(df, ["x"], ["t"], ["p"], ["id"], lambda a, b: float((a == b).mean()), kfolds=6, bins=4, xrange=[0, 4], native=False).orderBy("bin").collect()
    assert [r.med for r in mine] == pytest.approx([r.med for r in out])


def test_metric_boxes_with_default_folds_over_all_rows(spark, tmp_path):
    rows = [(i, (i * i) % 9001, i % 2, (i // 3) % 2) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, n_chars long, quality int, toxic int").select("doc_id", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.bin: r for r in QUERIES["q_metbox_default"](spark, str(tmp_path)).collect()}
    edges = np.linspace(min(r[1] for r in rows), max(r[1] for r in rows), 11)
    where = [min(int((edges <= r[1]).sum()), 10) - 1 for r in rows]
    assert sum(r.n for r in got.values()) == 300 and len(got) == 10
    for b in range(10):
        own = [r for r, w in zip(rows, where, strict=True) if w == b]
        scores = []
        for fold in range(100):
            drawn = sorted(own, key=lambda r: (hashlib.md5(f"{r[0]}:{fold}".encode()).hexdigest(), str(r[0])))[: round(len(own) / 2)]
            scores.append(np.mean([r[2] == r[3] for r in drawn]))
        assert got[b].n == len(own)
        assert [got[b].mean, got[b].q1, got[b].med, got[b].q3] == pytest.approx([np.mean(scores), *np.quantile(scores, [0.25, 0.5, 0.75])], abs=2e-6)


def frames(spark, kwargs, n=7):
    df = spark.createDataFrame([(i, float(i), 0.0) for i in range(n)], "i int, t double, p double").repartition(3)
    on = "i"
    if not isinstance(kwargs["window"], int):
        df, on = df.withColumn("ts", F.timestamp_micros(F.col("i").cast("long") * 600_000_000)), "ts"
    metrics = {"lo": lambda t, p: F.min(t), "hi": lambda t, p: F.max(t), "n": lambda t, p: F.count(t)}
    got = rolling.rolling_met(df, "t", "p", on, kwargs, metrics).orderBy(on).collect()
    return [list(range(int(r.lo), int(r.hi) + 1)) if r.lo is not None else [] for r in got]


def test_row_frames(spark):
    assert frames(spark, {"window": 4, "center": True}) == [[0, 1], [0, 1, 2], [0, 1, 2, 3], [1, 2, 3, 4], [2, 3, 4, 5], [3, 4, 5, 6], [4, 5, 6]]
    assert frames(spark, {"window": 3, "step": 2}) == [[0], [0, 1, 2], [2, 3, 4], [4, 5, 6]]
    assert frames(spark, {"window": 3, "closed": "left"})[:4] == [[], [0], [0, 1], [0, 1, 2]]
    assert frames(spark, {"window": 3, "closed": "both"})[4] == [1, 2, 3, 4]
    assert frames(spark, {"window": 1, "closed": "neither"}) == [[]] * 7


def test_time_frames(spark):
    assert frames(spark, {"window": "20min", "center": True}) == [[0, 1], [1, 2], [2, 3], [3, 4], [4, 5], [5, 6], [6]]
    assert frames(spark, {"window": "20min"})[:3] == [[0], [0, 1], [1, 2]]
    assert frames(spark, {"window": "20min", "closed": "neither"})[:4] == [[], [0], [1], [2]]


def test_rolling_equals_pandas_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(rolling, "LEAST_ROWS", 8)
    monkeypatch.setattr(rolling, "WINDOWS", 2)
    rng = np.random.default_rng(9)
    t = np.cumsum(rng.integers(1, 400, 300)) * 1_000_000
    p = pd.DataFrame({"ts": pd.to_datetime(t, unit="us"), "t": rng.random(300), "p": rng.random(300)})
    df = spark.createDataFrame(p)
    got = rolling.rolling_met(df, "t", "p", "ts", {"window": "10min", "center": True}, {"m": M.mae}).orderBy("ts").toPandas()
    want = (p.t - p.p).abs().groupby(lambda _: 0).apply(lambda s: pd.Series(s.values, index=p.ts).rolling("10min", center=True, min_periods=1).mean()).values
    assert got.m.values == pytest.approx(want.ravel())
    got = rolling.rolling_met(df, "t", "p", "ts", {"window": 5}, {"m": M.mae}).orderBy("ts").toPandas()
    assert got.m.values == pytest.approx((p.t - p.p).abs().rolling(5, min_periods=1).mean().values)


def test_rolling_defaults_and_names(spark):
    df = spark.createDataFrame([(i, i % 2, 1) for i in range(12)], "k int, t int, p int")
    assert rolling.rolling_met(df, "t", "p", "k").columns == ["Accuracy", "k"]
    assert rolling.rolling_met(df.withColumn("t", F.col("t") * 1.0), "t", "p", "k").columns == ["MSE", "k"]
    assert rolling.rolling_met(df, "t", "p", "k", roll_metric=[M.mae, M.mse]).columns == ["Metric 00", "Metric 01", "k"]
    own = rolling.rolling_met(df, "t", "p", "k", {"window": 3}, lambda a, b: float((a != b).sum()), native=False).orderBy("k").collect()
    assert [r.Metric for r in own][:4] == [1.0, 1.0, 2.0, 1.0]
    with pytest.raises(ValueError):
        rolling.rolling_met(df, "t", "p", "k", {"window": 3, "win_type": "gaussian"})
    kw = {"center": True}
    rolling.rolling_met(df, "t", "p", "k", kw)
    assert kw == {"center": True}


def test_rolling_by_group(spark):
    df = spark.createDataFrame([(i, i // 3, float(i), 0.0) for i in range(9)], "k int, g int, t double, p double")
    got = rolling.rolling_met(df, "t", "p", "k", {"window": 2}, {"n": lambda t, p: F.count(t)}, partition_by=["g"]).orderBy("k").collect()
    assert [r.n for r in got] == [1, 2, 2] * 3


def test_metrics_equal_numpy(spark):
    rng = np.random.default_rng(4)
    y, s = rng.integers(0, 2, 200), np.round(rng.random(200), 2)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "s": s, "k": rng.integers(0, 3, 200)}))
    one = df.agg(M.r2(F.col("y"), F.col("s")).alias("r2"), M.log_loss(F.col("y"), F.col("s")).alias("ll"), M.medae(F.col("y"), F.col("s")).alias("md")).first()
    c = np.clip(s, 1e-15, 1 - 1e-15)
    assert one.r2 == pytest.approx(1 - ((y - s) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert one.ll == pytest.approx(-(y * np.log(c) + (1 - y) * np.log(1 - c)).mean())
    assert one.md == pytest.approx(np.median(abs(y - s)))
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean())
    assert M.roc_auc(df, "y", "s").first().auc == pytest.approx(auc)
    k = df.toPandas().k.to_numpy()
    assert M.homogeneity(df, "y", "k").first().homogeneity == pytest.approx(M.homogeneity_score(y, k))


def test_split_and_folds(spark):
    df = spark.range(4000)
    train, test = sample.split(df, ["id"])
    assert train.count() + test.count() == 4000 and 0.27 < test.count() / 4000 < 0.33
    assert {r.fold for r in sample.folds(df, ["id"], 3).select("fold").distinct().collect()} == {0, 1, 2}


def test_training(spark):
    from pyspark.ml.regression import DecisionTreeRegressor

    df = spark.range(400).select("id", (F.col("id") % 20).alias("x"), ((F.col("id") % 20) * 2.0 + F.rand(1)).alias("y"))
    tree = DecisionTreeRegressor()
    assert ml.seeded(tree, 5)[0].getSeed() == 5 and ml.seeded(DecisionTreeRegressor(seed=9), 5)[1] == 9 and ml.seeded(DecisionTreeRegressor(seed=0), 5)[1] == 5
    model = ml.train(df, ["x"], "y", tree, ["id"], {"maxDepth": [1, 5]}, {"scoring": "r2"}, grid_ratio=None)
    assert model.depth == 5
    out = ml.predict(model, df, ["x"], "y")
    assert out.columns == ["id", "x", "y", "y_pred"] and out.agg(M.mse(F.col("y"), F.col("y_pred"))).first()[0] < 1
    found = ml.tune(tree, {"maxDepth": [1, 5]}, df, ["x"], "y", ["id"], scoring=["r2", "mse"], refit=False)
    assert len(found.rows) == 2 * 4 and found.best == 1 and len(ml.grid([{"a": [1, 2], "b": [3]}, {"a": [5]}])) == 3


def test_durations():
    assert duration("90min") == 5_400_000_000 and duration(2, "h") == duration("2h") and duration(pd.Timedelta("1s")) == 1_000_000
    with pytest.raises(ValueError):
        duration("3 parsecs")


def test_scores_have_directions_and_unknown_ones_are_refused(spark):
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.regression import DecisionTreeRegressor

    df = spark.range(300).select("id", (F.col("id") % 20).alias("x"), ((F.col("id") % 20) * 2.0 + F.rand(1)).alias("y"), (F.col("id") % 20 > 9).cast("int").alias("c"))
    best = lambda scoring, y="y", tree=None: ml.tune(tree or DecisionTreeRegressor(), {"maxDepth": [1, 5]}, df, ["x"], y, ["id"], cv=2, scoring=scoring, refit=False).best
    assert [best(s) for s in (None, "mse", "neg_mean_absolute_error", M.neg_mae)] == [1] * 4
    assert best(M.mae) == 0  # a metric of the caller's own: the more, the better
    assert best(["mse", "mae"]) == 1 and best({"a": "neg_mean_squared_error", "b": "mae"}) == 1
    with pytest.raises(ValueError, match="unknown score"):
        best("r_two")
    tree = DecisionTreeClassifier()
    assert ml.scorers(tree, None) == {"score": (M.accuracy, 1)} and ml.scorers(DecisionTreeRegressor(), None)["score"][0] is M.r2
    assert best(None, "c", tree) == 0
    undefined = ml.tune(DecisionTreeRegressor(), {"maxDepth": [1, 2]}, df.withColumn("y", F.lit(1.0)), ["x"], "y", ["id"], scoring="r2", refit=False)
    assert undefined.best == 0 and {v for _, _, v in undefined.rows} == {None}


def test_training_with_clashing_names(spark):
    from pyspark.ml.regression import LinearRegression

    names = ["id", "features", "target", "fold", "prediction", "row", "_features", "_fold", "x0"]
    df = spark.range(60).select("id", *[(F.col("id") * (k + 2) % (7 + k)).cast("double").alias(n) for k, n in enumerate(names[1:])])
    model = ml.train(df, ["features", "x0"], "target", LinearRegression(), ["id", "fold"], {"regParam": [0.0, 0.5]}, {"scoring": "mse"}, grid_ratio=None)
    out = ml.predict(model, df, ["features", "x0"], "target")
    assert out.columns == [*names, "target_pred"] and out.drop("target_pred").exceptAll(df).count() == 0


def test_rolling_with_clashing_names(spark):
    names = ["k", "rn", "on", "t", "p", "g0", "bucket", "_b", "_k"]
    df = spark.range(30).select(F.timestamp_micros(F.col("id") * 60_000_000).alias("ts"), *[(F.col("id") % (k + 2)).cast("double").alias(n) for k, n in enumerate(names)])
    got = rolling.rolling_mean(df, "k", "ts", "5min", partition_by=["g0"])
    assert got.columns == [*df.columns, "k_mean"] and got.drop("k_mean").exceptAll(df).count() == 0
    out = rolling.rolling_met(df, "t", "p", "ts", {"window": 3}, {"k": M.mae}, partition_by=["bucket", "rn"])
    assert out.columns == ["k", "ts", "bucket", "rn"] and out.count() == 30
    nulls = rolling.rolling_met(df.withColumn("bucket", F.when(F.col("bucket") > 3, F.col("bucket"))), "t", "p", "ts", {"window": 3}, {"k": M.mae}, partition_by=["bucket"])
    assert nulls.count() == 30


def test_buckets_of_dense_windows_are_short(spark):
    key = lambda n: spark.range(n).select((F.col("id") * 1000).alias("k"))
    assert rolling.bucket_length(key(100_000), "k", 50_000_000) == 50_000_000
    assert rolling.bucket_length(key(100_000), "k", 1_000_000) == 8_000_000
    assert rolling.bucket_length(key(10), "k", 1000) == 16_000 and rolling.bucket_length(key(0), "k", 10) == 160


def windows_by_hand(p, lo, hi, of, group=None):
    """What ``of`` gives for the known errors of the rows within [k + lo, k + hi] of each row; None without any."""
    out = []
    for i in range(len(p)):
        near = (p.k >= p.k[i] + lo) & (p.k <= p.k[i] + hi) & (group is None or p[group] == p[group][i])
        e = (p.t - p.p).abs()[near].dropna()
        out.append(of(e) if len(e) else None)
    return out


def test_windows_of_many_rows_are_not_summed_one_by_one(spark):
    """mean and median errors where each window has thousands of rows; evaluated window by window this took minutes."""
    rng = np.random.default_rng(3)
    n = 40_000
    p = pd.DataFrame({"k": np.sort(rng.integers(0, 3_600_000_000, n)), "t": rng.random(n).round(3), "p": rng.random(n).round(3)})
    df = spark.createDataFrame(p).select(F.timestamp_micros("k").alias("ts"), "t", "p", "k")
    start = time.perf_counter()
    got = rolling.rolling_met(df, "t", "p", "ts", {"window": "60min", "center": True}, {"mae": M.mae, "medae": M.medae}).orderBy("ts").toPandas()
    assert time.perf_counter() - start < 45 and len(got) == n
    e, k = (p.t - p.p).abs().to_numpy(), p.k.to_numpy()
    for i in range(0, n, 997):
        own = e[(k > k[i] - 1_800_000_000) & (k <= k[i] + 1_800_000_000)]
        assert [got.mae[i], got.medae[i]] == pytest.approx([own.mean(), np.median(own)])


def test_block_sums_and_quantiles_equal_brute_force():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 64, 129):
        x = rng.integers(0, 9, n) / 4
        lo, hi = rng.integers(0, n + 1, 300), rng.integers(0, n + 1, 300)
        sums, quarter, median = rolling.block_sums(x, lo, hi), rolling.block_quantiles(x, lo, hi, 0.25), rolling.block_quantiles(x, lo, hi, 0.5)
        for a, b, s, q, m in zip(lo, hi, sums, quarter, median, strict=True):
            assert (s, q, m) == (pytest.approx((x[a:b].sum(), np.quantile(x[a:b], 0.25), np.median(x[a:b]))) if a < b else (0, 0, 0))
    x = np.array([1e300, 1.0, 2.0, np.nan, 4.0, np.inf, 5.0])
    lo, hi = np.array([1, 4, 2, 4, 6]), np.array([3, 5, 5, 7, 7])
    assert rolling.block_sums(x, lo, hi) == pytest.approx([3, 4, np.nan, np.inf, 5], nan_ok=True)
    assert rolling.block_quantiles(x, lo, hi, 0.5) == pytest.approx([1.5, 4, 4, 5, 5])


def test_buckets_are_told_apart_in_batches_of_any_size(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(2)
    sizes = [3, 1, 40, 1, 1, 9, 25]
    key = np.concatenate([np.sort(rng.integers(0, 30, s)) for s in sizes])
    group, nth = np.repeat(range(len(sizes)), sizes), np.concatenate([np.arange(1, s + 1) for s in sizes])
    x, mine = np.where(rng.random(80) < 0.2, None, rng.random(80)), rng.random(80) < 0.7
    rows = pa.RecordBatch.from_pydict({"id": pa.array(range(80)), "_key": key, "_mine": mine, "_x0": pa.array(list(x), pa.float64()), "_x1": pa.array(list(x), pa.float64()), "_nth": nth})
    want = []
    for i in np.flatnonzero(mine):
        e = [v for v, k, g in zip(x, key, group, strict=True) if v is not None and g == group[i] and -4 <= k - key[i] <= 2]
        want.append((i, np.mean(e) if e else None, np.median(e) if e else None))
    for at_once, batch in ((1, 1), (1, 7), (20, 3), (1000, 80)):
        monkeypatch.setattr(rolling, "ROWS_AT_ONCE", at_once)
        parts = rolling._swept(-4, 2, [None, 0.5], ["id"])(iter([rows.slice(i, batch) for i in range(0, 80, batch)]))
        got = [tuple(r.values()) for part in parts for r in part.to_pylist()]
        assert [r[0] for r in got] == [r[0] for r in want]
        assert [v for r in got for v in r[1:]] == [v if v is None else pytest.approx(v) for r in want for v in r[1:]]


@pytest.mark.parametrize(("closed", "lo", "hi"), [("right", -299, 0), ("left", -300, -1), ("both", -300, 0), ("neither", -299, -1)])
def test_time_windows_with_gaps_groups_and_other_metrics(spark, closed, lo, hi):
    rng = np.random.default_rng(5)
    n = 150
    p = pd.DataFrame({"k": np.sort(rng.integers(0, 6000, n)), "g": rng.integers(0, 2, n), "t": rng.random(n), "p": rng.random(n)})
    p.loc[rng.random(n) < 0.3, "p"] = np.nan
    df = spark.createDataFrame(p).select(F.timestamp_micros(F.col("k") * 1_000_000).alias("ts"), "k", "g", "t", F.nanvl("p", F.lit(None).cast("double")).alias("p"))
    df = df.select("ts", "k", F.when(F.col("g") == 1, "one").alias("g"), "t", "p")
    metrics = {"mse": M.mse, "n": lambda t, q: F.count(F.abs(t - q)), "mae": M.mae, "medae": M.medae, "less": M.neg_mae}
    got = rolling.rolling_met(df, "t", "p", "ts", {"window": "5min", "closed": closed}, metrics, partition_by=["g"]).toPandas()
    assert list(got.columns) == [*metrics, "ts", "g"]
    for name, of in {"mse": lambda e: (e**2).mean(), "n": len, "mae": lambda e: e.mean(), "medae": lambda e: e.median(), "less": lambda e: -e.mean()}.items():
        want = sorted((k, g == 1, -1.0 if v is None else v) for k, g, v in zip(p.k, p.g, windows_by_hand(p, lo, hi, of, "g"), strict=True))
        own = sorted((int(ts.timestamp()), g == "one", (0.0 if name == "n" else -1.0) if pd.isna(v) else float(v)) for ts, g, v in zip(got.ts, got.g, got[name], strict=True))
        assert [r[:2] for r in own] == [r[:2] for r in want]
        assert [r[2] for r in own] == pytest.approx([max(r[2], 0.0) if name == "n" else r[2] for r in want])


def test_rolling_mean_of_many_rows_is_not_summed_one_by_one(spark):
    """150,000 rows in one window, with a value of 1e300 and a NULL among them that only their own windows see."""
    rng = np.random.default_rng(4)
    n = 150_000
    k, v = np.sort(rng.integers(0, 3_600_000_000, n)), rng.random(n).round(3)
    v[70], v[n - 1] = 1e300, np.nan
    rows = spark.createDataFrame(pd.DataFrame({"k": k, "v": v})).select(F.timestamp_micros("k").alias("ts"), "k", F.nanvl("v", F.lit(None).cast("double")).alias("v"))
    start = time.perf_counter()
    got = rolling.rolling_mean(rows, "v", "ts", "30min").orderBy("k").toPandas().v_mean
    assert time.perf_counter() - start < 60 and len(got) == n
    for i in [*range(0, 140, 10), *range(n // 2, n, 9973), n - 1]:
        own = v[(k > k[i] - 1_800_000_000) & (k <= k[i])]
        assert got[i] == pytest.approx(np.nanmean(own))


def test_rows_of_equal_time_roll_in_the_order_they_came(spark, tmp_path):
    """of rows of one time the first alone differs from its predecessor; its windows start there, whichever value is greater."""
    rng = np.random.default_rng(6)
    copies, times = 8, 60
    e = pd.DataFrame({"event_id": np.arange(copies * times), "at": np.tile(np.arange(times), copies), "value": np.tile(rng.integers(1, 500, times) / 4, copies)})
    spark.createDataFrame(e.sample(frac=1, random_state=1)).select("event_id", F.timestamp_micros(F.col("at") * 1_000_000).alias("ts"), "value").write.parquet(str(tmp_path / "events.parquet"))
    e = e.sort_values(["at", "event_id"])
    off = e.value.diff().abs().iloc[1:]
    want = off.rolling(6, min_periods=1).mean().to_numpy()
    at = e["at"].to_numpy()[1:]
    for name, step in (("q_roll_step", 4), ("q_roll_closed_both", 1)):
        own = want if step == 4 else off.rolling(7, min_periods=1).mean().to_numpy()
        got = sorted((int(r.ts.timestamp()), r.Metric) for r in QUERIES[name](spark, str(tmp_path)).collect())
        assert [v for r in got for v in r] == pytest.approx([v for r in sorted(zip(at[::step], own[::step], strict=True)) for v in r], abs=1e-6)


@pytest.mark.parametrize("name", ["q_roll_mae_medae_90m", "q_roll_mean_90m", "q_roll_time_left", "q_roll_time_neither", "q_roll_trailing", "q_roll_time_both", "q_roll_mse_60m"])
def test_queries_do_not_evaluate_windows_of_time_one_by_one(spark, name):
    """No frame of a plan is one of time; only running ones and numbers are left."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame" not in plan and "MapInArrow" in plan


def test_a_fit_has_a_bounded_number_of_rows_in_a_task(spark, monkeypatch):
    """a table in few partitions is dealt to more before it is fitted, with all its rows."""
    monkeypatch.setattr(ml, "ROWS_A_TASK", 100)
    few, many = spark.range(0, 1950, 1, 2), spark.range(0, 1950, 1, 20)
    assert ml.dealt(few).rdd.getNumPartitions() == 20 and ml.dealt(many) is many
    assert sorted(r.id for r in ml.dealt(few).collect()) == list(range(1950))
    assert max(ml.dealt(few).rdd.glom().map(len).collect()) <= 110
