"""Correlations, as-of joins, lags and preparation against pandas and hand-made frames."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import asof, corr, lag, prep
from tidegauge.plans.predicates import subsets
from tidegauge.plans.ranged import PID, nearest_known, numbered, ranged, running

NAN = float("nan")


def column(df, name="All"):
    return {r["feature"]: r[name] for r in df.collect()}


def test_pairwise_deletion_and_constants(spark):
    df = spark.createDataFrame([(1.0, 1, 2.0), (2.0, 1, None), (None, 1, 3.0), (4.0, 1, 5.0)], "x double, k int, y double")
    got = column(corr.cor_matrix(["x", "k"], ["y"], df))
    assert got["x"] == pytest.approx(1.0)
    assert got["k"] is None


def test_nan_and_infinity_are_missing(spark):
    df = spark.createDataFrame([(1.0, 1.0), (NAN, 5.0), (float("inf"), 2.0), (2.0, 2.0), (3.0, 3.5)], "x double, y double")
    assert column(corr.cor_matrix(["x"], ["y"], df))["x"] == pytest.approx(np.corrcoef([1, 2, 3], [1, 2, 3.5])[0, 1])


def test_null_category_is_on_the_other_side(spark):
    rows = [(1.0, 1.0, 1), (2.0, 3.0, 1), (3.0, 2.0, 1), (1.0, 5.0, 0), (2.0, 4.0, None), (3.0, 1.0, None)]
    df = spark.createDataFrame(rows, "x double, y double, c int")
    got = corr.cor_matrix(["x"], ["y"], df, cat_dat=["c", lambda t: t.x > 1]).first()
    p = pd.DataFrame(rows, columns=["x", "y", "c"])
    assert got["c == 1"] == pytest.approx(p[p.c == 1].x.corr(p[p.c == 1].y))
    assert got["c != 1"] == pytest.approx(p[p.c != 1].x.corr(p[p.c != 1].y))
    assert got["call00"] == pytest.approx(p[p.x > 1].x.corr(p[p.x > 1].y))


def test_several_targets_name_their_columns(spark):
    df = spark.range(20).select((F.col("id") * 1.0).alias("x"), (F.col("id") % 7).alias("y"), (F.col("id") % 3).alias("z"), (F.col("id") % 2).alias("c"))
    assert corr.cor_matrix(["x"], ["y", "z"], df, cat_dat={"k": "c"}).columns == ["feature", "All:y", "All:z", "k==1:y", "k==1:z", "k!=1:y", "k!=1:z"]


@pytest.mark.parametrize("method", ["pearson", "spearman", "kendall"])
def test_methods_equal_brute_force(spark, method):
    rng = np.random.default_rng(3)
    p = pd.DataFrame({"x": rng.integers(0, 12, 150).astype(float), "y": rng.integers(0, 9, 150).astype(float)})
    p.loc[::11, "x"] = None
    own = p.dropna()
    if method == "kendall":
        dx, dy = np.sign(own.x.values[:, None] - own.x.values), np.sign(own.y.values[:, None] - own.y.values)
        want = (dx * dy).sum() / np.sqrt((dx**2).sum() * (dy**2).sum())
    else:
        want = own.rank().corr().iloc[0, 1] if method == "spearman" else own.corr().iloc[0, 1]
    df = spark.createDataFrame([(None if np.isnan(a) else a, b) for a, b in p.values.tolist()], "x double, y double").repartition(5)
    assert column(corr.corrwith(df, ["x"], ["y"], method), "y")["x"] == pytest.approx(want, abs=1e-12)


def test_wide_and_long_layouts_agree(spark, monkeypatch):
    df = spark.range(200).select((F.rand(1)).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("y"))
    cats = [lambda t: t.a > 0.5]
    one = corr.cor_matrix(["a", "b"], ["y"], df, cat_dat=cats).collect()
    monkeypatch.setattr(corr, "WIDE", 0)
    for x, y in zip(one, corr.cor_matrix(["a", "b"], ["y"], df, cat_dat=cats).collect(), strict=True):
        assert x["feature"] == y["feature"]
        assert [x["All"], x["call00"]] == pytest.approx([y["All"], y["call00"]])


def test_arguments_are_checked(spark):
    df = spark.createDataFrame([("a", 1.0)], "s string, y double")
    with pytest.raises(ValueError):
        corr.cor_matrix(["s"], ["y"], df)
    assert corr.cor_matrix(["s", "y"], ["y"], df, numeric_only=True).count() == 1
    with pytest.raises(TypeError):
        corr.cor_matrix(["s"], df)
    with pytest.raises(KeyError):
        corr.cor_matrix(["nope"], ["y"], df)
    f = lambda t: t.x
    assert subsets(["a", f, f]) == {"a": "a", "call00": f, "call01": f}


def test_asof_ties_and_tolerance(spark):
    left = spark.createDataFrame([(10,), (20,), (None,)], "t long")
    right = spark.createDataFrame([(5, 1), (5, 2), (15, 3), (15, 4), (25, 5)], "t long, v long")
    get = lambda tol: {r.t: r.v for r in asof.nearest_asof(left, right, "t", tol, seq=["v"]).collect()}
    assert get(5) == {10: 2, 20: 4, None: None}
    assert get(4) == {10: None, 20: None, None: None}


def test_asof_takes_a_null_payload_of_the_nearest_key(spark):
    left = spark.createDataFrame([(10,)], "t long")
    right = spark.createDataFrame([(9, None), (12, 7)], "t long, v long")
    assert asof.nearest_asof(left, right, "t").first().v is None


@pytest.mark.parametrize("tolerance", [None, 0, 3])
def test_asof_equals_pandas(spark, tolerance):
    rng = np.random.default_rng(5)
    a = pd.DataFrame({"t": np.sort(rng.integers(0, 400, 120)), "i": range(120)})
    b = pd.DataFrame({"t": np.sort(rng.integers(0, 400, 90)), "v": range(90)})
    want = pd.merge_asof(a, b, on="t", direction="nearest", tolerance=tolerance)
    got = asof.nearest_asof(spark.createDataFrame(a).repartition(3), spark.createDataFrame(b).repartition(3), "t", tolerance, seq=["v"]).orderBy("i").toPandas()
    assert got.v.fillna(-1).tolist() == want.v.fillna(-1).tolist()


def test_resolution_and_commonest_gap(spark):
    keys = lambda gaps: spark.createDataFrame([(int(x),) for x in np.cumsum([0, *gaps])], "t long")
    assert asof.resolution(keys([3, 3, 1, 1, 2]), "t").first()[0] == 1
    assert asof.commonest_gap(keys([5, 3, 3, 5, 1]), "t") == 5
    assert asof.resolution(keys([]), "t").first()[0] is None


def test_feat_shift(spark):
    df = spark.createDataFrame([(f"2024-01-01 00:{m:02}:00", m * 1.0) for m in range(0, 30, 5)], "s string, v double").select(F.col("s").cast("timestamp_ntz").alias("t"), "v")
    got = [tuple(r)[1:] for r in lag.feat_shift(df, "t", [5, 10], drop_na=False).orderBy("t").collect()]
    assert got == [(0, None, None), (5, 0, None), (10, 5, 0), (15, 10, 5), (20, 15, 10), (25, 20, 15)]
    assert lag.feat_shift(df, "t", [-5], drop_orig=True).columns == ["t", "v -5 min"]
    assert lag.feat_shift(df, "t").count() == 5
    with pytest.raises(TypeError):
        lag.feat_shift(df, "t", "5")


def test_interpolate(spark):
    df = spark.createDataFrame(list(enumerate([None, 1.0, None, None, 4.0, None])), "i int, v double").repartition(4)
    assert [r.v for r in lag.interpolate(df, "i", ["v"]).orderBy("i").collect()] == [None, 1, 2, 3, 4, 4]


def test_ordered_helpers_cross_partitions(spark):
    df = spark.range(500).select(((F.col("id") * 37) % 500).alias("k")).repartition(7)
    assert ranged(df, "k", partitions=6).select(PID).distinct().count() == 6
    assert ranged(df, "k").select(PID).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [(r.k, r._rn) for r in numbered(df, "k", partitions=6).orderBy("k").collect()] == [(k, k + 1) for k in range(500)]
    r = running(ranged(df, "k", partitions=6), ["k"], F.col("k"), "s")
    assert r.where("k = 499").first().s == 499 * 500 / 2
    known = F.when(F.col("k") % 190 == 7, F.struct("k"))  # some partitions have none
    for ahead, strictly in ((False, False), (False, True), (True, False), (True, True)):
        got = {r.k: r.v and r.v.k for r in nearest_known(ranged(df, "k", partitions=9), ["k"], known, "v", ahead, strictly).collect()}
        for k in range(500):
            near = [x for x in (7, 197, 387) if (x > k or not strictly and x == k if ahead else x < k or not strictly and x == k)]
            assert got[k] == ((min if ahead else max)(near) if near else None)


def test_looking_ahead_takes_linear_time(spark):
    def seconds(n):
        r = ranged(spark.range(n).select(F.xxhash64("id").alias("k"), (F.col("id") % 50).alias("v")), "k", partitions=1)
        start = time.perf_counter()
        got = nearest_known(r, ["k"], F.when(F.col("v") == 0, F.struct("k")), "a", ahead=True)
        got.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds(1000)
    few, many = min(seconds(50_000) for _ in range(2)), min(seconds(200_000) for _ in range(2))
    assert many < 6 * few + 0.3


def test_inversions_equal_all_pairs():
    rng = np.random.default_rng(6)
    for n in (0, 1, 2, 17, 200):
        y, w = rng.integers(0, max(1, n // 3), n), rng.integers(1, 5, n)
        assert corr.inversions(y, w) == sum(w[i] * w[j] for i in range(n) for j in range(i + 1, n) if y[i] > y[j])


@pytest.mark.parametrize("blocks", [2, 7])
def test_kendall_of_values_that_most_rows_share(spark, blocks, monkeypatch):
    monkeypatch.setattr(corr, "BLOCK_PAIRS", 150 // blocks)
    rng = np.random.default_rng(8)
    p = pd.DataFrame({"x": np.where(rng.random(400) < 0.7, 1.0, rng.integers(0, 4, 400)), "y": rng.integers(0, 90, 400).astype(float)})
    dx, dy = np.sign(p.x.values[:, None] - p.x.values), np.sign(p.y.values[:, None] - p.y.values)
    want = (dx * dy).sum() / np.sqrt((dx**2).sum() * (dy**2).sum())
    for a, b in (("x", "y"), ("y", "x")):
        assert column(corr.corrwith(spark.createDataFrame(p), [a], [b], "kendall"), b)[a] == pytest.approx(want, abs=1e-12)


def test_spearman_of_many_combinations_at_once(spark):
    rng = np.random.default_rng(9)
    p = pd.DataFrame({c: rng.integers(0, 30, 300).astype(float) for c in "abcd"})
    p.loc[::7, "a"] = p.loc[::5, "c"] = np.nan
    got = {r.feature: r for r in corr.cor_matrix(["a", "b"], ["c", "d"], spark.createDataFrame(p).replace(float("nan"), None), cat_dat={"some": lambda t: t.b > 10, "none": lambda t: t.b > 99}, cor_meth="spearman").collect()}
    for f in "ab":
        for y in "cd":
            for name, own in (("All", p), ("some", p[p.b > 10])):
                both = own[[f, y]].dropna()
                assert got[f][f"{name}:{y}"] == pytest.approx(both.rank().corr().iloc[0, 1], abs=1e-12)
            assert got[f][f"none:{y}"] is None


def clashing(spark):
    names = ["k", "row", "_k", "_mk", "_mp", "payload", "at", "o", "s0", "x0", "b0", "f0", "_pid", "_rn", "_t", "_wt", "_l0", "_m0"]
    return spark.range(20).select((F.col("id") * 10).alias("t"), *[(F.col("id") * (i + 1) % 7).cast("double").alias(n) for i, n in enumerate(names)])


def test_names_of_helpers_do_not_clash(spark):
    from tidegauge.operators import reshape

    df = clashing(spark)
    same = lambda out: out.select(*[f"`{c}`" for c in df.columns]).exceptAll(df).count() == 0 and out.count() == 20
    joined = asof.nearest_asof(df, df, "t", 0)
    assert joined.columns == [*df.columns, *[f"{c}_y" for c in df.columns if c != "t"]] and same(joined) and joined.where("_k <> _k_y").count() == 0
    assert same(lag.interpolate(df, "t", ["k", "_rn"]))
    moved = lag.feat_shift(df.withColumn("t", F.timestamp_micros(F.col("t") * 60_000_000)), "t", [0], drop_na=False)
    assert moved.count() == 20 and moved.where("`_t` <> `_t 0 min` or `row` <> `row 0 min`").count() == 0
    cyclic = prep.cyclic_columns(df.withColumn("m0", F.lit(5)), ["k", "_k"])
    assert set(cyclic.columns) == {*df.columns, "m0", "cos_k", "sin_k", "cos__k", "sin__k"} - {"k", "_k"}
    both = reshape.joined_on(df.withColumn("k0", F.lit(1)), df.withColumn("k1", F.lit(2)), ["t", "k"])
    assert same(both) and both.where("k0 = 1 and k1 = 2").count() == 20
    with pytest.raises(ValueError, match="labels"):
        reshape.transposed(spark.range(reshape.MOST_LABELS + 1).select("id", F.lit(1.0).alias("v")), "id", ["v"])


def test_interpolation_of_equal_times_has_one_result(spark):
    rows = [(1, 1, 0.0), (1, 2, None), (1, 3, None), (1, 4, 9.0), (0, 9, None), (2, 0, None)]
    for parts in (1, 3, 6):
        df = spark.createDataFrame(rows, "t int, s int, v double").repartition(parts)
        assert sorted((r.t, r.s, r.v) for r in lag.interpolate(df, "t", ["v"], ["s"]).collect()) == [(0, 9, None), (1, 1, 0), (1, 2, 3), (1, 3, 6), (1, 4, 9), (2, 0, 9)]
        by_rest = sorted((r.t, r.s, r.v) for r in lag.interpolate(df, "t", ["v"]).collect())
        assert by_rest == [(0, 9, None), (1, 1, 0), (1, 2, 3), (1, 3, 6), (1, 4, 9), (2, 0, 9)]


def test_create(spark):
    rows = [(1.0, 10.0, 6.0, 1.0), (2.0, 0.0, 12.0, 2.0), (3.0, -1.0, 18.0, 3.0), (NAN, 1.0, 1.0, 4.0), (5.0, float("inf"), 24.0, 5.0), (6.0, 100.0, None, 6.0), (7.0, 1000.0, 0.0, 7.0)]
    df = spark.createDataFrame(rows, "a double, b double, h double, y double")
    x, y = prep.create(df, ["a", "b"], ["y"], ["b"], ["h"])
    assert x.columns == ["a", "log10_b", "cos_h", "sin_h"] and y.columns == ["y"]
    got = sorted(tuple(r) for r in x.collect())
    assert [r[0] for r in got] == [1.0, 7.0]
    assert got[0][1:] == pytest.approx((1.0, 0.0, 1.0), abs=1e-12)
    x, _ = prep.create(df.withColumn("h", F.col("h") * 15), ["a"], ["y"], lt_col=["h"])
    assert x.where("a = 1").first().cos_h == pytest.approx(0, abs=1e-12)
    with pytest.warns(UserWarning):
        prep.log10_columns(df, ["nope"])
    with pytest.raises(TypeError):
        prep.create(df, "a", ["y"])
    with pytest.raises(ValueError):
        prep.create(df, ["a"], ["y"], log_col=["y"])


def test_lag_corr_equals_pandas(spark):
    rng = np.random.default_rng(1)
    v = rng.random(80)
    df = spark.createDataFrame([(i * 60_000_000, float(x)) for i, x in enumerate(v)], "u long, v double").select(F.timestamp_micros("u").alias("t"), "v", (F.col("v") * F.col("v")).alias("y"))
    got = {r.lag: r.r for r in lag.lag_corr(df, "y", ["v"], "t", [0, 1, 3], tolerance=0).collect()}
    p = pd.Series(v)
    for k in (0, 1, 3):
        assert got[k] == pytest.approx(p.shift(k).corr(p**2))


def test_reshaping(spark):
    from tidegauge.operators import reshape

    df = spark.createDataFrame([("x", 1.0, 2), ("y", 3.0, 4)], "l string, a double, b int")
    assert [tuple(r) for r in reshape.transposed(df, "l", ["a", "b"]).orderBy("name").collect()] == [("a", 1.0, 3.0), ("b", 2.0, 4.0)]
    joined = reshape.joined_on(df, spark.createDataFrame([("x", 9.0)], "l string, a double"), ["l"]).orderBy("l")
    assert joined.columns == ["l", "a", "b", "a_y"] and [r.a_y for r in joined.collect()] == [9.0, None]
    assert reshape.stacked({"p": df, "q": df.select("l")}).count() == 4
    assert [tuple(r) for r in reshape.limits(df, ["a"]).collect()] == [("a", 1.0, 3.0)]
    assert reshape.scaled(df, {"b": 10}).agg({"b": "sum"}).first()[0] == 60.0


def test_a_method_of_ones_own_gets_whole_columns_from_files(spark):
    """the columns lie in files, not in the worker's memory; the method may change what it gets."""
    rng = np.random.default_rng(8)
    n = 25_000
    p = pd.DataFrame({"a": rng.random(n), "b": rng.integers(0, 5, n).astype(float), "y": rng.random(n), "one": np.where(np.arange(n) == 7, 1.0, np.nan), "none": np.nan})
    p.loc[::3, "a"] = np.nan
    df = spark.createDataFrame(p).repartition(3)

    def method(x, y):
        assert isinstance(x.base, np.memmap) and isinstance(y.base, np.memmap) and len(x) == len(y)
        x.sort()
        return np.nan if x[-1] > 3.5 else float(x.mean() - 2 * y.mean() + len(x))

    got = {r.feature: r for r in corr.cor_matrix(["a", "b", "one", "none"], ["y"], df, cat_dat={"low": lambda t: t.y < 0.25, "no": lambda t: t.y > 2}, cor_meth=method).collect()}
    for name, cond in (("All", p.y < 2), ("low", p.y < 0.25)):
        own = p[cond & p.a.notna()]
        assert got["a"][name] == pytest.approx(own.a.mean() - 2 * own.y.mean() + len(own))
    assert list(got) == ["a", "b", "one", "none"] and got["a"]["no"] is None
    assert [got[f][c] for f in ("b", "one", "none") for c in ("All", "low")] == [None] * 6
    x = np.array([0.1, -0.0, 5e-324, 1.5e300, 7.0])
    assert (corr.unpacked(corr.packed(x), 5) == x).all()
