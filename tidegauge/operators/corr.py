"""Feature-target correlations, overall and for overlapping subsets.

Pearson is one masked aggregate over one scan, whatever the number of subsets: partial sums on
the executors and one row in the end. Spearman ranks all combinations of feature, target and subset
together, by counts of distinct values in one ordered pass; Kendall counts pairs in sorted blocks.
A method of the user's own gets both whole columns in one worker, for that is what it asks for: they come in packed
pieces and lie in files there, which the method sees as arrays, so memory doesn't grow with the rows.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.predicates import Subset, masks
from ..plans.ranged import PID, ranged, running, settled
from ..plans.schema import as_list, numeric_columns, require, value
from .asof import commonest_gap, nearest_asof

#: Above so many aggregates the features are unpivoted instead of widening one aggregate.
WIDE = 200


def pearson(x: Column, y: Column) -> Column:
    """Pearson correlation of the rows where both are known; NULL for constants and fewer than two rows."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return r


def spearman(df: DataFrame, wanted: list[tuple[str, str, Column | None]]) -> DataFrame:
    """(combo, n, r) of each (x, y, condition): Pearson of the average ranks of the rows where both are known.

    One scan unpivots and counts the distinct pairs of all combinations, which are written; the
    distinct values of both sides of all of them are then put in order, and numbered, together.
    """
    each = []
    for k, (x, y, cond) in enumerate(wanted):
        a, b = value(df, x), value(df, y)
        both = a.isNotNull() & b.isNotNull() if cond is None else a.isNotNull() & b.isNotNull() & cond
        each.append(F.when(both, F.struct(F.lit(k).alias("combo"), a.alias("x"), b.alias("y"))))
    long = df.select(F.explode(F.array(*each)).alias("v")).where("v is not null").select("v.*")
    pairs = settled(long.groupBy("combo", "x", "y").agg(F.count("*").alias("n")))
    sides = F.explode(F.array(*[F.struct(F.lit(k).alias("side"), F.col(c).alias("v")) for k, c in enumerate("xy")])).alias("s")
    counts = pairs.select("combo", "n", sides).groupBy("combo", "s.side", "s.v").agg(F.sum("n").alias("n"))
    upto = running(ranged(counts, "combo", "side", "v"), ["combo", "side", "v"], F.col("n"), "upto")
    sizes = upto.groupBy("combo", "side").agg(F.min(F.col("upto") - F.col("n")).alias("base"), F.sum("n").alias("all"))  # two rows for each combination
    ranks = upto.join(F.broadcast(sizes), ["combo", "side"])
    # the average rank, about the ranks' mean
    ranks = ranks.select("combo", "side", "v", (F.col("upto") - F.col("base") - (F.col("n") - 1) / 2 - (F.col("all") + 1) / 2).alias("d"))
    of = lambda side, v, d: ranks.where(F.col("side") == side).select("combo", F.col("v").alias(v), F.col("d").alias(d))
    got = pairs.join(of(0, "x", "dx"), ["combo", "x"]).join(of(1, "y", "dy"), ["combo", "y"])
    total = lambda c: F.sum(F.col("n") * c)
    dx, dy = F.col("dx"), F.col("dy")
    return got.groupBy("combo").agg(F.sum("n").alias("n"), F.try_divide(total(dx * dy), F.sqrt(total(dx * dx) * total(dy * dy))).alias("r"))


def inversions(y: np.ndarray, n: np.ndarray) -> float:
    """Sum of n[i] * n[j] over the pairs i < j with y[i] > y[j].

    Ranks are split by one bit after the other, from the highest: of two ranks that have their higher bits in
    common, the one with a 1 is the greater, and each level is a stable split and a running sum.
    """
    rank = np.unique(y, return_inverse=True)[1]
    w, total = n.astype(float), 0.0
    for bit in range(int(max(rank, default=0)).bit_length() - 1, -1, -1):
        group, one = rank >> (bit + 1), (rank >> bit & 1).astype(bool)
        ones = np.cumsum(np.where(one, w, 0.0))
        start = np.flatnonzero(np.diff(group, prepend=-1))
        before = np.repeat(ones[start] - np.where(one[start], w[start], 0.0), np.diff(np.append(start, len(group))))
        total += float((w * (ones - before))[~one].sum())
        order = np.argsort(rank >> bit, kind="stable")
        rank, w = rank[order], w[order]
    return total


#: Distinct pairs in a block of Kendall's, which is worked off in one task, and blocks by blocks that one task sums up.
BLOCK_PAIRS, MOST_BLOCKS = 2_000_000, 4_000


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (n, r): tau-b of the rows where both are known.

    Distinct (x, y) pairs carry counts. They are cut into ranges of (x, y) and of (y, x), of like
    numbers of pairs, so a value that most rows share is cut too. Opposite pairs in
    one x range are counted in that range, others in one y range in that one, and all others
    from the numbers of rows in each (x range, y range). Pairs of different ranges are in the order of
    these: equal values on one side are in order of the other, which is no opposition.
    """
    both = df.select(value(df, x).alias("x"), value(df, y).alias("y")).na.drop()
    pairs = both.groupBy("x", "y").agg(F.count("*").alias("n"))
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_x = ranged(pairs, "x", "y", partitions=least).withColumnRenamed(PID, "bx")
    size = by_x.count()
    blocks = min(MOST_BLOCKS, max(least, -(-size // BLOCK_PAIRS)))
    if blocks > least:
        by_x = ranged(by_x.drop("bx"), "x", "y", partitions=blocks).withColumnRenamed(PID, "bx")
    cells = ranged(by_x, "y", "x", partitions=blocks).withColumnRenamed(PID, "by")

    def opposite(pdf: pd.DataFrame, apart: str | None) -> float:
        """Opposite pairs; with ``apart`` only those from different ones of these."""
        pdf = pdf.sort_values(["x", "y"], kind="stable")
        more = inversions(pdf["y"].to_numpy(), pdf["n"].to_numpy())
        if apart is not None:
            more -= sum(inversions(part["y"].to_numpy(), part["n"].to_numpy()) for _, part in pdf.groupby(apart, sort=False))
        return more

    count = lambda block, apart: cells.groupBy(block).applyInPandas(lambda pdf: pd.DataFrame({"d": [opposite(pdf, apart)]}), "d double")
    grid = cells.groupBy("bx", "by").agg(F.sum("n").cast("double").alias("n"))

    def far(pdf: pd.DataFrame) -> pd.DataFrame:  # at most MOST_BLOCKS by MOST_BLOCKS numbers
        m = pdf.pivot_table(index="bx", columns="by", values="n", fill_value=0.0).sort_index().sort_index(axis=1).to_numpy()
        if not m.size:
            return pd.DataFrame({"d": [0.0]})
        later = np.cumsum(m[::-1], axis=0)[::-1] - m  # rows of later x ranges
        return pd.DataFrame({"d": [float((m * (np.cumsum(later, axis=1) - later)).sum())]})

    total = count("bx", None).union(count("by", "bx")).union(grid.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(far, "d double")).agg(F.sum("d").alias("d"))
    ties = lambda c: cells.groupBy(c).agg(F.sum("n").cast("double").alias("t")).agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias(f"t{c}"))
    n = cells.agg(F.sum("n").cast("double").alias("n"), F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2).alias("txy"))
    one = total.join(F.broadcast(n)).join(F.broadcast(ties("x"))).join(F.broadcast(ties("y")))
    pairs_all = F.col("n") * (F.col("n") - 1) / 2
    up = pairs_all - F.col("tx") - F.col("ty") + F.col("txy") - 2 * F.coalesce("d", F.lit(0.0))
    return one.select(F.col("n").cast("long").alias("n"), F.try_divide(up, F.sqrt((pairs_all - F.col("tx")) * (pairs_all - F.col("ty")))).alias("r"))


def packed(x: np.ndarray) -> bytes:
    """Doubles byte by byte (the first of all, then the second ...), compressed: whole or few values take little."""
    return pa.compress(x.astype("<f8").view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(b: bytes, n: int) -> np.ndarray:
    flat = pa.decompress(b, decompressed_size=8 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(flat, np.uint8).reshape(8, n).T).view("<f8").ravel()


def own_method(df: DataFrame, wanted: list[tuple[str, str, Column | None]], method: Callable) -> DataFrame:
    """(combo, n, r) of a user's method of two arrays, over the rows where both are known; no row for a combination without such rows.

    The arrays are those of files in the worker's scratch folder (changes the method makes to them stay in memory).
    """
    columns, combos = [], len(wanted)
    for k, (f, y, cond) in enumerate(wanted):
        x, t = value(df, f), value(df, y)
        known = x.isNotNull() & t.isNotNull() & (F.lit(True) if cond is None else F.coalesce(cond, F.lit(False)))
        columns += [F.when(known, x).alias(f"x{k}"), F.when(known, t).alias(f"y{k}")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(combos):
                x, y = batch[f"x{k}"].drop_null().to_numpy(), batch[f"y{k}"].drop_null().to_numpy()
                if len(x):
                    yield pa.RecordBatch.from_pydict({"combo": pa.array([k], pa.int32()), "n": pa.array([len(x)], pa.int64()), "x": pa.array([packed(x)], pa.binary()), "y": pa.array([packed(y)], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scratch = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        with tempfile.TemporaryDirectory(prefix="tidegauge-", dir=scratch if os.path.isdir(scratch) else None) as folder:
            sizes: dict[int, int] = {}
            for batch in batches:
                for piece in batch.to_pylist():
                    for side in "xy":
                        with open(f"{folder}/{piece['combo']}{side}", "ab") as f:
                            unpacked(piece[side], piece["n"]).tofile(f)
                    sizes[piece["combo"]] = sizes.get(piece["combo"], 0) + piece["n"]
            for k, n in sizes.items():
                a, b = (np.memmap(f"{folder}/{k}{side}", dtype="<f8", mode="c", shape=(n,)).view(np.ndarray) for side in "xy")
                r = float(method(a, b)) if n > 1 else None
                yield pa.RecordBatch.from_pydict({"combo": pa.array([k], pa.int32()), "n": pa.array([n], pa.int64()), "r": pa.array([None if r is None or np.isnan(r) else r], pa.float64())})

    pieces = df.select(*columns).mapInArrow(pack, "combo int, n long, x binary, y binary")
    return pieces.repartition(combos, "combo").mapInArrow(run, "combo int, n long, r double")


def correlations(df: DataFrame, f_col: list[str], y_col: list[str], conditions: list[tuple[str, Column]], method: str | Callable = "pearson") -> DataFrame:
    """Long form: (feature, target, subset, n, r); the subset of all rows is named ``All``."""
    spark = df.sparkSession
    wanted = [(f, y, name, cond) for name, cond in [("All", None), *conditions] for f in f_col for y in y_col]
    schema = "feature string, target string, subset string, n long, r double"
    if method == "pearson" and len(wanted) <= WIDE:
        # one aggregate: (n, r) of every combination
        aggs = []
        for f, y, _, cond in wanted:
            x, t = value(df, f), value(df, y)
            if cond is not None:
                x, t = F.when(cond, x), F.when(cond, t)
            aggs += [F.count(F.when(x.isNotNull() & t.isNotNull(), 1)), pearson(x, t)]
        one = df.agg(*[a.alias(f"c{k}") for k, a in enumerate(aggs)])
        rows = [F.struct(F.lit(f).alias("feature"), F.lit(y).alias("target"), F.lit(s).alias("subset"), F.col(f"c{2 * k}").alias("n"), F.col(f"c{2 * k + 1}").cast("double").alias("r")) for k, (f, y, s, _) in enumerate(wanted)]
        return one.select(F.inline(F.array(*rows))) if rows else spark.createDataFrame([], schema)
    if method == "pearson":
        # many combinations: long layout, grouped
        out = None
        for name, cond in [("All", None), *conditions]:
            own = df if cond is None else df.where(cond)
            each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), value(df, f).alias("x")) for f in f_col])).alias("f")
            own = own.select(each, *[value(df, y).alias(f"y{k}") for k, y in enumerate(y_col)])
            own = own.groupBy("f.feature").agg(*[F.struct(F.count(F.when(F.col("f.x").isNotNull() & F.col(f"y{k}").isNotNull(), 1)).alias("n"), pearson(F.col("f.x"), F.col(f"y{k}")).alias("r")).alias(f"s{k}") for k in range(len(y_col))])
            rows = [F.struct(F.col("feature"), F.lit(y).alias("target"), F.lit(name).alias("subset"), F.col(f"s{k}.n").alias("n"), F.col(f"s{k}.r").alias("r")) for k, y in enumerate(y_col)]
            part = own.select(F.inline(F.array(*rows)))
            out = part if out is None else out.union(part)
        return out
    if not callable(method) and method not in ("spearman", "kendall"):
        raise ValueError(f"unknown method {method!r}")
    if callable(method) and not wanted:
        return spark.createDataFrame([], schema)
    if method != "kendall":
        combos = [(f, y, cond) for f, y, _, cond in wanted]
        got = own_method(df, combos, method) if callable(method) else spearman(df, combos)
        names = spark.createDataFrame([(k, f, y, name) for k, (f, y, name, _) in enumerate(wanted)], "combo int, feature string, target string, subset string")
        return F.broadcast(names).join(got, "combo", "left").select("feature", "target", "subset", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "r")
    out = None
    for f, y, name, cond in wanted:
        own = df if cond is None else df.where(cond)
        part = kendall(own, f, y).select(F.lit(f).alias("feature"), F.lit(y).alias("target"), F.lit(name).alias("subset"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), "r")
        out = part if out is None else out.union(part)
    return out


def corrwith(df: DataFrame, f_col: list[str], y_col: list[str], method: str | Callable = "pearson", numeric_only: bool = False) -> DataFrame:
    """Features by targets: a column ``feature`` and one for each target."""
    require(df, [*f_col, *y_col])
    f_col = numeric_columns(df, f_col) if numeric_only else f_col
    return _wide(correlations(df, f_col, y_col, [], method), f_col, [(y, y, "All") for y in y_col])


def _wide(long: DataFrame, f_col: list[str], columns: list[tuple[str, str, str]]) -> DataFrame:
    """Rows are features, in order; columns are (name, target, subset)."""
    order = F.create_map(*[F.lit(x) for k, f in enumerate(f_col) for x in (f, k)]) if f_col else None
    picked = [F.max(F.when((F.col("target") == t) & (F.col("subset") == s), F.col("r"))).alias(name) for name, t, s in columns]
    got = long.groupBy("feature").agg(*picked)
    return got.orderBy(order[F.col("feature")]) if f_col else got


def cor_matrix(
    f_dat: DataFrame | list[str], y_dat: DataFrame | list[str], cor_dat: DataFrame | None = None, cor_ind: str | None = None,
    cat_dat: list[Subset] | dict[str, Subset] | None = None, cor_meth: str | Callable = "pearson", numeric_only: bool = False,
) -> DataFrame:
    """Correlation matrix: one row for each feature, columns ``All`` and the subsets.

    Either names of features and targets of ``cor_dat``, or two tables that are joined to the
    nearest key ``cor_ind`` within their commonest gap.
    """
    if isinstance(f_dat, list) and isinstance(y_dat, list) and isinstance(cor_dat, DataFrame):
        df, f_col, y_col = cor_dat, f_dat, y_dat
    elif isinstance(f_dat, DataFrame) and isinstance(y_dat, DataFrame):
        if not cor_ind:
            raise ValueError("two tables need cor_ind, the key that joins them")
        gap = commonest_gap(f_dat, cor_ind)
        df = nearest_asof(f_dat, y_dat, cor_ind, tolerance=gap)
        f_col, y_col = [c for c in f_dat.columns if c != cor_ind], [c for c in y_dat.columns if c != cor_ind]
    else:
        raise TypeError("pass two lists of names and cor_dat, or two tables")
    require(df, [*as_list(f_col, "f_dat"), *as_list(y_col, "y_dat")])
    f_col = numeric_columns(df, f_col) if numeric_only else f_col
    several = len(y_col) > 1
    conditions = masks(df, cat_dat, several)
    columns = []
    for name in ["All", *[n for n, _ in conditions]]:
        columns += [(f"{name}:{y}" if several else name, y, name) for y in y_col]
    return _wide(correlations(df, f_col, y_col, conditions, cor_meth), f_col, columns)
