"""The query catalogue: one entry for each operator, with DuckDB SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..operators import asof, box, corr, lag, ml, prep, reshape, rolling, sample
from ..sources import tables
from . import schema
from .ranged import nearest_known, ranged

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

FEATURES = ["l_quantity", "l_discount", "l_tax"]
PRICE = "l_extendedprice"
#: Unique at every scale.
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
LINE_HASH = "concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, epoch_us(l_shipdate), cast(round(l_extendedprice * 100) AS BIGINT))"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return tables.read(spark, f"{d}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(schema.col(c), digits).alias(c) if t in ("double", "float") else schema.col(c) for c, t in df.dtypes])


def step(digits: int) -> float:
    """What is added before rounding where values of whole cents end in ties that two engines may round apart."""
    return 10.0 ** -(digits + 4)


def r_sql(x: str, y: str, cond: str = "TRUE") -> str:
    """Correlation rounded, undefined as NULL."""
    return f"(SELECT CASE WHEN isnan(r) THEN NULL ELSE round(r, 6) END FROM (SELECT corr({x}, {y}) FILTER (WHERE {cond}) AS r FROM t))"


def matrix_sql(source: str, features: list[str], columns: list[tuple[str, str, str]]) -> str:
    """UNION ALL of one row for each feature; columns are (name, target, condition)."""
    rows = [f"SELECT '{f}' AS feature, " + ", ".join(f'{r_sql(f, y, c)} AS "{n}"' for n, y, c in columns) for f in features]
    return f"WITH t AS ({source}) " + " UNION ALL ".join(rows)


@query("q_corr_all", matrix_sql("SELECT * FROM lineitem", FEATURES, [("All", PRICE, "TRUE")]))
def _(spark, d):
    return rounded(corr.cor_matrix(FEATURES, [PRICE], read(spark, d, "lineitem")))


@query("q_corr_multi", matrix_sql("SELECT * FROM lineitem", ["l_discount", "l_tax"], [("All:l_extendedprice", PRICE, "TRUE"), ("All:l_quantity", "l_quantity", "TRUE")]))
def _(spark, d):
    return rounded(corr.cor_matrix(["l_discount", "l_tax"], [PRICE, "l_quantity"], read(spark, d, "lineitem")))


LABELLED = "SELECT d.n_chars, l.quality, l.toxic, d.doc_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id"


def labelled(spark, d):
    return read(spark, d, "documents").select("doc_id", "n_chars").join(read(spark, d, "labels"), "doc_id")


@query("q_corr_cat", matrix_sql(LABELLED, ["n_chars"], [("All", "quality", "TRUE"), ("toxic == 1", "quality", "coalesce(toxic = 1, FALSE)"), ("toxic != 1", "quality", "NOT coalesce(toxic = 1, FALSE)")]))
def _(spark, d):
    return rounded(corr.cor_matrix(["n_chars"], ["quality"], labelled(spark, d), cat_dat=["toxic"]))


@query("q_corr_pred", matrix_sql("SELECT * FROM lineitem", FEATURES, [("All", PRICE, "TRUE"), ("call00", PRICE, "l_quantity > 25"), ("call01", PRICE, "l_linestatus = 'O'"), ("open", PRICE, "l_returnflag = 'N'")]).replace("call00", "many").replace("call01", "status_o"))
def _(spark, d):
    cats = {"many": lambda t: t.l_quantity > 25, "status_o": lambda t: t.l_linestatus == "O", "open": lambda t: t.l_returnflag == "N"}
    return rounded(corr.cor_matrix(FEATURES, [PRICE], read(spark, d, "lineitem"), cat_dat=cats))


@query("q_corr_calls", matrix_sql("SELECT *, (l_linestatus = 'O')::INT AS o FROM lineitem", ["l_quantity"], [(f"{n}:{y}", y, c) for n, c in (("All", "TRUE"), ("call00", "l_quantity > 25"), ("o==1", "o = 1"), ("o!=1", "o <> 1"), ("call01", "l_tax < 0.03")) for y in (PRICE, "l_discount")]))
def _(spark, d):
    df = read(spark, d, "lineitem").withColumn("o", (F.col("l_linestatus") == "O").cast("int"))
    return rounded(corr.cor_matrix(["l_quantity"], [PRICE, "l_discount"], df, cat_dat=[lambda t: t.l_quantity > 25, "o", lambda t: t.l_tax < 0.03]))


NULLED = "SELECT *, nullif(l_linenumber, 3) AS a, CASE WHEN l_quantity > 40 THEN NULL ELSE l_discount END AS b FROM lineitem"


def nulled(spark, d):
    return read(spark, d, "lineitem").withColumns({"a": F.nullif("l_linenumber", F.lit(3)), "b": F.when(~(F.col("l_quantity") > 40), F.col("l_discount"))})


@query("q_corr_nulls", matrix_sql(NULLED, ["a", "b", "l_tax"], [("All:l_extendedprice", PRICE, "TRUE"), ("All:b", "b", "TRUE"), ("some:l_extendedprice", PRICE, "coalesce(a > 2, FALSE)"), ("some:b", "b", "coalesce(a > 2, FALSE)")]))
def _(spark, d):
    return rounded(corr.cor_matrix(["a", "b", "l_tax"], [PRICE, "b"], nulled(spark, d), cat_dat={"some": lambda t: t.a > 2}))


@query("q_corr_const", "SELECT 'one' AS feature, CAST(NULL AS DOUBLE) AS \"All\"")
def _(spark, d):
    return corr.cor_matrix(["one"], ["p_retailprice"], read(spark, d, "part").withColumn("one", F.lit(1)))


def spearman_sql(table: str, x: str, y: str) -> str:
    rank = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
    return f"SELECT '{x}' AS feature, round(corr(rx, ry), 6) AS \"All\" FROM (SELECT {rank(x)} AS rx, {rank(y)} AS ry FROM {table} WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"


@query("q_corr_spearman", spearman_sql("part", "p_size", "p_retailprice") + " UNION ALL " + spearman_sql("part", "p_partkey", "p_retailprice"))
def _(spark, d):
    return rounded(corr.cor_matrix(["p_size", "p_partkey"], ["p_retailprice"], read(spark, d, "part"), cor_meth="spearman"))


@query("q_corr_spearman_cat", " UNION ALL ".join(f"SELECT * FROM ({spearman_sql('part', x, 'p_retailprice')}) JOIN (SELECT \"All\" AS \"large\" FROM ({spearman_sql('(SELECT * FROM part WHERE p_size > 25)', x, 'p_retailprice')})) ON TRUE" for x in ("p_size", "p_partkey")))
def _(spark, d):
    return rounded(corr.cor_matrix(["p_size", "p_partkey"], ["p_retailprice"], read(spark, d, "part"), cat_dat={"large": lambda t: t.p_size > 25}, cor_meth="spearman"))


@query("q_corr_kendall", """
    WITH p AS (SELECT p_size AS x, p_retailprice AS y FROM part WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL),
    s AS (SELECT sum(sign(a.x - b.x) * sign(a.y - b.y)) / 2.0 AS c, sum((a.x = b.x)::INT) AS tx, sum((a.y = b.y)::INT) AS ty, count(*) AS nn FROM p a, p b),
    n AS (SELECT count(*) AS n FROM p)
    SELECT 'p_size' AS feature, round(c / sqrt(((nn - tx) / 2.0) * ((nn - ty) / 2.0)), 6) AS "All" FROM s, n""")
def _(spark, d):
    return rounded(corr.cor_matrix(["p_size"], ["p_retailprice"], read(spark, d, "part"), cor_meth="kendall"))


@query("q_corr_callable", "SELECT 'l_quantity' AS feature, round(avg(l_quantity) - avg(l_extendedprice), 2) AS \"All\" FROM lineitem")
def _(spark, d):
    return rounded(corr.cor_matrix(["l_quantity"], [PRICE], read(spark, d, "lineitem"), cor_meth=lambda a, b: a.mean() - b.mean()), 2)


@query("q_numeric_only", matrix_sql("SELECT * FROM part", ["p_partkey", "p_size"], [("All", "p_retailprice", "TRUE")]))
def _(spark, d):
    return rounded(corr.cor_matrix(["p_partkey", "p_name", "p_brand", "p_size"], ["p_retailprice"], read(spark, d, "part"), numeric_only=True))


# An hourly series of the mean event value; empty hours are NULL.
HOURLY_SQL = """
    hours AS (SELECT unnest(generate_series((SELECT date_trunc('hour', min(ts)) FROM events), (SELECT max(ts) FROM events), INTERVAL 1 HOUR)) AS t),
    h AS (SELECT hours.t, v.value, v.n FROM hours LEFT JOIN (SELECT date_trunc('hour', ts) AS t, avg(value) AS value, count(*)::DOUBLE AS n FROM events GROUP BY 1) v ON hours.t = v.t)"""


def hourly(spark, d):
    e = read(spark, d, "events").select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("t"), "ts", "value")
    grid = e.agg(F.min("t").alias("a"), F.max("ts").alias("b")).select(F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias("t"))
    return grid.join(e.groupBy("t").agg(F.avg("value").alias("value"), F.count("*").cast("double").alias("n")), "t", "left")


@query("q_resolution", f"WITH {HOURLY_SQL}, g AS (SELECT epoch_us(t) - lag(epoch_us(t)) OVER (ORDER BY t) AS gap FROM h), c AS (SELECT gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1) SELECT gap AS resolution FROM c ORDER BY n DESC, gap LIMIT 1")
def _(spark, d):
    return asof.resolution(hourly(spark, d), "t")


ASOF_SQL = """
    WITH l AS (SELECT event_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT ts, value FROM events WHERE event_type = 'view'),
    b AS (SELECT l.event_id, l.ts, r.ts AS bt, r.value AS bv FROM l ASOF LEFT JOIN r ON l.ts >= r.ts),
    f AS (SELECT l.event_id, r.ts AS ft, r.value AS fv FROM l ASOF LEFT JOIN r ON l.ts <= r.ts),
    m AS (SELECT b.event_id, CASE WHEN ft IS NULL OR epoch_us(ts) - epoch_us(bt) <= epoch_us(ft) - epoch_us(ts) THEN bv ELSE fv END AS value,
                 least(coalesce(epoch_us(ts) - epoch_us(bt), 1e18), coalesce(epoch_us(ft) - epoch_us(ts), 1e18)) AS away FROM b JOIN f USING (event_id))
    SELECT event_id, CASE WHEN away <= {tol} THEN round(value, 6) END AS value FROM m"""


def _asof(spark, d, tolerance):
    e = read(spark, d, "events")
    left, right = e.where("event_type = 'purchase'").select("event_id", "ts"), e.where("event_type = 'view'").select("ts", "value")
    return rounded(asof.nearest_asof(left, right, "ts", tolerance).select("event_id", "value"))


@query("q_asof_nearest", ASOF_SQL.format(tol=600_000_000))
def _(spark, d):
    return _asof(spark, d, schema.duration("10min"))


@query("q_asof_unbounded", ASOF_SQL.format(tol="2e18"))
def _(spark, d):
    return _asof(spark, d, None)


def shift_sql(periods: list[int], orig: bool, drop: bool) -> str:
    cols = [f'round(s{i}.{c}, 6) AS "{c} {p} min"' for i, p in enumerate(periods) for c in ("value", "n")]
    names = [f's{i}.{c}' for i in range(len(periods)) for c in ("value", "n")] + ["h.value", "h.n"] * orig
    joins = " ".join(f"LEFT JOIN h s{i} ON s{i}.t = h.t - INTERVAL '{p} minutes'" for i, p in enumerate(periods))
    where = " WHERE " + " AND ".join(f"{n} IS NOT NULL" for n in names) if drop else ""
    own = "round(h.value, 6) AS value, round(h.n, 6) AS n, " if orig else ""
    return f"WITH {HOURLY_SQL} SELECT h.t, {own}{', '.join(cols)} FROM h {joins}{where}"


for _name, _periods, _orig, _drop in (("q_shift", [60, 120, 180], True, False), ("q_shift_neg", [-60, 120], True, False), ("q_shift_dropna", [60, 180], True, True), ("q_shift_droporig", [60], False, True)):

    @query(_name, shift_sql(_periods, _orig, _drop))
    def _(spark, d, p=_periods, o=_orig, n=_drop):
        return rounded(lag.feat_shift(hourly(spark, d), "t", p, drop_orig=not o, drop_na=n))


FIVE_SQL = "f AS (SELECT to_timestamp(floor(epoch(ts) / 300) * 300)::TIMESTAMP AS t, avg(value) AS value FROM events GROUP BY 1)"


@query("q_shift_default", f"WITH {FIVE_SQL} SELECT f.t, round(f.value, 6) AS value, round(s.value, 6) AS \"value 5 min\" FROM f JOIN f s ON s.t = f.t - INTERVAL 5 MINUTE")
def _(spark, d):
    t = F.timestamp_seconds(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 300) * 300).cast("timestamp_ntz")
    five = read(spark, d, "events").groupBy(t.alias("t")).agg(F.avg("value").alias("value"))
    return rounded(lag.feat_shift(five, "t"))


GAPPY_SQL = f"{HOURLY_SQL}, g AS (SELECT t, CASE WHEN hour(t) % 3 <> 1 THEN value END AS value, row_number() OVER (ORDER BY t) AS rn FROM h)"


@query("q_interpolate", f"""
    WITH {GAPPY_SQL}, k AS (SELECT *, max(CASE WHEN value IS NOT NULL THEN rn END) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b,
        min(CASE WHEN value IS NOT NULL THEN rn END) OVER (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f FROM g)
    SELECT k.t, round(CASE WHEN k.b IS NULL THEN NULL WHEN k.f IS NULL OR k.f = k.b THEN x.value ELSE x.value + (y.value - x.value) * (k.rn - k.b) / (k.f - k.b) END, 6) AS value
    FROM k LEFT JOIN g x ON x.rn = k.b LEFT JOIN g y ON y.rn = k.f""")
def _(spark, d):
    g = hourly(spark, d).select("t", F.when(F.hour("t") % 3 != 1, F.col("value")).alias("value"))
    return rounded(lag.interpolate(g, "t", ["value"]))


@query("q_lag_corr", f"""
    WITH {HOURLY_SQL}, p AS (SELECT unnest([0, 60, 120, 180, 240, 300, 360]) AS lag),
    j AS (SELECT p.lag, h.value AS y, s.value, s.n FROM h CROSS JOIN p LEFT JOIN h s ON s.t = h.t - p.lag * INTERVAL 1 MINUTE)
    SELECT 'n' AS feature, lag, count(*) FILTER (WHERE y IS NOT NULL AND n IS NOT NULL) AS n, round(corr(n, y), 6) AS r FROM j GROUP BY lag
    UNION ALL SELECT 'value', lag, count(*) FILTER (WHERE y IS NOT NULL AND value IS NOT NULL), round(corr(value, y), 6) FROM j GROUP BY lag""")
def _(spark, d):
    return rounded(lag.lag_corr(hourly(spark, d), "value", ["value", "n"], "t", list(range(0, 361, 60))))


@query("q_lag_matrix", f"""
    WITH {HOURLY_SQL}, p AS (SELECT unnest([0, 60, 120]) AS lag), j AS (SELECT p.lag, h.value AS y, s.n FROM h CROSS JOIN p LEFT JOIN h s ON s.t = h.t - p.lag * INTERVAL 1 MINUTE),
    c AS (SELECT lag, round(corr(n, y), 6) AS r FROM j GROUP BY lag)
    SELECT 'n' AS feature, max(r) FILTER (WHERE lag = 0) AS "0 min", max(r) FILTER (WHERE lag = 60) AS "60 min", max(r) FILTER (WHERE lag = 120) AS "120 min" FROM c""")
def _(spark, d):
    lags = [0, 60, 120]
    return lag.lag_matrix(rounded(lag.lag_corr(hourly(spark, d), "value", ["n"], "t", lags)), lags)


@query("q_corr_frames", f"""
    WITH {HOURLY_SQL}, y AS (SELECT date_trunc('hour', ts) AS t, avg(value) AS target FROM events WHERE event_type = 'purchase' GROUP BY 1),
    b AS (SELECT h.t, h.n, y.t AS bt, y.target AS bv FROM h ASOF LEFT JOIN y ON h.t >= y.t), f AS (SELECT h.t, y.t AS ft, y.target AS fv FROM h ASOF LEFT JOIN y ON h.t <= y.t),
    m AS (SELECT b.n, CASE WHEN ft IS NULL OR b.t - bt <= ft - b.t THEN CASE WHEN b.t - bt <= INTERVAL 1 HOUR THEN bv END ELSE CASE WHEN ft - b.t <= INTERVAL 1 HOUR THEN fv END END AS target FROM b JOIN f ON b.t = f.t)
    SELECT 'n' AS feature, round(corr(n, target), 6) AS "All" FROM m""")
def _(spark, d):
    h = hourly(spark, d)
    e = read(spark, d, "events").where("event_type = 'purchase'")
    y = e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("t")).agg(F.avg("value").alias("target"))
    return rounded(corr.cor_matrix(h.select("t", "n"), y, cor_ind="t"))


KEY_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def _cyclic_sql(x: str, period: str) -> str:
    return f"round(cos({x} * 2 * pi() / {period}), 6) AS cos_a, round(sin({x} * 2 * pi() / {period}), 6) AS sin_a"


@query("q_create", f"SELECT {KEY_SQL}, l_quantity, round(log10(l_tax), 6) AS log10_l_tax, {_cyclic_sql('l_linenumber', '24.0')}, round(l_extendedprice, 2) AS l_extendedprice FROM lineitem WHERE l_tax > 0")
def _(spark, d):
    df = read(spark, d, "lineitem").withColumn("a", F.col("l_linenumber"))
    return rounded(prep.prepared(df, ["l_quantity", "l_tax"], [PRICE], ["l_tax"], ["a"], key=KEY_SQL.split(", ")))


@query("q_create_nulls", f"SELECT {KEY_SQL}, l_quantity, round(log10(a), 6) AS log10_a, {_cyclic_sql('l_discount * 100', '24.0').replace('_a', '_h')}, round(l_extendedprice, 2) AS l_extendedprice FROM ({NULLED}) WHERE a IS NOT NULL AND b IS NOT NULL AND a > 0")
def _(spark, d):
    df = nulled(spark, d).withColumn("h", F.col("b") * 100)
    return rounded(prep.prepared(df, ["l_quantity", "a"], [PRICE], ["a"], ["h"], key=KEY_SQL.split(", ")))


@query("q_create_tcol", f"SELECT {KEY_SQL}, l_quantity, l_shipdate, l_returnflag FROM lineitem")
def _(spark, d):
    x, _ = prep.create(read(spark, d, "lineitem"), ["l_quantity"], [PRICE], t_col=["l_shipdate", "l_returnflag"], key=KEY_SQL.split(", "))
    return x


@query("q_create_360", f"SELECT {KEY_SQL}, l_quantity, {_cyclic_sql('l_linenumber * 51.0', '360.0')} FROM lineitem")
def _(spark, d):
    df = read(spark, d, "lineitem").withColumn("a", F.col("l_linenumber") * 51.0)
    x, _ = prep.create(df, ["l_quantity"], [PRICE], lt_col=["a"], key=KEY_SQL.split(", "))
    return rounded(x)


def box_sql(x: str, edges: str, whisker: float, y: str = PRICE, name: str | None = None, source: str = "lineitem") -> str:
    """Bins from a list of edges; the statistics are those of the exact quantiles."""
    return f"""(WITH src AS (SELECT {x} AS x, {y} AS y FROM {source}), lim AS (SELECT min(x) AS lo, max(x) AS hi FROM src), ed AS (SELECT {edges} AS e FROM lim),
    b AS (SELECT unnest(range(len(e) - 1)) AS bin, e FROM ed), bins AS (SELECT bin::INT AS bin, e[bin + 1] AS x_lo, e[bin + 2] AS x_hi, e[2] - e[1] AS x_width FROM b),
    r AS (SELECT least(len(list_filter(e, lambda v: v <= x)), len(e) - 1)::INT - 1 AS bin, y FROM src, ed WHERE x >= e[1] AND x <= e[len(e)]),
    s AS (SELECT bin, count(y) AS n, avg(y) AS mean, quantile_cont(y, 0.5) AS med, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM r GROUP BY bin)
    SELECT '{name or x}' AS x_col, bins.bin, round(x_lo, 6) AS x_lo, round(x_hi, 6) AS x_hi, round((x_lo + x_hi) / 2, 6) AS x_centre, round(x_width, 6) AS x_width, coalesce(n, 0) AS n,
           round(mean + 1e-6, 2) AS mean, round(med + 1e-6, 2) AS med, round(q1 + 1e-6, 2) AS q1, round(q3 + 1e-6, 2) AS q3,
           round(q1 - {whisker} * (q3 - q1) + 1e-6, 2) AS whislo, round(q3 + {whisker} * (q3 - q1) + 1e-6, 2) AS whishi
    FROM bins LEFT JOIN s ON bins.bin = s.bin)"""


def width_sql(n: int, lo: str = "lo", hi: str = "hi") -> str:
    return f"list_append([{lo}::DOUBLE + k * ({hi}::DOUBLE - {lo}::DOUBLE) / {n} FOR k IN range({n})], {hi}::DOUBLE)"


def boxed(df: DataFrame, digits: int = 2, n_zero: int = 0) -> DataFrame:
    edge = ("x_lo", "x_hi", "x_centre", "x_width")
    return df.select(*[(F.round(c, 6) if c in edge else F.round(F.col(c) + F.when(F.col("n") > n_zero, step(digits)).otherwise(0.0), digits)).alias(c) if t == "double" else c for c, t in df.dtypes])


def _box(name: str, x: list[str], sql: str, **kw: object) -> None:
    @query(name, sql)
    def _(spark, d):
        return boxed(box.boxplot_vx(read(spark, d, "lineitem"), x, [PRICE], **kw))


_box("q_box_default", ["l_quantity"], box_sql("l_quantity", width_sql(10), 1.5))
_box("q_box_range", ["l_quantity"], box_sql("l_quantity", width_sql(20, "0", "40"), 1.5), bins=20, xrange=[0, 40])
_box("q_box_edges", ["l_quantity"], box_sql("l_quantity", "[1.0, 5.0, 12.5, 50.0]::DOUBLE[]", 1.5), bins=[[1.0, 5.0, 12.5, 50.0]])
_box("q_box_whisker0", ["l_discount"], box_sql("l_discount", width_sql(5), 0.0), bins=5, whisker=0.0)
_box("q_box_multi_x", ["l_quantity", "l_discount"], box_sql("l_quantity", width_sql(10), 1.5) + " UNION ALL " + box_sql("l_discount", width_sql(5), 1.5), bins=[10, 5])
_box("q_box_empty", ["l_quantity"], box_sql("l_quantity", width_sql(6, "40", "100"), 1.5), bins=6, xrange=[40, 100])


def metbox_sql(source: str, x: str, yt: str, yp: str, key: str, metric: str, n_bins: int, lo: float, hi: float, folds: int, frac: float, digits: int) -> str:
    return f"""WITH src AS (SELECT {x} AS x, {yt} AS t, {yp} AS p, {key} AS k FROM {source}), ed AS (SELECT {width_sql(n_bins, str(lo), str(hi))} AS e),
    b AS (SELECT unnest(range({n_bins})) AS bin, e FROM ed), bins AS (SELECT bin::INT AS bin, e[bin + 1] AS x_lo, e[bin + 2] AS x_hi, e[2] - e[1] AS x_width FROM b),
    r AS (SELECT least(len(list_filter(e, lambda v: v <= x)), {n_bins})::INT - 1 AS bin, t, p, k FROM src, ed WHERE x >= e[1] AND x <= e[len(e)]),
    c AS (SELECT bin, count(*) AS n, round_even({frac} * count(*), 0) AS take FROM r GROUP BY bin),
    f AS (SELECT r.bin, fold, t, p, c.take, row_number() OVER (PARTITION BY r.bin, fold ORDER BY md5(concat_ws(':', k, fold)), k) AS rn FROM r JOIN c ON r.bin = c.bin CROSS JOIN range({folds}) z(fold)),
    m AS (SELECT bin, fold, {metric} AS score FROM f WHERE rn <= take GROUP BY bin, fold),
    s AS (SELECT bin, avg(score) AS mean, quantile_cont(score, 0.5) AS med, quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.75) AS q3 FROM m GROUP BY bin),
    a AS (SELECT '{x}' AS x_col, bins.bin, x_lo, x_hi, x_width, coalesce(n, 0) AS n, mean, med, q1, q3 FROM bins LEFT JOIN c ON bins.bin = c.bin LEFT JOIN s ON bins.bin = s.bin)
    SELECT x_col, bin, round(x_lo, 6) AS x_lo, round(x_hi, 6) AS x_hi, round((x_lo + x_hi) / 2, 6) AS x_centre, round(x_width, 6) AS x_width, n,
    """ + ", ".join(f"CASE WHEN n <= 1 THEN 0.0 ELSE round({e} + {step(digits)}, {digits}) END AS {c}" for c, e in (("mean", "mean"), ("med", "med"), ("q1", "q1"), ("q3", "q3"), ("whislo", "q1 - 1.5 * (q3 - q1)"), ("whishi", "q3 + 1.5 * (q3 - q1)"))) + " FROM a"


def _metbox(name: str, metric: object, sql: str, bins: int = 5, folds: int = 5, xrange: tuple = (0, 50), digits: int = 2) -> None:
    @query(name, metbox_sql("(SELECT *, l_quantity * 1000 AS yp FROM lineitem)", "l_quantity", PRICE, "yp", LINE_HASH, sql, bins, xrange[0], xrange[1], folds, 0.5, digits))
    def _(spark, d):
        df = read(spark, d, "lineitem").withColumn("yp", F.col("l_quantity") * 1000.0)
        return boxed(box.boxplot_metvx(df, ["l_quantity"], [PRICE], ["yp"], LINE_KEY, metric, kfolds=folds, bins=bins, xrange=list(xrange)), digits, 1)


_metbox("q_metbox_mse", lambda t, p: F.sqrt(M.mse(t, p)), "sqrt(avg((t - p) * (t - p)))")
_metbox("q_metbox_medae", M.medae, "quantile_cont(abs(t - p), 0.5)", bins=4, folds=4)


@query("q_metbox_acc", metbox_sql(f"({LABELLED})", "n_chars", "quality", "toxic", "doc_id", "avg((t = p)::INT)", 6, 0, 12000, 10, 0.5, 6))
def _(spark, d):
    return boxed(box.boxplot_metvx(labelled(spark, d), ["n_chars"], ["quality"], ["toxic"], ["doc_id"], kfolds=10, bins=6, xrange=[0, 12000]), 6, 1)


@query("q_metbox_sparse", metbox_sql(f"({LABELLED})", "n_chars", "quality", "toxic", "doc_id", "avg((t = p)::INT)", 8, 30000, 400000, 10, 0.5, 6))
def _(spark, d):
    return boxed(box.boxplot_metvx(labelled(spark, d), ["n_chars"], ["quality"], ["toxic"], ["doc_id"], kfolds=10, bins=8, xrange=[30000, 400000]), 6, 1)


@query("q_metbox_callable", metbox_sql(f"({LABELLED})", "n_chars", "quality", "toxic", "doc_id", "max(abs(t - p))::DOUBLE + count(*)", 6, 0, 12000, 4, 0.5, 6))
def _(spark, d):
    own = lambda t, p: float(abs(t - p).max() + len(t))
    return boxed(box.boxplot_metvx(labelled(spark, d), ["n_chars"], ["quality"], ["toxic"], ["doc_id"], own, kfolds=4, bins=6, xrange=[0, 12000], native=False), 6, 1)


@query("q_metbox_default")
def _(spark, d):
    return boxed(box.boxplot_metvx(labelled(spark, d), ["n_chars"], ["quality"], ["toxic"], ["doc_id"]), 6, 1)


PRED_SQL = "p AS (SELECT ts, value AS y_true, lag(value) OVER (ORDER BY ts) AS y_pred FROM events), q AS (SELECT * FROM p WHERE y_pred IS NOT NULL)"


def predicted(spark, d):
    """Events with the value before as the prediction; of one time in order of ``event_id``, which their windows keep."""
    e = read(spark, d, "events").select("ts", "event_id", F.col("value").alias("y_true")).withColumn("_o", F.unix_micros(F.col("ts").cast("timestamp")))
    r = nearest_known(ranged(e, "_o", "event_id"), ["_o", "event_id"], F.struct("y_true"), "_p", strictly=True)
    return r.select("ts", "event_id", "y_true", F.col("_p.y_true").alias("y_pred")).where("y_pred IS NOT NULL")


MAE_SQL, MSE_SQL = "round(avg(abs(y_true - y_pred)) OVER w + 1e-10, 6)", "round(avg((y_true - y_pred) * (y_true - y_pred)) OVER w + 1e-8, 4)"
MED_SQL = "round(quantile_cont(abs(y_true - y_pred), 0.5) OVER w + 1e-10, 6)"


def _roll(name: str, frame: str, cols: dict[str, str], kwargs: dict | None, metric: object, digits: int = 6, every: int | None = None) -> None:
    picked = ", ".join(f'{e} AS "{n}"' for n, e in cols.items())
    inner = f"WITH {PRED_SQL}, o AS (SELECT {picked}, ts, row_number() OVER (ORDER BY ts) AS rn FROM q WINDOW w AS (ORDER BY ts {frame}))"
    names = ", ".join(f'"{n}"' for n in cols)

    @query(name, f"{inner} SELECT {names}, ts FROM o" + (f" WHERE (rn - 1) % {every} = 0" if every else ""))
    def _(spark, d):
        out = rolling.rolling_met(predicted(spark, d), on="ts", roll_kwargs=kwargs, roll_metric=metric, ties=["event_id"])
        return rounded(out.select(*[(schema.col(c) + step(digits)).alias(c) for c in cols], "ts"), digits)


def range_sql(lo: int, hi: int) -> str:
    return f"RANGE BETWEEN INTERVAL {lo} MICROSECONDS PRECEDING AND INTERVAL {hi} MICROSECONDS {'FOLLOWING' if hi >= 0 else 'PRECEDING'}"


_roll("q_roll_mse_60m", range_sql(1_799_999_999, 1_800_000_000), {"MSE": MSE_SQL}, None, None, 4)
_roll("q_roll_mae_medae_90m", range_sql(2_699_999_999, 2_700_000_000), {"MAE": MAE_SQL, "MedAE": MED_SQL}, {"window": "90min", "center": True}, {"MAE": M.mae, "MedAE": M.medae})
_roll("q_roll_trailing", range_sql(5_399_999_999, 0), {"Metric 00": MAE_SQL, "Metric 01": MED_SQL}, {"window": "90min"}, [M.mae, M.medae])
_roll("q_roll_rows_10", "ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING", {"Metric": MAE_SQL}, {"window": 10, "center": True}, M.mae)
_roll("q_roll_rows_11", "ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING", {"Metric": MED_SQL}, {"window": 11, "center": True}, M.medae)
_roll("q_roll_step", "ROWS BETWEEN 5 PRECEDING AND CURRENT ROW", {"Metric": MAE_SQL}, {"window": 6, "step": 4}, M.mae, every=4)
_roll("q_roll_closed_left", "ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING", {"Metric": MAE_SQL}, {"window": 6, "closed": "left"}, M.mae)
_roll("q_roll_closed_both", "ROWS BETWEEN 6 PRECEDING AND CURRENT ROW", {"Metric": MAE_SQL}, {"window": 6, "closed": "both"}, M.mae)
_roll("q_roll_closed_neither", "ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING", {"Metric": MAE_SQL}, {"window": 6, "closed": "neither"}, M.mae)


for _closed, _from, _to in (("left", "5400000000 MICROSECONDS PRECEDING", "1 MICROSECOND PRECEDING"), ("both", "5400000000 MICROSECONDS PRECEDING", "0 MICROSECONDS FOLLOWING"), ("neither", "5399999999 MICROSECONDS PRECEDING", "1 MICROSECOND PRECEDING")):
    _roll(f"q_roll_time_{_closed}", f"RANGE BETWEEN INTERVAL {_from} AND INTERVAL {_to}", {"Metric": MAE_SQL}, {"window": "90min", "closed": _closed}, M.mae)


@query("q_roll_callable", "SELECT max(abs(quality - toxic) + doc_id % 7 * 0) OVER w + count(*) OVER w::DOUBLE AS \"Metric\", doc_id FROM labels WINDOW w AS (ORDER BY doc_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def _(spark, d):
    own = lambda t, p: float(abs(t - p).max() + len(t))
    return rolling.rolling_met(read(spark, d, "labels"), "quality", "toxic", "doc_id", {"window": 5}, own, native=False)


@query("q_roll_acc", "SELECT round(avg((quality = toxic)::INT) OVER (ORDER BY doc_id ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING), 6) AS \"Accuracy\", doc_id FROM labels")
def _(spark, d):
    return rounded(rolling.rolling_met(read(spark, d, "labels"), "quality", "toxic", on="doc_id"))


@query("q_roll_by_user", "SELECT round(avg(abs(value - 100)) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86399999999 MICROSECONDS PRECEDING AND CURRENT ROW), 6) AS \"MAE\", ts, user_id FROM events")
def _(spark, d):
    e = read(spark, d, "events").withColumn("guess", F.lit(100.0))
    return rounded(rolling.rolling_met(e, "value", "guess", "ts", {"window": "1day"}, {"MAE": M.mae}, partition_by=["user_id"]))


@query("q_roll_mean_90m", f"SELECT event_id, round(avg(value) OVER (ORDER BY ts {range_sql(5_399_999_999, 0)}) + 1e-10, 6) AS value_mean FROM events")
def _(spark, d):
    return rounded(rolling.rolling_mean(read(spark, d, "events").select("event_id", "ts", "value"), "value", "ts", "90min").select("event_id", (F.col("value_mean") + step(6)).alias("value_mean")))


@query("q_metric_acc_count", "SELECT sum((quality = toxic)::INT)::DOUBLE AS m FROM labels")
def _(spark, d):
    return read(spark, d, "labels").agg(M.accuracy_count(F.col("quality"), F.col("toxic")).alias("m"))


@query("q_metric_r2", "SELECT round(1 - sum((l_extendedprice - l_quantity * 1000) ** 2) / (var_pop(l_extendedprice) * count(*)), 6) AS r2, round(-avg(abs(l_extendedprice - l_quantity * 1000)), 2) AS neg_mae FROM lineitem")
def _(spark, d):
    t, p = F.col(PRICE), F.col("l_quantity") * 1000.0
    return read(spark, d, "lineitem").agg(F.round(M.r2(t, p), 6).alias("r2"), F.round(M.neg_mae(t, p), 2).alias("neg_mae"))


@query("q_metric_logloss", f"WITH t AS ({LABELLED}), p AS (SELECT quality AS y, least(greatest(n_chars / 20000.0, 1e-15), 1 - 1e-15) AS p FROM t) SELECT round(-avg(y * ln(p) + (1 - y) * ln(1 - p)), 6) AS m FROM p")
def _(spark, d):
    return labelled(spark, d).agg(F.round(M.log_loss(F.col("quality"), F.col("n_chars") / 20000.0), 6).alias("m"))


@query("q_metric_auc", f"WITH t AS ({LABELLED}), r AS (SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS k FROM t), s AS (SELECT sum(quality) AS p, count(*) - sum(quality) AS n, sum(k) FILTER (WHERE quality = 1) AS k FROM r) SELECT round((k - p * (p + 1) / 2.0) / (p * n), 6) AS auc FROM s")
def _(spark, d):
    return rounded(M.roc_auc(labelled(spark, d), "quality", "n_chars"))


@query("q_metric_homogeneity", "WITH c AS (SELECT quality AS t, toxic AS p, count(*)::DOUBLE AS n FROM labels GROUP BY 1, 2), a AS (SELECT *, sum(n) OVER (PARTITION BY p) AS np, sum(n) OVER () AS nn FROM c), b AS (SELECT t, sum(n) AS nt FROM c GROUP BY t) SELECT round(1 - (SELECT -sum(n * ln(n / np)) FROM a) / (SELECT -sum(nt * ln(nt / (SELECT sum(n) FROM c))) FROM b), 6) AS homogeneity")
def _(spark, d):
    return rounded(M.homogeneity(read(spark, d, "labels"), "quality", "toxic"))


@query("q_residual", "SELECT doc_id, quality - toxic AS resid FROM labels")
def _(spark, d):
    return prep.residual(read(spark, d, "labels"), "quality", "toxic").select("doc_id", "resid")


@query("q_timefilter", "SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-12 00:00:00'")
def _(spark, d):
    return prep.time_range(read(spark, d, "events").select("event_id", "ts"), "ts", "2024-01-05 00:00:00", "2024-01-12 00:00:00", after=True)


@query("q_dropna_subset", f"SELECT {KEY_SQL}, nullif(l_linenumber, 3) AS a FROM lineitem WHERE l_linenumber <> 3")
def _(spark, d):
    df = read(spark, d, "lineitem").select(*KEY_SQL.split(", "), F.nullif("l_linenumber", F.lit(3)).alias("a"), F.lit(None).cast("int").alias("b"))
    return prep.drop_missing(df, ["a"]).drop("b")


@query("q_dropinf", f"SELECT {KEY_SQL}, round(ln(l_tax), 6) AS a FROM lineitem WHERE l_tax > 0")
def _(spark, d):
    a = F.when(F.col("l_tax") > 0, F.ln("l_tax")).otherwise(F.lit(float("-inf")))
    return rounded(prep.drop_undefined(read(spark, d, "lineitem").select(*KEY_SQL.split(", "), a.alias("a"))))


@query("q_split", f"SELECT CASE WHEN substr(md5(concat_ws(':', {LINE_HASH}, '17')), 1, 8) <= '4ccccccc' THEN 'test' ELSE 'train' END AS part, count(*) AS n, sum(l_orderkey)::BIGINT AS keys FROM lineitem GROUP BY 1")
def _(spark, d):
    train, test = sample.split(read(spark, d, "lineitem"), LINE_KEY)
    count = lambda df, name: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))
    return count(train, "train").union(count(test, "test"))


@query("q_subsample", "SELECT o_orderkey, o_custkey FROM orders WHERE substr(md5(concat_ws(':', o_orderkey, '17')), 1, 8) <= '4ccccccc'")
def _(spark, d):
    return sample.subsample(read(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 0.3)


FOLD_SQL = "CASE WHEN substr(md5(concat_ws(':', {key}, '17')), 1, 8) <= '55555555' THEN 0 WHEN substr(md5(concat_ws(':', {key}, '17')), 1, 8) <= 'aaaaaaaa' THEN 1 ELSE 2 END"


@query("q_folds", f"SELECT o_orderkey, {FOLD_SQL.format(key='o_orderkey')}::INT AS fold FROM orders")
def _(spark, d):
    return sample.folds(read(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])


@query("q_describe", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75, round(max({c}), 4) AS max FROM (SELECT p_size::DOUBLE AS p_size, p_retailprice FROM part)" for c in ("p_size", "p_retailprice")))
def _(spark, d):
    return rounded(tables.describe(read(spark, d, "part"), ["p_size", "p_retailprice"]), 4)


@query("q_scale", f"SELECT {KEY_SQL}, l_tax * 1000.0 AS l_tax FROM lineitem")
def _(spark, d):
    return rounded(reshape.scaled(read(spark, d, "lineitem").select(*KEY_SQL.split(", "), "l_tax"), {"l_tax": 1000}))


@query("q_index_join", "SELECT d.doc_id, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _(spark, d):
    return reshape.joined_on(read(spark, d, "documents").select("doc_id", "n_chars"), read(spark, d, "labels"), ["doc_id"])


@query("q_transpose", "SELECT 'n' AS name, " + ", ".join(f"count(*) FILTER (WHERE l_returnflag = '{f}')::DOUBLE AS \"{f}\"" for f in "ANR") + " FROM lineitem UNION ALL SELECT 'qty', " + ", ".join(f"sum(l_quantity) FILTER (WHERE l_returnflag = '{f}')" for f in "ANR") + " FROM lineitem")
def _(spark, d):
    t = read(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))
    return reshape.transposed(t, "l_returnflag", ["n", "qty"])


@query("q_stack", "SELECT 'part' AS part, count(*) AS n, max(p_size) AS size FROM part UNION ALL SELECT 'supplier', count(*), NULL FROM supplier")
def _(spark, d):
    return reshape.stacked({"part": read(spark, d, "part").agg(F.count("*").alias("n"), F.max("p_size").alias("size")), "supplier": read(spark, d, "supplier").agg(F.count("*").alias("n"))})


@query("q_limits", "SELECT 'l_quantity' AS \"column\", min(l_quantity) AS least, max(l_quantity) AS largest FROM lineitem UNION ALL SELECT 'l_tax', min(l_tax), max(l_tax) FROM lineitem")
def _(spark, d):
    return reshape.limits(read(spark, d, "lineitem"), ["l_quantity", "l_tax"])


SCORE_SQL = "s AS (SELECT p_size AS candidate, unnest(['mean_test_price', 'mean_train_count', 'mean_test_same']) AS score, unnest([avg(p_retailprice), count(*)::DOUBLE, 1.0]) AS value FROM part GROUP BY p_size)"


@query("q_multi_score", f"WITH {SCORE_SQL}, n AS (SELECT candidate, coalesce((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0), 0.0) AS s FROM s WINDOW w AS (PARTITION BY score)) SELECT candidate, round(sqrt(avg(s * s)), 6) AS rms FROM n GROUP BY candidate")
def _(spark, d):
    each = F.inline(F.array(*[F.struct(F.lit(n).alias("score"), v.cast("double").alias("value")) for n, v in (("mean_test_price", F.col("price")), ("mean_train_count", F.col("n")), ("mean_test_same", F.lit(1)))]))
    scores = read(spark, d, "part").groupBy(F.col("p_size").alias("candidate")).agg(F.avg("p_retailprice").alias("price"), F.count("*").alias("n")).select("candidate", each)
    return rounded(ml.multi_score(scores))


def test_rows_sql() -> str:
    return f"substr(md5(concat_ws(':', {LINE_HASH}, '17')), 1, 8) <= '4ccccccc'"


#: With one feature of two values every tree of depth one splits between them: a forest without resampling, and boosting, predict the train split's means.
MEANS_SQL = f"WITH t AS (SELECT *, l_linestatus = 'O' AS o, {test_rows_sql()} AS test FROM lineitem), m AS (SELECT o, avg(l_extendedprice) AS mean FROM t WHERE NOT test GROUP BY o) SELECT o::INT AS o, count(*) AS n, round(any_value(mean), 2) AS pred, round(avg((l_extendedprice - mean) * (l_extendedprice - mean)), 0) AS mse FROM t JOIN m USING (o) WHERE test GROUP BY o"


def _trained(name: str, estimator: Callable) -> None:
    @query(name, MEANS_SQL)
    def _(spark, d):
        df = read(spark, d, "lineitem").withColumn("o", (F.col("l_linestatus") == "O").cast("int"))
        train, test = sample.split(df, LINE_KEY)
        out = ml.predict(ml.train(train, ["o"], PRICE, estimator(), LINE_KEY), test, ["o"], PRICE)
        pred = F.col(f"{PRICE}_pred")
        return out.groupBy("o").agg(F.count("*").alias("n"), F.round(F.max(pred), 2).alias("pred"), F.round(M.mse(F.col(PRICE), pred), 0).alias("mse"))


def forest(**kw: object):
    from pyspark.ml.regression import RandomForestRegressor

    return RandomForestRegressor(numTrees=20, minInstancesPerNode=5, maxDepth=1, bootstrap=False, **kw)


def boosted(**kw: object):
    from pyspark.ml.regression import GBTRegressor

    return GBTRegressor(maxIter=4, maxDepth=1, stepSize=1.0, **kw)


_trained("q_train_forest", forest)
_trained("q_train_boosting", boosted)


def _error_of(spark, d, estimator) -> DataFrame:
    """The error of an estimator fitted on the train split on the test split, beside that of the mean."""
    train, test = sample.split(read(spark, d, "lineitem"), LINE_KEY)
    out = ml.predict(ml.train(train, FEATURES, PRICE, estimator, LINE_KEY), test, FEATURES, PRICE)
    base = train.agg(F.avg(PRICE).alias("base"))
    return out.join(F.broadcast(base)).agg(F.count("*").alias("n"), M.mse(F.col(PRICE), F.col(f"{PRICE}_pred")).alias("mse"), M.mse(F.col(PRICE), F.col("base")).alias("mse_of_mean"))


@query("q_train_rf")
def _(spark, d):
    from pyspark.ml.regression import RandomForestRegressor

    return _error_of(spark, d, RandomForestRegressor(numTrees=20, minInstancesPerNode=5, featureSubsetStrategy="0.5", maxDepth=6))


@query("q_train_gbt")
def _(spark, d):
    from pyspark.ml.regression import GBTRegressor

    return _error_of(spark, d, GBTRegressor(maxIter=10, maxDepth=4))


def _determinant(m: list[list[str]]) -> str:
    if len(m) == 1:
        return m[0][0]
    terms = (f"{'-' if k % 2 else '+'} ({x}) * ({_determinant([row[:k] + row[k + 1 :] for row in m[1:]])})" for k, x in enumerate(m[0]))
    return " ".join(terms)


def least_squares_sql(xs: list[str], y: str, source: str) -> str:
    """(b0, b1, ..., a): slopes by Cramer's rule on the covariances, and the intercept."""
    cov = [[f"c{min(i, j)}{max(i, j)}" for j in range(len(xs))] for i in range(len(xs))]
    parts = [f"covar_pop({a}, {b}) AS c{i}{j}" for i, a in enumerate(xs) for j, b in enumerate(xs) if i <= j]
    parts += [f"covar_pop({a}, {y}) AS d{i}" for i, a in enumerate(xs)] + [f"avg({a}) AS m{i}" for i, a in enumerate(xs)] + [f"avg({y}) AS my"]
    slopes = [f"({_determinant([[f'd{i}' if j == k else c for j, c in enumerate(row)] for i, row in enumerate(cov)])}) / ({_determinant(cov)}) AS b{k}" for k in range(len(xs))]
    less = " ".join(f"- b{k} * m{k}" for k in range(len(xs)))
    return f"(SELECT *, my {less} AS a FROM (SELECT *, {', '.join(slopes)} FROM (SELECT {', '.join(parts)} FROM {source})))"


@query("q_predict", f"SELECT {KEY_SQL}, round(a + b0 * l_quantity + b1 * l_discount + b2 * l_tax, 1) AS pred FROM lineitem, {least_squares_sql(FEATURES, PRICE, 'lineitem')} f")
def _(spark, d):
    from pyspark.ml.regression import LinearRegression

    df = read(spark, d, "lineitem")
    return ml.predict(ml.train(df, FEATURES, PRICE, LinearRegression(), LINE_KEY), df, FEATURES, PRICE).select(*KEY_SQL.split(", "), F.round(f"{PRICE}_pred", 1).alias("pred"))


def _grid_sql() -> str:
    """Scores of trees of depth 0 (the train folds' mean) and 1 (their means by the feature's two values)."""
    means = {0: "avg(y) FILTER (WHERE fold <> f) OVER (PARTITION BY f)", 1: "avg(y) FILTER (WHERE fold <> f) OVER (PARTITION BY f, x)"}
    rows = " UNION ALL ".join(f"SELECT {c} AS candidate, f, fold = f AS test, y, {m} AS p FROM t, range(3) r(f)" for c, m in means.items())
    scores = {"r2": "1 - avg((y - p) * (y - p)) / var_pop(y)", "neg_mean_absolute_error": "-avg(abs(y - p))"}
    each = " UNION ALL ".join(f"SELECT candidate, f, concat('mean_', CASE WHEN test THEN 'test' ELSE 'train' END, '_{n}') AS score, {e} AS v FROM p GROUP BY candidate, f, test" for n, e in scores.items())
    return f"""WITH t AS (SELECT o_totalprice AS y, (o_orderstatus = 'O')::INT AS x, {FOLD_SQL.format(key='o_orderkey')} AS fold FROM orders), p AS ({rows}), e AS ({each}),
    s AS (SELECT candidate, score, avg(v) AS value FROM e GROUP BY ALL), n AS (SELECT candidate, coalesce((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0), 0.0) AS k FROM s WINDOW w AS (PARTITION BY score)),
    b AS (SELECT candidate FROM (SELECT candidate, sqrt(avg(k * k)) AS rms FROM n GROUP BY candidate) ORDER BY rms DESC, candidate LIMIT 1)
    SELECT s.candidate, score, round(value, 6) + 0.0 AS value, s.candidate = b.candidate AS best FROM s, b"""


def _searched(spark, d, grid: dict, features: list[str], df: DataFrame) -> DataFrame:
    from pyspark.ml.regression import DecisionTreeRegressor

    got = ml.tune(DecisionTreeRegressor(seed=17), grid, df, features, "o_totalprice", ["o_orderkey"], scoring=["r2", "neg_mean_absolute_error"], refit=False)
    out = rounded(spark.createDataFrame([(c, k, v, c == got.best) for c, k, v in got.rows], "candidate int, score string, value double, best boolean"))
    return out.withColumn("value", F.col("value") + 0.0)  # no minus zero


@query("q_grid_search", _grid_sql())
def _(spark, d):
    df = read(spark, d, "orders").withColumn("x", (F.col("o_orderstatus") == "O").cast("int"))
    return _searched(spark, d, {"maxDepth": [0, 1]}, ["x"], df)


@query("q_grid_search_trees")
def _(spark, d):
    df = read(spark, d, "orders").withColumn("month", F.month("o_orderdate"))
    return _searched(spark, d, {"maxDepth": [2, 4], "minInstancesPerNode": [1, 20]}, ["o_custkey", "month"], df)
