"""Sources and sinks: any table Spark reads or writes; HDF5 where its library is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quantiles import quantiles
from ..plans.schema import col, numeric_columns, require, value

FORMATS = ("parquet", "orc", "csv", "json", "jdbc", "avro")


def read(spark: SparkSession, path: str, fmt: str | None = None, schema: str | None = None, columns: list[str] | None = None, **options: str) -> DataFrame:
    """A table by path; the format is told by the file's ending unless given. ``columns`` prunes the scan."""
    fmt = fmt or next((f for f in FORMATS if f".{f}" in path), "hdf5" if path.endswith((".h5", ".hdf", ".hdf5")) else "parquet")
    if fmt == "hdf5":
        df = read_hdf(spark, path, **options)
    else:
        reader = spark.read.format(fmt).options(**{"header": "true", **options} if fmt == "csv" else options)
        df = (reader.schema(schema) if schema else reader).load(path)
    if columns:
        require(df, columns)
        df = df.select(*[col(c) for c in columns])
    return df


class HdfFile:
    """Row ranges of a pandas HDF5 table (``format="table"``) by the ``tables`` package, wherever it is asked."""

    def rows(self, path: str, key: str | None) -> int:
        import pandas as pd

        with pd.HDFStore(path, "r") as store:
            return store.get_storer(key or store.keys()[0]).nrows

    def read(self, path: str, key: str | None, start: int, stop: int):
        import pandas as pd

        return pd.read_hdf(path, key=key, start=start, stop=stop)


def read_hdf(spark: SparkSession, path: str, key: str | None = None, rows: int = 500_000, reader: HdfFile | None = None) -> DataFrame:
    """A pandas HDF5 table, read by the executors in ranges of ``rows`` rows; a named index becomes a column.

    Needs the ``tables`` package, and the path on all machines; types are those of the first rows. The driver
    reads no more than these. ``reader`` may stand for another kind of file with numbered rows.
    """
    if reader is None:
        try:
            import tables  # noqa: F401
        except ImportError as e:
            raise ImportError("reading HDF5 needs the 'tables' package") from e
        reader = HdfFile()
    named = lambda frame: frame.reset_index() if frame.index.name else frame
    n = reader.rows(path, key)
    schema = spark.createDataFrame(named(reader.read(path, key, 0, min(n, 1000)))).schema

    def run(batches):
        for b in batches:
            for at in b["id"]:
                yield named(reader.read(path, key, int(at), min(n, int(at) + rows)))[schema.names]

    parts = max(1, -(-n // rows))
    return spark.range(0, parts * rows, rows, parts).mapInPandas(run, schema)


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    writer = df.write.format(fmt).mode(mode)
    if fmt == "csv":
        writer = writer.option("header", "true")
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def head(df: DataFrame, n: int = 5) -> DataFrame:
    """The first rows as they come."""
    return df.limit(n)


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, mean, standard deviation, least and largest value, and exact quartiles: one row for each numeric column."""
    names = numeric_columns(df, columns or df.columns)
    stats = {"count": F.count, "std": F.stddev_samp, "min": F.min, "max": F.max}
    one = df.agg(*[f(value(df, c)).alias(f"{s}{k}") for k, c in enumerate(names) for s, f in stats.items()])
    row = lambda k, c: F.struct(F.lit(c).alias("column"), F.lit(k).alias("place"), *[F.col(f"{s}{k}").alias(s) for s in stats])
    rows = one.select(F.inline(F.array(*[row(k, c) for k, c in enumerate(names)])))
    long = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("place"), value(df, c).alias("x")) for k, c in enumerate(names)])).alias("v")).select("v.place", "v.x")
    inner = quantiles(long, ["place"], "x", [0.25, 0.5, 0.75]).select("place", "mean", F.col("q0").alias("q25"), F.col("q1").alias("q50"), F.col("q2").alias("q75"))
    return rows.join(F.broadcast(inner), "place", "left").select("column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")
