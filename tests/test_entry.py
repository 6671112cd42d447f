"""The driver contract, sources and streams."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidegauge.functions.metrics import mae
from tidegauge.sources import tables
from tidegauge.streaming.prep import prepared_stream, tumbling_metric


def test_every_oracle_has_a_query(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns[0] == "feature"


def test_formats(spark, tmp_path):
    df = spark.range(5).select("id", (F.col("id") * 2).alias("b"))
    for fmt in ("parquet", "csv", "json", "orc"):
        path = str(tmp_path / f"t.{fmt}")
        tables.write(df, path, fmt)
        back = tables.read(spark, path, schema="id long, b long" if fmt in ("csv", "json") else None, columns=["b"])
        assert sorted(r.b for r in back.collect()) == [0, 2, 4, 6, 8]
    assert tables.head(df, 2).count() == 2
    try:
        import tables as _  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError):
            tables.read(spark, "x.h5")


@pytest.mark.parametrize("key", [None, "indexed"])
def test_files_of_numbered_rows_are_read_in_ranges(spark, tmp_path, key):
    class Lines:
        """A file with numbered rows in the place of an HDF5 table."""

        def rows(self, path, key):
            with open(path) as f:
                return len(f.readlines()) - 1

        def read(self, path, key, start, stop):
            import pandas as pd

            frame = pd.read_csv(path, skiprows=range(1, start + 1), nrows=stop - start)
            return frame.set_index("t") if key == "indexed" else frame

    path = tmp_path / "t.csv"
    path.write_text("t,x\n" + "".join(f"{i},{i * 0.5}\n" for i in range(23)))
    df = tables.read_hdf(spark, str(path), key, rows=5, reader=Lines())
    assert df.rdd.getNumPartitions() == 5 and sorted((r.t, r.x) for r in df.collect()) == [(i, i * 0.5) for i in range(23)]


def test_heatmap_form(spark):
    from tidegauge.operators import reshape

    m = spark.createDataFrame([("a", -0.5, None), ("b", 0.25, 1.0), ("c", 0.0, 0.0)], "feature string, x double, y double")
    assert reshape.to_heatmap(m, drop=["c"]) == {"rows": ["a", "b"], "columns": ["x", "y"], "values": [[0.5, None], [0.25, 1.0]]}


def test_describe_equals_numpy(spark):
    import numpy as np

    df = spark.range(1001).select(((F.col("id") * 37) % 1001 / 7).alias("a"), F.when(F.col("id") % 3 > 0, F.col("id") % 5).alias("b"), F.lit(None).cast("double").alias("c"), F.lit("x").alias("s"))
    got = {r["column"]: r for r in tables.describe(df).collect()}
    p = df.toPandas()
    assert set(got) == {"a", "b", "c"} and got["c"]["count"] == 0 and got["c"]["mean"] is None
    for c in "ab":
        own = p[c].dropna().to_numpy()
        assert [got[c][k] for k in ("count", "mean", "std", "min", "q25", "q50", "q75", "max")] == pytest.approx([len(own), own.mean(), own.std(ddof=1), own.min(), *np.quantile(own, [0.25, 0.5, 0.75]), own.max()])


def test_describe(spark):
    r = tables.describe(spark.range(5).select("id", F.lit("x").alias("s"))).collect()
    assert [(x["column"], x["count"], x.q50) for x in r] == [("id", 5, 2.0)]


def test_streams(spark, tmp_path):
    rows = [(f"2024-01-01 00:0{i}:00", float(i), 0.0) for i in range(6)]
    df = spark.createDataFrame(rows, "s string, t double, p double").select(F.col("s").cast("timestamp").alias("ts"), "t", "p")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = tumbling_metric(stream, "ts", "t", "p", mae, "2 minutes", "1 minute")
    q = out.writeStream.format("memory").queryName("rolled").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.metric for r in spark.table("rolled").collect()) == [0.5, 2.5, 4.5]
    q = prepared_stream(stream, ["t"]).writeStream.format("memory").queryName("logged").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("logged").count() == 5
