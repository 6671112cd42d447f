"""The parts of preparation that run on streams: stateless, or with a watermark.

Centred windows and nearest as-of joins look ahead and are for tables only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import Metric
from ..operators.prep import drop_undefined, log10_columns
from ..plans.schema import col


def prepared_stream(stream: DataFrame, log_col: list[str] | None = None) -> DataFrame:
    """Logarithms and the filter on undefined values, unchanged from the batch operators."""
    return drop_undefined(log10_columns(stream, log_col or []))


def tumbling_metric(stream: DataFrame, t_col: str, y_true: str, y_pred: str, metric: Metric, window: str, watermark: str, slide: str | None = None) -> DataFrame:
    """A metric of predictions in windows of event time; late rows count until the watermark passes."""
    timed = stream.withColumn(t_col, col(t_col).cast("timestamp")).withWatermark(t_col, watermark)
    span = F.window(col(t_col), window, slide) if slide else F.window(col(t_col), window)
    out = timed.groupBy(span.alias("w")).agg(metric(col(y_true), col(y_pred)).alias("metric"), F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "metric")
