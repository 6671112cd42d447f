"""Equal-width and explicit bins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.schema import require, value


def per_column(x_col: list[str], bins: object, xrange: object) -> list[tuple[object, tuple[float, float] | None]]:
    """(bins, range) of each x column: a scalar serves all, a list has one entry for each."""
    if isinstance(bins, (list, tuple)):
        if len(bins) != len(x_col):
            raise ValueError("bins needs one entry for each x column")
        each = list(bins)
    else:
        each = [bins] * len(x_col)
    pair = lambda r: isinstance(r, (list, tuple)) and len(r) == 2 and all(isinstance(v, (int, float)) for v in r)
    if xrange is None:
        ranges = [None] * len(x_col)
    elif pair(xrange):
        if len(x_col) != 1:
            raise ValueError("one range for several x columns: pass a list of ranges")
        ranges = [tuple(xrange)]
    elif len(xrange) == len(x_col) and all(r is None or pair(r) for r in xrange):
        ranges = [None if r is None else tuple(r) for r in xrange]
    else:
        raise ValueError("xrange needs one [low, high] or None for each x column")
    return list(zip(each, ranges, strict=True))


def _between(x: Column, inner: list[float], first: int) -> Column:
    """``first`` and the number of ascending edges at or below a value, by halving: comparisons that are compiled."""
    if not inner:
        return F.lit(first)
    k = len(inner) // 2
    return F.when(x < inner[k], _between(x, inner[:k], first)).otherwise(_between(x, inner[k + 1 :], first + k + 1))


@dataclass
class Edges:
    """Bin edges of one x column; ``n`` bins, the last closed on both sides."""

    edges: list[float]

    @property
    def n(self) -> int:
        return len(self.edges) - 1

    def bin(self, x: Column) -> Column:
        """0-based bin of a value, NULL outside: the number of inner edges at or below it."""
        inside = (x >= self.edges[0]) & (x <= self.edges[-1])
        return F.when(inside, _between(x, self.edges[1:-1], 0))

    def table(self, spark, x_col: str) -> DataFrame:
        """One row for each bin: x_col, bin, x_lo, x_hi, x_centre and x_width (the first bin's)."""
        rows = [(x_col, k, float(a), float(b), (a + b) / 2, self.edges[1] - self.edges[0]) for k, (a, b) in enumerate(zip(self.edges, self.edges[1:], strict=False))]
        return spark.createDataFrame(rows, "x_col string, bin int, x_lo double, x_hi double, x_centre double, x_width double")


def edges_of(df: DataFrame, x_col: list[str], bins: object = 10, xrange: object = None) -> dict[str, Edges]:
    """Edges of each x column: explicit lists as they are, else equal widths over the range or the data's limits.

    The limits of all columns that need them are one aggregate of one row.
    """
    require(df, x_col)
    spec = per_column(x_col, bins, xrange)
    need = [c for c, (b, r) in zip(x_col, spec, strict=True) if r is None and not isinstance(b, (list, tuple))]
    limits: dict[str, tuple[float, float]] = {}
    if need:
        row = df.agg(*[f(value(df, c)).alias(f"{w}{k}") for k, c in enumerate(need) for f, w in ((F.min, "lo"), (F.max, "hi"))]).first()
        limits = {c: (row[f"lo{k}"], row[f"hi{k}"]) for k, c in enumerate(need)}
    out = {}
    for c, (b, r) in zip(x_col, spec, strict=True):
        if isinstance(b, (list, tuple)):
            out[c] = Edges(sorted(float(e) for e in b))
            continue
        lo, hi = r or limits[c]
        if lo is None:
            lo, hi = 0.0, 1.0
        if lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
        n = int(b)
        out[c] = Edges([float(lo) + k * (float(hi) - float(lo)) / n for k in range(n)] + [float(hi)])
    return out


def edge_table(df: DataFrame, edges: dict[str, Edges]) -> DataFrame:
    """All bins of all x columns, also those without rows."""
    tables = [e.table(df.sparkSession, c) for c, e in edges.items()]
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def binned(df: DataFrame, edges: dict[str, Edges], *keep: Column) -> DataFrame:
    """Long layout: x_col, bin and the kept columns, one row for each x column whose bin the row is in."""
    rows = [F.struct(F.lit(c).alias("x_col"), e.bin(value(df, c)).cast("int").alias("bin")) for c, e in edges.items()]
    if len(rows) == 1:
        return df.select(rows[0].alias("b"), *keep).where("b.bin IS NOT NULL").select("b.x_col", "b.bin", *[f"`{c}`" for c in df.select(*keep).columns])
    return df.select(F.explode(F.array(*rows)).alias("b"), *keep).where("b.bin IS NOT NULL").select("b.x_col", "b.bin", *[f"`{c}`" for c in df.select(*keep).columns])
