"""Subsets: names of 0/1 columns and row predicates, under the names results use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .schema import col, require

Subset = str | Callable[[DataFrame], Column]


def subsets(cat_dat: list[Subset] | dict[str, Subset] | None) -> dict[str, Subset]:
    """A list's strings name themselves, its callables are ``call00``, ``call01``, ..."""
    if not cat_dat:
        return {}
    if isinstance(cat_dat, dict):
        return dict(cat_dat)
    out, calls = {}, 0
    for x in cat_dat:
        if isinstance(x, str):
            out[x] = x
        else:
            out[f"call{calls:02}"] = x
            calls += 1
    return out


def masks(df: DataFrame, cat_dat: list[Subset] | dict[str, Subset] | None, several: bool) -> list[tuple[str, Column]]:
    """(column name or prefix, condition): a string gives the rows that are 1 and all others, NULL among them."""
    out = []
    for name, x in subsets(cat_dat).items():
        if isinstance(x, str):
            require(df, [x])
            one = F.coalesce(col(x).cast("double") == 1, F.lit(False))
            out += [(f"{name}==1" if several else f"{name} == 1", one), (f"{name}!=1" if several else f"{name} != 1", ~one)]
        else:
            out.append((name, F.coalesce(x(df), F.lit(False))))
    return out
