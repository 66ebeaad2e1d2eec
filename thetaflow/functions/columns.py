"""Column-expression helpers shared by the operators (all JVM-side)."""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def c(name: str) -> Column:
    """Column by exact name; backticks make names with dots resolvable."""
    return F.col(f"`{name}`")


def guarded_div(num: Column, den: Column) -> Column:
    """``num / den``, null when ``den`` is null or zero (never raises)."""
    return F.when(den.isNotNull() & (den != 0), F.try_divide(num, den))


def quote(name: str) -> str:
    """SQL identifier for ``name`` (backticks; dots and spaces are kept)."""
    return "`" + name.replace("`", "``") + "`"


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
                broadcast: bool = False) -> DataFrame:
    """Join on group keys of which a null is a value like any other."""
    right = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [c(k).eqNullSafe(c(f"_right_{k}")) for k in keys])
    return left.join(F.broadcast(right) if broadcast else right, same, how).drop(*[f"_right_{k}" for k in keys])


def all_not_null(cols: Iterable[str]) -> Column:
    """Conjunction ``c1 IS NOT NULL AND ...`` (one expression, cheap to build)."""
    terms = [f"{quote(n)} IS NOT NULL" for n in cols]
    return F.expr(" AND ".join(terms)) if terms else F.lit(True)


def sum_null_as_zero(cols: Sequence[str]) -> Column:
    """Horizontal sum where a null term counts as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(c(n), F.lit(0.0)) for n in cols])


def fold_add(cols: Sequence[str]) -> Column:
    """Horizontal sum where any null term makes the result null."""
    return reduce(lambda a, b: a + b, [c(n) for n in cols], F.lit(0.0))


def series_window(series_keys: Sequence[str] = (), order_by: Sequence[str] = ("date",)) -> WindowSpec:
    """Window over one time series per ``series_keys`` in ``order_by`` order.

    A daily series holds at most one row per trading day, so even the
    unpartitioned case (one market-wide series) is bounded by the calendar.
    """
    return Window.partitionBy(*series_keys).orderBy(*order_by)


def finite_or_null(x: Column) -> Column:
    """Map NaN and +-inf to null (the reference reports them as missing)."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def sharpe(mean: Column, std: Column, n: Column, rf: float, ann: int, min_n: int = 2) -> Column:
    """Annualised Sharpe ratio with the reference's edge rules.

    ``(mean - rf) / std * sqrt(ann)`` when std is non-zero; 0.0 when the
    mean is 0 and std is null or 0; otherwise null.  ``min_n`` is the number
    of observations required at all.
    """
    ratio = F.when(std.isNotNull() & (std != 0) & mean.isNotNull(),
                   F.try_divide(mean - F.lit(rf), std) * F.lit(float(ann) ** 0.5))
    zero = F.when(mean.isNotNull() & (mean == 0) & (std.isNull() | (std == 0)), F.lit(0.0))
    return F.when(n >= min_n, F.coalesce(ratio, zero))


def fixed_decimals(x: Column, decimals: int = 2) -> Column:
    """``x`` as text with ``decimals`` places, rounded like Python's ``f"{x:.2f}"``.

    ``format_string`` rounds the shortest decimal form half-up (2.775 -> 2.78);
    ``format_number`` rounds the exact binary value (2.775 is stored as
    2.77499... -> 2.77, exact ties to even), as Python does.  Its grouping
    separators are removed.
    """
    txt = F.regexp_replace(F.format_number(x, decimals), ",", "")
    inf = F.lit(float("inf"))
    return (F.when(F.isnan(x), F.lit("nan")).when(x == inf, F.lit("inf"))
            .when(x == -inf, F.lit("-inf")).otherwise(txt))
