"""Time-series reports over a backtest: period PnL (A5, A17), cumulative
breakdowns (W10-W12), autocorrelation (A13), histogram (A14) and KDE (A15).

Scalars that shape a report (bin width, grid, last date) are computed by an
aggregate and used as Spark 4 scalar subqueries (joined, where there are groups), so no value makes a round
trip through the driver.
"""

from __future__ import annotations

import math
from statistics import NormalDist
from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thetaflow.functions.columns import c, finite_or_null, join_groups
from thetaflow.functions.quantiles import breaks_below, exact_quantiles
from thetaflow.params import AnalysisParams


def period_pnl(df: DataFrame, pnl_col: str, period: str = "weekly", date_col: str = "date",
               group_cols: Sequence[str] = ()) -> DataFrame:
    """A5: PnL summed by Monday-start week or by calendar month."""
    if period not in ("weekly", "monthly"):
        raise ValueError("period must be 'weekly' or 'monthly'")
    unit = "week" if period == "weekly" else "month"
    start = F.trunc(F.col(date_col).cast("date"), unit).alias(f"{period}_start_date")
    src = df.where(c(date_col).isNotNull() & c(pnl_col).isNotNull())
    return src.groupBy(*group_cols, start).agg(F.sum(c(pnl_col)).alias(pnl_col))


def semester_periods(df: DataFrame, pnl_col: str, date_col: str = "date",
                     group_cols: Sequence[str] = ()) -> DataFrame:
    """Half-year periods with their first/last date, day count and PnL sum."""
    d = F.col(date_col).cast("date")
    src = df.where(c(date_col).isNotNull() & c(pnl_col).isNotNull())
    return src.groupBy(
        *group_cols, F.year(d).alias("plot_year"),
        (F.floor((F.month(d) - 1) / 6) + 1).cast("int").alias("plot_semester"),
    ).agg(F.min(d).alias("min_date"), F.max(d).alias("max_date"),
          F.count(F.lit(1)).alias("n_days"), F.sum(c(pnl_col)).alias(pnl_col))


def long_short_cumulative(df: DataFrame, signal_base: str = "ret_uprc_signal",
                          series_keys: Sequence[str] = ("securityid",),
                          order_by: Sequence[str] = ("date",)) -> DataFrame:
    """Running PnL of long-only and short-only days next to the total."""
    pos, pnl = c(f"{signal_base}_pos"), c(f"{signal_base}_pnl")
    side = F.when(pos > 0, F.lit("long")).when(pos < 0, F.lit("short"))
    w = Window.partitionBy(*series_keys, side).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    run = F.when(pnl.isNotNull(), F.sum(pnl).over(w))
    return df.select(
        *series_keys, *order_by, c(f"{signal_base}_cum_pnl"),
        F.when(pos > 0, run).alias("long_pnl_contribution"),
        F.when(pos < 0, run).alias("short_pnl_contribution"),
    )


def yearly_cumulative(df: DataFrame, cum_col: str = "ret_uprc_signal_cum_pnl",
                      series_keys: Sequence[str] = ("securityid",), date_col: str = "date") -> DataFrame:
    """W10 + W12: cumulative PnL rebased to 0 at the start of each calendar year.

    A year runs from Jan 1 up to, but excluding, the next Jan 1 or the
    series' last date, whichever comes first (so the very last date is left
    out, as in the reference report).
    """
    d = F.col(date_col)
    last = F.max(d).over(Window.partitionBy(*series_keys))
    year = F.year(d)
    end = F.least(F.make_date(year + 1, F.lit(1), F.lit(1)), last)
    kept = df.select(*series_keys, d, c(cum_col), year.alias("year"), end.alias("_end")).where(d < F.col("_end"))
    w = Window.partitionBy(*series_keys, "year").orderBy(date_col).rowsBetween(Window.unboundedPreceding, 0)
    return kept.select(*series_keys, "year", d, (c(cum_col) - F.first(c(cum_col)).over(w)).alias(cum_col))


#: Values of a series that one array holds while their lag sums are formed.
ACF_CHUNK = 1024


def autocorrelation(df: DataFrame, columns: Sequence[str], params: AnalysisParams = AnalysisParams(),
                    series_keys: Sequence[str] = (), order_by: Sequence[str] = ("date",)) -> DataFrame:
    """ACF of each column for lags 0..L with a normal confidence band.

    Nulls are removed first; lag i is the Pearson correlation of ``x`` with
    ``x`` shifted by i over the overlapping rows.  A column needs at least
    L + 1 values; undefined lags (constant series) are left out.

    A series is cut into chunks of ``ACF_CHUNK`` values, each led by the last L values of the chunk
    before (its halo).  A chunk yields one row of partial sums for each
    lag, and only these rows meet again.  Values are taken from the series' mean, so the sums do
    not cancel; a spread below 1e-12 of the second moment is none.
    """
    L = params.acf_max_lags
    size = max(ACF_CHUNK, L)
    z = NormalDist().inv_cdf(1 - (1 - params.acf_confidence) / 2)
    cols = [x for x in columns if x in df.columns]
    long = df.select(*series_keys, *order_by, *[c(x).cast("double").alias(x) for x in cols]).unpivot(
        [*series_keys, *order_by], cols, "column", "x").where(F.col("x").isNotNull())
    keys = [*series_keys, "column"]
    series = Window.partitionBy(*keys)
    placed = long.select(*keys, (F.row_number().over(series.orderBy(*order_by)) - 1).alias("_i"),
                         (F.col("x") - F.avg("x").over(series)).alias("_d"), F.count("x").over(series).alias("_n"))
    chunk = F.expr(f"_i DIV {size}")
    homes = F.when((F.col("_i") % size >= size - L) & (F.col("_i") < F.col("_n") - F.col("_n") % size),
                   F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    # the chunks' keys extend those of the window: no exchange in between
    chunks = placed.where(F.col("_n") >= L + 1).select(*keys, "_i", "_d", "_n", F.explode(homes).alias("_chunk")).groupBy(*keys, "_chunk").agg(
        F.array_sort(F.collect_list(F.struct("_i", "_d"))).alias("_a"), F.max("_n").alias("_n"))
    chunks = chunks.select(*keys, "_n", F.col("_a._d").alias("_a"),
                           F.size(F.filter("_a", lambda v: v["_i"] < F.col("_chunk") * size)).alias("_halo"))

    def total(a):
        return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)

    def squares(a):
        return F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v)

    a, halo, length = F.col("_a"), F.col("_halo"), F.size("_a")

    def cut(start, stop):
        """The values at places ``start`` (from 0) up to ``stop``; none if they cross."""
        return F.slice(a, start + 1, F.greatest(stop - start, F.lit(0)))

    # Sums are put together from a body that all lags share and at most L values at its ends, never by subtraction.
    split, end = F.greatest(halo, F.least(F.lit(L), length)), F.greatest(length - L, halo)
    shared = chunks.select(*keys, "_n", "_a", "_halo", split.alias("_b"), end.alias("_e"), total(cut(split, length)).alias("_x"),
                           squares(cut(split, length)).alias("_xx"), total(cut(halo, end)).alias("_y"), squares(cut(halo, end)).alias("_yy"))

    def sums(i):
        """Of the pairs whose later value is the chunk's own: of the later, of the earlier ones, and of products."""
        first = F.greatest(halo, i)
        low, high = F.greatest(halo - i, F.lit(0)), F.greatest(length - i, F.lit(0))
        head, lead, tail = cut(first, F.col("_b")), cut(low, F.least(halo, high)), cut(F.col("_e"), high)
        product = total(F.zip_with(cut(first, length), cut(first - i, high), lambda x, y: x * y))
        return F.struct(i.alias("lag"), F.greatest(length - first, F.lit(0)).alias("m"),
                        (F.col("_x") + total(head)).alias("x"), (total(lead) + F.col("_y") + total(tail)).alias("y"),
                        (F.col("_xx") + squares(head)).alias("xx"), (squares(lead) + F.col("_yy") + squares(tail)).alias("yy"),
                        product.alias("xy"))

    parts = shared.select(*keys, "_n", F.inline(F.transform(F.sequence(F.lit(0), F.lit(L)), sums)))
    agg = parts.where("m > 0").groupBy(*keys, "lag").agg(F.max("_n").alias("n"), *[F.sum(v).alias(v) for v in ("m", "x", "y", "xx", "yy", "xy")])
    m, x, y, xx, yy, xy = (F.col(v) for v in ("m", "x", "y", "xx", "yy", "xy"))
    vx, vy = m * xx - x * x, m * yy - y * y
    spread = (vx > 1e-12 * m * xx) & (vy > 1e-12 * m * yy)
    corr = F.when(spread, F.try_divide(m * xy - x * y, F.sqrt(vx) * F.sqrt(vy)))
    acf = F.when(F.col("lag") == 0, F.lit(1.0)).when(m >= 2, corr)
    out = agg.select(*keys, "lag", acf.alias("acf"), "n")
    out = out.where(F.col("acf").isNotNull() & ~F.isnan("acf"))
    return out.select(*keys, "lag", "acf", (F.lit(z) / F.sqrt(F.col("n"))).alias("conf_band"))


def _clean_values(df: DataFrame, col: str, limit: float | None, group_cols: Sequence[str] = ()) -> DataFrame:
    """Finite values ``x`` (below ``limit`` in size, if there is one)."""
    x = F.col("_x")
    v = df.select(*group_cols, c(col).cast("double").alias("_x")).where(finite_or_null(x).isNotNull())
    if limit is not None:
        v = v.where(F.abs(x) < F.lit(float(limit)))
    return v


def _with_shape(v: DataFrame, shape: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Adds each group's struct ``_p``: by a scalar subquery, or by a join on the groups."""
    if group_cols:
        return join_groups(v, shape, group_cols)
    return v.withColumn("_p", shape.select("_p").scalar())


#: Bins beyond this number can't be told apart in doubles.
MOST_BINS = float(1 << 53)
#: Pieces that a group's occupied bins are cut into to find each one's successor.
PIECES = 64


#: Bins of a run that one array lists when runs are told apart.
RUN_BINS = 10_000


def histogram(df: DataFrame, col: str, bins: int | str = "auto", limit: float | None = None,
              group_cols: Sequence[str] = (), every_bin: bool = False) -> DataFrame:
    """Density-normalised histogram with NumPy's ``auto`` rule (or ``bins`` equal bins), for each group.

    ``auto`` is the rule of NumPy 1.26, the version the reference runs with:
    the smaller of the Freedman-Diaconis and Sturges widths (Sturges alone
    when the IQR is 0, or when there were over 2**53 bins; NumPy 2 additionally caps the FD bin count); edges are evenly spaced from min to
    max, the last bin is closed.  The table is run-length: one row for each occupied bin (``bins`` = 1) and one for
    each stretch of empty ones, so a far outlier costs one row, whatever the number of bins.
    ``bin`` is the run's first bin, ``density`` is ``count / width / n``.  Null and non-finite values are left out.
    ``every_bin`` gives each empty bin a row of its own, as NumPy does, and no ``bins``.
    """
    g = list(group_cols)
    v = _clean_values(df, col, limit, g)
    x = F.col("_x")
    s = v.groupBy(*g).agg(F.count(x).cast("double").alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).where("n > 0")
    q = exact_quantiles(v, x, [0.75, 0.25], g, name="q")
    s = join_groups(s, q, g) if g else s.withColumn("q", q.scalar())
    n, lo, hi = F.col("n"), F.col("lo"), F.col("hi")
    s = s.withColumn("first", F.when(lo == hi, lo - 0.5).otherwise(lo)).withColumn("last", F.when(lo == hi, hi + 0.5).otherwise(hi))
    span = F.col("last") - F.col("first")
    if bins == "auto":
        sturges = (hi - lo) / (F.log2(n) + 1.0)
        fd = 2.0 * (F.col("q")[0] - F.col("q")[1]) * F.pow(n, F.lit(-1.0 / 3.0))

        def number(width):
            return F.when(width > 0, F.ceil(F.least(span / F.when(width > 0, width), F.lit(2 * MOST_BINS)))).otherwise(F.lit(1))

        smaller = number(F.when(fd > 0, F.least(fd, sturges)).otherwise(sturges))
        nb = F.when(smaller <= MOST_BINS, smaller).otherwise(number(sturges))
    else:
        nb = F.lit(int(bins))
    shape = s.withColumn("nb", nb.cast("long")).select(
        *g, F.struct("n", "first", "last", "nb", (span / F.col("nb")).alias("step")).alias("_p"))
    vv = _with_shape(v, shape, g)
    pn, pf, pl, pb, ps = (F.col(f"_p.{k}") for k in ("n", "first", "last", "nb", "step"))

    def edge(i):
        return F.when(i >= pb, pl).otherwise(pf + i * ps)

    i0 = F.least(F.greatest(F.floor((x - pf) / (pl - pf) * pb).cast("long"), F.lit(0)), pb - 1)
    step1 = vv.select(*g, "_x", "_p", i0.alias("i0"))
    i1 = F.when(x < edge(F.col("i0")), F.col("i0") - 1).otherwise(F.col("i0"))
    step2 = step1.select(*g, "_x", "_p", i1.alias("i1"))
    idx = F.when((x >= edge(F.col("i1") + 1)) & (F.col("i1") != pb - 1), F.col("i1") + 1).otherwise(F.col("i1"))
    taken = step2.select(*g, idx.alias("bin"), "_p").groupBy(*g, "bin").agg(F.count(F.lit(1)).alias("count"), F.first("_p").alias("_p"))
    # Each occupied bin's successor: within a piece by a window, over its end by the pieces' first bins (PIECES rows a group).
    cuts = F.array(*[F.lit(i / PIECES) for i in range(1, PIECES)])
    sketch = taken.groupBy(*g).agg(F.percentile_approx("bin", cuts, 1000).alias("_cuts"))
    cut = join_groups(taken, sketch, g) if g else taken.withColumn("_cuts", sketch.scalar())
    cut = cut.withColumn("_piece", breaks_below(F.col("_cuts"), F.col("bin"), PIECES - 1))
    heads = cut.groupBy(*g, "_piece").agg(F.min("bin").alias("_head"))
    heads = heads.select(*g, "_piece", F.lead("_head").over(Window.partitionBy(*g).orderBy("_piece")).alias("_head"))
    following = F.lead("bin").over(Window.partitionBy(*g, "_piece").orderBy("bin"))
    runs = join_groups(cut.withColumn("_next", following), heads, [*g, "_piece"], broadcast=not g)
    after = F.coalesce("_next", "_head", pb)
    run = F.array_compact(F.array(
        F.struct(F.col("bin"), F.lit(1).cast("long").alias("bins"), F.col("count")),
        F.when(after > F.col("bin") + 1, F.struct((F.col("bin") + 1).alias("bin"), (after - F.col("bin") - 1).alias("bins"),
                                                  F.lit(0).cast("long").alias("count")))))
    out = runs.select(*g, "_p", F.inline(run))
    if every_bin:
        size = F.lit(RUN_BINS).cast("long")
        part = out.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1, size)))
        each = F.sequence(F.col("bin") + F.col("_at"), F.col("bin") + F.least(F.col("_at") + size, F.col("bins")) - 1)
        out = part.select(*g, "_p", F.explode(each).alias("bin"), "count").withColumn("bins", F.lit(1).cast("long"))
    left, right = edge(F.col("bin")), edge(F.col("bin") + F.col("bins"))
    out = out.select(
        *g, "bin", "bins", left.alias("bin_start"), right.alias("bin_end"), "count",
        F.try_divide(F.try_divide(F.col("count").cast("double"), right - left), pn).alias("density"),
    )
    return out.drop("bins") if every_bin else out


#: Cells of a quarter bandwidth, moments of each cell, bandwidths that a kernel reaches, and the share of the
#: curve's peak below which a density is none.
KDE_CELL, KDE_MOMENTS, KDE_REACH, KDE_FLOOR = 0.25, 20, 12.0, 1e-12


def kde_curve(df: DataFrame, col: str, grid_size: int = 200, limit: float | None = None,
              group_cols: Sequence[str] = ()) -> DataFrame:
    """Gaussian KDE (Scott's bandwidth) on ``grid_size`` points from min to max, for each group.

    Values are binned into cells of a quarter bandwidth, each with ``KDE_MOMENTS`` moments about its
    middle, weighted by the kernel; the kernel at distance u of the middle is its Taylor
    series in these moments.  Values thus meet no grid point, only cells do, within ``KDE_REACH``
    bandwidths.  The cut series is off by 2e-15 of a kernel at most and the reach by 6e-32 of its
    height, so densities are exact but for rounding down to ``KDE_FLOOR`` of the peak; smaller ones are
    0.  No curve for a bandwidth of zero (constant data).
    """
    g = list(group_cols)
    v = _clean_values(df, col, limit, g)
    x = F.col("_x")
    s = v.groupBy(*g).agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).cast("double").alias("n"),
                          (F.stddev_samp(x) * F.pow(F.count(x).cast("double"), F.lit(-0.2))).alias("bw"))
    s = s.where((finite_or_null(F.col("bw")) > 0) & (F.col("hi") > F.col("lo")))
    shape = s.select(*g, F.struct("lo", "hi", "n", "bw").alias("_p"))
    lo, hi, n, bw = (F.col(f"_p.{k}") for k in ("lo", "hi", "n", "bw"))
    away = F.try_divide(x - lo, bw)
    vv = _with_shape(v, shape, g).where(F.col("_p").isNotNull()).select(
        *g, "_p", away.alias("_t"), F.floor(away / KDE_CELL).alias("_cell"))
    middle = (F.col("_cell") + 0.5) * KDE_CELL
    vv = vv.select(*g, "_p", "_cell", (F.col("_t") - middle).alias("_d"))
    weight, power, moments = F.exp(-0.5 * F.col("_d") * F.col("_d")), F.lit(1.0), []
    for k in range(KDE_MOMENTS):
        moments.append(F.sum(weight * power).alias(f"_m{k}"))
        power = power * F.col("_d")
    cells = vv.groupBy(*g, "_cell").agg(F.first("_p").alias("_p"), *moments)
    # grid point i lies i * step bandwidths above the smallest value
    step = (hi - lo) / bw / max(grid_size - 1, 1)
    first = F.greatest(F.ceil((middle - KDE_REACH) / step), F.lit(0)).cast("int")
    last = F.least(F.floor((middle + KDE_REACH) / step), F.lit(grid_size - 1)).cast("int")
    near = cells.withColumn("grid_index", F.explode(F.when(first <= last, F.sequence(first, last))))
    u = F.col("grid_index") * step - middle
    series_ = F.lit(0.0)
    for k in reversed(range(KDE_MOMENTS)):  # Horner: sum of u**k / k! * moment k
        series_ = F.col(f"_m{k}") + series_ * u / (k + 1)
    dens = near.groupBy(*g, "grid_index").agg(F.sum(F.exp(-0.5 * u * u) * series_).alias("_a"))
    grid = shape.select(*g, "_p", F.explode(F.sequence(F.lit(0), F.lit(grid_size - 1))).alias("grid_index"))
    out = join_groups(grid, dens, [*g, "grid_index"], "left")
    k = F.col("grid_index").cast("double") * F.lit(1.0 / (grid_size - 1) if grid_size > 1 else 0.0)
    norm = F.lit(1.0 / math.sqrt(2 * math.pi))
    out = out.select(*g, "grid_index", (lo + (hi - lo) * k).alias("x"),
                     (F.coalesce("_a", F.lit(0.0)) / n * norm / bw).alias("_density"))
    peak = F.max("_density").over(Window.partitionBy(*g))  # grid_size rows
    return out.select(*g, "grid_index", "x", F.when(F.col("_density") >= KDE_FLOOR * peak, F.col("_density")).otherwise(0.0).alias("density"))
