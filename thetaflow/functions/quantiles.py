"""Exact quantiles and average ranks without gathering a group in one task.

Spark's exact ``percentile`` buffers every value of a group, and a ranking
window over a whole column runs in one task.  Both break down when one group
(an underlying, a signal side, a value) holds a large share of the rows.
The methods here stay exact and distributed.

Quantiles:

1. a ``percentile_approx`` sketch per group gives two breaks around each target, a band of
   about ``4 / ACCURACY`` of the rows;
2. counts of the bands and of what lies between, made map-side, give every one's rank
   offset (a few rows per group) and say which of them hold a target rank: the
   narrow bands, unless the sketch was off -- the result is exact in any case;
3. only values inside these are shuffled, collapsed by a grouped count, so what is shuffled doesn't
   follow the number of distinct values;
4. a window over the distinct values of one band gives their exact rank ranges.

Ranks need all values: the sketch gives ``BUCKETS`` breaks, so each value falls in a bucket of roughly
``n / BUCKETS`` rows, a grouped count of ``(group, bucket, value)`` collapses
duplicates (a value holding a third of all rows becomes one row), bucket totals give rank
offsets, and a window over one bucket gives every distinct value its rank range.

Quantiles interpolate linearly between the values at ranks ``floor(p(n-1))``
and ``ceil(p(n-1))``: ``lo + (hi - lo) * frac``.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thetaflow.functions.columns import join_groups

BUCKETS = 1024
ACCURACY = 10_000
#: Breaks that are compared one by one; more are searched.
FEW = 40
V, B, CNT = "_qv", "_qb", "_qc"


def breaks_below(breaks: Column, x: Column, max_breaks: int) -> Column:
    """Number of sorted ``breaks`` strictly below ``x`` by binary search:
    ``log2`` steps per row instead of a scan of every break."""
    steps = []
    step = 1
    while step <= max_breaks:
        steps.append(step)
        step *= 2
    arr = F.array(*[F.lit(s) for s in reversed(steps)])

    def advance(acc, st):
        nxt = acc + st
        return F.when((nxt <= F.size(breaks)) & (F.try_element_at(breaks, nxt) < x), nxt).otherwise(acc)

    return F.aggregate(arr, F.lit(0), advance)


def _bucketed(df: DataFrame, value: Column, keys: Sequence[str], probs: Sequence[float], accuracy: int, small: bool) -> DataFrame:
    """All non-null values with the number of the sketch's breaks (its quantiles at ``probs``) below them (few breaks:
    twice that, and one more for a value that is a break).

    The sketch has one row per group; ``small`` says the number of groups is
    bounded by the configuration (not by the data), so it is broadcast.
    """
    v = df.select(*keys, value.cast("double").alias(V)).where(F.col(V).isNotNull())
    sk = v.groupBy(*keys).agg(F.percentile_approx(V, F.array(*[F.lit(p) for p in probs]), accuracy).alias("_br"))
    if keys:
        vb = join_groups(v, sk, keys, broadcast=small)
    else:
        vb = v.withColumn("_br", sk.scalar())
    if len(probs) <= FEW:  # plain comparisons, compiled
        below = sum((F.when(F.get("_br", F.lit(i)) < F.col(V), 1).otherwise(0) for i in range(len(probs))), F.lit(0))
        # a value that is a break has a bucket of its own: ties make the target a break, which would take all below it along
        below = 2 * below + F.when(F.array_contains("_br", F.col(V)), 1).otherwise(0)
    else:
        below = breaks_below(F.col("_br"), F.col(V), len(probs))
    return vb.select(*keys, below.alias(B), V)


def _distinct(values: DataFrame, keys: Sequence[str], *others: str) -> DataFrame:
    """Distinct values per (group, bucket) with their multiplicity; ``others`` are columns that a bucket determines."""
    return values.groupBy(*keys, B, V).agg(F.count(F.lit(1)).alias(CNT), *[F.first(o).alias(o) for o in others])


def _offsets(totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Buckets' sizes ``_bc`` -> also the rank offset ``_off`` and the group size ``_n``."""
    w = Window.partitionBy(*keys).orderBy(B)
    return totals.select(*keys, B, "_bc",
                         F.coalesce(F.sum("_bc").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                                    F.lit(0)).alias("_off"),
                         F.sum("_bc").over(Window.partitionBy(*keys)).alias("_n"))


def _ranked_values(d: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct values with the 0-based rank range ``[_lo, _hi)`` they cover
    (``d`` carries its bucket's ``_off``)."""
    w = Window.partitionBy(*keys, B).orderBy(V).rowsBetween(Window.unboundedPreceding, 0)
    cum = F.sum(CNT).over(w)
    return d.select("*", (F.col("_off") + cum - F.col(CNT)).alias("_lo"), (F.col("_off") + cum).alias("_hi"))


def exact_quantiles(df: DataFrame, value: Column, probs: Sequence[float], keys: Sequence[str] = (),
                    accuracy: int = ACCURACY, name: str = "quantiles", small_groups: bool = False) -> DataFrame:
    """Per group of ``keys``: ``name`` = array of exact linear quantiles at ``probs``.

    Groups without a non-null value are absent (callers left-join).
    ``small_groups`` declares that the number of groups is bounded by the
    configuration (e.g. one per report column), so per-group tables are
    broadcast; otherwise joins are left to AQE.
    """
    small = small_groups or not keys
    keys = list(keys)
    edges = sorted({min(max(p + side * 2 / accuracy, 0.0), 1.0) for p in probs for side in (-1, 1)})
    bucketed = _bucketed(df, value, keys, edges, accuracy, small)
    offsets = _offsets(bucketed.groupBy(*keys, B).agg(F.count(F.lit(1)).alias("_bc")), keys)
    n1 = F.col("_n") - 1
    targets = F.array_distinct(F.array(*[t for p in probs for t in (F.floor(F.lit(float(p)) * n1),
                                                                     F.ceil(F.lit(float(p)) * n1))]))
    need = offsets.select(*keys, B, "_off", "_n", F.filter(targets.cast("array<long>"), lambda k: (
        k >= F.col("_off")) & (k < F.col("_off") + F.col("_bc"))).alias("_ks")).where(F.size("_ks") > 0)
    # only these bands' values are shuffled, whatever else the data holds
    wanted = join_groups(bucketed, need, [*keys, B], broadcast=small)
    ranked = _ranked_values(_distinct(wanted, keys, "_off", "_n", "_ks"), keys)
    hits = ranked.select(*keys, "_n", F.explode(F.filter("_ks", lambda k: (k >= F.col("_lo")) & (
        k < F.col("_hi")))).alias("_qk"), V)
    at = hits.groupBy(*keys).agg(F.first("_n").alias("_n"),
                                 F.map_from_entries(F.collect_list(F.struct("_qk", V))).alias("_m"))
    qs = []
    for p in probs:
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        lo_k, hi_k = F.floor(pos), F.ceil(pos)
        lo_v, hi_v = F.element_at("_m", lo_k.cast("long")), F.element_at("_m", hi_k.cast("long"))
        qs.append(lo_v + (hi_v - lo_v) * (pos - lo_k))
    out = at.select(*keys, F.array(*qs).alias(name))
    return out if keys else out.where(F.col(name)[0].isNotNull())


def average_ranks(df: DataFrame, value: str, keys: Sequence[str] = (), buckets: int = BUCKETS,
                  accuracy: int = ACCURACY, name: str = "rank", small_groups: bool = False) -> DataFrame:
    """Per group of ``keys``: every distinct non-null ``value`` with its 1-based
    average rank (ties share the mean of their positions)."""
    small = small_groups or not keys
    keys = list(keys)
    probs = [i / buckets for i in range(1, buckets)]
    distinct = _distinct(_bucketed(df, F.col(f"`{value}`"), keys, probs, accuracy, small), keys)
    offsets = _offsets(distinct.groupBy(*keys, B).agg(F.sum(CNT).alias("_bc")), keys).select(*keys, B, "_off")
    ranked = _ranked_values(join_groups(distinct, offsets, [*keys, B], broadcast=small), keys)
    avg = F.col("_lo") + (F.col(CNT) + 1) / 2.0
    return ranked.select(*keys, F.col(V).alias(value), avg.alias(name))
