"""Option chain -> at-the-money straddles held to expiry.

Plan shape for the full straddle build, whatever the number of underlyings:

* the option chain is scanned once, with ``securityid IN (...)`` and
  ``date >= min_date`` pushed into the parquet reader, and joined to the daily
  closes on ``(securityid, date)``.  Both tables are meant to be bucketed by these two columns
  (``sources.sinks.write_bucketed``): then neither the join nor the choice of legs
  moves a quote.  The key includes ``date``, so one hot underlying still spreads over all
  its trading days.  Without buckets, the planner broadcasts closes that are measured small and shuffles
  the quotes once;
* open and close legs are tagged in one pass: a window over ``(securityid, date, okey_cp)`` ranks the
  open quotes, and its first row takes the expiry-day quotes along; all others are dropped next to the scan;
* what is left -- for each day and type the open leg, and for each day the expiry-day quotes in arrays -- meets by
  ``(securityid, ends)`` in one exchange: a window collects the closing quotes of an expiry, a
  few, for its open legs, which keep those of their strike (the reference's left join followed by an any-null filter);
* the call/put pivot is a conditional aggregation, which also absorbs the
  whole-row de-duplication and raises on conflicting duplicates.

The legs alone (C2) are a grouped ``min(struct(...))``, reduced map-side where quotes must move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thetaflow.functions.columns import all_not_null
from thetaflow.params import StraddleParams

STRIKE_SCALE = 1 / 1000  # strikes are stored in thousandths of a point


def wanted(params: StraddleParams):
    """Predicate for the underlyings asked for; all of them if none are named."""
    if params.underlyings is None:
        return F.col("securityid").isNotNull()
    return F.col("securityid").isin([int(i) for i in params.underlyings])


def of_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """P1 by table: the rows of the underlyings that ``ids`` (a ``securityid`` column) lists.

    A left-semi join, so repeated ids repeat no row, null ids match none, and no list of ids
    passes through the driver; the planner broadcasts the ids only if they are small.
    """
    return rows.join(ids.select(F.col("securityid").cast(rows.schema["securityid"].dataType)), "securityid", "left_semi")


def base_chain(options: DataFrame, prices: DataFrame,
               params: StraddleParams = StraddleParams()) -> DataFrame:
    """Option quotes joined to the underlying close of the same day.

    Columns: securityid, okey_cp, okey_xx (raw strike), date, expiration,
    sprc (mid quote), uprc (underlying close), strike.
    """
    opt = (
        options.where(wanted(params))
        .where(F.col("date") >= F.lit(params.min_date))
        .select(
            "securityid",
            F.col("callput").alias("okey_cp"),
            F.col("strike"),
            "date",
            "expiration",
            ((F.col("bestbid") + F.col("bestoffer")) / 2).alias("sprc"),
        )
    )
    px = prices.where(wanted(params)).select(
        "securityid", "date", F.col("closeprice").alias("uprc"))
    return opt.join(px, ["securityid", "date"], "inner").select(
        "securityid", "okey_cp", F.col("strike").alias("okey_xx"), "date",
        "expiration", "sprc", "uprc", "strike",
    )


def _with_tte(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "time_to_expiration": F.datediff("expiration", "date"),
        "okey_xx": F.col("strike") * F.lit(STRIKE_SCALE),
    })


def open_legs(options: DataFrame, prices: DataFrame,
              params: StraddleParams = StraddleParams(), keep_strike: bool = False) -> DataFrame:
    """Per (securityid, date, okey_cp) the leg closest to the money.

    Order: distance to strike, then days to expiry (distance ranks before
    tenor), then strike and mid quote as a deterministic tiebreak; null
    distances rank first as in the reference's ascending sort.
    """
    return _open_from(_with_tte(base_chain(options, prices, params)), keep_strike)


def _open_from(base: DataFrame, keep_strike: bool) -> DataFrame:
    legs = base.where(F.col("time_to_expiration") > 0)
    legs = legs.withColumn("dist_to_strike", F.abs(F.col("okey_xx") - F.col("uprc")))
    best = F.min(F.struct(
        "dist_to_strike", "time_to_expiration", "strike", "sprc",
        "okey_xx", "expiration", "uprc",
    )).alias("best")
    cols = ["securityid", "date", "okey_cp", "best.okey_xx", "best.expiration", "best.sprc",
            "best.uprc", "best.time_to_expiration", "best.dist_to_strike"]
    if keep_strike:
        cols.append("best.strike")
    return legs.groupBy("securityid", "date", "okey_cp").agg(best).select(*cols)


def close_legs(options: DataFrame, prices: DataFrame,
               params: StraddleParams = StraddleParams(), keep_strike: bool = False) -> DataFrame:
    """Quotes with less than one day to expiry (0 and negative included)."""
    return _close_from(_with_tte(base_chain(options, prices, params)), keep_strike)


def _close_from(base: DataFrame, keep_strike: bool) -> DataFrame:
    legs = base.where(F.col("time_to_expiration") < 1)
    cols = ["securityid", "okey_cp", "okey_xx", "date", "expiration", "sprc", "uprc",
            "time_to_expiration"]
    return legs.select(*(cols + (["strike"] if keep_strike else [])))


MERGED_COLS = ["securityid", "date", "okey_cp", "okey_xx", "expiration", "sprc_day_0",
               "uprc_day_0", "dist_to_strike", "sprc_day_1", "uprc_day_1"]


def _paired(options: DataFrame, prices: DataFrame, params: StraddleParams) -> DataFrame:
    tte, dist = F.col("time_to_expiration"), F.abs(F.col("okey_xx") - F.col("uprc"))
    quotes = _with_tte(base_chain(options, prices, params)).where(tte.isNotNull()).withColumns(
        {"is_open": tte > 0, "dist_to_strike": dist})
    # open quotes first: the first row is the day's open leg, if there is one, and takes the closing quotes of its type along
    day = Window.partitionBy("securityid", "date", "okey_cp").orderBy(
        F.desc("is_open"), *[F.asc_nulls_first(x) for x in ("dist_to_strike", "time_to_expiration", "strike", "sprc", "expiration", "uprc")])
    opened, quote = F.col("is_open"), ["strike", "sprc", "uprc"]
    closing = F.collect_list(F.when(~opened & all_not_null(quote), F.struct(*quote)))
    legs = quotes.withColumns({
        "place": F.row_number().over(day),
        "close": closing.over(day.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))}).where("place = 1")
    # A day's closing quotes, of all types, travel as one row of arrays.
    days = legs.groupBy("securityid", "date").agg(
        F.collect_list(F.when(opened, F.struct(F.col("expiration").alias("ends"), "okey_cp", *quote))).alias("open"),
        F.collect_list(F.when(F.size("close") > 0, F.struct("okey_cp", *[F.col(f"close.{x}").alias(x) for x in quote]))).alias("close"))
    nothing = F.lit(None).cast(days.schema["close"].dataType)
    moved = days.select("securityid", "date", F.inline(F.concat(
        F.transform("open", lambda x: F.struct(*[x[k].alias(k) for k in ("ends", "okey_cp", *quote)], nothing.alias("close"))),
        F.when(F.size("close") > 0, F.array(F.struct(
            F.col("date").alias("ends"), F.lit(None).cast("string").alias("okey_cp"), F.lit(None).cast("bigint").alias("strike"),
            F.lit(None).cast("double").alias("sprc"), F.lit(None).cast("double").alias("uprc"), "close"))).otherwise(F.array()))))
    moved = moved.repartition("securityid", "ends")  # the pivot groups by these too
    closes = F.flatten(F.collect_list("close").over(Window.partitionBy("securityid", "ends")))
    held = moved.withColumn("closes", closes).where("close IS NULL").select(
        "securityid", "date", "okey_cp", "strike", F.col("ends").alias("expiration"), F.col("sprc").alias("sprc_day_0"),
        F.col("uprc").alias("uprc_day_0"), F.inline("closes").alias("type", "strikes", "sprcs", "uprcs"))
    ended = F.inline(F.arrays_zip("strikes", "sprcs", "uprcs")).alias("closed", "sprc_day_1", "uprc_day_1")
    held = held.where(F.col("type") == F.col("okey_cp")).select(
        *[x for x in held.columns if x not in ("type", "strikes", "sprcs", "uprcs")], ended).where(F.col("closed") == F.col("strike"))
    xx = F.col("strike") * F.lit(STRIKE_SCALE)
    paired = held.withColumns({"okey_xx": xx, "dist_to_strike": F.abs(xx - F.col("uprc_day_0"))}).select(*MERGED_COLS)
    # Left join + "reject any null" in the reference == inner join + not-null.
    paired = paired.where(~F.col("date").isin(list(params.date_problems)))
    return paired.where(all_not_null(MERGED_COLS))


def merge_legs(options: DataFrame, prices: DataFrame,
               params: StraddleParams = StraddleParams()) -> DataFrame:
    """Open legs paired with their expiry-day quotes, de-duplicated."""
    return _paired(options, prices, params).distinct()


PIVOT_INDEX = ["securityid", "date", "okey_xx", "uprc_day_0", "expiration",
               "dist_to_strike", "uprc_day_1"]


def _one_value(cp: str, col: str, on_conflict: str = "raise"):
    """Pivot cell: the single value of ``col`` for ``okey_cp == cp``.

    Exact duplicates collapse (the reference de-duplicates whole rows first).
    Two different values for one cell are an error, as in a pivot without an
    aggregate function (``on_conflict="raise"``); ``"min"`` keeps the smaller
    value instead, so one bad quote cannot fail a whole run.
    """
    v = F.when(F.col("okey_cp") == cp, F.col(col))
    lo, hi = F.min(v), F.max(v)
    if on_conflict == "min":
        return lo.cast("double").alias(f"{col}_{cp}")
    if on_conflict != "raise":
        raise ValueError("on_conflict must be 'raise' or 'min'")
    return (F.when(lo != hi, F.raise_error(F.lit(f"pivot: several {col} values for {cp}")))
            .otherwise(lo).cast("double").alias(f"{col}_{cp}"))


def pivot_legs(merged: DataFrame, on_conflict: str = "raise") -> DataFrame:
    """A4: calls and puts side by side; rows missing either leg are dropped."""
    cells = [_one_value(cp, col, on_conflict) for col in ("sprc_day_0", "sprc_day_1") for cp in ("C", "P")]
    out = merged.groupBy(*PIVOT_INDEX).agg(*cells)
    names = [f"{c}_{cp}" for c in ("sprc_day_0", "sprc_day_1") for cp in ("C", "P")]
    return out.where(all_not_null(names))


def add_straddle_prices(pivoted: DataFrame) -> DataFrame:
    """straddle = call + put on both days; intrinsic value at expiry."""
    needed = ["sprc_day_0_C", "sprc_day_0_P", "sprc_day_1_C", "sprc_day_1_P", "uprc_day_1", "okey_xx"]
    if any(c not in pivoted.columns for c in needed):
        return pivoted
    return pivoted.withColumns({
        "straddle_day_0": F.col("sprc_day_0_C") + F.col("sprc_day_0_P"),
        "straddle_day_1": F.col("sprc_day_1_C") + F.col("sprc_day_1_P"),
        "uprc_diff": F.abs(F.col("uprc_day_1") - F.col("okey_xx")),
    })


def straddles(options: DataFrame, prices: DataFrame,
              params: StraddleParams = StraddleParams(), on_conflict: str = "raise") -> DataFrame:
    """C4: one at-the-money straddle per underlying and trading day."""
    return add_straddle_prices(pivot_legs(_paired(options, prices, params), on_conflict))
