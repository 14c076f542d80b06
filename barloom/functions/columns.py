"""Scalar columns of a bar and window helpers over a bar series.

A series is one (market, timeframe), or (market, timeframe, period_days) after the look-back fan-out;
``bar_idx`` counts its bars from 0. All helpers share one window specification, so that Spark plans a
single exchange and sort for any number of them. No window sorts a whole series in one task: bars are
numbered in spans of time, and windows run over pieces of a series, each with copies of the bars before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("market", "timeframe", "period_days", "_piece")
PRICES = ("open", "high", "low", "close", "volume")


def series_keys(df: DataFrame) -> list[str]:
    """The columns that tell the series of a frame apart."""
    return [k for k in KEYS if k in df.columns]


def in_order(df: DataFrame):
    return Window.partitionBy(*series_keys(df)).orderBy("ts")


#: Days of a span in which bars are numbered, and bars of a piece.
SPAN_DAYS, PIECE = 7, 8192


def span_of_time() -> Column:
    """The number of the span that a bar's time lies in; bars without time come first."""
    return F.coalesce(F.floor(F.unix_seconds("ts") / (86_400 * SPAN_DAYS)), F.lit(-(2**40)))


def with_bar_idx(df: DataFrame) -> DataFrame:
    """Adds the 0-based position of each bar in its series: that in its span of time, after the bars of the spans before.

    Bars that lack a key of their series are left out.
    """
    keys = series_keys(df)
    rows = df.withColumn("_span", span_of_time())
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))
    spans = rows.groupBy(*keys, "_span").agg(F.count("*").alias("_n")).select(*keys, "_span", F.coalesce(before, F.lit(0)).alias("_before"))
    rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*keys, "_span").orderBy("ts")))
    return rows.join(spans, [*keys, "_span"]).select(*(c for c in df.columns if c != "bar_idx"), (F.col("_before") + F.col("_at") - 1).cast("int").alias("bar_idx"))


def in_pieces(df: DataFrame, before: int, after: int = 0, size: int | None = None) -> DataFrame:
    """Every bar in its piece of ``size`` bars, and again in the pieces that begin up to ``before`` bars later or ended up to ``after`` bars before it.

    Pieces are series of their own to all helpers here. Windows that reach no farther give the bars ``at_home``
    what they give over whole series.
    """
    i, size = F.col("bar_idx"), size or PIECE
    piece = lambda at: F.floor(at / size).cast("int")
    return df.withColumn("_piece", F.explode(F.sequence(F.greatest(piece(i - after), F.lit(0)), piece(i + before))))


def at_home(df: DataFrame, size: int | None = None) -> DataFrame:
    """The bars of each piece without those that are there as neighbours."""
    return df.filter(F.floor(F.col("bar_idx") / (size or PIECE)) == F.col("_piece")).drop("_piece")


def no_nan(df: DataFrame) -> DataFrame:
    """NaN becomes null in the price columns; Spark would order NaN above every number."""
    return df.withColumns({c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in PRICES})


def typical_price() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def with_shape(df: DataFrame) -> DataFrame:
    """Adds body, range, wicks, midpoints and the bounds of the body of each bar."""
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return df.withColumns({
        "body": F.abs(c - o), "rng": h - low, "upper_wick": h - F.greatest(o, c), "lower_wick": F.least(o, c) - low,
        "mid": (h + low) / 2, "mid_body": (o + c) / 2, "min_body": F.least(o, c), "max_body": F.greatest(o, c),
    })
