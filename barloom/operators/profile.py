"""Price profiles of groups of bars: how much fell into each of equal bins, the fullest bin, and the value area around it.

Two passes: the range of each group, then counts by group and bin, which Spark adds up before the shuffle. The range
is worked out in spans of time and joined back by them, so a group that holds most bars is many tasks' work. Only
the bins of a group, at most ``bins`` rows, ever stand together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import span_of_time

#: Bins of a profile, and the part of the whole that a value area holds.
BINS, VALUE = 20, 0.7


def price_profile(bars: DataFrame, keys: list[str], bins: int = BINS, price: str = "close", weight: str | None = None) -> DataFrame:
    """(keys, low, width, bin, amount): the bars of each bin, or the sum of their ``weight``.

    Bins are closed below, the last one on both sides; a group of one price has bin 0 and width 0. Empty bins
    have no row. Bars without a price, or that lack a key, are left out; a weight that is missing or NaN counts 0.
    """
    p = F.nanvl(F.col(price).cast("double"), F.lit(None).cast("double"))
    amount = F.lit(1.0) if weight is None else F.coalesce(F.nanvl(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = bars.select(*keys, span_of_time().alias("_span"), p.alias("_p"), amount.alias("_amount")).filter(F.col("_p").isNotNull())
    group = Window.partitionBy(*keys)
    spans = rows.groupBy(*keys, "_span").agg(F.min("_p").alias("_low"), F.max("_p").alias("_high"))
    spans = spans.select(*keys, "_span", F.min("_low").over(group).alias("low"), F.max("_high").over(group).alias("_top"))
    spans = spans.select(*keys, "_span", "low", ((F.col("_top") - F.col("low")) / bins).alias("width"))
    at = F.least(F.coalesce(F.floor(F.try_divide(F.col("_p") - F.col("low"), F.col("width"))), F.lit(0)), F.lit(bins - 1)).cast("int")
    return rows.join(spans, [*keys, "_span"]).groupBy(*keys, "low", "width", at.alias("bin")).agg(F.sum("_amount").alias("amount"))


def value_area(profile: DataFrame, keys: list[str], bins: int = BINS, part: float = VALUE) -> DataFrame:
    """(keys, low, width, total, poc, value_low, value_high, value_amount) of each group of a profile.

    ``poc`` is the lower edge of the fullest bin, the lowest of equal ones. The value area starts as that bin and takes
    the fuller of its two neighbours, the upper one if they are equal, until it holds ``part`` of the total.
    """
    bars = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.coalesce(F.element_at("_have", k), F.lit(0.0)))
    rows = profile.groupBy(*keys, "low", "width").agg(F.map_from_entries(F.collect_list(F.struct("bin", "amount"))).alias("_have"))
    rows = rows.select(*keys, "low", "width", bars.alias("_bars"))
    rows = rows.withColumns({"total": F.aggregate("_bars", F.lit(0.0), lambda a, x: a + x), "_poc": (F.array_position("_bars", F.array_max("_bars")) - 1).cast("int")})
    area = F.aggregate(F.sequence(F.lit(2), F.lit(bins)) if bins > 1 else F.array().cast("array<int>"), _area("_poc", "_poc", F.get("_bars", F.col("_poc"))), lambda a, _: _grown(a, part))
    edge = lambda at: F.col("low") + at * F.col("width")
    rows = rows.withColumn("_area", area)
    return rows.select(*keys, "low", "width", "total", edge(F.col("_poc")).alias("poc"), edge(F.col("_area.first")).alias("value_low"), edge(F.col("_area.last") + 1).alias("value_high"), F.col("_area.amount").alias("value_amount"))


def _area(first: str | Column, last: str | Column, amount: Column) -> Column:
    first, last = (F.col(x) if isinstance(x, str) else x for x in (first, last))
    return F.struct(first.alias("first"), last.alias("last"), amount.alias("amount"))


def _grown(area: Column, part: float) -> Column:
    """The area with one bin more, unless it holds enough."""
    below, above = (F.coalesce(F.get("_bars", at), F.lit(-1.0)) for at in (area["first"] - 1, area["last"] + 1))
    down = _area(area["first"] - 1, area["last"], area["amount"] + below)
    up = _area(area["first"], area["last"] + 1, area["amount"] + above)
    return F.when((area["amount"] >= F.col("total") * part) | ((below < 0) & (above < 0)), area).when(below > above, down).otherwise(up)
