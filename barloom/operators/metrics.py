"""Performance of trades: per strategy and look-back window, and over the windows of a strategy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CAPITAL = 100_000.0
#: What stands for an infinite profit factor.
NO_LOSS = 10.0
GROUP = ("strategy_id", "period_days")


def equity_curve(trades: DataFrame) -> DataFrame:
    """Adds trade_no from 1, equity after the trade, its running peak (at least 0) and the drop from it."""
    # Trades of several series of a window are one account: they count in the order in which they end.
    w = Window.partitionBy(*GROUP).orderBy("exit_time", "market", "timeframe", "entry_idx")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = trades.withColumn("trade_no", F.row_number().over(w)).withColumn("equity", F.sum("pnl").over(so_far))
    rows = rows.withColumn("peak", F.greatest(F.max("equity").over(so_far), F.lit(0.0)))
    return rows.withColumn("drawdown", F.col("peak") - F.col("equity"))


def _if_any(condition: Column, value: Column) -> Column:
    return F.coalesce(F.when(condition, value), F.lit(0.0))


def period_metrics(trades: DataFrame, strategies: DataFrame | None = None, periods: tuple[int, ...] = (), curve: bool = False) -> DataFrame:
    """One row for each strategy and window. With ``strategies`` and ``periods`` windows without trades have a row of zeros.

    A trade wins with pnl > 0 and loses otherwise; percentages add up and are not compounded.
    """
    rows = equity_curve(trades)
    won = F.col("pnl") > 0
    profit, loss = F.coalesce(F.sum(F.when(won, F.col("pnl"))), F.lit(0.0)), F.abs(F.coalesce(F.sum(F.when(~won, F.col("pnl"))), F.lit(0.0)))
    more = [F.concat(F.array(F.lit(0.0)), F.transform(F.array_sort(F.collect_list(F.struct("trade_no", "equity"))), lambda x: x["equity"])).alias("equity_curve")] if curve else []
    rows = rows.groupBy(*GROUP).agg(
        F.count("*").alias("total_trades"), F.count_if(won).alias("winning_trades"), F.count_if(~won).alias("losing_trades"),
        F.sum("pnl").alias("total_pnl"), F.sum("pnl_percent").alias("total_pnl_percent"), profit.alias("gross_profit"), loss.alias("gross_loss"),
        F.coalesce(F.max(F.when(won, F.col("pnl"))), F.lit(0.0)).alias("largest_win"), F.abs(F.coalesce(F.min(F.when(~won, F.col("pnl"))), F.lit(0.0))).alias("largest_loss"),
        F.greatest(F.max("drawdown"), F.lit(0.0)).alias("max_drawdown"), *more,
    )
    if strategies is not None:
        every = strategies.select("strategy_id").distinct().withColumn("period_days", F.explode(F.array(*map(F.lit, periods))))
        rows = every.join(rows, [*GROUP], "left")
        rows = rows.fillna(0.0).fillna(0, ["total_trades", "winning_trades", "losing_trades"])
        if curve:
            rows = rows.withColumn("equity_curve", F.coalesce("equity_curve", F.array(F.lit(0.0))))
    n, wins, losses = F.col("total_trades"), F.col("winning_trades"), F.col("losing_trades")
    rows = rows.withColumns({
        "win_rate": _if_any(n > 0, wins / n * 100), "avg_win": _if_any(wins > 0, F.col("gross_profit") / wins), "avg_loss": _if_any(losses > 0, F.col("gross_loss") / losses),
        "largest_win_contribution": _if_any(F.col("gross_profit") > 0, F.col("largest_win") / F.col("gross_profit") * 100),
        "profit_factor": F.when(n == 0, F.lit(0.0)).when(F.col("gross_loss") == 0, F.lit(NO_LOSS)).otherwise(F.try_divide("gross_profit", "gross_loss")),
        "max_drawdown_percent": F.col("max_drawdown") / CAPITAL * 100,
    })
    share = F.col("win_rate") / 100
    return rows.withColumn("expectancy", share * F.col("avg_win") - (1 - share) * F.col("avg_loss"))


def overall(results: DataFrame, *more: Column) -> DataFrame:
    """Over the windows of each strategy: all profitable, worst drawdown, means, and trades of a year; ``more`` aggregates in the same pass."""
    n = lambda days, times: times * F.max(F.when(F.col("period_days") == days, F.col("total_trades")))
    factor = F.avg(F.when(F.col("profit_factor") > 0, F.col("profit_factor")))
    return results.groupBy("strategy_id").agg(
        F.bool_and(F.col("total_pnl") > 0).alias("all_periods_profitable"), F.max("max_drawdown_percent").alias("worst_drawdown"), F.avg("win_rate").alias("avg_win_rate"),
        F.avg("expectancy").alias("avg_expectancy"), F.coalesce(factor, F.lit(0.0)).alias("avg_profit_factor"), F.coalesce(n(365, 1), n(180, 2), n(60, 6), F.lit(0)).alias("total_trades_per_year"), *more,
    )


def thin_curve(curve: str | Column, most: int = 100) -> Column:
    """Every ``size div most``-th point of a longer curve."""
    curve = F.col(curve) if isinstance(curve, str) else curve
    step = F.greatest(F.lit(1), F.floor(F.size(curve) / most))
    return F.when(F.size(curve) > most, F.filter(curve, lambda x, i: i % step == 0)).otherwise(curve)
