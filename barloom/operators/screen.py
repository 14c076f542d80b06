"""Consistency screen of strategies over their look-back windows, and the tables of a report."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.metrics import overall


@dataclass(frozen=True)
class Limits:
    """Thresholds of the screen; ``targets`` are returns in percent by window, others are exempt."""

    drawdown: float = 22.0
    single_trade: float = 35.0
    expectancy: float = 0.5
    win_rate: float = 54.0
    profit_factor: float = 1.8
    failures: int = 1
    targets: dict[int, float] = field(default_factory=lambda: {30: 1.06, 60: 1.5, 180: 2.75, 365: 4.50})


def screen(results: DataFrame, limits: Limits | None = None) -> DataFrame:
    """One row for each strategy: its overall figures, ``failures`` in a fixed order, and ``passed``."""
    limits = limits or Limits()
    target = F.create_map(*(F.lit(x) for pair in limits.targets.items() for x in pair))
    wanted = F.element_at(target, F.col("period_days"))
    rows = overall(
        results,
        F.bool_and(F.col("max_drawdown_percent") <= limits.drawdown).alias("low_drawdown"),
        F.bool_and(wanted.isNull() | (F.col("total_pnl_percent") >= wanted)).alias("on_target"),
        F.bool_and(F.col("largest_win_contribution") <= limits.single_trade).alias("spread"),
    )
    text = lambda name, value, digits=2: F.concat(F.lit(f"{name}: "), F.format_number(value, digits))
    failures = F.array_compact(F.array(
        F.when(~F.col("all_periods_profitable"), F.lit("not profitable in every period")),
        F.when(~F.col("low_drawdown"), text("drawdown", F.col("worst_drawdown"))),
        F.when(F.col("avg_expectancy") < limits.expectancy, text("expectancy", F.col("avg_expectancy"))),
        F.when(F.col("avg_win_rate") < limits.win_rate, text("win rate", F.col("avg_win_rate"), 1)),
        F.when(F.col("avg_profit_factor") < limits.profit_factor, text("profit factor", F.col("avg_profit_factor"))),
        F.when(~F.col("on_target"), F.lit("below the return target")),
        F.when(~F.col("spread"), F.lit("rests on a single trade")),
    ))
    return rows.withColumn("failures", failures).withColumn("passed", F.size("failures") <= limits.failures)


def passing(results: DataFrame, limits: Limits | None = None) -> DataFrame:
    return screen(results, limits).filter("passed")


METRICS = ("total_pnl_percent", "win_rate", "profit_factor", "max_drawdown_percent", "total_trades")


def comparison(results: DataFrame, periods: tuple[int, ...] = (30, 60, 180, 365)) -> DataFrame:
    """Metrics by window: a row for each strategy and metric, a column for each window; null where there is none."""
    pairs = ", ".join(f"'{m}', CAST({m} AS DOUBLE)" for m in METRICS)
    long = results.selectExpr("strategy_id", "period_days", f"stack({len(METRICS)}, {pairs}) AS (metric, value)")
    wide = long.groupBy("strategy_id", "metric").pivot("period_days", list(periods)).agg(F.first("value"))
    return wide.select("strategy_id", "metric", *(F.col(str(p)).alias(f"days_{p}") for p in periods))


# What a rule's text must hold for a concept.
CONCEPTS = (
    "order_block", "liquidity_sweep", "sweep", "imbalance", "market_structure_shift", "breaker", "is_in_", "is_in_discount", "is_in_premium",
    "optimal_trade_entry", "inducement", "kill_zone", "choch", "mitigation", "amd", "ifvg", "turtle", "rejection", "propulsion", "void", "bpr",
    "volume_imbalance", "mean_threshold", "unicorn", "silver_bullet", "gap_reclaim", "reclaimed_block", "wick_ce", "order_flow", "sponsor",
    "range_rotation", "snap_back", "quarterly_shift", "std_dev", "po3_swing", "inst_swing", "smt_div", "macro", "liq_run", "stops_hunt", "eq_reclaim",
    "partial_void", "fractal_exp", "ib_breakout", "orb", "daily_open_rej", "pwh_pwl", "pdh_pdl", "sfp", "impulse", "psych_level", "tl_liquidity",
    "failed_auction", "turtle_soup", "decoupled_ob", "propulsion_candle", "eng_liquidity", "mitigation_block", "rejection_block", "nwog", "vol_void",
    "dragon", "quasimodo", "triple_tap", "compression", "master_pattern", "vol_imbalance", "judas", "3c_rev", "ote", "dr_range", "cpr", "value_area",
    "poc", "poor_high_low", "single_prints", "tails", "composite_op", "dist_accum", "spring_upthrust", "sign_of_strength", "last_point_support",
    "effort_result", "stopping_vol", "vsa_patterns", "climax_logic",
)


def concept_tags(strategies: DataFrame, concepts: list[str] | None = None) -> DataFrame:
    """(strategy_id, concept) for every concept that some entry rule names."""
    names = F.array(*(F.lit(c) for c in concepts or CONCEPTS))
    found = F.filter(names, lambda c: F.exists("entry_rules", lambda r: F.contains(r, c)))
    return strategies.select("strategy_id", F.explode(found).alias("concept"))


def trade_marks(bars: DataFrame, trades: DataFrame) -> DataFrame:
    """Bars at which trades begin or end, with the trade's side: the data behind a price chart."""
    keys = ["market", "timeframe", "period_days"]
    mark = lambda kind, idx, price: trades.select(*keys, F.col(idx).alias("bar_idx"), F.lit(kind).alias("mark"), "strategy_id", "direction", F.col(price).alias("price"))
    return bars.join(mark("entry", "entry_idx", "entry_price").unionAll(mark("exit", "exit_idx", "exit_price")), [*keys, "bar_idx"])


def run_summary(generated: DataFrame, validated: DataFrame, results: DataFrame, screened: DataFrame) -> DataFrame:
    """How many strategies each stage of a run kept, in one row."""
    count = lambda df, name, where: df.agg(F.count_if(where).alias(name))
    yes = F.lit(True)
    parts = [count(generated, "generated", yes), count(validated, "validated", F.col("valid")), results.agg(F.countDistinct("strategy_id").alias("backtested")), count(screened, "passed", F.col("passed"))]
    tagged = [p.select(F.lit(1).alias("one"), "*") for p in parts]
    out = tagged[0]
    for p in tagged[1:]:
        out = out.join(p, "one")
    return out.drop("one")

