"""The registered queries over the driver's tables, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.columns import with_bar_idx, with_shape
from barloom.operators import grid as g
from barloom.operators import indicators as ind
from barloom.operators import learning, metrics, profile
from barloom.operators import screen as sc
from barloom.operators.detectors import DETECTORS, array_detector, steady, with_detectors
from barloom.operators.rules import describe, detectors_of, entries, rule_hits, validate
from barloom.operators.trades import scan_trades, with_levels
from barloom.plans import detector_sql as ds
from barloom.plans import twins
from barloom.plans.research import backtest, numbered, scan_with_exits
from barloom.sources import bars as src
from barloom.sources import repository as repo

#: Look-back windows for the 30 days of events.
PERIODS = (7, 14, 21, 30)
EMAS = ((9, 21), (13, 34))
#: Event ids, one after the other, whose candles make up a payload.
PAYLOAD_IDS = 1_000
#: Rules of the strategies that the backtest queries run.
RULES = ("ema_fast_above_slow", "ema_fast_below_slow", "price_above_both_emas", "price_below_both_emas", "price_above_vwap", "price_below_vwap", "rsi_above_30", "rsi_below_70", "breakout_above_20bar_high", "detect_liquidity_sweep_low", "detect_bullish_engulfing", "detect_bearish_engulfing", "detect_inside_bar", "detect_discount_zone")
#: Those that are worked out once for all look-back windows.
FIRED = steady(detectors_of(list(RULES)))
# Strategies as (id, entry rules, stop, risk-reward, fast, slow); all on 1-hour bars of every market.
STRATEGIES = (
    ("s01", ("ema_fast_above_slow", "price_above_both_emas"), "1.5x_atr_from_entry", 2.0, 9, 21),
    ("s02", ("ema_fast_below_slow", "price_below_both_emas"), "2x_atr_from_entry", 1.8, 9, 21),
    ("s03", ("breakout_above_20bar_high",), "0.5pct_from_entry", 3.0, 13, 34),
    ("s04", ("detect_liquidity_sweep_low",), "entry_candle_stop", 2.5, 9, 21),
    ("s05", ("detect_bullish_engulfing", "price_below_vwap"), "1pct_from_entry", 2.0, 13, 34),
    ("s06", ("detect_bearish_engulfing", "rsi_below_70"), "swing_point_stop", 2.0, 9, 21),
    ("s07", ("detect_inside_bar", "detect_discount_zone"), "1.5x_atr_from_entry", 2.0, 13, 34),
    ("s08", ("price_above_vwap", "rsi_above_30"), "2x_atr_from_entry", 1.5, 9, 21),
)
# Signal exits of some of the strategies, for the query that lets positions leave by them.
EXITS = {"s01": ("ema_crossover_reversal",), "s02": ("price_crosses_vwap_opposite",), "s03": ("end_of_session",), "s08": ("ema_crossover_reversal", "price_crosses_vwap_opposite", "end_of_session")}
# The rules that are no detectors.
TOKENS = (
    "ema_fast_above_slow", "ema_fast_below_slow", "price_above_both_emas", "price_below_both_emas", "price_above_ema_fast", "price_above_ema_slow", "price_below_ema_slow",
    "pullback_to_ema_fast", "rally_to_ema_fast", "price_above_vwap", "price_below_vwap", "pullback_to_vwap", "rally_to_vwap", "price_within_0.5pct_of_vwap",
    "close_above_vwap_upper_band", "close_below_vwap_lower_band", "rsi_oversold_bounce", "rsi_above_30", "rsi_below_70", "rsi_crossed_above_30", "rsi_crossed_below_70",
    "rsi_between_40_60", "breakout_above_20bar_high", "breakout_below_20bar_low", "price_near_support", "price_near_resistance", "is_in_kill_zone",
)
#: Look-back windows for the years of orders, and the sorts of strategies that are drawn.
LONG_PERIODS = (30, 60, 180, 365)
FOCUSES = ("balanced", "institutional", "price_action")
# Strategies whose rules the dispatch of ``compat`` takes as met or sees with high and low exchanged.
COMPAT_STRATEGIES = (
    ("c1", ("detect_mitigation_block_bullish", "price_above_vwap"), "1pct_from_entry", 2.0, 9, 21),
    ("c2", ("detect_stopping_volume_bullish",), "1.5x_atr_from_entry", 2.0, 13, 34),
)
LIMITS = sc.Limits(targets={7: 1.06, 14: 1.5, 21: 2.75, 30: 4.50})


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.bars_from_events(_read(spark, sf_dir, "events"), "1h")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.aggregate_bars(src.order_ticks(_read(spark, sf_dir, "orders")), "1d")


def strategies(spark: SparkSession, timeframe: str = "1h", more: tuple = ()) -> DataFrame:
    rows = [(i, i, list(e), ["stop_loss_hit", "take_profit_hit"], s, f"{rr}x_stop_distance", rr, timeframe, "*", f, w) for i, e, s, rr, f, w in (*STRATEGIES, *more)]
    return spark.createDataFrame(rows, "strategy_id string, name string, entry_rules array<string>, exit_rules array<string>, stop_loss_logic string, take_profit_logic string, risk_reward double, timeframe string, market string, ema_fast int, ema_slow int")


def shown(df: DataFrame, *columns: str) -> DataFrame:
    """Times as epoch seconds and doubles to 6 digits, which both engines print alike."""
    kinds = dict(df.dtypes)
    out = []
    for c in columns or df.columns:
        if kinds[c] == "timestamp":
            out.append(F.unix_timestamp(c).alias("ts_epoch" if c == "ts" else c))
        else:
            out.append(F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c))
    return df.select(*out)


# --- Sources -------------------------------------------------------------------------------------


def bars_1h(spark, sf_dir):
    return shown(hourly(spark, sf_dir))


def bars_5m(spark, sf_dir):
    return shown(src.bars_from_events(_read(spark, sf_dir, "events"), "5m"))


def bars_daily(spark, sf_dir):
    return shown(daily(spark, sf_dir))


def bars_lineitem(spark, sf_dir):
    return shown(src.aggregate_bars(src.lineitem_ticks(_read(spark, sf_dir, "lineitem")), "1d"))


def candle_payloads(events: DataFrame) -> DataFrame:
    """(market, timeframe, seq, payload): a text for each event type and PAYLOAD_IDS event ids, so none grows with the table."""
    events = events.filter("value IS NOT NULL AND ts IS NOT NULL")
    candle = F.array(F.unix_timestamp("ts").cast("double"), F.col("value"), F.col("value") + 1, F.col("value") - 1, F.col("value") / 2, F.lit(1.0))
    chunk = F.floor(F.col("event_id") / PAYLOAD_IDS).alias("seq")
    payloads = events.groupBy(F.col("event_type").alias("market"), chunk).agg(F.sort_array(F.collect_list(F.struct("event_id", candle.alias("c")))).alias("cs"))
    text = F.to_json(F.struct(F.lit("ok").alias("s"), F.transform("cs", lambda x: x["c"]).alias("candles")))
    return payloads.select("market", F.lit("1m").alias("timeframe"), "seq", text.alias("payload"))


def candles_decoded(spark, sf_dir):
    """Payload texts made of the events of each type, decoded; several candles of a second are kept once."""
    payloads = candle_payloads(_read(spark, sf_dir, "events"))
    return shown(src.first_per_timestamp(src.decode_candles(payloads), "seq", "at"))


def lookback_windows(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    rows = with_bar_idx(src.with_periods(bars, src.end_of(bars), PERIODS))
    return shown(rows.select("market", "period_days", "ts", "bar_idx", "close"))


def bar_shape(spark, sf_dir):
    return shown(with_shape(hourly(spark, sf_dir)).drop("timeframe", "open", "high", "low", "close", "volume"))


# --- Indicators ----------------------------------------------------------------------------------


def _indexed(spark, sf_dir):
    return with_bar_idx(hourly(spark, sf_dir))


def ind_sma(spark, sf_dir):
    return shown(ind.with_sma(ind.with_sma(_indexed(spark, sf_dir), 20), 50), "market", "ts", "sma_20", "sma_50")


def ind_ema(spark, sf_dir):
    return shown(ind.with_ema(_indexed(spark, sf_dir), 9, 13, 21, 34), "market", "ts", "ema_9", "ema_13", "ema_21", "ema_34")


def ind_rsi(spark, sf_dir):
    return shown(ind.with_rsi(_indexed(spark, sf_dir)), "market", "ts", "rsi_14")


def ind_atr(spark, sf_dir):
    return shown(ind.with_atr(_indexed(spark, sf_dir)), "market", "ts", "atr_14")


def ind_vwap(spark, sf_dir):
    return shown(ind.with_vwap(_indexed(spark, sf_dir)), "market", "ts", "vwap")


def ind_vwap_session(spark, sf_dir):
    return shown(ind.with_vwap(_indexed(spark, sf_dir), "Asia/Kolkata"), "market", "ts", "vwap")


def ind_bands(spark, sf_dir):
    return shown(ind.with_vwap_bands(ind.with_vwap(_indexed(spark, sf_dir))), "market", "ts", "vwap_upper", "vwap_lower")


# --- Detectors -----------------------------------------------------------------------------------


def names_of(kind: str) -> list[str]:
    return [n for n, d in DETECTORS.items() if d.kind == kind]


def _detected(kind: str):
    def query(spark, sf_dir):
        names = names_of(kind)
        return shown(with_detectors(_indexed(spark, sf_dir), names).select("market", "ts", *(f"detect_{n}" for n in names)))

    query.__name__ = f"det_{kind}"
    return query


def det_frequency(spark, sf_dir):
    """How often each detector of fixed distances and extremes fires in each market."""
    names = [*names_of("lag"), *names_of("minmax")]
    rows = with_detectors(_indexed(spark, sf_dir), names).groupBy("market").agg(*(F.count_if(F.col(f"detect_{n}")).alias(n) for n in names))
    return rows.selectExpr("market", f"stack({len(names)}, {', '.join(f"'{n}', {n}" for n in names)}) AS (detector, hits)")


@array_detector(20, "regression_break_up", "regression_break_down")
def _regression_break(bars):
    """Whether the close is more than two deviations above the line through the 20 closes before it."""
    import numpy as np

    n, c = 20, bars["close"]
    fired = np.zeros(c.size, dtype=bool)
    if c.size > n:
        x = np.arange(n) - (n - 1) / 2
        before = np.lib.stride_tricks.sliding_window_view(c, n)[:-1]
        mean = before.mean(axis=1)
        slope = (before - mean[:, None]) @ x / (x @ x)
        off = before - mean[:, None] - slope[:, None] * x
        fired[n:] = c[n:] > mean + slope * (n + 1) / 2 + 2 * np.sqrt((off**2).mean(axis=1))
    return fired


def det_python(spark, sf_dir):
    """A detector written with numpy, in both directions, beside one that is an expression."""
    names = ["regression_break_up", "inside_bar", "regression_break_down"]
    return shown(with_detectors(_indexed(spark, sf_dir), names).select("market", "ts", *(f"detect_{n}" for n in names)))


def _sessions(spark, sf_dir):
    """The 5-minute bars of each market with the day of their exchange."""
    return src.bars_from_events(_read(spark, sf_dir, "events"), "5m").withColumn("session", F.date_format(F.from_utc_timestamp("ts", "Asia/Kolkata"), "yyyy-MM-dd"))


def price_bins(spark, sf_dir):
    """How many closes of each market lie in each bin of its whole range."""
    return shown(profile.price_profile(src.bars_from_events(_read(spark, sf_dir, "events"), "5m"), ["market"]))


def session_profile(spark, sf_dir):
    """Point of control and value area of each market and session, by volume."""
    keys = ["market", "session"]
    return shown(profile.value_area(profile.price_profile(_sessions(spark, sf_dir), keys, weight="volume"), keys))


# --- Strategies ----------------------------------------------------------------------------------


def validate_strategies(spark, sf_dir):
    """Strategies that the customers table gives rise to, checked."""
    rows = validate(_customer_strategies(_read(spark, sf_dir, "customer")))
    return rows.select("strategy_id", "valid", F.concat_ws(",", "errors").alias("errors"))


def _customer_strategies(customer: DataFrame) -> DataFrame:
    """A strategy for each customer, sound or faulty by its key."""
    k = F.col("c_custkey")
    entry = F.when(k % 7 == 0, F.array().cast("array<string>")).when(k % 11 == 0, F.array(F.lit("hope"))).otherwise(F.array(F.lit("detect_choch_bullish"), F.when(k % 5 == 0, F.lit("News_above_open")).otherwise(F.lit("price_above_vwap"))))
    stop = F.when(k % 13 == 0, F.lit("none")).otherwise(F.lit("1.5x_ATR_from_entry"))
    return customer.select(
        k.alias("strategy_id"), entry.alias("entry_rules"), F.when(k % 3 == 0, F.array(F.lit("end_of_session"))).otherwise(F.array(F.lit("stop_loss_hit"))).alias("exit_rules"), stop.alias("stop_loss_logic"),
        F.when(k % 17 == 0, F.lit("")).when(k % 19 == 0, F.lit("future_high")).otherwise(F.lit("2x")).alias("take_profit_logic"), (1.0 + (k % 50) / 10.0).cast("double").alias("risk_reward"), F.when(k % 23 == 0, F.lit("2h")).otherwise(F.lit("5m")).alias("timeframe"),
    )


def _series(spark, sf_dir):
    return numbered(hourly(spark, sf_dir), PERIODS, fired=FIRED)


def _ready(spark, sf_dir):
    return ind.with_indicators(_series(spark, sf_dir))


def _signals(spark, sf_dir, ready):
    return with_levels(entries(ready, strategies(spark), list(RULES), list(EMAS), "UTC", fired=FIRED))


def rule_entries(spark, sf_dir):
    rows = _signals(spark, sf_dir, _ready(spark, sf_dir))
    return shown(rows.select("strategy_id", "market", "period_days", "bar_idx", "direction", "stop", "target"))


def rule_entries_compat(spark, sf_dir):
    """Entries as the dispatch with its accidents finds them."""
    rules = [*RULES, *dict.fromkeys(r for s in COMPAT_STRATEGIES for r in s[1] if r not in RULES)]
    rows = entries(_ready(spark, sf_dir), strategies(spark, more=COMPAT_STRATEGIES), rules, list(EMAS), "UTC", compat=True)
    return shown(with_levels(rows).select("strategy_id", "market", "period_days", "bar_idx", "direction", "stop", "target"))


def screened_long(spark, sf_dir):
    """The screen over windows of up to a year of daily bars, with the texts of its failures in their order."""
    asked = strategies(spark, "1d")
    found = backtest(daily(spark, sf_dir), asked, list(RULES), list(EMAS), LONG_PERIODS, zone="UTC")
    rows = sc.screen(metrics.period_metrics(found, asked, LONG_PERIODS))
    return shown(rows.withColumn("failures", F.array_join("failures", "; ")))


def _trades(spark, sf_dir):
    series = _series(spark, sf_dir)
    return scan_trades(series, _signals(spark, sf_dir, ind.with_indicators(series)))


def trades(spark, sf_dir):
    return shown(_trades(spark, sf_dir).drop("timeframe", "entry_time", "exit_time"))


def trades_with_exits(spark, sf_dir):
    """Trades that may also leave by the signal exits of EXITS."""
    ready = _ready(spark, sf_dir)
    leave = F.create_map(*(x for k, v in EXITS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    asked = strategies(spark).withColumn("exit_rules", F.coalesce(F.element_at(leave, F.col("strategy_id")), F.array().cast("array<string>")))
    signals = with_levels(entries(ready, asked, list(RULES), list(EMAS), "UTC", fired=FIRED))
    return shown(scan_with_exits(ready, signals, list(EMAS), "UTC").drop("timeframe", "entry_time", "exit_time"))


def rule_tokens(spark, sf_dir):
    """At how many bars of each market and window each rule that is no detector holds."""
    hits = rule_hits(_ready(spark, sf_dir), list(TOKENS), [EMAS[0]], "UTC").select("market", "period_days", F.explode(F.element_at("hits", "/".join(map(str, EMAS[0])))).alias("rule"))
    return hits.groupBy("market", "period_days", "rule").agg(F.count("*").alias("bars"))


def equity(spark, sf_dir):
    return shown(metrics.equity_curve(_trades(spark, sf_dir)).select("strategy_id", "period_days", "trade_no", "equity", "drawdown"))


def _results(spark, sf_dir):
    return metrics.period_metrics(_trades(spark, sf_dir), strategies(spark), PERIODS)


def period_metrics(spark, sf_dir):
    return shown(_results(spark, sf_dir).drop("gross_profit", "gross_loss"))


def screened(spark, sf_dir):
    return shown(sc.screen(_results(spark, sf_dir), LIMITS).withColumn("n_failures", F.size("failures")).drop("failures"))


def passing_strategies(spark, sf_dir):
    return sc.passing(_results(spark, sf_dir), sc.Limits(failures=4, targets=LIMITS.targets)).select("strategy_id")


def repo_documents(spark, sf_dir):
    """Strategies with their results as JSON documents, and read from these again."""
    asked, results = strategies(spark), metrics.period_metrics(_trades(spark, sf_dir), strategies(spark), PERIODS, curve=True)
    rows = repo.encode(asked.withColumn("take_profit_logic", F.lit("2x")), results, metrics.overall(results), F.lit("2024-01-01"))
    back = repo.from_json(repo.to_json(rows))
    figure = lambda name: F.col(f"backtest_result.{name}").alias(name)
    points = rows.select(F.col("strategy.id").alias("id"), F.size(metrics.thin_curve(F.element_at("backtest_result.period_results", "30")["equity_curve"], 10)).alias("points"))
    out = back.select("hash", "stored_at", F.col("strategy.id").alias("strategy_id"), F.array_join("strategy.entry_rules", "|").alias("rules"), "strategy.ema_slow", figure("all_periods_profitable"), figure("avg_win_rate"), figure("worst_drawdown"), F.col("backtest_result.period_results").isNull().alias("no_windows"))
    return shown(out.join(points, F.col("strategy_id") == F.col("id")).drop("id"))


def report_pivot(spark, sf_dir):
    return shown(sc.comparison(_results(spark, sf_dir), PERIODS))


def concept_tags(spark, sf_dir):
    return sc.concept_tags(_supplier_strategies(_read(spark, sf_dir, "supplier")))


def trade_marks(spark, sf_dir):
    series = _series(spark, sf_dir)
    found = scan_trades(series, _signals(spark, sf_dir, ind.with_indicators(series)))
    return shown(sc.trade_marks(series, found).select("strategy_id", "market", "period_days", "bar_idx", "mark", "direction", "price"))


def run_summary(spark, sf_dir):
    every = strategies(spark)
    results = _results(spark, sf_dir)
    return sc.run_summary(every, validate(every), results, sc.screen(results, LIMITS))


# --- Repository and learning ---------------------------------------------------------------------


def _supplier_strategies(supplier: DataFrame) -> DataFrame:
    """A stored strategy for each supplier; few distinct sets of rules, so that they repeat."""
    k = F.col("s_suppkey")
    rules = F.array(*map(F.lit, ("detect_choch_bullish", "detect_liquidity_sweep_low", "is_in_kill_zone", "price_above_vwap", "rsi_below_70", "detect_dragon_pattern_bullish", "detect_tails_bearish")))
    pick = F.array_distinct(F.array(*(F.get(rules, ((k * m) % 7).cast("int")) for m in (1, 3))))
    return supplier.select(
        k.alias("strategy_id"), pick.alias("entry_rules"), F.array(F.lit("stop_loss_hit")).alias("exit_rules"), F.when(k % 3 == 0, F.lit("15m")).otherwise(F.lit("5m")).alias("timeframe"),
        F.when(k % 4 != 0, (1.8 + (k % 10) / 10.0).cast("double")).alias("risk_reward"), F.when(k % 9 != 0, F.lpad(((k * 7919) % 100003).cast("string"), 6, "0")).alias("stored_at"),
    )


def repo_dedup(spark, sf_dir):
    """Strategies that are new to a store which has those of three suppliers in seven."""
    rows = _supplier_strategies(_read(spark, sf_dir, "supplier")).withColumn("hash", repo.fingerprint())
    return repo.new_rows(rows.filter("strategy_id % 7 < 3"), rows.filter("stored_at IS NOT NULL").select("hash", "stored_at", "strategy_id")).select("hash", "strategy_id")


def repo_latest(spark, sf_dir):
    rows = _supplier_strategies(_read(spark, sf_dir, "supplier")).withColumn("hash", F.col("strategy_id").cast("string"))
    return repo.latest(rows, 10).select("strategy_id", F.coalesce("stored_at", F.lit("")).alias("stored_at"))


def repo_count(spark, sf_dir):
    rows = _supplier_strategies(_read(spark, sf_dir, "supplier")).withColumn("hash", repo.fingerprint())
    return rows.groupBy("timeframe").agg(F.count("*").alias("stored"), F.countDistinct("hash").alias("distinct_rules"))


def _recent(spark, sf_dir):
    return learning.recent(_supplier_strategies(_read(spark, sf_dir, "supplier")).filter("stored_at IS NOT NULL"))


def dna_keywords(spark, sf_dir):
    return learning.rule_weights(_recent(spark, sf_dir))


def dna_timeframes(spark, sf_dir):
    return learning.timeframe_weights(_recent(spark, sf_dir))


def dna_risk_reward(spark, sf_dir):
    return learning.mean_risk_reward(_recent(spark, sf_dir))


def dna_weights(spark, sf_dir):
    """Weights of all rules that any supplier's strategy has, learned from the recent ones."""
    every = _supplier_strategies(_read(spark, sf_dir, "supplier")).select(F.explode("entry_rules").alias("keyword")).distinct()
    return shown(learning.weighed(every, dna_keywords(spark, sf_dir), "keyword", "keyword"))


def dna_memory(spark, sf_dir):
    """The memory that recent strategies give rise to, as rows."""
    row = learning.memory(_supplier_strategies(_read(spark, sf_dir, "supplier")).filter("stored_at IS NOT NULL"))
    part = lambda kind: row.select(F.lit(kind).alias("kind"), F.explode(kind).alias("name", "weight"))
    focus = row.select(F.lit("rr_focus").alias("kind"), F.lit("").alias("name"), F.col("rr_focus").alias("weight"))
    return shown(part("keywords").unionAll(part("timeframes")).unionAll(focus))


def rules_described(spark, sf_dir):
    rows = _supplier_strategies(_read(spark, sf_dir, "supplier"))
    return rows.select("strategy_id", describe("entry_rules").alias("entry"), describe("exit_rules", " OR ").alias("leave"))


def _part_templates(part: DataFrame, *, whole: bool) -> DataFrame:
    """A template for each part, or for each last digit of a brand."""
    key = F.col("p_partkey") if whole else F.substring("p_brand", -1, 1).cast("long")
    rows = part.select(key.alias("k")).distinct()
    kind = F.when(F.col("k") % 10 < 5, "institutional").when(F.col("k") % 10 < 8, "price_action").when(F.col("k") % 10 == 8, "vwap").otherwise("ema")
    rules = F.array(F.concat(F.lit("detect_"), F.col("k").cast("string")), F.when(F.col("k") % 3 == 0, F.lit("detect_discount_zone")).otherwise(F.lit("price_above_vwap")))
    return rows.select(F.col("k").cast("int").alias("template"), kind.alias("type"), F.when(F.col("k") % 2 == 0, "LONG").otherwise("SHORT").alias("direction"), rules.alias("rules"), F.lit(1.0).alias("share"))


def strategy_grid(spark, sf_dir):
    """The grid without options over a template for each part, counted by its axes, after a bias to long ones."""
    rows = g.grid(spark, g.biased(_part_templates(_read(spark, sf_dir, "part"), whole=True), "BULLISH"), small=True)
    rows = rows.withColumn("_id", g.id_number())
    found = rows.groupBy("type", "direction", "timeframe", "stop_loss_logic", "take_profit_logic", "ema_fast", "ema_slow").agg(F.count("*").alias("strategies"), F.sum("probability").alias("probability"), g.id_of(F.min("_id")).alias("first_id"), g.id_of(F.max("_id")).alias("last_id"))
    return shown(found)


def strategy_options(spark, sf_dir):
    """The whole grid over a template for each last digit of a brand: how its options share out."""
    rows = g.grid(spark, _part_templates(_read(spark, sf_dir, "part"), whole=False), risk_rewards=(2.0,), timeframes=("5m",))
    found = rows.groupBy("type", "use_vwap", "use_rsi", F.size("entry_rules").alias("rules"), F.element_at(F.concat("exit_rules", F.array(F.lit(""))), 3).alias("leave")).agg(F.count("*").alias("strategies"), F.sum("probability").alias("probability"))
    return shown(found)


def drawn_strategies(spark, sf_dir):
    """A strategy drawn for each customer from all templates, with the shares of a focus that its nation decides."""
    customer = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    parts = []
    for k, focus in enumerate(FOCUSES):
        space = g.Space.of(focus)
        parts.append(space.drawn(customer.filter(F.col("c_nationkey") % len(FOCUSES) == k), "c_custkey", seed=11))
    rows = reduce(DataFrame.unionAll, parts)
    return shown(rows.select("c_custkey", "number", "strategy_id", "type", "direction", "template", F.array_join("entry_rules", "|").alias("entry"), F.array_join("exit_rules", "|").alias("leave"), "stop_loss_logic", "risk_reward", "timeframe", "ema_fast", "ema_slow"))


def part_grid(spark, sf_dir):
    """A grid of parts' brands with timeframes, stops and pairs of averages."""
    brands = _read(spark, sf_dir, "part").select("p_brand").distinct()
    for name, values in (("timeframe", dict.fromkeys(g.TIMEFRAMES, 1 / 3)), ("stop", g.STOPS), ("emas", g.EMAS)):
        brands = brands.withColumn(name, F.explode(g._axis(name, values)))
    rows = brands.select("p_brand", F.col("timeframe.value").alias("timeframe"), F.col("stop.value").alias("stop"), F.col("emas.value")[0].alias("fast"), F.col("emas.value")[1].alias("slow"), (F.col("timeframe.p") * F.col("stop.p") * F.col("emas.p")).alias("probability"))
    return shown(rows)


def weighted_sample(spark, sf_dir):
    """Twenty parts drawn by retail price."""
    parts = _read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("strategy_id"), F.col("p_retailprice").alias("probability"))
    return g.sample(parts, 20, seed=7).select("strategy_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        bars_1h, bars_5m, bars_daily, bars_lineitem, candles_decoded, lookback_windows, bar_shape, ind_sma, ind_ema, ind_rsi, ind_atr, ind_vwap, ind_vwap_session, ind_bands,
        *(_detected(k) for k in ("lag", "minmax", "avg_std", "exists", "count", "argmin", "array")), det_frequency, det_python, price_bins, session_profile, validate_strategies, rule_entries, rule_entries_compat, rule_tokens, trades, trades_with_exits, equity, period_metrics,
        screened, screened_long, passing_strategies, report_pivot, concept_tags, trade_marks, run_summary, repo_dedup, repo_latest, repo_count, repo_documents, dna_keywords, dna_timeframes, dna_risk_reward, dna_weights, dna_memory, rules_described, strategy_grid, strategy_options, drawn_strategies, part_grid, weighted_sample,
    )
    return {q.__name__: q for q in own}


def oracle_sql() -> dict[str, str]:
    guards = {name: first for first, names in ds.GUARDS.items() for name in names}
    simple = {f"det_{k}": ds.simple(names_of(k), guards, twins.BARS_1H) for k in ("lag", "minmax", "avg_std", "exists", "count")}
    frequency = ds.simple([*names_of("lag"), *names_of("minmax")], guards, twins.BARS_1H)
    return {
        **twins.sql(STRATEGIES, PERIODS, EXITS), **twins.variants(STRATEGIES, COMPAT_STRATEGIES, PERIODS, LONG_PERIODS), "drawn_strategies": twins.drawn(g.templates(), g.TWICE), **simple, "det_argmin": ds.positions(twins.BARS_1H), "det_array": ds.arrays(names_of("array"), guards, twins.BARS_1H),
        "det_frequency": f"SELECT market, replace(name, 'detect_', '') AS detector, count(*) FILTER (hit) AS hits FROM (UNPIVOT ({frequency}) ON COLUMNS('detect_.*') INTO NAME name VALUE hit) GROUP BY ALL",
    }
