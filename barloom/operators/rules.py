"""Strategy rules: validation of their texts, and evaluation of entry rules as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import at_home, in_pieces
from barloom.operators.detectors import DETECTORS, Bars, fired_in, in_kill_zone, reach_of, with_detectors, with_first_bars

# Fixed values of the validator: what makes a rule algorithmic, and terms that no rule may hold.
KEYWORDS = (
    "above", "below", "crossover", "crossed", "breakout", "breakdown", "pullback", "rally", "engulfing", "inside_bar", "morning_star", "evening_star",
    "ema", "vwap", "rsi", "atr", "price", "close", "open", "high", "low", "support", "resistance", "swing", "band", "upper", "lower", "between", "within",
    "hit", "near", "pct", "candle", "bar", "order_block", "sweep", "imbalance", "squeeze", "mss", "breaker", "premium", "discount", "ote", "inducement",
    "kill_zone", "choch", "mitigation", "amd", "ifvg", "turtle", "rejection", "propulsion", "void", "bpr", "volume_imbalance", "mean_threshold",
    "unicorn", "silver_bullet", "gap_reclaim", "reclaimed_block", "wick_ce", "order_flow", "sponsor", "range_rotation", "snap_back", "quarterly_shift",
    "std_dev", "po3_swing", "inst_swing", "smt_div", "macro", "liq_run", "stops_hunt", "eq_reclaim", "partial_void", "fractal_exp", "ib_breakout", "orb",
    "daily_open_rej", "pwh_pwl", "pdh_pdl", "sfp", "impulse", "psych_level", "tl_liquidity", "failed_auction", "turtle_soup", "decoupled_ob",
    "propulsion_candle", "eng_liquidity", "mitigation_block", "rejection_block", "nwog", "vol_void", "dragon", "quasimodo", "triple_tap", "compression",
    "master_pattern", "vol_imbalance", "judas", "3c_rev", "dr_range", "cpr", "value_area", "poc", "poor_high_low", "single_prints", "tails",
    "composite_op", "dist_accum", "spring_upthrust", "sign_of_strength", "last_point_support", "effort_result", "stopping_vol", "vsa_patterns",
    "climax_logic", "optimal_trade_entry", "market_structure_shift",
)
DISCRETIONARY = ("maybe", "might", "could", "should consider", "looks like", "seems", "feels", "opinion", "discretion", "judgment", "manual", "visual", "news", "sentiment", "announcement", "event")
LOOKAHEAD = ("future", "next_candle", "will_be", "going_to", "repaint", "zigzag", "pivot_confirmed")
STOP_WORDS = ("atr", "pct", "swing", "candle", "fixed")
TIMEFRAMES = ("1m", "5m", "15m", "30m", "1h")
RISK_REWARD = (1.8, 5.0)


def _has_any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def validate(strategies: DataFrame, risk_reward: tuple[float, float] = RISK_REWARD) -> DataFrame:
    """Adds ``errors array<string>``, in the fixed order of the checks, and ``valid``. A null text counts as empty."""
    entry, leave = (F.coalesce(c, F.array().cast("array<string>")) for c in ("entry_rules", "exit_rules"))
    stop, target = (F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("stop_loss_logic", "take_profit_logic"))
    known = lambda r: _has_any(F.lower(r), KEYWORDS) | F.startswith(F.lower(r), F.lit("detect_"))
    texts = F.transform(F.concat(entry, leave, F.array(stop, target)), lambda r: F.lower(r))
    checks = {
        "entry rules": (F.size(entry) > 0) & F.forall(entry, known),
        "exit rules": (F.size(leave) > 0) & F.exists(leave, lambda r: F.contains(F.lower(r), F.lit("stop"))),
        "stop loss": (F.length(stop) > 0) & _has_any(stop, STOP_WORDS),
        "take profit": F.length(target) > 0,
        "timeframe": F.col("timeframe").isin(*TIMEFRAMES),
        "discretionary terms": ~F.exists(texts, lambda t: _has_any(t, DISCRETIONARY)),
        "look-ahead terms": ~F.exists(texts, lambda t: _has_any(t, LOOKAHEAD)),
        "risk reward": F.col("risk_reward").between(*risk_reward),
    }
    errors = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items())))
    return strategies.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)


def describe(rules: str, joint: str = " AND ", empty: str = "no rule") -> Column:
    """Rules as one text."""
    return F.when(F.size(rules) > 0, F.array_join(rules, joint)).otherwise(F.lit(empty))


def _tokens() -> dict[str, tuple]:
    """Rules that are not detectors: name -> (bars, fast, slow) -> Column."""
    c, low, high, vwap, rsi = F.col("close"), F.col("low"), F.col("high"), F.col("vwap"), F.col("rsi_14")
    before = lambda b: b.back(rsi, 1)
    return {
        "ema_fast_above_slow": lambda b, f, s: f > s,
        "ema_fast_below_slow": lambda b, f, s: f < s,
        "price_above_both_emas": lambda b, f, s: (c > f) & (c > s),
        "price_below_both_emas": lambda b, f, s: (c < f) & (c < s),
        "price_above_ema_fast": lambda b, f, s: c > f,
        "price_above_ema_slow": lambda b, f, s: c > s,
        "price_below_ema_slow": lambda b, f, s: c < s,
        "pullback_to_ema_fast": lambda b, f, s: (low <= f) & (f <= c),
        "rally_to_ema_fast": lambda b, f, s: (c <= f) & (f <= high),
        "price_above_vwap": lambda b, f, s: vwap.isNull() | (c > vwap),
        "price_below_vwap": lambda b, f, s: vwap.isNull() | (c < vwap),
        "pullback_to_vwap": lambda b, f, s: (low <= vwap) & (vwap <= c),
        "rally_to_vwap": lambda b, f, s: (c <= vwap) & (vwap <= high),
        "price_within_0.5pct_of_vwap": lambda b, f, s: F.try_divide(F.abs(c - vwap), c) <= 0.005,
        "close_above_vwap_upper_band": lambda b, f, s: c > F.col("vwap_upper"),
        "close_below_vwap_lower_band": lambda b, f, s: c < F.col("vwap_lower"),
        "rsi_oversold_bounce": lambda b, f, s: rsi <= 30,
        "rsi_above_30": lambda b, f, s: rsi > 30,
        "rsi_below_70": lambda b, f, s: rsi < 70,
        "rsi_crossed_above_30": lambda b, f, s: (before(b) <= 30) & (rsi > 30),
        "rsi_crossed_below_70": lambda b, f, s: (before(b) >= 70) & (rsi < 70),
        "rsi_between_40_60": lambda b, f, s: rsi.between(40, 60),
        "breakout_above_20bar_high": lambda b, f, s: (b.i >= 20) & (c > b.high(-20, -1)),
        "breakout_below_20bar_low": lambda b, f, s: (b.i >= 20) & (c < b.low(-20, -1)),
        "price_near_support": lambda b, f, s: (b.i >= 20) & (F.abs(c - b.low(-20, -1)) <= 0.005 * c),
        "price_near_resistance": lambda b, f, s: (b.i >= 20) & (F.abs(c - b.high(-20, -1)) <= 0.005 * c),
    }


#: Rules that the dispatch of ``compat`` tests; every other token then counts as met.
COMPAT_TOKENS = ("ema_fast_above_slow", "ema_fast_below_slow", "price_above_both_emas", "price_below_both_emas", "price_above_vwap", "price_below_vwap", "is_in_kill_zone", "rsi_oversold_bounce")
# Detectors that ``compat`` takes as met whatever the bars (unlike parameters), those that it takes
# as met after a bar of the sought color too, and those that it evaluates with high and low exchanged.
COMPAT_MET = tuple(f"{n}_{d}" for n in ("mitigation_block", "rejection_block", "standard_deviation_projection", "stops_hunt", "equilibrium_reclaimed", "fractal_expansion", "failed_auction", "amd_setup", "decoupled_ob", "propulsion_candle", "engineered_liquidity", "inverse_fvg") for d in ("bullish", "bearish"))
COMPAT_RAISED = ("bullish_breaker", "bearish_breaker", "unicorn_model_bullish", "unicorn_model_bearish")
COMPAT_SWAPPED = ("wyckoff_sos_bullish", "wyckoff_sow_bearish", "effort_vs_result_bullish", "effort_vs_result_bearish", "stopping_volume_bullish", "stopping_volume_bearish")


class SwappedBars(Bars):
    """Bars whose high and low have changed places."""

    @property
    def h(self) -> Column:
        return super().l

    @property
    def l(self) -> Column:  # noqa: E743
        return super().h

    @property
    def rng(self) -> Column:
        return -super().rng


def rule_column(rule: str, frame: DataFrame, fast: str, slow: str, zone: str = "Asia/Kolkata", compat: bool = False) -> Column:
    """Whether one entry rule holds at a bar. Unknown rules are an error, or count as met with ``compat``.

    ``frame`` has the indicator columns of ``with_indicators`` and the detector columns it asks for.
    """
    name = rule.strip().lower()
    detector = name.removeprefix("detect_")
    if compat and detector in COMPAT_SWAPPED:
        d = DETECTORS[detector]
        b = SwappedBars(frame, d.mirrored)
        return F.coalesce(F.when(b.i >= d.min_i, d.rule(b)), F.lit(False))
    if compat and detector in COMPAT_RAISED:
        b = Bars(frame, DETECTORS[detector].mirrored)
        return F.col(f"detect_{detector}") | ((b.i >= 10) & b.back(b.down, 1))
    if name == "is_in_kill_zone":
        return in_kill_zone("UTC" if compat else zone)
    if name.startswith("detect_") and detector in DETECTORS and not (compat and detector in (*COMPAT_MET, "bullish_pin_bar")):
        return F.col(f"detect_{detector}")
    tokens = _tokens()
    if name in tokens and not (compat and name not in COMPAT_TOKENS):
        return F.coalesce(tokens[name](Bars(frame), F.col(fast), F.col(slow)), F.lit(False))
    if compat:
        return F.lit(True)
    raise ValueError(f"unknown rule: {rule}")


def known_rule(rule: str) -> bool:
    """Whether ``rule_column`` can evaluate a rule without ``compat``."""
    name = rule.strip().lower()
    return name == "is_in_kill_zone" or name in _tokens() or (name.startswith("detect_") and name.removeprefix("detect_") in DETECTORS)


def with_unknown(strategies: DataFrame, rules: list[str]) -> DataFrame:
    """Adds ``unknown``: entry rules of a strategy that are not among ``rules`` or that nothing can evaluate; such a strategy never enters."""
    known = F.array(*(F.lit(r) for r in rules if known_rule(r))) if any(map(known_rule, rules)) else F.array().cast("array<string>")
    return strategies.withColumn("unknown", F.array_except(F.coalesce("entry_rules", F.array().cast("array<string>")), known))


#: How many bars back rules that are no detectors look.
TOKEN_REACH = 20
#: Exits beside stop and target, at the close of the bar on which they hold.
SIGNAL_EXITS = ("ema_crossover_reversal", "price_crosses_vwap_opposite", "end_of_session")


def with_signal_exits(bars: DataFrame, emas: list[tuple[int, int]], zone: str = "Asia/Kolkata", piece: int | None = None) -> DataFrame:
    """Adds ``leaves``: the names of SIGNAL_EXITS that hold at a bar, as ``array<string>`` of ``<fast>/<slow>:<name>/<side>``.

    A long position leaves when the fast average falls below the slow one after it was not below, or the
    close falls below the volume-weighted price after it was not below; a short one when they rise
    above. Both leave on the last bar of a local day, which the next bar's date shows.
    """
    rows = in_pieces(bars, 1, 1, piece)
    b = Bars(rows)
    c, v = F.col("close"), F.col("vwap")
    falls = lambda x, y: (x < y) & (b.back(x, 1) >= b.back(y, 1))
    day = F.to_date(F.from_utc_timestamp("ts", zone))
    last = F.lead(day).over(b.w) != day
    held = {}
    for fast, slow in emas:
        f, s = F.col(f"ema_{fast}"), F.col(f"ema_{slow}")
        own = {"ema_crossover_reversal/LONG": falls(f, s), "ema_crossover_reversal/SHORT": falls(s, f), "price_crosses_vwap_opposite/LONG": falls(c, v), "price_crosses_vwap_opposite/SHORT": falls(v, c), "end_of_session/LONG": last, "end_of_session/SHORT": last}
        held |= {f"{fast}/{slow}:{k}": x for k, x in own.items()}
    return at_home(rows.withColumn("leaves", F.array_compact(F.array(*(F.when(x, F.lit(k)) for k, x in held.items())))), piece)


def detectors_of(rules: list[str]) -> list[str]:
    """The detectors that rules ask for, each once."""
    names = (r.strip().lower().removeprefix("detect_") for r in rules if r.strip().lower().startswith("detect_"))
    return [n for n in dict.fromkeys(names) if n in DETECTORS]


def rule_hits(bars: DataFrame, rules: list[str], emas: list[tuple[int, int]], zone: str = "Asia/Kolkata", compat: bool = False, piece: int | None = None, fired: list[str] | None = None) -> DataFrame:
    """Bars with ``hits``: for each (fast, slow) pair the names of the rules that hold, as ``map<string,array<string>>``.

    Rules are turned into columns once for the whole set of strategies, not once for each strategy. Rules
    that nothing can evaluate hold nowhere, so they stop the strategies that have them and no others.
    ``fired`` names the detectors that ``bars`` has in ``_fired``, so that only the others need windows here.
    """
    rules = [r for r in rules if compat or known_rule(r)]
    fired = [] if fired is None or compat else fired
    names = [n for n in detectors_of(rules) if n not in fired]
    rows = bars if "_first_high" in bars.columns or not any(n.startswith("defining_range") for n in names) else with_first_bars(bars)
    rows = with_detectors(in_pieces(rows, max(TOKEN_REACH, reach_of(names)), size=piece), names)
    rows = fired_in(rows, fired) if fired else rows
    own = {}
    for fast, slow in emas:
        held = F.array_compact(F.array(*(F.when(rule_column(r, rows, f"ema_{fast}", f"ema_{slow}", zone, compat), F.lit(r)) for r in rules))) if rules else F.array().cast("array<string>")
        own[f"{fast}/{slow}"] = held
    return at_home(rows.withColumn("hits", F.create_map(*(x for k, v in own.items() for x in (F.lit(k), v)))), piece)


def entries(bars: DataFrame, strategies: DataFrame, rules: list[str], emas: list[tuple[int, int]], zone: str = "Asia/Kolkata", compat: bool = False, fired: list[str] | None = None) -> DataFrame:
    """(strategy_id, series keys, bar_idx, ts, close, atr_14, direction) where all entry rules of a strategy hold.

    direction is LONG where the fast average is above the slow one, SHORT where below; else no entry.
    ``strategies`` are matched to bars by (market, timeframe), a strategy with market '*' to all markets.
    A bar meets only the strategies whose least frequent rule (by the number of strategies that ask for
    it) holds there; their other rules are tested then. ``fired``: see ``rule_hits``.
    """
    hit = rule_hits(bars, rules, emas, zone, compat, fired=fired)
    trend = F.create_map(*(x for f, s in emas for x in (F.lit(f"{f}/{s}"), F.when(F.col(f"ema_{f}") > F.col(f"ema_{s}"), F.lit("LONG")).when(F.col(f"ema_{f}") < F.col(f"ema_{s}"), F.lit("SHORT")))))
    keys = [k for k in ("market", "timeframe", "period_days") if k in bars.columns]
    hit = hit.select(*keys, "bar_idx", "ts", "high", "low", "close", "atr_14", F.explode("hits").alias("pair", "met"), trend.alias("trend"))
    hit = hit.withColumn("direction", F.element_at("trend", F.col("pair"))).filter("direction IS NOT NULL").drop("trend").withColumn("anchor", F.explode("met"))
    pair = F.concat_ws("/", F.col("ema_fast").cast("string"), F.col("ema_slow").cast("string"))
    more = [c for c in ("exit_rules",) if c in strategies.columns]
    asks = strategies.select("strategy_id", F.col("market").alias("on"), "timeframe", pair.alias("pair"), "entry_rules", "stop_loss_logic", "risk_reward", *more)
    asked = asks.select("strategy_id", F.explode(F.array_distinct("entry_rules")).alias("anchor"))
    often = asked.groupBy("anchor").agg(F.count("*").alias("n"))
    rarest = asked.join(often, "anchor").groupBy("strategy_id").agg(F.min_by("anchor", F.struct("n", "anchor")).alias("anchor"))
    asks = asks.join(rarest, "strategy_id")
    rows = hit.join(asks, ["timeframe", "pair", "anchor"]).filter((F.col("on") == "*") | (F.col("on") == F.col("market")))
    return rows.filter(F.size(F.array_except("entry_rules", "met")) == 0).drop("met", "anchor", "on")
