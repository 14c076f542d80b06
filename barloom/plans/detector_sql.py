"""DuckDB twins of the detectors, written out for both directions.

A small notation keeps them readable: ``c[-1]`` is the value one bar back, ``min(l,-20..-1)`` an
aggregate over bars -20..-1, both replaced by window expressions; ``some``/``count`` repeat a condition
for each k of a range.
"""

from __future__ import annotations

import re

BASE = """
bars AS ({bars}),
shaped AS (
    SELECT *, row_number() OVER w - 1 AS i, c > o AS up, c < o AS dn, abs(c - o) AS body, h - l AS rng, h - greatest(o, c) AS uw, least(o, c) - l AS lw,
           least(o, c) AS minb, greatest(o, c) AS maxb, (h + l) / 2 AS mid, (o + c) / 2 AS mb, c - o AS rise, o - c AS fall,
           lag(c) OVER w AS pc, lag(l) OVER w AS pl, lead(l) OVER w AS nl, lag(h) OVER w AS ph, lead(h) OVER w AS nh
    FROM (SELECT market, ts, open AS o, high AS h, low AS l, close AS c FROM bars) WINDOW w AS (PARTITION BY market ORDER BY ts)
)"""


# The first bar at which a detector may fire.
GUARDS = {
    0: (
        "bullish_pin_bar", "macro_cycle_bullish", "macro_cycle_bearish", "psychological_level_rejection_bullish", "psychological_level_rejection_bearish",
        "kill_zone",
    ),
    1: (
        "bullish_engulfing", "bearish_engulfing", "inside_bar", "bullish_order_block", "bearish_order_block", "rejection_block_v1_bullish",
        "rejection_block_v1_bearish", "volume_imbalance_v1_bullish", "volume_imbalance_v1_bearish", "quarterly_shift_bullish", "quarterly_shift_bearish",
    ),
    2: (
        "morning_star", "bullish_imbalance", "bearish_imbalance", "silver_bullet_bullish", "institutional_swing_point_bullish",
        "institutional_swing_point_bearish", "propulsion_candle_bullish", "propulsion_candle_bearish", "three_candle_reversal_bullish",
        "three_candle_reversal_bearish",
    ),
    3: (
        "propulsion_block_bullish", "propulsion_block_bearish", "balanced_price_range", "silver_bullet_bearish", "stops_hunt_bullish", "stops_hunt_bearish",
    ),
    4: (
        "liquidity_run_bullish", "liquidity_run_bearish", "wick_consequent_encroachment_bullish", "wick_consequent_encroachment_bearish",
    ),
    5: (
        "order_flow_entry_bullish", "order_flow_entry_bearish", "decoupled_ob_bullish", "decoupled_ob_bearish", "poor_high_low_bullish",
        "poor_high_low_bearish", "inverted_fvg_bullish", "inverted_fvg_bearish", "mean_threshold_retest_bullish", "mean_threshold_retest_bearish",
    ),
    9: (
        "rejection_block_bullish", "rejection_block_bearish", "sponsor_candle_bullish", "sponsor_candle_bearish",
    ),
    10: (
        "reclaimed_block_bullish", "reclaimed_block_bearish", "fractal_expansion_bullish", "fractal_expansion_bearish", "swing_failure_pattern_bullish",
        "swing_failure_pattern_bearish", "trendline_liquidity_build_bullish", "trendline_liquidity_build_bearish", "balanced_price_range_bullish",
        "balanced_price_range_bearish", "inducement_v1_bullish", "inducement_v1_bearish", "choch_bullish", "choch_bearish", "mitigation_block_bullish",
        "mitigation_block_bearish", "opening_gap_reclaim_bullish", "opening_gap_reclaim_bearish", "wyckoff_sos_bullish", "wyckoff_sow_bearish",
        "effort_vs_result_bullish", "effort_vs_result_bearish", "stopping_volume_bullish", "stopping_volume_bearish", "vsa_no_supply_bullish",
        "vsa_no_demand_bearish", "vsa_shakeout_bullish", "vsa_shakeout_bearish", "bullish_breaker", "bearish_breaker", "unicorn_model_bullish",
        "unicorn_model_bearish", "liquidity_void_bullish", "liquidity_void_bearish", "volume_imbalance_bullish", "volume_imbalance_bearish",
        "partial_void_fill_bullish", "partial_void_fill_bearish", "composite_operator_bullish", "composite_operator_bearish", "inducement_bullish",
        "inducement_bearish",
    ),
    11: (
        "inverse_fvg_bullish", "inverse_fvg_bearish",
    ),
    14: (
        "single_prints_bullish", "single_prints_bearish",
    ),
    15: (
        "amd_bullish", "amd_bearish", "smt_divergence_bullish", "smt_divergence_bearish", "wyckoff_lps_bullish", "wyckoff_lpsy_bearish",
        "momentum_impulse_bullish", "momentum_impulse_bearish", "compression_liquidity_bullish", "compression_liquidity_bearish", "master_pattern_bullish",
        "master_pattern_bearish", "judas_swing_bullish", "judas_swing_bearish", "mitigation_block_v1_bullish", "mitigation_block_v1_bearish",
        "triple_tap_bullish", "triple_tap_bearish",
    ),
    20: (
        "breakout_up", "breakout_down", "turtle_soup_v1_bullish", "turtle_soup_v1_bearish", "liquidity_sweep_low", "liquidity_sweep_high",
        "range_rotation_bullish", "range_rotation_bearish", "failed_auction_bullish", "failed_auction_bearish", "amd_setup_bullish", "amd_setup_bearish",
        "ote_entry_bullish", "ote_entry_bearish", "tails_bullish", "tails_bearish", "wyckoff_spring_bullish", "wyckoff_upthrust_bearish",
        "volatility_squeeze", "snap_back_bullish", "snap_back_bearish", "selling_climax_bullish", "buying_climax_bearish", "engineered_liquidity_bullish",
        "engineered_liquidity_bearish", "market_structure_shift_bullish", "market_structure_shift_bearish", "optimal_trade_entry_long",
        "optimal_trade_entry_short", "dragon_pattern_bullish", "dragon_pattern_bearish",
    ),
    24: (
        "volume_void_bullish", "volume_void_bearish",
    ),
    25: (
        "turtle_soup_bullish", "turtle_soup_bearish", "quasimodo_pattern_bullish", "quasimodo_pattern_bearish",
    ),
    30: (
        "power_of_3_swing_bullish", "power_of_3_swing_bearish", "standard_deviation_projection_bullish", "standard_deviation_projection_bearish",
        "dist_accum_bullish", "dist_accum_bearish",
    ),
    31: (
        "opening_range_breakout_bullish", "opening_range_breakout_bearish",
    ),
    50: (
        "daily_open_rejection_bullish", "daily_open_rejection_bearish", "discount_zone", "premium_zone", "equilibrium_reclaimed_bullish",
        "equilibrium_reclaimed_bearish", "value_area_bullish", "value_area_bearish", "nwog_bullish", "nwog_bearish",
    ),
    60: (
        "cpr_range_bullish", "cpr_range_bearish",
    ),
    61: (
        "initial_balance_breakout_bullish", "initial_balance_breakout_bearish",
    ),
    70: (
        "defining_range_bullish", "defining_range_bearish",
    ),
    75: (
        "pdh_pdl_sweep_bullish", "pdh_pdl_sweep_bearish",
    ),
    100: (
        "poc_level_rejection_bullish", "poc_level_rejection_bearish",
    ),
    200: (
        "pwh_pwl_sweep_bullish", "pwh_pwl_sweep_bearish",
    ),
}


def some(low: int, high: int, text: str, joint: str = " OR ") -> str:
    """``text`` for k = low..high; {k}, {k1}, {k2}, {a} (k+1) and {b} (k+5) are filled in."""
    return "(" + joint.join(f"coalesce(({text.format(k=k, k1=k + 1, k2=k + 2, j=k - 1, a=k + 1, b=k + 5)}), false)" for k in range(low, high + 1)) + ")"


def count(low: int, high: int, text: str) -> str:
    return "(" + " + ".join(f"coalesce(({text.format(k=k)})::int, 0)" for k in range(low, high + 1)) + ")"


def windows(text: str) -> str:
    text = re.sub(r"\b(min|max|avg|std)\((\w+),-(\d+)\.\.-(\d+)\)", lambda m: f"{'stddev_pop' if m[1] == 'std' else m[1]}({m[2]}) OVER (PARTITION BY market ORDER BY ts ROWS BETWEEN {m[3]} PRECEDING AND {m[4]} PRECEDING)", text)
    return re.sub(r"\b([a-z]+)\[-(\d+)\]", r"(lag(\1, \2) OVER w)", text)


def _breaker(reach: int) -> tuple[str, str]:
    return (
        some(2, reach, "dn[-{k}] AND max(h,-{j}..-1) > 1.001 * h[-{k}] AND l <= h[-{k}] AND c >= o[-{k}]"),
        some(2, reach, "up[-{k}] AND min(l,-{j}..-1) < 0.999 * l[-{k}] AND h >= l[-{k}] AND c <= o[-{k}]"),
    )


_PAIRS = {
    # name: (bullish, bearish)
    "propulsion_block": ("up[-1] AND up[-2] AND o[-1] > mb[-2]", "dn[-1] AND dn[-2] AND o[-1] < mb[-2]"),
    "rejection_block_v1": ("rng[-1] <> 0 AND lw[-1] > 0.5 * rng[-1] AND up", "rng[-1] <> 0 AND uw[-1] > 0.5 * rng[-1] AND dn"),
    "volume_imbalance_v1": ("abs(o - c[-1]) > 0",) * 2,
    "silver_bullet": ("l[-1] > coalesce(h[-3], 0) AND l <= l[-1] AND c >= coalesce(h[-3], 0)", "h[-1] < l[-3] AND h >= h[-1] AND c <= l[-3]"),
    "reclaimed_block": ("c[-2] > h[-5] AND l <= h[-5] AND h[-5] <= c", "c[-2] < l[-5] AND c <= l[-5] AND l[-5] <= h"),
    "order_flow_entry": ("up AND l > CASE WHEN dn[-1] THEN l[-1] WHEN dn[-2] THEN l[-2] WHEN dn[-3] THEN l[-3] END", "dn AND h < CASE WHEN up[-1] THEN h[-1] WHEN up[-2] THEN h[-2] WHEN up[-3] THEN h[-3] END"),
    "quarterly_shift": ("i % 24 = 0 AND c > c[-1]", "i % 24 = 0 AND c < c[-1]"),
    "power_of_3_swing": ("c < o[-30] AND c > c[-1] AND dn[-1]", "c > o[-30] AND c < c[-1]"),
    "institutional_swing_point": ("l[-1] < l[-2] AND l[-1] < l", "h[-1] > h[-2] AND h[-1] > h"),
    "macro_cycle": ("i % 60 BETWEEN 50 AND 59",) * 2,
    "liquidity_run": ("l[-1] < l[-2] AND l[-2] < l[-3] AND l > l[-1]", "h[-1] > h[-2] AND h[-2] > h[-3] AND h < h[-1]"),
    "stops_hunt": ("l < l[-2] AND c > l[-2] AND up", "h > h[-2] AND c < h[-2] AND dn"),
    "fractal_expansion": ("h[-5] > h[-6] AND h[-5] > h[-4] AND c > h[-5] AND c[-1] <= h[-5]", "l[-5] < l[-6] AND l[-5] < l[-4] AND c < l[-5] AND c[-1] >= l[-5]"),
    "daily_open_rejection": ("l <= o[-50] AND c > o[-50] AND up", "h >= o[-50] AND c < o[-50] AND dn"),
    "swing_failure_pattern": ("l[-5] < l[-6] AND l[-5] < l[-4] AND l < l[-5] AND c > l[-5]", "h[-5] > h[-6] AND h[-5] > h[-4] AND h > h[-5] AND c < h[-5]"),
    "psychological_level_rejection": ("l < floor(trunc(c) / 50) * 50 AND c > floor(trunc(c) / 50) * 50", "h > floor(trunc(c) / 50) * 50 + 50 AND c < floor(trunc(c) / 50) * 50 + 50"),
    "trendline_liquidity_build": ("l > l[-2] AND l[-2] > l[-4] AND abs((l - l[-2]) - (l[-2] - l[-4])) < 0.0005 * l", "h < h[-2] AND h[-2] < h[-4] AND abs((h[-2] - h) - (h[-4] - h[-2])) < 0.0005 * h"),
    "decoupled_ob": ("up[-3] AND l < l[-3] AND c > l[-3]", "dn[-3] AND h > h[-3] AND c < h[-3]"),
    "propulsion_candle": ("up[-1] AND o[-1] + 0.5 * rise[-1] < o AND o < c[-1] AND up", "dn[-1] AND c[-1] < o AND o < o[-1] - 0.5 * fall[-1] AND dn"),
    "balanced_price_range": (
        "up[-1] AND dn[-2] AND c[-1] > o[-2] AND o[-1] < c[-2] AND l < o[-1] + 0.5 * body[-1] AND c > l",
        "dn[-1] AND up[-2] AND c[-1] < o[-2] AND o[-1] > c[-2] AND h > o[-1] - 0.5 * body[-1] AND c < h",
    ),
    "three_candle_reversal": ("dn[-2] AND body[-1] < body[-2] AND up AND c > o[-2]", "up[-2] AND body[-1] < body[-2] AND dn AND c < o[-2]"),
    "turtle_soup_v1": ("l < min(l,-20..-1) AND c > min(l,-20..-1)", "h > max(h,-20..-1) AND c < max(h,-20..-1)"),
    "inducement_v1": ("l < min(l,-10..-1) AND c > min(l,-10..-1)", "h > max(h,-10..-1) AND c < max(h,-10..-1)"),
    "choch": ("c[-1] < max(h,-5..-1) AND c > max(h,-5..-1)", "c[-1] > min(l,-5..-1) AND c < min(l,-5..-1)"),
    "mitigation_block": ("l[-2] > l[-5] AND c[-1] > max(h,-5..-3) AND l <= 1.001 * l[-2] AND c > l[-2]", "h[-2] < h[-5] AND c[-1] < min(l,-5..-3) AND h >= 0.999 * h[-2] AND c < h[-2]"),
    "amd": ("min(l,-15..-1) < 0.998 * o[-15] AND c > o[-15]", "max(h,-15..-1) > 1.002 * o[-15] AND c < o[-15]"),
    "turtle_soup": ("l < min(l,-21..-2) AND c > min(l,-21..-2)", "h > max(h,-21..-2) AND c < max(h,-21..-2)"),
    "opening_gap_reclaim": ("min(c,-5..-1) < o[-10] AND c > o[-10]", "max(c,-5..-1) > o[-10] AND c < o[-10]"),
    "range_rotation": (
        "max(h,-20..-1) <> min(l,-20..-1) AND (c - min(l,-20..-1)) / (max(h,-20..-1) - min(l,-20..-1)) < 0.10 AND c > c[-1]",
        "max(h,-20..-1) <> min(l,-20..-1) AND (c - min(l,-20..-1)) / (max(h,-20..-1) - min(l,-20..-1)) > 0.90 AND c < c[-1]",
    ),
    "standard_deviation_projection": (
        "max(h,-30..-11) <> min(l,-30..-11) AND l <= 2 * min(l,-30..-11) - max(h,-30..-11) AND c > c[-1]",
        "max(h,-30..-11) <> min(l,-30..-11) AND h >= 2 * max(h,-30..-11) - min(l,-30..-11) AND c < c[-1]",
    ),
    "smt_divergence": ("l < min(l,-10..-2) AND up", "h > max(h,-10..-2) AND dn"),
    "equilibrium_reclaimed": (
        "c[-1] < (max(h,-50..-1) + min(l,-50..-1)) / 2 AND c > (max(h,-50..-1) + min(l,-50..-1)) / 2",
        "c[-1] > (max(h,-50..-1) + min(l,-50..-1)) / 2 AND c < (max(h,-50..-1) + min(l,-50..-1)) / 2",
    ),
    "initial_balance_breakout": ("c > max(h,-60..-1) AND c[-1] <= max(h,-60..-1)", "c < min(l,-60..-1) AND c[-1] >= min(l,-60..-1)"),
    "opening_range_breakout": ("c > max(h,-30..-1) AND c[-1] <= max(h,-30..-1)", "c < min(l,-30..-1) AND c[-1] >= min(l,-30..-1)"),
    "pwh_pwl_sweep": ("l < min(l,-200..-11)", "h > max(h,-200..-11)"),
    "pdh_pdl_sweep": ("l < min(l,-75..-11)", "h > max(h,-75..-11)"),
    "failed_auction": ("l < min(l,-20..-6) AND body < 0.3 * rng[-14]", "h > max(h,-20..-6) AND body < 0.3 * rng[-14]"),
    "amd_setup": ("l < min(l,-15..-2) AND c > min(l,-15..-2)", "h > max(h,-15..-2) AND c < max(h,-15..-2)"),
    "ote_entry": (
        "max(h,-20..-6) > min(l,-20..-6) AND c BETWEEN min(l,-20..-6) + 0.21 * (max(h,-20..-6) - min(l,-20..-6)) AND min(l,-20..-6) + 0.38 * (max(h,-20..-6) - min(l,-20..-6)) AND c > l",
        "max(h,-20..-6) > min(l,-20..-6) AND c BETWEEN max(h,-20..-6) - 0.38 * (max(h,-20..-6) - min(l,-20..-6)) AND max(h,-20..-6) - 0.21 * (max(h,-20..-6) - min(l,-20..-6)) AND c < h",
    ),
    "defining_range": (
        "c > (max(h) FILTER (i < 60) OVER (PARTITION BY market)) AND c[-1] <= (max(h) FILTER (i < 60) OVER (PARTITION BY market))",
        "c < (min(l) FILTER (i < 60) OVER (PARTITION BY market)) AND c[-1] >= (min(l) FILTER (i < 60) OVER (PARTITION BY market))",
    ),
    "cpr_range": tuple(
        f"{price} {op} {outer}((max(h,-60..-11) + min(l,-60..-11)) / 2, 2 * (max(h,-60..-11) + min(l,-60..-11) + c[-11]) / 3 - (max(h,-60..-11) + min(l,-60..-11)) / 2) "
        f"AND c {other} {inner}((max(h,-60..-11) + min(l,-60..-11)) / 2, 2 * (max(h,-60..-11) + min(l,-60..-11) + c[-11]) / 3 - (max(h,-60..-11) + min(l,-60..-11)) / 2) AND c {other} c[-1]"
        for price, op, outer, other, inner in (("l", "<=", "greatest", ">", "least"), ("h", ">=", "least", "<", "greatest"))
    ),
    "poor_high_low": ("h >= max(h,-5..-1) AND body > 0 AND uw / body < 0.05", "l <= min(l,-5..-1) AND body > 0 AND lw / body < 0.05"),
    "tails": ("l <= min(l,-20..-1) AND lw > 2 * body AND lw > 0", "h >= max(h,-20..-1) AND uw > 2 * body AND uw > 0"),
    "snap_back": ("c < 0.995 * avg(c,-20..-1) AND c > c[-1]", "c > 1.005 * avg(c,-20..-1) AND c < c[-1]"),
    "momentum_impulse": ("body > 2 * avg(rng,-14..-1) AND up", "body > 2 * avg(rng,-14..-1) AND dn"),
    "compression_liquidity": ("h < h[-5] AND avg(rng,-5..-1) < 0.7 * avg(rng,-15..-11)", "l > l[-5] AND avg(rng,-5..-1) < 0.7 * avg(rng,-15..-11)"),
    "master_pattern": ("std(c,-3..-1) > 2 * std(c,-15..-4) AND c > c[-3]", "std(c,-3..-1) > 2 * std(c,-15..-4) AND c < c[-3]"),
    "judas_swing": ("fall[-1] > 2 * std(c,-10..-3) AND up AND c > o[-1]", "rise[-1] > 2 * std(c,-10..-3) AND dn AND c < o[-1]"),
    "value_area": ("l <= avg(c,-50..-1) - 0.7 * std(c,-50..-1) AND c > avg(c,-50..-1) - 0.7 * std(c,-50..-1)", "h >= avg(c,-50..-1) + 0.7 * std(c,-50..-1) AND c < avg(c,-50..-1) + 0.7 * std(c,-50..-1)"),
    "dist_accum": ("std(c,-10..-3) < std(c,-30..-11) AND l[-1] < min(l,-30..-3) AND c > c[-1] AND c > min(l,-30..-3)", "std(c,-10..-3) < std(c,-30..-11) AND h[-1] > max(h,-30..-3) AND c < c[-1] AND c < max(h,-30..-3)"),
    "effort_vs_result": ("rng > 2 * avg(rng,-10..-2) AND body < 0.3 * rng AND c > l + 0.6 * rng", "rng > 2 * avg(rng,-10..-2) AND body < 0.3 * rng AND c < h - 0.6 * rng"),
    "stopping_volume": ("fall[-1] > 2 * avg(rng,-10..-3) AND rng < 0.5 * rng[-1] AND l >= l[-1] AND up", "rise[-1] > 2 * avg(rng,-10..-3) AND rng < 0.5 * rng[-1] AND h <= h[-1] AND dn"),
    "mitigation_block_v1": _breaker(14),
    "unicorn_model": (f"{_breaker(9)[0]} AND {some(1, 3, 'l[-{k}] > h[-{k2}]')}", f"{_breaker(9)[1]} AND {some(1, 3, 'h[-{k}] < l[-{k2}]')}"),
    "inverted_fvg": (some(1, 4, "c[-{k}] < 0.998 * o[-{k}] AND c > h[-{k}] AND l <= 1.001 * h[-{k}]"), some(1, 4, "c[-{k}] > 1.002 * o[-{k}] AND c < l[-{k}] AND h >= 0.999 * l[-{k}]")),
    "rejection_block": (some(1, 9, "lw[-{k}] > 1.5 * body[-{k}] AND l[-{k}] < l AND l < minb[-{k}] AND c > l"), some(1, 9, "uw[-{k}] > 1.5 * body[-{k}] AND maxb[-{k}] < h AND h < h[-{k}] AND c < h")),
    "liquidity_void": (some(1, 5, "body[-{k}] > 3 * avg(body,-{b}..-{a}) AND up[-{k}] AND o[-{k}] < l AND l < c[-{k}]"), some(1, 5, "body[-{k}] > 3 * avg(body,-{b}..-{a}) AND dn[-{k}] AND c[-{k}] < h AND h < o[-{k}]")),
    "volume_imbalance": (some(1, 9, "minb[-{k}] > maxb[-{k1}] AND l <= (minb[-{k}] + maxb[-{k1}]) / 2 AND c > l"), some(1, 9, "maxb[-{k}] < minb[-{k1}] AND h >= (maxb[-{k}] + minb[-{k1}]) / 2 AND c < h")),
    "mean_threshold_retest": (some(1, 4, "up[-{k}] AND rng[-{k}] <> 0 AND l <= mid[-{k}] AND mid[-{k}] <= c"), some(1, 4, "dn[-{k}] AND c <= mid[-{k}] AND mid[-{k}] <= h")),
    "wick_consequent_encroachment": (some(1, 4, "rng[-{k}] > 0 AND lw[-{k}] > 0.4 * rng[-{k}] AND l <= l[-{k}] + 0.5 * lw[-{k}]"), some(1, 4, "rng[-{k}] > 0 AND uw[-{k}] > 0.4 * rng[-{k}] AND h >= h[-{k}] - 0.5 * uw[-{k}]")),
    "sponsor_candle": (some(1, 4, "body[-{k}] > 2.5 * avg(body,-{b}..-{a}) AND up[-{k}] AND l <= h[-{k}] AND c >= l[-{k}]"), some(1, 4, "body[-{k}] > 2.5 * avg(body,-{b}..-{a}) AND dn[-{k}] AND h >= l[-{k}] AND c <= h[-{k}]")),
    "partial_void_fill": (some(1, 5, "up[-{k}] AND rise[-{k}] > 2 * avg(rng,-{b}..-{a}) AND l <= mb[-{k}] AND mb[-{k}] <= c"), some(1, 5, "dn[-{k}] AND c <= mb[-{k}] AND mb[-{k}] <= h")),
    "inverse_fvg": (
        some(2, 9, "l[-{k2}] > h[-{k}] AND max(c,-{j}..-1) > l[-{k2}] AND l <= l[-{k2}] AND c >= h[-{k}] AND c > c[-1]"),
        some(2, 9, "h[-{k2}] < l[-{k}] AND min(c,-{j}..-1) < h[-{k2}] AND h >= h[-{k2}] AND c <= l[-{k}] AND c < c[-1]"),
    ),
    "single_prints": (some(2, 9, "rise[-{k}] > 0 AND rise[-{k}] > 3 * avg(body,-{b}..-{a}) AND l <= c[-{k}] AND c >= o[-{k}] AND up"), some(2, 9, "fall[-{k}] > 0 AND fall[-{k}] > 3 * avg(body,-{b}..-{a}) AND h >= c[-{k}] AND c <= o[-{k}] AND dn")),
    "engineered_liquidity": (count(1, 19, "l < l[-{k}] AND l[-{k}] < 1.001 * l") + " >= 2 AND c > l", count(1, 19, "0.999 * h < h[-{k}] AND h[-{k}] < h") + " >= 2 AND c < h"),
    "composite_operator": (count(1, 9, "abs(l[-{k}] - l) < 0.0005 * l") + " >= 2 AND c > c[-1]", count(1, 9, "abs(h[-{k}] - h) < 0.0005 * h") + " >= 2 AND c < c[-1]"),
    "inducement": tuple(
        f"{p} {lt} p AND c {gt} p".replace(" p", " CASE " + " ".join(f"WHEN {p}[-{k}] {lt} {p}[-{k + 1}] AND {p}[-{k}] {lt} {p}[-{k - 1}] THEN {p}[-{k}]" for k in (5, 4, 3, 2)) + " END") for p, lt, gt in (("l", "<", ">"), ("h", ">", "<"))
    ),
    "nwog": tuple(some(1, 49, "abs(o[-{k}] - c[-{k1}]) > 0.0005 * c[-{k1}] AND l <= greatest(o[-{k}], c[-{k1}]) AND h >= least(o[-{k}], c[-{k1}])") + last for last in (" AND c > l", " AND c < h")),
    "volume_void": (some(1, 19, "rise[-{k}] > 3 * avg(body,-{b}..-{a}) AND o[-{k}] + 0.5 * rise[-{k}] BETWEEN l AND c"), some(1, 19, "fall[-{k}] > 3 * avg(body,-{b}..-{a}) AND c[-{k}] + 0.5 * fall[-{k}] BETWEEN c AND h")),
    "triple_tap": tuple(
        "CASE " + " ".join(f"WHEN {p}[-{k}] {lt} {p}[-{k + 1}] AND {p}[-{k}] {lt} {p}[-{k - 1}] THEN " + some(k + 3, k + 5, p + "[-{k}] " + lt + " " + p + "[-{k1}] AND " + p + "[-{k}] " + lt + " " + p + "[-{j}]") for k in (5, 4, 3)) + " END"
        for p, lt in (("l", "<"), ("h", ">"))
    ),
}

_NAMED = {
    "bullish_engulfing": "dn[-1] AND up AND o < c[-1] AND c > o[-1]",
    "bearish_engulfing": "up[-1] AND dn AND o > c[-1] AND c < o[-1]",
    "inside_bar": "h < h[-1] AND l > l[-1]",
    "morning_star": "dn[-2] AND body[-1] <= 0.6 * body[-2] AND up AND c > mb[-2]",
    "bullish_pin_bar": "lw >= 2 * body AND uw <= body AND rng > 0",
    "bullish_imbalance": "l - h[-2] > 0.0002 * c",
    "bearish_imbalance": "l[-2] - h > 0.0002 * c",
    "bullish_order_block": "dn[-1] AND up AND body > 2 * body[-1]",
    "bearish_order_block": "up[-1] AND dn AND body > 2 * body[-1]",
    "balanced_price_range": "up[-2] AND dn[-1] AND least(h[-2], h[-1]) > greatest(l[-2], l[-1]) AND c BETWEEN greatest(l[-2], l[-1]) AND least(h[-2], h[-1])",
    "kill_zone": "strftime(ts + INTERVAL '5 hours 30 minutes', '%H:%M:%S') BETWEEN '09:15:00' AND '11:00:00' OR strftime(ts + INTERVAL '5 hours 30 minutes', '%H:%M:%S') BETWEEN '13:30:00' AND '15:00:00'",
    "breakout_up": "c > max(h,-20..-1)",
    "breakout_down": "c < min(l,-20..-1)",
    "liquidity_sweep_low": "l < min(l,-20..-1) AND c > min(l,-20..-1)",
    "liquidity_sweep_high": "h > max(h,-20..-1) AND c < max(h,-20..-1)",
    "discount_zone": "c < (max(h,-50..-1) + min(l,-50..-1)) / 2",
    "premium_zone": "c > (max(h,-50..-1) + min(l,-50..-1)) / 2",
    "wyckoff_spring_bullish": "(l[-1] < min(l,-20..-6) OR l < min(l,-20..-6)) AND c > min(l,-20..-6) AND c > c[-1]",
    "wyckoff_upthrust_bearish": "(h[-1] > max(h,-20..-6) OR h > max(h,-20..-6)) AND c < max(h,-20..-6) AND c < c[-1]",
    "wyckoff_lps_bullish": "c[-3] > max(h,-15..-6) AND l BETWEEN 0.998 * max(h,-15..-6) AND 1.01 * max(h,-15..-6) AND c > c[-1]",
    "wyckoff_lpsy_bearish": "c[-3] < min(l,-15..-6) AND h BETWEEN 0.99 * min(l,-15..-6) AND 1.002 * min(l,-15..-6) AND c < c[-1]",
    "volatility_squeeze": "rng < 0.5 * avg(rng,-20..-1)",
    "wyckoff_sos_bullish": "rise > 2 * avg(body,-10..-2) AND c > h[-1]",
    "wyckoff_sow_bearish": "fall > 2 * avg(body,-10..-2) AND c < l[-1]",
    "vsa_no_supply_bullish": "dn AND rng < 0.7 * avg(rng,-3..-1) AND l <= min(l,-10..-1)",
    "vsa_no_demand_bearish": "up AND rng < 0.7 * avg(rng,-3..-1) AND h >= max(h,-10..-1)",
    "vsa_shakeout_bullish": "rng > 1.5 * avg(rng,-5..-2) AND l < min(l,-10..-3) AND c > l + 0.7 * rng",
    "vsa_shakeout_bearish": "rng > 1.5 * avg(rng,-5..-2) AND h > max(h,-10..-3) AND c < l + 0.3 * rng",
    "selling_climax_bullish": "c[-1] < avg(c,-20..-2) AND rng > 2.5 * avg(rng,-10..-2) AND lw > 0.4 * rng",
    "buying_climax_bearish": "c[-1] > avg(c,-20..-2) AND rng > 2.5 * avg(rng,-10..-2) AND uw > 0.4 * rng",
    "bullish_breaker": _breaker(9)[0],
    "bearish_breaker": _breaker(9)[1],
}

CONDITIONS = {**_NAMED, **{f"{n}_{d}": t for n, pair in _PAIRS.items() for d, t in zip(("bullish", "bearish"), pair, strict=True)}}


def simple(names: list[str], guards: dict[str, int], bars: str) -> str:
    """Detectors of ``names`` for every bar, from window expressions alone."""
    columns = ",\n  ".join(f"coalesce(i >= {guards[n]} AND ({windows(CONDITIONS[n])}), false) AS detect_{n}" for n in names)
    return f"WITH {BASE.format(bars=bars)}\nSELECT market, CAST(epoch(ts) AS BIGINT) AS ts_epoch,\n  {columns}\nFROM shaped WINDOW w AS (PARTITION BY market ORDER BY ts)"


def _earlier(n: int) -> str:
    """For each bar the n bars before it, side by side with it."""
    return f"SELECT a.market, a.ts, a.i, a.o, a.h, a.l, a.c, a.pc, b.i AS j, b.h AS bh, b.l AS bl, b.c AS bc, b.pl, b.nl, b.ph, b.nh FROM shaped a JOIN shaped b ON a.market = b.market AND b.i BETWEEN a.i - {n} AND a.i - 1"


def positions(bars: str) -> str:
    """Detectors that start at an extreme's position, by self joins."""
    return f"""WITH {BASE.format(bars=bars)},
near AS ({_earlier(20)}),
pits AS (SELECT market, i, min(j) FILTER (bl = m) AS p, min(j) FILTER (bh = x) AS q, min(m) AS m, min(x) AS x
         FROM (SELECT *, min(bl) OVER (PARTITION BY market, i) AS m, max(bh) OVER (PARTITION BY market, i) AS x FROM near) GROUP BY market, i),
since AS (SELECT n.market, n.i, max(bh) FILTER (j >= p) AS hs, min(bl) FILTER (j >= q) AS ls FROM near n JOIN pits USING (market, i) GROUP BY n.market, n.i)
SELECT market, CAST(epoch(ts) AS BIGINT) AS ts_epoch,
  coalesce(i >= 20 AND p <= i - 3 AND c > hs, false) AS detect_market_structure_shift_bullish,
  coalesce(i >= 20 AND q <= i - 3 AND c < ls, false) AS detect_market_structure_shift_bearish,
  coalesce(i >= 20 AND p <= i - 2 AND hs <> m AND l BETWEEN 0.999 * (hs - 0.786 * (hs - m)) AND hs - 0.618 * (hs - m) AND c > l, false) AS detect_optimal_trade_entry_long,
  coalesce(i >= 20 AND q <= i - 2 AND x <> ls AND h BETWEEN ls + 0.618 * (x - ls) AND 1.001 * (ls + 0.786 * (x - ls)) AND c < h, false) AS detect_optimal_trade_entry_short
FROM shaped LEFT JOIN pits USING (market, i) LEFT JOIN since USING (market, i)"""


def arrays(names: list[str], guards: dict[str, int], bars: str) -> str:
    """The array detectors: what windows can say, and chains of joins for the rest."""
    plain = [n for n in names if n in CONDITIONS]
    columns = ",\n  ".join(f"coalesce(i >= {guards[n]} AND ({windows(CONDITIONS[n])}), false) AS detect_{n}" for n in plain)

    def dragon(side: str, first: str, then: str, sign: str, value: str) -> str:
        return f"""
r_{side} AS (SELECT market, i, {first}(j, (b{value}, {'-' if first == 'arg_min' else ''}j)) AS r FROM far WHERE j >= i - 9 GROUP BY market, i),
u_{side} AS (SELECT a.market, a.i, a.r, {then}(b.i, (b.c, {'-' if then == 'arg_max' else ''}b.i)) AS u FROM r_{side} a JOIN shaped b ON a.market = b.market AND b.i BETWEEN greatest(a.r - 10, a.i - 29) AND a.r - 1 GROUP BY ALL),
e_{side} AS (SELECT a.market, a.i, a.r, a.u, {'min' if first == 'arg_min' else 'max'}(b.{value}) AS e FROM u_{side} a JOIN shaped b ON a.market = b.market AND b.i BETWEEN greatest(a.u - 10, a.i - 29) AND a.u - 1 GROUP BY ALL),
d_{side} AS (SELECT e.market, e.i, r.{value} / e.e > 0.98 AND r.{value} / e.e < 1.02 AND a.c {sign} u.c AS hit FROM e_{side} e JOIN shaped r ON r.market = e.market AND r.i = e.r JOIN shaped u ON u.market = e.market AND u.i = e.u JOIN shaped a ON a.market = e.market AND a.i = e.i)"""

    def quasimodo(side: str, pick: str, v: str, w: str, agg: str, lt: str, gt: str) -> str:
        return f"""
a_{side} AS (SELECT market, i, {pick}(j, (b{v}, {'' if pick == 'arg_min' else '-'}j)) AS p FROM far WHERE j BETWEEN i - 25 AND i - 6 GROUP BY market, i),
b_{side} AS (SELECT a.market, a.i, a.p, max(b.i) AS d FROM a_{side} a JOIN shaped q ON q.market = a.market AND q.i = a.p JOIN shaped b ON b.market = a.market AND b.i BETWEEN greatest(a.p - 10, a.i - 36) AND a.p - 1
             WHERE b.{v} {lt} b.p{v} AND b.{v} {lt} b.n{v} AND b.{v} {gt} q.{v} GROUP BY ALL),
q_{side} AS (SELECT a.market, a.i, coalesce({agg}(b.{w}) FILTER (b.i > a.p) {gt} {agg}(b.{w}) FILTER (b.i >= a.d AND b.i < a.p) AND abs(any_value(x.{v}) - any_value(y.{v})) < 0.001 * any_value(y.{v}), false) AS hit
             FROM b_{side} a JOIN shaped x ON x.market = a.market AND x.i = a.i JOIN shaped y ON y.market = a.market AND y.i = a.d JOIN shaped b ON b.market = a.market AND b.i BETWEEN a.d AND a.i - 1 GROUP BY a.market, a.i)"""

    return f"""WITH {BASE.format(bars=bars)},
far AS ({_earlier(36)}),{dragon('up', 'arg_min', 'arg_max', '>', 'l')},{dragon('down', 'arg_max', 'arg_min', '<', 'h')},{quasimodo('up', 'arg_min', 'l', 'h', 'max', '<', '>')},{quasimodo('down', 'arg_max', 'h', 'l', 'min', '>', '<')},
hundred AS (SELECT market, i, j, bc, min(bc) OVER v AS low, (max(bc) OVER v - min(bc) OVER v) / 20 AS width FROM ({_earlier(100)}) WHERE i >= 100 WINDOW v AS (PARTITION BY market, i)),
binned AS (SELECT market, i, low, width, CASE WHEN width = 0 THEN 0 ELSE least(floor((bc - low) / width), 19) END AS k, count(*) AS n FROM hundred GROUP BY ALL),
level AS (SELECT market, i, arg_max(low + k * width, (n, -k)) AS poc FROM binned GROUP BY market, i),
plain AS (SELECT market, ts, i, o, h, l, c, pc,
  {columns}
FROM shaped WINDOW w AS (PARTITION BY market ORDER BY ts))
SELECT p.market, CAST(epoch(ts) AS BIGINT) AS ts_epoch, {', '.join(f'detect_{n}' for n in plain)},
  coalesce(p.i >= 20 AND du.hit, false) AS detect_dragon_pattern_bullish, coalesce(p.i >= 20 AND dd.hit, false) AS detect_dragon_pattern_bearish,
  coalesce(p.i >= 25 AND qu.hit, false) AS detect_quasimodo_pattern_bullish, coalesce(p.i >= 25 AND qd.hit, false) AS detect_quasimodo_pattern_bearish,
  coalesce(p.i >= 100 AND l <= poc AND c > poc AND c > pc, false) AS detect_poc_level_rejection_bullish, coalesce(p.i >= 100 AND h >= poc AND c < poc AND c < pc, false) AS detect_poc_level_rejection_bearish
FROM plain p LEFT JOIN d_up du ON du.market = p.market AND du.i = p.i LEFT JOIN d_down dd ON dd.market = p.market AND dd.i = p.i
LEFT JOIN q_up qu ON qu.market = p.market AND qu.i = p.i LEFT JOIN q_down qd ON qd.market = p.market AND qd.i = p.i LEFT JOIN level v ON v.market = p.market AND v.i = p.i"""
