"""DuckDB twins of the queries other than detectors."""

from __future__ import annotations


def _bars(market: str, ts: str, tie: str, price: str, volume: str, table: str, bucket: str) -> str:
    return (
        f"SELECT {market} AS market, {bucket} AS ts, first({price} ORDER BY {ts}, {tie}) AS open, max({price}) AS high, min({price}) AS low, last({price} ORDER BY {ts}, {tie}) AS close, "
        f"CAST(coalesce(sum({volume}), 0) AS DOUBLE) AS volume FROM {table} WHERE {price} IS NOT NULL AND {ts} IS NOT NULL GROUP BY 1, 2"
    )


_K = "TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)"
BARS_1H = _bars("event_type", "ts", "event_id", "value", _K, "events", "time_bucket(INTERVAL 1 hour, ts)")
BARS_5M = _bars("event_type", "ts", "event_id", "value", _K, "events", "time_bucket(INTERVAL 5 minutes, ts)")
BARS_1D = _bars("o_orderpriority", "o_orderdate", "o_orderkey", "o_totalprice", "1.0", "orders", "date_trunc('day', o_orderdate)")
BARS_LINES = _bars("l_returnflag", "l_shipdate", "(l_orderkey * 8 + l_linenumber)", "l_extendedprice", "l_quantity", "lineitem", "date_trunc('day', l_shipdate)")
_EPOCH = "CAST(epoch(ts) AS BIGINT) AS ts_epoch"


def _shown(bars: str, timeframe: str) -> str:
    return f"SELECT market, '{timeframe}' AS timeframe, {_EPOCH}, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume FROM ({bars})"


def _series(bars: str, keys: str = "market") -> str:
    """Numbered bars with true range, gain and loss."""
    return f"""s AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY {keys}) AS n, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr,
       greatest(close - lag(close) OVER w, 0) AS gain, greatest(lag(close) OVER w - close, 0) AS loss, (high + low + close) / 3 AS tp
       FROM ({bars}) WINDOW w AS (PARTITION BY {keys} ORDER BY ts))"""


def _recurrence(name: str, value: str, q: str, first: int, seed: int, keys: tuple[str, ...] = ("market",)) -> str:
    """A recursive walk over each series from its seed on."""
    cols = ", ".join(keys)
    on = " AND ".join(f"b.{k} = r.{k}" for k in keys)
    return f"""{name}({cols}, i, e) AS (
    SELECT {cols}, {seed}, avg({value}) FROM s WHERE i BETWEEN {first} AND {seed} GROUP BY {cols} HAVING count(*) = {seed - first + 1}
    UNION ALL SELECT {", ".join("b." + k for k in keys)}, b.i, {q} * r.e + (1 - {q}) * b.{value} FROM {name} r JOIN s b ON {on} AND b.i = r.i + 1)"""


def _indicator(ctes: list[str], columns: str, joins: str, bars: str = BARS_1H) -> str:
    return f"WITH RECURSIVE {_series(bars)}" + "".join(f", {c}" for c in ctes) + f" SELECT s.market, {_EPOCH}, {columns} FROM s {joins}"


def _ema(period: int, name: str | None = None, keys: tuple[str, ...] = ("market",)) -> str:
    return _recurrence(name or f"e{period}", "close", f"({period - 1}.0 / {period + 1})", 0, period - 1, keys)


_VWAP = "CASE WHEN sum(volume) OVER {w} > 0 THEN sum(tp * volume) OVER {w} / sum(volume) OVER {w} END"
_RUN = "(PARTITION BY {k} ORDER BY ts ROWS UNBOUNDED PRECEDING)"


def _window_bars(periods: tuple[int, ...], bars: str = BARS_1H) -> str:
    days = ", ".join(map(str, periods))
    return f"SELECT b.*, p.d AS period_days FROM ({bars}) b, (SELECT unnest([{days}]) AS d) p WHERE b.ts > (SELECT max(ts) FROM ({bars})) + INTERVAL 1 microsecond - to_days(CAST(p.d AS INTEGER))"


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
RULES = {
    "price_above_ema_fast": "close > f", "price_above_ema_slow": "close > w", "price_below_ema_slow": "close < w", "pullback_to_ema_fast": "low <= f AND f <= close", "rally_to_ema_fast": "close <= f AND f <= high",
    "pullback_to_vwap": "low <= vwap AND vwap <= close", "rally_to_vwap": "close <= vwap AND vwap <= high", "price_within_0.5pct_of_vwap": "abs(close - vwap) <= 0.005 * close",
    "close_above_vwap_upper_band": "close > vwap + 2 * sd", "close_below_vwap_lower_band": "close < vwap - 2 * sd", "rsi_oversold_bounce": "rsi <= 30", "rsi_crossed_above_30": "prsi <= 30 AND rsi > 30",
    "rsi_crossed_below_70": "prsi >= 70 AND rsi < 70", "rsi_between_40_60": "rsi BETWEEN 40 AND 60", "breakout_below_20bar_low": "i >= 20 AND close < lo20", "price_near_support": "i >= 20 AND abs(close - lo20) <= 0.005 * close",
    "price_near_resistance": "i >= 20 AND abs(close - hi20) <= 0.005 * close", "is_in_kill_zone": "strftime(ts, '%H:%M:%S') BETWEEN '09:15:00' AND '11:00:00' OR strftime(ts, '%H:%M:%S') BETWEEN '13:30:00' AND '15:00:00'",
    "ema_fast_above_slow": "f > w", "ema_fast_below_slow": "f < w", "price_above_both_emas": "close > f AND close > w", "price_below_both_emas": "close < f AND close < w",
    "price_above_vwap": "vwap IS NULL OR close > vwap", "price_below_vwap": "vwap IS NULL OR close < vwap", "rsi_above_30": "rsi > 30", "rsi_below_70": "rsi < 70", "breakout_above_20bar_high": "i >= 20 AND close > hi20",
}


def _tokens() -> str:
    """Counts of RULES over ``ready``."""
    flags = ", ".join(f'coalesce({c}, false) AS "{n}"' for n, c in RULES.items())
    series = "PARTITION BY market, period_days ORDER BY ts"
    return f""" SELECT market, period_days, rule, count(*) AS bars FROM (UNPIVOT (SELECT market, period_days, {flags} FROM (SELECT *, e9 AS f, e21 AS w, lag(rsi) OVER ({series}) AS prsi,
        CASE WHEN i = 0 THEN 0 ELSE coalesce(stddev_pop(close - vwap) OVER ({series} ROWS UNBOUNDED PRECEDING), 0) END AS sd FROM ready)) ON COLUMNS(* EXCLUDE (market, period_days)) INTO NAME rule VALUE hit) WHERE hit GROUP BY ALL"""


def _leaves(strategies, exits) -> tuple[str, str, str]:
    """A CTE with the bars of signal exits, its join to the walk, and the condition under which a position leaves by them."""
    if not exits:
        return "", "", "false"
    crossed = ", ".join(f"e{f} < e{s} AND lag(e{f}) OVER v >= lag(e{s}) OVER v AS down{f}, e{f} > e{s} AND lag(e{f}) OVER v <= lag(e{s}) OVER v AS up{f}" for f, s in sorted({(s[4], s[5]) for s in strategies}))
    cte = f"""leaves AS MATERIALIZED (SELECT market, period_days, i, {crossed}, close < vwap AND lag(close) OVER v >= lag(vwap) OVER v AS below, close > vwap AND lag(close) OVER v <= lag(vwap) OVER v AS above,
        lead(CAST(ts AS DATE)) OVER v <> CAST(ts AS DATE) AS ends FROM ready WINDOW v AS (PARTITION BY market, period_days ORDER BY ts)),"""
    side = lambda long, short: f"CASE k.direction WHEN 'LONG' THEN x.{long} ELSE x.{short} END"
    fast = {s[0]: s[4] for s in strategies}
    when = {"ema_crossover_reversal": lambda s: side(f"down{fast[s]}", f"up{fast[s]}"), "price_crosses_vwap_opposite": lambda s: side("below", "above"), "end_of_session": lambda s: "x.ends"}
    cases = " ".join(f"WHEN '{s}' THEN " + " OR ".join(f"coalesce({when[n](s)}, false)" for n in names) for s, names in exits.items())
    return cte, "LEFT JOIN leaves x ON x.market = b.market AND x.period_days = b.period_days AND x.i = b.i", f"coalesce(CASE k.strategy_id {cases} END, false)"


def _backtest(strategies, periods, exits=None, bars: str = BARS_1H, compat: bool = False) -> str:
    """CTEs ready, asked, signals and the walk over them, up to ``trades``."""
    keys = ("market", "period_days")
    leaves, join_leaves, leave = _leaves(strategies, exits)
    rules = {
        "ema_fast_above_slow": "f > w", "ema_fast_below_slow": "f < w", "price_above_both_emas": "close > f AND close > w", "price_below_both_emas": "close < f AND close < w",
        "price_above_vwap": "vwap IS NULL OR close > vwap", "price_below_vwap": "vwap IS NULL OR close < vwap", "rsi_above_30": "rsi > 30", "rsi_below_70": "rsi < 70",
        "breakout_above_20bar_high": "i >= 20 AND close > hi20", "detect_liquidity_sweep_low": "i >= 20 AND low < lo20 AND close > lo20",
        "detect_bullish_engulfing": "i >= 1 AND pc < po AND close > open AND open < pc AND close > po", "detect_bearish_engulfing": "i >= 1 AND pc > po AND close < open AND open > pc AND close < po",
        "detect_inside_bar": "i >= 1 AND high < ph AND low > pl", "detect_discount_zone": "i >= 50 AND close < (hi50 + lo50) / 2",
    }
    if compat:  # rules that the dispatch does not test count as met; one sees high and low exchanged
        rules |= dict.fromkeys(("rsi_above_30", "rsi_below_70", "breakout_above_20bar_high", "detect_mitigation_block_bullish"), "true")
        rules["detect_stopping_volume_bullish"] = "i >= 10 AND po - pc > 2 * rng8 AND low - high < 0.5 * (pl - ph) AND high >= ph AND close > open"
    stops = {
        "1.5x_atr_from_entry": "coalesce(1.5 * atr, 0.01 * close)", "2x_atr_from_entry": "coalesce(2.0 * atr, 0.01 * close)", "0.5pct_from_entry": "0.005 * close", "1pct_from_entry": "0.01 * close",
        "entry_candle_stop": "greatest(abs(close - low), abs(high - close))", "swing_point_stop": "coalesce(1.5 * atr, 0.01 * close)",
    }
    same = lambda t: f"LEFT JOIN {t} ON {t}.market = s.market AND {t}.period_days = s.period_days AND {t}.i = s.i"
    asked = " UNION ALL ".join(
        f"SELECT '{sid}' AS strategy_id, market, period_days, i, CASE WHEN f > w THEN 'LONG' ELSE 'SHORT' END AS direction, close, {stops[stop]} AS d, {rr} AS rr FROM (SELECT *, e{fast} AS f, e{slow} AS w FROM ready) WHERE f <> w AND "
        + " AND ".join(f"coalesce({rules[r]}, false)" for r in entry)
        for sid, entry, stop, rr, fast, slow in strategies
    )
    return f"""WITH RECURSIVE {_series(_window_bars(periods, bars), "market, period_days")},
{_ema(9, "a9", keys)}, {_ema(13, "a13", keys)}, {_ema(21, "a21", keys)}, {_ema(34, "a34", keys)},
{_recurrence("up", "gain", "(13.0 / 14)", 1, 14, keys)}, {_recurrence("down", "loss", "(13.0 / 14)", 1, 14, keys)}, {_recurrence("tr14", "tr", "(13.0 / 14)", 0, 13, keys)},
ready AS (SELECT s.*, a9.e AS e9, a13.e AS e13, a21.e AS e21, a34.e AS e34, CASE WHEN down.e = 0 THEN 100 ELSE 100 - 100 / (1 + up.e / down.e) END AS rsi, CASE WHEN n > 14 THEN tr14.e END AS atr,
       {_VWAP.format(w=_RUN.format(k="s.market, s.period_days"))} AS vwap, max(high) OVER (v ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS hi20, min(low) OVER (v ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS lo20,
       max(high) OVER (v ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS hi50, min(low) OVER (v ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS lo50,
       avg(low - high) OVER (v ROWS BETWEEN 10 PRECEDING AND 3 PRECEDING) AS rng8, lag(open) OVER v AS po, lag(close) OVER v AS pc, lag(high) OVER v AS ph, lag(low) OVER v AS pl
    FROM s {" ".join(map(same, ("a9", "a13", "a21", "a34", "up", "down", "tr14")))} WINDOW v AS (PARTITION BY s.market, s.period_days ORDER BY ts)),
signals AS (SELECT *, CASE direction WHEN 'LONG' THEN close - d ELSE close + d END AS stop, CASE direction WHEN 'LONG' THEN close + d * rr ELSE close - d * rr END AS target FROM ({asked})),
{leaves}
walk AS (
    SELECT p.strategy_id, p.market, p.period_days, 49 AS i, CAST(NULL AS BIGINT) AS since, CAST(NULL AS VARCHAR) AS direction, CAST(NULL AS DOUBLE) AS price, CAST(NULL AS DOUBLE) AS stop, CAST(NULL AS DOUBLE) AS target,
           CAST(NULL AS BIGINT) AS was_at, CAST(NULL AS VARCHAR) AS was, CAST(NULL AS DOUBLE) AS paid, CAST(NULL AS DOUBLE) AS got
    FROM (SELECT DISTINCT strategy_id, market, period_days FROM signals) p
    UNION ALL
    SELECT strategy_id, market, period_days, i, CASE WHEN left_ THEN NULL WHEN held THEN since ELSE s_i END, CASE WHEN left_ THEN NULL WHEN held THEN direction ELSE s_direction END,
           CASE WHEN left_ THEN NULL WHEN held THEN price ELSE s_close END, CASE WHEN left_ THEN NULL WHEN held THEN stop ELSE s_stop END, CASE WHEN left_ THEN NULL WHEN held THEN target ELSE s_target END,
           CASE WHEN left_ THEN since END, CASE WHEN left_ THEN direction END, CASE WHEN left_ THEN price END, CASE WHEN left_ THEN fetched END
    FROM (SELECT k.strategy_id, k.market, k.period_days, b.i, k.since, k.direction, k.price, k.stop, k.target, k.since IS NOT NULL AS held, g.i AS s_i, g.direction AS s_direction, g.close AS s_close, g.stop AS s_stop, g.target AS s_target,
                 CASE WHEN k.since IS NULL THEN NULL WHEN k.direction = 'LONG' THEN CASE WHEN b.low <= k.stop THEN k.stop WHEN b.high >= k.target THEN k.target WHEN {leave} OR b.i = b.n - 1 THEN b.close END
                      ELSE CASE WHEN b.high >= k.stop THEN k.stop WHEN b.low <= k.target THEN k.target WHEN {leave} OR b.i = b.n - 1 THEN b.close END END AS fetched, fetched IS NOT NULL AS left_
          FROM walk k JOIN s b ON b.market = k.market AND b.period_days = k.period_days AND b.i = k.i + 1
          {join_leaves}
          LEFT JOIN signals g ON g.strategy_id = k.strategy_id AND g.market = k.market AND g.period_days = k.period_days AND g.i = b.i)),
trades AS (
    SELECT strategy_id, market, period_days, entry_idx, exit_idx, direction, entry_price, exit_price, CASE direction WHEN 'LONG' THEN exit_price - entry_price ELSE entry_price - exit_price END AS pnl, coalesce(pnl / nullif(entry_price, 0), 0) * 100 AS pnl_percent
    FROM (SELECT strategy_id, market, period_days, CAST(was_at AS INTEGER) AS entry_idx, CAST(i AS INTEGER) AS exit_idx, was AS direction, paid AS entry_price, got AS exit_price FROM walk WHERE got IS NOT NULL
          UNION ALL SELECT k.strategy_id, k.market, k.period_days, CAST(k.since AS INTEGER), CAST(k.i AS INTEGER), k.direction, k.price, k.price FROM walk k JOIN s b ON b.market = k.market AND b.period_days = k.period_days AND b.i = k.i WHERE k.since = k.i AND b.i = b.n - 1)),
curve AS (
    SELECT *, greatest(max(equity) OVER (PARTITION BY strategy_id, period_days ORDER BY trade_no), 0) - equity AS drawdown
    FROM (SELECT t.*, row_number() OVER q AS trade_no, sum(pnl) OVER (q ROWS UNBOUNDED PRECEDING) AS equity FROM trades t JOIN s b ON b.market = t.market AND b.period_days = t.period_days AND b.i = t.exit_idx
          WINDOW q AS (PARTITION BY t.strategy_id, t.period_days ORDER BY b.ts, t.market, t.entry_idx))),
results AS (
    SELECT p.strategy_id, p.period_days, coalesce(total_trades, 0) AS total_trades, coalesce(winning_trades, 0) AS winning_trades, coalesce(losing_trades, 0) AS losing_trades, coalesce(total_pnl, 0) AS total_pnl, coalesce(total_pnl_percent, 0) AS total_pnl_percent,
           coalesce(largest_win, 0) AS largest_win, coalesce(largest_loss, 0) AS largest_loss, coalesce(max_drawdown, 0) AS max_drawdown, coalesce(100.0 * winning_trades / total_trades, 0) AS win_rate, coalesce(profit / nullif(winning_trades, 0), 0) AS avg_win,
           coalesce(lost / nullif(losing_trades, 0), 0) AS avg_loss, coalesce(100 * largest_win / nullif(profit, 0), 0) AS largest_win_contribution, CASE WHEN total_trades IS NULL THEN 0 WHEN lost = 0 THEN 10 ELSE profit / lost END AS profit_factor,
           coalesce(max_drawdown, 0) / 1000 AS max_drawdown_percent, coalesce(1.0 * winning_trades / total_trades, 0) * avg_win - (1 - coalesce(1.0 * winning_trades / total_trades, 0)) * avg_loss AS expectancy
    FROM (SELECT strategy_id, d AS period_days FROM (SELECT unnest([{", ".join(f"'{s[0]}'" for s in strategies)}]) AS strategy_id), (SELECT unnest([{", ".join(map(str, periods))}]) AS d)) p
    LEFT JOIN (SELECT strategy_id, period_days, count(*) AS total_trades, count(*) FILTER (pnl > 0) AS winning_trades, count(*) FILTER (pnl <= 0) AS losing_trades, sum(pnl) AS total_pnl, sum(pnl_percent) AS total_pnl_percent,
                      coalesce(sum(pnl) FILTER (pnl > 0), 0) AS profit, abs(coalesce(sum(pnl) FILTER (pnl <= 0), 0)) AS lost, coalesce(max(pnl) FILTER (pnl > 0), 0) AS largest_win, abs(coalesce(min(pnl) FILTER (pnl <= 0), 0)) AS largest_loss, max(drawdown) AS max_drawdown
               FROM curve GROUP BY ALL) t USING (strategy_id, period_days))
"""


_TEMPLATES = """template AS (SELECT k, CASE WHEN k % 10 < 5 THEN 'institutional' WHEN k % 10 < 8 THEN 'price_action' WHEN k % 10 = 8 THEN 'vwap' ELSE 'ema' END AS type, CASE WHEN k % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS direction,
    'detect_' || k AS f1, CASE WHEN k % 3 = 0 THEN 'detect_discount_zone' ELSE 'price_above_vwap' END AS f2, f1 || '|' || f2 AS rules FROM t)"""
_STOPS = "SELECT unnest(['1.5x_atr_from_entry', '2x_atr_from_entry', '0.5pct_from_entry', '1pct_from_entry', 'swing_point_stop', 'entry_candle_stop']) AS stop"
_PAIRS = "SELECT * FROM (VALUES ('9', '21'), ('9', '34'), ('13', '21'), ('13', '34')) e(fast, slow)"


def _rounded(columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns.split())


def _profile(keys: str, rows: str, amount: str) -> str:
    """CTEs up to ``bins``: (keys, low, width, bin, amount) over 20 equal bins of closes."""
    return f"""rows AS ({rows}), spread AS (SELECT {keys}, min(close) AS low, (max(close) - min(close)) / 20 AS width FROM rows GROUP BY {keys}),
        bins AS (SELECT {keys}, spread.low AS low, width, CASE WHEN width = 0 THEN 0 ELSE CAST(least(floor((close - spread.low) / width), 19) AS INTEGER) END AS bin, CAST(sum({amount}) AS DOUBLE) AS amount FROM rows JOIN spread USING ({keys}) GROUP BY ALL)"""


def _value_area(keys: str) -> str:
    """Grows from the fullest bin, a bin a step, to 0.7 of the total."""
    both = lambda a: " AND ".join(f"{a}.{k.strip()} = g.{k.strip()}" for k in keys.split(","))
    return f"""whole AS (SELECT {keys}, low, width, sum(amount) AS total, min_by(bin, (-amount, bin)) AS poc, max(amount) AS most FROM bins GROUP BY ALL),
        grown AS (SELECT {keys}, poc AS a, poc AS z, most AS held FROM whole
            UNION ALL SELECT {", ".join("g." + k.strip() for k in keys.split(","))}, CASE WHEN below > above THEN a - 1 ELSE a END, CASE WHEN below > above THEN z ELSE z + 1 END, held + greatest(below, above)
            FROM (SELECT g.*, CASE WHEN g.a > 0 THEN coalesce(d.amount, 0) ELSE -1 END AS below, CASE WHEN g.z < 19 THEN coalesce(u.amount, 0) ELSE -1 END AS above, w.total
                  FROM grown g JOIN whole w ON {both("w")} LEFT JOIN bins d ON {both("d")} AND d.bin = g.a - 1 LEFT JOIN bins u ON {both("u")} AND u.bin = g.z + 1) g WHERE held < total * 0.7::DOUBLE AND (below >= 0 OR above >= 0)),
        best AS (SELECT {keys}, min(a) AS a, max(z) AS z, max(held) AS held FROM grown GROUP BY {keys})
        SELECT {keys}, round(low, 6) AS low, round(width, 6) AS width, round(total, 6) AS total, round(low + poc * width, 6) AS poc, round(low + a * width, 6) AS value_low, round(low + (z + 1) * width, 6) AS value_high, round(held, 6) AS value_amount FROM whole JOIN best USING ({keys})"""


def _screened(targets: dict[int, float]) -> str:
    """A CTE with each strategy's overall figures and flags."""
    wanted = " ".join(f"WHEN {d} THEN {t}" for d, t in targets.items())
    return f"""screened AS (
    SELECT *, (NOT all_periods_profitable)::int + (NOT low_drawdown)::int + (avg_expectancy < 0.5)::int + (avg_win_rate < 54)::int + (avg_profit_factor < 1.8)::int + (NOT on_target)::int + (NOT spread)::int AS n_failures
    FROM (SELECT strategy_id, bool_and(total_pnl > 0) AS all_periods_profitable, max(max_drawdown_percent) AS worst_drawdown, avg(win_rate) AS avg_win_rate, avg(expectancy) AS avg_expectancy, coalesce(avg(profit_factor) FILTER (profit_factor > 0), 0) AS avg_profit_factor,
                 CAST(coalesce(max(total_trades) FILTER (period_days = 365), 2 * max(total_trades) FILTER (period_days = 180), 6 * max(total_trades) FILTER (period_days = 60), 0) AS BIGINT) AS total_trades_per_year,
                 bool_and(max_drawdown_percent <= 22) AS low_drawdown, bool_and(total_pnl_percent >= CASE period_days {wanted} END) AS on_target, bool_and(largest_win_contribution <= 35) AS spread FROM results GROUP BY strategy_id))"""


def variants(strategies, accidental, periods, long_periods) -> dict[str, str]:
    """The screen over daily bars with its texts, and entries with the accidents of dispatch."""
    texts = "CASE WHEN NOT all_periods_profitable THEN 'not profitable in every period' END, CASE WHEN NOT low_drawdown THEN format('drawdown: {:,.2f}', worst_drawdown) END, CASE WHEN avg_expectancy < 0.5 THEN format('expectancy: {:,.2f}', avg_expectancy) END, CASE WHEN avg_win_rate < 54 THEN format('win rate: {:,.1f}', avg_win_rate) END, CASE WHEN avg_profit_factor < 1.8 THEN format('profit factor: {:,.2f}', avg_profit_factor) END, CASE WHEN NOT on_target THEN 'below the return target' END, CASE WHEN NOT spread THEN 'rests on a single trade' END"
    return {
        "screened_long": _backtest(strategies, long_periods, bars=BARS_1D) + f", {_screened({30: 1.06, 60: 1.5, 180: 2.75, 365: 4.50})} SELECT strategy_id, all_periods_profitable, total_trades_per_year, low_drawdown, on_target, spread, n_failures <= 1 AS passed, concat_ws('; ', {texts}) AS failures, " + _rounded("worst_drawdown avg_win_rate avg_expectancy avg_profit_factor") + " FROM screened",
        "rule_entries_compat": _backtest((*strategies, *accidental), periods, compat=True) + "SELECT strategy_id, market, period_days, CAST(i AS INTEGER) AS bar_idx, direction, round(stop, 6) AS stop, round(target, 6) AS target FROM signals",
    }


# Dimensions of the grid after the template, as (name, values, weights).
_AXES = (
    ("timeframe", ("1m", "5m", "15m"), (1, 1, 1)), ("vwap", ("", "price_above_vwap", "price_below_vwap", "price_within_0.5pct_of_vwap"), (3, 1, 1, 1)),
    ("rsi", ("", "rsi_below_70", "rsi_above_30", "rsi_crossed_above_30", "rsi_crossed_below_70", "rsi_between_40_60"), (70, 6, 6, 6, 6, 6)), ("zone", ("", "zone"), (1, 1)), ("clock", ("", "is_in_kill_zone"), (7, 3)),
    ("emas", ("9/21", "9/34", "13/21", "13/34"), (1, 1, 1, 1)), ("stop", ("1.5x_atr_from_entry", "2x_atr_from_entry", "0.5pct_from_entry", "1pct_from_entry", "swing_point_stop", "entry_candle_stop"), (1, 1, 1, 1, 1, 1)),
    ("leave", ("", "ema_crossover_reversal", "price_crosses_vwap_opposite", "end_of_session"), (3, 1, 1, 1)), ("rr", ("1.8", "2.0", "2.5", "3.0"), (1, 1, 1, 1)),
)


def drawn(templates, twice) -> str:
    """A strategy for each customer, by 32-bit numbers from MD5 against prefix sums of weights."""
    mixes = ((0.5, 0.3, 0.1, 0.1), (0.7, 0.2, 0.05, 0.05), (0.2, 0.7, 0.05, 0.05))
    types = ("institutional", "price_action", "vwap", "ema")
    times = [2 if len(r) == 1 and r[0][len("detect_") :] in twice else 1 for _, _, r in templates]
    rows = ", ".join(f"({i}, '{t}', '{d}', {list(r)!r}, {n})" for i, ((t, d, r), n) in enumerate(zip(templates, times, strict=True)))
    shares = ", ".join(f"({f}, '{t}', {w}::DOUBLE)" for f, mix in enumerate(mixes) for t, w in zip(types, mix, strict=True))
    u = lambda k: f"CAST(concat('0x', substr(md5('11~' || c_custkey || '~{k // 4}'), {k % 4 * 8 + 1}, 8)) AS BIGINT)"
    digits = ", ".join(f"len(list_filter({[round(sum(w[: j + 1]) / sum(w) * 2**32) for j in range(len(w) - 1)]}, lambda b: b <= {u(k)})) AS {n}_" for k, (n, _, w) in enumerate(_AXES, 1))
    values = ", ".join(f"({list(v)!r})[{n}_ + 1] AS {n}" for n, v, _ in _AXES if n != "zone")
    number = "template"
    for n, v, _ in _AXES:
        number = f"({number}) * {len(v)} + {'CASE WHEN zoned THEN 1 ELSE 0 END' if n == 'zone' else n + '_'}"
    return f"""WITH t AS (SELECT * FROM (VALUES {rows}) t(template, type, direction, rules, times)), mix AS (SELECT * FROM (VALUES {shares}) m(focus, type, share)),
        part AS (SELECT focus, t.*, share * times / sum(times) OVER (PARTITION BY focus, type) AS p FROM t JOIN mix USING (type)),
        bound AS (SELECT *, coalesce(round(sum(p) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) / sum(p) OVER a * 4294967296), 0) AS low, CASE WHEN template = {len(templates) - 1} THEN 4294967296 ELSE round(sum(p) OVER (o ROWS UNBOUNDED PRECEDING) / sum(p) OVER a * 4294967296) END AS top
            FROM part WINDOW o AS (PARTITION BY focus ORDER BY template), a AS (PARTITION BY focus)),
        c AS (SELECT c_custkey, c_nationkey % 3 AS focus, {u(0)} AS u, {digits} FROM customer),
        d AS (SELECT *, CASE direction WHEN 'LONG' THEN 'detect_discount_zone' ELSE 'detect_premium_zone' END AS side, zone_ = 1 AND type = 'institutional' AND NOT list_contains(rules, side) AS zoned, {values} FROM c JOIN bound ON bound.focus = c.focus AND u >= low AND u < top),
        e AS (SELECT *, array_to_string(list_concat(rules, list_filter([CASE WHEN zoned THEN side END, nullif(vwap, ''), nullif(rsi, ''), nullif(clock, '')], lambda x: x IS NOT NULL AND NOT list_contains(rules, x))), '|') AS entry,
            concat_ws('|', 'stop_loss_hit', 'take_profit_hit', nullif(leave, '')) AS leaves, CAST(split_part(emas, '/', 1) AS INTEGER) AS fast, CAST(split_part(emas, '/', 2) AS INTEGER) AS slow FROM d)
        SELECT c_custkey, CAST({number} AS BIGINT) AS number, left(md5(concat_ws('~', entry, leaves, stop, rr, timeframe, '*', fast, slow)), 16) AS strategy_id, type, direction, CAST(template AS INTEGER) AS template, entry, leaves AS leave, stop AS stop_loss_logic, CAST(rr AS DOUBLE) AS risk_reward, timeframe, fast AS ema_fast, slow AS ema_slow FROM e"""


def sql(strategies, periods, exits) -> dict[str, str]:
    back = _backtest(strategies, periods)
    shape = "abs(close - open) AS body, high - low AS rng, high - greatest(open, close) AS upper_wick, least(open, close) - low AS lower_wick, (high + low) / 2 AS mid, (open + close) / 2 AS mid_body, least(open, close) AS min_body, greatest(open, close) AS max_body"
    numbers = "total_pnl total_pnl_percent largest_win largest_loss max_drawdown win_rate avg_win avg_loss largest_win_contribution profit_factor max_drawdown_percent expectancy"
    screen = _screened({7: 1.06, 14: 1.5, 21: 2.75, 30: 4.50})
    pivot = " UNION ALL ".join(
        f"SELECT strategy_id, '{m}' AS metric, " + ", ".join(f"round(max(CAST({m} AS DOUBLE)) FILTER (period_days = {d}), 6) AS days_{d}" for d in periods) + " FROM results GROUP BY strategy_id"
        for m in ("total_pnl_percent", "win_rate", "profit_factor", "max_drawdown_percent", "total_trades")
    )
    k = "s_suppkey"
    rules = "['detect_choch_bullish', 'detect_liquidity_sweep_low', 'is_in_kill_zone', 'price_above_vwap', 'rsi_below_70', 'detect_dragon_pattern_bullish', 'detect_tails_bearish']"
    stored = f"""stored AS (SELECT {k} AS strategy_id, CASE WHEN {k} % 7 = ({k} * 3) % 7 THEN [({rules})[{k} % 7 + 1]] ELSE [({rules})[{k} % 7 + 1], ({rules})[({k} * 3) % 7 + 1]] END AS entry_rules, CASE WHEN {k} % 3 = 0 THEN '15m' ELSE '5m' END AS timeframe,
        CASE WHEN {k} % 4 <> 0 THEN 1.8 + ({k} % 10) / 10.0 END AS risk_reward, CASE WHEN {k} % 9 <> 0 THEN lpad(CAST(({k} * 7919) % 100003 AS VARCHAR), 6, '0') END AS stored_at FROM supplier),
        hashed AS (SELECT *, left(sha256(array_to_string(list_append(entry_rules, 'stop_loss_hit'), '|')), 12) AS hash FROM stored),
        recent AS (SELECT * FROM stored WHERE stored_at IS NOT NULL ORDER BY stored_at DESC, strategy_id DESC LIMIT 50)"""
    weights = "weights AS (SELECT keyword, round(count(*) / (SELECT count(*) FROM (SELECT unnest(entry_rules) FROM recent)), 4) AS weight FROM (SELECT unnest(entry_rules) AS keyword FROM recent) GROUP BY keyword)"
    c = "c_custkey"
    checks = [
        ("entry rules", f"{c} % 7 <> 0 AND {c} % 11 <> 0"), ("exit rules", f"{c} % 3 <> 0"), ("stop loss", f"{c} % 13 <> 0"), ("take profit", f"{c} % 17 <> 0"), ("timeframe", f"{c} % 23 <> 0"),
        ("discretionary terms", f"NOT ({c} % 7 <> 0 AND {c} % 11 <> 0 AND {c} % 5 = 0)"), ("look-ahead terms", f"NOT ({c} % 17 <> 0 AND {c} % 19 = 0)"), ("risk reward", f"1.0 + ({c} % 50) / 10.0 BETWEEN 1.8 AND 5.0"),
    ]
    faults = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN NOT ({t}) THEN '{n}' END" for n, t in checks) + "], lambda x: x IS NOT NULL), ',')"
    tags = "[" + ", ".join(f"'{t}'" for t in CONCEPTS) + "]"
    return {
        "bars_1h": _shown(BARS_1H, "1h"), "bars_5m": _shown(BARS_5M, "5m"), "bars_daily": _shown(BARS_1D, "1d"), "bars_lineitem": _shown(BARS_LINES, "1d"),
        "candles_decoded": f"""SELECT market, '1m' AS timeframe, ts_epoch, round(value, 6) AS open, round(value + 1, 6) AS high, round(value - 1, 6) AS low, round(value / 2, 6) AS close, 1.0::DOUBLE AS volume
            FROM (SELECT event_type AS market, CAST(floor(epoch(ts)) AS BIGINT) AS ts_epoch, value, row_number() OVER (PARTITION BY event_type, floor(epoch(ts)) ORDER BY event_id) AS k FROM events WHERE value IS NOT NULL AND ts IS NOT NULL) WHERE k = 1""",
        "lookback_windows": f"SELECT market, period_days, {_EPOCH}, CAST(row_number() OVER (PARTITION BY market, period_days ORDER BY ts) - 1 AS INTEGER) AS bar_idx, round(close, 6) AS close FROM ({_window_bars(periods)})",
        "bar_shape": f"SELECT market, {_EPOCH}, {_rounded('body rng upper_wick lower_wick mid mid_body min_body max_body')} FROM (SELECT market, ts, {shape} FROM ({BARS_1H}))",
        "ind_sma": f"WITH {_series(BARS_1H)} SELECT market, {_EPOCH}, round(CASE WHEN i >= 19 THEN avg(close) OVER (w ROWS 19 PRECEDING) END, 6) AS sma_20, round(CASE WHEN i >= 49 THEN avg(close) OVER (w ROWS 49 PRECEDING) END, 6) AS sma_50 FROM s WINDOW w AS (PARTITION BY market ORDER BY ts)",
        "ind_ema": _indicator([_ema(p) for p in (9, 13, 21, 34)], ", ".join(f"round(e{p}.e, 6) AS ema_{p}" for p in (9, 13, 21, 34)), " ".join(f"LEFT JOIN e{p} ON e{p}.market = s.market AND e{p}.i = s.i" for p in (9, 13, 21, 34))),
        "ind_rsi": _indicator([_recurrence("up", "gain", "(13.0 / 14)", 1, 14), _recurrence("down", "loss", "(13.0 / 14)", 1, 14)], "round(CASE WHEN down.e = 0 THEN 100 ELSE 100 - 100 / (1 + up.e / down.e) END, 6) AS rsi_14", "LEFT JOIN up ON up.market = s.market AND up.i = s.i LEFT JOIN down ON down.market = s.market AND down.i = s.i"),
        "ind_atr": _indicator([_recurrence("a", "tr", "(13.0 / 14)", 0, 13)], "round(CASE WHEN n > 14 THEN a.e END, 6) AS atr_14", "LEFT JOIN a ON a.market = s.market AND a.i = s.i"),
        "ind_vwap": f"WITH {_series(BARS_1H)} SELECT market, {_EPOCH}, round({_VWAP.format(w=_RUN.format(k='market'))}, 6) AS vwap FROM s",
        "ind_vwap_session": f"WITH {_series(BARS_1H)} SELECT market, {_EPOCH}, round({_VWAP.format(w=_RUN.format(k='market, CAST(ts + INTERVAL 330 minutes AS DATE)'))}, 6) AS vwap FROM s",
        "ind_bands": f"""WITH {_series(BARS_1H)}, v AS (SELECT *, {_VWAP.format(w=_RUN.format(k='market'))} AS vwap FROM s), d AS (SELECT *, CASE WHEN i = 0 THEN 0 ELSE coalesce(stddev_pop(close - vwap) OVER (PARTITION BY market ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) END AS sd FROM v)
            SELECT market, {_EPOCH}, round(vwap + 2 * sd, 6) AS vwap_upper, round(vwap - 2 * sd, 6) AS vwap_lower FROM d""",
        "det_python": f"""WITH {_series(BARS_1H)}, line AS (SELECT *, avg(close) OVER w AS mean, regr_slope(close, i) OVER w AS slope, regr_sxx(close, i) OVER w AS sxx, regr_syy(close, i) OVER w AS syy, lag(high) OVER v AS ph, lag(low) OVER v AS pl
                FROM s WINDOW w AS (PARTITION BY market ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), v AS (PARTITION BY market ORDER BY ts)),
            off AS (SELECT *, mean + slope * 10.5 AS expected, 2 * sqrt((syy - slope * slope * sxx) / 20) AS far FROM line)
            SELECT market, {_EPOCH}, coalesce(i >= 20 AND close > expected + far, false) AS detect_regression_break_up, coalesce(i >= 20 AND close < expected - far, false) AS detect_regression_break_down, coalesce(high < ph AND low > pl, false) AS detect_inside_bar FROM off""",
        "price_bins": f"WITH {_profile('market', BARS_5M, '1')} SELECT market, round(low, 6) AS low, round(width, 6) AS width, bin, round(amount, 6) AS amount FROM bins",
        "session_profile": f"""WITH RECURSIVE {_profile("market, session", f"SELECT *, strftime(ts + INTERVAL 330 minutes, '%Y-%m-%d') AS session FROM ({BARS_5M})", "volume")}, {_value_area("market, session")}""",
        "validate_strategies": f"SELECT {c} AS strategy_id, {faults} = '' AS valid, {faults} AS errors FROM customer",
        "rule_entries": back + "SELECT strategy_id, market, period_days, CAST(i AS INTEGER) AS bar_idx, direction, round(stop, 6) AS stop, round(target, 6) AS target FROM signals",
        "trades": back + "SELECT strategy_id, market, period_days, entry_idx, exit_idx, direction, " + _rounded("entry_price exit_price pnl pnl_percent") + " FROM trades",
        "trades_with_exits": _backtest(strategies, periods, exits) + "SELECT strategy_id, market, period_days, entry_idx, exit_idx, direction, " + _rounded("entry_price exit_price pnl pnl_percent") + " FROM trades",
        "rule_tokens": back.split("signals AS (")[0].rstrip().rstrip(",") + _tokens(),
        "passing_strategies": back + f", {screen} SELECT strategy_id FROM screened WHERE n_failures <= 4",
        "repo_documents": back + f""", {screen}, asked AS (SELECT unnest([{", ".join(f"'{s[0]}'" for s in strategies)}]) AS strategy_id, unnest([{", ".join("'" + "|".join(s[1]) + "'" for s in strategies)}]) AS rules, unnest([{", ".join(str(s[5]) for s in strategies)}]) AS ema_slow)
            SELECT left(sha256(rules || '|stop_loss_hit|take_profit_hit'), 12) AS hash, '2024-01-01' AS stored_at, strategy_id, rules, ema_slow, all_periods_profitable, round(avg_win_rate, 6) AS avg_win_rate, round(worst_drawdown, 6) AS worst_drawdown, true AS no_windows,
                   CAST(CASE WHEN total_trades + 1 > 10 THEN ceil((total_trades + 1) / ((total_trades + 1) // 10)) ELSE total_trades + 1 END AS INTEGER) AS points
            FROM screened JOIN asked USING (strategy_id) JOIN (SELECT strategy_id, total_trades FROM results WHERE period_days = 30) USING (strategy_id)""",
        "equity": back + "SELECT strategy_id, period_days, CAST(trade_no AS INTEGER) AS trade_no, " + _rounded("equity drawdown") + " FROM curve",
        "period_metrics": back + "SELECT strategy_id, period_days, total_trades, winning_trades, losing_trades, " + _rounded(numbers) + " FROM results",
        "screened": back + f", {screen} SELECT strategy_id, all_periods_profitable, total_trades_per_year, low_drawdown, on_target, spread, n_failures, n_failures <= 1 AS passed, " + _rounded("worst_drawdown avg_win_rate avg_expectancy avg_profit_factor") + " FROM screened",
        "report_pivot": back + pivot,
        "trade_marks": back + "SELECT strategy_id, market, period_days, entry_idx AS bar_idx, 'entry' AS mark, direction, round(entry_price, 6) AS price FROM trades UNION ALL SELECT strategy_id, market, period_days, exit_idx, 'exit', direction, round(exit_price, 6) FROM trades",
        "run_summary": back + f", {screen} SELECT {len(strategies)}::BIGINT AS generated, {sum(1.8 <= s[3] <= 5 for s in strategies)}::BIGINT AS validated, (SELECT count(DISTINCT strategy_id) FROM results) AS backtested, (SELECT count(*) FROM screened WHERE n_failures <= 1) AS passed",
        "concept_tags": f"WITH {stored} SELECT strategy_id, concept FROM stored, (SELECT unnest({tags}) AS concept) WHERE len(list_filter(entry_rules, lambda r: contains(r, concept))) > 0",
        "repo_dedup": f"WITH {stored} SELECT hash, first(strategy_id ORDER BY stored_at) AS strategy_id FROM hashed h WHERE stored_at IS NOT NULL AND hash NOT IN (SELECT hash FROM hashed WHERE strategy_id % 7 < 3) GROUP BY hash",
        "repo_latest": f"WITH {stored} SELECT strategy_id, coalesce(stored_at, '') AS stored_at FROM stored ORDER BY coalesce(stored_at, '') DESC, CAST(strategy_id AS VARCHAR) LIMIT 10",
        "repo_count": f"WITH {stored} SELECT timeframe, count(*) AS stored, count(DISTINCT hash) AS distinct_rules FROM hashed GROUP BY timeframe",
        "dna_keywords": f"WITH {stored}, {weights} SELECT * FROM weights",
        "dna_timeframes": f"WITH {stored} SELECT timeframe, round(count(*) / (SELECT count(*) FROM recent), 4) AS weight FROM recent GROUP BY timeframe",
        "dna_risk_reward": f"WITH {stored} SELECT CAST(round(avg(coalesce(risk_reward, 2.0)), 2) AS DOUBLE) AS rr_focus FROM recent",
        "dna_weights": f"WITH {stored}, {weights} SELECT keyword, round(1 + 2 * coalesce(weight, 0), 6) AS weight FROM (SELECT DISTINCT unnest(entry_rules) AS keyword FROM stored) LEFT JOIN weights USING (keyword)",
        "dna_memory": f"WITH {stored}, {weights} SELECT 'keywords' AS kind, keyword AS name, round(weight, 6) AS weight FROM weights UNION ALL SELECT 'timeframes', timeframe, round(count(*) / (SELECT count(*) FROM recent), 4) FROM recent GROUP BY timeframe UNION ALL SELECT 'rr_focus', '', CAST(round(avg(coalesce(risk_reward, 2.0)), 2) AS DOUBLE) FROM recent",
        "rules_described": f"WITH {stored} SELECT strategy_id, array_to_string(entry_rules, ' AND ') AS entry, 'stop_loss_hit' AS leave FROM stored",
        "strategy_grid": f"""WITH t AS (SELECT DISTINCT p_partkey AS k FROM part), {_TEMPLATES}, kept AS (
                SELECT *, CASE WHEN bool_or(direction = 'LONG') OVER o THEN count(*) OVER o / nullif(sum((direction = 'LONG')::int) OVER o, 0) ELSE 1 END AS share, bool_or(direction = 'LONG') OVER o AS biased FROM template WINDOW o AS (PARTITION BY type)),
            cells AS (SELECT type, direction, timeframe, stop AS stop_loss_logic, rr || 'x_stop_distance' AS take_profit_logic, CAST(fast AS INTEGER) AS ema_fast, CAST(slow AS INTEGER) AS ema_slow, share / 288.0 AS p,
                left(md5(concat_ws('~', rules, 'stop_loss_hit|take_profit_hit', stop, rr, timeframe, '*', fast, slow)), 16) AS id
                FROM kept, (SELECT unnest(['1m', '5m', '15m']) AS timeframe), ({_STOPS}), (SELECT unnest(['1.8', '2.0', '2.5', '3.0']) AS rr), ({_PAIRS}) WHERE NOT biased OR direction = 'LONG')
            SELECT type, direction, timeframe, stop_loss_logic, take_profit_logic, ema_fast, ema_slow, count(*) AS strategies, round(sum(p), 6) AS probability, min(id) AS first_id, max(id) AS last_id FROM cells GROUP BY ALL""",
        "strategy_options": f"""WITH t AS (SELECT DISTINCT CAST(right(p_brand, 1) AS BIGINT) AS k FROM part), {_TEMPLATES}, cells AS (
                SELECT type, v <> '' AS use_vwap, r <> '' AS use_rsi, leave, pv * pr * CASE WHEN type = 'institutional' THEN pz ELSE 1 END * pc * pl / 24.0 AS p,
                    len(list_distinct(list_filter([f1, f2, CASE WHEN z AND type = 'institutional' THEN CASE direction WHEN 'LONG' THEN 'detect_discount_zone' ELSE 'detect_premium_zone' END END, nullif(v, ''), nullif(r, ''), CASE WHEN c THEN 'is_in_kill_zone' END], lambda x: x IS NOT NULL))) AS rules
                FROM template, (VALUES ('', 0.5), ('price_above_vwap', 1.0 / 6), ('price_below_vwap', 1.0 / 6), ('price_within_0.5pct_of_vwap', 1.0 / 6)) a(v, pv),
                    (VALUES ('', 0.7), ('rsi_below_70', 0.06), ('rsi_above_30', 0.06), ('rsi_crossed_above_30', 0.06), ('rsi_crossed_below_70', 0.06), ('rsi_between_40_60', 0.06)) b(r, pr),
                    (VALUES (false, 0.5), (true, 0.5)) d(z, pz), (VALUES (false, 0.7), (true, 0.3)) e(c, pc), (VALUES ('', 0.5), ('ema_crossover_reversal', 1.0 / 6), ('price_crosses_vwap_opposite', 1.0 / 6), ('end_of_session', 1.0 / 6)) h(leave, pl), ({_STOPS}), ({_PAIRS})
                WHERE type = 'institutional' OR NOT z)
            SELECT type, use_vwap, use_rsi, CAST(rules AS INTEGER) AS rules, leave, count(*) AS strategies, round(CAST(sum(p) AS DOUBLE), 6) AS probability FROM cells GROUP BY ALL""",
        "part_grid": "SELECT p_brand, timeframe, stop, e.fast, e.slow, round(1.0 / 72, 6)::DOUBLE AS probability FROM (SELECT DISTINCT p_brand FROM part), (SELECT unnest(['1m', '5m', '15m']) AS timeframe), (SELECT unnest(['1.5x_atr_from_entry', '2x_atr_from_entry', '0.5pct_from_entry', '1pct_from_entry', 'swing_point_stop', 'entry_candle_stop']) AS stop), (VALUES (9, 21), (9, 34), (13, 21), (13, 34)) e(fast, slow)",
        "weighted_sample": "SELECT CAST(p_partkey AS VARCHAR) AS strategy_id FROM part ORDER BY -ln((CAST(concat('0x', left(md5('7~' || p_partkey), 8)) AS BIGINT) + 1) / 4294967297.0::DOUBLE) / p_retailprice, CAST(p_partkey AS VARCHAR) LIMIT 20",
    }
