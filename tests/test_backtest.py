import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_bars import START, series

from barloom.operators import grid as g
from barloom.operators import learning, metrics
from barloom.operators.indicators import with_indicators
from barloom.operators.rules import rule_column, rule_hits, validate
from barloom.operators.screen import screen, trade_marks
from barloom.operators.trades import WARM_UP, one_at_a_time, scan_trades, with_levels, with_pnl
from barloom.plans import queries as q
from barloom.plans.research import run_cycle
from barloom.sources import repository as repo

STRATEGY = "strategy_id string, entry_rules array<string>, exit_rules array<string>, stop_loss_logic string, take_profit_logic string, risk_reward double, timeframe string"


def scan(spark, closes, highs, lows, signals):
    bars = series(spark, closes, highs=highs, lows=lows).withColumn("period_days", F.lit(30))
    entries = spark.createDataFrame(signals, "strategy_id string, market string, timeframe string, period_days int, bar_idx int, direction string, stop double, target double")
    return bars, entries.join(bars.select("bar_idx", "ts", "close"), "bar_idx")


def flat(n):
    return [100.0] * n, [101.0] * n, [99.0] * n


def test_stop_counts_before_target(spark):
    c, h, low = flat(60)
    h[55], low[55] = 120.0, 80.0
    bars, entries = scan(spark, c, h, low, [("s", "m", "5m", 30, 52, "LONG", 90.0, 110.0)])
    row = scan_trades(bars, entries).first()
    assert (row.exit_idx, row.exit_price, row.pnl) == (55, 90.0, -10.0)


def test_open_position_leaves_at_the_last_close_and_warm_up_counts(spark):
    c, h, low = flat(60)
    bars, entries = scan(spark, c, h, low, [("s", "m", "5m", 30, 49, "LONG", 90.0, 110.0), ("s", "m", "5m", 30, 50, "SHORT", 110.0, 90.0)])
    rows = scan_trades(bars, entries).collect()
    assert [(r.entry_idx, r.exit_idx, r.pnl) for r in rows] == [(50, 59, 0.0)]


def test_no_entry_on_the_bar_of_an_exit(spark):
    c, h, low = flat(70)
    h[55] = 111.0
    bars, entries = scan(spark, c, h, low, [("s", "m", "5m", 30, i, "LONG", 90.0, 110.0) for i in (51, 53, 55, 56)])
    assert [r.entry_idx for r in scan_trades(bars, entries).orderBy("entry_idx").collect()] == [51, 56]


def walk(signals, bars, leaves=None):
    """Trades (entry bar, exit bar, exit price) of one strategy over one series, bar by bar. Signals (bar, direction, stop, target, names), bars (high, low, close)."""
    out, free = [], WARM_UP
    for at, direction, stop, target, names in sorted(signals):
        if at < free:
            continue
        end, price, left = len(bars) - 1, bars[-1][2], False
        for i in range(at + 1, len(bars)):
            high, low, close = bars[i]
            stopped, reached = (low <= stop, high >= target) if direction == "LONG" else (high >= stop, low <= target)
            named = any(f"{n}/{direction}" in (leaves or {}).get(i, ()) for n in names)
            if stopped or reached or named:
                end, price, left = i, stop if stopped else target if reached else close, True
                break
        out.append((at, end, price))
        if not left:
            break
        free = end + 1
    return out


@pytest.mark.parametrize(("block", "group", "segment", "exits"), [(128, 128, 256, False), (4, 3, 16, False), (4, 3, 16, True), (5, 2, 7, True)])
def test_scan_equals_a_walk_bar_by_bar(spark, block, group, segment, exits):
    """Small blocks, groups and segments send signals through every level."""
    rng = random.Random(block + segment)
    n, closes = 400, [100.0]
    for _ in range(n - 1):
        closes.append(closes[-1] * (1 + rng.gauss(0, 0.004)))
    rows = [(c + rng.random(), c - rng.random(), c) for c in closes]
    held = {i: [rng.choice(("x/LONG", "x/SHORT", "y/LONG"))] for i in range(n) if rng.random() < 0.02}
    frame = series(spark, closes, highs=[r[0] for r in rows], lows=[r[1] for r in rows]).withColumn("period_days", F.lit(30))
    leave = F.create_map(*(y for k, v in held.items() for y in (F.lit(k), F.array(*map(F.lit, v)))))
    frame = frame.withColumn("leaves", F.coalesce(F.element_at(leave, F.col("bar_idx")), F.array().cast("array<string>")))
    asked, want = [], []
    for s in range(12):
        width, dense = rng.choice((0.3, 2.0, 12.0, 1e6)), rng.choice((0.02, 0.3, 1.0))
        names = [["stop"], ["x"], ["x", "y"]][s % 3]
        own = []
        for i in range(n):
            if rng.random() < dense:
                side = rng.choice((1, -1))
                own.append((i, "LONG" if side > 0 else "SHORT", closes[i] - side * width, closes[i] + side * width * rng.choice((1, 2.5)), names))
        asked += [(f"s{s}", "m", "5m", 30, i, d, lo, up, x) for i, d, lo, up, x in own]
        want += [(f"s{s}", *t) for t in walk(own, rows, held if exits else None)]
    entries = spark.createDataFrame(asked, "strategy_id string, market string, timeframe string, period_days int, bar_idx int, direction string, stop double, target double, exit_rules array<string>")
    entries = entries.join(frame.select("bar_idx", "ts", "close"), "bar_idx")
    got = scan_trades(frame, entries, "leaves" if exits else None, block, group, segment)
    assert sorted((r.strategy_id, r.entry_idx, r.exit_idx, r.exit_price) for r in got.collect()) == sorted(want)
    assert got.filter("entry_time >= exit_time AND entry_idx < 399").count() == 0


def test_no_python_in_trades(spark, sf_dir):
    plan = q._trades(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_one_position_at_a_time_over_many_segments(spark):
    rng = random.Random(3)
    for dense in (0.05, 0.9):
        own = [(i, min(i + rng.choice((1, 2, 7, 90)), 4999)) for i in range(5000) if rng.random() < dense]
        rows = spark.createDataFrame([("s", "m", "1m", 1, i, e + 1, str(i)) for i, e in own], "strategy_id string, market string, timeframe string, period_days int, at int, free int, trade string")
        free, want = 0, []
        for i, e in own:
            if i >= free:
                want.append(i)
                free = e + 1
        assert sorted(r.at for r in one_at_a_time(rows, 64).collect()) == want


def trades_of(spark, pnls):
    rows = [("s", "m", "5m", 30, i, i + 1, START, START + timedelta(hours=i), "LONG", 100.0, 100.0 + p, p, p) for i, p in enumerate(pnls)]
    return spark.createDataFrame(rows, "strategy_id string, market string, timeframe string, period_days int, entry_idx int, exit_idx int, entry_time timestamp, exit_time timestamp, direction string, entry_price double, exit_price double, pnl double, pnl_percent double")


@pytest.mark.parametrize(("pnls", "factor", "drawdown", "rate"), [([5.0, -2.0, -4.0, 3.0], 8 / 6, 6.0, 50.0), ([1.0, 2.0], 10.0, 0.0, 100.0), ([-1.0, -2.0], 0.0, 3.0, 0.0)])
def test_metrics(spark, pnls, factor, drawdown, rate):
    row = metrics.period_metrics(trades_of(spark, pnls), curve=True).first()
    assert (row.profit_factor, row.max_drawdown, row.win_rate) == (pytest.approx(factor), drawdown, rate)
    assert row.equity_curve[0] == 0.0 and row.equity_curve[-1] == pytest.approx(row.total_pnl)


def test_windows_without_trades_are_zero(spark):
    some = spark.createDataFrame([("s",), ("none",)], "strategy_id string")
    rows = {(r.strategy_id, r.period_days): r for r in metrics.period_metrics(trades_of(spark, [1.0]), some, (30, 60), curve=True).collect()}
    assert rows["none", 60].total_trades == 0 and rows["none", 60].profit_factor == 0 and rows["none", 60].equity_curve == [0.0]
    assert len(rows) == 4


def test_curve_is_thinned(spark):
    df = spark.range(1).select(F.sequence(F.lit(0), F.lit(249)).alias("c"), F.sequence(F.lit(0), F.lit(99)).alias("d"))
    row = df.select(F.size(metrics.thin_curve("c")), F.size(metrics.thin_curve("d"))).first()
    assert tuple(row) == (125, 100)


def test_validation_of_the_known_strategies(spark):
    rules = ["detect_morning_star", "price_above_vwap"]
    rows = spark.createDataFrame([
        ("no target", rules, ["stop_loss_hit"], "entry_candle_stop", "", 2.0, "15m"), ("low reward", rules, ["stop_loss_hit"], "entry_candle_stop", "x", 1.7, "15m"),
        ("good", rules, ["stop_loss_hit"], "1.5x_atr", "2x", 2.0, "5m"), ("null", None, None, None, None, None, None),
    ], STRATEGY)
    got = {r.strategy_id: (r.valid, r.errors) for r in validate(rows).collect()}
    assert got["good"] == (True, []) and got["no target"] == (False, ["take profit"]) and got["low reward"] == (False, ["risk reward"])
    assert got["null"][0] is False and len(got["null"][1]) == 6


def test_unknown_rules(spark):
    bars = series(spark, [1.0] * 3)
    with pytest.raises(ValueError, match="unknown rule"):
        rule_column("moon_phase", bars, "a", "b")
    assert bars.select(rule_column("moon_phase", bars, "a", "b", compat=True).alias("x")).first().x is True


def test_screen_allows_one_failure(spark, sf_dir):
    rows = [("good", d, 10.0, 9.0, 60.0, 1.0, 2.0, 1.0, 20.0, 10) for d in (30, 60)] + [("bad", d, -1.0, -1.0, 10.0, -1.0, 0.5, 1.0, 20.0, 10) for d in (30, 60)]
    df = spark.createDataFrame(rows, "strategy_id string, period_days int, total_pnl double, total_pnl_percent double, win_rate double, expectancy double, profit_factor double, max_drawdown_percent double, largest_win_contribution double, total_trades int")
    got = {r.strategy_id: r for r in screen(df).collect()}
    assert got["good"].passed and got["good"].failures == [] and not got["bad"].passed and len(got["bad"].failures) == 5


def test_repository_keeps_each_fingerprint_once(spark, tmp_path):
    path = str(tmp_path / "store")
    assert repo.read(spark, path).count() == 0
    rows = spark.createDataFrame([("a", "2"), ("a", "1"), ("b", None)], "hash string, stored_at string")
    rows = rows.selectExpr("hash", "stored_at", f"CAST(NULL AS {repo.STRATEGY}) AS strategy", f"CAST(NULL AS {repo.RESULT}) AS backtest_result")
    repo.append(spark, path, rows)
    repo.append(spark, path, rows)
    assert sorted((r.hash, r.stored_at) for r in repo.read(spark, path).collect()) == [("a", "1"), ("b", None)]
    assert [r.hash for r in repo.latest(repo.read(spark, path)).collect()] == ["a", "b"]
    back = repo.from_json(repo.to_json(repo.read(spark, path))).first()
    assert back.backtest_result.avg_win_rate == 0.0 and back.backtest_result.period_results is None
    repo.clear(spark, path)
    assert repo.read(spark, path).count() == 0


def test_grid_and_sample(spark):
    table = g.template_table(spark)
    assert table.count() >= 150
    strategies = g.grid(spark, g.biased(table, "BULLISH"), small=True)
    assert strategies.filter("direction = 'SHORT'").count() == 0
    few = g.sample(strategies, 25, seed=3)
    ids = [r.strategy_id for r in few.collect()]
    assert len(set(ids)) == 25 and ids == [r.strategy_id for r in g.sample(strategies, 25, seed=3).collect()]
    assert validate(few).filter("NOT valid").count() == 0


def test_marks_join_both_ends(spark):
    c, h, low = flat(60)
    bars, entries = scan(spark, c, h, low, [("s", "m", "5m", 30, 52, "LONG", 90.0, 110.0)])
    assert sorted((r.mark, r.bar_idx) for r in trade_marks(bars, scan_trades(bars, entries)).collect()) == [("entry", 52), ("exit", 59)]


def test_levels_without_atr_use_one_percent(spark):
    rows = spark.createDataFrame([("1.5x_atr", 100.0, 101.0, 99.0, None, 2.0, "LONG"), ("entry_candle_stop", 100.0, 103.0, 99.0, 1.0, 2.0, "SHORT")], "stop_loss_logic string, close double, high double, low double, atr_14 double, risk_reward double, direction string")
    assert [(r.stop, r.target) for r in with_levels(rows).collect()] == [(99.0, 102.0), (103.0, 94.0)]


def test_as_of_is_a_parameter(spark, sf_dir):
    from barloom.plans.research import prepared

    bars = q.hourly(spark, sf_dir)
    assert prepared(bars, (7,), datetime(1990, 1, 1)).count() == prepared(bars, (7,), datetime(1990, 1, 1)).select("ts").count()


def test_compat_keeps_the_accidents_of_dispatch(spark):
    from barloom.operators.detectors import with_detectors

    n = 40
    c = [100.0 + (i % 5) for i in range(n)]
    bars = series(spark, c, highs=[x + 3 for x in c], lows=[x - 3 for x in c], opens=[x + (1 if i % 2 else -1) for i, x in enumerate(c)])
    rows = with_detectors(bars, ["bullish_breaker", "effort_vs_result_bullish", "stops_hunt_bullish"])
    count = lambda rule: rows.select(rule_column(rule, rows, "a", "b", compat=True).alias("x")).filter("x").count()
    down = [i for i in range(10, n) if i % 2 == 0]  # bars 10.. that follow a down bar
    rows.cache()
    assert count("detect_effort_vs_result_bullish") == 0
    assert count("detect_stops_hunt_bullish") == n
    assert count("detect_bullish_breaker") >= len(down)


def test_a_price_of_zero_has_no_percentage(spark):
    assert [r.pnl_percent for r in with_pnl(trades_of(spark, [5.0]).withColumn("entry_price", F.lit(0.0))).collect()] == [0.0]
    bars = with_indicators(series(spark, [0.0] * 60))
    hits = rule_hits(bars, list(q.TOKENS), [(9, 21)], "UTC")
    assert hits.filter("array_contains(hits['9/21'], 'price_within_0.5pct_of_vwap')").count() == 0


def test_positions_leave_by_signal_exits(spark):
    c, h, low = flat(70)
    bars, entries = scan(spark, c, h, low, [("s", "m", "5m", 30, i, "LONG", 90.0, 110.0) for i in (51, 58)])
    bars = bars.withColumn("leaves", F.when(F.col("bar_idx").isin(51, 54), F.array(F.lit("x/LONG"))).when(F.col("bar_idx") == 60, F.array(F.lit("x/SHORT"))).otherwise(F.array().cast("array<string>")))
    asked = entries.withColumn("exit_rules", F.array(F.lit("stop_loss_hit"), F.lit("x")))
    got = sorted((r.entry_idx, r.exit_idx) for r in scan_trades(bars, asked, exits="leaves").collect())
    assert got == [(51, 54), (58, 69)]  # not on the entry's own bar, nor by the other side's signal
    assert sorted((r.entry_idx, r.exit_idx) for r in scan_trades(bars, asked).collect()) == [(51, 69)]


def test_a_strategy_with_an_unknown_rule_stops_no_other(spark, sf_dir):
    rows = q.strategies(spark).withColumn("entry_rules", F.when(F.col("strategy_id") == "s01", F.array(F.lit("moon_phase"))).otherwise(F.col("entry_rules")))
    rules = [*q.RULES, "moon_phase"]
    checked, results, _ = run_cycle(q.hourly(spark, sf_dir), rows, rules, list(q.EMAS), q.PERIODS)
    assert {r.strategy_id: r.unknown for r in checked.filter("size(unknown) > 0").collect()} == {"s01": ["moon_phase"]}
    found = {r.strategy_id for r in results.select("strategy_id").distinct().collect()}
    assert "s01" not in found and "s02" in found


def test_templates_and_their_chances(spark):
    from collections import Counter

    table = g.template_table(spark, "institutional").collect()
    assert Counter(r.type for r in table) == {"institutional": 164, "price_action": 8, "vwap": 4, "ema": 4}
    of_type = Counter()
    for r in table:
        of_type[r.type] += r.share
    assert all(abs(of_type[t] - p) < 1e-9 for t, p in {"institutional": 0.7, "price_action": 0.2, "vwap": 0.05, "ema": 0.05}.items())
    biased = g.biased(g.template_table(spark), "BEARISH").collect()
    assert {r.direction for r in biased} == {"SHORT"} and abs(sum(r.share for r in biased) - 1) < 1e-9


def test_numbers_stand_for_the_strategies_of_the_grid(spark):
    short = [x for x in g.shares() if x[0] != "institutional"][:3] + [x for x in g.shares() if x[0] == "institutional"][:2] + [("institutional", "LONG", ("detect_discount_zone",), 0.1)]
    space = g.Space(tuple(short), g._axes((2.0,), ("5m",)))
    table = spark.createDataFrame([(i, t, d, list(r), p) for i, (t, d, r, p) in enumerate(short)], "template int, type string, direction string, rules array<string>, share double")
    whole = g.grid(spark, table, (2.0,), timeframes=("5m",))
    numbered = space.at_number(spark.range(-5, space.size + 5).withColumnRenamed("id", "number"))
    assert numbered.count() == space.size == numbered.select("number").distinct().count()
    key = ["strategy_id", "type", "template", "use_vwap", "use_rsi"]
    assert {tuple(r) for r in numbered.select(*key).distinct().collect()} == {tuple(r) for r in whole.select(*key).distinct().collect()}
    assert whole.agg(F.sum("probability")).first()[0] == pytest.approx(sum(x[3] for x in short))


@pytest.mark.parametrize("focus", ["institutional", "price_action"])
def test_drawn_shares_follow_the_mix(spark, focus):
    n, space = 20_000, g.Space.of(focus, risk_rewards=tuple(1.5 + k / 1000 for k in range(1000)))
    assert space.size > 10**9
    rows = space.at_number(space.draw(spark.range(n), "id", seed=5))
    asked = {"institutional": "type = 'institutional'", "action": "type = 'price_action'", "technical": "type IN ('vwap', 'ema')", "vwap": "use_vwap", "rsi": "use_rsi", "wrong": "type <> 'institutional' AND exists(entry_rules, r -> r LIKE 'detect_%_zone')"}
    found = rows.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), *(F.expr(f"count_if({c})").alias(k) for k, c in asked.items())).first()
    institutional, action, technical = g.MIX[focus]
    want = {"institutional": institutional, "action": action, "technical": technical, "vwap": 0.5, "rsi": 0.3}
    assert {k: found[k] / n for k in want} == pytest.approx(want, abs=0.02)
    assert (found.n, found.ids, found.wrong) == (n, n, 0)
    assert space.draw(spark.range(9), "id", 5).collect() == space.draw(spark.range(9), "id", 5).collect() != space.draw(spark.range(9), "id", 6).collect()


def test_distinct_draws(spark):
    space = g.Space.of()
    rows = space.draw_distinct(spark, 300, seed=2)
    drawn = [(r.strategy_id, r.drawn) for r in rows.collect()]
    assert len({s for s, _ in drawn}) == 300 and [k for _, k in drawn] == sorted(k for _, k in drawn)
    assert drawn[:50] == [(r.strategy_id, r.drawn) for r in space.draw_distinct(spark, 50, seed=2).collect()]
    assert validate(rows).filter("NOT valid").count() == 0
    few = g.Space((("vwap", "LONG", ("price_above_vwap",), 1.0),), g._axes((2.0,), ("5m",), small=True))
    assert few.draw_distinct(spark, 24).count() == 24 == few.size
    with pytest.raises(ValueError, match="no 25 different"):
        few.draw_distinct(spark, 25)


def test_memory_and_store_round_trips(spark, tmp_path):
    path = str(tmp_path / "memory")
    empty = learning.read_memory(spark, path).first()
    assert (empty.keywords, empty.timeframes, empty.rr_focus) == ({}, {}, 2.0)
    strategies = spark.createDataFrame([(i, ["a", "b"] if i % 2 else ["a"], "5m", 2.5, f"{i:03}") for i in range(60)], "strategy_id int, entry_rules array<string>, timeframe string, risk_reward double, stored_at string")
    learning.write_memory(learning.memory(strategies), path)
    found = learning.read_memory(spark, path).first()
    assert found.keywords == {"a": 0.6667, "b": 0.3333} and found.timeframes == {"5m": 1.0} and found.rr_focus == 2.5
    learning.write_memory(learning.memory(strategies.filter("strategy_id % 2 = 0")), path)
    assert learning.read_memory(spark, path).first().keywords == {"a": 1.0}
    store, copy = str(tmp_path / "store"), str(tmp_path / "copy")
    rows = spark.createDataFrame([("h1", "2024", None, None), ("h2", None, None, None)], repo.STORED)
    repo.append(spark, store, rows)
    repo.export(spark, store, copy)
    assert sorted(r.hash for r in repo.read(spark, copy).collect()) == ["h1", "h2"]
    repo.clear(spark, store)
    assert repo.read(spark, store).count() == 0 and repo.read(spark, copy).count() == 2


def test_a_grid_of_one_type_is_the_work_of_many_tasks(spark):
    """A bias, as a window over a type, left all strategies of the type to one task."""
    table = spark.range(400).selectExpr("cast(id as int) template", "'vwap' type", "'LONG' direction", "array(concat('r', id)) rules", "1.0D share").coalesce(1)
    rows = g.grid(spark, g.biased(table, "BULLISH"), (2.0,), timeframes=("5m",), small=True)
    by_task = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(by_task) == 400 * 24 and max(by_task) <= sum(by_task) / 2


def test_bias_keeps_types_without_the_direction_and_null_types(spark):
    rows = [("a", "LONG", 1.0), ("a", "SHORT", 2.0), ("a", None, 4.0), ("b", "SHORT", 3.0), (None, "LONG", 1.0), (None, "SHORT", 5.0)]
    table = spark.createDataFrame(rows, "type string, direction string, share double")
    assert {tuple(r) for r in g.biased(table, "BULLISH").collect()} == {("a", "LONG", 7.0), ("b", "SHORT", 3.0), (None, "LONG", 6.0)}


def test_least_ids_are_found_without_sorting(spark, sf_dir):
    ids = ["0000000000000000", "00000000000000ff", "7fffffffffffffff", "8000000000000000", "8000000000000001", "ffffffffffffffff"]
    rows = spark.createDataFrame([(x,) for x in ids], "strategy_id string").select("strategy_id", g.id_number().alias("n")).withColumn("back", g.id_of(F.col("n"))).orderBy("n").collect()
    assert [r.strategy_id for r in rows] == [r.back for r in rows] == ids
    assert "SortAggregate" not in q.strategy_grid(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_a_draw_is_worked_out_once(spark):
    """A drawn number was worked out anew for each bound of a weight, and by the test of its range twice more."""
    space, n = g.Space.of(), 20_000
    plan = space.drawn(spark.range(n), "id", seed=5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 3 + 1 and "Filter" not in plan
    assert space.drawn(spark.range(50), "id", seed=5).collect() == space.at_number(space.draw(spark.range(50), "id", seed=5)).collect()


def test_binary_search_counts_the_bounds_reached(spark):
    for bounds in ([5], [0, 0, 7], [1, 2, 3, 4], [2, 4, 4, 4, 9, 2**32 - 1, 2**32], list(range(3, 300, 7))):
        rows = spark.createDataFrame([(u,) for u in (0, 1, 2, 3, 4, 5, 8, 9, 150, 300, 2**32 - 2, 2**32 - 1)], "u long").select("u", g._passed(bounds, F.col("u")).alias("n")).collect()
        assert [r.n for r in rows] == [sum(b <= r.u for b in bounds) for r in rows]
