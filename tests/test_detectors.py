from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from test_bars import START, series

from barloom.functions.columns import with_bar_idx
from barloom.operators.detectors import DETECTORS, PLACED, array_detector, fired_in, steady, with_detectors, with_fired
from barloom.operators.indicators import with_indicators
from barloom.operators.rules import entries

ALL = list(DETECTORS)


def noisy(spark, n=260):
    value = lambda i, m: (i * m % 1009) / 1009
    closes = [100 + 5 * value(i, 733) + i / 50 for i in range(n)]
    opens = [c + 2 * value(i, 311) - 1 for i, c in enumerate(closes)]
    highs = [max(o, c) + value(i, 97) for i, (o, c) in enumerate(zip(opens, closes, strict=True))]
    lows = [min(o, c) - value(i, 61) for i, (o, c) in enumerate(zip(opens, closes, strict=True))]
    return series(spark, closes, highs=highs, lows=lows, opens=opens)


def fired(df, names):
    return {n: [r[0] for r in df.filter(F.col(f"detect_{n}")).orderBy("bar_idx").select("bar_idx").collect()] for n in names}


def test_inventory():
    assert len(ALL) >= 181
    assert all(d.min_i >= 0 for d in DETECTORS.values())


@pytest.mark.parametrize("kind", ["lag", "minmax", "avg_std", "exists", "count", "argmin", "array"])
def test_flat_and_short_series(kind, spark):
    names = [n for n, d in DETECTORS.items() if d.kind == kind and n not in ("kill_zone", "macro_cycle_bullish", "macro_cycle_bearish")]
    short = with_detectors(series(spark, [1, 2, 3, 2, 1]), names)
    row = short.agg(*(F.count_if(F.col(f"detect_{n}").isNull()).alias(n) for n in names)).first()
    assert not any(row)
    late = [n for n in names if DETECTORS[n].min_i > 4]
    assert not any(short.agg(*(F.count_if(F.col(f"detect_{n}")) for n in late)).first()) if late else True


@pytest.mark.parametrize("kind", ["lag", "minmax", "avg_std", "argmin", "array"])
def test_no_look_ahead(kind, spark):
    names = [n for n, d in DETECTORS.items() if d.kind == kind][:12]
    bars = noisy(spark)
    columns = [f"detect_{n}" for n in names]
    whole = with_detectors(bars, names).filter("bar_idx < 210").orderBy("bar_idx").select(*columns).collect()
    cut = with_detectors(bars.filter("bar_idx < 210"), names).orderBy("bar_idx").select(*columns).collect()
    assert whole == cut


@pytest.mark.parametrize("kind", ["lag", "minmax", "avg_std", "exists", "count", "argmin", "array"])
def test_fired_once_holds_in_every_window(kind, spark):
    """Windows that begin at any bar of a series show the same by ``_fired`` as by detectors of their own."""
    every = [n for n, d in DETECTORS.items() if d.kind == kind]
    names = steady(every)
    assert {n for n in every if DETECTORS[n].reach == DETECTORS[n].min_i} - set(names) == {*every} & {*PLACED}
    bars = with_fired(noisy(spark), names)
    for start in (0, 1, 37, 120):
        window = with_bar_idx(bars.filter(F.col("bar_idx") >= start))
        both = fired_in(window, names).alias("f").join(with_detectors(window.drop("_fired"), names).alias("d"), "ts")
        wrong = both.agg(F.count("*").alias("_n"), *(F.count_if(F.col(f"f.detect_{n}") != F.col(f"d.detect_{n}")).alias(n) for n in names)).first().asDict()
        assert wrong.pop("_n") == 260 - start
        assert {n: k for n, k in wrong.items() if k} == {}


@pytest.mark.parametrize("stem", ["dragon_pattern", "quasimodo_pattern"])
def test_pieces_hold_all_bars_that_a_pattern_looks_at(stem, spark):
    """These fire before as many bars are there as they look back to, so pieces need more bars than that."""
    names = [f"{stem}_bullish", f"{stem}_bearish"]
    bars = noisy(spark, 1200).withColumns({c: F.round(c, 1) for c in ("open", "high", "low", "close")})
    whole, pieces = (fired(with_detectors(bars, names, piece=size), names) for size in (None, 11))
    assert whole == pieces and any(whole.values())


def test_sweep_fires_once(spark):
    n = 90
    lows = [9.0] * n
    lows[60] = 8.0
    bars = series(spark, [10.0] * n, highs=[11.0] * n, lows=lows)
    assert fired(with_detectors(bars, ["liquidity_sweep_low", "liquidity_sweep_high"]), ["liquidity_sweep_low", "liquidity_sweep_high"]) == {"liquidity_sweep_low": [60], "liquidity_sweep_high": []}


def test_gap_threshold(spark):
    close = 100.0
    for gap, hit in ((0.0201, True), (0.0199, False)):
        bars = series(spark, [close] * 3, highs=[99.0, 101.0, 102.0], lows=[98.0, 98.5, 99.0 + gap])
        assert fired(with_detectors(bars, ["bullish_imbalance"]), ["bullish_imbalance"])["bullish_imbalance"] == ([2] if hit else [])


def test_first_of_equal_lows_counts(spark):
    lows = [9.0] * 30
    lows[8] = lows[24] = 5.0
    highs = [11.0] * 30
    highs[12] = 20.0
    closes = [10.0] * 25 + [15.0] * 5
    bars = series(spark, closes, highs=highs, lows=lows)
    # Since bar 8, the first of the two lowest bars, the high is 20, so a close of 15 breaks nothing.
    got = fired(with_detectors(bars, ["market_structure_shift_bullish"]), ["market_structure_shift_bullish"])["market_structure_shift_bullish"]
    assert 28 not in got and 27 not in got


def test_mirrored_prices_swap_directions(spark):
    bars = noisy(spark)
    mirrored = bars.select("market", "timeframe", "ts", (1000 - F.col("open")).alias("open"), (1000 - F.col("low")).alias("high"), (1000 - F.col("high")).alias("low"), (1000 - F.col("close")).alias("close"), "volume")
    pairs = [("choch", "lag"), ("judas_swing", ""), ("swing_failure_pattern", ""), ("triple_tap", ""), ("turtle_soup", "")]
    up, down = [f"{n}_bullish" for n, _ in pairs], [f"{n}_bearish" for n, _ in pairs]
    a, b = fired(with_detectors(bars, up), up), fired(with_detectors(with_bar_idx(mirrored), down), down)
    assert [a[x] for x in up] == [b[x] for x in down]


def test_kill_zone_clock(spark):
    rows = [("m", "1m", START + timedelta(hours=h, minutes=m), 1.0, 1.0, 1.0, 1.0, 1.0) for h, m in ((3, 44), (3, 45), (5, 30), (5, 31), (8, 0), (9, 30), (9, 31))]
    bars = with_bar_idx(spark.createDataFrame(rows, "market string, timeframe string, ts timestamp, open double, high double, low double, close double, volume double"))
    assert fired(with_detectors(bars, ["kill_zone"]), ["kill_zone"])["kill_zone"] == [1, 2, 4, 5]


def test_series_of_zeros(spark):
    """No detector divides by a price of 0; with a few other prices among them every guard is passed."""
    closes = [1.0 if i % 9 == 3 else 0.0 for i in range(130)]
    bars = with_bar_idx(series(spark, closes, lows=closes, highs=closes, opens=closes))
    rows = with_detectors(bars, list(DETECTORS)).select(*(f"detect_{n}" for n in DETECTORS)).collect()
    assert len(rows) == 130 and all(x is not None for r in rows for x in r)


def test_pieces_give_what_whole_series_give(spark):
    bars = noisy(spark, 450)
    some = [*ALL[::4], "defining_range_bullish", "defining_range_bearish", "pwh_pwl_sweep_bullish"]
    columns = [f"detect_{n}" for n in dict.fromkeys(some)]
    found = [with_detectors(bars, [*dict.fromkeys(some)], piece=p).orderBy("bar_idx").select("bar_idx", *columns).collect() for p in (90, None)]
    assert found[0] == found[1] and len(found[0]) == 450


@pytest.fixture
def numpy_twins():
    """A sweep, an engulfing and an inside bar, written with numpy."""
    import numpy as np

    def before(x, k):
        return np.concatenate([np.full(k, np.nan), x[: max(x.size - k, 0)]])[: x.size]

    @array_detector(20, "own_sweep", "own_sweep_high")
    def _sweep(b):
        lowest = np.nanmin(np.vstack([before(b["low"], k) for k in range(1, 21)] + [np.full(b["low"].size, np.inf)]), axis=0)
        return (b["low"] < lowest) & (b["close"] > lowest)

    @array_detector(1, "own_inside")
    def _inside(b):
        return (b["high"] < before(b["high"], 1)) & (b["low"] > before(b["low"], 1))

    yield {"own_sweep": "liquidity_sweep_low", "own_sweep_high": "liquidity_sweep_high", "own_inside": "inside_bar"}
    for name in ("own_sweep", "own_sweep_high", "own_inside"):
        del DETECTORS[name]


@pytest.mark.parametrize("piece", [None, 32])
def test_array_detectors_equal_their_column_twins(spark, numpy_twins, piece):
    bars = noisy(spark).unionByName(noisy(spark, 40).withColumn("market", F.lit("short")))
    rows = with_detectors(bars.orderBy(F.rand(1)), [x for both in numpy_twins.items() for x in both], piece=piece)
    assert rows.count() == 300
    for own, twin in numpy_twins.items():
        assert rows.filter(F.col(f"detect_{own}") != F.col(f"detect_{twin}")).count() == 0
        assert rows.filter(f"detect_{own}").count() > 0


def test_array_detectors_in_a_rule(spark, numpy_twins):
    bars = with_indicators(noisy(spark))
    asked = lambda rules: spark.createDataFrame([("s", rules, [], "1pct_from_entry", 2.0, "5m", "*", 9, 21)], "strategy_id string, entry_rules array<string>, exit_rules array<string>, stop_loss_logic string, risk_reward double, timeframe string, market string, ema_fast int, ema_slow int")
    found = [sorted(r.bar_idx for r in entries(bars, asked([rule, "price_below_both_emas"]), [rule, "price_below_both_emas"], [(9, 21)]).collect()) for rule in ("detect_own_sweep", "detect_liquidity_sweep_low")]
    assert found[0] == found[1] and found[0]


@pytest.mark.parametrize("wrong", [lambda b: b["close"], lambda b: b["close"][1:] > 0])
def test_an_array_detector_must_give_a_boolean_for_each_bar(spark, wrong):
    array_detector(0, "own_wrong")(wrong)
    try:
        with pytest.raises(Exception, match="own_wrong must give 5 booleans"):
            with_detectors(series(spark, [1, 2, 3, 2, 1]), ["own_wrong"]).collect()
    finally:
        del DETECTORS["own_wrong"]


def test_array_detectors_see_nan_for_null_and_may_have_no_bars(spark):
    array_detector(0, "own_gap")(lambda b: b["close"] != b["close"])
    try:
        bars = series(spark, [1, 2, 3, 2, 1]).withColumn("close", F.expr("CASE WHEN bar_idx = 2 THEN NULL ELSE close END"))
        assert fired(with_detectors(bars, ["own_gap"]), ["own_gap"]) == {"own_gap": [2]}
        assert with_detectors(bars.limit(0), ["own_gap", "inside_bar"]).count() == 0
    finally:
        del DETECTORS["own_gap"]
