import random
from datetime import timedelta

from pyspark.sql import functions as F
from test_bars import START

from barloom.functions.columns import with_bar_idx
from barloom.operators.indicators import with_indicators
from barloom.operators.rules import entries
from barloom.operators.trades import scan_trades, with_levels
from barloom.sources.bars import aggregate_bars
from barloom.streaming.backtest import Setup, advance, marked, read_state, start_backtest
from barloom.streaming.jobs import start_bars, start_cycle

TICKS = "market string, ts timestamp, tie long, price double, volume double"


def test_streamed_bars_equal_batch_bars(spark, tmp_path):
    rows = [(f"m{i % 2}", START + timedelta(seconds=37 * i), i, 100.0 + i * 7 % 13, 1.0) for i in range(200)]
    rows += [(f"m{i}", START + timedelta(days=1), 10_000 + i, 1.0, 1.0) for i in range(2)]  # moves the watermark past the others
    ticks = spark.createDataFrame(rows, TICKS)
    ticks.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(TICKS).parquet(str(tmp_path / "in"))
    start_bars(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = aggregate_bars(ticks.filter(f"ts < timestamp '{START + timedelta(hours=20)}'"), "5m")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_cycle_sees_each_bar_once(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    seen = []
    start_cycle(spark, str(tmp_path / "in"), "id long", str(tmp_path / "ck"), lambda df, i: seen.append(df.count())).awaitTermination()
    start_cycle(spark, str(tmp_path / "in"), "id long", str(tmp_path / "ck"), lambda df, i: seen.append(df.count())).awaitTermination()
    assert sum(seen) == 5


RULES = ("ema_fast_above_slow", "rsi_below_70", "price_above_vwap", "rsi_crossed_below_70", "close_above_vwap_upper_band", "detect_pwh_pwl_sweep_bullish", "detect_defining_range_bullish", "detect_bullish_engulfing", "price_below_vwap")
ASKED = (("a", ("ema_fast_above_slow", "rsi_below_70")), ("b", ("rsi_crossed_below_70",)), ("c", ("detect_pwh_pwl_sweep_bullish",)), ("d", ("detect_defining_range_bullish",)), ("e", ("close_above_vwap_upper_band",)), ("f", ("detect_bullish_engulfing", "price_below_vwap")))


def test_batches_of_bars_give_the_trades_of_one_run(spark, tmp_path):
    rng, rows = random.Random(8), []
    for m, n in (("m0", 420), ("m1", 300), ("late", 130)):
        c = 100.0
        for i in range(n):
            o, c = c, c * (1 + rng.gauss(0, 0.006))
            at = START + timedelta(minutes=5 * (i + (250 if m == "late" else 0)))
            rows.append((m, "5m", at, o, max(o, c) + rng.random(), min(o, c) - rng.random(), c, float(rng.randint(0, 9))))
    schema = "market string, timeframe string, ts timestamp, open double, high double, low double, close double, volume double"
    kinds = "strategy_id string, entry_rules array<string>, stop_loss_logic string, risk_reward double, timeframe string, market string, ema_fast int, ema_slow int"
    asked = spark.createDataFrame([(i, list(r), ("1.5x_atr", "2x_atr")[k % 2], (2.0, 30.0, 1.5)[k % 3], "5m", "*", 9, 21) for k, (i, r) in enumerate(ASKED)], kinds)
    setup = Setup(asked, RULES, ((9, 21),), "UTC")
    bars = with_bar_idx(spark.createDataFrame(rows, schema).withColumn("period_days", F.lit(0)))
    ready = with_indicators(bars, (9, 21))
    whole = scan_trades(bars, with_levels(entries(ready, asked, list(RULES), [(9, 21)], "UTC")))

    inner = [290]  # the first batch is too short to have averages
    cuts = [START + timedelta(minutes=5 * i) for i in (0, 7, *inner, 1000)]
    inbox, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        part = [r for r in rows if a <= r[2] < b]
        spark.createDataFrame([*part[::-1], *part[:1]], schema).coalesce(1).write.mode("append").parquet(inbox)  # out of order, one bar twice
        start_backtest(spark.readStream.schema(schema).parquet(inbox), setup, out, ck).awaitTermination()
    batches = len(cuts) - 1
    state = read_state(spark, out, batches - 1)
    got = spark.read.parquet(f"{out}/trades").drop("batch").unionByName(marked(state))
    key = lambda r: (r.strategy_id, r.market, r.entry_idx, r.exit_idx, r.direction, round(r.exit_price, 6), round(r.pnl, 6))
    assert sorted(map(key, got.collect())) == sorted(map(key, whole.collect()))
    assert {r.strategy_id for r in whole.collect()} >= {*"abcde"} and state.held.filter("entry IS NOT NULL").count() > 0
    # Bars that were seen already change nothing.
    closed, again = advance(setup, spark.createDataFrame(part, schema), state)
    assert closed.count() == 0 and sorted(map(str, again.held.collect())) == sorted(map(str, state.held.collect()))
