from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.functions.columns import at_home, in_pieces, no_nan, with_bar_idx
from barloom.operators import indicators as ind
from barloom.plans.queries import candle_payloads
from barloom.sources import bars as src

START = datetime(2025, 1, 1)


def series(spark, closes, market="m", highs=None, lows=None, opens=None, volumes=None, timeframe="5m"):
    n = len(closes)
    highs, lows, opens, volumes = highs or [c + 1 for c in closes], lows or [c - 1 for c in closes], opens or closes, volumes or [1.0] * n
    rows = [(market, timeframe, START + timedelta(minutes=5 * i), float(opens[i]), float(highs[i]), float(lows[i]), float(closes[i]), float(volumes[i])) for i in range(n)]
    return with_bar_idx(spark.createDataFrame(rows, "market string, timeframe string, ts timestamp, open double, high double, low double, close double, volume double"))


def column(df, name):
    return [r[0] for r in df.orderBy("ts").select(name).collect()]


def test_short_series_has_no_averages(spark):
    bars = series(spark, [1, 2, 3, 4, 5])
    assert column(ind.with_ema(bars, 9), "ema_9") == [None] * 5
    assert column(ind.with_rsi(bars), "rsi_14") == [None] * 5
    assert column(ind.with_atr(bars), "atr_14") == [None] * 5


@pytest.mark.parametrize(("period", "n"), [(2, 300), (9, 400), (34, 300)])
def test_blocked_recurrence_equals_a_loop(spark, period, n):
    closes = [100 + (i * 7919 % 101) / 10 for i in range(n)]
    got = column(ind.with_ema(series(spark, closes), period), f"ema_{period}")
    e = sum(closes[:period]) / period
    want = [None] * (period - 1) + [e]
    for c in closes[period:]:
        e += (c - e) * 2 / (period + 1)
        want.append(e)
    assert got[: period - 1] == want[: period - 1]
    assert max(abs(a - b) for a, b in zip(got[period - 1 :], want[period - 1 :], strict=True)) < 1e-9


def test_rsi_without_loss_is_100(spark):
    assert set(column(ind.with_rsi(series(spark, [5.0] * 40)), "rsi_14")[14:]) == {100.0}
    assert set(column(ind.with_rsi(series(spark, list(range(1, 41)))), "rsi_14")[14:]) == {100.0}


def test_vwap_is_null_without_volume(spark):
    got = column(ind.with_vwap(series(spark, [10, 10, 10, 12], volumes=[0, 0, 1, 1])), "vwap")
    assert got == [None, None, 10.0, 11.0]


def test_lookback_is_strict_and_may_be_empty(spark):
    bars = series(spark, [1, 2, 3])
    end = START + timedelta(days=1)
    assert src.lookback(bars, end, 1).count() == 2
    assert src.lookback(bars, end + timedelta(days=9), 1).count() == 0
    assert sorted(r[0] for r in src.with_periods(bars, src.end_of(bars), (1, 2)).select("period_days").collect()) == [1, 1, 1, 2, 2, 2]


def test_payload_decoding_and_first_row_wins(spark):
    good = '{"s": "ok", "candles": [[60, 1, 2, 0.5, 1.5, 10], [120, 2, 3, 1, 2, 20]]}'
    later = '{"s": "ok", "candles": [[60, 9, 9, 9, 9, 9]]}'
    rows = spark.createDataFrame([("m", "1m", 0, good), ("m", "1m", 1, later), ("m", "1m", 2, '{"s": "error"}'), ("m", "1m", 3, "x")], "market string, timeframe string, seq int, payload string")
    got = src.sorted_bars(src.first_per_timestamp(src.decode_candles(rows), "seq", "at")).collect()
    assert [(r.ts.minute, r.open, r.volume) for r in got] == [(1, 1.0, 10.0), (2, 2.0, 20.0)]


def test_payloads_stay_small_on_a_hot_type_and_day(spark):
    events = spark.range(5_000).selectExpr("id AS event_id", "timestamp'2025-01-01' + make_dt_interval(0, 0, 0, id % 700) AS ts", "'m' AS event_type", "CAST(id AS double) AS value")
    payloads = candle_payloads(events)
    sizes = [r.n for r in payloads.selectExpr("size(from_json(payload, 'struct<candles:array<array<double>>>').candles) AS n").collect()]
    assert sum(sizes) == 5_000 and max(sizes) <= 1_000
    got = src.first_per_timestamp(src.decode_candles(payloads), "seq", "at").collect()
    assert sorted(r.open for r in got) == [float(i) for i in range(700)]


def test_files_round_trip(spark, tmp_path):
    bars = src.sorted_bars(series(spark, [1, 2, 3]))
    src.write_bars(bars, str(tmp_path / "bars"))
    assert sorted(map(tuple, src.read_bars(spark, str(tmp_path / "bars")).collect())) == sorted(map(tuple, bars.collect()))
    path = src.csv_path(str(tmp_path), "X:Y", "5m")
    bars.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("datetime"), "open", "high", "low", "close", "volume").write.csv(path, header=True)
    assert src.read_csv(spark, path, "X:Y", "5m").count() == 3


def test_unknown_timeframe_counts_as_five_minutes(spark):
    rows = spark.createDataFrame([("1h",), ("7m",)], "tf string")
    assert [r[0] for r in rows.select(src.minutes(F.col("tf"))).collect()] == [60, 5]


def test_nan_becomes_null(spark):
    assert column(no_nan(series(spark, [1.0, float("nan"), 3.0])), "close") == [1.0, None, 3.0]


def test_numbers_over_many_spans_of_time(spark):
    rows = [(m, "1d", START + timedelta(days=3 * i + (i * 7) % 2)) for m, n in (("a", 40), ("b", 3)) for i in range(n)] + [("b", "1d", None)]
    got = with_bar_idx(spark.createDataFrame(rows, "market string, timeframe string, ts timestamp").repartition(4)).orderBy("market", "bar_idx").collect()
    assert [(r.market, r.bar_idx) for r in got] == [*(("a", i) for i in range(40)), *(("b", i) for i in range(4))]
    assert got[40].ts is None and [r.ts for r in got[:40]] == sorted(r.ts for r in got[:40])


def test_pieces_hold_their_neighbours(spark):
    bars = series(spark, list(range(25)))
    rows = in_pieces(bars, 3, 1, 10)
    assert {(r._piece, r.bar_idx) for r in rows.collect()} == {(p, i) for p in range(3) for i in range(p * 10 - 3, p * 10 + 11) if 0 <= i < 25} | ({(2, i) for i in range(17, 25)})
    assert sorted(r.bar_idx for r in at_home(rows, 10).collect()) == list(range(25))
