import random
from datetime import datetime, timedelta

import pytest

from barloom.operators.profile import price_profile, value_area

START = datetime(2025, 1, 1)


def bars(spark, rows):
    """(market, close, volume), five minutes apart."""
    rows = [(m, START + timedelta(minutes=5 * i), c, v) for i, (m, c, v) in enumerate(rows)]
    return spark.createDataFrame(rows, "market string, ts timestamp, close double, volume double")


def plainly(prices, amounts, bins, part):
    low, width = min(prices), (max(prices) - min(prices)) / bins
    held = [0.0] * bins
    for p, a in zip(prices, amounts, strict=True):
        held[min(int((p - low) // width), bins - 1) if width else 0] += a
    first = last = poc = held.index(max(held))
    total, inside = sum(held), held[poc]
    while inside < part * total and (first > 0 or last < bins - 1):
        below, above = held[first - 1] if first else -1, held[last + 1] if last < bins - 1 else -1
        inside += max(below, above)
        first, last = (first - 1, last) if below > above else (first, last + 1)
    return total, low + poc * width, low + first * width, low + (last + 1) * width, inside


@pytest.mark.parametrize(("bins", "part", "weight"), [(20, 0.7, None), (7, 0.5, "volume"), (1, 0.7, None), (20, 1.0, "volume")])
def test_profile_equals_a_plain_one_with_a_hot_group_over_many_spans(spark, bins, part, weight):
    rng = random.Random(bins)
    rows = [("hot" if i % 3 else f"m{i % 5}", float(rng.randrange(1, 200)), float(rng.randrange(9))) for i in range(6_000)]
    found = value_area(price_profile(bars(spark, rows), ["market"], bins, weight=weight), ["market"], bins, part).collect()
    assert len(found) == 6
    for r in found:
        own = [(c, v if weight else 1.0) for m, c, v in rows if m == r.market]
        want = plainly(*zip(*own, strict=True), bins, part)
        assert (r.total, r.poc, r.value_low, r.value_high, r.value_amount) == pytest.approx(want)


def test_one_price_missing_values_and_no_bars(spark):
    rows = [("flat", 5.0, 1.0), ("flat", 5.0, None), ("gone", None, 1.0), ("gone", float("nan"), 1.0), (None, 3.0, 1.0), ("flat", 5.0, float("nan"))]
    profile = price_profile(bars(spark, rows), ["market"], weight="volume")
    assert [tuple(r) for r in profile.collect()] == [("flat", 5.0, 0.0, 0, 1.0)]
    assert [(r.poc, r.value_low, r.value_high, r.value_amount) for r in value_area(profile, ["market"]).collect()] == [(5.0, 5.0, 5.0, 1.0)]
    assert price_profile(bars(spark, []), ["market"]).count() == 0


def test_equal_neighbours_grow_upwards_and_no_weight_stays_one_bin(spark):
    rows = [("m", c, 1.0) for c in (0.0, 5.0, 5.0, 10.0)]
    found = value_area(price_profile(bars(spark, rows), ["market"], 3), ["market"], 3, 0.7).first()
    assert (found.poc, found.value_low, found.value_high) == pytest.approx((10 / 3, 10 / 3, 10.0))
    empty = value_area(price_profile(bars(spark, [("m", 1.0, 0.0), ("m", 2.0, 0.0)]), ["market"], weight="volume"), ["market"]).first()
    assert (empty.total, empty.poc, empty.value_low, empty.value_amount) == (0.0, 1.0, 1.0, 0.0)
