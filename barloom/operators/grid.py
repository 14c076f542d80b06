"""Strategies as a grid: every template with every timeframe, filter, pair of averages, stop, exit and risk-reward.

Drawing from the grid by weight (``sample``) is a sort by a key from a hash of the strategy's id, so a run can be
repeated anywhere; no strategy is drawn twice. ``Space`` draws without building the grid: a strategy is a number
whose digits, one for each axis, are drawn by prefix sums of the axis' weights.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate
from math import fsum, prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.detectors import ARRAYS, DETECTORS

TIMEFRAMES = ("1m", "5m", "15m")
# Entry templates that join several rules, as (type, direction, rules).
TEMPLATES = (
    ("price_action", "LONG", ("detect_bullish_engulfing", "price_near_support")),
    ("price_action", "SHORT", ("detect_bearish_engulfing", "price_near_resistance")),
    ("price_action", "LONG", ("detect_inside_bar", "breakout_above_20bar_high")),
    ("price_action", "SHORT", ("detect_inside_bar", "breakout_below_20bar_low")),
    ("price_action", "LONG", ("breakout_above_20bar_high",)),
    ("price_action", "SHORT", ("breakout_below_20bar_low",)),
    ("price_action", "LONG", ("detect_morning_star",)),
    ("price_action", "LONG", ("detect_bullish_pin_bar",)),
    ("vwap", "LONG", ("price_above_vwap", "pullback_to_vwap")),
    ("vwap", "SHORT", ("price_below_vwap", "rally_to_vwap")),
    ("vwap", "LONG", ("close_above_vwap_upper_band",)),
    ("vwap", "SHORT", ("close_below_vwap_lower_band",)),
    ("ema", "LONG", ("ema_fast_above_slow", "price_above_both_emas")),
    ("ema", "SHORT", ("ema_fast_below_slow", "price_below_both_emas")),
    ("ema", "LONG", ("price_above_ema_slow", "pullback_to_ema_fast")),
    ("ema", "SHORT", ("price_below_ema_slow", "rally_to_ema_fast")),
    ("institutional", "LONG", ("detect_liquidity_sweep_low", "detect_bullish_order_block")),
    ("institutional", "SHORT", ("detect_liquidity_sweep_high", "detect_bearish_order_block")),
    ("institutional", "LONG", ("price_above_ema_slow", "detect_bullish_order_block")),
    ("institutional", "SHORT", ("price_below_ema_slow", "detect_bearish_order_block")),
    ("institutional", "LONG", ("detect_bullish_imbalance", "rsi_oversold_bounce")),
    ("institutional", "LONG", ("detect_volatility_squeeze", "breakout_above_20bar_high")),
    ("institutional", "SHORT", ("detect_volatility_squeeze", "breakout_below_20bar_low")),
    ("institutional", "LONG", ("detect_ote_entry_bullish", "detect_discount_zone")),
    ("institutional", "SHORT", ("detect_ote_entry_bearish", "detect_premium_zone")),
    ("institutional", "LONG", ("detect_inducement_bullish", "detect_bullish_order_block")),
    ("institutional", "SHORT", ("detect_inducement_bearish", "detect_bearish_order_block")),
    ("institutional", "LONG", ("detect_balanced_price_range_bullish", "price_above_ema_fast")),
)
# Directed detectors that make no template by themselves.
NOT_ALONE = (
    "bullish_engulfing", "bearish_engulfing", "bullish_imbalance", "bearish_imbalance", "bullish_order_block", "bearish_order_block",
    "optimal_trade_entry_long", "optimal_trade_entry_short", "bullish_pin_bar",
)
# Detectors whose template has twice the chance of another.
TWICE = ("mitigation_block_bullish", "mitigation_block_bearish", "turtle_soup_bullish", "turtle_soup_bearish", "rejection_block_bullish", "rejection_block_bearish", "volume_imbalance_bullish")
# Dimensions of the grid with the probability of each value.
FILTERS = {"": 0.5, "price_above_vwap": 1 / 6, "price_below_vwap": 1 / 6, "price_within_0.5pct_of_vwap": 1 / 6}
RSI = {"": 0.7, "rsi_below_70": 0.06, "rsi_above_30": 0.06, "rsi_crossed_above_30": 0.06, "rsi_crossed_below_70": 0.06, "rsi_between_40_60": 0.06}
ZONE = {False: 0.5, True: 0.5}
KILL_ZONE = {False: 0.7, True: 0.3}
EMAS = {(9, 21): 0.25, (9, 34): 0.25, (13, 21): 0.25, (13, 34): 0.25}
STOPS = dict.fromkeys(("1.5x_atr_from_entry", "2x_atr_from_entry", "0.5pct_from_entry", "1pct_from_entry", "swing_point_stop", "entry_candle_stop"), 1 / 6)
EXITS = {"": 0.5, "ema_crossover_reversal": 1 / 6, "price_crosses_vwap_opposite": 1 / 6, "end_of_session": 1 / 6}
#: Shares of the types; vwap and ema templates share what is technical.
MIX = {"balanced": (0.5, 0.3, 0.2), "institutional": (0.7, 0.2, 0.1), "price_action": (0.2, 0.7, 0.1)}


def templates() -> list[tuple[str, str, tuple[str, ...]]]:
    """The stated templates, and each directed detector alone but for NOT_ALONE and first versions."""
    alone = []
    for name in (n for n, d in DETECTORS.items() if d.kind != ARRAYS):
        up, down = name.endswith(("_bullish", "_long")) or name.startswith("bullish_"), name.endswith(("_bearish", "_short")) or name.startswith("bearish_")
        if (up or down) and name not in NOT_ALONE and "_v1" not in name:
            alone.append(("institutional", "LONG" if up else "SHORT", (f"detect_{name}",)))
    return [*TEMPLATES, *alone]


def shares(focus: str = "balanced") -> list[tuple[str, str, tuple[str, ...], float]]:
    """(type, direction, rules, share) of each template; the shares of a type add up to the type's."""
    institutional, action, technical = MIX[focus]
    of_type = {"institutional": institutional, "price_action": action, "vwap": technical / 2, "ema": technical / 2}
    times = lambda rules: 2 if len(rules) == 1 and rules[0].removeprefix("detect_") in TWICE else 1
    all_of = {t: sum(times(r) for k, _, r in templates() if k == t) for t in of_type}
    return [(t, d, r, of_type[t] * times(r) / all_of[t]) for t, d, r in templates()]


def template_table(spark: SparkSession, focus: str = "balanced") -> DataFrame:
    """(template, type, direction, rules, share): the chance of each template."""
    rows = [(i, t, d, list(r), share) for i, (t, d, r, share) in enumerate(shares(focus))]
    return spark.createDataFrame(rows, "template int, type string, direction string, rules array<string>, share double")


def biased(table: DataFrame, sentiment: str = "NEUTRAL") -> DataFrame:
    """Templates of the direction that a sentiment asks for, or all of a type that has none of it; types keep their chances."""
    wanted = {"BULLISH": "LONG", "BEARISH": "SHORT"}.get(sentiment)
    if not wanted:
        return table
    fits = F.col("direction") == wanted
    # Types are a handful, so they are gathered and sent to all tasks; a window over a type would put half of the templates into one.
    of_type = table.groupBy(F.col("type").alias("_type")).agg(F.max(fits).alias("_any"), F.sum("share").alias("_all"), F.sum(F.when(fits, F.col("share"))).alias("_own"))
    rows = table.join(F.broadcast(of_type), F.col("type").eqNullSafe(F.col("_type"))).filter(~F.col("_any") | fits)
    return rows.withColumn("share", F.when(F.col("_any"), F.col("share") * F.col("_all") / F.col("_own")).otherwise(F.col("share"))).select(*table.columns)


def _sql(value) -> str:
    """A value as a SQL literal; long lists of literals are built from text, in one call to the JVM."""
    if isinstance(value, tuple):
        return f"array({', '.join(map(_sql, value))})"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value!r}D" if isinstance(value, float) else f"{value}L" if abs(value) >= 2**31 else str(value)


def _axis(name: str, values: dict) -> Column:
    """A dimension as an array of (value, probability)."""
    return F.expr(f"array({', '.join(f"named_struct('value', {_sql(k)}, 'p', {_sql(float(p))})" for k, p in values.items())})").alias(name)


def _axes(risk_rewards: tuple[float, ...], timeframes: tuple[str, ...], small: bool = False) -> dict[str, dict]:
    """Every dimension but the template, with the chance of each value."""
    none = lambda axis, empty: {empty: 1.0} if small else axis
    return {"timeframe": dict.fromkeys(timeframes, 1 / len(timeframes)), "vwap": none(FILTERS, ""), "rsi": none(RSI, ""), "zone": none(ZONE, False), "clock": none(KILL_ZONE, False), "emas": EMAS, "stop": STOPS, "exit": none(EXITS, ""), "rr": dict.fromkeys(risk_rewards, 1 / len(risk_rewards))}


def grid(spark: SparkSession, table: DataFrame, risk_rewards: tuple[float, ...] = (1.8, 2.0, 2.5, 3.0), market: str = "*", timeframes: tuple[str, ...] = TIMEFRAMES, small: bool = False) -> DataFrame:
    """All combinations as strategies with ``probability``; ``small`` leaves filters, exits and clocks out.

    The dimensions are a few constants each. Those that decide entry rules are exploded first, so that rules are put
    together once for each template and options. All others make one small table, sent to all tasks, which has its
    share of the id's text ready. Templates are spread over all tasks before each becomes many strategies.
    """
    axes = _axes(risk_rewards, timeframes, small)
    value = {n: F.col(f"_{n}.value") for n in axes}
    settings, rows = spark.range(1), table.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    for name, values in axes.items():
        if name in RULE_AXES:
            rows = rows.withColumn(f"_{name}", F.explode(_axis(name, values)))
        else:
            settings = settings.withColumn(f"_{name}", F.explode(_axis(name, values)))
    institutional = F.col("type") == "institutional"
    chance = lambda names: [F.col(f"_{n}.p").alias(f"_{n}_p") for n in names]
    others = [n for n in axes if n not in RULE_AXES]
    settings = settings.select(*_settings(value, market), *chance(others)).withColumn("_after", _settings_text())
    rows = rows.filter(institutional | ~value["zone"]).select("type", "direction", "template", "share", *_rules(value), *chance(RULE_AXES)).withColumn("_before", _rules_text())
    probability = F.col("share")
    for n in axes:
        # Other types never ask for a zone, so what they have without one is certain.
        probability = probability * (F.when(institutional, F.col(f"_{n}_p")).otherwise(F.lit(1.0)) if n == "zone" else F.col(f"_{n}_p"))
    return _named(rows.crossJoin(F.broadcast(settings)), _id(F.col("_before"), F.col("_after")), probability.alias("probability"))


#: The axes that decide entry rules.
RULE_AXES = ("vwap", "rsi", "zone", "clock")


def _rules(value: dict[str, Column]) -> list[Column]:
    """What a template and the axes of rules decide."""
    zone = F.when(F.col("direction") == "LONG", F.lit("detect_discount_zone")).otherwise(F.lit("detect_premium_zone"))
    optional = F.array_compact(F.array(
        F.when(value["zone"] & (F.col("type") == "institutional") & ~F.array_contains("rules", zone), zone),
        F.when(value["vwap"] != "", value["vwap"]), F.when(value["rsi"] != "", value["rsi"]), F.when(value["clock"], F.lit("is_in_kill_zone")),
    ))
    return [F.array_distinct(F.concat("rules", optional)).alias("entry_rules"), (value["vwap"] != "").alias("use_vwap"), (value["rsi"] != "").alias("use_rsi")]


def _settings(value: dict[str, Column], market: str) -> list[Column]:
    """What the other axes decide."""
    return [
        F.concat(F.array(F.lit("stop_loss_hit"), F.lit("take_profit_hit")), F.when(value["exit"] != "", F.array(value["exit"])).otherwise(F.array().cast("array<string>"))).alias("exit_rules"),
        value["stop"].alias("stop_loss_logic"), F.concat(value["rr"].cast("string"), F.lit("x_stop_distance")).alias("take_profit_logic"), value["rr"].cast("double").alias("risk_reward"),
        value["timeframe"].alias("timeframe"), F.lit(market).alias("market"), value["emas"][0].alias("ema_fast"), value["emas"][1].alias("ema_slow"),
    ]


def _named(rows: DataFrame, identity: Column, *more: Column) -> DataFrame:
    """Strategies of rows that have what ``_rules`` and ``_settings`` give, and type, direction and template."""
    rows = rows.withColumn("strategy_id", identity)
    return rows.select(
        "entry_rules", "exit_rules", "stop_loss_logic", "take_profit_logic", "risk_reward", "timeframe", "market", "ema_fast", "ema_slow", "use_vwap", "use_rsi", "type", "direction", "template",
        *more, "strategy_id", F.concat_ws("_", "type", "template", "timeframe").alias("name"),
    )


#: Bits of a drawn number, against which prefix sums of weights are held.
BITS = 32


@dataclass(frozen=True)
class Space:
    """All strategies of a list of templates as numbers 0..size - 1: mixed-radix, the template first.

    ``templates`` are (type, direction, rules, share); ``axes`` map a name to its values with their weights. Both are
    short lists of the program. How many strategies there are matters to nothing here.
    """

    templates: tuple[tuple[str, str, tuple[str, ...], float], ...]
    axes: dict[str, dict]

    @classmethod
    def of(cls, focus: str = "balanced", risk_rewards: tuple[float, ...] = (1.8, 2.0, 2.5, 3.0), timeframes: tuple[str, ...] = TIMEFRAMES) -> Space:
        """The templates with the chances of a focus, and the axes of ``grid``."""
        return cls(tuple(shares(focus)), _axes(risk_rewards, timeframes))

    @property
    def radix(self) -> dict[str, int]:
        return {"template": len(self.templates)} | {n: len(v) for n, v in self.axes.items()}

    @property
    def size(self) -> int:
        return prod(self.radix.values())

    def bounds(self) -> dict[str, list[int]]:
        """Prefix sums of each digit's weights without the last, as parts of 2**BITS."""
        weights = {"template": [t[3] for t in self.templates]} | {n: list(v.values()) for n, v in self.axes.items()}
        return {n: [round(part / fsum(w) * 2**BITS) for part in list(accumulate(w))[:-1]] for n, w in weights.items()}

    def at_number(self, numbers: DataFrame, market: str = "*") -> DataFrame:
        """The strategies of the column ``number``; other columns stay. A number outside the space gives no row."""
        return self._decoded(numbers.filter(F.col("number").between(0, self.size - 1)), market)

    def drawn(self, rows: DataFrame, key: str, seed: int = 0, market: str = "*") -> DataFrame:
        """Every row with the strategy that ``draw`` gives it.

        A drawn number lies in the space. To test it would be to draw it again, as Spark moves tests below the drawing.
        """
        return self._decoded(self.draw(rows, key, seed), market)

    def _decoded(self, numbers: DataFrame, market: str) -> DataFrame:
        """The strategies of numbers that lie in the space."""
        if self.size >= 2**63:
            raise ValueError(f"{self.size} strategies are too many to number")
        rest, digit = F.col("number"), {}
        for name, n in reversed(self.radix.items()):
            digit[name] = (rest % n).cast("int")
            rest = F.call_function("div", rest, F.lit(n))
        known = F.expr(f"array({', '.join(f"named_struct('type', {_sql(t)}, 'direction', {_sql(d)}, 'rules', {_sql(tuple(r))})" for t, d, r, _ in self.templates)})")
        rows = numbers.select(*numbers.columns, digit["template"].alias("template"), F.get(known, digit["template"]).alias("_t"), *(F.get(_axis(n, v), digit[n])["value"].alias(f"_{n}") for n, v in self.axes.items()))
        rows = rows.select("*", "_t.*")
        value = {n: F.col(f"_{n}") for n in self.axes}
        return _named(rows.select("type", "direction", "template", *_rules(value), *_settings(value, market), *numbers.columns), strategy_id(), *numbers.columns)

    def draw(self, rows: DataFrame, key: str, seed: int = 0) -> DataFrame:
        """Adds ``number``, a strategy drawn by weight with replacement, which ``key`` and seed alone decide.

        A zone that a template's type or rules have no use for is not drawn, so equal strategies get equal numbers.
        """
        hexes = [F.md5(F.concat_ws("~", F.lit(str(seed)), F.col(key).cast("string"), F.lit(str(k)))).alias(f"_hex{k}") for k in range(-(-len(self.radix) // 4))]
        digit = {}
        for at, (name, bounds) in enumerate(self.bounds().items()):
            u = F.conv(F.substring(f"_hex{at // 4}", at % 4 * 8 + 1, 8), 16, 10).cast("long")
            digit[name] = _passed(bounds, u) if bounds else F.lit(0)
        without = list(self.axes["zone"]).index(False)
        rows = rows.select("*", *hexes).select("*", digit["template"].alias("_template"))
        takes = F.get(F.expr(_sql(tuple(_takes_zone(t, d, r) for t, d, r, _ in self.templates))), F.col("_template"))
        digit |= {"template": F.col("_template"), "zone": F.when(takes, digit["zone"]).otherwise(without)}
        number = F.lit(0).cast("long")
        for name, n in self.radix.items():
            number = number * n + digit[name]
        return rows.withColumn("number", number).drop("_template", *(f"_hex{k}" for k in range(len(hexes))))

    def draw_distinct(self, spark: SparkSession, n: int, seed: int = 0, market: str = "*") -> DataFrame:
        """n different strategies, drawn one after the other and each kept the first time; ``drawn`` is its place in that order.

        That is drawing without replacement. Draws are doubled until n differ; where 128 draws for each do not
        give n, the space is nearly used up, and ``sample`` of the whole grid is the way.
        """
        if n > self.size:
            raise ValueError(f"there are no {n} different strategies among {self.size}")
        draws = n
        while draws <= 128 * max(n, 1):
            found = self.draw(spark.range(draws), "id", seed).groupBy("number").agg(F.min("id").alias("drawn"))
            found = self._decoded(found, market)
            found = found.groupBy("strategy_id").agg(F.min_by(F.struct(*found.columns), "drawn").alias("s")).select("s.*")
            if found.count() >= n:
                return found.orderBy("drawn").limit(n).drop("number")
            draws *= 2
        raise ValueError(f"{n} different strategies did not turn up in {draws // 2} draws")


def _passed(bounds: list[int], u: Column) -> Column:
    """How many of the bounds, which ascend, ``u`` has reached: a binary search.

    It stands in a function of ``u``, as Spark would work out ``u`` itself anew at each step.
    """
    steps = [2**k for k in reversed(range(len(bounds).bit_length()))]
    padded = F.expr(_sql((*bounds, *[2**BITS] * (2 * steps[0] - 1 - len(bounds))))).cast("array<bigint>")
    search = lambda x: F.aggregate(F.expr(_sql(tuple(steps))), F.lit(0), lambda at, step: F.when(F.get(padded, at + step - 1) <= x, at + step).otherwise(at))
    return F.get(F.transform(F.array(u), search), F.lit(0))


def _takes_zone(kind: str, direction: str, rules: tuple[str, ...]) -> bool:
    return kind == "institutional" and ("detect_discount_zone" if direction == "LONG" else "detect_premium_zone") not in rules


def strategy_id() -> Column:
    """16 hex digits that all settings of a strategy decide."""
    return _id(_rules_text(), _settings_text())


def _id(rules: Column, settings: Column) -> Column:
    return F.left(F.md5(F.concat_ws("~", rules, settings)), F.lit(16))


def _rules_text() -> Column:
    return F.array_join("entry_rules", "|")


def _settings_text() -> Column:
    return F.concat_ws("~", F.array_join("exit_rules", "|"), "stop_loss_logic", F.col("risk_reward").cast("string"), "timeframe", "market", F.col("ema_fast").cast("string"), F.col("ema_slow").cast("string"))


def id_number(strategy: str = "strategy_id") -> Column:
    """An id as a long of the same order: the least and greatest long of many rows are found without sorting them, those of texts are not."""
    return F.conv(F.col(strategy), 16, -10).cast("long").bitwiseXOR(F.lit(-(2**63)))


def id_of(number: Column) -> Column:
    """The id of such a number."""
    return F.lpad(F.lower(F.hex(number.bitwiseXOR(F.lit(-(2**63))))), 16, "0")


def sample(strategies: DataFrame, n: int, seed: int = 0, weight: str = "probability") -> DataFrame:
    """n strategies drawn by weight without replacement: the smallest -ln(u) / weight, u from a hash of id and seed."""
    u = (F.conv(F.substring(F.md5(F.concat_ws("~", F.lit(str(seed)), "strategy_id")), 1, 8), 16, 10).cast("double") + 1) / 4294967297.0
    return strategies.withColumn("draw", -F.log(u) / F.col(weight)).orderBy("draw", "strategy_id").limit(n)
