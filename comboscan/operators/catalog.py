"""Predicate catalogs: flags, thresholds from quantiles, pairs; pruned by what the data say. One aggregate reads the data,
the rest is planned on the driver over a few hundred names."""

from __future__ import annotations

import hashlib
import math
import operator
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate, chain, repeat, takewhile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comboscan.functions import cols as C
from comboscan.operators import order as O
from comboscan.operators.combos import Predicate

#: The flags a rich catalog searches, in order.
FLAGS = """is_tribar is_tribar_green is_tribar_red is_tribar_hl is_tribar_hl_green is_tribar_hl_red consecutive_green_2 consecutive_green_3
consecutive_red_2 consecutive_red_3 prev_tribar prev_green higher_high higher_low lower_high lower_low is_hammer is_shooting_star bullish_engulfing
bearish_engulfing adx_rising adx_accelerating kf_adx_increasing kf_adx_decreasing kf_adx_accelerating kf_adx_decelerating kf_adx_trend_emerging
kf_adx_trend_fading is_kf_atr_squeeze is_kf_atr_c2c_squeeze is_kf_atr_volatility_spike is_kf_atr_volatility_drop is_kf_atr_c2c_spike is_kf_atr_c2c_drop
kf_atr_c2c_contracting kf_atr_c2c_expanding kf_atr_contracting kf_atr_expanding kf_volatility_divergence kf_momentum_increasing kf_momentum_decreasing
kf_slope_increasing kf_slope_decreasing kf_trending_volatile kf_trending_quiet kf_ranging_volatile kf_ranging_quiet is_kf_strong_trend_low_vol
is_kf_breakout_potential is_kf_consolidation kf_trending_c2c_volatile kf_trending_c2c_quiet is_kf_gap_trading_opportunity is_kf_smooth_trend
is_kf_positive_surprise is_kf_negative_surprise is_rsi_oversold_recovery is_rsi_overbought_recovery stoch_bullish_cross stoch_bearish_cross macd_cross_up
macd_cross_down is_bb_squeeze""".split()

#: The operators of each numeric column with thresholds; consecutive_green has >= alone.
BOUNDS = "rsi_14 adx kf_adx bb_position kf_vs_200sma kf_vs_9ema price_vs_9ema_dev price_vs_200sma_dev 9ema_to_200sma kf_price_deviation macd macd_hist macd_signal stoch_k stoch_d momentum_score trend_strength".split()
BOTH = "momentum_14 roc_5 roc_10 kf_trend_momentum kf_atr_momentum_5 kf_atr_c2c_momentum_5 kf_adx_momentum_5 kf_atr_deviation kf_adx_deviation kf_atr_vs_c2c kf_trend_volatility_ratio bb_std body_to_total_wick body_atr_ratio".split()
ABOVE = """rsi_7 rsi_21 atr_pct volatility_20_cv body_size_pct kf_atr_pct kf_atr_c2c_pct kf_innovation_abs kf_adx_innovation_abs atr_c2c_pct ext ext_sma14
wicks_diff wicks_diff_sma14 bar_range_pct adx_sma lower_shadow_ratio upper_shadow_ratio atr_pct_mean50 atr_c2c_mean50 kf_atr kf_atr_c2c""".split()
OPERATORS = {**{c: (">=", "<=") for c in BOUNDS}, **{c: (">", "<") for c in BOTH}, **{c: (">",) for c in ABOVE}, "consecutive_green": (">=",)}
DEFAULT_PARTNERS = ("close", "open", "high", "low", "kf_smooth")
#: The 1-2-5 ladder of steps.
STEPS = [m * 10.0**e for e in range(-5, 4) for m in (1, 2, 5)]


@dataclass
class Entry:
    name: str
    category: str
    predicate: Predicate
    threshold: float | None = None

    def column(self) -> Column:
        p = self.predicate
        if p.op is None:
            return C.true(F.col(f"`{self.name}`").cast("boolean"))
        return C.compare(F.col(f"`{p.base}`"), p.op, F.col(f"`{p.rhs}`") if p.rhs else self.threshold)


def flag(name: str) -> Entry:
    return Entry(name, "boolean", Predicate(name))


def constant(base: str, op: str, value: float, label: str | None = None) -> Entry:
    name = f"{base}{op}{label if label is not None else repr(value)}"
    return Entry(name, "feature_vs_constant", Predicate(name, base, op), value)


def pair(left: str, op: str, right: str) -> Entry:
    name = f"{left}{op}{right}"
    return Entry(name, "feature_vs_feature", Predicate(name, left, op, right))


def pairs(names: list[str], ops: tuple[str, ...] = (">",), ordered: bool = True, limit: int | None = None, partners: dict[str, tuple[str, ...]] | None = None) -> list[Entry]:
    """Pairs of different columns: all ordered ones, or each once with the earlier first; with partners, where either side lists the other."""
    ok = lambda a, b: partners is None or b in partners.get(a, DEFAULT_PARTNERS) or a in partners.get(b, DEFAULT_PARTNERS)
    out = []
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            if a != b and (ordered or i < j) and ok(a, b):
                out += [pair(a, op, b) for op in ops]
    return out[:limit]


def nice(value: float, down: bool) -> float:
    """A bound of the 1-2-5 ladder of value's decade. Positive values step down or up to the next rung; negative ones go to the
    decade's lowest rung (down) or its top (up)."""
    if value == 0:
        return 0.0
    decade = 10.0 ** math.floor(math.log10(abs(value)))
    if value < 0:
        return -decade if down else -10 * decade
    ladder = [decade * k for k in (1, 2, 5, 10)]
    return ladder[max(bisect_right(ladder, value) - 1, 0) if down else min(bisect_left(ladder, value), 3)]


def increment(low: float, high: float, operators: int, target: int = 10) -> float:
    """The standard step whose whole steps across the span, once for each operator, come nearest to ``target`` among those that give
    5 to 15; where none does, the step nearest to an even division. The smaller step wins ties."""
    span = high - low
    if span <= 0:
        return 0.0
    made = {step: operators * math.floor(span / step) for step in STEPS}
    fit = [step for step, n in made.items() if 5 <= n <= 15]
    even = span * operators / (target + operators)
    return min(fit, key=lambda step: abs(made[step] - target)) if fit else min(STEPS, key=lambda step: abs(step - even))


def grid(low: float, high: float, step: float, op: str) -> list[float]:
    """Thresholds from low up by steps that the range's own end on the operator's side still meets."""
    if step <= 0:
        return []
    end = high if op.startswith(">") else low
    holds = {">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le}[op]
    return [x for x in takewhile(lambda x: x <= high + C.EPS, accumulate(chain([low], repeat(step)))) if holds(end, x)]


def label(value: float) -> str:
    """At most two decimals, at least one."""
    return str(float(f"{value:.2f}"))


def nearest_quantiles(df: DataFrame, columns: list[str], qs: list[float]) -> dict[tuple[str, float], float]:
    """(column, q) -> nearest-rank quantile round((n - 1) q) of finite values, halves up."""
    n_of = df.agg(*[F.count(C.num(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    rank = lambda n, q: math.floor((n - 1) * q + 0.5)
    got = O.values_at(df, columns, lambda n: [rank(n, q) for q in qs])
    return {(c, q): got[c][rank(n_of[i], q)] for i, c in enumerate(columns) if c in got for q in qs}


def threshold_entries(
    df: DataFrame, operators: dict[str, tuple[str, ...]] | None = None, short_labels: bool = True, bounds: dict[str, tuple] | None = None
) -> list[Entry]:
    """Thresholds of each column from its 1st and 99th percentile; the first of equal names stays. ``bounds``: (min, max, step) of
    a column, each "auto" or a number."""
    have = {k: v for k, v in (operators or OPERATORS).items() if k in df.columns}
    qs = O.linear_quantiles(df, sorted(have), [0.01, 0.99]) if have else {}
    out: dict[str, Entry] = {}
    for name, (a, b) in qs.items():
        given = [None if x == "auto" else float(x) for x in (bounds or {}).get(name, ("auto",) * 3)]
        low = nice(a, True) if given[0] is None else given[0]
        high = nice(b, False) if given[1] is None else given[1]
        step = increment(low, high, len(have[name])) if given[2] is None else given[2]
        for op in have[name]:
            for v in grid(low, high, step, op):
                e = constant(name, op, v, label(v) if short_labels else None)
                out.setdefault(e.name, e)
    return list(out.values())


def builtin_catalog(df: DataFrame, with_pairs: bool = False) -> list[Entry]:
    """Four flags, volume / range / abs_body over their median and third quartile, and ordered pairs of prices and means."""
    cols = ["volume", "range", "abs_body"]
    q = nearest_quantiles(df, cols, [0.5, 0.75])
    out = [flag(n) for n in ("is_green", "is_red", "is_inside_bar", "is_range_expansion")]
    out += [constant(c, ">", q[c, p], f"p{int(p * 100)}") for c in cols for p in (0.5, 0.75) if (c, p) in q]
    return out + (pairs(["close", "sma_9", "sma_20", "sma_50"]) if with_pairs else [])


def rich_catalog(df: DataFrame, with_pairs: bool = False, limit: int | None = None) -> list[Entry]:
    """Flags, then thresholds, then pairs, each category by name where it has no order of its own."""
    flags = [flag(n) for n in FLAGS if n in df.columns]
    consts = sorted(threshold_entries(df), key=lambda e: (e.predicate.base, e.predicate.op, e.threshold))
    numeric = core_columns(df)
    return flags + consts + (pairs(numeric, (">",), False, limit, {}) if with_pairs else [])


def prune(df: DataFrame, entries: list[Entry], target: str, reward: str, min_sample: int) -> tuple[list[Entry], dict[str, int]]:
    """What can matter: enough trades; comparisons that are neither constant nor equal to an earlier comparison. One aggregate."""
    elig = F.coalesce(F.col(f"{target}_eligible"), F.lit(True)) if f"{target}_eligible" in df.columns else F.lit(True)
    gate = elig & C.num(reward).isNotNull() if reward in df.columns else elig
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, e in enumerate(entries):
        m = e.column()
        aggs += [F.count_if(m).alias(f"c{i}"), F.count_if(m & gate).alias(f"t{i}"), F.bit_xor(F.when(m, F.xxhash64("symbol", "bar_idx"))).alias(f"x{i}"), F.bit_xor(F.when(m, F.xxhash64("bar_idx", "symbol"))).alias(f"y{i}")]
    r = df.agg(*aggs).first()
    kept, seen, why = [], set(), {"constant": 0, "under_min": 0, "duplicate": 0}
    for i, e in enumerate(entries):
        key = (r[f"c{i}"], r[f"x{i}"], r[f"y{i}"])
        if e.category != "boolean" and r[f"c{i}"] in (0, r["n"]):
            why["constant"] += 1
        elif r[f"t{i}"] < min_sample:
            why["under_min"] += 1
        elif e.category != "boolean" and key in seen:
            why["duplicate"] += 1
        else:
            kept.append(e)
            if e.category != "boolean":
                seen.add(key)
    return kept, why


#: Numeric columns that only pairs use.
PAIRED = ("close", "open", "high", "low", "kf_smooth", "9ema", "20ema", "50ema", "200sma")


def core_columns(df: DataFrame) -> list[str]:
    """The numeric columns a rich catalog compares."""
    return sorted(c for c in {*OPERATORS, *PAIRED} if c in df.columns)


@dataclass
class Audit:
    """What the columns of prepared data and the catalog's lists do not agree on."""

    unlisted_flags: list[str]
    unlisted_numbers: dict[str, tuple[float, float, float, float]]  # 1st and 99th percentile (ranks rounded down), least, greatest
    missing_flags: list[str]
    missing_numbers: list[str]
    not_numbers: list[str]

    def lines(self) -> list[str]:
        out = [f"{len(v)} {what}: {', '.join(v)}" for what, v in (
            ("flags in no catalog", self.unlisted_flags), ("flags of the catalog missing", self.missing_flags),
            ("numbers of the catalog missing", self.missing_numbers), ("numbers of the catalog that are flags or none", self.not_numbers)) if v]
        return out + [f"number in no catalog: {n} P1-P99 [{a:.4f}, {b:.4f}] data [{c:.4f}, {d:.4f}]" for n, (a, b, c, d) in sorted(self.unlisted_numbers.items())]


def audit(df: DataFrame, flags: list[str] = FLAGS, numbers: dict = OPERATORS) -> Audit:
    """Compares prepared data with the catalog's lists: booleans, whole-number columns of 0 and 1 alone, and doubles."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    whole = [c for c, k in kinds.items() if k in ("byte", "short", "integer", "long")]
    real = [c for c, k in kinds.items() if k in ("float", "double")]
    zero_one = lambda c: F.bool_and(F.when(C.num(f"`{c}`").isNotNull(), F.col(f"`{c}`").isin(0, 1)))
    seen = df.agg(F.lit(1), *[zero_one(c).alias(f"z{i}") for i, c in enumerate([*whole, *real])]).first()
    binary = {c for i, c in enumerate([*whole, *real]) if seen[f"z{i}"]}
    other = [c for c in real if c not in numbers]
    n_of = df.agg(F.lit(1), *[F.count(C.num(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(other)]).first()
    n_of = {c: n_of[f"n{i}"] for i, c in enumerate(other)}
    at = O.values_at(df, [c for c in other if n_of[c] > 1], lambda n: [int(0.01 * (n - 1)), int(0.99 * (n - 1)), 0, n - 1])
    spans = {c: tuple(v[k] for k in (int(0.01 * (n_of[c] - 1)), int(0.99 * (n_of[c] - 1)), 0, n_of[c] - 1)) for c, v in at.items()}
    return Audit(
        sorted(c for c, k in kinds.items() if c not in flags and (k == "boolean" or (c in binary and c in whole))), spans,
        [c for c in flags if c not in kinds], [c for c in numbers if c not in kinds], [c for c in numbers if c in kinds and (c not in real or c in binary)],
    )


def catalog_digest(entries: list[Entry]) -> str:
    lines = sorted(f"{e.category}|{e.name}|{e.predicate.base}|{e.predicate.op}|{e.threshold!r}|{e.predicate.rhs}" for e in entries)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def catalog_frame(spark, entries: list[Entry]) -> DataFrame:
    rows = [(i, e.name, e.category, e.predicate.base, e.predicate.op, e.threshold, e.predicate.rhs) for i, e in enumerate(entries)]
    return spark.createDataFrame(rows, "idx int, name string, category string, base string, op string, threshold double, rhs string")


def with_masks(df: DataFrame, entries: list[Entry]) -> DataFrame:
    """The key columns and one boolean per entry."""
    keep = [c for c in df.columns if c not in {e.name for e in entries if e.category != "boolean"}]
    return df.select(*[f"`{c}`" for c in keep if c not in {e.name for e in entries}], *[e.column().alias(e.name) for e in entries])
