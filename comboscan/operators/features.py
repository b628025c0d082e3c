"""Engineered columns of bars: a small set, and the rich set of indicators and conditions.

Columns are added in stages (row-wise, recursive, windows over those), all partitioned by symbol and ordered by bar_idx, so one
exchange serves every window. Names and parameters are fixed values that prepared data and rules refer to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from comboscan.functions import cols as C
from comboscan.operators.kernels import with_recursive
from comboscan.operators.order import with_average_ranks
from comboscan.session import materialize


def builtin_features(bars: DataFrame) -> DataFrame:
    """is_green, is_red, is_inside_bar, is_range_expansion, range, body, abs_body, sma_9, sma_20, sma_50."""
    o, h, low, c = (C.num(x) for x in ("open", "high", "low", "close"))
    rng = h - low
    return bars.withColumns({
        "is_green": C.true(c > o), "is_red": C.true(c < o),
        "is_inside_bar": C.true((h <= C.lag(h)) & (low >= C.lag(low))), "is_range_expansion": C.true(rng > C.lag(rng)),
        "range": rng, "body": c - o, "abs_body": F.abs(c - o), **{f"sma_{p}": C.sma(c, p) for p in (9, 20, 50)},
    })


def candle_columns() -> dict[str, Column]:
    o, h, low, c = (C.num(x) for x in ("open", "high", "low", "close"))
    top, bottom = F.greatest(o, c), F.least(o, c)
    up, down, body = h - top, bottom - low, F.abs(c - o)
    green, red = C.true(c > o), C.true(c < o)
    both_tops, both_bottoms = F.greatest(C.lag(top), C.lag(top, 2)), F.least(C.lag(bottom), C.lag(bottom, 2))
    early = F.row_number().over(C.over()) <= 2
    tri = lambda cond: ~early & C.true(cond)
    wick = F.greatest(up, down)
    out = {
        "is_green": green, "is_red": red,
        "is_tribar_green": tri(green & (c > both_tops)), "is_tribar_red": tri(red & (c < both_bottoms)),
        "is_tribar_hl_green": tri(green & (c > F.greatest(C.lag(h), C.lag(h, 2)))), "is_tribar_hl_red": tri(red & (c < F.least(C.lag(low), C.lag(low, 2)))),
        "upper_shadow_ratio": C.ratio(up, h - low), "lower_shadow_ratio": C.ratio(down, h - low),
        "wicks_diff": F.when(c > o, o - low).otherwise(h - o), "body_to_total_wick": C.ratio(body, up + down, 1e-9), "body_vs_max_wick_ratio": C.ratio(body, wick),
        "higher_high": C.rising(h), "higher_low": C.rising(low), "lower_high": C.falling(h), "lower_low": C.falling(low),
        "is_hammer": C.true((body < 0.5 * down) & (down > 2 * up)), "is_shooting_star": C.true((body < 0.5 * up) & (up > 2 * down)),
        "bullish_engulfing": C.true(green & C.lag_flag(red) & (body > C.lag(body))), "bearish_engulfing": C.true(red & C.lag_flag(green) & (body > C.lag(body))),
        "bar_range_pct": C.ratio(h - low, c), "body_size_pct": C.ratio(body, c), "volatility_20_cv": C.rolling_cv(c, 20), "bb_std": C.rolling_std(c, 20),
        "200sma": C.sma(c, 200), "bb_middle": C.sma(c, 20), "roc_5": C.roc(c, 5), "roc_10": C.roc(c, 10), "momentum_14": C.momentum(c, 14),
        "ext": F.coalesce(h - C.rolling_min(low, 20), F.lit(0.0)), "consecutive_green": C.rolling_sum(green, 3),
    }
    for n in (2, 3):
        out |= {f"consecutive_green_{n}": C.streak(green, n), f"consecutive_red_{n}": C.streak(red, n)}
    for k in ("0_5", "1_0", "1_5", "2_0", "2_5"):
        out[f"body_dominant_{k}x"] = C.true(body > wick * float(k.replace("_", ".")))
    return out


def stochastic(h: Column, low: Column, c: Column, p: int = 14, smooth: int = 3, eps: float = 1e-9) -> tuple[Column, Column]:
    """(slow %K, raw range is zero anywhere) helper: raw %K; where any range of the series is zero, eps widens all of them."""
    full = F.row_number().over(C.over()) >= p
    hi, lo = F.when(full, F.max(h).over(C.over(p))), F.when(full, F.min(low).over(C.over(p)))
    return hi, lo


def with_stochastic(df: DataFrame, p: int = 14, smooth: int = 3, eps: float = 1e-9) -> DataFrame:
    """Adds stoch_k and stoch_d (rounded to 15 places)."""
    hi, lo = stochastic(C.num("high"), C.num("low"), C.num("close"), p)
    df = df.withColumns({"_hi": hi, "_lo": lo})
    flat = F.max((F.col("_hi") - F.col("_lo")) == 0).over(Window.partitionBy("symbol"))
    df = df.withColumn("_rng", F.col("_hi") - F.col("_lo") + F.when(C.true(flat), F.lit(eps)).otherwise(0.0))
    raw = C.ratio(C.num("close") - F.col("_lo"), F.col("_rng"), 0.0) * 100
    df = df.withColumn("_raw", F.when(F.col("_rng") > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))))
    df = df.withColumn("_k", C.sma(F.col("_raw"), smooth))
    return df.withColumns({"stoch_k": F.round("_k", 15), "stoch_d": F.round(C.sma(F.col("_k"), smooth), 15)}).drop("_hi", "_lo", "_rng", "_raw", "_k")


def bollinger(c: Column, p: int = 20, k: float = 2.0) -> tuple[Column, Column, Column]:
    mid, std = C.sma(c, p), C.rolling_std(c, p)
    return mid - k * std, mid, mid + k * std


def band_position(c: Column, lower: Column, upper: Column) -> Column:
    """Place within the bands; 0.5 where they meet."""
    w = upper - lower
    return F.when(w.isNotNull(), F.when(F.abs(w) < C.EPS, F.lit(0.5)).otherwise((c - lower) / F.when(F.abs(w) >= C.EPS, w)))


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def rich_features(bars: DataFrame) -> DataFrame:
    """All indicators and conditions. Percentile ranks, the strong-trend quantile and the stochastic's zero-range rule use the
    whole series, so they look ahead. Expects (symbol, bar_idx, open, high, low, close)."""
    df = with_recursive(bars).withColumns(candle_columns())
    df = with_stochastic(df)
    o, h, low, c = (C.num(x) for x in ("open", "high", "low", "close"))
    body = F.abs(c - o)
    e9, e20, e50, e200, s200 = (_q(x) for x in ("ema9", "ema20", "ema50", "ema200", "200sma"))
    kf, adx, kadx, atr, katr, c2c, kc2c = (_q(x) for x in ("kf_smooth", "adx", "kf_adx", "atr", "kf_atr", "atr_c2c", "kf_atr_c2c"))
    inn = _q("kf_innovation")
    lower, upper = _q("bb_middle") - 2 * _q("bb_std"), _q("bb_middle") + 2 * _q("bb_std")
    df = df.withColumns({
        "9ema": e9, "20ema": e20, "50ema": e50, "is_tribar": _q("is_tribar_green") | _q("is_tribar_red"), "is_tribar_hl": _q("is_tribar_hl_green") | _q("is_tribar_hl_red"),
        "prev_green": C.lag_flag(_q("is_green")), "bullish_bar_sequence": _q("higher_high") & _q("higher_low"), "bearish_bar_sequence": _q("lower_high") & _q("lower_low"),
        "wicks_diff_sma14": C.sma(_q("wicks_diff"), 14), "body_atr_ratio": C.ratio(body, atr),
        "trend_strength": 0.4 * adx / 100 + 0.6 * 10 * F.abs(C.ratio(c, s200) - 1), "adx_sma": C.sma(adx, 14),
        "kf_vs_9ema": C.ratio(kf - e9, e9), "kf_vs_200sma": C.ratio(kf - s200, s200), "kf_price_deviation": C.ratio(c - kf, c), "kf_innovation_abs": F.abs(inn),
        "kf_adx_innovation_abs": F.abs(_q("kf_adx_innovation")), "kf_trend_momentum": C.derivative(_q("kf_trend"), 5),
        "kf_adx_deviation": C.ratio(adx - kadx, kadx + 1e-9), "kf_adx_momentum_5": C.derivative(kadx, 5),
        "price_vs_200sma_dev": C.deviation(c, s200), "price_vs_9ema_dev": C.deviation(c, e9), "9ema_to_200sma": C.deviation(e9, e200),
        "kf_atr_pct": C.ratio(katr, c), "kf_atr_c2c_pct": C.ratio(kc2c, c), "kf_atr_vs_c2c": C.ratio(katr, kc2c + 1e-9), "kf_atr_deviation": C.ratio(atr - katr, katr + 1e-9),
        "kf_atr_momentum_5": C.derivative(katr, 5), "kf_atr_c2c_momentum_5": C.derivative(kc2c, 5), "atr_pct": C.ratio(atr, c), "atr_c2c_pct": C.ratio(c2c, c),
        "atr_pct_mean50": C.sma(atr, 50), "atr_c2c_mean50": C.sma(c2c, 50), "macd_hist_delta_1": C.derivative(_q("macd_hist"), 1),
        "bb_position": band_position(c, lower, upper), "ext_sma14": C.sma(_q("ext"), 14),
    })
    df = materialize(df, "features")
    df = with_average_ranks(df, {"_r14": _q("rsi_14"), "_r5": _q("roc_5"), "_r10": _q("roc_10")}, {"_q80": (_q("trend_strength"), 0.8)})
    df = df.withColumns({
        "momentum_score": (_q("_r14") + _q("_r5") + _q("_r10")) / 3, "prev_tribar": C.lag_flag(_q("is_tribar")),
        "kf_trend_volatility_ratio": C.ratio(kadx, 100 * _q("kf_atr_pct") + 1e-9),
        "_dkf": C.derivative(kf, 1), "_skf": C.derivative(kf, 5) / 5, "_dadx": C.derivative(kadx, 1), "_dc2c": C.derivative(kc2c, 1), "_datr": C.derivative(katr, 1), "_h1": _q("macd_hist_delta_1"),
    }).drop("_r14", "_r5", "_r10")
    return df.withColumns(_conditions(c, o, body, lower, upper)).drop("_q80", "_dkf", "_skf", "_dadx", "_dc2c", "_datr", "_h1", "bb_middle")


def _conditions(c: Column, o: Column, body: Column, lower: Column, upper: Column) -> dict[str, Column]:
    e9, e20, e50, s200, kf = _q("ema9"), _q("ema20"), _q("ema50"), _q("200sma"), _q("kf_smooth")
    adx, kadx, atr, katr, kc2c, inn = _q("adx"), _q("kf_adx"), _q("atr"), _q("kf_atr"), _q("kf_atr_c2c"), _q("kf_innovation")
    ai, ci, t, g, r = _q("kf_atr_innovation"), _q("kf_atr_c2c_innovation"), C.true, _q("is_green"), _q("is_red")
    pct, trend, mid, k, d = _q("body_size_pct"), _q("kf_trend"), _q("bb_middle"), _q("stoch_k"), _q("stoch_d")
    high = t(katr > 1.2 * C.sma(katr, 20))
    quiet = t(katr < 0.8 * C.sma(katr, 20))
    c2c_high, c2c_quiet = t(kc2c > 1.2 * C.sma(kc2c, 20)), t(kc2c < 0.8 * C.sma(kc2c, 20))
    gap, flow = t(_q("kf_atr_vs_c2c") > 1.5), t(_q("kf_atr_vs_c2c") < 1.2)
    s_ai, s_ci, s_in = C.rolling_std(ai, 20), C.rolling_std(ci, 20), C.rolling_std(inn, 20)
    z = (kc2c - C.sma(kc2c, 20)) / F.when(C.rolling_std(kc2c, 20) != 0, C.rolling_std(kc2c, 20))
    out = {
        "is_very_large_green": t(g & (body > 1.5 * atr)), "is_very_large_red": t(r & (body > 1.5 * atr)),
        "is_large_body": t((pct > 1.5 * C.sma(pct, 20)) & (pct > 1e-9)), "is_very_large_body": t(pct > 2 * C.sma(pct, 20)),
        "is_very_strong_trend": t(_q("trend_strength") > _q("_q80")),
        "all_emas_aligned": t((c > e9) & (e9 > e20) & (e20 > e50)), "all_emas_dealigned": t((c < e9) & (e9 < e20) & (e20 < e50)),
        "ema_ribbon_aligned": t((e9 > e20) & (e20 > e50) & (e50 > s200)), "ema_ribbon_dealigned": t((e9 < e20) & (e20 < e50) & (e50 < s200)),
        "is_close_above_200sma": C.greater(c, s200), "is_close_below_200sma": C.less(c, s200), "is_close_above_9ema": C.greater(c, e9), "is_close_below_9ema": C.less(c, e9),
        "is_close_above_kf_ma": C.greater(c, kf), "is_close_below_kf_ma": C.less(c, kf),
        "is_high_volatility": t(atr > 1.2 * C.sma(atr, 20)), "is_low_volatility": t(atr < 0.8 * C.sma(atr, 20)), "expanding_atr": C.rising(atr),
        "is_kf_atr_high_volatility": high, "is_kf_atr_low_volatility": quiet, "is_kf_atr_squeeze": t(katr < 1.1 * C.rolling_min(katr, 50)),
        "is_kf_atr_very_high_volatility": t(katr > C.sma(katr, 20) + 2 * C.rolling_std(katr, 20)),
        "is_kf_atr_volatility_spike": C.greater(ai, 2 * s_ai), "is_kf_atr_volatility_drop": C.less(ai, -2 * s_ai),
        "is_kf_atr_c2c_high_volatility": c2c_high, "is_kf_atr_c2c_low_volatility": c2c_quiet, "is_kf_atr_c2c_squeeze": t(kc2c < 1.1 * C.rolling_min(kc2c, 50)),
        "is_kf_atr_c2c_very_high": t(F.abs(z) > 2), "is_kf_atr_c2c_spike": C.greater(ci, 2 * s_ci), "is_kf_atr_c2c_drop": C.less(ci, -2 * s_ci),
        "kf_atr_c2c_contracting": t(_q("_dc2c") < 0), "kf_atr_c2c_expanding": t(_q("_dc2c") > 0), "kf_atr_contracting": t(_q("_datr") < 0), "kf_atr_expanding": t(_q("_datr") > 0),
        "is_kf_gap_volatility": gap, "is_kf_continuous_volatility": flow,
        "is_rsi_oversold_recovery": C.recovery(_q("rsi_14"), 30, True), "is_rsi_overbought_recovery": C.recovery(_q("rsi_14"), 70, False),
        "rsi_bullish": t(_q("rsi_14") > 50), "rsi_bearish": t(_q("rsi_14") < 50), "rsi_very_bullish": t(_q("rsi_14") > 60), "rsi_very_bearish": t(_q("rsi_14") < 40),
        "is_stoch_oversold": t(F.round(k, 10) < 20), "is_stoch_overbought": t(F.round(k, 10) > 80), "stoch_bullish_cross": C.cross_up(k, d), "stoch_bearish_cross": C.cross_down(k, d),
        "is_strong_momentum_score": t(_q("momentum_score") > 0.75), "is_weak_momentum_score": t(_q("momentum_score") < 0.25),
        "macd_bullish": C.greater(_q("macd"), _q("macd_signal")), "macd_bearish": C.less(_q("macd"), _q("macd_signal")), "macd_cross_up": C.cross_up(_q("macd"), _q("macd_signal")),
        "macd_cross_down": C.cross_down(_q("macd"), _q("macd_signal")), "macd_histogram_increasing": t(_q("_h1") > 0), "macd_histogram_decreasing": t(_q("_h1") < 0),
        "is_bb_squeeze": t(_q("bb_std") < 0.8 * C.sma(_q("bb_std"), 20)), "above_bb_middle": C.greater(c, mid), "below_bb_middle": C.less(c, mid),
        "adx_rising": C.rising(adx), "adx_accelerating": C.double_rising(adx),
        "kf_above_smooth": t(_q("kf_price_deviation") > 0), "kf_below_smooth": t(_q("kf_price_deviation") < 0), "kf_above_trend": C.greater(c, trend), "kf_below_trend": C.less(c, trend),
        "kf_adx_above_25": t(kadx > 25), "kf_adx_above_40": t(kadx > 40), "kf_adx_below_20": t(kadx < 20), "kf_adx_increasing": C.rising(kadx), "kf_adx_decreasing": C.falling(kadx),
        "kf_adx_accelerating": t((_q("_dadx") > 0) & (_q("_dadx") > C.lag(_q("_dadx")))), "kf_adx_decelerating": t((_q("_dadx") < 0) & (_q("_dadx") < C.lag(_q("_dadx")))),
        "is_kf_adx_surprise": C.greater(_q("kf_adx_innovation_abs"), 1.5 * C.sma(_q("kf_adx_innovation_abs"), 20)),
        "kf_adx_trend_emerging": t((kadx > 20) & (C.lag(kadx, 5) < 20)), "kf_adx_trend_fading": t((kadx < 25) & (C.lag(kadx, 5) > 30)),
        "kf_c2c_dominance": C.greater(kc2c, 0.7 * katr),
        "kf_volatility_divergence": (C.rising(katr) & C.falling(kc2c)) | (C.falling(katr) & C.rising(kc2c)),
        "kf_momentum_increasing": C.rising(_q("_dkf")), "kf_momentum_decreasing": C.falling(_q("_dkf")), "kf_slope_increasing": C.rising(_q("_skf")), "kf_slope_decreasing": C.falling(_q("_skf")),
        "kf_trending_volatile": t(kadx > 25) & high, "kf_trending_quiet": t(kadx > 25) & quiet, "kf_ranging_volatile": t(kadx < 20) & high, "kf_ranging_quiet": t(kadx < 20) & quiet,
        "is_kf_strong_trend_low_vol": t((kadx > 35) & (_q("kf_atr_pct") < 0.012)),
        "is_kf_breakout_potential": C.rising(kadx) & t(_q("_datr") > 0), "is_kf_consolidation": C.falling(kadx) & t(_q("_datr") < 0),
        "kf_trending_c2c_volatile": t(kadx > 25) & c2c_high, "kf_trending_c2c_quiet": t(kadx > 25) & c2c_quiet,
        "is_kf_gap_trading_opportunity": gap & t(kadx < 25), "is_kf_smooth_trend": flow & t(kadx > 30),
        "kf_ema_aligned": t((kf > e9) & (e9 > s200)), "kf_ema_divergence": t((kf < trend) & (trend < e50)),
        "is_kf_positive_surprise": C.greater(inn, s_in), "is_kf_negative_surprise": C.less(inn, -s_in),
        "is_kf_innovation_large": C.greater(_q("kf_innovation_abs"), 1.5 * C.sma(_q("kf_innovation_abs"), 20)),
    }
    return out
