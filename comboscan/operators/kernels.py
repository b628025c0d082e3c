"""Recurrences that no window frame expresses, as plain loops over one series.

A symbol of at most one block of bars is computed in one pass; longer ones by the scans over blocks of ``scans``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAN = np.nan


def ema(v: np.ndarray, p: int) -> np.ndarray:
    """alpha = 2 / (p + 1), seeded at row p - 1 with the mean of the first p; a missing input ends it."""
    out = np.full(len(v), NAN)
    if len(v) < p:
        return out
    a, x = 2.0 / (p + 1), float(np.mean(v[:p]))
    out[p - 1] = x
    for i in range(p, len(v)):
        x = a * v[i] + (1 - a) * x
        out[i] = x
    return out


def rma(v: np.ndarray, p: int) -> np.ndarray:
    """alpha = 1 / p, seeded with the first value there is; a missing input repeats the last result."""
    out, x, a = np.full(len(v), NAN), NAN, 1.0 / p
    for i, y in enumerate(v):
        if np.isfinite(y):
            x = y if not np.isfinite(x) else a * y + (1 - a) * x
        out[i] = x
    return out


def true_range(h: np.ndarray, low: np.ndarray, c: np.ndarray) -> np.ndarray:
    before = np.concatenate([[NAN], c[:-1]])
    return np.fmax(h - low, np.fmax(np.abs(h - before), np.abs(low - before)))


def atr(h, low, c, p: int = 14) -> np.ndarray:
    return rma(true_range(h, low, c), p)


def atr_close(c: np.ndarray, p: int = 14) -> np.ndarray:
    """Close-to-close range: the mean of what there is among the last p moves, from row p on smoothed by 2 / (p + 1)."""
    move = np.concatenate([[NAN], np.abs(np.diff(c))])
    out = np.full(len(c), NAN)
    for i in range(min(p, len(c))):
        seen = move[: i + 1][np.isfinite(move[: i + 1])]
        out[i] = seen.mean() if len(seen) else NAN
    a = 2.0 / (p + 1)
    for i in range(p, len(c)):
        if np.isfinite(move[i]) and np.isfinite(out[i - 1]):
            out[i] = a * move[i] + (1 - a) * out[i - 1]
        else:
            seen = move[i + 1 - p : i + 1][np.isfinite(move[i + 1 - p : i + 1])]
            out[i] = seen.mean() if len(seen) else NAN
    return out


def _share(n: np.ndarray, d: np.ndarray) -> np.ndarray:
    small = np.abs(d) < np.finfo(float).eps
    return np.where(small, 0.0, n / np.where(small, 1.0, d))


def adx(h, low, c, p: int = 14) -> np.ndarray:
    up, down = np.diff(h, prepend=h[:1]), -np.diff(low, prepend=low[:1])
    plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    tr = true_range(h, low, c)
    tr[:1] = 0.0
    r = rma(tr, p)
    a, b = _share(rma(plus, p), r) * 100, _share(rma(minus, p), r) * 100
    dx = _share(np.abs(a - b), a + b) * 100
    return rma(np.where(np.isfinite(dx), dx, 0.0), p)


def rsi(c: np.ndarray, p: int) -> np.ndarray:
    d = np.concatenate([[NAN], np.diff(c)])
    gain, loss = rma(np.where(np.isnan(d), NAN, np.maximum(d, 0)), p), rma(np.where(np.isnan(d), NAN, np.maximum(-d, 0)), p)
    none = loss == 0
    return np.where(none, 100.0, 100 - 100 / (1 + gain / np.where(none, 1.0, loss)))


def macd(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    line = ema(c, 12) - ema(c, 26)
    signal = np.full(len(c), NAN)
    first = np.flatnonzero(np.isfinite(line))
    if len(first):
        signal[first[0] :] = ema(line[first[0] :], 9)
    return line, signal, line - signal


def kalman(v: np.ndarray, q: float, r: float) -> tuple[np.ndarray, np.ndarray]:
    """(level, innovation) of a scalar filter that starts at the first value with variance 1; a missing value carries the level."""
    seen = v[np.isfinite(v)]
    x, p = (float(seen[0]) if len(seen) else 0.0), 1.0
    level, innovation = np.empty(len(v)), np.zeros(len(v))
    for i, y in enumerate(v):
        p += q
        if np.isfinite(y):
            k = p / (p + r)
            innovation[i] = y - x
            x += k * innovation[i]
            p *= 1 - k
        level[i] = x
    return level, innovation


RECURSIVE = (
    "ema9 ema12 ema20 ema26 ema50 ema200 rsi_7 rsi_14 rsi_21 macd macd_signal macd_hist atr atr_c2c adx kf_smooth kf_innovation kf_trend "
    "kf_adx kf_adx_innovation kf_atr kf_atr_innovation kf_atr_c2c kf_atr_c2c_innovation kf_wicks_smooth"
).split()


def recursive_columns(o, h, low, c) -> dict[str, np.ndarray]:
    out = {f"ema{p}": ema(c, p) for p in (9, 12, 20, 26, 50, 200)} | {f"rsi_{p}": rsi(c, p) for p in (7, 14, 21)}
    out["macd"], out["macd_signal"], out["macd_hist"] = macd(c)
    out["atr"], out["atr_c2c"], out["adx"] = atr(h, low, c), atr_close(c), adx(h, low, c)
    out["kf_smooth"], out["kf_innovation"] = kalman(c, 0.01, 0.1)
    out["kf_trend"] = kalman(c, 0.001, 0.5)[0]
    out["kf_adx"], out["kf_adx_innovation"] = kalman(out["adx"], 0.005, 0.2)
    out["kf_atr"], out["kf_atr_innovation"] = kalman(out["atr"], 0.01, 0.15)
    out["kf_atr_c2c"], out["kf_atr_c2c_innovation"] = kalman(out["atr_c2c"], 0.01, 0.15)
    out["kf_wicks_smooth"] = kalman(np.where(c > o, o - low, h - o), 0.01, 0.1)[0]
    return out


def with_recursive(bars: DataFrame) -> DataFrame:
    """Adds all recursive columns to (symbol, bar_idx, open, high, low, close, ...); missing values are NULL.

    No group holds more than ``scans.BLOCK`` bars: longer symbols are told apart by their last bar_idx and scanned in blocks.
    """
    from comboscan.functions.cols import num
    from comboscan.operators import scans

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_idx", kind="stable")
        with np.errstate(all="ignore"):
            cols = recursive_columns(*(pdf[k].to_numpy(float) for k in ("open", "high", "low", "close")))
        return pd.concat([pdf.reset_index(drop=True), pd.DataFrame(cols)], axis=1)

    if (bars.agg(F.max("bar_idx")).first()[0] or 0) >= scans.BLOCK:
        out = scans.with_recursive_blocks(bars)
    else:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema) + "".join(f", {c} double" for c in RECURSIVE)
        out = bars.groupBy("symbol").applyInPandas(run, schema)
    return out.withColumns({c: num(c) for c in RECURSIVE})
