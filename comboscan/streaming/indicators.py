"""Indicators of a live stream of bars: each symbol keeps the levels of its recurrences, and bars are taken in the order of their time."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EMAS = (9, 12, 20, 26, 50, 200)
#: The noise of the filter of closes.
LEVEL_NOISE, PRICE_NOISE = 0.01, 0.1
COLUMNS = [*(f"ema{p}" for p in EMAS), "macd", "macd_signal", "macd_hist", "atr", "kf_smooth", "kf_innovation"]
OUTPUT = "symbol string, ts timestamp, close double, " + ", ".join(f"{c} double" for c in COLUMNS)
#: What a symbol keeps: bars seen, the close before, sums that seed the means, and the levels.
LEVELS = ["n", "before", *(f"sum{p}" for p in EMAS), *(f"ema{p}" for p in EMAS), "lines", "signal_sum", "signal", "atr", "kf", "kf_var"]


def step(s: dict[str, float], o: float, h: float, low: float, c: float) -> dict[str, float]:
    """One bar's indicators; moves the levels on. The same columns as the batch gives, without a value before the first price there is."""
    s["n"] += 1
    out = {}
    for p in EMAS:
        k = 2.0 / (p + 1)
        if s["n"] <= p:
            s[f"sum{p}"] += c
            s[f"ema{p}"] = s[f"sum{p}"] / p if s["n"] == p else math.nan
        else:
            s[f"ema{p}"] = k * c + (1 - k) * s[f"ema{p}"]
        out[f"ema{p}"] = s[f"ema{p}"]
    line = s["ema12"] - s["ema26"]
    if s["lines"] or math.isfinite(line):
        s["lines"] += 1
        if s["lines"] <= 9:
            s["signal_sum"] += line
            s["signal"] = s["signal_sum"] / 9 if s["lines"] == 9 else math.nan
        else:
            s["signal"] = 0.2 * line + (1 - 0.2) * s["signal"]
    out |= {"macd": line, "macd_signal": s["signal"], "macd_hist": line - s["signal"]}
    tr = float(np.fmax(h - low, np.fmax(abs(h - s["before"]), abs(low - s["before"]))))
    if math.isfinite(tr):
        s["atr"] = tr if not math.isfinite(s["atr"]) else tr / 14.0 + (1 - 1 / 14.0) * s["atr"]
    s["before"] = c
    s["kf_var"] += LEVEL_NOISE
    out["kf_innovation"] = 0.0
    if math.isfinite(c):
        s["kf"] = c if not math.isfinite(s["kf"]) else s["kf"]
        gain = s["kf_var"] / (s["kf_var"] + PRICE_NOISE)
        out["kf_innovation"] = c - s["kf"]
        s["kf"] += gain * out["kf_innovation"]
        s["kf_var"] *= 1 - gain
    return out | {"atr": s["atr"], "kf_smooth": s["kf"]}


def fresh() -> dict[str, float]:
    none = {"before", "signal", "atr", "kf", *(f"ema{p}" for p in EMAS)}
    return {k: math.nan if k in none else 1.0 if k == "kf_var" else 0.0 for k in LEVELS}


class Indicators(StatefulProcessor):
    """Bars wait by their time until the watermark has passed them; then they move the levels on, the earliest first."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.levels = handle.getValueState("levels", ", ".join(f"{k} double" for k in LEVELS))
        self.waiting = handle.getMapState("waiting", "at long", "open double, high double, low double, close double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            at = pdf["ts"].to_numpy("datetime64[us]").astype(np.int64)
            price = [pdf[k].to_numpy(float) for k in ("open", "high", "low", "close")]
            for t, *bar in zip(at.tolist(), *(x.tolist() for x in price)):
                self.waiting.updateValue((t,), tuple(bar))
                self.handle.registerTimer(-(-t // 1000))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = sorted((k[0], tuple(bar)) for k, bar in self.waiting.iterator() if -(-k[0] // 1000) <= expiredTimerInfo.getExpiryTimeInMs())
        if not due:
            return iter([])
        s = dict(zip(LEVELS, self.levels.get())) if self.levels.exists() else fresh()
        out = []
        for t, bar in due:
            bar = [math.nan if x is None else x for x in bar]
            out.append({"symbol": key[0], "ts": pd.Timestamp(t, unit="us"), "close": bar[3], **step(s, *bar)})
            self.waiting.removeKey((t,))
        self.levels.update(tuple(float(s[k]) for k in LEVELS))
        return iter([pd.DataFrame(out)[["symbol", "ts", "close", *COLUMNS]]])

    def close(self) -> None:
        pass


def streaming_indicators(bars: DataFrame, late: str = "2 hours") -> DataFrame:
    """(symbol, ts, close, COLUMNS) of a stream of bars (symbol, ts, open, high, low, close), once the watermark has passed each.

    The values are those of the batch columns over the same bars, however the stream is split and in whatever order bars come within
    ``late``; later ones are dropped. Of two bars of one symbol and time the last to come counts. The session needs the RocksDB state
    store (``spark.sql.streaming.stateStore.providerClass``).
    """
    src = bars.select("symbol", "ts", "open", "high", "low", "close").withWatermark("ts", late)
    return src.groupBy("symbol").transformWithStateInPandas(Indicators(), OUTPUT, "Append", "EventTime")
