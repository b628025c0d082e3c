"""Stop / take-profit backtest with per-period trade caps: trades close with their period, so each (symbol, period) is a group."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comboscan.functions import cols as C
from comboscan.operators.kernels import with_recursive
from comboscan.operators.targets import period_index

SCHEMA = "symbol string, direction string, entry_idx long, exit_idx long, entry_price double, exit_price double, rr double, period long, stop_price double, tp_price double"


@dataclass(frozen=True)
class Plan:
    entry: str
    period: str = "weekly"
    tp_multiple: float = 2.0
    per_period: int = 2
    stop_after_win: bool = False
    direction: str = "both"
    trend_filter: bool = False


def simulate(pdf: pd.DataFrame, side: int, per_period: int, stop_after_win: bool) -> list[tuple]:
    """Trades of one side of one symbol: entered at the close, the stop first within a bar, closed at the period's last bar; the next
    candidate lies after the exit. Bars without prices are passed over."""
    h, low, c = (pdf[k].to_numpy(float) for k in ("high", "low", "close"))
    name = "long" if side == 1 else "short"
    stop, tp, sig, period, idx = (pdf[k].to_numpy() for k in (f"stop_{name}", f"tp_{name}", f"entry_{name}", "period", "bar_idx"))
    last = {p: i for i, p in enumerate(period)}
    used: dict[int, int] = {}
    won: dict[int, int] = {}
    out, i = [], 0
    while i < len(c):
        p = period[i]
        e, s, t = c[i], stop[i], tp[i]
        ok = sig[i] and used.get(p, 0) < per_period and not (stop_after_win and won.get(p))
        if not (ok and np.isfinite([e, s, t]).all() and (e - s) * side > 1e-9 and (t - e) * side > 0):
            i += 1
            continue
        end, price, at = last[p], e, i
        for j in range(i + 1, end + 1):
            if not np.isfinite([h[j], low[j], c[j]]).all():
                continue
            worst, best = (low[j], h[j]) if side == 1 else (h[j], low[j])
            if (worst - s) * side <= 0:
                price, at = s, j
                break
            if (best - t) * side >= 0:
                price, at = t, j
                break
            price, at = c[j], j
        rr = (price - e) / (e - s)
        used[p] = used.get(p, 0) + 1
        won[p] = won.get(p, 0) + (rr > 0)
        out.append((pdf["symbol"].iloc[0], name, int(idx[i]), int(idx[at]), float(e), float(price), float(rr), int(p), float(s), float(t)))
        i = at + 1
    return out


def backtest(bars: DataFrame, plan: Plan) -> DataFrame:
    """One row per trade of both sides, for (symbol, ts, bar_idx, prices and whatever columns the entry expression names).

    Stops are the tightest of the bar's extreme and one ATR that lie behind the entry; the target is a multiple of the ATR away."""
    df = bars if "atr" in bars.columns else with_recursive(bars)
    c, low, h, a = (C.num(x) for x in ("close", "low", "high", "atr"))
    sig = C.parse_entry(plan.entry, df.columns)
    trend = C.sma(c, 200)
    up, down = (C.true(c > trend), C.true(c < trend)) if plan.trend_filter else (F.lit(True), F.lit(True))
    tight = lambda far, near, pick, ok: F.when(ok(far) & ok(near), pick(far, near)).when(ok(far), far).when(ok(near), near)
    df = df.select(
        "symbol", "bar_idx", *[C.num(x).alias(x) for x in ("high", "low", "close")], period_index(F.col("ts"), plan.period).alias("period"),
        (sig & up & F.lit(plan.direction != "short")).alias("entry_long"), (sig & down & F.lit(plan.direction != "long")).alias("entry_short"),
        tight(low, c - a, F.greatest, lambda x: x < c).alias("stop_long"), tight(h, c + a, F.least, lambda x: x > c).alias("stop_short"),
        (c + plan.tp_multiple * a).alias("tp_long"), (c - plan.tp_multiple * a).alias("tp_short"),
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_idx").reset_index(drop=True)
        rows = simulate(pdf, 1, plan.per_period, plan.stop_after_win) + simulate(pdf, -1, plan.per_period, plan.stop_after_win)
        return pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    return df.groupBy("symbol", "period").applyInPandas(run, SCHEMA)


def summary(trades: DataFrame) -> DataFrame:
    return trades.groupBy("direction").agg(
        F.count(F.lit(1)).alias("trades"), F.count_if(F.col("rr") > 0).alias("wins"), F.count_if(F.col("rr") < 0).alias("losses"),
        F.avg("rr").alias("avg_rr"), F.max("rr").alias("best_rr"), F.min("rr").alias("worst_rr"),
    )

