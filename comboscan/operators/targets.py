"""Outcome labels: next-bar targets by lead, stop / take-profit brackets by a bounded range join or a descent over block extremes.

Each gives <t>, rr_<t>, <t>_eligible, <t>_exit_i (bar_idx), and the _long / _short sides for two-sided targets.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comboscan.functions import cols as C
from comboscan.session import materialize

TINY = 1e-9


def next_bar(bars: DataFrame, name: str = "next_bar_up") -> DataFrame:
    """next_bar_up (also next_bar_color_and_wicks) or next_bar_down: +-1 R by the next bar's colour. The last bar of a symbol has no
    trade: ineligible, no reward, exit -1."""
    if name not in ("next_bar_up", "next_bar_down", "next_bar_color_and_wicks"):
        raise ValueError(f"unknown target {name!r}; there are next_bar_up, next_bar_down and next_bar_color_and_wicks")
    nxt = lambda c: F.lead(C.num(c)).over(C.over())
    there = nxt("close").isNotNull() & nxt("open").isNotNull()
    hit = C.true(nxt("close") < nxt("open") if name == "next_bar_down" else nxt("close") > nxt("open"))
    return bars.withColumns({
        name: hit, f"rr_{name}": F.when(there, F.when(hit, 1.0).otherwise(-1.0)),
        f"{name}_eligible": there, f"{name}_exit_i": F.when(there, F.col("bar_idx") + 1).otherwise(F.lit(-1)).cast("long"),
    })


def next_bar_with_stop(bars: DataFrame, distance: str, name: str, tick: float | None = None, multiple: float = 1.5) -> DataFrame:
    """Trade of the next bar from its open to its close, stopped at ``multiple`` x a distance column known at the signal
    bar (ticks round the stop up). A label needs a move its way without a stop."""
    nxt = lambda c: F.lead(C.num(c)).over(C.over())
    o, h, low, c = (nxt(x) for x in ("open", "high", "low", "close"))
    d = C.tick_distance(C.num(distance) * multiple, tick)
    ok = (d > 0) & o.isNotNull() & c.isNotNull()
    long_stop, short_stop = low <= o - d, h >= o + d
    rr = lambda stopped, move: F.when(C.true(ok), F.when(C.true(stopped), F.lit(-1.0)).otherwise(move / F.when(d > 0, d)))
    exit_i = F.when(C.true(ok), F.col("bar_idx") + 1).cast("long")
    out = bars.withColumns({
        f"{name}_long": C.true(ok & ~C.true(long_stop) & (c > o)), f"{name}_short": C.true(ok & ~C.true(short_stop) & (c < o)),
        "rr_long": rr(long_stop, c - o), "rr_short": rr(short_stop, o - c), f"{name}_exit_i": exit_i,
    })
    return out.withColumns({name: F.col(f"{name}_long"), f"rr_{name}": F.col("rr_long"), f"{name}_eligible": F.col("rr_long").isNotNull()})


@dataclass(frozen=True)
class Bracket:
    stop: str  # wide, highlow, atr or tightest
    atr_multiple: float | None = None
    risk_multiple: float | None = None
    min_rr: float | None = None


#: The bracket of each target name.
BRACKETS = {
    "highlow_or_atr": Bracket("wide", atr_multiple=2.0),
    "highlow_1r": Bracket("highlow", risk_multiple=1.0),
    "2x_atr_tp_atr_stop": Bracket("atr", atr_multiple=2.0),
    "3x_atr_tp_atr_stop": Bracket("atr", atr_multiple=3.0),
    "atr_tp_atr_stop": Bracket("atr", atr_multiple=1.0),
    "highlow_sl_2x_atr_tp_rr_gt_1": Bracket("highlow", atr_multiple=2.0, min_rr=1.0),
    "highlow_sl_1x_atr_tp_rr_gt_1": Bracket("highlow", atr_multiple=1.0, min_rr=1.0),
    "highlow_or_atr_tightest_stop": Bracket("tightest", atr_multiple=2.0),
}
#: The distance column of the next-bar targets with a stop.
STOPPED = {"next_bar_color_and_wicks": "wicks_diff_sma14", "wicks_kf": "kf_wicks_smooth"}
ALIASES = {"atr_stop": "2x_atr_tp_atr_stop", "highlow_or_atr_tighest_stop": "highlow_or_atr_tightest_stop"}


def levels(bars: DataFrame, b: Bracket, tick: float | None = None) -> DataFrame:
    """(symbol, entry_idx, side, entry, stop, tp, risk) of each bar that opens a trade: long at the close of a green bar, short of a red."""
    o, h, low, c, a = (C.num(x) for x in ("open", "high", "low", "close", "atr"))
    body = c - o
    side = F.when(body > C.EPS, 1).when(body < -C.EPS, -1)
    far, near = F.when(side == 1, low).otherwise(h), F.when(side == 1, c - a).otherwise(c + a)
    lo, hi = F.least(far, near), F.greatest(far, near)
    both = far.isNotNull() & near.isNotNull()
    # the tightest stop is the closer one that still lies behind the entry
    tight = F.when(side == 1, F.when((far < c) & (near < c), hi).when(far < c, far).otherwise(near)).otherwise(F.when((far > c) & (near > c), lo).when(far > c, far).otherwise(near))
    raw = {"highlow": far, "atr": near, "wide": F.when(both, F.when(side == 1, lo).otherwise(hi)), "tightest": F.when(both, tight)}[b.stop]
    stop = F.when(side == 1, C.tick_price(raw, tick, "floor")).otherwise(C.tick_price(raw, tick, "ceil"))
    df = bars.select("symbol", F.col("bar_idx").alias("entry_idx"), side.alias("side"), c.alias("entry"), stop.alias("stop"), a.alias("_a")).where("side is not null")
    df = df.withColumn("risk", (F.col("entry") - F.col("stop")) * F.col("side")).where(F.col("risk") > TINY)
    reach = F.lit(b.atr_multiple) * F.col("_a") if b.atr_multiple is not None else F.lit(b.risk_multiple) * F.col("risk")
    tp = F.col("entry") + F.col("side") * reach
    df = df.withColumn("tp", F.when(F.col("side") == 1, C.tick_price(tp, tick, "ceil")).otherwise(C.tick_price(tp, tick, "floor"))).where("tp is not null")
    if b.min_rr is not None:
        df = df.where((F.col("tp") - F.col("entry")) * F.col("side") / F.col("risk") > b.min_rr)
    return df.drop("_a")


def resolve_join(signals: DataFrame, bars: DataFrame, horizon: int) -> DataFrame:
    """First touch within ``horizon`` bars by a bucketed range join: (symbol, entry_idx, side, rr, hit, exit_idx).

    Every signal meets at most horizon + 1 bars, so the work is linear in signals; use resolve() where trades may last to the end.
    """
    b = bars.select("symbol", F.col("bar_idx").alias("j"), *[C.num(x).alias(x[0]) for x in ("open", "high", "low", "close")])
    b = b.withColumn("bucket", F.floor(F.col("j") / horizon))
    s = signals.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("entry_idx") + 1) / horizon), F.floor((F.col("entry_idx") + horizon) / horizon))))
    j = s.join(b, ["symbol", "bucket"]).where((F.col("j") > F.col("entry_idx")) & (F.col("j") <= F.col("entry_idx") + horizon))
    d, o, stop, tp = F.col("side"), F.col("o"), F.col("stop"), F.col("tp")
    worst, best = F.when(d == 1, F.col("l")).otherwise(F.col("h")), F.when(d == 1, F.col("h")).otherwise(F.col("l"))
    rr_open = (o - F.col("entry")) * d / F.col("risk")
    hit = F.when((o - stop) * d <= 0, F.struct(rr_open.alias("rr"), F.lit(False).alias("hit"))).when((o - tp) * d >= 0, F.struct(rr_open.alias("rr"), F.lit(True).alias("hit")))
    hit = hit.when((worst - stop) * d <= 0, F.struct(F.lit(-1.0).alias("rr"), F.lit(False).alias("hit")))
    hit = hit.when((best - tp) * d >= 0, F.struct(((tp - F.col("entry")) * d / F.col("risk")).alias("rr"), F.lit(True).alias("hit")))
    touched = j.withColumn("t", hit).where("t is not null")
    first = touched.groupBy("symbol", "entry_idx", "side").agg(F.min_by("t", "j").alias("t"), F.min("j").alias("exit_idx"))
    return first.select("symbol", "entry_idx", "side", "t.rr", "t.hit", "exit_idx")


def first_touch(o, h, low, c, entry_idx: int, side: int, entry: float, stop: float, tp: float, last: int, force: bool) -> tuple[float, bool, int]:
    """(rr, hit, exit row) from the bar after entry to ``last``: gaps fill at the open, the stop wins within a bar; (nan, False, -1) if open."""
    risk = (entry - stop) * side
    a, b = entry_idx + 1, last + 1
    oo, hh, ll = o[a:b], h[a:b], low[a:b]
    worst, best = (ll, hh) if side == 1 else (hh, ll)
    with np.errstate(invalid="ignore"):
        seen = np.isfinite(hh) & np.isfinite(ll)
        gs, gt, st, tt = (oo - stop) * side <= 0, (oo - tp) * side >= 0, (worst - stop) * side <= 0, (best - tp) * side >= 0
    any_ = seen & (gs | gt | st | tt)
    if any_.any():
        k = int(any_.argmax())
        if gs[k] or gt[k]:
            return (oo[k] - entry) * side / risk, bool(not gs[k]), a + k
        return (-1.0, False, a + k) if st[k] else ((tp - entry) * side / risk, True, a + k)
    if force and last > entry_idx and np.isfinite(c[last]):
        return (c[last] - entry) * side / risk, False, last
    return np.nan, False, -1


#: Bars (or blocks) whose extremes a block holds: a search reads at most two blocks of each level.
FAN = 128


def block_levels(bars: DataFrame, fan: int) -> list[DataFrame]:
    """(symbol, node, kids) of every level: bars by blocks of ``fan``, those by blocks of ``fan``, up to one block a symbol.

    A kid has its pos and the lowest and highest price it reaches, open included; a bar without high or low reaches none. Kids of
    level 0 also have their prices.
    """
    o, h, low = (C.num(x) for x in ("open", "high", "low"))
    seen = h.isNotNull() & low.isNotNull()
    items = bars.select("symbol", F.col("bar_idx").alias("pos"), F.when(seen, F.least(low, o)).alias("lo"), F.when(seen, F.greatest(h, o)).alias("hi"), o.alias("o"), h.alias("h"), low.alias("l"))
    last, out = bars.agg(F.max("bar_idx")).first()[0] or 0, []
    while True:
        kids = F.array_sort(F.collect_list(F.struct("pos", *[c for c in items.columns if c not in ("symbol", "pos")])))
        nodes = materialize(items.groupBy("symbol", F.floor(F.col("pos") / fan).alias("node")).agg(kids.alias("kids")), "touch_blocks")
        out.append(nodes)
        if last < fan:
            return out
        last //= fan
        items = nodes.select("symbol", F.col("node").alias("pos"), F.array_min("kids.lo").alias("lo"), F.array_max("kids.hi").alias("hi"))


def first_touches(signals: DataFrame, bars: DataFrame, fan: int | None = None) -> DataFrame:
    """Signals and ``x`` (pos, o, h, l): the first later bar that reaches the stop or the target; null where none does.

    A signal climbs from its own block until a block holds a later touch, then descends to the bar: as many equi-joins as levels up
    and one less down, each on (symbol, block). No symbol is gathered, and a signal reads O(log bars) blocks.
    """
    levels = block_levels(bars, fan := fan or FAN)
    names = signals.columns
    down, up = (F.when(F.col("side") == 1, F.col(a)).otherwise(F.col(b)) for a, b in (("stop", "tp"), ("tp", "stop")))
    rows = signals.withColumns({"_down": down, "_up": up, "_at": F.col("entry_idx")})

    def look(df: DataFrame, level: int, block: Column, after: Column) -> DataFrame:
        nodes = levels[level].select(F.col("symbol").alias("_s"), "node", "kids")
        df = df.join(nodes, (F.col("symbol") == F.col("_s")) & (block == F.col("node")), "left")
        touch = lambda k: (k["pos"] > after) & ((k["lo"] <= F.col("_down")) | (k["hi"] >= F.col("_up")))
        return df.withColumn("x", F.get(F.filter("kids", touch), F.lit(0))).drop("_s", "node", "kids")

    found: list[DataFrame] = []
    for level in range(len(levels)):
        met = materialize(look(rows, level, F.floor(F.col("_at") / fan), F.col("_at")), "touch")
        found.append(met.where("x is not null"))
        rows = met.where("x is null").drop("x").withColumn("_at", F.floor(F.col("_at") / fan))
    for level in range(len(levels) - 1, 0, -1):
        inside = found[level].withColumn("_at", F.col("x.pos")).drop("x")
        found[level - 1] = found[level - 1].unionByName(look(inside, level - 1, F.col("_at"), F.lit(-1)))
    return found[0].select(*names, "x").unionByName(rows.select(*names).withColumn("x", F.lit(None).cast(found[0].schema["x"].dataType)))


def resolve(signals: DataFrame, bars: DataFrame, cutoff: int | Column | None = None) -> DataFrame:
    """Same columns as ``resolve_join``, to the end of each symbol's bars: gaps fill at the open, the stop wins within a bar.

    With a cutoff (a bar_idx, or a condition on bars whose last true bar it is) trades opened up to it are closed there at the
    latest, at that bar's close; one opened on that bar, or without such a close, is none. Later trades run to the end.
    """
    t = first_touches(signals, bars)
    d, entry, risk = F.col("side"), F.col("entry"), (F.col("entry") - F.col("stop")) * F.col("side")
    o, worst = F.col("x.o"), F.when(d == 1, F.col("x.l")).otherwise(F.col("x.h"))
    gap_stop, gap_tp = C.true((o - F.col("stop")) * d <= 0), C.true((o - F.col("tp")) * d >= 0)
    stopped = C.true((worst - F.col("stop")) * d <= 0)
    rr = F.when(gap_stop | gap_tp, (o - entry) * d / risk).when(stopped, F.lit(-1.0)).otherwise((F.col("tp") - entry) * d / risk)
    hit = F.when(gap_stop | gap_tp, ~gap_stop).otherwise(~stopped)
    done = F.col("x").isNotNull()
    out = t.select("symbol", "entry_idx", "side", F.when(done, F.struct(rr.alias("rr"), hit.alias("hit"), F.col("x.pos").alias("exit_idx"))).alias("r"), "entry", risk.alias("risk"))
    if cutoff is not None:
        inside = F.col("bar_idx") <= cutoff if isinstance(cutoff, int) else cutoff
        last = bars.where(inside).groupBy("symbol").agg(F.max_by(F.struct("bar_idx", C.num("close").alias("close")), "bar_idx").alias("cut"))
        out = out.join(last, "symbol", "left")
        idx, close = F.col("cut.bar_idx"), F.col("cut.close")
        late = (F.col("entry_idx") <= idx) & (F.col("r").isNull() | (F.col("r.exit_idx") > idx))
        forced = F.when((idx > F.col("entry_idx")) & close.isNotNull(), F.struct(((close - F.col("entry")) * d / F.col("risk")).alias("rr"), F.lit(False).alias("hit"), idx.alias("exit_idx")))
        out = out.withColumn("r", F.when(C.true(late), forced).otherwise(F.col("r")))
    return out.where("r.rr is not null").select("symbol", "entry_idx", "side", "r.rr", "r.hit", "r.exit_idx")


def with_bracket(bars: DataFrame, name: str, direction: str = "both", tick: float | None = None, horizon: int | None = None, cutoff: int | Column | None = None) -> DataFrame:
    """Bars with a bracket target's columns; for both directions <t> is the long side. ``bars`` needs an ``atr`` column."""
    name = ALIASES.get(name, name)
    signals = levels(bars, BRACKETS[name], tick)
    if direction != "both":
        signals = signals.where(F.col("side") == (1 if direction == "long" else -1))
    done = resolve_join(signals, bars, horizon) if horizon else resolve(signals, bars, cutoff)
    done = done.withColumnRenamed("entry_idx", "bar_idx")
    lo, sh = F.col("side") == 1, F.col("side") == -1
    sel = done.select("symbol", "bar_idx", F.when(lo, F.col("rr")).alias("rr_long"), F.when(sh, F.col("rr")).alias("rr_short"), (F.col("hit") & lo).alias("_l"), (F.col("hit") & sh).alias("_s"),
                      F.when(lo, F.col("exit_idx")).alias("_xl"), F.when(sh, F.col("exit_idx")).alias("_xs"))
    df = bars.drop("rr_long", "rr_short").join(sel, ["symbol", "bar_idx"], "left")
    main = "short" if direction == "short" else "long"
    both = {f"{name}_long": C.true(F.col("_l")), f"{name}_short": C.true(F.col("_s")), f"{name}_exit_i_long": F.col("_xl"), f"{name}_exit_i_short": F.col("_xs"),
            f"{name}_eligible_long": F.col("rr_long").isNotNull(), f"{name}_eligible_short": F.col("rr_short").isNotNull()}
    df = df.withColumns(both).drop("_l", "_s", "_xl", "_xs")
    return df.withColumns({name: F.col(f"{name}_{main}"), f"rr_{name}": F.col(f"rr_{main}"), f"{name}_exit_i": F.col(f"{name}_exit_i_{main}"), f"{name}_eligible": F.col(f"{name}_eligible_{main}")})


def period_index(ts: Column, period: str) -> Column:
    """Trading week (from Sunday 22:00 UTC, not below 0) or calendar month."""
    if period == "weekly":
        return F.greatest(F.lit(0), F.floor((F.unix_timestamp(ts) - F.lit(338400)) / 604800)).cast("long")
    if period == "monthly":
        return (F.year(ts) * 12 + F.month(ts) - 1).cast("long")
    raise ValueError(f"unknown period {period!r}")


def tribar_4h_2atr(bars: DataFrame, per_week: int = 2) -> DataFrame:
    """Long at the close of a three-bar reversal above the smoothed price: stop min(low, entry - ATR), target entry + 2 ATR, closed at the
    week's last bar, at most ``per_week`` a week and one at a time; the entry bar itself is scanned too. Weeks are independent, as
    no trade outlives one. Needs is_tribar, kf_smooth, atr and ts; meant for four-hour bars."""
    name = "tribar_4h_2atr"
    src = bars.select("symbol", "bar_idx", period_index(F.col("ts"), "weekly").alias("week"), *[C.num(x).alias(x) for x in ("open", "high", "low", "close", "atr")],
                      (F.col("is_tribar") & C.true(C.num("close") > C.num("kf_smooth"))).alias("sig"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_idx").reset_index(drop=True)
        o, h, low, c, a, wk = (pdf[k].to_numpy() for k in ("open", "high", "low", "close", "atr", "week"))
        last = {w: i for i, w in enumerate(wk)}
        out, count, free = [], {}, 0
        for i in np.flatnonzero(pdf["sig"].to_numpy(bool)):
            if i < free or count.get(wk[i], 0) >= per_week or not np.isfinite(a[i]):
                continue
            stop, tp = min(low[i], c[i] - a[i]), c[i] + 2 * a[i]
            if not stop < c[i]:
                continue
            end = last[wk[i]]
            if h[i] >= tp and low[i] > stop:
                rr, hit, j = (tp - c[i]) / (c[i] - stop), True, i
            elif low[i] <= stop:
                rr, hit, j = -1.0, False, i
            else:
                rr, hit, j = first_touch(o, h, low, c, i, 1, c[i], stop, tp, end, True)
            if np.isfinite(rr):
                out.append((pdf["symbol"][i], int(pdf["bar_idx"][i]), float(rr), bool(hit), int(pdf["bar_idx"][j])))
                count[wk[i]] = count.get(wk[i], 0) + 1
                free = j + 1
        return pd.DataFrame(out, columns=["symbol", "bar_idx", "rr", "hit", "x"])

    done = src.groupBy("symbol", "week").applyInPandas(run, "symbol string, bar_idx long, rr double, hit boolean, x long")
    df = bars.join(done, ["symbol", "bar_idx"], "left")
    return df.withColumns({name: C.true(F.col("hit")), f"rr_{name}": F.col("rr"), f"{name}_exit_i": F.col("x"), f"{name}_eligible": F.col("rr").isNotNull()}).drop("rr", "hit", "x")
