"""Recurrences of one series by an associative scan over blocks of bars, so that no group holds a whole symbol.

Every recurrence is a map of the state before a bar: affine for the smoothed means and filter levels, a Möbius map for a filter's
variance. Maps of neighbouring bars compose, so a block is told by one map. Passes alternate: blocks give their maps, a fold over
a symbol's blocks gives each the state it starts from, and the next pass goes on from there.

    pass 1  means and ranges of prices, variances of all filters
    pass 2  filters of prices and ranges, the index of directional movement, the signal line
    pass 3  the filter of that index
    pass 4  all columns

Results equal those of the plain loops in ``kernels`` but for rounding.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comboscan.operators import kernels as N
from comboscan.session import materialize

#: Bars of a block; at least as many as the longest mean is seeded with.
BLOCK = 1 << 15
#: Bars before a block that its first moves are measured from.
HALO = 16
NAN = np.nan
EMAS, RSIS = (9, 12, 20, 26, 50, 200), (7, 14, 21)
#: The noise of each filter's level and of its observations.
FILTERS = {"smooth": (0.01, 0.1), "trend": (0.001, 0.5), "wicks": (0.01, 0.1), "adx": (0.005, 0.2), "atr": (0.01, 0.15), "c2c": (0.01, 0.15)}


def compose(a1, c1, a2, c2):
    """x -> a2 (a1 x + c1) + c2; a map with a2 = 0 forgets what was before, missing values too."""
    return a1 * a2, np.where(a2 == 0, 0.0, a2 * c1) + c2


@dataclass
class Affine:
    """x -> a x + c from each bar's predecessor, scanned; ``seeded`` is the scan that starts without a state."""

    a: np.ndarray
    c: np.ndarray
    seeded: np.ndarray | None = None

    @classmethod
    def scan(cls, a: np.ndarray, c: np.ndarray, seeded: np.ndarray | None = None) -> Affine:
        a, c = a.astype(float), c.astype(float)
        step = 1
        while step < len(a):
            c[step:], a[step:] = (lambda n: (n[1], n[0]))(compose(a[:-step].copy(), c[:-step].copy(), a[step:].copy(), c[step:].copy()))
            step *= 2
        return cls(a, c, seeded)

    def run(self, x: float) -> np.ndarray:
        if np.isnan(x) and self.seeded is not None:
            return self.seeded
        return np.where(self.a == 0, 0.0, self.a * x) + self.c

    def before(self, x: float) -> np.ndarray:
        """The state before each bar."""
        return np.concatenate([[x], self.run(x)[:-1]])

    def end(self) -> list[float]:
        return [self.a[-1], self.c[-1], NAN if self.seeded is None else self.seeded[-1]]


def ema(v: np.ndarray, p: int, at: int) -> Affine:
    """Seeded at bar p - 1 with the mean of the first p, which lie in one block; a missing input ends it."""
    k = 2.0 / (p + 1)
    a, c = np.full(len(v), 1 - k), k * v
    if at == 0:
        a[:p], c[: p - 1] = 0.0, NAN
        if len(v) >= p:
            c[p - 1] = v[:p].mean()
    return Affine.scan(a, c)


def rma(v: np.ndarray, p: int) -> Affine:
    """Seeded with the first value there is; a missing input repeats the last result."""
    there, k = np.isfinite(v), 1.0 / p
    a, c = np.where(there, 1 - k, 1.0), np.where(there, k * v, 0.0)
    seeded = np.full(len(v), NAN)
    if there.any():
        i = int(there.argmax())
        b, d = a[i:].copy(), c[i:].copy()
        b[0], d[0] = 0.0, v[i]
        seeded[i:] = Affine.scan(b, d).c
    return Affine.scan(a, c, seeded)


def close_range(move: np.ndarray, at: int, p: int = 14) -> Affine:
    """``move`` starts HALO bars before the block; a mean of the last p there are starts anew after a missing one."""
    there = np.isfinite(move)
    n = np.convolve(there, np.ones(p), "full")[: len(move)]
    total = np.zeros(len(move))
    for lag in range(p):
        total[lag:] += np.where(there, move, 0.0)[: len(move) - lag]
    mean = np.where(n > 0, total / np.where(n > 0, n, 1), NAN)
    k, own = 2.0 / (p + 1), slice(HALO, None)
    smooth = (there & (np.concatenate([[0], n[:-1]]) > 0))[own] & (np.arange(len(move) - HALO) + at >= p)
    return Affine.scan(np.where(smooth, 1 - k, 0.0), np.where(smooth, k * np.where(there, move, 0.0)[own], mean[own]))


def variance(there: np.ndarray, q: float, r: float) -> np.ndarray:
    """Matrices (bars x 2 x 2) of the maps from the variance before the block to that after each bar, scaled."""
    m = np.empty((len(there), 2, 2))
    m[:, 0, 0], m[:, 0, 1], m[:, 1, 0], m[:, 1, 1] = (np.where(there, x, y) for x, y in ((r, 1.0), (q * r, q), (1.0, 0.0), (q + r, 1.0)))
    step = 1
    while step < len(m):
        m[step:] = m[step:] @ m[:-step].copy()
        m /= m.max(axis=(1, 2), keepdims=True)
        step *= 2
    return m


def level(v: np.ndarray, maps: np.ndarray, p: float, q: float, r: float) -> Affine:
    """The filter's level, given the variance before the block."""
    after = (maps[:, 0, 0] * p + maps[:, 0, 1]) / (maps[:, 1, 0] * p + maps[:, 1, 1])
    prior = np.concatenate([[p], after[:-1]]) + q
    there = np.isfinite(v)
    k = np.where(there, prior / (prior + r), 0.0)
    return Affine.scan(1 - k, np.where(there, k * np.where(there, v, 0.0), 0.0))


def first(v: np.ndarray) -> float:
    there = np.isfinite(v)
    return float(v[there.argmax()]) if there.any() else NAN


@dataclass
class Stretch:
    """One block's prices, with HALO bars before them (missing before the first bar), and what follows from them alone."""

    o: np.ndarray
    h: np.ndarray
    low: np.ndarray
    c: np.ndarray
    at: int
    affine: dict[str, Affine] = field(default_factory=dict)

    def __post_init__(self) -> None:
        own, last = slice(HALO, None), slice(HALO - 1, -1)
        o, h, low, c, before = self.o[own], self.h[own], self.low[own], self.c[own], self.c[last]
        start = self.at == 0
        tr = np.fmax(h - low, np.fmax(np.abs(h - before), np.abs(low - before)))
        up, down = h - self.h[last], self.low[last] - low
        d = c - before
        zeroed = tr.copy()
        if start:
            up[:1], down[:1], zeroed[:1] = 0.0, 0.0, 0.0
        plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
        move = np.concatenate([[NAN], np.abs(np.diff(self.c))])
        self.wick = np.where(c > o, o - low, h - o)
        a = self.affine
        a |= {f"ema{p}": ema(c, p, self.at) for p in EMAS}
        a |= {"atr": rma(tr, 14), "range": rma(zeroed, 14), "plus": rma(plus, 14), "minus": rma(minus, 14), "c2c": close_range(move, self.at)}
        for p in RSIS:
            a |= {f"gain{p}": rma(np.where(np.isnan(d), NAN, np.maximum(d, 0)), p), f"loss{p}": rma(np.where(np.isnan(d), NAN, np.maximum(-d, 0)), p)}
        # which ranges there are can be told without their values: all from the first on, and where one of the last moves is
        self.tr, self.moves = tr, move
        self.close = c

    def maps(self, seen: bool) -> dict[str, np.ndarray]:
        """Variance maps of all filters; ``seen``: an earlier block has a true range."""
        there = {k: np.isfinite(self.close) for k in ("smooth", "trend")} | {"wicks": np.isfinite(self.wick), "adx": np.ones(len(self.close), bool)}
        there["atr"] = np.ones(len(self.close), bool) if seen else np.logical_or.accumulate(np.isfinite(self.tr))
        near = np.convolve(np.isfinite(self.moves), np.ones(14), "full")[HALO : len(self.moves)]
        return {k: variance((there | {"c2c": near > 0})[k], *FILTERS[k]) for k in FILTERS}


def _pack(parts: dict[str, list[float]]) -> dict[str, list[float]]:
    return {k: [float(x) for x in v] for k, v in parts.items()}


def first_pass(s: Stretch, _: dict) -> dict[str, list[float]]:
    out = {k: f.end() for k, f in s.affine.items()}
    # the filter of the range skips what lies before the first range: both maps, as a block cannot know
    for seen in (False, True):
        out |= {f"var_{k}{'_seen' if seen else ''}": m[-1].ravel() for k, m in s.maps(seen).items() if k == "atr" or not seen}
    moves = s.moves[HALO:]
    return _pack(out | {"first_smooth": [first(s.close)], "first_wicks": [first(s.wick)], "first_atr": [first(s.tr)], "first_c2c": [first(moves)]})


def _stage_two(s: Stretch, x: dict) -> tuple[dict[str, np.ndarray], dict[str, Affine]]:
    """(finished series, next affine maps) from the states of pass 1."""
    v = {k: f.run(x[k]) for k, f in s.affine.items()}
    plus, minus = N._share(v["plus"], v["range"]) * 100, N._share(v["minus"], v["range"]) * 100
    dx = N._share(np.abs(plus - minus), plus + minus) * 100
    line = v["ema12"] - v["ema26"]
    nxt = {"adx": rma(np.where(np.isfinite(dx), dx, 0.0), 14)}
    begin = int(np.isfinite(line).argmax()) if s.at == 0 and np.isfinite(line).any() else 0
    signal = ema(line[begin:], 9, s.at)
    nxt["signal"] = Affine(np.concatenate([np.zeros(begin), signal.a]), np.concatenate([np.full(begin, NAN), signal.c]))
    if s.at == 0 and not np.isfinite(line).any():
        nxt["signal"] = Affine(np.zeros(len(line)), np.full(len(line), NAN))
    maps = s.maps(bool(np.isfinite(x["atr"])))
    for k, series in (("smooth", s.close), ("trend", s.close), ("wicks", s.wick), ("atr", v["atr"]), ("c2c", v["c2c"])):
        nxt[f"kf_{k}"] = level(series, maps[k], x[f"var_{k}"], *FILTERS[k])
    return v | {"line": line, "maps_adx": maps["adx"]}, nxt


def second_pass(s: Stretch, x: dict) -> dict[str, list[float]]:
    return _pack({k: f.end() for k, f in _stage_two(s, x)[1].items()})


def third_pass(s: Stretch, x: dict) -> dict[str, list[float]]:
    v, nxt = _stage_two(s, x)
    return _pack({"kf_adx": level(nxt["adx"].run(x["adx"]), v["maps_adx"], x["var_adx"], *FILTERS["adx"]).end()})


def columns(s: Stretch, x: dict) -> dict[str, np.ndarray]:
    """All recursive columns of a block."""
    v, nxt = _stage_two(s, x)
    adx = nxt["adx"].run(x["adx"])
    nxt["kf_adx"] = level(adx, v["maps_adx"], x["var_adx"], *FILTERS["adx"])
    at = {k: nxt[f"kf_{k}"].run(x[f"kf_{k}"]) for k in FILTERS}
    surprise = lambda k, series: np.where(np.isfinite(series), series - nxt[f"kf_{k}"].before(x[f"kf_{k}"]), 0.0)
    out = {f"ema{p}": v[f"ema{p}"] for p in EMAS}
    for p in RSIS:
        none = v[f"loss{p}"] == 0
        out[f"rsi_{p}"] = np.where(none, 100.0, 100 - 100 / (1 + v[f"gain{p}"] / np.where(none, 1.0, v[f"loss{p}"])))
    signal = nxt["signal"].run(x["signal"])
    out |= {"macd": v["line"], "macd_signal": signal, "macd_hist": v["line"] - signal, "atr": v["atr"], "atr_c2c": v["c2c"], "adx": adx}
    out |= {"kf_smooth": at["smooth"], "kf_innovation": surprise("smooth", s.close), "kf_trend": at["trend"], "kf_adx": at["adx"], "kf_adx_innovation": surprise("adx", adx)}
    return out | {"kf_atr": at["atr"], "kf_atr_innovation": surprise("atr", v["atr"]), "kf_atr_c2c": at["c2c"], "kf_atr_c2c_innovation": surprise("c2c", v["c2c"]), "kf_wicks_smooth": at["wicks"]}


def carry(summaries: list[dict[str, list[float]]], known: list[dict[str, float]]) -> list[dict[str, float]]:
    """The state before each block from the maps of those before it; ``known`` are states of earlier passes."""
    out, state = [], {}
    firsts = {k[6:]: next((s[k][0] for s in summaries if not np.isnan(s[k][0])), NAN) for k in (summaries[0] if summaries else {}) if k.startswith("first_")}
    for s, old in zip(summaries, known):
        now = dict(old)
        for k, v in s.items():
            if k.startswith("var_"):
                now.setdefault(k, state.get(k, 1.0)) if not k.endswith("_seen") else None
            elif not k.startswith("first_"):
                now[k] = state.get(k, _seed(k, old))
        out.append(now | {f"seed_{k}": v for k, v in firsts.items()})
        for k, v in s.items():
            if k.startswith("var_") and not k.endswith("_seen"):
                m = s["var_atr_seen"] if k == "var_atr" and np.isfinite(now["atr"]) else v
                state[k] = (m[0] * now[k] + m[1]) / (m[2] * now[k] + m[3])
            elif not k.startswith(("first_", "var_")):
                a, c, seeded = v
                x = now[k]
                state[k] = seeded if np.isnan(x) and not np.isnan(seeded) else (0.0 if a == 0 else a * x) + c
    return out


def _seed(name: str, known: dict[str, float]) -> float:
    """The state before the first bar: a filter starts at the first value there is, 0 without any; means have none."""
    if not name.startswith("kf_"):
        return NAN
    seed = {"kf_trend": known.get("seed_smooth"), "kf_adx": 0.0}.get(name, known.get(f"seed_{name[3:]}"))
    return 0.0 if seed is None or np.isnan(seed) else seed


def _stretch(t: pa.Table, rows: int) -> tuple[Stretch, pa.Table] | None:
    """A group's block, and its own rows in order; None for a group of bars that only precede one."""
    t = t.sort_by("bar_idx")
    own = t.filter(t["own"])
    if not own.num_rows:
        return None
    halo = t.num_rows - own.num_rows
    pad = lambda k: np.concatenate([np.full(HALO - halo, NAN), t[k].to_numpy()])
    return Stretch(*(pad(k) for k in ("_o", "_h", "_l", "_c")), at=own["block"][0].as_py() * rows), own


def with_recursive_blocks(bars: DataFrame, rows: int | None = None) -> DataFrame:
    """All recursive columns of (symbol, bar_idx from 0 without gaps, open, high, low, close, ...); missing values are NaN."""
    size = rows or BLOCK
    if size < max(EMAS):
        raise ValueError(f"a block holds at least {max(EMAS)} bars")
    price = lambda c, n: F.coalesce(F.col(c).cast("double"), F.lit(NAN)).alias(n)
    block, near = F.floor(F.col("bar_idx") / size), F.col("bar_idx") % size >= size - HALO
    of = F.explode(F.when(near, F.array(block, block + 1)).otherwise(F.array(block))).alias("block")
    dealt = lambda df: df.select(*df.columns, of, block.alias("_home")).withColumn("own", F.col("block") == F.col("_home")).drop("_home")
    slim = dealt(bars.select("symbol", "bar_idx", *[price(c, n) for c, n in (("open", "_o"), ("high", "_h"), ("low", "_l"), ("close", "_c"))]))

    def told(give: Callable[[Stretch, dict], dict[str, list[float]]]):
        def run(t: pa.Table, known: pa.Table | None) -> pa.Table:
            got = _stretch(t, size)
            empty = pa.table({"symbol": pa.array([], pa.string()), "block": pa.array([], pa.int64()), "known": pa.array([], pa.map_(pa.string(), pa.float64())), "told": pa.array([], pa.map_(pa.string(), pa.list_(pa.float64())))})
            if got is None:
                return empty
            x = dict(known["known"][0].as_py()) if known is not None and known.num_rows else {}
            with np.errstate(all="ignore"):
                maps = list(give(got[0], x).items())
            row = {"symbol": got[1]["symbol"][0].as_py(), "block": got[1]["block"][0].as_py(), "known": list(x.items()), "told": maps}
            return pa.Table.from_pylist([row], empty.schema)

        return run

    def folded(t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        states = carry([dict(x) for x in t["told"].to_pylist()], [dict(x) for x in t["known"].to_pylist()])
        kind = pa.map_(pa.string(), pa.float64())
        return pa.table({"symbol": t["symbol"], "block": t["block"], "known": pa.array([list(s.items()) for s in states], kind)})

    schema = "symbol string, block long, known map<string,double>, told map<string,array<double>>"
    fold = lambda df: materialize(df.groupBy("symbol").applyInArrow(folded, "symbol string, block long, known map<string,double>"), "scan")
    meet = lambda df, states, f, out: df.groupBy("symbol", "block").cogroup(states.select(F.col("symbol").alias("_s"), F.col("block").alias("_b"), "known").groupBy("_s", "_b")).applyInArrow(f, out)
    begin = told(first_pass)
    states = fold(slim.groupBy("symbol", "block").applyInArrow(lambda t: begin(t, None), schema))
    for give in (second_pass, third_pass):
        states = fold(meet(slim, states, told(give), schema))

    def last(t: pa.Table, known: pa.Table) -> pa.Table:
        got = _stretch(t, size)
        own = got[1] if got else t.slice(0, 0)
        with np.errstate(all="ignore"):
            made = columns(got[0], dict(known["known"][0].as_py())) if got else {k: np.zeros(0) for k in N.RECURSIVE}
        kept = own.drop_columns(["_o", "_h", "_l", "_c", "block", "own"])
        return pa.Table.from_arrays([*kept.columns, *(pa.array(made[k]) for k in N.RECURSIVE)], [*kept.column_names, *N.RECURSIVE])

    wide = dealt(bars.select(*[f"`{c}`" for c in bars.columns], *[price(c, n) for c, n in (("open", "_o"), ("high", "_h"), ("low", "_l"), ("close", "_c"))]))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema) + "".join(f", {c} double" for c in N.RECURSIVE)
    return meet(wide, states, last, out)
