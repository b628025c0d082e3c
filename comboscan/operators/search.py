"""Search of AND-combinations over bars that stay in row blocks on executors.

Bars are packed into blocks of consecutive bars of a symbol: one bit a predicate and bar. A window of combination ranks is judged by
descending from shared prefixes: each prefix is ANDed once, all its extensions in one step, and a prefix that cannot
lead to a result is left with all its ranks by arithmetic. A symbol of one block is judged where it lies. For a symbol of more,
counts are summed over blocks first; those with enough trades then get a summary a block, and summaries combine in bar order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from math import comb
from time import perf_counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from comboscan.operators.combos import Capital, Predicate, total, unrank
from comboscan.session import materialize

#: Bars of a block: 421 predicates take 3.5 MB of bits, and a worker holds one block at a time.
BLOCK = 1 << 16
#: Ranks whose counts are summed over blocks in one row.
CHUNK = 1 << 16
#: Trades, padded, whose statistics are worked out at a time.
TILE = 1 << 20

RESULT = pa.schema([
    ("symbol", pa.string()), ("combo_id", pa.int64()), ("combination", pa.string()), ("depth", pa.int32()), ("mask_hits", pa.int64()), ("total_bars", pa.int64()),
    ("profitable_bars", pa.int64()), ("label_hits", pa.int64()), ("total_return", pa.float64()), ("max_drawdown", pa.float64()), ("calmar_ratio", pa.float64()),
    ("looked", pa.int64()), ("and_seconds", pa.float64()), ("stat_seconds", pa.float64()),
])
_SQL = {pa.string(): "string", pa.int32(): "int", pa.int64(): "long", pa.float64(): "double"}
SCHEMA = ", ".join(f"{f.name} {_SQL[f.type]}" for f in RESULT)


@dataclass
class Blocks:
    """Packed bars, the names of their predicates, and how many blocks the longest symbol has."""

    df: DataFrame
    names: list[str]
    deepest: int
    count: int


def pack(bars: DataFrame, names: list[str], target: str, reward: str | None = None, rpc: Column | None = None, rows: int | None = None) -> Blocks:
    """Packs prepared bars (symbol, bar_idx, a boolean for each name, the target's columns) into blocks of ``rows`` bars.

    A bar is a trade where it is eligible and its reward is finite. Flags travel as 64-bit words, so a bar is some bytes
    in the one exchange; a block is a group of at most ``rows`` bars. Bars that are not there have no flag.
    """
    rows = rows or BLOCK
    reward, n = reward or f"rr_{target}", len(names)
    width = -(-n // 64)
    bit = lambda i: F.when(F.col(f"`{names[i]}`").cast("boolean"), F.lit(1 << (i % 64) if i % 64 < 63 else -(1 << 63))).otherwise(F.lit(0))
    words = [reduce(Column.bitwiseOR, [bit(i) for i in range(64 * w, min(64 * w + 64, n))]).cast("long").alias(f"w{w}") for w in range(width)]
    elig = F.coalesce(F.col(f"{target}_eligible"), F.lit(True)) if f"{target}_eligible" in bars.columns else F.lit(True)
    exits = F.col(f"{target}_exit_i") if f"{target}_exit_i" in bars.columns else F.lit(None)
    src = bars.select(
        "symbol", F.floor(F.col("bar_idx") / rows).alias("block"), F.col("bar_idx").cast("long").alias("bar_idx"), *words, elig.alias("e"), F.coalesce(F.col(target).cast("boolean"), F.lit(False)).alias("y"),
        F.col(reward).cast("double").alias("r"), F.coalesce(exits.cast("long"), F.lit(-1)).alias("x"), (rpc if rpc is not None else F.lit(1.0)).cast("double").alias("c"),
    )

    def run(t: pa.Table) -> pa.Table:
        block = t["block"][0].as_py()
        at = t["bar_idx"].to_numpy() - block * rows
        size = -(-(int(at.max()) + 1) // 64) * 64

        def placed(values: np.ndarray, kind: str) -> np.ndarray:
            out = np.zeros(size, kind)
            out[at] = values
            return out

        r = t["r"].to_numpy()
        gate = placed(t["e"].to_numpy() & np.isfinite(r), bool)
        lanes = np.stack([placed(t[f"w{w}"].to_numpy(), "<i8") for w in range(width)], axis=1) if width else np.zeros((size, 0), "<i8")
        bits = np.unpackbits(np.ascontiguousarray(lanes).view(np.uint8).reshape(size, 8 * width), axis=1, count=n, bitorder="little") if n else np.zeros((size, 0), np.uint8)
        packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
        parts = [packed, np.packbits(gate, bitorder="little"), np.packbits(placed(t["y"].to_numpy(), bool), bitorder="little")]
        parts += [np.where(gate, placed(np.nan_to_num(r), "<f8"), 0.0), placed(t["x"].to_numpy(), "<i8"), placed(t["c"].to_numpy(), "<f8")]
        columns = [pa.array([t["symbol"][0].as_py()], pa.string()), pa.array([block]), pa.array([size])]
        return pa.Table.from_arrays([*columns, *(pa.array([p.tobytes()], pa.binary()) for p in parts)], ["symbol", "block", "size", "flags", "gate", "label", "reward", "exits", "rpc"])

    schema = "symbol string, block long, size long, flags binary, gate binary, label binary, reward binary, exits binary, rpc binary"
    df = materialize(src.groupBy("symbol", "block").applyInArrow(run, schema), "blocks")
    per = df.groupBy("symbol").count().agg(F.max("count"), F.sum("count")).first()
    return Blocks(df, names, per[0] or 0, per[1] or 0)


class Segment:
    """One block's arrays in a worker."""

    def __init__(self, row: dict, n: int, rows: int) -> None:
        self.base = row["block"] * rows
        words = row["size"] // 64
        self.masks = np.frombuffer(row["flags"], "<u8").reshape(n, words)
        self.gate = np.frombuffer(row["gate"], "<u8")
        self.label = np.unpackbits(np.frombuffer(row["label"], np.uint8), bitorder="little").astype(bool)
        self.reward, self.rpc = np.frombuffer(row["reward"], "<f8"), np.frombuffer(row["rpc"], "<f8")
        self.exits = np.frombuffer(row["exits"], "<i8")


@dataclass
class Rules:
    """What no combination may hold: two bounds of one kind, a dead pair (in more than two), or none of the required."""

    kind: np.ndarray
    must: np.ndarray
    dead: np.ndarray | None  # packed rows of a symmetric bit matrix

    def extensions(self, member: int, deep: bool) -> np.ndarray:
        """Which predicates may stand beside this one."""
        ok = (self.kind != self.kind[member]) | (self.kind < 0)
        if deep and self.dead is not None:
            ok &= ~np.unpackbits(self.dead[member], count=len(self.kind)).astype(bool)
        return ok


def descend(masks: np.ndarray, root: np.ndarray, depth: int, start: int, end: int, need: int, rules: Rules) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ranks, members, gated words, counts) of the combinations of ranks start to end - 1 with at least ``need`` common trades.

    A prefix is ANDed once. A prefix with too few trades, or with what the rules forbid, takes its whole interval of ranks with it.
    The last item is empty and tells, as its count, how many rows were ANDed.
    """
    n, looked = len(masks), 0
    low_required = np.flatnonzero(rules.must)

    def below(prefix: list[int], words: np.ndarray, ok: np.ndarray, low: int, left: int, base: int, have: bool):
        nonlocal looked
        top = n - left + 1
        if low >= top:
            return
        # ranks of the extensions by low, low + 1, ...: C(n - c - 1, left - 1) each
        if left == 1:
            a, b = max(low, low + start - base), min(top, low + end - base)
            if a >= b:
                return
            may = ok[a:b] if have or not len(low_required) else ok[a:b] & rules.must[a:b]
            at = np.flatnonzero(may) + a
            if not len(at):
                return
            kids = masks[at] & words
            looked += len(at)
            count = np.bitwise_count(kids).sum(axis=1, dtype=np.int64)
            good = np.flatnonzero(count >= need)
            if len(good):
                members = np.empty((len(good), len(prefix) + 1), np.int64)
                members[:, :-1] = prefix
                members[:, -1] = at[good]
                yield base + at[good] - low, members, kids[good], count[good]
            return
        sizes, at, first = [], [], base
        for c in range(low, top):
            size = comb(n - c - 1, left - 1)
            if first + size > start and first < end and ok[c]:
                at.append(c)
                sizes.append(first)
            first += size
            if first >= end:
                break
        if not at:
            return
        at = np.array(at)
        kids = masks[at] & words
        looked += len(at)
        alive = np.bitwise_count(kids).sum(axis=1, dtype=np.int64) >= need
        for i in np.flatnonzero(alive).tolist():
            c = int(at[i])
            has = have or bool(rules.must[c])
            if not has and len(low_required) and low_required[-1] <= c:
                continue
            yield from below([*prefix, c], kids[i], ok & rules.extensions(c, deep), c + 1, left - 1, sizes[i], has)

    for k in range(1, depth + 1):
        base = total(n, k - 1)
        deep = k > 2
        if base < end and base + comb(n, k) > start:
            yield from below([], root, np.ones(n, bool), 0, k, base, False)
    yield np.zeros(0, np.int64), np.zeros((0, 0), np.int64), np.zeros((0, 0), "<u8"), np.array([looked])


#: A block's summary of a combination's trades, or the state after the blocks before: sums, prefix extremes and worst falls, of rewards and of capital.
STATE = ("hits", "n", "wins", "label", "sum", "high", "low", "fall", "growth", "top", "bottom", "pct", "free", "cap")


def neutral(rows: int, capital: Capital | None) -> dict[str, np.ndarray]:
    zero, one = np.zeros(rows), np.ones(rows)
    start = capital.start if capital else 1.0
    return {**{k: zero.copy() for k in STATE}, "growth": one.copy(), "top": one.copy(), "bottom": one.copy(), "free": zero - 1, "cap": zero + start}


def judge(seg: Segment, words: np.ndarray, hits: np.ndarray, stacking: bool, capital: Capital | None, before: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """State of each row of gated words after this block, from the trades' places alone; rewards add to ``before`` in bar order."""
    s = before if before is not None else neutral(len(words), capital)
    out = {k: v.copy() for k, v in s.items()}
    out["hits"] = s["hits"] + hits
    count = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
    order, at = np.argsort(count, kind="stable"), 0
    while at < len(order):
        # rows of like counts together, so that little is padding
        to = at + 1
        while to < len(order) and (to - at + 1) * max(1, count[order[to]]) <= TILE and (to - at) < 4096:
            to += 1
        rows = order[at:to]
        got = _tile(seg, words[rows], count[rows], stacking, capital, {k: v[rows] for k, v in s.items()})
        for k, v in got.items():
            out[k][rows] = v
        at = to
    return out


def _tile(seg: Segment, words: np.ndarray, count: np.ndarray, stacking: bool, capital: Capital | None, s: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    most, rows = int(count.max(initial=0)), len(words)
    if not most:
        return {}
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(rows, -1), axis=1, bitorder="little")
    flat = np.flatnonzero(bits.view(bool).reshape(-1))
    row, bar = np.divmod(flat, bits.shape[1])
    column = np.arange(len(flat)) - np.repeat(np.cumsum(count) - count, count)
    place = np.full((rows, most), -1)
    place[row, column] = bar
    real = place >= 0
    out: dict[str, np.ndarray] = {}
    if not stacking:
        out["free"], real = _apart(seg, place, s["free"])
    at = np.where(real, place, 0)
    reward = np.where(real, seg.reward[at], 0.0)
    equity = np.cumsum(reward, axis=1)
    peak = np.maximum(np.maximum.accumulate(equity, axis=1), 0)
    high, low, fall = peak[:, -1], np.minimum(equity.min(axis=1), 0), (peak - equity).max(axis=1)
    out |= {
        "n": s["n"] + real.sum(axis=1), "wins": s["wins"] + (reward > 0).sum(axis=1), "label": s["label"] + (real & seg.label[at]).sum(axis=1), "sum": s["sum"] + equity[:, -1],
        "fall": np.maximum(np.maximum(s["fall"], fall), s["high"] - (s["sum"] + low)), "high": np.maximum(s["high"], s["sum"] + high), "low": np.minimum(s["low"], s["sum"] + low),
    }
    if capital is not None:
        out |= _contracts(seg, real, at, reward, capital, s) if capital.contracts else _fraction(reward, capital, s)
    return out


def _fraction(reward: np.ndarray, capital: Capital, s: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """A share of the running capital at risk: capital is a product, so its path combines as rewards do."""
    path = np.cumprod(1.0 + reward * capital.risk, axis=1)
    peak = np.maximum(np.maximum.accumulate(path, axis=1), 1.0)
    top, bottom, pct = peak[:, -1], np.minimum(path.min(axis=1), 1.0), ((peak - path) / peak).max(axis=1)
    ends = np.minimum(s["growth"] * bottom, s["growth"] * top)
    return {
        "pct": np.maximum(np.maximum(s["pct"], pct), 1.0 - ends / s["top"]), "top": np.maximum(s["top"], s["growth"] * np.where(s["growth"] > 0, top, bottom)),
        "bottom": np.minimum(s["bottom"], ends), "growth": s["growth"] * path[:, -1],
    }


def _contracts(seg: Segment, real: np.ndarray, at: np.ndarray, reward: np.ndarray, capital: Capital, s: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Whole contracts by the running capital, all rows' trades of one ordinal at a time."""
    cap, top, pct = s["cap"].copy(), np.maximum(s["top"], 1.0) * capital.start, s["pct"].copy()
    for j in range(at.shape[1]):
        risk = seg.rpc[at[:, j]]
        ok = real[:, j] & (risk > 0)
        n = np.maximum(np.floor(cap * capital.risk / np.where(ok, risk, 1.0)), capital.min_contracts)
        if capital.max_contracts:
            n = np.minimum(n, capital.max_contracts)
        if capital.margin:
            n = np.minimum(n, np.maximum(0.0, np.floor(cap / capital.margin)))
        cap = np.where(ok, cap + n * risk * reward[:, j], cap)
        top = np.maximum(top, cap)
        pct = np.maximum(pct, (top - cap) / top)
    return {"cap": cap, "top": top / capital.start, "pct": pct, "growth": cap / capital.start}


def _apart(seg: Segment, place: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bar each row is free again from, trades taken): greedily those that start when the one before is closed."""
    free, taken = free.copy(), np.zeros(place.shape, bool)
    for j in range(place.shape[1]):
        bar = place[:, j] + seg.base
        take = (place[:, j] >= 0) & (bar >= free)
        leave = seg.exits[np.maximum(place[:, j], 0)]
        free = np.where(take, np.where(leave >= bar, leave, bar + 1), free)
        taken[:, j] = take
    return free, taken


def calmar(growth: np.ndarray, pct: np.ndarray, capital: Capital | None) -> np.ndarray:
    """Yearly growth over the deepest fall, both in percent: infinite without a fall but with growth."""
    if capital is None:
        return np.zeros(len(growth))
    yearly = np.where(growth > 0, 100.0 * (np.power(np.where(growth > 0, growth, 1.0), 1.0 / capital.years) - 1), 100.0 * (growth - 1))
    deep = pct > 0
    return np.where(deep, yearly / np.where(deep, 100.0 * pct, 1.0), np.where(yearly > 0, np.inf, 0.0))


def members_of(ranks: np.ndarray, n: int, depth: int) -> list[np.ndarray]:
    """Arrays of members, one for each run of ranks of equal depth in order."""
    out: list[list[tuple[int, ...]]] = []
    for r in ranks.tolist():
        c = unrank(r, n, depth)
        if not out or len(out[-1][0]) != len(c):
            out.append([])
        out[-1].append(c)
    return [np.array(x) for x in out]


@dataclass
class Plan:
    """A window of ranks and what is asked of its combinations."""

    names: list[str]
    depth: int
    start: int
    end: int
    need: int
    stacking: bool
    capital: Capital | None
    rules: Rules
    rows: int
    parts: int
    dense: bool = False  # counts of whole intervals are kept

    def chunks(self, part: int) -> Iterator[tuple[int, int]]:
        """The rank intervals of a part; the parts take turns, as neighbouring ranks cost alike."""
        size = max(1, -(-(self.end - self.start) // (4 * self.parts)))
        size = min(CHUNK, size) if self.dense else size
        for i, a in enumerate(range(self.start, self.end, size)):
            if i % self.parts == part:
                yield a, min(self.end, a + size)

    def table(self, symbol: str, ranks: np.ndarray, members: np.ndarray, s: dict[str, np.ndarray]) -> pa.RecordBatch:
        ok = s["n"] >= self.need
        text = [" && ".join([self.names[x] for x in row]) for row in members[ok].tolist()]
        whole = [s[k][ok].astype(np.int64) for k in ("hits", "n", "wins", "label")]
        values = [[symbol] * len(text), ranks[ok], text, np.full(len(text), members.shape[1]), *whole, s["sum"][ok], s["fall"][ok], calmar(s["growth"][ok], s["pct"][ok], self.capital)]
        zero = np.zeros(len(text))
        return pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip([*values, zero.astype(np.int64), zero, zero], RESULT)], schema=RESULT)

    def marker(self, symbol: str, looked: int, ands: float, stats: float) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([symbol, *[None] * 10, looked, ands, stats], RESULT)], schema=RESULT)


def _all(masks: np.ndarray, members: np.ndarray) -> np.ndarray:
    out = masks[members[:, 0]]
    for j in range(1, members.shape[1]):
        out = out & masks[members[:, j]]
    return out


def _rows(chunks: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in chunks:
        for i in range(batch.num_rows):
            yield {f: batch.column(j)[i].as_py() for j, f in enumerate(batch.schema.names)}


def judge_whole(plan: Plan) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Judges a part of the window over a symbol that is one block."""

    def run(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(chunks):
            seg = Segment(row, len(plan.names), plan.rows)
            looked, stats, began = 0, 0.0, perf_counter()
            for a, b in plan.chunks(row["part"]):
                for ranks, members, words, count in descend(seg.masks, seg.gate, plan.depth, a, b, plan.need, plan.rules):
                    if not len(ranks):
                        looked += int(count[0])
                        continue
                    t = perf_counter()
                    hits = np.bitwise_count(_all(seg.masks, members)).sum(axis=1, dtype=np.int64)
                    yield plan.table(row["symbol"], ranks, members, judge(seg, words, hits, plan.stacking, plan.capital))
                    stats += perf_counter() - t
            yield plan.marker(row["symbol"], looked, perf_counter() - began - stats, stats)

    return run


def count_blocks(plan: Plan) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Trades of every combination of a part in one block, as packed counts for each interval of ranks."""

    def run(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(chunks):
            seg = Segment(row, len(plan.names), plan.rows)
            for a, b in plan.chunks(row["part"]):
                out, looked = np.zeros(b - a, "<i4"), 0
                for ranks, _, _, count in descend(seg.masks, seg.gate, plan.depth, a, b, 1, plan.rules):
                    if len(ranks):
                        out[ranks - a] = count
                    else:
                        looked = int(count[0])
                yield pa.RecordBatch.from_arrays([pa.array([row["symbol"]], pa.string()), pa.array([row["part"]], pa.int32()), pa.array([a]), pa.array([out.tobytes()], pa.binary()), pa.array([looked])], ["symbol", "part", "first", "counts", "looked"])

    return run


def add_counts(need: int) -> Callable[[Iterator[pa.Table]], pa.Table]:
    """Ranks with enough trades in all blocks together: one group holds one interval of ranks, a row a block."""

    def run(t: pa.Table) -> pa.Table:
        counts = sum(np.frombuffer(x.as_py(), "<i4").astype(np.int64) for x in t["counts"])
        ranks = np.flatnonzero(counts >= need) + t["first"][0].as_py()
        looked = sum(t["looked"].to_pylist())
        return pa.table({"symbol": [t["symbol"][0].as_py()], "part": pa.array([t["part"][0].as_py()], pa.int32()), "ranks": [ranks.astype("<i8").tobytes()], "looked": [looked]})

    return run


def summarise(plan: Plan) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A block's state of each surviving rank; with a ``state`` column (packed, of the blocks before) the state after it."""

    def run(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(chunks):
            ranks = np.frombuffer(row["ranks"], "<i8")
            if not len(ranks):
                continue
            seg, at = Segment(row, len(plan.names), plan.rows), 0
            before = np.frombuffer(row["state"], "<f8").reshape(len(STATE), -1) if row.get("state") else None
            parts = []
            for members in members_of(ranks, len(plan.names), plan.depth):
                for lo in range(0, len(members), 4096):
                    m = members[lo : lo + 4096]
                    raw = _all(seg.masks, m)
                    s = dict(zip(STATE, before[:, at : at + len(m)])) if before is not None else None
                    parts.append(judge(seg, raw & seg.gate, np.bitwise_count(raw).sum(axis=1, dtype=np.int64), plan.stacking, plan.capital, s))
                    at += len(m)
            state = np.stack([np.concatenate([p[k] for p in parts]) for k in STATE])
            yield pa.RecordBatch.from_arrays([pa.array([row["symbol"]], pa.string()), pa.array([row["part"]], pa.int32()), pa.array([row["block"]]), pa.array([row["ranks"]], pa.binary()), pa.array([state.astype("<f8").tobytes()], pa.binary())], ["symbol", "part", "block", "ranks", "state"])

    return run


def combine(left: dict[str, np.ndarray], right: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Summary of two stretches of bars, the left one first."""
    a, b = left, right
    ends = np.minimum(a["growth"] * b["bottom"], a["growth"] * b["top"])
    return {
        **{k: a[k] + b[k] for k in ("hits", "n", "wins", "label", "sum")},
        "fall": np.maximum(np.maximum(a["fall"], b["fall"]), a["high"] - (a["sum"] + b["low"])), "high": np.maximum(a["high"], a["sum"] + b["high"]), "low": np.minimum(a["low"], a["sum"] + b["low"]),
        "pct": np.maximum(np.maximum(a["pct"], b["pct"]), 1.0 - ends / a["top"]), "top": np.maximum(a["top"], np.where(a["growth"] > 0, a["growth"] * b["top"], a["growth"] * b["bottom"])),
        "bottom": np.minimum(a["bottom"], ends), "growth": a["growth"] * b["growth"], "free": b["free"], "cap": b["cap"],
    }


def finish(plan: Plan, merge: bool) -> Callable[[pa.Table], pa.Table]:
    """Result rows of one part of a symbol from its blocks' states, combined in bar order."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        states = [dict(zip(STATE, np.frombuffer(x.as_py(), "<f8").reshape(len(STATE), -1))) for x in t["state"]]
        s = reduce(combine, states) if merge else states[-1]
        ranks, at, out = np.frombuffer(t["ranks"][0].as_py(), "<i8"), 0, []
        for members in members_of(ranks, len(plan.names), plan.depth):
            part = slice(at, at + len(members))
            out.append(plan.table(t["symbol"][0].as_py(), ranks[part], members, {k: v[part] for k, v in s.items()}))
            at += len(members)
        return pa.Table.from_batches(out, RESULT)

    return run


def search(
    blocks: Blocks, preds: list[Predicate], depth: int, start: int = 0, end: int | None = None, stacking: bool = True, min_sample: int = 1,
    require_any: set[str] | None = None, dead: np.ndarray | None = None, capital: Capital | None = None, parts: int | None = None, profile: Observation | None = None,
) -> DataFrame:
    """(symbol, combo_id, combination, depth, statistics) of the sound combinations with enough trades in a range of ranks, each symbol by itself.

    calmar_ratio is that of the capital's path, 0 without ``capital``. ``dead`` is a bit matrix of pairs (``pair_bits``); combinations of
    more than two with such a pair are skipped. ``profile`` observes how many combinations were ANDed and the seconds spent.
    """
    n, spark = len(preds), blocks.df.sparkSession
    last = total(n, depth)
    end = last if end is None else min(end, last)
    if end >= 2**63:
        raise ValueError("more combinations than 64-bit ranks; give an end")
    names = [p.name for p in preds]
    if unknown := (require_any or set()) - set(names):
        raise ValueError(f"unknown required features: {sorted(unknown)}")
    bounds = [p.bound() for p in preds]
    kinds = {b: i for i, b in enumerate(dict.fromkeys(bounds))}
    rules = Rules(np.array([-1 if b is None else kinds[b] for b in bounds], np.int64), np.array([x in (require_any or set()) for x in names], bool), dead)
    cores = spark.sparkContext.defaultParallelism
    parts = parts or max(1, -(-4 * cores // max(1, blocks.count)))
    plan = Plan(names, depth, start, max(start, end), max(1, min_sample), stacking, capital, rules, BLOCK, parts, blocks.deepest > 1)
    units = blocks.df.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(max(1, blocks.count * parts))
    out = units
    if blocks.deepest > 1:
        long = blocks.df.groupBy("symbol").count().where("count > 1").select("symbol")
        out = units.join(long, "symbol", "left_anti").mapInArrow(judge_whole(plan), SCHEMA).unionByName(_over_blocks(units.join(long, "symbol", "left_semi"), plan, blocks.deepest))
    else:
        out = units.mapInArrow(judge_whole(plan), SCHEMA)
    if profile is not None:
        out = out.observe(profile, F.sum("looked").alias("looked"), F.sum("and_seconds").alias("and_seconds"), F.sum("stat_seconds").alias("stat_seconds"), F.count("combination").alias("kept"))
    return out.where("combination is not null").drop("looked", "and_seconds", "stat_seconds")


def _over_blocks(units: DataFrame, plan: Plan, deepest: int) -> DataFrame:
    """Results of symbols of several blocks: counts summed, then states of the survivors, combined or carried in bar order."""
    counts = units.mapInArrow(count_blocks(plan), "symbol string, part int, first long, counts binary, looked long")
    alive = counts.groupBy("symbol", "first").applyInArrow(add_counts(plan.need), "symbol string, part int, ranks binary, looked long")
    alive = materialize(alive, "survivors")
    kept = alive.where(F.length("ranks") > 0).select("symbol", "part", "ranks").withColumn("first", F.hex(F.substring("ranks", 1, 8)))
    state = "symbol string, part int, block long, ranks binary, state binary"
    if plan.stacking and not (plan.capital and plan.capital.contracts):
        states = units.join(kept, ["symbol", "part"]).mapInArrow(summarise(plan), state)
        states, merge = materialize(states, "states"), True
    else:
        # what a trade may do hangs on the bars before: states are carried from block to block
        ids = units.groupBy("symbol").agg(F.array_sort(F.collect_set("block")).alias("ids"))
        states = kept.select("symbol", "part", "ranks", F.lit(None).cast("binary").alias("state"))
        units = units.join(ids, "symbol").withColumn("ordinal", F.array_position("ids", F.col("block"))).drop("ids")
        done = []
        for k in range(1, deepest + 1):
            # symbols with fewer blocks have no row in this step: their last state is already among the done
            stepped = units.where(F.col("ordinal") == k).join(states, ["symbol", "part"]).mapInArrow(summarise(plan), state)
            done.append(materialize(stepped, "states"))
            states = done[-1].select("symbol", "part", "ranks", "state")
        states, merge = reduce(DataFrame.unionByName, done), False
    found = states.withColumn("first", F.hex(F.substring("ranks", 1, 8))).groupBy("symbol", "part", "first").applyInArrow(finish(plan, merge), SCHEMA)
    zero = [F.lit(None).cast(_SQL[f.type]).alias(f.name) for f in list(RESULT)[1:11]]
    return found.unionByName(alive.select("symbol", *zero, "looked", F.lit(0.0).alias("and_seconds"), F.lit(0.0).alias("stat_seconds")))


def pair_counts(blocks: Blocks) -> DataFrame:
    """(symbol, counts): common trades of every pair of predicates as a packed matrix, summed over blocks."""
    n = len(blocks.names)

    def one(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(chunks):
            seg = Segment(row, n, BLOCK)
            gated = seg.masks & seg.gate
            out = np.zeros((n, n), "<i4")
            for i in range(n):
                out[i, i:] = np.bitwise_count(gated[i:] & gated[i]).sum(axis=1, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([row["symbol"]], pa.string()), pa.array([out.tobytes()], pa.binary())], ["symbol", "counts"])

    def add(t: pa.Table) -> pa.Table:
        total_ = sum(np.frombuffer(x.as_py(), "<i4").astype(np.int64) for x in t["counts"])
        return pa.table({"symbol": [t["symbol"][0].as_py()], "counts": [total_.astype("<i8").tobytes()]})

    return blocks.df.mapInArrow(one, "symbol string, counts binary").groupBy("symbol").applyInArrow(add, "symbol string, counts binary")


def dead_pairs(blocks: Blocks, min_sample: int) -> DataFrame:
    """(i, bits): for each predicate the later ones with which it has fewer than ``min_sample`` common trades in every symbol, as packed bits."""
    n = len(blocks.names)

    def few(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(chunks):
            c = np.frombuffer(row["counts"], "<i8").reshape(n, n)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array([np.packbits(c[i, i + 1 :] < min_sample).tobytes() for i in range(n)], pa.binary())], ["i", "bits"])

    def both(t: pa.Table) -> pa.Table:
        bits = reduce(np.bitwise_and, [np.frombuffer(x.as_py(), np.uint8) for x in t["bits"]])
        return pa.table({"i": [t["i"][0].as_py()], "bits": pa.array([bits.tobytes()], pa.binary())})

    return pair_counts(blocks).mapInArrow(few, "i long, bits binary").groupBy("i").applyInArrow(both, "i long, bits binary")


def pair_bits(rows: DataFrame, n: int) -> np.ndarray:
    """The symmetric bit matrix of ``dead_pairs``, rows packed: n * n / 8 bytes, which tasks get with their plan."""
    out = np.zeros((n, n), bool)
    for r in rows.collect():
        out[r["i"], r["i"] + 1 :] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=n - r["i"] - 1)
    return np.packbits(out | out.T, axis=1)
