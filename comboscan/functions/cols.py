"""Column functions. A missing number is NULL inside the engine; a comparison with one is false."""

from __future__ import annotations

import re

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16
TIE = 1e-10


def num(c: Column | str) -> Column:
    """A double whose NaN and infinities are NULL."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def over(p: int | None = None, symbol: str = "symbol", order: str = "bar_idx"):
    w = Window.partitionBy(symbol).orderBy(order)
    return w if p is None else w.rowsBetween(-(p - 1), 0)


def lag(c: Column, k: int = 1) -> Column:
    return F.lag(c, k).over(over())


def sma(c: Column, p: int) -> Column:
    """Mean of the last p values, all of which must be there."""
    return F.when(F.count(c).over(over(p)) == p, F.avg(c).over(over(p)))


def rolling_std(c: Column, p: int) -> Column:
    """Sample deviation of the last p values, all of which must be there; 0 for p = 1."""
    s = F.lit(0.0) if p == 1 else F.stddev_samp(c).over(over(p))
    return F.when(F.count(c).over(over(p)) == p, s)


def rolling_cv(c: Column, p: int) -> Column:
    return ratio(rolling_std(c, p), sma(c, p))


def rolling_min(c: Column, p: int) -> Column:
    """Least of the values there are among the last p rows; none before p rows."""
    return F.when(F.row_number().over(over()) >= p, F.min(c).over(over(p)))


def rolling_sum(flag: Column, p: int) -> Column:
    return F.when(F.row_number().over(over()) >= p, F.sum(flag.cast("double")).over(over(p)))


def streak(flag: Column, p: int) -> Column:
    return true(rolling_sum(true(flag), p) == p)


def lag_flag(flag: Column, k: int = 1) -> Column:
    return F.lag(flag, k, False).over(over())


def momentum(c: Column, p: int) -> Column:
    """Change over p rows; 0 while there is no earlier row."""
    return F.when(F.row_number().over(over()) <= p, F.lit(0.0)).otherwise(c - lag(c, p))


derivative = momentum


def roc(c: Column, p: int) -> Column:
    before = lag(c, p)
    return F.when(F.abs(before) >= EPS, c / before - 1)


def ratio(n: Column, d: Column, eps: float = EPS) -> Column:
    """n / d; 0 where d is about zero, missing where either is."""
    return F.when(n.isNotNull() & d.isNotNull(), F.when(F.abs(d) < eps, F.lit(0.0)).otherwise(n / F.when(F.abs(d) >= eps, d)))


def deviation(v: Column, r: Column) -> Column:
    return ratio(v - r, r)


def greater(a: Column, b: Column | float) -> Column:
    return true(a > b + F.lit(TIE))


def less(a: Column, b: Column | float) -> Column:
    return true(a < b - F.lit(TIE))


def cross_up(a: Column, b: Column) -> Column:
    return true((lag(a) <= lag(b)) & (a > b))


def cross_down(a: Column, b: Column) -> Column:
    return true((lag(a) >= lag(b)) & (a < b))


def recovery(c: Column, level: float, up: bool) -> Column:
    return true((lag(c) < level) & (c > level) if up else (lag(c) > level) & (c < level))


def rising(c: Column) -> Column:
    return true(c > lag(c))


def falling(c: Column) -> Column:
    return true(c < lag(c))


def double_rising(c: Column) -> Column:
    return true((c > lag(c)) & (lag(c) > lag(c, 2)))


def tick_price(p: Column, tick: float | None, mode: str) -> Column:
    """A price on the tick grid: nearest, floor or ceil; unchanged without a tick."""
    if not tick:
        return p
    steps = {"nearest": F.round, "floor": F.floor, "ceil": F.ceil}[mode](p / F.lit(tick))
    return steps.cast("double") * tick


def tick_distance(d: Column, tick: float | None, mode: str = "ceil") -> Column:
    """A distance on the tick grid, at least one tick unless it is zero."""
    if not tick:
        return d
    return F.when(d == 0, F.lit(0.0)).otherwise(F.greatest(tick_price(d, tick, mode), F.lit(tick)))


_OPS = {">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b}


def compare(a: Column, op: str, b: Column | float) -> Column:
    """A predicate over numbers; false where either is missing."""
    return true(_OPS[op](num(a), num(b) if isinstance(b, Column) else F.lit(float(b))))


def parse_entry(text: str, columns: list[str]) -> Column:
    """``flag && base > 1.5 && base <= other`` as a predicate; == and != compare with a tolerance of 1e-10.

    Unknown columns and malformed terms are errors; a term with an unknown operator makes the whole false.
    """
    out = F.lit(True)
    for term in (t.strip() for t in text.split("&&")):
        parts = term.split()
        if len(parts) == 1 and parts[0] in columns:
            out = out & true(F.col(f"`{parts[0]}`").cast("boolean"))
            continue
        if len(parts) != 3 or parts[0] not in columns:
            raise ValueError(f"cannot read the entry term {term!r}")
        left, op, right = parts
        is_number = re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", right)
        if not is_number and right not in columns:
            raise ValueError(f"cannot read the entry term {term!r}")
        a, b = num(F.col(f"`{left}`")), F.lit(float(right)) if is_number else num(F.col(f"`{right}`"))
        if op in _OPS:
            out = out & true(_OPS[op](a, b))
        elif op in ("==", "!="):
            close = F.abs(a - b) <= TIE
            out = out & true(close if op == "==" else ~close)
        else:
            out = F.lit(False)
    return out
