"""Order statistics of whole series without a sort of any series in one task: exact quantiles by narrowing histograms, average ranks
by ranges of values with carried counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from comboscan.functions import cols as C
from comboscan.session import materialize

#: Cells of a histogram: a pass narrows the place of a value that often.
CELLS = 1024


def values_at(df: DataFrame, columns: list[str], ranks: Callable[[int], list[int]]) -> dict[str, dict[int, float]]:
    """For each column the finite values at the 0-based ranks that ``ranks`` gives for their count; columns without values are left out.

    A pass counts the values of every sought interval in equal cells, all columns at once and pre-aggregated where the rows are; the
    driver gets cells, not values. A sought value's cell becomes its interval, until all values in it are equal.
    """
    v = {c: C.num(f"`{c}`") for c in columns}
    r = df.agg(*[f(v[c]).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("n", F.count), ("a", F.min), ("z", F.max))]).first()
    out: dict[str, dict[int, float]] = {c: {} for i, c in enumerate(columns) if r[f"n{i}"]}
    # sought rank -> (its place among the interval's values, the interval's ends)
    todo = {(c, k): (k, r[f"a{i}"], r[f"z{i}"]) for i, c in enumerate(columns) if r[f"n{i}"] for k in set(ranks(r[f"n{i}"]))}
    while todo:
        for (c, k), (_, low, high) in list(todo.items()):
            if low == high:
                out[c][k] = low
                del todo[c, k]
        if not todo:
            break
        spans = sorted({(c, low, high) for (c, _), (_, low, high) in todo.items()})
        ids = {s: j for j, s in enumerate(spans)}
        cells = []
        for (c, low, high), j in ids.items():
            inside = (v[c] >= low) & (v[c] <= high)
            cell = F.least(F.floor((v[c] / 2 - low / 2) / (high / 2 - low / 2) * CELLS), F.lit(CELLS - 1)).cast("int")
            cells.append(F.when(inside, F.struct(F.lit(j).alias("j"), cell.alias("cell"), v[c].alias("v"))))
        long = df.select(F.explode(F.array_compact(F.array(*cells))).alias("x")).select("x.*")
        found: dict[int, list] = {}
        for x in long.groupBy("j", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("z")).collect():
            found.setdefault(x["j"], []).append(x)
        for (c, k), (place, low, high) in list(todo.items()):
            for x in sorted(found[ids[c, low, high]], key=lambda x: x["cell"]):
                if place < x["n"]:
                    todo[c, k] = (place, x["a"], x["z"])
                    break
                place -= x["n"]
    return out


def linear_quantiles(df: DataFrame, columns: list[str], qs: list[float]) -> dict[str, list[float]]:
    """Interpolated quantiles of the finite values of each column that has any."""
    counts: dict[int, None] = {}

    def ranks(n: int) -> list[int]:
        counts[n] = None
        return [k for q in qs for k in (int((n - 1) * q), min(n - 1, int((n - 1) * q) + 1))]

    n_of = df.agg(*[F.count(C.num(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(columns)]).first() if columns else []
    n_of = {c: n_of[i] for i, c in enumerate(columns)}
    got = values_at(df, columns, ranks) if columns else {}

    def at(c: str, q: float) -> float:
        place = (n_of[c] - 1) * q
        low = int(place)
        a, b = got[c][low], got[c][min(n_of[c] - 1, low + 1)]
        return a if place == low else a * (low + 1 - place) + b * (place - low)

    return {c: [at(c, q) for q in qs] for c in got}


def ranked(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, times, before): each distinct value that is there, how often it is, and how many values of its keys are smaller.

    Values are counted first, so a frequent one is a row; rows are dealt by ranges of (keys, value), each range is summed by
    itself, and the sums of the ranges before are carried in.
    """
    some = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("times"))
    parts = materialize(some.repartitionByRange(*keys, value).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = parts.groupBy("_range", *keys).agg(F.sum("times").alias("_sum"))
    earlier = F.coalesce(F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carried = sums.select("_range", *keys, earlier.alias("_carried"))
    inside = F.coalesce(F.sum("times").over(Window.partitionBy("_range", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = parts.withColumn("_inside", inside).join(carried, ["_range", *keys])
    return out.select(*keys, value, "times", (F.col("_carried") + F.col("_inside")).alias("before"))


def with_average_ranks(df: DataFrame, ranks: dict[str, Column], quantiles: dict[str, tuple[Column, float]] | None = None) -> DataFrame:
    """Adds, for each name of ``ranks``, the average rank of a column's value among its symbol's over their number, ties sharing theirs; and
    for each of ``quantiles`` a symbol's interpolated quantile of a column. Missing where the value is. ``df`` is read three times."""
    quantiles = quantiles or {}
    kinds = {**ranks, **{n: c for n, (c, _) in quantiles.items()}}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), c.cast("double").alias("v")) for n, c in kinds.items()]))
    long = df.select("symbol", "bar_idx", each.alias("x")).select("symbol", "bar_idx", "x.*").where("v is not null")
    table = materialize(ranked(long, ["symbol", "kind"], "v"), "ranks")
    total = table.groupBy("symbol", "kind").agg(F.sum("times").alias("n"))
    table = table.join(total, ["symbol", "kind"])
    out = df
    if ranks:
        mine = long.where(F.col("kind").isin(list(ranks))).join(table, ["symbol", "kind", "v"])
        mine = mine.withColumn("rank", (F.col("before") + (F.col("times") + 1) / 2.0) / F.col("n"))
        wide = mine.groupBy("symbol", "bar_idx").agg(*[F.max(F.when(F.col("kind") == n, F.col("rank"))).alias(n) for n in ranks])
        out = out.join(wide, ["symbol", "bar_idx"], "left")
    for name, (_, q) in quantiles.items():
        place = (F.col("n") - 1) * F.lit(q)
        low, high = F.floor(place), F.ceil(place)
        holds = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("times"))
        ends = table.where(F.col("kind") == name).groupBy("symbol").agg(F.max(F.when(holds(low), F.col("v"))).alias("_a"), F.max(F.when(holds(high), F.col("v"))).alias("_b"), F.max(place - low).alias("_f"))
        out = out.join(ends.select("symbol", (F.col("_a") * (1 - F.col("_f")) + F.col("_b") * F.col("_f")).alias(name)), "symbol", "left")
    return out
