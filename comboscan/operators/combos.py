"""Enumeration of AND-combinations: ranks, predicates, masks as words. The search itself is in ``search``."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def total(n: int, depth: int) -> int:
    """Number of combinations of 1 to ``depth`` of n."""
    return sum(comb(n, k) for k in range(1, depth + 1))


def rank(combo: list[int], n: int) -> int:
    """Position in the fixed order: by depth, then lexicographic."""
    k = len(combo)
    at, low = total(n, k - 1), 0
    for i, c in enumerate(combo):
        left = k - i
        at += comb(n - low, left) - comb(n - c, left)
        low = c + 1
    return at


def unrank(at: int, n: int, depth: int) -> tuple[int, ...]:
    """Inverse of rank: each member by bisection on C(n - low, left) - C(n - c, left), the combinations led by less than c."""
    if at < 0:
        raise IndexError(at)
    for k in range(1, depth + 1):
        if at < comb(n, k):
            break
        at -= comb(n, k)
    else:
        raise IndexError("beyond the last combination")
    out, low = [], 0
    for left in range(k, 0, -1):
        a, b = low, n - left
        while a < b:
            m = (a + b + 1) // 2
            if comb(n - low, left) - comb(n - m, left) <= at:
                a = m
            else:
                b = m - 1
        at -= comb(n - low, left) - comb(n - a, left)
        out.append(a)
        low = a + 1
    return tuple(out)


def walk(start: int, end: int, n: int, depth: int) -> Iterator[tuple[int, ...]]:
    """Combinations of ranks start to end - 1, each from the one before."""
    if start >= end:
        return
    c = list(unrank(start, n, depth))
    for _ in range(end - start):
        yield tuple(c)
        k = len(c)
        i = k - 1
        while i >= 0 and c[i] == n - k + i:
            i -= 1
        if i < 0:
            if k == depth or k == n:
                return
            c = list(range(k + 1))
        else:
            c[i] += 1
            c[i + 1 :] = range(c[i] + 1, c[i] + k - i)


def unrank_pairs(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Closed form for pairs: (i, j) of 0-based ranks among C(n, 2)."""
    i = (n - 2 - np.floor(np.sqrt(np.maximum(0, -8.0 * at + 4.0 * n * (n - 1) - 7)) / 2 - 0.5)).astype(np.int64)
    for fix in (-1, 1):  # rounding of the root
        before = i * (2 * n - i - 1) // 2
        i = np.where((fix < 0) & (before > at), i - 1, i)
        i = np.where((fix > 0) & ((i + 1) * (2 * n - i - 2) // 2 <= at), i + 1, i)
    return i, at - i * (2 * n - i - 1) // 2 + i + 1


@dataclass
class Predicate:
    name: str
    base: str | None = None
    op: str | None = None
    rhs: str | None = None

    def bound(self) -> tuple[str, str] | None:
        """(base, lower or upper) of a constant comparison."""
        return (self.base, "lower" if self.op in (">", ">=") else "upper") if self.base and self.rhs is None else None


def structurally_sound(combo, preds: list[Predicate]) -> bool:
    """At most one lower and one upper bound for each base column."""
    seen = [b for i in combo if (b := preds[i].bound())]
    return len(seen) == len(set(seen))


def mask_words(df: DataFrame, names: list[str], order: str = "bar_idx") -> DataFrame:
    """(symbol, feature_idx, word_idx, word): 64 rows of a flag in a long, by order; the packing is a partial aggregate."""
    w, bit = F.floor(F.col(order) / 64), F.pmod(F.col(order), F.lit(64)).cast("int")
    flags = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.coalesce(F.col(f"`{n}`"), F.lit(False)).alias("v")) for i, n in enumerate(names)]))
    on = df.select("symbol", w.alias("word_idx"), bit.alias("bit"), flags.alias("f")).where("f.v")
    return on.groupBy("symbol", F.col("f.i").alias("feature_idx"), "word_idx").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("word"))


def pair_support(words: DataFrame) -> DataFrame:
    """(a, b, support) of every pair of features with a common row: equi-join on the word, then popcounts."""
    x, y = words.alias("x"), words.alias("y")
    j = x.join(y, (F.col("x.symbol") == F.col("y.symbol")) & (F.col("x.word_idx") == F.col("y.word_idx")) & (F.col("x.feature_idx") < F.col("y.feature_idx")))
    both = F.bit_count(F.col("x.word").bitwiseAND(F.col("y.word")))
    return j.groupBy(F.col("x.feature_idx").alias("a"), F.col("y.feature_idx").alias("b")).agg(F.sum(both).alias("support")).where("support > 0")


def enumerate_join(catalog: DataFrame, depth: int) -> DataFrame:
    """(combo array) of all index combinations up to ``depth`` by ordered self-joins of a catalog (idx); for small catalogs."""
    level = catalog.select(F.array("idx").alias("combo"), F.col("idx").alias("last"))
    out = level
    for _ in range(depth - 1):
        nxt = catalog.select(F.col("idx").alias("next"))
        level = level.join(nxt, F.col("next") > F.col("last")).select(F.concat("combo", F.array("next")).alias("combo"), F.col("next").alias("last"))
        out = out.unionByName(level)
    return out.select("combo")


def enumerate_range(spark: SparkSession, n: int, depth: int, start: int = 0, end: int | None = None, parts: int | None = None) -> DataFrame:
    """(combo_id, combo) of the ranks from start to end, unranked where they are."""
    last = total(n, depth)
    end = last if end is None else min(end, last)
    if end >= 2**63:
        raise ValueError("more combinations than 64-bit ranks; give an end")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = pdf["id"].to_numpy()
            if len(ids):
                yield pd.DataFrame({"combo_id": ids, "combo": [list(c) for c in walk(int(ids[0]), int(ids[-1]) + 1, n, depth)]})

    return spark.range(start, max(start, end), 1, parts or spark.sparkContext.defaultParallelism).mapInPandas(run, "combo_id long, combo array<int>")


def no_stacking(hits: np.ndarray, exits: np.ndarray) -> np.ndarray:
    """Greedy choice of trades that do not overlap: the next one starts at or after the last one's exit."""
    out, free = [], -1
    for i in hits.tolist():
        if i >= free:
            out.append(i)
            e = int(exits[i])
            free = e if e >= i else i + 1
    return np.array(out, dtype=np.int64)


@dataclass
class Capital:
    """How trades move the capital, and the years they span."""

    risk: float = 0.01
    start: float = 100_000.0
    years: float = 1.0
    contracts: bool = False
    min_contracts: int = 1
    max_contracts: int | None = None
    margin: float | None = None


def first_of_equal_masks(df: DataFrame, names: list[str]) -> list[str]:
    """Names whose masks are neither constant nor equal to an earlier one's; one aggregate of exact digests."""
    f = lambda n: F.coalesce(F.col(f"`{n}`"), F.lit(False))
    aggs = []
    for i, n in enumerate(names):
        aggs += [F.count_if(f(n)).alias(f"c{i}"), F.bit_xor(F.when(f(n), F.xxhash64("symbol", "bar_idx"))).alias(f"a{i}"), F.bit_xor(F.when(f(n), F.xxhash64("bar_idx", "symbol"))).alias(f"b{i}")]
    r = df.agg(F.count(F.lit(1)).alias("n"), *aggs).first()
    seen, out = set(), []
    for i, n in enumerate(names):
        key = (r[f"c{i}"], r[f"a{i}"], r[f"b{i}"])
        if 0 < r[f"c{i}"] < r["n"] and key not in seen:
            seen.add(key)
            out.append(n)
    return out

