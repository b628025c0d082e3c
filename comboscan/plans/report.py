"""Reports, batch sizing and an SQL face of the enumeration."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from comboscan.operators.combos import pair_support, walk


def format_report(top: DataFrame, formulas_only: bool = False) -> str:
    """Text of at most the top rows, best first: a block each, or a line each."""
    lines = []
    for i, r in enumerate(top.collect(), 1):
        d = r.asDict()
        name = d.pop("combination")
        lines.append(f"{i}. {name}")
        if not formulas_only:
            lines += [f"   {k}: {v:.4f}" if isinstance(v, float) else f"   {k}: {v}" for k, v in d.items()]
    return "\n".join(lines)


class BatchTuner:
    """Size of the next window of ranks: halved if the last five took over 30 s in the mean, doubled if under 7.5 s; looked at every ten."""

    def __init__(self, floor: int, every: int = 10, low: float = 7.5, high: float = 30.0) -> None:
        self.size, self.floor, self.cap = floor, floor, max(4 * floor, 200_000)
        self.every, self.low, self.high = every, low, high
        self.seen, self.last = 0, deque(maxlen=5)

    def record(self, seconds: float) -> int:
        self.seen += 1
        self.last.append(seconds)
        if self.seen % self.every == 0:
            mean = sum(self.last) / len(self.last)
            if mean > self.high:
                self.size = max(self.floor, self.size // 2)
            elif mean < self.low:
                self.size = min(self.cap, self.size * 2)
        return self.size


def dead_pairs(words: DataFrame, features: int, min_sample: int) -> DataFrame:
    """(a, b) pairs of features whose common support is under ``min_sample``: no deeper combination with both can reach it."""
    spark = words.sparkSession
    every = spark.range(features).select(F.col("id").cast("int").alias("a"))
    pairs = every.select("a", F.explode(F.sequence(F.col("a") + 1, F.lit(features))).alias("b")).where(F.col("b") < features)
    alive = pair_support(words).where(F.col("support") >= min_sample).select("a", "b")
    return pairs.join(alive, ["a", "b"], "left_anti")


@udtf(returnType="combo_id: bigint, combo: array<int>")
class EnumerateCombos:
    """enumerate_combos(n, depth, start, end) as a table."""

    def eval(self, n: int, depth: int, start: int, end: int) -> Iterator[tuple[int, list[int]]]:
        for i, c in enumerate(walk(start, end, n, depth)):
            yield start + i, list(c)


def register(spark: SparkSession) -> None:
    spark.udtf.register("enumerate_combos", EnumerateCombos)
