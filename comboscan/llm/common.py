"""Shared helpers of the llm operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from comboscan.session import materialize, scratch, ship_package

#: Rows of 64 numbers' bits up to which they go to the rows sought, not these to them (about 40 bytes a row; 128,000,000 numbers in sequence).
BITS_ROWS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(base: str, taken: list[str]) -> str:
    """A column name that clashes with none of the caller's, so extra columns survive an operator."""
    name = base
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: the optimizer would copy a projected expression to each of its uses."""
    return F.get(F.transform(F.array(value), body), 0)


def among(rows: DataFrame, number: str, wanted: DataFrame) -> DataFrame:
    """The rows whose number (long, not null) is in the one column of ``wanted``, repeats allowed there.

    The wanted numbers travel as bits, 64 in a row, so that wide rows are read where they lie and not shuffled; beyond
    ``BITS_ROWS`` Spark chooses the join.
    """
    word, bits = fresh("_word", rows.columns), fresh("_bits", rows.columns)
    n = F.col(wanted.columns[0])
    one = wanted.select(F.shiftright(n, 6).alias(word), n.bitwiseAND(F.lit(63)).cast("int").alias("at"))
    packed = materialize(one.groupBy(word).agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias(bits)), "bits")
    if packed.count() <= BITS_ROWS:
        packed = F.broadcast(packed)
    mine = F.col(number)
    has = F.getbit(F.col(bits), mine.bitwiseAND(F.lit(63)).cast("int")) == 1
    return rows.join(packed, (F.shiftright(mine, 6) == F.col(word)) & has, "left_semi")


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node in an edge, root the smallest node reachable.

    Alternates large-star and small-star steps; each round is two grouped minima and two equi-joins whose
    hot side Spark can split, and is written to the shared folder, so nothing is gathered on the driver
    and a lost executor costs one round. An empty edge table gives an empty result; self loops and repeats are ignored.
    """
    e = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "cc")
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "cc")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "cc")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


__all__ = ["among", "connected_components", "fold", "fresh", "let", "materialize", "scratch", "ship_package", "table"]
