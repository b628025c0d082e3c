"""Hierarchical weighted hash tree: rows descend region, rack and shard levels by weighted hash draws.

Every leaf gives a row an exponential arrival time ``-ln(u) / weight`` from a hash of (row key, leaf); a rack's
draw is the least of its shards', a region's the least of its racks'. The minimum of exponentials is exponential with
the summed weight, so each level is a weighted draw over its children, yet a changed leaf changes no other leaf's
draw: rows move only into a subtree that grew or out of one that shrank, and a new shard takes rows only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

REGIONS, RACKS = 4, 2
#: Rows of a shard are numbered in so many runs, one task's sort each; a constant, so the offsets table is bounded.
RUNS = 64


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def topology(shards: int, weights: dict[int, float] | None = None, regions: int = REGIONS, racks: int = RACKS) -> list[Leaf]:
    """Where each shard hangs: a shard's place depends on its number alone, so growth moves no other shard."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    leaves = [Leaf(s % regions, s // regions % racks, s, (weights or {}).get(s, 1.0)) for s in range(shards)]
    if any(x.weight < 0 for x in leaves) or not any(x.weight for x in leaves):
        raise ValueError("weights must not be negative, and one must be positive")
    return [x for x in leaves if x.weight > 0]


def _first_least(draws: dict[int, Column]) -> Column:
    """The key of the least draw."""
    if len(draws) == 1:
        return F.lit(next(iter(draws)))
    low = F.least(*draws.values())
    out = F.lit(list(draws)[-1])
    for k in list(draws)[-2::-1]:
        out = F.when(draws[k] == low, F.lit(k)).otherwise(out)
    return out


def _least(cols: list[Column]) -> Column:
    return F.least(*cols) if len(cols) > 1 else cols[0]


def place(df: DataFrame, key: Column, leaves: list[Leaf], prefix: str) -> DataFrame:
    """Adds {prefix}region, {prefix}rack and {prefix}shard. A null key is a key like any other (all such rows go together)."""
    base, draw = f"_{prefix}base", lambda s: f"_{prefix}draw{s}"
    df = df.withColumn(base, F.xxhash64(F.coalesce(key.cast("string"), F.lit("\0null"))))
    u = lambda s: (F.shiftrightunsigned(F.xxhash64(F.col(base), F.lit(s)), 11).cast("double") + 0.5) * (2.0**-53)
    df = df.withColumns({draw(x.shard): -F.ln(u(x.shard)) / F.lit(x.weight) for x in leaves})
    tree: dict[int, dict[int, list[int]]] = {}
    for x in leaves:
        tree.setdefault(x.region, {}).setdefault(x.rack, []).append(x.shard)
    rack_draw = {(g, k): f"_{prefix}rack{g}_{k}" for g, racks in tree.items() for k in racks}
    df = df.withColumns({rack_draw[g, k]: _least([F.col(draw(s)) for s in shards]) for g, racks in tree.items() for k, shards in racks.items()})
    df = df.withColumn(f"{prefix}region", _first_least({g: _least([F.col(rack_draw[g, k]) for k in racks]) for g, racks in tree.items()}))
    rack, shard = F.lit(None).cast("int"), F.lit(None).cast("int")
    for g, racks in tree.items():
        rack = F.when(F.col(f"{prefix}region") == g, _first_least({k: F.col(rack_draw[g, k]) for k in racks})).otherwise(rack)
    df = df.withColumn(f"{prefix}rack", rack)
    for g, racks in tree.items():
        for k, shards in racks.items():
            here = (F.col(f"{prefix}region") == g) & (F.col(f"{prefix}rack") == k)
            shard = F.when(here, _first_least({s: F.col(draw(s)) for s in shards})).otherwise(shard)
    df = df.withColumn(f"{prefix}shard", shard)
    return df.drop(base, *[draw(x.shard) for x in leaves], *rack_draw.values())


def shard_documents(docs: DataFrame, shards: int = 40, weights: dict[int, float] | None = None, runs: int = RUNS) -> DataFrame:
    """Places documents (doc_id, text) by the id alone and numbers each shard's rows from 0 without gaps.

    Returns doc_id, size (UTF-8 bytes + 16), text_crc32, law, region, rack, shard, slot, grown_shard.
    Null text: size 16, crc of no bytes (0). Null ids share one shard. Repeated rows each get a slot. An empty table gives
    no rows. Other columns of the input are not read. Only ids, sizes and checksums are shuffled, never texts;
    a shard's rows are numbered in ``runs`` separate sorts, whose offsets are a table of shards x runs rows.
    """
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    base = docs.select("doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    base = place(base, F.col("doc_id"), topology(shards, weights), "")
    base = place(base, F.col("doc_id"), topology(shards + 1, weights), "g_")
    base = base.withColumn("run", (F.monotonically_increasing_id() % runs).cast("int"))
    base = materialize(base.drop("g_region", "g_rack"), "shards")
    counts = base.groupBy("shard", "run").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "run", F.coalesce(before, F.lit(0)).alias("start"))
    # shards x runs rows at most, whatever the input
    numbered = base.withColumn("n", F.row_number().over(Window.partitionBy("shard", "run").orderBy("doc_id", "text_crc32", "size")))
    out = numbered.join(F.broadcast(offsets), ["shard", "run"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("start") + F.col("n") - 1).alias("slot"), F.col("g_shard").alias("grown_shard"), "region", "rack",
    )
