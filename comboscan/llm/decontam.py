"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Each test item keeps a MinHash sketch, the s smallest hashes of its word shingles. Items are partitioned by size (powers of
two); s follows from a partition's upper bound so that whatever document holds the wanted share of an item also
holds some hash of its sketch. The long side is never sketched: documents look their shingle hashes up in the sketches, so
a short item is found inside a text of any length. Candidates are verified on the shingles themselves.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import fresh, let, materialize

WORDS, TENTHS = 5, 8
#: Hashes in a sketch beyond those the guarantee needs; they make a chance hit less likely to be a candidate.
SPARE = 3
#: Tables of more rows than this are joined by shuffle instead of broadcast (about 20 bytes a row).
BROADCAST_ROWS = 2_000_000


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _windows(w: Column, one) -> Column:
    """one(w, i) for each start i of a shingle; none if there are too few words."""
    starts = F.when(F.size(w) >= WORDS, F.sequence(F.lit(0), F.size(w) - WORDS)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: one(w, i))


def hashes(text: Column) -> Column:
    """64-bit hashes of a text's shingles, repeats included."""
    one = lambda w, i: F.xxhash64(*[F.get(w, i + k) for k in range(WORDS)])
    return let(F.transform(words(text), lambda x: F.xxhash64(x)), lambda w: _windows(w, one))


def shingles(text: Column) -> Column:
    """The distinct shingles of a text as strings."""
    one = lambda w, i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(WORDS)])
    return F.array_distinct(let(words(text), lambda w: _windows(w, one)))


def text_key(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def item_shingles(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, item_id, n, shingle): distinct shingles of each distinct item of at least five words."""
    base = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("t")).where("t is not null").distinct()
    item = F.struct("item_id", text_key(F.col("t")).alias("k"))
    flat = base.select(F.xxhash64(item).alias("item"), "item_id", F.explode(shingles(F.col("t"))).alias("shingle"))
    sizes = flat.groupBy("item").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return flat.join(sizes, "item").select("item", "item_id", "n", "shingle")


def sketches(items: DataFrame, tenths: int = TENTHS) -> DataFrame:
    """(item, need, hash): sketches of ``item_shingles`` and the hits without which an item cannot be contained."""
    miss = lambda n: F.floor(n * F.lit(10 - tenths) / F.lit(10) + F.lit(1e-9)).cast("int")
    bound = F.pow(F.lit(2.0), F.length(F.bin("n"))).cast("int") - 1  # the size partition's upper bound
    w = Window.partitionBy("item").orderBy("hash")
    hashed = items.select("item", "n", F.xxhash64(*[F.xxhash64(F.get(F.split("shingle", " "), k)) for k in range(WORDS)]).alias("hash"))
    ranked = hashed.withColumn("rank", F.row_number().over(w)).withColumn("depth", F.least(miss(bound) + 1 + SPARE, F.col("n")))
    return ranked.where(F.col("rank") <= F.col("depth")).select("item", (F.col("depth") - miss(F.col("n"))).alias("need"), "hash")


def contained(docs: DataFrame, items: DataFrame, tenths: int = TENTHS, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Carried columns, key (of the text), item_id, matched, item_shingles, containment: every (document, item) pair
    where the document holds at least tenths / 10 of the item's distinct five-word shingles.

    Null, empty and shorter texts (documents or items) hold no shingle and match nothing. Repeated rows give one row, repeated
    items too; items that share an id are told apart by their texts. Empty tables give no rows.
    """
    own = materialize(item_shingles(items), "items")
    sketch = materialize(sketches(own, tenths), "sketches")
    n_own, n_sketch = own.count(), sketch.count()

    probe = docs.select(F.col(text).alias("_t")).where("_t is not null")
    probe = probe.select(text_key(F.col("_t")).alias("key"), F.explode(hashes(F.col("_t"))).alias("hash"))
    hits = probe.join(_sized(sketch, n_sketch), "hash").groupBy("key", "item").agg(F.countDistinct("hash").alias("hits"), F.first("need").alias("need"))
    cand = materialize(hits.where("hits >= need").select("key", "item"), "candidates")

    keys = cand.select("key").distinct()
    again = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)], F.col(text).alias("_t")).where("_t is not null")
    again = again.withColumn("key", text_key(F.col("_t")))
    again = again.join(_sized(keys, cand.count()), "key", "left_semi")
    carried = [f"_c{i}" for i in range(len(carry))]
    shingled = again.distinct().select(*carried, "key", F.explode(shingles(F.col("_t"))).alias("shingle"))
    met = shingled.join(_sized(own, n_own), "shingle").groupBy(*carried, "key", "item").agg(
        F.count(F.lit(1)).alias("matched"), F.first("n").alias("item_shingles"), F.first("item_id").alias("item_id")
    )
    met = met.where(F.col("matched") * 10 >= F.col("item_shingles") * tenths)
    return met.select(
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], "key", "item_id", "matched",
        F.col("item_shingles").cast("long").alias("item_shingles"), (F.col("matched") / F.col("item_shingles")).alias("containment"),
    )


def clean(docs: DataFrame, items: DataFrame, tenths: int = TENTHS, text: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns) whose text contains no item; null texts stay."""
    bad = materialize(contained(docs, items, tenths, text, carry=()).select("key").distinct(), "contaminated")
    key = fresh("_key", docs.columns)
    bad = bad.withColumnRenamed("key", key)
    marked = docs.withColumn(key, F.when(F.col(text).isNotNull(), text_key(F.col(text))))
    # a small table is broadcast, by its written size; otherwise both sides are shuffled on the key
    return marked.join(_sized(bad, bad.count()), key, "left_anti").drop(key)
