"""Bars: schema, CSV scan, bars from an event stream, prepared-data sink with a content guard."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_SCHEMA = T.StructType([T.StructField("timestamp", T.TimestampType())] + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")])
PRICES = ("open", "high", "low", "close", "volume")


def read_bars(spark: SparkSession, path: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """CSV with a header and the raw schema by name; cells that do not parse are null. Order is by timestamp.

    ``local_date`` is the calendar date as it is written, which a time with an offset (2024-03-01T01:30:00+02:00) has where it was noted
    down, not in UTC; dates of ranges mean it.
    """
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(path).drop(*drop)
    typed = [F.expr(f"try_cast(`{f.name}` as {f.dataType.simpleString()})").alias(f.name) for f in RAW_SCHEMA if f.name in raw.columns]
    if "timestamp" in raw.columns:
        typed.append(F.expr("try_cast(substring(trim(`timestamp`), 1, 10) as date)").alias("local_date"))
    rest = [c for c in raw.columns if c not in RAW_SCHEMA.names and c != "local_date"]
    return index_bars(raw.select(*typed, *rest).withColumn("symbol", F.lit("ALL")), "timestamp")


def read_prepared(spark: SparkSession, path: str) -> DataFrame:
    """Prepared data of any columns: CSV by inference, or Parquet."""
    if path.rstrip("/").endswith(".csv"):
        return spark.read.csv(path, header=True, inferSchema=True)
    return spark.read.option("ignoreCorruptFiles", True).parquet(path)


def index_bars(bars: DataFrame, ts: str = "ts", symbol: str = "symbol") -> DataFrame:
    """Adds bar_idx, 0-based in time order within a symbol; all later operators refer to it, never to physical order."""
    return bars.withColumn("bar_idx", (F.row_number().over(Window.partitionBy(symbol).orderBy(ts)) - 1).cast("long"))


def bars_from_events(events: DataFrame, every: str = "hour", symbol: Column | None = None) -> DataFrame:
    """(symbol, ts, open, high, low, close, volume, bar_idx) of time buckets; partial aggregates first, so a hot symbol or
    bucket costs one row a task."""
    key = F.struct("ts", "event_id")
    b = events.where("value is not null and ts is not null").groupBy(
        (symbol if symbol is not None else F.lit("ALL")).alias("symbol"), F.date_trunc(every, "ts").alias("bucket")
    ).agg(
        F.min_by("value", key).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.max_by("value", key).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"),
    )
    return index_bars(b.withColumnRenamed("bucket", "ts"))


def day_of(df: DataFrame, ts: str = "ts") -> Column:
    """The calendar date of a bar: as written, where the bars were read with it, else that of its time (UTC)."""
    return F.col("local_date") if "local_date" in df.columns else F.to_date(F.col(ts))


def date_filter(df: DataFrame, start: str | None, end: str | None, ts: str = "ts") -> DataFrame:
    """Inclusive calendar dates; rows without a time go when a bound is set. Exit indices stay absolute bar_idx."""
    day = day_of(df, ts)
    if start:
        df = df.where(day >= F.lit(start).cast("date"))
    if end:
        df = df.where(day <= F.lit(end).cast("date"))
    return df


def rebase_exits(df: DataFrame, offset: int) -> DataFrame:
    """For data cut at the front whose exit indices are row positions: v - offset, or null if it lay before."""
    cols = [c for c in df.columns if c.endswith(("_exit_i", "_exit_i_long", "_exit_i_short"))]
    return df.withColumns({c: F.when(F.col(c) >= offset, F.col(c) - offset) for c in cols})


def drop_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with every listed column finite; a column without any value is skipped, and an empty result is an error."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    some = df.agg(*[F.max(finite(c)).alias(c) for c in columns]).first()
    used = [c for c in columns if some[c]]
    cond = F.lit(True)
    for c in used:
        cond = cond & finite(c)
    out = df.where(cond)
    if out.isEmpty():
        raise ValueError("no row is left once rows with missing values are dropped")
    return out


def required_columns(available: list[str], target: str, flags: list[str], bases: list[str]) -> list[str]:
    """Columns a search needs, in order, each once."""
    want = ["symbol", "ts", "timestamp", "bar_idx", target, f"rr_{target}", "rr_long", "rr_short"]
    want += [f"{target}_{x}{s}" for x in ("eligible", "exit_i") for s in ("", "_long", "_short")]
    want += ["stop_distance", "atr", *flags, *bases]
    return [c for c in dict.fromkeys(want) if c in set(available)]


def digest(df: DataFrame) -> str:
    """Content digest of a table that does not depend on the order of rows: count, sum and xor of row hashes."""
    h = F.xxhash64(*sorted(df.columns))
    r = df.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first()
    return hashlib.sha256(repr((sorted(df.columns), *map(str, r))).encode()).hexdigest()


def fingerprint(spark: SparkSession, path: str) -> str:
    """Digest of the bytes of the files at a path; files are hashed where they are read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    parts = sorted(r["h"] for r in f.select(F.sha2("content", 256).alias("h")).collect())
    return "raw:" + hashlib.sha256("".join(parts).encode()).hexdigest()


class ChangedDataError(RuntimeError):
    """Prepared data at a path differs from what is to be written, and the change was not acknowledged."""


def write_prepared(df: DataFrame, path: str, acknowledge: bool = False) -> bool:
    """Writes prepared Parquet; equal content is kept (False), other content is an error unless acknowledged."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(hadoop):
        old = spark.read.parquet(path)
        if digest(old) == digest(df.select(old.columns) if set(old.columns) == set(df.columns) else df):
            return False
        if not acknowledge:
            raise ChangedDataError(f"prepared data at {path} changed; acknowledge to replace it")
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return True
