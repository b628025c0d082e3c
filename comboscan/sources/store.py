"""Result store: Parquet parts committed by window of the enumeration, resumable state, ranked reads."""

from __future__ import annotations

import hashlib
import json
import logging
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("comboscan")

RESULT_COLUMNS = {
    "csv_hash": "string", "direction": "string", "target": "string", "combination": "string", "processed_at": "string",
    "resume_offset": "bigint", "depth": "int", "total_bars": "bigint", "profitable_bars": "bigint", "win_rate": "double",
    "max_drawdown": "double", "calmar_ratio": "double",
}


class OtherDataError(RuntimeError):
    """The store holds results of other data."""


def run_digest(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def parse_s3(uri: str) -> tuple[str, str]:
    """(bucket, prefix) of s3://bucket/prefix; Spark itself writes to such places by s3a paths."""
    m = re.fullmatch(r"s3a?://([a-z0-9][a-z0-9.\-]{1,61}[a-z0-9])(?:/(.*))?", uri)
    if not m:
        raise ValueError(f"not an s3 uri with a bucket: {uri!r}")
    return m[1], (m[2] or "").strip("/")


class Store:
    """A directory with results/window=<start>-<end> and a state file for each (data, run).

    A window is written first and named in the state after; a window the state does not name is not read and is replaced
    when it is run again, so a lost driver never leaves rows twice.
    """

    def __init__(self, spark: SparkSession, path: str, data: str | None, run: str, force: bool = False) -> None:
        self.spark, self.path, self.data, self.run = spark, path.rstrip("/"), data, run
        self._jvm = spark._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        if force:
            self._fs.delete(self._at(""), True)
        self.state = self._load()
        if data is not None and self.state["data"] not in (None, data):
            raise OtherDataError("the store was filled from other data; force to start anew")
        self.state["data"] = data or self.state["data"]

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _load(self) -> dict:
        for version in sorted(self._versions(), reverse=True):
            text = "\n".join(r["value"] for r in self.spark.read.text(f"{self.path}/state-{version:09d}.json").collect())
            try:
                return json.loads(text)
            except ValueError:  # a file system without atomic renames may leave a part of one
                continue
        return {"data": None, "runs": {}}

    def _versions(self) -> list[int]:
        if not self._fs.exists(self._at("")):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._at(""))]
        return [int(m[1]) for n in names if (m := re.fullmatch(r"state-(\d+)\.json", n))]

    def _save(self) -> None:
        """A new version beside the old ones, of which two stay: at no moment is there none."""
        old = sorted(self._versions())
        s = self._fs.create(self._at("state.tmp"), True)
        s.write(bytearray(json.dumps(self.state).encode()))
        s.close()
        if not self._fs.rename(self._at("state.tmp"), self._at(f"state-{(old[-1] if old else 0) + 1:09d}.json")):
            raise RuntimeError("another run has written the next version of the state")
        for version in old[:-1]:
            self._fs.delete(self._at(f"state-{version:09d}.json"), False)

    def offset(self) -> int:
        """Where the run goes on: the end of its windows that follow each other from the first."""
        at = 0
        for a, b in sorted(self.state["runs"].get(self.run, [])):
            if a > at:
                break
            at = max(at, b)
        return at

    def write(self, rows: DataFrame, start: int, end: int) -> None:
        rows.select([F.col(c).cast(t).alias(c) for c, t in RESULT_COLUMNS.items()]).write.mode("overwrite").option("compression", "zstd").parquet(
            f"{self.path}/results/{self.run[:16]}/window={start}-{end}"
        )

    def name(self, start: int, end: int) -> None:
        """Names a written window in the state; from now on it is read."""
        self.state["runs"].setdefault(self.run, []).append([start, end])
        self._save()

    def commit(self, rows: DataFrame, start: int, end: int) -> None:
        self.write(rows, start, end)
        self.name(start, end)

    def cached(self, kind: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A small table kept beside the results under the digest of what it was made of: read if it is there whole, else made."""
        path = f"{self.path}/{kind}/{key[:32]}"
        if not self._fs.exists(self._at(f"{kind}/{key[:32]}/_SUCCESS")):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def _windows(self) -> list[str]:
        return [f"{self.path}/results/{run[:16]}/window={a}-{b}" for run, windows in self.state["runs"].items() for a, b in windows]

    def results(self, check: bool = False) -> DataFrame:
        """All committed rows, also as the temp view ``results``. Unreadable files are skipped; with ``check`` they are named first, in the
        log and in ``quarantine``."""
        parts = self._windows()
        schema = ", ".join(f"{c} {t}" for c, t in RESULT_COLUMNS.items())
        df = self.spark.read.schema(schema).option("ignoreCorruptFiles", True).parquet(*parts) if parts else self.spark.createDataFrame([], schema)
        if check and parts:
            self._check(df, parts)
        df.createOrReplaceTempView("results")
        return df

    def copy(self, uri: str) -> None:
        """Copies all committed rows to an S3 place, in one table by window."""
        bucket, prefix = parse_s3(uri)
        self.results().write.mode("overwrite").parquet(f"s3a://{bucket}/{prefix + '/' if prefix else ''}results")

    def _check(self, df: DataFrame, parts: list[str]) -> None:
        """Compares the files of the committed windows with those that gave rows. A file that gave fewer than its footer tells, or whose
        footer cannot be read, is damaged: its window has to be judged again."""
        listed = [f.getPath().toString() for p in parts for f in self._fs.listStatus(self._jvm.org.apache.hadoop.fs.Path(p)) if f.getPath().getName().endswith(".parquet")]
        plain = lambda x: re.sub(r"^(\w+):/+", r"\1:/", x)  # noqa: E731  file:/a and file:///a are one
        given = {plain(r["path"]): r["n"] for r in df.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("combination").alias("n")).collect()}
        bad = []
        for path in listed:
            try:
                told = self.spark.read.parquet(path).count()
            except Exception as e:  # noqa: BLE001  whatever a reader says of a damaged file
                bad.append((path, given.get(plain(path), 0), None, str(e).strip().splitlines()[0][:200]))
                continue
            if told != given.get(plain(path), 0):
                bad.append((path, given.get(plain(path), 0), told, "fewer rows than its footer tells"))
        if bad:
            for path, n, told, why in bad:
                log.warning("damaged result file %s: %d of %s rows read: %s", path, n, told, why)
            rows = self.spark.createDataFrame(bad, "file string, rows_read long, rows_told long, why string").withColumn("found_at", F.current_timestamp())
            rows.write.mode("append").parquet(f"{self.path}/quarantine")


def committed(spark: SparkSession, path: str) -> DataFrame:
    """All committed rows of a directory, whatever data they are of."""
    return Store(spark, path, None, "").results(check=True)


def top_results(results: DataFrame, k: int, min_sample: int = 0, max_drawdown: float = float("inf"), min_calmar: float | None = None, direction: str | None = None, target: str | None = None, min_win_rate: float | None = None) -> DataFrame:
    """The k best by calmar, ties by combination; NaN ranks nowhere."""
    c = (F.col("total_bars") >= min_sample) & (F.col("max_drawdown") <= max_drawdown) & ~F.isnan("calmar_ratio")
    for col, value, op in (("calmar_ratio", min_calmar, "ge"), ("win_rate", min_win_rate, "ge"), ("direction", direction, "eq"), ("target", target, "eq")):
        if value is not None:
            c = c & (F.col(col) >= value if op == "ge" else F.col(col) == value)
    return results.where(c).orderBy(F.desc("calmar_ratio"), "combination").limit(k)
