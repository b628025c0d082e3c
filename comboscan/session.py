"""Session helpers: shipping the package to Python workers and shared scratch tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Paths of the tables written in each open ``scratch`` block, the innermost last.
_OPEN: list[list[str]] = []


def ship_package(spark: SparkSession) -> None:
    """Give every Python worker this package, once per application, through Spark's own file service."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp()) / "comboscan_pkg.zip"
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(out))
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local session may go without; it gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not base:
        base = "file://" + os.path.join(tempfile.gettempdir(), "comboscan-shared")
    return f"{base.rstrip('/')}/comboscan/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a written table in the shared folder; the reread plan knows its real size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Removes the tables that ``materialize`` writes inside the block at its end; those taken off the list it gives stay."""
    _OPEN.append(made := [])
    try:
        yield made
    finally:
        _OPEN.pop()
        for path in made:
            _remove(spark, path)


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_scratch(spark: SparkSession) -> None:
    """Removes this application's scratch tables; no result that still reads them may be in use."""
    _remove(spark, shared_dir(spark))
