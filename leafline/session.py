"""Session helpers: table loading, the shared work folder and shipping this package to executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A driver table; Spark opens the path, so any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where that is unset a folder of this machine serves, for local sessions only, as in tests; elsewhere executors would not see it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return Path(tempfile.gettempdir(), "leafline-local").as_uri()


#: Folders made by this driver that have not been removed, in the order they were made.
_MADE: list[str] = []
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def work_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder name below the shared folder, for tables that cut lineage."""
    path = f"{checkpoint_root(spark)}/leafline/{what}-{uuid.uuid4().hex[:12]}"
    _MADE.append(path)
    return path


def cut(df: DataFrame, what: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: short lineage that outlives lost executors."""
    spark = df.sparkSession
    path = work_dir(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Removes the folders made inside at its end, but for tables written by the function it gives, which must not read from the others lazily."""
    start, kept = len(_MADE), set()

    def keep(df: DataFrame, what: str) -> DataFrame:
        before = len(_MADE)
        out = cut(df, what)
        kept.update(_MADE[before:])
        return out

    try:
        yield keep
    finally:
        gone = [path for path in _MADE[start:] if path not in kept]
        _MADE[start:] = [path for path in _MADE[start:] if path in kept]
        for path in gone:
            drop_dir(spark, path)


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of writes made inside go with each write, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREE) if before is None else spark.conf.set(_FREE, before)


def drop_dir(spark: SparkSession, path: str) -> None:
    """Removes a folder made by work_dir(), through Hadoop's file systems."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clean(spark: SparkSession) -> None:
    """Removes all folders that this driver made; for the time after results are written, as lazy ones read from them."""
    while _MADE:
        drop_dir(spark, _MADE.pop())


def fresh(columns: list[str], *names: str) -> list[str]:
    """Names for helper columns that no column has: the given ones with as many underscores as it takes."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_leafline_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="leafline-"), "leafline.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(target)
    sc._leafline_shipped = True
