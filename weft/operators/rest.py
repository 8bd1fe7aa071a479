"""Putting intermediate tables at rest in the folder that the whole cluster shares, and taking them away again."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where that is unset and all is on one machine (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='weft-shared-')}"
        atexit.register(shutil.rmtree, found.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver's Python ends."""
    path = f"{shared_dir(spark)}/weft-{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def put(df: DataFrame, name: str = "step") -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet and read it back, so that lineage ends and a lost executor costs nothing already written; also its path."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    return put(df, name)[0]


def drop(path: str | None) -> None:
    """Delete a table that nothing reads any more."""
    if path is None or (spark := _written.pop(path, None)) is None:
        return
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written() -> set[str]:
    """Paths of the tables that are still there."""
    return set(_written)


def release(before: set[str], keep: str) -> None:
    """Delete the tables that came since ``before``, but for one: once a result is at rest, nothing reads what it was made from."""
    for path in set(_written) - before - {keep}:
        drop(path)


@atexit.register
def _drop_all() -> None:
    for path in list(_written):
        with contextlib.suppress(Exception):  # the session may be gone already
            drop(path)
