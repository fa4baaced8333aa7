"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def use_utc(spark: SparkSession) -> SparkSession:
    """Calendar functions read the session zone; all ``ts`` values are UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def require_utc(spark: SparkSession) -> None:
    """Parsing and calendar functions would shift silently in another session zone."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "Z", "+00:00"):
        raise ValueError(f"the session time zone is {zone}; call use_utc(spark) first")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a
    machine-local folder would be lost with its executor.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="helio-"))
    return sc.getCheckpointDir().rstrip("/")


#: Paths that the innermost open ``stored_scope`` owns.
_OWNED: ContextVar[list[str] | None] = ContextVar("owned", default=None)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the store that ``path`` names; one that is not there is no error."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def stored_scope(spark: SparkSession) -> Iterator[None]:
    """Owns every table that is stored while it is open, and deletes them when it closes.

    Results must be written out or collected before: DataFrames made inside read
    the deleted tables. Scopes nest; an inner one takes what is stored inside it. Scopes of
    different threads do not mix.
    """
    owned: list[str] = []
    token = _OWNED.set(owned)
    try:
        yield
    finally:
        _OWNED.reset(token)
        for path in owned:
            remove_path(spark, path)


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, owned by the open scope if there is one."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    owned = _OWNED.get()
    if owned is not None:
        owned.append(path)
    return path


#: Spark removes the shuffle files of a query at its end; else they stay until the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_only(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` and read it back, without leaving shuffle files; the session's own setting is put back."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the files.

    This cuts lineage, survives lost executors, fixes non-deterministic values
    such as row positions, and keeps column pruning (unlike a checkpoint). The files
    stay until an open ``stored_scope`` closes; without one nothing deletes them. Shuffle
    files of the write go with it.
    """
    return write_only(df, new_path(df.sparkSession, label))


def stored_alone(spark: SparkSession, label: str, build: Callable[[], DataFrame]) -> DataFrame:
    """``materialize(build(), label)``; every other table that is stored meanwhile is deleted."""
    path = new_path(spark, label)
    with stored_scope(spark):
        return write_only(build(), path)
