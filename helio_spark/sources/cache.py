"""Stored tables that know what they were built from."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helio_spark.session import remove_path
from helio_spark.sources.writers import write_processed

MANIFEST = "digest string, data string"


def input_state(spark: SparkSession, inputs: Sequence[str]) -> str:
    """Names, lengths and times of change of all files under ``inputs``, as one value.

    Spark lists the files, so any store it can read will do, and their contents are not read. The
    value does not depend on the order of listing.
    """
    if not inputs:
        return "no inputs"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(inputs))
    mark = F.xxhash64("path", "length", F.col("modificationTime").cast("string"))
    n, total, mixed = files.select(mark.alias("m")).agg(
        F.count("m"), F.sum(F.col("m").cast("decimal(38,0)")), F.bit_xor("m")
    ).first()
    return f"{n} {total} {mixed}"


def build_digest(spark: SparkSession, inputs: Sequence[str], options: Mapping) -> str:
    """Names the table that ``options`` make of the files as they are now."""
    told = {"inputs": input_state(spark, inputs), "options": options}
    return hashlib.sha256(json.dumps(told, sort_keys=True, default=str).encode()).hexdigest()


def _manifest(spark: SparkSession, path: str):
    try:
        return spark.read.schema(MANIFEST).json(f"{path}/manifest").first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def cached_table(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    inputs: Sequence[str] = (),
    options: Mapping | None = None,
    by: Sequence[str] = ("series_id",),
) -> DataFrame:
    """The table stored under ``path`` if it was built from these files with these options, else a new one.

    A new table goes to a folder of its own and the manifest, which names it, is written last: a build that
    fails leaves the old table in place, and readers of the old one are not disturbed until
    the new one stands; then the old folder goes. ``build`` is not called if the table is current.
    """
    digest = build_digest(spark, inputs, options or {})
    known = _manifest(spark, path)
    if known is not None and known.digest == digest:
        return spark.read.parquet(f"{path}/{known.data}")
    data = f"data-{uuid.uuid4().hex}"
    write_processed(build(), f"{path}/{data}", by=by)
    row = spark.createDataFrame([(digest, data)], MANIFEST)
    row.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    if known is not None:
        remove_path(spark, f"{path}/{known.data}")
    return spark.read.parquet(f"{path}/{data}")
