"""Versioned parquet tables with an atomic commit marker.

No table format (Delta/Iceberg) is on the class path, so a table is a folder
of immutable versions::

    <root>/<table>/v=00000007-<attempt>/data/     parquet rows
    <root>/<table>/v=00000007-<attempt>/extra/... optional side tables of the same unit
    <root>/<table>/v=00000007-<attempt>/commit/   one-row parquet, written LAST

A version is visible only once its ``commit`` rows exist, so a unit of work
(rows + audit, or the three gold tables) appears completely or not at all,
and a reader never sees a half-written version. Every attempt has a folder
of its own, named by its marker: what a failed attempt left behind is never
read and never in the way of a retry. Versions are never overwritten; the
path being read is never the path being written.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.joins import join_small


COMMIT_SCHEMA = "version long, note string, attempt string"


def missing(exc: AnalysisException) -> bool:
    """The error says that nothing is there yet (any other error is one)."""
    return exc.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def _vdir(root: str, table: str, attempt: str) -> str:
    return f"{root}/{table}/v={attempt}"


def new_attempt(version: int) -> str:
    return f"{version:08d}-{uuid.uuid4().hex[:12]}"


def _commits(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    try:
        marks = spark.read.schema(COMMIT_SCHEMA).parquet(f"{root}/{table}/v=*/commit")
        # markers written before attempts had names stand for the folder of their version
        return marks.withColumn("attempt", F.coalesce("attempt", F.format_string("%08d", F.col("version"))))
    except AnalysisException as exc:
        if not missing(exc):
            raise
        return None  # no version committed yet


def committed(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Commit rows of every visible version of ``table``."""
    c = _commits(spark, root, table)
    return c if c is not None else spark.createDataFrame([], COMMIT_SCHEMA)


def latest_version(spark: SparkSession, root: str, table: str) -> int | None:
    row = committed(spark, root, table).agg(F.max("version").alias("v")).first()
    return row.v if row is not None else None


def part_path(spark: SparkSession, root: str, table: str, part: str, version: int) -> str:
    """Folder of a part of a committed version."""
    row = committed(spark, root, table).where(F.col("version") == version).first()
    if row is None:
        raise ValueError(f"{table} has no version {version}.")
    return f"{_vdir(root, table, row.attempt)}/{part}"


def read(spark: SparkSession, root: str, table: str, schema: T.StructType | None = None,
         part: str = "data", version: int | None = None) -> DataFrame | None:
    """Rows of the latest (or given) committed version; ``None`` if none and no schema."""
    v = version if version is not None else latest_version(spark, root, table)
    if v is None:
        return spark.createDataFrame([], schema) if schema is not None else None
    return spark.read.parquet(part_path(spark, root, table, part, v))


def commit(spark: SparkSession, root: str, table: str, parts: dict[str, DataFrame], note: str = "",
           expected_version: int | None = -1) -> int:
    """Write ``parts`` (DataFrames, or functions returning one, called in order
    after the parts before them are written) as the next version, then its
    commit marker.

    ``expected_version`` (when not -1) is the version the caller read; a
    different latest version means a concurrent writer -> ValueError."""
    current = latest_version(spark, root, table)
    if expected_version != -1 and current != expected_version:
        raise ValueError(f"{table} changed from version {expected_version} to {current}; retry the unit.")
    version = (current or 0) + 1
    attempt = new_attempt(version)
    base = _vdir(root, table, attempt)
    for name, df in parts.items():
        if callable(df):  # a part built from what the writes before it measured
            df = df()
        df.write.mode("errorifexists").option("compression", "zstd").parquet(f"{base}/{name}")
    mark(spark, root, table, version, attempt, note)
    return version


def mark(spark: SparkSession, root: str, table: str, version: int, attempt: str, note: str) -> None:
    """The commit marker that makes an attempt's folder the version."""
    spark.createDataFrame([(version, note, attempt)], COMMIT_SCHEMA).coalesce(1) \
        .write.mode("errorifexists").parquet(f"{_vdir(root, table, attempt)}/commit")


def history(spark: SparkSession, root: str, table: str, part: str) -> DataFrame | None:
    """``part`` rows of all committed versions, tagged with their version."""
    commits = _commits(spark, root, table)
    if commits is None:
        return None
    try:
        rows = spark.read.parquet(f"{root}/{table}/v=*/{part}").select(
            "*", F.regexp_extract(F.col("_metadata.file_path"), r"/v=([^/]+)/", 1).alias("_version"))
    except AnalysisException as exc:
        if not missing(exc):
            raise
        return None
    # one row per committed version, counted before it is broadcast
    return join_small(rows, commits.select(F.col("attempt").alias("_version")), "_version", "left_semi")
