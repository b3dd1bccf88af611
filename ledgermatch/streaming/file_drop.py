"""Continuous import of a drop folder (the upload queue, re-aimed).

A Structured Streaming file source lists new ``*.csv`` files of the drop
folder; each micro-batch (at most ``max_files`` new files) runs one import
unit of ``operators.merge`` per dataset -- header audit, typed read, strict
rejects, one merge of all files, an audit row per file -- in load order wallet master -> wallet
-> swap, then refreshes the gold tables once. The stream's checkpoint (below
the shared work folder) records which files were handed out; every import
commits the stream, batch and path it belongs to, and a replayed batch skips
what it has committed, so a restart after a lost executor or driver imports
nothing twice. A file that comes again in a later batch is imported again:
the merge decides row by row. A failing or empty file is recorded in
``<store>/failed_imports`` and the batch continues.
"""

from __future__ import annotations

import datetime as dt
import os
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schema as S
from ..operators import merge as M
from ..operators.review import Ledgers
from ..session import scratch_path
from ..sinks import gold, store
from ..sources import csv_ingest

FAILED = "failed_imports"


def _below_root(path: str) -> str:
    """The path without scheme and host, which callers may leave out."""
    return os.path.abspath(re.sub(r"^\w+:(//[^/]*)?", "", path))


def _committed_units(spark: SparkSession, root: str, units: list[str]) -> set[str]:
    """Which of ``units`` (one batch, at most ``max_files``) are committed;
    only the hits are collected."""
    if not units:
        return set()
    done = set()
    for table in S.TABLES.values():
        marks = store.committed(spark, root, table)
        named = marks.select(F.explode(F.split("note", M.UNITS)).alias("unit"))
        done |= {r.unit for r in named.filter(F.col("unit").isin(units)).collect()}
    return done


def import_batch(spark: SparkSession, paths: list[str], root: str, gold_root: str | None = None,
                 batch: str | None = None) -> list[dict]:
    """Import the given files (one merge per dataset, load order), then refresh gold.

    With a ``batch`` name, files that the same batch has committed before are skipped."""
    if not paths:
        return []
    exact = [csv_ingest.literal(p) for p in paths]
    audit = {r.file_path: r.dataset for r in csv_ingest.header_audit(spark, exact).collect()}
    seen = {_below_root(p) for p in audit}  # a file without a byte is not read, so it has no header
    empty = [p for p in paths if _below_root(p) not in seen]
    unit = {p: f"{batch} {p}" if batch is not None else "" for p in audit}
    done = _committed_units(spark, root, [u for u in unit.values() if u])
    results, failures = [], []
    for ds in S.LOAD_ORDER:
        paths = sorted(p for p, d in audit.items() if d == ds and unit[p] not in done)
        if not paths:
            continue
        exact = [csv_ingest.literal(p) for p in paths]
        for path, r in zip(paths, M.import_files(spark, root, exact, ds, units=[unit[p] for p in paths])):
            if r["error"]:
                failures.append((path, ds, r["error"], dt.datetime.now(dt.timezone.utc)))
            else:
                results.append(r)
    unknown = [(p, None, "The headers fit none of the three export layouts.", dt.datetime.now(dt.timezone.utc))
               for p, d in audit.items() if d is None]
    unknown += [(p, None, "The file is empty.", dt.datetime.now(dt.timezone.utc)) for p in sorted(empty)]
    if failures or unknown:
        spark.createDataFrame(failures + unknown, "path string, dataset string, error string, at timestamp") \
            .write.mode("append").parquet(f"{root}/{FAILED}")
    if gold_root is not None and results:
        led = Ledgers(*(store.read(spark, root, S.TABLES[d], S.table_schema(d))
                        for d in ("wallet_master", "wallet", "swap")))
        gold.refresh(spark, gold_root, led, gold.source_revision(spark, root))
    return results


def start(spark: SparkSession, drop_folder: str, root: str, *, gold_root: str | None = None,
          checkpoint: str | None = None, max_files: int = 100, available_now: bool = True,
          interval: str = "1 minute") -> StreamingQuery:
    """Start the import stream. ``available_now`` processes what is there and
    stops (scheduled runs); otherwise it polls every ``interval``."""
    checkpoint = checkpoint or scratch_path(spark, "import-stream")
    files = (spark.readStream.format("binaryFile")
             .schema("path string, modificationTime timestamp, length long, content binary")
             .option("pathGlobFilter", "*.csv")
             .option("maxFilesPerTrigger", max_files)
             .load(drop_folder)
             .select("path"))

    def each_batch(batch: DataFrame, epoch_id: int) -> None:
        paths = [r.path for r in batch.collect()]  # at most max_files rows
        import_batch(batch.sparkSession, paths, root, gold_root, batch=f"{checkpoint} {epoch_id}")

    writer = (files.writeStream.foreachBatch(each_batch)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()


def failed_imports(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.parquet(f"{root}/{FAILED}")
    except AnalysisException as exc:
        if not store.missing(exc):
            raise
        # none recorded yet
        return spark.createDataFrame([], "path string, dataset string, error string, at timestamp")

