"""Versioned merge of imported rows into a ledger table.

* ``latest_per_record`` -- one row per record id: the highest source version
  ``greatest(source_modified_at, source_change_at)`` (NULLs ignored; both NULL
  ranks lowest), ties broken by the highest row number. A ``max_by`` over a
  struct key: partial aggregation keeps one candidate per id per map task, so
  an id repeated millions of times never gathers in one task.
* ``upsert`` -- full outer join of the current table with the newest rows on
  the record id: insert new ids; replace an existing row only when the
  incoming version is >= the stored one *and* the raw record differs
  (re-importing a file applies nothing); keep everything else.
* ``merge_files`` -- the guarded upserts of any number of files, in order, as one
  fold per record id: the stored table is rewritten once.
* ``import_files`` -- parse + merge + audit rows committed as one version.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..plans.joins import written
from ..sinks import store
from ..sources import csv_ingest


def source_version(prefix: str = "") -> Column:
    return F.greatest(F.col(f"{prefix}source_modified_at"), F.col(f"{prefix}source_change_at"))


def latest_per_record(rows: DataFrame, key: str = "zoho_record_id") -> DataFrame:
    """I12."""
    cols = [c for c in rows.columns if c != key]
    order = F.struct(source_version().alias("v"), F.col("source_row_number").alias("n"))
    best = F.max_by(F.struct(*[F.col(c) for c in cols]), order)
    return rows.groupBy(key).agg(best.alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


# Incoming rows (after dedup) are broadcast while their measured payload stays
# below this; the stored table is then streamed through a broadcast join and
# never shuffled. Above it one full outer join on the id runs instead.
BROADCAST_INCOMING_BYTES = 64 * 1024 * 1024


def payload_bytes(df: DataFrame) -> Column:
    """Aggregate: bytes of the rows' values -- text and binary fields by their
    length, every other field counted as 16 bytes."""
    sizes = [F.coalesce(F.octet_length(F.col(f.name)), F.lit(0))
             if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.lit(16)
             for f in df.schema.fields]
    total = sizes[0]
    for size in sizes[1:]:
        total = total + size
    return F.sum(total.cast("long"))


def _versions(prefix: str) -> Column:
    return F.coalesce(source_version(prefix), F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"))


def _decide(cols: list[str], key: str, now: Column, ts_type) -> tuple[Column, list[Column]]:
    """Applied flag and the chosen columns for joined rows (e_* existing, n_* incoming)."""
    applied = F.col("_n").isNotNull() & (
        F.col("_e").isNull()
        | ((_versions("n_") >= _versions("e_")) & ~F.col("e_raw_record").eqNullSafe(F.col("n_raw_record"))))
    out = [F.col(key)]
    for c in cols:
        if c == "imported_at":
            out.append(F.when(applied, now.cast(ts_type)).otherwise(F.col("e_imported_at")).alias(c))
        else:
            out.append(F.when(applied, F.col(f"n_{c}")).otherwise(F.col(f"e_{c}")).alias(c))
    return applied, out


def upsert(existing: DataFrame, newest: DataFrame, imported_at: Column | None = None,
           key: str = "zoho_record_id", max_broadcast_bytes: int = BROADCAST_INCOMING_BYTES) -> DataFrame:
    """Merged table rows plus a boolean ``_applied`` per row.

    Small incoming side (written once to the shared folder and its payload
    measured there): existing LEFT JOIN broadcast(newest)
    decides replaced rows while streaming the table once; new ids come from a
    semi/anti join of bounded size. Above the bound: full outer join on the id."""
    now = imported_at if imported_at is not None else F.current_timestamp()
    cols = [c for c in existing.columns if c != key]
    ts_type = existing.schema["imported_at"].dataType
    e = existing.select(key, *[F.col(c).alias(f"e_{c}") for c in cols], F.lit(True).alias("_e"))
    newest = written(newest, "incoming")
    if (newest.agg(payload_bytes(newest).alias("b")).first().b or 0) > max_broadcast_bytes:
        n = newest.select(key, *[F.col(c).alias(f"n_{c}") for c in cols], F.lit(True).alias("_n"))
        applied, out = _decide(cols, key, now, ts_type)
        return e.join(n, key, "full_outer").select(*out, applied.alias("_applied"))
    n = newest.select(key, *[F.col(c).alias(f"n_{c}") for c in cols], F.lit(True).alias("_n"))
    applied, out = _decide(cols, key, now, ts_type)
    kept_or_replaced = e.join(F.broadcast(n), key, "left").select(*out, applied.alias("_applied"))
    # ids already stored: at most |newest| rows, so the anti join below stays small
    seen = existing.select(key).join(F.broadcast(newest.select(key)), key, "left_semi")
    inserted = newest.join(F.broadcast(seen), key, "left_anti").select(
        key, *[(now.cast(ts_type) if c == "imported_at" else F.col(c)).alias(c) for c in cols],
        F.lit(True).alias("_applied"))
    return kept_or_replaced.unionByName(inserted)


def merge(existing: DataFrame, incoming: DataFrame, imported_at: Column | None = None) -> DataFrame:
    """I12 + I13 for one file's rows."""
    return upsert(existing, latest_per_record(incoming), imported_at)


def _version_or_lowest() -> Column:
    return F.coalesce(source_version(), F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"))


def fold(candidates: DataFrame, stored: DataFrame, key: str = "zoho_record_id") -> DataFrame:
    """The guarded upserts of several files, in order, as one step per record id.

    ``candidates``: a file's newest row per id, with ``file_no``. The upserts that one file after
    the other would make are replayed over the id's short list (a row per file at most): a
    candidate replaces what is there then if its version is not older and its raw record differs.
    Returns the ids that change: key, ``row`` (the last one applied), ``applied`` (file numbers)."""
    cols = [c for c in candidates.columns if c not in (key, "file_no")]
    entry = F.struct("file_no", _version_or_lowest().alias("v"), F.struct(*cols).alias("row"))  # the raw record is in the row
    lists = candidates.select(key, entry.alias("e")).groupBy(key).agg(F.collect_list("e").alias("files"))
    by_file = F.array_sort("files", lambda a, b: F.when(a["file_no"] < b["file_no"], -1).otherwise(1))
    seen = stored.select(key, _version_or_lowest().alias("_v"), F.col("raw_record").alias("_raw"))
    joined = lists.select(key, by_file.alias("files")).join(seen, key, "left")
    row_type = candidates.select(F.struct(*cols).alias("row")).schema["row"].dataType
    start = F.struct(F.col("_v").alias("v"), F.col("_raw").alias("raw"), F.lit(None).cast(row_type).alias("row"),
                     F.array().cast("array<int>").alias("applied"))

    def step(acc: Column, x: Column) -> Column:
        takes = acc["v"].isNull() | ((x["v"] >= acc["v"]) & ~x["row"]["raw_record"].eqNullSafe(acc["raw"]))
        new = F.struct(x["v"].alias("v"), x["row"]["raw_record"].alias("raw"), x["row"].alias("row"),
                       F.concat(acc["applied"], F.array(x["file_no"])).alias("applied"))
        return F.when(takes, new).otherwise(acc)

    # a generated row, so that the fold runs once and not for every field that is read from it
    done = joined.select(key, F.explode(F.array(F.aggregate("files", start, step))).alias("s"))
    return done.where(F.size("s.applied") > 0).select(key, F.col("s.row").alias("row"), F.col("s.applied").alias("applied"))


def changed_by_one(candidates: DataFrame, stored: DataFrame, key: str = "zoho_record_id") -> DataFrame:
    """``fold`` for the rows of one file: an id has one candidate, so there is no list to collect."""
    seen = stored.select(key, F.lit(True).alias("_e"), _version_or_lowest().alias("_v"), F.col("raw_record").alias("_raw"))
    takes = F.col("_e").isNull() | ((_version_or_lowest() >= F.col("_v")) & ~F.col("raw_record").eqNullSafe(F.col("_raw")))
    cols = [c for c in candidates.columns if c not in (key, "file_no")]
    return candidates.join(seen, key, "left").where(takes).select(
        key, F.struct(*cols).alias("row"), F.array(F.col("file_no").cast("int")).alias("applied"))


def newest_by_file(rows: DataFrame, key: str = "zoho_record_id") -> DataFrame:
    """I12 per file: the newest row of each (record id, ``file_no``).

    Only the ids are exchanged to learn which files repeat one. The rows of the other files are what they are; those
    of a file that does are exchanged whole, and the newest are written once."""
    repeats = rows.groupBy(key, "file_no").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("file_no").distinct()
    repeats = [r.file_no for r in repeats.collect()]  # a row a file
    if not repeats:
        return rows
    repeating = F.col("file_no").isin(*repeats)
    cols = [c for c in rows.columns if c not in (key, "file_no")]
    order = F.struct(source_version().alias("v"), F.col("source_row_number").alias("n"))
    newest = rows.where(repeating).groupBy(key, "file_no").agg(F.max_by(F.struct(*cols), order).alias("_r"))
    newest = written(newest.select(key, "file_no", *[F.col(f"_r.{c}").alias(c) for c in cols]), "incoming")
    return rows.where(~repeating).select(*newest.columns).unionByName(newest)


def merge_files(stored: DataFrame, rows: DataFrame, imported_at: Column | None = None,
                key: str = "zoho_record_id") -> tuple[DataFrame, DataFrame]:
    """I12 + I13 for the rows of several files (``file_no``, in order): the merged table, and (file_no, rows_applied).

    The stored table is read for the files' ids and rewritten once, however many files there are."""
    now = imported_at if imported_at is not None else F.current_timestamp()
    ts_type = stored.schema["imported_at"].dataType
    newest = newest_by_file(rows, key)
    small = (newest.agg(payload_bytes(newest).alias("b")).first().b or 0) <= BROADCAST_INCOMING_BYTES
    files = [r.file_no for r in newest.select("file_no").distinct().collect()]  # a row a file
    if len(files) < 2 and stored.isEmpty():  # every id is new, and what changes lies in the shared folder already
        counts = newest.groupBy("file_no").agg(F.count(F.lit(1)).alias("rows_applied"))
        return newest.select(*[now.cast(ts_type).alias(c) if c == "imported_at" else F.col(c) for c in stored.columns]), counts
    ids = newest.select(key).distinct()
    known = stored.join(F.broadcast(ids) if small else ids, key, "left_semi")
    changed = written((changed_by_one if len(files) < 2 else fold)(newest, known, key), "changed")
    counts = changed.select(F.explode("applied").alias("file_no")).groupBy("file_no").agg(F.count(F.lit(1)).alias("rows_applied"))
    gone = changed.select(key)
    kept = stored.join(F.broadcast(gone) if small else gone, key, "left_anti")
    fresh = changed.select(*[F.col(key) if c == key else (now.cast(ts_type) if c == "imported_at" else F.col(f"row.{c}")).alias(c)
                             for c in stored.columns])
    return kept.unionByName(fresh), counts


def _listed(spark: SparkSession, path: str) -> list[str]:
    """The files that a path, a folder or a glob names, as Spark's file system lists them."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out: list[str] = []
    for status in fs.globStatus(hadoop) or []:
        below = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
        out += [f.getPath().toString() for f in below if f.isFile() and not f.getPath().getName().startswith(("_", "."))]
    return out


def _same_path(path: str) -> str:
    """One spelling of a local file's path: ``file:///a``, ``file:/a`` and ``/a`` are the same."""
    return re.sub(r"^(file:)?/+", "/", path)


def import_files(spark: SparkSession, root: str, paths: list[str], dataset: str | None = None, *, strict: bool = True,
                 units: list[str] | None = None, stop: bool = False) -> list[dict]:
    """I14 + I15 for several files of one dataset: parsed once, merged in one step, committed as one version.

    Table, audit rows and counts are those of importing the files one after the other. A glob
    counts as one file. With ``strict`` a file with a reject is left out whole and its result
    has an ``error``; with ``stop`` the files after it are left out, too, without a result. ``units`` name
    the files in the commit marker."""
    entry = {_same_path(f): no for no, p in enumerate(paths) for f in _listed(spark, p)}
    found = csv_ingest.header_audit(spark, paths).collect()
    results = [{"source_file": p.rsplit("/", 1)[-1], "error": None} for p in paths]
    heads: list[list] = [[] for _ in paths]
    for r in found:
        heads[entry[_same_path(r.file_path)]].append(r)
    kinds = {r.dataset for r in found if r.dataset}
    if dataset is None and len(kinds) == 1:
        dataset, = kinds
    for result, files in zip(results, heads):
        wrong = [f"{r.file_name}: {r.problem or f'this is a {r.dataset} export where a {dataset} export belongs.'}"
                 for r in files if r.problem or r.dataset != dataset]
        if wrong or not files:
            result["error"] = "; ".join(sorted(wrong)) or f"{result['source_file']}: there is no record in it."
    good = [no for no, r in enumerate(results) if not r["error"]]
    if not good:
        return _until_error(results, stop)
    parsed = csv_ingest.read_audited(spark, [r for no in good for r in heads[no]])[dataset].parsed
    numbers = [(p, no) for p, no in entry.items() if not results[no]["error"]]
    numbers = spark.createDataFrame(numbers, "_path string, file_no int")  # a row a file, as the audit above
    spelled = F.regexp_replace("source_path", r"^(file:)?/+", "/")
    parsed = written(parsed.withColumn("_path", spelled).join(F.broadcast(numbers), "_path").drop("_path"), "parsed")
    rejected = F.col("reject_reason").isNotNull()
    facts = {r.file_no: r for r in parsed.groupBy("file_no").agg(
        F.count_if(~rejected).alias("rows_read"), F.min(F.when(~rejected, F.col("created_on"))).alias("lo"),
        F.max(F.when(~rejected, F.col("created_on"))).alias("hi"),
        F.min(F.when(rejected, F.struct("source_file", "source_row_number", "reject_reason"))).alias("first")).collect()}
    for no in good:
        if strict and no in facts and facts[no].first is not None:
            results[no]["error"] = f"{facts[no].first.source_file}: {facts[no].first.reject_reason}"
    errors = [no for no, r in enumerate(results) if r["error"]]
    good = [no for no in good if not results[no]["error"] and not (stop and errors and no > errors[0])]
    if not good:
        return _until_error(results, stop)

    table = S.TABLES[dataset]
    current = store.latest_version(spark, root, table)
    stored = store.read(spark, root, table, S.table_schema(dataset), version=current) if current else \
        spark.createDataFrame([], S.table_schema(dataset))
    rows = parsed.where(F.col("file_no").isin(*good) & ~rejected).select(*S.stored_columns(dataset), "file_no")
    merged, counts = merge_files(stored, rows)
    applied = {r.file_no: r.rows_applied for r in counts.collect()}
    sums: list[list] = [[] for _ in paths]
    for r in csv_ingest.checksums(spark, [csv_ingest.literal(f.file_path) for no in good for f in heads[no]]).collect():
        sums[entry[_same_path(r.file_path)]].append((r.source_file, r.sha256))
    # batch ids are assigned at commit, like a serial: more than the largest
    # committed id (imports are one writer at a time, see store.commit)
    last = import_batches(spark, root).agg(F.max("batch_id").alias("last")).first().last or 0
    now, batch = dt.datetime.now(dt.timezone.utc), []
    for no in good:
        files, f = sorted(sums[no]), facts.get(no)
        # a glob's files get one digest over their digests
        digest = files[0][1] if len(files) == 1 else hashlib.sha256("".join(d for _, d in files).encode()).hexdigest()
        batch.append((last + len(batch) + 1, dataset, ";".join(n for n, _ in files), digest, f.rows_read if f else 0,
                      applied.get(no, 0), f.lo if f else None, f.hi if f else None, now))
    note = UNITS.join(units[no] for no in good) if units else ""
    version = store.commit(spark, root, table, {"data": merged, "batch": spark.createDataFrame(batch, AUDIT_SCHEMA)},
                           note=note, expected_version=current)
    for no, b in zip(good, batch):
        results[no] |= {"dataset": dataset, "source_file": b[2], "sha256": b[3], "rows_read": b[4], "rows_applied": b[5],
                        "version": version, "min_created_on": b[6].isoformat() if b[6] else None,
                        "max_created_on": b[7].isoformat() if b[7] else None}
    return _until_error(results, stop)


def _until_error(results: list[dict], stop: bool) -> list[dict]:
    first = next((no for no, r in enumerate(results) if r["error"]), len(results))
    return results[:first + 1] if stop else results


#: Parts the units of a commit marker.
UNITS = "\n"


def import_file(spark: SparkSession, root: str, path: str, dataset: str | None = None, strict: bool = True,
                unit: str = "") -> dict:
    """``import_files`` for one file (or glob); an error is raised and nothing is written."""
    result, = import_files(spark, root, [path], dataset, strict=strict, units=[unit])
    if result["error"]:
        raise ValueError(result["error"])
    return result


AUDIT_SCHEMA = ("batch_id long, dataset string, source_file string, sha256 string, rows_read long, "
                "rows_applied long, min_created_on timestamp_ntz, max_created_on timestamp_ntz, "
                "imported_at timestamp")


def import_batches(spark: SparkSession, root: str) -> DataFrame:
    """The audit log: one row per committed import, ``batch_id`` in commit order
    (stored with the row when it was committed; no numbering pass over the log)."""
    parts = []
    for table in S.TABLES.values():
        h = store.history(spark, root, table, "batch")
        if h is not None:
            parts.append(h)
    if not parts:
        return spark.createDataFrame([], AUDIT_SCHEMA)
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.drop("_version")


def recent_imports(spark: SparkSession, root: str, n: int = 10) -> DataFrame:
    """The last ``n`` batches, newest first, with the name of their module."""
    names = F.create_map(*[F.lit(x) for pair in csv_ingest.DATASET_MODULES.items() for x in pair])
    return import_batches(spark, root).orderBy(F.desc("batch_id")).limit(n).withColumn("module", names[F.col("dataset")])


def configured(files: dict[str, list[str]], *, master_only: bool = False, file_prefix: str | None = None) -> list[tuple[str, str]]:
    """I16: the configured files in load order wallet master -> wallet -> swap, restricted by the
    options; an option that leaves none has an error of its own."""
    todo = [(ds, p) for ds in S.LOAD_ORDER for p in files.get(ds, [])]
    if not todo:
        raise ValueError("No configured files to load.")
    if master_only:
        todo = [(ds, p) for ds, p in todo if ds == "wallet_master"]
        if not todo:
            raise ValueError("No wallet master files are configured.")
    if file_prefix:
        todo = [(ds, p) for ds, p in todo if p.rsplit("/", 1)[-1].startswith(file_prefix)]
        if not todo:
            raise ValueError(f"None of the configured file names begins with {file_prefix!r}.")
    return todo


def dry_run(spark: SparkSession, files: dict[str, list[str]], *, master_only: bool = False,
            file_prefix: str | None = None) -> DataFrame:
    """I16 without a store: the profile of every configured file, in load order. A file with a
    reject raises ``ValueError`` naming its first one."""
    out = None
    for no, (ds, path) in enumerate(configured(files, master_only=master_only, file_prefix=file_prefix)):
        res = csv_ingest.ingest(spark, path, ds)[ds]
        parsed = written(res.parsed, "parsed")
        res = csv_ingest.split_rejects(ds, parsed)
        first = res.rejects.orderBy("source_file", "source_row_number").first()
        if first is not None:
            raise ValueError(f"{first.source_file}: {first.reject_reason}")
        row = csv_ingest.profile(res.rows, ds).select(F.lit(no).alias("position"), F.lit(path.rsplit("/", 1)[-1]).alias("file"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def batch_load(spark: SparkSession, root: str, files: dict[str, list[str]], *, master_only: bool = False,
               file_prefix: str | None = None) -> list[dict]:
    """I16: the configured files, one merge per dataset. As with one import after the other, the
    first file that fails ends the load; what comes before it is committed."""
    todo = configured(files, master_only=master_only, file_prefix=file_prefix)
    results = []
    for ds in S.LOAD_ORDER:
        paths = [p for d, p in todo if d == ds]
        if paths:
            results += import_files(spark, root, paths, ds, stop=True)
            if results[-1]["error"]:
                raise ValueError(results[-1]["error"])
    return results
