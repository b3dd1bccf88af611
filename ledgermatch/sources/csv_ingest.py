"""Typed ingest of ledger CSV exports.

Steps, all Spark jobs over a drop folder (or a list of files):

1. ``header_audit`` -- the first record of every file, nothing behind it is read:
   missing expected headers, duplicate headers, detected
   dataset (exactly one field map must be a subset of the header).
2. ``read_typed`` -- the records of all files that share a header layout
   (``records``: files are read in splits, also where quoted fields hold line
   breaks), parsed by ``from_csv`` into strings (columns are mapped by *name*),
   malformed rows caught in ``_corrupt_record``; then one ``select``
   types every field with regex guards + ``try_cast`` and records the first
   failing field as ``reject_reason``. Sensitive columns are dropped before
   anything is written, the raw record keeps every other field as text.
3. ``profile`` / ``validate_preview`` -- one aggregation each.
"""

from __future__ import annotations

import re

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from .. import schema as S
from . import records as REC

# --- fixed values: parsing guards -----------------------------------------
DATE_RE = r"^\d{4}-\d{2}-\d{2}$"
TIMESTAMP_RE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$"
OFFSET_RE = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}(:?\d{2})?)$"
DECIMAL_RE = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
#: Decimals that the amount type holds as they are, nearly all of most exports.
PLAIN_RE = r"^-?\d{1,26}(\.\d{1,12})?\z"
NON_FINITE_RE = r"(?i)^\s*[+-]?(nan|snan|inf|infinity)\s*$"
BLANK_RE = r"(?U)^\s*$"
CORRUPT = "_corrupt_record"
# --- end of fixed values --------------------------------------------------

CSV_OPTIONS = {
    "multiLine": "true",
    "escape": '"',
    "quote": '"',
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": CORRUPT,
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def literal(path: str) -> str:
    """``path`` with its glob characters escaped, to read exactly that file."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def header_audit(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """I4 + I5: (file_path, file_name, headers, candidate_datasets, dataset,
    duplicate_headers, problem) for every file that has a record. Reads the
    first record of each file only, in one task a file."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    h = REC.heads(spark, paths)
    matches = [F.when(F.size(F.array_except(F.array(*[F.lit(x) for x in S.headers_of(ds)]), F.col("headers"))) == 0,
                      F.lit(ds)) for ds in S.FIELD_MAPS]
    h = h.withColumn("_hits", F.array_compact(F.array(*matches)))
    dup = F.size(F.col("headers")) != F.size(F.array_distinct("headers"))
    return h.select(
        "file_path", "file_name", "headers",
        F.transform(F.col("_hits"), lambda ds: ds).alias("candidate_datasets"),
        F.when(F.size("_hits") == 1, F.element_at("_hits", 1)).alias("dataset"),
        dup.alias("duplicate_headers"),
        F.when(dup, F.lit("A column header occurs twice."))
        .when(F.size("_hits") != 1, F.lit("The headers fit none of the three export layouts."))
        .alias("problem"),
    )


def missing_headers(headers: Column, dataset: str) -> Column:
    """Expected headers absent from ``headers``, sorted (I4)."""
    return F.array_sort(F.array_except(F.array(*[F.lit(x) for x in S.headers_of(dataset)]), headers))


def _blank_to_null(c: Column) -> Column:
    # nearly all texts begin with a printable ASCII sign, which a comparison tells sooner than a pattern
    printable = (c >= "!") & (c < "\x7f")
    return F.when(printable, c).when(c.isNull() | c.rlike(BLANK_RE), F.lit(None).cast("string")).otherwise(c)


def written_scale(raw: Column) -> Column:
    """Fractional digits as written (exponent applied, never negative):
    '120.10' -> 2, '7' -> 0, '1.5e1' -> 0, '15e-3' -> 3."""
    t = F.trim(raw)
    mantissa = F.regexp_replace(F.regexp_replace(t, r"^[+-]", ""), r"[eE].*$", "")
    frac = F.length(F.regexp_extract(mantissa, r"\.(\d*)$", 1))
    exp = F.coalesce(F.regexp_extract(t, r"[eE]([+-]?\d+)$", 1).try_cast("int"), F.lit(0))
    plain = F.length(raw) - F.coalesce(F.nullif(F.instr(raw, "."), F.lit(0)), F.length(raw))
    return F.when(raw.rlike(PLAIN_RE), plain).otherwise(F.greatest(frac - exp, F.lit(0)))


def _typed(v: Column, kind: str) -> Column:
    """The typed value of a field without its blank text, NULL where it is none."""
    if kind == "decimal":
        t = F.trim(v)
        mantissa = F.regexp_replace(F.regexp_replace(t, r"^[+-]", ""), r"[eE].*$", "")
        digits = F.replace(mantissa, F.lit("."), F.lit(""))
        zeros = F.length(digits) - F.length(F.regexp_replace(digits, "0+$", ""))
        frac_digits = F.length(F.regexp_extract(mantissa, r"\.(\d*)$", 1))
        exponent = F.coalesce(F.regexp_extract(t, r"[eE]([+-]?\d+)$", 1).try_cast("int"), F.lit(0))
        # no silent rounding: the last digit that counts lies within the type's fraction
        exact = (zeros == F.length(digits)) | (frac_digits - exponent - zeros <= S.MONEY.scale)
        return F.when(v.rlike(PLAIN_RE), v.try_cast(S.MONEY)).when(v.rlike(DECIMAL_RE) & exact, t.try_cast(S.MONEY))
    if kind == "date":
        return F.when(v.rlike(DATE_RE), v.try_cast(T.DateType()))
    if kind == "timestamp":
        # digits beyond the microsecond are cut off, as a datetime has no place for them
        cut = F.when(F.length(v) > 26, F.regexp_replace(v, r"(\.\d{6})\d+$", "$1")).otherwise(v)
        return F.when(v.rlike(TIMESTAMP_RE), cut.try_cast(T.TimestampNTZType()))
    if kind in ("required", "text"):
        return v
    raise ValueError(f"Unknown field type {kind}")


def _error(v: Column, value: Column, kind: str, field: str) -> Column:
    """What is wrong with a field, NULL if nothing is; ``value`` is its typed value."""
    if kind == "required":
        return F.when(v.isNull(), F.lit(f"{field} is empty but required"))
    wrong = F.when(v.isNull() | value.isNotNull(), F.lit(None).cast("string"))
    if kind == "decimal":
        return wrong.when(v.rlike(NON_FINITE_RE), F.lit(f"{field} holds no finite amount")).otherwise(
            F.lit(f"{field} is not a decimal number"))
    if kind == "timestamp":
        return wrong.when(v.rlike(OFFSET_RE), F.lit(f"{field} carries a zone offset; stored times have none")).otherwise(
            F.lit(f"{field} is not a timestamp"))
    return wrong.otherwise(F.lit(f"{field} is not a date"))


@dataclass(frozen=True)
class IngestResult:
    """Typed rows of one dataset plus the rejects (record number + reason)."""

    dataset: str
    rows: DataFrame      # typed table rows (table columns + provenance)
    rejects: DataFrame   # (source_file, source_row_number, record_text, reject_message, reject_reason)
    parsed: DataFrame    # every record: typed fields + reject columns (NULL when accepted)


def read_typed(spark: SparkSession, files: list[str], dataset: str, headers: list[str],
               sensitive: tuple[str, ...] = S.SENSITIVE_HEADERS, imported_at: Column | None = None) -> IngestResult:
    """I1-I3, I6-I8 for files that share one header layout.

    Fields are parsed positionally as strings (``c0 .. cN``) and mapped to
    table columns by header name; ``_corrupt_record`` flags rows with a wrong
    number of fields. Record numbers are those of the file, the header being 0."""
    positional = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(headers))]
                              + [T.StructField(CORRUPT, T.StringType())])
    limit = REC.MAX_FIELD * (len(headers) + 1)  # a longer record has a field that is too long, or too many
    found = REC.records(spark, files, limit).where("record > 0")
    fields = F.from_csv("text", positional.simpleString(), CSV_OPTIONS)
    # a generated row: the parsed fields are computed once, not once per expression and filter that reads them
    raw = found.select(F.col("name").alias("source_file"), REC.plain_path(F.col("path")).alias("source_path"),
                       F.col("record").alias("source_row_number"),
                       F.explode(F.array(F.when(F.length("text") <= limit, fields))).alias("_fields"))
    by_header = {h: F.col("_fields")[f"c{i}"] for i, h in enumerate(headers)}
    # The JVM never compiles a method of more than 8000 bytes, and the operators of a stage are fused into one. An operator
    # with a lambda is not fused: Spark makes it of small methods.
    lengths = F.transform(F.array(*by_header.values()), lambda x: F.length(x))
    maps = S.FIELD_MAPS[dataset]
    raw = raw.withColumns({"_longest": F.coalesce(F.array_max(lengths), F.lit(0)),
                           "_v": F.struct(*[_blank_to_null(by_header[header]).alias(col) for col, header, _ in maps])})
    costly = [_typed(F.col(f"_v.{col}"), kind).alias(col) for col, _, kind in maps if kind not in ("required", "text")]
    raw = raw.withColumns({"_oversize": F.exists(F.array("_longest"), lambda n: n > REC.MAX_FIELD) | F.col("_fields").isNull(),
                           "_t": F.struct(*costly)})
    typed, errors, scales = [], [], []
    for col, header, kind in maps:
        v = F.col(f"_v.{col}")
        value = v if kind in ("required", "text") else F.col(f"_t.{col}")
        typed.append(value.alias(col))
        if kind != "text":
            errors.append(_error(v, value, kind, header))
        if kind == "decimal":
            scales.append(F.when(value.isNotNull(), written_scale(by_header[header]))
                          .alias(col + S.SCALE_SUFFIX))
    # sorted names: the same record gives the same text whatever the file's column order
    kept = sorted(h for h in headers if h not in sensitive)
    raw_record = F.to_json(F.struct(*[F.coalesce(by_header[h], F.lit("")).alias(h) for h in kept]))
    wrong = [
        F.when(F.col("_oversize"), F.lit(f"has a field of more than {REC.MAX_FIELD} characters")),
        F.when(F.col("_fields")[CORRUPT].isNotNull(), F.lit("does not have as many fields as the header")),
        *errors]
    stamped = raw.select(
        *typed, *scales, "source_file", "source_row_number", raw_record.alias("raw_record"),
        (imported_at if imported_at is not None else F.current_timestamp()).alias("imported_at"),
        "source_path", by_header["Record Id"].alias("record_text"),
        F.array_compact(F.array(F.coalesce(*wrong))).alias("_wrong"))
    # generated, so that a filter for rejects reads it and is not pushed below, where it would compute it again
    stamped = stamped.withColumn("reject_message", F.explode_outer("_wrong")).drop("_wrong")
    stamped = stamped.withColumn("reject_reason", F.when(F.col("reject_message").isNotNull(), F.concat(
        F.lit("record "), F.col("source_row_number").cast("string"), F.lit(": "), F.col("reject_message"))))
    return split_rejects(dataset, stamped)


def split_rejects(dataset: str, parsed: DataFrame) -> IngestResult:
    """Accepted rows and rejects of parsed records."""
    rows = parsed.filter(F.col("reject_reason").isNull()).select(*S.stored_columns(dataset))
    rejects = parsed.filter(F.col("reject_reason").isNotNull()).select(
        "source_file", "source_row_number", "record_text", "reject_message", "reject_reason")
    return IngestResult(dataset, rows, rejects, parsed)


def ingest(spark: SparkSession, paths: str | list[str], dataset: str | None = None) -> dict[str, IngestResult]:
    """Header audit, then one typed read per (dataset, header layout).

    Only the audit (one row per file) reaches the driver. Files with a header
    problem raise ``ValueError`` naming them."""
    audit = header_audit(spark, paths).collect()
    bad = [f"{r.file_name}: {r.problem}" for r in audit if r.problem]
    if bad:
        raise ValueError("; ".join(sorted(bad)))
    for r in audit:
        if dataset is not None and r.dataset != dataset:
            raise ValueError(f"{r.file_name}: this is a {r.dataset} export where a {dataset} export belongs.")
    return read_audited(spark, audit)


def read_audited(spark: SparkSession, audit: list) -> dict[str, IngestResult]:
    """Typed reads of audited files without a problem, by dataset."""
    layouts: dict[tuple[str, tuple[str, ...]], list[str]] = {}
    for r in audit:
        layouts.setdefault((r.dataset, tuple(r.headers)), []).append(r.file_path)
    out: dict[str, IngestResult] = {}
    for (ds, headers), files in sorted(layouts.items()):
        res = read_typed(spark, [literal(f) for f in sorted(files)], ds, list(headers))
        if ds in out:
            res = split_rejects(ds, out[ds].parsed.unionByName(res.parsed, allowMissingColumns=True))
        out[ds] = res
    return out


def checksums(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(source_file, sha256, bytes) of each file, hashed as a stream in one task a file."""
    return REC.digests(spark, [paths] if isinstance(paths, str) else list(paths))


def profile(rows: DataFrame, dataset: str) -> DataFrame:
    """The dry-run profile of one dataset in a single aggregation."""
    amount = S.AMOUNT_FIELD[dataset]
    has_tx = dataset != "wallet_master"
    tx = F.col("transaction_id") if has_tx else F.lit(None).cast("string")
    return rows.agg(
        F.lit(dataset).alias("dataset"),
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("zoho_record_id").alias("distinct_record_ids"),
        (F.count(F.lit(1)) - F.count_distinct("zoho_record_id")).alias("duplicate_record_id_rows"),
        (F.count_if(tx.isNull()) if has_tx else F.lit(0).cast("bigint")).alias("missing_transaction_ids"),
        (F.count(tx) - F.count_distinct(tx)).alias("duplicate_transaction_id_rows"),
        F.min("created_on").alias("min_created_on"),
        F.max("created_on").alias("max_created_on"),
        F.lit(amount).alias("amount_field"),
        F.coalesce(F.sum(amount), F.lit(0).cast(S.MONEY)).alias("amount_total_in_source_units"),
    )


def status_counts(rows: DataFrame, dataset: str) -> DataFrame:
    """I10 statuses: status (category for the wallet master), NULL kept."""
    label = F.col("category") if dataset == "wallet_master" else F.col("status")
    return rows.groupBy(label.alias("status")).agg(F.count(F.lit(1)).alias("rows"))


def validate_preview(rows: DataFrame, dataset: str,
                     countries: tuple[str, ...] | None = C.COUNTRIES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(one-row preview, per-country counts, per-status-label counts).

    ``first_bad_country_record`` names the first record outside the country
    domain; a preview with it set, or with zero rows, rejects the file."""
    in_domain = F.col("country").isin(*countries) if countries else F.lit(True)
    label = F.coalesce(F.col("status") if "status" in rows.columns else F.lit(None).cast("string"),
                       F.col("category") if "category" in rows.columns else F.lit(None).cast("string"),
                       F.lit("Unspecified"))
    counts = rows.agg(
        F.lit(dataset).alias("dataset"),
        F.count_if(~in_domain | F.col("country").isNull()).alias("out_of_domain_rows"),
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("zoho_record_id").alias("distinct_record_ids"),
        (F.count(F.lit(1)) - F.count_distinct("zoho_record_id")).alias("duplicate_record_id_rows"),
        F.min(F.when(~in_domain | F.col("country").isNull(), F.col("source_row_number"))).alias("first_bad_country_record"),
        F.min("created_on").alias("min_created_on"),
        F.max("created_on").alias("max_created_on"),
        (F.count(F.lit(1)) >= C.EXPORT_CAP_WARNING_ROWS).alias("export_cap_warning"),
    )
    return counts, rows.groupBy("country").agg(F.count(F.lit(1)).alias("rows")), \
        rows.groupBy(label.alias("status")).agg(F.count(F.lit(1)).alias("rows"))


def export_csv(df: DataFrame, dataset: str, path: str, overrides: dict[str, Column] | None = None,
               extra: dict[str, Column] | None = None, leave_out: tuple[str, ...] = (), folder: str | None = None,
               compression: str = "none") -> None:
    """Write ledger rows as an export with the source headers (test inputs,
    round trips). Text is written verbatim; decimals keep their scale.
    ``overrides`` replace a header's text, ``extra`` adds columns, ``leave_out``
    drops headers, ``folder`` names a column whose values get a folder each."""
    overrides = overrides or {}
    cols = []
    for col, header, kind in S.FIELD_MAPS[dataset]:
        c = F.col(col)
        if kind == "timestamp":
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        c = overrides.get(header, c.cast("string"))
        cols.append(c.cast("string").alias(header))
    for header, c in (extra or {}).items():
        cols.append(c.cast("string").alias(header))
    cols = [c for c, (_, header, _) in zip(cols, S.FIELD_MAPS[dataset]) if header not in leave_out] + cols[len(S.FIELD_MAPS[dataset]):]
    writer = df.select(*cols, *([F.col(folder).alias("folder")] if folder else [])).write.mode("overwrite")
    ((writer.partitionBy("folder") if folder else writer)
     .options(header="true", escape='"', quote='"', ignoreLeadingWhiteSpace="false",
              ignoreTrailingWhiteSpace="false", nullValue="", emptyValue='""', compression=compression)
     .csv(path))


DATASET_MODULES = {"wallet_master": "Wallets", "wallet": "Wallet transactions", "swap": "Swapping transactions"}


def inspect(spark: SparkSession, paths: str | list[str], countries: tuple[str, ...] | None = C.COUNTRIES) -> dict:
    """I11 as a report: validate one export (header audit, typed read, country
    domain, non-empty) and return the preview dict. Raises ``ValueError`` for
    the first rejected record, the first record outside the country domain,
    or a file without data records. Only aggregates reach the driver."""
    results = ingest(spark, paths)
    if len(results) != 1:
        raise ValueError("One export at a time.")
    (dataset, res), = results.items()
    first_reject = res.rejects.orderBy("source_file", "source_row_number").first()
    if first_reject is not None:
        raise ValueError(f"{first_reject.source_file}: {first_reject.reject_reason}")
    counts, by_country, by_status = validate_preview(res.rows, dataset, countries)
    c = counts.first()
    if c.first_bad_country_record is not None:
        raise ValueError(f"Record {c.first_bad_country_record}: the country is none of "
                         f"{', '.join(countries)}.")
    if c.rows == 0:
        raise ValueError("No record follows the headers.")
    return {"dataset": dataset, "module": DATASET_MODULES[dataset], "rows": c.rows,
            "distinct_record_ids": c.distinct_record_ids, "duplicate_record_id_rows": c.duplicate_record_id_rows,
            "countries": {r.country: r.rows for r in by_country.collect()},
            "statuses": {r.status: r.rows for r in by_status.collect()},
            "min_created_on": c.min_created_on.isoformat() if c.min_created_on else None,
            "max_created_on": c.max_created_on.isoformat() if c.max_created_on else None,
            "export_cap_warning": c.export_cap_warning}
