"""Report exports.

Every export is a DataFrame of text columns written by Spark's CSV writer
(many part files, no driver round trip), published atomically as one version
of ``<root>/<report>`` together with its summary row(s).

Text rules (as the reports are read by people and spreadsheets):
* decimals as exact text, times as ISO-8601 (fraction only when non-zero),
  dates as ISO, booleans as True/False;
* arrays as JSON text with ``", "`` between elements (NULL -> ``null``);
* every part file starts with a byte order mark, so that spreadsheets read it as UTF-8;
* optionally, text starting with ``= + - @ TAB CR`` gets a leading quote
  (cell protection; not applied to the command-line review export).
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..functions import rules
from ..operators import counterparts as G
from ..operators import query as Q
from ..operators import review as R
from ..operators.merge import payload_bytes
from ..plans.joins import join_small, written
from . import store

# --- fixed values: exported field list of the review candidates report ------
REVIEW_EXPORT_FIELDS = (
    "country", "wallet_record_id", "transaction_id", "wallet_reference",
    "wallet_id", "wallet_code", "wallet_customer_id", "wallet_customer_reference",
    "wallet_customer_name", "wallet_amount", "wallet_currency", "wallet_created_on",
    "reconciliation_status", "review_reasons", "coverage_assessment",
    "swap_count", "successful_swap_count", "successful_swap_amount",
    "successful_swap_created_on", "swap_references", "successful_payment_methods",
    "customer_mapping_status", "swap_customer_lookup_check", "source_coverage_status",
)
#: What a reader of the missing-counterpart summary must know.
MISSING_NOTES = {
    "matching_rule": "Same country and same Transaction ID, neither blank. Every source Record Id is one row.",
    "wallet_scope": "Wallet transactions that are committed debits settled against a swap.",
    "swap_scope": "Every loaded swap, whatever its status and payment method.",
    "date_filter_rule": "Each group is filtered by its own creation time. Counterparts count on any loaded date.",
    "note": "Missing here means missing from the loaded exports, which does not prove that the source has no record. "
            "Rows without an identifier have a label of their own. A swap paid by other means may rightly have no debit.",
}
REVIEW_NOTE = ("Review candidates require investigation. Source coverage and refund eligibility are not "
               "verified.")
# --- end of fixed values -----------------------------------------------------

BYTE_ORDER_MARK = "\ufeff"
CSV_WRITE = {"header": "true", "escape": '"', "quote": '"', "ignoreLeadingWhiteSpace": "false",
             "ignoreTrailingWhiteSpace": "false", "nullValue": "", "emptyValue": '""'}


def json_list(arr: Column) -> Column:
    """Array -> JSON text with ', ' separators (each element JSON-escaped)."""
    items = F.transform(arr, lambda x: F.regexp_replace(F.to_json(F.array(x)), r"^\[(.*)\]$", "$1"))
    return F.when(arr.isNull(), F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]")))


def text_value(c: Column, dtype: T.DataType, protect: bool) -> Column:
    """E6 (and E5 when ``protect``): one column as report text."""
    if isinstance(dtype, T.ArrayType):
        return json_list(c)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return rules.iso_timestamp(c)
    if isinstance(dtype, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(dtype, T.BooleanType):
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    if isinstance(dtype, T.StringType):
        return rules.protect_cell(c) if protect else c
    return c.cast("string")


def decimal_text(c: Column, dtype: T.DecimalType, scale: Column) -> Column:
    """Exact decimal text with the written scale (the stored type may carry
    more fractional digits: '120.100000' with scale 2 -> '120.10')."""
    text = c.cast("string")
    cut = F.when(scale == 0, F.lit(dtype.scale + 1)).otherwise(F.lit(dtype.scale) - scale)
    return F.when(scale.isNull() | (scale >= dtype.scale) | (dtype.scale == 0), text).otherwise(
        F.left(text, F.length(text) - cut))


def as_text(df: DataFrame, protect: bool = False) -> DataFrame:
    """All columns as report text; ``<col>_scale`` columns shape their decimal
    and are not exported themselves."""
    return df.select(*_text_columns(df, protect))


def _text_columns(df: DataFrame, protect: bool) -> list[Column]:
    names = set(df.columns)
    out = []
    for f in df.schema.fields:
        if f.name.endswith("_scale") and f.name[: -len("_scale")] in names:
            continue
        scale = f.name + "_scale"
        if isinstance(f.dataType, T.DecimalType) and scale in names:
            out.append(decimal_text(F.col(f.name), f.dataType, F.col(scale)).alias(f.name))
        else:
            out.append(text_value(F.col(f.name), f.dataType, protect).alias(f.name))
    return out


def capped(df: DataFrame, cap: int | None = None) -> DataFrame:
    """Refuse an interactive export above ``cap`` rows (counts at most cap+1).

    Without a cap (the default) every row is exported; ``C.MAX_EXPORT`` is the
    cap an interactive caller may set."""
    if cap is not None and df.limit(cap + 1).count() > cap:
        raise ValueError(f"The selection exceeds the export cap of {cap} rows.")
    return df


def review_candidates(recon: DataFrame, filters: Q.ReconciliationFilter | None = None, *,
                      protect: bool = False, cap: int | None = None) -> DataFrame:
    """E1 rows: needs-review debits, fixed fields, record-id order.

    The interactive form protects text cells and may set a ``cap``."""
    r = Q.filtered(recon, filters).filter(F.col("needs_review"))
    scales = [c for c in ("wallet_amount_scale", "successful_swap_amount_scale") if c in r.columns]
    return as_text(capped(r.select(*REVIEW_EXPORT_FIELDS, *scales), cap), protect).orderBy("wallet_record_id")


#: Debits of one key from which on its arrays do not go through the sort with each of them.
SHARED_BY = 16
SHARED_BYTES = 64 * 1024 * 1024
#: Bytes of such keys' arrays to a task that writes them: a columnar file's dictionary of 1 MB holds them with room to spare.
SHARED_TASK_BYTES = 128 * 1024


def grouped_review(led, review: Callable[..., DataFrame], shown: Callable[[Column], Column], *,
                   max_bytes: int = SHARED_BYTES, **more) -> DataFrame:
    """The rows of ``review(led, shown=shown, **more)`` for outputs that hold its arrays.

    A key that many debits share shows the same long texts on each of them. Amid the short texts of other keys a
    columnar file writes them out once per debit; so the rows of such keys go to tasks of their own, in order of the key, and
    get their texts there, broadcast up to ``max_bytes`` (above that, all rows come as the review gives them)."""
    shared, size = _shared(R.shared_arrays(led, SHARED_BY, shown), max_bytes)
    if shared is None:
        return review(led, shown=shown, **more)
    keys = shared.select("_c", "_t")

    def of(how: str) -> R.Ledgers:
        return R.Ledgers(led.wallets, *[df.join(F.broadcast(keys), _on_key(), how) for df in (led.wallet_transactions, led.swap_transactions)])

    rows = review(of("left_anti"), shown=shown, **more)
    full = _with_shared(review(of("left_semi"), **more).drop(*R.LISTED.values()), shared, size)
    return rows.unionByName(full.select(*rows.columns))


def grouped_rows(lean: DataFrame, values: DataFrame, shown: Callable[[Column], Column], *, max_bytes: int = SHARED_BYTES) -> DataFrame:
    """``review.with_arrays`` of a stored review and its ``key_values``, the rows of shared keys as in ``grouped_review``."""
    keys = lean.groupBy(F.col("country").alias("_pc"), F.col("transaction_id").alias("_pt")).agg(F.count(F.lit(1)).alias("_n")) \
        .where(F.col("_n") > SHARED_BY).select("_pc", "_pt")
    listed = join_small(values, keys, (F.col("country") == F.col("_pc")) & (F.col("transaction_id") == F.col("_pt")), "left_semi")
    shared, size = _shared(R.arrays_by_key(listed, shown), max_bytes)
    if shared is None:
        return R.with_arrays(lean, values, shown)
    keys = F.broadcast(shared.select("_c", "_t"))
    rows = R.with_arrays(lean.join(keys, _on_key(), "left_anti"), values.join(keys, _on_key(), "left_anti"), shown)
    full = _with_shared(lean.join(keys, _on_key(), "left_semi"), shared, size)
    return rows.unionByName(full.select(*rows.columns))


def _on_key() -> Column:
    return (F.col("country") == F.col("_c")) & (F.col("transaction_id") == F.col("_t"))


def _shared(arrays: DataFrame, max_bytes: int) -> tuple[DataFrame | None, int]:
    """The arrays of shared keys, written, and their bytes; ``None`` if there are none or too many to broadcast."""
    shared = written(arrays, "shared")
    found = shared.agg(payload_bytes(shared).alias("b"), F.count(F.lit(1)).alias("n")).first()
    return (shared if found.n and found.b <= max_bytes else None), found.b or 0


def _with_shared(lean: DataFrame, shared: DataFrame, size: int) -> DataFrame:
    """The rows of shared keys with their arrays; rows of a key may go to several tasks, a task has those of few keys."""
    tasks = max(lean.sparkSession.sparkContext.defaultParallelism, size // SHARED_TASK_BYTES + 1)
    return lean.repartitionByRange(tasks, "country", "transaction_id", "wallet_record_id").join(F.broadcast(shared), _on_key())


def live_candidates(led, filters: Q.ReconciliationFilter | None = None, *, protect: bool = False,
                    cap: int | None = None, max_bytes: int = SHARED_BYTES) -> DataFrame:
    """``review_candidates`` of the live ledgers. A key that many debits share would bring its arrays into the
    sort once per debit; these join the sorted rows instead, broadcast up to ``max_bytes``."""
    shared = written(R.shared_arrays(led, SHARED_BY, json_list).drop("customer_ids"), "shared")
    if (shared.agg(payload_bytes(shared).alias("b")).first().b or 0) > max_bytes:
        return review_candidates(R.backend_reconciliation(led, shown=json_list), filters, protect=protect, cap=cap)
    recon = R.backend_reconciliation(led, shown=lambda arr: F.when(F.col("wallet_count") <= SHARED_BY, json_list(arr)))
    rows = capped(Q.filtered(recon, filters).filter(F.col("needs_review")), cap)
    text = _text_columns(rows.select(*REVIEW_EXPORT_FIELDS, "wallet_amount_scale", "successful_swap_amount_scale"), protect)
    ordered = rows.select(*text, F.col("country").alias("_kc"), F.col("transaction_id").alias("_kt")).orderBy("wallet_record_id")
    # a generated row, as the optimizer takes a sort right below a join away; a broadcast join keeps the order
    ordered = ordered.withColumn("_row", F.explode(F.array(F.lit(0))))
    names = [c for c in shared.columns if c in REVIEW_EXPORT_FIELDS]
    shared = shared.withColumnsRenamed({c: f"_s_{c}" for c in names})
    j = ordered.join(F.broadcast(shared), (F.col("_kc") == F.col("_c")) & (F.col("_kt") == F.col("_t")), "left")
    return j.select(*[F.coalesce(c, f"_s_{c}").alias(c) if c in names else F.col(c) for c in REVIEW_EXPORT_FIELDS])


def with_mark(df: DataFrame) -> DataFrame:
    """The byte order mark before the header line: part of the first column's name."""
    return df.withColumnRenamed(df.columns[0], BYTE_ORDER_MARK + df.columns[0])


def _publish(spark: SparkSession, root: str, report: str, parts: dict[str, DataFrame],
             summary: dict | Callable[[], dict]) -> int:
    """Write the parts, then the summary (a dict, or a function called after
    the parts are written -- it may refuse to publish by raising), then the
    commit marker that makes the report visible."""
    version = (store.latest_version(spark, root, report) or 0) + 1
    attempt = store.new_attempt(version)
    base = f"{root}/{report}/v={attempt}"
    for name, df in parts.items():
        with_mark(df).write.mode("errorifexists").options(**CSV_WRITE).csv(f"{base}/{name}")
    summary = summary() if callable(summary) else summary
    spark.createDataFrame([(json.dumps(summary, ensure_ascii=False, default=str),)], "summary string") \
        .coalesce(1).write.mode("errorifexists").text(f"{base}/summary")
    store.mark(spark, root, report, version, attempt, report)
    return version


def write_review_report(spark: SparkSession, recon: DataFrame, root: str,
                        filters: Q.ReconciliationFilter | None = None, candidates: DataFrame | None = None) -> dict:
    """E1 + E2: candidates CSV and the summary JSON, published together only if
    the candidate count equals the summary's needs-review count. ``candidates``: the
    rows of ``review_candidates`` made otherwise (``live_candidates``)."""
    filters = filters or Q.ReconciliationFilter()
    summary = Q.summary(recon, filters)
    # the candidates are counted by their own write; the check runs before
    # the commit marker, so a disagreeing export is never published
    counted = Observation("candidates")
    candidates = review_candidates(recon, filters) if candidates is None else candidates
    candidates = candidates.observe(counted, F.count(F.lit(1)).alias("rows"))

    def checked_summary() -> dict:
        count = counted.get["rows"]
        if count != summary["needs_review_count"]:
            raise RuntimeError(f"{count} exported candidates: the count does not agree with the summary's.")
        summary.update(generated_at_utc=dt.datetime.now(dt.timezone.utc).isoformat(), candidate_count=count,
                       note=REVIEW_NOTE)
        return summary

    summary["version"] = _publish(spark, root, "reconciliation_report", {"review_candidates": candidates},
                                  checked_summary)
    return summary


def gap_statistics(stats: DataFrame) -> dict:
    """G14 rows (group, dimension, key, records) -> nested dict (bounded size)."""
    out: dict = {}
    for r in stats.collect():
        g = out.setdefault(r["group"], {})
        if r["dimension"] == "rows":
            g["rows"] = r["records"]
        else:
            g.setdefault(r["dimension"], {})[r["key"]] = r["records"]
    return out


def write_missing_reports(spark: SparkSession, led, root: str,
                          filters: Q.ReconciliationFilter | None = None) -> dict:
    """Both gap reports (protected text) + summary, published together."""
    filters = filters or Q.ReconciliationFilter()
    parts, stats = {}, None
    for side in (G.WALLET_SIDE, G.SWAP_SIDE):
        rep = written(G.report_filter(G.gap_report(led, side), side, filters, order=None), "gaps")
        s = G.report_statistics(rep, side)
        stats = s if stats is None else stats.unionByName(s)
        parts[side] = as_text(G.report_filter(rep, side), protect=True)
    summary = {"generated_at_utc": dt.datetime.now(dt.timezone.utc).isoformat(),
               "filters": filters.as_dict(), "source_coverage_status": C.NOT_VERIFIED,
               **MISSING_NOTES, "groups": gap_statistics(stats)}
    for side, group in summary["groups"].items():
        group["file"] = side
    summary["version"] = _publish(spark, root, "missing_counterparts", parts, summary)
    return summary


def tracking_export(led, group: str, filters: Q.ReconciliationFilter | None = None,
                    cap: int | None = None) -> DataFrame:
    """E4 + E5: one tracking group's detail rows as protected text, up to ``cap`` rows if given."""
    if group not in C.TRACKING_GROUPS:
        raise ValueError("Choose a known counterpart tracking group.")
    side, cls = C.TRACKING_GROUPS[group]
    rows = G.report_filter(G.gap_report(led, side), side, filters, classification=cls, order=None)
    return as_text(capped(rows, cap), protect=True)
