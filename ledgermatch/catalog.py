"""Registered queries: one entry per operator, each ``(spark, sf_dir) -> DataFrame``.

Queries run on the three ledgers derived from the driver's tables (see
``sources.adapter``). For value comparison with the SQL oracle, array columns
are rendered as text (``'|'``-joined, NULL elements as ``<null>``) and the
load-clock column ``imported_at`` is left out.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schema as S
from .functions import arrays, rules
from .operators import counterparts as G
from .operators import query as Q
from .operators import reports as X
from .operators import review as R
from .sources import adapter

# --- fixed values: parameters of the registered example queries -----------
ADAPTER_COUNTRIES = tuple(f"NATION_{i}" for i in range(25))
FILTER_COUNTRY = "NATION_7"
FILTER_START = "1996-01-01"
FILTER_END = "1997-06-30"
PAGE_LIMIT = 100
PAGE_CURSOR = "wt-5000"
DETAIL_RECORD = "wt-1"
DAY_COUNTRY = "NATION_24"
DAY_START = dt.date(1998, 1, 1)
DAY_END = dt.date(1998, 2, 1)
GAP_COUNTRY = "NATION_3"
GAP_START = "1996-01-01"
GAP_END = "1998-12-31"
TRACKING_GROUP = "swap_without_wallet"
TRACKING_LIMIT = 50
TRACKING_AFTER_GROUP = "wallet_without_swap"
TRACKING_AFTER_LIMIT = 100
TRACKING_CURSOR = "wt-5000"
# --- end of fixed values ----------------------------------------------------

Query = Callable[[SparkSession, str], DataFrame]


_LEDGERS: dict[tuple[int, str, str], adapter.StoredLedgers] = {}


def ledgers(spark: SparkSession, sf_dir: str) -> adapter.StoredLedgers:
    """The stored ledgers derived from ``sf_dir`` (each derived on first use; the
    DataFrames -- plans over the stored files -- are reused within a session)."""
    key = (id(spark), sf_dir, adapter._signature(sf_dir))
    if key not in _LEDGERS:
        _LEDGERS[key] = adapter.StoredLedgers(spark, sf_dir)
    return _LEDGERS[key]


def comparable(df: DataFrame) -> DataFrame:
    """Arrays as text; load-clock timestamps and written-scale columns dropped."""
    cols = []
    for f in df.schema.fields:
        if f.name.endswith("imported_at") or f.name.endswith("_scale"):
            continue
        if isinstance(f.dataType, T.ArrayType):
            cols.append(arrays.render(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def _filters(**kw) -> Q.ReconciliationFilter:
    return Q.ReconciliationFilter(countries=ADAPTER_COUNTRIES, **kw)


REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Callable[[R.Ledgers], DataFrame]):
        REGISTRY[name] = lambda spark, sf_dir: comparable(fn(ledgers(spark, sf_dir)))
        return fn
    return deco


# --- R1-R13 -----------------------------------------------------------------

@register("eligible_debits")
def _eligible(led):
    return R.eligible_debits(led.wallet_transactions).select(
        "zoho_record_id", "transaction_id", "country", "wallet_id", "amount", "created_on")


@register("swap_groups")
def _swap_groups(led):
    return R.swap_groups(led.swap_transactions)


@register("swap_key_values")
def _key_values(led):
    return R.key_values(led)


@register("wallet_dup_window")
def _dup_window(led):
    return R.wallet_swap_review(led).select("wallet_record_id", "country", "transaction_id", "wallet_count")


@register("wallet_swap_review")
def _wallet_swap_review(led):
    return E.grouped_review(led, R.wallet_swap_review, arrays.render)


@register("reconciliation_status")
def _status(led):
    return R.wallet_swap_review(led).select("wallet_record_id", "reconciliation_status")


@register("payment_method_review")
def _payment(led):
    return R.wallet_swap_review(led).select("wallet_record_id", "successful_swap_count",
                                            "successful_payment_methods", "payment_method_needs_review")


@register("customer_review")
def _customer_review(led):
    return E.grouped_review(led, R.customer_review, arrays.render)


@register("customer_mapping_status")
def _mapping(led):
    return R.customer_review(led).select("wallet_record_id", "wallet_id", "country", "customer_mapping_status")


@register("customer_lookup_check")
def _lookup(led):
    return E.grouped_review(led, R.customer_review, arrays.render).select(
        "wallet_record_id", "wallet_customer_id", "customer_ids", "swap_customer_lookup_check")


@register("observed_bounds")
def _bounds(led):
    return R.observed_bounds(led.swap_transactions)


@register("review_reasons")
def _reasons(led):
    return R.backend_reconciliation(led).select("wallet_record_id", "review_reasons", "needs_review")


@register("coverage_assessment")
def _coverage(led):
    return R.backend_reconciliation(led).select("wallet_record_id", "wallet_created_on", "observed_first_swap",
                                                "observed_last_swap", "coverage_assessment")


@register("backend_reconciliation")
def _backend(led):
    return E.grouped_review(led, R.backend_reconciliation, arrays.render, bounds_from=led.swap_transactions)


# --- Q1-Q7 ------------------------------------------------------------------

def _recon(led):
    return R.backend_reconciliation(led)


def _page(led, **kw):
    """A page of the reconciliation: chosen without the arrays, which its rows then get."""
    page = Q.page_frame(_recon(led).drop(*R.LISTED.values()), limit=PAGE_LIMIT, **kw)
    return R.with_page_arrays(page, led).select(*Q.DETAIL_FIELDS, *Q.DETAIL_SCALES)


@register("filter_country_date_status")
def _filter(led):
    f = _filters(country=FILTER_COUNTRY, start_date=FILTER_START, end_date=FILTER_END)
    return Q.filtered(_recon(led), f).select(*Q.DETAIL_FIELDS)


@register("summary_groups")
def _summary_groups(led):
    return Q.summary_groups(_recon(led))


@register("summary_totals")
def _summary_totals(led):
    return Q.summary_totals(Q.summary_groups(_recon(led)))


@register("page_first")
def _page_first(led):
    return _page(led)


@register("page_after_cursor")
def _page_after(led):
    return _page(led, after_record_id=PAGE_CURSOR)


@register("page_review_only")
def _page_review(led):
    return _page(led, review_only=True)


@register("record_detail")
def _detail(led):
    return Q.record_detail(R.record_detail_live(led, DETAIL_RECORD), DETAIL_RECORD, countries=ADAPTER_COUNTRIES)


@register("overview_cards")
def _cards(led):
    return Q.overview_cards(Q.summary_groups(_recon(led)))


@register("overview_by_country")
def _by_country(led):
    return Q.overview_by_country(Q.summary_groups(_recon(led)))


# --- G1-G14 -----------------------------------------------------------------

@register("wallet_without_swap")
def _wallet_gaps(led):
    return G.wallet_without_swap(led)


@register("swap_without_wallet")
def _swap_gaps(led):
    return G.swap_without_wallet(led)


@register("gap_reason")
def _gap_reason(led):
    w = G.wallet_without_swap(led).select(F.lit("wallet").alias("side"), F.col("wallet_record_id").alias("record_id"),
                                          "missing_counterpart_reason")
    s = G.swap_without_wallet(led).select(F.lit("swap").alias("side"), F.col("swap_record_id").alias("record_id"),
                                          "missing_counterpart_reason")
    return w.unionByName(s)


@register("gap_date_context")
def _gap_date(led):
    w = G.wallet_without_swap(led).select(
        F.lit("wallet").alias("side"), F.col("wallet_record_id").alias("record_id"), "created_on",
        F.col("observed_first_swap").alias("first_seen"), F.col("observed_last_swap").alias("last_seen"),
        "date_context")
    s = G.swap_without_wallet(led).select(
        F.lit("swap").alias("side"), F.col("swap_record_id").alias("record_id"), "created_on",
        F.col("observed_first_wallet_deduction").alias("first_seen"),
        F.col("observed_last_wallet_deduction").alias("last_seen"), "date_context")
    return w.unionByName(s)


@register("customer_rollup")
def _rollup(led):
    return G.customer_rollup(led.wallets)


@register("gap_customer_name")
def _gap_name(led):
    return G.swap_without_wallet(led).select("swap_record_id", "customer_id", "customer_name")


@register("gap_currency")
def _gap_currency(led):
    return G.swap_without_wallet(led).select("swap_record_id", "currency", "currency_candidates")


@register("wallet_payment_expected")
def _payment_expected(led):
    return G.swap_without_wallet(led).select("swap_record_id", "swap_status", "payment_method",
                                             "wallet_payment_expected")


def _id_class(led, valid: bool):
    cond = rules.valid_identifiers(F.col("transaction_id"), F.col("country"))
    cond = cond if valid else ~cond
    w = R.eligible_debits(led.wallet_transactions).filter(cond).select(
        F.lit("wallet").alias("side"), "zoho_record_id", "country", "transaction_id")
    s = led.swap_transactions.filter(cond).select(
        F.lit("swap").alias("side"), "zoho_record_id", "country", "transaction_id")
    return w.unionByName(s)


@register("gap_valid_ids")
def _valid_ids(led):
    return _id_class(led, True)


@register("gap_unmatchable_ids")
def _unmatchable_ids(led):
    return _id_class(led, False)


@register("tracking_ids")
def _tracking_ids(led):
    parts = [G.tracking_ids(led, side, cls, _filters()).select(F.lit(group).alias("group"), "country",
                                                                "zoho_record_id")
             for group, (side, cls) in G.C.TRACKING_GROUPS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("gap_filtered")
def _gap_filtered(led):
    f = _filters(country=GAP_COUNTRY, start_date=GAP_START, end_date=GAP_END)
    return G.report_filter(G.wallet_without_swap(led), G.WALLET_SIDE, f)


@register("tracking_summary")
def _tracking_summary(led):
    return G.tracking_summary(led, _filters())


@register("tracking_page")
def _tracking_page(led):
    return G.tracking_page_frame(led, TRACKING_GROUP, _filters(), limit=TRACKING_LIMIT)


@register("tracking_page_after")
def _tracking_page_after(led):
    return G.tracking_page_frame(led, TRACKING_AFTER_GROUP, _filters(), limit=TRACKING_AFTER_LIMIT,
                                 cursor=TRACKING_CURSOR)


@register("missing_report_stats")
def _report_stats(led):
    return G.report_statistics(G.wallet_without_swap(led), G.WALLET_SIDE).unionByName(
        G.report_statistics(G.swap_without_wallet(led), G.SWAP_SIDE))


# --- X1-X16, I17, I19 ---------------------------------------------------------

@register("x_dataset_counts")
def _x1(led):
    return X.dataset_counts(led)


@register("x_status_counts")
def _x2(led):
    return X.status_counts(led)


@register("x_coverage_notes")
def _x3(led):
    return X.coverage_notes(led)


@register("x_day_candidates")
def _x4(led):
    return X.day_candidates(led, DAY_COUNTRY, DAY_START, DAY_END)


@register("x_payment_review")
def _x5(led):
    return X.payment_review_rows(led)


@register("x_missing_tx_by_method")
def _x6(led):
    return X.missing_tx_by_method(led)


@register("x_dup_wallet_tx")
def _x7(led):
    return X.duplicate_transaction_ids(led.wallet_transactions)


@register("x_dup_swap_tx")
def _x8(led):
    return X.duplicate_transaction_ids(led.swap_transactions)


@register("x_wallets_by_country")
def _x10(led):
    return X.wallets_by_country(led)


@register("x_mapping_counts")
def _x11(led):
    return X.mapping_counts(led)


@register("x_status_mapping")
def _x12(led):
    return X.status_mapping_counts(led)


@register("x_in_span_candidates")
def _x13(led):
    return X.in_span_candidates(led)


@register("x_lookup_among_matched")
def _x14(led):
    return X.lookup_among_matched(led)


@register("x_amounts_by_currency")
def _x15(led):
    return X.amounts_by_currency(led)


@register("x_wallets_by_currency")
def _x16(led):
    return X.wallets_by_currency(led)


@register("source_inventory")
def _i17(led):
    return X.source_inventory(led)


@register("post_load_counts")
def _i19(led):
    return X.post_load_counts(led)


# --- I1-I16, I18: ingest and versioned merge ----------------------------------
# Inputs are CSV exports that Spark writes from the stored ledgers (clean, a
# master export with a Wallet Pin column, and a deterministically corrupted
# wallet export); see ``adapter.exports``.

from .operators import merge as M  # noqa: E402
from .sinks import store  # noqa: E402
from .session import scratch_path  # noqa: E402
from .sources import csv_ingest as I  # noqa: E402


def _ingested(spark, sf_dir, name: str, dataset: str) -> I.IngestResult:
    base = adapter.exports(spark, sf_dir, name)
    return I.ingest(spark, f"{base}/{name}/*.csv", dataset)[dataset]


def register_raw(name: str):
    """Queries that need the session and folder themselves (ingest, merge)."""
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        REGISTRY[name] = lambda spark, sf_dir: comparable(fn(spark, sf_dir))
        return fn
    return deco


@register_raw("ingest_typed_scan")
def _ingest_typed(spark, sf_dir):
    rows = _ingested(spark, sf_dir, "swap", "swap").rows
    return rows.select("zoho_record_id", "transaction_id", "country", "status", "created_on", "swap_amount",
                       "swap_date", "payment_method", "customer_id", "customer_name", "station_label")


@register_raw("ingest_field_parse")
def _ingest_parse(spark, sf_dir):
    p = _ingested(spark, sf_dir, "dirty_wallet", "wallet").parsed
    return p.select("record_text", "amount", "created_on", "source_modified_at", "reject_message")


@register_raw("ingest_rejects")
def _ingest_rejects(spark, sf_dir):
    return _ingested(spark, sf_dir, "dirty_wallet", "wallet").rejects.select("record_text", "reject_message")


@register_raw("ingest_drop_sensitive")
def _ingest_sensitive(spark, sf_dir):
    rows = _ingested(spark, sf_dir, "wallet_master", "wallet_master").rows
    return rows.select("zoho_record_id", F.col("raw_record").contains("Wallet Pin").alias("pin_in_raw"),
                       F.lit(any("pin" in c.lower() for c in rows.columns)).alias("pin_column"))


@register_raw("ingest_raw_record")
def _ingest_raw(spark, sf_dir):
    return _ingested(spark, sf_dir, "wallet_master", "wallet_master").rows.select("zoho_record_id", "raw_record")


def _folder():
    return F.regexp_extract("file_path", r"/([^/]+)/[^/]+$", 1).alias("folder")


def _headers(spark, sf_dir):
    """The header audit of all exports. Only the first record of a file is read, so they are compressed ones."""
    return I.header_audit(spark, f"{adapter.exports(spark, sf_dir, compression='gzip')}/*/*.csv.gz")


@register_raw("ingest_header_check")
def _ingest_headers(spark, sf_dir):
    """What the headers of every export folder say; files of a folder must agree."""
    a = _headers(spark, sf_dir)
    missing = F.concat_ws("|", I.missing_headers(F.col("headers"), "wallet"))
    return a.select(_folder(), F.size("headers").cast("long").alias("columns"), "duplicate_headers",
                    F.col("problem").isNotNull().alias("refused"), missing.alias("missing_for_wallet")).distinct()


@register_raw("ingest_detect")
def _ingest_detect(spark, sf_dir):
    a = _headers(spark, sf_dir)
    return a.select(_folder(), "candidate_datasets", "dataset").distinct()


def _export_order(rows: DataFrame) -> DataFrame:
    """Adds ``export_record``: a file's record numbers follow those of the files before it, as the export
    is in order; ``gapless`` says that the file's numbers have no hole."""
    sizes = rows.groupBy("source_file").agg(F.count(F.lit(1)).alias("n"), F.max("source_row_number").alias("last"))
    before = Window.orderBy("source_file").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    sizes = sizes.select("source_file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"),
                         (F.col("n") == F.col("last")).alias("gapless"))
    return rows.join(sizes, "source_file").withColumn("export_record", F.col("_before") + F.col("source_row_number")).drop("_before")


@register_raw("ingest_provenance")
def _ingest_provenance(spark, sf_dir):
    rows = _ingested(spark, sf_dir, "wallet", "wallet").rows.select("zoho_record_id", "source_file", "source_row_number")
    return _export_order(rows).select("zoho_record_id", "export_record", "gapless")


@register_raw("ingest_checksum")
def _ingest_checksum(spark, sf_dir):
    """Digest and length of the file of every nation's wallets."""
    sums = I.checksums(spark, f"{adapter.exports(spark, sf_dir, "master_by_country")}/master_by_country/*/*.csv")
    return sums.select(F.regexp_extract("file_path", r"folder=([^/]+)/", 1).alias("country"), "sha256", "bytes")


def _profile(dataset, folder):
    def fn(spark, sf_dir):
        return I.profile(_ingested(spark, sf_dir, folder, dataset).rows, dataset)
    return fn


@register_raw("profile_statuses")
def _profile_statuses(spark, sf_dir):
    parts = [I.status_counts(_ingested(spark, sf_dir, ds, ds).rows, ds).select(F.lit(ds).alias("dataset"), "*")
             for ds in S.LOAD_ORDER]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


register_raw("profile_wallet")(_profile("wallet", "wallet"))
register_raw("profile_swap")(_profile("swap", "swap"))
register_raw("profile_wallet_master")(_profile("wallet_master", "wallet_master"))


@register_raw("validate_preview")
def _preview(spark, sf_dir):
    rows = _export_order(_ingested(spark, sf_dir, "swap", "swap").rows).withColumn("source_row_number", F.col("export_record"))
    counts, _, _ = I.validate_preview(rows, "swap", ADAPTER_COUNTRIES)
    return counts


@register_raw("validate_preview_countries")
def _preview_countries(spark, sf_dir):
    _, countries, statuses = I.validate_preview(_ingested(spark, sf_dir, "swap", "swap").rows, "swap",
                                                ADAPTER_COUNTRIES)
    return countries.select(F.lit("country").alias("kind"), F.col("country").alias("label"), "rows").unionByName(
        statuses.select(F.lit("status").alias("kind"), F.col("status").alias("label"), "rows"))


@register("dedup_latest")
def _dedup(led):
    return M.latest_per_record(adapter.revisions(led.wallet_transactions)).select(
        "zoho_record_id", "status", "source_modified_at", "source_row_number")


@register("merge_upsert")
def _upsert(led):
    merged = M.merge(led.wallet_transactions, adapter.revisions(led.wallet_transactions))
    return merged.select("zoho_record_id", "status", "source_modified_at", "source_row_number",
                         F.col("_applied").alias("applied"))


@register("merge_idempotent")
def _idempotent(led):
    incoming = adapter.revisions(led.wallet_transactions)
    first = M.merge(led.wallet_transactions, incoming)
    second = M.merge(first.drop("_applied"), incoming)
    both = first.select(F.lit(1).alias("r"), F.col("_applied").alias("a1"), F.lit(False).alias("a2")).unionByName(
        second.select(F.lit(0).alias("r"), F.lit(False).alias("a1"), F.col("_applied").alias("a2")))
    return both.agg(F.sum("r").cast("long").alias("rows"), F.count_if("a1").alias("first_applied"),
                    F.count_if("a2").alias("second_applied"))


_LOADED: dict[tuple[int, str], str] = {}


def _loaded_store(spark, sf_dir) -> str:
    """A store filled by one configured batch load of the clean exports
    (once per session and folder)."""
    key = (id(spark), sf_dir)
    if key not in _LOADED:
        base = adapter.exports(spark, sf_dir, "wallet_master", "wallet", "late_wallet", "swap")
        root = scratch_path(spark, "store")
        # the wallet export and a later one with revised records: two files of one merge
        files = {ds: [f"{base}/{ds}/*.csv"] for ds in ("wallet_master", "wallet", "swap")}
        files["wallet"].append(f"{base}/late_wallet/*.csv")
        M.batch_load(spark, root, files)
        _LOADED[key] = root
    return _LOADED[key]


# Part-file names and digests are random per export run: compared columns
# leave them out (they are checked by ``ingest_checksum`` / tests).
AUDIT_COLS = ["batch_id", "dataset", "rows_read", "rows_applied", "min_created_on", "max_created_on"]


@register_raw("dry_run_profiles")
def _dry_run(spark, sf_dir):
    base = adapter.exports(spark, sf_dir, "swap", "late_wallet", "wallet")
    out = M.dry_run(spark, {"swap": [f"{base}/swap/*.csv"], "wallet": [f"{base}/late_wallet/*.csv", f"{base}/wallet/*.csv"]})
    return out.drop("file", "amount_field")


@register_raw("batch_load")
def _batch_load(spark, sf_dir):
    """What the load put into the three tables: rows, ids, span and amounts read back."""
    root = _loaded_store(spark, sf_dir)
    parts = []
    for ds, t in S.TABLES.items():
        rows = store.read(spark, root, t, S.table_schema(ds))
        parts.append(rows.agg(
            F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("rows"),
            F.count_distinct("zoho_record_id").alias("record_ids"), F.min("created_on").alias("first"),
            F.max("created_on").alias("last"), F.sum(S.AMOUNT_FIELD[ds]).cast(S.MONEY).alias("amounts")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register_raw("import_audit")
def _import_audit(spark, sf_dir):
    return M.import_batches(spark, _loaded_store(spark, sf_dir)).select(*AUDIT_COLS)


@register_raw("recent_imports")
def _recent(spark, sf_dir):
    return M.recent_imports(spark, _loaded_store(spark, sf_dir)).select(*AUDIT_COLS, "module")


@register_raw("x_batch_log")
def _x9(spark, sf_dir):
    return M.import_batches(spark, _loaded_store(spark, sf_dir)).orderBy(F.desc("batch_id")).select(*AUDIT_COLS)


@register_raw("merge_atomic")
def _atomic(spark, sf_dir):
    """The stored wallet transactions before and after a strict import of the corrupted export."""
    base = adapter.exports(spark, sf_dir, "wallet", "dirty_wallet")
    root = scratch_path(spark, "store")
    M.import_file(spark, root, f"{base}/wallet/*.csv", "wallet")

    def stored(moment: str) -> DataFrame:
        rows = store.read(spark, root, "wallet_transactions", S.table_schema("wallet"))
        rows = rows.select(F.lit(1).alias("r"), F.lit(0).alias("b"), "amount")
        batches = M.import_batches(spark, root).select(F.lit(0).alias("r"), F.lit(1).alias("b"), F.lit(None).cast(S.MONEY).alias("amount"))
        return rows.unionByName(batches).agg(
            F.lit(moment).alias("moment"), F.sum("r").cast("long").alias("rows"), F.sum("b").cast("long").alias("batches"),
            F.sum("amount").cast(S.MONEY).alias("amounts"))

    before = stored("before")
    failed = M.import_files(spark, root, [f"{base}/dirty_wallet/*.csv"], "wallet")
    if not failed[0]["error"]:
        raise ValueError("the corrupted export was not refused")
    return before.unionByName(stored("after"))


# --- M1-M5 gold tables, E1-E6 exports -------------------------------------------

from .sinks import exports as E  # noqa: E402
from .sinks import gold as GOLD  # noqa: E402

# column kinds of the exported reports (for the text rules): s text, d decimal,
# t timestamp, a array, b boolean, n integer, dt date
WALLET_GAP_KINDS = [("country", "s"), ("wallet_record_id", "s"), ("transaction_id", "s"), ("wallet_reference", "s"),
                    ("wallet_id", "s"), ("wallet_code", "s"), ("customer_id", "s"), ("customer_reference", "s"),
                    ("customer_name", "s"), ("wallet_amount", "d"), ("currency", "s"), ("created_on", "t"),
                    ("wallet_status", "s"), ("transaction_type", "s"), ("settled_against", "s"),
                    ("missing_counterpart_reason", "s"), ("observed_first_swap", "t"), ("observed_last_swap", "t"),
                    ("date_context", "s"), ("source_file", "s"), ("source_row_number", "n"),
                    ("source_coverage_status", "s")]
SWAP_GAP_KINDS = [("country", "s"), ("swap_record_id", "s"), ("transaction_id", "s"), ("swap_reference", "s"),
                  ("customer_id", "s"), ("customer_name", "s"), ("mapped_customer_references", "a"),
                  ("mapped_wallet_record_ids", "a"), ("swap_amount", "d"), ("currency", "s"),
                  ("currency_candidates", "a"), ("created_on", "t"), ("swap_date", "dt"), ("swap_status", "s"),
                  ("payment_method", "s"), ("wallet_payment_expected", "b"), ("vehicle_registration", "s"),
                  ("station_label", "s"), ("station_code", "s"), ("city", "s"), ("missing_counterpart_reason", "s"),
                  ("observed_first_wallet_deduction", "t"), ("observed_last_wallet_deduction", "t"),
                  ("date_context", "s"), ("source_file", "s"), ("source_row_number", "n"),
                  ("source_coverage_status", "s")]
REVIEW_EXPORT_KINDS = [(c, {"wallet_amount": "d", "successful_swap_amount": "d", "wallet_created_on": "t",
                            "successful_swap_created_on": "t", "review_reasons": "a", "swap_references": "a",
                            "successful_payment_methods": "a", "swap_count": "n",
                            "successful_swap_count": "n"}.get(c, "s")) for c in E.REVIEW_EXPORT_FIELDS]
DETAIL_KINDS = [(c, {"wallet_amount": "d", "successful_swap_amount": "d", "wallet_created_on": "t",
                     "successful_swap_created_on": "t", "observed_first_swap": "t", "observed_last_swap": "t",
                     "wallet_mapping_modified_at": "t", "review_reasons": "a", "swap_references": "a",
                     "successful_payment_methods": "a", "swap_count": "n", "successful_swap_count": "n",
                     "wallet_count": "n", "needs_review": "b"}.get(c, "s")) for c in Q.DETAIL_FIELDS]
EXPORT_GROUP = "unmatchable_wallets"
CAPPED_GROUP = "unmatchable_swaps"


def _gold_root(spark, sf_dir) -> str:
    """Gold of the stored ledgers of ``sf_dir``, refreshed when stale."""
    from .session import work_root

    root = f"{work_root(spark)}/gold-{adapter._signature(sf_dir)}"
    GOLD.refresh(spark, root, ledgers(spark, sf_dir), revision=adapter._signature(sf_dir))
    return root


@register_raw("gold_reconciliation")
def _gold_recon(spark, sf_dir):
    return GOLD.read(spark, _gold_root(spark, sf_dir), "reconciliation", shown=arrays.render, joined=E.grouped_rows)


@register_raw("gold_wallet_gaps")
def _gold_wallet(spark, sf_dir):
    return GOLD.read(spark, _gold_root(spark, sf_dir), "wallet_gaps")


@register_raw("gold_swap_gaps")
def _gold_swap(spark, sf_dir):
    return GOLD.read(spark, _gold_root(spark, sf_dir), "swap_gaps")


@register_raw("gold_summary_groups")
def _gold_summary(spark, sf_dir):
    return Q.summary_groups(GOLD.read(spark, _gold_root(spark, sf_dir), "reconciliation", arrays=False))


@register_raw("gold_tracking_summary")
def _gold_tracking(spark, sf_dir):
    return G.tracking_summary(None, _filters(), gaps=GOLD.gap_tables(spark, _gold_root(spark, sf_dir)))


@register_raw("gold_equals_live")
def _gold_live(spark, sf_dir):
    """Rows of each stored table, and rows that only it or only the live result has."""
    root = _gold_root(spark, sf_dir)
    out = None
    # an array stands for itself by its digest, made once per key and not once per debit
    digest = {"shown": lambda arr: F.sha2(arrays.render(arr), 256)}
    for name, live in GOLD.build(ledgers(spark, sf_dir), **digest).items():
        gold = GOLD.read(spark, root, name, **digest)
        row = GOLD.difference(comparable(live), comparable(gold)).select(
            F.lit(name).alias("table_name"), F.col("left_only").alias("live_only"),
            F.col("right_only").alias("gold_only")).join(
            gold.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows")), "table_name")
        out = row if out is None else out.unionByName(row)
    return out


@register_raw("gold_staleness")
def _gold_stale(spark, sf_dir):
    """The revision that the published gold tables carry against the source's, and against a newer one."""
    root = _gold_root(spark, sf_dir)
    rev = adapter._signature(sf_dir)
    published = store.committed(spark, root, GOLD.GOLD).agg(F.max_by("note", "version").alias("revision"))
    return published.select((F.col("revision") == rev).alias("fresh_for_current"),
                            (F.col("revision") == rev + "+1").alias("fresh_for_newer"))


@register_raw("gold_refresh")
def _gold_refresh(spark, sf_dir):
    """Versions published for the source's revision after a second refresh, and their rows."""
    root = _gold_root(spark, sf_dir)
    rev = adapter._signature(sf_dir)
    GOLD.refresh(spark, root, ledgers(spark, sf_dir), revision=rev)
    versions = store.committed(spark, root, GOLD.GOLD).where(F.col("note") == rev).select(F.lit(1).alias("v"), F.lit(0).alias("r"))
    rows = GOLD.read(spark, root, "reconciliation", arrays=False).select(F.lit(0).alias("v"), F.lit(1).alias("r"))
    return versions.unionByName(rows).agg(F.sum("v").cast("long").alias("versions"), F.sum("r").cast("long").alias("rows"))


@register("review_candidates")
def _e1(led):
    return E.live_candidates(led)


@register("protected_candidates")
def _e1_protected(led):
    return E.live_candidates(led, protect=True)


@register_raw("review_summary")
def _e2(spark, sf_dir):
    led = ledgers(spark, sf_dir)
    s = E.write_review_report(spark, R.backend_reconciliation(led), scratch_path(spark, "reports"),
                              candidates=E.live_candidates(led))
    return spark.createDataFrame([(s["deduction_count"], s["needs_review_count"], s["candidate_count"])],
                                 "deduction_count long, needs_review_count long, candidate_count long")


def _missing_export(side, kinds):
    def fn(spark, sf_dir):
        root = scratch_path(spark, "reports")
        s = E.write_missing_reports(spark, ledgers(spark, sf_dir), root)
        path = store.part_path(spark, root, "missing_counterparts", side, s["version"])
        return spark.read.options(header="true", escape='"', multiLine="true").schema(
            ", ".join(f"`{c}` string" for c, _ in kinds)).csv(path)
    return fn


register_raw("missing_export")(_missing_export(G.WALLET_SIDE, WALLET_GAP_KINDS))
register_raw("missing_export_swaps")(_missing_export(G.SWAP_SIDE, SWAP_GAP_KINDS))


@register("csv_protect")
def _e5(led):
    return E.tracking_export(led, EXPORT_GROUP, _filters())


@register("capped_export")
def _e4(led):
    return E.tracking_export(led, CAPPED_GROUP, _filters())


@register("serialize_values")
def _e6(led):
    return E.as_text(_page(led))
