"""Diagnostic reports: source inventory, post-load counts and the shipped
ad-hoc review queries (I17, I19, X1-X16). All are group-bys with map-side
partial aggregation over the ledgers or the review result."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..plans.joins import join_small
from .review import Ledgers, customer_review, observed_bounds, wallet_swap_review

DATASET_LABELS = {"wallet_master": "Wallets", "wallet": "Wallet transactions", "swap": "Swapping transactions"}


def _count(df: DataFrame, *keys, name: str = "records") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def source_inventory(led: Ledgers) -> DataFrame:
    """Per dataset and country: rows, first and last created_on."""
    parts = []
    for dataset, df in (("wallet_master", led.wallets), ("wallet", led.wallet_transactions),
                        ("swap", led.swap_transactions)):
        parts.append(df.groupBy("country").agg(
            F.count(F.lit(1)).alias("rows"), F.min("created_on").alias("first"),
            F.max("created_on").alias("last"))
            .select(F.lit(dataset).alias("dataset"), F.lit(DATASET_LABELS[dataset]).alias("module"),
                    "country", "rows", "first", "last"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def post_load_counts(led: Ledgers) -> DataFrame:
    """Debits by country x status and by country x mapping, plus table totals."""
    cr = customer_review(led)
    by_status = _count(cr, "country", F.col("reconciliation_status").alias("label")) \
        .select(F.lit("status").alias("kind"), "country", "label", "records")
    by_mapping = _count(cr, "country", F.col("customer_mapping_status").alias("label")) \
        .select(F.lit("mapping").alias("kind"), "country", "label", "records")
    totals = [df.agg(F.count(F.lit(1)).alias("records")).select(
        F.lit("table").alias("kind"), F.lit(None).cast("string").alias("country"), F.lit(name).alias("label"),
        "records") for name, df in (("wallets", led.wallets), ("wallet_transactions", led.wallet_transactions),
                                    ("swap_transactions", led.swap_transactions))]
    out = by_status.unionByName(by_mapping)
    for t in totals:
        out = out.unionByName(t)
    return out


# --- X1-X16 ----------------------------------------------------------------

def dataset_counts(led: Ledgers) -> DataFrame:
    """X1."""
    w = _count(led.wallet_transactions, "country").select("country", F.lit("wallet").alias("dataset"), "records")
    s = _count(led.swap_transactions, "country").select("country", F.lit("swap").alias("dataset"), "records")
    return w.unionByName(s)


def status_counts(led: Ledgers, review: DataFrame | None = None) -> DataFrame:
    """X2."""
    r = review if review is not None else wallet_swap_review(led)
    return _count(r, "country", "reconciliation_status", name="wallet_records") \
        .orderBy(F.asc_nulls_last("country"), "reconciliation_status")


def coverage_notes(led: Ledgers) -> DataFrame:
    """Coverage notes for debits without a loaded swap. Own label order:
    after the last swap, before the first, no data, else within (a NULL time
    lands in 'within')."""
    r = wallet_swap_review(led).filter(F.col("reconciliation_status") == C.NO_SWAP)
    b = observed_bounds(led.swap_transactions).withColumnRenamed("country", "_b_country")
    j = join_small(r, b, F.col("country") == F.col("_b_country"), "left")
    note = (F.when(F.col("wallet_created_on") > F.col("observed_last_swap"), "after_swap_export_max_created_on")
            .when(F.col("wallet_created_on") < F.col("observed_first_swap"), "before_swap_export_min_created_on")
            .when(F.col("observed_first_swap").isNull(), "no_swap_data_loaded")
            .otherwise("within_observed_swap_time_span_not_proven_complete"))
    return _count(j, "country", note.alias("coverage_note"), name="wallet_records")


def day_candidates(led: Ledgers, country: str, start: dt.date, end: dt.date) -> DataFrame:
    """No-swap debits of one country in the half-open range [start, end)."""
    r = wallet_swap_review(led)
    lo = F.lit(start.isoformat() + " 00:00:00").cast("timestamp_ntz")
    hi = F.lit(end.isoformat() + " 00:00:00").cast("timestamp_ntz")
    return (r.filter((F.col("country") == country) & (F.col("reconciliation_status") == C.NO_SWAP)
                     & (F.col("wallet_created_on") >= lo) & (F.col("wallet_created_on") < hi))
            .select("country", "wallet_record_id", "transaction_id", "wallet_reference", "wallet_id",
                    "wallet_amount", "wallet_created_on", "reconciliation_status")
            .orderBy("wallet_created_on"))


def payment_review_rows(led: Ledgers) -> DataFrame:
    """X5."""
    return wallet_swap_review(led).filter(F.col("payment_method_needs_review")) \
        .orderBy(F.asc_nulls_last("country"), F.asc_nulls_last("wallet_created_on"))


def missing_tx_by_method(led: Ledgers) -> DataFrame:
    """X6."""
    return _count(led.swap_transactions.filter(F.col("transaction_id").isNull()), "country", "payment_method",
                  name="missing_transaction_id")


def duplicate_transaction_ids(df: DataFrame) -> DataFrame:
    """Transaction ids used more than once within a country (all rows)."""
    return _count(df.filter(F.col("transaction_id").isNotNull()), "country", "transaction_id") \
        .filter(F.col("records") > 1)


def wallets_by_country(led: Ledgers) -> DataFrame:
    """X10."""
    return _count(led.wallets, "country", name="wallets")


def mapping_counts(led: Ledgers, cr: DataFrame | None = None) -> DataFrame:
    """X11."""
    cr = cr if cr is not None else customer_review(led)
    return _count(cr, "country", "customer_mapping_status", name="wallet_deductions")


def status_mapping_counts(led: Ledgers, cr: DataFrame | None = None) -> DataFrame:
    """X12."""
    cr = cr if cr is not None else customer_review(led)
    return _count(cr, "country", "reconciliation_status", "customer_mapping_status", name="wallet_deductions")


def in_span_candidates(led: Ledgers) -> DataFrame:
    """No-swap debits up to the country's last swap (inner join on bounds;
    NULL times drop), with customer details."""
    cr = customer_review(led).filter(F.col("reconciliation_status") == C.NO_SWAP)
    b = (led.swap_transactions.groupBy(F.col("country").alias("_b_country"))
         .agg(F.max("created_on").alias("_last_swap")))
    j = join_small(cr, b, F.col("country") == F.col("_b_country"), "inner")
    return (j.filter(F.col("wallet_created_on") <= F.col("_last_swap"))
            .select("country", "wallet_record_id", "transaction_id", "wallet_reference", "wallet_code",
                    "wallet_customer_id", "wallet_customer_reference", "wallet_customer_name", "wallet_amount",
                    "wallet_currency", "wallet_created_on", "reconciliation_status")
            .orderBy(F.asc_nulls_last("country"), "wallet_created_on"))


def lookup_among_matched(led: Ledgers, cr: DataFrame | None = None) -> DataFrame:
    """X14."""
    cr = cr if cr is not None else customer_review(led)
    return _count(cr.filter(F.col("reconciliation_status") == C.MATCHED), "country", "swap_customer_lookup_check",
                  name="matched_wallet_deductions")


def amounts_by_currency(led: Ledgers, cr: DataFrame | None = None) -> DataFrame:
    """Counts and amounts kept separate by country and source currency."""
    cr = cr if cr is not None else customer_review(led)
    return cr.groupBy("country", "wallet_currency", "reconciliation_status").agg(
        F.count(F.lit(1)).alias("deductions"), F.sum("wallet_amount").alias("amount_in_source_currency"))


def wallets_by_currency(led: Ledgers) -> DataFrame:
    """X16."""
    return _count(led.wallets, "country", "currency", name="wallets")
