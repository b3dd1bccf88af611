"""Classification rules as plain Column expressions (no UDFs).

Each function maps columns of one row to a label, flag or array, in the
priority order of the ledger rules. They stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C


def blank(c: Column) -> Column:
    """NULL or only spaces (``nullif(btrim(x), '') IS NULL``)."""
    return F.nullif(F.trim(c), F.lit("")).isNull()


def eligible_debit(transaction_type: Column, status: Column, settled_against: Column) -> Column:
    return ((transaction_type == C.DEBIT_TYPE) & (status == C.COMMITTED)
            & (settled_against == C.SETTLED_SWAP))


def reconciliation_status(transaction_id: Column, wallet_count: Column, matched_group: Column,
                          successful_count: Column, wallet_amount: Column, swap_amount: Column) -> Column:
    """First matching rule wins. ``matched_group`` is true when a swap group joined."""
    return (
        F.when(transaction_id.isNull(), C.MISSING_TX)
        .when((wallet_count > 1) | (successful_count > 1), C.AMBIGUOUS)
        .when(~matched_group, C.NO_SWAP)
        .when(successful_count == 0, C.NO_SUCCESS)
        .when(wallet_amount.isNull() | swap_amount.isNull(), C.MISSING_AMOUNT)
        .when(wallet_amount != swap_amount, C.AMOUNT_MISMATCH)
        .otherwise(C.MATCHED)
    )


def payment_method_needs_review(successful_count: Column, wallet_successes: Column) -> Column:
    """With exactly one success, its distinct methods IS DISTINCT FROM ['WALLET'].

    With one success that array is ``[method]``, so it equals ``['WALLET']`` exactly
    when that success was paid by WALLET: the rule needs only the count of
    successful WALLET swaps, never the array of methods."""
    return F.when(successful_count == 1, wallet_successes != 1).otherwise(F.lit(False))


def customer_mapping_status(wallet_found: Column, crm_id: Column, business_id: Column) -> Column:
    """R8."""
    return (F.when(~wallet_found, C.WALLET_NOT_LOADED)
            .when(crm_id.isNull() & business_id.isNull(), C.CUSTOMER_NOT_AVAILABLE)
            .otherwise(C.MAPPED))


def customer_lookup_check(crm_id: Column, min_swap_customer_id: Column, max_swap_customer_id: Column) -> Column:
    """Every non-NULL swap customer id equals the wallet's customer id.

    The distinct ids are a subset of ``{crm_id}`` exactly when their minimum and
    maximum both equal it; no ids at all leaves both NULL. Two fixed-size
    aggregates replace the per-key id array, so a hot key never builds one."""
    return (F.when(crm_id.isNull(), C.WALLET_LOOKUP_UNAVAILABLE)
            .when(min_swap_customer_id.isNull(), C.SWAP_LOOKUP_UNAVAILABLE)
            .when((min_swap_customer_id == crm_id) & (max_swap_customer_id == crm_id), C.LOOKUP_AGREES)
            .otherwise(C.LOOKUP_DIFFERS))


def review_reasons(status: Column, payment_review: Column, mapping_status: Column,
                   successful_count: Column, lookup_check: Column, currency: Column,
                   country: Column, wallet_created_on: Column, successful_created_on: Column) -> Column:
    """Ordered reasons, NULLs removed."""
    return F.array_compact(F.array(
        F.when(status != C.MATCHED, status),
        F.when(payment_review, F.lit(C.PAYMENT_REVIEW)),
        F.when(mapping_status != C.MAPPED, mapping_status),
        F.when((successful_count > 0) & (lookup_check == C.LOOKUP_DIFFERS), F.lit(C.LOOKUP_DIFFERS_REASON)),
        F.when((successful_count > 0) & lookup_check.isin(C.SWAP_LOOKUP_UNAVAILABLE, C.WALLET_LOOKUP_UNAVAILABLE),
               F.lit(C.LOOKUP_UNAVAILABLE_REASON)),
        F.when(currency.isNull(), F.lit(C.CURRENCY_UNAVAILABLE)),
        F.when(country.isNull(), F.lit(C.COUNTRY_UNAVAILABLE)),
        F.when(wallet_created_on.isNull() | ((successful_count == 1) & successful_created_on.isNull()),
               F.lit(C.TIMESTAMP_UNAVAILABLE)),
    ))


def coverage_assessment(created_on: Column, first_swap: Column, last_swap: Column) -> Column:
    """A country whose swaps all lack a time counts as no data."""
    return (F.when(first_swap.isNull(), C.NO_SWAP_DATA)
            .when(created_on.isNull(), C.TIMESTAMP_UNAVAILABLE)
            .when(created_on < first_swap, C.BEFORE_SWAP_START)
            .when(created_on > last_swap, C.AFTER_SWAP_CUTOFF)
            .otherwise(C.WITHIN_SWAP_SPAN))


def gap_reason(transaction_id: Column, country: Column, no_counterpart_label: str) -> Column:
    """G3."""
    return (F.when(blank(transaction_id), C.GAP_MISSING_TX)
            .when(blank(country), C.GAP_MISSING_COUNTRY)
            .otherwise(no_counterpart_label))


def gap_date_context(has_counterparts: Column, created_on: Column, first_seen: Column, last_seen: Column) -> Column:
    """Presence of counterpart rows and NULL bounds are separate cases."""
    return (F.when(~has_counterparts, C.NO_COUNTERPART_DATA)
            .when(created_on.isNull() | first_seen.isNull(), C.TIMESTAMP_UNAVAILABLE)
            .when(created_on < first_seen, C.BEFORE_COUNTERPART)
            .when(created_on > last_seen, C.AFTER_COUNTERPART)
            .otherwise(C.WITHIN_COUNTERPART))


def valid_identifiers(transaction_id: Column, country: Column) -> Column:
    """Both identifiers non-blank."""
    return ~blank(transaction_id) & ~blank(country)


def gap_customer_name(name: Column, label: Column, rollup_names: Column) -> Column:
    """Own name, else label ('' counts as missing), else the single rollup name."""
    return F.coalesce(F.nullif(name, F.lit("")), F.nullif(label, F.lit("")),
                      F.when(F.size(rollup_names) == 1, F.element_at(rollup_names, 1)))


def single_value(candidates: Column) -> Column:
    """The only candidate, else NULL."""
    return F.when(F.size(candidates) == 1, F.element_at(candidates, 1))


def wallet_payment_expected(status: Column, method: Column) -> Column:
    """G8."""
    return F.coalesce((status == C.SWAP_SUCCESS) & (method == C.WALLET_METHOD), F.lit(False))


def protect_cell(c: Column) -> Column:
    """E5: a leading quote on text that a spreadsheet would read as a formula."""
    return F.when(c.rlike("^[=+\\-@\\t\\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def iso_timestamp(c: Column) -> Column:
    """ISO-8601 text; fraction only when non-zero (as Python's isoformat)."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(c, "SSSSSS")
    return F.when(c.isNull(), F.lit(None).cast("string")).when(
        micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))
