"""Two-sided review of committed wallet debits against swap records.

Plan shape (all on the keys ``(country, transaction_id)``):

1. One aggregation over ``debit keys UNION ALL swaps`` computes, per key, the
   debit count (the duplicate check) and every swap statistic. It runs with
   map-side partial aggregation, so a hot key (e.g. all NULL-id debits of one
   country, or one reused transaction id) is reduced to one row per map task
   before the shuffle -- no task ever holds a whole hot group.
2. The debits join that table once. The key columns are materialised as
   null-safe normalised columns, so the aggregate's output partitioning is
   reused and only the debit rows are exchanged. AQE's skew join splits a hot
   key's debit partition.
3. The wallet snapshot joins on ``(wallet_id, country)`` (AQE broadcasts it
   when its measured size is small), per-country swap bounds join through a
   size-checked broadcast. Both join the debits before step 2, so nothing is exchanged
   any more once a key's arrays stand on each of its debits.

A window ``count(*) OVER (PARTITION BY country, transaction_id)`` would give the
same numbers but sorts each key's rows inside one task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import arrays, rules
from ..plans.joins import join_small, split_join, written

KEYS = ["_kc", "_cn", "_kt", "_tn"]
# Fixed-size per-key aggregates the R9 rule reads instead of the id array.
LOOKUP_BOUNDS = ["_min_customer_id", "_max_customer_id"]


@dataclass(frozen=True)
class Ledgers:
    """The three input tables (any DataFrames with the ledger columns)."""

    wallets: DataFrame
    wallet_transactions: DataFrame
    swap_transactions: DataFrame


def _normalised_keys(country: Column, tx: Column) -> list[Column]:
    """Null-safe equality of (country, tx) as plain equality of four columns."""
    return [
        F.coalesce(country, F.lit("")).alias("_kc"),
        country.isNull().alias("_cn"),
        F.coalesce(tx, F.lit("")).alias("_kt"),
        tx.isNull().alias("_tn"),
    ]


def eligible_debits(wallet_transactions: DataFrame) -> DataFrame:
    """Committed debits settled against a swap (pushed to the scan)."""
    w = wallet_transactions
    return w.filter(rules.eligible_debit(w.transaction_type, w.status, w.settled_against))


def swap_groups(swap_transactions: DataFrame) -> DataFrame:
    """R2 on its own: per (country, non-NULL transaction id) swap statistics."""
    s = swap_transactions.filter(F.col("transaction_id").isNotNull())
    s = s.withColumn("swap_amount_scale", scale_of(s, "swap_amount"))
    ok = F.col("status") == C.SWAP_SUCCESS
    return s.groupBy("country", "transaction_id").agg(*_swap_aggs(F.lit(True), ok))


def scale_of(df: DataFrame, col: str) -> Column:
    """The written-scale column of a decimal column, or NULL when the table
    keeps none (then the type's scale applies)."""
    name = col + "_scale"
    return F.col(name) if name in df.columns else F.lit(None).cast("int")


def _swap_aggs(is_swap: Column, ok: Column) -> list[Column]:
    succ = is_swap & ok
    return [
        F.count_if(is_swap).alias("swap_count"),
        F.count_if(succ).alias("successful_swap_count"),
        F.min(F.when(succ, F.col("swap_amount"))).alias("successful_swap_amount"),
        F.min_by(F.col("swap_amount_scale"), F.when(succ, F.col("swap_amount"))).alias("successful_swap_amount_scale"),
        F.min(F.when(succ, F.col("created_on"))).alias("successful_swap_created_on"),
        arrays.distinct_sorted(F.col("swap_reference"), where=is_swap).alias("swap_references"),
        arrays.distinct_sorted(F.col("customer_id"), where=is_swap & F.col("customer_id").isNotNull(),
                               keep_null=False).alias("customer_ids"),
        arrays.distinct_sorted(F.col("payment_method"), where=succ).alias("successful_payment_methods"),
    ]


#: Kinds of listed values and the review's array of them; ``references`` and ``methods`` may hold NULL.
LISTED = {"reference": "swap_references", "customer": "customer_ids", "method": "successful_payment_methods"}


def key_values(led: Ledgers) -> DataFrame:
    """R2 + R4 as rows: the distinct values that a debit's key lists, once per key: country, transaction_id, kind, value.

    A review shows them on every debit of the key, so d debits and s swaps of one id are d x s
    array elements there, and d + s rows here. Distinct comes before any collecting, with map-side
    partial aggregation, and a hot key's values are rows that spread over tasks."""
    keys = eligible_debits(led.wallet_transactions).select(F.col("country").alias("_c"), F.col("transaction_id").alias("_t")).distinct()
    return split_join(_listed_values(led.swap_transactions), keys, [("country", "_c"), ("transaction_id", "_t")], "left_semi")


def _listed_values(swap_transactions: DataFrame) -> DataFrame:
    """The rows of ``key_values`` for all keys of some swaps."""
    swaps = swap_transactions.filter(F.col("transaction_id").isNotNull() & F.col("country").isNotNull())
    ok = F.col("status") == C.SWAP_SUCCESS
    listed = F.array(
        F.struct(F.lit("reference").alias("kind"), F.col("swap_reference").alias("value")),
        F.when(F.col("customer_id").isNotNull(), F.struct(F.lit("customer").alias("kind"), F.col("customer_id").alias("value"))),
        F.when(ok, F.struct(F.lit("method").alias("kind"), F.col("payment_method").alias("value"))))
    return swaps.select("country", "transaction_id", F.explode(F.array_compact(listed)).alias("v")).select(
        "country", "transaction_id", "v.kind", "v.value").distinct()


def with_page_arrays(page: DataFrame, led: Ledgers) -> DataFrame:
    """A page of a review without its arrays (``query.page_frame``) plus the arrays of its rows' keys, in the page's
    order: only the swaps of these keys are read for them."""
    page = written(page, "page")
    keys = page.select(F.col("country").alias("_pc"), F.col("transaction_id").alias("_pt")).where(
        F.col("_pc").isNotNull() & F.col("_pt").isNotNull()).distinct()
    return with_arrays(page, _listed_values(_swaps_of(led, keys))).orderBy("wallet_record_id")


def with_arrays(lean: DataFrame, values: DataFrame, shown: Callable[[Column], Column] | None = None) -> DataFrame:
    """A review without its arrays plus the arrays of ``key_values`` rows (for outputs that show them).

    ``shown`` is made of each array once per key, not once per debit."""
    return split_join(lean, arrays_by_key(values, shown), [("country", "_c"), ("transaction_id", "_t")], "left").drop("_c", "_t")


def arrays_by_key(values: DataFrame, shown: Callable[[Column], Column] | None) -> DataFrame:
    """The arrays of each key (``_c``, ``_t``) of ``key_values`` rows."""
    shown = shown or (lambda arr: arr)
    item = F.struct(F.col("value").alias("v"))
    return values.groupBy(F.col("country").alias("_c"), F.col("transaction_id").alias("_t")).agg(*[
        shown(arrays.empty_to_null(F.array_sort(F.transform(F.collect_list(F.when(F.col("kind") == kind, item)), lambda e: e["v"])))).alias(name)
        for kind, name in LISTED.items()])


def shared_arrays(led: Ledgers, debits: int, shown: Callable[[Column], Column] | None = None) -> DataFrame:
    """The arrays of each key (``_c``, ``_t``) that more than ``debits`` eligible debits share."""
    keys = eligible_debits(led.wallet_transactions).where(F.col("country").isNotNull() & F.col("transaction_id").isNotNull()) \
        .groupBy(F.col("country").alias("_pc"), F.col("transaction_id").alias("_pt")).agg(F.count(F.lit(1)).alias("_n")) \
        .where(F.col("_n") > debits).select("_pc", "_pt")
    return arrays_by_key(_listed_values(_swaps_of(led, keys)), shown)


def _swaps_of(led: Ledgers, keys: DataFrame) -> DataFrame:
    """The swaps of some keys (``_pc``, ``_pt``)."""
    return join_small(led.swap_transactions, keys,
                      (F.col("country") == F.col("_pc")) & (F.col("transaction_id") == F.col("_pt")), "left_semi")


def key_statistics(debits: DataFrame, swap_transactions: DataFrame) -> DataFrame:
    """Per normalised key: debit count and swap statistics (swap side only for
    keys with both identifiers present -- NULL never equals NULL there)."""
    d = debits.select(*_normalised_keys(F.col("country"), F.col("transaction_id")),
                      F.lit(False).alias("_swap"),
                      F.lit(None).cast("string").alias("status"),
                      F.lit(None).cast(swap_transactions.schema["swap_amount"].dataType).alias("swap_amount"),
                      F.lit(None).cast("int").alias("swap_amount_scale"),
                      F.lit(None).cast(swap_transactions.schema["created_on"].dataType).alias("created_on"),
                      F.lit(None).cast("string").alias("swap_reference"),
                      F.lit(None).cast("string").alias("customer_id"),
                      F.lit(None).cast("string").alias("payment_method"))
    s = swap_transactions.filter(
        F.col("transaction_id").isNotNull() & F.col("country").isNotNull()
    ).select(*_normalised_keys(F.col("country"), F.col("transaction_id")),
             F.lit(True).alias("_swap"), "status", "swap_amount",
             scale_of(swap_transactions, "swap_amount").alias("swap_amount_scale"), "created_on",
             "swap_reference", "customer_id", "payment_method")
    is_swap = F.col("_swap")
    ok = F.col("status") == C.SWAP_SUCCESS
    return d.unionByName(s).groupBy(*KEYS).agg(
        F.count_if(~is_swap).alias("wallet_count"),
        *_swap_aggs(is_swap, ok),
        # bounded inputs of R6 and R9 (the arrays above are output only, and
        # Catalyst drops them from every plan that does not return them)
        F.count_if(is_swap & ok & (F.col("payment_method") == C.WALLET_METHOD)).alias("_wallet_successes"),
        F.min(F.when(is_swap, F.col("customer_id"))).alias("_min_customer_id"),
        F.max(F.when(is_swap, F.col("customer_id"))).alias("_max_customer_id"),
    )


def wallet_swap_review(led: Ledgers, shown: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per eligible debit with its swap group and status."""
    return _review_core(led, shown=shown).drop(*LOOKUP_BOUNDS)


def _debits(led: Ledgers) -> DataFrame:
    """The eligible debits with the columns and normalised keys of the review."""
    return eligible_debits(led.wallet_transactions).select(
        "zoho_record_id", "transaction_id", "reference", "wallet_id", "wallet_label", "country",
        "amount", "created_on", "source_file", "imported_at",
        scale_of(led.wallet_transactions, "amount").alias("_amount_scale"),
        *_normalised_keys(F.col("country"), F.col("transaction_id")))


def _review_core(led: Ledgers, debits: DataFrame | None = None, carried: tuple[str, ...] = (),
                 shown: Callable[[Column], Column] | None = None) -> DataFrame:
    """``wallet_swap_review`` plus the per-key customer id bounds R9 needs.

    ``debits``: ``_debits`` with columns ``carried`` more. ``shown`` is made of each array once per
    key, before the key's debits get it."""
    plain = _debits(led)
    stats = key_statistics(plain, led.swap_transactions)
    if shown is not None:
        stats = stats.withColumns({name: shown(F.col(name)) for name in LISTED.values()})
    # both sides exchange once more, so that AQE can split a hot key's debits
    right = [f"_s{k}" for k in KEYS]
    j = split_join(plain if debits is None else debits, stats.withColumnsRenamed(dict(zip(KEYS, right))), list(zip(KEYS, right)))
    has_group = F.col("swap_count") > 0
    return j.select(
        F.col("zoho_record_id").alias("wallet_record_id"),
        "transaction_id",
        F.col("reference").alias("wallet_reference"),
        "wallet_id", "wallet_label", "country",
        F.col("amount").alias("wallet_amount"),
        F.col("created_on").alias("wallet_created_on"),
        "wallet_count", "swap_count", "successful_swap_count",
        "successful_swap_amount", "successful_swap_created_on",
        "swap_references", "customer_ids", "successful_payment_methods",
        rules.reconciliation_status(F.col("transaction_id"), F.col("wallet_count"), has_group,
                                    F.when(has_group, F.col("successful_swap_count")),
                                    F.col("amount"), F.col("successful_swap_amount"))
        .alias("reconciliation_status"),
        rules.payment_method_needs_review(F.col("successful_swap_count"), F.col("_wallet_successes"))
        .alias("payment_method_needs_review"),
        F.col("source_file").alias("wallet_source_file"),
        F.col("imported_at").alias("wallet_imported_at"),
        F.col("_amount_scale").alias("wallet_amount_scale"),
        "successful_swap_amount_scale",
        *LOOKUP_BOUNDS, *carried,
    )


def wallet_mapping(wallets: DataFrame) -> DataFrame:
    return wallets.select(
        F.col("zoho_record_id").alias("_m_id"), F.col("country").alias("_m_country"),
        "wallet_code",
        F.col("customer_crm_id").alias("wallet_customer_id"),
        F.col("customer_business_id").alias("wallet_customer_reference"),
        F.col("customer_name").alias("wallet_customer_name"),
        F.col("currency").alias("wallet_currency"),
        F.col("source_modified_at").alias("wallet_mapping_modified_at"),
    )


def _with_mapping(df: DataFrame, wallets: DataFrame) -> DataFrame:
    m = wallet_mapping(wallets)
    return df.join(m, (df.wallet_id == m._m_id) & (df.country == m._m_country), "left")


#: What the wallet mapping adds to a debit; the first column says that there is one.
MAPPED = ("_m_id", "wallet_code", "wallet_customer_id", "wallet_customer_reference", "wallet_customer_name",
          "wallet_currency", "wallet_mapping_modified_at")


def customer_review(led: Ledgers, review: DataFrame | None = None,
                    shown: Callable[[Column], Column] | None = None) -> DataFrame:
    """Wallet snapshot mapping on wallet id and country."""
    if review is not None:
        return _customer_flags(_with_mapping(review, led.wallets))
    return _customer_flags(_review_core(led, _with_mapping(_debits(led), led.wallets), MAPPED, shown))


def _customer_flags(j: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """R8 and R9 of a review with its mapping; ``carried`` columns come last."""
    if set(LOOKUP_BOUNDS) <= set(j.columns):
        lo, hi = F.col(LOOKUP_BOUNDS[0]), F.col(LOOKUP_BOUNDS[1])
    else:  # a review without the bounds: take them from its id arrays
        lo, hi = F.array_min("customer_ids"), F.array_max("customer_ids")
    return j.select(
        *[c for c in j.columns if c not in (*LOOKUP_BOUNDS, *MAPPED, "_m_country", *carried)], *MAPPED[1:],
        rules.customer_mapping_status(F.col("_m_id").isNotNull(), F.col("wallet_customer_id"),
                                      F.col("wallet_customer_reference")).alias("customer_mapping_status"),
        rules.customer_lookup_check(F.col("wallet_customer_id"), lo, hi).alias("swap_customer_lookup_check"),
        *carried,
    )


def observed_bounds(swap_transactions: DataFrame) -> DataFrame:
    """Per country first and last swap time over all swaps."""
    return swap_transactions.groupBy("country").agg(
        F.min("created_on").alias("observed_first_swap"),
        F.max("created_on").alias("observed_last_swap"))


OBSERVED = ("observed_first_swap", "observed_last_swap")


def backend_reconciliation(led: Ledgers, bounds_from: DataFrame | None = None,
                           shown: Callable[[Column], Column] | None = None) -> DataFrame:
    """The full reconciliation result (flagship).

    ``bounds_from``: the swaps the per-country observed bounds come from when
    ``led`` holds only a key-restricted slice (point lookups); default all. ``shown``:
    what to make of each listed array, once per key (``None``: the array)."""
    swaps = bounds_from if bounds_from is not None else led.swap_transactions
    bounds = observed_bounds(swaps).withColumnRenamed("country", "_b_country")
    debits = join_small(_with_mapping(_debits(led), led.wallets), bounds, F.col("country") == F.col("_b_country"), "left")
    j = _customer_flags(_review_core(led, debits, (*MAPPED, *OBSERVED), shown), OBSERVED)
    reasons = rules.review_reasons(
        F.col("reconciliation_status"), F.col("payment_method_needs_review"),
        F.col("customer_mapping_status"), F.col("successful_swap_count"),
        F.col("swap_customer_lookup_check"), F.col("wallet_currency"), F.col("country"),
        F.col("wallet_created_on"), F.col("successful_swap_created_on"))
    flagged = j.select(
        "*",
        reasons.alias("review_reasons"),
        rules.coverage_assessment(F.col("wallet_created_on"), F.col("observed_first_swap"),
                                  F.col("observed_last_swap")).alias("coverage_assessment"),
    )
    return flagged.select(
        "*",
        (F.size("review_reasons") > 0).alias("needs_review"),
        F.lit(C.NOT_VERIFIED).alias("source_coverage_status"),
    )


def key_slice(led: Ledgers, country, transaction_id) -> Ledgers:
    """Ledgers restricted to one ``(country, transaction_id)`` key (NULL matches
    NULL, as in the duplicate check); the filters reach both parquet scans."""
    def on_key(df: DataFrame) -> DataFrame:
        return df.filter(F.col("country").eqNullSafe(F.lit(country).cast("string"))
                         & F.col("transaction_id").eqNullSafe(F.lit(transaction_id).cast("string")))
    return Ledgers(led.wallets, on_key(led.wallet_transactions), on_key(led.swap_transactions))


def record_detail_live(led: Ledgers, wallet_record_id: str) -> DataFrame:
    """Q5 on the live plan as a point lookup: one small job finds the debit's
    key, then only that key's rows of both ledgers are read (the duplicate
    check still sees the complete key); the observed bounds read all swaps of
    the debit's country only."""
    target = (eligible_debits(led.wallet_transactions)
              .filter(F.col("zoho_record_id") == wallet_record_id)
              .select("country", "transaction_id").first())
    if target is None:
        return backend_reconciliation(key_slice(led, None, None)).limit(0)
    sliced = key_slice(led, target.country, target.transaction_id)
    same_country = led.swap_transactions.filter(F.col("country") == F.lit(target.country).cast("string"))
    recon = backend_reconciliation(sliced, bounds_from=same_country)
    return recon.filter(F.col("wallet_record_id") == wallet_record_id)
