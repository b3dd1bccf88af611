"""Derive the three ledgers from the driver's star-schema tables.

The driver's parquet tables carry no wallets or swaps, so wallet master, wallet
transactions and swap transactions are derived deterministically from
``orders`` x ``customer`` x ``nation`` and ``lineitem``. Every branch of the
reconciliation rules is populated (NULL / blank / duplicated ids, amount
mismatches, failed swaps, unmapped wallets, a country without swaps, a country
whose swaps lack times). ``k`` is the order key, ``ck`` the customer key and
``nk`` the nation key; the first matching rule wins.

All three are plain narrow DataFrame plans: the wallet and swap ledgers are
joins of a fact table with two small dimensions, so they scale with the fact.
"""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_root

# --- fixed values: adapter rule parameters --------------------------------
SWAP_WINDOW_START = "1995-07-01 00:00:00"
SWAP_WINDOW_END = "2001-01-01 00:00:00"
NATION_WITHOUT_SWAPS = 24
SWAP_ONLY_COUNTRY = "Offshore"
NATION_WITHOUT_SWAP_TIMES = 23
IMPORTED_AT = "2026-10-05 00:00:00"
MASTER_CREATED_ON = "1994-06-01 00:00:00"
# --- end of fixed values --------------------------------------------------


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _m(c: Column, n: int) -> Column:
    return (c % F.lit(n)) == 0


def _s(c: Column) -> Column:
    return c.cast("string")


def _provenance(source_file: str, row_number: Column, raw: Column) -> list[Column]:
    return [
        F.lit(source_file).alias("source_file"),
        row_number.cast("bigint").alias("source_row_number"),
        raw.alias("raw_record"),
        F.lit(IMPORTED_AT).cast("timestamp").alias("imported_at"),
    ]


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders x customer x nation with the shared country / transaction id rules."""
    orders = _read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    customer = _read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    nation = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    k, nk = F.col("o_orderkey"), F.col("c_nationkey")
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, customer.c_nationkey == nation.n_nationkey)
        .select(
            k.alias("k"),
            F.col("o_custkey").alias("ck"),
            nk.alias("nk"),
            F.col("c_name"),
            F.col("o_orderstatus"),
            F.col("o_orderdate"),
            F.col("o_orderpriority"),
            F.when(_m(k, 53), F.lit(None).cast("string")).otherwise(F.col("n_name")).alias("country"),
            F.when(_m(k, 41), F.lit(None).cast("string"))
            .when(_m(k, 59), F.lit("  "))
            .when(_m(k, 43), F.concat(F.lit("dup-"), _s(nk)))
            .otherwise(F.concat(F.lit("tx-"), _s(k)))
            .alias("transaction_id"),
            F.col("o_totalprice").cast("decimal(18,2)").alias("amt"),
        )
    )


def wallet_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _base(spark, sf_dir)
    k, ck = F.col("k"), F.col("ck")
    rid = F.concat(F.lit("wt-"), _s(k))
    return b.select(
        rid.alias("zoho_record_id"),
        "transaction_id",
        F.concat(F.when(_m(k, 12), F.lit("=ref-")).otherwise(F.lit("ref-")), _s(k)).alias("reference"),
        F.concat(F.lit("rid-"), _s(k)).alias("source_record_id"),
        F.when(_m(k, 29), F.lit("w-none")).otherwise(F.concat(F.lit("w-"), _s(ck))).alias("wallet_id"),
        F.col("c_name").alias("wallet_label"),
        "country",
        F.when(_m(k, 10), F.lit("Credit")).otherwise(F.lit("Debit")).alias("transaction_type"),
        F.when((F.col("o_orderstatus") == "P") & _m(k, 3), F.lit("Pending"))
        .otherwise(F.lit("Committed")).alias("status"),
        F.when(_m(k, 11), F.lit("Rental")).otherwise(F.lit("Swap")).alias("settled_against"),
        F.col("o_orderpriority").alias("narration"),
        F.when(_m(k, 61), F.lit(None).cast("decimal(18,2)")).otherwise(F.col("amt")).alias("amount"),
        F.lit(None).cast("decimal(18,2)").alias("opening_balance"),
        F.lit(None).cast("decimal(18,2)").alias("available_balance"),
        F.lit(None).cast("decimal(18,2)").alias("hold_amount"),
        F.when(_m(k, 67), F.lit(None).cast("timestamp_ntz")).otherwise(F.col("o_orderdate")).alias("created_on"),
        F.col("o_orderdate").alias("crm_created_at"),
        F.col("o_orderdate").alias("source_modified_at"),
        F.lit(None).cast("timestamp_ntz").alias("source_change_at"),
        *_provenance("adapter_wallet_transactions.csv", k + 1, F.concat(F.lit('{"Record Id": "'), rid, F.lit('"}'))),
    )


def swap_transactions(spark: SparkSession, sf_dir: str,
                      arranged: Callable[[DataFrame, Column], DataFrame] | None = None) -> DataFrame:
    """Every order line is a swap; a line number that an order repeats is the same record.

    Swaps of orders outside the window have no time and an id that no debit shares, and those of one
    nation are booked in a country of their own: that leaves debits without swaps, debits
    before and after the observed span, and a country without swaps.

    ``arranged`` deals out and sorts the rows (by their record id, say) while they are narrow: the ledger's texts are made
    of them after that."""
    b = _base(spark, sf_dir)
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    # two numbers a line go to the join's tasks here; its rows are wide, so there are more tasks than that asks for
    lines = lines.repartition(4 * max(8, spark.sparkContext.defaultParallelism), "l_orderkey")
    s = b.join(lines, b.k == lines.l_orderkey)
    k, ck, nk, ln = F.col("k"), F.col("ck"), F.col("nk"), F.col("l_linenumber")
    outside = ((F.col("o_orderdate") < F.lit(SWAP_WINDOW_START).cast("timestamp_ntz"))
               | (F.col("o_orderdate") >= F.lit(SWAP_WINDOW_END).cast("timestamp_ntz")))
    rid = F.concat(F.lit("sw-"), _s(k), F.lit("-"), _s(ln))
    if arranged is not None:
        s = arranged(s, rid)
    station = _s(k % 7)
    return s.select(
        rid.alias("zoho_record_id"),
        F.when(_m(k, 17), F.lit(None).cast("string")).otherwise(F.concat(F.lit("bs-"), _s(k))).alias("swap_reference"),
        F.when(outside, F.concat(F.lit("out-"), _s(k))).otherwise(F.col("transaction_id")).alias("transaction_id"),
        F.concat(F.lit("rid-"), rid).alias("source_record_id"),
        F.when(_m(k, 31), F.lit("c-other"))
        .when(_m(k, 71), F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("c-"), _s(ck))).alias("customer_id"),
        F.when(_m(k, 10), F.lit(None).cast("string")).otherwise(F.col("c_name")).alias("customer_label"),
        F.when(_m(k, 5), F.lit(None).cast("string")).otherwise(F.col("c_name")).alias("customer_name"),
        F.concat(F.lit("veh-"), _s(ck)).alias("vehicle_id"),
        F.concat(F.when(_m(ck, 12), F.lit("-KX ")).otherwise(F.lit("KX ")), _s(ck)).alias("vehicle_registration"),
        F.concat(F.lit("st-"), station).alias("station_id"),
        F.concat(F.lit("Station "), station).alias("station_label"),
        F.concat(F.lit("S"), station).alias("station_code"),
        F.lit(None).cast("string").alias("in_battery_oem"),
        F.lit(None).cast("string").alias("out_battery_oem"),
        F.concat(F.lit("in-"), _s(k)).alias("in_battery_serial"),
        F.concat(F.lit("out-"), _s(k)).alias("out_battery_serial"),
        F.when(nk == NATION_WITHOUT_SWAPS, F.lit(SWAP_ONLY_COUNTRY)).otherwise(F.col("country")).alias("country"),
        F.lit(None).cast("string").alias("city"),
        F.when(_m(k, 19), F.lit("OFFER_APPLIED"))
        .when(_m(k, 37), F.lit(None).cast("string"))
        .otherwise(F.lit("WALLET")).alias("payment_method"),
        F.when(ln == 1, F.when(_m(k, 7), F.lit("FAILED")).otherwise(F.lit("SUCCESS")))
        .when((ln == 2) & _m(k, 13), F.lit("SUCCESS")).otherwise(F.lit("FAILED")).alias("status"),
        F.when(_m(k, 47), F.lit(None).cast("decimal(18,2)"))
        .when(_m(k, 23), (F.col("amt") + F.lit(0.01).cast("decimal(18,2)")).cast("decimal(18,2)"))
        .otherwise(F.col("amt")).alias("swap_amount"),
        F.col("o_orderdate").cast("date").alias("swap_date"),
        F.when(outside | (nk == NATION_WITHOUT_SWAP_TIMES) | _m(k, 73), F.lit(None).cast("timestamp_ntz"))
        .otherwise(F.col("o_orderdate") + F.expr("INTERVAL 2 SECONDS")).alias("created_on"),
        F.col("o_orderdate").alias("source_modified_at"),
        F.lit(None).cast("timestamp_ntz").alias("source_change_at"),
        *_provenance("adapter_swap_transactions.csv", k * 8 + ln,
                     F.concat(F.lit('{"Record Id": "'), rid, F.lit('"}'))),
    )


def wallets(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = _read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    nation = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    c = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    ck, nk = F.col("c_custkey"), F.col("c_nationkey")
    crm = F.when(_m(ck, 17), F.lit(None).cast("string")).otherwise(F.concat(F.lit("c-"), _s(ck)))

    def rows(prefix: str, name: Column, business: Column, currency: Column, row_offset: int) -> list[Column]:
        rid = F.concat(F.lit(prefix), _s(ck))
        return [
            rid.alias("zoho_record_id"),
            F.concat(F.lit("WC-"), F.lit(prefix), _s(ck)).alias("wallet_code"),
            F.concat(F.lit("rid-"), rid).alias("source_record_id"),
            crm.alias("customer_crm_id"),
            F.col("c_name").alias("customer_label"),
            business.alias("customer_business_id"),
            name.alias("customer_name"),
            F.col("n_name").alias("country"),
            F.concat(F.lit("CC"), _s(nk)).alias("country_code"),
            currency.alias("currency"),
            F.col("c_mktsegment").alias("category"),
            F.lit(None).cast("decimal(18,2)").alias("opening_balance"),
            F.lit(None).cast("decimal(18,2)").alias("hold_amount"),
            F.col("c_acctbal").cast("decimal(18,2)").alias("available_balance"),
            F.lit(MASTER_CREATED_ON).cast("timestamp_ntz").alias("created_on"),
            F.lit(MASTER_CREATED_ON).cast("timestamp_ntz").alias("source_modified_at"),
            F.lit(None).cast("timestamp_ntz").alias("source_change_at"),
            *_provenance("adapter_wallets.csv", ck * 2 + row_offset,
                         F.concat(F.lit('{"Record Id": "'), rid, F.lit('"}'))),
        ]

    primary = c.select(*rows(
        "w-", F.col("c_name"),
        F.when(_m(ck, 34), F.lit(None).cast("string")).otherwise(F.concat(F.lit("B-"), _s(ck))),
        F.when(_m(nk, 9), F.lit(None).cast("string")).otherwise(F.concat(F.lit("CUR"), _s(nk))),
        1))
    alternate = c.filter(_m(ck, 15) & ~_m(ck, 17)).select(*rows(
        "w2-", F.concat(F.col("c_name"), F.lit(" alt")),
        F.concat(F.lit("B2-"), _s(ck)), F.lit("ALT"), 2))
    return primary.unionByName(alternate)


def load(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(wallets, wallet_transactions, swap_transactions) for ``sf_dir`` as lazy plans."""
    return wallets(spark, sf_dir), wallet_transactions(spark, sf_dir), swap_transactions(spark, sf_dir)


LEDGER_NAMES = ("wallets", "wallet_transactions", "swap_transactions")
SOURCE_TABLES = ("orders", "customer", "nation", "lineitem")


# Bumped whenever the derived tables' layout changes, so stored copies made by
# older code are never reused.
LAYOUT_VERSION = "6"


def _signature(sf_dir: str) -> str:
    """Folder name part that changes when the source tables (or the derived
    layout) change."""
    parts = [LAYOUT_VERSION, os.path.abspath(sf_dir) if "://" not in sf_dir else sf_dir]
    for t in SOURCE_TABLES:
        path = f"{sf_dir.rstrip('/')}/{t}.parquet"
        try:
            st = os.stat(path)
            parts.append(f"{t}:{st.st_size}:{int(st.st_mtime)}")
        except OSError:
            parts.append(t)
    return hashlib.sha256("|".join(parts).encode()).hexdigest()[:16]


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(f"{path}/_SUCCESS")
        return True
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def stored_ledger(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One ledger as a stored parquet table below the shared work folder.

    Derived once per source folder (like loading the exports once), then read
    back by every query: scans prune columns and push filters into the files. The rows are
    written by the tasks of the derivation's last join, in whose exchanges only narrow rows go."""
    path = f"{work_root(spark)}/ledgers-{_signature(sf_dir)}/{name}"
    if not _exists(spark, path):
        derive = {"wallets": wallets, "wallet_transactions": wallet_transactions, "swap_transactions": swap_transactions}
        derive[name](spark, sf_dir).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three ledgers as stored parquet tables."""
    return tuple(stored_ledger(spark, sf_dir, name) for name in LEDGER_NAMES)


class StoredLedgers:
    """The stored ledgers of a source folder (as ``review.Ledgers``), each derived when a query first names it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._source = spark, sf_dir

    @functools.cached_property
    def wallets(self) -> DataFrame:
        return stored_ledger(*self._source, "wallets")

    @functools.cached_property
    def wallet_transactions(self) -> DataFrame:
        return stored_ledger(*self._source, "wallet_transactions")

    @functools.cached_property
    def swap_transactions(self) -> DataFrame:
        return stored_ledger(*self._source, "swap_transactions")


# --- derived import inputs (exports, a corrupted export, a revision batch) ---

def _order_key(c: str = "zoho_record_id") -> Column:
    return F.regexp_extract(F.col(c), r"^w[t2]?-(\d+)", 1).cast("bigint")


def dirty_overrides() -> dict[str, Column]:
    """Text replacements that make some wallet records invalid (first rule wins).

    k%97 'NaN' amount; k%89 'not-a-number' amount; k%79 a timestamp with an offset; k%73 an impossible date; k%71 a
    partial timestamp in Modified Time; k%61 a blank record id. Valid but
    unusual: k%83 seven fractional digits (first), k%7 ' 1e2 ' amount, k%5 a leading '+' on the amount."""
    k = _order_key()
    amount_text = F.col("amount").cast("string")
    amount = (F.when(_m(k, 97), F.lit("NaN"))
              .when(_m(k, 89), F.lit("not-a-number"))
              .when(_m(k, 83), F.lit("1.1234567"))
              .when(_m(k, 79) | _m(k, 73) | _m(k, 71) | _m(k, 61), amount_text)
              .when(_m(k, 7), F.lit(" 1e2 "))
              .when(_m(k, 5) & F.col("amount").isNotNull(), F.concat(F.lit("+"), amount_text))
              .otherwise(amount_text))
    created = F.date_format("created_on", "yyyy-MM-dd HH:mm:ss")
    created = (F.when(_m(k, 97) | _m(k, 89) | _m(k, 83), created)
               .when(_m(k, 79), F.lit("2026-09-23T12:00:00+03:00"))
               .when(_m(k, 73), F.lit("2026-02-30 10:00:00"))
               .otherwise(created))
    modified = F.date_format("source_modified_at", "yyyy-MM-dd HH:mm:ss")
    modified = F.when(_m(k, 71) & ~(_m(k, 97) | _m(k, 89) | _m(k, 83) | _m(k, 79) | _m(k, 73)),
                      F.lit("2026-09")).otherwise(modified)
    rid = F.when(_m(k, 61) & ~(_m(k, 97) | _m(k, 89) | _m(k, 83) | _m(k, 79) | _m(k, 73) | _m(k, 71)),
                 F.lit("   ")).otherwise(F.col("zoho_record_id"))
    return {"Amount": amount, "Created On": created, "Modified Time": modified, "Record Id": rid}


EXPORTS = ("wallet", "swap", "wallet_master", "dirty_wallet", "late_wallet", "partial_wallet", "master_by_country")


def exports(spark: SparkSession, sf_dir: str, *names: str, compression: str = "none") -> str:
    """Folder of CSV exports written from the stored ledgers (once per source and ``compression``), the named ones or all:
    ``wallet/``, ``swap/``, ``wallet_master/`` (with a Wallet Pin column),
    ``dirty_wallet/``, ``late_wallet/`` (a later export with revised records),
    ``partial_wallet/`` (a header is missing) and ``master_by_country/`` (a file per
    nation). Rows are in order of the record id, across the files by name, too;
    the number of files follows from the size. Compressed ones (``gzip``) hold the same rows in files that are read from
    their start only: for header audits, not for reads in splits or digests."""
    from . import csv_ingest

    base = f"{work_root(spark)}/exports-{'' if compression == 'none' else compression + '-'}{_signature(sf_dir)}"

    def ordered(df: DataFrame, *more: str, rid: str | Column = "zoho_record_id") -> DataFrame:
        return df.repartitionByRange(rid).sortWithinPartitions(rid, *more)

    led = StoredLedgers(spark, sf_dir)
    pin = F.concat(F.lit("PIN-"), F.substring(F.sha2(F.col("zoho_record_id"), 256), 1, 6))

    def by_country() -> DataFrame:
        return led.wallets.repartition("country").sortWithinPartitions("country", "zoho_record_id")

    write = functools.partial(csv_ingest.export_csv, compression=compression)
    jobs = {
        "wallet": lambda p: write(ordered(led.wallet_transactions), "wallet", p),
        # the largest ledger, of which there is no other export: it is neither stored nor exchanged with its texts for this one
        "swap": lambda p: write(swap_transactions(spark, sf_dir, lambda df, rid: ordered(df, rid=rid)), "swap", p),
        "wallet_master": lambda p: write(ordered(led.wallets), "wallet_master", p, extra={"Wallet Pin": pin}),
        "dirty_wallet": lambda p: write(ordered(led.wallet_transactions), "wallet", p, overrides=dirty_overrides()),
        "late_wallet": lambda p: write(ordered(revisions(led.wallet_transactions), "source_row_number"), "wallet", p),
        "partial_wallet": lambda p: write(ordered(led.wallet_transactions), "wallet", p, leave_out=("Amount", "Type")),
        "master_by_country": lambda p: write(by_country(), "wallet_master", p, folder="country"),
    }
    for name in names or EXPORTS:
        if not _exists(spark, f"{base}/{name}"):
            jobs[name](f"{base}/{name}")
    return base


def revisions(wallet_tx: DataFrame) -> DataFrame:
    """An incoming batch for the versioned merge, derived from the stored
    wallet ledger: every row once (unchanged), plus for k%3 a newer copy with
    status 'Reversed', for k%4 an older copy with status 'Old', for k%5 a
    same-version copy with status 'Tie' and a higher row number, and new
    records 'wt-new-<k>' for k%9."""
    k = _order_key()
    base = wallet_tx.withColumn("_k", k)
    day = F.expr("INTERVAL 1 DAY")

    def copy(cond, status, shift, row_add, new_id=False):
        c = base.filter(cond(F.col("_k")))
        c = c.withColumn("status", F.lit(status))
        if shift is not None:
            c = c.withColumn("source_modified_at", F.col("source_modified_at") + shift)
        c = c.withColumn("source_row_number", F.col("source_row_number") + row_add)
        if new_id:
            c = c.withColumn("zoho_record_id", F.concat(F.lit("wt-new-"), F.col("_k").cast("string")))
        return c.withColumn("raw_record", F.concat(F.col("raw_record"), F.lit("|"), F.lit(status)))

    parts = [
        base,
        copy(lambda c: _m(c, 3), "Reversed", day, 1_000_000),
        copy(lambda c: _m(c, 4), "Old", -day, 2_000_000),
        copy(lambda c: _m(c, 5), "Tie", None, 3_000_000),
        copy(lambda c: _m(c, 9), "Committed", None, 4_000_000, new_id=True),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("_k")
