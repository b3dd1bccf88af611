"""What the derivation of ledgers and exports writes, on own rows."""

from __future__ import annotations

import datetime as dt
import glob
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgermatch import catalog
from ledgermatch import schema as S
from ledgermatch.functions import arrays
from ledgermatch.operators import review as R
from ledgermatch.session import work_root
from ledgermatch.sinks import exports as E
from ledgermatch.sinks import gold as GOLD
from ledgermatch.sources import adapter, csv_ingest


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    day = dt.datetime(1995, 6, 1)
    rows = {
        "orders": ([(k, k % 7, "OFP"[k % 3], 10.25 + k, day + dt.timedelta(days=k), "1-URGENT") for k in range(130)],
                   "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
                   "o_orderpriority string"),
        "lineitem": ([(k, ln) for k in range(130) for ln in (1, 2, 2, None)], "l_orderkey bigint, l_linenumber int"),
        "customer": ([(c, f"Customer {c}", c % 3, 1.5 * c, "MACHINERY") for c in range(7)],
                     "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "nation": ([(0, "NATION_0"), (1, "NATION_1"), (2, "NATION_2")], "n_nationkey int, n_name string"),
    }
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return folder


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def _ledger(spark, tables: str, name: str) -> str:
    return _local(f"{work_root(spark)}/ledgers-{adapter._signature(tables)}/{name}")


def _lines(spark, path: str) -> list[str]:
    return [r.value for r in spark.read.text(path).collect()]


def test_swap_export_is_made_of_narrow_rows(spark, tables, tmp_path):
    path = f"{adapter.exports(spark, tables, 'swap')}/swap"
    assert not os.path.exists(_ledger(spark, tables, "swap_transactions"))  # one export does not need it stored
    csv_ingest.export_csv(adapter.stored_ledger(spark, tables, "swap_transactions"), "swap", str(tmp_path / "ledger"))
    header = _lines(spark, path)[0]
    rows = lambda p: sorted(x for x in _lines(spark, p) if x != header)
    assert len(rows(path)) == 130 * 3 and rows(path) == rows(str(tmp_path / "ledger"))
    ids = [r["Record Id"] for f in sorted(glob.glob(f"{_local(path)}/*.csv"))
           for r in spark.read.option("header", "true").csv(f).select("Record Id").collect()]
    kept = [x for x in ids if x is not None]
    assert ids == [None] * 130 + sorted(kept)


def test_stored_ledgers_and_gold_are_compressed_well(spark, tables):
    adapter.stored_ledger(spark, tables, "wallet_transactions")
    gold = _local(catalog._gold_root(spark, tables))
    for pattern in (f"{_ledger(spark, tables, 'wallet_transactions')}/*.parquet", f"{gold}/gold/v=*/reconciliation/*.parquet"):
        files = glob.glob(pattern)
        assert files and all(f.endswith(".zstd.parquet") for f in files)


def test_headers_are_audited_on_compressed_exports(spark, tables):
    plain = _local(f"{work_root(spark)}/exports-{adapter._signature(tables)}")
    got = catalog.REGISTRY["ingest_header_check"](spark, tables).collect()
    assert not os.path.exists(f"{plain}/partial_wallet")  # no plain copy is written for an audit
    audit = csv_ingest.header_audit(spark, f"{adapter.exports(spark, tables)}/*/*.csv").collect()
    assert {(r.folder, r.columns, r.refused) for r in got} == {
        (r.file_path.split("/")[-2], len(r.headers), r.problem is not None) for r in audit}
    assert {r.folder: r.missing_for_wallet for r in got}["partial_wallet"] == "Amount|Type"
    packed = adapter.exports(spark, tables, compression="gzip")
    for name in ("swap", "late_wallet"):
        assert sorted(_lines(spark, f"{packed}/{name}")) == sorted(_lines(spark, f"{plain}/{name}"))


def test_texts_of_a_shared_key_are_written_once_and_not_once_per_debit(spark, tmp_path, monkeypatch):
    """customer_review and backend_reconciliation: the arrays of a key that 400 debits share, amid keys of one debit each.

    A dictionary of 40 kB stands for the 1 MB of larger tables."""
    def ledger(dataset, rows):
        blank = dict.fromkeys(S.table_schema(dataset).fieldNames()) | {"source_file": "f", "source_row_number": 1, "raw_record": "{}"}
        return spark.createDataFrame([tuple((blank | r).values()) for r in rows], S.table_schema(dataset))

    def key(i, hot):
        return {"transaction_id": "HOT" if hot else None if i % 50 == 7 else f"t{i}", "country": None if i % 40 == 3 else "Kenya"}

    debits = [key(i, i < 400) | {"zoho_record_id": f"d{i}", "wallet_id": "w", "transaction_type": "Debit", "status": "Committed",
                                 "settled_against": "Swap", "amount": Decimal("1.00")} for i in range(6000)]
    swaps = [key(i, i < 400) | {"zoho_record_id": f"s{i}", "status": "SUCCESS", "swap_amount": Decimal("1.00"), "customer_id": f"c{i}",
                                "swap_reference": None if i % 9 == 0 else f"reference-{i:08d}", "payment_method": "WALLET"} for i in range(6000)]
    led = R.Ledgers(ledger("wallet_master", [{"zoho_record_id": "w", "country": "Kenya"}]), ledger("wallet", debits), ledger("swap", swaps))
    monkeypatch.setattr(catalog, "ledgers", lambda spark, sf_dir: led)
    for name, plain in (("customer_review", R.customer_review), ("backend_reconciliation", R.backend_reconciliation)):
        got, want = catalog.REGISTRY[name](spark, ""), catalog.comparable(plain(led, shown=arrays.render))
        assert got.dtypes == want.dtypes
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
        got.write.option("compression", "none").option("parquet.dictionary.page.size", 40_000).parquet(str(tmp_path / name))
        text = got.agg(F.sum(F.length("swap_references"))).first()[0]
        written = sum(f.stat().st_size for f in (tmp_path / name).glob("*.parquet"))
        assert written < text / 2, (name, written, text)


def _shared_key_ledgers(spark):
    """400 debits and swaps share a key amid 5,600 keys of one debit each; some ids and countries are NULL."""
    def ledger(dataset, rows):
        blank = dict.fromkeys(S.table_schema(dataset).fieldNames()) | {"source_file": "f", "source_row_number": 1, "raw_record": "{}"}
        return spark.createDataFrame([tuple((blank | r).values()) for r in rows], S.table_schema(dataset))

    def key(i):
        return {"transaction_id": "HOT" if i < 400 else None if i % 50 == 7 else f"t{i}",
                "country": None if i >= 400 and i % 40 == 3 else "Kenya"}

    debits = [key(i) | {"zoho_record_id": f"d{i}", "wallet_id": "w", "transaction_type": "Debit", "status": "Committed",
                        "settled_against": "Swap", "amount": Decimal("1.00")} for i in range(6000)]
    swaps = [key(i) | {"zoho_record_id": f"s{i}", "status": "SUCCESS", "swap_amount": Decimal("1.00"), "customer_id": f"customer-{i:08d}",
                       "swap_reference": None if i % 9 == 0 else f"reference-{i:08d}", "payment_method": "WALLET"} for i in range(6000)]
    return R.Ledgers(ledger("wallet_master", [{"zoho_record_id": "w", "country": "Kenya"}]), ledger("wallet", debits), ledger("swap", swaps))


def _written_once(got, want, column, path):
    assert got.dtypes == want.dtypes
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    got.write.option("compression", "none").option("parquet.dictionary.page.size", 40_000).parquet(str(path))
    text = got.agg(F.sum(F.length(column))).first()[0]
    written = sum(f.stat().st_size for f in path.glob("*.parquet"))
    assert written < text / 2, (written, text)


def test_status_review_and_lookup_check_write_shared_texts_once(spark, tmp_path, monkeypatch):
    led = _shared_key_ledgers(spark)
    monkeypatch.setattr(catalog, "ledgers", lambda spark, sf_dir: led)
    _written_once(catalog.REGISTRY["wallet_swap_review"](spark, ""), catalog.comparable(R.wallet_swap_review(led)),
                  "swap_references", tmp_path / "review")
    want = R.customer_review(led).select("wallet_record_id", "wallet_customer_id", "customer_ids", "swap_customer_lookup_check")
    _written_once(catalog.REGISTRY["customer_lookup_check"](spark, ""), catalog.comparable(want), "customer_ids", tmp_path / "lookup")


def test_gold_reconciliation_writes_shared_texts_once(spark, tmp_path, monkeypatch):
    led = _shared_key_ledgers(spark)
    root = f"{tmp_path}/gold"
    GOLD.refresh(spark, root, led, revision="1")
    monkeypatch.setattr(catalog, "_gold_root", lambda spark, sf_dir: root)
    want = catalog.comparable(GOLD.read(spark, root, "reconciliation", shown=arrays.render))
    _written_once(catalog.REGISTRY["gold_reconciliation"](spark, ""), want, "swap_references", tmp_path / "out")
    # above the bound the rows come as before
    lean, values = GOLD.read(spark, root, "reconciliation", arrays=False), GOLD.store.read(spark, root, GOLD.GOLD, part=GOLD.VALUES)
    plain = catalog.comparable(E.grouped_rows(lean, values, arrays.render, max_bytes=10))
    assert plain.dtypes == want.dtypes and plain.exceptAll(want).isEmpty() and want.exceptAll(plain).isEmpty()
