"""The drop-folder import stream: load order, idempotent replay, failures recorded."""

from __future__ import annotations

import csv
import os
import shutil
import tempfile

import pytest

from ledgermatch import schema as S
from ledgermatch.operators import merge as M
from ledgermatch.sinks import gold, store
from ledgermatch.streaming import file_drop

from test_ingest import MASTER, SWAP, WALLET, write_csv


def test_stream_imports_new_files_once(spark):
    work = tempfile.mkdtemp(prefix="run-stream-", dir="/tmp")
    drop, staging = os.path.join(work, "drop"), os.path.join(work, "staging")
    os.makedirs(drop), os.makedirs(staging)
    root, groot, cp = (os.path.join(work, n) for n in ("store", "gold", "checkpoint"))
    # swap arrives in the same batch as its wallet; load order puts the master first
    for name, ds, rows, extra in (("s.csv", "swap", [SWAP], ()), ("w.csv", "wallet", [WALLET], ()),
                                  ("m.csv", "wallet_master", [MASTER], ["Wallet Pin"])):
        write_csv(drop, name, ds, rows, extra)
    q = file_drop.start(spark, drop, root, gold_root=groot, checkpoint=cp)
    q.awaitTermination(300)
    audit = M.import_batches(spark, root).orderBy("batch_id").collect()
    assert [a.dataset for a in audit] == ["wallet_master", "wallet", "swap"]
    assert gold.read(spark, groot, "reconciliation").first().reconciliation_status == "matched"

    # a second run sees only the new files: a bad one (recorded) and a new wallet row
    shutil.copy(write_csv(staging, "bad.csv", "wallet", [dict(WALLET, **{"Amount": "NaN"})]), drop)
    shutil.copy(write_csv(staging, "w2.csv", "wallet", [dict(WALLET, **{"Record Id": "zcrm_t2"})]), drop)
    q = file_drop.start(spark, drop, root, gold_root=groot, checkpoint=cp)
    q.awaitTermination(300)
    assert M.import_batches(spark, root).count() == 4
    assert store.read(spark, root, "wallet_transactions", S.table_schema("wallet")).count() == 2
    assert file_drop.failed_imports(spark, root).count() == 1

    # a batch that is handed out again imports nothing twice
    again = [os.path.join(drop, "w2.csv")]
    assert [r["rows_applied"] for r in file_drop.import_batch(spark, again, root, batch="stream 7")] == [0]
    assert file_drop.import_batch(spark, again, root, batch="stream 7") == []
    assert M.import_batches(spark, root).count() == 5


def test_batch_with_ordinary_file_trouble(spark):
    work = tempfile.mkdtemp(prefix="run-drop-", dir="/tmp")
    root = os.path.join(work, "store")
    a, b = os.path.join(work, "a b"), os.path.join(work, "b")
    os.makedirs(a), os.makedirs(b)
    other = dict(WALLET, **{"Amount": "1.00"})
    first = write_csv(a, "Wallet Transactions.csv", "wallet", [WALLET])
    second = write_csv(b, "Wallet Transactions.csv", "wallet", [other])
    # same base name in two folders, same version: the later content wins, and the earlier one comes back
    for path in (first, second, first, second):
        assert [r["rows_applied"] for r in file_drop.import_batch(spark, [path], root)] == [1]
    # the same record with its columns in another order changes nothing
    with open(second, encoding="utf-8-sig", newline="") as f:
        rows = list(csv.reader(f))
    turned = os.path.join(b, "turned.csv")
    with open(turned, "w", encoding="utf-8", newline="") as f:
        csv.writer(f).writerows(row[::-1] for row in rows)
    assert [r["rows_applied"] for r in file_drop.import_batch(spark, [turned], root)] == [0]
    # an empty file is recorded, beside a good one and alone
    empty = os.path.join(work, "empty.csv")
    open(empty, "w").close()
    assert len(file_drop.import_batch(spark, [empty, first], root)) == 1
    assert file_drop.import_batch(spark, [empty], root) == []
    assert [r.error for r in file_drop.failed_imports(spark, root).collect()] == ["The file is empty."] * 2


def test_retry_after_a_failed_write(spark):
    root = os.path.join(tempfile.mkdtemp(prefix="run-retry-", dir="/tmp"), "store")
    rows = spark.range(3)

    def lost():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        store.commit(spark, root, "t", {"data": rows, "side": lost})
    assert store.latest_version(spark, root, "t") is None
    assert store.commit(spark, root, "t", {"data": rows, "side": rows}) == 1
    assert store.read(spark, root, "t").count() == 3
    assert store.history(spark, root, "t", "data").count() == 3  # not the failed attempt's rows
