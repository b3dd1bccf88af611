"""CSV ingest, validation, versioned merge and the atomic import unit (FIXTURES.md D)."""

from __future__ import annotations

import csv
import datetime as dt
import io
import os
import re
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgermatch import schema as S
from ledgermatch.operators import merge as M
from ledgermatch.operators import review as R
from ledgermatch.sinks import gold, store
from ledgermatch.sources import csv_ingest as I


def write_csv(folder, name, dataset, rows, extra_headers=(), drop=(), bom=True):
    headers = [h for h in S.headers_of(dataset) if h not in drop] + list(extra_headers)
    buf = io.StringIO()
    w = csv.DictWriter(buf, fieldnames=headers, lineterminator="\r\n")
    w.writeheader()
    for r in rows:
        w.writerow({h: r.get(h, "") for h in headers})
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8-sig" if bom else "utf-8", newline="") as f:
        f.write(buf.getvalue())
    return path


MASTER = {"Record Id": "zcrm_w1", "Wallet ID": "W-1", "Customer.id": "cust-1", "Customer ID": "RW-9",
          "Customer Name": "Rider, \"Quoted\"\nsecond line", "Country": "Rwanda", "Currency": "RWF",
          "Available Balance": "2377.10", "Created On": "2026-10-01 08:00:00", "Wallet Pin": "4321"}
WALLET = {"Record Id": "zcrm_t1", "Transaction ID": "TX-77", "Country": "Rwanda", "Status": "Committed",
          "Type": "Debit", "Settled Against": "Swap", "Wallet.id": "zcrm_w1", "Amount": "2377.10",
          "Created On": "2026-10-02 09:00:00", "Modified Time": "2026-10-02 09:00:00"}
SWAP = {"Record Id": "zcrm_s1", "Transaction ID": "TX-77", "Country": "Rwanda", "Status": "SUCCESS",
        "Customer.id": "cust-1", "Pay Method": "WALLET", "Swap Amount": "2377.10", "Swap Date": "2026-10-02",
        "Created On": "2026-10-02 09:00:02"}


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="run-ingest-", dir="/tmp")


def test_detection_pin_removal_and_quoting(spark, folder):
    path = write_csv(folder, "master.csv", "wallet_master", [MASTER], extra_headers=["Wallet Pin"])
    audit = I.header_audit(spark, path).first()
    assert audit.dataset == "wallet_master" and audit.problem is None
    res = I.ingest(spark, path)["wallet_master"]
    row = res.rows.first()
    assert "Wallet Pin" not in row.raw_record and "4321" not in row.raw_record
    assert "wallet_pin" not in res.rows.columns
    assert row.customer_name == 'Rider, "Quoted"\nsecond line'
    assert row.available_balance == Decimal("2377.10")
    assert (row.source_file, row.source_row_number) == ("master.csv", 1)


def test_bad_values_are_rejected_with_record_and_field(spark, folder):
    rows = [dict(MASTER, **{"Record Id": f"w{i}", "Available Balance": bal})
            for i, bal in enumerate(["NaN", "not-a-number", "1.5", "Infinity", "1.1234567890123"])]
    rows.append(dict(MASTER, **{"Record Id": "w9", "Created On": "2026-09-23T12:00:00+03:00"}))
    rows.append(dict(MASTER, **{"Record Id": "  "}))
    path = write_csv(folder, "bad.csv", "wallet_master", rows)
    rej = {r.source_row_number: r.reject_reason for r in I.ingest(spark, path)["wallet_master"].rejects.collect()}
    assert rej == {
        1: "record 1: Available Balance holds no finite amount",
        2: "record 2: Available Balance is not a decimal number",
        4: "record 4: Available Balance holds no finite amount",
        5: "record 5: Available Balance is not a decimal number",
        6: "record 6: Created On carries a zone offset; stored times have none",
        7: "record 7: Record Id is empty but required",
    }


def test_decimals_of_many_digits_are_exact(spark, folder):
    texts = {"1.1234567": "1.1234567", "12345678901234567890123456.000000000001": "12345678901234567890123456.000000000001",
             "0.5000000000000000": "0.5", "-25e-10": "-0.0000000025", "1200e-14": "0.000000000012", "1.5e20": "150000000000000000000",
             "+.25": "0.25", "0.00000000000000": "0", "0e-40": "0"}
    rows = [dict(MASTER, **{"Record Id": f"w{i}", "Available Balance": t}) for i, t in enumerate(texts)]
    rows += [dict(MASTER, **{"Record Id": f"x{i}", "Available Balance": t}) for i, t in enumerate(["1e-13", "1e26", "12.e", "."])]
    res = I.ingest(spark, write_csv(folder, "wide.csv", "wallet_master", rows))["wallet_master"]
    got = {r.zoho_record_id: r.available_balance for r in res.rows.collect()}
    assert got == {f"w{i}": Decimal(v) for i, v in enumerate(texts.values())}
    assert res.rejects.count() == 4


def test_wrong_field_count_and_incomplete_headers(spark, folder):
    path = write_csv(folder, "w.csv", "wallet", [WALLET])
    with open(path, "a", encoding="utf-8") as f:
        f.write("zcrm_t2,TX-78\r\n")
    rej = I.ingest(spark, path)["wallet"].rejects.collect()
    assert [r.reject_reason for r in rej] == ["record 2: does not have as many fields as the header"]
    other = tempfile.mkdtemp(prefix="run-ingest-", dir="/tmp")
    bad = write_csv(other, "partial.csv", "wallet", [WALLET], drop=("Amount",))
    with pytest.raises(ValueError, match="fit none of the three"):
        I.ingest(spark, bad)


def test_preview_rejects_countries_outside_domain(spark, folder):
    rows = [dict(SWAP, **{"Record Id": "s1"}), dict(SWAP, **{"Record Id": "s2", "Country": "Uganda"}),
            dict(SWAP, **{"Record Id": "s3", "Country": ""})]
    path = write_csv(folder, "swaps.csv", "swap", rows)
    counts, countries, statuses = I.validate_preview(I.ingest(spark, path)["swap"].rows, "swap")
    c = counts.first()
    assert c.rows == 3 and c.first_bad_country_record == 2 and c.out_of_domain_rows == 2
    assert not c.export_cap_warning


def test_reimport_is_idempotent_and_end_to_end_match(spark, folder):
    root = os.path.join(folder, "store")
    files = {"wallet_master": [write_csv(folder, "m.csv", "wallet_master", [MASTER], ["Wallet Pin"])],
             "wallet": [write_csv(folder, "w.csv", "wallet", [WALLET])],
             "swap": [write_csv(folder, "s.csv", "swap", [SWAP])]}
    first = M.batch_load(spark, root, files)
    assert [r["rows_applied"] for r in first] == [1, 1, 1]
    again = M.import_file(spark, root, files["wallet"][0])
    assert again["rows_applied"] == 0
    led = R.Ledgers(*(store.read(spark, root, S.TABLES[d], S.table_schema(d))
                      for d in ("wallet_master", "wallet", "swap")))
    r = R.backend_reconciliation(led).first()
    assert (r.reconciliation_status, r.wallet_currency) == ("matched", "RWF")
    from ledgermatch.operators import query as Q
    page = Q.list_records(R.backend_reconciliation(led), Q.ReconciliationFilter(country="Rwanda"))
    assert str(page["records"][0]["wallet_amount"]) == "2377.10"
    audit = M.import_batches(spark, root).orderBy("batch_id").collect()
    assert [a.rows_applied for a in audit] == [1, 1, 1, 0]
    # gold: refresh builds once per source revision
    groot = os.path.join(folder, "gold")
    rev = gold.source_revision(spark, root)
    assert gold.refresh(spark, groot, led, rev) is True
    assert gold.refresh(spark, groot, led, rev) is False
    assert gold.difference(gold.read(spark, groot, "reconciliation").drop("wallet_imported_at"),
                           R.backend_reconciliation(led).drop("wallet_imported_at")).first() == (0, 0)
    assert not gold.is_fresh(spark, groot, gold.source_revision(spark, root) + "x")


def test_failed_file_leaves_no_version_and_no_audit(spark, folder):
    root = os.path.join(folder, "store")
    bad = write_csv(folder, "bad.csv", "wallet", [WALLET, dict(WALLET, **{"Record Id": "t2", "Amount": "NaN"})])
    with pytest.raises(ValueError, match="record 2"):
        M.import_file(spark, root, bad)
    assert store.latest_version(spark, root, "wallet_transactions") is None
    assert M.import_batches(spark, root).count() == 0


def test_latest_version_per_record_and_guarded_update(spark):
    rows = [("a", "2026-01-01 00:00:00", None, 1, "r1", "x"), ("a", "2026-01-02 00:00:00", None, 2, "r2", "y"),
            ("a", None, "2026-01-02 00:00:00", 3, "r3", "z"), ("b", None, None, 1, "r4", "p"),
            ("b", None, None, 2, "r5", "q")]
    df = spark.createDataFrame(rows, "zoho_record_id string, source_modified_at string, source_change_at string, "
                                     "source_row_number long, raw_record string, status string") \
        .selectExpr("zoho_record_id", "cast(source_modified_at as timestamp_ntz) source_modified_at",
                    "cast(source_change_at as timestamp_ntz) source_change_at", "source_row_number", "raw_record",
                    "status")
    newest = {r.zoho_record_id: r.status for r in M.latest_per_record(df).collect()}
    assert newest == {"a": "z", "b": "q"}      # tie on version -> highest row number; NULL version lowest
    existing = df.filter("source_row_number = 2").withColumn("imported_at", df.source_row_number.cast("timestamp"))
    incoming = df.filter("source_row_number = 1").withColumn("imported_at", df.source_row_number.cast("timestamp"))
    merged = {r.zoho_record_id: (r.status, r._applied) for r in M.upsert(existing, incoming).collect()}
    # a: older incoming version -> kept; b: both versions NULL (equal) and raw differs -> replaced
    assert merged == {"a": ("y", False), "b": ("p", True)}


def test_written_scale(spark):
    df = spark.createDataFrame([(t,) for t in ("120.10", "7", ".5", "1.5e1", "15e-3", "-3.000", "+2.50")], "t string")
    got = [r.s for r in df.select(I.written_scale(df.t).alias("s")).collect()]
    assert got == [2, 0, 1, 0, 3, 3, 2]


def test_inspect_preview_and_its_errors(spark, folder):
    good = write_csv(folder, "ok.csv", "swap", [SWAP, dict(SWAP, **{"Record Id": "s2", "Status": ""})])
    p = I.inspect(spark, good)
    assert (p["dataset"], p["module"], p["rows"], p["countries"]) == ("swap", "Swapping transactions", 2,
                                                                      {"Rwanda": 2})
    assert p["statuses"] == {"SUCCESS": 1, "Unspecified": 1} and p["export_cap_warning"] is False
    other = tempfile.mkdtemp(prefix="run-ingest-", dir="/tmp")
    bad = write_csv(other, "ug.csv", "swap", [SWAP, dict(SWAP, **{"Record Id": "s2", "Country": "Uganda"})])
    with pytest.raises(ValueError, match="Record 2: the country is none of"):
        I.inspect(spark, bad, ("Kenya", "Rwanda"))
    third = tempfile.mkdtemp(prefix="run-ingest-", dir="/tmp")
    empty = write_csv(third, "empty.csv", "swap", [])
    with pytest.raises(ValueError, match="No record follows"):
        I.inspect(spark, empty)


def test_file_names_with_spaces_and_glob_characters(spark, tmp_path):
    """An export whose name holds a space, a plus, a percent sign and brackets is audited and read."""
    headers = list(S.headers_of("wallet"))
    for name in ("Wallet Transactions (1).csv", "a+b 100% [x].csv"):
        (tmp_path / name).write_text(",".join(f'"{h}"' for h in headers) + "\n" + ",".join(
            '"r1"' if h == "Record Id" else '""' for h in headers) + "\n")
    audit = I.header_audit(spark, str(tmp_path)).collect()
    assert {r.dataset for r in audit} == {"wallet"} and all(" " in r.file_path for r in audit)
    parsed = I.ingest(spark, str(tmp_path))["wallet"].parsed
    assert parsed.count() == 2


def test_one_merge_per_batch_equals_one_by_one(spark, folder):
    """For files in any order with repeated, older, tied and equal records: table, counts and audit agree."""
    import random

    rnd = random.Random(8)
    names = []
    for k in range(3):
        rows = [dict(WALLET, **{"Record Id": f"r{rnd.randrange(6)}", "Amount": f"{rnd.randrange(3)}.5",
                                "Modified Time": rnd.choice(["", "2026-01-01 00:00:00", "2026-01-02 00:00:00"])}) for _ in range(8)]
        names.append(write_csv(folder, f"w{k}.csv", "wallet", rows))
    names.append(write_csv(folder, "bad.csv", "wallet", [dict(WALLET, **{"Record Id": "r1", "Amount": "NaN"})]))
    names.append(write_csv(folder, "none.csv", "wallet", []))
    for run in range(1):
        rnd.shuffle(names)
        apart, together = (os.path.join(folder, f"{n}{run}") for n in ("apart", "together"))
        want = []
        for p in names:
            try:
                want.append(M.import_file(spark, apart, p, "wallet")["rows_applied"])
            except ValueError as exc:
                want.append(str(exc))
        got = [r["error"] or r["rows_applied"] for r in M.import_files(spark, together, names, "wallet")]
        assert got == want and any(isinstance(x, str) for x in want)
        cols = [c for c in S.stored_columns("wallet") if c != "imported_at"]
        tables = [sorted(map(str, store.read(spark, root, "wallet_transactions").select(*cols).collect())) for root in (apart, together)]
        assert tables[0] == tables[1]
        audits = [[(a.batch_id, a.source_file, a.sha256, a.rows_read, a.rows_applied) for a in M.import_batches(spark, root).orderBy(
            "batch_id").collect()] for root in (apart, together)]
        assert audits[0] == audits[1]
        assert store.latest_version(spark, together, "wallet_transactions") == 1  # one rewrite for all files


def test_configured_load_stops_at_a_bad_file_and_dry_run(spark, folder):
    good = write_csv(folder, "jan_w.csv", "wallet", [WALLET])
    bad = write_csv(folder, "feb_w.csv", "wallet", [dict(WALLET, **{"Record Id": "t2", "Amount": "x"})])
    late = write_csv(folder, "mar_w.csv", "wallet", [dict(WALLET, **{"Record Id": "t3"})])
    root = os.path.join(folder, "store")
    with pytest.raises(ValueError, match="feb_w.csv: record 1"):
        M.batch_load(spark, root, {"wallet": [good, bad, late]})
    assert store.read(spark, root, "wallet_transactions").count() == 1
    profile = M.dry_run(spark, {"wallet": [good, late], "swap": [write_csv(folder, "jan_s.csv", "swap", [SWAP])]}, file_prefix="jan")
    assert [(r.file, r.dataset, r.rows) for r in profile.orderBy("position").collect()] == [
        ("jan_w.csv", "wallet", 1), ("jan_s.csv", "swap", 1)]
    with pytest.raises(ValueError, match="begins with 'dec'"):
        M.dry_run(spark, {"wallet": [good]}, file_prefix="dec")
    with pytest.raises(ValueError, match="No wallet master"):
        M.batch_load(spark, root, {"wallet": [good]}, master_only=True)
    with pytest.raises(ValueError, match="record 1"):
        M.dry_run(spark, {"wallet": [bad]})
    recent = M.recent_imports(spark, root).collect()
    assert [(r.module, r.source_file) for r in recent] == [("Wallet transactions", "jan_w.csv")]


def test_one_file_changes_what_the_fold_of_its_list_changes(spark):
    cols = "zoho_record_id string, source_modified_at timestamp_ntz, source_change_at timestamp_ntz, raw_record string"
    day = [dt.datetime(2026, 1, d) for d in (1, 2, 3)]
    stored = spark.createDataFrame([("a", day[1], None, "x"), ("b", day[1], None, "x"), ("c", day[1], None, "x"), ("d", None, None, None)], cols)
    new = spark.createDataFrame([("a", day[0], None, "y"), ("b", day[1], None, "x"), ("c", day[1], day[2], "y"),
                                 ("d", None, None, "z"), ("e", None, None, None), (None, day[0], None, "n")], cols).withColumn("file_no", F.lit(3))
    fold, one = (sorted(map(str, f(new, stored).collect())) for f in (M.fold, M.changed_by_one))
    assert fold == one and len(one) == 4
    assert "collect_list" not in M.changed_by_one(new, stored)._jdf.queryExecution().toString()


def test_a_file_without_repeated_ids_is_not_exchanged_whole(spark):
    cols = "zoho_record_id string, source_modified_at timestamp_ntz, source_change_at timestamp_ntz, source_row_number long, raw_record string, file_no int"
    day = [dt.datetime(2026, 1, d) for d in (1, 2)]
    once = [("a", day[0], None, 1, "a1", 0), ("b", None, None, 2, "b1", 0), (None, day[0], None, 3, "n", 0)]
    again = [("a", day[1], None, 1, "a2", 1), ("a", day[0], None, 2, "a3", 1), ("c", None, None, 3, "c1", 1), ("c", None, None, 4, "c2", 1)]
    apart = M.newest_by_file(spark.createDataFrame(once, cols))
    assert "max_by" not in apart._jdf.queryExecution().toString() and sorted(map(str, apart.collect())) == sorted(map(str, spark.createDataFrame(once, cols).collect()))
    both = M.newest_by_file(spark.createDataFrame(once + again, cols)).select("zoho_record_id", "raw_record", "file_no").collect()
    assert sorted(map(tuple, both), key=str) == sorted([("a", "a1", 0), ("b", "b1", 0), (None, "n", 0), ("a", "a2", 1), ("c", "c2", 1)], key=str)


def test_a_field_is_cleaned_and_typed_once(spark, folder):
    """Plain amounts and others give the same values, scales and errors; no expression is repeated for each that reads it."""
    texts = ["7", "-0.50", "00012.340000000000", "1" * 26 + "." + "9" * 12, "1" * 27, "1.1234567890123", "1.1234567890120", " 1e2 ", "+5", ".5", "5.", "NaN", "-",
             "1e-3", "x", "   "]
    rows = [dict(WALLET, **{"Record Id": f"t{i}", "Amount": t}) for i, t in enumerate(texts)]
    parsed = I.ingest(spark, write_csv(folder, "amounts.csv", "wallet", rows))["wallet"].parsed
    got = {r.zoho_record_id: (r.amount, r.amount_scale, r.reject_message) for r in parsed.collect()}
    bad, none = "Amount is not a decimal number", (None, None, None)
    want = [(Decimal(7), 0, None), (Decimal("-0.5"), 2, None), (Decimal("12.34"), 12, None), (Decimal("1" * 26 + "." + "9" * 12), 12, None),
            (None, None, bad), (None, None, bad), (Decimal("1.123456789012"), 13, None), (Decimal(100), 0, None), (Decimal(5), 0, None),
            (Decimal("0.5"), 1, None), (Decimal(5), 0, None), (None, None, "Amount holds no finite amount"), (None, None, bad),
            (Decimal("0.001"), 3, None), (None, None, bad), none]
    assert [got[f"t{i}"] for i in range(len(texts))] == want
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(I.BLANK_RE) <= len(S.FIELD_MAPS["wallet"])


@pytest.mark.parametrize("dataset", list(S.FIELD_MAPS))
def test_parse_is_made_of_methods_that_the_jvm_compiles(spark, tmp_path, dataset):
    """HotSpot interprets methods of more than 8000 bytes for good."""
    path = tmp_path / "export.csv"
    path.write_text(",".join(S.headers_of(dataset)) + "\n" + "id" + "," * (len(S.headers_of(dataset)) - 1) + "\n")
    read = I.ingest(spark, str(path), dataset)[dataset]
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # whose plans show no code before they run
    try:
        for df in (read.parsed, read.rows, I.status_counts(read.rows, dataset)):
            code = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
            sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
            assert sizes and max(sizes) < 8000, (dataset, sizes)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
