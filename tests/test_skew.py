"""Hot keys: one transaction id holds a third of all rows, NULL ids pile up in
one country. Results must equal a brute-force restatement, and the plan must
not gather a hot group in one task (no window; partial aggregation; AQE may
split the hot join partition)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pandas as pd
import pytest

from ledgermatch import schema as S
from ledgermatch.operators import counterparts as G
from ledgermatch.operators import review as R

N = 6000


def _ledgers(spark):
    t0 = dt.datetime(2026, 1, 1)
    debits, swaps = [], []
    for i in range(N):
        tx = "HOT" if i % 3 == 0 else (None if i % 7 == 0 else f"tx-{i}")
        debits.append(dict(zoho_record_id=f"d{i}", transaction_id=tx, wallet_id="w", country="Kenya",
                           transaction_type="Debit", status="Committed", settled_against="Swap",
                           amount=Decimal("10.00"), created_on=t0 + dt.timedelta(minutes=i)))
        stx = "HOT" if i % 3 == 1 else f"tx-{i}"
        swaps.append(dict(zoho_record_id=f"s{i}", transaction_id=stx, country="Kenya",
                          status="SUCCESS" if i % 5 else "FAILED", swap_amount=Decimal("10.00"),
                          customer_id=f"c{i % 11}", payment_method="WALLET", swap_reference=f"r{i % 13}",
                          created_on=t0 + dt.timedelta(minutes=i, seconds=2)))

    def frame(dataset, rows):
        names = S.table_schema(dataset).fieldNames()
        full = [tuple({**{n: None for n in names}, "source_file": "f", "source_row_number": 1,
                       "raw_record": "{}", **r}[n] for n in names) for r in rows]
        return spark.createDataFrame(full, S.table_schema(dataset)).repartition(8)

    wallets = spark.createDataFrame([], S.table_schema("wallet_master"))
    return R.Ledgers(wallets, frame("wallet", debits), frame("swap", swaps)), pd.DataFrame(debits), pd.DataFrame(swaps)


def _brute(debits: pd.DataFrame, swaps: pd.DataFrame) -> dict:
    key = debits["transaction_id"].fillna("\0null")
    wallet_count = key.map(key.value_counts())
    grp = swaps.groupby("transaction_id")
    sc = grp.size()
    ok = swaps[swaps.status == "SUCCESS"].groupby("transaction_id").size()
    out = {}
    for rid, tx, wc in zip(debits.zoho_record_id, debits.transaction_id, wallet_count):
        if tx is None:
            out[rid] = ("missing_wallet_transaction_id", wc)
        elif wc > 1 or ok.get(tx, 0) > 1:
            out[rid] = ("ambiguous_transaction_id", wc)
        elif tx not in sc:
            out[rid] = ("no_swap_in_loaded_data", wc)
        elif ok.get(tx, 0) == 0:
            out[rid] = ("no_successful_swap_in_loaded_data", wc)
        else:
            out[rid] = ("matched", wc)
    return out


@pytest.fixture()
def skew_conf(spark):
    keys = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB",
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def test_hot_key_review_matches_brute_force(spark, skew_conf):
    led, debits, swaps = _ledgers(spark)
    review = R.wallet_swap_review(led)
    got = {r.wallet_record_id: (r.reconciliation_status, r.wallet_count) for r in review.collect()}
    assert got == _brute(debits, swaps)
    hot = review.filter("transaction_id = 'HOT'").first()
    assert hot.wallet_count == N // 3 and hot.swap_count == N // 3
    assert hot.swap_references == [f"r{i}" for i in sorted(range(13), key=lambda i: f"r{i}")]


def test_hot_key_gaps_match_brute_force(spark, skew_conf):
    led, debits, swaps = _ledgers(spark)
    swap_keys = set(swaps.transaction_id)
    expected = {rid for rid, tx in zip(debits.zoho_record_id, debits.transaction_id)
                if tx is None or tx not in swap_keys}
    assert {r.wallet_record_id for r in G.wallet_without_swap(led).collect()} == expected


def test_candidates_of_a_hot_key_join_their_arrays_after_the_sort(spark):
    from ledgermatch.sinks import exports as E

    led, _, _ = _ledgers(spark)
    plain = [tuple(r) for r in E.review_candidates(R.backend_reconciliation(led)).collect()]
    for max_bytes in (E.SHARED_BYTES, 0):
        df = E.live_candidates(led, max_bytes=max_bytes)
        assert df.columns == list(E.REVIEW_EXPORT_FIELDS)
        assert [tuple(r) for r in df.collect()] == plain
    at = E.REVIEW_EXPORT_FIELDS.index("swap_references")
    assert sum(r[at] is not None and r[at].startswith('["r0", "r1"') for r in plain) == N // 3


def test_a_page_gets_the_arrays_of_its_keys(spark):
    from ledgermatch.operators import query as Q

    led, _, _ = _ledgers(spark)
    recon = R.backend_reconciliation(led)
    page = Q.page_frame(recon.drop(*R.LISTED.values()), limit=20)
    assert "swap_references" not in page.columns
    got = R.with_page_arrays(page, led).select(*Q.DETAIL_FIELDS).collect()
    assert got == Q.page_frame(recon, limit=20).select(*Q.DETAIL_FIELDS).collect()
