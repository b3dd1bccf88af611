"""Physical-plan assertions: shuffle count, no window on the hot key,
bounded broadcasts, anti joins on pre-aggregated keys, scan pushdown."""

from __future__ import annotations

import pytest

from ledgermatch import catalog
from ledgermatch.operators import counterparts as G
from ledgermatch.operators import review as R
from ledgermatch.plans.inspect import count_ops, plan_text

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def led(spark):
    return catalog.ledgers(spark, SF)


@pytest.fixture()
def no_auto_broadcast(spark):
    """The plan large inputs get: no size-based broadcast of either side."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_review_core_exchanges_both_join_sides_and_has_no_window(led, no_auto_broadcast):
    df = R.wallet_swap_review(led)
    text = plan_text(df)
    # the per-key aggregate's output partitioning is reused by the join
    # the key aggregate, and one exchange of its own per join side: only then can AQE split a hot key
    assert count_ops(df, "Exchange") == 3, text
    assert "Window" not in text
    # partial aggregation before the shuffle (map-side combine of hot keys)
    assert count_ops(df, "ObjectHashAggregate") + count_ops(df, "HashAggregate") >= 2


def test_bounds_join_is_a_checked_broadcast(led):
    text = plan_text(R.backend_reconciliation(led))
    assert "BroadcastExchange" in text and "InMemoryRelation" not in text and "/side-" in text


def test_gap_reports_use_anti_join_on_distinct_keys(led):
    for df in (G.wallet_without_swap(led), G.swap_without_wallet(led)):
        text = plan_text(df)
        assert "LeftAnti" in text
        assert "Window" not in text


def test_filters_and_columns_reach_the_scan(led):
    text = plan_text(R.eligible_debits(led.wallet_transactions).select("zoho_record_id"))
    assert "EqualTo(transaction_type,Debit)" in text and "EqualTo(status,Committed)" in text
    read = [line for line in text.splitlines() if "ReadSchema" in line]
    assert read and "amount" not in read[0] and "narration" not in read[0]


def test_page_is_a_take_ordered(led):
    from ledgermatch.operators import query as Q
    text = plan_text(Q.page_frame(R.backend_reconciliation(led), limit=10))
    assert "TakeOrderedAndProject" in text


def test_upsert_streams_the_table_through_a_broadcast_join(led, spark):
    from ledgermatch.operators import merge as M
    from ledgermatch.sources import adapter

    incoming = adapter.revisions(led.wallet_transactions)
    small = M.merge(led.wallet_transactions, incoming)
    text = plan_text(small)
    assert "BroadcastHashJoin LeftOuter" in text and "FullOuter" not in text
    big = M.upsert(led.wallet_transactions, M.latest_per_record(incoming), max_broadcast_bytes=0)
    assert "FullOuter" in plan_text(big)
    cols = ["zoho_record_id", "status", "source_modified_at", "source_row_number", "raw_record", "_applied"]
    assert small.select(*cols).exceptAll(big.select(*cols)).count() == 0
    assert big.select(*cols).exceptAll(small.select(*cols)).count() == 0


def test_summaries_build_no_per_key_arrays(led):
    """R6 and R9 read fixed-size aggregates; the per-key arrays are output
    columns only, pruned from every plan that does not return them."""
    from ledgermatch.operators import query as Q
    for df in (Q.summary_groups(R.backend_reconciliation(led)), catalog.REGISTRY["missing_report_stats"](
            led.wallets.sparkSession, SF)):
        text = plan_text(df)
        assert "collect_set" not in text, text


def test_nothing_is_exchanged_once_debits_have_their_arrays(led, no_auto_broadcast):
    """The join with the key statistics comes last: d debits and s swaps of a key are d x s array elements from there on."""
    for df in (R.customer_review(led), R.backend_reconciliation(led)):
        text = plan_text(df)
        last = next(line for line in text.splitlines() if "Join" in line)
        assert "Inner" in last and "Exchange" not in text.split(last)[0], text


def test_only_the_named_ledgers_and_exports_are_derived(spark, tmp_path, monkeypatch):
    from ledgermatch.sources import adapter

    monkeypatch.setattr(adapter, "work_root", lambda spark: str(tmp_path))
    base = adapter.exports(spark, SF, "master_by_country")
    assert [f.name for f in sorted(tmp_path.glob("*/*"))] == ["master_by_country", "wallets"]
    assert base.startswith(str(tmp_path))
