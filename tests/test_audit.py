"""Compliance operators on hand-made audit rows."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from lakeaudit.contracts import DISCLOSURES, TRANSACTIONS
from lakeaudit.operators import deadlines, reconcile, summaries, trails


def _ts(s):
    return dt.datetime.fromisoformat(s)


def _transactions(spark, rows):
    base = dict(
        customer_id="c1", corridor="US-MX", send_country="US", receive_country="MX",
        send_amount=D("100.00"), send_currency="USD", receive_amount=D("1700.00"),
        receive_currency="MXN", disclosed_fee=D("3.99"), charged_fee=D("3.99"),
        disclosed_fx_rate=D("17.000000"), applied_fx_rate=D("17.000000"), transfer_method="bank",
        promised_delivery_ts=_ts("2025-01-02 00:00:00"), actual_delivery_ts=_ts("2025-01-01 12:00:00"),
        status="delivered", created_at=_ts("2025-01-01 00:00:00"),
    )
    data = []
    for r in rows:
        row = dict(base)
        row.update(r)
        data.append(tuple(row.get(c) for c in TRANSACTIONS.column_names))
    return spark.createDataFrame(data, TRANSACTIONS.schema())


def _disclosures(spark, rows):
    base = dict(
        disclosed_at=_ts("2025-01-01 00:00:00"), disclosed_fee=D("3.99"), disclosed_fx_rate=D("17.000000"),
        disclosed_receive_amount=D("1700.00"), disclosed_delivery_window="1-2 days",
        receipt_sent_at=_ts("2025-01-01 00:10:00"), cancellation_deadline=_ts("2025-01-01 00:30:00"),
        created_at=None,
    )
    data = []
    for r in rows:
        row = dict(base)
        row.update(r)
        data.append(tuple(row.get(c) for c in DISCLOSURES.column_names))
    return spark.createDataFrame(data, DISCLOSURES.schema())


def test_reconcile_fixture(spark):
    tx = _transactions(spark, [
        dict(tx_id="equal"),
        dict(tx_id="within", charged_fee=D("4.00")),
        dict(tx_id="fee_off", charged_fee=D("5.99")),
        dict(tx_id="stated_zero", charged_fee=D("1.00")),
        dict(tx_id="huge_pct", charged_fee=D("999.99")),
        dict(tx_id="no_disclosure"),
        dict(tx_id="two_disclosures", charged_fee=D("3.99")),
    ])
    ds = _disclosures(spark, [
        dict(disclosure_id="d1", tx_id="equal"),
        dict(disclosure_id="d2", tx_id="within"),
        dict(disclosure_id="d3", tx_id="fee_off"),
        dict(disclosure_id="d4", tx_id="stated_zero", disclosed_fee=D("0.00")),
        dict(disclosure_id="d5", tx_id="huge_pct", disclosed_fee=D("0.01")),
        # the later disclosure states the fee that was charged
        dict(disclosure_id="d6", tx_id="two_disclosures", disclosed_fee=D("1.00"),
             disclosed_at=_ts("2025-01-01 00:00:00")),
        dict(disclosure_id="d7", tx_id="two_disclosures", disclosed_fee=D("3.99"),
             disclosed_at=_ts("2025-01-01 00:05:00")),
    ])
    rules = reconcile.transaction_rules(fee_tol=0.05)
    out = reconcile.reconcile_transactions(tx, ds, rules=rules)
    fee = {r["tx_id"]: r for r in out.filter(F.col("rule_id") == "FEE_MISMATCH").collect()}
    assert set(fee) == {"fee_off", "stated_zero", "huge_pct"}
    assert fee["fee_off"]["delta"] == D("2.000000")
    assert fee["fee_off"]["delta_pct"] == D("50.1253")
    assert fee["fee_off"]["severity"] == "high"
    assert fee["fee_off"]["disclosed_value"] == "3.99" and fee["fee_off"]["actual_value"] == "5.99"
    assert fee["stated_zero"]["delta_pct"] is None  # stated 0 → no percent
    assert fee["huge_pct"]["delta_pct"] is None  # 9999800% does not fit DECIMAL(8,4)
    assert fee["huge_pct"]["delta"] == D("999.980000")
    # stated-value drift (C5): transaction says 3.99, disclosure said 0.00 / 0.01
    drift = {r["tx_id"] for r in out.filter(F.col("rule_id") == "STATED_FEE_DRIFT").collect()}
    assert drift == {"stated_zero", "huge_pct"}
    # violations ⊆ transactions, one row per (tx, rule), stable ids
    ids = [r["violation_id"] for r in out.collect()]
    assert len(ids) == len(set(ids))
    assert out.join(tx, "tx_id", "left_anti").count() == 0
    # a transaction without a disclosure is C3's finding
    missing = reconcile.missing_counterpart(tx, ds, "tx_id", "tx_id").collect()
    assert [r["tx_id"] for r in missing] == ["no_disclosure"]


def test_reconcile_all_rows_and_overflow_flag(spark):
    df = spark.createDataFrame([("a", D("1.00"), D("1.00")), ("b", D("1.00"), D("9999999.00"))],
                               "tx string, s decimal(12,2), a decimal(12,2)")
    rule = reconcile.Rule("R", "s", "a", 0.0)
    out = {r["tx_id"]: r for r in reconcile.reconcile(df, "tx", [rule], only_violations=False).collect()}
    assert out["a"]["violated"] is False
    assert out["b"]["violated"] is True
    assert out["b"]["delta"] is None and out["b"]["delta_overflow"] is True


def test_late_and_overdue(spark):
    df = _transactions(spark, [
        dict(tx_id="on_time_to_second", promised_delivery_ts=_ts("2025-01-02 00:00:00"),
             actual_delivery_ts=_ts("2025-01-02 00:00:00")),
        dict(tx_id="late", actual_delivery_ts=_ts("2025-01-02 00:00:01")),
        dict(tx_id="undelivered_not_due", promised_delivery_ts=_ts("2025-02-01 00:00:00"), actual_delivery_ts=None),
        dict(tx_id="undelivered_overdue", actual_delivery_ts=None),
    ])
    out = {r["tx_id"]: r for r in deadlines.late_or_undelivered(df, as_of="2025-01-10 00:00:00").collect()}
    assert set(out) == {"late", "undelivered_overdue"}
    assert out["late"]["status"] == "late" and out["late"]["delay_seconds"] == 1
    assert out["undelivered_overdue"]["status"] == "overdue"
    assert out["undelivered_overdue"]["delay_seconds"] == 8 * 86400
    with_grace = deadlines.late_or_undelivered(df, grace_seconds=5, as_of="2025-01-10 00:00:00")
    assert {r["tx_id"] for r in with_grace.collect()} == {"undelivered_overdue"}


def test_receipt_checks(spark):
    ds = _disclosures(spark, [
        dict(disclosure_id="ok", tx_id="t1"),
        dict(disclosure_id="missing", tx_id="t2", receipt_sent_at=None),
        dict(disclosure_id="late", tx_id="t3", receipt_sent_at=_ts("2025-01-03 00:00:00")),
        dict(disclosure_id="bad_deadline", tx_id="t4", cancellation_deadline=_ts("2024-12-31 00:00:00")),
    ])
    out = {(r["disclosure_id"], r["check_name"]) for r in deadlines.receipt_checks(ds).collect()}
    assert out == {("missing", "receipt_missing"), ("late", "receipt_late"), ("bad_deadline", "deadline_invalid")}


def test_trail_checks(spark):
    t0 = dt.datetime(2025, 1, 1)
    rows = []
    def add(tx, seqs, clocks):
        for i, (s, c) in enumerate(zip(seqs, clocks)):
            rows.append((f"{tx}-{i}", tx, s, t0 + dt.timedelta(seconds=c)))
    add("clean", [1, 2, 3], [0, 1, 2])
    add("gap", [1, 3], [0, 1])
    add("dup", [1, 1], [0, 1])
    add("late_start", [2, 3], [0, 1])
    add("backwards", [1, 2, 3], [0, 5, 3])
    df = spark.createDataFrame(rows, "event_id string, tx_id string, sequence_num int, wall_clock_ts timestamp")
    s = {r["tx_id"]: r for r in trails.trail_summary(df, tie=["event_id"], block_width=2).collect()}
    assert s["clean"]["is_clean"] is True
    assert (s["gap"]["n_gaps"], s["gap"]["is_clean"]) == (1, False)
    assert s["dup"]["n_duplicates"] == 1
    assert (s["late_start"]["first_seq"], s["late_start"]["is_clean"]) == (2, False)
    assert s["backwards"]["n_backwards"] == 1


def test_rollup_leaves_sum_to_total(spark):
    rows = [("high", "R1", "US-MX", D("1.5")), ("low", "R1", "US-MX", D("-0.5")),
            ("high", "R2", "UK-IN", D("2.0")), ("medium", "R2", "US-MX", None)]
    v = spark.createDataFrame(rows, "severity string, rule_id string, corridor string, delta decimal(12,6)")
    r = summaries.violation_summary(v, mode="rollup").collect()
    total = [x for x in r if x["g_severity"] == 1]
    leaves = [x for x in r if x["g_corridor"] == 0]
    assert len(total) == 1 and total[0]["violations"] == 4
    assert sum(x["violations"] for x in leaves) == 4
    assert sum(x["abs_delta"] or 0 for x in leaves) == total[0]["abs_delta"] == D("4.0")
    cube = summaries.violation_summary(v, mode="cube").count()
    sets = summaries.violation_summary(v, mode="sets", grouping_sets=[("severity",), ()]).count()
    assert cube > len(r) and sets == 4


def test_risk_exposure(spark):
    customers = spark.createDataFrame([("c1", "t1", "low"), ("c2", "t2", "high")],
                                      "customer_id string, kyc_tier string, risk_level string")
    tx = spark.createDataFrame([("x1", "c1", D("10.00")), ("x2", "c1", D("30.00")), ("x3", "c2", D("5.00"))],
                               "tx_id string, customer_id string, send_amount decimal(12,2)")
    viol = spark.createDataFrame([("x2", "R1"), ("x2", "R2")], "tx_id string, rule_id string")
    out = {r["kyc_tier"]: r for r in summaries.risk_exposure(customers, tx, viol).collect()}
    assert out["t1"]["n_tx"] == 2 and out["t1"]["n_violating"] == 1
    assert out["t1"]["violating_amount"] == D("30.00") and out["t1"]["violating_share"] == 0.75
    assert out["t2"]["violating_share"] == 0.0


def test_payload_fields(spark):
    df = spark.createDataFrame([("e1", '{"k": 5, "who": "a"}'), ("e2", "not json"), ("e3", None)],
                               "event_id string, payload string")
    out = {r["event_id"]: r for r in summaries.payload_fields(
        df, {"k": "$.k:bigint", "who": "$.who"}).collect()}
    assert (out["e1"]["k"], out["e1"]["who"], out["e1"]["payload_valid"]) == (5, "a", True)
    assert (out["e2"]["k"], out["e2"]["payload_valid"]) == (None, False)
    assert out["e3"]["payload_valid"] is None


def test_audit_run_end_to_end(spark, scratch):
    import os

    from lakeaudit.contracts import AUDIT_EVENTS, CUSTOMERS
    from lakeaudit.plans.audit_run import AuditParams, run_audit

    customers = spark.createDataFrame(
        [("c1", "US", "tier1", "low", dt.date(2024, 1, 1), None), ("c2", "MX", "tier2", "high", dt.date(2024, 1, 1), None)],
        CUSTOMERS.schema(),
    )
    tx = _transactions(spark, [
        dict(tx_id="t1", customer_id="c1"),
        dict(tx_id="t2", customer_id="c2", charged_fee=D("9.99"), actual_delivery_ts=_ts("2025-01-05 00:00:00")),
        dict(tx_id="t3", customer_id="c2", actual_delivery_ts=None),
    ])
    ds = _disclosures(spark, [
        dict(disclosure_id="d1", tx_id="t1"),
        dict(disclosure_id="d2", tx_id="t2", receipt_sent_at=None),
    ])
    t0 = dt.datetime(2025, 1, 1)
    events = spark.createDataFrame(
        [("e1", "t1", "created", "sys", t0, 1, '{"k": 1}', None),
         ("e2", "t1", "sent", "sys", t0 + dt.timedelta(seconds=5), 3, '{"k": 2}', None)],
        AUDIT_EVENTS.schema(),
    )
    params = AuditParams(as_of="2025-01-10 00:00:00", payload_fields={"k": "$.k:int"})
    out = os.path.join(scratch, "audit")
    report = {r["output"]: r["rows"] for r in run_audit(spark, customers, tx, ds, events, params, out).collect()}
    assert report["violations"] == report["violation_findings"] == 1  # t2's fee
    from lakeaudit.contracts import VIOLATIONS
    assert spark.read.parquet(os.path.join(out, "violations")).schema == VIOLATIONS.schema()
    assert report["late_deliveries"] == 2  # t2 late, t3 overdue
    assert report["missing_disclosures"] == 1  # t3
    assert report["receipt_checks"] == 1  # d2 receipt missing
    assert report["trail_summary"] == 1 and report["payload_fields"] == 2
    qr = {(r["table_name"], r["check_name"], r["column_name"]): r["failed_rows"]
          for r in spark.read.parquet(os.path.join(out, "quality_report")).collect()}
    assert qr[("disclosures", "foreign_key", "tx_id")] == 0
    assert qr[("transactions", "foreign_key", "customer_id")] == 0
    assert ("transactions", "not_null", "actual_delivery_ts") not in qr  # nullable column
    trail = spark.read.parquet(os.path.join(out, "trail_summary")).first()
    assert trail["n_gaps"] == 1 and trail["is_clean"] is False
    rollup = spark.read.parquet(os.path.join(out, "violation_rollup"))
    assert rollup.filter("g_severity = 1").first()["violations"] == 1
    exposure = {r["kyc_tier"]: r for r in spark.read.parquet(os.path.join(out, "risk_exposure")).collect()}
    assert exposure["tier2"]["n_violating"] == 1 and exposure["tier1"]["n_violating"] == 0


def test_reconcile_math_matches_python_decimal(spark):
    """delta, delta_pct (half-up to 4 places, NULL on a zero base or overflow)
    and severity, for random amounts, against Python's decimal module."""
    import decimal
    import random

    rnd = random.Random(11)
    rows = []
    for i in range(3000):
        stated = D(rnd.randint(-10**7, 10**7)) / 100 if i % 50 else D("0.00")
        actual = stated + D(rnd.randint(-10**6, 10**6)) / 100 if i % 7 else D(rnd.randint(0, 10**9)) / 100
        rows.append((f"t{i}", stated, actual))
    df = spark.createDataFrame(rows, "tx string, s decimal(12,2), a decimal(12,2)")
    rule = reconcile.Rule("R", "s", "a", 0.0)
    got = {r["tx_id"]: r for r in reconcile.reconcile(df, "tx", [rule], only_violations=False).collect()}
    ctx = decimal.Context(prec=60, rounding=decimal.ROUND_HALF_UP)
    for tx, stated, actual in rows:
        r = got[tx]
        delta = actual - stated
        fits = abs(delta) < D("1000000")  # DECIMAL(12,6) holds six integer digits
        assert r["delta"] == (delta if fits else None)
        assert r["delta_overflow"] == (not fits)
        if stated == 0:
            pct = None
        else:
            pct = ctx.divide(delta * 100, stated).quantize(D("0.0001"), rounding=decimal.ROUND_HALF_UP)
            if abs(pct) >= D("10000"):
                pct = None
        assert r["delta_pct"] == pct, (tx, stated, actual, r["delta_pct"], pct)
        assert r["pct_overflow"] == (pct is None and stated != 0)
        want = "high" if pct is None or abs(pct) >= 10 else "medium" if abs(pct) >= 1 else "low"
        assert r["severity"] == want
        assert r["violated"] == (delta != 0)


def test_contract_checks_with_foreign_keys(spark):
    from lakeaudit.operators.quality import contract_checks

    tx = _transactions(spark, [dict(tx_id="t1"), dict(tx_id="t2"), dict(tx_id="t2", corridor=None)])
    ds = _disclosures(spark, [dict(disclosure_id="d1", tx_id="t1"), dict(disclosure_id="d2", tx_id="ghost")])
    rep = {(r["check_name"], r["column_name"]): (r["failed_rows"], r["total_rows"])
           for r in contract_checks(ds, DISCLOSURES, parents={"transactions": tx}).collect()}
    assert rep[("foreign_key", "tx_id")] == (1, 2)
    assert rep[("unique_key", "disclosure_id")] == (0, 2)
    rep_tx = {(r["check_name"], r["column_name"]): r["failed_rows"]
              for r in contract_checks(tx, TRANSACTIONS).collect()}
    assert rep_tx[("unique_key", "tx_id")] == 1 and rep_tx[("not_null", "corridor")] == 1
    assert ("foreign_key", "customer_id") not in rep_tx  # parent not given
