import json
import re
import time
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioforge.operators import facts as A
from folioforge.operators import lineage
from folioforge.operators import quality as Q
from folioforge.operators import statement_rows as S
from folioforge.operators import trades as T
from folioforge.plans import landed_views as L
from folioforge.plans import views as V
from folioforge.sources import landed, loads, tables

PH = ["Symbol", "Quantity", "Mult", "Cost Price", "Cost Basis", "Close Price", "Value", "Unrealized P/L", "Code"]
TH = ["Symbol", "Date/Time", "Quantity", "T. Price", "C. Price", "Proceeds", "Comm/Fee", "Basis", "Realized P/L", "MTM P/L", "Code"]


def pad(first, n):
    return [first] + [""] * (n - 1)


def account(name, end="March 6, 2026"):
    return [
        [["Account Information", ""], ["Account", name], ["Base Currency", "SGD"]],
        [["Net Asset Value", "", ""], ["December 31, 2025", "", end]],
        [pad("Open Positions", 9), PH, pad("Stocks", 9), pad("EUR", 9), ["AAPL", "1,000", "1", "150", "15,000.00", "175.50", "17,550.00", "2,550.00", ""],
         pad("Total AAPL", 9)],
        # A fragment without header and with too few columns continues the table above.
        [["MSFT", "5", "1", "10", "50", "12", "60", "10"]],
        # A repeated page header keeps the state; the label is cut off.
        [pad("Open Positions", 9), pad("Equity and Index Opt", 9), ["EEM 31MAR26 48 C", "6", "100", "3", "2095.71", "4", "2400", "304.29", ""],
         ["BROKEN", "1", "100", "3", "1", "1", "1", "0", ""], pad("Bonds", 9), ["ACME 5%", "1", "1", "1", "1", "1", "1", "0", ""]],
        [pad("Trades", 11), TH, pad("Stocks", 11), pad("USD", 11),
         ["AAPL", "2026-01-12,\n09:30:00", "-50", "175.00", "176", "8750.00", "-1.09", "0", "12.5", "0", "C"],
         ["ZERO", "2026-01-12,\n09:30:00", "0", "1", "1", "0", "0", "0", "0", "0", ""], ["LATE", "no date", "1", "1", "1", "0", "0", "0", "0", "0", ""]],
        [pad("Transaction Fees", 3), ["AAPL", "x", "y"]],
        [pad("Open Positions", 9), PH, pad("Stocks", 9), ["AGAIN", "1", "1", "1", "1", "1", "1", "0", ""]],
    ]


def land(spark, files):
    out = []
    for file_id, doc in files.items():
        for page, table in enumerate(doc, 1):
            out += [(file_id, page, 1, i, cells) for i, cells in enumerate(table)]
    return spark.createDataFrame(out, landed.STATEMENT_ROWS)


def test_statement_job(spark):
    rows = land(spark, {"two": [[["Cover"]]] + account("U1") + account("U2"), "one": account("U3", "Mar 7, 2026")})
    classified = S.classify_rows(rows)
    headers = S.statement_headers(classified)
    meta = {(r.file_id, r.account_seq): r for r in headers.collect()}
    assert {k: v.account_id for k, v in meta.items()} == {("two", 1): "U1", ("two", 2): "U2", ("one", 1): "U3"}
    assert meta[("one", 1)].period_start == date(2026, 1, 1) and meta[("one", 1)].period_end == date(2026, 3, 7)
    assert meta[("two", 1)].base_currency == "SGD"

    found = S.extract_positions(classified, headers)
    good = {(r.account_id, r.symbol): r for r in Q.accept(found, Q.position_rules()).collect()}
    assert {s for _, s in good} == {"AAPL", "MSFT", "EEM 31MAR26 48 C"} and len(good) == 9
    aapl, eem = good[("U2", "AAPL")], good[("U2", "EEM 31MAR26 48 C")]
    assert (aapl.quantity, aapl.cost_basis, aapl.currency, aapl.statement_date) == (1000, 15000, "EUR", date(2026, 3, 6))
    assert (eem.asset_class, eem.expiry, eem.strike, eem.right) == ("OPT", date(2026, 3, 31), Decimal(48), "C")
    assert {r.symbol for r in Q.quarantine(found, Q.position_rules()).collect()} == {"BROKEN"}

    trades = S.extract_trades(classified, headers)
    kept = Q.accept(trades, Q.trade_rules()).where("account_id = 'U1'").collect()
    assert [(r.symbol, r.side, r.quantity, r.trade_date, r.commission) for r in kept] == [
        ("AAPL", "SLD", 50, datetime(2026, 1, 12, 9, 30), Decimal("-1.09"))]
    assert {r.symbol for r in Q.quarantine(trades, Q.trade_rules()).collect()} == {"LATE"}


def test_row_diagnosis(spark):
    classified = S.classify_rows(land(spark, {"one": account("U3")}))
    got = S.diagnose(classified)
    labels = {r["first"]: r.classification for r in got.collect()}
    assert labels["AAPL"] == labels["MSFT"] == labels["EEM 31MAR26 48 C"] == "parsed"
    assert labels["BROKEN"] == "error" and labels["ACME 5%"] == "skipped_no_asset_class" and labels["Bonds"] == "asset_class_skipped"
    assert labels["Trades"] == "section_header" and "AGAIN" not in labels and labels["Account"] == "outside_section"
    assert [r.row_num for r in got.orderBy("row_num").collect()] == list(range(1, got.count() + 1))
    counts = S.diagnosis_counts(got).first()
    assert (counts.parsed, counts.skipped) == (3, 2)
    assert S.search_rows(got, " eem ").count() == 1
    assert S.problem_context(got, 1, 0).count() == 4


def huge_account(name, n):
    """One page whose single table holds nearly all rows: positions of three classes, currencies that change, skipped labels."""
    rows = [pad("Open Positions", 9), PH]
    want, outside = [], 0
    asset, currency = None, "USD"
    for i in range(n):
        if i % 701 == 0:
            asset = (i // 701) % 4
            rows.append(pad(["Stocks", "ETFs", "Bonds", "Equity and Index Opt"][asset], 9))
        if i % 333 == 5:
            currency = ["EUR", "SGD", "USD"][i // 333 % 3]
            rows.append(pad(currency, 9))
        symbol = f"S{i} 31MAR26 48 C" if asset == 3 else f"S{i}"
        rows.append([symbol, f"{i + 1:,}", "1", "1", "2", "3", "4", "5", ""])
        if asset == 2:
            outside += 1
        else:
            want.append((name, symbol, ["STK", "ETF", "", "OPT"][asset], i + 1, currency))
    return [[["Account Information", ""], ["Account", name], ["Base Currency", "SGD"]], [["Net Asset Value", "", ""], ["December 31, 2025", "", "March 6, 2026"]],
            rows, [pad("Trades", 11), TH]], want, outside


def test_one_page_may_hold_most_rows(spark):
    big, want, outside = huge_account("U7", 3000)
    small, more, _ = huge_account("U8", 40)
    rows = land(spark, {"big": big + small, "other": account("U9")}).repartition(6)
    segments = S.merge_fragments(rows, segment_rows=100).groupBy("part", "seg").count()
    assert segments.agg(F.max("count")).first()[0] <= 100 and segments.count() >= 31
    classified = S.classify_rows(rows, segment_rows=100)
    headers = S.statement_headers(classified)
    found = {(r.account_id, r.symbol, r.asset_class, int(r.quantity), r.currency) for r in S.extract_positions(classified, headers).where("account_id <> 'U9'").collect()}
    assert found == set(want + more)
    counts = {r.account_seq: r for r in S.diagnosis_counts(S.diagnose(classified)).where("file_id = 'big'").collect()}
    assert (counts[1].parsed, counts[1].skipped, counts[1].outside) == (len(want), outside, 5)
    assert counts[2].parsed == len(more)
    # Row numbers start anew with each account and have no gaps.
    numbers = classified.groupBy("file_id", "account_seq").agg(F.min("row_num"), F.max("row_num"), F.count_distinct("row_num"), F.count("*"))
    assert all(r[2] == 1 and r[3] == r[4] == r[5] for r in numbers.collect())
    assert S.classify_rows(rows.limit(0)).count() == 0


def test_rows_are_dealt_out_once(spark):
    """Rows only look up small tables after their segments are written: no exchange, sort or window of rows."""
    big, want, _ = huge_account("U7", 400)
    classified = S.classify_rows(land(spark, {"big": big, "two": account("U1") + account("U2")}), segment_rows=50)
    lazy = [classified, S.extract_positions(classified, S.statement_headers(classified)), S.diagnose(classified)]
    for df in lazy:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Exchange hashpartitioning", "Exchange rangepartitioning", "SortMergeJoin", "Window"))
    found = {(r.account_id, r.symbol, r.asset_class, int(r.quantity), r.currency) for r in lazy[1].where("account_id = 'U7'").collect()}
    assert found == set(want)


def test_file_without_account_marker(spark):
    rows = land(spark, {"x": [[pad("Open Positions", 9), PH, pad("Stocks", 9), ["A", "1", "1", "1", "1", "1", "1", "0", ""]]]})
    classified = S.classify_rows(rows)
    headers = S.statement_headers(classified)
    assert headers.first().account_id is None and S.extract_positions(classified, headers).count() == 1


def fact(val, start, end, fp, form="10-Q", filed="2024-08-01", fy=2024):
    return {"val": val, "start": start, "end": end, "form": form, "fy": fy, "fp": fp, "filed": filed}


def test_company_facts(spark, tmp_path):
    doc = {"cik": 320193, "entityName": "X", "facts": {"us-gaap": {
        "Revenues": {"units": {"USD": [
            fact(25000, "2024-04-01", "2024-06-30", "Q2", filed="2024-09-01"), fact(53000, "2024-01-01", "2024-06-30", "Q2"),
            fact(52000, "2024-01-01", "2024-06-30", "Q2", filed="2024-07-01"), fact(1, "2024-01-01", "2024-06-30", "Q2", form="8-K", filed="2025-01-01"),
            fact("n/a", "2024-01-01", "2024-09-30", "Q3"), fact(9, None, None, "Q1")]}},
        "SalesRevenueNet": {"units": {"USD": [fact(1, "2023-01-01", "2023-12-31", "FY")]}},
        "EarningsPerShareDiluted": {"units": {"USD/shares": [fact(6.08, "2024-01-01", "2024-12-31", "FY", form="10-K")]}},
        "Assets": {"units": {"pure": [fact(5, None, "2024-12-31", "FY", form="S-1")], "USD": [fact(7, None, "2024-12-31", "FY", form="S-1", fy=None)]}},
    }}}
    (tmp_path / "facts").mkdir()
    (tmp_path / "facts" / "CIK0000320193.json").write_text(json.dumps(doc))
    (tmp_path / "tickers.json").write_text(json.dumps({"0": {"ticker": "googl", "cik_str": 320193}, "1": {"ticker": "MSFT", "cik_str": 789019}}))
    documents = landed.read_company_facts(spark, str(tmp_path / "facts"))
    tickers = landed.read_ticker_map(spark, str(tmp_path / "tickers.json"))
    symbols = spark.createDataFrame([("goog",), ("NOPE",)], "symbol string")
    assert {r.symbol: r.cik for r in A.resolve_ciks(symbols, tickers).collect()} == {"GOOG": "0000320193", "NOPE": None}
    out = A.facts_to_metrics(symbols, tickers, documents)
    good = {(r.metric_name, r.fiscal_period): r for r in Q.accept(out, Q.metric_rules()).collect()}
    assert set(good) == {("revenue", "Q2"), ("eps_diluted", "FY"), ("total_assets", "FY")}
    assert good[("revenue", "Q2")].metric_value == 53000 and good[("revenue", "Q2")].reporting_style == "mixed"
    assert good[("eps_diluted", "FY")].metric_value == Decimal("6.08") and good[("total_assets", "FY")].metric_value == 7
    assert good[("total_assets", "FY")].fiscal_year == 2024 and good[("total_assets", "FY")].filing_type == "S-1"
    assert [r.violations for r in Q.quarantine(out, Q.metric_rules()).collect()] == [["metric_value"]]


def test_table_upsert_delete_and_csv(spark, tmp_path):
    root = str(tmp_path)
    bars = lambda rows: spark.createDataFrame(rows, "symbol string, price_date date, close double, n int")
    tables.upsert_table(bars([("A", date(2023, 1, 2), 1.0, 0), ("A", date(2024, 1, 2), 2.0, 0), ("B", date(2024, 1, 2), 3.0, 0)]),
                        root, "daily_prices", [F.col("close")])
    load = bars([("A", date(2024, 1, 2), 7.0, 1), ("A", date(2024, 1, 2), 8.0, 2), ("C", date(2024, 1, 3), 9.0, 1)])
    tables.upsert_table(load, root, "daily_prices", [F.col("n").desc()])
    got = {(r.symbol, r.price_date.year): float(r.close) for r in tables.read_table(spark, root, "daily_prices").collect()}
    assert got == {("A", 2023): 1, ("A", 2024): 8, ("B", 2024): 3, ("C", 2024): 9}
    tables.delete_from_table(spark, root, "daily_prices", spark.createDataFrame([("A",)], "symbol string"), ["symbol"])
    assert {r.symbol for r in tables.read_table(spark, root, "daily_prices").collect()} == {"B", "C"}
    tables.export_csv(tables.read_table(spark, root, "daily_prices"), f"{root}/csv", ["symbol", "close"])
    assert spark.read.option("header", True).csv(f"{root}/csv").count() == 2


def test_quality_rules(spark):
    rows = spark.createDataFrame([(" aapl", "Revenue ", 1, date(2024, 1, 1), "SEC_EDGAR", "1"), ("", "weird", None, None, "SEC_EDGAR", None)],
                                 "symbol string, metric_name string, metric_value int, period_end date, source string, cik string")
    clean = Q.clean_metrics(rows)
    assert [(r.symbol, r.metric_name, r.known_metric) for r in clean.collect()] == [("AAPL", "revenue", True), ("", "weird", False)]
    assert Q.quarantine(clean, Q.metric_rules()).first().violations == ["symbol", "metric_value", "period_end", "cik"]
    snaps = spark.createDataFrame([("A", "Value"), ("A", "Other")], "symbol string, preset string")
    assert Q.accept(snaps, Q.snapshot_rules()).count() == 1


def test_writes_touch_only_their_partitions(spark, tmp_path):
    root = f"{tmp_path}/pruned"
    rows = [("A", date(y, 1, 2), float(y), 0) for y in range(2010, 2020)] + [("B", date(2015, 1, 2), 1.0, 0)]
    schema = "symbol string, price_date date, close double, n int"
    tables.upsert_table(spark.createDataFrame(rows, schema), root, "daily_prices", [F.col("n").desc()])
    files = lambda: {p.parent.name: p.name for p in Path(root, "daily_prices").rglob("*.parquet")}
    before = files()
    tables.upsert_table(spark.createDataFrame([("A", date(2013, 1, 2), 9.0, 1)], schema), root, "daily_prices", [F.col("n").desc()])
    after = files()
    assert {k for k in before if before[k] != after[k]} == {"part_year=2013"}
    tables.delete_from_table(spark, root, "daily_prices", spark.createDataFrame([("A", date(2015, 1, 2)), ("A", date(2016, 1, 2))], "symbol string, price_date date"),
                             ["symbol", "price_date"])
    left = files()
    assert "part_year=2016" not in left and {k for k in left if after[k] != left[k]} == {"part_year=2015"}
    assert tables.read_table(spark, root, "daily_prices").count() == 9
    with pytest.raises(ValueError, match="has to contain"):
        tables.upsert_table(spark.createDataFrame(rows, schema), root, "daily_prices", [F.col("n").desc()], keys=["symbol"])


def statement_load(spark, ids, quantity):
    heads = spark.createDataFrame([(i, "U1", date(y, 1, 1), date(y, 12, 31)) for i, y in ids], "id string, account_id string, period_start date, period_end date")
    heads = heads.withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    rows = [(i, "AAPL", "STK", quantity, date(y, 12, 31), "U1") for i, y in ids]
    positions = spark.createDataFrame(rows, "statement_id string, symbol string, asset_class string, quantity int, statement_date date, account_id string")
    deals = [(i, datetime(y, 5, 1), "AAPL", "STK", "BOT", quantity, 1, "U1") for i, y in ids]
    trades = spark.createDataFrame(
        deals, "statement_id string, trade_date timestamp_ntz, symbol string, asset_class string, side string, quantity int, price int, account_id string")
    return heads, positions, trades


def stored_state(spark, root):
    return {t: sorted((r[0], int(r[1])) for r in tables.read_table(spark, root, t).select("statement_id", "quantity").collect())
            for t in ("positions", "trades")} | {"statements": sorted(r.id for r in tables.read_table(spark, root, "statements").collect())}


def expected_state(rows):
    return {"positions": rows, "trades": rows, "statements": [i for i, _ in rows]}


def test_stopped_loads_are_whole_or_absent(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    tables.store_statements(root, *statement_load(spark, [("a", 2019), ("b", 2020)], 1))
    first = expected_state([("a", 1), ("b", 1)])
    assert stored_state(spark, root) == first

    def stop(*_):
        raise RuntimeError("stopped")

    # Stopped after staging one of three tables: nothing of the load is seen, and the next load drops it.
    real_stage = loads.stage
    with monkeypatch.context() as m:
        m.setattr(loads, "stage", lambda load, table, rows: stop() if table == "trades" else real_stage(load, table, rows))
        with pytest.raises(RuntimeError):
            tables.store_statements(root, *statement_load(spark, [("b", 2020), ("c", 2021)], 2))
    assert stored_state(spark, root) == first
    loads.recover(spark, root)
    assert stored_state(spark, root) == first and not list(Path(root, "_loads").iterdir())

    # Stopped after the commit, with one of three tables copied: all of it is seen, before and after recovery.
    real_publish = loads._publish_table
    second = expected_state([("a", 1), ("b", 2), ("c", 2)])
    with monkeypatch.context() as m:
        m.setattr(loads, "_publish_table", lambda *a: real_publish(*a) if a[3] == "statements" else stop())
        with pytest.raises(RuntimeError):
            tables.store_statements(root, *statement_load(spark, [("b", 2020), ("c", 2021)], 2))
    assert stored_state(spark, root) == second
    loads.recover(spark, root)
    assert stored_state(spark, root) == second
    assert loads.pending(spark, root, "trades") is None

    # The first load of a table may also stop after its commit.
    fresh = f"{tmp_path}/fresh"
    with monkeypatch.context() as m:
        m.setattr(loads, "_publish_table", stop)
        with pytest.raises(RuntimeError):
            tables.store_statements(fresh, *statement_load(spark, [("a", 2019)], 3))
    assert stored_state(spark, fresh) == expected_state([("a", 3)])
    # Writing a table whole ends the stopped load first, so that its files do not hide the new rows.
    tables.write_table(statement_load(spark, [("a", 2019)], 4)[1], fresh, "positions")
    assert stored_state(spark, fresh) == expected_state([("a", 3)]) | {"positions": [("a", 4)]}


def test_stored_cascade_delete(spark, tmp_path):
    root = str(tmp_path)
    tables.store_statements(root, *statement_load(spark, [("a", 2019), ("b", 2020), ("c", 2021)], 1))
    files = lambda t: {p.parent.name: p.name for p in Path(root, t).rglob("*.parquet")}
    before = {t: files(t) for t in ("statements", "positions", "trades")}
    doomed = spark.createDataFrame([("b",), ("b",), ("unknown",), (None,)], "id string")
    tables.delete_statements(spark, root, doomed)
    assert stored_state(spark, root) == expected_state([("a", 1), ("c", 1)])
    for t, had in before.items():
        assert files(t) == {k: v for k, v in had.items() if k != "part_year=2020"}
    # Ids may be read from the tables themselves; nothing is left, and the tables still read.
    tables.delete_statements(spark, root, tables.read_table(spark, root, "statements").select("id"))
    assert stored_state(spark, root) == expected_state([])


def test_years_come_from_the_trades(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    for name in ("part", "orders", "customer"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    year = F.when(F.col("l_orderkey") % 97 == 0, 1990).when(F.col("l_orderkey") % 89 == 0, 2005)
    moved = lines.withColumn("l_shipdate", F.coalesce(F.make_timestamp_ntz(year, F.lit(6), F.lit(1), F.lit(0), F.lit(0), F.lit(0)), "l_shipdate"))
    moved.write.parquet(f"{tmp_path}/lineitem.parquet")
    where = str(tmp_path)
    for view, column in ((V.statements, "period_end"), (V.positions, "statement_date")):
        years = {r[0] for r in view(spark, where).select(F.year(column)).distinct().collect()}
        assert {1990, 1992, 2005} <= years
    totals = {r.preset: r.trades for r in T.totals_by_preset(V.trades(spark, where), V.AS_OF).collect()}
    assert totals["All"] == lines.count()
    assert V.trades(spark, where).join(V.statements(spark, where), F.col("statement_id") == F.col("id"), "left_anti").count() == 0


def test_bars_and_statement_rows_from_files(spark, tmp_path):
    (tmp_path / "bars.csv").write_text("symbol,price_date,open,high,low,close,adj_close,volume\n aapl ,2024-01-02,1,2,0.5,1.5,1.5,10\n,2024-01-02,1,1,1,1,1,1\nBAD,nope,x,1,1,-1,1,1\n")
    bars = landed.read_bars(spark, str(tmp_path / "bars.csv"))
    assert [(r.symbol, float(r.close), r.volume) for r in Q.accept(bars, Q.price_rules()).collect()] == [("AAPL", 1.5, 10)]
    assert {v for r in Q.quarantine(bars, Q.price_rules()).collect() for v in r.violations} >= {"symbol", "price_date", "open", "close"}
    (tmp_path / "rows.json").write_text(json.dumps({"file_id": "f", "page": 1, "table_no": 0, "row_no": 0, "cells": ["a", None]}) + "\n")
    assert landed.read_statement_rows(spark, str(tmp_path / "rows.json")).first().cells == ["a", ""]


def test_malformed_landed_lines(spark, tmp_path):
    good = {"file_id": "f", "page": 1, "table_no": 0, "row_no": 0, "cells": ["a", None]}
    lines = [json.dumps(good), json.dumps(good)[:-9], "", "  ", "[1]", "7", json.dumps(good | {"page": "x"}), json.dumps(good | {"row_no": None}), "{}",
             json.dumps(good | {"extra": 1})]
    (tmp_path / "rows.json").write_text("\n".join(lines) + "\n")
    kept, lost = landed.landed_statement_rows(spark, str(tmp_path / "rows.json"))
    assert [r.cells for r in kept.collect()] == [["a", ""], ["a", ""]]
    reasons = sorted(r.reason for r in lost.collect())
    assert reasons.count("place") == 2 and reasons.count("malformed") == 4
    assert {r.raw for r in lost.collect()} >= {lines[1], lines[6]} and lost.first().file.endswith("rows.json")
    (tmp_path / "none.json").write_text("")
    assert [df.count() for df in landed.landed_statement_rows(spark, str(tmp_path / "none.json"))] == [0, 0]


def test_malformed_facts_files(spark, tmp_path):
    bodies = {"CIK0000000001.json": {"cik": 1, "facts": {"us-gaap": {}}}, "2.json": {"cik": 2}, "x.json": {"facts": {}}, "part-00007.json": {"cik": 3, "facts": {}}}
    for name, body in bodies.items():
        (tmp_path / name).write_text(json.dumps(body))
    (tmp_path / "4.json").write_text('{"cik": 4, "facts": {"us-gaap": {')
    (tmp_path / "5.json").write_text(" ")
    (tmp_path / "6.json").write_text("")
    kept, lost = landed.landed_company_facts(spark, str(tmp_path))
    assert sorted(r.cik for r in kept.collect()) == ["0000000001", "0000000003"]
    assert sorted((r.cik or "", r.reason) for r in lost.collect()) == [
        ("", "cik"), ("0000000002", "facts"), ("0000000004", "malformed"), ("0000000005", "malformed")]


def test_checked_upsert_observes_its_counts(spark, tmp_path):
    root = str(tmp_path)
    schema = "symbol string, price_date date, open double, high double, low double, close double, volume bigint"
    bar = lambda symbol, day, close=1.0: (symbol, day, 1.0, 1.0, 1.0, close, 5)
    days = [date(2023, 1, 2), date(2024, 1, 2)]
    load = lambda rows: tables.upsert_checked(
        Q.clean_symbols(spark.createDataFrame(rows, schema)), root, "daily_prices", Q.price_rules(), [F.col("close").desc()])
    first = load([bar("a", days[0]), bar(" ", days[0]), bar("b", None, -1.0)])
    assert (first.received, first.accepted, first.inserted, first.updated) == (3, 1, 1, 0)
    assert first.broken["symbol"] == first.broken["price_date"] == first.broken["close"] == 1 and first.broken["open"] == 0
    assert sorted(r.violations for r in first.quarantine.collect()) == [["price_date", "close"], ["symbol"]]
    # Repeated keys of one load count once, and only stored keys are updates.
    second = load([bar("A", days[0], 2.0), bar("A ", days[0], 3.0), bar("A", days[1]), bar("c", days[0])])
    assert (second.received, second.accepted, second.inserted, second.updated) == (4, 4, 2, 1)
    got = {(r.symbol, r.price_date.year): float(r.close) for r in tables.read_table(spark, root, "daily_prices").collect()}
    assert got == {("A", 2023): 3, ("A", 2024): 1, ("C", 2023): 1}
    empty = load([bar("", days[0])])
    assert (empty.received, empty.accepted, empty.inserted, empty.updated) == (1, 0, 0, 0)
    assert tables.read_table(spark, root, "daily_prices").count() == 3


def test_cells_travel_as_one_text(spark):
    """Packing is reversible whatever the cells hold, and null rows, rows without cells and empty cells stay apart."""
    odd = [None, [], [""], ["", ""], ["a"], ["\x1b"], ["\x1f"], ["\x1be", "\x1bb"], ["\x1b\x1f\x1b", "", "é\n,", "x\x1f"], ["\x1b", "b"], ["e\x1b", "\x1fb"]]
    rows = spark.createDataFrame(list(enumerate(odd)), "id int, cells array<string>")
    back = rows.withColumn("cells", S._packed()).withColumn("cells", S._unpacked())
    assert back.schema["cells"].dataType == rows.schema["cells"].dataType
    assert [r.cells for r in back.orderBy("id").collect()] == odd
    # Rows are sent with their cells in one text.
    segments = S.merge_fragments(land(spark, {"one": account("U3")}))
    assert segments.where("size(cells) > 1").count() > 0


def test_rows_are_packed_whatever_they_hold(spark):
    """Joining plain cells and escaping the others gives the same texts; null cells become empty."""
    odd = [None, [], [""], ["", ""], [None], [None, "a", None], ["a"], ["\x1b"], ["\x1f"], ["\x1be", "\x1bb"], ["\x1f", "", "é\n,", "x\x1f"], ["b", "\x1f\x1f"]]
    rows = spark.createDataFrame(list(enumerate(odd)), "id int, cells array<string>")
    texts = S.packed_rows(rows)
    assert texts.schema["cells"].dataType.simpleString() == "string"
    back = [r.cells for r in texts.withColumn("cells", S._unpacked()).orderBy("id").collect()]
    assert back == [c and [t or "" for t in c] for c in odd]


def test_facts_of_rows_are_found_once(spark):
    """Extractions evaluate no lambda per cell of a row: a header's places are found per state, a row's names as it is dealt out."""
    rows = land(spark, {"one": account("U3")})
    classified = S.classify_rows(rows)
    for df in (S.statement_headers(classified), S.extract_trades(classified, S.statement_headers(classified)), S.diagnose(classified)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert not any(word in plan for word in ("exists(", "filter(", "forall(")) and "regexp_replace(trim" not in plan
    # A wide row that names a section is one only after its text is cut off with the columns that its table does not have.
    doc = [[pad("Open Positions", 3), ["Symbol", "Quantity", "Value"], pad("Stocks", 3)], [["ETFs", "", "", "note"], ["SPY", "2", "9", "x"]], [["ETFs", "", "note"], ["IWM", "1", "1"]]]
    found = S.classify_rows(land(spark, {"x": doc}))
    labels = {(r.pos.page, r.pos.row_no): (r.kind, r.label) for r in found.collect()}
    assert labels[(2, 0)] == ("asset", "ETFs") and labels[(3, 0)] == ("data", None)
    got = S.extract_positions(found, S.statement_headers(found))
    assert {(r.symbol, r.asset_class, int(r.market_value)) for r in got.collect()} == {("SPY", "ETF", 9), ("ETFs", "ETF", 0), ("IWM", "ETF", 1)}


def test_classified_rows_leave_nothing_behind(spark):
    """What is written on the way to a distilled relation goes, shuffle files too; only the relation itself stays."""
    root = Path(lineage.shared_folder(spark).removeprefix("file://"))
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {p.name for d in manager.localDirsString() for p in Path(d).rglob("shuffle_*")}
    rows = land(spark, {"two": account("U1") + account("U2")}).repartition(3)
    want, before, sent = S.classify_rows(rows).count(), set(root.iterdir()), shuffles()
    classified = lineage.distilled(spark, lambda: S.classify_rows(lineage.distilled(spark, lambda: rows)))
    made, until = set(root.iterdir()) - before, time.time() + 30
    while shuffles() - sent and time.time() < until:
        time.sleep(0.5)
    assert len([p for p in made if p.is_dir()]) == 1 and not shuffles() - sent
    assert classified.count() == want > 0
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None


def test_slices_of_files_take_the_disk_of_one_slice(spark):
    """A slice's landed rows are gone when the next one is classified; the rows are those of all files at once."""
    root = Path(lineage.shared_folder(spark).removeprefix("file://"))
    files = land(spark, {f"f{k}": account(f"U{k}") for k in range(12)} | {"two": account("U1") + account("U2")})
    halves = lambda: (files.where("file_id < 'f5'"), files.where("file_id >= 'f5'"))
    before, seen = set(root.iterdir()), []

    def step(rows):
        seen.append({p.name for made in set(root.iterdir()) - before for p in made.glob("slice=*")})
        return S.classify_rows(rows)

    sliced = lineage.distilled_in_slices(spark, halves, "file_id", step, slices=4, rows=20)
    sizes = [len(s) for s in seen]
    assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) == len(sizes) > 1 and sizes[-1] == 1
    assert not [p for made in set(root.iterdir()) - before for p in made.glob("slice=*")]
    as_rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert as_rows(sliced) == as_rows(S.classify_rows(files)) and sliced.count() > 0
    none = lineage.distilled_in_slices(spark, lambda: [files.limit(0)], "file_id", S.classify_rows)
    assert none.count() == 0


def test_landing_writes_the_lines_once(spark, tmp_path):
    """Positions and trades of the landed files come from one written relation of lines, not from joins of their own."""
    day = datetime(1996, 3, 1)
    spark.createDataFrame([(1, 4, "O", 1.0, day, "1")], V._SCHEMAS["orders"]).write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(7, "p", "Brand#13", "PROMO", 3, 9.5)], V._SCHEMAS["part"]).write.parquet(str(tmp_path / "part.parquet"))
    line = (1, 7, 2, 1, 3.0, 30.0, 0.05, 0.01, "N", "O", day)
    spark.createDataFrame([line], V._SCHEMAS["lineitem"]).write.parquet(str(tmp_path / "lineitem.parquet"))
    parts = L.statement_rows(spark, str(tmp_path))
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in parts]
    assert not any(re.search(r"Join Inner, \(l_", p) for p in plans)
    assert [df.where("page between 30 and 37 or page between 130 and 137").where("row_no > 9").count() for df in parts] == [1, 1]
