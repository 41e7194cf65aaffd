"""Real files through reading, mapping, parsing, gating, storing."""

import csv
import datetime as dt
import hashlib
import io
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallystone.operators import importing, mapping, ranking
from tallystone.operators.ranking import row_numbers, running_last
from tallystone.sources import annotated, bankfiles, stores


def preview(spark, folder, sign="outflow-negative", order=None):
    headers, rows = bankfiles.split_header(bankfiles.records_from_lines(bankfiles.read_lines(spark, str(folder))))
    found = mapping.detect_mapping(headers, rows).withColumn("amount_sign", F.lit(sign))
    if order:
        found = found.withColumn("date_order", F.lit(order))
    return found, importing.examine(rows, headers, found)


def parsed(spark, tmp_path, body, **how):
    (tmp_path / "bank.csv").write_text(body, encoding="utf-8", newline="")
    _, examined = preview(spark, tmp_path, **how)
    return [(r["line"], r["state"], r["error"], r["merchant"], None if r["amount"] is None else float(r["amount"]))
            for r in examined.orderBy("line").collect()]


def test_signed_amounts(spark, tmp_path):
    got = parsed(spark, tmp_path, "﻿Transaction Date,Description,Amount\n08/17/2026,SQ *BLUE BOTTLE 4412,-4.50\n08/18/2026,PAY,100\n")
    assert got == [(2, "parsed", None, "BLUE BOTTLE", -4.5), (3, "parsed", None, "PAY", 100.0)]


def test_split_amounts(spark, tmp_path):
    body = "Date,Name,Debit,Credit\n17/08/2026,A,4.50,\n17/08/2026,B,-4.50,\n17/08/2026,C,,9\n17/08/2026,D,1,2\n17/08/2026,E,,\n"
    got = parsed(spark, tmp_path, body)
    assert [g[4] for g in got] == [-4.5, -4.5, 9.0, None, None]
    assert got[3][2] == "both debit and credit are filled in" and got[4][2] == "neither debit nor credit is filled in"


def test_first_failing_check_is_the_reason(spark, tmp_path):
    body = "Date,Description,Amount\n2026-08-17,A,1\n2026-08-18,,OOPS\nPENDING,,OOPS\n2026-08-19,B,OOPS\n2026-08-20,C,1,9\n2026-08-21,D\n,,\n2026-08-22,E,2\n2026-08-23,F,2\n" + "2026-08-23,F,2\n" * 6
    got = {g[0]: g[1:3] for g in parsed(spark, tmp_path, body)}
    assert got[3] == ("error", "description is blank") and got[4] == ("error", "not a date")
    assert got[5] == ("error", "not a valid amount") and got[6] == ("error", "1 extra cell(s) beyond the header")
    assert got[7] == ("error", "missing cell(s) for: Amount") and got[8] == ("blank", None) and got[9][0] == "parsed"


def test_ambiguous_dates_parse_only_when_told(spark, tmp_path):
    body = "Date,Description,Amount\n03/04/2026,A,-1\n05/06/2026,B,-2\n"
    assert {g[2] for g in parsed(spark, tmp_path, body)} == {"date order is ambiguous"}
    assert {g[1] for g in parsed(spark, tmp_path, body, order="DAY_FIRST")} == {"parsed"}


def test_outflow_positive_flips(spark, tmp_path):
    got = parsed(spark, tmp_path, "Date,Description,Amount\n2026-08-17,A,4.50\n", sign="outflow-positive")
    assert got[0][4] == -4.5


def test_identical_rows_are_reported_and_kept(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Description,Amount\n2026-08-17,A,-1\n2026-08-17,A,-1.00\n2026-08-17,B,-1\n")
    _, examined = preview(spark, tmp_path)
    rows = examined.filter("state = 'parsed'")
    groups = importing.duplicate_groups(rows).collect()
    assert rows.count() == 3 and [(g["rows"], g["first_line"]) for g in groups] == [(2, 2)]
    assert [r["line"] for r in importing.duplicate_lines(rows).orderBy("line").collect()] == [2, 3]


AWKWARD = (
    'Date,Details,Amount\n2026-08-17,"two\nlines, ""quoted""",-1\n\n2026-08-18,5" pipe,-2\n'
    '2026-08-19,"closed"tail"x,-3\n"2026-08-20","a\n\nb",-4\r\n2026-08-21,plain,-5\n   \n2026-08-22,"",-6'
)


def expected_records(body):
    reader = csv.reader(io.StringIO(body, newline=""))
    out, before = [], 0
    for cells in reader:
        if cells:
            out.append((before + 1, [c.replace("\r\n", "\n") for c in cells]))
        before = reader.line_num
    return out


@pytest.mark.parametrize("block", ["128m", "16"])
def test_records_match_the_csv_module_whatever_the_block_size(spark, tmp_path, block):
    """Sixteen-byte blocks cut records, quotes and lines in every place."""
    (tmp_path / "x.csv").write_text(AWKWARD, encoding="utf-8", newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        records = bankfiles.records_from_lines(bankfiles.read_lines(spark, str(tmp_path)))
        got = [(r["line"], r["cells"]) for r in records.orderBy("line").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == expected_records(AWKWARD)


def test_quote_state_survives_chunk_borders(spark, monkeypatch):
    monkeypatch.setattr(bankfiles, "CHUNK_LINES", 2)
    lines = spark.createDataFrame(
        [("f", i + 1, t) for i, t in enumerate(AWKWARD.replace("\r\n", "\n").split("\n"))],
        "file_id string, line_no bigint, text string")
    got = [(r["line"], r["cells"]) for r in bankfiles.records_from_lines(lines).orderBy("line").collect()]
    assert got == expected_records(AWKWARD)


def test_file_identity(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"x,y\n1,2\n")
    row = bankfiles.file_checksums(spark, str(tmp_path)).first()
    assert row["source_sha256"] == hashlib.sha256(b"x,y\n1,2\n").hexdigest() and row["bytes"] == 8


def ledger_rows(spark, rows, file_order=1, ids=None):
    data = [(1, f"f{file_order}", file_order, i + 2, f"2026-08-{d:02d}", m, a, "USD", ids[i] if ids else None)
            for i, (d, m, a) in enumerate(rows)]
    frame = spark.createDataFrame(
        data, "account_id bigint, file_id string, file_order int, line bigint, posted_on string, merchant string,"
        " amount string, currency string, external_id string")
    frame = frame.withColumn("posted_on", F.to_date("posted_on")).withColumn("amount", F.col("amount").cast("decimal(28,6)"))
    return importing.number_occurrences(importing.with_fingerprint(frame))


def stored_of(frame, column="occurrence"):
    return frame.select("account_id", "fingerprint", F.col(column).alias("occurrence"), "external_id")


def split(resolved):
    rows = resolved.collect()
    return sum(not r["already_stored"] for r in rows), sum(r["already_stored"] for r in rows)


def test_snapshot_is_idempotent(spark):
    first = ledger_rows(spark, [(17, "A", "-4.50"), (17, "A", "-4.50")])
    again = ledger_rows(spark, [(17, "A", "-4.5"), (17, "A", "-4.50"), (17, "A", "-4.500")])
    none = stored_of(first).limit(0)
    assert split(importing.resolve_snapshot(first, none)) == (2, 0)
    assert split(importing.resolve_snapshot(first, stored_of(first))) == (0, 2)
    assert split(importing.resolve_snapshot(again, stored_of(first))) == (1, 2)


def test_incremental_goes_by_the_banks_id(spark):
    first = ledger_rows(spark, [(17, "A", "-1"), (17, "A", "-1")], ids=["T1", "T2"])
    later = ledger_rows(spark, [(17, "A", "-1"), (17, "A", "-1")], ids=["T1", "T3"], file_order=2)
    resolved = importing.resolve_incremental(later, stored_of(first))
    got = {r["external_id"]: (r["already_stored"], r["stored_occurrence"]) for r in resolved.collect()}
    assert got == {"T1": (True, None), "T3": (False, 4)}
    both = importing.resolve_incremental(first.unionByName(later), stored_of(first).limit(0))
    assert {r["external_id"]: r["stored_occurrence"] for r in both.filter("not already_stored").collect()} == {
        "T1": 1, "T2": 2, "T3": 4}


def test_rows_without_id_are_never_shifted(spark):
    first = ledger_rows(spark, [(17, "A", "-1")])
    later = ledger_rows(spark, [(17, "A", "-1"), (17, "A", "-1")], ids=[None, None], file_order=2)
    rows = importing.resolve_incremental(later, stored_of(first)).collect()
    assert sorted((r["occurrence"], r["already_stored"], r["stored_occurrence"]) for r in rows) == [(1, True, None), (2, False, 2)]


def test_manual_entry_needs_a_repeat_flag(spark):
    stored = stored_of(ledger_rows(spark, [(17, "A", "-1")]))
    mark = stored.first()["fingerprint"]
    entries = spark.createDataFrame(
        [(1, 1, mark, False), (2, 1, mark, True), (3, 1, "new", False), (4, 1, "new", False), (5, 1, "new", True)],
        "seq bigint, account_id bigint, fingerprint string, repeat boolean")
    got = {r["seq"]: (r["stored"], r["occurrence"]) for r in importing.enter_manually(entries, stored).collect()}
    assert got == {1: (False, 1), 2: (True, 2), 3: (True, 1), 4: (False, 1), 5: (True, 2)}


def test_row_numbers_do_not_depend_on_chunks_or_partitions(spark):
    rows = spark.range(2000).select((F.col("id") % 3).alias("k"), F.col("id").alias("line"))
    plain = {(r["k"], r["line"]): r["n"] for r in row_numbers(rows, ["k"], F.lit(0), ["line"], "n").collect()}
    cut = {(r["k"], r["line"]): r["n"] for r in
           row_numbers(rows.repartition(13), ["k"], F.floor(F.col("line") / 7), ["line"], "n").collect()}
    assert plain == cut and plain[(0, 3)] == 2


def test_running_last_crosses_chunks(spark):
    rows = spark.range(20).withColumn("k", F.lit("a"))
    value = F.when(F.col("id") % 7 == 0, F.concat(F.lit("v"), F.col("id").cast("string")))
    got = running_last(rows, ["k"], F.floor(F.col("id") / 2), "id", value, "v").orderBy("id").collect()
    assert [r["v"] for r in got] == [f"v{i // 7 * 7}" for i in range(20)]
    above = running_last(rows, ["k"], F.floor(F.col("id") / 2), "id", value, "v", before=True).orderBy("id").collect()
    assert [r["v"] for r in above][:9] == [None] + ["v0"] * 7 + ["v7"]


def test_labelled_file_defaults_and_errors(spark, tmp_path):
    (tmp_path / "csv").write_text(
        "transaction_id,description,amount,annotator_a_label,annotator_b_label,final_label,acceptable_labels,ambiguity_note\n"
        't1,SQ *SHOP #12,-4.50,LIVING_DINING,,,"LIVING_GROCERY | LIVING_DINING",either\nt2,,1,INCOME,,,,\n')
    rows = {r["transaction_id"]: r for r in annotated.read_labelled(spark, str(tmp_path)).collect()}
    assert rows["t1"]["acceptable"] == ["LIVING_DINING", "LIVING_GROCERY"] and rows["t1"]["ambiguous"]
    assert str(rows["t1"]["posted_on"]) == "1970-01-01" and rows["t1"]["source"] == "manual_annotation"
    assert rows["t1"]["merchant"] == "SHOP" and rows["t2"]["error"] == "description is blank"


def test_charge_file(spark, tmp_path):
    head = "id,posted_on,posted_time,merchant,category,amount,receipt\n"
    (tmp_path / "good.csv").write_text(head + "A,2026-07-14,10:00,Cloud,Infra,12000.00,true\nB,2026-08-14,10:04,Cloud,Infra,24500,false\n")
    (tmp_path / "bad.csv").write_text(head + "A,2026-07-14,10:00,Cloud,Infra,1.001,true\nA,2026-08-14,10:04,Cloud,Infra,NaN,maybe\nC,2026-08-14,10:04,Cloud,Infra,5,true,extra\n")
    judged = annotated.read_charges(spark, str(tmp_path))
    files = {r["file_id"].split("/")[-1]: r for r in annotated.charge_files(judged).collect()}
    assert files["good.csv"]["accepted"] and not files["bad.csv"]["accepted"]
    reasons = {r["line"]: r["reason"] for r in judged.filter("file_id like '%bad.csv'").collect()}
    assert reasons == {2: "invalid amount", 3: "invalid id", 4: "wrong field count"}


def test_registration_keeps_the_first_text(spark):
    names = spark.createDataFrame([(1, " Chase Checking", 1), (1, "chase-checking", 2), (2, "Chase checking", 1), (1, "!!", 3)],
                                  "tenant_id int, display_name string, position int")
    existing = spark.createDataFrame([(2, "chase-checking")], "tenant_id int, account_key string")
    got = [tuple(r) for r in stores.register_accounts(names, existing).collect()]
    assert got == [(1, "chase-checking", "Chase Checking")] and stores.unnamed_accounts(names).count() == 1


def test_prediction_log_refuses_a_partial_run(spark, tmp_path):
    rows = spark.createDataFrame([("t1", "a"), ("t2", "a"), ("t1", "b")], "transaction_id string, system string")
    digest = spark.createDataFrame([(2, 7)], "rows bigint, digest_a bigint")
    with pytest.raises(ValueError):
        annotated.write_predictions(rows, digest, str(tmp_path / "log"))
    annotated.write_predictions(rows.filter("system = 'a'"), digest, str(tmp_path / "log2"))
    assert annotated.read_predictions(spark, str(tmp_path / "log2"), "transaction_id string, system string").count() == 2


def test_run_log_is_append_only(spark, tmp_path):
    runs = spark.createDataFrame([("r1", 1), ("r2", 2)], "run_id string, created_at int")
    lines = spark.createDataFrame([("r1", "rent", -5.0, -7.0, -2.0), ("r2", "rent", 0.0, 1.0, 1.0)],
                                  "run_id string, code string, current_cash double, candidate_cash double, delta double")
    months = spark.createDataFrame([("r1", 0), ("r2", 3)], "run_id string, residual int")
    kept = stores.accepted_runs(runs, months, runs.limit(0))
    stores.append_runs(kept, stores.run_components(lines), str(tmp_path))
    saved = spark.read.parquet(f"{tmp_path}/runs")
    assert [r["run_id"] for r in saved.collect()] == ["r1"]
    assert spark.read.parquet(f"{tmp_path}/components").count() == 1
    assert stores.accepted_runs(runs, months.limit(0), saved).count() == 1


def test_a_late_row_decides_the_date_order(spark, tmp_path):
    body = "Date,Description,Amount\n" + "".join(f"0{k % 9 + 1}/05/2026,SHOP,-1.00\n" for k in range(205)) + "25/05/2026,SHOP,-1.00\n"
    (tmp_path / "bank.csv").write_text(body)
    found, _ = preview(spark, tmp_path)
    assert [r["date_order"] for r in found.collect()] == ["DAY_FIRST"]


def test_a_cell_of_any_length_is_a_cell(spark):
    long = "x" * 200_000
    frame = spark.createDataFrame([(f'"{long}, ""y""",b',)], "text string")
    assert frame.select(bankfiles.split_cells(F.col("text")).alias("c")).first()["c"] == [f'{long}, "y"', "b"]


def test_charge_file_with_another_header_is_refused(spark, tmp_path):
    (tmp_path / "good.csv").write_text(",".join(annotated.CHARGE_COLUMNS) + "\nA,2026-01-02,10:00,M,C,1.00000000001,true\nB,2026-01-02,10:00,M,C,1.50,true\n")
    (tmp_path / "other.csv").write_text("id,when\nA,2026-01-02\n")
    judged = annotated.read_charges(spark, str(tmp_path)).collect()
    assert sorted((r["file_id"].rsplit("/", 1)[1], r["id"], r["reason"]) for r in judged if r["reason"]) == [
        ("good.csv", "A", "invalid amount"), ("other.csv", None, "wrong header")]


def test_annotation_file_without_a_column_is_refused(spark, tmp_path):
    columns = [c for c in annotated.REQUIRED if c != "final_label"]
    (tmp_path / "a.csv").write_text(",".join(columns) + "\n" + ",".join(["T1", "SHOP", "1.00", "OTHER", "", "", ""]) + "\n")
    (tmp_path / "b.csv").write_text(",".join(annotated.REQUIRED) + "\n")
    assert [r["error"] for r in annotated.read_labelled(spark, str(tmp_path)).collect()] == ["required column missing: final_label"]
    headers, rows = bankfiles.split_header(bankfiles.records_from_lines(bankfiles.read_lines(spark, str(tmp_path))))
    refused = {r["file_id"].rsplit("/", 1)[1]: r["reason"] for r in annotated.refused_labelled_files(headers, rows).collect()}
    assert refused == {"a.csv": "required column missing: final_label", "b.csv": "no rows"}


def test_crowded_keys_are_cut_and_null_keys_are_one_group(spark, monkeypatch):
    rows = spark.createDataFrame(
        [(k, i, i % 3 == 0) for k in ("a", "b", None) for i in range(40)], "k string, id bigint, told boolean")
    told = F.when(F.col("told"), F.col("id"))
    chunk = F.floor(F.col("id") / 7)
    for crowded in (0, 1 << 16):
        monkeypatch.setattr(ranking, "CROWDED", crowded)
        numbered = row_numbers(rows, ["k"], chunk, ["id"], "n").collect()
        assert sorted(r["n"] for r in numbered) == sorted(list(range(1, 41)) * 3)
        assert all(r["n"] == r["id"] + 1 for r in numbered)
        last = running_last(rows, ["k"], chunk, "id", told, "v", before=True).collect()
        assert all(r["v"] == (None if r["id"] == 0 else (r["id"] - 1) // 3 * 3) for r in last)


def test_running_total_leaves_its_rows_where_the_window_put_them(spark):
    rows = spark.range(1000).selectExpr("id % 7 as k", "id", "cast(id as string) as text")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = row_numbers(rows, ["k"], F.floor(F.col("id") / 7), ["id"], "n")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # a null-safe match would deal all rows out again by coalesced keys
    assert "hashpartitioning(coalesce(" not in plan and "hashpartitioning(_part" in plan


def test_quotes_open_across_many_chunks(spark, monkeypatch):
    body = ['a,"x', "y", 'z, ""', "w", 'e",1', "b,c", 'd,"f', "g", 'h"', "", "i,j", 'k,"l', "m", "n", 'o",p', "q,r"] * 3
    lines = spark.createDataFrame([("f", i + 1, t) for i, t in enumerate(body)], "file_id string, line_no bigint, text string")
    want = [(r["line"], r["cells"]) for r in bankfiles.records_from_lines(lines).orderBy("line").collect()]
    assert [c for _, c in want] == [c for c in csv.reader(io.StringIO("\n".join(body))) if c]
    for size in (1, 2, 3, 5):
        monkeypatch.setattr(bankfiles, "CHUNK_LINES", size)
        assert [(r["line"], r["cells"]) for r in bankfiles.records_from_lines(lines).orderBy("line").collect()] == want


def test_statement_cells_are_judged_by_compiled_code(spark, tmp_path):
    # a method of more than 8,000 bytes is never compiled by the JVM and runs many times slower
    from tallystone.plans import bank_text

    rows = spark.createDataFrame(
        [("f", 1, 2, 0, "fine", "SHOP", 3, False, "2024-01-31", "4.00")],
        "file_id string, account_id long, line long, shape long, fault string, merchant string, part_id long,"
        " flipped boolean, day string, size string",
    ).withColumns({"posted_on": F.to_date("day"), "amount": F.col("size").cast("decimal(18,2)")})
    headers, records = bank_text.bank_headers(rows), bank_text.bank_records(rows)
    found = mapping.detect_mapping(headers, records).withColumn("amount_sign", F.lit("outflow-negative"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        examined = importing.examine(records, headers, found)
        plan = examined._jdf.queryExecution().executedPlan()
        debug = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$")
        stages = getattr(debug, "MODULE$").codegenStringSeq(plan)
        assert max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_records_meet_the_headers_only_after_their_cells_are_summed(spark):
    rows = spark.createDataFrame(
        [("a", ["2024-1-5", "(3.00)", "x", "7"]), ("a", ["13/01/2024", "123456789"]), ("a", None), ("a", []),
         ("b", None), ("c", ["1"]), (None, ["1"]), ("d", ["01/13/2024 10:30", " 5 Mar 2024 ", "12-31-2024", ""])],
        "file_id string, cells array<string>")
    headers = spark.createDataFrame(
        [("a", ["Date", "Amount", "Note"]), ("b", ["Date"]), ("d", ["w", "x", "y", "z", "u"]), ("e", ["Date"]), ("a", ["Date", "Sum"])],
        "file_id string, header array<string>")
    facts = mapping.column_evidence(headers, rows)
    got = {(r.file_id, r.position, r.column): (r.holds_dates, r.holds_money, r.date_order) for r in facts.collect()}
    assert facts.count() == len(got)
    assert got == {
        ("a", 0, "Date"): (True, False, "DAY_FIRST"), ("a", 1, "Amount"): (False, False, "AMBIGUOUS"),
        ("a", 1, "Sum"): (False, False, "AMBIGUOUS"), ("a", 2, "Note"): (False, False, "AMBIGUOUS"),
        ("b", 0, "Date"): (False, False, "AMBIGUOUS"), ("d", 0, "w"): (True, False, "MONTH_FIRST"),
        ("d", 1, "x"): (True, False, "ISO"), ("d", 2, "y"): (True, False, "MONTH_FIRST"),
        ("d", 3, "z"): (False, False, "AMBIGUOUS"), ("d", 4, "u"): (False, False, "AMBIGUOUS")}
    # the records are moved by no join: what is shuffled are sums
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("posexplode(header") < plan.index("Join Inner") < plan.index("Generate posexplode(cells")


def moves(frame):
    """How often the plan that ran deals rows out by keys, but for the counts of buckets."""
    frame.collect()
    ran = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return sum(" Exchange hashpartitioning(" in line and not re.search("_bucket|ReusedExchange", line) for line in ran.split("\n"))


def charges_of(spark, rows, order=1):
    kinds = ("account_id bigint, file_id string, line bigint, id string, posted_on date, merchant string, amount decimal(18,2),"
             " currency string, external_id string, file_order int")
    return spark.createDataFrame(
        [(a, f, n, f"{i}", dt.date(2026, 8, day), "M", Decimal(x), c, e, order) for i, (a, f, n, day, x, c, e) in enumerate(rows)], kinds)


def two_deliveries(spark):
    first = charges_of(spark, [(a, f"{a}-f", n, 17 + n % 2, "1", ("USD", None)[n % 3 == 0], e) for a in (1, 2, None)
                               for n, e in enumerate(["A", "B", None, "C", None, "Z", "D"])])
    second = charges_of(spark, [(a, f"{a}-g", n, 17 + n % 2, "1", ("USD", None)[n % 3 == 0], e) for a in (1, 2, 3, None)
                                for n, e in enumerate(["B", "E", None, None, "F", "A", None, None, "G"])], 2)
    third = charges_of(spark, [(a, f"{a}-h", n, 17, "1.00", "USD", f"H{n}") for a in (1, 3) for n in range(4)], 3)
    stored = charges_of(spark, [(a, f"{a}-s", n, 17 + n % 2, "1", "USD", e) for a in (1, 3, None) for n, e in enumerate(["A", None, "E", "X", "Y"])])
    return first.unionByName(second).unionByName(third), stored


def numbered(rows, whole):
    return importing.number_occurrences(importing.with_fingerprint(rows), "id", whole)


@pytest.mark.parametrize("resolve", [importing.resolve_incremental, importing.resolve_snapshot])
def test_charges_are_resolved_alike_whether_accounts_are_whole_or_cut(spark, monkeypatch, resolve):
    run, stored = two_deliveries(spark)
    was = resolve(numbered(run, False), numbered(stored, False))

    def work(rows, known, whole):
        return resolve(numbered(rows, whole), numbered(known, whole), whole)

    def told(frame):
        return sorted(map(repr, frame.select(*was.columns).collect()))

    for crowded in (20, 1 << 16):  # the larger accounts are cut, none is
        monkeypatch.setattr(ranking, "CROWDED", crowded)
        assert told(ranking.apart(work, ["account_id"], run, stored)) == told(was)


@pytest.mark.parametrize("resolve", [importing.resolve_incremental, importing.resolve_snapshot])
def test_charges_are_moved_once_by_account(spark, resolve):
    run, stored = two_deliveries(spark)

    def work(rows, known, whole):
        return resolve(numbered(rows, whole), numbered(known, whole), whole)

    assert moves(ranking.apart(work, ["account_id"], run, stored)) == 2


def test_entries_are_judged_alike_whether_accounts_are_whole_or_cut(spark, monkeypatch):
    _, stored = two_deliveries(spark)
    stored = numbered(stored, False).select("account_id", "fingerprint", "occurrence")
    stored = spark.createDataFrame(stored.collect(), stored.schema)
    marks = sorted(r[0] for r in stored.select("fingerprint").distinct().collect())
    entries = spark.createDataFrame(
        [(n, a, m, r) for n, (a, m, r) in enumerate(
            (a, m, r) for r in (None, False, True, False, None, True) for a in (1, 2, 3, None) for m in [*marks, "new"])],
        "seq bigint, account_id bigint, fingerprint string, repeat boolean")
    was = importing.enter_manually(entries, stored)
    for crowded in (15, 1 << 16):
        monkeypatch.setattr(ranking, "CROWDED", crowded)
        got = ranking.apart(importing.enter_manually, ["account_id"], entries, stored)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, was.collect()))
    assert moves(got) == 2


def test_records_of_whole_files_are_read_where_they_lie(spark, monkeypatch):
    body = AWKWARD.replace("\r\n", "\n").split("\n")
    lines = spark.createDataFrame(
        [(f, i + 1, t) for f, cut in (("a", 0), ("b", 3), (None, 0)) for i, t in enumerate(body[cut:])],
        "file_id string, line_no bigint, text string")

    def work(lines, whole):
        headers, rows = bankfiles.split_header(bankfiles.records_from_lines(lines, whole))
        return bankfiles.named_columns(headers, rows, ["Date", "Details", "Amount"])

    was = sorted(map(repr, work(lines, False).collect()))
    assert len(was) > 8
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for crowded in (0, 1 << 16):
            monkeypatch.setattr(ranking, "CROWDED", crowded)
            got = ranking.apart(work, ["file_id"], lines)
            assert sorted(map(repr, got.collect())) == was
        assert moves(got) == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_ledger_is_written_by_the_tasks_that_hold_its_rows(spark, tmp_path):
    rows = spark.range(40).selectExpr("id", "id % 3 as account_id", "date_add(date '2026-01-30', cast(id % 4 as int)) as posted_on")
    context = spark.sparkContext
    context.setJobGroup("ledger", "append")
    stores.append_ledger(rows, str(tmp_path / "ledger"))
    context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    assert [len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup("ledger")] == [1]
    read = stores.read_ledger(spark, str(tmp_path / "ledger"))
    assert {r["posted_month"]: r["count"] for r in read.groupBy("posted_month").count().collect()} == {"2026-01": 20, "2026-02": 20}
    assert list((tmp_path / "ledger").glob("*/*.zstd.parquet"))
