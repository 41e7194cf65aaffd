"""Continuous jobs against their batch answers."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tallystone.operators import ranking
from tallystone.plans.catalogue import QUERIES
from tallystone.session import portions
from tallystone.streaming import flows

SCHEMA = ("id string, account_id bigint, file_id string, line bigint, posted_on date, merchant string,"
          " amount decimal(18,2), currency string, external_id string")


def delivery(spark, folder, name, ids):
    rows = [(f"{name}-{i}", 1, name, i + 2, dt.date(2026, 8, 17), "A", Decimal("-1.00"), "USD", x) for i, x in enumerate(ids)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_incremental_import_survives_restarts(spark, tmp_path):
    source, ledger, checkpoint = (str(tmp_path / n) for n in ("in", "ledger", "progress"))
    delivery(spark, source, "f1", ["T1", "T2"])

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        flows.import_deliveries(stream, ledger, checkpoint).awaitTermination()
        rows = spark.read.schema(flows.STORED).parquet(ledger).collect()
        return sorted((r["external_id"], r["occurrence"]) for r in rows)

    assert run() == [("T1", 1), ("T2", 2)]
    delivery(spark, source, "f2", ["T1", "T3"])
    assert run() == [("T1", 1), ("T2", 2), ("T3", 4)]
    assert run() == [("T1", 1), ("T2", 2), ("T3", 4)]


def test_a_new_checkpoint_keeps_the_ledger(spark, tmp_path):
    source, ledger = str(tmp_path / "in"), str(tmp_path / "ledger")

    def run(checkpoint):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        flows.import_deliveries(stream, ledger, str(tmp_path / checkpoint)).awaitTermination()
        rows = spark.read.schema(flows.STORED).parquet(ledger).collect()
        return sorted(r["external_id"] for r in rows)

    delivery(spark, source, "f1", ["T1", "T2"])
    assert run("first") == ["T1", "T2"]
    delivery(spark, source, "f2", ["T9", "T2"])
    assert run("second") == ["T1", "T2", "T9"]
    assert run("first") == ["T1", "T2", "T9"]


def test_late_charges_are_counted(spark, tmp_path):
    source = str(tmp_path / "in")
    kind = "seq bigint, posted_on date, minute_of_day int, merchant string, amount decimal(18,2)"

    def put(rows):
        spark.createDataFrame([(s, dt.date(2026, 8, 14), m, "A", Decimal("1")) for s, m in rows], kind).coalesce(1).write.mode("append").parquet(source)

    put([(1, 10), (2, 14), (3, 600)])
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(source)

    def go():
        query = flows.append_to(flows.duplicate_minutes(flows.minute_charges(stream), flows.minute_charges(stream)),
                                str(tmp_path / "out"), str(tmp_path / "progress"))
        query.awaitTermination()
        return query

    go()
    pairs = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["seq_left"], r["seq_right"], r["minutes_apart"]) for r in pairs] == [(1, 2, 4)]
    put([(4, 12)])
    assert flows.rows_too_late(go()) > 0


def test_minutes_of_a_full_day_meet_only_their_blocks(spark, capsys):
    """Every pair one to five minutes apart, across blocks and once each, found by equality of blocks."""
    charges = spark.range(40).select(
        F.col("id").alias("seq"), F.lit("SHOP").alias("merchant"), F.lit(5).cast("decimal(18,2)").alias("amount"),
        F.lit("2024-01-01").cast("date").alias("posted_on"), F.col("id").alias("minute_of_day"))
    pairs = flows.duplicate_minutes(flows.minute_charges(charges), flows.minute_charges(charges))
    found = sorted((r.seq_left, r.seq_right, r.minutes_apart) for r in pairs.collect())
    assert found == sorted((i, j, j - i) for i in range(40) for j in range(i + 1, min(i + 6, 40)))
    pairs.explain()
    assert "block" in capsys.readouterr().out


def test_large_tables_are_cut_by_rows(spark):
    cut = portions(spark.range(0, 1000, 1, 2), 100)
    assert cut.rdd.getNumPartitions() == 10 and cut.distinct().count() == 1000
    assert portions(spark.range(0, 1000, 1, 2), 500).rdd.getNumPartitions() == 2
    assert portions(spark.range(0), 500).count() == 0


def test_levers_start_from_pairs_computed_once(spark, tmp_path):
    spark.range(1, 6).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    levers = QUERIES["k12_negotiation_levers"](spark, str(tmp_path))
    assert not [path for path in levers.inputFiles() if "customer.parquet" in path]
    assert levers.groupBy("pair_id").count().filter("count = 4").count() == 5


def test_a_delivery_with_one_large_account_is_imported_like_others(spark, tmp_path, monkeypatch):
    source = str(tmp_path / "in")
    for name, accounts in (("f1", (1, 1, 1, 1, 2)), ("f2", (1, 2, 2, 3))):
        rows = [(f"{name}-{i}", a, f"{name}-{a}", i, dt.date(2026, 8, 17), "A", Decimal("-1.00"), "USD", f"T{a}{i}")
                for i, a in enumerate(accounts)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def run(name, crowded):
        monkeypatch.setattr(ranking, "CROWDED", crowded)
        ledger = str(tmp_path / name)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        flows.import_deliveries(stream, ledger, f"{ledger}-progress").awaitTermination()
        assert list((tmp_path / name).glob("run=*/batch=*/bucket=*/*.zstd.parquet"))
        return sorted((r["external_id"], r["occurrence"]) for r in spark.read.schema(flows.STORED).parquet(ledger).collect())

    want = [("T10", 1), ("T11", 2), ("T12", 3), ("T13", 4), ("T21", 2), ("T22", 3), ("T24", 1), ("T33", 1)]
    assert [run(f"ledger-{c}", c) for c in (3, 1 << 16)] == [want] * 2
