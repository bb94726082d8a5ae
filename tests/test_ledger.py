"""The ledger: all tables of a batch or none, whatever fails between them."""

import os

import pytest
from pyspark.sql import functions as F

from dossier.sources.ledger import Ledger


def tables(spark, n, tag="x"):
    rows = spark.range(n).withColumn("tag", F.lit(tag))
    return {"evidence": rows, "checksums": rows.withColumn("sha", F.sha2(F.col("id").cast("string"), 256)), "metadata": rows.where("id > 0")}


def shown(ledger):
    """(batch, tag, rows) of each table as a reader sees them."""
    return {n: sorted(map(tuple, ledger.read(n).groupBy("batch", "tag").count().collect())) for n in ("evidence", "checksums", "metadata")}


def test_a_failure_between_tables_shows_nothing(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    assert ledger.commit(1, tables(spark, 5))
    before = shown(ledger)
    broken = tables(spark, 9, "late")
    broken["metadata"] = broken["metadata"].withColumn("id", F.when(F.col("id") > 3, F.raise_error(F.lit("disk full"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="disk full"):
        ledger.commit(2, broken)
    assert os.path.exists(f"{tmp_path}/data/evidence/batch=2") and shown(ledger) == before
    assert ledger.commit(2, tables(spark, 3, "again"))
    assert shown(ledger) == {"evidence": [(1, "x", 5), (2, "again", 3)], "checksums": [(1, "x", 5), (2, "again", 3)], "metadata": [(1, "x", 4), (2, "again", 2)]}
    assert {r.batch: r.tables for r in ledger.manifests().collect()} == {1: {"evidence": 5, "checksums": 5, "metadata": 4}, 2: {"evidence": 3, "checksums": 3, "metadata": 2}}
    assert ledger.vacuum(hours=1) == 0
    kept = shown(ledger)
    assert ledger.vacuum(hours=0) >= 2 and shown(ledger) == kept


def test_a_crash_before_the_rename_shows_nothing(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    attempt, rows = ledger.stage(5, tables(spark, 4))
    assert ledger.manifests().count() == 0 and ledger.read("evidence").count() == 0
    assert ledger.publish(5, attempt, rows) and ledger.read("evidence").count() == 4


def test_of_two_attempts_one_wins(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    staged = [ledger.stage(1, tables(spark, n, f"by {n}")) for n in (2, 7)]
    won = [(ledger.publish(1, *staged[n]), n) for n in (1, 0)]
    assert won == [(True, 1), (False, 0)]
    n = next(n for w, n in won if w)
    assert shown(ledger)["evidence"] == [(1, f"by {(2, 7)[n]}", (2, 7)[n])]
    assert not ledger.commit(1, tables(spark, 1, "late")) and len(shown(ledger)["metadata"]) == 1


def test_empty_tables_and_chosen_batches(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    assert ledger.commit(1, tables(spark, 0)) and ledger.commit(2, tables(spark, 2)) and ledger.commit(3, tables(spark, 2))
    assert {r.batch for r in ledger.read("evidence", [1, 3]).collect()} == {3}
