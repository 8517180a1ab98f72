"""Rates that are observed during a write."""

import pytest
from pyspark.sql import functions as F

from gridloom.plans import observe


def test_rates_come_from_the_write(spark, tmp_path, monkeypatch):
    flags = spark.range(3000).select(F.when(F.col("id") % 7 == 3, None).otherwise(F.concat(F.lit("b"), F.col("id") % 7)).alias("baseline"), (F.col("id") % 5 == 0).alias("flag")).repartition(4)
    report = observe.write_flags(flags, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.columns == ["baseline", "flag"]
    want = sorted(((r["baseline"], r["n"], r["f"]) for r in back.groupBy("baseline").agg(F.count("*").alias("n"), F.count_if("flag").alias("f")).collect()), key=lambda x: (x[0] is None, x[0] or ""))
    assert report.rates() == want
    assert report.totals() == (3000, 600)
    assert report.seconds > 0
    assert report.table(spark).filter("key = 'b0'").first()["percent"] == pytest.approx(100 * want[0][2] / want[0][1])
    numbers, later = observe.watched(flags.select("baseline", F.when(F.col("flag"), 4).alias("flag")))
    numbers.collect()
    assert later.rates() == want
    monkeypatch.setattr(observe, "COUNTERS", 64)
    monkeypatch.setattr(observe, "MOST", 16)
    many, report = observe.watched(spark.range(2000).select(F.col("id").alias("baseline"), F.lit(True).alias("flag")))
    many.count()
    with pytest.raises(ValueError, match="keys"):
        report.rates()


def test_no_rows(spark, tmp_path):
    report = observe.write_flags(spark.createDataFrame([], "baseline int, flag boolean"), str(tmp_path / "out"))
    assert report.rates() == []
    assert report.totals() == (0, 0)
