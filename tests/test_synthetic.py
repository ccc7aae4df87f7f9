"""Synthetic ledger: rules hold, output is deterministic and flows through the daily table."""

from pyspark.sql import functions as F

from proofbox.operators import daily as dl
from proofbox.sources.synthetic import synth_ledger


def test_synthetic_rules(spark):
    raw = synth_ledger(spark, days=60, seed=1)
    daily = dl.daily_table(dl.clean_ledger(raw))
    assert daily.count() == 60 * 4
    assert daily.filter(F.col("sold_qty") < 5).count() == 0
    assert raw.filter((F.col("weather") == "Snow") & (F.col("temp_avg") >= 0)).count() == 0
    assert raw.filter((F.col("수량") < 0) & (F.col("실매출") != 0)).count() == 0
    a = sorted(map(tuple, synth_ledger(spark, days=30, seed=7).collect()))
    b = sorted(map(tuple, synth_ledger(spark, days=30, seed=7).repartition(5).collect()))
    assert a == b
