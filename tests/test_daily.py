"""Preprocessing: hand-computed groups (mixed, multi-negative, negative-only) and headers."""

import datetime as dt

import pytest
from pyspark.sql import Row

from proofbox.operators import daily as dl

RAW = [
    # No., product, qty, sales, weather, temp_avg
    ("2026-01-01", "Croissant", 30, 600, "Sunny", 5.0),
    ("2026-01-01", "Croissant", 20, 400, None, None),
    ("2026-01-01", "Croissant", -5, -100, "Rainy", 4.0),  # three lines in the group: 50 sold, 5 waste
    ("2026-01-01", "Bagel", 12, 240, "Sunny", 5.0),
    ("2026-01-02", "Croissant", 10, 200, "Cloudy", 3.0),
    ("2026-01-02", "Croissant", -2, -40, "Cloudy", 3.0),
    ("2026-01-02", "Croissant", -3, -60, "Cloudy", 3.0),
]


def raw_frame(spark, rows=RAW):
    cols = ["No.", "상품명", "수량", "실매출", "weather", "temp_avg"]
    return spark.createDataFrame(rows, cols).withColumn("line_ord", __import__("pyspark.sql.functions", fromlist=["x"]).monotonically_increasing_id())


def test_mixed_and_multi_negative_groups(spark):
    df = dl.daily_table(dl.clean_ledger(raw_frame(spark)))
    rows = {(r.date, r.product): r for r in df.collect()}
    assert len(rows) == 3
    c1 = rows[(dt.date(2026, 1, 1), "Croissant")]
    assert (c1.sold_qty, c1.waste_qty, c1.made_qty, c1.net_qty) == (50.0, 5.0, 55.0, 45.0)
    assert (float(c1.gross_sales), float(c1.waste_value)) == (1000.0, 100.0)
    assert c1.source_row_count == 3 and c1.positive_row_count == 2 and c1.negative_row_count == 1
    # first VALID weather / temperature in input order (nulls skipped)
    assert c1.weather == "Sunny" and c1.temp_avg == 5.0
    c2 = rows[(dt.date(2026, 1, 2), "Croissant")]
    assert (c2.sold_qty, c2.waste_qty, c2.source_row_count, c2.negative_row_count) == (10.0, 5.0, 3, 2)
    assert c2.multi_negative_rows_flag == 1 and c2.only_negative_flag == 0
    assert df.columns == dl.DAILY_COLUMNS


def test_negative_only_group(spark):
    df = spark.createDataFrame([("2026-01-05", "Baguette", "-10", "-200")], ["No.", "상품명", "수량", "실매출"])
    r = dl.daily_table(dl.clean_ledger(df)).collect()[0]
    assert (r.sold_qty, r.waste_qty, r.made_qty, r.net_qty) == (0.0, 10.0, 10.0, -10.0)
    assert r.only_negative_flag == 1 and r.has_positive_row == 0
    assert r.weather is None and r.temp_avg is None


def test_minimal_columns_get_null_weather(spark):
    df = spark.createDataFrame([("2026-01-01", "Croissant", 10)], ["date", "product", "qty"])
    out = dl.daily_table(dl.clean_ledger(df))
    r = out.collect()[0]
    assert r.weather is None and r.temp_avg is None and r.temp_max is None and r.temp_min is None
    assert float(r.gross_sales) == 0.0


def test_english_headers_pass_through(spark):
    df = spark.createDataFrame(
        [("2026-01-01", "A", 5, "Sunny", 3.0), ("2026-01-01", "A", 2, "Sunny", 3.0),
         ("2026-01-02", "A", 4, "Rainy", 1.0), ("2026-01-02", "A", -1, "Rainy", 1.0)],
        ["date", "product", "qty", "weather", "temp_avg"],
    )
    assert dl.daily_table(dl.clean_ledger(df)).count() == 2


def test_missing_required_column_is_reported(spark):
    df = spark.createDataFrame([("2026-01-01", 1)], ["date", "qty"])
    with pytest.raises(ValueError, match="product"):
        dl.normalise_columns(df)


def test_bad_values_tolerated(spark):
    df = spark.createDataFrame(
        [("2026-01-01", "A", "x"), ("not a date", "A", "3"), ("20260101", "A", "4"), ("2026-01-01", None, "1")],
        ["date", "product", "qty"],
    )
    out = dl.daily_table(dl.clean_ledger(df)).collect()
    assert len(out) == 1
    r = out[0]
    # the unparsable qty row still counts as a source row (0 qty), the compact date parses
    assert r.source_row_count == 2 and r.sold_qty == 4.0


def test_select_positions_out_of_range(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["a", "b", "c"])
    assert dl.select_positions(df, [0, 2], ["x", "y"]).columns == ["x", "y"]
    with pytest.raises(IndexError):
        dl.select_positions(df, [0, 5], ["x", "y"])


def test_shuffle_invariance(spark):
    from proofbox.plans.ledger_queries import q_daily_table
    from tests.conftest import SF_SMOKE

    a = sorted(map(tuple, q_daily_table(spark, SF_SMOKE).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        b = sorted(map(tuple, q_daily_table(spark, SF_SMOKE).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert a == b


_ = Row
