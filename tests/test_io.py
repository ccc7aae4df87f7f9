"""Sources and sinks: CSV export with BOM and Korean headers, partitioned daily table, model save/load."""

import datetime as dt

from pyspark.sql import functions as F

from proofbox.operators import daily as dl
from proofbox.operators import forecast as fc
from proofbox.sources.ledger_io import read_ledger


def test_read_csv_with_bom_and_korean_headers(spark, tmp_path):
    p = tmp_path / "history.csv"
    p.write_bytes("\ufeffNo.,상품명,수량,실매출,weather,temp_avg\n2026-01-01,Croissant,30,600,Sunny,5.0\n"
                  "2026-01-01,Croissant,-5,-100,Sunny,5.0\n2026-01-02,Bagel,x,0,,\n".encode("utf-8"))
    raw = read_ledger(spark, str(p))
    assert raw.columns[:4] == ["No.", "상품명", "수량", "실매출"]
    out = {(r.date, r.product): r for r in dl.daily_table(dl.clean_ledger(raw)).collect()}
    c = out[(dt.date(2026, 1, 1), "Croissant")]
    assert (c.sold_qty, c.waste_qty, float(c.gross_sales), float(c.waste_value)) == (30.0, 5.0, 600.0, 100.0)
    b = out[(dt.date(2026, 1, 2), "Bagel")]
    assert b.sold_qty == 0.0 and b.source_row_count == 1 and b.weather is None


def test_write_daily_partitioned_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([("2026-01-01", "A", 3), ("2026-02-01", "A", 4)], ["date", "product", "qty"])
    daily = dl.daily_table(dl.clean_ledger(df))
    path = str(tmp_path / "daily")
    dl.write_daily(daily, path)
    back = fc.read_features(spark, path)
    assert back.filter(F.col("month") == "2026-02").count() == 1
    assert set(dl.DAILY_COLUMNS) <= set(back.columns)
    assert dl.union_panels(daily, daily).count() == 4


def test_model_save_and_load(spark, tmp_path):
    rows = []
    start = dt.date(2024, 1, 1)
    for i in range(80):
        rows.append((start + dt.timedelta(days=i), "P" + str(i % 2), "Sunny" if i % 3 else "Rainy", float(10 + i % 7), float(i % 5)))
    df = spark.createDataFrame(rows, "date date, product string, weather string, sold_qty double, sold_lag_1 double")
    model = fc.fit_primary(df, "sold_qty", max_iter=3, depth=3)
    pred = fc.predict_primary(model, df, "sold_qty")
    assert pred.filter(F.col("pred") < 0).count() == 0
    path = str(tmp_path / "gbt")
    fc.save_model(model, path)
    again = fc.predict_primary(fc.load_pipeline(path), df, "sold_qty")
    a = sorted((r.product, r.date, round(r.pred, 9)) for r in pred.collect())
    b = sorted((r.product, r.date, round(r.pred, 9)) for r in again.collect())
    assert a == b


def test_coefficients_json_files(spark, tmp_path):
    from proofbox.operators import demand as dm

    coeffs = spark.createDataFrame(
        [("Rye Bread", 10.5, {"day_Monday": 2.0, "temp": 0.1}, 1.0, 12.0)],
        "product string, base_bias double, weights map<string,double>, waste_risk double, avg_made double",
    )
    lines = str(tmp_path / "coef_lines")
    dm.write_keyed_json(coeffs, lines)
    back = dm.read_coefficients(spark, lines).first()
    assert back.product_key == "RyeBread" and back.base_bias == 10.5 and back.weights["temp"] == 0.1
    # one whole JSON object keyed by product; missing waste_risk / avg_made default to 0.0
    whole = tmp_path / "model.json"
    whole.write_text('{"Sour dough": {"base_bias": 3.0, "weights": {}},\n "Bagel": {"base_bias": 1.5, "weights": {"is_rain": -2.0}, "waste_risk": 0.5}}')
    rows = {r.product_key: r for r in dm.read_coefficients(spark, str(whole), whole_file=True).collect()}
    assert rows["Sourdough"].waste_risk == 0.0 and rows["Sourdough"].avg_made == 0.0 and rows["Bagel"].weights == {"is_rain": -2.0}


def test_input_order_over_files_and_blocks(spark, tmp_path):
    """The ordinal follows the file paths, then the places in the files, also where files are read in several blocks."""
    from proofbox.sources.ledger_io import read_ledger

    want = []
    for name, n in (("b.csv", 4000), ("a.csv", 3000), ("c.csv", 1)):
        (tmp_path / name).write_text("No.,qty\n" + "".join(f"{name}-{i:05d},{i}\n" for i in range(n)))
    for name, n in (("a.csv", 3000), ("b.csv", 4000), ("c.csv", 1)):
        want += [f"{name}-{i:05d}" for i in range(n)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (old, "10000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            df = read_ledger(spark, str(tmp_path), ordinal="line_ord")
            assert df.columns == ["No.", "qty", "line_ord"] and df.select("line_ord").distinct().count() == len(want)
            assert [r[0] for r in df.orderBy("line_ord").select("`No.`").collect()] == want
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_first_valid_weather_follows_the_files(spark, tmp_path):
    from proofbox.sources.ledger_io import read_ledger

    (tmp_path / "2.csv").write_text("date,product,qty,weather,temp_avg\n2026-01-01,A,1,Snow,1.0\n")
    (tmp_path / "1.csv").write_text("date,product,qty,weather,temp_avg\n2026-01-01,A,1,,\n2026-01-01,A,1,Rainy,\n2026-01-01,A,1,Sunny,7.0\n")
    r = dl.daily_table(dl.clean_ledger(read_ledger(spark, str(tmp_path), ordinal="line_ord"))).first()
    assert (r.weather, r.temp_avg, r.source_row_count) == ("Rainy", 7.0, 4)
