"""Batch forecast for requests, and streaming jobs equal to their batch twins."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from proofbox.operators import daily as dl
from proofbox.operators import lifecycle as lc
from proofbox.operators import serving as sv
from proofbox.sources import fixtures as fx
from proofbox.streaming import event_time as et
from proofbox.streaming import jobs as sj
from tests.test_lifecycle import _actions


def _daily(spark, days=40):
    rows = []
    start = dt.date(2024, 1, 1)
    for i in range(days):
        rows.append((start + dt.timedelta(days=i), "A", float(10 + i % 3), 1.0, float(11 + i % 3), float(9 + i % 3),
                     0.0, 0.0, "Sunny", 10.0, 15.0, 5.0, 1, 1, 1, 1, 2, 0, 0))
    return spark.createDataFrame(rows, dl.DAILY_COLUMNS).withColumn("gross_sales", F.col("gross_sales").cast("decimal(18,2)"))


def test_requests(spark):
    d = _daily(spark)
    req = spark.createDataFrame(
        [("r1", "A", "2024-02-10", "Rainy", 4.0), ("r2", "A", "2023-12-01", "Sunny", 1.0),
         ("r3", "B", "2024-02-10", "Sunny", 1.0), ("r4", "A", "02/10/2024", "Sunny", 1.0)],
        "request_id string, product string, target_date string, forecast_weather string, forecast_temp double",
    )
    stand = lambda c: (lambda f: F.col(c))
    out = {r.request_id: r for r in sv.forecast(req, d, stand("sold_rolling_mean_7"), stand("sold_same_dow_mean_4"),
                                                stand("waste_rolling_mean_7"), stand("waste_same_dow_mean_4")).collect()}
    assert set(out) == {"r1", "r2", "r3"}
    assert out["r2"].confidence_label == "Failed" and out["r3"].confidence_label == "Failed"
    last7 = [10 + i % 3 for i in range(33, 40)]
    assert abs(out["r1"].predicted_sold_qty - (sum(last7) / 7)) < 1e-9 or out["r1"].sold_strategy != "target_optimal_average"
    assert [r.request_id for r in sv.rejected_requests(req).collect()] == ["r4"]
    f = sv.request_features(req, d).filter(F.col("request_id") == "r1").first()
    assert f.sold_lag_1 == float(10 + 39 % 3) and f.temp_avg_lag_1 == 10.0 and f.temp_avg_diff_1 == -6.0 and f.is_cold_shock == 1


ACTIONS = "key long, ts timestamp_ntz, seq long, action string, amount double"
LIFE = ["key", "seq", "action", "status_before", "status_after", "accepted", "note"]
KEYS = ["key", "seq"]


def _in_files(spark, rows, folder, n):
    """The rows as ``n`` files in the given order, one file each, oldest modification first."""
    for i in range(n):
        spark.createDataFrame(rows[i::n], ACTIONS).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(ACTIONS).option("maxFilesPerTrigger", 1).parquet(folder)


def _same(a, b):
    return sorted(map(str, map(tuple, a.collect()))) == sorted(map(str, map(tuple, b.collect())))


def test_streaming_lifecycle_and_admission_over_shuffled_files_equal_batch(spark, tmp_path):
    rows = _actions(seed=21)
    random.Random(4).shuffle(rows)
    df = spark.createDataFrame(rows, ACTIONS)
    stream = _in_files(spark, rows, str(tmp_path / "a"), 4)
    life = sj.run_available(sj.stream_order_lifecycle(stream, "20 days"), "t-life", "update", KEYS)
    assert {r.stage for r in life.select("stage").distinct().collect()} <= {"open", "final"}
    assert _same(life.select(LIFE), lc.order_lifecycle(df).select(LIFE))
    adm = sj.run_available(sj.stream_admission(lc.point_moves_from_actions(stream), "20 days"), "t-adm", "update", KEYS)
    want = lc.admit(lc.point_moves_from_actions(df))
    assert _same(adm.select(want.columns), want)


def test_late_actions_change_nothing_and_are_all_there(spark, tmp_path):
    rows = _actions(seed=22)
    random.Random(5).shuffle(rows)
    stream = _in_files(spark, rows, str(tmp_path / "a"), 4)
    life = sj.run_available(sj.stream_order_lifecycle(stream, "3 days"), "t-late", "update", KEYS).persist()
    known = [r for r in rows if r[3] in lc.LIFECYCLE_ACTIONS]
    seqs = {r.stage: {x.seq for x in life.collect() if x.stage == r.stage} for r in life.select("stage").distinct().collect()}
    assert set(seqs) == {"open", "final", "late"}
    assert sum(map(len, seqs.values())) == len(known) == len(set().union(*seqs.values()))
    # late: behind the newest time of the earlier files, less the delay
    late, newest = set(), None
    for i in range(4):
        part = [r for r in rows[i::4] if r[3] in lc.LIFECYCLE_ACTIONS]
        late |= {r[2] for r in part if newest and r[1] <= newest - dt.timedelta(days=3)}
        newest = max([r[1] for r in part] + ([newest] if newest else []))
    assert seqs["late"] == late
    final = {r[2] for r in known if r[2] not in late and r[1] <= newest - dt.timedelta(days=3)}
    assert seqs["final"] == final
    in_time = spark.createDataFrame([r for r in known if r[2] not in late], ACTIONS)
    assert _same(life.where("stage != 'late'").select(LIFE), lc.order_lifecycle(in_time).select(LIFE))


def test_closed_orders_are_evicted(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    day = dt.timedelta(days=1)
    rows = [(1, t, 1, "create", 0.0), (1, t + day, 2, "complete", 0.0), (2, t + day, 3, "create", 0.0), (9, t + 12 * day, 4, "create", 0.0), (9, t + 30 * day, 5, "confirm", 0.0),
            (1, t + 31 * day, 6, "cancel", 0.0), (2, t + 31 * day, 7, "confirm", 0.0)]
    folder, path = str(tmp_path / "a"), str(tmp_path / "q")
    for some in (rows[:4], rows[4:5], rows[5:]):  # one run after each landing
        spark.createDataFrame(some, ACTIONS).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(ACTIONS).parquet(folder)
        out = sj.run_available(sj.stream_order_lifecycle(stream, "1 day", retain_ms=5 * 86_400_000), "t-evict", "update", KEYS, path=path)
        state = {r.key.key: r.value.status for r in spark.read.format("statestore").option("path", f"{path}/checkpoint").option("stateVarName", "at").load().collect()}
        if len(some) == 1:
            assert state == {2: "PENDING", 9: "PENDING"}  # order 1 is closed and forgotten
    got = {r.seq: (r.status_before, r.accepted, r.note) for r in out.collect()}
    assert got[6] == ("NONE", False, "order_not_found") and got[7] == ("PENDING", True, None) and got[2] == ("PENDING", True, None)


def test_daily_stream_keeps_late_lines(spark, tmp_path):
    cols = "date date, product string, qty double, sales double, weather string, temp_avg double, line_ord long"
    first = [(dt.date(2024, 1, 10), "A", 5.0, 10.0, "Sunny", 1.0, 1), (dt.date(2024, 1, 20), "A", 3.0, 6.0, "Sunny", 1.0, 2), (None, "A", 1.0, 1.0, "Sunny", 1.0, 9)]
    second = [(dt.date(2024, 1, 10), "A", 7.0, 14.0, "Sunny", 1.0, 3), (dt.date(2024, 1, 19), "A", 1.0, 2.0, "Rainy", 1.0, 4), (dt.date(2024, 1, 17), "A", 1.0, 2.0, "Sunny", 1.0, 5)]
    third = [(dt.date(2024, 1, 18), "B", 2.0, 4.0, None, 1.0, 6), (dt.date(2024, 2, 1), "A", -2.0, -4.0, "Sunny", 1.0, 7)]
    folder, path = str(tmp_path / "l"), str(tmp_path / "q")
    for some in (first, second, third):
        spark.createDataFrame(some, cols).write.mode("append").parquet(folder)
        table, late = et.run_daily(spark.readStream.schema(cols).parquet(folder), 3, path)
    assert sorted(r.line_ord for r in late.collect()) == [3, 5]  # on or before 20 - 3
    lines = spark.createDataFrame([*first, *second, *third], cols)
    want = dl.daily_table(lines.where("line_ord not in (3, 5)"))
    assert _same(table.select(want.columns), want)
    closed = spark.read.parquet(f"{path}/closed")
    assert {str(r.date) for r in closed.collect()} == {"2024-01-10", "2024-01-18", "2024-01-19", "2024-01-20"}
    assert table.count() == closed.select("date", "product").distinct().count() + 1
    again, _ = et.run_daily(spark.readStream.schema(cols).parquet(folder), 3, path)  # nothing new
    assert _same(again.select(want.columns), want)


def test_daily_stream_over_shuffled_files(spark, tmp_path):
    """Landed and late lines together are all lines, row by row, one file a batch."""
    sf = "/root/testdata/sf0.001"
    lines = fx.ledger(spark, sf).persist()
    folder = str(tmp_path / "l")
    lines.orderBy(F.rand(3)).repartition(4).write.parquet(folder)
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    table, late = et.run_daily(stream, 400)
    late = late.select(lines.columns)
    in_time = lines.exceptAll(late)  # line by line, repeated lines too
    assert 0 < late.count() < lines.count() and in_time.count() + late.count() == lines.count()
    want = dl.daily_table(in_time)
    assert _same(table.select(want.columns), want)


def test_daily_stream_watermark_evicts_closed_days(spark, tmp_path):
    cols = "date date, product string, qty double, sales double, weather string, temp_avg double, line_ord long"
    folder, path = str(tmp_path / "l"), str(tmp_path / "q")
    for some in ([(dt.date(2024, 1, 10), 5.0, 1), (dt.date(2024, 1, 20), 3.0, 2)], [(dt.date(2024, 1, 10), 7.0, 3), (dt.date(2024, 1, 19), 1.0, 4)]):
        spark.createDataFrame([(d, "A", q, q, "Sunny", 1.0, i) for d, q, i in some], cols).write.mode("append").parquet(folder)
        out = sj.run_available(sj.stream_daily(spark.readStream.schema(cols).parquet(folder), "3 days"), "t-daily", mode="update", keys=["date", "product"], path=path)
    got = {r.date.day: r.sold_qty for r in out.collect()}
    assert got == {10: 5.0, 19: 1.0, 20: 3.0}  # day 10 was closed and its state gone when the line came


def test_lifecycle_shuffle_invariance(spark):
    from pyspark.sql import functions as F  # noqa: F401

    rows = _actions(seed=33)
    df = spark.createDataFrame(rows, "key long, ts timestamp_ntz, seq long, action string, amount double")
    a = sorted(map(tuple, lc.order_lifecycle(df).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        b = sorted(map(tuple, lc.order_lifecycle(df).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert a == b


def test_requests_with_fitted_models(spark):
    from proofbox.operators import features as ft
    from proofbox.operators import forecast as fc

    d = _daily(spark, 60)
    feats = ft.build_features(d)
    sold_model = fc.fit_primary(feats, "sold_qty", max_iter=3, depth=3)
    waste_model = fc.fit_primary(feats, "waste_qty", max_iter=3, depth=3)
    req = spark.createDataFrame([("r1", "A", "2024-03-05", "Rainy", 4.0), ("r2", "Z", "2024-03-05", "Sunny", 1.0)],
                                "request_id string, product string, target_date string, forecast_weather string, forecast_temp double")
    out = {r.request_id: r for r in sv.forecast(
        req, d, sv.model_predictor(sold_model), lambda f: F.col("sold_same_dow_mean_4"),
        sv.model_predictor(waste_model), lambda f: F.col("waste_same_dow_mean_4")).collect()}
    assert out["r1"].predicted_sold_qty > 0 and out["r1"].confidence_label != "Failed"
    assert out["r2"].confidence_label == "Failed" and out["r2"].recommended_made_qty == 0.0


TABLE_STREAMS = (("stream_daily", "daily_table"), ("stream_lifecycle", "order_lifecycle"), ("stream_admission", "point_admission"), ("stream_status_counts", "status_counts"), ("stream_stock_position", "stock_position"))


@pytest.mark.parametrize("stream,batch", TABLE_STREAMS)
def test_table_streams_equal_the_batch_on_files_and_folders(spark, tmp_path, stream, batch):
    """Each stream over tables that are single files, over folders of shuffled files, and over one file a batch."""
    from proofbox.plans import all_queries
    from proofbox.sources.tables import read_table

    sf, q = "/root/testdata/sf0.001", all_queries()
    want = q[batch](spark, sf)
    got = q[stream](spark, sf)  # single files
    assert _same(got.select(want.columns), want)
    for name in ("lineitem", "orders", "part", "events"):
        read_table(spark, sf, name).orderBy(F.rand(3)).repartition(4).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = q[stream](spark, str(tmp_path))
    assert _same(got.select(want.columns), want)


def test_table_stream_of_a_file_with_a_pattern_in_its_name(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "w"))
    part = next((tmp_path / "w").glob("part-*.parquet"))
    for name in ("a[1]{x}", "a1x"):
        (tmp_path / f"{name}.parquet").write_bytes(part.read_bytes())
    stream = sj.table_stream(spark, str(tmp_path), "a1x")
    assert sj.run_available(stream, "t-name").count() == 5


def test_stream_counts_one_file_a_batch(spark, tmp_path, monkeypatch):
    from proofbox.plans import all_queries
    from proofbox.sources.tables import read_table

    sf, q = "/root/testdata/sf0.001", all_queries()
    for name in ("lineitem", "orders", "part"):
        read_table(spark, sf, name).orderBy(F.rand(3)).repartition(4).write.parquet(str(tmp_path / f"{name}.parquet"))
    whole = sj.table_stream
    monkeypatch.setattr(sj, "table_stream", lambda spark, d, name, max_files=None: whole(spark, d, name, 1))
    for stream, batch in TABLE_STREAMS[3:]:
        got = q[stream](spark, str(tmp_path))
        assert _same(got, q[batch](spark, sf).select(got.columns)), stream


def _two_products(spark, days=60):
    """A panel with gaps, a product that starts late, and null temperatures."""
    rows = []
    for p, first in (("A", 0), ("B", 25)):
        for i in range(first, days):
            if i % 9 == 4:
                continue
            rows.append((dt.date(2024, 1, 1) + dt.timedelta(days=i), p, float(10 + i % 5), float(i % 3), float(10 + i % 5 + i % 3), float(10 + i % 5 - i % 3),
                         0.0, 0.0, "Rainy" if i % 4 == 0 else "Sunny", None if i % 11 == 0 else 10.0 + i % 6, 15.0, 5.0, 1, 1, 1, 1, 2, 0, 0))
    return spark.createDataFrame(rows, dl.DAILY_COLUMNS).withColumn("gross_sales", F.col("gross_sales").cast("decimal(18,2)"))


def _requests(spark, days=70):
    rows = [(f"{p}{i}", p, str(dt.date(2023, 12, 25) + dt.timedelta(days=i)), "Sunny" if i % 2 else "Rainy", 5.0 + i % 7) for p in ("A", "B", "Z") for i in range(days)]
    rows += [("bad1", "A", "2024-02-30", "Sunny", 1.0), ("bad2", "A", "01/02/2024", "Sunny", 1.0), ("bad3", "B", None, "Sunny", 1.0), ("far", "B", "2031-05-01", "Sunny", 1.0)]
    return spark.createDataFrame(rows, "request_id string, product string, target_date string, forecast_weather string, forecast_temp double")


def test_asof_days_are_the_last_before(spark):
    d = _two_products(spark)
    req = sv.valid_requests(_requests(spark))
    got = {(r["product"], r.date): r.asof for r in sv.asof_days(req, d).collect()}
    known = {}
    for r in d.select("product", "date").collect():
        known.setdefault(r["product"], []).append(r.date)
    keys = {(r["product"], r.date) for r in req.collect()}
    assert set(got) == keys
    for p, day in keys:
        assert got[p, day] == max((x for x in known.get(p, []) if x < day), default=None), (p, day)


def test_stream_answers_as_the_batch_does(spark, tmp_path):
    """Requests before, inside and after the history, of unknown products and with bad dates: answered, failed, rejected."""
    d, req = _two_products(spark), _requests(spark)
    batch = sv.forecast(req, d, *sj.STAND_INS)
    stream = sj.run_available(sj.stream_forecast(sj.landed_stream(req, "t-req"), d), "t-forecast")
    assert _same(stream.select(batch.columns), batch)
    labels = {r.confidence_label: r.n for r in batch.groupBy("confidence_label").agg(F.count("*").alias("n")).collect()}
    assert set(labels) == {"Failed", "Moderate (Fallback Gen)"} and sum(labels.values()) == req.count() - 3
    rejected = sj.run_available(sj.stream_rejected(sj.landed_stream(req, "t-rej")), "t-rejected")
    assert {r.request_id for r in rejected.collect()} == {"bad1", "bad2", "bad3"} and _same(rejected, sv.rejected_requests(req))


def test_fitted_pipelines_answer_batch_and_stream(spark):
    from proofbox.operators import features as ft
    from proofbox.operators import forecast as fc

    d, req = _two_products(spark), _requests(spark)
    f = ft.build_features(d).persist()
    predictors = []
    for target in ("sold_qty", "waste_qty"):
        predictors += [sv.model_predictor(fc.fit_primary(f, target, max_iter=3, depth=3)), sv.challenger_predictor(fc.fit_challenger(fc.sequence_samples(f, target)))]
    batch = sv.forecast(req, d, *predictors)
    rows = {r.request_id: r for r in batch.collect()}
    assert rows["Z40"].confidence_label == "Failed" and rows["A0"].confidence_label == "Failed"
    assert rows["A69"].predicted_sold_qty > 0 and rows["A69"].sold_strategy not in ("fallback_zero", "fallback_primary_xgb")
    assert rows["A15"].sold_strategy == "fallback_primary_xgb"  # fewer than 14 days before it: no sequence
    stream = sj.run_available(sj.stream_forecast(sj.landed_stream(req, "t-fit"), d, predictors), "t-fitted")
    assert _same(stream.select(batch.columns), batch)


def test_comparing_fitted_answers_plans_in_little_memory(spark):
    """compared in one plan with the stream's, the batch's answers took 4,610 MB of the driver's allocations here."""
    from proofbox.operators import features as ft
    from proofbox.operators import forecast as fc
    from proofbox.plans.forecast_queries import answers_compared

    d, req = _two_products(spark), _requests(spark)
    f = ft.build_features(d).persist()
    pair = [sv.model_predictor(fc.fit_primary(f, "sold_qty", max_iter=1, depth=1)), sv.challenger_predictor(fc.fit_challenger(fc.sequence_samples(f, "sold_qty")))]
    batch = sv.forecast(req, d, *pair, *pair)
    stream = spark.createDataFrame(batch.collect(), batch.schema)
    threads, me = spark._jvm.java.lang.management.ManagementFactory.getThreadMXBean(), spark._jvm.java.lang.Thread.currentThread().getId()
    before = threads.getThreadAllocatedBytes(me)
    compared = answers_compared(batch, stream)
    compared._jdf.queryExecution().executedPlan()
    assert threads.getThreadAllocatedBytes(me) - before < 1_500 << 20
    rows = compared.collect()
    assert len(rows) == batch.count() and all(r.fits and r.stream_equal for r in rows) and {r.answered for r in rows} == {True, False}


def test_points_truncate_toward_zero(spark):
    from proofbox.functions.exprs import points_for

    rows = spark.createDataFrame([(-20.0,), (20.0,), (0.0,), (100.0,)], "x double").select(points_for("x").alias("p")).collect()
    assert [r.p for r in rows] == [0, 0, 0, 3]
