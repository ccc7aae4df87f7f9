"""Metrics, folds, backtest rules and the demand fit."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofbox.operators import demand as dm
from proofbox.operators import forecast as fc


def test_metrics_hand_values(spark):
    df = spark.createDataFrame([(10.0, 10.0), (20.0, 18.0), (30.0, 33.0)], "y double, p double")
    r = fc.metrics(df, "y", "p").first()
    assert abs(r.model_mae - 5 / 3) < 1e-9 and abs(r.model_wape - 5 / 60) < 1e-9
    df = spark.createDataFrame([(10.0, 5.0), (20.0, 25.0)], "y double, p double")
    r = fc.metrics(df, "y", "p").first()
    assert r.model_mae == 5.0 and abs(r.model_wape - 10 / 30) < 1e-9
    z = spark.createDataFrame([(0.0, 1.0)], "y double, p double")
    assert fc.metrics(z, "y", "p").first().model_wape == 0.0


def _panel(spark, days=90):
    rnd = random.Random(7)
    start = dt.date(2023, 1, 1)
    rows = [(start + dt.timedelta(days=i), "Croissant", float(rnd.randint(20, 80))) for i in range(days)]
    return spark.createDataFrame(rows, "date date, product string, sold_qty double")


def test_folds_do_not_overlap(spark):
    w = fc.fold_windows(_panel(spark), 2, 7).orderBy("fold").collect()
    assert len(w) == 2 and all(r.n_dates == 7 for r in w)
    assert w[0].val_start > w[1].val_end  # fold 0 is the newest window
    old = fc.fold_windows(_panel(spark), 2, 7, newest_first=False).orderBy("fold").collect()
    assert old[0].val_end < old[1].val_start


def test_too_few_dates_raises(spark):
    with pytest.raises(Exception, match="Insufficient dates"):
        fc.fold_windows(_panel(spark, 10), 2, 7).collect()


def test_temporal_split_default(spark):
    train, val = fc.temporal_split(_panel(spark))
    assert train.count() + val.count() == 90
    assert val.agg(F.min("date")).first()[0] == dt.date(2023, 3, 31) - dt.timedelta(days=21) + dt.timedelta(days=0)


def test_report_weights(spark):
    folds = spark.createDataFrame(
        [("sold_qty", 0.10, 0.30, 0.20), ("sold_qty", 0.12, 0.28, 0.22),
         ("waste_qty", 0.40, 0.20, 0.30), ("waste_qty", 0.42, 0.22, 0.30)],
        "target string, xgb_wape double, lstm_wape double, ensemble_wape double",
    )
    r = {x.target: x for x in fc.backtest_report(folds).collect()}
    assert (r["sold_qty"].weight_primary, r["sold_qty"].weight_challenger) == (1.0, 0.0)
    assert (r["waste_qty"].weight_primary, r["waste_qty"].weight_challenger) == (0.1, 0.9)


def test_backtest_with_standins(spark):
    p = _panel(spark).withColumn("prev", F.lag("sold_qty").over(__import__("pyspark.sql", fromlist=["Window"]).Window.orderBy("date")))

    @fc.no_fit
    def prev(train, val):
        return val.withColumn("pred", F.coalesce("prev", F.lit(0.0)))

    @fc.no_fit
    def const(train, val):
        return val.withColumn("pred", F.lit(50.0))

    out = fc.backtest(p, "sold_qty", prev, const, 2, 7).collect()
    assert len(out) == 2 and all(r.xgb_mae >= 0 for r in out)


def test_sequence_samples_shape(spark):
    rows = []
    start = dt.date(2023, 1, 1)
    for prod in ("A", "B"):
        for i in range(60):
            rows.append((start + dt.timedelta(days=i), prod, "Sunny", float(i), 1.0, float(i) + 1, 5.0, 0.1, 0.2, 0.3, 0.4))
    df = spark.createDataFrame(rows, "date date, product string, weather string, sold_qty double, waste_qty double, made_qty double, "
                               "temp_avg double, dow_sin double, dow_cos double, month_sin double, month_cos double")
    s = fc.sequence_samples(df, "sold_qty", 14)
    assert s.count() == 2 * (60 - 14)
    r = s.filter((F.col("product") == "A") & (F.col("date") == dt.date(2023, 1, 15))).first()
    assert len(r.history) == 14 and len(r.context) == 5 and r.target == 14.0
    assert [h.sold_qty for h in r.history] == [float(i) for i in range(14)]


def test_demand_fit_solves_normal_equations(spark):
    rnd = np.random.default_rng(3)
    rows = []
    start = dt.date(2024, 1, 1)
    for i in range(120):
        d = start + dt.timedelta(days=i)
        temp = float(rnd.integers(-5, 30))
        weather = "Rainy" if rnd.random() < 0.3 else "Sunny"
        qty = float(max(1, round(20 + 3 * (d.weekday() == 5) - 4 * (weather == "Rainy") + 0.3 * temp + rnd.normal(0, 2))))
        rows.append((d, "Bread", qty, weather, temp))
    df = spark.createDataFrame(rows, "date date, product string, qty double, weather string, temp double")
    fit = dm.fit_demand(df).first()
    # reference solution: centred minimum-norm least squares in numpy
    X = np.array([[1.0 * (r[0].weekday() == k) for k in range(7)] + [1.0 * ("Rain" in r[3]), r[4]] for r in rows])
    y = np.array([r[2] for r in rows])
    Xc, yc = X - X.mean(0), y - y.mean()
    coef = np.linalg.lstsq(Xc, yc, rcond=None)[0]
    intercept = y.mean() - X.mean(0) @ coef
    assert abs(fit.base_bias - round(intercept, 2)) <= 0.011
    for i, k in enumerate(dm.REGRESSORS):
        assert abs(fit.weights[k] - coef[i]) <= 0.006, k
    assert fit.fit_status == "ok"


def test_demand_fit_edge_cases(spark):
    rows = [(dt.date(2024, 1, 1), "Few", 5.0, "Sunny", 1.0), (dt.date(2024, 1, 2), "Few", 6.0, "Sunny", 2.0),
            (dt.date(2024, 1, 1), "NullTemp", 5.0, "Sunny", None), (dt.date(2024, 1, 2), "NullTemp", 7.0, "Sunny", 2.0),
            (dt.date(2024, 1, 3), "NullTemp", 9.0, "Sunny", 3.0), (dt.date(2024, 1, 1), "Single", 3.0, "Sunny", 1.0)]
    df = spark.createDataFrame(rows, "date date, product string, qty double, weather string, temp double")
    out = {r.product: r for r in dm.fit_demand(df).collect()}
    assert "Single" not in out  # fewer than two rows: skipped
    assert out["Few"].base_bias == 0.0 and out["Few"].weights == {}
    assert out["NullTemp"].fit_status == "fit_failed" and out["NullTemp"].base_bias == 7.0


def test_seasonality_and_scoring(spark):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), "Rye Bread", float(10 + (i % 7)), "Sunny", 10.0) for i in range(14)]
    df = spark.createDataFrame(rows, "date date, product string, qty double, weather string, temp double")
    s = dm.seasonality(df).collect()
    assert len(s) == 7 and {r.product for r in s} == {"RyeBread"}
    coeffs = spark.createDataFrame(
        [("Rye Bread", 10.0, {"day_Monday": 2.0, "is_rain": -1.5, "temp": 0.1}, 1.0, 12.0)],
        "product string, base_bias double, weights map<string,double>, waste_risk double, avg_made double",
    )
    products = spark.createDataFrame([("RyeBread",), ("Unknown",)], "product string")
    scen = spark.createDataFrame([("RyeBread", "Monday", "light rain", 30.0), ("Unknown", "Monday", "Sunny", 10.0)],
                                 "product string, day_name string, weather string, temp double")
    out = {r.product: r for r in dm.score_scenarios(products, coeffs, scen).collect()}
    r = out["RyeBread"]
    assert r.predicted == 10.0 + 2.0 - 1.5 + 3.0 and r.recommended == 14 and r.status == "Heat Spike" and r.color == "green"
    assert out["Unknown"].status == "No Data" and out["Unknown"].recommended == 0


def test_scaler_population_std_and_apply(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    stats = fc.fit_scaler(df, ["a", "b"])
    r = stats.first()
    assert r.a__mean == 2.0 and r.a__std == 1.0 and r.b__std == 1.0  # population std; constant column -> 1
    out = fc.apply_scaler(df, stats, ["a", "b"], suffix="_z").orderBy("a").collect()
    assert [x.a_z for x in out] == [-1.0, 1.0] and [x.b_z for x in out] == [0.0, 0.0]


def test_context_samples_keep_every_validation_day(spark):
    rows = []
    start = dt.date(2023, 1, 1)
    for i in range(40):
        if i == 30:
            continue  # a gap: calendar-day context would lose validation rows
        rows.append((start + dt.timedelta(days=i), "A", "Sunny", float(i), 0.0, float(i), 5.0, 0.1, 0.2, 0.3, 0.4))
    df = spark.createDataFrame(rows, "date date, product string, weather string, sold_qty double, waste_qty double, made_qty double, "
                               "temp_avg double, dow_sin double, dow_cos double, month_sin double, month_cos double")
    folds = fc.fold_dates(df, 1, 7)
    s = fc.with_context(fc.sequence_samples(df, "sold_qty", 14), folds)
    assert s.count() == 7


def test_boosted_trees_beat_the_moving_average_on_a_seeded_panel(spark):
    """SURVEY step 6: on a seeded synthetic panel, the fitted primary model's WAPE is
    below the stand-in's (weekend and rain effects are learnable, a 7-day mean is not)."""
    from proofbox.operators import daily as dl
    from proofbox.operators import features as ft
    from proofbox.sources.synthetic import synth_ledger

    f = ft.build_features(dl.daily_table(dl.clean_ledger(synth_ledger(spark, days=200, seed=3)))).checkpoint(eager=True)

    @fc.no_fit
    def moving_average(train, val):
        return val.withColumn("pred", F.coalesce("sold_rolling_mean_7", F.lit(0.0)))

    def trees(train, val):
        return fc.predict_primary(fc.fit_primary(train, "sold_qty", max_iter=15, depth=4), val, "sold_qty")

    out = fc.backtest(f, "sold_qty", trees, moving_average, 1, 14).collect()
    assert len(out) == 1 and out[0].xgb_wape < out[0].lstm_wape


def test_seasonality_nested_form(spark):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), "Bun", float(10 + (i % 7 == 0) * 7), "Sunny", 10.0) for i in range(14)]
    df = spark.createDataFrame(rows, "date date, product string, qty double, weather string, temp double")
    nested = dm.seasonality_nested(dm.seasonality(df)).first()
    assert nested.product == "Bun" and nested.base_avg == 11.0
    assert nested.factors["Monday"] == round(17 / 11, 2) and nested.factors["Tuesday"] == round(10 / 11, 2)
    assert len(nested.factors) == 7


def _lstsq(rows):
    """Centred minimum-norm least squares of qty on weekday dummies, rain and temperature."""
    x = np.array([[float(d.weekday() == i) for i in range(7)] + [float("Rain" in w or "Snow" in w), t] for d, _, _, w, t in rows])
    y = np.array([r[2] for r in rows])
    coef = np.linalg.lstsq(x - x.mean(0), y - y.mean(), rcond=1e-9)[0]
    return y.mean() - x.mean(0) @ coef, coef


def test_demand_fit_closed_form_at_every_rank(spark):
    """Rank 2, 1 and 0 of the rain/temperature system, few weekdays, one weekday: always the minimum-norm solution."""
    rnd = np.random.default_rng(9)
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=int(i))
    qty = lambda: float(rnd.integers(1, 60))
    rows = [(day(rnd.integers(0, 200)), "full", qty(), rnd.choice(["Rainy", "Sunny"]), float(rnd.integers(-5, 30))) for _ in range(90)]
    rows += [(day(rnd.integers(0, 200)), "dry", qty(), "Sunny", float(rnd.integers(-5, 30))) for _ in range(60)]
    rows += [(day(rnd.integers(0, 200)), "flat", qty(), rnd.choice(["Rainy", "Sunny"]), 11.5) for _ in range(60)]
    rows += [(d, "tied", qty(), w, 4.0 if w == "Snow" else 9.0) for d, w in ((day(i), rnd.choice(["Snow", "Sunny"])) for i in range(50))]
    rows += [(d, "by_day", qty(), "Rainy" if d.weekday() < 3 else "Sunny", float(d.weekday() * d.weekday())) for d in (day(i) for i in range(60))]
    rows += [(d, "rain_by_day", qty(), "Rainy" if d.weekday() < 3 else "Sunny", float(rnd.integers(0, 20))) for d in (day(i) for i in range(60))]
    rows += [(day(7 * i + i % 2), "two_days", qty(), rnd.choice(["Rainy", "Sunny"]), float(rnd.integers(0, 20))) for i in range(40)]
    rows += [(day(7 * i), "one_day", qty(), "Sunny", 3.0) for i in range(5)]
    rows += [(day(7 * i), "one_day_warm", qty(), "Sunny", float(i)) for i in range(5)]
    df = spark.createDataFrame([(d, p, q, str(w), t) for d, p, q, w, t in rows] + [(day(1), "full", -3.0, "Sunny", 1.0)], "date date, product string, qty double, weather string, temp double").repartition(6)
    out = {r["product"]: r for r in dm.fit_demand(df).collect()}
    for name in {r[1] for r in rows}:
        base, coef = _lstsq([r for r in rows if r[1] == name])
        assert out[name].fit_status == "ok" and abs(out[name].base_bias - base) <= 0.0051, name
        for k, c in zip(dm.REGRESSORS, coef):
            assert abs(out[name].weights[k] - c) <= 0.0051, (name, k)


def _sample_panel(spark, days=60, late_qty=0.0):
    rows = []
    start = dt.date(2023, 1, 1)
    for p in ("A", "B"):
        for i in range(days):
            qty = float(10 + i % 7 + (5 if p == "B" else 0)) + (late_qty if i >= 45 else 0.0)
            rows.append((start + dt.timedelta(days=i), p, "Sunny" if i % 3 else None, qty, 1.0, qty + 1, None if i % 5 == 0 else float(i % 9), 0.1 * (i % 7), 0.2, 0.3, 0.4))
    return spark.createDataFrame(rows, "date date, product string, weather string, sold_qty double, waste_qty double, made_qty double, "
                                 "temp_avg double, dow_sin double, dow_cos double, month_sin double, month_cos double")


def test_challenger_takes_nulls_and_learns_from_training_rows_alone(spark):
    cut = dt.date(2023, 2, 10)
    models, preds = [], []
    for late in (0.0, 1000.0):
        samples = fc.sequence_samples(_sample_panel(spark, late_qty=late), "sold_qty")
        models.append(fc.fit_challenger(samples.filter(F.col("date") < cut)))
        preds.append({(r["product"], r.date): r.pred for r in fc.predict_challenger(models[-1], samples.filter(F.col("date") < dt.date(2023, 2, 14))).collect()})
    # what comes after the cut has no say in the statistics, the ids or the weights
    a, b = (m.stages[-1] for m in models)
    assert list(a.coefficients) == list(b.coefficients) and a.intercept == b.intercept
    assert models[0].stages[0].getStatement() == models[1].stages[0].getStatement()
    assert preds[0] == preds[1] and all(p >= 0 and p == p for p in preds[0].values())
    unseen = fc.sequence_samples(_sample_panel(spark), "sold_qty").limit(3).withColumn("product", F.lit("new")).withColumn("weather", F.lit("Hail"))
    assert fc.predict_challenger(models[0], unseen).where("pred is null").count() == 0


def test_primary_stops_by_itself_and_ignores_what_it_must_not_see(spark):
    df = _sample_panel(spark, 80).withColumn("sold_lag_1", F.col("temp_avg"))
    model = fc.fit_primary_stopping(df, "sold_qty", max_iter=500, depth=3)
    trees = model.stages[-1].getNumTrees
    assert 1 <= trees < 500
    changed = df.withColumn("sold_qty", F.when(F.col("date") >= dt.date(2023, 3, 1), 500.0).otherwise(F.col("sold_qty")))
    means = [[list(map(dict, st.stats)) if hasattr(st, "stats") else None for st in fc.fit_primary_stopping(x, "sold_qty", stop_days=21, max_iter=2, depth=2).stages] for x in (df, changed)]
    assert str(means[0]) == str(means[1])  # the encoders never see the rows that decide when to stop


def test_many_products_do_not_widen_the_trees(spark):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i % 40), f"p{i % 300}", "Sunny", float(i % 17), float(i % 5)) for i in range(1200)]
    df = spark.createDataFrame(rows, "date date, product string, weather string, sold_qty double, sold_lag_1 double")
    model = fc.fit_primary(df, "sold_qty", max_iter=2, depth=2)
    assert model.stages[-1].getMaxBins() == 64
    out = fc.predict_primary(model, df.withColumn("product", F.lit("never seen")), "sold_qty")
    assert out.count() == 1200 and out.where("pred is null").count() == 0


def test_index_numbers_values_in_order_over_partitions(spark):
    values = [f"v{(i * 7919) % 1000:04d}" for i in range(1000)]
    df = spark.createDataFrame([(v,) for v in values + values[:50]] + [(None,)], "x string").repartition(7)
    for n in (1, 5, 40):
        got = {r.x: r.x_idx for r in fc.fit_index(df, "x", n).collect()}
        assert got == {v: i for i, v in enumerate(sorted(set(values)), 1)}
    assert fc.fit_index(df.where("x is null"), "x").collect() == []
