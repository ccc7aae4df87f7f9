"""Ensemble outcomes, recommendation and texts (hand-computed cases)."""

from pyspark.sql import functions as F

from proofbox.operators import decide as dc

CASES = [
    # target, primary, challenger, final, strategy, anomaly
    ("sold_qty", 50.0, None, 50.0, "fallback_primary_xgb", False),
    ("sold_qty", None, 60.0, 60.0, "fallback_challenger_lstm", False),
    ("sold_qty", -10.0, None, 0.0, "fallback_primary_xgb", False),
    ("sold_qty", None, None, 0.0, "fallback_zero", False),
    ("sold_qty", 100.0, 100.0, 100.0, "target_optimal_average", False),
    ("waste_qty", 100.0, 98.0, 98.2, "target_optimal_average", False),
    ("sold_qty", 100.0, 90.0, 98.0, "xgb_biased_blend", False),
    ("waste_qty", 100.0, 50.0, 100.0, "anomaly_fallback_primary", True),
]


def test_six_outcomes(spark):
    for target, p, c, final, strategy, anomaly in CASES:
        df = spark.createDataFrame([(p, c)], "p double, c double")
        r = df.select(*dc.ensemble_columns(target, "p", "c")).collect()[0]
        assert abs(r.final_prediction - final) < 1e-9, (target, p, c, r)
        assert r.selected_strategy == strategy and r.anomaly_flag == anomaly


def test_gap_ratio_value(spark):
    df = spark.createDataFrame([(100.0, 90.0)], "p double, c double")
    r = df.select(*dc.ensemble_columns("sold_qty", "p", "c")).collect()[0]
    assert abs(r.gap_ratio - 0.1) < 1e-12


def test_nan_prediction_is_clamped_to_zero(spark):
    df = spark.createDataFrame([(float("nan"), None)], "p double, c double")
    r = df.select(*dc.ensemble_columns("sold_qty", "p", "c")).collect()[0]
    assert r.final_prediction == 0.0 and r.selected_strategy == "fallback_primary_xgb"


def test_recommendation_total(spark):
    df = spark.createDataFrame([(150.0, 15.2)], "s double, w double")
    assert abs(df.select(dc.recommended_made("s", "w").alias("m")).first().m - 165.2) < 1e-9


def test_texts_and_failure(spark):
    df = spark.createDataFrame(
        [("Croissant", "2023-11-20", "Rainy", 12.5, 45.0, 5.0, 50.0, False, True),
         ("Bagel", "2023-11-20", "Sunny", 20.0, 2.5, 0.5, 3.0, True, False)],
        "product string, target_date string, forecast_weather string, forecast_temp double, predicted_sold_qty double, "
        "predicted_waste_qty double, recommended_made_qty double, anomaly_flag boolean, ok boolean",
    )
    rows = df.select(*dc.explain_columns(failed=~F.col("ok")), dc.prompt_text().alias("p")).collect()
    a, b = rows
    assert a.staff_explanation == ("For 2023-11-20, the system predicts we will sell 45 Croissants. "
                                   "Weather is expected to be Rainy (12.5°C).")
    assert a.production_note == "Please prepare 50 units." and a.risk_note == "Estimated buffer waste is 5 units."
    assert "Total Recommended to Make: 50.0" in a.p
    assert b.confidence_label == "Failed" and b.production_note == "Consult manager manually."


def _expected(target, p, c):
    """The decision table of the ensemble, written out directly for property checking."""
    import math

    def clip(x):
        if x is None:
            return None
        return 0.0 if math.isnan(x) else max(0.0, x)

    p, c = clip(p), clip(c)
    wp, wc = {"sold_qty": (1.0, 0.0), "waste_qty": (0.1, 0.9)}.get(target, (0.5, 0.5))
    if p is None and c is None:
        return 0.0, "fallback_zero", False
    if c is None:
        return p, "fallback_primary_xgb", False
    if p is None:
        return c, "fallback_challenger_lstm", False
    gap = 0.0 if p == 0 and c == 0 else abs(p - c) / max(abs(p), abs(c))
    if gap <= 0.05:
        return max(0.0, p * wp + c * wc), "target_optimal_average", False
    if gap <= 0.20:
        return max(0.0, p * 0.8 + c * 0.2), "xgb_biased_blend", False
    return p, "anomaly_fallback_primary", True


def test_ensemble_matches_decision_table_on_random_pairs(spark):
    import random

    rnd = random.Random(17)
    values = [None, float("nan"), 0.0, -3.0]
    rows = []
    for i in range(400):
        def draw():
            r = rnd.random()
            if r < 0.15:
                return rnd.choice(values)
            base = rnd.uniform(0, 200)
            return base
        p = draw()
        c = p * rnd.uniform(0.7, 1.3) if (p is not None and p == p and rnd.random() < 0.6) else draw()
        rows.append((i, rnd.choice(["sold_qty", "waste_qty", "made_qty"]), p, c))
    df = spark.createDataFrame(rows, "i int, target string, p double, c double")
    for target in ("sold_qty", "waste_qty", "made_qty"):
        got = df.filter(F.col("target") == target).select("i", "p", "c", *dc.ensemble_columns(target, "p", "c")).collect()
        for r in got:
            final, strategy, anomaly = _expected(target, r.p, r.c)
            assert r.selected_strategy == strategy and r.anomaly_flag == anomaly, (target, r.p, r.c, r)
            assert abs(r.final_prediction - final) < 1e-9
