"""Rule-based reconciliation of two forecasts, production quantity and texts.

I8 (ensemble), I9 (recommended made quantity), I11 (explanation columns),
I12 (prompt text). Everything is a ``case when`` over columns, so it runs in
the same codegen stage as whatever produced the forecasts.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofbox.functions.exprs import clip0, gap_ratio

# Per-target weights (primary, challenger) used when the models agree.
DEFAULT_WEIGHTS = {"sold_qty": (1.0, 0.0), "waste_qty": (0.1, 0.9)}
OTHER_WEIGHTS = (0.5, 0.5)
AGREE_GAP = 0.05
BLEND_GAP = 0.20
BLEND_WEIGHTS = (0.8, 0.2)

# Strategy names and fallback reasons.
S_ZERO = "fallback_zero"
S_PRIMARY = "fallback_primary_xgb"
S_CHALLENGER = "fallback_challenger_lstm"
S_AVERAGE = "target_optimal_average"
S_BLEND = "xgb_biased_blend"
S_ANOMALY = "anomaly_fallback_primary"
R_BOTH = "Both primary and challenger missing"
R_CHALLENGER = "Challenger (LSTM) missing or error"
R_PRIMARY = "Primary (XGB) missing or error"
R_GAP = "Model gap > 20%, falling back explicitly to primary XGBoost"


def _weights(target: str, weights: Mapping[str, tuple[float, float]] | None) -> tuple[float, float]:
    table = dict(DEFAULT_WEIGHTS if weights is None else weights)
    return table.get(target, OTHER_WEIGHTS)


def ensemble_columns(
    target: str, primary: Column | str, challenger: Column | str, weights: Mapping[str, tuple[float, float]] | None = None
) -> list[Column]:
    """I8 as columns: primary_pred, challenger_pred, final_prediction, gap_ratio,
    anomaly_flag, selected_strategy, fallback_reason (both inputs clamped at 0 first)."""
    p = clip0(primary)
    c = clip0(challenger)
    wp, wc = _weights(target, weights)
    gap = gap_ratio(p, c)
    both = p.isNotNull() & c.isNotNull()
    final = (
        F.when(p.isNull() & c.isNull(), F.lit(0.0))
        .when(c.isNull(), p)
        .when(p.isNull(), c)
        .when(gap <= AGREE_GAP, F.greatest(p * wp + c * wc, F.lit(0.0)))
        .when(gap <= BLEND_GAP, F.greatest(p * BLEND_WEIGHTS[0] + c * BLEND_WEIGHTS[1], F.lit(0.0)))
        .otherwise(p)
    )
    strategy = (
        F.when(p.isNull() & c.isNull(), S_ZERO)
        .when(c.isNull(), S_PRIMARY)
        .when(p.isNull(), S_CHALLENGER)
        .when(gap <= AGREE_GAP, S_AVERAGE)
        .when(gap <= BLEND_GAP, S_BLEND)
        .otherwise(S_ANOMALY)
    )
    reason = (
        F.when(p.isNull() & c.isNull(), R_BOTH)
        .when(c.isNull(), R_CHALLENGER)
        .when(p.isNull(), R_PRIMARY)
        .when(gap > BLEND_GAP, R_GAP)
    )
    return [
        F.lit(target).alias("target_col"),
        p.alias("primary_pred"),
        c.alias("challenger_pred"),
        final.alias("final_prediction"),
        F.when(both, gap).otherwise(F.lit(0.0)).alias("gap_ratio"),
        (both & (gap > BLEND_GAP)).alias("anomaly_flag"),
        strategy.alias("selected_strategy"),
        reason.alias("fallback_reason"),
    ]


def ensemble(df: DataFrame, target: str, primary: str, challenger: str, keep=("date", "product"), weights=None) -> DataFrame:
    return df.select(*keep, *ensemble_columns(target, primary, challenger, weights))


def ensemble_struct(target: str, primary: Column | str, challenger: Column | str, weights=None) -> Column:
    return F.struct(*ensemble_columns(target, primary, challenger, weights))


def recommended_made(sold_final: Column | str, waste_final: Column | str) -> Column:
    """max(0, sold + waste); a missing side counts as 0."""
    s = F.coalesce(F.col(sold_final) if isinstance(sold_final, str) else sold_final, F.lit(0.0))
    w = F.coalesce(F.col(waste_final) if isinstance(waste_final, str) else waste_final, F.lit(0.0))
    return F.greatest(s + w, F.lit(0.0))


def decide(df: DataFrame, sold_primary: str, sold_challenger: str, waste_primary: str, waste_challenger: str,
           keep=("date", "product"), weights=None) -> DataFrame:
    """Both targets reconciled side by side plus the production quantity (I8 + I9)."""
    sold = ensemble_struct("sold_qty", sold_primary, sold_challenger, weights)
    waste = ensemble_struct("waste_qty", waste_primary, waste_challenger, weights)
    out = df.select(*keep, sold.alias("sold"), waste.alias("waste"))
    return out.select(
        *keep,
        F.col("sold.final_prediction").alias("predicted_sold_qty"),
        F.col("waste.final_prediction").alias("predicted_waste_qty"),
        recommended_made("sold.final_prediction", "waste.final_prediction").alias("recommended_made_qty"),
        (F.col("sold.anomaly_flag") | F.col("waste.anomaly_flag")).alias("anomaly_flag"),
        F.col("sold.gap_ratio").alias("sold_gap_ratio"),
        F.col("waste.gap_ratio").alias("waste_gap_ratio"),
        F.col("sold.selected_strategy").alias("sold_strategy"),
        F.col("waste.selected_strategy").alias("waste_strategy"),
    )


# ------------------------------------------------------------------ texts

def fmt_fixed(x: Column | str, dp: int) -> Column:
    """Fixed-point text with half-even rounding, computed in decimals (engine-independent)."""
    c = F.col(x) if isinstance(x, str) else x
    r = F.bround(c.cast("decimal(38,10)"), dp)
    return (r.cast("bigint") if dp == 0 else r.cast(f"decimal(38,{dp})")).cast("string")


def fmt_float(x: Column | str) -> Column:
    """Plain text of a float as written with one decimal at least (12.5 -> '12.5', 20 -> '20.0')."""
    c = F.col(x) if isinstance(x, str) else x
    return F.when(c == F.floor(c), F.concat(F.floor(c).cast("bigint").cast("string"), F.lit(".0"))).otherwise(c.cast("string"))


# Fallback explanation templates and failure texts.
FAILED_TEXTS = {
    "staff_explanation": "System encountered operational failure preventing generation.",
    "risk_note": "Unknown.",
    "confidence_label": "Failed",
    "production_note": "Consult manager manually.",
}
ANOMALY_NOTE = " (Note: System anomaly flagged, numbers fall back to primary averages.)"
FALLBACK_LABEL = "Moderate (Fallback Gen)"


def explain_columns(failed: Column | None = None) -> list[Column]:
    """I11 over columns product, target_date, forecast_weather, forecast_temp,
    predicted_sold_qty, predicted_waste_qty, recommended_made_qty, anomaly_flag."""
    note = F.when(F.col("anomaly_flag"), F.lit(ANOMALY_NOTE)).otherwise(F.lit(""))
    texts = {
        "staff_explanation": F.concat(
            F.lit("For "), F.col("target_date").cast("string"), F.lit(", the system predicts we will sell "),
            fmt_fixed("predicted_sold_qty", 0), F.lit(" "), F.col("product"), F.lit("s. Weather is expected to be "),
            F.col("forecast_weather"), F.lit(" ("), fmt_float("forecast_temp"), F.lit("°C)."), note,
        ),
        "risk_note": F.concat(F.lit("Estimated buffer waste is "), fmt_fixed("predicted_waste_qty", 0), F.lit(" units.")),
        "confidence_label": F.lit(FALLBACK_LABEL),
        "production_note": F.concat(F.lit("Please prepare "), fmt_fixed("recommended_made_qty", 0), F.lit(" units.")),
    }
    if failed is None:
        return [v.alias(k) for k, v in texts.items()]
    return [F.when(failed, F.lit(FAILED_TEXTS[k])).otherwise(v).alias(k) for k, v in texts.items()]


def prompt_text(key_drivers: Column | None = None) -> Column:
    """The numbers block of the explanation prompt (one decimal, anomaly and driver text)."""
    anomaly = F.when(
        F.col("anomaly_flag"), F.lit("YES. The prediction tracking systems detected unstable pattern divergence today.")
    ).otherwise(F.lit("None detected."))
    drivers = (
        F.lit("Relying on standard historical averages.")
        if key_drivers is None
        else F.when(F.coalesce(key_drivers, F.lit("")) != "", F.concat(F.lit("Key indicators: "), key_drivers)).otherwise(
            F.lit("Relying on standard historical averages.")
        )
    )
    return F.concat(
        F.lit("Product: "), F.col("product"), F.lit("\nTarget Date: "), F.col("target_date").cast("string"),
        F.lit("\n\nWeather Forecast: "), F.col("forecast_weather"),
        F.lit("\nTemperature: "), fmt_float("forecast_temp"), F.lit("°C"),
        F.lit("\n\nPredicted Demand (Sold): "), fmt_fixed("predicted_sold_qty", 1),
        F.lit("\nPredicted Waste (Leftovers): "), fmt_fixed("predicted_waste_qty", 1),
        F.lit("\nTotal Recommended to Make: "), fmt_fixed("recommended_made_qty", 1),
        F.lit("\n\nSystem Anomalies: "), anomaly, F.lit("\n"), drivers,
    )
