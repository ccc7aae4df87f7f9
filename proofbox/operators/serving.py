"""Batch forecast for a table of requests (I10, with B19 and I11).

A request is (request_id, product, target_date text, forecast_weather,
forecast_temp). Its features are what the feature build would give a new row
appended after the product's last observed day BEFORE the target date. Rather
than copying history per request, every history row h carries the "next-day
state" (the same window features with frames shifted by one row, so they end
at h instead of before it), and each request picks up the state of the last
history row before its date with an as-of lookup (``asof_days``): over the distinct
(product, date) pairs asked for, inside months, with the last day of the earlier months carried in; the requests
themselves only meet the result in equi-joins, so no window holds the requests of a product.
Fitted pipelines answer in the same frame: ``PipelineModel.transform`` adds a prediction column, in batch and in a stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofbox.functions.exprs import safe_div, valid_iso_date
from proofbox.operators import decide as dc
from proofbox.operators.features import (
    LAGS, QTY, ROLL_WINDOWS, SAME_DOW_WEEKS, calendar_columns, mean_present, pop_std_present, series_window,
)
from proofbox.operators.forecast import HISTORY_COLUMNS


CALENDAR = ("dow_sin", "dow_cos", "month_sin", "month_cos", "day_of_week", "month", "day_of_month", "week_of_year", "is_weekend")


def _lag_or_self(col: Column | str, n: int, w) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c if n == 0 else F.lag(c, n).over(w)


def next_day_state(daily: DataFrame) -> DataFrame:
    """Per history row: the window features of a row that would follow it."""
    w = series_window()
    st = safe_div("sold_qty", "made_qty")
    wr = safe_div("waste_qty", "made_qty")
    fields = []
    for n in LAGS:
        for q in QTY:
            fields.append(_lag_or_self(f"{q}_qty", n - 1, w).alias(f"{q}_lag_{n}"))
    for n in ROLL_WINDOWS:
        for q in QTY:
            fields.append(F.avg(f"{q}_qty").over(w.rowsBetween(-(n - 1), 0)).alias(f"{q}_rolling_mean_{n}"))
    for q in QTY:
        fields.append(F.stddev_samp(f"{q}_qty").over(w.rowsBetween(-6, 0)).alias(f"{q}_rolling_std_7"))
    # the newest rows themselves, for sequence models
    fields.append(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in HISTORY_COLUMNS])).over(w.rowsBetween(-13, 0)).alias("recent"))
    dow_lags = [_lag_or_self(f"{q}_qty", 7 * k - 1, w).alias(f"__{q}_d{k}") for q in QTY for k in range(1, 9)]
    fields += [
        st.alias("sell_through_rate_lag_1"), wr.alias("waste_rate_lag_1"),
        F.lag(st, 6).over(w).alias("sell_through_rate_lag_7"), F.lag(wr, 6).over(w).alias("waste_rate_lag_7"),
        F.avg(st).over(w.rowsBetween(-6, 0)).alias("sell_through_rate_rolling_mean_7"),
        F.avg(wr).over(w.rowsBetween(-6, 0)).alias("waste_rate_rolling_mean_7"),
        F.avg(st).over(w.rowsBetween(-27, 0)).alias("sell_through_rate_rolling_mean_28"),
        F.avg(wr).over(w.rowsBetween(-27, 0)).alias("waste_rate_rolling_mean_28"),
        F.col("temp_avg").alias("temp_prev"),
        F.avg("temp_avg").over(w.rowsBetween(-6, 0)).alias("temp_prev_mean_7"),
    ]
    # stage 1: every window output as a named column (one Window operator)
    dated = daily.drop(*[c for c in CALENDAR if c in daily.columns]).select("*", *calendar_columns("date"))
    stage1 = dated.select("product", "date", *fields, *dow_lags)
    # stage 2: same-weekday statistics as a projection over the named lags
    stats = []
    for k in SAME_DOW_WEEKS:
        for q in QTY:
            stats.append(mean_present([f"__{q}_d{i}" for i in range(1, k + 1)]).alias(f"{q}_same_dow_mean_{k}"))
    for q in QTY:
        stats.append(pop_std_present([f"__{q}_d{i}" for i in range(1, 9)]).alias(f"{q}_same_dow_std_8"))
    names = [c for c in stage1.columns if c not in ("product", "date") and not c.startswith("__")]
    stage2 = stage1.select("product", "date", *names, *stats)
    return stage2.select("product", "date", F.struct(*[c for c in stage2.columns if c not in ("product", "date")]).alias("state"))


def asof_days(keys: DataFrame, hist: DataFrame, bucket: str = "month") -> DataFrame:
    """(product, date, asof): for each distinct (product, date) of ``keys`` the last date of ``hist`` before it, if any.

    Inside a (product, month) a window over dates, history and asked ones, none of them twice; over a product's months
    a window with one row each carries the last history date on.
    """
    marks = hist.select("product", "date").distinct().withColumn("h", F.lit(True))
    asked = keys.select("product", "date").distinct().withColumn("h", F.lit(False))
    u = marks.unionByName(asked).withColumn("bucket", F.trunc("date", bucket))
    is_h = F.when(F.col("h"), F.col("date"))
    # a history row of the asked date itself does not count: asked dates sort first
    inside = Window.partitionBy("product", "bucket").orderBy("date", "h").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("product").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = u.groupBy("product", "bucket").agg(F.max(is_h).alias("last")).withColumn("carried", F.max("last").over(earlier)).drop("last")
    found = u.withColumn("in_bucket", F.max(is_h).over(inside)).where(~F.col("h"))
    return found.join(carried, ["product", "bucket"]).select("product", "date", F.coalesce("in_bucket", "carried").alias("asof"))


def state_days(state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stream's side of the as-of lookup, so that a stream of requests only meets it in equi-joins.

    (product, date, prev): the state that holds on each calendar day from a product's second day to its last; and
    (product, last, latest): its last state, which holds on all days after ``last``.
    """
    w = Window.partitionBy("product").orderBy("date")
    spans = state.withColumn("next", F.lead("date").over(w))
    inside = spans.where(F.col("next").isNotNull()).select("product", F.explode(F.sequence(F.date_add("date", 1), "next")).alias("date"), F.col("state").alias("prev"))
    return inside, spans.where(F.col("next").isNull()).select("product", F.col("date").alias("last"), F.col("state").alias("latest"))


def valid_requests(requests: DataFrame) -> DataFrame:
    """Requests with a valid date, typed."""
    return requests.filter(valid_iso_date("target_date")).select(
        "request_id", "product", F.to_date("target_date", "yyyy-MM-dd").alias("date"),
        "forecast_weather", F.col("forecast_temp").cast("double").alias("forecast_temp"),
    )


def features_of(asof: DataFrame) -> DataFrame:
    """Feature columns of requests with their as-of state ``prev`` (null: no history)."""
    t = F.col("forecast_temp")
    diff = t - F.col("prev.temp_prev")
    return asof.select(
        "request_id", "product", "date", "forecast_weather", "forecast_temp",
        F.col("prev").isNotNull().alias("has_history"),
        *calendar_columns("date"),
        "prev.*",
        diff.alias("temp_avg_diff_1"),
        (t - F.col("prev.temp_prev_mean_7")).alias("temp_avg_vs_7d_mean"),
        F.coalesce(diff <= -5.0, F.lit(False)).cast("int").alias("is_cold_shock"),
        F.coalesce(diff >= 5.0, F.lit(False)).cast("int").alias("is_heat_shock"),
    ).withColumnRenamed("temp_prev", "temp_avg_lag_1").drop("temp_prev_mean_7")


def request_features(requests: DataFrame, daily: DataFrame) -> DataFrame:
    """Valid requests with their as-of features; ``has_history`` False when no
    history row precedes the target date. Invalid dates are excluded here
    (see ``rejected_requests``)."""
    req = valid_requests(requests)
    state = next_day_state(daily)
    days = asof_days(req, daily)
    states = days.join(state.select("product", F.col("date").alias("asof"), F.col("state").alias("prev")), ["product", "asof"]).select("product", "date", "prev")
    return features_of(req.join(states, ["product", "date"], "left"))


def rejected_requests(requests: DataFrame) -> DataFrame:
    """B19 side output: requests whose target date is not a valid yyyy-MM-dd date."""
    return requests.filter(~valid_iso_date("target_date")).select(
        "request_id", "product", "target_date",
        F.concat(F.lit("Invalid target_date format: "), F.coalesce(F.col("target_date"), F.lit("null"))).alias("error_message"),
    )


Predictor = Callable[[DataFrame], "Column | DataFrame"]


def model_predictor(model) -> Predictor:
    """Wrap a fitted primary pipeline (I5) as a request predictor: the frame with a column ``pred``.

    The request's own weather and temperature stand in for the day's; every
    other column the pipeline was trained on comes from the as-of features,
    and anything the request cannot know (e.g. the day's min/max temperature)
    is missing, encoded exactly as in training. No join: it also runs in a stream.
    """
    from pyspark.ml.feature import StringIndexerModel, VectorAssembler

    from proofbox.operators.forecast import MISSING

    asm = next(st for st in model.stages if isinstance(st, VectorAssembler))
    cats = [c for st in model.stages if isinstance(st, StringIndexerModel) for c in st.getInputCols()]
    nums = [c for c in asm.getInputCols() if not c.endswith("__mean")]

    def predict(f: DataFrame) -> DataFrame:
        g = f.withColumn("__row", F.struct(*f.columns)).withColumns({"weather": F.col("forecast_weather"), "temp_avg": F.col("forecast_temp")})
        num_cols = [
            F.coalesce((F.col(c) if c in g.columns else F.lit(None)).cast("double"), F.lit(MISSING)).alias(c) for c in nums
        ]
        cat_cols = [F.coalesce(F.col(c).cast("string"), F.lit("<unknown>")).alias(c) for c in cats]
        return model.transform(g.select("__row", *num_cols, *cat_cols)).select("__row.*", F.greatest(F.col("prediction"), F.lit(0.0)).alias("pred"))

    return predict


def challenger_predictor(model, seq_len: int = 14) -> Predictor:
    """Wrap a fitted challenger pipeline (I6): its sequence is the product's last ``seq_len`` days before the request; fewer days give no prediction."""
    from proofbox.operators.forecast import CONTEXT_COLUMNS

    def predict(f: DataFrame) -> DataFrame:
        context = F.struct(*[(F.col("forecast_temp") if c == "temp_avg" else F.col(c)).cast("double").alias(c) for c in CONTEXT_COLUMNS])
        rows = f.select(
            F.struct(*f.columns).alias("__row"), "product", F.col("forecast_weather").alias("weather"), F.coalesce("recent", F.array().cast(f.schema["recent"].dataType)).alias("history"),
            context.alias("context"),
        )
        known = F.size("history") == seq_len
        return model.transform(rows).select("__row.*", F.when(known, F.greatest(F.col("prediction"), F.lit(0.0))).alias("pred"))

    return predict


def forecast(requests: DataFrame, daily: DataFrame, sold_primary: Predictor, sold_challenger: Predictor,
             waste_primary: Predictor, waste_challenger: Predictor) -> DataFrame:
    """Request table -> both targets -> ensemble -> recommendation -> texts.

    A predictor maps the request-feature frame either to a Column (a stand-in
    read from the features) or to that frame with a column ``pred``, e.g. a
    fitted pipeline's output (``model_predictor``). Requests without prior history get null predictions and
    the fixed failure texts (confidence 'Failed').
    """
    return answer(request_features(requests, daily), sold_primary, sold_challenger, waste_primary, waste_challenger)


def answer(f: DataFrame, sold_primary: Predictor, sold_challenger: Predictor, waste_primary: Predictor, waste_challenger: Predictor) -> DataFrame:
    """Forecasts, decisions and texts for request features, in batch or in a stream."""
    has = F.col("has_history")
    keep = ["request_id", "product", "date", "forecast_weather", "forecast_temp", "has_history"]
    for name, fn in (("sp", sold_primary), ("sc", sold_challenger), ("wp", waste_primary), ("wc", waste_challenger)):
        out = fn(f)
        f = out.withColumnRenamed("pred", name) if isinstance(out, DataFrame) else f.withColumn(name, out)
    preds = f.select(*keep, *[F.when(has, F.col(k)).alias(k) for k in ("sp", "sc", "wp", "wc")])
    d = dc.decide(preds, "sp", "sc", "wp", "wc", keep=tuple(keep))
    d = d.withColumnRenamed("date", "target_date")
    return d.select(
        "request_id", "product", "target_date", "forecast_weather", "forecast_temp",
        "predicted_sold_qty", "predicted_waste_qty", "recommended_made_qty", "anomaly_flag",
        "sold_strategy", "waste_strategy",
        *dc.explain_columns(failed=~has),
    )
