"""Registered queries: splits, folds, samples, scaling, metrics and backtests.

The SQL-checked backtest uses the same stand-in forecasts as the ensemble
queries (previous-7-row mean as primary, same-weekday mean of 4 lags as
challenger); the fitted models go through the same operators, and SQL checks
what holds of any forecaster's answers (windows, rows, truth, no negative value).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofbox.operators import forecast as fc
from proofbox.operators import serving as sv
from proofbox.plans import decide_queries
from proofbox.plans.common import round_doubles
from proofbox.plans.ledger_queries import daily, daily_once, features, features_sql
from proofbox.plans.sql_fixtures import DAILY_CTE, LEDGER_CTES, with_ctes
from proofbox.session import checkpointed, scratch_path
from proofbox.sources import fixtures as fx
from proofbox.streaming import jobs as sj

N_SPLITS, WINDOW = 3, 14


def q_fold_windows(spark, d):
    return fc.fold_windows(daily(spark, d), N_SPLITS, WINDOW)


def q_fold_windows_oldest_first(spark, d):
    return fc.fold_windows(daily(spark, d), N_SPLITS, WINDOW, newest_first=False)


def q_fold_panel(spark, d):
    return fc.assign_folds(daily_once(spark, d), N_SPLITS, WINDOW).select("fold", "product", "date", "sold_qty", "waste_qty")


def q_temporal_split(spark, d):
    dd = daily_once(spark, d)
    train, val = fc.temporal_split(dd)
    both = train.withColumn("split", F.lit("train")).unionByName(val.withColumn("split", F.lit("validation")))
    return both.groupBy("product", "split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


def q_panel_dates(spark, d):
    dates, _ = fc.panel_keys(daily(spark, d))
    return dates


def q_category_index(spark, d):
    dd = daily_once(spark, d)
    p = fc.fit_index(dd, "product").select(F.lit("product").alias("kind"), F.col("product").alias("value"), F.col("product_idx").alias("idx"))
    w = fc.fit_index(dd, "weather").select(F.lit("weather").alias("kind"), F.col("weather").alias("value"), F.col("weather_idx").alias("idx"))
    return p.unionByName(w)


def q_scaler_stats(spark, d):
    f = features(spark, d, once=True)
    train, _ = fc.temporal_split(f)
    return round_doubles(fc.fit_scaler(train, fc.HISTORY_COLUMNS))


def q_sequence_samples(spark, d):
    """14-row histories; summarised per sample so the oracle can check them."""
    f = features(spark, d, once=True)
    idx = fc.fit_index(f, "product")
    s = fc.apply_index(fc.sequence_samples(f, "sold_qty", 14), idx, "product")
    flat = fc.flatten_history(s)
    return round_doubles(
        s.select(
            "product", "date", "product_idx", "target",
            F.size(flat).alias("n_values"),
            F.aggregate(F.transform("history", lambda r: r["sold_qty"]), F.lit(0.0), lambda a, x: a + x).alias("hist_sold_sum"),
            F.col("history")[0]["sold_qty"].alias("hist_first_sold"),
            F.col("history")[13]["temp_avg"].alias("hist_last_temp"),
            F.col("context.temp_avg").alias("ctx_temp"),
        )
    )


def q_context_samples(spark, d):
    """14-row sequence samples whose target day lies in a validation fold (history
    comes from the full panel, so no validation day is lost to a calendar-day cut)."""
    f = features(spark, d, once=True)
    s = fc.with_context(fc.sequence_samples(f, "sold_qty", 14), fc.fold_dates(f, N_SPLITS, WINDOW))
    return round_doubles(
        s.select(
            "fold", "product", "date", "target",
            F.aggregate(F.transform("history", lambda r: r["sold_qty"]), F.lit(0.0), lambda a, x: a + x).alias("hist_sold_sum"),
        )
    )


def _standin(col: str):
    @fc.no_fit
    def fn(train: DataFrame, val: DataFrame) -> DataFrame:
        return val.withColumn("pred", F.coalesce(F.col(col), F.lit(0.0)))

    return fn


def backtest_standins(spark, d) -> DataFrame:
    # every fold and target reads the panel: cut its lineage once in the shared checkpoint
    # folder (the daily-sized feature table, dates x products, independent of ledger volume)
    f = checkpointed(features(spark, d))
    out = []
    for q in ("sold", "waste"):
        out.append(fc.backtest(f, f"{q}_qty", _standin(f"{q}_rolling_mean_7"), _standin(f"{q}_same_dow_mean_4"), N_SPLITS, WINDOW))
    return out[0].unionByName(out[1])


def q_backtest_standins(spark, d):
    return round_doubles(backtest_standins(spark, d))


def q_backtest_report(spark, d):
    return round_doubles(fc.backtest_report(backtest_standins(spark, d)))


MODEL_SPLITS, MODEL_WINDOW = 2, 7
TARGETS = ("sold_qty", "waste_qty")


def _fitted_forecasters(panel: DataFrame, target: str):
    """Boosted trees with their own stop and the sequence model, as forecasters of the fold loop."""
    samples = checkpointed(fc.sequence_samples(panel, target, 14))

    def primary(train, val):
        return fc.predict_primary(fc.fit_primary_stopping(train, target), val, target)

    def challenger(train, val):
        tr = samples.join(train.select("product", "date"), ["product", "date"], "left_semi")
        va = samples.join(val.select("product", "date"), ["product", "date"], "left_semi")
        return fc.predict_challenger(fc.fit_challenger(tr), va)

    return primary, challenger


def backtest_models(panel: DataFrame, target: str) -> DataFrame:
    """I5 + I6 + I7: predictions of both fitted models for every validation row of every fold."""
    return fc.backtest_predictions(panel, target, *_fitted_forecasters(panel, target), n_splits=MODEL_SPLITS, window_days=MODEL_WINDOW)


def q_backtest_models(spark, d):
    """The fitted backtest of both targets: per fold its window, rows and truth, and what holds of any forecaster's
    answers (a prediction for every row, none below 0, the ensemble their mean, finite scores)."""
    # the panel is read by every fit; cut its lineage once in the shared checkpoint folder
    # (it is the daily-sized feature table: dates x products, independent of ledger volume)
    f = checkpointed(features(spark, d))
    out = None
    for target in TARGETS:
        p = checkpointed(backtest_models(f, target))
        facts = p.groupBy("fold").agg(
            F.min("val_start").alias("val_start"), F.max("val_end").alias("val_end"), F.count(F.lit(1)).alias("n_rows"), F.sum("__y").alias("truth"),
            F.count_if((F.col("xgb_pred") < 0) | (F.col("lstm_pred") < 0)).alias("n_negative"),
            F.count_if(F.abs(F.col("ensemble_pred") - (F.col("xgb_pred") + F.col("lstm_pred")) / 2) < 1e-9).alias("n_ensemble"),
        )
        scores = fc.backtest_scores(p, target)
        finite = [F.col(f"{m}_{k}").isNotNull() & (F.col(f"{m}_{k}") >= 0) & (F.col(f"{m}_{k}") < float("inf")) for m in fc.MODELS for k in ("mae", "wape")]
        scored = scores.select("fold", F.forall(F.array(*finite), lambda x: x).alias("scored"))
        one = facts.join(scored, "fold").select(F.lit(target).alias("target"), "*")
        out = one if out is None else out.unionByName(one)
    return round_doubles(out)


def _fitted(spark, panel: DataFrame) -> dict[str, str]:
    """Both models of both targets, fitted on the training side of the temporal split and saved; their paths."""
    train, _ = fc.temporal_split(panel)
    paths = {}
    for target in TARGETS:
        samples = fc.sequence_samples(panel, target, 14).join(train.select("product", "date"), ["product", "date"], "left_semi")
        for kind, model in (("primary", fc.fit_primary_stopping(train, target)), ("challenger", fc.fit_challenger(samples))):
            paths[f"{target}:{kind}"] = path = scratch_path(spark, f"models/{target}-{kind}-{uuid.uuid4().hex[:12]}")
            fc.save_model(model, path)
            paths[f"{target}:{kind}:live"] = model
    return paths


def q_model_reload(spark, d):
    """Fitted pipelines saved, reloaded and held against the live ones on the validation side: rows and equal predictions."""
    f = checkpointed(features(spark, d))
    _, val = fc.temporal_split(f)
    models = _fitted(spark, f)
    out = None
    for target in TARGETS:
        samples = fc.sequence_samples(f, target, 14).join(val.select("product", "date"), ["product", "date"], "left_semi")
        for kind, rows, predict in (("primary", val, lambda m, x, t=target: fc.predict_primary(m, x, t)), ("challenger", samples, fc.predict_challenger)):
            live, again = (predict(m, rows) for m in (models[f"{target}:{kind}:live"], fc.load_pipeline(models[f"{target}:{kind}"])))
            both = live.join(again.withColumnRenamed("pred", "again"), ["product", "date"])
            one = both.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("pred") == F.col("again")).alias("n_equal"), F.count_if(F.col("again") < 0).alias("n_negative"))
            one = one.select(F.lit(target).alias("target"), F.lit(kind).alias("model"), "*")
            out = one if out is None else out.unionByName(one)
    return out


def answers_compared(batch: DataFrame, stream: DataFrame) -> DataFrame:
    """Per request of ``batch``: whether it was answered, whether its quantities fit, and whether ``stream`` has the same answer.

    ``batch`` is landed first, as the stream's answers are: each of its columns that the comparison reads would otherwise
    carry the expressions of all four fitted pipelines once more, and planning them fills the driver's memory.
    """
    batch = checkpointed(batch)
    qty = ["predicted_sold_qty", "predicted_waste_qty", "recommended_made_qty"]
    same = stream.select("request_id", *[F.col(c).alias(f"s_{c}") for c in qty], F.col("confidence_label").alias("s_label"))
    equal = F.col("confidence_label") == F.col("s_label")
    for c in qty:
        equal = equal & (F.abs(F.col(c) - F.col(f"s_{c}")) < 1e-9)
    fits = (F.least(*qty) >= 0) & (F.abs(F.col(qty[2]) - F.col(qty[0]) - F.col(qty[1])) < 1e-9)
    joined = batch.join(same, "request_id", "left")
    return joined.select("request_id", "product", "target_date", (F.col("confidence_label") != "Failed").alias("answered"), fits.alias("fits"), F.coalesce(equal, F.lit(False)).alias("stream_equal"))


def q_forecast_fitted(spark, d):
    """I10 + J5 with fitted pipelines, reloaded: every request, by batch and by stream; what SQL can tell of the answers.

    Per request: whether it was answered, whether its quantities are none below 0 and the made quantity their sum, and whether
    the stream's answer is the batch's.
    """
    f = checkpointed(features(spark, d))
    dd = checkpointed(daily_once(spark, d))  # daily-sized too; the requests, the batch's states and the stream's states come from it
    models = _fitted(spark, f)
    load = {k: fc.load_pipeline(p) for k, p in models.items() if not k.endswith(":live")}
    predictors = [wrap(load[f"{t}:{kind}"]) for t in TARGETS for kind, wrap in (("primary", sv.model_predictor), ("challenger", sv.challenger_predictor))]
    batch = sv.forecast(fx.forecast_requests(dd), dd, *predictors)
    stream = sj.run_available(sj.stream_forecast(sj.landed_stream(fx.forecast_requests(dd), "requests"), dd, predictors), "forecast-fitted")
    return answers_compared(batch, stream)


QUERIES = {
    "fold_windows": q_fold_windows,
    "fold_windows_oldest_first": q_fold_windows_oldest_first,
    "fold_panel": q_fold_panel,
    "temporal_split": q_temporal_split,
    "panel_dates": q_panel_dates,
    "category_index": q_category_index,
    "scaler_stats": q_scaler_stats,
    "sequence_samples": q_sequence_samples,
    "context_samples": q_context_samples,
    "backtest_standins": q_backtest_standins,
    "backtest_report": q_backtest_report,
    "backtest_models": q_backtest_models,
    "model_reload": q_model_reload,
    "forecast_fitted": q_forecast_fitted,
}

# ------------------------------------------------------------------ oracle side

BASE = list(LEDGER_CTES) + [DAILY_CTE]
FOLD_CTE = (
    "fd",
    f"""select date, cast(floor((rn - 1) / {WINDOW}) as integer) as fold from (
  select date, row_number() over (order by date desc) as rn from (select distinct date from daily))
where rn <= {N_SPLITS * WINDOW}""",
)
FOLD_WIN_CTE = ("fw", "select fold, min(date) as val_start, max(date) as val_end, count(*) as n_dates from fd group by fold")


def _features_cte() -> tuple[str, str]:
    text = features_sql(rounded=False)
    # reuse the generated feature query as a sub-select over its own CTEs
    return ("feat", f"select * from ({text})")


def _backtest_sql() -> str:
    parts = []
    for q in ("sold", "waste"):
        parts.append(
            f"""select fd.fold, '{q}_qty' as target, f.{q}_qty as y,
  greatest(coalesce(f.{q}_rolling_mean_7, 0.0), 0.0) as xp, greatest(coalesce(f.{q}_same_dow_mean_4, 0.0), 0.0) as lp
from feat f join fd on f.date = fd.date"""
        )
    rows = ("bt_rows", " union all ".join(parts))
    m = []
    for name, col in (("xgb", "xp"), ("lstm", "lp"), ("ensemble", "(xp + lp) / 2.0")):
        m.append(f"avg(abs(y - {col})) as {name}_mae")
        m.append(f"case when sum(y) > 0 then sum(abs(y - {col})) / sum(y) else 0.0 end as {name}_wape")
    bt = ("bt", f"select fold, target, {', '.join(m)} from bt_rows group by fold, target")
    return BASE + [_features_cte(), FOLD_CTE, FOLD_WIN_CTE, rows, bt]


METRIC_COLS = [f"{m}_{k}" for m in ("xgb", "lstm", "ensemble") for k in ("mae", "wape")]


def _r(cols):
    return ", ".join(f"round({c}, 6) as {c}" for c in cols)


HIST = ["sold_qty", "waste_qty", "made_qty", "temp_avg", "dow_sin", "dow_cos", "month_sin", "month_cos"]
SEQ_W = "over (partition by product order by date rows between 14 preceding and 1 preceding)"

ORACLE = {
    "fold_windows": with_ctes(BASE + [FOLD_CTE, FOLD_WIN_CTE], "select fold, val_start, val_end, n_dates from fw"),
    "fold_windows_oldest_first": with_ctes(
        BASE + [FOLD_CTE, FOLD_WIN_CTE], f"select cast({N_SPLITS - 1} - fold as integer) as fold, val_start, val_end, n_dates from fw"
    ),
    "fold_panel": with_ctes(
        BASE + [FOLD_CTE], "select fd.fold, d.product, d.date, round(d.sold_qty, 6) as sold_qty, round(d.waste_qty, 6) as waste_qty from daily d join fd on d.date = fd.date"
    ),
    "temporal_split": with_ctes(
        BASE + [("cut", "select max(date) - interval 21 day as d from daily")],
        """select product, case when date < (select d from cut) then 'train' else 'validation' end as split,
  count(*) as n_rows, min(date) as first_date, max(date) as last_date from daily group by 1, 2""",
    ),
    "panel_dates": with_ctes(BASE, "select distinct date from daily"),
    "category_index": with_ctes(
        BASE,
        """select 'product' as kind, product as value, cast(dense_rank() over (order by product) as integer) as idx
  from (select distinct product from daily where product is not null)
union all
select 'weather' as kind, weather as value, cast(dense_rank() over (order by weather) as integer) as idx
  from (select distinct weather from daily where weather is not null)""",
    ),
    "scaler_stats": with_ctes(
        [_features_cte(), ("cut", "select max(date) - interval 21 day as d from feat")],
        "select "
        + ", ".join(
            f"round(avg({c}), 6) as {c}__mean, round(case when coalesce(stddev_pop({c}), 0) = 0 then 1.0 else stddev_pop({c}) end, 6) as {c}__std"
            for c in HIST
        )
        + " from feat where date < (select d from cut)",
    ),
    "sequence_samples": with_ctes(
        [
            _features_cte(),
            (
                "s",
                f"""select product, date, sold_qty as target, temp_avg as ctx_temp,
  count(*) {SEQ_W} as n, sum(sold_qty) {SEQ_W} as hist_sold_sum,
  first_value(sold_qty) {SEQ_W} as hist_first_sold, last_value(temp_avg) {SEQ_W} as hist_last_temp
from feat""",
            ),
        ],
        """select product, date, cast(dense_rank() over (order by product) as integer) as product_idx, round(target, 6) as target,
  cast(n * 8 as integer) as n_values, round(hist_sold_sum, 6) as hist_sold_sum, round(hist_first_sold, 6) as hist_first_sold,
  round(hist_last_temp, 6) as hist_last_temp, round(ctx_temp, 6) as ctx_temp
from s where n = 14""",
    ),
    "context_samples": with_ctes(
        [
            _features_cte(),
            ("daily", "select * from feat"),
            FOLD_CTE,
            ("s", f"""select product, date, sold_qty as target, count(*) {SEQ_W} as n, sum(sold_qty) {SEQ_W} as hist_sold_sum from feat"""),
        ],
        """select fd.fold, s.product, s.date, round(s.target, 6) as target, round(s.hist_sold_sum, 6) as hist_sold_sum
from s join fd on s.date = fd.date where s.n = 14""",
    ),
    "backtest_standins": with_ctes(
        _backtest_sql(),
        f"select bt.fold, {_r(METRIC_COLS)}, fw.val_start, fw.val_end, bt.target from bt join fw on bt.fold = fw.fold",
    ),
    "backtest_report": with_ctes(
        _backtest_sql()
        + [("rep", "select target, avg(xgb_wape) as x, avg(lstm_wape) as l, avg(ensemble_wape) as e from bt group by target")],
        """select target, round(x, 6) as xgb_mean_wape, round(l, 6) as lstm_mean_wape, round(e, 6) as ensemble_mean_wape,
  cast(case when e < x and e < l then 0.5 when l < x then 0.1 else 1.0 end as double) as weight_primary,
  cast(case when e < x and e < l then 0.5 when l < x then 0.9 else 0.0 end as double) as weight_challenger
from rep""",
    ),
}

_MODEL_FOLDS = f"""select date, cast(floor((rn - 1) / {MODEL_WINDOW}) as integer) as fold from (
  select date, row_number() over (order by date desc) as rn from (select distinct date from daily))
where rn <= {MODEL_SPLITS * MODEL_WINDOW}"""
ORACLE["backtest_models"] = with_ctes(
    BASE + [("mf", _MODEL_FOLDS)],
    " union all ".join(
        f"""select '{t}' as target, fold, min(date) as val_start, max(date) as val_end, count(*) as n_rows, round(sum({t}), 6) as truth,
  cast(0 as bigint) as n_negative, count(*) as n_ensemble, true as scored from (
    select d.date, d.product, {t}, fold, (select min(date) from mf m where m.fold = mf.fold) as s, (select max(date) from mf m where m.fold = mf.fold) as e
    from daily d join mf using (date)) group by fold""" for t in TARGETS
    ).replace("min(date) as val_start, max(date) as val_end", "min(s) as val_start, max(e) as val_end"),
)
ORACLE["model_reload"] = with_ctes(
    BASE + [("v", "select count(*) as n from daily where date >= (select max(date) from daily) - 21")],
    "select target, model, n as n_rows, n as n_equal, cast(0 as bigint) as n_negative from v, (select unnest(['sold_qty', 'waste_qty']) as target), (select unnest(['primary', 'challenger']) as model)",
)
ORACLE["forecast_fitted"] = with_ctes(
    BASE + [c for c in decide_queries._REQ_CTES if c[0] in ("req_raw", "req")],
    """select request_id, product, date as target_date, exists (select 1 from daily d where d.product = req.product and d.date < req.date) as answered,
  true as fits, true as stream_equal from req""",
)
