"""Registered queries: ensemble, recommendation and explanation texts.

The two forecasts fed to the rule-based ensemble here are SQL-computable
stand-ins derived from the daily table: the previous-7-row mean as the
primary and the same-weekday mean of 4 lags as the challenger. They are test
inputs so the decision rules can be checked value-for-value; fitted models go
through the same operators in ``forecast_queries``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofbox.operators import decide as dc
from proofbox.operators import features as ft
from proofbox.operators import serving as sv
from proofbox.plans.common import round_doubles
from proofbox.plans.ledger_queries import daily
from proofbox.plans.sql_fixtures import DAILY_CTE, LEDGER_CTES, with_ctes
from proofbox.sources import fixtures as fx

ENSEMBLE_COLS = [
    "target_col", "primary_pred", "challenger_pred", "final_prediction", "gap_ratio",
    "anomaly_flag", "selected_strategy", "fallback_reason",
]


def stand_ins(spark, sf_dir) -> DataFrame:
    """Both stand-ins per (date, product): window outputs first (one Window operator),
    then the same-weekday mean as a projection over the named lags."""
    w = ft.series_window()
    d = daily(spark, sf_dir)
    stage1 = d.select(
        "date", "product", "weather", "temp_avg",
        *[F.avg(f"{q}_qty").over(w.rowsBetween(-7, -1)).alias(f"{q}_primary") for q in ("sold", "waste")],
        *[F.lag(f"{q}_qty", 7 * k).over(w).alias(f"__{q}_l{k}") for q in ("sold", "waste") for k in range(1, 5)],
    )
    return stage1.select(
        "date", "product", "weather", "temp_avg", "sold_primary", "waste_primary",
        *[ft.mean_present([f"__{q}_l{k}" for k in range(1, 5)]).alias(f"{q}_challenger") for q in ("sold", "waste")],
    )


def q_ensemble_sold(spark, sf_dir):
    return round_doubles(dc.ensemble(stand_ins(spark, sf_dir), "sold_qty", "sold_primary", "sold_challenger"))


def q_ensemble_waste(spark, sf_dir):
    return round_doubles(dc.ensemble(stand_ins(spark, sf_dir), "waste_qty", "waste_primary", "waste_challenger"))


def recommendation(spark, sf_dir) -> DataFrame:
    s = stand_ins(spark, sf_dir)
    return dc.decide(
        s, "sold_primary", "sold_challenger", "waste_primary", "waste_challenger", keep=("date", "product", "weather", "temp_avg")
    )


def q_recommendation(spark, sf_dir):
    return round_doubles(recommendation(spark, sf_dir).drop("weather", "temp_avg"))


def q_forecast_explain(spark, sf_dir):
    r = recommendation(spark, sf_dir).select(
        "product",
        F.col("date").alias("target_date"),
        F.col("weather").alias("forecast_weather"),
        F.col("temp_avg").alias("forecast_temp"),
        "predicted_sold_qty",
        "predicted_waste_qty",
        "recommended_made_qty",
        "anomaly_flag",
    )
    return r.select("product", "target_date", *dc.explain_columns(), dc.prompt_text().alias("prompt_text"))


QUERIES = {
    "ensemble_sold": q_ensemble_sold,
    "ensemble_waste": q_ensemble_waste,
    "recommendation": q_recommendation,
    "forecast_explain": q_forecast_explain,
}

# ------------------------------------------------------------------ oracle side

W = "partition by product order by date"


def _stand_in_cte():
    parts = []
    for q in ("sold", "waste"):
        parts.append(f"avg({q}_qty) over ({W} rows between 7 preceding and 1 preceding) as {q}_primary")
        lags = [f"lag({q}_qty, {7 * k}) over ({W})" for k in range(1, 5)]
        s = " + ".join(f"coalesce({x}, 0)" for x in lags)
        n = " + ".join(f"cast({x} is not null as integer)" for x in lags)
        parts.append(f"({s}) / nullif({n}, 0) as {q}_challenger")
    return ("si", f"select date, product, weather, temp_avg, {', '.join(parts)} from daily")


def _ens_cte(name: str, target: str, p: str, c: str, src: str = "si"):
    wp, wc = dc.DEFAULT_WEIGHTS.get(target, dc.OTHER_WEIGHTS)
    clip = lambda x: f"case when {x} is null then null when isnan({x}) then 0.0 else greatest({x}, 0.0) end"
    base = f"select *, {clip(p)} as pp, {clip(c)} as cc from {src}"
    gap = "case when pp = 0 and cc = 0 then 0.0 else abs(pp - cc) / greatest(abs(pp), abs(cc)) end"
    body = f"""select *,
  '{target}' as target_col,
  case when pp is null and cc is null then 0.0 when cc is null then pp when pp is null then cc
       when g <= {dc.AGREE_GAP} then greatest(pp * {wp} + cc * {wc}, 0.0)
       when g <= {dc.BLEND_GAP} then greatest(pp * {dc.BLEND_WEIGHTS[0]} + cc * {dc.BLEND_WEIGHTS[1]}, 0.0)
       else pp end as final_prediction,
  case when pp is not null and cc is not null then g else 0.0 end as gap_ratio,
  coalesce(pp is not null and cc is not null and g > {dc.BLEND_GAP}, false) as anomaly_flag,
  case when pp is null and cc is null then '{dc.S_ZERO}' when cc is null then '{dc.S_PRIMARY}'
       when pp is null then '{dc.S_CHALLENGER}' when g <= {dc.AGREE_GAP} then '{dc.S_AVERAGE}'
       when g <= {dc.BLEND_GAP} then '{dc.S_BLEND}' else '{dc.S_ANOMALY}' end as selected_strategy,
  case when pp is null and cc is null then '{dc.R_BOTH}' when cc is null then '{dc.R_CHALLENGER}'
       when pp is null then '{dc.R_PRIMARY}' when g > {dc.BLEND_GAP} then '{dc.R_GAP}' end as fallback_reason
from (select *, {gap} as g from ({base}))"""
    return (name, body)


def _ensemble_sql(target: str, q: str) -> str:
    ctes = list(LEDGER_CTES) + [DAILY_CTE, _stand_in_cte(), _ens_cte("e", target, f"{q}_primary", f"{q}_challenger")]
    return with_ctes(
        ctes,
        """select date, product, target_col, round(pp, 6) as primary_pred, round(cc, 6) as challenger_pred,
  round(final_prediction, 6) as final_prediction, round(gap_ratio, 6) as gap_ratio, anomaly_flag,
  selected_strategy, fallback_reason from e""",
    )


def _rec_ctes():
    return list(LEDGER_CTES) + [
        DAILY_CTE,
        _stand_in_cte(),
        _ens_cte("es", "sold_qty", "sold_primary", "sold_challenger"),
        (
            "es2",
            "select date, product, weather, temp_avg, waste_primary, waste_challenger, final_prediction as sold_final, "
            "anomaly_flag as sold_anom, gap_ratio as sold_gap, selected_strategy as sold_strategy from es",
        ),
        _ens_cte("ew", "waste_qty", "waste_primary", "waste_challenger", src="es2"),
        (
            "rec",
            """select date, product, weather, temp_avg, sold_final as predicted_sold_qty, final_prediction as predicted_waste_qty,
  greatest(coalesce(sold_final, 0.0) + coalesce(final_prediction, 0.0), 0.0) as recommended_made_qty,
  (sold_anom or anomaly_flag) as anomaly_flag, sold_gap as sold_gap_ratio, gap_ratio as waste_gap_ratio,
  sold_strategy, selected_strategy as waste_strategy from ew""",
        ),
    ]


def _fmt0(x: str) -> str:
    return f"cast(cast(round_even(cast({x} as decimal(38,10)), 0) as bigint) as varchar)"


def _fmt1(x: str) -> str:
    return f"cast(cast(round_even(cast({x} as decimal(38,10)), 1) as decimal(38,1)) as varchar)"


def _fmtf(x: str) -> str:
    return f"case when {x} = floor({x}) then concat(cast(cast(floor({x}) as bigint) as varchar), '.0') else cast({x} as varchar) end"


EXPLAIN_SELECT = f"""select product, date as target_date,
  concat('For ', cast(date as varchar), ', the system predicts we will sell ', {_fmt0('predicted_sold_qty')}, ' ', product,
         's. Weather is expected to be ', weather, ' (', {_fmtf('temp_avg')}, '°C).',
         case when anomaly_flag then '{dc.ANOMALY_NOTE}' else '' end) as staff_explanation,
  concat('Estimated buffer waste is ', {_fmt0('predicted_waste_qty')}, ' units.') as risk_note,
  '{dc.FALLBACK_LABEL}' as confidence_label,
  concat('Please prepare ', {_fmt0('recommended_made_qty')}, ' units.') as production_note,
  concat('Product: ', product, chr(10), 'Target Date: ', cast(date as varchar), chr(10), chr(10),
         'Weather Forecast: ', weather, chr(10), 'Temperature: ', {_fmtf('temp_avg')}, '°C', chr(10), chr(10),
         'Predicted Demand (Sold): ', {_fmt1('predicted_sold_qty')}, chr(10),
         'Predicted Waste (Leftovers): ', {_fmt1('predicted_waste_qty')}, chr(10),
         'Total Recommended to Make: ', {_fmt1('recommended_made_qty')}, chr(10), chr(10),
         'System Anomalies: ', case when anomaly_flag then 'YES. The prediction tracking systems detected unstable pattern divergence today.'
                                    else 'None detected.' end, chr(10), 'Relying on standard historical averages.') as prompt_text
from rec"""

ORACLE = {
    "ensemble_sold": _ensemble_sql("sold_qty", "sold"),
    "ensemble_waste": _ensemble_sql("waste_qty", "waste"),
    "recommendation": with_ctes(
        _rec_ctes(),
        """select date, product, round(predicted_sold_qty, 6) as predicted_sold_qty,
  round(predicted_waste_qty, 6) as predicted_waste_qty, round(recommended_made_qty, 6) as recommended_made_qty,
  anomaly_flag, round(sold_gap_ratio, 6) as sold_gap_ratio, round(waste_gap_ratio, 6) as waste_gap_ratio,
  sold_strategy, waste_strategy from rec""",
    ),
    "forecast_explain": with_ctes(_rec_ctes(), EXPLAIN_SELECT),
}


# ------------------------------------------------------------------ batch forecast



def q_forecast_requests(spark, sf_dir):
    """I10 with the stand-in forecasters: requests after, inside and before the panel, and of a product it does not know."""
    from proofbox.plans.ledger_queries import daily_once
    from proofbox.streaming.jobs import STAND_INS

    d = daily_once(spark, sf_dir)
    return round_doubles(sv.forecast(fx.forecast_requests(d), d, *STAND_INS).drop("prompt_text"))


def q_rejected_requests(spark, sf_dir):
    """The requests that are not answered, with the reason."""
    return sv.rejected_requests(fx.forecast_requests(daily(spark, sf_dir)))


QUERIES["forecast_requests"] = q_forecast_requests
QUERIES["rejected_requests"] = q_rejected_requests

_H = "partition by product order by date"
_REQ_CTES = [
    (
        "hstate",
        f"""select product, date,
  avg(sold_qty) over ({_H} rows between 6 preceding and current row) as sp,
  avg(waste_qty) over ({_H} rows between 6 preceding and current row) as wp,
  """
        + ",\n  ".join(
            "("
            + " + ".join(f"coalesce(lag({q}_qty, {7 * k - 1}) over ({_H}), 0)" for k in range(1, 5))
            + ") / nullif("
            + " + ".join(f"cast(lag({q}_qty, {7 * k - 1}) over ({_H}) is not null as integer)" for k in range(1, 5))
            + f", 0) as {q[0]}c"
            for q in ("sold", "waste")
        )
        + "\nfrom daily",
    ),
    (
        "req_raw",
        """select product as of_product, tag, d, (d - date '1995-01-01') as dayno,
  case when tag = 'unknown' then product || ' (gone)' else product end as product,
  case when tag = 'format' then strftime(d, '%Y/%m/%d') when tag = 'no_day' then '2001-02-30' else strftime(d, '%Y-%m-%d') end as target_date
from (
  select product, strftime(d, '%Y-%m-%d') as tag, d
  from (select distinct product from daily), (select cast((select max(date) from daily) + cast(k as integer) as date) as d from range(1, 8) r(k))
  union all select product, 'inside', cast(min(date) + 10 as date) from daily group by product
  union all select product, 'before', cast(min(date) - 1 as date) from daily group by product
  union all select product, unnest(['unknown', 'format', 'no_day']), cast((select max(date) from daily) + 1 as date) from (select distinct product from daily)
)""",
    ),
    (
        "req",
        """select of_product || ':' || tag as request_id, product, d as date,
  case when t < 0 then 'Snow' when dayno % 10 < 3 then 'Rainy' when dayno % 10 < 6 then 'Cloudy' else 'Sunny' end as weather,
  t as temp_avg
from (select *, cast(((dayno * 7) % 41) - 8 + 0.5 * (dayno % 3) as double) as t from req_raw) where tag not in ('format', 'no_day')""",
    ),
    (
        "req_state",
        """select r.*, h.sp as sold_primary, h.sc as sold_challenger, h.wp as waste_primary, h.wc as waste_challenger,
  h.product is not null as has_history
from req r left join (
  select r2.request_id, arg_max(h2.date, h2.date) as hd from req r2 join hstate h2 on r2.product = h2.product and h2.date < r2.date
  group by r2.request_id) m on r.request_id = m.request_id
left join hstate h on h.product = r.product and h.date = m.hd""",
    ),
]


def _forecast_requests_sql() -> str:
    ctes = list(LEDGER_CTES) + [DAILY_CTE] + _REQ_CTES + [
        _ens_cte("es", "sold_qty", "sold_primary", "sold_challenger", src="req_state"),
        (
            "es2",
            "select request_id, product, date, weather, temp_avg, has_history, waste_primary, waste_challenger, "
            "final_prediction as sold_final, anomaly_flag as sold_anom, gap_ratio as sold_gap, selected_strategy as sold_strategy from es",
        ),
        _ens_cte("ew", "waste_qty", "waste_primary", "waste_challenger", src="es2"),
        (
            "rec",
            """select request_id, product, date, weather, temp_avg, sold_final as predicted_sold_qty, final_prediction as predicted_waste_qty,
  greatest(coalesce(sold_final, 0.0) + coalesce(final_prediction, 0.0), 0.0) as recommended_made_qty,
  (sold_anom or anomaly_flag) as anomaly_flag, sold_strategy, selected_strategy as waste_strategy, has_history from ew""",
        ),
    ]
    sel = EXPLAIN_SELECT.split(" as prompt_text")[0]
    sel = sel.rsplit(",\n  concat('Product: '", 1)[0]
    sel = sel.replace("select product, date as target_date,", "select request_id, product, date as target_date, weather as forecast_weather, "
                      "round(temp_avg, 6) as forecast_temp, round(predicted_sold_qty, 6) as predicted_sold_qty, "
                      "round(predicted_waste_qty, 6) as predicted_waste_qty, round(recommended_made_qty, 6) as recommended_made_qty, "
                      "anomaly_flag, sold_strategy, waste_strategy,")
    failed = ", ".join(f"case when has_history then {k} else '{text}' end as {k}" for k, text in dc.FAILED_TEXTS.items())
    answered = sel.replace("select request_id,", "select request_id, has_history,") + "\nfrom rec"
    return with_ctes(ctes, f"select * exclude (has_history, {', '.join(dc.FAILED_TEXTS)}), {failed} from ({answered})")


ORACLE["forecast_requests"] = _forecast_requests_sql()
ORACLE["rejected_requests"] = with_ctes(
    list(LEDGER_CTES) + [DAILY_CTE, next(c for c in _REQ_CTES if c[0] == "req_raw")],
    """select of_product || ':' || tag as request_id, product, target_date, 'Invalid target_date format: ' || target_date as error_message
from req_raw where tag in ('format', 'no_day')""",
)
