"""Registered queries: legacy demand model, seasonality, waste statistics, scoring.

The scoring oracle needs SQL-computable coefficients, so ``standin_coefficients``
derives them by plain aggregation (mean, weekday and rain differences, the
simple temperature slope). The least-squares fit (D7) has its own SQL, the same
closed form; the tests hold it against ``numpy.linalg.lstsq``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofbox.functions.exprs import WEEKDAYS, rain_flag, weekday_name
from proofbox.operators import daily as dl
from proofbox.operators import demand as dm
from proofbox.plans.common import round_doubles
from proofbox.plans.ledger_queries import daily
from proofbox.plans.sql_fixtures import DAILY_CTE, LEDGER_CTES, RAW_LEDGER_CTES, with_ctes
from proofbox.sources import fixtures as fx


def legacy(spark, sf_dir) -> DataFrame:
    """Ledger lines in the legacy five-column form, dates as ISO text (as exported)."""
    lg = fx.ledger(spark, sf_dir).withColumn("date", F.date_format("date", "yyyy-MM-dd"))
    return dm.legacy_frame(lg)


def legacy_parsed(spark, sf_dir) -> DataFrame:
    """B4 on the exported text dates (strict compact format first, then the fallback list)."""
    return dm.parse_date_or_fallback(legacy(spark, sf_dir)).dropna(subset=["date"])


def legacy_typed(spark, sf_dir) -> DataFrame:
    """The same five legacy columns with the date kept typed (no text round trip)."""
    return dm.legacy_frame(fx.ledger(spark, sf_dir))


def legacy_mixed(spark, sf_dir) -> DataFrame:
    """The defect-carrying export: only compact-format dates survive the strict parse."""
    raw = dl.normalise_columns(fx.raw_ledger(spark, sf_dir))
    x = dm.legacy_frame(raw).withColumn("qty", F.coalesce(F.col("qty").try_cast("double"), F.lit(0.0)))
    return dl.drop_null_keys(dm.parse_date_or_fallback(x), ("date", "product"))


def q_seasonality_positions(spark, sf_dir):
    """A7 + B4 + D5: the export read by column POSITION (0, 1, 2, 4, 5 -> date, product,
    qty, weather, temp) as the legacy scripts do, then the strict-format parse."""
    raw = fx.raw_ledger(spark, sf_dir)
    x = dl.select_positions(raw, [0, 1, 2, 4, 5], ["date", "product", "qty", "weather", "temp"])
    x = x.withColumn("qty", F.coalesce(F.col("qty").try_cast("double"), F.lit(0.0)))
    x = dl.drop_null_keys(dm.parse_date_or_fallback(x), ("date", "product"))
    return round_doubles(dm.seasonality(x))


def q_seasonality(spark, sf_dir):
    return round_doubles(dm.seasonality(legacy_parsed(spark, sf_dir)))


def q_seasonality_mixed(spark, sf_dir):
    return round_doubles(dm.seasonality(legacy_mixed(spark, sf_dir)))


def q_global_means(spark, sf_dir):
    return round_doubles(dm.global_means(legacy_typed(spark, sf_dir)))


def q_weekday_means(spark, sf_dir):
    return round_doubles(dm.weekday_means(legacy_typed(spark, sf_dir)))


def q_waste_stats(spark, sf_dir):
    return round_doubles(dm.waste_stats(legacy_typed(spark, sf_dir)))


def q_health_report(spark, sf_dir):
    raw = dl.normalise_columns(fx.raw_ledger(spark, sf_dir))
    return dm.health_report(raw)


def q_health_examples(spark, sf_dir):
    raw = dl.normalise_columns(fx.raw_ledger(spark, sf_dir))
    return dm.health_examples(raw, order=("line_ord", "date", "product"))


def standin_coefficients(x: DataFrame) -> DataFrame:
    """Aggregation-only coefficients (test input for the scoring oracle)."""
    wd = F.weekday("date")
    rain = rain_flag(F.coalesce(F.col("weather"), F.lit("nan"))) == 1
    q = F.col("qty")
    pos = q > 0
    pq = F.when(pos, q)
    # one pass: positive-row statistics and the waste statistics together
    g = x.groupBy("product").agg(
        F.avg(pq).alias("m"),
        *[F.avg(F.when(pos & (wd == i), q)).alias(f"d{i}") for i in range(7)],
        F.avg(F.when(pos & rain, q)).alias("mr"),
        F.avg(F.when(pos & ~rain, q)).alias("mn"),
        F.regr_slope(pq, F.when(pos, F.col("temp"))).alias("slope"),
        F.count_if(pos).alias("n_pos"),
        F.sum(F.when(pos, q).otherwise(F.lit(0.0))).alias("total_sold"),
        F.sum(F.when(q < 0, -q).otherwise(F.lit(0.0))).alias("total_waste"),
        F.count(F.lit(1)).alias("row_count"),
    ).filter(F.col("n_pos") > 0)
    keys, vals = [], []
    for i, d in enumerate(WEEKDAYS):
        keys.append(F.lit(f"day_{d}"))
        vals.append(dm.bround_dec(F.col(f"d{i}") - F.col("m"), 2))
    keys += [F.lit("is_rain"), F.lit("temp")]
    vals += [dm.bround_dec(F.col("mr") - F.col("mn"), 2), dm.bround_dec("slope", 2)]
    weights = F.map_filter(F.map_from_arrays(F.array(*keys), F.array(*vals)), lambda k, v: v.isNotNull())
    has_waste = F.col("row_count") >= 2
    return g.select(
        "product",
        dm.bround_dec("m", 2).alias("base_bias"),
        weights.alias("weights"),
        F.when(has_waste, dm.bround_dec(F.col("total_waste") / F.col("row_count"), 1)).otherwise(F.lit(0.0)).alias("waste_risk"),
        F.when(has_waste, dm.bround_dec((F.col("total_sold") + F.col("total_waste")) / F.col("row_count"), 1))
        .otherwise(F.lit(0.0)).alias("avg_made"),
    )


def _flat_coeffs(c: DataFrame) -> DataFrame:
    return c.select(
        "product", "base_bias",
        *[F.coalesce(F.try_element_at("weights", F.lit(k)), F.lit(0.0)).alias(f"w_{k}") for k in dm.REGRESSORS],
        "waste_risk", "avg_made",
    )


def q_coefficients_json(spark, sf_dir):
    """A9 -> A8 round trip: keyed JSON lines written by Spark, parsed back."""
    text = dm.to_keyed_json(standin_coefficients(legacy_typed(spark, sf_dir)))
    return round_doubles(_flat_coeffs(dm.parse_coefficients(text)))


def _scenarios(spark, sf_dir) -> DataFrame:
    """One what-if scenario per observed (product, day): its weekday, weather and temperature."""
    d = daily(spark, sf_dir)
    return d.select("product", "date", weekday_name("date").alias("day_name"), "weather", F.col("temp_avg").alias("temp"))


SCORE_COLS = [
    "product", "date", "base_score", "day_effect", "rain_effect", "temp_effect", "predicted", "recommended",
    "status", "color", "waste_risk", "avg_made",
]


def q_score_scenarios(spark, sf_dir):
    """C5 + I2 + I3 + I4 with the aggregation-derived coefficients."""
    coeffs = standin_coefficients(legacy_typed(spark, sf_dir))
    scored = dm.score_scenarios(None, coeffs, _scenarios(spark, sf_dir))
    return round_doubles(scored.select(*SCORE_COLS))


def q_demand_fit(spark, sf_dir):
    """D7 + D6: least-squares coefficients and waste statistics per product."""
    return round_doubles(_flat_coeffs(dm.coefficients(dm.fit_demand(legacy_typed(spark, sf_dir)))))


def q_demand_scores(spark, sf_dir):
    """D7 -> I4: fitted coefficients scored on every observed day."""
    coeffs = dm.coefficients(dm.fit_demand(legacy_typed(spark, sf_dir)))
    return round_doubles(dm.score_scenarios(None, coeffs, _scenarios(spark, sf_dir)).select(*SCORE_COLS))


QUERIES = {
    "seasonality": q_seasonality,
    "seasonality_mixed": q_seasonality_mixed,
    "seasonality_positions": q_seasonality_positions,
    "global_means": q_global_means,
    "weekday_means": q_weekday_means,
    "waste_stats": q_waste_stats,
    "health_report": q_health_report,
    "health_examples": q_health_examples,
    "coefficients_json": q_coefficients_json,
    "score_scenarios": q_score_scenarios,
    "demand_fit": q_demand_fit,
    "demand_scores": q_demand_scores,
}

# ------------------------------------------------------------------ oracle side


def _bround(x: str, dp: int) -> str:
    return f"cast(round_even(cast({x} as decimal(38,12)), {dp}) as double)"


LEG = ("leg", "select date, product, qty, weather, temp_avg as temp from ledger")
MIXED = (
    "leg",
    """select strptime(raw_date, '%Y%m%d')::date as date, replace(product, ' ', '') as product,
  coalesce(qty, 0.0) as qty, weather, temp_avg as temp
from raw_ledger where try_strptime(raw_date, '%Y%m%d') is not null and product is not null""",
)


def _season_sql(leg_cte, base_ctes) -> str:
    ctes = list(base_ctes) + [
        leg_cte,
        ("gm", "select product, avg(qty) as base_avg from leg group by product having avg(qty) <> 0"),
        ("wm", "select product, cast(isodow(date) - 1 as integer) as day_num, avg(qty) as day_avg from leg group by 1, 2"),
        ("grid", "select product, base_avg, cast(unnest(range(0, 7)) as integer) as day_num from gm"),
    ]
    names = ", ".join(f"'{d}'" for d in WEEKDAYS)
    return with_ctes(
        ctes,
        f"""select g.product, g.day_num, [{names}][g.day_num + 1] as day_name,
  case when w.day_avg is null then 1.0 else round({_bround('w.day_avg / g.base_avg', 2)}, 6) end as factor,
  round({_bround('g.base_avg', 1)}, 6) as base_avg
from grid g left join wm w on g.product = w.product and g.day_num = w.day_num""",
    )


WASTE_SQL = """select product, sum(case when qty > 0 then qty else 0.0 end) as total_sold,
  sum(case when qty < 0 then -qty else 0.0 end) as total_waste,
  sum(case when qty > 0 then qty else 0.0 end) + sum(case when qty < 0 then -qty else 0.0 end) as total_made,
  count(*) as row_count
from leg group by product having count(*) >= 2"""

COEF_CTES = [
    ("ws0", WASTE_SQL),
    (
        "ws",
        f"""select *, {_bround('total_waste / row_count', 1)} as avg_waste,
  {_bround('total_made / row_count', 1)} as avg_made from ws0""",
    ),
    (
        "cg",
        "select product, avg(qty) as m, "
        + ", ".join(f"avg(case when isodow(date) = {i + 1} then qty end) as d{i}" for i in range(7))
        + ", avg(case when coalesce(weather, 'nan') like '%Rain%' or coalesce(weather, 'nan') like '%Snow%' then qty end) as mr"
        + ", avg(case when not (coalesce(weather, 'nan') like '%Rain%' or coalesce(weather, 'nan') like '%Snow%') then qty end) as mn"
        + ", regr_slope(qty, temp) as slope from leg where qty > 0 group by product",
    ),
    (
        "coef",
        f"select cg.product, {_bround('m', 2)} as base_bias, "
        + ", ".join(f"coalesce({_bround(f'd{i} - m', 2)}, 0.0) as w_day_{d}" for i, d in enumerate(WEEKDAYS))
        + f", coalesce({_bround('mr - mn', 2)}, 0.0) as w_is_rain, coalesce({_bround('slope', 2)}, 0.0) as w_temp"
        + ", coalesce(ws.avg_waste, 0.0) as waste_risk, coalesce(ws.avg_made, 0.0) as avg_made"
        + " from cg left join ws on cg.product = ws.product",
    ),
]


def _r(cols):
    return ", ".join(f"round({c}, 6) as {c}" for c in cols)


COEF_COLS = ["base_bias"] + [f"w_{k}" for k in dm.REGRESSORS] + ["waste_risk", "avg_made"]


def _fit_ctes() -> list[tuple[str, str]]:
    """D7 in SQL: within-weekday sums, the 2 x 2 system and its rank 1 and 0 forms."""
    rain = "case when coalesce(weather, 'nan') like '%Rain%' or coalesce(weather, 'nan') like '%Snow%' then 1.0 else 0.0 end"
    sums = {"sy": "qty", "sr": "rain", "st": "temp", "srt": "rain * temp", "stt": "temp * temp", "sry": "rain * qty", "sty": "temp * qty"}
    within = {"r_r": "sr - n * mr * mr", "r_t": "srt - n * mr * mt", "t_t": "stt - n * mt * mt", "r_y": "sry - n * mr * my", "t_y": "sty - n * mt * my"}
    moments = {"rr": ("mr", "mr"), "rt": ("mr", "mt"), "tt": ("mt", "mt"), "ry": ("mr", "my"), "ty": ("mt", "my")}
    eps = "1e-9"
    days = ", ".join(f"max(case when wd = {i} then {m} end) as {m}{i}" for i in range(7) for m in ("n", "my", "mr", "mt"))
    effects = ", ".join(f"case when n{i} > 0 then (my{i} - my) - b1 * (mr{i} - mr) - b2 * (mt{i} - mt) else 0.0 end as e{i}" for i in range(7))
    base = "sy / n - b1 * sr / n - b2 * st / n" + "".join(f" - coalesce(n{i}, 0) / n * e{i}" for i in range(7))
    few = "n <= 2"
    cols = [(f"w_day_{d}", f"e{i}") for i, d in enumerate(WEEKDAYS)] + [("w_is_rain", "b1"), ("w_temp", "b2")]
    return [
        ("fx", f"select product, cast(isodow(date) - 1 as integer) as wd, qty, temp, {rain} as rain from leg where date is not null"),
        (
            "f1",
            "select product, wd, count(*) as rows_, coalesce(sum(qty) filter (where qty > 0), 0.0) as sold, coalesce(sum(-qty) filter (where qty < 0), 0.0) as waste, "
            "count(*) filter (where qty > 0) as n, count(*) filter (where qty > 0 and temp is null) as n_null, "
            + ", ".join(f"coalesce(sum({e}) filter (where qty > 0), 0.0) as {k}" for k, e in sums.items()) + " from fx group by product, wd",
        ),
        ("f2", "select *, " + ", ".join(f"case when n > 0 then s{m} / n end as m{m}" for m in "yrt") + " from f1"),
        (
            "f3",
            "select product, sum(rows_) as rows_, sum(sold) as sold, sum(waste) as waste, sum(n) as n, sum(n_null) as n_null, sum(sy) as sy, sum(sr) as sr, sum(st) as st, sum(stt) as stt, "
            "count(*) filter (where n > 0) as k, " + ", ".join(f"coalesce(sum({e}) filter (where n > 0), 0.0) as {k}" for k, e in within.items()) + ", "
            + ", ".join(f"coalesce(sum({m}) filter (where n > 0), 0.0) as {m}" for m in ("my", "mr", "mt")) + ", "
            + ", ".join(f"coalesce(sum({x} * {y}) filter (where n > 0), 0.0) as p{k}" for k, (x, y) in moments.items()) + f", {days} from f2 group by product having sum(rows_) >= 2",
        ),
        (
            "f4",
            "select *, " + ", ".join(f"p{k} - {x} * {y} / greatest(k, 1) as {k}" for k, (x, y) in moments.items())
            + f", case when r_r > {eps} * sr then r_r else 0.0 end as a, case when r_r > {eps} * sr and t_t > {eps} * stt then r_t else 0.0 end as b, case when t_t > {eps} * stt then t_t else 0.0 end as e from f3",
        ),
        (
            "f5",
            f"""select *, case when a * e - b * b > {eps} * a * e then 2 when a + e > 0 then 1 else 0 end as rank,
  case when a * e - b * b > {eps} * a * e then (e * r_y - b * t_y) / (a * e - b * b) when a + e > 0 then (a * r_y + b * t_y) / ((a + e) * (a + e))
    else ((1 + tt) * ry - rt * ty) / ((1 + rr) * (1 + tt) - rt * rt) end as c1,
  case when a * e - b * b > {eps} * a * e then (a * t_y - b * r_y) / (a * e - b * b) when a + e > 0 then (b * r_y + e * t_y) / ((a + e) * (a + e))
    else ((1 + rr) * ty - rt * ry) / ((1 + rr) * (1 + tt) - rt * rt) end as c2,
  case when a > 0 then -b else 1.0 end as u, case when a > 0 then a else 0.0 end as v from f4""",
        ),
        (
            "f6",
            """select * exclude (my, mr, mt), my / greatest(k, 1) as my, mr / greatest(k, 1) as mr, mt / greatest(k, 1) as mt,
  case when rank = 1 then (u * c1 + v * c2 - u * (ry - c1 * rr - c2 * rt) - v * (ty - c1 * rt - c2 * tt)) / (u * u + v * v + u * u * rr + 2 * u * v * rt + v * v * tt) else 0.0 end as move from f5""",
        ),
        ("f7", "select *, c1 - move * u as b1, c2 - move * v as b2 from f6"),
        ("f8", f"select *, {effects} from f7"),
        (
            "coef",
            f"select product, case when {few} then 0.0 when n_null > 0 then sy / n else {_bround(base, 2)} end as base_bias, "
            + ", ".join(f"case when {few} or n_null > 0 then 0.0 else {_bround(e, 2)} end as {k}" for k, e in cols)
            + f", {_bround('waste / rows_', 1)} as waste_risk, {_bround('(sold + waste) / rows_', 1)} as avg_made from f8",
        ),
    ]


def _score_sql(coef_ctes: list[tuple[str, str]]) -> str:
    return with_ctes(
        list(LEDGER_CTES) + [DAILY_CTE, LEG] + coef_ctes + [
            (
                "sc",
                """select d.product, d.date, dayname(d.date) as day_name, d.weather, d.temp_avg as temp,
  c.product is not null as has_model, c.*
from daily d left join coef c on replace(d.product, ' ', '') = replace(c.product, ' ', '')""",
            ),
            (
                "eff",
                """select product, date, day_name, weather, temp, has_model, base_bias, waste_risk, avg_made,
  case dayname(date) when 'Monday' then w_day_Monday when 'Tuesday' then w_day_Tuesday
    when 'Wednesday' then w_day_Wednesday when 'Thursday' then w_day_Thursday when 'Friday' then w_day_Friday
    when 'Saturday' then w_day_Saturday else w_day_Sunday end as de,
  case when lower(weather) like '%rain%' or lower(weather) like '%snow%' then w_is_rain else 0.0 end as re,
  temp * w_temp as te
from sc""",
            ),
            (
                "scored",
                """select product, date, day_name, temp,
  case when has_model then base_bias else 0.0 end as base_score,
  case when has_model then de else 0.0 end as day_effect,
  case when has_model then re else 0.0 end as rain_effect,
  case when has_model then te else 0.0 end as temp_effect,
  case when has_model then base_bias + de + re + te else 0.0 end as predicted,
  case when has_model then cast(greatest(0, floor(base_bias + de + re + te + 0.5)) as integer) else 0 end as recommended,
  coalesce(waste_risk, 0.0) as waste_risk, coalesce(avg_made, 0.0) as avg_made, has_model
from eff""",
            ),
            (
                "st",
                """select *, case when not has_model then 'No Data'
  when temp > 25 and temp_effect >= 1.0 then 'Heat Spike'
  when rain_effect <= -1.0 then 'Rain Drop'
  when day_effect >= 1.0 then day_name || ' Boost'
  when day_effect <= -1.0 then day_name || ' Drop' else 'Stable' end as status from scored""",
            ),
        ],
        f"""select product, date, {_r(['base_score', 'day_effect', 'rain_effect', 'temp_effect', 'predicted'])}, recommended, status,
  case when status like '%Boost%' or status like '%Spike%' then 'green'
       when status like '%Drop%' or status like '%Rain%' then 'red' else 'gray' end as color,
  {_r(['waste_risk', 'avg_made'])}
from st""",
    )


ORACLE = {
    "seasonality": _season_sql(LEG, LEDGER_CTES),
    "seasonality_mixed": _season_sql(MIXED, RAW_LEDGER_CTES),
    "seasonality_positions": _season_sql(MIXED, RAW_LEDGER_CTES),
    "global_means": with_ctes(list(LEDGER_CTES) + [LEG], "select product, round(avg(qty), 6) as base_avg from leg group by product"),
    "weekday_means": with_ctes(
        list(LEDGER_CTES) + [LEG],
        "select product, cast(isodow(date) - 1 as integer) as day_num, round(avg(qty), 6) as day_avg from leg group by 1, 2",
    ),
    "waste_stats": with_ctes(
        list(LEDGER_CTES) + [LEG] + COEF_CTES[:2],
        "select product, " + _r(["total_sold", "total_waste", "total_made"]) + ", row_count, "
        + _r(["avg_waste", "avg_made"]) + " from ws",
    ),
    "health_report": with_ctes(
        RAW_LEDGER_CTES,
        "select count(*) as total_rows, count(*) filter (where try_strptime(raw_date, '%Y%m%d') is null) as invalid_dates from raw_ledger",
    ),
    "health_examples": with_ctes(
        RAW_LEDGER_CTES,
        "select raw_date from raw_ledger where try_strptime(raw_date, '%Y%m%d') is null "
        "order by line_ord, raw_date, product nulls first limit 5",
    ),
    "coefficients_json": with_ctes(list(LEDGER_CTES) + [LEG] + COEF_CTES, f"select product, {_r(COEF_COLS)} from coef"),
    "score_scenarios": _score_sql(COEF_CTES),
    "demand_fit": with_ctes(list(LEDGER_CTES) + [LEG] + _fit_ctes(), f"select product, {_r(COEF_COLS)} from coef"),
    "demand_scores": _score_sql(_fit_ctes()),
}
