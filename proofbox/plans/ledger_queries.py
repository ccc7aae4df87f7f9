"""Registered queries: ledger -> daily table -> features (and their oracles)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from proofbox.functions.exprs import weekday_dummies, weekday_name
from proofbox.operators import daily as dl
from proofbox.operators import features as ft
from proofbox.plans.common import round_doubles, sql_round_list
from proofbox.plans.sql_fixtures import DAILY_CTE, LEDGER_CTES, RAW_LEDGER_CTES, landing_sql, with_ctes
from proofbox.sources import fixtures as fx

# ------------------------------------------------------------------ Spark side


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dl.daily_table(fx.ledger(spark, sf_dir))


def daily_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily table materialised once in the shared checkpoint folder, for plans that
    read it more than once (one ledger scan instead of one per reference)."""
    from proofbox.session import checkpointed

    return checkpointed(daily(spark, sf_dir))


def q_daily_table(spark, sf_dir):
    return round_doubles(dl.daily_table(fx.ledger(spark, sf_dir), by_product=False))


def q_daily_from_raw(spark, sf_dir):
    """Text ledger with Korean headers and defects -> daily table."""
    raw = fx.raw_ledger(spark, sf_dir)
    return round_doubles(dl.daily_table(dl.clean_ledger(raw)))


def q_daily_from_csv(spark, sf_dir):
    """A1 + A2-A3 + B1-B2 through a real CSV round trip: the text export is written as CSV
    under the shared checkpoint folder, read back with headers and cleaned."""
    import uuid

    from proofbox.session import scratch_path
    from proofbox.sources.ledger_io import read_ledger, write_ledger_csv

    path = scratch_path(spark, f"csv-ledger-{uuid.uuid4().hex[:12]}")
    write_ledger_csv(fx.raw_ledger(spark, sf_dir), path)
    raw = read_ledger(spark, path)
    return round_doubles(dl.daily_table(dl.clean_ledger(raw)))


def q_daily_input_order(spark, sf_dir):
    """A1 + D2 over many CSV files: the first valid weather and temperatures of a day are those of the line that
    comes first by file and place in the file."""
    import uuid

    from proofbox.session import scratch_path
    from proofbox.sources.ledger_io import read_ledger, write_ledger_csv

    base = scratch_path(spark, f"csv-landings-{uuid.uuid4().hex[:12]}")
    lines = fx.varied_export(spark, sf_dir)
    keys = [f"`{c}`" for c in fx.EXPORT_ORDER]
    for i in range(fx.LANDINGS):
        part = lines.where(f"landing = {i}").drop("landing")
        write_ledger_csv(part.repartitionByRange(3, *keys).sortWithinPartitions(*keys), f"{base}/{i}")
    raw = read_ledger(spark, [f"{base}/{i}" for i in range(fx.LANDINGS)], ordinal="line_ord")
    return round_doubles(dl.daily_table(dl.clean_ledger(raw), by_product=False))


def q_daily_written(spark, sf_dir):
    """A4 + A5: the daily table written as parquet partitioned by month under the shared
    checkpoint folder, then read back (partition column dropped, types restored)."""
    import uuid

    from proofbox.operators.forecast import read_features
    from proofbox.session import scratch_path

    path = scratch_path(spark, f"daily-{uuid.uuid4().hex[:12]}")
    dl.write_daily(daily(spark, sf_dir), path)
    back = read_features(spark, path).drop("month")
    return round_doubles(back.select(*dl.DAILY_COLUMNS))


def q_daily_ordered(spark, sf_dir):
    """the daily table in panel order (date, product), as a sink writes it (range-partitioned sort)."""
    return round_doubles(dl.order_panel(daily(spark, sf_dir)))


def q_panel_union(spark, sf_dir):
    """G1 + B13: the training and validation parts of the default split appended back together."""
    from proofbox.operators.forecast import temporal_split

    train, val = temporal_split(daily_once(spark, sf_dir))
    return round_doubles(dl.union_panels(train, val))


def features(spark, sf_dir, once: bool = False) -> DataFrame:
    return ft.build_features(daily_once(spark, sf_dir) if once else daily(spark, sf_dir))


def q_features(spark, sf_dir):
    return round_doubles(features(spark, sf_dir))


def _keyed(df: DataFrame, cols) -> DataFrame:
    return round_doubles(df.select("date", "product", *cols))


def q_feature_lags(spark, sf_dir):
    w = ft.series_window()
    return _keyed(daily(spark, sf_dir), ft.lag_columns(w))


def q_feature_rolling_mean(spark, sf_dir):
    w = ft.series_window()
    return _keyed(daily(spark, sf_dir), ft.rolling_mean_columns(w))


def q_feature_rolling_std(spark, sf_dir):
    w = ft.series_window()
    return _keyed(daily(spark, sf_dir), ft.rolling_std_columns(w))


def q_feature_same_dow(spark, sf_dir):
    d = daily(spark, sf_dir).select("date", "product", "sold_qty", "waste_qty", "made_qty")
    names = [f"{q}_same_dow_mean_{k}" for k in ft.SAME_DOW_WEEKS for q in ft.QTY] + [f"{q}_same_dow_std_8" for q in ft.QTY]
    return round_doubles(ft.add_same_dow(d).select("date", "product", *names))


def q_feature_ratios(spark, sf_dir):
    w = ft.series_window()
    return _keyed(daily(spark, sf_dir), ft.ratio_columns() + ft.ratio_window_columns(w))


def q_feature_temperature(spark, sf_dir):
    w = ft.series_window()
    return _keyed(daily(spark, sf_dir), ft.temperature_columns(w))


def q_calendar(spark, sf_dir):
    """H1-H7 over the panel dates."""
    d = daily(spark, sf_dir).select("date").distinct()
    return round_doubles(
        d.select("date", *ft.calendar_columns(), weekday_name("date").alias("day_name"), *weekday_dummies("date"))
    )


QUERIES = {
    "daily_table": q_daily_table,
    "daily_from_raw": q_daily_from_raw,
    "daily_from_csv": q_daily_from_csv,
    "daily_input_order": q_daily_input_order,
    "daily_written": q_daily_written,
    "daily_ordered": q_daily_ordered,
    "panel_union": q_panel_union,
    "features": q_features,
    "feature_lags": q_feature_lags,
    "feature_rolling_mean": q_feature_rolling_mean,
    "feature_rolling_std": q_feature_rolling_std,
    "feature_same_dow": q_feature_same_dow,
    "feature_ratios": q_feature_ratios,
    "feature_temperature": q_feature_temperature,
    "calendar": q_calendar,
}

# ------------------------------------------------------------------ oracle side

W = "partition by product order by date"


def _win(lo: int, hi: int = 1) -> str:
    return f"over ({W} rows between {lo} preceding and {hi} preceding)"


def _lag_sql() -> list[str]:
    return [f"lag({q}_qty, {n}) over ({W}) as {q}_lag_{n}" for n in ft.LAGS for q in ft.QTY]


def _rm_sql() -> list[str]:
    return [f"avg({q}_qty) {_win(n)} as {q}_rolling_mean_{n}" for n in ft.ROLL_WINDOWS for q in ft.QTY]


def _rs_sql() -> list[str]:
    return [f"stddev_samp({q}_qty) {_win(7)} as {q}_rolling_std_7" for q in ft.QTY]


def _dow_lag_sql() -> list[str]:
    return [f"lag({q}_qty, {7 * k}) over ({W}) as {q}_dl{k}" for q in ft.QTY for k in range(1, 9)]


def _dow_stats_sql() -> list[str]:
    out = []
    for k in ft.SAME_DOW_WEEKS:
        for q in ft.QTY:
            s = " + ".join(f"coalesce({q}_dl{i}, 0)" for i in range(1, k + 1))
            n = " + ".join(f"cast({q}_dl{i} is not null as integer)" for i in range(1, k + 1))
            out.append(f"({s}) / nullif({n}, 0) as {q}_same_dow_mean_{k}")
    for q in ft.QTY:
        n = " + ".join(f"cast({q}_dl{i} is not null as integer)" for i in range(1, 9))
        out.append(f"nullif({n}, 0) as {q}_n8")
    return out


def _dow_std_sql() -> list[str]:
    out = []
    for q in ft.QTY:
        ss = " + ".join(
            f"coalesce(({q}_dl{i} - {q}_same_dow_mean_8) * ({q}_dl{i} - {q}_same_dow_mean_8), 0)" for i in range(1, 9)
        )
        out.append(f"sqrt(({ss}) / {q}_n8) as {q}_same_dow_std_8")
    return out


def _ratio_base_sql() -> list[str]:
    return [
        "case when made_qty = 0 then 0.0 else sold_qty / made_qty end as sell_through_rate",
        "case when made_qty = 0 then 0.0 else waste_qty / made_qty end as waste_rate",
    ]


def _ratio_win_sql() -> list[str]:
    out = []
    for n in (1, 7):
        out.append(f"lag(sell_through_rate, {n}) over ({W}) as sell_through_rate_lag_{n}")
        out.append(f"lag(waste_rate, {n}) over ({W}) as waste_rate_lag_{n}")
    for n in (7, 28):
        out.append(f"avg(sell_through_rate) {_win(n)} as sell_through_rate_rolling_mean_{n}")
        out.append(f"avg(waste_rate) {_win(n)} as waste_rate_rolling_mean_{n}")
    return out


def _temp_sql() -> list[str]:
    return [
        f"lag(temp_avg, 1) over ({W}) as temp_avg_lag_1",
        f"temp_avg - lag(temp_avg, 1) over ({W}) as temp_avg_diff_1",
        f"temp_avg - avg(temp_avg) {_win(7)} as temp_avg_vs_7d_mean",
        f"cast(coalesce(temp_avg - lag(temp_avg, 1) over ({W}) <= -5.0, false) as integer) as is_cold_shock",
        f"cast(coalesce(temp_avg - lag(temp_avg, 1) over ({W}) >= 5.0, false) as integer) as is_heat_shock",
    ]


def _cal_sql() -> list[str]:
    return [
        "cast(isodow(date) - 1 as integer) as day_of_week",
        "cast(isodow(date) in (6, 7) as integer) as is_weekend",
        "cast(weekofyear(date) as integer) as week_of_year",
        "cast(month(date) as integer) as month",
        "cast(day(date) as integer) as day_of_month",
        "sin(2 * pi() * (isodow(date) - 1) / 7.0) as dow_sin",
        "cos(2 * pi() * (isodow(date) - 1) / 7.0) as dow_cos",
        "sin(2 * pi() * month(date) / 12.0) as month_sin",
        "cos(2 * pi() * month(date) / 12.0) as month_cos",
    ]


DOUBLE_DAILY = ["sold_qty", "waste_qty", "made_qty", "net_qty", "temp_avg", "temp_max", "temp_min"]
INT_DERIVED = {
    "day_of_week", "is_weekend", "week_of_year", "month", "day_of_month", "is_cold_shock", "is_heat_shock",
}


def _name(expr: str) -> str:
    return expr.rsplit(" as ", 1)[1].strip()


def _select_rounded(cols: list[str]) -> str:
    parts = []
    for c in cols:
        if c in INT_DERIVED or c in dl.DAILY_COLUMNS and c not in DOUBLE_DAILY:
            parts.append(c)
        else:
            parts.append(sql_round_list([c]))
    return ", ".join(parts)


def features_sql(columns: list[str] | None = None, extra_ctes=(), rounded: bool = True) -> str:
    """Oracle for I1 (or a column subset of it)."""
    f1 = ["*"] + _cal_sql() + _lag_sql() + _rm_sql() + _rs_sql() + _dow_lag_sql() + _ratio_base_sql() + _temp_sql()
    ctes = list(LEDGER_CTES) + [DAILY_CTE] + list(extra_ctes) + [
        ("f1", f"select {', '.join(f1)} from daily"),
        ("f2", f"select *, {', '.join(_dow_stats_sql() + _ratio_win_sql())} from f1"),
        ("f3", f"select *, {', '.join(_dow_std_sql())} from f2"),
    ]
    cols = columns if columns is not None else dl.DAILY_COLUMNS + ft.FEATURE_DERIVED
    sel = _select_rounded(cols) if rounded else ", ".join(cols)
    return with_ctes(ctes, f"select {sel} from f3")


def daily_sql(ctes) -> str:
    return with_ctes(list(ctes) + [DAILY_CTE], f"select {_select_rounded(dl.DAILY_COLUMNS)} from daily")


def _raw_daily_sql() -> str:
    clean = (
        "ledger_clean",
        """select coalesce(try_strptime(raw_date, '%Y-%m-%d'), try_strptime(raw_date, '%Y-%m-%d %H:%M:%S'),
                try_strptime(raw_date, '%Y/%m/%d'), try_strptime(raw_date, '%Y%m%d'))::date as date,
  product, coalesce(qty, 0.0) as qty, sales, weather, temp_avg, temp_max, temp_min, line_ord
from raw_ledger""",
    )
    daily_clean = ("daily", DAILY_CTE[1].replace("from ledger", "from ledger_clean"))
    return with_ctes(
        list(RAW_LEDGER_CTES) + [clean, daily_clean], f"select {_select_rounded(dl.DAILY_COLUMNS)} from daily"
    )


def _subset(names: list[str]) -> str:
    return features_sql(["date", "product"] + names)


def _names(exprs: list[str]) -> list[str]:
    return [_name(e) for e in exprs]


CAL_NAMES = _names(_cal_sql())
WEEKDAY_SQL = ", ".join(
    f"cast(isodow(date) = {i + 1} as integer) as day_{n}" for i, n in enumerate(
        ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
    )
)

ORACLE = {
    "daily_table": daily_sql(LEDGER_CTES),
    "daily_from_raw": _raw_daily_sql(),
    "daily_from_csv": _raw_daily_sql(),
    "daily_input_order": daily_sql(
        [
            *LEDGER_CTES[:-1], ("whole", LEDGER_CTES[-1][1]),
            (
                "exported",
                f"""select {landing_sql("cast((year(date) - 1995) // 2 as integer)", "line_ord")} as landing, date, product, qty, sales, line_ord as line,
  case when line_ord % 3 <> 0 then weather || ' ' || (line_ord % 5) end as weather, case when line_ord % 4 <> 0 then temp_avg + line_ord % 7 end as temp_avg,
  case when line_ord % 5 <> 0 then temp_max + line_ord % 3 end as temp_max, case when line_ord % 2 <> 0 then temp_min end as temp_min from whole""",
            ),
            (
                "ledger",
                "select *, row_number() over (order by landing, strftime(date, '%Y-%m-%d'), product, line, cast(qty as varchar), cast(sales as varchar)) as line_ord from exported",
            ),
        ]
    ),
    "daily_written": daily_sql(LEDGER_CTES),
    "daily_ordered": daily_sql(LEDGER_CTES),
    "panel_union": daily_sql(LEDGER_CTES),
    "features": features_sql(),
    "feature_lags": _subset(_names(_lag_sql())),
    "feature_rolling_mean": _subset(_names(_rm_sql())),
    "feature_rolling_std": _subset(_names(_rs_sql())),
    "feature_same_dow": _subset(
        [f"{q}_same_dow_mean_{k}" for k in ft.SAME_DOW_WEEKS for q in ft.QTY] + [f"{q}_same_dow_std_8" for q in ft.QTY]
    ),
    "feature_ratios": _subset(["sell_through_rate", "waste_rate"] + _names(_ratio_win_sql())),
    "feature_temperature": _subset(_names(_temp_sql())),
    "calendar": with_ctes(
        list(LEDGER_CTES) + [DAILY_CTE, ("d", "select distinct date from daily")],
        f"select date, {', '.join(_cal_sql()[:5])}, "
        + ", ".join(f"round({e.rsplit(' as ', 1)[0]}, 9) as {_name(e)}" for e in _cal_sql()[5:])
        + ", dayname(date) as day_name, "
        + WEEKDAY_SQL
        + " from d",
    ),
}
