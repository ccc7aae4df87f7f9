"""Registered queries: the Structured Streaming jobs, run to completion with
``availableNow`` over the driver tables read as file streams. Each oracle is
the SQL of the job's batch twin (all input arrives in one micro-batch here, so
stream and batch must agree row for row)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from proofbox.operators import lifecycle as lc
from proofbox.plans import decide_queries, ledger_queries, lifecycle_queries, shop_queries
from proofbox.plans.common import round_doubles
from proofbox.plans.sql_fixtures import ACTIONS_CTE, LEDGER_CTES, landing_sql, with_ctes
from proofbox.sources import fixtures as fx
from proofbox.streaming import event_time as et
from proofbox.streaming import jobs as sj


def q_stream_daily(spark, d):
    """J1 in update mode: every (day, product) the stream touched, latest version (what is there lands in one batch)."""
    out = sj.run_available(sj.stream_daily(sj.ledger_stream(spark, d)), "daily", mode="update", keys=["date", "product"])
    return round_doubles(out)


def _applied(df):
    return df.where(F.col("stage") != et.LATE).drop("stage")


def q_stream_lifecycle(spark, d):
    """J2 over the whole action log, as it lands in one batch: nothing is late."""
    return _applied(sj.run_available(sj.stream_order_lifecycle(sj.actions_stream(spark, d)), "lifecycle", mode="update", keys=["key", "seq"]))


def q_stream_admission(spark, d):
    """J3 over the whole action log, as it lands in one batch: nothing is late."""
    moves = lc.point_moves_from_actions(sj.actions_stream(spark, d))
    return _applied(sj.run_available(sj.stream_admission(moves), "admission", mode="update", keys=["key", "seq"])).drop("ts")


def _landed(spark, rows, job, name):
    """The landed table of a keyed job that runs after each of the landings of ``rows``."""
    path = sj.scratch_path(spark, f"streams/{name}-{uuid.uuid4().hex[:12]}")
    return et.run_landings(rows, "landing", fx.LANDINGS, lambda stream: sj.run_available(job(stream), name, mode="update", keys=["key", "seq"], path=path))


def q_lifecycle_landings(spark, d):
    """J2 with stragglers: four landings, two days of delay; every action, applied or late."""
    out = _landed(spark, fx.action_landings(spark, d), sj.stream_order_lifecycle, "lifecycle-landings")
    return out.withColumn("late", F.col("stage") == et.LATE).drop("stage")


def q_admission_landings(spark, d):
    """J3 with stragglers: four landings, two days of delay; every move, applied or late."""
    out = _landed(spark, fx.action_landings(spark, d), lambda a: sj.stream_admission(lc.point_moves_from_actions(a)), "admission-landings")
    return out.withColumn("late", F.col("stage") == et.LATE).drop("stage", "ts")


DAILY_DELAY = 30


def _daily_landings(spark, d):
    path = sj.scratch_path(spark, f"streams/daily-{uuid.uuid4().hex[:12]}")
    return et.run_landings(fx.ledger_landings(spark, d), "landing", fx.LANDINGS, lambda stream: et.run_daily(stream, DAILY_DELAY, path))


def q_daily_landings(spark, d):
    """J1 with stragglers: the daily table of the lines that were in time over four landings, 30 days of delay."""
    return round_doubles(_daily_landings(spark, d)[0])


def q_late_lines(spark, d):
    """J1's side table: the lines that came behind the watermark, row by row."""
    return _daily_landings(spark, d)[1].select("line_ord", "date", "product", "qty")


def q_stream_status_counts(spark, d):
    stream = sj.table_stream(spark, d, "orders")
    # the same order rules applied to the streamed orders table
    o = stream.select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 10 == 0, "CANCELLED").when(F.col("o_orderstatus") == "O", "PENDING")
        .when(F.col("o_orderstatus") == "P", "PROCESSING").otherwise("COMPLETED").alias("status"),
    )
    return sj.run_available(sj.stream_status_counts(o), "status", mode="update", keys=["status"])


def q_stream_stock_position(spark, d):
    """Stock per product kept current from a stream of order lines (static orders
    give each line's status); the opening stock and badge are applied on read."""
    from proofbox.functions.exprs import stock_badge

    items = fx.shop_items_from(sj.table_stream(spark, d, "lineitem"))
    deltas = sj.run_available(sj.stream_stock_deltas(items, fx.shop_orders(spark, d)), "stock", mode="update", keys=["product_id"])
    products = fx.shop_products(spark, d).select("product_id", "stock")
    pos = (F.col("stock") + F.coalesce("net_delta", F.lit(0))).cast("long")
    return products.join(deltas, "product_id", "left").select("product_id", pos.alias("stock"), stock_badge(pos).alias("badge"))


def _request_stream(daily):
    return sj.landed_stream(fx.forecast_requests(daily), "requests")


def q_stream_forecast(spark, d):
    """J5 with the stand-in forecasters: answered and failed requests."""
    daily = ledger_queries.daily_once(spark, d)
    return round_doubles(sj.run_available(sj.stream_forecast(_request_stream(daily), daily), "forecast").drop("prompt_text"))


def q_stream_rejected(spark, d):
    """J5's rejected requests."""
    return sj.run_available(sj.stream_rejected(_request_stream(ledger_queries.daily(spark, d))), "rejected")


QUERIES = {
    "stream_daily": q_stream_daily,
    "stream_lifecycle": q_stream_lifecycle,
    "stream_admission": q_stream_admission,
    "lifecycle_landings": q_lifecycle_landings,
    "admission_landings": q_admission_landings,
    "daily_landings": q_daily_landings,
    "late_lines": q_late_lines,
    "stream_status_counts": q_stream_status_counts,
    "stream_stock_position": q_stream_stock_position,
    "stream_forecast": q_stream_forecast,
    "stream_rejected": q_stream_rejected,
}


def _late_ctes(rows: str, time: str, part: str, ordinal: str, ms: str, delay_ms: int) -> list[tuple[str, str]]:
    """Rows marked late: at or before the newest time of all earlier landings, less the delay."""
    return [
        ("landed", f"select *, {landing_sql(part, ordinal)} as landing, {ms} as ms from {rows}"),
        ("newest", "select landing, max(ms) as top from landed group by landing"),
        (
            "marked",
            f"""select r.* exclude (landing, ms), coalesce(r.ms <= (select max(top) from newest w where w.landing < r.landing) - {delay_ms}, false) as late
from landed r""",
        ),
    ]


def _landed_actions(rows: str) -> list[tuple[str, str]]:
    return _late_ctes(rows, "ts", "cast((day(ts) - 1) // 8 as integer)", "seq", "epoch_ms(ts)", 2 * 86_400_000)


_LEDGER_MARKED = [
    *LEDGER_CTES[:-1], ("whole", LEDGER_CTES[-1][1]),
    *_late_ctes("whole", "date", "cast((year(date) - 1995) // 2 as integer)", "line_ord", "cast(epoch_ms(cast(date as timestamp)) as bigint)", DAILY_DELAY * 86_400_000),
]

_LIFE_COLS = "key, ts, seq, action, status_before, status_after, accepted, note"
_ADMIT_COLS = "key, seq, kind, amount, accepted, balance_after, reason"

LANDED_ORACLE = {
    "lifecycle_landings": lifecycle_queries.with_recursive(
        [
            ("logged", ACTIONS_CTE[1]),
            ("known", "select * from logged where action in ('create', 'confirm', 'complete', 'cancel')"),
            *_landed_actions("known"),
            ("actions", "select key, ts, seq, action, amount from marked where not late"),
            *[c for c in lifecycle_queries.LIFE_RECURSIVE if c[0] != "actions"],
        ],
        f"""select {_LIFE_COLS}, false as late from life
union all select key, ts, seq, action, null, null, null, null, true from marked where late""",
    ),
    "admission_landings": lifecycle_queries.with_recursive(
        [
            ("logged", ACTIONS_CTE[1]),
            ("known", "select * from logged where action in ('credit', 'create', 'cancel')"),
            *_landed_actions("known"),
            ("actions", "select key, ts, seq, action, amount from marked where not late"),
            *[c for c in lifecycle_queries.ADMIT_RECURSIVE if c[0] != "actions"],
        ],
        f"""select {_ADMIT_COLS}, false as late from admitted
union all select key, seq, case action when 'credit' then 'deposit' when 'create' then 'withdraw' else 'revert' end, cast(floor(amount) as bigint), null, null, null, true
from marked where late""",
    ),
    "daily_landings": ledger_queries.daily_sql([*_LEDGER_MARKED, ("ledger", "select * exclude (late) from marked where not late")]),
    "late_lines": with_ctes(_LEDGER_MARKED, "select line_ord, date, product, qty from marked where late"),
}

ORACLE = LANDED_ORACLE | {
    "stream_daily": ledger_queries.ORACLE["daily_table"],
    "stream_lifecycle": lifecycle_queries.ORACLE["order_lifecycle"],
    "stream_admission": lifecycle_queries.ORACLE["point_admission"],
    "stream_status_counts": shop_queries.ORACLE["status_counts"],
    "stream_stock_position": shop_queries.ORACLE["stock_position"],
    "stream_forecast": decide_queries.ORACLE["forecast_requests"],
    "stream_rejected": decide_queries.ORACLE["rejected_requests"],
}
