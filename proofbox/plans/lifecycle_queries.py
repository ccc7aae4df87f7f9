"""Registered queries: order lifecycle (J2) and sequential point admission.

Both oracles are recursive CTEs that walk each key's actions one by one, an
independent, sequential formulation of the same rules.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from proofbox.operators import lifecycle as lc
from proofbox.plans.sql_fixtures import ACTIONS_CTE, with_ctes
from proofbox.sources import fixtures as fx


def q_order_lifecycle(spark, d):
    return lc.order_lifecycle(fx.actions(spark, d))


def q_point_admission(spark, d):
    return lc.admit(lc.point_moves_from_actions(fx.actions(spark, d)))


def q_status_after_actions(spark, d):
    """J4 batch twin: live status counts, the last status of every order."""
    life = lc.order_lifecycle(fx.actions(spark, d))
    last = life.groupBy("key").agg(F.max_by("status_after", F.struct("ts", "seq")).alias("status"))
    return last.groupBy("status").agg(F.count(F.lit(1)).alias("n_orders"))


QUERIES = {
    "order_lifecycle": q_order_lifecycle,
    "point_admission": q_point_admission,
    "status_after_actions": q_status_after_actions,
}

LIFE_RECURSIVE = [
    ACTIONS_CTE,
    (
        "la",
        """select key, ts, seq, action, row_number() over (partition by key order by ts, seq) as rn
from actions where action in ('create', 'confirm', 'complete', 'cancel')""",
    ),
    (
        "walk(key, rn, ts, seq, action, status_before, status_after)",
        """select key, rn, ts, seq, action, 'NONE',
  case when action = 'create' then 'PENDING' else 'NONE' end
from la where rn = 1
union all
select n.key, n.rn, n.ts, n.seq, n.action, w.status_after,
  case when n.action = 'create' then 'PENDING'
       when n.action = 'confirm' and w.status_after = 'PENDING' then 'PROCESSING'
       when n.action = 'complete' and w.status_after <> 'NONE' then 'COMPLETED'
       when n.action = 'cancel' and w.status_after not in ('NONE', 'CANCELLED') then 'CANCELLED'
       else w.status_after end
from walk w join la n on n.key = w.key and n.rn = w.rn + 1""",
    ),
    (
        "life",
        """select key, ts, seq, action, status_before, status_after,
  case when action = 'create' then true when action = 'confirm' then status_before = 'PENDING'
       when action = 'complete' then status_before <> 'NONE'
       when action = 'cancel' then status_before not in ('NONE', 'CANCELLED') else false end as accepted,
  case when action <> 'create' and status_before = 'NONE' then 'order_not_found'
       when action = 'confirm' and status_before <> 'PENDING' then 'only_pending_can_be_confirmed'
       when action = 'complete' and status_before = 'COMPLETED' then 'already_completed'
       when action = 'cancel' and status_before = 'CANCELLED' then 'already_cancelled'
       when action = 'cancel' then 'restock' end as note
from walk""",
    ),
]


ADMIT_RECURSIVE = [
    ACTIONS_CTE,
    (
        "mv",
        """select key, ts, seq, kind, amount, row_number() over (partition by key order by ts, seq) as rn from (
  select key, ts, seq, case action when 'credit' then 'deposit' when 'create' then 'withdraw' when 'cancel' then 'revert' end as kind,
    cast(floor(amount) as bigint) as amount from actions) where kind is not null""",
    ),
    (
        "adm(key, rn, seq, kind, amount, accepted, balance_after)",
        """select key, rn, seq, kind, amount,
  case when kind = 'withdraw' then amount <= 0 else true end,
  case when kind = 'deposit' then amount when kind = 'withdraw' then (case when amount <= 0 then -amount else 0 end)
       else greatest(0, -amount) end
from mv where rn = 1
union all
select n.key, n.rn, n.seq, n.kind, n.amount,
  case when n.kind = 'withdraw' then a.balance_after >= n.amount else true end,
  case when n.kind = 'deposit' then a.balance_after + n.amount
       when n.kind = 'withdraw' then (case when a.balance_after >= n.amount then a.balance_after - n.amount else a.balance_after end)
       else greatest(0, a.balance_after - n.amount) end
from adm a join mv n on n.key = a.key and n.rn = a.rn + 1""",
    ),
    (
        "admitted",
        """select key, seq, kind, amount, accepted, cast(balance_after as bigint) as balance_after,
  case when not accepted then 'insufficient_balance' end as reason from adm""",
    ),
]


def with_recursive(ctes, body: str) -> str:
    return with_ctes(ctes, body).replace("with ", "with recursive ", 1)


ORACLE = {
    "order_lifecycle": with_recursive(LIFE_RECURSIVE, "select * from life"),
    "status_after_actions": with_recursive(
        LIFE_RECURSIVE,
        """select status, count(*) as n_orders from (
  select key, arg_max(status_after, rn) as status from walk group by key) group by status""",
    ),
    "point_admission": with_recursive(ADMIT_RECURSIVE, "select * from admitted"),
}
