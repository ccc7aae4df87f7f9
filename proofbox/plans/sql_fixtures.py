"""DuckDB-dialect text of the reference-shaped views (the oracle side).

Each constant is a list of CTE bodies; ``with_ctes`` assembles them. The
views are rebuilt independently of the Spark code from the same fixed rules
(see ``sources/fixtures.py`` for the rules in prose).
"""

from __future__ import annotations

from collections.abc import Sequence

LEDGER_CTES = [
    (
        "lg0",
        """select cast(l_shipdate as date) as date, p_type as product,
  case when l_returnflag = 'R' then -l_quantity else l_quantity end as qty,
  cast(case when l_returnflag = 'R' then -l_extendedprice else l_extendedprice end as decimal(18,2)) as sales,
  l_orderkey * 8 + l_linenumber as line_ord,
  (cast(l_shipdate as date) - date '1995-01-01') as dayno
from lineitem join part on l_partkey = p_partkey""",
    ),
    (
        "lg1",
        """select *, cast(((dayno * 7) % 41) - 8 + 0.5 * (dayno % 3) as double) as temp_avg from lg0""",
    ),
    (
        "ledger",
        """select date, product, qty, sales, temp_avg, temp_avg + 5 as temp_max, temp_avg - 5 as temp_min,
  case when temp_avg < 0 then 'Snow' when dayno % 10 < 3 then 'Rainy'
       when dayno % 10 < 6 then 'Cloudy' else 'Sunny' end as weather,
  line_ord, dayno
from lg1""",
    ),
]

RAW_LEDGER_CTES = LEDGER_CTES + [
    (
        "raw_ledger",
        """select
  case when dayno % 97 = 0 then 'not-a-date'
       when dayno % 83 = 0 then strftime(date, '%Y%m%d')
       else strftime(date, '%Y-%m-%d') end as raw_date,
  case when (dayno + cast(trunc(qty) as bigint)) % 79 = 0 then null else product end as product,
  case when (dayno + cast(trunc(qty) as bigint)) % 89 = 0 then null else qty end as qty,
  sales, weather, temp_avg, temp_max, temp_min, line_ord, date as true_date
from ledger""",
    ),
]

DAILY_CTE = (
    "daily",
    """select date, product,
  sum(case when qty > 0 then qty else 0.0 end) as sold_qty,
  abs(sum(case when qty < 0 then qty else 0.0 end)) as waste_qty,
  sum(case when qty > 0 then qty else 0.0 end) + abs(sum(case when qty < 0 then qty else 0.0 end)) as made_qty,
  sum(case when qty > 0 then qty else 0.0 end) - abs(sum(case when qty < 0 then qty else 0.0 end)) as net_qty,
  cast(sum(case when qty > 0 then sales else 0 end) as decimal(28,2)) as gross_sales,
  cast(abs(sum(case when qty < 0 then sales else 0 end)) as decimal(28,2)) as waste_value,
  arg_min(weather, line_ord) filter (where weather is not null) as weather,
  arg_min(temp_avg, line_ord) filter (where temp_avg is not null) as temp_avg,
  arg_min(temp_max, line_ord) filter (where temp_max is not null) as temp_max,
  arg_min(temp_min, line_ord) filter (where temp_min is not null) as temp_min,
  cast(max(case when qty > 0 then 1 else 0 end) as integer) as has_positive_row,
  cast(max(case when qty < 0 then 1 else 0 end) as integer) as has_negative_row,
  cast(sum(case when qty > 0 then 1 else 0 end) as integer) as positive_row_count,
  cast(sum(case when qty < 0 then 1 else 0 end) as integer) as negative_row_count,
  cast(count(*) as integer) as source_row_count,
  cast(max(case when qty < 0 then 1 else 0 end) = 1 and max(case when qty > 0 then 1 else 0 end) = 0 as integer) as only_negative_flag,
  cast(sum(case when qty < 0 then 1 else 0 end) > 1 as integer) as multi_negative_rows_flag
from ledger
where date is not null and product is not null
group by date, product""",
)

SHOP_CTES = [
    (
        "shop_products",
        """select p_partkey as product_id, p_name || case when p_partkey % 11 = 0 then ' 라떼' when p_partkey % 13 = 0 then ' 아메리카노' else '' end as name, cast(p_retailprice as decimal(18,2)) as price,
  cast(p_size * 4 as integer) as stock,
  case when p_partkey % 4 = 0 then 'HARD' when p_partkey % 4 = 1 then 'SOFT'
       when p_partkey % 4 = 2 then 'ALL' end as category
from part""",
    ),
    (
        "shop_customers",
        """select c_custkey as customer_id, c_name as name,
  concat('010', lpad(cast(c_custkey as varchar), 8, '0')) as phone,
  cast(greatest(0, floor(c_acctbal)) as integer) as points
from customer where c_custkey % 7 <> 0""",
    ),
    (
        "shop_orders",
        """select o_orderkey as order_id, o_custkey as customer_id,
  concat('010', lpad(cast(o_custkey as varchar), 8, '0')) as phone, o_orderdate as order_date,
  case when o_orderkey % 10 = 0 then 'CANCELLED' when o_orderstatus = 'O' then 'PENDING'
       when o_orderstatus = 'P' then 'PROCESSING' else 'COMPLETED' end as status,
  cast(o_totalprice as decimal(18,2)) as total_amount,
  cast((o_orderkey * 37) % 500 as integer) as points_used,
  case when o_orderkey % 10 <> 0 and o_orderstatus = 'F'
       then cast(floor(cast(o_totalprice as decimal(18,2)) * 0.03) as integer) else 0 end as points_earned
from orders""",
    ),
    (
        "shop_items",
        """select l_orderkey as order_id, l_partkey as product_id, cast(l_quantity as integer) as quantity from lineitem""",
    ),
]

ACTIONS_CTE = (
    "actions",
    """select user_id as key, ts, event_id as seq,
  case event_type when 'purchase' then 'create' when 'click' then 'confirm' when 'view' then 'complete'
                  when 'error' then 'cancel' when 'signup' then 'credit' end as action,
  value as amount
from events""",
)


def landing_sql(part: str, ordinal: str) -> str:
    """The landing (0 to 3) a row arrives with (see ``fixtures._landing``)."""
    return f"cast(greatest(0, least(3, {part} + case when {ordinal} % 13 = 0 then 2 when {ordinal} % 11 = 0 then 1 else 0 end)) as integer)"


def with_ctes(ctes: Sequence[tuple[str, str]], body: str) -> str:
    seen: dict[str, str] = {}
    for name, text in ctes:
        seen.setdefault(name, text)
    parts = ",\n".join(f"{name} as (\n{text}\n)" for name, text in seen.items())
    return f"with {parts}\n{body}"
