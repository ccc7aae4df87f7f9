"""Registered queries: the shop's orders, stock and points (and their oracles)."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofbox.functions.exprs import is_open, phone_digits, valid_iso_date
from proofbox.operators import daily as dl
from proofbox.operators import lifecycle as lc
from proofbox.operators import retail as rt
from proofbox.plans import lifecycle_queries
from proofbox.plans.sql_fixtures import ACTIONS_CTE, RAW_LEDGER_CTES, SHOP_CTES, with_ctes
from proofbox.sources import fixtures as fx
from proofbox.sources.tables import read_table


def _p(spark, d):
    return fx.shop_products(spark, d)


def _o(spark, d):
    return fx.shop_orders(spark, d)


def _i(spark, d, orphans=False):
    return fx.shop_items(spark, d, with_orphans=orphans)


def _c(spark, d):
    return fx.shop_customers(spark, d)


def q_order_totals(spark, d):
    return rt.order_totals(_i(spark, d), _p(spark, d))


def q_customer_points(spark, d):
    return rt.customer_points(_o(spark, d).select("phone").distinct(), _c(spark, d))


def q_orders_by_phone(spark, d):
    return rt.orders_by_phone(_o(spark, d), _c(spark, d)).select("phone", "order_id", "order_date", "status")


def q_orders_by_customer(spark, d):
    ids = read_table(spark, d, "customer").filter(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("customer_id"))
    return rt.orders_by_customer(_o(spark, d), ids).select("customer_id", "order_id", "status", "total_amount")


def q_new_customers(spark, d):
    n = rt.new_customers(_o(spark, d), _c(spark, d))
    return n.select("phone", "name", "points", rt.counter_name("phone").alias("counter_name"), rt.manual_name("phone").alias("manual_name"))


def q_orphan_items(spark, d):
    return rt.orphan_items(_i(spark, d, orphans=True), _p(spark, d))


def q_lookup_category(spark, d):
    return rt.lookup(_p(spark, d), "category", ["HARD"])


def q_order_status(spark, d):
    ids = read_table(spark, d, "lineitem").select((F.col("l_orderkey") * 2).alias("order_id")).distinct()
    return rt.order_status(ids, _o(spark, d))


def q_status_counts(spark, d):
    return rt.status_counts(_o(spark, d))


def q_points_balance(spark, d):
    return rt.points_balance(rt.point_moves(_o(spark, d)), _c(spark, d))


def q_stock_position(spark, d):
    return rt.stock_position(_p(spark, d), rt.stock_moves(_i(spark, d), _o(spark, d)))


def q_points_history(spark, d):
    return rt.points_history(_o(spark, d))


def q_orders_newest(spark, d):
    return rt.orders_newest(_o(spark, d)).select("order_id", "order_date", "status", "total_amount")


def q_menu_order(spark, d):
    return rt.menu_order(_p(spark, d)).select("product_id", "name", "stock", "is_drink")


def q_menu_availability(spark, d):
    return rt.menu_availability(_i(spark, d), _o(spark, d), _p(spark, d))


def q_stock_badges(spark, d):
    return rt.with_badges(_p(spark, d)).select("product_id", "stock", "stock_badge")


def q_rule_violations(spark, d):
    return rt.order_rule_violations(*fx.order_forms(spark, d))


def q_form_violations(spark, d):
    """Payment, manual points and stock forms against their rule sets, the broken rules of each as one text."""
    pay, stock = fx.payment_forms(spark, d), fx.stock_forms(spark, d)
    out = None
    for kind, forms in (("payment", pay), ("points", pay), ("stock", stock)):
        one = rt.violations(forms, rt.rule_set(kind)).select(F.lit(kind).alias("form"), "form_id", F.array_join("codes", ",").alias("codes"))
        out = one if out is None else out.unionByName(one)
    return out


def q_point_channels(spark, d):
    """D12 + J3: every point channel, admitted in order from the customers' points."""
    moves = rt.channel_moves(fx.point_requests(spark, d))
    opening = _c(spark, d).select(F.col("customer_id").alias("key"), F.col("points").alias("opening"))
    out = lc.admit(moves, opening)
    return out.join(moves.select("seq", "channel", "earn"), "seq").select("key", "seq", "channel", "amount", "earn", "accepted", "balance_after", "reason")


def q_stock_after_takes(spark, d):
    """D13 with stock-takes: the last count of a product, and what was ordered after it."""
    return rt.stock_position(_p(spark, d), rt.stock_moves(_i(spark, d), _o(spark, d)), fx.stock_takes(spark, d))


def q_payment_points(spark, d):
    return rt.payment_points(_o(spark, d))


def q_phone_digits(spark, d):
    c = _c(spark, d)
    shown = F.concat_ws("-", F.substring("phone", 1, 3), F.substring("phone", 4, 4), F.substring("phone", 8, 4))
    return c.select("customer_id", F.concat(F.lit("("), shown, F.lit(")")).alias("shown"), phone_digits(shown).alias("digits"))


def q_valid_iso_dates(spark, d):
    raw = dl.normalise_columns(fx.raw_ledger(spark, d))
    return raw.select(F.col("date").alias("raw_date")).distinct().select("raw_date", valid_iso_date("raw_date").alias("is_valid"))


def q_shop_open(spark, d):
    a = fx.actions(spark, d)
    return a.select("seq", "ts", is_open("ts").alias("is_open"))


QUERIES = {
    "order_totals": q_order_totals,
    "customer_points": q_customer_points,
    "orders_by_phone": q_orders_by_phone,
    "orders_by_customer": q_orders_by_customer,
    "new_customers": q_new_customers,
    "orphan_items": q_orphan_items,
    "lookup_category": q_lookup_category,
    "order_status": q_order_status,
    "status_counts": q_status_counts,
    "points_balance": q_points_balance,
    "stock_position": q_stock_position,
    "points_history": q_points_history,
    "orders_newest": q_orders_newest,
    "menu_order": q_menu_order,
    "menu_availability": q_menu_availability,
    "stock_badges": q_stock_badges,
    "rule_violations": q_rule_violations,
    "form_violations": q_form_violations,
    "point_channels": q_point_channels,
    "stock_after_takes": q_stock_after_takes,
    "payment_points": q_payment_points,
    "phone_digits": q_phone_digits,
    "valid_iso_dates": q_valid_iso_dates,
    "shop_open": q_shop_open,
}

# ------------------------------------------------------------------ oracle side

S = SHOP_CTES
ORPHAN_ITEMS = (
    "items_o",
    "select l_orderkey as order_id, case when l_orderkey % 50 = 0 then l_partkey + 10000000 else l_partkey end as product_id, "
    "cast(l_quantity as integer) as quantity from lineitem",
)
MOVES = (
    "moves",
    """select customer_id, -points_used as delta from shop_orders
union all select customer_id, points_earned from shop_orders where points_earned <> 0""",
)
STOCK_MOVES = (
    "smoves",
    """select i.product_id, -i.quantity as delta from shop_items i join shop_orders o on i.order_id = o.order_id
union all select i.product_id, i.quantity from shop_items i join shop_orders o on i.order_id = o.order_id where o.status = 'CANCELLED'""",
)

ORACLE = {
    "order_totals": with_ctes(
        S,
        """select i.order_id, cast(sum(p.price * i.quantity) as decimal(38,2)) as total_amount, count(*) as n_items,
  cast(sum(i.quantity) as bigint) as n_units
from shop_items i join shop_products p on i.product_id = p.product_id group by i.order_id""",
    ),
    "customer_points": with_ctes(
        S,
        """select o.phone, coalesce(c.points, 0) as points
from (select distinct phone from shop_orders) o left join shop_customers c on o.phone = c.phone""",
    ),
    "orders_by_phone": with_ctes(
        S, "select phone, order_id, order_date, status from shop_orders where phone in (select phone from shop_customers)"
    ),
    "orders_by_customer": with_ctes(
        S,
        """select customer_id, order_id, status, total_amount from shop_orders
where customer_id in (select c_custkey from customer where c_mktsegment = 'BUILDING')""",
    ),
    "new_customers": with_ctes(
        S,
        """select phone, 'Guest' as name, 0 as points, concat('Guest ', right(phone, 4)) as counter_name,
  concat('Walk-in ', phone) as manual_name
from (select distinct phone from shop_orders where phone not in (select phone from shop_customers))""",
    ),
    "orphan_items": with_ctes(
        S + [ORPHAN_ITEMS],
        "select product_id, order_id, quantity from items_o where product_id not in (select product_id from shop_products)",
    ),
    "lookup_category": with_ctes(S, "select * from shop_products where category = 'HARD'"),
    "order_status": with_ctes(
        S,
        """select r.order_id, coalesce(o.status, 'UNKNOWN') as status
from (select distinct l_orderkey * 2 as order_id from lineitem) r left join shop_orders o on r.order_id = o.order_id""",
    ),
    "status_counts": with_ctes(S, "select status, count(*) as n_orders from shop_orders group by status"),
    "points_balance": with_ctes(
        S + [MOVES],
        """select coalesce(g.customer_id, c.customer_id) as customer_id, coalesce(c.points, 0) as opening_points,
  cast(coalesce(g.used, 0) as bigint) as points_used, cast(coalesce(g.earned, 0) as bigint) as points_earned,
  cast(coalesce(c.points, 0) + coalesce(g.net, 0) as bigint) as balance
from (select customer_id, sum(case when delta < 0 then -delta else 0 end) as used,
             sum(case when delta > 0 then delta else 0 end) as earned, sum(delta) as net
      from moves group by customer_id) g
full join shop_customers c on g.customer_id = c.customer_id""",
    ),
    "stock_position": with_ctes(
        S + [STOCK_MOVES],
        """select p.product_id, cast(p.stock + coalesce(m.d, 0) as bigint) as stock,
  case when p.stock + coalesce(m.d, 0) <= 0 then 'SOLD_OUT' when p.stock + coalesce(m.d, 0) <= 5 then 'LOW' else 'OK' end as badge
from shop_products p left join (select product_id, sum(delta) as d from smoves group by product_id) m on p.product_id = m.product_id""",
    ),
    "points_history": with_ctes(
        S,
        """select phone, order_id, order_date, points_earned, points_used, rank from (
  select phone, order_id, order_date, points_earned, points_used,
    cast(row_number() over (partition by phone order by order_date desc, order_id desc) as integer) as rank
  from shop_orders where status <> 'CANCELLED') where rank <= 5""",
    ),
    "orders_newest": with_ctes(S, "select order_id, order_date, status, total_amount from shop_orders"),
    "menu_order": with_ctes(
        S,
        "select product_id, name, stock, coalesce(contains(name, '라떼') or contains(name, '아메리카노'), false) as is_drink from shop_products",
    ),
    "menu_availability": with_ctes(
        S,
        """select i.order_id, i.product_id, cast(o.order_date as date) as order_day, p.category,
  case when p.category is null or p.category = 'ALL' then true
       when p.category = 'HARD' then isodow(o.order_date) in (4, 5, 6)
       when p.category = 'SOFT' then isodow(o.order_date) in (7, 1, 3) else false end as available
from shop_items i join shop_orders o on i.order_id = o.order_id join shop_products p on i.product_id = p.product_id""",
    ),
    "stock_badges": with_ctes(
        S,
        "select product_id, stock, case when stock <= 0 then 'SOLD_OUT' when stock <= 5 then 'LOW' else 'OK' end as stock_badge from shop_products",
    ),
    "rule_violations": with_ctes(
        S + [
            (
                "oforms",
                """select order_id, case when order_id % 17 = 0 then substr(phone, 1, 7) when order_id % 19 = 0 then null else phone end as phone,
  case when order_id % 23 = 0 then repeat('m', 501) when order_id % 5 = 0 then 'no onions' end as memo,
  case when order_id % 29 = 0 then -5 else points_used end as points_used,
  case when order_id % 31 = 0 then 0 when order_id % 37 = 0 then 500001 else total_amount end as total_amount from shop_orders""",
            ),
            ("iforms", "select order_id, case when order_id % 43 = 0 then 0 else quantity end as quantity from shop_items where order_id % 41 <> 0"),
        ],
        """select order_id, rule from (
  select o.order_id, unnest([
    case when o.phone is null or not regexp_matches(o.phone, '^[0-9]{10,11}$') then 'phone_format' end,
    case when length(coalesce(o.memo, '')) > 500 then 'memo_too_long' end,
    case when coalesce(g.n, 0) < 1 then 'no_items' end,
    case when g.mq < 1 then 'quantity_below_1' end,
    case when o.points_used < 0 then 'negative_points' end,
    case when o.total_amount <= 0 or o.total_amount > 500000 then 'amount_out_of_range' end]) as rule
  from oforms o left join (select order_id, count(*) as n, min(quantity) as mq from iforms group by order_id) g
    on o.order_id = g.order_id) where rule is not null""",
    ),
    "form_violations": with_ctes(
        S + [
            (
                "pay",
                """select order_id as form_id, case when order_id % 17 = 0 then ' ' when order_id % 19 = 0 then null else phone end as phone,
  case when order_id % 23 = 0 then null when order_id % 31 = 0 then -1 when order_id % 37 = 0 then 500001 else total_amount end as amount,
  case when order_id % 41 = 0 then null when order_id % 2 = 0 then 'CASH' else 'CARD' end as method,
  case when order_id % 29 = 0 then -5 else points_used end as points_used from shop_orders""",
            ),
            (
                "stockf",
                """select product_id as form_id, case when product_id % 17 <> 0 then product_id end as product_id,
  case when product_id % 19 = 0 then -1 else product_id * 7 % 60 end as quantity from shop_products""",
            ),
        ],
        """select 'payment' as form, form_id, concat_ws(',', case when phone is null or trim(phone) = '' then 'phone_missing' end, case when amount is null then 'amount_missing' end,
  case when amount <= 0 then 'amount_not_positive' end, case when amount > 500000 then 'amount_above_limit' end, case when method is null then 'method_missing' end,
  case when points_used < 0 then 'negative_points' end) as codes from pay
union all select 'points', form_id, concat_ws(',', case when phone is null or trim(phone) = '' then 'phone_missing' end, case when amount is null then 'amount_missing' end,
  case when amount <= 0 then 'amount_not_positive' end, case when amount > 500000 then 'amount_above_limit' end) from pay
union all select 'stock', form_id, concat_ws(',', case when product_id is null then 'product_missing' end, case when quantity < 0 then 'negative_quantity' end) from stockf""",
    ),
    "point_channels": lifecycle_queries.with_recursive(
        [
            *S,
            (
                "steps",
                """select customer_id as key, order_date as ts, order_id, total_amount as amount,
  case when order_id % 7 = 0 then points_used * 400 else points_used end as used, cast(floor(total_amount * 0.03) as integer) as earned,
  unnest(case order_id % 5 when 0 then ['order', 'complete'] when 1 then ['order', 'complete', 'revert'] when 2 then ['counter'] when 3 then ['quick'] else ['manual'] end) as channel
  from shop_orders""",
            ),
            (
                "pm",
                """select key, ts, order_id * 4 + case channel when 'complete' then 1 when 'revert' then 2 else 0 end as seq, channel,
  cast(case channel when 'complete' then trunc(amount * 0.03) when 'manual' then trunc(amount * 0.05) when 'revert' then earned else used end as bigint) as amount,
  cast(case channel when 'counter' then trunc(greatest(amount - used, 0) * 0.03) when 'quick' then trunc((amount - used) * 0.03) else 0 end as bigint) as earn
from steps""",
            ),
            ("pn", "select *, row_number() over (partition by key order by ts, seq) as rn from pm"),
            (
                "pw(key, rn, seq, channel, amount, earn, bef, aft)",
                """select key, cast(0 as bigint), cast(null as bigint), cast(null as varchar), cast(0 as bigint), cast(0 as bigint), cast(0 as bigint), cast(coalesce(c.points, 0) as bigint)
from (select distinct key from pn) k left join shop_customers c on c.customer_id = k.key
union all
select n.key, n.rn, n.seq, n.channel, n.amount, n.earn, w.aft,
  case when n.channel in ('complete', 'manual') then w.aft + n.amount when n.channel = 'revert' then greatest(0, w.aft - n.amount)
       when w.aft >= n.amount then w.aft - n.amount + n.earn else w.aft end
from pw w join pn n on n.key = w.key and n.rn = w.rn + 1""",
            ),
        ],
        """select key, seq, channel, amount, earn, channel not in ('order', 'counter', 'quick') or bef >= amount as accepted, aft as balance_after,
  case when channel in ('order', 'counter', 'quick') and bef < amount then 'insufficient_balance' end as reason from pw where rn > 0""",
    ),
    "stock_after_takes": with_ctes(
        S + [
            (
                "takes",
                """select product_id, cast((select max(cast(o_orderdate as date)) from orders) - cast(product_id % 40 as integer) as timestamp) as ts, product_id * 7 % 60 as set_qty
from shop_products where product_id % 4 <> 1""",
            ),
            (
                "ordered",
                """select i.product_id, sum(case when o.status = 'CANCELLED' then 0 else i.quantity end) as q
from shop_items i join shop_orders o on i.order_id = o.order_id left join takes t on t.product_id = i.product_id
where t.ts is null or o.order_date > t.ts group by i.product_id""",
            ),
            ("pos", "select p.product_id, coalesce(t.set_qty, p.stock) - coalesce(a.q, 0) as stock from shop_products p left join takes t using (product_id) left join ordered a using (product_id)"),
        ],
        "select product_id, cast(stock as bigint) as stock, case when stock <= 0 then 'SOLD_OUT' when stock <= 5 then 'LOW' else 'OK' end as badge from pos",
    ),
    "payment_points": with_ctes(
        S,
        """select order_id, cast(floor(total_amount * 0.03) as integer) as completion_points,
  greatest(total_amount - cast(points_used as decimal(18,2)), 0) as net_paid,
  cast(floor(greatest(total_amount - cast(points_used as decimal(18,2)), 0) * 0.03) as integer) as counter_points,
  cast(floor(total_amount * 0.05) as integer) as manual_points,
  case when status = 'CANCELLED' then 'CANCELLED' else 'ACTIVE' end as order_badge
from shop_orders""",
    ),
    "phone_digits": with_ctes(
        S,
        """select customer_id, concat('(', substr(phone, 1, 3), '-', substr(phone, 4, 4), '-', substr(phone, 8, 4), ')') as shown,
  phone as digits from shop_customers""",
    ),
    "valid_iso_dates": with_ctes(
        RAW_LEDGER_CTES,
        """select raw_date, coalesce(regexp_matches(raw_date, '^\\d{4}-\\d{2}-\\d{2}$') and try_strptime(raw_date, '%Y-%m-%d') is not null, false) as is_valid
from (select distinct raw_date from raw_ledger)""",
    ),
    "shop_open": with_ctes(
        [ACTIONS_CTE],
        """select seq, ts, isodow(ts) <> 2 and strftime(ts, '%H:%M:%S.%f') > '09:00:00.000000'
  and strftime(ts, '%H:%M:%S.%f') < '17:00:00.000000' as is_open from actions""",
    ),
}
