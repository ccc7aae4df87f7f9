"""Orders, stock and loyalty points as set-based DataFrame operators.

Read side of the shop: valuation joins, lookups, balances, histories and
record rules (B14-B20, C1-C4, C8-C11, D11-D13, E12, F2, F3, H11, H13).
Joins are plain equi-joins; Spark picks broadcast only when a side's
measured size is under ``spark.sql.autoBroadcastJoinThreshold`` (and AQE
re-plans at runtime), otherwise a sort-merge join with AQE skew splitting.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofbox.functions.exprs import available_on, net_paid, order_badge, points_for, stock_badge

# Menu keywords that mark a drink (drinks sort last on the menu).
DRINK_KEYWORDS = ["라떼", "아메리카노"]
# Loyalty rates per channel (completion, counter payment, manual add).
RATE_COMPLETION = "0.03"
RATE_COUNTER = "0.03"
RATE_MANUAL = "0.05"
# Limits of the request forms.
PHONE_PATTERN = r"^[0-9]{10,11}$"
MAX_AMOUNT = 500000
MAX_MEMO = 500


# ------------------------------------------------------------------ joins

def order_totals(items: DataFrame, products: DataFrame) -> DataFrame:
    """line = price at purchase x quantity; order total and item count.

    Items whose product does not exist drop out of the inner join; use
    ``orphan_items`` to report them. Aggregation is partial + final.
    """
    lines = items.join(products.select("product_id", "price"), "product_id", "inner").select(
        "order_id", "product_id", "quantity", F.col("price").alias("price_at_purchase"),
        (F.col("price") * F.col("quantity")).alias("line_total"),
    )
    return lines.groupBy("order_id").agg(
        F.sum("line_total").alias("total_amount"),
        F.count(F.lit(1)).alias("n_items"),
        F.sum("quantity").alias("n_units"),
    )


def customer_points(phones: DataFrame, customers: DataFrame) -> DataFrame:
    """Points per phone; unknown phone -> 0."""
    c = customers.select("phone", "points")
    return phones.join(c, "phone", "left").select("phone", F.coalesce("points", F.lit(0)).alias("points"))


def orders_by_phone(orders: DataFrame, phones: DataFrame) -> DataFrame:
    """Orders of the given phones, newest first (range-partitioned sort, skew-tolerant)."""
    o = orders.join(phones.select("phone").distinct(), "phone", "left_semi")
    return o.orderBy("phone", F.desc("order_date"), F.desc("order_id"))


def orders_by_customer(orders: DataFrame, ids: DataFrame, key: str = "customer_id") -> DataFrame:
    """C4: orders of the given customer ids (left semi-join)."""
    return orders.join(ids.select(key), key, "left_semi")


def default_name(given: Column | str | None = None, existing: Column | str | None = None) -> Column:
    """Given name if non-empty, else existing, else 'Guest'."""
    parts = []
    if given is not None:
        g = F.col(given) if isinstance(given, str) else given
        parts.append(F.when(F.length(g) > 0, g))
    if existing is not None:
        parts.append(F.col(existing) if isinstance(existing, str) else existing)
    parts.append(F.lit("Guest"))
    return F.coalesce(*parts)


def counter_name(phone: Column | str) -> Column:
    """B18, counter payments: 'Guest ' + last four digits."""
    p = F.col(phone) if isinstance(phone, str) else phone
    return F.concat(F.lit("Guest "), F.substring(p, -4, 4))


def manual_name(phone: Column | str) -> Column:
    """B18, manual point grants: 'Walk-in ' + phone."""
    p = F.col(phone) if isinstance(phone, str) else phone
    return F.concat(F.lit("Walk-in "), p)


def new_customers(orders: DataFrame, customers: DataFrame, name: Column | None = None) -> DataFrame:
    """Phones seen in orders but unknown as customers -> new customers with 0 points."""
    # de-duplicate first (map-side partial aggregation), then anti-join the much smaller phone set
    unknown = orders.select("phone").dropDuplicates(["phone"]).join(customers.select("phone"), "phone", "left_anti")
    return unknown.select("phone", (name if name is not None else default_name()).alias("name"), F.lit(0).alias("points"))


def orphan_items(items: DataFrame, products: DataFrame) -> DataFrame:
    """Items whose product does not exist (left anti-join)."""
    return items.join(products.select("product_id"), "product_id", "left_anti")


def lookup(df: DataFrame, key: str, values: DataFrame | Sequence) -> DataFrame:
    """Rows whose key is in ``values`` (a DataFrame -> semi-join; a short list -> IN filter)."""
    if isinstance(values, DataFrame):
        return df.join(values.select(key).distinct(), key, "left_semi")
    return df.filter(F.col(key).isin(list(values)))


def order_status(ids: DataFrame, orders: DataFrame, key: str = "order_id") -> DataFrame:
    """C11: status of each requested id; unknown id -> 'UNKNOWN'."""
    return ids.select(key).join(orders.select(key, "status"), key, "left").select(
        key, F.coalesce("status", F.lit("UNKNOWN")).alias("status")
    )


# ------------------------------------------------------------------ aggregates

def status_counts(orders: DataFrame) -> DataFrame:
    """Orders per status (the pending count is the PENDING row)."""
    return orders.groupBy("status").agg(F.count(F.lit(1)).alias("n_orders"))


def point_moves(orders: DataFrame) -> DataFrame:
    """Point movements per order, one row: points used when ordered, earned when completed (null: none)."""
    return orders.select("customer_id", "order_id", "order_date", F.col("points_used").alias("used"), F.when(F.col("points_earned") != 0, F.col("points_earned")).alias("earned"))


def points_balance(moves: DataFrame, customers: DataFrame) -> DataFrame:
    """D12 (no floor): opening points + movements, per customer (partial aggregation; the orders are read once)."""
    g = moves.groupBy("customer_id").agg(F.sum("used").alias("points_used"), F.sum("earned").alias("points_earned"))
    c = customers.select("customer_id", F.col("points").alias("opening_points"))
    used, earned = F.coalesce("points_used", F.lit(0)).cast("long"), F.coalesce("points_earned", F.lit(0)).cast("long")
    return g.join(c, "customer_id", "full").select(
        "customer_id", F.coalesce("opening_points", F.lit(0)).alias("opening_points"), used.alias("points_used"), earned.alias("points_earned"),
        (F.coalesce("opening_points", F.lit(0)) - used + earned).cast("long").alias("balance"),
    )


def channel_moves(requests: DataFrame) -> DataFrame:
    """D12, all channels: point moves (key, ts, seq, channel, kind, amount, earn) for ``lifecycle.admit``.

    ``requests``: customer_id, ts, request_id, channel, amount, points_used, points_earned. Channels:
    'order' withdraws the points used; 'complete' credits 3% of the order's total; 'counter' pays with points and earns 3% of
    what is left to pay (never below 0), only if the balance covers the points; 'quick' is the same without the floor on what is left; 'manual' credits
    5% of the amount; 'revert' takes back what was earned, down to 0. Points are truncated toward zero.
    """
    ch, used = F.col("channel"), F.col("points_used").cast("decimal(18,2)")
    kind = F.when(ch == "order", "withdraw").when(ch.isin("complete", "manual"), "deposit").when(ch.isin("counter", "quick"), "payment").when(ch == "revert", "revert")
    amount = (
        F.when(ch == "complete", points_for("amount", RATE_COMPLETION)).when(ch == "manual", points_for("amount", RATE_MANUAL)).when(ch == "revert", F.col("points_earned"))
        .otherwise(F.col("points_used"))
    )
    earn = F.when(ch == "counter", points_for(net_paid("amount", used), RATE_COUNTER)).when(ch == "quick", points_for(net_paid("amount", used, False), RATE_COUNTER)).otherwise(F.lit(0))
    return requests.select(F.col("customer_id").alias("key"), "ts", F.col("request_id").alias("seq"), "channel", kind.alias("kind"), amount.cast("long").alias("amount"), earn.cast("long").alias("earn"))


def stock_moves(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Stock deltas, one row per line: -quantity when ordered; none in the end when the order was cancelled (the lines are read and joined once)."""
    lines = items.join(orders.select("order_id", "order_date", "status"), "order_id", "inner")
    delta = F.when(F.col("status") == "CANCELLED", F.lit(0)).otherwise(-F.col("quantity"))
    return lines.select("product_id", F.col("order_date").alias("ts"), delta.alias("delta"))


def stock_position(products: DataFrame, moves: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """Opening stock + deltas; an absolute 'set stock' (product_id, ts, set_qty)
    restarts the count from that value, and only later deltas apply.

    Every step is a partial aggregate per product (``max_by`` for the last set),
    so a hot product never gathers its raw moves in one task.
    """
    base = products.select("product_id", F.col("stock").alias("opening_stock"))
    if sets is None:
        d = moves.groupBy("product_id").agg(F.sum("delta").alias("net_delta"))
        j = base.join(d, "product_id", "left")
        pos = F.col("opening_stock") + F.coalesce("net_delta", F.lit(0))
    else:
        last = sets.groupBy("product_id").agg(F.max("ts").alias("set_ts"), F.max_by("set_qty", "ts").alias("set_qty"))
        m = moves.join(last, "product_id", "left")
        d = m.groupBy("product_id").agg(
            F.sum(F.when(F.col("set_ts").isNull() | (F.col("ts") > F.col("set_ts")), F.col("delta")).otherwise(F.lit(0))).alias("net_delta")
        )
        j = base.join(last, "product_id", "left").join(d, "product_id", "left")
        start = F.coalesce("set_qty", "opening_stock")
        pos = start + F.coalesce("net_delta", F.lit(0))
    return j.select("product_id", pos.cast("long").alias("stock"), stock_badge(pos).alias("badge"))


# ------------------------------------------------------------------ windows and sorts

def points_history(orders: DataFrame, n: int = 5, key: str = "phone") -> DataFrame:
    """Last ``n`` non-cancelled orders per customer (date, points earned, used).

    ``row_number() <= n`` lets Spark insert a partial per-partition top-n
    (WindowGroupLimit) before the shuffle, so a hot customer moves at most n
    rows per map task.
    """
    w = Window.partitionBy(key).orderBy(F.desc("order_date"), F.desc("order_id"))
    live = orders.filter(F.col("status") != "CANCELLED")
    ranked = live.select(key, "order_id", "order_date", "points_earned", "points_used", F.row_number().over(w).alias("rank"))
    return ranked.filter(F.col("rank") <= n)


def orders_newest(orders: DataFrame) -> DataFrame:
    """all orders newest first (order id as tie-break)."""
    return orders.orderBy(F.desc("order_date"), F.desc("order_id"))


def is_drink(name: Column | str, keywords: Sequence[str] = DRINK_KEYWORDS) -> Column:
    n = F.col(name) if isinstance(name, str) else name
    hit = F.lit(False)
    for k in keywords:
        hit = hit | F.coalesce(n.contains(k), F.lit(False))
    return hit


def menu_order(products: DataFrame, keywords: Sequence[str] = DRINK_KEYWORDS) -> DataFrame:
    """non-drinks first, then stock descending (product id as tie-break)."""
    return products.withColumn("is_drink", is_drink("name", keywords)).orderBy("is_drink", F.desc("stock"), "product_id")


# ------------------------------------------------------------------ rules

def menu_availability(items: DataFrame, orders: DataFrame, products: DataFrame) -> DataFrame:
    """B14 in set form: was each ordered product on the menu on its order day?"""
    lines = items.join(orders.select("order_id", "order_date"), "order_id").join(
        products.select("product_id", "category"), "product_id"
    )
    return lines.select(
        "order_id", "product_id", F.col("order_date").cast("date").alias("order_day"), "category",
        available_on("category", F.col("order_date").cast("date")).alias("available"),
    )


def with_badges(products: DataFrame) -> DataFrame:
    return products.withColumn("stock_badge", stock_badge("stock"))


def blank(col: str) -> Column:
    return F.col(col).isNull() | (F.trim(col) == "")


def amount_rules(col: str) -> dict[str, Column]:
    return {"amount_missing": F.col(col).isNull(), "amount_not_positive": F.col(col) <= 0, "amount_above_limit": F.col(col) > MAX_AMOUNT}


def rule_set(kind: str) -> dict[str, Column]:
    """A form's rules as data, code -> condition under which a record breaks the rule."""
    if kind == "order":
        return {
            "phone_format": F.col("phone").isNull() | ~F.col("phone").rlike(PHONE_PATTERN),
            "memo_too_long": F.coalesce(F.length("memo"), F.lit(0)) > MAX_MEMO,
            "no_items": F.coalesce(F.col("n_items"), F.lit(0)) < 1,
            "quantity_below_1": F.col("min_qty") < 1,
            "negative_points": F.col("points_used") < 0,
            "amount_out_of_range": (F.col("total_amount") <= 0) | (F.col("total_amount") > MAX_AMOUNT),
        }
    if kind == "payment":
        return {"phone_missing": blank("phone"), **amount_rules("amount"), "method_missing": F.col("method").isNull(), "negative_points": F.col("points_used") < 0}
    if kind == "points":
        return {"phone_missing": blank("phone"), **amount_rules("amount")}
    if kind == "stock":
        return {"product_missing": F.col("product_id").isNull(), "negative_quantity": F.col("quantity") < 0}
    raise ValueError(f"unknown rule set {kind!r}")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``df`` with ``codes``: the rules each record breaks, in the rule set's order (an unknown condition breaks nothing)."""
    found = F.array(*[F.when(broken, F.lit(code)) for code, broken in rules.items()])
    return df.withColumn("codes", F.filter(found, lambda x: x.isNotNull()))


def order_rule_violations(orders: DataFrame, items: DataFrame) -> DataFrame:
    """One row per (order, broken rule). Items are counted with a partial aggregate."""
    per_order = items.groupBy("order_id").agg(F.count(F.lit(1)).alias("n_items"), F.min("quantity").alias("min_qty"))
    o = orders.join(per_order, "order_id", "left")
    if "memo" not in o.columns:
        o = o.withColumn("memo", F.lit(None).cast("string"))
    return violations(o, rule_set("order")).select("order_id", F.explode("codes").alias("rule"))


def payment_points(orders: DataFrame) -> DataFrame:
    """H11 + H13: points on completion (gross), net paid at the counter (floored) and its points."""
    net = net_paid("total_amount", F.col("points_used").cast("decimal(18,2)"))
    return orders.select(
        "order_id",
        points_for("total_amount", RATE_COMPLETION).alias("completion_points"),
        net.alias("net_paid"),
        points_for(net, RATE_COUNTER).alias("counter_points"),
        points_for("total_amount", RATE_MANUAL).alias("manual_points"),
        order_badge("status").alias("order_badge"),
    )
