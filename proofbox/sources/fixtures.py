"""Reference-shaped views derived from the driver tables.

These are the inputs the operators expect (a signed point-of-sale ledger, a
shop catalogue, orders and an action log), derived by Spark from the given
tables so that every query's work grows with them. The rules are fixed so the
DuckDB oracle can rebuild the same rows (see ``plans/sql_fixtures.py``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofbox.sources.tables import read_table

EPOCH = "1995-01-01"


def _dayno(d: Column) -> Column:
    return F.datediff(d, F.lit(EPOCH).cast("date"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed ledger: one row per line item; returned lines are negative (waste).

    Columns: date, product, qty, sales decimal(18,2), temp_avg, temp_max, temp_min,
    weather, line_ord (input order, used by first-valid aggregates).
    """
    return ledger_from(read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "part"))


def ledger_from(lineitem: DataFrame, part_table: DataFrame) -> DataFrame:
    """The ledger rule over any lineitem frame (batch or streaming) and the part table."""
    li = lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"
    )
    part = part_table.select("p_partkey", "p_type")
    returned = F.col("l_returnflag") == "R"
    base = li.join(part, li.l_partkey == part.p_partkey, "inner").select(
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("p_type").alias("product"),
        F.when(returned, -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("qty"),
        F.when(returned, -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")).cast("decimal(18,2)").alias("sales"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_ord"),
    )
    with_temp = base.withColumn("temp_avg", temperature_of(F.col("date")))
    t = F.col("temp_avg")
    return with_temp.select(
        "date",
        "product",
        "qty",
        "sales",
        "temp_avg",
        (t + 5).alias("temp_max"),
        (t - 5).alias("temp_min"),
        weather_of(F.col("date"), t).alias("weather"),
        "line_ord",
    )


def temperature_of(d: Column) -> Column:
    """The fixture's daily mean temperature: a fixed rule on the day number."""
    dayno = _dayno(d)
    return ((dayno * 7) % 41 - 8 + F.lit(0.5) * (dayno % 3)).cast("double")


def weather_of(d: Column, temp: Column) -> Column:
    dayno = _dayno(d)
    return F.when(temp < 0, "Snow").when(dayno % 10 < 3, "Rainy").when(dayno % 10 < 6, "Cloudy").otherwise("Sunny")


def forecast_requests(daily: DataFrame, horizon: int = 7) -> DataFrame:
    """Requests per product, with the day's weather and temperature from the fixture's rule.

    The ``horizon`` days after the panel's last day; the tenth day after the product's first one ('inside': answered
    from what came before); the day before its first one and a product that does not exist ('before', 'unknown': no
    history); a date in another format and one that does not exist ('format', 'no_day': rejected).
    """
    p = daily.groupBy("product").agg(F.min("date").alias("first")).withColumn("last", daily.select(F.max("date")).scalar())
    ahead = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda k: F.struct(F.date_format(F.date_add("last", k), "yyyy-MM-dd").alias("tag"), F.date_add("last", k).alias("d")))
    next_day = F.date_add("last", 1)
    other = [("inside", F.date_add("first", 10)), ("before", F.date_sub("first", 1)), ("unknown", next_day), ("format", next_day), ("no_day", next_day)]
    tags = F.concat(ahead, F.array(*[F.struct(F.lit(tag).alias("tag"), d.alias("d")) for tag, d in other]))
    r = p.select("product", F.explode(tags).alias("x")).select("product", "x.tag", "x.d")
    t = temperature_of(F.col("d"))
    text = F.when(F.col("tag") == "format", F.date_format("d", "yyyy/MM/dd")).when(F.col("tag") == "no_day", "2001-02-30").otherwise(F.date_format("d", "yyyy-MM-dd"))
    return r.select(
        F.concat_ws(":", "product", "tag").alias("request_id"),
        F.when(F.col("tag") == "unknown", F.concat("product", F.lit(" (gone)"))).otherwise(F.col("product")).alias("product"),
        text.alias("target_date"),
        weather_of(F.col("d"), t).alias("forecast_weather"),
        t.alias("forecast_temp"),
    )


def raw_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger as the point-of-sale export writes it: Korean headers, text fields.

    Some rows carry defects so cleaning has work to do (fixed rules on the day
    number and the quantity): every 97th day a bad date, every 89th a bad qty,
    every 83rd the compact ``yyyyMMdd`` form, every 79th a missing product.
    """
    lg = ledger(spark, sf_dir)
    dayno = _dayno(F.col("date"))
    qint = F.col("qty").cast("long")
    iso = F.date_format("date", "yyyy-MM-dd")
    date_txt = (
        F.when(dayno % 97 == 0, F.lit("not-a-date"))
        .when(dayno % 83 == 0, F.date_format("date", "yyyyMMdd"))
        .otherwise(iso)
    )
    qty_txt = F.when((dayno + qint) % 89 == 0, F.lit("n/a")).otherwise(F.col("qty").cast("string"))
    product = F.when((dayno + qint) % 79 == 0, F.lit(None).cast("string")).otherwise(F.col("product"))
    return lg.select(
        date_txt.alias("No."),
        product.alias("상품명"),
        qty_txt.alias("수량"),
        F.col("sales").cast("string").alias("실매출"),
        "weather",
        "temp_avg",
        "temp_max",
        "temp_min",
        "line_ord",
    )


def varied_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ledger as an export whose weather and temperature differ from line to line of a day, some missing, with the landing
    (0 to 3) of the file each line stands in. Inside a landing lines stand in the order of all their columns."""
    lg = ledger_landings(spark, sf_dir)
    k = F.col("line_ord")
    return lg.select(
        "landing",
        F.date_format("date", "yyyy-MM-dd").alias("No."),
        F.col("product").alias("상품명"),
        F.col("qty").cast("string").alias("수량"),
        F.col("sales").cast("string").alias("실매출"),
        F.when(k % 3 != 0, F.concat("weather", F.lit(" "), (k % 5).cast("string"))).alias("weather"),
        F.when(k % 4 != 0, F.col("temp_avg") + k % 7).alias("temp_avg"),
        F.when(k % 5 != 0, F.col("temp_max") + k % 3).alias("temp_max"),
        F.when(k % 2 != 0, F.col("temp_min")).alias("temp_min"),
        k.alias("line"),
    )


EXPORT_ORDER = ["No.", "상품명", "line", "수량", "실매출"]


# ---------------------------------------------------------------- shop side

def shop_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice", "p_size")
    m = F.col("p_partkey") % 4
    return p.select(
        F.col("p_partkey").alias("product_id"),
        F.concat("p_name", F.when(F.col("p_partkey") % 11 == 0, " 라떼").when(F.col("p_partkey") % 13 == 0, " 아메리카노").otherwise("")).alias("name"),
        F.col("p_retailprice").cast("decimal(18,2)").alias("price"),
        (F.col("p_size") * 4).cast("int").alias("stock"),
        F.when(m == 0, "HARD").when(m == 1, "SOFT").when(m == 2, "ALL").alias("category"),
    )


def phone_of(key: Column) -> Column:
    return F.concat(F.lit("010"), F.lpad(key.cast("string"), 8, "0"))


def shop_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return c.filter(F.col("c_custkey") % 7 != 0).select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("name"),
        phone_of(F.col("c_custkey")).alias("phone"),
        F.greatest(F.lit(0), F.floor("c_acctbal")).cast("int").alias("points"),
    )


def shop_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    k = F.col("o_orderkey")
    total = F.col("o_totalprice").cast("decimal(18,2)")
    return o.select(
        k.alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        phone_of(F.col("o_custkey")).alias("phone"),
        F.col("o_orderdate").alias("order_date"),
        F.when(k % 10 == 0, "CANCELLED")
        .when(F.col("o_orderstatus") == "O", "PENDING")
        .when(F.col("o_orderstatus") == "P", "PROCESSING")
        .otherwise("COMPLETED")
        .alias("status"),
        total.alias("total_amount"),
        ((k * 37) % 500).cast("int").alias("points_used"),
        F.when((k % 10 != 0) & (F.col("o_orderstatus") == "F"), F.floor(total * F.lit(0.03)).cast("int"))
        .otherwise(F.lit(0))
        .alias("points_earned"),
    )


def shop_items(spark: SparkSession, sf_dir: str, with_orphans: bool = False) -> DataFrame:
    return shop_items_from(read_table(spark, sf_dir, "lineitem"), with_orphans)


def shop_items_from(lineitem: DataFrame, with_orphans: bool = False) -> DataFrame:
    """Order lines from any lineitem frame (batch or streaming)."""
    li = lineitem.select("l_orderkey", "l_partkey", "l_quantity")
    pid = F.col("l_partkey")
    if with_orphans:
        pid = F.when(F.col("l_orderkey") % 50 == 0, pid + 10000000).otherwise(pid)
    return li.select(
        F.col("l_orderkey").alias("order_id"),
        pid.alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
    )


def order_forms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(orders, items) as forms are sent in: every order, some with a defect that one rule each is there for."""
    k = F.col("order_id")
    o = shop_orders(spark, sf_dir).select(
        "order_id",
        F.when(k % 17 == 0, F.substring("phone", 1, 7)).when(k % 19 == 0, F.lit(None).cast("string")).otherwise(F.col("phone")).alias("phone"),
        F.when(k % 23 == 0, F.repeat(F.lit("m"), 501)).when(k % 5 == 0, "no onions").alias("memo"),
        F.when(k % 29 == 0, F.lit(-5)).otherwise(F.col("points_used")).alias("points_used"),
        F.when(k % 31 == 0, F.lit(0)).when(k % 37 == 0, F.lit(500001)).otherwise(F.col("total_amount")).cast("decimal(18,2)").alias("total_amount"),
    )
    i = shop_items(spark, sf_dir).where(k % 41 != 0)
    return o, i.withColumn("quantity", F.when(k % 43 == 0, F.lit(0)).otherwise(F.col("quantity")))


def payment_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counter payment per order, some with a defect: form_id, phone, amount, method, points_used."""
    k = F.col("order_id")
    return shop_orders(spark, sf_dir).select(
        k.alias("form_id"),
        F.when(k % 17 == 0, " ").when(k % 19 == 0, F.lit(None).cast("string")).otherwise(F.col("phone")).alias("phone"),
        F.when(k % 23 == 0, F.lit(None)).when(k % 31 == 0, F.lit(-1)).when(k % 37 == 0, F.lit(500001)).otherwise(F.col("total_amount")).cast("decimal(18,2)").alias("amount"),
        F.when(k % 41 == 0, F.lit(None).cast("string")).when(k % 2 == 0, "CASH").otherwise("CARD").alias("method"),
        F.when(k % 29 == 0, F.lit(-5)).otherwise(F.col("points_used")).alias("points_used"),
    )


def stock_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stock-take per product, some with a defect: form_id, product_id, quantity."""
    k = F.col("product_id")
    return shop_products(spark, sf_dir).select(
        k.alias("form_id"), F.when(k % 17 != 0, k).alias("product_id"), F.when(k % 19 == 0, F.lit(-1)).otherwise((k * 7 % 60).cast("int")).alias("quantity")
    )


def stock_takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute stock counts of all products but every fourth, in the 40 days before the last order: product_id, ts, set_qty."""
    last = read_table(spark, sf_dir, "orders").select(F.max("o_orderdate").cast("date")).scalar()
    k = F.col("product_id")
    return shop_products(spark, sf_dir).where(k % 4 != 1).select("product_id", F.date_sub(last, (k % 40).cast("int")).cast("timestamp_ntz").alias("ts"), (k * 7 % 60).cast("int").alias("set_qty"))


def point_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What moves points, per order: by order key, an order that is completed, one that is reverted after that, a counter payment, a quick
    payment or a manual credit. customer_id, ts, request_id, channel, amount, points_used, points_earned."""
    o = shop_orders(spark, sf_dir)
    k = F.col("order_id")
    used = F.when(k % 7 == 0, F.col("points_used") * 400).otherwise(F.col("points_used"))
    steps = (
        F.when(k % 5 == 0, F.array(F.lit("order"), F.lit("complete"))).when(k % 5 == 1, F.array(F.lit("order"), F.lit("complete"), F.lit("revert")))
        .when(k % 5 == 2, F.array(F.lit("counter"))).when(k % 5 == 3, F.array(F.lit("quick"))).otherwise(F.array(F.lit("manual")))
    )
    amount = F.col("total_amount")
    return o.select("customer_id", "order_id", F.col("order_date").alias("ts"), amount.alias("amount"), used.alias("points_used"), F.floor(amount * F.lit(0.03)).cast("int").alias("points_earned"),
                    F.posexplode(steps).alias("step", "channel")).select(
        "customer_id", "ts", (k * 4 + F.col("step")).alias("request_id"), "channel", "amount", "points_used", "points_earned"
    )


# Action mapping for the order/stock action log (fixed values):
# purchase -> create, click -> confirm, view -> complete, error -> cancel, signup -> credit
ACTION_OF_EVENT = {
    "purchase": "create",
    "click": "confirm",
    "view": "complete",
    "error": "cancel",
    "signup": "credit",
}


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Action log keyed by user: (key, ts, seq, action, amount)."""
    return actions_from(read_table(spark, sf_dir, "events"))


def actions_from(events: DataFrame) -> DataFrame:
    """The action mapping over any events frame (batch or streaming)."""
    ev = events.select("event_id", "ts", "user_id", "event_type", "value")
    mapping = F.create_map(*[x for kv in ACTION_OF_EVENT.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return ev.select(
        F.col("user_id").alias("key"),
        F.col("ts").alias("ts"),
        F.col("event_id").alias("seq"),
        mapping[F.col("event_type")].alias("action"),
        F.col("value").alias("amount"),
    )


# ---------------------------------------------------------------- landings

LANDINGS = 4


def _landing(part: Column, ordinal: Column) -> Column:
    """The landing (0 to 3) a row arrives with: its time's own, one later for every 11th row, two later for every 13th."""
    straggle = F.when(ordinal % 13 == 0, 2).when(ordinal % 11 == 0, 1).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(LANDINGS - 1), part + straggle)).cast("int")


def ledger_landings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ledger with the landing each line arrives with: two years a landing, stragglers later."""
    lg = ledger(spark, sf_dir)
    return lg.withColumn("landing", _landing(F.floor((F.year("date") - 1995) / 2), F.col("line_ord")))


def action_landings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole action log with the landing each action arrives with: eight days of a month a landing, stragglers later."""
    a = actions(spark, sf_dir)
    return a.withColumn("landing", _landing(F.floor((F.dayofmonth("ts") - 1) / 8), F.col("seq")))
