"""Menu availability, shop hours, badges, names and record rules."""

import datetime as dt

from pyspark.sql import functions as F

from proofbox.functions import exprs as ex
from proofbox.operators import retail as rt


def test_menu_by_weekday(spark):
    cats = ["HARD", "HARD", "SOFT", "SOFT", "SOFT", "ALL", "ALL"]
    products = spark.createDataFrame([(i, c) for i, c in enumerate(cats)], "id int, category string")
    monday = dt.date(2024, 1, 1)
    counts = {}
    for k in range(7):
        d = monday + dt.timedelta(days=k)
        counts[d.strftime("%a")] = products.filter(ex.available_on("category", F.lit(d))).count()
    assert counts == {"Mon": 5, "Tue": 2, "Wed": 5, "Thu": 4, "Fri": 4, "Sat": 4, "Sun": 5}


def test_shop_hours(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2024, 1, 1, 9, 0, 0),), (dt.datetime(2024, 1, 1, 9, 0, 1),), (dt.datetime(2024, 1, 1, 17, 0, 0),),
         (dt.datetime(2024, 1, 2, 12, 0, 0),)], "ts timestamp_ntz")
    assert [r.o for r in df.select(ex.is_open("ts").alias("o")).collect()] == [False, True, False, False]


def test_points_and_names(spark):
    df = spark.createDataFrame([(199.99, 0, "01012345678", ""), (10.0, 50, "0105551234", "Kim")],
                               "total double, used int, phone string, name string")
    df = df.withColumn("total", F.col("total").cast("decimal(18,2)"))
    r = df.select(ex.points_for("total").alias("p"), ex.net_paid("total", F.col("used").cast("decimal(18,2)")).alias("n"),
                  rt.default_name("name").alias("d"), rt.counter_name("phone").alias("c"), rt.manual_name("phone").alias("m")).collect()
    assert r[0].p == 5 and r[0].d == "Guest" and r[0].c == "Guest 5678" and r[0].m == "Walk-in 01012345678"
    assert float(r[1].n) == 0.0 and r[1].d == "Kim"


def test_record_rules(spark):
    orders = spark.createDataFrame([(1, "010-1234", 0, 600000.0), (2, "01012345678", -1, 100.0)],
                                   "order_id long, phone string, points_used int, total_amount double")
    items = spark.createDataFrame([(2, 5, 0)], "order_id long, product_id long, quantity int")
    got = {(r.order_id, r.rule) for r in rt.order_rule_violations(orders, items).collect()}
    assert got == {(1, "phone_format"), (1, "no_items"), (1, "amount_out_of_range"), (2, "quantity_below_1"), (2, "negative_points")}


def test_phone_digits_and_badges(spark):
    df = spark.createDataFrame([("(010) 1234-5678", 0), ("010 9", 3), ("x", 9)], "p string, s int")
    r = df.select(ex.phone_digits("p").alias("d"), ex.stock_badge("s").alias("b")).collect()
    assert [x.d for x in r] == ["01012345678", "0109", ""] and [x.b for x in r] == ["SOLD_OUT", "LOW", "OK"]


def test_every_rule_label_and_default_occurs_in_the_fixtures(spark):
    """Green rows of the registered queries reach every code, badge, label and outcome."""
    from proofbox.operators import retail as rt
    from proofbox.plans import all_queries

    sf, q = "/root/testdata/sf0.01", all_queries()
    codes = {r.codes for r in q["form_violations"](spark, sf).select("form", F.explode(F.split("codes", ",")).alias("codes")).where("codes <> ''").collect()}
    assert codes == {c for kind in ("payment", "points", "stock") for c in rt.rule_set(kind)}
    assert {r.rule for r in q["rule_violations"](spark, sf).select("rule").distinct().collect()} == set(rt.rule_set("order"))
    assert {r.badge for r in q["stock_after_takes"](spark, sf).select("badge").distinct().collect()} == {"OK", "LOW", "SOLD_OUT"}
    assert {r.is_drink for r in q["menu_order"](spark, sf).select("is_drink").distinct().collect()} == {True, False}
    got = {(r.channel, r.accepted) for r in q["point_channels"](spark, sf).select("channel", "accepted").distinct().collect()}
    assert {c for c, _ in got} == {"order", "complete", "revert", "counter", "quick", "manual"}
    assert {("order", False), ("counter", False), ("quick", False)} <= got


def test_payments_earn_only_when_they_are_covered(spark):
    import datetime as dt

    from proofbox.operators import lifecycle as lc
    from proofbox.operators import retail as rt

    t = dt.datetime(2024, 1, 1)
    rows = [(1, t, 1, "manual", 1000.0, 0, 0), (1, t, 2, "counter", 1000.0, 60, 0), (1, t, 3, "counter", 30.0, 50, 0), (1, t, 4, "quick", 10.0, 45, 0), (1, t, 5, "order", 0.0, 30, 0),
            (1, t, 6, "complete", 200.0, 0, 0), (1, t, 7, "revert", 0.0, 0, 100), (1, t, 8, "quick", -100.0, 0, 0)]
    req = spark.createDataFrame(rows, "customer_id long, ts timestamp_ntz, request_id long, channel string, amount double, points_used int, points_earned int")
    moves = rt.channel_moves(req.withColumn("amount", F.col("amount").cast("decimal(18,2)")))
    for run_rows in (2, 100):
        got = {r.seq: (r.accepted, r.balance_after) for r in lc.admit(moves, None, 3, run_rows).collect()}
        # 50; 60 > 50; -50 + 0; 45 > 0; 30 > 0; +6; max(0, 6 - 100); -0 + trunc(-3)
        assert got == {1: (True, 50), 2: (False, 50), 3: (True, 0), 4: (False, 0), 5: (False, 0), 6: (True, 6), 7: (True, 0), 8: (True, -3)}
