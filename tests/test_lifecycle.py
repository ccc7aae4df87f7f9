"""Order lifecycle (segmented scan) and sequential admission against brute force."""

import datetime as dt
import random

from pyspark.sql import functions as F

from proofbox.operators import lifecycle as lc
from proofbox.operators import transfer as tf
from proofbox.streaming.event_time import life_step as _life_step


def _actions(n_keys=6, n=400, seed=11):
    rnd = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    acts = ["create", "confirm", "complete", "cancel", "credit"]
    rows = []
    for i in range(n):
        k = rnd.randrange(n_keys) if rnd.random() > 0.3 else 0  # key 0 is hot
        ts = start + dt.timedelta(hours=rnd.randrange(24 * 10))
        rows.append((k, ts, i, rnd.choice(acts), float(rnd.randint(0, 40))))
    return rows


def _brute_life(rows):
    out = {}
    by_key = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if r[3] not in lc.LIFECYCLE_ACTIONS:
            continue
        st = by_key.get(r[0], lc.NONE)
        after, ok, note = _life_step(st, r[3])
        out[r[2]] = (st, after, ok, note)
        by_key[r[0]] = after
    return out


def test_lifecycle_scan_matches_sequential(spark):
    rows = _actions()
    df = spark.createDataFrame(rows, "key long, ts timestamp_ntz, seq long, action string, amount double")
    got = {r.seq: (r.status_before, r.status_after, r.accepted, r.note) for r in lc.order_lifecycle(df, bucket="day").collect()}
    assert got == _brute_life(rows)
    got_h = {r.seq: (r.status_before, r.status_after, r.accepted, r.note) for r in lc.order_lifecycle(df, bucket="hour").collect()}
    assert got_h == got


def test_admission_matches_sequential(spark):
    rows = _actions(seed=5)
    df = spark.createDataFrame(rows, "key long, ts timestamp_ntz, seq long, action string, amount double")
    moves = lc.point_moves_from_actions(df)
    got = {r.seq: (r.accepted, r.balance_after) for r in lc.admit(moves).collect()}
    bal, want = {}, {}
    kind = {"credit": "deposit", "create": "withdraw", "cancel": "revert"}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if r[3] not in kind:
            continue
        b, a = bal.get(r[0], 0), int(r[4])
        k = kind[r[3]]
        if k == "deposit":
            b, ok = b + a, True
        elif k == "withdraw":
            ok = b >= a
            b = b - a if ok else b
        else:
            b, ok = max(0, b - a), True
        bal[r[0]] = b
        want[r[2]] = (ok, b)
    assert got == want


def test_cancel_restocks(spark):
    from proofbox.operators import retail as rt

    products = spark.createDataFrame([(1, "Loaf", 10)], "product_id long, name string, stock int")
    orders = spark.createDataFrame([(7, dt.datetime(2024, 1, 1, 10), "CANCELLED")], "order_id long, order_date timestamp_ntz, status string")
    items = spark.createDataFrame([(7, 1, 2)], "order_id long, product_id long, quantity int")
    r = rt.stock_position(products, rt.stock_moves(items, orders)).first()
    assert r.stock == 10  # ordered 2, cancelled: 2 back
    orders2 = spark.createDataFrame([(7, dt.datetime(2024, 1, 1, 10), "COMPLETED")], "order_id long, order_date timestamp_ntz, status string")
    assert rt.stock_position(products, rt.stock_moves(items, orders2)).first().stock == 8
    sets = spark.createDataFrame([(1, dt.datetime(2024, 1, 2), 12)], "product_id long, ts timestamp_ntz, set_qty int")
    assert rt.stock_position(products, rt.stock_moves(items, orders2), sets).first().stock == 12


def test_admission_with_opening_balances(spark):
    moves = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 1, 9), 1, "withdraw", 30), (1, dt.datetime(2024, 1, 1, 10), 2, "withdraw", 30),
         (1, dt.datetime(2024, 1, 1, 11), 3, "revert", 100), (2, dt.datetime(2024, 1, 1, 9), 4, "withdraw", 1)],
        "key long, ts timestamp_ntz, seq long, kind string, amount long",
    )
    opening = spark.createDataFrame([(1, 50)], "key long, opening long")
    got = {r.seq: (r.accepted, r.balance_after, r.reason) for r in lc.admit(moves, opening).collect()}
    assert got == {1: (True, 20, None), 2: (False, 20, "insufficient_balance"), 3: (True, 0, None),
                   4: (False, 0, "insufficient_balance")}


def test_transfer_functions_equal_replay():
    rnd = random.Random(1)
    for _ in range(200):
        n = rnd.randrange(0, 120)
        kinds = [rnd.choice(["deposit", "withdraw", "revert", "other"]) for _ in range(n)]
        amounts = [rnd.randint(-3, 40) for _ in range(n)]
        f = tf.of_moves(kinds, amounts)
        cut = rnd.randrange(0, n + 1)
        joined = tf.then(tf.of_moves(kinds[:cut], amounts[:cut]), tf.of_moves(kinds[cut:], amounts[cut:]))
        for opening in [*range(-60, 400, 7), 10**9]:
            closing = tf.replay(kinds, amounts, opening)[3]
            assert f(opening) == closing == joined(opening)


def _moves(n, seed, hot):
    rnd = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        key = 3 if rnd.random() < hot else rnd.randrange(40)
        rows.append((key, start + dt.timedelta(minutes=rnd.randrange(9000)), i, rnd.choice(["deposit", "withdraw", "withdraw", "revert", "gift"]), rnd.randint(0, 60)))
    return rows


def _admit_in_order(rows, opening):
    balance, want = dict(opening), {}
    for key, _, seq, kind, amount in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        (ok,), (after,), (reason,), balance[key] = tf.replay([kind], [amount], balance.get(key, 0))
        want[seq] = (ok, after, reason)
    return want


def test_admission_of_a_hot_key_over_many_runs(spark):
    rows = _moves(4000, 3, 0.5)
    rows += [(None, dt.datetime(2024, 1, 1), 9000, "deposit", 5)]
    df = spark.createDataFrame(rows, "key long, ts timestamp_ntz, seq long, kind string, amount long").repartition(5)
    opening = {k: 17 * k for k in range(0, 40, 3)}
    given = spark.createDataFrame([*opening.items(), (None, 3)], "key long, opening long")
    want = _admit_in_order(rows[:-1], opening)
    for partitions, run_rows in ((8, 16), (3, 512), (1, 7), (40, 100_000)):
        got = {r.seq: (r.accepted, r.balance_after, r.reason) for r in lc.admit(df, given, partitions, run_rows).collect()}
        assert got == want, (partitions, run_rows)


def test_admission_of_one_key_and_of_none(spark):
    rows = [(1, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), i, "withdraw" if i % 3 else "deposit", 10) for i in range(300)]
    df = spark.createDataFrame(rows, "key long, ts timestamp_ntz, seq long, kind string, amount long")
    for partitions, run_rows in ((4, 10), (1, 300), (1, 299), (2, 1)):
        got = {r.seq: (r.accepted, r.balance_after, r.reason) for r in lc.admit(df, None, partitions, run_rows).collect()}
        assert got == _admit_in_order(rows, {}), (partitions, run_rows)
    assert lc.admit(df.where("key > 5")).collect() == []


def test_a_hot_key_is_spread_over_tasks(spark):
    """Half of the moves are of one key; no task replays half of them."""
    rows = _moves(4000, 8, 0.5)
    df = spark.createDataFrame(rows, "key long, ts timestamp_ntz, seq long, kind string, amount long")
    ordered = df.repartitionByRange(8, "key", "ts", "seq").select("key", F.spark_partition_id().alias("part"))
    hot = [r["count"] for r in ordered.where("key = 3").groupBy("part").count().collect()]
    assert len(hot) >= 4 and max(hot) < sum(hot) / 2
