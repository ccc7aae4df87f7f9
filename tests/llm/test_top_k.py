import numpy as np

from proofbox.llm.top_k import top_k


def brute(rows, k, every):
    live = [(i, [int(np.floor(256 * c)) for c in x]) for i, x in rows if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)]
    out = []
    for a, (q, v) in enumerate(live):
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(v, w)), c) for b, (c, w) in enumerate(live) if b != a)[:k]
            out += [(q, r, c, -s) for r, (s, c) in enumerate(best, 1)]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as block", "2 as score").repartition(3)
    return sorted(tuple(r) for r in top_k(df, **options).collect())


def test_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    spread = rng.normal(size=(400, 30)) * np.linspace(2, 0.05, 30) * rng.lognormal(0, 1, (400, 1))
    rows = [(i, x.astype(np.float32).tolist()) for i, x in enumerate(spread)]
    rows += [(1000 + i, rows[7][1]) for i in range(30)]  # ties
    rows += [(2000, None), (2050, [float("nan")] * 30), (2100, [None] * 30), (2150, [float("inf")] * 30), (None, rows[1][1]), (2200, [0.0] * 30), (50, rows[50][1]), (2250, rows[3][1][:5])]
    assert run(spark, rows, query_every=50, block_rows=40, query_rows=3) == brute(rows, 5, 50)


def test_few_rows_and_negative_scores(spark):
    rows = [(0, [1.0, 0.0]), (50, [-1.0, 0.0]), (3, [-2.0, 0.5])]
    assert run(spark, rows) == brute(rows, 5, 50)
    assert run(spark, [(0, [1.0])]) == []
    repeated = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [3.0, 0.0]), (2, [0.5, 0.0]), (0, [4.0, 0.0]), (50, [1.0, 1.0]), (50, [1.0, 1.0])]
    assert run(spark, repeated, block_rows=2, query_rows=1) == brute(repeated, 5, 50)
    assert run(spark, repeated)[0] == (0, 1, 0, 262144)
    assert run(spark, []) == []


def test_the_driver_broadcasts_nothing(spark):
    """Spark broadcast the sent query blocks: it took their size to be that of the query rows."""
    rows = [(i, np.random.default_rng(i).normal(size=16).astype(np.float32).tolist()) for i in range(600)]
    conf = {"spark.sql.autoBroadcastJoinThreshold": "100m", "spark.sql.maxBroadcastTableSize": "20k"}
    before = {c: spark.conf.get(c) for c in conf}
    for c, v in conf.items():
        spark.conf.set(c, v)
    try:
        assert run(spark, rows, query_every=5, block_rows=30, query_rows=10) == brute(rows, 5, 5)
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_equal_and_long_vectors(spark):
    rng = np.random.default_rng(7)
    equal = [(int(i), [1.0, 2.0]) for i in rng.permutation(300)] + [(300 + i, [2.0, 1.0]) for i in range(90)]
    assert run(spark, equal, query_every=30, block_rows=100, query_rows=7) == brute(equal, 5, 30)
    for reach in (1.0, 3e4, 1e6):  # scores of 32-bit floats, of 64-bit floats and of integers
        rows = [(i, [float(x) for x in rng.normal(size=12).astype(np.float32) * np.float32(reach)]) for i in range(200)]
        assert run(spark, rows, query_every=10, block_rows=60, query_rows=9) == brute(rows, 5, 10)
