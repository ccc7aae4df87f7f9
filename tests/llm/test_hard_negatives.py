import numpy as np
import pytest

from proofbox.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=50, positives=5, negatives=3, low=50, high=95):
    live = []
    for i, x, label in rows:
        if i is not None and x is not None and label is not None and all(c is not None and np.isfinite(c) for c in x):
            live.append((i, [int(np.floor(256 * float(np.float32(c)))) for c in x], label))
    out = []
    for a, (i, v, label) in enumerate(live):
        if i % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w)), j, other) for b, (j, w, other) in enumerate(live) if b != a)
        for minus, j, _ in [s for s in scored if s[2] == label][:positives]:
            fits = [s for s in scored if s[2] != label and low * -minus <= 100 * -s[0] <= high * -minus][:negatives]
            out += [(i, j, r, n, -minus, -s) for r, (s, n, _) in enumerate(fits, 1)]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as key", "2 as block", "'x' as positives", "3 as rank").repartition(3)
    return sorted(tuple(r) for r in hn.hard_negatives(df, **options).collect())


def some_rows(n, dim, seed, labels=4):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(labels, dim)) * 0.3
    label = np.where(rng.random(n) < 0.4, 0, rng.integers(0, labels, n))  # one label holds many rows
    v = (centre[label] + rng.normal(size=(n, dim)) * 0.3).astype(np.float32)
    return [(i, x.tolist(), int(c)) for i, (x, c) in enumerate(zip(v, label))]


def test_matches_brute_force(spark):
    rows = some_rows(500, 20, 1)
    rows += [(600 + i, rows[7][1], i % 3) for i in range(40)]  # ties, over labels
    rows += [(50, rows[3][1], 2), (50, rows[50][1], rows[50][2]), (100, rows[100][1], rows[100][2])]  # repeated ids and rows
    rows += [(2000, None, 1), (2050, rows[1][1], None), (2100, [float("nan")] * 20, 1), (2150, [None] * 20, 0), (None, rows[1][1], 1), (2200, [float("inf")] * 20, 1), (2250, rows[9][1][:5], 0), (2300, [], 1)]
    want = brute(rows)
    assert len(want) > 50
    assert run(spark, rows, block_rows=60, anchor_rows=4) == want
    assert run(spark, rows) == want


def test_few_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0], 1)]) == []
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.5], 1), (2, [0.75, 0.0], 2), (3, [0.25, 0.0], 2), (4, [0.75, 0.0], 0)]
    assert run(spark, rows) == brute(rows) == [(0, 1, 1, 2, 65536, 49152), (0, 1, 2, 4, 65536, 49152)]
    zeros = [(0, [0.0], 1), (1, [0.0], 1), (2, [0.0], 2)]
    assert run(spark, zeros) == brute(zeros) == [(0, 1, 1, 2, 0, 0)]
    negative = [(0, [1.0], 1), (1, [-1.0], 1), (2, [-0.6], 2)]
    assert run(spark, negative) == brute(negative) == []


@pytest.mark.parametrize("low,high", [(-300, 300), (0, 0), (-1, 0), (0, 255), (-256, 255), (-2**20, 2**20)])
def test_table_lookups_are_inner_products(low, high):
    rng = np.random.default_rng(5)
    v, a = rng.integers(low, high + 1, (700, 13)), rng.integers(low, high + 1, (9, 13))
    planes = hn.planes_needed(low, high)
    assert (hn.scores(hn.subset_sums(a, planes), hn.pack_planes(v, planes)) == a @ v.T).all()


def test_too_long_vectors_raise(spark):
    with pytest.raises(ValueError):
        run(spark, [(0, [1e9], 1)])
