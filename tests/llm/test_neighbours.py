import numpy as np

from proofbox.llm import neighbours as nb


def exact(rows, k=20, every=20):
    live = [(i, np.asarray(x, np.float32).astype(float)) for i, x in rows if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x) and any(c != 0 for c in x)]
    dim = max((len(x) for _, x in live), default=0)
    v = np.array([np.pad(x, (0, dim - len(x))) for _, x in live]).reshape(len(live), dim)
    ids = np.array([i for i, _ in live], np.int64)
    out = []
    for a in np.flatnonzero(ids % every == 0):
        s = nb.ordered_products(np.broadcast_to(v[a], v.shape), v)
        best = [b for b in np.lexsort((ids, -s)) if b != a][:k]
        out += [(int(ids[a]), r, int(ids[b]), float(s[b])) for r, b in enumerate(best, 1)]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as key", "2 as part", "3 as v", "4 as sub").repartition(4)
    return sorted(tuple(r) for r in nb.nearest_neighbours(df, **options).collect())


def recall(got, want):
    return len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}) / len(want)


def test_small_tables_are_searched_exactly(spark):
    rng = np.random.default_rng(3)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(300, 12)).astype(np.float32))]
    rows += [(400 + i, rows[7][1]) for i in range(30)]  # ties
    rows += [(20, rows[5][1]), (20, rows[20][1]), (900, None), (920, [float("nan")] * 12), (940, [None] * 12), (960, [0.0] * 12), (None, rows[1][1]), (980, [float("inf")] * 12), (1000, rows[3][1][:5]), (1020, [])]
    assert run(spark, rows, block_rows=50, query_rows=3) == exact(rows)
    assert run(spark, []) == [] and run(spark, [(20, [1.0])]) == []
    assert run(spark, rows[:5]) == exact(rows[:5])


def grouped(n, seed, groups=60, dim=24):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, dim))
    of = np.where(rng.random(n) < 0.33, 0, rng.integers(0, groups, n))  # one group holds a third of the rows
    v = centre[of] + rng.normal(size=(n, dim)) * 0.25
    return [(i, x.tolist()) for i, x in enumerate(v.astype(np.float32))]


def test_recall_and_scores(spark):
    rows = grouped(6000, 4)
    want, got = exact(rows), run(spark, rows, block_rows=500, query_rows=50)
    assert recall(got, want) >= 0.9
    score = {(q, i): s for q, _, i, s in want}
    assert len(got) == len(want) and all(abs(s - score[q, i]) < 1e-12 for q, _, i, s in got if (q, i) in score)
    by_query = {}
    for q, r, i, s in got:
        by_query.setdefault(q, []).append((r, -s, i))
    assert all([r for r, _, _ in x] == list(range(1, 21)) and [y[1:] for y in x] == sorted(y[1:] for y in x) for x in by_query.values())


def test_a_cloud_without_neighbourhoods(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(3000, 32))
    rows = [(i, x.tolist()) for i, x in enumerate((v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32))]
    assert recall(run(spark, rows), exact(rows)) >= 0.9


def test_copies(spark):
    rows = grouped(2000, 7)
    rows += [(5000 + i, rows[11][1]) for i in range(1500)]
    assert recall(run(spark, rows), exact(rows)) >= 0.9


def test_parts_are_balanced_and_routes_narrow():
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(8, 16)) * 2
    v = np.repeat(centre, 100, axis=0) + rng.normal(size=(800, 16)) * 0.2
    v = v[rng.permutation(800)]
    near = nb.neighbour_lists(v, v, 16, np.arange(800))
    part = nb.partition_graph(near, 3, rng)
    size = np.bincount(part, minlength=8)
    assert size.min() >= 90 and size.max() <= 110
    assert (part[near] == part[:, None]).mean() > 0.8
    router = nb.fit(v, 3, 20, 0.96)
    held = np.bincount(router.places(v), minlength=8)
    assert router.routes(v, held, 20).sum(axis=1).mean() < 4
    assert (router.routes(v, held, 10_000) == (held > 0)).all()
