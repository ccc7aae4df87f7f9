"""Approximate nearest neighbours by learned partitions (operator 13).

* A sample of at most ``sample`` rows (those with the smallest id hashes) is fitted on the driver: the graph
  of each row's ``degree`` nearest by inner product is cut into equal parts by repeated spectral halving, then refined by
  moves that cut fewer edges and keep the parts within 5% of equal.
* A small network (one hidden layer, trained by numpy gradient descent) learns where a vector's
  neighbours lie: its target is the share of them in each part.
* Index: every row goes to its most probable part; parts are held as blocks of about ``block_rows`` rows,
  so a part with a third of all rows is many blocks.
* Search: a query goes to its most probable parts until their summed probability reaches a
  bar, and until they hold more than ``k`` rows. The bar is set on the sample: the least one that finds ``aim`` of
  the true neighbours of held-out sample rows. All rows of these parts are scored exactly.

The parts a query visits follow from the data: one or two where vectors lie in groups, most of them where
vectors have no neighbourhoods at all (an isotropic cloud), so recall holds there too, at a price.
Tables of under 1,024 rows are one part, which is an exact search.

Nearness is the inner product in double precision, summed in the order of the components. Vectors that are null, zero or
hold null or non-finite components, and rows with a null id, take no part. Rows are told apart by
a key of their own, so rows that repeat an id are each other's candidates. Shorter vectors count as
padded with zeros. Ties go to the smaller id. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofbox.llm.common import stored, tidy
from proofbox.llm.hard_negatives import tidy_table


def matrix(column, dim: int) -> np.ndarray:
    """An Arrow list column as rows of doubles, padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = np.zeros((len(column), dim))
    if len(column):
        off = column.offsets.to_numpy().astype(np.int64)
        size = np.diff(off)
        flat = column.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]
        out[np.repeat(np.arange(len(column)), size), np.arange(len(flat)) - np.repeat(off[:-1] - off[0], size)] = flat
    return out


# ---------------------------------------------------------------- fitting on the sample


def neighbour_lists(queries: np.ndarray, base: np.ndarray, k: int, own: np.ndarray) -> np.ndarray:
    """The ``k`` rows of ``base`` with the largest inner product, best first, leaving out ``own`` (a row of base per query)."""
    out = np.empty((len(queries), k), np.int64)
    for lo in range(0, len(queries), 512):
        s = queries[lo : lo + 512] @ base.T
        s[np.arange(len(s)), own[lo : lo + 512]] = -np.inf
        top = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < s.shape[1] else np.argsort(-s, axis=1)[:, :k]
        out[lo : lo + 512] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, axis=1), axis=1, kind="stable"), axis=1)
    return out


def partition_graph(near: np.ndarray, levels: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Cut a neighbour graph into 2^levels parts of equal size with few edges between them."""
    n, k = near.shape
    a, b = np.repeat(np.arange(n), k), near.reshape(-1)
    a, b = np.concatenate((a, b)), np.concatenate((b, a))
    part = np.zeros(n, np.int64)
    for level in range(levels):
        # The second eigenvector of each part's own graph, all parts at once; halves are split at its median.
        parts = 1 << level
        inside = part[a] == part[b]
        x, y = a[inside], b[inside]
        root = np.sqrt(np.maximum(np.bincount(x, minlength=n), 1e-9))
        v = rng.normal(size=n)
        whole = np.bincount(part, root * root, minlength=parts)
        for _ in range(40):
            v = 0.5 * v + 0.5 * np.bincount(x, (v / root)[y], minlength=n) / root
            v -= root * (np.bincount(part, v * root, minlength=parts) / whole)[part]
            v /= np.sqrt(np.maximum(np.bincount(part, v * v, minlength=parts), 1e-300))[part]
        order = np.lexsort((v / root, part))
        first = np.concatenate(([0], np.cumsum(np.bincount(part, minlength=parts))))
        place = np.arange(n) - first[part[order]]
        half = (first[1:] - first[:-1] + 1) // 2
        part[order] = 2 * part[order] + (place >= half[part[order]])
    parts = 1 << levels
    room, least = int(np.ceil(1.05 * n / parts)), int(np.floor(0.95 * n / parts))
    for _ in range(rounds if parts > 1 else 0):
        beside = np.bincount(a * parts + part[b], minlength=n * parts).reshape(n, parts)
        best = beside.argmax(axis=1)
        gain = beside[np.arange(n), best] - beside[np.arange(n), part]
        before, size = part.copy(), np.bincount(part, minlength=parts)
        wish = np.flatnonzero(gain > 0)
        wish = wish[rng.random(len(wish)) < 0.5]  # neighbours that change places together undo each other
        for i in wish[np.argsort(-gain[wish], kind="stable")].tolist():
            if size[best[i]] < room and size[part[i]] > least:
                size[part[i]] -= 1
                size[best[i]] += 1
                part[i] = best[i]
        if (part[a] != part[b]).sum() > (before[a] != before[b]).sum():
            part = before
    return part


class Router:
    """A small classifier: the probability of each part, and the bar of summed probability to search up to."""

    def __init__(self, scale: float, layers: list[np.ndarray], bar: float = 1.0):
        self.scale, self.layers, self.bar = scale, layers, bar

    def probabilities(self, v: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        z = np.maximum(v * self.scale @ w1 + b1, 0) @ w2 + b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def places(self, v: np.ndarray) -> np.ndarray:
        return self.probabilities(v).argmax(axis=1)

    def routes(self, v: np.ndarray, held: np.ndarray, k: int) -> np.ndarray:
        """Which parts each vector visits: most probable first, up to the bar and to more than ``k`` rows (``held``: rows of each part)."""
        p = self.probabilities(v)
        order = np.argsort(-p, axis=1, kind="stable")
        mass = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1)
        rows = np.cumsum(held[order], axis=1)
        zero = np.zeros((len(v), 1))
        visit = (np.hstack((zero, mass[:, :-1])) < self.bar) | (np.hstack((zero, rows[:, :-1])) <= k)
        out = np.zeros(p.shape, bool)
        np.put_along_axis(out, order, visit, axis=1)
        return out & (held > 0)


def train(v: np.ndarray, target: np.ndarray, rng: np.random.Generator, hidden: int = 128, epochs: int = 20, step: float = 3e-3) -> Router:
    """Fit the classifier to the shares ``target`` by gradient descent with moment estimates."""
    scale = 1.0 / max(float(np.sqrt((v * v).sum(axis=1).mean())), 1e-30) * np.sqrt(v.shape[1])
    layers = [rng.normal(size=(v.shape[1], hidden)) * np.sqrt(2.0 / v.shape[1]), np.zeros(hidden), rng.normal(size=(hidden, target.shape[1])) * np.sqrt(1.0 / hidden), np.zeros(target.shape[1])]
    router = Router(scale, layers)
    mean, square, t = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    for epoch in range(epochs):
        order = rng.permutation(len(v))
        for lo in range(0, len(v), 256):
            x, y = v[order[lo : lo + 256]] * scale, target[order[lo : lo + 256]]
            h = np.maximum(x @ layers[0] + layers[1], 0)
            z = h @ layers[2] + layers[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            d = (z / z.sum(axis=1, keepdims=True) - y) / len(x)
            back = d @ layers[2].T * (h > 0)
            t += 1
            for i, g in enumerate((x.T @ back, back.sum(axis=0), h.T @ d, d.sum(axis=0))):
                mean[i] = 0.9 * mean[i] + 0.1 * g
                square[i] = 0.999 * square[i] + 0.001 * g * g
                rate = step * (1 - epoch / epochs) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
                layers[i] -= rate * mean[i] / (np.sqrt(square[i]) + 1e-8)
    return router


def fit(v: np.ndarray, levels: int, k: int, aim: float, degree: int = 16, held_out: int = 512, seed: int = 13) -> Router:
    """Graph, parts, classifier and search bar from the sample ``v``; its last ``held_out`` rows only set the bar."""
    rng = np.random.default_rng(seed)
    if not levels:
        return Router(1.0, [np.zeros((v.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)])
    held_out = min(held_out, len(v) // 8)
    base = v[: len(v) - held_out]
    near = neighbour_lists(base, base, min(degree, len(base) - 1), np.arange(len(base)))
    part = partition_graph(near, levels, rng)
    share = np.bincount(np.repeat(np.arange(len(base)), near.shape[1]) * (1 << levels) + part[near.reshape(-1)], minlength=len(base) << levels).reshape(len(base), -1).astype(float)
    share[np.arange(len(base)), part] += 1
    router = train(base, share / share.sum(axis=1, keepdims=True), rng)
    asked = v[len(base) :]
    true = neighbour_lists(asked, v, min(k, len(v) - 1), np.arange(len(base), len(v)))
    p, place = router.probabilities(asked), router.places(v)
    order = np.argsort(-p, axis=1, kind="stable")
    before = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1) - np.take_along_axis(p, order, axis=1)
    back = np.empty_like(before)
    np.put_along_axis(back, order, before, axis=1)
    needed = np.sort(np.take_along_axis(back, place[true], axis=1).reshape(-1))
    router.bar = float(np.nextafter(needed[min(len(needed) - 1, int(np.ceil(aim * len(needed))))], 2.0)) if len(needed) else 1.0
    return router


# ---------------------------------------------------------------- index and search


def _placed(router, dim: int):
    def run(batches):
        for batch in batches:
            part = router.value.places(matrix(batch.column("v"), dim)) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("vec_id"), batch.column("v"), pa.array(part.astype(np.int32))], names=["key", "vec_id", "v", "part"])

    return run


def _routed(router, dim: int, held: np.ndarray, k: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                row, part = np.nonzero(router.value.routes(matrix(batch.column("v"), dim), held, k))
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(row)), batch.column("vec_id").take(pa.array(row)), batch.column("v").take(pa.array(row)), pa.array(part.astype(np.int32))], names=["key", "vec_id", "v", "part"])

    return run


def _blocks(dim: int):
    def run(table: pa.Table) -> pa.Table:
        cols = {"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "sub": pa.array([table.column("sub")[0].as_py()], pa.int64())}
        for name, raw in (("keys", table.column("key").to_numpy()), ("ids", table.column("vec_id").to_numpy()), ("held", matrix(table.column("v"), dim))):
            cols[name] = pa.array([raw.tobytes()], pa.binary())
        return pa.table(cols)

    return run


def ordered_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products, each summed from the first component to the last."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def nearest(queries: np.ndarray, q_keys: np.ndarray, base: np.ndarray, keys: np.ndarray, ids: np.ndarray, k: int):
    """(query row, base row, score): the ``k`` nearest of ``base`` for each query, leaving out its own row."""
    rows, cols, found = [], [], []
    for lo in range(0, len(queries), 256):
        s = queries[lo : lo + 256] @ base.T
        live = keys[None, :] != q_keys[lo : lo + 256, None]
        if s.shape[1] > k + 1:
            # A blocked product rounds by place, so what is near the k-th best is scored again in one fixed order.
            least = np.partition(s, s.shape[1] - k - 1, axis=1)[:, [s.shape[1] - k - 1]]
            live &= s >= least - 1e-9 * (1 + np.abs(least))
        row, col = np.nonzero(live)
        score = ordered_products(queries[lo + row], base[col])
        order = np.lexsort((keys[col], ids[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        rows.append(lo + row[keep])
        cols.append(col[keep])
        found.append(score[keep])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, cols, found))


def _search(dim: int, k: int):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                keys, ids, q_keys = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int64) for c in ("keys", "ids", "q_keys"))
                base, asked = (np.frombuffer(batch.column(c)[i].as_buffer(), np.float64).reshape(-1, dim) for c in ("held", "q_held"))
                row, col, score = nearest(asked, q_keys, base, keys, ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(q_keys[row]), pa.array(keys[col]), pa.array(ids[col]), pa.array(score.astype(np.float64))], names=["key", "other", "vec_id", "score"])

    return run


def nearest_neighbours(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, query_every: int = 20, sample: int = 8704, aim: float = 0.96, rows_per_part: int = 256, max_parts: int = 64,
    block_rows: int = 4096, query_rows: int = 512,
) -> DataFrame:
    """query_id, rank, vec_id, score: up to ``k`` near rows for each row whose id is divisible by ``query_every``."""
    spark = vectors.sparkSession
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    usable = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("v")).where(usable)
    rows = stored(rows.withColumn("key", F.monotonically_increasing_id()), "near-rows")
    n, dim = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # The sample comes to the driver: at most ``sample`` vectors.
    drawn = [r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "key").limit(sample).collect()]
    v = np.zeros((len(drawn), dim))
    for i, r in enumerate(drawn):
        v[i, : len(r)] = r
    levels = 0 if n < 1024 else max(1, int(np.log2(min(max_parts, n / rows_per_part, len(v) / 16))))
    router = spark.sparkContext.broadcast(fit(v, levels, k, aim))
    placed = stored(rows.mapInArrow(tidy(_placed(router, dim)), "key long, vec_id long, v array<double>, part int"), "near-placed")

    def cut(frame: DataFrame, size: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
        """Blocks of about ``size`` rows of one part, the rows of each part and its number of blocks."""
        held = np.zeros(1 << levels, np.int64)
        for r in frame.groupBy("part").count().collect():  # a row per part
            held[r["part"]] = r["count"]
        subs = np.maximum(1, -(-held // size))
        of = F.element_at(F.array(*[F.lit(int(s)).cast("long") for s in subs]), F.col("part") + 1)
        made = frame.withColumn("sub", F.pmod(F.xxhash64("key"), of)).groupBy("part", "sub").applyInArrow(tidy_table(_blocks(dim)), "part int, sub long, keys binary, ids binary, held binary")
        return made, held, subs

    blocks, held, subs = cut(placed, block_rows)
    asked = rows.where(F.col("vec_id") % query_every == 0)
    routed = stored(asked.select("key", "vec_id", "v").mapInArrow(tidy(_routed(router, dim, held, k)), "key long, vec_id long, v array<double>, part int"), "near-routed")
    sent, _, _ = cut(routed, query_rows)
    last = F.element_at(F.array(*[F.lit(int(s - 1)).cast("long") for s in subs]), F.col("part") + 1)
    sent = sent.select("part", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("sub"), F.col("keys").alias("q_keys"), F.col("held").alias("q_held"))
    parts = int(min(2 * subs.sum(), 4096))
    met = sent.repartition(parts, "part", "sub").join(blocks.repartition(parts, "part", "sub"), ["part", "sub"])
    found = met.mapInArrow(tidy(_search(dim, k)), "key long, other long, vec_id long, score double")
    order = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id", "other")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("other")
    return best.join(asked.select("key", F.col("vec_id").alias("query_id")), "key").select("query_id", "rank", "vec_id", "score")
