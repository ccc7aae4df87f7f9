"""Exact top-k inner products over norm-sorted, rotated vectors (operator 2).

Components become integers floor(``scale`` * x). All vectors are rotated by the eigenvectors
of their second-moment matrix (an SVD rotation: inner products stay, length moves into the
first coordinates) and sorted by descending length into blocks of ``block_rows``, which hold
the ids and the integer vectors in the smallest type that takes them. Rotated vectors and the lengths behind each
coordinate are worked out where a block is used. The blocks of one sorted partition, 16 at most or so, are a shelf.

Queries, in blocks too, first meet the block of the longest vectors, which gives each
a k-th best score to beat. A query block is then sent to the shelves it may still need:
|q| * (longest vector of the shelf) must reach the score to beat. Inside a block, scores
grow from partial sums over the first rotated coordinates; by Cauchy-Schwarz the rest adds
at most the product of the residual lengths, and vectors whose bound stays below the
query's k-th best are dropped stage by stage, for a block of queries in one product of matrices. Survivors are scored
in integers (in floating point while that is exact), so the result is exact. What a shelf finds raises the score to beat
in its next block; it returns the ``k`` best of each query.

Shelves and the query blocks sent to them are one table, sorted so that a task reads a shelf and then its queries.
There is no join, so nothing is broadcast, whatever Spark takes the sizes to be (a join's planner knows the rows of the
queries, not how often they are sent). The driver gets dim x dim sums, a row for each shelf and one block.

Vectors that are null or hold null or non-finite components, and rows with a null id, take
no part. Rows are told apart by a key of their own, so rows that repeat an id are queries and candidates each. Shorter
vectors count as padded with zeros. Scores are exact while every sum of products fits 63
bits (|components| up to 2^28 at 64 of them); larger ones raise. Ties go to the smaller id.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofbox.llm.common import batches_of, scratch, stored, tidy

_SLACK = 1e-4  # relative allowance for rounding in the rotated sums, which are of 32-bit floats
_LOWEST = np.iinfo(np.int64).min
_SHELF = 16  # blocks
_BATCH = 4 << 20  # bytes of blocks that Spark hands a worker at once
_PAIRS = 1 << 14  # pairs of vectors scored at once


def _matrix(values, dim: int) -> np.ndarray:
    """Rows of an Arrow list column as a matrix, padded with zeros."""
    out = np.zeros((len(values), dim), np.int64)
    if len(values):
        off = values.offsets.to_numpy().astype(np.int64)
        size = np.diff(off)
        row = np.repeat(np.arange(len(values)), size)
        flat = values.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]
        out[row, np.arange(len(flat)) - np.repeat(off[:-1] - off[0], size)] = flat
    return out


def _moments(dim: int):
    def run(batches):
        total, n = np.zeros((dim, dim)), 0
        for batch in batches:
            m = _matrix(batch.column("v"), dim).astype(np.float64)
            total, n = total + m.T @ m, n + len(m)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.reshape(-1))], names=["at", "m"])

    return run


def stages_of(dim: int) -> list[int]:
    return [s for s in (8, 24) if s < dim] + [dim]


def _small(v: np.ndarray) -> np.ndarray:
    """In the smallest integer type that takes all values."""
    lo, hi = v.min(initial=0), v.max(initial=0)
    return v.astype(next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= lo and hi <= np.iinfo(t).max))


def _blocks(dim: int, rows: int):
    """Blocks of a partition sorted by descending length; ids ascend in a block, so ties go to the earlier row."""

    def run(batches):
        held = []

        def block(table):
            ids, keys = (table.column(c).to_numpy().astype(np.int64) for c in ("vec_id", "key"))
            order = np.lexsort((keys, ids))
            v = _matrix(table.column("v").combine_chunks(), dim)[order]
            length = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
            return pa.RecordBatch.from_arrays([*[pa.array([x.tobytes()], pa.binary()) for x in (keys[order], ids[order], _small(v))], pa.array([float(length.max())])], names=["keys", "ids", "vectors", "longest"])

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= rows:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, rows))
                held = table.slice(rows).to_batches()
        if sum(b.num_rows for b in held):
            yield block(pa.Table.from_batches(held))

    return run


class Prepared:
    """A block's vectors, with what the stages need of them."""

    def __init__(self, keys: bytes, ids: bytes, vectors: bytes, dim: int, rotation: np.ndarray):
        self.keys, self.ids, self.rotation = np.frombuffer(keys, np.int64), np.frombuffer(ids, np.int64), rotation
        n = len(self.ids)
        self.vectors = np.frombuffer(vectors, f"i{len(vectors) // (n * dim) if n * dim else 8}").reshape(n, dim)
        self.length = np.sqrt((self.vectors.astype(np.float64) ** 2).sum(axis=1))
        self.longest = float(self.length.max(initial=0))
        self.by_key = np.argsort(self.keys)
        self._made: dict = {}

    def exact(self, kind) -> np.ndarray:
        if kind not in self._made:
            self._made[kind] = self.vectors.astype(kind)
        return self._made[kind]

    def bound(self, stage: int) -> np.ndarray:
        """The first ``stage`` rotated coordinates and the length behind them: products of two such rows are bounds of the score."""
        if stage not in self._made:
            rotated = self.vectors.astype(np.float64) @ self.rotation
            tail = np.sqrt((rotated[:, stage:] ** 2).sum(axis=1))
            self._made[stage] = np.column_stack((rotated[:, :stage], tail)).astype(np.float32)
        return self._made[stage]


def _kind(most: float):
    """The fastest type in which sums of products are exact, if ``most`` is the product of the lengths."""
    return np.float32 if most < 2.0**24 * (1 - 1e-6) else np.float64 if most < 2.0**53 * (1 - 1e-6) else np.int64


def _part(a: np.ndarray, at: np.ndarray) -> np.ndarray:
    return a if len(at) == len(a) else a[at]


def _top(row: np.ndarray, ties: tuple, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the ``k`` best of each row, and which of them are a row's k-th; ``ties`` from the last to the first that counts."""
    order = np.lexsort((*ties, -score, row))
    rank = np.arange(len(order)) - np.searchsorted(row[order], row[order])
    return order[rank < k], (rank == k - 1)[rank < k]


def _own(queries: Prepared, q: np.ndarray, base: Prepared, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where rows ``q`` of the queries meet themselves among rows ``b`` of ``base``."""
    keys = queries.keys[q]
    at = np.minimum(np.searchsorted(base.keys, keys, sorter=base.by_key), len(base.keys) - 1)
    row = base.by_key[at]
    col = np.minimum(np.searchsorted(b, row), len(b) - 1)
    same = (base.keys[row] == keys) & (b[col] == row)
    return np.flatnonzero(same), col[same]


def _pair_scores(queries: Prepared, q: np.ndarray, base: Prepared, b: np.ndarray, kind) -> np.ndarray:
    out = [np.einsum("ij,ij->i", queries.exact(kind)[q[i : i + _PAIRS]], base.exact(kind)[b[i : i + _PAIRS]]).astype(np.int64) for i in range(0, len(q), _PAIRS)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _grid_scores(queries: Prepared, q: np.ndarray, base: Prepared, b: np.ndarray, kind, beat: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, row of ``base``, score) of pairs of ``q`` and ``b`` that reach ``beat``, with the ``k`` best of each query."""
    score = _part(queries.exact(kind), q) @ _part(base.exact(kind), b).T
    own = _own(queries, q, base, b)
    score[own] = _LOWEST if kind == np.int64 else -np.inf
    live = score >= beat[q, None].astype(kind)
    live[own] = False
    many = np.flatnonzero(np.count_nonzero(live, axis=1) > max(64, 4 * k))
    if len(many):  # those above the k-th best, and the first that equal it
        few = score[many]
        kth = np.partition(few, few.shape[1] - k, axis=1)[:, -k, None]
        tie = few == kth
        live[many] = (few > kth) | tie & (np.cumsum(tie, axis=1, dtype=np.int32) <= k)
    r, c = np.nonzero(live)
    return q[r], b[c], score[r, c].astype(np.int64)


def search(queries: Prepared, base: Prepared, beat: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query row, row of ``base``, score, whether it is the k-th) of the ``k`` best for each query, leaving out what cannot reach ``beat``."""
    stages = stages_of(base.vectors.shape[1])
    kind = _kind(queries.longest * base.longest)
    floor = beat - _SLACK * (1 + queries.length * base.longest)
    q, b, pairs = np.flatnonzero(queries.length * base.longest >= floor), np.arange(len(base.ids)), None
    for stage in stages if kind == np.int64 else stages[:-1]:  # the last is as dear as the score, if that is one of floats
        if not len(q) or not len(b):
            break
        live = _part(queries.bound(stage), q) @ _part(base.bound(stage), b).T >= floor[q, None].astype(np.float32)
        if np.count_nonzero(live) * 64 < live.size:
            r, c = np.nonzero(live)
            pairs = q[r], b[c]
            break
        q, b = q[live.any(axis=1)], b[live.any(axis=0)]
    if pairs is not None:
        row, at = pairs
        other = base.keys[at] != queries.keys[row]
        row, at = row[other], at[other]
        score = _pair_scores(queries, row, base, at, kind)
    elif len(q) and len(b):
        row, at, score = _grid_scores(queries, q, base, b, kind, beat, k)
    else:
        row, at, score = (np.zeros(0, np.int64) for _ in range(3))
    reach = np.flatnonzero(score >= beat[row])
    best, kth = _top(row[reach], (at[reach],), score[reach], k)
    best = reach[best]
    return row[best], at[best], score[best], kth


def _prepared(batch, i: int, dim: int, rotation: np.ndarray) -> Prepared:
    return Prepared(*[batch.column(c)[i].as_py() for c in ("keys", "ids", "vectors")], dim, rotation)


def _shelf_scores(queries: Prepared, shelf: list[Prepared], beat: np.ndarray, k: int) -> list[np.ndarray]:
    """Query row, key, id and score of the ``k`` best of a shelf for each query, in blocks of descending length."""
    found = [np.zeros(0, np.int64) for _ in range(4)]
    for base in shelf:
        row, at, score, _ = search(queries, base, beat, k)
        if len(row):
            found = [np.concatenate(x) for x in zip(found, (row, base.keys[at], base.ids[at], score), strict=True)]
            best, kth = _top(found[0], (found[1], found[2]), found[3], k)
            found = [x[best] for x in found]
            beat[found[0][kth]] = np.maximum(beat[found[0][kth]], found[3][kth])
    return found


def _scores(dim: int, rotation: np.ndarray, k: int):
    """Of rows sorted by shelf, a shelf's blocks before its queries."""

    def run(batches):
        held_shelf, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                shelf, beat = batch.column("shelf")[i].as_py(), batch.column("beat")[i].as_py()
                if shelf != held_shelf:
                    held_shelf, held = shelf, []
                block = _prepared(batch, i, dim, rotation)
                if beat is None:
                    held.append(block)
                    continue
                row, key, vec_id, score = _shelf_scores(block, held, np.frombuffer(beat, np.int64).copy(), k)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (block.keys[row], block.ids[row], key, vec_id, score)], names=["key", "query_id", "other", "vec_id", "score"])

    return run


def _first_scores(dim: int, rotation: np.ndarray, k: int, longest_block: tuple[bytes, bytes, bytes], shelves: np.ndarray, longest: np.ndarray):
    """Each query block with the k-th best score of each query among the longest vectors, and the shelves it may need."""

    def run(batches):
        base = Prepared(*longest_block, dim, rotation)
        for batch in batches:
            beats, need = [], []
            for i in range(batch.num_rows):
                q = _prepared(batch, i, dim, rotation)
                beat = np.full(len(q.ids), _LOWEST, np.int64)
                row, _, score, kth = search(q, base, beat, k)
                beat[row[kth]] = score[kth]
                beats.append(beat.tobytes())
                with np.errstate(divide="ignore"):
                    reach = np.where(beat <= 0, 0.0, beat / np.where(q.length > 0, q.length, np.inf))
                need.append(shelves[longest >= reach.min() * (1 - _SLACK)].tolist())
            yield pa.RecordBatch.from_arrays([batch.column("keys"), batch.column("ids"), batch.column("vectors"), pa.array(beats, pa.binary()), pa.array(need, pa.list_(pa.int32()))], names=["keys", "ids", "vectors", "beat", "need"])

    return run


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: int = 256, query_every: int = 50, block_rows: int = 8192, query_rows: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of all other vectors for each row whose id is divisible by ``query_every``."""
    spark = vectors.sparkSession
    whole = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale))
    usable = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & usable).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    with scratch(spark) as keep, batches_of(spark, _BATCH):
        rows = stored(rows.withColumn("norm2", norm2).withColumn("key", F.monotonically_increasing_id()), "topk-rows")
        dim, n, largest = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.max("norm2"), F.lit(0.0))).first()
        if largest >= 2.0**62:
            raise ValueError("vectors are too long for exact 64-bit scores")
        if not n:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        rotation = np.zeros((0, 0))
        if dim:  # fitted on all vectors; the driver gets dim x dim sums
            moments = rows.select("v").mapInArrow(_moments(dim), "at long, m double").groupBy("at").agg(F.sum("m").alias("m")).toArrow()
            total = np.zeros(dim * dim)
            total[moments.column("at").to_numpy()] = moments.column("m").to_numpy()
            total = total.reshape(dim, dim)
            rotation = np.linalg.eigh((total + total.T) / 2)[1][:, ::-1].copy()
        # A shelf is a partition; tables of few blocks have shelves enough for all cores.
        parts = max(-(-n // (_SHELF * block_rows)), min(-(-n // block_rows), 4 * spark.sparkContext.defaultParallelism))
        made = "keys binary, ids binary, vectors binary, longest double"
        made_of = rows.repartitionByRange(parts, F.desc("norm2"), "key").sortWithinPartitions(F.desc("norm2"), "key").select("key", "vec_id", "v").mapInArrow(tidy(_blocks(dim, block_rows)), made)
        blocks = stored(made_of.withColumn("block", F.monotonically_increasing_id()).withColumn("shelf", F.shiftright("block", 33).cast("int")), "topk-blocks")
        # A row for each shelf, and one block: the longest vectors.
        index = sorted((r["top"]["longest"], -r["shelf"], r["top"]["block"]) for r in blocks.groupBy("shelf").agg(F.max(F.struct("longest", "block")).alias("top")).collect())[::-1]
        shelves, longest = np.array([-x[1] for x in index], np.int32), np.array([x[0] for x in index])
        first = blocks.where(F.col("block") == index[0][2]).first()
        wanted = rows.where(F.col("vec_id") % query_every == 0)
        asked = wanted.repartition(max(1, -(-n // (query_every * query_rows))), "key").sortWithinPartitions(F.desc("norm2"), "key").select("key", "vec_id", "v").mapInArrow(_blocks(dim, query_rows), made)
        asked = asked.mapInArrow(tidy(_first_scores(dim, rotation, k, tuple(bytes(first[c]) for c in ("keys", "ids", "vectors")), shelves, longest)), "keys binary, ids binary, vectors binary, beat binary, need array<int>")
        sent = asked.select(F.explode("need").alias("shelf"), "keys", "ids", "vectors", "beat")
        met = sent.unionByName(blocks.select("shelf", "keys", "ids", "vectors", "longest"), allowMissingColumns=True)
        met = met.repartitionById(len(index), F.col("shelf")).sortWithinPartitions("shelf", F.col("beat").isNotNull(), F.desc("longest"))
        best = keep(stored(met.mapInArrow(tidy(_scores(dim, rotation, k)), "key long, query_id long, other long, vec_id long, score long"), "topk-best"))
    order = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id", "other")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
with v as (
  select row_number() over () as key, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
),
s as (
  select q.key, q.vec_id as query_id, c.vec_id as vec_id, c.key as other,
         cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.key <> c.key
  where q.vec_id % 50 = 0
)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by key order by score desc, vec_id, other) as rank from s)
where rank <= 5
"""
