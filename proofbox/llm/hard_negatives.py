"""Hard-negative mining with Four-Russians scoring (operator 11).

Components become integers floor(``scale`` * x); a score is the integer inner product.

* A block of candidates is held as bit planes: the components in two's complement, one plane a
  bit, eight dimensions packed into one byte.
* For a block of anchors the sums of all 256 subsets of each eight-dimension group are worked
  out once (each from a smaller subset by one addition).
* A candidate's plane bytes index these tables: the lookups of a plane are added over the groups, and the
  planes are joined from the highest (the sign, subtracted) down by shifting and adding. The
  result is the full, exact score; nothing is estimated.

Two passes meet every anchor block with every candidate block. The first keeps each anchor's
``n_positives`` best other rows of its label and scores only rows of that label: both kinds of
block are sorted by label. The second keeps, for each anchor and positive, the ``n_negatives``
best rows of other labels with low * positive <= 100 * negative <= high * positive. A block pair
sends on its own best only, so what is merged is small beside the pairs, and a label that holds a
third of all rows is spread over all blocks. Anchors are a stated set (ids divisible by
``anchor_every``); their number times all rows is inherent.

Rows with a null id, label or vector, or with a null or non-finite component, take no part.
Rows are told apart by a key of their own, so rows that repeat an id are anchors, positives and negatives each.
Shorter vectors count as padded with zeros. Ties go to the smaller id. An anchor without
a positive, or a positive without a negative in its range, gives no rows; an empty table gives none.
Scores are exact while every sum of products fits 62 bits; larger components raise. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofbox.llm.common import stored, tidy

_STEP = 256  # candidates that are looked up at once


def matrix(column, dim: int) -> np.ndarray:
    """An Arrow list column as rows of integers, padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = np.zeros((len(column), dim), np.int64)
    if len(column):
        off = column.offsets.to_numpy().astype(np.int64)
        size = np.diff(off)
        flat = column.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]
        out[np.repeat(np.arange(len(column)), size), np.arange(len(flat)) - np.repeat(off[:-1] - off[0], size)] = flat
    return out


def planes_needed(low: int, high: int) -> int:
    """Bits of two's complement that hold all of low..high."""
    return max(int(-low - 1).bit_length() if low < 0 else 0, int(high).bit_length() if high > 0 else 0) + 1


def pack_planes(v: np.ndarray, planes: int) -> np.ndarray:
    """(plane, group, row) bytes: a bit of eight neighbouring dimensions each, the first dimension highest."""
    groups = -(-v.shape[1] // 8)
    wide = np.zeros((len(v), groups * 8), np.int64)
    wide[:, : v.shape[1]] = v
    return np.stack([np.packbits((wide >> b & 1).astype(np.uint8), axis=1).T for b in range(planes)]) if planes else np.zeros((0, groups, len(v)), np.uint8)


def subset_sums(anchors: np.ndarray, planes: int) -> np.ndarray:
    """(group, byte, anchor): the sum of the anchor's components over the byte's set bits."""
    groups = -(-anchors.shape[1] // 8)
    wide = np.zeros((len(anchors), groups * 8), np.int64)
    wide[:, : anchors.shape[1]] = anchors
    # 32 bits hold every shifted sum of these anchors, or 64 do.
    reach = int(np.abs(wide).sum(axis=1).max(initial=0)) << planes
    table = np.zeros((groups, 256, len(anchors)), np.int32 if reach < 1 << 31 else np.int64)
    for i in range(8):
        bit = 1 << i
        table[:, bit : 2 * bit] = table[:, :bit] + wide[:, 7 - i :: 8].T[:, None, :].astype(table.dtype)
    return table


def scores(table: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Exact inner products, a row per anchor and a column per candidate."""
    planes, groups, n = packed.shape
    out = np.empty((table.shape[2], n), table.dtype)
    found = np.empty((_STEP, table.shape[2]), table.dtype)
    for lo in range(0, n, _STEP):
        part = packed[:, :, lo : lo + _STEP]
        total, hit = np.zeros((part.shape[2], table.shape[2]), table.dtype), found[: part.shape[2]]
        for b in range(planes - 1, -1, -1):
            np.left_shift(total, 1, out=total)
            for g in range(groups):
                np.take(table[g], part[b, g], axis=0, out=hit, mode="clip")
                if b == planes - 1:
                    np.subtract(total, hit, out=total)
                else:
                    np.add(total, hit, out=total)
        out[:, lo : lo + _STEP] = total.T
    return out


class Block:
    """Rows of one block, sorted by label."""

    def __init__(self, row, i: int):
        def ints(name):
            return np.frombuffer(row.column(name)[i].as_buffer(), np.int64)

        self.keys, self.ids, self.labels = ints("keys"), ints("ids"), ints("labels")


def _blocks(dim: int, planes: int, packed: bool):
    """One row per block; candidates as bit planes, anchors as integers with what is known of their positives."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("label", "ascending"), ("vec_id", "ascending"), ("key", "ascending")])
        v = matrix(table.column("v"), dim)

        def raw(name):
            return table.column(name).to_numpy().astype(np.int64).tobytes()

        held = np.ascontiguousarray(pack_planes(v, planes)).tobytes() if packed else v.tobytes()
        cols = {"block": table.column("block")[0].as_py(), "keys": raw("key"), "ids": raw("vec_id"), "labels": raw("label"), "held": held}
        if "positives" in table.column_names:
            # Per anchor its positives' scores, best first; a score beyond their number is unused.
            flat = [x.as_py() for x in table.column("positives")]
            cols["counts"] = np.array([len(x) for x in flat], np.int64).tobytes()
            cols["known"] = np.array([s for x in flat for s in x], np.int64).tobytes()
        return pa.table({k: pa.array([x], pa.int64() if k == "block" else pa.binary()) for k, x in cols.items()})

    return run


BLOCK = "block long, keys binary, ids binary, labels binary, held binary"


def best_positives(anchors: Block, table: np.ndarray, base: Block, packed: np.ndarray, k: int):
    """(anchor row, candidate row, score) of each anchor's ``k`` best other rows of its label in the block."""
    for label in np.intersect1d(anchors.labels, base.labels):
        a, z = (int(np.searchsorted(anchors.labels, label, side)) for side in ("left", "right"))
        c, d = (int(np.searchsorted(base.labels, label, side)) for side in ("left", "right"))
        s = scores(table[:, :, a:z], packed[:, :, c:d])
        other = base.keys[c:d][None, :] != anchors.keys[a:z, None]
        live = other
        if d - c > k + 1:  # an anchor meets itself once at most
            live = other & (s >= np.partition(s, d - c - k - 1, axis=1)[:, [d - c - k - 1]])
        row, col = np.nonzero(live)
        score = s[row, col].astype(np.int64)
        order = np.lexsort((base.keys[c + col], base.ids[c + col], -score, row))
        row, col, score = row[order], col[order], score[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        yield a + row[keep], c + col[keep], score[keep]


def best_negatives(anchors: Block, positives: list[np.ndarray], table: np.ndarray, base: Block, packed: np.ndarray, k: int, low: int, high: int):
    """(anchor row, place of the positive, candidate row, score): the ``k`` best other-label rows within each positive's range."""
    s = scores(table, packed)
    floors = [-((-low * p) // 100) for p in positives]
    tops = [(high * p) // 100 for p in positives]
    none = np.iinfo(np.int64).max
    least = np.array([f.min(initial=none) for f in floors])
    most = np.array([t.max(initial=-none) for t in tops])
    live = (s >= least[:, None]) & (s <= most[:, None]) & (base.labels[None, :] != anchors.labels[:, None])
    row, col = np.nonzero(live)
    score = s[row, col].astype(np.int64)
    order = np.lexsort((base.keys[col], base.ids[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    cut = np.searchsorted(row, np.arange(len(positives) + 1))
    for i in np.unique(row):
        down = -score[cut[i] : cut[i + 1]]
        first = np.searchsorted(down, -tops[i])
        for p, (at, floor) in enumerate(zip(first.tolist(), floors[i].tolist(), strict=True)):
            for j in range(at, min(at + k, len(down))):
                if -down[j] < floor:
                    break
                yield i, p, col[cut[i] + j], -down[j]


def _met(dim: int, planes: int, find, names: list[str]):
    """Run ``find`` on each pair of blocks of a task."""
    groups = -(-dim // 8)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                base = Block(row, 0)
                packed = np.frombuffer(row.column("held")[0].as_buffer(), np.uint8).reshape(planes, groups, len(base.ids))
                asked = Block(row.rename_columns([c.removeprefix("q_") if c.startswith("q_") else f"c_{c}" for c in row.schema.names]), 0)
                v = np.frombuffer(row.column("q_held")[0].as_buffer(), np.int64).reshape(len(asked.ids), dim)
                cols = find(row, asked, subset_sums(v, planes), base, packed)
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in cols], names=names)

    return run


def _find_positives(k: int):
    def find(row, asked, table, base, packed):
        parts = list(best_positives(asked, table, base, packed, k))
        a, c, s = (np.concatenate([p[j] for p in parts]) if parts else np.zeros(0, np.int64) for j in range(3))
        return asked.keys[a], base.keys[c], base.ids[c], s

    return find


def _find_negatives(k: int, low: int, high: int):
    def find(row, asked, table, base, packed):
        counts = np.frombuffer(row.column("q_counts")[0].as_buffer(), np.int64)
        known = np.frombuffer(row.column("q_known")[0].as_buffer(), np.int64)
        positives = np.split(known, np.cumsum(counts)[:-1])
        found = list(best_negatives(asked, positives, table, base, packed, k, low, high))
        a, p, c, s = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
        return asked.keys[a], p, base.keys[c], base.ids[c], s

    return find


def hard_negatives(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256, anchor_every: int = 50,
    n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95, block_rows: int = 2048, anchor_rows: int = 512,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of every row of ``vectors`` whose id is divisible by ``anchor_every``."""
    spark = vectors.sparkSession
    x = F.col(vector_col)
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull() & usable).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v")
    )
    rows = stored(rows.withColumn("key", F.monotonically_increasing_id()), "negatives-rows")
    n, dim, least, most = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.min(F.array_min("v")), F.lit(0)), F.coalesce(F.max(F.array_max("v")), F.lit(0))).first()
    if not n or not dim:
        least = most = 0
    dim = max(dim, 1)
    planes = planes_needed(least, most)
    if dim * (1 << 2 * planes) >= 1 << 62:
        raise ValueError("vectors are too long for exact 64-bit scores")
    n_blocks = max(1, -(-n // block_rows))
    # A row's block is drawn from its key: labels, hot ones too, are spread over all blocks.
    blocks = stored(rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n_blocks))).groupBy("block").applyInArrow(tidy_table(_blocks(dim, planes, True)), BLOCK), "negatives-blocks")
    anchors = rows.where(F.col("vec_id") % anchor_every == 0)
    asked_blocks = max(1, -(-n // (anchor_every * anchor_rows)))

    def met(asked: DataFrame, more: str, find, made: str) -> DataFrame:
        """``find`` on every anchor block of ``asked`` against every candidate block."""
        held = asked.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(asked_blocks))).groupBy("block").applyInArrow(tidy_table(_blocks(dim, planes, False)), BLOCK + more)
        sent = held.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"), *[F.col(c).alias(f"q_{c}") for c in held.columns if c != "block"])
        parts = min(2 * n_blocks, 4096)
        pairs = sent.repartition(parts, "block").join(blocks.repartition(parts, "block"), "block")
        return pairs.mapInArrow(tidy(_met(dim, planes, find, [c.split()[0] for c in made.split(", ")])), made)

    found = met(anchors, "", _find_positives(n_positives), "key long, other long, positive_id long, positive_score long")
    order = Window.partitionBy("key").orderBy(F.desc("positive_score"), "positive_id", "other")
    positives = stored(found.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < n_positives).drop("other"), "negatives-positives")
    listed = positives.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "positive_score"))), lambda p: p["positive_score"]).alias("positives"))
    found = met(anchors.join(listed, "key"), ", counts binary, known binary", _find_negatives(n_negatives, low, high), "key long, place long, other long, negative_id long, negative_score long")
    order = Window.partitionBy("key", "place").orderBy(F.desc("negative_score"), "negative_id", "other")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives).drop("other")
    named = best.join(positives.withColumn("place", F.col("place").cast("long")), ["key", "place"]).join(anchors.select("key", F.col("vec_id").alias("anchor_id")), "key")
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def tidy_table(run):
    """``tidy`` for a function of one group's table."""

    def tidied(table: pa.Table) -> pa.Table:
        (out,) = tidy(lambda tables: (run(t) for t in tables))([table])
        return out

    return tidied


SQL = """
with v as (
  select row_number() over () as key, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
),
s as (
  select a.key, a.vec_id as anchor_id, c.key as other, c.vec_id, a.label = c.label as same,
         coalesce(cast(list_sum(list_transform(list_zip(a.v, c.v), lambda p: coalesce(p[1] * p[2], 0))) as bigint), 0) as score
  from v a join v c on a.key <> c.key
  where a.vec_id % 50 = 0
),
p as (
  select * from (select key, anchor_id, vec_id as positive_id, score as positive_score,
                        row_number() over (partition by key order by score desc, vec_id, other) as place from s where same)
  where place <= 5
),
n as (
  select p.anchor_id, p.positive_id, p.positive_score, s.vec_id as negative_id, s.score as negative_score,
         row_number() over (partition by p.key, p.place order by s.score desc, s.vec_id, s.other) as rank
  from p join s on s.key = p.key and not s.same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 3
"""
