"""Order lifecycle (J2) and sequential admission of withdrawals (J3), batch form.

J2 is a finite state machine whose state after any action is determined by
three "latest position" facts (last create, last complete/cancel, last
confirm-or-later), and a "latest" is a max: associative. So it is computed as
a two-pass parallel (segmented) scan with window functions: within (key,
time bucket) chunks, a running max; across the chunks of a key, a running max
over one summary row per chunk; the two are combined per row. A hot key is
split over its time buckets instead of landing in one task; the price is a
second read of the action log for the chunk summaries (the usual reduce-then-
scan pair), never a second shuffle of raw rows beyond the chunk partitioning.

J3 (a withdrawal is accepted only if the running balance covers it) is not a
running sum once a withdrawal is refused. A run of moves is a piecewise function
of its opening balance (``transfer``): such functions are built for all runs in
parallel, opening balances are looked through them, and every run is replayed
from its known opening. The streaming form (``streaming.event_time``) keeps the same
balance in the state store and applies moves once the watermark has passed them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofbox.operators import transfer as tf
from proofbox.session import checkpointed

# Order statuses.
NONE, PENDING, PROCESSING, COMPLETED, CANCELLED = "NONE", "PENDING", "PROCESSING", "COMPLETED", "CANCELLED"
LIFECYCLE_ACTIONS = ("create", "confirm", "complete", "cancel")


def _pos():
    return F.struct(F.col("ts").alias("ts"), F.col("seq").alias("seq"))


def order_lifecycle(actions: DataFrame, key: str = "key", bucket: str = "day") -> DataFrame:
    """Per action, the status before and after and whether it was accepted.

    Rules: create opens the order (PENDING); confirm only from PENDING
    (-> PROCESSING); complete from any existing status (COMPLETED again is an
    accepted no-op); cancel from any existing status except CANCELLED (it
    restocks). Actions on an order not yet created are rejected. Order of
    actions per key is (ts, seq).
    """
    a = actions.filter(F.col("action").isin(*LIFECYCLE_ACTIONS)).select(
        F.col(key).alias("key"), "ts", "seq", "action", F.date_trunc(bucket, "ts").alias("bucket")
    )
    is_create = F.col("action") == "create"
    is_term = F.col("action").isin("complete", "cancel")
    is_prog = F.col("action").isin("confirm", "complete", "cancel")
    marks = a.select(
        "*",
        F.when(is_create, _pos()).alias("m_c"),
        F.when(is_term, F.struct(_pos().alias("p"), F.col("action").alias("a"))).alias("m_t"),
        F.when(is_prog, _pos()).alias("m_p"),
    )
    # running maxima inside each (key, bucket) chunk, excluding the current row
    w_in = Window.partitionBy("key", "bucket").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    inner = marks.select(
        "key", "ts", "seq", "action", "bucket",
        F.max("m_c").over(w_in).alias("c_in"), F.max("m_t").over(w_in).alias("t_in"), F.max("m_p").over(w_in).alias("p_in"),
    )
    # one summary row per chunk, then running maxima over the chunks of a key (exclusive)
    chunks = marks.groupBy("key", "bucket").agg(F.max("m_c").alias("c"), F.max("m_t").alias("t"), F.max("m_p").alias("p"))
    w_ch = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    prefix = chunks.select(
        "key", "bucket", F.max("c").over(w_ch).alias("c_pre"), F.max("t").over(w_ch).alias("t_pre"), F.max("p").over(w_ch).alias("p_pre")
    )
    j = inner.join(prefix, ["key", "bucket"], "left")
    lc = F.greatest("c_in", "c_pre")
    lt = F.greatest("t_in", "t_pre")
    lp = F.greatest("p_in", "p_pre")
    s = j.select("key", "ts", "seq", "action", lc.alias("lc"), lt.alias("lt"), lp.alias("lp"))
    before = (
        F.when(F.col("lc").isNull(), F.lit(NONE))
        .when(F.col("lt.p") > F.col("lc"), F.when(F.col("lt.a") == "complete", F.lit(COMPLETED)).otherwise(F.lit(CANCELLED)))
        .when(F.col("lp") > F.col("lc"), F.lit(PROCESSING))
        .otherwise(F.lit(PENDING))
    )
    s = s.select("key", "ts", "seq", "action", before.alias("status_before"))
    return s.select("*", *transition("action", "status_before"))


def transition(action: str, before: str):
    """Columns status_after, accepted, note for one action applied to a status."""
    a, b = F.col(action), F.col(before)
    accepted = (
        F.when(a == "create", F.lit(True))
        .when(a == "confirm", b == PENDING)
        .when(a == "complete", b != NONE)
        .when(a == "cancel", ~b.isin(NONE, CANCELLED))
        .otherwise(F.lit(False))
    )
    after = (
        F.when(a == "create", F.lit(PENDING))
        .when((a == "confirm") & (b == PENDING), F.lit(PROCESSING))
        .when((a == "complete") & (b != NONE), F.lit(COMPLETED))
        .when((a == "cancel") & ~b.isin(NONE, CANCELLED), F.lit(CANCELLED))
        .otherwise(b)
    )
    note = (
        F.when((a != "create") & (b == NONE), F.lit("order_not_found"))
        .when((a == "confirm") & (b != PENDING), F.lit("only_pending_can_be_confirmed"))
        .when((a == "complete") & (b == COMPLETED), F.lit("already_completed"))
        .when((a == "cancel") & (b == CANCELLED), F.lit("already_cancelled"))
        .when(a == "cancel", F.lit("restock"))
    )
    return [after.alias("status_after"), accepted.alias("accepted"), note.alias("note")]


# ------------------------------------------------------------------ J3

ADMIT_SCHEMA = T.StructType(
    [
        T.StructField("key", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("amount", T.LongType()),
        T.StructField("accepted", T.BooleanType()),
        T.StructField("balance_after", T.LongType()),
        T.StructField("reason", T.StringType()),
    ]
)


_LISTS = "seq array<long>, kind array<string>, amount array<long>, earn array<long>"
RUN_SCHEMA = f"key long, part int, run int, edge boolean, {_LISTS}, start array<long>, slope array<boolean>, offset array<long>"
_RUN_TYPES = pa.schema(
    [("key", pa.int64()), ("part", pa.int32()), ("run", pa.int32()), ("edge", pa.bool_()), ("seq", pa.list_(pa.int64())), ("kind", pa.list_(pa.string())),
     ("amount", pa.list_(pa.int64())), ("earn", pa.list_(pa.int64())), ("start", pa.list_(pa.int64())), ("slope", pa.list_(pa.bool_())), ("offset", pa.list_(pa.int64()))]
)


def _pack(run_rows: int):
    """Runs of one key, at most ``run_rows`` moves each, of a partition sorted by key and time.

    A run is an edge if its key may have moves in another run: it is the partition's first or
    last key, or has a full run here. Edges get their transfer function. Memory: one run and one batch.
    """

    def pack(batches):
        held, rows, cut, first, n = [], 0, False, True, 0

        def out(table: pa.Table, offsets: list[int], edge: bool) -> pa.RecordBatch:
            nonlocal n
            table = table.combine_chunks()
            k = len(offsets) - 1
            at = pa.array(offsets, pa.int32())

            def flat(name):
                c = table.column(name)
                return c.chunk(0) if c.num_chunks else pa.array([], c.type)

            def listed(name):
                return pa.ListArray.from_arrays(at, flat(name))

            f = tf.of_moves(*[table.column(c).to_pylist() for c in ("kind", "amount", "earn")]) if edge else None
            fn = [[x.tolist()] if edge else [[]] * k for x in ((f.start, f.slope, f.offset) if edge else (None,) * 3)]
            starts = pa.array(offsets[:-1], pa.int64())
            cols = [flat("key").take(starts), flat("part").take(starts), pa.array(range(n, n + k), pa.int32()), pa.array([edge] * k), listed("seq"), listed("kind"), listed("amount"), listed("earn")]
            n += k
            return pa.RecordBatch.from_arrays([*cols, *[pa.array(x, t.type) for x, t in zip(fn, list(_RUN_TYPES)[8:])]], schema=_RUN_TYPES)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = table.column("key").to_numpy()
            if not len(keys):
                continue
            ends = [*(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            lo = 0
            if held and held[0].column("key")[0].as_py() == keys[0]:
                lo = ends.pop(0)
                held.append(table.slice(0, lo))
                rows += lo
            if held and ends:  # another key follows
                yield out(pa.concat_tables(held), [0, rows], first or cut)
                held, rows, cut, first = [], 0, False, False
            if ends:
                if first and len(ends) > 1:
                    yield out(table.slice(lo, ends[0] - lo), [0, ends[0] - lo], True)
                    lo, first = ends.pop(0), False
                if len(ends) > 1:  # keys that begin and end in this batch
                    yield out(table.slice(lo, ends[-2] - lo), [0, *[e - lo for e in ends[:-1]]], False)
                    lo = ends[-2]
                held, rows = [table.slice(lo)], len(keys) - lo
            while rows >= run_rows:
                whole = pa.concat_tables(held)
                yield out(whole.slice(0, run_rows), [0, run_rows], True)
                held, rows, cut = [whole.slice(run_rows)] if rows > run_rows else [], rows - run_rows, True
                if not held:  # the key may go on: an empty slice keeps its name
                    held = [whole.slice(run_rows - 1, 1).slice(0, 0)]
                    break
        if rows:
            yield out(pa.concat_tables(held), [0, rows], True)

    return pack


def _look(batches):
    """The balance before each edge run: look the opening balance through the functions of a key's runs in order."""
    key, balance = None, 0
    for batch in batches:
        keys, openings = batch.column("key").to_pylist(), batch.column("opening").to_pylist()
        cut = batch.column("start").offsets.to_numpy()
        cut = cut - cut[0]
        start, slope, offset = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("start", "slope", "offset"))
        found = []
        for i, k in enumerate(keys):
            if k != key:
                key, balance = k, openings[i]
            found.append(balance)
            one = slice(cut[i], cut[i + 1])
            balance = tf.Transfer(start[one], slope[one], offset[one])(balance)
        yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("run"), pa.array(found, pa.int64())], names=["part", "run", "balance"])


def _replay(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            accepted, after, reasons = [], [], []
            for kinds, amounts, earns, opening in zip(*[part.column(c).to_pylist() for c in ("kind", "amount", "earn", "opening")]):
                a, b, r, _ = tf.replay(kinds, amounts, opening, earns)
                accepted += a
                after += b
                reasons += r
            size = np.diff(part.column("seq").offsets.to_numpy())
            keys = part.column("key").take(pa.array(np.repeat(np.arange(part.num_rows), size)))
            cols = [keys, *[part.column(c).flatten() for c in ("seq", "kind", "amount")], pa.array(accepted, pa.bool_()), pa.array(after, pa.int64()), pa.array(reasons, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=ADMIT_SCHEMA.fieldNames())


def admit(moves: DataFrame, opening: DataFrame | None = None, partitions: int | None = None, run_rows: int = 512) -> DataFrame:
    """Sequential admission per key over moves (key, ts, seq, kind, amount), in the order (ts, seq).

    kind: 'deposit' (always accepted), 'withdraw' (accepted only if the balance
    covers it), 'payment' (a withdrawal that brings ``earn``, a column of the moves, if it is accepted), 'revert' (subtracts, floored at 0); any other kind changes nothing. ``opening`` (key, opening)
    gives starting balances (default 0). Line-level: each move is admitted on
    its own (an all-or-nothing multi-line order would couple keys). Moves with a null key are left out, a null amount counts as 0.

    Moves are range-partitioned by (key, ts, seq), so a key that holds half of them is spread over
    half of the partitions. A run of a key's moves is a transfer function of its opening balance
    (``transfer``); only keys that have several runs need theirs. The opening balances are
    looked through a key's functions in order (one row a run, not a move; two intervals a move at most were measured
    in runs of 512 without reverts, four in all with them), and every run is
    then replayed from its known opening, all in parallel. The runs are checkpointed: both later steps must see the same cut.
    """
    zero = F.lit(0).cast("long")
    earn = F.coalesce(F.col("earn").cast("long"), zero) if "earn" in moves.columns else zero
    m = moves.where(F.col("key").isNotNull()).select(
        F.col("key").cast("long").alias("key"), "ts", F.col("seq").cast("long").alias("seq"), "kind", F.coalesce(F.col("amount").cast("long"), zero).alias("amount"), earn.alias("earn")
    )
    n = partitions or int(moves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = m.repartitionByRange(n, "key", "ts", "seq").sortWithinPartitions("key", "ts", "seq")
    runs = ordered.select("key", "seq", "kind", "amount", "earn", F.spark_partition_id().alias("part")).mapInArrow(_pack(run_rows), RUN_SCHEMA)
    runs = checkpointed(runs)
    if opening is None:
        runs = runs.withColumn("opening", F.lit(0).cast("long"))
    else:
        given = opening.where(F.col("key").isNotNull()).select(F.col("key").cast("long").alias("key"), F.col("opening").cast("long").alias("opening"))
        runs = runs.join(given, "key", "left").withColumn("opening", F.coalesce("opening", F.lit(0).cast("long")))
    edges = runs.where("edge")
    looked = edges.select("key", "part", "run", "opening", "start", "slope", "offset").repartition("key").sortWithinPartitions("key", "part", "run").mapInArrow(_look, "part int, run int, balance long")
    moves_of = ["key", "seq", "kind", "amount", "earn"]
    inside = runs.where(~F.col("edge")).select(*moves_of, "opening")
    across = edges.join(looked, ["part", "run"]).select(*moves_of, F.col("balance").alias("opening"))
    return inside.unionByName(across).mapInArrow(_replay, ADMIT_SCHEMA)


def point_moves_from_actions(actions: DataFrame) -> DataFrame:
    """Loyalty point moves from the action log: credit -> deposit, create ->
    withdraw (points used), cancel -> revert (points taken back); whole points."""
    kind = (
        F.when(F.col("action") == "credit", "deposit")
        .when(F.col("action") == "create", "withdraw")
        .when(F.col("action") == "cancel", "revert")
    )
    return actions.select("key", "ts", "seq", kind.alias("kind"), F.floor("amount").cast("long").alias("amount")).filter(
        F.col("kind").isNotNull()
    )
