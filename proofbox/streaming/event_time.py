"""Event-time streams: order lifecycle (J2), admission (J3) and the daily table (J1) with a late branch.

Rows arrive in any order. A watermark, the newest event time seen less the delay, seals the past: what is at or before it
is final, and a row that arrives behind it is late. Late rows change nothing; they come out marked, so applied
and late rows together are all rows.

J2 and J3 keep, per key, what the sealed actions led to (a value state) and the actions not yet sealed (a list
state); an event-time timer at a key's next due action applies them in (ts, seq) order once the watermark has passed.
Until then each micro-batch that touches a key lands provisional rows ('open') for what it holds, so the landed table is
current; the row of the latest batch counts. J1 keeps the open days as sums in the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from proofbox.operators import daily as dl
from proofbox.operators import lifecycle as lc
from proofbox.operators import transfer as tf
from proofbox.session import scratch_path

FINAL, OPEN, LATE = "final", "open", "late"
LIFE_OUT = "key long, ts timestamp_ntz, seq long, action string, status_before string, status_after string, accepted boolean, note string, stage string"
ADMIT_OUT = "key long, ts timestamp_ntz, seq long, kind string, amount long, accepted boolean, balance_after long, reason string, stage string"


class InOrder(StatefulProcessor):
    """Applies a key's rows in (ts, seq) order as the watermark passes them; subclasses say how.

    Rows carry ``ms`` (event time in milliseconds, null if there is none) beside their own columns.
    """

    #: The value state's own column and its value for a key never seen.
    state_type, nothing = "", None
    #: Held columns behind (ms, ts, seq).
    held_type: str = ""

    def __init__(self, retain_ms: int | None = None):
        self.retain_ms = retain_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", f"{self.state_type}, last_ms long, timer long")
        self.held = handle.getListState("held", f"ms long, ts timestamp_ntz, seq long, {self.held_type}")

    # what a subclass defines
    def item(self, row) -> tuple: ...

    def apply(self, state, item: tuple) -> tuple: ...  # (new state, output columns)

    def late_row(self, key, row) -> Row: ...

    def out_row(self, key, item: tuple, result: tuple, stage: str) -> Row: ...

    def closed(self, state) -> bool:
        return False

    # the common part
    def _run(self, key, state, last_ms, items: list[tuple], stage: str):
        out = []
        for item in items:
            if self._forgotten(state, last_ms, item[0]):
                state = self.nothing
            state, result = self.apply(state, item)
            last_ms = item[0]
            out.append(self.out_row(key, item, result, stage))
        return state, last_ms, out

    def _forgotten(self, state, last_ms, now_ms) -> bool:
        return self.retain_ms is not None and last_ms is not None and self.closed(state) and now_ms - last_ms > self.retain_ms

    def _advance(self, key, new: list[tuple], watermark: int):
        """Apply what is due, keep the rest, set the key's one timer; the final and the provisional rows."""
        known = self.at.get() if self.at.exists() else None
        state, last_ms, timer = known if known is not None else (self.nothing, None, None)
        held = sorted([*(tuple(x) for x in self.held.get()), *new] if self.held.exists() else new, key=lambda x: (x[0], x[1], x[2]))
        due = [x for x in held if x[0] <= watermark]
        rest = held[len(due) :]
        state, last_ms, final = self._run(key, state, last_ms, due, FINAL)
        open_ = self._run(key, state, last_ms, rest, OPEN)[2] if new else []
        if rest:
            self.held.put(rest)
            due_ms = rest[0][0]
        else:
            self.held.clear()
            # A closed key without held rows is evicted once it is forgotten anyway.
            due_ms = last_ms + self.retain_ms + 1 if self.retain_ms is not None and last_ms is not None and self.closed(state) else None
            if due_ms is not None and due_ms <= watermark:
                state, last_ms, due_ms = self.nothing, None, None
        if timer is not None and timer != due_ms:
            self.handle.deleteTimer(timer)
        if due_ms is not None and timer != due_ms:
            self.handle.registerTimer(due_ms)
        if state == self.nothing and last_ms is None and due_ms is None:
            self.at.clear()
        else:
            self.at.update((state, last_ms, due_ms))
        return [*final, *open_]

    def handleInputRows(self, key, rows, timerValues):
        watermark = timerValues.getCurrentWatermarkInMs()
        new = []
        for row in rows:
            if row["ms"] <= watermark:
                yield self.late_row(key[0], row)
            else:
                new.append(self.item(row))
        if new:
            yield from self._advance(key[0], new, watermark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        known = self.at.get() if self.at.exists() else None
        if known is not None and known[2] == expiredTimerInfo.getExpiryTimeInMs():
            self.at.update((known[0], known[1], None))  # this timer is spent
        yield from self._advance(key[0], [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def life_step(status: str, action: str) -> tuple[str, bool, str | None]:
    """One action applied to a status: status after, accepted, note."""
    if action == "create":
        return lc.PENDING, True, None
    if status == lc.NONE:
        return status, False, "order_not_found"
    if action == "confirm":
        return (lc.PROCESSING, True, None) if status == lc.PENDING else (status, False, "only_pending_can_be_confirmed")
    if action == "complete":
        return lc.COMPLETED, True, ("already_completed" if status == lc.COMPLETED else None)
    if action == "cancel":
        return (status, False, "already_cancelled") if status == lc.CANCELLED else (lc.CANCELLED, True, "restock")
    return status, False, "unknown_action"


class Lifecycle(InOrder):
    state_type, nothing, held_type = "status string", lc.NONE, "action string"

    def item(self, row):
        return row["ms"], row["ts"], row["seq"], row["action"]

    def apply(self, state, item):
        after, accepted, note = life_step(state, item[3])
        return after, (state, after, accepted, note)

    def closed(self, state):
        return state in (lc.COMPLETED, lc.CANCELLED)

    def out_row(self, key, item, result, stage):
        return Row(key=key, ts=item[1], seq=item[2], action=item[3], status_before=result[0], status_after=result[1], accepted=result[2], note=result[3], stage=stage)

    def late_row(self, key, row):
        return Row(key=key, ts=row["ts"], seq=row["seq"], action=row["action"], status_before=None, status_after=None, accepted=None, note=None, stage=LATE)


class Admission(InOrder):
    state_type, nothing, held_type = "balance long", 0, "kind string, amount long"

    def item(self, row):
        return row["ms"], row["ts"], row["seq"], row["kind"], row["amount"]

    def apply(self, state, item):
        (accepted,), _, (reason,), balance = tf.replay([item[3]], [item[4]], state)
        return balance, (accepted, balance, reason)

    def out_row(self, key, item, result, stage):
        return Row(key=key, ts=item[1], seq=item[2], kind=item[3], amount=item[4], accepted=result[0], balance_after=result[1], reason=result[2], stage=stage)

    def late_row(self, key, row):
        return Row(key=key, ts=row["ts"], seq=row["seq"], kind=row["kind"], amount=row["amount"], accepted=None, balance_after=None, reason=None, stage=LATE)


def _keyed(stream: DataFrame, delay: str, columns: list) -> DataFrame:
    """The stream with its watermark set; the rows carry a plain copy of the event time, so late ones reach the processor."""
    marked = stream.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", delay)
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return marked.where(F.col("key").isNotNull() & F.col("ts").isNotNull()).select(F.col("key").cast("long").alias("key"), ms.alias("ms"), "ts", F.col("seq").cast("long").alias("seq"), *columns)


def order_lifecycle(actions: DataFrame, delay: str = "2 days", retain_ms: int | None = None) -> DataFrame:
    """J2 in event time: LIFE_OUT rows in update mode, keyed by (key, seq).

    Equal to ``lifecycle.order_lifecycle`` over the actions that are not late. With ``retain_ms`` a completed or cancelled
    order is forgotten that long after its last action (its state is evicted): a later action finds no order.
    Actions without a key or time take no part.
    """
    a = actions.filter(F.col("action").isin(*lc.LIFECYCLE_ACTIONS))
    return _keyed(a, delay, ["action"]).groupBy("key").transformWithState(Lifecycle(retain_ms), LIFE_OUT, "Update", "EventTime")


def admission(moves: DataFrame, delay: str = "2 days") -> DataFrame:
    """J3 in event time: ADMIT_OUT rows in update mode, keyed by (key, seq); equal to ``lifecycle.admit`` over the moves that are not late."""
    amount = F.coalesce(F.col("amount").cast("long"), F.lit(0).cast("long")).alias("amount")
    return _keyed(moves, delay, ["kind", amount]).groupBy("key").transformWithState(Admission(), ADMIT_OUT, "Update", "EventTime")


# ------------------------------------------------------------------ J1 with a late branch

MARK = T.StructType([T.StructField("newest", T.DateType())])


def run_daily(ledger: DataFrame, delay_days: int, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """J1 over everything available: (daily table of the lines that were in time, late lines).

    Each micro-batch splits its lines at the watermark (newest date of the batches before, less
    ``delay_days``), adds the sums of those in time to the open days, and lands the days that its
    own dates close, once, as final sums. Open days are (date, product, weather) sums in the
    shared folder, so what is kept grows with the delay, not with the ledger. Lines behind the watermark go to
    the side table as they are. A replayed batch replaces its own folders; a stable ``path`` resumes. Lines
    without a date or product are in neither.
    """
    spark = ledger.sparkSession
    base = path or scratch_path(spark, f"streams/daily-{uuid.uuid4().hex[:12]}")
    lines = dl.drop_null_keys(dl.ensure_columns(ledger))
    empty = spark.createDataFrame([], lines.schema)
    sums_type = dl.line_sums(empty).schema

    def put(df: DataFrame, kind: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/{kind}/__batch={batch_id}")

    def get(kind: str, schema, batch_id: int | None = None) -> DataFrame:
        found = spark.read.schema(schema).parquet(f"{base}/{kind}" if batch_id is None else f"{base}/{kind}/__batch={batch_id}")
        return found.select(schema.fieldNames())

    def land(batch: DataFrame, batch_id: int) -> None:
        if batch_id == 0:
            put(spark.createDataFrame([], sums_type), "open", -1)
            put(spark.createDataFrame([(None,)], MARK), "mark", -1)
        before = get("mark", MARK, batch_id - 1).first()["newest"]
        batch = batch.persist()
        try:
            newest = batch.agg(F.greatest(F.max("date"), F.lit(before))).first()[0]
            late = F.coalesce(F.col("date") <= F.date_sub(F.lit(before).cast("date"), delay_days), F.lit(False))
            put(batch.where(late), "late", batch_id)
            open_ = dl.merge_sums(get("open", sums_type, batch_id - 1).unionByName(dl.line_sums(batch.where(~late)))).persist()
            closes = F.coalesce(F.col("date") <= F.date_sub(F.lit(newest).cast("date"), delay_days), F.lit(False))
            put(open_.where(closes), "closed", batch_id)
            put(open_.where(~closes), "open", batch_id)
            open_.unpersist()
            put(spark.createDataFrame([(newest,)], MARK), "mark", batch_id)
        finally:
            batch.unpersist()

    q = lines.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(land).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    if not _exists(spark, f"{base}/mark"):  # nothing has come yet
        return dl.fold_days(dl.line_sums(empty)), empty
    last = spark.read.parquet(f"{base}/mark").agg(F.max("__batch")).first()[0]  # one row a batch
    sums = get("closed", sums_type).unionByName(get("open", sums_type, last))
    return dl.fold_days(sums), get("late", lines.schema)


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def run_landings(rows: DataFrame, landing: str, n: int, run: Callable[[DataFrame], object]):
    """Land ``rows`` in ``n`` parts, by the number in column ``landing``, and run a resumable stream job after each; the last result.

    ``run`` gets the file stream over the landed folder. This is how a scheduled job meets a table that
    grows: each run takes what is new as one micro-batch and resumes from its checkpoint.
    """
    spark = rows.sparkSession
    folder = scratch_path(spark, f"landings/{uuid.uuid4().hex[:12]}")
    kept = rows.drop(landing)
    out = None
    for i in range(n):
        rows.where(F.col(landing) == i).drop(landing).write.mode("append").parquet(folder)
        out = run(spark.readStream.schema(kept.schema).parquet(folder))
    return out
