"""Structured Streaming jobs (J1-J5) and a runner that lands them in tables.

Every job is a function from a streaming DataFrame to a streaming DataFrame;
``run_available`` drives one with ``trigger(availableNow=True)`` into
parquet under the session's shared checkpoint folder (state and offsets in
the same folder; with a caller-given path a restarted job resumes there) and
returns the landed table as a batch DataFrame. Each job has a batch twin that is its oracle.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofbox.operators import daily as dl
from proofbox.operators.serving import answer, features_of, next_day_state, rejected_requests, state_days, valid_requests
from proofbox.session import scratch_path
from proofbox.sources import fixtures as fx
from proofbox.sources.tables import table_path
from proofbox.streaming import event_time as et


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# ------------------------------------------------------------------ sources

def table_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """A driver table, one file or a folder of part files, read as a file stream (schema taken from the files).

    A file source watches folders: a table that is one file is read as its parent folder, with a
    filter that only this file's name passes.
    """
    path = table_path(sf_dir, name)
    r = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop_path).isDirectory():
        r = r.option("pathGlobFilter", re.sub(r"([\\*?\[\]{}])", r"\\\1", hadoop_path.getName()))
        path = hadoop_path.getParent().toString()
    return r.parquet(path)


def ledger_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger lines as a stream: streaming lineitem joined to the static part table."""
    return fx.ledger_from(table_stream(spark, sf_dir, "lineitem"), spark.read.parquet(table_path(sf_dir, "part")))


def actions_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.actions_from(table_stream(spark, sf_dir, "events"))


def landed_stream(rows: DataFrame, name: str) -> DataFrame:
    """A batch frame landed once as files in the shared folder and read back as a stream."""
    path = scratch_path(rows.sparkSession, f"landed/{name}-{uuid.uuid4().hex[:12]}")
    rows.write.parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).parquet(path)


# ------------------------------------------------------------------ runner

def run_available(stream: DataFrame, name: str, mode: str = "append", keys: Sequence[str] | None = None, path: str | None = None) -> DataFrame:
    """Run ``stream`` until all available input is processed; return the result table.

    append: every emitted row is landed. update/complete: each micro-batch's
    rows are landed with their batch id and the result keeps, per ``keys``,
    the row of the latest batch (an upsert resolved at read time). A caller
    that gives a stable ``path`` resumes from its offsets and state.
    """
    spark = stream.sparkSession
    base = path or scratch_path(spark, f"streams/{name}-{uuid.uuid4().hex[:12]}")
    out, ckpt = f"{base}/out", f"{base}/checkpoint"

    def land(batch: DataFrame, batch_id: int) -> None:
        # a replayed batch replaces its own folder
        batch.write.mode("overwrite").parquet(f"{out}/__batch={batch_id}")

    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{out}/__batch=-1")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", ckpt).trigger(availableNow=True).foreachBatch(land)
    provider = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)  # timers and list state need it; a query keeps what it was started with
    try:
        q = writer.start()
    finally:
        spark.conf.unset(STATE_STORE) if provider is None else spark.conf.set(STATE_STORE, provider)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    schema = T.StructType([*stream.schema.fields, T.StructField("__batch", T.LongType())])
    landed = spark.read.schema(schema).parquet(out)
    if mode == "append" or not keys:
        return landed.drop("__batch")
    w = Window.partitionBy(*keys).orderBy(F.desc("__batch"))
    return landed.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") == 1).drop("__r", "__batch")


# ------------------------------------------------------------------ J1: daily table kept current

def stream_daily(ledger: DataFrame, delay: str = "3 days") -> DataFrame:
    """The daily operational table over a ledger stream.

    Event time is the ledger date. Lines within ``delay`` of the newest day
    seen are always counted; once the watermark passes a day its state is
    evicted (state stays bounded), and lines for it arriving later are
    dropped by the engine: ``event_time.run_daily`` is the form that keeps them, in a side table.
    Lines of one micro-batch are never late to each other. Run in update mode (every changed day is re-emitted) or append mode
    (each day emitted once, when the watermark has closed it).
    """
    # the 1-day tumbling window IS the ledger day: grouping by the day's timestamp (the
    # watermarked column) keeps window state evictable without UTC-aligned window()
    # boundaries, so the result does not depend on the session time zone
    df = dl.split_sign(dl.drop_null_keys(dl.ensure_columns(ledger))).withColumn("ts", F.col("date").cast("timestamp"))
    o = F.col("line_ord")
    agg = df.withWatermark("ts", delay).groupBy("ts", "product").agg(
        F.count("qty").cast("int").alias("source_row_count"),
        F.sum("is_positive").cast("int").alias("positive_row_count"),
        F.max("is_positive").cast("int").alias("has_positive_row"),
        F.sum("is_negative").cast("int").alias("negative_row_count"),
        F.max("is_negative").cast("int").alias("has_negative_row"),
        F.sum("positive_qty").alias("sold_qty"),
        F.sum("negative_qty").alias("raw_waste_qty"),
        F.sum("positive_sales").alias("gross_sales"),
        F.sum("negative_sales").alias("raw_waste_value"),
        *[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), o)).alias(c) for c in dl.WEATHER_COLUMNS],
    )
    return dl.derive_daily(agg.withColumn("date", F.col("ts").cast("date")).drop("ts"))


# ------------------------------------------------------------------ J2 / J3: event time

def stream_order_lifecycle(actions: DataFrame, delay: str = "2 days", retain_ms: int | None = None) -> DataFrame:
    """Order state machine in event time (``event_time.order_lifecycle``): run in update mode, keys (key, seq)."""
    return et.order_lifecycle(actions, delay, retain_ms)


def stream_admission(moves: DataFrame, delay: str = "2 days") -> DataFrame:
    """Sequential admission in event time (``event_time.admission``): run in update mode, keys (key, seq)."""
    return et.admission(moves, delay)


# ------------------------------------------------------------------ J4: live counts

def stream_status_counts(orders: DataFrame) -> DataFrame:
    """Orders per status (the pending count is one row), update mode."""
    return orders.groupBy("status").agg(F.count(F.lit(1)).alias("n_orders"))


def stream_stock_deltas(items: DataFrame, orders_static: DataFrame) -> DataFrame:
    """Net stock movement per product from a stream of order lines joined to
    the (static) orders; the badge is applied where the opening stock is known."""
    o = orders_static.select("order_id", "status")
    lines = items.join(o, "order_id", "inner")
    delta = F.when(F.col("status") == "CANCELLED", F.lit(0)).otherwise(-F.col("quantity"))
    return lines.groupBy("product_id").agg(F.sum(delta).alias("net_delta"))


# ------------------------------------------------------------------ J5: forecasts as requests arrive

def stand_in(column: str):
    """A forecaster that reads its answer from the request's features."""
    return lambda f: F.col(column)


STAND_INS = tuple(stand_in(c) for c in ("sold_rolling_mean_7", "sold_same_dow_mean_4", "waste_rolling_mean_7", "waste_same_dow_mean_4"))


def stream_forecast(requests: DataFrame, daily: DataFrame, predictors=STAND_INS) -> DataFrame:
    """Arriving requests joined to the static as-of states, answered as the batch form (I10) answers them.

    ``predictors``: sold primary and challenger, waste primary and challenger; fitted pipelines
    (``serving.model_predictor``) transform the stream itself. Requests without history come out as 'Failed';
    requests with an invalid date are in ``stream_rejected``.
    """
    inside, last = state_days(next_day_state(daily))
    r = valid_requests(requests).join(inside, ["product", "date"], "left").join(last, "product", "left")
    prev = F.coalesce(F.col("prev"), F.when(F.col("date") > F.col("last"), F.col("latest")))
    return answer(features_of(r.withColumn("prev", prev).drop("last", "latest")), *predictors)


def stream_rejected(requests: DataFrame) -> DataFrame:
    """J5's side output: requests whose date is not a valid one, with the reason."""
    return rejected_requests(requests)
