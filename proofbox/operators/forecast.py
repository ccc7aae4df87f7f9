"""Time splits, sequence samples, scaling, metrics, backtests and models
(B12, B13, C7, D8-D10, D14-D16, E10, E11, E13, I5-I7, A5, A11).

Folds are computed from the DISTINCT dates (bounded by the calendar), joined
back to the panel with an equi-join on date against a table of n*k rows (a
parameter-bounded broadcast). Model fits are MLlib jobs over the panel; the
only driver loop is over folds (a handful of model fits), never over data.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofbox.operators.features import feature_columns, series_window
from proofbox.session import ensure_checkpoint_dir

# Sequence-model history and target-day context columns.
HISTORY_COLUMNS = ["sold_qty", "waste_qty", "made_qty", "temp_avg", "dow_sin", "dow_cos", "month_sin", "month_cos"]
CONTEXT_COLUMNS = ["temp_avg", "dow_sin", "dow_cos", "month_sin", "month_cos"]
DEFAULT_HOLDOUT_DAYS = 21


# ------------------------------------------------------------------ splits

def panel_keys(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct dates and distinct products of the panel."""
    return df.select("date").distinct(), df.select("product").distinct()


def default_split_date(df: DataFrame, holdout_days: int = DEFAULT_HOLDOUT_DAYS) -> Column:
    """max(date) - holdout as a scalar subquery (one distributed aggregate)."""
    return df.select(F.date_sub(F.max("date"), holdout_days).alias("d")).scalar()


def temporal_split(df: DataFrame, split_date: Column | str | None = None) -> tuple[DataFrame, DataFrame]:
    """Train is date < d, validation is date >= d."""
    d = default_split_date(df) if split_date is None else (F.lit(split_date).cast("date") if isinstance(split_date, str) else split_date)
    return df.filter(F.col("date") < d), df.filter(F.col("date") >= d)


def _fold_of_dates(df: DataFrame, n_splits: int, window_days: int, newest_first: bool) -> DataFrame:
    """(date, fold, val_start, val_end) for the newest n*k distinct dates; raises if there are fewer.

    Only the newest n*k distinct dates are ever ranked (a distributed top-k),
    so the windows below see at most n*k rows. The panel is read once: the
    "enough dates" check counts the top-k itself (fewer than n*k rows there
    means the panel has exactly that many dates), so no extra scalar job.
    """
    need = n_splits * window_days
    top = df.select("date").distinct().orderBy(F.desc("date")).limit(need)
    pos = F.row_number().over(Window.orderBy(F.desc("date"))) - 1
    n_dates = F.count(F.lit(1)).over(Window.partitionBy())
    back = F.floor(pos / window_days).cast("int")
    fold = back if newest_first else (F.lit(n_splits - 1) - back)
    msg = F.concat(F.lit("Insufficient dates ("), n_dates.cast("string"), F.lit(f") to perform {n_splits} splits of {window_days} days."))
    fd = top.select("date", F.when(n_dates < need, F.raise_error(msg)).otherwise(fold).alias("fold"))
    w = Window.partitionBy("fold")
    return fd.select("date", "fold", F.min("date").over(w).alias("val_start"), F.max("date").over(w).alias("val_end"))


def fold_windows(df: DataFrame, n_splits: int = 3, window_days: int = 14, newest_first: bool = True) -> DataFrame:
    """N windows of k OBSERVED dates counted back from the newest date.

    One row per fold: fold, val_start, val_end, n_dates. ``newest_first``
    numbers the newest window 0 (the backtest's order); False numbers the
    oldest window 0 (the trainer's order).
    """
    fd = _fold_of_dates(df, n_splits, window_days, newest_first)
    return fd.groupBy("fold", "val_start", "val_end").agg(F.count(F.lit(1)).alias("n_dates"))


def fold_dates(df: DataFrame, n_splits: int = 3, window_days: int = 14, newest_first: bool = True) -> DataFrame:
    """(date, fold, val_start, val_end) for every validation date (n*k rows)."""
    return _fold_of_dates(df, n_splits, window_days, newest_first)


def assign_folds(df: DataFrame, n_splits: int = 3, window_days: int = 14, newest_first: bool = True) -> DataFrame:
    """Validation rows of every fold: the panel equi-joined on date to the n*k
    (date, fold) rows, a broadcast whose size is bounded by the parameters."""
    fd = fold_dates(df, n_splits, window_days, newest_first)
    return df.join(F.broadcast(fd), "date", "inner")


# ------------------------------------------------------------------ scaling and indices

def fit_scaler(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with the mean and POPULATION std of each column over the
    training rows (std 0 or undefined -> 1). MLlib's StandardScaler would use
    the sample std, hence the explicit aggregate."""
    aggs = []
    for c in cols:
        aggs.append(F.avg(c).alias(f"{c}__mean"))
        sd = F.stddev_pop(c)
        aggs.append(F.when(F.coalesce(sd, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(sd).alias(f"{c}__std"))
    return train.agg(*aggs)


def apply_scaler(df: DataFrame, stats: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """Scale columns with the one-row stats: each statistic enters as a scalar
    subquery (Spark merges them into one job), so no join is planned."""
    out = {}
    for c in cols:
        m = stats.select(f"{c}__mean").scalar()
        s = stats.select(f"{c}__std").scalar()
        out[f"{c}{suffix}"] = (F.col(c) - m) / s
    return df.withColumns(out)


def fit_index(df: DataFrame, col: str, partitions: int | None = None) -> DataFrame:
    """Value -> 1..n in sorted order (0 is reserved for unknown).

    The distinct values are range-partitioned and sorted; a value's number is its place in its partition plus
    the number of values in the partitions before, a table of one row per partition. Lazy, and no
    task ranks the whole catalogue. (Both reads share one exchange, so they see the same ranges.)
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.select(col).where(F.col(col).isNotNull()).distinct().repartitionByRange(n, col).sortWithinPartitions(col)
    row = F.monotonically_increasing_id()
    placed = ranged.select(col, F.shiftright(row, 33).cast("int").alias("__part"), row.bitwiseAND(F.lit((1 << 33) - 1)).alias("__place"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(offsets), "__part").select(col, (F.col("__before") + F.col("__place") + 1).cast("int").alias(f"{col}_idx"))


def apply_index(df: DataFrame, index: DataFrame, col: str) -> DataFrame:
    return df.join(index, col, "left").withColumn(f"{col}_idx", F.coalesce(F.col(f"{col}_idx"), F.lit(0)))


# ------------------------------------------------------------------ sequences

def sequence_samples(df: DataFrame, target: str, seq_len: int = 14, history=HISTORY_COLUMNS, context=CONTEXT_COLUMNS) -> DataFrame:
    """Previous ``seq_len`` rows as an array of structs, the day's context and target.

    Only rows with a full history are kept. The frame is bounded (seq_len),
    so the window holds at most seq_len rows per output row.
    """
    w = series_window()
    hist = F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in history])).over(w.rowsBetween(-seq_len, -1))
    out = df.select(
        "product", "date", "weather",
        hist.alias("history"),
        F.struct(*[F.col(c).cast("double").alias(c) for c in context]).alias("context"),
        F.col(target).cast("double").alias("target"),
    )
    return out.filter(F.size("history") == seq_len)


def flatten_history(samples: DataFrame, history=HISTORY_COLUMNS) -> Column:
    """history (n x k structs) -> flat array of n*k doubles, row-major."""
    return F.flatten(F.transform("history", lambda s: F.array(*[s[c] for c in history])))


def with_context(samples: DataFrame, folds: DataFrame) -> DataFrame:
    """Samples whose target day falls in a fold (history comes from earlier rows,
    so no separate trailing-context union is needed and no validation day is lost)."""
    return samples.join(F.broadcast(folds.select("date", "fold")), "date", "inner")


# ------------------------------------------------------------------ metrics

def align_predictions(truth: DataFrame, *preds: DataFrame, keys: Sequence[str] = ("product", "date")) -> DataFrame:
    """Join truth and every prediction frame on the keys (not by position)."""
    out = truth
    for p in preds:
        out = out.join(p, list(keys), "inner")
    return out


def metric_columns(y: str, yhat: str, prefix: str) -> list[Column]:
    """MAE and WAPE = sum|y - yhat| / sum y (0 when sum y <= 0)."""
    err = F.abs(F.col(y) - F.col(yhat))
    s = F.sum(y)
    return [
        F.avg(err).alias(f"{prefix}_mae"),
        F.when(s > 0, F.sum(err) / s).otherwise(F.lit(0.0)).alias(f"{prefix}_wape"),
    ]


def metrics(df: DataFrame, y: str, yhat: str, by: Sequence[str] = (), prefix: str = "model") -> DataFrame:
    return df.groupBy(*by).agg(*metric_columns(y, yhat, prefix))


MODELS = ("xgb", "lstm", "ensemble")


def backtest_report(folds: DataFrame) -> DataFrame:
    """D9 + D10: mean WAPE per model and target, and the recommended weights."""
    r = folds.groupBy("target").agg(*[F.avg(f"{m}_wape").alias(f"{m}_mean_wape") for m in MODELS])
    x, l, e = F.col("xgb_mean_wape"), F.col("lstm_mean_wape"), F.col("ensemble_mean_wape")
    ens_best = (e < x) & (e < l)
    return r.select(
        "*",
        F.when(ens_best, 0.5).when(l < x, 0.1).otherwise(1.0).alias("weight_primary"),
        F.when(ens_best, 0.5).when(l < x, 0.9).otherwise(0.0).alias("weight_challenger"),
    )


def no_fit(fn: Callable[[DataFrame | None, DataFrame], DataFrame]) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """Mark a forecaster that needs no training: it is called ONCE with
    (None, validation rows of all folds) and must return those same rows with
    a ``pred`` column added (so no alignment join is needed)."""
    fn.fits = False
    return fn


def backtest_predictions(panel: DataFrame, target: str, primary: Callable[[DataFrame, DataFrame], DataFrame],
                         challenger: Callable[[DataFrame, DataFrame], DataFrame], n_splits: int = 3, window_days: int = 14,
                         newest_first: bool = True) -> DataFrame:
    """Rolling-origin backtest of two forecasters and their average.

    A fitting forecaster gets (train rows, validation rows) per fold, with
    train = rows before the fold's first date, and returns (product, date,
    pred); the loop runs over the n folds only (each fit is Spark/MLlib jobs)
    and predictions are aligned with the truth on keys (C7). A ``no_fit``
    forecaster adds ``pred`` to the validation rows in one pass. Predictions
    are clamped at 0 and averaged into a provisional ensemble. One row per validation row that both answer:
    its columns, ``__y``, xgb_pred, lstm_pred, ensemble_pred.
    """
    val_rows = assign_folds(panel, n_splits, window_days, newest_first)
    keys = ["fold", "product", "date"]
    frame = val_rows.withColumn("__y", F.col(target).cast("double"))
    for name, fn in (("xgb_pred", primary), ("lstm_pred", challenger)):
        if getattr(fn, "fits", True):
            parts = []
            for i in range(n_splits):
                val = val_rows.filter(F.col("fold") == i)
                start = val.select(F.min("val_start")).scalar()
                train = panel.filter(F.col("date") < start)
                parts.append(fn(train, val.drop("fold", "val_start", "val_end")).select("product", "date", "pred").withColumn("fold", F.lit(i)))
            p = parts[0]
            for q in parts[1:]:
                p = p.unionByName(q)
            frame = align_predictions(frame, p.withColumnRenamed("pred", name), keys=keys)
        else:
            frame = fn(None, frame).withColumnRenamed("pred", name)
        pred = F.col(name).cast("double")
        frame = frame.withColumn(name, F.when(pred.isNotNull(), F.greatest(pred, F.lit(0.0))))
    return frame.withColumn("ensemble_pred", (F.col("xgb_pred") + F.col("lstm_pred")) / 2.0)


def backtest(panel: DataFrame, target: str, primary: Callable[[DataFrame, DataFrame], DataFrame],
             challenger: Callable[[DataFrame, DataFrame], DataFrame], n_splits: int = 3, window_days: int = 14,
             newest_first: bool = True) -> DataFrame:
    """I7 scored: MAE and WAPE per fold for both forecasters and their average."""
    return backtest_scores(backtest_predictions(panel, target, primary, challenger, n_splits, window_days, newest_first), target)


def backtest_scores(frame: DataFrame, target: str) -> DataFrame:
    return frame.groupBy("fold").agg(
        F.min("val_start").alias("val_start"),
        F.max("val_end").alias("val_end"),
        *[c for mdl in MODELS for c in metric_columns("__y", f"{mdl}_pred", mdl)],
    ).withColumn("target", F.lit(target))


# ------------------------------------------------------------------ models

MISSING = -999.0


def model_frame(df: DataFrame, target: str, sentinel: float = MISSING) -> tuple[DataFrame, list[str], list[str]]:
    """Leakage-safe numeric features with missing values as a far sentinel
    (trees isolate it with one split); categoricals returned separately."""
    feats = feature_columns(df, target)
    cats = [c for c in ("product", "weather") if c in feats]
    nums = [c for c, t in df.dtypes if c in feats and c not in cats and t in ("double", "int", "bigint", "float", "smallint")]
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(sentinel)) for c in nums})
    filled = filled.withColumns({c: F.coalesce(F.col(c), F.lit("<unknown>")) for c in cats})
    return filled, nums, cats


def fit_primary(train: DataFrame, target: str, max_iter: int = 500, step: float = 0.05, depth: int = 6,
                subsample: float = 0.8, feature_fraction: str = "0.8", validation: DataFrame | None = None, tol: float = 0.01, seed: int = 42):
    """Boosted trees over all products at once, as one fitted Pipeline.

    Product and weather enter as the target's mean over their training rows (``TargetEncoder``, shrunk to the overall mean
    for rare values; a value never seen gets the overall mean), so the number of products has
    no say in the trees' bins. With ``validation`` rows the trees stop once a round gains less than ``tol`` of their error there; the encoders never see
    those rows.
    """
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.feature import SQLTransformer, StringIndexer, TargetEncoder, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    ensure_checkpoint_dir(train.sparkSession)  # long boosting cuts its lineage there
    tr, nums, cats = model_frame(train, target)
    tr = tr.withColumn(target, F.col(target).cast("double"))
    idx, enc, mean = ([f"{c}__{kind}" for c in cats] for kind in ("idx", "enc", "mean"))
    stages = []
    if cats:
        stages = [
            StringIndexer(inputCols=cats, outputCols=idx, handleInvalid="keep"),
            TargetEncoder(inputCols=idx, outputCols=enc, labelCol=target, targetType="continuous", handleInvalid="keep", smoothing=10.0),
            # as plain numbers: the encoded column still carries the index's category attributes
            SQLTransformer(statement="select *, " + ", ".join(f"{e} + 0D as {m}" for e, m in zip(enc, mean)) + " from __THIS__"),
        ]
    prepared = Pipeline(stages=[*stages, VectorAssembler(inputCols=[*nums, *mean], outputCol="features", handleInvalid="keep")]).fit(tr)
    rows = prepared.transform(tr).select("features", target, F.lit(False).alias("is_val"))
    gbt = GBTRegressor(featuresCol="features", labelCol=target, maxIter=max_iter, stepSize=step, maxDepth=depth, subsamplingRate=subsample,
                       featureSubsetStrategy=feature_fraction, maxBins=64, validationTol=tol, seed=seed)
    if validation is not None:
        va, _, _ = model_frame(validation, target)
        va = prepared.transform(va.withColumn(target, F.col(target).cast("double")))
        rows = rows.unionByName(va.select("features", target, F.lit(True).alias("is_val")))
        gbt.setValidationIndicatorCol("is_val")
    return PipelineModel([*prepared.stages, gbt.fit(rows)])


def fit_primary_stopping(train: DataFrame, target: str, stop_days: int = DEFAULT_HOLDOUT_DAYS, **options):
    """``fit_primary`` on all but the last ``stop_days`` days of the training rows, which decide when to stop."""
    fit_rows, stop_rows = temporal_split(train, default_split_date(train, stop_days))
    return fit_primary(fit_rows, target, validation=stop_rows, **options)


def predict_primary(model, df: DataFrame, target: str) -> DataFrame:
    fr, _, _ = model_frame(df, target)
    return model.transform(fr).select("product", "date", F.greatest(F.col("prediction"), F.lit(0.0)).alias("pred"))


def _scaled_sql(samples: DataFrame, seq_len: int) -> tuple[str, list[str]]:
    """The challenger's columns as SQL, with the training rows' statistics in it, and their names.

    Every value of the history and the context is scaled by its variable's mean and population deviation (D14) over the
    training samples (their newest history row, and their context); a null becomes the mean, and the share of nulls of a variable is a column of its own.
    """
    last = f"get(history, {seq_len - 1})"
    source = {f"h_{c}": f"{last}.{c}" for c in HISTORY_COLUMNS} | {f"c_{c}": f"context.{c}" for c in CONTEXT_COLUMNS}
    stats = fit_scaler(samples.select(*[F.expr(e).cast("double").alias(k) for k, e in source.items()]), list(source)).first()

    def scaled(value: str, k: str) -> str:
        mean = stats[f"{k}__mean"] or 0.0
        return f"coalesce((cast({value} as double) - {mean!r}D) / {stats[f'{k}__std']!r}D, 0D)"

    cols = {f"h{i}_{c}": scaled(f"get(history, {i}).{c}", f"h_{c}") for i in range(seq_len) for c in HISTORY_COLUMNS}
    cols |= {f"c_{c}": scaled(f"context.{c}", f"c_{c}") for c in CONTEXT_COLUMNS}
    cols |= {f"null_h_{c}": f"aggregate(history, 0D, (n, r) -> n + if(r.{c} is null, 1D, 0D)) / {seq_len}D" for c in HISTORY_COLUMNS}
    cols |= {f"null_c_{c}": f"if(context.{c} is null, 1D, 0D)" for c in CONTEXT_COLUMNS}
    ids = "coalesce(product, '<unknown>') as id_product, coalesce(weather, '<unknown>') as id_weather"
    return "select *, " + ids + ", " + ", ".join(f"{e} as {k}" for k, e in cols.items()) + " from __THIS__", list(cols)


def fit_challenger(samples: DataFrame, reg: float = 0.1, seq_len: int = 14, id_width: int = 256):
    """Linear model on the scaled history and context and the hashed product and weather, as one fitted Pipeline.

    Scaling and imputation come from ``samples`` alone; ids are hashed to ``id_width`` places, so a product never seen needs no index.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import FeatureHasher, SQLTransformer, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    statement, cols = _scaled_sql(samples, seq_len)
    return Pipeline(stages=[
        SQLTransformer(statement=statement),
        FeatureHasher(inputCols=["id_product", "id_weather"], outputCol="ids", numFeatures=id_width),
        VectorAssembler(inputCols=[*cols, "ids"], outputCol="features"),
        LinearRegression(featuresCol="features", labelCol="target", regParam=reg, elasticNetParam=0.0),
    ]).fit(samples)


def predict_challenger(model, samples: DataFrame) -> DataFrame:
    return model.transform(samples).select(
        "product", "date", F.greatest(F.col("prediction"), F.lit(0.0)).alias("pred")
    )


def save_model(model, path: str) -> None:
    """Fitted pipeline (indexers + assembler + model) saved together."""
    model.write().overwrite().save(path)


def load_pipeline(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def read_features(spark, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    """A5: re-read a stored feature table, re-typing the date key. A CSV file has no types: give ``schema``, or its columns are text."""
    r = spark.read.format(fmt) if schema is None else spark.read.format(fmt).schema(schema)
    if fmt == "csv":
        r = r.option("header", True)
    df = r.load(path)
    return df.withColumn("date", F.col("date").cast("date")).withColumn("product", F.col("product").cast("string"))
