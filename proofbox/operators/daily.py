"""Ledger -> daily operational table (one row per date and product).

The ledger is append-only and can be huge; the daily table is bounded by
(number of days x number of products). ``daily_table`` is a single hash
aggregate: Spark runs it as partial (map-side) + final aggregation, so a hot
product never travels as raw rows through one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofbox.functions.exprs import nan_to_null, parse_date, parse_money, parse_num

# Point-of-sale export headers and their canonical names.
RAW_HEADER_NAMES = {"No.": "date", "상품명": "product", "수량": "qty", "실매출": "sales"}
REQUIRED_RAW = ("date", "product", "qty")
WEATHER_COLUMNS = ("weather", "temp_avg", "temp_max", "temp_min")

# The 19-column daily contract, in output order.
DAILY_COLUMNS = [
    "date", "product",
    "sold_qty", "waste_qty", "made_qty", "net_qty",
    "gross_sales", "waste_value",
    "weather", "temp_avg", "temp_max", "temp_min",
    "has_positive_row", "has_negative_row",
    "positive_row_count", "negative_row_count", "source_row_count",
    "only_negative_flag", "multi_negative_rows_flag",
]


def require_columns(df: DataFrame, required: Iterable[str], what: str = "table") -> DataFrame:
    """Contract check on the schema only (no Spark job)."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"Missing required columns from {what}: {missing}")
    return df


def normalise_columns(
    df: DataFrame, mapping: Mapping[str, str] = RAW_HEADER_NAMES, required: Sequence[str] = REQUIRED_RAW
) -> DataFrame:
    """Rename known headers to canonical names; other names pass through."""
    present = {k: v for k, v in mapping.items() if k in df.columns}
    out = df.withColumnsRenamed(present) if present else df
    return require_columns(out, required, "raw ledger")


def ensure_columns(df: DataFrame) -> DataFrame:
    """Absent sales -> 0.0; absent weather -> null string; absent temp_* -> null double."""
    adds = {}
    if "sales" not in df.columns:
        adds["sales"] = F.lit(0.0)
    if "weather" not in df.columns:
        adds["weather"] = F.lit(None).cast("string")
    for c in ("temp_avg", "temp_max", "temp_min"):
        if c not in df.columns:
            adds[c] = F.lit(None).cast("double")
    return df.withColumns(adds) if adds else df


def select_positions(df: DataFrame, positions: Sequence[int], names: Sequence[str]) -> DataFrame:
    """Pick columns by position and rename them (header-agnostic readers)."""
    if len(positions) != len(names):
        raise ValueError("positions and names differ in length")
    bad = [i for i in positions if i >= len(df.columns)]
    if bad:
        raise IndexError(f"column positions {bad} out of range for {len(df.columns)} columns")
    return df.select(*[F.col(f"`{df.columns[i]}`").alias(n) for i, n in zip(positions, names)])


def clean_ledger(df: DataFrame, date_formats: Sequence[str] | None = None) -> DataFrame:
    """Raw (text) ledger -> typed ledger: A2, A3, B1, B2.

    Dates that do not parse become null (and are dropped by ``daily_table``);
    quantities and sales that do not parse become 0.
    """
    df = ensure_columns(normalise_columns(df))
    if "line_ord" in df.columns and dict(df.dtypes)["line_ord"] == "string":
        df = df.withColumn("line_ord", F.col("line_ord").try_cast("long"))  # input order read back from text
    date = parse_date("date", date_formats) if date_formats else parse_date("date")
    sales = F.col("sales")
    return df.withColumns(
        {
            "date": date,
            "qty": parse_num("qty"),
            "sales": parse_money(sales) if dict(df.dtypes)["sales"] == "string" else F.coalesce(sales, F.lit(0)),
            "temp_avg": nan_to_null(F.col("temp_avg").cast("double")),
            "temp_max": nan_to_null(F.col("temp_max").cast("double")),
            "temp_min": nan_to_null(F.col("temp_min").cast("double")),
        }
    )


def split_sign(df: DataFrame) -> DataFrame:
    """Row-level sign split (B5): positive lines are sold, negative lines are waste."""
    q, s = F.col("qty"), F.col("sales")
    pos, neg = q > 0, q < 0
    zero_s = F.lit(0).cast(dict(df.dtypes).get("sales", "double"))
    return df.withColumns(
        {
            "is_positive": pos.cast("int"),
            "is_negative": neg.cast("int"),
            "positive_qty": F.when(pos, q).otherwise(F.lit(0.0)),
            "negative_qty": F.when(neg, q).otherwise(F.lit(0.0)),
            "positive_sales": F.when(pos, s).otherwise(zero_s),
            "negative_sales": F.when(neg, s).otherwise(zero_s),
        }
    )


def drop_null_keys(df: DataFrame, keys: Sequence[str] = ("date", "product")) -> DataFrame:
    return df.dropna(subset=list(keys))


TEMPS = ("temp_avg", "temp_max", "temp_min")


def line_sums(ledger: DataFrame, ordinal: str | None = "line_ord") -> DataFrame:
    """Sums per (date, product, weather) of the lines with a date and a product, with the first
    ordinal of the weather and of each temperature (D2).

    Grouping by weather keeps every aggregation buffer fixed-width, so Spark runs a map-side partial + final HASH
    aggregate (a string such as weather in a buffer would force a sort-based one). The rows are partial sums: those of
    several inputs may be put together and folded.
    """
    df = ensure_columns(ledger)
    if ordinal is None or ordinal not in df.columns:
        df, ordinal = df.withColumn("__ord", F.lit(0).cast("long")), "__ord"
    df, o = split_sign(drop_null_keys(df)), F.col(ordinal)
    return df.groupBy("date", "product", "weather").agg(
        F.count("qty").alias("n"),
        F.sum("is_positive").alias("npos"),
        F.sum("is_negative").alias("nneg"),
        F.sum("positive_qty").alias("sold"),
        F.sum("negative_qty").alias("neg"),
        F.sum("positive_sales").alias("gross"),
        F.sum("negative_sales").alias("negs"),
        F.min(F.when(F.col("weather").isNotNull(), o)).alias("w_ord"),
        *[F.min(F.when(F.col(t).isNotNull(), o)).alias(f"{t}__ord") for t in TEMPS],
        *[F.min_by(F.col(t), F.when(F.col(t).isNotNull(), o)).alias(t) for t in TEMPS],
    )


def merge_sums(sums: DataFrame) -> DataFrame:
    """Partial sums of several inputs as one row per (date, product, weather)."""
    types = dict(sums.dtypes)
    merged = sums.groupBy("date", "product", "weather").agg(
        *[F.sum(c).cast(types[c]).alias(c) for c in ("n", "npos", "nneg", "sold", "neg", "gross", "negs")],
        *[F.min(c).alias(c) for c in ("w_ord", *(f"{t}__ord" for t in TEMPS))],
        *[F.min_by(t, f"{t}__ord").alias(t) for t in TEMPS],
    )
    return merged.select(sums.columns)


def fold_days(sums: DataFrame) -> DataFrame:
    """The daily table from partial sums: a second, daily-sized aggregation folds the weather groups of each (date, product)."""
    gross_t = dict(sums.dtypes)["gross"]
    agg = sums.groupBy("date", "product").agg(
        F.sum("n").cast("int").alias("source_row_count"),
        F.sum("npos").cast("int").alias("positive_row_count"),
        (F.sum("npos") > 0).cast("int").alias("has_positive_row"),
        F.sum("nneg").cast("int").alias("negative_row_count"),
        (F.sum("nneg") > 0).cast("int").alias("has_negative_row"),
        F.sum("sold").alias("sold_qty"),
        F.sum("neg").alias("raw_waste_qty"),
        F.sum("gross").cast(gross_t).alias("gross_sales"),
        F.sum("negs").cast(gross_t).alias("raw_waste_value"),
        F.min_by("weather", "w_ord").alias("weather"),
        *[F.min_by(t, f"{t}__ord").alias(t) for t in TEMPS],
    )
    return derive_daily(agg)


def daily_table(ledger: DataFrame, ordinal: str | None = "line_ord", by_product: bool = True) -> DataFrame:
    """Per (date, product) sums of the sign-split quantities, counts and flags.

    ``ordinal`` names a column giving input order for the first-valid weather
    and temperature (D2); without one, any valid value is taken. Null keys are
    dropped before the aggregation (same result, less shuffle).

    Two hash aggregates: the ledger-sized one per (date, product, weather), and the daily-sized fold. With
    ``by_product`` the folded rows are hash-partitioned by product in between: the fold then needs no exchange of its own, and
    the output has the distribution that per-product windows need. A consumer without such windows
    leaves it out, so that a hot product does not meet in one task.
    """
    sums = line_sums(ledger, ordinal)
    return fold_days(sums.repartition("product") if by_product else sums)


def derive_daily(agg: DataFrame) -> DataFrame:
    """B9 + B10 on the aggregated rows, projected to the 19-column contract."""
    waste = F.abs("raw_waste_qty")
    return agg.select(
        "date",
        "product",
        F.col("sold_qty").cast("double").alias("sold_qty"),
        waste.cast("double").alias("waste_qty"),
        (F.col("sold_qty") + waste).cast("double").alias("made_qty"),
        (F.col("sold_qty") - waste).cast("double").alias("net_qty"),
        F.col("gross_sales"),
        F.abs("raw_waste_value").alias("waste_value"),
        *WEATHER_COLUMNS,
        "has_positive_row",
        "has_negative_row",
        "positive_row_count",
        "negative_row_count",
        "source_row_count",
        ((F.col("has_negative_row") == 1) & (F.col("has_positive_row") == 0)).cast("int").alias("only_negative_flag"),
        (F.col("negative_row_count") > 1).cast("int").alias("multi_negative_rows_flag"),
    )


def union_panels(a: DataFrame, b: DataFrame) -> DataFrame:
    """G1: append two panels with the same columns (matched by name)."""
    return a.unionByName(b)


def order_panel(df: DataFrame, by: Sequence[str] = ("date", "product")) -> DataFrame:
    """a total order for sinks (distributed range sort)."""
    return df.orderBy(*by)


def write_daily(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """A4: write the daily table partitioned by month so readers prune by date."""
    out = df.withColumn("month", F.date_format("date", "yyyy-MM"))
    w = out.write.mode(mode).partitionBy("month")
    if fmt == "parquet":
        w.parquet(path)
    elif fmt == "csv":
        w.option("header", True).csv(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")
