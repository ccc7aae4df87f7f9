"""Reading and writing the point-of-sale export (A1, A4 helpers)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofbox.operators.forecast import fit_index


def read_ledger(spark: SparkSession, path: str | list[str], fmt: str = "csv", ordinal: str | None = None) -> DataFrame:
    """A1: the raw export as text columns, headers as written.

    CSV is read with a header and WITHOUT schema inference (every field stays
    text, so ``clean_ledger`` decides what parses); a UTF-8 byte-order mark
    is stripped by Spark's reader, and headers such as ``No.`` are kept
    verbatim (refer to them with backticks in SQL). ``ordinal`` names a column to add with the input order (``with_input_order``).
    """
    if fmt == "csv":
        df = spark.read.option("header", True).option("inferSchema", False).option("encoding", "UTF-8").csv(path)
    elif fmt == "parquet":
        df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    else:
        raise ValueError(f"unsupported format {fmt!r}")
    return df if ordinal is None else with_input_order(df, ordinal)


def with_input_order(df: DataFrame, ordinal: str) -> DataFrame:
    """``df``, just read from files, with a unique ordinal of its rows in input order: by file path, then place in the file.

    A row's place is the start of its file block and its position in the task that reads the block (rows of a
    block are read in order by one task). File paths are numbered in sorted order (D15). The ordinal is a
    decimal(38,0), file * 10^23 + block start * 10^10 + position: fixed-width, so that taking its minimum stays a hash aggregate.
    """
    placed = df.select(
        "*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__row"),
    )
    files = fit_index(df.select(F.col("_metadata.file_path").alias("__file")), "__file")  # one row per file
    whole = F.col("__file_idx").cast("decimal(38,0)") * F.lit(10**13).cast("decimal(14,0)") + F.col("__block").cast("decimal(19,0)")
    order = whole.cast("decimal(27,0)") * F.lit(10**10).cast("decimal(11,0)") + F.col("__row").cast("decimal(10,0)")
    return placed.join(files, "__file").withColumn(ordinal, order.cast("decimal(38,0)")).drop("__file", "__file_idx", "__block", "__row")


def write_ledger_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a ledger in the export's CSV form (header row, text fields), one file per partition."""
    df.write.mode(mode).option("header", True).csv(path)
