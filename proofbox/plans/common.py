"""Helpers shared by the registered query plans."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DOUBLE_DP = 6
TRIG_DP = 9
TRIG_COLUMNS = {"dow_sin", "dow_cos", "month_sin", "month_cos"}


def round_doubles(df: DataFrame, dp: int = DOUBLE_DP, trig: Iterable[str] = TRIG_COLUMNS) -> DataFrame:
    """Round every double column for engine-independent comparison (presentation only)."""
    trig = set(trig)
    cols = []
    for name, typ in df.dtypes:
        if typ in ("double", "float"):
            cols.append(F.round(F.col(f"`{name}`"), TRIG_DP if name in trig else dp).alias(name))
        else:
            cols.append(F.col(f"`{name}`"))
    return df.select(*cols)


def sql_round_list(cols: Iterable[str], dp: int = DOUBLE_DP, trig: Iterable[str] = TRIG_COLUMNS) -> str:
    trig = set(trig)
    return ", ".join(f"round({c}, {TRIG_DP if c in trig else dp}) as {c}" for c in cols)
