"""Column expressions (all JVM-side built-ins; no Python UDFs).

Each helper maps plain column(s) to a Column so it stays inside whole-stage
codegen wherever it is used.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weekday names, Monday first (weekday() numbering, Monday = 0).
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ------------------------------------------------------------- parsing

DEFAULT_DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "yyyyMMdd")


def parse_date(col: Column | str, formats: Sequence[str] = DEFAULT_DATE_FORMATS) -> Column:
    """Tolerant date parse: the first format that matches wins; no match -> null."""
    c = _c(col).cast("string")
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats]).cast("date")


def parse_num(col: Column | str) -> Column:
    """Tolerant numeric parse: null or unparsable -> 0.0."""
    return F.coalesce(_c(col).cast("string").try_cast("double"), F.lit(0.0))


def parse_money(col: Column | str) -> Column:
    """Tolerant money parse to decimal(18,2): null or unparsable -> 0.00."""
    return F.coalesce(_c(col).cast("string").try_cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))


def valid_iso_date(col: Column | str) -> Column:
    """True only for a strict ``yyyy-MM-dd`` date."""
    c = _c(col).cast("string")
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).isNotNull(), F.lit(False))


def nan_to_null(col: Column | str) -> Column:
    return F.nanvl(_c(col), F.lit(None).cast("double"))


# ------------------------------------------------------------- keys and flags

def product_key(col: Column | str) -> Column:
    """Canonical product key: every space removed, then trimmed."""
    return F.trim(F.replace(_c(col), F.lit(" "), F.lit("")))


def rain_flag(col: Column | str, ignore_case: bool = False) -> Column:
    """1 if the weather text mentions rain or snow, else 0 (null text -> 0)."""
    c = _c(col)
    if ignore_case:
        c = F.lower(c)
        hit = c.contains("rain") | c.contains("snow")
    else:
        hit = c.contains("Rain") | c.contains("Snow")
    return F.coalesce(hit, F.lit(False)).cast("int")


def phone_digits(col: Column | str) -> Column:
    return F.regexp_replace(_c(col), r"[^0-9]", "")


# ------------------------------------------------------------- arithmetic

def safe_div(num: Column | str, den: Column | str) -> Column:
    """num / den with den = 0 -> 0.0 (bare division by zero raises under ANSI)."""
    n, d = _c(num), _c(den)
    return F.when(d == 0, F.lit(0.0)).otherwise(F.try_divide(n.cast("double"), d.cast("double")))


def clip0(col: Column | str) -> Column:
    """max(0.0, x) as Python computes it: null stays null, NaN becomes 0.0
    (Spark's greatest() would keep NaN, which it orders above every number)."""
    c = _c(col).cast("double")
    return F.when(c.isNotNull(), F.greatest(F.nanvl(c, F.lit(0.0)), F.lit(0.0)))


def round_half_up_int0(col: Column | str) -> Column:
    """Scoring-side rounding: half-up to an integer, floored at 0."""
    return F.greatest(F.lit(0), F.floor(_c(col) + F.lit(0.5)).cast("int"))


def points_for(amount: Column | str, rate: str = "0.03") -> Column:
    """Loyalty points: truncate(amount * rate) computed in decimals, never doubles."""
    return (_c(amount).cast("decimal(18,2)") * F.lit(rate).cast("decimal(4,2)")).cast("int")


def net_paid(total: Column | str, used: Column | str, floor_at_zero: bool = True) -> Column:
    diff = _c(total) - _c(used)
    return F.greatest(diff, F.lit(0)) if floor_at_zero else diff


def gap_ratio(a: Column | str, b: Column | str) -> Column:
    """|a - b| / max(|a|, |b|); 0 when both are 0."""
    x, y = _c(a), _c(b)
    den = F.greatest(F.abs(x), F.abs(y))
    return F.when((x == 0) & (y == 0), F.lit(0.0)).otherwise(F.abs(x - y) / den)


# ------------------------------------------------------------- calendar (H1-H7)

def day_of_week(d: Column | str) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(_c(d))


def weekday_name(d: Column | str) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in WEEKDAYS]), F.weekday(_c(d)) + 1)


def cyc_sin(x: Column | str, period: float) -> Column:
    return F.sin(F.lit(2 * math.pi) * _c(x) / F.lit(float(period)))


def cyc_cos(x: Column | str, period: float) -> Column:
    return F.cos(F.lit(2 * math.pi) * _c(x) / F.lit(float(period)))


def weekday_dummies(d: Column | str, prefix: str = "day_") -> list[Column]:
    """Always all seven one-hot columns (day_Monday .. day_Sunday)."""
    wd = F.weekday(_c(d))
    return [(wd == i).cast("int").alias(f"{prefix}{name}") for i, name in enumerate(WEEKDAYS)]


# ------------------------------------------------------------- shop rules

def available_on(category: Column | str, d: Column | str) -> Column:
    """Menu availability: null/ALL always; HARD Thu-Sat; SOFT Sun, Mon, Wed; other -> never."""
    cat, wd = _c(category), F.weekday(_c(d))
    return (
        F.when(cat.isNull() | (cat == "ALL"), F.lit(True))
        .when(cat == "HARD", wd.isin(3, 4, 5))
        .when(cat == "SOFT", wd.isin(6, 0, 2))
        .otherwise(F.lit(False))
    )


def is_open(ts: Column | str, force: Column | str | None = None) -> Column:
    """Shop open: an override wins; closed Tuesday; else strictly between 09:00 and 17:00."""
    t = _c(ts)
    hms = F.date_format(t, "HH:mm:ss.SSSSSS")
    rule = (F.weekday(t) != 1) & (hms > F.lit("09:00:00.000000")) & (hms < F.lit("17:00:00.000000"))
    if force is None:
        return rule
    return F.coalesce(_c(force), rule)


def stock_badge(stock: Column | str) -> Column:
    s = _c(stock)
    return F.when(s <= 0, "SOLD_OUT").when(s <= 5, "LOW").otherwise("OK")


def order_badge(status: Column | str) -> Column:
    return F.when(_c(status) == "CANCELLED", "CANCELLED").otherwise("ACTIVE")
