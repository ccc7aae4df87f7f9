"""Per-product linear demand model, weekday seasonality, waste statistics and
what-if scoring (B3, B4, B7, B8, C5, C6, D3-D7, I2-I4, A8, A9).

Every statistic is a ``groupBy(product)`` aggregate that Spark computes with
map-side partial aggregation, so a product holding a third of the ledger
costs one partial row per task, never a task full of raw rows. The least-squares
fit (D7) is a closed form over sums per (product, weekday).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofbox.functions.exprs import WEEKDAYS, parse_date, product_key, rain_flag, round_half_up_int0

DAY_KEYS = [f"day_{d}" for d in WEEKDAYS]
REGRESSORS = DAY_KEYS + ["is_rain", "temp"]


def bround_dec(x: Column | str, dp: int) -> Column:
    """Half-even rounding on the shortest decimal form of a double (engine-independent)."""
    c = F.col(x) if isinstance(x, str) else x
    return F.bround(c.cast("decimal(38,12)"), dp).cast("double")


# ------------------------------------------------------------------ inputs

def legacy_frame(df: DataFrame, cols: Sequence[str] = ("date", "product", "qty", "weather", "temp_avg")) -> DataFrame:
    """The legacy scripts' five columns: date, product, qty, weather, temp."""
    return df.select(*[F.col(c) for c in cols]).toDF("date", "product", "qty", "weather", "temp")


def parse_date_or_fallback(df: DataFrame, col: str = "date", strict: str = "yyyyMMdd",
                           fallback: Sequence[str] = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "yyyyMMdd")) -> DataFrame:
    """Parse with ``strict``; only if EVERY row fails, parse with the fallback list.

    The "every row failed" test is a scalar subquery (one distributed count),
    not a join or a driver-side loop.
    """
    strict_parsed = F.try_to_timestamp(F.col(col).cast("string"), F.lit(strict)).cast("date")
    n_ok = df.select(F.count(strict_parsed).alias("n")).scalar()
    return df.withColumn(col, F.when(n_ok > 0, strict_parsed).otherwise(parse_date(col, fallback)))


def health_report(df: DataFrame, col: str = "date", fmt: str = "yyyyMMdd") -> DataFrame:
    """Total rows and rows whose date does not parse with ``fmt`` (one aggregate)."""
    bad = F.try_to_timestamp(F.col(col).cast("string"), F.lit(fmt)).isNull()
    return df.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(bad).alias("invalid_dates"))


def health_examples(df: DataFrame, col: str = "date", fmt: str = "yyyyMMdd", order: Sequence[str] = (), n: int = 5) -> DataFrame:
    """Up to ``n`` offending raw values, first in input order (top-n, not a full sort)."""
    bad = F.try_to_timestamp(F.col(col).cast("string"), F.lit(fmt)).isNull()
    return df.filter(bad).orderBy(*order).limit(n).select(F.col(col).alias("raw_date"))


# ------------------------------------------------------------------ seasonality

def global_means(df: DataFrame) -> DataFrame:
    """D3: mean qty per product (over every ledger line)."""
    return df.groupBy("product").agg(F.avg("qty").alias("base_avg"))


def weekday_means(df: DataFrame) -> DataFrame:
    """Mean qty per product and weekday (Monday = 0)."""
    return df.groupBy("product", F.weekday("date").alias("day_num")).agg(F.avg("qty").alias("day_avg"))


def factor_grid(products: DataFrame, day_means: DataFrame) -> DataFrame:
    """Every product x 7 weekdays; a weekday never seen -> factor 1.0.

    The 7 rows per product come from ``explode(sequence(0, 6))`` (no join),
    then one left equi-join brings the weekday means in.
    """
    grid = products.select("product", "base_avg", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("day_num"))
    j = grid.join(day_means, ["product", "day_num"], "left")
    return j.select(
        "product",
        "day_num",
        F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), F.col("day_num") + 1).alias("day_name"),
        F.when(F.col("day_avg").isNull(), F.lit(1.0)).otherwise(bround_dec(F.col("day_avg") / F.col("base_avg"), 2)).alias("factor"),
        bround_dec("base_avg", 1).alias("base_avg"),
    )


def seasonality(df: DataFrame, strip_spaces: bool = True) -> DataFrame:
    """D5 (long form): product, day_num, day_name, factor (2 dp), base_avg (1 dp).

    Rows without a date are dropped; products whose mean is 0 are skipped.
    """
    x = df.dropna(subset=["date"])
    if strip_spaces:
        x = x.withColumn("product", F.replace(F.col("product").cast("string"), F.lit(" "), F.lit("")))
    g = global_means(x).filter(F.col("base_avg") != 0)
    return factor_grid(g, weekday_means(x))


def seasonality_nested(long: DataFrame) -> DataFrame:
    """D5 nested form: product, base_avg, factors map<weekday name, factor>."""
    return long.groupBy("product").agg(
        F.first("base_avg").alias("base_avg"),
        F.map_from_entries(F.collect_list(F.struct("day_name", "factor"))).alias("factors"),
    )


# ------------------------------------------------------------------ waste statistics

def waste_stats(df: DataFrame, min_rows: int = 2) -> DataFrame:
    """Totals and per-row averages (1 dp) per product; products with < min_rows rows skipped."""
    q = F.col("qty")
    g = df.groupBy("product").agg(
        F.sum(F.when(q > 0, q).otherwise(F.lit(0.0))).alias("total_sold"),
        F.sum(F.when(q < 0, -q).otherwise(F.lit(0.0))).alias("total_waste"),
        F.count(F.lit(1)).alias("row_count"),
    )
    return g.filter(F.col("row_count") >= min_rows).select(
        "product",
        "total_sold",
        "total_waste",
        (F.col("total_sold") + F.col("total_waste")).alias("total_made"),
        "row_count",
        bround_dec(F.col("total_waste") / F.col("row_count"), 1).alias("avg_waste"),
        bround_dec((F.col("total_sold") + F.col("total_waste")) / F.col("row_count"), 1).alias("avg_made"),
    )


# ------------------------------------------------------------------ demand fit

#: Share of a sum of squares below which its within-weekday part counts as zero.
RANK_SHARE = 1e-9


def weekday_sums(df: DataFrame) -> DataFrame:
    """Per (product, weekday): row and waste totals over every row, and over rows with qty > 0
    the count, sums and products of qty, rain (0/1) and temp. Fixed-width sums, so one partial row per key and task."""
    q, temp = F.col("qty"), F.col("temp").cast("double")
    rain = rain_flag(F.coalesce(F.col("weather").cast("string"), F.lit("nan"))).cast("double")
    pos = q > 0

    def total(c: Column, where: Column = pos) -> Column:
        return F.coalesce(F.sum(F.when(where, c)), F.lit(0.0))

    return df.groupBy("product", F.weekday("date").alias("wd")).agg(
        F.count(F.lit(1)).alias("rows"), total(q).alias("sold"), total(-q, q < 0).alias("waste"),
        F.count_if(pos).alias("n"), F.count_if(pos & temp.isNull()).alias("n_null"),
        total(q).alias("sy"), total(rain).alias("sr"), total(temp).alias("st"), total(rain * temp).alias("srt"), total(temp * temp).alias("stt"),
        total(rain * q).alias("sry"), total(temp * q).alias("sty"),
    )


def fit_demand(df: DataFrame, min_rows: int = 2) -> DataFrame:
    """D7 (+ D6): per product, least squares of qty on weekday dummies, rain and temperature over rows
    with qty > 0 (minimum norm of the centred problem, as ``lstsq`` gives it), and the waste statistics.

    The closed form of the within-group estimator: centred inside each weekday, only rain and temperature are
    left, a 2 x 2 system of within-weekday sums; the weekday effects are the weekdays' mean residuals,
    centred over the weekdays seen (unseen ones get 0). Where rain or temperature does not vary inside the weekdays, or one
    follows from the other there, the system has rank 1 or 0, and the remaining freedom goes to the smallest
    squared norm of all coefficients: along one direction (rank 1), or a ridge of weight 1 over the weekday means (rank 0).

    Products with fewer than ``min_rows`` ledger rows are skipped; <= 2 positive
    rows -> base 0 and no weights; a null temperature makes the fit fail ->
    base = mean qty, no weights (the legacy behaviour). Coefficients 2 dp.
    Two hash aggregates, (product, weekday), then product over at most 7 rows each; no Python.
    """
    d = weekday_sums(df.dropna(subset=["date"]))
    c, seen = F.col, F.col("n") > 0

    def over(x: Column) -> Column:
        return F.coalesce(F.sum(F.when(seen, x)), F.lit(0.0))

    d = d.withColumns({m: F.when(seen, c(f"s{m[1]}") / c("n")) for m in ("my", "mr", "mt")})
    within = {"r_r": ("sr", "mr", "mr"), "r_t": ("srt", "mr", "mt"), "t_t": ("stt", "mt", "mt"), "r_y": ("sry", "mr", "my"), "t_y": ("sty", "mt", "my")}
    products = {"rr": ("mr", "mr"), "rt": ("mr", "mt"), "tt": ("mt", "mt"), "ry": ("mr", "my"), "ty": ("mt", "my")}
    g = d.groupBy("product").agg(
        F.sum("rows").alias("rows"), F.sum("sold").alias("sold"), F.sum("waste").alias("waste"), F.sum("n").alias("n"), F.sum("n_null").alias("n_null"),
        *[F.sum(f"s{v}").alias(f"s{v}") for v in "yrt"], F.sum("stt").alias("stt"), F.count_if(seen).alias("k"),
        *[over(c(total) - c("n") * c(x) * c(y)).alias(name) for name, (total, x, y) in within.items()],
        *[over(c(m)).alias(m) for m in ("my", "mr", "mt")], *[over(c(x) * c(y)).alias(name) for name, (x, y) in products.items()],
        F.map_from_entries(F.collect_list(F.when(seen, F.struct("wd", F.struct("n", "my", "mr", "mt"))))).alias("days"),
    ).filter(c("rows") >= min_rows)
    # Moments of the weekday means about their own means.
    g = g.withColumns({name: c(name) - c(x) * c(y) / F.greatest(c("k"), F.lit(1)) for name, (x, y) in products.items()})
    r_ok, t_ok = c("r_r") > RANK_SHARE * c("sr"), c("t_t") > RANK_SHARE * c("stt")
    g = g.withColumns({"a": F.when(r_ok, c("r_r")).otherwise(0.0), "b": F.when(r_ok & t_ok, c("r_t")).otherwise(0.0), "e": F.when(t_ok, c("t_t")).otherwise(0.0)})
    det, trace = c("a") * c("e") - c("b") * c("b"), c("a") + c("e")
    full = det > RANK_SHARE * c("a") * c("e")
    ridge = (1 + c("rr")) * (1 + c("tt")) - c("rt") * c("rt")
    # Rank 1: a solution, and the direction (u, v) that stays free.
    g = g.withColumns({
        "rank": F.when(full, 2).when(trace > 0, 1).otherwise(0),
        "b1": F.when(full, (c("e") * c("r_y") - c("b") * c("t_y")) / det).when(trace > 0, (c("a") * c("r_y") + c("b") * c("t_y")) / (trace * trace))
        .otherwise(((1 + c("tt")) * c("ry") - c("rt") * c("ty")) / ridge),
        "b2": F.when(full, (c("a") * c("t_y") - c("b") * c("r_y")) / det).when(trace > 0, (c("b") * c("r_y") + c("e") * c("t_y")) / (trace * trace))
        .otherwise(((1 + c("rr")) * c("ty") - c("rt") * c("ry")) / ridge),
        "u": F.when(c("a") > 0, -c("b")).otherwise(F.lit(1.0)), "v": F.when(c("a") > 0, c("a")).otherwise(F.lit(0.0)),
    })
    along = c("u") * c("b1") + c("v") * c("b2") - c("u") * (c("ry") - c("b1") * c("rr") - c("b2") * c("rt")) - c("v") * (c("ty") - c("b1") * c("rt") - c("b2") * c("tt"))
    length = c("u") * c("u") + c("v") * c("v") + c("u") * c("u") * c("rr") + 2 * c("u") * c("v") * c("rt") + c("v") * c("v") * c("tt")
    g = g.withColumn("move", F.when(c("rank") == 1, along / length).otherwise(0.0))
    g = g.withColumns({"b1": c("b1") - c("move") * c("u"), "b2": c("b2") - c("move") * c("v")})
    g = g.withColumns({m: c(m) / F.greatest(c("k"), F.lit(1)) for m in ("my", "mr", "mt")})

    def effect(i: int) -> Column:
        day = F.try_element_at(c("days"), F.lit(i))
        return F.when(day.isNotNull(), (day["my"] - c("my")) - c("b1") * (day["mr"] - c("mr")) - c("b2") * (day["mt"] - c("mt"))).otherwise(0.0)

    g = g.withColumns({f"e{i}": effect(i) for i in range(7)})
    share = [F.coalesce(F.try_element_at(c("days"), F.lit(i))["n"], F.lit(0)) / c("n") for i in range(7)]
    base = c("sy") / c("n") - c("b1") * c("sr") / c("n") - c("b2") * c("st") / c("n")
    for i in range(7):
        base = base - share[i] * c(f"e{i}")
    weights = F.map_from_arrays(F.array(*[F.lit(k) for k in REGRESSORS]), F.array(*[bround_dec(c(x), 2) for x in [*(f"e{i}" for i in range(7)), "b1", "b2"]]))
    few, failed = c("n") <= 2, c("n_null") > 0
    return g.select(
        "product", c("n").alias("n_fit_rows"),
        F.when(few, F.lit(0.0)).when(failed, c("sy") / c("n")).otherwise(bround_dec(base, 2)).alias("base_bias"),
        F.when(few | failed, F.create_map().cast("map<string,double>")).otherwise(weights).alias("weights"),
        F.when(few, "too_few_rows").when(failed, "fit_failed").otherwise("ok").alias("fit_status"),
        bround_dec(c("waste") / c("rows"), 1).alias("waste_risk"), bround_dec((c("sold") + c("waste")) / c("rows"), 1).alias("avg_made"),
    )


def coefficients(fit: DataFrame, waste: DataFrame | None = None) -> DataFrame:
    """Coefficient table: product, base_bias, weights, waste_risk, avg_made."""
    if waste is None and "waste_risk" in fit.columns:
        return fit.select("product", "base_bias", "weights", "waste_risk", "avg_made")
    base = fit.drop("waste_risk", "avg_made")
    return base.join(waste.select("product", "avg_waste", "avg_made"), "product", "left").select(
        "product",
        "base_bias",
        "weights",
        F.coalesce("avg_waste", F.lit(0.0)).alias("waste_risk"),
        F.coalesce("avg_made", F.lit(0.0)).alias("avg_made"),
    )


# ------------------------------------------------------------------ JSON

COEF_JSON_SCHEMA = "map<string, struct<base_bias: double, weights: map<string, double>, waste_risk: double, avg_made: double>>"


def to_keyed_json(coeffs: DataFrame) -> DataFrame:
    """One JSON object per product line, keyed by product (distributed write form)."""
    body = F.struct("base_bias", "weights", "waste_risk", "avg_made")
    return coeffs.select(F.to_json(F.create_map(F.col("product"), body)).alias("value"))


def write_keyed_json(coeffs: DataFrame, path: str, mode: str = "overwrite") -> None:
    to_keyed_json(coeffs).write.mode(mode).text(path)


def parse_coefficients(text: DataFrame, col: str = "value") -> DataFrame:
    """JSON text (one object per line, or one whole object) -> one row per product.

    Missing waste_risk / avg_made -> 0.0; the key is canonicalised (spaces removed).
    """
    m = F.from_json(F.col(col), COEF_JSON_SCHEMA)
    e = text.select(F.explode(m).alias("product", "c"))
    return e.select(
        product_key("product").alias("product_key"),
        F.col("product"),
        F.col("c.base_bias").alias("base_bias"),
        F.coalesce(F.col("c.weights"), F.create_map().cast("map<string,double>")).alias("weights"),
        F.coalesce(F.col("c.waste_risk"), F.lit(0.0)).alias("waste_risk"),
        F.coalesce(F.col("c.avg_made"), F.lit(0.0)).alias("avg_made"),
    )


def read_coefficients(spark, path: str, whole_file: bool = False) -> DataFrame:
    return parse_coefficients(spark.read.text(path, wholetext=whole_file))


# ------------------------------------------------------------------ scoring

def attach_coefficients(products: DataFrame, coeffs: DataFrame, name_col: str = "product") -> DataFrame:
    """Products left-joined to coefficients on the canonical name; unmatched -> zeros."""
    c = coeffs if "product_key" in coeffs.columns else coeffs.withColumn("product_key", product_key("product"))
    c = c.select("product_key", "base_bias", "weights", "waste_risk", "avg_made")
    p = products.withColumn("product_key", product_key(name_col))
    j = p.join(c, "product_key", "left")
    return j.withColumn("has_model", F.col("base_bias").isNotNull()).drop("product_key")


def _w(key: Column | str) -> Column:
    k = F.lit(key) if isinstance(key, str) else key
    return F.coalesce(F.try_element_at(F.col("weights"), k), F.lit(0.0))


def score_demand(df: DataFrame, day: str = "day_name", weather: str = "weather", temp: str = "temp") -> DataFrame:
    """I2 + I3 over rows that carry coefficients plus a scenario (day name, weather, temp).

    Output adds base_score, day_effect, rain_effect, temp_effect, predicted,
    recommended (half-up, floored at 0), status and color. Rows without a
    model get zeros and status 'No Data'.
    """
    has = F.col("has_model") if "has_model" in df.columns else F.col("base_bias").isNotNull()
    day_effect = _w(F.concat(F.lit("day_"), F.col(day)))
    rain = rain_flag(weather, ignore_case=True) == 1
    rain_effect = F.when(rain, _w("is_rain")).otherwise(F.lit(0.0))
    temp_effect = F.col(temp) * _w("temp")
    predicted = F.col("base_bias") + day_effect + rain_effect + temp_effect
    scored = df.withColumns(
        {
            "base_score": F.when(has, F.col("base_bias")).otherwise(F.lit(0.0)),
            "day_effect": F.when(has, day_effect).otherwise(F.lit(0.0)),
            "rain_effect": F.when(has, rain_effect).otherwise(F.lit(0.0)),
            "temp_effect": F.when(has, temp_effect).otherwise(F.lit(0.0)),
            "predicted": F.when(has, predicted).otherwise(F.lit(0.0)),
            "recommended": F.when(has, round_half_up_int0(predicted)).otherwise(F.lit(0)),
            "waste_risk": F.coalesce("waste_risk", F.lit(0.0)),
            "avg_made": F.coalesce("avg_made", F.lit(0.0)),
        }
    )
    return scored.withColumns({"status": score_status(has, day), "color": F.lit(None).cast("string")}).withColumn(
        "color", status_color("status")
    )


def score_status(has: Column, day: str = "day_name") -> Column:
    """Later rules overwrite earlier ones, so test them in reverse priority."""
    d, r, t = F.col("day_effect"), F.col("rain_effect"), F.col("temp_effect")
    return (
        F.when(~has, F.lit("No Data"))
        .when((F.col("temp") > 25) & (t >= 1.0), F.lit("Heat Spike"))
        .when(r <= -1.0, F.lit("Rain Drop"))
        .when(d >= 1.0, F.concat(F.col(day), F.lit(" Boost")))
        .when(d <= -1.0, F.concat(F.col(day), F.lit(" Drop")))
        .otherwise(F.lit("Stable"))
    )


def status_color(status: str) -> Column:
    s = F.col(status)
    return (
        F.when(s.contains("Boost") | s.contains("Spike"), F.lit("green"))
        .when(s.contains("Drop") | s.contains("Rain"), F.lit("red"))
        .otherwise(F.lit("gray"))
    )


def score_scenarios(products: DataFrame | None, coeffs: DataFrame, scenarios: DataFrame, on: Sequence[str] = ("product",),
                    name_col: str = "product") -> DataFrame:
    """I4: score products under scenarios (day_name, weather, temp) without refitting.

    Scenarios are joined on ``on`` (e.g. per-product scenario rows): an
    equi-join, never a product-by-scenario cross product. With
    ``products=None`` the scenario rows carry the product name themselves and
    the coefficients are attached to them directly (one pass over scenarios).
    """
    if products is None:
        return score_demand(attach_coefficients(scenarios, coeffs, name_col))
    withc = attach_coefficients(products, coeffs, name_col)
    return score_demand(withc.join(scenarios, list(on), "inner"))
