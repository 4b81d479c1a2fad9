"""Monthly series: calendars, anomalies, forecasts and their checks. Many series at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from noticelake.operators.aggregates import month_label
from noticelake.storage import cut, drop

MAD_TO_SIGMA, MIN_SCALE, MIN_RISE, NEAR_RECORD = 0.6745, 1.0, 3.0, 0.9
BAND_Z = 1.0
SERIES = ["scope", "label"]


def add_months(label: Column, n: Column | int) -> Column:
    """A YYYY-MM label moved by months."""
    return F.date_format(F.add_months(F.to_date(F.concat(label, F.lit("-01"))), n if isinstance(n, Column) else F.lit(n)), "yyyy-MM")


def month_calendar(df: DataFrame, date: str = "report_date") -> DataFrame:
    """Every month from the first to the last that occurs."""
    ends = df.agg(F.min(F.trunc(date, "month")).alias("a"), F.max(F.trunc(date, "month")).alias("b")).where("a is not null")
    return ends.select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("m")).select(F.date_format("m", "yyyy-MM").alias("month"))


def gap_fill(series: DataFrame, calendar: DataFrame) -> DataFrame:
    """Every series over the whole calendar, missing months as zero."""
    keys = series.select(*SERIES).distinct()
    return keys.crossJoin(F.broadcast(calendar)).join(series, [*SERIES, "month"], "left").select(*SERIES, "month", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def scan_series(df: DataFrame, top_entities: int = 20) -> DataFrame:
    """The series that are watched: overall, each category, the most frequent entities.

    The notices are read once: a row names its series, one aggregation counts them by month, and all
    else, calendar, choice of entities and missing months, comes from those stored counts.
    """
    item = lambda scope, label: F.struct(F.lit(scope).alias("scope"), label.alias("label"))
    values = F.array_distinct(F.transform(F.coalesce("entities", F.array().cast("array<struct<type:string,value:string>>")), lambda e: e["value"]))
    named = F.concat(F.array(item("overall", F.lit("total")), item("category", F.col("category"))), F.transform(values, lambda v: item("entity", v)))
    rows = df.where("report_date is not null").select(month_label(F.col("report_date")).alias("month"), F.explode(named).alias("x")).select("x.*", "month").where("label is not null")
    counts = cut(rows.groupBy(*SERIES, "month").agg(F.count("*").alias("count")), "monthly")
    entities = counts.where("scope = 'entity'")
    best = entities.groupBy("label").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "label").limit(top_entities)
    kept = counts.where("scope <> 'entity'").unionByName(entities.join(best, "label", "left_semi").select(*counts.columns))
    months = month_calendar(counts.where("scope = 'overall'").select(F.to_date(F.concat("month", F.lit("-01"))).alias("m")), "m")
    filled = cut(gap_fill(kept, months), "series")
    drop(counts)
    return filled


def calendar_of(series: DataFrame) -> DataFrame:
    """The months of series without gaps."""
    return series.select("month").distinct()


def _dropped_last(series: DataFrame) -> DataFrame:
    """Without each series' last month, which is still in progress."""
    last = F.max("month").over(W.partitionBy(*SERIES))
    return series.withColumn("__last", last).where("month < __last").drop("__last")


def anomalies(series: DataFrame, window: int = 12, min_history: int = 6, threshold: float = 3.0) -> DataFrame:
    """Months far over their trailing median, or among the highest so far: baseline and z.

    Spread is the median absolute deviation, where that is zero the standard deviation, one at least.
    """
    each = W.partitionBy(*SERIES).orderBy("month")
    trailing = each.rowsBetween(-window, -1)
    before = each.rowsBetween(W.unboundedPreceding, -1)
    v = F.col("count").cast("double")
    scored = _dropped_last(series).select(
        *SERIES, "month", "count", F.row_number().over(each).alias("n"), F.percentile(v, F.lit(0.5)).over(trailing).alias("baseline"),
        F.collect_list(v).over(trailing).alias("h"), F.stddev_pop(v).over(trailing).alias("sd"), F.percentile(v, F.lit(NEAR_RECORD)).over(before).alias("high"),
    ).where(F.col("n") > min_history)
    away = F.array_sort(F.transform("h", lambda x: F.abs(x - F.col("baseline"))))
    size = F.size("h")
    mid = F.floor((size + 1) / 2).cast("int")
    scored = scored.withColumn("away", away).withColumn("mad", (F.get("away", mid - 1) + F.get("away", size - mid)) / 2)
    scale = F.greatest(F.when(F.col("mad") > 0, F.col("mad") / MAD_TO_SIGMA).otherwise(F.col("sd")), F.lit(MIN_SCALE))
    rise = F.col("count") - F.col("baseline")
    near = (F.col("n") - 1 >= max(window, 2)) & (F.col("count") >= F.col("high"))
    kept = scored.withColumn("zz", rise / scale).where(((F.col("zz") >= threshold) | near) & (rise >= MIN_RISE))
    return kept.select(*SERIES, "month", F.col("count").alias("observed"), "baseline", F.round("zz", 1).alias("z"))


def surface(flags: DataFrame, calendar: DataFrame, recent: int = 24, limit: int = 8) -> DataFrame:
    """The flags of the calendar's last months, of the series with the highest peaks, newest first."""
    months = calendar.orderBy(F.desc("month")).limit(recent)
    kept = flags.join(F.broadcast(months), "month", "left_semi")
    best = kept.groupBy(*SERIES).agg(F.max(F.abs("z")).alias("peak"), F.max("month").alias("newest")).orderBy(F.desc("peak"), *SERIES).limit(limit)
    return kept.join(F.broadcast(best), SERIES).orderBy(F.desc("newest"), F.desc("peak"), *SERIES, "month").select(*SERIES, "month", "observed", "baseline", "z", "peak", "newest")


def near_record(series: DataFrame, pct: float = NEAR_RECORD, window: int = 12) -> DataFrame:
    """Months at or over a percentile of all earlier ones, once there are enough."""
    each = W.partitionBy(*SERIES).orderBy("month")
    high = F.percentile("count", F.lit(pct)).over(each.rowsBetween(W.unboundedPreceding, -1))
    rows = _dropped_last(series).select(*SERIES, "month", "count", F.row_number().over(each).alias("n"), high.alias("high"))
    return rows.where((F.col("n") > max(window, 2)) & (F.col("count") >= F.col("high"))).select(*SERIES, "month", "count", "high")


def forecast(series: DataFrame, horizon: int = 3, period: int = 12, min_history: int = 24, min_mean: float = 3.0) -> DataFrame:
    """Seasonal trend in log counts, projected from the last, dropped month on.

    A rough line detrends the logs, calendar months' mean residuals, centred, are the season, and a
    second line through the rest is level and slope. The band widens with the square root of the step.
    """
    each = W.partitionBy(*SERIES)
    t = (F.row_number().over(each.orderBy("month")) - 1).cast("double")
    rows = _dropped_last(series).select(*SERIES, "month", F.col("count").cast("double").alias("y"), t.alias("t"), F.substring("month", 6, 2).cast("int").alias("cal"))
    rows = rows.withColumn("n", F.count("*").over(each)).withColumn("mean", F.avg("y").over(each)).where((F.col("n") >= min_history) & (F.col("mean") >= min_mean))
    rows = rows.withColumn("ly", F.log1p("y"))
    slope, level = F.regr_slope("ly", "t"), F.regr_intercept("ly", "t")
    rough = rows.withColumn("d", F.col("ly") - (level.over(each) + slope.over(each) * F.col("t")))
    cycles = rough.groupBy(*SERIES, "cal", "n").agg(F.avg("d").alias("s"))
    # months that never occur have no residual and count as zero in the mean
    season = cycles.withColumn("s", F.when(F.col("n") >= 2 * period, F.col("s")).otherwise(0.0)).withColumn("s", F.col("s") - F.sum("s").over(each) / period).select(*SERIES, "cal", "s")
    fit = rows.join(season, [*SERIES, "cal"]).withColumn("e", F.col("ly") - F.col("s"))
    fit = fit.withColumn("b", F.regr_slope("e", "t").over(each)).withColumn("a", F.regr_intercept("e", "t").over(each))
    fit = fit.withColumn("r", F.col("y") - F.expm1(F.col("a") + F.col("b") * F.col("t") + F.col("s")))
    model = fit.groupBy(*SERIES).agg(F.first("n").alias("n"), F.first("a").alias("a"), F.first("b").alias("b"), F.stddev_samp("r").alias("sd"), F.max("month").alias("last"))
    ahead = model.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("month", add_months(F.col("last"), F.col("step")))
    ahead = ahead.withColumn("cal", F.substring("month", 6, 2).cast("int")).join(season, [*SERIES, "cal"], "left")
    value = F.greatest(F.lit(0.0), F.expm1(F.col("a") + F.col("b") * (F.col("n") - 1 + F.col("step")) + F.coalesce("s", F.lit(0.0))))
    band = F.lit(BAND_Z) * F.col("sd") * F.sqrt("step")
    out = ahead.withColumn("v", value).withColumn("w", band)
    return out.select(*SERIES, "month", F.round("v", 1).alias("predicted"), F.round(F.greatest(F.lit(0.0), F.col("v") - F.col("w")), 1).alias("lower"), F.round(F.col("v") + F.col("w"), 1).alias("upper"))


def backtest(series: DataFrame, horizon: int = 3, tie: float = 0.05) -> DataFrame:
    """Mean absolute error of the forecast of the last complete months against last year's same months."""
    each = W.partitionBy(*SERIES)
    back = F.row_number().over(each.orderBy(F.desc("month")))
    rows = _dropped_last(series).withColumn("back", back).withColumn("naive", F.lag("count", 12).over(each.orderBy("month")))
    held = rows.where(F.col("back") <= horizon)
    # the model drops a last month: leave the first held-out one in its place
    known = rows.where(F.col("back") >= horizon).select(*SERIES, "month", "count")
    met = held.join(forecast(known, horizon), [*SERIES, "month"])
    out = met.groupBy(*SERIES).agg(F.avg(F.abs(F.col("predicted") - F.col("count"))).alias("mae"), F.avg(F.abs(F.col("naive") - F.col("count"))).alias("naive_mae"))
    verdict = F.when(F.col("mae") < F.col("naive_mae") * (1 - tie), "better").when(F.col("mae") > F.col("naive_mae") * (1 + tie), "worse").otherwise("tie")
    return out.withColumn("verdict", verdict)


def holt_winters(series: DataFrame, period: int = 12, horizon: int = 3, steps: int = 10) -> DataFrame:
    """Additive triple exponential smoothing, a series per group; series under two periods yield nothing.

    The three smoothing constants are fitted: of a grid of ``steps`` values each, all tried at once,
    the triple with the least squared one-step error is taken.
    """

    def project(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("month")
        y = frame["count"].to_numpy(float)[:-1]
        if len(y) < 2 * period:
            return pd.DataFrame({"scope": [], "label": [], "step": [], "predicted": []})
        alpha, beta, gamma = (g.ravel() for g in np.meshgrid(*[np.linspace(0.02, 0.98, steps)] * 3))
        level, slope = np.full(len(alpha), y[:period].mean()), np.full(len(alpha), (y[period : 2 * period].mean() - y[:period].mean()) / period)
        season = [np.full(len(alpha), x) for x in y[:period] - y[:period].mean()]
        error = np.zeros(len(alpha))
        for at in range(period, len(y)):
            old = season[at - period]
            error += (level + slope + old - y[at]) ** 2
            before = level
            level = alpha * (y[at] - old) + (1 - alpha) * (level + slope)
            slope = beta * (level - before) + (1 - beta) * slope
            season.append(gamma * (y[at] - level) + (1 - gamma) * old)
        i = int(error.argmin())
        ahead = [max(0.0, level[i] + h * slope[i] + season[len(y) - period + (h - 1) % period][i]) for h in range(1, horizon + 1)]
        return pd.DataFrame({"scope": frame["scope"].iloc[0], "label": frame["label"].iloc[0], "step": range(1, horizon + 1), "predicted": ahead})

    return series.groupBy(*SERIES).applyInPandas(project, "scope string, label string, step long, predicted double")


def stl_flags(series: DataFrame, period: int = 12, threshold: float = 3.0, inner: int = 2, outer: int = 15) -> DataFrame:
    """Months whose STL residual is ``threshold`` robust deviations over the residuals' median.

    STL (Cleveland et al., 1990) with robustness weights: calendar months are smoothed by LOESS, what
    passes a low-pass filter is taken off again, the rest less the season gives the trend. The last
    month is left out; series under two periods yield nothing.
    """

    def loess(y: np.ndarray, w: np.ndarray, span: int, at: np.ndarray) -> np.ndarray:
        """Local lines through ``y`` at the places ``at``, the nearest ``span`` points each, tricube weights."""
        n = len(y)
        x = np.arange(n, dtype=float)
        far = np.abs(x[None, :] - at[:, None])
        width = np.sort(far, 1)[:, min(span, n) - 1] * (1.0 if span <= n else span / n)
        k = np.clip(1 - (far / np.maximum(width, 1e-9)[:, None]) ** 3, 0, None) ** 3 * w[None, :]
        k = np.where(k.sum(1, keepdims=True) > 0, k, far == far.min(1, keepdims=True))
        total = k.sum(1)
        mx, my = (k @ x) / total, (k @ y) / total
        vx = (k * (x[None, :] - mx[:, None]) ** 2).sum(1)
        cov = (k * (x[None, :] - mx[:, None]) * (y[None, :] - my[:, None])).sum(1)
        return my + np.where(vx > 1e-9, cov / np.maximum(vx, 1e-9), 0.0) * (at - mx)

    def average(y: np.ndarray, span: int) -> np.ndarray:
        return np.convolve(y, np.ones(span) / span, "valid")

    def flag(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("month").iloc[:-1]
        y = frame["count"].to_numpy(float)
        n = len(y)
        if n < 2 * period:
            return frame.iloc[:0][["scope", "label", "month"]].assign(residual=0.0)
        places, trend, robust = np.arange(n, dtype=float), np.zeros(n), np.ones(n)
        wide = int(np.ceil(1.5 * period / (1 - 1.5 / 7))) | 1
        for round_ in range(outer + 1):
            for _ in range(inner):
                cycle = np.zeros(n + 2 * period)
                for c in range(period):
                    part = (y - trend)[c::period]
                    cycle[c::period] = loess(part, robust[c::period], 7, np.arange(-1, len(cycle[c::period]) - 1, dtype=float))
                low = average(average(average(cycle, period), period), 3)
                season = cycle[period:-period] - loess(low, np.ones(n), period | 1, places)
                trend = loess(y - season, robust, wide, places)
            rest = y - season - trend
            scale = 6 * np.median(np.abs(rest))
            if round_ < outer:
                robust = np.ones(n) if scale <= 0 else np.clip(1 - (np.abs(rest) / scale) ** 2, 0, None) ** 2
        middle = np.median(rest)
        spread = np.median(np.abs(rest - middle)) or 1.0
        hit = MAD_TO_SIGMA * (rest - middle) / spread >= threshold
        return frame.loc[hit, ["scope", "label", "month"]].assign(residual=rest[hit])

    return series.groupBy(*SERIES).applyInPandas(flag, "scope string, label string, month string, residual double")


def agreement(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """How many keys two frames share, have together, and the ratio."""
    both = a.select(*keys, F.lit(1).alias("bit")).unionByName(b.select(*keys, F.lit(2).alias("bit"))).groupBy(*keys).agg(F.bit_or("bit").alias("bits"))
    n = both.agg(F.count_if(F.col("bits") == 3).alias("shared"), F.count("*").alias("either"))
    return n.withColumn("jaccard", F.when(F.col("either") > 0, F.col("shared") / F.col("either")).otherwise(1.0))
