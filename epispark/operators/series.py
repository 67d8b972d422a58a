"""Windows over series, selections of rows, forecasts and their scores."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from epispark.functions.scalars import micros
from epispark.session import stored

# windows


def readmissions(df: DataFrame, person: str, t0: str, stay: str, days: int = 14) -> DataFrame:
    """gap (whole days since the person's previous stay, null for the first) and readmitted 0/1. Rows without person go first."""
    w = W.partitionBy(person).orderBy(t0, stay)
    gap = F.floor((micros(F.col(t0)) - micros(F.lag(t0).over(w))) / 86_400_000_000).cast("long")
    return df.where(F.col(person).isNotNull()).withColumn("gap", gap).withColumn("readmitted", F.coalesce(F.col("gap") <= days, F.lit(False)).cast("int"))


def forward_filled(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], default: float = 0.0) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit(default)) for c in columns})


def lagged(df: DataFrame, series: str, date: str, value: str, lags: Sequence[int]) -> DataFrame:
    """Lag columns; rows that miss one are dropped."""
    w = W.partitionBy(series).orderBy(date)
    out = df.withColumns({f"lag_{k}": F.lag(value, k).over(w) for k in lags})
    return out.dropna(subset=[f"lag_{k}" for k in lags])


def input_windows(df: DataFrame, series: str, date: str, value: str, width: int) -> DataFrame:
    """The width values before each row; rows with fewer are dropped."""
    w = W.partitionBy(series).orderBy(date).rowsBetween(-width, -1)
    return df.withColumn("inputs", F.collect_list(value).over(w)).where(F.size("inputs") == width)


def rolling_origins(df: DataFrame, series: str, date: str, value: str, least: int, horizon: int, step: int = 1, start=None, end=None) -> DataFrame:
    """(series, as_of, date, train, test): windows of the last `least` values and the next `horizon`, every step rows.

    Positions count rows, not days. start and end bound the first target and the last target's room. A series is
    gathered once, as one row, and only the windows asked for are cut out of it.
    """
    rows = df.groupBy(series).agg(F.sort_array(F.collect_list(F.struct(F.col(date).alias("d"), F.col(value).alias("v")))).alias("_s"))
    before = lambda at, same: F.size(F.filter("_s", lambda x: x["d"] <= at if same else x["d"] < at))
    first = F.lit(least) if start is None else F.greatest(F.lit(least), before(F.lit(start), False))
    n = F.size("_s") if end is None else F.least(F.size("_s"), before(F.lit(end), True))
    places = F.when(n - horizon >= first, F.sequence(first, n - horizon, F.lit(step))).otherwise(F.array().cast("array<int>"))
    values = lambda lo, n: F.slice("_s", lo, n)["v"]
    window = lambda i: F.struct(F.get("_s", i - 1)["d"].alias("as_of"), F.get("_s", i)["d"].alias(date), values(i - least + 1, F.lit(least)).alias("train"), values(i + 1, F.lit(horizon)).alias("test"))
    # windows are cut before they become rows, so no row holds the series again
    return rows.select(series, F.explode(F.transform(places, window)).alias("_w")).select(series, "_w.*")


def step_windows(df: DataFrame, series: str, date: str, value: str, history: int = 156, recent: int = 8, horizon: int = 4, step: int = 1) -> DataFrame:
    """(series, as_of, history, recent, future): for every step-th row the last values up to it, the latest few of these,
    and those that follow, fewer at the end; rows that nothing follows are left out."""
    rows = df.groupBy(series).agg(F.sort_array(F.collect_list(F.struct(F.col(date).alias("d"), F.col(value).alias("v")))).alias("_s"))
    places = F.when(F.size("_s") > 1, F.sequence(F.lit(0), F.size("_s") - 2, F.lit(step))).otherwise(F.array().cast("array<int>"))
    last = lambda i, n: F.slice("_s", F.greatest(i + 2 - n, F.lit(1)), F.least(i + 1, F.lit(n)))["v"]
    window = lambda i: F.struct(F.get("_s", i)["d"].alias("as_of"), last(i, history).alias("history"), last(i, recent).alias("recent"), F.slice("_s", i + 2, F.lit(horizon))["v"].alias("future"))
    return rows.select(series, F.explode(F.transform(places, window)).alias("_w")).select(series, "_w.*")


def trend(df: DataFrame, series: str, date: str, value: str) -> DataFrame:
    """growth (against three rows before, else the first of the window), slope, pct_change and run of strict increases
    (up to eight values back)."""
    w = W.partitionBy(series).orderBy(date)
    v, prev = F.col(value), F.lag(value).over(w)
    base = F.coalesce(F.lag(value, 3).over(w), F.first(value).over(w.rowsBetween(-3, 0)))
    out = df.withColumns({"growth": (v - base) / F.greatest(F.lit(1.0), base), "slope": v - prev, "pct_change": (v - prev) / F.greatest(F.lit(1.0), prev), "_break": F.when(v > prev, 0).otherwise(1)})
    out = out.withColumn("_isle", F.sum("_break").over(w))
    return out.withColumn("run", F.least(F.lit(7), F.row_number().over(W.partitionBy(series, "_isle").orderBy(date)) - 1)).drop("_break", "_isle")


def volatility(df: DataFrame, series: str, date: str, value: str) -> DataFrame:
    """Median absolute relative change over the last eight values, within 0.05 and 0.5; 0.15 for a first row."""
    w = W.partitionBy(series).orderBy(date)
    change = F.abs(F.col(value) - F.lag(value).over(w)) / F.greatest(F.lit(1.0), F.lag(value).over(w))
    out = df.withColumn("_c", change)
    m = F.percentile("_c", F.lit(0.5)).over(w.rowsBetween(-6, 0))
    return out.withColumn("volatility", F.coalesce(F.greatest(F.lit(0.05), F.least(F.lit(0.5), m)), F.lit(0.15))).drop("_c")


def running_scores(df: DataFrame, run: str, order: str, actual: str, forecast: str) -> DataFrame:
    w = W.partitionBy(run).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    e = F.col(actual) - F.col(forecast)
    return df.withColumn("mae_so_far", F.avg(F.abs(e)).over(w)).withColumn("rmse_so_far", F.sqrt(F.avg(e * e).over(w)))


def peak_threshold(df: DataFrame, series: str, date: str, value: str, q: float = 0.9) -> DataFrame:
    w = W.partitionBy(series).orderBy(date).rowsBetween(-1, 0)
    return df.withColumn("_m", F.max(value).over(w)).groupBy(series).agg(F.percentile("_m", F.lit(q)).alias("threshold"))


def sudden_drops(df: DataFrame, series: str, date: str, value: str, limit: float = -0.3) -> DataFrame:
    """drop: mean of the last two relative changes at or below limit; changes from zero do not count."""
    w = W.partitionBy(series).orderBy(date)
    prev = F.lag(value).over(w)
    out = df.withColumn("_c", F.when(prev > 0, (F.col(value) - prev) / prev))
    return out.withColumn("drop", F.coalesce(F.avg("_c").over(w.rowsBetween(-1, 0)) <= limit, F.lit(False)).cast("int")).drop("_c")


def tuned_step(df: DataFrame, series: str, date: str, error: str, window: int = 4, rate: float = 0.1) -> DataFrame:
    """factor: 1 + rate where the error grew from the first to the last of the window, 1 - rate where it fell."""
    w = W.partitionBy(series).orderBy(date).rowsBetween(1 - window, 0)
    first, last = F.first(error).over(w), F.last(error).over(w)
    return df.withColumn("factor", F.when(last > first, 1 + rate).when(last < first, 1 - rate).otherwise(1.0))


def latest_per_date(df: DataFrame, keys: Sequence[str], as_of: str) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(as_of)))).where("_r = 1").drop("_r")


def finite(c: Column) -> Column:
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def conformal(df: DataFrame, series: str, date: str, residual: str, alpha: float = 0.1, buffer: int = 52) -> DataFrame:
    """radius: the residual of rank ceil((n+1)(1-alpha)) among the absolute values of the last `buffer` finite residuals
    before this row; null before the first. Null, NaN and infinite residuals take no place in the buffer."""
    r = F.col(residual).cast("double")
    rows = df.withColumn("_f", finite(r))
    # the buffer after each finite residual, among finite ones only; later rows carry its radius on
    own = W.partitionBy(series, "_f").orderBy(date).rowsBetween(1 - buffer, 0)
    kept = F.sort_array(F.collect_list(F.when(F.col("_f"), F.abs(r))).over(own))
    k = F.greatest(F.lit(1), F.least(F.size("_b"), F.ceil((F.size("_b") + 1) * (1 - alpha)).cast("int")))
    after = rows.withColumn("_b", kept).withColumn("_after", F.when(F.col("_f"), F.try_element_at("_b", k)))
    before = W.partitionBy(series).orderBy(date).rowsBetween(W.unboundedPreceding, -1)
    return after.withColumn("radius", F.last("_after", ignorenulls=True).over(before)).drop("_f", "_b", "_after")


def widened(low: Column, mid: Column, high: Column, radius: Column) -> Column:
    """Interval widened by a radius; null or non-positive radius changes nothing."""
    lo = F.greatest(F.lit(0.0), F.least(low, mid - radius))
    return F.when(F.coalesce(radius, F.lit(0.0)) > 0, F.struct(lo.alias("low"), F.greatest(high, mid + radius, lo).alias("high"))).otherwise(F.struct(low.alias("low"), high.alias("high")))


# selections


def top_categories(df: DataFrame, category: str, person: str, k: int, drop: Sequence[str] = ()) -> DataFrame:
    """The k categories with most distinct persons, ties by name; a report of bounded size."""
    rows = df.where(~F.col(category).isin(*drop)) if drop else df
    return rows.where(F.col(category).isNotNull()).groupBy(category).agg(F.count_distinct(person).alias("persons")).orderBy(F.desc("persons"), category).limit(k)


def spaced(df: DataFrame, date: str, n: int) -> DataFrame:
    """n dates evenly spaced by position, all when there are no more. Positions are counted within ranges of dates."""
    from epispark.operators.aggregates import running_totals

    dates = df.select(F.col(date)).where(F.col(date).isNotNull()).distinct().withColumn("_one", F.lit(1))
    days = running_totals(dates, [], date, "_one", "_k").select(date, (F.col("_k") - 1).alias("i"))
    total = days.agg(F.count(F.lit(1)).alias("total"))
    picks = total.select("total", F.explode(F.when(F.lit(n <= 0) | (F.col("total") <= n), F.sequence(F.lit(0), F.col("total") - 1)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(max(n, 2) - 1)), lambda k: F.floor(k * (F.col("total") - 1) / max(n - 1, 1)).cast("long")))).alias("i"))
    return days.join(picks.select("i").distinct(), "i").select(date)


def tail_split(df: DataFrame, series: str, date: str, ratio: float) -> DataFrame:
    """split: validation for the last max(1, int(n * ratio)) rows of each series."""
    back = F.row_number().over(W.partitionBy(series).orderBy(F.desc(date)))
    n = F.count(F.lit(1)).over(W.partitionBy(series))
    return df.withColumn("split", F.when(back <= F.greatest(F.lit(1), F.floor(n * ratio)), "validation").otherwise("train"))


def stratified_split(ids: DataFrame, key: str, label: str, test: float = 0.15, validation: float = 0.15, buckets: int = 4096) -> DataFrame:
    """train, validation or test per id, label by label, in a fixed hashed order of the ids.

    Ranks come from counts per (label, hash bucket), so no label is sorted in one task: bucket totals are summed over
    at most `buckets` rows a label, and ids are ranked within their own bucket.
    """
    h = F.pmod(F.col(key) * 2654435761, F.lit(4294967296))
    rows = ids.select(key, label).distinct().withColumn("_h", h).withColumn("_b", F.floor(F.col("_h") / (4294967296 // buckets)))
    per = rows.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy(label).orderBy("_b")
    per = per.withColumn("_before", F.sum("_n").over(w) - F.col("_n")).withColumn("_total", F.sum("_n").over(W.partitionBy(label)))
    rank = F.row_number().over(W.partitionBy(label, "_b").orderBy("_h", key)) + F.col("_before")
    n_test = F.ceil(F.col("_total") * test)
    n_val = F.ceil((F.col("_total") - n_test) * (validation / (1 - test)))
    out = rows.join(per, [label, "_b"]).withColumn("_r", rank)
    return out.select(key, label, F.when(F.col("_r") <= n_test, "test").when(F.col("_r") <= n_test + n_val, "validation").otherwise("train").alias("split"))


# forecasts


def persistence(df: DataFrame, value: str, horizon: int, levels: Sequence[float], width: float = 0.15) -> DataFrame:
    """Rows (step, level, forecast) of the last value with bands p -/+ width * p * |q - 0.5| / 0.45."""
    steps = df.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("level", F.explode(F.array(*[F.lit(float(q)) for q in levels])))
    p = F.col(value)
    return steps.withColumn("forecast", F.greatest(F.lit(0.0), p + F.signum(F.col("level") - 0.5) * width * p * F.abs(F.col("level") - 0.5) / 0.45))


def gaussian_bands(p: Column, sigma: Column, z: dict[str, float]) -> Column:
    return F.struct(*[F.greatest(F.lit(0.0), p + F.lit(v) * sigma).alias(k) for k, v in z.items()])


def damped_growth(value: Column, growth: Column, vol: Column, horizon: int, impact: Column | None = None, lag: int = 0, decay: float = 0.85) -> Column:
    """array of (step, q05, q50, q95): growth damped by decay^i, half the impact after the lag, jumps limited by volatility."""
    impact = F.lit(0.0) if impact is None else impact
    item = "struct<step:int,q05:double,q50:double,q95:double>"
    spread = F.greatest(vol * 0.5, F.lit(0.05))

    def step(acc: Column, i: Column) -> Column:
        g = F.when(i < lag, growth).otherwise(growth + 0.5 * impact)
        cur = acc["cur"]
        raw = F.greatest(F.lit(0.0), cur * (1 + g * F.pow(F.lit(decay), i)))
        jump = F.greatest(2 * vol * F.greatest(F.lit(1.0), cur), F.lit(0.1))
        nxt = F.when(F.abs(raw - cur) > jump, cur + F.signum(raw - cur) * jump).otherwise(raw)
        band = spread * F.greatest(F.lit(1.0), F.sqrt(nxt))
        one = F.struct((i + 1).cast("int").alias("step"), F.greatest(F.lit(0.0), nxt - band).alias("q05"), nxt.alias("q50"), (nxt + band).alias("q95"))
        return F.struct(nxt.cast("double").alias("cur"), F.concat(acc["out"], F.array(one)).alias("out"))

    zero = F.struct(value.cast("double").alias("cur"), F.array().cast(f"array<{item}>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(horizon - 1)), zero, step, lambda acc: acc["out"])


def event_score(pct: Column, run: Column, school: Column, temperature: Column) -> Column:
    """struct(impact, confidence, note) from growth, school status, temperature and run of increases."""
    s = F.lower(F.coalesce(school, F.lit("")))
    base = F.greatest(F.lit(-0.5), F.least(F.lit(0.5), 0.6 * pct))
    base = base + F.when(s.rlike("close|vacation"), -0.2).when(s.rlike("open|session"), 0.1).otherwise(0.0)
    base = base + F.when(temperature >= 25, 0.15).when(temperature <= 15, -0.15).otherwise(0.0)
    base = base + F.when((run >= 3) & (base > 0), 0.1).otherwise(0.0)
    impact = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), base))
    return F.struct(impact.alias("impact"), (0.5 + F.least(F.lit(0.3), 0.4 * F.abs(impact))).alias("confidence"), F.when(impact > 0.4, "rising").when(impact < -0.4, "falling").otherwise("").alias("note"))


def uncertainty(vol: Column, horizon: int) -> Column:
    base = F.greatest(F.lit(0.1), F.least(F.lit(0.9), 3 * vol))
    return F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), lambda i: F.least(F.lit(0.95), base + 0.02 * i))


def count_dispersion(u: Column, vol: Column) -> Column:
    return F.greatest(F.lit(0.25), F.least(F.lit(3.0), (0.5 + 2.5 * u) * (0.5 + 2 * vol)))


def means_or_last(means: Column, last: Column) -> Column:
    """Array of forecast means, non-negative; where all are 0 (or none is there), the last value in their place."""
    m = F.transform(means, lambda x: F.greatest(F.lit(0.0), F.coalesce(x.cast("double"), F.lit(0.0))))
    return F.when(F.exists(m, lambda x: x > 0), m).otherwise(F.transform(m, lambda x: F.greatest(F.lit(0.0), F.coalesce(last.cast("double"), F.lit(0.0)))))


def compartments(last: Column, beta: Column, sigma: Column, gamma: Column, steps: int, population: float = 1e6, exposed: float = 10.0, infected: float = 10.0) -> Column:
    """Infected after each step, scaled so that the first equals the last observed value."""
    def step(acc: Column, _: Column) -> Column:
        new, onset, cured = beta * acc["s"] * acc["i"] / population, sigma * acc["e"], gamma * acc["i"]
        floor = lambda c: F.greatest(F.lit(0.0), c)
        i = floor(acc["i"] + onset - cured)
        return F.struct(floor(acc["s"] - new).alias("s"), floor(acc["e"] + new - onset).alias("e"), i.alias("i"), F.concat(acc["out"], F.array(i)).alias("out"))

    zero = F.struct(F.lit(population - exposed - infected).alias("s"), F.lit(exposed).alias("e"), F.lit(infected).alias("i"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), zero, step, lambda acc: F.transform(acc["out"], lambda x: x * last / (acc["out"][0] + 1e-6)))


def grid_searched(windows: DataFrame, grid: DataFrame, series: str, actual: str) -> DataFrame:
    """Best (beta, sigma, gamma) per series by sMAPE of the compartment trajectory against an array of actuals.

    The grid is a parameter table of fixed size and is broadcast."""
    n = windows.select(F.max(F.size(actual))).first()[0] or 1
    tried = windows.crossJoin(F.broadcast(grid)).withColumn("_p", compartments(F.element_at(actual, 1), F.col("beta"), F.col("sigma"), F.col("gamma"), n))
    part = F.transform(F.arrays_zip(F.col(actual).alias("a"), F.slice("_p", 1, F.size(actual)).alias("p")), lambda x: F.abs(x["a"] - x["p"]) / F.greatest(F.lit(1e-9), (F.abs(x["a"]) + F.abs(x["p"])) / 2))
    loss = F.aggregate(part, F.lit(0.0), lambda s, x: s + x) / F.size(actual)
    return tried.withColumn("loss", loss).groupBy(series).agg(F.min(F.struct("loss", "beta", "sigma", "gamma")).alias("b")).select(series, "b.*")


def sampled_paths(windows: DataFrame, series: str, paths: int = 100, seed: int = 1, salt: Column | None = None) -> DataFrame:
    """(series, as_of, path, step, value, actual): sample paths of each rolling-origin window (series, as_of, train, test).

    A path starts at the last training value and adds, step by step, one of the window's own one-step differences, drawn
    with replacement; values below 0 count as 0, the path goes on from the sum. The draw of each path and step comes from
    a fixed function of the seed, the origin's day and salt (a number per series; its crc32 if none is given), so a run
    gives the same paths at any partitioning. Windows with one training value or a null among them give flat paths of the
    last value, null where that is null.
    """
    salt = F.crc32(F.col(series).cast("string")) if salt is None else salt
    train = F.col("train")
    diffs = F.zip_with(F.slice(train, 2, F.greatest(F.size(train) - 1, F.lit(0))), F.slice(train, 1, F.greatest(F.size(train) - 1, F.lit(0))), lambda b, a: (b - a).cast("double"))
    rows = windows.select(series, "as_of", F.element_at(train, -1).cast("double").alias("_last"), diffs.alias("_diffs"), "test", salt.cast("long").alias("_salt"))
    rows = rows.withColumn("_n", F.when(F.forall("_diffs", lambda x: x.isNotNull()), F.size("_diffs")).otherwise(0))
    rows = rows.withColumn("path", F.explode(F.sequence(F.lit(0), F.lit(paths - 1))))

    def drawn(step: Column) -> Column:
        mixed = F.col("_salt") * 7919 + F.unix_date(F.to_date("as_of")) * 104729 + F.col("path") * 1299709 + step * 15485863 + seed
        number = F.pmod(F.pmod(mixed, F.lit(4294967296)) * 2654435761, F.lit(4294967296))
        return F.when(F.col("_n") > 0, F.try_element_at("_diffs", (F.floor(number / 65536) % F.greatest(F.col("_n"), F.lit(1)) + 1).cast("int"))).otherwise(0.0)

    start = F.struct(F.col("_last").alias("at"), F.array().cast("array<double>").alias("out"))
    walk = F.aggregate(F.sequence(F.lit(1), F.size("test")), start, lambda acc, k: F.struct((acc["at"] + drawn(k)).alias("at"), F.concat(acc["out"], F.array(acc["at"] + drawn(k))).alias("out")), lambda acc: acc["out"])
    each = rows.where(F.size("test") > 0).select(series, "as_of", "path", F.posexplode(F.arrays_zip(walk.alias("value"), F.col("test").alias("actual"))).alias("k", "x"))
    value = F.when(F.col("x.value").isNotNull(), F.greatest(F.lit(0.0), "x.value"))
    return each.select(series, "as_of", "path", (F.col("k") + 1).alias("step"), value.alias("value"), F.col("x.actual").cast("double").alias("actual"))


def path_quantiles(paths: DataFrame, keys: Sequence[str], value: str, levels: Sequence[float] = (0.05, 0.5, 0.8, 0.95)) -> DataFrame:
    q = F.percentile(value, F.array(*[F.lit(x) for x in levels]))
    out = paths.groupBy(*keys).agg(q.alias("_q"))
    return out.select(*keys, *[F.col("_q")[i].alias(f"q{round(x * 100):02d}") for i, x in enumerate(levels)])


def future_dates(df: DataFrame, series: str, date: str, horizon: int) -> DataFrame:
    """The next dates of each series, with the smallest step between its dates (7 days for a single one)."""
    w = W.partitionBy(series).orderBy(date)
    step = df.withColumn("_s", F.datediff(date, F.lag(date).over(w))).groupBy(series).agg(F.max(date).alias("last"), F.coalesce(F.min(F.when(F.col("_s") > 0, F.col("_s"))), F.lit(7)).alias("step"))
    return step.select(series, F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("k"), "last", "step").select(series, "k", F.date_add("last", F.col("step") * F.col("k")).alias("date"))


def least_squares(lags: Sequence[int], horizon: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A model for backtest(): least squares on lags, forecast step by step on its own output."""
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        y = np.asarray(pdf["train"].iloc[0], float)
        m = max(lags)
        out = np.full(horizon, y[-1] if len(y) else 0.0)
        if len(y) > m + len(lags):
            x = np.stack([y[m - k : len(y) - k] for k in lags] + [np.ones(len(y) - m)], 1)
            w = np.linalg.lstsq(x, y[m:], rcond=None)[0]
            past = list(y)
            for h in range(horizon):
                past.append(max(0.0, float(np.dot(w[:-1], [past[-k] for k in lags]) + w[-1])))
                out[h] = past[-1]
        return pd.DataFrame({"step": np.arange(1, horizon + 1), "prediction": out})

    return fit


def mean_bands(horizon: int, z: float = 1.6448536269514722) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A model for backtest(): the mean of the training values with normal bands."""
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        y = np.asarray(pdf["train"].iloc[0], float)
        m, sd = (float(y.mean()), float(y.std())) if len(y) else (0.0, 0.0)
        return pd.DataFrame({"step": np.arange(1, horizon + 1), "prediction": m, "q05": max(0.0, m - z * sd), "q50": m, "q95": m + z * sd})

    return fit


#: models by name: each gives step and prediction, and further columns (quantiles, samples) that backtest() is told of
MODELS: dict[str, Callable[..., Callable[[pd.DataFrame], pd.DataFrame]]] = {
    "least_squares": least_squares,
    "mean_bands": mean_bands,
    "persistence": lambda horizon: lambda pdf: pd.DataFrame({"step": np.arange(1, horizon + 1), "prediction": float(pdf["train"].iloc[0][-1])}),
}


def backtest(windows: DataFrame, series: str, model: Callable[[pd.DataFrame], pd.DataFrame], more: str = "") -> DataFrame:
    """(series, as_of, step, prediction, actual, more): one bounded group (a window) per series and origin goes to the
    model. more: names and types of further columns of the model, such as "q05 double, samples array<double>"."""
    kind = dict(windows.dtypes)
    schema = f"`{series}` {kind[series]}, as_of {kind['as_of']}, step int, prediction double, actual double" + (f", {more}" if more else "")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = model(pdf)
        out.insert(2, "actual", list(pdf["test"].iloc[0]))
        out.insert(0, "as_of", pdf["as_of"].iloc[0])
        out.insert(0, series, pdf[series].iloc[0])
        return out

    return windows.groupBy(series, "as_of").applyInPandas(run, schema)


def backtest_last(windows: DataFrame, series: str) -> DataFrame:
    """backtest() of the last value without any Python: (series, as_of, step, prediction, actual)."""
    return windows.select(series, "as_of", F.element_at("train", -1).alias("prediction"), F.posexplode("test").alias("k", "actual")).select(series, "as_of", (F.col("k") + 1).alias("step"), F.col("prediction").cast("double"), F.col("actual").cast("double"))


def origin_errors(df: DataFrame, run: str, as_of: str, actual: str, forecast: str) -> DataFrame:
    """Mean absolute error of each run by forecast origin."""
    return df.groupBy(run, as_of).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col(actual) - F.col(forecast))).alias("mae"))


def aligned_pairs(actuals: DataFrame, predictions: DataFrame, keys: Sequence[str], actual: str, forecast: str) -> DataFrame:
    """Actual and forecast of the same keys; pairs that miss either are dropped."""
    return actuals.select(*keys, actual).join(predictions.select(*keys, forecast), list(keys)).dropna(subset=[actual, forecast])


# scores

METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "mae": lambda a, p: F.avg(F.abs(a - p)),
    "rmse": lambda a, p: F.sqrt(F.avg((a - p) * (a - p))),
    "mape": lambda a, p: F.avg(F.abs(a - p) / F.greatest(F.lit(1e-6), F.abs(a))),
    "smape": lambda a, p: F.avg(F.abs(a - p) / F.greatest(F.lit(1e-9), (F.abs(a) + F.abs(p)) / 2)),
    "medae": lambda a, p: F.percentile(F.abs(a - p), F.lit(0.5)),
    "bias": lambda a, p: F.avg(p - a),
    "residual_std": lambda a, p: F.stddev_samp(a - p),
}
#: further metrics by name, for scores(names=...)
MORE_METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "mape_percent": lambda a, p: 100 * F.avg(F.abs(a - p) / F.abs(F.when(a == 0, 1.0).otherwise(a))),
    "residual_mean": lambda a, p: F.avg(a - p),
}


def scores(df: DataFrame, keys: Sequence[str], actual: str, forecast: str, names: Sequence[str] = tuple(METRICS)) -> DataFrame:
    """All metrics of all runs in one grouped pass over pairs without nulls."""
    return df.dropna(subset=[actual, forecast]).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[(METRICS | MORE_METRICS)[m](F.col(actual).cast("double"), F.col(forecast).cast("double")).alias(m) for m in names])


def run_summary(df: DataFrame, run: str, as_of: str, date: str, actual: str, forecast: str, names: Sequence[str] = ("mae", "rmse", "smape")) -> DataFrame:
    """One row per run, in the order of their names: first and last target, origins, horizon and metrics."""
    rows = df.dropna(subset=[actual, forecast])
    per = rows.groupBy(run, as_of).agg(F.count(F.lit(1)).alias("_h"), F.min(date).alias("_lo"), F.max(date).alias("_hi"))
    span = per.groupBy(run).agg(F.min("_lo").alias("start"), F.max("_hi").alias("end"), F.count(F.lit(1)).alias("n_steps"), F.max("_h").alias("horizon"))
    return span.join(scores(rows, [run], actual, forecast, names), run).orderBy(run)


def coverage(df: DataFrame, keys: Sequence[str], actual: str, level: float, prefix: str = "q_") -> DataFrame:
    """Share of actuals inside the level's interval, bounds included; null when the columns are missing."""
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    near = lambda q: next((c for c in df.columns if c.startswith(prefix) and abs(float(c[len(prefix) :]) - q) < 1e-4), None)
    a, b = near(lo), near(hi)
    inside = F.col(actual).between(F.col(f"`{a}`"), F.col(f"`{b}`")).cast("double") if a and b else F.lit(None).cast("double")
    return df.groupBy(*keys).agg(F.avg(inside).alias("coverage"))


def crps_quantiles(df: DataFrame, keys: Sequence[str], actual: str, quantiles: Mapping[float, str], forecast: str | None = None) -> DataFrame:
    """Twice the mean over levels of the mean pinball loss, each level over its own rows without null; no unpivot.
    Without any level, the mean absolute error of the forecast."""
    if not quantiles:
        if forecast is None:
            raise ValueError("without quantiles a forecast column is needed")
        return df.groupBy(*keys).agg(F.avg(F.abs(F.col(actual) - F.col(f"`{forecast}`"))).alias("crps"))
    loss = lambda q, c: F.avg(F.greatest(q * (F.col(actual) - F.col(f"`{c}`")), (q - 1) * (F.col(actual) - F.col(f"`{c}`"))))
    total = sum((loss(q, c) for q, c in quantiles.items()), F.lit(0.0))
    return df.groupBy(*keys).agg((2 * total / len(quantiles)).alias("crps"))


def crps_samples(actual: Column, samples: Column) -> Column:
    """mean |x - y| - half the mean |x - x'|, the latter from sorted samples."""
    n = F.size(samples)
    s = F.sort_array(samples)
    near = F.aggregate(samples, F.lit(0.0), lambda acc, x: acc + F.abs(x - actual)) / n
    spread = F.aggregate(F.transform(s, lambda x, i: x * (2 * i + 1 - n)), F.lit(0.0), lambda acc, x: acc + x) / (n * n)
    return near - spread


def crps_rows(df: DataFrame, key: str, actual: Column, sample: str) -> DataFrame:
    """(key, crps): crps_samples over samples that are rows; no key's samples meet in one row, and equal ones are merged."""
    from epispark.operators.aggregates import running_totals

    m = df.groupBy(key, F.col(sample).alias("_x")).agg(F.count(F.lit(1)).alias("_c")).where("_x is not null")
    c, x = F.col("_c"), F.col("_x")
    ranks = c * F.col("_upto") - c * (c - 1) / 2
    g = running_totals(m, [key], "_x", "_c", "_upto").groupBy(key).agg(F.sum("_c").alias("n"), F.sum(c * F.abs(x - actual)).alias("near"), F.sum(x * (2 * ranks - c)).alias("up"), F.sum(x * c).alias("all"))
    return g.select(key, (F.col("near") / F.col("n") - (F.col("up") - F.col("n") * F.col("all")) / (F.col("n") * F.col("n"))).alias("crps"))


def crps_gaussian(actual: Column, mean: Column, sigma: Column, cdf) -> Column:
    """Closed form of one forecast: sigma counts as 1e-6 at least, the result as 0."""
    g = F.greatest(F.lit(1e-6), sigma)
    z = (actual - mean) / g
    score = g * (z * (2 * cdf(z) - 1) + 2 * F.exp(-z * z / 2) / F.lit(float(np.sqrt(2 * np.pi))) - F.lit(float(1 / np.sqrt(np.pi))))
    return F.when(z.isNotNull(), F.greatest(F.lit(0.0), score))


def count_sigma(mean: Column, size: Column) -> Column:
    """Standard deviation of a negative binomial count of this mean and size: sqrt(m (1 + m / size))."""
    return F.sqrt(mean * (1 + mean / size))


def peak_errors(df: DataFrame, series: str, date: str, actual: str, forecast: str) -> DataFrame:
    """Mean absolute error over the rows at or above the series' peak threshold."""
    t = peak_threshold(df, series, date, actual)
    return df.join(t, series).where(F.col(actual) >= F.col("threshold")).groupBy(series).agg(F.count(F.lit(1)).alias("n_peaks"), F.avg(F.abs(F.col(actual) - F.col(forecast))).alias("peak_mae"))


def peak_recall(df: DataFrame, series: str, date: str, actual: str, forecast: str, share: float = 0.1, window: int = 2) -> DataFrame:
    """Share of the top rows of the actuals that have a top row of the forecasts within `window` positions."""
    n = F.ceil(F.count(F.lit(1)).over(W.partitionBy(series)) * share)
    rank = lambda c: F.row_number().over(W.partitionBy(series).orderBy(F.desc(c), date))
    rows = df.select(series, F.row_number().over(W.partitionBy(series).orderBy(date)).alias("i"), (rank(actual) <= n).alias("top"), (rank(forecast) <= n).alias("said"))
    spot = rows.where("said").select(series, F.explode(F.sequence(F.col("i") - window, F.col("i") + window)).alias("i")).distinct().withColumn("hit", F.lit(1))
    return rows.where("top").join(spot, [series, "i"], "left").groupBy(series).agg(F.count(F.lit(1)).alias("n_peaks"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def peak_placement(df: DataFrame, series: str, date: str, actual: str, forecast: str, share: float = 0.1) -> DataFrame:
    """(series, n_peaks, time_rmse, height_rmse): the top rows of actuals and of forecasts (at least one of each, ties to
    the earlier) are put in order of time and paired by position; root mean square of the distance in rows and of the
    difference of the actual at the one and the forecast at the other."""
    n = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)).over(W.partitionBy(series)) * share))
    rank = lambda c: F.row_number().over(W.partitionBy(series).orderBy(F.desc(c), date))
    rows = df.select(series, actual, forecast, F.row_number().over(W.partitionBy(series).orderBy(date)).alias("i"), (rank(actual) <= n).alias("top"), (rank(forecast) <= n).alias("said"))

    def placed(flag: str, at: str, value: str, height: str) -> DataFrame:
        order = F.row_number().over(W.partitionBy(series).orderBy("i"))
        return rows.where(flag).select(series, F.col("i").alias(at), F.col(value).alias(height), order.alias("k"))

    pairs = placed("top", "i", actual, "a").join(placed("said", "j", forecast, "p"), [series, "k"])
    rms = lambda x: F.sqrt(F.avg(x * x))
    return pairs.groupBy(series).agg(F.count(F.lit(1)).alias("n_peaks"), rms(F.col("i") - F.col("j")).alias("time_rmse"), rms(F.col("a") - F.col("p")).alias("height_rmse"))


def coverage_table(df: DataFrame, actual: str, pairs: Sequence[tuple[str, str, float]]) -> DataFrame:
    """expected and observed coverage of each symmetric pair of quantile columns."""
    names = [f"{e:.4f}" for _, _, e in pairs]
    row = df.agg(*[F.avg(F.col(actual).between(F.col(a), F.col(b)).cast("double")).alias(n) for (a, b, _), n in zip(pairs, names, strict=True)])
    return row.unpivot([], [f"`{n}`" for n in names], "expected", "observed").withColumn("expected", F.col("expected").cast("double"))


def disagreement(paths: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, mad, median, percent) per key: median absolute deviation of its paths, in percent of |median| + 1."""
    m = paths.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("_m"))
    d = paths.join(m, list(keys)).groupBy(*keys).agg(F.percentile(F.abs(F.col(value) - F.col("_m")), F.lit(0.5)).alias("mad"), F.first("_m").alias("median"))
    return d.withColumn("percent", 100 * F.col("mad") / F.greatest(F.lit(1.0), F.abs("median") + 1))


def disagreement_summary(paths: DataFrame, by: Sequence[str], step: str, value: str) -> DataFrame:
    """(by, n_steps, mean_percent, max_percent): disagreement over the steps of each series."""
    per = disagreement(paths, [*by, step], value)
    return per.groupBy(*by).agg(F.count(F.lit(1)).alias("n_steps"), F.avg("percent").alias("mean_percent"), F.max("percent").alias("max_percent"))


def exceedance(paths: DataFrame, keys: Sequence[str], value: str, thresholds: Sequence[float]) -> DataFrame:
    return paths.groupBy(*keys).agg(*[F.avg((F.col(value) > t).cast("double")).alias(f"p_over_{t:g}") for t in thresholds])


def paired_tests(df: DataFrame, run: str, keys: Sequence[str], error: str, baseline: str, alpha: float = 0.05) -> DataFrame:
    """Per run against the baseline run on common keys: n, mean_diff, t, t_p, w_plus, w_minus, w, w_p and whether either
    p is below alpha (t_significant, w_significant).

    t: paired t with two-sided p of Student's distribution; null for one pair or differences that do not vary. w:
    Wilcoxon's signed ranks (average ranks, zeros out) with the two-sided p of its normal approximation, the variance
    corrected for ties, without continuity correction; null where all differences are 0. A null p is not significant.
    Pairs with a null error take no part. The differences are stored once; ranks run within ranges.
    """
    from epispark.functions.helpers import normal_tails, t_tails
    from epispark.operators.aggregates import running_totals

    base = df.where(F.col(run) == baseline).select(*keys, F.col(error).alias("_e"))
    d = df.where(F.col(run) != baseline).join(base, list(keys)).select(run, (F.col(error) - F.col("_e")).alias("_d")).where("_d is not null")
    d = stored(d)
    t = d.groupBy(run).agg(F.count(F.lit(1)).alias("n"), F.avg("_d").alias("mean_diff"), F.try_divide(F.avg("_d"), F.stddev_samp("_d") / F.sqrt(F.count(F.lit(1)))).alias("t"))
    m = d.where("_d <> 0").groupBy(run, F.abs("_d").alias("_a")).agg(F.sum(F.when(F.col("_d") > 0, 1).otherwise(0)).alias("_up"), F.count(F.lit(1)).alias("_c"))
    rank = F.col("_upto") - (F.col("_c") - 1) / 2
    c = F.col("_c").cast("double")
    w = running_totals(m, [run], "_a", "_c", "_upto").groupBy(run).agg(F.sum(rank * F.col("_up")).alias("w_plus"), F.sum(rank * (F.col("_c") - F.col("_up"))).alias("w_minus"), F.sum(c).alias("_n"), F.sum(c * c * c - c).alias("_ties"))
    n = F.col("_n")
    z = F.try_divide(F.least("w_plus", "w_minus") - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48))
    out = t.join(w, run, "left").withColumns({"w": F.least("w_plus", "w_minus"), "t_p": t_tails(F.col("t"), F.col("n") - 1), "w_p": normal_tails(z)})
    flag = lambda p: F.coalesce(F.col(p) < alpha, F.lit(False))
    return out.select(run, "n", "mean_diff", "t", "t_p", "w_plus", "w_minus", "w", "w_p", flag("t_p").alias("t_significant"), flag("w_p").alias("w_significant"))


def scale_check(train: Column, forecast: Column, limit: float = 10.0) -> Column:
    """Ratio of the largest forecast to the largest training value, either way, and whether it is off."""
    a, b = F.greatest(F.array_max(train), F.lit(1e-9)), F.greatest(F.array_max(forecast), F.lit(1e-9))
    r = F.greatest(a / b, b / a)
    return F.struct(r.alias("ratio"), (r > limit).alias("off"))
