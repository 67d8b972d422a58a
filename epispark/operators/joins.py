"""Joins of events to stays, signals, months and calendars."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from epispark.functions.scalars import micros


def within_hours(events: DataFrame, starts: DataFrame, key: str, ts: str, t0: str, hours: int, lower: int | None = 0) -> DataFrame:
    """Events of a stay up to `hours` after its start; lower None keeps earlier ones too. One row per stay in starts."""
    gap = micros(F.col(ts)) - micros(F.col(t0))
    out = events.join(starts.select(key, t0), key).where(gap <= hours * 3_600_000_000 if lower is None else gap < hours * 3_600_000_000)
    return out if lower is None else out.where(gap >= lower * 3_600_000_000)


def assembled(stays: DataFrame, parts: Sequence[DataFrame], key: str, defaults: Mapping[str, Column]) -> DataFrame:
    """Left joins of feature tables onto the stays, nulls replaced by the given defaults."""
    out = stays
    for p in parts:
        out = out.join(p, key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items()})


def with_label(df: DataFrame, labels: DataFrame, key: str, label: str, default: int = 0) -> DataFrame:
    return df.join(labels.select(key, label), key, "left").withColumn(label, F.coalesce(label, F.lit(default)))


def members(df: DataFrame, ids: DataFrame, key: str, out: bool = False) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti" if out else "left_semi")


def lookback(targets: DataFrame, day: str, signals: DataFrame, signal_day: str, values: Sequence[str], days: int = 7) -> DataFrame:
    """For each target day d, mean, min and max of each value over [d - days, d) and the days in order.

    The window becomes day keys, so the join is an equi-join and its size is days rows a target.
    """
    keys = targets.select(day).distinct().select(day, F.explode(F.sequence(F.date_sub(day, days), F.date_sub(day, 1))).alias("_d"))
    found = keys.join(signals.withColumnRenamed(signal_day, "_d"), "_d")
    agg = [f(v).alias(f"{v}_{n}") for v in values for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    got = found.groupBy(day).agg(F.count(F.lit(1)).alias("n_days"), *agg, F.array_join(F.sort_array(F.collect_list(F.col("_d").cast("string"))), ",").alias("days"))
    return targets.join(got, day, "left")


def monthly_signal(df: DataFrame, day: str, months: DataFrame, month: str, n: str) -> DataFrame:
    """Value of the month before the day's month and its relative change to the month before that; exact months only."""
    m = months.select(F.trunc(month, "MM").alias("_m"), F.col(n).alias("_n"))
    this = df.withColumn("_k", F.trunc(F.col(day), "MM"))
    one = m.select(F.add_months("_m", 1).alias("_k"), F.col("_n").alias("previous"))
    two = m.select(F.add_months("_m", 2).alias("_k"), F.col("_n").alias("_before"))
    out = this.join(one, "_k", "left").join(two, "_k", "left")
    return out.withColumn("change", F.when(F.col("_before") != 0, (F.col("previous") - F.col("_before")) / F.col("_before"))).drop("_k", "_before")


def school_status(df: DataFrame, day: str, calendar: DataFrame | None) -> DataFrame:
    """school: status of the last matching school event in list order; holidays in order. calendar: position, type,
    event_name, date_start, date_end. Without a calendar the month decides. The calendar is broadcast: one row per event."""
    d = F.col(day)
    if calendar is None:
        return df.withColumn("school", F.when(F.month(d).isin(7, 8), "summer_break").when(F.month(d).isin(1, 2), "winter_break").otherwise("in_session")).withColumn("holidays", F.lit(""))
    name = F.col("event_name")
    status = F.when(F.col("type") == "School Vacation", F.when(F.contains(name, F.lit("Summer")), "summer_break").when(F.contains(name, F.lit("Winter")), "winter_break").otherwise("vacation")).when(F.col("type") == "School Season", "in_session")
    holiday = F.when(F.contains(F.col("type"), F.lit("Holiday")), F.struct("position", name.alias("name")))
    days = df.select(d.alias("_d")).distinct()
    hit = days.join(F.broadcast(calendar), F.col("_d").between(F.col("date_start"), F.col("date_end")))
    got = hit.withColumn("_s", status).groupBy("_d").agg(F.max_by("_s", F.when(F.col("_s").isNotNull(), F.col("position"))).alias("school"), F.array_join(F.transform(F.sort_array(F.collect_list(holiday)), lambda h: h["name"]), ",").alias("holidays"))
    return df.join(got, F.col(day) == F.col("_d"), "left").drop("_d").withColumn("school", F.coalesce("school", F.lit("in_session"))).withColumn("holidays", F.coalesce("holidays", F.lit("")))


def with_extra_categories(weekly: DataFrame, extra: DataFrame, names: Sequence[str], key: str = "week", other: str = "Other") -> DataFrame:
    """Extra category columns joined on, null as 0, their sum taken off `other` with 0 as floor."""
    out = weekly.join(extra.select(key, *names), key, "left").fillna(0, list(names))
    total = sum((F.col(n) for n in names), F.lit(0))
    return out.withColumn(other, F.greatest(F.col(other) - total, F.lit(0)))


def regular(series: DataFrame, series_id: str, date: str, step_days: int = 7) -> DataFrame:
    """Missing steps of each series as null rows."""
    grid = series.groupBy(series_id).agg(F.min(date).alias("lo"), F.max(date).alias("hi")).select(series_id, F.explode(F.sequence("lo", "hi", F.expr(f"interval {step_days} days"))).alias(date))
    return grid.join(series, [series_id, date], "left")


def rejected_pairs(df: DataFrame, key: str, answer: str, group: str, buckets: int = 4096) -> DataFrame:
    """Each row with the answer of the next row of its group in a hashed order (the last takes the first's).

    Rows follow each other within buckets of the hash; the last of a bucket takes the first answer of the next bucket, of
    which there are at most `buckets` a group, so no group is sorted in one task.
    """
    order = F.pmod(F.col(key) * 2654435761, F.lit(4294967296))
    rows = df.withColumn("_h", order).withColumn("_b", F.floor(F.col("_h") / (4294967296 // buckets)))
    w = W.partitionBy(group, "_b").orderBy("_h", key)
    rows = rows.withColumn("_next", F.lead(F.struct(F.col(answer).alias("a"))).over(w))
    heads = rows.groupBy(group, "_b").agg(F.min_by(F.struct(F.col(answer).alias("a")), F.struct("_h", key)).alias("_head"))
    v = W.partitionBy(group).orderBy("_b")
    heads = heads.withColumn("_after", F.coalesce(F.lead("_head").over(v), F.first("_head").over(v.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))))
    return rows.join(heads.drop("_head"), [group, "_b"]).withColumn("rejected", F.coalesce("_next", "_after")["a"]).drop("_h", "_b", "_next", "_after")
