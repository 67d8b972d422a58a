"""Structured Streaming forms of the weekly counts, signals, episodes and residual buffers. Batch frames work as well."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weekly_counts(events: DataFrame, ts: str, category: str, person: str, delay: str = "7 days") -> DataFrame:
    """Rows and approximate distinct persons per week (Tuesday to Monday, labelled by the Monday) and category."""
    w = F.window(F.col(ts).cast("timestamp"), "7 days", "7 days", "5 days")
    g = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).groupBy(w.alias("w"), F.col(category).alias("category"))
    out = g.agg(F.count(F.lit(1)).alias("visits"), F.approx_count_distinct(person, 0.01).alias("patients"))
    return out.select(F.date_sub(F.to_date("w.end"), 1).alias("week"), "category", "visits", "patients")


def weekly_persons(events: DataFrame, ts: str, category: str, person: str, delay: str = "7 days") -> DataFrame:
    """(week, category, visits, patients): rows and exact distinct persons per week (Tuesday to Monday, labelled by the
    Monday) and category, on a stream in append mode.

    Two stateful steps in a row: rows per (week, category, person), given out when the watermark closes the week, then
    persons and rows per (week, category). State holds one number for each person of an open week. A row later than
    `delay` behind the latest is dropped once its week is closed; rows within the delay count. Rows without person are
    visits, not patients. Batch frames give the same numbers for all weeks at once.
    """
    w = F.window(F.col(ts), "7 days", "7 days", "5 days").alias("w")
    rows = events.select(F.col(ts).cast("timestamp").alias(ts), F.col(category).alias("category"), F.col(person).alias("person")).withWatermark(ts, delay)
    fine = rows.groupBy(w, "category", "person").agg(F.count(F.lit(1)).alias("n"))
    out = fine.groupBy("w", "category").agg(F.sum("n").alias("visits"), F.count("person").alias("patients"))
    return out.select(F.date_sub(F.to_date("w.end"), 1).alias("week"), "category", "visits", "patients")


def sliding_signal(events: DataFrame, ts: str, value: str, delay: str = "1 day") -> DataFrame:
    """Mean, least and largest value of the seven days before each day."""
    g = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).groupBy(F.window(ts, "7 days", "1 day").alias("w"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("lo"), F.max(value).alias("hi")).select(F.to_date("w.end").alias("day"), "n", "mean", "lo", "hi")


def episodes(events: DataFrame, ts: str, person: str, gap: str = "14 days", delay: str = "1 day") -> DataFrame:
    """Events of one person closer than gap form an episode."""
    g = events.withColumn(ts, F.col(ts).cast("timestamp")).where(F.col(person).isNotNull()).withWatermark(ts, delay).groupBy(F.col(person), F.session_window(ts, gap).alias("w"))
    return g.agg(F.count(F.lit(1)).alias("n")).select(person, F.col("w.start").alias("start"), "n")


def residual_radii(residuals: DataFrame, series: str, value: str, alpha: float = 0.1, buffer: int = 52) -> DataFrame:
    """(series, n, radius) after each batch: conformal radius over the last `buffer` absolute finite residuals kept as state."""
    import math

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        for f in frames:
            r = f.sort_values("seq")[value].abs()
            kept = (kept + r[r < math.inf].tolist())[-buffer:]
        state.update((kept,))
        k = min(len(kept), max(1, math.ceil((len(kept) + 1) * (1 - alpha))))
        yield pd.DataFrame({series: [key[0]], "n": [len(kept)], "radius": [sorted(kept)[k - 1] if kept else None]})

    kind = dict(residuals.dtypes)[series]
    return residuals.groupBy(series).applyInPandasWithState(step, f"{series} {kind}, n int, radius double", "kept array<double>", "update", "NoTimeout")


def without_repeats(events: DataFrame, key: str, ts: str, delay: str = "7 days") -> DataFrame:
    """The first delivery of each key within the watermark."""
    t = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return t.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key]) if events.isStreaming else t.dropDuplicates([key])


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Everything available into a parquet sink; a second call resumes after what the first has written."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def delivered(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Everything available through a batch function, such as sources.files.keyed_batches; a later call resumes."""
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
