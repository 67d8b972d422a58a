"""Batch twins of the streaming queries over the given tables, and the run-result reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from epispark.plans.records import WEEK
from epispark.plans.registry import query, table
from epispark.sources.files import RUN_JSON, flatten_run
from epispark.streaming import streams as T

W = WEEK.format("ts")


@query("str1_weekly_visits", f"SELECT CAST({W} AS DATE) AS week, event_type AS category, count(*) AS visits FROM events GROUP BY ALL")
def str1(spark, d):
    return T.weekly_counts(table(spark, d, "events"), "ts", "event_type", "user_id").drop("patients")


@query("str2_sliding_signal", "SELECT day, count(*) AS n, avg(value) AS mean, min(value) AS lo, max(value) AS hi FROM (SELECT CAST(ts AS DATE) + CAST(k AS INTEGER) AS day, value FROM events, (SELECT unnest(generate_series(1, 7)) AS k)) GROUP BY 1")
def str2(spark, d):
    return T.sliding_signal(table(spark, d, "events"), "ts", "value")


@query("str3_episodes", "WITH x AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS b FROM events WHERE user_id IS NOT NULL), y AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS e FROM x) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM y GROUP BY user_id, e")
def str3(spark, d):
    return T.episodes(table(spark, d, "events"), "ts", "user_id", "12 hours").select("user_id", F.unix_micros("start").alias("start_us"), "n")


@query("str6_without_repeats", "SELECT user_id, count(*) AS n FROM (SELECT DISTINCT event_id, user_id FROM events) GROUP BY 1")
def str6(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", "user_id")
    return T.without_repeats(e.unionAll(e), "event_id", "ts").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("src6_run_results", "SELECT event_type AS run, CAST(event_id AS INTEGER) AS step_index, CAST(ts AS DATE) AS date, value AS actual, value * 2 AS prediction, value AS q05, value * 2 AS q50, value * 3 AS q95 FROM events WHERE value IS NOT NULL")
def src6(spark, d):
    e = table(spark, d, "events").where("value is not null")
    one = lambda c: F.array(c)
    v = F.col("value")
    forecast = F.struct(one(v).alias("q05"), one(v * 2).alias("q50"), one(v * 3).alias("q95"), F.array().cast("array<double>").alias("point"))
    step = F.struct(F.col("event_id").cast("int").alias("step_index"), F.struct(forecast.alias("parsed_forecast")).alias("predictor"), F.struct(one(F.to_date("ts").cast("string")).alias("dates"), one(v).alias("values")).alias("actual_values"))
    text = e.select(F.to_json(F.struct(F.struct(F.col("event_type").alias("name")).alias("meta"), F.array(step).alias("steps"))).alias("j"))
    return flatten_run(text.select(F.from_json("j", RUN_JSON).alias("r")).select("r.*"))
