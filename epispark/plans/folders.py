"""Queries through files: what the writers write, the readers and streams read again. Files lie in the shared folder."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from epispark.operators import aggregates as A
from epispark.operators import clean as C
from epispark.operators import series as R
from epispark.plans.forecasts import SERIES, series
from epispark.plans.records import WEEK
from epispark.plans.registry import query, table
from epispark.plans.reports import RUNS, runs
from epispark.session import shared_folder
from epispark.sources import files as I
from epispark.streaming import streams as T

EV = WEEK.format("ts")


def folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@query("src1_series_file", f"WITH w AS (SELECT CAST({EV} AS DATE) AS date, event_type, count(DISTINCT user_id) AS n FROM events GROUP BY ALL) SELECT date, CAST(coalesce(sum(n) FILTER (event_type = 'purchase'), 0) AS INTEGER) AS purchase, CAST(coalesce(sum(n) FILTER (event_type = 'view'), 0) AS INTEGER) AS view FROM w GROUP BY 1")
def src1(spark, d):
    weekly = A.wide(A.weekly_counts(table(spark, d, "events"), "ts", "event_type", "user_id"), ["purchase", "view"])
    path = folder(spark, "series")
    I.write_csv(weekly.withColumn("INSPECTION_DATE", F.date_format("week", "yyyyMMdd")).select("INSPECTION_DATE", "purchase", "view"), path)
    return I.read_series(spark, path, schema="INSPECTION_DATE string, purchase int, view int")


@query("src3_one_series", f"WITH {SERIES} SELECT week AS date, v AS value FROM s WHERE series = '1-URGENT'")
def src3(spark, d):
    path = folder(spark, "one")
    I.write_csv(series(spark, d).where("series = '1-URGENT'").select(F.col("week").alias("week_end_date"), F.col("v").alias("cases")), path)
    return I.read_series(spark, path, schema="week_end_date string, cases double").select("date", F.col("cases").alias("value"))


@query("src4_records", "SELECT event_id, event_type, value FROM events WHERE event_id % 10 <> 0")
def src4(spark, d):
    path = folder(spark, "records")
    whole = F.to_json(F.struct("event_id", "event_type", "value"))
    line = F.when(F.col("event_id") % 10 == 0, F.regexp_replace(whole, r"\}$", "")).otherwise(whole)
    broken = F.when(F.col("event_id") % 20 == 0, F.substring(whole, 1, 9)).otherwise(line)
    table(spark, d, "events").select(broken.alias("value")).write.text(path)
    return I.read_records(spark, path, "event_id long, event_type string, value double").drop("source_file")


@query("src5_runs", f"WITH {RUNS.replace('week + CAST(7 * (k - 1) AS INTEGER)', 'as_of + CAST(7 * k AS INTEGER)')} SELECT 'run=' || run AS run, count(*) AS n, round(sum(actual), 3) AS actual, round(sum(prediction), 3) AS prediction FROM y GROUP BY 1")
def src5(spark, d):
    path = folder(spark, "runs")
    runs(spark, d).write.partitionBy("run").option("header", True).csv(path)
    got = I.read_runs(spark, path, "*.csv")
    return got.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("actual"), 3).alias("actual"), F.round(F.sum("prediction"), 3).alias("prediction"))


@query("src5_mixed_runs", f"WITH {RUNS.replace('week + CAST(7 * (k - 1) AS INTEGER)', 'as_of + CAST(7 * k AS INTEGER)')} SELECT run, count(*) AS n, round(sum(actual), 3) AS actual, round(sum(prediction), 3) AS prediction, CASE WHEN run = 'last' THEN round(sum(prediction * 0.5), 3) END AS q_05, CASE WHEN run = 'higher' THEN round(sum(prediction * 2), 3) END AS q_95 FROM y GROUP BY 1")
def src5b(spark, d):
    """Runs with different columns in different orders, beside a file that has no as_of."""
    path, y = folder(spark, "mixed"), runs(spark, d)
    of = lambda name: y.where(F.col("run") == name).drop("run")
    last = of("last").select("as_of", "date", (F.col("prediction") * 0.5).alias("q_0.05"), "actual", "prediction")
    higher = of("higher").select("prediction", (F.col("prediction") * 2).alias("q_0.95"), "actual", "date", "as_of")
    for name, rows in (("last", last), ("higher", higher), ("flat", of("last").drop("as_of"))):
        I.write_csv(rows, f"{path}/{name}")
    got = I.read_runs(spark, path, "*.csv").groupBy("run")
    rounded = lambda c, name: F.round(F.sum(f"`{c}`"), 3).alias(name)
    return got.agg(F.count(F.lit(1)).alias("n"), rounded("actual", "actual"), rounded("prediction", "prediction"), rounded("q_0.05", "q_05"), rounded("q_0.95", "q_95"))


@query("src7_signals", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS cases FROM orders GROUP BY 1")
def src7(spark, d):
    path = folder(spark, "signals")
    monthly = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("report_period")).agg(F.count(F.lit(1)).alias("cases"))
    I.write_csv(monthly, path)
    none = I.read_signals(spark, f"{path}-absent", "csv", "report_period string, cases long", "report_period")
    return I.read_signals(spark, path, "csv", "report_period string, cases long", "report_period").unionByName(none).select("month", "cases")


@query("snk2_json_rows", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS status, CAST(o_orderdate AS DATE) AS day FROM orders")
def snk2(spark, d):
    path = folder(spark, "json")
    o = table(spark, d, "orders")
    I.write_json(o.select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("status"), F.col("o_orderdate").cast("timestamp").alias("day")), path)
    return I.read(spark, path, "json", "o_orderkey long, status string, day timestamp").withColumn("day", F.to_date("day"))


@query("snk3_splits", "WITH x AS (SELECT DISTINCT doc_id, toxic, (doc_id * 2654435761) % 4294967296 AS h FROM labels), r AS (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY h, doc_id) AS i, ceil(count(*) OVER (PARTITION BY toxic) * 0.15) AS a, count(*) OVER (PARTITION BY toxic) AS n FROM x) SELECT CASE WHEN i <= a THEN 'test' WHEN i <= a + ceil((n - a) * (0.15 / 0.85)) THEN 'validation' ELSE 'train' END AS split, toxic, count(*) AS n FROM r GROUP BY ALL")
def snk3(spark, d):
    path = folder(spark, "splits")
    I.write_splits(R.stratified_split(table(spark, d, "labels"), "doc_id", "toxic"), path)
    return spark.read.parquet(path).groupBy("split", "toxic").agg(F.count(F.lit(1)).alias("n"))


@query("str5_resumed_stream", "SELECT DISTINCT event_id, user_id FROM events")
def str5(spark, d):
    """The stream is stopped when its input is drained and started again after more files came."""
    path, out, mark = folder(spark, "stream"), folder(spark, "sink"), folder(spark, "mark")
    e = table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    for part in (F.col("event_id") % 3 != 0, F.col("event_id") % 3 == 0):
        e.where(part).write.mode("append").parquet(path)
        T.drained(spark.readStream.schema(e.schema).parquet(path).select("event_id", "user_id"), out, mark)
    return spark.read.schema("event_id long, user_id long").parquet(out)


@query("str5_keyed_sink", f"WITH {RUNS.replace('week + CAST(7 * (k - 1) AS INTEGER)', 'as_of + CAST(7 * k AS INTEGER)')} SELECT run, as_of, date, actual, prediction FROM y")
def str5b(spark, d):
    """Forecast rows arrive by origin, those of some origins twice, as after a crash; the sink holds each origin once."""
    path, out, mark = folder(spark, "steps"), folder(spark, "keyed"), folder(spark, "mark")
    y = runs(spark, d)
    for part in ("month(as_of) <= 8", "month(as_of) > 6"):
        y.where(part).repartition("run", "as_of").write.mode("append").parquet(path)
        T.delivered(spark.readStream.schema(y.schema).parquet(path), I.keyed_batches(out, ["run", "as_of"]), mark)
    return spark.read.schema(y.schema).parquet(out).select("run", "as_of", "date", "actual", "prediction")


@query("str1_weekly_persons", f"SELECT CAST({EV} AS DATE) AS week, event_type AS category, CAST(count(*) AS BIGINT) AS visits, count(DISTINCT user_id) AS patients FROM events GROUP BY ALL")
def str1b(spark, d):
    """The stream itself, over three parts in order of time; a row far behind them closes the last weeks."""
    path, out, mark = folder(spark, "visits"), folder(spark, "weeks"), folder(spark, "mark")
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id")
    lo, hi = e.agg(F.min("ts"), F.max("ts")).first()
    cut = [lo + (hi - lo) * k / 3 for k in (1, 2)] if lo else []
    part = sum((F.when(F.col("ts") >= c, 1).otherwise(0) for c in cut), F.lit(0))
    after = [spark.createDataFrame([(hi + (hi - lo) + dt.timedelta(days=30), None, None)], e.schema)] if lo else []
    for rows in [*(e.where(part == k) for k in range(3)), *after]:
        rows.write.mode("append").parquet(path)
        T.drained(T.weekly_persons(spark.readStream.schema(e.schema).parquet(path), "ts", "event_type", "user_id"), out, mark)
    return spark.read.schema("week date, category string, visits long, patients long").parquet(out).where("category is not null")


@query("pii6_saved_mapping", "WITH o AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS id FROM orders), c AS (SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT id FROM o)), m AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM o UNION ALL SELECT id, row_number() OVER (ORDER BY id) + (SELECT count(*) FROM o) FROM c) SELECT c_custkey, 'P' || lpad(CAST(CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE n END AS VARCHAR), 6, '0') AS pseudonym FROM customer JOIN m ON id = CAST(c_custkey AS VARCHAR)")
def pii6b(spark, d):
    """The mapping of the orders, extended by the customers, and read by these; every tenth has no id."""
    path = folder(spark, "mapping")
    C.extend_mapping(spark, path, [(table(spark, d, "orders"), "o_custkey")])
    customers = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 10 != 0, F.col("c_custkey").cast("string")).otherwise("").alias("pseudonym"))
    mapping = C.extend_mapping(spark, path, [(table(spark, d, "customer"), "c_custkey"), (table(spark, d, "orders"), "o_custkey")])
    return C.pseudonymised(customers, "pseudonym", mapping)


@query("str4_residual_radii", f"WITH {SERIES}, l AS (SELECT series, week, abs(v - lag(v) OVER (PARTITION BY series ORDER BY week)) AS e FROM s), k AS (SELECT series, e, row_number() OVER (PARTITION BY series ORDER BY week DESC) AS r FROM l WHERE e IS NOT NULL), b AS (SELECT series, list_sort(list(e)) AS b FROM k WHERE r <= 52 GROUP BY 1) SELECT series, CAST(len(b) AS INTEGER) AS n, b[CAST(least(len(b), greatest(1, ceil((len(b) + 1) * 0.9))) AS INTEGER)] AS radius FROM b")
def str4(spark, d):
    """Residuals arrive in two parts; what each part gives is kept, and the later row of a series counts."""
    path, out, mark = folder(spark, "residuals"), folder(spark, "radii"), folder(spark, "mark")
    r = R.lagged(series(spark, d), "series", "week", "v", [1]).select("series", F.unix_date("week").cast("long").alias("seq"), (F.col("v") - F.col("lag_1")).alias("r"))
    for part in ("week < date'1998-01-01'", "week >= date'1998-01-01'"):
        r.where(part.replace("week", "date_from_unix_date(cast(seq as int))")).coalesce(1).write.mode("append").parquet(path)
        keep = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)
        stream = T.residual_radii(spark.readStream.schema(r.schema).parquet(path), "series", "r")
        stream.writeStream.foreachBatch(keep).option("checkpointLocation", mark).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(out).groupBy("series").agg(F.max_by(F.struct("n", "radius"), "batch").alias("x"))
    return last.select("series", "x.*")
