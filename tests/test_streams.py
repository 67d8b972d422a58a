"""Streams over slices of a table give what their batch twins give."""

from pyspark.sql import functions as F

from epispark.streaming import streams as T


def test_stream_equals_batch_and_resumes(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.orderBy("ts").repartitionByRange(3, "ts").write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")
    T.drained(T.without_repeats(stream(), "event_id", "ts").select("event_id"), f"{tmp_path}/out", f"{tmp_path}/ck")
    T.drained(T.without_repeats(stream(), "event_id", "ts").select("event_id"), f"{tmp_path}/out", f"{tmp_path}/ck")
    assert spark.read.parquet(f"{tmp_path}/out").count() == e.select("event_id").distinct().count()
    q = T.weekly_counts(stream(), "ts", "event_type", "user_id").writeStream.format("memory").queryName("weekly").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    key = ["week", "category", "visits"]
    assert sorted(map(tuple, spark.table("weekly").select(*key).collect())) == sorted(map(tuple, T.weekly_counts(e, "ts", "event_type", "user_id").select(*key).collect()))


def test_residual_state(spark, tmp_path):
    spark.range(60).select(F.lit("s").alias("series"), F.col("id").alias("seq"), F.col("id").cast("double").alias("r")).coalesce(1).write.parquet(f"{tmp_path}/r")
    s = spark.readStream.schema("series string, seq long, r double").parquet(f"{tmp_path}/r")
    q = T.residual_radii(s, "series", "r").writeStream.format("memory").queryName("radii").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    r = spark.table("radii").collect()[-1]
    assert (r["n"], r["radius"]) == (52, 55.0)


def visits(spark, path, rows):
    df = spark.createDataFrame(rows, "ts string, c string, p string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.mode("append").parquet(path)
    return df


def test_weekly_persons_with_late_rows(spark, tmp_path):
    """Rows within the delay count, also after a restart; rows of a closed week do not. Persons are exact."""
    into, out, mark = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"
    parts = [
        [("2024-01-02 10:00:00", "a", "x"), ("2024-01-03 10:00:00", "a", "x"), ("2024-01-08 23:00:00", "a", "y"), ("2024-01-04 00:00:00", "b", None)],
        [("2024-01-12 10:00:00", "a", "x")],
        [("2024-01-07 10:00:00", "a", "z"), ("2024-01-02 10:00:00", "a", "x")],  # late, within the delay
        [("2024-02-20 10:00:00", "a", "x")],
        [("2024-02-21 10:00:00", "a", "x")],
        [("2024-01-05 10:00:00", "a", "late"), ("2024-02-22 10:00:00", "a", "x")],  # its week is closed
        [("2024-06-01 10:00:00", None, None)],
        [("2024-06-02 10:00:00", None, None)],
        [("2024-06-03 10:00:00", None, None)],
    ]
    for rows in parts:
        schema = visits(spark, into, rows).schema
        T.drained(T.weekly_persons(spark.readStream.schema(schema).parquet(into), "ts", "c", "p"), out, mark)
    got = sorted((str(r["week"]), r["category"], r["visits"], r["patients"]) for r in spark.read.parquet(out).where("category is not null").collect())
    assert got == [("2024-01-08", "a", 5, 3), ("2024-01-08", "b", 1, 0), ("2024-01-15", "a", 1, 1), ("2024-02-26", "a", 3, 1)]
    kept = spark.read.parquet(into).where("p is null or p <> 'late'")
    batch = sorted((str(r["week"]), r["category"], r["visits"], r["patients"]) for r in T.weekly_persons(kept, "ts", "c", "p").where("category is not null").collect())
    assert batch == got


def test_sink_by_keys_survives_a_crash_between_write_and_commit(spark, tmp_path):
    from pyspark.errors import StreamingQueryException

    from epispark.sources.files import keyed_batches, write_keyed

    into, out, mark = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"
    schema = "run string, as_of date, v int"
    rows = lambda *r: spark.createDataFrame([(a, b, c) for a, b, c in r], "run string, as_of string, v int").withColumn("as_of", F.to_date("as_of"))
    keys = ["run", "as_of"]
    rows(("r", "2024-01-01", 1), ("r", "2024-01-01", 2), ("q", "2024-01-08", 3)).coalesce(1).write.parquet(into)

    def crashing(batch, n):
        keyed_batches(out, keys)(batch, n)
        raise RuntimeError("lost after the write, before the commit")

    stream = lambda: spark.readStream.schema(schema).parquet(into)
    try:
        T.delivered(stream(), crashing, mark)
        raise AssertionError("the crash went unseen")
    except StreamingQueryException:
        pass
    read = lambda: sorted((r["run"], str(r["as_of"]), r["v"]) for r in spark.read.schema(schema).parquet(out).collect())
    want = [("q", "2024-01-08", 3), ("r", "2024-01-01", 1), ("r", "2024-01-01", 2)]
    assert read() == want
    T.delivered(stream(), keyed_batches(out, keys), mark)
    assert read() == want
    rows(("q", "2024-01-15", 4), ("q", "2024-01-08", 5)).coalesce(1).write.mode("append").parquet(into)
    T.delivered(stream(), keyed_batches(out, keys), mark)
    assert read() == [("q", "2024-01-08", 5), ("q", "2024-01-15", 4), *want[1:]]
    write_keyed(rows(("q", "2024-01-15", 6)), out, keys)
    assert len(read()) == 4


def test_residual_state_passes_over_what_is_not_finite(spark, tmp_path):
    rows = [("s", k, float(k)) for k in range(4)] + [("s", 4, float("nan")), ("s", 5, float("inf")), ("s", 6, None)]
    spark.createDataFrame(rows, "series string, seq long, r double").coalesce(1).write.parquet(f"{tmp_path}/r")
    s = spark.readStream.schema("series string, seq long, r double").parquet(f"{tmp_path}/r")
    T.residual_radii(s, "series", "r").writeStream.format("memory").queryName("finite").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    r = spark.table("finite").collect()[-1]
    assert (r["n"], r["radius"]) == (4, 3.0)
