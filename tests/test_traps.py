"""Hand-written cases where a literal reading would be wrong."""

import datetime as dt

from pyspark.sql import functions as F

from epispark.functions import scalars as S
from epispark.functions.helpers import first_object, smallest_count
from epispark.operators import aggregates as A
from epispark.operators import clean as C
from epispark.operators import joins as J
from epispark.operators import series as R

D = dt.date


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_weeks_end_on_monday_and_count_rows_and_persons(spark):
    t = [("2024-01-08 00:00:00", "a", 1), ("2024-01-08 23:59:00", "a", None), ("2024-01-09 00:00:00", "a", 1), ("2024-01-22 10:00:00", "a", 2)]
    df = spark.createDataFrame(t, "ts string, c string, p int").withColumn("ts", F.to_timestamp("ts"))
    w = A.weekly_counts(df, "ts", "c", "p")
    assert rows(w) == [(D(2024, 1, 8), "a", 1, 2), (D(2024, 1, 15), "a", 1, 1), (D(2024, 1, 22), "a", 1, 1)]
    assert A.filled_weeks(w.where("week <> '2024-01-15'")).where("visits = 0").count() == 1


def test_doses(spark):
    df = spark.createDataFrame([(".5mg",), (".25mg",), ("12.5mg",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(S.dose_mg(F.col("t"))).collect()] == [0.5, 0.25, 12.5, None, None]
    assert [r[0] for r in df.select(S.dose_mg(F.col("t"), strict=True)).collect()][:2] == [0.05, 0.25]


def test_dates_and_null_diagnoses(spark):
    df = spark.createDataFrame([("20240131",), ("2024-01-31",), ("bad",), (None,)], "t string")
    assert [r[0] for r in df.select(F.to_date(S.lenient_time(F.col("t")))).collect()] == [D(2024, 1, 31), D(2024, 1, 31), None, None]
    rules = (("avian", ("avian flu",)), ("flu", ("flu",)))
    df = spark.createDataFrame([("avian flu",), ("flu",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(S.first_keyword(F.col("t"), rules)).collect()] == ["avian", "flu", "Other", "Other"]


def test_lab_features_of_one_value(spark):
    df = spark.createDataFrame([("s", "k", "2024-01-01 00:00:00", 5.0), ("s", "m", "2024-01-01 00:00:00", 2.0), ("s", "m", "2024-01-03 00:00:00", 2.0)], "s string, t string, ts string, v double").withColumn("ts", F.to_timestamp("ts"))
    got = {r["t"]: (r["z"], r["slope"], r["flag"]) for r in A.lab_features(df, "s", "t", "ts", "v").collect()}
    assert got == {"k": (None, 0.0, 0), "m": (0.0, 0.0, 0)}


def test_calendar_last_event_wins(spark):
    c = spark.createDataFrame([(0, "School Vacation", "Summer", D(2024, 7, 1), D(2024, 8, 31)), (1, "School Season", "Camp", D(2024, 7, 10), D(2024, 7, 12)), (2, "Public Holiday", "Day", D(2024, 7, 11), D(2024, 7, 11))], "position int, type string, event_name string, date_start date, date_end date")
    days = spark.createDataFrame([(D(2024, 7, 1),), (D(2024, 7, 11),), (D(2024, 9, 9),)], "day date")
    assert rows(J.school_status(days, "day", c)) == [(D(2024, 7, 1), "summer_break", ""), (D(2024, 7, 11), "in_session", "Day"), (D(2024, 9, 9), "in_session", "")]


def test_month_gap_gives_no_signal(spark):
    m = spark.createDataFrame([(D(2024, 1, 1), 10), (D(2024, 3, 1), 20)], "m date, n int")
    df = spark.createDataFrame([(D(2024, 4, 5),), (D(2024, 2, 5),)], "d date")
    assert rows(J.monthly_signal(df, "d", m, "m", "n")) == [(D(2024, 2, 5), 10, None), (D(2024, 4, 5), 20, None)]


def test_latest_forecast_and_missing_levels(spark):
    p = spark.createDataFrame([(D(2024, 1, 1), 1, 5.0), (D(2024, 1, 1), 2, 6.0)], "date date, as_of int, q double")
    assert rows(R.latest_per_date(p, ["date"], "as_of")) == [(D(2024, 1, 1), 2, 6.0)]
    assert R.coverage(p, ["date"], "q", 0.95).first()["coverage"] is None


def test_count_quantiles():
    assert smallest_count(0.0, 2.0, 0.5) == 0
    assert smallest_count(4.0, 1.0, 0.5) == 4
    assert smallest_count(4.0, 2.0, 0.95) > smallest_count(4.0, 1.0, 0.95)


def test_brace_scan():
    assert first_object('say {"a": "}"} end') == '{"a": "}"}'
    assert first_object('open { then {"b": 1}') == '{"b": 1}'
    assert first_object("none {") is None
    assert first_object(None) is None


def test_brace_scan_goes_on_where_a_part_is_no_json():
    assert first_object('Answer {not closed: {"k": 2} and }} more') == '{"k": 2}'


def test_pseudonyms_are_shared_and_dense(spark):
    a = spark.createDataFrame([("b",), ("a",), (None,), ("",)], "id string")
    b = spark.createDataFrame([("c",), ("a",)], "id string")
    assert rows(C.pseudonyms([(a, "id"), (b, "id")])) == [("a", "P000001"), ("b", "P000002"), ("c", "P000003")]


def test_splits_are_disjoint_and_complete(spark):
    ids = spark.range(1000).select(F.col("id"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    n = {(r["y"], r["split"]): r["count"] for r in R.stratified_split(ids, "id", "y").groupBy("y", "split").count().collect()}
    assert sum(n.values()) == 1000
    assert n[(1, "test")] == 38
    assert n[(0, "test")] == 113
