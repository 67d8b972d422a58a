"""Reading and writing: series, record directories, prediction runs, run results and signal tables."""

from __future__ import annotations

import csv
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epispark.functions.scalars import iso_week, iso_year, lenient_time
from epispark.operators.clean import first_column

DATE_COLUMNS = ("diagnosis_time", "INSPECTION_DATE", "week_end_date", "date")


def read(spark: SparkSession, path, kind: str, schema: str | None = None, **options: str) -> DataFrame:
    reader = spark.read.options(**({"header": "true"} if kind == "csv" else {}), **options)
    return (reader.schema(schema) if schema else reader).format(kind).load(path)


def read_series(spark: SparkSession, path, kind: str = "csv", candidates: Sequence[str] = DATE_COLUMNS, schema: str | None = None) -> DataFrame:
    """A wide series table with its date column, found by priority, as `date`. Bad dates are null."""
    df = read(spark, path, kind, schema)
    name = first_column(df, candidates)
    return df.withColumn("date", F.to_date(lenient_time(F.col(name)))).drop(*({name} - {"date"}))


def read_yearly(spark: SparkSession, path, kind: str = "csv", date: str = "week_end_date", fmt: str = "dd/MM/yyyy", schema: str | None = None) -> DataFrame:
    """Yearly files stacked, with the year of the file name, parsed date, ISO year and week."""
    df = read(spark, path, kind, schema)
    d = F.to_date(F.try_to_timestamp(date, F.lit(fmt)))
    return df.withColumn("year", F.regexp_extract(F.col("_metadata.file_name"), r"(\d{4})", 1).try_cast("int")).withColumn("date", d).withColumn("iso_year", iso_year(d)).withColumn("iso_week", iso_week(d))


def read_records(spark: SparkSession, path, schema: str, multiline: bool = False) -> DataFrame:
    """JSON records of a directory with their file; records that cannot be decoded are left out. What stands behind a
    complete record on its line is passed over, as Spark's reader does."""
    raw = spark.read.schema(f"{schema}, _bad string").options(mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", multiLine=str(multiline).lower()).json(path)
    return raw.withColumn("source_file", F.col("_metadata.file_name")).where("_bad is null").drop("_bad")


def header_lines(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(header, path): the first line of every file below root. One pass, of each file one row is kept by the map side."""
    lines = spark.read.options(recursiveFileLookup="true", pathGlobFilter=name).text(root)
    first = lines.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n")).where("at = 0")
    return first.groupBy("path").agg(F.min_by("value", "n").alias("header")).select("header", "path")


def read_runs(spark: SparkSession, root: str, name: str = "predictions.csv") -> DataFrame:
    """Predictions of all runs below root; the run is the folder's name. Runs may have different columns, in any order: a
    column that a run lacks is null in its rows. Files without an as_of column are left out one by one, and so are rows
    without as_of. Without any file there are no rows and only the columns run and as_of.

    Files are read by header, each group of equal ones in one read; the driver holds their paths, as any read does.
    """
    groups: dict[str, list[str]] = {}
    for r in header_lines(spark, root, name).collect():
        groups.setdefault(r["header"].removeprefix("\ufeff"), []).append(r["path"])
    out = None
    for header, paths in sorted(groups.items()):
        if "as_of" not in next(csv.reader([header]), []):
            continue
        df = spark.read.options(header="true", inferSchema="true").csv(paths)
        df = df.withColumn("run", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)).where("as_of is not null")
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return spark.createDataFrame([], "run string, as_of date") if out is None else out


RUN_JSON = "meta struct<name:string>, steps array<struct<step_index:int,as_of:string,current_target_date:string,predictor:struct<parsed_forecast:struct<q05:array<double>,q50:array<double>,q95:array<double>,point:array<double>>>,actual_values:struct<dates:array<string>,values:array<double>>>>"


def flatten_run(runs: DataFrame) -> DataFrame:
    """Nested run results as prediction rows (run, step_index, date, actual, prediction, q05, q50, q95); point falls back to q50."""
    s = runs.select(F.col("meta.name").alias("run"), F.explode("steps").alias("s"))
    f = F.col("s.predictor.parsed_forecast")
    rows = s.select("run", "s.step_index", f.alias("f"), F.posexplode(F.arrays_zip("s.actual_values.dates", "s.actual_values.values")).alias("i", "a"))
    at = lambda name: F.try_element_at(F.col(f"f.{name}"), F.col("i") + 1)
    return rows.select("run", "step_index", F.to_date("a.dates").alias("date"), F.col("a.values").alias("actual"), F.coalesce(at("point"), at("q50")).alias("prediction"), at("q05").alias("q05"), at("q50").alias("q50"), at("q95").alias("q95"))


def read_signals(spark: SparkSession, path: str | None, kind: str, schema: str, month: str | None = None) -> DataFrame:
    """A signal table with a stated schema; an absent path gives the empty table of that schema."""
    empty = spark.createDataFrame([], schema)
    if not path:
        df = empty
    else:
        try:
            df = read(spark, path, kind, schema)
        except Exception as e:  # noqa: BLE001 - Spark reports an absent path by its error class only
            if "PATH_NOT_FOUND" not in str(e):
                raise
            df = empty
    return df.withColumn("month", F.to_date(F.try_to_timestamp(month, F.lit("yyyy-MM")))) if month else df


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss").option("ignoreNullFields", "false").json(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def write_keyed(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Replace the rows of the keys that df holds, and leave all other keys as they are: one folder per key, and one
    commit for all of them. Writing the same rows again changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def keyed_batches(path: str, keys: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """write_keyed for foreachBatch. A batch that is delivered again after a crash, before or after its commit, replaces
    what it wrote before, so no key has double rows; a key that a later batch brings again takes its rows."""

    def write(batch: DataFrame, _: int) -> None:
        write_keyed(batch, path, keys)

    return write
