"""Projections, cleaning, anonymisation and set operations on record tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from epispark.session import path_exists


def renamed(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})


def first_column(df: DataFrame, names: Sequence[str]) -> str:
    """The first of the candidate columns that exists."""
    for n in names:
        if n in df.columns:
            return n
    raise ValueError(f"none of {list(names)} among {df.columns}")


def with_key(df: DataFrame, names: Sequence[str], key: str = "stay_id") -> DataFrame:
    """One string key from the first existing candidate column, else from the first column named like an id."""
    like = [c for c in df.columns if c.lower().endswith("id")]
    return df.withColumn(key, F.col(first_column(df, [*names, *like])).cast("string"))


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*names)


def required(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(names))


def complete(names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in names))


def clean_report(c: Column, phrases: Sequence[str] = (), length: int | None = None) -> Column:
    """Boilerplate removed, white space collapsed, trimmed, cut to length characters where that is asked for."""
    out = reduce(lambda a, p: F.replace(a, F.lit(p), F.lit("")), phrases, F.coalesce(c, F.lit("")))
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    return F.substring(out, 1, length) if length else out


def minmax_scaled(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Each column to [0, 1] after null to 0; a constant column becomes 0. One pass for the bounds, one row broadcast."""
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    bounds = df.agg(*[f(value(c)).alias(f"_{k}_{c}") for c in names for k, f in (("lo", F.min), ("hi", F.max))])
    scaled = {c: F.when(F.col(f"_hi_{c}") > F.col(f"_lo_{c}"), (value(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}"))).otherwise(0.0) for c in names}
    return df.crossJoin(F.broadcast(bounds)).withColumns(scaled).drop(*bounds.columns)


def column_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^a-zA-Z0-9_]", "_")


def column_names(df: DataFrame, value: str, prefix: str = "") -> DataFrame:
    """Distinct values with unique column names: clashes get a running number in the order of the values."""
    names = df.select(F.col(value)).where(F.col(value).isNotNull()).distinct().withColumn("name", F.concat(F.lit(prefix), column_name(F.col(value))))
    rank = F.row_number().over(W.partitionBy("name").orderBy(value))
    return names.withColumn("_r", rank).select(value, F.when(F.col("_r") > 1, F.concat_ws("_", "name", F.col("_r").cast("string"))).otherwise(F.col("name")).alias("name"))


def aligned(frames: Sequence[DataFrame], fill=0) -> DataFrame:
    """Stack of frames with different columns; missing columns get fill."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).fillna(fill)


def clamped(df: DataFrame, bounds: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """(name, value) rows clamped by a bounds table (name, lo, hi); values that are no numbers go, unknown names stay as they are."""
    v = F.col(value).try_cast("double")
    return df.withColumn(value, v).where(F.col(value).isNotNull()).join(F.broadcast(bounds), name, "left").withColumn(value, F.greatest(F.coalesce("lo", value), F.least(F.coalesce("hi", value), F.col(value)))).drop("lo", "hi")


def chosen(df: DataFrame, key: str, names: Sequence[str], aliases: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(key, value, disease): the columns of the given names, else of the first of their aliases that exists, stacked in
    one pass. A name without a column is an error."""
    known = {k.lower(): v for k, v in (aliases or {}).items()}
    parts = [F.struct(F.col(f"`{first_column(df, [n, *known.get(n.lower(), ())])}`").cast("double").alias("value"), F.lit(n).alias("disease")) for n in names]
    return df.select(key, F.explode(F.array(*parts)).alias("_c")).select(key, "_c.*")


# anonymisation

#: Name patterns by kind, in the order in which they are tried.
PERSONAL = (("name", ("name",)), ("id", ("id_card", "ssn", "custkey", "patient_id")), ("phone", ("phone", "tel", "mobile")), ("address", ("address", "addr")), ("age", ("age",)), ("birth", ("birth", "dob")))


def personal_kind(column: str) -> str | None:
    low = column.lower()
    return next((kind for kind, parts in PERSONAL if any(p in low for p in parts)), None)


def column_kinds(df: DataFrame) -> DataFrame:
    """(column, kind, n): what each column is by its name (other where nothing fits), and how many values it holds."""
    rows = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).unpivot([], [f"`{c}`" for c in df.columns], "column", "n")
    kind = None
    for k, parts in PERSONAL:
        hit = F.greatest(F.lit(False), *[F.contains(F.lower("column"), F.lit(p)) for p in parts])
        kind = F.when(hit, k) if kind is None else kind.when(hit, k)
    return rows.select("column", kind.otherwise("other").alias("kind"), "n")


def hashed_name(c: Column) -> Column:
    return F.when(F.trim(F.coalesce(c, F.lit(""))) == "", "ANONYMOUS").otherwise(F.substring(F.sha2(c, 256), 1, 8))


def masked_phone(c: Column) -> Column:
    d = F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", "")
    return F.when(F.length(d) >= 7, F.concat(F.substring(d, 1, 3), F.lit("****"), F.right(d, F.lit(4)))).otherwise("MASKED")


def general_address(c: Column, marks: Sequence[str]) -> Column:
    """The address up to and with the first of the marks it holds, coarsest first."""
    out = None
    for m in marks:
        part = F.concat(F.substring_index(c, m, 1), F.lit(m))
        out = F.when(F.contains(c, F.lit(m)), part) if out is None else out.when(F.contains(c, F.lit(m)), part)
    return out.otherwise(F.lit("UNKNOWN"))


def age_group(age: Column, edges: Sequence[int] = (1, 6, 18, 35, 50, 65)) -> Column:
    a = F.regexp_replace(age.cast("string"), r"[^\d.]", "").try_cast("double")
    out = F.when(a.isNull(), "unknown")
    lo = 0
    for e in edges:
        out = out.when(a < e, f"{lo}-{e - 1}")
        lo = e
    return out.otherwise(f"{lo}+")


def birth_group(birth: Column, year: int) -> Column:
    return age_group(F.lit(year) - F.year(birth))


def pseudonyms(frames: Sequence[tuple[DataFrame, str]], prefix: str = "P") -> DataFrame:
    """(id, pseudonym) for all ids of all frames, numbered in the order of the ids.

    Only distinct ids are numbered, within ranges of their order, and raised by the sizes of the ranges before.
    """
    from epispark.operators.aggregates import running_totals

    ids = reduce(lambda a, b: a.union(b), (df.select(F.col(c).cast("string").alias("id")) for df, c in frames)).where("id is not null and id <> ''").distinct()
    numbered = running_totals(ids.withColumn("one", F.lit(1)), [], "id", "one", "k")
    return numbered.select("id", pseudonym(F.col("k"), prefix).alias("pseudonym"))


def pseudonym(number: Column, prefix: str = "P") -> Column:
    """The prefix and at least six digits; more where the number has more."""
    return F.when(number.isNotNull(), F.concat(F.lit(prefix), F.format_string("%06d", number.cast("long"))))


MAPPING = "id string, number long"


def saved_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(id, number) of the mapping saved at path; none yet is the empty mapping."""
    if path_exists(spark, path):
        return spark.read.schema(MAPPING).parquet(path)
    return spark.createDataFrame([], MAPPING)


def extend_mapping(spark: SparkSession, path: str, frames: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Bring the mapping saved at path up to date with the ids of all frames, and return it.

    Known ids keep their number; new ones continue after the largest, in the order of the ids. Null and empty ids are
    not mapped. Only the new ids are numbered and appended, in one commit: a run that fails before it leaves the mapping
    as it was, and one that is repeated after it finds nothing new. Two runs at once are for the caller to keep apart.
    """
    from epispark.operators.aggregates import running_totals

    known = saved_mapping(spark, path)
    ids = reduce(lambda a, b: a.union(b), (df.select(F.col(c).cast("string").alias("id")) for df, c in frames)).where("id is not null and id <> ''").distinct()
    new = ids.join(known.select("id"), "id", "left_anti").withColumn("one", F.lit(1))
    largest = known.agg(F.coalesce(F.max("number"), F.lit(0)).alias("largest"))  # one row
    rows = running_totals(new, [], "id", "one", "k").crossJoin(F.broadcast(largest))
    rows.select("id", (F.col("k") + F.col("largest")).alias("number")).write.mode("append").parquet(path)
    return saved_mapping(spark, path)


def pseudonymised(df: DataFrame, column: str, mapping: DataFrame, prefix: str = "P") -> DataFrame:
    """df with the pseudonym in place of the id; null and empty ids are number 0. An id that the mapping lacks is null."""
    pairs = mapping.select(F.col("id").alias("_id"), F.col("number").alias("_number"))
    id_ = F.col(f"`{column}`").cast("string")
    named = df.join(pairs, id_ == F.col("_id"), "left")
    number = F.when(F.coalesce(id_, F.lit("")) == "", F.lit(0)).otherwise(F.col("_number"))
    return named.withColumn(column, pseudonym(number, prefix)).drop("_id", "_number")


def anonymised(df: DataFrame, year: int, exclude: Sequence[str] = (), marks: Sequence[str] = ("Province", "City", "District")) -> DataFrame:
    """One select that treats every personal column by its kind; ids are hashed with the name rule unless excluded."""
    treat = {"name": hashed_name, "id": lambda c: hashed_name(c.cast("string")), "phone": masked_phone, "address": lambda c: general_address(c, marks), "age": age_group, "birth": lambda c: birth_group(c, year)}
    return df.select(*[treat[k](F.col(c)).alias(c) if (k := personal_kind(c)) and c not in exclude else F.col(c) for c in df.columns])


def anonymity_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row per column: personal kind, distinct values before and after."""
    def counts(df: DataFrame, name: str) -> DataFrame:
        return df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in df.columns]).unpivot([], df.columns, "column", name)

    return counts(before, "n_before").join(counts(after, "n_after"), "column")


# sets

def source_overlap(frames: Mapping[str, DataFrame], key: str) -> DataFrame:
    """One row per id: in how many and which sources it occurs. One grouping instead of pairwise intersections."""
    rows = reduce(lambda a, b: a.union(b), (df.select(F.col(key).cast("string").alias("id"), F.lit(name).alias("source")) for name, df in frames.items()))
    return rows.where("id is not null").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n_sources"), F.array_join(F.sort_array(F.collect_list("source")), "+").alias("sources"))


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first row of each key in a stated order."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
