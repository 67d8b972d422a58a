"""Aggregations over event rows and weekly tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from epispark.functions.scalars import week_label
from epispark.session import stored


def weekly_counts(df: DataFrame, ts: str, category: str, person: str) -> DataFrame:
    """(week, category, patients, visits): distinct persons and rows in one pass.

    Two levels, so that a dominant category is spread over its persons: rows per (week, category, person) first.
    Rows without a person are visits, not patients; weeks without events are absent.
    """
    fine = df.groupBy(week_label(F.col(ts)).alias("week"), F.col(category).alias("category"), F.col(person).alias("person")).agg(F.count(F.lit(1)).alias("n"))
    return fine.groupBy("week", "category").agg(F.count("person").alias("patients"), F.sum("n").alias("visits"))


def filled_weeks(weekly: DataFrame) -> DataFrame:
    """Absent weeks of each category as zero, between the first and the last week of all."""
    span = weekly.agg(F.min("week").alias("lo"), F.max("week").alias("hi"))
    grid = weekly.select("category").distinct().crossJoin(F.broadcast(span)).select("category", F.explode(F.sequence("lo", "hi", F.expr("interval 7 days"))).alias("week"))
    return grid.join(weekly, ["week", "category"], "left").fillna(0, ["patients", "visits"])


def wide(weekly: DataFrame, values: Sequence[str], value: str = "patients", key: str = "week", category: str = "category") -> DataFrame:
    """One column per category of a fixed list, absent ones 0, in sorted order."""
    return weekly.groupBy(key).pivot(category, sorted(values)).agg(F.sum(value)).fillna(0)


def long(df: DataFrame, key: str, drop: Sequence[str] = ("Other",)) -> DataFrame:
    """(key, category, n) of the positive cells of a wide table."""
    cells = [c for c in df.columns if c != key and c not in drop]
    return df.unpivot([key], cells, "category", "n").where("n > 0")


def daily_persons(df: DataFrame, ts: str, person: str) -> DataFrame:
    return df.where(F.col(person).isNotNull()).groupBy(F.to_date(ts).alias("day")).agg(F.count_distinct(person).alias("persons"))


def mean_matrix(df: DataFrame, keys: Sequence, column: str, values: Sequence, value: str, absent: float = -1.0) -> DataFrame:
    return df.groupBy(*keys).pivot(column, list(values)).agg(F.avg(value)).fillna(absent)


def profile(df: DataFrame, key: str, required: Sequence[str], samples: int = 5) -> DataFrame:
    """Rows, ids, rows without id, ids of complete rows, shares and the first sample ids, in one aggregation."""
    whole = F.lit(True)
    for c in required:
        whole = whole & F.col(c).isNotNull()
    ids = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(whole.cast("int")).alias("whole"))
    first = ids.where(F.col(key).isNotNull()).orderBy(key).limit(samples).agg(F.array_join(F.array_sort(F.collect_list(F.col(key))), ",").alias("sample_ids"))
    out = ids.agg(F.sum("n").alias("n_rows"), F.count(key).alias("n_ids"), F.sum(F.when(F.col(key).isNull(), F.col("n")).otherwise(0)).alias("n_null"), F.sum(F.when(F.col(key).isNotNull(), F.col("whole")).otherwise(0)).alias("n_complete"))
    return out.withColumn("complete_share", F.col("n_complete") / F.col("n_ids")).withColumn("rows_per_id", F.col("n_rows") / F.col("n_ids")).crossJoin(F.broadcast(first))


def value_shares(df: DataFrame, column: str) -> DataFrame:
    n = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select(column, "n", (F.col("n") / F.col("total")).alias("share"))


def rare_grouped(df: DataFrame, column: str, threshold: float, other: str = "Other") -> DataFrame:
    s = value_shares(df, column)
    return s.groupBy(F.when(F.col("share") < threshold, other).otherwise(F.col(column)).alias("category")).agg(F.sum("n").alias("n"))


def box_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.groupBy(group).agg(F.min(value).alias("lo"), q.alias("q"), F.max(value).alias("hi")).select(group, "lo", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"), F.col("q")[2].alias("q3"), "hi")


def gated_columns(df: DataFrame, columns: Sequence[str], fewer_than: int = 50, rsd: float = 0.02) -> list[str]:
    """Those of the columns with more than one and fewer than `fewer_than` different values (nulls are none).

    One pass of mergeable sketches over all columns; where an estimate lies too near the limit to be trusted (six
    standard errors), a second pass counts these columns exactly. The driver gets one row.
    """
    if not columns:
        return []
    col = lambda c: F.col(f"`{c}`")
    row = df.agg(*[F.approx_count_distinct(col(c), rsd) for c in columns], *[F.coalesce(F.min(col(c)) < F.max(col(c)), F.lit(False)) for c in columns]).first()
    about, several = row[: len(columns)], row[len(columns) :]
    near = [c for c, n, more in zip(columns, about, several, strict=True) if more and abs(n - fewer_than) <= 6 * rsd * fewer_than + 2]
    exact = dict(zip(near, df.agg(*[F.count_distinct(col(c)) for c in near]).first(), strict=True)) if near else {}
    return [c for c, n, more in zip(columns, about, several, strict=True) if more and exact.get(c, n) < fewer_than]


def column_boxes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, lo, q1, q2, q3, hi) of numeric columns with few different values, in one pass over all of them."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns])).alias("x")
    return box_stats(df.select(each).select("x.*").where("value is not null"), "column", "value")


def column_histograms(df: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """(column, bin, n): counts of numeric columns over bins of equal width between least and largest value, which the
    last bin holds. One pass for the bounds (one row to the driver), one for the counts."""
    col = lambda c: F.col(f"`{c}`").cast("double")
    row = df.agg(*[f(col(c)) for c in columns for f in (F.min, F.max)]).first()
    bounds = {c: (row[2 * k], row[2 * k + 1]) for k, c in enumerate(columns)}
    spot = lambda c, lo, hi: F.least(F.width_bucket(col(c), F.lit(lo), F.lit(hi), F.lit(bins)), F.lit(bins)).cast("int")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), spot(c, *bounds[c]).alias("bin")) for c in columns])).alias("x")
    return df.select(each).select("x.*").where("bin is not null").groupBy("column", "bin").agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts per bin; the last bin holds its upper edge."""
    k = F.least(F.width_bucket(F.col(value), F.lit(lo), F.lit(hi), F.lit(bins)), F.lit(bins))
    return df.groupBy(k.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def word_counts(df: DataFrame, text: str, pattern: str = r"\s+") -> DataFrame:
    return df.select(F.explode(F.split(F.lower(text), pattern)).alias("word")).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def first_time(df: DataFrame, key: str, ts: str, code: str) -> DataFrame:
    return df.groupBy(key).agg(F.min(ts).alias("t0"), F.sort_array(F.collect_set(code)).alias("codes"))


def ordered_text(df: DataFrame, key: str, order: str, text: str, sep: str = " ", length: int = 256) -> DataFrame:
    """Texts of a key in order, joined and cut; pieces are cut before they are gathered."""
    piece = F.substring(F.col(text), 1, length)
    parts = F.sort_array(F.collect_list(F.struct(F.col(order), piece.alias("t"))))
    return df.where(F.col(text).isNotNull()).groupBy(key).agg(F.substring(F.array_join(F.transform(parts, lambda p: p["t"]), sep), 1, length).alias("text"))


def lab_features(df: DataFrame, key: str, test: str, ts: str, value: str, ranges: Mapping[str, tuple[float, float, float, float]] | None = None) -> DataFrame:
    """(key, test, z, slope, flag): z of the first value, change within 24 hours of the first, out-of-range flag.

    ranges: test to (mean, std, low, high); tests without one use the group's own mean and sample deviation (1 when it
    is 0, null z for a single value) and are never flagged. Ties in time go to the smaller value.
    """
    w = W.partitionBy(key, test)
    rows = df.where(F.col(value).isNotNull()).withColumn("_t0", F.min(ts).over(w))
    near = F.col(ts) <= F.col("_t0") + F.expr("interval 24 hours")
    g = rows.groupBy(key, test).agg(
        F.min(F.struct(ts, value))[value].alias("first"),
        F.max(F.when(near, F.struct(ts, value)))[value].alias("last"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
    )
    known = ranges or {}
    pick = lambda i: F.coalesce(*[F.when(F.col(test) == t, F.lit(float(r[i]))) for t, r in known.items()], F.lit(None).cast("double"))
    mean, std = F.coalesce(pick(0), "mean"), F.coalesce(pick(1), F.when(F.col("std") == 0, 1.0).otherwise(F.col("std")))
    out = (F.col("first") < pick(2)) | (F.col("first") > pick(3))
    return g.select(key, test, ((F.col("first") - mean) / std).alias("z"), (F.col("last") - F.col("first")).alias("slope"), F.coalesce(out, F.lit(False)).cast("int").alias("flag"))


def packed_features(features: DataFrame, key: str, test: str) -> DataFrame:
    """Map test to z|slope|flag per key."""
    entry = F.struct(F.col(test), F.format_string("%.2f|%.2f|%d", F.coalesce("z", F.lit(0.0)), "slope", "flag").alias("v"))
    return features.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("labs"))


def summed(frames: Sequence[DataFrame], key: str, value: str) -> DataFrame:
    out = frames[0].select(key, value)
    for f in frames[1:]:
        out = out.unionByName(f.select(key, value))
    return out.groupBy(key).agg(F.sum(F.coalesce(value, F.lit(0))).alias(value))


def monthly_spread(months: DataFrame, month: str, n: str, as_of: Column) -> DataFrame:
    """Each month's count in four equal parts, on the days 0, 7, 14 and 21 before its end, by weeks before as_of."""
    part = months.select(F.col(n), F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.date_sub(F.last_day(F.col(month)), (k * 7).cast("int")))).alias("day"))
    week = F.floor(F.datediff(as_of, "day") / 7).cast("int")
    return part.where(F.col("day") <= as_of).groupBy(week.alias("weeks_ago")).agg((F.sum(n) / 4).alias("n"))


def recent_signal(df: DataFrame, group: str, ts: str, as_of: Column) -> DataFrame:
    """Rows of the last week against the mean of the three before: change and capped ratio; only rows up to as_of."""
    week = F.floor(F.datediff(as_of, F.to_date(ts)) / 7)
    n = lambda k: F.sum((week == k).cast("int"))
    g = df.where(F.to_date(ts) <= as_of).groupBy(group).agg(n(0).alias("last"), ((n(1) + n(2) + n(3)) / 3).alias("prev"))
    change = F.when(F.col("prev") > 0, (F.col("last") - F.col("prev")) / F.greatest(F.lit(1.0), "prev")).when(F.col("last") > 0, 1.0).otherwise(0.0)
    return g.withColumn("change", change).withColumn("ratio", F.least(F.lit(3.0), F.col("last") / 5))


def value_ranges(df: DataFrame, column: str, ranges: int = 256, sample: int = 8192) -> Column:
    """Number of the range of values that a row falls into, ranges of about equally many different values.

    The edges come from a sample of at most `sample` different values (those with the smallest hashes, so the ranges are
    the same on every run); only the balance of the ranges depends on it."""
    values = df.select(F.col(column).alias("v")).where("v is not null").distinct()
    few = sorted(r[0] for r in values.orderBy(F.xxhash64("v"), "v").limit(sample).collect())
    edges = few[:: max(1, -(-len(few) // ranges))]
    kind = df.schema[column].dataType

    def found(lo: int, hi: int) -> Column:
        """By halves, so a row meets few edges."""
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(column) < F.lit(edges[mid]).cast(kind), found(lo, mid)).otherwise(found(mid + 1, hi))

    return found(0, len(edges))


def running_sums(df: DataFrame, keys: Sequence[str], order: str, totals: Mapping[str, str]) -> DataFrame:
    """Sums of columns up to and with each row of its keys, in an order without ties and nulls; totals: new column to the
    column it sums. df is stored first, so its own plan runs once. No task sees more than a range of the order: sums run
    within ranges, and are raised by the totals of the ranges before, of which there are few a key."""
    df = stored(df)
    rows = df.withColumn("_range", value_ranges(df, order))
    per = rows.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_sum_{k}") for k, c in enumerate(totals.values())])
    w = W.partitionBy(*keys).orderBy("_range")  # at most as many rows a key as there are ranges
    before = per.select(*keys, "_range", *[(F.sum(f"_sum_{k}").over(w) - F.col(f"_sum_{k}")).alias(f"_before_{k}") for k in range(len(totals))])
    here = W.partitionBy(*keys, "_range").orderBy(order)
    within = rows.withColumns({out: F.sum(c).over(here) for out, c in totals.items()}).join(before, [*keys, "_range"])
    return within.withColumns({out: F.col(out) + F.col(f"_before_{k}") for k, out in enumerate(totals)}).drop("_range", *[f"_before_{k}" for k in range(len(totals))])


def running_totals(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str) -> DataFrame:
    """running_sums of one column."""
    return running_sums(df, keys, order, {out: value})


def top_values(df: DataFrame, column: str, k: int = 30, tracked: int = 8192) -> DataFrame:
    """(value, n, rank): the k most frequent values, ties by value; exact, nulls are none.

    A mergeable sketch of `tracked` counters names the candidates in one pass, a second one counts them exactly. A value
    outside the sketch occurs at most 3.5 / tracked of all times; only where the k-th candidate is no more frequent than
    that (nearly all values rare) are all values counted. At most 2 k + 1 values go to the driver.
    """
    tracked = max(tracked, 2 * k)
    name = f"`{column}`"
    # as text, for types that the sketch does not take
    rows = df.select(F.col(name).alias("value"), F.col(name).cast("string").alias("text")).where("value is not null")
    row = rows.agg(F.expr(f"approx_top_k(text, {2 * k}, {tracked})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    names = [r["item"] for r in row["top"] or []]
    n = rows.where(F.col("text").isin(names)).groupBy("value").agg(F.count(F.lit(1)).alias("n")) if names else rows.limit(0).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    best = n.orderBy(F.desc("n"), "value").limit(k)
    least = best.agg(F.count(F.lit(1)), F.min("n")).first()
    if row["n"] and (least[0] < k and len(names) >= k or (least[1] or 0) * tracked <= 3.5 * row["n"]):
        best = rows.groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)
    # k rows
    return best.select("value", "n", F.row_number().over(W.orderBy(F.desc("n"), "value")).alias("rank"))


def top_flags(df: DataFrame, column: str, k: int = 30, prefix: str = "top") -> DataFrame:
    """df with a 0/1 column for each of its k most frequent values, in one scan. A column is called
    `<prefix>_<value, letters and digits only>_<rank from 0>`, so names stay apart where values shrink to the same."""
    from epispark.operators.clean import column_name

    top = top_values(df, column, k).select("value", "rank", column_name(F.col("value").cast("string")).alias("name")).orderBy("rank").collect()  # k rows
    flag = lambda v: F.coalesce(F.col(f"`{column}`") == F.lit(v), F.lit(False)).cast("int")
    return df.withColumns({f"{prefix}_{r['name']}_{r['rank'] - 1}": flag(r["value"]) for r in top})


def top_weekly(df: DataFrame, ts: str, category: str, person: str, k: int) -> DataFrame:
    """Weekly persons and rows of the k categories with most persons over all weeks; weeks of the table without any are 0."""
    from epispark.operators.series import top_categories

    top = top_categories(df, category, person, k).select(category)  # k rows
    weekly = weekly_counts(df.join(F.broadcast(top), category, "left_semi"), ts, category, person)
    weeks = df.select(week_label(F.col(ts)).alias("week")).where("week is not null").distinct()
    grid = weeks.crossJoin(F.broadcast(top.withColumnRenamed(category, "category")))
    return grid.join(weekly, ["week", "category"], "left").fillna(0, ["patients", "visits"])


def step_flags(stays: DataFrame, events: DataFrame, key: str, step: Column, flags: Mapping[str, Column], part: int = 1 << 18) -> DataFrame:
    """Per stay and step 1 where any event of it raises a flag.

    Stays and events meet in parts of about `part` events, dealt by key: more events make more tasks, not larger ones.
    """
    parts = max(1, -(-events.count() // part))
    placed = events.repartition(parts, key).join(stays.repartition(parts, key).hint("merge"), key).withColumn("time_idx", step).where("time_idx >= 0")
    return placed.groupBy(key, "time_idx").agg(*[F.max(c.cast("int")).alias(n) for n, c in flags.items()])


def severe_outcome(stays: DataFrame, flagged: Sequence[DataFrame], key: str) -> DataFrame:
    """stays with outcome 1 where any of the flagged id tables holds the key."""
    ids = flagged[0].select(key)
    for f in flagged[1:]:
        ids = ids.union(f.select(key))
    return stays.join(ids.distinct().withColumn("_hit", F.lit(1)), key, "left").withColumn("outcome", F.coalesce("_hit", F.lit(0))).drop("_hit")


def class_report(df: DataFrame, y: str, p: str) -> DataFrame:
    """Support, precision, recall and F1 per class from the confusion counts."""
    cells = df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    by = cells.select("y", "p", "n", F.explode(F.array_distinct(F.array("y", "p"))).alias("label"))
    g = by.groupBy("label").agg(*[F.sum(F.when(c, F.col("n")).otherwise(0)).alias(k) for k, c in (("tp", (F.col("y") == F.col("label")) & (F.col("p") == F.col("label"))), ("support", F.col("y") == F.col("label")), ("said", F.col("p") == F.col("label")))])
    precision, recall = F.coalesce(F.try_divide("tp", "said"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    return g.select("label", "support", precision.alias("precision"), recall.alias("recall"), F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"))


def score_areas(df: DataFrame, y: str, score: str) -> DataFrame:
    """One row: n, positives, auroc (null without both classes) and auprc, the average precision: over the different
    scores from the highest, the gain in recall times the precision at that score (0 without positives, null without rows).

    Equal scores are merged first, so ties count as one threshold; counts below a score run within ranges of scores, so
    no task sorts all of them. Rows with a null label, or a null or NaN score, take no part.
    """
    rows = df.select(F.col(y).cast("long").alias("y"), F.col(score).cast("double").alias("s")).where("y is not null and s is not null and not isnan(s)")
    s = rows.groupBy("s").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    ranked = running_sums(s, [], "s", {"upto_pos": "pos", "upto_neg": "neg"})
    total = ranked.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    x = ranked.crossJoin(F.broadcast(total))  # one row
    below = F.col("upto_neg") - F.col("neg")
    hit, miss = F.col("all_pos") - F.col("upto_pos") + F.col("pos"), F.col("all_neg") - F.col("upto_neg") + F.col("neg")
    roc = F.try_divide(F.sum(F.col("pos") * (below + F.col("neg") / 2)), F.max("all_pos") * F.max("all_neg"))
    precision = F.sum(F.col("pos") * hit / (hit + miss))
    return x.agg(F.sum(F.col("pos") + F.col("neg")).alias("n"), F.sum("pos").alias("positives"), roc.alias("auroc"), F.when(F.max("all_pos") == 0, 0.0).otherwise(F.try_divide(precision, F.max("all_pos"))).alias("auprc"))


def auroc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Area under the ROC curve by ranks, as in score_areas."""
    return score_areas(df, y, score).select("auroc")


def calibration(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("observed"), F.avg(p).alias("predicted"))


def split_distribution(df: DataFrame, split: str, outcome: str) -> DataFrame:
    n = df.groupBy(split, outcome).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(W.partitionBy(split)))
