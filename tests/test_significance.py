"""Scores, areas and p-values against plain Python and tabulated values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from epispark.functions.helpers import student_tails
from epispark.operators import series as R
from epispark.operators.aggregates import column_boxes, column_histograms, gated_columns, score_areas, top_flags, top_values


def plain_areas(rows):
    rows = [(y, s) for y, s in rows if y is not None and s is not None and not math.isnan(s)]
    pos = sum(y for y, _ in rows)
    auprc, hits, said = 0.0, 0, 0
    for s in sorted({s for _, s in rows}, reverse=True):
        mine = [y for y, t in rows if t == s]
        hits, said = hits + sum(mine), said + len(mine)
        auprc += sum(mine) * hits / said
    return len(rows), pos, auprc / pos if pos else 0.0


def test_areas_with_ties_and_nulls(spark):
    r = random.Random(4)
    rows = [(r.randrange(2), round(r.random(), 1 + k % 3)) for k in range(2000)] + [(None, 0.5), (1, None), (0, float("nan"))]
    got = score_areas(spark.createDataFrame(rows, "y int, s double").repartition(5), "y", "s").first()
    n, pos, auprc = plain_areas(rows)
    assert (got["n"], got["positives"]) == (n, pos)
    assert abs(got["auprc"] - auprc) < 1e-12


@pytest.mark.parametrize(("rows", "auroc", "auprc"), [([(1, 0.2), (1, 0.4)], None, 1.0), ([(0, 0.2), (0, 0.4)], None, 0.0), ([(1, 0.5), (0, 0.5)], 0.5, 0.5), ([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], 0.75, 5 / 6), ([], None, None)])
def test_areas_of_small_cases(spark, rows, auroc, auprc):
    got = score_areas(spark.createDataFrame(rows, "y int, s double"), "y", "s").first()
    near = lambda a, b: a is b if None in (a, b) else abs(a - b) < 1e-12
    assert near(got["auroc"], auroc)
    assert rows == [] or near(got["auprc"], auprc)


@pytest.mark.parametrize(("t", "df", "p"), [(12.706205, 1, 0.05), (2.228139, 10, 0.05), (3.169273, 10, 0.01), (1.959966, 10**7, 0.05), (0.0, 5, 1.0), (-2.228139, 10, 0.05), (6.3138, 1, 0.1), (2.042272, 30, 0.05)])
def test_student_tails_are_the_tabulated_ones(t, df, p):
    assert abs(student_tails(t, df) - p) < 2e-6


def test_paired_tests_with_p_values(spark):
    """The before-and-after example of Wilcoxon's test: differences 8 14 23 ... without and with ties and zeros."""
    d = [6, 8, 14, 16, 23, 24, 28, 29, 41, -48, 49, 56, 60, -67, 75]
    rows = [("a", k, 100.0 + x) for k, x in enumerate(d)] + [("base", k, 100.0) for k in range(len(d))]
    rows += [("same", k, 100.0) for k in range(len(d))] + [("one", 0, 101.0)] + [("ties", k, 100.0 + x) for k, x in enumerate([1, 1, -1, 2, 2, 0, 3, 3])] + [("base", 99, None)]
    got = {r["run"]: r for r in R.paired_tests(spark.createDataFrame(rows, "run string, day int, e double"), "run", ["day"], "e", "base").collect()}
    a = got["a"]
    assert (a["w"], a["w_plus"], a["w_minus"]) == (24, 96, 24)
    z = (24 - 15 * 16 / 4) / math.sqrt(15 * 16 * 31 / 24)
    assert abs(a["w_p"] - math.erfc(abs(z) / math.sqrt(2))) < 1e-12
    assert a["w_significant"]
    mean = sum(d) / 15
    t = mean / math.sqrt(sum((x - mean) ** 2 for x in d) / 14 / 15)
    assert abs(a["t"] - t) < 1e-9
    assert abs(a["t_p"] - 0.049770) < 1e-4  # t = 2.148 at 14 degrees of freedom
    same, one, ties = got["same"], got["one"], got["ties"]
    assert (same["t"], same["t_p"], same["w"], same["w_p"], same["t_significant"], same["w_significant"]) == (None, None, None, None, False, False)
    assert (one["n"], one["t_p"]) == (1, None)
    # ranks 2 2 2 4.5 4.5 6.5 6.5 of seven values, groups of 3, 2 and 2
    assert (ties["w_minus"], ties["w_plus"]) == (2, 26)
    z = (2 - 14) / math.sqrt(7 * 8 * 15 / 24 - (24 + 6 + 6) / 48)
    assert abs(ties["w_p"] - math.erfc(abs(z) / math.sqrt(2))) < 1e-12


def test_conformal_keeps_the_last_finite_residuals(spark):
    rows = [("s", k, float(k) if k % 2 else None) for k in range(1, 121)] + [("s", 121, float("nan")), ("s", 122, float("inf"))]
    got = {r["d"]: r["radius"] for r in R.conformal(spark.createDataFrame(rows, "s string, d int, r double"), "s", "d", "r").collect()}
    odd = list(range(1, 121, 2))
    for day in (2, 60, 105, 121, 122):
        kept = sorted([x for x in odd if x < day][-52:])
        assert got[day] == kept[max(1, min(len(kept), math.ceil((len(kept) + 1) * 0.9))) - 1]
    assert got[1] is None


def test_disagreement_and_gaussian_floors(spark):
    x = spark.createDataFrame([("a", 1, v) for v in (1.0, 2.0, 3.0)] + [("a", 2, v) for v in (0.0, 0.0, 0.0)], "s string, step int, v double")
    got = R.disagreement_summary(x, ["s"], "step", "v").first()
    assert abs(got["max_percent"] - 100 / 3) < 1e-9
    assert abs(got["mean_percent"] - 100 / 6) < 1e-9
    from epispark.functions.helpers import normal_cdf

    one = spark.createDataFrame([(5.0, 5.0, 0.0), (7.0, 5.0, -1.0), (1.0, None, 1.0)], "a double, m double, g double")
    c = [r[0] for r in one.select(R.crps_gaussian(F.col("a"), F.col("m"), F.col("g"), normal_cdf)).collect()]
    assert 0 <= c[0] < 1e-6
    assert abs(c[1] - 2) < 1e-5
    assert c[2] is None


def test_columns_with_few_values_pass_the_gate(spark):
    df = spark.range(4000).select(F.lit(3).alias("one"), (F.col("id") % 49).alias("under"), (F.col("id") % 50).alias("at"), (F.col("id") % 2).cast("double").alias("two"), F.col("id").alias("many"), F.lit(None).cast("int").alias("none"))
    assert gated_columns(df, df.columns) == ["under", "two"]
    assert gated_columns(df.limit(0), df.columns) == []
    box = {r["column"]: (r["lo"], r["q2"], r["hi"]) for r in column_boxes(df, ["under", "two"]).collect()}
    assert box["two"] == (0, 0.5, 1)
    n = {(r["column"], r["bin"]): r["n"] for r in column_histograms(df, ["under", "two"]).collect()}
    assert n["two", 1] == n["two", 10] == 2000
    assert sum(v for (c, _), v in n.items() if c == "under") == 4000


@pytest.mark.parametrize("tracked", [16, 8192])
def test_top_values_are_exact(spark, tracked):
    r = random.Random(6)
    values = [f"v{min(int(r.expovariate(0.02)), 400)}" for _ in range(20000)] + [None] * 500 + ["x y", "x-y"] * 900
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(6)
    counts = {v: values.count(v) for v in set(values) - {None}}
    want = sorted(counts, key=lambda v: (-counts[v], v))[:30]
    got = top_values(df, "v", 30, tracked).orderBy("rank").collect()
    assert [(g["value"], g["n"]) for g in got] == [(v, counts[v]) for v in want]
    flags = top_flags(df, "v", 30, "med")
    assert len(set(flags.columns)) == 31
    assert {f"med_x_y_{want.index(v)}" for v in ("x y", "x-y")} <= set(flags.columns)
    assert flags.agg(F.sum(f"med_x_y_{want.index('x-y')}")).first()[0] == counts["x-y"]
    assert top_values(df.limit(0), "v").count() == 0
    # nearly all values rare: the sketch cannot tell, all are counted
    rare = spark.range(3000).select((F.col("id") % 2990).alias("v"))
    assert [g["value"] for g in top_values(rare, "v", 12, tracked).orderBy("rank").collect()] == [*range(10), 10, 11]


def test_sample_paths_repeat_and_resample_differences(spark):
    rows = [("a", "2024-01-01", [1.0, 3.0, 6.0, 2.0], [5.0, 6.0, 7.0]), ("b", "2024-01-01", [4.0], [1.0]), ("c", "2024-01-01", [1.0, None, 2.0], [1.0]), ("d", "2024-01-01", [1.0, 2.0], [])]
    w = spark.createDataFrame(rows, "s string, as_of string, train array<double>, test array<double>").withColumn("as_of", F.to_date("as_of"))
    y = R.sampled_paths(w, "s", paths=50)
    got = sorted(map(tuple, y.collect()))
    assert got == sorted(map(tuple, R.sampled_paths(w.repartition(3), "s", paths=50).collect()))
    assert len([g for g in got if g[0] == "a"]) == 150
    assert {g[4] for g in got if g[0] == "b"} == {4.0}
    assert {g[4] for g in got if g[0] == "c"} == {2.0}
    first = {g[4] for g in got if g[0] == "a" and g[3] == 1}
    assert first == {4.0, 5.0, 0.0}
    assert got != sorted(map(tuple, R.sampled_paths(w, "s", paths=50, seed=2).collect()))


def test_peak_placement(spark):
    actual, said = [0, 9, 0, 0, 8, 0, 0, 0, 0, 0, 0, 0], [0, 0, 7, 0, 0, 0, 6, 0, 0, 0, 0, 0]
    df = spark.createDataFrame([("s", k, float(a), float(p)) for k, (a, p) in enumerate(zip(actual, said, strict=True))], "s string, d int, a double, p double")
    r = R.peak_placement(df, "s", "d", "a", "p").first()
    assert r["n_peaks"] == 2
    assert abs(r["time_rmse"] - math.sqrt((1 + 4) / 2)) < 1e-9
    assert abs(r["height_rmse"] - math.sqrt((4 + 4) / 2)) < 1e-9


def test_point_scores_and_means_fall_back(spark):
    df = spark.createDataFrame([("s", 3.0, 1.0), ("s", 5.0, 9.0)], "s string, a double, p double")
    assert R.crps_quantiles(df, ["s"], "a", {}, "p").first()["crps"] == 3.0
    with pytest.raises(ValueError, match="forecast"):
        R.crps_quantiles(df, ["s"], "a", {})
    m = spark.createDataFrame([([0.0, -2.0], 7.0), ([None, 3.0], 7.0), ([0.0], None)], "m array<double>, v double")
    assert [r[0] for r in m.select(R.means_or_last(F.col("m"), F.col("v"))).collect()] == [[7.0, 7.0], [0.0, 3.0], [0.0]]
