"""Queries over weekly series: windows, selections, forecasts, scores, pages and stays."""

from __future__ import annotations

from pyspark.sql import functions as F

from epispark.functions import scalars as S
from epispark.operators import aggregates as A
from epispark.operators import series as R
from epispark.operators import text as X
from epispark.plans.records import WEEK
from epispark.plans.registry import query, table
from epispark.session import stored

WK = WEEK.format("o_orderdate")
SERIES = f"s AS (SELECT o_orderpriority AS series, CAST({WK} AS DATE) AS week, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY ALL)"
O = "OVER (PARTITION BY series ORDER BY week"


def series(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("series"), S.week_label(F.col("o_orderdate")).alias("week")).agg(F.count(F.lit(1)).cast("double").alias("v"))


def forecasts(spark, d):
    """The last value as forecast of the next week, with bands, as a prediction table of one run."""
    return R.lagged(series(spark, d), "series", "week", "v", [1]).select("series", "week", F.col("v").alias("actual"), F.col("lag_1").alias("p"), (F.col("lag_1") * 0.5).alias("q_0.05"), (F.col("lag_1") * 0.8).alias("q_0.25"), F.col("lag_1").alias("q_0.5"), (F.col("lag_1") * 1.2).alias("q_0.75"), (F.col("lag_1") * 1.5).alias("q_0.95"))


FC = f"{SERIES}, f AS (SELECT * FROM (SELECT series, week, v AS actual, lag(v) {O}) AS p FROM s) WHERE p IS NOT NULL)"


@query("src2_yearly_weeks", f"WITH {SERIES} SELECT series, week, v, CAST(isoyear(week) AS INTEGER) AS iso_year, CAST(week(week) AS INTEGER) AS iso_week FROM s")
def src2(spark, d):
    return series(spark, d).withColumn("iso_year", S.iso_year(F.col("week")).cast("int")).withColumn("iso_week", S.iso_week(F.col("week")))


@query("wn1_group_minimum", "SELECT l_orderkey, l_linenumber, CAST(min(l_shipdate) OVER (PARTITION BY l_orderkey) AS DATE) AS first_ship FROM lineitem")
def wn1(spark, d):
    from pyspark.sql import Window

    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.to_date(F.min("l_shipdate").over(Window.partitionBy("l_orderkey"))).alias("first_ship"))


@query("wn2_readmissions", "SELECT o_orderkey, gap, CASE WHEN gap <= 14 THEN 1 ELSE 0 END AS readmitted FROM (SELECT o_orderkey, datediff('day', lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderdate) AS gap FROM orders WHERE o_custkey IS NOT NULL)")
def wn2(spark, d):
    return R.readmissions(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_orderkey", "gap", "readmitted")


@query("wn3_forward_fill", "SELECT event_id, coalesce(last_value(CASE WHEN event_id % 3 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0) AS v FROM events")
def wn3(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("v"))
    return R.forward_filled(e, ["user_id"], "event_id", ["v"]).select("event_id", "v")


@query("wn4_lags", f"WITH {SERIES} SELECT * FROM (SELECT series, week, v, " + ", ".join(f"lag(v, {k}) {O}) AS lag_{k}" for k in (1, 2, 3, 4, 12, 26, 52)) + " FROM s) WHERE lag_52 IS NOT NULL")
def wn4(spark, d):
    return R.lagged(series(spark, d), "series", "week", "v", [1, 2, 3, 4, 12, 26, 52])


@query("wn5_input_windows", f"WITH {SERIES} SELECT series, week, v, array_to_string(a, ',') AS inputs FROM (SELECT series, week, v, list(CAST(v AS BIGINT)) {O} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS a FROM s) WHERE len(a) = 6")
def wn5(spark, d):
    return R.input_windows(series(spark, d), "series", "week", "v", 6).withColumn("inputs", F.array_join(F.col("inputs").cast("array<bigint>").cast("array<string>"), ","))


@query("wn6_rolling_origins", f"WITH {SERIES}, r AS (SELECT *, row_number() {O}) - 1 AS i, count(*) OVER (PARTITION BY series) AS n, lag(week) {O}) AS as_of, list(CAST(v AS BIGINT)) {O} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS a, list(CAST(v AS BIGINT)) {O} ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS b FROM s) SELECT series, as_of, week, array_to_string(a, ',') AS train, array_to_string(b, ',') AS test FROM r WHERE i >= 20 AND i < n - 4 + 1 AND (i - 20) % 4 = 0")
def wn6(spark, d):
    text = lambda c: F.array_join(F.col(c).cast("array<bigint>").cast("array<string>"), ",")
    return R.rolling_origins(series(spark, d), "series", "week", "v", 20, 4, 4).withColumn("train", text("train")).withColumn("test", text("test"))


@query("wn8_trend", f"WITH {SERIES}, x AS (SELECT *, lag(v) {O}) AS p, coalesce(lag(v, 3) {O}), first(v) {O} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) AS b FROM s), y AS (SELECT *, sum(CASE WHEN v > p THEN 0 ELSE 1 END) {O}) AS isle FROM x) SELECT series, week, v, (v - b) / greatest(1, b) AS growth, v - p AS slope, (v - p) / greatest(1, p) AS pct_change, CAST(least(7, row_number() OVER (PARTITION BY series, isle ORDER BY week) - 1) AS INTEGER) AS run FROM y")
def wn8(spark, d):
    return R.trend(series(spark, d), "series", "week", "v")


@query("wn9_volatility", f"WITH {SERIES}, x AS (SELECT *, abs(v - lag(v) {O})) / greatest(1, lag(v) {O})) AS c FROM s) SELECT series, week, v, coalesce(greatest(0.05, least(0.5, quantile_cont(c, 0.5) {O} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))), 0.15) AS volatility FROM x")
def wn9(spark, d):
    return R.volatility(series(spark, d), "series", "week", "v")


@query("wn10_running_scores", f"WITH {FC} SELECT series, week, avg(abs(actual - p)) {O} ROWS UNBOUNDED PRECEDING) AS mae_so_far, sqrt(avg((actual - p) * (actual - p)) {O} ROWS UNBOUNDED PRECEDING)) AS rmse_so_far FROM f")
def wn10(spark, d):
    return R.running_scores(forecasts(spark, d), "series", "week", "actual", "p").select("series", "week", "mae_so_far", "rmse_so_far")


PEAK = f"t AS (SELECT series, quantile_cont(m, 0.9) AS threshold FROM (SELECT series, max(v) {O} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS m FROM s) GROUP BY 1)"


@query("wn11_peak_threshold", f"WITH {SERIES}, {PEAK} SELECT * FROM t")
def wn11(spark, d):
    return R.peak_threshold(series(spark, d), "series", "week", "v")


@query("wn12_sudden_drops", f"WITH {SERIES}, x AS (SELECT *, CASE WHEN lag(v) {O}) > 0 THEN (v - lag(v) {O})) / lag(v) {O}) END AS c FROM s) SELECT series, week, v, CASE WHEN avg(c) {O} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) <= -0.3 THEN 1 ELSE 0 END AS drop FROM x")
def wn12(spark, d):
    return R.sudden_drops(series(spark, d), "series", "week", "v")


@query("wn13_tuned_step", f"WITH {FC}, e AS (SELECT series, week, abs(actual - p) AS e FROM f), w AS (SELECT *, first(e) {O} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS a FROM e) SELECT series, week, e, CAST(CASE WHEN e > a THEN 1.1 WHEN e < a THEN 0.9 ELSE 1.0 END AS DOUBLE) AS factor FROM w")
def wn13(spark, d):
    e = forecasts(spark, d).select("series", "week", F.abs(F.col("actual") - F.col("p")).alias("e"))
    return R.tuned_step(e, "series", "week", "e")


@query("wn14_latest_forecast", "SELECT o_custkey, CAST(d AS DATE) AS day, o_orderkey FROM (SELECT o_custkey, date_trunc('month', o_orderdate) AS d, o_orderkey, row_number() OVER (PARTITION BY o_custkey, date_trunc('month', o_orderdate) ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def wn14(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.trunc("o_orderdate", "MM").alias("day"), "o_orderkey")
    return R.latest_per_date(o, ["o_custkey", "day"], "o_orderkey")


#: every fifth residual is null and every seventh not a number: the buffer counts the others
HOLED = f"{FC}, h AS (SELECT series, week, CASE WHEN day(week) % 5 = 0 THEN NULL WHEN day(week) % 7 = 0 THEN 'nan'::DOUBLE ELSE actual - p END AS r FROM f), g AS (SELECT *, sum(CASE WHEN isfinite(r) THEN 1 ELSE 0 END) {O} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM h), a AS (SELECT series, k, list_sort(list(abs(r)) {O} ROWS BETWEEN 51 PRECEDING AND CURRENT ROW)) AS b FROM g WHERE isfinite(r)), w AS (SELECT g.*, b FROM g LEFT JOIN a ON a.series = g.series AND a.k = g.k - CASE WHEN isfinite(r) THEN 1 ELSE 0 END)"


@query("wn15_conformal", f"WITH {HOLED} SELECT series, week, CASE WHEN len(b) > 0 THEN b[CAST(greatest(1, least(len(b), ceil((len(b) + 1) * 0.9))) AS INTEGER)] END AS radius FROM w")
def wn15(spark, d):
    day = F.dayofmonth("week")
    r = forecasts(spark, d).select("series", "week", F.when(day % 5 == 0, None).when(day % 7 == 0, float("nan")).otherwise(F.col("actual") - F.col("p")).alias("r"))
    return R.conformal(r, "series", "week", "r").drop("r")


@query("tk1_top_categories", "SELECT p_name, persons FROM (SELECT p_name, count(DISTINCT p_brand || p_size) AS persons FROM part WHERE p_name IS NOT NULL GROUP BY 1) ORDER BY persons DESC, p_name LIMIT 20")
def tk1(spark, d):
    return R.top_categories(table(spark, d, "part").withColumn("b", F.concat("p_brand", F.col("p_size").cast("string"))), "p_name", "b", 20)


@query("tk2_top_residual", "SELECT event_type, count(DISTINCT user_id) AS persons FROM events WHERE event_type NOT IN ('view') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4")
def tk2(spark, d):
    return R.top_categories(table(spark, d, "events"), "event_type", "user_id", 4, ["view"])


@query("tk4_top_values", "SELECT p_name, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def tk4(spark, d):
    return table(spark, d, "part").groupBy("p_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p_name").limit(10)


TOP = "SELECT p_name AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_name) AS rank FROM part WHERE p_name IS NOT NULL GROUP BY 1"


@query("tk4_top_values_counted", f"SELECT v AS value, n, CAST(rank AS INTEGER) AS rank FROM ({TOP}) WHERE rank <= 30")
def tk4b(spark, d):
    return A.top_values(table(spark, d, "part"), "p_name", 30)


@query("tk4_top_flags", f"WITH t AS ({TOP}), x AS (SELECT p_brand, v, rank FROM part JOIN t ON p_name = v WHERE rank <= 30), k AS (SELECT * FROM (SELECT DISTINCT p_brand FROM part), (SELECT v, rank FROM t WHERE rank <= 30)) SELECT k.p_brand, 'name_' || regexp_replace(k.v, '[^a-zA-Z0-9_]', '_', 'g') || '_' || (k.rank - 1) AS flag, count(x.v) AS n FROM k LEFT JOIN x ON x.p_brand = k.p_brand AND x.v = k.v GROUP BY ALL")
def tk4c(spark, d):
    flagged = A.top_flags(table(spark, d, "part").select("p_brand", "p_name"), "p_name", 30, "name")
    names = [c for c in flagged.columns if c.startswith("name_")]
    sums = flagged.groupBy("p_brand").agg(*[F.sum(c).alias(c) for c in names])
    return sums.unpivot(["p_brand"], names, "flag", "n")


@query("tk5_spaced_dates", "WITH x AS (SELECT CAST(o_orderdate AS DATE) AS day, row_number() OVER (ORDER BY CAST(o_orderdate AS DATE)) - 1 AS i FROM (SELECT DISTINCT o_orderdate FROM orders)), n AS (SELECT count(*) AS n FROM x) SELECT day FROM x, n WHERE i IN (SELECT CAST(floor(k * (n - 1) / 11.0) AS BIGINT) FROM (SELECT unnest(generate_series(0, 11)) AS k), n)")
def tk5(spark, d):
    return R.spaced(table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")), "day", 12)


@query("tk6_validation_tail", f"WITH {SERIES} SELECT series, week, v, CASE WHEN row_number() OVER (PARTITION BY series ORDER BY week DESC) <= greatest(1, floor(count(*) OVER (PARTITION BY series) * 0.15)) THEN 'validation' ELSE 'train' END AS split FROM s")
def tk6(spark, d):
    return R.tail_split(series(spark, d), "series", "week", 0.15)


@query("tk7_stratified_split", "WITH x AS (SELECT DISTINCT doc_id, toxic, (doc_id * 2654435761) % 4294967296 AS h FROM labels), r AS (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY h, doc_id) AS i, ceil(count(*) OVER (PARTITION BY toxic) * 0.15) AS a, count(*) OVER (PARTITION BY toxic) AS n FROM x) SELECT doc_id, toxic, CASE WHEN i <= a THEN 'test' WHEN i <= a + ceil((n - a) * (0.15 / 0.85)) THEN 'validation' ELSE 'train' END AS split FROM r")
def tk7(spark, d):
    return R.stratified_split(table(spark, d, "labels"), "doc_id", "toxic")


# scores


@query("mt1_scores", f"WITH {FC}, e AS (SELECT series, actual AS a, p, abs(actual - p) AS x FROM f) SELECT series, count(*) AS n, avg(x) AS mae, sqrt(avg(x * x)) AS rmse, avg(x / greatest(1e-6, abs(a))) AS mape, avg(x / greatest(1e-9, (abs(a) + abs(p)) / 2)) AS smape, quantile_cont(x, 0.5) AS medae, avg(p - a) AS bias, stddev_samp(a - p) AS residual_std FROM e GROUP BY 1")
def mt1(spark, d):
    return R.scores(forecasts(spark, d), ["series"], "actual", "p")


@query("mt4_coverage", f"WITH {FC} SELECT series, avg(CASE WHEN actual BETWEEN p * 0.5 AND p * 1.5 THEN 1.0 ELSE 0.0 END) AS coverage FROM f GROUP BY 1")
def mt4(spark, d):
    return R.coverage(forecasts(spark, d), ["series"], "actual", 0.9)


@query("mt5_sharpness", f"WITH {FC} SELECT series, avg(p * 1.5 - p * 0.5) AS sharpness FROM f GROUP BY 1")
def mt5(spark, d):
    return forecasts(spark, d).groupBy("series").agg(F.avg(F.col("`q_0.95`") - F.col("`q_0.05`")).alias("sharpness"))


QS = {0.05: 0.5, 0.25: 0.8, 0.5: 1.0, 0.75: 1.2, 0.95: 1.5}


@query("mt6_crps_quantiles", f"WITH {FC} SELECT series, 2 * (" + " + ".join(f"avg(greatest({q} * (actual - p * {m}), ({q} - 1) * (actual - p * {m})))" for q, m in QS.items()) + ") / 5 AS crps FROM f GROUP BY 1")
def mt6(spark, d):
    return R.crps_quantiles(forecasts(spark, d), ["series"], "actual", {q: f"q_{q:g}" for q in QS})


@query("mt6_crps_point", f"WITH {FC} SELECT series, avg(abs(actual - p)) AS crps FROM f GROUP BY 1")
def mt6b(spark, d):
    return R.crps_quantiles(forecasts(spark, d), ["series"], "actual", {}, "p")


@query("mt7_crps_samples", "WITH g AS (SELECT o_custkey, list(o_totalprice / 1000) AS xs FROM orders GROUP BY 1) SELECT o_custkey, round((SELECT avg(abs(x - 150)) FROM (SELECT unnest(xs) AS x)) - 0.5 * (SELECT avg(abs(x - y)) FROM (SELECT unnest(xs) AS x), (SELECT unnest(xs) AS y)), 3) AS crps FROM g")
def mt7(spark, d):
    samples = table(spark, d, "orders").select("o_custkey", (F.col("o_totalprice") / 1000).alias("x"))
    return R.crps_rows(samples, "o_custkey", F.lit(150.0), "x").withColumn("crps", F.round("crps", 3))


#: the normal distribution function by its series of positive terms; beyond 8 it is 0 or 1
CDF = "CASE WHEN abs(z) > 8 THEN CASE WHEN z > 0 THEN 1.0 ELSE 0.0 END ELSE 0.5 + sign(z) * exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 150), lambda n: exp((2 * n + 1) * ln(greatest(abs(z), 1e-300)) + n * ln(2) + lgamma(n + 1) - lgamma(2 * n + 2)))) END"


@query("mt8_crps_gaussian", f"WITH {FC}, x AS (SELECT series, greatest(0.5, sqrt(p)) AS g, (actual - p) / greatest(0.5, sqrt(p)) AS z FROM f) SELECT series, avg(g * (z * (2 * {CDF} - 1) + 2 * exp(-z * z / 2) / sqrt(2 * pi()) - 1 / sqrt(pi()))) AS crps FROM x GROUP BY 1")
def mt8(spark, d):
    from epispark.functions.helpers import normal_cdf

    f = forecasts(spark, d).withColumn("sigma", F.greatest(F.lit(0.5), F.sqrt("p")))
    return f.withColumn("c", R.crps_gaussian(F.col("actual"), F.col("p"), F.col("sigma"), normal_cdf)).groupBy("series").agg(F.avg("c").alias("crps"))


@query("mt8_crps_counts", f"WITH {FC}, y AS (SELECT series, actual, p, CASE WHEN day(week) % 9 = 0 THEN 0 ELSE sqrt(p * (1 + p / 8)) END AS g FROM f), x AS (SELECT series, greatest(1e-6, g) AS g, (actual - p) / greatest(1e-6, g) AS z FROM y) SELECT series, avg(greatest(0, g * (z * (2 * {CDF} - 1) + 2 * exp(-z * z / 2) / sqrt(2 * pi()) - 1 / sqrt(pi())))) AS crps FROM x GROUP BY 1")
def mt8b(spark, d):
    from epispark.functions.helpers import normal_cdf

    sigma = F.when(F.dayofmonth("week") % 9 == 0, 0.0).otherwise(R.count_sigma(F.col("p"), F.lit(8.0)))
    score = R.crps_gaussian(F.col("actual"), F.col("p"), F.col("sigma"), normal_cdf)
    return forecasts(spark, d).withColumn("sigma", sigma).withColumn("c", score).groupBy("series").agg(F.avg("c").alias("crps"))


@query("mt9_peak_mae", f"WITH {FC}, t AS (SELECT series, quantile_cont(m, 0.9) AS threshold FROM (SELECT series, max(actual) {O} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS m FROM f) GROUP BY 1) SELECT series, count(*) AS n_peaks, avg(abs(actual - p)) AS peak_mae FROM f JOIN t USING (series) WHERE actual >= threshold GROUP BY 1")
def mt9(spark, d):
    return R.peak_errors(forecasts(spark, d), "series", "week", "actual", "p")


@query("mt10_peak_recall", f"WITH {FC}, r AS (SELECT series, row_number() {O}) AS i, row_number() OVER (PARTITION BY series ORDER BY actual DESC, week) AS ra, row_number() OVER (PARTITION BY series ORDER BY p DESC, week) AS rp, ceil(count(*) OVER (PARTITION BY series) * 0.1) AS n FROM f) SELECT series, count(*) AS n_peaks, avg(CASE WHEN EXISTS (SELECT 1 FROM r b WHERE b.series = a.series AND b.rp <= b.n AND abs(b.i - a.i) <= 2) THEN 1.0 ELSE 0.0 END) AS recall FROM r a WHERE ra <= n GROUP BY 1")
def mt10(spark, d):
    return R.peak_recall(forecasts(spark, d), "series", "week", "actual", "p")


@query("mt10_peak_placement", f"WITH {FC}, r AS (SELECT series, actual, p, row_number() {O}) AS i, row_number() OVER (PARTITION BY series ORDER BY actual DESC, week) AS ra, row_number() OVER (PARTITION BY series ORDER BY p DESC, week) AS rp, greatest(1, ceil(count(*) OVER (PARTITION BY series) * 0.1)) AS n FROM f), a AS (SELECT series, i, actual, row_number() OVER (PARTITION BY series ORDER BY i) AS k FROM r WHERE ra <= n), b AS (SELECT series, i AS j, p, row_number() OVER (PARTITION BY series ORDER BY i) AS k FROM r WHERE rp <= n) SELECT series, count(*) AS n_peaks, sqrt(avg((i - j) * (i - j))) AS time_rmse, sqrt(avg((actual - p) * (actual - p))) AS height_rmse FROM a JOIN b USING (series, k) GROUP BY 1")
def mt10b(spark, d):
    return R.peak_placement(forecasts(spark, d), "series", "week", "actual", "p")


@query("mt11_coverage_table", f"WITH {FC} SELECT CAST(0.9 AS DOUBLE) AS expected, avg(CASE WHEN actual BETWEEN p * 0.5 AND p * 1.5 THEN 1.0 ELSE 0.0 END) AS observed FROM f UNION ALL SELECT 0.5, avg(CASE WHEN actual BETWEEN p * 0.8 AND p * 1.2 THEN 1.0 ELSE 0.0 END) FROM f")
def mt11(spark, d):
    return R.coverage_table(forecasts(spark, d), "actual", [("`q_0.05`", "`q_0.95`", 0.9), ("`q_0.25`", "`q_0.75`", 0.5)])


PATHS = "SELECT event_type AS series, CAST(ts AS DATE) AS step, value FROM events WHERE value IS NOT NULL"


def paths(spark, d):
    return table(spark, d, "events").where("value is not null").select(F.col("event_type").alias("series"), F.to_date("ts").alias("step"), "value")


@query("mt12_disagreement", f"WITH x AS ({PATHS}), m AS (SELECT series, step, quantile_cont(value, 0.5) AS median FROM x GROUP BY ALL) SELECT series, step, quantile_cont(abs(value - median), 0.5) AS mad, any_value(median) AS median, 100 * quantile_cont(abs(value - median), 0.5) / greatest(1, abs(any_value(median)) + 1) AS percent FROM x JOIN m USING (series, step) GROUP BY ALL")
def mt12(spark, d):
    return R.disagreement(paths(spark, d), ["series", "step"], "value")


@query("mt12_disagreement_summary", f"WITH x AS ({PATHS}), m AS (SELECT series, step, quantile_cont(value, 0.5) AS median FROM x GROUP BY ALL), y AS (SELECT series, step, 100 * quantile_cont(abs(value - median), 0.5) / greatest(1, abs(any_value(median)) + 1) AS percent FROM x JOIN m USING (series, step) GROUP BY ALL) SELECT series, count(*) AS n_steps, avg(percent) AS mean_percent, max(percent) AS max_percent FROM y GROUP BY 1")
def mt12b(spark, d):
    return R.disagreement_summary(paths(spark, d), ["series"], "step", "value")


@query("mt13_exceedance", f"SELECT series, avg(CASE WHEN value > 25 THEN 1.0 ELSE 0.0 END) AS p_over_25, avg(CASE WHEN value > 75 THEN 1.0 ELSE 0.0 END) AS p_over_75 FROM ({PATHS}) GROUP BY 1")
def mt13(spark, d):
    return R.exceedance(paths(spark, d), ["series"], "value", [25, 75])


RUNS = f"{FC}, runs AS (SELECT 'last' AS run, series, week, abs(actual - p) AS e FROM f UNION ALL SELECT 'higher', series, week, abs(actual - p * 1.1) FROM f UNION ALL SELECT 'lower', series, week, abs(actual - p * 0.9) FROM f)"


@query("mt15_paired_tests", f"WITH {RUNS}, d AS (SELECT a.run, a.e - b.e AS d FROM runs a JOIN runs b USING (series, week) WHERE b.run = 'last' AND a.run <> 'last'), k AS (SELECT run, d, rank() OVER (PARTITION BY run ORDER BY abs(d)) + (count(*) OVER (PARTITION BY run, abs(d)) - 1) / 2 AS r FROM d WHERE d <> 0), w AS (SELECT run, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus FROM k GROUP BY 1) SELECT run, count(*) AS n, avg(d) AS mean_diff, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t, any_value(w_plus) AS w_plus, any_value(w_minus) AS w_minus, least(any_value(w_plus), any_value(w_minus)) AS w FROM d JOIN w USING (run) GROUP BY 1")
def mt15(spark, d):
    f = forecasts(spark, d)
    runs = None
    for name, m in (("last", 1.0), ("higher", 1.1), ("lower", 0.9)):
        p = F.col("p") if m == 1.0 else F.col("p") * m
        one = f.select(F.lit(name).alias("run"), "series", "week", F.abs(F.col("actual") - p).alias("e"))
        runs = one if runs is None else runs.unionByName(one)
    return R.paired_tests(runs, "run", ["series", "week"], "e", "last").select("run", "n", "mean_diff", "t", "w_plus", "w_minus", "w")


# Student's tails of whole degrees of freedom v by finite sums over the angle a, normal ones by CDF
EVEN = "sin(a) * list_sum(list_transform(range(0, v // 2), lambda k: exp(lgamma(2 * k + 1) - 2 * k * ln(2) - 2 * lgamma(k + 1) + 2 * k * ln(cos(a)))))"
ODD = "2 / pi() * (a + sin(a) * coalesce(list_sum(list_transform(range(0, (v - 1) // 2), lambda k: exp(2 * k * ln(2) + 2 * lgamma(k + 1) - lgamma(2 * k + 2) + (2 * k + 1) * ln(cos(a))))), 0))"


@query("mt15_significance", f"WITH {RUNS}, d AS (SELECT a.run || ' ' || a.series AS run, a.e - b.e AS d FROM runs a JOIN runs b USING (series, week) WHERE b.run = 'last' AND a.run <> 'last' AND week < DATE '1996-01-01'), k AS (SELECT run, d, rank() OVER (PARTITION BY run ORDER BY abs(d)) + (count(*) OVER (PARTITION BY run, abs(d)) - 1) / 2 AS r, count(*) OVER (PARTITION BY run, abs(d)) AS c FROM d WHERE d <> 0), w AS (SELECT run, least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS w, count(*) AS n, sum(c * c - 1) AS ties FROM k GROUP BY 1), t AS (SELECT run, count(*) AS n, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t FROM d GROUP BY 1), x AS (SELECT t.run, t.n, t, w, t.n - 1 AS v, atan(abs(t) / sqrt(t.n - 1)) AS a, -abs((w - w.n * (w.n + 1) / 4) / sqrt(w.n * (w.n + 1) * (2 * w.n + 1) / 24 - ties / 48)) AS z FROM t JOIN w USING (run)), p AS (SELECT run, n, t, w, 1 - CASE WHEN v % 2 = 0 THEN {EVEN} ELSE {ODD} END AS t_p, 2 * {CDF} AS w_p FROM x) SELECT *, t_p < 0.05 AS t_significant, w_p < 0.05 AS w_significant FROM p")
def mt15b(spark, d):
    f = forecasts(spark, d).where("week < '1996-01-01'")
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("run"), F.lit(m).alias("m")) for name, m in (("last", 1.0), ("higher", 1.1), ("lower", 0.9))])).alias("x")
    runs = f.select("series", "week", "actual", "p", each).select("series", "week", F.when(F.col("x.run") == "last", "last").otherwise(F.concat_ws(" ", "x.run", "series")).alias("run"), F.abs(F.col("actual") - F.when(F.col("x.m") == 1, F.col("p")).otherwise(F.col("p") * F.col("x.m"))).alias("e"))
    return R.paired_tests(runs, "run", ["series", "week"], "e", "last").drop("mean_diff", "w_plus", "w_minus")


# forecasts


@query("fc1_persistence", f"WITH {SERIES}, l AS (SELECT series, arg_max(v, week) AS v FROM s GROUP BY 1) SELECT series, v, CAST(step AS INTEGER) AS step, CAST(level AS DOUBLE) AS level, greatest(0, v + sign(level - 0.5) * 0.15 * v * abs(level - 0.5) / 0.45) AS forecast FROM l, (SELECT unnest(generate_series(1, 4)) AS step), (SELECT unnest([0.05, 0.5, 0.95]) AS level)")
def fc1(spark, d):
    last = series(spark, d).groupBy("series").agg(F.max_by("v", "week").alias("v"))
    return R.persistence(last, "v", 4, [0.05, 0.5, 0.95])


@query("fc2_gaussian_bands", f"WITH {SERIES}, w AS (SELECT series, week, v, stddev_pop(v) {O} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS g FROM s) SELECT series, week, greatest(0, v - 1.6448536269514722 * g) AS q05, greatest(0, v) AS q50, greatest(0, v + 1.6448536269514722 * g) AS q95 FROM w")
def fc2(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("series").orderBy("week").rowsBetween(-11, 0)
    z = {"q05": -1.6448536269514722, "q50": 0.0, "q95": 1.6448536269514722}
    return series(spark, d).select("series", "week", R.gaussian_bands(F.col("v"), F.stddev_pop("v").over(w), z).alias("b")).select("series", "week", "b.*")


STEP = "SELECT series, week, i + 1, growth, vol, CASE WHEN abs(raw - cur) > jump THEN cur + sign(raw - cur) * jump ELSE raw END FROM (SELECT *, greatest(0, cur * (1 + growth * pow(0.85, i))) AS raw, greatest(2 * vol * greatest(1, cur), 0.1) AS jump FROM r WHERE i < 4)"


@query("fc3_damped_growth", f"WITH RECURSIVE {SERIES}, x AS (SELECT *, abs(v - lag(v) {O})) / greatest(1, lag(v) {O})) AS c, (v - coalesce(lag(v, 3) {O}), first(v) {O} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))) / greatest(1, coalesce(lag(v, 3) {O}), first(v) {O} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))) AS growth FROM s), y AS (SELECT series, week, v, growth, coalesce(greatest(0.05, least(0.5, quantile_cont(c, 0.5) {O} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))), 0.15) AS vol FROM x), r(series, week, i, growth, vol, cur) AS (SELECT series, week, 0, growth, vol, v FROM y UNION ALL {STEP}) SELECT series, week, CAST(i AS INTEGER) AS step, greatest(0, cur - greatest(0.5 * vol, 0.05) * greatest(1, sqrt(cur))) AS q05, cur AS q50, cur + greatest(0.5 * vol, 0.05) * greatest(1, sqrt(cur)) AS q95 FROM r WHERE i > 0")
def fc3(spark, d):
    s = R.volatility(R.trend(series(spark, d), "series", "week", "v"), "series", "week", "v")
    out = s.select("series", "week", F.explode(R.damped_growth(F.col("v"), F.col("growth"), F.col("volatility"), 4)).alias("f"))
    return out.select("series", "week", "f.*")


@query("fc4_event_scores", "WITH x AS (SELECT event_id, value / 50 - 1 AS pct, event_id % 5 AS run, CASE WHEN event_id % 2 = 0 THEN 'School closed' ELSE 'in session' END AS school, value / 3 AS t FROM events WHERE value IS NOT NULL), a AS (SELECT *, greatest(-0.5, least(0.5, 0.6 * pct)) + CASE WHEN contains(lower(school), 'close') THEN -0.2 ELSE 0.1 END + CASE WHEN t >= 25 THEN 0.15 WHEN t <= 15 THEN -0.15 ELSE 0 END AS b FROM x), c AS (SELECT event_id, greatest(-1, least(1, b + CASE WHEN run >= 3 AND b > 0 THEN 0.1 ELSE 0 END)) AS impact FROM a) SELECT event_id, impact, 0.5 + least(0.3, 0.4 * abs(impact)) AS confidence, CASE WHEN impact > 0.4 THEN 'rising' WHEN impact < -0.4 THEN 'falling' ELSE '' END AS note FROM c")
def fc4(spark, d):
    e = table(spark, d, "events").where("value is not null")
    school = F.when(F.col("event_id") % 2 == 0, "School closed").otherwise("in session")
    return e.select("event_id", R.event_score(F.col("value") / 50 - 1, F.col("event_id") % 5, school, F.col("value") / 3).alias("s")).select("event_id", "s.*")


COUNTS = f"WITH {SERIES}, x AS (SELECT *, abs(v - lag(v) {O})) / greatest(1, lag(v) {O})) AS c FROM s), y AS (SELECT series, week, v AS m, greatest(0.25, least(3, (0.5 + 2.5 * 0.3) * (0.5 + 2 * coalesce(greatest(0.05, least(0.5, quantile_cont(c, 0.5) {O} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))), 0.15)))) AS d FROM x), k AS (SELECT series, week, m, 1 / (d - 1) AS n, d, unnest(range(0, CAST(floor(m + 12 * sqrt(CASE WHEN d <= 1 THEN m ELSE m + (d - 1) * m * m END)) AS BIGINT) + 30)) AS k FROM y), p AS (SELECT series, week, k, sum(CASE WHEN d <= 1 THEN exp(k * ln(m) - m - lgamma(k + 1)) ELSE exp(lgamma(n + k) - lgamma(n) - lgamma(k + 1) + n * ln(n / (n + m)) + k * ln(m / (n + m))) END) OVER (PARTITION BY series, week ORDER BY k) AS f FROM k)"


@query("fc5_count_quantiles", f"{COUNTS} SELECT series, week, " + ", ".join(f"CAST(coalesce(min(k) FILTER (f >= {q}), max(k)) AS DOUBLE) AS q{round(q * 100):02d}" for q in (0.05, 0.5, 0.95)) + " FROM p GROUP BY ALL")
def fc5(spark, d):
    from epispark.functions.helpers import count_quantiles

    s = R.volatility(series(spark, d), "series", "week", "v")
    q = count_quantiles(F.col("v"), R.count_dispersion(F.lit(0.3), F.col("volatility")))
    return s.select("series", "week", q.alias("q")).select("series", "week", F.col("q")[0].alias("q05"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q95"))


@query("fc5_means_or_last", f"WITH {SERIES}, x AS (SELECT series, week, v, list(CASE WHEN day(week) > 20 THEN 0 ELSE v - 20 END) {O} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS b FROM s), y AS (SELECT *, list_transform(b, lambda x: greatest(0, x)) AS m FROM x) SELECT series, week, CAST(k AS INTEGER) AS step, CASE WHEN list_max(m) > 0 THEN m[k] ELSE v END AS mean FROM y, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE k <= len(m)")
def fc5b(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("series").orderBy("week").rowsBetween(-3, 0)
    b = F.collect_list(F.when(F.dayofmonth("week") > 20, 0.0).otherwise(F.col("v") - 20)).over(w)
    m = series(spark, d).withColumn("b", b).select("series", "week", F.posexplode(R.means_or_last(F.col("b"), F.col("v"))).alias("k", "mean"))
    return m.select("series", "week", (F.col("k") + 1).alias("step"), "mean")


@query("fc6_uncertainty", "SELECT event_id, CAST(i AS INTEGER) AS step, least(0.95, greatest(0.1, least(0.9, 3 * (value / 300))) + 0.02 * i) AS u FROM events, (SELECT unnest(generate_series(0, 3)) AS i) WHERE value IS NOT NULL")
def fc6(spark, d):
    return table(spark, d, "events").where("value is not null").select("event_id", F.posexplode(R.uncertainty(F.col("value") / 300, 4)).alias("step", "u"))


@query("fc7_compartments", "WITH RECURSIVE l AS (SELECT o_custkey, count(*) AS last FROM orders GROUP BY 1), r(o_custkey, last, k, s, e, i) AS (SELECT o_custkey, last, 0, 999980.0::DOUBLE, 10.0::DOUBLE, 10.0::DOUBLE FROM l UNION ALL SELECT o_custkey, last, k + 1, greatest(0, s - 0.4 * s * i / 1000000.0), greatest(0, e + 0.4 * s * i / 1000000.0 - 0.2 * e), greatest(0, i + 0.2 * e - 0.1 * i) FROM r WHERE k < 6), f AS (SELECT o_custkey, i AS i1 FROM r WHERE k = 1) SELECT o_custkey, CAST(k AS INTEGER) AS step, i * last / (i1 + 1e-6) AS infected FROM r JOIN f USING (o_custkey) WHERE k > 0")
def fc7(spark, d):
    last = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("last"))
    out = last.select("o_custkey", F.posexplode(R.compartments(F.col("last"), F.lit(0.4), F.lit(0.2), F.lit(0.1), 6)).alias("k", "infected"))
    return out.select("o_custkey", (F.col("k") + 1).alias("step"), "infected")


GRID_SEARCH = f"WITH RECURSIVE {SERIES}, x AS (SELECT series, week, list(v) {O} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS a FROM s), l AS (SELECT series, arg_max(a, week) AS a FROM x WHERE len(a) = 24 GROUP BY 1), g AS (SELECT b * 0.1::DOUBLE AS beta, c * 0.1::DOUBLE AS sigma, d * 0.1::DOUBLE AS gamma FROM (SELECT unnest(range(1, 6)) AS b), (SELECT unnest(range(1, 4)) AS c), (SELECT unnest(range(1, 4)) AS d)), r(beta, sigma, gamma, k, su, e, i) AS (SELECT beta, sigma, gamma, 0, 999980.0::DOUBLE, 10.0::DOUBLE, 10.0::DOUBLE FROM g UNION ALL SELECT beta, sigma, gamma, k + 1, greatest(0, su - beta * su * i / 1000000.0), greatest(0, e + beta * su * i / 1000000.0 - sigma * e), greatest(0, i + sigma * e - gamma * i) FROM r WHERE k < 24), f AS (SELECT beta, sigma, gamma, i AS first FROM r WHERE k = 1), t AS (SELECT series, beta, sigma, gamma, avg(abs(a[k] - i * a[1] / (first + 1e-6)) / greatest(1e-9, (abs(a[k]) + abs(i * a[1] / (first + 1e-6))) / 2)) AS loss FROM l, r JOIN f USING (beta, sigma, gamma) WHERE k > 0 GROUP BY ALL)"


@query("fc8_grid_search", f"{GRID_SEARCH}, m AS (SELECT series, min({{'loss': loss, 'beta': beta, 'sigma': sigma, 'gamma': gamma}}) AS m FROM t GROUP BY 1) SELECT series, m.loss AS loss, m.beta AS beta, m.sigma AS sigma, m.gamma AS gamma FROM m")
def fc8(spark, d):
    grid = spark.range(1, 6).select((F.col("id") * 0.1).alias("beta")).crossJoin(spark.range(1, 4).select((F.col("id") * 0.1).alias("sigma"))).crossJoin(spark.range(1, 4).select((F.col("id") * 0.1).alias("gamma")))
    w = R.input_windows(series(spark, d), "series", "week", "v", 24).groupBy("series").agg(F.max_by("inputs", "week").alias("actual"))
    return R.grid_searched(w, grid, "series", "actual")


@query("fc9_path_quantiles", f"SELECT series, step, quantile_cont(value, 0.05) AS q05, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.8) AS q80, quantile_cont(value, 0.95) AS q95 FROM ({PATHS}) GROUP BY ALL")
def fc9(spark, d):
    return R.path_quantiles(paths(spark, d), ["series", "step"], "value")


@query("fc10_backtest_persistence", f"WITH {SERIES}, r AS (SELECT *, row_number() {O}) - 1 AS i, count(*) OVER (PARTITION BY series) AS n, lag(week) {O}) AS as_of, lag(v) {O}) AS p, list(v) {O} ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS b FROM s) SELECT series, as_of, CAST(k AS INTEGER) AS step, p AS prediction, b[k] AS actual FROM r, (SELECT unnest([1, 2]) AS k) WHERE i >= 60 AND i < n - 2 + 1 AND (i - 60) % 8 = 0")
def fc10(spark, d):
    return R.backtest_last(R.rolling_origins(series(spark, d), "series", "week", "v", 60, 2, 8), "series")


def determinant(m: list[list[str]]) -> str:
    """Of a square matrix of SQL expressions, by its first row."""
    if len(m) == 1:
        return m[0][0]
    return "(" + " ".join(f"{'+-'[j % 2]} {m[0][j]} * {determinant([r[:j] + r[j + 1 :] for r in m[1:]])}" for j in range(len(m))) + ")"


# least squares on the lags 1, 2 and 4 and a constant: normal equations of each window, by Cramer's rule
GRAM = [[f"s{min(i, j)}{max(i, j)}" for j in range(4)] for i in range(4)]
WEIGHTS = ", ".join(f"{determinant([[f't{i}' if j == k else GRAM[i][j] for j in range(4)] for i in range(4)])} / {determinant(GRAM)} AS w{k}" for k in range(4))
LAGS = f"WITH {SERIES}, r AS (SELECT *, row_number() {O}) - 1 AS i, count(*) OVER (PARTITION BY series) AS n, lag(week) {O}) AS as_of, list(v) {O} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS a, list(v) {O} ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS b FROM s), o AS (SELECT * FROM r WHERE i >= 60 AND i < n - 2 + 1 AND (i - 60) % 8 = 0), x AS (SELECT series, as_of, a[t] AS y, a[t - 1] AS x0, a[t - 2] AS x1, a[t - 4] AS x2, 1.0 AS x3 FROM o, (SELECT unnest(range(5, 61)) AS t)), g AS (SELECT series, as_of, " + ", ".join([f"sum(x{i} * x{j}) AS s{i}{j}" for i in range(4) for j in range(i, 4)] + [f"sum(x{i} * y) AS t{i}" for i in range(4)]) + f" FROM x GROUP BY ALL), w AS (SELECT series, as_of, {WEIGHTS} FROM g), p AS (SELECT *, greatest(0, w0 * a[60] + w1 * a[59] + w2 * a[57] + w3) AS p1 FROM o JOIN w USING (series, as_of))"


@query("fc11_backtest_least_squares", f"{LAGS} SELECT series, as_of, CAST(k AS INTEGER) AS step, CASE WHEN k = 1 THEN p1 ELSE greatest(0, w0 * p1 + w1 * a[60] + w2 * a[58] + w3) END AS prediction, b[k] AS actual FROM p, (SELECT unnest([1, 2]) AS k)")
def fc11(spark, d):
    return R.backtest(R.rolling_origins(series(spark, d), "series", "week", "v", 60, 2, 8), "series", R.MODELS["least_squares"]([1, 2, 4], 2))


@query("fc12_future_dates", f"WITH {SERIES} SELECT series, CAST(k AS INTEGER) AS k, max(week) + CAST(7 * k AS INTEGER) AS date FROM s, (SELECT unnest(generate_series(1, 3)) AS k) GROUP BY series, k")
def fc12(spark, d):
    return R.future_dates(series(spark, d), "series", "week", 3)


@query("w3_rolling_scores", f"WITH {SERIES}, x AS (SELECT *, avg(v) {O} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS p, row_number() {O}) AS i FROM s) SELECT series, count(*) AS n, avg(abs(v - p)) AS mae, sqrt(avg((v - p) * (v - p))) AS rmse FROM x WHERE i > 4 GROUP BY 1")
def w3(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("series").orderBy("week")
    x = series(spark, d).withColumn("p", F.avg("v").over(w.rowsBetween(-4, -1))).withColumn("i", F.row_number().over(w)).where("i > 4")
    return R.scores(x, ["series"], "v", "p", ("mae", "rmse"))


# pages and passages


@query("rt1_links", "WITH l AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href=\"([^\"]*)\"[^>]*>(.*?)</a>', 1)) AS href, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href=\"([^\"]*)\"[^>]*>(.*?)</a>', 2)) AS title FROM pages) SELECT url, href, trim(regexp_replace(title, '<[^>]*>', '', 'g')) AS title, regexp_extract(url, '^(\\w+://[^/?#]*)', 1) || href AS target FROM l")
def rt1(spark, d):
    return X.links(table(spark, d, "pages")).drop("pos")


@query("rt2_articles", "SELECT url, regexp_extract(url, '://([^/?#]*)', 1) AS host, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) AS title, regexp_extract(html, '(?i)<html lang=\"(\\w+)\"', 1) AS lang FROM pages")
def rt2(spark, d):
    return X.articles(table(spark, d, "pages")).drop("n_text")


@query("rt1_titled_links", "WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href=\"([^\"]*)\"[^>]*>(.*?)</a>', 1)) AS href, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href=\"([^\"]*)\"[^>]*>(.*?)</a>', 2)) AS title FROM pages) SELECT url, href, title, regexp_extract(url, '^(\\w+://[^/?#]*)', 1) || href AS target FROM (SELECT url, href, trim(regexp_replace(title, '<[^>]*>', '', 'g')) AS title FROM l) WHERE contains(title, 'th') OR contains(title, 'ei')")
def rt1b(spark, d):
    """Links whose values are quoted one way, the other way or not at all, with certain words in their titles."""
    quoted = [F.regexp_replace("html", 'href="([^"]*)"', to) for to in ("HREF = '$1'", "class=l href=$1", 'href="$1" rel=\'x\'')]
    html = F.when(F.col("page_id") % 3 == 0, quoted[0]).when(F.col("page_id") % 3 == 1, quoted[1]).otherwise(quoted[2])
    pages = table(spark, d, "pages").select("url", html.alias("html"))
    return X.links(pages, title=lambda t: F.contains(t, F.lit("th")) | F.contains(t, F.lit("ei"))).drop("pos")


#: pages with a short container in front, totals at the end of their article, and a month in a given title, in the text or nowhere
REPORT = "SELECT url, page_id, '20' || (10 + page_id % 15) || '年' || CASE WHEN page_id % 2 = 0 THEN ' ' ELSE '' END || (page_id % 12 + 1) || '月' AS month, CASE WHEN page_id % 5 = 0 THEN '共报告 法定传染病' || page_id || '例，死亡' || page_id % 7 || '人' WHEN page_id % 5 = 1 THEN '报告发病' || page_id || '例' WHEN page_id % 5 = 2 THEN '共报告' || page_id || '例死亡3人' ELSE 'none' END AS totals, html FROM pages"


def unescaped(x: str) -> str:
    """The character references of the pages; in HTML these need no semicolon."""
    for name, c in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        x = f"regexp_replace({x}, '&{name};?', '{c}', 'g')"
    return x


def strings_of(html: str) -> str:
    """The strings between tags, scripts, styles and comments, joined by line ends; white space alone counts as one character."""
    each = f"list_transform(list_filter(string_split_regex({html}, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<[^>]*>'), lambda x: x <> ''), lambda x: {unescaped('x')})"
    each = f"list_transform({each}, lambda x: CASE WHEN regexp_full_match(x, '\\s+') THEN CASE WHEN contains(x, chr(10)) THEN chr(10) ELSE ' ' END ELSE x END)"
    return f"regexp_replace(array_to_string({each}, chr(10)), '^\\s+|\\s+$', '', 'g')"


#: the main text is the article's, or the body's where that has at most 50 characters
RECORDS = f"WITH r AS ({REPORT}), a AS (SELECT *, CASE WHEN page_id % 4 = 0 THEN month ELSE '' END AS hint, trim({unescaped("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)")}) AS own, replace(replace(html, '</article>', '<p>' || totals || CASE WHEN page_id % 4 = 1 THEN ' ' || month ELSE '' END || '</p></article>'), '<body>', '<body>a' || chr(10) || 'c<br>d') AS whole FROM r WHERE html IS NOT NULL), b AS (SELECT *, {strings_of("regexp_extract(whole, '(?is)<article>(.*?)</article>', 1)")} AS of_article, {strings_of("regexp_extract(whole, '(?is)<body>(.*?)(</body>|\\z)', 1)")} AS of_body FROM a), t AS (SELECT *, CASE WHEN length(of_article) > 50 THEN of_article ELSE of_body END AS main_text FROM b)"


@query("rt2_article_records", f"{RECORDS} SELECT url, CASE WHEN hint <> '' THEN hint ELSE own END AS title, md5(main_text) AS text_md5, length(main_text) AS n_chars, regexp_extract(month, '^(\\d+)', 1) || '-' || lpad(regexp_extract(month, '(\\d+)月', 1), 2, '0') AS month, CASE WHEN page_id % 5 < 3 THEN page_id END AS cases, CASE WHEN page_id % 5 = 0 THEN page_id % 7 WHEN page_id % 5 = 2 THEN 3 END AS deaths, CASE WHEN contains(url, 'example.org') THEN 'org' WHEN contains(url, 'example.net') THEN 'net' ELSE 'unknown' END AS source FROM t WHERE page_id % 4 IN (0, 1)")
def rt2b(spark, d):
    k = F.col("page_id")
    text = lambda c: c.cast("string")
    month = F.concat(F.lit("20"), text(10 + k % 15), F.lit("年"), F.when(k % 2 == 0, " ").otherwise(""), text(k % 12 + 1), F.lit("月"))
    totals = F.when(k % 5 == 0, F.concat(F.lit("共报告 法定传染病"), text(k), F.lit("例，死亡"), text(k % 7), F.lit("人"))).when(k % 5 == 1, F.concat(F.lit("报告发病"), text(k), F.lit("例"))).when(k % 5 == 2, F.concat(F.lit("共报告"), text(k), F.lit("例死亡3人"))).otherwise("none")
    last = F.concat(F.lit("<p>"), totals, F.when(k % 4 == 1, F.concat(F.lit(" "), month)).otherwise(""), F.lit("</p></article>"))
    short = '<body><div class="x content"><div>a<script>b</script></div>c</div><div class="contents">d</div>'
    html = F.replace(F.replace("html", F.lit("</article>"), last), F.lit("<body>"), F.lit(short))
    pages = table(spark, d, "pages").select("url", html.alias("html"), F.when(k % 4 == 0, month).otherwise("").alias("hint"))
    out = X.article_records(pages, "hint", sources=(("example.org", "org"), ("example.net", "net")))
    return out.select("url", "title", F.md5("main_text").alias("text_md5"), F.length("main_text").alias("n_chars"), "month", "cases", "deaths", "source")


@query("rt5_strided_chunks", "SELECT doc_id, CAST((k - 1) // 450 AS INTEGER) AS chunk, substr(text, k, 500) AS content FROM (SELECT doc_id, text, unnest(generate_series(1, greatest(1, length(text) - 50), 450)) AS k FROM documents WHERE length(text) > 0)")
def rt5(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(X.strided(F.col("text"))).alias("chunk", "content"))


def last_cut(separator: str) -> str:
    """Where the separator last stands in the text between a and e, or 0."""
    sep = "'" + separator + "'" if "\n" not in separator else " || ".join(["chr(10)"] * len(separator))
    part = "substr(text, a + 52, e - a - 51)"
    found = f"instr(reverse({part}), reverse({sep}))"
    return f"CASE WHEN {found} > 0 THEN a + 51 + length({part}) - {found} + 1 - {len(separator)} ELSE 0 END"


CUTS = ", ".join(f"{last_cut(x)} AS c{k}" for k, x in enumerate(("\n\n", "\n", ". ", " ")))
SPLIT = f"WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0), r(doc_id, a, o, k) AS (SELECT doc_id, -1::BIGINT, 0::BIGINT, 0 FROM d UNION ALL SELECT doc_id, o, CASE WHEN e = n THEN n ELSE greatest(z - 50, o + 1) END, k + 1 FROM (SELECT doc_id, o, n, k, e, CASE WHEN e < n AND c0 > 0 THEN c0 WHEN e < n AND c1 > 0 THEN c1 WHEN e < n AND c2 > 0 THEN c2 WHEN e < n AND c3 > 0 THEN c3 ELSE e END AS z FROM (SELECT *, {CUTS} FROM (SELECT r.doc_id, o, o AS a, k, n, text, least(n, o + 500) AS e FROM r JOIN d USING (doc_id) WHERE o < n)))), q AS (SELECT doc_id, a, k, text, CASE WHEN e < n AND c0 > 0 THEN c0 WHEN e < n AND c1 > 0 THEN c1 WHEN e < n AND c2 > 0 THEN c2 WHEN e < n AND c3 > 0 THEN c3 ELSE e END AS z FROM (SELECT *, {CUTS} FROM (SELECT r.doc_id, r.a, k, n, text, least(n, r.a + 500) AS e FROM r JOIN d USING (doc_id) WHERE r.a >= 0))), p AS (SELECT doc_id, k, regexp_replace(substr(text, a + 1, z - a), '^\\s+|\\s+$', '', 'g') AS content FROM q)"


@query("rt5_split_chunks", f"{SPLIT} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS chunk, content FROM p WHERE content <> ''")
def rt5b(spark, d):
    from epispark.functions.helpers import splitter

    return table(spark, d, "documents").select("doc_id", F.posexplode(splitter()(F.col("text"))).alias("chunk", "content"))


@query("rt6_nearest", "WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0), x AS (SELECT q.vec_id AS query, e.vec_id AS id, list_sum(list_transform(list_zip(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS distance FROM q, embeddings e), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(distance, 9), id) AS rank FROM x) SELECT query, id, round(distance, 4) AS distance, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def rt6(spark, d):
    e = table(spark, d, "embeddings")
    return X.nearest(e.where("vec_id % 20 = 0"), e, 5, "vec_id").select("query", "id", F.round("distance", 4).alias("distance"), "rank")


@query("rt7_context", "WITH x AS (SELECT conv_id, turn, text, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) AS t FROM conversations WHERE text IS NOT NULL) SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS context FROM x WHERE t <= 600 GROUP BY 1")
def rt7(spark, d):
    return X.context(table(spark, d, "conversations").where("text is not null"), "conv_id", "turn", "text", 600)


@query("rt8_page_texts", "SELECT doc_id, CAST(generate_subscripts(p, 1) AS INTEGER) AS page, unnest(p) AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)")
def rt8(spark, d):
    return X.page_texts(table(spark, d, "documents"), "doc_id", "text")


# stays


GRID = "WITH p AS (SELECT l_orderkey, datediff('day', o_orderdate, l_shipdate) AS k, l_shipdate, l_returnflag, avg(l_quantity) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL 20 DAY GROUP BY ALL), c AS (SELECT l_orderkey, k, avg(v) FILTER (l_returnflag = 'A') AS A, avg(v) FILTER (l_returnflag = 'N') AS N, avg(v) FILTER (l_returnflag = 'R') AS R FROM p GROUP BY ALL), g AS (SELECT o_orderkey AS l_orderkey, unnest(generate_series(0, 19)) AS k FROM orders) SELECT l_orderkey, k AS time_idx, " + ", ".join(f"coalesce(last_value({x} IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY k ROWS UNBOUNDED PRECEDING), 0) AS {x}" for x in "ANR") + " FROM g LEFT JOIN c USING (l_orderkey, k)"


@query("fe1_stay_grid", GRID)
def fe1(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return X.stay_grid(o, table(spark, d, "lineitem"), "l_orderkey", "o_orderdate", "l_shipdate", "l_returnflag", "l_quantity", ["A", "N", "R"], 20)


@query("fe2_flat_features", "SELECT doc_id, length(text) AS n_chars, len(string_split(text, ' ')) AS n_words, len(list_filter(string_split(text, ' '), lambda w: w LIKE '%.')) AS n_ends FROM documents")
def fe2(spark, d):
    return flat_features(table(spark, d, "documents"))


def flat_features(documents, *more: str):
    words = F.split("text", " ")
    return documents.select("doc_id", F.length("text").alias("n_chars"), F.size(words).alias("n_words"), F.size(F.filter(words, lambda w: F.endswith(w, F.lit(".")))).alias("n_ends"), *more)


@query("fe3_outcome_model")
def fe3(spark, d):
    from pyspark.ml.functions import vector_to_array

    # the texts are read once: what follows takes numbers
    j = stored(flat_features(table(spark, d, "documents"), "lang").join(table(spark, d, "labels"), "doc_id").withColumn("label", F.col("quality").cast("double")))
    split = R.stratified_split(j, "doc_id", "quality").select("doc_id", "split")
    rows = stored(j.join(split, "doc_id"))
    model = X.outcome_model(rows.where("split = 'train'"), ["n_chars", "n_words", "n_ends"], ["lang"], "label")
    return model.transform(rows.withColumn("weight", F.lit(1.0))).select("doc_id", "split", "quality", F.round(vector_to_array("probability")[1], 6).alias("p"))


@query("fe5_category_codes", "SELECT value, CAST(dense_rank() OVER (ORDER BY value) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT p_type AS value FROM part WHERE p_type IS NOT NULL)")
def fe5(spark, d):
    return X.category_codes(table(spark, d, "part"), "p_type")
