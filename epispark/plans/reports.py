"""Queries over chosen categories, forecast origins, saved pages and run reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from epispark.functions import scalars as S
from epispark.operators import aggregates as A
from epispark.operators import clean as C
from epispark.operators import series as R
from epispark.operators import text as X
from epispark.plans.forecasts import FC, SERIES, O, forecasts, series
from epispark.plans.records import LAB, WEEK
from epispark.plans.registry import query, table

EV = WEEK.format("ts")


@query("prj21_chosen", f"WITH w AS (SELECT CAST({EV} AS DATE) AS week, event_type, count(DISTINCT user_id) AS n FROM events GROUP BY ALL), k AS (SELECT DISTINCT week FROM w), c AS (SELECT * FROM (VALUES ('purchase', 'purchase'), ('looks', 'view')) t(disease, event_type)) SELECT week, CAST(coalesce(n, 0) AS DOUBLE) AS value, disease FROM k CROSS JOIN c LEFT JOIN w USING (week, event_type)")
def prj21(spark, d):
    weekly = A.wide(A.weekly_counts(table(spark, d, "events"), "ts", "event_type", "user_id"), ["purchase", "view", "click"])
    return C.chosen(weekly, "week", ["purchase", "looks"], {"looks": ["glances", "view"]})


@query("pii1_column_kinds", "SELECT col AS \"column\", CASE WHEN contains(lower(col), 'name') THEN 'name' WHEN contains(lower(col), 'id_card') OR contains(lower(col), 'ssn') OR contains(lower(col), 'custkey') OR contains(lower(col), 'patient_id') THEN 'id' WHEN contains(lower(col), 'phone') OR contains(lower(col), 'tel') OR contains(lower(col), 'mobile') THEN 'phone' WHEN contains(lower(col), 'addr') THEN 'address' WHEN contains(lower(col), 'age') THEN 'age' WHEN contains(lower(col), 'birth') OR contains(lower(col), 'dob') THEN 'birth' ELSE 'other' END AS kind, n FROM (UNPIVOT (SELECT count(COLUMNS(*)) FROM customer) ON COLUMNS(*) INTO NAME col VALUE n)")
def pii1(spark, d):
    return C.column_kinds(table(spark, d, "customer"))


ORIGINS = f"{SERIES}, r AS (SELECT *, row_number() {O}) - 1 AS i, count(*) OVER (PARTITION BY series) AS n, lag(week) {O}) AS as_of, list(v) {O} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS a, list(v) {O} ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS b FROM s), w AS (SELECT * FROM r WHERE i >= 20 AND i < n - 4 + 1 AND (i - 20) % 4 = 0)"


def origins(spark, d):
    return R.rolling_origins(series(spark, d), "series", "week", "v", 20, 4, 4)


@query("ag25_origin_errors", f"WITH {ORIGINS} SELECT series, as_of, CAST(4 AS BIGINT) AS n, list_avg(list_transform(b, lambda x: abs(x - a[20]))) AS mae FROM w")
def ag25(spark, d):
    return R.origin_errors(R.backtest_last(origins(spark, d), "series"), "series", "as_of", "actual", "prediction")


@query("ag26_residual_summary", f"WITH {FC} SELECT series, count(*) AS n, avg(actual - p) AS residual_mean, stddev_samp(actual - p) AS residual_std FROM f GROUP BY 1")
def ag26(spark, d):
    return R.scores(forecasts(spark, d), ["series"], "actual", "p", ("residual_mean", "residual_std"))


@query("ag27_scale_check", f"WITH {ORIGINS}, x AS (SELECT series, as_of, greatest(list_max(a) / 40, 1e-9) AS p, greatest(list_max(b), 1e-9) AS q FROM w) SELECT series, as_of, greatest(p / q, q / p) AS ratio, greatest(p / q, q / p) > 10 AS off FROM x")
def ag27(spark, d):
    scaled = F.transform("train", lambda x: x / 40)
    return origins(spark, d).select("series", "as_of", R.scale_check(scaled, F.col("test")).alias("s")).select("series", "as_of", "s.*")


@query("ag15_order_flags", "SELECT l_orderkey, datediff('day', o_orderdate, l_shipdate) AS time_idx, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned, max(CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END) AS large FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate GROUP BY ALL")
def ag15(spark, d):
    stays = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    day = S.whole_days(F.col("l_shipdate"), F.col("o_orderdate"))
    return A.step_flags(stays, table(spark, d, "lineitem"), "l_orderkey", day, {"returned": F.col("l_returnflag") == "R", "large": F.col("l_quantity") > 40})


@query("wn7_step_windows", f"WITH {SERIES}, r AS (SELECT series, week AS as_of, row_number() {O}) - 1 AS i, array_to_string(list(CAST(v AS BIGINT)) {O} ROWS BETWEEN 155 PRECEDING AND CURRENT ROW), ',') AS history, array_to_string(list(CAST(v AS BIGINT)) {O} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), ',') AS recent, list(CAST(v AS BIGINT)) {O} ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS f FROM s) SELECT series, as_of, history, recent, array_to_string(f, ',') AS future FROM r WHERE len(f) > 0 AND i % 6 = 0")
def wn7(spark, d):
    text = lambda c: F.array_join(F.col(c).cast("array<bigint>").cast("array<string>"), ",")
    out = R.step_windows(series(spark, d), "series", "week", "v", step=6)
    return out.withColumns({c: text(c) for c in ("history", "recent", "future")})


@query("wn15_widened_bands", f"WITH {FC}, w AS (SELECT series, week, p, list_sort(list(abs(actual - p)) {O} ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING)) AS b FROM f), x AS (SELECT *, CASE WHEN len(b) > 0 THEN b[CAST(greatest(1, least(len(b), ceil((len(b) + 1) * 0.9))) AS INTEGER)] ELSE 0 END AS radius FROM w) SELECT series, week, CASE WHEN radius > 0 THEN greatest(0, least(p * 0.8, p - radius)) ELSE p * 0.8 END AS low, CASE WHEN radius > 0 THEN greatest(p * 1.2, p + radius, greatest(0, least(p * 0.8, p - radius))) ELSE p * 1.2 END AS high FROM x")
def wn15b(spark, d):
    f = forecasts(spark, d).withColumn("r", F.col("actual") - F.col("p"))
    bands = R.widened(F.col("p") * 0.8, F.col("p"), F.col("p") * 1.2, F.col("radius"))
    return R.conformal(f, "series", "week", "r").select("series", "week", bands.alias("b")).select("series", "week", "b.*")


@query("jn14_regular_series", "WITH o AS (SELECT o_orderstatus || ' ' || o_orderpriority AS series, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY ALL), g AS (SELECT series, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM o GROUP BY 1) SELECT series, day, n FROM g LEFT JOIN o USING (series, day)")
def jn14b(spark, d):
    o = table(spark, d, "orders").groupBy(F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    from epispark.operators.joins import regular

    return regular(o, "series", "day", 1)


@query("jn10_aligned_pairs", f"WITH {SERIES}, p AS (SELECT series, week + 7 AS week, CASE WHEN day(week) <> 1 THEN v END AS forecast FROM s) SELECT series, week, v AS actual, forecast FROM s JOIN p USING (series, week) WHERE forecast IS NOT NULL")
def jn10(spark, d):
    s = series(spark, d)
    later = s.select("series", F.date_add("week", 7).alias("week"), F.when(F.dayofmonth("week") != 1, F.col("v")).alias("forecast"))
    return R.aligned_pairs(s.withColumnRenamed("v", "actual"), later, ["series", "week"], "actual", "forecast")


@query("tk3_weekly_top", f"WITH e AS (SELECT l_suppkey AS c, l_orderkey AS p, CAST({WEEK.format('l_shipdate')} AS DATE) AS week FROM lineitem), t AS (SELECT c FROM (SELECT c, count(DISTINCT p) AS n FROM e GROUP BY 1 ORDER BY n DESC, c LIMIT 20)), k AS (SELECT DISTINCT week FROM e) SELECT week, c AS category, count(DISTINCT p) AS patients, count(p) AS visits FROM k CROSS JOIN t LEFT JOIN e USING (week, c) GROUP BY ALL")
def tk3(spark, d):
    return A.top_weekly(table(spark, d, "lineitem"), "l_shipdate", "l_suppkey", "l_orderkey", 20)


RUNS = f"{ORIGINS}, p AS (SELECT 'last' AS run, 1.0 AS m UNION ALL SELECT 'higher', 1.1), y AS (SELECT run, as_of, week + CAST(7 * (k - 1) AS INTEGER) AS date, b[k] AS actual, a[20] * m AS prediction FROM w, p, (SELECT unnest([1, 2, 3, 4]) AS k))"


def runs(spark, d):
    out = R.backtest_last(origins(spark, d), "series").withColumn("date", F.date_add("as_of", 7 * F.col("step")))
    factor = F.explode(F.array(F.struct(F.lit("last").alias("run"), F.lit(1.0).alias("m")), F.struct(F.lit("higher").alias("run"), F.lit(1.1).alias("m"))))
    return out.withColumn("x", factor).select("x.run", "as_of", "date", "actual", (F.col("prediction") * F.col("x.m")).alias("prediction"))


@query("tk8_run_report", f"WITH {RUNS.replace('week + CAST(7 * (k - 1) AS INTEGER)', 'as_of + CAST(7 * k AS INTEGER)')}, g AS (SELECT run, as_of, count(*) AS h FROM y GROUP BY ALL), z AS (SELECT run, count(*) AS n_steps, max(h) AS horizon FROM g GROUP BY 1) SELECT run, min(date) AS start, max(date) AS \"end\", any_value(n_steps) AS n_steps, any_value(horizon) AS horizon, count(*) AS n, avg(abs(actual - prediction)) AS mae, sqrt(avg((actual - prediction) * (actual - prediction))) AS rmse, avg(abs(actual - prediction) / greatest(1e-9, (abs(actual) + abs(prediction)) / 2)) AS smape FROM y JOIN z USING (run) GROUP BY 1 ORDER BY 1")
def tk8(spark, d):
    return R.run_summary(runs(spark, d), "run", "as_of", "date", "actual", "prediction")


@query("mt2_percentage_errors", f"WITH {FC} SELECT series, count(*) AS n, avg(abs(actual - p) / greatest(1e-6, abs(actual))) AS mape, 100 * avg(abs(actual - p) / abs(CASE WHEN actual = 0 THEN 1 ELSE actual END)) AS mape_percent, avg(abs(actual - p) / greatest(1e-9, (abs(actual) + abs(p)) / 2)) AS smape FROM f GROUP BY 1")
def mt2(spark, d):
    return R.scores(forecasts(spark, d), ["series"], "actual", "p", ("mape", "mape_percent", "smape"))


@query("ud1_model_quantiles", f"WITH {ORIGINS}, m AS (SELECT series, as_of, b, list_avg(a) AS m, sqrt(list_avg(list_transform(a, lambda x: (x - list_avg(a)) * (x - list_avg(a))))) AS g FROM w) SELECT series, as_of, CAST(k AS INTEGER) AS step, m AS prediction, b[k] AS actual, greatest(0, m - 1.6448536269514722 * g) AS q05, m AS q50, m + 1.6448536269514722 * g AS q95 FROM m, (SELECT unnest([1, 2, 3, 4]) AS k)")
def ud1(spark, d):
    return R.backtest(origins(spark, d), "series", R.MODELS["mean_bands"](4), "q05 double, q50 double, q95 double")


#: the draw of series.sampled_paths written out: 20 paths of each window of 20 values
DRAWN = f"{ORIGINS}, q AS (SELECT series, as_of, a, b, ascii(series) AS salt, list_transform(range(1, 20), lambda i: a[i + 1] - a[i]) AS diffs FROM w), u AS (SELECT *, (((salt * 7919 + date_diff('day', DATE '1970-01-01', as_of) * 104729 + path * 1299709 + step * 15485863 + 1) % 4294967296 * 2654435761::HUGEINT) % 4294967296) // 65536 % 19 AS pick FROM q, (SELECT unnest(range(0, 20)) AS path), (SELECT unnest(range(1, 5)) AS step)), y AS (SELECT series, as_of, path, CAST(step AS INTEGER) AS step, greatest(0, a[20] + sum(diffs[CAST(pick AS INTEGER) + 1]) OVER (PARTITION BY series, as_of, path ORDER BY step)) AS value, b[step] AS actual FROM u)"


def drawn(spark, d):
    return R.sampled_paths(origins(spark, d), "series", paths=20, seed=1, salt=F.ascii("series"))


@query("ud1_sample_paths", f"WITH {DRAWN} SELECT series, as_of, CAST(path AS INTEGER) AS path, step, value, actual FROM y")
def ud1b(spark, d):
    return drawn(spark, d)


@query("ud1_sample_scores", f"WITH {DRAWN}, l AS (SELECT series, as_of, step, any_value(actual) AS actual, list(value) AS xs, quantile_cont(value, 0.05) AS q05, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.95) AS q95, avg(CASE WHEN value > 5 THEN 1.0 ELSE 0.0 END) AS p_over_5 FROM y GROUP BY ALL) SELECT series, as_of, step, q05, q50, q95, p_over_5, list_avg(list_transform(xs, lambda x: abs(x - actual))) - list_sum(list_transform(xs, lambda x: list_sum(list_transform(xs, lambda z: abs(x - z))))) / 800 AS crps, 100 * list_median(list_transform(xs, lambda x: abs(x - q50))) / greatest(1, abs(q50) + 1) AS percent FROM l")
def ud1c(spark, d):
    """What the sample paths of each origin give to the scores that take samples."""
    from epispark.session import stored

    y, keys = stored(drawn(spark, d)), ["series", "as_of", "step"]
    gathered = y.groupBy(*keys).agg(F.first("actual").alias("actual"), F.collect_list("value").alias("xs"))  # 20 paths
    out = gathered.select(*keys, R.crps_samples(F.col("actual"), F.col("xs")).alias("crps"))
    out = out.join(R.path_quantiles(y, keys, "value", (0.05, 0.5, 0.95)), keys).join(R.exceedance(y, keys, "value", [5]), keys)
    return out.join(R.disagreement(y, keys, "value").drop("mad", "median"), keys)


PAGE_ROWS = "SELECT page_id, url, '20' || CAST(20 + page_id % 5 AS VARCHAR) || '-' || lpad(CAST(page_id % 12 + 1 AS VARCHAR), 2, '0') AS month, regexp_extract(url, '://[^/?#]*[.]([a-z]+)', 1) AS source FROM pages"


def page_rows(spark, d):
    month = F.concat(F.lit("20"), (20 + F.col("page_id") % 5).cast("string"), F.lit("-"), F.lpad((F.col("page_id") % 12 + 1).cast("string"), 2, "0"))
    return table(spark, d, "pages").select("page_id", "url", month.alias("month"), F.regexp_extract("url", r"://[^/?#]*[.]([a-z]+)", 1).alias("source"))


@query("rt3_monthly_table", f"WITH x AS ({PAGE_ROWS}), o AS (SELECT * FROM x WHERE month BETWEEN '2021-03' AND '2023-10'), a AS (SELECT month, source, min(url) AS url FROM o GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY CASE WHEN source = 'org' THEN 0 ELSE 1 END, source) AS k FROM a) SELECT month, source, url FROM r WHERE k = 1")
def rt3(spark, d):
    return X.monthly_table(page_rows(spark, d), "2021-03", "2023-10", "org").select("month", "source", "url")


TITLE = "trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1))"


@query("rt4_seed_urls", f"WITH x AS (SELECT page_id // 25 AS log, page_id % 2 AS kind, page_id, {TITLE} AS title, url FROM pages) SELECT arg_min(title, {{'l': log, 'k': kind, 'p': page_id}}) AS title, url FROM x WHERE title <> '' AND contains(title, 'e') AND (contains(title, 'on') OR contains(title, 'the')) AND (contains(url, 'example.org') OR contains(url, 'example.net')) GROUP BY url")
def rt4(spark, d):
    p = table(spark, d, "pages").select(F.floor(F.col("page_id") / 25).alias("log"), "page_id", "url", F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"))
    # saved searches of at most 25 results, in two arrays each
    result = F.struct("page_id", "title", F.when(F.col("page_id") % 3 == 0, F.col("url")).alias("link"), "url")
    of = lambda k: F.sort_array(F.collect_list(F.when(F.col("page_id") % 2 == k, result)))
    logs = p.groupBy("log").agg(of(0).alias("organic"), of(1).alias("news"))
    return X.seed_urls(logs, "log", ["organic", "news"], "e", ["on", "the"], ["example.org", "example.net"])


@query("sc6_labelled_counts", "SELECT page_id, CASE WHEN page_id % 3 = 2 THEN NULL ELSE page_id % 1000 END AS cases FROM pages")
def sc6(spark, d):
    n = (F.col("page_id") % 1000).cast("string")
    cell = F.concat(F.lit("<table><tr><th>cases</th>\n<td class=\"n\"> "), n, F.lit(" </td></tr></table>"))
    line = F.concat(F.lit("<p>CASES so far: "), n, F.lit(" of all</p>"))
    page = F.concat(F.col("html"), F.when(F.col("page_id") % 3 == 0, cell).when(F.col("page_id") % 3 == 1, line).otherwise("<p>none</p>"))
    return table(spark, d, "pages").select("page_id", S.count_after(page, "Cases").alias("cases"))


@query("sc8_packed_features", f"SELECT user_id, CAST(count(*) AS INTEGER) AS n_labs, CAST(sum(flag) AS INTEGER) AS n_raised FROM ({LAB}) WHERE z IS NOT NULL OR z IS NULL GROUP BY 1")
def sc8(spark, d):
    f = A.lab_features(table(spark, d, "events"), "user_id", "event_type", "ts", "value", {"view": (50.0, 20.0, 10.0, 90.0)})
    packed = A.packed_features(f, "user_id", "event_type")
    return packed.select("user_id", F.size("labs").alias("n_labs"), S.raised(F.col("labs")).alias("n_raised"))


@query("fe4_held_out")
def fe4(spark, d):
    from epispark.plans.forecasts import fe3

    test = fe3(spark, d).where("split = 'test'").withColumn("said", (F.col("p") >= 0.5).cast("int"))
    return A.class_report(test, "quality", "said").crossJoin(A.auroc(test.withColumn("quality", F.col("quality").cast("double")), "quality", "p"))
