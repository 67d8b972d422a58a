"""Queries over record tables: cleaning, anonymisation, sets, joins and aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from epispark.functions import scalars as S
from epispark.operators import aggregates as A
from epispark.operators import clean as C
from epispark.operators import joins as J
from epispark.plans.registry import query, table

WEEK = "(CAST({0} AS DATE) + CAST((8 - isodow(CAST({0} AS DATE))) % 7 AS INTEGER))"
EVENT_RULES = (("trouble", ("error", "fail")), ("money", ("purchase",)), ("access", ("view", "click")))
TEXT_RULES = (("shouting", ("!!",)), ("licensed", ("License", "licensed", "rights reserved")), ("markup", (" | ",)), ("tion", ("tion", "ción")), ("lich", ("lich", "keit")))
TYPES = ("click", "error", "purchase", "signup", "view")


def case(rules, col: str) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({col}, '{w}')" for w in words) + f" THEN '{c}'" for c, words in rules) + " ELSE 'Other' END"


W = WEEK.format("ts")


@query("ag1_weekly_counts", f"SELECT CAST({W} AS DATE) AS week, event_type AS category, count(DISTINCT user_id) AS patients, CAST(count(*) AS BIGINT) AS visits FROM events GROUP BY ALL")
def ag1(spark, d):
    return A.weekly_counts(table(spark, d, "events"), "ts", "event_type", "user_id")


@query("ag3_weekly_wide", f"SELECT CAST({W} AS DATE) AS week, " + ", ".join(f"count(DISTINCT user_id) FILTER (event_type = '{t}') AS {t}" for t in TYPES) + " FROM events GROUP BY ALL")
def ag3(spark, d):
    return A.wide(ag1(spark, d), TYPES)


@query("ag19_weekly_long", f"SELECT * FROM (SELECT CAST({W} AS DATE) AS week, event_type AS category, count(DISTINCT user_id) AS n FROM events WHERE event_type <> 'view' GROUP BY ALL) WHERE n > 0")
def ag19(spark, d):
    return A.long(A.wide(ag1(spark, d), TYPES), "week", ("view",))


@query("jn14_filled_weeks", f"WITH w AS (SELECT CAST({W} AS DATE) AS week, event_type AS category, count(DISTINCT user_id) AS patients, count(*) AS visits FROM events WHERE event_type <> 'view' OR day(ts) < 10 GROUP BY ALL), g AS (SELECT category, CAST(unnest(generate_series((SELECT min(week) FROM w), (SELECT max(week) FROM w), INTERVAL 7 DAY)) AS DATE) AS week FROM (SELECT DISTINCT category FROM w)) SELECT g.week, g.category, coalesce(patients, 0) AS patients, CAST(coalesce(visits, 0) AS BIGINT) AS visits FROM g LEFT JOIN w USING (week, category)")
def jn14b(spark, d):
    e = table(spark, d, "events").where("event_type <> 'view' or day(ts) < 10")
    return A.filled_weeks(A.weekly_counts(e, "ts", "event_type", "user_id"))


@query("jn11_other_adjusted", f"WITH x AS (SELECT CAST({W} AS DATE) AS week, count(*) AS all_n, count(*) FILTER (event_type='click') AS click, count(*) FILTER (event_type='error') AS error FROM events GROUP BY ALL) SELECT week, click, error, CAST(greatest(all_n - click - error, 0) AS BIGINT) AS Other FROM x")
def jn11(spark, d):
    w = A.weekly_counts(table(spark, d, "events"), "ts", "event_type", "user_id")
    total = w.groupBy("week").agg(F.sum("visits").alias("Other"))
    return J.with_extra_categories(total, A.wide(w.where("category in ('click','error')"), ("click", "error"), "visits"), ("click", "error"))


@query("prj16_event_classes", f"SELECT {case(EVENT_RULES, 'event_type')} AS category, CAST(count(*) AS BIGINT) AS n, count(DISTINCT user_id) AS persons FROM events GROUP BY ALL")
def prj16(spark, d):
    e = table(spark, d, "events").withColumn("category", S.first_keyword(F.col("event_type"), EVENT_RULES))
    return e.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("persons"))


@query("prj16_text_classes", f"SELECT lang, {case(TEXT_RULES, 'text')} AS category, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY ALL")
def prj16t(spark, d):
    return table(spark, d, "documents").withColumn("category", S.first_keyword(F.col("text"), TEXT_RULES)).groupBy("lang", "category").agg(F.count(F.lit(1)).alias("n"))


@query("ag4_daily_persons", "SELECT CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS persons FROM events WHERE user_id IS NOT NULL GROUP BY ALL")
def ag4(spark, d):
    return A.daily_persons(table(spark, d, "events"), "ts", "user_id")


@query("ag5_mean_matrix", "SELECT user_id, CAST(ts AS DATE) AS day, " + ", ".join(f"coalesce(avg(value) FILTER (event_type = '{t}'), -1) AS {t}" for t in TYPES) + " FROM events GROUP BY ALL")
def ag5(spark, d):
    return A.mean_matrix(table(spark, d, "events"), ["user_id", F.to_date("ts").alias("day")], "event_type", TYPES, "value")


@query("ag7_profile", "SELECT CAST(count(*) AS BIGINT) AS n_rows, count(DISTINCT o_custkey) AS n_ids, CAST(count(*) FILTER (o_custkey IS NULL) AS BIGINT) AS n_null, count(DISTINCT o_custkey) FILTER (o_orderdate IS NOT NULL) AS n_complete, count(DISTINCT o_custkey) FILTER (o_orderdate IS NOT NULL) / count(DISTINCT o_custkey) AS complete_share, count(*) / count(DISTINCT o_custkey) AS rows_per_id, (SELECT string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey IS NOT NULL ORDER BY 1 LIMIT 5)) AS sample_ids FROM orders")
def ag7(spark, d):
    return A.profile(table(spark, d, "orders"), "o_custkey", ["o_orderdate"])


@query("ag8_value_shares", "SELECT o_orderpriority, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM orders GROUP BY 1")
def ag8(spark, d):
    return A.value_shares(table(spark, d, "orders"), "o_orderpriority")


@query("ag8_contingency", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus='F') AS F, count(*) FILTER (o_orderstatus='O') AS O, count(*) FILTER (o_orderstatus='P') AS P FROM orders GROUP BY 1")
def ag8b(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).fillna(0)


@query("ag9_rare_grouped", "WITH s AS (SELECT p_name, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM part GROUP BY 1) SELECT CASE WHEN share < 0.02 THEN 'Other' ELSE p_name END AS category, CAST(sum(n) AS BIGINT) AS n FROM s GROUP BY 1")
def ag9(spark, d):
    return A.rare_grouped(table(spark, d, "part"), "p_name", 0.02)


@query("ag10_box_stats", "SELECT event_type, min(value) AS lo, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3, max(value) AS hi FROM events GROUP BY 1")
def ag10(spark, d):
    return A.box_stats(table(spark, d, "events"), "event_type", "value")


@query("ag10_histogram", "SELECT CAST(least(floor((l_quantity - 0) / (50.0 / 10)) + 1, 10) AS INTEGER) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def ag10h(spark, d):
    return A.histogram(table(spark, d, "lineitem"), "l_quantity", 0.0, 50.0, 10)


ITEM_COLUMNS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
FEW = {c: f"(SELECT count(DISTINCT {c}) BETWEEN 2 AND 49 FROM lineitem)" for c in ITEM_COLUMNS}


@query("ag10_gated_boxes", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(min({c}) AS DOUBLE) AS lo, quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS q2, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3, CAST(max({c}) AS DOUBLE) AS hi FROM lineitem HAVING {FEW[c]}" for c in ITEM_COLUMNS))
def ag10c(spark, d):
    """Box statistics of the numeric columns that the gate lets through."""
    items = table(spark, d, "lineitem")
    return A.column_boxes(items, A.gated_columns(items, ITEM_COLUMNS))


@query("ag10_gated_bins", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(least(floor(10 * (CAST({c} AS DOUBLE) - lo) / (hi - lo)) + 1, 10) AS INTEGER) AS bin, count(*) AS n FROM lineitem, (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM lineitem) WHERE {FEW[c]} GROUP BY 1, 2" for c in ITEM_COLUMNS))
def ag10d(spark, d):
    items = table(spark, d, "lineitem")
    return A.column_histograms(items, A.gated_columns(items, ITEM_COLUMNS))


@query("ag11_word_counts", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '[ \\t\\n\\x0B\\f\\r]+')) AS word FROM documents) WHERE word <> '' GROUP BY 1")
def ag11(spark, d):
    return A.word_counts(table(spark, d, "documents"), "text")


@query("ag12_first_time", "SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS t0, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS codes FROM orders GROUP BY 1")
def ag12(spark, d):
    return A.first_time(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderpriority").select("o_custkey", F.to_date("t0").alias("t0"), F.array_join("codes", "|").alias("codes"))


@query("ag13_ordered_text", "SELECT conv_id, substr(string_agg(substr(text, 1, 256), ' ' ORDER BY turn, substr(text, 1, 256)), 1, 256) AS text FROM conversations WHERE text IS NOT NULL GROUP BY 1")
def ag13(spark, d):
    return A.ordered_text(table(spark, d, "conversations"), "conv_id", "turn", "text")


LAB = """WITH r AS (SELECT user_id, event_type, ts, value, min(ts) OVER (PARTITION BY user_id, event_type) AS t0 FROM events WHERE value IS NOT NULL),
g AS (SELECT user_id, event_type, min({'ts': ts, 'v': value}).v AS f, (max({'ts': ts, 'v': value}) FILTER (ts <= t0 + INTERVAL 24 HOUR)).v AS l, avg(value) AS m, stddev_samp(value) AS s FROM r GROUP BY ALL)
SELECT user_id, event_type, CASE WHEN event_type = 'view' THEN (f - 50.0) / 20.0 ELSE (f - m) / CASE WHEN s = 0 THEN 1 ELSE s END END AS z, l - f AS slope, CASE WHEN event_type = 'view' AND (f < 10 OR f > 90) THEN 1 ELSE 0 END AS flag FROM g"""


@query("ag14_lab_features", LAB)
def ag14(spark, d):
    return A.lab_features(table(spark, d, "events"), "user_id", "event_type", "ts", "value", {"view": (50.0, 20.0, 10.0, 90.0)})


@query("ag16_severe_outcome", "WITH g AS (SELECT o_custkey, datediff('day', lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderdate) AS gap FROM orders), ids AS (SELECT o_custkey FROM g WHERE gap <= 14 UNION SELECT o_custkey FROM orders WHERE lower(o_orderpriority) LIKE '%urgent%' AND o_orderstatus = 'P') SELECT c_custkey, CASE WHEN o_custkey IS NULL THEN 0 ELSE 1 END AS outcome FROM customer LEFT JOIN ids ON c_custkey = o_custkey")
def ag16(spark, d):
    from epispark.operators.series import readmissions

    o = table(spark, d, "orders")
    again = readmissions(o, "o_custkey", "o_orderdate", "o_orderkey").where("readmitted = 1").select(F.col("o_custkey").alias("c_custkey"))
    word = o.where((S.any_keyword([F.col("o_orderpriority")], ["urgent"]) == 1) & (F.col("o_orderstatus") == "P")).select(F.col("o_custkey").alias("c_custkey"))
    return A.severe_outcome(table(spark, d, "customer").select("c_custkey"), [again, word], "c_custkey")


@query("ag17_summed_series", "SELECT day, sum(v) AS v FROM (SELECT CAST(o_orderdate AS DATE) AS day, o_totalprice AS v FROM orders UNION ALL SELECT CAST(l_shipdate AS DATE), l_extendedprice FROM lineitem) GROUP BY 1")
def ag17(spark, d):
    a = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("v"))
    b = table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("day"), F.col("l_extendedprice").alias("v"))
    return A.summed([a, b], "day", "v")


@query("ag18_disease_pivot", "SELECT CAST(ts AS DATE) AS day, avg(value) FILTER (event_type='error') AS error, avg(value) FILTER (event_type='view') AS view FROM events WHERE event_type IN ('error','view') GROUP BY 1")
def ag18(spark, d):
    return table(spark, d, "events").where("event_type in ('error','view')").groupBy(F.to_date("ts").alias("day")).pivot("event_type", ["error", "view"]).agg(F.avg("value"))


@query("ag20_monthly_spread", "WITH m AS (SELECT date_trunc('month', o_orderdate) AS month, count(*) AS n FROM orders GROUP BY 1), p AS (SELECT n, CAST(last_day(month) AS DATE) - CAST(k * 7 AS INTEGER) AS day FROM m, (SELECT unnest(generate_series(0, 3)) AS k)) SELECT CAST(floor((DATE '2001-07-15' - day) / 7) AS INTEGER) AS weeks_ago, sum(n) / 4 AS n FROM p WHERE day <= DATE '2001-07-15' GROUP BY 1")
def ag20(spark, d):
    m = table(spark, d, "orders").groupBy(F.trunc("o_orderdate", "MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return A.monthly_spread(m, "month", "n", F.lit("2001-07-15").cast("date"))


@query("ag21_recent_signal", "WITH w AS (SELECT event_type, floor((DATE '2024-01-28' - CAST(ts AS DATE)) / 7) AS k FROM events WHERE CAST(ts AS DATE) <= DATE '2024-01-28'), g AS (SELECT event_type, count(*) FILTER (k = 0) AS last, (count(*) FILTER (k = 1) + count(*) FILTER (k = 2) + count(*) FILTER (k = 3)) / 3 AS prev FROM w GROUP BY 1) SELECT event_type, last, prev, CASE WHEN prev > 0 THEN (last - prev) / greatest(1, prev) WHEN last > 0 THEN 1 ELSE 0 END AS change, least(3, last / 5) AS ratio FROM g")
def ag21(spark, d):
    return A.recent_signal(table(spark, d, "events"), "event_type", "ts", F.lit("2024-01-28").cast("date"))


PRED = "SELECT doc_id, quality AS y, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS p, least(n_chars, 4000) / 4000.0 AS s FROM documents JOIN labels USING (doc_id)"


def predicted(spark, d):
    j = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return j.select("doc_id", F.col("quality").alias("y"), (F.col("n_chars") > 1500).cast("int").alias("p"), (F.least("n_chars", F.lit(4000)) / 4000.0).alias("s"))


@query("ag22_class_report", f"WITH d AS ({PRED}), k AS (SELECT unnest([0, 1]) AS label), g AS (SELECT label, count(*) FILTER (y = label AND p = label) AS tp, count(*) FILTER (y = label) AS support, count(*) FILTER (p = label) AS said FROM d, k GROUP BY 1) SELECT label, CAST(support AS BIGINT) AS support, tp / said AS precision, tp / support AS recall, 2 * (tp / said) * (tp / support) / (tp / said + tp / support) AS f1 FROM g")
def ag22(spark, d):
    return A.class_report(predicted(spark, d), "y", "p")


@query("ag22_auroc", f"WITH d AS ({PRED}), g AS (SELECT s, sum(y) AS pos, count(*) - sum(y) AS neg FROM d GROUP BY 1), b AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) SELECT sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS auroc FROM b")
def ag22b(spark, d):
    return A.auroc(predicted(spark, d), "y", "s")


@query("ag22_auprc", f"WITH d AS ({PRED}), g AS (SELECT s, sum(y) AS pos, count(*) - sum(y) AS neg FROM d GROUP BY 1), c AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS hit, sum(pos + neg) OVER (ORDER BY s DESC) AS said, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) SELECT CAST(sum(pos + neg) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS positives, sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS auroc, sum(pos * hit / said) / sum(pos) AS auprc FROM c")
def ag22c(spark, d):
    return A.score_areas(predicted(spark, d), "y", "s")


@query("ag23_calibration", f"SELECT CAST(least(floor(s * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(y) AS observed, avg(s) AS predicted FROM ({PRED}) GROUP BY 1")
def ag23(spark, d):
    return A.calibration(predicted(spark, d), "y", "s")


@query("ag24_split_distribution", "SELECT split, toxic, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY split) AS percent FROM (SELECT toxic, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM labels) GROUP BY split, toxic")
def ag24(spark, d):
    return A.split_distribution(table(spark, d, "labels").withColumn("split", F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train")), "split", "toxic")


# cleaning


@query("prj1_renamed", "SELECT c_custkey AS patient_id, c_name AS patient_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def prj1(spark, d):
    return C.renamed(table(spark, d, "customer"), {"c_custkey": "patient_id", "c_name": "patient_name", "absent": "x"})


@query("prj2_standard_keys", "SELECT CAST(o_custkey AS VARCHAR) AS stay_id, count(*) AS n FROM orders GROUP BY 1")
def prj2(spark, d):
    return C.with_key(table(spark, d, "orders"), ["inpatient_no", "o_custkey"]).groupBy("stay_id").agg(F.count(F.lit(1)).alias("n"))


@query("prj3_lenient_dates", "SELECT day, count(*) AS n FROM (SELECT CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS day FROM events) GROUP BY 1")
def prj3(spark, d):
    raw = F.when(F.col("event_id") % 7 == 0, "n/a").when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyyMMdd")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return table(spark, d, "events").select(F.to_date(S.lenient_time(raw)).alias("day")).groupBy("day").agg(F.count(F.lit(1)).alias("n"))


@query("prj5_required_rows", "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL")
def prj5(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return C.without(C.required(j, ["quality", "n_chars"]), ["text", "lang", "source", "n_chars", "toxic", "absent"])


@query("prj6_demographics", "SELECT user_id, nullif(regexp_extract(t, '(\\d+) years', 1), '') AS age, nullif(regexp_extract(t, '(male|female)', 1), '') AS sex FROM (SELECT user_id, 'patient, ' || CASE WHEN event_id % 3 = 0 THEN '' ELSE CAST(event_id % 90 AS VARCHAR) || ' years, ' END || CASE WHEN event_id % 2 = 0 THEN 'female' ELSE 'none' END AS t FROM events)")
def prj6(spark, d):
    t = F.concat(F.lit("patient, "), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat((F.col("event_id") % 90).cast("string"), F.lit(" years, "))), F.when(F.col("event_id") % 2 == 0, "female").otherwise("none"))
    found = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
    return table(spark, d, "events").select("user_id", found(r"(\d+) years").alias("age"), found("(male|female)").alias("sex"))


@query("prj7_lenient_numbers", "SELECT event_type, sum(v) AS total, count(*) AS n FROM (SELECT event_type, try_cast(CASE WHEN event_id % 5 = 0 THEN 'neg' ELSE json_extract_string(props, '$.k') END AS DOUBLE) AS v FROM events) WHERE v IS NOT NULL GROUP BY 1")
def prj7(spark, d):
    raw = F.when(F.col("event_id") % 5 == 0, "neg").otherwise(F.get_json_object("props", "$.k"))
    return table(spark, d, "events").withColumn("v", S.lenient_double(raw)).where("v is not null").groupBy("event_type").agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("n"))


DOSE = "CASE p_size % 4 WHEN 0 THEN '.' || p_size || 'mg' WHEN 1 THEN p_size || '.5 mg' WHEN 2 THEN 'x' ELSE ' ' || p_size || 'ml' END"


@query("prj8_dose_mg", f"SELECT p_partkey, CASE WHEN t LIKE '.%' THEN try_cast('0.' || regexp_extract(t, '^\\.(\\d+)', 1) AS DOUBLE) ELSE try_cast(nullif(regexp_extract(t, '(\\d+\\.?\\d*)', 1), '') AS DOUBLE) END AS mg FROM (SELECT p_partkey, trim({DOSE}) AS t FROM part)")
def prj8(spark, d):
    return table(spark, d, "part").select("p_partkey", S.dose_mg(F.expr(DOSE)).alias("mg"))


@query("prj9_dose_parts", f"SELECT p_partkey, coalesce(try_cast(nullif(regexp_extract(t, '^\\s*(\\d+(?:\\.\\d+)?)\\s*([^\\d\\s]+)\\s*$', 1), '') AS DOUBLE), try_cast(t AS DOUBLE)) AS value, nullif(regexp_extract(t, '^\\s*(\\d+(?:\\.\\d+)?)\\s*([^\\d\\s]+)\\s*$', 2), '') AS unit FROM (SELECT p_partkey, {DOSE} AS t FROM part)")
def prj9(spark, d):
    return table(spark, d, "part").select("p_partkey", S.dose_parts(F.expr(DOSE)).alias("x")).select("p_partkey", "x.value", "x.unit")


@query("prj10_narrative", "SELECT c_custkey, concat_ws('; ', CASE WHEN length(c_name) > 0 THEN 'name: ' || c_name END, CASE WHEN c_acctbal > 0 THEN 'balance: ' || CAST(CAST(c_acctbal AS BIGINT) AS VARCHAR) END) AS narrative FROM (SELECT c_custkey, c_name, floor(c_acctbal) AS c_acctbal FROM customer)")
def prj10(spark, d):
    balance = F.when(F.floor("c_acctbal") > 0, F.floor("c_acctbal").cast("string"))
    return table(spark, d, "customer").select("c_custkey", S.labelled_text([("name", F.col("c_name")), ("balance", balance)]).alias("narrative"))


@query("prj11_medication_list", "SELECT l_orderkey, string_agg(l_partkey || ':' || CAST(l_quantity AS BIGINT), ',' ORDER BY l_linenumber, l_partkey, l_quantity) AS items FROM lineitem GROUP BY 1")
def prj11(spark, d):
    items = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity")))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(items, lambda i: F.concat_ws(":", i["l_partkey"].cast("string"), i["l_quantity"].cast("long").cast("string"))), ",").alias("items"))


@query("prj12_clean_reports", "SELECT doc_id, trim(regexp_replace(replace(text, 'All rights reserved.', ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS report FROM documents")
def prj12(spark, d):
    return table(spark, d, "documents").select("doc_id", C.clean_report(F.col("text"), ["All rights reserved."]).alias("report"))


@query("prj13_squeezed", "SELECT p_partkey, regexp_replace(p_name, '\\s+', '', 'g') AS name FROM part")
def prj13(spark, d):
    return table(spark, d, "part").select("p_partkey", S.squeezed(F.col("p_name")).alias("name"))


@query("prj14_culture_results", "SELECT name, result, count(*) AS n FROM (SELECT CASE WHEN t LIKE 'no %' THEN substr(t, 4) ELSE t END AS name, CASE WHEN t LIKE 'no %' THEN 0 ELSE 1 END AS result FROM (SELECT CASE WHEN event_id % 4 = 0 THEN 'no ' || event_type ELSE event_type END AS t FROM events)) GROUP BY ALL")
def prj14(spark, d):
    t = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("no "), "event_type")).otherwise(F.col("event_type"))
    negative = F.nullif(F.regexp_extract(t, r"^no (.+)$", 1), F.lit(""))
    return table(spark, d, "events").where("event_type is not null").select(F.coalesce(negative, t).alias("name"), negative.isNull().cast("int").alias("result")).groupBy("name", "result").agg(F.count(F.lit(1)).alias("n"))


@query("prj15_patient_key", "SELECT coalesce(CASE WHEN event_id % 2 = 0 THEN 'i' || user_id END, 'o' || user_id) AS patient, count(*) AS n FROM events GROUP BY 1")
def prj15(spark, d):
    inpatient = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("i"), F.col("user_id").cast("string")))
    return table(spark, d, "events").select(F.coalesce(inpatient, F.concat(F.lit("o"), F.col("user_id").cast("string"))).alias("patient")).groupBy("patient").agg(F.count(F.lit(1)).alias("n"))


@query("prj17_drug_codes", "SELECT p_partkey, CASE WHEN contains(p_name, 'gear') THEN 'G01' WHEN contains(p_name, 'bolt') THEN 'B02' ELSE 'Z99' END AS code FROM part")
def prj17(spark, d):
    return table(spark, d, "part").select("p_partkey", S.first_keyword(F.col("p_name"), (("G01", ("gear",)), ("B02", ("bolt",))), "Z99").alias("code"))


@query("prj18_period", "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31'")
def prj18(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderdate").between(F.lit("1997-01-01").cast("timestamp"), F.lit("1997-12-31").cast("timestamp"))).select("o_orderkey")


@query("prj19_one_week", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS persons FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15' GROUP BY 1")
def prj19(spark, d):
    w = table(spark, d, "events").where("ts >= timestamp'2024-01-08' and ts < timestamp'2024-01-15'")
    return w.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("persons"))


@query("prj20_keyword_flag", "SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)license|password') OR regexp_matches(source, '(?i)license|password') THEN 1 ELSE 0 END AS flag FROM documents")
def prj20(spark, d):
    return table(spark, d, "documents").select("doc_id", S.any_keyword([F.col("text"), F.col("source")], ["license", "password"]).alias("flag"))


@query("prj22_column_names", "SELECT p_type, CASE WHEN r > 1 THEN 'lab_' || n || '_' || r ELSE 'lab_' || n END AS name FROM (SELECT p_type, n, row_number() OVER (PARTITION BY n ORDER BY p_type) AS r FROM (SELECT DISTINCT p_type, regexp_replace(p_type, '[^a-zA-Z0-9_]', '_', 'g') AS n FROM part))")
def prj22(spark, d):
    return C.column_names(table(spark, d, "part"), "p_type", "lab_")


@query("prj23_minmax", "SELECT l_orderkey, l_linenumber, (l_quantity - min(l_quantity) OVER ()) / (max(l_quantity) OVER () - min(l_quantity) OVER ()) AS l_quantity, (l_tax - min(l_tax) OVER ()) / (max(l_tax) OVER () - min(l_tax) OVER ()) AS l_tax FROM lineitem")
def prj23(spark, d):
    return C.minmax_scaled(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"), ["l_quantity", "l_tax"])


@query("prj24_complete_rows", "SELECT lang, count(*) FILTER (quality IS NOT NULL AND text IS NOT NULL) AS complete, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def prj24(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return j.groupBy("lang").agg(F.count(F.when(C.complete(["quality", "text"]), 1)).alias("complete"), F.count(F.lit(1)).alias("n"))


@query("prj25_clamped", "SELECT event_id, event_type AS name, CASE event_type WHEN 'view' THEN greatest(20, least(60, value)) WHEN 'error' THEN greatest(0, least(5, value)) ELSE value END AS value FROM events WHERE value IS NOT NULL")
def prj25(spark, d):
    b = spark.createDataFrame([("view", 20.0, 60.0), ("error", 0.0, 5.0)], "name string, lo double, hi double")
    return C.clamped(table(spark, d, "events").select("event_id", F.col("event_type").alias("name"), "value"), b)


@query("prj26_aligned", "SELECT c_custkey AS id, c_acctbal AS balance, 0 AS size FROM customer UNION ALL SELECT p_partkey, 0, p_size FROM part")
def prj26(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return C.aligned([a, table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"))])


# anonymisation


@query("pii2_anonymised", "SELECT substr(sha256(c_name), 1, 8) AS c_name, CASE WHEN length(p) >= 7 THEN substr(p, 1, 3) || '****' || right(p, 4) ELSE 'MASKED' END AS phone, CASE WHEN a < 1 THEN '0-0' WHEN a < 6 THEN '1-5' WHEN a < 18 THEN '6-17' WHEN a < 35 THEN '18-34' WHEN a < 50 THEN '35-49' WHEN a < 65 THEN '50-64' ELSE '65+' END AS age, CASE WHEN contains(ad, 'Province') THEN split_part(ad, 'Province', 1) || 'Province' ELSE split_part(ad, 'City', 1) || 'City' END AS address, c_mktsegment FROM (SELECT c_name, CAST(c_custkey * 7919 AS VARCHAR) AS p, c_custkey % 100 AS a, CASE WHEN c_custkey % 2 = 0 THEN 'North Province West City 5' ELSE 'West City 9' END AS ad, c_mktsegment FROM customer)")
def pii2(spark, d):
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select("c_name", (k * 7919).cast("string").alias("phone"), (k % 100).cast("string").alias("age"), F.when(k % 2 == 0, "North Province West City 5").otherwise("West City 9").alias("address"), "c_mktsegment")
    return C.anonymised(c, 2025)


@query("pii5_birth_groups", "SELECT CASE WHEN a < 1 THEN '0-0' WHEN a < 6 THEN '1-5' WHEN a < 18 THEN '6-17' WHEN a < 35 THEN '18-34' WHEN a < 50 THEN '35-49' WHEN a < 65 THEN '50-64' ELSE '65+' END AS age_group, count(*) AS n FROM (SELECT 2010 - year(o_orderdate) AS a FROM orders) GROUP BY 1")
def pii5(spark, d):
    return table(spark, d, "orders").groupBy(C.birth_group(F.col("o_orderdate"), 2010).alias("age_group")).agg(F.count(F.lit(1)).alias("n"))


@query("pii6_pseudonyms", "WITH ids AS (SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer UNION SELECT CAST(o_custkey AS VARCHAR) FROM orders) SELECT id, 'P' || lpad(CAST(row_number() OVER (ORDER BY id) AS VARCHAR), 6, '0') AS pseudonym FROM ids")
def pii6(spark, d):
    return C.pseudonyms([(table(spark, d, "customer"), "c_custkey"), (table(spark, d, "orders"), "o_custkey")])


@query("pii7_report", "SELECT 'c_name' AS \"column\", count(DISTINCT c_name) AS n_before, count(DISTINCT substr(sha256(c_name), 1, 8)) AS n_after FROM customer UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment), count(DISTINCT c_mktsegment) FROM customer")
def pii7(spark, d):
    c = table(spark, d, "customer").select("c_name", "c_mktsegment")
    return C.anonymity_report(c, C.anonymised(c, 2025))


# sets


@query("st1_source_overlap", "WITH r AS (SELECT CAST(o_custkey AS VARCHAR) AS id, 'orders' AS s FROM orders UNION SELECT CAST(c_custkey AS VARCHAR), 'customer' FROM customer UNION SELECT CAST(doc_id AS VARCHAR), 'labels' FROM labels) SELECT id, count(*) AS n_sources, string_agg(s, '+' ORDER BY s) AS sources FROM r GROUP BY 1")
def st1(spark, d):
    return C.source_overlap({"orders": table(spark, d, "orders").select(F.col("o_custkey").alias("k")), "customer": table(spark, d, "customer").select(F.col("c_custkey").alias("k")), "labels": table(spark, d, "labels").select(F.col("doc_id").alias("k"))}, "k")


@query("st4_first_per_host_month", "SELECT url, lang FROM (SELECT url, regexp_extract(html, 'lang=\"(\\w+)\"', 1) AS lang, row_number() OVER (PARTITION BY regexp_extract(html, 'lang=\"(\\w+)\"', 1), regexp_extract(url, '://([^/?#]*)', 1) ORDER BY CASE WHEN url LIKE 'https%' THEN 0 ELSE 1 END, url) AS r FROM (SELECT DISTINCT url, html FROM pages)) WHERE r = 1")
def st4(spark, d):
    p = table(spark, d, "pages").select("url", F.regexp_extract("html", r'lang="(\w+)"', 1).alias("lang"), F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"))
    return C.first_per(p, ["lang", "host"], [(~F.startswith("url", F.lit("https"))).cast("int"), "url"]).select("url", "lang")


@query("st5_first_order", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def st5(spark, d):
    return C.first_per(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


# joins


@query("jn2_within_days", "SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL 30 DAY GROUP BY 1")
def jn2(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return J.within_hours(table(spark, d, "lineitem"), o, "l_orderkey", "l_shipdate", "o_orderdate", 720).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query("jn3_assembled", "SELECT c_custkey, coalesce(n_orders, 0) AS n_orders, coalesce(codes, '') AS codes FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) a ON c_custkey = a.o_custkey LEFT JOIN (SELECT o_custkey, string_agg(DISTINCT o_orderstatus, '' ORDER BY o_orderstatus) AS codes FROM orders WHERE o_totalprice > 300000 GROUP BY 1) b ON c_custkey = b.o_custkey")
def jn3(spark, d):
    o = table(spark, d, "orders").withColumn("c_custkey", F.col("o_custkey"))
    a = o.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    b = o.where("o_totalprice > 300000").groupBy("c_custkey").agg(F.array_join(F.sort_array(F.collect_set("o_orderstatus")), "").alias("codes"))
    return J.assembled(table(spark, d, "customer").select("c_custkey"), [a, b], "c_custkey", {"n_orders": F.lit(0), "codes": F.lit("")})


@query("jn4_default_label", "SELECT doc_id, coalesce(toxic, 0) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def jn4(spark, d):
    return J.with_label(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id", "toxic")


@query("jn5_members", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def jn5(spark, d):
    ids = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return J.members(table(spark, d, "customer").select("c_custkey"), ids, "c_custkey")


@query("jn6_start_pairs", "SELECT DISTINCT o_custkey, o_orderkey, CAST(t0 AS DATE) AS t0 FROM orders JOIN (SELECT l_orderkey, min(l_shipdate) AS t0 FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def jn6(spark, d):
    t0 = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.to_date(F.min("l_shipdate")).alias("t0"))
    return table(spark, d, "orders").select("o_custkey", "o_orderkey").distinct().join(t0, "o_orderkey")


DAILY = "SELECT CAST(ts AS DATE) AS d, avg(value) AS v FROM events GROUP BY 1"


@query("jn7_lookback", f"WITH s AS ({DAILY}) SELECT t.d AS day, count(*) AS n_days, avg(s.v) AS v_mean, min(s.v) AS v_min, max(s.v) AS v_max, string_agg(CAST(s.d AS VARCHAR), ',' ORDER BY s.d) AS days FROM s t JOIN s ON s.d >= t.d - 7 AND s.d < t.d GROUP BY 1")
def jn7(spark, d):
    s = table(spark, d, "events").groupBy(F.to_date("ts").alias("d")).agg(F.avg("value").alias("v"))
    return J.lookback(s.select(F.col("d").alias("day")), "day", s, "d", ["v"]).where("n_days is not null")


@query("jn8_monthly_signal", "WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS k, count(*) AS n FROM orders GROUP BY 1) SELECT CAST(d AS DATE) AS day, a.n AS previous, CASE WHEN b.n <> 0 THEN (a.n - b.n) / b.n END AS change FROM (SELECT DISTINCT o_orderdate AS d FROM orders) LEFT JOIN m a ON a.k = CAST(date_trunc('month', d) - INTERVAL 1 MONTH AS DATE) LEFT JOIN m b ON b.k = CAST(date_trunc('month', d) - INTERVAL 2 MONTH AS DATE)")
def jn8(spark, d):
    o = table(spark, d, "orders")
    m = o.groupBy(F.trunc("o_orderdate", "MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return J.monthly_signal(o.select(F.to_date("o_orderdate").alias("day")).distinct(), "day", m, "month", "n").select("day", "previous", "change")


@query("jn9_school_by_month", "SELECT CAST(d AS DATE) AS day, CASE WHEN month(d) IN (7, 8) THEN 'summer_break' WHEN month(d) IN (1, 2) THEN 'winter_break' ELSE 'in_session' END AS school, '' AS holidays FROM (SELECT DISTINCT o_orderdate AS d FROM orders)")
def jn9(spark, d):
    return J.school_status(table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct(), "day", None)


CAL = [(0, "School Season", "Autumn term", "1997-09-01", "1997-12-20"), (1, "School Vacation", "Summer break", "1997-07-01", "1997-08-31"), (2, "School Vacation", "Harvest days", "1997-10-01", "1997-10-07"), (3, "Public Holiday", "National day", "1997-10-01", "1997-10-03"), (4, "Other Holiday", "Founders day", "1997-10-02", "1997-10-02")]


@query("jn9_school_calendar", "WITH c(position, type, event_name, a, b) AS (VALUES " + ", ".join(f"({p}, '{t}', '{n}', DATE '{a}', DATE '{b}')" for p, t, n, a, b in CAL) + "), d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE year(o_orderdate) = 1997), h AS (SELECT day, position, type, event_name, CASE WHEN type = 'School Vacation' THEN CASE WHEN contains(event_name, 'Summer') THEN 'summer_break' WHEN contains(event_name, 'Winter') THEN 'winter_break' ELSE 'vacation' END WHEN type = 'School Season' THEN 'in_session' END AS s FROM d JOIN c ON day BETWEEN a AND b) SELECT d.day, coalesce(arg_max(s, position) FILTER (s IS NOT NULL), 'in_session') AS school, coalesce(string_agg(event_name, ',' ORDER BY position) FILTER (contains(type, 'Holiday')), '') AS holidays FROM d LEFT JOIN h USING (day) GROUP BY 1")
def jn9c(spark, d):
    c = spark.createDataFrame(CAL, "position int, type string, event_name string, date_start string, date_end string").withColumns({k: F.to_date(k) for k in ("date_start", "date_end")})
    days = table(spark, d, "orders").where("year(o_orderdate) = 1997").select(F.to_date("o_orderdate").alias("day")).distinct()
    return J.school_status(days, "day", c)


@query("jn13_rejected_pairs", "WITH r AS (SELECT conv_id * 1000 + turn AS key, role, text, row_number() OVER (PARTITION BY role ORDER BY ((conv_id * 1000 + turn) * 2654435761) % 4294967296, conv_id * 1000 + turn) AS i, count(*) OVER (PARTITION BY role) AS n FROM conversations) SELECT a.key, a.role, b.key AS other FROM r a JOIN r b ON a.role = b.role AND b.i = a.i % a.n + 1")
def jn13(spark, d):
    c = table(spark, d, "conversations").withColumn("key", F.col("conv_id") * 1000 + F.col("turn"))
    return J.rejected_pairs(c, "key", "key", "role").select("key", "role", F.col("rejected").alias("other"))


# scalar functions


@query("sc2_iso_weeks", "SELECT CAST(o_orderdate AS DATE) AS day, CAST(isoyear(o_orderdate) AS INTEGER) AS iso_year, CAST(week(o_orderdate) AS INTEGER) AS iso_week, CASE WHEN month(o_orderdate) IN (3,4,5) THEN 'spring' WHEN month(o_orderdate) IN (6,7,8) THEN 'summer' WHEN month(o_orderdate) IN (9,10,11) THEN 'autumn' ELSE 'winter' END AS season, CAST(CASE WHEN month(o_orderdate) IN (5,6,7) THEN 1.5 WHEN month(o_orderdate) IN (9,10) THEN 1.2 ELSE 1.0 END AS DOUBLE) AS weight, count(*) AS n FROM orders GROUP BY ALL")
def sc2(spark, d):
    t = F.col("o_orderdate")
    return table(spark, d, "orders").groupBy(F.to_date(t).alias("day"), S.iso_year(t).cast("int").alias("iso_year"), S.iso_week(t).alias("iso_week"), S.season(t).alias("season"), S.season_weight(t, {(5, 6, 7): 1.5, (9, 10): 1.2}).alias("weight")).agg(F.count(F.lit(1)).alias("n"))


@query("sc2_month_mondays", "SELECT CAST(month AS DATE) AS month, string_agg(CAST(week(m) AS VARCHAR), ',' ORDER BY m) AS weeks FROM (SELECT month, unnest(generate_series(month, month + INTERVAL 1 MONTH - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS m FROM (SELECT DISTINCT date_trunc('month', o_orderdate) AS month FROM orders)) WHERE isodow(m) = 1 GROUP BY 1")
def sc2m(spark, d):
    m = table(spark, d, "orders").select(F.trunc("o_orderdate", "MM").alias("month")).distinct()
    return m.select("month", F.array_join(S.month_mondays(F.col("month")).cast("array<string>"), ",").alias("weeks"))


@query("sc4_year_months", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def sc4(spark, d):
    text = F.concat(F.lit("report of "), F.date_format("o_orderdate", "yyyy"), F.lit("/"), F.date_format("o_orderdate", "M"), F.lit(" closed"))
    return table(spark, d, "orders").select("o_orderkey", S.year_month(text).alias("month"))


@query("sc5_first_match", "SELECT doc_id, coalesce(nullif(regexp_extract(t, 'token=\"([0-9a-f]+)', 1), ''), nullif(regexp_extract(t, 'password=([0-9a-f]+)', 1), '')) AS found FROM (SELECT doc_id, regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', '', 'g') AS t FROM documents)")
def sc5(spark, d):
    return table(spark, d, "documents").select("doc_id", S.first_match(F.col("text"), ['token="([0-9a-f]+)', "password=([0-9a-f]+)"]).alias("found"))


@query("sc7_whole_hours", "SELECT event_id, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3600000000.0) AS BIGINT) AS hours, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400000000.0) AS BIGINT) AS days FROM events")
def sc7(spark, d):
    t0 = F.lit("2024-01-01").cast("timestamp")
    return table(spark, d, "events").select("event_id", S.whole_hours(F.col("ts"), t0).alias("hours"), S.whole_days(F.col("ts"), t0).alias("days"))


@query("sc9_json_numbers", "SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.forecast') AS DOUBLE), try_cast(json_extract_string(props, '$.k') AS DOUBLE)) AS v FROM events")
def sc9(spark, d):
    return table(spark, d, "events").select("event_id", S.json_number(F.col("props"), ["$.forecast", "$.k"]).alias("v"))


@query("sc9_embedded_json", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS v FROM events")
def sc9b(spark, d):
    from epispark.functions.helpers import json_object_in

    prose = F.concat(F.lit("Answer {not closed: "), F.col("props"), F.lit(" and }} more"))
    return table(spark, d, "events").select("event_id", S.json_number(json_object_in(prose), ["$.k"]).alias("v"))


@query("sc10_event_scores", "SELECT event_id, greatest(-1, least(1, value / 50 - 1)) AS impact, greatest(0, least(1, coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE value / 100 END, 0.5))) AS confidence FROM events")
def sc10(spark, d):
    c = F.coalesce(F.when(F.col("event_id") % 3 != 0, F.col("value") / 100), F.lit(0.5))
    return table(spark, d, "events").select("event_id", S.clamp(F.col("value") / 50 - 1, -1.0, 1.0).alias("impact"), S.clamp(c, 0.0, 1.0).alias("confidence"))


@query("sc11_payloads", "SELECT o_custkey, '{\"id\":' || o_custkey || ',\"recent\":[' || string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) || ']}' AS payload FROM orders GROUP BY 1")
def sc11(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("recent"))
    return g.select("o_custkey", F.to_json(F.struct(F.col("o_custkey").alias("id"), "recent")).alias("payload"))


@query("sc12_query_text", "SELECT CAST(day AS DATE) AS day, concat_ws(' ', 'outbreak', monthname(day), CASE WHEN v >= 51 THEN 'high' WHEN v < 49 THEN 'low' END) AS q FROM (SELECT CAST(ts AS DATE) AS day, avg(value) AS v FROM events GROUP BY 1)")
def sc12(spark, d):
    s = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    return s.select("day", F.concat_ws(" ", F.lit("outbreak"), F.date_format("day", "MMMM"), F.when(F.col("v") >= 51, "high").when(F.col("v") < 49, "low")).alias("q"))


@query("sc13_prompts", "SELECT a.conv_id, a.turn, 'Question: ' || a.text AS prompt, b.text AS completion FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant' AND length(trim(a.text)) > 0 AND length(trim(b.text)) > 0")
def sc13(spark, d):
    c = table(spark, d, "conversations")
    b = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("completion"))
    full = lambda x: F.length(F.trim(x)) > 0
    return c.where("role = 'user'").join(b, ["conv_id", "turn"]).where(full(F.col("text")) & full(F.col("completion"))).select("conv_id", "turn", S.labelled_text([("Question", F.col("text"))]).alias("prompt"), "completion")


@query("sc14_ordered_quantiles", "SELECT event_id, least(greatest(value - 60, 0), greatest(value - 30, 0)) AS q05, greatest(value - 30, 0) AS q50, greatest(value - 50, greatest(value - 30, 0)) AS q95 FROM events WHERE value IS NOT NULL")
def sc14(spark, d):
    v = F.col("value")
    return table(spark, d, "events").where("value is not null").select("event_id", S.ordered_quantiles(v - 60, v - 30, v - 50).alias("q")).select("event_id", "q.q05", "q.q50", "q.q95")
