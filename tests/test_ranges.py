"""Orders over a whole table that no single task sorts, against plain Python."""

import random

from pyspark.sql import functions as F

from epispark.operators.aggregates import auroc, running_totals
from epispark.operators.clean import pseudonyms
from epispark.operators.joins import rejected_pairs
from epispark.operators.text import category_codes


def test_running_totals(spark):
    r = random.Random(1)
    for make in (lambda: r.random() * 1e6, lambda: f"k{r.randrange(10**6)}"):
        rows = sorted({(k % 2, make()) for k in range(3000)})
        kind = "double" if isinstance(rows[0][1], float) else "string"
        df = spark.createDataFrame([(g, v, k % 7) for k, (g, v) in enumerate(rows)], f"g int, v {kind}, n long").repartition(5)
        got = {(x["g"], x["v"]): x["t"] for x in running_totals(df, ["g"], "v", "n", "t").collect()}
        total, want = {0: 0, 1: 0}, {}
        for k, (g, v) in enumerate(rows):
            total[g] += k % 7
            want[g, v] = total[g]
        assert got == want
    assert running_totals(df.limit(0), ["g"], "v", "n", "t").count() == 0


def test_codes_and_pseudonyms_are_dense_and_in_order(spark):
    values = [f"v{(k * 7919) % 1000}" for k in range(2000)] + [None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    want = {v: k for k, v in enumerate(sorted({v for v in values if v}))}
    assert {x["value"]: x["code"] for x in category_codes(df, "v").collect()} == want
    assert {x["id"]: x["pseudonym"] for x in pseudonyms([(df, "v"), (df, "v")]).collect()} == {v: f"P{k + 1:06d}" for v, k in want.items()}


def test_auroc(spark):
    r = random.Random(2)
    rows = [(r.randrange(2), round(r.random(), 2)) for _ in range(1500)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(auroc(spark.createDataFrame(rows, "y int, s double"), "y", "s").first()["auroc"] - want) < 1e-9


def test_rejected_pairs_go_round(spark):
    rows = [(k, f"a{k}", "g" if k % 3 else "h") for k in range(500)] + [(1000, None, "h"), (1001, "alone", "i")]
    df = spark.createDataFrame(rows, "key long, answer string, grp string").withColumn("key", F.col("key"))
    got = {x["key"]: x["rejected"] for x in rejected_pairs(df, "key", "answer", "grp", buckets=16).collect()}
    for grp in "ghi":
        mine = sorted((k * 2654435761 % 4294967296, k, a) for k, a, g in rows if g == grp)
        for (_, k, _), (_, _, a) in zip(mine, mine[1:] + mine[:1], strict=True):
            assert got[k] == a


def test_crps_of_rows_is_that_of_arrays(spark):
    from epispark.operators.series import crps_rows, crps_samples

    r = random.Random(3)
    rows = [(k % 5, round(r.gauss(0, 3), 1)) for k in range(400)] + [(9, 1.0)]
    df = spark.createDataFrame(rows, "key int, x double")
    arrays = df.groupBy("key").agg(F.collect_list("x").alias("xs")).select("key", crps_samples(F.lit(0.5), F.col("xs")).alias("crps"))
    a, b = ({x["key"]: round(x["crps"], 9) for x in d.collect()} for d in (arrays, crps_rows(df, "key", F.lit(0.5), "x")))
    assert a == b


def test_step_flags_in_parts(spark):
    """More events make more tasks; the flags are those of plain counting."""
    from epispark.operators.aggregates import step_flags

    rng = random.Random(4)
    events = [(rng.randrange(60), rng.randrange(12), rng.random() < 0.3) for _ in range(1000)]
    stays = spark.createDataFrame([(k, k % 5) for k in range(50)], "k int, t0 int")
    out = step_flags(stays, spark.createDataFrame(events, "k int, t int, hit boolean"), "k", F.col("t") - F.col("t0"), {"hit": F.col("hit")}, part=50)
    want = {}
    for k, t, hit in events:
        if k < 50 and t >= k % 5:
            want[k, t - k % 5] = max(want.get((k, t - k % 5), 0), int(hit))
    assert {(r["k"], r["time_idx"]): r["hit"] for r in out.collect()} == want
    assert out.rdd.getNumPartitions() >= 20
