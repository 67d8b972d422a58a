"""The outcome model and the report of its held-out rows against plain versions."""

import numpy as np

import __spark_entry__
from epispark.operators.text import class_weights, outcome_model

KINDS = ["a", "b", "c"]


def made(n, seed):
    rng = np.random.default_rng(seed)
    x = np.c_[rng.normal(40, 15, n), rng.normal(0, 2, n)]
    kind = rng.integers(0, 3, n)
    y = rng.random(n) < 1 / (1 + np.exp(-(0.05 * (x[:, 0] - 60) + 0.6 * x[:, 1] + np.array([0, 0.8, -0.5])[kind])))
    return x, kind, y.astype(float)


def newton(x, y, cost):
    """Logistic regression by Newton steps; the tiny ridge settles the one direction that leaves probabilities alone."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (cost * p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(len(w)), x.T @ (cost * (p - y)) + 1e-9 * w)
    return w


def frame(spark, x, kind, y):
    rows = [(k, float(a), float(b), KINDS[c], float(t)) for k, ((a, b), c, t) in enumerate(zip(x, kind, y, strict=True))]
    return spark.createDataFrame(rows, "id long, age double, score double, kind string, label double")


def test_weights_balance_the_classes(spark):
    rows = class_weights(spark.createDataFrame([(1.0,)] * 30 + [(0.0,)] * 10, "label double"), "label").collect()
    assert {(r["label"], round(r["weight"], 9)) for r in rows} == {(1.0, round(40 / 60, 9)), (0.0, 2.0)}


def test_probabilities_match_newton_steps(spark):
    x, kind, y = made(1500, 1)
    model = outcome_model(frame(spark, x, kind, y), ["age", "score"], ["kind"], "label")
    cost = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    mean, spread = x.mean(0), x.std(0, ddof=1)
    inputs = lambda x, kind: np.c_[(x - mean) / spread, np.eye(3)[kind], np.ones(len(x))]
    w = newton(inputs(x, kind), y, cost)
    fresh, fresh_kind, fresh_y = made(300, 2)
    scored = model.transform(frame(spark, fresh, fresh_kind, fresh_y)).orderBy("id").collect()
    want = 1 / (1 + np.exp(-inputs(fresh, fresh_kind) @ w))
    assert np.abs(np.array([r["probability"][1] for r in scored]) - want).max() < 2e-3
    # a category that training has not met counts as none of them
    new = model.transform(spark.createDataFrame([(0, 50.0, 1.0, "new"), (1, 50.0, 1.0, None)], "id long, age double, score double, kind string")).collect()
    assert new[0]["probability"] == new[1]["probability"] and 0 < new[0]["probability"][1] < 1


def test_report_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = [r for r in __spark_entry__.queries()["fe3_outcome_model"](spark, sf).collect() if r["split"] == "test"]
    got = {r["label"]: r for r in __spark_entry__.queries()["fe4_held_out"](spark, sf).collect()}
    assert sorted(got) == [0, 1] and rows
    pairs = [(a["p"], b["p"]) for a in rows if a["quality"] == 1 for b in rows if b["quality"] == 0]
    area = sum((a > b) + (a == b) / 2 for a, b in pairs) / len(pairs)
    for label, r in got.items():
        said = [x for x in rows if (x["p"] >= 0.5) == bool(label)]
        support = [x for x in rows if x["quality"] == label]
        hit = len([x for x in said if x["quality"] == label])
        precision, recall = hit / len(said), hit / len(support)
        assert r["support"] == len(support)
        assert abs(r["precision"] - precision) < 1e-9 and abs(r["recall"] - recall) < 1e-9
        assert abs(r["f1"] - 2 * precision * recall / (precision + recall)) < 1e-9
        assert abs(r["auroc"] - area) < 1e-9


def test_outcome_model_does_not_evaluate_its_rows_for_every_pass(spark):
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        seen.add(1)
        return v

    rows = spark.createDataFrame([(float(k % 7), "ab"[k % 2], float(k % 3 == 0)) for k in range(90)], "x double, kind string, y double")
    outcome_model(rows.withColumn("x", counted("x")), ["x"], ["kind"], "y")
    assert 90 <= seen.value <= 180  # once for the weights at most, once for the rows
