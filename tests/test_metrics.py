"""Golden values of the metrics, worked by hand."""

from math import isclose

import pytest
from pyspark.sql import functions as F

from stormgrid.operators import metrics as M


def one(df):
    return df.first().asDict()


def pairs(spark):
    rows = [(True, True, True)] * 3 + [(True, False, True)] * 2 + [(False, True, True)] * 4 + [(False, False, True)] * 11
    return spark.createDataFrame(rows + [(True, False, False)] * 30, "pred boolean, obs boolean, ok boolean")


def test_contingency(spark):
    r = one(M.contingency(pairs(spark), [], F.col("pred"), F.col("obs"), F.col("ok")))
    assert (r["hits"], r["false_alarms"], r["misses"], r["correct_negatives"]) == (3, 2, 4, 11)
    for k, v in {"pod": 3 / 7, "far": 2 / 5, "csi": 3 / 9, "bias": 5 / 7, "hss": 5 / 17, "ets": 5 / 29}.items():
        assert isclose(r[k], v, abs_tol=1e-6), k


def test_nothing_scores_null(spark):
    r = one(M.contingency(pairs(spark).where("false"), [], F.col("pred"), F.col("obs")))
    assert r["csi"] is None and r["pod"] is None


@pytest.mark.parametrize("labels,key,value", [("1011000100", "auprc", 35 / 48), ("1110100100", "auroc", 21 / 25)])
def test_ranking(spark, labels, key, value):
    df = spark.createDataFrame([(float(10 - i), c == "1") for i, c in enumerate(labels)], "p double, y boolean")
    assert isclose(one(M.ranking(df, [], "p", F.col("y")))[key], value, abs_tol=1e-6)


def test_ranking_ties_and_one_class(spark):
    df = spark.createDataFrame([(1.0, i % 2 == 0) for i in range(10)], "p double, y boolean")
    r = one(M.ranking(df, [], "p", F.col("y")))
    assert r["auprc"] == 0.5 and r["auroc"] == 0.5
    r = one(M.ranking(df.withColumn("y", F.lit(False)), [], "p", F.col("y")))
    assert r["auprc"] is None and r["auroc"] is None


def test_brier(spark):
    rows = [(p, i < round(100 * p)) for p in (0.05, 0.25, 0.45, 0.65, 0.85) for i in range(100)]
    r = one(M.brier(spark.createDataFrame(rows, "p double, y boolean"), [], "p", F.col("y")))
    assert r["reliability"] < 1e-4 and isclose(r["uncertainty"], 0.2475, abs_tol=1e-6)
    r = one(M.brier(spark.createDataFrame([(0.9, i < 20) for i in range(200)], "p double, y boolean"), [], "p", F.col("y")))
    assert isclose(r["reliability"], 0.64, abs_tol=1e-6)


def field(spark, ones, other, n=64):
    rows = [(0, r, c, float((r, c) in ones), float((r, c) in other)) for r in range(n) for c in range(n)]
    return spark.createDataFrame(rows, "day int, row int, col int, p double, lit double")


def test_fss(spark):
    a, b = {(3, 3), (3, 4)}, {(3, 6), (3, 7)}
    assert one(M.fss(field(spark, a, a), ["day"], "p", "lit", 2))["fss"] == 1.0
    assert one(M.fss(field(spark, a, b), ["day"], "p", "lit", 0))["fss"] == 0.0
    assert one(M.fss(field(spark, a, b), ["day"], "p", "lit", 4))["fss"] > 0.5


def test_best_threshold_is_lowest_on_ties(spark):
    s = spark.createDataFrame([(0.1, 0.5), (0.2, 0.5), (0.3, None)], "threshold double, csi double")
    assert M.best_csi(s, []).first()["threshold"] == 0.1 and M.select_threshold(s).first()["threshold"] == 0.1
    assert M.select_threshold(s.where("false")).first()["threshold"] == 0.15


def test_ranking_is_the_same_in_slices(spark):
    import random

    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.choice([0.0, -1.0, 1e-9, 0.25, 0.5, float("inf"), rng.random()]), rng.random() < 0.3) for _ in range(400)] + [("b", None, True), ("c", 0.5, True)]
    df = spark.createDataFrame(rows, "k string, p double, o boolean")
    both = [sorted(map(str, M.ranking(df, keys, "p", F.col("o"), sliced=x).collect())) for keys in (["k"], []) for x in (False, True)]
    assert both[0] == both[1] and both[2] == both[3]
