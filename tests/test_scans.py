import random

import pytest
from pyspark.sql import functions as F

from stormgrid.operators import evaluation, metrics, splits
from stormgrid.sources import satellite


def test_kelvin_takes_the_ends_of_the_table(spark):
    table = spark.createDataFrame([(i, 300.0 - i) for i in range(4)], "idx long, kelvin double")
    got = satellite.kelvin(spark.createDataFrame([(-3,), (0,), (2,), (9,)], "n int"), F.col("n"), table)
    assert {r["n"]: r["kelvin"] for r in got.collect()} == {-3: 300.0, 0: 300.0, 2: 298.0, 9: 297.0}
    with pytest.raises(ValueError):
        satellite.kelvin(got, F.col("n"), table.where("idx <> 1"))


def test_flashes_by_quality_and_frame(spark):
    start = satellite.J2000 + 600
    rows = [(20.0, 75.0, 600.0, 0), (20.0, 75.0, 899.9, 0), (20.0, 75.0, 900.0, 0), (20.0, 75.0, 700.0, 1), (20.0, 75.0, 599.0, 0), (60.0, 75.0, 650.0, 0)]
    got = satellite.flash_frames(spark.createDataFrame(rows, "lat double, lon double, offset_s double, quality int"), start, 2, 20.0, 75.0)
    assert sorted((r["frame"], r["flashes"]) for r in got.collect()) == [(0, 2), (1, 1)]


def test_windows_of_splits(spark):
    frames = spark.createDataFrame([("a", 0, 30), ("b", 0, 30), ("c", 0, 30)], "day string, first_frame long, last_frame long")
    owner = spark.createDataFrame([("a", "train"), ("b", "val"), ("c", "test")], "day string, split string")
    got = splits.split_windows(owner, frames, "day", 2, 5, 1, {"test": 1})
    t0 = {x: sorted(r["t0"] for r in got.collect() if r["split"] == x) for x in ("train", "val", "test")}
    assert t0["train"] == [1, 3, 5, 7, 9, 11] and t0["val"] == [1, 6, 11] and len(t0["test"]) == 1
    with pytest.raises(ValueError):
        splits.split_windows(owner.union(spark.createDataFrame([("a", "test")], owner.schema)), frames, "day")


def test_ranking_over_slices(spark):
    """Average ranks and average precision by their definitions, with ties, tiny, zero and negative scores."""
    rng = random.Random(5)
    rows = [(k, rng.choice([0.0, -0.5, 1e-7 * rng.randrange(1, 9), rng.random() / 900, rng.random(), round(rng.random(), 1)]), rng.random() < 0.3) for k in ("x", None) for _ in range(400)]
    got = {r["k"]: r for r in metrics.ranking(spark.createDataFrame(rows, "k string, p double, o boolean"), ["k"], "p", F.col("o")).collect()}
    for k in ("x", None):
        pos, neg = ([p for kk, p, o in rows if kk == k and o == w] for w in (True, False))
        assert got[k]["auroc"] == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg), abs=1e-6)
        assert got[k]["auprc"] == pytest.approx(sum(sum(b >= a for b in pos) / sum(b >= a for b in pos + neg) for a in pos) / len(pos), abs=1e-6)


ROWS = "model string, kind string, auprc double, csi double, ni_auprc double, ni_csi double"


def _said(spark, rows, problems=()):
    return evaluation.verdict(spark.createDataFrame(rows, ROWS), list(problems)).first()


def test_comparison_with_missing_values(spark):
    s = spark.createDataFrame([("l", "learned", 0.5, None, 0.1, 0.2), ("advection", "baseline", 0.4, 0.2, 0.2, 0.2), ("persistence", "baseline", 0.9, 0.9, 0.9, 0.9)], ROWS)
    got = {r["metric"]: r for r in evaluation.compared(s).collect()}
    assert set(got) == {"auprc", "csi", "ni_auprc", "ni_csi"} and {r["reference"] for r in got.values()} == {"advection"}
    assert got["auprc"]["learned_wins"] and got["auprc"]["relative"] == 0.25
    assert not got["csi"]["comparable"] and not got["csi"]["learned_wins"] and got["csi"]["margin"] is None
    assert got["ni_auprc"]["margin"] == pytest.approx(-0.1) and not got["ni_csi"]["learned_wins"]


def test_verdict_by_hand(spark):
    """The aggregate AUPRC decides, whatever the other scores say; only problems of the test split withhold it."""
    adv, rule = ("advection", "baseline", 0.4, 0.9, 0.3, 0.9), ("charging_rule", "baseline", 0.3, 0.9, 0.05, 0.9)
    r = _said(spark, [("a", "learned", 0.45, 0.1, 0.1, 0.1), ("blend_a", "blend", 0.41, 0.1, None, 0.1), adv, rule], ["val: fewer than 500 positives"])
    assert (r["verdict"], r["best_learned"], r["best_overall"], r["best_new_initiation"]) == ("beats both", "a", "a", "advection")
    assert (r["ni_beats_advection"], r["ni_beats_charging_rule"], r["test_split_usable"]) == (False, True, True)
    assert _said(spark, [("a", "learned", 0.35, 1.0, 1.0, 1.0), adv, rule])["verdict"] == "beats charging_rule only"
    assert _said(spark, [("a", "learned", 0.4, 1.0, 1.0, 1.0), adv, ("charging_rule", "baseline", 0.5, 0.0, 0.0, 0.0)])["verdict"] == "beats neither"
    assert _said(spark, [("a", "learned", 0.45, 1.0, 1.0, 1.0), adv, ("charging_rule", "baseline", None, 0.0, 0.0, 0.0)])["verdict"] == "beats advection only"
    assert _said(spark, [("a", "learned", 0.9, 1.0, 1.0, 1.0), adv, rule], ["test: all from one event"])["verdict"] == "withheld"
    assert _said(spark, [("a", "learned", None, 1.0, 1.0, 1.0), adv, rule])["verdict"] == "nothing to claim"


def test_threshold_without_anything_to_score(spark):
    d = spark.createDataFrame([("m", 0.001, 0.0), ("m", 0.002, 0.0)], "model string, p double, lit double")
    assert tuple(evaluation.choose_thresholds(d, ["model"], "p", "lit").first()) == ("m", 0.15, None, None)
    assert len(evaluation.CHOICES) == 14
