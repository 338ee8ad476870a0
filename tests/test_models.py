"""Early stopping, calibration and the two-phase model: on data whose answer is known, and stored and read again."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import compose as cm
from tickloom.operators import ml
from tickloom.schema import tape_of_events


@pytest.fixture(scope="module")
def noisy(spark):
    """The chance of class 1 is a known function of a; b is noise."""
    rng = np.random.default_rng(1)
    rows = [(i, float(a), float(b), int(u < 1 / (1 + math.exp(-3 * a)))) for i, (a, b, u) in enumerate(zip(rng.normal(size=4000), rng.normal(size=4000), rng.random(4000), strict=True))]
    return spark.createDataFrame(rows, "t long, a double, b double, y int").cache()


def test_trees_stop_when_later_rows_gain_nothing(noisy):
    model = ml.fit_early(noisy, ["a", "b"], "y", "gbt_classifier", "t", trees=60, depth=4, pace=0.3)
    assert 0 < model.stages[-1].getNumTrees < 60
    out = ml.classification_metrics(ml.probabilities(model, noisy), "p_raw", "y").first()
    assert out["auc"] > 0.8 and out["log_loss"] < 0.6
    weighted = ml.fit_early(ml.class_weights(noisy, "y"), ["a", "b"], "y", "gbt_classifier", "t", trees=10, weight="weight")
    assert weighted.stages[-1].getNumTrees <= 10
    with pytest.raises(KeyError):
        ml.fit_early(noisy, ["a"], "y", "ridge", "t")


def pooled(p, y):
    """Isotonic regression by pooling neighbours that break the order."""
    blocks = []
    for x in sorted(set(p)):
        own = [b for a, b in zip(p, y, strict=True) if a == x]
        blocks.append([sum(own), len(own), [x]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, xs = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + xs]
    return {x: s / n for s, n, xs in blocks for x in xs}


def test_calibration_comes_from_held_out_rows(spark, noisy, tmp_path):
    """The map is the pooled one of probabilities that earlier models gave to later rows; it mends a wrong scale."""
    seen = ml.held_out(noisy, ["a", "b"], "y", "logistic", "t", 3)
    assert seen.count() == 3000 and seen.groupBy("fold").agg(F.min("t").alias("t")).filter("fold = 1").first()["t"] == 1000
    model = ml.calibrate(noisy, ["a", "b"], "y", "logistic", "t", 3, reg=0.2)  # shrunk weights: too timid
    rows = ml.held_out(noisy, ["a", "b"], "y", "logistic", "t", 3, reg=0.2).select("p_raw", "y").collect()
    want = pooled([r["p_raw"] for r in rows], [r["y"] for r in rows])
    frame = spark.createDataFrame([(x,) for x in list(want)[::50]], "p_raw double")
    for r in model.isotonic.transform(frame).collect():
        assert r["p"] == pytest.approx(want[r["p_raw"]], abs=1e-6)
    out = model.transform(noisy)
    raw, mapped = (ml.classification_metrics(out, x, "y").first() for x in ("p_raw", "p"))
    assert mapped["calibration_error"] < 0.5 * raw["calibration_error"] and mapped["brier"] < raw["brier"]
    model.save(str(tmp_path / "m"))
    model.save(str(tmp_path / "m"))
    again = ml.Calibrated.load(str(tmp_path / "m")).transform(noisy)
    assert again.select("t", "p").exceptAll(out.select("t", "p")).count() == 0


def test_metrics_of_odd_tables(spark):
    df = spark.createDataFrame([(0.7, 1), (0.7, 0), (0.2, 0), (None, 1), (0.4, None), (1.0, 1)], "p double, y int")
    got = ml.classification_metrics(df, "p", "y").first()
    assert (got["n"], got["accuracy"], got["recall"]) == (4, 0.75, 1.0) and got["auc"] == pytest.approx(3.5 / 4)
    assert [(r["bin"], r["n"]) for r in ml.reliability(df, "p", "y").orderBy("bin").collect()] == [(2, 1), (7, 2), (9, 1)]
    one = ml.classification_metrics(df.filter("y = 1"), "p", "y").first()
    assert one["auc"] is None and one["recall"] == 1.0
    none = ml.classification_metrics(df.limit(0), "p", "y").first()
    assert none["n"] == 0 and none["brier"] is None and none["auc"] is None
    assert ml.reliability(df.limit(0), "p", "y").count() == 0 and ml.class_report(df.limit(0), "y", "y").count() == 0


def test_two_phases(spark, tmp_path):
    """The label is a different function in each cluster, so a classifier needs the cluster."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(900):
        k = i % 3
        x, z = rng.normal(), rng.normal()
        rows.append((i, 10.0 * k + 0.3 * rng.normal(), None if i % 50 == 7 else float(x), float(z), int((x if k == 0 else z if k == 1 else -x) > 0)))
    df = spark.createDataFrame(rows, "i long, where double, x double, z double, y int")
    columns = ["where", "x", "z"]
    model = ml.TwoPhase.fit(df, columns, "y", k=3, trees=20)
    out = model.predict(df.withColumn("cluster_name", F.lit("mine")))
    assert out.columns == ["i", "where", "x", "z", "y", "cluster_name", "cluster", "pred", "pred_proba"]
    assert out.agg(F.avg((F.col("pred") == F.col("y")).cast("double"))).first()[0] > 0.9
    report = ml.cluster_report(out, "y", ["where"]).collect()
    assert len(report) == 3 and sum(r["n"] for r in report) == 900 and out.filter("x is null").count() == 18
    for r in report:
        own = [x for x in out.collect() if x["cluster"] == r["cluster"]]
        assert r["rate"] == pytest.approx(100 * np.mean([x["y"] for x in own])) and r["mean_where"] == pytest.approx(np.mean([x["where"] for x in own]))
    names = [n for n, _ in model.importances()]
    assert sorted(names) == sorted([*columns, "cluster"]) and sum(v for _, v in model.importances()) == pytest.approx(1)
    model.save(str(tmp_path / "two"))
    again = ml.TwoPhase.load(str(tmp_path / "two"))
    assert again.columns == columns
    assert again.predict(df).select("i", "cluster", "pred", "pred_proba").exceptAll(out.select("i", "cluster", "pred", "pred_proba")).count() == 0
    scores = ml.two_phase_scores(df, columns, "y", "i", k=2, trees=10)
    assert len(scores) == 2 and min(scores) > 0.7
    said = {r["class"]: r for r in ml.class_report(out, "pred", "y").collect()}
    assert said[0]["support"] + said[1]["support"] == 900 and said[1]["recall"] > 0.85


def test_two_phases_of_few_rows_and_of_none(spark, tmp_path):
    """Fewer distinct rows than clusters, and a table without rows: the model is fitted, stored and read again all the same."""
    df = spark.createDataFrame([(float(i % 2), 1.0, i % 2) for i in range(8)], "a double, b double, y int")
    out = ml.TwoPhase.fit(df, ["a", "b"], "y", k=3, trees=3).predict(df)
    assert sorted(r["n"] for r in ml.cluster_report(out, "y", ["a"]).collect()) == [4, 4]
    assert ml.clusters(df, ["a", "b"], 3).select("cluster").distinct().count() == 2
    none = df.limit(0)
    model = ml.TwoPhase.fit(none, ["a", "b"], "y", k=3, trees=3)
    model.save(str(tmp_path / "none"))
    again = ml.TwoPhase.load(str(tmp_path / "none"))
    assert again.columns == ["a", "b"] and again.importances() == []
    assert again.predict(none).dtypes == out.dtypes and ml.cluster_report(again.predict(none), "y", ["a"]).count() == 0
    assert again.predict(df).filter("cluster is null and pred is null and pred_proba is null").count() == 8
    assert ml.clusters(none, ["a", "b"], 3).columns == ["a", "b", "y", "cluster"]


def test_gap_matrix_sees_nothing_ahead(spark, sf):
    """Features of a gap are the same when all trades behind its bar are missing; labels are not asked for that."""
    tape = tape_of_events(spark.read.parquet(f"{sf}/events.parquet")).filter("symbol < 3")
    whole = cm.gap_matrix(tape, 21600).toPandas().set_index(["symbol", "bar"]).sort_index()
    cut = int(whole.index.get_level_values("bar")[len(whole) // 2])
    part = cm.gap_matrix(tape.filter(F.unix_seconds("ts") < cut + 21600), 21600).toPandas().set_index(["symbol", "bar"]).sort_index()
    ahead = [c for c in whole.columns if c.startswith(("label", "future", "fill"))]
    known = whole[whole.index.get_level_values("bar") <= cut].drop(columns=ahead)
    assert len(known) > 5 and known.equals(part.drop(columns=ahead)[known.columns])


def test_models_are_fitted_on_rows_that_are_made_once(spark, sf, monkeypatch):
    """A fit passes over its rows many times, so it gets them stored, not as a plan over the tape."""
    from tickloom import queries_models as qm

    seen = []
    for name in ("calibrate", "fit_early", "fit"):
        f = getattr(ml, name)
        monkeypatch.setattr(ml, name, lambda df, *a, f=f, **p: seen.append(df) or f(df, *a, **p))
    qm.calibrated(spark, sf)
    assert seen
    for df in seen:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Aggregate" not in plan
