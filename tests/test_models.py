import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from risklattice.functions.scalar import sigmoid
from risklattice.operators import models
from risklattice.plans import QUERIES


@pytest.fixture(scope="module")
def panel(spark):
    random.seed(11)
    rows = []
    for a in range(12):
        for t in range(60):
            x, z = random.gauss(0, 1), random.gauss(0, 1)
            y = int(random.random() < 1 / (1 + np.exp(-(1.5 * x - 0.5 * z - 1))))
            rows.append((f"A{a:02d}", t, x, z, 1.0, y, y + (y and random.randint(0, 2)), t))
    return spark.createDataFrame(rows, "area string, t int, x double, z double, flat double, y int, events int, week int").cache()


def test_logistic_recovers_signs_and_survives_a_constant(panel):
    m = models.Learner(["x", "z", "flat"]).fit(panel)
    w = m.coefficients()
    assert w["x"] > 1 and w["z"] < 0 and abs(w["flat"]) < 1e-6
    p = m.score(panel)
    assert p.filter("score < 0 or score > 1").count() == 0 and p.count() == panel.count()


def test_logistic_matches_newton(panel):
    """Same penalised optimum as a small dense solver: loss sum + |w|^2 / 2, free intercept."""
    rows = np.array([tuple(r) for r in panel.select("x", "z", "y").collect()])
    x, y = rows[:, :2], rows[:, 2]
    x = np.c_[(x - x.mean(0)) / x.std(0), np.ones(len(x))]
    w, reg = np.zeros(3), np.diag([1.0, 1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + reg, x.T @ (p - y) + reg @ w)
    got = models.Learner(["x", "z"]).fit(panel).coefficients()
    assert np.allclose([got["x"], got["z"]], w[:2], atol=1e-3)


def test_calibration_splits_by_area_and_averages(panel):
    split = models.area_split(panel)
    assert split.groupBy("area").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    cal = models.Calibrated.fit(models.Learner(["x", "z"]), split)
    assert len(cal.parts) == 3
    out = cal.score(split)
    gap = out.agg(F.abs(F.avg("score") - F.avg("y"))).first()[0]
    assert gap < 0.05
    with pytest.raises(ValueError, match="fewer than 50"):
        models.Calibrated.fit(models.Learner(["x"]), split.filter("t < 5"))


def test_hurdle_stage(panel):
    stage = models.poisson_stage(panel, ["x", "z", "flat"])
    out = models.severity(models.Learner(["x", "z"]).fit(panel).score(panel), stage)
    assert out.filter("severity < 1").count() == 0
    with pytest.raises(ValueError, match="too few"):
        models.poisson_stage(panel.filter("t < 3"), ["x"])


def test_stack_orders_bases(panel):
    bases = {"good": models.Learner(["x", "z"]), "poor": models.Learner(["flat", "z"])}
    scored, weights = models.stack(panel.filter("t < 50"), panel.filter("t >= 50"), bases, F.col("t") >= 35)
    table = {(w.meta, w.base): w.weight for w in weights.collect()}
    assert all(table[m, "good"] > table[m, "poor"] for m in models.META)
    assert scored.filter("ensemble is null or ensemble_unweighted is null").count() == 0


def test_recalibration_hits_target_keeps_order_or_leaves_alone(spark):
    rows = [(7, 0.05 + 0.9 * i / 99) for i in range(100)] + [(14, 0.2)] * 3
    df = spark.createDataFrame(rows, "horizon int, p double")
    targets = spark.createDataFrame([(7, 0.1), (14, 1e-9)], "horizon int, target double")
    out = models.recalibrate(df, "p", targets, "horizon")
    mean = out.filter("horizon = 7").agg(F.avg("recalibrated")).first()[0]
    assert abs(mean - 0.1) < 1e-6
    pairs = [tuple(r) for r in out.filter("horizon = 7").select("p", "recalibrated").orderBy("p").collect()]
    assert all(a[1] < b[1] for a, b in zip(pairs, pairs[1:]))
    kept = out.filter("horizon = 14").first()
    assert kept.shift is None and kept.recalibrated == 0.2


def test_contributions_add_up(panel):
    m = models.Learner(["x", "z", "flat"]).fit(panel)
    long = models.contributions(panel, ["area", "t"], m.scaler, m.coefficients(), {"x": "both", "z": "both"})
    total = long.groupBy("area", "t").agg(F.sum("contribution").alias("c"))
    scored = m.score(panel).join(total, ["area", "t"]).withColumn("p", sigmoid(F.col("c") + m.intercept()))
    assert scored.agg(F.max(F.abs(F.col("p") - F.col("score")))).first()[0] < 1e-9
    top = models.top_drivers(long, ["area", "t"], 2).collect()
    assert all((r.value is None) == (r.n_features > 1) for r in top)


def test_rolling_origin_scores_each_test_week_once(panel):
    out = models.rolling_origin(panel, models.Learner(["x", "z"]), 2, 10, 59)
    assert out.count() == 12 * 20 and out.groupBy("area", "t").count().filter("count > 1").count() == 0
    assert [r[0] for r in out.filter("fold = 2").agg(F.min("t")).collect()] == [50]


def test_experiments_run(panel):
    learner = models.Learner(["x", "z"])
    h = models.horizon_experiment(panel.drop("y"), [1, 2], learner, 1, 10, 59, 3)
    assert sorted(r.horizon_days for r in h.collect()) == [7, 14]
    schemes = models.calibration_schemes(panel.filter("t < 50"), panel.filter("t >= 50"), learner, 3)
    assert {r.scheme for r in schemes.collect()} == {"none", "rows by area", "rows by week", "expanding time", "explicit by area"}


def test_balanced_fit_weighs_its_own_rows(panel):
    """Balancing inside the fit equals explicit weights from the same rows."""
    explicit = models.Learner(["x", "z"], weight="w").fit(models.balanced_weights(panel, "y", "w")).coefficients()
    inside = models.Learner(["x", "z"], balanced=True).fit(panel).coefficients()
    assert np.allclose(list(explicit.values()), list(inside.values()), atol=1e-6)


def test_poisson_stage_matches_newton(panel):
    """Penalised mean Poisson loss, alpha = 1, intercept free."""
    rows = np.array([tuple(map(float, r)) for r in panel.filter("events > 0").select("x", "z", "events").collect()])
    x, y = rows[:, :2], rows[:, 2] - 1
    x = np.c_[(x - x.mean(0)) / x.std(0), np.ones(len(x))]
    w, reg = np.zeros(3), np.diag([1.0, 1.0, 0.0]) * len(x)
    for _ in range(60):
        mu = np.exp(x @ w)
        w -= np.linalg.solve((x * mu[:, None]).T @ x + reg, x.T @ (mu - y) + reg @ w)
    scaler, used, model = models.poisson_stage(panel, ["x", "z"])
    fitted = model.stages[-1]
    assert np.allclose([*fitted.coefficients, fitted.intercept], w, atol=1e-3)


def test_row_order_splits_are_contiguous_in_each_class(panel):
    rows = models.row_order_splits(panel, ["t", "area"]).select("t", "area", "y", "split").collect()
    for y in (0, 1):
        own = [r.split for r in sorted((r for r in rows if r.y == y), key=lambda r: (r.t, r.area))]
        assert own == sorted(own) and max(own.count(i) for i in range(3)) - min(own.count(i) for i in range(3)) <= 1


def test_expanding_masks_fit_before_they_calibrate(panel):
    for before, block in models.expanding_masks(59, 0):
        low, high = panel.filter(block).agg(F.min("t"), F.max("t")).first()
        assert panel.filter(before).agg(F.max("t")).first()[0] == low - 1 and high - low == 14


def test_boosting_weighted_and_calibrated_protocols_run_small(panel, spark):
    """The long queries' learners and protocols, with few trees and folds."""
    boosting = models.Learner(["x", "z"], kind="boosting", params={"maxIter": 3, "maxDepth": 2})
    scored = boosting.fit(panel.filter("t < 40")).score(panel.filter("t >= 40"))
    assert scored.filter("score between 0 and 1").count() == 240
    assert scored.corr("score", "x") > 0.5
    weights = spark.createDataFrame([(f"A{a:02d}", 0.5 + a / 12) for a in range(12)], "area string, weight double")
    found = models.under_reporting_experiment(panel, weights, models.Learner(["x", "z"]), 2, 10, 59, k=3).collect()
    assert sorted({(r.weighting, r.fold) for r in found}) == [("inverse detection", 1), ("inverse detection", 2), ("none", 1), ("none", 2)]
    schemes = models.calibration_schemes(panel.filter("t < 50"), panel.filter("t >= 50"), models.Learner(["x", "z"]), k=3).collect()
    assert len(schemes) == 5 and all(0 <= r.brier <= 0.3 for r in schemes)


def test_stack_returns_weights_of_all_bases_and_metas(panel):
    rows = models.area_split(panel)
    bases = {"a": models.Learner(["x"]), "b": models.Learner(["z"]), "c": models.Learner(["x", "z"], kind="forest", params={"numTrees": 3, "maxDepth": 3})}
    scored, weights = models.stack(rows.filter("t < 50"), rows.filter("t >= 50"), bases, F.col("t") >= 40, calibrated=("a",))
    assert {(r.meta, r.base) for r in weights.collect()} == {(m, b) for m in models.META for b in bases}
    assert {"p_a", "p_b", "p_c", *models.META} <= set(scored.columns) and scored.count() == 120


@pytest.mark.parametrize("kind", ["logistic", "forest"])
@pytest.mark.parametrize("label", [0, 1])
def test_balanced_fit_on_one_class_gives_that_class(panel, kind, label):
    one = panel.filter(F.col("y") == label)
    fitted = models.Learner(["x", "z"], kind=kind, balanced=True).fit(one)
    assert fitted.score(panel).agg(F.min("score"), F.max("score")).first()[:] == (float(label), float(label))
    assert set(fitted.coefficients().values()) == {0.0}
    with pytest.raises(ValueError, match="no rows"):
        models.Learner(["x", "z"], kind=kind, balanced=True).fit(panel.filter("false"))


def test_recalibration_to_the_end_of_the_bracket(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (2, 0.3), (2, 0.4)], "fold int, p double")
    targets = spark.createDataFrame([(1, 1.0), (2, 0.0)], "fold int, target double")
    out = models.recalibrate(df, "p", targets, "fold", to_end=True).collect()
    assert all(abs(x["shift"] - (12.0 if x["fold"] == 1 else -12.0)) < 1e-6 for x in out)
    assert all(x["recalibrated"] > 0.9999 if x["fold"] == 1 else x["recalibrated"] < 0.0001 for x in out)


def test_protocols_run_on_panels_of_one_class(panel):
    """Labels that are always 1, as where every area has an event in every week."""
    ones = panel.withColumns({"y": F.lit(1), "events": F.lit(1.0) + F.pmod("t", F.lit(3))}).cache()
    learner = models.Learner(["x", "z"], balanced=True)
    weights = ones.groupBy("area").agg(F.lit(2.0).alias("weight"))
    found = [
        models.horizon_experiment(ones.drop("y"), [1, 2], learner, 2, 10, 59, 5),
        models.delay_experiment(lambda d: ones, [0, 1], learner, 2, 10, 59, 5),
        models.under_reporting_experiment(ones, weights, learner, 2, 10, 59, 5),
        models.calibration_schemes(ones.filter("t < 50"), ones.filter("t >= 50"), learner, 5),
    ]
    assert [f.count() for f in found] == [4, 4, 4, 5]
    assert all(r.base_rate == 1.0 and r.average_precision == 1.0 and r.brier == 0.0 and r.roc_auc is None for f in found for r in f.collect())
    scored = models.severity(models.Calibrated.fit(learner, models.area_split(ones)).score(ones), models.poisson_stage(ones, ["x", "z"]))
    assert scored.filter("score <> 1 or severity < 1 or expected <> severity").count() == 0


@pytest.fixture(scope="module")
def busy(spark, sf, tmp_path_factory):
    """Driver tables in which every nation has two or three urgent orders in every one of 330 weeks, as in large copies."""
    root = str(tmp_path_factory.mktemp("busy"))
    for name in ("nation", "region"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{root}/{name}.parquet")
    like = {name: spark.read.parquet(f"{sf}/{name}.parquet").schema for name in ("customer", "orders")}
    customer = spark.range(25).select((F.col("id") + 1).alias("c_custkey"), F.col("id").alias("c_nationkey"), F.lit("BUILDING").alias("c_mktsegment"))
    place, copy = F.floor(F.col("id") / 3), F.col("id") % 3
    orders = spark.range(330 * 25 * 3).select(
        F.col("id").alias("o_orderkey"), (place % 25 + 1).alias("o_custkey"), F.when(copy == 1, "O").otherwise("F").alias("o_orderstatus"), (100.0 + F.col("id") % 7).alias("o_totalprice"),
        F.date_add(F.lit("1992-01-06").cast("date"), (F.floor(place / 25) * 7).cast("int")).alias("o_orderdate"),
        F.when((copy == 2) & (F.col("id") % 2 == 0), "5-LOW").otherwise("1-URGENT").alias("o_orderpriority"),
    )
    for name, df in (("customer", customer), ("orders", orders)):
        df.select(*[F.col(f.name).cast(f.dataType) for f in like[name] if f.name in df.columns]).write.parquet(f"{root}/{name}.parquet")
    return root


# Rows and, where every row says the same, that value.
BUSY = {
    "M3_logistic": (1300, {"y": 1, "score": 1.0}),
    "M5_calibrated_logistic": (1300, {"y": 1, "score": 1.0}),
    "M6_forest": (1300, {"y": 1, "score": 1.0}),
    "M8_hurdle": (1300, {}),
    "M17_horizon_experiment": (15, {"base_rate": 1.0, "brier": 0.0}),
    "M18_delay_experiment": (15, {"base_rate": 1.0, "brier": 0.0}),
    "M19_under_reporting_experiment": (10, {"base_rate": 1.0, "brier": 0.0}),
    "M20_calibration_schemes": (5, {"base_rate": 1.0, "brier": 0.0}),
}


@pytest.mark.parametrize("key", BUSY)
def test_queries_run_where_every_area_has_an_event_every_week(spark, busy, key):
    rows, same = BUSY[key]
    found = QUERIES[key](spark, busy).collect()
    assert len(found) == rows and all(x[c] == v for x in found for c, v in same.items())
    if key == "M8_hurdle":
        assert all(x.severity == x.expected and abs(x.severity - x.events) < 0.2 for x in found)
