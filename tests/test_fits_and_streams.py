"""Fits as sums, isotonic cells, bounded streaming state, the weekly contract and indexed tables."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from risklattice.operators import glm, quality
from risklattice.operators import panel as P
from risklattice.plans.base import table
from risklattice.plans import QUERIES
from risklattice.plans.streams import FEATURE_NAMES, ROCKS, surroundings, weekly_measures
from risklattice.session import scratch_path
from risklattice.sources import contracts
from risklattice.streaming import weekly


def rows_of(spark, n=400, seed=1):
    rng = np.random.RandomState(seed)
    x = rng.randn(n, 2)
    p = 1 / (1 + np.exp(-(0.3 + x @ [1.0, -0.7])))
    return spark.createDataFrame([(float(a), float(b), int(rng.rand() < q), int(rng.poisson(np.exp(0.2 + 0.5 * a)))) for (a, b), q in zip(x, p)], "a double, b double, y int, n int")


@pytest.mark.parametrize("family,label,ridge", [("logistic", "y", 0.0), ("logistic", "y", 0.5), ("poisson", "n", 0.0), ("poisson", "n", 1.0)])
def test_fit_is_where_the_gradient_vanishes(spark, family, label, ridge):
    df = rows_of(spark)
    fit = glm.reweighted_fit(df, ["a", "b"], label, family, ridge=ridge, steps=12)
    rows = np.array([(r.a, r.b, r[label]) for r in df.collect()])
    linear = fit.intercept + rows[:, :2] @ [fit.weights["a"], fit.weights["b"]]
    error = rows[:, 2] - (1 / (1 + np.exp(-linear)) if family == "logistic" else np.exp(linear))
    pull = ridge * np.array([0, fit.weights["a"], fit.weights["b"]])
    assert np.abs(np.array([error.mean(), *(error[:, None] * rows[:, :2]).mean(axis=0)]) - pull).max() < 1e-8


def test_fit_of_odd_rows(spark):
    df = rows_of(spark)
    odd = df.unionByName(spark.createDataFrame([(None, 1.0, 1, 1), (1.0, 1.0, None, None)], df.schema))
    assert glm.reweighted_fit(odd, ["a"], "y") == pytest.approx(glm.reweighted_fit(df, ["a"], "y")) or glm.reweighted_fit(odd, ["a"], "y").intercept == pytest.approx(glm.reweighted_fit(df, ["a"], "y").intercept)
    with pytest.raises(ValueError):
        glm.reweighted_fit(df.filter("false"), ["a"], "y")
    with pytest.raises(ValueError):
        glm.reweighted_fit(df.withColumn("c", F.lit(0.0)), ["a", "c"], "y")


def test_isotonic_cells_equal_pooling(spark):
    rng = random.Random(4)
    points = [(rng.random(), int(rng.random() < 0.5)) for _ in range(500)]
    got = {r.cell: r.level for r in glm.isotonic_cells(spark.createDataFrame([*points, (None, 1)], "p double, y int"), "p", "y").collect()}
    sums = {}
    for p, y in points:
        n, s = sums.get(int(p * 100), (0, 0))
        sums[int(p * 100)] = (n + 1, s + y)
    pools = []  # adjacent violators
    for cell in sorted(sums):
        pools.append([[cell], *sums[cell]])
        while len(pools) > 1 and pools[-2][2] / pools[-2][1] >= pools[-1][2] / pools[-1][1]:
            cells, n, s = pools.pop()
            pools[-1] = [pools[-1][0] + cells, pools[-1][1] + n, pools[-1][2] + s]
    want = {c: s / n for cells, n, s in pools for c in cells}
    assert got == pytest.approx(want)
    asked = spark.createDataFrame([(-0.5,), (0.37,), (2.0,), (None,)], "p double")
    cells = spark.createDataFrame([(10, 0.1), (30, 0.4), (90, 0.8)], "cell long, level double")
    assert {r.p: r.c for r in glm.calibrated_by(asked, "p", cells, "c").collect()} == {-0.5: 0.1, 0.37: 0.4, 2.0: 0.8, None: None}


def test_hot_area_is_taken_up_day_by_day(spark, tmp_path):
    """With room for 50 times an area's 3,000 events go through map state and come out as they do in memory."""
    rng = random.Random(5)
    start = datetime.datetime(2024, 1, 1)
    rows = [(1 if i % 10 else 2, start + datetime.timedelta(seconds=rng.randrange(20 * 86_400))) for i in range(3000)]
    for k in range(2):
        spark.createDataFrame(rows[k::2], "area int, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        found = []
        for most in (50, 1 << 17):
            raw = spark.readStream.schema("area int, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            out = str(tmp_path / f"out{most}")
            run = weekly.time_since_last(raw, most=most).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-p").trigger(availableNow=True).start()
            run.awaitTermination()
            found.append(sorted((r.area, r.ts, -1 if r.weeks_since is None or r.weeks_since != r.weeks_since else round(r.weeks_since, 9)) for r in spark.read.parquet(out).collect()))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert found[0] == found[1] and len(found[0]) == 3000


def test_streamed_contract_equals_a_rebuild(spark, sf):
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    base = weekly_measures(spark, sf, events)
    rebuilt = weekly.contract_features(base, base.select(F.max("week_start")).scalar(), *surroundings(spark, sf)).select(*FEATURE_NAMES)
    streamed = QUERIES["D2_stream_contract"](spark, sf)
    names = [n for n in FEATURE_NAMES if n not in ("actor_centrality", "sentiment_score", "spatial_lag_risk")]
    assert sorted(map(str, streamed.select(names).collect())) == sorted(map(str, rebuilt.select(names).collect()))
    assert quality.frame_difference(streamed, rebuilt, ["lga_id", "week_start"], ["actor_centrality", "spatial_lag_risk"]).count() == 2
    assert len(FEATURE_NAMES) == 11 and streamed.filter("incident_prob_7d is not null").count() > 0


def test_look_ups_read_one_bucket_and_no_exchange(spark, sf):
    root = scratch_path(spark, "lookup")
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("lga_id"), F.col("o_orderdate").cast("date").alias("event_date"), "o_orderkey")
    for name in ("ix_a", "ix_b"):
        spark.sql(f"drop table if exists {name}")
        contracts.write_indexed(o, name, f"{root}/{name}", ["lga_id", "event_date"], 8)
    found = contracts.look_up(spark, "ix_a", ["lga_id", "event_date"], 7, datetime.date(1995, 1, 1))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SelectedBucketsCount: 1 out of 8" in plan and "event_date" in plan.split("PushedFilters")[1]
    assert sorted(r.o_orderkey for r in found.collect()) == sorted(r.o_orderkey for r in o.filter("lga_id = 7 and event_date >= '1995-01-01'").collect())
    both = spark.table("ix_a").hint("merge").join(spark.table("ix_b").withColumnRenamed("o_orderkey", "k"), "lga_id")
    assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()


def test_dropped_rows_are_counted_and_asserted(spark):
    dense = spark.range(40).select((F.col("id") % 4).alias("area"), F.floor(F.col("id") / 4).cast("long").alias("t"))
    assert [tuple(P.dropped_rows(dense, h).first()) for h in (1, 3)] == [(1, 0, 0), (3, 8, 8)]
    P.assert_dropped(dense, 3)
    with pytest.raises(ValueError):
        P.assert_dropped(dense.filter("not (area = 1 and t = 9)"), 3)


def test_labels_among_features_are_found(spark):
    df = spark.createDataFrame([(1, 1.0, 0), (0, 0.0, 1), (1, 1.0, 1)], "y int, copy double, other int")
    assert {tuple(r) for r in quality.label_copies(df, ["copy", "other", "y"], "y").collect()} == {("copy", False, 3, 3), ("other", False, 1, 3), ("y", True, 3, 3)}
