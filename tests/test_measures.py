import random
from datetime import date, timedelta

import numpy as np
from pyspark.sql import functions as F

from risklattice.operators import bands, metrics, ranking, recapture, stats

MON = date(2020, 1, 6)


def exact(scores, labels):
    s, y = np.array(scores), np.array(labels)
    ap = tp = n = 0
    for v in sorted(set(scores), reverse=True):
        at = s == v
        tp, n = tp + y[at].sum(), n + at.sum()
        ap += y[at].sum() / y.sum() * tp / n
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos])
    return ap, auc


def test_quality_with_ties_and_small_pieces(spark, monkeypatch):
    random.seed(2)
    for spread in (lambda: random.randint(0, 6) / 7, lambda: 0.5 + random.random() / 1e4, lambda: random.gauss(0, 3)):
        rows = [("m", spread(), int(random.random() < 0.3)) for _ in range(400)]
        df = spark.createDataFrame(rows, "model string, score double, y int")
        cells = ranking.score_cells(df, ["model"], "score", {"tp": F.sum("y"), "n": F.count(F.lit(1))})
        small = ranking.running_totals(cells, ["model"], ["tp", "n"], piece_rows=7).orderBy(F.desc("score")).collect()
        want = ranking.running_totals(cells, ["model"], ["tp", "n"]).orderBy(F.desc("score")).collect()
        assert small == want
        assert [r.cum_n for r in want] == list(np.cumsum([r.n for r in want]))
        q = metrics.ranking_quality(df, ["model"]).first()
        ap, auc = exact([r[1] for r in rows], [r[2] for r in rows])
        assert abs(q.average_precision - ap) < 1e-12 and abs(q.roc_auc - auc) < 1e-12


def test_quantiles_equal_numpy(spark):
    random.seed(4)
    values = [random.choice([1.0, 2.0, random.random() * 100]) for _ in range(501)]
    probs = [0, 0.1, 0.37, 0.5, 0.99, 1]
    got = ranking.exact_quantiles(spark.createDataFrame([(v,) for v in values], "v double"), [], "v", probs).first().edges
    assert np.allclose(got, np.quantile(values, probs), atol=1e-12)


def week(i):
    return MON + timedelta(days=7 * i)


def test_recall_ties_and_empty_week(spark):
    rows = [(week(0), "B", 1.0, 1), (week(0), "A", 1.0, 0), (week(0), "C", 0.5, 1), (week(1), "A", 1.0, 0), (week(1), "B", 0.2, 0)]
    df = spark.createDataFrame(rows, "week date, area string, score double, y int")
    one = metrics.recall_at_k(df, [], 1).first()
    assert (one.hits, one.positives) == (0, 2)  # the smaller key wins the tie
    two = metrics.recall_at_k(df, [], 2, areas=3).first()
    assert two.recall_at_k == 0.5 and abs(two.lift_at_k - 0.75) < 1e-12
    c = metrics.confusion_at_k(df, [], 2).first()
    assert (c.tp, c.fp, c.fn, c.tn) == (1, 3, 1, 0)


def test_calibration_keeps_ties_together(spark):
    df = spark.createDataFrame([(0.1, 0)] * 60 + [(0.5, 1)] * 40, "score double, y int")
    rows = {r.bin: (r.rows, r.observed) for r in metrics.calibration(df, []).collect()}
    assert sum(n for n, _ in rows.values()) == 100 and len(rows) == 2
    assert sorted(rows.values()) == [(40, 1.0), (60, 0.0)]


def test_empty_band_keeps_row(spark):
    df = spark.createDataFrame([("A", week(0), 1, "Low"), ("B", week(0), 0, "High")], "area string, week date, y int, band string")
    out = {r.band: r for r in bands.band_profile(df).collect()}
    assert set(out) == set(bands.BANDS)
    assert out["Severe"].realised_rate is None and out["Severe"].areas_per_week == 0
    assert out["Low"].times_base == 2


def test_anchor_never_touches_its_test_block(spark):
    # y is 1 exactly in the last 104 weeks; horizons shorten the record, the anchor must follow.
    for last in (299, 296):
        df = spark.range(last + 1).select(F.col("id").cast("int").alias("t"), (F.col("id") > last - 104).cast("int").alias("y"))
        rates = {r.fold: r.anchor_rate for r in bands.anchors(df, "recent", F.lit(last)).collect()}
        assert rates[4] == 0 and rates[5] == 1


def test_comparable_run_stops_at_break(spark):
    rows = [(week(i), 300.0 if i < 10 else 100.0, 1 if i < 10 else 0, 1) for i in range(20)]
    df = spark.createDataFrame(rows, "week date, volume double, positives int, rows int")
    got = bands.comparable_anchor(df, F.lit(100.0)).first()
    assert (got.weeks, got.first_week, got.anchor_rate, got.comparable) == (10, week(10), 0.0, True)
    none = bands.comparable_anchor(df, F.lit(1e6), cap=5).first()
    assert (none.weeks, none.comparable) == (5, False)


def test_chapman_extremes(spark):
    groups = spark.createDataFrame([("A", "g")], "area string, grp string")
    days = [date(2020, 1, d) for d in range(1, 11)]
    none = spark.createDataFrame([("A", d, "m" if i < 5 else "o") for i, d in enumerate(days)], "area string, day date, source string")
    every = spark.createDataFrame([("A", d, s) for d in days for s in "mo"], "area string, day date, source string")
    a = recapture.detection(none, "m", "o", groups).filter("pooled = 1").first()
    assert a.matched == 0 and a.estimate == 35 and not a.reliable
    b = recapture.detection(every, "m", "o", groups).filter("pooled = 1").first()
    assert b.matched == 10 and b.detection == 1.0 and b.reliable


def test_weights_average_to_one(spark):
    detected = spark.createDataFrame([("g", 0, True, 0.5), ("h", 0, False, 0.1), (None, 1, True, 0.25)], "grp string, pooled int, reliable boolean, detection double")
    areas = spark.createDataFrame([("A", "g"), ("B", "h")], "area string, grp string")
    w = {r.area: r.weight for r in recapture.detection_weights(areas, detected).collect()}
    assert abs(sum(w.values()) / 2 - 1) < 1e-12 and w["B"] == 2 * w["A"]


def test_quantile_bands_edges(spark):
    df = spark.createDataFrame([(float(i),) for i in range(5)], "v double")
    half = stats.quantile_bands(df, "v", [0, 0.5, 1.0]).groupBy("band_no").count().collect()
    both = stats.quantile_bands(df, "v", [0, 0.5, 1.0], inclusive=True).groupBy("band_no").count().collect()
    assert sorted(map(tuple, half)) == [(1, 2), (2, 3)] and sorted(map(tuple, both)) == [(1, 3), (2, 3)]


def test_correlation_with_a_constant_is_not_a_number_and_ties_go_by_place(spark, duck):
    import math

    from risklattice.operators import stats

    df = spark.createDataFrame([(1.0, 5.0, 1), (2.0, 3.0, 1), (4.0, 4.0, 1)], "b double, a double, y int")
    got = dict(map(tuple, stats.correlations(df, "y", ["b", "a"]).collect()))
    assert math.isnan(got["a"]) and math.isnan(got["b"])
    assert stats.strongest(stats.correlations(df, "y", ["b", "a"]), ["b", "a"]).first().feature == "b"
    both = dict(map(tuple, stats.correlations(df, "a", ["b"]).collect()))
    assert abs(both["b"] - duck.sql("select corr(a, b) from (values (1.0, 5.0), (2.0, 3.0), (4.0, 4.0)) t(b, a)").fetchall()[0][0]) < 1e-12
