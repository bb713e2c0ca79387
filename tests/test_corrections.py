"""Cases that whole-table comparisons do not reach."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from risklattice import session
from risklattice.operators import bands, quality, recapture, spatial, text_audit
from risklattice.sources import contracts


def test_many_main_days_beside_one_other_day_match_once(spark):
    day = dt.date(2024, 1, 10)
    rows = [(1, day + dt.timedelta(d), "m") for d in (-1, 0, 1)] + [(1, day, "o"), (9, day, "m")]
    events = spark.createDataFrame(rows, "area int, day date, source string")
    groups = spark.createDataFrame([(1, "north")], "area int, grp string")
    got = {(r.grp, r.pooled): r for r in recapture.detection(events, "m", "o", groups, days=1).collect()}
    assert got["north", 0].matched == 1 and got["north", 0].n_other == 1
    # An area of no group counts, on its own and in the pooled row.
    assert got[None, 0].n_main == 1 and got[None, 1].n_main == 4
    assert got["north", 0].detection == pytest.approx(3 / (4 * 2 / 2 - 1))
    nothing = recapture.detection(events.filter("area = 9"), "m", "o", groups).filter("pooled = 1").first()
    assert nothing.estimate == 1.0 and nothing.detection == 1.0


def test_nearest_target_near_the_pole_and_over_the_date_line(spark):
    places = [(1, 0.0, 85.0), (2, 40.0, 85.0), (3, 10.0, 88.0), (4, -170.0, 88.0), (5, 179.0, 0.0), (6, -179.0, 0.0), (7, 90.0, -90.0), (8, 0.0, -80.0)]
    df = spark.createDataFrame(places, "area int, x double, y double")

    def km(a, b):
        (_, lon1, lat1), (_, lon2, lat2) = a, b
        p, q = math.radians(lat1), math.radians(lat2)
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
        return 2 * 6371.0088 * math.asin(math.sqrt(min(1, h)))

    for cell in (1.0, 5.0):
        got = {r.area: r.km for r in spatial.nearest_target(df, df, cell).collect()}
        assert got == {a[0]: pytest.approx(min(km(a, b) for b in places if b != a)) for a in places}


def test_part_inside_another_area_is_an_edge(spark):
    def square(x, y, side):
        return [[x, y], [x + side, y], [x + side, y + side], [x, y + side]]

    for order in (1, -1):
        parts = [square(50.0, 50.0, 1.0), square(4.0, 4.0, 1.0)][::order]
        df = spark.createDataFrame([("a", [square(0.0, 0.0, 10.0)]), ("b", parts)], "code string, rings array<array<array<double>>>")
        assert [tuple(r) for r in spatial.adjacency(df, 2.0).collect()] == [("a", "b")]


def test_null_version_ranks_lowest(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, None), ("b", 3, 5), ("b", 4, 4)], "k string, v int, n int")
    assert sorted(map(tuple, contracts.newest_per_key(df, ["k"], "n").collect())) == [("a", 1, None), ("b", 3, 5)]


def test_suffixes_go_on_beyond_two_letters(spark):
    df = spark.range(1, 18300).select(F.lit("k").alias("k"), F.col("id").alias("n")).unionByName(spark.createDataFrame([("alone", 1)], "k string, n long"))
    got = {(r.k, r.n): r.suffix for r in quality.letter_suffixes(df, "k", ["n"]).collect()}
    assert [got["k", n] for n in (1, 26, 27, 702, 703, 704, 18278, 18279)] == ["a", "z", "aa", "zz", "aaa", "aab", "zzz", "aaaa"] and got["alone", 1] == ""


def test_figures_in_per_cent(spark):
    df = spark.createDataFrame([(1, "rose by 12 per cent, 5 per cent and 1,250 of 2024; 77 no")], "d int, t string")
    assert {r.figure for r in quality.figures(df, "d", "t").collect()} == {"12", "1,250"}


def test_require_names_every_failure(spark):
    checks = spark.range(30).select(F.concat(F.lit("c"), "id").alias("label"), F.lit(1).alias("stated"), F.lit(2).alias("computed"), F.lit(False).alias("ok"))
    with pytest.raises(AssertionError, match="30 failed.*c29"):
        quality.require(checks)


def test_marks_in_headings_are_not_prose(spark):
    df = spark.createDataFrame([(1, "# One; robust\nTwo; three robust. Four.\n## S\nBody words here.\n## T\nMore.")], "d int, t string")
    assert text_audit.profile(df, "d", "t").first().semicolons == 1
    assert text_audit.phrase_hits(df, "t", ["robust"]).first().hits == 1
    assert [(r.title, r.words) for r in text_audit.split_sections(df, "d", "t").collect()] == [("S", 3), ("T", 1)]


def test_evaluation_anchor_pools_all_folds(spark):
    df = spark.range(40).select(F.col("id").cast("int").alias("t"), (F.col("id") >= 35).cast("int").alias("y"))
    rate = lambda kind, **kw: {r.fold: r.anchor_rate for r in bands.anchors(df, kind, F.lit(39), 2, 10, 5, **kw).collect()}
    assert rate("evaluation") == {1: 0.25, 2: 0.25} and rate("test_block") == {1: 0.0, 2: 0.5}
    # Labels that reach into the test block are left out.
    late = spark.range(40).select(F.col("id").cast("int").alias("t"), (F.col("id") == 29).cast("int").alias("y"))
    known = {r.fold: r.anchor_rate for r in bands.anchors(late, "recent", F.lit(39), 2, 10, 5, horizon=2).collect()}
    assert known == {1: 0.0, 2: 0.0}


def test_a_cluster_without_shared_folder_is_refused():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_percent_text_rounds_the_exact_value_as_printf(spark, duck):
    from risklattice.functions.scalar import percent_text

    rates = [k / 2000 for k in range(0, 400)] + [k / 200 for k in range(20, 120)] + [-k / 2000 for k in range(1, 40)] + [0.0999999, 0.0995, None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rates)], "i int, d double")
    got = dict(map(tuple, df.select("i", percent_text(F.col("d")).alias("s")).collect()))
    duck.execute("create or replace temp table rate (i int, d double)")
    duck.executemany("insert into rate values (?, ?)", [list(x) for x in enumerate(rates)])
    want = dict(duck.sql("select i, case when d * 100 < 10 then printf('%.1f%%', d * 100) else printf('%.0f%%', d * 100) end from rate").fetchall())
    assert got == want


def test_areas_of_one_place_look_for_targets_once(spark, monkeypatch):
    """1,200 areas on 24 places, some with targets: brute force, and no written step holds more rows than places or two targets a place."""
    rows = [(i, float(i % 24 * 14 - 170), float(i % 24 * 5 - 60), i % 24 < 9 and i % 7 == 0 or i == 23) for i in range(1200)]
    df = spark.createDataFrame(rows, "area int, x double, y double, goal boolean")
    sizes = []

    def counted(out):
        sizes.append(out.count())
        return session.cut_lineage(out)

    monkeypatch.setattr(spatial, "cut_lineage", counted)
    got = {r.area: (round(r.km, 6), r.target) for r in spatial.nearest_target(df, df.filter("goal"), 5.0).collect()}
    at = {i: (math.radians(x), math.radians(y)) for i, x, y, _ in rows}
    goals = [i for i, _, _, goal in rows if goal]

    def km(a, b):
        (p, q), (u, v) = at[a], at[b]
        return round(2 * 6371.0088 * math.asin(math.sqrt(min(1, math.sin((v - q) / 2) ** 2 + math.cos(q) * math.cos(v) * math.sin((u - p) / 2) ** 2))), 6)

    assert got == {a: min((km(a, b), b) for b in goals if b != a) for a in at}
    assert max(sizes) <= 24
