from datetime import date, timedelta

from pyspark.sql import functions as F

from risklattice.functions.scalar import week_start
from risklattice.operators import graph, quality
from risklattice.operators import panel as P

MON = date(2020, 1, 6)


def series(spark, values, area="A00"):
    rows = [(area, MON + timedelta(days=7 * t), t, float(v)) for t, v in enumerate(values)]
    return spark.createDataFrame(rows, "area string, week date, t int, events double")


def column(df, name):
    return [r[0] for r in df.orderBy("area", "t").select(name).collect()]


def test_weeks_start_on_monday(spark):
    df = spark.createDataFrame([("2023-12-31 23:59:00",), ("2024-01-01 00:00:00",)], "s string")
    weeks = [r[0] for r in df.select(week_start(F.col("s").cast("timestamp"))).collect()]
    assert weeks == [date(2023, 12, 25), date(2024, 1, 1)]


def test_iso_week_53(spark):
    df = spark.createDataFrame([(date(2015, 12, 31),), (date(2020, 12, 31),)], "d date")
    assert [r[0] for r in df.select(F.weekofyear("d")).collect()] == [53, 53]


def test_single_event_series(spark):
    df = series(spark, [0, 0, 0, 1, 0, 0, 0])
    assert column(df.withColumn("x", P.rolling_sum("events", 1)), "x") == [0, 0, 0, 0, 1, 0, 0]
    assert column(df.withColumn("x", P.running_sum("events")), "x") == [0, 0, 0, 0, 1, 1, 1]
    assert column(df.withColumn("x", P.weeks_since("events")), "x") == [520, 520, 520, 520, 520, 1, 2]
    assert column(df.withColumn("x", P.weeks_since("events", single_lag=True)), "x") == [520, 520, 520, 520, 1, 2, 3]
    assert column(df.withColumn("x", P.rolling_sum("events", 2, delay=1)), "x") == [0, 0, 0, 0, 0, 1, 1]


def test_silent_area(spark):
    df = series(spark, [0] * 5).withColumns({"since": P.weeks_since("events"), "cum": P.running_sum("events")})
    assert set(column(df, "since")) == {520.0} and set(column(df, "cum")) == {0.0}


def test_prefix_equals_frames(spark):
    import random

    random.seed(3)
    df = series(spark, [random.randint(0, 3) for _ in range(120)]).withColumn("total", P.prefix("events"))
    for w in (1, 13, 52):
        for d in (0, 2):
            a = column(df.withColumn("x", P.prefix_window("total", w, d)), "x")
            assert a == column(df.withColumn("x", P.rolling_sum("events", w, d)), "x")


def test_spine_drops_unknown_area_and_fills_zero(spark):
    areas = spark.createDataFrame([("A00",), ("A01",)], "area string")
    events = spark.createDataFrame([("A00", MON), ("A99", MON), ("A00", MON + timedelta(days=14))], "area string, week date")
    totals = P.weekly_totals(events, {"events": F.count(F.lit(1))})
    d = P.densify(P.spine(areas, *P.week_span(totals)), totals, ["events"])
    assert d.count() == 6
    assert column(d, "events") == [1, 0, 1, 0, 0, 0]


def test_forward_label_drops_exactly(spark):
    df = series(spark, [0, 0, 0, 0, 1, 0]).withColumn("y", P.forward_label("events", 3))
    out = P.complete_horizon(df, 3)
    assert out.count() == 4 and column(out, "y") == [0, 0, 1, 1]


def test_unknown_edges_are_dropped(spark):
    edges = spark.createDataFrame([("A", "B"), ("A", "Z")], "a string, b string")
    areas = spark.createDataFrame([("A",), ("B",), ("C",)], "area string")
    known = graph.known_edges(graph.symmetric(edges), areas)
    assert sorted(map(tuple, known.collect())) == [("A", "B"), ("B", "A")]
    row = graph.degree_profile(known, areas).first()
    assert (row.edges, row.min_degree, row.max_degree, row.isolated) == (1, 0, 1, 1)


def test_all_42_features(spark):
    names = P.feature_names()
    assert len(names) == len(set(names)) == 42
    groups = quality.column_groups(spark, names, quality.FEATURE_GROUPS)
    assert groups.groupBy("grp").count().count() == 6
    quality.assert_label_absent(names)


def test_delay_shifts_features(spark):
    base = series(spark, [1, 2, 0, 3, 1, 0, 2]).withColumns({c: F.lit(0.0) for c in ("ops", "deaths", "taken")})
    edges = spark.createDataFrame([], "src string, dst string")
    volume = spark.createDataFrame([], "week date, cov_records_13w double")
    now, late = P.panel_features(base, edges, volume), P.panel_features(base, edges, volume, 1)
    assert column(late, "own_events_4w")[1:] == column(now, "own_events_4w")[:-1]


def test_page_rank_sums_to_one_and_prefers_the_hub(spark):
    links = spark.createDataFrame([("a", "h", 1), ("b", "h", 1), ("c", "h", 1), ("h", "a", 1)], "src string, dst string, weight int")
    rank = dict(map(tuple, graph.page_rank(links, tolerance=1e-6).collect()))
    assert abs(sum(rank.values()) - 1) < 1e-9 and max(rank, key=rank.get) == "h"


def test_page_rank_settles_in_few_rounds_where_ranks_swing(spark, monkeypatch):
    """Two sides that hand all rank to each other swing by 0.85 a round; plain rounds to 1e-8 are over a hundred."""
    edges = [(f"a{i}", f"b{j}", 1.0 + (i * j) % 3) for i in range(30) for j in range(4)]
    links = spark.createDataFrame(edges + [(b, a, w) for a, b, w in edges], "src string, dst string, weight double")
    rounds, coalesce = [], F.coalesce  # a round calls it once
    monkeypatch.setattr(graph.F, "coalesce", lambda *cols: rounds.append(1) or coalesce(*cols))
    rank = dict(map(tuple, graph.page_rank(links).collect()))
    assert len(rounds) <= 40
    share = {}
    for s, d, w in links.collect():
        share.setdefault(s, {})[d] = w
    plain = dict.fromkeys(rank, 1.0)
    for _ in range(200):
        nxt = dict.fromkeys(rank, 0.15)
        for s, out in share.items():
            for d, w in out.items():
                nxt[d] += 0.85 * plain[s] * w / sum(out.values())
        plain = nxt
    assert all(abs(rank[n] - plain[n] / len(plain)) < 1e-9 for n in rank)


def test_dense_panel_equals_densify_and_moves_no_weeks(spark):
    """300 areas by 53 weeks: the same rows, with windows, while fewer rows are shuffled than the panel has."""
    from test_matching import shuffled_rows

    areas = spark.range(300).withColumnRenamed("id", "area").repartition(4)
    totals = spark.range(330).selectExpr("id as area", "case when id % 50 <> 9 then date_add(date'2020-01-06', cast(7 * (id % 53) as int)) end as week", "id + 1 as events")
    span = F.lit("2020-01-06").cast("date"), F.lit("2021-01-04").cast("date")
    want = P.densify(P.spine(areas, *span), totals, ["events"]).withColumn("sum", P.prefix("events"))
    before = shuffled_rows(spark)
    got = P.dense_panel(areas, totals, ["events"], *span).withColumn("sum", P.prefix("events")).select(want.columns).collect()
    assert shuffled_rows(spark) - before < 300 * 53 / 2
    assert len(got) == 300 * 53 and sorted(got) == sorted(want.collect())
