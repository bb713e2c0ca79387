import difflib
import random
from datetime import date

import numpy as np
from pyspark.sql import functions as F

from risklattice.functions import text as T
from risklattice.operators import conform, link, ranking, reconcile, resolve, spatial

D = date(2020, 1, 6)


def square(x, y, s=1.0):
    x, y = float(x), float(y)
    return [[[x, y], [x + s, y], [x + s, y + s], [x, y + s]]]


POLY = "code string, rings array<array<array<double>>>"


def test_normalise_modes(spark):
    df = spark.createDataFrame([("Tama’ore",), ("Ɓorvin-Keɗu ",), (None,), ("Łódź ß",)], "s string")
    rows = [tuple(r) for r in df.select(T.normalise_key("s"), T.normalise_key("s", "ascii"), T.normalise_key("s", "words")).collect()]
    assert rows == [("tamaore", "tamaore", "tamaore"), ("borvinkedu", "borvinkedu", "borvinkedu"), ("", "", ""), ("lodzss", "lodzss", "lodz ss")]


def test_block_ratio_is_difflib(spark):
    random.seed(1)
    words = ["".join(random.choice("abcde") for _ in range(random.randint(0, 9))) for _ in range(60)]
    pairs = [(a, b) for a in words for b in words]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.matching_blocks_ratio("a", "b").alias("r")).collect()
    assert all(r.r == difflib.SequenceMatcher(None, r.a, r.b).ratio() for r in got)


def test_crosswalk_stays_in_group(spark):
    ref = spark.createDataFrame([("P1", "north", "borvinkedu", "Borvin Kedu"), ("P2", "south", "borvinkedu", "Other"), ("P3", "north", "zelmo", "Zelmo")], "code string, group_key string, name_key string, official_name string").withColumn("place", F.lit(0))
    labels = spark.createDataFrame([("north", "borvinkedu", 4), ("south", "borvinkedu", 1), ("north", "borvikedu", 2), ("north", "xyz", 1), ("east", "zelmo", 1), ("north", "seat", 1)], "group_key string, name_key string, records int")
    manual = spark.createDataFrame([("north", "seat", "P3", "Zelmo")], "group_key string, name_key string, code string, official_name string")
    out = {(r.group_key, r.name_key): (r.code, r.match_type) for r in reconcile.crosswalk(labels, ref, manual).collect()}
    assert out == {
        ("north", "borvinkedu"): ("P1", "exact"), ("south", "borvinkedu"): ("P2", "exact"), ("north", "borvikedu"): ("P1", "fuzzy"),
        ("north", "xyz"): (None, "unmatched"), ("east", "zelmo"): (None, "unmatched"), ("north", "seat"): ("P3", "manual"),
    }


def brute(add, main, threshold):
    words = lambda s: set() if s is None else {w for w in "".join(c if c in "abcdefghijklmnopqrstuvwxyz " else " " for c in s.lower()).split() if w not in T.STOP_WORDS}
    out = {}
    for a, ab, at in add:
        best = None
        for m, mb, mt in main:
            t, n = words(at), words(mt)
            if ab is None or ab != mb or not t:
                continue
            s = len(t & n) / len(t)
            if s >= threshold and (best is None or (-s, m) < best):
                best = (-s, m)
        if best:
            out[a] = (best[1], round(-best[0], 9))
    return out


def test_duplicates_against_brute_force(spark):
    random.seed(5)
    vocab = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)]
    text = lambda lo, hi: " ".join(random.choice(vocab) for _ in range(random.randint(lo, hi)))
    # One block holds most rows, and most of its narratives are one text.
    copy = text(12, 20)
    main = [(i, "hot" if i % 4 else f"b{i % 5}", copy if i % 3 == 0 else text(5, 25)) for i in range(150)] + [(900, None, copy), (901, "hot", None)]
    add = [(i, "hot" if i % 3 else f"b{i % 5}", copy if i % 7 == 0 else text(2, 9)) for i in range(120)] + [(900, None, copy), (901, "hot", None)]
    a = spark.createDataFrame(add, "add_id long, block string, title string")
    m = spark.createDataFrame(main, "main_id long, block string, narrative string")
    got = {r.add_id: (r.main_id, round(r.score, 9)) for r in link.find_duplicates(a, m, ["block"], "title", "narrative").collect()}
    assert got == brute(add, main, 0.6) and len(got) > 20


def test_duplicate_threshold_edge(spark):
    m = spark.createDataFrame([(2, D, "north", "alpha beta gamma"), (1, D, "north", "alpha beta gamma delta")], "main_id long, date date, state string, narrative string")
    a = spark.createDataFrame([(1, D, "north", "alpha beta gamma xx yy"), (2, D, "north", "alpha beta xx yy"), (3, D, "south", "alpha beta gamma")], "add_id long, date date, state string, title string")
    got = [tuple(r) for r in link.find_duplicates(a, m, ["date", "state"], "title", "narrative").collect()]
    assert got == [(1, 1, 0.6)]


def test_second_donor_fills(spark):
    main = spark.createDataFrame([(1, None), (2, 5.0)], "main_id long, deaths double")
    add = spark.createDataFrame([(10, None), (11, 7.0), (12, 9.0)], "add_id long, deaths double")
    links = spark.createDataFrame([(10, 1), (11, 1), (12, 2)], "add_id long, main_id long")
    out = {r.main_id: (r.deaths, r.deaths_filled) for r in link.enrich(main, add, links, ["deaths"]).collect()}
    assert out == {1: (7.0, True), 2: (5.0, False)}


def test_evidence_cases(spark):
    rows = [
        ("north", "A", "north", "A", "north", "agree"), ("north", "B", "south", "A", "north", "conflict_kept_name"),
        ("north", "A", "north", "B", "north", "conflict_kept_geometry"), ("north", "B", "south", "C", "east", "conflict_unresolved"),
        ("north", "B", "south", None, None, "geometry_only"), ("north", None, None, "A", "north", "name_only"), ("north", None, None, None, None, "none"),
    ]
    df = spark.createDataFrame(rows, "declared string, gc string, gg string, nc string, ng string, want string")
    out = resolve.reconcile_evidence(df, "declared", "gc", "gg", "nc", "ng").collect()
    assert all(r.basis == r.want for r in out)
    assert [r.code for r in out] == ["A", "A", "A", None, "B", "A", None]


def test_gazetteer_longest_and_field_order(spark):
    gaz = spark.createDataFrame([("alpha", "north", "P1", 0), ("alphaville", "north", "P2", 1), ("abcd", "north", "P3", 2), ("omega", "south", "P4", 3)], "name_key string, group_key string, code string, place int")
    texts = spark.createDataFrame([(1, "north", "xxalphavillexx", "alpha"), (2, "north", "nothing", "inalphahere"), (3, "north", "abcd", "omega"), (4, None, "alpha", "")], "id int, state string, location string, narrative string")
    out = {r.id: r.code for r in resolve.gazetteer_match(texts, gaz, "id", "state", ["location", "narrative"]).collect()}
    assert out == {1: "P2", 2: "P1"}


def test_point_location_edges(spark):
    polygons = spark.createDataFrame([("A", square(0, 0)), ("B", square(1, 0)), ("H", [square(5, 5, 3.0)[0], square(6, 6)[0]])], POLY)
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.0, 0.5), (3, 2.02, 0.5), (4, 2.03, 0.5), (5, 6.5, 6.5), (6, 5.5, 5.5), (7, None, 1.0)], "id int, x double, y double")
    out = {r.id: (r.code, r.how) for r in spatial.locate(points, polygons, 0.7).collect()}
    assert out == {1: ("A", "inside"), 2: ("A", "snapped"), 3: ("B", "snapped"), 4: (None, "outside"), 5: (None, "outside"), 6: ("H", "inside"), 7: (None, "outside")}


def test_adjacency_gaps(spark):
    polygons = spark.createDataFrame([("A", square(0, 0)), ("B", square(1, 0)), ("C", square(1, 1)), ("D", square(2.001, 0)), ("E", square(3.004, 0)), ("I", square(0.4, 0.4, 0.1))], POLY)
    pairs = sorted(map(tuple, spatial.adjacency(polygons, 0.5).collect()))
    assert pairs == [("A", "B"), ("A", "C"), ("A", "I"), ("B", "C"), ("B", "D"), ("C", "D")]


def test_row_ids_are_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("g"))
    got = [tuple(r) for r in conform.add_row_id(df, ["k"]).select("k", "row_id").orderBy("k").collect()]
    assert got == [(i, i) for i in range(1000)]


def test_ordered_numbers_with_one_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise((F.col("id") % 50).cast("string")).alias("g"), "id").repartition(6)
    out = ranking.ordered_numbers(df, ["g"], ["id"]).withColumn("want", F.expr("row_number() over (partition by g order by id)"))
    assert out.count() == 5000 and out.filter("place <> want").count() == 0


def test_merge_and_conform(spark):
    raw = spark.createDataFrame([("2020-02-30", " Banditry", "GSF Operation", "S", "L", "P", "x", "7", "n", "3", None), ("2020-02-03", "other", "raid", "S", "L", "P", "9.5", "7", "n", "many", "2")],
                                ["Date of Incident", "Incident Type 2", "Incident Type", "State", "Local Govt Area", "Location", "Latitude", "Longitude", "Details", "Fatalities", "Kidnap"])
    rows = conform.general_events(raw).collect()
    assert (rows[0].date, rows[0].latitude, rows[0].is_target, rows[0].is_operation, rows[0].category) == (None, None, True, True, "banditry")
    assert (rows[1].date, rows[1].deaths, rows[1].kidnapped, rows[1].category) == (date(2020, 2, 3), None, 2.0, "other")


def shuffled_rows(spark):
    """Rows written to shuffles by all stages of the session so far."""
    sc = spark.sparkContext
    none = sc._gateway.new_array(sc._gateway.jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, sc._gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_pairs_of_a_block_are_no_rows(spark):
    """300 by 300 texts of the same few words, nearly all of whose 90,000 pairs share some: the links of all pairs, from few rows."""
    rng = random.Random(4)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(5) for j in range(8)]
    texts = [" ".join(rng.sample(words, rng.randint(2, 25))) for _ in range(600)]
    add, main = (spark.createDataFrame([(i, "b", t) for i, t in enumerate(texts) if i % 2 == k], f"{n} long, block string, t string") for k, n in enumerate(("add_id", "main_id")))
    before = shuffled_rows(spark)
    got = {r.add_id: (r.main_id, round(r.score, 9)) for r in link.find_duplicates(add, main, ["block"], "t", "t").collect()}
    assert shuffled_rows(spark) - before < 9_000
    want = {}
    for i in range(0, 600, 2):
        own = set(texts[i].split())
        score, j = min((-len(own & set(texts[j].split())) / len(own), j) for j in range(1, 600, 2))
        if -score >= 0.6:
            want[i] = (j, round(-score, 9))
    assert got == want


def test_shared_counts_in_slices(monkeypatch):
    """Common and rare values, in slices of few cells: the size of each intersection."""
    monkeypatch.setattr(link, "CELLS", 200)
    rng = random.Random(5)
    own, other = ([sorted(rng.sample(range(-30, 300), rng.randint(1, 40)) + [1000 + k]) for k in range(n)] for n in (50, 70))
    flat = lambda sets: (np.array([v for s in sets for v in s]), np.array([i for i, s in enumerate(sets) for _ in s]))
    slices = list(link.shared_counts(*flat(own), 50, *flat(other), 70))
    assert len(slices) > 1 and np.concatenate([m for _, m in slices]).tolist() == [[len(set(a) & set(b)) for b in other] for a in own]
