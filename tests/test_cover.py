"""Cell covers, name matching and linkage against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from risklattice.functions.text import edit_ratio
from risklattice.operators import link, reconcile, resolve, spatial

POLY = "code string, rings array<array<array<double>>>"


def star(rng, x, y, size, corners, step=None):
    ring = []
    for i in range(corners):
        turn, far = 2 * math.pi * i / corners, size * rng.uniform(0.3, 1)
        p = [x + far * math.cos(turn), y + far * math.sin(turn)]
        ring.append([round(c / step) * step for c in p] if step else p)
    return ring


def sides(rings):
    return [(*a, *b) for ring in rings for a, b in zip(ring, ring[1:] + ring[:1]) if a != b]


def distance(px, py, s):
    x1, y1, x2, y2 = s
    dx, dy = x2 - x1, y2 - y1
    if (px - x1) * dy == (py - y1) * dx and min(x1, x2) <= px <= max(x1, x2) and min(y1, y2) <= py <= max(y1, y2):
        return 0.0
    t = max(0.0, min(1.0, ((px - x1) * dx + (py - y1) * dy) / (dx * dx + dy * dy)))
    return math.hypot(px - x1 - t * dx, py - y1 - t * dy)


def odd(px, py, rings):
    return sum((y1 > py) != (y2 > py) and px < x1 + (py - y1) * (x2 - x1) / (y2 - y1) for x1, y1, x2, y2 in sides(rings)) % 2 == 1


def place(px, py, polygons, tolerance):
    inside = [c for c, r in polygons if odd(px, py, r) and min(distance(px, py, s) for s in sides(r)) > 0]
    if inside:
        return min(inside), "inside"
    near = [(gap, c) for c, r in polygons if (gap := min(distance(px, py, s) for s in sides(r))) <= tolerance]
    return (min(near)[1], "snapped") if near else (None, "outside")


@pytest.mark.parametrize("step", [None, 0.5])
def test_locate_equals_brute_force(spark, step):
    """Free outlines, and outlines whose corners and edges lie on the grid; with holes, overlaps and long thin parts."""
    rng = random.Random(3)
    polygons = [(f"p{i:02}", [star(rng, rng.uniform(-4, 4), rng.uniform(-4, 4), rng.uniform(0.5, 4), rng.randint(3, 12), step)]) for i in range(14)]
    polygons[0][1].append(star(rng, 0, 0, 1, 5, step))
    polygons.append(("q", [[[-6.0, -6.0], [6.0, -5.5], [6.0, -5.25]]]))
    points = [(rng.uniform(-7, 7), rng.uniform(-7, 7)) for _ in range(1500)] + [(rng.randint(-28, 28) / 4, rng.randint(-28, 28) / 4) for _ in range(700)]
    points += [tuple(p) for _, rings in polygons for p in rings[0]]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)] + [(-1, None, 0.0), (-2, float("nan"), 0.0), (-3, float("inf"), 0.0)], "id long, x double, y double")
    got = {r.id: (r.code, r.how) for r in spatial.locate(df, spark.createDataFrame(polygons, POLY), 0.5, 0.1).collect()}
    assert [got.pop(i) for i in (-1, -2, -3)] == [(None, "outside")] * 3
    assert got == {i: place(*p, polygons, 0.1) for i, p in enumerate(points)}


def test_cover_cells_are_filed_along_the_line(spark):
    """A slanted segment over 100 by 100 cells is filed near its line; a cell inside carries no segments."""
    df = spark.createDataFrame([("a", [[[0.0, 0.0], [100.0, 100.0], [0.0, 100.0]]])], POLY)
    cover = spatial.cell_cover(df, 1.0, 0.001)
    edge = cover.filter("segs is not null")
    assert edge.count() < 3 * 102 + 4 * 102 and cover.filter("segs is null").count() == cover.filter("segs is null and odd").count() > 4000
    assert edge.filter(F.size("segs") > 3).count() == 0


@pytest.mark.parametrize("step", [None, 0.5])
def test_adjacency_equals_brute_force(spark, step):
    rng = random.Random(5)
    polygons = [(f"p{i:02}", [star(rng, rng.uniform(-6, 6), rng.uniform(-6, 6), rng.uniform(0.3, 1.5), rng.randint(3, 9), step)]) for i in range(30)]
    polygons.append(("z", [star(rng, 0, 0, 3, 9, step)]))
    polygons = [(c, r) for c, r in polygons if sides(r)]

    def cross(s, t):
        def side(p, q, r):
            return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])

        a, b, c, d = s[:2], s[2:], t[:2], t[2:]
        return side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0

    def near(r, q):
        for s in sides(r):
            for t in sides(q):
                if cross(s, t) or min(distance(*t[:2], s), distance(*t[2:], s), distance(*s[:2], t), distance(*s[2:], t)) <= 0.05:
                    return True
        return odd(*r[0][0], q) or odd(*q[0][0], r)

    want = {(a, b) for a, r in polygons for b, q in polygons if a < b and near(r, q)}
    assert set(map(tuple, spatial.adjacency(spark.createDataFrame(polygons, POLY), 0.5, 0.05).collect())) == want


def test_gazetteer_equals_brute_force(spark):
    rng = random.Random(8)
    names = {(g, "".join(rng.choice("ab") for _ in range(rng.randint(3, 17)))) for g in "xy" for _ in range(60)}
    gaz = [(n, g, f"c{i}", i % 40) for i, (g, n) in enumerate(sorted(names))]
    texts = [(i, rng.choice(["x", "y", "z", None]), *("".join(rng.choice("ab") for _ in range(rng.choice([0, 4, 30, 400]))) for _ in range(2))) for i in range(120)]
    want = {}
    for i, g, *fields in texts:
        hits = [(f, -len(n), p, n, c) for f, t in enumerate(fields) for n, group, c, p in gaz if group == g and len(n) >= 5 and n in t]
        if hits:
            want[i] = (min(hits)[4], min(hits)[3], min(hits)[0])
    out = resolve.gazetteer_match(spark.createDataFrame(texts, "id int, g string, a string, b string"), spark.createDataFrame(gaz, "name_key string, group_key string, code string, place int"), "id", "g", ["a", "b"])
    assert {r.id: (r.code, r.name_key, r.field_no) for r in out.collect()} == want


def test_hot_words_are_dealt_out(spark, monkeypatch):
    """One block of texts built from the same few words: every pair is found, and no (word, part) holds more than a few times the bound."""
    rng = random.Random(9)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(4) for j in range(5)]
    rows = [(i, "b" if i % 7 else "c", " ".join(rng.sample(words, rng.randint(3, 12)))) for i in range(400)]
    monkeypatch.setattr(link.salted, "__defaults__", (20,))
    add, main = (spark.createDataFrame([(i, b, t) for i, b, t in rows if i % 2 == k], f"{n} long, block string, t string") for k, n in enumerate(("add_id", "main_id")))
    got = {r.add_id: (r.main_id, round(r.score, 9)) for r in link.find_duplicates(add, main, ["block"], "t", "t").collect()}
    want = {}
    for i, b, t in rows[::2]:
        own = set(t.split())
        score, j = min((-len(own & set(u.split())) / len(own), j) for j, c, u in rows[1::2] if c == b)
        if -score >= 0.6:
            want[i] = (j, round(-score, 9))
    assert got == want
    keys = spark.createDataFrame([(1, i) for i in range(1000)] + [(2, 5)], "no int, id long")
    a, b = link.salted(keys, keys.withColumnRenamed("id", "other"), ["no"], "id", "other", 20)
    sizes = [r["count"] for df in (a, b) for r in df.groupBy("no", "_a", "_b").count().collect()]
    assert max(sizes) <= 60 and a.join(b, ["no", "_a", "_b"]).count() == 1000 * 1000 + 1


def test_nearest_names_equal_all_pairs_with_few_pairs(spark):
    """A full group of names: the same rows as all pairs, ties and unmatched labels included, from at most a tenth of the pairs."""
    rng = random.Random(10)

    def word(n):
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123") for _ in range(n))

    names = sorted({word(rng.randint(4, 14)) for _ in range(1200)})
    labels = ["", "zz", names[0], "q" * 40]
    for n in rng.sample(names, 150):
        k = rng.randrange(len(n))
        labels += [n[:k] + n[k + 1 :], n[:k] + rng.choice("aeiou") + n[k:], n[::-1]] if rng.random() < 0.5 else [n + "s", word(len(n))]
    ref = spark.createDataFrame([("g", n, f"c{(7 * i) % 1000:04}", n.upper(), 0) for i, n in enumerate(names)] + [("h", "abc", "c1", "ABC", 0)], "group_key string, name_key string, code string, official_name string, place int")
    open_labels = spark.createDataFrame([("g", n) for n in labels] + [("h", "abd"), ("nowhere", "abd")], "group_key string, name_key string")
    got = {tuple(r) for r in reconcile.nearest_names(open_labels, ref).collect()}
    assert got == {tuple(r) for r in reconcile.fuzzy_best(open_labels, ref, edit_ratio).collect()}
    names_rows = reconcile._gram_rows(ref.select("group_key", F.col("name_key").alias("ref")), "ref", None, "ref_")
    own = reconcile._gram_rows(open_labels.filter("group_key = 'g'").distinct(), "name_key", names_rows.select("group_key", F.explode("_grams").alias("_gram")).groupBy("group_key", "_gram").agg(F.count("*").alias("_names")))
    best = spark.createDataFrame([(r[0], r[1], r[4]) for r in got if r[0] == "g"], "group_key string, name_key string, best double")
    assert reconcile.pairs_in_reach(own, names_rows, best).count() <= len(set(labels)) * len(names) / 10
