"""Neighbours, passages, decontamination, SimHash: brute force, planted cases, and the odd cases."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from risklattice.llm import chunks, decontaminate, graph, neighbours, simhash
from test_text_operators import DOC, docs_of, empty, odd

VEC = "vec_id long, embedding array<float>, label int"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 9))) for _ in range(n))


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], VEC)


def exact(vectors, k):
    ids, x = [i for i, _ in vectors], np.array([v for _, v in vectors], np.float32).astype(float)
    out = {}
    for i, q in zip(ids, x):
        if i % 20 == 0:
            scores = [(-float((q * p).sum()), j) for j, p in zip(ids, x) if j != i]
            out[i] = [(j, -s) for s, j in sorted(scores)[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("shard_rows", [10_000, 60])
def test_factor_one_is_exact(spark, shard_rows):
    rng = np.random.RandomState(1)
    rows = [(i, (rng.randn(8) * rng.uniform(0.2, 3)).tolist()) for i in range(600)]
    got = found(neighbours.nearest(vectors_of(spark, rows), F.col("vec_id") % 20 == 0, factor=1.0, shard_rows=shard_rows))
    want = exact(rows, 20)
    assert {k: [i for i, _ in v] for k, v in got.items()} == {k: [i for i, _ in v] for k, v in want.items()}
    assert all(s == pytest.approx(t, abs=1e-12) for k in got for (_, s), (_, t) in zip(got[k], want[k]))


def test_recall_at_the_standing_factor(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got, want = found(neighbours.nearest(vectors_of(spark, rows), F.col("vec_id") % 20 == 0, shard_rows=100)), exact(rows, 20)
    hits = sum(len({i for i, _ in got[k]} & {i for i, _ in want[k]}) for k in want)
    assert hits >= 0.9 * 20 * len(want)


@pytest.mark.parametrize("kind", ["isotropic", "clustered", 3, 8, 16])
def test_tuned_factor_keeps_recall_on_hard_vectors(spark, kind):
    rng = np.random.RandomState(3)
    x = rng.randn(3000, 32)
    if kind == "clustered":
        x = rng.randn(20, 32)[rng.randint(0, 20, 3000)] + 0.3 * x
    elif kind != "isotropic":
        x = x[:, :kind] @ rng.randn(kind, 32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = list(enumerate(x.astype(np.float32).tolist()))
    got, want = found(neighbours.nearest(vectors_of(spark, rows), F.col("vec_id") % 20 == 0, shard_rows=500)), exact(rows, 20)
    hits = sum(len({i for i, _ in got[k]} & {i for i, _ in want[k]}) for k in want)
    assert hits >= 0.95 * 20 * len(want)


def test_neighbours_of_odd_vectors(spark):
    one, nan = [1.0, 0.0], float("nan")
    rows = [(i, one) for i in range(0, 90)] + [(100, None), (120, []), (140, [0.0, 0.0]), (160, [nan, 1.0]), (180, [float("inf"), 1.0]), (200, [None, 1.0]), (220, [1.0, 2.0, 3.0]), (None, one), (240, [0.5, 0.5]), (240, [0.5, 0.5])]
    got = found(neighbours.nearest(vectors_of(spark, rows), F.col("vec_id") % 20 == 0))
    # Ties of a common vector go to the smaller ids, the query left out.
    assert sorted(got) == [0, 20, 40, 60, 80, 240]
    assert [i for i, _ in got[0]] == list(range(1, 21)) and [i for i, _ in got[80]] == list(range(20))
    assert [i for i, _ in got[240]] == list(range(20)) and {s for _, s in got[240]} == {0.5}
    few = found(neighbours.nearest(vectors_of(spark, [(0, one), (1, [0.0, 1.0])]), F.col("vec_id") % 20 == 0))
    assert few == {0: [(1, 0.0)]}
    assert neighbours.nearest(vectors_of(spark, []), F.col("vec_id") % 20 == 0).count() == 0


def test_boundaries_shift_with_the_text():
    rng = random.Random(2)
    body = prose(rng, 3000).encode()
    plain, moved = chunks.boundaries(body), chunks.boundaries(b"something new " + body)
    assert len({x + 14 for x in plain} & set(moved)) > 0.98 * len(plain)
    piece, chunks.PIECE = chunks.PIECE, 1000
    try:
        assert chunks.boundaries(body) == plain
    finally:
        chunks.PIECE = piece


def test_passages_are_found(spark):
    rng = random.Random(3)
    clean = [prose(rng, 150) for _ in range(40)]
    passages = [prose(rng, 60) for _ in range(12)]
    planted = []
    for p in passages:
        for _ in range(3):
            words = prose(rng, 120).split()
            words.insert(rng.randrange(120), p)
            planted.append(" ".join(words))
    docs = docs_of(spark, clean + planted)
    out = chunks.repeated_passages(docs).collect()
    assert {r.doc_id for r in out} == {40 + 3 * k + j for k in range(12) for j in (1, 2)}
    assert all(r.first_doc_id == 40 + (r.doc_id - 40) // 3 * 3 for r in out)
    texts = dict(enumerate(clean + planted))
    for r in out:
        assert texts[r.doc_id].encode()[r.start : r.end].decode() in texts[r.first_doc_id]
    cut = {r.doc_id: r.text for r in chunks.without_repeats(docs).collect()}
    assert all(cut[i] == texts[i] for i in range(41)) and all(len(cut[r.doc_id]) < len(texts[r.doc_id]) - 100 for r in out)


def test_passages_of_odd_rows(spark):
    long = "word " * 2000
    rows = [(None, long, "", "", 0), (1, long, "", "", 0), (1, long, "", "", 0), (2, None, "", "", 0), (3, "", "", "", 0), (4, long, "", "", 0)]
    out = chunks.repeated_passages(spark.createDataFrame(rows, DOC).withColumn("start", F.lit("clash"))).collect()
    assert [(r.doc_id, r.first_doc_id) for r in out] == [(4, 1)]
    assert chunks.repeated_passages(empty(spark)).count() == 0


def test_fit_distance_is_exact():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ("".join(rng.choice("abé ") for _ in range(rng.randint(lo, 40))) for lo in (1, 0))
        assert decontaminate.fit_distance(a, b) == brute.edit_fit(a, b)


def test_leaks_are_found(spark):
    rng = random.Random(5)
    items = [(i, prose(rng, rng.randint(15, 60)).capitalize() + ".") for i in range(30)] + [(90, "short ITEM!"), (91, None), (92, ""), (None, "no id")]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def edited(text, share):
        return "".join(c if rng.random() > share else rng.choice(["", "x", c + "y"]) for c in text)

    texts, want = [], set()
    for i, text in items[:30]:
        for share in (0, 0.03, 0.08):
            words = prose(rng, 80).split()
            words.insert(rng.randrange(80), edited(text, share).upper())
            want.add((len(texts), i))
            texts.append(" ".join(words))
    texts += [prose(rng, 200) for _ in range(40)] + ["this has a short, item in it", "this has a shorter item", None, "", prose(rng, 50_000)]
    docs = docs_of(spark, texts)
    out = decontaminate.leaks(docs, bench).collect()
    got = {(r.doc_id, r.item_id) for r in out}
    assert got <= want | {(130, 90)} and (130, 90) in got and len(got & want) >= 0.95 * len(want)
    norm = {i: decontaminate.normalised(t).decode() for i, t in items if t}
    for r in out[:40]:
        assert r.distance == brute.edit_fit(norm[r.item_id], decontaminate.normalised(texts[r.doc_id]).decode()) <= 0.2 * len(norm[r.item_id])
    kept = {r.doc_id for r in decontaminate.without_leaks(docs, bench).collect()}
    assert kept == set(range(len(texts))) - {d for d, _ in got}
    # Items in blocks give the same.
    small, decontaminate.item_blocks.__defaults__ = decontaminate.item_blocks.__defaults__, (2000,)
    try:
        assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()} == got
    finally:
        decontaminate.item_blocks.__defaults__ = small


def test_leaks_of_odd_rows(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(odd(spark), none).count() == 0 and decontaminate.without_leaks(odd(spark), none).count() == 5
    some = spark.createDataFrame([(1, "same text twice")], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.distance) for r in decontaminate.leaks(odd(spark).withColumn("distance", F.lit("clash")), some).collect()] == [(3, 1, 0)] * 2
    assert decontaminate.leaks(empty(spark), some).count() == 0


def test_fingerprints_equal_plain_ones():
    rng = random.Random(6)
    for t in [None, "", " \n", "One", "a b", "A b\tc\x0bd E", "é É x", "same " * 50, prose(rng, 500), "x y z w v"]:
        assert simhash.fingerprint(t) == brute.simhash(t)


def test_bit_sliced_distances():
    rng = np.random.RandomState(7)
    centre = rng.randint(0, 1 << 62, 40, dtype=np.uint64)
    prints = np.array([c ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, rng.randint(0, 9), replace=False).astype(np.uint64)) if k else c for c in centre for k in range(8)], np.uint64)
    for radius in (1, 3, 4, 7):
        got = {(i, int(j)) for i, js in simhash.near_rows(prints, prints, np.arange(1, len(prints) + 1), radius) for j in js}
        assert got == {(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if bin(int(prints[i] ^ prints[j])).count("1") <= radius}


@pytest.mark.parametrize("bucket", [4096, 16])
def test_links_join_the_same_classes(spark, bucket):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(15)} | {0, 1, 3}
    signed = {p - (1 << 64) if p >> 63 else p: p for p in prints}
    links = simhash.near_links(spark.createDataFrame([(s,) for s in signed], "fp long"), bucket=bucket)
    got = {r.node: r.component for r in graph.components(links).collect()}
    want = brute.classes({s: p for s, p in signed.items()})
    groups = lambda of: sorted(sorted(s for s in signed if of(s) == c) for c in {of(s) for s in signed})
    assert groups(lambda s: got.get(s, s)) == groups(lambda s: want[s])


def test_classes_of_documents(spark):
    rng = random.Random(9)
    texts = [prose(rng, 120) for _ in range(40)]
    texts += [texts[3], texts[3] + " tail", texts[7].upper(), None, "", " \n"]
    out = {r.doc_id: r.component_id for r in simhash.classes(docs_of(spark, texts)).collect()}
    assert out == brute.classes({i: brute.simhash(t) for i, t in enumerate(texts)})
    assert out[40] == 3 and out[42] == 7 and out[43] == out[44] == out[45] == 43
    kept = {r.doc_id for r in simhash.keep_one(docs_of(spark, texts)).collect()}
    assert kept == set(out.values())


def test_classes_of_odd_rows(spark):
    df = odd(spark).withColumn("fp", F.lit("clash"))
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.classes(df).collect() if r.component_id is not None)
    assert got == [(1, 1), (2, 1), (3, 3), (3, 3)]
    assert sorted(str(r.doc_id) for r in simhash.keep_one(df).collect()) == ["1", "3", "None"]
    assert simhash.classes(empty(spark)).count() == 0


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 499), (7, 7)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 499: 499, 500: 499}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
