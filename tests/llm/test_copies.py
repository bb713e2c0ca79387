"""The pipeline's near copies: exact similarity, one of each, and the odd cases."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from risklattice.llm import copies
from test_pair_operators import prose
from test_text_operators import docs_of, empty, odd


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def similarity(a, b):
    x, y = shingle_set(a), shingle_set(b)
    return len(x & y) / len(x | y)


def test_no_near_copies_stay_and_none_goes_alone(spark):
    rng = random.Random(12)
    texts = [prose(rng, 200) for _ in range(30)]
    for k in range(30):
        for edits in (1, 2, 3, 4, 6, 9):  # similarities from 0.95 down to 0.6
            words = texts[k].split()
            for at in rng.sample(range(200), edits):
                words[at] = "other"
            texts.append(" ".join(words))
    kept = {r.doc_id for r in corpus_pipeline.one_of_each(spark, docs_of(spark, texts), "").collect()}
    assert [(a, b) for a in kept for b in kept if a < b and similarity(texts[a], texts[b]) >= 0.8] == []
    lost = set(range(len(texts))) - kept
    assert len(lost) > 60 and all(any(a < b and similarity(texts[a], texts[b]) >= 0.8 for a in kept) for b in lost)


def test_all_that_share_a_band_meet(spark):
    rng = random.Random(13)
    texts = [prose(rng, 100) for _ in range(60)]
    texts += [t + " tail" for t in texts[40:]]
    one = docs_of(spark, texts).select(F.col("doc_id").alias("id"), F.array(F.lit(1).cast("long")).alias("bands"))
    assert {r.id for r in copies.copies(one, docs_of(spark, texts), 5, 0.8).collect()} == set(range(60, 80))


def test_texts_that_share_a_passage_but_are_no_copies(spark):
    """A hot group of band mates at 0.6 to 0.8 and some real copies among them: as brute force by ascending id says, with pairs in proportion."""
    rng = random.Random(14)
    passage = prose(rng, 120)
    texts = [f"{passage} {prose(rng, rng.randint(25, 40))}" for _ in range(150)]
    texts += [t + " tail" for t in texts[::10]]
    sets = {i: shingle_set(t) for i, t in enumerate(texts)}
    kept = []
    for i, own in sets.items():
        if not any(len(own & sets[j]) >= 0.8 * len(own | sets[j]) for j in kept):
            kept.append(i)
    docs = docs_of(spark, texts)
    assert {r.doc_id for r in copies.keep_one(docs).collect()} == set(kept)
    every = copies.shingle_sets(docs, 5)
    near = {(r.id, r.other) for r in copies.joined(every, 0.8).collect()}
    assert near == {(i, j) for i in sets for j in sets if i > j and similarity(texts[i], texts[j]) >= 0.8}


def test_settled_follows_the_order_of_ids(spark):
    rng = random.Random(15)
    for links in ([], [(i + 1, i) for i in range(30)], [(i, 0) for i in range(1, 40)], sorted({(max(a, b), min(a, b)) for a, b in (rng.sample(range(40), 2) for _ in range(60))})):
        stay, gone = set(), set()
        for i in range(41):
            (gone if any(a == i and b in stay for a, b in links) else stay).add(i)
        df = spark.createDataFrame(links, "id long, other long")
        assert {r.id for r in copies.settled(df).collect()} == gone


def test_long_texts_are_compared_whole(spark):
    rng = random.Random(16)
    long = prose(rng, 60_000)
    texts = [long, long + " " + prose(rng, 6_000), prose(rng, 60_000), long[: len(long) // 2]]
    assert {r.doc_id for r in copies.keep_one(docs_of(spark, texts)).collect()} == {0, 2, 3}


def test_copies_of_odd_rows(spark):
    assert sorted(str(r.doc_id) for r in copies.keep_one(odd(spark).withColumn("id", F.lit("clash"))).collect()) == ["1", "3", "None"]
    assert copies.keep_one(empty(spark)).count() == 0
