"""Near copies by SimHash classes and bands of minima, verified by the exact Jaccard similarity of word shingles.

Texts of one SimHash class, or that share a band of minima of their shingles, are candidates. They are compared with the smallest of
their bands, which stays; those that are left are joined by their rarest shingles, exactly. Only sets of shingles move, never texts,
and a pair is made only where the sets can be similar enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risklattice.llm import simhash
from risklattice.llm.pieces import lists, some_texts
from risklattice.session import cut_lineage

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 6  # a pair of similarity s shares a band with 1 - (1 - s^6)^24: 0.9993 at 0.8, 0.9999999 at 0.9
MANY = 0.1  # a round that removes a smaller share of those left is the last
AT_ONCE = 1 << 12  # shingles in memory at a time
MIX = np.uint64(0x9E3779B97F4A7C15)
FACTORS, SHIFTS = (np.random.RandomState(k).randint(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) for k in (3, 4))
FACTORS |= np.uint64(1)


def mixed(now: np.ndarray, more: np.ndarray) -> np.ndarray:
    now = (now ^ more) * MIX
    return now ^ now >> np.uint64(29)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles, read as ``simhash.fingerprint`` reads them; fewer than ``words``: the whole sequence."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxh64_intdigest, parts), np.uint64, len(parts))
    n = max(1, len(parts) - words + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(words, len(parts))):
        out = mixed(out, hashes[i : i + n])
    return np.unique(out)


def bands(own: np.ndarray) -> np.ndarray:
    """A key for each band of minima; none for no shingles."""
    if not len(own):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(own), AT_ONCE):
        least = np.minimum(least, (FACTORS[:, None] * own[None, i : i + AT_ONCE] + SHIFTS[:, None]).min(axis=1))
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = mixed(keys, column)
    return keys.view(np.int64)


def marked(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, node, bands of every row with an id; texts of the same shingles have the same node."""

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh64_intdigest

        for rows in batches:
            own = [shingles(t, words) for t in rows["text"]]
            nodes = np.array([xxh64_intdigest(x.tobytes()) for x in own], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": rows["doc_id"], "node": nodes, "bands": [bands(x) for x in own]})

    return docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInPandas(mark, "doc_id long, node long, bands array<long>")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """id, own: the shingles of each text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in some_texts(batch, "text"):
                own = [shingles(t, words).view(np.int64) for t in rows.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column("id"), lists(own, pa.int64())], ["id", "own"])

    return docs.select(F.col("doc_id").alias("id"), "text").mapInArrow(cut, "id long, own array<long>")


def near_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (id, other) whose sets have the similarity."""
    left, right = sets.select("id", F.col("own").alias("_a")), sets.select(F.col("id").alias("other"), F.col("own").alias("_b"))
    both = F.size(F.array_intersect("_a", "_b"))
    least = both >= F.lit(similarity) * (F.size("_a") + F.size("_b") - both) - 1e-9
    return pairs.join(left, "id").join(right, "other").filter(least).select("id", "other")


def joined(sets: DataFrame, similarity: float) -> DataFrame:
    """id > other: all pairs of sets with the similarity, whatever else they have in common.

    Shingles are ordered by how many of the sets hold them, the rarest first. Two sets that are similar enough share a shingle
    among the first few of each, at places after which enough of both is left; what many sets hold comes last and leads to no pair.
    """
    each = sets.select("id", F.size("own").alias("n"), F.explode("own").alias("shingle"))
    held = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("held"))
    order = F.sort_array(F.collect_list(F.struct("held", "shingle")))
    t = similarity
    probing, filing = (F.col("n") - F.ceil(F.col("n") * F.lit(share) - 1e-9) + 1 for share in (t, 2 * t / (1 + t)))
    first = each.join(held, "shingle").groupBy("id", "n").agg(order.alias("_all")).select("id", "n", filing.alias("_filing"), F.posexplode(F.slice("_all", F.lit(1), probing.cast("int"))).alias("at", "_s"))
    first = cut_lineage(first.filter("_s.held > 1").select("id", "n", "at", "_filing", F.col("_s.shingle").alias("shingle")))
    small = first.filter("at < _filing").select("shingle", F.col("id").alias("_a"), F.col("n").alias("_na"), F.col("at").alias("_ia"))
    large = first.select("shingle", F.col("id").alias("_b"), F.col("n").alias("_nb"), F.col("at").alias("_ib"))
    ahead = (F.col("_na") < F.col("_nb")) | ((F.col("_na") == F.col("_nb")) & (F.col("_a") < F.col("_b")))
    enough = F.least(F.col("_na") - F.col("_ia"), F.col("_nb") - F.col("_ib")) >= (F.col("_na") + F.col("_nb")) * F.lit(t / (1 + t)) - 1e-9
    met = small.join(large, "shingle").filter(ahead & (F.col("_na") >= F.col("_nb") * F.lit(t) - 1e-9) & enough)
    return near_pairs(met.select(F.greatest("_a", "_b").alias("id"), F.least("_a", "_b").alias("other")).distinct(), sets, similarity)


def settled(links: DataFrame) -> DataFrame:
    """id of those nodes of ``links`` (id > other) that go if, in order of ids, each stays unless it is linked to one that stays."""
    links, gone = cut_lineage(links), None
    while not links.isEmpty():
        stay = links.select("other").distinct().join(links.select(F.col("id").alias("other")).distinct(), "other", "left_anti")
        lost = cut_lineage(links.join(stay, "other").select("id").distinct())
        gone = lost if gone is None else gone.unionByName(lost)
        rest = links.join(lost, "id", "left_anti").join(lost.select(F.col("id").alias("other")), "other", "left_anti")
        links = cut_lineage(rest.select("id", "other"))
    return links.select("id") if gone is None else gone


def copies(alive: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """id of those of ``alive`` (id, bands) that are near copies of one of smaller id which stays.

    A text that is the smallest of all its bands stays, and what shares a band with it is compared with it, as long as that removes many.
    So a large class costs one comparison a member. What is left shares bands for other reasons, such as a passage that many
    hold; it is joined by its rare shingles.
    """
    filed = alive.select("id", F.explode("bands").alias("band"))
    pool = cut_lineage(shared(filed))
    moving = docs.join(pool.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sets = cut_lineage(shingle_sets(moving, words))
    out, before = alive.select("id").limit(0), None
    while True:
        heads = pool.groupBy("band").agg(F.min("id").alias("other"))
        beside = pool.join(heads, "band").select("id", "other")
        stay = beside.groupBy("id").agg(F.bool_and(F.col("id") == F.col("other")).alias("_s")).filter("_s").select("id")
        stay = cut_lineage(stay)
        pairs = beside.filter("id <> other").distinct().join(stay.select(F.col("id").alias("other")), "other", "left_semi")
        lost = cut_lineage(near_pairs(pairs, sets, similarity).select("id").distinct())
        pool = cut_lineage(shared(pool.join(lost, "id", "left_anti").join(stay, "id", "left_anti").select("id", "band")))
        out = out.unionByName(lost)
        removed, left = lost.count(), pool.select("id").distinct().count()
        if left == 0:
            return out
        if removed <= MANY * left:
            break
    rest = sets.join(pool.select("id").distinct(), "id", "left_semi")
    return out.unionByName(settled(joined(cut_lineage(rest), similarity)))


def shared(filed: DataFrame) -> DataFrame:
    """Rows of bands that more than one text has."""
    many = filed.groupBy("band").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("band")
    return filed.join(many, "band").select("id", "band")


def keep_one(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without near copies: rows whose shingles have a Jaccard similarity of ``similarity`` or more to a document of smaller id that stayed so far.

    Similarity is exact, and a document goes only beside one that it was compared with. Pairs that share no band are not seen.
    Null and empty texts are copies of each other. Of repeated rows of one id one stays; rows with a null id cannot be named and
    stay. An empty table gives no rows.
    """
    rows = cut_lineage(marked(docs, words))
    alive = rows.groupBy("node").agg(F.min("doc_id").alias("id"), F.min_by("bands", "doc_id").alias("bands"))
    # A SimHash class is one more band, so copies within its radius meet the smallest of their class.
    found = simhash.classes(docs.filter(F.col("doc_id").isNotNull()), words).groupBy(F.col("doc_id").alias("id")).agg(F.min("component_id").alias("_class"))
    alive = cut_lineage(alive.join(found, "id").select("id", F.when(F.size("bands") > 0, F.array_append("bands", F.xxhash64("_class"))).otherwise(F.col("bands")).alias("bands")))
    stay = docs.join(alive.join(copies(alive, docs, words, similarity), "id", "left_anti").select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    if not rows.groupBy("doc_id").count().filter("count > 1").isEmpty():
        stay = stay.dropDuplicates(["doc_id"])
    return stay.unionByName(docs.filter(F.col("doc_id").isNull()))
