"""SimHash near-dedup with bit-sliced comparison.

Distinct fingerprints are filed under bands: the 64 bits are cut into m blocks, and two fingerprints that differ in at
most r bits agree wholly in at least m - r blocks, so each choice of m - r blocks is a band and no link is missed. In a band's
bucket the fingerprints stand as 64 bit planes, 64 fingerprints to a machine word; the distances of a whole word grow at once
in carry-save bit counters, and a block is abandoned once all its distances exceed the radius. A bucket returns a spanning star
per class, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from risklattice.llm.graph import components
from risklattice.session import cut_lineage

WORDS, RADIUS, SEED = 4, 4, 42
BUCKET = 4096  # fingerprints compared by one task at a time; larger buckets are dealt out in pairs of blocks
QUERIES = 256  # fingerprints whose distances to a bucket are counted together
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
AT_ONCE = 1 << 15  # shingles in memory at a time


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """SimHash of a text's word shingles, repeats included; no words: zero. Fewer than ``words``: the whole sequence."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(parts) - words + 1)
    first, last = starts[:n].tolist(), ends[len(parts) - n :].tolist()
    ones = np.zeros(64, np.int64)
    for i in range(0, n, AT_ONCE):
        hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(first[i : i + AT_ONCE], last[i : i + AT_ONCE])], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(i) for i in np.flatnonzero(2 * ones > n))


def fingerprints(text: Column | str, words: int = WORDS) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64))

    return hashed(text)


def planes_of(prints: np.ndarray) -> np.ndarray:
    """64 rows of words: bit k of word w of row b is bit b of fingerprint 64 w + k."""
    padded = np.zeros(-(-len(prints) // 64) * 64, np.uint64)
    padded[: len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def near_rows(prints: np.ndarray, queries: np.ndarray, ahead: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(query, places of prints within ``radius``), looking only at prints from place ``ahead[query]`` on."""
    planes, total = planes_of(prints), len(prints)
    place = np.arange(planes.shape[1] * 64)
    steps = radius.bit_length()
    # Counters start so that a carry leaves the highest one exactly when the distance passes the radius.
    offset = (1 << steps) - radius - 1
    for at in range(0, len(queries), QUERIES):
        q, start = queries[at : at + QUERIES], ahead[at : at + QUERIES]
        skip = int(start.min()) // 64 * 64
        if skip >= len(place):
            continue
        out = (place[None, skip:] < start[:, None]) | (place[None, skip:] >= total)
        over = np.ascontiguousarray(np.packbits(out, axis=1, bitorder="little")).view(np.uint64)
        counters = [np.full_like(over, FULL if offset >> k & 1 else 0) for k in range(steps)]
        rows = np.arange(len(q))
        for b in range(64):
            carry = planes[b, skip // 64 :][None, :] ^ np.where(q >> np.uint64(b) & np.uint64(1), FULL, np.uint64(0))[:, None]
            for k in range(steps):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            over |= carry
            if b % 8 == 7:
                live = (over != FULL).any(axis=1)
                if not live.all():
                    q, over, rows = q[live], over[live], rows[live]
                    counters = [c[live] for c in counters]
                    if not len(q):
                        break
        if len(q):
            near = np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little")
            for row, hits in zip(rows.tolist(), near):
                yield at + row, np.flatnonzero(hits) + skip


def spanning(prints: np.ndarray, left: int, radius: int) -> list[tuple[int, int]]:
    """Links (place, root) that join all prints within the radius of each other or, if ``left``, those between the first ``left`` and the rest."""
    n = len(prints)
    queries, ahead = (prints[:left], np.full(left, left)) if left else (prints[:-1], np.arange(1, n))
    label = np.arange(n)
    for i, js in near_rows(prints, queries, ahead, radius):
        met = np.unique(np.append(label[js], label[i]))
        if len(met) > 1:
            label[np.isin(label, met)] = met[0]
    return [(k, int(label[k])) for k in np.flatnonzero(label != np.arange(n)).tolist()]


def banded(prints: DataFrame, radius: int, blocks: int) -> DataFrame:
    """band, value, fp: each fingerprint under every choice of ``blocks - radius`` blocks; value keeps only their bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << (edges[c + 1] - edges[c])) - 1) << edges[c] for c in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    filed = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks]))
    return prints.select("fp", filed.alias("band", "value"))


def compare_groups(radius: int):
    """Function over batches sorted by (band, value, pair, side): links of each group, which may lie across batches."""

    def links(group: pd.DataFrame) -> pd.DataFrame:
        fp, left = group["fp"].to_numpy(), int((group["side"] == 0).sum())
        if len(fp) < 2 or (left == 0):
            return pd.DataFrame({"a": fp[:0], "b": fp[:0]})
        found = spanning(fp.view(np.uint64), left if left < len(fp) else 0, radius)
        return pd.DataFrame({"a": fp[[x for x, _ in found]], "b": fp[[y for _, y in found]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            now = batch if rest is None or rest.empty else pd.concat([rest, batch], ignore_index=True)
            if now.empty:
                continue
            keys = now[["band", "value", "pair"]].to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            begins = [0, *cuts.tolist()]
            out = [links(now.iloc[a:b]) for a, b in zip(begins[:-1], begins[1:]) if b - a > 1]
            if out:
                yield pd.concat(out, ignore_index=True)
            rest = now.iloc[begins[-1] :]
        if rest is not None and len(rest) > 1:
            yield links(rest)

    return run


def near_links(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) whose transitive closure is that of all pairs within ``radius``.

    The number of blocks rises with the table so that a bucket holds few unrelated fingerprints; the result does not depend
    on it. A bucket above ``bucket`` rows is dealt into blocks that meet in pairs, one pair a group, so no group is larger.
    """
    total = prints.count()
    blocks = next((m for m in range(radius + 1, 2 * radius + 1) if total >> (64 * (m - radius) // m) <= bucket // 2), 2 * radius)
    filed = banded(prints, radius, blocks)
    sizes = filed.groupBy("band", "value").count().filter(F.col("count") > bucket)
    parts = F.ceil(F.col("count") / (bucket // 2)).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    large = filed.join(sizes, ["band", "value"]).withColumn("parts", parts).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = large.select("band", "value", (F.least("mine", "other") * F.col("parts") + F.greatest("mine", "other")).cast("long").alias("pair"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "fp")
    small = filed.join(sizes, ["band", "value"], "left_anti").select("band", "value", F.lit(-1).cast("long").alias("pair"), F.lit(0).alias("side"), "fp")
    groups = small.unionByName(dealt).repartition("band", "value", "pair").sortWithinPartitions("band", "value", "pair", "side", "fp")
    return groups.mapInPandas(compare_groups(radius), "a long, b long")


def classes(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id for every row.

    Null and empty texts have fingerprint zero and link like any other. The component of a row is the smallest doc_id reachable over
    links of at most ``radius`` bits; null ids never name a component, and one of null ids alone has null. Equal fingerprints
    are one node, so exact copies cost one row. Other columns are not read; an empty table gives no rows.
    """
    marked = cut_lineage(docs.select("doc_id", fingerprints(F.coalesce("text", F.lit("")), words).alias("fp")))
    nodes = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = components(near_links(nodes.select("fp"), radius)).select(F.col("node").alias("fp"), "component")
    placed = nodes.join(linked, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    of_print = cut_lineage(placed.select("fp", "component").join(named, "component").select("fp", "component_id"))
    return marked.join(of_print, "fp").select("doc_id", "fp", "component_id")


def as_hex(fp: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest doc_id; of repeated rows of one id one stays.

    Rows with a null id cannot be named and stay.
    """
    found = classes(docs, words, radius)
    kept = cut_lineage(found.filter("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")))
    stay = docs.join(kept.select("doc_id"), "doc_id", "left_semi")
    if not kept.filter("rows > 1").isEmpty():
        stay = stay.dropDuplicates(["doc_id"])
    return stay.unionByName(docs.filter(F.col("doc_id").isNull()))
