"""Ranked lexical search over bit-sliced Bloom signatures.

The index holds documents in blocks. Within a block, documents with about as many distinct terms share a signature length; bit p of
all their signatures is one row of bits, a slice, with a bit a document. A term sets a few bits, and sets others again, as another
key, where it occurs twice and four times. The slices of a key, joined by "and", overestimate which documents hold it, so sums of
the terms' weights over their slices, each level times what it can add to a score, are upper bounds of all scores of a block.

A search counts the terms' documents exactly from the blocks' own vocabularies, scores some documents of highest bound to learn
how high the last rank must be, and scores from their whole texts all documents whose bound reaches that.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from math import ceil, floor, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from risklattice.llm.pieces import some_texts
from risklattice.session import scratch_path

BLOCK_BYTES = 1 << 22  # bytes of text in a block; a longer text is a block of its own
BITS, PROBES = 8, 4  # at least so many signature bits for each key of a document; bits a key sets
LEVELS = (1, 2, 4)  # occurrences from which a term sets a key of its own
SEEDS = 32  # documents of highest bound scored first, an item
ITEM_BYTES = 1 << 22  # bytes of items searched for at a time; more items are taken in blocks
ITEMS_AT_ONCE = 256
SCALE, LEVEL_OFF, SLOPE = 1_000_000_000, 1000, 8

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
INDEX = "n_docs long, n_terms long, bits int, ids array<long>, sizes array<long>, slices binary, terms array<binary>, held array<long>"


def terms(text: str | None) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII, A-Z lower-cased, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def places(hashed: np.ndarray, level: int, bits: int) -> np.ndarray:
    """The bits that each key sets, a row a key."""
    key = (hashed ^ np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
    key ^= key >> np.uint64(32)
    step = key >> np.uint64(20) | np.uint64(1)
    return ((key[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def block_rows(texts: list[str | None]) -> Iterator[tuple]:
    """Signature rows of one block: (bits, documents, slices), and last (0, vocabulary, documents of each, sizes of documents)."""
    own = [terms(t) for t in texts]
    sizes = np.array([len(x) for x in own], np.int64)
    words = [w for x in own for w in x]
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    key = np.sort(np.repeat(np.arange(len(own)), sizes) * max(1, len(number)) + np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.concatenate([new, [len(key)]]))
    doc, term = np.divmod(key[new], max(1, len(number)))
    hashed = hashes(list(number))
    keys = sum(np.bincount(doc[times >= least], minlength=len(own)) for least in LEVELS)
    widths = np.where(keys > 0, 1 << np.ceil(np.log2(np.maximum(8, keys * BITS))).astype(np.int64), 0)
    for bits in np.unique(widths[widths > 0]).tolist():
        members = np.flatnonzero(widths == bits)
        rank = np.full(len(own), -1)
        rank[members] = np.arange(len(members))
        plane = np.zeros((bits, len(members)), bool)
        for level, least in enumerate(LEVELS):
            of = (times >= least) & (rank[doc] >= 0)
            plane[places(hashed[term[of]], level, bits), rank[doc[of]][:, None]] = True
        yield bits, members, np.packbits(plane, axis=1).tobytes()
    yield 0, list(number), np.bincount(term, minlength=len(number)), sizes


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of a block's documents of one signature length (``ids``, their numbers of terms, ``slices``), and a row a block with its vocabulary.

    ``n_docs`` and ``n_terms`` of that row count its documents that hold a term, and their terms. Documents without terms are in no
    signature. Null ids and repeated rows are documents like others. Other columns are not read. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in INDEX.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())]
        for batch in batches:
            for rows in some_texts(batch, "text", BLOCK_BYTES):
                ids, found = rows.column("id"), list(block_rows(rows.column("text").to_pylist()))
                _, words, held, sizes = found.pop()
                out = [(0, 0, bits, ids.take(pa.array(members)).to_pylist(), sizes[members].tolist(), slices, None, None) for bits, members, slices in found]
                out.append((int((sizes > 0).sum()), int(sizes.sum()), 0, None, None, None, words, held.tolist()))
                yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*out), kinds)], names)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, INDEX)


@dataclass(frozen=True)
class Search:
    """A block of items with the weights of their terms. At most about ``ITEM_BYTES`` of items."""

    items: list[np.ndarray]  # of each item the numbers of its terms
    number: dict[bytes, int]
    hashed: np.ndarray
    weights: np.ndarray
    n_docs: int
    n_terms: int
    least: np.ndarray  # score that a document needs, an item

    def lengths(self, sizes):
        return 100 - 90 + 90 * sizes * self.n_docs // self.n_terms

    def bounds(self, bits: int, sizes: np.ndarray, slices: bytes) -> Iterator[tuple[int, np.ndarray]]:
        """For blocks of items, the first one's number and upper bounds, an item a row and a document a column."""
        plane, lengths, best = np.frombuffer(slices, np.uint8).reshape(bits, -1), self.lengths(sizes), np.zeros(len(sizes), np.int64)
        gains = []
        for above in (*LEVELS[1:], None):  # fewer occurrences than the next level can give at most this
            most = np.full(len(sizes), SCALE // LEVEL_OFF) if above is None else SCALE * (above - 1) // (LEVEL_OFF * (above - 1) + SLOPE * lengths)
            gains.append(most - best)
            best = most
        for begin in range(0, len(self.items), ITEMS_AT_ONCE):
            some = self.items[begin : begin + ITEMS_AT_ONCE]
            used = np.unique(np.concatenate(some))
            out = np.zeros((len(some), len(sizes)), np.int64)
            for level, gain in enumerate(gains):
                rows = np.bitwise_and.reduce(plane[places(self.hashed[used], level, bits)], axis=1)
                held = np.unpackbits(rows, axis=1, count=len(sizes)).astype(np.float64)  # sums of weights are whole numbers far below 2^53
                for i, item in enumerate(some):
                    out[i] += (self.weights[item] @ held[np.searchsorted(used, item)]).astype(np.int64) * gain
            yield begin, out

    def score(self, text: str | None, items: list[int]) -> Iterator[tuple[int, int]]:
        """Exact scores above zero of a whole text."""
        own = terms(text)
        times = Counter(own)
        length = self.lengths(len(own)) if own else 0
        gain = {self.number[w]: SCALE * n // (LEVEL_OFF * n + SLOPE * length) for w, n in times.items() if w in self.number}
        for i in items:
            total = sum(int(self.weights[t]) * gain[t] for t in self.items[i].tolist() if t in gain)
            if total > 0:
                yield i, total


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Items in blocks of about ``ITEM_BYTES``, one at a time, so that what the driver and a task hold has a bound."""
    own = items.filter(F.length(text_col) > 0).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).distinct()
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, ceil(total / ITEM_BYTES))
    for b in range(count):
        some = own.filter(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == b) if count > 1 else own
        block = [(r.id, sorted(set(terms(r.text)))) for r in some.collect()]
        if block := [(i, t) for i, t in block if t]:
            yield sorted(block, key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def prepared(index: DataFrame, block: list[tuple[int | None, list[bytes]]]) -> Search | None:
    """Counts the documents of the items' terms and weighs the terms; none if the corpus holds none of them."""
    asked = index.sparkSession.sparkContext.broadcast(pa.array(sorted({t for _, own in block for t in own}), pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            words, held = rows.column("terms").flatten(), rows.column("held").flatten()
            ours = pc.is_in(words, value_set=asked.value)
            yield pa.RecordBatch.from_arrays([words.filter(ours), held.filter(ours)], ["term", "held"])

    totals = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    counted = index.filter("bits = 0").select("terms", "held").mapInArrow(run, "term binary, held long").groupBy("term").agg(F.sum("held")).collect()
    if not counted:
        return None
    held = {bytes(t): n for t, n in counted}
    number = {t: i for i, t in enumerate(sorted(held))}
    weights = np.array([floor(1000 * log((2 * totals[0] + 2) / (2 * held[t] + 1))) for t in number], np.int64)
    own = [np.array(sorted(number[t] for t in ts if t in number), np.int64) for _, ts in block]
    return Search(own, number, hashes(list(number)), weights, totals[0], totals[1], np.ones(len(own), np.int64))


def highest_bounds(index: DataFrame, sent, count: int) -> DataFrame:
    """doc_id, item: for each item the ``count`` known documents of highest bound of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search: Search = sent.value
        n = len(search.items)
        best, ids = np.zeros((n, count), np.int64), np.zeros((n, count), np.int64)
        for rows in batches:
            for bits, own, sizes, slices in zip(*(rows.column(c).to_pylist() for c in ("bits", "ids", "sizes", "slices"))):
                known = np.array([i is not None for i in own])
                number = np.array([i or 0 for i in own], np.int64)
                for begin, bounds in search.bounds(bits, np.array(sizes, np.int64), slices):
                    of = slice(begin, begin + len(bounds))
                    both = np.concatenate([best[of], np.where(known, bounds, 0)], axis=1)
                    both_ids = np.concatenate([ids[of], np.broadcast_to(number, bounds.shape)], axis=1)
                    top = np.argpartition(-both, count - 1, axis=1)[:, :count]
                    best[of], ids[of] = np.take_along_axis(both, top, axis=1), np.take_along_axis(both_ids, top, axis=1)
        item, place = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(ids[item, place]), pa.array(item.astype(np.int32)), pa.array(best[item, place])], ["doc_id", "item", "bound"])

    found = index.filter("bits > 0").select("bits", "ids", "sizes", "slices").mapInArrow(run, "doc_id long, item int, bound long")
    by_bound = Window.partitionBy("item").orderBy(F.desc("bound"), "doc_id")
    return found.withColumn("r", F.row_number().over(by_bound)).filter(F.col("r") <= count).select("doc_id", "item")


def not_excluded(index: DataFrame, sent) -> DataFrame:
    """doc_id, item: all documents whose bound reaches what the item's last rank needs at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search: Search = sent.value
        for rows in batches:
            for at, (bits, sizes, slices) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("bits", "sizes", "slices")))):
                ids = rows.column("ids").slice(at, 1).flatten()
                for begin, bounds in search.bounds(bits, np.array(sizes, np.int64), slices):
                    item, doc = np.nonzero(bounds >= search.least[begin : begin + len(bounds), None])
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array((item + begin).astype(np.int32))], ["doc_id", "item"])

    return index.filter("bits > 0").select("bits", "ids", "sizes", "slices").mapInArrow(run, "doc_id long, item int")


def rescored(texts: DataFrame, pairs: DataFrame, sent, label: str) -> DataFrame:
    """item, doc_id, score: exact scores of the pairs, from whole texts.

    The pairs are written first, a row a document, so that Spark sends them to the texts only where their size is small.
    """
    path = scratch_path(texts.sparkSession, label)
    pairs.groupBy("doc_id").agg(F.collect_set("item").alias("items")).write.parquet(path)
    asked = texts.sparkSession.read.parquet(path).withColumnRenamed("doc_id", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search: Search = sent.value
        for rows in batches:
            found = [(i, n, s) for n, (text, items) in enumerate(zip(rows.column("text").to_pylist(), rows.column("items").to_pylist())) for i, s in search.score(text, items)]
            item, row, score = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), rows.column("doc_id").take(pa.array(row, pa.int64())), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return texts.join(asked, F.col("doc_id").eqNullSafe(F.col("asked"))).select("doc_id", "text", "items").mapInArrow(run, "item int, doc_id long, score long")


def ranks(scored: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of highest score above zero for every item, equal scores by smaller id.

    Null and empty texts hold no terms; such items have no rows. Repeated rows of ``docs`` are documents of their own and may both
    be ranked; null document ids come after all others of equal score. Repeated equal items are one; different texts under one
    item id are ranked apart. Other columns are not read. The index is written once to the shared folder.
    """
    spark: SparkSession = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    path = scratch_path(spark, "signatures")
    build_index(texts).write.parquet(path)
    index, out = spark.read.parquet(path), None
    for block in item_blocks(items, item_col, item_text):
        found = prepared(index, block)
        if found is None:
            continue
        sent = spark.sparkContext.broadcast(found)
        seeds = ranks(rescored(texts, highest_bounds(index, sent, max(SEEDS, top)), sent, "seeds"), top).filter(F.col("rank") == top)
        least = found.least.copy()
        for r in seeds.collect():  # at most a row an item of the block
            least[r.item] = r.score
        sent = spark.sparkContext.broadcast(replace(found, least=least))
        best = ranks(rescored(texts, not_excluded(index, sent), sent, "candidates"), top)
        names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(block)], f"item int, {item_col} long")
        some = best.join(names, "item").select(item_col, F.col("rank").cast("int").alias("rank"), F.col("doc_id").alias(id_col), "score")
        out = some if out is None else out.unionByName(some)
    return spark.createDataFrame([], f"{item_col} long, rank int, {id_col} long, score long") if out is None else out


_UPPER, _TERM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SQL = f"""
WITH own AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_TERM}') AS terms
    FROM documents),
sized AS (SELECT r, doc_id, len(terms) AS n FROM own WHERE len(terms) > 0),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sized),
times AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM own) GROUP BY r, term),
asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{_TERM}')) AS term
    FROM benchmark),
weights AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM times, totals WHERE term IN (SELECT term FROM asked) GROUP BY term),
lengths AS (SELECT r, doc_id, 100 - 90 + (90 * n * docs) // terms AS m FROM sized, totals),
scored AS (
    SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
    FROM asked JOIN weights USING (term) JOIN times USING (term) JOIN lengths USING (r)
    GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10
"""
