"""Alignment of two tokenizers over the same text: groups between shared cuts, linked tokens, and how common each link is.

Method: both token sequences are ends of byte ranges of one text. An interval of tokens whose ends agree is cut in two at a common
end near its middle, found by bisecting the other sequence for the ends closest to the middle, and both halves are cut again; an
interval without a common end inside is a leaf group. All intervals of one depth, of all texts at hand, are cut together.

How many documents hold a link is counted over the corpus. Documents stay in blocks of a bounded size: a block asks once for each
link it holds, so a link of every document is one row a block, and the answers go back to their blocks.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from risklattice.llm.pieces import Encoder, Model, SPACE, lists, load, some_texts
from risklattice.llm.tokens import PRE_TOKEN, special_strings
from risklattice.llm.tokens import load as load_bytes
from risklattice.session import scratch_path

BLOCK_BYTES = 1 << 21  # bytes of text in a block; a longer text is a block of its own
MEMO_ENTRIES, MEMO_CHARS = 1 << 17, 64

ALIGNED = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pair array<long>, times array<int>, block_pair array<long>, block_docs array<long>"


class ByteTokens:
    """Ids of texts by a byte-level vocabulary, strings of added tokens being plain text, and the bytes of each id."""

    def __init__(self, path: str):
        import regex

        special_strings(path)  # refuses vocabularies that cut text otherwise
        self.tok, self.cut, self.memo = load_bytes(path), regex.compile(PRE_TOKEN), {}
        self.tok.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes written as themselves; the rest follow from 256 on
        rest = [b for b in range(256) if b not in set(own)]
        byte_of = {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}
        table = [b""] * self.tok.get_vocab_size()
        for text, i in vocabulary.items():
            table[i] = bytes(byte_of[c] for c in text) if all(c in byte_of for c in text) else text.encode("utf-8")
        self.table = table
        self.bytes = np.array([*table, None], object)[:-1]

    def encode(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of texts, none where their bytes are not the text's. Distinct pre-tokens are merged and compared once each; a text is its pre-tokens."""
        memo, own, odd = self.memo, self.table, set()
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        words = [self.cut.findall(t) for t in texts]
        new = list(set().union(*words).difference(memo))
        for word, found in zip(new, self.tok.encode_batch_fast(new, add_special_tokens=False) if new else []):
            ids = found.ids
            memo[word] = array("I", ids).tobytes()
            if b"".join([own[i] for i in ids]) != word.encode("utf-8"):
                odd.add(word)
        out = [None if odd and not odd.isdisjoint(some) else np.frombuffer(b"".join(map(memo.__getitem__, some)), "<u4") for some in words]
        for word in new:
            if len(word) > MEMO_CHARS or word in odd:
                del memo[word]
        return out


class PieceTokens:
    """Ids of texts by a piece model, and the bytes of each id."""

    def __init__(self, model: Model):
        self.encoder, self.unknown = Encoder(model), model.unknown
        table = [p.replace(SPACE, " ").encode("utf-8") for p in model.pieces]
        for b, i in enumerate(model.byte_ids):
            table[i] = bytes([b])
        self.bytes = np.array([*table, None], object)[:-1]

    def encode(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of texts, none where their bytes are not a space and the text."""
        forms = [self.encoder.form(t) for t in texts]
        out = list(self.encoder.merged(forms))
        for n, (form, text, ids) in enumerate(zip(forms, texts, out)):
            # Pieces without an unknown one give the normalised text back.
            if form.replace(SPACE, " ") != f" {text}" or self.unknown in ids:
                out[n] = None
        return out


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of both sequences that close the leaf groups, in order.

    ``ends`` rise over all texts together; text t holds tokens ``first[t]`` to ``first[t + 1]`` of each sequence, and its last ends agree.
    """
    now = np.stack([first_a[:-1], first_a[1:], first_b[:-1], first_b[1:]]).astype(ends_a.dtype)
    now = now[:, now[1] > now[0]]
    place = np.searchsorted(ends_b, ends_a).astype(ends_a.dtype)  # all ends of the first side bisected in the second
    common = ends_b[np.minimum(place, len(ends_b) - 1)] == ends_a if len(ends_b) else np.zeros(len(ends_a), bool)
    closed = []
    while now.shape[1]:
        single = (now[1] - now[0] == 1) | (now[3] - now[2] == 1)
        closed.append(now[:, single])
        now, halves, step = now[:, ~single], [], 0
        while now.shape[1]:  # ends nearest the middle first: 0, -1, 1, -2, 2, ...
            away = -(step + 1) // 2 if step % 2 else step // 2
            at = (now[0] + now[1] - 2) // 2 + away
            hit = (at >= now[0]) & (at < now[1] - 1)
            hit &= common[np.where(hit, at, 0)]
            (lo_a, hi_a, lo_b, hi_b), a = now[:, hit], at[hit]
            b = place[a] + 1
            halves += [np.stack([lo_a, a + 1, lo_b, b]), np.stack([a + 1, hi_a, b, hi_b])]
            done = ~hit & (2 * abs(away) > now[1] - now[0])  # no end is left on either side
            closed.append(now[:, done])
            now, step = now[:, ~(hit | done)], step + 1
        now = np.concatenate(halves, axis=1) if halves else now
    leaves = np.concatenate(closed, axis=1) if closed else np.zeros((4, 0), np.int64)
    order = np.argsort(leaves[1], kind="stable")
    return leaves[1][order] - 1, leaves[3][order] - 1


class Aligner:
    """Aligns texts inside a worker."""

    def __init__(self, path: str, model: Model):
        self.a, self.b = ByteTokens(path), PieceTokens(model)
        self.sizes = [np.array([len(x) for x in side.bytes], np.int64) for side in (self.a, self.b)]
        # Each id as the text of a group needs it: followed by another of its side, or closing its side.
        self.written = [np.array([f"{i}{sign}" for sign in signs for i in range(len(side.bytes))], object) for side, signs in ((self.a, ",|"), (self.b, ",;"))]

    def tokens(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides; none where either side's bytes are not a space and the text."""
        own = [t or "" for t in texts]
        all_a, all_b = self.a.encode([f" {t}" if t else "" for t in own]), self.b.encode(own)
        none = np.zeros(0, "<u4")
        for n, (t, a, b) in enumerate(zip(own, all_a, all_b)):
            if not t or a is None or b is None:
                all_a[n] = all_b[n] = none
        return all_a, all_b

    def align(self, texts: list[str | None]):
        """Per text: sizes of both sides, groups, links, text of the groups; and rows (text, pair, times) in order of text and pair."""
        all_a, all_b = self.tokens(texts)
        n_a, n_b = np.array([len(x) for x in all_a]), np.array([len(x) for x in all_b])
        first_a, first_b = np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])
        ids_a, ids_b = np.concatenate(all_a).astype(np.int64), np.concatenate(all_b).astype(np.int64)
        ends_a, ends_b = np.cumsum(self.sizes[0][ids_a]), np.cumsum(self.sizes[1][ids_b])
        small = np.int32 if len(ends_a) == 0 or ends_a[-1] < 1 << 31 else np.int64
        last_a, last_b = shared_cuts(ends_a.astype(small), ends_b.astype(small), first_a, first_b)

        # The stretch between two ends of either side belongs to one token of each: that is a link. An end's tokens are
        # those after all ends of their side before it.
        both = np.sort(np.concatenate([2 * ends_a, 2 * ends_b + 1]))
        of_b = both & 1
        new = np.concatenate([[True], both[1:] >> 1 != both[:-1] >> 1])[: len(both)]
        at_b = (np.cumsum(of_b) - of_b)[new]
        at_a = np.flatnonzero(new) - at_b
        text, width = np.repeat(np.arange(len(texts)), n_a)[at_a], len(self.sizes[1])
        n_links = np.bincount(text, minlength=len(texts))
        key = np.sort((text * len(self.sizes[0]) + ids_a[at_a]) * width + ids_b[at_b])
        begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        times = np.diff(np.concatenate([begins, [len(key)]])).astype(np.int32)
        text, b_of = np.divmod(key[begins], width)
        text, a_of = np.divmod(text, len(self.sizes[0]))

        # Groups as text: a token comes after all earlier ones of its side and those of the other side in groups before, its own too for the second side.
        closes_a, closes_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        closes_a[last_a], closes_b[last_b] = 1, 1
        group_a, group_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
        words = np.empty(len(ids_a) + len(ids_b), object)
        words[np.arange(len(ids_a)) + np.concatenate([[0], last_b + 1])[group_a]] = self.written[0][ids_a + closes_a * len(self.sizes[0])]
        words[np.arange(len(ids_b)) + (last_a + 1)[group_b]] = self.written[1][ids_b + closes_b * width]
        words = words.tolist()
        n_groups = np.diff(np.searchsorted(last_a, first_a))
        joint = first_a + first_b
        groups = ["".join(words[i:j])[:-1] for i, j in zip(joint.tolist(), joint[1:].tolist())]
        return n_a, n_b, n_groups, n_links, groups, (text, a_of << 32 | b_of, times)


def align(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups, pair, times for every row, and what its block holds.

    ``groups`` lists the ids of each leaf group, ``a1,a2|b1;a3|b2``; ``pair`` the distinct links of the text, ``a << 32 | b``, and
    ``times`` their occurrences. The first row of a block of texts also carries the block's distinct links and how many of its
    rows hold each. Null and empty texts, and texts that a side cannot give back byte for byte, have no tokens: zeros and an
    empty text. Null ids and repeated rows are kept, a row each. Other columns are not read. No shuffle: one pass in place.
    """
    sent = docs.sparkSession.sparkContext.broadcast(load(piece_path))  # at most the vocabulary
    schema = to_arrow_schema(StructType.fromDDL(ALIGNED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, block = Aligner(byte_path, sent.value), TaskContext.get().partitionId() << 32
        for batch in batches:
            for rows in some_texts(batch, "text", BLOCK_BYTES):
                n = rows.num_rows
                n_a, n_b, n_groups, n_links, groups, (text, pair, times) = aligner.align(rows.column("text").to_pylist())
                cuts = np.searchsorted(text, np.arange(n + 1))
                asked, held = np.unique(pair, return_counts=True)
                empty = [np.zeros(0, np.int64)] * (n - 1)
                counts = [pa.array(x.astype(np.int64)) for x in (n_a, n_b, n_groups, n_links)]
                own = [lists([x[i:j] for i, j in zip(cuts, cuts[1:])], kind) for x, kind in ((pair, pa.int64()), (times, pa.int32()))]
                of_block = [lists([x, *empty], pa.int64()) for x in (asked, held)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), rows.column("id"), *counts, pa.array(groups, pa.string()), *own, *of_block], schema=schema)
                block += 1

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, ALIGNED).withColumnRenamed("doc_id", id_col)


def with_counts(aligned: DataFrame) -> DataFrame:
    """``aligned`` with n_best, the links whose count is the highest of their first id, and count_sum, the sum of their counts.

    A link's count is the number of rows, corpus-wide, that hold it. ``aligned`` is written once; only links, a row for each block
    that holds one, and the written rows themselves are shuffled, and a group is never larger than its block of texts.
    """
    spark = aligned.sparkSession
    path = scratch_path(spark, "aligned")
    aligned.write.parquet(path)
    rows = spark.read.parquet(path).drop("block_pair", "block_docs")
    asked = spark.read.parquet(path).filter(F.size("block_pair") > 0).select("block", F.explode(F.arrays_zip("block_pair", "block_docs")).alias("x")).select("block", F.col("x.block_pair").alias("link"), F.col("x.block_docs").alias("docs"))
    counts = asked.groupBy("link").agg(F.sum("docs").alias("count"))
    first = Window.partitionBy(F.shiftright("link", 32))  # at most the other vocabulary
    counts = counts.select("link", "count", (F.col("count") == F.max("count").over(first)).alias("best"))
    answers = asked.join(counts, "link").select("block", "link", "count", "best")

    kept = [f for f in rows.schema.fields if f.name not in ("pair", "times")]
    out_type = StructType([*kept]).add("n_best", "long").add("count_sum", "long")
    schema = to_arrow_schema(out_type)

    def answered(own: pa.Table, links: pa.Table) -> pa.Table:
        link = links.column("link").to_numpy()
        order = np.argsort(link)
        link, count, best = link[order], links.column("count").to_numpy()[order], links.column("best").to_numpy()[order].astype(np.int64)
        pair, times = own.column("pair").combine_chunks(), own.column("times").combine_chunks()
        offsets = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(pair).to_numpy(zero_copy_only=False))])
        at, n = np.searchsorted(link, pair.flatten().to_numpy()), times.flatten().to_numpy().astype(np.int64)
        sums = [np.concatenate([[0], np.cumsum(x)]) for x in ((n * best[at], n * count[at]) if len(at) else (n, n))]
        return pa.table([*(own.column(f.name) for f in kept), *(pa.array(s[offsets[1:]] - s[offsets[:-1]]) for s in sums)], schema=schema)

    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(answered, out_type)
