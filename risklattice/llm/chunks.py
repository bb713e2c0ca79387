"""Substring dedup by content-defined chunks.

A gear hash rolls over the UTF-8 bytes: the hash at a byte depends on the 32 bytes up to it only, and a chunk ends where its low bits are
below a threshold, at least ``LEAST`` bytes after the last end. Boundaries so move with the content: an insertion changes the
chunks around it and no others. Chunks are deduplicated by a 128-bit digest; consecutive repeated chunks of a document make one
repeated passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from risklattice.session import cut_lineage

LEAST, MEAN = 12, 16  # least bytes of a chunk; mean bytes from there to the next boundary
PASSAGE = 120  # bytes of consecutive repeated chunks that make a passage; 50 words have about 300, of which some 40 at each end are lost
GEAR = np.random.RandomState(7).randint(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
PIECE = 1 << 22  # bytes hashed at a time


def boundaries(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``, the last one its length."""
    total, last, out = len(data), 0, []
    cut = np.uint32((1 << 32) // MEAN)
    for at in range(0, total, PIECE):
        lead = min(at, 31)  # bytes before the piece that its first hashes depend on
        h = GEAR[np.frombuffer(data, np.uint8, min(PIECE, total - at) + lead, at - lead)]
        for shift in (1, 2, 4, 8, 16):  # after these, each hash sums 32 bytes, each shifted by its age
            moved = h.copy()
            moved[shift:] += h[:-shift] << np.uint32(shift)
            h = moved
        # Multiplying spreads the young bytes of the low bits over the whole word.
        mixed = (h * np.uint32(2654435761))[lead:]
        for end in (np.flatnonzero(mixed < cut) + at + 1).tolist():
            if end - last >= LEAST:
                out.append(end)
                last = end
    if total > last:
        out.append(total)
    return out


def chunk_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """doc_id, start, end, h1, h2 of every chunk of every text."""
    from xxhash import xxh3_128_digest

    for rows in batches:
        for at in range(0, len(rows), 256):
            some = rows.iloc[at : at + 256]
            ids, counts, starts, ends, digests = some["doc_id"].to_numpy(), [], [], [], []
            for text in some["text"]:
                data = (text or "").encode("utf-8", "surrogatepass")
                cuts = boundaries(data)
                begins = [0, *cuts[:-1]] if cuts else []
                counts.append(len(cuts))
                starts += begins
                ends += cuts
                digests += [xxh3_128_digest(data[a:b]) for a, b in zip(begins, cuts)]
            if digests:
                two = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                yield pd.DataFrame({"doc_id": np.repeat(ids, counts), "start": np.array(starts, np.int32), "end": np.array(ends, np.int32), "h1": two[:, 0], "h2": two[:, 1]})


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id, start, end (bytes), h1, h2 of all chunks of whole texts. Null ids take no part; null and empty texts have no chunks."""
    return docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInPandas(chunk_rows, "doc_id long, start int, end int, h1 long, h2 long")


def repeated_passages(docs: DataFrame, least_bytes: int = PASSAGE) -> DataFrame:
    """doc_id, start, end (bytes, end exclusive), first_doc_id: passages that a document of smaller id holds too.

    The first document, by smallest id, keeps a passage and is named beside every repeat; one row per passage and document, so
    copies are never paired with each other. Where chunks of one passage come from several firsts, the smallest is named.
    Repeats inside one document alone are not passages here. Repeated rows of one id give their passages once; other columns are not
    read; an empty table gives no rows. Chunks are counted before they are joined, so a hot chunk moves one row per task;
    the join on hot chunks is split by adaptive execution.
    """
    all_chunks = chunks(docs)
    seen = all_chunks.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("_last"))
    shared = seen.filter("first_doc_id < _last").drop("_last")
    later = all_chunks.join(shared, ["h1", "h2"]).filter("doc_id > first_doc_id").groupBy("doc_id", "start", "end").agg(F.min("first_doc_id").alias("first_doc_id"))
    line = Window.partitionBy("doc_id").orderBy("start", "end")
    begins = F.coalesce(F.col("start") > F.lag("end").over(line), F.lit(True))
    runs = later.withColumn("_begins", begins.cast("int")).withColumn("_run", F.sum("_begins").over(line))
    passages = runs.groupBy("doc_id", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("first_doc_id").alias("first_doc_id"))
    return passages.filter(F.col("end") - F.col("start") >= least_bytes).select("doc_id", "start", "end", "first_doc_id")


def without_repeats(docs: DataFrame, least_bytes: int = PASSAGE) -> DataFrame:
    """``docs`` with their repeated passages cut out of the text; texts without any stay as they are. Cuts keep whole characters."""
    spans = cut_lineage(repeated_passages(docs, least_bytes))
    lists = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_spans"))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(texts, spans):
            if text is None or own is None:
                out.append(text)
                continue
            data, at, kept = text.encode("utf-8", "surrogatepass"), 0, []
            for s in own:
                kept.append(data[at : s["start"]])
                at = s["end"]
            out.append(b"".join([*kept, data[at:]]).decode("utf-8", "ignore"))
        return pd.Series(out, dtype=object)

    return docs.join(lists, "doc_id", "left").withColumn("text", cut("text", "_spans")).select(*docs.columns)
