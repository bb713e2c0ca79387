"""Find records of one source that repeat a record of another, and use them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risklattice.functions.text import content_words
from risklattice.session import cut_lineage, scratch_path

LINK_THRESHOLD = 0.60
HOT_ROWS = 4096  # rows of one side of a block that meet in one task
CELLS = 2**22  # pairs, and postings of rare words, counted at a time


def salted(probes: DataFrame, postings: DataFrame, on: list[str], probe_id: str, posting_id: str, rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_a`` and ``_b`` beside ``on``, so that no task meets more than about ``rows`` rows of one side of a hot key.

    A key's postings are dealt to as many parts as they hold ``rows``, and so are its probes; each part of one side meets each of
    the other. Keys with fewer rows stay as they are.
    """
    spark = probes.sparkSession
    sizes = [df.groupBy(*on).agg(F.count(F.lit(1)).alias(n)).filter(F.col(n) > rows) for df, n in ((probes, "_probes"), (postings, "_postings"))]
    parts = {f"_{side}": F.ceil(F.coalesce(f"_{name}", F.lit(0)) / F.lit(float(rows))) for side, name in (("sb", "probes"), ("sa", "postings"))}
    path = scratch_path(spark, "hot")
    sizes[0].join(sizes[1], on, "full_outer").select(*on, *[F.greatest(v, F.lit(1)).cast("int").alias(k) for k, v in parts.items()]).write.parquet(path)
    hot = spark.read.parquet(path)  # at most a row for each ``rows`` rows; Spark sees its size

    def dealt(df: DataFrame, own: str, other: str, own_parts: str, other_parts: str, key: str) -> DataFrame:
        joined = df.join(hot, on, "left")
        part = F.pmod(F.xxhash64(key), F.coalesce(own_parts, F.lit(1))).cast("int")
        return joined.select(*df.columns, part.alias(own), F.explode(F.sequence(F.lit(0), F.coalesce(other_parts, F.lit(1)) - 1)).alias(other))

    return dealt(probes, "_b", "_a", "_sb", "_sa", probe_id), dealt(postings, "_a", "_b", "_sa", "_sb", posting_id)


def word_sets(records: DataFrame, block: list[str], text: str, own: str) -> DataFrame:
    """block, ``own``, ``_hash`` of the content words and ``_words``, each as a 64-bit hash of word and block: two words of one block
    count as equal if their hashes are. Written once, eight bytes a word, as cutting text into words is the dear part."""
    words = records.dropna(subset=block).select(*block, own, F.array_sort(content_words(text)).alias("_w"))
    hashed = F.transform("_w", lambda w: F.xxhash64(w, *block))
    return cut_lineage(words.select(*block, own, F.sha2(F.concat_ws(" ", "_w"), 256).alias("_hash"), hashed.alias("_words"))).filter(F.size("_words") > 0)


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists of a column in one array, and the row of each value."""
    column = column.combine_chunks()
    rows = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))
    return column.flatten().to_numpy(zero_copy_only=False), rows


def shared_counts(own: np.ndarray, own_rows: np.ndarray, n: int, other: np.ndarray, other_rows: np.ndarray, m: int):
    """Yield (first row, matrix of shared values) for slices of ``n`` sets against ``m`` sets, given as values with their rows.

    Values that more than one in 32 of the other sets hold are multiplied as 0/1 matrices, the rest counted through their
    postings; a slice has at most CELLS cells and postings, if it has more than one row.
    """
    order = np.argsort(other, kind="stable")
    values, starts, sizes = np.unique(other[order], return_index=True, return_counts=True)
    postings = other_rows[order]
    at = np.searchsorted(values, own)
    held = values[np.minimum(at, len(values) - 1)] == own
    at, rows = at[held], own_rows[held]
    common = sizes > max(32, m // 32)
    column = np.cumsum(common) - 1
    dense = np.zeros((int(common.sum()), m), dtype=np.float32)
    where = np.repeat(common, sizes)
    dense[np.repeat(column, sizes)[where], postings[where]] = 1
    rare = ~common[at]
    steps = np.bincount(rows[rare], weights=sizes[at[rare]], minlength=n)
    weight = np.cumsum(np.maximum(steps, m))
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(weight, (weight[first - 1] if first else 0) + CELLS, side="right")))
        a, b = np.searchsorted(rows, [first, last])
        hit, row, few = at[a:b], rows[a:b] - first, rare[a:b]
        mine = np.zeros((last - first, len(dense)), dtype=np.float32)
        mine[row[~few], column[hit[~few]]] = 1
        lengths = sizes[hit[few]]
        ends = np.cumsum(lengths)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[hit[few]] - (ends - lengths), lengths)
        cells = np.repeat(row[few] * m, lengths) + postings[places]
        yield first, np.bincount(cells, minlength=(last - first) * m).reshape(-1, m) + np.rint(mine @ dense).astype(np.int64)
        first = last


def _best_in_tiles(titles: pa.Table, stories: pa.Table, kept: list[str], threshold: float, main_id: str) -> pa.Table:
    """Best story of each title inside each tile, the lowest id of equals; rows of a tile lie together once sorted."""
    titles, stories = titles.sort_by("_tile"), stories.sort_by([("_tile", "ascending"), (main_id, "ascending")])
    spans = [dict(zip(v, zip(i, np.append(i[1:], len(t))))) for t in (titles, stories) for v, i in [np.unique(t["_tile"].to_numpy(), return_index=True)]]
    found, partner, score = [], [], []
    for tile, (a, b) in spans[0].items():
        if tile not in spans[1]:
            continue
        c, d = spans[1][tile]
        own, own_rows = _lists(titles["_words"].slice(a, b - a))
        size = np.bincount(own_rows, minlength=b - a)
        for first, shared in shared_counts(own, own_rows, b - a, *_lists(stories["_words"].slice(c, d - c)), d - c):
            best = shared.argmax(axis=1)
            share = shared[np.arange(len(best)), best] / size[first : first + len(best)]
            good = np.flatnonzero(share >= threshold)
            found.append(a + first + good)
            partner.append(c + best[good])
            score.append(share[good])
    found, partner, score = (np.concatenate(v) if v else np.zeros(0, dtype=t) for v, t in ((found, np.int64), (partner, np.int64), (score, np.float64)))
    return titles.select(kept).take(pa.array(found)).append_column(main_id, stories[main_id].take(pa.array(partner))).append_column("score", pa.array(score))


def find_duplicates(additional: DataFrame, main: DataFrame, block: list[str], title: str, narrative: str, threshold: float = LINK_THRESHOLD, add_id: str = "add_id", main_id: str = "main_id") -> DataFrame:
    """Best main record for each additional record that repeats it: (add_id, main_id, score).

    Score is the share of title words the narrative holds, inside equal non-null block keys; ties go to
    the lowest main id. A block's texts share their common words, so nearly all its pairs have some: the work is a block's number of
    pairs. None of them is a row:

    * equal word sets inside a block collapse to one row, keeping the lowest main id, so masses of copies cost one comparison;
    * a block is dealt out as tiles of at most about HOT_ROWS titles by as many narratives, and tiles into tasks;
    * a tile counts the shared words of all its pairs in place, and only each title's best partner in it leaves the task.
    """
    titles, stories = word_sets(additional, block, title, add_id), word_sets(main, block, narrative, main_id)
    title_sets, story_sets = (sets.groupBy(*block, "_hash").agg(F.first("_words").alias("_words"), F.min(own).alias(own)) for sets, own in ((titles, add_id), (stories, main_id)))
    counts = [sets.select(*block, "_hash").distinct() for sets in (titles, stories)]
    groups = max(1, sum(sets.count() for sets in counts) // HOT_ROWS)
    a, b = salted(title_sets, story_sets, block, "_hash", "_hash")
    tile = F.xxhash64(*block, "_a", "_b")
    a, b = (df.select(*own, "_words", tile.alias("_tile"), F.pmod(tile, F.lit(groups)).alias("_group")) for df, own in ((a, [*block, "_hash"]), (b, [main_id])))
    types = {f.name: f.dataType.simpleString() for f in [*titles.schema, *stories.schema]}
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*block, "_hash", main_id]) + ", score double"

    def best_in_tiles(left: pa.Table, right: pa.Table) -> pa.Table:
        return _best_in_tiles(left, right, [*block, "_hash"], threshold, main_id)

    pairs = a.groupBy("_group").cogroup(b.groupBy("_group")).applyInArrow(best_in_tiles, schema)
    best = pairs.groupBy(*block, "_hash").agg(F.min_by(F.struct(main_id, "score"), F.struct(-F.col("score"), F.col(main_id))).alias("_b"))
    return titles.select(*block, add_id, "_hash").join(best, [*block, "_hash"]).select(add_id, f"_b.{main_id}", "_b.score")


def drop_linked(additional: DataFrame, links: DataFrame, add_id: str = "add_id") -> DataFrame:
    return additional.join(links.select(add_id), add_id, "left_anti")


def enrich(main: DataFrame, additional: DataFrame, links: DataFrame, fields: list[str], add_id: str = "add_id", main_id: str = "main_id") -> DataFrame:
    """Fill null main fields from the first linked donor that has a value, with a flag per field.

    Donors are reduced to one row per main record before they meet the main table.
    """
    donors = links.select(add_id, main_id).join(additional.select(add_id, *fields), add_id)
    firsts = [F.min_by(f, F.when(F.col(f).isNotNull(), F.col(add_id))).alias(f"_donor_{f}") for f in fields]
    filled = main.join(donors.groupBy(main_id).agg(*firsts), main_id, "left")
    marks = {f"{f}_filled": F.col(f).isNull() & F.col(f"_donor_{f}").isNotNull() for f in fields}
    filled = filled.withColumns(marks).withColumns({f: F.coalesce(f, f"_donor_{f}") for f in fields})
    return filled.drop(*[f"_donor_{f}" for f in fields])


def fill_counts(enriched: DataFrame, fields: list[str]) -> DataFrame:
    return enriched.agg(*[F.count_if(F.col(f"{f}_filled")).alias(f) for f in fields])
