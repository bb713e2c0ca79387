"""Benchmark decontamination: documents that hold a benchmark item, edited or not.

The CGK embedding walks through a text with a random rule: at each step it writes the byte it stands on and moves on or stays,
as the rule says for that step and byte. Two texts a few edits apart fall into step again soon, so edit distance becomes Hamming
distance of the walks. Bits of a walk are sampled as keys: windows of documents and of items that start at the same sampled
kinds of words are walked ``WALKS`` times, each with its own rule and sample, and windows that share a key are candidates. A
candidate names the item and the place where the item's whole window begins; that window is then verified by exact edit distance.

The walk of a window does not depend on where the window ends, so items of all sizes share one set of walks over a document.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIMILARITY = 0.8  # least 1 - edits / length of the item
WALKS, STEPS, SAMPLES = 4, 64, 14  # independent walks; their steps (about half as many bytes); sampled steps
PRUNE = 6  # samples after which windows that agree with no item are given up
ANCHOR_SHARE = 1  # one in so many kinds of words starts a window, the same kinds in documents and items; one: every word
SHORT = 48  # bytes; shorter items, and others too short for a whole walk, are found only as they are
ITEM_BYTES = 1 << 24  # bytes of items held by a task at a time; more items are taken in blocks
TEXT_BYTES = 1 << 21  # bytes of text walked at a time
TABLE = 1 << 20

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def normalised(text: str | None) -> bytes:
    """A-Z lower-cased, every run of other ASCII than letters and digits one space, none at the ends."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split())


def fit_distance(pattern: str, text: str) -> int:
    """Least edit distance of ``pattern`` to any substring of ``text``; bit-parallel, one step a character."""
    size = len(pattern)
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << size) - 1
    up, down, now = full, 0, size  # vertical differences +1 and -1 of the current column, its last value
    best = size
    for c in text:
        equal = where.get(c, 0)
        vertical = equal | down
        diagonal = (((equal & up) + up) ^ up) | equal
        right_up, right_down = down | (full & ~(diagonal | up)), up & diagonal
        now += (right_up >> (size - 1) & 1) - (right_down >> (size - 1) & 1)
        best = min(best, now)
        right_up, right_down = right_up << 1 & full, right_down << 1 & full
        up, down = right_down | (full & ~(vertical | right_up)), right_up & vertical
    return best


def gram_counts(data: np.ndarray) -> np.ndarray:
    """Counts of 3-byte grams, hashed to 1,024 bins; bins that meet only raise what two texts share."""
    if len(data) < 3:
        return np.zeros(1024, np.int16)
    wide = data.astype(np.uint32)
    code = (wide[:-2] | wide[1:-1] << np.uint32(8) | wide[2:] << np.uint32(16)) * np.uint32(2654435761) >> np.uint32(22)
    return np.bincount(code, minlength=1024).astype(np.int16)


class Walks:
    """The random rules, the sampled steps, and the walks of windows."""

    def __init__(self, seed: int = 11):
        draw = np.random.RandomState(seed)
        self.moves = draw.randint(0, 2, (WALKS, STEPS, 256)).astype(np.int32)
        self.sampled = [set(draw.choice(STEPS, SAMPLES, replace=False).tolist()) for _ in range(WALKS)]

    @staticmethod
    def anchors(data: np.ndarray) -> np.ndarray:
        """Places of words whose first three bytes are of a sampled kind. ``data`` begins and ends with spaces."""
        at = np.flatnonzero((data[1:-4] != 32) & (data[:-5] == 32)) + 1
        kind = data[at].astype(np.uint32) | data[at + 1].astype(np.uint32) << np.uint32(8) | data[at + 2].astype(np.uint32) << np.uint32(16)
        return at[(kind * np.uint32(2654435761)) >> np.uint32(16) & np.uint32(0xFF) < 256 // ANCHOR_SHARE]

    def keys(self, data: np.ndarray, at: np.ndarray, walk: int, tables: list[np.ndarray] | None = None):
        """(windows, keys, ends): sampled bytes of the walk of each window. ``tables`` give up windows whose first samples match no item."""
        place, key, seen, early = at.astype(np.int32), np.zeros(len(at), np.uint64), 0, None
        for step in range(STEPS):
            byte = data[place]
            if step in self.sampled[walk]:
                key = (key ^ byte) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
                seen += 1
                if seen == PRUNE:
                    early = key
                    if tables is not None:
                        live = tables[walk][(key & np.uint64(TABLE - 1)).astype(np.int64)]
                        at, place, key, byte = at[live], place[live], key[live], byte[live]
                        early = None
            place = place + self.moves[walk, step][byte]
        return at, key, place, early


class Index:
    """Keys of all windows of a block of items. Built on the driver, at most about ``ITEM_BYTES`` of items."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.ids = [i for i, _ in items]
        forms = [normalised(t) for _, t in items]
        self.texts = [f.decode("utf-8", "ignore") for f in forms]
        self.sizes = [len(f) for f in forms]
        self.short: dict[bytes, list[int]] = {}
        for n, f in enumerate(forms):
            if 0 < len(f) < SHORT:
                self.short.setdefault(f, []).append(n)
        self.grams = [gram_counts(np.frombuffer(f, np.uint8)) for f in forms]
        self.walks = Walks()
        parts: list[list[np.ndarray]] = [[] for _ in range(WALKS)]
        early: list[list[np.ndarray]] = [[] for _ in range(WALKS)]
        for n, f in enumerate(forms):
            if len(f) < SHORT:
                continue
            data = np.frombuffer(b" " + f + b" " * (STEPS + 8), np.uint8)
            at = self.walks.anchors(data)
            for w in range(WALKS):
                _, keys, ends, first = self.walks.keys(data, at, w)
                whole = ends <= len(f) + 1
                rows = np.zeros(int(whole.sum()), dtype=[("key", "<u8"), ("item", "<i4"), ("offset", "<i4")])
                rows["key"], rows["item"], rows["offset"] = keys[whole], n, at[whole] - 1
                parts[w].append(rows)
                early[w].append(first[whole])
        walked = {int(i) for own in parts for rows in own for i in rows["item"]}
        for n, f in enumerate(forms):
            if len(f) >= SHORT and n not in walked:  # no sampled word leaves room for a whole walk
                self.short.setdefault(f, []).append(n)
        self.rows, self.tables = [], []
        for w in range(WALKS):
            rows = np.concatenate(parts[w]) if parts[w] else np.zeros(0, dtype=[("key", "<u8"), ("item", "<i4"), ("offset", "<i4")])
            self.rows.append(rows[np.argsort(rows["key"], kind="stable")])
            table = np.zeros(TABLE, bool)
            if early[w]:
                table[(np.concatenate(early[w]) & np.uint64(TABLE - 1)).astype(np.int64)] = True
            self.tables.append(table)


class Finder:
    """Finds items of an index in texts, inside a worker."""

    def __init__(self, index: Index, similarity: float):
        self.index, self.memo = index, {}
        self.most = [int((1 - similarity) * len(t) + 1e-9) for t in index.texts]
        self.sizes = np.array(index.sizes, np.int64)
        # Edits are counted in characters; one may change up to four bytes of those outside ASCII.
        self.bytes_most = [m if len(t) == n else 4 * m for m, t, n in zip(self.most, index.texts, index.sizes)]
        self.slack = np.maximum(1, np.array([max(m, n // 5) if len(t) == n else 2 * m for m, t, n in zip(self.most, index.texts, index.sizes)], np.int64))
        self.automaton = None
        if index.short:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for form, numbers in index.short.items():
                self.automaton.add_word(f" {form.decode('utf-8', 'ignore')} ", numbers)
            self.automaton.make_automaton()

    def candidates(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin of an item's window in ``data``, item) of windows that share a key with the item in any walk."""
        at, begins, items = self.index.walks.anchors(data), [], []
        for w in range(WALKS):
            rows = self.index.rows[w]
            if not len(rows):
                continue
            places, keys, _, _ = self.index.walks.keys(data, at, w, self.index.tables)
            low = np.searchsorted(rows["key"], keys, "left")
            count = np.searchsorted(rows["key"], keys, "right") - low
            hit = np.flatnonzero(count)
            low, count, places = low[hit], count[hit], places[hit]
            own = rows[np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
            begins.append(np.repeat(places, count) - own["offset"])
            items.append(own["item"])
        if not begins:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(begins), np.concatenate(items)

    def hopeless(self, item: int, window: np.ndarray) -> bool:
        """Whether the window shares fewer 3-byte grams with the item than so few edits can leave (one edit breaks three)."""
        return int(np.minimum(self.index.grams[item], gram_counts(window)).sum()) < self.index.sizes[item] - 2 - 3 * self.bytes_most[item]

    def verified(self, item: int, window: bytes) -> int:
        """Exact edit distance of an item to its window; the copies of a passage are verified once."""
        key = (item, window)
        if key not in self.memo:
            if len(self.memo) > 20_000:
                self.memo.clear()
            self.memo[key] = fit_distance(self.index.texts[item], window.decode("utf-8", "ignore"))
        return self.memo[key]

    def find(self, texts: list[str | None]) -> list[dict[int, int]]:
        """For each text the items found, with their edit distances. Texts are walked whole, some at a time."""
        out: list[dict[int, int]] = [{} for _ in texts]
        forms = [normalised(t) for t in texts]
        begin = 0
        while begin < len(forms):
            end, total = begin, 0
            while end < len(forms) and (end == begin or total + len(forms[end]) <= TEXT_BYTES):
                total += len(forms[end]) + 1
                end += 1
            self._some(forms[begin:end], out[begin:end])
            begin = end
        return out

    def _some(self, forms: list[bytes], out: list[dict[int, int]]) -> None:
        joined = b" " + b" ".join(forms) + b" " * (STEPS + 8)
        data = np.frombuffer(joined, np.uint8)
        starts = np.cumsum([1, *[len(f) + 1 for f in forms]])
        begins, items = self.candidates(data)
        slack = self.slack[items]
        # Windows of one item whose begins lie in one cell of its slack are one candidate.
        cell = np.unique(np.stack([np.searchsorted(starts, begins + self.sizes[items] // 2, "right") - 1, items, begins // slack], axis=1), axis=0)
        for d, item, place in cell.tolist():
            if not 0 <= d < len(forms):
                continue
            size, slack = self.index.sizes[item], int(self.slack[item])
            a, b = max(int(starts[d]), (place - 1) * slack), min(int(starts[d + 1]) - 1, (place + 2) * slack + size)
            if self.hopeless(item, data[a:b]):
                continue
            distance = self.verified(item, joined[a:b])
            if distance <= self.most[item] and distance < out[d].get(item, size + 1):
                out[d][item] = distance
        if self.automaton is not None:
            for d, form in enumerate(forms):
                for _, numbers in self.automaton.iter(f" {form.decode('utf-8', 'ignore')} "):
                    for n in numbers:
                        out[d][n] = 0


def item_blocks(benchmark: DataFrame, most: int = ITEM_BYTES) -> Iterator[list[tuple[int, str | None]]]:
    """The benchmark in blocks of about ``most`` bytes each, one at a time, so that what the driver and a task hold has a bound whatever its size."""
    items = benchmark.filter(F.col("item_id").isNotNull() & (F.length("text") > 0)).select("item_id", "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, ceil(total / most))
    for b in range(count):
        some = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(count)) == b) if count > 1 else items
        yield sorted({(r.item_id, r.text) for r in some.collect()})


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, distance, similarity: every document and benchmark item it holds, at the item's best place.

    A document holds an item if a stretch of its text is within ``(1 - similarity) * length`` edits of the item, both with letters
    lower-cased and signs as spaces. Null and empty texts and items match nothing; null ids of items take no part. Null document
    ids and repeated rows give their rows as they are; other columns are not read. No shuffle: documents stay where they are read.
    """
    found = None
    for block in item_blocks(benchmark):
        index = docs.sparkSession.sparkContext.broadcast(Index(block))

        def search(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            finder = Finder(index.value, similarity)
            for rows in batches:
                hits = [(d, finder.index.ids[n], k, 1 - k / max(1, len(finder.index.texts[n]))) for d, own in zip(rows["doc_id"], finder.find(rows["text"].tolist())) for n, k in sorted(own.items())]
                yield pd.DataFrame(hits, columns=["doc_id", "item_id", "distance", "similarity"])

        some = docs.select("doc_id", "text").mapInPandas(search, "doc_id long, item_id long, distance int, similarity double")
        found = some if found is None else found.unionByName(some)
    return found


def holds_any(index, similarity: float):
    @F.pandas_udf("boolean")
    def holds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = Finder(index.value, similarity)
        for texts in batches:
            yield pd.Series([bool(x) for x in finder.find(texts.tolist())], dtype=bool)

    return holds(F.coalesce("text", F.lit("")))


def without_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; all columns and other rows stay as they are."""
    for block in item_blocks(benchmark):
        docs = docs.filter(~holds_any(docs.sparkSession.sparkContext.broadcast(Index(block)), similarity))
    return docs
