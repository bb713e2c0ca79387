"""Toxicity by multiple-instance learning: only documents are labelled, sentences are scored.

A sentence's evidence is a sum of weights of its words and word beginnings; the document's probability is the noisy-or of its
sentences. Weights are fitted to document labels by maximum likelihood with an L1 penalty, so that a sentence
without known evidence counts nothing and long clean texts stay clean. The sentence scores then locate the offending sentences.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 6000  # labelled documents that the fit reads at most (a feature: the bound of the fit); the smallest by hash of id
SAMPLE_CHARS = 1 << 16  # labelled documents longer than this are not used for the fit; every text is scored whole
FEATURES = 1 << 18
BEGINNINGS = (4, 6)  # lengths of word beginnings used beside whole words
ROUNDS, RATE, PENALTY, BIAS = 150, 1.0, 2.0, -5.0
SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")
WORD = re.compile(r"[^\W\d_]+")
EDGES = ".,;:!?()[]\"'"
MEMO_ENTRIES = 1 << 18


def feature(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % FEATURES


def features_of(token: str) -> set[int]:
    """Hashed features of a lower-case token: its words, and their beginnings where they are longer."""
    names = {x for word in WORD.findall(token) for x in ("w " + word, *(f"{n} {word[:n]}" for n in BEGINNINGS if len(word) >= n))}
    return set(map(feature, names))


def sentences(text: str) -> list[set[str]]:
    """Distinct tokens of each sentence of a text, lower-cased."""
    return [set(s.split()) for s in SENTENCE.findall(text.lower())]


def sentence_span(text: str, index: int) -> tuple[int, int]:
    return next(islice(SENTENCE.finditer(text), index, None)).span()


def bag(text: str | None) -> tuple[list[int], list[int]]:
    """Features of all sentences one after the other, and where each sentence's begin."""
    ids, starts = [], []
    for tokens in sentences(text or ""):
        found = sorted(set().union(*map(features_of, tokens)))
        if found:
            starts.append(len(ids))
            ids.extend(found)
    return ids, starts


def evidence(z: np.ndarray) -> np.ndarray:
    """-log(1 - p) of sentences with score z above the bias; zero without evidence."""
    return np.maximum(0.0, np.logaddexp(0, z + BIAS) - np.logaddexp(0, BIAS))


def fit(bags: list[tuple[list[int], list[int]]], labels: list[int]) -> np.ndarray:
    """Weights by proximal adaptive gradient steps on the noisy-or likelihood. Deterministic."""
    weights = np.zeros(FEATURES)
    keep = [i for i, (ids, _) in enumerate(bags) if len(ids)]
    if not keep or len({labels[i] for i in keep}) < 2:
        return weights
    ids = np.concatenate([np.asarray(bags[i][0], np.int64) for i in keep])
    sizes = np.array([len(bags[i][0]) for i in keep])
    offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    starts = np.concatenate([np.asarray(bags[i][1], np.int64) + o for i, o in zip(keep, offsets)])
    doc = np.repeat(np.arange(len(keep)), [len(bags[i][1]) for i in keep])
    y = np.array([labels[i] for i in keep], float)
    lengths = np.diff(np.append(starts, len(ids)))
    leak = max(1e-3, y.mean() / 10)  # what labels hold besides evidence
    past = np.full(FEATURES, 1e-8)
    for _ in range(ROUNDS):
        z = np.add.reduceat(weights[ids], starts)
        total = np.bincount(doc, evidence(z), len(keep)) + leak
        slope = np.where(y > 0, 1 / np.expm1(np.minimum(total, 50)), -1.0)
        each = slope[doc] / (1 + np.exp(-(z + BIAS)))
        grad = np.bincount(ids, np.repeat(each, lengths), FEATURES)
        past += grad * grad
        step = RATE / np.sqrt(past)
        moved = weights + step * grad
        weights = np.sign(moved) * np.maximum(0, np.abs(moved) - step * PENALTY * 0.01 * np.sqrt(y.sum()))
    weights[np.abs(weights) < 1e-3] = 0
    return weights


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights from labelled documents whose crc32(doc_id) mod 5 is not 0; a bounded sample of at most ``sample`` ids, the same in every run.

    Where an id repeats, its first text in order counts, once.
    """
    seen = labels.filter(F.col("toxic").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0))
    marks = seen.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.filter(F.char_length("text") <= SAMPLE_CHARS).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min(F.struct("text", "toxic")).alias("_t")).select("doc_id", "_t.*")

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            pairs = [bag(t) for t in rows["text"]]
            yield pd.DataFrame({"doc_id": rows["doc_id"], "toxic": rows["toxic"].astype("int32"), "ids": [np.array(a, np.int32).tobytes() for a, _ in pairs], "starts": [np.array(b, np.int32).tobytes() for _, b in pairs]})

    rows = sorted(texts.mapInPandas(bags, "doc_id long, toxic int, ids binary, starts binary").collect(), key=lambda r: (r.doc_id, r.ids))
    return fit([(np.frombuffer(r.ids, np.int32), np.frombuffer(r.starts, np.int32)) for r in rows], [int(r.toxic > 0) for r in rows])


class Scorer:
    def __init__(self, weights: dict[int, float]):
        self.weights, self.memo, self.starts = weights, {}, {}

    def _word(self, word: str) -> float:
        """Weight of one word; beginnings repeat across words, so their weights are remembered apart."""
        value = self.weights.get(feature("w " + word), 0.0)
        for n in BEGINNINGS:
            if len(word) >= n:
                start = word[:n]
                if start not in self.starts:
                    self.starts[start] = self.weights.get(feature(f"{n} {start}"), 0.0)
                value += self.starts[start]
        return value

    def _learn(self, tokens: set[str]) -> None:
        if len(self.memo) > MEMO_ENTRIES:
            self.memo.clear()
            self.starts.clear()
        for token in (t for t in tokens if t not in self.memo):
            bare = token.strip(EDGES)
            self.memo[token] = self._word(bare) if bare.isalpha() else sum(map(self._word, set(WORD.findall(bare))))

    def scored(self, text: str | None) -> tuple[float, int, int, float]:
        """Document score and, where it is toxic, span and score of its worst sentence (else an empty span)."""
        z = []
        for tokens in sentences(text or ""):
            try:
                z.append(sum(map(self.memo.__getitem__, tokens)))
            except KeyError:
                self._learn(tokens)
                z.append(sum(map(self.memo.__getitem__, tokens)))
        if not z or max(z) <= 0:
            return 0.0, 0, 0, 0.0
        each = evidence(np.array(z))
        value = float(-np.expm1(-each.sum()))
        if value < 0.5:
            return value, 0, 0, 0.0
        worst = int(each.argmax())
        return value, *sentence_span(text, worst), float(-np.expm1(-each[worst]))


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, score, worst_start, worst_end, worst_score for every row, in one pass without a shuffle.

    Null and empty texts and texts of unknown words score 0. Null ids and repeated rows are kept. Only the text is an input.
    """
    known = {int(i): float(weights[i]) for i in np.flatnonzero(weights)}  # at most FEATURES entries
    shared = docs.sparkSession.sparkContext.broadcast(known)

    @F.pandas_udf("score double, worst_start long, worst_end long, worst_score double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield pd.DataFrame([scorer.scored(t) for t in texts], columns=["score", "worst_start", "worst_end", "worst_score"])

    return docs.select("doc_id", scored(F.coalesce("text", F.lit(""))).alias("_s")).select("doc_id", "_s.*")


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those whose score is 0.5 or more. Columns and other rows stay as they are."""
    known = learn(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast({int(i): float(known[i]) for i in np.flatnonzero(known)})

    @F.pandas_udf("double")
    def value(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield pd.Series([scorer.scored(t)[0] for t in texts], dtype=float)

    return docs.filter(value(F.coalesce("text", F.lit(""))) < 0.5)
