"""Token counts of whole texts by a byte-level BPE vocabulary file.

Method: every vocabulary string is encoded alone once, before the job ("offline"); those that come back as exactly
one token are proved whole. A text is cut into pre-tokens by the vocabulary's own pattern; a pre-token that is a
proved string counts one, and only the rest is merged.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: how byte-level BPE cuts text before merging.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES_AT_ONCE = 1 << 16  # pre-tokens of one text in memory at a time
MEMO_ENTRIES = 1 << 18  # merged pre-tokens a worker remembers; only speed depends on it
MEMO_CHARS = 64


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs one worker a core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def special_strings(path: str) -> list[str]:
    """Strings that the library takes out of a text before it is cut, longest first."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    added = spec.get("added_tokens") or []
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
    if not plain or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError(f"{path}: only a byte-level vocabulary without normalizer and with plain added tokens is counted by whole tokens")
    return sorted((t["content"] for t in added), key=lambda s: (-len(s), s))


def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that encode alone as one token. Bounded by the vocabulary."""
    tok = load(path)
    special = set(special_strings(path))
    texts = [tok.decode([i], skip_special_tokens=False) for i in tok.get_vocab().values()]
    texts = sorted({t for t in texts if t and "�" not in t and t not in special})
    return frozenset(t for t, e in zip(texts, tok.encode_batch(texts, add_special_tokens=False)) if len(e.ids) == 1)


class Counter:
    """Counts tokens of texts inside a worker."""

    def __init__(self, path: str, whole: frozenset[str]):
        import regex

        self.tok, self.whole, self.memo = load(path), whole, {}
        self.cut = regex.compile(PRE_TOKEN)
        special = special_strings(path)
        self.special = regex.compile("|".join(regex.escape(s) for s in special)) if special else None

    def _merged(self, rest: list[str]) -> int:
        """Tokens of pre-tokens that are not proved whole."""
        memo = self.memo
        new = list({p for p in rest if p not in memo})
        if new:
            if len(memo) + len(new) > MEMO_ENTRIES:
                memo.clear()
                new = list(set(rest))
            sizes = {p: len(e.ids) for p, e in zip(new, self.tok.encode_batch(new, add_special_tokens=False))}
            memo.update(sizes)
        total = sum(map(memo.__getitem__, rest))
        for p in new:
            if len(p) > MEMO_CHARS:
                del memo[p]
        return total

    def _pieces(self, pieces: list[str]) -> int:
        whole = self.whole
        rest = [p for p in pieces if p not in whole]
        return len(pieces) - len(rest) + (self._merged(rest) if rest else 0)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts = self.special.split(text) if self.special else [text]
        total = len(parts) - 1
        for part in parts:
            if len(part) <= PIECES_AT_ONCE:
                total += self._pieces(self.cut.findall(part))
                continue
            found = (m.group() for m in self.cut.finditer(part))
            while some := list(islice(found, PIECES_AT_ONCE)):
                total += self._pieces(some)
        return total


def token_count(text: Column | str, path: str, spark) -> Column:
    """Number of tokens of ``text`` as the library counts them; null and empty count zero."""
    whole = spark.sparkContext.broadcast(whole_tokens(path))  # at most the vocabulary

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(path, whole.value)
        for texts in batches:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    return counted(text)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row.

    Null and empty texts: zero bytes, zero tokens. Null ids and repeated rows are kept, a row each. Other columns are not
    read. Strings of added tokens inside a text count one, as is the library's default. No shuffle: one pass in place.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = token_count(text, path, docs.sparkSession)
    return docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), n.alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)
