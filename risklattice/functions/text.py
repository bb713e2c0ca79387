"""Keys, words and similarity of free text."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# Stop words of the title matcher.
STOP_WORDS = (
    "the a an in of at on and to for with by is was were has have been said after "
    "as from that this it its"
).split()

# Stand-alone letters with no decomposition, and what they sort as; then the hooked letters.
FOLDED_LETTERS = {
    "ø": "o", "Ø": "O", "æ": "ae", "Æ": "Ae", "œ": "oe", "Œ": "Oe", "ð": "d", "Ð": "D",
    "þ": "th", "Þ": "Th", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ß": "ss",
    "ɓ": "b", "Ɓ": "B", "ɗ": "d", "Ɗ": "D", "ƙ": "k", "Ƙ": "K", "ƴ": "y", "Ƴ": "Y",
}


_FOLDED = str.maketrans(FOLDED_LETTERS)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_OTHER = {mode: bytes(b for b in range(128) if not (chr(b).isalnum() or (mode == "words" and b == 32))) for mode in ("alnum", "ascii", "words")}


def _key(text: str, mode: str) -> str:
    letters = set(text)
    if not letters.isdisjoint(FOLDED_LETTERS):
        text = text.translate(_FOLDED)
    text = unicodedata.normalize("NFKD", text)
    if mode == "alnum" and any(c > "\x7f" and c.isalnum() for c in set(text)):
        return "".join(filter(str.isalnum, text.lower()))
    # What is left beyond ASCII has no place in the key, and bytes are folded and cut at once.
    plain = text.encode("ascii", "ignore").translate(_LOWER, _OTHER[mode]).decode("ascii")
    return plain.strip() if mode == "words" else plain


def normalise_key(value: Column | str, mode: str = "alnum") -> Column:
    """Spelling-insensitive key of a label; null becomes the empty string.

    ``alnum`` keeps letters and digits of every script, ``ascii`` only a-z and 0-9, ``words`` keeps
    spaces as well. ASCII text is folded inside the JVM. Spark has no Unicode decomposition, so only other text goes
    through an Arrow function; each batch works on its distinct values, so a label that repeats on a third of all rows is
    folded once per batch and nothing is shuffled.
    """
    if mode not in ("alnum", "ascii", "words"):
        raise ValueError(f"unknown mode {mode!r}")

    @F.pandas_udf(StringType())
    def fold(values: pd.Series) -> pd.Series:
        codes, uniques = pd.factorize(values)
        keys = [_key(u, mode) for u in uniques]
        return pd.Series(["" if c < 0 else keys[c] for c in codes], index=values.index, dtype=object)

    col = F.col(value) if isinstance(value, str) else value
    other = F.regexp(col, F.lit(r"[^\x00-\x7F]"))
    plain = F.trim(F.regexp_replace(F.lower(col), "[^a-z0-9 ]", "")) if mode == "words" else F.regexp_replace(F.lower(col), "[^a-z0-9]", "")
    return F.coalesce(F.when(other, fold(F.when(other, col))).otherwise(plain), F.lit(""))


def ascii_key(value: Column | str) -> Column:
    """The same key for text known to be ASCII, wholly inside the JVM."""
    col = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.regexp_replace(F.lower(col), "[^a-z0-9]", ""), F.lit(""))


def canonical(key: Column, aliases: dict[str, str]) -> Column:
    """Replace an alias key by its canonical key; other keys pass."""
    if not aliases:
        return key
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(table[key], key)


def content_words(value: Column | str, stop: list[str] | None = None) -> Column:
    """Distinct lower-case words without stop words; null text has no words at all."""
    col = F.col(value) if isinstance(value, str) else value
    cleaned = F.trim(F.regexp_replace(F.lower(col), "[^a-z ]", " "))
    words = F.array_distinct(F.split(cleaned, " +"))
    drop = F.array(*[F.lit(w) for w in (STOP_WORDS if stop is None else stop)] + [F.lit("")])
    return F.coalesce(F.array_except(words, drop), F.array().cast("array<string>"))


def containment(inner: Column, outer: Column) -> Column:
    """Share of the first set that the second one holds; null for an empty first set."""
    share = F.size(F.array_intersect(inner, outer)).cast("double") / F.size(inner)
    return F.when(F.size(inner) > 0, share)


@F.pandas_udf(DoubleType())
def matching_blocks_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity, 2M/(|a|+|b|) over the longest matching blocks.

    Matching is directional in rare cases, so the first argument stays the first sequence.
    """
    out, seen = [], {}
    for a, b in zip(left, right):
        if a is None or b is None:
            out.append(None)
            continue
        if (a, b) not in seen:
            seen[a, b] = difflib.SequenceMatcher(None, a, b).ratio()
        out.append(seen[a, b])
    return pd.Series(out, index=left.index, dtype="float64")


def edit_ratio(left: Column, right: Column) -> Column:
    """JVM-side alternative: 1 - edit distance / longer length. Not equal to the block ratio."""
    longer = F.greatest(F.length(left), F.length(right))
    return F.when(longer > 0, F.lit(1.0) - F.levenshtein(left, right).cast("double") / longer)
