"""SentencePiece encoding with the place of every piece in the original text, and decoding.

Method: a text is normalised by longest prefixes: wherever a key of the model's compiled character map begins, its longest key
is replaced, everything else is copied, and each normalised byte records the original byte it came from. The normalised text is
cut into words over whose ends no piece of the vocabulary reaches, distinct words are merged once each, and the pieces' ends in the
normalised text are projected through the record to byte spans of the original.
"""

from __future__ import annotations

import codecs
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
MEMO_ENTRIES, MEMO_CHARS = 1 << 17, 64  # merged words a worker remembers; only speed depends on them
TEXT_BYTES = 1 << 21  # bytes of text whose pieces are held at a time; a longer text is held alone

codecs.register_error("each-byte", lambda e: ("�" * (e.end - e.start), e.end))


class CharacterMap:
    """A compiled character map: the size of a double-array trie, the trie, and the replacements, each closed by a zero byte."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        units = np.frombuffer(blob[4 : 4 + size], "<u4")
        self.units, self.texts = units.tolist(), blob[4 + size :]
        self.first = re.compile(f"[{''.join(map(re.escape, self._first_characters(units)))}]") if size else None

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def _first_characters(self, units: np.ndarray) -> list[str]:
        """Characters with which a key begins, so that all other text is copied without a look at the trie."""
        labels, out, todo = np.arange(256), [], [(self._offset(self.units[0]), b"")]
        while todo:
            base, head = todo.pop()
            near = base ^ labels
            near = near[near < len(units)]
            for place in near[(units[near] & 0x800000FF) == (near ^ base)].tolist():
                byte = place ^ base
                if byte == 0:
                    continue
                prefix = head + bytes([byte])
                whole = 1 if prefix[0] < 0x80 else 2 if prefix[0] < 0xE0 else 3 if prefix[0] < 0xF0 else 4
                if len(prefix) == whole:
                    out.append(prefix.decode("utf-8"))
                else:
                    todo.append((place ^ self._offset(self.units[place]), prefix))
        return sorted(out)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that begins at ``at``, and its replacement."""
        units, found = self.units, None
        place = self._offset(units[0])
        for i in range(at, len(data)):
            place ^= data[i]
            if place >= len(units) or units[place] & 0x800000FF != data[i]:
                break
            leaf = units[place] >> 8 & 1
            place ^= self._offset(units[place])
            if leaf:
                found = (i + 1 - at, units[place] & 0x7FFFFFFF)
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]

    def replaced(self, text: str) -> tuple[bytes, np.ndarray]:
        """The replaced text, and for each of its bytes the original byte it came from: replacements come from where their key begins."""
        data = text.encode("utf-8")
        if self.first is None or not self.first.search(text):
            return data, np.arange(len(data), dtype=np.int32)
        parts, source, at, char = [], [], 0, 0
        for m in self.first.finditer(text):
            if m.start() < char:
                continue  # inside the key before
            plain = len(text[char : m.start()].encode("utf-8"))
            begin = at + plain
            hit = self.longest(data, begin)
            if hit is None:
                continue
            parts += (data[at:begin], hit[1])
            source += (np.arange(at, begin, dtype=np.int32), np.full(len(hit[1]), begin, np.int32))
            at = begin + hit[0]
            char = m.start() + len(data[begin:at].decode("utf-8"))
        parts.append(data[at:])
        source.append(np.arange(at, len(data), dtype=np.int32))
        return b"".join(parts), np.concatenate(source)


@dataclass(frozen=True)
class Model:
    """What a model file says. Bounded by the vocabulary, so it can be sent to all tasks."""

    merger: bytes  # the model without its normaliser, for text that is normalised already
    pieces: list[str]
    byte_ids: list[int]
    control: frozenset[int]
    unknown: int
    unknown_surface: str
    begin: int
    end: int
    character_map: bytes
    dummy_prefix: bool
    squeeze: bool


def load(path: str) -> Model:
    """Read a model file: byte-pair merges with byte fallback and white space as prefix; others are refused, not approximated."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    train, norm = proto.trainer_spec, proto.normalizer_spec
    kinds = {name: [i for i, p in enumerate(proto.pieces) if p.type == n] for name, n in (("unknown", 2), ("control", 3), ("own", 4), ("unused", 5), ("byte", 6))}
    if train.model_type != 2 or not train.byte_fallback or train.treat_whitespace_as_suffix or kinds["own"] or kinds["unused"] or not norm.escape_whitespaces or proto.denormalizer_spec.precompiled_charsmap:
        raise ValueError(f"{path}: only byte-pair models with byte fallback and plain pieces are encoded")
    pieces = [p.piece for p in proto.pieces]
    rules = (norm.precompiled_charsmap, norm.add_dummy_prefix, norm.remove_extra_whitespaces)
    norm.precompiled_charsmap, norm.add_dummy_prefix, norm.remove_extra_whitespaces = b"", False, False
    own = [int(i) for _, i in sorted((int(pieces[i][3:-1], 16), i) for i in kinds["byte"])]
    return Model(proto.SerializeToString(), pieces, own, frozenset(kinds["control"]), kinds["unknown"][0], train.unk_surface, train.bos_id, train.eos_id, *rules)


class Encoder:
    """Encodes texts inside a worker."""

    def __init__(self, model: Model):
        from sentencepiece import SentencePieceProcessor

        self.model, self.map, self.memo = model, CharacterMap(model.character_map), {}
        self.merger = SentencePieceProcessor(model_proto=model.merger)
        bytes_of = {i: b for b, i in enumerate(model.byte_ids)}
        plain = [p for i, p in enumerate(model.pieces) if i not in bytes_of and i not in model.control]
        reaches_over = any(SPACE in p.lstrip(SPACE) for p in plain)  # a piece goes on after a space
        self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if not reaches_over else "(?s).+")
        self.sizes = np.array([len(p.encode("utf-8")) for p in model.pieces], np.int64)
        self.byte = np.array([bytes_of.get(i, -1) for i in range(len(model.pieces))], np.int64)

    def normalised(self, text: str) -> tuple[bytes, np.ndarray]:
        """The text as the vocabulary sees it, and the original byte of each of its bytes and of its end."""
        model, tail = self.model, len(text.encode("utf-8"))
        data, source = self.map.replaced(text)
        if model.squeeze and data:
            raw = np.frombuffer(data, np.uint8)
            blank = raw == 32
            keep = ~(blank & np.concatenate([[True], blank[:-1]]))
            if keep.any() and blank[np.flatnonzero(keep)[-1]]:
                last = np.flatnonzero(keep)[-1]
                keep[last], tail = False, int(source[last])
            data, source = raw[keep].tobytes(), source[keep]
        if not data:
            return b"", np.zeros(1, np.int32)
        raw = np.frombuffer(data, np.uint8)
        source = np.repeat(source, np.where(raw == 32, len(SPACE.encode()), 1))
        data = data.replace(b" ", SPACE.encode())
        if model.dummy_prefix:
            data, source = SPACE.encode() + data, np.concatenate([np.full(3, source[0] if model.squeeze else 0, np.int32), source])
        return data, np.concatenate([source, [tail]]).astype(np.int32)

    def form(self, text: str) -> str:
        """The normalised text alone."""
        if self.map.first is None and not self.model.squeeze:
            return (SPACE if self.model.dummy_prefix and text else "") + text.replace(" ", SPACE)
        return self.normalised(text)[0].decode("utf-8")

    def spans(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces begin and end in the normalised text: the last byte piece of a character stands for all of it, the others for nothing."""
        sizes, byte = self.sizes[ids], self.byte[ids]
        if (byte >= 0).any():
            sizes[byte >= 0] = 0
            lead = np.flatnonzero((byte >= 0) & ((byte < 0x80) | (byte >= 0xC0)))
            width = np.select([byte[lead] < 0x80, byte[lead] < 0xE0, byte[lead] < 0xF0], [1, 2, 3], 4)
            sizes[lead + width - 1] = width
        ends = np.cumsum(sizes)
        return ends - sizes, ends

    def merged(self, forms: list[str]) -> Iterator[np.ndarray]:
        """Ids of normalised texts; distinct words are merged once each."""
        memo = self.memo
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        words = [self.words.findall(form) for form in forms]
        new = list(set().union(*words).difference(memo))
        for word, ids in zip(new, self.merger.encode(new, num_threads=1) if new else []):
            memo[word] = array("I", ids).tobytes()
        for some in words:
            yield np.frombuffer(b"".join(map(memo.__getitem__, some)), "<u4")
        for word in new:
            if len(word) > MEMO_CHARS:
                del memo[word]

    def encode(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each text the ids, and the original bytes where each piece begins and ends. No begin and end ids."""
        forms = [self.normalised(t or "") for t in texts]
        for (_, source), ids in zip(forms, self.merged([data.decode("utf-8") for data, _ in forms])):
            begins, ends = self.spans(ids)
            yield ids, source[begins], source[ends]


class Decoder:
    """Text of ids inside a worker."""

    def __init__(self, model: Model):
        if model.squeeze:
            raise ValueError("models that remove extra spaces are not decoded")
        self.control, self.strip = np.zeros(len(model.pieces), bool), model.dummy_prefix
        self.control[sorted(model.control)] = True
        table = [b"" if i in model.control else model.unknown_surface.encode() if i == model.unknown else p.replace(SPACE, " ").encode("utf-8") for i, p in enumerate(model.pieces)]
        for b, i in enumerate(model.byte_ids):
            table[i] = bytes([b])
        self.table = np.array([*table, None], object)[:-1]
        self.spaced = np.array([p.startswith(SPACE) for p in model.pieces])

    def decode(self, ids: np.ndarray) -> str:
        parts, control = self.table[ids].tolist(), self.control[ids]
        seen = np.flatnonzero(~control)
        if not len(seen):
            return ""
        if self.strip and self.spaced[ids[seen[0]]]:
            parts[seen[0]] = parts[seen[0]][1:]
        cuts = [int(seen[0]), *(np.flatnonzero(control[seen[0] : seen[-1]]) + seen[0]).tolist(), int(seen[-1]) + 1]  # bytes on two sides of a control id are no character
        return "".join(b"".join(parts[a:b]).decode("utf-8", "each-byte") for a, b in zip(cuts, cuts[1:]))


def some_texts(rows: pa.RecordBatch, column: str, most: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """``rows`` in slices of about ``most`` bytes of text."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(rows.column(column)), 0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > begin and total + size > most:
            yield rows.slice(begin, i - begin)
            begin, total = i, 0
        total += size
    if begin < rows.num_rows:
        yield rows.slice(begin)


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else [], kind))


def encode(docs: DataFrame, path: str, begin: bool = True, end: bool = True, decode: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, packed, starts, ends for every row, and decoded, the text of the ids, if ``decode`` is set.

    ``packed`` holds the ids as little-endian unsigned 32-bit integers, ``starts`` and ``ends``, packed alike, the bytes of the
    original UTF-8 text that each id stands for; begin and end ids stand for nothing at the text's ends, and so does all but the
    last id of a character that is written in bytes. Null and empty texts have only the begin and end ids. Null ids and repeated
    rows are kept, a row each. Other columns are not read. No shuffle: one pass in place.
    """
    sent = docs.sparkSession.sparkContext.broadcast(load(path))  # at most the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        encoder, decoder = Encoder(model), Decoder(model) if decode else None
        head, foot = [model.begin] * begin, [model.end] * end
        for batch in batches:
            for rows in some_texts(batch, "text"):
                texts, packed, starts, ends, back = rows.column("text").to_pylist(), [], [], [], []
                for text, (ids, a, b) in zip(texts, encoder.encode(texts)):
                    last = [len((text or "").encode("utf-8"))] * end
                    ids = np.concatenate([head, ids, foot]).astype("<u4")
                    packed.append(ids.tobytes())
                    starts.append(np.concatenate([[0] * begin, a, last]).astype("<u4").tobytes())
                    ends.append(np.concatenate([[0] * begin, b, last]).astype("<u4").tobytes())
                    if decode:
                        back.append(decoder.decode(ids))
                columns = [rows.column("id"), pa.array([len(p) // 4 for p in packed], pa.int64()), *(pa.array(x, pa.binary()) for x in (packed, starts, ends))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(back, pa.string())] * decode, names)

    schema = "id long, n_tokens long, packed binary, starts binary, ends binary" + ", decoded string" * decode
    names = [part.split()[0] for part in schema.split(", ")]
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decoded(packed: Column | str, path: str, spark) -> Column:
    """The text of packed ids, as the library decodes them; null stays null."""
    sent = spark.sparkContext.broadcast(load(path))  # at most the vocabulary

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = Decoder(sent.value)
        for rows in batches:
            yield pd.Series([None if p is None else decoder.decode(np.frombuffer(p, "<u4")) for p in rows], dtype=object)

    return text(packed)
