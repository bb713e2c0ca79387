"""Piece encoding, tokenizer alignment and ranked search against the libraries, brute force and the odd cases."""

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from risklattice.llm import align, pieces, ranked
from risklattice.llm.queries import QUERIES
from test_text_operators import DOC, docs_of, empty, odd

HARD = ["", " ", "  ", "a", " a", "a▁b", "▁", "<s> hi </s><0x0A>\n\n\t<|endoftext|>", "漢字🙂é ́x\0y", "  " * 50 + "x" + "   y  ", "x" * 3000, "ab" * 70_000, "1234567 8,90", "<unk>", None]


@pytest.fixture(scope="module")
def byte_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def piece_path():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(piece_path):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_path)


def texts_of(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def noise(n, alphabet, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(n)]


def merged(word, scores):
    """Byte-pair merges of one word, the plain way: the best pair, the leftmost of equals, until none is left."""
    own = list(word)
    while True:
        best = max(((scores[a + b], -i) for i, (a, b) in enumerate(zip(own, own[1:])) if a + b in scores), default=None)
        if best is None:
            return own
        i = -best[1]
        own[i : i + 2] = [own[i] + own[i + 1]]


def test_piece_query_equals_the_library(spark, sf, library):
    texts = dict(texts_of(spark, sf))
    rows = QUERIES["op11_piece_encoding"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_pieces_spans_and_decoding_of_hard_texts(spark, piece_path, library):
    texts = HARD + noise(300, "ab  \n▁漢🙂é1<>", 1)
    out = pieces.encode(docs_of(spark, texts), piece_path).withColumn("text", pieces.decoded("packed", piece_path, spark))
    got = {r.doc_id: r for r in out.collect()}
    for i, t in enumerate(texts):
        want, n = library.encode(t or "", return_type="proto").pieces, len((t or "").encode())
        assert np.frombuffer(got[i].packed, "<u4").tolist() == [1, *(p.id for p in want), 2]
        starts, ends = (np.frombuffer(x, "<u4").tolist() for x in (got[i].starts, got[i].ends))
        assert list(zip(starts, ends)) == [(0, 0), *((p.begin, p.end) for p in want), (n, n)]
        assert got[i].text == library.decode([1, *(p.id for p in want), 2])


def test_pieces_equal_plain_merges(piece_path, library):
    scores = {library.id_to_piece(i): library.get_score(i) for i in range(259, library.get_piece_size())}
    encoder = pieces.Encoder(pieces.load(piece_path))
    for text, (ids, _, _) in zip(own := noise(200, "the andingr  ", 2), encoder.encode(own)):
        assert [library.id_to_piece(int(i)) for i in ids] == merged("▁" + text.replace(" ", "▁"), scores)


def test_decoding_of_any_ids(piece_path, library):
    decoder, rng = pieces.Decoder(pieces.load(piece_path)), random.Random(3)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(32_000), rng.randrange(3, 259), rng.randrange(3)]) for _ in range(rng.randint(0, 12))]
        assert decoder.decode(np.array(ids, "<u4")) == library.decode(ids)


def test_character_map_normalises_like_the_library(piece_path):
    """A compiled map with some 200,000 bytes of trie: longest keys, alignment, and extra spaces taken out."""
    from dataclasses import replace

    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    library, spec = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc"), sentencepiece_model_pb2.NormalizerSpec()
    spec.ParseFromString(library.serialized_normalizer_spec())
    assert len(spec.precompiled_charsmap) > 100_000
    model = replace(pieces.load(piece_path), character_map=spec.precompiled_charsmap, squeeze=spec.remove_extra_whitespaces)
    encoder = pieces.Encoder(model)
    for text in [t for t in HARD if t] + noise(1500, " 　①ｱﾟ ﬁ́eé漢​﻿\tガ가x", 4):
        want, places = library.normalize(text, with_offsets=True)
        data, source = encoder.normalised(text)
        at = np.cumsum([0, *(len(c.encode()) for c in data.decode())])
        assert data.decode() == want
        assert [len(text.encode()[: source[k]].decode()) for k in at] == places


def plain_alignment(texts, byte_path, library):
    """Groups, links and their corpus-wide counts, one token and one pair at a time."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(byte_path)
    tok.encode_special_tokens = True
    byte_of = {c: b for b, c in ((b, chr(b)) for b in [*range(33, 127), *range(161, 173), *range(174, 256)])}
    byte_of |= {chr(256 + n): b for n, b in enumerate(b for b in range(256) if chr(b) not in byte_of)}
    rows, held = [], Counter()
    for text in texts:
        a = tok.encode(" " + (text or ""), add_special_tokens=False).ids
        b = library.encode(text or "")
        bytes_a = [bytes(byte_of[c] for c in tok.id_to_token(i)) for i in a]
        names = [library.id_to_piece(i) for i in b]
        bytes_b = [bytes([int(p[3:-1], 16)]) if library.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, names)]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            rows.append(((0, 0, 0, ""), []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        groups = defaultdict(lambda: ([], []))
        cuts = sorted(set(ends_a) & set(ends_b))
        for side, (ids, ends) in enumerate(((a, ends_a), (b, ends_b))):
            for i, e in zip(ids, ends):
                groups[cuts[bisect_left(cuts, e)]][side].append(i)
        owners = [[n for n, x in enumerate(side) for _ in x] for side in (bytes_a, bytes_b)]  # of each byte
        links = [(a[i], b[j]) for i, j in dict.fromkeys(zip(*owners))]
        held.update(set(links))
        rows.append(((len(a), len(b), len(groups), ";".join("|".join(",".join(map(str, side)) for side in groups[c]) for c in cuts)), links))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return [(*shape[:3], len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(shape[3].encode()).hexdigest() if shape[3] else "") for shape, links in rows]


def aligned(docs, byte_path, piece_path):
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    out = align.with_counts(align.align(docs, byte_path, piece_path).withColumn("digest", digest).drop("groups"))
    return [tuple(r) for r in out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "digest").collect()]


def test_alignment_equals_brute_force(spark, byte_path, piece_path, library, monkeypatch):
    texts = [t for t in HARD if len(t or "") < 5000] + noise(150, "the andingr  \n▁漢🙂é1<>", 5) + ["the end of the line"] * 4 + ["don't   stop 12345"] * 3
    monkeypatch.setattr(align, "BLOCK_BYTES", 500)  # many blocks
    got = dict((r[0], r[1:]) for r in aligned(docs_of(spark, texts).repartition(3), byte_path, piece_path))
    assert [got[i] for i in range(len(texts))] == plain_alignment(texts, byte_path, library)


def test_alignment_query_equals_brute_force(spark, sf, byte_path, library):
    own = [(d, t) for d, t in texts_of(spark, sf)]
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_alignment"](spark, sf).collect()}
    assert [got[d] for d, _ in own] == plain_alignment([t for _, t in own], byte_path, library)


def test_cuts_are_found_at_any_depth():
    rng = np.random.RandomState(6)
    for _ in range(300):
        size = rng.randint(1, 200)
        a, b = ([*np.flatnonzero(rng.rand(size) < p), size] for p in rng.rand(2))
        last_a, last_b = align.shared_cuts(np.array(a), np.array(b), np.array([0, len(a)]), np.array([0, len(b)]))
        assert [a[i] for i in last_a] == [b[i] for i in last_b] == sorted(set(a) & set(b))


def test_new_text_operators_of_odd_rows(spark, byte_path, piece_path):
    clashing = odd(spark).withColumn("packed", F.lit("x")).withColumn("block", F.lit("x")).withColumn("n_tokens", F.lit("x")).withColumn("id", F.lit("x"))
    rows = pieces.encode(clashing, piece_path).collect()
    assert sorted((r.doc_id is None, r.n_tokens) for r in rows)[:2] == [(False, 2), (False, 2)] and len(rows) == 5
    assert len(aligned(clashing, byte_path, piece_path)) == 5
    assert pieces.encode(empty(spark), piece_path).count() == 0 and aligned(empty(spark), byte_path, piece_path) == []


def plain_terms(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)


def plain_scores(docs, query):
    """(score, id) of every document with a score above zero, best first."""
    own = [(i, Counter(plain_terms(t))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, c in own if c), sum(sum(c.values()) for _, c in own)
    out = []
    for i, c in own:
        score, size = 0, sum(c.values())
        for t in set(plain_terms(query)) & set(c):
            weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in d for _, d in own) + 1)))
            score += weight * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * (10 + 90 * size * n_docs // n_terms)))
        if score > 0:
            out.append((score, i))
    return sorted(out, key=lambda x: (-x[0], x[1] is None, x[1] or 0))


def test_ranked_search_equals_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeéß漢1") for _ in range(rng.randint(1, 4))) for _ in range(150)]
    texts = [" ".join(rng.choice(words[: rng.choice([5, 40, 150])]) for _ in range(rng.choice([1, 8, 40, 300]))) for _ in range(120)]
    texts += [texts[0]] * 12 + [None, "", "-- !!", texts[1].upper(), " ".join(words) * 30, "x" * 50_000]
    rows = [(None if i == 5 else 7 if i in (6, 8) else i, t) for i, t in enumerate(texts)]
    queries = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))) for i in range(40)] + [(40, texts[0]), (41, None), (42, ""), (43, "unseen words only"), (44, "x" * 50_000)]
    monkeypatch.setattr(ranked, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(ranked, "ITEM_BYTES", 4000)  # several blocks of documents and of items
    monkeypatch.setattr(ranked, "ITEMS_AT_ONCE", 7)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("items", F.lit("clash")).withColumn("score", F.lit("clash")).repartition(3)
    items = spark.createDataFrame([*queries, queries[0]], "item_id long, text string")
    got = defaultdict(list)
    for r in ranked.search(docs, items).orderBy("item_id", "rank").collect():
        got[r.item_id].append((r.rank, r.score, r.doc_id))
    want = {i: [(n, s, d) for n, (s, d) in enumerate(plain_scores(rows, q)[:10], 1)] for i, q in queries}
    assert got == {i: w for i, w in want.items() if w}


def test_bounds_hold_and_exclude(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    index, texts = ranked.build_index(docs).persist(), dict(texts_of(spark, sf))
    block = next(ranked.item_blocks(items, "item_id", "text"))
    found = ranked.prepared(index, block)
    every, reach, total = list(range(len(block))), 0, 0
    for row in index.filter("bits > 0").collect():
        exact = [dict(found.score(texts[d], every)) for d in row.ids]
        for begin, bounds in found.bounds(row.bits, np.array(row.sizes), row.slices):
            real = np.array([[e.get(begin + i, 0) for e in exact] for i in range(len(bounds))])
            assert (bounds >= real).all()
            total += bounds.size
            reach += int((bounds > 1.25 * real + 1_000_000).sum())
    assert reach < 0.5 * total  # bounds are near the scores


def test_ranked_search_of_odd_rows(spark):
    items = spark.createDataFrame([(1, "same text twice"), (None, "no id"), (2, None)], "item_id long, text string")
    rows = ranked.search(odd(spark), items).collect()
    assert sorted((r.item_id is None, r.rank, r.doc_id) for r in rows if r.doc_id is not None) == [(False, 1, 3), (False, 2, 3)]
    assert [(r.rank, r.doc_id) for r in rows if r.item_id is None] == [(1, None)]
    assert ranked.search(empty(spark), items).count() == 0 and ranked.search(odd(spark), items.filter("false")).count() == 0
