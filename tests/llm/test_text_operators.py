"""Token counts, line dedup, personal data, main text, mixing, toxicity: exact against brute force, and the odd cases."""

import hashlib
import random
import re

import brute
import pytest
from pyspark.sql import functions as F

from risklattice.llm import html, lines, mixing, pii, tokens, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, source=None):
    rows = [(i, t, "en", (source or (lambda k: f"s{k % 3}"))(i), len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def odd(spark):
    """Null id, null text, null source, empty and repeated rows."""
    rows = [(None, "no id here at all", None, None, None), (1, None, None, None, None), (2, "", "en", "a", 0), (3, "same text twice", "en", "a", 15), (3, "same text twice", "en", "a", 15)]
    return spark.createDataFrame(rows, DOC)


def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_token_counts_equal_the_library(spark, vocabulary):
    texts = ["Hello world", "it's  a\n\ntest  ", "x" * 5000, "<|endoftext|>a<|endoftext|><|endoftext|>", "é漢字 🙂 12345 !!??", " " * 70_000 + "a", "the " * 40_000, None, ""]
    got = {r.doc_id: r for r in tokens.count_tokens(docs_of(spark, texts), vocabulary).collect()}
    tok = tokens.load(vocabulary)
    for i, t in enumerate(texts):
        assert got[i].n_tokens == len(tok.encode(t or "", add_special_tokens=False).ids)
        assert got[i].n_bytes == len((t or "").encode()) and got[i].over_limit == (got[i].n_tokens > 1024)


def test_token_counts_of_odd_rows(spark, vocabulary):
    assert tokens.count_tokens(odd(spark).withColumn("n_tokens", F.lit("clash")), vocabulary).count() == 5
    assert tokens.count_tokens(empty(spark), vocabulary).count() == 0


def test_whole_tokens_encode_alone(vocabulary):
    whole, tok = tokens.whole_tokens(vocabulary), tokens.load(vocabulary)
    assert len(whole) > 40_000
    for s in random.Random(1).sample(sorted(whole), 300):
        assert len(tok.encode(s, add_special_tokens=False).ids) == 1


def test_lines_stay_in_the_largest_document(spark):
    shared, rng = "This line is long enough to count", random.Random(2)
    texts = [f"own {i}\n  {shared.upper()} \t\n{shared}\nshort\n{'pair line of two documents only' if i < 2 else ''}" for i in range(5)]
    texts += ["\n".join(rng.choice([shared, "a line of some twenty characters", "unique %d" % rng.random()]) for _ in range(200)), None, "", shared]
    out = {r.doc_id: r for r in lines.dedup_lines(docs_of(spark, texts)).collect()}
    want = brute.repeated_lines(list(enumerate(texts)))
    for i, t in enumerate(texts):
        assert (out[i].text or "") == "\n".join(want[i])
        assert out[i].n_lines == len((t or "").split("\n")) and out[i].n_dropped == out[i].n_lines - len(want[i])
    assert out[6].text is None and out[7].text == ""
    # Bitmaps name only words that lose a line.
    assert out[6].keep is None and all(bits != -1 for bits in out[5].keep.values())


def test_lines_of_odd_rows(spark):
    long = "a line that three rows of no id share"
    rows = [(None, long, None, None, 0)] * 3 + [(5, long, "en", "a", 0), (6, long, "en", "a", 0), (6, long, "en", "a", 0)]
    df = spark.createDataFrame(rows, DOC).withColumn("keep", F.lit(1)).withColumn("h1", F.lit(2))
    out = lines.dedup_lines(df).collect()
    # Rows without id are one document, so three hold the line; the rows of document 6 keep it.
    assert sorted((r.doc_id or 0, r.text, r.n_dropped) for r in out) == [(0, "", 1)] * 3 + [(5, "", 1)] + [(6, long, 0)] * 2
    assert out[0].h1 == 2
    assert lines.dedup_lines(empty(spark)).count() == 0


TRICKY = [
    "a@b.c_d@e.f x.y@z-1.co.uk. @no.com a@b a@@b.c", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4 9999999999.1.1.1 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112 5500000000000004",
    "+1 (555) 123-4567 +44 20 7946 0958. +12 +1()()() +123456789012345678", "é漢🙂 me@x.org 漢 10.0.0.1", "4" * 30_000 + " a" * 10, "a." * 20_000 + "@" + "b." * 20_000, "1." * 20_000, "+1" + " (" * 20_000 + "1", None, "",
]


def test_personal_data_equals_plain_patterns(spark):
    rng = random.Random(3)
    texts = TRICKY + ["".join(rng.choice("a1.@+ -()9\n4é") for _ in range(400)) for _ in range(150)]
    found = pii.find_personal_data(docs_of(spark, texts)).select("doc_id", F.sha2(pii.as_text(list(pii.PATTERNS)).cast("binary"), 256).alias("h"))
    got = {r.doc_id: r.h for r in found.collect()}
    assert [i for i, t in enumerate(texts) if got[i] != brute.spans_sha256(t)] == []


def test_trusted_context_finds_unseen_ids(spark):
    texts = [f"contact: user{i}@mail.org thanks" for i in range(8)] + ["see contact: AB12-99871 now", "note: AB12-99871", "note: plain words", "note: other", "odd: 12345678"]
    found = {r.doc_id: r.id for r in pii.find_personal_data(docs_of(spark, texts)).collect()}
    assert [(s.start, s.end) for s in found[8]] == [(13, 23)] and texts[8][13:23] == "AB12-99871"
    assert all(not found[i] for i in range(len(texts)) if i != 8)


def test_long_tokens_and_names_are_taken_whole(spark):
    name, token = "a_name_of_more_than_twenty_four_letters", "eyJ0eXAi1." * 30 + "end"
    texts = [f"{key}: user{i}@mail.org thanks" for i in range(8) for key in ("contact", name)] + [f"see contact: {token} now", f"see {name}: {token} now"]
    found = {r.doc_id: r.id for r in pii.find_personal_data(docs_of(spark, texts)).collect()}
    assert [[texts[i][s.start : s.end] for s in found[i]] for i in (16, 17)] == [[token], [token]]


def test_second_line_hash_reads_the_line(spark):
    row = lines.occurrences(docs_of(spark, ["a line of more than twenty signs"])).withColumn("seeded", F.expr("xxhash64('a line of more than twenty signs', 1)")).first()
    assert row.h2 != row.seeded  # which is a function of h1


def test_tokens_of_the_documents_are_found_and_nothing_else(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    found = {r.doc_id: [(s.start, s.end) for s in r.id] for r in pii.find_personal_data(docs).collect()}
    for r in docs.collect():
        want = [m.span(1) for m in re.finditer(r'token = "([0-9a-f]{40})"', r.text or "")]
        assert set(want) <= set(found[r.doc_id])
        assert all(sum(c.isdigit() for c in r.text[a:b]) >= 2 for a, b in found[r.doc_id])
    assert sum(map(len, found.values())) < 1.2 * sum(len(re.findall('token = "', r.text or "")) for r in docs.collect())


def test_patterns_are_scored_against_ordinary_words(spark):
    ids = [(f"key = ", f"{i}abc4567890123{i}xyz", False) for i in range(5)] + [("key = ", "a1b2c3", False)]
    words = [("said: ", w, False) for w in "one two three four five six seven eight nine".split()] + [("said: ", f"9{i}abc4567890123{i}xyz", False) for i in range(3)]
    few = [("once = ", "0abc45678901230xyz", False), ("no: ", "word", True)]
    got = {r.pattern: (r.confidence, r.seeds) for r in pii.pattern_scores(spark.createDataFrame(ids + words + few, "pattern string, token string, known boolean")).collect()}
    assert got["key = "][0] > pii.CONFIDENT and got["key = "][1] == 5
    assert got["said: "][0] < pii.CONFIDENT and got["once = "][1] < pii.SUPPORT and got["no: "][1] == 1


def test_personal_data_of_odd_rows(spark):
    assert pii.find_personal_data(odd(spark).withColumn("email", F.lit("clash"))).count() == 5
    assert pii.find_personal_data(empty(spark)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><header><h2>Site name</h2></header>
<nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav><div class="cookie-notice">We use cookies</div>
<%s><h1>Big &amp; small</h1><p>First   paragraph with <b>bold</b>
and a&nbsp;line break,<br>long enough to be text.<p>Second paragraph &lt;ok&gt; that goes on for a while.<ul><li>one item</li><li>two items</li></ul>
<aside>Related</aside><form><input> Search</form></%s><div class="comments"><p>I disagree with all of this, said a reader at length.</p></div>
<div id="sidebar"><p>Popular posts and more words</p></div><footer>&copy; Someone</footer></body></html>"""
TEXT = ["Big & small", "First paragraph with bold and a line break, long enough to be text.", "Second paragraph <ok> that goes on for a while.", "one item", "two items"]


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_main_text_of_a_page(tag):
    assert html.content_blocks(PAGE % (tag, tag)) == TEXT


def test_main_text_of_odd_pages(spark):
    pages = [(1, "u", None, 1), (2, "u", "", 1), (None, None, "<p>only one paragraph of text", 1), (4, "u", "<div>" * 3000 + "deep text here", 1), (5, "u", "plain text < no markup & more", 1), (6, "u", "<article><p>" + "word " * 200_000, 1), (6, "u", "<script>x", 1)]
    out = html.extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string, text int")).collect()
    assert [r.text for r in out[:5]] == ["", "", "only one paragraph of text", "deep text here", "plain text < no markup & more"]
    assert out[5].n_chars == 200_000 * 5 - 1 and out[6].text == ""


def test_smoothing_keeps_a_constant():
    assert html.smoothed([2.0] * 7) == pytest.approx([2.0] * 7)


def test_mix_meets_targets(spark):
    rng = random.Random(4)
    texts = ["w " * rng.randint(0, 60) for _ in range(600)] + [None]
    out = mixing.mix(docs_of(spark, texts, lambda i: None if i % 7 == 0 else "hot" if i % 3 else f"s{i % 4}")).collect()
    per = {}
    for r in out:
        assert r.size == len((texts[r.doc_id] or "").split()) and 0 <= r.taken <= 2 * r.size
        per.setdefault(r.source, []).append(r)
    total = sum(r.size for r in out)
    assert sum(v[0].target for v in per.values()) == pytest.approx(1.5 * total)
    for rows in per.values():
        assert rows[0].source_size == sum(r.size for r in rows)
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 60


def test_mix_of_odd_rows(spark):
    out = mixing.mix(odd(spark).withColumn("taken", F.lit("clash"))).collect()
    assert len(out) == 5 and {r.size for r in out if r.text is None} == {0}
    assert mixing.mix(empty(spark)).count() == 0


def test_toxicity_learns_from_documents(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(300)]

    def text(toxic):
        parts = [" ".join(rng.choice(words) for _ in range(8)) for _ in range(rng.randint(1, 12))]
        if toxic:
            k = rng.randrange(len(parts))
            parts[k] = parts[k] + " nastyword"
        return ". ".join(parts) + "."

    marks = [int(rng.random() < 0.3) for _ in range(900)]
    docs = docs_of(spark, [text(m) for m in marks])
    labels = spark.createDataFrame([(i, m) for i, m in enumerate(marks) if i % 2], "doc_id long, toxic int")
    weights = toxicity.learn(docs, labels)
    out = {r.doc_id: r for r in toxicity.score(docs, weights).collect()}
    assert [i for i, m in enumerate(marks) if (out[i].score >= 0.5) != bool(m)] == []
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i, m in enumerate(marks):
        assert not m or "nastyword" in texts[i][out[i].worst_start : out[i].worst_end]
    assert toxicity.accepted(docs, labels).count() == marks.count(0)
    # Held-out labels are no input: turning them around changes nothing.
    held = toxicity.held_out("doc_id")
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert (toxicity.learn(docs, turned) == weights).all()
    # A long clean text stays clean.
    assert toxicity.Scorer({}).scored("clean words. " * 100_000)[0] == 0.0


def test_toxicity_of_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    weights = toxicity.learn(odd(spark), none)
    assert not weights.any()
    assert [r.score for r in toxicity.score(odd(spark).withColumn("score", F.lit("clash")), weights).collect()] == [0.0] * 5
    assert toxicity.score(empty(spark), weights).count() == 0


def test_mix_sources_hash(spark):
    assert hashlib.md5(b"7").hexdigest()[:12] == spark.range(7, 8).select(mixing.place_hash("id").alias("h")).first().h
