"""Line dedup over a corpus: keys of lines found in several documents stay in one of them. DataFrame functions only.

Only hashes of line keys move, never lines. They are range-partitioned together with a salt of the document and sorted
inside each task by document (largest first, as the largest id keeps its lines) and position. Each task streams its sorted
runs: the first row of a run is the key's first occurrence there, and documents are counted as they pass. A key has at most
``SALTS`` runs, which are summed. Each document then gets a keep bitmap: sparse 64-bit words, of which those that keep
all their lines are left out. Its text is rebuilt from the bitmap in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from risklattice.session import cut_lineage

LEAST_CHARS, LEAST_DOCS = 20, 3
SALTS = 64  # a key's documents are dealt over so many runs
BITS = 64
ALL = -1  # a word that keeps all its lines


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased (other letters stay)."""
    stripped = F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))
    return F.translate(stripped, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_lines(text: Column) -> Column:
    """Lines of a text; null and empty are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def occurrences(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc, row, pos, h1, h2: the 128-bit key hash of every line whose key is long enough. ``row`` tells apart rows of one id."""

    def hashed(line: Column, pos: Column) -> Column:
        key = line_key(line)
        return F.when(F.char_length(key) >= least_chars, F.struct(pos.alias("pos"), F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")))

    keys = F.explode(F.array_compact(F.transform(split_lines(F.col("text")), hashed)))
    return docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("row"), keys.alias("_k")).select("doc", "row", "_k.*")


def repeated_keys(lines: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """h1, h2, keeper: keys found in at least ``least_docs`` documents, and the largest id that holds them."""
    salted = lines.select("h1", "h2", "doc", "pos", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).alias("salt"))
    dealt = salted.repartitionByRange("h1", "h2", "salt").sortWithinPartitions("h1", "h2", "salt", F.desc("doc"), "pos")
    run = Window.partitionBy("h1", "h2", "salt").orderBy(F.desc("doc"), "pos")
    first = F.row_number().over(run) == 1
    fresh = first | ~F.lag("doc").over(run).eqNullSafe(F.col("doc"))
    streamed = dealt.withColumns({"_first": first, "_fresh": fresh}).filter("_fresh")
    totals = streamed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.max(F.when(F.col("_first"), F.col("doc"))).alias("keeper"))
    return totals.filter(F.col("docs") >= least_docs).select("h1", "h2", "keeper")


def keep_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc, row, keep: for documents that lose lines, word number -> its 64 keep bits; words that lose none are left out."""
    lines = cut_lineage(occurrences(docs, least_chars))
    repeated = cut_lineage(repeated_keys(lines, least_docs))  # read anew, so that a hot key's side of the join can be split
    lost = lines.join(repeated, ["h1", "h2"]).filter(~F.col("doc").eqNullSafe(F.col("keeper")))
    bit = F.expr(f"shiftleft(1L, pos % {BITS})")
    words = lost.groupBy("doc", "row", F.expr(f"pos div {BITS}").cast("int").alias("word")).agg(F.bitwise_not(F.bit_or(bit)).alias("bits"))
    return words.groupBy("doc", "row").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", "bits")))).alias("keep"))


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """All rows of ``docs`` with their text cut, and n_lines, n_dropped, keep added (existing columns of these names are replaced).

    Keys of at least ``least_chars`` code points found in at least ``least_docs`` documents lose all their lines except in the
    document of the largest id that holds them; there every line stays. Null and empty texts are one empty line. A document
    that loses nothing keeps its text as it is, null included; one that loses all its lines gets an empty text. Rows with a null id
    together count as one document, smaller than all. Repeated rows of one id count once and lose the same lines.
    """
    added = ["n_lines", "n_dropped", "keep"]
    base = docs.drop(*added)
    maps = keep_bitmaps(base, least_chars, least_docs).select(F.col("doc").alias("_doc"), F.col("row").alias("_row"), "keep")
    joined = base.withColumn("_hash", F.xxhash64("text")).join(maps, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_hash") == F.col("_row")), "left")
    lines = split_lines(F.col("text"))
    words = F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys("keep"))), lambda w: F.coalesce(F.element_at("keep", w), F.lit(ALL).cast("long")))
    flags = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.getbit(w, i) == 1)))
    kept = F.array_join(F.zip_with(lines, flags, lambda x, f: F.when(F.coalesce(f, F.lit(True)), x)), "\n")
    lost = F.aggregate(F.map_values("keep"), F.lit(0).cast("long"), lambda n, w: n + BITS - F.bit_count(w))
    return joined.select(
        *[F.when(F.col("keep").isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col(c) for c in base.columns],
        F.size(lines).cast("long").alias("n_lines"), F.coalesce(lost, F.lit(0)).cast("long").alias("n_dropped"), "keep",
    )


SQL = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) as pos
  from documents),
keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
repeated as (
  select key, max(doc_id) as keeper from keyed where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
marked as (
  select k.*, r.key is not null and k.doc_id <> r.keeper as lost from keyed k left join repeated r on k.key = r.key)
select doc_id, count(*) as n_lines, count(*) filter (lost) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not lost), '')) as kept_sha256
from marked group by doc_id
"""
