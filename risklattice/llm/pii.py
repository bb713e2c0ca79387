"""Personal data by fixed patterns and by bootstrapped context. DataFrame functions only.

Fixed patterns give the seed entities, and so do, a little less surely, tokens that by their form can only be identifiers: long
mixtures of letters and digits. Every place where a word, ``=`` or ``:`` and a token follow one another is an edge of a
pattern-instance graph: the pattern is the word with its sign, the instance the token. A pattern is scored by precision: what its
instances are trusted, against ordinary words in the same place. Seeds make patterns trustworthy, trusted patterns make more
instances known, and Spark scores the graph a few times over, both ways; what looks like an identifier under a pattern of
high confidence is found as kind ``id``. Texts are read once; afterwards only spans and edges move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from risklattice.session import cut_lineage

# The four fixed patterns, with possessive repeats so that no match backtracks or recurses, and with a start test so that a
# long run is tried once: a match begins at the start of its run or where the last match ended (\G). The matches are the same.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A word, a sign, a token, each taken whole; possessive repeats bound the work.
CONTEXT = r"(?<![\p{L}_])[\p{L}_]{2,}+\x20?[=:]\x20?[\"'(<\[]?[^\x20\x09-\x0D\"'()<>\[\]]++"
TOKEN = r"[^\x20\x09-\x0D\"'()<>\[\]]+$"
LOOKS_LIKE_ID = r"^(?=.*[0-9].*[0-9])[A-Za-z0-9_@.+-]{6,}+$"
# By its form alone an identifier: 16 characters or more, with four digits and two letters among them.
FORMED = r"^(?=(?:[^0-9]*+[0-9]){4})(?=(?:[^A-Za-z]*+[A-Za-z]){2})[A-Za-z0-9_+/=.-]{16,}+$"
ORDINARY = r"^[\p{L}\p{M}'’-]++[.,;:!?]*+$"
ROUNDS, CONFIDENT, SUPPORT = 3, 0.6, 3  # scoring rounds; least confidence and least seeds of a trusted pattern
FORM_TRUST = 0.9  # trust in a token that only its form makes known
PRIOR = 1.0  # instances against a pattern before any is seen

SPANS = "array<struct<start:bigint,end:bigint>>"


def luhn(digits: Column) -> Column:
    """Whether a digit string of at most 19 digits passes the Luhn test."""
    back = F.reverse(digits)
    total = F.lit(0)
    for i in range(19):
        digit = F.coalesce(F.substring(back, i + 1, 1).try_cast("int"), F.lit(0))
        total = total + (F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit) if i % 2 else digit)
    return total % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.coalesce(F.substring(p, -3, 3).try_cast("int") <= 255, F.lit(False)) & (F.translate(F.substring(p, F.lit(1), F.length(p) - 3), "0", "") == ""))
    if kind == "card":
        digits = F.translate(match, " -", "")
        return F.length(digits).between(16, 19) & luhn(F.when(F.length(digits) <= 19, digits))
    if kind == "phone":
        return F.length(F.translate(match, "+ ().-", "")).between(8, 15)
    return F.lit(True)


def located(text: Column, pattern: str, test) -> Column:
    """Spans (code points, end exclusive) of the matches that pass ``test``, in order: pieces between matches give the offsets."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("hit"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        hit = F.coalesce(x["hit"], F.lit(""))
        begin = acc["at"] + F.char_length(x["gap"])
        end = begin + F.char_length(hit)
        span = F.array(F.struct(begin.alias("start"), end.alias("end"))).cast(SPANS)
        return F.struct(end.cast("long").alias("at"), F.when((hit != "") & test(hit), F.concat(acc["out"], span)).otherwise(acc["out"]).cast(SPANS).alias("out"))

    return F.when(F.regexp(text, F.lit(pattern)), F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(SPANS))


def base_spans(text: Column) -> dict[str, Column]:
    return {kind: located(text, pattern, lambda m, kind=kind: valid(kind, m)) for kind, pattern in PATTERNS.items()}


def read_once(docs: DataFrame) -> DataFrame:
    """_row, doc_id, spans of each kind, and contexts (start, end, pattern, token) of every text, written once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = docs.select("doc_id", text.alias("text"), F.monotonically_increasing_id().alias("_row"))
    places = located(F.col("text"), CONTEXT, lambda m: F.lit(True))

    def edge(s: Column) -> Column:
        whole = F.substring(F.col("text"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
        token = F.regexp_extract(whole, TOKEN, 0)
        pattern = F.lower(F.substring(whole, F.lit(1), F.char_length(whole) - F.char_length(token)))
        return F.struct((s["end"] - F.char_length(token)).alias("start"), s["end"].alias("end"), pattern.alias("pattern"), F.rtrim(token, F.lit(".,;")).alias("token"))

    signs = F.col("text").contains("=") | F.col("text").contains(":")
    contexts = F.when(signs, F.transform(places, edge))
    return cut_lineage(marked.select("_row", "doc_id", *[c.alias(k) for k, c in base_spans(F.col("text")).items()], contexts.alias("contexts")))


def pattern_scores(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """pattern, confidence, seeds from edges (pattern, token, known): trusted instances against ordinary words, scored ``rounds`` times over.

    Tokens that are neither, such as short numbers, count neither way until a trusted pattern holds them. An instance counts once a
    pattern, however often it stands there.
    """
    form = F.when(F.col("token").rlike(FORMED), FORM_TRUST).otherwise(0.0)
    graph = edges.groupBy("pattern", "token").agg(F.max(F.col("known").cast("double")).alias("known"))
    graph = cut_lineage(graph.withColumns({"seed": F.greatest("known", form), "against": F.col("token").rlike(ORDINARY).cast("double")}))
    trust = graph.groupBy("token").agg(F.max("seed").alias("trust"))
    scores = None
    for _ in range(rounds):
        weighed = graph.join(trust, "token")
        doubt = F.when(F.col("trust") == 0, F.col("against")).otherwise(0.0)
        confidence = F.sum("trust") / (F.sum(F.col("trust") + doubt) + PRIOR)
        scores = cut_lineage(weighed.groupBy("pattern").agg(confidence.alias("confidence"), F.count_if(F.col("seed") > 0).alias("seeds")))
        best = F.max(F.when((F.col("confidence") >= CONFIDENT) & (F.col("seeds") >= SUPPORT) & (F.col("against") == 0), F.col("confidence")).otherwise(0.0))
        trust = graph.join(scores, "pattern").groupBy("token").agg(F.greatest(F.max("seed"), best).alias("trust"))
    return scores


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, email, ip, card, phone, id: arrays of spans in whole texts, for every row.

    Null and empty texts have none. Null ids and repeated rows are kept, a row each; other columns are not read. Ids that overlap a
    base span are not added. Hot patterns and tokens are aggregated before each shuffle.
    """
    read = read_once(docs)
    base = F.concat(*PATTERNS)
    overlaps = F.exists(base, lambda s: (s["start"] < F.col("c.end")) & (F.col("c.start") < s["end"]))
    places = read.filter(F.size("contexts") > 0).select("_row", base.alias("_b"), *PATTERNS, F.explode("contexts").alias("c")).select("_row", "c.*", overlaps.alias("known"))
    trusted = pattern_scores(places).filter((F.col("confidence") >= CONFIDENT) & (F.col("seeds") >= SUPPORT)).select("pattern")
    new = places.filter(~F.col("known") & F.regexp("token", F.lit(LOOKS_LIKE_ID))).join(trusted, "pattern")
    span = F.struct(F.col("start").cast("long").alias("start"), (F.col("start") + F.char_length("token")).cast("long").alias("end"))
    ids = new.groupBy("_row").agg(F.array_sort(F.collect_set(span)).alias("id"))
    return read.join(ids, "_row", "left").select("doc_id", *PATTERNS, F.coalesce("id", F.array().cast(SPANS)).alias("id"))


def as_text(kinds: list[str]) -> Column:
    """kind:start:end of all spans, by kind as given and then start, comma-joined."""

    def named(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    return F.array_join(F.concat(*map(named, kinds)), ",")
