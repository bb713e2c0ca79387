"""Match free-text labels to a closed list of areas, inside a declared group."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from risklattice.functions.text import edit_ratio, matching_blocks_ratio
from risklattice.operators.ranking import first_value, top_k
from risklattice.session import cut_lineage

FUZZY_THRESHOLD = 0.88
SEED_GRAMS = 3


def spellings(reference: DataFrame, group: Column, key, name_pattern: str, code: str) -> DataFrame:
    """Unpivot every name column that fully matches the pattern; the first spelling of a key wins.

    ``key`` turns a name column into its match key. Columns count in table order, rows by code.
    """
    names = [c for c in reference.columns if re.fullmatch(name_pattern, c)]
    tall = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.col(c).alias("name")) for i, c in enumerate(names)]))
    rows = reference.select(F.col(code).alias("code"), group.alias("group_key"), F.col(names[0]).alias("official_name"), tall.alias("s"))
    rows = rows.filter(F.col("s.name").isNotNull()).select("code", "group_key", "official_name", "s.place", key(F.col("s.name")).alias("name_key"))
    rows = rows.filter(F.col("name_key") != "")
    return first_value(rows, ["group_key", "name_key"], F.struct("place", "code"), ["code", "official_name", "place"])


def distinct_labels(events: DataFrame, group: str, label: str) -> DataFrame:
    """Labels once each, with the number of records: the rest of the match works on these."""
    return events.filter(F.col(label).isNotNull()).groupBy(group, label).agg(F.count(F.lit(1)).alias("records"))


def fuzzy_best(labels: DataFrame, reference: DataFrame, score=matching_blocks_ratio) -> DataFrame:
    """Best-scoring reference name of the same group for each distinct (group_key, name_key).

    The reference is the closed dimension; a label meets only the names of its own group, and the
    best is kept by an aggregate that runs before the shuffle. Ties go to the smaller code.
    """
    names = reference.select("group_key", F.col("name_key").alias("_ref"), "code", "official_name", "place")
    scored = (
        labels.select("group_key", "name_key").distinct().join(names, "group_key")
        .withColumn("score", score(F.col("name_key"), F.col("_ref")))
    )
    order = F.struct((-F.col("score")).alias("s"), F.col("code"), F.col("place"))
    return first_value(scored, ["group_key", "name_key"], order, ["code", "official_name", "score"])


def letter_bits(name: Column) -> tuple[Column, Column]:
    """Letters of a name as bits, two for each of a-z and twelve for all else, a bit an occurrence, and how many occurrences have no bit.

    The ones two names have in common, with the smaller rest, are never fewer than the letters they share.
    """
    counts = [F.length(name) - F.length(F.replace(name, F.lit(c), F.lit(""))) for c in "abcdefghijklmnopqrstuvwxyz"]
    counts.append(F.length(name) - sum(counts[1:], counts[0]))
    room = [2] * 26 + [12]
    unary = [F.shiftleft(F.call_function("shiftleft", F.lit(1).cast("long"), F.least(n, F.lit(r)).cast("int")) - 1, sum(room[:i])) for i, (n, r) in enumerate(zip(counts, room))]
    rest = [F.greatest(n - r, F.lit(0)) for n, r in zip(counts, room)]
    bits = unary[0]
    for u in unary[1:]:
        bits = bits.bitwiseOR(u)
    return bits, sum(rest[1:], rest[0])


def pairs_in_reach(labels: DataFrame, names: DataFrame, best: DataFrame) -> DataFrame:
    """(group_key, name_key, ref): the pairs whose edit ratio can reach the best one known of the label, by bounds that no such pair escapes.

    ``labels`` and ``names`` come from :func:`_gram_rows`, ``best`` adds ``best`` to the labels. An edit changes at most two grams
    of a label, so a label that may change fewer grams than it has must share one of its rarest ones with the name. Labels that
    may change all of them look through the names length by length. Either way the lengths and the letters in common must allow the ratio.
    """
    keys = ["group_key", "name_key"]
    open_labels = labels.join(best, keys)
    longer = F.greatest("_len", "ref_len")
    common = F.bit_count(F.col("_bits").bitwiseAND(F.col("ref_bits"))) + F.least("_rest", "ref_rest")
    allowed = F.least(common, F.least("_len", "ref_len")) >= F.col("best") * longer - 1e-9
    changed = F.floor(2 * (1 - F.col("best")) * F.col("_len") + 1e-9)
    open_labels = open_labels.withColumn("_probes", changed + 1)
    probing = open_labels.filter(F.col("_probes") <= F.size("_grams"))
    probes = probing.select(*keys, "_len", "_bits", "_rest", "best", F.explode(F.slice("_grams", F.lit(1), F.col("_probes").cast("int"))).alias("_gram"))
    postings = names.select("group_key", "ref", "ref_len", "ref_bits", "ref_rest", F.explode("_grams").alias("_gram"))
    near = probes.join(postings, ["group_key", "_gram"]).filter(allowed).select(*keys, "ref")
    lengths = names.select("group_key", "ref_len").distinct()
    rest = open_labels.filter(F.col("_probes") > F.size("_grams")).select(*keys, "_len", "_bits", "_rest", "best")
    of_length = rest.join(lengths, "group_key").filter(F.least("_len", "ref_len") >= F.col("best") * longer - 1e-9)
    far = of_length.join(names.drop("_grams"), ["group_key", "ref_len"]).filter(allowed).select(*keys, "ref")
    return near.unionByName(far).distinct()


def _gram_rows(rows: DataFrame, name: str, order: DataFrame | None, prefix: str = "_") -> DataFrame:
    """``rows`` with the length, letters and two-letter grams of a name; the grams rarest first where ``order`` gives their counts."""
    bits, rest = letter_bits(F.col(name))
    out = rows.withColumns({f"{prefix}len": F.length(name), f"{prefix}bits": bits, f"{prefix}rest": rest})
    grams = F.array_distinct(F.regexp_extract_all(name, F.lit("(?s)(?=(..))"), F.lit(1)))
    if order is None:
        return out.withColumn("_grams", grams)
    keys = rows.columns
    each = rows.select(*keys, F.explode(grams).alias("_gram")).join(order, ["group_key", "_gram"], "left")
    sorted_grams = each.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.coalesce("_names", F.lit(0)).alias("n"), "_gram"))), lambda g: g["_gram"]).alias("_grams"))
    return out.join(sorted_grams, keys, "left").withColumn("_grams", F.coalesce("_grams", F.array().cast("array<string>")))


def nearest_names(labels: DataFrame, reference: DataFrame) -> DataFrame:
    """The same as :func:`fuzzy_best` by edit ratio, without letting a label meet all names of its group.

    Names that hold one of the label's three rarest grams set a first best; then only names that can reach it are compared, so the
    best stays exact however low it is.
    """
    keys = ["group_key", "name_key"]
    names = cut_lineage(_gram_rows(reference.select("group_key", F.col("name_key").alias("ref")).distinct(), "ref", None, "ref_"))
    held = names.select("group_key", F.explode("_grams").alias("_gram")).groupBy("group_key", "_gram").agg(F.count(F.lit(1)).alias("_names"))
    own = cut_lineage(_gram_rows(labels.select(*keys).distinct(), "name_key", held).join(names.select("group_key").distinct(), "group_key", "left_semi"))
    ratio = edit_ratio(F.col("name_key"), F.col("ref"))
    rarest = own.select(*keys, F.explode("_grams").alias("_gram")).join(held, ["group_key", "_gram"])
    rarest = top_k(rarest, keys, [F.col("_names"), F.col("_gram")], SEED_GRAMS)
    seeds = rarest.select(*keys, "_gram").join(names.select("group_key", "ref", F.explode("_grams").alias("_gram")), ["group_key", "_gram"])
    first = seeds.groupBy(*keys).agg(F.max(ratio).alias("best"))
    best = own.select(*keys).join(first, keys, "left").withColumn("best", F.coalesce("best", F.lit(0.0)))
    scored = pairs_in_reach(own, names, best).withColumn("score", ratio)
    places = reference.select("group_key", F.col("name_key").alias("ref"), "code", "official_name", "place")
    order = F.struct((-F.col("score")).alias("s"), F.col("code"), F.col("place"))
    top = scored.groupBy(*keys).agg(F.max("score").alias("score"))
    return first_value(scored.join(top, [*keys, "score"]).join(places, ["group_key", "ref"]), keys, order, ["code", "official_name", "score"])


def crosswalk(labels: DataFrame, reference: DataFrame, overrides: DataFrame, threshold: float = FUZZY_THRESHOLD, score=matching_blocks_ratio) -> DataFrame:
    """Manual, then exact, then fuzzy match of (group_key, name_key); unmatched keeps its best score.

    ``overrides`` has (group_key, name_key, code, official_name). Only labels the first two passes leave open reach the
    fuzzy pass.
    """
    keys = ["group_key", "name_key"]
    manual = overrides.select(*keys, F.struct("code", "official_name").alias("_manual"))
    exact = reference.select(*keys, F.struct("code", "official_name").alias("_exact"))
    looked = labels.join(manual, keys, "left").join(exact, keys, "left")
    open_labels = looked.filter(F.col("_manual").isNull() & F.col("_exact").isNull())
    found = nearest_names(open_labels, reference) if score is edit_ratio else fuzzy_best(open_labels, reference, score)
    fuzzy = found.select(*keys, F.struct("code", "official_name", "score").alias("_fuzzy"))
    joined = looked.join(fuzzy, keys, "left")
    accepted = F.col("_fuzzy.score") >= threshold
    kind = (
        F.when(F.col("_manual").isNotNull(), "manual").when(F.col("_exact").isNotNull(), "exact")
        .when(accepted, "fuzzy").otherwise("unmatched")
    )

    def pick(field):
        return F.coalesce(F.col(f"_manual.{field}"), F.col(f"_exact.{field}"), F.when(accepted, F.col(f"_fuzzy.{field}")))

    return joined.select(
        *labels.columns, pick("code").alias("code"), pick("official_name").alias("official_name"), kind.alias("match_type"),
        F.when(kind.isin("manual", "exact"), F.lit(1.0)).otherwise(F.round(F.coalesce(F.col("_fuzzy.score"), F.lit(0.0)), 4)).alias("score"),
    )


def lookup_with_fallback(events: DataFrame, first: DataFrame, second: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Left join two lookup tables on the same keys; the second serves where the first has no row."""
    a = first.select(*keys, F.struct(*values).alias("_a"))
    b = second.select(*keys, F.struct(*values).alias("_b"))
    joined = events.join(a, keys, "left").join(b, keys, "left")
    hit = F.coalesce("_a", "_b")
    return joined.withColumns({v: hit[v] for v in values}).drop("_a", "_b")


def attach_counts(labels: DataFrame, counts: DataFrame, keys: list[str], count: str = "records") -> DataFrame:
    """Counts onto labels; a label without records gets zero."""
    return labels.join(counts.select(*keys, count), keys, "left").na.fill(0, [count])


def match_report(matched: DataFrame, kind: str = "match_type", records: str = "records") -> DataFrame:
    """Labels and records per match type, with the share of all records."""
    by_type = matched.groupBy(kind).agg(F.count(F.lit(1)).alias("labels"), F.sum(records).alias("records"))
    whole = matched.select(F.sum(records)).scalar()
    return by_type.withColumn("record_share", F.try_divide(F.col("records").cast("double"), whole.cast("double")))


def candidate_state(keys: DataFrame, candidates: DataFrame, on: list[str]) -> DataFrame:
    """missing, resolved or ambiguous for each wanted key by its number of candidates."""
    n = candidates.groupBy(*on).agg(F.count(F.lit(1)).alias("candidates"))
    out = keys.join(n, on, "left").na.fill(0, ["candidates"])
    state = F.when(F.col("candidates") == 0, "missing").when(F.col("candidates") == 1, "resolved").otherwise("ambiguous")
    return out.withColumn("state", state)
