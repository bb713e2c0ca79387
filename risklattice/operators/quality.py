"""Checks on panels, results and texts, each returned as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from risklattice.operators.ranking import ordered_numbers


def leakage_probe(build, events: DataFrame, perturbed: DataFrame, step: Column, features: list[str], area: str = "area", week: str = "week") -> DataFrame:
    """Rows at or before the perturbed week whose features changed, per feature; all must be zero.

    ``build(events)`` returns the panel; ``perturbed`` differs from ``events`` in one week only. Later
    changes are counted too, to show that the probe had an effect.
    """
    before, after = build(events), build(perturbed)
    joined = before.select(area, week, *features).join(after.select(area, week, *[F.col(f).alias(f"_{f}") for f in features]), [area, week])
    early = F.col(week) <= step
    counts = joined.agg(
        *[F.count_if(early & ~F.col(f).eqNullSafe(F.col(f"_{f}"))).alias(f) for f in features],
        *[F.count_if(~early & ~F.col(f).eqNullSafe(F.col(f"_{f}"))).alias(f"_{f}") for f in features],
    )
    pairs = [F.struct(F.lit(f).alias("feature"), F.col(f).alias("leaked_rows"), F.col(f"_{f}").alias("later_rows")) for f in features]
    return counts.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")


def assert_label_absent(features: list[str], labels: tuple[str, ...] = ("y", "occurred", "events")) -> None:
    wrong = sorted(set(features) & set(labels))
    if wrong:
        raise ValueError(f"label columns among the features: {wrong}")


def label_copies(panel: DataFrame, features: list[str], label: str) -> DataFrame:
    """feature, named_as_label, same, rows: whether a feature has the label's name, and in how many rows it has its value."""
    same = [F.struct(F.lit(c).alias("feature"), F.lit(c == label).alias("named_as_label"), F.count_if(F.col(c).cast("double") == F.col(label).cast("double")).alias("same")) for c in features]
    found = panel.agg(F.array(*same).alias("f"), F.count(F.lit(1)).alias("rows"))
    return found.select(F.explode("f").alias("f"), "rows").select("f.*", "rows")


def frame_difference(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], tolerance: float = 1e-4) -> DataFrame:
    """Largest absolute difference per column over joined keys, and keys on one side only."""
    joined = left.select(*keys, *columns, F.lit(True).alias("_l")).join(
        right.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_r")), keys, "full_outer"
    )
    gap = {c: F.abs(F.col(c).cast("double") - F.col(f"_{c}").cast("double")) for c in columns}
    one = joined.agg(
        F.count_if(F.col("_l").isNull() | F.col("_r").isNull()).alias("_unmatched"),
        *[F.max(gap[c]).alias(c) for c in columns],
        *[F.count_if(F.col("_l") & F.col("_r") & (F.col(c).isNull() != F.col(f"_{c}").isNull())).alias(f"_n_{c}") for c in columns],
    )
    rows = [F.struct(F.lit(c).alias("column"), F.col(c).alias("largest"), F.col(f"_n_{c}").alias("null_mismatch"), F.col("_unmatched").alias("unmatched_keys")) for c in columns]
    out = one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    ok = (F.coalesce("largest", F.lit(0.0)) <= tolerance) & (F.col("null_mismatch") == 0) & (F.col("unmatched_keys") == 0)
    return out.withColumn("ok", ok)


def expectations(computed: DataFrame, stated: dict[str, float], tolerance: float | dict[str, float] = 0.0) -> DataFrame:
    """One-row table of computed values against stated ones: (label, stated, computed, tolerance, ok)."""
    rows = []
    for name, value in stated.items():
        tol = tolerance.get(name, 0.0) if isinstance(tolerance, dict) else tolerance
        rows.append(F.struct(F.lit(name).alias("label"), F.lit(float(value)).alias("stated"), F.col(name).cast("double").alias("computed"), F.lit(float(tol)).alias("tolerance")))
    out = computed.select(F.explode(F.array(*rows)).alias("e")).select("e.*")
    return out.withColumn("ok", F.coalesce(F.abs(F.col("stated") - F.col("computed")) <= F.col("tolerance"), F.lit(False)))


def require(checks: DataFrame) -> None:
    """Raise with every failed row and their number. A check table has one row per stated expectation, so it is small."""
    failed = checks.filter(~F.coalesce("ok", F.lit(False))).collect()
    if failed:
        raise AssertionError(f"{len(failed)} failed: " + "; ".join(f"{r['label']}: stated {r['stated']}, computed {r['computed']}" for r in failed))


def non_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per column that are null, NaN or infinite, and whether the column has any variance."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == F.lit(float("inf")))
    one = df.agg(*[F.struct(F.count_if(bad(c)).alias("bad"), (F.max(c) == F.min(c)).alias("constant")).alias(c) for c in columns])
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"{c}.bad").alias("bad"), F.col(f"{c}.constant").alias("constant")) for c in columns]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


# Figures worth tracing, and those too common to trace. Fixed values.
FIGURE = r"((?<![\d.\w])\d+(?:[.,]\d+)+|(?<![\d.\w])\d{3,}|(?<![\d.\w])\d+(?=\s*per cent))"
COMMON_FIGURES = ["5", "20", "52", "42", "2", "4", "14", "28", "7"]


def figures(texts: DataFrame, doc: str, text: str, pattern: str | list[str] = FIGURE, skip: list[str] = COMMON_FIGURES) -> DataFrame:
    """Distinct numbers of each text, without years and the listed common ones. Several patterns are taken together."""
    patterns = [pattern] if isinstance(pattern, str) else pattern
    hits = [F.expr(f"regexp_extract_all({text}, r'{p}', 1)") for p in patterns]
    found = texts.select(doc, F.explode(F.concat(*hits)).alias("figure"))
    year = F.regexp_replace("figure", ",", "").rlike("^(19|20)[0-9][0-9]$")
    return found.filter(~year & ~F.col("figure").isin(skip)).distinct()


def uncarried_figures(stated: DataFrame, sources: DataFrame, figure: str = "figure") -> DataFrame:
    """Stated figures that no source holds, neither as written nor as the decimal of a percentage."""
    known = sources.select(figure).distinct()
    decimal = F.format_string("%.3f", F.regexp_replace(figure, ",", "").try_cast("double") / 100)
    left = stated.join(known, figure, "left_anti").withColumn("_dec", decimal)
    return left.join(known.select(F.col(figure).alias("_dec")), "_dec", "left_anti").drop("_dec")


def sequence_gaps(items: DataFrame, group: str, order: list[str], number: str) -> DataFrame:
    """Items whose number differs from their place 1..N inside the group."""
    placed = ordered_numbers(items, [group], order, "expected")
    return placed.filter(~F.col(number).eqNullSafe(F.col("expected")))


def orphans(cited: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, marked ``unresolved`` (cited, not listed) or ``uncited`` (listed, not cited)."""
    a, b = cited.select(key).distinct(), listed.select(key).distinct()
    lost = a.join(b, key, "left_anti").withColumn("problem", F.lit("unresolved"))
    return lost.unionByName(b.join(a, key, "left_anti").withColumn("problem", F.lit("uncited")))


def consolidate(entries: DataFrame, text: str, key: str, origin: str) -> DataFrame:
    """Equal texts once, with the number of origins and the first one."""
    return entries.groupBy(key, text).agg(F.countDistinct(origin).alias("origins"), F.min(origin).alias("first_origin"), F.count(F.lit(1)).alias("copies"))


def conflicting_keys(entries: DataFrame, text: str, key: str) -> DataFrame:
    """Keys that carry different texts."""
    return entries.groupBy(key).agg(F.countDistinct(text).alias("texts")).filter("texts > 1")


def letter_suffixes(entries: DataFrame, key: str, order: list[str], name: str = "suffix") -> DataFrame:
    """a, b, ... for entries that share a key, in the given order; a lone entry gets none.

    Beyond z the suffix goes on as columns of a spreadsheet do: aa, ab, ...
    """
    shared = entries.groupBy(key).agg((F.count(F.lit(1)) > 1).alias("_shared"))
    placed = ordered_numbers(entries, [key], order, "_n").join(shared, key)
    # Names of k letters follow the (26 ** k - 26) / 25 shorter ones; the rest in base 26 gives the letters.
    shorter = lambda k: (26**k - 26) // 25
    letters = sum(((F.col("_n") > shorter(k)).cast("int") for k in range(2, 14)), F.lit(1))
    rest = F.col("_n") - 1 - F.element_at(F.array(*[F.lit(shorter(k)).cast("long") for k in range(1, 14)]), letters)
    powers = F.array(*[F.lit(26**k).cast("long") for k in range(13)])
    digit = lambda k: F.call_function("mod", F.call_function("div", rest, F.element_at(powers, k)), F.lit(26))
    text = F.array_join(F.transform(F.sequence(letters, F.lit(1)), lambda k: F.chr(F.lit(97) + digit(k))), "")
    return placed.withColumn(name, F.when(F.col("_shared"), text).otherwise(F.lit(""))).drop("_n", "_shared")


def field_mismatches(stated: DataFrame, authority: DataFrame, key: str, fields: list[str], departures: DataFrame | None = None) -> DataFrame:
    """(key, field, stated, authority) wherever a field differs, allowed departures left out."""
    pairs = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("stated"), F.col(f"_{f}").cast("string").alias("authority")) for f in fields]
    joined = stated.select(key, *fields).join(authority.select(key, *[F.col(f).alias(f"_{f}") for f in fields]), key)
    differing = F.filter(F.array(*pairs), lambda p: ~p["stated"].eqNullSafe(p["authority"]))
    out = joined.select(key, F.explode(differing).alias("p")).select(key, "p.*")
    return out if departures is None else out.join(departures.select(key, "field"), [key, "field"], "left_anti")


def introduced_late(texts: DataFrame, doc: str, text: str, long_form: str, short_form: str) -> DataFrame:
    """Texts that use the short form with no long form before it."""
    short_at, long_at = F.instr(F.col(text), F.lit(short_form)), F.instr(F.col(text), F.lit(long_form))
    late = (short_at > 0) & ((long_at == 0) | (long_at > short_at))
    return texts.select(doc, short_at.alias("short_at"), long_at.alias("long_at"), late.alias("late")).filter("short_at > 0")


def column_groups(spark, columns: list[str], groups: dict[str, str]) -> DataFrame:
    """Assign columns to the groups whose pattern they fully match; every column must match exactly one."""
    import re

    rows = []
    for c in columns:
        hits = [g for g, pattern in groups.items() if re.fullmatch(pattern, c)]
        if len(hits) != 1:
            raise ValueError(f"column {c!r} matches groups {hits}")
        rows.append((c, hits[0]))
    return spark.createDataFrame(rows, "column string, grp string")


# Feature groups of the 42 features.
FEATURE_GROUPS = {
    "Own history": r"own_(events|active)_\d+w",
    "Background": r"own_events_cum|own_rate_longrun|nb_rate_longrun|own_weeks_since|own_ever",
    "Neighbour activity": r"nb_(events|active)_\d+w",
    "Guardianship": r"(own|nb)_ops_\d+w",
    "Severity context": r"own_(deaths|taken)_\d+w",
    "Calendar and structure": r"cal_sin|cal_cos|time_index|nb_degree|cov_records_13w",
}
