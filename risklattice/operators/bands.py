"""Risk bands against a base-rate anchor, and their audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from risklattice.functions.scalar import lookup, ratio, tiers

# Band names with the multiple of the anchor where each starts.
BAND_CUTS = [("Severe", 8), ("High", 4), ("Elevated", 2)]
LOWEST_BAND = "Low"
BANDS = [name for name, _ in BAND_CUTS] + [LOWEST_BAND]
ANCHOR_WEEKS = 52


def band_of(score: Column, anchor: Column) -> Column:
    return tiers(score, anchor, BAND_CUTS, LOWEST_BAND)


def band_index(band: Column) -> Column:
    """Ordinal of a band, 1 = least severe."""
    return lookup(band, {b: len(BANDS) - i for i, b in enumerate(BANDS)})


def fold_table(spark, last_step: int, folds: int = 5, test_weeks: int = 52) -> DataFrame:
    """Rolling-origin folds on week positions: test blocks are contiguous and the last ends the record."""
    rows = []
    for i in range(folds):
        start = last_step + 1 - (folds - i) * test_weeks
        if start > 0:
            rows.append((i + 1, start, start, start + test_weeks - 1))
    return spark.createDataFrame(rows, "fold int, train_end int, test_start int, test_end int")


def with_fold(df: DataFrame, last_step: Column, folds: int = 5, test_weeks: int = 52, step: str = "t") -> DataFrame:
    """Tag test rows with their fold (1 = oldest) by arithmetic on the week position; earlier rows get null."""
    back = F.floor((last_step - F.col(step)) / F.lit(test_weeks)).cast("int")
    return df.withColumn("fold", F.when((back >= 0) & (back < folds), F.lit(folds) - back))


def anchors(df: DataFrame, kind: str, last_step: Column, folds: int = 5, test_weeks: int = 52, window: int = ANCHOR_WEEKS, step: str = "t", label: str = "y", keys: tuple[str, ...] = (), horizon: int = 1) -> DataFrame:
    """Base rate per fold: ``evaluation`` pools the test blocks of all folds, ``test_block`` is the fold's own, ``training`` takes
    all training weeks and ``recent`` the last ``window`` of them.

    A labelled week belongs to each fold it can inform; weeks are summed first, so the fan-out to
    folds touches one row per week. Training and recent anchors use only labels whose ``horizon`` weeks end before the fold's first test week.
    """
    weekly = df.filter(F.col(label).isNotNull()).groupBy(*keys, step).agg(
        F.sum(F.col(label).cast("long")).alias("_pos"), F.count(F.lit(1)).alias("_n")
    )
    spread = weekly.select("*", F.explode(F.sequence(F.lit(1), F.lit(folds))).alias("fold"))
    start = last_step + 1 - (F.lit(folds + 1) - F.col("fold")) * test_weeks
    t = F.col(step)
    known = t + horizon - 1 < start
    keep = {
        "evaluation": t > last_step - folds * test_weeks,
        "test_block": (t >= start) & (t < start + test_weeks),
        "training": known,
        "recent": known & (t >= start - window),
    }[kind]
    return spread.filter(keep).groupBy(*keys, "fold").agg(ratio(F.sum("_pos"), F.sum("_n")).alias("anchor_rate"))


def comparable_anchor(weekly: DataFrame, reference_volume: Column, cap: int = ANCHOR_WEEKS, week: str = "week", volume: str = "volume", factor: float = 2.0) -> DataFrame:
    """Base rate over the newest unbroken run of weeks recorded at a volume like the reference week's.

    ``weekly`` has one row per labelled week: week, volume, positives, rows. Where even the newest
    week is out of range, the last ``cap`` weeks serve. The window runs over weeks, a bounded table.
    """
    low, high = reference_volume / F.lit(factor), reference_volume * F.lit(factor)
    newest = Window.partitionBy(F.lit(0)).orderBy(F.col(week).desc())
    breaks = F.sum((~F.coalesce(F.col(volume).between(low, high), F.lit(False))).cast("int")).over(
        newest.rowsBetween(Window.unboundedPreceding, 0)
    )
    marked = weekly.withColumn("_breaks", breaks).withColumn("_age", F.row_number().over(newest))
    run = F.col("_breaks") == 0
    capped = F.col("_age") <= cap

    def rate(mask):
        return ratio(F.sum(F.when(mask, F.col("positives"))), F.sum(F.when(mask, F.col("rows"))))

    return marked.agg(
        F.coalesce(rate(run & capped), rate(capped)).alias("anchor_rate"),
        F.when(F.count_if(run & capped) > 0, F.count_if(run & capped)).otherwise(F.count_if(capped)).alias("weeks"),
        F.coalesce(F.min(F.when(run & capped, F.col(week))), F.min(F.when(capped, F.col(week)))).alias("first_week"),
        (F.count_if(run & capped) > 0).alias("comparable"),
    )


def band_profile(scored: DataFrame, keys: list[str] = [], label: str = "y", area: str = "area", week: str = "week") -> DataFrame:
    """Per band: areas per week, realised rate, multiple of base, share of events, areas ever; empty bands keep a row."""
    sums = scored.groupBy(*keys, "band").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col(label).cast("long")).alias("_pos"), F.countDistinct(area).alias("areas_ever")
    )
    whole = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_all_n"), F.sum(F.col(label).cast("long")).alias("_all_pos"), F.countDistinct(week).alias("_weeks")
    )
    # One row per group, times the four fixed bands.
    frame = whole.select("*", F.explode(F.array(*[F.lit(b) for b in BANDS])).alias("band"))
    joined = frame.join(sums, keys + ["band"], "left")
    rate = ratio(F.col("_pos"), F.col("_n"))
    base = ratio(F.col("_all_pos"), F.col("_all_n"))
    return joined.select(
        *keys, "band",
        (F.coalesce("_n", F.lit(0)) / F.col("_weeks")).alias("areas_per_week"),
        rate.alias("realised_rate"),
        F.try_divide(rate, base).alias("times_base"),
        F.when(F.col("_n") > 0, ratio(F.col("_pos"), F.col("_all_pos"))).alias("share_of_events"),
        F.coalesce("areas_ever", F.lit(0)).cast("long").alias("areas_ever"),
    )


def band_audit(scores: DataFrame, anchor_sets: dict[str, DataFrame], label: str = "y") -> DataFrame:
    """Band the same scores under several anchors; sizes, low share and emptiness by anchor and fold."""
    parts = []
    for name, table in anchor_sets.items():
        banded = scores.join(table, "fold").withColumn("band", band_of(F.col("score"), F.col("anchor_rate")))
        parts.append(banded.withColumn("anchor", F.lit(name)))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("anchor", "fold").agg(
        *[F.count_if(F.col("band") == b).alias(b.lower()) for b in BANDS],
        F.avg((F.col("band") == LOWEST_BAND).cast("double")).alias("low_share"),
        F.sum(F.col(label).cast("long")).alias("positives"),
    ).withColumn("empty_bands", sum((F.col(b.lower()) == 0).cast("int") for b in BANDS))


def band_moves(banded: DataFrame, area: str = "area", order: str = "t") -> DataFrame:
    """Each row with the band the same area held the week before."""
    w = Window.partitionBy(area).orderBy(order)
    return banded.withColumn("previous_band", F.lag("band").over(w))


def stability(banded: DataFrame, label: str = "y", **cols) -> DataFrame:
    """Share of rows that keep their band and share of events in rows that move."""
    moved = band_moves(banded, **cols).filter(F.col("previous_band").isNotNull())
    stays = F.col("band") == F.col("previous_band")
    return moved.agg(
        F.avg(stays.cast("double")).alias("unchanged_share"),
        ratio(F.sum(F.when(~stays, F.col(label)).otherwise(0)), F.sum(label)).alias("events_in_moves"),
    )


def transitions(banded: DataFrame, **cols) -> DataFrame:
    """Row-normalised counts of previous band to band."""
    counts = band_moves(banded, **cols).filter(F.col("previous_band").isNotNull()).groupBy("previous_band", "band").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("previous_band")))


def tier_summary(forecast: DataFrame, anchor_rates: DataFrame) -> DataFrame:
    """Areas per tier, the cut values and the anchor of each horizon."""
    counts = forecast.groupBy("horizon_days").agg(
        *[F.count_if(F.col("band") == b).alias(f"n_{b.lower()}") for b in BANDS], F.count(F.lit(1)).alias("areas")
    )
    cuts = [(F.col("anchor_rate") * m).alias(f"cut_{b.lower()}") for b, m in BAND_CUTS]
    return counts.join(anchor_rates, "horizon_days").select(*counts.columns, "anchor_rate", *cuts)


def pooled_rate(stats: DataFrame, keys: list[str] = []) -> DataFrame:
    """Rate over several tiers, weighted by the areas each holds in a week."""
    weighted = F.try_divide(F.sum(F.col("areas_per_week") * F.col("realised_rate")), F.sum("areas_per_week"))
    return stats.filter(F.col("realised_rate").isNotNull()).groupBy(*keys).agg(weighted.alias("pooled_rate"))
