"""Capture-recapture: what share of events a log records, from two overlapping sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risklattice.functions.scalar import ratio

RELIABLE_MATCHES = 5


def source_cells(events: DataFrame, cell: list[str], source: str = "source") -> DataFrame:
    """Distinct (cell, source): copies of one event in one source count once, before any join."""
    return events.select(*cell, source).distinct()


def shared_within(left: DataFrame, right: DataFrame, days: int, area: str = "area", day: str = "day") -> DataFrame:
    """Left cells with a right cell in the same area at most ``days`` days away.

    The right cells spread over 2d+1 days, which turns the range into an equi-join.
    """
    offsets = F.explode(F.sequence(F.lit(-days), F.lit(days))).alias("_off")
    reach = right.select(area, day).distinct().select(area, F.col(day).alias("_day"), offsets)
    reach = reach.select(area, F.date_add("_day", F.col("_off")).alias(day)).distinct()
    return left.join(reach, [area, day], "left_semi")


def detection(events: DataFrame, main: str, other: str, groups: DataFrame, days: int = 0, area: str = "area", day: str = "day", group: str = "grp", source: str = "source") -> DataFrame:
    """Chapman estimate and detection rate per group and pooled (group null).

    Cells are (area, day). With ``days`` = 0 a cell seen by both sources is one aggregated row. Otherwise
    cells of the other source count as matched when the main source has a cell nearby, so matches never outnumber its
    records; every distinct cell stays observed. Areas of no group form one more group with a null name, told
    from the pooled row by ``pooled``. Detection is null where the estimate is not above zero.
    """
    cells = source_cells(events.filter(F.col(source).isin(main, other)), [area, day], source)
    seen = cells.groupBy(area, day).agg(
        F.max((F.col(source) == main).cast("int")).alias("in_main"), F.max((F.col(source) == other).cast("int")).alias("in_other")
    )
    if days == 0:
        seen = seen.withColumn("matched", F.col("in_main") * F.col("in_other"))
    else:
        near = shared_within(seen.filter("in_other = 1").select(area, day), seen.filter("in_main = 1"), days, area, day)
        seen = seen.join(near.withColumn("matched", F.lit(1)), [area, day], "left").na.fill(0, ["matched"])
    located = seen.join(groups.select(area, group), area, "left")
    sums = located.rollup(group).agg(
        F.sum("in_main").alias("n_main"), F.sum("in_other").alias("n_other"), F.sum("matched").alias("matched"),
        F.count(F.lit(1)).alias("observed"), F.grouping(group).alias("pooled"),
    )
    chapman = (F.col("n_main") + 1).cast("double") * (F.col("n_other") + 1) / (F.col("matched") + 1) - 1
    return sums.withColumn("estimate", chapman).withColumns({
        "detection": F.when(F.col("estimate") > 0, F.least(ratio(F.col("observed"), F.col("estimate")), F.lit(1.0))),
        "reliable": F.col("matched") >= RELIABLE_MATCHES,
    })


def detection_weights(areas: DataFrame, detected: DataFrame, area: str = "area", group: str = "grp") -> DataFrame:
    """Inverse-detection weight per area: own group where reliable, else pooled; mean one."""
    own = detected.filter((F.col("pooled") == 0) & F.col("reliable")).select(group, F.col("detection").alias("_own"))
    pooled = detected.filter(F.col("pooled") == 1).select("detection").scalar()
    raw = areas.join(own, group, "left").withColumn("raw_weight", F.lit(1.0) / F.coalesce("_own", pooled)).drop("_own")
    mean = raw.select(F.avg("raw_weight")).scalar()
    return raw.withColumn("weight", F.col("raw_weight") / mean)


def cell_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """Sizes of intersection and union of two sets of cells, by one aggregation over the tagged union."""
    tagged = left.distinct().withColumn("_l", F.lit(1)).withColumn("_r", F.lit(0)).unionByName(
        right.distinct().withColumn("_l", F.lit(0)).withColumn("_r", F.lit(1))
    )
    both = tagged.groupBy(*left.columns).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    return both.agg(
        F.count_if((F.col("_l") == 1) & (F.col("_r") == 1)).alias("in_both"), F.count(F.lit(1)).alias("in_either")
    )
