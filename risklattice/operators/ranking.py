"""Exact running totals, quantiles and top-k over columns too long for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from risklattice.session import cut_lineage

PIECE_ROWS = 200_000


def score_cells(df: DataFrame, keys: list[str], score: str, sums: dict[str, Column]) -> DataFrame:
    """One row per distinct score: equal scores, however many, collapse before the shuffle."""
    return (
        df.filter(F.col(score).isNotNull())
        .groupBy(*keys, F.col(score).cast("double").alias("score"))
        .agg(*[c.alias(n) for n, c in sums.items()])
    )


def running_totals(cells: DataFrame, keys: list[str], sums: list[str], descending: bool = True, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Add ``cum_<c>`` (inclusive, along the score) and ``all_<c>`` (whole group) to score cells.

    A single window ordered by score would put a whole group on one task. Instead the score axis is
    cut into pieces by a fixed monotone rule (a coarse log-like band, then an even split of bands
    holding more than ``piece_rows`` cells). Piece totals are few, so their prefix is a small window;
    it is added to a window inside each piece. ``keys`` are few groups (models, folds), not areas.
    Band statistics number below 100,000 per group and piece totals below that plus
    cells / ``piece_rows``; whether they are small enough to send to every task is left to Spark, which checks.
    """
    band = F.floor(F.asinh(F.col("score") * 1e6) * 64).cast("long")
    banded = cells.withColumn("_band", band)
    stats = banded.groupBy(*keys, "_band").agg(
        F.min("score").alias("_lo"), F.max("score").alias("_hi"), F.count(F.lit(1)).alias("_n")
    )
    pieces = F.ceil(F.col("_n") / F.lit(float(piece_rows)))
    place = F.coalesce(F.try_divide(F.col("score") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    placed = banded.join(stats, keys + ["_band"]).withColumn(
        "_piece", F.least(F.floor(place * pieces), pieces - 1).cast("long")
    ).drop("_lo", "_hi", "_n")

    way = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    group = keys if keys else [F.lit(0)]
    along = Window.partitionBy(*group).orderBy(way("_band"), way("_piece"))
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*keys, "_band", "_piece").agg(*[F.sum(c).alias(c) for c in sums])
    starts = totals.select(
        *keys, "_band", "_piece",
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_pre_{c}") for c in sums],
        *[F.sum(c).over(Window.partitionBy(*group)).alias(f"all_{c}") for c in sums],
    )
    inside = Window.partitionBy(*keys, "_band", "_piece").orderBy(way("score")).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(starts, keys + ["_band", "_piece"])
    out = out.withColumns({f"cum_{c}": F.col(f"_pre_{c}") + F.sum(c).over(inside) for c in sums})
    return out.drop("_band", "_piece", *[f"_pre_{c}" for c in sums])


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], name: str = "edges") -> DataFrame:
    """Linear-interpolated quantiles per group as one array, without holding a group's values in one buffer."""
    return cell_quantiles(running_totals(score_cells(df, keys, value, {"n": F.count(F.lit(1))}), keys, ["n"], descending=False), keys, probs, name)


def cell_quantiles(ranked: DataFrame, keys: list[str], probs: list[float], name: str = "edges") -> DataFrame:
    """Quantiles from cells that already carry ascending ``cum_n`` and ``all_n``."""
    picks = []
    for q in probs:
        at = F.lit(float(q)) * (F.col("all_n") - 1)
        for index in (F.floor(at), F.ceil(at)):
            holds = (F.col("cum_n") - F.col("n") <= index) & (index < F.col("cum_n"))
            picks.append(F.max(F.when(holds, F.col("score"))))
        picks.append(F.max(at - F.floor(at)))
    grouped = ranked.groupBy(*keys).agg(*[p.alias(f"_q{i}") for i, p in enumerate(picks)])
    edges = [
        F.col(f"_q{3 * i}") + (F.col(f"_q{3 * i + 1}") - F.col(f"_q{3 * i}")) * F.col(f"_q{3 * i + 2}")
        for i in range(len(probs))
    ]
    return grouped.select(*keys, F.array(*edges).alias(name))


def ranked_within(df: DataFrame, groups: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Row number inside each group; ``order`` must end in a key so that ties are settled."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))


def top_k(df: DataFrame, groups: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First k rows of each group. Spark keeps k rows per group and task before the shuffle."""
    return ranked_within(df, groups, order, name).filter(F.col(name) <= k)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in the given order."""
    return top_k(df, keys, order, 1, "_first").drop("_first")


def first_value(df: DataFrame, keys: list[str], order: Column, values: list[str]) -> DataFrame:
    """Like :func:`first_per_key` by aggregation: partial before the shuffle, safe for a hot key."""
    picked = F.min_by(F.struct(*values), order).alias("_v")
    return df.groupBy(*keys).agg(picked).select(*keys, "_v.*")


def ordered_numbers(df: DataFrame, groups: list[str], order: list[Column | str], name: str = "place") -> DataFrame:
    """Row number from 1 inside each group, for groups that may be too large for one task.

    Rows are range-sorted by group and order over all tasks, numbered inside each task, and lifted by the
    rows of the same group in earlier tasks. The sorted rows are written once in between: sampled range
    bounds may differ between two evaluations, so both steps must read the same rows. ``order`` must
    be total inside a group.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    keyed = df.withColumn("_o", F.struct(*columns))
    placed = cut_lineage(keyed.repartitionByRange(*groups, "_o").withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_c").over(before), F.lit(0))).filter("_start > 0").drop("_c")
    inside = F.row_number().over(Window.partitionBy(*groups, "_part").orderBy("_o"))
    numbered = placed.withColumn("_inside", inside)
    # Only groups cut by a task border have a start, at most one per border, so this side is small.
    joined = numbered.join(F.broadcast(starts), groups + ["_part"], "left")
    return joined.withColumn(name, F.coalesce("_start", F.lit(0)) + F.col("_inside")).drop("_part", "_o", "_inside", "_start")


def previous_value(df: DataFrame, groups: list[str], order: list[Column | str], value: str, name: str) -> DataFrame:
    """Value of the row before, inside each group, without one task per group: rows meet on (group, place)."""
    numbered = ordered_numbers(df, groups, order, "_place")
    earlier = numbered.select(*groups, (F.col("_place") + 1).alias("_place"), F.col(value).alias(name))
    return numbered.join(earlier, groups + ["_place"], "left").drop("_place")
