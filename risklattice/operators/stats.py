"""General aggregations over events and panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from risklattice.functions.scalar import ratio
from risklattice.operators.ranking import exact_quantiles, previous_value


def frequency(df: DataFrame, keys: list[str], within: list[str] = []) -> DataFrame:
    """Rows per key and share of the total (or of the ``within`` group); counted first, shared after."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    if not within:
        return counts.withColumn("share", F.col("n") / df.select(F.count(F.lit(1))).scalar())
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*within)))


def pivot_count(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts of ``column`` values side by side per row key, absent cells zero."""
    return df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0)


def two_level(df: DataFrame, outer: list[str], inner: str, value: Column, name: str = "mean_total") -> DataFrame:
    """Mean over ``inner`` of per-inner sums."""
    return df.groupBy(*outer, inner).agg(F.sum(value).alias("_v")).groupBy(*outer).agg(F.avg("_v").alias(name))


def quantile_bands(df: DataFrame, value: str, probs: list[float], inclusive: bool = False) -> DataFrame:
    """Assign rows to bands between exact quantiles.

    Half-open by default. ``inclusive`` counts a row on an inner edge in both bands, one output row
    for each, as closed intervals do.
    """
    edges = exact_quantiles(df, [], value, probs).scalar()
    v, e = F.col(value), edges
    n = len(probs) - 1
    hits = [F.when((v >= e[i]) & ((v <= e[i + 1]) if inclusive or i == n - 1 else (v < e[i + 1])), F.lit(i + 1)) for i in range(n)]
    return df.withColumn("band_no", F.explode(F.array_compact(F.array(*hits))))


def correlations(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """Pearson correlation of each feature with the label: one pass over the rows. Not a number where either is constant, null without rows."""

    def pearson(x: Column, y: Column) -> Column:
        x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
        spread = F.stddev_pop(x) * F.stddev_pop(y)
        return F.when(spread == 0, F.lit(float("nan"))).otherwise(F.try_divide(F.covar_pop(x, y), spread))

    one = df.agg(*[pearson(F.col(c).cast("double"), F.col(label).cast("double")).alias(c) for c in features])
    return one.unpivot([], features, "feature", "r")


def strongest(corr: DataFrame, features: list[str]) -> DataFrame:
    """Largest absolute correlation, equal ones by their place in ``features``; not a number counts as largest."""
    place = F.array_position(F.array(*[F.lit(c) for c in features]), F.col("feature"))
    order = F.when(F.col("r").isNotNull(), F.struct(F.abs("r"), -place))
    return corr.agg(F.max_by("feature", order).alias("feature"), F.max_by("r", order).alias("r"))


def sparsity(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of zeros per column."""
    one = df.agg(*[F.avg((F.col(c) == 0).cast("double")).alias(c) for c in columns])
    return one.unpivot([], columns, "feature", "zero_share")


def group_profile(df: DataFrame, group: str, observed: str, predicted: str) -> DataFrame:
    """Events, mean observed and predicted, and predicted over observed by group."""
    out = df.groupBy(group).agg(
        F.sum(F.col(observed).cast("double")).alias("events"), F.avg(observed).alias("mean_observed"), F.avg(predicted).alias("mean_predicted")
    )
    return out.withColumn("predicted_to_observed", F.try_divide("mean_predicted", "mean_observed"))


def concentration(totals: DataFrame, value: str, top: list[int], order: list[Column]) -> DataFrame:
    """Share held by the n largest groups, for each n. ``totals`` is one row per group, already summed."""
    whole = totals.select(F.sum(value)).scalar()
    # The largest groups, at most max(top) rows, are cut once; each n sums its part of them.
    largest = totals.orderBy(*order).limit(max(top)).withColumn("_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    spread = largest.withColumn("top", F.explode(F.array(*[F.lit(n) for n in top]))).filter(F.col("_rank") <= F.col("top"))
    return spread.groupBy("top").agg(F.sum(value).alias("_held")).select("top", ratio(F.col("_held"), whole).alias("share"))


def subset_share(df: DataFrame, inside: Column, value: Column) -> DataFrame:
    """One subset against the rest: share of rows and value, mean of each side."""
    return df.agg(
        F.avg(inside.cast("double")).alias("row_share"),
        ratio(F.sum(F.when(inside, value).otherwise(0)), F.sum(value)).alias("value_share"),
        F.avg(F.when(inside, value)).alias("mean_inside"),
        F.avg(F.when(~inside, value)).alias("mean_outside"),
    )


def mixed_sign(df: DataFrame, entity: str, value: str) -> DataFrame:
    """Entities whose value is negative at one time and positive at another."""
    return df.groupBy(entity).agg(F.min(value).alias("lowest"), F.max(value).alias("highest")).filter("lowest < 0 and highest > 0")


def reach_by_period(events: DataFrame, period: Column, area: str) -> DataFrame:
    """Affected areas and events per affected area by period; repeated areas collapse first."""
    per_area = events.groupBy(period.alias("period"), area).agg(F.count(F.lit(1)).alias("n"))
    return per_area.groupBy("period").agg(
        F.count(F.lit(1)).alias("areas_hit"), F.sum("n").alias("events"), (F.sum("n") / F.count(F.lit(1))).alias("events_per_area")
    )


def actor_counts(events: DataFrame, area: str, actor: str) -> DataFrame:
    """Rows per actor and area, blank actors left out."""
    named = F.trim(F.coalesce(F.col(actor), F.lit(""))) != ""
    return events.filter(named).groupBy(area, actor).agg(F.count(F.lit(1)).alias("n"))


def panel_summary(panel: DataFrame, count: str = "events", area: str = "area", week: str = "week") -> DataFrame:
    hit = F.col(count) > 0
    return panel.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct(area).alias("areas"),
        F.countDistinct(week).alias("weeks"),
        F.count_if(hit).alias("positive_rows"),
        F.avg(hit.cast("double")).alias("positive_rate"),
        F.countDistinct(F.when(hit, F.col(area))).alias("areas_ever"),
        ratio(F.count_if(F.col(count) == 1), F.count_if(hit)).alias("single_event_share"),
        F.max(count).cast("long").alias("largest"),
    )


def time_since_last(events: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """Seconds from each event to the one before it under the same key."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    out = previous_value(events, [key], [ts, tie], ts, "_before")
    return out.withColumn("gap_seconds", (micros(ts) - micros("_before")) / F.lit(1e6)).drop("_before")
