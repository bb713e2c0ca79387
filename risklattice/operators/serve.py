"""Views for readers of the forecast. They expose aggregates; event details only on request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from risklattice.operators.ranking import ordered_numbers
from risklattice.operators.bands import band_index


def display_label(area: str, group: str) -> Column:
    return F.concat_ws(", ", area, group)


def split_label(label: str) -> tuple[Column, Column]:
    """Area and group of a display label; the group follows the last comma."""
    group = F.substring_index(label, ", ", -1)
    return F.expr(f"substring({label}, 1, length({label}) - length(substring_index({label}, ', ', -1)) - 2)"), group


def choose(df: DataFrame, **wanted) -> DataFrame:
    """Filter columns to the given values; None or an empty list leaves a column unfiltered."""
    for column, values in wanted.items():
        if values is None or values == []:
            continue
        df = df.filter(F.col(column).isin(values) if isinstance(values, (list, tuple)) else F.col(column) == values)
    return df


def ranked_by_horizon(forecast: DataFrame, p: str = "probability", horizon: str = "horizon_days", area: str = "area") -> DataFrame:
    """Rank inside each horizon, 1 = highest; a horizon's areas are numbered over all tasks."""
    return ordered_numbers(forecast.withColumn("_down", -F.col(p)), [horizon], ["_down", area], "rank").drop("_down")


def first_rows(df: DataFrame, order: list[Column | str], n: int) -> DataFrame:
    """First n rows of the list, n from 1 to 100 on the viewer."""
    return df.orderBy(*order).limit(n)


def selected_or_first(df: DataFrame, key: str, value, order: list[Column | str]) -> DataFrame:
    """The row with the given key, or the first row when there is none."""
    preferred = F.when(F.col(key) == F.lit(value), 0).otherwise(1)
    return df.orderBy(preferred, *order).limit(1)


def band_shift(forecast: DataFrame, keep: list[str], first: int = 7, last: int = 28, horizons: list[int] = [7, 14, 28]) -> DataFrame:
    """Bands and ranks side by side by horizon for entities whose band changes from first to last."""
    wide = forecast.groupBy(*keep).pivot("horizon_days", horizons).agg(F.first("band").alias("band"), F.first("rank").alias("rank"))
    wide = wide.withColumnsRenamed({f"{h}_{c}": f"{c}_{h}" for h in horizons for c in ("band", "rank")})
    a, b = band_index(F.col(f"band_{first}")), band_index(F.col(f"band_{last}"))
    direction = F.when(b > a, f"rises by {last} days").otherwise(f"falls by {last} days")
    return wide.filter(a != b).withColumn("direction", direction).orderBy(f"rank_{first}")


def recent_rows(events: DataFrame, area: str, day: str, newest: Column, weeks: int, order: list[Column], n: int) -> DataFrame:
    """Newest n rows of each area inside the last weeks. Row details are the caller's choice of columns."""
    recent = events.filter(F.col(day) >= F.date_sub(newest, 7 * weeks))
    return recent.withColumn("place", F.row_number().over(Window.partitionBy(area).orderBy(*order))).filter(F.col("place") <= n)


def map_layer(areas: DataFrame, forecast: DataFrame, key: str) -> DataFrame:
    """Every area with its forecast."""
    return areas.join(forecast, key, "left")


def unmatched_areas(areas: DataFrame, forecast: DataFrame, key: str) -> DataFrame:
    """Forecast keys without an area and areas without a forecast; must be empty before drawing."""
    a = forecast.select(key).distinct().join(areas.select(key), key, "left_anti").withColumn("problem", F.lit("no area"))
    return a.unionByName(areas.select(key).join(forecast.select(key).distinct(), key, "left_anti").withColumn("problem", F.lit("no forecast")))


def with_tier_rate(forecast: DataFrame, stats: DataFrame) -> DataFrame:
    """Measured rate of a row's own tier at its horizon."""
    return forecast.join(stats.select("horizon_days", "band", "realised_rate"), ["horizon_days", "band"], "left")


def decorate(df: DataFrame, dimension: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Names of a key; unknown keys read ``unknown``."""
    joined = df.join(dimension.select(key, *names), key, "left")
    return joined.withColumns({n: F.coalesce(n, F.lit("unknown")) for n in names})
