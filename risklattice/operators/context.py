"""Features from calendars, mentions, actors and event mixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from risklattice.functions.scalar import ratio


def trailing_day_counts(events: DataFrame, key: str, day: str, spans: list[int], kinds: list[str], kind: str = "kind") -> DataFrame:
    """Events of the last n days (today included) by key and day, with the share of each kind in the longest span.

    Rows are summed to (key, day) first; the range window then runs over at most one row a day.
    """
    daily = events.groupBy(key, day).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(kind) == k).alias(f"_k_{k}") for k in kinds])
    number = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    daily = daily.withColumn("_d", number)

    def over(span):
        return Window.partitionBy(key).orderBy("_d").rangeBetween(-(span - 1), 0)

    longest = max(spans)
    cols = {f"last_{s}d": F.sum("n").over(over(s)) for s in spans}
    mix = {f"share_{k}": ratio(F.sum(f"_k_{k}").over(over(longest)), F.sum("n").over(over(longest))) for k in kinds}
    return daily.withColumns(cols | mix).select(key, day, *cols, *mix)


def mention_totals(mentions: DataFrame, payload: str, schema: str, keys: list[Column], value: str) -> DataFrame:
    """Mentions and mean score per key from a JSON column; malformed payloads count as no mention."""
    parsed = mentions.withColumn("_j", F.from_json(payload, schema))
    return parsed.groupBy(*keys).agg(F.count(F.col("_j")).alias("mentions"), F.avg(F.col(f"_j.{value}").cast("double")).alias("mean_score"))


def overlaps(windows: DataFrame, periods: DataFrame, start: str, end: str, p_start: str, p_end: str, flag: str = "overlaps") -> DataFrame:
    """Flag forecast windows that share a day with any calendar period.

    Both sides spread to days, which turns the interval overlap into a semi-join on the day; the day
    table holds each calendar day once, whatever the number of periods.
    """
    days = periods.select(F.explode(F.sequence(F.col(p_start), F.col(p_end))).alias("_day")).distinct()
    spans = windows.select(start, end).distinct().withColumn("_day", F.explode(F.sequence(F.col(start), F.col(end))))
    hit = spans.join(days, "_day", "left_semi").select(start, end).distinct().withColumn(flag, F.lit(True))
    return windows.join(hit, [start, end], "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def co_occurrence(dense: DataFrame, left: str, right: str, weeks: int, w) -> Column:
    """1 where both series had an event in the ``weeks`` weeks before."""
    from risklattice.operators.panel import rolling_sum

    return ((rolling_sum(left, weeks, w=w) > 0) & (rolling_sum(right, weeks, w=w) > 0)).cast("int")


def f1_at(df: DataFrame, threshold: float, keys: list[str], score: str = "score", label: str = "y") -> DataFrame:
    """Precision, recall and F1 of the rows scoring at least the threshold."""
    flagged, event = F.col(score) >= threshold, F.col(label) == 1
    out = df.groupBy(*keys).agg(F.count_if(flagged & event).alias("tp"), F.count_if(flagged & ~event).alias("fp"), F.count_if(~flagged & event).alias("fn"))
    tp = F.col("tp")
    return out.withColumns({
        "precision": ratio(tp, tp + F.col("fp")), "recall": ratio(tp, tp + F.col("fn")), "f1": ratio(2 * tp, 2 * tp + F.col("fp") + F.col("fn")),
    })


def spatial_holdout(area: Column, folds: int, code: bool = False) -> Column:
    """Fold of an area, by its hash or, for an integer code, by remainder."""
    return F.pmod(area if code else F.xxhash64(area), F.lit(folds)).cast("int")
