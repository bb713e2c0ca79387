"""Events to a dense area-by-week panel with history-only features.

Raw events are summed to (area, week) before anything else, so partial aggregation absorbs a hot
area. From there an area holds one row per week, a number fixed by the calendar, so windows over one
area are bounded whatever the size of the event log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from risklattice.functions.scalar import week_angle, week_list
from risklattice.operators.graph import degree, neighbour_sum

AREA, WEEK, STEP = "area", "week", "t"

# Window lengths in weeks and the cap on weeks since the last event.
EVENT_WINDOWS = (1, 2, 4, 8, 13, 26, 52)
ACTIVE_WINDOWS = (1, 2, 4)
CONTEXT_WINDOWS = (4, 13, 52)
RECORD_WINDOW = 13
LONGEST_GAP = 520
AREAS_A_TASK = 4096


def weekly_totals(events: DataFrame, measures: dict[str, Column], keys: tuple[str, ...] = (AREA, WEEK)) -> DataFrame:
    """One row per (area, week) with the given sums or counts."""
    return events.groupBy(*keys).agg(*[expr.alias(name) for name, expr in measures.items()])


def week_span(df: DataFrame, week: str = WEEK) -> tuple[Column, Column]:
    """First and last week of a table as scalar subqueries."""
    return (df.select(F.min(week)).scalar(), df.select(F.max(week)).scalar())


def spine(areas: DataFrame, first: Column, last: Column) -> DataFrame:
    """Every area with every week and the week's position ``t`` from 0.

    Each area row explodes its own week list, so the grid is produced where the area lives, with no
    shuffle and no cross join.
    """
    return areas.select("*", F.posexplode(week_list(first, last)).alias(STEP, WEEK))


def densify(grid: DataFrame, totals: DataFrame, values: list[str], keys: tuple[str, ...] = (AREA, WEEK)) -> DataFrame:
    """Left join totals onto the grid; weeks without events become explicit zeros.

    Totals of areas outside the grid drop out.
    """
    out = grid.join(totals.select(*keys, *values), list(keys), "left")
    return out.withColumns({v: F.coalesce(F.col(v), F.lit(0)).cast("double") for v in values})


def dense_panel(areas: DataFrame, totals: DataFrame, values: list[str], first: Column, last: Column) -> DataFrame:
    """The same rows as :func:`spine` and :func:`densify`, for many areas with few weeks each.

    Each area takes its totals along, at most one a week, before it spreads into weeks; so only areas and totals are shuffled, and the
    weeks of an area stay in one place for the windows that follow, AREAS_A_TASK areas a task.
    """
    held = F.map_from_entries(F.collect_list(F.struct(WEEK, F.struct(*values)))).alias("_held")
    packed = totals.filter(F.col(WEEK).isNotNull()).groupBy(AREA).agg(held)
    tasks = max(1, -(-areas.count() // AREAS_A_TASK))
    grid = spine(areas.join(packed, AREA, "left").repartition(tasks, AREA), first, last)
    return grid.withColumns({v: F.coalesce(F.col("_held")[F.col(WEEK)][v], F.lit(0)).cast("double") for v in values}).drop("_held")


def by_area(*extra: str) -> Window:
    return Window.partitionBy(AREA, *extra).orderBy(STEP)


def shifted(x: Column | str, k: int = 1, w=None) -> Column:
    """Value k weeks earlier, zero before the start."""
    return F.lag(x, k, 0.0).over(w or by_area())


def rolling_sum(x: Column | str, weeks: int, delay: int = 0, w=None) -> Column:
    """Sum of ``weeks`` weeks ending one week (plus ``delay``) before the current one."""
    frame = (w or by_area()).rowsBetween(-(weeks + delay), -(1 + delay))
    return F.coalesce(F.sum(x).over(frame), F.lit(0.0))


def running_sum(x: Column | str, delay: int = 0, w=None) -> Column:
    """Sum of everything strictly before the current week."""
    frame = (w or by_area()).rowsBetween(Window.unboundedPreceding, -(1 + delay))
    return F.coalesce(F.sum(x).over(frame), F.lit(0.0))


def long_run_rate(x: Column | str, delay: int = 0, w=None) -> Column:
    """Running sum over weeks elapsed; the divisor counts the current week and ignores the delay."""
    return running_sum(x, delay, w) / (F.col(STEP) + 1).cast("double")


def weeks_since(x: Column | str, delay: int = 0, cap: int = LONGEST_GAP, single_lag: bool = False, w=None) -> Column:
    """Weeks since the last week with an event, capped.

    The published feature lags twice: it reads the series one week back and then looks for events
    before that, so 1 means an event two weeks ago. ``single_lag`` gives the plain count.
    """
    x = F.col(x) if isinstance(x, str) else x
    lags = 1 if single_lag else 2
    frame = (w or by_area()).rowsBetween(Window.unboundedPreceding, -(lags + delay))
    last = F.max(F.when(x > 0, F.col(STEP))).over(frame)
    return F.coalesce(F.least(F.col(STEP) - last - (lags - 1), F.lit(cap)), F.lit(cap)).cast("double")


def forward_label(x: Column | str, horizon: int, w=None) -> Column:
    """1 where any of this and the next ``horizon - 1`` weeks has an event."""
    x = F.col(x) if isinstance(x, str) else x
    return F.max((x > 0).cast("int")).over((w or by_area()).rowsBetween(0, horizon - 1))


def complete_horizon(df: DataFrame, horizon: int, last_step: Column | None = None) -> DataFrame:
    """Drop the last ``horizon - 1`` weeks, whose forward window is cut short."""
    if horizon <= 1:
        return df
    last = last_step if last_step is not None else df.select(F.max(STEP)).scalar()
    return df.filter(F.col(STEP) <= last - (horizon - 1))


def dropped_rows(df: DataFrame, horizon: int, area: str = "area") -> DataFrame:
    """horizon, dropped, expected: rows that :func:`complete_horizon` takes off a dense panel, and areas times the weeks it cuts."""
    kept = complete_horizon(df, horizon).groupBy(area).agg(F.count(F.lit(1)).alias("_kept"))
    sizes = df.groupBy(area).agg(F.count(F.lit(1)).alias("_all")).join(kept, area, "left")
    dropped = F.sum(F.col("_all") - F.coalesce("_kept", F.lit(0)))
    return sizes.agg(F.lit(horizon).alias("horizon"), F.coalesce(dropped, F.lit(0)).alias("dropped"), (F.count(F.lit(1)) * (horizon - 1)).alias("expected"))


def assert_dropped(df: DataFrame, horizon: int, area: str = "area") -> None:
    """Raise unless exactly the weeks without a whole forward window go."""
    found = dropped_rows(df, horizon, area).first()
    if found["dropped"] != found["expected"]:
        raise ValueError(f"horizon {horizon} drops {found['dropped']} rows, expected {found['expected']}")


def record_volume(events: DataFrame, weeks: int = RECORD_WINDOW, delay: int = 0) -> DataFrame:
    """Recording intensity: events of the whole log in the ``weeks`` weeks before each week.

    Each weekly count is handed to the weeks that see it, then summed: two aggregations, no
    single-task window over the national series.
    """
    national = events.groupBy(WEEK).agg(F.count(F.lit(1)).alias("n"))
    return trailing_total(national, "n", weeks, delay, "cov_records_13w")


def trailing_total(weekly: DataFrame, value: str, weeks: int, delay: int, name: str) -> DataFrame:
    ahead = F.explode(F.sequence(F.lit(1 + delay), F.lit(weeks + delay))).alias("ahead")
    return (
        weekly.select(F.col(WEEK).alias("seen"), value, ahead)
        .groupBy(F.date_add("seen", F.col("ahead") * 7).alias(WEEK))
        .agg(F.sum(value).cast("double").alias(name))
    )


def prefix(x: str, delay: int = 0) -> Column:
    """Inclusive running sum, the base of the long windows."""
    return F.sum(x).over(by_area().rowsBetween(Window.unboundedPreceding, 0))


def prefix_window(total: str, weeks: int, delay: int = 0) -> Column:
    """Trailing window as the difference of two prefix sums: constant work per row for any length."""
    w = by_area()
    near = F.coalesce(F.lag(total, 1 + delay).over(w), F.lit(0.0))
    far = F.coalesce(F.lag(total, 1 + delay + weeks).over(w), F.lit(0.0))
    return near - far


def panel_features(dense: DataFrame, edges: DataFrame, volume: DataFrame, delay: int = 0) -> DataFrame:
    """The 42 features on a dense grid with columns events, ops, deaths, taken.

    ``edges`` holds (src, dst) in both directions; ``volume`` comes from :func:`record_volume`.
    ``delay`` withholds that many further weeks from every history column, as late reporting would.
    Compute on the whole history and cut burn-in weeks afterwards.
    """
    sparse = dense.filter((F.col("events") > 0) | (F.col("ops") > 0)).select(
        AREA, WEEK, "events", "ops", (F.col("events") > 0).cast("double").alias("active")
    )
    near = neighbour_sum(sparse, edges, ["events", "ops", "active"], prefix="nb_")
    series = ["events", "nb_events", "active", "nb_active", "ops", "nb_ops"]
    base = (
        dense.join(near, [AREA, WEEK], "left")
        .join(degree(edges), AREA, "left")
        .join(volume, WEEK, "left")
        .withColumns(
            {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("nb_events", "nb_ops", "nb_active", "nb_degree", "cov_records_13w")}
        )
        .withColumn("nb_degree", F.col("nb_degree").cast("double"))
        .withColumn("active", (F.col("events") > 0).cast("double"))
    )
    # Counts are whole numbers, so differences of prefix sums are exact; severity sums keep real frames.
    base = base.withColumns({f"_sum_{c}": prefix(c) for c in series})
    out = {}
    for w in EVENT_WINDOWS:
        out[f"own_events_{w}w"] = prefix_window("_sum_events", w, delay)
        out[f"nb_events_{w}w"] = prefix_window("_sum_nb_events", w, delay)
    for w in ACTIVE_WINDOWS:
        out[f"own_active_{w}w"] = prefix_window("_sum_active", w, delay)
        out[f"nb_active_{w}w"] = prefix_window("_sum_nb_active", w, delay)
    for w in CONTEXT_WINDOWS:
        out[f"own_ops_{w}w"] = prefix_window("_sum_ops", w, delay)
        out[f"nb_ops_{w}w"] = prefix_window("_sum_nb_ops", w, delay)
        out[f"own_deaths_{w}w"] = rolling_sum("deaths", w, delay)
        out[f"own_taken_{w}w"] = rolling_sum("taken", w, delay)
    elapsed = (F.col(STEP) + 1).cast("double")
    own = F.coalesce(F.lag("_sum_events", 1 + delay).over(by_area()), F.lit(0.0))
    near_total = F.coalesce(F.lag("_sum_nb_events", 1 + delay).over(by_area()), F.lit(0.0))
    out["own_events_cum"] = own
    out["own_rate_longrun"] = own / elapsed
    out["nb_rate_longrun"] = near_total / elapsed
    out["own_weeks_since"] = weeks_since("events", delay)
    out["own_ever"] = (own > 0).cast("double")
    out["cal_sin"] = F.sin(week_angle(WEEK))
    out["cal_cos"] = F.cos(week_angle(WEEK))
    out["time_index"] = F.col(STEP).cast("double")
    return base.withColumns(out).drop(*[f"_sum_{c}" for c in series])


def feature_names() -> list[str]:
    names = [f"{o}_events_{w}w" for o in ("own", "nb") for w in EVENT_WINDOWS]
    names += [f"{o}_active_{w}w" for o in ("own", "nb") for w in ACTIVE_WINDOWS]
    names += [f"{o}_ops_{w}w" for o in ("own", "nb") for w in CONTEXT_WINDOWS]
    names += [f"own_{s}_{w}w" for s in ("deaths", "taken") for w in CONTEXT_WINDOWS]
    names += ["own_events_cum", "own_rate_longrun", "nb_rate_longrun", "own_weeks_since", "own_ever"]
    return names + ["cov_records_13w", "nb_degree", "cal_sin", "cal_cos", "time_index"]


def with_future_week(grid_last: Column, weeks: int = 1) -> Column:
    """Last week of a spine that also holds the week to forecast."""
    return F.date_add(grid_last, 7 * weeks)


def label_of_past(x: Column, last_observed: Column) -> Column:
    """0/1 label, null in weeks nobody has observed yet."""
    return F.when(F.col(WEEK) <= last_observed, (x > 0).cast("int"))


def recency_score(recent: Column, long_run: Column) -> Column:
    """Baseline ranker: last four weeks, long-run rate as tie-break."""
    return recent + F.lit(0.01) * long_run
