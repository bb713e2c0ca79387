"""Registry, and how the driver tables play events, areas and groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from risklattice.functions.scalar import week_start
from risklattice.operators import panel as P
from risklattice.operators.graph import symmetric
from risklattice.session import cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MODEL_START = "1996-01-01"
TARGET, OPERATION = "1-URGENT", "5-LOW"


def query(key: str, sql: str | None = None):
    """Register a query under its key; ``sql`` is its DuckDB equivalent."""

    def wrap(fn):
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql.strip()
        return fn

    return wrap


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r(c: Column | str, places: int = 6) -> Column:
    return F.round(c, places)


def areas(spark, sf) -> DataFrame:
    """The area dimension: nation with its region as group."""
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("area"), F.col("n_regionkey").alias("grp"), F.col("n_name").alias("name"))


def events(spark, sf) -> DataFrame:
    """Orders as events, placed by their customer's nation. Spark prunes what a query does not use."""
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(areas(spark, sf), F.col("c_nationkey") == F.col("area"))
        .select(
            F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("actor"), "area", "grp", "name",
            F.col("c_mktsegment").alias("segment"),
            F.col("o_orderdate").cast("date").alias("day"), week_start("o_orderdate").alias("week"),
            (F.col("o_orderpriority") == TARGET).alias("is_target"), (F.col("o_orderpriority") == OPERATION).alias("is_op"),
            F.col("o_totalprice").alias("severity"), F.col("o_orderstatus").alias("source"), F.col("o_orderpriority").alias("kind"),
        )
    )


def edges(spark, sf) -> DataFrame:
    """Areas of one group are neighbours: unordered pairs a < b of the 25-row dimension."""
    n = areas(spark, sf)
    a, b = n.select(F.col("area").alias("a"), "grp"), n.select(F.col("area").alias("b"), "grp")
    return a.join(b, "grp").filter("a < b").select("a", "b")


def directed(spark, sf) -> DataFrame:
    return symmetric(edges(spark, sf))


def measures() -> dict[str, Column]:
    hit = F.col("is_target")
    return {
        "events": F.count_if(hit), "ops": F.count_if(F.col("is_op")),
        "deaths": F.coalesce(F.sum(F.when(hit, F.col("severity"))), F.lit(0.0)),
        "taken": F.coalesce(F.sum(F.when(hit & (F.col("source") == "F"), F.col("severity"))), F.lit(0.0)),
    }


def dense(spark, sf) -> DataFrame:
    """area, grp, week, t, events, ops, deaths, taken: every nation and week from the first event to the last.

    The weekly totals are written once; span, grid, neighbours and windows all start from them.
    """
    totals = cut_lineage(P.weekly_totals(events(spark, sf), measures()))
    grid = P.spine(areas(spark, sf).select("area", "grp"), *P.week_span(totals))
    return P.densify(grid, totals, ["events", "ops", "deaths", "taken"])


def dense_events(spark, sf) -> DataFrame:
    """The same grid with target counts only."""
    totals = cut_lineage(P.weekly_totals(events(spark, sf), {"events": F.count_if(F.col("is_target"))}))
    grid = P.spine(areas(spark, sf).select("area", "grp"), *P.week_span(totals))
    return P.densify(grid, totals, ["events"])


def features(spark, sf, delay: int = 0) -> DataFrame:
    return P.panel_features(dense(spark, sf), directed(spark, sf), P.record_volume(events(spark, sf), delay=delay), delay)


def scores(spark, sf) -> DataFrame:
    """Modelled weeks with label y and two baseline rankers: recency and long_run."""
    d = dense_events(spark, sf).withColumns({"recent": P.rolling_sum("events", 4), "long_run": P.long_run_rate("events")})
    d = d.withColumns({"y": (F.col("events") > 0).cast("int"), "recency": P.recency_score(F.col("recent"), F.col("long_run"))})
    return d.filter(F.col("week") >= F.lit(MODEL_START).cast("date")).select("area", "grp", "week", "t", "events", "y", "recency", "long_run")


# The same bindings in SQL. A query puts the pieces it needs after WITH.
EV = """
ev as (
  select o_orderkey as event_id, o_custkey as actor, c_nationkey as area, n_regionkey as grp, n_name as name,
         c_mktsegment as segment, cast(o_orderdate as date) as day, cast(date_trunc('week', o_orderdate) as date) as week,
         o_orderpriority = '1-URGENT' as is_target, o_orderpriority = '5-LOW' as is_op,
         o_totalprice as severity, o_orderstatus as source, o_orderpriority as kind
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"""
EDGES = """
edges as (
  select x.n_nationkey as a, z.n_nationkey as b from nation x join nation z
  on x.n_regionkey = z.n_regionkey and x.n_nationkey < z.n_nationkey),
links as (select a as src, b as dst from edges union all select b, a from edges)"""
DENSE = EV + """,
weeks as (
  select cast(w as date) as week, row_number() over (order by w) - 1 as t
  from (select unnest(generate_series(min(week), max(week), interval 7 day)) as w from ev)),
tot as (
  select area, week, count(*) filter (is_target) as events, count(*) filter (is_op) as ops,
         coalesce(sum(severity) filter (is_target), 0) as deaths,
         coalesce(sum(severity) filter (is_target and source = 'F'), 0) as taken
  from ev group by all),
dense as (
  select n_nationkey as area, n_regionkey as grp, k.week, k.t,
         cast(coalesce(events, 0) as double) as events, cast(coalesce(ops, 0) as double) as ops,
         coalesce(deaths, 0) as deaths, coalesce(taken, 0) as taken
  from nation cross join weeks k left join tot on tot.area = n_nationkey and tot.week = k.week)"""
SCORES = DENSE + """,
past as (
  select *, coalesce(sum(events) over (partition by area order by t rows between 4 preceding and 1 preceding), 0) as recent,
         coalesce(sum(events) over (partition by area order by t rows between unbounded preceding and 1 preceding), 0)
           / cast(t + 1 as double) as long_run
  from dense),
scores as (
  select area, grp, week, t, events, case when events > 0 then 1 else 0 end as y,
         recent + 0.01::double * long_run as recency, long_run
  from past where week >= date '1996-01-01')"""
TALL = SCORES + """,
tall as (
  select 'recency' as model, area, grp, week, t, y, recency as score from scores
  union all select 'long_run', area, grp, week, t, y, long_run from scores)"""
# Rows per distinct score, with running totals from the highest score.
CELLS = TALL + """,
cells0 as (select model, score, sum(y) as tp, count(*) as n from tall group by all),
cells as (
  select *, sum(tp) over (partition by model order by score desc) as cum_tp,
         sum(n) over (partition by model order by score desc) as cum_n,
         sum(tp) over (partition by model) as p, sum(n) over (partition by model) as all_n
  from cells0)"""


def tall_scores(spark, sf) -> DataFrame:
    from risklattice.operators.metrics import long_scores

    return long_scores(scores(spark, sf), ["recency", "long_run"], ["area", "grp", "week", "t", "y"])
