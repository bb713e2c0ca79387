"""Panel, window and graph queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from risklattice.functions.scalar import week_angle
from risklattice.operators import context, graph
from risklattice.operators import panel as P
from risklattice.operators import serve, stats
from risklattice.plans.base import DENSE, EDGES, EV, MODEL_START, SCORES, areas, dense, dense_events, directed, edges, events, features, query, r, table
from risklattice.session import cut_lineage

AREA_T = "over (partition by area order by t"


@query("A1_weekly_totals", f"with {EV} select area, week, count(*) as n, count(*) filter (is_target) as targets, round(sum(severity), 2) as severity from ev group by area, week")
def _(spark, sf):
    return P.weekly_totals(events(spark, sf), {"n": F.count(F.lit(1)), "targets": F.count_if(F.col("is_target")), "severity": r(F.sum("severity"), 2)})


@query("A2_national_weeks", f"with {DENSE} select k.week, count(ev.event_id) as n from weeks k left join ev on ev.week = k.week group by k.week")
def _(spark, sf):
    counts = events(spark, sf).groupBy("week").agg(F.count(F.lit(1)).alias("n"))
    first, last = P.week_span(counts)
    weeks = spark.range(1).select(F.explode(F.sequence(first, last, F.expr("interval 7 days"))).alias("week"))
    return weeks.join(counts, "week", "left").na.fill(0, ["n"])


@query("J14_dense_spine", f"with {DENSE} select area, week, t, events, round(deaths, 2) as deaths from dense")
def _(spark, sf):
    return dense(spark, sf).select("area", "week", F.col("t").cast("long").alias("t"), "events", r("deaths", 2).alias("deaths"))


@query("J12_neighbour_sum", f"with {DENSE},{EDGES} select dst as area, week, sum(events) as nb_events, sum(ops) as nb_ops from tot join links on src = area where events > 0 or ops > 0 group by dst, week".replace("sum(events)", "cast(sum(events) as bigint)").replace("sum(ops)", "cast(sum(ops) as bigint)"))
def _(spark, sf):
    totals = P.weekly_totals(events(spark, sf), {"events": F.count_if(F.col("is_target")), "ops": F.count_if(F.col("is_op"))})
    return graph.neighbour_sum(totals.filter("events > 0 or ops > 0"), directed(spark, sf), ["events", "ops"])


@query("A3_degree_profile", f"with {EDGES}, k as (select n_nationkey, count(src) as k from nation left join links on src = n_nationkey group by 1) select count(*) as areas, cast(sum(k) / 2 as bigint) as edges, min(k) as min_degree, round(avg(k), 6) as mean_degree, max(k) as max_degree, count(*) filter (k = 0) as isolated from k")
def _(spark, sf):
    return graph.degree_profile(directed(spark, sf), areas(spark, sf))


@query("A4_cross_group_edges", "with e as (select distinct least(c_nationkey, s_nationkey) as a, greatest(c_nationkey, s_nationkey) as b from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey where c_nationkey <> s_nationkey) select x.n_regionkey <> z.n_regionkey as crosses, count(*) as n from e join nation x on x.n_nationkey = a join nation z on z.n_nationkey = b group by 1")
def _(spark, sf):
    # Trade links between nations: line items reduced to distinct (order's nation, supplier's nation) pairs.
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    pairs = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    links = pairs.filter("c_nationkey <> s_nationkey").select(F.least("c_nationkey", "s_nationkey").alias("a"), F.greatest("c_nationkey", "s_nationkey").alias("b")).distinct()
    return graph.cross_group(links, areas(spark, sf)).groupBy("crosses").agg(F.count(F.lit(1)).alias("n"))


@query("J13_decorate", f"with {EV} select e.event_id, e.area, coalesce(n_name, 'unknown') as name, e.grp from ev e left join nation on n_nationkey = e.area")
def _(spark, sf):
    return serve.decorate(events(spark, sf).select("event_id", "area", "grp"), areas(spark, sf), "area", ["name"])


@query("J15_week_range", f"with {DENSE} select area, week, events from dense where t between 100 and 151")
def _(spark, sf):
    return dense_events(spark, sf).filter(F.col("t").between(100, 151)).select("area", "week", "events")


@query("W1_shift", f"with {DENSE} select area, t, lag(events, 1, 0) {AREA_T}) as lag1, lag(events, 3, 0) {AREA_T}) as lag3 from dense")
def _(spark, sf):
    return dense_events(spark, sf).select("area", F.col("t").cast("long").alias("t"), P.shifted("events").alias("lag1"), P.shifted("events", 3).alias("lag3"))


@query("W2_rolling_sums", f"with {DENSE} select area, t, " + ", ".join(f"coalesce(sum(events) {AREA_T} rows between {w} preceding and 1 preceding), 0) as own_{w}w" for w in P.EVENT_WINDOWS) + " from dense")
def _(spark, sf):
    return dense_events(spark, sf).select("area", F.col("t").cast("long").alias("t"), *[P.rolling_sum("events", w).alias(f"own_{w}w") for w in P.EVENT_WINDOWS])


@query("W2_prefix_sums", f"with {DENSE} select area, t, " + ", ".join(f"coalesce(sum(events) {AREA_T} rows between {w} preceding and 1 preceding), 0) as own_{w}w" for w in (13, 26, 52)) + " from dense")
def _(spark, sf):
    d = dense_events(spark, sf).withColumn("total", P.prefix("events"))
    return d.select("area", F.col("t").cast("long").alias("t"), *[P.prefix_window("total", w).alias(f"own_{w}w") for w in (13, 26, 52)])


@query("W3_running_sum", f"with {DENSE} select area, t, coalesce(sum(events) {AREA_T} rows between unbounded preceding and 1 preceding), 0) as cum from dense")
def _(spark, sf):
    return dense_events(spark, sf).select("area", F.col("t").cast("long").alias("t"), P.running_sum("events").alias("cum"))


@query("W4_long_run_rate", f"with {DENSE} select area, t, round(coalesce(sum(events) {AREA_T} rows between unbounded preceding and 1 preceding), 0) / (t + 1), 6) as rate from dense")
def _(spark, sf):
    return dense_events(spark, sf).select("area", F.col("t").cast("long").alias("t"), r(P.long_run_rate("events")).alias("rate"))


@query("W5_weeks_since", f"with {DENSE} select area, t, cast(coalesce(least(t - max(case when deaths > 400000 then t end) {AREA_T} rows between unbounded preceding and 2 preceding) - 1, 520), 520) as double) as since, cast(coalesce(least(t - max(case when deaths > 400000 then t end) {AREA_T} rows between unbounded preceding and 1 preceding), 520), 520) as double) as plain from dense")
def _(spark, sf):
    d = dense(spark, sf)
    rare = F.when(F.col("deaths") > 400000, 1).otherwise(0)
    return d.select("area", F.col("t").cast("long").alias("t"), P.weeks_since(rare).alias("since"), P.weeks_since(rare, single_lag=True).alias("plain"))


@query("W6_ever_flag", f"with {DENSE} select area, t, coalesce(sum(events) {AREA_T} rows between unbounded preceding and 1 preceding), 0) > 0 as ever from dense")
def _(spark, sf):
    return dense_events(spark, sf).select("area", F.col("t").cast("long").alias("t"), (P.running_sum("events") > 0).alias("ever"))


@query("W7_active_weeks", f"with {DENSE},{EDGES}, nb as (select dst as area, week, count(*) as x from dense join links on src = area where events > 0 group by 1, 2), j as (select d.area, d.t, case when d.events > 0 then 1 else 0 end as own, coalesce(nb.x, 0) as near from dense d left join nb on nb.area = d.area and nb.week = d.week) select area, t, cast(coalesce(sum(own) {AREA_T} rows between 4 preceding and 1 preceding), 0) as double) as own_active_4w, cast(coalesce(sum(near) {AREA_T} rows between 4 preceding and 1 preceding), 0) as double) as nb_active_4w from j")
def _(spark, sf):
    d = dense_events(spark, sf).withColumn("active", (F.col("events") > 0).cast("double"))
    near = graph.neighbour_sum(d.filter("events > 0").select("area", "week", "active"), directed(spark, sf), ["active"])
    j = d.join(near, ["area", "week"], "left").na.fill(0.0, ["nb_active"])
    return j.select("area", F.col("t").cast("long").alias("t"), P.rolling_sum("active", 4).alias("own_active_4w"), P.rolling_sum("nb_active", 4).alias("nb_active_4w"))


@query("W8_record_volume", f"with {DENSE}, n as (select k.week, count(ev.event_id) as n from weeks k left join ev on ev.week = k.week group by 1) select a.week, cast(sum(b.n) as double) as cov_records_13w from weeks a join n b on b.week between a.week - 91 and a.week - 7 group by 1")
def _(spark, sf):
    ev = events(spark, sf)
    last = ev.select(F.max("week")).scalar()
    return P.record_volume(ev.select("week")).filter(F.col("week") <= last)


@query("W9_forward_label", f"with {DENSE} select area, t, max(case when events > 0 then 1 else 0 end) {AREA_T} rows between current row and 1 following) as y2, max(case when events > 0 then 1 else 0 end) {AREA_T} rows between current row and 3 following) as y4 from dense")
def _(spark, sf):
    return dense_events(spark, sf).select("area", F.col("t").cast("long").alias("t"), P.forward_label("events", 2).alias("y2"), P.forward_label("events", 4).alias("y4"))


@query("W10_complete_horizon", f"with {DENSE}, l as (select *, max(case when events > 0 then 1 else 0 end) {AREA_T} rows between current row and 3 following) as y from dense) select area, t, y from l where t <= (select max(t) - 3 from dense)")
def _(spark, sf):
    d = dense_events(spark, sf).withColumn("y", P.forward_label("events", 4))
    last = events(spark, sf).select(F.floor(F.datediff(F.max("week"), F.min("week")) / 7)).scalar()
    return P.complete_horizon(d, 4, last).select("area", F.col("t").cast("long").alias("t"), "y")


@query("W10_dropped_rows", f"with {DENSE}, h as (select unnest([1, 2, 4]) as horizon), m as (select max(t) as last from dense) select cast(horizon as integer) as horizon, count(*) filter (t > last - (horizon - 1)) as dropped, count(distinct area) * (horizon - 1) as expected from h cross join dense cross join m group by horizon")
def _(spark, sf):
    d = cut_lineage(dense_events(spark, sf).select("area", "t"))
    out = None
    for horizon in (1, 2, 4):
        P.assert_dropped(d, horizon)
        some = P.dropped_rows(d, horizon)
        out = some if out is None else out.unionByName(some)
    return out


@query("W17_first_row", f"with {EV}, k as (select *, row_number() over (partition by area, source order by day, event_id) as rn from ev) select area, source, event_id, day from k where rn = 1")
def _(spark, sf):
    from risklattice.operators.ranking import first_value

    return first_value(events(spark, sf), ["area", "source"], F.struct("day", "event_id"), ["event_id", "day"])


@query("W18_recent_rows", f"with {EV}, k as (select *, row_number() over (partition by area order by day desc, event_id) as place from ev where day >= (select max(day) from ev) - 56) select area, day, event_id, place from k where place <= 12")
def _(spark, sf):
    ev = events(spark, sf).select("area", "day", "event_id")
    newest = ev.select(F.max("day")).scalar()
    return serve.recent_rows(ev, "area", "day", newest, 8, [F.col("day").desc(), F.col("event_id")], 12).withColumn("place", F.col("place").cast("long"))


@query("W19_future_week", f"with {DENSE}, wide as (select area, week, t, events from dense union all select n_nationkey, cast(max(week) + 7 as date), max(t) + 1, null from nation cross join weeks group by 1), f as (select area, week, t, coalesce(sum(events) {AREA_T} rows between 4 preceding and 1 preceding), 0) as own_events_4w, case when events > 0 then 1 when events is not null then 0 end as y from wide) select * from f where week >= (select max(week) from dense)")
def _(spark, sf):
    totals = P.weekly_totals(events(spark, sf), {"events": F.count_if(F.col("is_target"))})
    first, last = P.week_span(totals)
    grid = P.spine(areas(spark, sf).select("area"), first, P.with_future_week(last))
    d = P.densify(grid, totals, ["events"])
    out = d.select("area", "week", F.col("t").cast("long").alias("t"), P.rolling_sum("events", 4).alias("own_events_4w"), P.label_of_past(F.col("events"), last).alias("y"))
    return out.filter(F.col("week") >= last)


@query("A32_actor_frequency", f"with {EV} select area, segment, count(*) as n from ev where trim(coalesce(segment, '')) <> '' group by 1, 2")
def _(spark, sf):
    return stats.actor_counts(events(spark, sf), "area", "segment")


FEATURE_SQL = "with " + DENSE + "," + EDGES + """,
nb as (
  select dst as area, week, sum(events) as nb_events, sum(ops) as nb_ops, count(*) filter (events > 0) as nb_active
  from dense join links on src = area group by 1, 2),
vol as (select week, count(*) as n from ev group by 1),
j as (
  select d.*, case when d.events > 0 then 1 else 0 end as active, coalesce(nb_events, 0) as nb_events, coalesce(nb_ops, 0) as nb_ops,
         coalesce(nb_active, 0) as nb_active, (select count(*) from links where src = d.area) as nb_degree,
         coalesce((select sum(n) from vol where vol.week between d.week - 91 and d.week - 7), 0) as cov
  from dense d left join nb on nb.area = d.area and nb.week = d.week)
select area, week, """ + ", ".join(
    [f"cast(coalesce(sum({s}) {AREA_T} rows between {w} preceding and 1 preceding), 0) as double) as {n}_{w}w" for s, n in (("events", "own_events"), ("nb_events", "nb_events")) for w in P.EVENT_WINDOWS]
    + [f"cast(coalesce(sum({s}) {AREA_T} rows between {w} preceding and 1 preceding), 0) as double) as {n}_{w}w" for s, n in (("active", "own_active"), ("nb_active", "nb_active")) for w in P.ACTIVE_WINDOWS]
    + [f"cast(coalesce(sum({s}) {AREA_T} rows between {w} preceding and 1 preceding), 0) as double) as {n}_{w}w" for s, n in (("ops", "own_ops"), ("nb_ops", "nb_ops")) for w in P.CONTEXT_WINDOWS]
    + [f"round(coalesce(sum({s}) {AREA_T} rows between {w} preceding and 1 preceding), 0), 2) as own_{s}_{w}w" for s in ("deaths", "taken") for w in P.CONTEXT_WINDOWS]
) + f""",
  coalesce(sum(events) {AREA_T} rows between unbounded preceding and 1 preceding), 0) as own_events_cum,
  round(coalesce(sum(events) {AREA_T} rows between unbounded preceding and 1 preceding), 0) / (t + 1), 6) as own_rate_longrun,
  round(coalesce(sum(nb_events) {AREA_T} rows between unbounded preceding and 1 preceding), 0) / (t + 1), 6) as nb_rate_longrun,
  cast(coalesce(least(t - max(case when events > 0 then t end) {AREA_T} rows between unbounded preceding and 2 preceding) - 1, 520), 520) as double) as own_weeks_since,
  cast(case when coalesce(sum(events) {AREA_T} rows between unbounded preceding and 1 preceding), 0) > 0 then 1 else 0 end as double) as own_ever,
  cast(cov as double) as cov_records_13w, cast(nb_degree as double) as nb_degree,
  round(sin(2 * pi() * weekofyear(week) / 52), 6) as cal_sin, round(cos(2 * pi() * weekofyear(week) / 52), 6) as cal_cos,
  cast(t as double) as time_index
from j qualify week >= date '1996-01-01'"""


@query("F_all_42_features", FEATURE_SQL)
def _(spark, sf):
    f = features(spark, sf).filter(F.col("week") >= F.lit(MODEL_START).cast("date"))
    rounded = {c: 2 for c in P.feature_names() if c.startswith(("own_deaths", "own_taken"))} | {c: 6 for c in ("own_rate_longrun", "nb_rate_longrun", "cal_sin", "cal_cos")}
    return f.select("area", "week", *[r(c, rounded[c]).alias(c) if c in rounded else F.col(c) for c in P.feature_names()])


@query("F14_harmonics", f"with {DENSE} select week, weekofyear(week) as iso_week, round(sin(2 * pi() * weekofyear(week) / 52), 6) as cal_sin, round(cos(2 * pi() * weekofyear(week) / 52), 6) as cal_cos from (select distinct week from ev)".replace("weekofyear(week) as iso", "cast(weekofyear(week) as integer) as iso"))
def _(spark, sf):
    weeks = events(spark, sf).select("week").distinct()
    return weeks.select("week", F.weekofyear("week").alias("iso_week"), r(F.sin(week_angle("week"))).alias("cal_sin"), r(F.cos(week_angle("week"))).alias("cal_cos"))


CUSTOMER_PANEL = """
with ev as (select o_custkey as area, cast(date_trunc('week', o_orderdate) as date) as week, count(*) as events from orders group by 1, 2),
weeks as (
  select cast(w as date) as week, row_number() over (order by w) - 1 as t
  from (select unnest(generate_series(min(week), max(week), interval 7 day)) as w from ev)),
d as (
  select c_custkey as area, k.week, k.t, cast(coalesce(events, 0) as double) as events
  from customer cross join weeks k left join ev on ev.area = c_custkey and ev.week = k.week),
f as (
  select area, week, t, events,
    coalesce(sum(events) over (partition by area order by t rows between 4 preceding and 1 preceding), 0) as own_4w,
    coalesce(sum(events) over (partition by area order by t rows between 52 preceding and 1 preceding), 0) as own_52w,
    coalesce(least(t - max(case when events > 0 then t end) over (partition by area order by t rows between unbounded preceding and 2 preceding) - 1, 520), 520) as since
  from d)
select week, count(*) as areas, sum(events) as events, sum(own_4w) as own_4w, sum(own_52w) as own_52w, cast(sum(since) as double) as since,
  count(*) filter (events > 0 and own_4w > 0) as repeats
from f group by week"""


@query("W2_panel_by_customer", CUSTOMER_PANEL)
def _(spark, sf):
    """A panel whose areas grow with the data: one per customer, hundreds of weeks each."""
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("area"), F.date_trunc("week", "o_orderdate").cast("date").alias("week"))
    totals = P.weekly_totals(orders, {"events": F.count(F.lit(1))})
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("area"))
    d = P.dense_panel(customers, totals, ["events"], *P.week_span(orders)).withColumn("total", P.prefix("events"))
    f = d.select("area", "week", "events", P.prefix_window("total", 4).alias("own_4w"), P.prefix_window("total", 52).alias("own_52w"), P.weeks_since("events").alias("since"))
    return f.groupBy("week").agg(
        F.count(F.lit(1)).alias("areas"), F.sum("events").alias("events"), F.sum("own_4w").alias("own_4w"), F.sum("own_52w").alias("own_52w"),
        F.sum("since").alias("since"), F.count_if((F.col("events") > 0) & (F.col("own_4w") > 0)).alias("repeats"),
    )


@query("D3_trailing_days", """
with d as (select user_id, cast(ts as date) as day, count(*) as n, count(*) filter (event_type = 'error') as e from events group by 1, 2)
select user_id, day,
  cast(sum(n) over (partition by user_id order by day range between interval 6 day preceding and current row) as bigint) as last_7d,
  cast(sum(n) over (partition by user_id order by day range between interval 13 day preceding and current row) as bigint) as last_14d,
  cast(sum(n) over (partition by user_id order by day range between interval 29 day preceding and current row) as bigint) as last_30d,
  round(sum(e) over (partition by user_id order by day range between interval 29 day preceding and current row)::double
    / sum(n) over (partition by user_id order by day range between interval 29 day preceding and current row), 6) as share_error
from d""")
def _(spark, sf):
    ev = table(spark, sf, "events").select("user_id", F.col("ts").cast("date").alias("day"), F.col("event_type").alias("kind"))
    return context.trailing_day_counts(ev, "user_id", "day", [7, 14, 30], ["error"]).withColumn("share_error", r("share_error"))


@query("D6_mentions", """
select c_nationkey as area, cast(date_trunc('week', ts) as date) as week, count(props ->> 'k') as mentions, round(avg(cast(props ->> 'k' as double)), 6) as mean_score
from events join customer on user_id = c_custkey group by 1, 2""")
def _(spark, sf):
    ev = table(spark, sf, "events").join(table(spark, sf, "customer"), F.col("user_id") == F.col("c_custkey"))
    keys = [F.col("c_nationkey").alias("area"), F.date_trunc("week", "ts").cast("date").alias("week")]
    return context.mention_totals(ev, "props", "k double", keys, "k").withColumn("mean_score", r("mean_score"))


@query("D7_spatial_lag", f"with {DENSE},{EDGES}, w as (select c_nationkey as area, sum(c_acctbal) as w from customer group by 1) select dst as area, week, round(sum(w * events) / sum(w), 6) as spatial_lag from dense join links on src = dense.area join w on w.area = dense.area group by dst, week")
def _(spark, sf):
    weight = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("area")).agg(F.sum("c_acctbal").alias("w"))
    values = dense_events(spark, sf).join(weight, "area")
    return graph.spatial_lag(values, directed(spark, sf), "events", F.col("w")).withColumn("spatial_lag", r("spatial_lag"))


@query("D8_nearby_recent", f"with {EV},{EDGES}, big as (select distinct area, day from ev where severity > 490000), cells as (select distinct area, day from ev) select c.area, c.day, exists (select 1 from links join big on big.area = src where dst = c.area and big.day between c.day - 14 and c.day - 1) as nearby from cells c")
def _(spark, sf):
    ev = events(spark, sf)
    cells = ev.select("area", "day").distinct()
    return graph.nearby_recent(cells, directed(spark, sf), ev.filter("severity > 490000"), 14)


@query("D9_calendar_overlap", f"with {EV}, days as (select cast(o_orderdate as date) as a, count(*) as n from orders group by 1), holidays as (select a, a + 2 as z from days where n > (select 1.3::double * avg(n) from days)), k as (select distinct week, week + 6 as week_end from ev) select week, week_end, exists (select 1 from holidays where a <= week_end and z >= week) as festival from k")
def _(spark, sf):
    weeks = events(spark, sf).select("week").distinct().withColumn("week_end", F.date_add("week", 6))
    days = table(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("date").alias("a")).agg(F.count(F.lit(1)).alias("n"))
    big = days.filter(F.col("n") > 1.3 * days.select(F.avg("n")).scalar()).select("a")  # days far busier than the average one
    return context.overlaps(weeks, big.withColumn("z", F.date_add("a", 2)), "week", "week_end", "a", "z", "festival")


@query("D10_co_occurrence", f"with {DENSE} select area, t, case when sum(events) {AREA_T} rows between 2 preceding and 1 preceding) > 0 and sum(ops) {AREA_T} rows between 2 preceding and 1 preceding) > 0 then 1 else 0 end as both_2w from dense")
def _(spark, sf):
    d = dense(spark, sf)
    return d.select("area", F.col("t").cast("long").alias("t"), context.co_occurrence(d, "events", "ops", 2, P.by_area()).alias("both_2w"))


def trade(spark, sf):
    """Customer to supplier contacts; pairs are summed before any join, so a busy actor stays small."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("a"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("b")
    )


@query("D11_weighted_degree", """
with p as (select 'c' || o_custkey as a, 's' || l_suppkey as b, count(*) as w from lineitem join orders on l_orderkey = o_orderkey group by 1, 2),
s as (select a as actor, w from p union all select b, w from p)
select actor, cast(sum(w) as bigint) as contacts, count(*) as partners from s group by actor""")
def _(spark, sf):
    return graph.weighted_degree(trade(spark, sf))


@query("D11_page_rank", """
with recursive p as (select 'c' || o_custkey as a, 's' || l_suppkey as b, count(*)::double as w from lineitem join orders on l_orderkey = o_orderkey group by 1, 2),
l as (select a as src, b as dst, w from p union all select b, a, w from p),
st as (select src, dst, w / sum(w) over (partition by src) as share from l),
pr as (
  select 0 as i, node, 1.0::double as rank from (select distinct src as node from l)
  union all
  select min(i) + 1, dst, 0.15::double + 0.85::double * sum(share * rank) from pr join st on src = node where i < 150 group by dst)
select node, round(rank / avg(rank) over (), 3) as rank from pr where i = 150""")
def _(spark, sf):
    """Ranks over their mean, so that they read as multiples of an average node."""
    pairs = trade(spark, sf).groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))
    ranked = cut_lineage(graph.page_rank(graph.symmetric(pairs, keep=("weight",))))
    mean = ranked.select(F.avg("rank")).scalar()
    return ranked.select("node", r(F.col("rank") / mean, 3).alias("rank"))


@query("M21_hop_features", f"with {DENSE},{EDGES}, deg as (select dst, count(*) as d from links group by 1), h1 as (select l.dst as area, week, sum(events / d) as x from dense join links l on l.src = area join deg on deg.dst = l.dst group by 1, 2), h2 as (select l.dst as area, week, sum(x / d) as x from h1 join links l on l.src = area join deg on deg.dst = l.dst group by 1, 2) select h1.area, h1.week, round(h1.x, 6) as hop1_events, round(h2.x, 6) as hop2_events from h1 join h2 on h1.area = h2.area and h1.week = h2.week")
def _(spark, sf):
    out = graph.hop_features(dense_events(spark, sf), directed(spark, sf), "events", 2)
    return out.select("area", "week", r("hop1_events").alias("hop1_events"), r("hop2_events").alias("hop2_events"))


@query("M21_decayed_history", f"with {DENSE} select area, t, round(" + " + ".join(f"coalesce(lag(events, {k}) {AREA_T}), 0) * {0.8 ** (k - 1)!r}" for k in range(1, 9)) + ", 6) as decayed from dense")
def _(spark, sf):
    return dense_events(spark, sf).select("area", F.col("t").cast("long").alias("t"), r(graph.decayed_sum("events", 8, 0.8, P.by_area())).alias("decayed"))


@query("M10_recency_ranker", f"with {SCORES} select area, week, y, recency, long_run from scores")
def _(spark, sf):
    from risklattice.plans.base import scores

    return scores(spark, sf).select("area", "week", "y", "recency", "long_run")
