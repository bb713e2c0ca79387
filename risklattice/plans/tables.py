"""Scans, casts, scalar functions, sorts and set operations on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from risklattice.functions import scalar as S
from risklattice.operators import models, quality, serve, stats
from risklattice.operators import panel as P
from risklattice.plans.base import DENSE, EV, MODEL_START, SCORES, areas, dense_events, events, features, query, r, scores, table
from risklattice.plans.panels import FEATURE_SQL
from risklattice.sources import contracts, files


@query("S4_pruned_scan", "select l_orderkey, l_quantity from lineitem")
def _(spark, sf):
    return files.read_columns(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_quantity"])


@query("S2_layers", "select layer, count(*) as n, min(name) as first_name from (select 'nation' as layer, n_name as name from nation union all select 'supplier', s_name from supplier union all select 'customer', c_name from customer) group by 1")
def _(spark, sf):
    layers = files.read_layers(spark, {n: f"{sf}/{n}.parquet" for n in ("nation", "supplier", "customer")})
    return layers.groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce("n_name", "s_name", "c_name")).alias("first_name"))


@query("S9_F20_messages", """select event_id, '{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '"}' as value from events""")
def _(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return ev.select("event_id", F.to_json(F.struct("event_id", "user_id", "event_type")).alias("value"))


@query("F20_json_fields", "select event_id, cast(props ->> 'k' as bigint) as k from events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("S10_newest_per_key", "select user_id, case when event_id % 3 <> 0 then event_id end as event_id from events qualify row_number() over (partition by user_id order by (event_id % 3 = 0), ts desc, event_id desc) = 1")
def _(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    known = F.col("event_id") % 3 != 0
    newest = contracts.newest_per_key(ev, ["user_id"], F.when(known, F.struct("ts", "event_id")))
    return newest.select("user_id", F.when(known, F.col("event_id")).alias("event_id"))


@query("P3_tolerant_number", "select doc_id, token, try_cast(token as double) as number from (select distinct doc_id, unnest(regexp_extract_all(text, '[0-9][0-9.,]*')) as token from documents)")
def _(spark, sf):
    tokens = table(spark, sf, "documents").select("doc_id", F.explode(F.expr("regexp_extract_all(text, '[0-9][0-9.,]*', 0)")).alias("token")).distinct()
    return tokens.select("doc_id", "token", S.to_number("token").alias("number"))


@query("P4_tolerant_date", "select o_orderkey, try_cast(substr(cast(cast(o_orderdate as date) as varchar), 1, 8) || lpad(cast(o_orderkey % 40 as varchar), 2, '0') as date) as day from orders")
def _(spark, sf):
    text = F.concat(F.substring(F.col("o_orderdate").cast("date").cast("string"), 1, 8), F.lpad((F.col("o_orderkey") % 40).cast("string"), 2, "0"))
    return table(spark, sf, "orders").select("o_orderkey", S.to_day(text).alias("day"))


@query("P10_not_null_filter", "select doc_id, lang, quality from documents left join labels using (doc_id) where quality is not null and toxic = 0")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.filter(F.col("quality").isNotNull() & (F.col("toxic") == 0)).select("doc_id", "lang", "quality")


@query("P11_F9_week_start", "select event_id, cast(date_trunc('week', ts) as date) as week, cast(dayofweek(date_trunc('week', ts)) as integer) as weekday from events")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", S.week_start("ts").alias("week"))
    return e.withColumn("weekday", F.dayofweek("week") - 1)


@query("P17_clip", "select c_custkey, least(greatest(c_acctbal, 0), 5000) as clipped from customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", S.clip("c_acctbal", 0.0, 5000.0).alias("clipped"))


@query("P18_display_label", "select c_custkey, c_name || ', ' || n_name as label, c_name as area_part, n_name as group_part from customer join nation on c_nationkey = n_nationkey")
def _(spark, sf):
    c = table(spark, sf, "customer").join(areas(spark, sf), F.col("c_nationkey") == F.col("area")).withColumn("label", serve.display_label("c_name", "name"))
    a, g = serve.split_label("label")
    return c.select("c_custkey", "label", a.alias("area_part"), g.alias("group_part"))


GROUP_CASE = "case when regexp_full_match(c, 'own_(events|active)_[0-9]+w') then 'Own history' when regexp_full_match(c, 'nb_(events|active)_[0-9]+w') then 'Neighbour activity' when regexp_full_match(c, '(own|nb)_ops_[0-9]+w') then 'Guardianship' when regexp_full_match(c, 'own_(deaths|taken)_[0-9]+w') then 'Severity context' when c in ('cal_sin', 'cal_cos', 'time_index', 'nb_degree', 'cov_records_13w') then 'Calendar and structure' else 'Background' end"
LONG_FEATURES = "select unnest([{'c': '" + "'}, {'c': '".join(f"{c}', 'v': cast({c} as double)" for c in P.feature_names()).replace("double)'}", "double)}") + "}]) as u from fx"


@query("P20_A12_sparsity_by_group", f"with fx as ({FEATURE_SQL}), u as ({LONG_FEATURES}), z as (select u.c as c, avg((u.v = 0)::int) as zero_share from u group by 1) select {GROUP_CASE} as grp, count(*) as features, round(avg(zero_share), 6) as zero_share from z group by 1")
def _(spark, sf):
    """Zero share of the 42 features, averaged over the column groups; a column in no group or in two is an error."""
    f = features(spark, sf).filter(F.col("week") >= F.lit(MODEL_START).cast("date"))
    groups = quality.column_groups(spark, P.feature_names(), quality.FEATURE_GROUPS)
    # Trigonometric noise is not zero; severity sums and rates are compared as the panel stores them.
    zero = stats.sparsity(f.withColumns({c: r(c) for c in ("cal_sin", "cal_cos")}), P.feature_names())
    return zero.join(groups, F.col("feature") == F.col("column")).groupBy("grp").agg(F.count(F.lit(1)).alias("features"), r(F.avg("zero_share")).alias("zero_share"))


@query("F2_F5_string_functions", "select part.p_partkey, lower(trim(' ' || p_name || ' ')) as tidy, contains(p_name, 'red') as has_red, starts_with(p_type, 'S') as s_type, string_split(p_name, ' ')[1] as first_word, regexp_replace(p_brand, '[^0-9]', '', 'g') as digits, regexp_full_match(p_brand, 'Brand#1[0-9]') as teens, regexp_extract(p_brand, '#([0-9]+)', 1) as number from part")
def _(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", F.lower(F.trim(F.concat(F.lit(" "), "p_name", F.lit(" ")))).alias("tidy"), F.contains("p_name", F.lit("red")).alias("has_red"),
        F.startswith("p_type", F.lit("S")).alias("s_type"), F.split("p_name", " ")[0].alias("first_word"), F.regexp_replace("p_brand", "[^0-9]", "").alias("digits"),
        F.col("p_brand").rlike("^Brand#1[0-9]$").alias("teens"), F.regexp_extract("p_brand", "#([0-9]+)", 1).alias("number"),
    )


@query("F10_F13_calendar", "select o_orderkey, cast(weekofyear(o_orderdate) as integer) as iso_week, cast(year(o_orderdate) as integer) as year, cast(cast(o_orderdate as date) + 14 as date) as two_weeks_on, strftime(o_orderdate, '%Y-%m-%d') as shown from orders")
def _(spark, sf):
    d = F.col("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", F.weekofyear(d).alias("iso_week"), F.year(d).alias("year"), S.add_weeks(d.cast("date"), 2).alias("two_weeks_on"), F.date_format(d, "yyyy-MM-dd").alias("shown"))


@query("F12_week_list", f"with {EV}, s as (select area, min(week) as a, max(week) as b from ev group by 1) select area, cast(unnest(generate_series(a, b, interval 7 day)) as date) as week from s")
def _(spark, sf):
    ends = events(spark, sf).groupBy("area").agg(F.min("week").alias("a"), F.max("week").alias("b"))
    return ends.select("area", F.explode(S.week_list(F.col("a"), F.col("b"))).alias("week"))


@query("F15_log_odds", f"with {SCORES}, p as (select area, week, least(greatest(long_run, 1e-6), 1 - 1e-6) as p from scores) select area, week, round(ln(p / (1 - p)), 6) as log_odds, round(1 / (1 + exp(-(ln(p / (1 - p)) + 0.5))), 6) as shifted from p")
def _(spark, sf):
    s = scores(spark, sf)
    return s.select("area", "week", r(S.log_odds("long_run")).alias("log_odds"), r(S.sigmoid(S.log_odds("long_run") + 0.5)).alias("shifted"))


@query("F16_numeric", "select c_custkey, round(sqrt(abs(c_acctbal)), 6) as root, cast(sign(c_acctbal) as double) as sign, round(c_acctbal, 1) as rounded from customer")
def _(spark, sf):
    b = F.col("c_acctbal")
    return table(spark, sf, "customer").select("c_custkey", r(F.sqrt(F.abs(b))).alias("root"), F.signum(b).alias("sign"), r(b, 1).alias("rounded"))


@query("F17_tiers", "select o_orderkey, case when o_totalprice >= 400000 then 'Severe' when o_totalprice >= 200000 then 'High' when o_totalprice >= 100000 then 'Elevated' else 'Low' end as tier from orders")
def _(spark, sf):
    from risklattice.operators.bands import band_of

    return table(spark, sf, "orders").select("o_orderkey", band_of(F.col("o_totalprice"), F.lit(50000.0)).alias("tier"))


@query("F18_dictionary", "select o_orderkey, case o_orderstatus when 'F' then 'final' when 'O' then 'open' else 'other' end as status from orders")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.lookup(F.col("o_orderstatus"), {"F": "final", "O": "open"}, F.lit("other")).alias("status"))


@query("F19_dense_code", "select c_mktsegment as segment, c_nationkey as nation, cast(dense_rank() over (order by c_mktsegment, c_nationkey) - 1 as integer) as code from (select distinct c_mktsegment, c_nationkey from customer)")
def _(spark, sf):
    keys = table(spark, sf, "customer").select(F.struct("c_mktsegment", "c_nationkey").alias("k"))
    return models.dense_code(keys, "k").select(F.col("k.c_mktsegment").alias("segment"), F.col("k.c_nationkey").alias("nation"), "code")


@query("F21_percent_text", "select o_orderkey, case when d * 100 < 10 then printf('%.1f%%', d * 100) else printf('%.0f%%', d * 100) end as shown from (select o_orderkey, o_totalprice / 1000000 as d from orders)")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.percent_text(F.col("o_totalprice") / 1000000).alias("shown"))


@query("U2_tagged_blocks", f"with {DENSE} select 7 as horizon_days, area, t, case when events > 0 then 1 else 0 end as y from dense union all select 28, area, t, max(case when events > 0 then 1 else 0 end) over (partition by area order by t rows between current row and 3 following) from dense")
def _(spark, sf):
    d = dense_events(spark, sf)
    part = lambda h: d.select(F.lit(7 * h).alias("horizon_days"), "area", F.col("t").cast("long").alias("t"), P.forward_label("events", h).alias("y"))
    return part(1).unionByName(part(4))


@query("U4_set_difference", "select distinct c_custkey as custkey from customer except select o_custkey from orders")
def _(spark, sf):
    stated = table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey")).distinct()
    return stated.join(table(spark, sf, "orders").select(F.col("o_custkey").alias("custkey")), "custkey", "left_anti")


@query("U5_distinct_tuples", "select distinct c_nationkey, c_mktsegment from customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_nationkey", "c_mktsegment").distinct()


@query("T2_top_n", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20")
def _(spark, sf):
    return serve.first_rows(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), "o_orderkey"], 20)


@query("J18_scores_with_state", f"with {SCORES} select s.area, s.week, n.n_regionkey as state, s.recency from scores s join (select distinct n_nationkey, n_regionkey from nation) n on n.n_nationkey = s.area")
def _(spark, sf):
    s = scores(spark, sf).select("area", "week", "recency")
    return s.join(areas(spark, sf).select("area", F.col("grp").alias("state")).distinct(), "area", "left").select("area", "week", "state", "recency")


@query("Q2_label_absent", f"with {SCORES}, f as (select unnest([{{'feature': 'recency', 'v': recency::double}}, {{'feature': 'long_run', 'v': long_run::double}}, {{'feature': 'week_number', 'v': t::double}}], recursive := true), y from scores) select feature, feature = 'y' as named_as_label, count(*) filter (v = y) as same, count(*) as rows from f group by feature")
def _(spark, sf):
    """No feature is the label: by name, and by how often it has the label's value."""
    s = scores(spark, sf).withColumnRenamed("t", "week_number")
    names = ["recency", "long_run", "week_number"]
    quality.assert_label_absent(names)
    return quality.label_copies(s, names, "y")
