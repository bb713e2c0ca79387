"""Steps that belong together as one query: raw sources to a panel, and evidence to a final placement."""

from __future__ import annotations

from pyspark.sql import functions as F

from risklattice.functions import text as T
from risklattice.functions.scalar import week_start
from risklattice.operators import bands, conform, ranking, resolve, serve
from risklattice.operators import panel as P
from risklattice.plans.base import areas, events, query, r, table
from risklattice.plans.evidence import FOLD_SQL, GENERAL_SQL, general_log, specialist
from risklattice.plans.measures import FORECAST, forecast, horizon_bands, horizon_labels

START = "1993-01-01"
KEY_SQL = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"


@query("E1_events_to_panel", f"""with {GENERAL_SQL},
p as (select *, coalesce(date between date '{START}' and (select max(date) from m where is_target), false) as in_period from m),
cw as (select c_mktsegment as state, {KEY_SQL.format('c_name')} as k, min(c_nationkey) as area from customer group by 1, 2),
x as (select area, cast(date_trunc('week', date) as date) as week, kidnapped from p join cw on state = state_raw and k = {KEY_SQL.format('lga_raw')} where is_target and in_period),
w as (select cast(unnest(generate_series(min(week), max(week), interval 7 day)) as date) as week from x),
t as (select area, week, count(*) as events, coalesce(sum(kidnapped), 0) as taken from x group by 1, 2),
d as (select n_nationkey as area, w.week, coalesce(events, 0)::double as events, coalesce(taken, 0) as taken from nation cross join w left join t on t.area = n_nationkey and t.week = w.week)
select area, week, events, round(taken, 2) as taken, coalesce(sum(events) over (partition by area order by week rows between 4 preceding and 1 preceding), 0) as own_events_4w from d""")
def _(spark, sf):
    """Two raw logs conformed, merged and dated, their labels matched to areas, counted by week on the dense grid, with a lagged feature."""
    merged = conform.period_flags(conform.merge_sources(general_log(spark, sf), specialist(spark, sf)), START)
    labels = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("state_raw"), T.ascii_key("c_name").alias("key"), F.col("c_nationkey").alias("area"))
    matched = labels.groupBy("state_raw", "key").agg(F.min("area").alias("area"))
    placed = merged.filter("is_target and in_model_period").withColumn("key", T.ascii_key("lga_raw")).join(matched, ["state_raw", "key"]).withColumn("week", week_start("date"))
    totals = P.weekly_totals(placed, {"events": F.count(F.lit(1)), "taken": F.coalesce(F.sum("kidnapped"), F.lit(0.0))})
    dense = P.densify(P.spine(areas(spark, sf).select("area"), *P.week_span(totals)), totals, ["events", "taken"])
    return dense.select("area", "week", F.col("events").cast("double").alias("events"), F.round("taken", 2).alias("taken"), P.rolling_sum("events", 4).cast("double").alias("own_events_4w"))


PLACES_SQL = f"""
g0 as (select page_id, regexp_extract(url, '//(?:[a-z]+\\.)?([a-z]+)\\.example', 1) as name_key, regexp_extract(url, '/(en|fr|de|es)(?:/|$)', 1) as group_key from pages),
pl as (select * from g0 where name_key <> '' and group_key <> ''),
gz as (select name_key, group_key, min(page_id) as code from pl where length(name_key) >= 5 group by 1, 2),
d as (select doc_id, lang, {FOLD_SQL} as blob, case when doc_id % 5 = 0 then doc_id % 97 end as gc, case when doc_id % 3 = 0 then doc_id % 89 end as nc from documents),
e as (select doc_id, lang, blob, a.page_id as geo_code, a.group_key as geo_group, b.page_id as name_code, b.group_key as name_group from d left join pl a on a.page_id = gc left join pl b on b.page_id = nc),
b as (
  select *, case when geo_code is not null and name_code is not null then
      case when geo_code = name_code then 'agree' when geo_group = lang then 'conflict_kept_geometry' when name_group = lang then 'conflict_kept_name' else 'conflict_unresolved' end
    when geo_code is not null then 'geometry_only' when name_code is not null then 'name_only' else 'none' end as basis from e),
c as (select *, case when basis in ('agree', 'conflict_kept_geometry', 'geometry_only') then geo_code when basis in ('conflict_kept_name', 'name_only') then name_code end as code from b),
h as (select doc_id, arg_min(gz.code, (-length(name_key), gz.code)) as found from c join gz on group_key = lang and contains(blob, name_key) where c.code is null group by 1)"""


@query("E2_resolve_with_gazetteer", f"with {PLACES_SQL} select c.doc_id, case when code is null and found is not null then 'gazetteer' else basis end as basis, coalesce(code, found) as code, coalesce(code, found) is not null as resolved from c left join h on c.doc_id = h.doc_id")
def _(spark, sf):
    """Documents placed by coordinate and name evidence, and those still unplaced by the longest place name in their text."""
    pages = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"//(?:[a-z]+\.)?([a-z]+)\.example", 1).alias("name_key"), F.regexp_extract("url", "/(en|fr|de|es)(?:/|$)", 1).alias("group_key"))
    places = pages.filter("name_key <> '' and group_key <> ''")
    geo = places.select(F.col("page_id").alias("geo_code"), F.col("group_key").alias("geo_group"))
    named = places.select(F.col("page_id").alias("name_code"), F.col("group_key").alias("name_group"))
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    hints = docs.select("doc_id", "lang", F.when(F.col("doc_id") % 5 == 0, F.col("doc_id") % 97).alias("_g"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 89).alias("_n"))
    seen = hints.join(geo, F.col("_g") == F.col("geo_code"), "left").join(named, F.col("_n") == F.col("name_code"), "left").drop("_g", "_n")
    resolved = resolve.reconcile_evidence(seen, "lang", "geo_code", "geo_group", "name_code", "name_group")
    gaz = ranking.first_value(places, ["name_key", "group_key"], F.col("page_id"), ["page_id"]).select("name_key", "group_key", F.col("page_id").alias("code"), F.col("page_id").alias("place"))
    unplaced = docs.join(resolved.filter("code is null").select("doc_id"), "doc_id", "left_semi").select("doc_id", "lang", T.normalise_key("text", "ascii").alias("blob"))
    hits = resolve.gazetteer_match(unplaced, gaz, "doc_id", "lang", ["blob"])
    return resolve.with_gazetteer(resolved, hits, "doc_id").select("doc_id", "basis", "code", "resolved")


@query("E3_forecast_to_views", f"""with {FORECAST},
st as (select horizon_days, band, avg(y) as realised_rate from hb group by 1, 2)
select area, n_name as name, r_name as region, horizon_days, round(probability, 6) as probability, fc.band, rank, round(realised_rate, 6) as realised_rate
from fc left join st using (horizon_days, band) join nation on n_nationkey = area join region on n_regionkey = r_regionkey""")
def _(spark, sf):
    """Scores to bands and ranks per horizon, each row with its tier's measured rate and its names: the table that a viewer reads."""
    profile = bands.band_profile(horizon_bands(spark, sf), ["horizon_days"])
    served = serve.with_tier_rate(forecast(spark, sf), profile)
    regions = table(spark, sf, "region").select(F.col("r_regionkey").alias("grp"), F.col("r_name").alias("region"))
    named = serve.decorate(served, areas(spark, sf).join(regions, "grp"), "area", ["name", "region"])
    return named.select("area", "name", "region", "horizon_days", r("probability").alias("probability"), "band", F.col("rank").cast("long").alias("rank"), r("realised_rate").alias("realised_rate"))


@query("A36_run_metadata", f"""with {FORECAST},
mx as (select max(week) as newest from dense)
select horizon_days, count(distinct week) filter (t > m - 52) as anchor_weeks, min(week) filter (t > m - 52) as anchor_from, max(week) as newest_labelled, cast(max(week) + horizon_days as date) as window_end,
  count(distinct week) as training_weeks, round(avg(y) filter (t > m - 52), 6) as anchor_rate, (select count(*) from ev where week > (select newest from mx) - 91) as volume_13w
from hs group by horizon_days""")
def _(spark, sf):
    """One row per horizon: the weeks behind its anchor, the weeks with a whole label, the end of the forecast window, the recent record volume."""
    h = horizon_labels(spark, sf)
    anchor = F.col("t") > F.col("last_t") - bands.ANCHOR_WEEKS
    ev = events(spark, sf)
    newest = ev.select(F.max("week")).scalar()
    volume = ev.filter(F.col("week") > F.date_sub(newest, 91)).select(F.count(F.lit(1))).scalar()
    found = h.groupBy("horizon_days").agg(
        F.countDistinct(F.when(anchor, F.col("week"))).alias("anchor_weeks"), F.min(F.when(anchor, F.col("week"))).alias("anchor_from"), F.max("week").alias("newest_labelled"),
        F.countDistinct("week").alias("training_weeks"), F.avg(F.when(anchor, F.col("y"))).alias("anchor_rate"),
    )
    return found.select("horizon_days", "anchor_weeks", "anchor_from", "newest_labelled", F.date_add("newest_labelled", F.col("horizon_days")).alias("window_end"), "training_weeks", r("anchor_rate").alias("anchor_rate"), volume.alias("volume_13w"))
