"""Metric, band, recapture and statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from risklattice.functions.scalar import percent_text, to_day, to_number
from risklattice.operators import bands, context, metrics, quality, ranking, recapture, serve, stats
from risklattice.operators import panel as P
from risklattice.plans.base import CELLS, DENSE, EV, SCORES, TALL, areas, dense_events, events, query, r, scores, table, tall_scores

K = 5


@query("A18_A19_ranking_quality", f"""with {CELLS}
select model, cast(sum(n) as bigint) as rows, cast(sum(tp) as bigint) as positives, round(sum(tp)::double / sum(n), 6) as base_rate,
  round(sum(tp::double / p * cum_tp / cum_n), 6) as average_precision,
  round(sum(tp * ((all_n - p) - (cum_n - cum_tp) + 0.5 * (n - tp))) / (any_value(p)::double * any_value(all_n - p)), 6) as roc_auc
from cells group by model""")
def _(spark, sf):
    q = metrics.ranking_quality(tall_scores(spark, sf), ["model"])
    return q.withColumns({c: r(c) for c in ("base_rate", "average_precision", "roc_auc")})


@query("A20_roc_points", f"with {CELLS} select model, score as threshold, round(cum_tp::double / p, 6) as tpr, round((cum_n - cum_tp)::double / (all_n - p), 6) as fpr from cells")
def _(spark, sf):
    return metrics.roc_points(tall_scores(spark, sf), ["model"]).withColumns({"tpr": r("tpr"), "fpr": r("fpr")})


@query("A18_quality_by_customer", """
with s as (select c_custkey as area, c_acctbal / 10000 as score, count(o_orderkey) filter (o_orderpriority = '1-URGENT') > 1 as hit, c_mktsegment as model
  from customer left join orders on o_custkey = c_custkey group by all),
c0 as (select model, score, sum(hit::int) as tp, count(*) as n from s group by all),
c as (select *, sum(tp) over w as cum_tp, sum(n) over w as cum_n, sum(tp) over (partition by model) as p, sum(n) over (partition by model) as all_n from c0 window w as (partition by model order by score desc))
select model, round(sum(tp::double / p * cum_tp / cum_n), 6) as average_precision,
  round(sum(tp * ((all_n - p) - (cum_n - cum_tp) + 0.5 * (n - tp))) / (any_value(p)::double * any_value(all_n - p)), 6) as roc_auc
from c group by model""")
def _(spark, sf):
    """Nearly every score is distinct and some are negative: the pieces of the score axis do the work."""
    hits = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("hits"))
    s = table(spark, sf, "customer").join(hits, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.col("c_mktsegment").alias("model"), (F.col("c_acctbal") / 10000).alias("score"), (F.coalesce("hits", F.lit(0)) > 1).cast("int").alias("y")
    )
    return metrics.ranking_quality(s, ["model"]).select("model", r("average_precision").alias("average_precision"), r("roc_auc").alias("roc_auc"))


@query("A21_brier", f"with {TALL} select model, round(avg(power(y - least(greatest(score, 0), 1), 2)), 6) as brier from tall group by model")
def _(spark, sf):
    return tall_scores(spark, sf).groupBy("model").agg(r(metrics.brier(F.col("score"), F.col("y"))).alias("brier"))


TOP = TALL + f""",
ranked as (select *, row_number() over (partition by model, week order by score desc, area) as rk from tall),
caught as (select model, cast(sum(y) filter (rk <= {K}) as bigint) as hits, cast(sum(y) as bigint) as positives, count(*) as rows,
  count(*) filter (rk <= {K}) as flagged, count(distinct area) as areas from ranked group by model)"""


@query("A22_A23_recall_at_k", f"with {TOP} select model, hits, positives, round(hits::double / positives, 6) as recall_at_k, round(hits::double / positives / ({K}.0 / areas), 6) as lift_at_k from caught")
def _(spark, sf):
    return metrics.recall_at_k(tall_scores(spark, sf), ["model"], K).withColumns({"recall_at_k": r("recall_at_k"), "lift_at_k": r("lift_at_k")})


@query("A24_confusion", f"with {TOP} select model, hits as tp, flagged - hits as fp, positives - hits as fn, rows - flagged - positives + hits as tn, round(hits::double / flagged, 6) as precision, round(hits::double / positives, 6) as recall from caught")
def _(spark, sf):
    return metrics.confusion_at_k(tall_scores(spark, sf), ["model"], K).withColumns({"precision": r("precision"), "recall": r("recall")})


@query("A26_catch_comparison", f"with {TOP} select model, hits, positives, hits - (select hits from caught where model = 'long_run') as extra from caught")
def _(spark, sf):
    return metrics.catch_comparison(scores(spark, sf), ["recency", "long_run"], K, "long_run")


@query("W13_weekly_flag", f"with {TOP} select model, week, area, rk as rank, rk <= {K} as flagged from ranked")
def _(spark, sf):
    out = metrics.weekly_flag(tall_scores(spark, sf), K, keys=["model"])
    return out.select("model", "week", "area", F.col("rank").cast("long").alias("rank"), "flagged")


@query("A25_calibration", f"with {TALL}, e as (select model, list_distinct(quantile_cont(score, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) as edges from tall group by model), b as (select t.*, len([x for x in list_sort(edges)[2:-2] if x < score]) as bin from tall t join e on e.model = t.model) select model, cast(bin as integer) as bin, count(*) as rows, round(avg(score), 6) as predicted, round(avg(y), 6) as observed from b group by model, bin")
def _(spark, sf):
    out = metrics.calibration(tall_scores(spark, sf), ["model"])
    return out.select("model", "bin", "rows", r("predicted").alias("predicted"), r("observed").alias("observed"))


@query("A27_severity_error", f"with {DENSE}, p as (select *, coalesce(sum(events) over (partition by area order by t rows between 4 preceding and 1 preceding), 0) / 4 as mu from dense) select count(*) as rows, round(avg(events), 6) as mean_observed, round(avg(mu), 6) as mean_predicted, round(avg(abs(events - mu)), 6) as mae_model, round(avg(abs(events - 1)), 6) as mae_constant from p where events > 0")
def _(spark, sf):
    d = dense_events(spark, sf).withColumn("mu", P.rolling_sum("events", 4) / 4).filter("events > 0")
    out = metrics.severity_error(d, "events", "mu")
    return out.select("rows", *[r(c).alias(c) for c in out.columns[1:]])


def fold_metrics(spark, sf):
    """Recall and base rate of both rankers by fold of 52 weeks."""
    tall = tall_scores(spark, sf)
    last = tall.select(F.max("t")).scalar()
    folded = bands.with_fold(tall, last).filter("fold is not null")
    return metrics.recall_at_k(folded, ["model", "fold"], K).select("model", "fold", "hits", "positives", "recall_at_k")


FOLDED = TALL + f""",
folded as (
  select *, cast(5 - floor(((select max(t) from tall) - t) / 52) as integer) as fold from tall
  where (select max(t) from tall) - t < 260),
fr as (select *, row_number() over (partition by model, week order by score desc, area) as rk from folded),
fm as (select model, fold, cast(sum(y) filter (rk <= {K}) as bigint) as hits, cast(sum(y) as bigint) as positives,
  sum(y) filter (rk <= {K})::double / sum(y) as recall_at_k from fr group by model, fold)"""


@query("M1_fold_metrics", f"with {FOLDED} select model, fold, hits, positives, round(recall_at_k, 6) as recall_at_k from fm")
def _(spark, sf):
    return fold_metrics(spark, sf).withColumn("recall_at_k", r("recall_at_k"))


@query("M1_folds", f"with {FOLDED} select fold, min(t) as test_start, max(t) as test_end, count(distinct week) as weeks, count(*) as rows from folded group by fold")
def _(spark, sf):
    tall = tall_scores(spark, sf)
    folded = bands.with_fold(tall, tall.select(F.max("t")).scalar()).filter("fold is not null")
    return folded.groupBy("fold").agg(F.min("t").cast("long").alias("test_start"), F.max("t").cast("long").alias("test_end"), F.countDistinct("week").alias("weeks"), F.count(F.lit(1)).alias("rows"))


@query("A17_macro_average", f"with {FOLDED} select model, round(avg(recall_at_k), 6) as recall_at_k, count(*) as folds from fm group by model")
def _(spark, sf):
    return metrics.macro_average(fold_metrics(spark, sf), ["model"], ["recall_at_k"]).withColumn("recall_at_k", r("recall_at_k"))


@query("A37_head_to_head", f"with {FOLDED}, w as (select x.recall_at_k - z.recall_at_k as gap from fm x join fm z on x.fold = z.fold where x.model = 'recency' and z.model = 'long_run') select count(*) filter (gap > 0) as wins, count(*) filter (gap < 0) as losses, round(min(gap), 6) as smallest_margin, round(max(gap), 6) as largest_margin from w")
def _(spark, sf):
    out = metrics.head_to_head(fold_metrics(spark, sf), "recall_at_k", "recency", "long_run")
    return out.withColumns({c: r(c) for c in ("smallest_margin", "largest_margin")})


@query("A37_range_within_fold", f"with {FOLDED} select fold, round(max(recall_at_k) - min(recall_at_k), 6) as range_in_fold, arg_max(model, (recall_at_k, model)) as best from fm group by fold")
def _(spark, sf):
    return metrics.range_within(fold_metrics(spark, sf), "fold", "recall_at_k").withColumn("range_in_fold", r("range_in_fold"))


@query("A37_metric_ranges", f"with {FOLDED}, b as (select fold, arg_max(model, (recall_at_k, model)) as best from fm group by fold) select model, round(max(recall_at_k) - min(recall_at_k), 6) as range_over_folds, (select count(*) from b where best = fm.model) as folds_led from fm group by model")
def _(spark, sf):
    return metrics.metric_ranges(fold_metrics(spark, sf), "recall_at_k").withColumn("range_over_folds", r("range_over_folds"))


# ---- bands: the long-run ranker against a quarter of each fold's base rate, so that all bands occur

ANCHORS = TALL + """,
lastt as (select max(t) as m from tall),
one as (select t, y from tall where model = 'long_run'),
fs as (select f as fold, (select m from lastt) + 1 - (6 - f) * 52 as s from (select unnest([1, 2, 3, 4, 5]) as f)),
ank as (
  select fold, avg(y) filter (t > (select m from lastt) - 260) as evaluation, avg(y) filter (t < s) as training,
         avg(y) filter (t < s and t >= s - 52) as recent
  from fs cross join one group by fold)"""


def anchor_tables(spark, sf):
    s = scores(spark, sf).select("t", "y")
    last = s.select(F.max("t")).scalar()
    return {k: bands.anchors(s, k, last) for k in ("evaluation", "training", "recent")}


@query("W14_anchors", f"with {ANCHORS} select fold, 'evaluation' as kind, round(evaluation, 6) as anchor_rate from ank where evaluation is not null union all select fold, 'training', round(training, 6) from ank where training is not null union all select fold, 'recent', round(recent, 6) from ank where recent is not null")
def _(spark, sf):
    out = None
    for kind, a in anchor_tables(spark, sf).items():
        part = a.select(F.col("fold").cast("int").alias("fold"), F.lit(kind).alias("kind"), r("anchor_rate").alias("anchor_rate"))
        out = part if out is None else out.unionByName(part)
    return out


BANDED = ANCHORS + """,
ws as (
  select area, week, t, y, recency as score, cast(5 - floor(((select m from lastt) - t) / 52) as integer) as fold from scores
  where (select m from lastt) - t < 260),
bd as (
  select ws.*, case when score >= recent * 8 then 'Severe' when score >= recent * 4 then 'High' when score >= recent * 2 then 'Elevated' else 'Low' end as band
  from ws join ank using (fold) where recent is not null)"""


def banded(spark, sf):
    """Weekly bands of the recency ranker against each fold's recent base rate."""
    s = scores(spark, sf)
    last = s.select(F.max("t")).scalar()
    folded = bands.with_fold(s, last).filter("fold is not null").withColumn("score", F.col("recency"))
    return folded.join(bands.anchors(s, "recent", last), "fold").withColumn("band", bands.band_of(F.col("score"), F.col("anchor_rate")))


@query("M12_bands", f"with {BANDED} select area, week, fold, band from bd")
def _(spark, sf):
    return banded(spark, sf).select("area", "week", "fold", "band")


@query("A28_band_profile", f"""with {BANDED}, l as (select unnest(['Severe', 'High', 'Elevated', 'Low']) as band),
k as (select l.band, count(bd.area) as n, sum(y) as pos, count(distinct bd.area) as ever from l left join bd using (band) group by 1),
a as (select count(*) as n, sum(y) as pos, count(distinct week) as w from bd)
select band, round(k.n::double / w, 6) as areas_per_week, round(k.pos::double / nullif(k.n, 0), 6) as realised_rate, round((k.pos::double / nullif(k.n, 0)) / (a.pos::double / a.n), 6) as times_base, case when k.n > 0 then round(k.pos::double / a.pos, 6) end as share_of_events, ever as areas_ever from k cross join a""")
def _(spark, sf):
    out = bands.band_profile(banded(spark, sf))
    return out.withColumns({c: r(c) for c in ("areas_per_week", "realised_rate", "times_base", "share_of_events")})


@query("M13_band_audit", f"with {ANCHORS}, long as (unpivot ank on evaluation, training, recent into name anchor value rate), ws as (select area, week, y, recency as score, cast(5 - floor(((select m from lastt) - t) / 52) as integer) as fold from scores where (select m from lastt) - t < 260), b as (select anchor, ws.fold, y, case when score >= rate * 8 then 'Severe' when score >= rate * 4 then 'High' when score >= rate * 2 then 'Elevated' else 'Low' end as band from ws join long on long.fold = ws.fold where rate is not null), g as (select anchor, fold, count(*) filter (band = 'Severe') as severe, count(*) filter (band = 'High') as high, count(*) filter (band = 'Elevated') as elevated, count(*) filter (band = 'Low') as low, round(avg((band = 'Low')::int), 6) as low_share, cast(sum(y) as bigint) as positives from b group by 1, 2) select *, cast((severe = 0)::int + (high = 0)::int + (elevated = 0)::int + (low = 0)::int as integer) as empty_bands from g")
def _(spark, sf):
    s = scores(spark, sf)
    folded = bands.with_fold(s, s.select(F.max("t")).scalar()).filter("fold is not null").withColumn("score", F.col("recency"))
    return bands.band_audit(folded, anchor_tables(spark, sf)).withColumn("low_share", r("low_share"))


HORIZONS = DENSE + """,
hz as (
  select area, week, t, 7 as horizon_days, case when events > 0 then 1 else 0 end as y from dense
  union all select area, week, t, 14, max(case when events > 0 then 1 else 0 end) over (partition by area order by t rows between current row and 1 following) from dense qualify t <= (select max(t) - 1 from dense)
  union all select area, week, t, 28, max(case when events > 0 then 1 else 0 end) over (partition by area order by t rows between current row and 3 following) from dense qualify t <= (select max(t) - 3 from dense)),
rc as (select area, week, coalesce(sum(events) over (partition by area order by t rows between 4 preceding and 1 preceding), 0) as score from dense),
hs as (select hz.*, rc.score, max(t) over (partition by horizon_days) as m from hz join rc using (area, week)),
hf as (select *, cast(5 - floor((m - t) / 52) as integer) as fold from hs where m - t < 260),
ha as (
  select h.horizon_days, f.fold, avg(y) as anchor_rate
  from hs h join (select unnest([1, 2, 3, 4, 5]) as fold) f
    on h.t < h.m + 1 - (6 - f.fold) * 52 and h.t >= h.m + 1 - (6 - f.fold) * 52 - 52 group by all),
hb as (
  select hf.*, case when score >= anchor_rate * 8 then 'Severe' when score >= anchor_rate * 4 then 'High' when score >= anchor_rate * 2 then 'Elevated' else 'Low' end as band
  from hf join ha using (horizon_days, fold))"""


def horizon_labels(spark, sf):
    """Each modelled row with its label at 7, 14 and 28 days; cut-off forward windows are dropped."""
    d = dense_events(spark, sf)
    last = events(spark, sf).select(F.floor(F.datediff(F.max("week"), F.min("week")) / 7)).scalar()
    d = d.withColumns({"score": P.rolling_sum("events", 4)} | {f"y{h}": P.forward_label("events", h) for h in (1, 2, 4)})
    per = [F.struct(F.lit(7 * h).alias("horizon_days"), F.col(f"y{h}").alias("y"), (last - (h - 1)).alias("last_t")) for h in (1, 2, 4)]
    return d.select("area", "week", "t", "score", F.explode(F.array(*per)).alias("h")).select("area", "week", "t", "score", "h.*").filter("t <= last_t")


def horizon_bands(spark, sf):
    h = horizon_labels(spark, sf)
    anchors = bands.anchors(h, "recent", F.col("last_t"), keys=("horizon_days", "last_t"))
    tagged = bands.with_fold(h, F.col("last_t")).filter("fold is not null")
    return tagged.join(anchors, ["horizon_days", "last_t", "fold"]).withColumn("band", bands.band_of(F.col("score"), F.col("anchor_rate")))


@query("M14_band_validation", f"""with {HORIZONS}, l as (select horizon_days, band from (select unnest([7, 14, 28]) as horizon_days) cross join (select unnest(['Severe', 'High', 'Elevated', 'Low']) as band)),
k as (select l.*, count(hb.area) as n, sum(y) as pos, count(distinct hb.area) as ever from l left join hb using (horizon_days, band) group by 1, 2),
a as (select horizon_days, count(*) as n, sum(y) as pos, count(distinct week) as w from hb group by 1)
select horizon_days, band, round(k.n::double / w, 6) as areas_per_week, round(k.pos::double / nullif(k.n, 0), 6) as realised_rate, round((k.pos::double / nullif(k.n, 0)) / (a.pos::double / a.n), 6) as times_base, case when k.n > 0 then round(k.pos::double / a.pos, 6) end as share_of_events, ever as areas_ever from k join a using (horizon_days)""")
def _(spark, sf):
    out = bands.band_profile(horizon_bands(spark, sf), ["horizon_days"])
    return out.withColumns({c: r(c) for c in ("areas_per_week", "realised_rate", "times_base", "share_of_events")})


@query("A29_pooled_rate", f"with {HORIZONS}, k as (select horizon_days, band, count(*)::double / (select count(distinct week) from hb z where z.horizon_days = hb.horizon_days) as a, avg(y) as r from hb group by 1, 2) select horizon_days, round(sum(a * r) / sum(a), 6) as pooled_rate, case when sum(a * r) / sum(a) * 100 < 10 then printf('%.1f%%', sum(a * r) / sum(a) * 100) else printf('%.0f%%', sum(a * r) / sum(a) * 100) end as shown from k where band <> 'Low' group by 1")
def _(spark, sf):
    profile = bands.band_profile(horizon_bands(spark, sf), ["horizon_days"]).filter("band <> 'Low'")
    pooled = bands.pooled_rate(profile, ["horizon_days"])
    return pooled.select("horizon_days", r("pooled_rate").alias("pooled_rate"), percent_text(F.col("pooled_rate")).alias("shown"))


MOVES = BANDED + ", mv as (select *, lag(band) over (partition by area order by t) as previous_band from bd)"


@query("W11_stability", f"with {MOVES} select round(avg((band = previous_band)::int), 6) as unchanged_share, round(sum(case when band <> previous_band then y else 0 end)::double / sum(y), 6) as events_in_moves from mv where previous_band is not null")
def _(spark, sf):
    out = bands.stability(banded(spark, sf))
    return out.select(*[r(c).alias(c) for c in out.columns])


@query("W11_transitions", f"with {MOVES} select previous_band, band, count(*) as n, round(count(*)::double / sum(count(*)) over (partition by previous_band), 6) as share from mv where previous_band is not null group by 1, 2")
def _(spark, sf):
    return bands.transitions(banded(spark, sf)).withColumn("share", r("share"))


@query("A8_crosstab", f"with {BANDED} select fold, count(*) filter (band = 'Severe') as Severe, count(*) filter (band = 'High') as High, count(*) filter (band = 'Elevated') as Elevated, count(*) filter (band = 'Low') as Low from bd group by fold")
def _(spark, sf):
    return stats.pivot_count(banded(spark, sf), "fold", "band", bands.BANDS)


@query("W15_comparable_anchor", f"""with {DENSE}, n as (select k.week, count(ev.event_id) as n from weeks k left join ev on ev.week = k.week group by 1),
v as (select a.week, a.t, coalesce((select sum(n) from n where n.week between a.week - 91 and a.week - 7), 0)::double as volume from weeks a),
ref as (select sum(n)::double as v from n where week > (select max(week) - 91 from n)),
w as (select v.week, volume, sum((events > 0)::int) as positives, count(*) as rows from v join dense using (week) group by 1, 2),
m as (select *, row_number() over (order by week desc) as age, sum(case when volume between v / 2 and v * 2 then 0 else 1 end) over (order by week desc) as breaks from w cross join ref)
select round(coalesce(sum(positives) filter (breaks = 0 and age <= 52)::double / sum(rows) filter (breaks = 0 and age <= 52), sum(positives) filter (age <= 52)::double / sum(rows) filter (age <= 52)), 6) as anchor_rate,
  case when count(*) filter (breaks = 0 and age <= 52) > 0 then count(*) filter (breaks = 0 and age <= 52) else count(*) filter (age <= 52) end as weeks,
  coalesce(min(week) filter (breaks = 0 and age <= 52), min(week) filter (age <= 52)) as first_week,
  count(*) filter (breaks = 0 and age <= 52) > 0 as comparable from m""")
def _(spark, sf):
    ev = events(spark, sf)
    volume = P.record_volume(ev.select("week"))
    d = dense_events(spark, sf)
    weekly = d.groupBy("week").agg(F.count_if(F.col("events") > 0).alias("positives"), F.count(F.lit(1)).alias("rows"))
    weekly = weekly.join(volume.withColumnRenamed("cov_records_13w", "volume"), "week", "left").na.fill(0.0, ["volume"])
    next_week = ev.select(F.date_add(F.max("week"), 7)).scalar()
    reference = volume.filter(F.col("week") == next_week).select("cov_records_13w").scalar()
    return bands.comparable_anchor(weekly, reference).withColumn("anchor_rate", r("anchor_rate"))


# A forecast table: each area's last modelled week at three horizons, scored by its 4-week count.
FORECAST = HORIZONS + """,
fa as (select horizon_days, avg(y) as anchor_rate from hs where t > m - 52 group by 1),
fc0 as (select area, horizon_days, score * horizon_days / 28 as probability, anchor_rate from hs join fa using (horizon_days) where t = m),
fc as (
  select *, case when probability >= anchor_rate * 8 then 'Severe' when probability >= anchor_rate * 4 then 'High' when probability >= anchor_rate * 2 then 'Elevated' else 'Low' end as band,
    row_number() over (partition by horizon_days order by probability desc, area) as rank from fc0)"""


def forecast(spark, sf):
    h = horizon_labels(spark, sf)
    rates = h.filter(F.col("t") > F.col("last_t") - 52).groupBy("horizon_days").agg(F.avg("y").alias("anchor_rate"))
    f = h.filter("t = last_t").join(rates, "horizon_days").withColumn("probability", F.col("score") * F.col("horizon_days") / 28)
    f = f.withColumn("band", bands.band_of(F.col("probability"), F.col("anchor_rate")))
    return serve.ranked_by_horizon(f).select("area", "horizon_days", "probability", "anchor_rate", "band", "rank")


@query("W12_rank_in_horizon", f"with {FORECAST} select area, horizon_days, round(probability, 6) as probability, band, rank from fc")
def _(spark, sf):
    return forecast(spark, sf).select("area", "horizon_days", r("probability").alias("probability"), "band", F.col("rank").cast("long").alias("rank"))


@query("A36_tier_summary", f"with {FORECAST} select horizon_days, count(*) filter (band = 'Severe') as n_severe, count(*) filter (band = 'High') as n_high, count(*) filter (band = 'Elevated') as n_elevated, count(*) filter (band = 'Low') as n_low, count(*) as areas, round(any_value(anchor_rate), 6) as anchor_rate, round(any_value(anchor_rate) * 8, 6) as cut_severe, round(any_value(anchor_rate) * 4, 6) as cut_high, round(any_value(anchor_rate) * 2, 6) as cut_elevated from fc group by 1")
def _(spark, sf):
    f = forecast(spark, sf)
    out = bands.tier_summary(f, f.select("horizon_days", "anchor_rate").distinct())
    return out.withColumns({c: r(c) for c in ("anchor_rate", "cut_severe", "cut_high", "cut_elevated")})


@query("J22_tier_rate", f"with {FORECAST}, st as (select horizon_days, band, avg(y) as realised_rate from hb group by 1, 2) select area, horizon_days, fc.band, round(realised_rate, 6) as realised_rate from fc left join st using (horizon_days, band)")
def _(spark, sf):
    profile = bands.band_profile(horizon_bands(spark, sf), ["horizon_days"])
    return serve.with_tier_rate(forecast(spark, sf), profile).select("area", "horizon_days", "band", r("realised_rate").alias("realised_rate"))


@query("U6_band_shift", f"with {FORECAST}, w as (select area, max(band) filter (horizon_days = 7) as band_7, max(band) filter (horizon_days = 14) as band_14, max(band) filter (horizon_days = 28) as band_28, max(rank) filter (horizon_days = 7) as rank_7, max(rank) filter (horizon_days = 28) as rank_28 from fc group by 1), o as (select *, list_position(['Low', 'Elevated', 'High', 'Severe'], band_7) as a, list_position(['Low', 'Elevated', 'High', 'Severe'], band_28) as b from w) select area, band_7, band_14, band_28, rank_7, rank_28, case when b > a then 'rises by 28 days' else 'falls by 28 days' end as direction from o where a <> b")
def _(spark, sf):
    out = serve.band_shift(forecast(spark, sf), ["area"])
    return out.select("area", "band_7", "band_14", "band_28", *[F.col(c).cast("long").alias(c) for c in ("rank_7", "rank_28")], "direction")


@query("J19_map_layer", f"with {FORECAST} select n_nationkey as area, n_name as name, band, rank from nation left join fc on area = n_nationkey and horizon_days = 14")
def _(spark, sf):
    f = serve.choose(forecast(spark, sf), horizon_days=14)
    return serve.map_layer(areas(spark, sf).select("area", "name"), f, "area").select("area", "name", "band", F.col("rank").cast("long").alias("rank"))


@query("J19_unmatched_areas", "select c_custkey as area, 'no forecast' as problem from customer where c_custkey not in (select o_custkey from orders) union all select distinct o_custkey, 'no area' from orders where o_custkey not in (select c_custkey from customer)")
def _(spark, sf):
    return serve.unmatched_areas(table(spark, sf, "customer").select(F.col("c_custkey").alias("area")), table(spark, sf, "orders").select(F.col("o_custkey").alias("area")), "area")


@query("P19_optional_filters", f"with {FORECAST} select area, horizon_days, band from fc where horizon_days = 28 and band in ('Elevated', 'High')")
def _(spark, sf):
    return serve.choose(forecast(spark, sf), horizon_days=28, band=["Elevated", "High"], area=[]).select("area", "horizon_days", "band")


@query("T3_first_rows", f"with {FORECAST} select area, round(probability, 6) as probability from fc where horizon_days = 7 order by rank limit 10")
def _(spark, sf):
    return serve.first_rows(serve.choose(forecast(spark, sf), horizon_days=7), ["rank"], 10).select("area", r("probability").alias("probability"))


@query("T4_selected_row", f"with {FORECAST} select area, band, rank from fc where horizon_days = 7 and area = 7")
def _(spark, sf):
    return serve.selected_or_first(serve.choose(forecast(spark, sf), horizon_days=7), "area", 7, ["rank"]).select("area", "band", F.col("rank").cast("long").alias("rank"))


# ---- capture-recapture of target events: orders of status O are one source, all others the main one

RECAPTURE = EV + """,
cells as (select area, grp, day, max((source <> 'O')::int) as a, max((source = 'O')::int) as b from ev where is_target group by 1, 2, 3),
det as (
  select grp, grouping(grp) as pooled, cast(sum(a) as bigint) as n_main, cast(sum(b) as bigint) as n_other, cast(sum(a * b) as bigint) as matched, count(*) as observed
  from cells group by rollup (grp)),
dd as (select *, (n_main + 1)::double * (n_other + 1) / (matched + 1) - 1 as estimate, matched >= 5 as reliable from det)"""


def two_sources(spark, sf):
    other = F.col("source") == "O"
    return events(spark, sf).filter("is_target").withColumn("source", F.when(other, "O").otherwise("F"))


@query("A30_detection", f"with {RECAPTURE} select grp, n_main, n_other, matched, observed, round(estimate, 4) as estimate, round(least(observed / estimate, 1), 6) as detection, reliable from dd")
def _(spark, sf):
    d = recapture.detection(two_sources(spark, sf), "F", "O", areas(spark, sf))
    return d.select("grp", "n_main", "n_other", "matched", "observed", r("estimate", 4).alias("estimate"), r("detection").alias("detection"), "reliable")


@query("A30_detection_tolerance", f"with {RECAPTURE}, m as (select c.*, (b = 1 and exists (select 1 from cells z where z.area = c.area and z.a = 1 and abs(z.day - c.day) <= 2))::int as hit from cells c) select grp, cast(sum(hit) as bigint) as matched, count(*) as observed, round(least(count(*) / ((sum(a) + 1)::double * (sum(b) + 1) / (sum(hit) + 1) - 1), 1), 6) as detection from m group by rollup (grp)")
def _(spark, sf):
    d = recapture.detection(two_sources(spark, sf), "F", "O", areas(spark, sf), days=2)
    return d.select("grp", "matched", "observed", r("detection").alias("detection"))


@query("A31_detection_weights", f"with {RECAPTURE}, o as (select grp, least(observed / estimate, 1) as d from dd where pooled = 0 and reliable), p as (select least(observed / estimate, 1) as d from dd where pooled = 1), w as (select n_nationkey as area, 1 / coalesce(o.d, p.d) as raw from nation left join o on o.grp = n_regionkey cross join p) select area, round(raw, 6) as raw_weight, round(raw / avg(raw) over (), 6) as weight from w")
def _(spark, sf):
    d = recapture.detection(two_sources(spark, sf), "F", "O", areas(spark, sf))
    return recapture.detection_weights(areas(spark, sf).select("area", "grp"), d).select("area", r("raw_weight").alias("raw_weight"), r("weight").alias("weight"))


@query("J16_shared_within", f"with {RECAPTURE} select area, day from cells c where a = 1 and exists (select 1 from cells z where z.area = c.area and z.b = 1 and abs(z.day - c.day) <= 1)")
def _(spark, sf):
    ev = two_sources(spark, sf)
    one = lambda s: ev.filter(F.col("source") == s).select("area", "day").distinct()
    return recapture.shared_within(one("F"), one("O"), 1)


@query("U3_cell_overlap", f"with {RECAPTURE} select count(*) filter (a = 1 and b = 1) as in_both, count(*) as in_either from cells")
def _(spark, sf):
    ev = two_sources(spark, sf)
    return recapture.cell_overlap(*[ev.filter(F.col("source") == s).select("area", "day") for s in ("F", "O")])


# ---- statistics

@query("A5_distinct_counts", f"with {EV} select grp, count(distinct area) as areas, count(distinct week) as weeks, count(distinct actor) as actors from ev group by 1")
def _(spark, sf):
    return events(spark, sf).groupBy("grp").agg(F.countDistinct("area").alias("areas"), F.countDistinct("week").alias("weeks"), F.countDistinct("actor").alias("actors"))


@query("A6_frequency", f"with {EV} select kind, count(*) as n, round(count(*)::double / sum(count(*)) over (), 6) as share from ev group by 1")
def _(spark, sf):
    return stats.frequency(events(spark, sf), ["kind"]).withColumn("share", r("share"))


@query("A7_year_pivot", f"with {EV} select cast(year(day) as integer) as year, count(*) filter (source = 'F') as F, count(*) filter (source = 'O') as O, count(*) filter (source = 'P') as P from ev group by 1")
def _(spark, sf):
    return stats.pivot_count(events(spark, sf).withColumn("year", F.year("day")), "year", "source", ["F", "O", "P"])


@query("A8_row_shares", f"with {EV} select grp, source, count(*) as n, round(count(*)::double / sum(count(*)) over (partition by grp), 6) as share from ev group by 1, 2")
def _(spark, sf):
    return stats.frequency(events(spark, sf), ["grp", "source"], ["grp"]).withColumn("share", r("share"))


@query("A9_two_level", f"with {EV} select grp, round(avg(v), 4) as mean_total from (select grp, week, sum(severity) as v from ev group by 1, 2) group by 1")
def _(spark, sf):
    return stats.two_level(events(spark, sf), ["grp"], "week", F.col("severity")).withColumn("mean_total", r("mean_total", 4))


@query("A10_quantile_bands", f"with {EV}, w as (select week, count(*) as n from ev group by 1), e as (select quantile_cont(n, [0, 0.25, 0.5, 0.75, 1.0]) as q from w) select b as band_no, count(*) as weeks, cast(sum(n) as bigint) as events from w cross join e cross join (select unnest([1, 2, 3, 4]) as b) where n >= q[b] and n <= q[b + 1] group by 1")
def _(spark, sf):
    weekly = events(spark, sf).groupBy("week").agg(F.count(F.lit(1)).alias("n"))
    banded_weeks = stats.quantile_bands(weekly, "n", [0, 0.25, 0.5, 0.75, 1.0], inclusive=True)
    return banded_weeks.groupBy("band_no").agg(F.count(F.lit(1)).alias("weeks"), F.sum("n").alias("events"))


@query("A10_exact_quantiles", "select l_returnflag as flag, round(quantile_cont(l_extendedprice, 0.1), 4) as q10, round(quantile_cont(l_extendedprice, 0.5), 4) as q50, round(quantile_cont(l_extendedprice, 0.99), 4) as q99 from lineitem group by 1")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    q = ranking.exact_quantiles(li, ["flag"], "l_extendedprice", [0.1, 0.5, 0.99])
    return q.select("flag", *[r(F.col("edges")[i], 4).alias(n) for i, n in enumerate(("q10", "q50", "q99"))])


CORRELATED = ["recency", "long_run", "events", "t"]
CORR = SCORES + ", cr as (unpivot (select corr(recency, y) as recency, corr(long_run, y) as long_run, corr(events, y) as events, corr(t, y) as t from scores) on recency, long_run, events, t into name feature value r)"


@query("A11_correlations", f"with {CORR} select feature, round(r, 6) as r from cr")
def _(spark, sf):
    return stats.correlations(scores(spark, sf), "y", CORRELATED).withColumn("r", r("r"))


@query("A11_strongest", f"with {CORR} select arg_max(feature, abs(r)) as feature, round(arg_max(r, abs(r)), 6) as r from cr")
def _(spark, sf):
    return stats.strongest(stats.correlations(scores(spark, sf), "y", CORRELATED), CORRELATED).withColumn("r", r("r"))


@query("A12_sparsity", f"with {DENSE} select unnest(['events', 'ops', 'taken']) as feature, unnest([round(avg((events = 0)::int), 6), round(avg((ops = 0)::int), 6), round(avg((taken = 0)::int), 6)]) as zero_share from dense")
def _(spark, sf):
    from risklattice.plans.base import dense

    return stats.sparsity(dense(spark, sf), ["events", "ops", "taken"]).withColumn("zero_share", r("zero_share"))


@query("A13_group_profile", f"with {SCORES} select grp, round(sum(events), 2) as events, round(avg(events), 6) as mean_observed, round(avg(long_run), 6) as mean_predicted, round(avg(long_run) / avg(events), 6) as predicted_to_observed from scores group by 1")
def _(spark, sf):
    out = stats.group_profile(scores(spark, sf), "grp", "events", "long_run")
    return out.select("grp", r("events", 2).alias("events"), *[r(c).alias(c) for c in out.columns[2:]])


@query("A14_concentration", f"with {EV}, g as (select actor, count(*) as n, row_number() over (order by count(*) desc, actor) as rk from ev group by 1) select 10 as top, round(sum(n) filter (rk <= 10)::double / sum(n), 6) as share from g union all select 100, round(sum(n) filter (rk <= 100)::double / sum(n), 6) from g")
def _(spark, sf):
    totals = events(spark, sf).groupBy("actor").agg(F.count(F.lit(1)).alias("n"))
    return stats.concentration(totals, "n", [10, 100], [F.col("n").desc(), F.col("actor")]).withColumn("share", r("share"))


@query("A15_subset_share", f"with {EV}, e as (select *, grp in (1, 2) as i from ev where day between date '1997-01-01' and date '1999-12-31') select round(avg(i::int), 6) as row_share, round(sum(severity) filter (i) / sum(severity), 6) as value_share, round(avg(severity) filter (i), 3) as mean_inside, round(avg(severity) filter (not i), 3) as mean_outside from e")
def _(spark, sf):
    e = events(spark, sf).filter(F.col("day").between("1997-01-01", "1999-12-31"))
    out = stats.subset_share(e, F.col("grp").isin(1, 2), F.col("severity"))
    return out.select(r("row_share").alias("row_share"), r("value_share").alias("value_share"), r("mean_inside", 3).alias("mean_inside"), r("mean_outside", 3).alias("mean_outside"))


@query("A16_mixed_sign", f"with {SCORES} select area, min(recency - 4 * long_run) as lowest, max(recency - 4 * long_run) as highest from scores group by 1 having min(recency - 4 * long_run) < 0 and max(recency - 4 * long_run) > 0".replace("min(recency - 4 * long_run) as", "round(min(recency - 4 * long_run), 6) as").replace("max(recency - 4 * long_run) as", "round(max(recency - 4 * long_run), 6) as"))
def _(spark, sf):
    s = scores(spark, sf).withColumn("swing", F.col("recency") - 4 * F.col("long_run"))
    return stats.mixed_sign(s, "area", "swing").withColumns({"lowest": r("lowest"), "highest": r("highest")})


@query("A38_reach", f"with {EV} select cast(year(day) as integer) as period, count(distinct actor) as areas_hit, count(*) as events, round(count(*)::double / count(distinct actor), 6) as events_per_area from ev group by 1")
def _(spark, sf):
    return stats.reach_by_period(events(spark, sf), F.year("day"), "actor").withColumn("events_per_area", r("events_per_area"))


@query("Q9_panel_summary", f"with {DENSE} select count(*) as rows, count(distinct area) as areas, count(distinct week) as weeks, count(*) filter (events > 0) as positive_rows, round(avg((events > 0)::int), 6) as positive_rate, count(distinct area) filter (events > 0) as areas_ever, round(count(*) filter (events = 1)::double / count(*) filter (events > 0), 6) as single_event_share, cast(max(events) as bigint) as largest from dense")
def _(spark, sf):
    return stats.panel_summary(dense_events(spark, sf)).withColumns({"positive_rate": r("positive_rate"), "single_event_share": r("single_event_share")})


@query("D4_time_since_last", "select event_id, user_id, round((epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id))) / 1e6, 3) as gap_seconds from events")
def _(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return stats.time_since_last(ev, "user_id", "ts", "event_id").select("event_id", "user_id", r("gap_seconds", 3).alias("gap_seconds"))


@query("D13_f1", f"with {SCORES} select grp, count(*) filter (long_run >= 0.4 and y = 1) as tp, count(*) filter (long_run >= 0.4 and y = 0) as fp, count(*) filter (long_run < 0.4 and y = 1) as fn, round(2.0 * count(*) filter (long_run >= 0.4 and y = 1) / (count(*) filter (long_run >= 0.4) + sum(y)), 6) as f1 from scores group by 1".replace("2.0 *", "2::double *"))
def _(spark, sf):
    out = context.f1_at(scores(spark, sf), 0.4, ["grp"], score="long_run")
    return out.select("grp", "tp", "fp", "fn", r("f1").alias("f1"))


@query("D13_spatial_holdout", f"with {SCORES} select area % 5 as fold, count(*) as rows, count(distinct area) as areas, cast(sum(y) as bigint) as positives from scores group by 1")
def _(spark, sf):
    s = scores(spark, sf).withColumn("fold", context.spatial_holdout(F.col("area"), 5, code=True))
    return s.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("area").alias("areas"), F.sum(F.col("y").cast("long")).alias("positives"))
