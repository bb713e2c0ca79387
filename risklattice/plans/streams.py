"""Streaming queries: the events table replayed as a file stream and drained once."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from risklattice.plans.base import query, r, table
from risklattice.session import scratch_path
from risklattice.sources.contracts import FEATURES_WEEKLY, KEYS, conform, read_current
from risklattice.streaming import weekly

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MESSAGE = "event_id long, user_id long, event_type string, value double, ts timestamp"


FEATURE_NAMES = [part.split()[0] for part in FEATURES_WEEKLY.split(", ")]
FILES_A_BATCH = 8  # intake limit: bounds what one key can bring in one micro-batch


def stream(spark, sf) -> DataFrame:
    schema = table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", FILES_A_BATCH).parquet(sf)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def drain_append(df: DataFrame, label: str) -> DataFrame:
    """Run an append stream to its end into a fresh folder and read it back."""
    spark = df.sparkSession
    out = scratch_path(spark, label)
    run = df.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/progress").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/rows")


def drain_upsert(df: DataFrame, keys: list[str], label: str, partition: str | None = None) -> DataFrame:
    spark = df.sparkSession
    out = scratch_path(spark, label)
    weekly.start_upsert(df, f"{out}/rows", f"{out}/progress", keys, partition=partition).awaitTermination()
    return read_current(spark, f"{out}/rows")


@query("D1_stream_unique_events", "select event_id, user_id, event_type, value from events")
def _(spark, sf):
    messages = stream(spark, sf).select(F.to_json(F.struct("event_id", "user_id", "event_type", "value", "ts")).alias("value"))
    parsed = weekly.parse_events(messages, MESSAGE)
    return drain_append(weekly.unique_events(parsed, "event_id", "ts").select("event_id", "user_id", "event_type", "value"), "unique")


@query("D2_stream_weekly_features", """
select cast(user_id % 25 as varchar) as lga_id, cast(date_trunc('week', ts) as date) as week_start, cast(count(*) as integer) as incident_count_7d,
  bool_or(event_type = 'click') as military_ops_flag, round(avg(value), 4) as sentiment_score, cast(count(*) filter (value > 50) as integer) as entity_mentions
from events group by 1, 2""")
def _(spark, sf):
    """Users stand for areas. Rows follow the declared contract of the weekly feature table; columns that no stream fills are null."""
    events = stream(spark, sf).withWatermark("ts", weekly.LATENESS).withColumn("lga_id", (F.col("user_id") % 25).cast("string"))
    measures = {
        "incident_count_7d": F.count(F.lit(1)), "military_ops_flag": F.max(F.col("event_type") == "click"),
        "sentiment_score": F.avg("value"), "entity_mentions": F.count_if(F.col("value") > 50),
    }
    counts = conform(weekly.weekly_counts(events, "ts", ["lga_id"], measures).withColumnRenamed("week", "week_start"), FEATURES_WEEKLY)
    out = drain_upsert(counts, KEYS["features_weekly"], "weekly", "week_start")
    return out.select("lga_id", "week_start", "incident_count_7d", "military_ops_flag", r("sentiment_score", 4).alias("sentiment_score"), "entity_mentions")


def weekly_measures(spark, sf, events):
    """Own-area measures; an event's actor is known by its static weight, the share of suppliers of its region."""
    regions = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("actor")).agg(F.count(F.lit(1)).alias("n"))
    actors = regions.select("actor", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias("centrality"))  # a row a region
    known = events.withColumns({"lga_id": (F.col("user_id") % 25).cast("string"), "actor": (F.col("event_id") % 7).cast("int")}).join(actors, "actor", "left")
    measures = {
        "incident_count_7d": F.count(F.lit(1)), "actor_centrality": F.max("centrality"), "military_ops_flag": F.max(F.col("event_type") == "click"),
        "ransom": F.max(F.col("event_type") == "purchase"), "sentiment_score": F.avg("value"), "entity_mentions": F.count_if(F.col("value") > 50),
    }
    return weekly.weekly_counts(known, "ts", ["lga_id"], measures).withColumnRenamed("week", "week_start")


def surroundings(spark, sf):
    """Areas of one region are neighbours; days whose events are worth far more than the average day's are festivals."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("lga_id"), F.col("n_regionkey").alias("g"))
    edges = n.join(n.select(F.col("lga_id").alias("near"), "g"), "g").filter("lga_id <> near").select("lga_id", "near")
    days = table(spark, sf, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.sum("value").alias("v"))
    return edges, days.filter(F.col("v") > 1.1 * days.select(F.avg("v")).scalar()).select("day")


@query("D2_stream_contract", """
with a as (select n_regionkey as actor, count(*)::double / sum(count(*)) over () as centrality from supplier join nation on s_nationkey = n_nationkey group by 1),
base as (
  select cast(user_id % 25 as varchar) as lga_id, cast(date_trunc('week', ts) as date) as week_start, cast(count(*) as integer) as incident_count_7d, max(centrality) as actor_centrality,
    bool_or(event_type = 'click') as military_ops_flag, bool_or(event_type = 'purchase') as ransom, avg(value) as sentiment_score, cast(count(*) filter (value > 50) as integer) as entity_mentions
  from events left join a on actor = event_id % 7 group by 1, 2),
n as (select cast(n_nationkey as varchar) as lga_id, n_regionkey as g from nation),
e as (select x.lga_id, y.lga_id as near from n x join n y on x.g = y.g and x.lga_id <> y.lga_id),
days as (select cast(ts as date) as day, sum(value) as v from events group by 1),
fest as (select distinct cast(date_trunc('week', day) as date) as week_start from days where v > (select 1.1::double * avg(v) from days)),
near as (
  select e.lga_id, b.week_start + 7 * k as week_start, bool_or(ransom) as ransom, sum(case when k = 1 then incident_count_7d end) as lag
  from base b join e on e.near = b.lga_id cross join (select unnest([0, 1]) as k) group by 1, 2)
select b.lga_id, b.week_start, b.incident_count_7d, round(b.actor_centrality, 6) as actor_centrality, b.week_start in (select week_start from fest) as festival_flag, b.military_ops_flag,
  coalesce(near.ransom, false) as ransom_payment_nearby, round(b.sentiment_score, 4) as sentiment_score,
  round(coalesce(lag / (select count(*) from e where e.lga_id = b.lga_id), 0), 6) as spatial_lag_risk, b.entity_mentions,
  case when b.week_start < (select max(week_start) from base) then case when f.lga_id is null then 0.0::double else 1.0::double end end as incident_prob_7d
from base b left join near on near.lga_id = b.lga_id and near.week_start = b.week_start left join base f on f.lga_id = b.lga_id and f.week_start = b.week_start + 7""")
def _(spark, sf):
    """The whole contract of the weekly feature table, kept by a stream in several micro-batches."""
    root = scratch_path(spark, "contract")
    spread = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    spread.repartitionByRange(3, "ts").write.parquet(f"{root}/in")
    raw = spark.readStream.schema(spread.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    # Files come in any order here, so the watermark must not drop what another file brings later.
    measures = weekly_measures(spark, sf, raw.withWatermark("ts", "3650 days"))
    weekly.start_features(measures, root, *surroundings(spark, sf)).awaitTermination()
    out = read_current(spark, f"{root}/features").select(*FEATURE_NAMES)
    return out.withColumns({"actor_centrality": r("actor_centrality"), "sentiment_score": r("sentiment_score", 4), "spatial_lag_risk": r("spatial_lag_risk")})


@query("D3_stream_sliding_counts", "with e as (select cast(ts as date) as d, event_type from events), o as (select unnest(generate_series(0, 6)) as k) select cast(d + cast(k as integer) as date) as day, event_type, count(*) as n from e cross join o group by 1, 2")
def _(spark, sf):
    events = stream(spark, sf).withWatermark("ts", weekly.LATENESS)
    return drain_upsert(weekly.sliding_counts(events, "ts", ["event_type"], 7), ["day", "event_type"], "sliding", "day").select("day", "event_type", "n")


@query("D4_stream_time_since_last", "select cast(user_id as varchar) as area, ts, round((epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts))) / 1e6 / 604800, 6) as weeks_since from events")
def _(spark, sf):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    try:
        out = drain_append(weekly.time_since_last(stream(spark, sf), "user_id"), "gaps")
    finally:
        spark.conf.set(key, before)
    return out.select("area", F.col("ts").cast("timestamp_ntz").alias("ts"), r("weeks_since").alias("weeks_since"))


@query("D5_late_rows", "select cast(ts as date) + cast(props ->> 'k' as integer) % 30 as arrived, count(*) as rows, count(*) filter (cast(props ->> 'k' as integer) % 30 > 14) as late from events group by 1")
def _(spark, sf):
    delay = F.get_json_object("props", "$.k").cast("int") % 30
    events = table(spark, sf, "events").withColumn("arrived", F.date_add(F.col("ts").cast("date"), delay))
    return weekly.late_rows(events, "ts", "arrived").select("arrived", "rows", "late")


@query("D5_stream_lateness", """
with e as (select event_id % 2 as arrival, cast(props ->> 'k' as integer) % 30 as delay from events)
select arrival, count(*) as rows, count(*) filter (delay > 14) as late from e group by 1""")
def _(spark, sf):
    """Two arrivals, a micro-batch each; a listener reads what the stream observed of its own rows."""
    root = scratch_path(spark, "arrivals")
    delay = F.get_json_object("props", "$.k").cast("int") % 30
    events = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.date_add(F.col("ts").cast("date"), delay).alias("arrived"))
    log = weekly.LatenessLog()
    spark.streams.addListener(log)
    try:
        for arrival in (0, 1):
            events.filter(F.col("event_id") % 2 == arrival).write.mode("append").parquet(f"{root}/in")
            rows = weekly.with_lateness_metrics(spark.readStream.schema(events.schema).parquet(f"{root}/in"), "ts", "arrived")
            run = rows.writeStream.format("noop").option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
            run.awaitTermination()
        deadline = time.monotonic() + 30
        while len(log.batches) < 2 and time.monotonic() < deadline:  # the listener is told a moment later
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(log)
    found = [(n, *counts) for n, (_, counts) in enumerate(sorted(log.batches.items()))]
    return spark.createDataFrame(found, "arrival long, rows long, late long")
