"""Continuous versions of ingest, weekly counts and time since the last event."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from risklattice.session import cut_lineage
from risklattice.sources.contracts import FEATURES_WEEKLY, KEYS, conform, read_current, upsert

# Reports arrive one to two weeks late.
LATENESS = "14 days"
# Thursday is day 0 of the epoch, so weeks that start on Monday are offset by four days.
MONDAY = "4 days"


def parse_events(messages: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """JSON messages to typed columns; a malformed message gives nulls and is left out by its null key."""
    return messages.select(F.from_json(F.col(value).cast("string"), schema).alias("e")).select("e.*")


def unique_events(events: DataFrame, key: str, ts: str, lateness: str = LATENESS) -> DataFrame:
    """Each event id once. State is dropped once the watermark passes."""
    return events.filter(F.col(key).isNotNull()).withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def weekly_counts(events: DataFrame, ts: str, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """Monday-aligned weekly sums; rows behind the watermark are dropped."""
    week = F.window(ts, "7 days", startTime=MONDAY)
    out = events.groupBy(week, *keys).agg(*[m.alias(n) for n, m in measures.items()])
    return out.select(F.col("window.start").cast("date").alias("week"), *keys, *measures)


def sliding_counts(events: DataFrame, ts: str, keys: list[str], days: int) -> DataFrame:
    """Events of the last ``days`` days, one row per key and day."""
    out = events.groupBy(F.window(ts, f"{days} days", "1 day"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.date_sub(F.col("window.end").cast("date"), 1).alias("day"), *keys, "n")


def with_lateness_metrics(events: DataFrame, ts: str, arrived: str, name: str = "lateness", days: int = 14) -> DataFrame:
    """Observed metrics per micro-batch: rows, and rows that arrived more than ``days`` days after they happened."""
    delay = F.datediff(F.col(arrived), F.col(ts).cast("date"))
    return events.observe(name, F.count(F.lit(1)).alias("rows"), F.count_if(delay > days).alias("late"))


def late_rows(events: DataFrame, ts: str, arrived: str, days: int = 14) -> DataFrame:
    """Rows per arrival day that came more than ``days`` days after they happened."""
    delay = F.datediff(F.col(arrived), F.col(ts).cast("date"))
    return events.groupBy(F.col(arrived).alias("arrived")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(delay > days).alias("late"))


def start_upsert(stream: DataFrame, path: str, checkpoint: str, keys: list[str], output: str = "update", partition: str | None = None):
    """Write a keyed aggregate stream to a table; the batch number settles which row of a key is newest. A batch rewrites only the partitions it touches."""

    def write(batch: DataFrame, number: int) -> None:
        upsert(batch.sparkSession, path, batch.withColumn("batch", F.lit(number)), keys, "batch", partition)

    return stream.writeStream.outputMode(output).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def contract_features(base: DataFrame, latest: Column, edges: DataFrame, festivals: DataFrame) -> DataFrame:
    """All columns of the weekly feature table from its own-area measures.

    ``base`` has lga_id, week_start, incident_count_7d, actor_centrality, military_ops_flag, ransom, sentiment_score and entity_mentions;
    ``edges`` directed pairs (lga_id, near); ``festivals`` distinct days (day). A payment counts as nearby in its week and the one
    after; the spatial lag is the neighbours' mean count of the week before; the label is null until a week after ``week_start`` is there.
    """
    week = F.col("week_start")
    steps = F.array(*[F.struct(F.date_add(week, 7 * k).alias("week_start"), F.lit(k).alias("after")) for k in (0, 1)])
    spread = base.select(F.col("lga_id").alias("near"), "incident_count_7d", "ransom", F.explode(steps).alias("s")).join(edges, "near")
    nearby = spread.groupBy("lga_id", "s.week_start").agg(F.bool_or("ransom").alias("_ransom"), F.sum(F.when(F.col("s.after") == 1, F.col("incident_count_7d"))).alias("_lag"))
    degree = edges.groupBy("lga_id").agg(F.count(F.lit(1)).alias("_degree"))
    following = base.select("lga_id", F.date_sub(week, 7).alias("week_start"), (F.col("incident_count_7d") > 0).cast("double").alias("_next"))
    festive = festivals.select(F.date_trunc("week", "day").cast("date").alias("week_start")).distinct().withColumn("_festive", F.lit(True))
    out = base.join(nearby, ["lga_id", "week_start"], "left").join(degree, "lga_id", "left").join(following, ["lga_id", "week_start"], "left").join(festive, "week_start", "left")
    out = out.withColumns({
        "festival_flag": F.coalesce("_festive", F.lit(False)), "ransom_payment_nearby": F.coalesce("_ransom", F.lit(False)),
        "spatial_lag_risk": F.coalesce(F.col("_lag") / F.col("_degree"), F.lit(0.0)), "incident_prob_7d": F.when(week < latest, F.coalesce("_next", F.lit(0.0))),
    })
    return conform(out, FEATURES_WEEKLY)


def start_features(stream: DataFrame, root: str, edges: DataFrame, festivals: DataFrame):
    """Keep the weekly feature table under ``root`` as own-area measures stream in.

    A batch first upserts the measures of its weeks. A week's rows depend on the week before, its own and the one after, so only
    the weeks next to those a batch touches, and the week that was the last so far, are derived again and overwritten, from
    the partitions of measures around them. A repeated batch writes the same rows again.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        touched = {r[0] for r in batch.select("week_start").distinct().collect()}  # weeks of one batch
        if not touched:
            return
        done = read_current(spark, f"{root}/features")
        before = done.agg(F.max("week_start")).first()[0] if done is not None else None
        upsert(spark, f"{root}/base", batch.withColumn("batch", F.lit(number)), KEYS["features_weekly"], "batch", "week_start")
        base = spark.read.parquet(f"{root}/base")
        latest = base.agg(F.max("week_start")).first()[0]
        week = datetime.timedelta(days=7)
        affected = {w + k * week for w in touched for k in (-1, 0, 1)} | ({before} if before else set())
        around = sorted({w + k * week for w in affected for k in (-1, 0, 1)})
        own = contract_features(base.filter(F.col("week_start").isin(around)), F.lit(latest), edges, festivals).filter(F.col("week_start").isin(sorted(affected)))
        cut_lineage(own).hint("rebalance", F.col("week_start")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("week_start").parquet(f"{root}/features")

    return stream.writeStream.outputMode("update").option("checkpointLocation", f"{root}/progress").foreachBatch(write).trigger(availableNow=True).start()


DAY_US = 86_400_000_000
GAP_ROW = "area string, ts timestamp, weeks_since double"


class TimeSinceLast(StatefulProcessor):
    """Time since the previous event of an area, kept online.

    State is one timestamp per area. The times of an area in one micro-batch are sorted before they are compared. Up to ``most`` of
    them, eight bytes each, are held at once; where an area brings more, they are set down in map state by day as they come and
    taken up again day by day, so a hot area needs no more memory than one of its days. An event older than the last one
    seen reports no gap. An event-time timer clears an area once the watermark is past the longest gap.
    """

    def __init__(self, forget_days: int = 3640, most: int = 1 << 17):
        self.forget_ms, self.most = forget_days * 86_400_000, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts timestamp")
        self.waiting = handle.getMapState("waiting", "day long, part int", "times binary")

    def _set_down(self, times: np.ndarray, part: int) -> None:
        day = times // DAY_US
        for d in np.unique(day):
            self.waiting.updateValue((int(d), part), (times[day == d].tobytes(),))

    def _in_order(self, rows: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        """Times of the area in microseconds, sorted, some at a time."""
        held, size, part = [], 0, 0
        for batch in rows:
            times = batch["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
            for begin in range(0, len(times), self.most):
                some = times[begin : begin + self.most]
                if size + len(some) > self.most:
                    self._set_down(np.concatenate(held), part)
                    held, size, part = [], 0, part + 1
                held.append(some)
                size += len(some)
        if part == 0:
            yield np.sort(np.concatenate(held))
            return
        self._set_down(np.concatenate(held), part)
        keys = sorted((int(k[0]), int(k[1])) for k in self.waiting.keys())
        for day in dict.fromkeys(d for d, _ in keys):
            own = [k for k in keys if k[0] == day]
            yield np.sort(np.concatenate([np.frombuffer(self.waiting.getValue(k)[0], np.int64) for k in own]))
            for k in own:
                self.waiting.removeKey(k)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        known = self.last.exists()
        last = int(np.datetime64(self.last.get()[0], "us").astype(np.int64)) if known else None
        newest = last
        for times in self._in_order(rows):
            before = np.concatenate([[newest if newest is not None else times[0]], times[:-1]])
            gap = (times - before) / (7 * DAY_US)
            if newest is None:
                gap[0] = np.nan  # nothing was seen before
            elif known:
                before = np.maximum(before, last)
                gap = np.where(times <= last, np.nan, (times - before) / (7 * DAY_US))
            newest = int(times[-1]) if newest is None else max(newest, int(times[-1]))
            yield pd.DataFrame({"area": [str(key[0])] * len(times), "ts": pd.Series(times.astype("datetime64[us]")), "weeks_since": gap})
        self.last.update((pd.Timestamp(newest, unit="us").to_pydatetime(),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(newest // 1000 + self.forget_ms)

    def handleExpiredTimer(self, key, timer_values, expired) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


class LatenessLog(StreamingQueryListener):
    """Rows and late rows of each micro-batch, as :func:`with_lateness_metrics` observed them."""

    def __init__(self, name: str = "lateness"):
        self.name, self.batches = name, {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get(self.name)
        if found is not None and found["rows"]:
            self.batches[event.progress.batchId] = (int(found["rows"]), int(found["late"]))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def time_since_last(events: DataFrame, area: str = "area", ts: str = "ts", most: int = 1 << 17) -> DataFrame:
    """Stream of (area, ts, weeks_since). Needs the RocksDB state store."""
    rows = events.select(F.col(area).cast("string").alias("area"), F.col(ts).cast("timestamp").alias("ts"))
    timed = rows.withWatermark("ts", LATENESS)
    # Event time, not processing time: with processing-time timers a drained stream never ends.
    return timed.groupBy("area").transformWithStateInPandas(TimeSinceLast(most=most), GAP_ROW, "append", "eventTime", eventTimeColumnName="ts")
