"""Schemas of the landing tables and the keyed upsert that writes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from risklattice.session import cut_lineage

# Declared columns and keys of the landing tables. Points are lon/lat, shapes are rings.
LGA = "lga_id string, lga_name string, state_name string, rings array<array<array<double>>>"
INCIDENTS = (
    "incident_id string, lga_id string, event_date date, event_type string, event_subtype string, actor1 string, "
    "actor2 string, fatalities int, source string, source_scale string, notes string, lon double, lat double, ingested_at timestamp"
)
TEXT_MENTIONS = (
    "mention_id long, source string, published_at timestamp, lga_id string, raw_text string, entities string, "
    "embedding array<float>, sentiment_score double, ingested_at timestamp"
)
FEATURES_WEEKLY = (
    "lga_id string, week_start date, incident_count_7d int, actor_centrality double, festival_flag boolean, "
    "military_ops_flag boolean, ransom_payment_nearby boolean, sentiment_score double, spatial_lag_risk double, "
    "entity_mentions int, incident_prob_7d double"
)
KEYS = {"lga": ["lga_id"], "incidents": ["incident_id"], "text_mentions": ["mention_id"], "features_weekly": ["lga_id", "week_start"]}

INDEX_BLOCK = 1 << 20  # bytes of a row group of an indexed table: small, so that look-ups skip most


def conform(df: DataFrame, schema: str) -> DataFrame:
    """Project onto a declared schema: casts by name, null for absent columns."""
    target = df.sparkSession.createDataFrame([], schema).schema
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in target])


def newest_per_key(df: DataFrame, keys: list[str], version: Column | str) -> DataFrame:
    """One row per key, the highest version; an aggregate, so copies of a key collapse before the shuffle.

    A null version ranks below all others, so a key that has no other keeps a row.
    """
    v = F.col(version) if isinstance(version, str) else version
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(F.lit(0).alias("_"), *rest), F.struct(v.isNotNull(), v)).alias("_r")
    return df.groupBy(*keys).agg(newest).select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def upsert(spark: SparkSession, path: str, changes: DataFrame, keys: list[str], version: str, partition: str | None = None) -> None:
    """Merge rows into a Parquet table: of each key the row of the highest version stays.

    With ``partition``, a key column, only the partitions that changes touch are read and overwritten. The merged rows are written to the
    shared folder before they replace what they were merged from, so a repeated call merges the same rows again.
    """
    latest, current = newest_per_key(changes, keys, version), read_current(spark, path)
    if current is not None:
        if partition:
            current = current.join(latest.select(partition).distinct(), partition, "left_semi")
        latest = newest_per_key(current.unionByName(latest, allowMissingColumns=True), keys, version)
    latest = cut_lineage(latest)
    if partition:
        dealt = latest.hint("rebalance", F.col(partition))
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    else:
        latest.write.mode("overwrite").parquet(path)


# Secondary indexes of the landing tables.
INDEXES = {"incidents": ["lga_id", "event_date"], "text_mentions": ["lga_id", "published_at"]}


def write_indexed(df: DataFrame, name: str, path: str, index: list[str], buckets: int) -> None:
    """A table that answers look-ups by its index without a shuffle and without reading most of itself.

    Rows are dealt into ``buckets`` files by the first index column and sorted by all of them; row groups carry the ranges of all
    index columns and a Bloom filter of the first. A look-up by key reads one bucket, and of that the row groups that can hold it;
    two tables with the same first column and buckets join where they lie.
    """
    dealt = df.repartition(buckets, index[0])
    dealt.write.mode("overwrite").format("parquet").bucketBy(buckets, index[0]).sortBy(*index).option("path", path).option(f"parquet.bloom.filter.enabled#{index[0]}", "true").option("parquet.block.size", INDEX_BLOCK).saveAsTable(name)


def look_up(spark: SparkSession, name: str, index: list[str], key, low=None, high=None) -> DataFrame:
    """Rows of one key of an indexed table, between two values of its second index column where given."""
    rows = spark.table(name).filter(F.col(index[0]) == F.lit(key))
    if low is not None:
        rows = rows.filter(F.col(index[1]) >= F.lit(low))
    return rows if high is None else rows.filter(F.col(index[1]) <= F.lit(high))


def read_current(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None before the first write."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(conf)
    written = files.exists(root) and any(not f.getPath().getName().startswith((".", "_")) for f in files.listStatus(root))
    return spark.read.parquet(path) if written else None
