"""Scans and sinks over files."""

from __future__ import annotations

import functools
import io
import json
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from risklattice.session import cut_lineage

ROWS_A_TASK = 2**20  # rows of a partitioned write that one task sorts


def read_csv(spark: SparkSession, path: str, schema: str, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """CSV with a declared schema; no inference pass."""
    return spark.read.schema(schema).option("header", True).option("dateFormat", date_format).csv(path)


def read_layers(spark: SparkSession, layers: dict[str, str], fmt: str = "parquet", **options) -> DataFrame:
    """Several layers of one reference, each a path, as one table with a ``layer`` column."""
    out = None
    for name, path in layers.items():
        part = spark.read.format(fmt).options(**options).load(path).withColumn("layer", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Parquet scan that reads only the given columns."""
    return spark.read.parquet(path).select(*columns)


FEATURE_ROW = "code string, name string, grp string, geometry string"
RINGS = "array<array<array<double>>>"


def read_boundaries(spark: SparkSession, path: str, code: str, name: str, group: str) -> DataFrame:
    """(code, name, grp, rings) from zipped or plain GeoJSON files; features without geometry are left out.

    One row per file enters Python to be unzipped and cut into features, which are streamed out one
    by one; coordinates are parsed by Spark. The rings of a multipolygon are put side by side.
    """

    def features(batches):
        for batch in batches:
            for content in batch["content"]:
                for text in _documents(content):
                    rows = []
                    for f in json.loads(text).get("features", []):
                        p = f.get("properties") or {}
                        rows.append((p.get(code), p.get(name), p.get(group), json.dumps(f["geometry"]) if f.get("geometry") else None))
                    yield pd.DataFrame(rows, columns=["code", "name", "grp", "geometry"], dtype=object)

    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(features, FEATURE_ROW)
    kind = F.get_json_object("geometry", "$.type")
    single = F.from_json("geometry", f"coordinates {RINGS}")["coordinates"]
    multi = F.flatten(F.from_json("geometry", f"coordinates array<{RINGS}>")["coordinates"])
    return raw.filter(F.col("geometry").isNotNull()).select(
        "code", "name", "grp", F.when(kind == "Polygon", single).when(kind == "MultiPolygon", multi).alias("rings")
    )


def _documents(content: bytes):
    if not content.startswith(b"PK"):
        yield content
        return
    with zipfile.ZipFile(io.BytesIO(content)) as bundle:
        for entry in bundle.namelist():
            if entry.lower().endswith((".geojson", ".json")):
                yield bundle.read(entry)


def write_table(df: DataFrame, path: str, partition_by: list[str] = [], mode: str = "overwrite", rows: int = ROWS_A_TASK) -> None:
    """Parquet, optionally partitioned. Rows of a partition value go to few tasks; a value of more than ``rows`` rows to as many tasks as
    it holds that many. Tasks are dealt by rows, not bytes: each one sorts its rows by value, and bytes may be far fewer before that.
    """
    if not partition_by:
        df.write.mode(mode).parquet(path)
        return
    sizes = df.groupBy(*partition_by).agg(F.count(F.lit(1)).alias("_rows")).withColumn("_parts", F.ceil(F.col("_rows") / F.lit(float(rows))))
    sizes = cut_lineage(sizes.toDF(*[f"_v{i}" for i in range(len(partition_by))], "_rows", "_parts"))
    small, large = sizes.agg(F.sum(F.when(F.col("_parts") == 1, F.col("_rows"))), F.sum(F.when(F.col("_parts") > 1, F.col("_parts")))).first()
    base = -(-(small or 0) // rows)  # tasks for the values that need less than one, by hash
    starts = F.coalesce(F.sum("_parts").over(Window.orderBy(F.col("_parts").desc(), *sizes.columns).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hot = sizes.filter("_parts > 1").withColumn("_start", starts + base).drop("_rows")
    same = [F.col(f"_v{i}").eqNullSafe(df[c]) for i, c in enumerate(partition_by)]
    # At most a row for each ``rows`` rows.
    dealt = df.join(F.broadcast(hot), functools.reduce(lambda a, b: a & b, same), "left")
    task = F.coalesce(F.col("_start") + F.pmod(F.monotonically_increasing_id(), F.col("_parts")), F.pmod(F.xxhash64(*[df[c] for c in partition_by]), F.lit(max(base, 1))))
    dealt.repartitionById(max(1, base + (large or 0)), task.cast("int")).select(*[df[c] for c in df.columns]).write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_sorted_csv(df: DataFrame, path: str, order: list[Column | str]) -> None:
    df.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def write_results(df: DataFrame, path: str) -> None:
    """Nested results as JSON lines."""
    df.write.mode("overwrite").json(path)


def read_results(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """Size and md5 of every input file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.md5("content").alias("md5"))


def as_messages(df: DataFrame, key: str | None = None) -> DataFrame:
    """One JSON message per row, in the shape a Kafka sink takes."""
    value = F.to_json(F.struct("*")).alias("value")
    return df.select(F.col(key).cast("string").alias("key"), value) if key else df.select(value)


def publish(df: DataFrame, sink: str, options: dict[str, str], key: str | None = None) -> int:
    """Write one message per row to any sink (``kafka`` where its package is present); returns the number written.

    The number is observed while the rows are written, so they are computed once.
    """
    sent = Observation("sent")
    as_messages(df, key).observe(sent, F.count(F.lit(1)).alias("n")).write.format(sink).options(**options).mode("append").save()
    return int(sent.get["n"])


SERVING_TABLES = ("forecast", "drivers", "band_stats", "recent", "metadata")


def serving_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The five tables the viewer reads."""
    return {name: spark.read.parquet(f"{root}/{name}") for name in SERVING_TABLES}
