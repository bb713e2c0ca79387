"""Round trips through sources and sinks: given tables are written to the shared folder in a landing format and read back."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import functions as F

from risklattice.plans.base import query, table
from risklattice.session import scratch_path
from risklattice.sources import contracts, files, rest


@query("S1_csv_scan", "select o_orderkey, o_custkey, cast(o_orderdate as date) as o_orderdate, o_totalprice, o_orderpriority from orders")
def _(spark, sf):
    path = scratch_path(spark, "csv")
    columns = ["o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_totalprice", "o_orderpriority"]
    table(spark, sf, "orders").select(*columns).write.option("header", True).csv(path)
    return files.read_csv(spark, path, "o_orderkey long, o_custkey long, o_orderdate date, o_totalprice double, o_orderpriority string")


FEATURES_A_FILE = 200


@query("S3_boundaries", """
select 'P' || p_partkey as code, p_name as name, p_brand as grp, case when p_size % 2 = 0 then 2 else 1 end as rings, (p_partkey % 64)::double as west
from part where p_size % 7 <> 0""")
def _(spark, sf):
    """Parts as squares in GeoJSON files, every other one of two parts, some without geometry."""
    x, y = F.col("p_partkey") % 64, F.floor(F.col("p_partkey") / 64)

    def ring(size):
        corners = [(0, 0), (size, 0), (size, size), (0, size), (0, 0)]
        return F.array(*[F.array((x + a).cast("double"), (y + b).cast("double")) for a, b in corners])

    one = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring(1)).alias("coordinates")))
    two = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.array(F.array(ring(1)), F.array(ring(0.5))).alias("coordinates")))
    shape = F.when(F.col("p_size") % 7 == 0, F.lit("null")).when(F.col("p_size") % 2 == 0, two).otherwise(one)
    names = F.to_json(F.struct(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("c"), F.col("p_name").alias("n"), F.col("p_brand").alias("g")))
    feature = F.concat(F.lit('{"type":"Feature","properties":'), names, F.lit(',"geometry":'), shape, F.lit("}"))
    grouped = table(spark, sf, "part").select(F.floor(F.col("p_partkey") / FEATURES_A_FILE).alias("file"), feature.alias("f")).groupBy("file").agg(F.array_join(F.collect_list("f"), ",").alias("f"))
    path = scratch_path(spark, "geojson")
    grouped.select("file", F.concat(F.lit('{"type":"FeatureCollection","features":['), "f", F.lit("]}")).alias("value")).write.partitionBy("file").text(path)
    found = files.read_boundaries(spark, path, "c", "n", "g")
    return found.select("code", "name", "grp", F.size("rings").alias("rings"), F.col("rings")[0][0][0].alias("west"))


@query("S5_partitioned_table", "select l_returnflag, l_linestatus, count(*) as n, cast(sum(l_quantity) as bigint) as quantity from lineitem group by 1, 2")
def _(spark, sf):
    path = scratch_path(spark, "table")
    files.write_table(table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity"), path, ["l_returnflag"])
    back = spark.read.parquet(path)
    return back.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))


@query("S6_sorted_csv", "select c_custkey, c_name, c_mktsegment from customer")
def _(spark, sf):
    path = scratch_path(spark, "sorted")
    files.write_sorted_csv(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), path, ["c_mktsegment", "c_custkey"])
    return files.read_csv(spark, path, "c_custkey long, c_name string, c_mktsegment string")


@query("S7_nested_results", "select c_nationkey as nation, c_mktsegment as segment, count(*) as n, max(c_custkey) as newest from customer group by 1, 2")
def _(spark, sf):
    path = scratch_path(spark, "results")
    counts = table(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.struct(F.count(F.lit(1)).alias("n"), F.max("c_custkey").alias("newest")).alias("figures"))
    files.write_results(counts, path)
    back = files.read_results(spark, path, "c_nationkey int, c_mktsegment string, figures struct<n:long,newest:long>")
    return back.select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), "figures.n", "figures.newest")


@query("S8_paged_source", "select cast(event_id as varchar) as event_id, cast(cast(ts as date) as varchar) as event_date, event_type as category from events")
def _(spark, sf):
    """The events table behind a paging fetcher: each slice of days asks for its pages until a short one."""
    days = table(spark, sf, "events").agg(F.min(F.col("ts").cast("date")), F.max(F.col("ts").cast("date"))).first()
    path = f"{sf}/events.parquet"
    held = {}  # in each reading process: the service's answer to its last range, which its pages cut

    def answer(start, end, options):
        import datetime as dt

        import pyarrow.dataset as ds

        low, high = dt.datetime.fromisoformat(start), dt.datetime.fromisoformat(end) + dt.timedelta(days=1)
        data = ds.dataset(options["path"], format="parquet")
        kind = data.schema.field("ts").type
        import pyarrow as pa

        rows = data.to_table(["event_id", "ts", "event_type"], filter=(ds.field("ts") >= pa.scalar(low, kind)) & (ds.field("ts") < pa.scalar(high, kind)))
        return rows.sort_by("event_id").combine_chunks()

    def page(start, end, number, size, options):
        key = (options["path"], start, end)
        if key not in held:
            held.clear()
            held[key] = answer(start, end, options)
        rows = held[key].slice((number - 1) * size, size).to_pylist()
        return [{"event_id": str(r["event_id"]), "event_date": r["ts"].date().isoformat(), "category": r["event_type"]} for r in rows]

    spark.dataSource.register(rest.paged_source("paged_events", page))
    options = {"user": "u", "key": "k", "start": str(days[0]), "end": str(days[1]), "slice_days": "7", "page_size": "500", "pause": "0", "path": path}
    return spark.read.format("paged_events").options(**options).load().select("event_id", "event_date", "category")


@query("S10_indexed_lookup", "select o_orderkey, cast(o_orderdate as date) as event_date, o_totalprice from orders where o_custkey = 37 and cast(o_orderdate as date) between date '1994-01-01' and date '1999-12-31'")
def _(spark, sf):
    """Orders as incidents of the customer's area, indexed by area and day; one area's rows of some years."""
    name, path = f"incidents_{uuid.uuid4().hex}", scratch_path(spark, "indexed")
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("lga_id"), F.col("o_orderdate").cast("date").alias("event_date"), "o_orderkey", "o_totalprice")
    contracts.write_indexed(o, name, path, contracts.INDEXES["incidents"], 8)
    found = contracts.look_up(spark, name, contracts.INDEXES["incidents"], 37, datetime.date(1994, 1, 1), datetime.date(1999, 12, 31))
    return found.select("o_orderkey", "event_date", "o_totalprice")


@query("S11_fingerprints", """
with v as (select strftime(o_orderdate, '%Y-%m') as month, o_orderkey, o_orderkey || ',' || o_custkey || ',' || o_orderstatus as line from orders)
select month, cast(sum(strlen(line) + 1) as bigint) as bytes, md5(string_agg(line || chr(10), '' order by o_orderkey)) as md5 from v group by month""")
def _(spark, sf):
    path = scratch_path(spark, "inputs")
    o = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderkey", F.concat_ws(",", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderstatus").alias("value"))
    o.repartition("month").sortWithinPartitions("month", "o_orderkey").drop("o_orderkey").write.partitionBy("month").text(path)
    found = files.fingerprints(spark, path)
    return found.select(F.regexp_extract("path", "month=([0-9-]+)", 1).alias("month"), "bytes", "md5")


@query("S12_serving_tables", "select 'forecast' as name, count(*) as n from orders union all select 'drivers', count(*) from lineitem union all select 'band_stats', count(*) from part union all select 'recent', count(*) from customer union all select 'metadata', count(*) from region")
def _(spark, sf):
    root = scratch_path(spark, "serving")
    for name, source in zip(files.SERVING_TABLES, ("orders", "lineitem", "part", "customer", "region")):
        files.write_table(table(spark, sf, source), f"{root}/{name}")
    out = None
    for name, served in files.serving_tables(spark, root).items():
        part = served.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out
