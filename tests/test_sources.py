import json
import zipfile
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from risklattice.sources import contracts, files
from risklattice.sources.rest import paged_source
from risklattice.streaming import weekly


def test_csv_scan_and_sorted_sink(spark, tmp_path):
    df = spark.createDataFrame([(2, date(2020, 1, 2)), (1, date(2020, 1, 1))], "id int, d date")
    files.write_sorted_csv(df, str(tmp_path / "c"), ["id"])
    back = files.read_csv(spark, str(tmp_path / "c"), "id int, d date")
    assert sorted(map(tuple, back.collect())) == [(1, date(2020, 1, 1)), (2, date(2020, 1, 2))]


def test_parquet_sink_results_and_serving(spark, tmp_path):
    df = spark.range(20).withColumn("y", F.col("id") % 2)
    files.write_table(df, str(tmp_path / "t"), ["y"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 20
    files.write_results(df.select(F.struct("id", "y").alias("s"), F.array("id").alias("a")), str(tmp_path / "j"))
    assert files.read_results(spark, str(tmp_path / "j"), "s struct<id: long, y: long>, a array<long>").filter("s.id = a[0]").count() == 20
    for name in files.SERVING_TABLES:
        files.write_table(df, str(tmp_path / "gold" / name))
    assert {n: t.count() for n, t in files.serving_tables(spark, str(tmp_path / "gold")).items()} == dict.fromkeys(files.SERVING_TABLES, 20)


def test_partitioned_write_splits_large_values_by_rows(spark, tmp_path):
    """Equal rows, which shrink to few bytes: no file holds many more than the bound; small and null values keep one file."""
    y = F.when(F.col("id") < 4000, 1).when(F.col("id") < 4020, 2)
    df = spark.range(4050).select(y.alias("y"), F.lit(7).alias("x"))
    files.write_table(df, str(tmp_path / "t"), ["y"], rows=500)
    back = spark.read.parquet(str(tmp_path / "t"))
    held = {}
    for r in back.groupBy("y", F.input_file_name().alias("f")).count().collect():
        held.setdefault(r.y, []).append(r["count"])
    assert sum(held[1]) == 4000 and max(held[1]) <= 600 and held[2] == [20] and held[None] == [30]


def test_layers(spark, tmp_path):
    spark.createDataFrame([("a", 1)], "name string, x int").write.parquet(str(tmp_path / "l1"))
    spark.createDataFrame([("b",)], "name string").write.parquet(str(tmp_path / "l2"))
    out = files.read_layers(spark, {"one": str(tmp_path / "l1"), "two": str(tmp_path / "l2")})
    assert sorted(map(tuple, out.select("layer", "name", "x").collect())) == [("one", "a", 1), ("two", "b", None)]


@pytest.mark.parametrize("zipped", [True, False])
def test_boundaries(spark, tmp_path, zipped):
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    feature = lambda c, g: {"type": "Feature", "properties": {"code": c, "name": c, "grp": "g"}, "geometry": g}
    doc = json.dumps({"type": "FeatureCollection", "features": [
        feature("A", {"type": "Polygon", "coordinates": [ring]}), feature("B", {"type": "MultiPolygon", "coordinates": [[ring], [ring, ring]]}), feature("C", None),
    ]})
    if zipped:
        path = tmp_path / "b.zip"
        with zipfile.ZipFile(path, "w") as z:
            z.writestr("areas.geojson", doc)
    else:
        path = tmp_path / "b.geojson"
        path.write_text(doc)
    rows = {r.code: r for r in files.read_boundaries(spark, str(path), "code", "name", "grp").collect()}
    assert set(rows) == {"A", "B"} and len(rows["A"].rings) == 1 and len(rows["B"].rings) == 3
    assert rows["A"].rings[0][1] == [1.0, 0.0]


def test_rest_pages(spark):
    def fetch(start, end, page, size, options):
        total = {"2020-01-01": 5, "2020-01-11": 4}.get(start, 0)
        return [{"event_id": f"{start}-{i}", "event_date": start} for i in range((page - 1) * size, min(page * size, total))]

    spark.dataSource.register(paged_source("paged_test", fetch))
    read = spark.read.format("paged_test").options(start="2020-01-01", end="2020-01-25", slice_days="10", page_size="2", pause="0")
    with pytest.raises(Exception, match="missing credentials"):
        read.load().count()
    df = read.options(user="u", key="k").load()
    assert df.count() == 9 and df.select("event_id").distinct().count() == 9


def test_messages_and_fingerprints(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id int, s string")
    assert files.publish(df, "json", {"path": str(tmp_path / "out")}, "id") == 2
    back = spark.read.json(str(tmp_path / "out"))
    assert sorted(json.loads(r.value)["id"] for r in back.collect()) == [1, 2]
    (tmp_path / "f.bin").write_bytes(b"abc")
    row = files.fingerprints(spark, str(tmp_path / "f.bin")).first()
    assert (row.bytes, row.md5) == (3, "900150983cd24fb0d6963f7d28e17f72")


def test_contract_and_upsert(spark, tmp_path):
    path = str(tmp_path / "u")
    raw = spark.createDataFrame([("e1", "2020-01-01", 3)], "incident_id string, event_date string, fatalities long")
    row = contracts.conform(raw, contracts.INCIDENTS)
    assert row.first().event_date == date(2020, 1, 1) and len(row.columns) == 14
    make = lambda rows: spark.createDataFrame(rows, "k string, v int, n int")
    assert contracts.read_current(spark, path) is None
    contracts.upsert(spark, path, make([("a", 1, 1), ("b", 1, 1), ("a", 2, 2)]), ["k"], "n")
    contracts.upsert(spark, path, make([("b", 5, 3), ("c", 1, 3)]), ["k"], "n")
    assert sorted((r.k, r.v) for r in contracts.read_current(spark, path).collect()) == [("a", 2), ("b", 5), ("c", 1)]


def test_late_event_is_dropped_and_counted(spark, tmp_path):
    """Two file arrivals: the second holds one event inside the watermark and one far behind it."""
    src, schema = tmp_path / "in", "event_id long, ts timestamp, arrived date"
    day = lambda d: datetime(2024, 1, 1) + (datetime(2024, 1, d) - datetime(2024, 1, 1))
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))

    def drain(label):
        s = weekly.with_lateness_metrics(spark.readStream.schema(schema).parquet(str(src)), "ts", "arrived")
        unique = weekly.unique_events(s, "event_id", "ts")
        q = unique.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return [p["observedMetrics"]["lateness"]["late"] for p in q.recentProgress if "lateness" in p["observedMetrics"] and p["numInputRows"]]

    put([(1, day(2), date(2024, 1, 2)), (2, day(31), date(2024, 1, 31)), (2, day(31), date(2024, 1, 31))])
    assert drain("first") == [0]
    put([(3, day(25), date(2024, 2, 1)), (4, day(3), date(2024, 2, 1))])
    assert drain("second") == [1]
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]


def test_pages_of_a_slice_read_the_events_once(spark, sf, monkeypatch):
    import pyarrow.dataset as ds

    from risklattice.plans import QUERIES
    from risklattice.sources import rest

    found, opened, plain = {}, [], ds.dataset

    def caught(name, fetch):
        found["page"] = fetch
        raise KeyError(name)

    monkeypatch.setattr(rest, "paged_source", caught)
    with pytest.raises(KeyError):
        QUERIES["S8_paged_source"](spark, sf)
    monkeypatch.setattr(ds, "dataset", lambda *a, **k: opened.append(1) or plain(*a, **k))
    pages = [found["page"]("2024-01-01", "2024-12-31", n, 7, {"path": f"{sf}/events.parquet"}) for n in (1, 2, 3)]
    assert len(opened) == 1 and len({r["event_id"] for p in pages for r in p}) == 21
