"""Decide the area of an event from coordinate, name and gazetteer evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risklattice.operators.ranking import ordered_numbers
from risklattice.session import cut_lineage, scratch_path

SHORTEST_PLACE_NAME = 5


def reconcile_evidence(events: DataFrame, declared: str, geo_code: str, geo_group: str, name_code: str, name_group: str) -> DataFrame:
    """``code`` and ``basis`` from two candidate matches: agreement first, then the one inside the declared group."""
    g, n = F.col(geo_code), F.col(name_code)
    has_g, has_n = g.isNotNull(), n.isNotNull()
    g_fits = F.coalesce(F.col(geo_group) == F.col(declared), F.lit(False))
    n_fits = F.coalesce(F.col(name_group) == F.col(declared), F.lit(False))
    basis = (
        F.when(has_g & has_n & (g == n), "agree")
        .when(has_g & has_n & g_fits, "conflict_kept_geometry")
        .when(has_g & has_n & n_fits, "conflict_kept_name")
        .when(has_g & has_n, "conflict_unresolved")
        .when(has_g, "geometry_only")
        .when(has_n, "name_only")
        .otherwise("none")
    )
    code = (
        F.when(F.col("basis").isin("agree", "conflict_kept_geometry", "geometry_only"), g)
        .when(F.col("basis").isin("conflict_kept_name", "name_only"), n)
    )
    return events.withColumn("basis", basis).withColumn("code", code)


def gazetteer_match(texts: DataFrame, gazetteer: DataFrame, row_id: str, group: str, fields: list[str], shortest: int = SHORTEST_PLACE_NAME) -> DataFrame:
    """Longest place name of the declared group contained in a text field, fields in the given order.

    ``texts`` holds normalised fields; ``gazetteer`` has (name_key, group_key, code, place), each name already
    resolved to one area. Ties of equal length go to the earlier gazetteer place. Texts are read whole and never travel:

    * a name is covered by grams of ``shortest`` letters, side by side and one at its end; of the text only places that hold
      such a gram of their group go on, as row, place and gram, after a join that Spark keeps local where the grams are few;
    * of a name's grams the one that the texts hold least often proposes where the name begins;
    * a proposal stands if the name's other grams are at their places too, so a name of any length is checked letter by letter.
    """
    spark, n = texts.sparkSession, shortest
    order = [(-F.length("name_key")).alias("_shorter"), F.col("place"), F.col("name_key")]
    names = ordered_numbers(gazetteer.filter(F.length("name_key") >= n).dropDuplicates(["group_key", "name_key"]), [], order, "name_no")
    last = F.length("name_key") - n
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(n)), F.array(last)))
    covers = names.select("group_key", "name_key", "name_no", F.size(starts).alias("need"), F.explode(starts).alias("offset"))
    path = scratch_path(spark, "covers")
    covers.select("group_key", "name_no", "need", "offset", F.substring("name_key", F.col("offset") + 1, F.lit(n)).alias("gram")).write.parquet(path)
    covers = spark.read.parquet(path)

    tall = F.explode(F.array(*[F.struct(F.lit(i).alias("field_no"), F.col(f).alias("blob")) for i, f in enumerate(fields)]))
    blobs = texts.filter(F.col(group).isNotNull()).select(row_id, F.col(group).alias("group_key"), tall.alias("b")).select(row_id, "group_key", "b.field_no", "b.blob")
    grams = blobs.select(row_id, "group_key", "field_no", F.posexplode(F.regexp_extract_all("blob", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))).alias("at", "gram"))
    found = cut_lineage(grams.join(covers.select("group_key", "gram").distinct(), ["group_key", "gram"], "left_semi"))

    seen = found.groupBy("group_key", "gram").agg(F.count(F.lit(1)).alias("_seen"))
    rarest = covers.join(seen, ["group_key", "gram"]).groupBy("group_key", "name_no", "need").agg(F.count(F.lit(1)).alias("_held"), F.min_by(F.struct("gram", "offset"), F.struct("_seen", "offset")).alias("_key"))
    keys = rarest.filter("_held = need").select("group_key", "name_no", "need", "_key.gram", "_key.offset")
    proposed = found.join(keys, ["group_key", "gram"]).select(row_id, "group_key", "field_no", (F.col("at") - F.col("offset")).alias("begin"), "name_no", "need", F.col("offset").alias("_first")).filter("begin >= 0")
    others = covers.select("group_key", "name_no", "gram", "offset")
    asked = proposed.filter("need > 1").join(others, ["group_key", "name_no"]).filter("offset <> _first").withColumn("at", F.col("begin") + F.col("offset"))
    checked = asked.join(found, [row_id, "group_key", "field_no", "at", "gram"]).groupBy(row_id, "field_no", "begin", "name_no", "need").agg(F.count(F.lit(1)).alias("_there")).filter("_there = need - 1")
    hits = proposed.filter("need = 1").select(row_id, "field_no", "name_no").unionByName(checked.select(row_id, "field_no", "name_no"))
    best = hits.groupBy(row_id).agg(F.min(F.struct("field_no", "name_no")).alias("_b")).select(row_id, "_b.field_no", "_b.name_no")
    return best.join(names.select("name_no", "code", "name_key"), "name_no").select(row_id, "code", "name_key", "field_no")


def with_gazetteer(resolved: DataFrame, hits: DataFrame, row_id: str) -> DataFrame:
    """Give still unplaced events their gazetteer hit; ``resolved`` marks events with an area."""
    joined = resolved.join(hits.select(row_id, F.col("code").alias("_gaz")), row_id, "left")
    take = F.col("code").isNull() & F.col("_gaz").isNotNull()
    joined = joined.withColumn("basis", F.when(take, "gazetteer").otherwise(F.col("basis")))
    joined = joined.withColumn("code", F.coalesce("code", "_gaz"))
    return joined.drop("_gaz").withColumn("resolved", F.col("code").isNotNull())


def conflict_pairs(resolved: DataFrame, declared: str, found: str, top: int = 8) -> DataFrame:
    """Most frequent (declared, found) label pairs among conflicts."""
    pairs = resolved.filter(F.col("basis").startswith("conflict")).groupBy(declared, found).agg(F.count(F.lit(1)).alias("n"))
    return pairs.orderBy(F.col("n").desc(), declared, found).limit(top)
