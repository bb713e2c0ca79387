"""Mixing sources to target weights by hash-threshold histograms. DataFrame functions only.

Every document has a hash. Words are summed by source and leading hash digits; where the running sum of a source
passes its budget lies the boundary bucket, and only that bucket is summed again by the next digits. After
``LEVELS`` such steps the threshold of each source is known to one hash value, and documents pass by comparing their hash with
it: nothing is sorted and no group meets in one task. Thresholds are nested: a smaller budget takes a subset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from risklattice.operators.ranking import ordered_numbers
from risklattice.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)  # by place of the source, repeating
SHARE = 1.5  # of all words
MOST_COPIES = 2.0
SENT_SOURCES = 20_000  # at most so many rows, one a source, are sent to all tasks; beyond that the documents are joined by source
DIGITS, LEVELS = 3, 4  # hex digits of the hash that each histogram resolves; 4,096 buckets a source


def n_words(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place_hash(doc_id: Column | str) -> Column:
    """The leading ``DIGITS * LEVELS`` hex digits of a document's hash."""
    return F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), 1, DIGITS * LEVELS)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """source, source_size, target from rows (source, size). One row per source; null is a source, the last.

    Targets are proportional to weights; those above ``most`` times the source stop there and the excess is shared again
    among the others until none is above. Each round is one aggregate over the sources; the number of rounds is at most the
    number of distinct size-to-weight ratios and the driver holds three numbers.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = ordered_numbers(totals.withColumn("_null", F.col("source").isNull()), [], [F.col("_null"), F.col("source")], "_place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_place") - 1, F.lit(len(weights))) + 1).cast("int"))
    placed = cut_lineage(numbered.select("source", "source_size", weight.alias("_w"), (F.lit(most) * F.col("source_size")).alias("_cap")))
    everything = placed.agg(F.sum("source_size")).first()[0] or 0
    level = None
    while True:
        above = F.lit(False) if level is None else F.col("_w") * F.lit(level) > F.col("_cap")
        held, free = placed.agg(F.sum(F.when(above, F.col("_cap")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("_w")))).first()
        now = (share * everything - held) / free if free else level
        if now is None or now == level:
            break
        level = now
    target = F.least(F.col("_cap"), F.col("_w") * F.lit(level or 0.0))
    return placed.select("source", "source_size", target.alias("target"))


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """source, source_size, target, whole (copies of every document), cut: hashes up to and with ``cut`` get one more.

    The cut is the hash whose running sum comes nearest to what is left of the target, the smaller of two as near.
    An empty string takes none.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = targets.withColumn("whole", whole).withColumn("_left", F.col("target") - F.col("whole") * F.col("source_size"))
    state = state.withColumns({"_prefix": F.lit(""), "_base": F.lit(0).cast("long")})
    for _ in range(LEVELS):
        digits = F.length("_prefix") + DIGITS
        inside = sizes.join(state.withColumnRenamed("source", "_s").filter("_left > 0"), F.col("source").eqNullSafe(F.col("_s")))
        inside = inside.filter(F.col("hash").startswith(F.col("_prefix")))
        buckets = inside.groupBy("source", F.expr(f"substring(hash, 1, length(_prefix) + {DIGITS})").alias("_b")).agg(F.sum("size").alias("_n"), F.first("_left").alias("_left"), F.first("_base").alias("_base"))
        up_to = Window.partitionBy("source").orderBy("_b")
        run = buckets.withColumn("_cum", F.col("_base") + F.sum("_n").over(up_to))
        # The boundary bucket: the first whose running sum reaches what is left.
        edge = run.filter("_cum >= _left").groupBy("source").agg(F.min(F.struct("_b", (F.col("_cum") - F.col("_n")).alias("_base"), "_cum")).alias("_e"))
        edge = edge.select(F.col("source").alias("_s"), F.col("_e._b").alias("_p"), F.col("_e._base").alias("_nb"), F.col("_e._cum").alias("_nc"))
        keep = [c for c in state.columns if c not in ("_prefix", "_base", "_reach")]
        state = cut_lineage(state.join(edge, F.col("source").eqNullSafe(F.col("_s")), "left").select(*keep, F.coalesce("_p", F.lit("")).alias("_prefix"), F.coalesce("_nb", F.lit(0)).cast("long").alias("_base"), F.col("_nc").alias("_reach")))
    nearer = (F.col("_reach") - F.col("_left")) < (F.col("_left") - F.col("_base"))
    return state.select(
        "source", "source_size", "target", "whole", F.col("_prefix").alias("_edge"),
        F.coalesce(nearer & (F.col("_prefix") != ""), F.lit(False)).alias("_with"),
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """All rows of ``docs`` with size, source_size, target and taken added (existing columns of these names are replaced).

    Null text: size 0, taken 0. Null source: one more source, after all others. Null ids share one hash, as do repeated rows, and are
    taken together. A source without words gets target 0. Hot sources: sums are partial before every shuffle, and the histogram of a
    source never has more than 4,096 rows.
    """
    added = ["size", "source_size", "target", "taken"]
    base = docs.drop(*added)
    sizes = cut_lineage(base.select("source", n_words("text").alias("size"), place_hash("doc_id").alias("hash")))
    cuts = cut_lineage(thresholds(sizes, source_targets(sizes, weights, share, most)).withColumnRenamed("source", "_s"))
    if cuts.count() <= SENT_SOURCES:
        cuts = F.broadcast(cuts)  # texts then stay where they are
    joined = base.withColumns({"size": n_words("text"), "_hash": place_hash("doc_id")}).join(cuts, F.col("source").eqNullSafe(F.col("_s")), "left")
    more = (F.col("_hash") < F.col("_edge")) | (F.col("_with") & (F.col("_hash") == F.col("_edge")))
    taken = F.col("size") * (F.col("whole") + F.when(more, 1).otherwise(0))
    return joined.withColumn("taken", taken.cast("long")).select(*base.columns, *added)


# The same in DuckDB, with a running sum over hashes in place of histograms.
SQL = r"""
with recursive sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 12) as h
  from documents),
totals as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
placed as (
  select source, source_size, 2.0::double * source_size as cap,
         [3.0::double, 1.0, 2.0][((row_number() over (order by source is null, encode(source)) - 1) % 3 + 1)::int] as w
  from totals),
rounds as (
  select 1 as i, 1.5::double * (select sum(source_size) from placed)::double / (select sum(w) from placed) as level
  union all
  select i + 1, (select (1.5::double * sum(source_size)::double - sum(case when w * r.level > cap then cap else 0.0::double end))
                        / sum(case when w * r.level > cap then 0.0::double else w end) from placed)
  from rounds r where i < 25),
targets as (select source, source_size, least(cap, w * (select level from rounds order by i desc limit 1)) as target from placed),
parts as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end as whole from targets),
cells as (select source, h, sum(size) as n from sized group by all),
run as (
  select source, h, n, sum(n) over (partition by source order by h) as cum from cells),
edge as (
  select r.source, min(r.h) as edge, arg_min(r.cum, r.h) as reach, arg_min(r.cum - r.n, r.h) as base, any_value(p.target - p.whole * p.source_size) as rest
  from run r join parts p on r.source is not distinct from p.source
  where p.target - p.whole * p.source_size > 0 and r.cum >= p.target - p.whole * p.source_size
  group by r.source)
select s.doc_id, cast(s.size as bigint) as size, p.source_size, p.target,
       cast(s.size * (p.whole + case when s.h < e.edge or (s.h = e.edge and e.reach - e.rest < e.rest - e.base) then 1 else 0 end) as bigint) as taken
from sized s join parts p on s.source is not distinct from p.source left join edge e on s.source is not distinct from e.source
"""
