"""Source merging, label matching and placement queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from risklattice.functions import text as T
from risklattice.functions.scalar import in_box
from risklattice.operators import conform, link, ranking, reconcile, resolve, spatial
from risklattice.plans.base import EV, areas, events, query, r, table

# ---- sources

RAW_SQL = """
raw as (
  select o_orderkey, o_orderstatus, cast(cast(o_orderdate as date) as varchar) as day, o_totalprice,
    case when o_orderpriority = '1-URGENT' then ' Banditry ' when o_orderpriority = '2-HIGH' then 'Kidnap Incident' when o_orderpriority = '3-MEDIUM' then 'banditary' else 'Other' end as t2,
    case when o_orderpriority = '5-LOW' then 'GSF Operation ' else 'x' end as t1, c_mktsegment, c_name
  from orders join customer on o_custkey = c_custkey)"""


def raw_orders(spark, sf):
    p = F.col("o_orderpriority")
    second = F.when(p == "1-URGENT", " Banditry ").when(p == "2-HIGH", "Kidnap Incident").when(p == "3-MEDIUM", "banditary").otherwise("Other")
    first = F.when(p == "5-LOW", "GSF Operation ").otherwise("x")
    joined = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select("o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("date").cast("string").alias("day"), "o_totalprice", second.alias("t2"), first.alias("t1"), "c_mktsegment", "c_name")


def general_log(spark, sf):
    raw = raw_orders(spark, sf).filter("o_orderstatus <> 'O'")
    return conform.general_events(raw.select(
        F.col("day").alias("Date of Incident"), F.col("t1").alias("Incident Type"), F.col("t2").alias("Incident Type 2"),
        F.col("c_mktsegment").alias("State"), F.col("c_name").alias("Local Govt Area"), F.lit(None).cast("string").alias("Location"),
        F.col("day").alias("Latitude"), F.lit("7.5").alias("Longitude"), F.col("c_name").alias("Details"),
        F.col("o_totalprice").cast("string").alias("Fatalities"), F.lit("n/a").alias("Kidnap"),
    ))


def specialist(spark, sf):
    raw = raw_orders(spark, sf).filter("o_orderstatus = 'O'")
    return conform.specialist_events(raw.select(
        F.col("day").alias("Date"), F.col("t2").alias("Category"), F.col("c_mktsegment").alias("State"), F.col("c_name").alias("LGA"),
        F.col("c_name").alias("Community (city,town, ward)"), F.col("c_name").alias("Title"), F.col("c_mktsegment").alias("Kidnapper (P)"),
        F.lit(None).cast("double").alias("Latitude"), F.lit(None).cast("double").alias("Longitude"),
        F.lit(None).cast("double").alias("Total Deaths"), F.col("o_totalprice").alias("Kidnapee (V)"),
    ))


GENERAL_SQL = RAW_SQL + """,
g as (
  select cast(day as date) as date, c_mktsegment as state_raw, c_name as lga_raw, cast(null as double) as latitude, 7.5::double as longitude,
    o_totalprice as deaths, cast(null as double) as kidnapped, cast(null as varchar) as perpetrator, 'main' as source_file,
    lower(trim(t2)) in ('banditry', 'kidnap incident') as is_target,
    case when lower(trim(t2)) in ('banditry', 'kidnap incident') then lower(trim(t2)) else 'other' end as category,
    lower(trim(t1)) = 'gsf operation' as is_operation from raw where o_orderstatus <> 'O'),
s as (
  select cast(day as date) as date, c_mktsegment as state_raw, c_name as lga_raw, cast(null as double) as latitude, cast(null as double) as longitude,
    cast(null as double) as deaths, o_totalprice as kidnapped, c_mktsegment as perpetrator, 'additional' as source_file, true as is_target,
    case when lower(trim(t2)) = 'banditary' then 'banditry' else lower(trim(t2)) end as category, false as is_operation from raw where o_orderstatus = 'O'),
m as (select * from g union all select * from s)"""
EVENT_COLUMNS = ["date", "state_raw", "lga_raw", "latitude", "longitude", "deaths", "kidnapped", "perpetrator", "source_file", "is_target", "category", "is_operation"]


@query("P1_P8_general_log", f"with {GENERAL_SQL} select * from g")
def _(spark, sf):
    return general_log(spark, sf).select(*EVENT_COLUMNS)


@query("P2_P7_specialist_file", f"with {GENERAL_SQL} select * from s")
def _(spark, sf):
    return specialist(spark, sf).select(*EVENT_COLUMNS)


@query("U1_merge_sources", f"with {GENERAL_SQL} select source_file, category, count(*) as n, count(deaths) as deaths, count(kidnapped) as kidnapped from m group by 1, 2")
def _(spark, sf):
    merged = conform.merge_sources(general_log(spark, sf).drop("perpetrator"), specialist(spark, sf))
    return merged.groupBy("source_file", "category").agg(F.count(F.lit(1)).alias("n"), F.count("deaths").alias("deaths"), F.count("kidnapped").alias("kidnapped"))


@query("P12_P13_period_flags", f"with {GENERAL_SQL} select in_model_period, is_burn_in, count(*) as n from (select coalesce(date between date '1996-01-01' and (select max(date) from m where is_target), false) as in_model_period, coalesce(date < date '1996-01-01', false) as is_burn_in from m) group by 1, 2")
def _(spark, sf):
    merged = conform.merge_sources(general_log(spark, sf), specialist(spark, sf))
    return conform.period_flags(merged, "1996-01-01").groupBy("in_model_period", "is_burn_in").agg(F.count(F.lit(1)).alias("n"))


@query("P16_row_id", "select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) - 1 as row_id from orders")
def _(spark, sf):
    return conform.add_row_id(table(spark, sf, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "row_id")


@query("P9_bounding_box", "select o_orderkey, coalesce(o_orderkey / 1000.0::double between 2 and 14 and o_totalprice / 10000 between 4 and 15, false) as usable from orders")
def _(spark, sf):
    o = table(spark, sf, "orders").withColumns({"lon": F.col("o_orderkey") / 1000.0, "lat": F.col("o_totalprice") / 10000})
    return o.select("o_orderkey", in_box("lon", "lat", (2, 4, 14, 15)).alias("usable"))


# ---- keys and words

FOLD_SQL = "regexp_replace(lower(strip_accents(replace(text, 'ß', 'ss'))), '[^a-z0-9]', '', 'g')"
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ", '']"
WORDS_SQL = f"[w for w in list_distinct(string_split_regex(trim(regexp_replace(lower(text), '[^a-z ]', ' ', 'g')), ' +')) if not list_contains({STOP_SQL}, w)]"


@query("P5_F1_normalise", f"select doc_id, length({FOLD_SQL}) as n, md5({FOLD_SQL}) as key from documents")
def _(spark, sf):
    d = table(spark, sf, "documents").withColumn("key", T.normalise_key("text", "ascii"))
    return d.select("doc_id", F.length("key").cast("long").alias("n"), F.md5("key").alias("key"))


@query("P5_ascii_key", "select c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') as key from customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", T.ascii_key("c_name").alias("key"))


@query("P6_canonical", "select c_custkey, case lower(c_mktsegment) when 'machinery' then 'industry' when 'building' then 'industry' else lower(c_mktsegment) end as key from customer")
def _(spark, sf):
    key = T.canonical(T.ascii_key("c_mktsegment"), {"machinery": "industry", "building": "industry"})
    return table(spark, sf, "customer").select("c_custkey", key.alias("key"))


@query("P14_content_words", f"with w as (select doc_id, list_sort({WORDS_SQL}) as w from documents) select doc_id, len(w) as n, md5(array_to_string(w, ' ')) as words from w")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.array_sort(T.content_words("text")).alias("w"))
    return d.select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.concat_ws(" ", "w")).alias("words"))


@query("F8_containment", f"with w as (select conv_id, turn, {WORDS_SQL} as w from conversations) select a.conv_id, a.turn, round(len(list_intersect(a.w, b.w))::double / nullif(len(a.w), 0), 6) as share from w a join w b on a.conv_id = b.conv_id and b.turn = a.turn + 1")
def _(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", T.content_words("text").alias("w"))
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("w2"))
    return c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", r(T.containment(F.col("w"), F.col("w2"))).alias("share"))


# ---- labels onto a closed list: parts by type are the reference, spellings on line items the labels

LABEL_SQL = """
ref0 as (select regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') as group_key, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') as name_key, p_partkey as code, p_name from part),
ref as (select group_key, name_key, min(code) as code, arg_min(p_name, code) as official_name from ref0 group by 1, 2),
lab0 as (
  select regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') as group_key, case l_linenumber when 1 then p_name when 2 then replace(p_name, 'e', '') when 3 then upper(replace(p_name, ' ', '-')) when 4 then p_name || 's'
    when 5 then substr(p_name, 2) when 6 then reverse(p_name) else 'special lot' end as label
  from lineitem join part on l_partkey = p_partkey),
lab as (select group_key, regexp_replace(lower(label), '[^a-z0-9]', '', 'g') as name_key, count(*) as records from lab0 group by 1, 2),
man as (select group_key, 'speciallot' as name_key, code, official_name from ref where code = (select min(code) from ref r where r.group_key = ref.group_key)),
base as (
  select lab.*, m.code as mc, e.code as ec from lab left join man m using (group_key, name_key) left join ref e using (group_key, name_key)),
sc as (
  select b.group_key, b.name_key, r.code, 1 - levenshtein(b.name_key, r.name_key)::double / greatest(length(b.name_key), length(r.name_key)) as score
  from base b join ref r using (group_key) where mc is null and ec is null),
bst as (select group_key, name_key, arg_min(code, (-score, code)) as code, max(score) as score from sc group by 1, 2),
xw as (
  select b.group_key, b.name_key, b.records, coalesce(mc, ec, case when s.score >= 0.88 then s.code end) as code,
    case when mc is not null then 'manual' when ec is not null then 'exact' when s.score >= 0.88 then 'fuzzy' else 'unmatched' end as match_type,
    case when mc is not null or ec is not null then 1.0::double else round(coalesce(s.score, 0), 4) end as score
  from base b left join bst s using (group_key, name_key))"""


def part_reference(spark, sf):
    return reconcile.spellings(table(spark, sf, "part").select("p_partkey", "p_type", "p_name"), T.ascii_key("p_type"), T.ascii_key, "p_name", "p_partkey")


def part_labels(spark, sf):
    li = table(spark, sf, "lineitem").select("l_partkey", "l_linenumber")
    joined = li.join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    n = F.col("l_linenumber")
    label = (
        F.when(n == 1, F.col("p_name")).when(n == 2, F.replace("p_name", F.lit("e"), F.lit(""))).when(n == 3, F.upper(F.replace("p_name", F.lit(" "), F.lit("-"))))
        .when(n == 4, F.concat("p_name", F.lit("s"))).when(n == 5, F.substring("p_name", 2, 1000)).when(n == 6, F.reverse("p_name")).otherwise("special lot")
    )
    raw = reconcile.distinct_labels(joined.select(F.col("p_type").alias("grp"), label.alias("label")), "grp", "label")
    return raw.groupBy(T.ascii_key("grp").alias("group_key"), T.ascii_key("label").alias("name_key")).agg(F.sum("records").alias("records"))


def overrides(reference):
    first = reference.groupBy("group_key").agg(F.min("code").alias("code"), F.min_by("official_name", "code").alias("official_name"))
    return first.withColumn("name_key", F.lit("speciallot"))


def part_crosswalk(spark, sf, score):
    reference = part_reference(spark, sf)
    return reconcile.crosswalk(part_labels(spark, sf), reference, overrides(reference), score=score)


@query("J1_J2_J3_crosswalk_edit", f"with {LABEL_SQL} select group_key, name_key, records, code, match_type, score from xw")
def _(spark, sf):
    return part_crosswalk(spark, sf, T.edit_ratio).select("group_key", "name_key", "records", "code", "match_type", "score")


@query("J3_F7_crosswalk_blocks")
def _(spark, sf):
    return part_crosswalk(spark, sf, T.matching_blocks_ratio).select("group_key", "name_key", "records", "code", "match_type", "score")


@query("A33_match_report", f"with {LABEL_SQL} select match_type, count(*) as labels, cast(sum(records) as bigint) as records, round(sum(records)::double / (select sum(records) from xw), 6) as record_share from xw group by 1")
def _(spark, sf):
    return reconcile.match_report(part_crosswalk(spark, sf, T.edit_ratio)).withColumn("record_share", r("record_share"))


@query("T1_sorted_crosswalk", f"with {LABEL_SQL} select group_key, name_key, records from xw order by group_key, records desc, name_key")
def _(spark, sf):
    return part_crosswalk(spark, sf, T.edit_ratio).select("group_key", "name_key", "records").orderBy("group_key", F.col("records").desc(), "name_key")


@query("T2_top_unmatched", f"with {LABEL_SQL} select group_key, name_key, records from xw where match_type = 'unmatched' order by records desc, group_key, name_key limit 20")
def _(spark, sf):
    x = part_crosswalk(spark, sf, T.edit_ratio).filter("match_type = 'unmatched'").select("group_key", "name_key", "records")
    return x.orderBy(F.col("records").desc(), "group_key", "name_key").limit(20)


@query("P15_spellings", """
with s as (select regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') as group_key, unnest([{'place': 0, 'n': p_name}, {'place': 1, 'n': p_type}]) as s, p_partkey as code, p_name from part),
k as (select group_key, regexp_replace(lower(s.n), '[^a-z0-9]', '', 'g') as name_key, s.place as place, code, p_name from s)
select group_key, name_key, arg_min(code, (place, code)) as code, arg_min(p_name, (place, code)) as official_name, min(place) as place from k group by 1, 2""")
def _(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_name", "p_type")
    return reconcile.spellings(part, T.ascii_key("p_brand"), T.ascii_key, "p_(name|type)", "p_partkey")


@query("J4_fallback_lookup", "select o_orderkey, coalesce(a.c_name, 'nation ' || b.c_nationkey) as label from orders left join (select * from customer where c_acctbal > 5000) a on a.c_custkey = o_custkey left join customer b on b.c_custkey = o_custkey")
def _(spark, sf):
    c = table(spark, sf, "customer")
    first = c.filter("c_acctbal > 5000").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("label"))
    second = c.select(F.col("c_custkey").alias("key"), F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")).alias("label"))
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("key"))
    return reconcile.lookup_with_fallback(o, first, second, ["key"], ["label"]).select("o_orderkey", "label")


@query("J17_attach_counts", "select c_custkey, coalesce(n, 0) as records from customer left join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey")
def _(spark, sf):
    counts = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("records"))
    return reconcile.attach_counts(table(spark, sf, "customer").select("c_custkey"), counts, ["c_custkey"])


@query("J23_candidate_state", "select c_custkey, coalesce(n, 0) as candidates, case when n is null then 'missing' when n = 1 then 'resolved' else 'ambiguous' end as state from customer left join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey")
def _(spark, sf):
    candidates = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return reconcile.candidate_state(table(spark, sf, "customer").select("c_custkey"), candidates, ["c_custkey"])


# ---- duplicates between two sources of documents (sources src0-src9 and the rest), blocked by language and first word

LINK_SQL = f"""
w as (select doc_id, lang, string_split(text, ' ')[1] as opener, regexp_matches(source, '^src[0-9]$') as is_main, {WORDS_SQL} as w from documents),
pr as (
  select a.doc_id as add_id, m.doc_id as main_id, len(list_intersect(a.w, m.w))::double / len(a.w) as score
  from w a join w m on a.lang = m.lang and a.opener = m.opener and not a.is_main and m.is_main and len(a.w) > 0),
lk as (select add_id, arg_min(main_id, (-score, main_id)) as main_id, max(score) as score from pr where score >= 0.6 group by 1)"""


def sources(spark, sf):
    d = table(spark, sf, "documents").withColumn("opener", F.split("text", " ")[0])
    main = F.col("source").rlike("^src[0-9]$")
    return d.filter(main).withColumnRenamed("doc_id", "main_id"), d.filter(~main).withColumnRenamed("doc_id", "add_id")


def linked(spark, sf):
    main, extra = sources(spark, sf)
    return link.find_duplicates(extra, main, ["lang", "opener"], "text", "text")


@query("J5_find_duplicates", f"with {LINK_SQL} select add_id, main_id, round(score, 6) as score from lk")
def _(spark, sf):
    return linked(spark, sf).withColumn("score", r("score"))


@query("J6_drop_linked", f"with {LINK_SQL} select doc_id as add_id, lang from w where not is_main and doc_id not in (select add_id from lk)")
def _(spark, sf):
    return link.drop_linked(sources(spark, sf)[1].select("add_id", "lang"), linked(spark, sf))


ENRICH_SQL = LINK_SQL + """,
mn as (select d.doc_id as main_id, quality, toxic from documents d left join labels using (doc_id) where regexp_matches(source, '^src[0-9]$')),
dn as (select main_id, arg_min(quality, add_id) filter (quality is not null) as q, arg_min(toxic, add_id) filter (toxic is not null) as x from lk left join labels on doc_id = add_id group by 1),
en as (select main_id, coalesce(quality, q) as quality, coalesce(toxic, x) as toxic, quality is null and q is not null as quality_filled, toxic is null and x is not null as toxic_filled from mn left join dn using (main_id))"""


def enriched(spark, sf):
    main, extra = sources(spark, sf)
    labels = table(spark, sf, "labels")
    m = main.select("main_id").join(labels.withColumnRenamed("doc_id", "main_id"), "main_id", "left")
    a = extra.select("add_id").join(labels.withColumnRenamed("doc_id", "add_id"), "add_id", "left")
    return link.enrich(m, a, linked(spark, sf), ["quality", "toxic"])


@query("J7_donor_enrichment", f"with {ENRICH_SQL} select main_id, quality, toxic, quality_filled, toxic_filled from en")
def _(spark, sf):
    return enriched(spark, sf).select("main_id", "quality", "toxic", "quality_filled", "toxic_filled")


@query("J7_fill_counts", f"with {ENRICH_SQL} select count(*) filter (quality_filled) as quality, count(*) filter (toxic_filled) as toxic from en")
def _(spark, sf):
    return link.fill_counts(enriched(spark, sf), ["quality", "toxic"])


# ---- placement: the customer's nation is what the name says, the supplier's what the coordinate says

EVIDENCE_SQL = """
e as (
  select l_orderkey, l_linenumber, cn.n_regionkey as declared, cn.n_name as declared_name, case when l_returnflag <> 'R' then s_nationkey end as geo_code, sn.n_regionkey as geo_group, sn.n_name as geo_name,
    case when l_quantity > 10 then c_nationkey end as name_code, case when l_tax > 0.02 then cn.n_regionkey else -1 end as name_group
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation cn on c_nationkey = cn.n_nationkey
    join supplier on l_suppkey = s_suppkey join nation sn on s_nationkey = sn.n_nationkey),
b as (
  select *, case when geo_code is not null and name_code is not null then
      case when geo_code = name_code then 'agree' when geo_group = declared then 'conflict_kept_geometry' when name_group = declared then 'conflict_kept_name' else 'conflict_unresolved' end
    when geo_code is not null then 'geometry_only' when name_code is not null then 'name_only' else 'none' end as basis from e),
c as (select *, case when basis in ('agree', 'conflict_kept_geometry', 'geometry_only') then geo_code when basis in ('conflict_kept_name', 'name_only') then name_code end as code from b)"""


def evidence(spark, sf):
    n = areas(spark, sf)
    cust = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("area")).select("c_custkey", "c_nationkey", F.col("grp").alias("declared"), F.col("name").alias("declared_name"))
    supp = table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("area")).select("s_suppkey", "s_nationkey", F.col("grp").alias("geo_group"), F.col("name").alias("geo_name"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_quantity", "l_tax")
    rows = li.join(supp, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(cust, F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.withColumns({
        "geo_code": F.when(F.col("l_returnflag") != "R", F.col("s_nationkey")), "name_code": F.when(F.col("l_quantity") > 10, F.col("c_nationkey")),
        "name_group": F.when(F.col("l_tax") > 0.02, F.col("declared")).otherwise(-1),
    })
    return resolve.reconcile_evidence(rows, "declared", "geo_code", "geo_group", "name_code", "name_group")


@query("J20_evidence", f"with {EVIDENCE_SQL} select l_orderkey, l_linenumber, basis, code from c")
def _(spark, sf):
    return evidence(spark, sf).select("l_orderkey", "l_linenumber", "basis", "code")


@query("A34_conflict_pairs", f"with {EVIDENCE_SQL} select declared_name, geo_name, count(*) as n from c where starts_with(basis, 'conflict') group by 1, 2 order by n desc, 1, 2 limit 8")
def _(spark, sf):
    return resolve.conflict_pairs(evidence(spark, sf), "declared_name", "geo_name")


GAZ_SQL = f"""
g0 as (select regexp_extract(url, '//(?:[a-z]+\\.)?([a-z]+)\\.example', 1) as name_key, regexp_extract(url, '/(en|fr|de|es)(?:/|$)', 1) as group_key, page_id from pages),
g as (select name_key, group_key, min(page_id) as code from g0 where name_key <> '' and group_key <> '' and length(name_key) >= 5 group by 1, 2),
d as (select doc_id, lang, {FOLD_SQL} as blob from documents),
h as (select doc_id, code, name_key from d join g on group_key = lang and contains(blob, name_key))"""


@query("J11_T5_gazetteer", f"with {GAZ_SQL} select doc_id, arg_min(code, (-length(name_key), code)) as code, arg_min(name_key, (-length(name_key), code)) as name_key from h group by 1")
def _(spark, sf):
    pages = table(spark, sf, "pages")
    names = pages.select(F.regexp_extract("url", r"//(?:[a-z]+\.)?([a-z]+)\.example", 1).alias("name_key"), F.regexp_extract("url", "/(en|fr|de|es)(?:/|$)", 1).alias("group_key"), "page_id")
    names = names.filter("name_key <> '' and group_key <> ''")
    gaz = ranking.first_value(names, ["name_key", "group_key"], F.col("page_id"), ["page_id"]).select("name_key", "group_key", F.col("page_id").alias("code"), F.col("page_id").alias("place"))
    docs = table(spark, sf, "documents").select("doc_id", "lang", T.normalise_key("text", "ascii").alias("blob"))
    return resolve.gazetteer_match(docs, gaz, "doc_id", "lang", ["blob"]).select("doc_id", "code", "name_key")


# ---- geometry: nations and parts as squares on a lattice, orders as points

def square(x, y, side):
    p = lambda a, b: F.array(a, b)
    return F.array(F.array(p(x, y), p(x + side, y), p(x + side, y + side), p(x, y + side)))


@query("J8_J9_locate", """
with b as (select n_nationkey as code, (n_nationkey % 5)::double as x0, floor(n_nationkey / 5)::double as y0 from nation),
p as (select o_orderkey, (o_orderkey % 1300) / 250.0::double - 0.1::double as x, (o_custkey * 7 % 1300) / 250.0::double - 0.1::double as y from orders),
k as (
  select o_orderkey, code, x > x0 and x < x0 + 1 and y > y0 and y < y0 + 1 as inside,
    sqrt(power(greatest(x0 - x, x - x0 - 1, 0), 2) + power(greatest(y0 - y, y - y0 - 1, 0), 2)) as gap
  from p join b on x between x0 - 1 and x0 + 2 and y between y0 - 1 and y0 + 2),
o as (select o_orderkey, arg_min(code, (case when inside then 0 else 1 end, case when inside then 0 else gap end, code)) as code, max(inside::int) as i from k where inside or gap <= 0.025 group by 1)
select p.o_orderkey, code, case when i = 1 then 'inside' when i = 0 then 'snapped' else 'outside' end as how from p left join o using (o_orderkey)""")
def _(spark, sf):
    n = table(spark, sf, "nation")
    polygons = n.select(F.col("n_nationkey").alias("code"), square((F.col("n_nationkey") % 5).cast("double"), F.floor(F.col("n_nationkey") / 5).cast("double"), F.lit(1.0)).alias("rings"))
    points = table(spark, sf, "orders").select("o_orderkey", ((F.col("o_orderkey") % 1300) / 250.0 - 0.1).alias("x"), ((F.col("o_custkey") * 7 % 1300) / 250.0 - 0.1).alias("y"))
    return spatial.locate(points, polygons, 0.125).select("o_orderkey", "code", "how")


@query("J10_adjacency", """
with b as (select p_partkey as code, (p_partkey % 64)::double as x0, floor(p_partkey / 64)::double as y0, 1 - (p_size % 3) * 0.0015::double as side from part)
select a.code as a, z.code as b from b a join b z on a.code < z.code
  and greatest(z.x0 - a.x0 - a.side, a.x0 - z.x0 - z.side, 0) < 0.01 and greatest(z.y0 - a.y0 - a.side, a.y0 - z.y0 - z.side, 0) < 0.01
where sqrt(power(greatest(z.x0 - a.x0 - a.side, a.x0 - z.x0 - z.side, 0), 2) + power(greatest(z.y0 - a.y0 - a.side, a.y0 - z.y0 - z.side, 0), 2)) <= 0.002""")
def _(spark, sf):
    p = table(spark, sf, "part")
    side = F.lit(1.0) - (F.col("p_size") % 3) * 0.0015
    polygons = p.select(F.col("p_partkey").alias("code"), square((F.col("p_partkey") % 64).cast("double"), F.floor(F.col("p_partkey") / 64).cast("double"), side).alias("rings"))
    return spatial.adjacency(polygons, 1.0)


@query("D12_nearest_target", """
with c as (select c_custkey as area, (c_custkey * 13 % 350 - 175)::double as x, (c_custkey * 7 % 179 - 89)::double as y, c_acctbal from customer),
k as (
  select a.area, 2 * 6371.0088::double * asin(sqrt(least(1, power(sin(radians(b.y - a.y) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * power(sin(radians(b.x - a.x) / 2), 2)))) as km
  from c a join c b on a.area <> b.area and b.c_acctbal > 9500)
select area, round(min(km), 4) as km from k group by area""")
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("area"), (F.col("c_custkey") * 13 % 350 - 175).cast("double").alias("x"), (F.col("c_custkey") * 7 % 179 - 89).cast("double").alias("y"), "c_acctbal")
    return spatial.nearest_target(c, c.filter("c_acctbal > 9500"), 5.0).select("area", r("km", 4).alias("km"))
