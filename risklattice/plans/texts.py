"""Text and table checks over documents, benchmark, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from risklattice.operators import quality, text_audit
from risklattice.operators import panel as P
from risklattice.plans.base import EV, areas, dense_events, events, features, measures, query, r, table

FIGURE_SQL = r"regexp_extract_all(' ' || text, '(?:^|[^0-9.A-Za-z_])([0-9]+(?:[.,][0-9]+)+|[0-9]{3,})', 1)"
# RE2 has no look-behind; the boundary is consumed instead, in both engines alike.
FIGURE_PATTERN = ["(?:^|[^0-9.A-Za-z_])([0-9]+(?:[.,][0-9]+)+|[0-9]{3,})", "(?:^|[^0-9.A-Za-z_])([0-9]+)[ ]*per cent"]
PERCENT_SQL = "regexp_extract_all(text, '(?:^|[^0-9.A-Za-z_])([0-9]+)[ ]*per cent', 1)"
COMMON = ", ".join(f"'{c}'" for c in quality.COMMON_FIGURES)

CARRIED = f"""
d as (select doc_id, lang, text || ' so ' || (n_chars % 90) || ' per cent' as text from documents),
f0 as (select doc_id, lang, unnest({FIGURE_SQL.replace("' ' || text", "text")} || {PERCENT_SQL}) as figure from d),
f as (select distinct doc_id, lang, figure from f0 where not regexp_matches(replace(figure, ',', ''), '^(19|20)[0-9][0-9]$') and figure not in ({COMMON})),
src as (select distinct figure from f where lang <> 'en'),
st as (select doc_id, figure, printf('%.3f', try_cast(replace(figure, ',', '') as double) / 100) as dec from f where lang = 'en')"""


def with_percentages(docs):
    """Texts that each state one more figure in per cent."""
    return docs.withColumn("text", F.concat("text", F.lit(" so "), (F.col("n_chars") % 90).cast("string"), F.lit(" per cent")))


@query("Q6_U4_uncarried_figures", f"with {CARRIED} select doc_id, figure from st where figure not in (select figure from src) and (dec is null or dec not in (select figure from src))")
def _(spark, sf):
    docs = with_percentages(table(spark, sf, "documents"))
    found = lambda d: quality.figures(d, "doc_id", "text", FIGURE_PATTERN)
    return quality.uncarried_figures(found(docs.filter("lang = 'en'")), found(docs.filter("lang <> 'en'"))).select("doc_id", "figure")


@query("Q6_figures_look_behind", f"with {CARRIED} select doc_id, figure from f")
def _(spark, sf):
    return quality.figures(with_percentages(table(spark, sf, "documents")), "doc_id", "text")


@query("J21_orphans", "with a as (select distinct l_partkey as k from lineitem), b as (select c_custkey as k from customer) select k, 'unresolved' as problem from a where k not in (select k from b) union all select k, 'uncited' from b where k not in (select k from a)")
def _(spark, sf):
    """Part numbers that are no customer number, and the other way round: two key sets of different reach."""
    cited, listed = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("k")), table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    return quality.orphans(cited, listed, "k")


@query("Q4_Q5_expectations", f"with {EV}, c as (select (select count(*) from nation) as areas, (select count(*) from orders) as events, count(*) as placed, count(distinct grp) as groups from ev) select 'areas' as label, 25.0::double as stated, areas::double as computed, 0.0::double as tolerance, areas = 25 as ok from c union all select 'groups', 6.0, groups, 0, abs(groups - 6) <= 0 from c union all select 'placed_share', 1.0, placed / events, 0.001, abs(placed / events - 1) <= 0.001 from c")
def _(spark, sf):
    ev = events(spark, sf)
    total = table(spark, sf, "orders").select(F.count(F.lit(1))).scalar()
    n = areas(spark, sf).select(F.count(F.lit(1))).scalar()
    computed = ev.agg(F.countDistinct("grp").alias("groups"), (F.count(F.lit(1)) / total).alias("placed_share"), n.alias("areas"))
    return quality.expectations(computed, {"areas": 25, "groups": 6, "placed_share": 1}, {"placed_share": 0.001})


@query("Q8_sequence_gaps", "with c as (select conv_id, turn, row_number() over (partition by conv_id order by turn) as expected from conversations) select conv_id, turn, expected from c where turn + 1 <> expected")
def _(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", (F.col("turn") + 1).alias("number"))
    return quality.sequence_gaps(c, "conv_id", ["turn"], "number").select("conv_id", "turn", "expected")


@query("Q8_sequence_gaps_lines", "with c as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, row_number() over (partition by l_orderkey order by l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice) as expected from lineitem) select l_orderkey, l_linenumber, l_partkey, expected from c where l_linenumber <> expected")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber"), "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    out = quality.sequence_gaps(li, "l_orderkey", ["l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"], "l_linenumber")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "expected")


@query("Q11_consolidate", "select lang, md5(text) as text, count(distinct source) as origins, min(source) as first_origin, count(*) as copies from documents group by lang, text")
def _(spark, sf):
    d = table(spark, sf, "documents").select("lang", F.md5("text").alias("text"), "source")
    return quality.consolidate(d, "text", "lang", "source")


@query("Q11_conflicting_keys", "select source, count(distinct text) as texts from documents group by 1 having count(distinct text) > 1")
def _(spark, sf):
    return quality.conflicting_keys(table(spark, sf, "documents").select("source", F.sha2("text", 256).alias("text")), "text", "source")


@query("Q12_letter_suffixes", """
with p as (
  select l_orderkey, l_linenumber, l_partkey, row_number() over (partition by l_returnflag order by l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice) as n,
    count(*) over (partition by l_returnflag) as c from lineitem),
k as (select *, 1 + (n > 26)::int + (n > 702)::int + (n > 18278)::int + (n > 475254)::int as size, [0, 26, 702, 18278, 475254] as shorter from p)
select l_orderkey, l_linenumber, l_partkey, case when c = 1 then '' else array_to_string([chr(cast(97 + ((n - 1 - shorter[size]) // cast(26 ** j as bigint)) % 26 as integer)) for j in range(size - 1, -1, -1)], '') end as suffix from k""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    return quality.letter_suffixes(li, "l_returnflag", ["l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey", "suffix")


@query("Q13_field_mismatches", """
with s as (select l_orderkey, max(l_linestatus) as status, max(cast(l_shipdate as date)) as day from lineitem group by 1),
j as (select o_orderkey, o_orderstatus, cast(o_orderdate as date) as od, status, day from s join orders on l_orderkey = o_orderkey)
select o_orderkey, 'status' as field, o_orderstatus as stated, status as authority from j where o_orderstatus is distinct from status and o_orderstatus <> 'P'
union all select o_orderkey, 'day', cast(od as varchar), cast(day as varchar) from j where od is distinct from day""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("date").alias("day"))
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linestatus").alias("status"), F.max(F.col("l_shipdate").cast("date")).alias("day"))
    departures = o.filter("status = 'P'").select("o_orderkey", F.lit("status").alias("field"))
    return quality.field_mismatches(o, li, "o_orderkey", ["status", "day"], departures)


@query("Q14_introduced_late", "with p as (select doc_id, instr(text, 'the') as s, instr(text, 'The') as l from documents) select doc_id, cast(s as integer) as short_at, cast(l as integer) as long_at, l = 0 or l > s as late from p where s > 0")
def _(spark, sf):
    return quality.introduced_late(table(spark, sf, "documents"), "doc_id", "text", "The", "the")


@query("Q3_frame_difference", f"with w as (select c_custkey, c_acctbal as a, round(c_acctbal, 1) as b from customer) select 'balance' as \"column\", round(max(abs(a - b)), 6) as largest, 0::bigint as null_mismatch, 0::bigint as unmatched_keys, max(abs(a - b)) <= 0.01 as ok from w")
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"))
    out = quality.frame_difference(c, c.withColumn("balance", F.round("balance", 1)), ["c_custkey"], ["balance"], 0.01)
    return out.withColumn("largest", r("largest"))


@query("Q10_non_finite", f"with {EV} select 'severity' as \"column\", count(*) filter (severity is null or isnan(severity)) as bad, max(severity) = min(severity) as constant from ev")
def _(spark, sf):
    return quality.non_finite(events(spark, sf), ["severity"])


FIXED = ("own_ever", "nb_degree", "cal_sin", "cal_cos", "time_index")


@query("Q1_leakage_probe", f"select feature, 0::bigint as leaked_rows, feature not in ({', '.join(repr(c) for c in FIXED)}) as moved from (select unnest([{', '.join(repr(c) for c in P.feature_names())}]) as feature)")
def _(spark, sf):
    """Add ten events to every area of one week and rebuild all 42 features; nothing at or before it may change."""
    from risklattice.operators.graph import symmetric
    from risklattice.plans.base import directed

    ev = events(spark, sf).select("area", "grp", "week", "is_target", "is_op", "severity", "source")
    week = F.lit("1998-01-05").cast("date")
    extra = areas(spark, sf).select("area", "grp", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("_i")).select(
        "area", "grp", week.alias("week"), F.lit(True).alias("is_target"), F.lit(True).alias("is_op"), F.lit(1e6).alias("severity"), F.lit("F").alias("source")
    )
    neighbours = directed(spark, sf)

    def build(e):
        totals = P.weekly_totals(e, measures())
        grid = P.spine(areas(spark, sf).select("area"), *P.week_span(totals))
        return P.panel_features(P.densify(grid, totals, ["events", "ops", "deaths", "taken"]), neighbours, P.record_volume(e))

    probed = quality.leakage_probe(build, ev, ev.unionByName(extra), week, P.feature_names())
    return probed.select("feature", "leaked_rows", (F.col("later_rows") > 0).alias("moved"))


SENTENCES = "[trim(s) for s in string_split_regex(regexp_replace(prose, '([.!?])\\s+([A-Z(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) if trim(s) <> '']"
PROSE = "array_to_string([trim(x) for x in string_split(text, chr(10)) if trim(x) <> '' and not regexp_matches(trim(x), '^(#|\\||!|>)') and not regexp_full_match(trim(x), '(Table|Figure) [0-9]+\\.?') and not (starts_with(trim(x), '*') and ends_with(trim(x), '*'))], chr(10))"
WORDS = "len([w for w in string_split_regex({}, '\\s+') if w <> ''])"


PARAGRAPHS = PROSE[len("array_to_string(") : -len(", chr(10))")]


@query("Q7_text_profile", f"""with p as (select doc_id, text, {PROSE} as prose, {PARAGRAPHS} as paras from documents),
s as (select *, {SENTENCES} as sents, [len({SENTENCES.replace('prose', 'para')}) for para in paras] as plen from p), l as (select *, [{WORDS.format('z')} for z in sents] as lens from s)
select doc_id, len(paras) as paragraphs, cast({WORDS.format('prose')} as bigint) as words, len(sents) as sentences, list_min(lens) as shortest_sentence, list_max(lens) as longest_sentence,
  list_sort(lens)[len(lens) // 2 + 1] as median_sentence, len(list_distinct([string_split_regex(z, '\\s+')[1] for z in sents])) as distinct_openers,
  len([i for i in range(1, len(lens) - 1) if list_max(lens[i:i + 2]) - list_min(lens[i:i + 2]) <= 2]) as even_runs,
  list_min(plen) as shortest_paragraph, list_sort(plen)[len(plen) // 2 + 1] as median_paragraph, list_max(plen) as longest_paragraph,
  len([n for n in plen if n = 1]) as one_sentence_paragraphs, len([n for n in plen if n = 2]) as two_sentence_paragraphs, len([n for n in plen if n >= 7]) as long_paragraphs,
  len(text) - len(replace(text, '—', '')) as em_dashes, len(text) - len(regexp_replace(text, '[“”‘’]', '', 'g')) as curly_quotes,
  len(regexp_replace(text, '[\\x00-\\x7F]+', '', 'g')) as non_ascii, len(prose) - len(replace(prose, ';', '')) as semicolons from l""")
def _(spark, sf):
    p = text_audit.profile(table(spark, sf, "documents"), "doc_id", "text")
    return p.select("doc_id", *[F.col(c).cast("long").alias(c) for c in p.columns if c != "doc_id"])


PHRASES = text_audit.BANNED_WORDS + text_audit.COPULA_SUBSTITUTES + text_audit.CLOSING_RESTATEMENTS
COMMON_SQL = ", ".join(f"'{w}'" for w in text_audit.COMMON_WORDS)
RISKY_SQL = ", ".join(f"'{w}'" for w in text_audit.HIGH_RISK_WORDS)


# Invented prose holds none of the phrases, so one more sentence is added to each text, chosen by its number.
@query("Q7_phrase_hits", f"with ph as (select unnest([{', '.join(f"'{p}'" for p in PHRASES)}]) as phrase), d as (select text || chr(10) || 'It ' || ([{', '.join(f"'{p}'" for p in PHRASES)}])[doc_id % {len(PHRASES)} + 1] || ' once.' || chr(10) || '# Overall, robust' as text from documents), p as (select lower({PROSE}) as prose from d) select phrase, cast(sum((len(prose) - len(replace(prose, phrase, ''))) / len(phrase)) as bigint) as hits from p cross join ph group by 1")
def _(spark, sf):
    chosen = F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("doc_id") % len(PHRASES) + 1).cast("int"))
    docs = table(spark, sf, "documents").withColumn("text", F.concat("text", F.lit("\nIt "), chosen, F.lit(" once.\n# Overall, robust")))
    return text_audit.phrase_hits(docs, "text", PHRASES)


@query("Q7_repeated_words", f"with p as (select doc_id, lower({PROSE}) as prose from documents), w as (select doc_id, unnest(regexp_extract_all(' ' || regexp_replace(prose, '[^\\p{{L}}\\p{{N}}_]+', '  ', 'g') || ' ', ' ([a-z]{{4,}}) ', 1)) as word from p) select doc_id, word, count(*) as n, word in ({RISKY_SQL}) as high_risk from w where word not in ({COMMON_SQL}) group by 1, 2 having count(*) >= 4")
def _(spark, sf):
    return text_audit.repeated_words(table(spark, sf, "documents"), "doc_id", "text")


HEADED_SQL = "regexp_replace(text, '(^|\n)([AEIST])', '\\1## \\2', 'g')"


@query("Q7_sections", f"with h as (select doc_id, {HEADED_SQL} as text from documents), x as (select doc_id, string_split(chr(10) || text, chr(10) || '## ') as parts from h), s as (select doc_id, unnest(parts) as body, unnest(range(0, len(parts))) as section from x), b as (select doc_id, section, string_split(body, chr(10))[1] as title, array_to_string(string_split(body, chr(10))[2:], chr(10)) as text from s where section > 0), p as (select *, {PROSE} as prose from b) select doc_id, cast(section as integer) as section, md5(title) as title, cast({WORDS.format('prose')} as integer) as words from p")
def _(spark, sf):
    """Lines that begin with certain letters are made headings, so that every text has sections."""
    headed = table(spark, sf, "documents").withColumn("text", F.regexp_replace("text", r"(^|\n)([AEIST])", "$1## $2"))
    return text_audit.split_sections(headed, "doc_id", "text").select("doc_id", "section", F.md5("title").alias("title"), "words")


@query("Q7_openers", f"with p as (select {PROSE} as prose from documents), s as (select unnest({SENTENCES}) as s from p) select string_split_regex(s, '\\s+')[1] as opener, count(*) as n from s group by 1")
def _(spark, sf):
    return text_audit.openers(table(spark, sf, "documents"), "text")


@query("Q7_length_distribution", f"with p as (select {PROSE} as prose from documents), s as (select unnest({SENTENCES}) as s from p) select cast({WORDS.format('s')} as integer) as words, count(*) as sentences from s group by 1")
def _(spark, sf):
    return text_audit.length_distribution(table(spark, sf, "documents"), "text")


@query("Q7_section_imbalance", f"with t as (select conv_id, {WORDS.format('text')} as words from conversations) select conv_id, count(*) as sections, round(avg(words), 6) as mean_words, round(max(words) / avg(words), 6) as longest_to_mean, round(min(words) / avg(words), 6) as shortest_to_mean from t group by 1")
def _(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", text_audit.word_count(F.col("text")).alias("words"))
    out = text_audit.section_imbalance(turns, "conv_id")
    return out.withColumns({c: r(c) for c in ("mean_words", "longest_to_mean", "shortest_to_mean")})
