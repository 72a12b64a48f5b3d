"""Registered queries of the scalar text functions, each called on a column of the driver's tables, and SQL for the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import evaluation as E
from ..operators import grounding as G
from ..operators import matching as M
from ..operators import quality as Q
from ..operators import review
from ..operators import rules as R
from ..sources import files, models, sinks
from .registry import sound_sql, plain, query, read, spread


@query(r"select doc_id, regexp_matches(text, '[\x{0900}-\x{09FF}]') as indic, len(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+'))::int as tokens, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+')[1] as first from documents")
def native_tokens(spark, sf_dir):
    t = X.native_tokens(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", X.has_indic(F.col("text")).alias("indic"), F.size(t).alias("tokens"), F.get(t, F.lit(0)).alias("first"))


@query(f"""
with n as (select p_partkey as id, replace({plain('p_name')}, ' ', '') as s from part), k as (select id, {sound_sql('s')} as key from n)
select id, key, left(key, 1) || translate(substr(key, 2), 'aeiou', '') as bones from k""")
def phonetic_keys(spark, sf_dir):
    key = X.phonetic_key(F.replace(X.normalize_ascii(F.col("p_name")), F.lit(" "), F.lit("")))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), key.alias("key"), X.skeleton(key).alias("bones"))


@query(r"""
select conv_id, turn, regexp_replace(role || ': ' || text || chr(10) || 'Dr Who said : yes', '(?m)^[^\S\n]*(?:[^\s:：]{1,20}[^\S\n]+){0,2}[^\s:：]{1,20}[^\S\n]*[:：][^\S\n]*', '', 'g') as said from conversations""")
def speaker_labels(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", X.strip_speaker_labels(F.concat("role", F.lit(": "), "text", F.lit("\nDr Who said : yes"))).alias("said"))


_CODES = " ".join(f"when '{k}' then '{v}'" for k, v in models.LANGUAGES.items())


@query(f"""
with n as (select p_partkey as id, case p_partkey % 5 when 0 then ' English' when 1 then 'HINDI ' when 2 then 'bangla' when 3 then 'bn' else 'Klingon' end as l from part)
select id, case lower(trim(l)) {_CODES} else lower(trim(l)) end as code from n""")
def language_codes(spark, sf_dir):
    named = F.array(*[F.lit(x) for x in (" English", "HINDI ", "bangla", "bn", "Klingon")])
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), models.language_code(F.get(named, (F.col("p_partkey") % 5).cast("int"))).alias("code"))


_CLEAN = r"""trim(regexp_replace(trim(regexp_replace(translate({0}, '“”‘’', '""'''''), '\s+', ' ', 'g')), '^["'']+|["'']+$', '', 'g'))"""


@query(f"select p_partkey as id, {_CLEAN.format("'  “' || p_name || '”  ' || p_type || ' ‘'")} as cell from part")
def clean_cells(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), X.clean_cell(F.concat(F.lit("  “"), "p_name", F.lit("”  "), "p_type", F.lit(" ‘"))).alias("cell"))


@query(rf"""
with c as (select p_partkey as id, p_name || ' (H) / ' || p_brand || ', also ' || p_type || ' (' || lower(p_type) || '; e.g. ' || p_size || ') or kind; ' || p_name as c from part),
x as (select id, regexp_replace(c, '\((?:H|B)\)|\be\.g\.,?', ' ', 'g') as x from c),
p as (select id, list_concat(string_split_regex(regexp_replace(x, '\([^()]*\)', ' ', 'g'), '\s+/\s+|[,;]|\s+or\s+'), flatten(list_transform(regexp_extract_all(x, '\(([^()]+)\)', 1), lambda i: string_split_regex(i, '\s+/\s+|[,;]|\s+or\s+')))) as ps from x),
t as (select id, list_transform(ps, lambda p: trim(regexp_replace({_CLEAN.format('p')}, '(?i)^(?:graded|also|incl\.?|including)\s+', ''))) as ps from p),
u as (select id, unnest(ps) as a, unnest(range(0, len(ps))) as i from t)
select id, a as alias, (row_number() over (partition by id order by min(i)) - 1)::int as place from u where length(a) between 1 and 60 group by id, a""")
def alias_cells(spark, sf_dir):
    cell = F.concat("p_name", F.lit(" (H) / "), "p_brand", F.lit(", also "), "p_type", F.lit(" ("), F.lower("p_type"), F.lit("; e.g. "), F.col("p_size").cast("string"), F.lit(") or kind; "), "p_name")
    d = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.posexplode(X.split_aliases(cell)).alias("k", "alias"))
    return d.select("id", "alias", F.col("k").alias("place"))


@query("""
with n as (select p_partkey as id, p_name || ' (' || upper(left(p_type, 3)) || ')' as a, p_name || ' (' || lower(p_type) || ')' as b, p_name || ' / ' || p_type as c from part),
u as (select id, unnest([a, b, c]) as name from n),
v as (select id, name, trim(regexp_replace(name, '\\s*\\([^()]*\\)\\s*$', '')) as head, regexp_extract(name, '\\(([^()]*)\\)\\s*$', 1) as tail, trim(regexp_replace(regexp_replace(name, '\\([^()]*\\)', ' ', 'g'), '\\s+', ' ', 'g')) as bare, trim(regexp_replace(translate(name, '()', '  '), '\\s+', ' ', 'g')) as whole from u),
w as (select id, name, list_concat([name, head, case when regexp_matches(tail, '[A-Z]{2}') or len(string_split(trim(tail), ' ')) >= 2 then tail end, bare, whole], list_transform(string_split_regex(name, '\\s+/\\s+'), lambda p: trim(p))) as vs from v)
select distinct id, name, unnest(list_filter(vs, lambda p: p is not null and length(p) >= 2)) as variant from w""")
def name_variants(spark, sf_dir):
    kinds = F.array(F.concat("p_name", F.lit(" ("), F.upper(F.left("p_type", F.lit(3))), F.lit(")")), F.concat("p_name", F.lit(" ("), F.lower("p_type"), F.lit(")")), F.concat("p_name", F.lit(" / "), "p_type"))
    p = spread(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_type"), "id")
    d = p.select("id", F.explode(kinds).alias("name")).distinct()  # variants of a name are distinct
    return d.select("id", "name", F.explode(X.name_variants(F.col("name"))).alias("variant"))


_GENERIC = ", ".join(f"'{w}'" for w in X.GENERIC)
_CATEGORIES = ("medicine", "disease", "sign", "test")


@query(f"""
with w as (select distinct unnest(string_split_regex(text, '\\s+')) as a from documents), p as (select distinct p_name as a from part union select distinct '(' || p_brand || ')' from part),
c as (select a, case length(a) % 4 when 0 then 'medicine' when 1 then 'disease' when 2 then 'sign' else 'test' end as category, trim(translate(a, '()', '')) as x from (select a from w union select a from p))
select a as alias, category, x <> '' and lower(x) not in ({_GENERIC}) and case when category = 'medicine' then length(x) >= 3 when regexp_matches(x, '\\s') then true when regexp_matches(x, '[A-Z]{{2}}|[0-9]') then length(x) >= 2 else length(x) >= 5 end as useful from c""")
def useful_aliases(spark, sf_dir):
    """Every word of the documents and every name and brand as an alias."""
    words = read(spark, sf_dir, "documents").select(F.explode(F.split("text", r"\s+")).alias("a"))
    part = read(spark, sf_dir, "part")
    a = words.unionByName(part.select(F.col("p_name").alias("a"))).unionByName(part.select(F.concat(F.lit("("), "p_brand", F.lit(")")).alias("a"))).distinct()
    d = a.select(F.col("a").alias("alias"), F.get(F.array(*map(F.lit, _CATEGORIES)), F.length("a") % 4).alias("category"))
    return d.withColumn("useful", X.useful_alias(F.col("alias"), F.col("category")))


@query("""
select p_partkey as id, '"' || p_name || '"' as one, '“' || p_type || '”' as two, p_name || ' drops' as first_word, p_name || ' disease' as disease from part""")
def alias_sources(spark, sf_dir):
    """Quoted phrases of a cell, the first word of a medicine, and a disease without that word; put together again."""
    p = read(spark, sf_dir, "part")
    quoted = X.split_colloquial(F.concat(F.lit('"'), "p_name", F.lit('" ; “'), "p_type", F.lit("”")))
    first = F.concat(F.get(X.extra_aliases(F.concat(F.lit("Medicine "), "p_name"), F.lit("medicine")), F.lit(0)), F.lit(""))
    disease = F.get(X.extra_aliases(F.concat("p_name", F.lit(" disease")), F.lit("disease")), F.lit(0))
    d = p.select(F.col("p_partkey").alias("id"), quoted.alias("q"), first.alias("f"), disease.alias("d"), "p_name")
    return d.select("id", F.concat(F.lit('"'), F.get("q", F.lit(0)), F.lit('"')).alias("one"), F.concat(F.lit("“"), F.get("q", F.lit(1)), F.lit("”")).alias("two"),
                    F.when(F.col("f") == "Medicine", F.concat("p_name", F.lit(" drops"))).alias("first_word"), F.concat("d", F.lit(" disease")).alias("disease"))


_QUOTE_STOP = "('the', 'and', 'with', 'for', 'was', 'are', 'has', 'have', 'that', 'this', 'from')"


@query(f"""
with n as (select item_id, {plain("text || ' in the right eye oedema'")} as s from benchmark)
select item_id, len(list_filter(string_split(s, ' '), lambda w: length(w) >= 3 and w not in {_QUOTE_STOP}))::int as content,
  trim(regexp_replace(array_to_string(list_filter(string_split(replace(replace(s, 'oedema', 'edema'), 'haemorrh', 'hemorrh'), ' '), lambda w: w not in ('in', 'of', 'the', 'right', 'left', 'both', 'eye', 'eyes', 're', 'le', 'be')), ' '), ' +', ' ', 'g')) as spelled from n""")
def spelled_findings(spark, sf_dir):
    s = X.normalize_ascii(F.concat("text", F.lit(" in the right eye oedema")))
    return read(spark, sf_dir, "benchmark").select("item_id", F.size(G.content_words(s)).alias("content"), X.spell(s).alias("spelled"))


@query("""
with d as (select conv_id, turn, case when turn % 3 = 0 then repeat(left(text, 41) || ' ', 60) when turn % 3 = 1 then repeat(text || ' ', 3) else text end as t from conversations),
e as (select *, right(t, 1200) as tail from d)
select conv_id, turn, length(t) >= 1500 and (
  (length(t) >= 1500 and len(list_filter(range(1, length(tail) - 38), lambda i: substr(tail, i, 40) = right(t, 40))) >= 15) or (length(t) >= 1500 and len(list_filter(range(1, length(tail) - 78), lambda i: substr(tail, i, 80) = right(t, 80))) >= 7)
  or (length(t) >= 1500 and len(list_filter(range(1, length(tail) - 158), lambda i: substr(tail, i, 160) = right(t, 160))) >= 3)) as looping from e""")
def looping_answers(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    t = F.when(F.col("turn") % 3 == 0, F.repeat(F.concat(F.left("text", F.lit(41)), F.lit(" ")), 60)).when(F.col("turn") % 3 == 1, F.repeat(F.concat("text", F.lit(" ")), 3)).otherwise(F.col("text"))
    return c.select("conv_id", "turn", t.alias("t")).select("conv_id", "turn", X.is_looping(F.col("t")).alias("looping"))


@query("select event_id, floor(greatest(0.0, least(1.0, (value - 10) / 20)) * 1000 + 1e-6)::int as clamped from events where value is not null")
def clamped_values(spark, sf_dir):
    e = read(spark, sf_dir, "events").where("value is not null")
    return e.select("event_id", F.floor(X.clamp((F.col("value") - 10) / 20) * 1000 + 1e-6).cast("int").alias("clamped"))


@query("""
with s as (select user_id, -value / 20 as lp, event_type || repeat('x', (event_id % 7)::int) as text from events where value is not null),
c as (select user_id, sum(exp(lp) * length(text)) / sum(length(text)) as p, sum(case when exp(lp) < 0.5 then length(text) else 0 end) as low, sum(length(text)) as n from s group by user_id)
select user_id, round(p * 1000)::int as confidence, (low * 1000 // n)::int as low_share from c""")
def segment_confidences(spark, sf_dir):
    e = read(spark, sf_dir, "events").where("value is not null")
    s = e.select(F.col("user_id").alias("id"), (-F.col("value") / 20).alias("avg_logprob"), F.concat("event_type", F.repeat(F.lit("x"), (F.col("event_id") % 7).cast("int"))).alias("text"))
    c = files.segment_confidence(s)
    return c.select(F.col("id").alias("user_id"), F.round(F.col("confidence") * 1000).cast("int").alias("confidence"), F.floor(F.col("low_ratio") * 1000 + 1e-9).cast("int").alias("low_share"))


@query(r"""
with s as (select conv_id, turn, case turn % 4 when 0 then repeat(left(text, 20) || '. ', 5) when 1 then '  ' when 2 then text else null end as english, case conv_id % 3 when 0 then 'bn' when 1 then 'hi' else 'en' end as lang from conversations),
p as (select *, list_filter(string_split_regex(lower(english), '[.?!]\s*'), lambda x: x <> '') as ps from s)
select conv_id, turn, case when coalesce(trim(english), '') = '' then 'off' when len(ps) >= 4 and len(list_distinct(ps)) * 10 < len(ps) * 7 then 'loopy' when lang = 'bn' then 'rejected' else 'use' end as policy from p""")
def translation_policy(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    english = F.when(F.col("turn") % 4 == 0, F.repeat(F.concat(F.left("text", F.lit(20)), F.lit(". ")), 5)).when(F.col("turn") % 4 == 1, "  ").when(F.col("turn") % 4 == 2, F.col("text"))
    lang = F.when(F.col("conv_id") % 3 == 0, "bn").when(F.col("conv_id") % 3 == 1, "hi").otherwise("en")
    return c.select("conv_id", "turn", models.translation_for_llm(english, lang).alias("policy"))


@query(r"""
with p as (select p_partkey as id, p_name as a, p_type || ' ' || p_name as b from part), n as (select id, regexp_replace(lower(a), '[^a-z0-9]+', '', 'g') as a, regexp_replace(lower(b), '[^a-z0-9]+', '', 'g') as b from p)
select id, (levenshtein(a, b) * 1000 // length(a))::int as changed from n""")
def change_ratios(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.floor(review.change_ratio(F.col("p_name"), F.concat("p_type", F.lit(" "), "p_name")) * 1000 + 1e-9).cast("int").alias("changed"))


@query("""
with e as (select event_id, case event_id % 6 when 0 then 'connect ECONNREFUSED 127.0.0.1' when 1 then 'Request timed out' when 2 then 'Unauthorized: bad key' when 3 then 'getaddrinfo ENOTFOUND host' when 4 then 'bad gateway' else 'AccessDenied: access denied' end as error from events)
select event_id, case when regexp_matches(error, '(?i)econnrefused|connection refused') then 'the service is not running' when regexp_matches(error, '(?i)timed? ?out') then 'the service took too long'
  when regexp_matches(error, '(?i)credential|unauthori[sz]ed|access denied') then 'the service did not accept the credentials' when regexp_matches(error, '(?i)enotfound|name or service not known') then 'the service''s host is unknown' else error end as said,
  regexp_matches(error, '(?i)econnrefused|connection refused|credential|unauthori[sz]ed|api key|access denied') as fatal from e""")
def service_errors(spark, sf_dir):
    texts = F.array(*[F.lit(x) for x in ("connect ECONNREFUSED 127.0.0.1", "Request timed out", "Unauthorized: bad key", "getaddrinfo ENOTFOUND host", "bad gateway", "AccessDenied: access denied")])
    e = read(spark, sf_dir, "events").select("event_id", F.get(texts, (F.col("event_id") % 6).cast("int")).alias("error"))
    return e.select("event_id", review.explain_error(F.col("error")).alias("said"), models.is_fatal(F.col("error")).alias("fatal"))


@query("""
with o as (select o_orderkey as id, case o_orderkey % 4 when 0 then 'high' when 1 then 'medium' when 2 then 'low' else 'unusable' end as tier, o_orderkey % 3 = 0 as cut, o_orderkey % 5 as unsure, case o_orderkey % 7 when 0 then 'loopy' when 1 then 'rejected' else 'use' end as tr from orders)
select id, array_to_string(list_filter([case when tier = 'unusable' then 'The transcript is not usable; check everything.' end, case when tier = 'low' then 'The transcript is noisy; every term needs checking.' end,
  case when cut then 'The model''s answer was cut off; items may be missing.' end, case when unsure > 0 then unsure || ' terms were heard where the speech model was unsure.' end,
  case when tr = 'loopy' then 'The translation repeats itself and was not used.' end, case when tr = 'rejected' then 'The translation was not used for this language.' end], lambda x: x is not null), ' ') as warnings from o""")
def quality_warnings(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    tier = F.when(k % 4 == 0, "high").when(k % 4 == 1, "medium").when(k % 4 == 2, "low").otherwise("unusable")
    w = review.warnings_of(tier, k % 3 == 0, k % 5, F.when(k % 7 == 0, "loopy").when(k % 7 == 1, "rejected").otherwise("use"))
    return o.select(k.alias("id"), F.array_join(w, " ").alias("warnings"))


@query("""
select l_orderkey, l_linenumber from lineitem where not (l_linestatus = 'O' and l_returnflag in ('A', 'N') and l_discount < 0.05)""")
def weak_matches(spark, sf_dir):
    m = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linestatus") == "O", "fuzzy").otherwise("exact").alias("kind"), F.when(F.col("l_returnflag") == "A", "disease").when(F.col("l_returnflag") == "N", "sign").otherwise("medicine").alias("category"), F.col("l_discount").alias("score"))
    return review.strong_enough(m, 0.05).select("l_orderkey", "l_linenumber")


@query("""
with d as (select user_id, value, case when event_id % 11 = 0 then 'nan'::double when event_id % 13 = 0 then 'inf'::double else value end as v from events)
select user_id, round(avg(case when not isnan(v) and not isinf(v) then v end) * 1000)::bigint as mean from d group by user_id""")
def batch_means(spark, sf_dir):
    """Means over what is there and finite, for each user."""
    e = read(spark, sf_dir, "events")
    v = F.when(F.col("event_id") % 11 == 0, float("nan")).when(F.col("event_id") % 13 == 0, float("inf")).otherwise(F.col("value"))
    return sinks.batch_averages(e.select("user_id", v.alias("mean")).groupBy("user_id"), ["mean"]).select("user_id", F.round(F.col("mean") * 1000).cast("long").alias("mean"))


@query("""
select p_partkey as id, p_partkey || ' [' || p_type || '] ' || p_name || case when p_size % 3 = 0 then '' else ' (' || p_brand || ', ' || lower(p_type) || ')' end || case when p_size % 2 = 0 then '' else ' — ' || p_size end || ' «' || upper(p_name) || '»' as line from part""")
def candidate_lines(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    also = F.when(F.col("p_size") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("p_brand", F.lower("p_type")))
    details = F.when(F.col("p_size") % 2 == 0, "").otherwise(F.col("p_size").cast("string"))
    return p.select(F.col("p_partkey").alias("id"), sinks.candidate_line(F.col("p_partkey").cast("string"), F.col("p_type"), F.col("p_name"), also, details, F.upper("p_name")).alias("line"))


@query("""
select vec_id, (greatest(len(embedding) * 4000 - 44, 0) / 32000.0 * 1000)::bigint as millis from embeddings""")
def wav_lengths(spark, sf_dir):
    """Seconds of 16 kHz mono WAV from a size in bytes."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", (F.size("embedding") * 4000).alias("length"))
    return e.select("vec_id", F.round(files.wav_seconds(F.col("length")) * 1000).cast("long").alias("millis"))


@query("""
with g as (select user_id, event_type, count(*) as n from events group by all), t as (select user_id, sum(n) as all_n from g group by user_id)
select user_id, event_type, (n * 1000 >= all_n * 150) as passed from g join t using (user_id)""")
def share_gates(spark, sf_dir):
    g = read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    t = g.groupBy("user_id").agg(F.sum("n").alias("all_n"))
    return g.join(t, "user_id").select("user_id", "event_type", E.ratio_gate(F.col("n"), F.col("all_n"), 0.15).alias("passed"))


@query("""
with s as (select o_orderkey as id, case when o_orderkey % 3 = 0 then null else (o_orderkey % 100) / 100.0 end as c, (o_orderkey % 41) / 100.0 as low, o_orderkey % 300 as words, (o_orderkey % 90) + 1 as secs from orders),
b as (select *, greatest(0, least(1, (c - 0.4) / 0.45)) as base, greatest(0, least(1, 1 - low * 2.5)) as lows, words / (secs / 60) as rate from s)
select id, round((0.7 * base + 0.3 * lows) * 1000)::int as confidence, round(case when secs > 10 then greatest(0, least(1, case when rate < 60 then rate / 60 when rate > 280 then 1 - (rate - 280) / 200 else 1.0 end)) end * 1000)::int as rate from b""")
def speech_signals(spark, sf_dir):
    k = F.col("o_orderkey")
    c = F.when(k % 3 != 0, (k % 100) / 100.0)
    pace = Q.speech_rate_signal((k % 300).cast("double"), ((k % 90) + 1).cast("double"), F.lit(60.0))
    o = read(spark, sf_dir, "orders").select(k.alias("id"), Q.confidence_signal(c, (k % 41) / 100.0).alias("confidence"), pace.alias("rate"))
    return o.select("id", F.round(F.col("confidence") * 1000).cast("int").alias("confidence"), F.round(F.col("rate") * 1000).cast("int").alias("rate"))


@query(rf"""
with e as (select item_id, list_filter(string_split_regex(lower(text), '[\s,।.?!;:()"''“”‘’\-–—/]+'), lambda t: length(t) >= 2) as t from benchmark)
select item_id, len(t)::int as n, t[1] as first, case when length(t[1]) >= 4 then left(t[1], 4) else t[1] end as key from e""")
def evidence_words(spark, sf_dir):
    t = R.evidence_tokens(F.col("text"))
    first = F.get(t, F.lit(0))
    return read(spark, sf_dir, "benchmark").select("item_id", F.size(t).alias("n"), first.alias("first"), R.evidence_key(first).alias("key"))


@query(r"""
with l as (select doc_id, unnest(string_split(text || chr(10) || 'চোখ লাল', chr(10))) as line, unnest(range(0, len(string_split(text || chr(10) || 'চোখ লাল', chr(10))))) as n from documents)
select doc_id, n::int as n, case when regexp_matches(line, '[\x{0900}-\x{09FF}]') then 'indic' else 'latin' end as pool, length(line)::int as chars from l where line <> ''""")
def lines_by_script(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat("text", F.lit("\nচোখ লাল")).alias("text"))
    return M.lines_by_script(d).select(F.col("id").alias("doc_id"), "n", "pool", F.length("line").alias("chars"))
