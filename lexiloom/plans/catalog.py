"""Registered queries over the driver's tables, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scans
from ..functions import text as X
from ..operators import evaluation as E
from ..operators import grounding as G
from ..operators import matching as M
from ..operators import quality as Q
from ..operators import review
from ..operators import rules as R
from ..operators import spans as S
from ..sources import files, models
from . import analyze, report_queries, rule_queries, scenes, speech_queries, text_queries
from . import tables as T
from .registry import ORACLES, QUERIES, plain, query, read, sound_sql, spread, toks

FLAGSHIP = "phrase_exact_match"
REGISTERED = (report_queries, rule_queries, speech_queries, text_queries)  # they register their queries when they are imported


def docs_toks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as words of the ASCII normalisation, in the JVM alone; dealt out by id, so that what follows by id is not shuffled again."""
    d = spread(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    return d.select("id", X.words(X.normalize_ascii(F.col("text"))).alias("toks"))


DT = f"dt as (select doc_id as id, {toks('text')} as toks from documents)"


def gram(n: int, t: str = "toks") -> str:
    return f"array_to_string({t}[i + 1 : i + {n}], ' ')"


# --- C, E: scalars and generators ------------------------------------------------------------


@query(f"select p_partkey as id, {plain('p_name')} as norm from part union all select c_custkey as id, {plain('c_name')} as norm from customer")
def text_normalize_ascii(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), X.normalize_ascii(F.col("p_name")).alias("norm"))
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), X.normalize_ascii(F.col("c_name")).alias("norm"))
    return p.unionByName(c)


@query(r"""
select doc_id, length(regexp_replace(text, '[^\x{0900}-\x{097F}]', '', 'g')) as dev, length(regexp_replace(text, '[^\x{0980}-\x{09FF}]', '', 'g')) as ben,
  length(regexp_replace(text, '[^A-Za-z]', '', 'g')) as lat,
  length(regexp_replace(regexp_replace(text, '[A-Za-z\x{0900}-\x{09FF}]', '', 'g'), '[^\p{L}]', '', 'g')) as other,
  case when regexp_matches(text, '[\x{0980}-\x{09FF}]') then 'bn' when regexp_matches(text, '[\x{0900}-\x{097F}]') then 'hi' else 'en' end as script_lang
from documents""")
def script_profile(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in X.script_counts(F.col("text")).items()])
    return d.withColumn("script_lang", X.infer_language(F.col("dev"), F.col("ben")))


@query(f"""
with {DT}, g as (select {gram(2)} as gram from (select toks, unnest(range(0, len(toks) - 1)) as i from dt))
select gram, count(*) as n from g group by gram order by n desc, gram limit 20""")
def token_ngrams_topk(spark, sf_dir):
    return M.ngrams(docs_toks(spark, sf_dir), 2, 2).groupBy("gram").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "gram").limit(20)


def members(toks: str, words: list[str]) -> Column:
    """How many of an array's words are in a list."""
    return F.size(F.filter(toks, lambda t: t.isin(*words)))


@query(f"""
with {DT}, w as (select id, unnest(toks) as t from dt), f(lang, word) as (values {T.values((k, w) for k, ws in T.FUNCTION_WORDS.items() for w in ws)})
select d.lang, count(*) as words, count(f.word) as function_words from w join documents d on d.doc_id = w.id left join f on f.lang = d.lang and f.word = w.t group by d.lang""")
def function_word_rate(spark, sf_dir):
    """Only counts of a text are joined with its language, not its words."""
    d = docs_toks(spark, sf_dir).select("id", F.size("toks").alias("n"), *[members("toks", ws).alias(lang) for lang, ws in T.FUNCTION_WORDS.items()])
    d = d.join(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang"), "id")
    hit = F.lit(0)
    for lang in T.FUNCTION_WORDS:
        hit = F.when(F.col("lang") == lang, F.col(lang)).otherwise(hit)
    return d.groupBy("lang").agg(F.sum("n").alias("words"), F.sum(hit).alias("function_words")).where("words > 0")


@query(f"""
with {DT}, w as (select id, unnest(toks) as t, unnest(range(0, len(toks))) as i from dt),
r as (select id, t, i - row_number() over (partition by id, t order by i) as island from w), n as (select id, count(*) as n from r group by id, t, island)
select dt.id as doc_id, len(dt.toks) as words, coalesce(case when len(dt.toks) >= 8 then (select sum(n - 1) from n where n.id = dt.id and n.n >= 4) end, 0)::bigint as looped from dt""")
def loop_ratio_unigram(spark, sf_dir):
    d = docs_toks(spark, sf_dir)
    return d.select(F.col("id").alias("doc_id"), F.size("toks").cast("long").alias("words"), Q.unigram_loop(F.col("toks")).cast("long").alias("looped"))


KEYWORD_SQL = f"""
with {DT}, e(category, key, form) as (values {T.values(T.KEYWORDS)}),
g as (select id, unnest(toks) as gram from dt union all select id, {gram(2)} as gram from (select id, toks, unnest(range(0, len(toks) - 1)) as i from dt)),
per as (select id, category, key, form, count(*) as n from g join e on g.gram = e.form group by all),
named as (select id, category, key, max(n) as n from per group by all),
t as (select id, toks, unnest(toks) as t, unnest(range(0, len(toks))) as i from dt),
k as (select id, case when regexp_full_match(t, '[0-9]+/[0-9]+') then 'fraction' when regexp_full_match(t, '[0-9]+:[0-9]+') then 'ratio' when regexp_full_match(t, '[0-9]+(\\.[0-9]+)?%') then 'percent'
  when regexp_full_match(t, '[0-9]+(\\.[0-9]+)?') then case when toks[i + 2] = 'mmhg' then 'pressure' when toks[i + 2] in ('mm','mg','ml','d','diopter','dioptre','diopters') then 'unit' else 'digits' end end as key from t),
told as (select id, case key when 'digits' then 'number' else 'measurement' end as category, key, count(*) as n from k where key is not null group by all),
hits as (select * from named union all select * from told)
"""


@query(KEYWORD_SQL + "select id as doc_id, category, key, n from hits")
def keyword_counts(spark, sf_dir):
    e = T.table(spark, T.KEYWORDS, "category, key, form")
    return Q.keyword_hits(docs_toks(spark, sf_dir), e).withColumnRenamed("id", "doc_id")


@query(KEYWORD_SQL + "select h.id as doc_id, sum(n)::bigint as total, len(any_value(dt.toks))::bigint as words, count(distinct category) as categories from hits h join dt on dt.id = h.id group by h.id")
def keyword_report(spark, sf_dir):
    d = docs_toks(spark, sf_dir)
    h = Q.keyword_hits(d, T.table(spark, T.KEYWORDS, "category, key, form"))
    r = h.groupBy("id").agg(F.sum("n").alias("total"), F.countDistinct("category").alias("categories"))
    return r.join(d.select("id", F.size("toks").cast("long").alias("words")), "id").withColumnRenamed("id", "doc_id")


@query(f"""
with c as (select conv_id, role, {toks('text')} as toks from conversations where role in ('user', 'assistant')), e(category, key, form) as (values {T.values(k for k in T.KEYWORDS if " " not in k[2])}),
h as (select distinct conv_id, role, category || ':' || key as k from (select conv_id, role, unnest(toks) as t from c) join e on t = form),
u as (select conv_id, list(k) filter (role = 'user') as a, list(k) filter (role = 'assistant') as b from h group by conv_id)
select conv_id, len(list_intersect(a, b)) as shared, len(list_distinct(list_concat(a, b))) as either from u where a is not null and b is not null and len(list_distinct(list_concat(a, b))) >= 3""")
def keyword_jaccard(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").where("role in ('user', 'assistant')").select("conv_id", "role", F.explode(X.words(X.normalize_ascii(F.col("text")))).alias("t"))
    e = T.table(spark, [k for k in T.KEYWORDS if " " not in k[2]], "category, key, form")
    h = c.join(e, F.col("t") == F.col("form")).groupBy(F.col("conv_id").alias("id"), "role").agg(F.collect_set(F.concat_ws(":", "category", "key")).alias("keys"))
    a = Q.agreement(h.where("role = 'user'"), h.where("role = 'assistant'"))
    return a.select(F.col("id").alias("conv_id"), F.col("both").cast("long").alias("shared"), F.col("either").cast("long").alias("either"))


_EVERY = ", ".join(f"'{w}'" for w in sorted({w for ws in T.FUNCTION_WORDS.values() for w in ws}))


@query(f"""
with {DT}, w as (select id, unnest(toks) as t, unnest(range(0, len(toks))) as i from dt),
r as (select id, t, i - row_number() over (partition by id, t order by i) as island from w), n as (select id, count(*) as n from r group by id, t, island),
l as (select id, sum(n - 1) as looped from n where n.n >= 4 group by id),
c as (select dt.id, len(toks) as words, len(list_filter(toks, lambda x: x in ({_EVERY}))) as fw, case when len(toks) >= 8 then coalesce(l.looped, 0) else 0 end as looped from dt left join l using (id)),
s as (select id, words, case when words >= 15 then least(1000, fw * 1000 // words * 4) end as fit, greatest(0, 1000 - 3 * (looped * 1000 // greatest(words, 1))) as rep from c),
m as (select id, words, (coalesce(fit * 2, 0) + rep) // (case when fit is null then 1 else 3 end) as mean, least(coalesce(fit, 1000), rep) + 300 as weakest from s),
z as (select id, case when words < 8 then 0 else least(mean, weakest) end as score from m)
select z.id as doc_id, score::bigint as score, case when score >= 750 then 'high' when score >= 550 then 'medium' when score >= 350 then 'low' else 'unusable' end as tier,
  case when score >= 550 then 600 else 500 end as candidate_min, l.quality from z left join labels l on l.doc_id = z.id""")
def quality_score_tier(spark, sf_dir):
    every = sorted({w for ws in T.FUNCTION_WORDS.values() for w in ws})
    d = docs_toks(spark, sf_dir).select("id", F.size("toks").cast("long").alias("words"), F.size(F.filter("toks", lambda t: t.isin(*every))).cast("long").alias("fw"), Q.unigram_loop(F.col("toks")).cast("long").alias("looped"))
    fit = F.when(F.col("words") >= 15, F.least(F.lit(1000), F.expr("fw * 1000 div words * 4")))
    d = d.select("id", "words", fit.alias("fit"), F.greatest(F.lit(0), 1000 - 3 * F.expr("looped * 1000 div greatest(words, 1)")).alias("rep"))
    mean = F.expr("(coalesce(fit * 2, 0) + rep) div (case when fit is null then 1 else 3 end)")
    score = F.when(F.col("words") < 8, 0).otherwise(F.least(mean, F.least(F.coalesce("fit", F.lit(1000)), F.col("rep")) + 300)).cast("long")
    d = d.select(F.col("id").alias("doc_id"), score.alias("score")).withColumn("tier", Q.tier_of(F.col("score") / 1000))
    p = Q.policies(spark).select("tier", F.round(F.col("candidate_min") * 1000).cast("int").alias("candidate_min"))
    return d.join(F.broadcast(p), "tier").join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")


# --- G, H, I, J: matching --------------------------------------------------------------------


def bench_phrases(spark, sf_dir, n: int = 4) -> DataFrame:
    """Every run of ``n`` words of every item, once an item."""
    b = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), X.words(X.normalize_ascii(F.col("text"))).alias("toks"))
    return M.ngrams(b, n, n).select(F.col("id").alias("term"), F.col("gram").alias("norm"), "n").distinct()


@query(f"""
with {DT}, b as (select item_id, t, unnest(range(0, len(t) - 3)) as i from (select item_id, {toks('text')} as t from benchmark)), p as (select distinct item_id, {gram(4, 't')} as norm from b),
g as (select id, {gram(4)} as gram from (select id, toks, unnest(range(0, len(toks) - 3)) as i from dt))
select id as doc_id, item_id as term, norm, count(*) as n from g join p on g.gram = p.norm group by all""")
def phrase_exact_match(spark, sf_dir):
    m = M.exact_matches(docs_toks(spark, sf_dir), bench_phrases(spark, sf_dir))
    return m.select(F.col("id").alias("doc_id"), "term", "norm", F.col("count").alias("n"))


@query(f"""
with a(raw) as (values {T.values(T.ABBREVIATIONS)}), t as (select distinct doc_id, unnest(regexp_split_to_array(text, '[^A-Za-z0-9/:+]+')) as tok from documents)
select doc_id, raw from t join a on tok = raw""")
def abbr_match_case(spark, sf_dir):
    a = T.table(spark, T.ABBREVIATIONS, "raw").withColumn("term", F.col("raw"))
    return M.abbreviation_matches(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), a).select(F.col("id").alias("doc_id"), "raw")


_STOP = ", ".join(f"'{w}'" for w in sorted(M.STOP))


@query(f"""
with {DT}, nd as (select item_id, list_distinct(list_filter(t, lambda x: length(x) > 2 and x not in ({_STOP}))) as c from (select item_id, {toks('text')} as t from benchmark)),
need as (select * from nd where len(c) >= 3),
pr as (select h.id, n.item_id, len(any_value(n.c)) as k, count(*) as n from (select distinct id, unnest(toks) as w from dt) h join (select item_id, c, unnest(c) as w from need) n using (w) group by h.id, n.item_id),
c as (select pr.id, pr.item_id, pr.k, list_max(list_transform(range(0, len(dt.toks), 2), lambda i: len(list_intersect(dt.toks[i + 1 : i + greatest(3 * pr.k, 12)], need.c)))) as best
  from pr join dt using (id) join need using (item_id) where pr.n * 10 >= pr.k * 6)
select id as doc_id, item_id as term, k, best from c where best * 10 >= k * 6""")
def overlap_coverage(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("term"), X.words(X.normalize_ascii(F.col("text"))).alias("t"))
    need = b.select("term", F.array_distinct(F.filter("t", lambda x: (F.length(x) > 2) & ~x.isin(*sorted(M.STOP)))).alias("content")).where(F.size("content") >= 3)
    m = M.overlap_matches(docs_toks(spark, sf_dir), need)
    return m.select(F.col("id").alias("doc_id"), "term", F.col("k").cast("long").alias("k"), F.col("best").cast("long").alias("best"))


@query(f"""
with n as (select distinct {plain('p_name')} as norm from part), j as (select norm, replace(norm, ' ', '') as s, len(string_split(norm, ' ')) as k from n),
p as (select *, {sound_sql('s')} as key, case when length(s) >= 12 then 3 when length(s) >= 8 then 2 else 1 end as m from j),
c as (select a.norm as heard, b.norm as form, a.s as x, b.s as y, b.m, least(levenshtein(a.s, b.s), levenshtein(a.key, b.key)) as d
  from p a join p b on a.norm <> b.norm and length(b.s) >= 6 and b.k <= 4 and abs(length(a.s) - length(b.s)) <= b.m + 2 and a.k between greatest(1, b.k - 1) and least(5, b.k + 2)
    and (a.s[1] = b.s[1] or a.key[1] = b.key[1] or (length(b.s) >= 9 and right(a.s, 3) = right(b.s, 3))))
select heard, form, d::int as d from c where d <= m""")
def fuzzy_blocked_match(spark, sf_dir):
    n = read(spark, sf_dir, "part").select(X.normalize_ascii(F.col("p_name")).alias("norm")).distinct().withColumn("s", F.replace("norm", F.lit(" "), F.lit("")))
    n = n.withColumn("n_toks", F.size(F.split("norm", " ")))
    m = M.fuzzy_pairs(n.select(F.col("norm").alias("span"), "s", "n_toks"), n.select(F.col("norm").alias("form"), F.col("s").alias("joined"), "n_toks", F.lit(True).alias("is_name")))
    return m.where("not rescued and h_span <> form").select(F.col("h_span").alias("heard"), "form", F.col("d").cast("int").alias("d"))


_SPANS = f"""
{DT}, bt as (select item_id, {toks('text')} as t from benchmark),
ph as (select distinct n, array_to_string(t[i + 1 : i + n], ' ') as norm from (select n, t, unnest(range(0, len(t) - n + 1)) as i from bt, (select unnest([3, 4, 5]) as n))),
gr as (select id, i, n, array_to_string(toks[i + 1 : i + n], ' ') as gram from (select id, toks, unnest(range(0, len(toks) - 1)) as i from dt), (select unnest([3, 4, 5]) as n) where i + n <= len(toks)),
sp as (select distinct gr.id, ph.norm, gr.i as s, gr.i + gr.n as e from gr join ph on gr.gram = ph.norm)"""


def bench_spans(spark, sf_dir) -> DataFrame:
    """Spans (id, heard, start, end) of all runs of 3 to 5 words that some item of the benchmark has."""
    b = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), X.words(X.normalize_ascii(F.col("text"))).alias("toks"))
    return M.phrase_spans(docs_toks(spark, sf_dir), M.ngrams(b, 3, 5).select(F.col("gram").alias("heard")), 3, 5)


@query(f"with {_SPANS} select id as doc_id, norm as heard, s::int as \"start\", e::int as \"end\" from sp a where not exists (select 1 from sp b where b.id = a.id and b.s <= a.s and b.e >= a.e and b.e - b.s > a.e - a.s)")
def span_longest_wins(spark, sf_dir):
    s = bench_spans(spark, sf_dir).withColumn("ord", F.lit(0))
    return S.longest_wins(s, ["id"]).select(F.col("id").alias("doc_id"), "heard", "start", "end")


@query(f"""
with {_SPANS}, m as (select id, norm, count(*) as n, max(len(string_split(norm, ' '))) as score from sp group by id, norm)
select id as doc_id, norm as heard, n from m a where not exists (select 1 from m b where b.id = a.id and b.score >= a.score and length(b.norm) > length(a.norm) and contains(b.norm, a.norm))""")
def match_suppress_contained(spark, sf_dir):
    m = bench_spans(spark, sf_dir).groupBy("id", "heard").agg(F.count("*").alias("n")).withColumn("score", F.size(F.split("heard", " ")).cast("double")).withColumn("kind", F.lit("fuzzy"))
    return M.suppress_contained(m).select(F.col("id").alias("doc_id"), "heard", "n")


@query("""
with s as (select p_brand, p_partkey, p_retailprice from part where p_retailprice >= 500), c as (select count(*) as n, count(distinct p_brand) as cats from s),
r as (select s.*, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as k, greatest(3, 60 // (2 * cats)) as fl, n from s, c),
f as (select *, k <= fl as kept, sum((k <= fl)::int) over () as kn from r), g as (select *, row_number() over (partition by kept order by p_retailprice desc, p_partkey) as rk from f)
select p_brand as category, p_partkey as term from g where n <= 60 or kept or rk <= 60 - kn""")
def candidate_floor_topk(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.lit(0).alias("id"), F.col("p_brand").alias("category"), F.col("p_partkey").alias("term"), F.col("p_retailprice").alias("score"))
    return M.select_candidates(p, 60, 500.0, [F.col("score").desc(), "term"]).select("category", "term")


@query(f"""
with {DT}, b as (select distinct item_id, w, min(i) as i from (select item_id, unnest(t) as w, unnest(range(0, len(t))) as i from (select item_id, {toks('text')} as t from benchmark)) where w not in ({", ".join(f"'{w}'" for w in sorted(M.STOP))}) group by all),
h as (select id, w, count(*) as n from (select id, unnest(toks) as w from dt) group by all), m as (select h.id, b.item_id, b.i, h.n, h.w from h join b using (w)),
r as (select *, row_number() over (partition by id, item_id order by i) as k, max(n) over (partition by id, item_id) as most from m)
select id as doc_id, item_id as term, (1000 - i)::double / 1000 as score, w as heard, most as n from r where k = 1""")
def best_match_per_term(spark, sf_dir):
    """The words of an item that say something play its surfaces, the earlier the better; all words of a document are looked at."""
    toks_ = X.words(X.normalize_ascii(F.col("text")))
    b = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("term"), F.posexplode(toks_).alias("ord", "w")).where(~F.col("w").isin(*sorted(M.STOP))).groupBy("term", "w").agg(F.min("ord").alias("ord"))
    h = docs_toks(spark, sf_dir).select("id", F.explode(F.filter("toks", lambda w: ~w.isin(*sorted(M.STOP)))).alias("w"))
    m = M.earliest_per_term(h, b).withColumn("score", (1000 - F.col("ord")).cast("double") / 1000)
    return m.select(F.col("id").alias("doc_id"), "term", "score", F.col("w").alias("heard"), F.col("count").alias("n"))


# --- E4, F7, G7: denial and answers ----------------------------------------------------------

_NEG = """
cl as (select conv_id, turn, unnest(string_split_regex(lower(text), '[?!.,;:\\n]+')) as c, unnest(range(0, len(string_split_regex(lower(text), '[?!.,;:\\n]+')))) as clause from conversations),
tk as (select conv_id, turn, clause, list_filter(string_split_regex(c, '[\\s"()]+'), lambda x: x <> '') as t from cl),
ng as (select conv_id, turn, clause, t, unnest(range(0, len(t))) as pos from tk),
nn as (select *, t[pos + 2 : pos + 5] as a from ng where t[pos + 1] in ('no','without','denies','deny','denied','never','negative') and (pos = 0 or t[pos] not in ('can''t','cant','cannot','unable','couldn''t','couldnt'))),
sp as (select conv_id, turn, clause::int as clause, pos::int as pos, a[1 : coalesce(list_min(list_filter([list_position(a, 'but'), list_position(a, 'however'), list_position(a, 'except')], lambda p: p > 0)) - 1, 4)] as p from nn),
neg as (select conv_id, turn, clause, pos, array_to_string(p, ' ') as phrase from sp where len(p) > 0)"""


def turn_negations(spark, sf_dir) -> DataFrame:
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", S.english_negations(F.col("text")).alias("n"))
    return c.select("conv_id", "turn", F.inline("n"))


@query(f"with {_NEG} select * from neg")
def negation_english(spark, sf_dir):
    return turn_negations(spark, sf_dir)


@query(f"""
with {_NEG}, hit as (select conv_id, turn, clause::int as clause, t[pos + 1] as w, pos::int as pos from ng where t[pos + 1] in (select * from (values {T.values(sorted(set(T.FUNCTION_WORDS['en'])))})))
select conv_id, turn, clause, pos, w from hit h where not exists (select 1 from neg n where n.conv_id = h.conv_id and n.turn = h.turn and n.clause = h.clause and h.pos >= n.pos + 1 and h.pos + 1 <= n.pos + 1 + len(string_split(n.phrase, ' ')))""")
def span_negation_anti(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split(F.lower("text"), r"[?!.,;:\n]+")).alias("clause", "c"))
    h = c.select("conv_id", "turn", "clause", F.posexplode(F.array_remove(F.split("c", r"[\s\"()]+"), "")).alias("pos", "w")).where(F.col("w").isin(*sorted(set(T.FUNCTION_WORDS["en"]))))
    hits = h.withColumn("start", F.col("pos")).withColumn("end", F.col("pos") + 1)
    n = turn_negations(spark, sf_dir).select("conv_id", "turn", "clause", (F.col("pos") + 1).alias("start"), (F.col("pos") + 1 + F.size(F.split("phrase", " "))).alias("end"))
    return S.outside(hits, n, ["conv_id", "turn", "clause"]).select("conv_id", "turn", "clause", "pos", "w")


@query("""
select user_id, arg_max(event_type, struct_pack(ts := ts, event_id := event_id)) as answer, (count(distinct event_type) > 1) as conflict from events where event_type in ('purchase', 'click') group by user_id""")
def last_answer_wins(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("said", F.when(F.col("event_type").isin("purchase", "click"), F.col("event_type")))
    return R.last_decisive(e, ["user_id"], "said", ["ts", "event_id"])


@query(f"""
with w as (select distinct conv_id, role, unnest({toks('text')}) as w from conversations where role in ('user', 'assistant'))
select conv_id, count(*) as only_user from w u where role = 'user' and not exists (select 1 from w a where a.role = 'assistant' and a.conv_id = u.conv_id and a.w = u.w) group by conv_id""")
def doctor_line_exclusion(spark, sf_dir):
    w = read(spark, sf_dir, "conversations").select("conv_id", "role", F.explode(F.array_distinct(X.words(X.normalize_ascii(F.col("text"))))).alias("w"))
    return S.said_by_one(w, ["conv_id", "w"], F.col("role") == "user", F.col("role") == "assistant").groupBy("conv_id").agg(F.count("*").alias("only_user"))


# --- A10, D11, I6 ----------------------------------------------------------------------------


@query("""
with e as (select user_id, event_id, ts, case when event_type = 'view' then ' ' else '' end || event_type as text, value from events where event_type <> 'error'),
g as (select *, sum((text like ' %')::int) over (partition by user_id order by event_id rows unbounded preceding) as word_id from e)
select user_id, word_id::bigint as word_id, trim(string_agg(text, '' order by event_id)) as w, round(min(value) * 100)::bigint as p from g group by user_id, word_id""")
def running_word_groups(spark, sf_dir):
    """Events play the tokens of a recording: a view opens a word, an error is a special token."""
    text = F.when(F.col("event_type") == "error", "[_ERR_]").when(F.col("event_type") == "view", " view").otherwise(F.col("event_type"))
    t = read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("pos"), text.alias("text"), F.col("value").alias("p"))
    return files.words_of_tokens(t).select(F.col("id").alias("user_id"), "word_id", "w", F.round(F.col("p") * 100).cast("long").alias("p"))


# --- G11 and on: grounding -------------------------------------------------------------------


@query(f"""
with names as (select p_partkey as id, {plain('p_name')} as norm, p_brand as category from part),
it as (select row_number() over () as rid, l_partkey as kb_id, {plain('p_name')} as norm, case when l_linenumber % 3 = 0 then 'Brand#11' else p_brand end as category from lineitem join part on p_partkey = l_partkey),
c as (select rid, 1 as p, kb_id as term, 'id' as how from it join names on names.id = it.kb_id and names.category = it.category union all
  select rid, 2, names.id, 'name' from it join names on names.norm = it.norm and names.category = it.category union all
  select rid, 3, names.id, 'head' from it join names on string_split(names.norm, ' ')[1] = string_split(it.norm, ' ')[1] and names.category = it.category where length(string_split(it.norm, ' ')[1]) >= 5),
b as (select rid, min(struct_pack(p := p, o := case when p = 1 then 0 else term end, term := term, how := how)) as x from c group by rid)
select coalesce(b.x.how, 'none') as how, count(*) as n, sum(coalesce(b.x.term, 0))::bigint as checksum from it left join b using (rid) group by 1""")
def id_grounding_cascade(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    names = p.select(F.col("p_partkey").alias("id"), X.normalize_ascii(F.col("p_name")).alias("norm"), F.col("p_brand").alias("category"), F.col("p_partkey").alias("ord"))
    it = read(spark, sf_dir, "lineitem")
    it = it.join(p, F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_partkey").alias("kb_id"), F.col("p_name").alias("name"), F.when(F.col("l_linenumber") % 3 == 0, "Brand#11").otherwise(F.col("p_brand")).alias("category"))
    r = G.resolve(it, names)
    return r.groupBy(F.coalesce("how", F.lit("none")).alias("how")).agg(F.count("*").alias("n"), F.sum(F.coalesce("term", F.lit(0))).alias("checksum"))


_RISK = ("rights", "token", "clown", "public", "version", "license")


@query(f"""
with r(risk) as (values {T.values(_RISK)}), m as (select item_id, risk from benchmark, r where contains(lower(text || ' clown rights'), risk)),
h as (select source, risk from documents, r where contains(lower(text), risk) group by all)
select source, item_id, risk from h join m using (risk) where source = 'src' || (item_id % 20)""")
def risk_cross_check(spark, sf_dir):
    """Benchmark items play the cautions of medicines, each of one source; documents of a source its history."""
    m = read(spark, sf_dir, "benchmark").select(F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("visit"), F.col("item_id").alias("medicine"), F.concat("text", F.lit(" clown rights")).alias("caution"))
    h = read(spark, sf_dir, "documents").select(F.col("source").alias("visit"), "text")
    return G.risk_checks(m, h, _RISK).select(F.col("visit").alias("source"), F.col("medicine").alias("item_id"), "risk").distinct()


_EV = r"""list_filter(string_split_regex(lower({0}), '[\s,।.?!;:()"''“”‘’\-–—/]+'), lambda t: length(t) >= 2)"""


@query(f"""
with ev as (select item_id, len({_EV.format('text')}) as n, unnest(list_transform({_EV.format('text')}, lambda t: case when length(t) >= 4 then left(t, 4) else t end)) as k from benchmark),
tr as (select distinct doc_id, unnest(list_transform({_EV.format('text')}, lambda t: case when length(t) >= 4 then left(t, 4) else t end)) as k from documents)
select doc_id, item_id, count(*) as hit, any_value(n) as words from ev join tr using (k) group by doc_id, item_id having count(*) * 10 >= any_value(n) * 6""")
def evidence_supported(spark, sf_dir):
    key = lambda c: F.transform(R.evidence_tokens(c), R.evidence_key)
    ev = read(spark, sf_dir, "benchmark").select("item_id", key(F.col("text")).alias("ks")).select("item_id", F.size("ks").cast("long").alias("words"), F.explode("ks").alias("k"))
    ev = ev.groupBy("item_id", "words", "k").agg(F.count("*").alias("times"))
    d = spread(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    tr = d.select("doc_id", F.explode(F.array_distinct(key(F.col("text")))).alias("k")).join(S.small_side(ev.select("k").distinct()), "k", "left_semi").distinct()
    m = tr.join(S.small_side(ev), "k").groupBy("doc_id", "item_id", "words").agg(F.sum("times").alias("hit"))
    return m.where("hit * 10 >= words * 6").select("doc_id", "item_id", "hit", "words")


@query("""
with k as (select l_orderkey, l_linenumber, case when l_linenumber = 1 then '' else l_returnflag || '|' || l_linestatus end as key from lineitem),
r as (select *, row_number() over (partition by l_orderkey, key order by l_linenumber) as n from k) select l_orderkey, l_linenumber, key from r where n = 1 or key = ''""")
def dedupe_first_wins(spark, sf_dir):
    k = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 1, "").otherwise(F.concat_ws("|", "l_returnflag", "l_linestatus")).alias("key"))
    return R.first_of(k, ["l_orderkey"], "key", "l_linenumber").where("_rank = 1").drop("_rank")


def copy_pairs(spark, sf_dir) -> DataFrame:
    """Documents of any language that share the first or the last of their runs of eight words, by spelling, with the first document that does: (doc_id, ref_id, hyp, ref).

    Copies agree in one of the two wherever they were edited, unless they were edited there.
    """
    d = read(spark, sf_dir, "documents").select("doc_id", "text", F.split(F.lower("text"), r"[ \t\n\r]+").alias("t")).where(F.size("t") >= 8)
    runs = F.transform(F.sequence(F.lit(1), F.size("t") - 7), lambda i: F.array_join(F.slice("t", i, 8), " "))
    k = d.select("doc_id", runs.alias("r")).select("doc_id", F.explode(F.array(F.concat(F.lit("<"), F.array_min("r")), F.concat(F.lit(">"), F.array_max("r")))).alias("k"))
    first = k.groupBy("k").agg(F.min("doc_id").alias("ref_id"), F.count("*").alias("n")).where("n > 1")
    pairs = k.join(first, "k").where("doc_id <> ref_id").select("doc_id", "ref_id").distinct()
    m = pairs.join(d.select("doc_id", F.col("text").alias("hyp")), "doc_id").join(d.select(F.col("doc_id").alias("ref_id"), F.col("text").alias("ref")), "ref_id")
    # A run that many documents have gives them one ref_id: their pairs must not stay in its task.
    return m.where("hyp <> ref").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "ref_id")


_COPIES = """
d as (select doc_id, text, string_split_regex(lower(text), '[ \\t\\n\\r]+') as t from documents),
w as (select doc_id, list_transform(range(1, len(t) - 6), lambda i: array_to_string(t[i : i + 7], ' ')) as r from d where len(t) >= 8),
k as (select doc_id, '<' || list_min(r) as k from w union all select doc_id, '>' || list_max(r) from w),
f as (select k, min(doc_id) as ref_id from k group by k having count(*) > 1),
p as (select distinct k.doc_id, f.ref_id from k join f using (k) where k.doc_id <> f.ref_id),
c as (select p.doc_id, p.ref_id, a.text as hyp, b.text as ref from p join d a on a.doc_id = p.doc_id join d b on b.doc_id = p.ref_id where a.text <> b.text)"""
# DuckDB's distance counts bytes: letters with accents are written as one capital each, of which lower-cased texts have none.
_ONE_BYTE = "translate({0}, 'áàâäãéèêëíìîïóòôöõúùûüñçßæœ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ!&')"


@query(f"""with {_COPIES}, s as (select doc_id, ref_id, regexp_replace(lower(hyp), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', '', 'g') as h, regexp_replace(lower(ref), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', '', 'g') as r from c)
select doc_id, ref_id, levenshtein({_ONE_BYTE.format('h')}, {_ONE_BYTE.format('r')})::int as errors, length(r)::int as chars from s""")
def cer_chars(spark, sf_dir):
    p = copy_pairs(spark, sf_dir).select("doc_id", "ref_id", X.char_seq(F.col("hyp")).alias("h"), X.char_seq(F.col("ref")).alias("r"))
    return X.with_edit_distance(p, "h", "r", "errors").select("doc_id", "ref_id", "errors", F.length("r").alias("chars"))


@query()
def wer_words(spark, sf_dir):
    p = copy_pairs(spark, sf_dir).select("doc_id", "ref_id", X.normalize_native(F.col("hyp")).alias("hyp"), X.normalize_native(F.col("ref")).alias("ref"))
    c = p.select("doc_id", "ref_id", F.size(X.words(F.col("ref"))).alias("words"), scans.change_counts("ref", "hyp").alias("c"))
    return c.select("doc_id", "ref_id", "c.subs", "c.dels", "c.inss", "words", "c.distance")


# --- H10 and on: evaluation ------------------------------------------------------------------

_HITS = "h as (select d.source, d.lang, d.doc_id, l.quality, l.toxic, (d.n_chars >= 600)::int as pred from documents d join labels l using (doc_id))"


def predicted(spark, sf_dir) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", (F.col("n_chars") >= 600).cast("int").alias("pred"))
    return d.join(read(spark, sf_dir, "labels"), "doc_id")


@query(f"""
with {_HITS}, s as (select source, sum(pred) filter (quality = 1) as hit, count(*) filter (quality = 1) as facts, sum(pred) filter (toxic = 1) as bad from h group by source)
select source, hit::bigint as hit, facts, coalesce(bad, 0)::bigint as violations, hit * 1000 >= facts * 900 as recall_gate, coalesce(bad, 0) = 0 as forbidden_gate from s""")
def fact_recall_gates(spark, sf_dir):
    h = predicted(spark, sf_dir)
    s = h.groupBy("source").agg(F.sum(F.when(F.col("quality") == 1, F.col("pred"))).alias("hit"), F.count(F.when(F.col("quality") == 1, 1)).alias("facts"), F.coalesce(F.sum(F.when(F.col("toxic") == 1, F.col("pred"))), F.lit(0)).alias("violations"))
    return s.withColumn("recall_gate", E.ratio_gate(F.col("hit"), F.col("facts"), 0.9)).withColumn("forbidden_gate", F.col("violations") == 0)


@query(f"with {_HITS} select lang, source, grouping(lang, source)::int as level, count(*) as n, sum(quality)::bigint as good from h group by grouping sets ((lang), (source), ())")
def slice_grouping_sets(spark, sf_dir):
    return E.slices(predicted(spark, sf_dir), [["lang"], ["source"], []], F.count("*").alias("n"), F.sum("quality").alias("good")).select("lang", "source", "level", "n", "good")


@query(f"with {_HITS} select lang, count(*) filter (pred = 1 and quality = 1) as tp, count(*) filter (pred = 1 and quality = 0) as fp, count(*) filter (pred = 0 and quality = 1) as fn from h group by lang")
def prf_scores(spark, sf_dir):
    return E.label_counts(predicted(spark, sf_dir), ["lang"], "pred", "quality")


@query("""
with n as (select count(*) as n, greatest(1, floor(0.1 * count(*) + 0.5)::int) as want from documents), k as (select n, want, ceil(n / want)::int as k from n),
r as (select doc_id, row_number() over (order by doc_id) - 1 as i from documents)
select doc_id, case when i % k = 0 and i // k < want then 'valid' else 'train' end as part from r, k""")
def train_valid_split(spark, sf_dir):
    return E.train_valid(read(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("doc_id", "part")


@query("""
with t as (select p_partkey as id, case p_partkey % 3 when 0 then 'medicine' when 1 then 'disease' else 'symptom' end as category, p_name || ' ' || p_brand as name, [upper(left(p_type, 3)), p_type || ' kind', 'x'] as aliases from part),
w as (select case category when 'medicine' then 0 when 'disease' then 1 else 5 end as c, 0 as o, name as word from t union all
  select 0, 1, a from (select unnest(aliases) as a from t where category = 'medicine') where regexp_full_match(a, '[A-Z]{2,5}') or length(a) > 5),
k as (select lower(word) as key, min(struct_pack(o := o, c := c, word := word)) as x from w group by 1),
r as (select x.word as word, sum(length(x.word) + 2) over (order by x.o, x.c, x.word rows unbounded preceding) as used from k)
select word, used::bigint as used from r where used <= 600""")
def hotword_budget(spark, sf_dir):
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey") % 3
    aliases = F.array(F.upper(F.left("p_type", F.lit(3))), F.concat("p_type", F.lit(" kind")), F.lit("x"))
    t = p.select(F.col("p_partkey").alias("id"), F.when(k == 0, "medicine").when(k == 1, "disease").otherwise("symptom").alias("category"), F.concat_ws(" ", "p_name", "p_brand").alias("name"), aliases.alias("aliases"))
    return review.hotwords(t, 600)


@query("""
with e as (select user_id, event_type, count(distinct extract(day from ts) % 2) as runs from events group by user_id, event_type)
select user_id, count(*) filter (runs = 2) as in_all, count(*) as in_any from e group by user_id""")
def set_stability(spark, sf_dir):
    """Odd and even days play two runs, kinds of events the facts found in them."""
    e = read(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("fact"), (F.dayofmonth("ts") % 2).alias("run")).distinct().withColumn("hit", F.lit(True))
    every = e.select("user_id", "fact").distinct().withColumn("run", F.explode(F.array(F.lit(0), F.lit(1))))
    return E.stability(every.join(e, ["user_id", "fact", "run"], "left").fillna(False, ["hit"]), ["user_id"])


@query("""
with c as (select c_custkey, any_value(c_mktsegment) as seg, any_value(c_nationkey) as nat, list_sort(list(distinct o_orderstatus)) as terms from customer join orders on o_custkey = c_custkey group by c_custkey),
p as (select seg, nat, terms, count(*) as n, min(c_custkey) as id from c group by all)
select v.id as visit, e.id as example, 3 + len(list_intersect(v.terms, e.terms)) + (v.nat = e.nat)::int as score, v.n as visits, e.n as examples from p v join p e on e.seg = v.seg""")
def example_similarity(spark, sf_dir):
    """Every customer against every other: those with one profile are scored as one, with how many they are."""
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("visit")).agg(F.array_sort(F.collect_set("o_orderstatus")).alias("terms"))
    c = read(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("visit"))
    p = c.groupBy(F.array("c_mktsegment").alias("dx"), "terms", F.col("c_nationkey").alias("language")).agg(F.min("visit").alias("visit"), F.count("*").alias("n"))
    s = G.example_scores(p, p.withColumnRenamed("visit", "example")).withColumn("score", F.col("score").cast("long"))
    return s.join(p.select("visit", F.col("n").alias("visits")), "visit").join(p.select(F.col("visit").alias("example"), F.col("n").alias("examples")), "example")


@query("""
with w(phrase, n) as (select * from (values ('once daily', 1), ('twice daily', 2), ('three times a day', 3), ('every two hours', 12), ('hourly', 24)))
select o_orderkey, phrase, n::int as per_day from orders, w where w.n = case o_orderkey % 5 when 0 then 1 when 1 then 2 when 2 then 3 when 3 then 12 else 24 end""")
def doses_per_day(spark, sf_dir):
    table = F.array(*[F.lit(x) for x in ("once daily", "twice daily", "three times a day", "every two hours", "hourly")])
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.get(table, (F.col("o_orderkey") % 5).cast("int")).alias("phrase"))
    return o.withColumn("per_day", X.written_per_day(F.col("phrase")))


@query("""
with p as (select source, lang, sum(n_chars) as len, sum((n_chars % 100) * n_chars) as num from documents group by source, lang),
s as (select source, sum(num)::bigint as num, sum(len)::bigint as den, arg_max(lang, struct_pack(l := len, g := lang)) as language from p group by source)
select source, num, den, language, case when num / den >= 85 then 'good' when num / den >= 60 then 'fair' when num / den >= 30 then 'poor' else 'unusable' end as grade from s""")
def review_rollup(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("source").alias("id"), (F.col("n_chars") % 100).alias("estimate"), F.col("n_chars").alias("length"), F.col("lang").alias("language"))
    return review.review_rollup(d).withColumnRenamed("id", "source")


@query("select p_brand as category, count(*) as n from part group by p_brand")
def vocabulary_counts(spark, sf_dir):
    return files.vocabulary_counts(read(spark, sf_dir, "part").select(F.col("p_brand").alias("category")))


@query("select distinct c_nationkey as k from customer except select distinct s_nationkey from supplier where s_acctbal < 0")
def denied_minus_affirmed(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("k"))
    return S.only_denied(read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), s, ["k"])


# --- rows only: no SQL says the same -----------------------------------------------------------


@query()
def transliterate_indic(spark, sf_dir):
    """The Indic sentence after each turn of a conversation, romanised."""
    return speech_queries.numbered(spark, sf_dir).select("conv_id", "turn", X.transliterate_udf(F.element_at(F.split("line", r"\. "), -1)).alias("roman"))


@query()
def align_words(spark, sf_dir):
    """Each turn of a conversation held against the next one, word by word."""
    c = read(spark, sf_dir, "conversations").where("text is not null")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp"))
    d = c.select("conv_id", "turn", F.col("text").alias("ref")).join(after, ["conv_id", "turn"])
    return scans.aligned_rows(d.select("conv_id", "turn", X.normalize_native(F.col("ref")).alias("ref"), X.normalize_native(F.col("hyp")).alias("hyp")), "ref", "hyp")


def _answers(spark, sf_dir) -> DataFrame:
    """(visit, raw): a model's answer for each turn, whole, fenced, with thoughts before it, or cut at any place."""
    c = read(spark, sf_dir, "conversations").where("text is not null")
    items = F.transform(F.slice(F.split("text", " "), 1, 8), lambda w: F.struct(w.alias("name")))
    body = F.to_json(F.struct(F.lit(None).cast("string").alias("note"), items.alias("diagnosis"), F.array("text").alias("advice")))
    kind = (F.col("conv_id") + F.col("turn")) % 4
    fence = F.lit("`" * 3)
    raw = F.when(kind == 0, body).when(kind == 1, F.concat(fence, F.lit("json\n"), body, F.lit("\n"), fence)).when(kind == 2, F.concat(F.lit("<think>so</think> "), body)).otherwise(F.left(body, F.length(body) - F.length("text") % 40 - 1))
    return c.select(F.concat_ws(":", "conv_id", "turn").alias("visit"), raw.alias("raw"))


@query()
def repair_json(spark, sf_dir):
    return _answers(spark, sf_dir).withColumn("json", scans.loose_json("raw"))


@query()
def loop_ratio_phrases(spark, sf_dir):
    return docs_toks(spark, sf_dir).select(F.col("id").alias("doc_id"), F.size("toks").alias("words"), scans.loop_words("toks").alias("looped"))


@query()
def record_rules(spark, sf_dir):
    """All 25 rules in order, over the drafts of every customer."""
    items, _ = R.post_process(*scenes.draft(spark, sf_dir))
    return items


@query()
def record_audit(spark, sf_dir):
    """What the rules did to those drafts."""
    _, audit = R.post_process(*scenes.draft(spark, sf_dir))
    return audit


def part_terms(spark, sf_dir) -> DataFrame:
    """Parts as a vocabulary: name, an abbreviation and a brand as aliases, a longer phrase as people say it."""
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    kinds = F.array(*map(F.lit, ("medicine", "disease", "symptom", "sign")))
    phrase = F.concat(F.lit("the one that is "), F.lower("p_type"), F.lit(" and "), "p_name")
    return p.select(
        F.concat(F.lit("P"), k.cast("string")).alias("id"), F.get(kinds, (k % 4).cast("int")).alias("category"), F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("name"),
        F.array(F.concat(F.upper(F.left("p_type", F.lit(2))), F.col("p_size").cast("string")), F.col("p_brand")).alias("aliases"), F.array(phrase).alias("colloquial"), F.create_map(F.lit("size"), F.col("p_size").cast("string")).alias("details"),
    )


@query()
def vocabulary_forms(spark, sf_dir):
    return M.forms(part_terms(spark, sf_dir))


@query()
def recorded_model_answers(spark, sf_dir):
    prompts = _answers(spark, sf_dir).select("visit", F.concat(F.lit("say ANSWER: "), "raw").alias("prompt"))
    return models.coerce(models.ask(prompts, "mock"))


@query()
def recorded_words(spark, sf_dir):
    """Turns as a recogniser's tokens, words in two pieces each, put together again."""
    c = read(spark, sf_dir, "conversations").where("text is not null")
    pieces = lambda w: F.array(F.concat(F.lit(" "), F.left(w, F.lit(3))), F.substr(w, F.lit(4), F.length(w)))
    toks = F.filter(F.flatten(F.transform(F.split("text", r"\s+"), pieces)), lambda t: F.trim(t) != "")
    t = c.select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.posexplode(toks).alias("pos", "text"))
    return files.words_of_tokens(t.withColumn("p", (1 - (F.length("text") % 5) / 10).cast("double")))


@query()
def hot_words(spark, sf_dir):
    return review.hotwords(part_terms(spark, sf_dir))


def analysis(spark, sf_dir) -> analyze.Analysis:
    """The whole analysis of every conversation: its turns, with a line in Bengali or Hindi and what is denied after each, and parts as vocabulary."""
    c = speech_queries.conversations_in_three_languages(spark, sf_dir)
    p = read(spark, sf_dir, "part")
    names = p.select(F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("name"), (F.col("p_partkey") % 97).alias("k")).groupBy("k").agg(F.min("name").alias("name"))
    heard = c.withColumn("k", F.col("visit") % 97).join(names, "k", "left")
    text = F.concat_ws("\n", "text", F.concat(F.when(F.col("visit") % 2 == 0, "no ").otherwise("there is "), F.col("name")))
    visits = heard.select("visit", text.alias("text"), F.lit(None).cast("string").alias("english"), F.lit(None).cast("string").alias("language"), (F.length(text) / 12.0).alias("seconds"), (0.5 + (F.col("visit") % 50) / 100).alias("confidence"), ((F.col("visit") % 40) / 100).alias("low_ratio"))
    return analyze.analyze(visits, part_terms(spark, sf_dir), T.table(spark, T.KEYWORDS, "category, key, form"), {"en": T.FUNCTION_WORDS["en"]})


@query()
def analyze_quality(spark, sf_dir):
    return analysis(spark, sf_dir).quality


@query()
def analyze_matches(spark, sf_dir):
    return analysis(spark, sf_dir).matches


@query()
def analyze_candidates(spark, sf_dir):
    return analysis(spark, sf_dir).candidates
