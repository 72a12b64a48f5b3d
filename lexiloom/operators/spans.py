"""Spans of texts: longest match, containment, denial, false friends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import denials, intervals
from ..functions.kinds import let

#: Words that deny what follows, and words that end the denial.
DENY, CANNOT, END = ("no", "without", "denies", "deny", "denied", "never", "negative"), ("can't", "cant", "cannot", "unable", "couldn't", "couldnt"), ("but", "however", "except")


def clean_phrase(s: Column) -> Column:
    """Lower-cased, without characters of no width; a hyphen is a space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(s), r"[\x{200B}-\x{200D}\x{FEFF}]", ""), r"[\s-]+", " "))


#: Rows of a vocabulary that are broadcast, counted first; beyond it both sides of a join are shuffled by key.
BROADCAST_ROWS = 100_000


def small_side(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A side to join with: broadcast if it is counted to be small, else merged. What Spark guesses of exploded or made rows is far too little or far too much."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("merge")


def lexicon_hits(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(id, text) and (entry, phrase) -> (id, entry, phrase, start, end): where lexicon phrases stand in texts.

    Latin phrases count at the edges of words, Indic ones anywhere; a hyphen and a space are one.
    Repeats of a phrase don't overlap. Texts and phrases meet on the first word of a Latin phrase
    and on up to three first characters of an Indic one: equi-joins, no nested loop. A small lexicon
    is broadcast, the texts never are.
    """
    told = lexicon.select("entry", clean_phrase(F.col("phrase")).alias("phrase")).where("phrase <> ''").distinct()
    told = told.withColumn("indic", told["phrase"].rlike(r"[\x{0900}-\x{09FF}]"))
    edge = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
    literal = F.regexp_replace(F.regexp_replace("phrase", r"[^\p{L}\p{M}\p{N} ]", r"\\\\$0"), " ", r"[\\s-]")
    told = told.withColumn("pattern", F.when(F.col("indic"), literal).otherwise(F.concat(F.lit(edge[0]), literal, F.lit(edge[1]))))
    low = F.lower("text")
    words = F.array_distinct(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    flat = F.translate(low, "-\n\t", "   ")
    # Look-aheads take no characters: one pass for each length, none for each place.
    starts = F.concat(*[F.regexp_extract_all(flat, F.lit(f"(?s)(?=({'.' * k}))"), F.lit(1)) for k in (1, 2, 3)])
    told = told.withColumn("key", F.when(F.col("indic"), F.left("phrase", F.lit(3))).otherwise(F.regexp_extract("phrase", r"[\p{L}\p{N}]+", 0)))
    latin = texts.select("id", F.explode(words).alias("key")).join(small_side(told.where("not indic")), "key")
    able = texts.where(F.col("text").rlike(r"[\x{0900}-\x{09FF}]"))
    indic = able.select("id", F.explode(F.array_distinct(starts)).alias("key")).join(small_side(told.where("indic")), "key")
    pairs = latin.unionByName(indic).select("id", "entry", "phrase", "pattern").distinct().hint("merge").join(texts.select("id", low.alias("low")), "id")
    # Between the parts that a phrase cuts a text into are the hits.
    found = pairs.select("id", "entry", "phrase", F.expr("regexp_extract_all(low, pattern, 0)").alias("hits"), F.expr("split(low, pattern, -1)").alias("rest")).where(F.size("hits") > 0)
    lengths = lambda xs: F.transform(xs, lambda x: F.length(x))
    total = lambda xs: F.aggregate(lengths(xs), F.lit(0), lambda a, x: a + x)
    each = found.select("id", "entry", "phrase", "rest", "hits", F.posexplode("hits").alias("k", "hit"))
    start = total(F.slice("rest", 1, F.col("k") + 1)) + total(F.slice("hits", 1, F.col("k")))
    return each.select("id", "entry", "phrase", start.alias("start"), (start + F.length("hit")).alias("end"))


def lexicon_terms(hits: DataFrame, lexicon: DataFrame, terms: DataFrame) -> DataFrame:
    """Hits (id, entry, …) with the term (id, name, category) that an entry names, where there is one."""
    wanted = lexicon.select("entry", F.col("term").alias("t_id")).distinct()
    own = terms.select(F.col("id").alias("t_id"), "name", "category").join(small_side(wanted.select("t_id").distinct()), "t_id", "left_semi")
    named = wanted.hint("merge").join(own, "t_id", "left")  # the vocabulary without what no entry names
    return hits.join(small_side(named), "entry", "left").withColumnRenamed("t_id", "term")


def only_denied(denied: DataFrame, positive: DataFrame, keys: list[str]) -> DataFrame:
    """What is denied and nowhere affirmed, once."""
    return denied.select(*keys).distinct().join(positive.select(*keys), keys, "left_anti")


def said_by_one(words: DataFrame, keys: list[str], one: Column, other: Column) -> DataFrame:
    """Rows (…keys) of one speaker without those of the other."""
    return words.where(one).select(*keys).distinct().join(words.where(other).select(*keys), keys, "left_anti")


def longest_wins(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(…keys, start, end): drops a span inside another; of equal spans the first by ``ord`` stays.

    By start and then the longest first, a span lies inside another exactly if one before it
    ends no earlier: a running maximum, no self-join.
    """
    w = Window.partitionBy(*keys).orderBy("start", F.col("end").desc(), "ord")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") < F.col("end"))).drop("_before")


def outside(hits: DataFrame, spans: DataFrame, keys: list[str], inside: bool = False) -> DataFrame:
    """Hits (…keys, start, end) that lie in no span, or with ``inside`` those that lie in one."""
    s = spans.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("start").alias("_s"), F.col("end").alias("_e"))
    on = (F.col("start") >= F.col("_s")) & (F.col("end") <= F.col("_e"))
    for k in keys:
        on &= F.col(k) == F.col(f"_{k}")
    return hits.join(s, on, "left_semi" if inside else "left_anti")


def english_negations(text: Column) -> Column:
    """array<struct<clause, pos, phrase>>: up to four words after a denying word, to the next but; none after can't."""
    clauses = F.split(F.lower(text), r"[?!.,;:\n]+")

    def of_clause(c: Column, k: Column) -> Column:
        toks = F.array_remove(F.split(c, r"[\s\"()]+"), "")

        def at(t: Column, i: Column) -> Column:
            after = F.slice(toks, i + 2, 4)
            stop = F.array_min(F.filter(F.transform(F.array(*[F.lit(w) for w in END]), lambda w: F.array_position(after, w)), lambda p: p > 0))
            part = F.slice(after, 1, F.coalesce(stop - 1, F.lit(4)).cast("int"))
            free = (i == 0) | ~F.coalesce(F.get(toks, i - 1), F.lit("")).isin(*CANNOT)
            says = t.isin(*DENY) & free & (F.size(part) > 0)
            return F.when(says, F.struct(k.cast("int").alias("clause"), i.cast("int").alias("pos"), F.array_join(part, " ").alias("phrase")))

        return F.array_compact(F.transform(toks, at))

    return F.flatten(F.transform(clauses, of_clause))


def inject_lexicon(matches: DataFrame, hits: DataFrame, score: float = 0.95) -> DataFrame:
    """(id, term, score, count) upserted with lexicon hits (id, term, n): at least ``score`` where there is one."""
    h = hits.groupBy("id", "term").agg(F.sum("n").alias("n"))
    both = matches.join(h, ["id", "term"], "full_outer")
    return both.select("id", "term", F.when(F.col("n").isNotNull(), F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(score))).otherwise(F.col("score")).alias("score"), F.coalesce("count", "n").alias("count"))


def drop_denied(matches: DataFrame, denied: DataFrame, positive: DataFrame) -> DataFrame:
    """Matches (id, term, heard) whose term is denied and nowhere affirmed."""
    return matches.join(only_denied(denied, positive, ["id", "term"]), ["id", "term"], "left_anti")


def affirmed_and_denied(text: Column) -> Column:
    """struct<affirmed, denied, spans>: what is left of a text without what it denies, the denied phrases, and where they stand."""
    text = F.coalesce(text, F.lit(""))

    def of(found: Column) -> Column:
        phrases = F.array_join(F.transform(found, lambda n: n["phrase"]), " | ")
        return F.struct(intervals.cut_out(text, found).alias("affirmed"), phrases.alias("denied"), intervals.merged(found).alias("spans"))

    return let(denials.find(text), of)


def denied_by_text(matches: DataFrame, texts: DataFrame) -> DataFrame:
    """Matches (id, term, heard, …) with ``denied``: heard, of three letters or more, is in what the text (id, affirmed, denied: both
    normalised) denies and nowhere in the rest, and no other match of the term is affirmed."""
    d = matches.join(texts.select("id", "affirmed", F.col("denied").alias("_no")), "id", "left")
    only = (F.length("heard") >= 3) & F.contains("_no", "heard") & ~F.contains("affirmed", "heard")
    d = d.withColumn("_only", F.coalesce(only, F.lit(False))).drop("affirmed", "_no")
    return d.withColumn("denied", F.min("_only").over(Window.partitionBy("id", "term"))).drop("_only")


def drop_false_friends(matches: DataFrame, blocks: DataFrame, explicit: DataFrame) -> DataFrame:
    """Matches (id, term, heard) that a blocker (id, term, words) names without the term's own hit, if a word of
    3 letters or more of the one begins with such a word of the other."""
    b = blocks.join(explicit, ["id", "term"], "left_anti").select(F.col("id").alias("b_id"), F.col("term").alias("b_term"), F.filter("words", lambda w: F.length(w) >= 3).alias("b_words"))
    mine = F.filter(F.split("heard", " "), lambda w: F.length(w) >= 3)
    alike = F.exists(mine, lambda w: F.exists("b_words", lambda x: F.startswith(x, w) | F.startswith(w, x)))
    return matches.join(b, (F.col("id") == F.col("b_id")) & (F.col("term") == F.col("b_term")) & alike, "left_anti")


def flag_uncertain(matches: DataFrame, unsure: DataFrame) -> DataFrame:
    """(id, heard) with (id, low: array): whether any heard word is one the speech model was unsure of."""
    return matches.join(unsure, "id", "left").withColumn("uncertain", F.coalesce(F.arrays_overlap(F.split("heard", " "), F.col("low")), F.lit(False))).drop("low")
