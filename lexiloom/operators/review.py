"""Reviews and reports: weak matches, warnings, hot words, item rows, review rollups, error texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.kinds import let

#: What is put into words of a service's failure.
FAILURES = ((r"(?i)econnrefused|connection refused", "the service is not running"), (r"(?i)timed? ?out", "the service took too long"), (r"(?i)credential|unauthori[sz]ed|access denied", "the service did not accept the credentials"), (r"(?i)enotfound|name or service not known", "the service's host is unknown"))
PRIORITY = ("medicine", "disease", "procedure", "investigation", "sign", "symptom")


def strong_enough(matches: DataFrame, least: float = 0.75) -> DataFrame:
    """Without fuzzy matches of diseases and signs that score below ``least``."""
    return matches.where(~((F.col("kind") == "fuzzy") & F.col("category").isin("disease", "sign") & (F.col("score") < least)))


def explain_error(error: Column) -> Column:
    out = error
    for pattern, said in reversed(FAILURES):
        out = F.when(error.rlike(pattern), said).otherwise(out)
    return out


def warnings_of(tier: Column, truncated: Column, unsure: Column, translation: Column) -> Column:
    """Messages for the reader, those that hold."""
    return F.array_compact(
        F.array(
            F.when(tier == "unusable", "The transcript is not usable; check everything."),
            F.when(tier == "low", "The transcript is noisy; every term needs checking."),
            F.when(truncated, "The model's answer was cut off; items may be missing."),
            F.when(unsure > 0, F.concat(unsure.cast("string"), F.lit(" terms were heard where the speech model was unsure."))),
            F.when(translation == "loopy", "The translation repeats itself and was not used."),
            F.when(translation == "rejected", "The translation was not used for this language."),
        )
    )


def hotwords(terms: DataFrame, most_chars: int = 600) -> DataFrame:
    """(category, name, aliases) -> words in order of category, names before medicines' aliases, while they fit ``most_chars``.

    A vocabulary is small; the running sum is over one window.
    """
    rank = F.lit(len(PRIORITY))
    for i, c in reversed(list(enumerate(PRIORITY))):
        rank = F.when(F.col("category") == c, i).otherwise(rank)
    also = F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: a.rlike("^[A-Z]{2,5}$") | (F.length(a) > 5))
    w = terms.select(rank.alias("c"), F.posexplode(F.concat(F.array("name"), F.when(F.col("category") == "medicine", also).otherwise(F.array().cast("array<string>")))).alias("o", "word"))
    w = w.groupBy(F.lower("word").alias("key")).agg(F.min(F.struct(F.least("o", F.lit(1)).alias("o"), "c", "word")).alias("x")).select("x.*")
    run = Window.orderBy("o", "c", "word").rowsBetween(Window.unboundedPreceding, 0)
    return w.withColumn("used", F.sum(F.length("word") + 2).over(run)).where(F.col("used") <= most_chars).select("word", "used")


def item_rows(items: DataFrame) -> DataFrame:
    """(case, section, name, eye, attrs) -> a line of text for each item, to be looked for facts in."""
    values = F.array_join(F.filter(F.map_values(F.coalesce("attrs", F.create_map().cast("map<string,string>"))), lambda v: v != ""), " ")
    return items.select("case", "section", "eye", F.trim(F.concat_ws(" ", "name", "eye", values)).alias("text"))


def review_rollup(chunks: DataFrame) -> DataFrame:
    """(id, estimate, length, language) -> the estimate weighted by length as two whole numbers, and the language of most of it."""
    per = chunks.groupBy("id", "language").agg(F.sum("length").alias("len"), F.sum(F.col("estimate") * F.col("length")).alias("num"))
    out = per.groupBy("id").agg(F.sum("num").alias("num"), F.sum("len").alias("den"), F.max_by("language", F.struct("len", "language")).alias("language"))
    percent = F.col("num") / F.greatest(F.col("den"), F.lit(1))
    return out.withColumn("grade", F.when(percent >= 85, "good").when(percent >= 60, "fair").when(percent >= 30, "poor").otherwise("unusable"))


def change_ratio(before: Column, after: Column) -> Column:
    """Character edits for each character there was."""
    a, b = X.char_seq(before), X.char_seq(after)
    return F.when(F.length(a) > 0, F.levenshtein(a, b) / F.length(a)).otherwise(F.when(F.length(b) > 0, 1.0).otherwise(0.0))


def chunked(texts: DataFrame, most: int = X.CHUNK) -> DataFrame:
    """(id, text) -> (id, part, chunk): each text in chunks for a model, from part 0 on."""
    return texts.select("id", F.posexplode(X.chunks(F.col("text"), most)).alias("part", "chunk"))


#: Share of its letters that a text may change, issues of a chunk and of a text.
MOST_CHANGE, CHUNK_ISSUES, TEXT_ISSUES = 0.35, 15, 25


def reassembled(parts: DataFrame, answers: DataFrame, most_change: float = MOST_CHANGE) -> DataFrame:
    """(id, part, chunk) and what a model said of them (id, part, corrected, estimate, language, summary, issues: array, cut) -> a row for each id.

    ``original`` and ``corrected`` are the chunks in order, those without a correction as they were. ``edits`` of ``letters``
    say how much was changed, chunk by chunk where that is little; ``used`` is whether that is at most ``most_change`` of them; a text whose length alone says that
    it isn't has no ``edits``. ``text`` is the corrected text if it is used, and ``kept`` takes each chunk's
    correction or leaves it by the chunk's own share. ``num`` of ``den`` is the estimate weighted by length, ``language``
    that of most letters, ``summary`` the summaries in order, ``issues`` the first ones, ``warnings`` what is missing or was cut.
    """
    d = parts.join(answers, ["id", "part"], "left")
    fixed = F.when(F.trim(F.coalesce("corrected", F.lit(""))) != "", F.trim("corrected")).otherwise(F.col("chunk"))
    rating = F.when(F.col("estimate").isNotNull() & ~F.isnan("estimate"), X.clamp(F.col("estimate"), 0.0, 100.0))
    part = F.concat(F.lit("part "), (F.col("part") + 1).cast("string"))
    warn = F.array_compact(F.array(F.when(F.coalesce("cut", F.lit(False)), F.concat(part, F.lit(": the answer was cut short"))), F.when(rating.isNull(), F.concat(part, F.lit(": no estimate")))))
    few = F.slice(F.coalesce("issues", F.array().cast("array<string>")), 1, CHUNK_ISSUES)
    d = d.select("id", "part", "chunk", fixed.alias("fixed"), rating.alias("estimate"), "language", "summary", few.alias("issues"), warn.alias("warn"), _change("chunk", fixed, most_change).alias("c"))
    row = F.struct("part", "chunk", "fixed", "c", "estimate", "language", F.nullif(F.col("summary"), F.lit("")).alias("summary"), "issues", "warn")
    g = d.groupBy("id").agg(F.array_sort(F.collect_list(row)).alias("p"))
    joined = lambda f, sep=" ": F.array_join(F.transform("p", f), sep)
    size = lambda x: F.length(x["chunk"])
    total = lambda f: F.aggregate(F.transform("p", f), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    names = F.array_distinct(F.array_compact(F.transform("p", lambda x: F.nullif(x["language"], F.lit("")))))
    votes = F.transform(names, lambda n: F.struct(total(lambda x: F.when(x["language"] == n, size(x).cast("double"))).alias("n"), n.alias("name")))
    g = g.select(
        "id",
        F.size("p").alias("parts"),
        joined(lambda x: x["chunk"]).alias("original"),
        joined(lambda x: x["fixed"]).alias("corrected"),
        joined(lambda x: F.when(x["c"]["fits"], x["fixed"]).otherwise(x["chunk"])).alias("kept"),
        total(lambda x: x["estimate"] * size(x)).alias("num"),
        total(lambda x: size(x).cast("double")).alias("den"),
        F.coalesce(F.array_max(votes)["name"], F.lit("")).alias("language"),
        F.array_join(F.array_compact(F.transform("p", lambda x: x["summary"])), " ").alias("summary"),
        F.slice(F.flatten(F.transform("p", lambda x: x["issues"])), 1, TEXT_ISSUES).alias("issues"),
        F.flatten(F.transform("p", lambda x: x["warn"])).alias("warnings"),
        F.when(F.forall("p", lambda x: x["c"]["edits"].isNotNull()), total(lambda x: x["c"]["edits"].cast("double"))).cast("int").alias("_edits"),
        total(lambda x: x["c"]["letters"].cast("double")).cast("int").alias("_letters"),
    )
    # The edits of the chunks bound those of the whole from above; only between both bounds is the whole compared.
    few_edits = F.col("_edits") <= most_change * F.greatest(F.col("_letters"), F.lit(1))
    whole = F.when(few_edits, F.struct(F.col("_edits").alias("edits"), F.lit(True).alias("fits"))).otherwise(let(_change("original", F.col("corrected"), most_change), lambda c: F.struct(c["edits"].alias("edits"), c["fits"].alias("fits"))))
    g = g.withColumn("_c", whole)
    rewritten = F.when(~F.col("_c.fits"), F.array(F.lit("the correction changes too much and is not used"))).otherwise(F.array().cast("array<string>"))
    grade = F.col("num") / F.greatest(F.col("den"), F.lit(1.0))
    return g.select(
        "id", "parts", "original", "corrected", "kept", F.when(F.col("_c.fits"), F.col("corrected")).otherwise(F.col("original")).alias("text"), F.col("_c.edits").alias("edits"), F.col("_letters").alias("letters"), F.col("_c.fits").alias("used"),
        "num", "den", F.when(grade >= 85, "high").when(grade >= 60, "medium").when(grade >= 30, "low").otherwise("unusable").alias("quality"), "language", "summary", "issues", F.concat("warnings", rewritten).alias("warnings"),
    )


def _change(before: str, after: Column, most_change: float) -> Column:
    """struct<edits, letters, more, fits>: edits are null where the lengths alone differ too much; ``more`` is the difference of lengths."""

    def of(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        most, more = most_change * F.greatest(F.length(a), F.lit(1)), F.abs(F.length(a) - F.length(b))
        told = lambda e: F.struct(e.alias("edits"), F.length(a).alias("letters"), more.alias("more"), F.coalesce(e <= most, F.lit(False)).alias("fits"))
        return let(F.when(more <= most, X.edit_distance(a, b)), told)

    return let(F.struct(X.char_seq(F.col(before)).alias("a"), X.char_seq(after).alias("b")), of)
