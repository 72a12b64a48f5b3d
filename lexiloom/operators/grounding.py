"""Grounding of records in a vocabulary: by id, by name, by brand; cautions, gaps, and merging of what was missed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .rules import supported

#: Categories that a section's items may come from.
SECTION_CATEGORIES = {
    "chief_complaints": ("symptom", "disease"), "history.systemic": ("abbreviation", "disease"), "history.ocular": ("disease", "procedure", "abbreviation"), "examination": ("test", "optical", "abbreviation"),
    "clinical_findings": ("sign", "disease", "abbreviation"), "diagnosis": ("disease", "abbreviation"), "medications": ("medicine",), "procedures": ("procedure",), "investigations": ("test",), "advice": ("counselling",),
}
RISKS = ("asthma", "copd", "heart block", "bradycardia", "pregnan", "sulfa", "diabet", "glaucoma", "kidney", "renal", "children", "infant")


def resolve(items: DataFrame, names: DataFrame) -> DataFrame:
    """(…, kb_id, name, category) against ``names`` (id, norm, category, ord): by id, by whole name, by first word; the first in order wins.

    An id of the wrong category counts as none. Distinct items are resolved once, and of names
    and of first words only the first term in order is looked up.
    """
    first = lambda d, *keys: d.groupBy(*keys).agg(F.min(F.struct("ord", "id")).alias("x"))
    head = lambda c: F.element_at(F.split(c, " "), 1)
    ids = names.select(F.col("id").alias("i_id"), F.col("category").alias("i_cat")).distinct()
    n = names.select("id", "norm", F.col("category").alias("n_cat"), "ord")
    whole = first(n, "norm", "n_cat").select(F.col("norm").alias("w_norm"), F.col("n_cat").alias("w_cat"), F.col("x.id").alias("w_id"))
    begins = first(n.withColumn("h", head(F.col("norm"))), "h", "n_cat").select("h", F.col("n_cat").alias("h_cat"), F.col("x.id").alias("h_id"))
    d = items.select("kb_id", "name", "category").distinct().withColumn("_norm", X.normalize(F.col("name")))
    d = d.join(ids, (F.col("kb_id") == F.col("i_id")) & (F.col("category") == F.col("i_cat")), "left")
    d = d.join(whole, (F.col("_norm") == F.col("w_norm")) & (F.col("category") == F.col("w_cat")), "left")
    d = d.join(begins, (head(F.col("_norm")) == F.col("h")) & (F.length("h") >= 5) & (F.col("category") == F.col("h_cat")), "left")
    how = F.when(F.col("i_id").isNotNull(), "id").when(F.col("w_id").isNotNull(), "name").when(F.col("h_id").isNotNull(), "head")
    d = d.select(F.col("kb_id").alias("_k"), F.col("name").alias("_n"), F.col("category").alias("_c"), F.coalesce("i_id", "w_id", "h_id").alias("term"), how.alias("how"))
    same = F.col("kb_id").eqNullSafe(F.col("_k")) & F.col("name").eqNullSafe(F.col("_n")) & F.col("category").eqNullSafe(F.col("_c"))
    return items.join(d, same, "left").drop("_k", "_n", "_c")


def ids_in(record: Column) -> Column:
    """Every kb_id in a record's JSON, at any depth, once."""
    return F.array_distinct(F.regexp_extract_all(record, F.lit(r'"kb_id"\s*:\s*"([^"]+)"'), F.lit(1)))


def risk_checks(medicines: DataFrame, histories: DataFrame, risks: tuple[str, ...] = RISKS) -> DataFrame:
    """(visit, medicine, caution) and (visit, text): the risk words that stand in both, as rows."""
    words = lambda c: F.filter(F.array(*[F.lit(r) for r in risks]), lambda r: F.contains(F.lower(c), r))
    m = medicines.select("visit", "medicine", F.explode(words(F.col("caution"))).alias("risk"))
    h = histories.select("visit", F.explode(words(F.col("text"))).alias("risk")).distinct()
    return m.join(h, ["visit", "risk"]).select("visit", "medicine", "risk")


def missing_fields(items: DataFrame) -> DataFrame:
    """Medicines (visit, name, frequency, duration, eye) with the fields that are empty."""
    gap = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c))
    return items.withColumn("missing", F.array_compact(F.array(gap("frequency"), gap("duration"), gap("eye")))).where(F.size("missing") > 0)


def content_words(normed: Column) -> Column:
    stop = ("the", "and", "with", "for", "was", "are", "has", "have", "that", "this", "from")
    return F.filter(F.split(normed, " "), lambda w: (F.length(w) >= 3) & ~w.isin(*stop))


def covered(item: Column, lines: Column) -> Column:
    """At least 0.6 of an item's words begin a word of the lines, or have their first five letters anywhere in them. Both are normalised columns."""
    ws = content_words(item)
    text = F.concat(F.lit(" "), lines)
    hit = F.size(F.filter(ws, lambda w: F.contains(text, F.concat(F.lit(" "), w)) | ((F.length(w) >= 5) & F.contains(text, F.left(w, F.lit(5))))))
    return (F.size(ws) > 0) & (hit * 10 >= F.size(ws) * 6)


def same_quote(a: Column, b: Column) -> Column:
    x, y = X.normalize(a), X.normalize(b)
    return (x == y) | ((F.length(x) >= 6) & F.contains(y, x)) | ((F.length(y) >= 6) & F.contains(x, y))


COMMENTARY, IMPERATIVE = r"(?i)conversation|transcript|the doctor (?:said|asked)|was discussed", r"(?i)^(?:avoid|use|wear|take|wash|do not|don't|keep|stop|continue|come|return|apply|clean)"


def merge_missed(missed: DataFrame, drafted: DataFrame, most: int = 12) -> DataFrame:
    """(visit, ord, kind, text, evidence, heard) and (visit, lines) -> with ``action``: skip, add or warn.

    Unsupported rows and commentary go first, then at most ``most`` of a visit stay. Rows that
    the draft covers are skipped; short complaints and imperative advice are added.
    """
    d = missed.where(supported(F.col("evidence"), F.col("heard")) & ~F.col("text").rlike(COMMENTARY))
    d = d.withColumn("_n", F.row_number().over(Window.partitionBy("visit").orderBy("ord"))).where(F.col("_n") <= most).drop("_n")
    d = d.join(drafted, "visit", "left").withColumns({"_item": X.normalize(F.col("text")), "_lines": X.normalize(F.coalesce("lines", F.lit("")))})
    short = F.size(F.split("text", " ")) <= 6
    action = F.when(covered(F.col("_item"), F.col("_lines")), "skip").when((F.col("kind") == "complaint") & short, "add").when((F.col("kind") == "advice") & F.col("text").rlike(IMPERATIVE), "add").otherwise("warn")
    return d.withColumn("action", action).drop("lines", "_item", "_lines")


def repair_merge(items: DataFrame, repaired: DataFrame) -> DataFrame:
    """Repaired items for empty sections: complaints if there are none; examination and findings if both are empty, else rows about the fundus only."""
    counts = items.groupBy("visit").agg(F.count(F.when(F.col("section") == "chief_complaints", 1)).alias("_c"), F.count(F.when(F.col("section").isin("examination", "clinical_findings"), 1)).alias("_e"))
    r = repaired.join(counts, "visit", "left").fillna(0, ["_c", "_e"])
    fundus = F.col("name").rlike("(?i)fundus|retina|disc|macula|vitre|cup")
    keep = ((F.col("section") == "chief_complaints") & (F.col("_c") == 0)) | (F.col("section").isin("examination", "clinical_findings") & ((F.col("_e") == 0) | fundus))
    return items.unionByName(r.where(keep).select(*items.columns))


def empty_sections(visits: DataFrame, items: DataFrame) -> DataFrame:
    """(visit, text): sections that were spoken of and have no item."""
    said = F.array_compact(F.array(F.when(F.col("text").rlike("(?i)pain|itch|red|water|blur|complain|trouble"), "chief_complaints"), F.when(F.col("text").rlike("(?i)vision|pressure|slit|fundus|6/[0-9]"), "examination")))
    return visits.select("visit", F.explode(said).alias("section")).hint("merge").join(items.select("visit", "section").distinct(), ["visit", "section"], "left_anti")


def example_scores(wanted: DataFrame, approved: DataFrame) -> DataFrame:
    """(visit, dx, terms, language) and (example, …): 3 for a shared diagnosis, 1 for a shared term, 1 for the language; a diagnosis is needed."""
    a = approved.select(F.col("example"), F.col("dx").alias("a_dx"), F.col("terms").alias("a_terms"), F.col("language").alias("a_lang"), F.explode(F.array_distinct("dx")).alias("d"))
    pairs = wanted.withColumn("d", F.explode(F.array_distinct("dx"))).join(a, "d").drop("d").distinct()
    score = 3 * F.size(F.array_intersect("dx", "a_dx")) + F.size(F.array_intersect("terms", "a_terms")) + (F.col("language") == F.col("a_lang")).cast("int")
    return pairs.select("visit", "example", score.alias("score"))
