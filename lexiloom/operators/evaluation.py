"""Evaluation: error rates, facts found, gates, slices, precision and recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scans

#: Gates of a release.
GATES = (("mean_recall", 0.90), ("worst_recall", 0.80), ("critical", 0.95), ("violations", 0.0), ("consistency", 0.90), ("errors", 0.0))


def error_counts(pairs: DataFrame) -> DataFrame:
    """(…, ref_words, hyp_words) -> with sub, del and ins counts."""
    d = pairs.withColumn("al", scans.alignment("ref_words", "hyp_words"))
    count = lambda op: F.size(F.filter("al", lambda x: x["op"] == op))
    return d.withColumns({"subs": count("sub"), "dels": count("del"), "inss": count("ins")}).drop("al")


def error_rate(errors: Column, reference: Column, heard: Column) -> Column:
    """Errors for a thousand words; all wrong if there is no reference but something was heard, none if there is neither."""
    return F.when(reference == 0, F.when(heard > 0, 1000).otherwise(0)).otherwise(F.floor(errors * 1000 / reference)).cast("int")


def confusions(aligned: DataFrame, most: int = 15) -> DataFrame:
    """(al) -> the most frequent substitutions."""
    d = aligned.select(F.explode("al").alias("x")).where("x.op = 'sub'").groupBy("x.ref", "x.hyp").agg(F.count("*").alias("n"))
    return d.orderBy(F.col("n").desc(), "ref", "hyp").limit(most)


def matched_facts(facts: DataFrame, rows: DataFrame) -> DataFrame:
    """Facts (case, fact, sections, patterns, eye) with rows (case, section, text, eye): whether one row has it all.

    A row's eye must be the fact's; BE stands for either, and a fact for both eyes is also met
    by a row for each. Facts and rows grow with the cases: both are shuffled, whatever Spark guesses of their size.
    """
    f = facts.withColumn("section", F.explode("sections"))
    both = f.hint("merge").join(rows.select("case", "section", "text", F.col("eye").alias("row_eye")), ["case", "section"])
    both = both.where(F.forall("patterns", lambda p: F.regexp_like(F.lower("text"), p)))
    eye = F.coalesce("eye", F.lit(""))
    own = (eye == "") | (F.col("row_eye") == eye) | (eye.isin("RE", "LE") & (F.col("row_eye") == "BE"))
    hit = both.groupBy("case", "fact").agg(
        F.max(own.cast("int")).alias("own"), F.max((F.col("row_eye") == "RE").cast("int")).alias("re"), F.max((F.col("row_eye") == "LE").cast("int")).alias("le"), F.first("eye").alias("_eye")
    )
    hit = hit.select("case", "fact", ((F.col("own") == 1) | ((F.col("_eye") == "BE") & (F.col("re") == 1) & (F.col("le") == 1))).alias("hit"))
    return facts.hint("merge").join(hit, ["case", "fact"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def violations(forbid: DataFrame, rows: DataFrame) -> DataFrame:
    """Forbidden patterns (case, label, sections, pattern) that some row has."""
    f = forbid.withColumn("section", F.explode("sections"))
    r = rows.select(F.col("case").alias("r_case"), F.col("section").alias("r_section"), "text")
    on = (F.col("case") == F.col("r_case")) & (F.col("section") == F.col("r_section")) & F.regexp_like(F.lower("text"), F.col("pattern"))
    return f.hint("merge").join(r, on, "left_semi").select("case", "label").distinct()


def score_cases(found: DataFrame, broken: DataFrame) -> DataFrame:
    """Facts (case, fact, critical, hit) and violations (case, label) -> (case, hit, facts, critical_hit, critical, violations)."""
    own = found.groupBy("case").agg(
        F.sum(F.col("hit").cast("long")).alias("hit"), F.count("*").alias("facts"), F.sum((F.col("critical") & F.col("hit")).cast("long")).alias("critical_hit"), F.sum(F.col("critical").cast("long")).alias("critical")
    )
    bad = broken.groupBy("case").agg(F.count("*").alias("violations"))
    return own.hint("merge").join(bad, "case", "left").withColumn("violations", F.coalesce("violations", F.lit(0)))


def summarise(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Scores of cases -> by ``keys``: recall in thousandths, mean and least, pooled critical facts, violations."""
    recall = F.expr("hit * 1000 div greatest(facts, 1)")
    return scores.groupBy(*keys).agg(
        F.count("*").alias("cases"), F.sum(recall).alias("recall_sum"), F.min(recall).alias("worst_recall"), F.sum("critical_hit").alias("critical_hit"), F.sum("critical").alias("critical"), F.sum("violations").alias("violations")
    )


def gates(summary: DataFrame) -> DataFrame:
    """A summary -> with a column for each gate it can tell: passed or not."""
    at = dict(GATES)
    return summary.select(
        "*",
        ratio_gate(F.col("recall_sum"), F.col("cases") * 1000, at["mean_recall"]).alias("mean_recall_gate"),
        (F.col("worst_recall") >= int(at["worst_recall"] * 1000)).alias("worst_recall_gate"),
        ratio_gate(F.col("critical_hit"), F.col("critical"), at["critical"]).alias("critical_gate"),
        (F.col("violations") <= int(at["violations"])).alias("violations_gate"),
    )


def slices(df: DataFrame, sets: list[list[str]], *measures: Column) -> DataFrame:
    """Measures for each of several sets of columns, in one pass; ``level`` says which columns a row leaves out."""
    every = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *every).agg(F.grouping_id(*every).cast("int").alias("level"), *measures)


def label_counts(df: DataFrame, keys: list[str], predicted: str, truth: str) -> DataFrame:
    """True and false positives and false negatives by ``keys``."""
    count = lambda p, q: F.count(F.when((F.col(predicted) == p) & (F.col(truth) == q), 1))
    return df.groupBy(*keys).agg(count(1, 1).alias("tp"), count(1, 0).alias("fp"), count(0, 1).alias("fn"))


def stability(hits: DataFrame, keys: list[str]) -> DataFrame:
    """(…keys, fact, run, hit): facts found in all runs and in any run."""
    per = hits.groupBy(*keys, "fact").agg(F.sum(F.col("hit").cast("int")).alias("n"), F.countDistinct("run").alias("runs"))
    return per.groupBy(*keys).agg(F.count(F.when(F.col("n") == F.col("runs"), 1)).alias("in_all"), F.count(F.when(F.col("n") > 0, 1)).alias("in_any"))


def ratio_gate(hit: Column, of: Column, least: float) -> Column:
    """hit / of >= least, in whole numbers."""
    return hit * 1000 >= of * int(round(least * 1000))


def ranked(df: DataFrame, key: str, width: int = 65_536) -> DataFrame:
    """Adds ``rank``, gapless from 0 in the order of a long key: ranks within slices of the key, offset by slice counts."""
    d = df.withColumn("_slice", F.floor(F.col(key) / width))
    counts = d.groupBy("_slice").agg(F.count("*").alias("_n"))
    off = counts.select("_slice", F.coalesce(F.sum("_n").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    w = Window.partitionBy("_slice").orderBy(key)
    return d.withColumn("_r", F.row_number().over(w) - 1).join(off, "_slice").withColumn("rank", F.col("_r") + F.col("_off")).drop("_slice", "_r", "_off")


def train_valid(df: DataFrame, key: str, share: float = 0.1) -> DataFrame:
    """Every k-th row for validation, k = ceil(n / wanted), up to the wanted number; one at least of two rows."""
    n = df.count()
    want = max(1, int(share * n + 0.5)) if n >= 2 else 0
    k = -(-n // want) if want else n + 1
    r = ranked(df, key)
    return r.withColumn("part", F.when((F.col("rank") % k == 0) & (F.floor(F.col("rank") / k) < want), "valid").otherwise("train"))
