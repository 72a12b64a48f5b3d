"""Writers and renderers: JSON, Markdown, CSV reports, training chats, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.evaluation import train_valid


def write_json(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite").option("ignoreNullFields", True)
    (w.partitionBy(*by) if by else w).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; quotes doubled."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def append_runs(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def record_markdown(items: DataFrame) -> DataFrame:
    """(visit, section, idx, name, eye) -> (visit, md): a heading for each section, a bullet for each item."""
    line = F.concat(F.lit("- "), F.col("name"), F.when(F.coalesce("eye", F.lit("")) != "", F.concat(F.lit(" ("), F.col("eye"), F.lit(")"))).otherwise(""))
    per = items.groupBy("visit", "section").agg(F.array_sort(F.collect_list(F.struct("idx", line.alias("line")))).alias("x"))
    title = F.initcap(F.regexp_replace("section", "[._]", " "))
    text = F.concat(F.lit("## "), title, F.lit("\n"), F.array_join(F.col("x.line"), "\n"))
    return per.groupBy("visit").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", text.alias("t")))), lambda s: s["t"]), "\n\n").alias("md"))


def quality_markdown(quality: DataFrame) -> DataFrame:
    """(id, tier, score, warnings: array) -> (id, md): the tier with its score, a bullet for each warning."""
    head = F.concat(F.lit("**Transcript quality: "), "tier", F.lit("** ("), F.round(F.col("score") * 100).cast("int").cast("string"), F.lit("%)"))
    return quality.select("id", F.concat_ws("\n", head, F.array_join(F.transform("warnings", lambda w: F.concat(F.lit("- "), w)), "\n")).alias("md"))


def report_markdown(gated: DataFrame, key: str) -> DataFrame:
    """A summary with gates -> (key, line): a table row each, thousandths as per cent, failed gates named."""
    gates = [c for c in gated.columns if c.endswith("_gate")]
    failed = F.array_join(F.array_compact(F.array(*[F.when(~F.col(c), F.lit(c.removesuffix("_gate"))) for c in gates])), ", ")
    recall = F.format_string("%d.%d%%", F.expr("recall_sum div cases div 10").cast("int"), F.expr("recall_sum div cases % 10").cast("int"))
    cells = F.concat_ws(" | ", F.col(key).cast("string"), F.col("cases").cast("string"), recall, F.col("violations").cast("string"), F.when(failed == "", "passed").otherwise(F.concat(F.lit("failed: "), failed)))
    return gated.select(key, F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))


def save_approved(records: DataFrame, path: str) -> None:
    """(visit, language, transcript, prescription, …) appended as JSON, each under an id from the time and its visit."""
    now = F.current_timestamp()
    stamped = records.withColumns({"id": F.concat_ws("-", F.date_format(now, "yyyyMMddHHmmss"), F.col("visit").cast("string")), "savedAt": iso_stamp(now)})
    stamped.write.mode("append").option("ignoreNullFields", True).json(path)


def iso_stamp(ts: Column) -> Column:
    """UTC to the second, as in file names and saved records."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH-mm-ss")


def denial_notes(denied: DataFrame) -> DataFrame:
    """(id, heard, term) -> (id, note): each distinct pair once, in order."""
    line = F.concat(F.lit("- "), "heard", F.when(F.coalesce("term", F.lit("")) != "", F.concat(F.lit(" ["), "term", F.lit("]"))).otherwise(""))
    return denied.select("id", line.alias("line")).distinct().groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("note"))


def diff_markdown(alignment: Column) -> Column:
    """An inline diff: ~~missed~~, **inserted**, ~~said~~ **heard**."""
    return F.array_join(
        F.transform(
            alignment,
            lambda a: F.when(a["op"] == "ok", a["ref"]).when(a["op"] == "del", F.concat(F.lit("~~"), a["ref"], F.lit("~~"))).when(a["op"] == "ins", F.concat(F.lit("**"), a["hyp"], F.lit("**"))).otherwise(F.concat(F.lit("~~"), a["ref"], F.lit("~~ **"), a["hyp"], F.lit("**"))),
        ),
        " ",
    )


def batch_averages(results: DataFrame, columns: list[str]) -> DataFrame:
    """Means over what is there and finite."""
    return results.agg(*[F.avg(F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))).alias(c) for c in columns])


def candidate_line(id: Column, category: Column, name: Column, aliases: Column, details: Column, heard: Column) -> Column:
    also = F.array_join(F.slice(aliases, 1, 6), ", ")
    return F.concat(id, F.lit(" ["), category, F.lit("] "), name, F.when(also != "", F.concat(F.lit(" ("), also, F.lit(")"))).otherwise(""), F.when(details != "", F.concat(F.lit(" — "), details)).otherwise(""), F.lit(" «"), heard, F.lit("»"))


def prompts(visits: DataFrame, lines: DataFrame, notes: DataFrame) -> DataFrame:
    """(visit, text), (visit, ord, line) and (visit, note) -> (visit, prompt), sections in a fixed order."""
    c = lines.groupBy("visit").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("candidates"))
    d = visits.join(c, "visit", "left").join(notes, "visit", "left")
    return d.select("visit", F.concat_ws("\n\n", F.concat(F.lit("CANDIDATES\n"), F.coalesce("candidates", F.lit("(none detected)"))), F.nullif("note", F.lit("")), F.concat(F.lit("TRANSCRIPT\n"), F.col("text"))).alias("prompt"))


def export_training(chats: DataFrame, key: str, path: str) -> None:
    """(key, prompt, answer) -> JSON lines below train and valid."""
    message = F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content"))).alias("messages")))
    parts = train_valid(chats, key)
    for part in ("train", "valid"):
        parts.where(F.col("part") == part).select(message.alias("value")).write.mode("overwrite").text(f"{path}/{part}")


def review_sheet(rows: DataFrame, matched: DataFrame, broken: DataFrame) -> DataFrame:
    """Rows (case, section, text) for an expert, labelled: forbidden, found, or not in the expected list."""
    m = matched.select("case", "text").distinct().withColumn("_hit", F.lit(True))
    b = broken.select("case", "text").distinct().withColumn("_bad", F.lit(True))
    d = rows.join(m, ["case", "text"], "left").join(b, ["case", "text"], "left")
    return d.select("case", "section", "text", F.when(F.col("_bad"), "FORBIDDEN").when(F.col("_hit"), "✓").otherwise("not in expected list").alias("label"))
