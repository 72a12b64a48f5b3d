"""Readers: vocabularies, lexicons, transcripts, audio files, references, saved results, recorded model outputs."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X

AUDIO = r"(?i)\.(?:wav|mp3|m4a|aac|ogg|opus|flac|webm|mp4)$"


@dataclass(frozen=True)
class SheetSpec:
    """Where a sheet's columns go."""

    category: str
    name: str
    aliases: tuple[str, ...] = ()
    colloquial: tuple[str, ...] = ()


def read_sheet(spark: SparkSession, path: str, spec: SheetSpec) -> DataFrame:
    """A CSV export of one sheet: the first row names the columns, the first column is the id. Rows without id or name go."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if spec.name not in raw.columns:
        raise ValueError(f"{path} has no column {spec.name!r}")
    none = F.array().cast("array<string>")
    have = lambda names: [c for c in names if c in raw.columns]
    aliases = F.concat(none, *[F.coalesce(X.split_aliases(F.col(f"`{c}`")), none) for c in have(spec.aliases)])
    colloquial = F.concat(none, *[F.coalesce(X.split_colloquial(F.col(f"`{c}`")), none) for c in have(spec.colloquial)])
    rest = [c for c in raw.columns[1:] if c not in (spec.name, *spec.aliases, *spec.colloquial)]
    details = F.map_filter(F.create_map(*[x for c in rest for x in (F.lit(c), X.clean_cell(F.col(f"`{c}`")))]), lambda _, v: v != "") if rest else F.create_map().cast("map<string,string>")
    name, category = X.clean_cell(F.col(f"`{spec.name}`")), F.lit(spec.category)
    d = raw.select(F.trim(F.col(f"`{raw.columns[0]}`")).alias("id"), category.alias("category"), name.alias("name"), aliases.alias("aliases"), colloquial.alias("colloquial"), details.alias("details"))
    d = d.where((F.coalesce("id", F.lit("")) != "") & (F.coalesce("name", F.lit("")) != ""))
    made = F.array_distinct(F.concat("aliases", X.name_variants(F.col("name")), X.extra_aliases(F.col("name"), F.col("category"))))
    return d.withColumn("aliases", F.filter(made, lambda a: (a != F.col("name")) & X.useful_alias(a, F.col("category"))))


def cell_text(cell: Column) -> Column:
    """The text of a cell that came as JSON: of a rich text its runs, of a formula its result, of a link its text, of a date its day; else itself."""
    runs = F.array_join(F.from_json(F.get_json_object(cell, "$.richText"), "array<struct<text:string>>")["text"], "")
    day = F.left(F.get_json_object(cell, "$.date"), F.lit(10))
    got = F.coalesce(F.nullif(runs, F.lit("")), F.get_json_object(cell, "$.result"), F.get_json_object(cell, "$.text"), day)
    return F.when(cell.startswith("{"), F.coalesce(got, F.lit(""))).otherwise(cell)


def build_vocabulary(spark: SparkSession, sheets: dict[str, SheetSpec]) -> DataFrame:
    """All sheets that can be read as one table; a missing file is left out."""
    out = None
    for path, spec in sheets.items():
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
            continue
        sheet = read_sheet(spark, path, spec)
        out = sheet if out is None else out.unionByName(sheet)
    if out is None:
        raise FileNotFoundError("no sheet can be read")
    return out


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """terms of a JSON file {terms: [...]}."""
    return spark.read.option("multiLine", True).json(path).select(F.inline("terms"))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(lang, phrase, id, hint, block): a row for each phrase of {entries: [...]} or a bare list; entries without phrases go."""
    schema = "lang string, match array<string>, id string, hint string, block array<string>"
    whole = spark.read.schema(f"entries array<struct<{', '.join(c.strip().replace(' ', ':', 1) for c in schema.split(','))}>>").option("multiLine", True).json(path)
    listed = whole.where("entries is not null").select(F.inline("entries"))
    bare = spark.read.schema(schema).option("multiLine", True).json(path).where("match is not null")
    d = listed.unionByName(bare).where(F.size("match") > 0)
    return d.select("lang", F.explode("match").alias("phrase"), "id", "hint", "block")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(visit, text): each file's whole text under its stem."""
    d = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    return d.select(F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("visit"), "text")


def list_audio(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, seconds) of audio files below a folder; seconds as of 16 kHz mono WAV."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return d.where(F.col("path").rlike(AUDIO)).withColumn("seconds", wav_seconds(F.col("length")))


def wav_seconds(length: Column) -> Column:
    """Seconds of 16 kHz mono WAV from a file's bytes."""
    return (length - 44) / 32000.0


def vocabulary_counts(terms: DataFrame) -> DataFrame:
    """Terms of each category."""
    return terms.groupBy("category").agg(F.count("*").alias("n"))


def find_references(files: DataFrame) -> DataFrame:
    """(path) -> (path, reference): <stem>.ref.txt before <stem>.txt, never the file itself."""
    stem = F.regexp_replace("path", r"\.[^./]+$", "")
    refs = files.where(F.col("path").endswith(".txt")).select(F.col("path").alias("reference"))
    refs = refs.select("reference", F.regexp_replace("reference", r"(?:\.ref)?\.txt$", "").alias("stem"), F.when(F.col("reference").endswith(".ref.txt"), 1).otherwise(2).alias("p"))
    d = files.withColumn("stem", stem).join(refs, "stem", "left").where("reference is null or reference <> path")
    best = d.groupBy("path").agg(F.min(F.struct("p", "reference")).alias("x")).select("path", F.col("x.reference").alias("reference"))
    return files.join(best, "path", "left")


def read_approved(spark: SparkSession, path: str) -> DataFrame:
    """Approved records, one JSON a file; what cannot be parsed or has no record or transcript goes. Missing columns are null."""
    schema = "id string, savedAt string, language string, transcript string, english string, prescription string, termIds array<string>, doctor string"
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path).where("prescription is not null and transcript is not null")


def read_cases(spark: SparkSession, path: str, ids: list[str] | None = None, group: str | None = None) -> DataFrame:
    d = spark.read.option("multiLine", True).json(path)
    d = d.where(F.col("id").isin(ids)) if ids else d
    return d.where(F.col("group") == group) if group else d


def words_of_tokens(tokens: DataFrame) -> DataFrame:
    """(id, pos, text, p) -> (id, word_id, w, p): a token that begins with white space opens a word; p is the least of its tokens.

    Special tokens [...] are skipped, as are words with a replacement character.
    """
    t = tokens.where(~F.col("text").rlike(r"^\[.*\]$") & ~F.col("text").rlike(r"^<\|.*\|>$"))
    w = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("word_id", F.sum(F.col("text").rlike(r"^\s").cast("int")).over(w))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    d = t.groupBy("id", "word_id").agg(F.trim(F.array_join(parts, "")).alias("w"), F.round(F.min("p"), 3).alias("p"))
    return d.where((F.col("w") != "") & ~F.contains("w", F.lit("�")))


def read_whisper(spark: SparkSession, path: str) -> DataFrame:
    """Words of a recorded speech model's JSON {transcription: [{tokens: [{text, p}]}]}."""
    schema = "transcription array<struct<tokens:array<struct<text:string,p:double>>>>"
    d = spark.read.schema(schema).option("multiLine", True).json(path).select(F.input_file_name().alias("id"), F.flatten("transcription.tokens").alias("t"))
    return words_of_tokens(d.select("id", F.posexplode("t").alias("pos", "x")).select("id", "pos", "x.text", "x.p"))


def segment_confidence(segments: DataFrame) -> DataFrame:
    """(id, text, avg_logprob) -> mean probability weighted by length, and the share of letters in segments below 0.5."""
    p, n = F.exp("avg_logprob"), F.greatest(F.length("text"), F.lit(1))
    return segments.groupBy("id").agg((F.sum(p * n) / F.sum(n)).alias("confidence"), (F.sum(F.when(p < 0.5, n).otherwise(0)) / F.sum(n)).alias("low_ratio"))


@dataclass(frozen=True)
class Settings:
    """Layered settings: PROD_<name> before <name> in production, then what is here."""

    asr: str = "recorded"
    llm: str = "mock"
    max_candidates: int = 60
    quality_gate: bool = False
    low_conf_p: float = 0.5
    extra: dict = field(default_factory=dict)

    @classmethod
    def load(cls, env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ) if env is None else env
        production = env.get("APP_ENV") == "production"
        got = {}
        for f in fields(cls):
            if f.name == "extra":
                continue
            key = f.name.upper()
            raw = (env.get(f"PROD_{key}") if production else None) or env.get(key)
            if raw is not None:
                kind = type(f.default)
                got[f.name] = raw.lower() in ("1", "on", "true", "yes") if kind is bool else kind(raw)
        return cls(**got)
