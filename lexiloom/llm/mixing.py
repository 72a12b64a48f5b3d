"""Mixing sources to target weights by Pareto order sampling.

Sources share all words by weight; one whose share would be more than a few times its size is held
there, and what it leaves is shared again. A document is expected in the mix as often as its
source's target asks for; its certain whole copies are allocated first. The fraction that is
left is its inclusion probability. Documents are ranked by the odds of a random number
over the odds of inclusion, and the first ones are taken whose words fit into what the source
still lacks: a sample of fixed size, in words. Further rounds go on in the same order with the
documents that still fit.

All is DataFrame functions. Ranks and sums within a source are taken in slices of the ranking
key, with the sums of slices as offsets, so that a source may hold any part of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Weights of sources in order, repeating; most copies of a document, on average and each.
WEIGHTS, MOST = (1, 2, 3), 3
#: Rounds at most, and the part of its target that a source may lack without another one.
ROUNDS, NEAR = 8, 0.001
#: Documents in a slice, about; sources that are broadcast (beyond it the join is shuffled).
SLICE_ROWS, BROADCAST_SOURCES = 8_192, 100_000
SEED = "mix-1"


def words(text: Column) -> Column:
    """How many [^\\x20\\x09-\\x0D]+ a text holds; a letter is kept for each word, not the words."""
    return F.length(F.regexp_replace(F.ltrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r")), r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "x")).cast("long")


def random(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) that depends on the row's id and text alone."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sources: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds weight and target (words) to rows of (none, s, rows, source_size): one for each source."""
    # Ranks by code point without one task for all: sorted parts, and counts of parts as offsets.
    parts = scratch.save(sources.orderBy("none", "s").withColumn("part", F.spark_partition_id()))
    offsets = parts.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("none", "s")) - 1 + F.col("before")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    ranked = scratch.save(parts.join(F.broadcast(offsets.select("part", "before")), "part").withColumn("weight", weight.cast("long")).drop("part", "before"))
    scratch.drop(parts)
    full, share = most * F.col("source_size"), 0.0
    held = F.lit(False)
    count = -1
    while True:
        got = ranked.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("all"),
            F.count_if(held).alias("held"),
            F.coalesce(F.sum(F.when(held, full)), F.lit(0)).alias("words"),
            F.coalesce(F.sum(F.when(~held, F.col("weight"))), F.lit(0)).alias("weight"),
        ).first()
        if got.held == count:
            break
        count = got.held
        share = float(got.all - got.words) / got.weight if got.weight else 0.0
        held = F.lit(share) * F.col("weight") > full
    return ranked.withColumn("target", F.when(held, full.cast("double")).otherwise(F.lit(share) * F.col("weight")))


def _with(rows: DataFrame, sources: DataFrame, count: int) -> DataFrame:
    """Joins what is known of each source; a hot source is split by the broadcast, or by Spark's handling of skewed joins."""
    return rows.join(F.broadcast(sources) if count <= BROADCAST_SOURCES else sources, ["none", "s"])


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, odds: str | None = None, seed: str = SEED, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of each row: ``taken`` words, which is ``copies`` times its size.

    ``odds`` names a column of positive numbers to which expected copies are proportional within a
    source (null, zero and less, and what is no number: never); without it all documents of a
    source are expected equally often. No document has more than ``most`` copies.

    Null and empty texts have the size 0 and take nothing. Null is a source of its own, the last
    one, and differs from the empty name. Repeated rows are rows of their own with equal random
    numbers: of those that tie, any may be taken, which gives the same rows. A source whose documents all
    are larger than what it lacks stays below its target. An empty table gives an empty one. Only
    doc_id, text, source and ``odds`` are read. Runs agree: random numbers depend on id, text and ``seed``.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    given = F.col(odds).cast("double") if odds else F.lit(1.0)
    rows = scratch.save(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").isNull().alias("none"),
            F.coalesce(F.col("source").cast("string"), F.lit("")).alias("s"),
            words(F.col("text")).alias("size"),
            random(F.col("doc_id"), F.col("text"), seed).alias("u"),
            F.when((given > 0) & (given < float("inf")), given).otherwise(0.0).alias("odds"),
        )
    )
    sources = rows.groupBy("none", "s").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
    sources = scratch.save(targets(sources, scratch, weights, most))
    count = sources.count()
    if not count:
        return spark.createDataFrame([], "doc_id long, size long, source_size long, target double, taken long, copies int")

    rate = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    if odds:
        rate = _rates(rows, sources, count, most, scratch)
    known = sources.select("none", "s", "rows", "source_size", "target", rate.alias("rate")) if not odds else rate
    copies = F.least(F.lit(float(most)), F.col("rate") * F.col("odds"))
    rows = _with(rows, known.select("none", "s", "rate"), count).withColumn("whole", F.floor(copies)).withColumn("p", copies - F.floor(copies))
    odds_of = (F.col("u") / (1 - F.col("u"))) * ((1 - F.col("p")) / F.col("p"))
    rows = scratch.save(rows.select("doc_id", "none", "s", "size", F.col("whole").cast("int").alias("copies"), F.when((F.col("p") > 0) & (F.col("size") > 0), odds_of).alias("q")))
    for _ in range(ROUNDS):
        more = _round(rows, known, count, slice_rows, scratch)
        if more is None:
            break
        rows = more
    return _with(rows, known.select("none", "s", "source_size", "target"), count).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def _rates(rows: DataFrame, sources: DataFrame, count: int, most: int, scratch: Scratch) -> DataFrame:
    """Sources with the rate at which rate x odds, held at ``most``, sums up to the target (or all that can be had)."""
    known = sources.withColumn("rate", F.lit(0.0))
    before = None
    while True:
        held = F.col("rate") * F.col("odds") >= most
        free = F.when(~held, F.col("size") * F.col("odds"))
        sums = _with(rows, known.select("none", "s", "rate"), count).groupBy("none", "s").agg(
            F.count_if(held & (F.col("odds") > 0)).alias("held"), F.coalesce(F.sum(F.when(held, most * F.col("size"))), F.lit(0)).alias("got"), F.coalesce(F.sum(free), F.lit(0.0)).alias("free")
        )
        rate = F.when(F.col("free") > 0, F.greatest((F.col("target") - F.col("got")) / F.col("free"), F.col("rate"))).otherwise(F.col("rate"))
        known = scratch.save(_with(known, sums, count).withColumn("rate", rate).select(*known.columns, "held"))
        now = known.agg(F.sum("held")).first()[0]
        known = known.drop("held")
        if now == before:
            return known
        before = now


def _round(rows: DataFrame, known: DataFrame, count: int, slice_rows: int, scratch: Scratch) -> DataFrame | None:
    """Another copy for those that come first in order and fit together into what their source lacks; None if none do."""
    lacks = F.col("target") - F.coalesce("got", F.lit(0))
    got = rows.groupBy("none", "s").agg(F.sum(F.col("size") * F.col("copies")).alias("got"))
    open_ = scratch.save(_with(known.select("none", "s", "target"), got, count).select("none", "s", lacks.alias("lacks")).where(lacks > NEAR * F.col("target")))
    fits = F.col("q").isNotNull() & (F.col("size") <= F.col("lacks"))
    able = _with(rows, open_, count).where(fits)
    able_of = scratch.save(able.groupBy("none", "s").agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.first("lacks").alias("lacks")))
    if not able_of.count():
        return None
    # Slices of about equal counts: q over the odds of the mean inclusion, as a number from 0 to 1.
    mean = F.least(F.col("lacks") / F.col("words"), F.lit(1 - 1e-9))
    slices = able_of.select("none", "s", "lacks", (mean / (1 - mean)).alias("odds"), F.ceil(F.col("n") / slice_rows).alias("slices"))
    joined = rows.join(F.broadcast(slices) if count <= BROADCAST_SOURCES else slices, ["none", "s"], "left")
    at = F.col("q") * F.col("odds")
    key = F.when(fits, F.least(F.floor(at / (1 + at) * F.col("slices")), F.col("slices") - 1)).otherwise(-1 - F.pmod(F.xxhash64("doc_id", "size"), F.lit(64)))
    joined = joined.withColumn("slice", key).drop("odds", "slices")
    # Written, as the window below reads it by slice and the sums of slices are joined to that.
    joined = scratch.save(joined)
    before = Window.partitionBy("none", "s").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = joined.where("slice >= 0").groupBy("none", "s", "slice").agg(F.sum("size").alias("sum")).withColumn("before", F.coalesce(F.sum("sum").over(before), F.lit(0))).drop("sum")
    own = Window.partitionBy("none", "s", "slice").orderBy("q", "size", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    some = joined.where("slice >= 0").withColumn("cum", F.sum("size").over(own)).join(sums, ["none", "s", "slice"])
    taken = F.col("before") + F.col("cum") <= F.col("lacks")
    some = some.select("doc_id", "none", "s", "size", (F.col("copies") + taken.cast("int")).alias("copies"), F.when(~taken, F.col("q")).alias("q"))
    rest = joined.where("slice < 0").select("doc_id", "none", "s", "size", "copies", "q")
    out = scratch.save(some.unionByName(rest))
    scratch.drop(rows, open_, able_of, joined)
    return out


def _oracle() -> str:
    digest = f"substr(md5('{SEED}|' || coalesce(doc_id::varchar, '') || '|' || coalesce(text, '')), 1, 13)"
    sql = rf"""
with d as (
  select row_number() over () as r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, (('0x' || {digest})::bigint + 0.5::double) / {1 << 52}::double as u
  from documents
), s as (
  select source, sum(size)::bigint as source_size, list_extract({list(WEIGHTS)}, ((row_number() over (order by source nulls last) - 1) % {len(WEIGHTS)} + 1)::int) as weight from d group by source
), o as (
  select *, sum(source_size) over () as everything, sum(weight) over () as weights, {MOST} * source_size / weight::double as ratio,
         row_number() over (order by {MOST} * source_size / weight::double, source nulls last) as k
  from s
), b as (
  select *, (everything - coalesce(sum({MOST} * source_size) over (order by k rows between unbounded preceding and 1 preceding), 0))::double
            / (weights - coalesce(sum(weight) over (order by k rows between unbounded preceding and 1 preceding), 0))::double as share
  from o
), fill as (select min_by(share, k) as share from b where share * weight <= {MOST} * source_size),
t as (
  select s.source, source_size, case when share * weight > {MOST} * source_size then ({MOST} * source_size)::double else share * weight end as target,
         coalesce(target / nullif(source_size, 0), 0) as rate
  from s, fill
), r0 as (
  select d.r, d.doc_id, d.source, d.size, floor(rate)::bigint as copies,
         case when rate > floor(rate) and size > 0 then (u / (1 - u)) * ((1 - (rate - floor(rate))) / (rate - floor(rate))) end as q
  from d join t on d.source is not distinct from t.source
)"""
    for i in range(ROUNDS):
        sql += f""", l{i} as (
  select t.source, any_value(target) - sum(size * copies) as lacks from r{i} a join t on a.source is not distinct from t.source group by t.source having any_value(target) - sum(size * copies) > {NEAR} * any_value(target)
), c{i} as (
  select r, sum(size) over (partition by a.source order by q, size, doc_id, r rows unbounded preceding) <= lacks as taken
  from r{i} a join l{i} l on a.source is not distinct from l.source where q is not null and size <= lacks
), r{i + 1} as (
  select a.r, doc_id, source, size, copies + coalesce(taken::int, 0) as copies, case when not coalesce(taken, false) then q end as q from r{i} a left join c{i} c on a.r = c.r
)"""
    return sql + f"""
select doc_id, size, source_size, target, (size * copies)::bigint as taken, copies::int as copies from r{ROUNDS} a join t on a.source is not distinct from t.source
"""


#: The same rows, with windows over whole sources.
ORACLE = _oracle()
