"""Shards of even size by balanced label propagation.

Documents with equal texts are linked, through their group instead of in pairs. All rows begin
in shards of exactly even counts. In each round every group without a home proposes the shard
that holds most of it, among those with enough room, and quotas accept proposals, those that
mend most links for a moved row first, while the groups at home fit a shard's capacity. Rows of
groups without a home take no room, as they leave it in the end: a swap needs no free rows.
Groups larger than a shard are handled as several. Groups that no shard has room for
as a whole fill up what is left one after the other, then rows without links do, so that the
counts of any two shards differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

ROUNDS, BUCKET_ROWS = 6, 100_000


def _ranked(df: DataFrame, by: list[str], name: str, rows: int, key: str = "rid") -> DataFrame:
    """Adds a gapless rank from 0 within ``by``: rows are ranked in hashed buckets, and bucket counts give the offsets.

    Rows with equal ``key`` follow each other.
    """
    buckets = max(1, -(-rows // BUCKET_ROWS))
    d = df.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(buckets)))
    offsets = (
        d.groupBy(*by, "_b")
        .agg(F.count("*").alias("_n"))
        .withColumn("_o", F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("_n")
    )
    w = Window.partitionBy(*by, "_b").orderBy(*dict.fromkeys((key, "rid")))
    return d.withColumn("_r", F.row_number().over(w) - 1).join(offsets, [*by, "_b"]).withColumn(name, F.col("_r") + F.col("_o")).drop("_b", "_r", "_o")


def _within(able: DataFrame, free: Column, proposals: int) -> DataFrame:
    """The proposals (gid, home, all, gain) that a home's free rows take, the best first: (gid, home, all).

    Gains are put in levels, an eighth of a doubling each, and levels in hashed slices. Sums of
    slices give the offsets, so that no task ranks all proposals of a home.
    """
    slices = max(1, -(-proposals // BUCKET_ROWS))
    level = F.when(F.col("gain").isNull(), 1 << 20).otherwise(F.floor(8 * F.log2(F.greatest(F.col("gain"), F.lit(1e-9))))).cast("int")
    able = able.withColumns({"level": level, "slice": F.pmod(F.xxhash64("gid"), F.lit(slices))})
    before = Window.partitionBy("home").orderBy(F.col("level").desc(), "slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = able.groupBy("home", "level", "slice").agg(F.sum("all").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = Window.partitionBy("home", "level", "slice").orderBy(F.col("gain").desc_nulls_first(), "gid").rowsBetween(Window.unboundedPreceding, 0)
    summed = able.withColumn("sum", F.sum("all").over(own)).join(offsets, ["home", "level", "slice"])
    return summed.where(F.col("sum") + F.col("offset") <= free[F.col("home")]).select("gid", "home", "all")


def shard(docs: DataFrame, shards: int = 24, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row, under the law ``rows``.

    A null text has the size 8, the checksum 0 and no links; an empty text is a text like
    others, and a long one counts as one row. Repeated rows are rows of their own with equal
    texts. Of equally good shards the one that comes first after the group's own hash is
    proposed. An empty table gives an empty one. Other columns are not read; grown_shard is
    null under this law.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.xxhash64(F.lit(1), "text")).alias("g0"),
        F.when(F.col("text").isNotNull(), F.xxhash64(F.lit(2), "text")).alias("g1"),
    )
    rows = scratch.save(rows.withColumn("rid", F.struct("doc_id", "size", "text_crc32", "g0", "g1")))
    total = rows.count()
    base = scratch.save(_ranked(rows, [], "rank", total).drop("rid").withColumnRenamed("rank", "rid"))
    scratch.drop(rows)
    small, more = divmod(total, shards)
    room = {s: small + (s < more) for s in range(shards)}
    start = F.pmod(F.col("rid"), F.lit(shards)).cast("int")

    # Written out, so that the join to the rows has a shuffle of its own, which can be split at a hot group.
    groups = scratch.save(base.where("g0 is not null").groupBy("g0", "g1").agg(F.count("*").alias("n")).where("n > 1"))
    # A group that fits a shard is whole; a larger one is handled as parts of about half a shard.
    parts = F.when(F.col("n") <= max(1, small), 1).otherwise(F.ceil(F.col("n") / max(1, small // 2)))
    linked = base.join(groups, ["g0", "g1"]).select("rid", start.alias("shard"), F.xxhash64("g0", "g1", F.pmod(F.xxhash64("rid"), parts)).alias("gid"))
    linked = scratch.save(linked)
    held = {s: 0 for s in range(shards)}  # rows of groups at home
    open_ = scratch.save(linked.groupBy("gid", "shard").agg(F.count("*").alias("n")))
    homes: DataFrame | None = None
    spent = [groups]
    for _ in range(rounds):
        free = F.create_map(*[F.lit(x) for s in room for x in (s, max(0, room[s] - held[s]))])
        turn = F.pmod(F.col("shard") - F.pmod(F.col("gid"), F.lit(shards)), F.lit(shards))  # ties go to different shards
        able = (
            open_.withColumns({"all": F.sum("n").over(Window.partitionBy("gid")), "whole": F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("gid"))})
            .where(free[F.col("shard")] >= F.col("all"))
            .groupBy("gid")
            .agg(F.max(F.struct(F.col("n").alias("n"), (-turn).alias("t"), F.col("shard").alias("shard"))).alias("x"), F.first("all").alias("all"), F.first("whole").alias("whole"))
            .select("gid", F.col("x.shard").alias("home"), "all", ((F.col("all") * F.col("all") - F.col("whole")) / F.nullif(F.col("all") - F.col("x.n"), F.lit(0))).alias("gain"))
        )
        able = scratch.save(able)
        taken = scratch.save(_within(able, free, able.count()))
        scratch.drop(able)
        flow = taken.groupBy("home").agg(F.sum("all").alias("n")).collect()  # a row for each shard at most
        if not flow:
            break
        for r in flow:
            held[r.home] += r.n
        taken = taken.select("gid", "home")
        homes = taken if homes is None else homes.unionByName(taken)
        spent.append(open_)
        open_ = scratch.save(open_.join(taken, "gid", "left_anti"))
    placed = linked.join(homes, "gid").select("rid", F.col("home").alias("shard")) if homes is not None else linked.select("rid", "shard").where("false")

    left = linked.join(open_.select("gid").distinct(), "gid").select("gid", "rid")
    waits = left.count()
    loose = _ranked(base.select("rid").join(linked.select("rid"), "rid", "left_anti"), [], "k", total).select("rid", (F.col("k") + waits).alias("k"))
    loose = _ranked(left, [], "k", waits, "gid").select("rid", "k").unionByName(loose)
    ends, end = [], 0
    for s in range(shards):
        end += room[s] - held[s]
        ends.append(end)
    filled = loose.select("rid", sum(((F.col("k") >= e).cast("int") for e in ends[:-1]), F.lit(0)).alias("shard"))
    put = scratch.save(placed.unionByName(filled))
    scratch.drop(*spent, open_, linked)
    out = _ranked(base.join(put, "rid"), ["shard"], "slot", max(1, small))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
