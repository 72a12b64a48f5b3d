"""Benchmark decontamination with spaced-seed hashing, in DataFrame operations only.

A document leaks an item if some 13 consecutive words of each agree, place by place, in at
least 11. Items of fewer words must occur whole and unchanged; the shortest that are looked for
are a parameter, as runs of a few words occur anywhere by chance. Seeds are hashes of 6 words picked by a fixed mask, others ignored. The two masks are
lossless for this: whatever 2 of 13 places differ, one of them fits somewhere between. All
seeds of all documents meet all seeds of the benchmark; each hit is verified around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, free_names

#: Words of a window and how many agree; words of the shortest items that are looked for unless the caller says otherwise (1: all).
WINDOW, AGREE, SHORTEST = 13, 11, 5
MASKS = ("###-----###", "###-###")
#: Seeds and words of items that are broadcast; beyond it the joins are shuffled.
BROADCAST_SEEDS, BROADCAST_WORDS = 1_000_000, 2_000_000


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _seed(words: Column, at: Column, mask: str, number: int) -> Column:
    return F.xxhash64(F.lit(number), *[F.get(words, at + k) for k, c in enumerate(mask) if c == "#"])


def _item_seeds(items: DataFrame) -> DataFrame:
    """(h, item_id, pos) of items of WINDOW words or more."""
    long = items.where(F.size("bw") >= WINDOW)
    parts = []
    for number, mask in enumerate(MASKS):
        at = long.select("item_id", "bw", F.explode(F.sequence(F.lit(0), F.size("bw") - len(mask))).alias("pos"))
        parts.append(at.select(_seed(F.col("bw"), F.col("pos"), mask, number).alias("h"), "item_id", "pos"))
    return parts[0].unionByName(parts[1]).distinct()


def _window_hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, th, item_id) where a window of an item agrees."""
    seeds = _item_seeds(items)
    n = F.size("w")
    short = min(map(len, MASKS))
    # One number for place and mask: the seeds of a document come from one generator, without a copy of its words.
    rows = docs.where(n >= WINDOW).select("doc_id", "th", "w", F.explode(F.sequence(F.lit(0), 2 * (n - short) + 1)).alias("j"))
    at = F.shiftright("j", 1)
    hashed = F.when(F.col("j") % 2 == 1, _seed(F.col("w"), at, MASKS[1], 1)).when(at + len(MASKS[0]) <= n, _seed(F.col("w"), at, MASKS[0], 0))
    rows = rows.select("doc_id", "th", "w", at.alias("i"), hashed.alias("h"))
    if seeds.count() <= BROADCAST_SEEDS:
        hits = rows.join(F.broadcast(seeds), "h")
    else:
        own = docs.select(F.col("doc_id").alias("d_"), F.col("th").alias("t_"), "w")
        hits = rows.select("doc_id", "th", "i", "h").join(seeds, "h").join(own, F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("th") == F.col("t_")))
    around = WINDOW + max(map(len, MASKS))
    # The words about the hit, beginning with the document's word that faces the item's word `low`.
    low = F.greatest(F.lit(0), F.col("pos") - WINDOW, F.col("pos") - F.col("i"))
    hits = hits.select("doc_id", "th", "item_id", low.alias("low"), F.slice("w", F.col("i") - F.col("pos") + low + 1, 2 * around).alias("part")).distinct()
    words = items.agg(F.sum(F.size("bw"))).first()[0] or 0
    facing = hits.join(F.broadcast(items) if words <= BROADCAST_WORDS else items, "item_id").select(
        "doc_id", "th", "item_id", F.zip_with("part", F.slice("bw", F.col("low") + 1, F.size("part")), lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0))).alias("same")
    )
    starts = F.sequence(F.lit(1), F.size("same") - WINDOW + 1)
    agree = F.exists(starts, lambda s: F.aggregate(F.slice("same", s, WINDOW), F.lit(0), lambda x, y: x + y) >= AGREE)
    return facing.where(F.when(F.size("same") >= WINDOW, agree).otherwise(F.lit(False))).select("doc_id", "th", "item_id").distinct()


def _whole_hits(docs: DataFrame, items: DataFrame, shortest: int) -> DataFrame | None:
    """(doc_id, th, item_id) where a short item occurs whole. A seed for each length that items have."""
    small = items.where((F.size("bw") >= max(1, shortest)) & (F.size("bw") < WINDOW)).select("item_id", F.size("bw").alias("k"), F.xxhash64(F.concat_ws(" ", "bw")).alias("h"))
    sizes = [r[0] for r in small.select("k").distinct().collect()]  # less than WINDOW numbers
    out = None
    for k in sorted(sizes):
        rows = docs.where(F.size("w") >= k).select("doc_id", "th", "w", F.explode(F.sequence(F.lit(0), F.size("w") - k)).alias("i"))
        rows = rows.select("doc_id", "th", F.xxhash64(F.concat_ws(" ", F.slice("w", F.col("i") + 1, k))).alias("h"))
        own = small.where(F.col("k") == k).select("h", "item_id")
        hit = rows.join(F.broadcast(own) if own.count() <= BROADCAST_SEEDS else own, "h").select("doc_id", "th", "item_id").distinct()
        out = hit if out is None else out.unionByName(hit)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, th, item_ids) of the documents that leak; ``th`` tells texts of one doc_id apart."""
    d = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), words_of(F.col("text")).alias("w"))
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), words_of(F.col("text")).alias("bw"))
    hits = _window_hits(d, items)
    whole = _whole_hits(d, items, shortest)
    hits = hits if whole is None else hits.unionByName(whole)
    return hits.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))


def scan(docs: DataFrame, benchmark: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids) of each row.

    A null or empty text leaks nothing, nor does one that is shorter than an item's window; long
    ones are read whole. Items without id or text, or with fewer than ``shortest`` words, are not
    looked for. Repeated rows get equal results, as do equal benchmark items, each under its own
    id; ids are in order. Other columns are not read. An empty table gives an empty one; an empty
    benchmark leaves all rows clean.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"))
    found = leaks(docs, benchmark, shortest).select(F.col("doc_id").alias("d_"), F.col("th").alias("t_"), "item_ids")
    both = rows.join(found, rows.doc_id.eqNullSafe(F.col("d_")) & (rows.th == F.col("t_")), "left")
    ids = F.coalesce("item_ids", F.array().cast("array<long>"))
    return both.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """The rows of ``docs`` that leak nothing, with all columns, whatever they are called."""
    found = leaks(docs, benchmark, shortest).select("doc_id", "th")
    found = Scratch(docs.sparkSession, "leaks").save(found)
    doc, text = free_names(docs, "leak_doc", "leak_text")
    found = found.toDF(doc, text)
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(docs["text"]) == F.col(text))
    return docs.join(F.broadcast(found) if found.count() <= BROADCAST_SEEDS else found, same, "left_anti")


#: The same rows in DuckDB, from four-word runs: of 13 places with 2 that differ, 4 in a row agree.
ORACLE = r"""
with b as (select item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as bw from benchmark where text is not null),
d as (select doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents where text is not null),
bg as (select item_id, i, bw[i + 1] || ' ' || bw[i + 2] || ' ' || bw[i + 3] || ' ' || bw[i + 4] as g from (select item_id, bw, unnest(range(0, len(bw) - 3)) as i from b)),
dg as (select doc_id, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] as g from (select doc_id, w, unnest(range(0, len(w) - 3)) as i from d)),
c as (select distinct dg.doc_id, bg.item_id, dg.i - bg.i as o from dg join bg using (g)),
f as (
  select c.doc_id, c.item_id, len(b.bw) as n,
    list_transform(range(greatest(0, -c.o), least(len(b.bw), len(d.w) - c.o)), lambda k: case when d.w[k + c.o + 1] = b.bw[k + 1] then 1 else 0 end) as s
  from c join b using (item_id) join d using (doc_id)),
hit as (
  select distinct doc_id, item_id from f
  where case when n >= 13 then len(list_filter(range(0, len(s) - 12), lambda k: list_sum(s[k + 1 : k + 13]) >= 11)) > 0
             when n >= 5 then len(s) = n and list_sum(s) = n else false end),
per as (select doc_id, list_sort(list(item_id)) as item_ids from hit group by doc_id)
select documents.doc_id, per.item_ids is not null as contaminated, coalesce(len(per.item_ids), 0)::bigint as n_items,
  coalesce(per.item_ids, cast([] as bigint[])) as item_ids
from documents left join per on documents.doc_id = per.doc_id
"""
