"""Hard negatives by blocked dense products.

Anchors go in blocks of a bounded size, each broadcast once, against blocks of candidates: one
matrix product scores a block against a block. Components are whole numbers, so a product in
float64 is exact while all partial sums stay below 2^53; blocks that could pass that bound are
multiplied in whole numbers of any size. A first pass keeps the best positives of each anchor, and
lists of two blocks merge into the best of both. A second pass gives every positive's window
of scores its best negatives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Bytes of anchors that are broadcast at once, and anchors at most: a lot. Products held at once in a task.
LOT_BYTES, LOT_ROWS, CELLS = 32 << 20, 8_192, 1 << 21
#: Whole numbers below this are exact in float64; scores beyond a long are held at its ends.
EXACT, LONG = 1 << 53, (1 << 63) - 1
_LAST = np.iinfo(np.int64).max


def _whole(x: np.ndarray) -> np.ndarray:
    """floor(256 x): float64, or Python's whole numbers where one is 2^53 or more."""
    with np.errstate(over="ignore"):
        y = np.floor(256.0 * x)
    if not y.size or np.abs(y).max() < EXACT:
        return y
    return np.array([[int(v) * 256 if abs(v) >= EXACT else int(np.floor(256.0 * v)) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of rows of a and of b, exact; int64 but for products beyond a long, which are held at its ends."""
    dims = a.shape[1]
    most = (int(np.abs(a).max()) * int(np.abs(b).max()) * dims) if a.size and b.size else 0
    if most < EXACT:
        return (np.asarray(a, np.float64) @ np.asarray(b, np.float64).T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in row] for row in m.tolist()], dtype=object).reshape(m.shape)
    return np.clip(whole(a) @ whole(b).T, -LONG - 1, LONG).astype(np.int64)


class Best:
    """The first ``k`` (score, id) of each row, higher scores and then smaller ids first; where taken is False nothing is held."""

    def __init__(self, rows: int, k: int):
        self.score = np.full((rows, k), -LONG - 1, np.int64)
        self.id = np.full((rows, k), _LAST, np.int64)
        self.taken = np.zeros((rows, k), bool)

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray, ok: np.ndarray) -> None:
        """Merges a block: score and ok are (rows, columns), columns ascend by id."""
        k = self.score.shape[1]
        ok = ok & (~self.taken[rows, -1:] | (score >= self.score[rows, -1:]))
        hit = ok.any(axis=1)
        if not hit.any():
            return
        rows, score, ok = rows[hit], score[hit], ok[hit]
        n = score.shape[1]
        if n > k:  # what is above the k-th score of the block, and of what equals it the first ids
            low = np.where(ok, score, -LONG - 1)
            cut = np.partition(low, n - k, axis=1)[:, n - k][:, None]
            above = ok & (score > cut)
            tied = ok & (score == cut)
            ok = above | (tied & (tied.cumsum(axis=1) <= k - above.sum(axis=1)[:, None]))
        r, c = np.nonzero(ok)
        at = np.arange(len(r)) - np.searchsorted(r, r)
        new = Best(len(rows), k)
        new.score[r, at], new.id[r, at], new.taken[r, at] = score[r, c], ids[c], True
        both = [np.concatenate([getattr(self, x)[rows], getattr(new, x)], axis=1) for x in ("score", "id", "taken")]
        order = np.lexsort((both[1], ~both[0], ~both[2]), axis=-1)[:, :k]  # ~ reverses whole numbers without an overflow
        self.score[rows], self.id[rows], self.taken[rows] = (np.take_along_axis(x, order, axis=1) for x in both)


class Lot:
    """A lot of anchors as arrays; sent to all workers."""

    def __init__(self, table: pa.Table):
        self.uid, self.vec_id = table["uid"].to_numpy(), table["vec_id"].to_numpy()
        self.label = table["label"].to_numpy()
        dims = table["dim"].to_numpy()
        self.part = {}
        for d in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == d)
            flat = table["e"].take(pa.array(rows)).combine_chunks()
            self.part[d] = (rows, _whole(_flat(flat, len(rows), d)))


def _flat(lists: pa.Array | pa.ChunkedArray, rows: int, dim: int) -> np.ndarray:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, dim)


def _blocks(batches: Iterator[pa.RecordBatch], lot: Lot) -> Iterator[tuple]:
    """(anchors' places, candidates' id, uid, label, scores) of all blocks against blocks; candidates ascend by id."""
    for batch in batches:
        ids = batch.column("vec_id").fill_null(_LAST).to_numpy(zero_copy_only=False)
        uid, label, dims = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("uid", "label", "dim"))
        for d, (rows, a) in lot.part.items():
            mine = np.flatnonzero(dims == d)
            if not len(mine):
                continue
            mine = mine[np.argsort(ids[mine], kind="stable")]
            across = min(len(mine), 4_096)
            down = max(1, CELLS // across)
            for i in range(0, len(mine), across):
                some = mine[i : i + across]
                b = _whole(_flat(batch.column("e").take(pa.array(some)), len(some), d))
                for j in range(0, len(rows), down):
                    yield rows[j : j + down], ids[some], uid[some], label[some], products(a[j : j + down], b)


_POSITIVES = "anchor long, anchor_id long, vec_id long, score long"
_NEGATIVES = "anchor long, positive_score long, vec_id long, score long"


def _out(cols: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64(), mask=v == _LAST if c == "vec_id" else None) for c, v in cols.items()})


def _positives(candidates: DataFrame, lot, most: int) -> DataFrame:
    """Pass 1: each task's best positives of each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: Lot = lot.value
        best = Best(len(anchors.uid), most)
        for rows, ids, uid, label, score in _blocks(batches, anchors):
            best.add(rows, score, ids, (anchors.label[rows][:, None] == label) & (anchors.uid[rows][:, None] != uid))
        r, c = np.nonzero(best.taken)
        if len(r):
            yield _out({"anchor": anchors.uid[r], "anchor_id": anchors.vec_id[r], "vec_id": best.id[r, c], "score": best.score[r, c]})

    return candidates.mapInArrow(run, _POSITIVES)


def _negatives(candidates: DataFrame, lot, windows, most: int) -> DataFrame:
    """Pass 2: each task's best negatives in each window of each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: Lot = lot.value
        place, tops, low, high = windows.value  # places ascend
        best = Best(len(place), most)
        first, end = np.searchsorted(place, np.arange(len(anchors.uid)), "left"), np.searchsorted(place, np.arange(len(anchors.uid)), "right")
        deepest = int((end - first).max(initial=0))
        for rows, ids, _, label, score in _blocks(batches, anchors):
            other = anchors.label[rows][:, None] != label
            for k in range(deepest):
                has = np.flatnonzero(first[rows] + k < end[rows])
                w = first[rows[has]] + k
                s = score[has]
                best.add(w, s, ids, other[has] & (s >= low[w][:, None]) & (s <= high[w][:, None]))
        r, c = np.nonzero(best.taken)
        if len(r):
            yield _out({"anchor": anchors.uid[place[r]], "positive_score": tops[r], "vec_id": best.id[r, c], "score": best.score[r, c]})

    return candidates.mapInArrow(run, _NEGATIVES)


def _valid(vectors: DataFrame) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    whole = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), e.alias("e")).where("label is not null and e is not null").where(whole)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select("vec_id", moved.alias("label"), "e", F.size("e").alias("dim"), F.monotonically_increasing_id().alias("uid"))


def _first(df: DataFrame, by: list[str], most: int) -> DataFrame:
    """The first rows of each key by score and id."""
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, lot_rows: int = LOT_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of all anchors, rows whose vec_id is divisible by ``every``.

    Rows with a null label, a null vector or a null or non-finite component take no part. A row
    is a row: those that share a vec_id are candidates, anchors and positives each for itself,
    and a row without vec_id is a candidate with no id that comes last among ties. Vectors of
    different lengths are not compared; those of no components score 0. An anchor without other
    rows of its label, or a positive with an empty window (such as one with a negative score),
    gives no rows. Scores beyond a long are held at its ends. An empty table gives an empty one;
    other columns are not read.

    Work grows with anchors times rows: a stated query set against all rows. Memory does not:
    a lot of anchors, one block of products and the best of each anchor are held.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "hardneg")
    rows = scratch.save(_valid(vectors))
    anchors = rows.where(F.col("vec_id") % every == 0)
    size = anchors.agg(F.count("*").alias("n"), F.coalesce(F.sum(8 * F.col("dim") + 24), F.lit(0)).alias("bytes")).first()
    lots = max(1, -(-size.n // lot_rows), -(-size.bytes // LOT_BYTES))
    found: list[DataFrame] = []
    for i in range(lots if size.n else 0):
        held = anchors.where(F.pmod(F.xxhash64("uid"), F.lit(lots)) == i).select("uid", "vec_id", "label", "dim", "e").toArrow()
        if held.num_rows:
            found.append(_of_lot(spark, scratch, rows, held, positives, negatives, low, high))
    if not found:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def _of_lot(spark: SparkSession, scratch: Scratch, rows: DataFrame, held: pa.Table, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """Both passes for one lot of anchors; written, so that a lot's broadcasts are not needed after it."""
    lot = spark.sparkContext.broadcast(Lot(held))
    best = scratch.save(_first(_positives(rows, lot, positives), ["anchor"], positives))
    # A window per score: positives of one score share it. At most ``positives`` windows for an anchor of the lot.
    got = best.where("score >= 0").select("anchor", "score").distinct().toArrow()
    order = np.argsort(lot.value.uid)
    place = order[np.searchsorted(lot.value.uid, got["anchor"].to_numpy(), sorter=order)] if got.num_rows else np.zeros(0, np.int64)
    tops = got["score"].to_numpy()
    by = np.lexsort((tops, place))
    place, tops = place[by], tops[by]
    ends = np.array([[-(-low * t // 100), min(LONG, high * t // 100)] for t in tops.tolist()], np.int64).reshape(-1, 2)
    windows = spark.sparkContext.broadcast((place, tops, ends[:, 0], ends[:, 1]))
    bad = _first(_negatives(rows, lot, windows, negatives), ["anchor", "positive_score"], negatives)
    bad = bad.select("anchor", "positive_score", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    good = best.select("anchor", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return scratch.save(good.join(bad, ["anchor", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


#: The same rows, by all pairs of anchors and rows; scores are exact in doubles while below 2^53.
ORACLE = """
with v as (
  select row_number() over () as uid, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), pairs as (
  select a.uid as anchor, a.vec_id as anchor_id, c.vec_id, c.label = a.label as same, list_inner_product(a.q, c.q)::bigint as score
  from v a join v c on a.uid <> c.uid and len(a.q) = len(c.q)
  where a.vec_id % 100 = 0
), good as (
  select anchor, anchor_id, vec_id as positive_id, score as positive_score, row_number() over (partition by anchor order by score desc, vec_id) as k
  from pairs where same qualify k <= 5
), found as (
  select g.*, p.vec_id as negative_id, p.score as negative_score, row_number() over (partition by g.anchor, g.k order by p.score desc, p.vec_id) as r
  from good g join pairs p on p.anchor = g.anchor and not p.same and 80 * g.positive_score <= 100 * p.score and 100 * p.score <= 100 * g.positive_score
  qualify r <= 5
)
select anchor_id, positive_id, r::int as rank, negative_id, positive_score, negative_score from found
"""
