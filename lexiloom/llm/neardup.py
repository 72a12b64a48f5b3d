"""MinHash near-duplicate groups with a multi-index Hamming join.

A document's set of distinct word shingles gets a signature of 32 symbols of 16 bits.
Documents with equal sets form a class first; classes are joined on their signatures:

* the signature is split into 8 chunks of 4 symbols. If two signatures differ in at most
  15 symbols, some chunk pair differs in at most floor(15 / 8) = 1 symbol;
* that one error is enumerated: each chunk gives 4 keys, each without one symbol. Two
  signatures within the threshold share one of the 32 keys, whatever the data are;
* the signature distance of every pair that shares a key is computed, and pairs within the
  threshold are confirmed on the full shingle sets.

At the similarity s a symbol differs with the probability 1 - s, so the chance that a linked
pair is beyond 15 of 32 is 3.5e-6 at s = 0.85 and 1.4e-4 at s = 0.8.

Groups of near copies would give all pairs within a bucket. Instead, the members of a bucket
are first compared with its smallest member, and those within the threshold are joined into
clusters; then members in different clusters are left. They are dealt into blocks, each pair of
blocks is a task, and a task returns no more than a spanning forest of the near pairs it finds.
So every pair that shares a key and is within the threshold ends in one cluster. On full sets
links are confirmed likewise: with the nearest first member, then between the blocks of a
cluster whose members aren't in one group yet.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow import map_slices
from .components import connected_components
from .scratch import Scratch

SYMBOLS, CHUNKS, MAX_DISTANCE = 32, 8, 15
#: Ids that are broadcast to pick out documents; beyond it the join is shuffled.
BROADCAST_IDS = 500_000
_SIG = [f"s{i}" for i in range(CHUNKS)]
_ODD = (np.random.default_rng(20_260_101).integers(0, 2**63, SYMBOLS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = np.random.default_rng(20_260_102).integers(0, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Hash of a word; forgets all when full, to bound memory."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


def shingle_set(text: str | None, words: int, known: _Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text.

    A-Z are lower-cased, words are runs without ASCII white space; with fewer words than a
    shingle has, the whole sequence is one shingle; without words the set is empty.
    """
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(parts)
    if not n:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(known.__getitem__, parts), np.uint64, n)
    k = min(words, n)
    h = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + ids[j : n - k + 1 + j])
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def signature(shingles: np.ndarray) -> np.ndarray:
    """32 symbols of 16 bits: hashes of the smallest value under 32 permutations."""
    low = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 1024):
        np.minimum(low, (shingles[None, i : i + 1024] * _ODD[:, None] + _ADD[:, None]).min(axis=1), out=low)
    return (_mix(low) >> np.uint64(48)).astype(np.uint16)


def _signer(words: int):
    def make():
        known = _Words()

        def run(cols: dict) -> dict:
            out: dict[str, list] = {k: [] for k in ("doc_id", "n_shingles", "h0", "h1", *_SIG)}
            for doc, text in zip(cols["doc_id"], cols["text"], strict=True):
                u = shingle_set(text, words, known)
                out["doc_id"].append(doc)
                out["n_shingles"].append(len(u))
                out["h0"].append(int(_mix(u).sum(dtype=np.uint64).astype(np.int64)))
                out["h1"].append(int(_mix(u ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)))
                sig = signature(u).view(np.int64)
                for k, s in zip(_SIG, sig.tolist(), strict=True):
                    out[k].append(s)
            return out

        return run

    return make


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, h0, h1, s0..s7) of every row."""
    schema = "doc_id long, n_shingles long, h0 long, h1 long, " + ", ".join(f"{s} long" for s in _SIG)
    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), schema, _signer(words))


def _lit(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >= 1 << 63 else x).cast("long")


def _symbols_apart(a: str, b: str) -> Column:
    """In how many of 32 symbols two signatures differ, with bit operations on longs."""

    def lanes(i: int) -> Column:
        x = F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))
        for shift, mask in ((8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift).bitwiseAND(_lit(mask)))
        return F.bit_count(x.bitwiseAND(_lit(0x0001000100010001)))

    return reduce(lambda p, q: p + q, (lanes(i) for i in range(CHUNKS)))


def _keys(sig: DataFrame) -> DataFrame:
    """(key, doc_id): for each chunk the four keys that leave out one symbol."""
    keys = [F.xxhash64(F.lit(4 * c + w), F.col(f"s{c}").bitwiseAND(_lit(~(0xFFFF << (16 * w)) & (2**64 - 1)))) for c in range(CHUNKS) for w in range(4)]
    return sig.select(F.explode(F.array(*keys)).alias("key"), "doc_id")


def spanning_links(ids: list[int], sets: list[np.ndarray], side: list[bool], percent: int, group: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that join what all links among the sets join; with two sides only links across, unless all are on one.

    Sets of one ``group`` are joined already. Where one side is small, pairs are counted one by
    one; else by products of 0/1 matrices over slices of the shingles that two sets share at least.
    """
    m = len(ids)
    first: dict[int, int] = {}
    top = list(range(m)) if group is None else [first.setdefault(g, i) for i, g in enumerate(group)]

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    out: list[tuple[int, int]] = []

    def linked(i: int, j: int) -> None:
        a, b = root(i), root(j)
        if a != b:
            top[b] = a
            out.append((ids[i], ids[j]))

    size = np.array([len(s) for s in sets], np.int64)
    left, right = [i for i in range(m) if not side[i]], [i for i in range(m) if side[i]]
    square = not (left and right)
    if square:
        left = right = left or right
    if len(left) * len(right) <= 144 or min(len(left), len(right)) <= 4:
        for i in left:
            for j in right:
                if (square and j <= i) or root(i) == root(j):
                    continue
                x, y = (sets[i], sets[j]) if size[i] <= size[j] else (sets[j], sets[i])
                if len(x) and 100 * len(x) >= percent * len(y):
                    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        linked(i, j)
        return out
    flat = np.concatenate(sets)
    rows = np.repeat(np.arange(m), size)
    order = np.argsort(flat)
    flat, rows = flat[order], rows[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1]))
    number = np.cumsum(new) - 1
    shared = np.bincount(number)[number] > 1
    rows, number = rows[shared], number[shared]
    number = np.cumsum(np.concatenate(([0], (number[1:] != number[:-1]).astype(np.int64)))) if len(number) else number
    a, b = np.array(left), np.array(right)
    both = np.zeros((len(a), len(b)), np.float32)
    width = 4096
    for c in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        i, j = np.searchsorted(number, (c, c + width))
        part = np.zeros((m, width), np.float32)
        part[rows[i:j], number[i:j] - c] = 1
        both += part[a] @ part[b].T
    both = both.astype(np.int64)
    hit = (both > 0) & (100 * both >= percent * (size[a][:, None] + size[b][None] - both))
    if square:
        hit = np.triu(hit, 1)
    for i, j in zip(*np.nonzero(hit), strict=True):
        linked(left[i], right[j])
    return out


def near_links(side: np.ndarray, cluster: np.ndarray, n: np.ndarray, sig: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of clusters that join what all near pairs of signatures across sides (or on the only side) join."""
    a, b = np.flatnonzero(~side), np.flatnonzero(side)
    if not len(a) or not len(b):
        a = b = np.arange(len(side))
    symbols = np.ascontiguousarray(sig.T)
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while top.setdefault(x, x) != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    out = []
    for i in range(0, len(a), 512):
        p = a[i : i + 512]
        apart = np.zeros((len(p), len(b)), np.uint8)
        for x in symbols:
            apart += x[p][:, None] != x[b][None]
        hit = (apart <= MAX_DISTANCE) & (cluster[p][:, None] != cluster[b][None])
        hit &= np.minimum(n[p][:, None], n[b][None]) * 100 >= np.maximum(n[p][:, None], n[b][None]) * percent
        x, y = np.nonzero(hit)
        x, y = cluster[p[x]], cluster[b[y]]
        for u, v in np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0).tolist():
            x, y = root(u), root(v)
            if x != y:
                top[y] = x
                out.append((u, v))
    return out


#: Members of a bucket, and shingles of a cluster, in a block, about.
BLOCK_ROWS, BLOCK_SHINGLES = 2_048, 131_072


def _by_task(dealt: DataFrame, fn: Callable[[dict], list[tuple[int, int]]]) -> DataFrame:
    """Rows with a ``task`` -> links (u, v) that ``fn`` gives for the columns of each task."""
    names = dealt.columns

    def run(batches):
        held: list[pa.RecordBatch] = []
        now, out = None, []

        def done() -> None:
            if sum(x.num_rows for x in held) > 1:
                t = pa.Table.from_batches(held)
                out.extend(fn({c: t.column(c) for c in names}))
            held.clear()

        def links() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["u", "v"])
            out.clear()
            return got

        for batch in batches:
            task = batch.column(names.index("task")).to_numpy()
            cuts = [0, *(np.flatnonzero(task[1:] != task[:-1]) + 1).tolist(), len(task)]
            for i, j in pairwise(cuts):
                if i == j:
                    continue
                if task[i] != now:
                    done()
                    now = task[i]
                held.append(batch.slice(i, j - i))
            if len(out) > 10_000:
                yield links()
        done()
        yield links()

    return dealt.repartition("task").sortWithinPartitions("task").mapInArrow(run, "u long, v long")


def _told(table: DataFrame, rows: int) -> DataFrame:
    """A table of at most ``rows`` rows, broadcast if that is within ``BROADCAST_IDS``; else joins with it are shuffled."""
    return F.broadcast(table) if rows <= BROADCAST_IDS else table


def _deal(rows: DataFrame, limit: int, percent: int, scratch: Scratch) -> DataFrame:
    """(g, id, c, n, w, ...) with ``task`` and ``side``: all pairs of one g, but different c, whose sizes n allow a link meet in a task.

    Rows of a g are cut into blocks of weight ``limit``, by size and by a hash; pairs of blocks
    are tasks. A c that fills blocks has its own, and those don't meet each other. What is
    counted is pre-aggregated, so a g with a third of all rows is no hot key.
    """
    # Sizes that allow a link are in one bin or in neighbouring ones; a little wider than exact, for rounding.
    step = max(0.01, math.log(100 / percent) * (1 + 1e-9))
    rows = rows.withColumn("bin", F.floor(F.log(F.col("n").cast("double")) / step).cast("int"))
    sums = scratch.save(rows.groupBy("g", "bin", "c").agg(F.sum("w").alias("w")))
    most = sums.count()
    own = sums.where(F.col("w") >= limit).select("g", "bin", "c", F.ceil(F.col("w") / limit).alias("own"))
    pool = sums.where(F.col("w") < limit).groupBy("g", "bin").agg(F.sum("w").alias("w")).where(F.col("w") > limit)
    rows = rows.join(_told(own, most), ["g", "bin", "c"], "left")
    rows = rows.join(_told(pool.select("g", "bin", F.ceil(F.col("w") / limit).alias("pool")), most), ["g", "bin"], "left")
    part = F.pmod(F.xxhash64("id"), F.coalesce("own", "pool", F.lit(1)))
    of = F.when(F.col("own").isNotNull(), F.col("c"))
    rows = scratch.save(rows.withColumns({"of": of, "block": F.xxhash64("g", "bin", of.isNotNull(), F.coalesce(of, F.lit(0)), part)}).drop("own", "pool"))
    blocks = rows.groupBy("g", "bin", "of", "block").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    x = blocks.select("g", F.col("bin").alias("x_bin"), F.col("of").alias("x_of"), F.col("block").alias("x"), (F.col("lo") < F.col("hi")).alias("mixed"), F.explode(F.array("bin", F.col("bin") + 1)).alias("bin"))
    y = blocks.select("g", "bin", F.col("of").alias("y_of"), F.col("block").alias("y"))
    meet = (F.col("x_bin") < F.col("bin")) | (F.col("x") < F.col("y")) | ((F.col("x") == F.col("y")) & F.col("mixed"))
    tasks = x.join(y, ["g", "bin"]).where(meet & ~F.coalesce(F.col("x_of") == F.col("y_of"), F.lit(False)))
    ends = F.array(F.struct(F.col("x").alias("block"), F.lit(False).alias("side")), F.struct(F.when(F.col("x") != F.col("y"), F.col("y")).alias("block"), F.lit(True).alias("side")))
    sides = tasks.select(F.xxhash64("x", "y").alias("task"), F.inline(ends)).where("block is not null")
    return rows.join(sides, "block")


def _clusters(sig: DataFrame, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Clusters (node, component) of near signatures, and the near pairs (u, v, apart) of a bucket's first member with others."""
    keys = _keys(sig)
    full = scratch.save(keys.groupBy("key").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("tail")).where("head < tail").select("key", "head"))
    hot = scratch.save(keys.join(full, "key"))
    pairs = hot.where("doc_id > head").select(F.col("head").alias("u"), F.col("doc_id").alias("v")).distinct()
    a, b = sig.alias("a"), sig.alias("b")
    near = pairs.join(a, F.col("u") == F.col("a.doc_id")).join(b, F.col("v") == F.col("b.doc_id")).where(_near("a", "b", percent))
    stars = scratch.save(near.select("u", "v", _symbols_apart("a", "b").alias("apart")))
    found = scratch.save(connected_components(stars.select("u", "v"), scratch))

    # What is left: members of one bucket that are in different clusters.
    left = hot.select("key", "doc_id").join(found, F.col("doc_id") == F.col("node"), "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("comp"))
    split = scratch.save(left.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key"))
    if split.isEmpty():
        return found, stars
    members = left.join(split, "key").join(sig, "doc_id").select(F.col("key").alias("g"), F.col("doc_id").alias("id"), F.col("comp").alias("c"), F.col("n_shingles").alias("n"), F.lit(1).alias("w"), *_SIG)
    members = scratch.save(members)

    def met(cols: dict) -> list[tuple[int, int]]:
        s = np.stack([cols[k].to_numpy() for k in _SIG], 1).view(np.uint16)
        return near_links(cols["side"].to_numpy(), cols["c"].to_numpy(), cols["n"].to_numpy(), s, percent)

    more = scratch.save(_by_task(_deal(members, BLOCK_ROWS, percent, scratch).select("task", "side", "c", "n", *_SIG), met))
    scratch.drop(full, hot, split, members)
    if not more.isEmpty():
        star = found.select(F.col("node").alias("u"), F.col("component").alias("v"))
        found = scratch.save(connected_components(star.unionByName(more), scratch))
    return found, stars


def _confirmed(found: DataFrame, stars: DataFrame, docs: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """Groups (node, component) of the links on full sets within clusters. Only their documents are read into sets.

    Each member is held against the nearest first member of its buckets; then only members of a
    cluster that are in different groups meet.
    """
    clusters = found.select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    few = clusters.count() <= BROADCAST_IDS
    wanted = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(clusters) if few else clusters, "id")

    def make():
        known = _Words()

        def run(cols: dict) -> dict:
            sets = [shingle_set(t, words, known) for t in cols["text"]]
            return {"id": cols["id"], "cluster": cols["cluster"], "n": list(map(len, sets)), "set": [s.tobytes() for s in sets]}

        return run

    sets = scratch.save(map_slices(wanted, "id long, cluster long, n long, set binary", make).where("n > 0"))

    def met(cols: dict) -> list[tuple[int, int]]:
        held = [np.frombuffer(s, np.uint64) for s in cols["set"].to_pylist()]
        group = cols["c"].to_pylist() if "c" in cols else None
        return spanning_links(cols["id"].to_pylist(), held, cols["side"].to_pylist(), percent, group)

    nearest = stars.groupBy("v").agg(F.min(F.struct("apart", "u")).alias("x")).select("v", "x.u")
    nearest = scratch.save(nearest.join(sets.select(F.col("id").alias("v"), "n"), "v"))
    parts = nearest.groupBy("u").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("parts")).where("parts > 1")
    nearest = nearest.join(_told(parts, nearest.count()), "u", "left").select("u", "v", F.xxhash64("u", F.pmod(F.xxhash64("v"), F.coalesce("parts", F.lit(1)))).alias("task"))
    sides = nearest.select(F.col("v").alias("id"), "task", F.lit(True).alias("side")).unionByName(nearest.select(F.col("u").alias("id"), "task", F.lit(False).alias("side")).distinct())
    links = scratch.save(_by_task(sides.join(sets.select("id", "set"), "id"), met))
    groups = scratch.save(connected_components(links, scratch))

    placed = sets.select("id", "cluster", "n").distinct().join(groups, F.col("id") == F.col("node"), "left")
    placed = scratch.save(placed.select(F.col("cluster").alias("g"), "id", F.coalesce("component", "id").alias("c"), "n", F.col("n").alias("w")))
    several = scratch.save(placed.groupBy("g").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("g"))
    if several.isEmpty():
        return groups
    dealt = _deal(placed.join(several, "g"), BLOCK_SHINGLES, percent, scratch).select("task", "side", "id", "c")
    more = scratch.save(_by_task(dealt.join(sets.select("id", "set"), "id"), met))
    if not more.isEmpty():
        star = groups.select(F.col("node").alias("u"), F.col("component").alias("v"))
        groups = scratch.save(connected_components(star.unionByName(more), scratch))
    scratch.drop(sets, nearest, placed, several, links, more)
    return groups


def _near(a: str, b: str, percent: int) -> Column:
    """Sizes that allow the similarity, and signatures within the threshold."""
    x, y = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    return (F.least(x, y) * 100 >= F.greatest(x, y) * percent) & (_symbols_apart(a, b) <= MAX_DISTANCE)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents linked by ``100 * intersection >= percent * union`` of shingle sets.

    Returns a row for each row: doc_id, n_shingles, component_id (the smallest doc_id reached),
    kept (doc_id = component_id). Null or wordless texts have an empty set and are linked with
    nothing; other columns are not read. A row without doc_id is linked with nothing, has no
    component_id and is kept. Rows that share a doc_id count as one document: what any of them
    is linked with, all are. Texts are read whole, whatever their length; of groups with equal
    texts the smallest doc_id stays. An empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    rows = scratch.save(signatures(docs, words))
    able = rows.where("doc_id is not null and n_shingles > 0")
    classes = scratch.save(able.groupBy("h0", "h1", "n_shingles").agg(F.min("doc_id").alias("rep"), *[F.first(s).alias(s) for s in _SIG]))
    sig = classes.select(F.col("rep").alias("doc_id"), "n_shingles", *_SIG)

    clusters, stars = _clusters(sig, percent, scratch)
    found = _confirmed(clusters, stars, docs, words, percent, scratch)
    scratch.drop(clusters, stars)

    reps = classes.select("h0", "h1", F.col("n_shingles").alias("n_"), "rep")
    named = reps.join(found, F.col("rep") == F.col("node"), "left").select("h0", "h1", "n_", F.coalesce("component", "rep").alias("component_id"))
    r = rows.select("doc_id", "n_shingles", F.col("h0").alias("r0"), F.col("h1").alias("r1"))
    return (
        r.join(named, (F.col("r0") == F.col("h0")) & (F.col("r1") == F.col("h1")) & (F.col("n_shingles") == F.col("n_")), "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
