"""Nearest neighbours with one navigable small-world graph a shard.

Distinct vectors are dealt over shards of a bounded size in bytes by a hash. Each shard is
indexed by a hierarchical navigable small-world graph, kept as flat arrays of neighbours in a row
of a table. An index is sent once to a task that holds many blocks of queries against it; what
the shards find is merged. Equal vectors are indexed once, and stand for their rows when results
are counted out.
"""

from __future__ import annotations

from heapq import heappop, heappush, heapreplace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import map_slices
from .scratch import Scratch

#: Vectors and bytes of vectors in a shard, about; links of a vector above and on the ground level; beams of building and searching.
SHARD_ROWS, SHARD_BYTES, LINKS, BEAM, SEARCH_BEAM = 8_192, 16 << 20, 14, 64, 128
#: Queries in a block, and blocks that one load of an index serves.
QUERY_BLOCK, BLOCKS = 256, 64
#: Vector lengths that are broadcast; beyond it the join is shuffled.
BROADCAST_DIMS = 10_000


class Graph:
    """A navigable small-world graph over ``x``; links[level] is (n, width) of neighbour numbers, -1 where free."""

    def __init__(self, x: np.ndarray, seed: int = 3):
        self.x = np.ascontiguousarray(x, np.float64)
        n = len(x)
        rng = np.random.default_rng(seed)
        self.level = np.minimum((-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(np.int64), 6)
        self.links = [np.full((n if k == 0 else int((self.level >= k).sum()), LINKS * (2 if k == 0 else 1)), -1, np.int32) for k in range(int(self.level.max(initial=0)) + 1)]
        self.slot = [np.arange(n)] + [np.cumsum(self.level >= k) - 1 for k in range(1, len(self.links))]
        self.size = [np.zeros(len(a), np.int32) for a in self.links]
        self.entry, self.top = -1, -1

    def _far(self, q: np.ndarray, ids) -> np.ndarray:
        d = self.x[ids] - q
        return np.einsum("ij,ij->i", d, d)

    def beam(self, q: np.ndarray, start: list[tuple[float, int]], k: int, width: int) -> list[tuple[float, int]]:
        """The nearest ``width`` that a best-first walk on a level meets, nearest first."""
        links, slot, size = self.links[k], self.slot[k], self.size[k]
        seen = np.zeros(len(self.x), bool)
        seen[[i for _, i in start]] = True
        todo = sorted(start)
        best = [(-d, i) for d, i in start]
        best.sort()
        while len(best) > width:
            heappop(best)
        while todo:
            d, i = heappop(todo)
            if d > -best[0][0] and len(best) >= width:
                break
            s = slot[i]
            near = links[s, : size[s]]
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            far = self._far(q, near)
            if len(best) >= width:
                ok = far < -best[0][0]
                far, near = far[ok], near[ok]
            for d, i in zip(far.tolist(), near.tolist()):
                if len(best) < width:
                    heappush(best, (-d, i))
                    heappush(todo, (d, i))
                elif d < -best[0][0]:
                    heapreplace(best, (-d, i))
                    heappush(todo, (d, i))
        return sorted((-d, i) for d, i in best)

    def _pick(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours in different directions: nearer to the vector than to those picked before; then the nearest of the rest."""
        ids = np.array([i for _, i in found])
        d = np.array([d for d, _ in found])
        v = self.x[ids]
        sq = np.einsum("ij,ij->i", v, v)
        apart = sq[:, None] + sq[None] - 2 * (v @ v.T)
        nearest = np.full(len(ids), np.inf)
        got: list[int] = []
        for j in range(len(ids)):
            if d[j] < nearest[j]:
                got.append(j)
                if len(got) == most:
                    break
                np.minimum(nearest, apart[j], out=nearest)
        if len(got) < most:
            held = set(got)
            got += [j for j in range(len(ids)) if j not in held][: most - len(got)]
        return ids[got].tolist()

    def _link(self, k: int, i: int, j: int) -> None:
        """A link from i to j; a full list is picked anew."""
        s, links, size = self.slot[k][i], self.links[k], self.size[k]
        if size[s] < links.shape[1]:
            links[s, size[s]] = j
            size[s] += 1
            return
        near = np.append(links[s], j)
        far = self._far(self.x[i], near)
        order = np.argsort(far, kind="stable")
        kept = self._pick(list(zip(far[order].tolist(), near[order].tolist())), links.shape[1] * 3 // 4)
        links[s] = -1
        links[s, : len(kept)] = kept
        size[s] = len(kept)

    def build(self) -> Graph:
        for i in range(len(self.x)):
            q, own = self.x[i], int(self.level[i])
            if self.entry < 0:
                self.entry, self.top = i, own
                continue
            start = [(float(self._far(q, [self.entry])[0]), self.entry)]
            for k in range(self.top, own, -1):
                start = self.beam(q, start, k, 1)
            for k in range(min(own, self.top), -1, -1):
                start = self.beam(q, start, k, BEAM)
                for j in self._pick(start, LINKS):
                    self._link(k, i, j)
                    self._link(k, j, i)
            if own > self.top:
                self.entry, self.top = i, own
        return self

    def search(self, q: np.ndarray, most: int, width: int) -> list[tuple[float, int]]:
        start = [(float(self._far(q, [self.entry])[0]), self.entry)]
        for k in range(self.top, 0, -1):
            start = self.beam(q, start, k, 1)
        return self.beam(q, start, 0, max(width, most))[:most]


def _store(shard: str, reps: np.ndarray, g: Graph) -> dict:
    return {
        "shard": shard,
        "dim": g.x.shape[1],
        "reps": reps.astype(np.int64).tobytes(),
        "vectors": g.x.tobytes(),
        "level": g.level.astype(np.int64).tobytes(),
        "links": [a.tobytes() for a in g.links],
        "entry": g.entry,
        "top": g.top,
    }


def _load(row: dict) -> tuple[np.ndarray, Graph]:
    g = Graph.__new__(Graph)
    reps = np.frombuffer(row["reps"], np.int64).reshape(-1, 2)
    n = len(reps)
    g.x = np.frombuffer(row["vectors"], np.float64).reshape(n, row["dim"])
    g.level = np.frombuffer(row["level"], np.int64)
    g.links = [np.frombuffer(a, np.int32).reshape(-1, LINKS * (2 if k == 0 else 1)) for k, a in enumerate(row["links"])]
    g.slot = [np.arange(n)] + [np.cumsum(g.level >= k) - 1 for k in range(1, len(g.links))]
    g.size = [(a >= 0).sum(axis=1) for a in g.links]
    g.entry, g.top = row["entry"], row["top"]
    return reps, g


_INDEX = "shard string, dim int, reps binary, vectors binary, level binary, links array<binary>, entry int, top int"


def _valid(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, e) of the rows that take part: e has no null and no non-finite component and is not zero; ``row`` numbers rows."""
    e = F.col("embedding").cast("array<double>")
    ok = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e")).where("vec_id is not null and e is not null").where(ok)
    return rows.withColumn("row", F.monotonically_increasing_id())


def shard_counts(distinct: DataFrame, rows: int = SHARD_ROWS) -> DataFrame:
    """(dim, shards): how many shards the vectors of each length have."""
    per = F.least(F.lit(rows), F.greatest(F.lit(64), F.floor(F.lit(SHARD_BYTES) / (8 * F.col("dim")))))
    return distinct.groupBy(F.size("e").alias("dim")).agg(F.count("*").alias("n")).select("dim", F.ceil(F.col("n") / per).cast("int").alias("shards"))


def build_index(distinct: DataFrame, shards: DataFrame) -> DataFrame:
    """(rep, h, e) of distinct vectors, h a hash of e, -> a row with the graph of each shard."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rep", "h"])
        g = Graph(np.stack([np.asarray(v, np.float64) for v in pdf["e"]])).build()
        return pd.DataFrame([_store(pdf["shard"].iloc[0], pdf[["rep", "h"]].to_numpy(), g)])

    dealt = distinct.withColumn("dim", F.size("e")).join(F.broadcast(shards) if shards.count() <= BROADCAST_DIMS else shards, "dim")
    shard = F.concat_ws(":", "dim", F.pmod(F.xxhash64("rep", "h"), "shards"))
    return dealt.select("rep", "h", "e", shard.alias("shard")).groupBy("shard").applyInPandas(build, _INDEX)


def _answers(index: DataFrame, asked: DataFrame, k: int, beam: int) -> DataFrame:
    """Index rows and blocks of queries (shard, lot, asked) -> (q, rep, h, score).

    An index goes to each lot of its shard, and comes before the queries there.
    """
    names = [f.name for f in index.schema if f.name != "shard"]
    none = [F.lit(None).cast(index.schema[c].dataType).alias(c) for c in names]
    lots = asked.select("shard", "lot").distinct()
    first = index.join(lots, "shard").select("shard", "lot", *names, F.lit(None).cast(asked.schema["asked"].dataType).alias("asked"))
    rows = first.unionByName(asked.select("shard", "lot", *none, "asked"))
    rows = rows.repartition("shard", "lot").sortWithinPartitions("shard", "lot", F.col("entry").asc_nulls_last())

    def make():
        loaded: list = [None, None, None]

        def run(cols: dict) -> dict:
            out: dict[str, list] = {"q": [], "rep": [], "h": [], "score": []}
            for i, shard in enumerate(cols["shard"]):
                if cols["entry"][i] is not None:
                    loaded[:] = [shard, *_load({c: v[i] for c, v in cols.items()})]
                    continue
                if loaded[0] != shard:
                    raise RuntimeError("queries came before their index")
                _, reps, g = loaded
                for a in cols["asked"][i]:
                    for d, j in g.search(np.array(a["e"]), k + 1, beam):
                        out["q"].append(a["q"])
                        out["rep"].append(int(reps[j, 0]))
                        out["h"].append(int(reps[j, 1]))
                        out["score"].append(float(np.sqrt(d)))
            return out

        return run

    return map_slices(rows, "q long, rep long, h long, score double", make, text="vectors", chars=8_000_000)


def search(vectors: DataFrame, every: int = 100, k: int = 10, shard_rows: int = SHARD_ROWS, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row whose vec_id is divisible by ``every`` the ``k`` nearest other rows.

    Euclidean distance in double precision; nearest first, ties to the smaller vec_id. Rows
    whose vector is null, empty, zero or has a null or non-finite component take no part; nor
    do rows without vec_id. A row is a row: those that share a vec_id are queries and candidates
    each for itself, so that an id may come twice in a result. Vectors of different lengths are not
    compared; long ones make smaller shards. An empty table gives an empty one; other columns
    are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    # Equal vectors are known by two hashes of theirs: one is indexed, and of their rows the first k + 1 are enough, as one of
    # them at most is the query itself. Spark drops the others of a task before it shuffles.
    keys = {"h": F.xxhash64("e"), "h2": F.xxhash64(F.lit(7), "e")}
    rows = scratch.save(_valid(vectors).withColumns(keys))
    w = Window.partitionBy("h", "h2").orderBy("vec_id", "row")
    firsts = scratch.save(rows.select("row", "vec_id", "h", "h2").withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1))
    reps = firsts.where("n = 1").select("row", F.col("row").alias("rep"), "h")
    members = firsts.select("h", "h2", "vec_id", "row").join(firsts.where("n = 1").select("h", "h2", F.col("row").alias("rep")), ["h", "h2"]).select("rep", "h", "vec_id", "row")
    members = scratch.save(members)
    distinct = scratch.save(rows.select("row", "e").join(reps, "row").select("rep", "h", "e"))
    shards = scratch.save(shard_counts(distinct, shard_rows))
    index = scratch.save(build_index(distinct, shards))
    scratch.drop(distinct, firsts)

    queries = scratch.save(rows.where(F.col("vec_id") % every == 0).select(F.col("row").alias("q"), F.col("vec_id").alias("query_id"), "e", F.size("e").alias("dim")))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    asked = queries.groupBy("dim", F.pmod(F.xxhash64("q"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("q", "e")).alias("asked")).join(shards, "dim")
    asked = asked.select(
        F.floor(F.col("block") / BLOCKS).alias("lot"), "asked", F.explode(F.transform(F.sequence(F.lit(0), F.col("shards") - 1), lambda s: F.concat_ws(":", "dim", s))).alias("shard")
    )
    found = _answers(index, asked, k, beam)
    near = found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("score", "rep", "h"))).where(F.col("n") <= k + 1).drop("n")
    hits = near.join(members, ["rep", "h"]).where("row <> q")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id", "row"))
    best = hits.withColumn("rank", rank).where(F.col("rank") <= k)
    out = best.join(queries.select("q", "query_id"), "q").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    out = scratch.save(out)
    scratch.drop(rows, members, shards, index, queries)
    return out
