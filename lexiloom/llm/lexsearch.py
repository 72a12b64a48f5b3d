"""Ranked lexical search with variable blocks and their maxima.

Three passes. The first counts, in each document, the terms that any query asks for, and all
terms for the lengths. The second sums document frequencies, from which every posting's share of a
score follows as a whole number. Documents are then dealt over shards of a bounded number of
postings. In a shard the postings of a term are cut into blocks by dynamic programming: the cut has the least
sum of bound errors (a block's maximum times its postings, less their sum) and a price for
each block. Where the maxima of the blocks that cover a document can't add up to the k-th best
score found so far, the document is skipped with its blocks, so the result is that of a full
evaluation. The first k of all shards merge.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Documents and postings in a shard, about.
SHARD_ROWS, SHARD_POSTINGS = 16_384, 1 << 20
#: Longest block, and the price of a block in mean shares of its list.
BLOCK, PRICE = 64, 2.0
#: Terms of queries that are sent to the workers at once: a lot of queries.
LOT_TERMS, LOT_QUERIES = 200_000, 20_000
#: Documents of the rarest terms that give a first k-th score, about; pivots of the next step, and how many times more each later one takes.
START, STEP, MORE = 256, 64, 8

#: Stands for a row without doc_id; comes last among ties.
_NONE = np.iinfo(np.int64).max

# A term is a longest run of ASCII letters and digits and of all that is not ASCII: in UTF-8, of bytes. Only A-Z change.
_FOLD = bytes((b if b >= 0x80 or chr(b).isalnum() else 0x20) if not 0x41 <= b <= 0x5A else b + 0x20 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """All terms of a text, in order."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


# --- counting


def _counts(docs: DataFrame, numbers) -> DataFrame:
    """(doc_id, n, terms, tf): a document's number of terms, and number and count of each that ``numbers`` knows, as packed arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = numbers.value
        for batch in batches:
            n, which, often = [], [], []
            for text in batch.column("text"):
                found = terms(text.as_py())
                n.append(len(found))
                got = [(t, k) for w, k in Counter(found).items() if (t := known.get(w)) is not None]
                which.append(np.array([t for t, _ in got], np.int32).tobytes())
                often.append(np.array([k for _, k in got], np.int32).tobytes())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").fill_null(_NONE), "n": pa.array(n, pa.int64()), "terms": pa.array(which, pa.binary()), "tf": pa.array(often, pa.binary())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, terms binary, tf binary")


def _frequencies(counted: DataFrame, most: int) -> DataFrame:
    """(term, df): in how many documents each term is; each task adds up its own documents first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(most, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), np.int32), minlength=most)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_pydict({"term": pa.array(at[i : i + 100_000], pa.int32()), "df": pa.array(total[at[i : i + 100_000]], pa.int64())})

    return counted.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def shares(w: np.ndarray, tf: np.ndarray, n: np.ndarray, documents: int, words: int) -> np.ndarray:
    """What each posting adds to a score: whole numbers, divisions rounded down."""
    if 90 * int(n.max(initial=0)) * documents >= 1 << 63:
        m = np.array([10 + 90 * int(x) * documents // words for x in n.tolist()], np.int64)
    else:
        m = 10 + (90 * n.astype(np.int64) * documents) // max(1, words)
    return w * ((1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 8 * m))


# --- index


def cut_blocks(share: np.ndarray, first: np.ndarray, price: float = PRICE, longest: int = BLOCK) -> np.ndarray:
    """Where blocks begin: for lists that lie one after the other from each ``first``, the cut with the least sum of
    (maximum x length) and price x mean share for each block.

    All lists take their steps together, the longest ones the longest: at each posting the best
    last block of up to ``longest`` postings is chosen, from running maxima.
    """
    size = np.diff(np.append(first, len(share)))
    if not len(size):
        return np.zeros(0, np.int64)
    order = np.argsort(-size, kind="stable")
    cost = (price * np.add.reduceat(share, first) / size)[order]
    first, size = first[order], size[order]
    back = np.zeros(len(share), np.int16)
    width = np.arange(1, longest + 1, dtype=np.float64)
    top = np.zeros((len(size), longest))  # maxima of the last 1, 2, ... postings
    best = np.full((len(size), longest), np.inf)  # least costs up to before the last 1, 2, ... postings
    best[:, 0] = 0
    alive = np.searchsorted(-size, -np.arange(size[0]), "left")  # lists longer than j
    for j in range(size[0]):
        k = alive[j]
        x = share[first[:k] + j].astype(np.float64)
        top[:k, 1:] = top[:k, :-1]
        top[:k, 0] = 0
        np.maximum(top[:k], x[:, None], out=top[:k])
        total = best[:k] + top[:k] * width
        at = total.argmin(axis=1)
        back[first[:k] + j] = at + 1
        least = total[np.arange(k), at] + cost[:k]
        best[:k, 1:] = best[:k, :-1]
        best[:k, 0] = least
    # Back from each list's end, all lists at once.
    starts, here, low = [], first + size, first
    while len(here):
        here = here - back[here - 1]
        starts.append(here)
        on = here > low
        here, low = here[on], low[on]
    return np.sort(np.concatenate(starts))


class Shard:
    """Postings of a shard's documents by term, in blocks; documents are numbered by doc_id."""

    FIELDS = (("ids", np.int64), ("term", np.int32), ("block", np.int64), ("posting", np.int64), ("doc", np.int32), ("share", np.int64), ("top", np.int64))

    def __init__(self, ids, term, block, posting, doc, share, top):
        self.ids = ids  # doc_id by number
        self.term, self.block = term, block  # ascending terms, and where each one's blocks begin (one more at the end)
        self.posting, self.doc, self.share = posting, doc, share  # where each block's postings begin (one more at the end), and they
        self.top = top  # largest share in each block

    @classmethod
    def build(cls, pdf: pd.DataFrame, weights: np.ndarray, documents: int, words: int) -> Shard:
        pdf = pdf.sort_values("doc_id", kind="stable")
        sizes = pdf["terms"].str.len().to_numpy() // 4
        doc = np.repeat(np.arange(len(pdf), dtype=np.int32), sizes)
        term = np.frombuffer(b"".join(pdf["terms"]), np.int32)
        tf = np.frombuffer(b"".join(pdf["tf"]), np.int32)
        share = shares(weights[term], tf, np.repeat(pdf["n"].to_numpy(), sizes), documents, words)
        order = np.argsort(term, kind="stable")
        term, doc, share = term[order], doc[order], share[order]
        names, first = np.unique(term, return_index=True)
        posting = cut_blocks(share, first)
        top = np.maximum.reduceat(share, posting) if len(posting) else share
        return cls(pdf["doc_id"].to_numpy(np.int64), names, np.append(np.searchsorted(posting, first), len(posting)), np.append(posting, len(share)), doc, share, top)

    def search(self, asked: np.ndarray, k: int, floor: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
        """(doc numbers, scores) of the first ``k`` with a score of ``floor`` or more, and how many documents were scored in full.

        Terms whose maxima together stay below the k-th score can't carry a document alone:
        only the documents of the other terms are pivots. A pivot whose own shares of those and
        block maxima of the rest stay below it is skipped with its blocks.
        """
        at = np.searchsorted(self.term, asked)
        at = at[self.term[np.minimum(at, len(self.term) - 1)] == asked] if len(self.term) else at[:0]
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        lists = [(self.doc[a:b], self.share[a:b]) for a, b in zip(self.posting[self.block[at]], self.posting[self.block[at + 1]])]
        most = np.array([self.top[a:b].max() for a, b in zip(self.block[at], self.block[at + 1])])
        order = np.argsort(most, kind="stable")
        # Documents that rare terms favour give a first k-th score.
        first: list[np.ndarray] = []
        for i in order[::-1]:
            doc, share = lists[i]
            first.append(doc if len(doc) <= START else doc[np.argpartition(-share, START)[:START]])
            if sum(map(len, first)) >= START:
                break
        some = np.unique(np.concatenate(first))
        best_doc, best_score, low = self._first(some, self._exact(lists, some), k, floor)
        light = most[order].cumsum() < low  # below it, not equal: a document that ties can come first
        rest = [lists[i] for i in order[light]]
        pivots = np.unique(np.concatenate([lists[i][0] for i in order[~light]])) if not light.all() else some[:0]
        score = self._exact([lists[i] for i in order[~light]], pivots)
        bound = score + sum((self._shallow(t, pivots) for t in at[order[light]]), np.zeros(len(pivots), np.int64))
        bound[np.isin(pivots, some, assume_unique=True)] = -1  # scored before
        turn = np.argsort(-bound, kind="stable")
        scored, i, ahead = len(some), 0, STEP
        while i < len(turn) and bound[turn[i]] >= low:
            now = turn[i : i + ahead]
            now = np.sort(now[bound[now] >= low])
            points = score[now] + self._exact(rest, pivots[now])
            best_doc, best_score, low = self._first(np.append(best_doc, pivots[now]), np.append(best_score, points), k, floor)
            scored, i, ahead = scored + len(now), i + ahead, ahead * MORE
        return best_doc, best_score, scored

    def _first(self, doc: np.ndarray, score: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The first k, and the score that others need."""
        keep = np.lexsort((doc, -score))[:k]
        keep = keep[score[keep] >= floor]
        return doc[keep], score[keep], int(score[keep[-1]]) if len(keep) == k else floor

    def _exact(self, lists: list[tuple[np.ndarray, np.ndarray]], docs: np.ndarray) -> np.ndarray:
        """Sums of the lists' shares of some documents, in ascending order."""
        out = np.zeros(len(docs), np.int64)
        if len(docs):
            for doc, share in lists:
                if len(doc) < len(docs):  # the shorter one is looked up in the other
                    where = np.minimum(np.searchsorted(docs, doc), len(docs) - 1)
                    hit = docs[where] == doc
                    out[where[hit]] += share[hit]
                else:
                    where = np.minimum(np.searchsorted(doc, docs), len(doc) - 1)
                    out += np.where(doc[where] == docs, share[where], 0)
        return out

    def _shallow(self, term: int, docs: np.ndarray) -> np.ndarray:
        """The maxima of the blocks of a term that cover some documents; no posting is read but the blocks' ends."""
        a, b = self.block[term], self.block[term + 1]
        at = np.searchsorted(self.doc[self.posting[a + 1 : b + 1] - 1], docs)
        inside = at < b - a
        at = a + np.minimum(at, b - a - 1)
        return np.where(inside & (self.doc[self.posting[at]] <= docs), self.top[at], 0)


_INDEX = "shard int, " + ", ".join(f"{name} binary" for name, _ in Shard.FIELDS)


def build_index(counted: DataFrame, shards: int, weights, documents: int, words: int) -> DataFrame:
    """A row for each shard, from rows of counted documents."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        s = Shard.build(pdf, weights.value, documents, words)
        return pd.DataFrame([{"shard": int(pdf["shard"].iloc[0])} | {name: np.ascontiguousarray(getattr(s, name), kind).tobytes() for name, kind in Shard.FIELDS}])

    key: Column = F.pmod(F.xxhash64("doc_id", "n", "terms", "tf"), F.lit(shards))
    # Rows that agree in all of this can be many (copies without an id), so they are dealt by place as well.
    key = F.pmod(key + F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20)), F.lit(shards)).cast("int")
    return counted.withColumn("shard", key).groupBy("shard").applyInPandas(build, _INDEX)


def _answers(index: DataFrame, queries, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                s = Shard(*(np.frombuffer(batch.column(name)[i].as_buffer(), kind) for name, kind in Shard.FIELDS))
                out: dict[str, list] = {"q": [], "doc_id": [], "score": []}
                for q, asked in queries.value:
                    docs, scores, _ = s.search(asked, k)
                    out["q"] += [q] * len(docs)
                    out["doc_id"] += [None if x == _NONE else x for x in s.ids[docs].tolist()]
                    out["score"] += scores.tolist()
                if out["q"]:
                    yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return index.mapInArrow(run, "q long, doc_id long, score long")


# --- search


def search(docs: DataFrame, items: DataFrame, k: int = 10, shard_rows: int = SHARD_ROWS, shard_postings: int = SHARD_POSTINGS, lot_queries: int = LOT_QUERIES) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of ``items`` the ``k`` documents with the highest scores above 0.

    Equal scores go by ascending doc_id, rows without doc_id last. Null and empty texts have no
    terms: such a document is in no result, such an item has none. Repeated rows are rows of their
    own, of items (each has its own ranks) as of documents. An empty table gives an empty result. Only doc_id and text,
    and item_id and text, are read; whole texts of any length are counted.

    Items are the stated queries: they are taken in lots of a bounded number of terms, which
    are sent to the workers. The index holds the postings of a lot's terms of every document.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lexsearch")
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("q"))
    asked = scratch.save(asked.mapInArrow(_asked, "q long, item_id long, term binary"))
    size = asked.agg(F.count_distinct("q").alias("queries"), F.count("*").alias("terms")).first()
    lots = max(1, -(-size.queries // lot_queries), -(-size.terms // LOT_TERMS))
    out: list[DataFrame] = []
    for i in range(lots if size.terms else 0):
        of = asked.where(F.pmod(F.xxhash64("q"), F.lit(lots)) == i)
        if (held := of.toArrow()).num_rows:
            ranked = _of_lot(spark, scratch, docs, held, k, shard_rows, shard_postings)
            out.append(ranked.join(of.select("q", "item_id").distinct(), "q").select("item_id", "rank", "doc_id", "score"))
    if not out:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = out[0]
    for df in out[1:]:
        found = found.unionByName(df)
    return found


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct term of an item."""
    for batch in batches:
        rows = [(q, i, t) for q, i, text in zip(*(batch.column(c).to_pylist() for c in ("q", "item_id", "text"))) for t in dict.fromkeys(terms(text))]
        if rows:
            q, i, t = zip(*rows)
            yield pa.RecordBatch.from_pydict({"q": pa.array(q, pa.int64()), "item_id": pa.array(i, pa.int64()), "term": pa.array(t, pa.binary())})


def _of_lot(spark: SparkSession, scratch: Scratch, docs: DataFrame, held: pa.Table, k: int, shard_rows: int, shard_postings: int) -> DataFrame:
    """Counts, index and search for one lot of queries: (q, rank, doc_id, score), written."""
    sc = spark.sparkContext
    known = {t: i for i, t in enumerate(sorted(set(held["term"].to_pylist())))}
    by: dict[int, list[int]] = {}
    for q, t in zip(held["q"].to_pylist(), held["term"].to_pylist()):
        by.setdefault(q, []).append(known[t])
    counted = scratch.save(_counts(docs, sc.broadcast(known)))
    all_ = counted.agg(
        F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("words"), F.count_if(F.octet_length("terms") > 0).alias("rows"), F.coalesce(F.sum(F.octet_length("terms").cast("long")), F.lit(0)).alias("bytes")
    ).first()
    df = np.zeros(len(known), np.int64)
    got = _frequencies(counted, len(known)).toArrow()  # a row for each term of the lot at most
    df[got["term"].to_numpy()] = got["df"].to_numpy()
    weights = sc.broadcast(np.array([weight(all_.documents, int(x)) for x in df], np.int64))
    shards = max(1, -(-all_.rows // shard_rows), -(-all_.bytes // (4 * shard_postings)))
    index = scratch.save(build_index(counted.where(F.octet_length("terms") > 0), shards, weights, all_.documents, all_.words))
    scratch.drop(counted)
    found = _answers(index, sc.broadcast([(q, np.array(sorted(ts), np.int32)) for q, ts in sorted(by.items())]), k)
    w = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = scratch.save(found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))
    scratch.drop(index)
    return ranked


#: The same rows, by scoring every pair that shares a term.
ORACLE = r"""
with d as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts
  from documents where text is not null
), b as (
  select row_number() over () as q, item_id,
         list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as ts
  from benchmark where text is not null
), s as (select count(*)::bigint as n, sum(len(ts))::bigint as l from d where len(ts) > 0),
words as (select r, unnest(ts) as t from d),
tf as (select r, t, count(*)::bigint as tf from words group by r, t),
df as (select t, count(*)::bigint as df from tf group by t),
w as (select t, floor(1000 * ln((2 * n + 2)::double / (2 * df + 1)::double))::bigint as w from df, s),
posts as (
  select tf.t, tf.r, w.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(d.ts)::bigint * s.n) // s.l))) as share
  from tf join w on w.t = tf.t join d on d.r = tf.r, s
), asked as (select q, unnest(ts) as t from b),
score as (select q, r, sum(share)::bigint as score from asked join posts on posts.t = asked.t group by q, r having sum(share) > 0),
ranked as (
  select q, d.doc_id, score, row_number() over (partition by q order by score desc, d.doc_id nulls last) as rank
  from score join d on d.r = score.r
)
select b.item_id, rank::int as rank, doc_id, score from ranked join b on b.q = ranked.q where rank <= 10
"""
