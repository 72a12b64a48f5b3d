"""SentencePiece encoding and decoding by suffix-array matching.

The distinct new words of a batch are concatenated and indexed by a suffix array, every piece
of the vocabulary is binary-searched in it for the range of its occurrences, and the ranges
become edges (start, length, piece), sorted by position. The edges of a word are then relaxed: a
unigram model takes the best-scoring path, a BPE model contracts the best-scoring edge
between neighbours until none is left. Words are looked up again for their repeats, which is
exact because no piece of the model goes on past a word's start (checked when it is read).
"""

from __future__ import annotations

import copy
import heapq
import re
import struct
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_slices

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2
#: Words whose ids a task remembers, at most, and characters of words that are learned at once.
MEMORY, LEARN_CHARS = 250_000, 250_000
#: Words of at most so many characters are contracted together.
SHORT = 64


def _fields(buf: bytes):
    """(number, value) of a protocol buffer message's fields."""
    i, n = 0, len(buf)

    def varint() -> int:
        nonlocal i
        x = s = 0
        while True:
            b = buf[i]
            i += 1
            x |= (b & 127) << s
            s += 7
            if b < 128:
                return x

    while i < n:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            size = varint()
            yield key >> 3, buf[i : i + size]
            i += size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            yield key >> 3, buf[i : i + size]
            i += size
        else:
            raise ValueError("not a SentencePiece model")


@dataclass
class Model:
    """What a model file holds; ``index`` has the pieces that texts can match."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    kind: int = UNIGRAM
    prefix: bool = True
    squeeze: bool = True
    index: dict[str, int] = field(default_factory=dict)
    byte_ids: list[int] = field(default_factory=list)
    unknown: int = 0
    splits: bool = True
    breaks: bool = True

    def __post_init__(self):
        self.index = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k in (NORMAL, USER)}
        found = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.byte_ids = [found[f"<0x{b:02X}>"] for b in range(256)] if found else []
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in self.index)
        self.breaks = not any("\n" in p and len(p) > 1 for p in self.index)


def read_model(path: str = MODEL_PATH) -> Model:
    pieces, scores, kinds, kind, prefix, squeeze = [], [], [], UNIGRAM, True, True
    with open(path, "rb") as f:
        data = f.read()
    for number, value in _fields(data):
        if number == 1:
            got = dict(_fields(value))
            pieces.append(got.get(1, b"").decode())
            scores.append(struct.unpack("<f", got[2])[0] if 2 in got else 0.0)
            kinds.append(got.get(3, NORMAL))
        elif number == 2:
            kind = dict(_fields(value)).get(3, UNIGRAM)
        elif number == 3:
            got = dict(_fields(value))
            if got.get(2):
                raise ValueError("models with a normalisation table are not supported")
            prefix, squeeze = bool(got.get(3, 1)), bool(got.get(4, 1))
    if kind not in (UNIGRAM, BPE) or UNUSED in kinds:
        raise ValueError("only unigram and BPE models without unused pieces are supported")
    return Model(pieces, scores, kinds, kind, prefix, squeeze)


class Matcher:
    """Finds all pieces of two characters or more in a concatenation of words."""

    def __init__(self, model: Model):
        longer = sorted((p, i) for p, i in model.index.items() if len(p) > 1)
        self.ids = np.array([i for _, i in longer], np.int32)
        self.sizes = np.array([len(p) for p, _ in longer], np.int64)
        self.width = int(self.sizes.max()) if longer else 1
        codes = np.zeros((len(longer), self.width), np.uint32)
        for k, (p, _) in enumerate(longer):
            codes[k, : len(p)] = np.frombuffer(p.encode("utf-32-le", "surrogatepass"), np.uint32) + 1
        self.letters, at = np.unique(codes, return_inverse=True)
        self.spelled = at.reshape(codes.shape)

    def occurrences(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The suffix array by the first ``width`` characters, and of each piece the first and the past-last suffix that begins with it.

        ``text``: code points + 1, 0 between words. As many characters as fit are packed in a
        key; ranks of keys are doubled until they cover ``width`` characters. A piece is cut in
        the same parts, each is binary-searched among the keys, and the ranges are doubled alike.
        """
        used = np.unique(text)
        used = used[used > 0]
        bits = max(1, int(len(used)).bit_length())
        per = min(self.width, 62 // bits)
        parts = 1
        while parts * per < self.width:
            parts *= 2
        rank = np.zeros(len(text) + parts * per, np.int64)
        rank[: len(text)] = np.searchsorted(used, text, side="right")  # 0 stays 0
        n = len(rank) - per + 1
        key = np.zeros(n, np.int64)
        for j in range(per):
            key = (key << bits) | rank[j : j + n]
        number = np.searchsorted(used, self.letters)
        known = (number < len(used)) & (used[np.minimum(number, len(used) - 1)] == self.letters)
        spelled = np.where(known, number + 1, 0)[self.spelled]
        bad = ((spelled == 0) & (self.spelled > 0)).any(axis=1)
        low = np.zeros((len(self.ids), parts), np.int64)
        high = np.zeros_like(low)
        for p in range(parts):
            x = np.zeros(len(self.ids), np.int64)
            for j in range(p * per, (p + 1) * per):
                x = (x << bits) | (spelled[:, j] if j < self.width else 0)
            rest = np.clip((p + 1) * per - self.sizes, 0, per)  # characters of the part that are behind the piece's end
            low[:, p], high[:, p] = x, x + (np.int64(1) << (rest * bits))
        span = per
        while True:
            order = np.argsort(key)
            keys = key[order]
            if low.shape[1] == 1:
                first, last = np.searchsorted(keys, low[:, 0]), np.searchsorted(keys, high[:, 0])
                last[bad] = first[bad]
                return order, first, np.maximum(first, last)
            fresh = np.concatenate(([True], keys[1:] != keys[:-1]))
            own = keys[fresh]
            rank = np.empty(len(key), np.int64)
            rank[order] = np.cumsum(fresh) - 1
            low, high = np.searchsorted(own, low), np.searchsorted(own, high)
            # A part behind the end spans all ranks; one before the last is whole and has one rank or none.
            absent = high <= low
            first, second = slice(0, None, 2), slice(1, None, 2)
            none = absent[:, first] | absent[:, second]
            low, high = np.where(none, 0, low[:, first] * len(own) + low[:, second]), np.where(none, 0, (high[:, first] - 1) * len(own) + high[:, second])
            key = rank[: len(rank) - span] * len(own) + rank[span:]
            span *= 2

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, lengths and piece ids of all occurrences, in the order of pieces, and where each word begins; text is what they lie in."""
        text = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint32(1)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        begin = np.cumsum(size) - size
        text[begin + size - 1] = 0  # between words; no piece has it
        self.text = text
        order, first, last = self.occurrences(text)
        count = last - first
        starts = order[np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())]
        return starts, np.repeat(self.sizes, count), np.repeat(self.ids, count), begin


class _Words(dict):
    """Numbers of words; new words wait to be learned."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, w: str) -> int:
        i = self[w] = len(self)
        self.new.append(w)
        return i


class Encoder:
    """Texts to ids and back; remembers words within ``MEMORY``, their ids in flat arrays."""

    def __init__(self, model: Model):
        self.model, self.matcher = model, Matcher(model)
        cut = rf"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if not model.breaks else rf"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n"
        self.cut = re.compile(cut if model.splits else r"(?s).+")
        self.texts = [bytes([model.byte_ids.index(i)]) if k == BYTE else p.encode() if k != CONTROL else b"" for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True))]
        self.scores = np.array(model.scores, np.float64)
        self.forget()

    def forget(self) -> None:
        self.known = _Words()
        self.flat, self.size, self.true = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, bool)

    def normalise(self, text: str) -> str:
        if self.model.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return (SPACE if self.model.prefix else "") + text.replace(" ", SPACE)

    def _single(self, c: str) -> tuple[int, ...]:
        i = self.model.index.get(c)
        if i is not None:
            return (i,)
        if self.model.byte_ids:
            return tuple(self.model.byte_ids[b] for b in c.encode("utf-8", "replace"))
        return (self.model.unknown,)

    def _contract(self, word: str, edges: dict[tuple[int, int], int]) -> list[int]:
        """BPE: the best edge over two neighbours first, the leftmost of equals."""
        n, scores = len(word), self.model.scores
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) < n and (e := edges.get((i, after[j]))) is not None:
                heapq.heappush(heap, (-scores[e], i, after[j], j))

        for i in range(n - 1):
            offer(i)
        gone = [False] * n
        while heap:
            _, i, end, j = heapq.heappop(heap)
            if gone[i] or gone[j] or after[i] != j or after[j] != end:
                continue
            gone[j] = True
            after[i] = end
            if end < n:
                before[end] = i
            offer(before[i])
            offer(i)
        out: list[int] = []
        i = 0
        while i < n:
            j = after[i]
            out.extend((edges[i, j],) if j > i + 1 else self._single(word[i]))
            i = j
        return out

    def _path(self, word: str, edges: dict[tuple[int, int], int]) -> list[int]:
        """Unigram: the path of the highest score; single characters without a piece score below all."""
        n, scores = len(word), self.model.scores
        low = min(scores) - 10.0
        best, back = [-1e30] * (n + 1), [(0, 0)] * (n + 1)
        best[0] = 0.0
        out_of: dict[int, list[tuple[int, int]]] = {}
        for (i, j), e in edges.items():
            out_of.setdefault(i, []).append((j, e))
        for i in range(n):
            e = self.model.index.get(word[i])
            for j, e_ in [*out_of.get(i, []), (i + 1, -1 if e is None else e)]:
                s = best[i] + (low if e_ < 0 else scores[e_])
                if s > best[j]:
                    best[j], back[j] = s, (i, e_)
        out: list[tuple[int, ...]] = []
        j = n
        while j:
            i, e = back[j]
            out.append(self._single(word[i]) if e < 0 else (e,))
            j = i
        return [x for t in reversed(out) for x in t]

    def _singles(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of some characters has by itself, and the ids one after the other."""
        own, at = np.unique(codes, return_inverse=True)
        ids = [self._single(chr(c - 1)) for c in own.tolist()]
        size = np.array([len(x) for x in ids], np.int64)
        flat = np.array([i for x in ids for i in x], np.int32)
        n = size[at]
        first = (np.cumsum(size) - size)[at]
        return n, flat[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]

    def _contract_all(self, words: list[str], begin: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """BPE for many short words at once: each round contracts the best edge of every word that has one.

        Edges are sorted by position and length into a table. Words of similar length are rows
        of one matrix of gains. Returns the number of ids of each word, and all ids.
        """
        wide = self.matcher.width + 1
        text = self.matcher.text
        n = len(text)
        table = np.full((n + 2) * wide, -1, np.int32)
        table[starts * wide + sizes] = ids
        after, before = np.arange(1, n + 4), np.arange(-1, n + 2)
        dead = text == 0

        def gain(i: np.ndarray) -> np.ndarray:
            k = after[after[i]] - i
            e = table[np.where(k < wide, i * wide + k, i * wide)]
            return np.where(e >= 0, self.scores[e], -np.inf)

        long = np.diff(np.append(begin, n)) - 1
        edge = 0
        for most in (6, 8, 10, 12, 16, 24, 32, SHORT):
            rows = np.flatnonzero((long > edge) & (long <= most))
            edge = most
            if not len(rows):
                continue
            base = begin[rows]
            at = base[:, None] + np.arange(most)
            best = gain(np.minimum(at, n - 1).ravel()).reshape(at.shape)
            best[np.arange(most) >= long[rows][:, None] - 1] = -np.inf
            while True:
                top = best.argmax(axis=1)  # the leftmost of equals
                live = np.flatnonzero(best[np.arange(len(base)), top] > -np.inf)
                if not len(live):
                    break
                if len(live) < 0.8 * len(base):
                    best, base, top = best[live], base[live], top[live]
                    live = np.arange(len(base))
                i = base[live] + top[live]
                j = after[i]
                k = after[j]
                after[i], before[k], dead[j] = k, i, True
                best[live, j - base[live]] = -np.inf
                best[live, top[live]] = gain(i)
                p = before[i]
                q = p >= base[live]
                best[live[q], (p - base[live])[q]] = gain(p[q])
        alive = np.flatnonzero(~dead)
        span = after[alive] - alive
        found = table[alive * wide + np.minimum(span, wide - 1)]
        one = span == 1
        count = np.ones(len(alive), np.int64)
        count[one], singles = self._singles(text[alive[one]])
        out = np.empty(int(count.sum()), np.int32)
        single = np.repeat(one, count)
        out[single], out[~single] = singles, found[~one]
        ends = np.concatenate(([0], np.cumsum(count)))[np.searchsorted(alive, np.append(begin, n))]
        return np.diff(ends), out

    def _each(self, words: list[str], begin: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same word by word: unigram models, and long words."""
        by = np.argsort(starts, kind="stable")
        starts, sizes, ids = starts[by], sizes[by], ids[by]
        own = np.searchsorted(begin, starts, side="right") - 1
        cut = np.searchsorted(own, np.arange(len(words) + 1))
        starts = starts - begin[own]
        s, e, ids = starts.tolist(), (starts + sizes).tolist(), ids.tolist()
        relax = self._contract if self.model.kind == BPE else self._path
        got = []
        for k, w in enumerate(words):
            a, b = cut[k], cut[k + 1]
            got.append(relax(w, dict(zip(zip(s[a:b], e[a:b], strict=True), ids[a:b], strict=True))))
        return np.array([len(x) for x in got], np.int64), np.array([i for x in got for i in x], np.int32)

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and all ids, by a suffix array over at most LEARN_CHARS characters, a word at least."""
        relax = self._contract_all if self.model.kind == BPE and max(map(len, words)) <= SHORT else self._each
        counts, flats = [], []
        i = size = 0
        for j, w in enumerate(words):
            size += len(w) + 1
            if size > LEARN_CHARS or j + 1 == len(words):
                group = words[i : j + 1]
                starts, sizes, ids, begin = self.matcher.edges(group)
                n, flat = relax(group, begin, starts, sizes, ids)
                counts.append(n)
                flats.append(flat)
                i, size = j + 1, 0
        return np.concatenate(counts), np.concatenate(flats)

    def learn(self) -> None:
        """Ids of the words that wait, and whether they decode to the word again."""
        new, self.known.new = self.known.new, []
        if not new:
            return
        short = np.fromiter((len(w) <= SHORT for w in new), bool, len(new))
        size, parts = np.zeros(len(new), np.int64), {}
        for kind in (True, False):
            at = np.flatnonzero(short == kind)
            if len(at):
                size[at], parts[kind] = self._ids([new[i] for i in at.tolist()])
        each = np.repeat(short, size)
        flat = np.empty(int(size.sum()), np.int32)
        for kind, got in parts.items():
            flat[each == kind] = got
        ids, end = flat.tolist(), np.cumsum(size).tolist()
        spelled = [b"".join(map(self.texts.__getitem__, ids[e - n : e])) for e, n in zip(end, size.tolist(), strict=True)]
        true = np.fromiter((x == w.encode("utf-8", "surrogatepass") for x, w in zip(spelled, new, strict=True)), bool, len(new))
        self.flat, self.size, self.true = np.concatenate([self.flat, flat]), np.concatenate([self.size, size]), np.concatenate([self.true, true])

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[bool]]:
        """Where the ids of each text end, all ids, and whether decoding gives the whole text again."""
        if len(self.known) > MEMORY:
            self.forget()
        find, number = self.cut.findall, self.known.__getitem__
        norms = [self.normalise(t) if t else "" for t in texts]
        parts = [find(t) if t else () for t in norms]
        words = np.fromiter(map(number, chain.from_iterable(parts)), np.int64)
        n_words = np.fromiter(map(len, parts), np.int64, len(parts))
        del parts
        self.learn()
        n = self.size[words]
        first = (np.cumsum(self.size) - self.size)[words]
        ends = np.cumsum(n)
        flat = self.flat[np.repeat(first - ends + n, n) + np.arange(int(n.sum()))]
        last = np.cumsum(n_words)
        ends = np.concatenate(([0], ends))[last]
        wrong = np.concatenate(([0], np.cumsum(~self.true[words])))
        wrong = (wrong[last] - wrong[last - n_words]).tolist()
        same = []
        for k, (t, s, bad) in enumerate(zip(texts, norms, wrong, strict=True)):
            if bad:
                same.append(self.decode(flat[ends[k - 1] if k else 0 : ends[k]].tolist()) == t)
            else:  # every word decodes to itself, so the ids decode to the normalised text
                s = s.replace(SPACE, " ")
                same.append((s[1:] if self.model.prefix and s.startswith(" ") else s) == (t or ""))
        return ends, flat, same

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        ends, flat, _ = self.encode_flat(texts)
        ids, ends = flat.tolist(), [0, *ends.tolist()]
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.texts.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.model.prefix and text.startswith(" ") else text


_encoders: dict[str, Encoder] = {}


def _told(spark, model_path: str):
    """The model goes to executors by broadcast; a vocabulary bounds its size."""
    model = spark.sparkContext.broadcast(read_model(model_path))

    def encoder() -> Encoder:
        if model_path not in _encoders:
            _encoders[model_path] = Encoder(model.value)
        enc = copy.copy(_encoders[model_path])  # what a task learns goes with it
        enc.forget()
        return enc

    return encoder


def encode(docs: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """(doc_id, n_tokens, ids, lossless) of each row; ``lossless``: decoding gives the whole text again.

    A null or empty text has no ids, n_tokens 0, and is lossless. A text with U+2581 or
    with what the model's normalisation changes is not lossless. Texts are encoded whole,
    whatever their length; of equally good merges the leftmost comes first. Repeated rows get
    equal ids; an empty table gives an empty one; other columns are not read.
    """
    encoder = _told(docs.sparkSession, model_path)

    def make():
        enc = encoder()

        def run(cols: dict) -> dict:
            ends, flat, same = enc.encode_flat(cols["text"])
            begin = np.concatenate(([0], ends))
            ids = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(flat, pa.int32()))
            return {"doc_id": cols["doc_id"], "n_tokens": np.diff(begin), "ids": ids, "lossless": same}

        return run

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_slices(rows, "doc_id long, n_tokens long, ids array<int>, lossless boolean", make)


def decode(tokens: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text); null ids give a null text."""
    encoder = _told(tokens.sparkSession, model_path)

    def make():
        enc = encoder()
        return lambda cols: {"doc_id": cols["doc_id"], "text": [None if x is None else enc.decode(x) for x in cols["ids"]]}

    return map_slices(tokens.select("doc_id", "ids"), "doc_id long, text string", make, text=None)
