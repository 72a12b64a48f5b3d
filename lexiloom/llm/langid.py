"""Language of words by a linear-chain conditional random field, summed up for whole texts.

Features of a word are its affixes (1 to 3 letters), all its 2- and 3-grams and its entry in a
lexicon of training words, hashed into one weight table; features reach the chain through the
word's label scores, transitions between labels are learned with them. Training sequences are
spliced from spans of documents of different languages, so that switches inside a sequence
have been seen. Labels are marginals by forward-backward; a text is one chain, worked through in
sequences of ``SPAN`` words with messages carried from each to its neighbours.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_slices

#: Bound of the training sample: labelled documents, and letters of each that are read.
SAMPLE_DOCS, SAMPLE_CHARS = 1_200, 1_200
SPAN, WIDTH, BITS = 64, 24, 17
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")
_GRAMS = 2 * WIDTH + 6 + 1


@dataclass
class Crf:
    """Weights: features x labels, transitions, starts; the lexicon's words keep their own weight."""

    labels: list[str]
    weights: np.ndarray
    moves: np.ndarray
    starts: np.ndarray
    lexicon: dict[str, int]
    version: int


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids of words of at most WIDTH letters, and which of them count."""
    n = len(words)
    size = np.fromiter(map(len, words), np.int64, n)
    codes = np.zeros((n, WIDTH + 2), np.uint64)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    rows = np.repeat(np.arange(n), size)
    cols = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    codes[rows, cols + 1] = flat
    codes[:, 0] = 1
    codes[np.arange(n), size + 1] = 2
    ids = np.zeros((n, _GRAMS), np.int64)
    on = np.zeros((n, _GRAMS), bool)
    m1, m2, m3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
    top = np.uint64(64 - BITS)

    def put(k: int, salt: int, *cs: np.ndarray) -> None:
        h = np.full(n, np.uint64(salt), np.uint64)
        for c in cs:
            h = (h ^ c) * m1
            h = (h ^ (h >> np.uint64(29))) * m2
        ids[:, k] = ((h * m3) >> top).astype(np.int64)

    at = np.arange(n)
    for i in range(WIDTH):
        put(2 * i, 11, codes[:, i], codes[:, i + 1])
        on[:, 2 * i] = i < size + 1
        put(2 * i + 1, 12, codes[:, i], codes[:, i + 1], codes[:, i + 2])
        on[:, 2 * i + 1] = i < size
    for j in range(3):
        k = 2 * WIDTH + j
        put(k, 20 + j, *[codes[:, 1 + i] for i in range(j + 1)])
        put(k + 3, 30 + j, *[codes[at, np.maximum(size - i, 0)] for i in range(j + 1)])
        on[:, k] = on[:, k + 3] = size > j
    known = np.fromiter((lexicon.get(w, -1) for w in words), np.int64, n)
    ids[:, -1] = np.where(known >= 0, (1 << BITS) + known, 0)
    on[:, -1] = known >= 0
    return ids, on


def word_scores(words: list[str], weights: np.ndarray, lexicon: dict[str, int]) -> np.ndarray:
    """Label scores of distinct words."""
    out = np.zeros((len(words), weights.shape[1]), np.float32)
    for i in range(0, len(words), 20_000):
        ids, on = features(words[i : i + 20_000], lexicon)
        got = weights[ids[:, 0]] * on[:, :1]
        for k in range(1, _GRAMS):
            got += weights[ids[:, k]] * on[:, k : k + 1]
        out[i : i + 20_000] = got
    return out


def forward_backward(emit: np.ndarray, moves: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (sequence, position, label) and summed pair marginals (label, label) of padded sequences.

    Each step is scaled by its sum. Padding follows a sequence's end; its marginals are 0.
    """
    n, length, k = emit.shape
    e = np.exp(emit - emit.max(axis=2, keepdims=True))
    t = np.exp(moves - moves.max())
    live = np.arange(length)[None, :] < size[:, None]
    fwd, bwd = np.zeros_like(e), np.ones_like(e)
    a = e[:, 0] * np.exp(starts - starts.max())
    fwd[:, 0] = a / a.sum(axis=1, keepdims=True)
    for i in range(1, length):
        a = (fwd[:, i - 1] @ t) * e[:, i]
        fwd[:, i] = a / a.sum(axis=1, keepdims=True)
    for i in range(length - 2, -1, -1):
        b = (bwd[:, i + 1] * e[:, i + 1]) @ t.T
        b /= b.sum(axis=1, keepdims=True)
        bwd[:, i] = np.where(live[:, i + 1 : i + 2], b, 1.0)
    p = fwd * bwd
    p /= p.sum(axis=2, keepdims=True)
    p *= live[:, :, None]
    left = fwd[:, :-1, :, None] * t[None, None] * (bwd[:, 1:] * e[:, 1:])[:, :, None, :]
    left /= left.sum(axis=(2, 3), keepdims=True)
    pairs = (left * live[:, 1:, None, None]).sum(axis=(0, 1))
    return p, pairs


def marginals(emit: np.ndarray, moves: np.ndarray, starts: np.ndarray, size: np.ndarray, after: np.ndarray | None = None) -> np.ndarray:
    """Marginals alone, as ``forward_backward`` has them.

    ``starts`` may differ by sequence (n, label); ``after`` (n, label) is what a sequence's end
    hears from what follows it, as weights.
    """
    n, length, k = emit.shape
    e = np.exp(emit - emit.max(axis=2, keepdims=True))
    t = np.exp(moves - moves.max()).astype(emit.dtype)
    fwd = np.empty_like(e)
    a = e[:, 0] * np.exp(starts - starts.max(axis=-1, keepdims=True)).astype(emit.dtype)
    fwd[:, 0] = a / a.sum(axis=1, keepdims=True)
    for i in range(1, length):
        a = (fwd[:, i - 1] @ t) * e[:, i]
        fwd[:, i] = a / a.sum(axis=1, keepdims=True)
    end = np.ones((n, k), emit.dtype) if after is None else after.astype(emit.dtype)
    b = end
    for i in range(length - 1, -1, -1):
        if i < length - 1:
            c = (b * e[:, i + 1]) @ t.T
            b = np.where((i + 1 < size)[:, None], c / c.sum(axis=1, keepdims=True), end).astype(emit.dtype)
        p = fwd[:, i] * b
        fwd[:, i] = p / p.sum(axis=1, keepdims=True) * (i < size)[:, None]
    return fwd


def transfers(emit: np.ndarray, moves: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What each sequence makes of a message that comes in before its first word: (n, label in, label out), scaled."""
    n, length, k = emit.shape
    e = np.exp(emit - emit.max(axis=2, keepdims=True))
    t = np.exp(moves - moves.max()).astype(emit.dtype)
    m = np.eye(k, dtype=emit.dtype)[None] * e[:, 0][:, None, :]
    for i in range(1, length):
        live = np.flatnonzero(i < size)
        x = (m[live].reshape(-1, k) @ t).reshape(-1, k, k) * e[live, i][:, None, :]
        m[live] = x / x.sum(axis=(1, 2), keepdims=True)
    return m


def carried(m: np.ndarray, per: np.ndarray, moves: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log weights that enter each sequence, and weights that its end hears, where ``per`` sequences in a row are one text."""
    t = np.exp(moves - moves.max())
    first = np.cumsum(per) - per
    into = np.tile(np.exp(starts - starts.max()), (len(m), 1))
    heard = np.ones_like(into)
    for j in range(int(per.max(initial=1)) - 1):
        at = first[per > j + 1] + j
        x = np.einsum("nk,nkl->nl", into[at], m[at]) @ t
        into[at + 1] = x / x.sum(axis=1, keepdims=True)
        at = (first + per - 1)[per > j + 1] - j
        y = np.einsum("nkl,nl->nk", m[at], heard[at]) @ t.T
        heard[at - 1] = y / y.sum(axis=1, keepdims=True)
    return np.log(np.maximum(into, 1e-300)), heard


def tokens(text: str | None) -> list[str]:
    """Lower-cased runs of letters of a whole text; longer ones than WIDTH count as several words."""
    if not text:
        return []
    found = _WORD.findall(text.lower())
    if found and max(map(len, found)) > WIDTH:
        found = [w[i : i + WIDTH] for w in found for i in range(0, len(w), WIDTH)]
    return found


def train(texts: list[str], langs: list[str], rounds: int = 35, seed: int = 7) -> Crf:
    """Maximum likelihood by full-batch Adam, with a small penalty; deterministic."""
    labels = sorted(set(langs))
    number = {x: i for i, x in enumerate(labels)}
    rng = np.random.default_rng(seed)
    spans: list[tuple[int, list[str]]] = []
    count: Counter[str] = Counter()
    for text, lang in zip(texts, langs, strict=True):
        words = [w for w in tokens(text[:SAMPLE_CHARS]) if w.isalpha()]
        count.update(set(words))
        i = 0
        while i < len(words):
            j = i + int(rng.integers(4, 24))
            spans.append((number[lang], words[i:j]))
            i = j
    lexicon = {w: i for i, w in enumerate(sorted(w for w, c in count.items() if c >= 3))}
    order = rng.permutation(len(spans))
    flat = [w for k in order for w in spans[k][1]]
    truth = np.concatenate([np.full(len(spans[k][1]), spans[k][0]) for k in order]) if len(spans) else np.empty(0, np.int64)
    k = len(labels)
    weights = np.zeros(((1 << BITS) + len(lexicon), k), np.float32)
    moves, starts = np.eye(k) * 2, np.zeros(k)
    if k < 2 or not flat:
        return Crf(labels, weights, moves, starts, lexicon, 0)
    n = -(-len(flat) // SPAN)
    vocab = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    ids, on = features(list(vocab), lexicon)
    at = np.full(n * SPAN, 0)
    at[: len(flat)] = [vocab[w] for w in flat]
    y = np.full(n * SPAN, 0)
    y[: len(flat)] = truth
    at, y = at.reshape(n, SPAN), y.reshape(n, SPAN)
    size = np.full(n, SPAN)
    size[-1] = len(flat) - (n - 1) * SPAN
    live = np.arange(SPAN)[None] < size[:, None]
    gold = np.zeros((len(vocab), k))
    np.add.at(gold, (at[live], y[live]), 1)
    both = live[:, 1:]
    steps = np.zeros((k, k))
    np.add.at(steps, (y[:, :-1][both], y[:, 1:][both]), 1)
    rows, cols = np.nonzero(on)
    used = ids[rows, cols]
    want = [np.zeros_like(weights), np.zeros_like(moves), np.zeros_like(starts)]
    mean, var = [np.zeros_like(x) for x in want], [np.zeros_like(x) for x in want]
    total = len(flat)
    for r in range(1, rounds + 1):
        emit = np.zeros((len(vocab), k))
        for j in range(k):
            emit[:, j] = np.bincount(rows, weights[used, j], len(vocab))
        p, pairs = forward_backward(emit[at], moves, starts, size)
        seen = np.stack([np.bincount(at.ravel(), p[:, :, j].ravel(), len(vocab)) for j in range(k)], 1)
        d = gold - seen
        want[0] = np.stack([np.bincount(used, d[rows, j], len(weights)) for j in range(k)], 1) / total - 1e-6 * weights
        want[1] = (steps - pairs) / total - 1e-4 * moves
        want[2] = (np.bincount(y[:, 0], minlength=k) - p[:, 0].sum(0)) / n - 1e-4 * starts
        for x, g, m, v in zip((weights, moves, starts), want, mean, var, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += (0.15 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)).astype(x.dtype)
    return Crf(labels, weights, moves, starts, lexicon, int(xxhash.xxh3_64_intdigest(weights.tobytes()) >> 1))


def fit(docs: DataFrame, max_docs: int = SAMPLE_DOCS) -> Crf:
    """Learns from at most ``max_docs`` rows with a language whose crc32(doc_id) mod 5 is not 0, the first by a hash."""
    able = docs.where("lang is not null and text is not null and doc_id is not null").where(~held_out())
    ids = [r[0] for r in able.select("doc_id", F.xxhash64("doc_id").alias("h")).distinct().orderBy("h", "doc_id").limit(max_docs).collect()]
    rows = able.where(F.col("doc_id").isin(ids)).select("doc_id", F.substring("text", 1, SAMPLE_CHARS).alias("text"), "lang").collect() if ids else []
    rows = sorted(rows)
    return train([r.text for r in rows], [r.lang for r in rows])


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


class _Known(dict):
    """Row of a word's scores; new words wait until the slice's end."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, w: str) -> int:
        i = self[w] = len(self)
        self.new.append(w)
        return i


def posteriors(texts: list[str | None], crf: Crf, cache: dict[int, tuple[_Known, np.ndarray]] | None = None) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
    """Words with a letter of each text, how many they are, and the label marginals of all of them in a row.

    A text is one chain, whatever its length: it is worked through in sequences of ``SPAN`` words,
    and messages are carried from each to the next in both directions. ``cache`` keeps words for later calls.
    """
    cache = {} if cache is None else cache
    known, scores = cache.get(crf.version, (None, None))
    if known is None or len(known) > 300_000:
        known, scores = _Known(), np.zeros((0, len(crf.labels)), np.float32)
    found = [tokens(t) for t in texts]
    ids = [np.fromiter(map(known.__getitem__, ws), np.int64, len(ws)) for ws in found]
    if known.new:
        new = word_scores(known.new, crf.weights, crf.lexicon)
        new[[i for i, w in enumerate(known.new) if not any(c.isalpha() for c in w)]] = np.nan
        scores = np.concatenate([scores, new])
        known.new = []
    cache.clear()
    cache[crf.version] = (known, scores)
    for k, x in enumerate(ids):
        if len(x) and (bad := np.isnan(scores[x, 0])).any():
            ids[k], found[k] = x[~bad], [w for w, out in zip(found[k], bad.tolist(), strict=True) if not out]
    size = np.array([len(x) for x in ids], np.int64)
    out = np.zeros((int(size.sum()), len(crf.labels)), np.float32)
    if not len(out):
        return found, size, out
    per = -(-size // SPAN)
    owner = np.repeat(np.arange(len(ids)), per)
    part = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    own = np.minimum(size[owner] - part * SPAN, SPAN)
    flat = np.concatenate(ids)
    begin = (np.cumsum(size) - size)[owner] + part * SPAN
    emit = lambda rows: scores[flat[np.minimum(begin[rows][:, None] + np.arange(SPAN)[None], len(flat) - 1)]]
    into, heard = np.tile(crf.starts, (len(owner), 1)), np.ones((len(owner), len(crf.labels)))
    more = np.flatnonzero(per[owner] > 1)
    if len(more):
        m = np.concatenate([transfers(emit(more[i : i + 2_000]), crf.moves, own[more[i : i + 2_000]]) for i in range(0, len(more), 2_000)])
        into[more], heard[more] = carried(m, per[per > 1], crf.moves, crf.starts)
    for i in range(0, len(owner), 2_000):
        rows = np.arange(i, min(i + 2_000, len(owner)))
        p = marginals(emit(rows), crf.moves, into[rows], own[rows], heard[rows])
        live = np.arange(SPAN)[None] < own[rows][:, None]
        out[(begin[rows][:, None] + np.arange(SPAN)[None])[live]] = p[live]
    return found, size, out


def label_texts(texts: list[str | None], crf: Crf, cache: dict[int, tuple[_Known, np.ndarray]] | None = None) -> tuple[list[str], list[float], list[dict]]:
    """Of each text: language, its share of the word marginals, and the shares by label."""
    _, size, p = posteriors(texts, crf, cache)
    owner = np.repeat(np.arange(len(size)), size)
    sums = np.stack([np.bincount(owner, p[:, j], len(size)) for j in range(len(crf.labels))], 1)
    langs, score, shares = [], [], []
    for n, x in zip(size, sums, strict=True):
        best = int(x.argmax()) if n else -1
        langs.append(crf.labels[best] if n else UNKNOWN)
        score.append(float(min(1.0, max(0.0, x[best] / n))) if n else 0.0)
        shares.append({lang: float(v / n) for lang, v in zip(crf.labels, x, strict=True)} if n else {})
    return langs, score, shares


def label_words(docs: DataFrame, crf: Crf) -> DataFrame:
    """(doc_id, words, langs, probs) of each row: every word of the text with its own label and marginal.

    A null text or one without letters has no words; with nothing learned every word is ``und``.
    Words are lower-cased; those of more than WIDTH letters count as several.
    """
    told = docs.sparkSession.sparkContext.broadcast(crf)

    def make():
        cache: dict = {}

        def run(cols: dict) -> dict:
            labels = told.value.labels
            if not labels:
                words = [[w for w in tokens(t) if w.isalpha()] for t in cols["text"]]
                return {"doc_id": cols["doc_id"], "words": words, "langs": [[UNKNOWN] * len(w) for w in words], "probs": [[0.0] * len(w) for w in words]}
            words, size, p = posteriors(cols["text"], told.value, cache)
            best, prob = p.argmax(axis=1).tolist() if len(p) else [], p.max(axis=1).tolist() if len(p) else []
            cut = [0, *np.cumsum(size).tolist()]
            spans = list(zip(cut[:-1], cut[1:], strict=True))
            return {"doc_id": cols["doc_id"], "words": words, "langs": [[labels[x] for x in best[a:b]] for a, b in spans], "probs": [prob[a:b] for a, b in spans]}

        return run

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_slices(rows, "doc_id long, words array<string>, langs array<string>, probs array<double>", make)


def predict(docs: DataFrame, crf: Crf) -> DataFrame:
    """Adds nothing to ``docs``: returns doc_id, held_out, lang_pred, score, shares for each row, from the text alone.

    A null text or one without letters gets ``und`` and the score 0. Texts are read whole,
    whatever their length; of languages with equal shares the first by name is taken. Repeated
    rows get equal results; a null doc_id is not held out; other columns are not read. An empty
    table gives an empty one. With no labelled rows to learn from, every text gets ``und``.
    """
    spark = docs.sparkSession
    told = spark.sparkContext.broadcast(crf)  # bounded: 2^BITS rows and the lexicon of a bounded sample

    def make():
        cache: dict = {}

        def run(cols: dict) -> dict:
            if not told.value.labels:
                n = len(cols["doc_id"])
                langs, score, shares = [UNKNOWN] * n, [0.0] * n, [{}] * n
            else:
                langs, score, shares = label_texts(cols["text"], told.value, cache)
            return {"doc_id": cols["doc_id"], "held_out": cols["held_out"], "lang_pred": langs, "score": score, "shares": [list(x.items()) for x in shares]}

        return run

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return map_slices(rows, "doc_id long, held_out boolean, lang_pred string, score double, shares map<string, double>", make)


def keep_known(docs: DataFrame, crf: Crf) -> DataFrame:
    """The rows of ``docs`` whose text has a language; those without a letter go. All columns stay, in place.

    The text is labelled once, beside the other columns, and no join is made.
    """
    told = docs.sparkSession.sparkContext.broadcast(crf)
    names = docs.columns

    def make():
        cache: dict = {}

        def run(cols: dict) -> dict:
            langs = label_texts(cols["text"], told.value, cache)[0] if told.value.labels else [UNKNOWN if not any(c.isalpha() for c in t or "") else "" for t in cols["text"]]
            keep = [i for i, x in enumerate(langs) if x != UNKNOWN]
            return {c: [cols[c][i] for i in keep] for c in names}

        return run

    return map_slices(docs, docs.schema, make)
