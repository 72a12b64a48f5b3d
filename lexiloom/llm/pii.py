"""Personal data: fixed patterns, and candidates chosen by boosted trees.

Base spans of four kinds are found by pattern and always stay. High-recall generators propose
more spans, which may overlap: national phone numbers, written-out mail addresses, account and
identity numbers, IPv6 addresses, street addresses, names after a title. Boosted trees judge each
candidate on its format and on its context, for which weights of neighbouring words are learned;
a candidate is taken if its calibrated probability reaches its kind's threshold and it overlaps
neither a base span nor a better one.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_slices
from .trees import Tree, boost, calibrate

BASE = ("email", "ip", "card", "phone")
MORE = ("local_phone", "written_email", "ssn", "iban", "ip6", "address", "name")
KINDS = BASE + MORE
_LOCAL = "".join(map(chr, range(128)))
_LOCAL = "".join(c for c in _LOCAL if c.isalnum() or c in "._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, int]  # start, end, number of the kind


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def _octet(s: str) -> bool:
    s = s.lstrip("0")
    return len(s) < 3 or len(s) == 3 and s <= "255"


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that hold, in the order of their starts.

    Works in a time linear in the text: mail addresses are found from their @, and digit runs
    are entered at their start only.
    """
    out: list[Span] = []
    at, floor = text.find("@"), 0
    while at >= 0:
        seg = text[floor:at]
        left = floor + len(seg.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if left < at else None
        if m:
            out.append((left, m.end(), 0))
        floor = m.end() if m else at + 1
        at = text.find("@", floor)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(map(_octet, m[0].split("."))):
                out.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and _luhn(digits):
                    out.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    out.append((m.start(), m.end(), 3))
    out.sort()
    return out


# Titles, street words in four languages.
_TITLE = r"Mrs?|Ms|Dr|Prof|Herrn?|Frau|Señora?|Sra?|Monsieur|Madame|Mme"
_STREET = r"Street|St|Avenue|Ave|Road|Rd|Lane|Drive|Court|Boulevard|Blvd|Way|Place|Square"
_VIA = r"(?i:calle|avenida|plaza|rue|avenue|boulevard)\x20(?:de\x20la\x20|de\x20|del\x20|du\x20|des\x20)?"
# Generators of candidates: kind, what a text must have, pattern; a group in it is the span.
_GENERATORS = (
    ("local_phone", _DIGIT, re.compile(r"(?<![\w+])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?!\w)")),
    ("written_email", re.compile(r"(?i:\b(?:at|arroba)\b|\[at\]|\(at\))"), re.compile(r"(?i)(?<![\w.])[a-z0-9][a-z0-9._-]{1,40}(?:\x20at\x20|\x20arroba\x20|\x20?[\[(]at[\])]\x20?)[a-z0-9-]{2,40}(?:(?:\x20dot\x20|\x20punto\x20|\x20?[\[(]dot[\])]\x20?|\.)[a-z]{2,12}){1,3}(?!\w)")),
    ("ssn", _DIGIT, re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    ("iban", _DIGIT, re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?!\w)")),
    ("ip6", re.compile(r":"), re.compile(r"(?<![\w:])(?:[0-9a-fA-F]{1,4}:){2,7}(?::?[0-9a-fA-F]{1,4}){1,6}(?![\w:])")),
    (
        "address",
        _DIGIT,
        re.compile(
            rf"(?<!\w)(?:[0-9]{{1,5}}[a-zA-Z]?\x20(?:[A-Z][\w'’-]*\x20){{1,3}}(?:{_STREET})(?!\w)|[A-ZÄÖÜ][\wäöüß-]*(?:straße|strasse|weg|platz|allee|gasse)\x20[0-9]{{1,4}}[a-z]?(?!\w)"
            rf"|[0-9]{{1,4}},?\x20{_VIA}[A-ZÀ-Ü][\w'’-]+|{_VIA}[A-ZÀ-Ü][\w'’-]+,?\x20[0-9]{{1,4}}(?!\w))"
        ),
    ),
    ("name", re.compile(rf"\b(?:{_TITLE}|[Nn]ame)\b"), re.compile(rf"(?:(?<!\w)(?:{_TITLE})\.?\x20|\b[Nn]ame(?:\x20is|:)\x20)([A-ZÀ-Ü][\w'’-]+(?:\x20[A-ZÀ-Ü][\w'’-]+){{0,2}})")),
)
# Words that stand near personal data of a kind.
_CUES = {
    "local_phone": ("phone", "call", "tel", "telephone", "mobile", "fax", "cell", "whatsapp", "telefon", "teléfono", "téléphone", "number"),
    "written_email": ("mail", "email", "e-mail", "contact", "write", "reach", "correo", "courriel", "address"),
    "ssn": ("ssn", "social", "security", "tax", "id", "identity", "insurance"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte", "transfer"),
    "ip6": ("ip", "ipv6", "host", "address", "server", "login", "from"),
    "address": ("address", "lives", "live", "home", "ship", "deliver", "wohnt", "adresse", "dirección", "vive", "habite"),
    "name": ("patient", "contact", "name", "signed", "dear", "regards", "ask", "met", "saw", "called"),
}
# Words that stand near numbers of the same shapes that are nobody's.
_OTHERS = "chapter section part model serial isbn order invoice figure lot article item version page table score ratio build sku draft volume code ticket case issue time movie drink".split()
_WORDS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")
FEATURES = (*[f"is_{k}" for k in MORE], "length", "digits", "letters", "separators", "distinct", "brackets", "cue_before", "cue_after", "own_line", "number_before", "number_after", "checksum", "near")


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    if not 15 <= len(s) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def candidates(text: str) -> list[Span]:
    """What the generators propose; spans may overlap."""
    out = []
    for kind, needs, pattern in _GENERATORS:
        if needs.search(text):
            k = pattern.groups and 1
            out.extend((m.start(k), m.end(k), KINDS.index(kind)) for m in pattern.finditer(text))
    return out


def _near(text: str, span: Span) -> list[str]:
    """The last five words before a candidate and the first three after it, of 60 characters on either side."""
    s, e, _ = span
    return [w.lower() for w in _WORDS.findall(text[max(0, s - 60) : s])][-5:] + [w.lower() for w in _WORDS.findall(text[e : e + 60])][:3]


def describe(text: str, span: Span, weights: dict[str, float]) -> list[float]:
    """Features of a candidate: its format, and the 60 characters on either side."""
    s, e, k = span
    kind, value = KINDS[k], text[s:e]
    before, after = text[max(0, s - 60) : s], text[e : e + 60]
    cues = _CUES[kind]
    digits = sum(map(str.isdigit, value))
    near = [w.lower() for w in _WORDS.findall(before)][-5:]
    next_ = [w.lower() for w in _WORDS.findall(after)][:3]
    held = {"iban": lambda: _iban_ok(value), "ssn": lambda: value[:3] not in ("000", "666") and value[0] != "9" and value[4:6] != "00" and value[7:] != "0000"}.get(kind, lambda: True)()
    return [
        *[float(kind == x) for x in MORE],
        float(len(value)),
        float(digits),
        float(sum(map(str.isalpha, value))),
        float(sum(not c.isalnum() for c in value)),
        float(len(set(value))),
        float("(" in value or "[" in value),
        float(any(w in cues for w in near)),
        float(any(w in cues for w in next_)),
        float("\n" in before[-3:] and "\n" in after[:3]),
        float(before[-2:-1].isdigit() or before[-1:].isdigit()),
        float(after[:1].isdigit() or after[1:2].isdigit()),
        float(held),
        sum(weights.get(w, 0.0) for w in set(_near(text, span))),
    ]


@dataclass
class Model:
    prior: float
    trees: list[Tree]
    slope: float
    offset: float
    thresholds: dict[int, float]
    weights: dict[str, float]

    def probability(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.prior)
        for t in self.trees:
            f += t.apply(x)
        return 1 / (1 + np.exp(-(self.slope * f + self.offset)))


def _examples(n: int, seed: int) -> list[tuple[str, Span, int]]:
    """Labelled candidates in invented sentences: personal data, mostly beside cues, and values of the same shapes beside other words.

    Some of either kind stand beside neither, and some cues stand beside the wrong kind, so that shape alone and cues alone don't decide.
    """
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    num = lambda k: "".join(str(int(d)) for d in rng.integers(0, 10, k))
    names = ["maria", "j.doe", "lena_k", "tom99", "amy-w", "info", "p.martin"]
    filler = ["the report", "we met", "section", "table", "and then", "version", "results of", "der wert", "la suma", "le total", "look", "page"]
    hosts = ["example", "mailbox", "uni-north", "corp"]
    tops = ["com", "org", "net", "de"]
    proper = ["Miller", "Garcia", "Lopez", "Baker", "Schmidt", "Weber", "Moreau", "Dubois", "Anna", "Peter", "Lucia", "Elm", "Oak", "Linden", "Church"]

    def iban() -> str:
        body = num(18)
        check = 98 - int(body + "131400") % 97
        s = f"DE{check:02d}{body}"
        return pick([s, " ".join(s[i : i + 4] for i in range(0, len(s), 4))])

    good = {
        "local_phone": lambda: f"({num(3)}) {num(3)}-{num(4)}" if rng.random() < 0.5 else f"{num(3)}{pick('-. ')}{num(3)}{pick('-. ')}{num(4)}",
        "written_email": lambda: f"{pick(names)}{pick([' at ', ' [at] ', '(at)', ' arroba '])}{pick(hosts)}{pick([' dot ', ' [dot] ', '.', ' punto '])}{pick(tops)}",
        "ssn": lambda: f"{int(rng.integers(1, 665)):03d}-{int(rng.integers(1, 99)):02d}-{int(rng.integers(1, 9999)):04d}",
        "iban": iban,
        "ip6": lambda: ":".join(f"{int(x):x}" for x in rng.integers(0, 65536, 8)),
        "address": lambda: pick([f"{num(2)} {pick(proper)} {pick(['Street', 'Road', 'Lane', 'Ave'])}", f"{pick(proper)}straße {num(2)}", f"calle {pick(proper)} {num(2)}", f"{num(2)} rue de {pick(proper)}"]),
        "name": lambda: f"{pick(['Mr', 'Mrs', 'Dr', 'Herr', 'Frau', 'Señora', 'Mme'])}{pick(['.', ''])} {pick(proper)}{pick(['', ' ' + pick(proper)])}",
    }
    bad = {
        "local_phone": lambda: f"{num(3)} {num(3)} {num(3)}" if rng.random() < 0.6 else f"{num(4)}-{num(4)}-{num(4)}",
        "written_email": lambda: f"{pick(['look', 'stay', 'met', 'arrive', 'sold'])} at {pick(['home', 'noon', 'work', 'cost', 'school'])}.{pick(['then', 'the', 'and', 'we', 'so'])}",
        "ssn": lambda: f"{pick(['000', '666', '9' + num(2)])}-{num(2)}-{num(4)}",
        "iban": lambda: f"{pick(['AB', 'XY', 'QR'])}{num(2)} {pick(['ABCD', 'PART', 'ITEM'])} {num(4)}",
        "ip6": lambda: pick([f"{int(rng.integers(0, 24))}:{num(2)}:{num(2)}", f"{num(2)}:{num(2)}:{num(2)}:{num(2)}"]),
        "address": lambda: f"{num(2)} {pick(['Big', 'Great', 'Other', 'New', 'Open'])} {pick(['Place', 'Way', 'Square'])}",
        "name": lambda: f"{pick(['Dr', 'Mr'])} {pick(['Pepper', 'Right', 'Big', 'Who', 'Watson'])}",
    }
    for kind in MORE:  # half of what is nobody's looks exactly like what is
        bad[kind] = (lambda a, b: lambda: a() if rng.random() < 0.5 else b())(good[kind], bad[kind])
    out = []
    while len(out) < n:
        kind = pick(MORE)
        y = int(rng.random() < 0.5)
        value = (good if y else bad)[kind]()
        word = pick(_CUES[kind]) if rng.random() < (0.8 if y else 0.04) else pick(_OTHERS) if rng.random() < (0.03 if y else 0.8) else ""
        head = f"{pick(filler)} {word}{pick([':', ' is', '']) if word else ''} "
        text = head + value + " " + pick(filler)
        hits = [c for c in candidates(text) if KINDS[c[2]] == kind and c[0] < len(head) + len(value) and c[1] > len(head)]
        out.extend((text, c, y) for c in hits[:1])
        if not hits:
            n -= 1
    return out


_fitted: dict[tuple[int, int], Model] = {}


def fit(n: int = 6_000, seed: int = 5) -> Model:
    """Learns from ``n`` invented labelled candidates: weights of words on a quarter, trees on half, calibration and thresholds on the rest.

    A kind's threshold is the smallest that gives it a precision of 0.95 there, 0.5 at least; where
    none does, the one with the best precision.
    """
    if (n, seed) in _fitted:
        return _fitted[n, seed]
    rows = _examples(n, seed)
    part = np.arange(len(rows)) % 4
    seen: dict[str, list[int]] = {}
    total = [0, 0]
    for (t, c, v), p in zip(rows, part.tolist(), strict=True):
        if p == 0:
            total[v] += 1
            for w in set(_near(t, c)):
                seen.setdefault(w, [0, 0])[v] += 1
    weights = {w: float(np.log((k[1] + 1) / (total[1] + 2)) - np.log((k[0] + 1) / (total[0] + 2))) for w, k in sorted(seen.items()) if sum(k) >= 4}
    x, y = np.array([describe(t, c, weights) for t, c, _ in rows]), np.array([v for *_, v in rows])
    rest = part == 3
    prior, trees = boost(x[(part == 1) | (part == 2)], y[(part == 1) | (part == 2)])
    m = Model(prior, trees, 1.0, 0.0, {}, weights)
    raw = np.log((p := np.clip(m.probability(x[rest]), 1e-9, 1 - 1e-9)) / (1 - p))
    m.slope, m.offset = calibrate(raw, y[rest])
    p = m.probability(x[rest])
    for j, kind in enumerate(MORE):
        own = x[rest][:, j] > 0
        tried = [(float(y[rest][own & (p >= c)].mean()), float(c)) for c in np.arange(0.98, 0.49, -0.02) if (own & (p >= c)).any()]
        right = [c for mean, c in tried if mean >= 0.95]
        m.thresholds[KINDS.index(kind)] = round(min(right) if right else max(tried, default=(0, 0.99))[1], 2)
    _fitted[n, seed] = m
    return m


def find(texts: list[str | None], model: Model) -> list[tuple[list[Span], list[Span]]]:
    """Base spans, and all spans, of each whole text; by start, then kind."""
    base = [base_spans(t) if t else [] for t in texts]
    extra: list[tuple[int, Span]] = []
    rows = []
    for i, t in enumerate(texts):
        for c in candidates(t) if t else ():
            extra.append((i, c))
            rows.append(describe(t, c, model.weights))
    taken: list[list[Span]] = [list(b) for b in base]
    if rows:
        p = model.probability(np.array(rows))
        chosen = [(-float(q), i, c) for q, (i, c) in zip(p, extra, strict=True) if q >= model.thresholds[c[2]]]
        by_text: dict[int, list] = {}
        for q, i, c in sorted(chosen):
            by_text.setdefault(i, []).append(c)
        for i, cs in by_text.items():
            taken[i] = _disjoint(base[i], cs)
    return list(zip(base, taken, strict=True))


def _disjoint(base: list[Span], chosen: list[Span]) -> list[Span]:
    """Base spans and, best first, the chosen ones that overlap none before them; sorted."""
    import bisect

    # base spans of different kinds may overlap each other: merge them for the test
    cover: list[list[int]] = []
    for s, e, _ in base:
        if cover and s < cover[-1][1]:
            cover[-1][1] = max(cover[-1][1], e)
        else:
            cover.append([s, e])
    out = list(base)
    for s, e, k in chosen:
        j = bisect.bisect_left(cover, [s, e])
        if (j == 0 or cover[j - 1][1] <= s) and (j == len(cover) or cover[j][0] >= e):
            cover.insert(j, [s, e])
            out.append((s, e, k))
    out.sort()
    return out


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans by the first one's."""
    if not text or not spans:
        return text
    out, at = [], 0
    for s, e, k in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, redacted) of each row's whole text.

    Counts and the digest are of the base spans, ``spans`` has all. A null or empty text has
    none; the digest is then that of an empty string, and ``redacted`` the text itself. Texts are
    read whole, whatever their length. Spans that start together are in the order of kinds; of
    overlapping candidates the more probable is taken, then the first. Repeated rows get equal
    results; an empty table gives an empty one; other columns are not read.
    """
    model = model or fit()

    def make():
        def run(cols: dict) -> dict:
            found = find(cols["text"], model)
            out = {"doc_id": cols["doc_id"]}
            for k, kind in enumerate(BASE):
                out[f"n_{kind}"] = [sum(x[2] == k for x in b) for b, _ in found]
            out["base_sha256"] = [hashlib.sha256(_joined(b).encode()).hexdigest() for b, _ in found]
            out["spans"] = [_joined(a) for _, a in found]
            out["redacted"] = [redact(t, a) for t, (_, a) in zip(cols["text"], found, strict=True)]
            return out

        return run

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_slices(rows, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string", make)


def redact_documents(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with every span in ``text`` replaced, and ``n_chars`` of the new text; all other columns as they are."""
    model = model or fit()
    names = docs.columns

    def make():
        def run(cols: dict) -> dict:
            out = {c: cols[c] for c in names}
            out["text"] = [redact(t, a) for t, (_, a) in zip(cols["text"], find(cols["text"], model), strict=True)]
            if "n_chars" in out:
                out["n_chars"] = [n if t is None else len(t) for n, t in zip(cols["n_chars"], out["text"], strict=True)]
            return out

        return run

    return map_slices(docs, docs.schema, make)
