"""Numbers in words: Bengali, Hindi and English, decimals and hundreds, as one grammar over kinds of words.

Kinds: d up to nine, t from ten to 99, h a hundred, s a word that makes hundreds of a digit
before it, g a digit, e and f English up to nine and from ten, p a point, x any other. A
capital is a word that is a unit besides.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .kinds import let, lookup, matches, words_by_value

# Units, words for a point, endings that speech recognition glues to a number, words of hundreds, halves.
UNITS = (
    "বছর", "বছরের", "মাস", "মাসের", "দিন", "দিনে", "সপ্তাহ", "ঘণ্টা", "ঘন্টা", "মিনিট", "ফোঁটা", "ফোটা", "বার", "বারে",
    "साल", "महीने", "महीना", "दिन", "हफ्ते", "हफ़्ते", "घंटे", "मिनट", "बूंद", "बार",
)
POINTS = ("দশমিক", "পয়েন্ট", "পইন্ট", "দশমলব", "दशमलव", "पॉइंट", "पॉइन्ट", "प्वाइंट", "point")
ENDINGS = ("ছে", "ের", "এর", "ে", "টা", "টি", "ও", "তে", "য", "ই", "वां", "वीं", "वें")
HUNDREDS = ("শো", "सौ")
HALVES = ((r"দেড়|দেড়|ডেড়|ডেড়|डेढ़|डेढ़|डेढ|(?i)one and a half", 1.5), (r"আড়াই|আড়াই|ढाई|(?i)two and a half", 2.5))
MOST = 30
# Parts of the day, those after noon, and hours and minutes in English.
DAY_PARTS = ("সকাল", "বিকেল", "বিকাল", "দুপুর", "সন্ধ্যা", "সন্ধে", "রাত", "सुबह", "दोपहर", "शाम", "रात")
AFTER_NOON, NOON = ("বিকেল", "বিকাল", "সন্ধ্যা", "সন্ধে", "রাত", "शाम", "रात"), ("দুপুর", "दोपहर")
MINUTES = {"thirty": "30", "fifteen": "15", "forty": "45"}

_FROM, _TO = "য়ড়ঢ়क़ख़ग़ज़ड़ढ़फ़य़", "যডঢकखगजडढफय"
_SIGNS = "ँं़ঁং়"  # nasal signs and dots below
DIGITS = "".join(chr(b + i) for b in (0x09E6, 0x0966) for i in range(10)), "0123456789" * 2
_CUT = r"[\s,।.?!;:()\"'“”‘’-]+"


def spelled(w: str) -> str:
    """Spellings with and without nasal signs and dots below are one; ``key`` of a constant."""
    return unicodedata.normalize("NFC", w.translate(dict(zip(map(ord, _FROM), _TO)))).translate(dict.fromkeys(map(ord, _SIGNS)))


def key(w: Column) -> Column:
    whole = F.replace(F.replace(w, F.lit("ো"), F.lit("ো")), F.lit("ৌ"), F.lit("ৌ"))
    return F.translate(whole, _FROM + _SIGNS, _TO)


@cache
def tables() -> tuple[dict[str, int], dict[str, int]]:
    """Values of Indic words by spelling, and of English words."""
    indic = {spelled(w): n for name in ("bn", "hi") for w, n in words_by_value(f"number_words_{name}.txt").items()}
    return indic, words_by_value("number_words_en.txt")


def _glued(k: Column, free: int | None) -> Column:
    """The number word of at least three letters that k begins with: before a known ending, or any from ``free`` letters on."""
    words = sorted((w for w in tables()[0] if len(w) >= 3), key=lambda w: (-len(w), w))
    ends = "(?:" + "|".join(sorted(map(spelled, ENDINGS), key=len, reverse=True)) + ")?$"
    some = [w for w in words if free is not None and len(w) >= free]
    rest = [w for w in words if w not in some]
    found = F.coalesce(F.nullif(F.regexp_extract(k, f"^({'|'.join(some)})", 1), F.lit("")) if some else F.lit(None).cast("string"), F.nullif(F.regexp_extract(k, f"^({'|'.join(rest)}){ends}", 1), F.lit("")))
    return lookup(tables()[0], found)


def _words(text: Column) -> Column:
    """array<struct<word, key>>."""
    cut = F.array_remove(F.split(F.coalesce(text, F.lit("")), _CUT), "")
    return F.transform(cut, lambda w: F.struct(w.alias("word"), key(w).alias("key")))


def _indic(w: Column, value: Column) -> Column:
    return F.when(w["key"].rlike(r"^[\x{0900}-\x{09FF}]"), value)


def find(text: Column) -> Column:
    """array<struct<heard, value>>: decimals, hundreds, and other Indic words from 11 or with a unit, each phrase once, the first ``MOST``."""
    english = tables()[1]
    units, points = "^(?:" + "|".join(sorted(UNITS, key=len, reverse=True)) + ")", [spelled(p) for p in POINTS]

    def valued(w: Column) -> Column:
        own = _indic(w, F.coalesce(lookup(tables()[0], w["key"]), _glued(w["key"], 5)))
        other = F.coalesce(F.when(w["word"].rlike("^[0-9]$"), w["word"].cast("int")), F.when(w["word"].rlike("^[A-Za-z]{3,9}$"), lookup(english, F.lower(w["word"]))))
        return F.struct(w["word"].alias("word"), w["key"].alias("key"), own.alias("own"), other.alias("other"))

    def letter(w: Column) -> Column:
        kind = (
            F.when(w["own"] < 10, "d").when((w["own"] == 100) & w["key"].isin(*map(spelled, HUNDREDS)), "s").when(w["own"] == 100, "h").when(w["own"].isNotNull(), "t")
            .when(w["word"].rlike("^[0-9]$"), "g").when(w["other"] < 10, "e").when(w["other"].isNotNull(), "f").when(F.lower(w["key"]).isin(*points), "p").otherwise("x")
        )
        return F.when(w["word"].rlike(units), F.upper(kind)).otherwise(kind)

    grammar = "(?i)[dtshef]p(?:f|[dge][dgef]?)|ds[dt]?|[hs][dt]?|[dt]"

    def phrase(ws: Column, letters: Column, m: Column) -> Column:
        size = F.length(m["letters"])
        mine = F.slice(ws, m["start"] + 1, size)
        at = lambda i: F.get(mine, F.lit(i))["own"]
        fraction = F.array_join(F.transform(F.slice(mine, 3, F.greatest(size - 2, F.lit(0))), lambda w: F.coalesce(w["own"], w["other"]).cast("string")), "")
        first = F.get(mine, F.lit(0))
        value = (
            F.when(m["letters"].rlike("(?i)^.p"), F.concat(F.coalesce(first["own"], first["other"]).cast("string"), F.lit("."), fraction).cast("double"))
            .when(m["letters"].rlike("(?i)^ds"), at(0) * 100 + F.coalesce(at(2), F.lit(0)))
            .when(m["letters"].rlike("(?i)^[hs]"), F.lit(100) + F.coalesce(at(1), F.lit(0)))
            .otherwise(at(0))
            .cast("double")
        )
        decimal = m["letters"].rlike("(?i)^.p")
        unit = ~decimal & F.substr(letters, m["start"] + size + 1, F.lit(1)).rlike("^[A-Z]$")
        heard = F.array_join(F.transform(mine, lambda w: w["word"]), " ")
        heard = F.when(unit, F.concat(heard, F.lit(" "), F.get(ws, m["start"] + size)["word"])).otherwise(heard)
        return F.when(decimal | unit | (value >= 11), F.struct(heard.alias("heard"), value.alias("value")))

    def of(ws: Column) -> Column:
        return let(F.array_join(F.transform(ws, letter), ""), lambda ls: F.transform(matches(ls, grammar), lambda m: phrase(ws, ls, m)))

    return F.slice(F.array_distinct(F.array_compact(let(F.transform(_words(text), valued), of))), 1, MOST)


def values(text: Column) -> Column:
    """array<double>, ascending: all that was said: digits of three scripts, number words of any size, twenty-three, one and a half."""
    text = F.coalesce(text, F.lit(""))
    english = tables()[1]
    digits = F.transform(F.regexp_extract_all(F.translate(text, *DIGITS), F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)), lambda x: x.cast("double"))
    indic = F.transform(_words(text), lambda w: _indic(w, F.coalesce(lookup(tables()[0], w["key"]), _glued(w["key"], None))).cast("double"))

    def both(ns: Column) -> Column:
        after = F.transform(ns, lambda n, i: F.when((n >= 20) & (n % 10 == 0) & F.get(ns, i + 1).between(1, 9), n + F.get(ns, i + 1)))
        return F.concat(ns, after)

    plain = let(F.transform(F.array_remove(F.split(F.lower(text), _CUT), ""), lambda w: F.when(w.rlike("^[a-z]{3,9}$"), lookup(english, w))), both)
    halves = F.array(*[F.when(text.rlike(p), F.lit(v)) for p, v in HALVES])
    said = F.transform(find(text), lambda x: x["value"])
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(digits, indic, F.transform(plain, lambda n: n.cast("double")), halves, said))))


def clock(text: Column) -> Column:
    """A time of day that was said: 10:30 or 10.30 pm; a part of the day with an hour as "11 am"; "at ten thirty" as 10:30. Empty without one."""
    english = tables()[1]
    digits = r"(?i)(?<![a-z0-9_])(?:at\s+)?([0-9]{1,2})[:.]([0-9]{2})(?:\s*([ap]m))?(?![a-z0-9_])"
    hour, minute, half = (F.regexp_extract(text, digits, i) for i in (1, 2, 3))
    plain = F.when((hour.try_cast("int") < 24) & (minute.try_cast("int") < 60), F.concat(hour, F.lit(":"), minute, F.when(half != "", F.concat(F.lit(" "), F.lower(half))).otherwise("")))

    parts = rf"({'|'.join(DAY_PARTS)})\s+(\S+?)(?:টায়|টায়|টা|টার|টে)?(?:\s+(?:বেজে|बजे))?(?=[\s,।.]|$)"
    part = F.regexp_extract(text, parts, 1)
    said = F.get(F.filter(values(F.regexp_extract(text, parts, 2)), lambda v: v.between(1, 12)), F.lit(0))
    shown = F.when(said == F.floor(said), said.cast("int").cast("string")).otherwise(said.cast("string"))
    late = part.isin(*AFTER_NOON) | (part.isin(*NOON) & (said < 6))
    spoken = F.concat(shown, F.when(late, " pm").otherwise(" am"))

    hours = [w for w, n in english.items() if 1 <= n <= 12]
    at = rf"(?i)(?<![a-z0-9_])at\s+({'|'.join(hours)})(?:\s+(thirty|fifteen|forty.?five|o'?clock))?(?![a-z0-9_])"
    named = lookup(english, F.lower(F.regexp_extract(text, at, 1)))
    rest = F.coalesce(lookup(MINUTES, F.regexp_extract(F.lower(F.regexp_extract(text, at, 2)), "^(thirty|fifteen|forty)", 1)), F.lit("00"))
    return F.coalesce(plain, spoken, F.concat(named.cast("string"), F.lit(":"), rest), F.lit(""))
