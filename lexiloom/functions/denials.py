"""What is denied, in Bengali, Hindi, romanised and English words, by a table of negators over kinds of words.

Being unable to is no denial, and the word for nine that is also a negator is none beside what is counted.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .kinds import let, matches
from .numbers import key, spelled

# Words by kind.
KINDS = {
    "b": "নেই নাই নেইতো",
    "n": "নয়",
    "h": "नहीं नही नहीँ",
    "r": "nahi nahin nai nei",
    "e": "no without denies deny denied never negative",
    "m": "don't dont doesn't doesnt haven't havent hasn't hasnt didn't didnt",
    "v": "have has had get feel",
    "c": "can't cant cannot unable couldn't couldnt",
    "s": "but however except",
    "i": "पा पाता पाती पाते पाया दिख दिखता दिखती दिखाई देख देता देती सक सकता सकती सकते हो",
    "y": "है हैं था थी थे हुआ हुई",
    "w": "বাই পয়েন্ট দশমিক",
    "q": "by এন n ছয় ছ",
    "a": "মাস মাসের বছর বছরের দিন দিনের সপ্তাহ ঘণ্টা ঘন্টা মিনিট টা টি বার মিলিমিটার সেকেন্ড",
}


class Negator(NamedTuple):
    """A kind of word with what must or mustn't stand beside it, and the words that it denies: an expression over kinds, beside it."""

    sign: str
    before: bool
    denied: str


# A blank is a gap between two words, a bar the end of a clause; s ends what an English word denies.
NEGATORS = {
    "b": Negator("b", True, "(?:[a-z] ?){0,3}"),
    "n": Negator("(?<![qw] )n(?! [aw])", True, "(?:[a-z] ?){0,3}"),
    "h": Negator(r"(?<!i )h(?= y| ?(?:[|]|$))", True, "(?:[a-z] ?){0,3}"),
    "r": Negator("r", True, "(?:[a-z] ?){0,3}"),
    "e": Negator("(?<!c )e", False, "((?: [a-rt-z]){0,4})"),
    "m": Negator("m(?= v)", False, "[ ]v((?: [a-z]){0,3})"),
}
_END, _GAP = "।॥?!.,;:\\n", "\"'“”‘()"
_PIECES = rf"[{_END}]+|[^\s{_END}{_GAP}]+(?:['’][^\s{_END}\"“”‘()]+)?|(?:[^\S\n]|[{_GAP}])+"


def find(text: Column) -> Column:
    """array<struct<phrase, start, end, negator>> in the text's own characters, end exclusive; overlapping ones are kept."""
    table = {spelled(w): k for k, ws in KINDS.items() for w in ws.split()}

    def letter(p: Column) -> Column:
        w = F.lower(F.replace(key(p), F.lit("’"), F.lit("'")))
        kinds = [F.when(w.isin(*[x for x, of in table.items() if of == k]), k) for k in KINDS]
        return F.coalesce(F.when(p.rlike(rf"^[{_END}]"), "|"), F.when(p.rlike(rf"^[\s{_GAP}]"), " "), *kinds, F.when(w.rlike("^[0-9]+/?$"), "q"), F.lit("x"))

    def denied(ps: Column, letters: Column, m: Column) -> Column:
        left, right = F.left(letters, m["start"]), F.substr(letters, m["start"] + 2, F.length(letters))
        window, lead = F.lit(""), F.lit(0)
        for k, n in NEGATORS.items():
            mine = F.regexp_extract(left, f"({n.denied})$", 1) if n.before else F.regexp_extract(right, f"^{n.denied}", 1)
            window = F.when(m["letters"] == k, mine).otherwise(window)
            lead = F.when(m["letters"] == k, F.lit(2 if k == "m" else 0)).otherwise(lead)
        before = m["letters"].isin(*[k for k, n in NEGATORS.items() if n.before])

        def span(w: Column) -> Column:
            first = F.when(before, m["start"] - F.length(w)).otherwise(m["start"] + 1 + lead + F.length(w) - F.length(F.ltrim(w)))
            part = F.slice(ps, first + 1, F.length(F.trim(w)))
            start = F.length(F.array_join(F.slice(ps, 1, first), ""))
            phrase = F.array_join(F.filter(part, lambda _, i: i % 2 == 0), " ")
            end = start + F.length(F.array_join(part, ""))
            return F.when(F.trim(w) != "", F.struct(phrase.alias("phrase"), start.alias("start"), end.alias("end"), F.get(ps, m["start"]).alias("negator")))

        return let(window, span)

    def of(ps: Column) -> Column:
        signs = "|".join(n.sign for n in NEGATORS.values())
        return let(F.array_join(F.transform(ps, letter), ""), lambda ls: F.transform(matches(ls, signs), lambda m: denied(ps, ls, m)))

    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_PIECES), F.lit(0))
    return F.array_compact(let(pieces, of))
