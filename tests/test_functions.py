"""Pure functions and column expressions against plain Python."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiloom.functions import denials, intervals, numbers, scans, text
from lexiloom.functions.kinds import words_by_value
from lexiloom.functions.scripts import transliterate
from lexiloom.operators import rules
from lexiloom.plans import fixtures


def test_normalize_keeps_notation():
    assert text.normalize_text("VA 6/36, IOP 16.5 mmHg; C:D 0.7") == "va 6/36 iop 16.5 mmhg c:d 0.7"


def test_transliteration():
    for native, roman in fixtures.NATIVE_WORDS:
        assert transliterate(native) == roman


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_normalize_is_idempotent(s):
    once = text.normalize_text(s)
    assert text.normalize_text(once) == once


def test_ascii_column_is_the_python_function(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choice("aB1.2/:% <>+'-\n") for _ in range(rng.randint(0, 30))),) for _ in range(400)]
    got = spark.createDataFrame(rows, "s string").select("s", text.normalize_ascii(F.col("s")).alias("a"), text.normalize(F.col("s")).alias("n"), text.normalize_native(F.col("s")).alias("v")).collect()
    for r in got:
        assert r.a == text.normalize_text(r.s) == r.n, repr(r.s)
        assert r.v == text.normalize_native_text(r.s), repr(r.s)


def test_native_digits():
    assert text.normalize_native_text("৬/৬ ও १.५० — ঠিক।") == "6/6 ও 1.50 ঠিক"


def test_phonetic_keys_meet(spark):
    pairs = [("moksiphloksasin", "moxifloxacin"), ("chokh", "chok"), ("aankh", "ankh")]
    got = spark.createDataFrame(pairs, "a string, b string").select(text.phonetic_key(F.col("a")).alias("a"), text.phonetic_key(F.col("b")).alias("b")).collect()
    assert [scans.edit_distance(r.a, r.b) for r in got] == [1, 0, 0]


def test_aliases(spark):
    d = spark.createDataFrame([("Motiyabind (H) / cataract, k/c/o lens; opacity or cloud",)], "c string").select(text.split_aliases(F.col("c")).alias("a")).first()
    assert d.a == ["Motiyabind", "cataract", "k/c/o lens", "opacity", "cloud"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=8), st.lists(st.sampled_from("abc"), max_size=8))
def test_alignment_is_minimal(a, b):
    al = scans.align(a, b)
    assert [x[1] for x in al if x[1] is not None] == a
    assert [x[2] for x in al if x[2] is not None] == b
    changes = sum(op != "ok" for op, _, _ in al)
    assert changes == scans.edit_distance(a, b) == scans.edit_distance(b, a)
    assert (changes == 0) == (a == b)


def test_large_alignments_are_halved(monkeypatch):
    rng = random.Random(3)
    for n in (0, 1, 7, 40):
        a, b = [rng.choice("abc") for _ in range(n)], [rng.choice("abc") for _ in range(rng.randint(0, 40))]
        whole = scans.align(a, b)
        for cells in (1, 5, 60):
            monkeypatch.setattr(scans, "ALIGN_CELLS", cells)
            assert scans.align(a, b) == whole
        monkeypatch.undo()


def test_edit_distance_in_bands(spark):
    rng = random.Random(4)
    rows = [("x" * 3 + "".join(rng.choice("ab") for _ in range(rng.randint(0, 200))), "".join(rng.choice("ab") for _ in range(rng.randint(0, 200)))) for _ in range(60)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", text.edit_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(r.d == scans.edit_distance(list(r.a), list(r.b)) for r in got)


def test_one_word_in_five():
    al = scans.align("the red kite flew home".split(), "the red bite flew home".split())
    assert sum(op != "ok" for op, _, _ in al) / 5 == 0.2


def _loops(toks):
    if len(toks) < 8:
        return 0
    hit = [False] * len(toks)
    for n in range(1, 7):
        need, i = (4 if n == 1 else 3), 0
        while i + n * need <= len(toks):
            reps = 1
            while i + (reps + 1) * n <= len(toks) and toks[i + reps * n : i + (reps + 1) * n] == toks[i : i + n]:
                reps += 1
            if reps >= need:
                hit[i + n : i + reps * n] = [True] * ((reps - 1) * n)
                i += reps * n
            else:
                i += 1
    return sum(hit)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=30))
def test_loops(toks):
    assert scans.looped_words(toks) == _loops(toks)


def _of(spark, f, *lines):
    """f of each line."""
    got = spark.createDataFrame(list(enumerate(lines)), "i int, line string").select("i", f(F.col("line")).alias("x")).orderBy("i").collect()
    return [r.x for r in got]


def test_every_number_word_to_99(spark):
    for name, unit in (("bn", "বছর"), ("hi", "साल")):
        table = words_by_value(f"number_words_{name}.txt")
        assert set(range(100)) <= set(table.values())
        said = list(table.items())
        found = _of(spark, numbers.find, *[f"বয়স {w} {unit} হল" for w, _ in said])
        assert [[(x.heard, x.value) for x in f] for f in found] == [[(f"{w} {unit}", float(n))] for w, n in said]
        assert _of(spark, numbers.values, *[w for w, _ in said]) == [[float(n)] for _, n in said]


def test_numbers(spark):
    lines = ("বয়স আটান্ন বছর", "বিশেষ তিনি", "একশো আটান্ন", "তিন শো পঁয়ষট্টি", "zero point four", "शून्य दशमलव चार पांच छह", "আটান্নছে", "এক দুই", "দশ দিন, দশ দিন", "ওয়ান পয়েন্ট ফাইভ অ্যাড", None)
    found = [[(x.heard, x.value) for x in f] for f in _of(spark, numbers.find, *lines)]
    assert found == [
        [("আটান্ন বছর", 58.0)], [], [("একশো আটান্ন", 158.0)], [("তিন শো পঁয়ষট্টি", 365.0)], [("zero point four", 0.4)], [("शून्य दशमलव चार पांच", 0.45)], [("আটান্নছে", 58.0)],
        [], [("দশ দিন", 10.0)], [("ওয়ান পয়েন্ট ফাইভ", 1.5)], [],
    ]
    assert _of(spark, numbers.values, "twenty three and one and a half", "১৮ আর ষোলোয় आधा", None) == [[1.0, 1.5, 3.0, 20.0, 23.0], [16.0, 18.0], []]


def test_clock(spark):
    lines = ("at 10:30", "10.45 PM now", "25:10", "সকাল এগারোটায় মাপা", "দুপুর তিনটায়", "रात नौ बजे", "at ten thirty", "at four", "দুপুর বারোটায়", "no time", "বিকেল ৫টায়")
    assert _of(spark, numbers.clock, *lines) == ["10:30", "10:45 pm", "", "11 am", "3 pm", "9 pm", "10:30", "4:00", "12 am", "", "5 pm"]


def test_denials(spark):
    lines = ("no vomiting or fever but pain", "दिखाई नहीं देता", "সুগার প্রেশার নেই", "ছয় বাই নয়", "জ্বর নয়, কাশি নেই", "I don't have any pain now today", "can't no see", "without but", "शुगर नहीं। बीपी नहीं था", None)
    got = _of(spark, denials.find, *lines)
    assert [[x.phrase for x in g] for g in got] == [["vomiting or fever"], [], ["সুগার প্রেশার"], [], ["জ্বর", "কাশি"], ["any pain now"], [], [], ["शुगर", "बीपी"], []]
    assert all(line[x.start : x.end].split() == x.phrase.split() for line, g in zip(lines, got) for x in g)


def test_systemic_answers(spark):
    lines = (
        "সুগার আছে", "সুগার প্রেশার নেই", "সুগার, প্রেশার বা থাইরয়েড আছে?\nসুগার আছে", "eye pressure 18", "I am diabetic", "sugar?", "sugar problem", "no sugar\nsugar for five years", "শুগার নাই", "nothing",
        "has sugar since long\nno sugar",
    )
    got = [(x.answer, x.conflict) for x in _of(spark, lambda c: rules.systemic_answer(c, rules.SYSTEMIC[0][2]), *lines)]
    assert got == [("yes", False), ("no", False), ("yes", False), ("none", False), ("yes", False), ("asked", False), (None, False), ("yes", True), ("no", False), ("none", False), ("no", True)]
    got = [x.answer for x in _of(spark, lambda c: rules.systemic_answer(c, rules.SYSTEMIC[1][2]), *lines)]
    assert got == ["none", "no", "asked", "none", "none", "none", "none", "none", "none", "none", "none"]


def test_json():
    assert scans.repair_json('{"a": [{"b": 1}, {"c": "cut') == '{"a": [{"b": 1}]}'
    assert scans.parse_loose('```json\n{"a": 1}\n```') == '{"a": 1}'
    assert scans.parse_loose("nothing here") is None


def test_compact_records():
    record = {"a": " x ", "b": "", "c": [{"d": None, "kb_id": "K1"}, {}], "e": {"f": []}}
    assert scans.compacted(record) == {"a": "x", "c": [{"kb_id": "K1"}]}
    assert scans.compacted(record, frozenset(("kb_id",))) == {"c": [{"kb_id": "K1"}]}


def _cut(text, spans):
    out, at = "", 0
    for a, b in sorted(x for x in spans if x[0] < x[1]):
        if a >= at:
            out, at = out + text[at:a] + " ", b
    return out + text[at:]


def test_spans_of_a_row(spark):
    rng = random.Random(7)
    draw = lambda: [(a, a + rng.randint(0, 6)) for a in (rng.randint(0, 24) for _ in range(rng.randint(0, 5)))]
    rows = [(i, "abcdefghijklmnopqrstuvwxyz0123", draw(), draw()) for i in range(120)]
    kind = "array<struct<start:int,end:int>>"
    d = spark.createDataFrame(rows, f"i int, t string, a {kind}, b {kind}")
    got = d.select("i", intervals.cut_out(F.col("t"), F.col("a")).alias("cut"), intervals.merged(F.col("a")).alias("m"), intervals.subtracted(F.col("a"), F.col("b"), F.length("t")).alias("s")).collect()
    places = lambda spans: {p for a, b in spans for p in range(a, b)}
    for r in got:
        _, t, a, b = rows[r.i]
        assert r.cut == _cut(t, a)
        assert places(r.m) == places(a) and all(x.end < y.start for x, y in zip(r.m, r.m[1:]))
        assert places(r.s) == places(a) - places(b)
