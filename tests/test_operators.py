"""Operators against brute force, plans without nested loops, and queries against SQL."""

import json
import random
from pathlib import Path

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lexiloom.functions import scans, text
from lexiloom.operators import matching, quality, rules, spans, term_graph
from lexiloom.plans import analyze, catalog, fixtures, tables
from lexiloom.sources import files, models

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 8), st.integers(1, 4)), max_size=12))
def test_longest_wins_is_brute_force(spark, raw):
    rows = [(k, s, s + n, i) for i, (k, s, n) in enumerate(raw)]
    got = {tuple(r) for r in spans.longest_wins(spark.createDataFrame(rows, "id int, start int, end int, ord int"), ["id"]).collect()}
    inside = lambda a, b: a[0] == b[0] and b[1] <= a[1] and a[2] <= b[2] and ((b[2] - b[1]) > (a[2] - a[1]) or b[3] < a[3])
    assert got == {a for a in rows if not any(inside(a, b) for b in rows)}


def test_fuzzy_equals_brute_force_without_nested_loops(spark):
    names = ["latanoprost", "latano prost", "moxifloxacin", "ofloxacin", "brimonidine", "brimonadin", "timolol", "travoprost"]
    heard = spark.createDataFrame([(n, n.replace(" ", ""), len(n.split())) for n in names], "span string, s string, n_toks int")
    known = heard.selectExpr("span as form", "s as joined", "n_toks", "true as is_name")
    d = matching.fuzzy_pairs(heard, known)
    assert ("brimonadin", "brimonidine") in {(r.h_span, r.form) for r in d.collect()}
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def _within(a, b, most):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1] if row[-1] <= most else 99


def test_fuzzy_pairs_are_those_of_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    parts = "ka tor mi ph ex lo pro st in ol ver qu zi cho ra ne oo th w y".split()

    def misheard(s):
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(s) + 1)
            s = s[:i] + rng.choice(("", "a", "k", "e")) + s[i + rng.randint(0, 1) :]
        return s

    forms = [(f"f{i}", w, rng.choice((1, 1, 2)), rng.random() < 0.7) for i, w in enumerate(sorted({"".join(rng.choices(parts, k=rng.randint(2, 9))) for _ in range(220)}))]
    said = sorted({misheard(w) for _, w, _, _ in forms for _ in range(3)} - {""})
    said = [(w, w, rng.choice((1, 1, 2)), rng.random() < 0.4) for w in said]
    h, k = spark.createDataFrame(said, "span string, s string, n_toks int, loose boolean"), spark.createDataFrame(forms, "form string, joined string, n_toks int, is_name boolean")
    keys = lambda c: {r[0]: tuple(r[1:]) for r in c.collect()}
    strict, free = text.phonetic_key(F.col("s")), text.phonetic_key(F.col("s"), True)
    of_h = keys(h.withColumn("k", F.when(F.col("loose"), free).otherwise(strict)).select("s", "k", text.skeleton(F.col("k"))))
    of_k = keys(k.withColumnRenamed("joined", "s").withColumn("k", strict).select("s", "k", free, text.skeleton(F.col("k"))))
    want = {}
    for form, j, jn, name in forms:
        sound, loose_sound, bones = of_k[j]
        most = 3 if len(j) >= 12 else 2 if len(j) >= 8 else 1
        for _, a, an, loose in said:
            hk, hs = of_h[a]
            able = len(j) >= (6 if name or jn > 1 else 7) and abs(len(a) - len(j)) <= most + 2 and max(1, jn - 1) <= an <= min(5, jn + 2)
            if able and (a[:1] == j[:1] or hk[:1] == sound[:1] or (len(j) >= 9 and a[-3:] == j[-3:])):
                d = min(_within(a, j, 3), _within(hk, loose_sound if loose else sound, 3))
                rescued = d > most and len(bones) >= 7 and _within(hs, bones, 2) <= (2 if len(bones) >= 12 else 1)
                if rescued or d <= most:
                    want[a, form, loose] = (most if rescued else d, rescued)
    assert len(want) > 300 and any(x[1] for x in want.values())
    for most in (matching.BROADCAST_FORMS, 0):  # broadcast, and shuffled by key
        monkeypatch.setattr(matching, "BROADCAST_FORMS", most)
        assert {(r.h_span, r.form, r.loose): (r.d, r.rescued) for r in matching.fuzzy_pairs(h, k).collect()} == want


VOCABULARY = "id string, category string, name string, aliases array<string>, brands array<string>, generic string, ord int"


def test_generics_at_the_end_of_chains(spark):
    rng = random.Random(11)
    n = 120
    up = {i: rng.choice([None, rng.randrange(n), i + 1 if i + 1 < n else None]) for i in range(n)}
    rows = [(f"T{i}", "medicine", f"medicine number {i}", [f"alias{i}"], [], f"Alias{up[i]}" if up[i] is not None else None, i) for i in range(n)]
    v = spark.createDataFrame(rows, VOCABULARY)

    def end(i):
        seen = [i]
        while (j := up[seen[-1]]) is not None and j != seen[-1]:
            if j in seen:
                return min(seen[seen.index(j) :])
            seen.append(j)
        return seen[-1]

    got = {r.id: r.standing for r in term_graph.generics(v, term_graph.surfaces(v), rules.checkpointed).collect()}
    assert got == {f"T{i}": f"T{end(i)}" for i in range(n)}


def test_names_brands_and_unstated_types(spark):
    rows = [
        ("M1", "medicine", "Moxifloxacin", ["moxi"], ["Vigamox"], None, 0), ("M2", "medicine", "Timolol maleate", [], ["Glucomol"], None, 1), ("M3", "medicine", "Moxicip", [], [], "moxi", 2),
        ("D1", "disease", "Glaucoma suspect", [], [], None, 3), ("D2", "disease", "Dry eye", [], [], None, 4),
    ]
    v = spark.createDataFrame(rows, VOCABULARY)
    names = term_graph.surfaces(v, "brands")
    said = [
        (0, "medications", "M1", "x", "", ["medicine"]), (1, "medications", "D2", "Moxi", "", ["medicine"]), (2, "medications", "", "Timolol", "", ["medicine"]), (3, "medications", None, "", "VIGAMOX", ["medicine"]),
        (4, "medications", "", "moxifloxasin", None, ["medicine"]), (5, "medications", "", "Moxicip", "", ["medicine"]), (6, "diagnosis", "", "Glaucoma", "", ["disease"]), (7, "diagnosis", "", "dry eye", "", ["disease"]), (8, "medications", "", "water", "", ["medicine"]),
    ]
    items = spark.createDataFrame(said, "n int, section string, kb_id string, name string, brand string, categories array<string>")
    near = term_graph.near_names(items, names)
    d = term_graph.resolve(items, names, term_graph.generics(v, names, rules.checkpointed), near)
    got = {r.n: (r.term, r.how) for r in d.collect()}
    assert got == {0: ("M1", "id"), 1: ("M1", "name"), 2: ("M2", "head"), 3: ("M1", "brand name"), 4: ("M1", "near"), 5: ("M1", "name"), 6: ("D1", "head"), 7: ("D2", "name"), 8: (None, None)}
    got = {r.n: (r.term, r.unstated) for r in term_graph.sub_type_unstated(d, names, "glaucoma").collect()}
    assert got[6] == (None, True) and got[7] == ("D2", False)


def test_a_brand_is_heard_by_its_generic(spark):
    terms = spark.createDataFrame([("M1", "medicine", "Moxifloxacin", [], [], None), ("M2", "medicine", "Vigamox", [], [], "moxifloxacin"), ("M3", "medicine", "Zymar", [], [], "gatifloxacin")], "id string, category string, name string, aliases array<string>, colloquial array<string>, generic string")
    items = spark.createDataFrame([("v", "medications", i, k, n, "", "", {}) for i, (k, n) in enumerate((("M2", "Vigamox"), ("M3", "Zymar")))], "visit string, section string, idx int, kb_id string, name string, eye string, evidence string, attrs map<string,string>")
    d = rules.Draft(items, spark.createDataFrame([("v", "use moxifloxacin twice")], "visit string, text string"), rules.checkpointed, terms)
    rules.k1_medicines_heard(d)
    assert [r.name for r in d.items.where("alive").collect()] == ["Vigamox"]


def test_loop_and_tiers(spark):
    d = spark.createDataFrame([(["x"] * 60, 0.8), (["a", "b"] * 5, 0.3)], "t array<string>, s double")
    r = d.select(quality.unigram_loop(d.t).alias("n"), quality.tier_of(d.s).alias("t")).collect()
    assert [(x.n, x.t) for x in r] == [(59, "high"), (0, "unusable")]


def test_rules(spark):
    items, audit = rules.post_process(*fixtures.draft(spark))
    names = {(r.section, r.name) for r in items.collect()}
    told = {r.rule for r in audit.collect()}
    assert ("medications", "Prednisolone") not in names
    assert ("medications", "Moxifloxacin") in names
    assert not any(s == "chief_complaints" and n == "Fever" for s, n in names)
    assert ("diagnosis", "Cataract (type not specified)") in names
    assert any(s == "follow_up" for s, _ in names)
    assert sum(s == "chief_complaints" and n.lower() == "redness" for s, n in names) == 1
    assert {"k1", "k2", "k3", "k5", "k7", "k12", "k15", "k16", "k17", "k18", "k21", "k25"} <= told


def _terms(spark):
    rows = [
        ("MED-001", "medicine", "Moxifloxacin 0.5%", ["Moxi", "moxifloxacin"], ["laal chokh er drop"]),
        ("MED-002", "medicine", "Timolol", ["timo"], []),
        ("SYS-001", "systemic", "Diabetes mellitus", ["sugar"], []),
        ("PRO-001", "procedure", "Yag capsulotomy", ["yag laser"], []),
        ("PRO-002", "procedure", "Trabeculectomy", [], []),
        ("SYM-001", "symptom", "Watering", ["tearing", "epiphora"], []),
        ("SYM-002", "symptom", "Itching", ["itchy eye"], []),
        ("COU-001", "counselling", "Wash hands often", [], ["হাত ধোবেন"]),
    ]
    return spark.createDataFrame([(*r, {}) for r in rows], "id string, category string, name string, aliases array<string>, colloquial array<string>, details map<string,string>")


def test_rules_look_things_up(spark):
    heard = "Patient: my eye is tearing but not itchy. No itchy eye.\nDoctor: any watering? yag laser is advised for the left eye and we will talk about the date. The trabeculectomy was done last year. Use moxi and timolol."
    rows = [
        ("v1", "medications", 0, "", "moxifloxacin", "RE", "", {}),
        ("v1", "medications", 1, "MED-002", "MED-002", "RE", "", {}),
        ("v1", "medications", 2, "", "Prednisolone", "RE", "", {}),
        ("v1", "history.current_medications", 0, "", "sugar", "", "", {}),
        ("v1", "history.current_medications", 1, "", "Metformin", "", "", {}),
        ("v1", "advice", 0, "", "হাত ধোবেন", "", "wash", {}),
    ]
    items = spark.createDataFrame(rows, "visit string, section string, idx int, kb_id string, name string, eye string, evidence string, attrs map<string,string>")
    visits = spark.createDataFrame([("v1", heard)], "visit string, text string")
    seen = {}
    for rule in (rules.k1_medicines_heard, rules.k6_procedure_fallback, rules.k8_current_medicines, rules.k9_medicine_ids, rules.k22_advice, rules.k23_symptoms):
        d = rules.Draft(items, visits, lambda x: x, _terms(spark))
        rule(d)
        seen[rule] = {(r.section, r.kb_id, r.name) for r in d.items.where("alive").collect()}
    assert {n for s, _, n in seen[rules.k1_medicines_heard] if s == "medications"} == {"moxifloxacin", "MED-002"}
    assert ("medications", "MED-001", "moxifloxacin") in seen[rules.k1_medicines_heard]
    assert {x for x in seen[rules.k6_procedure_fallback] if x[0] == "procedures"} == {("procedures", "PRO-001", "Yag capsulotomy")}
    assert {n for s, _, n in seen[rules.k8_current_medicines] if s == "history.current_medications"} == {"Metformin"}
    assert ("medications", "MED-002", "timo") in seen[rules.k9_medicine_ids]
    assert ("advice", "", "Wash hands often") in seen[rules.k22_advice]
    assert {x for x in seen[rules.k23_symptoms] if x[0] == "chief_complaints"} == {("chief_complaints", "SYM-001", "Watering")}
    plan = d.items._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_pressures_in_three_languages(spark):
    rows = [
        ("eye pressure is right eye 18 and left eye 20 today", (18, 20)),
        ("চোখের প্রেশার ডান চোখে ১৬, বাম চোখে আঠারো", (16, 18)),
        ("प्रेशर दाहिनी आँख में १७ और बाईं आँख में बारह है", (17, 12)),
        ("pressure right 18 " + "and so on " * 8 + "left 20", None),
        ("pressure right 90 left 20", None),
        ("the right 18 and left 20", None),
    ]
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    got = {r.i: r.x and (r.x.RE, r.x.LE) for r in d.select("i", rules.eye_pressures(d.t).alias("x")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(rows)}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab -চল.", max_size=14), max_size=5), st.lists(st.text(alphabet="ab -চল", min_size=1, max_size=4), max_size=4))
def test_lexicon_hits_are_brute_force(spark, texts, phrases):
    import re

    d = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    lex = spark.createDataFrame([(f"e{i}", p) for i, p in enumerate(phrases)], "entry string, phrase string")
    got = {(r.id, r.entry, r.start, r.end) for r in spans.lexicon_hits(d, lex).collect()}
    want = set()
    for k, p in enumerate(phrases):
        p = " ".join(re.sub(r"[\s-]+", " ", p).split(" ")).strip(" ")
        if not re.search(r"\w", p) or not p:
            continue
        body = re.escape(p).replace(r"\ ", r"[\s-]").replace(" ", r"[\s-]")
        indic = re.search("[ঀ-৿]", p)
        pattern = body if indic else rf"(?<![^\W_]){body}(?![^\W_])"
        want |= {(i, f"e{k}", m.start(), m.end()) for i, t in enumerate(texts) for m in re.finditer(pattern, t)}
    assert got == want


def test_analysis(spark):
    got = analyze.analyze(fixtures.visits(spark), fixtures.terms(spark), tables.table(spark, tables.KEYWORDS, "category, key, form"), {"en": tables.FUNCTION_WORDS["en"]})
    tiers = {r.id: r.tier for r in got.quality.collect()}
    assert tiers["v1"] == "high" and tiers["v2"] == "unusable"
    found = {(r.id, r.term): r.kind for r in got.candidates.collect()}
    assert found["v1", "SYM-001"] == "exact" and ("v1", "MED-001") in found and ("v2", "MED-001") not in found
    assert {r.phrase for r in got.negations.where("id = 'v1'").collect()} == {"epiphora now and the"}


def test_analysis_with_a_lexicon(spark):
    """Lexicon phrases bring terms in, not from denials, and take false friends out."""
    rows = [("e1", "moxi floxacin", "MED-001", []), ("e2", "watering", "", ["SYM-001"]), ("e3", "the right eye", "EYE-001", []), ("e4", "epiphora", "SYM-009", [])]
    lexicon = spark.createDataFrame(rows, "entry string, phrase string, term string, block array<string>")
    got = analyze.analyze(fixtures.visits(spark).where("visit = 'v1'"), fixtures.terms(spark), tables.table(spark, tables.KEYWORDS, "category, key, form"), {"en": tables.FUNCTION_WORDS["en"]}, lexicon=lexicon)
    found = {r.term: (r.kind, r.score) for r in got.matches.collect()}
    assert found["EYE-001"] == ("lexicon", 0.95) and found["MED-001"][1] >= 0.95
    assert "SYM-001" not in found and "SYM-009" not in found


def test_recorded_models(spark):
    tokens = tables.table(spark, fixtures.TOKENS, "id, pos, text, p").selectExpr("id", "cast(pos as int) as pos", "text", "cast(p as double) as p")
    words = files.words_of_tokens(tokens).orderBy("word_id").collect()
    assert [(w.w, w.p) for w in words] == [("hello", 0.8), ("world", 0.7)]
    rows = models.coerce(models.ask(tables.table(spark, fixtures.PROMPTS, "visit, prompt"), "mock")).collect()
    assert {(r.visit, r.section) for r in rows} >= {("v1", "chief_complaints"), ("v2", "diagnosis")}
    with pytest.raises(ValueError):
        models.ask(spark.createDataFrame([("a", "b")], "visit string, prompt string"), "none such")


def test_queries_without_sql_over_the_given_tables(spark):
    """What no SQL says the same: against other ways to the same rows, over whole tables."""
    turns = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{SF}/conversations.parquet").collect() if r.text is not None}
    q = lambda name: catalog.QUERIES[name](spark, SF).collect()
    for r in q("align_words"):
        ref, hyp = (text.normalize_native_text(turns[r.conv_id, k]).split() for k in (r.turn, r.turn + 1))
        assert [x.ref for x in r.al if x.ref is not None] == ref and [x.hyp for x in r.al if x.hyp is not None] == hyp
        assert sum(x.op != "ok" for x in r.al) == scans.edit_distance(ref, hyp)
    words = {}
    for r in sorted(q("recorded_words"), key=lambda r: (r.id, r.word_id)):
        words.setdefault(r.id, []).append(r.w)
    assert words == {f"{c}:{t}": x.split() for (c, t), x in turns.items() if x.split()}
    answers = {r.visit: r for r in q("repair_json")}
    assert len(answers) == len(turns)
    for (c, t), x in turns.items():
        got = json.loads(answers[f"{c}:{t}"].json)
        if (c + t) % 4 < 3:  # the answer was whole
            assert got["advice"] == [x] and [y["name"] for y in got["diagnosis"]] == x.split(" ")[:8]
        else:
            assert set(got) <= {"diagnosis", "advice"}
    assert all(r.roman and r.roman.isascii() for r in q("transliterate_indic"))


def test_analysis_of_all_conversations(spark):
    a = catalog.analysis(spark, SF)
    quality = {r.id: r.tier for r in a.quality.collect()}
    turns = spark.read.parquet(f"{SF}/conversations.parquet").where("text is not null")
    assert set(quality) == {r.conv_id for r in turns.select("conv_id").distinct().collect()}
    matches = a.matches.where("kind = 'exact' and category is not null").select("id", "term", "heard").collect()
    said = {r.visit: text.normalize_text(r.text) for r in catalog.speech_queries.conversations_in_three_languages(spark, SF).collect()}
    assert matches and not any(r.id % 2 == 0 and r.heard not in said[r.id] for r in matches)  # a term that is only denied is none
    assert any(r.id % 2 for r in matches)


def test_services_over_http(spark):
    """Recorded answers of a local server: a chat in lines, a speech service, and a failure that a row tells."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            if self.path == "/chat":
                said = json.loads(body)["messages"][0]["content"]
                parts = ['{"message":{"content":"{\\"diagnosis\\": [\\""}}', json.dumps({"choices": [{"delta": {"content": said}}]}), 'data: {"choices":[{"delta":{"content":"\\"]}"},"finish_reason":"stop"}]}', "data: [DONE]"]
                out = "\n".join(parts).encode()
            elif self.path == "/speech":
                out = json.dumps({"text": f" {len(body)} bytes ", "segments": [{"text": "abcd", "avg_logprob": 0.0}, {"text": "ab", "avg_logprob": -2.0}]}).encode()
            else:
                self.send_error(503)
                return
            self.send_response(200)
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    try:
        models.register_llm("local", models.http_chat(f"{url}/chat", "m"))
        models.register_llm("down", models.http_chat(f"{url}/none", "m"))
        prompts = spark.createDataFrame([("v1", "dry eye")], "visit string, prompt string")
        assert models.ask(prompts, "local").first().json == '{"diagnosis": ["dry eye"]}'
        assert "503" in models.ask(prompts, "down").first().error
        models.register_asr("local", models.http_speech(f"{url}/speech"))
        audio = spark.createDataFrame([("v1", bytearray(32_044))], "visit string, content binary")
        r = models.transcribe(audio, "local").first()
        assert r.text == "32044 bytes" and r.seconds == 1.0 and abs(r.low_ratio - 1 / 3) < 1e-9 and 0.6 < r.confidence < 0.8
    finally:
        server.shutdown()
    assert models.pick_model(["b:7", "a:1"], "b") == "b:7" and models.pick_model(["b:7", "a:1"], order=("c", "a")) == "a:1"
    with pytest.raises(ValueError):
        models.pick_model(["a"], "z")


def test_files(spark, tmp_path: Path):
    (tmp_path / "a.csv").write_text('id,Name,Also,Dose\nM1,Moxifloxacin 0.5%,"MFX, moxi eye drops (H)",4x\n,No id,,\n')
    t = files.read_sheet(spark, str(tmp_path / "a.csv"), files.SheetSpec("medicine", "Name", ("Also",))).collect()
    assert len(t) == 1 and "MFX" in t[0].aliases and t[0].details == {"Dose": "4x"}
    refs = spark.createDataFrame([("x/a.wav",), ("x/a.txt",), ("x/a.ref.txt",)], "path string")
    got = {r.path: r.reference for r in files.find_references(refs).collect()}
    assert got["x/a.wav"] == "x/a.ref.txt"
    assert files.Settings.load({"APP_ENV": "production", "PROD_LLM": "a", "LLM": "b", "MAX_CANDIDATES": "5"}) == files.Settings(llm="a", max_candidates=5)


def _value(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(_value, v))
    return v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(catalog.ORACLES[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    key = lambda r: repr(r)
    assert sorted((tuple(_value(r[c]) for c in cols) for r in df.collect()), key=key) == sorted((tuple(_value(r[i]) for i in at) for r in want.fetchall()), key=key)


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "term", "norm", "n"]
