"""Joins whose sides grow with the tables are shuffled, whatever Spark guesses of them; and results that larger tables brought to light."""

from pyspark.sql import functions as F

from lexiloom.functions import text as X


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_null_text_does_not_loop_and_signs_are_letters(spark):
    loop = "ab\\Ecd.*[x]( " * 200
    rows = [(1, None), (2, loop), (3, " ".join(map(str, range(900)))), (4, "short")]
    got = {r.id: r.l for r in spark.createDataFrame(rows, "id int, t string").select("id", X.is_looping(F.col("t")).alias("l")).collect()}
    assert got == {1: None, 2: True, 3: False, 4: False}


def test_a_span_is_inside_another_by_letters(spark):
    from lexiloom.operators import matching

    rows = [(1, "the cat sat here", 4.0, "fuzzy"), (1, "he cat sa", 3.0, "fuzzy"), (1, "cat sat", 2.0, "fuzzy"), (1, "t sa", 2.0, "fuzzy"), (1, "er", 1.0, "fuzzy"), (1, "a", 1.0, "fuzzy"), (1, "e", 9.0, "fuzzy"),
            (1, "cat sit", 2.0, "fuzzy"), (1, "he cat", 2.0, "exact"), (1, "", 1.0, "overlap"), (2, "he cat sa", 3.0, "fuzzy")]
    d = spark.createDataFrame(rows, "id int, heard string, score double, kind string")
    inside = lambda a, b: a[0] == b[0] and a[3] != "exact" and a[1] and b[3] != "overlap" and b[2] >= a[2] and len(b[1]) > len(a[1]) and a[1] in b[1]
    assert sorted(map(tuple, matching.suppress_contained(d).collect())) == sorted(a for a in rows if not any(inside(a, b) for b in rows))


def test_texts_are_not_broadcast_to_a_lexicon(spark):
    from lexiloom.operators import spans

    texts = spark.range(50).select("id", F.concat(F.lit("the right eye চোখ "), F.col("id").cast("string")).alias("text"))
    lexicon = spark.createDataFrame([("e1", "right eye", "T1"), ("e2", "চোখ", "T2")], "entry string, phrase string, term string")
    hits = spans.lexicon_hits(texts, lexicon)
    assert hits.count() == 100 and "BuildLeft" not in plan(hits)
    terms = spark.range(1000).select(F.concat(F.lit("T"), "id").alias("id"), F.lit("n").alias("name"), F.lit("c").alias("category"))
    told = spans.lexicon_terms(hits, lexicon, terms)
    assert "BuildLeft" not in plan(told) and {(r.entry, r.term, r.name) for r in told.collect()} == {("e1", "T1", "n"), ("e2", "T2", "n")}


def test_facts_and_rows_are_not_broadcast(spark):
    from lexiloom.operators import evaluation

    case = spark.range(20).withColumnRenamed("id", "case")
    rows = case.select("case", F.lit("advice").alias("section"), F.lit("wash").alias("text"), F.lit("RE").alias("eye"))
    facts = case.select("case", F.lit("w").alias("fact"), F.array(F.lit("advice")).alias("sections"), F.array(F.lit("wash")).alias("patterns"), F.lit("").alias("eye"), F.lit(True).alias("critical"))
    forbid = case.where("case < 5").select("case", F.lit("x").alias("label"), F.array(F.lit("advice")).alias("sections"), F.lit("was").alias("pattern"))
    scores = evaluation.score_cases(evaluation.matched_facts(facts, rows), evaluation.violations(forbid, rows))
    assert "Broadcast" not in plan(scores) and {(r.case, r.hit, r.violations) for r in scores.collect()} == {(k, 1, int(k < 5)) for k in range(20)}


def test_texts_are_not_broadcast_to_terms(spark):
    from lexiloom.operators import matching

    texts = spark.range(50).select("id", F.split(F.lit("a red kite flew over the old stone bridge at home"), " ").alias("toks"))
    phrases = spark.createDataFrame([("t1", "red kite", 2), ("t2", "red kite", 2), ("t3", "green kite", 2)], "term string, norm string, n int")
    exact = matching.exact_matches(texts, phrases)
    assert exact.count() == 100 and "BuildLeft" not in plan(exact)
    words = ["kite", "flew", "stone", "bridge", "home"]
    over = matching.overlap_matches(texts, spark.createDataFrame([("t1", words), ("t2", words), ("t3", ["none", "such", "words"])], "term string, content array<string>"))
    assert {(r.term, r.k, r.best) for r in over.collect()} == {("t1", 5, 5), ("t2", 5, 5)} and over.count() == 100 and "BuildLeft" not in plan(over)


def test_loops_of_long_texts_take_one_pass():
    import time

    from lexiloom.functions import scans

    plain = [str(i * 7919 % 3001) for i in range(20_000)]
    looped = plain[:50] + ["a", "b"] * 4 + plain[50:90] + ["c"] * 5
    begin = time.process_time()
    assert [scans.looped_words(plain) for _ in range(20)] == [scans.looped_words(plain)] * 20
    assert time.process_time() - begin < 3 and scans.looped_words(looped) == 6 + 4


def test_drafts_are_made_in_parts_and_texts_are_read_once(spark, monkeypatch):
    from lexiloom.operators import rules
    from lexiloom.plans import scenes

    monkeypatch.setattr(scenes, "PART_VISITS", 40)
    items, visits = scenes.draft(spark, "/root/testdata/sf0.001")
    assert items.rdd.getNumPartitions() == visits.rdd.getNumPartitions() == 4
    d = rules.Draft(items, visits, lambda x: x)
    texts = d.of_texts(n=F.length("heard"))
    said = {r.text for r in visits.select("text").distinct().collect()}
    assert sorted(r.heard for r in texts.collect()) == sorted({*said, ""}) and len(said) < visits.count()
    d.look(texts)
    assert d.items.where("n = length(heard)").count() == items.count()


def test_alignments_leave_a_worker_in_slices_and_counts_alone_for_rates(spark):
    from lexiloom.functions import scans

    texts = ["", None, "a b c", "a x c d", "one two " * 9_000, "one three two " * 9]
    pairs = [(i, j, texts[i], texts[j]) for i in range(6) for j in range(6) if not (i == j == 4)]
    d = spark.createDataFrame(pairs, "i int, j int, ref string, hyp string").coalesce(1)
    w = lambda s: (s or "").split()
    rows = scans.aligned_rows(d, "ref", "hyp")
    for r in rows.collect():
        assert [tuple(x) for x in r.al] == scans.align(w(texts[r.i]), w(texts[r.j]))
    for r in d.select("i", "j", scans.change_counts("ref", "hyp").alias("c")).collect():
        ops = [x[0] for x in scans.align(w(texts[r.i]), w(texts[r.j]))]
        assert (r.c.subs, r.c.dels, r.c.inss) == tuple(map(ops.count, ("sub", "del", "ins"))) and r.c.distance == sum(r.c) - r.c.distance


def test_pairs_of_one_document_are_spread(spark):
    from lexiloom.plans import catalog

    assert "REPARTITION_BY_NUM" in plan(catalog.copy_pairs(spark, "/root/testdata/sf0.001"))


def test_words_are_not_copied_for_each_number(spark):
    from lexiloom.operators import quality

    texts = spark.createDataFrame([(1, ["12", "mmhg", "7", "6/9", "x"]), (2, ["5"])], "id int, toks array<string>")
    hits = quality.keyword_hits(texts, spark.createDataFrame([("c", "k", "x")], "category string, key string, form string"))
    assert "posexplode" not in plan(hits)
    assert {tuple(r) for r in hits.collect()} == {(1, "c", "k", 1), (1, "measurement", "pressure", 1), (1, "number", "digits", 1), (1, "measurement", "fraction", 1), (2, "number", "digits", 1)}


def test_names_are_made_distinct_and_not_their_variants(spark, tmp_path):
    from lexiloom.plans import text_queries

    rows = [(1, "green pen (tip)", "SMALL BOX"), (1, "green pen (tip)", "SMALL BOX"), (1, "green pen (tip)", "SMALL TIN"), (2, "red pen / ink", "LARGE TIN")]
    spark.createDataFrame(rows, "p_partkey int, p_name string, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    d = text_queries.name_variants(spark, str(tmp_path))
    got = [tuple(r) for r in d.collect()]
    assert len(got) == len(set(got)) and {r[0] for r in got} == {1, 2} and (1, "green pen (tip) (SMA)", "green pen (tip)") in got
    assert "REPARTITION_BY_NUM" in plan(d) and not any("variant" in line for line in plan(d).splitlines() if "Aggregate" in line)


def test_windows_before_a_content_word_are_enough(spark):
    import random

    from lexiloom.operators import matching
    from lexiloom.plans import catalog

    r = random.Random(5)
    texts = [(k, [r.choice("abcdefghij") * 3 for _ in range(r.randint(0, 60))]) for k in range(60)]
    needs = [("t1", ["aaa", "bbb", "ccc"]), ("t2", ["aaa", "bbb", "ccc"]), ("t3", ["jjj", "iii", "hhh", "ggg", "fff"])]
    want = set()
    for k, toks in texts:
        for term, c in needs:
            best = max((len(set(toks[i : i + max(3 * len(c), 12)]) & set(c)) for i in range(0, len(toks), 2)), default=0)
            if best * 10 >= len(c) * 6:
                want.add((k, term, len(c), best))
    m = matching.overlap_matches(spark.createDataFrame(texts, "id int, toks array<string>"), spark.createDataFrame(needs, "term string, content array<string>"))
    assert sorted(tuple(x)[:4] for x in m.collect()) == sorted(want) and "array_intersect(slice" in plan(m)
    p = plan(catalog.overlap_coverage(spark, "/root/testdata/sf0.001"))
    assert "REPARTITION_BY_NUM" in p and "sequence(" not in p


def test_phrases_are_found_by_their_first_words(spark):
    import random

    from lexiloom.operators import matching

    r = random.Random(7)
    texts = [(k, [r.choice("abc") for _ in range(r.randint(0, 30))]) for k in range(40)]
    phrases = {" ".join(r.choice("abc") for _ in range(r.randint(3, 5))) for _ in range(25)}
    want = {(k, " ".join(t[i : i + n]), i, i + n) for k, t in texts for n in (3, 4, 5) for i in range(len(t) - n + 1) if " ".join(t[i : i + n]) in phrases}
    got = matching.phrase_spans(spark.createDataFrame(texts, "id int, toks array<string>"), spark.createDataFrame([(p,) for p in phrases], "heard string"), 3, 5)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 100


def test_the_earliest_word_of_a_term_is_its_best_match(spark):
    from lexiloom.operators import matching

    words = "a b c d e f g".split()
    said = spark.createDataFrame([(k % 7, words[k * k % 5]) for k in range(60)], "id int, w string")
    surfaces = spark.createDataFrame([(t, w, k) for t in range(4) for k, w in enumerate(words[t:])] + [(None, "b", 3), (None, "a", 3)], "term int, w string, ord int")
    m = matching.earliest_per_term(said, surfaces)
    counts = said.groupBy("id", "w").agg(F.count("*").alias("count")).join(surfaces.where("term is not null"), "w").withColumn("score", -F.col("ord").cast("double"))
    want = matching.best_per_term(counts).select("id", "term", "w", "ord", "count")
    assert sorted(map(tuple, m.where("term is not null").collect())) == sorted(map(tuple, want.collect()))
    assert m.where("term is null").count() == m.where("term is null").select("id").distinct().count() > 0
    assert [line for line in plan(m).splitlines() if "Window" in line and "id#" in line.split("Window", 1)[1]] == []


def test_evidence_counts_a_word_of_a_document_once(spark, tmp_path):
    from lexiloom.plans import catalog

    spark.createDataFrame([(1, "one two three"), (1, "two three four"), (2, "one"), (3, None)], "doc_id int, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, "one two two five")], "item_id int, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = catalog.evidence_supported(spark, str(tmp_path))
    assert [tuple(r) for r in d.collect()] == [(1, 7, 3, 4)] and "REPARTITION_BY_NUM" in plan(d)


def test_word_pairs_are_counted_in_parts(spark):
    from lexiloom.plans import catalog

    d = catalog.token_ngrams_topk(spark, "/root/testdata/sf0.001")
    assert "REPARTITION_BY_NUM" in plan(d) and "slice(" not in plan(d)


def test_counts_of_words_are_joined_and_not_words(spark, tmp_path):
    from lexiloom.plans import catalog

    rows = [(1, "The cat and the dog", "en"), (1, "a", "de"), (2, "der Hund", None), (3, "...", "fr"), (4, None, "es"), (None, "the", "en")]
    spark.createDataFrame(rows, "doc_id int, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    d = catalog.function_word_rate(spark, str(tmp_path))
    assert {tuple(r) for r in d.collect()} == {("en", 6, 4), ("de", 6, 0), (None, 2, 0)}
    assert "REPARTITION_BY_NUM" in plan(d)


def test_normalising_with_a_plain_class_is_the_same(spark):
    rows = [(chr(i) + "a" + chr(i) + chr(i) + "b",) for i in [*range(0x300), 0x2019, 0xD7FF, 0xE000, 0xFFFF, 0x10000, 0x10FFFF]] + [("a <b>  <<c 1.2.3/4:d <dot>e'f - g",), ("",), (None,)]
    x = F.regexp_replace(F.lower("t"), "'", "")
    for sign, name in ((r"(\d)\.(\d)", "dot"), (r"([a-z0-9])/([a-z0-9])", "sl"), (r"([a-z0-9]):([a-z0-9])", "co")):
        x = F.regexp_replace(x, sign, f"$1<{name}>$2")
    x = F.regexp_replace(x, r"[^a-z0-9%+<>]+", " ")
    for name, sign in (("<dot>", "."), ("<sl>", "/"), ("<co>", ":")):
        x = F.replace(x, F.lit(name), F.lit(sign))
    want = F.trim(F.regexp_replace(F.translate(x, "<>", "  "), " +", " "))
    assert spark.createDataFrame(rows, "t string").where(~want.eqNullSafe(X.normalize_ascii(F.col("t")))).count() == 0


def test_chains_end_as_soon_as_nothing_moves(spark):
    from lexiloom.operators import rules, term_graph

    up = {k: k + 1 for k in range(1, 6)} | {k: k // 3 for k in range(30, 90)} | {7: 8, 8: 9, 9: 7, 10: 7, 11: 10, 12: 11, 13: 13}
    ids = range(1, 90)
    rows = [(k, "c", f"term {k}", f"Term {up[k]}" if k in up else None, k * 7 % 89) for k in ids]
    v = spark.createDataFrame(rows, "id int, category string, name string, generic string, ord int").withColumn("aliases", F.array().cast("array<string>"))
    rounds = []

    def save(d):
        rounds.append(1)
        return rules.checkpointed(d)

    def stands(k):
        seen = []
        while k not in seen:
            seen.append(k)
            k = up.get(k, k)
        return min(seen[seen.index(k) :], key=lambda x: x * 7 % 89)

    got = {r.id: r.standing for r in term_graph.generics(v, term_graph.surfaces(v), save).collect()}
    assert got == {k: stands(k) for k in ids} and len(rounds) <= 6


def test_a_part_and_number_of_lines_is_grounded_once(spark, tmp_path):
    from lexiloom.plans import report_queries

    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    part.write.parquet(str(tmp_path / "part.parquet"))
    rows = [(1, 1, 5), (2, 1, 5), (3, 4, 5), (4, None, 5), (5, 2, None)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    d = report_queries.grounded_lines(spark, str(tmp_path))
    got = {r.l_orderkey: (r.l_linenumber, r.term, r.how) for r in d.collect()}
    assert set(got) == {1, 2, 3, 4} and d.count() == 4 and got[1] == got[2] and got[3][2] == "id"
    assert any("keys=[l_partkey" in line and "l_linenumber" in line for line in plan(d).splitlines() if "HashAggregate" in line)


def test_an_analysis_works_out_what_is_asked_for(spark, monkeypatch):
    """Quality needs no matches; and visits that come out of a shuffle by visit are still dealt out to all tasks."""
    from lexiloom.plans import analyze, fixtures, tables

    def unasked(*_):
        raise AssertionError("matches were not asked for")

    monkeypatch.setattr(analyze, "match_terms", unasked)
    visits = fixtures.visits(spark).groupBy("visit").agg(*[F.first(c).alias(c) for c in fixtures.visits(spark).columns if c != "visit"])
    got = analyze.analyze(visits, fixtures.terms(spark), tables.table(spark, tables.KEYWORDS, "category, key, form"), {"en": tables.FUNCTION_WORDS["en"]})
    assert {r.id: r.tier for r in got.quality.collect()}["v1"] == "high"
    assert got._texts.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_heard_span_is_probed_by_few_keys(spark):
    """Eight places for a length and three edits, and none where no known form has such a length."""
    from lexiloom.operators import segments

    d = spark.createDataFrame([("thesmallringbond", 44), ("x" * 40, 0)], "s string, n int")
    rows = d.select("n", F.size(segments.probe_keys("w", F.col("s"), {(3, n) for n in range(13, 20)})).alias("keys")).collect()
    assert all(r.keys == r.n for r in rows)


def test_rules_leave_one_copy_of_the_items(spark, monkeypatch):
    """Copies of the items, and what was read in texts, are deleted once a later copy holds them: disk does not grow with the rules."""
    from pathlib import Path

    from lexiloom.operators import rules
    from lexiloom.plans import fixtures

    files = []

    def save(df):
        out = rules.checkpointed(df)
        files.append(out._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:"))
        return out

    items, audit = rules.post_process(*fixtures.draft(spark), save=save)
    left = [f for f in files if Path(f).exists()]
    assert len(files) > 15 and len(left) <= 3  # the items, the distinct texts and what they deny
    assert items.count() and audit.count()


def test_far_texts_are_compared_by_rows_of_bits(spark):
    """Long texts that are far apart: the same distance as the whole table's, with no table of their cells."""
    import random
    import time

    rng = random.Random(3)
    text = lambda n: "".join(rng.choices("abcdéচ𝒳", k=n))
    rows = [("", ""), ("", "ab"), (None, "a"), ("a" * 900, "b" * 700)] + [(text(rng.randint(0, 900)), text(rng.randint(0, 900))) for _ in range(40)]
    d = spark.createDataFrame(rows, "h string, r string")
    got = X.with_edit_distance(d, "h", "r", "n").withColumn("want", F.levenshtein("h", "r")).collect()
    assert [r.n for r in got] == [r.want for r in got] and sum(r.want is None for r in got) == 1
    began = time.perf_counter()
    X.far_distance(text(60_000), text(60_000))  # 3,600 million cells
    assert time.perf_counter() - began < 10
