"""Secret scans: patterns propose findings, a random forest removes the false ones.

Everything on the main path is a DataFrame operation. Candidates, their places and their
neighbours come from regular expressions; features are columns. Which words of a value are
dictionary words is learned from all documents, by document frequency. Weights of neighbouring
words, of words inside values and of character transitions are learned from one half of a bounded
table of labelled findings, and the forest from the other; they are written as literals and
nested conditions.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .trees import Tree, forest

#: Labelled findings that are learned from, at most; documents, and characters of each, that training contexts are cut from.
FINDINGS, PROSE_DOCS, PROSE_CHARS = 3_000, 200, 600
#: Trees and their depth; score from which a finding stays; documents that a dictionary word is in at least.
TREES, DEPTH, THRESHOLD, MIN_DOCS = 25, 6, 0.5, 3
#: Learned words of a kind, at most; words of candidates that are broadcast, beyond it the join is shuffled.
LEARNED_WORDS, BROADCAST_WORDS = 150, 500_000

# Names that secrets are given to, and forms that services give their keys.
_NAMES = "password|passwd|passphrase|pwd|secret|token|api[_-]?key|apikey|auth|access[_-]?key|private[_-]?key|client[_-]?secret|credentials?"
_BLOCK = r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:\s*+(?:[A-Za-z-]{2,20}: [^\n]*+\n)*+[A-Za-z0-9+/=\s\\]*+-----END [A-Z ]*PRIVATE KEY-----)?"
_FORMS = rf"AKIA[0-9A-Z]{{16}}|gh[pousr]_[A-Za-z0-9]{{36}}|xox[abprs]-[A-Za-z0-9-]{{10,}}|sk_live_[A-Za-z0-9]{{16,}}|AIza[A-Za-z0-9_-]{{35}}|eyJ[A-Za-z0-9_-]{{8,}}\.[A-Za-z0-9_-]{{8,}}\.[A-Za-z0-9_-]{{8,}}|{_BLOCK}"
_RUN = r"[A-Za-z0-9+/_-]"
#: A name, a sign and a value; a known form, a key with all its lines; or a run of 16 characters or more with a digit. Each is taken to its end, without a second look.
PATTERN = (
    rf"(?i:(?<![a-z])(?:{_NAMES})[\"']?[ \t]*+(?::=|=>|[:=])[ \t]*+[\"']?)(?:{_BLOCK}|[A-Za-z0-9+/_.!@$%^&*~-]{{6,}}+={{0,2}})"
    rf"|(?<!{_RUN})(?:{_FORMS})"
    rf"|(?<!{_RUN})(?=[A-Za-z+/_-]*+[0-9]){_RUN}{{16,}}+={{0,2}}"
)
_HEAD = rf"^(?i:(?:{_NAMES})[\"']?[ \t]*+(?::=|=>|[:=])[ \t]*+[\"']?)"
_PATHS = r"(?i)(?:^|[/_.-])(?:tests?|spec|fixtures?|examples?|samples?|docs?|mock|demo|vendor|node_modules|lock)(?:[/_.-]|$)"
#: Letters, a digit, what else: the states of character transitions.
_STATES = "abcdefghijklmnopqrstuvwxyz0."
_INNER = "[A-Z]?[a-z]{2,}|[A-Z]{3,}"

FEATURES = ("f_length", "f_digits", "f_upper", "f_hex", "f_distinct", "f_changes", "f_moves", "f_known", "f_inner", "f_named", "f_form", "f_quoted", "f_number", "f_uuid", "f_path", "f_near", "f_same")


@dataclass
class Model:
    """What is learned from labelled findings."""

    trees: list[Tree] = field(default_factory=list)
    near: dict[str, float] = field(default_factory=dict)
    inner: dict[str, float] = field(default_factory=dict)
    moves: list[float] = field(default_factory=lambda: [0.0] * len(_STATES) ** 2)


def _value(cand: Column) -> Column:
    return F.regexp_replace(cand, _HEAD, "")


def _inner_words(value: Column) -> Column:
    """Lower-cased runs of letters in a value, also within camelCase."""
    return F.transform(F.regexp_extract_all(value, F.lit(_INNER), F.lit(0)), F.lower)


def _near_words(before: Column, after: Column) -> Column:
    """The last five words before a finding on its line, and the first three after it."""
    line = F.substring_index(before, "\n", -1)
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\d]{2,}"), F.lit(0))
    first = words(line)
    return F.array_distinct(F.concat(F.slice(first, F.greatest(F.size(first) - 4, F.lit(1)), 5), F.slice(words(after), 1, 3)))


def _weighed(words: Column, table: dict[str, float]) -> Column:
    if not table:
        return F.lit(0.0)
    weights = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.aggregate(words, F.lit(0.0), lambda total, w: total + F.coalesce(weights[w], F.lit(0.0)))


def _moved(value: Column, moves: list[float]) -> Column:
    """Mean weight of the transitions between a value's characters."""
    states = F.regexp_replace(F.regexp_replace(F.lower(value), "[0-9]", "0"), "[^a-z0]", ".")
    place = lambda i: F.position(F.substring(states, i, F.lit(1)), F.lit(_STATES)) - 1
    table = F.array(*[F.lit(x) for x in moves])
    steps = F.when(F.length(states) > 1, F.sequence(F.lit(1), F.length(states) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(0.0), lambda total, i: total + F.coalesce(F.get(table, place(i) * len(_STATES) + place(i + 1)), F.lit(0.0))) / F.greatest(F.length(states), F.lit(1))


def described(found: DataFrame, model: Model) -> DataFrame:
    """(cand, before, after, path, known: letters in dictionary words) with the value and its features."""
    v, low = F.col("value"), F.lower("value")
    n = F.greatest(F.length(v), F.lit(1)).cast("double")
    count = lambda p, c=v: F.regexp_count(c, F.lit(p)).cast("double")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return found.withColumn("value", _value(F.col("cand"))).withColumns(
        {
            "f_length": F.length(v).cast("double"),
            "f_digits": count("[0-9]") / n,
            "f_upper": count("[A-Z]") / n,
            "f_hex": flag(low.rlike("^[0-9a-f]+$")),
            "f_distinct": F.size(F.array_distinct(F.split(v, ""))).cast("double") / n,
            "f_changes": (count("[a-z](?=[0-9A-Z])") + count("[A-Z](?=[0-9a-z])") + count("[0-9](?=[A-Za-z])")) / n,
            "f_moves": _moved(v, model.moves),
            "f_known": F.coalesce("known", F.lit(0)) / n,
            "f_inner": _weighed(_inner_words(v), model.inner),
            "f_named": (F.length("cand") > F.length(v)).cast("double"),
            "f_form": flag(v.rlike(f"^(?:{_FORMS})")),
            "f_quoted": flag(F.left("after", F.lit(1)).isin('"', "'") | F.right("before", F.lit(1)).isin('"', "'")),
            "f_number": flag(v.rlike("^[0-9+_/-]+$")),
            "f_uuid": flag(low.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")),
            "f_path": flag(F.col("path").rlike(_PATHS)),
            "f_near": _weighed(_near_words(F.col("before"), F.col("after")), model.near),
            "f_same": flag(v.rlike(r"(.)\1{5}")),
        }
    )


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, cand, before, after, path) of every match; places in code points, end exclusive."""
    rows = docs.where(F.col("text").rlike(PATTERN)).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("th"),
        (F.col("source") if "source" in docs.columns else F.lit(None).cast("string")).alias("path"),
        F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)).alias("cands"),
        F.split("text", PATTERN, -1).alias("rest"),
    )
    each = rows.select("doc_id", "th", "path", "rest", F.posexplode("cands").alias("k", "cand"))
    each = each.select(
        "doc_id", "th", "path", "k", "cand", F.length(F.get("rest", F.col("k"))).alias("gap"), F.right(F.get("rest", F.col("k")), F.lit(80)).alias("before"), F.left(F.get("rest", F.col("k") + 1), F.lit(80)).alias("after")
    )
    each = each.dropDuplicates(["doc_id", "th", "k"])
    w = Window.partitionBy("doc_id", "th").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("cand")).over(w)
    return each.withColumn("end", end).withColumn("start", F.col("end") - F.length("cand")).select("doc_id", "start", "end", "cand", "before", "after", "path")


def dictionary(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The ``wanted`` (word) that stand by themselves in at least ``MIN_DOCS`` documents, counted over all of them."""
    told = F.broadcast(wanted) if wanted.count() <= BROADCAST_WORDS else wanted
    words = docs.where("text is not null").select(F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}0-9+/_-]+"))).alias("word"))
    return words.join(told, "word").groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_DOCS).select("word")


def with_known(found: DataFrame, known: DataFrame) -> DataFrame:
    """(id, cand, ...) with ``known``, the letters of a value's words that are in the dictionary."""
    runs = found.select("id", F.explode(_inner_words(_value(F.col("cand")))).alias("word"))
    told = F.broadcast(known) if known.count() <= BROADCAST_WORDS else known
    sums = runs.join(told, "word").groupBy("id").agg(F.sum(F.length("word")).alias("known"))
    return found.join(sums, "id", "left")


def prose(docs: DataFrame) -> list[str]:
    """Beginnings of a bounded number of documents, the first by a hash: contexts of invented findings."""
    able = docs.where("text is not null").withColumn("_h", F.xxhash64("text"))
    first = [r[0] for r in able.select("_h").distinct().orderBy("_h").limit(PROSE_DOCS).collect()]
    texts = able.where(F.col("_h").isin(first)).groupBy("_h").agg(F.min(F.substring("text", 1, PROSE_CHARS)).alias("t")) if first else None
    return sorted(r.t for r in texts.collect()) if texts is not None else []


def labelled_findings(n: int = FINDINGS, seed: int = 17, lines: list[str] | None = None) -> list[tuple[str, str, str, str, int]]:
    """Invented findings (cand, before, after, path, label) in the shapes of real ones, between pieces of ``lines``."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    run = lambda abc, k: "".join(abc[int(i)] for i in rng.integers(0, len(abc), k))
    some = lambda a, b: int(rng.integers(a, b))
    hexa, digits = "0123456789abcdef", "0123456789"
    letters = "abcdefghijklmnopqrstuvwxyz"
    alnum = letters + letters.upper() + digits
    names = ["token", "secret", "api_key", "password", "auth", "access_key", "TOKEN", "API_KEY", "client_secret", "apikey", "passwd", "private_key", "credential"]
    syllables = "th he in er an re on at en nd es or st tion ing ment que os ado lich ung ver keit".split()
    lines = [x for x in lines or [] if x.strip()]
    vocabulary = sorted({w for x in lines for w in re.findall("[a-z]{3,}", x.lower())})
    word = lambda: pick(vocabulary) if vocabulary and rng.random() < 0.7 else "".join(pick(syllables) for _ in range(some(1, 5)))

    def around(k: int) -> str:
        if lines and rng.random() < 0.7:
            x = pick(lines)
            i = some(0, max(1, len(x) - k))
            return x[i : i + k]
        return " ".join(word() for _ in range(6))

    good_paths, bad_paths = ["src/app.py", "config/prod.env", "src3", "deploy.yml", "main.go", "src17", ""], ["tests/test_auth.py", "docs/example.md", "fixtures/keys.json", "package-lock.json"]
    mixed = lambda: pick(["Tr0ub", "hunter", "Winter", "blue", word()]) + pick("!@$%_-") + run(alnum, some(3, 8)) + run(digits, 2)
    out = []
    for i in range(n):
        y = i % 2
        quote, sep = pick(['"', "'", ""]), pick([" = ", "=", ": ", ":"])
        named = f"{pick(names)}{sep}{quote}"
        before, tail, path = around(60) + " ", " " + around(30), pick(good_paths + good_paths + bad_paths)
        if y:
            value = pick([run(hexa, 40), run(hexa, 32), run(hexa.upper(), 40), run(hexa, 64), run(alnum, some(20, 64)), run(alnum + "+/", 44), run(alnum, 12) + pick("!@$%") + run(digits, 2), mixed(), mixed(), run(alnum + "_-", some(16, 200))])
            form = pick([None, None, None, "AKIA" + run(letters.upper() + digits, 16), "ghp_" + run(alnum, 36), "sk_live_" + run(alnum, 24), f"eyJ{run(alnum, 20)}.{run(alnum, 60)}.{run(alnum, 43)}", "xoxb-" + run(digits, 11) + "-" + run(alnum, 24), "-----BEGIN RSA PRIVATE KEY-----"])
            if form:
                cand = named + form if rng.random() < 0.5 else form
                before += pick(["key ", "using ", "", ""]) if cand == form else ""
            elif rng.random() < 0.75:
                cand = named + value
            else:
                cand, before = run(pick([alnum, hexa, alnum + "+/"]), pick([32, 40, 64, some(24, 50)])), before + pick(["bearer ", "login ", "password is ", "the secret ", "authorization: bearer ", "api key ", "export KEY=", "credentials "])
        else:
            kind = some(0, 12)
            if kind == 0:
                cand = run(digits, some(16, 24))
            elif kind == 1:
                cand, before = run(hexa, pick([40, 64, 32])), before + pick(["commit ", "sha256 ", "md5 ", "checksum: ", "etag ", "sha1 ", "digest ", "hash ", "revision ", "merge ", "parent ", "tree "])
            elif kind == 2:
                cand = named + pick(["your_token_here", "changeme", "xxxxxxxxxxxx", "example-secret", "placeholder", "password", "test1234", "default_value", "insert-key-here", "REPLACE_ME", "********", "my_secret_value", "todo_fill_in", "YOUR_API_KEY", "dummy-token"])
            elif kind == 3:
                cand = "-".join((run(hexa, 8), run(hexa, 4), run(hexa, 4), run(hexa, 4), run(hexa, 12)))
                before += pick(["", "id ", "uuid ", "request "])
            elif kind == 4:
                cand = named + word() + pick([".", "_", "-"]) + word() + pick(["", "_" + word(), "." + word()])
            elif kind == 5:
                cand = "/".join((word(), word(), word() + run(digits, 2), word(), word()))
            elif kind == 6:
                cand = "_".join(word() for _ in range(3)) + "_" + run(digits, some(1, 5))
            elif kind == 7:
                cand, path = named + run(alnum, 20), pick(bad_paths)
                before += "example "
            elif kind == 8:
                cand = named + pick(["os.environ", "getenv", "request.headers", "self.config", "process.env.", "settings."]) + pick(["", word()])
            elif kind == 9:
                cand = word().capitalize() + word().capitalize() + word().capitalize() + "V" + run(digits, 1) + word().capitalize()
            elif kind == 10:
                cand = f"20{run(digits, 2)}-{some(1, 13):02d}-{some(1, 29):02d}-{word()}-{word()}"
            else:
                cand = named + word() + word()
        out.append((cand, before, (quote if cand.startswith(named) else "") + tail, path, y))
    return out


_SCHEMA = "cand string, before string, after string, path string, label int"


def _learned(pos: Counter[str], neg: Counter[str], n: int, m: int) -> dict[str, float]:
    """Log odds of words in labelled findings, the strongest first."""
    odds = {w: float(np.log((pos[w] + 1) / (n + 2)) - np.log((neg[w] + 1) / (m + 2))) for w in pos | neg if pos[w] + neg[w] >= 4}
    return dict(sorted(odds.items(), key=lambda kv: (-abs(kv[1]), kv[0]))[:LEARNED_WORDS])


def fit(found: DataFrame) -> Model:
    """Learns from labelled findings (id, cand, before, after, path, label, known), at most ``FINDINGS`` of them by a hash."""
    rows = found.orderBy(F.xxhash64("cand", "before", "after"), "cand", "before").limit(FINDINGS)
    value = _value(F.col("cand"))
    half = F.pmod(F.xxhash64("before", "cand"), F.lit(2)) == 0
    rows = rows.withColumns({"half": half, "words": _near_words(F.col("before"), F.col("after")), "inner": F.array_distinct(_inner_words(value)), "low": F.lower(value)})
    told = rows.select("half", "label", "words", "inner", "low").collect()
    model = Model()
    if not told:
        return model
    near, inner, total = (Counter(), Counter()), (Counter(), Counter()), [0, 0]
    steps = np.ones((2, len(_STATES), len(_STATES)))
    place = {c: i for i, c in enumerate(_STATES)}
    for r in told:
        if r.half:
            total[r.label] += 1
            near[r.label].update(r.words)
            inner[r.label].update(r.inner)
            at = [place["0" if c in "0123456789" else c if c in place and c != "0" else "."] for c in r.low]
            np.add.at(steps[r.label], (at[:-1], at[1:]), 1)
    model.near, model.inner = _learned(near[1], near[0], total[1], total[0]), _learned(inner[1], inner[0], total[1], total[0])
    chance = np.log(steps / steps.sum(axis=2, keepdims=True))
    model.moves = [float(x) for x in (chance[1] - chance[0]).ravel()]
    m = np.array(described(rows.where(~F.col("half")), model).select("label", *FEATURES).collect(), dtype=float)
    if len(m):
        model.trees = forest(m[:, 1:], m[:, 0], TREES, DEPTH)
    return model


def score_of(trees: list[Tree]) -> Column:
    return sum((t.column(list(FEATURES)) for t in trees), F.lit(0.0)) / max(1, len(trees))


def scan(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """(doc_id, start, end, kind, secret, score, is_secret) of each candidate in every whole text.

    ``findings`` (cand, before, after, path, label) are labelled ones to learn from; without any,
    invented ones are used, with contexts from ``docs``. Null and empty texts have no candidates;
    long texts and values are taken whole. Where two patterns begin at one place, a named value
    goes before a key form and that before a run. A score of exactly 0.5 is a secret. Repeated
    rows (one doc_id and text) are reported once. An empty table gives an empty one. ``source``
    is read as the path where there is one; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "secrets")
    found = scratch.save(candidates(docs).withColumn("id", F.monotonically_increasing_id()))
    if findings is None:
        findings = spark.createDataFrame(labelled_findings(lines=prose(docs)), _SCHEMA)
    findings = scratch.save(findings.select("cand", "before", "after", "path", "label").withColumn("id", F.monotonically_increasing_id()))
    words = lambda d: d.select(F.explode(_inner_words(_value(F.col("cand")))).alias("word"))
    known = scratch.save(dictionary(docs, scratch.save(words(found).unionByName(words(findings)).distinct())))
    model = fit(with_known(findings, known))
    kind = F.when(F.col("f_form") > 0, "key form").when(F.col("f_named") > 0, "named value").otherwise("random run")
    rows = described(with_known(found, known), model).withColumn("score", score_of(model.trees))
    head = F.length("cand") - F.length("value")
    return rows.select("doc_id", (F.col("start") + head).alias("start"), "end", kind.alias("kind"), F.col("value").alias("secret"), "score", (F.col("score") >= THRESHOLD).alias("is_secret"))
