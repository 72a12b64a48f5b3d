"""Drafted records and what was heard beside them, made for every customer from fixed sentences: data that Spark and SQL share.

No real person's words. A visit hears two of the sentences, and its draft has eight of the items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEARD = (
    "I have redness and pain in the right eye for three days.",
    "No fever and no cough but some itching.",
    "I am 58 years old and I have sugar for ten years.",
    "Eye pressure by NCT right eye 18 and left eye 20 at 10:30.",
    "Vision is 6/9 today, aged 58.",
    "Use moxifloxacin four times daily. Wash your hands often.",
    "Take timolol eye drops twice a day at home.",
    "No need for the blood test now.",
    "Cataract surgery is planned next month.",
    "She is allergic to sulfa, a reaction to tablets.",
    "It is a nuclear cataract in the left eye.",
    "The macula looks fine, come back after one week.",
    "Goldmann applanation shows pressure of 22 mm.",
    "Use latanoprost once at night. Nothing else.",
    "We will check the pressure next time.",
    "Warm compress every night, avoid rubbing.",
    "The injection was done last year.",
    "Phacoemulsification is advised for the right eye.",
)
FIELDS = ("section", "kb_id", "name", "eye", "evidence", "result", "frequency", "phase", "duration", "character", "notes", "grade", "when", "purpose", "status", "label", "brand_said", "positive")
_ITEMS: tuple[dict[str, str], ...] = (
    {"section": "patient.name", "name": "Doctor babu"},
    {"section": "patient.name", "name": "Patient"},
    {"section": "patient.name", "name": "Maria Lopez"},
    {"section": "patient.age", "name": "58"},
    {"section": "patient.age", "name": "120 years"},
    {"section": "patient.age", "name": "old"},
    {"section": "chief_complaints", "name": "Redness", "eye": "RE", "evidence": "redness and pain", "duration": "evening"},
    {"section": "chief_complaints", "name": "redness", "eye": "RE", "evidence": "redness", "duration": "at night", "character": "burning"},
    {"section": "chief_complaints", "name": "Pain", "eye": "RE", "evidence": "pain in the right eye"},
    {"section": "history.systemic", "name": "Diabetes", "evidence": "i have sugar for ten years", "duration": "10 years"},
    {"section": "history.systemic", "name": "Diabetes", "evidence": "i have sugar", "duration": "long"},
    {"section": "history.allergy", "name": "none known"},
    {"section": "history.ocular", "name": "Family history of glaucoma", "eye": "BE"},
    {"section": "history.current_medications", "name": "Diabetes"},
    {"section": "history.current_medications", "name": "Metformin"},
    {"section": "examination", "name": "Intraocular pressure", "eye": "RE", "result": "18 mmHg", "evidence": "right eye 18"},
    {"section": "examination", "name": "Intraocular pressure (NCT)", "eye": "LE", "result": "20", "evidence": "left eye 20"},
    {"section": "examination", "name": "Intraocular pressure", "eye": "LE", "result": "22 mmHg"},
    {"section": "examination", "name": "IOP", "eye": "RE", "result": "normal"},
    {"section": "examination", "name": "Visual acuity", "eye": "RE", "result": "6/9", "evidence": "vision is 6/9"},
    {"section": "examination", "name": "Visual acuity", "eye": "LE", "result": "6/60"},
    {"section": "examination", "name": "Retinoscopy"},
    {"section": "clinical_findings", "name": "Redness", "eye": "RE", "evidence": "redness"},
    {"section": "clinical_findings", "name": "Nuclear cataract", "eye": "LE", "evidence": "nuclear cataract"},
    {"section": "clinical_findings", "name": "Corneal oedema", "eye": "LE", "evidence": "the cornea was hazy"},
    {"section": "diagnosis", "name": "Nuclear cataract", "eye": "LE", "evidence": "it is a nuclear cataract", "grade": "two"},
    {"section": "diagnosis", "name": "Cortical cataract", "eye": "RE", "evidence": "cataract surgery is planned"},
    {"section": "diagnosis", "name": "Dry eye", "eye": "BE", "evidence": "dryness all day"},
    {"section": "medications", "name": "Moxifloxacin", "eye": "RE", "evidence": "use moxifloxacin four times daily", "frequency": "twice daily", "phase": "current"},
    {"section": "medications", "name": "Timolol 0.5%", "eye": "BE", "evidence": "take timolol", "frequency": "BD", "status": "old"},
    {"section": "medications", "name": "Latanoprast", "eye": "BE", "evidence": "use latanoprost", "frequency": "three times a day", "phase": "pre-op"},
    {"section": "medications", "name": "Prednisolone", "eye": "RE", "phase": "Post op"},
    {"section": "medications", "name": "", "brand_said": ""},
    {"section": "medications", "kb_id": "MED-001", "name": "MED-001", "label": "Moxifloxacin", "brand_said": "moxifloxacin"},
    {"section": "medications", "name": "Vigamox", "positive": "true", "notes": "not required now"},
    {"section": "procedures", "name": "Injection", "eye": "RE", "evidence": "if it gets worse", "notes": "to be considered if it gets worse"},
    {"section": "procedures", "name": "Cataract surgery", "eye": "LE", "evidence": "cataract surgery is planned"},
    {"section": "procedures", "name": "Laser", "eye": "RE", "evidence": "laser in case of leaks", "notes": "laser"},
    {"section": "investigations", "name": "Blood test", "eye": "BE", "evidence": "no need for the blood test"},
    {"section": "investigations", "name": "Blood sugar", "eye": "BE", "evidence": "sugar for ten years"},
    {"section": "investigations", "name": "OCT of the macula", "eye": "BE", "evidence": "oct"},
    {"section": "investigations", "name": "Slit lamp examination", "eye": "BE", "evidence": "slit lamp"},
    {"section": "advice", "name": "Wash hands", "evidence": "wash your hands often"},
    {"section": "advice", "name": "Hand washing", "evidence": "Wash your hands often"},
    {"section": "advice", "name": "Warm compress", "evidence": "warm compress every night"},
    {"section": "advice", "name": "Come back after one week", "evidence": "come back after one week"},
    {"section": "advice", "name": "We will check the pressure", "evidence": "we will check the pressure next time"},
    {"section": "follow_up", "when": "এক সপ্তাহ পরে"},
    {"section": "follow_up", "when": "one week", "purpose": "Review"},
)
ITEMS = tuple(tuple(x.get(f, "") for f in FIELDS) for x in _ITEMS)
PER_VISIT = 8
#: Visits of a part, at least, until there are as many parts as a shuffle has.
PART_VISITS = 4_000
ATTRS = FIELDS[5:]


def _array(rows) -> F.Column:
    return F.array(*[F.array(*[F.lit(c) for c in r]) for r in rows])


def draft(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Items (visit, section, idx, kb_id, name, eye, evidence, attrs) and visits (visit, text), both by visit in as many parts.

    A file of few row groups would otherwise be few tasks, however many items are made of its rows.
    """
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("visit"))
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), c.count() // PART_VISITS + 1)
    c = c.repartition(parts, "visit")
    said = F.array(*[F.lit(x) for x in HEARD])
    n, m = len(HEARD), len(ITEMS)
    visits = c.select("visit", F.concat_ws(" ", F.get(said, (F.col("visit") % n).cast("int")), F.get(said, ((F.col("visit") * 7 + 3) % n).cast("int"))).alias("text"))
    picked = c.select("visit", F.explode(F.sequence(F.lit(0), F.lit(PER_VISIT - 1))).alias("idx"))
    picked = picked.withColumn("x", F.get(_array(ITEMS), ((F.col("visit") * 5 + F.col("idx") * 11) % m).cast("int")))
    at = {f: F.get("x", F.lit(i)) for i, f in enumerate(FIELDS)}
    attrs = F.create_map(*[y for f in ATTRS for y in (F.lit(f), at[f])])
    return picked.select("visit", at["section"].alias("section"), "idx", *[at[f].alias(f) for f in ("kb_id", "name", "eye", "evidence")], attrs.alias("attrs")), visits


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_ROWS = ", ".join(f"({i}, {', '.join(map(_quoted, r))})" for i, r in enumerate(ITEMS))
_SAID = ", ".join(f"({i}, {_quoted(x)})" for i, x in enumerate(HEARD))
_NAMES = ", ".join(f'"{f}"' for f in FIELDS)
#: The same in SQL: ``base`` has a row for each item, with what was heard; ``visits`` a row for each visit.
SQL = f"""
said(k, t) as (values {_SAID}), items(k, {_NAMES}) as (values {_ROWS}),
visits as (select c_custkey as visit, a.t || ' ' || b.t as heard from customer join said a on a.k = c_custkey % {len(HEARD)} join said b on b.k = (c_custkey * 7 + 3) % {len(HEARD)}),
base as (select visits.visit, heard, j::int as idx, {", ".join(f'items."{f}"' for f in FIELDS)} from visits, (select unnest(range(0, {PER_VISIT})) as j) join items on items.k = (visits.visit * 5 + j * 11) % {len(ITEMS)})"""
