"""Invented rows for operators that the driver's tables cannot exercise. No real person's words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NATIVE_WORDS = (("मोतियाबिंद", "motiyabind"), ("চোখ লাল", "chokh lal"), ("दिखता", "dikhta"), ("অ্যালার্জি", "alarji"))
PAIRS = (("the red kite flew home", "the red bite flew home"), ("a b c", "a c"), ("one", "one two"), ("চোখ লাল আছে", "চোখ লাল নেই"))
ANSWERS = ('{"a": [{"b": 1}, {"c": "cut', '```json\n{"a": 1}\n```', '<think>well</think> {"a": 2} thanks', "nothing", '{"prescription": {"complaints": ["x"]}}')
PROMPTS = (("v1", 'say ANSWER: {"prescription": {"complaints": ["pain", "redness"]}}'), ("v2", 'ANSWER: {"diagnosis": [{"name": "x"}, {"name": "y'), ("v3", "nothing asked"))
TOKENS = tuple(("r1", str(i), t, p) for i, (t, p) in enumerate(((" hel", "0.9"), ("lo", "0.8"), ("[_BEG_]", "1.0"), (" wor", "0.7"), ("ld", "0.95"))))


def draft(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Items and visits in which most rules find something to do."""
    heard = (
        "Patient: I have redness and pain in the right eye for three days. No fever. I am 58 years old, I have sugar for ten years. "
        "Doctor: any pressure or asthma?\nDoctor: eye pressure by NCT right eye 18 and left eye 20 at 10:30. Vision 6/9. Use moxifloxacin four times daily. "
        "Wash your hands often. No need for the blood test. Cataract surgery is planned. Come back after one week."
    )
    rows = [
        ("v1", "patient.name", 0, "", "Doctor babu", "", "", {}),
        ("v1", "patient.age", 0, "", "58", "", "", {}),
        ("v1", "chief_complaints", 0, "", "Redness", "RE", "redness and pain", {"duration": "evening"}),
        ("v1", "chief_complaints", 1, "", "redness", "RE", "redness", {}),
        ("v1", "chief_complaints", 2, "", "Fever", "", "no fever", {}),
        ("v1", "history.systemic", 0, "", "Diabetes (sugar)", "", "i have sugar for ten years", {"duration": "10 years"}),
        ("v1", "history.systemic", 1, "", "Asthma", "", "any pressure or asthma", {}),
        ("v1", "history.allergy", 0, "", "none known", "", "", {}),
        ("v1", "examination", 0, "", "Intraocular pressure", "RE", "right eye 18", {"result": "18 mmHg"}),
        ("v1", "examination", 1, "", "Visual acuity", "RE", "vision 6/9", {"result": "6/60"}),
        ("v1", "examination", 2, "", "Retinoscopy", "", "", {"result": ""}),
        ("v1", "clinical_findings", 0, "", "Redness", "RE", "redness", {}),
        ("v1", "diagnosis", 0, "", "Nuclear cataract", "RE", "cataract surgery is planned", {"grade": ""}),
        ("v1", "medications", 0, "", "Moxifloxacin", "RE", "use moxifloxacin four times daily", {"frequency": "twice daily", "phase": "current"}),
        ("v1", "medications", 1, "", "Prednisolone", "RE", "", {}),
        ("v1", "procedures", 0, "", "Injection", "RE", "if it gets worse", {"notes": "if it gets worse"}),
        ("v1", "investigations", 0, "", "Blood test", "BE", "no need for the blood test", {"purpose": ""}),
        ("v1", "investigations", 1, "", "OCT macula", "BE", "oct", {}),
        ("v1", "investigations", 2, "", "Slit lamp examination", "BE", "slit lamp", {}),
        ("v1", "advice", 0, "", "Wash hands", "", "wash your hands often", {}),
        ("v1", "advice", 1, "", "Warm compress", "", "warm compress at bedtime", {}),
        ("v1", "advice", 2, "", "Come back after one week", "", "come back after one week", {}),
        ("v2", "follow_up", 0, "", "", "", "", {"when": "এক সপ্তাহ পরে", "purpose": ""}),
    ]
    items = spark.createDataFrame(rows, "visit string, section string, idx int, kb_id string, name string, eye string, evidence string, attrs map<string,string>")
    visits = spark.createDataFrame([("v1", heard), ("v2", "এক সপ্তাহ পরে আবার আসবেন")], "visit string, text string")
    return items, visits


def terms(spark: SparkSession) -> DataFrame:
    rows = [
        ("MED-001", "medicine", "Moxifloxacin 0.5%", ["Moxi", "MFX"], ["laal chokh er drop"], {"caution": "none"}),
        ("DIS-001", "disease", "Dry eye disease", ["DED", "dry eye"], ["chokh shukiye jawa"], {}),
        ("SYM-001", "symptom", "Watering", ["tearing", "epiphora"], ["chokh diye jol pora khub beshi hoy"], {}),
    ]
    return spark.createDataFrame(rows, "id string, category string, name string, aliases array<string>, colloquial array<string>, details map<string,string>")


def visits(spark: SparkSession) -> DataFrame:
    """Invented conversations: a clean one with a misheard name and a denial, a looping one, one in Bengali."""
    rows = [
        ("v1", "I have dry eye in the right eye and watering for three days. The doctor gave me moxi floxacin and MFX drops. There is no epiphora now and the pain is in the left side.", None, "en", 20.0, 0.9, 0.05),
        ("v2", "drops " * 60, None, "en", 30.0, 0.5, 0.5),
        ("v3", "চোখ লাল আছে, চোখ দিয়ে জল পড়ে না, মক্সিফ্লক্সাসিন দিন রাতে সকালে একটু ব্যথা আছে ডান চোখে", "The eye is red. Give moxifloxacin at night.", "Bengali", 25.0, 0.8, 0.1),
    ]
    return spark.createDataFrame(rows, "visit string, text string, english string, language string, seconds double, confidence double, low_ratio double")
