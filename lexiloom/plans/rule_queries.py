"""A registered query for each record rule: the rule alone over the drafts of ``scenes``, and SQL that gives the same items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import grounding as G
from ..operators import rules as R
from . import scenes
from .registry import ORACLES, QUERIES, plain

_SHOWN = ("section", "idx", "kb_id", "name", "eye", "result", "frequency", "phase", "duration", "character", "when", "purpose", "status")


def _shown(items):
    at = lambda c: F.col(c) if c in R.Draft.columns else R.attr(c)
    return items.select("visit", *[at(c).alias("when_said" if c == "when" else c) for c in _SHOWN])


def _register(query_name: str, rule, keep: str = "true", ctes: str = "", source: str = "base", **to: str) -> None:
    """``keep``: which items of ``source`` stay; ``to``: what becomes of a column. Both in SQL."""

    def run(spark, sf_dir):
        d = R.Draft(*scenes.draft(spark, sf_dir), lambda x: x)
        rule(d)
        return _shown(d.items.where("alive"))

    run.__name__ = query_name
    QUERIES[query_name] = run
    cols = ", ".join(f'{to.get(c, f"""{chr(34)}{c}{chr(34)}""")} as {"when_said" if c == "when" else c}' for c in _SHOWN)
    ORACLES[query_name] = f"with {scenes.SQL}{ctes} select visit, {cols} from {source} where {keep}"


def _has(column: str, pattern: str) -> str:
    """regexp_matches with a pattern whose (?<![a-z]) and (?![a-z]) are written out for an engine without look-around."""
    p = pattern.replace("(?<![a-z])", "(?:^|[^a-z])").replace("(?![a-z])", "(?:[^a-z]|$)").replace("(?<![A-Za-z])", "(?:^|[^A-Za-z])").replace("(?![A-Za-z])", "(?:[^A-Za-z]|$)")
    return f"regexp_matches({column}, '{p.replace(chr(39), chr(39) * 2)}')"


def _in(*sections: str) -> str:
    return "section in (" + ", ".join(f"'{s}'" for s in sections) + ")"


_WORDS = "list_filter(string_split({0}, ' '), lambda x: x <> '')"
_HEAD = "string_split({0}, ' ')[1]"

# --- what is dropped ------------------------------------------------------------------------

_label = "coalesce(nullif(name, ''), brand_said)"
_register(
    "rule_medicines_heard",
    R.k1_medicines_heard,
    f"""not ({_in("medications")} and (({_label} = '' and kb_id = '') or not (
  (length({_HEAD.format("nn")}) >= 5 and contains(hn, {_HEAD.format("nn")})) or (length({_HEAD.format("bn")}) >= 5 and contains(hn, {_HEAD.format("bn")})) or contains(' ' || hn || ' ', ' ' || ln || ' ')
  or (length({_HEAD.format("ln")}) >= 8 and len(list_filter({_WORDS.format("hn")}, lambda t: levenshtein(t, {_HEAD.format("ln")}) <= 2)) > 0) or positive = 'true')))""",
    ctes=f", n as (select *, {plain('heard')} as hn, {plain(_label)} as ln, {plain('name')} as nn, {plain('brand_said')} as bn from base)",
    source="n",
)
_register("rule_allergy", R.k3_allergy, f"not ({_in('history.allergy')} and name <> '' and not {_has('heard', '(?i)allerg|sulfa|reaction to')})")
_register(
    "rule_current_medicines", R.k8_current_medicines, f"not ({_in('history.current_medications')} and {_has('trim(name)', '(?i)^(?:diabet[a-z]*|sugar|hypertension|bp|blood pressure|thyroid|asthma|cholesterol)$')})"
)
_register("rule_clinic_tests", R.k21_clinic_tests, f"not ({_in('investigations')} and {_has('name', '(?i)slit.?lamp|tonometr|fundus|refraction|visual acuity|retinoscop|ophthalmoscop')})")
_register(
    "rule_not_needed",
    R.k16_not_needed,
    f"not ({_in('procedures', 'medications', 'investigations')} and {_has('notes || chr(32) || purpose || chr(32) || evidence', '(?i)not (?:required|indicated|needed|necessary|advised)|no need')})",
)
_EV = r"""list_transform(list_filter(string_split_regex(lower({0}), '[\s,।.?!;:()"''“”‘’\-–—/]+'), lambda t: length(t) >= 2), lambda t: case when length(t) >= 4 then left(t, 4) else t end)"""
_register(
    "rule_evidence",
    R.k15_evidence,
    f"not ({_in('advice')} and not (len(ev) > 0 and len(list_filter(ev, lambda t: list_contains(tr, t))) * 10 >= len(ev) * 6))",
    ctes=f", n as (select *, {_EV.format('evidence')} as ev, {_EV.format('heard')} as tr from base)",
    source="n",
)
_greets = ", ".join(f"'{w}'" for w in R.GREETING)
_register(
    "rule_patient",
    R.k7_patient,
    f"""not ({_in("patient.name")} and ({_has("name", "(?i)^(?:(?:patient|rogi|doctor)[ ,.]*)+$")} or (len(ws) > 0 and (2 * len(list_filter(ws, lambda w: w in ({_greets}))) >= len(ws) or {_has("name", "(?i)babu|(?<![a-z])(?:dr|doctor)(?![a-z])")}))))
  and not ({_in("patient.age")} and name <> '' and ((heard <> '' and not {_has("heard", "(?i)(?<![a-z])aged?(?![a-z])|years? old|yrs? old")}) or not {_has("name", "(?i)^[0-9]{1,3}(?: *(?:y|yr|yrs|years?|m|months?))?$")} or coalesce(try_cast(regexp_extract(name, '^([0-9]+)', 1) as int), 0) > 110))""",
    ctes=f", n as (select *, {_WORDS.format(plain('name'))} as ws from base)",
    source="n",
)

# --- what is repeated -----------------------------------------------------------------------


def _repeats(key: str, keep: str = "true") -> tuple[str, str]:
    ctes = f""", n as (select *, case when {keep} then {key} else '' end as key from base),
r as (select *, row_number() over (partition by visit, section, key order by idx) as rank from n)"""
    return ctes, "key = '' or rank = 1"


_ctes, _keep = _repeats(plain("evidence"), f"{_in('advice')} and length({plain('evidence')}) >= 6")
_register("rule_advice_repeats", R.k19_advice_repeats, _keep, _ctes, "r")
_parts = {"name": f"coalesce(nullif(kb_id, ''), {plain('name')})", "finding": f"coalesce(nullif({plain('name')}, ''), kb_id)", "eye": "eye", "id": "kb_id"}
_key = "case " + " ".join(
    f"when section = '{s}' then " + " || '|' || ".join(_parts.get(p, plain(f'"{p}"') if p in scenes.FIELDS else "''") for p in spec.split(",")) for s, spec in R.KEYS.items()
) + " else '' end"
_ctes, _keep = _repeats(f"(select case when replace(k, '|', '') = '' then '' else k end from (select {_key} as k))")
_register("rule_dedupe", R.k25_dedupe, _keep, _ctes, "r")

# --- what is changed ------------------------------------------------------------------------

_register("rule_medicine_ids", R.k9_medicine_ids, name=f"case when {_in('medications')} and regexp_full_match(name, '[A-Z]{{3}}-[0-9]{{3}}') then coalesce(nullif(label, ''), name) else name end")


def _per_day(s: str) -> str:
    steps = ("every hour|hourly", 24), ("every (?:two|2) hours", 12), ("every (?:four|4) hours|six times|6 times", 6), ("four times|4 times|every (?:six|6) hours", 4), ("three times|thrice|3 times|every (?:eight|8) hours", 3)
    steps += ("twice|two times|2 times|morning and (?:night|evening)", 2), ("once|one time|1 time|at (?:night|bedtime)|every (?:night|morning)", 1)
    return "case " + " ".join(f"when regexp_matches(lower({s}), '{p}') then {n}" for p, n in steps) + " end"


_short = "upper(regexp_replace(frequency, '[^A-Za-z]', '', 'g'))"
_written = f"case when {_short} in ('QID', 'QDS') then 4 when {_short} in ('TID', 'TDS') then 3 when {_short} in ('BD', 'BID') then 2 when {_short} in ('OD', 'HS') then 1 else {_per_day('frequency')} end"
_told = "case said when 24 then 'hourly' when 1 then 'once daily' when 2 then 'twice daily' else said || ' times daily' end"
_register(
    "rule_frequency",
    R.k10_frequency,
    ctes=f""", p as (select *, case when length(string_split(name, ' ')[1]) > 0 then strpos(lower(heard), lower(string_split(name, ' ')[1])) else 0 end as place from base),
n as (select *, case when place > 0 then {_per_day("string_split_regex(substr(heard, place, 120), '[.!?।]')[1]")} end as said, {_written} as written from p)""",
    source="n",
    frequency=f"case when {_in('medications')} and said is not null and frequency <> '' and said is distinct from written then {_told} else frequency end",
)
_surgery = "(?i)surgery|operation|operate|phaco|sics|lasik|laser|injection"
_register(
    "rule_phase",
    R.k11_phase,
    ctes=", n as (select *, count(*) filter (section = 'procedures') over (partition by visit) as procedures from base)",
    source="n",
    phase=f"case when {_in('medications')} and procedures = 0 and not {_has('heard', _surgery)} and regexp_matches(phase, '(?i)(?:pre|post)[- ]?op') then '' else phase end",
)
_name = "name"
for _kind, _said in (("nuclear", "(?i)nuclear"), ("cortical", "(?i)cortical"), ("posterior subcapsular", "(?i)subcapsular|(?<![a-z])pscc?(?![a-z])")):
    _name = f"case when section = 'diagnosis' and contains(lower({_name}), '{_kind}') and not {_has('heard', _said)} then 'Cataract (type not specified)' else {_name} end"
_register("rule_subtype", R.k12_subtype, name=_name)
_systemic = "(?i)blood|sugar|glucose|hba1c|fbs|ppbs|rbs|ecg|ekg|(?<![a-z])bp(?![a-z])|urine|creatinine|cbc|h(?:a)?emogram|lipid|x-?ray|chest|serolog|hiv|hbsag|hcv|thyroid|tsh|physician"
_register("rule_systemic_eye", R.k13_systemic_eye, eye=f"case when {_in('investigations')} and {_has('name', _systemic)} and not {_has('name', '(?i)tonometr|intraocular')} then '' else eye end")
_timed = f"({_in('chief_complaints')} and {_has('trim(duration)', '(?i)^(?:at |in the )?(?:morning|afternoon|evening|night|bedtime|daytime)$')})"
_number = "(?i)[0-9]|(?<![a-z])(?:one|two|three|four|five|six|seven|eight|nine|ten|few|several)(?![a-z])"
_register(
    "rule_fields",
    R.k14_fields,
    duration=f"case when {_timed} then '' when {_in('history.systemic')} and duration <> '' and evidence <> '' and not {_has('evidence', _number)} then '' else duration end",
    character=f"case when {_timed} then case when \"character\" <> '' then \"character\" || ', ' else '' end || 'worse in the ' || regexp_replace(duration, '(?i)^(?:at|in the) +', '') else \"character\" end",
    phase=f"case when {_in('medications')} and phase = 'current' then '' else phase end",
    status=f"case when {_in('medications')} and status = '' then 'new' else status end",
)
_if = "(?i)(?<![a-z])if(?![a-z])|in case|unless"
_cond = f"({_in('procedures')} and ({_has('notes', _if)} or {_has('evidence', _if)}))"
_register(
    "rule_conditional",
    R.k17_conditional,
    section=f"case when {_cond} then 'advice' else section end",
    idx=f"case when {_cond} then idx + 1000 else idx end",
    name=f"case when {_cond} then name || ' — only ' || case when {_has('notes', _if)} then regexp_replace(notes, '(?i)^(?:to be )?(?:considered )?', '') else 'if the condition changes, as discussed' end else name end",
)
_macula = f"({_in('investigations')} and {_has('name', '(?i)macula')} and not {_has('heard', '(?i)macula')})"
_register("rule_macula", R.k20_macula, name=f"case when {_macula} then trim(regexp_replace(name, '(?i) *\\(? *(?:of +(?:the +)?)?maculr?a?r? *\\)?', '', 'g')) else name end")
_plan = f"({_in('advice')} and {_has('trim(name)', '(?i)(?<![a-z])(?:i|we)(?:''ll| will) (?:check|see|recheck|measure)')})".replace("''''", "''")
_register(
    "rule_advice",
    R.k22_advice,
    section=f"case when {_plan} then 'follow_up' else section end",
    purpose=f"case when {_plan} then case when regexp_matches(name, '(?i)pressure') then 'Recheck eye pressure' when regexp_matches(name, '(?i)vision') then 'Recheck vision' else name end else purpose end",
)
_english = ", ".join(f"'{k}': '{v}'" for k, v in R.ENGLISH.items())


def _to_english(c: str) -> str:
    return f"""case when {_in("follow_up", "medications")} and regexp_matches("{c}", '[\\x{{0900}}-\\x{{09FF}}]') then array_to_string(list_transform(string_split("{c}", ' '), lambda w: coalesce(map {{{_english}}}[w], w)), ' ') else "{c}" end"""


_register("rule_english", R.k24_english, when=_to_english("when"), frequency=_to_english("frequency"), duration=_to_english("duration"))
_spell = lambda c: f"trim(regexp_replace(array_to_string(list_filter(string_split(replace(replace({c}, 'oedema', 'edema'), 'haemorrh', 'hemorrh'), ' '), lambda w: w not in ('in', 'of', 'the', 'right', 'left', 'both', 'eye', 'eyes', 're', 'le', 'be')), ' '), ' +', ' ', 'g'))"
_back = f"(section = 'advice' and {_has('trim(name)', '(?i)^(?:come back|come again|review|follow.?up|revisit|see me|return)(?![a-z])')})"
_disease = "(?i)npdr|pdr|csme|dme|amd|glaucoma|cataract|keratitis|conjunctivitis|retinopathy|degeneration|uveitis|pterygium|presbyopia|myopia|blepharitis|dry eye"
_register(
    "rule_layout",
    R.k18_layout,
    f"""not (section = 'clinical_findings' and ((length(s) >= 4 and (contains(exam, s) or (contains(dx, s) and regexp_matches(name, '{_disease}')))) or list_contains(cc, s)))""",
    ctes=f""", s as (select *, {_spell(plain("name"))} as s, {_spell(plain("result"))} as sr, {_spell(plain("grade"))} as sg from base),
n as (select *, coalesce(string_agg(case when section = 'examination' then sr end, ' | ') over (partition by visit), '') as exam,
  coalesce(string_agg(case when section = 'diagnosis' then sg || ' ' || s end, ' | ') over (partition by visit), '') as dx,
  coalesce(list(s) filter (section = 'chief_complaints') over (partition by visit), []) as cc from s)""",
    source="n",
    section=f"case when {_back} then 'follow_up' else section end",
    when=f"""case when {_back} then coalesce(nullif(trim(regexp_replace(name, '(?i)^(?:come back|come again|review|follow.?up|revisit|return) *(?:after|in)? *', '')), ''), name) else "when" end""",
    eye="case when section = 'history.ocular' and regexp_matches(name, '(?i)family|mother|father|sibling|brother|sister') then '' else eye end",
)


# --- examination: values, said numbers, method and time ---------------------------------------

_pressure = "(?i)pressure|(?<![a-z])iop(?![a-z])|tonometr|intraocular|(?<![a-z])nct(?![a-z])|applanation"
_acuity = "(?i)acuity|vision|(?<![a-z])va(?![a-z])|ucva|bcva|pinhole|snellen"
_value = "(?i)[0-9]|(?<![a-z])(?:cf|fc|hm|hmcf|pl|npl|pr|nlp|counting fingers?|hand movements?|perception of light|no perception)(?![a-z])"
_methods = (("NCT", "(?i)(?<![a-z])nct(?![a-z])|non.?contact|air.?puff"), ("AT", "(?i)applanation|goldmann|(?<![a-z])gat(?![a-z])"), ("RT", "(?i)rebound|icare"))
_numbers = "map {" + ", ".join(f"'{w}': {n}.0" for w, n in {"zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}.items()) + "}"
_named, _heard_methods, _any_method = "name", [], []
for _m, _p in _methods:
    _named = f"case when pressure and {_has(_named, f'(?<![A-Za-z]){_m}(?![A-Za-z])')} and not {_has('heard', _p)} then trim(regexp_replace({_named}, ' *\\(? *{_m} *\\)?', '', 'g')) else {_named} end"
    _heard_methods.append(f"case when {_has('heard', _p)} then '{_m}' end")
    _any_method += [_has("named", _p), _has("named", f"(?<![A-Za-z]){_m}(?![A-Za-z])")]
_register(
    "rule_examination",
    R.k5_examination,
    f"""not (exam and ((not measured and trim(result) = '') or (measured and (not {_has("result", _value)} or len(list_filter(nums, lambda x: not list_contains(told, x))) > 0))))""",
    ctes=f""", m as (select *, section = 'examination' as exam, {_has("name", _pressure)} or {_has("name", _acuity)} as measured, section = 'examination' and {_has("name", _pressure)} as pressure,
  list_transform(regexp_extract_all(result, '[0-9]+(?:\\.[0-9]+)?'), lambda x: x::double) as nums,
  list_concat(list_transform(regexp_extract_all(heard, '[0-9]+(?:\\.[0-9]+)?'), lambda x: x::double), list_transform(list_filter(regexp_split_to_array(lower(heard), '[^a-z]+'), lambda w: map_contains({_numbers}, w)), lambda w: {_numbers}[w]::double)) as told,
  list_filter([{", ".join(_heard_methods)}], lambda x: x is not null) as methods from base),
q as (select *, {_named} as named from m),
n as (select *, named || case when pressure and len(methods) = 1 and not ({" or ".join(_any_method)}) then ' (' || methods[1] || ')' else '' end as new_name,
  regexp_extract(heard, '(?is)(?:pressure|iop|tonometr|intraocular|nct|applanation).{{0,140}}?((?:[01]?[0-9]|2[0-3])[:.][0-5][0-9](?:\\s*[ap]m)?)', 1) as clock from q)""",
    source="n",
    name="new_name",
    result="""case when pressure and clock <> '' and not regexp_matches(result, '[0-9]{1,2}[:.][0-9]{2}') then result || case when regexp_matches(result, '(?i)mm ?hg') then '' else ' mmHg' end || ' at ' || lower(clock) else result end""",
)


# --- after the rules: grounding ---------------------------------------------------------------


def missing_fields(spark, sf_dir):
    items, _ = scenes.draft(spark, sf_dir)
    d = items.where("section = 'medications'").select("visit", "idx", "name", "eye", R.attr("frequency").alias("frequency"), R.attr("duration").alias("duration"))
    return G.missing_fields(d).select("visit", "idx", F.concat_ws(",", "missing").alias("missing"))


QUERIES["missing_fields"] = missing_fields
ORACLES["missing_fields"] = f"""
with {scenes.SQL}, m as (select visit, idx, list_filter([case when frequency = '' then 'frequency' end, case when duration = '' then 'duration' end, case when eye = '' then 'eye' end], lambda x: x is not null) as gaps from base where section = 'medications')
select visit, idx, array_to_string(gaps, ',') as missing from m where len(gaps) > 0"""


def coverage_of_items(spark, sf_dir):
    items, visits = scenes.draft(spark, sf_dir)
    d = R.Draft(items, visits, lambda x: x)
    d.look(d.of_texts(lines=X.normalize(F.col("heard"))))
    d = d.items.where("name <> ''").withColumn("own", X.normalize(F.col("name")))
    return d.select("visit", "section", "idx", G.covered(F.col("own"), F.col("lines")).alias("covered"), G.same_quote(F.col("evidence"), F.col("name")).alias("same"))


QUERIES["coverage_of_items"] = coverage_of_items
_content = "list_filter(string_split(nn, ' '), lambda w: length(w) >= 3 and w not in ('the', 'and', 'with', 'for', 'was', 'are', 'has', 'have', 'that', 'this', 'from'))"
ORACLES["coverage_of_items"] = f"""
with {scenes.SQL}, m as (select visit, section, idx, {plain("name")} as nn, {plain("heard")} as hn, {plain("evidence")} as en from base where name <> ''), c as (select *, {_content} as ws from m)
select visit, section, idx, len(ws) > 0 and len(list_filter(ws, lambda w: contains(' ' || hn, ' ' || w) or (length(w) >= 5 and contains(' ' || hn, left(w, 5))))) * 10 >= len(ws) * 6 as covered,
  en = nn or (length(en) >= 6 and contains(nn, en)) or (length(nn) >= 6 and contains(en, nn)) as same from c"""


def repaired_sections(spark, sf_dir):
    """Items of the next visit in number play the answer to a repair request."""
    items, _ = scenes.draft(spark, sf_dir)
    cols = ["visit", "section", "idx", "name"]
    own, more = items.select(*cols), items.select((F.col("visit") - 1).alias("visit"), "section", (F.col("idx") + 100).alias("idx"), "name").join(items.select("visit").distinct(), "visit", "left_semi")
    return G.repair_merge(own, more)


QUERIES["repaired_sections"] = repaired_sections
ORACLES["repaired_sections"] = f"""
with {scenes.SQL}, n as (select visit, count(*) filter (section = 'chief_complaints') as c, count(*) filter (section in ('examination', 'clinical_findings')) as e from base group by visit),
more as (select b.visit - 1 as visit, section, (idx + 100)::int as idx, name, c, e from base b join n on n.visit = b.visit - 1)
select visit, section, idx, name from base union all select visit, section, idx, name from more
where (section = 'chief_complaints' and c = 0) or (section in ('examination', 'clinical_findings') and (e = 0 or regexp_matches(name, '(?i)fundus|retina|disc|macula|vitre|cup')))"""


def unspoken_sections(spark, sf_dir):
    items, visits = scenes.draft(spark, sf_dir)
    return G.empty_sections(visits, items)


QUERIES["unspoken_sections"] = unspoken_sections
ORACLES["unspoken_sections"] = f"""
with {scenes.SQL}, spoken as (select visit, 'chief_complaints' as section from visits where regexp_matches(heard, '(?i)pain|itch|red|water|blur|complain|trouble')
  union all select visit, 'examination' from visits where regexp_matches(heard, '(?i)vision|pressure|slit|fundus|6/[0-9]'))
select * from spoken s where not exists (select 1 from base b where b.visit = s.visit and b.section = s.section)"""


def rule_procedures(spark, sf_dir):
    d = R.Draft(*scenes.draft(spark, sf_dir), lambda x: x)
    R.k6_procedure_fallback(d)
    return d.items.where("alive and section = 'procedures'").select("visit", "idx", "name", "evidence")


QUERIES["rule_procedures"] = rule_procedures
_names = ", ".join(f"'{p}'" for p in R.PROCEDURES)
ORACLES["rule_procedures"] = f"""
with {scenes.SQL}, t as (select visit, {plain("heard")} as t from visits),
f as (select visit, p, left(trim(string_split(t, p)[-1]), 45) as after from t, (select unnest([{_names}]) as p) where contains(t, p)),
n as (select visit, p from f where regexp_matches(after, '{R.PLANNED}') and not {_has("after", R.DONE)} and not exists (select 1 from base b where b.visit = f.visit and b.section = 'procedures' and {plain("b.name")} = p)),
last as (select visit, max(idx) as i from base where section = 'procedures' group by visit)
select visit, idx, name, evidence from base where section = 'procedures' union all
select n.visit, (coalesce(i, -1) + row_number() over (partition by n.visit order by p))::int, p, p from n left join last on last.visit = n.visit"""
