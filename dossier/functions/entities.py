"""Entities from report texts: patterns, values, and spans."""

from __future__ import annotations

import re
from functools import cache, reduce
from itertools import accumulate
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import ship_package
from .classify import field_injury, field_region, holds_any
from .lexicon import ANATOMY_TERMS, INJURY_STEMS, ORGANS, TOX_STEMS
from .text import FLAGS, MARK, ODD, bind, matched, places_of, remembered, strip

DOT = FLAGS + "(?s)"
# The patterns of report parts.
INJURY_BLOCK = r"(?:Injury\s*(?:No\.?\s*)?\d*\s*[:\-\.]\s*)(.*?)(?=Injury\s*(?:No\.?\s*)?\d+|External|Internal|Opinion|\z)"
INJURY_LIST = r"\d+\.\s*((?:Lacerated|Incised|Contusion|Abrasion|Fracture|Bruise|Wound).*?)(?=\d+\.\s*(?:Lacerated|Incised|Contusion)|$)"
INJURY_NUMBERED = r"Injury\s*(?:No\.?\s*)?\d+\s*[:\-\.]\s*(.*?)(?=Injury\s*(?:No\.?\s*)?\d+|External\s*Examination|Internal|Opinion|\z)"
TOX_LINE = r"(?:(?:Ethanol|Alcohol|Blood\s*Alcohol)\s*[:\-]?\s*)(?:(?:Positive|Negative|Not\s*Detected|[\d\.]+\s*(?:mg|ng|ug)[/\s]*(?:dL|mL|L)).*?)(?:\n|$)"
TOX_NAMED = r"(?:Opiate|Opioid|Cannabis|THC|Barbiturate|Benzodiazepine|Amphetamine|Cocaine|Organophosph\w+|Cyanide)\s*[:\-]?\s*(?:Positive|Negative|Detected|Not\s*Detected|Trace|[\d\.]+\s*\w+)"
TOX_AMOUNT = r"([\d\.]+)\s*((?:mg|ng|ug)/(?:dL|mL|L))"
DIMENSIONS = [
    r"(\d+\.?\d*\s*[xX×]\s*\d+\.?\d*(?:\s*[xX×]\s*\d+\.?\d*)?\s*(?:cm|mm|inch))",
    r"(\d+\.?\d*\s*(?:cm|mm)\s*[xX×]\s*\d+\.?\d*\s*(?:cm|mm))",
    r"(\d+\.?\d*\s*(?:cm|mm)(?:\s*(?:in\s*)?(?:diameter|length|width|depth))?)",
]
DOCTORS = [r"(?:(?:Performed|Conducted)\s*by\s*[:\-]?\s*(?:Dr\.?\s*)?)([A-Z][a-zA-Z\s\.]+?)(?:\n|,|$)", r"(?:Dr\.?\s+)([A-Z][a-zA-Z\s\.]+?)(?:\s*,?\s*(?:MBBS|MD|Pathologist))"]

#: entity type -> (pattern with one group, flags, confidence); fixed patterns, in the order of extraction
PATTERNS: list[tuple[str, str, str, float]] = [
    ("CASE_IDENTIFIER", r"(?:P\.?M\.?\s*No\.?\s*[:\-]?\s*)(\S+[\d/\-]+\S*)", FLAGS, 0.85),
    ("CASE_IDENTIFIER", r"(?:Case\s*No\.?\s*[:\-]?\s*)(\S+[\d/\-]+\S*)", FLAGS, 0.85),
    ("CASE_IDENTIFIER", r"(?:M\.?L\.?C\.?\s*No\.?\s*[:\-]?\s*)(\S+)", FLAGS, 0.85),
    ("CASE_IDENTIFIER", r"(?:FIR\s*No\.?\s*[:\-]?\s*)(\S+)", FLAGS, 0.85),
    ("DECEASED_NAME", r"(?:Name\s*(?:of\s*(?:deceased|dead\s*body))?\s*[:\-]\s*)([A-Z][a-zA-Z\s\.]+?)(?:\n|,|Age)", FLAGS, 0.75),
    ("DECEASED_AGE", r"(?:Age\s*[:\-]?\s*)(\d+)\s*(?:years?|yrs?)", FLAGS, 0.8),
    ("DECEASED_GENDER", r"(?:Sex|Gender)\s*[:\-]\s*(Male|Female|M|F)\b", FLAGS, 0.9),
    ("CAUSE_OF_DEATH", r"(?:Cause\s*of\s*Death|C\.?O\.?D\.?)\s*[:\-]\s*(.*?)(?:\n\n|\n(?=[A-Z])|\.\s*\n|$)", DOT, 0.8),
    ("MANNER_OF_DEATH", r"(?:Manner\s*of\s*Death|M\.?O\.?D\.?)\s*[:\-]\s*(.*?)(?:\n|$)", FLAGS, 0.8),
    ("TIME_OF_DEATH", r"(?:Time\s*of\s*Death|T\.?O\.?D\.?|PMI)\s*[:\-]\s*(.*?)(?:\n|$)", FLAGS, 0.7),
    ("EXAMINING_DOCTOR", DOCTORS[0], "(?uUd)", 0.75),
    ("EXAMINING_DOCTOR", DOCTORS[1], "(?uUd)", 0.75),
    ("INJURY", INJURY_BLOCK, DOT, 0.75),
    ("INJURY", INJURY_LIST, DOT, 0.7),
    *[("TOXICOLOGY_FINDING", rf"({s}\w*\s*[:\-]?\s*(?:positive|negative|detected|not\s*detected|trace|[\d\.]+\s*\w+))", FLAGS, 0.75) for s in TOX_STEMS],
    *[("ANATOMICAL_REFERENCE", rf"\b({t})\b", FLAGS, 0.9) for t in ANATOMY_TERMS],
    *[("ORGAN_FINDING", rf"({o}\s*[:\-]\s*.*?)(?:\n|$)", FLAGS, 0.7) for o in ORGANS],
]
MOST_ANATOMICAL = 50
SPANS = "array<struct<entity_type:string,start:int,end:int>>"
ENTITIES = "array<struct<entity_type:string,raw_value:string,normalized_value:string,confidence:double>>"


def _keep(kind: str, pattern: str, value: Column) -> Column:
    if kind == "CAUSE_OF_DEATH":
        return F.length(value) > 3
    if kind == "ORGAN_FINDING":
        return F.length(value) > 10
    if pattern == INJURY_BLOCK:
        return (F.length(value) > 5) & holds_any(value, INJURY_STEMS)
    return F.lit(True)


def _normal(kind: str, pattern: str, value: Column) -> Column:
    if kind == "DECEASED_GENDER":
        return F.when(F.upper(value).isin("M", "MALE"), "Male").otherwise("Female")
    if kind == "ANATOMICAL_REFERENCE":
        return F.lit(pattern[3:-3])
    return F.left(value, F.lit(300 if kind == "ORGAN_FINDING" else 500))


def entities(text: Column, kinds: list[str] | None = None) -> Column:
    """Array of (entity_type, raw_value, normalized_value, confidence) in the order of PATTERNS; references to anatomy are capped at 50."""
    return bind(F.lower(F.upper(text)), lambda low: _entities(text, low, kinds))


def batch_entities(text: Column, kinds: list[str] | None = None) -> Column:
    """As entities, for columns of tables: plain texts go through Python's patterns in batches, as in entity_spans, others stay in the JVM."""
    ship_package(SparkSession.active())
    return F.coalesce(plain_entities(kinds)(text), bind(text, lambda t: entities(t, kinds)))


def _entities(text: Column, low: Column, kinds: list[str] | None) -> Column:
    parts: dict[str, list[Column]] = {}
    for kind, pattern, flags, confidence in PATTERNS:
        if kinds and kind not in kinds:
            continue
        found = F.transform(F.regexp_extract_all(text, F.lit(flags + pattern), F.lit(1)), strip)
        made = F.transform(F.filter(found, _test(kind, pattern)), _struct(kind, pattern, confidence, 300 if kind == "ORGAN_FINDING" else 500))
        # a plain search for what every match holds spares most patterns
        met = reduce(or_, [F.contains(low, F.lit(w)) for w in _needed(kind, pattern)])
        made = F.when(met, made).otherwise(F.array().cast(ENTITIES))
        parts.setdefault(kind, []).append(made)
    arrays = [F.slice(F.concat(*p), 1, MOST_ANATOMICAL) if k == "ANATOMICAL_REFERENCE" else F.concat(*p) for k, p in parts.items()]
    return F.coalesce(F.concat(*arrays), F.array().cast(ENTITIES))


def _initials(letters: str) -> list[str]:
    """Three letters with or without dots between them."""
    a, b, c = letters
    return [a + x + b + y + c for x in ("", ".") for y in ("", ".")]


#: What a match begins with, by the start of its pattern
_BEGINS = {
    r"(?:P\.?M": ["pm", "p.m"], r"(?:Case": ["case"], r"(?:M\.?L": _initials("mlc"), r"(?:FIR": ["fir"], r"(?:Name": ["name"], r"(?:Age": ["age"], r"(?:Sex": ["sex", "gender"],
    r"(?:Cause": ["cause", *_initials("cod")], r"(?:Manner": ["manner", *_initials("mod")], r"(?:Time": ["time", "pmi", *_initials("tod")], r"(?:(?:Performed": ["performed", "conducted"], r"(?:Dr": ["dr"],
    r"(?:Injury": ["injury"], r"\d+\.\s*((?:Lacerated": ["lacerated", "incised", "contusion", "abrasion", "fracture", "bruise", "wound"],
}


def _needed(kind: str, pattern: str) -> list[str]:
    """Lower-case words of which every match of the pattern holds one."""
    if kind == "TOXICOLOGY_FINDING":
        return [pattern[1:].split("\\w")[0]]
    if kind == "ANATOMICAL_REFERENCE":
        return [pattern[3:-3]]
    if kind == "ORGAN_FINDING":
        return [pattern[1:].split("\\s")[0].removesuffix("s?")]
    return next(words for begin, words in _BEGINS.items() if pattern.startswith(begin))


def _test(kind: str, pattern: str):
    return lambda v: _keep(kind, pattern, v)


def _struct(kind: str, pattern: str, confidence: float, cut: int):
    return lambda v: F.struct(F.lit(kind).alias("entity_type"), F.left(v, F.lit(cut)).alias("raw_value"), _normal(kind, pattern, v).alias("normalized_value"), F.lit(confidence).alias("confidence"))


def entity_spans(text: Column) -> Column:
    """Array of (entity_type, start, end): where the patterns match (whole matches, code points), for highlighting.

    Spark's patterns tell no places, so texts of plain letters go through Python's in batches, in lower case and
    only where a word that a pattern needs is met. Of other texts each pattern marks its matches in the JVM.
    """
    ship_package(SparkSession.active())
    # a mark that is there already becomes another control character, which all patterns treat alike
    marked = lambda t: bind(F.translate(t, MARK, "\x02"), lambda u: bind(F.lower(F.upper(u)), lambda low: _marked_spans(u, low)))
    return F.coalesce(_plain_spans(text), F.when(text.isNotNull(), marked(text)), F.array().cast(SPANS))


@cache
def _matchers() -> tuple[dict[str, list[int]], list[tuple]]:
    """Needed word (up to a blank) -> numbers of its patterns; and (pattern, whether it minds the case, a shorter search) of each
    pattern, for texts in lower case. Matches begin with one of the words; where they do not, the search is given."""
    by_word: dict[str, list[int]] = {}
    found = []
    for i, (kind, pattern, flags, _) in enumerate(PATTERNS):
        cased = "i" not in flags
        low, dot = _lower(pattern, cased), re.S if "(?s)" in flags else 0
        for w in _needed(kind, pattern):
            by_word.setdefault(w.split(" ")[0], []).append(i)
        numbered = low.startswith(r"\d+")
        found.append((re.compile(low, dot), cased, re.compile(low[3:], dot) if numbered else None))
    return by_word, found


def _lower(pattern: str, cased: bool = False) -> str:
    """The pattern in Python's form, for texts in lower case unless it minds the case."""
    low = pattern if cased else re.sub(r"\\.|[A-Z]", lambda m: m[0] if m[0][0] == "\\" else m[0].lower(), pattern)
    return low.replace(r"\z", r"\Z")


@remembered
def _piece_places(piece: str) -> list[tuple[int, list[int]]] | None:
    """(number of a pattern, places where its matches may begin) of a piece between blanks or line ends; None if it is not plain."""
    if ODD.search(piece):
        return None
    by_word, found = _matchers()[0], {}
    low = piece.lower()
    for w, some in by_word.items():
        if w in low:
            for i in some:
                found.setdefault(i, []).append(w)
    return [(i, places_of(low, words)) for i, words in found.items()]


def _matches(text: str, kinds: frozenset[str] | None = None) -> list[tuple[int, list[re.Match]]] | None:
    """(number, matches) of the patterns that a plain text calls for, in their order; None if it is not plain."""
    pieces = text.replace("\n", " ").split(" ")
    called = list(map(_piece_places, pieces))
    if None in called:
        return None
    places: dict[int, list[int]] = {}
    for k, (some, before) in enumerate(zip(called, accumulate(map(len, pieces), initial=0))):
        for i, at in some:
            places.setdefault(i, []).extend([before + k + x for x in at])
    low, matchers, out = text.lower(), _matchers()[1], []
    for i in sorted(places):
        if kinds is not None and PATTERNS[i][0] not in kinds:
            continue
        pattern, cased, shorter = matchers[i]
        if shorter:
            found = list(pattern.finditer(low)) if shorter.search(low) else []
        else:
            found = matched(pattern, text if cased else low, places[i])
        if found:
            out.append((i, found))
    return out


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("entity_type", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def _plain_spans(texts: pa.Array) -> pa.Array:
    """Null for null texts and those that are not plain."""
    ends, kinds, starts, stops = [0], [], [], []
    for text in texts.to_pylist():
        met = None if text is None else _matches(text)
        if met is None:
            ends[-1:] = [None, ends[-1]]
            continue
        for i, found in met:
            for m in found:
                kinds.append(i)
                starts.append(m.start())
                stops.append(m.end())
        ends.append(len(kinds))
    names = pa.array([kind for kind, *_ in PATTERNS]).take(pa.array(kinds, pa.int32()))
    rows = pa.StructArray.from_arrays([names, pa.array(starts, pa.int32()), pa.array(stops, pa.int32())], ["entity_type", "start", "end"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)


def _value(i: int, value: str) -> tuple[str, str] | None:
    """(raw, normalized) of what the pattern of number i found in a plain text; None if it does not count."""
    kind, pattern, *_ = PATTERNS[i]
    if kind == "ANATOMICAL_REFERENCE":
        return value, pattern[3:-3]
    if kind == "DECEASED_GENDER":
        return value, "Male" if value.upper() in ("M", "MALE") else "Female"
    if kind == "CAUSE_OF_DEATH" and len(value) <= 3 or kind == "ORGAN_FINDING" and len(value) <= 10:
        return None
    if pattern == INJURY_BLOCK and not (len(value) > 5 and any(w in value.lower() for w in INJURY_STEMS)):
        return None
    value = value[: 300 if kind == "ORGAN_FINDING" else 500]
    return value, value


_ENTITY = T.StructType([*[T.StructField(n, T.StringType()) for n in ("entity_type", "raw_value", "normalized_value")], T.StructField("confidence", T.DoubleType())])


def plain_entities(kinds: list[str] | None):
    """The function of plain texts; it gives null for null texts and those that are not plain."""
    some = frozenset(kinds) if kinds else None

    @F.arrow_udf(T.ArrayType(_ENTITY))
    def made(texts: pa.Array) -> pa.Array:
        ends, numbers, raw, normal = [0], [], [], []
        for text in texts.to_pylist():
            met = None if text is None else _matches(text, some)
            if met is None:
                ends[-1:] = [None, ends[-1]]
                continue
            anatomical = 0
            for i, found in met:
                if PATTERNS[i][0] == "ANATOMICAL_REFERENCE":
                    found = found[: MOST_ANATOMICAL - anatomical]
                    anatomical += len(found)
                for m in found:
                    start, stop = m.span(1)
                    value = _value(i, text[start:stop].strip())
                    if value:
                        numbers.append(i)
                        raw.append(value[0])
                        normal.append(value[1])
            ends.append(len(numbers))
        number = pa.array(numbers, pa.int32())
        taken = lambda at, form: pa.array([p[at] for p in PATTERNS], form).take(number)
        columns = [taken(0, pa.string()), pa.array(raw, pa.string()), pa.array(normal, pa.string()), taken(3, pa.float64())]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, _ENTITY.names))

    return made


def _marked_spans(text: Column, low: Column) -> Column:
    met = lambda kind, pattern: reduce(or_, [F.contains(low, F.lit(w)) for w in _needed(kind, pattern)])
    row = lambda kind, pattern, flags: F.struct(F.lit(kind).alias("kind"), F.regexp_replace(text, flags + pattern, f"{MARK}$0{MARK}").alias("marked"))
    marked = F.array(*[F.when(met(kind, p), row(kind, p, flags)) for kind, p, flags, _ in PATTERNS])

    def step(z: Column, piece: Column) -> Column:
        end = z["at"] + F.length(piece)
        found = F.array(F.struct(z["kind"].alias("entity_type"), z["at"].alias("start"), end.alias("end")))
        return F.struct(z["kind"].alias("kind"), end.alias("at"), (~z["inside"]).alias("inside"), F.when(z["inside"], F.concat(z["out"], found)).otherwise(z["out"]).cast(SPANS).alias("out"))

    start = lambda x: F.struct(x["kind"].alias("kind"), F.lit(0).alias("at"), F.lit(False).alias("inside"), F.array().cast(SPANS).alias("out"))
    places = lambda x: F.aggregate(F.split(x["marked"], MARK, -1), start(x), step, lambda z: z["out"])
    return F.flatten(F.transform(F.filter(marked, lambda x: F.contains(x["marked"], F.lit(MARK))), places))


#: field -> patterns of which the first with a non-empty value counts; fixed patterns
FIELDS: dict[str, list[str]] = {
    "case_number": [
        r"(?:P\.?M\.?\s*(?:No\.?|Number)\s*[:\-]?\s*)(\S+[\d/\-]+\S*)",
        r"(?:Case\s*(?:No\.?|Number)\s*[:\-]?\s*)(\S+[\d/\-]+\S*)",
        r"(?:PM\s*[:\-]\s*)(\d+[\d/\-]*\d*)",
        r"(?:Post[- ]?Mortem\s*(?:No\.?)\s*[:\-]?\s*)(\S+)",
        r"(?:Autopsy\s*(?:No\.?|Number)\s*[:\-]?\s*)(\S+)",
        r"(?:M\.?L\.?C\.?\s*(?:No\.?)\s*[:\-]?\s*)(\S+)",
        r"(?:FIR\s*(?:No\.?)\s*[:\-]?\s*)(\S+)",
    ],
    "deceased_name": [
        r"(?:Name\s*(?:of\s*(?:deceased|dead\s*body))?\s*[:\-]\s*)([A-Z][a-zA-Z\s\.]+?)(?:\n|,|Age)",
        r"(?:Deceased\s*[:\-]\s*)([A-Z][a-zA-Z\s\.]+?)(?:\n|,|Age)",
        r"(?:Body\s*of\s*)([A-Z][a-zA-Z\s\.]+?)(?:\n|,|was)",
    ],
    "deceased_age": [r"(?:Age\s*[:\-]?\s*)(\d+)\s*(?:years?|yrs?|y\.?o\.?)", r"(?:aged?\s*(?:about\s*)?)(\d+)\s*(?:years?|yrs?)", r"(\d+)\s*(?:years?|yrs?)\s*(?:old|of\s*age)"],
    "deceased_gender": [r"(?:Sex\s*[:\-]\s*)(Male|Female|M|F)", r"(?:Gender\s*[:\-]\s*)(Male|Female|M|F)", r"(?:body\s*of\s*(?:a\s*)?)(male|female)"],
    "cause_of_death": [r"(?s)(?:Cause\s*of\s*Death\s*[:\-]\s*)(.*?)(?:\n\n|\n(?=[A-Z])|$)", r"(?s)(?:C\.?O\.?D\.?\s*[:\-]\s*)(.*?)(?:\n\n|\n(?=[A-Z])|$)", r"(?s)(?:cause\s*of\s*death\s*(?:is|was)\s*)(.*?)(?:\.|$)"],
    "manner_of_death": [r"(?:Manner\s*of\s*Death\s*[:\-]\s*)(.*?)(?:\n|$)", r"(?:M\.?O\.?D\.?\s*[:\-]\s*)(.*?)(?:\n|$)", r"(?:manner\s*of\s*death\s*(?:is|was)\s*)(Natural|Accidental|Suicide|Homicide|Undetermined)"],
    "time_of_death": [r"(?:Time\s*of\s*Death\s*[:\-]\s*)(.*?)(?:\n|$)", r"(?:T\.?O\.?D\.?\s*[:\-]\s*)(.*?)(?:\n|$)", r"(?:death\s*(?:occurred|happened)\s*(?:at|on)\s*)(.*?)(?:\n|$)", r"(?:PMI\s*[:\-]\s*)(.*?)(?:\n|$)"],
    "date_of_examination": [r"(?:Date\s*of\s*(?:Autopsy|Examination|P\.?M\.?)\s*[:\-]\s*)([\d/\-\.]+(?:\s+\d{4})?)", r"(?:Date\s*[:\-]\s*)([\d]{1,2}[/\-\.][\d]{1,2}[/\-\.][\d]{2,4})", r"(?:Dated?\s*[:\-]\s*)([\d]{1,2}[\s\-/\.]+\w+[\s\-/\.]+\d{4})"],
    "examining_doctor": [
        DOCTORS[0],
        r"(?:Doctor\s*[:\-]\s*(?:Dr\.?\s*)?)([A-Z][a-zA-Z\s\.]+?)(?:\n|,|$)",
        r"(?:Pathologist\s*[:\-]\s*(?:Dr\.?\s*)?)([A-Z][a-zA-Z\s\.]+?)(?:\n|,|$)",
        DOCTORS[1],
    ],
}


def report_field(text: Column, name: str) -> Column:
    """The first pattern's non-empty value, at most 500 characters; null if none matches."""
    tries = [F.nullif(strip(F.regexp_extract(text, FLAGS + p, 1)), F.lit("")) for p in FIELDS[name]]
    value = F.left(F.coalesce(*tries), F.lit(500))
    if name == "deceased_gender":
        return F.when(F.upper(value).isin("M", "MALE"), "Male").when(F.upper(value).isin("F", "FEMALE"), "Female").otherwise(value)
    return value


def age_status(age: Column) -> Column:
    return F.when(age.isNull(), None).when(age.try_cast("int").between(0, 150), "valid").otherwise("invalid")


def dimensions(c: Column) -> Column:
    """Measures such as 3 x 2 cm; '' if there are none."""
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(c, FLAGS + p, 1)), F.lit("")) for p in DIMENSIONS], F.lit(""))


def report_injuries(text: Column) -> Column:
    """Array of (description, injury_type, body_region, dimensions) of numbered injuries, at least 5 characters each."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(DOT + p), F.lit(1)) for p in (INJURY_NUMBERED, INJURY_LIST)])
    kept = F.filter(F.transform(found, strip), lambda d: F.length(d) >= 5)
    return F.transform(kept, lambda d: F.struct(F.left(d, F.lit(500)).alias("description"), field_injury(d).alias("injury_type"), field_region(d).alias("body_region"), dimensions(d).alias("dimensions")))


def _tox_lines(text: Column) -> Column:
    return F.transform(F.concat(*[F.regexp_extract_all(text, F.lit(FLAGS + p), F.lit(0)) for p in (TOX_LINE, TOX_NAMED)]), strip)


@cache
def _tox_matchers() -> list[tuple[re.Pattern, list[str]]]:
    """(pattern for texts in lower case, words that its matches begin with)"""
    named = ["opiate", "opioid", "cannabis", "thc", "barbiturate", "benzodiazepine", "amphetamine", "cocaine", "organophosph", "cyanide"]
    return [(re.compile(_lower(p)), some) for p, some in ((TOX_LINE, ["ethanol", "alcohol", "blood"]), (TOX_NAMED, named))]


@F.arrow_udf(T.ArrayType(T.StringType()))
def _plain_toxicology(texts: pa.Array) -> pa.Array:
    """Toxicology lines; null for null texts and those that are not plain."""
    out = []
    for text in texts.to_pylist():
        if text is None or ODD.search(text):
            out.append(None)
            continue
        low = text.lower()
        out.append([text[m.start() : m.end()].strip() for pattern, some in _tox_matchers() for m in matched(pattern, low, places_of(low, some))])
    return pa.array(out, pa.list_(pa.string()))


def report_toxicology(text: Column) -> Column:
    """Array of (substance, result, concentration, unit), split at the first colon or dash."""
    return _tox_records(_tox_lines(text))


def batch_toxicology(text: Column) -> Column:
    """As report_toxicology, for columns of tables, in the manner of batch_entities."""
    ship_package(SparkSession.active())
    return _tox_records(F.coalesce(_plain_toxicology(text), _tox_lines(text)))


def _tox_records(found: Column) -> Column:
    def one(x: Column) -> Column:
        parts = F.split(x, r"[:\-]\s*", 2)
        result = F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
        return F.struct(
            F.trim(F.get(parts, F.lit(0))).alias("substance"),
            F.when(result == "", "detected").otherwise(result).alias("result"),
            F.regexp_extract(result, TOX_AMOUNT, 1).alias("concentration"),
            F.regexp_extract(result, TOX_AMOUNT, 2).alias("unit"),
        )

    return F.transform(found, one)
