"""Text cleaning and rewriting as column functions; all stay in the JVM unless said otherwise."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import ship_package
from .lexicon import ABBREVIATIONS, SYNONYMS

#: Java flags that make matching follow Unicode and lines end at \n only.
FLAGS = "(?iuUd)"
#: Stands around or for matches, in texts that have none.
MARK = "\x01"
#: Met in texts that Java's and Python's patterns may read differently; of all others both make the same words, blanks and cases.
ODD = re.compile("[^\x00-\x1b\x20-\x7f\xa0\xb0\xb7\xc0-\xff\u2013\u2014\u2018\u2019\u201c\u201d]")


def literal_map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def bind(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with ``x`` evaluated once, however often f uses it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def lookup(table: dict[str, str], key: Column, default: Column | None = None) -> Column:
    """Value of a small fixed table; ``default`` (null if absent) where the key is unknown.

    Literal maps are searched one key after another, so larger tables are one map for each key length.
    """
    by_length: dict[int, dict[str, str]] = {}
    for k, v in table.items():
        by_length.setdefault(len(k), {})[k] = v

    def find(k: Column) -> Column:
        chain = F.when(F.lit(False), F.lit(None).cast("string"))
        for n, part in by_length.items():
            chain = chain.when(F.length(k) == n, F.try_element_at(literal_map(part), k))
        return chain

    found = F.try_element_at(literal_map(table), key) if len(table) <= 16 else bind(key, find)
    return found if default is None else F.coalesce(found, default)


class _Remembered(dict):
    def __init__(self, f: Callable):
        super().__init__()
        self.f = f

    def __missing__(self, piece: str):
        found = self.f(piece)
        if len(piece) <= 64:
            if len(self) >= 1 << 16:
                self.clear()
            self[piece] = found
        return found


def remembered(f: Callable) -> Callable:
    """f of a piece of text; what it gives is kept for at most 65,536 pieces of 64 characters or less, as words repeat."""
    return _Remembered(f).__getitem__


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))


def nfc(c: Column) -> Column:
    """Unicode NFC; there is no built-in, so texts with more bytes than characters go through Arrow, others as null.

    A condition around the call would not spare them: Python columns are computed for all rows first.
    """
    return F.coalesce(_nfc(F.when(F.octet_length(c) > F.length(c), c)), c)


def collapse_spaces(c: Column) -> Column:
    """Runs of blanks and tabs become one blank and every line is stripped; line breaks stay."""
    one = F.regexp_replace(c, r"[ \t]{2,}+|\t", " ")  # a single blank stays as it is
    return F.regexp_replace(one, r"(?md)(?U)^[\s\x1c-\x1f&&[^\n]]+|[\s\x1c-\x1f&&[^\n]]+$", "")


def drop_controls(c: Column) -> Column:
    return F.regexp_replace(c, r"[\p{Cc}&&[^\n\r\t]]", "")


def unix_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def clean_text(c: Column, normalize: bool = True) -> Column:
    """NFC, blanks, control characters, line ends, ends of the text, in this order; null and empty pass."""
    return strip(unix_lines(drop_controls(collapse_spaces(nfc(c) if normalize else c))))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")


def expand_abbreviations(c: Column) -> Column:
    """Whole words that are abbreviations once lower-cased and freed of .,;:() are written out; single blanks between words."""
    said = F.transform(words(c), lambda w: lookup(ABBREVIATIONS, F.trim(F.lower(w), F.lit(".,;:()")), w))
    return F.array_join(said, " ")


#: Spelling rules after the abbreviations, for approximations, years, weights and heights; none reaches over a blank.
SPELLINGS = ((r"\b(approx\.?|approximately)\b", "approximately"), (r"\b(yr|yrs|y\.o\.)\b", "years old"), (r"\b(wt|wgt)\b", "weight"), (r"\b(ht|hgt)\b", "height"))


@remembered
def _plain_standard(word: str) -> str:
    out = ABBREVIATIONS.get(word.lower().strip(".,;:()"), word)
    for pattern, new in SPELLINGS:
        out = re.sub(pattern, new, out, flags=re.I)
    return out


@F.arrow_udf(T.StringType())
def _plain_standardized(texts: pa.Array) -> pa.Array:
    """Null for null texts and those that are not plain; what a word becomes is remembered."""
    return pa.array([None if t is None or ODD.search(t) else " ".join(map(_plain_standard, t.split())) for t in texts.to_pylist()], pa.string())


def standardize_text(c: Column) -> Column:
    """Abbreviations, then the spelling rules."""
    out = expand_abbreviations(c)
    for pattern, new in SPELLINGS:
        out = F.regexp_replace(out, FLAGS + pattern, new)
    return out


def batch_standardize(c: Column) -> Column:
    """As standardize_text, for columns of tables: plain texts go through Python in batches, others stay in the JVM.

    The call is marked as nondeterministic, as a later call that reads its result must not be merged into one projection with it.
    """
    ship_package(SparkSession.active())
    return F.coalesce(_plain_standardized.asNondeterministic()(c), standardize_text(c))


def synonym_rules() -> list[tuple[str, str, str]]:
    """(term, canonical term, category), longest terms first, otherwise in the order of the tables."""
    rules = [(k, v, cat) for cat, table in SYNONYMS.items() for k, v in table.items()]
    return sorted(rules, key=lambda r: -len(r[0]))


def _first_word(term: str) -> str:
    return re.match(r"\w+", term)[0]


@cache
def synonym_index() -> tuple[dict[str, list[int]], list[str]]:
    """First word of a term -> numbers of the rules that a text with that word may need.

    These are the rules whose terms begin with it and, over and over, those that what they write can call for.
    """
    rules = synonym_rules()
    by_word: dict[str, set[int]] = {}
    for i, (term, _, _) in enumerate(rules):
        by_word.setdefault(_first_word(term), set()).add(i)
    # what a rule writes may stand beside words of the text, so a written word calls for terms that hold it anywhere
    holding = {w: {i for i, (t, _, _) in enumerate(rules) if w in re.findall(r"\w+", t)} for _, new, _ in rules for w in re.findall(r"\w+", new.lower())}
    closed = {}
    for word, own in by_word.items():
        found, todo = set(own), list(own)
        while todo:
            called = set().union(*(holding[w] for w in re.findall(r"\w+", rules[todo.pop()][1].lower()))) - found
            found |= called
            todo += called
        closed[word] = sorted(found)
    return closed, list(closed)


def _needed_rules(low: Column) -> Column:
    """Numbers of the rules that a lower-case text may need, ascending: its words are split off once and looked up."""
    closed, firsts = synonym_index()
    met = F.array_intersect(F.split(low, r"(?U)\W+"), F.array(*map(F.lit, firsts)))
    by_length = {n: F.create_map(*[x for w in firsts if len(w) == n for x in (F.lit(w), F.array(*map(F.lit, closed[w])))]) for n in sorted(set(map(len, firsts)))}

    def numbers(w: Column) -> Column:
        found = F.when(F.lit(False), F.array().cast("array<int>"))
        for n, table in by_length.items():
            found = found.when(F.length(w) == n, F.element_at(table, w))
        return found

    return F.array_sort(F.array_distinct(F.flatten(F.transform(met, numbers))))


def by_number(i: Column, made: list[Callable[[], Column]], first: int = 0) -> Column:
    """The column of number ``i``, by halving: every rule keeps a pattern of its own, which is compiled once."""
    if len(made) == 1:
        return made[0]()
    half = len(made) // 2
    return F.when(i < first + half, by_number(i, made[:half], first)).otherwise(by_number(i, made[half:], first + half))


def _java(new: str) -> str:
    return new.replace("\\", "\\\\").replace("$", "\\$")


def _whole(term: str) -> str:
    return rf"{FLAGS}\b{re.escape(term)}\b"


def resolve_synonyms(c: Column) -> Column:
    """Every rule in turn over what the ones before it left, whole words in any case.

    The text's words are split off once; only rules whose terms begin with one of them, and rules that what
    these write can call for, run over the text, in the order of all rules.
    """
    rules = synonym_rules()
    rule = lambda now, i: by_number(i, [lambda t=t, new=new: F.regexp_replace(now, _whole(t), _java(new)) for t, new, _ in rules])
    return bind(c, lambda t: bind(_needed_rules(F.lower(F.upper(t))), lambda some: F.when(F.coalesce(F.size(some), F.lit(0)) < 1, t).otherwise(F.aggregate(some, t, rule))))


def batch_resolve(c: Column) -> Column:
    """As resolve_synonyms, for columns of tables, in the manner of batch_standardize."""
    ship_package(SparkSession.active())
    return F.coalesce(_plain_resolved.asNondeterministic()(c), resolve_synonyms(c))


LOG = "array<struct<original:string,resolved:string,category:string,confidence:double,position:int>>"


def match_starts(text: Column, pattern: Column, found: Column) -> Column:
    """Where the matches ``found`` of a pattern begin, in code points: the pieces between them tell."""
    lengths = bind(F.split(text, pattern, -1), lambda pieces: F.transform(found, lambda m, i: F.struct(F.length(F.get(pieces, i)).alias("gap"), F.length(m).alias("own"))))
    step = lambda z, x: F.struct((z["at"] + x["gap"] + x["own"]).alias("at"), F.concat(z["out"], F.array(z["at"] + x["gap"])).alias("out"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(lengths, start, step, lambda z: z["out"])


def places_of(low: str, some: list[str]) -> list[int]:
    """Where any of the words begins in a text, in order."""
    places = []
    for w in some:
        at = low.find(w)
        while at >= 0:
            places.append(at)
            at = low.find(w, at + 1)
    return sorted(places)


def matched(pattern: re.Pattern, text: str, places: list[int]) -> list[re.Match]:
    """Matches as of finditer, of a pattern whose matches begin at some of these places, in order."""
    found, rest = [], 0
    for at in places:
        if at >= rest and (m := pattern.match(text, at)):
            found.append(m)
            rest = m.end()
    return found


@cache
def _plain_rules() -> list[tuple]:
    return [(term, re.compile(rf"\b{re.escape(term)}\b"), new) for term, new, _ in synonym_rules()]


@remembered
def _called_rules(piece: str) -> frozenset[int]:
    """Numbers of the rules that the words of a piece between blanks call for."""
    closed, _ = synonym_index()
    return frozenset(n for w in re.findall(r"\w+", piece) for n in closed.get(w, ()))


def _logged(text: str) -> tuple[str, list[tuple[str, int, int]]]:
    """A plain text resolved, and (original, rule, position) of the substitutions in the order of the log."""
    out, low, rules = [], text.lower(), _plain_rules()
    for n in sorted(set().union(*map(_called_rules, set(low.split())))):
        term, pattern, new = rules[n]
        if found := [m.span() for m in matched(pattern, low, places_of(low, [term]))]:
            out += [(text[i:j], n, i) for i, j in reversed(found)]
            gaps = list(zip([0, *[j for _, j in found]], [*[i for i, _ in found], len(text)]))
            text, low = new.join(text[i:j] for i, j in gaps), new.lower().join(low[i:j] for i, j in gaps)
    return text, out


@F.arrow_udf(T.StringType())
def _plain_resolved(texts: pa.Array) -> pa.Array:
    """Null for null texts and those that are not plain."""
    return pa.array([None if t is None or ODD.search(t) else _logged(t)[0] for t in texts.to_pylist()], pa.string())


_LOG_ROW = T.StructType([*[T.StructField(n, T.StringType()) for n in ("original", "resolved", "category")], T.StructField("confidence", T.DoubleType()), T.StructField("position", T.IntegerType())])


@F.arrow_udf(T.ArrayType(_LOG_ROW))
def _plain_log(texts: pa.Array) -> pa.Array:
    """Null for null texts and those that are not plain."""
    ends, said = [0], []
    for text in texts.to_pylist():
        if text is None or ODD.search(text):
            ends[-1:] = [None, ends[-1]]
            continue
        said += _logged(text)[1]
        ends.append(len(said))
    rules = synonym_rules()
    number = pa.array([n for _, n, _ in said], pa.int32())
    columns = [pa.array([x for x, _, _ in said], pa.string()), *[pa.array([r[k] for r in rules], pa.string()).take(number) for k in (1, 2)], pa.array([0.9] * len(said), pa.float64()), pa.array([at for _, _, at in said], pa.int32())]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, _LOG_ROW.names))


def synonym_log(c: Column) -> Column:
    """The substitutions of resolve_synonyms with places in the text as it was then, last match of a rule first.

    Spark's patterns tell no places, so plain texts go through Python's in batches; others are cut at the matches in the JVM.
    """
    ship_package(SparkSession.active())
    return F.coalesce(_plain_log(c), _cut_log(c))


def _cut_log(c: Column) -> Column:
    def said(text: Column, term: str, new: str, cat: str) -> Column:
        row = lambda m, at: F.struct(m.alias("original"), F.lit(new).alias("resolved"), F.lit(cat).alias("category"), F.lit(0.9).alias("confidence"), at.alias("position"))
        rows = lambda found: bind(match_starts(text, F.lit(_whole(term)), found), lambda at: F.reverse(F.transform(found, lambda m, i: row(m, F.get(at, i)))))
        return bind(F.regexp_extract_all(text, F.lit(_whole(term)), F.lit(0)), rows).cast(LOG)

    def one(now: Column, term: str, new: str, cat: str) -> Column:
        return F.struct(F.regexp_replace(now["t"], _whole(term), _java(new)).alias("t"), F.concat(now["log"], said(now["t"], term, new, cat)).alias("log"))

    rules = synonym_rules()
    rule = lambda now, i: by_number(i, [lambda r=r: one(now, *r) for r in rules])
    none = F.array().cast(LOG)
    folded = lambda t: bind(_needed_rules(F.lower(F.upper(t))), lambda some: F.aggregate(some, F.struct(t.alias("t"), none.alias("log")), rule, lambda z: z["log"]))
    return F.when(c.isNull(), none).otherwise(bind(c, folded))


def resolve_term(c: Column) -> tuple[Column, Column, Column]:
    """(canonical term, confidence, category) of a single term: 0.9 if it is known, else the term itself and 1.0."""
    key = F.trim(F.lower(c))
    flat = {k: v for table in SYNONYMS.values() for k, v in table.items()}
    known = lookup(flat, key)
    category = lookup({k: cat for cat, table in SYNONYMS.items() for k in table}, key, F.lit("unknown"))
    return F.coalesce(known, c), F.when(known.isNotNull(), 0.9).otherwise(1.0), category


def script_language(c: Column) -> Column:
    """hin, eng+hin, eng or unknown, by Devanagari and ASCII letters."""
    hindi, latin = F.regexp_count(c, F.lit(r"[\x{0900}-\x{097F}]")), F.regexp_count(c, F.lit("[A-Za-z]"))
    return F.when(F.coalesce(hindi + latin, F.lit(0)) == 0, "unknown").when(hindi > latin, "hin").when(hindi > 0, "eng+hin").otherwise("eng")


def output_confidence(c: Column) -> Column:
    """How far a model's transcript may be trusted, by length, section words, gaps marked illegible and measurements."""
    n = F.size(words(c))
    marked = F.lower(c).rlike("cause of death|post-mortem|autopsy|examination|findings|opinion")
    gaps = F.regexp_count(c, F.lit(r"\[ILLEGIBLE\]"))
    score = F.lit(0.5) + F.when(n > 100, 0.15).when(n > 50, 0.10).when(n > 20, 0.05).otherwise(0.0)
    score += F.when(marked, 0.10).otherwise(0.0) + F.when(gaps == 0, 0.10).when(gaps > 5, -0.15).otherwise(0.0)
    score += F.when(c.rlike(r"\d+\.?\d*\s*(?:cm|mm|kg|gm|ml|mg)"), 0.05).otherwise(0.0)
    return F.when(F.coalesce(c, F.lit("")) == "", 0.0).otherwise(F.round(F.greatest(F.lit(0.1), F.least(F.lit(0.95), score)), 4))


def tolerant_json(c: Column) -> Column:
    """JSON (as variant) from a reply that may be fenced or wrapped in prose; null if there is none."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"\A```(?:json)?", ""), r"```\z", ""))
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.try_parse_json(bare), F.try_parse_json(F.nullif(inner, F.lit(""))))


def section(c: Column, name: str) -> Column:
    """What a named section says, up to the next heading: over 10 characters, at most 2000; else null."""
    heads = "External|Internal|Opinion|Cause|Manner|Toxicology|Histopathology"
    body = strip(F.regexp_extract(c, rf"{FLAGS}(?s)(?:{re.escape(name)}\s*[:\-]?\s*\n?)(.*?)(?=\n\s*(?:{heads})|\z)", 1))
    return F.when(F.length(body) > 10, F.left(body, F.lit(2000)))
