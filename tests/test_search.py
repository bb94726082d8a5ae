"""Synonyms, their log, and spans of entities against Python's own patterns."""

import random
import re

from pyspark.sql import functions as F

from dossier.functions import entities as E
from dossier.functions import text as X
from dossier.plans.inputs import view


def plain(text):
    log = []
    for term, new, cat in X.synonym_rules():
        p = re.compile(rf"\b{re.escape(term)}\b", re.I)
        log += [(m.group(), new, cat, 0.9, m.start()) for m in reversed(list(p.finditer(text)))]
        text = p.sub(lambda _, new=new: new, text)
    return text, log


def test_synonyms_and_log_on_texts_of_rule_words(spark):
    """Words of terms and of what rules write, in any order: rules call for each other over seams."""
    r = random.Random(0)
    words = [w for t, n, _ in X.synonym_rules() for w in re.findall(r"\S+", f"{t} {n}")] + ["the", "É", "x", "—"]
    terms = [t for t, _, _ in X.synonym_rules()]
    texts = [None, ""] + ["".join(r.choice([w, w.upper()]) + r.choice([" ", " ", "-", ", ", "\n", "_", "'"]) for w in r.choices(words, k=r.randrange(1, 40))) for _ in range(300)]
    texts += [" ".join(r.choice([r.choice(terms), r.choice(words)]) for _ in range(r.randrange(1, 20))) for _ in range(300)] + ["bleeding " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for x in df.select("t", X.resolve_synonyms(F.col("t")).alias("r"), X.synonym_log(F.col("t")).alias("log")).collect():
        assert (x.r, [tuple(y) for y in x.log]) == (plain(x.t) if x.t is not None else (None, []))


def test_spans_match_python_and_hold_the_values(spark):
    flags = {E.FLAGS: re.I, E.DOT: re.I | re.S, "(?uUd)": re.NOFLAG}
    compiled = [(k, re.compile(p.replace(r"\z", r"\Z"), flags[f])) for k, p, f, _ in E.PATTERNS]
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "😀 M.L.C. No 7, Dr. A Bee, MD; c.o.d: heart gave out.\nTOD: noon\nskull Kidneys: pale and swollen\nFIR No: 9 1. Wound of arm 2. Incised")], "id long, text string")
    both = view(spark, "/root/testdata/sf0.001", "reports").select("id", "text").where("id % 5 = 1").union(odd)
    for x in both.select("text", E.entity_spans(F.col("text")).alias("s"), E.entities(F.col("text")).alias("e")).collect():
        assert [tuple(y) for y in x.s] == [(k, m.start(), m.end()) for k, p in compiled for m in p.finditer(x.text or "")]
        held = {(y.entity_type, x.text[y.start : y.end]) for y in x.s}
        assert all(any(k == e.entity_type and e.raw_value[:200] in t for k, t in held) for e in x.e)
