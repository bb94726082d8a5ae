"""What the findings of round 4 asked for."""

from pyspark.sql import functions as F

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
ODD = "\u017f\u0130\x1c\u212a\u00b2\u65e5"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_encoding_of_few_words_of_accented_letters(spark):
    """words of accented letters alone, in few others, are Western; Cyrillic ones use more letters, short and among Latin ones too."""
    from dossier.functions.encoding import encoding

    western = ["Onqueque de èê de, du.", "Èêenvi ç un queon ouou èèêé.", "ñó", "Éèê", "ééê ñíñó de"]
    cyrillic = ["Смерть ночью", "Vermerk: тело найдено ночью, Zeuge Meier", "Наступила"]
    rows = [(t, bytearray(t.encode("latin-1")), "iso-8859-1") for t in western]
    rows += [(f"{c} {t}", bytearray(t.encode(c)), n) for t in cyrillic for c, n in (("cp1251", "windows-1251"), ("koi8_r", "koi8-r"))]
    df = spark.createDataFrame(rows, "t string, b binary, want string")
    assert {x.t: x.n for x in df.select("t", encoding(F.col("b"))[0].alias("n")).collect()} == {t: w for t, _, w in rows}


def test_codes_are_looked_up_for_different_terms_only(spark):
    """the lookup stays above the grouping; below it, it would make the text anew for each key of the dictionary."""
    for name, code in (("jn10_icd_injuries", "S06.3"), ("jn10_icd_causes", "I21")):
        p = plan(entry.queries()[name](spark, SMALL))
        assert code in p[: p.index("Aggregate")] and code not in p[p.index("Aggregate") :]


def reports_of_pieces(n: int) -> list[str]:
    """Texts of pieces that patterns and rules look for, joined by chance, some with letters that make them odd."""
    import random

    r = random.Random(4)
    some = ["P.M. No: 12/24", "pm no 7-1", "Case No. 9/1", "M.L.C No: x", "mlc no", "FIR No 3", "Name of deceased: Asha Rao", "name: lena katz, ", "Age: 41 years", "age 7 yrs", "Sex: M", "gender- FEMALE", "sex: f", "Cause of Death: heart\x0bgave out.", "COD: x", "c.o.d.: stab wound", "Manner of Death: Homicide", "mod:", "M.O.D.: Suicide"]
    some += ["Time of Death: 4", "PMI: 6 h", "T.O.D - late", "Performed by: Dr. Meera Nair, MBBS", "dr. a bee, MD", "Dr A. Bee Pathologist", "Injury No. 1: deep wound of arm", "injury 2 - burn", "Injury: none", "1. Incised neck 2. Wound of arm", "3. lacerated scalp", "External", "Internal", "Opinion: drowned", "ethanol: positive", "Blood Alcohol: 80 mg/dL", "ALCOHOL 30 mg / dL", "Cocaine not detected"]
    some += ["cannabis trace", "Organophosphorus - 4.5 units", "aluminium phosphide: positive", "ALUMINIUM PHOSPHIDE 3 g", "lead: trace", "Heart: pale and large", "heart", "HEART, brain", "lungs: wet and heavy", "lung: no", "Kidneys - congested both", "bladder: empty", "uterus", "skull", "approx 2 cm", "Approx. 3", "approximately", "5 yr old", "6 Y.O. man", "7 y.o.x", "wt 40", "wgt", "ht. 5", "h/o HTN and DM.", "pt brought", "GSW to chest"]
    some += ["kneecap", "heart attack", "(RTA)", "rigor", "death stiffness", "", " ", "\xa0", "\t", "é", "É à", "×", "-", ":", "12.5 x 3 cm", "\x01", "\x02"]
    out = []
    for i in range(n):
        parts = [r.choice(some) for _ in range(r.randrange(1, 40))] + ([r.choice(ODD)] if i % 5 == 0 else [])
        r.shuffle(parts)
        out.append("".join(p + r.choice(["\n", "\n", " ", " ", "\n\n", ""]) for p in parts))
    return out + ["heart " * 70, "x" * 100 + "heart: " + "y" * 100, "", None]


def test_entities_of_plain_and_of_odd_texts(spark):
    """plain texts go through one batch function; what it finds is what the JVM's patterns find."""
    from dossier.functions import entities as E

    df = spark.createDataFrame([(t,) for t in reports_of_pieces(400)], "t string").repartition(4)
    kinds = ["INJURY", "CAUSE_OF_DEATH", "ANATOMICAL_REFERENCE", "TOXICOLOGY_FINDING"]
    batch, some = E.plain_entities(None)(F.col("t")), E.plain_entities(kinds)(F.col("t"))
    found = df.select("t", E.batch_entities(F.col("t")).alias("e"), E.entities(F.col("t")).alias("j"), batch.alias("b"), E.batch_entities(F.col("t"), kinds).alias("e4"), E.entities(F.col("t"), kinds).alias("j4"), some.alias("b4")).collect()
    assert all(x.e == x.j and x.e4 == x.j4 for x in found), [x for x in found if x.e != x.j or x.e4 != x.j4][:1]
    assert {x.b is None for x in found if x.t is None or any(c in x.t for c in ODD)} == {True}
    assert sum(x.b is not None and x.b == x.j and x.b4 == x.j4 for x in found) > 300
    assert {y.entity_type for x in found for y in x.b or []} == {kind for kind, *_ in E.PATTERNS}
    assert "made(" in plan(entry.queries()["ent11_all_entities"](spark, SMALL))


def test_metadata_search_only_what_they_use(spark):
    """no pattern of organs, anatomy or toxicology runs for the metadata of autopsies, and plain texts go in batches."""
    p = plan(entry.queries()["cls12_13_autopsy_metadata"](spark, SMALL))
    assert "made(" in p and "ORGAN_FINDING" not in p and "TOXICOLOGY_FINDING" not in p and "INJURY" in p


def test_rewriting_of_plain_and_of_odd_texts(spark):
    """standardizing, synonyms and toxicology of plain texts are made in batches, with the JVM's results."""
    from dossier.functions import entities as E
    from dossier.functions import text as X

    df = spark.createDataFrame([(t,) for t in reports_of_pieces(400)], "t string").repartition(4)
    df = df.select("t", X.batch_standardize(F.col("t")).alias("s"), X.batch_resolve(F.col("t")).alias("r"), E.batch_toxicology(F.col("t")).alias("x"), X.standardize_text(F.col("t")).alias("s2"), X.resolve_synonyms(F.col("t")).alias("r2"), E._tox_lines(F.col("t")).alias("x2"), E._plain_toxicology(F.col("t")).alias("b"))
    found = df.collect()
    assert all(x.s == x.s2 and x.r == x.r2 for x in found) and sum(x.r != x.t for x in found) > 100 and sum(x.s != x.t for x in found) > 100
    plain = [x for x in found if x.b is not None]
    assert len(plain) > 300 and all(x.b == x.x2 for x in plain) and sum(len(x.b) > 1 for x in plain) > 50
    assert all((x.x is None) == (x.t is None) and len(x.x or []) == len(x.x2 or []) for x in found)
    for name in ("normalize_all", "normalize_faithful"):
        p = plan(entry.queries()[name](spark, SMALL))
        assert all(p.count(f"{f}(") == 1 for f in ("_plain_standardized", "_plain_resolved", "_plain_toxicology", "made"))


def test_remembered_pieces_are_bounded():
    """Long pieces are not kept, and not more than 65,536."""
    from dossier.functions.text import remembered

    f = remembered(len)
    assert f("x" * 65) == 65 and not f.__self__ and [f(str(i)) for i in range(70_000)][-1] == 5 and len(f.__self__) < 1 << 16
