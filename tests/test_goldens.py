"""Results derived by hand from the described semantics."""

from pyspark.sql import functions as F

from dossier.functions import classify as C
from dossier.functions import measures as M
from dossier.functions import text as X
from dossier.functions.entities import entities
from dossier.operators import quality, timeline
from dossier.plans.texts import best_match
from dossier.functions.lexicon import ICD_INJURIES


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_quality_scores(spark):
    """8 and 11 of 13 fields; one critical anomaly."""
    none = F.array().cast("array<struct<anomaly_type:string,severity:string,field:string>>")
    critical = F.array(F.struct(F.lit("x").alias("anomaly_type"), F.lit("critical").alias("severity"), F.lit("f").alias("field")))
    for present, found, want in ((8, none, (0.6154, 0.6154)), (11, none, (0.8462, 0.8462)), (8, critical, (0.6154, 0.3654))):
        r = quality.quality_report({str(i): F.lit(i < present) for i in range(13)}, found)
        assert one(spark, r["completeness"], r["overall"]) == want
        assert len(one(spark, r["missing"])[0]) == 13 - present


def test_toxic_levels(spark):
    for s, amount, want in (("ethanol", 30, "therapeutic"), ("ethanol", 75, "elevated"), ("ethanol", 150, "toxic"), ("ethanol", 400, "lethal"), ("ethanol", 10000, "elevated"), ("cocaine", 0, "therapeutic"), ("cocaine", 50, "elevated"), ("organophosphate", 7, "lethal"), ("water", 7, "")):
        assert one(spark, C.tox_level(F.lit(s), F.lit(float(amount)))) == (want,)


def test_units(spark):
    for value, unit, target, want in ((98.6, "°F", None, (37.0, "celsius")), (185.0, "lbs", None, (83.9145, "kilograms")), (10.0, "oz", None, (283.495, "grams")), (3.0, "yd", "cm", (3.0, "yards"))):
        assert one(spark, *M.convert(F.lit(value), F.lit(unit), None if target is None else F.lit(target))) == want


def test_dates(spark):
    for said, want in (("03/04/2024", ("2024-03-04T00:00:00", "exact")), ("13/04/2024", ("2024-04-13T00:00:00", "exact")), ("2024-07", ("2024-07-01T00:00:00", "day")), ("1999", ("1999-01-01T00:00:00", "estimated")), ("D:20240115143000+05'30'", ("2024-01-15T14:30:00", "exact"))):
        at, precision = M.parse_timestamp(F.lit(said))
        assert one(spark, M.iso(at), precision) == want


def test_cascade_meets_its_own_words(spark):
    assert one(spark, X.resolve_synonyms(F.lit("rigor mortis"))) == ("rigor mortis mortis",)
    assert one(spark, X.resolve_synonyms(F.lit("death stiffness"))) == ("rigor mortis mortis",)
    assert one(spark, X.resolve_synonyms(F.lit("nothing here"))) == ("nothing here",)


def test_standardizing_hides_labels(spark):
    done = X.resolve_synonyms(X.standardize_text(F.lit("COD: asphyxia\nMOD: suicide")))
    assert one(spark, F.size(entities(done, ["CAUSE_OF_DEATH", "MANNER_OF_DEATH"]))) == (0,)
    assert one(spark, F.size(entities(F.lit("COD: asphyxia\nMOD: suicide"), ["CAUSE_OF_DEATH", "MANNER_OF_DEATH"]))) == (2,)


def test_codes(spark):
    terms = spark.createDataFrame([("laceration",), ("deep laceration over scalp",), ("nothing",)], "term string")
    got = {r.term: (r.code, r.confidence, r.is_exact) for r in best_match(terms, ICD_INJURIES).collect()}
    assert got == {"laceration": ("T14.1", 0.95, True), "deep laceration over scalp": ("T14.1", 0.7, False)}


def test_death_time_match_conflicts_and_gps(spark):
    assert one(spark, M.hours_since_death(F.lit(31.0))) == (4.0,)
    t = [F.to_timestamp(F.lit(f"2024-01-01 10:{x}")) for x in ("00:00", "04:59", "05:01")]
    assert one(spark, *timeline.source_match(t)) == (False, 301.0)
    assert one(spark, *timeline.source_match([F.lit(None).cast("timestamp")] * 3)) == (None, None)
    e = spark.createDataFrame([(0, 3, "c"), (1, 1, "c"), (2, 2, "c")], "seq int, t int, k string").withColumn("e", F.col("t"))
    assert [(r.event_1, r.event_2) for r in timeline.conflicts(e, [F.col("seq")], "t", "e", "k").collect()] == [(3, 1)]
    empty = F.lit(None).cast("string")
    found = quality.anomalies(F.current_timestamp(), {}, F.lit("0"), F.lit("0"), empty, F.lit(1), F.lit(5))
    assert [a.anomaly_type for a in one(spark, found)[0]] == ["suspicious_gps"]
    assert one(spark, *M.checked_location(F.lit(0.0), F.lit(0.0))) == (0.0, 0.0, None)


def test_confidence_override_and_clamp(spark):
    rows = [(1, "f", 1, "VALIDATED", None), (1, "f", 2, "INFERRED", None), (1, "f", 3, "X", 1.7), (1, "f", 4, "DEFAULT_VALUE", None)]
    df = spark.createDataFrame(rows, "id int, field string, n int, kind string, o double")
    got = [(r.before, r.after) for r in quality.confidence_steps(df, ["id", "field"], "n", "kind", "o").orderBy("ord").collect()]
    assert got == [(1.0, 1.0), (1.0, 0.7), (0.7, 1.0), (1.0, 0.5)]
    assert quality.audit(quality.confidence_steps(df, ["id", "field"], "n", "kind", "o"), "id").first().composite == 0.5
