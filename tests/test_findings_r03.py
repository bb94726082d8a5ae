"""What the findings of round 3 asked for."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from dossier.plans.texts import codes_by_type

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_codes_of_entities_read_the_texts_once(spark):
    """one pass without join or shuffle; ties of length go to the first key of the dictionary."""
    assert not [w for w in ("Join", "Aggregate", "Union") if w in plan(entry.queries()["cls11_ontology"](spark, SMALL))]
    rows = [(1, "INJURY", " Burn "), (2, "INJURY", "rib"), (3, "INJURY", "nothing"), (4, "CAUSE_OF_DEATH", "burns all over"), (5, "ANATOMICAL_REFERENCE", "brain"), (6, "TOXICOLOGY_FINDING", "x"), (7, "INJURY", None), (8, "INJURY", " "), (9, "OTHER", "burn")]
    got = {x.id: (x.term, x.code, x.system, x.confidence) for x in codes_by_type(spark.createDataFrame(rows, "id int, entity_type string, normalized_value string")).collect()}
    assert got[1] == ("burn", "T30.0", "ICD-10", 0.95) and got[2] == ("rib", "S22.4", "ICD-10", 0.7) and got[4] == ("burns all over", "T30", "ICD-10", 0.7)
    assert got[5][2:] == ("ANATOMICAL_HIERARCHY", 0.9) and set(got) == {1, 2, 4, 5}


def test_encoding_of_late_and_of_short_western_letters(spark):
    """letters behind 8192 plain bytes, and a few in a row that could be Cyrillic ones."""
    from dossier.functions.encoding import encoding

    texts = ["plain " * 3000 + "café", "Anaieux éé èçou éç ê.", "No asdo de la ññmi.", "éé", "plain words " * 9 + "àé"]
    df = spark.createDataFrame([(i, bytearray(t.encode("latin-1"))) for i, t in enumerate(texts)], "i int, b binary")
    assert {x.i: x.n for x in df.select("i", encoding(F.col("b"))[0].alias("n")).collect()} == dict.fromkeys(range(5), "iso-8859-1")
    late = spark.createDataFrame([(bytearray(("x" * 9000 + "é—😀").encode()),)], "b binary")
    assert late.select(encoding(F.col("b"))[0]).first()[0] == "utf-8"


def test_tasks_of_key_views_have_bounded_rows(spark, tmp_path):
    """one split with many keys becomes tasks of bounded rows, and no row is lost."""
    from dossier.session import TASK_ROWS
    from dossier.plans.inputs import view

    n = 5 * TASK_ROWS
    spark.range(n).select(F.col("id").alias("o_orderkey"), F.lit(1.5).alias("o_totalprice")).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    for name in ("reports", "metadata"):
        sizes = [r[1] for r in view(spark, str(tmp_path), name).groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == n and max(sizes) <= 1.1 * TASK_ROWS


def test_pivot_tables_propose_pairs_to_the_similarity_search(spark):
    """close fingerprints meet by the pivot tables, also where no bucket has both; sets verify them."""
    from dossier.llm.shingles import alike_sets, fingerprinted_sets
    from dossier.llm.simhash import pivot_links

    base = [f"w{i * i % 9973}" for i in range(4000)]
    texts = [" ".join(base), " ".join(base[:2000] + ["other"] + base[2001:]), " ".join(base[::-1]), ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = fingerprinted_sets(df, 5, "doc_id", "text").withColumns({"rep": F.col("doc_id"), "low": F.col("doc_id"), "bands": F.array().cast("array<bigint>")})
    reps = spark.createDataFrame(made.collect(), made.schema)
    proposed = pivot_links(reps)
    links = alike_sets(df, reps, proposed, 5, 28, 0.8, "doc_id", "text").collect()
    assert {tuple(sorted(x)) for x in links} == {(0, 1)}


def test_files_are_dealt_over_tasks(spark, tmp_path):
    """one split of customers becomes tasks of bounded rows."""
    from dossier.plans.files import files
    from dossier.session import TASK_ROWS

    n = 3 * TASK_ROWS
    spark.range(n).selectExpr("id AS c_custkey", "'n' AS c_name", "3 AS c_nationkey").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    sizes = [r[1] for r in files(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == n and max(sizes) <= 1.1 * TASK_ROWS


def test_batches_to_and_from_python_are_bounded(spark):
    """long rows come in small batches, and large results go back before a batch is done."""
    import numpy as np

    from dossier.operators.pixels import mapped
    from dossier.plans.inputs import table

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    table(spark, SMALL, "documents")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    images = spark.createDataFrame([(i, 2, 1, bytearray([i, i])) for i in range(12)], "id int, width int, height int, pixels binary").coalesce(1)
    out = mapped(images, lambda a: np.full((1500, 1500), a[0, 0], np.uint8))
    assert sorted((x.id, x.width, x.n, x.b) for x in out.selectExpr("id", "width", "length(pixels) AS n", "hex(substring(pixels, 1, 1)) AS b").collect()) == [(i, 1500, 2250000, f"{i:02X}") for i in range(12)]


def test_median_by_exchanges_is_the_median():
    """same values as before, without sorting nine floats a pixel (np.median is not called any more)."""
    from unittest import mock

    import numpy as np

    from dossier.operators.pixels import median3, shifts

    r = np.random.default_rng(0)
    for h, w in ((1, 1), (1, 7), (2, 2), (40, 31), (3, 200)):
        a = r.integers(0, 256, (h, w), np.uint8)
        want = np.median(shifts(a), 0)
        with mock.patch("numpy.median", side_effect=AssertionError):
            got = median3(a)
        assert got.dtype == np.float64 and (got == want).all()


def test_log_of_plain_texts_is_made_in_batches():
    """no pattern is compiled or split at for each text; texts with odd letters stay null for the JVM."""
    import re

    import pyarrow as pa

    from dossier.functions import text as X

    texts = ["Heart attack, HEART ATTACK; kneecap\nbleeding " * 3, "É kneecap — GSW_ gsw pt", None, "", "ſ kneecap", "kneecap \x1c", "x"]
    want = []
    for t in texts:
        log, now = [], t or ""
        for term, new, cat in X.synonym_rules():
            p = re.compile(rf"\b{re.escape(term)}\b", re.I)
            log += [(m.group(), new, cat, 0.9, m.start()) for m in reversed(list(p.finditer(now)))]
            now = p.sub(lambda _, new=new: new, now)
        want.append(log)
    got = X._plain_log.func(pa.array(texts)).to_pylist()
    assert [i for i, x in enumerate(got) if x is None] == [2, 4, 5] and len(want[0]) > 6
    assert all(x is None or [tuple(y.values()) for y in x] == w for x, w in zip(got, want))


def test_spans_of_plain_and_of_odd_texts(spark):
    """plain texts go through one batch function, others through marks in the JVM; both tell the same places."""
    from dossier.functions import entities as E

    text = "p.m no: 7-1, PM No: PM/12/24\nAge: 41 years Sex: F\nCase No 9/1 Injury No. 1: deep wound Injury 2: burn Opinion 1. Wound of arm 2. Incised neck\nCOD: c.o.d: heart \x01gave out.\nheart: pale @ and large, heartless heart\nEthanol 30 mg Dr. A Bee, MD"
    df = spark.createDataFrame([(0, text), (1, text.replace("@", "ſ")), (2, text.replace("@", "×")), (3, None), (4, ""), (5, text.replace("@", "İ"))], "i int, t string")
    made = df.select("i", E.entity_spans(F.col("t")).alias("s"))
    assert "_plain_spans" in plan(made)
    got = {x.i: [tuple(y) for y in x.s] for x in made.collect()}
    assert len(got[0]) > 12 and got[1] == got[0] == got[2] == got[5] and got[3] == got[4] == []


def test_running_values_backwards_are_made_once(spark):
    """F8: no window frame that ends with the block, as each row would read the rest of its block again."""
    from dossier.operators.scan import ordered, running

    rows = ordered(spark.range(3000).selectExpr("id AS at", "(id * 7919) % 3001 AS v"), [], ["at"], 6)
    made = running(rows, [], {"low": ("min", F.when(F.col("at") % 10 == 0, F.col("v")))}, backwards=True)
    assert "unboundedfollowing" not in plan(made).lower()
    v, want, low = [i * 7919 % 3001 for i in range(3000)], {}, None
    for i in reversed(range(3000)):
        low = min(x for x in (low, v[i] if i % 10 == 0 else None, 10**9) if x is not None)
        want[i] = low if low < 10**9 else None
    assert {x.at: x.low for x in made.collect()} == want


def test_layout_of_documents_is_made_in_their_rows(spark, tmp_path):
    """Nothing but ids is shuffled; rows that share an id still make one document."""
    from dossier.operators import layout
    from dossier.plans.inputs import view

    words = " ".join(f"w{i}" for i in range(150))
    rows = [(1, words), (2, ""), (3, None), (None, "a b"), (4, "  a \t b" * 9), (5, "one"), (5, "  two three"), (6, "é " * 700), (-7, words)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "a" / "documents.parquet"))
    q = entry.queries()
    lines = layout.lines(view(spark, str(tmp_path / "a"), "words"), ["doc_id", "page", "line"])
    pages = layout.pages(lines, "doc_id", "page", "line")
    tuples = lambda df, c: sorted(tuple(round(v, 3) if isinstance(v, float) else v for v in (x[n] for n in c)) for x in df.collect() if x.doc_id != 5)
    # of equal places in one line the order is open: of id 5 only counts are compared
    for name, plain, c in (("agg10_lines", lines, ["doc_id", "page", "line", "text", "x", "y", "w", "h", "confidence"]), ("agg11_pages", pages, ["doc_id", "page", "text", "confidence"])):
        made = q[name](spark, str(tmp_path / "a"))
        assert tuples(made, c) == tuples(plain, c)
        assert made.where("doc_id = 5").count() == plain.where("doc_id = 5").count() == 1
    assert sorted("one two three".split()) == sorted(q["agg11_pages"](spark, str(tmp_path / "a")).where("doc_id = 5").first().text.split())
    want = {x.doc_id: x.pages for x in layout.documents(pages, "doc_id", "page").collect()}
    assert {x.doc_id: x.pages for x in q["agg11_documents"](spark, str(tmp_path / "a")).collect()} == want
    spark.createDataFrame(rows[:4], "doc_id long, text string").repartition(8).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    for name in ("agg10_lines", "agg11_pages", "agg11_documents"):
        assert "Aggregate" not in plan(q[name](spark, str(tmp_path / "b")))


def test_recognized_reports_are_made_in_their_rows(spark, tmp_path):
    """lines and pages are not shuffled; reports that share an id are still grouped."""
    keys = [1, 2, 3, 30, 31, 7, 7]
    q = entry.queries()["udf08_recognized"]
    for name, some in (("a", keys), ("b", keys[:5])):
        spark.createDataFrame([(k,) for k in some], "o_orderkey long").write.parquet(str(tmp_path / name / "orders.parquet"))
    both = {x.id: x for x in q(spark, str(tmp_path / "a")).collect()}
    alone = q(spark, str(tmp_path / "b"))
    assert "Aggregate" not in plan(alone) and sorted(both) == [1, 2, 3, 7, 30, 31]
    assert {x.id: x for x in alone.collect()} == {i: x for i, x in both.items() if i != 7}
