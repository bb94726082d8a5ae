"""Queries whose inputs are whole tables and whole texts, against plain versions on small tables."""

import hashlib

import pytest

from dossier.plans.catalogue import QUERIES

TEXTS = {i: " ".join(f"w{i}x{k}" for k in range(n)) for i, n in ((1, 3), (2, 75), (5, 12), (7, 130), (13, 1))}


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("small"))
    rows = [(i, t, "en") for i, t in TEXTS.items()] + [(20, "a\u0007b \t c " * 900 + "the end", "en"), (21, "", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{d}/documents.parquet")
    return d


def plain_pages(doc_id, text):
    """Lines of ten words, pages of six lines, without words of negative confidence."""
    pages = {}
    for k, w in enumerate(text.split(" ")):
        if w.strip() and (doc_id * 7 + k * 13) % 101 - 1 >= 0:
            pages.setdefault(k // 60, {}).setdefault(k % 60 // 10, []).append(w)
    return {p: {n: " ".join(ws) for n, ws in lines.items()} for p, lines in pages.items()}


def test_layout_takes_every_document(spark, small):
    want = {i: plain_pages(i, t) for i, t in TEXTS.items()}
    lines = [x for x in QUERIES["agg10_lines"](spark, small).collect() if x.doc_id in TEXTS]
    assert {(x.doc_id, x.page, x.line): x.text for x in lines} == {(i, p, n): t for i, ps in want.items() for p, ls in ps.items() for n, t in ls.items()}
    pages = {i: {p: "\n".join(ls[n] for n in sorted(ls)) for p, ls in ps.items()} for i, ps in want.items()}
    got = [x for x in QUERIES["agg11_pages"](spark, small).collect() if x.doc_id in TEXTS]
    assert {(x.doc_id, x.page): x.text for x in got} == {(i, p): t for i, ps in pages.items() for p, t in ps.items()}
    docs = {x.doc_id: (x.text_md5, x.pages) for x in QUERIES["agg11_documents"](spark, small).collect() if x.doc_id in TEXTS}
    joined = {i: "\n\n--- Page Break ---\n\n".join(ps[p] for p in sorted(ps)) for i, ps in pages.items()}
    assert docs == {i: (hashlib.md5(t.encode()).hexdigest(), len(pages[i])) for i, t in joined.items() if pages[i]}


def test_cleaning_takes_whole_texts(spark, small):
    """The long text has 900 controls, tabs and runs of spaces; all are cleaned and its end is there."""
    for name, column in (("txt01_clean", "text"), ("txt06_nested_clean", "v")):
        got = {x.doc_id: x[column] for x in QUERIES[name](spark, small).collect()}
        assert got[20] == "ab c " * 900 + "the end\nx \ny"
        assert all(TEXTS[i] in got[i] for i in TEXTS)
    controls = {x.doc_id: x.text for x in QUERIES["txt04_controls"](spark, small).collect()}[20]
    assert "\u0007" not in controls and controls.count("c") == 900
    spaces = {x.doc_id: x.text for x in QUERIES["txt03_spaces"](spark, small).collect()}[20]
    assert "\t" not in spaces and "  " not in spaces and spaces.count("\u0007b c") == 900
    ends = {x.doc_id: x.text for x in QUERIES["txt05_line_ends"](spark, small).collect()}[20]
    assert "\r" not in ends and ends.count("c") == 900


def test_language_and_selection_take_whole_texts(spark, small):
    got = {x.doc_id: x.language for x in QUERIES["txt14_language"](spark, small).collect()}
    assert got == {1: "eng+hin", 2: "eng", 5: "hin", 7: "eng", 13: "eng", 20: "hin", 21: "hin"}
    texts = {x.doc_id: x.text for x in QUERIES["ent10_text_selection"](spark, small).collect()}
    assert all(texts[i] == t + "\nen" for i, t in TEXTS.items()) and texts[21] == ""


def test_images_hold_every_byte(spark, small):
    from dossier.plans.records import _images

    texts = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r.id: r for r in _images(spark, small).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        x = got[i]
        assert bytes(x.pixels) == t.ljust(x.width * x.height, b" ") and x.width * x.height - len(t) < max(x.width, 2)
        assert x.height == 1 if len(t) < 64 else abs(x.width - x.height) <= 1
    for name in ("mth04_pixel_measures", "mth03_page_gate", "mth06_prepared"):
        assert {x.id for x in QUERIES[name](spark, small).collect()} == set(texts)
    assert QUERIES["mth07_text_blocks"](spark, small).count() > 0
    assert {x.id for x in QUERIES["udf06_detector_hook"](spark, small).collect()} >= {1, 7}
