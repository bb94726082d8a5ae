"""Two readings of pages and regions, merged as by hand."""

from dossier.operators.recognition import PAGE_BREAK, recognized_documents, recognized_pages

READ = "print_text string, print_conf double, vision_text string, vision_conf double"


def test_pages_and_documents(spark):
    pages = spark.createDataFrame(
        [(1, 1, "whole", 0.9, "WHOLE", 0.95), (1, 2, "unsure", 0.5, "SURER", 0.6), (1, 3, "unsure", 0.5, "WORSE", 0.4), (1, 4, "has regions", 0.1, "never used", 1.0), (2, 1, None, None, None, None), (3, 1, "PM No: PM/7/2024", 0.8, "", 0.0)],
        f"doc int, page int, {READ}",
    )
    regions = spark.createDataFrame(
        [(1, 4, 2, "printed", "second", 0.8, "X", 1.0), (1, 4, 1, "handwritten", "scrawl", 0.1, "first", 0.6), (1, 4, 3, None, "  ", 0.9, "Y", 1.0), (4, 1, 1, "printed", "", 0.3, None, None)],
        f"doc int, page int, reading_order int, content string, {READ}",
    )
    read = recognized_pages(pages, regions, "doc")
    got = {(x.doc, x.page): (x.text, round(x.confidence, 4), x.engine, x.engines) for x in read.collect()}
    assert got == {
        (1, 1): ("whole", 0.9, "print", ["print"]), (1, 2): ("SURER", 0.6, "vision", ["print", "vision"]), (1, 3): ("unsure", 0.5, "print", ["print"]),
        (1, 4): ("first\nsecond", 0.7, "print", ["print", "vision"]), (2, 1): ("", 0.0, "print", ["print"]), (3, 1): ("PM No: PM/7/2024", 0.8, "print", ["print"]), (4, 1): ("", 0.0, "print", ["print"]),
    }
    docs = {x.doc: x for x in recognized_documents(read, "doc", ["case_number"]).collect()}
    assert docs[1].text == PAGE_BREAK.join(["whole", "SURER", "unsure", "first\nsecond"]) and round(docs[1].confidence, 4) == 0.675
    assert docs[1].engines == ["print", "vision"] and docs[1].page_count == 4
    assert (docs[2].text, docs[2].confidence, docs[2].page_count) == ("", 0.0, 1) and docs[3].case_number == "PM/7/2024"
    plain = recognized_pages(pages, regions, "doc", use_vision=False)
    assert {e for x in plain.collect() for e in x.engines} == {"print"}
