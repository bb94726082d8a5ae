"""Recognized documents from what two recognizers say of pages and regions: one plan from regions to fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.entities import FIELDS, report_field
from ..functions.text import bind

PAGE_BREAK = "\n\n--- Page Break ---\n\n"
#: A whole page below this confidence is tried with the second recognizer.
SURE = 0.7


def _said(chosen: Column, first: str, second: str) -> list[Column]:
    """(engine, text, confidence) of the second recognizer where ``chosen``, else of the first."""
    return [F.when(chosen, F.lit(second)).otherwise(F.lit(first)).alias("engine"), *[F.when(chosen, F.col(f"{second}_{c}")).otherwise(F.col(f"{first}_{c}")).alias(c) for c in ("text", "conf")]]


def recognized_pages(pages: DataFrame, regions: DataFrame, doc: str, sure: float = SURE, use_vision: bool = True) -> DataFrame:
    """(doc, page, text, confidence, engine, engines) of every page.

    ``pages`` (doc, page) and ``regions`` (doc, page, reading_order, content) both have print_text, print_conf,
    vision_text and vision_conf: what two recognizers say of the whole page and of the region. Of a page with
    regions each handwritten region counts as the vision recognizer reads it, others as print, in reading
    order; blank ones are left out, and the confidence is the mean of the rest. A page without regions is read
    as print; below ``sure`` the vision reading takes its place if it is surer. Null texts are blank, null
    confidences 0. Without ``use_vision`` everything is print.
    """
    by_hand = (F.col("content") == "handwritten") & F.lit(use_vision)
    read = regions.select(doc, "page", "reading_order", *_said(F.coalesce(by_hand, F.lit(False)), "print", "vision"))
    told = F.trim(F.coalesce("text", F.lit(""))) != ""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(told, F.struct("reading_order", "text")))), lambda x: x["text"]), "\n")
    of_regions = read.groupBy(doc, "page").agg(joined.alias("text"), F.avg(F.when(told, F.coalesce("conf", F.lit(0.0)))).alias("confidence"), F.sort_array(F.collect_set("engine")).alias("engines"))
    of_regions = of_regions.withColumns({"engine": F.lit("print"), "confidence": F.coalesce("confidence", F.lit(0.0))})

    print_conf, vision_conf = F.coalesce("print_conf", F.lit(0.0)), F.coalesce("vision_conf", F.lit(0.0))
    surer = (print_conf < sure) & (vision_conf > print_conf) & F.lit(use_vision)
    whole = pages.select(doc, "page", *_said(surer, "print", "vision")).join(of_regions.select(doc, "page"), [doc, "page"], "left_anti")
    engines = F.when(F.col("engine") == "vision", F.array(F.lit("print"), F.lit("vision"))).otherwise(F.array(F.lit("print")))
    whole = whole.select(doc, "page", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("conf", F.lit(0.0)).alias("confidence"), engines.alias("engines"), "engine")
    return of_regions.unionByName(whole)


def recognized_documents(read: DataFrame, doc: str, fields: list[str] | None = None) -> DataFrame:
    """(doc, text, confidence, page_count, engines, the report ``fields``): pages joined by page breaks (blank ones left
    out), the mean of the confidences above 0, all engines used, and fields of the joined text."""
    told = F.trim("text") != ""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(told, F.struct("page", "text")))), lambda x: x["text"]), PAGE_BREAK)
    out = read.groupBy(doc).agg(
        text.alias("text"), F.coalesce(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))), F.lit(0.0)).alias("confidence"), F.count("*").alias("page_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("engines")))).alias("engines")
    )
    return with_fields(out, fields)


def _read(r: Column, chosen: Column) -> Column:
    return F.struct(F.when(chosen, F.lit("vision")).otherwise(F.lit("print")).alias("engine"), *[F.when(chosen, r[f"vision_{c}"]).otherwise(r[f"print_{c}"]).alias(c) for c in ("text", "conf")])


def _mean(values: Column) -> Column:
    """The mean of an array of numbers, 0 if it is empty."""
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)).otherwise(F.lit(0.0))


def page_of_regions(regions: Column, use_vision: bool = True) -> Column:
    """``recognized_pages`` for one page whose regions, in reading order, are an array: (text, confidence, engines)."""
    by_hand = lambda r: F.coalesce((r["content"] == "handwritten") & F.lit(use_vision), F.lit(False))

    def made(read: Column) -> Column:
        told = F.filter(read, lambda x: F.trim(F.coalesce(x["text"], F.lit(""))) != "")
        text = F.array_join(F.transform(told, lambda x: x["text"]), "\n")
        return F.struct(text.alias("text"), _mean(F.transform(told, lambda x: F.coalesce(x["conf"], F.lit(0.0)))).alias("confidence"), F.array_distinct(F.transform(read, lambda x: x["engine"])).alias("engines"))

    return bind(F.transform(regions, lambda r: _read(r, by_hand(r))), made)


def whole_page(page: Column, sure: float = SURE, use_vision: bool = True) -> Column:
    """``recognized_pages`` for one page without regions, a struct of both readings: (text, confidence, engines)."""
    print_conf, vision_conf = F.coalesce(page["print_conf"], F.lit(0.0)), F.coalesce(page["vision_conf"], F.lit(0.0))
    surer = (print_conf < sure) & (vision_conf > print_conf) & F.lit(use_vision)
    engines = lambda x: F.when(x["engine"] == "vision", F.array(F.lit("print"), F.lit("vision"))).otherwise(F.array(F.lit("print")))
    return bind(_read(page, surer), lambda x: F.struct(F.coalesce(x["text"], F.lit("")).alias("text"), F.coalesce(x["conf"], F.lit(0.0)).alias("confidence"), engines(x).alias("engines")))


def document_of_pages(pages: Column) -> Column:
    """``recognized_documents`` for one document whose read pages, in order, are an array: (text, confidence, page_count, engines)."""
    told = F.filter(F.transform(pages, lambda x: x["text"]), lambda t: F.trim(t) != "")
    sure = F.filter(F.transform(pages, lambda x: x["confidence"]), lambda c: c > 0)
    engines = F.array_sort(F.array_distinct(F.flatten(F.transform(pages, lambda x: x["engines"]))))
    return F.struct(F.array_join(told, PAGE_BREAK).alias("text"), _mean(sure).alias("confidence"), F.size(pages).cast("long").alias("page_count"), engines.alias("engines"))


def with_fields(documents: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """``documents`` (text) with the report ``fields`` of the text."""
    return documents.select("*", *[report_field(F.col("text"), f).alias(f) for f in (list(FIELDS) if fields is None else fields)])
