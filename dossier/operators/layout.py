"""Lines, pages, reading order and content of recognized documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind
from ..storage import materialize
from .scan import BLOCK_BITS, RANGE_ROWS, following, ordered, running_sums, with_next


def lines(words: DataFrame, keys: list[str]) -> DataFrame:
    """Words (seq, word, conf, x, y, w, h) joined to lines: text in order, mean confidence, union of boxes. Words of negative confidence are none."""
    some = words.where("conf >= 0 and trim(word) <> ''")
    return some.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "word"))), lambda s: s["word"]), " ").alias("text"),
        (F.avg("conf") / 100).alias("confidence"),
        F.min("x").alias("x"), F.min("y").alias("y"),
        (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"),
    )


def pages(found: DataFrame, doc: str, page: str, order: str) -> DataFrame:
    """Lines to pages: text by line, mean confidence of lines that have one."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda s: s["text"]), "\n")
    return found.groupBy(doc, page).agg(text.alias("text"), F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))).alias("confidence"))


def documents(found: DataFrame, doc: str, page: str) -> DataFrame:
    """Pages to documents: text with page breaks, mean confidence, and the best page."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(page, "text"))), lambda s: s["text"]), "\n\n--- Page Break ---\n\n")
    return found.groupBy(doc).agg(
        text.alias("text"), F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))).alias("confidence"), F.max_by(page, F.struct("confidence", -F.col(page))).alias("best_page"), F.count("*").alias("pages")
    )


def _mean(values: Column) -> Column:
    """The mean of an array of numbers, null if it is empty."""
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))


def line_of(words: Column) -> Column:
    """``lines`` for one line whose words, in order, are an array: (text, confidence, x, y, w, h), null if no word is left."""
    of = lambda some, f: F.transform(some, f)

    def made(some: Column) -> Column:
        x, y = F.array_min(of(some, lambda s: s["x"])), F.array_min(of(some, lambda s: s["y"]))
        line = F.struct(
            F.array_join(of(some, lambda s: s["word"]), " ").alias("text"), (_mean(of(some, lambda s: s["conf"].cast("double"))) / 100).alias("confidence"), x.alias("x"), y.alias("y"),
            (F.array_max(of(some, lambda s: s["x"] + s["w"])) - x).alias("w"), (F.array_max(of(some, lambda s: s["y"] + s["h"])) - y).alias("h"),
        )
        return F.when(F.size(some) > 0, line)

    return bind(F.filter(words, lambda s: (s["conf"] >= 0) & (F.trim(s["word"]) != "")), made)


def _joined(parts: Column, between: str) -> list[Column]:
    known = F.filter(F.transform(parts, lambda p: p["confidence"]), lambda c: c > 0)
    return [F.array_join(F.transform(parts, lambda p: p["text"]), between).alias("text"), _mean(known).alias("confidence")]


def page_of(found: Column) -> Column:
    """``pages`` for one page whose lines, in order, are an array: (text, confidence)."""
    return F.struct(*_joined(found, "\n"))


def document_of(found: Column) -> Column:
    """``documents`` for one document whose pages, in order, are an array: (text, confidence, pages)."""
    return F.struct(*_joined(found, "\n\n--- Page Break ---\n\n"), F.size(found).cast("long").alias("pages"))


#: Regions of a page up to which its bands are folded in one array.
WHOLE_PAGE = 1024
_BAND = "array<struct<band:int,x:int,y:int,seq:int>>"


def _bands(rows: Column) -> Column:
    """(band, x, y, seq) of regions sorted by (y, x, seq, h), sorted by band, left to right inside a band."""

    def step(state: Column, v: Column) -> Column:
        same = F.abs(v["y"] - state["top"]) < v["h"] * 0.5
        band = F.when(state["band"] < 0, 0).when(same, state["band"]).otherwise(state["band"] + 1)
        top = F.when((state["band"] >= 0) & same, state["top"]).otherwise(v["y"])
        one = F.struct(band.cast("int").alias("band"), v["x"].alias("x"), v["y"].alias("y"), v["seq"].alias("seq"))
        return F.struct(band.cast("int").alias("band"), top.alias("top"), F.concat(state["out"], F.array(one)).cast(_BAND).alias("out"))

    start = F.struct(F.lit(-1).alias("band"), F.lit(0).alias("top"), F.array().cast(_BAND).alias("out"))
    return F.array_sort(F.aggregate(rows, start, step, lambda z: z["out"]))


def reading_order(regions: DataFrame, page: str, whole_page: int = WHOLE_PAGE, block_bits: int = BLOCK_BITS) -> DataFrame:
    """(page, seq, reading_order, band): bands from top to bottom, left to right inside a band.

    A region is in the current band if its top is less than half its height from the band's first region.
    If all pages have up to ``whole_page`` regions, each is folded in one array. Otherwise pages are
    range-sorted and cut where a band starts whatever came before: where a region's top less half its height is
    not above the top of the region before it, as no band began lower than that. The stretches between
    cuts are folded, and running counts of their bands and regions put them together.
    """
    row = F.struct("y", "x", "seq", "h")
    most = regions.groupBy(page).count().agg(F.max("count")).first()[0] or 0
    if most <= whole_page:
        folded = regions.groupBy(page).agg(_bands(F.array_sort(F.collect_list(row))).alias("b"))
        return folded.select(page, F.posexplode("b").alias("reading_order", "v")).select(page, F.col("v.seq").alias("seq"), "reading_order", F.col("v.band").alias("band"))
    g = F.coalesce(F.concat(F.lit("="), F.col(page).cast("string")), F.lit(""))
    rows = ordered(regions.select(g.alias("g"), page, "y", "x", "seq", "h", (F.col("y") - F.col("h") * 0.5).alias("reach")), ["g"], ["y", "x", "seq", "h"], block_bits)
    cut = (F.col("g") == F.col("next_g")) & (F.col("next_reach") >= F.col("y"))
    flagged = materialize(with_next(rows, ["g", "reach"]).withColumn("cut", F.coalesce(cut, F.lit(False)).cast("long")), "cuts")
    parts = running_sums(flagged, ["g"], {"cuts": F.col("cut")}).withColumn("part", F.col("cuts") - F.col("cut"))
    parts = materialize(parts.groupBy("g", page, "part").agg(_bands(F.array_sort(F.collect_list(row))).alias("b")), "bands")
    before = ordered(parts.select("g", "part", F.size("b").alias("n"), (F.element_at("b", -1)["band"] + 1).alias("bands")), ["g"], ["part"], block_bits)
    sums = running_sums(before, ["g"], {"n_sum": F.col("n"), "bands_sum": F.col("bands")}).select("g", "part", (F.col("n_sum") - F.col("n")).alias("n0"), (F.col("bands_sum") - F.col("bands")).alias("band0"))
    out = parts.join(sums, ["g", "part"]).select(page, "n0", "band0", F.posexplode("b").alias("i", "v"))
    return out.select(page, F.col("v.seq").alias("seq"), (F.col("n0") + F.col("i")).cast("int").alias("reading_order"), (F.col("band0") + F.col("v.band")).cast("int").alias("band"))


def dominant_content(regions: DataFrame, page: str) -> DataFrame:
    """The content type with the largest area of each page; of equals the first seen, then the last by name."""
    areas = regions.groupBy(page, "content").agg(F.sum(F.col("w").cast("long") * F.col("h")).alias("area"), F.min("seq").alias("first"))
    return areas.groupBy(page).agg(F.max_by("content", F.struct("area", -F.col("first"), "content")).alias("dominant"), F.bool_or(F.col("content") == "handwritten").alias("has_handwriting"))


def motion_frames(frames: DataFrame, camera: str, order: str, score: str, threshold: float = 50_000, most: int = RANGE_ROWS) -> DataFrame:
    """Frames whose difference to the one before exceeds the threshold, counted for each camera; a camera of more than
    ``most`` frames is cut."""
    pairs = following(frames.select(*dict.fromkeys([camera, order, score])), [camera], [F.col(order)], [score], most)
    moved = F.abs(F.col(f"next_{score}") - F.col(score)) > threshold
    return pairs.groupBy(camera).agg(F.count("*").alias("frames"), F.count_if(moved).alias("motion_frames"))
