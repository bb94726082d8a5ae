"""Classification and canonical terms as column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from .text import bind, lookup


def holds_any(text: Column, some: list[str]) -> Column:
    return bind(F.lower(text), lambda low: _any(low, some))


def _any(low: Column, some: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in some])


def first_class(text: Column, classes: dict[str, list[str]], default: str) -> Column:
    """The first class with one of its words in the text."""

    def choose(low: Column) -> Column:
        chain = F.when(F.lit(False), F.lit(None).cast("string"))
        for name, some in classes.items():
            chain = chain.when(_any(low, some), name)
        return chain.otherwise(default)

    return bind(F.lower(text), choose)


def severity(c: Column) -> Column:
    return first_class(c, L.SEVERITY, "UNCLASSIFIED")


def decomposition(c: Column) -> Column:
    return first_class(c, L.DECOMPOSITION, "UNDETERMINED")


def wound_age(c: Column) -> Column:
    return first_class(c, L.WOUND_AGE, "UNDETERMINED")


def cause_class(c: Column) -> Column:
    return first_class(c, L.CAUSES, "UNDETERMINED")


def field_injury(c: Column) -> Column:
    return first_class(c, L.FIELD_INJURY, "unclassified")


def field_region(c: Column) -> Column:
    return first_class(c, L.FIELD_REGION, "unspecified")


def canonical(table: dict[str, str], c: Column) -> Column:
    key = F.trim(F.lower(c))
    return lookup(table, key, key)


def tox_result(c: Column) -> Column:
    key = F.trim(F.lower(c))
    table = {w: name for name, some in L.TOX_RESULTS.items() for w in some}
    return lookup(table, key, c)


def tox_level(substance: Column, amount: Column) -> Column:
    """lethal, toxic or therapeutic by inclusive ranges in this order; elevated above zero, else normal; '' if the substance is unknown."""
    out = F.lit("")
    for name, ranges in L.LEVELS.items():
        step = F.when(amount.isNull(), "")
        for level, (low, high) in zip(("lethal", "toxic", "therapeutic"), ranges):
            step = step.when(amount.between(low, high), level)
        out = F.when(substance == name, step.when(amount > 0, "elevated").otherwise("normal")).otherwise(out)
    return out


def tox_record(substance: Column, result: Column, concentration: Column, unit: Column) -> dict[str, Column]:
    """A finding in canonical form, by output column."""
    raw = F.trim(F.coalesce(substance, F.lit("")))
    name = lookup(L.SUBSTANCES, F.lower(raw), raw)
    said = F.trim(F.coalesce(concentration, F.lit("")))
    amount = F.regexp_replace(said, r"[^\d.]", "").try_cast("double")
    parent = lookup(L.METABOLITES, F.lower(name))
    given = F.trim(F.coalesce(unit, F.lit("")))
    return {
        "substance": name,
        "result": tox_result(F.trim(F.coalesce(result, F.lit("")))),
        "concentration": amount,
        "unit": lookup(L.TOX_UNITS, F.lower(given), given),
        "level": bind(F.struct(F.lower(name).alias("s"), amount.alias("n")), lambda x: tox_level(x["s"], x["n"])),
        "is_metabolite": parent.isNotNull(),
        "parent_drug": F.coalesce(parent, F.lit("")),
        "confidence": F.when(amount.isNotNull(), 0.8).otherwise(0.6),
    }


def legibility(score: Column) -> Column:
    return F.when(score >= 0.8, "EXCELLENT").when(score >= 0.6, "GOOD").when(score >= 0.4, "FAIR").when(score >= 0.2, "POOR").otherwise("ILLEGIBLE")


def region_type(x: Column, y: Column, w: Column, h: Column, page_w: Column, page_h: Column, edges: Column, grid: Column) -> Column:
    """Kind of a page region by place, shape, edge density and whether it shows a grid."""
    aspect, area = w / F.greatest(h, F.lit(1)), (w * h) / (page_w * page_h)
    return (
        F.when((y / page_h < 0.15) & (w > page_w * 0.4), "HEADER")
        .when((w < page_w * 0.2) & ((x / page_w < 0.1) | (x / page_w > 0.8)), "MARGIN_NOTE")
        .when((y / page_h > 0.8) & (w < page_w * 0.4) & (h < page_h * 0.1), "SIGNATURE")
        .when((aspect > 0.7) & (aspect < 1.4) & (area > 0.005) & (area < 0.05) & (edges > 0.15), "STAMP")
        .when(grid, "TABLE")
        .otherwise("BODY_TEXT")
    )


def content_type(stroke_variance: Column, edges: Column) -> Column:
    return F.when(stroke_variance.isNull(), "unknown").when((stroke_variance > 0.4) & (edges > 0.08), "handwritten").when(stroke_variance < 0.2, "printed").otherwise("mixed")


def segmentation_mode(w: Column, h: Column, content: Column, default: int = 3) -> Column:
    return F.when(h > w * 3, 4).when((w > h * 5) & (h < 100), 7).when(content == "handwritten", 6).otherwise(default)


def orientation(w: Column, h: Column) -> Column:
    return F.when(w > h * 1.2, "landscape").otherwise("portrait")


def sharpness(variance: Column) -> Column:
    return F.when(variance > 100, "Good").otherwise("Blurry")


def stage_code(c: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in L.STAGE_CODES.items() for x in kv]), F.lower(c)), F.lit(0))


def resolve_mime(declared: Column, filename: Column) -> Column:
    """The declared type if it is allowed, else by the file name's ending, else null."""
    ending = F.lower(F.regexp_extract(filename, r"(\.[^./]+)$", 1))
    allowed = F.when(declared.isin(*L.MIME_CATEGORY), declared)
    return F.coalesce(allowed, lookup(L.EXTENSION_MIME, ending))


def category(mime: Column) -> Column:
    return lookup(L.MIME_CATEGORY, mime)


def image_type(head: Column) -> Column:
    """Image type by the first bytes; PNG if none is known."""
    starts = lambda hexes: F.hex(F.substring(head, 1, len(hexes) // 2)) == hexes
    return (
        F.when(starts("89504E470D0A1A0A"), "image/png").when(starts("FFD8"), "image/jpeg").when(starts("49492A00") | starts("4D4D002A"), "image/tiff").when(starts("424D"), "image/bmp").otherwise("image/png")
    )


def content_warning(mime: Column, head: Column) -> Column:
    """Why the first bytes do not fit the type; null if they do. Warnings, not errors."""
    h = F.hex(F.substring(head, 1, 12))
    word = F.lit("application/vnd.openxmlformats-officedocument")
    return (
        F.when((mime == "application/pdf") & ~h.startswith("255044462D"), "missing PDF header")
        .when(mime.startswith(word) & ~h.startswith("504B"), "not a ZIP container")
        .when(mime.isin("video/mp4", "video/quicktime") & ~h.contains("66747970"), "missing ftyp box")
        .when((mime == "video/x-msvideo") & ~h.startswith("52494646"), "missing RIFF header")
    )


def upload_error(mime: Column, size: Column, most: int = 500 * 1024 * 1024) -> Column:
    return F.when(mime.isNull(), "UNSUPPORTED_FILE_TYPE").when(size > most, "FILE_TOO_LARGE").when(size <= 0, "EMPTY_FILE")


def json_verdict(c: Column) -> Column:
    """INVALID_JSON, SCALAR_ROOT or null. The text is read as the only element of an array, as the parser stops behind a first value."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    items = F.try_variant_get(wrapped, "$", "array<variant>")
    root = F.schema_of_variant(F.get(items, F.lit(0)))
    one = F.coalesce(F.size(items) == 1, F.lit(False))
    return F.when(~one, "INVALID_JSON").when(~(root.startswith("OBJECT") | root.startswith("ARRAY")), "SCALAR_ROOT")
