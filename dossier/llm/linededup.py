"""Line dedup by site-relative frequency, in DataFrame functions only (op10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialize

#: A line is boilerplate on a host if more than this share of the host's pages have it ...
RATIO = 0.08
#: ... and at least this many pages: a line on one page does not repeat.
MIN_PAGES = 2


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """128 bits of a trimmed line."""
    return F.struct(F.xxhash64(F.trim(line)).alias("h1"), F.xxhash64(F.lit(1), F.trim(line)).alias("h2"))


def boilerplate(df: DataFrame, host: Column, text: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, h1, h2) of the lines on more than ``ratio`` of a host's pages; materialized.

    A page counts once for each distinct line. Only hashes and counts are shuffled, summed per task
    first, so a large host or a common line makes no large task. A host has at most its lines per
    page divided by ``ratio`` such lines, however many pages it has.
    """
    pages = df.select(host.alias("host"), text.alias("text"))
    each = F.array_sort(F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""), _key))
    once = lambda a: F.filter(a, lambda x, i: (i == 0) | (F.get(a, i - 1) != x))
    keys = F.element_at(F.transform(F.array(each), once), 1)
    lines = pages.select("host", F.inline(keys)).groupBy("host", "h1", "h2").agg(F.count("*").alias("n"))
    totals = pages.groupBy("host").agg(F.count("*").alias("total"))
    often = lines.where(F.col("n") >= min_pages).join(totals, "host").where(F.col("n") > ratio * F.col("total"))
    return materialize(often.select("host", "h1", "h2"), "boilerplate")


def _is_known(key: Column) -> Column:
    """Whether the sorted array ``known`` has a key; ``steps`` has as many elements as the binary search needs."""

    def search(k: Column) -> Column:
        middle = lambda z: F.shiftright(z["low"] + z["high"], 1)
        step = lambda z, _: F.when(F.get("known", middle(z)) < k, F.struct((middle(z) + 1).alias("low"), z["high"].alias("high"))).otherwise(F.struct(z["low"].alias("low"), middle(z).alias("high")))
        at = F.aggregate("steps", F.struct(F.lit(0).alias("low"), F.size("known").alias("high")), step, lambda z: z["low"])
        return F.coalesce(F.get("known", at) == k, F.lit(False))

    return F.element_at(F.transform(F.array(key), search), 1)


def drop_boilerplate(df: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """All columns of ``df``, its text without boilerplate lines, and n_lines and n_dropped.

    Lines are compared without the spaces around them; blank lines stay. A line that is on exactly
    ``ratio`` of the pages stays, and so does one on fewer than ``min_pages`` pages (two: a host of one
    page loses nothing, on a host of up to 24 pages every line on two of them goes). Null hosts form one
    host, apart from the empty one. A null text stays null with 0 lines; an empty one has one line.
    Repeated rows count as pages. Columns of ``df`` named n_lines or n_dropped are replaced; other names
    do not matter. Rows of equal counts need no order: each line is kept or dropped by its own count. A host's
    boilerplate lines travel as one array, at most its lines per page divided by ``ratio``; each line
    looks itself up there by binary search.
    """
    names = [c for c in df.columns if c not in ("n_lines", "n_dropped")]
    rows = df.select(*names).toDF(*[f"c{i}" for i in range(len(names))])
    host, text = (F.col(f"c{names.index(c)}") for c in (host_col, text_col))
    at = F.coalesce(F.concat(F.lit("h"), host.cast("string")), F.lit(""))
    found = boilerplate(rows, at, text, ratio, min_pages)
    small = found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    sets = found.groupBy("host").agg(F.array_sort(F.collect_set(F.struct("h1", "h2"))).alias("known"))
    sets = sets.withColumn("steps", F.sequence(F.lit(0), F.ceil(F.log2(F.size("known") + F.lit(1.0))).cast("int")))
    out = rows.withColumn("host", at).join(F.broadcast(sets) if small else sets, "host", "left")
    lines = _lines(text)
    kept = F.when(F.col("known").isNull(), lines).otherwise(F.filter(lines, lambda x: (F.trim(x) == "") | ~_is_known(_key(x))))
    out = out.withColumns({"n_lines": F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long"), "kept": kept})
    out = out.withColumn("n_dropped", F.when(text.isNull(), 0).otherwise(F.col("n_lines") - F.size("kept")).cast("long"))
    made = [F.array_join("kept", "\n") if c == text_col else F.col(f"c{i}") for i, c in enumerate(names)]
    return out.select(*[m.alias(c) for m, c in zip(made, names)], "n_lines", "n_dropped")


#: The same rows in DuckDB SQL, for a table whose ids are unique.
LINE_SQL = f"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, source, unnest(ls) AS line FROM d),
c AS (SELECT source, trim(line) AS k, count(DISTINCT doc_id) AS n FROM l WHERE trim(line) <> '' GROUP BY 1, 2),
t AS (SELECT source, count(*) AS total FROM documents GROUP BY 1),
b AS (SELECT c.source, list(k) AS ks FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
      WHERE n >= {MIN_PAGES} AND n > {RATIO} * total GROUP BY 1),
k AS (SELECT d.doc_id, d.ls, CASE WHEN b.ks IS NULL THEN d.ls
      ELSE list_filter(d.ls, lambda x: trim(x) = '' OR NOT list_contains(b.ks, trim(x))) END AS kept
      FROM d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, array_to_string(kept, chr(10)) AS text, CAST(len(ls) AS BIGINT) AS n_lines,
       CAST(len(ls) - len(kept) AS BIGINT) AS n_dropped FROM k"""
