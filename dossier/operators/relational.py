"""Listing, search, latest-per-key, pending work, detail and write-side operators over evidence tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DONE = ("COMPLETED", "IN_PROGRESS")


def listing(df: DataFrame, live_only: bool = True, **equal) -> DataFrame:
    """Rows that are not deleted and equal the given values; None leaves a column free."""
    keep = [F.col(c) == v for c, v in equal.items() if v is not None]
    keep += [~F.col("is_deleted")] if live_only and "is_deleted" in df.columns else []
    return df.where(reduce(lambda a, b: a & b, keep)) if keep else df


def point(df: DataFrame, key: str, value) -> DataFrame:
    return listing(df, **{key: value}).limit(1)


def search(df: DataFrame, text: str | None, columns: list[str], **equal) -> DataFrame:
    """Rows with ``text`` in one of the columns, in any case, % and _ taken literally."""
    out = listing(df, **equal)
    if not text:
        return out
    return out.where(reduce(lambda a, b: a | b, [F.contains(F.lower(c), F.lower(F.lit(text))) for c in columns]))


def page(df: DataFrame, order: str = "created_at", descending: bool = True, number: int = 1, size: int = 20, tie: str = "id", columns: list[str] | None = None) -> DataFrame:
    """One page of a listing: number at least 1, size 1 to 100, ties by ``tie``; ``order`` must be one of ``columns`` if given."""
    if columns is not None and order not in columns:
        raise ValueError(f"cannot sort by {order}")
    number, size = max(1, number), min(100, max(1, size))
    key = F.col(order).desc() if descending else F.col(order).asc()
    return df.orderBy(key, F.col(tie)).offset((number - 1) * size).limit(size)


def page_info(df: DataFrame, number: int, size: int) -> DataFrame:
    """total, total_pages, has_next, has_prev."""
    pages = F.ceil(F.col("total") / size)
    return df.agg(F.count("*").alias("total")).select("total", pages.cast("long").alias("total_pages"), (pages > number).alias("has_next"), F.lit(number > 1).alias("has_prev"))


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where("__n = 1").drop("__n")


def pending(evidence: DataFrame, normalizations: DataFrame, attempts: int | None = None) -> DataFrame:
    """Completed, live evidence without a completed or running normalization; ``attempts`` bounds how many may have failed."""
    left = evidence.where((F.col("status") == "COMPLETED") & ~F.col("is_deleted"))
    out = left.join(normalizations.where(F.col("status").isin(*DONE)).select(F.col("evidence_id").alias("id")), "id", "left_anti")
    if attempts is not None:
        tired = normalizations.groupBy(F.col("evidence_id").alias("id")).count().where(F.col("count") >= attempts)
        out = out.join(tired, "id", "left_anti")
    return out


def detail(evidence: DataFrame, normalizations: DataFrame, tie: str = "attempt") -> DataFrame:
    """Evidence with its latest normalization and the number of attempts."""
    last = latest(normalizations, "evidence_id", F.col("created_at").desc(), F.col("attempt").desc(), F.col(tie))
    last = last.select(F.col("evidence_id").alias("id"), F.col("status").alias("last_status"), F.col("attempt").alias("last_attempt"))
    counts = normalizations.groupBy(F.col("evidence_id").alias("id")).agg(F.count("*").alias("attempts"))
    return evidence.join(last, "id", "left").join(counts, "id", "left").fillna(0, ["attempts"])


def with_children(parents: DataFrame, children: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    """Parents with their children's values as one ordered array (empty without children)."""
    grouped = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias(name))
    joined = parents.join(grouped, key, "left")
    return joined.withColumn(name, F.coalesce(F.transform(name, lambda x: x[value]), F.array().cast(f"array<{children.schema[value].dataType.simpleString()}>")))


def child_counts(parents: DataFrame, children: DataFrame, key: str, name: str = "n") -> DataFrame:
    return parents.join(children.groupBy(key).agg(F.count("*").alias(name)), key, "left").fillna(0, [name])


def fresh(incoming: DataFrame, known: DataFrame | None, digest: str, arrival: str) -> DataFrame:
    """Incoming rows whose digest was not seen before, neither in ``known`` nor earlier in the batch; adds duplicate.

    The first arrival of each digest is a minimum with partial sums, joined back, so that a digest that
    a large part of the batch shares does not gather in one task. ``arrival`` is unique in a batch.
    """
    first = incoming.groupBy(digest).agg(F.min(arrival).alias("__first"))
    out = incoming.join(first, digest).withColumn("duplicate", F.col(arrival) > F.col("__first")).drop("__first")
    if known is not None:
        seen = known.select(digest).distinct().withColumn("__seen", F.lit(True))
        out = out.join(seen, digest, "left").withColumn("duplicate", F.col("duplicate") | F.col("__seen").isNotNull()).drop("__seen")
    return out


def soft_delete(df: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """Mark rows whose id is in ``ids`` as deleted at ``at``; what was deleted before stays as it was."""
    hit = ids.select("id").distinct().withColumn("__hit", F.lit(True))
    out = df.join(hit, "id", "left")
    now = F.col("__hit").isNotNull() & ~F.col("is_deleted")
    return out.withColumns({"deleted_at": F.when(now, at), "is_deleted": F.col("is_deleted") | now}).drop("__hit")


def patch(df: DataFrame, changes: DataFrame, key: str, truthy: list[str], defined: list[str], closed_at: Column) -> DataFrame:
    """Update by key: ``truthy`` columns only where the change is not null or empty, ``defined`` ones where has_<column> says so (null
    allowed); a status set to CLOSED stamps closed_at."""
    c = changes.select(key, *[F.col(x).alias(f"__{x}") for x in truthy + defined], *[F.col(f"has_{x}").alias(f"__has_{x}") for x in defined])
    out = df.join(c, key, "left")
    cols = {x: F.when(F.col(f"__{x}").isNotNull() & (F.col(f"__{x}").cast("string") != ""), F.col(f"__{x}")).otherwise(F.col(x)) for x in truthy}
    cols |= {x: F.when(F.coalesce(F.col(f"__has_{x}"), F.lit(False)), F.col(f"__{x}")).otherwise(F.col(x)) for x in defined}
    if "status" in truthy:
        cols["closed_at"] = F.when(F.col("__status") == "CLOSED", closed_at).otherwise(F.col("closed_at"))
    return out.withColumns(cols).drop(*[x for x in c.columns if x != key])


def delete_cascade(parents: DataFrame, children: DataFrame, ids: DataFrame, key: str, foreign: str) -> tuple[DataFrame, DataFrame]:
    gone = ids.select(F.col(key)).distinct()
    return parents.join(gone, key, "left_anti"), children.join(gone.withColumnRenamed(key, foreign), foreign, "left_anti")


def insert_new(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Rows of ``incoming`` whose key is not there yet (an insert that does nothing on conflict)."""
    return incoming.join(existing.select(key), key, "left_anti")


def update_where(df: DataFrame, condition: Column, **values) -> DataFrame:
    return df.withColumns({c: F.when(condition, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def revoke_families(tokens: DataFrame, presented: DataFrame) -> DataFrame:
    """Presenting a revoked token revokes every token of its family."""
    reused = tokens.where("is_revoked").join(presented.select("token"), "token", "left_semi").select("family").distinct().withColumn("__hit", F.lit(True))
    out = tokens.join(reused, "family", "left")
    return out.withColumn("is_revoked", F.col("is_revoked") | F.col("__hit").isNotNull()).drop("__hit")


def expired_files(files: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    return files.where(F.col("modified_at") < now - F.make_interval(hours=F.lit(hours)))
