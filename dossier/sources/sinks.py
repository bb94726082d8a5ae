"""Write side: partitioned storage, rows of an ingest batch (the ledger commits them), audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def store(files: DataFrame, path: str) -> None:
    """Objects by category and ingest date; the path's scheme chooses the store (file, hdfs, s3a)."""
    files.withColumn("ingest_date", F.to_date("created_at")).write.mode("append").partitionBy("category", "ingest_date").parquet(path)


def stored(spark: SparkSession, path: str, category: str | None = None, since: str | None = None) -> DataFrame:
    """Read back; category and date prune partitions."""
    df = spark.read.parquet(path)
    if category is not None:
        df = df.where(F.col("category") == category)
    return df if since is None else df.where(F.col("ingest_date") >= F.lit(since).cast("date"))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def ingest(files: DataFrame, known: DataFrame | None, now: Column, most_bytes: int = 500 * 1024 * 1024) -> dict[str, DataFrame]:
    """Scanned files (path, length, content, mime, category, sha256, md5) to evidence, checksums, metadata, rejects and audit rows.

    Rejected files are rows with an error code. A digest that is known, or came before in the batch, is
    a DUPLICATE.
    """
    from ..functions.classify import content_warning, upload_error
    from ..operators.relational import fresh
    from .readers import extract

    checked = files.withColumn("error_code", upload_error(F.col("mime"), F.col("length"), most_bytes))
    good = fresh(checked.where("error_code is null"), known, "sha256", "path")
    ident = F.substring("sha256", 1, 32)
    taken = good.where("not duplicate")
    metadata = extract(taken.select(ident.alias("path"), "mime", "content")).select(F.col("path").alias("evidence_file_id"), "meta_type", "metadata")
    new = taken.select(ident.alias("id"), F.element_at(F.split("path", "/"), -1).alias("original_filename"), F.col("mime").alias("mime_type"), "category", F.col("length").alias("file_size"), "sha256", "md5", F.lit("COMPLETED").alias("status"), content_warning(F.col("mime"), F.substring("content", 1, 12)).alias("warning"), now.alias("created_at"))
    bad = checked.where("error_code is not null").select("path", "error_code").union(good.where("duplicate").select("path", F.lit("DUPLICATE")))
    audit = new.select(F.col("id").alias("evidence_file_id"), F.lit("INGESTED").alias("action"), F.col("original_filename").alias("detail"), now.alias("created_at"))
    audit = audit.unionByName(bad.select(F.lit(None).cast("string").alias("evidence_file_id"), F.lit("REJECTED").alias("action"), F.concat_ws(" ", "error_code", "path").alias("detail"), now.alias("created_at")))
    return {"evidence_files": new, "file_checksums": new.select(F.col("id").alias("evidence_file_id"), "sha256", "md5", "file_size"), "evidence_metadata": metadata, "ingest_rejects": bad, "acquisition_logs": audit}
