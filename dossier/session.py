"""Session settings every entry point shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Runtime settings the operators rely on: UTC clocks, AQE with skew handling.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "dossier", master: str | None = None, **conf: str) -> SparkSession:
    """A session with SETTINGS; ``master`` only for local runs, a cluster sets its own."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if its scan has fewer splits than there are cores, for work that is heavy in CPU.

    A small file in one row group is one task however many cores wait. Large inputs have splits enough
    and are left alone, so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


#: Rows of a task of narrow rows from which long texts are made, at most.
TASK_ROWS = 1 << 15


def deal(df: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """``df`` (narrow, straight from a file) in tasks of about ``rows`` rows, for work that is heavy in CPU row by row.

    Splits follow bytes and row groups: a column of keys packs millions of rows into one. Counting reads
    the files' footers only, and what is shuffled is the keys.
    """
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(tasks)


#: Rows and bytes of a batch between the JVM and Python at most: texts and pages are long, and batches are held on both sides.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session; narrower settings stay."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key, None)
        digits = "".join(c for c in now or "" if c.isdigit())
        if not (digits and 0 < int(digits) <= most and digits == now):
            spark.conf.set(key, str(most))
