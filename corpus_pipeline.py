"""A corpus through five stages: each is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.bpe import encode_texts
from dossier.llm.common import table
from dossier.llm.decontam import without_contaminated
from dossier.llm.linededup import drop_boilerplate
from dossier.llm.quality import score_quality, train
from dossier.llm.simhash import near_duplicates
from dossier.storage import discard, materialize

#: Near-duplicates of the dedup stage: words of a shingle, least Jaccard similarity, and bits in which their fingerprints may differ.
WORDS, SHARE, BITS = 5, 0.8, 28


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.7 or more).

    A null text counts as empty and is scored by the bias; repeated rows are scored alike, each by itself, so
    there are no ties; long texts are scored whole. Columns keep their names, whatever these are.
    """
    model = train(docs, table(spark, sf_dir, "labels"))
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = {n: f"c{i}" for i, n in enumerate(names)}
    scored = score_quality(plain, model, at["doc_id"], at["text"], keep=plain.columns)
    return scored.where("predicted = 1").select(*[F.col(at[n]).alias(n) for n in names])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source; n_chars follows the text.

    A null text stays null (its n_chars too), a null source is a source of its own; repeated rows count as pages
    and stay; a line on exactly the limiting share of pages stays. Columns named n_lines or n_dropped are kept.
    """
    names = docs.columns
    at = {n: f"c{i}" for i, n in enumerate(names)}
    plain = drop_boilerplate(docs.toDF(*at.values()), at["source"], at["text"])
    counted = F.length(at["text"]).cast(docs.schema["n_chars"].dataType) if "n_chars" in at else None
    return plain.select(*[(counted if n == "n_chars" else F.col(at[n])).alias(n) for n in names])


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row, that of the smallest doc_id (rows without id come last).

    Near-duplicates share WORDS-word shingles at a similarity of SHARE or more; candidates come from minima of the
    shingles' hashes, not from the pivot table (see the README). Rows are told apart by id and text:
    different texts under one id are rows of their own; of rows alike in both, that with the smallest hash of
    all columns stays. Null texts are like empty ones; long texts are compared whole.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"), F.col("text").isNull().alias("empty"))
    own = "__row" + "_" * max(map(len, docs.columns))
    keyed = docs.withColumn(own, key)
    pick = own + "_"
    first = near_duplicates(keyed, WORDS, BITS, SHARE, own).where(F.col(own) == F.col("component_id")).select(own).distinct()
    keyed = keyed.withColumn(pick, F.xxhash64(*[F.to_json(F.struct(c)) if kind.startswith("map") else F.col(c) for c, kind in docs.dtypes]))
    first = first.join(keyed.groupBy(own).agg(F.min(pick).alias(pick)), own)
    return keyed.join(first, [own, pick], "left_semi").dropDuplicates([own, pick]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its edit budget.

    Null and empty texts hold none; each row is judged by itself, so repeats and ties need no rule; texts are searched whole.
    """
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, with digests of the ids and of what they decode to.

    A null text is an empty one, without ids; repeated rows are encoded each; long texts are encoded whole.
    """
    return encode_texts(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("simhash_dedup", simhash_dedup), ("decontamination", decontamination), ("bpe", bpe)]

#: Classifier, fingerprints, alignments and merges are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what one wrote is deleted once the next has read it, but for the last one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        after = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
