"""Vector retrieval, regression, and hooks for models that run outside."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.classify import stage_code
from ..storage import materialize, ship_package


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


#: Numbers of the vectors and of the queries of a tile at most, about; rows of a tile from which on more tiles share the work.
VECTOR_NUMBERS, QUERY_NUMBERS, SMALL_TILE = 1 << 22, 1 << 17, 512
#: Queries that are multiplied with a tile at once, and what rounding may move a product by.
AT_ONCE, SLACK = 64, 1e-9


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, id, score): for each query row its ``k`` best by cosine, equal cosines by id (null first).

    Queries and vectors are dealt to tiles of bounded size; every pair of tiles gives the ``k`` best of its
    vectors for each of its queries, and these are merged, ranks by ranks, before they are gathered. The plan is
    the same for any number of queries, and none of them passes through the driver. Cosines rank as they
    are; the score is rounded to six digits. Vectors without a cosine (null, zero, of another length)
    score null and come last. Repeated query rows are answered each.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    kinds = dict(vectors.dtypes)
    asked = materialize(queries.select(F.monotonically_increasing_id().alias("n"), F.col(id_col).alias("query_id"), F.col(vec_col).alias("asked")), "queries")
    measure = lambda df, c: df.agg(F.count("*"), F.sum(F.greatest(F.size(c), F.lit(1)))).first()
    (rows, numbers), (_, query_numbers) = measure(vectors, vec_col), measure(asked, "asked")
    tiles = max(-(-(numbers or 1) // VECTOR_NUMBERS), min(spark.sparkContext.defaultParallelism, -(-rows // SMALL_TILE)), 1)
    query_tiles = max(1, -(-(query_numbers or 1) // QUERY_NUMBERS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("q", F.pmod(F.xxhash64("n"), F.lit(query_tiles))).withColumn("v", every(tiles))
    right = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(tiles)).alias("v")).withColumn("q", every(query_tiles))
    pair = (F.col("q") * tiles + F.col("v")).alias("pair")
    left, right = left.select(pair, "n", "query_id", "asked"), right.select(pair, "id", "vec")
    schema = f"n bigint, query_id {dict(queries.dtypes)[id_col]}, id {kinds[id_col]}, score double"
    best = left.groupBy("pair").cogroup(right.groupBy("pair")).applyInArrow(lambda q, v: best_of_tiles(q, v, k), schema)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("n").orderBy(F.col("score").desc_nulls_last(), F.col("id").asc_nulls_first())))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("id").alias(id_col), F.round("score", 6).alias("score"))


def _matrix(column: pa.Array, at: np.ndarray, n: int) -> np.ndarray:
    return column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)


def best_of_tiles(queries: pa.Table, vectors: pa.Table, k: int) -> pa.Table:
    """(n, query_id, id, score): the ``k`` best of a tile of vectors for each of a tile of queries, by cosine and then id.

    Products of whole matrices choose, with some slack; what they choose is scored pair by pair, so that equal
    vectors score alike wherever they lie.
    """
    asked, vec = queries.column("asked").combine_chunks(), vectors.column("vec").combine_chunks()
    by_id = np.asarray(pc.sort_indices(vectors.column("id").combine_chunks(), null_placement="at_start")).astype(np.int64)
    place = np.empty(len(by_id), np.int64)
    place[by_id] = np.arange(len(by_id))
    sizes = [np.array(c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64) for c in (asked, vec)]
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for n in np.unique(sizes[0][sizes[0] > 0]).tolist():
        ours, theirs = (np.flatnonzero(s == n) for s in sizes)
        a, b = _matrix(asked, ours, n), _matrix(vec, theirs, n)
        with np.errstate(all="ignore"):
            a_norm, b_norm = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
            good = np.isfinite(b_norm) & (b_norm > 0)
            theirs, b, b_norm = theirs[good], b[good], b_norm[good]
            for low in range(0, len(ours), AT_ONCE):
                rough = (a[low : low + AT_ONCE] / a_norm[low : low + AT_ONCE, None]) @ (b / b_norm[:, None]).T
                for i, row in enumerate(rough, low):
                    if not (a_norm[i] > 0 and np.isfinite(a_norm[i])) or not len(theirs):
                        continue
                    some = np.flatnonzero(row >= np.partition(row, -k)[-k] - SLACK) if len(row) > k else np.arange(len(row))
                    exact = (b[some] * a[i]).sum(1) / (a_norm[i] * b_norm[some])
                    first = np.lexsort((place[theirs[some]], -exact))[:k]
                    found[int(ours[i])] = theirs[some][first], exact[first]
    none = (np.empty(0, np.int64), np.empty(0))
    picks, scores, counts = [], [], []
    for i in range(len(sizes[0])):
        at, s = found.get(i, none)
        if len(at) < k:  # what has no cosine fills up, by id
            rest = by_id[~np.isin(by_id, at)][: k - len(at)]
            at, s = np.concatenate([at, rest]), np.concatenate([s, np.full(len(rest), np.nan)])
        picks.append(at)
        scores.append(s)
        counts.append(len(at))
    rows, at, s = pa.array(np.repeat(np.arange(len(counts)), counts)), pa.array(np.concatenate([none[0], *picks])), np.concatenate([none[1], *scores])
    return pa.table([queries.column("n").take(rows), queries.column("query_id").take(rows), vectors.column("id").take(at), pa.array(s, mask=~np.isfinite(s))], names=["n", "query_id", "id", "score"])


#: fixed values: body temperature, ambient temperature, rigor code, lividity code -> hours
PMI_ROWS = [(34.0, 25.0, 1, 1, 2.0), (32.0, 24.0, 2, 2, 4.0), (30.0, 22.0, 3, 3, 8.0), (28.0, 20.0, 4, 4, 12.0), (26.0, 18.0, 5, 5, 18.0)]


def interval_model(spark: SparkSession, seed: int = 7):
    """A seeded random forest over the fixed rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    names = ["body", "ambient", "rigor", "lividity"]
    train = spark.createDataFrame(PMI_ROWS, "body double, ambient double, rigor int, lividity int, label double")
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), RandomForestRegressor(seed=seed, numTrees=20)]).fit(train)


def predict_interval(df: DataFrame, model) -> DataFrame:
    """Adds hours to rows of body, ambient and the two stages by name."""
    coded = df.withColumns({"rigor": stage_code(F.col("rigor_stage")), "lividity": stage_code(F.col("lividity_stage"))})
    return model.transform(coded).withColumn("hours", F.round("prediction", 2)).drop("features", "prediction", "rigor", "lividity")


def with_model(df: DataFrame, text_col: str, out_col: str, model: Callable[[str], str | None] | None = None) -> DataFrame:
    """A column from a text model given as a function; null where there is none (offline)."""
    if model is None:
        return df.withColumn(out_col, F.lit(None).cast("string"))

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else model(x))

    return df.withColumn(out_col, run(text_col))
