"""Splitting of groups into tiles of bounded size, so that no task holds an unbounded group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize


def tile_pairs(df: DataFrame, keys: list[str], by: str, tile_rows: int) -> DataFrame:
    """Rows of ``df`` with the tile pairs in which they meet every other row of their group.

    Adds tile, lo and hi (ints). A group of up to ``tile_rows`` rows is one pair (0, 0). A larger one
    is dealt by a hash of ``by`` over k tiles, and each of its rows goes to the k pairs that hold its
    tile; two rows of different tiles meet in one pair, two of the same tile in (tile, tile). Large
    groups are found by a count with partial sums; their keys are joined back by broadcast only if few.
    """
    large = materialize(df.groupBy(*keys).count().where(F.col("count") > tile_rows).select(*keys, F.ceil(F.col("count") / tile_rows).cast("int").alias("tiles")), "large")
    tiled = df.join(broadcast_if_small(large), keys, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    tiled = tiled.withColumn("tile", F.when(F.col("tiles") == 1, 0).otherwise(F.pmod(F.xxhash64(by), F.col("tiles")).cast("int")))
    met = F.when(F.col("tiles") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("tiles") - 1))
    tiled = tiled.withColumn("other", F.explode(met))
    return tiled.withColumns({"lo": F.least("tile", "other"), "hi": F.greatest("tile", "other")}).drop("tiles", "other")
