"""Embedding near-duplicates: PCA-ordered tiled comparison with suffix bounds (op8)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, claim, discard, materialize, ship_code
from .graph import components, unite

#: Numbers of the vectors of a tile at most (8192 vectors of 64 dimensions); a task holds a tile pair.
TILE_NUMBERS = 1 << 19
#: Leading coordinates whose boxes tell tiles apart, slabs of a large cell at most, and rows that are multiplied at once.
LEAD, SLABS, BLOCK_ROWS = 8, 64, 256
#: Products that are held at once at most.
BLOCK_NUMBERS = 1 << 21
#: Pairs whose products grow together beyond the first dimensions.
PAIRS = 1 << 16
#: Up to this width the full second moments are gathered; of wider vectors LEADING axes by POWERS block power steps.
FULL_BASIS, LEADING, POWERS = 256, 32, 3
#: Rounding that the bounds allow for; pairs this near the threshold are decided by the exact formula.
SLACK = 1e-9


def usable(label: str, vec: str, vec_id: str) -> Column:
    v = F.col(vec)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.col(label).isNotNull() & F.col(vec_id).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~odd & F.exists(v, lambda x: x != 0)
    return F.coalesce(sound, F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that their largest component is near 1: no square under- or overflows, nothing is rounded."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def turned(u: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Unit vectors by a basis. A basis with fewer axes than dimensions gives its coordinates and then what is
    left of the vector on its own axes, so products and norms stay the same."""
    lead = u @ basis
    return lead if basis.shape[0] == basis.shape[1] else np.hstack([lead, u - lead @ basis.T])


def _summed(vectors: DataFrame, of, width: dict[int, int]) -> dict[int, np.ndarray]:
    """By dimension, the sum of ``of(unit vectors, dimension)`` over all vectors: per task, then by number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for d in np.unique(dims).tolist():
                total[d] = total.get(d, 0) + of(unit(matrix(batch.column(1).filter(pa.array(dims == d)))), d)
        for d, m in total.items():
            flat = m.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(flat.size, d, np.int32)), pa.array(np.arange(flat.size)), pa.array(flat)], names=["dim", "at", "value"])

    sums = vectors.select("dim", "vec").mapInArrow(run, "dim int, at bigint, value double").groupBy("dim", "at").agg(F.sum("value").alias("value"))
    found = {d: np.zeros(d * n) for d, n in width.items()}
    for r in sums.collect():
        found[r["dim"]][r["at"]] = r["value"]
    return {d: v.reshape(d, -1) for d, v in found.items()}


def bases(vectors: DataFrame) -> dict[int, np.ndarray]:
    """By width, orthonormal axes with the most second moment of the unit vectors first.

    Up to FULL_BASIS dimensions all axes, from the full moments (width x width numbers reach the driver).
    Beyond it the LEADING ones: each step multiplies the moments with a block of as many columns, task by
    task, and makes the sums orthogonal (width x LEADING numbers a step).
    """
    dims = [r[0] for r in vectors.select("dim").distinct().collect()]
    full = {d: d for d in dims if d <= FULL_BASIS}
    found = {}
    for d, m in (_summed(vectors.where(F.col("dim") <= FULL_BASIS), lambda u, _: u.T @ u, full) if full else {}).items():
        values, axes = np.linalg.eigh(m)
        found[d] = axes[:, np.argsort(-values, kind="stable")]
    wide = {d: LEADING for d in dims if d > FULL_BASIS}
    if wide:
        blocks = {d: np.linalg.qr(np.random.default_rng(d).normal(size=(d, LEADING)))[0] for d in wide}
        for _ in range(POWERS):
            now = blocks
            summed = _summed(vectors.where(F.col("dim") > FULL_BASIS), lambda u, d: u.T @ (u @ now[d]), wide)
            blocks = {d: np.linalg.qr(m)[0] for d, m in summed.items()}
        energy = _summed(vectors.where(F.col("dim") > FULL_BASIS), lambda u, d: np.pad(((u @ blocks[d]) ** 2).sum(0), (0, d - LEADING)), {d: 1 for d in wide})
        found |= {d: blocks[d][:, np.argsort(-energy[d].ravel()[:LEADING], kind="stable")] for d in wide}
    return found


def linked_pairs(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of ``a`` and ``b`` with cosine >= threshold.

    x, y: the same rows as unit vectors in the ordered basis. Products grow over the leading
    dimensions; what is left of a product is at most the product of the suffix norms, and a pair is
    dropped once even that cannot reach the threshold. Survivors are decided on the given vectors.
    """
    d = x.shape[1]
    stops = sorted({min(d, s) for s in (4, 16, 48)} | {d})
    part = x[:, : stops[0]] @ y[:, : stops[0]].T
    tail = lambda m, s: np.sqrt(np.maximum((m[:, s:] ** 2).sum(1), 0))
    first = np.nonzero(part + np.outer(tail(x, stops[0]), tail(y, stops[0])) >= threshold - SLACK)
    tails = [(tail(x, s), tail(y, s)) for s in stops[1:]]
    found = []
    for at in range(0, len(first[0]), PAIRS):
        i, j = (k[at : at + PAIRS] for k in first)
        got = part[i, j]
        for before, s, (tx, ty) in zip(stops, stops[1:], tails):
            got = got + np.einsum("ij,ij->i", x[i, before:s], y[j, before:s])
            on = got + tx[i] * ty[j] >= threshold - SLACK
            i, j, got = i[on], j[on], got[on]
        p, q = a[i], b[j]
        exact = (p * q).sum(1) / (np.sqrt((p * p).sum(1)) * np.sqrt((q * q).sum(1)))
        on = exact >= threshold
        found.append((i[on], j[on]))
    return tuple(np.concatenate(k) for k in zip(*found)) if found else first


def placed_vectors(classes: DataFrame, basis, side: float) -> DataFrame:
    """``classes`` with the leading coordinates of each unit vector and its cell (c1, c2); materialized."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("embed")
        for batch in batches:
            dims = batch.column(0).to_numpy()
            lead = np.zeros((len(dims), LEAD))
            for d in np.unique(dims).tolist():
                x = unit(matrix(batch.column(1).filter(pa.array(dims == d)))) @ basis.value[d][:, :LEAD]
                lead[dims == d, : x.shape[1]] = x
            at = np.floor(lead[:, :2] / side).astype(np.int32)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(lead.ravel()), LEAD).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(at[:, 0]), pa.array(at[:, 1])], names=[*batch.schema.names, "lead", "c1", "c2"])

    columns = ["dim", "vec", "label", "rep", "low", "mult"]
    kinds = dict(classes.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", lead array<double>, c1 int, c2 int"
    return materialize(classes.select(*columns).mapInArrow(run, schema), "placed")


def tile_vectors(placed: DataFrame, side: float) -> tuple[DataFrame, DataFrame]:
    """``placed`` with a tile number, each vector in one tile of bounded size; and the tile pairs (lo, hi, pair) to compare.

    A label of up to TILE_NUMBERS numbers is one cell. A cell of more than that is cut into slabs at quantiles of the third coordinate, and a
    slab that ties leave too large by a hash. Of each tile the box of its leading coordinates is kept; two
    tiles are compared only if their cells are neighbours and their boxes come as near as linked vectors.
    """
    cell = ["label", "dim", "c1", "c2"]
    much = lambda n: F.ceil(n * F.col("dim") / TILE_NUMBERS).cast("int")
    few = materialize(placed.groupBy("label", "dim").agg(F.count("*").alias("n")).where(much(F.col("n")) <= 1).select("label", "dim", F.lit(True).alias("one")), "few")
    placed = placed.join(broadcast_if_small(few), ["label", "dim"], "left").withColumns({c: F.when(F.col("one"), 0).otherwise(F.col(c)).cast("int") for c in ("c1", "c2")}).drop("one")
    at = F.array(*[F.lit(i / SLABS) for i in range(1, SLABS)])
    cells = placed.groupBy(*cell).agg(F.count("*").alias("n"), F.percentile_approx(F.element_at("lead", 3), at, 2000).alias("q")).where(much(F.col("n")) > 1)
    cells = materialize(cells.select(*cell, F.least(much(F.col("n")), F.lit(SLABS)).alias("slabs"), "q"), "cells")
    bounds = F.transform(F.sequence(F.lit(1), F.col("slabs") - 1), lambda i: F.get("q", (i * SLABS / F.col("slabs")).cast("int") - 1))
    slab = F.when(F.col("slabs") > 1, F.size(F.filter(bounds, lambda b: b < F.element_at("lead", 3)))).otherwise(0)
    rows = placed.join(broadcast_if_small(cells), cell, "left").withColumn("slab", slab).drop("q", "slabs")
    parts = materialize(rows.groupBy(*cell, "slab").agg(F.count("*").alias("n")).where(much(F.col("n")) > 1).select(*cell, "slab", much(F.col("n")).alias("parts")), "parts")
    rows = rows.join(broadcast_if_small(parts), [*cell, "slab"], "left").withColumn("part", F.pmod(F.xxhash64("rep"), F.coalesce("parts", F.lit(1))).cast("int"))

    box = [f(F.element_at("lead", i + 1)).alias(f"{n}{i}") for i in range(LEAD) for f, n in ((F.min, "min"), (F.max, "max"))]
    tiles = materialize(rows.groupBy(*cell, "slab", "part").agg(*box).withColumn("tile", F.monotonically_increasing_id()), "tiles")
    steps = F.array(*[F.struct((F.col("c1") + a).alias("g1"), (F.col("c2") + b).alias("g2")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    one = tiles.select("label", "dim", F.col("tile").alias("lo"), *[F.col(f"{n}{i}").alias(f"{n}{i}_") for i in range(LEAD) for n in ("min", "max")], F.inline(steps))
    both = one.join(tiles.withColumnsRenamed({"c1": "g1", "c2": "g2", "tile": "hi"}), ["label", "dim", "g1", "g2"]).where("lo <= hi")
    gap = sum(F.pow(F.greatest(F.lit(0.0), F.col(f"min{i}") - F.col(f"max{i}_"), F.col(f"min{i}_") - F.col(f"max{i}")), 2) for i in range(LEAD))
    pairs = materialize(both.where(gap <= side * side).select("lo", "hi").withColumn("pair", F.monotonically_increasing_id()), "pairs")
    numbered = rows.join(broadcast_if_small(tiles.select(*cell, "slab", "part", "tile")), [*cell, "slab", "part"])
    return numbered.select("tile", "vec", "rep", "mult"), pairs


def near_vectors(df: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: ``id_col``, n_links, component_id, kept.

    Only vectors of equal, non-null labels and equal widths are compared. Vectors that are null,
    empty, zero, hold null or non-finite components, or have no label or id link with nothing: they
    have 0 links and are their own component (kept; without id: null and false). Equal vectors are one
    class from the start, with its size; repeated rows count as vectors. Ids are of any type that has an
    order. Empty tables give an empty result; other columns are ignored.

    Cells are squares of the two leading basis coordinates with the side sqrt(2 - 2 threshold), the
    largest distance of linked unit vectors: links lie in one cell or in neighbouring ones. See
    ``tile_vectors`` for what is compared. A tile pair returns link counts and a spanning star, not its
    pairs. Vectors of over FULL_BASIS dimensions have LEADING principal axes and the rest of the vector behind
    them; the result is exact either way. Components of any size count: vectors are scaled by powers of two
    before squares are taken. Work is quadratic where vectors lie within that distance in all
    leading coordinates, as each vector's links are counted.
    """
    spark = df.sparkSession
    ship_code(spark)
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), F.col(label_col).alias("label"))
    sound = rows.where(usable("label", "vec", "id"))
    classes = sound.groupBy("label", "vec").agg(F.min("id").alias("low"), F.count("*").alias("mult")).withColumn("dim", F.size("vec"))
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    basis = spark.sparkContext.broadcast(bases(classes))
    side = max(math.sqrt(max(2 - 2 * threshold, 0)), 1e-3) + SLACK
    placed = placed_vectors(classes, basis, side)
    discard(classes)
    tiled, pairs = tile_vectors(placed, side)
    meets = pairs.select("pair", "lo", "hi", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("tile"))
    tiled = tiled.join(broadcast_if_small(meets), "tile")

    def compare(t: pa.Table) -> pa.Table:
        tile, rep, mult = (t.column(c).to_numpy(zero_copy_only=False) for c in ("tile", "rep", "mult"))
        lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
        counts, root = np.zeros(len(rep), np.int64), np.arange(len(rep))
        v = scaled(matrix(t.column("vec").combine_chunks()))
        u = turned(unit(v), basis.value[v.shape[1]])
        ones, others = np.flatnonzero(tile == lo), np.flatnonzero(tile == hi)
        step = max(1, min(BLOCK_ROWS, BLOCK_NUMBERS // len(others)))
        for at in range(0, len(ones), step):
            p = ones[at : at + step]
            to = others if lo != hi else others[at:]
            i, j = linked_pairs(u[p], u[to], v[p], v[to], threshold)
            i, j = p[i], to[j]
            if lo == hi:
                i, j = i[i < j], j[i < j]
            np.add.at(counts, i, mult[j])
            np.add.at(counts, j, mult[i])
            unite(root, i, j)
        some, child = np.flatnonzero(counts), np.flatnonzero(root != np.arange(len(rep)))
        return pa.table({"a": np.concatenate([rep[some], rep[child]]), "b": np.concatenate([counts[some], rep[root[child]]]), "link": np.concatenate([np.zeros(len(some), bool), np.ones(len(child), bool)])})

    met = materialize(tiled.groupBy("pair").applyInArrow(compare, "a bigint, b bigint, link boolean"), "links")
    counts = met.where("not link").groupBy("a").agg(F.sum("b").alias("others")).withColumnRenamed("a", "rep")
    comps = components(met.where("link").select("a", "b")).withColumnRenamed("node", "rep")
    lowest = comps.join(placed.select("rep", "low"), "rep").groupBy("component").agg(F.min("low").alias("lowest"))
    done = placed.select("label", "vec", "rep", "low", "mult").join(counts, "rep", "left").join(comps.join(lowest, "component"), "rep", "left")
    done = done.select("label", "vec", (F.coalesce("others", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("lowest", "low").alias("component_id"))
    linked = sound.join(done, ["label", "vec"]).select("id", "n_links", "component_id")
    alone = rows.where(~usable("label", "vec", "id")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
