"""Word-shingle sets behind the SimHash operator's links by similarity: minima that deal out buckets, and verification by whole sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, claim, materialize, ship_code
from .graph import components, unite

#: Bands of a signature and minima of a band. A pair at similarity 0.8 shares no band with a chance of (1 - 0.8^4)^32 = 5e-8.
BANDS, MINIMA = 32, 4
#: Documents of a bucket that one task holds at most (of each side of a tile pair).
TILE_ROWS = 512
#: Shingles that are ranked at once.
PART = 1 << 12
#: Sets below this size are not told apart by fingerprints: too few shingles vote.
VOTERS = 32

_rng = np.random.default_rng(5)
_MASK = _rng.integers(0, 1 << 64, BANDS * MINIMA, np.uint64)[:, None]
_ODD = _rng.integers(0, 1 << 64, BANDS * MINIMA, np.uint64)[:, None] | np.uint64(1)


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct XXH64 of the shingles; words as in ``simhash.fingerprint``. A shorter text is one shingle."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    k = min(words, len(found))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[k - 1 :].tolist())), np.uint64))


def bands(found: np.ndarray) -> np.ndarray:
    """One key for each band: a hash of the band's minima and its number. No keys without shingles."""
    if not len(found):
        return np.empty(0, np.int64)
    low = np.full(BANDS * MINIMA, (1 << 64) - 1, np.uint64)
    for at in range(0, len(found), PART):
        low = np.minimum(low, ((found[at : at + PART] ^ _MASK) * _ODD).min(1))
    raw = low.astype("<u8").tobytes()
    size = MINIMA * 8
    return np.array([xxhash.xxh64_intdigest(raw[i * size : (i + 1) * size], i) for i in range(BANDS)], np.uint64).view(np.int64)


def majority(found: np.ndarray) -> int:
    """Bit-wise majority of distinct hashes, as a signed 64-bit number; 0 without any."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), 1 << 15):
        part = found[at : at + (1 << 15)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(found), bitorder="little").tobytes(), "little", signed=True)


def fingerprinted_sets(df: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """``id_col``, fp of the distinct shingles, h1 and h2 (128 bits of the set) and bands of each whole text."""
    ship_code(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("shingles")
        for batch in batches:
            sets = [shingles(t.as_py() or "", words) for t in batch.column(1)]
            h = b"".join(xxhash.xxh3_128_digest(s.astype("<u8").tobytes()) for s in sets)
            h1, h2 = np.frombuffer(h, "<i8").reshape(-1, 2).T
            fp = np.array([majority(s) for s in sets], np.int64)
            keys = pa.array([bands(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), pa.array(h1), pa.array(h2), keys], names=[id_col, "fp", "h1", "h2", "bands"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, fp bigint, h1 bigint, h2 bigint, bands array<bigint>")


def _sets(df: DataFrame, words: int, text_col: str) -> DataFrame:
    """h1, h2, size and set (hashes, eight bytes each) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("shingles")
        for batch in batches:
            sets = [shingles(t.as_py() or "", words).astype("<u8").tobytes() for t in batch.column(0)]
            h1, h2 = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, sets)), "<i8").reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array([len(s) // 8 for s in sets], pa.int64()), pa.array(sets, pa.binary())], names=["h1", "h2", "size", "set"])

    return df.select(text_col).mapInArrow(run, "h1 bigint, h2 bigint, size bigint, set binary")


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Shared elements of two sorted sets that are not empty."""
    if len(a) < len(b):
        a, b = b, a
    return int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())


def _verified(pairs: DataFrame, share: float) -> DataFrame:
    """Links (a, b) of those pairs (a, b, sa, sb) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                p, q = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                n = common(p, q)
                on.append(n >= share * (len(p) + len(q) - n) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(on, pa.bool_()))

    return pairs.mapInArrow(run, "a bigint, b bigint")


def spanning_links(sets: list[np.ndarray], fp: np.ndarray, start: np.ndarray, tile: np.ndarray, lo: int, cross: bool, bits: int, share: float) -> np.ndarray:
    """For each set of a tile pair the first set of its component over links of ``share`` or more.

    ``start``: sets with the same number are linked already; those that are linked do not meet again.
    ``cross``: only sets of different tiles need to meet. Fingerprints discard pairs of large sets.
    """
    n = len(sets)
    first, at = np.unique(start, return_index=True)
    root, size = at[np.searchsorted(first, start)], np.array([len(s) for s in sets])
    for i in np.flatnonzero(tile == lo) if cross else range(n - 1):
        to = np.flatnonzero(tile != lo) if cross else np.arange(i + 1, n)
        small, large = np.minimum(size[to], size[i]), np.maximum(size[to], size[i])
        ask = (root[to] != root[i]) & (small >= share * large - 1e-9) & ((small < VOTERS) | (np.bitwise_count(fp[to] ^ fp[i]) <= bits))
        to = to[ask]
        if not len(to):
            continue
        flat = np.concatenate([sets[j] for j in to])
        hit = sets[i][np.minimum(np.searchsorted(sets[i], flat), size[i] - 1)] == flat
        both = np.add.reduceat(hit.astype(np.int64), np.cumsum(size[to]) - size[to])
        to = to[both >= share * (size[i] + size[to] - both) - 1e-9]
        unite(root, np.full(len(to), i), to)
    return root


def _link_tiles(rows: DataFrame, bits: int, share: float) -> DataFrame:
    """Links (a, b) between rows (key, lo, hi, tile, rep, fp, start, set) of the same bucket and tile pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def links() -> pa.RecordBatch:
            tile, rep, fp, start = (np.array([r[i] for r in held], np.int64) for i in range(4))
            cross = now is not None and now[1] != now[2]
            root = spanning_links([np.frombuffer(r[4], "<u8") for r in held], fp.view(np.uint64), start, tile, now[1] if now else 0, cross, bits, share)
            child = np.flatnonzero(start != start[root])
            return pa.RecordBatch.from_arrays([pa.array(rep[child]), pa.array(rep[root[child]])], names=["a", "b"])

        for batch in batches:
            for key, lo, hi, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, lo, hi) != now:
                    if len(held) > 1:
                        yield links()
                    now, held = (key, lo, hi), []
                held.append(row)
        if len(held) > 1:
            yield links()

    return rows.select("key", "lo", "hi", "tile", "rep", "fp", "start", "set").mapInArrow(run, "a bigint, b bigint")


def _tiled(rows: DataFrame) -> DataFrame:
    """Rows (key, rep, start, ...) with the tile pairs (lo, hi) in which they meet the rows of other starts.

    Rows of a bucket's commonest start are linked already and meet only the others: they have tiles of
    their own, behind those of the others, and go to pairs with them only.
    """
    sizes = rows.groupBy("key", "start").agg(F.count("*").alias("n"))
    kinds = sizes.groupBy("key").agg(F.max_by("start", F.struct("n", "start")).alias("most"), F.max("n").alias("top"), F.sum("n").alias("all")).where("all > top")
    tiles = lambda c: F.ceil(c / TILE_ROWS).cast("int")
    kinds = materialize(kinds.select("key", "most", tiles(F.col("all") - F.col("top")).alias("few"), tiles(F.col("top")).alias("many")), "kinds")
    met = rows.join(broadcast_if_small(kinds), "key")
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("start") == F.col("most"), F.col("many")).otherwise(F.col("few"))).cast("int")
    met = met.withColumn("tile", F.when(F.col("start") == F.col("most"), F.col("few") + own).otherwise(own))
    last = F.when(F.col("start") == F.col("most"), F.col("few") - 1).otherwise(F.col("few") + F.col("many") - 1)
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return met.withColumns({"lo": F.least("tile", "other"), "hi": F.greatest("tile", "other")}).drop("most", "few", "many", "other")


def alike_sets(df: DataFrame, reps: DataFrame, proposed: DataFrame, words: int, bits: int, share: float, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) that span the classes (rep, low, fp, h1, h2, bands) at a similarity of ``share`` or more.

    Pairs (a, b) that the pivot tables ``proposed`` are verified in the first pass, and what that links does not
    meet again. For the rest classes meet in the buckets of their bands; buckets with the same members count once, and only
    documents that meet others are read again, for their whole sets. First every member is verified
    against its bucket's first one, which is linear; then buckets whose members are not all linked by
    that are compared inside, in tiles of bounded size, where linked ones do not meet again. Each link is
    verified by both sets, so none is wrong; below a similarity of 0.8 bands miss more (``BANDS``). Texts
    without words are one class and link with no other.
    """
    buckets = reps.select("rep", "fp", F.explode("bands").alias("key"))
    groups = buckets.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.min("rep").alias("first"), F.min_by("fp", "rep").alias("first_fp")).where("n > 1")
    groups = materialize(groups.groupBy("n", "x", "first").agg(F.min("key").alias("key"), F.first("first_fp").alias("first_fp")), "buckets")
    rows = materialize(buckets.join(broadcast_if_small(groups.select("key", "first", "first_fp")), "key"), "met")
    asked = rows.select("rep").union(proposed.select("a")).union(proposed.select("b")).distinct()
    met = reps.join(asked, "rep", "left_semi").select("rep", "low", "h1", "h2")
    met = materialize(met, "candidates")
    ids = materialize(met.select(F.col("low").alias(id_col)).distinct(), "ids")
    again = df.select(id_col, text_col).join(broadcast_if_small(ids), id_col, "left_semi")
    sets = _sets(again, words, text_col).groupBy("h1", "h2").agg(F.first("size").alias("size"), F.first("set").alias("set"))
    sets = materialize(met.select("rep", "h1", "h2").join(sets, ["h1", "h2"]).select("rep", "size", "set"), "sets")

    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("first_fp"))) <= bits
    pairs = rows.where("rep <> first").select(F.col("rep").alias("a"), F.col("first").alias("b"), near.alias("near"))
    pairs = pairs.union(proposed.select("a", "b", F.lit(True))).distinct()
    pairs = pairs.join(sets.select(F.col("rep").alias("a"), F.col("size").alias("na"), F.col("set").alias("sa")), "a")
    pairs = pairs.join(sets.select(F.col("rep").alias("b"), F.col("size").alias("nb"), F.col("set").alias("sb")), "b")
    small, large = F.least("na", "nb"), F.greatest("na", "nb")
    pairs = pairs.where((small >= share * large - 1e-9) & (F.col("near") | (small < VOTERS)))
    links = materialize(_verified(pairs.select("a", "b", "sa", "sb"), share), "links")
    comps = components(links).select(F.col("node").alias("rep"), "component")
    started = materialize(rows.select("key", "rep", "fp").join(comps, "rep", "left").select("key", "rep", "fp", F.coalesce("component", "rep").alias("start")), "started")
    tiled = _tiled(started).join(sets.select("rep", "set"), "rep")
    tiled = tiled.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return links.union(_link_tiles(tiled, bits, share))
