"""SimHash near-duplicates: fingerprints, pivot distance tables, components (op6)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim, materialize, ship_code
from .graph import components, unite
from .shingles import alike_sets, fingerprinted_sets
from .tiles import tile_pairs

#: Reference fingerprints of the distance table; a multiple of 8, as 8 distances make one long.
PIVOTS = 16
#: Fingerprints of a bucket that one task holds at most (of each side of a tile pair).
TILE_ROWS = 2048
#: Differing bits up to which pivot tables propose pairs to a search by similarity.
PIVOT_BITS = 3


def pivots(n: int = PIVOTS) -> list[int]:
    """Fixed pseudo-random reference fingerprints."""
    return [xxhash.xxh64_intdigest(f"pivot {i}".encode(), 7) for i in range(n)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """Bit-wise majority of the XXH64 of all word shingles, repeats included; 0 without words."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    size = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    k = min(words, len(found))
    digest = xxhash.xxh64_intdigest
    n = len(found) - k + 1
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist())), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        part = hashes[at : at + (1 << 15)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and fp (the fingerprint as a signed long) of each whole text; null counts as empty."""
    ship_code(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("simhash")
        for batch in batches:
            made = [signed(fingerprint(t.as_py() or "", words)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64())], names=[id_col, "fp"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, fp bigint")


def block_masks(bits: int, rows: int) -> list[int]:
    """Masks of which two fingerprints at ``bits`` or fewer differing bits agree on one at least.

    64 bits are cut into blocks; ``bits`` differing bits spoil that many blocks at most, so the others
    agree. More fingerprints take more blocks, so that agreeing parts are wide enough to keep buckets
    small: 16, 25 or 32 bits of agreement for 3 bits.
    """
    blocks = bits + (1 if rows <= 1 << 24 else 2 if rows <= 1 << 32 else 3)
    cut = [64 * i // blocks for i in range(blocks + 1)]
    part = [((1 << cut[i + 1]) - 1) ^ ((1 << cut[i]) - 1) for i in range(blocks)]
    return [sum(part[i] for i in kept) for kept in combinations(range(blocks), blocks - bits)]


def distance_table(fp: Column) -> list[Column]:
    """Hamming distances of ``fp`` to all pivots, eight to a long, one byte each."""
    found = [F.bit_count(fp.bitwiseXOR(F.lit(signed(p)))).cast("long") for p in pivots()]
    packed = []
    for at in range(0, PIVOTS, 8):
        word = found[at]
        for i in range(1, 8):
            word = word.bitwiseOR(F.shiftleft(found[at + i], 8 * i))
        packed.append(word.alias(f"p{at // 8}"))
    return packed


def spanning_links(group: np.ndarray, tile: np.ndarray, cross: np.ndarray, fp: np.ndarray, table: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links that span the sets of linked fingerprints inside each group.

    Rows come sorted by group, then by the distance to the first pivot. Row i meets row i + lag only
    while the group is the same and the first distances differ by ``bits`` or less; the other pivots
    then discard pairs by their largest coordinate difference, and the survivors are verified.
    ``cross``: rows of tile pairs of two tiles, where only rows of different tiles need to meet.
    """
    n = len(fp)
    root = np.arange(n)
    first = table[:, 0].astype(np.int16)
    coords = table.astype(np.int16)
    at, lag = np.arange(n), 0
    while len(at):
        lag += 1
        at = at[at < n - lag]
        to = at + lag
        on = (group[at] == group[to]) & (first[to] - first[at] <= bits)
        at = at[on]
        to = at + lag
        ask = (root[at] != root[to]) & ~(cross[at] & (tile[at] == tile[to]))
        i, j = at[ask], to[ask]
        for c in range(0, PIVOTS, 4):
            if not len(i):
                break
            near = np.abs(coords[i, c : c + 4] - coords[j, c : c + 4]).max(1) <= bits
            i, j = i[near], j[near]
        if len(i):
            linked = np.bitwise_count(fp[i] ^ fp[j]) <= bits
            unite(root, i[linked], j[linked])
    child = np.flatnonzero(root != np.arange(n))
    return child, root[child]


def link_buckets(rows: DataFrame, bits: int) -> DataFrame:
    """Links (a, b) between rows (bucket columns, rep, fp, p0, p1, tile, lo, hi) of the same bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        names = ("k", "key", "lo", "hi", "tile", "rep", "fp", "p0", "p1")

        def links(part: pa.Table) -> pa.RecordBatch:
            k, key, lo, hi, tile, rep, fp, p0, p1 = (part.column(c).to_numpy() for c in names)
            edge = np.flatnonzero((k[1:] != k[:-1]) | (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            group = np.zeros(len(k), np.int64)
            group[edge] = 1
            table = np.stack([p0, p1], 1).astype("<i8").view(np.uint8)
            child, top = spanning_links(np.cumsum(group), tile, lo != hi, fp.view(np.uint64), table, bits)
            return pa.RecordBatch.from_arrays([pa.array(rep[child]), pa.array(rep[top])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if held.num_rows < 8192:
                continue
            k, key, lo, hi = (held.column(c).to_numpy() for c in names[:4])
            open_ = np.flatnonzero((k == k[-1]) & (key == key[-1]) & (lo == lo[-1]) & (hi == hi[-1]))[0]
            if open_:
                yield links(held.slice(0, open_))
                held = held.slice(open_).combine_chunks()
        if held is not None:
            yield links(held.combine_chunks())

    return rows.mapInArrow(run, "a bigint, b bigint")


def alike_fingerprints(reps: DataFrame, bits: int) -> DataFrame:
    """Links (a, b) that span the classes whose fingerprints differ in ``bits`` bits or fewer."""
    masks = block_masks(bits, reps.count())
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for k, m in enumerate(masks)])
    rows = reps.select("rep", "fp", *distance_table(F.col("fp")), F.inline(keys))
    rows = tile_pairs(rows, ["k", "key"], "fp", TILE_ROWS)
    rows = rows.repartition("k", "key", "lo", "hi").sortWithinPartitions("k", "key", "lo", "hi", F.col("p0").bitwiseAND(F.lit(255)))
    return link_buckets(rows, bits)


def pivot_links(reps: DataFrame, bits: int = PIVOT_BITS) -> DataFrame:
    """Links (a, b) of classes (rep, fp) whose fingerprints are equal or, by the pivot tables, joined at ``bits`` or fewer differing bits; materialized."""
    firsts = materialize(reps.groupBy("fp").agg(F.min("rep").alias("rep")), "firsts")
    same = reps.select("fp", F.col("rep").alias("a")).join(firsts.select("fp", F.col("rep").alias("b")), "fp").where("a <> b").select("a", "b")
    return materialize(alike_fingerprints(firsts, bits).union(same), "pivots")


def near_duplicates(df: DataFrame, words: int = 3, bits: int = 3, share: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, fingerprint (16 hex digits), component_id.

    component_id is the smallest id reachable over links of ``bits`` or fewer differing bits. Ids are of
    any type that has an order (structs too). Equal fingerprints are one class with its smallest id before
    any pair is formed. Null texts count as empty (fingerprint zero, linked like any other). Rows without
    id get their fingerprint and a null component; repeated rows are kept; an empty table gives an empty
    result; other columns are ignored.

    Classes meet in buckets of agreeing bit blocks, as distances to pivots alone leave a quadratic
    number of pairs; inside a bucket the pivot table prunes, and what survives is verified exactly.

    With ``share``, links are pairs whose sets of word shingles have that Jaccard similarity or more, the
    fingerprint is of the distinct shingles, and classes are equal sets. Pairs at 0.8 lie about ten bits
    apart, up to ``bits`` (28 loses fewer than one in ten million). Pivot tables propose pairs at PIVOT_BITS
    first; neither bit blocks nor pivots prune at the larger radius, so buckets for the rest come from minima
    of the shingles' hashes (``shingles.bands``), fingerprints discard pairs inside the buckets, and whole
    sets verify all links. See ``alike_sets``.
    """
    make = fingerprints if share is None else fingerprinted_sets
    key = ["fp"] if share is None else ["h1", "h2"]
    found = materialize(make(df, words, id_col, text_col), "fingerprints")
    more = [] if share is None else [F.first("fp").alias("fp"), F.first("bands").alias("bands")]
    reps = found.where(F.col(id_col).isNotNull()).groupBy(*key).agg(F.min(id_col).alias("low"), *more)
    reps = materialize(reps.withColumn("rep", F.monotonically_increasing_id()), "classes")
    comps = components(alike_fingerprints(reps, bits) if share is None else alike_sets(df, reps, pivot_links(reps), words, bits, share, id_col, text_col))
    member = comps.join(reps.select(F.col("rep").alias("node"), "low"), "node")
    lowest = member.groupBy("component").agg(F.min("low").alias("lowest"))
    named = comps.join(lowest, "component").select(F.col("node").alias("rep"), "lowest")
    classes = reps.join(named, "rep", "left").select(*[F.col(k).alias(f"of_{k}") for k in key], F.coalesce("lowest", "low").alias("component_id"))
    joined = found.join(classes, [F.col(k) == F.col(f"of_{k}") for k in key], "left")
    return joined.select(
        id_col,
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col(id_col).isNotNull(), F.col("component_id")).alias("component_id"),
    )
