"""Merkle dataset manifest: aligned subtrees in range-sorted partitions, ragged nodes by coordinate, proofs (op11)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scan import BLOCK_BITS, offsets, ordered
from ..storage import broadcast_if_small, discard, materialize
from .common import ship_code

#: Consecutive nodes that become one node of the next level.
FAN = 8
#: A path: for each level the siblings left and right of a node, joined.
PATH = "array<struct<before:string,after:string>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def record_hash(*fields: Column) -> Column:
    """Hash of a record: of each field ``-`` if it is null, else its UTF-8 byte count, ``:`` and itself."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda a, x: F.sha2(F.concat(x["before"], a, x["after"]), 256))


def proof_hash(path: Column) -> Column:
    """Hash of all siblings of a path, level by level, from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), ""), 256)


def joined_hash(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def climb(first: int, nodes: list[str], count: int) -> Iterator[tuple[int, list[str], int, int, list[str]]]:
    """Level by level (first, nodes, count, lowest, parents): the nodes from place ``first`` on that a stretch of
    leaves completes by itself, of ``count`` in the group, and their parents that it completes, from ``lowest`` on."""
    while True:
        last = first + len(nodes)
        low, high = -(-first // FAN), last // FAN if last < count else -(-last // FAN)
        parents = [joined_hash(nodes[j * FAN - first : (j + 1) * FAN - first]) for j in range(low, high)] if count > 1 else []
        yield first, nodes, count, low, parents
        if not parents:
            return
        first, nodes, count = low, parents, -(-count // FAN)


def stretches(rows: pa.Table) -> Iterator[tuple[str, int, int, pa.Table]]:
    """(group, place, total, rows in order) of each stretch of a group inside a block."""
    rows = rows.sort_by("row_no")
    names = rows.column("g").combine_chunks()
    cut = np.flatnonzero(np.concatenate([[True], np.asarray(names[1:].to_numpy(zero_copy_only=False) != names[:-1].to_numpy(zero_copy_only=False))])) if len(names) else []
    for a, b in zip(cut, [*cut[1:], len(names)]):
        part = rows.slice(a, b - a)
        yield names[int(a)].as_py(), part.column("place")[0].as_py(), part.column("total")[0].as_py(), part


def leaves_of(part: pa.Table) -> list[str]:
    return [x.as_py().hex() for x in part.column("leaf")]


def ragged(rows: pa.Table) -> pa.Table:
    """Nodes of a block that their own stretch can't complete a parent of, and roots."""
    found: dict[str, list] = {c: [] for c in ("g", "total", "level", "place", "node")}
    for group, place, total, part in stretches(rows):
        for level, (first, nodes, _, low, parents) in enumerate(climb(place, leaves_of(part), total)):
            a, b = (low * FAN - first, (low + len(parents)) * FAN - first) if parents else (len(nodes), len(nodes))
            for i in [*range(a), *range(b, len(nodes))]:
                for c, v in zip(found, (group, total, level, first + i, nodes[i])):
                    found[c].append(v)
    return pa.table([pa.array(found["g"], pa.string()), pa.array(found["total"], pa.int64()), pa.array(found["level"], pa.int32()), pa.array(found["place"], pa.int64()), pa.array(found["node"], pa.string())], names=list(found))


def with_paths(keep: list[str]):
    """For a block's rows and the runs of siblings above it that other blocks have part in: the rows' paths."""

    def run(rows: pa.Table, above: pa.Table) -> pa.Table:
        runs = {(g, k, j): m for g, k, j, m in zip(*(above.column(c).to_pylist() for c in ("g", "level", "run", "members")))}
        done = []
        for group, place, total, part in stretches(rows):
            own = list(climb(place, leaves_of(part), total))
            depth, count = 0, total
            while count > 1:
                depth, count = depth + 1, -(-count // FAN)
            at = np.arange(place, place + len(part))
            before, after, pick = [], [], np.zeros((len(part), depth), np.int64)
            for k in range(depth):
                low, high = place // FAN**k, (place + len(part) - 1) // FAN**k
                pick[:, k] = len(before) + at // FAN**k - low
                first, nodes, _, lowest, parents = own[k] if k < len(own) else (0, [], 0, 0, [])
                for j in range(low // FAN, high // FAN + 1):
                    members = nodes[j * FAN - first : (j + 1) * FAN - first] if lowest <= j < lowest + len(parents) else runs[group, k, j]
                    for i in range(max(low, j * FAN), min(high, j * FAN + FAN - 1) + 1):
                        before.append("".join(members[: i - j * FAN]))
                        after.append("".join(members[i - j * FAN + 1 :]))
            levels = pa.StructArray.from_arrays([pa.array(before, pa.string()).take(pa.array(pick.ravel())), pa.array(after, pa.string()).take(pa.array(pick.ravel()))], names=["before", "after"])
            path = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * depth), levels)
            done.append(part.select(["g", "leaf", *keep]).append_column("path", path))
        return pa.concat_tables(done)

    return run


def hash_trees(leaves: DataFrame, order: list[Column | str], keep: list[str], block_bits: int = BLOCK_BITS) -> tuple[DataFrame, DataFrame]:
    """A tree for each group g of ``leaves`` (g string, leaf as hexadecimal digits, ``keep``), its leaves in ``order``.

    Returns the leaves (g, leaf as bytes, keep) with their paths, and (g, root). Leaves are range-sorted;
    counts for each group and partition give every leaf its place. A block completes the aligned subtrees
    that it holds, up to 14 ragged nodes a level are shuffled by (group, level, run) and finish the upper
    levels there. A block then gets back only the runs at its own ends, two a level.
    """
    rows = ordered(leaves.withColumn("leaf", F.unhex("leaf")), ["g"], order, block_bits)
    at = offsets(rows, ["g"])
    placed = rows.join(broadcast_if_small(at), ["g", "range_no"]).withColumn("place", F.col("before") + F.col("row_no") - F.col("first_row"))
    some = placed.select("g", "leaf", "row_no", "block_no", "place", "total")
    nodes = materialize(some.groupBy("block_no").applyInArrow(ragged, "g string, total bigint, level int, place bigint, node string"), "nodes")
    most = at.agg(F.max("total")).first()[0] or 0
    left = lambda k: F.ceil(F.col("total") / F.lit(float(FAN**k)))
    names, made, runs, roots = ["g", "total", "place", "node"], None, None, None
    level = 0
    while most:
        here = nodes.where(F.col("level") == level).select(*names)
        here = here if made is None else here.unionByName(made)
        top = here.where(left(level) == 1).select("g", F.col("node").alias("root"))
        roots = top if roots is None else roots.union(top)
        if most == 1:
            break
        met = here.where(left(level) > 1).groupBy("g", "total", F.floor(F.col("place") / FAN).alias("run")).agg(F.array_sort(F.collect_list(F.struct("place", "node"))).alias("m"))
        met = materialize(met.select("g", "total", "run", F.transform("m", lambda x: x["node"]).alias("members")), "runs")
        made = met.select("g", "total", F.col("run").alias("place"), F.sha2(F.array_join("members", ""), 256).alias("node"))
        one = met.select("g", F.lit(level).alias("level"), "run", "members")
        runs = one if runs is None else runs.union(one)
        level, most = level + 1, -(-most // FAN)
    if roots is None:
        return leaves.select("g", F.unhex("leaf").alias("leaf"), *keep, F.array().cast(PATH).alias("path")).limit(0), leaves.select("g", F.col("leaf").alias("root")).limit(0)
    roots = materialize(roots, "roots")
    if runs is None:
        return rows.select("g", "leaf", *keep, F.array().cast(PATH).alias("path")), roots
    ends = placed.groupBy("block_no", "g").agg(F.min("place").alias("a"), F.max("place").alias("b"), F.max("total").alias("total"))
    steps = F.array(*[F.when(left(k) > 1, F.lit(k)) for k in range(level)])
    ends = ends.select("block_no", "g", "a", "b", F.explode(F.array_compact(steps)).alias("level"))
    run_of = lambda c: F.floor(F.col(c) / F.pow(F.lit(float(FAN)), F.col("level") + 1))
    ends = ends.select("block_no", "g", "level", F.explode(F.array_distinct(F.array(run_of("a"), run_of("b")))).alias("run"))
    above = materialize(ends.join(runs, ["g", "level", "run"]).select("block_no", "g", "level", "run", "members"), "above")
    discard(nodes)
    kinds = dict(leaves.dtypes)
    schema = ", ".join(["g string", "leaf binary", *[f"`{c}` {kinds[c]}" for c in keep], f"path {PATH}"])
    wide = placed.select("g", "leaf", "row_no", "block_no", "place", "total", *keep)
    return wide.groupBy("block_no").cogroup(above.groupBy("block_no")).applyInArrow(with_paths(keep), schema), roots


def manifest(df: DataFrame, fields: list[str], group_col: str = "lang", id_col: str = "doc_id", carry: dict[str, Column] | None = None, block_bits: int = BLOCK_BITS) -> DataFrame:
    """``id_col``, leaf, subroot, root, path (the proof) and the columns of ``carry`` of every row of ``df``.

    A leaf hashes the ``fields`` of a row. Per group, leaves ascend by id (null first; rows of one id by
    their leaf, so equal rows are leaves of their own and any order of them is the same); groups ascend
    bytewise, the null one first, apart from the empty one. Runs of FAN nodes become a node until one is
    left; a lone leaf is its group's subroot, a lone subroot the root. A path has, level by level, the
    siblings left and right of the node, none for a run of one. An empty table gives an empty result;
    texts of any length are hashed whole; other columns are ignored and their names don't matter.
    """
    ship_code(df.sparkSession)
    extra = {f"carry{i}": c for i, c in enumerate((carry or {}).values())}
    g = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    leaves = materialize(df.select(g.alias("g"), F.col(id_col).alias("id"), record_hash(*map(F.col, fields)).alias("leaf"), *[c.alias(n) for n, c in extra.items()]), "leaves")
    paths, subroots = hash_trees(leaves, [F.col("id").asc_nulls_first(), "leaf"], ["id", *extra], block_bits)
    tops, roots = hash_trees(subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("root").alias("leaf")), ["name"], ["name"], block_bits)
    root = roots.first()
    known = materialize(tops.select(F.col("name").alias("g"), F.lower(F.hex("leaf")).alias("subroot"), F.col("path").alias("upper")), "tops")
    out = paths.join(broadcast_if_small(known), "g")
    named = [F.col(n).alias(c) for n, c in zip(extra, carry or {})]
    return out.select(F.col("id").alias(id_col), F.lower(F.hex("leaf")).alias("leaf"), "subroot", F.lit(root["root"] if root else None).cast("string").alias("root"), F.concat("path", "upper").alias("path"), *named)


def document_manifest(docs: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every document.

    Texts of documents whose id's checksum 3 divides are tampered with (A to Z in lower case; null ids and
    texts are left alone); folded_root is what their leaf and the original siblings lead to.
    """
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    lowered = record_hash(*[F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in fields])
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    made = manifest(docs, fields, carry={"tampered": F.when(chosen, F.unhex(lowered))}, block_bits=block_bits)
    leaf = F.coalesce(F.lower(F.hex("tampered")), F.col("leaf"))
    found = made.withColumn("folded_root", folded(leaf, F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", proof_hash(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _tree_sql(name: str, levels: int) -> str:
    """CTEs of a forest over {name}0 (g, i, h, n: nodes of the level): {name}k has level k; a finished tree stays as it is."""
    out = []
    for k in range(levels):
        a, b = f"{name}{k}", f"{name}{k + 1}"
        out.append(f"{a}r AS (SELECT g, i // {FAN} AS j, list(h ORDER BY i) AS m, max(n) AS n FROM {a} GROUP BY 1, 2)")
        out.append(f"{b} AS (SELECT g, j AS i, CASE WHEN n = 1 THEN m[1] ELSE sha256(array_to_string(m, '')) END AS h, (n + {FAN - 1}) // {FAN} AS n FROM {a}r)")
    return ",\n".join(out)


def _fold_sql(name: str, levels: int, source: str, key: str) -> str:
    """CTEs from ``source`` ({key}, i, ids, leaf, cur, sib): up to {name}f{levels} with cur folded and sib grown."""
    out, last = [], source
    for k in range(levels):
        at = f"CAST(s.i % {FAN} AS INT)"
        out.append(
            f"{name}f{k + 1} AS (SELECT s.* EXCLUDE (i, cur, sib), s.i // {FAN} AS i, "
            f"CASE WHEN r.n = 1 THEN s.cur ELSE sha256(array_to_string(r.m[:{at}], '') || s.cur || array_to_string(r.m[{at} + 2:], '')) END AS cur, "
            f"CASE WHEN r.n = 1 THEN s.sib ELSE s.sib || array_to_string(r.m[:{at}], '') || array_to_string(r.m[{at} + 2:], '') END AS sib "
            f"FROM {last} s JOIN {name}{k}r r ON s.{key} = r.g AND s.i // {FAN} = r.j)"
        )
        last = f"{name}f{k + 1}"
    return ",\n".join(out)


#: CRC-32 of a column as decimal text, bit by bit.
CRC_SQL = "xor(list_reduce([4294967295] || list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda y: CAST(ascii(y) AS BIGINT)), lambda c, b: list_reduce([xor(c, b)] || CAST([0,0,0,0,0,0,0,0] AS BIGINT[]), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"


def _leaf_sql(text: str) -> str:
    part = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    return "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: The same rows in DuckDB SQL, for up to 8**8 documents of a language and 8**3 languages.
MERKLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {_leaf_sql("text")} AS leaf,
      CASE WHEN {CRC_SQL.format("doc_id")} % 3 = 0 THEN {_leaf_sql(f"translate(text, '{UPPER}', '{LOWER}')")} END AS other FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
a0 AS (SELECT g, i, leaf AS h, n FROM l),
{_tree_sql("a", 8)},
b0 AS (SELECT '' AS g, row_number() OVER (ORDER BY encode(g)) - 1 AS i, h, count(*) OVER () AS n, g AS name FROM a8),
{_tree_sql("b", 3)},
s AS (SELECT doc_id, g, leaf, i, coalesce(other, leaf) AS cur, '' AS sib FROM l),
{_fold_sql("a", 8, "s", "g")},
t AS (SELECT f.doc_id, f.leaf, b0.h AS subroot, b0.g, b0.i, f.cur, f.sib FROM af8 f JOIN b0 ON f.g = b0.name),
{_fold_sql("b", 3, "t", "g")}
SELECT f.doc_id, f.leaf, f.subroot, b3.h AS root, sha256(f.sib) AS proof_sha256, f.cur AS folded_root, f.cur = b3.h AS verified FROM bf3 f, b3"""
