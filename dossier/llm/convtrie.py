"""Prefix trie of conversations: each node belongs to its smallest member, which owns a suffix of its own path (op13)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scan import BLOCK_BITS, ordered, positions, running_sums
from ..storage import broadcast_if_small, discard, materialize
from .common import ship_code
from .merkle import CRC_SQL

#: A conversation begins with up to MOST_SHARED - 1 turns of the first one of its HUNDRED.
MOST_SHARED, HUNDRED = 6, 100
MASK = 0xFFFFFFFF
PIECES = ["p0", "p1", "p2", "p3"]
NODE = ["depth", "k1", "k2"]


def shared_turns(conv: Column) -> Column:
    return (F.crc32(conv.cast("string").cast("binary")) % MOST_SHARED).cast("long")


def pieces(place: Column, digest: Column) -> dict[str, Column]:
    """Four numbers of 32 bits for a turn at a place. Their sums over the first turns name that sequence: they
    can be added up in any grouping, so a long conversation can be split."""
    a, b = F.xxhash64(place, digest), F.xxhash64(F.lit(1), digest, place)
    low = lambda c: c.bitwiseAND(F.lit(MASK))
    return {"p0": F.shiftrightunsigned(a, 32), "p1": low(a), "p2": F.shiftrightunsigned(b, 32), "p3": low(b)}


def node_key(sums: list[Column]) -> list[Column]:
    """128 bits of four sums."""
    low = [c.bitwiseAND(F.lit(MASK)) for c in sums]
    return [F.shiftleft(low[0], 32).bitwiseOR(low[1]), F.shiftleft(low[2], 32).bitwiseOR(low[3])]


def occurrences(turns: DataFrame, block_bits: int) -> DataFrame:
    """(c, depth, k1, k2, q1, q2, past, tokens, ends) of every rebuilt conversation c and depth: the node, its
    parent, tokens of the turns before its last one and of that one, and whether c ends there; materialized."""
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    narrow = materialize(turns.select("c", "turn", digest.alias("digest"), F.length("text").cast("long").alias("tokens")), "turns")
    rows = ordered(narrow, ["c"], [F.col("turn").asc_nulls_first(), "digest"], block_bits)
    placed = materialize(positions(rows, ["c"]).drop("turn", "range_no"), "placed")
    discard(narrow, rows)

    convs = placed.groupBy("c").agg(F.max("total").alias("total")).withColumns({"h": shared_turns(F.col("c")), "base": F.col("c") - F.col("c") % HUNDRED})
    bases = materialize(convs.where("c = base").select("base", F.col("total").alias("base_total")), "bases")
    convs = convs.join(broadcast_if_small(bases), "base", "left").withColumn("k", F.least("h", F.coalesce("base_total", F.lit(0))))
    convs = materialize(convs.select("c", "base", "h", "k", "total"), "convs")

    first = placed.where((F.col("c") % HUNDRED == 0) & (F.col("place") < MOST_SHARED - 1)).withColumns(pieces(F.col("place"), F.col("digest")))
    first = first.groupBy(F.col("c").alias("base")).agg(F.array_sort(F.collect_list(F.struct("place", "tokens", *PIECES))).alias("first"))
    none = F.array().cast(first.schema["first"].dataType)
    begun = materialize(convs.join(first, "base", "left").withColumn("first", F.coalesce("first", none)), "begun")
    add = lambda n, d: F.aggregate(F.slice("first", 1, d), F.lit(0).cast("long"), lambda a, x: a + x[n])
    zero = [F.lit(0).cast("long")] * 6
    ended = lambda d: (F.col("k") == d) & (F.col("total") <= F.col("h"))
    root = begun.select("c", F.lit(0).cast("long").alias("depth"), *[x.alias(n) for x, n in zip(zero, ["k1", "k2", "q1", "q2", "past", "tokens"])], ended(0).alias("ends"))
    shared = begun.where("k > 0").select("c", "k", "h", "total", "first", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k"))).alias("depth"))
    at = F.col("depth").cast("int")
    here, before = node_key([add(p, at) for p in PIECES]), node_key([add(p, at - 1) for p in PIECES])
    shared = shared.select("c", "depth", here[0].alias("k1"), here[1].alias("k2"), before[0].alias("q1"), before[1].alias("q2"), add("tokens", at - 1).alias("past"), F.get("first", at - 1)["tokens"].alias("tokens"), ended(F.col("depth")).alias("ends"))

    had = begun.where("total > h").select("c", "h", "k", *[add(n, F.col("k").cast("int")).alias(f"{n}_had") for n in [*PIECES, "tokens"]])
    own = placed.join(had, "c")
    later = F.col("place") >= F.col("h")
    own = own.withColumn("pos", F.col("k") + F.col("place") - F.col("h"))
    own = own.withColumns({n: F.when(later, v).otherwise(0) for n, v in pieces(F.col("pos"), F.col("digest")).items()} | {"seen": F.when(later, F.col("tokens")).otherwise(0)})
    own = materialize(own.select("c", "place", "total", "h", "pos", "tokens", "seen", "row_no", "block_no", *PIECES, *[f"{n}_had" for n in [*PIECES, "tokens"]]), "own")
    sums = running_sums(own, ["c"], {f"{n}_sum": F.col(n) for n in [*PIECES, "seen"]}).where(later)
    upto = [F.col(f"{p}_had") + F.col(f"{p}_sum") for p in PIECES]
    here, before = node_key(upto), node_key([u - F.col(p) for u, p in zip(upto, PIECES)])
    own = sums.select("c", (F.col("pos") + 1).alias("depth"), here[0].alias("k1"), here[1].alias("k2"), before[0].alias("q1"), before[1].alias("q2"), (F.col("tokens_had") + F.col("seen_sum") - F.col("tokens")).alias("past"), "tokens", (F.col("place") + 1 == F.col("total")).alias("ends"))
    return materialize(root.union(shared).union(own), "occurrences")


def end_hashes(ends: DataFrame, block_bits: int) -> DataFrame:
    """(node, ends_sha256) of the conversations that end at each node: blocks of sorted ids become one text each,
    and the texts of a node are hashed one after another, so no node's ids are ever held together."""
    rows = ordered(ends, NODE, ["c"], block_bits)
    parts = rows.groupBy(*NODE, "block_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sha = None, None

        def made(node: tuple, digest: str) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[pa.array([v], pa.int64()) for v in node], pa.array([digest])], names=[*NODE, "ends_sha256"])

        for batch in batches:
            nodes, shas = [], []
            for *node, ids in zip(*(batch.column(n).to_pylist() for n in (*NODE, "ids"))):
                if node == last:
                    sha.update(b"," + ids.encode())
                    continue
                if last is not None:
                    nodes.append(last)
                    shas.append(sha.hexdigest())
                last, sha = node, hashlib.sha256(ids.encode())
            if nodes:
                yield pa.RecordBatch.from_arrays([*[pa.array(v, pa.int64()) for v in zip(*nodes)], pa.array(shas)], names=[*NODE, "ends_sha256"])
        if last is not None:
            yield made(tuple(last), sha.hexdigest())

    kinds = ", ".join(f"{n} bigint" for n in NODE)
    return parts.repartition(*NODE).sortWithinPartitions(*NODE, "block_no").select(*NODE, "ids").mapInArrow(run, f"{kinds}, ends_sha256 string")


def prefix_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block_bits: int = BLOCK_BITS) -> DataFrame:
    """One row per node of the prefix trie of the rebuilt conversations: conv_id (its smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation's turns are ordered by turn (null first), those of one turn by the SHA-256 of role and text;
    repeated rows are turns of their own. Null roles and texts are empty. Rows without a conversation id
    belong to none and are left out. A rebuilt conversation begins with the first h turns of conversation
    c - c % 100 and goes on with its own after the first h, h = crc32(c) % 6; without turns it is a member of
    the root. Texts of any length are read once. An empty table has no nodes; other columns are ignored.

    Members' smallest ids grow with depth, so the nodes that a conversation owns are the last ones of its path,
    from one depth on. What a subtree holds beyond one copy is what its members hold from there on, less what
    they own, so one sum over the members of a node is enough. The minima are aggregated instead of taken in
    windows over nodes: the root has every conversation as member. Turns are numbered and added up in blocks.
    """
    ship_code(df.sparkSession)
    some = df.select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text")).where("c is not null")
    occ = occurrences(some, block_bits)
    first = occ.groupBy(*NODE).agg(F.min(F.struct("c", "past")).alias("m"), (F.count("*") == F.count_if("ends")).alias("leaf"))
    owners = first.groupBy("m.c").agg(F.min("m.past").alias("owns"), F.max("leaf").alias("leaf"))
    whole = occ.groupBy("c").agg(F.max(F.col("past") + F.col("tokens")).alias("all"))
    per = whole.join(owners, "c", "left").select("c", F.coalesce("owns", "all").alias("owns"), F.coalesce("leaf", F.lit(False)).cast("long").alias("leaf"))
    told = occ.join(materialize(per, "owners"), "c")
    spare = F.greatest(F.lit(0), F.col("owns") - F.col("past"))
    nodes = told.groupBy(*NODE).agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.sum("leaf").alias("n_leaves"), F.sum(spare).alias("saved_tokens"), F.min("q1").alias("q1"), F.min("q2").alias("q2"))
    nodes = materialize(nodes, "nodes")
    up = [(F.col("depth") - 1).alias("depth"), F.col("q1").alias("k1"), F.col("q2").alias("k2")]
    below = nodes.where("depth > 0").select(*up).groupBy(*NODE).agg(F.count("*").alias("n_children"))
    owned = nodes.select(F.col("depth").alias("d"), F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    ends = end_hashes(materialize(occ.where("ends").select("c", *NODE), "ends"), block_bits)
    out = nodes.join(below, NODE, "left").join(ends, NODE, "left").withColumn("d", F.col("depth") - 1).join(owned, ["d", "q1", "q2"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")
    )


#: The same rows in DuckDB SQL, by the sequences themselves.
TRIE_SQL = f"""
WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS own, {CRC_SQL.format("c")} % {MOST_SHARED} AS h FROM t GROUP BY c),
r AS (SELECT o.c, coalesce(b.own[:o.h], []) || o.own[o.h + 1:] AS turns FROM o LEFT JOIN o b ON b.c = o.c - o.c % {HUNDRED}),
p AS (SELECT c, turns, unnest(range(len(turns) + 1)) AS depth FROM r),
n AS (SELECT turns[:depth] AS path, depth, min(c) AS conv_id, count(*) AS n_convs, list(c ORDER BY c) FILTER (WHERE len(turns) = depth) AS ends FROM p GROUP BY 1, 2),
k AS (SELECT path[:depth - 1] AS path, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
m AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children, CASE WHEN n.depth = 0 THEN 0 ELSE (n_convs - 1) * length(n.path[-1].text) END AS spare FROM n LEFT JOIN k ON n.path = k.path AND n.depth = k.depth),
u AS (SELECT path, depth, n_children, spare, unnest(range(depth + 1)) AS up FROM m),
s AS (SELECT path[:up] AS path, up AS depth, sum(spare) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves FROM u GROUP BY 1, 2)
SELECT m.conv_id, m.depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens,
       sha256(coalesce(array_to_string(m.ends, ','), '')) AS ends_sha256
FROM m JOIN s ON m.path = s.path AND m.depth = s.depth LEFT JOIN m q ON q.depth = m.depth - 1 AND q.path = m.path[:m.depth - 1]"""
