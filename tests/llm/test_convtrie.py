"""Prefix trie against plain dictionaries, and against its SQL."""

import hashlib
import random
import zlib

import pytest

from dossier.llm import convtrie

from ..oracle import connect, duck_rows, spark_rows

KIND = "conv_id long, turn long, role string, text string, depth int, k1 string, c string"


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def plain(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = turns.get(c - c % 100, [])[:h] + turns[c][h:]
    members = {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for path, own_members in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in children
            saved[path[:d]] += (len(own_members) - 1) * len(path[-1][1]) if path else 0
    out = []
    for path, m in members.items():
        ends = sorted(c for c in m if len(rebuilt[c]) == len(path))
        sha = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(m), len(path), min(members[path[:-1]]) if path else None, len(m), len(children.get(path, [])), leaves[path], saved[path], sha))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)


@pytest.mark.parametrize("seed, convs, bits", [(1, 60, 3), (2, 150, 6)])
def test_against_plain_dictionaries(spark, seed, convs, bits):
    rng = random.Random(seed)
    rows = []
    for _ in range(convs):
        c = rng.choice([None, 0, 1, 2, 3, 7, 99, 100, 101, 105, *range(200, 260), 1000, 431])
        for turn in range(rng.choice([1, 2, 3, 9])):
            text = rng.choice([None, "", "a", "b", "é😀", "long " * 3000 if rng.random() < 0.05 else "c"])
            rows.append((c, rng.choice([turn, turn, None]), rng.choice(["user", "assistant", None]), text, 1, "x", "y"))
    rows += [(500 + i, t, "user", f"same {t}", 1, "", "") for i in range(40) for t in range(7)]
    rows += [(777, t, "user", f"hot {t}", 1, "", "") for t in range(300)]
    assert rows_of(convtrie.prefix_trie(spark.createDataFrame(rows, KIND), block_bits=bits)) == plain(rows)


def test_empty_and_nameless(spark):
    assert convtrie.prefix_trie(spark.createDataFrame([], KIND)).collect() == []
    assert convtrie.prefix_trie(spark.createDataFrame([(None, 1, "user", "a", 1, "", "")], KIND)).collect() == []


def test_sql(spark):
    d = "/root/testdata/sf0.001"
    assert spark_rows(convtrie.prefix_trie(spark.read.parquet(f"{d}/conversations.parquet"))) == duck_rows(connect(d), convtrie.TRIE_SQL)
