"""Merkle manifest against a plain recursion, and against its SQL."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from dossier.llm import merkle

from ..oracle import connect, duck_rows, spark_rows

KIND = "doc_id long, text string, lang string, source string, n_chars long, leaf string, g int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    told = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)]
    return h(*told)


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def walk(tree, i):
    path = []
    for nodes in tree[:-1]:
        a = i // 8 * 8
        path.append((nodes[a:i], nodes[i + 1 : a + 8]))
        i //= 8
    return path


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r, leaf(r, r[1])))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[g] = levels([x[1] for x in groups[g]])
    top = levels([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, (r, own) in enumerate(groups[g]):
            path = walk(trees[g], i) + walk(top, k)
            now = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                now = leaf(r, None if r[1] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]))
            for a, b in path:
                now = h(*a, now, *b)
            out.append((r[0], own, trees[g][-1][0], top[-1][0], h(*[x for a, b in path for x in a + b]), now, now == top[-1][0]))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


@pytest.mark.parametrize("seed, n, bits", [(1, 700, 4), (3, 9, 1), (4, 1, 3), (6, 1300, 3)])
def test_against_plain_recursion(spark, seed, n, bits):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        text = rng.choice([None, "", "Abc É", "x" * rng.randrange(5), "Z" * 30_000 if rng.random() < 0.01 else "Q"])
        rows.append((rng.choice([None, *range(3 * n)]), text, rng.choice(["en"] * 6 + [None, "", "fr", "ü", "zz"]), rng.choice([None, "s"]), rng.choice([None, 3]), "own", 7))
    rows += rows[: n // 10]
    df = spark.createDataFrame(rows, KIND)
    assert rows_of(merkle.document_manifest(df, block_bits=bits)) == plain(rows)


def test_many_groups(spark):
    rows = [(i, "T", f"g{i // 2}", "s", 1, "", 0) for i in range(300)]
    assert rows_of(merkle.document_manifest(spark.createDataFrame(rows, KIND), block_bits=3)) == plain(rows)


def test_empty_table(spark):
    assert merkle.document_manifest(spark.createDataFrame([], KIND)).collect() == []


def test_proofs_are_siblings(spark):
    rows = [(i, "t", "en", "s", 1, "", 0) for i in range(20)]
    made = merkle.manifest(spark.createDataFrame(rows, KIND), ["doc_id", "text"])
    assert made.where(merkle.folded(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0
    third = made.where("doc_id = 3").first()
    assert (len(third.path[0].before), len(third.path[0].after)) == (3 * 64, 4 * 64)


def test_sql(spark):
    d = "/root/testdata/sf0.001"
    got = spark_rows(merkle.document_manifest(spark.read.parquet(f"{d}/documents.parquet")))
    assert got == duck_rows(connect(d), merkle.MERKLE_SQL)
