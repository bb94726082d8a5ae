import random
import re

import numpy as np
import xxhash

from dossier.llm import simhash
from dossier.llm.graph import components, unite
from dossier.llm.simhash import block_masks, fingerprint, near_duplicates


def plain_fingerprint(text, words=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = re.findall("[^\x20\x09-\x0d]+", text)
    if not w:
        return 0
    sh = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps):
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprint_matches_plain():
    r = random.Random(0)
    for t in ["", " \t ", "One", "one TWO", "É ß\x0bx\x1cy z q", *(" ".join(r.choice(["a", "B", "ce", "Ü"]) for _ in range(r.randrange(60))) for _ in range(60))]:
        assert fingerprint(t) == plain_fingerprint(t), t


def test_masks_cover_all_pairs():
    r = random.Random(1)
    for rows in (10, 1 << 30, 1 << 40):
        masks = block_masks(3, rows)
        for _ in range(300):
            diff = sum(1 << b for b in r.sample(range(64), 3))
            assert any(not diff & m for m in masks)


def test_unite():
    root = np.arange(8)
    unite(root, np.array([7, 5, 3]), np.array([5, 3, 1]))
    assert root.tolist() == [0, 1, 2, 1, 4, 1, 6, 1]


def test_components_of_chain_star_and_pairs(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(1000, i) for i in range(1001, 1200)]
    df = spark.createDataFrame([*chain, *star, (7, 5), (5, 7), (9, 9)], "a long, b long")
    got = dict(map(tuple, components(df).collect()))
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 1000 for i in range(1000, 1200))
    assert got[7] == got[5] == 5 and 9 not in got
    assert components(df.limit(0)).count() == 0


def test_matches_brute_force_with_split_buckets(spark, monkeypatch):
    """Fingerprints planted near a few centres, in buckets far above the tile size."""
    monkeypatch.setattr(simhash, "TILE_ROWS", 16)
    r = random.Random(4)
    fps = {}
    for c in range(4):
        centre = r.getrandbits(64)
        for _ in range(90):
            x = centre
            for b in r.sample(range(64), r.randrange(7)):
                x ^= 1 << b
            fps[len(fps) * 3 + 1] = x
    monkeypatch.setattr(simhash, "fingerprints", lambda df, *a: df)
    df = spark.createDataFrame([(i, simhash.signed(x)) for i, x in fps.items()], "doc_id long, fp long")
    got = {x.doc_id: (int(x.fingerprint, 16), x.component_id) for x in near_duplicates(df).collect()}
    want = plain_components(fps)
    assert got == {i: (fps[i], want[i]) for i in fps}


def test_texts_nulls_ties_repeats_and_clashing_columns(spark):
    rows = [(5, None), (3, ""), (8, "The quick brown fox jumps"), (8, "The quick brown fox jumps"), (6, "the QUICK brown\tfox  jumps"), (1, "zz " * 50_000), (None, "the quick brown fox jumps")]
    df = spark.createDataFrame([(*x, "fp", 1) for x in rows], "doc_id long, text string, fp string, rep int")
    got = sorted((x.doc_id or 0, x.fingerprint, x.component_id) for x in near_duplicates(df).collect())
    quick = f"{plain_fingerprint('the quick brown fox jumps'):016x}"
    assert got == sorted([(5, "0" * 16, 3), (3, "0" * 16, 3), (8, quick, 6), (8, quick, 6), (6, quick, 6), (1, f"{plain_fingerprint('zz zz zz'):016x}", 1), (0, quick, None)])
    assert near_duplicates(df.limit(0)).count() == 0


def test_ids_of_any_type(spark):
    rows = [("b", "one two three four"), ("a", "one two three four"), (None, "one two three four"), ("c", "")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert sorted((x.doc_id or "", x.component_id or "") for x in near_duplicates(df).collect()) == [("", ""), ("a", "a"), ("b", "a"), ("c", "c")]
