import random

import numpy as np

import corpus_pipeline
from dossier.llm import shingles as S
from dossier.llm.simhash import near_duplicates


def plain_sets(texts, words=5):
    """The sets of word shingles as text."""
    out = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        out[i] = {b" ".join(w[k : k + words]) for k in range(len(w) - words + 1)} or ({b" ".join(w)} if w else set())
    return out


def plain_components(texts, words=5, share=0.8):
    """Components over all pairs by brute force; texts without words are alike."""
    sets = plain_sets(texts, words)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a == b or 5 * len(a & b) >= 5 * share * len(a | b):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def near_copies():
    """Texts of 60 to 400 words with copies that have words replaced, on both sides of 0.8."""
    r = random.Random(8)
    texts, word = {}, lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    for _ in range(40):
        base = [word() for _ in range(r.randrange(60, 400))]
        for edits in (0, 0, 1, 2, 4, 8):
            copy = list(base)
            for _ in range(edits):
                copy[r.randrange(len(copy))] = word()
            texts[len(texts) * 3 + 1] = " ".join(copy)
    return texts


def test_stage_matches_brute_force(spark):
    texts = near_copies() | {9000: None, 9001: "", 9002: " \t", 9003: "One two", 9004: "one  TWO", 9005: "one three"}
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in texts.items()], "doc_id long, text string, n_chars long")
    got = {x.doc_id for x in corpus_pipeline.simhash_dedup(spark, df, "").collect()}
    want = set(plain_components(texts).values())
    assert got == want and 40 < len(want) < 200


def test_large_bucket_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(S, "TILE_ROWS", 8)
    texts = near_copies()
    texts = {i: t for n, (i, t) in enumerate(texts.items()) if n < 60}
    base = texts[1].split()
    texts |= {1000 + k: " ".join([*base[:k], f"new{k}", *base[k:]]) for k in range(50)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {x.doc_id: x.component_id for x in near_duplicates(df, 5, 28, 0.8).collect()} == plain_components(texts)


def test_members_of_a_bucket_that_its_first_one_does_not_reach(monkeypatch):
    """Sets of one start do not meet again, those of others do, within and across tiles."""
    sets = [np.unique(np.arange(k, k + 40, dtype=np.uint64)) for k in (0, 20, 22, 23, 100)]
    fp = np.zeros(5, np.uint64)
    root = S.spanning_links(sets, fp, np.array([7, 9, 9, 11, 12]), np.zeros(5, np.int64), 0, False, 28, 0.8)
    assert root.tolist() == [0, 1, 1, 1, 4]
    root = S.spanning_links(sets, fp, np.arange(5), np.array([0, 0, 1, 1, 1]), 0, True, 28, 0.8)
    assert root.tolist() == [0, 1, 1, 1, 4]


def test_ids_of_other_types(spark):
    texts = near_copies()
    df = spark.createDataFrame([(f"d{i:05d}", t) for i, t in texts.items()], "doc_id string, text string")
    want = {f"d{i:05d}": f"d{c:05d}" for i, c in plain_components(texts).items()}
    assert {x.doc_id: x.component_id for x in near_duplicates(df, 5, 28, 0.8).collect()} == want


def test_two_texts_under_one_id(spark):
    one, two = "the first text has these words " * 3, "quite another thing stands here now " * 3
    rows = [(1, one, 0), (1, two, 0), (2, one, 0), (None, two, 0), (1, one, 0), (None, "a third text of some words here", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = sorted((x.doc_id or 0, x.text) for x in corpus_pipeline.simhash_dedup(spark, df, "").collect())
    assert got == sorted([(1, one), (1, two), (0, "a third text of some words here")])


def test_sets_and_long_texts(monkeypatch):
    r = random.Random(3)
    text = " ".join(str(r.randrange(10**6)) for _ in range(9000))
    found = S.shingles(text, 5)
    assert len(found) == len(plain_sets({1: text})[1])
    whole = S.bands(found)
    monkeypatch.setattr(S, "PART", 100)
    assert np.array_equal(S.bands(found), whole)
