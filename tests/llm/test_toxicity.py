"""Toxicity: gradients against differences, stretches against loops, held-out accuracy, misspellings, odd input."""

import math
import zlib

import numpy as np
import pytest

from dossier.llm import toxicity as T

DIR = "/root/testdata/sf0.01"


def plain_score(model, text):
    """The score by loops, from the rule's text."""
    words = []
    for w in T._WORD.findall(text.lower()):
        if not words or words[-1] != w:
            words.append(w)
    x = model.lean
    if words:
        own = []
        for w in words:
            marked = f"<{w}>"
            grams = [marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)] + [marked + "="]
            at = [zlib.crc32(g.encode()) >> (32 - T.BITS) for g in grams]
            own.append([sum(float(model.scores[a][k]) for a in at) / len(at) for k in (0, 1)])
        n = min(T.STRETCH, len(words))
        x += sum(a for a, _ in own) / len(own) + max(sum(b for _, b in own[i : i + n]) / n for i in range(len(own) - n + 1))
    return 1 / (1 + math.exp(-x))


@pytest.fixture(scope="module")
def made():
    bad = ["you total idiot", "what a moron", "pathetic loser here", "worthless trash", "stupid clown"]
    good = ["the sun is warm", "a quiet little river", "bread and butter", "the train is late today", "two cups of tea"]
    texts = [f"{g} {b} {h}" for b in bad for g in good for h in good] + [f"{a} {b} {c}" for a in good for b in good for c in good]
    return T.SubwordBags(texts, [1] * 125 + [0] * 125)


def test_scores_by_loops(made):
    for text in ["", "...", "idiot", "the sun is an idiot " * 9, "Tea tea TEA", "a b c d e f g h i j k l m n o p idiot"]:
        assert made.score(text, made.word_scores) == pytest.approx(plain_score(made, text), abs=1e-6)


def test_misspellings_share_vectors(made):
    for text in ["what an idiott", "such morons", "patheticc", "you stupidd clowns"]:
        assert made.score(text, made.word_scores) >= 0.5, text
    assert made.score("a warm quiet train", made.word_scores) < 0.5


def test_step_follows_the_gradient():
    """One step with a tiny rate lowers the loss, as its slopes say."""
    rng = np.random.default_rng(1)
    model = T.SubwordBags([], [])
    model.vectors, model.softmax, model.bias = rng.normal(0, 0.3, (1 << T.BITS, T.DIMS)).astype(np.float32), rng.normal(0, 1, (2, 2 * T.DIMS)), np.zeros(2)
    words = ["idiot", "train", "moron", "bread"]
    found = [T.grams_of(w) for w in words]
    sizes = np.array([len(f) for f in found])
    starts, flat = np.concatenate([[0], np.cumsum(sizes)]), np.array([g for f in found for g in f])
    bags = [np.array([0, 1]), np.array([1, 3, 2]), np.array([0]), np.array([2])]
    y = np.array([1, 0])

    def loss():
        mean = [np.mean([model.vectors[f].mean(0) for f in (found[w] for w in b)], axis=0) for b in bags]
        z = np.stack([np.concatenate([mean[i], mean[i + 2]]) for i in range(2)]) @ model.softmax.T + model.bias
        return float(np.mean(np.log(np.exp(z).sum(1)) - z[[0, 1], y]))

    before = loss()
    model._step(bags, y, np.ones(2), starts, sizes, flat, np.full(1 << T.BITS, 1e-6), [np.full((2, 2 * T.DIMS), 1e-6), np.full(2, 1e-6)], 1e-3)
    assert loss() < before


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    found = {r.doc_id: r for r in T.score_toxicity(docs, T.learn_toxicity(docs, labels)).collect()}
    assert len(found) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for i, r in found.items())
    told = [(found[r.doc_id], r.toxic) for r in labels.collect() if r.doc_id in found]
    held = [(r.predicted == t) for r, t in told if r.held_out]
    assert sum(held) / len(held) > 0.85


def test_odd_rows(spark):
    kind = "doc_id long, text string, held_out int, score string"
    rows = [(1, None, 1, "x"), (None, "", 2, "y"), (2, "w" * 300_000, 3, ""), (2, "idiot " * 50_000, 3, ""), (2, "idiot " * 50_000, 3, "")]
    docs = spark.createDataFrame(rows, kind)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (None, 1), (9, 1)], "doc_id long, toxic int")
    got = T.score_toxicity(docs, T.learn_toxicity(docs, labels, passes=2)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    none = labels.limit(0)
    assert {r.score for r in T.score_toxicity(docs, T.learn_toxicity(docs, none)).collect()} == {0.5}
    assert T.score_toxicity(docs.limit(0), T.learn_toxicity(docs.limit(0), labels)).collect() == []
    one = T.learn_toxicity(docs, labels.where("toxic = 0"))
    assert all(r.predicted == 0 for r in T.score_toxicity(docs, one).collect())
