import random
import zlib

import numpy as np

from dossier.llm import langid, quality
from dossier.llm.grams import class_sample, distinct, draw, gram_codes

SYL = {"en": "the ing er on an st re th ou".split(), "de": "sch ung ein ich ver ge ber ü".split(), "fr": "eau tion oi ê re ment que é".split()}


def words(r, lang, n):
    return " ".join("".join(r.choice(SYL[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_codes_are_grams():
    assert len(distinct(gram_codes("abab"))) == 2 + 2 + 2 and not len(gram_codes(""))
    a, b = set(gram_codes("naïve🙂").tolist()), set(gram_codes("ve🙂").tolist())
    assert b <= a and len(gram_codes("x")) == 1


def test_kernel_is_presence_kernel():
    texts = ["the cat", "the hat", "zzz"]
    m = langid.KernelModel(texts, ["a", "a", "b"])
    grams = [{t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} for t in texts]
    k = m.kernel([distinct(gram_codes(t)) for t in texts])
    for i, x in enumerate(grams):
        for j, row in enumerate([0, 2, 1]):  # landmarks take turns by language
            y = grams[row]
            assert np.isclose(k[i, j], len(x & y) / np.sqrt(len(x) * len(y)), atol=1e-5)


def test_language_held_out_accuracy_and_edges(spark):
    r = random.Random(5)
    rows = [(i, words(r, g := r.choice(list(SYL)), r.randrange(3, 60)), g, "src", 1.0) for i in range(400)]
    rows += [(900, None, "en", "s", 1.0), (901, "123 ...", "en", "s", 1.0), (902, "", None, "s", 1.0), (903, words(r, "de", 30_000), "de", "s", 1.0), (None, "the thing", None, None, None), (5, rows[5][1], rows[5][2], "src", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")
    got = langid.predict_language(df).collect()
    assert len(got) == len(rows)
    truth = {x[0]: x[2] for x in rows}
    test = [x for x in got if x.held_out and x.doc_id < 900]
    assert test and np.mean([x.lang_pred == truth[x.doc_id] for x in test]) > 0.95
    by = {x.doc_id: x for x in got}
    assert [by[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "de"]
    assert all(x.held_out == (x.doc_id is not None and held(x.doc_id)) and 0 <= x.score <= 1 for x in got)
    assert langid.predict_language(df.limit(0)).count() == 0
    assert {x.lang_pred for x in langid.predict_language(df.withColumn("lang", df.lang.substr(9, 1)).where("lang is null")).collect()} == {"und"}


def test_quality_held_out_accuracy_and_edges(spark):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        good = i % 3 > 0
        t = words(r, r.choice(list(SYL)), r.randrange(20, 80))
        if not good:
            w = t.split()
            t = [" ".join(x + "***" for x in w), " ".join(w[0] + " " + w[0] for _ in w), " ".join(x.upper() + "!!" for x in w), " | ".join(w)][i % 4]
        rows.append((i, t, "x", 0.1))
        labels.append((i, int(good), None))
    rows += [(700, None, "x", 0.1), (701, "", "x", 0.1), (702, "the " * 60_000, "x", 0.1), (None, "the ing", None, None)]
    labels += [(700, None, 1), (None, 1, 1), (3, 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.train(docs, lab)
    got = quality.score_quality(docs, model, keep=["text", "lang", "score"]).collect()
    assert len(got) == len(rows) and got[0].lang == "x"
    test = [x for x in got if x.held_out and x.doc_id < 600]
    assert np.mean([x.predicted == (x.doc_id % 3 > 0) for x in test]) > 0.95
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in got)
    by = {x.doc_id: x for x in got}
    assert by[700].score == by[701].score and by[702].predicted == 0
    assert quality.score_quality(docs.limit(0), model).count() == 0
    assert {x.score for x in quality.score_quality(docs, quality.train(docs, lab.limit(0))).collect()} == {0.5}


def test_ridge_matches_plain_kernel_regression():
    """With every text a landmark, the scores are those of ridge regression in the kernel's own feature space, in plain loops."""
    r = random.Random(9)
    texts = [words(r, g, r.randrange(2, 12)) for g in SYL for _ in range(8)]
    langs = [g for g in SYL for _ in range(8)]
    model = langid.KernelModel(texts, langs, landmarks=len(texts), ridge=0.01)
    sets = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    k = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    known = [sets(t) for t in texts]
    gram = np.array([[k(a, b) for b in known] for a in known])
    target = np.array([[1.0 if x == g else -1.0 for g in sorted(SYL)] for x in langs])
    alpha = np.linalg.solve(gram + 0.01 * len(texts) * np.eye(len(texts)), target)
    new = [words(r, g, 5) for g in SYL for _ in range(4)]
    want = np.array([[k(sets(t), b) for b in known] for t in new]) @ alpha
    got, scores = model.predict(new)
    assert got == [sorted(SYL)[i] for i in want.argmax(1)]
    assert np.allclose(scores, np.clip((want.max(1) + 1) / 2, 0, 1), atol=0.01)


def test_every_language_has_a_landmark():
    langs = [f"l{i:03d}" for i in range(200)]
    texts = [f"{chr(0x4E00 + i)}{chr(0x5E00 + i)}{chr(0x6E00 + i)}" for i in range(200)]
    assert langid.KernelModel(texts, langs).predict(texts)[0] == langs


def test_support_vectors_match_a_plain_dual_solver():
    """Margins on a small table against the hinge-loss dual, solved by projected gradient on the whole kernel matrix."""
    r = random.Random(11)
    texts = [words(r, g, r.randrange(3, 9)) for g in ("en", "de") for _ in range(10)]
    labels = [1] * 10 + [0] * 10
    model = quality.SupportVectors(texts, labels, epochs=400)
    find = quality.Indicators()
    x = np.zeros((20, 1 << quality.BITS))
    for row, t in zip(x, texts):
        row[find(t)] = 1
    y = np.array(labels) * 2.0 - 1
    p, q = (1.0 + x[y == s].sum(0) for s in (1, -1))
    scaled = x * (np.log(p / p.sum()) - np.log(q / q.sum())) / np.sqrt(x.sum(1, keepdims=True))
    kernel = (scaled @ scaled.T + 1) * np.outer(y, y)
    dual = np.zeros(20)
    for _ in range(20_000):
        dual = np.clip(dual + 0.9 / np.linalg.norm(kernel, 2) * (1 - kernel @ dual), 0, 1)
    want = y * (kernel @ dual)
    assert np.allclose([model.margin(find(t)) for t in texts], want, atol=0.02)


def test_sample_is_bounded_by_rows_and_characters(spark):
    rows = [("same text", 1)] * 500 + [(f"text {i} " * 50, 0) for i in range(500)]
    df = spark.createDataFrame([(t, l, i) for i, (t, l) in enumerate(rows)], "t string, l int, i int").select("t", "l", draw("t").alias("draw"))
    got = class_sample(df, 100, 10_000)
    assert sum(l == 1 for _, l in got) <= 1 and 5 < sum(l == 0 for _, l in got) <= 40
    assert sum(len(t) for t, l in got if l == 0) <= 10_000
