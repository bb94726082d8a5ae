import random

import numpy as np

from dossier.operators import retrieval


def test_every_query_row_gets_its_nearest(spark, monkeypatch):
    """More queries than a block has, ties, zero and null vectors, against brute force."""
    for name, value in (("VECTOR_NUMBERS", 60), ("QUERY_NUMBERS", 9), ("AT_ONCE", 2)):
        monkeypatch.setattr(retrieval, name, value)
    r = random.Random(2)
    vecs = {i: [float(r.randrange(-3, 4)) for _ in range(4)] for i in range(60)} | {60: [0.0] * 4, 61: None, 62: [1.0, 2.0]}
    df = spark.createDataFrame(list(vecs.items()), "vec_id long, embedding array<float>").repartition(3)

    def score(a, b):
        if a is None or b is None or len(a) != len(b) or not any(a) or not any(b):
            return None
        x, y = np.array(a), np.array(b)
        return float((x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())))

    got = {}
    for x in retrieval.nearest(df, df.where("vec_id % 7 = 0"), 5).collect():
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    assert set(got) == set(range(0, 63, 7))
    for q, found in got.items():
        ranked = sorted(((j, score(vecs[q], v)) for j, v in vecs.items()), key=lambda p: (p[1] is None, -(p[1] or 0), p[0]))
        assert sorted(found) == sorted((j, None if s is None else round(s, 6)) for j, s in ranked[:5]), q
    assert retrieval.nearest(df, df.limit(0), 5).count() == 0


def test_ranks_come_before_rounding_and_copies_tie(spark):
    """Cosines that differ beyond six digits rank by what they are; many copies of one vector rank by id."""
    rows = [(0, [1.0, 0.0])] + [(i, [1.0, (100 - i) * 1e-5]) for i in range(1, 20)] + [(100 + i, [3.0, 4.0]) for i in range(50)] + [(200, [6.0, 8.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = [x.vec_id for x in retrieval.nearest(df, df.where("vec_id = 0"), 4).collect()]
    assert sorted(got) == [0, 17, 18, 19]
    copies = retrieval.nearest(df, df.where("vec_id in (120, 200)"), 3)
    assert sorted((x.query_id, x.vec_id) for x in copies.collect()) == [(q, v) for q in (120, 200) for v in (100, 101, 102)]


def test_plan_is_the_same_for_any_number_of_queries(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_NUMBERS", 8)
    df = spark.range(400).selectExpr("id AS vec_id", "array(cast(id as double), 1D) AS embedding")
    plans = [retrieval.nearest(df, df.where(f"vec_id < {n}"), 2)._jdf.queryExecution().optimizedPlan().toString().count("\n") for n in (2, 300)]
    assert plans[0] == plans[1]
