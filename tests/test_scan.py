"""Positions, running values, neighbours and clamped folds against plain loops, over many small blocks."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from dossier.operators import layout, quality, timeline
from dossier.operators.scan import clamped, following, ordered, placed, positions, running, with_next
from dossier.streaming import operators as S


def test_running_values_and_positions(spark):
    r = random.Random(1)
    rows = [(r.choice("aab"), r.randrange(50), r.choice([None, *range(9)])) for _ in range(600)]
    df = spark.createDataFrame(rows, "g string, k int, v int")
    table = ordered(df, ["g"], ["k", "v"], block_bits=3)
    want = {}
    for g in "ab":
        own = sorted((x for x in rows if x[0] == g), key=lambda x: (x[1], x[2] is not None, x[2] or 0))
        total, most = 0, None
        for n, (_, k, v) in enumerate(own):
            total += v or 0
            most = v if most is None else max(most, v if v is not None else most)
            want[g, n] = (k, v, total, most, len(own))
    out = running(table, ["g"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))})
    got = {(x.g, x.place): (x.k, x.v, x.s, x.m, x.total) for x in positions(table, ["g"]).join(out.select("row_no", "s", "m"), "row_no").collect()}
    assert got == want
    back = {x.row_no: x.low for x in running(table, ["g"], {"low": ("min", F.col("k"))}, backwards=True).collect()}
    assert all(back[x.row_no] == x.k for x in table.collect())


@pytest.mark.parametrize("n", [0, 1, 7, 400])
def test_neighbours_of_a_whole_order(spark, n):
    keys = random.Random(n).sample(range(10_000), n)
    df = spark.createDataFrame([(k, -k) for k in keys], "k int, v int")
    got = {x.k: x.next_v for x in with_next(ordered(df, [], ["k"], block_bits=2), ["v"]).collect()}
    keys.sort()
    assert got == {a: (-b if b is not None else None) for a, b in zip(keys, [*keys[1:], None])}


def test_keyless_conflicts_have_no_single_task(spark):
    df = spark.createDataFrame([(i, (i * 37) % 101) for i in range(500)], "e int, t int")
    found = timeline.conflicts(df, [F.col("e")], "t", "e")
    assert sorted(map(tuple, found.collect())) == [(i, i + 1) for i in range(499) if (i * 37) % 101 > ((i + 1) * 37) % 101]
    assert "SinglePartition" not in found._jdf.queryExecution().toString()


def folded(steps, x):
    out = []
    for a, lo, hi in steps:
        after = min(hi, max(lo, a * x))
        out.append((x, after))
        x = after
    return out


@pytest.mark.parametrize("bits", [2, 8])
def test_clamped_steps_in_blocks(spark, bits):
    """Several levels of blocks of four against one loop; steps that forget what came before among them."""
    r = random.Random(3)
    steps = {g: [r.choice([(0.9, 0.0, 1.0), (1.3, 0.0, 1.0), (0.0, 0.7, 0.7), (0.5, 0.2, 0.6), (1.0, 0.0, 1.0), (0.0, 0.0, 0.0)]) for _ in range(n)] for g, n in (("long", 300), ("short", 3), ("one", 1))}
    rows = [(g, i, *s, f"{g}{i}") for g, v in steps.items() for i, s in enumerate(v)]
    r.shuffle(rows)
    got = clamped(spark.createDataFrame(rows, "g string, at int, a double, lo double, hi double, tag string"), ["g"], 0.8, ["tag"], bits).collect()
    assert len(got) == len(rows)
    for x in got:
        before, after = folded(steps[x.g], 0.8)[x.at]
        assert x.before == pytest.approx(before, abs=1e-12) and x.after == pytest.approx(after, abs=1e-12) and x.tag == f"{x.g}{x.at}"


def test_a_field_of_many_steps(spark):
    """200,000 steps of one field: the same as one loop at its end, and nothing is gathered whole."""
    n = 200_000
    df = spark.range(n).select(F.lit(1).alias("k"), F.lit("f").alias("field"), F.col("id").alias("ord"), F.when(F.col("id") % 1000 == 7, F.lit(0.9)).alias("override"), F.lit("synonym_resolution").alias("kind"))
    out = quality.confidence_steps(df, ["k", "field"], "ord", "kind", "override")
    last = out.orderBy(F.desc("ord")).first()
    factor = quality.CONFIDENCE_FACTORS.get("synonym_resolution", 1.0)
    x = 1.0
    for i in range(n):
        x = 0.9 if i % 1000 == 7 else min(1.0, max(0.0, x * factor))
    assert (last.ord, out.count()) == (n - 1, n) and last.after == pytest.approx(x, abs=1e-9)


def test_nearest_in_time(spark):
    r = random.Random(5)
    a = [(i, r.choice([None, *range(0, 4000, 50)])) for i in range(80)]
    b = [(1000 + i, r.choice([None, *range(0, 4000, 50)])) for i in range(60)] + [(5000 + i, 2000) for i in range(30)]
    table = lambda rows: spark.createDataFrame(rows, "id long, s long").select("id", F.timestamp_seconds("s").alias("ts"))
    got = {x.a_id: (x.n_near, x.before_id, x.after_id) for x in timeline.nearest_in_time(table(a), table(b), "ts", "id").collect()}
    points = sorted((s, i) for i, s in b if s is not None)
    want = {}
    for i, s in a:
        if s is not None:
            at = bisect.bisect_right(points, (s, 10**9))
            want[i] = (sum(abs(t - s) <= 300 for t, _ in points), points[at - 1][1] if at else None, points[at][1] if at < len(points) else None)
    assert got == want


@pytest.mark.parametrize("whole", [1024, 5])
def test_reading_order_of_long_pages(spark, whole):
    """Pages cut where bands surely start against one loop over the page."""
    r = random.Random(7)
    rows = [(p, i, r.randrange(900), r.randrange(0, 60 * n, r.choice([1, 7])), r.choice([4, 12, 30, 200])) for p, n in ((1, 400), (2, 3), (None, 60)) for i in range(n)]
    want = {}
    for p in (1, 2, None):
        band, top, out = -1, 0, []
        for y, x, seq, h in sorted((y, x, i, h) for q, i, x, y, h in rows if q == p):
            if band < 0 or not abs(y - top) < h * 0.5:
                band, top = band + 1, y
            out.append((band, x, y, seq))
        want |= {(p, seq): (n, band) for n, (band, _, _, seq) in enumerate(sorted(out))}
    df = spark.createDataFrame(rows, "page int, seq int, x int, y int, h int")
    got = {(x.page, x.seq): (x.reading_order, x.band) for x in layout.reading_order(df, "page", whole, 3).collect()}
    assert got == want


def test_lockouts_of_a_busy_user_in_stretches(spark):
    r = random.Random(11)
    rows, at = [], {1: 0, None: 0}
    for i in range(1500):
        u = r.choice([1, 1, 1, None])
        at[u] += r.choice([30, 200, 2500])
        rows.append((u, i, float(at[u]), r.random() < 0.35))
    want = {}
    for u in (1, None):
        state = (0, 0.0)
        for _, i, t, ok in sorted((x for x in rows if x[0] == u), key=lambda x: (x[2], x[1])):
            *state, said = S.after_login(*state, t, ok)
            want[u, i] = (said, state[0])
    df = spark.createDataFrame(rows, "u long, i long, at double, ok boolean").withColumn("ts", F.timestamp_micros((F.col("at") * 1e6).cast("long")))
    got = {(x.u, x.i): (x.outcome, x.attempts) for x in S.lockouts(df, "u", "ts", "i", "ok", 4).collect()}
    assert got == want and {v[0] for v in want.values()} == {"OK", "FAILED", "LOCKED", "LOCKED_NOW"}


@pytest.mark.parametrize("most", [0, 1 << 21])
def test_neighbours_and_places_of_keys_of_any_size(spark, most):
    """Windows and cut keys give the same rows: null keys are one key, ties go by the order's next column, other columns keep their names."""
    r = random.Random(3)
    rows = [(r.choice(["hot", "hot", "b", None]), r.randrange(40), i, i * 10) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, t int, row_no int, g int")
    nxt = {x.row_no: (x.next_t, x.next_g) for x in following(df, ["key"], [F.col("t"), F.col("row_no")], ["t", "g"], most).collect()}
    at = {x.row_no: x.place for x in placed(df, ["key"], [F.col("t"), F.col("row_no")], most=most).collect()}
    for k in ["hot", "b", None]:
        own = sorted((x for x in rows if x[0] == k), key=lambda x: (x[1], x[2]))
        for n, (a, b) in enumerate(zip(own, [*own[1:], (None,) * 4])):
            assert nxt[a[2]] == (b[1], b[3]) and at[a[2]] == n + 1
    assert following(df.limit(0), ["key"], [F.col("t")], ["t"], most).count() == placed(df.limit(0), ["key"], [F.col("t")], most=most).count() == 0


@pytest.mark.parametrize("most", [0, 1 << 21])
def test_gaps_conflicts_and_motion_of_cut_keys(spark, most):
    rows = [("a", "2024-01-01 00:00:00", 1, 5.0), ("a", "2024-01-01 03:00:00", 2, 90.0), ("a", None, 3, 91.0), ("b", "2024-01-01 09:00:00", 4, 0.0), ("b", "2024-01-01 08:00:00", 5, None), ("b", "2024-01-01 11:00:00", 6, 50.0)]
    df = spark.createDataFrame(rows, "k string, ts string, e int, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    gaps = timeline.gaps(df, "k", "ts", "e", 1.5, most).collect()
    assert sorted((x.k, str(x.gap_start), x.duration_hours) for x in gaps) == [("a", "2024-01-01 00:00:00", 3.0), ("b", "2024-01-01 09:00:00", 2.0)]
    late = timeline.conflicts(df, [F.col("e")], "ts", "e", "k", most).collect()
    assert [(x.k, x.event_1, x.event_2) for x in late] == [("b", 4, 5)]
    moved = layout.motion_frames(df, "k", "e", "v", 20, most).collect()
    assert sorted(tuple(x) for x in moved) == [("a", 3, 1), ("b", 3, 0)]
