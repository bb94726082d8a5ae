"""Timelines: order, conflicts, gaps, matching of sources, recommended actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .scan import RANGE_ROWS, following, running, with_next
from .scan import ordered as ordered_rows


def ordered(df: DataFrame, at: Column, tie: str) -> DataFrame:
    """A total order by time, equal times by ``tie``."""
    return df.orderBy(at.asc(), F.col(tie).asc())


def conflicts(df: DataFrame, by: list[Column], ts: str, event: str, key: str | None = None, most: int = RANGE_ROWS) -> DataFrame:
    """Neighbours in input order of which the first is later than the second. ``key`` splits independent timelines;
    without it all rows form one, which is range-sorted and compared block by block, never in one task. ``by`` is a
    complete order; a key of more than ``most`` rows is cut as well."""
    if key is None:
        names = {f"by{i}": c for i, c in enumerate(by)}
        rows = ordered_rows(df.select(F.col(event).alias("event_1"), F.col(ts).alias("at"), *[c.alias(n) for n, c in names.items()]), [], list(names))
        return with_next(rows, ["event_1", "at"]).where("at > next_at").select("event_1", F.col("next_event_1").alias("event_2"))
    after = following(df, [key], by, [event, ts], most)
    late = after.where(F.col(ts) > F.col(f"next_{ts}")).withColumnRenamed(f"next_{event}", "event_2")
    return late.drop(f"next_{ts}").withColumnRenamed(event, "event_1")


def inconsistencies_after_sorting(df: DataFrame, ts: str, event: str, key: str) -> DataFrame:
    """Conflicts of a sorted timeline: there are none, kept for completeness; conflicts() is the useful one."""
    return conflicts(df, [F.col(ts), F.col(event)], ts, event, key)


def gaps(df: DataFrame, key: str, ts: str, tie: str, hours: float = 2.0, most: int = RANGE_ROWS) -> DataFrame:
    """(key, gap_start, gap_end, duration_hours) of neighbours more than ``hours`` apart; a key of more than ``most`` rows is cut."""
    after = following(df.select(*dict.fromkeys([key, ts, tie])), [key], [F.col(ts), F.col(tie)], [ts], most)
    out = after.select(key, F.col(ts).alias("gap_start"), F.col(f"next_{ts}").alias("gap_end"))
    span = (F.unix_micros(F.col("gap_end").cast("timestamp")) - F.unix_micros(F.col("gap_start").cast("timestamp"))) / 3.6e9
    return out.withColumn("duration_hours", F.round(span, 4)).where(F.col("duration_hours") > hours)


def source_match(times: list[Column], seconds: int = 300) -> tuple[Column, Column]:
    """(matched, spread in seconds) of several sources' times; nulls do not count, and without any time both are null."""
    spread = F.unix_micros(F.greatest(*times)) / 1e6 - F.unix_micros(F.least(*times)) / 1e6
    return spread <= seconds, spread


def nearest_in_time(a: DataFrame, b: DataFrame, ts: str, id_col: str, seconds: int = 300) -> DataFrame:
    """For each row of ``a``: a_id, n_near (rows of ``b`` at most ``seconds`` away), before_id (the last of ``b`` up to its
    time, of equals the largest id) and after_id (the first later one, of equals the smallest id), however far.

    No pairs are made. Rows of ``b``, of ``a``, and two probes at the ends of each window go into one ordering;
    running counts at the probes give the number between them, a running maximum and minimum give the
    neighbours. Times of any density cost the same. Null times are left out.
    """
    span = F.make_interval(secs=F.lit(seconds))
    at = F.col(ts).cast("timestamp")
    none = F.lit(None).cast(b.schema[id_col].dataType)
    points = F.array(*[F.struct(t.alias("at"), F.lit(side).alias("side")) for t, side in ((at - span, 0), (at, 2), (at + span, 3))])
    mine = a.where(at.isNotNull()).select(F.inline(points), F.col(id_col).alias("a_id"), none.alias("b_id"))
    theirs = b.where(at.isNotNull()).select(at.alias("at"), F.lit(1).alias("side"), F.lit(None).cast(a.schema[id_col].dataType).alias("a_id"), F.col(id_col).alias("b_id"))
    rows = ordered_rows(materialize(mine.union(theirs), "points"), [], ["at", "side", "b_id"])
    here = F.when(F.col("side") == 1, F.struct("at", "b_id"))
    seen = running(rows, [], {"n": ("sum", F.when(F.col("side") == 1, 1).otherwise(0)), "last": ("max", here)})
    coming = running(rows.select("row_no", "block_no", here.alias("here")), [], {"first": ("min", F.col("here"))}, backwards=True)
    found = seen.where("side <> 1").join(coming.select("row_no", "first"), "row_no")
    of = lambda c, side: F.max(F.when(F.col("side") == side, c))
    return found.groupBy("a_id").agg((of(F.col("n"), 3) - of(F.col("n"), 0)).alias("n_near"), of(F.col("last.b_id"), 2).alias("before_id"), of(F.col("first.b_id"), 2).alias("after_id"))


def matching_pairs(a: DataFrame, b: DataFrame, ts: str, id_col: str, seconds: int = 300) -> DataFrame:
    """(a_id, b_id) at most ``seconds`` apart: rows meet in time buckets, those of ``b`` also in the two next to theirs, so it is an equality join."""
    at = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / seconds)
    left = a.select(F.col(id_col).alias("a_id"), F.col(ts).alias("a_ts"), at(ts).alias("slot"))
    near = F.explode(F.array(at(ts) - 1, at(ts), at(ts) + 1)).alias("slot")
    right = b.select(F.col(id_col).alias("b_id"), F.col(ts).alias("b_ts"), near)
    apart = F.abs(F.unix_micros(F.col("a_ts").cast("timestamp")) - F.unix_micros(F.col("b_ts").cast("timestamp")))
    return left.join(right, "slot").where(apart <= seconds * 1_000_000).select("a_id", "b_id")


PRIORITY = {"HIGH": 3, "MEDIUM": 2, "LOW": 1}


def recommendations(gap_rows: DataFrame, hypotheses: DataFrame, key: str) -> DataFrame:
    """(key, rank, action, priority, target): gaps first, then missing evidence, each target once by first mention, HIGH before MEDIUM.

    ``gap_rows``: key, seq, duration_hours. ``hypotheses``: key, seq, score, missing (array).
    """
    from_gaps = gap_rows.where("duration_hours > 2").select(key, F.lit(0).alias("part"), F.col("seq").alias("o1"), F.lit(0).alias("o2"), F.lit("Acquire CCTV").alias("action"), F.lit("HIGH").alias("priority"), F.lit("Surrounding area of crime scene").alias("target"))
    items = hypotheses.select(key, F.lit(1).alias("part"), F.col("seq").alias("o1"), "score", F.posexplode("missing").alias("o2", "target"))
    first = F.row_number().over(Window.partitionBy(key, "target").orderBy("o1", "o2"))
    items = items.withColumn("n", first).where("n = 1")
    items = items.select(key, "part", "o1", "o2", F.lit("Acquire Evidence").alias("action"), F.when(F.col("score") > 0.6, "HIGH").otherwise("MEDIUM").alias("priority"), "target")
    both = from_gaps.union(items)
    weight = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[F.col("priority")]
    rank = F.row_number().over(Window.partitionBy(key).orderBy(weight.desc(), "part", "o1", "o2"))
    return both.select(key, rank.alias("rank"), "action", "priority", "target")


def strategy(gap_rows: DataFrame, hypotheses: DataFrame, key: str) -> DataFrame:
    """(key, primary_hypothesis, highest_confidence, critical_gaps, actions, investigation_status)."""
    best = hypotheses.groupBy(key).agg(F.max_by("kind", F.struct(F.when(F.col("score") > 0, F.col("score")), -F.col("seq"))).alias("kind"), F.greatest(F.lit(0.0), F.max("score")).alias("highest_confidence"))
    critical = gap_rows.groupBy(key).agg(F.count_if(F.col("duration_hours") > 2).alias("critical_gaps"))
    acts = recommendations(gap_rows, hypotheses, key).groupBy(key).agg(F.count("*").alias("actions"))
    out = best.join(critical, key, "full").join(acts, key, "left").fillna(0, ["critical_gaps", "actions", "highest_confidence"])
    name = F.when(F.col("highest_confidence") > 0, F.col("kind")).otherwise("Inconclusive")
    status = F.when(F.col("actions") > 0, "Active - Requires Lead Follow-up").otherwise("Analysis Complete")
    return out.select(key, name.alias("primary_hypothesis"), "highest_confidence", "critical_gaps", "actions", status.alias("investigation_status"))
