"""Streaming forms: pending work, retention, rate limits, sessions, lockout. The column logic also runs in batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..storage import materialize, ship_package

MOST_ATTEMPTS, LOCK_MINUTES = 5, 30


def poll(source: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, seconds: int = 10, once: bool = False) -> StreamingQuery:
    """Hand every micro-batch of a stream to ``work`` (idempotent by its batch number); a restart goes on from the checkpoint."""
    writer = source.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def evidence_stream(spark: SparkSession, path: str, schema, per_trigger: int = 5) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def release_times(jobs: DataFrame, queue: list[str], at: str, job: str, seconds: int = 2) -> DataFrame:
    """``jobs`` with released_at: first come, first served, one job every ``seconds`` for each queue (all jobs form one without a key).

    Job n (from 0, by time and then id) leaves at max(its time, seconds after the one before it), which is
    n * seconds + the running maximum of (time of job k - k * seconds): a running value, so a queue of any
    length is cut into blocks. Queue keys must not be null.
    """
    from ..operators.scan import ordered, positions, running

    rows = ordered(jobs, queue, [at, job])
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    placed = positions(rows.withColumn("all", F.lit(0)), [*queue, "all"])
    lead = running(placed, queue, {"lead": ("max", micros - F.col("place") * (seconds * 1_000_000))})
    return lead.withColumn("released_at", F.timestamp_micros(F.col("lead") + F.col("place") * (seconds * 1_000_000))).select(*jobs.columns, "released_at")


class AnalysisQueue(StatefulProcessor):
    """A first-in, first-out queue as stream state by queue name; rows: queue, at (timestamp), job, type, payload.

    A job's release slot is its time, or ``seconds`` after the slot before it. A timer for each slot lets one job
    out and through the handler of its type. A type without a handler and a handler that fails make a row
    of status DEAD_LETTER with the reason: no job is lost, and none is released twice. Jobs of one batch join
    the queue by time and id.
    """

    def __init__(self, handlers: dict[str, Callable[[str], str]], seconds: int = 2):
        self.handlers, self.step = handlers, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "slot bigint, job bigint, type string, payload string")
        self.last = handle.getValueState("last", "slot bigint")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N803, ANN001, ANN201
        came = sorted((int(t.value // 1000), int(j), k, p) for b in rows for t, j, k, p in zip(b["at"], b["job"], b["type"], b["payload"]))
        last = self.last.get()[0] if self.last.exists() else None
        joined = []
        for at, job, kind, payload in came:
            last = at if last is None else max(at, last + self.step)
            joined.append((last, job, kind, payload))
            self.handle.registerTimer(last // 1000 + 1)
        self.waiting.appendList(joined)
        self.last.update((last,))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N803, ANN001, ANN201
        until, out, rest = expiredTimerInfo.getExpiryTimeInMs() * 1000, [], []
        for slot, job, kind, payload in self.waiting.get():
            if slot >= until:
                rest.append((slot, job, kind, payload))
                continue
            status, detail = "DEAD_LETTER", f"no handler for {kind}"
            if kind in self.handlers:
                try:
                    status, detail = "DONE", self.handlers[kind](payload)
                except Exception as e:  # any failing job: the error is the row
                    detail = f"{type(e).__name__}: {e}"
            out.append((key[0], job, kind, pd.Timestamp(slot, unit="us"), status, detail))
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        yield pd.DataFrame(out, columns=["queue", "job", "type", "released_at", "status", "detail"])

    def close(self) -> None:
        pass


def analysis_stream(jobs: DataFrame, handlers: dict[str, Callable[[str], str]], seconds: int = 2, late: str = "1 minute") -> DataFrame:
    """(queue, job, type, released_at, status, detail) of a stream of jobs, each once its slot is behind the watermark."""
    seen = jobs.select("queue", "at", "job", "type", "payload").withWatermark("at", late)
    return seen.groupBy("queue").transformWithStateInPandas(AnalysisQueue(handlers, seconds), "queue string, job bigint, type string, released_at timestamp, status string, detail string", "append", "eventTime")


def routed(jobs: DataFrame, handlers: dict[str, Callable[[DataFrame], DataFrame]], kind: str = "type") -> tuple[DataFrame, DataFrame]:
    """Each job type through its own handler; and the jobs of other types (null too), which no handler takes."""
    parts = [f(jobs.where(F.col(kind) == name)) for name, f in handlers.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, jobs.where(~F.coalesce(F.col(kind).isin(*handlers), F.lit(False)))


def rate_limits(requests: DataFrame, client: str, ts: str, most: int, minutes: int = 15, late: str = "1 hour") -> DataFrame:
    """(client, start, n) of fixed windows with more than ``most`` requests; late rows beyond the watermark are dropped."""
    seen = requests.withWatermark(ts, late) if requests.isStreaming else requests
    counts = seen.groupBy(client, F.window(ts, f"{minutes} minutes")).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > most).select(client, F.col("window.start").alias("start"), "n")


def expired(df: DataFrame, since: str, now: Column, days: int = 7) -> DataFrame:
    return df.where(F.col(since) + F.make_interval(days=F.lit(days)) < now)


def session_progress(files: DataFrame, session: str, status: str, total: str) -> DataFrame:
    """Counters of upload sessions; complete once completed and failed (duplicates included) reach the total."""
    done, failed = F.count_if(F.col(status) == "COMPLETED"), F.count_if(F.col(status).isin("FAILED", "DUPLICATE"))
    return files.groupBy(session).agg(done.alias("completed"), failed.alias("failed"), (done + failed >= F.max(total)).alias("is_complete"))


def after_login(attempts: int, locked_until: float, now: float, success: bool) -> tuple[int, float, str]:
    """One step of the lockout: (attempts, locked until, outcome), times in seconds."""
    if now < locked_until:
        return attempts, locked_until, "LOCKED"
    if success:
        return 0, 0.0, "OK"
    attempts += 1
    if attempts >= MOST_ATTEMPTS:
        return attempts, now + LOCK_MINUTES * 60, "LOCKED_NOW"
    return attempts, 0.0, "FAILED"


def lockouts(logins: DataFrame, user: str, ts: str, tie: str, success: str, block_bits: int = 14) -> DataFrame:
    """(user, tie, outcome, attempts) of every login, in order.

    A success without a failure in the LOCK_MINUTES before it can't be locked out, so it resets the user
    whatever came before. Users are cut behind such logins (running values over range-sorted blocks find them),
    and each stretch streams through a task of its own from a fresh state: a user with very many logins is
    not one task's work. A user that only fails is one stretch. Null users are one user.
    """
    from ..operators.scan import ordered, running, running_sums

    ship_package(logins.sparkSession)
    kind = logins.schema[user].dataType.simpleString(), logins.schema[tie].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, attempts, until = None, 0, 0.0
        for b in batches:
            out = []
            for g, part, u, t, at, ok in zip(b["g"], b["part"], b["u"], b["t"], b["at"], b["ok"]):
                if (g, part) != who:
                    who, attempts, until = (g, part), 0, 0.0
                attempts, until, said = after_login(attempts, until, at, ok)
                out.append((u, t, said, attempts))
            yield pd.DataFrame(out, columns=[user, tie, "outcome", "attempts"])

    g = F.coalesce(F.concat(F.lit("="), F.col(user).cast("string")), F.lit(""))
    rows = logins.select(g.alias("g"), F.col(user).alias("u"), F.col(tie).alias("t"), (F.unix_micros(ts) / 1e6).alias("at"), F.coalesce(success, F.lit(False)).alias("ok"))
    seen = running(ordered(rows, ["g"], ["at", "t"], block_bits), ["g"], {"failed": ("max", F.when(~F.col("ok"), F.col("at")))})
    reset = F.col("ok") & (F.col("failed").isNull() | (F.col("at") >= F.col("failed") + LOCK_MINUTES * 60))
    flagged = materialize(seen.withColumn("reset", reset.cast("long")), "resets")
    parts = running_sums(flagged, ["g"], {"resets": F.col("reset")}).withColumn("part", F.col("resets") - F.col("reset"))
    stretches = parts.select("g", "part", "u", "t", "at", "ok").repartition("g", "part").sortWithinPartitions("g", "part", "at", "t")
    return stretches.mapInPandas(run, f"`{user}` {kind[0]}, `{tie}` {kind[1]}, outcome string, attempts int")


class Lockout(StatefulProcessor):
    """The lockout as stream state by user; rows: user, ts, event, ok.

    Logins wait in list state until the watermark has passed them and are then taken in order of time and
    event, so batches may come in any order within the watermark's delay. A user's state is forgotten after
    ``idle_days`` without a login; a later login starts from no attempts.
    """

    def __init__(self, idle_days: float = 30.0):
        self.idle = int(idle_days * 86_400_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("lock", "attempts int, until double, last bigint")
        self.waiting = handle.getListState("waiting", "at bigint, event bigint, ok boolean")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N803, ANN001, ANN201
        came = [(int(t.value // 1000), int(e), bool(ok)) for b in rows for t, e, ok in zip(b["ts"], b["event"], b["ok"])]
        self.waiting.appendList(came)
        self.handle.registerTimer(max(came)[0] // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N803, ANN001, ANN201
        until, due, rest, out = expiredTimerInfo.getExpiryTimeInMs() * 1000, [], [], []
        for row in self.waiting.get() if self.waiting.exists() else ():
            (due if row[0] < until else rest).append(tuple(row))
        attempts, locked, last = self.state.get() if self.state.exists() else (0, 0.0, None)
        for at, event, ok in sorted(due):
            if last is not None and at - last > self.idle:
                attempts, locked = 0, 0.0
            attempts, locked, said = after_login(attempts, locked, at / 1e6, ok)
            last = at
            out.append((key[0], event, said, attempts))
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        if due:
            self.state.update((attempts, locked, last))
            self.handle.registerTimer((last + self.idle) // 1000 + 1)
        elif not rest and last is not None and until > last + self.idle:
            self.state.clear()
        yield pd.DataFrame(out, columns=["user", "event", "outcome", "attempts"])

    def close(self) -> None:
        pass


def lockout_stream(logins: DataFrame, late: str = "1 hour", idle_days: float = 30.0) -> DataFrame:
    """(user, event, outcome, attempts) of a stream of logins (user, ts, event, ok), once they are behind the watermark."""
    seen = logins.select("user", "ts", "event", "ok").withWatermark("ts", late)
    return seen.groupBy("user").transformWithStateInPandas(Lockout(idle_days), "user bigint, event bigint, outcome string, attempts int", "append", "eventTime")


class Progress(StreamingQueryListener):
    """Calls a function with (query id, batch, rows) after each batch."""

    def __init__(self, say: Callable[[str, int, int], None]):
        self.say = say

    def onQueryStarted(self, event) -> None:  # noqa: N802, ANN001
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802, ANN001
        p = event.progress
        self.say(str(p.id), p.batchId, p.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: N802, ANN001
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802, ANN001
        pass
