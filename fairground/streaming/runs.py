"""Stateful operators as Structured Streaming queries over files that arrive in a folder.

Each function takes a streaming frame and gives one; ``drain`` runs it over what is there,
with its checkpoint and results in the shared folder, and returns the result as a table.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.shared import shared_dir


def source(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A stream of the Parquet files of ``path`` (a file or a folder), event time ``ts`` as an instant.

    The path is given as a pattern, as a single file is accepted only so.
    """
    rows = spark.readStream.schema(like.schema).parquet(f"{path[:-1]}[{path[-1]}]")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Runs ``stream`` until its input is used up; returns what it gave.

    In complete and update mode each batch's rows are stored with the batch's number; the last
    word on a key is the row with the largest.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        run = writer.format("parquet").option("path", f"{base}/rows").start()
    else:
        # The batch's number makes a batch that is written again replace itself.
        run = writer.foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{base}/rows/n={n}")).start()
    run.awaitTermination()
    rows = spark.read.schema(stream.schema if mode == "append" else stream.schema.add("batch", "long")).option("recursiveFileLookup", mode != "append").parquet(f"{base}/rows")
    return rows


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last row of each key from a drained complete or update stream."""
    others = [c for c in rows.columns if c not in keys and c != "batch"]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("v"))
    return best.select(*keys, "v.*")


def last_batch(rows: DataFrame) -> DataFrame:
    """The whole result of a drained complete stream, for keys that may change between batches."""
    return rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch", "left_semi").drop("batch")


def signed_counter(events: DataFrame, key: str) -> DataFrame:
    """Running sum of +1 and -1 for each key, never told as less than 0."""
    delta = F.when(F.col("event_type").isin("signup", "purchase"), 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return events.groupBy(key).agg(F.sum(delta).alias("net"), F.greatest(F.lit(0), F.sum(delta)).alias("counter"))


def distinct_deliveries(events: DataFrame, delay: str = "2 days") -> DataFrame:
    """The first delivery of a user, kind and day; keys are forgotten after ``delay``."""
    return events.withColumn("day", F.to_date("ts").cast("string")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["user_id", "event_type", "day"])


def sliding_errors(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "90 minutes", "15 minutes").alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors")).select(F.col("w.start").alias("window_start"), "n", "errors")


def user_sessions(events: DataFrame, gap: str = "30 minutes", delay: str | None = "1 hour") -> DataFrame:
    """Sessions with their number of events; without ``delay`` there is no watermark, for complete mode, which tells those still open, too."""
    return (events.withWatermark("ts", delay) if delay else events).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


FAILURES, GAP_S, OPEN_S = 3, 15 * 60, 2 * 3600
NEVER = 2**63 - 1  # a time that no watermark passes
FRESH = (0, -1.0, -1.0, 0)


def breaker_step(state: tuple[int, float, float, int], at: float, failed: bool) -> tuple[tuple[int, float, float, int], str]:
    """One event of a circuit breaker: (failures in a row, last failure, open until, times opened).

    Three failures with gaps of 15 minutes or less open it for two hours. A failure once that
    time is over opens it again; only a success after it closes it.
    """
    count, last, until, opened = state
    if failed:
        count = count + 1 if last >= 0 and at - last <= GAP_S else 1
        half_open = 0 <= until <= at
        if count >= FAILURES or half_open:
            opened += int(until < 0 or until <= at)
            until = max(until, at + OPEN_S)
        last = at
    elif until < 0 or until <= at:
        count, until = 0, -1.0
    return (count, last, until, opened), "open" if until > at else "half_open" if until >= 0 else "closed"


BREAKER_SCHEMA = "user_id long, event_id long, state string, opened int"


class Alarms:
    """The times at which a key wants to be woken, in memory while its events are taken."""

    def __init__(self) -> None:
        self.times: list[int] = []

    def registerTimer(self, at: int) -> None:
        if at not in self.times:
            self.times.append(at)

    def next(self, limit: int) -> int | None:
        """Takes out the earliest time up to ``limit``."""
        at = min(self.times, default=None)
        if at is None or at > limit:
            return None
        self.times.remove(at)
        return at


class InOrder(StatefulProcessor):
    """Takes a key's events (``us``, ``id``, ``kind``, ``amount``) in order of time and id, also if they come late.

    They wait until the watermark has passed them. A key has one timer, for the first of its events and alarms; when it comes,
    all that the watermark has passed is taken in one go, so that a key costs a few calls to the state, however many events it has.
    Subclasses say what an event does (``event``), and what a time does that has none (``alarm``); both get
    the key's numbers and return (numbers or None to forget them, rows). An event sets its key's alarms anew by ``handle``; one
    at a time that has an event doesn't ring, so an event first tells what has run out before it.
    """

    numbers: str  #: the numbers that a key has, as a schema
    rows: str  #: what comes out, after the key, as names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.store, self.handle = handle, Alarms()
        self.kept = handle.getValueState("kept", f"timer long, alarms array<long>, numbers struct<{self.numbers}>")
        self.waiting = handle.getListState("waiting", "us long, id long, kind string, amount double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            events = list(zip(frame.us.tolist(), frame.id.tolist(), frame.kind.tolist(), frame.amount.tolist()))
            self.waiting.appendList(events)
            earliest = min(e[0] for e in events) // 1000
            first = earliest if first is None else min(first, earliest)
        kept = self.kept.get()
        if first is not None and (kept is None or first < kept[0]):
            self.store.registerTimer(first)
            self.kept.update((first, *(kept[1:] if kept else ([], None))))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        kept = self.kept.get()
        if kept is None or kept[0] > limit:  # a timer from before an earlier event came
            return
        due, later = [], []
        for e in map(tuple, self.waiting.get()):
            (due if e[0] // 1000 <= limit else later).append(e)
        self.handle.times = list(kept[1])
        state, out = self.taken(tuple(kept[2]) if kept[2] is not None else None, sorted(due), limit)
        if due and later:
            self.waiting.put(later)
        elif due:
            self.waiting.clear()
        coming = min([e[0] // 1000 for e in later] + self.handle.times, default=None)
        if coming is None and state is None:
            self.kept.clear()
        else:
            if coming is not None:
                self.store.registerTimer(coming)
            self.kept.update((NEVER if coming is None else coming, self.handle.times, state))
        if out:
            names = self.rows.split(", ")
            frame = pd.DataFrame([(*key, *r) for r in out], columns=names)
            yield frame.astype({c: "Int64" for c in names if c.endswith("_id")})

    def taken(self, state, events: list[tuple], limit: int) -> tuple:
        """The numbers and rows after ``events`` (in order) and the alarms between them and up to ``limit``."""
        out = []
        for event in events:
            at = event[0] // 1000
            while (alarm := self.handle.next(at - 1)) is not None:
                state, told = self.alarm(state, alarm)
                out += told
            self.handle.times = []
            state, told = self.event(state, event)
            out += told
        while (alarm := self.handle.next(limit)) is not None:
            state, told = self.alarm(state, alarm)
            out += told
        return state, out

    def close(self) -> None:
        pass


class Breaker(InOrder):
    """A circuit breaker that a timer turns half-open when its two hours are over. What a fresh one would tell as well is forgotten; so is one
    that was opened before, ``forget_s`` after its last event."""

    numbers, rows = "count int, last double, until double, opened int, seen long, told int", "user_id, event_id, state, opened, at_ms"

    def __init__(self, forget_s: int) -> None:
        self.forget_s = forget_s

    def event(self, state, event):
        us, number, kind, _ = event
        out = self.over(state, us / 1e6) if state else []
        now, told = breaker_step(state[:4] if state else FRESH, us / 1e6, kind == "error")
        for at in ([math.ceil(now[2] * 1000)] if now[2] * 1e6 > us else []) + [us // 1000 + GAP_S * 1000 + 1000] + ([us // 1000 + self.forget_s * 1000] if now[3] else []):
            self.handle.registerTimer(at)
        return (*now, us // 1000, 0 if now[2] * 1e6 > us else 1), [*out, (number, told, now[3], us // 1000)]

    def over(self, state, at: float) -> list[tuple]:
        """The row of an open breaker whose time is over at ``at``, unless it was told."""
        return [(None, "half_open", state[3], math.ceil(state[2] * 1000))] if not state[5] and 0 <= state[2] <= at else []

    def alarm(self, state, due):
        if state is None:
            return None, []
        idle, out = due - state[4], self.over(state, due / 1000)
        forgotten = idle >= self.forget_s * 1000 or state[2] < 0 and not state[3] and idle > GAP_S * 1000
        return None if forgotten else (*state[:5], 1 if out else state[5]), out


class Quota(InOrder):
    """An hour's sum of a client, dropped when the hour ends."""

    numbers, rows = "used double", "client, hour, request_id, accepted"

    def __init__(self, hourly: float, most: float) -> None:
        self.hourly, self.most = hourly, most

    def event(self, state, event):
        us, number, _, amount = event
        fine = 0 <= amount <= self.most and (state is None or state[0] + amount <= self.hourly)
        self.handle.registerTimer((us // 3_600_000_000 + 1) * 3_600_000)
        return ((state[0] if state else 0.0) + amount,) if fine else state, [(number, bool(fine))]

    def alarm(self, state, due):
        return None, []


class Lease(InOrder):
    """A job's lease: ``lease`` events take it for ``lease_s``, ``done`` ones end it; a timer gives it back when it runs out."""

    numbers, rows = "attempts int, until long, told int", "job_id, attempts, outcome, at_ms, available_ms"

    def __init__(self, lease_s: int) -> None:
        self.lease_s = lease_s

    def event(self, state, event):
        us, _, kind, _ = event
        at = us // 1000
        if state and state[1] >= at:
            if kind == "done":
                return None, [(state[0], "done", at, None)]
            self.handle.registerTimer(state[1] + 1)
            return state, []
        state, out = self.alarm(state, at)
        if kind == "done":
            return state, out
        self.handle.registerTimer(at + self.lease_s * 1000 + 1)
        return ((state[0] if state else 0) + 1, at + self.lease_s * 1000, 0), out

    def alarm(self, state, due):
        if state is None or state[2] or due <= state[1]:
            return state, []
        return (*state[:2], 1), [(state[0], "requeued", state[1], state[1] + 1000 * min(300, 5 * 2 ** (state[0] - 1)))]


def _in_order(events: DataFrame, keys: list[str], processor: InOrder, schema: str, delay: str) -> DataFrame:
    # Set for the session: this kind of state is kept by this provider alone.
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return events.withWatermark("ts", delay).withColumn("us", F.unix_micros("ts")).groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "EventTime")


def circuit_breaker(events: DataFrame, delay: str = "1 hour", forget_days: int = 3_650) -> DataFrame:
    """The breaker's state after each failure (error) or success (purchase) of each user, and, with a null ``event_id``,
    when it turns half-open (``at_ms``: milliseconds since the epoch).

    Rows come once the watermark, ``delay`` behind the newest event, has passed them; later ones are dropped.
    """
    used = events.where(F.col("event_type").isin("error", "purchase") & F.col("user_id").isNotNull()).select("user_id", "ts", F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.lit(0.0).alias("amount"))
    return _in_order(used, ["user_id"], Breaker(forget_days * 86_400), f"{BREAKER_SCHEMA}, at_ms long", delay)


def stream_quota(requests: DataFrame, hourly: int = 60, most: int = 20, delay: str = "1 hour") -> DataFrame:
    """``weighted_quota`` as a stream (client and request_id: whole numbers): (client, hour, request_id, accepted); an hour's sum is dropped when it ends."""
    used = requests.where("client is not null").select("client", F.unix_millis(F.date_trunc("hour", "ts")).alias("hour"), "ts", F.col("request_id").alias("id"), F.lit("").alias("kind"), F.col("amount").cast("double").alias("amount"))
    return _in_order(used, ["client", "hour"], Quota(hourly, most), "client long, hour long, request_id long, accepted boolean", delay)


def leases(events: DataFrame, lease_s: int, delay: str = "1 hour") -> DataFrame:
    """What becomes of leases (job_id, ts, id, kind: lease or done): job_id, attempts, outcome (done or requeued), at_ms, available_ms.

    A lease that nothing ends runs out without any event, and its job can be had again after
    min(300, 5 x 2^(attempts - 1)) seconds. A lease on a job that is held changes nothing, nor
    does an end that comes too late. A job that is done is forgotten.
    """
    used = events.where("job_id is not null").select("job_id", "ts", "id", "kind", F.lit(0.0).alias("amount"))
    return _in_order(used, ["job_id"], Lease(lease_s), "job_id long, attempts int, outcome string, at_ms long, available_ms long", delay)


def with_end(events: DataFrame, path: str, wait: str = "30 days") -> DataFrame:
    """``events`` and two rows of a user -1 that come ``wait`` after the newest row of the table at ``path``, and again ``wait`` later,
    one a batch: a drained stream's watermark passes all events, then the timers that they set."""
    spark = events.sparkSession
    end = f"{shared_dir(spark)}/end-{uuid.uuid4().hex}"
    last = spark.read.parquet(path).select(F.max("ts").cast("timestamp").alias("ts"))
    own = {"user_id": -1, "event_id": -1, "event_type": "purchase"}
    for times in (1, 2):
        later = F.col("ts") + times * F.expr(f"interval {wait}")
        last.select(*[(later if f.name == "ts" else F.lit(own.get(f.name)).cast(f.dataType)).alias(f.name) for f in events.schema]).write.mode("append").parquet(end)
    return events.unionByName(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(end))


def breaker_batch(events: DataFrame) -> DataFrame:
    """The same over a whole table: a user's events come in order and only the breaker's state is held, so a user may have any number."""
    used = events.where(F.col("event_type").isin("error", "purchase")).select("user_id", "ts", "event_id", "event_type")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, now = None, FRESH
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                if r.user_id != user:
                    user, now = r.user_id, FRESH
                now, told = breaker_step(now, r.ts.timestamp(), r.event_type == "error")
                rows.append((r.user_id, r.event_id, told, now[3]))
            yield pd.DataFrame(rows, columns=["user_id", "event_id", "state", "opened"])

    return used.repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id").mapInPandas(run, BREAKER_SCHEMA)


def weighted_quota(requests: DataFrame, hourly: int = 60, most: int = 20) -> DataFrame:
    """(request_id, accepted): whether a client's request still fits its hour, in order of time.

    An hour's first request opens it; later ones are taken while the sum stays within ``hourly``, and those that are
    refused use nothing up. Amounts under 0 or over ``most`` are refused. Columns: client, ts, request_id, amount.
    Only an hour's sum is held, so a client may have any number of requests.
    """
    hours = requests.select("client", F.date_trunc("hour", "ts").alias("hour"), "ts", "request_id", "amount")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, used = None, None
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                if (r.client, r.hour) != at:
                    at, used = (r.client, r.hour), None
                fine = 0 <= r.amount <= most and (used is None or used + r.amount <= hourly)
                if fine:
                    used = (used or 0) + r.amount
                rows.append((r.request_id, bool(fine)))
            yield pd.DataFrame(rows, columns=["request_id", "accepted"])

    kind = requests.schema["request_id"].dataType.simpleString()
    return hours.repartition("client", "hour").sortWithinPartitions("client", "hour", "ts", "request_id").mapInPandas(run, f"request_id {kind}, accepted boolean")


def spaced_requests(events: DataFrame, seconds: int) -> DataFrame:
    """Slots for each user's requests, at least ``seconds`` apart: (user_id, event_id, slot_s since the epoch).

    slot = max(time, last slot + gap); as the gap is the same for all, that is
    gap x place + the largest (time - gap x place) so far, which a window tells.
    """
    from pyspark.sql.window import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    placed = events.withColumn("place", F.row_number().over(order)).withColumn("free", at - seconds * F.col("place"))
    return placed.select("user_id", "event_id", (F.max("free").over(order.rowsBetween(Window.unboundedPreceding, 0)) + seconds * F.col("place")).alias("slot_s"))
