"""Inventory and usage: counts, caps, limits, ladders, retention; folds over a key's events in the order of time.

The folds are pure functions from (state, event) to (state, row), used by the batch operators here, which read each key's
sorted rows batch by batch, and by the streaming ones, which keep the state between batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.operators.numbering import numbered
from folioflow.scratch import free_name


def _micros(ts: Column | str) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


# --- inventory --------------------------------------------------------------------------------------------------------


def folder_counts(notes: DataFrame, by: Sequence[str] = ("vault_id",)) -> DataFrame:
    """Notes in each folder; a folder of which only the marker exists counts 0."""
    return notes.groupBy(*by, "folder").agg(F.count_if(F.col("kind") == "note").alias("notes"))


def tag_counts(notes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Notes with each tag; a note counts once for a tag."""
    return notes.select(*by, F.explode(F.array_distinct("tags")).alias("tag")).groupBy(*by, "tag").agg(F.count("*").alias("notes"))


def distinct_values(notes: DataFrame, column: str) -> DataFrame:
    return notes.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def embed_status(notes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """total, indexed and pending; stale means no embed_hash, or one that differs from a known content_hash."""
    stale = F.col("embed_hash").isNull() | (F.col("embed_hash") != F.col("content_hash"))
    return notes.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.col("embed_hash") == F.col("content_hash")).alias("indexed"), F.count_if(stale).alias("pending"))


def storage_usage(files: DataFrame, by: Sequence[str] = ("vault_id",), size: str = "size_bytes") -> DataFrame:
    return files.groupBy(*by).agg(F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("bytes"), F.count("*").alias("files"))


def content_counts(vaults: DataFrame, notes: DataFrame, attachments: DataFrame, key: str = "vault_id") -> DataFrame:
    """Every vault with its notes and attachments, 0 where it has none."""
    a = notes.groupBy(key).agg(F.count("*").alias("_n"))
    b = attachments.groupBy(key).agg(F.count("*").alias("_a"))
    return vaults.join(a, key, "left").join(b, key, "left").select(*vaults.columns, F.coalesce("_n", F.lit(0)).alias("notes"), F.coalesce("_a", F.lit(0)).alias("attachments"))


def latest(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in the order given."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")


def provider_counts(rows: DataFrame, known: Sequence[str], column: str = "provider") -> DataFrame:
    """Counts by provider with a zero for each known one without rows, and ``other`` for the rest."""
    named = rows.select(F.when(F.col(column).isin(list(known)), F.col(column)).otherwise("other").alias(column), F.lit(1).alias("n"))
    zeros = rows.sparkSession.createDataFrame([(k, 0) for k in [*known, "other"]], f"{column} string, n int")
    return named.unionByName(zeros).groupBy(column).agg(F.sum("n").alias("n"))


def orphans(rows: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    return rows.join(owners, key, "left_anti").select(key).distinct()


def decremented(counter: Column, by: Column) -> Column:
    """A counter that never falls below 0."""
    return F.greatest(F.lit(0), counter - by)


def recounted(meters: DataFrame, notes: DataFrame, key: str = "user_id", counter: str = "notes_count") -> DataFrame:
    """Meters whose counter isn't the number of live notes, with that number."""
    real = notes.where(F.col("deleted_at").isNull()).groupBy(key).agg(F.count("*").alias("_real"))
    joined = meters.join(real, key, "left").withColumn("real", F.coalesce("_real", F.lit(0)))
    return joined.where(~F.col(counter).eqNullSafe(F.col("real"))).select(key, counter, "real")


# --- caps and ladders -------------------------------------------------------------------------------------------------


def over_cap_every_day(stats: DataFrame, cap: int, days: Sequence[str], user: str = "user_id", count: str = "request_count") -> DataFrame:
    """Users whose requests exceed the cap on every one of the days: a division of (user, day) by the days."""
    dates = [F.to_date(F.lit(d)) for d in days]
    daily = stats.where(F.col("day").isin(dates)).groupBy(user, "day").agg(F.sum(count).alias("n")).where(F.col("n") > cap)
    return daily.groupBy(user).agg(F.count("*").alias("days")).where(F.col("days") == len(set(days))).select(user)


def inactivity_ladder(users: DataFrame, today: str, bands: Sequence[int] = (60, 80, 90), grace: int = 30) -> DataFrame:
    """The step of each user's inactivity: active, warn_<days> for each band but the last, disable, delete after the grace."""
    idle = F.datediff(F.to_date(F.lit(today)), F.to_date("last_active"))
    step = F.when(idle >= bands[-1] + grace, "delete").when(idle >= bands[-1], "disable")
    for b in reversed(bands[:-1]):
        step = step.when(idle >= b, f"warn_{b}")
    return users.withColumn("idle_days", idle).withColumn("step", step.otherwise("active"))


def kept_by_retention(rows: DataFrame, today: str, days: int, ts: str = "ts") -> DataFrame:
    return rows.where(F.col(ts) >= F.to_date(F.lit(today)) - F.expr(f"INTERVAL {int(days)} DAYS"))


def unexpired(rows: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    """Rows whose expiry is later than ``now``; without one they never expire."""
    return rows.where(F.col(expires).isNull() | (F.col(expires) > now))


def fixed_window_limit(hits: DataFrame, seconds: int, limit: int, key: str = "user_id", ts: str = "ts", id_: str = "event_id") -> DataFrame:
    """Each hit with its window's start and whether it is within the limit."""
    start = F.timestamp_seconds(F.floor((_micros(ts) / 1_000_000) / seconds) * seconds)
    rows = hits.withColumn("window_start", start)
    return rows.withColumn("allowed", F.row_number().over(Window.partitionBy(key, "window_start").orderBy(ts, id_)) <= limit)


def hot_cold(rows: DataFrame, key: str, ts: str = "ts", within_ms: int = 2000, id_: str = "event_id") -> DataFrame:
    """Hot if the key's event before came less than ``within_ms`` ago."""
    before = F.lag(ts).over(Window.partitionBy(key).orderBy(ts, id_))
    gap = _micros(ts) - _micros(before)
    return rows.withColumn("hot", F.coalesce(gap < within_ms * 1000, F.lit(False)))


def drain_slots(cold: DataFrame, topic: str, per_slot: int = 20, ts: str = "ts", id_: str = "event_id") -> DataFrame:
    """Cold events in the order of arrival, ``per_slot`` for each slot of a topic; a topic of any size fills many tasks."""
    place = free_name(cold.columns, "_place")
    return numbered(cold, [F.col(ts), F.col(id_)], place, [topic]).withColumn("slot", F.expr(f"(`{place}` - 1) div {per_slot}").cast("int")).drop(place)


def evicted(entries: DataFrame, cap: int, by: str, ts: str = "last_used", id_: str = "id") -> DataFrame:
    """The oldest entries of each key beyond its cap."""
    return entries.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(ts), F.desc(id_)))).where(F.col("_r") > cap).drop("_r")


def compaction_due(state_bytes: Column, clients: Column) -> Column:
    return (state_bytes >= 500_000) & (clients >= 1000)


def retry_after(now: Column, kind: Column) -> Column:
    seconds = F.when(kind == "transient", 300).when(kind == "persistent", 21_600).otherwise(1_800)
    return F.timestamp_add("SECOND", seconds, now)


def embed_priority(embed_hash: Column) -> Column:
    return F.when(embed_hash.isNull(), 9).otherwise(0)


def bucketed(value: Column, edges: Sequence[float]) -> Column:
    """The number of the first edge that isn't below the value; one more than there are edges beyond the last."""
    out = None
    for i, e in enumerate(edges):
        out = F.when(value <= e, i) if out is None else out.when(value <= e, i)
    return out.otherwise(len(edges))


def histogram(rows: DataFrame, value: str, edges: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*by, bucketed(F.col(value), edges).alias("bucket")).agg(F.count("*").alias("n"))


def ingested_logs(logs: DataFrame, now: Column, message: int = 8000, stack: int = 16_000, short: int = 128, columns: Sequence[str] = ("category", "plugin_version", "platform", "conn_id", "device_id")) -> DataFrame:
    """Client logs with bounded fields, a level, and a time: an invalid or missing one is ``now``."""
    return logs.select(F.coalesce(F.try_to_timestamp(F.col("ts").cast("string")), now).alias("ts"), F.coalesce(F.substr("level", F.lit(1), F.lit(short)), F.lit("info")).alias("level"), F.substr("message", F.lit(1), F.lit(message)).alias("message"), F.substr("stack", F.lit(1), F.lit(stack)).alias("stack"), *[F.substr(c, F.lit(1), F.lit(short)).alias(c) for c in columns])


# --- folds ------------------------------------------------------------------------------------------------------------


@dataclass
class Meter:
    """Conversations anchored at their first query, with caps by conversation and by day.

    A query opens a conversation if there is none, if the open one began more than ``window`` minutes ago, or if it has
    its full number of queries.  A new day starts its counts anew.  Opening is refused beyond the day's conversations,
    though the conversation then counts, and a query is refused at the day's full number of queries.
    """

    window: int = 30
    per_conversation: int = 50
    conversations: int = 5
    queries: int = 200
    state: dict = field(default_factory=lambda: {"start": None, "in": 0, "day": None, "opened": 0, "asked": 0})

    def __call__(self, us: int) -> tuple[int, int, str]:
        s, day = self.state, us // 86_400_000_000
        if s["day"] != day:
            s.update(day=day, opened=0, asked=0)
        if s["start"] is None or us - s["start"] > self.window * 60_000_000 or s["in"] >= self.per_conversation:
            s.update(start=us, opened=s["opened"] + 1)
            s["in"] = 0
            if s["opened"] > self.conversations:
                return s["opened"], 0, "conversation_cap"
        elif s["opened"] > self.conversations:
            return s["opened"], s["in"], "conversation_cap"
        if s["asked"] >= self.queries:
            return s["opened"], s["in"], "query_cap"
        s["in"] += 1
        s["asked"] += 1
        return s["opened"], s["in"], "allowed"

    def until(self) -> int | None:
        """From this microsecond on the state tells no more than none: the day and the conversation's window are over."""
        s = self.state
        return None if s["start"] is None else max((s["day"] + 1) * 86_400_000_000, s["start"] + self.window * 60_000_000 + 1)


@dataclass
class Bucket:
    """A token bucket: refilled with time up to its capacity, one token for a call; a refused call changes nothing."""

    capacity: float = 10.0
    per_second: float = 0.1
    state: dict = field(default_factory=lambda: {"tokens": None, "at": None})

    def __call__(self, us: int) -> tuple[float, str]:
        s = self.state
        now = self.capacity if s["tokens"] is None else min(self.capacity, s["tokens"] + max(0, us - s["at"]) / 1e6 * self.per_second)
        if now < 1:
            return now, "denied"
        s.update(tokens=now - 1, at=us)
        return now - 1, "allowed"

    def until(self) -> int | None:
        """From this microsecond on the bucket is full again, as without a state; None where that never comes."""
        s = self.state
        if s["tokens"] is None or self.per_second <= 0:
            return None
        return s["at"] + int((self.capacity - s["tokens"]) / self.per_second * 1e6) + 1_000_000  # a second for rounding


def debounced(times: Sequence[int], quiet: int, ceiling: int, eager: int | None = None, idle: int | None = None) -> list[tuple[int, int, int]]:
    """(first, run at, events) of each run: ``quiet`` after the last event of a burst, at most ``ceiling`` after its first.

    With ``eager``, a burst that follows at least ``idle`` without events runs its first flush that soon.
    """
    burst = Burst(quiet, ceiling, eager, idle)
    out = [r for t in times if (r := burst(t))]
    return [*out, burst.run()] if burst.count else out


@dataclass
class Burst:
    """The open burst of ``debounced``: takes the next time and gives the run that it ends, if any."""

    quiet: int
    ceiling: int
    eager: int | None = None
    idle: int | None = None
    first: int = 0
    due: int = 0
    count: int = 0
    last: int | None = None
    fixed: bool = False

    def run(self) -> tuple[int, int, int]:
        return self.first, self.due, self.count

    def __call__(self, t: int) -> tuple[int, int, int] | None:
        ended = None
        if self.count and t > self.due:
            ended, self.count = self.run(), 0
        if not self.count:
            self.first = t
            calm = self.eager is not None and (self.last is None or t - self.last >= (self.idle or self.quiet))
            self.due, self.fixed = (t + self.eager, True) if calm else (t + self.quiet, False)
        elif not self.fixed:
            self.due = min(t + self.quiet, self.first + self.ceiling)
        self.count += 1
        self.last = t
        return ended


def _fold(rows: DataFrame, key: str, ts: str, order: Sequence[str], make: Callable[[], Callable], out: str, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """A step for each row, by key in order of time.  A key's rows meet in one task, sorted by Spark, which can spill; Python
    holds one batch of them and the step's state."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, step = object(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            made = []
            for value, us in zip(batch.column(key).to_pylist(), batch.column("_us").to_pylist(), strict=True):
                if step is None or value != last:
                    last, step = value, make()
                made.append(step(us))
            columns = [pa.array(c) for c in zip(*made, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (key, *keep)), *(c.cast(t) for c, t in zip(columns, types, strict=True))], [key, *keep, *names])

    types = [{"int": pa.int32(), "double": pa.float64(), "string": pa.string()}[c.split()[1]] for c in out.split(", ")]
    schema = ", ".join([f"{key} {kinds[key]}", *[f"{c} {kinds[c]}" for c in keep], out])
    dealt = rows.select(key, *keep, _micros(ts).alias("_us")).repartition(key).sortWithinPartitions(key, "_us", *order)
    return dealt.mapInArrow(run, schema)


def conversation_meter(ticks: DataFrame, key: str = "user_id", ts: str = "ts", id_: str = "event_id", **dials: int) -> DataFrame:
    """key, id, conversation_no, query_no and decision of each tick."""
    return _fold(ticks, key, ts, [id_], lambda: Meter(**dials), "conversation_no int, query_no int, decision string", ("conversation_no", "query_no", "decision"), [id_])


def token_bucket(calls: DataFrame, key: str = "user_id", ts: str = "ts", id_: str = "event_id", **dials: float) -> DataFrame:
    """key, id, tokens (after the call) and decision of each call."""
    return _fold(calls, key, ts, [id_], lambda: Bucket(**dials), "tokens double, decision string", ("tokens", "decision"), [id_])


def debounce(events: DataFrame, key: str = "user_id", ts: str = "ts", quiet: float = 30, ceiling: float = 300, eager: float | None = None, idle: float | None = None) -> DataFrame:
    """key, first, run_at and events of each run, in seconds of event time."""
    us = lambda s: None if s is None else int(s * 1e6)
    kinds = dict(events.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, burst, kind = None, None, None
        for batch in batches:
            made, kind = [], batch.schema.field(key).type
            for value, t in zip(batch.column(key).to_pylist(), batch.column("_us").to_pylist(), strict=True):
                if burst is None or value != last:
                    made += [(last, *burst.run())] if burst else []
                    last, burst = value, Burst(us(quiet), us(ceiling), us(eager), us(idle))
                if ended := burst(t):
                    made.append((last, *ended))
            yield rows(made, kind)
        if burst:
            yield rows([(last, *burst.run())], kind)

    def rows(made: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        types = (kind, pa.int64(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate(types)], [key, "first_us", "run_us", "events"])

    dealt = events.select(key, _micros(ts).alias("_us")).repartition(key).sortWithinPartitions(key, "_us")
    found = dealt.mapInArrow(run, f"{key} {kinds[key]}, first_us bigint, run_us bigint, events int")
    return found.select(key, F.timestamp_micros("first_us").alias("first"), F.timestamp_micros("run_us").alias("run_at"), "events")


def idle_delay(idle_seconds: Column, attempts: Column, base: int = 300) -> Column:
    """Seconds to the next drain: null while active, then longer with each attempt, eightfold at most."""
    return F.when(idle_seconds >= base, base * F.least(attempts + 1, F.lit(8)))


def replayed(snapshot: DataFrame, log: DataFrame, key: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Last writer wins: the newest value of each key over a snapshot and a log of updates; equal updates count once."""
    both = snapshot.unionByName(log).dropDuplicates()
    return both.groupBy(*key).agg(F.max_by(value, F.struct(*order, value)).alias(value))
