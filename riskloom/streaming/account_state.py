"""Real-time account features as a keyed stateful operator.

State per account: times and amounts by the hour, last sighting of each device, city and counterparty, count and
sum of everything so far, and the ids of answered transactions.  Rows are answered on arrival, however late, and each
counts what has arrived from an hour (a day, 30 days) before it on, later rows included.

State is bounded by an account's *clock*: the ``CONFIRM``-th newest event time that it has had.  One or two events with
a wrong time, however far ahead, count like all others but do not move the clock, so they erase nothing and keep nothing
out; rows without a time of their own never move it.  Slices are kept for a day plus ``remember`` hours before the
clock, sightings for 30 days plus ``remember`` hours, so a row up to ``remember`` hours late is counted and counts
others exactly like one in time.  Ids are kept by the hour of their event time for ``remember`` hours of the clock after
the last one of that hour came in.  A still later row is answered from what is left and is not stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from riskloom.streaming import payload

HOUR = 3_600_000_000  # microseconds
DAY, MONTH = 24 * HOUR, 30 * 24 * HOUR
SLACK = HOUR          # kept beyond the window for rows out of order
REMEMBER = 72         # hours for which transaction ids are remembered, and by which rows may be late
CONFIRM = 3           # events that have to be newer than a time before it moves an account's clock
ATTRIBUTES = (("device_id", "device_count_30d"), ("ip_city", "city_count_30d"),
              ("counterparty_hash", "counterparty_count_30d"))

MEASURES = (("count_1h", "int"), ("cents_1h", "long"), ("count_24h", "int"), ("cents_24h", "long"),
            *[(m, "int") for _, m in ATTRIBUTES], ("count_all", "long"), ("cents_all", "long"))
INPUT = ("transaction_id", "timed", "micros", "cents", *[a for a, _ in ATTRIBUTES], "payload")
CURRENT = "micros long, payload array<string>, " + ", ".join(f"{n} {kind}" for n, kind in MEASURES)


def _running(starts: np.ndarray, ends: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows the sum of the weights whose [start, end) contains it."""
    change = np.zeros(n + 1, dtype=weights.dtype)
    live = ends > starts
    np.add.at(change, starts[live], weights[live])
    np.add.at(change, ends[live], -weights[live])
    return np.cumsum(change[:n])


class AccountState(StatefulProcessor):
    def __init__(self, remember: int = REMEMBER, serve_seconds: int = 0):
        self.remember, self.serve_seconds = remember, serve_seconds
        self.lateness = (remember or REMEMBER) * HOUR

    def init(self, handle) -> None:
        self.handle = handle
        # one value each: every access is a message to the store, whatever its size, and accounts have few rows an hour
        self.ids = handle.getValueState("ids", "hours array<long>, at array<long>, ids array<array<string>>, newest array<long>")
        self.slices = handle.getValueState("slices", "times array<long>, cents array<long>")
        self.profile = handle.getValueState(
            "profile", "n long, cents long, attributes array<int>, values array<string>, last array<long>")
        if self.serve_seconds:
            self.current = handle.getValueState("current", CURRENT, self.serve_seconds * 1000)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        batch = dict(zip(INPUT, zip(*[[row[name] for name in INPUT] for row in rows])))
        micros, ids = np.array(batch["micros"], np.int64), np.array(batch["transaction_id"], object)
        *held, newest = self.ids.get() or ([], [], [], [])
        newest = self._newest(newest, micros[np.array(batch["timed"], bool)])
        clock = newest[0] if newest else 0
        fresh, held = self._first_arrivals(held, ids.tolist(), (micros // HOUR).tolist(), clock // HOUR)
        self.ids.update((*held, newest))
        if not len(fresh):
            return
        order = fresh[np.lexsort((ids[fresh].astype(str), micros[fresh]))]
        times, cents = micros[order], np.array(batch["cents"], np.int64)[order]
        n = len(times)
        own = np.arange(n)
        out = {"payload": [batch["payload"][i] for i in order.tolist()]}

        old_times, old_cents = (np.array(v, np.int64) for v in self.slices.get() or ([], []))
        all_times, all_cents = np.concatenate([old_times, times]), np.concatenate([old_cents, cents])
        starts = np.concatenate([np.zeros(len(old_times), np.int64), own])
        for name, span in (("1h", HOUR), ("24h", DAY)):
            ends = np.searchsorted(times, all_times + span, side="right")
            out[f"count_{name}"] = _running(starts, ends, np.ones_like(all_cents), n).astype(np.int32)
            out[f"cents_{name}"] = _running(starts, ends, all_cents, n)

        n_before, cents_before, *sighted = self.profile.get() or (0, 0, [], [], [])
        known = self._sightings(sighted)
        for number, (attribute, measure) in enumerate(ATTRIBUTES):
            values = [batch[attribute][i] for i in order.tolist()]
            out[measure] = self._distinct(values, times, known[number]).astype(np.int32)

        out["count_all"], out["cents_all"] = n_before + own + 1, cents_before + np.cumsum(cents)
        self._remember(int(out["count_all"][-1]), int(out["cents_all"][-1]), known, clock - self.lateness)
        self._store(all_times, all_cents, (clock - DAY - self.lateness - SLACK) // HOUR)
        if self.serve_seconds:
            self._serve(times, out)
        if not self.serve_seconds and timerValues.getCurrentWatermarkInMs() >= 0:
            self.handle.registerTimer(int(times[-1] + DAY + SLACK) // 1000)
        answer = Row("payload", *[m for m, _ in MEASURES])
        for values in zip(out["payload"], *[out[m].tolist() for m, _ in MEASURES]):
            yield answer(*values)

    def _serve(self, times: np.ndarray, out: dict[str, np.ndarray]) -> None:
        """Keeps the features of the newest event; the store forgets them ``serve_seconds`` after the last write."""
        held = self.current.get()
        if held is None or held[0] <= int(times[-1]):
            self.current.update((int(times[-1]), list(out["payload"][-1]), *[int(out[n][-1]) for n, _ in MEASURES]))

    @staticmethod
    def _newest(before: list[int], times: np.ndarray) -> list[int]:
        """The ``CONFIRM`` newest of all distinct event times; the oldest of them is the account's clock."""
        return np.unique(np.concatenate([np.array(before, np.int64), times]))[-CONFIRM:].tolist()

    def _first_arrivals(self, held, ids: list[str | None], hours: list[int], now: int) -> tuple[np.ndarray, tuple]:
        """Places of the rows whose id was not answered before, and the ids to hold; rows without an id always are."""
        if not self.remember:
            return np.arange(len(ids)), held
        known = {hour: (at, set(have)) for hour, at, have in zip(*held)}
        seen, fresh = set(), []
        for place, (name, hour) in enumerate(zip(ids, hours)):
            if name is not None:
                if name in seen:
                    continue
                seen.add(name)
                have = known.get(hour, (now, set()))[1]
                if name in have:
                    continue
                have.add(name)
                known[hour] = now, have
            fresh.append(place)
        live = [(hour, at, sorted(have)) for hour, (at, have) in known.items() if at >= now - self.remember]
        return np.array(fresh, np.int64), ([h for h, _, _ in live], [at for _, at, _ in live], [have for _, _, have in live])

    @staticmethod
    def _sightings(sighted) -> list[dict[str, int]]:
        known: list[dict[str, int]] = [{} for _ in ATTRIBUTES]
        for number, value, last in zip(*sighted):
            known[number][value] = last
        return known

    def _remember(self, n: int, cents: int, known: list[dict[str, int]], now: int) -> None:
        live = [(number, v, t) for number, seen in enumerate(known) for v, t in seen.items() if t + MONTH + SLACK >= now]
        self.profile.update((n, cents, [x[0] for x in live], [x[1] for x in live], [x[2] for x in live]))

    def _store(self, times: np.ndarray, cents: np.ndarray, oldest: int) -> None:
        """Keep the rows of the hours from ``oldest`` on."""
        kept = times // HOUR >= oldest
        self.slices.update((times[kept].tolist(), cents[kept].tolist()))

    @staticmethod
    def _distinct(values: list[str | None], times: np.ndarray, seen: dict[str, int]) -> np.ndarray:
        """Distinct values within 30 days at every row; ``seen`` takes up the new sightings.

        A sighting counts from its row until the value is seen again or leaves the window.
        """
        n = len(times)
        starts, lasts, ends, open_at = [0] * len(seen), list(seen.values()), [n] * len(seen), {}
        for position, value in enumerate(seen):
            open_at[value] = position
        for row, (value, time) in enumerate(zip(values, times.tolist())):
            if value is None:
                continue
            if value in open_at:
                ends[open_at[value]] = row
            open_at[value] = len(starts)
            starts.append(row)
            lasts.append(max(time, seen.get(value, 0)))
            ends.append(n)
            seen[value] = lasts[-1]
        gone = np.searchsorted(times, np.array(lasts, np.int64) + MONTH, side="right")
        return _running(np.array(starts, np.int64), np.minimum(np.array(ends, np.int64), gone), np.ones(len(starts), np.int64), n)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        times, cents = (np.array(v, np.int64) for v in self.slices.get() or ([], []))
        self._store(times, cents, (now - DAY - SLACK) // HOUR)
        n, cents, *sighted = self.profile.get() or (0, 0, [], [], [])
        known = self._sightings(sighted)
        self._remember(n, cents, known, now)
        remaining = [t for seen in known for t in seen.values() if t + MONTH + SLACK >= now]
        if remaining:  # come back when they are out of their window
            self.handle.registerTimer((max(remaining) + MONTH + 2 * SLACK) // 1000)
        yield from ()

    def close(self) -> None:
        pass


def stream_features(stream: DataFrame, key: str = "account_id", late_policy: str = "process",
                    remember: int = REMEMBER, ts: str = "transaction_time", serve_seconds: int = 0) -> DataFrame:
    """Adds the real-time features to a stream that has an ``event_time``, one row per transaction id.

    ``process`` answers every row however late, without event-time timers; ``drop`` ignores
    rows older than the watermark (Spark counts them in the query's progress, which
    ``pipeline.dropped_rows`` adds up) and cleans state by event time.  ``remember`` is the
    number of hours of event time for which ids are known; 0 turns de-duplication off.  Rows
    without ``ts`` have the time of their arrival and do not move their account's clock.
    Columns of any type pass through.

    With ``serve_seconds`` the state also holds each account's current features, for that long
    after their last write; ``served_features`` reads them from the checkpoint.
    """
    if late_policy not in ("process", "drop"):
        raise ValueError("late_policy must be 'process' or 'drop'")
    if serve_seconds and late_policy == "drop":
        raise ValueError("features are served by time of processing, which needs late_policy='process'")
    # the row travels as one column of strings, and as a row: a frame per account would cost more
    # to convert than the features cost to compute
    timed = f"`{ts}` is not null" if ts in stream.columns else "true"
    ready = stream.selectExpr(
        f"coalesce(cast({key} as string), 'unknown') as account_key", "event_time", "transaction_id", f"{timed} as timed",
        "unix_micros(event_time) as micros", "cast(coalesce(amount, 0) * 100 as bigint) as cents",
        *[a for a, _ in ATTRIBUTES], f"{payload.packed(stream.schema)} as payload")
    schema = "payload array<string>, " + ", ".join(f"{n} {kind}" for n, kind in MEASURES)
    mode = "ProcessingTime" if serve_seconds else "EventTime" if late_policy == "drop" else "None"
    out = ready.groupBy("account_key").transformWithState(
        AccountState(remember, serve_seconds), schema, "Append", mode)
    return _finished(out, stream.schema)


def served_features(spark: SparkSession, checkpoint: str, schema: T.StructType, now: str | None = None) -> DataFrame:
    """Current features of every account, read from the state of a query that serves them.

    One row per account, with ``account_key`` and ``expires_at``; ``schema`` is that of the stream given to
    ``stream_features``, and ``now`` (default: the time of reading) decides what has expired.
    """
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "current").load()
    value = state.selectExpr("key.account_key as account_key", "value.value.*", "timestamp_millis(value.ttlExpirationMs) as expires_at")
    moment = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    return _finished(value.filter(F.col("expires_at") > moment), schema, "account_key", "expires_at")


def _finished(rows: DataFrame, schema: T.StructType, *keep: str) -> DataFrame:
    """Rows of the state operator under the names and types of the stream, with amounts and ratios."""
    rows = rows.selectExpr(*keep, *payload.unpacked(schema), *[n for n, _ in MEASURES])

    def yuan(column):
        return (F.col(column).cast("decimal(20,0)") / 100).cast("decimal(18,2)")

    mean = F.col("cents_all") / 100.0 / F.col("count_all")  # the order of the batch operator
    deviation = F.when(F.col("count_all") >= 2, F.try_divide(F.abs(F.col("amount").cast("double") - mean), mean))
    return rows.select(
        *keep, *schema.names, "count_1h", yuan("cents_1h").alias("amount_1h"), "count_24h", yuan("cents_24h").alias("amount_24h"),
        *[m for _, m in ATTRIBUTES], F.coalesce(deviation, F.lit(0.0)).alias("amount_deviation"),
        F.coalesce(F.col("device_id").isNotNull() & (F.col("device_count_30d") == 1), F.lit(False)).alias("is_first_device"))
