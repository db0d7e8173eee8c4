"""The life of alerts as keyed state: every action folds in, and deadlines are timers.

An alert's state is what the batch fold of its actions gives, and leaves as a row whenever a micro-batch touches it.
Each CREATE sets a deadline.  When the watermark passes it, the alert goes up one level unless it had been handled by
then: what counts is the last action up to the deadline, not what came in before the timer ran.  A newer CREATE takes
the place of an older one whose deadline had not come.

Every access to the state is a message and every call of the operator a frame, so alerts can share the state of a hash
bucket (``BucketState``): two messages and a timer for all alerts of a bucket that a micro-batch touches.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from riskloom import fixed_values as fv
from riskloom.operators.latest import latest_per_key

STATE, ESCALATION = "state", "escalation"
OPEN = ("CREATE", "ESCALATE", "PROCESSING")  # actions after which an alert waits to be handled
OUTPUT = "kind string, alert_id string, alert_status string, assignee string, escalation_level long, micros long, seq long"


class AlertState(StatefulProcessor):
    def __init__(self, hours: int, states: dict[str, str]):
        self.wait, self.states = hours * 3_600_000_000, states

    def init(self, handle) -> None:
        self.handle = handle
        self.fold = handle.getValueState("fold", "micros long, seq long, action string, by_micros long, by_seq long, assignee string, "
                                                 "escalations long, updated long")
        # episodes that wait for their deadline: created, and the last action up to created + wait
        self.waiting = handle.getValueState("waiting", "created array<long>, micros array<long>, seq array<long>, action array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        actions = pd.concat(list(rows), ignore_index=True).sort_values(["micros", "seq"])
        state = self.fold.get()
        last, by, n = ((state[0], state[1], state[2]), (state[3], state[4], state[5]), state[6]) if state else (None, None, 0)
        if by and by[0] is None:
            by = None
        waiting = self._waiting()
        for micros, seq, action, assignee in zip(actions["micros"].tolist(), actions["seq"].tolist(), actions["action"], actions["assignee"]):
            last = max(last, (micros, seq, action)) if last else (micros, seq, action)
            n += action == "ESCALATE"
            if action not in ("CREATE", "ESCALATE"):
                by = max(by, (micros, seq, assignee), key=lambda v: v[:2]) if by else (micros, seq, assignee)
            for created, seen in waiting.items():
                if micros <= created + self.wait and (micros, seq) > seen[:2]:
                    waiting[created] = (micros, seq, action)
            if action == "CREATE" and micros not in waiting:
                for created in [c for c in waiting if c < micros <= c + self.wait]:
                    del waiting[created]
                waiting[micros] = (micros, seq, action)
                self.handle.registerTimer((micros + self.wait) // 1000 + 1)
        self._wait_for(waiting)
        self.fold.update((*last, *(by or (None, None, None)), n, last[0]))
        yield self._row(STATE, key, self.states.get(last[2], "CLOSED"), by[2] if by else None, n, last[0], last[1])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        waiting = self._waiting()
        due = sorted((created, *seen) for created, seen in waiting.items() if created + self.wait <= now)
        if due:
            self._wait_for({created: seen for created, seen in waiting.items() if created + self.wait > now})
        for created, _, seq, action in due:
            if action in OPEN:
                state = self.fold.get()
                yield self._row(ESCALATION, key, "PENDING", state[5], state[6] + 1, created + self.wait, seq)

    def _waiting(self) -> dict[int, tuple[int, int, str]]:
        return {created: tuple(seen) for created, *seen in zip(*(self.waiting.get() or ([], [], [], [])))}

    def _wait_for(self, waiting: dict[int, tuple[int, int, str]]) -> None:
        self.waiting.update(tuple(map(list, zip(*[(created, *seen) for created, seen in waiting.items()]))) or ([], [], [], []))

    @staticmethod
    def _row(kind, key, status, assignee, level, micros, seq) -> pd.DataFrame:
        return pd.DataFrame({"kind": [kind], "alert_id": [key[0]], "alert_status": [status], "assignee": [assignee],
                             "escalation_level": [level], "micros": [micros], "seq": [seq]})

    def close(self) -> None:
        pass


class BucketState(StatefulProcessor):
    """The same for all alerts of a bucket, in one value; a timer waits for the earliest deadline of them."""

    def __init__(self, hours: int, states: dict[str, str]):
        self.wait, self.states = hours * 3_600_000_000, states

    def init(self, handle) -> None:
        self.handle = handle
        fold = "keys array<string>, micros array<long>, seq array<long>, action array<string>, by_micros array<long>, " \
               "by_seq array<long>, assignee array<string>, escalations array<long>"
        waiting = "waiting array<int>, created array<long>, seen_micros array<long>, seen_seq array<long>, seen_action array<string>"
        self.alerts = handle.getValueState("alerts", f"{fold}, {waiting}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        actions = pd.concat(list(rows), ignore_index=True).sort_values(["alert_key", "micros", "seq"])
        folds, waiting = self._held()
        touched = []
        columns = [actions[c].tolist() for c in ("alert_key", "micros", "seq", "action", "assignee")]
        for name, own in groupby(zip(*columns), key=itemgetter(0)):
            last, by, n = folds.get(name, (None, None, 0))
            open_ = waiting.setdefault(name, {})
            for _, micros, seq, action, assignee in own:
                last = max(last, (micros, seq, action)) if last else (micros, seq, action)
                n += action == "ESCALATE"
                if action not in ("CREATE", "ESCALATE"):
                    by = max(by, (micros, seq, assignee), key=lambda v: v[:2]) if by else (micros, seq, assignee)
                for created, seen in open_.items():
                    if micros <= created + self.wait and (micros, seq) > seen[:2]:
                        open_[created] = (micros, seq, action)
                if action == "CREATE" and micros not in open_:
                    for created in [c for c in open_ if c < micros <= c + self.wait]:
                        del open_[created]
                    open_[micros] = (micros, seq, action)
            folds[name] = last, by, n
            touched.append((STATE, name, self.states.get(last[2], "CLOSED"), by[2] if by else None, n, last[0], last[1]))
        self._hold(folds, waiting)
        yield self._rows(touched)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Everything that is due by the watermark, as if each deadline had a timer of its own at the millisecond after it."""
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        folds, waiting = self._held()
        out = []
        for name, open_ in waiting.items():
            for created, (_, seq, action) in sorted(open_.items()):
                if created + self.wait < now:
                    del open_[created]
                    if action in OPEN:
                        _, by, n = folds[name]
                        out.append((ESCALATION, name, "PENDING", by[2] if by else None, n + 1, created + self.wait, seq))
        self._hold(folds, waiting)
        if out:
            yield self._rows(out)

    def _held(self):
        """Of every alert its last action, by whom it was handled last and its escalations; and its episodes that wait."""
        names, *values = self.alerts.get() or ([],) * 13
        micros, seq, action, by_micros, by_seq, assignee, escalations, owner, created, *seen = values
        folds = {name: (last, None if by[0] is None else by, n) for name, last, by, n in zip(
            names, zip(micros, seq, action), zip(by_micros, by_seq, assignee), escalations)}
        waiting = {name: {} for name in names}
        for number, at, *what in zip(owner, created, *seen):
            waiting[names[number]][at] = tuple(what)
        return folds, waiting

    def _hold(self, folds, waiting) -> None:
        names = list(folds)
        last = list(zip(*[f[0] for f in folds.values()])) or [()] * 3
        by = list(zip(*[f[1] or (None, None, None) for f in folds.values()])) or [()] * 3
        episodes = list(zip(*[(number, created, *seen) for number, name in enumerate(names) for created, seen in waiting[name].items()])) or [()] * 5
        self.alerts.update((names, *map(list, last), *map(list, by), [f[2] for f in folds.values()], *map(list, episodes)))
        if episodes[1]:
            self.handle.registerTimer((min(episodes[1]) + self.wait) // 1000 + 1)

    @staticmethod
    def _rows(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["kind", "alert_id", "alert_status", "assignee", "escalation_level", "micros", "seq"])

    def close(self) -> None:
        pass


def alert_life(actions: DataFrame, hours: int = fv.ALERT_DEADLINE_DEFAULT_HOURS, buckets: int | None = None) -> DataFrame:
    """State rows and escalations of a stream of actions (``entity_id``, ``ts``, ``seq``, ``action``, ``assignee``).

    The stream needs a watermark on ``event_time``; actions without an alert or a time take no part.  ``buckets`` is the
    number of groups of alerts that share a state, fixed for the life of a checkpoint; without it every alert has its own.
    """
    ready = actions.selectExpr("cast(entity_id as string) as alert_key", "event_time", "unix_micros(event_time) as micros",
                               "cast(seq as long) as seq", "action", "assignee").filter("alert_key is not null and micros is not null")
    if buckets:
        ready = ready.withColumn("bucket", F.pmod(F.xxhash64("alert_key"), F.lit(buckets)).cast("int"))
    processor = (BucketState if buckets else AlertState)(hours, dict(fv.ALERT_STATES))
    out = ready.groupBy("bucket" if buckets else "alert_key").transformWithStateInPandas(processor, OUTPUT, "Append", "EventTime")
    return out.withColumn("at", F.timestamp_micros("micros")).drop("micros")


def current_alerts(output: DataFrame) -> DataFrame:
    """The state of every alert after all micro-batches written so far."""
    return latest_per_key(output.filter(F.col("kind") == STATE), ["alert_id"], ["at", "seq", "batch_id"])
