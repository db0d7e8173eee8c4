"""Live events with the profile that was in force at their time.

Two streams, profile changes and events, are keyed alike and meet in one stateful operator.  Its state is the versions
of a key's profile.  A micro-batch first takes in its changes, then answers its events: each sees the last version that
is not newer than itself (at equal times the one with the highest sequence number), not the newest one.  A deleted
profile is a version without values.

Every access to the state is a message, whatever its size.  The state of a group is one value with the clocks and
versions of its keys.  A group is a key, or, where most keys have rows in every micro-batch, all keys of a hash bucket.

Versions that no event less than ``remember`` hours late can see are dropped: all but the last one before the key's
clock minus that time.  The clock is that of ``account_state``: single events or changes with a wrong time do not move
it, and neither do events without a time.  An event that came before a change it should have seen is not answered
again here; ``repair`` does that.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from riskloom.streaming import payload
from riskloom.streaming.account_state import CONFIRM, HOUR, REMEMBER

CHANGE, EVENT = 0, 1
NO_TIME = -(1 << 63)  # time of events without one
LEAST = f"cast({NO_TIME} as long)"
HELD = ("keys array<string>, clock_of array<int>, clocks array<long>, "
        "version_of array<int>, times array<long>, seqs array<long>, profiles array<array<string>>")


class ProfileState(StatefulProcessor):
    def __init__(self, remember: int = REMEMBER):
        self.remember = remember

    def init(self, handle) -> None:
        self.versions = handle.getValueState("versions", HELD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        names, clock_of, clocks, version_of, times, seqs, profiles = self.versions.get() or ([], [], [], [], [], [], [])
        # the keys of the state keep their numbers
        owner, names = pd.factorize(np.concatenate([np.array(names, object), batch["profile_key"].to_numpy(object)]))
        owner = owner[len(owner) - len(batch):].astype(np.int64)
        micros, payloads = batch["micros"].to_numpy(np.int64), batch["payload"].to_numpy(object)
        change = batch["side"].to_numpy() == CHANGE

        version_of, times, seqs = (np.concatenate([np.array(old, np.int64), new[change]]) for old, new in (
            (version_of, owner), (times, micros), (seqs, batch["seq"].to_numpy(np.int64))))
        profiles = [*profiles, *[None if p is None else list(p) for p in payloads[change]]]
        order = np.lexsort((seqs, times, version_of))
        version_of, times, seqs, profiles = version_of[order], times[order], seqs[order], [profiles[i] for i in order.tolist()]

        if not change.all():
            at = self._seen(version_of, times, owner[~change], micros[~change]).tolist()
            yield pd.DataFrame({"payload": payloads[~change], "profile": [profiles[i] if i >= 0 else None for i in at],
                                "since": pd.array([int(times[i]) if i >= 0 else None for i in at], "Int64")})

        timed = micros != NO_TIME
        clock_of, clocks = self._newest(np.concatenate([np.array(clock_of, np.int64), owner[timed]]),
                                        np.concatenate([np.array(clocks, np.int64), micros[timed]]))
        oldest = np.full(len(names), NO_TIME, np.int64)
        first = np.flatnonzero(np.diff(clock_of, prepend=-1))
        oldest[clock_of[first]] = clocks[first] - self.remember * HOUR
        # a version goes when the next one of its key is that old, too
        kept = np.ones(len(times), bool)
        kept[:-1] = (version_of[1:] != version_of[:-1]) | (times[1:] > oldest[version_of[:-1]])
        self.versions.update((names.tolist(), clock_of.tolist(), clocks.tolist(), version_of[kept].tolist(), times[kept].tolist(),
                          seqs[kept].tolist(), [p for p, k in zip(profiles, kept.tolist()) if k]))

    @staticmethod
    def _seen(version_of: np.ndarray, times: np.ndarray, owner: np.ndarray, micros: np.ndarray) -> np.ndarray:
        """For each event the place of the last version of its key that is not newer, -1 if there is none."""
        n = len(times)
        order = np.lexsort((np.arange(n + len(owner)), np.concatenate([times, micros]), np.concatenate([version_of, owner])))
        last = np.maximum.accumulate(np.where(order < n, order, -1))
        events = order >= n
        at = np.empty(len(owner), np.int64)
        at[order[events] - n] = last[events]
        return np.where((at >= 0) & (version_of[at] == owner), at, -1) if n else at

    @staticmethod
    def _newest(owner: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ``CONFIRM`` newest of all distinct times of every key; the oldest of them is the key's clock."""
        pairs = np.unique(np.column_stack([owner, times]), axis=0)
        owner, times = pairs[:, 0], pairs[:, 1]
        kept = np.searchsorted(owner, owner, side="right") - np.arange(len(owner)) <= CONFIRM
        return owner[kept], times[kept]

    def close(self) -> None:
        pass


def with_profile_asof(events: DataFrame, changes: DataFrame, key: str, ts: str, change_ts: str, seq: str, fields: Sequence[str],
                      op: str | None = None, change_key: str | None = None, remember: int = REMEMBER,
                      buckets: int | None = None) -> DataFrame:
    """``events`` with ``fields`` of the profile in force and ``profile_since``; NULL where there was none.

    ``changes`` has ``change_key`` (``key`` by default), ``change_ts``, ``seq`` and ``fields``; where ``op`` is
    "delete" the profile ends.  Changes without a key or a time take no part; events without a time see no profile.
    Of changes at one time those without ``seq`` are the first.  ``buckets`` is the number of groups of keys,
    fixed for the life of a checkpoint; without it every key is a group.
    """
    taken = {*fields, "profile_since"} & set(events.columns)
    if taken:
        raise ValueError(f"columns of the events that the profile would hide: {sorted(taken)}")
    profile = T.StructType([changes.schema[f] for f in fields])
    gone = f"{op} = 'delete'" if op else "false"
    own = changes.selectExpr(
        f"cast({change_key or key} as string) as profile_key", f"{CHANGE} as side", f"unix_micros(cast({change_ts} as timestamp)) as micros",
        f"coalesce(cast({seq} as long), {LEAST}) as seq", f"if({gone}, null, {payload.packed(profile)}) as payload") \
        .filter("profile_key is not null and micros is not null")
    asked = events.selectExpr(
        f"coalesce(cast({key} as string), '') as profile_key", f"{EVENT} as side",
        f"coalesce(unix_micros(cast({ts} as timestamp)), {LEAST}) as micros", "0L as seq",
        f"{payload.packed(events.schema)} as payload")
    schema = "payload array<string>, profile array<string>, since long"
    rows = own.unionByName(asked)
    if buckets:
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("profile_key"), F.lit(buckets)).cast("int"))
    out = rows.groupBy("bucket" if buckets else "profile_key").transformWithStateInPandas(ProfileState(remember), schema, "Append", "None")
    return out.selectExpr(*payload.unpacked(events.schema), *payload.unpacked(profile, "profile"), "timestamp_micros(since) as profile_since")
