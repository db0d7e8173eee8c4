"""How often the stateful processors speak to their store: every access is a message, whatever its size."""

import random
import types

import pandas as pd
from pyspark.sql import Row

from riskloom.streaming import account_state, alert_state, profile_state

HOUR = account_state.HOUR


class Store:
    """States that count what is asked of them."""

    def __init__(self):
        self.asked = 0

    def registerTimer(self, at):
        pass

    def getMapState(self, *_):
        return Values(self)

    getValueState = getMapState


class Values:
    def __init__(self, store):
        self.store, self.held, self.of = store, None, {}

    def get(self):
        self.store.asked += 1
        return self.held

    def update(self, value):
        self.store.asked += 1
        self.held = value

    def iterator(self):
        self.store.asked += 1
        return iter(list(self.of.items()))

    def containsKey(self, key):
        self.store.asked += 1
        return key in self.of

    def getValue(self, key):
        self.store.asked += 1
        return self.of[key]

    def updateValue(self, key, value):
        self.store.asked += 1
        self.of[key] = value

    def removeKey(self, key):
        self.store.asked += 1
        self.of.pop(key, None)


def test_messages_of_an_account_do_not_grow_with_its_hours():
    store, state = Store(), account_state.AccountState()
    state.init(store)
    clock = types.SimpleNamespace(getCurrentWatermarkInMs=lambda: -1)
    for batch in range(3):
        rows = [Row(account_key="a", transaction_id=f"t{batch}-{i}", timed=True, micros=(batch * 40 + i) * HOUR, cents=100, device_id="d",
                    ip_city="c", counterparty_hash=f"p{i}", payload=["x"]) for i in range(40)]
        before = store.asked
        out = list(state.handleInputRows(("a",), iter([*rows, rows[0]]), clock))
        assert [r["count_24h"] for r in out][-1] == 25 and len(out) == 40
        assert store.asked - before <= 6


def test_messages_of_an_alert_do_not_grow_with_its_episodes():
    store, state = Store(), alert_state.AlertState(24, {"CREATE": "PENDING"})
    state.init(store)
    actions = pd.DataFrame({"micros": [i * 30 * HOUR for i in range(20)], "seq": range(20), "action": "CREATE", "assignee": None})
    out = pd.concat(state.handleInputRows(("a",), iter([actions]), None))
    assert store.asked <= 4 and out["kind"].tolist() == [alert_state.STATE]
    expired = types.SimpleNamespace(getExpiryTimeInMs=lambda: 60 * 3_600_000)
    escalated = pd.concat(state.handleExpiredTimer(("a",), None, expired))
    assert escalated["micros"].tolist() == [24 * HOUR, 54 * HOUR]
    again = types.SimpleNamespace(getExpiryTimeInMs=lambda: 90 * 3_600_000)
    assert pd.concat(state.handleExpiredTimer(("a",), None, again))["micros"].tolist() == [84 * HOUR]


def test_messages_of_a_bucket_do_not_grow_with_its_alerts():
    """Alerts of a bucket share its state and give the rows that they give alone."""
    rng = random.Random(3)
    names = [f"k{i}" for i in range(30)]
    kinds = ["CREATE", "ESCALATE", "PROCESSING", "RESOLVED", "CLOSED"]
    alone, shared = {n: (Store(), alert_state.AlertState(24, {"CREATE": "PENDING"})) for n in names}, (Store(), alert_state.BucketState(24, {"CREATE": "PENDING"}))
    for store, state in (*alone.values(), shared):
        state.init(store)
        store.timers = set()
        store.registerTimer = store.timers.add

    def rows(frames):
        return {tuple(None if v != v else v for v in r) for f in frames for r in f.itertuples(index=False)}

    def expire(store, state, key, watermark):
        out, clock = [], types.SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark)
        for at in sorted(t for t in store.timers if t <= watermark):
            out += state.handleExpiredTimer(key, clock, types.SimpleNamespace(getExpiryTimeInMs=lambda: at))
            store.timers.discard(at)
        return rows(out)

    escalated = 0
    for batch in range(4):
        frame = pd.DataFrame([(rng.choice(names), (batch * 60 + rng.randrange(70)) * HOUR, i, rng.choice(kinds), rng.choice(["x", "y"]))
                              for i in range(batch * 1000, batch * 1000 + 300)], columns=["alert_key", "micros", "seq", "action", "assignee"])
        before = shared[0].asked
        got = rows(shared[1].handleInputRows((0,), iter([frame]), None))
        assert shared[0].asked - before == 2 and len(shared[0].timers) <= 4
        assert got == {r for n, own in frame.groupby("alert_key") for r in rows(alone[n][1].handleInputRows((n,), iter([own]), None))}
        watermark = (batch * 60 + 65) * 3_600_000
        got = expire(*shared, (0,), watermark)
        assert got == {r for n in names for r in expire(*alone[n], (n,), watermark)}
        escalated += len(got)
    assert escalated > 20


def test_messages_of_profiles_do_not_grow_with_their_keys():
    """Keys that share a group share its state, not their versions or clocks; rows without a time move no clock."""
    store, state = Store(), profile_state.ProfileState()
    state.init(store)
    names = [f"k{i}" for i in range(40)]

    def rows(side, hour, payload):
        micros = [profile_state.NO_TIME if hour is None else (hour + i) * HOUR for i in range(40)]
        return pd.DataFrame({"profile_key": names, "side": side, "micros": micros, "seq": 0, "payload": [[payload(n)] for n in names]})

    for hour in (0, 200, 400):
        before = store.asked
        asked = pd.concat([rows(profile_state.EVENT, hour + 5, str), rows(profile_state.EVENT, hour - 1, str), rows(profile_state.EVENT, None, str)])
        out = pd.concat(state.handleInputRows((0,), iter([rows(profile_state.CHANGE, hour, lambda n: f"{n}-{hour}"), asked]), None))
        assert store.asked - before == 2
        assert out["profile"].tolist() == [[f"{n}-{hour}"] for n in names] + [
            [f"{n}-{hour - 200}"] if hour else None for n in names] + [None] * 40
    held = dict(zip([c.split()[0] for c in profile_state.HELD.split(", ")], state.versions.held))
    assert held["keys"] == names and len(held["clocks"]) == 3 * 40
    # the clocks are at 399 hours: of three versions a key, that of hour 200 is still seen by rows three days late
    assert [p[0] for p in held["profiles"]] == [f"{n}-{hour}" for n in names for hour in (200, 400)]
