"""The placing of a stream asks the state store a few times a calendar, not several times a post."""

from __future__ import annotations

import random
from collections import Counter

import pandas as pd

from lumenry.operators import places as P
from lumenry.streaming import calendar


class Map:
    def __init__(self, calls):
        self.held, self.calls = {}, calls

    def _count(self, name):
        self.calls[name] += 1

    def keys(self):
        self._count("keys")
        return iter(list(self.held))

    def containsKey(self, k):
        self._count("contains")
        return k in self.held

    def getValue(self, k):
        self._count("get")
        return self.held.get(k)

    def updateValue(self, k, v):
        self._count("put")
        self.held[k] = v

    def removeKey(self, k):
        self._count("remove")
        self.held.pop(k, None)


class Value:
    def __init__(self, calls):
        self.held, self.calls = None, calls

    def exists(self):
        self.calls["exists"] += 1
        return self.held is not None

    def get(self):
        self.calls["get"] += 1
        return self.held

    def update(self, v):
        self.calls["put"] += 1
        self.held = v


class Handle:
    def __init__(self):
        self.calls, self.timers = Counter(), set()

    def getMapState(self, *_):
        return Map(self.calls)

    def getValueState(self, *_):
        return Value(self.calls)

    def registerTimer(self, at):
        self.calls["timer"] += 1
        self.timers.add(at)


class Until:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def row(k, at, name="Night"):
    told = dict.fromkeys(calendar._NAMES) | {"calendar": "c", "at": pd.Timestamp(at), "post_id": f"{k:05d}", "posted_at": at, "source_kind": "ticket_update", "event_dates": [], "k_name": name, "k_alias": name, "k_venue": "", "k_url": "u", "rich": 5}
    return told | {"event_name": name, "event_date": "2030-01-01", "ticket_url": "u"}


def run(batches):
    """Turns of posts by (rows, watermark) batches; timers run as Spark runs them. Also the handle."""
    handle, placing, told = Handle(), calendar.Placing(), []
    placing.init(handle)
    for rows, until in batches:
        if rows:
            list(placing.handleInputRows(("c",), iter([pd.DataFrame(rows)]), Until(until)))
        for t in sorted(t for t in handle.timers if t <= until):
            handle.timers.discard(t)
            told += [r for df in placing.handleExpiredTimer(("c",), Until(until), t) for r in df.to_dict("records")]
    return told, handle


def ms(at):
    return int(pd.Timestamp(at).timestamp() * 1000)


def test_a_calendar_costs_few_calls():
    rows = [row(k, f"2026-0{1 + k % 3}-{1 + k % 28:02d}T00:00:00.{k:06d}") for k in range(600)]
    told, handle = run([(rows[::2], 0), (rows[1::2], 0), ([], ms("2027-01-01"))])
    assert [r["post_id"] for r in told] == [r["post_id"] for r in sorted(rows, key=lambda r: (r["posted_at"], r["post_id"]))]
    assert [r["turn"] for r in told] == list(range(1, 601)) and {r["event_id"] for r in told} == {"00000"}
    assert sum(handle.calls.values()) < 100


def test_posts_wait_and_are_placed_once(monkeypatch):
    """Batches of any order, watermarks between them, posts that come again, parts and packs of a few."""
    for name, value in (("MOST", 3), ("PACK", 4), ("PART", 5)):
        monkeypatch.setattr(calendar, name, value)
    rng = random.Random(4)
    rows = [row(k, f"2026-{rng.randrange(1, 13):02d}-{rng.randrange(1, 28):02d}T10:00:00.{k:06d}", rng.choice(["Night", "Gala", "Parade"])) for k in range(200)]
    rows += [rows[k] | {"posted_at": "2026-12-30T00:00:00", "at": pd.Timestamp("2026-12-30")} for k in range(0, 200, 9)]
    rows.sort(key=lambda r: r["at"])
    batches, k = [], 0
    while k < len(rows):
        some = rows[k : k + 25]
        rng.shuffle(some)
        batches += [(some + rng.sample(rows[: k + 1], min(k, 3)), ms(min(r["posted_at"] for r in rows[k : k + 25])) - 1), ([], ms(rows[min(k + 12, len(rows) - 1)]["posted_at"]) + 1)]
        k += 25
    told, handle = run([*batches, ([], ms("2027-02-01"))])
    faces, want = P.Faces(), []
    seen = set()
    for r in sorted(rows, key=lambda r: (r["posted_at"], r["post_id"])):
        if r["post_id"] not in seen:
            seen.add(r["post_id"])
            want.append((r["post_id"], P.place(faces, r | {"own": []}, len(seen))["event_id"], len(seen)))
    assert [(r["post_id"], r["event_id"], r["turn"]) for r in told] == want
    assert not any(t <= ms("2027-02-01") for t in handle.timers)
