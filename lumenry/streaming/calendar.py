"""Merging a stream of posts: placing them is a stateful operator, the events are a view over what it wrote.

Each calendar (a column: the account or act whose posts may be about the same events) is
a key of ``transformWithStateInPandas``. Its state is a map of faces by event, a map of event ids by
mark, the posts that wait, and the ids that were placed, so a post reads and writes the
events that it may be about and no others, and a batch costs what its posts cost. Each access to the state is a message
to another process, so a call reads and writes a key once, and waiting posts and ids are kept in packs. A post waits until
the watermark has passed it: a timer then places all that wait, in order of time. So the
events don't depend on how posts were split into batches, as long as no post is later than the watermark
allows; Spark drops such rows, which are for ``sync.backfill``.

What is placed is appended to a log. The events are ``fold.merged_fields`` over the posts and that log.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ..operators import fold as G
from ..operators import places as P

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROW = f"calendar string, at timestamp, post_id string, posted_at string, source_kind string, {P.FACE}, {P.KEYS}"
_NAMES = tuple(c.split()[0] for c in ROW.split(", "))
_OUT = tuple(c.split()[0] for c in G.PLACED.split(", "))
MOST, PACK, PART = 10000, 500, 256  # keys held at once, posts of a pack, ids of a part


class Held:
    """A map state, read and written once for each key that a call touches; what is held is written back beyond MOST keys."""

    def __init__(self, state):
        self._state, self._held, self._changed = state, {}, set()

    def get(self, *key):
        if key not in self._held:
            self._room()
            told = self._state.getValue(key)
            self._held[key] = None if told is None else json.loads(told[0])
        return self._held[key]

    def put(self, *key, value) -> None:
        self._room()
        self._held[key] = value
        self._changed.add(key)

    def _room(self) -> None:
        if len(self._held) >= MOST:
            self.flush()

    def flush(self) -> None:
        for key in self._changed:
            self._state.updateValue(key, (json.dumps(self._held[key]),))
        self._held, self._changed = {}, set()


class StoredFaces:
    """``places.Faces`` in the state store."""

    def __init__(self, faces, by_mark):
        self._faces, self._by_mark = Held(faces), Held(by_mark)

    def face(self, event: str) -> dict:
        return self._faces.get(event)

    def put(self, event: str, face: dict) -> None:
        self._faces.put(event, value=face)

    def marked(self, mark: str) -> list[str]:
        return self._by_mark.get(mark) or []

    def mark(self, mark: str, event: str) -> None:
        self._by_mark.put(mark, value=[*self.marked(mark), event])

    def unmark(self, mark: str, event: str) -> None:
        self._by_mark.put(mark, value=[e for e in self.marked(mark) if e != event])

    def flush(self) -> None:
        self._faces.flush()
        self._by_mark.flush()


class Seen:
    """The ids that were placed, dealt over so many parts that one holds about PART of them."""

    def __init__(self, state, n: int):
        self._state, self._parts, self._width = state, Held(state), self.width(n)

    @staticmethod
    def width(n: int) -> int:
        return 1 << (n // PART).bit_length()

    def add(self, post: str) -> bool:
        """Whether the id is new; it is held from now on."""
        part = zlib.crc32(post.encode()) % self._width
        ids = self._parts.get(part) or []
        if post in ids:
            return False
        self._parts.put(part, value=[*ids, post])
        return True

    def flush(self, n: int) -> None:
        """Writes what changed; once there are ``n`` ids, each part is dealt over its share of more parts."""
        self._parts.flush()
        before, self._width = self._width, self.width(n)
        for part in range(before if self._width > before else 0):
            dealt: dict[int, list[str]] = {}
            for post in self._parts.get(part) or []:
                dealt.setdefault(zlib.crc32(post.encode()) % self._width, []).append(post)
            for k in {part, *dealt}:
                self._state.updateValue((k,), (json.dumps(dealt.get(k, [])),))


class Placing(StatefulProcessor):
    """Posts wait in packs of one month, and the calendar has a timer at or before the first of them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.faces = StoredFaces(handle.getMapState("faces", "event string", "face string"), handle.getMapState("marks", "mark string", "events string"))
        self.waiting = handle.getMapState("waiting", "month string, first string, n long", "rows string")
        self.placed = handle.getMapState("placed", "part int", "posts string")
        self.count = handle.getValueState("count", "turn long, packs long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        packs, first = Packs(self.waiting, self.count), None
        for frame in rows:
            for row in frame.to_dict("records"):
                if row["post_id"] is None or pd.isna(row["at"]):
                    continue  # only moves the watermark
                packs.add({c: _plain(row[c]) for c in _NAMES if c not in ("calendar", "at")})
                at = _millis(row["at"])
                first = at if first is None else min(first, at)
        if first is not None:
            packs.flush()
            self.handle.registerTimer(first)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until, out, waits = timerValues.getCurrentWatermarkInMs(), [], None
        over = lambda at: bool(at) and _millis(pd.Timestamp(at)) > until
        months: dict[str, list[tuple]] = {}
        for k in sorted(tuple(k) for k in self.waiting.keys()):
            months.setdefault(k[0], []).append(k)
        packs = Packs(self.waiting, self.count)
        seen = Seen(self.placed, packs.turn)
        for month in sorted(months):
            first = min(k[1] for k in months[month])
            if over(first):
                waits = first
                break
            rows = []
            for k in months[month]:
                rows += json.loads(self.waiting.getValue(k)[0])
                self.waiting.removeKey(k)
            for row in sorted(rows, key=lambda r: (r["posted_at"] or "", r["post_id"])):
                if over(row["posted_at"]):
                    waits = waits or row["posted_at"]
                    packs.add(row)
                elif seen.add(row["post_id"]):
                    packs.turn += 1
                    told = P.place(self.faces, row | {"own": []}, packs.turn)
                    out.append({c: told.get(c) for c in _OUT} | {"post_id": row["post_id"], "turn": packs.turn, "known": False})
            if waits is not None:
                break
            if len(out) >= MOST:
                yield pd.DataFrame(out, columns=list(_OUT))
                out = []
        if months:
            self.faces.flush()
            seen.flush(packs.turn)
            packs.flush()
        if waits is not None:
            self.handle.registerTimer(_millis(pd.Timestamp(waits)))
        if out:
            yield pd.DataFrame(out, columns=list(_OUT))

    def close(self) -> None:
        pass


class Packs:
    """Posts that go on waiting, put together; and how many were placed (``turn``) and put together so far."""

    def __init__(self, waiting, count):
        self._waiting, self._count, self._rows = waiting, count, {}
        self.turn, self._n = count.get() or (0, 0)

    def add(self, row: dict) -> None:
        held = self._rows.setdefault((row["posted_at"] or "")[:7], [])
        held.append(row)
        if len(held) >= PACK:
            self._put((row["posted_at"] or "")[:7])

    def _put(self, month: str) -> None:
        rows = self._rows.pop(month)
        self._n += 1
        self._waiting.updateValue((month, min(r["posted_at"] or "" for r in rows), self._n), (json.dumps(rows),))

    def flush(self) -> None:
        for month in list(self._rows):
            self._put(month)
        self._count.update((self.turn, self._n))


def _millis(at) -> int:
    """The first whole millisecond that isn't before an instant."""
    return math.ceil(at.timestamp() * 1000)


def _plain(value):
    """A cell of pandas as JSON has it."""
    if hasattr(value, "tolist"):
        return value.tolist()
    return None if value is None or (not isinstance(value, list) and pd.isna(value)) else value


def place_stream(posts: DataFrame, calendar: Column, log: str, checkpoint: str, lateness: str = "30 days", words: tuple[str, ...] = (), acts: tuple[str, ...] = ()) -> StreamingQuery:
    """Places all posts (``fold.POST``, a stream) that are there, appends them to ``log`` (``fold.PLACED``), and ends; goes on where it stopped.

    ``posted_at`` is a text in ISO form in the session's zone; a row without a post_id
    counts as a sign that time has passed. A post without a time is taken as the oldest.
    """
    spark = posts.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    at = F.coalesce(F.to_timestamp("posted_at"), F.to_timestamp(F.lit("1970-01-02"))).alias("at")
    rows = G.with_keys(posts.withColumn("calendar", F.coalesce(calendar, F.lit(""))), words, acts).select("calendar", at, *[c for c in _NAMES if c not in ("calendar", "at")])
    kinds = StructType.fromDDL(G.PLACED)
    placed = rows.withWatermark("at", lateness).groupBy("calendar").transformWithStateInPandas(Placing(), kinds, "Append", "EventTime")
    return placed.writeStream.format("parquet").option("path", log).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def events_of(spark: SparkSession, posts: DataFrame, log: str, as_of: Column | str) -> DataFrame:
    """The events (``fold.EVENT``) of all posts that ``log`` has."""
    placed = spark.read.schema(G.PLACED).parquet(log)
    return G.merged_fields(G.distinct_posts(posts), placed, spark.createDataFrame([], G.EVENT), G.moment(as_of))
