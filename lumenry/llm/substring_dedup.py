"""Operator 2: removal of word windows that start earlier elsewhere, by level-wise doubling.

Windows of a short length are looked up first; only places where every such window is
repeated are extended to (at most) twice the length, until the full window length is
reached or no candidate survives. For the windows of full length that another block
holds too, the shards then find the smallest document, and answer each block whether it
holds that one.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import blocks as B
from . import words as W

OWNED = B.Extra("plain", 2)
RESULT = "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<start:int,end:int>>"


def lengths(window: int, least: int = 8) -> list[int]:
    """The levels: from ``window`` down by halves, shortest first; 20 gives 10, 20."""
    out = [window]
    while (out[0] + 1) // 2 >= least:
        out.insert(0, (out[0] + 1) // 2)
    return out


class _Block:
    """The windows of one block, level by level, as far as answers have come."""

    def __init__(self, table: pa.Table, levels: list[int]):
        self.ids = np.asarray(table["doc_id"].to_numpy())
        self.words = W.split(table["text"])
        self.levels, self.level = levels, 0
        self.hashes = self.words.hashes()
        self.sums = W.window_sums(self.hashes, levels[0])
        self.left = self.words.left()
        self.at = np.flatnonzero(self.left >= levels[0])
        self._order()

    def _order(self) -> None:
        self.known, self.order, self.runs = B.ordered_unique(W.spread(self.sums[self.at]))

    def extend(self, elsewhere: np.ndarray) -> None:
        """On to the next level, for places whose windows of this level are all repeated."""
        length, wider = self.levels[self.level], self.levels[self.level + 1]
        counts = np.diff(np.append(self.runs, len(self.order)))
        again = np.zeros(len(self.hashes) + wider + 1, bool)
        again[self.at[self.order]] = np.repeat(elsewhere.astype(bool) | (counts > 1), counts)
        total = np.concatenate([[0], np.cumsum(again)])
        span = wider - length + 1
        n = len(self.hashes)
        self.at = np.flatnonzero((total[span : span + n] - total[:n] == span) & (self.left >= wider))
        self.sums = W.widen(self.sums, length, wider, self.hashes)
        self.level += 1
        self._order()

    def asks(self, block: int, route: B.Route) -> pa.Table:
        return B.asks(block, self.known, route)

    def owners(self, block: int, route: B.Route, elsewhere: np.ndarray) -> pa.Table:
        """Of the windows that other blocks hold too: a second hash, and the smallest document of this block."""
        second = W.spread(W.window_sums(self.hashes, self.levels[-1], 1)[self.at]).view(np.int64)[self.order][self.runs]
        owner = self.ids[self.words.text_of()[self.at]][self.order]
        owner = np.minimum.reduceat(owner, self.runs) if len(owner) else owner
        asked = elsewhere.astype(bool)
        return B.asks(block, self.known[asked], route, OWNED, np.stack([second[asked], owner[asked]]))

    def removed(self, elsewhere: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The starts of windows that also start earlier. ``first``: of the windows ``elsewhere``, whether this block's document is the first."""
        holds_first = np.ones(len(self.known), bool)
        holds_first[elsewhere.astype(bool)] = first.astype(bool)
        counts = np.diff(np.append(self.runs, len(self.order)))
        texts = self.words.text_of()[self.at][self.order]
        ids = self.ids[texts]
        if not len(ids):
            return np.zeros(0, np.int64)
        least = np.repeat(np.minimum.reduceat(ids, self.runs), counts)
        # the order within a run is by position, so by text: the first of each text in the run starts first in it
        fresh = np.concatenate([[True], texts[1:] != texts[:-1]])
        fresh[self.runs] = True
        keep = np.repeat(holds_first, counts) & (ids == least) & fresh
        return self.at[self.order][~keep]


def _holds_first(keys: list[np.ndarray], owned: list[np.ndarray]) -> list[bytes]:
    """Bits: whether the block's smallest document of a window is the smallest of all."""
    key = np.concatenate(keys)
    second, doc = np.concatenate(owned, 1)
    order = np.lexsort((doc, second, key))
    first = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (second[order][1:] != second[order][:-1])])
    least = np.repeat(doc[order][first], np.diff(np.append(np.flatnonzero(first), len(order))))
    flags = np.empty(len(order), bool)
    flags[order] = doc[order] == least
    return [B.as_bits(x) for x in B.split_at(flags, keys)]


def substring_dedup(
    docs: DataFrame,
    window: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Sequence[str] = (),
    block_bytes: int = B.BLOCK_BYTES,
) -> DataFrame:
    """Removes each word in a window of ``window`` words whose word sequence also starts earlier.

    Earlier: in a document of smaller id, or at an earlier word of the same document;
    windows are those of the input. Returns doc_id, n_words, n_removed, kept_text (kept
    words joined by one space) and removed (word ranges, end exclusive), one row for
    each input row; with ``carry``, also those columns of the row, as the struct ``row``.

    Null and empty texts have no words: zero counts, an empty kept_text. Texts shorter
    than the window lose nothing. A null id stands before all others, as the smallest.
    Rows that repeat an id are judged one by one, and equal windows of two such rows
    don't make each other go. Other columns of ``docs``, of any name, are not read.
    An empty table gives an empty result. Very long texts make a block of their own.
    """
    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        *([F.struct(*[F.col(f"`{c}`") for c in carry]).cast(B.nullable(docs.select(*[F.col(f"`{c}`") for c in carry]).schema)).alias("row")] if carry else []),
    )
    held = B.write_blocks(texts, block_bytes)
    light = held.select("block", "doc_id", "text")
    route, levels = B.route(held), lengths(window)
    known = None
    for k in range(len(levels) + 1):
        last = k == len(levels)
        got = B.written(B.answer(_asks(light, known, levels, k, route), route, k, _holds_first if last else B.repeated, OWNED if last else None))
        known = got if known is None else known.unionByName(got)
    schema = StructType([*StructType.fromDDL(RESULT).fields, *(f for f in B.nullable(texts.schema).fields if f.name == "row")])
    return _cogrouped(held, known, _result(levels), schema)


def _least_id(table: pa.Table) -> pa.Table:
    """A null id as the smallest number."""
    return table.set_column(table.schema.get_field_index("doc_id"), "doc_id", pc.fill_null(table["doc_id"], -(2**63)))


def _cogrouped(held: DataFrame, known: DataFrame, run, schema: str | StructType) -> DataFrame:
    return held.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, schema)


def _replay(table: pa.Table, answers: pa.Table, levels: list[int], upto: int) -> _Block:
    block = _Block(_least_id(table), levels)
    for k in range(upto):
        block.extend(B.replies(answers, k, "bits"))
    return block


def _asks(held: DataFrame, known: DataFrame | None, levels: list[int], k: int, route: B.Route) -> DataFrame:
    def first(table: pa.Table) -> pa.Table:
        return _replay(table, None, levels, 0).asks(table["block"][0].as_py(), route)

    def later(table: pa.Table, answers: pa.Table) -> pa.Table:
        name = table["block"][0].as_py()
        if k < len(levels):
            return _replay(table, answers, levels, k).asks(name, route)
        return _replay(table, answers, levels, k - 1).owners(name, route, B.replies(answers, k - 1, "bits"))

    return held.groupBy("block").applyInArrow(first, B.ASK) if known is None else _cogrouped(held, known, later, B.ASK)


def _result(levels: list[int]):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        last = len(levels) - 1
        block = _replay(table, answers, levels, last)
        gone = W.covered(block.removed(B.replies(answers, last, "bits"), B.replies(answers, last + 1, "bits")), levels[-1], len(block.hashes))
        words = block.words
        edge = np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))
        # a run of removed words ends where its text ends
        split_at = np.zeros(len(gone) + 1, bool)
        split_at[words.first[:-1]] = True
        inner = split_at[:-1] & gone & np.concatenate([[False], gone[:-1]])
        begin = np.sort(np.concatenate([np.flatnonzero(edge == 1), np.flatnonzero(inner)]))
        end = np.sort(np.concatenate([np.flatnonzero(edge == -1), np.flatnonzero(inner)]))
        owner = np.searchsorted(words.first, begin, "right") - 1
        spans = pa.StructArray.from_arrays(
            [pa.array((x - words.first[owner]).astype(np.int32)) for x in (begin, end)], names=["start", "end"]
        )
        offsets = np.searchsorted(begin, words.first).astype(np.int32)
        carried = {"row": table["row"]} if "row" in table.column_names else {}
        return pa.table(
            {
                "doc_id": table["doc_id"],
                "n_words": pa.array(words.counts.astype(np.int64)),
                "n_removed": pa.array(W.per_text(gone, words.first)),
                "kept_text": W.joined(words, ~gone).cast(pa.string()),
                "removed": pa.ListArray.from_arrays(pa.array(offsets), spans),
                **carried,
            }
        )

    return run
