"""Operator 1: license notices in documents.

The templates' word n-grams are winnowed to fingerprints in an inverted index (sorted
hashes with template and position; a few KB). Every n-gram of a document is looked up
there; hits of a template on neighbouring diagonals make a candidate, and a banded local
alignment of the words around it gives the matched share of the template and the span.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .license_templates import TEMPLATES

GRAM = 3
WINNOW = 4
# words are runs of letters, digits and bytes beyond ASCII
_BETWEEN = np.ones(256, bool)
_BETWEEN[48:58] = _BETWEEN[65:91] = _BETWEEN[97:123] = _BETWEEN[128:] = False
RESULT = (
    "doc_id long, template string, license string, matched_words long, template_words long, coverage double, "
    "start_word long, end_word long, start_char long, end_char long"
)


def winnowed(grams: np.ndarray, window: int = WINNOW) -> np.ndarray:
    """Positions of the least hash of every ``window`` consecutive n-grams (the last one of equals)."""
    if len(grams) <= window:
        return np.arange(len(grams))  # of a short notice all are kept, so a part of it is enough to find it
    out = set()
    for k in range(len(grams) - window + 1):
        part = grams[k : k + window][::-1]
        out.add(k + window - 1 - int(part.argmin()))
    return np.array(sorted(out))


@dataclass
class Index:
    names: list[str]
    licenses: list[str]
    words: list[np.ndarray]  # each template's word hashes
    hashes: np.ndarray  # sorted fingerprints
    template: np.ndarray
    position: np.ndarray


def index_of(templates: Mapping[str, tuple[str, str]]) -> Index:
    names = list(templates)
    words = W.split(pa.array([templates[n][1] for n in names], pa.string()), True, _BETWEEN)
    hashes = words.hashes()
    each = [hashes[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
    grams, template, position = [], [], []
    for k, x in enumerate(each):
        size = min(GRAM, len(x))
        sums = W.spread(W.window_sums(x, size), size)[: len(x) - size + 1] if size else np.zeros(0, np.uint64)
        at = winnowed(sums)
        grams.append(sums[at])
        template.append(np.full(len(at), k))
        position.append(at)
    grams, template, position = (np.concatenate(x) for x in (grams, template, position))
    order = np.argsort(grams, kind="stable")
    return Index(names, [templates[n][0] for n in names], each, grams[order], template[order], position[order].astype(np.int64))


def align(text: np.ndarray, template: np.ndarray, start: int, band: int) -> tuple[int, int, int]:
    """Banded local alignment around the diagonal that begins at ``start``: matched words, and the span in ``text``.

    A match counts 2, a word replaced, left out or put in counts -1.
    """
    m, width = len(template), 2 * band + 1
    rows = np.zeros((m + 1, width), np.int32)
    lanes = np.arange(width)
    for i in range(1, m + 1):
        at = start - band + i - 1 + lanes  # the text word of each lane
        inside = (at >= 0) & (at < len(text))
        same = inside & (text[np.clip(at, 0, len(text) - 1)] == template[i - 1])
        row = np.maximum(rows[i - 1] + np.where(same, 2, -1), np.append(rows[i - 1][1:], 0) - 1)
        row = np.where(inside, np.maximum(row, 0), 0)
        rows[i] = np.maximum(row, np.maximum.accumulate(row + lanes) - lanes)  # words put in: a running maximum
        rows[i][~inside] = 0
    i, lane = np.unravel_index(int(rows.argmax()), rows.shape)
    end = first = start - band + int(i) + int(lane)
    matched = 0
    while i > 0 and rows[i, lane] > 0:
        at = start - band + i - 1 + lane
        value = rows[i, lane]
        same = 0 <= at < len(text) and text[at] == template[i - 1]
        if value == rows[i - 1, lane] + (2 if same else -1):
            matched += same
            first, i = at, i - 1
        elif lane + 1 < width and value == rows[i - 1, lane + 1] - 1:
            i, lane = i - 1, lane + 1
        elif lane > 0 and value == rows[i, lane - 1] - 1:
            lane -= 1
        else:
            break
    return int(matched), int(first), int(end)


def matches(text: np.ndarray, at: np.ndarray, template: np.ndarray, position: np.ndarray, index: Index, least: float):
    """(template, matched, start, end) in one document's words, from its hits; of overlapping ones of a template, the best.

    Exact places are taken first. Hits outside of them are grouped and aligned again, on
    the words that no place has taken, until each hit is in a place or its diagonal failed.
    """
    for k in np.unique(template):
        words = index.words[k]
        m, band = len(words), max(4, len(words) // 8)
        mine = template == k
        hits, starts = at[mine], (at - position)[mine]
        taken: list[tuple[int, int]] = []
        free = np.isin(text, words)  # words that may match and that no place has taken
        for start in np.unique(starts):
            if 0 <= start <= len(text) - m and (not taken or start >= taken[-1][1]) and (text[start : start + m] == words).all():
                taken.append((int(start), int(start) + m))
                free[start : start + m] = False
                yield k, m, int(start), int(start) + m
        left = free[hits]
        hits, starts = hits[left], starts[left]
        masked = None
        while len(hits):
            sums = np.concatenate([[0], np.cumsum(free)])
            low, high = np.clip(starts - band, 0, len(text)), np.clip(starts + m + band, 0, len(text))
            may = sums[high] - sums[low] >= least * m
            hits, starts = hits[may], starts[may]
            if not len(hits):
                break
            if masked is None:
                masked, none = text.copy(), np.setdiff1d(np.arange(m + 1, dtype=text.dtype), words)[0]
            masked[~free] = none
            order = np.sort(starts)
            tried = np.array([group[len(group) // 2] for group in np.split(order, np.flatnonzero(np.diff(order) > band) + 1)])
            found = [align(masked, words, int(start), band) for start in tried]
            for matched, first, end in sorted(found, key=lambda x: (-x[0], x[1])):
                if matched >= least * m and all(end <= a or first >= b for a, b in taken):
                    taken.append((first, end))
                    free[first:end] = False
                    yield k, matched, first, end
            left = free[hits] & ~np.isin(starts, tried)
            hits, starts = hits[left], starts[left]


def license_scan(
    docs: DataFrame, templates: Mapping[str, tuple[str, str]] = TEMPLATES, least: float = 0.75, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Each place where at least ``least`` of a template's words stand in order: one row for a place and template.

    Spans are in words (runs of letters and digits) and in characters, end exclusive;
    coverage is matched_words / template_words. ``templates`` maps a name to license and
    notice; they are sent to every task, so their number is what memory bounds. A place
    may match several templates. Null, empty and unmatched texts give no rows; repeated
    rows give their rows again; an empty table gives an empty result. Whole texts of any
    length are read, and no other columns.
    """
    index = index_of(templates)

    def run(batches):
        for batch in W.chunks(batches, "text", 8 << 20):
            words = W.split(batch.column("text"), True, _BETWEEN)
            hashes, owner, left = words.hashes(), words.text_of(), words.left()
            hits = []
            for size in range(1, GRAM + 1):  # shorter grams are those of templates shorter than GRAM
                if size < GRAM and not any(len(x) == size for x in index.words):
                    continue
                at = np.flatnonzero(left >= size)
                sums = W.spread(W.window_sums(hashes, size)[at], size)
                low, high = np.searchsorted(index.hashes, sums), np.searchsorted(index.hashes, sums, "right")
                some = np.flatnonzero(high > low)
                for k in range(int((high - low).max(initial=0))):
                    more = some[high[some] - low[some] > k]
                    hits.append(np.stack([at[more], low[more] + k]))
            if not hits or not sum(h.shape[1] for h in hits):
                continue
            place, entry = np.concatenate(hits, 1)
            order = np.argsort(owner[place], kind="stable")
            place, entry = place[order], entry[order]
            texts, begins = np.unique(owner[place], return_index=True)
            characters = np.concatenate([[0], np.cumsum((words.bytes[:-8] & 0xC0) != 0x80)])
            ids = batch.column("doc_id")
            out = []
            for text, a, b in zip(texts, begins, [*begins[1:], len(place)], strict=True):
                first, end = words.first[text], words.first[text + 1]
                for k, matched, start, stop in matches(hashes[first:end], place[a:b] - first, index.template[entry[a:b]], index.position[entry[a:b]], index, least):
                    base = characters[words.text_at[text]]
                    n = len(index.words[k])
                    out.append((
                        ids[int(text)].as_py(), index.names[k], index.licenses[k], matched, n, matched / n, start, stop,
                        int(characters[words.start[first + start]] - base), int(characters[words.end[first + stop - 1]] - base),
                    ))
            names = [x.split()[0] for x in RESULT.split(", ")]
            kinds = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(len(names))], names=names)

    return W.small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, RESULT)
