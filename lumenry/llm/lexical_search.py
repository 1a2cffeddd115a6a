"""Exact ranked lexical search: every document against each item, by sort-based accumulation.

Documents are read once: a task looks up each word in the sorted terms of the items and
leaves a row (doc_id, n, terms, counts), a small part of the text. Counts over those rows
give N, L and df. Then each task concatenates the (item, document, impact) arrays of its
postings, sorts them by packed keys, 16 bits a pass, sums runs of equal keys, and keeps a
heap of the best ``k`` documents for each item. What tasks keep is dealt by ranges of
(item, score), so an item is cut into as many ranges as its candidates need, and ranked.

Items are taken in blocks of bounded size, one search each, so neither the terms that
are sent to tasks nor the heaps grow with the number of items.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B
from . import words as W

ITEM_BYTES, ITEM_ROWS = 4 << 20, 4096  # of a block of items
ENTRIES = 1 << 20  # (item, document, impact) entries that are sorted at once, unless one document has more
POSTINGS = "doc_id long, n long, terms array<int>, counts array<int>"
CANDIDATES = "item int, item_id long, doc_id long, score long"
RESULT = "item_id long, rank int, doc_id long, score long"
NO_ID = 2**63  # stands for a null id, after all others
#: Bytes between terms: ASCII but letters and digits. Bytes of other letters are part of a term.
SEPARATOR = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


class Terms:
    """The terms of a block of items: which items hold each, how often, and where a word of a text is among them."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        words = W.split(pa.array([t for _, t in items], pa.string()), lower=True, separator=SEPARATOR)
        held = words.bytes.tobytes()
        rows = Counter(zip((held[a:b] for a, b in zip(words.start, words.end, strict=True)), words.text_of().tolist(), strict=True))
        terms = sorted({t for t, _ in rows})
        at = {t: k for k, t in enumerate(terms)}
        entries = sorted((at[t], item, n) for (t, item), n in rows.items())
        self.ids = [i for i, _ in items]
        self.size = len(terms)
        self.item = np.array([e[1] for e in entries], np.int64)
        self.times = np.array([e[2] for e in entries], np.int64)
        self.first = np.searchsorted(np.array([e[0] for e in entries], np.int64), np.arange(self.size + 1))
        lengths = np.array([len(t) for t in terms], np.int64)
        self.bytes = np.frombuffer(b"".join(terms) + bytes(8), np.uint8)
        self.end = np.cumsum(lengths)
        self.start = self.end - lengths
        hashes = W.span_hashes(self.bytes, self.start, self.end)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def find(self, words: W.Words) -> tuple[np.ndarray, np.ndarray]:
        """(which words are terms, which terms they are); words of equal hash are compared byte by byte."""
        if not self.size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashes = words.hashes()
        place = np.minimum(np.searchsorted(self.hashes, hashes), self.size - 1)
        at = np.flatnonzero(self.hashes[place] == hashes)
        term = self.order[place[at]]
        same = words.end[at] - words.start[at] == self.end[term] - self.start[term]
        at, term = at[same], term[same]
        mine, theirs = (np.ndarray((len(x) - 7,), "<u8", x, 0, (1,)) for x in (words.bytes, self.bytes))
        length = self.end[term] - self.start[term]
        same = np.ones(len(at), bool)
        for k in range(0, int(length.max(initial=0)), 8):
            some = np.flatnonzero(length > k)
            gap = mine[words.start[at[some]] + k] ^ theirs[self.start[term[some]] + k]
            rest = np.minimum(length[some] - k, 8).astype(np.uint64)
            same[some] &= gap << ((np.uint64(8) - rest) * np.uint64(8)) == 0  # bytes past the word go
        return at[same], term[same]


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int | None, str | None]]]:
    """(id, text) of the items in blocks of ``ITEM_BYTES`` or ``ITEM_ROWS`` at most, unless one item is longer."""
    held, size = [], 0
    for row in items.toLocalIterator():
        long = len((row[1] or "").encode())
        if held and (size + long > ITEM_BYTES or len(held) == ITEM_ROWS):
            yield held
            held, size = [], 0
        held.append((row[0], row[1]))
        size += long
    if held:
        yield held


def _postings(terms: Terms):
    def run(batches):
        for batch in W.chunks(batches, "text"):
            words = W.split(batch.column("text"), lower=True, separator=SEPARATOR)
            at, term = terms.find(words)
            key, counts = np.unique(words.text_of()[at] * max(terms.size, 1) + term, return_counts=True)
            owner = key // max(terms.size, 1)
            offsets = pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (key % max(terms.size, 1), counts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words.counts.astype(np.int64)), *lists], names=["doc_id", "n", "terms", "counts"])

    return run


def radix_order(keys: np.ndarray, top: int) -> np.ndarray:
    """The stable sorting permutation of keys from 0 to ``top``: a radix sort, 16 bits a pass, lowest first."""
    order = np.arange(len(keys))
    for shift in range(0, max(top, 1).bit_length(), 16):
        digit = (keys >> shift).astype(np.uint16)
        order = order[np.argsort(digit[order], kind="stable")]
    return order


class Best:
    """A heap of the ``k`` best (score, document) of each item: high scores first, then small ids."""

    def __init__(self, items: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(items)]
        self.least = np.ones(items, np.int64)

    def add(self, item: np.ndarray, doc: list[int], score: np.ndarray) -> None:
        for k in np.flatnonzero(score >= self.least[item]):
            i, entry = int(item[k]), (int(score[k]), -doc[k])
            heap = self.heaps[i]
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            else:
                continue
            if len(heap) == self.k:
                self.least[i] = heap[0][0]


def _scored(terms: Terms, weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    fan = np.diff(terms.first)

    def add(best: Best, ids: list, first: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray) -> None:
        """Entries of some documents, whose postings begin at ``first``."""
        size = len(ids)
        doc = np.repeat(np.arange(size), np.diff(first))
        impact = weights[term] * ((10**9 * tf) // (1000 * tf + 12 * m[doc]))
        many = fan[term]
        ends = np.cumsum(many)
        entry = np.arange(ends[-1] if len(ends) else 0) + np.repeat(terms.first[term] - ends + many, many)
        keys = terms.item[entry] * size + np.repeat(doc, many)
        impacts = np.repeat(impact, many) * terms.times[entry]
        order = radix_order(keys, len(terms.ids) * size)
        keys = keys[order]
        runs = np.flatnonzero(np.diff(keys, prepend=-1))
        if len(runs):
            sums = np.add.reduceat(impacts[order], runs)
            item, which = np.divmod(keys[runs], size)
            best.add(item, [ids[d] for d in which.tolist()], sums)

    def run(batches):
        best = Best(len(terms.ids), k)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = [NO_ID if i is None else i for i in batch.column("doc_id").to_pylist()]
            m = 100 - 25 + (25 * batch.column("n").to_numpy() * n_docs) // max(n_terms, 1)
            lists = batch.column("terms")
            first = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
            term, tf = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "counts"))
            size = np.concatenate([[0], np.cumsum(fan[term])])[first]
            begin = 0
            while begin < len(ids):
                end = max(begin + 1, int(np.searchsorted(size, size[begin] + ENTRIES, "right")) - 1)
                a, b = first[begin], first[end]
                add(best, ids[begin:end], first[begin : end + 1] - a, term[a:b], tf[a:b], m[begin:end])
                begin = end
        rows = [(i, terms.ids[i], None if -d == NO_ID else -d, s) for i, heap in enumerate(best.heaps) for s, d in heap]
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=["item", "item_id", "doc_id", "score"])

    return run


def lexical_search(
    docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """The ``k`` highest-scoring documents of each item: item_id, rank (from 1), doc_id, score.

    Terms are the longest runs of ASCII letters and digits and of all other code points
    beyond ASCII, with only A-Z lower-cased. A term's weight is
    floor(1000 ln((2N + 2) / (2df + 1))), over the N documents that have a term; a document of n
    terms gets (10^9 tf) div (1000 tf + 12 m) of it, with m = 75 + (25 n N) div L and L the number of all
    terms. An item's repeated terms count as often as they stand there. Only scores above 0
    are ranked; equal ones by ascending doc_id, a null one last.

    Null and empty texts have no terms: such documents are never found and not counted in
    N, such items find nothing and have no row. Rows that repeat a doc_id are documents of
    their own, rows that repeat an item_id items of their own. Whole texts count, of any
    length; other columns, of any name, are not read. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    texts = W.small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    asked = items.select(F.col(item_id_col).cast("long"), F.col(item_text_col).cast("string"))
    out = None
    for block in item_blocks(asked):
        terms = Terms(block)
        postings = B.written(texts.mapInArrow(_postings(terms), POSTINGS))
        n_docs, n_terms = postings.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        frequency = np.zeros(terms.size, np.int64)
        for row in postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one row a term of the block at most
            frequency[row[0]] = row[1]
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in frequency.tolist()], np.int64)
        found = B.written(postings.mapInArrow(_scored(terms, weights, n_docs, n_terms, k), CANDIDATES))
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        dealt = found.repartitionByRange("item", *order)  # each range keeps k rows of an item at most, before they meet
        ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
        ranked = ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = ranked if out is None else out.unionByName(ranked)
    return spark.createDataFrame([], RESULT) if out is None else out
