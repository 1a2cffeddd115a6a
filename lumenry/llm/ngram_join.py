"""Operator 10: Jaccard self-join on word n-grams, as a blocked product of the document by n-gram incidence.

1. Each block of documents learns how many documents hold each of its n-grams. An n-gram
   of one document can't be shared, so a document with too many of those is linked to none.
2. Documents of equal sets become one row of the matrix. A row is entered under its
   rarest n-grams only, as many as its size leaves for a pair that reaches the threshold.
3. Rows that meet under an n-gram form groups; rows of a group are dealt to cells of
   bounded size, and two cells are multiplied if they meet under an n-gram. In a product,
   pairs whose sizes alone forbid a link are left out, overlap counts are added up column
   block by column block, and what leaves the task is a spanning forest of the links and
   each row's number of links, not the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import words as W
from .graph import components

CELL = 128  # rows of a cell; a row of many n-grams counts as several
CELL_NGRAMS = 2000
COLUMNS = 4096
_SETS = "doc_id long, n_shingles long, k1 long, k2 long, singles long, ngrams binary"
_LINKS = "node long, other long, links long"


class _Sets:
    """The distinct n-grams of each text of a block, text by text, and how many texts of the block hold each."""

    def __init__(self, table: pa.Table, n: int):
        words = W.split(table["text"], lower=True)
        hashes, counts, owner = words.hashes(), words.counts, words.text_of()
        full = np.flatnonzero(words.left() >= n)
        parts, owners = [W.spread(W.window_sums(hashes, n)[full])], [owner[full]]
        for k in range(1, n):  # shorter texts: all their words as one
            of = np.flatnonzero(counts == k)
            parts.append(W.spread(W.window_sums(hashes, k)[words.first[of]], k))
            owners.append(of)
        values, owner = np.concatenate(parts), np.concatenate(owners)
        order = np.lexsort((values, owner))
        values, owner = values[order], owner[order]
        keep = np.ones(len(values), bool)
        keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
        self.values, self.owner = values[keep], owner[keep]
        self.first = np.searchsorted(self.owner, np.arange(len(counts) + 1))
        self.known, _, runs = B.ordered_unique(self.values)
        self.held = np.diff(np.append(runs, len(self.values)))


def _add_up(keys: list[np.ndarray], held: list[np.ndarray]) -> list[bytes]:
    """How many texts of all blocks hold each key, less one: most have one."""
    all_keys, counts = np.concatenate(keys), np.concatenate(held, 1)[0]
    order = np.argsort(all_keys, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], all_keys[order][1:] != all_keys[order][:-1]]))
    sums = np.add.reduceat(counts[order] + 1, first)
    out = np.empty(len(order), np.int64)
    out[order] = np.minimum(np.repeat(sums, np.diff(np.append(first, len(order)))) - 1, 2**32 - 1)
    return [B.sparse(x) for x in B.split_at(out, keys)]


def _needed(n, percent: int):
    """The least overlap of a set of ``n`` with any set it is linked with."""
    return -(-percent * n // 100)


def _ordered_sets(n: int, percent: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        sets = _Sets(table, n)
        total = B.replies(answers, 0, "sparse") + 1
        of = total[np.searchsorted(sets.known, sets.values)] if len(sets.values) else np.zeros(0, np.int64)
        order = np.lexsort((sets.values, of, sets.owner))
        values, counts = sets.values[order], of[order]
        size = np.diff(sets.first)
        singles = W.per_text(counts == 1, sets.first)
        keys = []
        for salt in (1, 2):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(W.spread(values, salt))])
            keys.append((sums[sets.first[1:]] - sums[sets.first[:-1]]).view(np.int64))
        ids = table["doc_id"].combine_chunks()
        linked = (size > 0) & (size - singles >= _needed(size, percent)) & ~np.asarray(ids.is_null())
        ngrams = [values[a + s : b].tobytes() if x else None for a, s, b, x in zip(sets.first, singles, sets.first[1:], linked)]
        return pa.table(
            {"doc_id": ids, "n_shingles": pa.array(size), "k1": pa.array(keys[0]), "k2": pa.array(keys[1]), "singles": pa.array(singles), "ngrams": pa.array(ngrams, pa.binary())}
        )

    return run


def _postings(rows: DataFrame, percent: int) -> DataFrame:
    """(ngram, node) for the n-grams under which a row is entered: any partner shares one of them."""

    def run(batches):
        for batch in batches:
            held = [np.frombuffer(x, np.int64) for x in batch.column("ngrams").to_pylist()]
            n = batch.column("n_shingles").to_numpy()
            first = n - _needed(n, percent) + 1 - batch.column("singles").to_numpy()
            parts = [x[: max(0, k)] for x, k in zip(held, first)]
            nodes = np.repeat(batch.column("node").to_numpy(), [len(p) for p in parts])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)), pa.array(nodes)], names=["ngram", "node"])

    return rows.select("node", "n_shingles", "singles", "ngrams").mapInArrow(run, "ngram long, node long")


def overlaps(sets: list[np.ndarray], size: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which rows of ``left`` and ``right`` (indices) are linked: sparse columns, multiplied block by block.

    Both sides are taken in order of size; a strip of rows is multiplied only with the
    rows that are not too large or too small for it.
    """
    column = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    new = np.concatenate([[True], column[1:] != column[:-1]])
    group = np.cumsum(new) - 1
    shared = np.bincount(group)[group] > 1
    row = row[shared]
    group = np.cumsum(np.concatenate([[True], np.diff(group[shared]) != 0])) - 1 if len(row) else group[:0]
    left, right = left[np.argsort(size[left], kind="stable")], right[np.argsort(size[right], kind="stable")]
    strips = []
    for a in range(0, len(left), 32):
        rows = left[a : a + 32]
        low, high = size[rows[0]] * percent / 100, size[rows[-1]] * 100 / percent
        b, c = np.searchsorted(size[right], [low - 1, high + 1])
        if b < c:
            strips.append((a, a + len(rows), b, c))
    total = np.zeros((len(left), len(right)), np.float32)
    for begin in range(0, int(group[-1]) + 1 if len(group) else 0, COLUMNS):
        p, q = np.searchsorted(group, [begin, begin + COLUMNS])
        block = np.zeros((len(sets), COLUMNS), np.float32)
        block[row[p:q], group[p:q] - begin] = 1
        x, y = block[left], block[right]
        for a, b, c, d in strips:
            total[a:b, c:d] += x[a:b] @ y[c:d].T
    union = size[left][:, None] + size[right][None, :] - total
    linked = np.zeros((len(sets), len(sets)), bool)
    linked[np.ix_(left, right)] = (100 * total >= percent * union) & (total > 0)
    return linked


def _product(percent: int):
    def run(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, np.uint64) for x in table["ngrams"].to_pylist()]
        size, side = table["n_shingles"].to_numpy(), table["side"].to_numpy()
        node, copies = table["node"].to_numpy(), table["copies"].to_numpy()
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1)
        linked = overlaps(sets, size, left, right if len(right) else left, percent)
        np.fill_diagonal(linked, False)
        linked |= linked.T
        label = np.argsort(np.argsort(node))
        by_label = np.sort(node)
        while True:  # the least label of a row and its partners, until nothing changes
            least = np.minimum(label, np.where(linked, label[None, :], len(label)).min(1))
            if (least == label).all():
                break
            label = least
        links = linked @ copies
        use = links > 0
        return pa.table({"node": pa.array(node[use]), "other": pa.array(by_label[label[use]]), "links": pa.array(links[use])})

    return run


def _cells(rows: DataFrame, postings: DataFrame, grouped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each row's cell, and the pairs of cells to multiply.

    Small groups are packed together. A large group's rows are dealt by their rarest
    n-gram, and a part that still is too large by a hash of the row.
    """
    weight = F.greatest(F.lit(1), F.ceil(F.col("n_shingles") / CELL_NGRAMS))
    held = rows.join(grouped, "node").select("node", "component", weight.alias("weight"), F.xxhash64(F.substring("ngrams", 1, 8)).alias("near"))
    sizes = held.groupBy("component").agg(F.sum("weight").alias("size"))
    small = sizes.filter(F.col("size") <= CELL).agg(F.sum("size")).first()[0] or 0
    packs = max(1, -(-small // CELL))
    held = held.join(sizes, "component").withColumn(
        "part",
        F.when(F.col("size") <= CELL, F.xxhash64(F.lit(0), F.pmod(F.xxhash64("component"), F.lit(packs))))
        .otherwise(F.xxhash64(F.lit(1), "component", F.pmod("near", F.ceil(F.col("size") / CELL)))),
    )
    parts = held.groupBy("part").agg(F.sum("weight").alias("held"))
    cell = F.xxhash64("part", F.when((F.col("size") > CELL) & (F.col("held") > 2 * CELL), F.pmod(F.xxhash64("node"), F.ceil(F.col("held") / CELL))).otherwise(0))
    dealt = B.written(held.join(parts, "part").select("node", cell.alias("cell"), (F.col("size") > CELL).alias("large")))
    met = postings.join(dealt.filter("large"), "node").select("ngram", "cell").distinct()
    several = met.groupBy("ngram").agg(F.count("*").alias("n")).filter("n > 1").select("ngram")
    met = met.join(several, "ngram")
    cross = met.join(met.withColumnRenamed("cell", "other"), "ngram").filter("cell < other").select("cell", "other").distinct()
    own = dealt.select("cell", F.col("cell").alias("other")).distinct()
    return dealt, own.unionByName(cross)


def ngram_join(
    docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = B.BLOCK_BYTES
) -> DataFrame:
    """Documents linked by the Jaccard similarity of their sets of ``n``-word shingles.

    Words are lower-cased A-Z. A text of fewer than ``n`` words is one shingle. Two
    documents are linked when 100 * overlap >= ``percent`` * union. Returns doc_id,
    n_shingles, component_id (the smallest doc_id that links reach) and n_links (the number
    of other rows it is linked with), one row for each input row.

    Null and empty texts, and rows of a null id, are linked with nothing; a null id has a
    null component. Repeated rows are linked with each other. Other columns are not read.
    An empty table gives an empty result. Every pair that can reach the threshold is
    counted; there is no cap on partners or on n-grams of any frequency.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = B.write_blocks(texts, block_bytes)
    route, held_by = B.route(held), B.Extra("sparse")

    def ask(table: pa.Table) -> pa.Table:
        sets = _Sets(table, n)
        return B.asks(table["block"][0].as_py(), sets.known, route, held_by, sets.held - 1)

    answers = B.answer(held.groupBy("block").applyInArrow(ask, B.ASK), route, 0, _add_up, held_by)
    sets = B.written(held.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_ordered_sets(n, percent), _SETS))
    key = ["n_shingles", "k1", "k2"]
    may = sets.filter("ngrams is not null")
    equal = may.groupBy(*key).agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies"))
    one = equal.join(may.select(F.col("doc_id").alias("least_id"), *key, "singles", "ngrams"), ["least_id", *key]).dropDuplicates(key)
    rows = B.written(one.withColumn("node", F.monotonically_increasing_id()))  # of the set: different sets may have one smallest id
    postings = B.written(_postings(rows, percent))
    least = postings.groupBy("ngram").agg(F.min("node").alias("least"), F.count("*").alias("n")).filter("n > 1")
    star = postings.join(least, "ngram").filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    dealt, pairs = _cells(rows, postings, components(star))
    pair = F.xxhash64("cell", "other").alias("pair")
    sides = pairs.select(pair, F.lit(0).alias("side"), "cell").unionByName(
        pairs.filter("cell <> other").select(pair, F.lit(1).alias("side"), F.col("other").alias("cell"))
    )
    factors = sides.join(dealt.select("node", "cell"), "cell").join(rows.select("node", "n_shingles", "copies", "ngrams"), "node")
    found = B.written(factors.groupBy("pair").applyInArrow(_product(percent), _LINKS))
    linked = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    of_set = (
        rows.join(linked, "node", "left").join(counts, "node", "left")
        .select(*key, "least_id", F.coalesce("component", "node").alias("component"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    least_ids = of_set.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_set = of_set.join(least_ids, "component").select(*key, "component_id", "n_links")
    alone = sets.filter("ngrams is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return may.join(of_set, key).select("doc_id", "n_shingles", "component_id", "n_links").unionByName(alone)
