"""Operator 3: quality by the perplexity of an interpolated modified Kneser-Ney model of trusted text.

The model is of order two over lower-cased words. Its counts never become a table of
their own: blocks of documents ask shards of hashed n-grams, sending along how often
their trusted documents hold each; a shard adds up and answers every block that asked.
One round does so for word pairs. In the second, each pair's owner (the first block with
a trusted occurrence) adds it to the types of its first word and of its second, which
gives the words' context and continuation counts. So training and scoring are two
sharded count joins, and what they move grows with the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B
from . import words as W

TRUSTED = -1  # the round under which a block learns which of its documents it is trained on
STEPS = 1000  # of the logarithm of a perplexity; thresholds are exact to one of them
BLOCK_BYTES = 2 * B.BLOCK_BYTES  # larger blocks hold fewer distinct pairs in all
FOLDS = 5  # one in so many trusted documents is left out of training, for the thresholds
#: As context: occurrences, and types seen once, twice, more often; as a continuation: types before it.
PLANES = 5
ONE, ALL = B.Extra("sparse"), B.Extra("sparse", PLANES)
SCORED = "doc_id long, lang string, n_words long, perplexity double"


class _Pairs:
    """Words and word pairs of a block, and their counts in the trusted documents."""

    def __init__(self, table: pa.Table, known: pa.Table):
        self.words = W.split(table["text"], lower=True)
        self.hashes = self.words.hashes()
        self.owner = self.words.text_of()
        trusted = known.filter(pa.compute.equal(known["round"], TRUSTED))
        ids = np.frombuffer(b"".join(trusted["reply"].to_pylist()), "<i8")
        held = np.isin(table["doc_id"].fill_null(-(2**63)).to_numpy(), ids)[self.owner] if len(self.owner) else np.zeros(0, bool)
        self.at = np.flatnonzero(self.words.left() >= 2)  # the first words of pairs
        self.pairs, order, runs = B.ordered_unique(W.spread(W.window_sums(self.hashes, 2)[self.at]))
        self.counts = np.add.reduceat(held[self.at][order].astype(np.int64), runs) if len(runs) else np.zeros(0, np.int64)
        self.of_pair = np.empty(len(self.at), np.int64)
        self.of_pair[order] = np.repeat(np.arange(len(runs)), np.diff(np.append(runs, len(order))))
        first = self.at[order[runs]] if len(runs) else np.zeros(0, np.int64)
        self.vocabulary, order, runs = B.ordered_unique(W.mix(self.hashes))
        self.of_word = np.empty(len(self.hashes), np.int64)
        self.of_word[order] = np.repeat(np.arange(len(runs)), np.diff(np.append(runs, len(order))))
        self.left, self.right = self.of_word[first], self.of_word[first + 1] if len(first) else first

    def types(self, answers: np.ndarray) -> np.ndarray:
        """The planes of this block's words, from its own occurrences and the pairs that it owns."""
        total, owned = answers >> 1, (answers & 1).astype(bool)
        n = len(self.vocabulary)
        planes = np.zeros((PLANES, n), np.int64)
        planes[0] = np.bincount(self.left, self.counts, n)
        for k, chosen in ((1, total == 1), (2, total == 2), (3, total > 2), (4, total > 0)):
            planes[k] = np.bincount((self.right if k == 4 else self.left)[chosen & owned], minlength=n)
        return planes


def _shared(keys: list[np.ndarray], sent: list[np.ndarray], mark: int) -> list[bytes]:
    """Adds up the values of each key over all blocks; row ``mark`` is doubled, plus one for the key's owner."""
    all_keys = np.concatenate(keys)
    values = np.concatenate(sent, 1)
    order = np.argsort(all_keys, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], all_keys[order][1:] != all_keys[order][:-1]]))
    runs = np.diff(np.append(first, len(order)))
    sums = np.repeat(np.add.reduceat(values[:, order], first, 1), runs, 1)
    has = values[mark][order] > 0
    rank = np.cumsum(has) - np.repeat((np.cumsum(has) - has)[first], runs)
    sums[mark] = 2 * sums[mark] + (has & (rank == 1))
    out = np.empty(values.shape, np.int64)
    out[:, order] = sums
    return [B.sparse(x) for x in B.split_at(out, keys)]


def _tally(answers: DataFrame, round_: int, rows: int, mark: int) -> tuple[list[int], int, int]:
    """Of all keys, each counted once: how many have the values 1, 2, 3, 4; how many are over 0; and the sum."""

    def run(batches):
        total = np.zeros(6, np.int64)
        for batch in batches:
            for held in batch.column("reply").to_pylist():
                for part in B.frames(held):
                    x = B.dense(part, rows)[mark]
                    x = x[x & 1 == 1] >> 1
                    total += [*((x == k).sum() for k in (1, 2, 3, 4)), (x > 0).sum(), x.sum()]
        yield pa.RecordBatch.from_arrays([pa.array([int(v)]) for v in total], names=list("abcdef"))

    got = answers.filter(F.col("round") == round_).select("reply").mapInArrow(run, "a long, b long, c long, d long, e long, f long")
    row = [int(v or 0) for v in got.agg(*[F.sum(c) for c in "abcdef"]).first()]
    return row[:4], row[4], row[5]


def discounts(n: list[int]) -> np.ndarray:
    """D for counts 0, 1, 2 and 3 or more (Chen and Goodman), from the counts of counts; within [0, count]."""
    n1, n2, n3, n4 = (max(x, 1e-9) for x in n)
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0, *(min(max(d, 0.0), k - 0.05) for k, d in zip((1, 2, 3), raw, strict=True))])


def log_probabilities(pair, context, continuation, pair_discounts, word_discounts, words: tuple[list[int], int, int]) -> np.ndarray:
    """log P of words after their predecessors. pair: counts; context: planes 0 to 3; continuation: types before the word.

    ``words``: the tally of continuation counts. A pair without a known context, and a text's
    first word, have the probability of the continuation alone.
    """
    counts, vocabulary, types = words
    more = vocabulary - counts[0] - counts[1]
    free = word_discounts[1] * counts[0] + word_discounts[2] * counts[1] + word_discounts[3] * more
    low = (continuation - word_discounts[np.minimum(continuation, 3)] + free / (vocabulary + 1)) / max(types, 1) if types else np.ones(len(continuation))
    high = pair - pair_discounts[np.minimum(pair, 3)] + (pair_discounts[1] * context[1] + pair_discounts[2] * context[2] + pair_discounts[3] * context[3]) * low
    return np.log(np.where(context[0] > 0, high / np.maximum(context[0], 1), low))


def perplexities(docs: DataFrame, trusted: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, lang, n_words and perplexity (null without words) of docs (doc_id, text, lang), by a model of the ids in ``trusted``."""
    held = B.write_blocks(docs, block_bytes)
    route = B.route(held)
    ids = held.select("block", "doc_id").join(trusted.select("doc_id").distinct(), "doc_id").groupBy("block").agg(F.collect_list("doc_id").alias("ids"))

    def bytes_of(batches):
        for batch in batches:
            reply = [np.array(x, "<i8").tobytes() for x in batch.column("ids").to_pylist()]
            n = len(reply)
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array([TRUSTED] * n, pa.int32()), pa.array([0] * n, pa.int64()), pa.array(reply, pa.binary())], names=["block", "round", "part", "reply"])

    known = B.written(ids.mapInArrow(bytes_of, B.ANSWER))
    blocks = held.select("block", "doc_id", "text")

    def ask_pairs(table: pa.Table, known: pa.Table) -> pa.Table:
        x = _Pairs(table, known)
        return B.asks(table["block"][0].as_py(), x.pairs, route, ONE, x.counts)

    def ask_words(table: pa.Table, known: pa.Table) -> pa.Table:
        x = _Pairs(table, known)
        return B.asks(table["block"][0].as_py(), x.vocabulary, route, ALL, x.types(B.replies(known, 0, "sparse")))

    def cogrouped(run, known: DataFrame, schema: str, of: DataFrame = blocks) -> DataFrame:
        return of.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, schema)

    pairs = B.written(B.answer(cogrouped(ask_pairs, known, B.ASK), route, 0, lambda k, x: _shared(k, x, 0), ONE))
    known = known.unionByName(pairs)
    words = B.written(B.answer(cogrouped(ask_words, known, B.ASK), route, 1, lambda k, x: _shared(k, x, 4), ALL))
    known = known.unionByName(words)
    pair_discounts = discounts(_tally(pairs, 0, 1, 0)[0])
    told = _tally(words, 1, PLANES, 4)
    word_discounts = discounts(told[0])

    def score(table: pa.Table, known: pa.Table) -> pa.Table:
        x = _Pairs(table, known)
        pair = np.zeros(len(x.hashes), np.int64)
        pair[x.at + 1] = (B.replies(known, 0, "sparse") >> 1)[x.of_pair]
        planes = B.replies(known, 1, "sparse", PLANES)
        context = np.zeros((4, len(x.hashes)), np.int64)
        context[:, x.at + 1] = planes[:4, x.of_word[x.at]]
        logs = log_probabilities(pair, context, planes[4, x.of_word] >> 1, pair_discounts, word_discounts, told)
        sums = np.concatenate([[0.0], np.cumsum(logs)])
        n = x.words.counts
        mean = (sums[x.words.first[1:]] - sums[x.words.first[:-1]]) / np.maximum(n, 1)
        return pa.table({"doc_id": table["doc_id"], "lang": table["lang"], "n_words": pa.array(n.astype(np.int64)), "perplexity": pa.array(np.where(n > 0, np.exp(-mean), np.nan), from_pandas=True)})

    return cogrouped(score, known, SCORED, held)


def thresholds(told: DataFrame, quantile: float, prior: float) -> tuple[DataFrame, DataFrame]:
    """(lang, own) and (overall): the quantile of the perplexities, by counting them in steps of 0.1 percent.

    A language's own quantile is drawn (in logarithms) towards that of all languages, as if
    ``prior`` documents had told the latter. What is shuffled are counts by language and
    step, so no task gets the perplexities of a language.
    """

    def of(counts: DataFrame, keys: list[str]) -> DataFrame:
        up = Window.partitionBy(*keys).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
        every = Window.partitionBy(*keys)
        reached = counts.withColumns({"r": F.sum("n").over(up), "all": F.sum("n").over(every)}).filter(F.col("r") >= quantile * F.col("all"))
        return reached.groupBy(*keys).agg(((F.min("step") + 1) / STEPS).alias("log"), F.first("all").alias("n"))

    counts = told.groupBy("lang", F.floor(F.ln("perplexity") * STEPS).alias("step")).agg(F.count("*").alias("n"))
    overall = of(counts.groupBy("step").agg(F.sum("n").alias("n")).withColumn("one", F.lit(0)), ["one"]).select(F.col("log").alias("overall"))
    own = of(counts, ["lang"]).crossJoin(F.broadcast(overall))  # one row
    blended = (F.col("n") * F.col("log") + prior * F.col("overall")) / (F.col("n") + prior)
    return own.select(F.col("lang").alias("known_lang"), F.exp(blended).alias("own")), overall.select(F.exp("overall").alias("overall"))


def quality_classifier(
    docs: DataFrame,
    labels: DataFrame,
    quantile: float = 0.995,
    prior: float = 20.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """doc_id, lang, n_words, perplexity, threshold and kept, one row for each input row.

    Trusted are documents whose label ``quality`` is 1; the model is trained on all but one
    in FOLDS of them, and those left out give each language's threshold: the ``quantile``
    of their perplexities, drawn towards that of all languages by ``prior`` documents.
    Kept is a document whose perplexity isn't above it.

    Null and empty texts have no perplexity and aren't kept. A null language is one of its
    own, apart from an empty one. Without trusted documents there is no threshold, and all
    documents with words are kept. Repeated rows get equal rows, and count for training as
    often as they stand there. Other columns are not read; an empty table gives an empty
    result. Whole texts count.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    good = labels.filter("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    left_out = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(FOLDS)) == 0
    scored = B.written(perplexities(texts, good.filter(~left_out), block_bytes))
    own, overall = thresholds(scored.filter("perplexity is not null").join(good.filter(left_out), "doc_id"), quantile, prior)
    out = scored.join(F.broadcast(own), F.col("lang").eqNullSafe(F.col("known_lang")), "left").join(F.broadcast(overall), how="left")
    threshold = F.coalesce("own", "overall")
    kept = F.col("perplexity").isNotNull() & (threshold.isNull() | (F.col("perplexity") <= threshold))
    return out.select("doc_id", "lang", "n_words", "perplexity", threshold.alias("threshold"), kept.alias("kept"))
