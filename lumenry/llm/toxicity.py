"""Operator 6: toxicity by compression distance between two zstandard dictionaries.

Both dictionaries share one trained on ordinary text. To it, one adds what marks toxic
text (words whose documents are mostly toxic, by a likelihood ratio), the other as many
bytes of ordinary words of like length. So for an ordinary window of a text both lengths
agree but for chance matches, and for a toxic one the toxic dictionary saves bytes. The
differences of all windows of a text give a few features; a logistic curve, fitted on
labelled texts that the dictionaries didn't see, turns them into a score.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

WINDOW = 16  # words
DICTIONARY_BYTES = 110 << 10
LEAST_MATCH = 5  # bytes; shorter matches are chance
SAMPLE = 5000  # labelled texts of each class that the driver reads at most
_WORD = re.compile(r"\w+")


def windows(text: str | None) -> list[bytes]:
    """The lower-cased words of a text in runs of ``WINDOW``; one empty run if there are none."""
    words = (text or "").lower().encode().split()
    return [b" " + b" ".join(words[k : k + WINDOW]) for k in range(0, len(words), WINDOW)] or [b""]


class Distance:
    """Bytes that the toxic dictionary saves against the ordinary one."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self._sizes = [self._size_of(x) for x in (ordinary, toxic)]

    @staticmethod
    def _size_of(content: bytes):
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters(
            window_log=18, hash_log=17, chain_log=17, search_log=4, min_match=LEAST_MATCH, strategy=zstandard.STRATEGY_LAZY2,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        held.precompute_compress(compression_params=how)
        compress = zstandard.ZstdCompressor(dict_data=held, compression_params=how).compress
        return lambda window: len(compress(window))

    def saved(self, text: str | None) -> np.ndarray:
        ordinary, toxic = self._sizes
        return np.array([ordinary(x) - toxic(x) for x in windows(text)])


def features(saved: np.ndarray) -> np.ndarray:
    """Shares of windows by bytes saved, the largest savings, and how many windows save four bytes or more."""
    n = len(saved)
    shares = np.bincount(np.clip(saved, -4, 8) + 4, minlength=13) / n
    top = np.sort(saved)[::-1][:2]
    return np.concatenate([shares, [top.mean(), top[0], math.sqrt((saved >= 4).sum()), math.log(n)]])


def unlike(texts: Sequence[str]) -> list[str]:
    """The texts that share at most a fifth of their three-word runs with those before: copies tell nothing new."""
    seen: set[int] = set()
    out = []
    for text in texts:
        words = _WORD.findall(text.lower())
        runs = {hash(tuple(words[k : k + 3])) for k in range(max(1, len(words) - 2))}
        if len(runs & seen) <= 0.2 * len(runs):
            out.append(text)
        seen |= runs
    return out


def marks(toxic: Sequence[str], ordinary: Sequence[str]) -> tuple[list[str], Counter]:
    """Words of toxic texts, the most telling last, and how many ordinary texts hold each word."""
    counts = []
    for texts in (toxic, ordinary):
        held: Counter = Counter()
        for text in texts:
            held.update(set(_WORD.findall(text.lower())))
        counts.append(held)
    in_toxic, in_ordinary = counts
    n, m = len(toxic) + 1, len(ordinary) + 1
    out = []
    for word, k in in_toxic.items():
        if len(word) >= 3 and k >= max(3, 0.004 * n):
            ratio = math.log((k + 0.5) / n * m / (in_ordinary[word] + 0.5))
            if ratio >= math.log(8) and k * ratio >= 12:
                out.append((k, word))
    return [w for _, w in sorted(out)], in_ordinary


def dictionaries(toxic: Sequence[str], ordinary: Sequence[str]) -> tuple[bytes, bytes]:
    """The contents of the toxic and the ordinary dictionary; of one length, so that they are searched alike."""
    told, in_ordinary = marks(toxic, ordinary)
    of_length: dict[int, list[str]] = {}
    for word in sorted(w for w, k in in_ordinary.items() if k >= 2 and w not in set(told)):
        of_length.setdefault(len(word), []).append(word)
    draw = random.Random(0)
    like = [draw.choice(of_length[min(of_length, key=lambda n: abs(n - len(w)))]) for w in told] if of_length else []
    added = "".join("\0 " + w for w in told).encode() + b"\0"
    filled = ("".join("\0 " + w for w in like).encode() + b"\0")[: len(added)].rjust(len(added), b"\0")
    runs = [x for text in ordinary for x in windows(text)]
    try:
        shared = zstandard.train_dictionary(DICTIONARY_BYTES, runs).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself
        shared = b"".join(runs)[-DICTIONARY_BYTES:]
    return shared + added, shared + filled


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, scales and weights of a logistic curve, by Newton's method."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (p - y) + ridge * w)
    return mean, scale, w


Model = tuple[bytes, bytes, np.ndarray, np.ndarray, np.ndarray]


def train(toxic: Sequence[str], ordinary: Sequence[str], odds: float = 1.0, folds: int = 3) -> Model | None:
    """Dictionaries of all texts, and the curve from texts that the fold's dictionaries didn't see.

    ``odds`` are those of the label toxic: the texts come with equal weight for each class,
    and the curve is moved half the way (in logits) to these odds, so that a score of a
    half weighs a missed toxic text somewhat more than a clean one that is taken for toxic.
    None where a class has under six texts.
    """
    toxic, ordinary = unlike(toxic), unlike(ordinary)
    if min(len(toxic), len(ordinary)) < 6:
        return None
    x, y = [], []
    for k in range(folds):
        seen = [[t for i, t in enumerate(texts) if i % folds != k] for texts in (toxic, ordinary)]
        distance = Distance(*dictionaries(*seen))
        for label, texts in ((1.0, toxic), (0.0, ordinary)):
            x += [features(distance.saved(t)) for t in texts[k::folds]]
            y += [label] * len(texts[k::folds])
    mean, scale, w = fitted(np.array(x), np.array(y))
    w[-1] += 0.5 * math.log(odds * len(ordinary) / len(toxic))
    return (*dictionaries(toxic, ordinary), mean, scale, w)


def held_out(id_col) -> F.Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[str], list[str], float]:
    """Whole toxic and ordinary texts of at most ``sample`` labelled rows of each class that aren't held out, by a hash of the id; and the odds.

    Of rows that repeat an id, the least text counts.
    """
    known = labels.filter(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    first = [known.filter(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(sample) for toxic in (1, 0)]
    chosen = F.broadcast(first[0].unionByName(first[1]))
    texts = docs.join(chosen, "doc_id").filter("text is not null").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = sorted(texts.collect(), key=lambda r: (zlib.crc32(f"{r.doc_id} 3".encode()), r.doc_id))
    n = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    return [r.text for r in rows if r.toxic == 1], [r.text for r in rows if r.toxic == 0], max(1, n.get(1, 0)) / max(1, n.get(0, 0))


def toxicity(
    docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score >= 0.5) of each text, one row for each input row.

    ``labels`` has doc_id and toxic (0 or 1, nulls are no label). The model is fitted on at
    most ``sample_rows`` labelled texts of each class, whole, none of them held out (the
    CRC-32 of the id's digits divides by five); all that scores is the text. Whole texts are
    scored. Null and empty texts get the score of an empty window; a null id isn't held
    out. Where a class has too few labelled texts to fit, every score is 0. Repeated rows
    get equal scores; an empty table gives an empty result; other columns aren't read.
    """
    texts = W.small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = train(*sample(texts, labels, sample_rows))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        if sent.value is not None:
            toxic, ordinary, mean, scale, w = sent.value
            distance = Distance(toxic, ordinary)
        for batch in W.chunks(batches, "text", 8 << 20):
            if sent.value is None:
                scores = np.zeros(len(batch))
            else:
                x = np.array([features(distance.saved(t)) for t in batch.column("text").to_pylist()])
                scores = 1 / (1 + np.exp(-np.clip(np.column_stack([(x - mean) / scale, np.ones(len(x))]) @ w, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    scored = texts.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
