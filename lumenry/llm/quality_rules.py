"""Operator 8: quality rules by counts, and by divergence from the language's own profile.

The profile of a language is the mean character-class distribution of its documents and
the shares of its most frequent words, over every document that passes the counting
rules. A document is compared with it by the Jensen-Shannon distance (base 2, 0 to 1).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B
from . import words as W

CLASSES = ("lower", "upper", "digit", "space", "sentence", "symbol", "other ascii", "beyond ascii")
CHUNK = 3 << 20  # bytes of text that are measured at once; arrays of eight bytes a byte are made of them
WAITING = 2 << 20  # words that a task counts at once
HELD = 4096  # profiles, of about 1 KB, that are sent to every task; where there are more, each row is joined with its own
POOLED, UNTOLD = "*", "-"  # the keys of all languages together, and of the null language; those of others begin with =
SYMBOLS = b"#*$%&|<>"
_CLASS = np.full(256, 6, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[list(b".,;:!?'\"()-")] = 4
_CLASS[list(SYMBOLS)] = 5
_CLASS[0xC0:], _CLASS[0x80:0xC0] = 7, 8  # the bytes after the first of a code point are in none


@dataclass(frozen=True)
class Limits:
    """Thresholds. A share is of words; a distance counts only for texts of ``profile_words`` or more."""

    least_words: int = 20
    repeat_percent: int = 30
    repeat_window: int = 8
    profile_words: int = 60
    class_distance: float = 0.28
    word_distance: float = 0.45
    common_words: int = 64
    profile_documents: int = 50


def measure(texts: pa.Array, window: int = 8) -> tuple[W.Words, dict[str, np.ndarray], np.ndarray]:
    """Words, base counts and character classes (one row a text) of whole texts."""
    words = W.split(texts)
    n = len(words.counts)
    hashes = words.hashes()
    owner = words.text_of()

    at = np.flatnonzero(words.left() >= window)
    keys = W.spread(W.window_sums(hashes, window)[at], owner[at])
    order = np.argsort(keys)
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order][1:] == keys[order][:-1]
    again = W.covered(np.sort(at[order[same[1:] | same[:-1]]]), window, len(hashes))

    held = words.bytes[:-8]
    breaks = np.flatnonzero(held == 10)
    begin = np.sort(np.concatenate([words.text_at[:-1], breaks + 1]))
    end = np.sort(np.concatenate([breaks, words.text_at[1:]]))
    full = np.searchsorted(words.start, end) > np.searchsorted(words.start, begin)
    begin, end = begin[full], end[full]
    of = np.searchsorted(words.text_at, begin, "right") - 1
    lines = W.spread(W.span_hashes(words.bytes, begin, end), of)
    order = np.argsort(lines, kind="stable")
    later = np.concatenate([[False], lines[order][1:] == lines[order][:-1]])[: len(lines)]

    sizes = np.diff(words.text_at)
    kinds = np.bincount(np.repeat(np.arange(n), sizes) * 9 + _CLASS[held], minlength=9 * n).reshape(n, 9)[:, :8]
    counts = {
        "n_words": words.counts.astype(np.int64),
        "word_chars": W.per_text(~W.SEPARATOR[held] & ((held & 0xC0) != 0x80), words.text_at),
        "n_symbols": kinds[:, 5],
        "n_dup_lines": np.bincount(of[order[later]], minlength=n),
        "n_repeat_words": W.per_text(again, words.first),
    }
    return words, counts, kinds


def base_failed(counts: dict[str, np.ndarray], limits: Limits) -> np.ndarray:
    return (counts["n_words"] < limits.least_words) | (100 * counts["n_repeat_words"] > limits.repeat_percent * counts["n_words"])


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of the rows of ``p`` and ``q``; a row without counts is at 0."""
    total = p.sum(1, keepdims=True)
    p = p / np.maximum(total, 1)
    q = q / np.maximum(q.sum(1, keepdims=True), 1e-300)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        each = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return np.where(total[:, 0] > 0, np.sqrt(np.maximum(each.sum(1) / 2, 0)), 0.0)


def _keys(lang: pa.Array) -> list[str]:
    return [UNTOLD if x is None else "=" + x for x in lang.to_pylist()]


def _lower_hashes(texts: pa.Array) -> tuple[W.Words, np.ndarray]:
    words = W.split(texts, lower=True)
    return words, words.hashes()


def profiles(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """lang, documents, classes (sums of shares), word_ids and word_shares, over all documents; ``POOLED`` is all languages.

    One pass adds up within each task; what is shuffled is a row for each language and
    word of a task. The most frequent words are found by hashed parts of the vocabulary
    first, so no task gets all words of a language.
    """

    def summed_up(lang: str, shares: np.ndarray, documents: int, hashes: list[np.ndarray]) -> pa.RecordBatch:
        ids, n = np.unique(np.concatenate(hashes), return_counts=True)
        keys = np.concatenate([np.arange(9), ids.view(np.int64)])
        values = np.concatenate([shares, [documents], n]).astype(float)
        kind = np.concatenate([np.zeros(9, np.int32), np.ones(len(ids), np.int32)])
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(keys), pa.string()), pa.array(kind), pa.array(keys), pa.array(values)], names=["lang", "kind", "key", "value"]
        )

    def partial(batches):
        held: dict[str, list] = {}
        waiting = 0
        for batch in W.chunks(batches, "text", CHUNK):
            texts = batch.column("text")
            _, counts, kinds = measure(texts, limits.repeat_window)
            use = ~base_failed(counts, limits)
            words, hashes = _lower_hashes(texts)
            owner = words.text_of()
            langs = np.asarray(_keys(batch.column("lang")), object)
            for lang in set(langs[use]):
                mine = use & (langs == lang)
                got = held.setdefault(lang, [np.zeros(8), 0, []])
                got[0] += (kinds[mine] / np.maximum(kinds[mine].sum(1, keepdims=True), 1)).sum(0)
                got[1] += int(mine.sum())
                got[2].append(hashes[mine[owner]])
                waiting += len(got[2][-1])
            if waiting > WAITING:
                yield from (summed_up(lang, *got) for lang, got in held.items())
                held, waiting = {}, 0
        yield from (summed_up(lang, *got) for lang, got in held.items())

    # written, as several steps read it: so the texts are measured once
    summed = B.written(docs.mapInArrow(partial, "lang string, kind int, key long, value double").groupBy("lang", "kind", "key").agg(F.sum("value").alias("value")))
    pooled = summed.groupBy("kind", "key").agg(F.sum("value").alias("value")).select(F.lit(POOLED).alias("lang"), "kind", "key", "value")
    summed = summed.unionByName(pooled)
    by_part = Window.partitionBy("lang", F.pmod("key", F.lit(64))).orderBy(F.desc("value"), "key")
    by_lang = Window.partitionBy("lang").orderBy(F.desc("value"), "key")
    counted = summed.filter("kind = 1")
    totals = counted.groupBy("lang").agg(F.sum("value").alias("n"))
    top = (
        counted.withColumn("r", F.row_number().over(by_part)).filter(F.col("r") <= limits.common_words)
        .withColumn("r", F.row_number().over(by_lang)).filter(F.col("r") <= limits.common_words)
        .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct(F.col("key"), F.col("value")))).alias("w"))
    )
    classes = summed.filter("kind = 0").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("key", "value"))).alias("c"))
    return (
        classes.join(top, "lang").join(totals, "lang")
        .select(
            "lang", F.element_at("c", 9)["value"].alias("documents"),
            F.transform(F.slice("c", 1, 8), lambda x: x["value"]).alias("classes"),
            F.col("w.key").alias("word_ids"), F.transform("w", lambda x: x["value"] / F.col("n")).alias("word_shares"),
        )
    )


def _unpacked(row) -> tuple:
    return np.array(row["classes"]), int(row["documents"]), np.array(row["word_ids"], np.int64), np.array(row["word_shares"])


def _blended(own: tuple | None, pooled: tuple, limits: Limits) -> tuple:
    """A language's profile; one of few documents is filled up to ``profile_documents`` by the profile of all languages."""
    weight = min(1.0, own[1] / limits.profile_documents) if own else 0.0
    parts = [(w, p) for w, p in ((weight, own), (1 - weight, pooled)) if w]
    ids = np.unique(np.concatenate([p[2] for _, p in parts]))
    classes, shares = np.zeros(8), np.zeros(len(ids))
    for w, (sums, n, words, told) in parts:
        classes += w * sums / n
        shares[np.searchsorted(ids, words)] += w * told
    return classes, ids.view(np.uint64), shares


def _judged(docs: DataFrame, text: str, lang: str, limits: Limits):
    """``docs``, which may have a further column ``_profile`` now, and what judges a batch of its texts and languages."""
    texts = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    table = B.written(profiles(texts, limits))
    top = table.filter(F.col("lang") == POOLED).first()
    pooled = _unpacked(top) if top else None
    rows = table.filter(F.col("lang") != POOLED).limit(HELD + 1).collect()
    if len(rows) <= HELD:
        held = {r.lang: _blended(_unpacked(r), pooled, limits) for r in rows}
        return docs, lambda batch: held, pooled
    packed = table.filter(F.col("lang") != POOLED).select(F.col("lang").alias("_lang"), F.struct("classes", "documents", "word_ids", "word_shares").alias("_profile"))
    joined = docs.join(packed, F.coalesce(F.concat(F.lit("="), lang), F.lit(UNTOLD)) == F.col("_lang"), "left").drop("_lang")

    def own(batch):
        langs = _keys(batch.column(lang))
        first = {name: k for k, name in enumerate(langs)}
        return {name: _blended(_unpacked(p), pooled, limits) for name, k in first.items() if (p := batch.column("_profile")[k].as_py())}

    return joined, own, pooled


RESULT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, class_distance double, word_distance double, kept boolean"
)


def quality_rules(
    docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """Counts, distances and verdict of each document, one row for each input row.

    Rejected are texts of fewer than ``least_words`` words, texts of which more than
    ``repeat_percent`` percent of the words are in repeated windows, and texts of
    ``profile_words`` words or more that lie further from their language's profile than
    ``class_distance`` or ``word_distance``. The profile of a language with fewer than
    ``profile_documents`` good documents is filled up by that of all languages.

    Null and empty texts have no words and fail. A null language is a language of its
    own, apart from an empty one. Repeated rows are judged alike; an empty table gives an empty result; other
    columns are not read. Whole texts count, of any length.
    """
    texts = W.small_batches(docs).select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    texts, held, pooled = _judged(texts, "text", "lang", limits)
    judge = _judge(pooled, limits)

    def run(batches):
        for batch in W.chunks(batches, "text", CHUNK):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **judge(batch.column("text"), batch.column("lang"), held(batch))})

    return texts.mapInArrow(run, RESULT)


def keep_good(docs: DataFrame, limits: Limits = Limits(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, as they are, that ``quality_rules`` keeps; judged in the same pass that reads them."""
    whole = B.nullable(docs.schema)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).cast(whole).alias("row")  # so no name of theirs meets one of ours
    texts = W.small_batches(docs).select(row, F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    texts, held, pooled = _judged(texts, "text", "lang", limits)
    judge = _judge(pooled, limits)

    def run(batches):
        for batch in W.chunks(batches, "text", CHUNK):
            kept = judge(batch.column("text"), batch.column("lang"), held(batch))["kept"]
            yield pa.RecordBatch.from_struct_array(batch.column("row").filter(kept))

    return texts.mapInArrow(run, whole)


def _judge(pooled: tuple | None, limits: Limits):
    """Counts, distances and verdicts of a batch of texts by the profiles of ``held``; by ``pooled`` where a language has none."""
    other = _blended(None, pooled, limits) if pooled else None

    def judge(texts: pa.Array, lang: pa.Array, held: dict[str, tuple]) -> dict[str, pa.Array]:
        _, counts, kinds = measure(texts, limits.repeat_window)
        words, hashes = _lower_hashes(texts)
        langs = np.asarray(_keys(lang), object)
        owner = words.text_of()
        of_class = np.full(len(langs), np.nan)
        of_words = np.full(len(langs), np.nan)
        for name in set(langs) if other else ():
            classes, ids, shares = held.get(name, other)
            mine = np.flatnonzero(langs == name)
            of_class[mine] = distance(kinds[mine], np.tile(classes, (len(mine), 1)))
            row = np.full(len(langs), -1)
            row[mine] = np.arange(len(mine))
            chosen = np.flatnonzero(row[owner] >= 0)
            rank = np.argsort(ids)
            place = np.minimum(np.searchsorted(ids[rank], hashes[chosen]), len(ids) - 1)
            bin_ = np.where(ids[rank][place] == hashes[chosen], rank[place], len(ids))
            size = len(ids) + 1
            histogram = np.bincount(row[owner[chosen]] * size + bin_, minlength=len(mine) * size).reshape(len(mine), size)
            of_words[mine] = distance(histogram, np.tile(np.append(shares, max(0.0, 1 - shares.sum())), (len(mine), 1)))
        failed = base_failed(counts, limits)
        far = (np.nan_to_num(of_class) > limits.class_distance) | (np.nan_to_num(of_words) > limits.word_distance)
        kept = ~failed & ~(far & (counts["n_words"] >= limits.profile_words))
        return {
            **{k: pa.array(v.astype(np.int64)) for k, v in counts.items()},
            "base_failed": pa.array(failed),
            "class_distance": pa.array(of_class, from_pandas=True),
            "word_distance": pa.array(of_words, from_pandas=True),
            "kept": pa.array(kept),
        }

    return judge
