"""Operator 7: byte-pair encoding and decoding of a word-end vocabulary, by a pair occurrence index.

The distinct pre-tokens of a chunk of a partition are laid out as one array of symbols.
Each pair that the vocabulary merges is mapped to all its positions; the lowest active
rank is applied to all of them at once, and the lists of the pairs to the left and right
of each new symbol are updated.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

HELD_WORDS = 200_000  # words whose encoding a task keeps; beyond, it starts anew
CHUNK = 4 << 20  # bytes of text whose new words are merged together
RESULT = "doc_id long, ids array<int>, decoded string"
# \x1c-\x1f count as white space for str.split, but not in the Unicode property
_SPLIT_BY_HAND = regex.compile("[\x1c-\x1f]")
_WHITE = regex.compile(r"\p{White_Space}+")


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


@dataclass
class Vocabulary:
    tokens: list[str]  # by id
    first: np.ndarray  # id of each byte inside a word
    last: np.ndarray  # and at its end
    pairs: np.ndarray  # sorted keys of mergeable pairs: left * size + right
    ranks: np.ndarray  # their ranks
    merged: np.ndarray  # by rank: the new symbol
    left: np.ndarray
    right: np.ndarray
    special: dict[str, int]
    pattern: regex.Pattern
    special_pattern: regex.Pattern | None


@lru_cache(maxsize=4)
def vocabulary(text: str) -> Vocabulary:
    """Reads the JSON of a tokenizer with a word-end suffix, a split pattern and byte-level symbols."""
    held = json.loads(text)
    model = held["model"]
    ids: dict[str, int] = model["vocab"]
    special = {t["content"]: t["id"] for t in held["added_tokens"]}
    tokens = [""] * (1 + max([*ids.values(), *special.values()]))
    for token, k in [*ids.items(), *special.items()]:
        tokens[k] = token
    size, end = len(tokens), model["end_of_word_suffix"]
    split = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    left, right = (np.array([ids[m[k]] for m in split], np.int64) for k in (0, 1))
    merged = np.array([ids[a + b] for a, b in split], np.int64)
    keys = left * size + right
    order = np.argsort(keys, kind="stable")
    characters = _byte_characters()
    # a character of [^\s...] in the file is one without the property White_Space
    pattern = held["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
    return Vocabulary(
        tokens, np.array([ids[c] for c in characters]), np.array([ids[c + end] for c in characters]), keys[order], order, merged, left, right,
        special, regex.compile(pattern), regex.compile("|".join(map(regex.escape, special))) if special else None,
    )


class _Symbols:
    """Symbols of many words as linked lists in arrays, and the positions of each mergeable pair by rank."""

    def __init__(self, words: list[bytes], v: Vocabulary):
        self.v, self.size = v, len(v.tokens)
        sizes = np.array([len(w) for w in words])
        held = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(sizes)
        n = len(held)
        self.symbol = v.first[held]
        self.symbol[ends - 1] = v.last[held[ends - 1]]
        self.next = np.arange(1, n + 1)
        self.next[ends - 1] = -1
        self.before = np.arange(-1, n - 1)
        self.before[ends - sizes] = -1
        self.ends, self.sizes = ends, sizes
        self.index: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []
        self._enter(np.arange(n))

    def _enter(self, at: np.ndarray) -> None:
        """Adds the pairs that begin at ``at`` to their ranks' lists."""
        at = at[at >= 0]
        at = at[self.next[at] >= 0]
        keys = self.symbol[at] * self.size + self.symbol[self.next[at]]
        place = np.minimum(np.searchsorted(self.v.pairs, keys), len(self.v.pairs) - 1)
        known = self.v.pairs[place] == keys
        at, ranks = at[known], self.v.ranks[place[known]]
        if not len(at):
            return
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cut = np.flatnonzero(np.diff(ranks)) + 1
        for rank, part in zip(ranks[np.concatenate([[0], cut])].tolist(), np.split(at, cut), strict=True):
            if rank not in self.index:
                self.index[rank] = []
                heapq.heappush(self.active, rank)
            self.index[rank].append(part)

    def merge_all(self) -> None:
        while self.active:
            rank = heapq.heappop(self.active)
            lists = self.index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            a, b = self.v.left[rank], self.v.right[rank]
            follow = self.next[at]
            at = at[(self.symbol[at] == a) & (follow >= 0) & (self.symbol[follow] == b)]
            at = np.unique(at) if len(lists) > 1 else np.sort(at)
            if a == b and len(at) > 1:  # in a run of one symbol, every second place
                joins = np.concatenate([[False], self.next[at[:-1]] == at[1:]])
                begin = np.maximum.accumulate(np.where(joins, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - begin) % 2 == 0]
            if not len(at):
                continue
            gone = self.next[at]
            after = self.next[gone]
            self.symbol[at] = self.v.merged[rank]
            self.symbol[gone] = -1
            self.next[at] = after
            self.before[after[after >= 0]] = at[after >= 0]
            self._enter(np.unique(np.concatenate([self.before[at], at])))

    def encoded(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids, word after word, and where each word's end."""
        alive = self.symbol >= 0
        return self.symbol[alive].astype("<i4"), np.cumsum(alive)[self.ends - 1]


def encode_words(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pre-tokens (none empty), one after another, and where each one's end."""
    if not words:
        return np.zeros(0, "<i4"), np.zeros(0, np.int64)
    symbols = _Symbols(words, v)
    symbols.merge_all()
    return symbols.encoded()


def _lowered(text: str) -> str:
    text = unicodedata.normalize("NFC", text)
    return "".join(c.lower() for c in text) if "Σ" in text else text.lower()  # no special case for a final sigma


def pieces(raw: str, v: Vocabulary) -> list[str | int]:
    """Pre-tokens of a text, and the ids of special tokens that stand in it."""
    if not (v.special_pattern and v.special_pattern.search(raw)):
        return v.pattern.findall(raw.lower() if raw.isascii() else _lowered(raw))
    out: list[str | int] = []
    at = 0
    for m in v.special_pattern.finditer(raw):
        out += v.pattern.findall(_lowered(raw[at : m.start()]))
        out.append(v.special[m[0]])
        at = m.end()
    return out + v.pattern.findall(_lowered(raw[at:]))


class _Encoder:
    """Encodings of white-space-separated words, kept within a task."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.ids: dict[str, bytes] = {}

    def split(self, text: str | None) -> list[str]:
        if not text:
            return []
        return [w for w in _WHITE.split(text) if w] if _SPLIT_BY_HAND.search(text) else text.split()

    def learn(self, words: set[str]) -> None:
        if len(self.ids) > HELD_WORDS:
            self.ids.clear()
        parts = {w: pieces(w, self.v) for w in words - self.ids.keys()}
        fresh = list({p for x in parts.values() for p in x if isinstance(p, str)})
        ids, ends = encode_words([p.encode() for p in fresh], self.v)
        held = ids.tobytes()
        coded: dict[str | int, bytes] = {k: k.to_bytes(4, "little") for k in self.v.special.values()}
        a = 0
        for piece, b in zip(fresh, ends.tolist(), strict=True):
            coded[piece] = held[4 * a : 4 * b]
            a = b
        for w, x in parts.items():
            self.ids[w] = coded[x[0]] if len(x) == 1 else b"".join([coded[p] for p in x])


def decoded(ids, v: Vocabulary) -> str:
    """What the library gives for a vocabulary without a decoder: the tokens, special ones too, joined by a space."""
    return " ".join([v.tokens[k] for k in ids])


def bpe(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes each text by the vocabulary at ``path`` (a file of the driver, sent to each executor once: a few MB), and decodes the ids.

    Returns doc_id, ids and decoded, one row for each input row. Null and empty texts have
    no ids and decode to an empty text. Special tokens that stand in a text are encoded as
    such; none is added. Repeated rows are encoded alike, whole texts of any length; other
    columns are not read; an empty table gives an empty result.
    """
    with open(path, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        v = vocabulary(sent.value)
        encoder, tokens = _Encoder(v), pa.array(v.tokens, pa.string())
        for batch in W.chunks(batches, "text", CHUNK):
            texts = [encoder.split(x) for x in batch.column("text").to_pylist()]
            encoder.learn(set().union(*texts))
            ids = encoder.ids.__getitem__
            held = [b"".join(map(ids, x)) for x in texts]
            offsets = np.cumsum([0] + [len(x) // 4 for x in held]).astype(np.int32)
            values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(held))])
            lists = pa.ListArray.from_arrays(pa.array(offsets), values)
            shown = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), tokens.take(values)), " ")  # the ids, decoded
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, shown], names=["doc_id", "ids", "decoded"])

    texts = W.small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, RESULT)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", as_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its id lists as a further column; null ids give an empty text."""
    with open(path, encoding="utf-8") as f:
        sent = encoded.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("string")
    def text(ids):
        v = vocabulary(sent.value)
        return ids.map(lambda x: "" if x is None else decoded(x, v))

    return encoded.withColumn(as_col, text(F.col(ids_col)))
