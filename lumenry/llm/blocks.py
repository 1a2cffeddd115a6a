"""Blocks of documents, and lookups from blocks to shards of hashes and back.

Counting n-grams of a corpus by exploding them into rows moves every occurrence
twice. Here a block of documents (a few MB of text, one row group of a bucketed
table) asks each hash shard once for its distinct hashes as one binary value, and
the shard answers with one value of equal length. So the shuffle holds a few bytes
for each distinct hash of a block and no key is ever gathered by occurrence: a word
sequence in a third of all documents costs one entry a block.

Shards grow with the blocks, so sending each block to each shard would take a number
of rows that grows with the square of the corpus. Hashes are dealt by digits instead:
a block sends ``RADIX`` parts at most, by the first digit; a router merges what
``RADIX`` blocks sent for that digit and deals it by the next, and so on. Each hop
moves about ``RADIX`` rows a block, and the answers go back by the same routers. Up to
``RADIX`` shards one hop does, so there are no routers.

The blocks are written once, bucketed by block, to the folder that the session names
in ``spark.checkpoint.dir``; every later pass reads them in place, without a shuffle,
and a lost executor's work is redone from those files.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, LongType, MapType, StructField, StructType

from .words import small_batches

BLOCK_BYTES = 6 << 20
RADIX = 256  # a power of two
ASK = "to long, part long, blocks array<long>, keys array<binary>, extras array<binary>"
REPLY = "to long, part long, blocks array<long>, replies array<binary>"
ANSWER = "block long, round int, part long, reply binary"
_LISTS = pa.list_(pa.int64()), pa.list_(pa.binary())
_own: dict[str, str] = {}
_made: dict[str, list[tuple[str, str]]] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``; below a temporary one where that is unset and Spark runs in one process."""
    context = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not top:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = _own.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="lumenry-")
        _own[context.applicationId] = top
    path = f"{top.rstrip('/')}/lumenry-{uuid.uuid4().hex}"
    _made.setdefault(context.applicationId, []).append(("", path))
    return path


def made_table(spark: SparkSession, table: str, path: str) -> None:
    """Notes a table whose files lie at ``path``, a name from ``shared_folder``."""
    _made[spark.sparkContext.applicationId].append((table, path))


def clean_up(spark: SparkSession) -> int:
    """Drops the tables and deletes the folders that this module made in the session's application; for when all results are written."""
    made = _made.pop(spark.sparkContext.applicationId, [])
    for table, path in made:
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        else:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return len(made)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, and is computed once."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _tagger(block_bytes: int):
    def tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, size = TaskContext.get().partitionId() << 24, 0
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            done = np.cumsum(lengths) + size
            ids = block + done // block_bytes
            size = int(done[-1]) if len(done) else size
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *batch.columns], names=["block", *batch.schema.names])

    return tagged


def write_blocks(texts: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``texts`` (doc_id long, text string, and what is carried along) with a block number, bucketed by it.

    The numbers come from where a row was read, once: afterwards the table is what holds.
    """
    spark = small_batches(texts).sparkSession
    name, path = f"lumenry_{uuid.uuid4().hex}", shared_folder(spark)
    _made[spark.sparkContext.applicationId].append((name, path))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tagged = texts.mapInArrow(_tagger(block_bytes), StructType([StructField("block", LongType()), *texts.schema.fields]))
    tagged.write.option("compression", "zstd").option("path", path).bucketBy(buckets, "block").saveAsTable(name)
    return spark.table(name)


@dataclass(frozen=True)
class Route:
    """``hops`` digits of ``bits`` bits each lead to a shard; ``groups`` has the number of routers' groups after each hop."""

    bits: int
    hops: int
    groups: tuple[int, ...]

    @property
    def shards(self) -> int:
        return 1 << (self.bits * self.hops)

    @property
    def precision(self) -> int:
        """Bits of a hash that are sent: those of its shard, and 32 below, which nearly always tell a shard's hashes apart."""
        return min(64, self.bits * self.hops + 32)

    def below(self, hop: int) -> int:
        """Bits that tell hashes apart within a part that ``hop`` digits name."""
        return self.precision - self.bits * hop

    def group(self, block: int, hop: int) -> int:
        out = (block * 0x9E3779B97F4A7C15 & 2**64 - 1) >> 20
        for n in self.groups[:hop]:
            out %= n
        return out


def route(blocks: DataFrame) -> Route:
    """Shards that each get about as many hashes as two or three blocks hold, and the hops that reach them."""
    n = blocks.select("block").distinct().count()
    wanted = max(1, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 2)
    bits, digit = (wanted - 1).bit_length(), RADIX.bit_length() - 1
    hops = max(1, -(-bits // digit))
    return Route(-(-bits // hops), hops, tuple(max(1, -(-n // (1 << (digit * k)))) for k in range(1, hops)))


def squeezed(held: bytes) -> bytes:
    return zstandard.ZstdCompressor(1, write_checksum=False).compress(held)


def opened(held: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(held)


def packed(ordered: np.ndarray, bits: int) -> bytes:
    """Sorted numbers below 2 ** ``bits`` as differences: 16 bits of each, then the next 16, which compress well."""
    steps = np.diff(ordered, prepend=np.uint64(0))
    return squeezed(b"".join((steps >> np.uint64(k)).astype("<u2").tobytes() for k in range(0, max(bits, 1), 16)))


def unpacked(held: bytes, bits: int) -> np.ndarray:
    planes = np.frombuffer(opened(held), "<u2").reshape(-(-max(bits, 1) // 16), -1)
    return np.cumsum(sum(p.astype(np.uint64) << np.uint64(16 * k) for k, p in enumerate(planes)), dtype=np.uint64)


def sparse(values: np.ndarray) -> bytes:
    """Numbers below 2^63, most of them 0: which ones aren't, their values up to 253, and the larger ones in four bytes or eight."""
    flat = values.ravel()
    some = flat[flat > 0]
    wide = some >= 2**32
    sizes = np.where(wide, 255, np.minimum(some, 254)).astype(np.uint8)
    head = np.array([len(flat), len(some)], "<u4")
    return squeezed(head.tobytes() + np.packbits(flat > 0).tobytes() + sizes.tobytes() + some[wide].astype("<u8").tobytes() + some[(some > 253) & ~wide].astype("<u4").tobytes())


def dense(held: bytes, rows: int = 1) -> np.ndarray:
    """The numbers that ``sparse`` packed, as int64, in ``rows`` rows."""
    data = opened(held)
    size, n = np.frombuffer(data, "<u4", 2)
    at = 8 + (int(size) + 7) // 8
    where = np.unpackbits(np.frombuffer(data, np.uint8, at - 8, 8), count=int(size)).astype(bool)
    sizes = np.frombuffer(data, np.uint8, int(n), at)
    some = sizes.astype(np.int64)
    at += int(n)
    for mark, kind in ((255, "<u8"), (254, "<u4")):
        chosen = sizes == mark
        if count := int(chosen.sum()):
            some[chosen] = np.frombuffer(data, kind, count, at)
            at += count * int(kind[2])
    out = np.zeros(int(size), np.int64)
    out[where] = some
    return out.reshape(rows, -1)


def plain(values: np.ndarray) -> bytes:
    """Eight bytes a number, first bytes first, so that what numbers have in common compresses."""
    return squeezed(np.ascontiguousarray(values.astype("<i8").ravel().view(np.uint8).reshape(-1, 8).T).tobytes())


def restored(held: bytes, rows: int = 1) -> np.ndarray:
    bytes_ = np.frombuffer(opened(held), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(bytes_.T).view("<i8").reshape(rows, -1).astype(np.int64)


#: How the values that go along with keys are packed.
CODECS = {"sparse": (sparse, dense), "plain": (plain, restored)}


def nullable(kind: DataType) -> DataType:
    """A type of the same fields whose values, at any depth, may be null; as tasks return them."""
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, nullable(f.dataType), True, f.metadata) for f in kind.fields])
    if isinstance(kind, ArrayType):
        return ArrayType(nullable(kind.elementType), True)
    return MapType(kind.keyType, nullable(kind.valueType), True) if isinstance(kind, MapType) else kind


@dataclass(frozen=True)
class Extra:
    """Values that go along with each key: ``rows`` numbers of it."""

    kind: str
    rows: int = 1

    def pack(self, values: np.ndarray) -> bytes:
        return CODECS[self.kind][0](values)

    def open(self, held: bytes) -> np.ndarray:
        return CODECS[self.kind][1](held, self.rows)


def _rows(rows: list[tuple], schema: str) -> pa.Table:
    """Rows of (to, part, blocks, binary lists) as a table of the schema."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), _LISTS[0], *[_LISTS[1]] * (len(names) - 3)]
    return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def _cut(keys: np.ndarray, bits: int, below: int) -> Iterator[tuple[int, int, int]]:
    """(digit, begin, end) of sorted keys dealt by the ``bits`` bits above the last ``below``."""
    starts = np.arange((1 << bits) + 1, dtype=np.uint64)[:-1] << np.uint64(below)
    at = np.append(np.searchsorted(keys, starts), len(keys))
    for digit in np.flatnonzero(np.diff(at)):
        yield int(digit), int(at[digit]), int(at[digit + 1])


def asks(block: int, ordered: np.ndarray, route: Route, extra: Extra | None = None, values: np.ndarray | None = None) -> pa.Table:
    """One row for each part that ``ordered`` (sorted hashes of a block) reaches. ``values``: (n,) or (rows, n), with ``extra``."""
    keys = ordered >> np.uint64(64 - route.precision)
    below = route.below(1)
    out = []
    for digit, a, b in _cut(keys, route.bits, below):
        part = keys[a:b] - (np.uint64(digit) << np.uint64(below))
        out.append((route.group(block, 1), digit, [block], [packed(part, below)], [extra.pack(values[..., a:b]) if extra else b""]))
    return _rows(out, ASK)


def _forward(route: Route, hop: int, extra: Extra | None):
    """A router: the parts of ``hop`` digits that a group of blocks sent, dealt by the next digit."""

    def run(table: pa.Table) -> pa.Table:
        part, before, below = table["part"][0].as_py(), route.below(hop), route.below(hop + 1)
        out: dict[int, tuple] = {}
        blocks, keys, extras = (pc.list_flatten(table[c]).to_pylist() for c in ("blocks", "keys", "extras"))
        for block, k, x in zip(blocks, keys, extras, strict=True):
            held, values = unpacked(k, before), extra.open(x) if extra else None
            for digit, a, b in _cut(held, route.bits, below):
                row = out.setdefault(digit, (route.group(blocks[0], hop + 1), (part << route.bits) + digit, [], [], []))
                row[2].append(block)
                row[3].append(packed(held[a:b] - (np.uint64(digit) << np.uint64(below)), below))
                row[4].append(extra.pack(values[:, a:b]) if extra else b"")
        return _rows(list(out.values()), ASK)

    return run


def _framed(parts: list[bytes]) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def frames(held: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(held):
        end = at + 4 + int.from_bytes(held[at : at + 4], "little")
        yield held[at + 4 : end]
        at = end


def _back(route: Route, hop: int, round_: int, parts: list[int], blocks: list[list[int]], replies: list[list[bytes]]) -> pa.Table:
    """Answers for parts of ``hop`` digits, on to the routers of ``hop`` - 1 digits, or to the blocks."""
    if hop == 1:
        flat = [(b, p, r) for p, bs, rs in zip(parts, blocks, replies, strict=True) for b, r in zip(bs, rs, strict=True)]
        return pa.table({"block": pa.array([x[0] for x in flat], pa.int64()), "round": pa.array([round_] * len(flat), pa.int32()), "part": pa.array([x[1] for x in flat], pa.int64()), "reply": pa.array([x[2] for x in flat], pa.binary())})
    out: dict[tuple[int, int], tuple] = {}
    for p, bs, rs in zip(parts, blocks, replies, strict=True):
        for b, r in zip(bs, rs, strict=True):
            to = route.group(b, hop - 1)
            row = out.setdefault((to, p), (to, p, [], []))
            row[2].append(b)
            row[3].append(r)
    return _rows(list(out.values()), REPLY)


def _merge(route: Route, hop: int, round_: int):
    """A router on the way back: joins the answers for a group's blocks by the last digit."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        part = table["part"][0].as_py() >> route.bits
        held: dict[int, list[bytes]] = {}
        for bs, rs in zip(table["blocks"].to_pylist(), table["replies"].to_pylist(), strict=True):
            for b, r in zip(bs, rs, strict=True):
                held.setdefault(b, []).append(r)
        return _back(route, hop, round_, [part], [list(held)], [[b"".join(x) for x in held.values()]])

    return run


Reply = Callable[[list[np.ndarray], list[np.ndarray]], list[bytes]]


def answer(asked: DataFrame, route: Route, round_: int, reply: Reply, extra: Extra | None = None) -> DataFrame:
    """Lets ``reply`` see all keys (32 bits and up) and values that one shard got, and answer each block (ANSWER)."""
    for hop in range(1, route.hops):
        asked = asked.groupBy("to", "part").applyInArrow(_forward(route, hop, extra), ASK)

    def one(table: pa.Table) -> pa.Table:
        blocks, keys, extras = (table[c].to_pylist() for c in ("blocks", "keys", "extras"))
        held = [unpacked(k, route.below(route.hops)) for ks in keys for k in ks]
        got = iter(reply(held, [extra.open(x) for xs in extras for x in xs] if extra else []))
        return _back(route, route.hops, round_, table["part"].to_pylist(), blocks, [[_framed([next(got)]) for _ in bs] for bs in blocks])

    out = asked.groupBy("part").applyInArrow(one, ANSWER if route.hops == 1 else REPLY)
    for hop in range(route.hops - 1, 0, -1):
        out = out.groupBy("to", F.shiftright("part", route.bits)).applyInArrow(_merge(route, hop, round_), ANSWER if hop == 1 else REPLY)
    return out


def replies(answers: pa.Table, round_: int, kind: str, rows: int = 1) -> np.ndarray:
    """The answers to a block's asks of one round, in the order of its sorted hashes. kind: bits, or sparse in ``rows`` rows."""
    mine = answers.filter(pc.equal(answers["round"], round_)).sort_by("part")
    parts = [x for held in mine["reply"].to_pylist() for x in frames(held)]
    if kind == "bits":  # the first byte tells how many bits of the last byte are padding
        held = [np.frombuffer(opened(x), np.uint8) for x in parts]
        bits = [np.unpackbits(x[1:])[: 8 * (len(x) - 1) - int(x[0])] for x in held]
        return np.concatenate(bits) if bits else np.zeros(0, np.uint8)
    out = np.concatenate([dense(x, rows) for x in parts], 1) if parts else np.zeros((rows, 0), np.int64)
    return out if rows > 1 else out[0]


def as_bits(flags: np.ndarray) -> bytes:
    return squeezed(bytes([-len(flags) % 8]) + np.packbits(flags).tobytes())


def split_at(values: np.ndarray, parts: list[np.ndarray]) -> list[np.ndarray]:
    """``values`` of all keys (along the last axis) dealt back to the parts that the keys came in."""
    return np.split(values, np.cumsum([len(p) for p in parts])[:-1], -1)


def repeated(parts: list[np.ndarray], _: list[np.ndarray]) -> list[bytes]:
    """Bits: whether another block asked for the same key."""
    held = np.concatenate(parts)
    order = np.argsort(held, kind="stable")
    same = np.zeros(len(held) + 1, bool)
    same[1:-1] = held[order][1:] == held[order][:-1]
    flags = np.empty(len(held), bool)
    flags[order] = same[1:] | same[:-1]
    return [as_bits(x) for x in split_at(flags, parts)]


def ordered_unique(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, the sorting permutation, and where each distinct value's run begins in it."""
    order = np.argsort(values, kind="stable")
    run = values[order]
    first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else np.zeros(0, np.int64)
    return run[first], order, first
