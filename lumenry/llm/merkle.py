"""A Merkle manifest of a table: a tree for each source, a tree over the sources, and an inclusion proof of each row.

Leaves are sorted by ranges of (source, id) into numbered partitions, so a leaf's position
in its tree is known from counts alone, and a source of any size lies in as many partitions
as it needs. Each partition pushes its leaves on a stack, a mountain range: the sixteenth
node of a run carries, as one node, to the level above. Runs that lie in one partition
whole, and the last, short run of a tree, are done there; nodes of runs that begin or end in another
partition (fewer than sixteen at each end and level) are sent to be merged, one level after the
other, by columns expressions. Afterwards each partition gets the merged runs at its ends and
walks from each leaf to the root.
"""

from __future__ import annotations

import hashlib
import string
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B

FANOUT = 16
LEAVES, LEAST = 1 << 18, 1 << 10  # of a partition: at most, about; at least, if there are that many
EDGES = "key string, level int, pos long, node string, width long"
PATHS = "leaf_key string, above array<array<string>>, places array<int>"
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(nodes: Iterable[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def width(leaves: int, level: int) -> int:
    """Nodes of a level of a tree."""
    for _ in range(level):
        leaves = -(-leaves // FANOUT)
    return leaves


def height(leaves: int) -> int:
    n = 0
    while leaves > 1:
        leaves, n = -(-leaves // FANOUT), n + 1
    return n


class Mountains:
    """A stack over the leaves ``start``, ``start`` + 1, ... of a tree of ``total`` leaves.

    runs: the nodes of each run that is known whole, by (level, number of the run).
    edges: (level, position, node) of nodes whose run has nodes elsewhere. top: the root, if it is known.
    """

    def __init__(self, start: int, total: int, leaves: Iterable[str] = ()):
        self.start, self.total = start, total
        self.stack: list[list] = []
        self.runs: dict[tuple[int, int], list[str]] = {}
        self.edges: list[tuple[int, int, str]] = []
        self.top: str | None = None
        for leaf in leaves:
            self.push(leaf)
        level = 0
        while level < len(self.stack):
            if self.stack[level][1]:
                self._close(level)
            level += 1

    def push(self, node: str, level: int = 0) -> None:
        if level == len(self.stack):
            self.stack.append([-(-self.start // FANOUT**level), [], width(self.total, level)])
        held = self.stack[level]
        if held[2] == 1:
            self.top = node
            return
        held[1].append(node)
        if (held[0] + len(held[1])) % FANOUT == 0:
            self._close(level)

    def _close(self, level: int) -> None:
        first, nodes, of_level = self.stack[level]
        self.stack[level][:2] = first + len(nodes), []
        if first % FANOUT == 0 and (len(nodes) == FANOUT or first + len(nodes) == of_level):
            self.runs[level, first // FANOUT] = nodes
            self.push(digest(nodes), level + 1)
        else:
            self.edges += [(level, first + k, node) for k, node in enumerate(nodes)]

    def path(self, level: int, pos: int) -> list[tuple[list[str], int]]:
        """(run, place in it) of the node and of all above it but the root."""
        out = []
        while width(self.total, level) > 1:
            out.append((self.runs[level, pos // FANOUT], pos % FANOUT))
            level, pos = level + 1, pos // FANOUT
        return out


@dataclass
class Trees:
    """held: (part, seq, key, digest, ...), the leaves by partition. spans: (part, key, start, n, total), the leaves of a tree in a partition.
    met: (part, key, level, run, nodes), the merged runs that a span begins or ends in. tops: (key, node), the root of each tree."""

    held: DataFrame
    spans: DataFrame
    met: DataFrame
    tops: DataFrame


def _tagged(batches):
    """Each row's partition, and its place there."""
    from pyspark import TaskContext

    part, seen = TaskContext.get().partitionId(), 0
    for batch in batches:
        tags = [pa.array([part] * batch.num_rows, pa.int32()), pa.array(range(seen, seen + batch.num_rows), pa.int64())]
        yield pa.RecordBatch.from_arrays([*tags, *batch.columns], names=["part", "seq", *batch.schema.names])
        seen += batch.num_rows


def _of_key(table: pa.Table, info: pa.Table):
    """(row of ``info``, the key's rows in order) for each key of a partition."""
    table = table.sort_by("seq")
    told = {row["key"]: row for row in info.to_pylist()}
    keys = table["key"].to_pylist()
    begin = 0
    for k in range(1, len(keys) + 1):
        if k == len(keys) or keys[k] != keys[begin]:
            yield told[keys[begin]], table.slice(begin, k - begin)
            begin = k


def _stacked(table: pa.Table, spans: pa.Table) -> pa.Table:
    rows = []
    for span, mine in _of_key(table, spans):
        done = Mountains(span["start"], span["total"], mine["digest"].to_pylist())
        rows += [(span["key"], level, pos, node, width(span["total"], level)) for level, pos, node in done.edges]
        if done.top is not None:
            rows.append((span["key"], height(span["total"]), 0, done.top, 1))
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64())
    return pa.table([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=["key", "level", "pos", "node", "width"])


def _bucketed(df: DataFrame, by: str, buckets: int) -> DataFrame:
    """``df`` as a table in the shared folder, bucketed by a column."""
    spark = df.sparkSession
    name, path = f"lumenry_{uuid.uuid4().hex}", B.shared_folder(spark)
    B.made_table(spark, name, path)
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, by).saveAsTable(name)
    return spark.table(name)


def trees(leaves: DataFrame, order: list[str], per_part: int = LEAVES) -> Trees:
    """A tree for each key of ``leaves`` (key, digest, ...), whose leaves stand in ``order``, equal ones by digest."""
    spark = leaves.sparkSession
    size = leaves.count()
    parts = max(1, -(-size // per_part), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // LEAST)))
    tied = leaves.withColumn("tie", F.monotonically_increasing_id())  # so that any number of equal rows can be dealt
    by = [F.asc_nulls_first(c) for c in ("key", *order, "digest")]
    dealt = tied.repartitionByRange(parts, *by, "tie").sortWithinPartitions(*by).drop("tie")
    schema = f"part int, seq long, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in dealt.schema)}"
    held = _bucketed(dealt.mapInArrow(_tagged, schema), "part", min(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    counts = held.groupBy("part", "key").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("key")
    before = F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = B.written(counts.select("part", "key", before.alias("start"), "n", F.sum("n").over(whole).alias("total")))
    edges = B.written(held.groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(_stacked, EDGES))
    tops, found, carried = [edges.filter("width = 1").select("key", "node")], [], None
    levels = height(spans.agg(F.coalesce(F.max("total"), F.lit(0))).first()[0])
    for level in range(levels if edges.filter("width > 1").limit(1).count() else 0):
        now = edges.filter((F.col("level") == level) & (F.col("width") > 1)).select("key", "pos", "node", "width")
        now = now if carried is None else now.unionByName(carried.filter("width > 1"))
        nodes = F.sort_array(F.collect_list(F.struct("pos", "node")))["node"]  # sixteen at most
        run = B.written(now.groupBy("key", F.floor(F.col("pos") / FANOUT).alias("run")).agg(nodes.alias("nodes"), F.max("width").alias("width")))
        carried = run.select("key", F.col("run").alias("pos"), F.sha2(F.array_join("nodes", ""), 256).alias("node"), F.ceil(F.col("width") / FANOUT).alias("width"))
        found.append(run.select("key", F.lit(level).alias("level"), "run", "nodes"))
        tops.append(carried.filter("width = 1").select("key", "node"))
    return Trees(held, spans, _met(spans, found), _union(tops))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


def _met(spans: DataFrame, found: list[DataFrame]) -> DataFrame:
    if not found:
        return spans.select("part", "key", F.lit(0).alias("level"), F.lit(0).cast("long").alias("run"), F.array().cast("array<string>").alias("nodes")).limit(0)
    ends = [F.col("start"), F.col("start") + F.col("n") - 1]

    def at(level: int) -> Column:  # the runs of a level over a span's first and last leaf
        return F.array_distinct(F.array(*[F.floor(e / F.lit(FANOUT ** (level + 1))) for e in ends]))

    asked = [spans.select("part", "key", F.lit(level).alias("level"), F.explode(at(level)).alias("run")) for level in range(len(found))]
    return _union(asked).join(_union(found), ["key", "level", "run"])


def _info(t: Trees, more: DataFrame | None = None) -> DataFrame:
    """The spans with their merged runs, and what ``more`` tells of a tree."""
    met = t.met.groupBy("part", "key").agg(F.collect_list(F.struct("level", "run", "nodes")).alias("met"))  # two a level at most
    out = t.spans.join(met, ["part", "key"], "left")
    return out if more is None else out.join(more, "key")


def _walks(table: pa.Table, info: pa.Table):
    """(row of ``info``, mountains that know all runs over the span, the key's rows)."""
    for span, mine in _of_key(table, info):
        walk = Mountains(span["start"], span["total"], mine["digest"].to_pylist())
        walk.runs |= {(m["level"], m["run"]): m["nodes"] for m in span["met"] or []}
        yield span, walk, mine


def _paths(table: pa.Table, info: pa.Table) -> pa.Table:
    rows = []
    for span, walk, mine in _walks(table, info):
        for k, leaf in enumerate(mine["leaf_key"].to_pylist()):
            path = walk.path(0, span["start"] + k)
            rows.append((leaf, [nodes for nodes, _ in path], [place for _, place in path]))
    kinds = (pa.string(), pa.list_(pa.list_(pa.string())), pa.list_(pa.int32()))
    return pa.table([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=["leaf_key", "above", "places"])


def _beside(run: list[str], place: int) -> tuple[str, str]:
    return "".join(run[:place]), "".join(run[place + 1 :])


def _proved(table: pa.Table, info: pa.Table) -> pa.Table:
    out: dict[str, list] = {c: [] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root")}
    for span, walk, mine in _walks(table, info):
        ids, leaves, altered = (mine[c].to_pylist() for c in ("doc_id", "digest", "altered"))
        over = [_beside(run, place) for run, place in zip(span["above"], span["places"], strict=True)]
        run_of, steps = None, []
        for k, (leaf, other) in enumerate(zip(leaves, altered, strict=True)):
            pos = span["start"] + k
            if pos // FANOUT != run_of:  # what stands above a run is the same for its leaves
                run_of = pos // FANOUT
                steps = [_beside(run, place) for run, place in walk.path(1, run_of)] + over
                tail = "".join(a + b for a, b in steps)
            own = [_beside(walk.runs[0, run_of], pos % FANOUT)] if span["total"] > 1 else []
            folded = other or leaf
            for before, after in own + steps:
                folded = digest((before, folded, after))
            out["proof_sha256"].append(digest((*(x for pair in own for x in pair), tail)))
            out["folded_root"].append(folded)
        out["doc_id"] += ids
        out["leaf"] += leaves
        out["subroot"] += [span["subroot"]] * len(ids)
        out["root"] += [span["root"]] * len(ids)
    same = pa.array([a == b for a, b in zip(out["folded_root"], out["root"], strict=True)], pa.bool_())
    return pa.table({"doc_id": pa.array(out.pop("doc_id"), pa.int64()), **{c: pa.array(v, pa.string()) for c, v in out.items()}, "verified": same})


def field(value: Column) -> Column:
    """UTF-8 byte count, ``:``, value; ``-`` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def manifest(docs: DataFrame, tampered: Column | None = None, per_part: int = LEAVES) -> DataFrame:
    """Each row's leaf, its source's root, the table's root, its proof, and whether a copy of the row still folds to the root.

    A leaf is the sha256 of the fields doc_id, source, lang, n_chars and text, each as
    ``field`` gives it. Leaves of a source ascend by doc_id; runs of sixteen nodes, the last of
    them shorter, become the sha256 of their digests in hex, level by level, until one is
    left. The roots of the sources, in order of their UTF-8 bytes, make a tree in the same way. proof_sha256 is the
    digest of a leaf's siblings at all levels, from left to right. folded_root is made from the
    row's copy and those siblings; the copy has its text's A-Z lower-cased where ``tampered``
    (as it stands: where 5 divides the crc32 of doc_id) says so.

    A null source is one source, before all others and apart from an empty one; a null doc_id
    stands before all others and isn't tampered with; a null text stays null. Rows of one source and doc_id stand in
    order of their leaves, so the roots don't depend on how rows are stored. Other columns are not
    read. An empty table gives an empty result.
    """
    if tampered is None:
        tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lower = F.translate(F.col("text"), string.ascii_uppercase, string.ascii_lowercase)
    leaf = F.sha2(F.concat(*[field(F.col(c)) for c in FIELDS]), 256)
    other = F.sha2(F.concat(*[field(F.col(c)) for c in FIELDS[:-1]], field(lower)), 256)
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    leaves = B.written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), leaf.alias("digest"), F.when(tampered, other).alias("altered")))
    low = trees(leaves, ["doc_id"], per_part)
    high = trees(B.written(low.tops.select(F.lit("").alias("key"), F.col("key").alias("leaf_key"), F.col("node").alias("digest"))), ["leaf_key"], per_part)
    paths = high.held.groupBy("part").cogroup(_info(high).groupBy("part")).applyInArrow(_paths, PATHS)
    root = high.tops.select(F.col("node").alias("root"))  # one row at most
    upper = low.tops.select("key", F.col("node").alias("subroot")).join(paths.withColumnRenamed("leaf_key", "key"), "key").join(F.broadcast(root))
    return low.held.groupBy("part").cogroup(_info(low, upper).groupBy("part")).applyInArrow(_proved, RESULT)
