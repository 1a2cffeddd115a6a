"""Operator 9: exact top-k inner products by multi-resolution segment statistics.

The inner product is (|q|^2 + |v|^2 - |q - v|^2) / 2, so a lower bound of the distance
bounds the score from above. Over segments of equal length, the distance is at least
length * ((difference of means)^2 + (difference of deviations)^2). Each pair goes through
the resolutions from one segment to segments of two components, until a bound falls below
the query's k-th score; exact scores are computed for what survives all of them.

Two things make the bounds tighter, neither changes a result: components are rotated to
the main axes of a sample (distances stay, segments become uneven), and each query knows
from a first block of candidates what its k-th score is at least.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 4096  # vectors of a block, about
QUERY_BLOCKS, ROW_BLOCKS = 4, 16  # blocks that meet in one task
QUERIES, ROWS = 2048, 1024  # of them, those compared at once
EXACT = 2.0**53  # doubles hold integers up to here
LEAST, MOST = -(2**63), 2**63 - 1
_BLOCK = "block long, dims int, large boolean, ids binary, vectors binary, known binary"


def sound(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part."""
    x = F.col(vector_col).cast("array<double>")
    whole = F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(whole, x).alias("v")).filter("v IS NOT NULL")


def scaled(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as doubles that are integers; inf where that is beyond a double."""
    with np.errstate(over="ignore"):
        return np.floor(x * scale)


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """The same as Python's integers, of any size: a double beyond 2^53 is an integer."""
    return np.array([[int(np.floor(c * scale)) if abs(c) < EXACT else int(c) * scale for c in row] for row in x.tolist()], object).reshape(x.shape)


def _packed(rows: DataFrame, blocks: int, scale: int) -> DataFrame:
    """The rows dealt to ``blocks`` blocks by a hash, each one binary matrix for each vector length, large components apart."""

    def run(table: pa.Table) -> pa.Table:
        lists = table["v"].combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        flat, ids = lists.flatten().to_numpy(), table["vec_id"].to_numpy()
        known = table["known"].to_numpy() if "known" in table.column_names else np.full(len(ids), LEAST)
        top = np.maximum.reduceat(np.abs(scaled(flat, scale)), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        large = top * top * sizes >= EXACT / 4
        kinds = sorted(set(zip(sizes.tolist(), large.tolist(), strict=True)))
        chosen = [(sizes == d) & (large == b) for d, b in kinds]
        return pa.table(
            {
                "block": pa.array(np.full(len(kinds), table["block"][0].as_py())),
                "dims": pa.array([d for d, _ in kinds], pa.int32()),
                "large": pa.array([b for _, b in kinds], pa.bool_()),
                "ids": pa.array([ids[c].astype("<i8").tobytes() for c in chosen], pa.binary()),
                "vectors": pa.array([flat[np.repeat(c, sizes)].astype("<f8").tobytes() for c in chosen], pa.binary()),
                "known": pa.array([known[c].astype("<i8").tobytes() for c in chosen], pa.binary()),
            }
        )

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)))
    return dealt.groupBy("block").applyInArrow(run, _BLOCK)


def resolutions(dims: int) -> list[int]:
    """Numbers of segments, coarse to fine: the divisors of the length that double."""
    out = [1]
    while dims % (2 * out[-1]) == 0 and dims // (2 * out[-1]) >= 2:
        out.append(2 * out[-1])
    return out


def statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    parts = x.reshape(len(x), segments, -1)
    return parts.mean(2), parts.std(2)


def axes(sample: np.ndarray) -> np.ndarray:
    """An orthogonal matrix: the main axes of ``sample``, those of the largest spread first."""
    return np.linalg.svd(np.cov(sample.T).reshape(sample.shape[1], -1))[0] if len(sample) > 1 else np.eye(sample.shape[1])


def _best(both: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best ``k`` columns of each row by score, ties by name."""
    order = np.lexsort((names, -both), axis=1)[:, :k]
    return np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)


def search(queries, query_ids, known, rows, ids, k: int, turn: np.ndarray | None = None, told: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(query_id, vec_id, score) of the best ``k`` of ``rows`` for each query, its own id left out.

    Vectors are integers as doubles whose products stay exact. ``known``: a score that each
    query's k-th best reaches. ``told`` gets added up how many pairs each resolution saw,
    and at its end those that survived all.
    """
    q_norm, order = (queries * queries).sum(1), np.argsort(-(rows * rows).sum(1), kind="stable")
    rows, ids = rows[order], ids[order]  # large norms first, so the k-th score is good early on
    x_norm = (rows * rows).sum(1)
    turned_q, turned_x = (queries, rows) if turn is None else (queries @ turn, rows @ turn)
    slack = 1e-3 + 1e-9 * (q_norm.max(initial=0) + x_norm.max(initial=0))
    dims = queries.shape[1]
    levels = [(s, statistics(turned_q, s), statistics(turned_x, s)) for s in resolutions(dims)]
    best, best_id = np.full((len(queries), k), -np.inf), np.full((len(queries), k), MOST)
    for a in range(0, len(queries), QUERIES):
        b = min(a + QUERIES, len(queries))
        for c in range(0, len(rows), ROWS):
            d = min(c + ROWS, len(rows))
            least = np.maximum(best[a:b, -1], known[a:b]) - slack
            alive = query_ids[a:b, None] != ids[None, c:d]
            for level, (s, (qm, qd), (xm, xd)) in enumerate(levels):
                count = int(alive.sum())
                if told is not None:
                    told[level] += count
                if not count:
                    break
                length = dims / s
                if 8 * count > alive.size:  # most pairs are left: means and deviations of all as one product
                    q, x = np.concatenate([qm[a:b], qd[a:b]], 1), np.concatenate([xm[c:d], xd[c:d]], 1)
                    far = length * ((q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * (q @ x.T))
                    alive &= (q_norm[a:b, None] + x_norm[None, c:d] - far) / 2 >= least[:, None]
                else:
                    i, j = np.nonzero(alive)
                    far = length * (((qm[a + i] - xm[c + j]) ** 2).sum(1) + ((qd[a + i] - xd[c + j]) ** 2).sum(1))
                    alive[i, j] = (q_norm[a + i] + x_norm[c + j] - far) / 2 >= least[i]
            count = int(alive.sum())
            if told is not None:
                told[len(levels)] += count
            if not count:
                continue
            scores = np.full(alive.shape, -np.inf)
            i, j = np.nonzero(alive)
            if 8 * count > alive.size:
                scores[i, j] = (queries[a:b] @ rows[c:d].T)[i, j]
            else:
                scores[i, j] = np.einsum("ij,ij->i", queries[a + i], rows[c + j])
            scores[scores < least[:, None]] = -np.inf
            some = np.flatnonzero((scores > -np.inf).any(1))
            if len(some):
                width = min(d - c, max(k, int((scores[some] > -np.inf).sum(1).max())))
                part = np.argpartition(-scores[some], width - 1, axis=1)[:, :width] if width < d - c else np.broadcast_to(np.arange(d - c), (len(some), d - c))
                both = np.concatenate([best[a + some], np.take_along_axis(scores[some], part, 1)], 1)
                names = np.concatenate([best_id[a + some], ids[c:d][part]], 1)
                best[a + some], best_id[a + some] = _best(both, names, k)
    found = best > -np.inf
    return np.repeat(query_ids, found.sum(1)), best_id[found], best[found].astype(np.int64)


def search_large(queries, query_ids, rows, ids, k: int, scale: int) -> tuple[np.ndarray, ...]:
    """As ``search``, of unscaled vectors with components so large that products aren't exact in doubles.

    Scores of doubles, with what rounding can make of them, tell which rows may be among
    the best; their scores are then computed in Python's integers, and held within a long.
    """
    down = 2.0 ** -np.ceil(np.log2(np.maximum(np.abs(rows).max(), np.finfo(float).tiny)))
    x = rows * down
    norms = np.sqrt((x * x).sum(1))
    out = []
    for query, name in zip(queries, query_ids, strict=True):
        others = np.flatnonzero(ids != name)
        up = 2.0 ** -np.ceil(np.log2(np.maximum(np.abs(query).max(), np.finfo(float).tiny)))
        y = query * up
        near = x[others] @ y
        # floors move each component by 1 / scale at most
        room = (1e-12 * np.sqrt((y * y).sum()) * norms[others] * len(y)) + _moved(rows[others], y, up, down, scale)
        least = -np.partition(-(near - room), k - 1)[k - 1] if len(others) >= k else -np.inf
        most = 2.0**63 * up * down / scale / scale * (1 - 1e-9)  # scores beyond are alike
        least = -np.inf if least <= -most else min(least, most)
        may = others[near + room >= least]
        q = integers(query[None, :], scale)[0]
        scores = [min(max(int(s), LEAST), MOST) for s in (integers(rows[may], scale) * q).sum(1)] if len(may) else []
        out += [(name, int(ids[at]), s) for s, at in sorted(zip(scores, may, strict=True), key=lambda p: (-p[0], ids[p[1]]))[:k]]
    return tuple(np.array(c, np.int64) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def _moved(rows: np.ndarray, y: np.ndarray, up: float, down: float, scale: int) -> np.ndarray:
    """How far floors can move a score, in the units of ``y`` (a query times ``up``) and of rows times ``down``."""
    return (np.abs(rows) * down).sum(1) * up / scale + (np.abs(y).sum() + len(y) * up / scale) * down / scale


def top_k(
    vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """The ``k`` vectors of the highest integer inner product with each query: query_id, rank (from 1), vec_id, score.

    Components become floor(``scale`` * x). Queries are the rows whose id is divisible by
    ``every``, candidates are all rows of the same length but the query's id; ties go to
    the smaller id. Blocks of queries meet blocks of candidates, and each meeting gives
    at most ``k`` rows for a query, ranked by a window that keeps the best ``k`` of each
    task before it shuffles.

    Null ids, null or empty vectors, and those with a null or non-finite component take no
    part. Finite vectors of any size do; a score beyond a long counts as the largest (or
    smallest) long. Rows that repeat an id are candidates of their own and may both be
    named; as queries they count once, by the first in order of their components. An empty
    table gives an empty result; other columns are not read.
    """
    rows = sound(vectors, id_col, vector_col)
    asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    n_rows, n_asked = (max(1, -(-x.count() // BLOCK_ROWS)) for x in (rows, asked))
    blocks = _packed(rows, n_rows, scale)
    first = blocks.filter("block = 0")
    turns = {}  # of one block of BLOCK_ROWS vectors: efficiency alone hangs on it
    for r in first.filter("NOT large").select("dims", "vectors").collect():
        turns[r.dims] = axes(scaled(np.frombuffer(r.vectors, "<f8").reshape(-1, r.dims)[:1024], scale))

    def meet(q: pa.Table, x: pa.Table) -> pa.Table:
        found = []
        for (dims, large), (_, q_ids, q_vectors, known) in _matrices(q):
            for (other, large_x), (_, ids, x_vectors, _) in _matrices(x):
                if other == dims and (large or large_x):
                    found.append(search_large(q_vectors, q_ids, x_vectors, ids, k, scale))
                elif other == dims:
                    found.append(search(scaled(q_vectors, scale), q_ids, known, scaled(x_vectors, scale), ids, k, turns.get(dims)))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
        return pa.table([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

    def met(queries: DataFrame, candidates: DataFrame, groups: int) -> DataFrame:
        """The best of each group of candidate blocks for each query."""
        q_groups = -(-n_asked // QUERY_BLOCKS)
        every_of = lambda n, name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(name)
        group = lambda name, n: F.pmod(F.col("block"), F.lit(n)).alias(name)
        columns = ["dims", "large", "ids", "vectors", "known"]
        left = queries.select(group("qg", q_groups), every_of(groups, "xg"), *columns).groupBy("qg", "xg")
        right = candidates.select(group("xg", groups), every_of(q_groups, "qg"), *columns).groupBy("qg", "xg")
        return left.cogroup(right).applyInArrow(meet, "query_id long, vec_id long, score long")

    def ranked(near: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    floors = met(_packed(asked, n_asked, scale), first, 1).groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    least = F.coalesce(F.when(F.col("n") >= k, F.col("least")), F.lit(LEAST)).alias("known")
    informed = asked.join(floors, asked["vec_id"] == floors["query_id"], "left").select("vec_id", "v", least)
    # groups of ROW_BLOCKS blocks, or smaller ones where these would be too few for all tasks
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranked(met(_packed(informed, n_asked, scale), blocks, min(n_rows, max(-(-n_rows // ROW_BLOCKS), tasks))))


def _matrices(table: pa.Table):
    """((dims, large), (kind, ids, vectors, known)) of the blocks of a table, those of one kind put together."""
    held: dict[tuple, list] = {}
    for r in table.select(["dims", "large", "ids", "vectors", "known"]).to_pylist():
        held.setdefault((r["dims"], r["large"]), []).append(r)
    for kind, parts in held.items():
        ids, known = (np.concatenate([np.frombuffer(r[c], "<i8") for r in parts]) for c in ("ids", "known"))
        yield kind, (kind, ids, np.concatenate([np.frombuffer(r["vectors"], "<f8").reshape(-1, kind[0]) for r in parts]), known)
