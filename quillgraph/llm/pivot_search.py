"""Exact top-k inner-product search with pivot-table elimination.

Every candidate has a table of its distances to many pivots.  For a query, the largest
difference of distances to one pivot bounds the candidate's distance from below, and so
its inner product from above.  Candidates are evaluated in the order of that bound
until the next bound is under the k-th score found; what is left can't be in the result.

Candidates and queries are dealt out in blocks; each pair of a query block and a
candidate block is one row of an equi-join on their numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a candidate block at least, where there are fewer than ``BLOCKS`` of them; and of any block at most.
BLOCK, MOST = 4096, 1 << 17
BLOCKS = 64
#: Bytes of a block's vectors as long numbers, at most.
BLOCK_BYTES = 64 << 20
#: Candidates and queries whose products are taken at once.
TILE, CHUNK = 4096, 64
PIVOTS, _SAMPLE = 32, 512
#: Pivots that all candidates are held against; the others only while they leave out more than half, which is tried again each so many chunks.
FEW, TRIAL = 4, 16


def scaled(vector: Column, factor: int = 1024) -> Column:
    """floor(factor * x) of every component as long; null where a component is null or not finite."""
    good = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(good, F.transform(vector, lambda x: F.floor(F.lit(float(factor)) * x.cast("double")).cast("bigint")))


def _choose_pivots(x: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first pivots of a sample."""
    far = ((x - x.mean(axis=0)) ** 2).sum(axis=1)
    chosen: list[int] = []
    for _ in range(min(n, len(x))):
        i = int(far.argmax())
        chosen.append(i)
        far = np.minimum(far, ((x - x[i]) ** 2).sum(axis=1))
    return x[chosen]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """By differences: squares of norms would drown a small distance between long vectors."""
    out = np.empty((len(x), len(pivots)))
    for j, p in enumerate(pivots):
        out[:, j] = np.sqrt(((x - p) ** 2).sum(axis=1))
    return out


class _Bounds:
    """Lower bounds of distances by pivots: the largest sure difference of distances to one pivot.

    Distances are kept in single precision and come from vectors rounded to doubles; what
    that and single arithmetic can take away (in proportion to the distances themselves,
    which a far pivot makes long, and to the vectors' norms) is taken off each difference
    before the largest is chosen.
    """

    def __init__(self, cd: np.ndarray, c_norm: np.ndarray):
        self.cd = np.ascontiguousarray(cd.T, dtype=np.float32)
        self.slack = self.cd * np.float32(2.0**-20)
        self.norm = 2.0**-40 * c_norm
        self.room = np.empty_like(self.cd)

    def lowest(self, qd: np.ndarray, q_norm: float, pivots: int) -> np.ndarray:
        """For each candidate the least distance it can have from the query, by the first pivots."""
        if not len(self.cd):
            return np.zeros(len(self.norm))
        x, room = qd[:pivots].astype(np.float32)[:, None], self.room[:pivots]
        np.subtract(self.cd[:pivots], x, out=room)
        np.abs(room, out=room)
        room -= self.slack[:pivots]
        room -= x * np.float32(2.0**-20)
        return np.maximum(room.max(axis=0) - self.norm - 2.0**-40 * q_norm, 0)


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as they need; the first byte tells how many."""
    kind = next(k for k in ("<i2", "<i4", "<i8") if not x.size or np.iinfo(k).min <= x.min() and x.max() <= np.iinfo(k).max)
    return kind[2:].encode() + x.astype(kind).tobytes()


def _wide(raw: bytes, rows: int) -> np.ndarray:
    x = np.frombuffer(raw, f"<i{raw[:1].decode()}", offset=1)
    return x.reshape(rows, -1 if len(x) else 0).astype(np.int64)


def _products(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of rows with a vector: in doubles where those hold every sum."""
    most = (int(np.abs(c).max(initial=0)) + 1) * (int(np.abs(q).max(initial=0)) + 1) * max(len(q), 1)
    return (c.astype(np.float64) @ q.astype(np.float64)).astype(np.int64) if most < 1 << 52 else c @ q


def _blocks(vectors: DataFrame, n: int) -> DataFrame:
    """One row for each block: ids and vectors, packed."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        x = np.asarray(group.column("v").combine_chunks().flatten(), dtype=np.int64).reshape(group.num_rows, key[0].as_py())
        ids = np.asarray(group.column("vec_id"), dtype=np.int64)
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "x": pa.array([_narrow(x)], pa.binary())})

    dealt = vectors.select(F.size("v").alias("dim"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int").alias("block"), "vec_id", "v")
    return dealt.groupBy("dim", "block").applyInArrow(run, "dim int, block int, ids binary, x binary")


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        high = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        ids, scores = ids[high], scores[high]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def search_block(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, pivots: np.ndarray, k: int, least: dict[int, int] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """For each query its k best candidates of a block (ids and scores), its own id left out, and how many passed their bounds.

    ``least`` has scores that k candidates of a query are known to reach; worse ones are left out.
    """
    least = {} if least is None else least
    none = np.zeros(0, np.int64)
    found, evaluated = [(none, none)] * len(q), [0] * len(q)
    floors = [least.get(i) for i in q_ids.tolist()]
    qf, held, turn = q.astype(np.float64), len(pivots), 0
    qd, q_norm, q_most = _distances(qf, pivots), (qf**2).sum(axis=1), np.abs(q).max(axis=1, initial=0)
    for low in range(0, len(c), TILE):
        tile, ids = c[low : low + TILE], c_ids[low : low + TILE]
        cf = tile.astype(np.float64)
        c_norm, c_most = (cf**2).sum(axis=1), int(np.abs(tile).max(initial=0))
        near = _Bounds(_distances(cf, pivots), np.sqrt(c_norm))
        for first in range(0, len(q), CHUNK):
            chunk = range(first, min(first + CHUNK, len(q)))
            may = np.empty((len(chunk), len(tile)), dtype=bool)
            turn += 1
            trial = turn % TRIAL == 0
            for n, i in enumerate(chunk):
                norms = q_norm[i] + c_norm
                bound = (norms - near.lowest(qd[i], float(np.sqrt(q_norm[i])), len(pivots) if trial else held) ** 2) / 2
                bound += 1e-6 * norms + 1e-6  # more than rounding can take away
                np.greater_equal(bound, -np.inf if floors[i] is None else floors[i], out=may[n])
                may[n] &= ids != q_ids[i]
            if trial:
                held = FEW if 2 * np.count_nonzero(may) > may.size else len(pivots)
            some = np.flatnonzero(may.any(axis=0))
            # Doubles hold every sum of nearly all; the others are multiplied by themselves.
            small = (c_most + 1) * (int(q_most[first : first + len(chunk)].max(initial=0)) + 1) * max(q.shape[1], 1) < 1 << 52
            products = (cf if len(some) == len(cf) else cf[some]) @ qf[first : first + len(chunk)].T if small and len(some) else None
            for n, i in enumerate(chunk):
                own = may[n][some]
                evaluated[i] += int(np.count_nonzero(own))
                if products is not None:
                    if floors[i] is not None:
                        own &= products[:, n] >= floors[i]
                    at = np.flatnonzero(own)
                    scores = products[at, n].astype(np.int64)
                else:
                    at = np.flatnonzero(own)
                    scores = _products(tile[some[at]], q[i])
                if not len(at):
                    continue
                got = _best(np.concatenate([found[i][0], ids[some[at]]]), np.concatenate([found[i][1], scores]), k)
                found[i] = got
                if len(got[1]) >= k:
                    floors[i] = int(got[1][-1]) if floors[i] is None else max(floors[i], int(got[1][-1]))
    for i, own in enumerate(q_ids.tolist()):
        if floors[i] is not None:
            least[own] = max(floors[i], least.get(own, floors[i]))
        yield own, *found[i], evaluated[i]


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", factor: int = 1024, counted: bool = False) -> DataFrame:
    """The k best rows of each query: ``query_id, rank, vec_id, score``; with ``counted`` also the candidates ``evaluated`` for it,
    those whose bounds reached the k-th score at the time.

    Components become floor(factor * x); the score is the integer inner product (it must
    fit 64 bits), ties go to the smaller id.  Rows with a query's own id are left out of
    its result.  Null vectors, and those with null or non-finite components, take no
    part; nor do null ids.  Empty vectors score 0 with each other.  Only vectors of the
    query's length are its candidates.  A repeated row is a candidate each time, and a
    repeated query id has one result, that of all its rows together.
    """
    rows = vectors.select(vectors[id_col].cast("bigint").alias("vec_id"), scaled(vectors[vector_col], factor).alias("v"), is_query.alias("is_query")).filter("vec_id is not null and v is not null")
    total, asked, parts = rows.agg(F.count(F.lit(1)), F.count_if("is_query"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    sample: dict[int, list[list[int]]] = {}
    for r in rows.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(_SAMPLE).collect():
        sample.setdefault(len(r["v"]), []).append(r["v"])
    pivots = {dim: _choose_pivots(np.array(x, dtype=np.float64), PIVOTS) for dim, x in sample.items() if dim}
    most = min(MOST, max(BLOCK_BYTES * max(total, 1) // (8 * max(parts, 1)), 1))
    n_c, n_q = max(-(-total // most), min(-(-total // BLOCK), BLOCKS), 1), max(1, -(-asked // most))
    candidates = _blocks(rows.select("vec_id", "v"), n_c).withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    queries = _blocks(rows.filter("is_query").select("vec_id", "v"), n_q).withColumnRenamed("block", "q_block").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))))
    names = ["query_id", "vec_id", "score", "block", "evaluated"]
    least: dict[int, int] = {}  # a task's later blocks profit from its earlier ones

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if len(least) > 1 << 20:
            least.clear()
        found = []
        if left.num_rows and right.num_rows:  # one row each
            (c_ids, c), (q_ids, q) = ((np.frombuffer(t.column("ids")[0].as_py(), np.int64), t.column("x")[0].as_py()) for t in (left, right))
            dim = key[0].as_py()
            found = list(search_block(q_ids, _wide(q, len(q_ids)), c_ids, _wide(c, len(c_ids)), pivots.get(dim, np.zeros((0, dim))), k, least))
        sizes = [len(f[1]) for f in found]
        joined = [np.concatenate([np.zeros(0, np.int64), *(f[j] for f in found)]) for j in (1, 2)]
        repeated = lambda j: np.repeat(np.array([f[j] for f in found], dtype=np.int64), sizes)
        return pa.table([repeated(0), *joined, np.full(sum(sizes), key[1].as_py(), np.int32), repeated(3)], names=names)

    on = ["dim", "block", "q_block"]
    pairs = candidates.select(*on, "ids", "x").groupBy(*on).cogroup(queries.select(*on, "ids", "x").groupBy(*on))
    found = pairs.applyInArrow(run, "query_id long, vec_id long, score long, block int, evaluated long")
    if counted:
        spent = found.select("query_id", "block", "evaluated").distinct().groupBy("query_id").agg(F.sum("evaluated").alias("evaluated"))
    order = [F.desc("score"), F.asc("vec_id")]
    groups = n_c
    while groups > 64:  # few rows of a query meet at once, however many blocks there are
        found = found.withColumn("block", F.expr("cast(block div 64 as int)"))
        found = found.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "block").orderBy(*order))).filter(F.col("n") <= k).drop("n")
        groups = -(-groups // 64)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    best = found.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
    return best.join(spent, "query_id") if counted else best
