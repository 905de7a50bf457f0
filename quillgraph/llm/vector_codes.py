"""Product codes of vectors: nearest codebook entries by exponion search, exact in integers.

A part that had entry ``a`` at squared distance ``u`` can only be as near to an entry
within twice that distance of ``a``, that is where the squared distance of the entries
is at most ``4 u``.  Entries are listed for each entry by their distance to it, so the
search starts at the previous entry and reads a prefix of its list.  All comparisons
are of integers; ties go to the lower index.

Each round is one pass: tasks assign parts, keep the codes beside the vectors for the
next round, and sum up the parts of each entry.  Only these sums, a fixed number, meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import forget, written

#: Bits of a sum that one row carries; longer sums have more rows.
_LIMB = 62
_MOST = (1 << 63) - 1
#: Vectors assigned at once.
_AT_ONCE = 1024


def whole(x: np.ndarray, factor: int = 256) -> np.ndarray:
    """floor(factor * x) of finite doubles: 64-bit integers, or Python's where those don't hold them."""
    if not x.size or np.abs(x).max() * factor < 2.0**62:
        return np.floor(x * factor).astype(np.int64)
    # From 2^52 on doubles are whole, so that no product is rounded.
    return np.array([int(v) * factor if abs(v) >= 2.0**52 else int(np.floor(v * factor)) for v in x.ravel().tolist()], dtype=object).reshape(x.shape)


class Codebooks:
    """Entries of every part position, with each entry's list of the others by distance."""

    def __init__(self, entries: np.ndarray):
        #: parts x entries x width
        self.entries = entries
        parts, k, width = entries.shape
        self._most = int(np.abs(entries).max(initial=0))
        self._lists: dict[type, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def _of_type(self, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries by component (width x all entries), lists of entries, and the squared distances of those."""
        if kind not in self._lists:
            parts, k, width = self.entries.shape
            e = self.entries.astype(kind)
            apart = ((e[:, :, None, :] - e[:, None, :, :]) ** 2).sum(axis=3) if width else np.zeros((parts, k, k), kind)
            order = np.argsort(apart, axis=2, kind="stable")
            first = (np.arange(parts) * k)[:, None, None]
            self._lists[kind] = (
                np.ascontiguousarray(e.reshape(parts * k, width).T),
                (order + first).reshape(parts * k, k),
                np.take_along_axis(apart, order, axis=2).reshape(parts * k, k),
            )
        return self._lists[kind]

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest entries of vectors (n x parts x width) from entries to start at (n x parts), squared distances, and how many distances were worked out."""
        parts, k, width = self.entries.shape
        n = len(x)
        most = max(self._most, int(np.abs(x).max(initial=0)) if x.size else 0) + 1
        kind = np.int64 if 16 * max(width, 1) * most * most < 1 << 62 else object
        book, lists, apart = self._of_type(kind)
        flat = np.ascontiguousarray(x.astype(kind).reshape(n * parts, width).T)

        def distance(rows: np.ndarray | slice, entry: np.ndarray) -> np.ndarray:
            out = np.zeros(len(entry), dtype=kind)
            for j in range(width):
                d = flat[j, rows] - book[j, entry]
                out += d * d
            return out

        begun = (start.astype(np.int64) + np.arange(parts) * k).ravel()
        best, least = begun.copy(), distance(slice(None), begun)
        # How far each list must be read: entries within twice the distance to the first.
        reach = np.zeros(n * parts, dtype=np.int64)
        by_entry = np.argsort(begun, kind="stable")
        bounds = np.searchsorted(begun[by_entry], np.arange(parts * k + 1))
        for a in np.flatnonzero(np.diff(bounds)).tolist():
            rows = by_entry[bounds[a] : bounds[a + 1]]
            reach[rows] = np.searchsorted(apart[a], 4 * least[rows], side="right")
        order = np.argsort(-reach, kind="stable")
        open_ = np.searchsorted(-reach[order], -np.arange(k + 1), side="left")  # rows that read beyond a step
        for step in range(k):
            rows = order[: open_[step]]
            if not len(rows):
                break
            entry = lists[begun[rows], step]
            d = distance(rows, entry)
            better = (d < least[rows]) | ((d == least[rows]) & (entry < best[rows]))
            least[rows[better]], best[rows[better]] = d[better], entry[better]
        return (best.reshape(n, parts) - np.arange(parts) * k), least.reshape(n, parts), int(reach.sum())

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _pack(x: np.ndarray, raw: np.ndarray) -> list[bytes]:
    """Vectors as 16-bit integers where all fit, else as the doubles that they come from; the first byte tells which."""
    if not x.size or (x.dtype != object and np.abs(x).max() < 1 << 15):
        return [b"i" + v.tobytes() for v in x.astype("<i2")]
    return [b"d" + v.tobytes() for v in raw.astype("<f8")]


def _unpack(rows: list[bytes], width: int, factor: int) -> np.ndarray:
    kinds = {r[:1] for r in rows}
    if kinds <= {b"i"}:
        return np.frombuffer(b"".join(r[1:] for r in rows), "<i2").reshape(len(rows), width).astype(np.int64)
    parts = [np.frombuffer(r, "<i2", offset=1).astype(np.int64) if r[:1] == b"i" else whole(np.frombuffer(r, "<f8", offset=1), factor) for r in rows]
    out = np.empty((len(rows), width), dtype=object if any(p.dtype == object for p in parts) else np.int64)
    for i, p in enumerate(parts):
        out[i] = p
    return out


def _limbs(values: np.ndarray) -> list[np.ndarray]:
    """Integers as sums of limb i times 2^(62 i), each limb within 64 bits."""
    if values.dtype != object:
        return [values]
    out, left = [], values
    while True:
        if all(-(1 << _LIMB) <= v < 1 << _LIMB for v in left.tolist()):
            return [*out, left.astype(np.int64)]
        out.append(np.array([v & ((1 << _LIMB) - 1) for v in left.tolist()], dtype=np.int64))
        left = np.array([v >> _LIMB for v in left.tolist()], dtype=object)


class _Sums:
    """Sums and counts of the parts of each entry, as a task meets them."""

    def __init__(self, parts: int, k: int, width: int):
        self.k, self.total, self.counts = k, np.zeros((parts, k, width), dtype=object), np.zeros((parts, k), dtype=np.int64)
        self._near, self._room = np.zeros((parts, k, width), dtype=np.int64), 1 << 62

    def add(self, x: np.ndarray, codes: np.ndarray) -> None:
        parts, _, width = self.total.shape
        at = codes + np.arange(parts) * self.k
        self.counts += np.bincount(at.ravel(), minlength=parts * self.k).reshape(parts, self.k)
        most = int(np.abs(x).max(initial=0)) * len(x) if x.size else 0
        if x.dtype == object or most >= 1 << 53:  # beyond what doubles sum up exactly
            for i, p in np.ndindex(len(x), parts):
                self.total[p, codes[i, p]] += x[i, p].astype(object)
            return
        if most > self._room:
            self._settle()
        self._room -= most
        for j in range(width):
            self._near[:, :, j] += np.bincount(at.ravel(), weights=x[:, :, j].ravel(), minlength=parts * self.k).reshape(parts, self.k).astype(np.int64)

    def _settle(self) -> None:
        self.total += self._near.astype(object)
        self._near[:], self._room = 0, 1 << 62

    def rows(self) -> list[np.ndarray]:
        """One row for each limb: all sums, then all counts (with limb 0)."""
        self._settle()
        limbs = _limbs(self.total.ravel())
        return [np.concatenate([v, self.counts.ravel() if i == 0 else np.zeros(self.counts.size, np.int64)]) for i, v in enumerate(limbs)]


def _assign(vectors: DataFrame, book: Codebooks, shape: tuple[int, int, int], kinds: tuple[str, str], factor: int) -> DataFrame:
    """One round over vectors (first as ``vector``, later as ``x`` with ``code``): codes, and a row of sums for each task."""
    parts, k, width = shape
    first = "vector" in vectors.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, met = _Sums(parts, k, width), False
        names = ["vec_id", "label", "x", "code", "limb", "sums"]
        types = None
        for batch in batches:
            types = types or (batch.schema.field(0).type, batch.schema.field(1).type)
            for low in range(0, batch.num_rows, _AT_ONCE):
                some = batch.slice(low, _AT_ONCE)
                n = some.num_rows
                x, start, packed = _read(some, first, parts, width, factor)
                codes, _, _ = book.nearest(x, start)
                sums.add(x, codes)
                met = True
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), packed, pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int64()))],
                    names,
                )
        if met:
            rows = sums.rows()
            m = len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(m, types[0]), pa.nulls(m, types[1]), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()), pa.array(range(m), pa.int32()), pa.array([r.tolist() for r in rows], pa.list_(pa.int64()))],
                names,
            )

    return vectors.mapInArrow(run, f"vec_id {kinds[0]}, label {kinds[1]}, x binary, code binary, limb int, sums array<bigint>")


def _read(some: pa.RecordBatch, first: bool, parts: int, width: int, factor: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Vectors, the entries to start at, and the packed vectors of a batch."""
    n = some.num_rows
    if not first:
        x = _unpack(some.column(2).to_pylist(), parts * width, factor)
        start = np.frombuffer(b"".join(some.column(3).to_pylist()), np.uint8).reshape(n, parts)
        return x.reshape(n, parts, width), start, some.column(2)
    given = np.asarray(some.column(2).flatten(), dtype=np.float64).reshape(n, -1)
    raw = np.zeros((n, parts * width))
    raw[:, : given.shape[1]] = given
    x = whole(raw, factor)
    return x.reshape(n, parts, width), np.zeros((n, parts), np.uint8), pa.array(_pack(x, raw), pa.binary())


def _moved(book: Codebooks, sums: DataFrame) -> Codebooks:
    """Every used entry at the floor of its parts' mean."""
    shape = book.entries.shape
    rows = sums.select("limb", F.posexplode("sums").alias("at", "v")).groupBy("limb", "at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    total = [0] * (book.entries.size + shape[0] * shape[1])
    for r in rows:
        total[r["at"]] += int(r["v"]) << (_LIMB * r["limb"])
    counts = np.array(total[book.entries.size :], dtype=object).reshape(shape[:2])
    values = np.array(total[: book.entries.size], dtype=object).reshape(shape)
    used = counts > 0
    entries = book.entries.astype(object)
    entries[used] = values[used] // counts[used][:, None]
    small = not entries.size or max(map(abs, entries.ravel().tolist())) < 1 << 62
    return Codebooks(entries.astype(np.int64) if small else entries)


def _long(value: F.Column) -> F.Column:
    return F.least(value, F.lit(_MOST).cast("decimal(38,0)")).cast("bigint")


def compress(
    vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, factor: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """Codes of vectors: ``vec_id, code, error, label_error, codebooks_sha256``.

    Components become floor(factor * x); vectors are cut into ``parts`` equal parts (the
    last ones filled up with zeros where the length is no multiple).  Codebooks start as
    the parts of the ``entries`` smallest ids (at most 256) and move ``rounds`` times;
    ``code`` has two hex digits a part, ``error`` is the sum of the squared distances and
    ``label_error`` that sum over all rows of the label, null labels together.

    Null vectors, and those with null or non-finite components, take no part; nor do
    vectors of another length than that of the smallest id.  Null ids come after all
    others, and rows that repeat an id are told apart by their vectors; each input row
    has its own result.  With fewer vectors than entries the codebooks are as many; an
    empty table gives an empty result.  Equal entries and equal distances go to the lower
    index.  Components of any size are exact; errors beyond a long are given as its
    maximum.  Other columns are not carried; their names can't clash.
    """
    spark = vectors.sparkSession
    v = vectors[vector_col]
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(vectors[id_col].alias("vec_id"), vectors[label_col].alias("label"), v.cast("array<double>").alias("vector")).filter(good)
    kinds = (rows.schema["vec_id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString())
    head = rows.orderBy(F.asc_nulls_last("vec_id"), "vector").select("vector").limit(1).collect()
    if not head:
        kind = rows.schema["vec_id"].dataType
        return spark.createDataFrame([], T.StructType([T.StructField("vec_id", kind), *(T.StructField(n, t) for n, t in (("code", T.StringType()), ("error", T.LongType()), ("label_error", T.LongType()), ("codebooks_sha256", T.StringType())))]))
    length = len(head[0]["vector"])
    rows = rows.filter(F.size("vector") == length)
    first = [r["vector"] for r in rows.orderBy(F.asc_nulls_last("vec_id"), "vector").select("vector").limit(entries).collect()]
    width = -(-length // parts)
    raw = np.zeros((len(first), parts * width))
    raw[:, :length] = np.array(first, dtype=np.float64).reshape(len(first), length)
    book = Codebooks(np.ascontiguousarray(whole(raw, factor).reshape(len(first), parts, width).swapaxes(0, 1)))
    shape = book.entries.shape
    current = rows
    for _ in range(rounds):
        before, current = current, written(_assign(current, book, shape, kinds, factor), "codes")
        forget(before)
        book = _moved(book, current.filter("sums is not null"))
        kept, current = current, current.filter("sums is null").select("vec_id", "label", "x", "code")
        current._written_to = kept._written_to

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, _AT_ONCE):
                some = batch.slice(low, _AT_ONCE)
                x, start, _ = _read(some, "vector" in batch.schema.names, parts, width, factor)
                codes, least, _ = book.nearest(x, start)
                errors = [min(e, _MOST) for e in least.sum(axis=1).tolist()] if least.dtype == object else least.sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array([c.tobytes().hex() for c in codes.astype(np.uint8)], pa.string()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"]
                )

    coded = written(current.mapInArrow(last, f"vec_id {kinds[0]}, label {kinds[1]}, code string, error bigint"), "coded")
    forget(current)
    # Written, so that its size is known before a plan sends it to every task or not.
    totals = written(coded.groupBy("label").agg(_long(F.sum(F.col("error").cast("decimal(38,0)"))).alias("label_error")).withColumnRenamed("label", "of"), "label-errors")
    joined = coded.join(totals, coded["label"].eqNullSafe(totals["of"]))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(book.digest()).alias("codebooks_sha256"))
