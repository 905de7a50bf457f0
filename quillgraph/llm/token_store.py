"""Token ids in binary shards with a minimal perfect hash index over document keys.

A shard file holds, in this order:

* ``QTOK0001``
* the payload: ids of all documents in key order, little-endian unsigned 16-bit (32-bit
  for vocabularies beyond 65,536), each document with its end id;
* the document offsets, 64-bit, in ids, one more than documents;
* the index: level bit maps, ranks, and for each slot a 32-bit fingerprint of its key,
  the first document of that key and how many documents have it;
* the keys as an Arrow stream, and a JSON footer with the places of all these, whose
  size is in the last eight bytes.

The index is built in levels: a key that falls alone on a bit of a level owns it, the
others go to the next level.  The rank of an owned bit is the key's slot, so n keys
have the slots 0 to n - 1, and a lookup reads a few bits, one rank and one slot.  Keys
whose 64-bit hash another key of the shard has are listed apart and compared as text.
"""

from __future__ import annotations

import io
import json
import math
import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import shared_path, written
from . import bpe
from . import textarrays as ta

_MAGIC = b"QTOK0001"
_LEVELS, _LOAD = 40, 2.0


def key_hashes(keys: pa.Array) -> np.ndarray:
    """64-bit hashes of keys by their text; null has a hash of its own."""
    text = keys.cast(pa.string())
    data, offsets = ta.text_column(text)
    out = np.empty(len(keys), dtype=np.uint64)
    solid = np.diff(offsets) > 0
    out[solid] = ta.hash_spans(data, offsets[:-1][solid], offsets[1:][solid])
    out[~solid] = ta.mix64(np.array([0x0E], dtype=np.uint64))[0]
    out[np.asarray(text.is_null())] = ta.mix64(np.array([0x17], dtype=np.uint64))[0]
    return out


def _spot(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)
    return (ta.mix64(hashes ^ seed) % np.uint64(size)).astype(np.int64)


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    return (ta.mix64(hashes + np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit key hashes."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.ranks = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        left, sizes, parts = hashes, [], []
        while len(left):
            if len(sizes) == _LEVELS:
                raise ValueError("the hashes are not distinct")
            size = max(8, int(_LOAD * len(left)))
            at = _spot(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            parts.append(alone)
            left = left[~alone[at]]
        return cls(sizes, np.concatenate(parts) if parts else np.zeros(0, bool))

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where no level owns it."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        todo = np.arange(len(hashes))
        for level, size in enumerate(self.sizes):
            if not len(todo):
                break
            at = self.starts[level] + _spot(hashes[todo], level, size)
            hit = self.bits[at]
            out[todo[hit]] = self.ranks[at[hit]]
            todo = todo[~hit]
        return out


class ShardReader:
    """Keyed access to one shard file."""

    def __init__(self, path: str):
        fs, name = pafs.FileSystem.from_uri(path)
        self._file = fs.open_input_file(name)
        size = self._file.size()
        tail = self._file.read_at(8, size - 8)
        n = int.from_bytes(tail, "little")
        self.footer = json.loads(self._file.read_at(n, size - 8 - n))
        part = {k: np.frombuffer(self._file.read_at(s, at), dtype=d) for k, (at, s, d) in self.footer["parts"].items() if k not in ("ids", "keys")}
        self.offsets, self._prints, self._first, self._run = part["offsets"], part["prints"], part["first"], part["run"]
        bits = np.unpackbits(part["bits"], count=sum(self.footer["levels"])).astype(bool)
        self.hash = PerfectHash(self.footer["levels"], bits)
        #: Keys that share their hash with another one: text (or None) to first document and number.
        self._clashes = {(None if k is None else str(k)): (f, n) for k, f, n in self.footer["clashes"]}

    def close(self) -> None:
        self._file.close()

    def keys(self) -> pa.Array:
        """All keys in document order."""
        at, size, _ = self.footer["parts"]["keys"]
        with pa.ipc.open_stream(self._file.read_at(size, at)) as stream:
            return stream.read_all().column(0).combine_chunks()

    def find(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """First document and number of documents of each key; -1 and 0 where it is unknown."""
        hashes = key_hashes(keys)
        slots = self.hash.slots(hashes)
        good = slots >= 0
        good[good] = self._prints[slots[good]] == fingerprints(hashes[good])
        first, run = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        first[good], run[good] = self._first[slots[good]], self._run[slots[good]]
        if self._clashes:
            for i, key in enumerate(keys.cast(pa.string()).to_pylist()):
                if key in self._clashes:
                    first[i], run[i] = self._clashes[key]
        return first, run

    def ids(self, first: int, last: int) -> np.ndarray:
        """Raw ids of documents ``first`` to ``last - 1``, joined."""
        at, _, kind = self.footer["parts"]["ids"]
        width = np.dtype(kind).itemsize
        a, b = int(self.offsets[first]), int(self.offsets[last])
        return np.frombuffer(self._file.read_at((b - a) * width, at + a * width), dtype=kind)


def _run_starts(column: pa.Array, hashes: np.ndarray) -> np.ndarray:
    """Where a key differs from the one before; two keys of one hash are compared themselves."""
    new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
    for i in np.flatnonzero(~new).tolist():
        new[i] = column[i] != column[i - 1] if column[i].is_valid and column[i - 1].is_valid else column[i].is_valid != column[i - 1].is_valid
    return np.flatnonzero(new)


def _write_shard(batches: Iterator[pa.RecordBatch], folder: str, path: str, end_id: int) -> dict[str, Any] | None:
    coder = bpe.load(path, library=True)
    kind = "<u2" if len(coder.tokens) <= 1 << 16 else "<u4"
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    name = f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.qtok"
    keys, offsets, total = [], [np.zeros(1, np.int64)], 0
    with fs.open_output_stream(f"{root}/{name}") as out:
        out.write(_MAGIC)
        for batch in batches:
            keys.append(batch.column(0))
            for piece in ta.slices(batch.column(1)):
                ids, cuts = bpe.with_end(*coder.chunks_of(piece).documents(), end_id)
                out.write(ids.astype(kind).tobytes())
                offsets.append(total + cuts[1:])
                total += len(ids)
        if keys:
            column = pa.chunked_array(keys).combine_chunks()
            solid = column.drop_null()
            least, greatest = (solid[0].as_py(), solid[-1].as_py()) if len(solid) else (None, None)
            nulls = column.null_count
            hashes = key_hashes(column)
            # Equal keys are neighbours, as the rows are in key order.
            first = _run_starts(column, hashes)
            run = np.diff(np.append(first, len(hashes)))
            _, which, times = np.unique(hashes[first], return_index=True, return_counts=True)
            alone = np.zeros(len(first), dtype=bool)
            alone[which] = True
            shared = np.isin(hashes[first], hashes[first][which[times > 1]]) if (times > 1).any() else np.zeros(len(first), dtype=bool)
            names = column.take(pa.array(first[shared])).cast(pa.string()).to_pylist()
            clashes = [[k, int(f), int(n)] for k, f, n in zip(names, first[shared], run[shared], strict=True)]
            first, run, documents = first[alone], run[alone], len(hashes)
            index = PerfectHash.build(hashes[first])
            order = np.argsort(index.slots(hashes[first]))
            stream = io.BytesIO()
            table = pa.table({"key": column})
            with pa.ipc.new_stream(stream, table.schema) as w:
                w.write_table(table)
            parts = {
                "offsets": np.concatenate(offsets).astype("<i8"),
                "bits": np.packbits(index.bits),
                "prints": fingerprints(hashes[first])[order].astype("<u4"),
                "first": first[order].astype("<i8"),
                "run": run[order].astype("<i4"),
            }
            at = len(_MAGIC) + total * np.dtype(kind).itemsize
            places: dict[str, Any] = {"ids": [len(_MAGIC), at - len(_MAGIC), kind]}
            for part, values in parts.items():
                data = values.tobytes()
                places[part] = [at, len(data), values.dtype.str]
                out.write(data)
                at += len(data)
            places["keys"] = [at, stream.tell(), "arrow"]
            out.write(stream.getvalue())
            footer = json.dumps({"documents": documents, "ids": total, "levels": index.sizes, "parts": places, "clashes": clashes}).encode()
            out.write(footer + len(footer).to_bytes(8, "little"))
    if not keys:
        fs.delete_file(f"{root}/{name}")
        return None
    return {"shard": TaskContext.get().partitionId(), "file": f"{folder}/{name}", "documents": documents, "ids": total, "least": least, "greatest": greatest, "nulls": nulls}


def write_store(docs: DataFrame, path: str, folder: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and writes all documents in ascending key order; returns the manifest.

    The manifest has one row for each shard: ``shard, file, documents, ids, least,
    greatest, nulls, start``: its keys' bounds, its rows with a null key, and the number
    of ids in all shards before.  Null keys come first.
    Rows with equal keys are neighbours in the order of the input.  A null or empty
    text is its end id alone.  Other columns are not carried.  An empty table gives no
    shard.  ``folder`` is a folder that all executors share (by default one in the
    cluster's).  A task that is run again writes a file of its own; the manifest names
    those of the tasks that were committed.
    """
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "token-store")
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id())
    shards = max(1, rows.rdd.getNumPartitions())
    ordered = rows.repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), "row").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "row").select("doc_id", "text")

    arrow = to_arrow_type(rows.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = _write_shard(batches, folder, path, end_id)
        if row:
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("shard", pa.int64()), ("file", pa.string()), ("documents", pa.int64()), ("ids", pa.int64()), ("least", arrow), ("greatest", arrow), ("nulls", pa.int64())]))

    kind = rows.schema["doc_id"].dataType.simpleString()
    manifest = written(ordered.mapInArrow(run, f"shard long, file string, documents long, ids long, least {kind}, greatest {kind}, nulls long"), "token-manifest")
    return _with_starts(spark, manifest)


def _with_starts(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """One small row for each shard; there are as many as input splits."""
    start, out = 0, []
    for r in manifest.orderBy("shard").collect():
        out.append((*r, start))
        start += r["ids"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in manifest.schema.fields)
    return spark.createDataFrame(out, f"{schema}, start long").repartition(max(1, len(out)))


def read_store(manifest: DataFrame, key_type: str = "bigint") -> DataFrame:
    """Every document of the store, found by its key: ``doc_id, start, n_tokens, ids``.

    ``start`` is the number of ids before the document in the whole store, ``ids``
    binary, little-endian unsigned 32-bit.  A key that the index doesn't find is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                reader = ShardReader(shard["file"])
                keys = reader.keys()
                for low in range(0, len(keys), 1024):
                    part = keys.slice(low, 1024)
                    first, run = reader.find(part)
                    if (first < 0).any():
                        raise ValueError(f"{shard['file']}: a stored key is not in its index")
                    # The i-th row of a repeated key is the i-th document of its run.
                    at = np.arange(low, low + len(part))
                    doc = first + np.minimum(at - first, run - 1)
                    a, b = reader.offsets[doc], reader.offsets[doc + 1]
                    whole = reader.ids(int(doc.min()), int(doc.max()) + 1).astype("<u4")
                    base = int(reader.offsets[int(doc.min())])
                    flat = memoryview(whole).cast("B")
                    ids = [bytes(flat[4 * (x - base) : 4 * (y - base)]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([part, pa.array(shard["start"] + a, pa.int64()), pa.array(b - a, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
                reader.close()

    return manifest.mapInArrow(run, f"doc_id {key_type}, start long, n_tokens long, ids binary")


def lookup(manifest: DataFrame, wanted: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """Ids of some keys: ``key, ids``, one row for each stored document of each distinct key.

    A key meets the shards whose bounds hold it (more than one only where a repeated key
    spans shards), and each shard's index is asked once for a block of its keys.  Keys
    that no shard has give no row; a null key finds the rows with a null key.

    Shards are found in two steps: of about the root of their number of groups, whose
    bounds are broadcast, and then of a group's shards in a join on the group.
    """
    key_type = wanted.schema[key_col].dataType.simpleString()
    count = manifest.count()
    wide = max(1, math.isqrt(count))
    shards = manifest.select("file", "least", "greatest", "nulls", (F.col("shard") / wide).cast("int").alias("group"))
    groups = shards.groupBy("group").agg(F.min("least").alias("low"), F.max("greatest").alias("high"))
    keys = wanted.select(F.col(key_col).alias("key")).distinct()
    met = keys.filter("key is not null").join(F.broadcast(groups), F.col("key").between(F.col("low"), F.col("high")))
    met = met.join(shards, "group").filter(F.col("key").between(F.col("least"), F.col("greatest"))).select("file", "key")
    none = keys.filter("key is null").crossJoin(F.broadcast(shards.filter("nulls > 0").select("file"))).select("file", "key")  # one row at most on the left
    both = met.unionByName(none).withColumn("b", F.floor(F.monotonically_increasing_id() / 4096))
    asked = both.groupBy("file", F.pmod(F.xxhash64("key"), F.lit(16)).alias("part"), "b").agg(F.collect_list(F.struct("key")).alias("keys")).select("file", F.expr("transform(keys, k -> k.key)").alias("keys"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys = batch.column(1).slice(i, 1).flatten()
                reader = ShardReader(batch.column(0)[i].as_py())
                first, n = reader.find(keys)
                where = np.flatnonzero(first >= 0)
                doc = np.repeat(first[where], n[where]) + np.concatenate([np.arange(k) for k in n[where]] or [np.zeros(0, np.int64)]).astype(np.int64)
                ids = [reader.ids(d, d + 1).astype("<u4").tobytes() for d in doc.tolist()]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(np.repeat(where, n[where]))), pa.array(ids, pa.binary())], ["key", "ids"])
                reader.close()

    return asked.mapInArrow(run, f"key {key_type}, ids binary")
