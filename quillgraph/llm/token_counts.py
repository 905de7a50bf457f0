"""Token counts of texts from the piece counts of their distinct pre-tokens.

A byte-level vocabulary splits a text into pre-tokens and each of them into pieces by
itself.  So pieces are counted once for each distinct pre-token of the corpus, joined to
the pre-token frequencies of the documents, and summed; no ids are made.

Frequencies stay with their slice of texts.  What is dealt out is each slice's distinct
pre-tokens, packed in one row for each bucket of their hashes; the join of pieces to
pre-tokens is within buckets, and the slices get numbers back.  A pre-token that every
text has is met once a slice, so no bucket is hot.
"""

from __future__ import annotations

import json
import math
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import bpe
from . import textarrays as ta

_SPECIAL = 4
#: Pre-tokens that the library encodes at once.
_TOGETHER = 512
#: Buckets of pre-tokens at least, and bytes of text for one.
BUCKETS, BUCKET_BYTES = 256, 64 << 20


class ByteLevel:
    """Pre-tokens of a byte-level vocabulary file, and the number of pieces of each."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"] or {}
        if split.get("type") != "ByteLevel" or not split.get("use_regex", True) or split.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError(f"{path}: not a byte-level vocabulary without a normalizer")
        if any(t[flag] for t in spec["added_tokens"] for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path}: added tokens that take in their surroundings")
        # Longer strings first, as where one begins with another.
        self._special = sorted((t["content"].encode() for t in spec["added_tokens"]), key=len, reverse=True)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        self._classes = bpe._classes().copy()
        self._asked = bpe.assigned()

    def _class_of(self, points: np.ndarray) -> np.ndarray:
        """Classes of code points; the library is asked for those that this Python's tables don't have yet."""
        for c in np.unique(points[~self._asked[points]]).tolist():
            cuts = {a for _, (a, _) in self._library.pre_tokenizer.pre_tokenize_str(f"!a{chr(c)}1!")}
            self._classes[c] = bpe._LETTER if 2 not in cuts else bpe._NUMBER if 3 not in cuts else bpe._OTHER
            self._asked[c] = True
        return self._classes[points]

    def split(self, points: np.ndarray, first: np.ndarray, special: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin among code points; they tile the texts.

        ``first`` marks the first character of each text and around special tokens,
        ``special`` the characters of those.  Pre-tokens are the contractions ``'s 't 're
        've 'm 'll 'd`` at a beginning, runs of letters, of numbers and of other characters,
        each with one space before it, and white space: all of a run but its last character
        where something follows.
        """
        n = len(points)
        kind = self._class_of(points)
        kind[special] = _SPECIAL
        white = kind == bpe._WHITE
        begin = first.copy()
        begin[1:] |= kind[1:] != kind[:-1]
        followed = np.zeros(n, dtype=bool)
        followed[:-1] = white[:-1] & ~first[1:] & ~white[1:]
        joined = followed & (points == 0x20)
        begin[1:] &= ~joined[:-1]
        begin |= followed
        marks = np.flatnonzero((points == 0x27) & begin & (kind == bpe._OTHER))
        marks = marks[marks + 1 < n]
        marks = marks[~first[marks + 1]]
        if len(marks):
            one = points[marks + 1]
            more = marks + 2 < n
            after = np.minimum(marks + 2, n - 1)
            two = np.where(more & ~first[after], points[after], 0)
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            for chosen, size in ((short, 2), (long, 3)):
                at = marks[chosen]
                begin[at + 1] = False
                rest = at[at + size < n] + size
                begin[rest] |= kind[rest] == bpe._LETTER
        return begin

    def spans(self, piece: ta.TextSlice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of a slice, where its pre-tokens begin, their documents, and which of them are special tokens."""
        data, starts = piece.data, piece.starts
        raw = data.tobytes()
        try:
            text = raw.decode()
        except UnicodeDecodeError:  # bytes that are no text become U+FFFD, text by text
            texts = [piece.text(i).decode("utf-8", "replace").encode() for i in range(len(piece))]
            raw, text = b"".join(texts), b"".join(texts).decode()
            data = np.frombuffer(raw, np.uint8)
            starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]]).astype(np.int64)
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        if not len(points):
            empty = np.zeros(0, np.int64)
            return data, empty, empty, np.zeros(0, bool)
        at = np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)) if len(points) != len(data) else np.arange(1, len(points) + 1)
        at = np.concatenate([[0], at]).astype(np.int64)
        first, special = np.zeros(len(points) + 1, dtype=bool), np.zeros(len(points), dtype=bool)
        first[np.searchsorted(at, starts)] = True
        for low, high in self._find_special(raw, np.append(starts, len(data))):
            i, j = np.searchsorted(at, [low, high])
            first[i] = first[j] = True
            special[i:j] = True
        begin = np.flatnonzero(self.split(points, first[:-1], special))
        return data, at[begin], np.searchsorted(starts, at[begin], side="right") - 1, special[begin]

    def _find_special(self, raw: bytes, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
        """Places of special tokens, from left to right, each within one text."""
        if not any(s in raw for s in self._special):
            return
        place = 0
        while True:
            hits = [(at, -len(s)) for s in self._special if (at := raw.find(s, place)) >= 0]
            if not hits:
                return
            low, size = min(hits)
            place = low - size
            if bounds[np.searchsorted(bounds, low, side="right")] < place:
                place = low + 1  # its characters belong to two texts
            else:
                yield low, place

    def pieces(self, pre_tokens: list[str]) -> list[int]:
        """The number of pieces of each pre-token."""
        return [len(e.ids) for e in self._library.encode_batch(pre_tokens, add_special_tokens=False)]


@lru_cache(maxsize=2)
def load(path: str) -> ByteLevel:
    return ByteLevel(path)


def _squeezed(raw: bytes) -> bytes:
    """Compressed bytes behind their length; rows hold thousands of short words or numbers, so this halves what is shuffled."""
    return len(raw).to_bytes(8, "little") + _codec().compress(raw, asbytes=True)


def _loosened(raw: bytes) -> bytes:
    return _codec().decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True)


@lru_cache(maxsize=1)
def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=3)


def _packed(values: np.ndarray) -> bytes:
    """Numbers in as few bytes each as all need; the first byte tells how many."""
    most = int(values.max(initial=0))
    kind = next(k for k in (1, 2, 4, 8) if most < 1 << (8 * k))
    return str(kind).encode() + _squeezed(values.astype(f"<u{kind}").tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(_loosened(raw[1:]), f"<u{raw[:1].decode()}").astype(np.int64)


_NAMES = ["slice", "doc_id", "place", "n_bytes", "special", "bucket", "words", "lengths", "places", "times", "texts"]


def frequencies(docs: DataFrame, path: str, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """Rows of three kinds, by slice of texts.

    For each text its ``place, doc_id, n_bytes`` and number of ``special`` tokens; for each
    bucket the slice's distinct pre-tokens (``words, lengths``); and once the frequencies:
    in how many ``texts`` each pre-token is, in the order of buckets, and at which
    ``places`` it is how many ``times``.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType
    schema = f"slice long, doc_id {kind.simpleString()}, place int, n_bytes long, special long, bucket int, words binary, lengths binary, places binary, times binary, texts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column(0)
            types = [pa.int64(), ids.type, pa.int32(), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 5]

            def made(n: int, number: int, types: list = types, **columns: object) -> pa.RecordBatch:
                columns["slice"] = np.full(n, number)
                return pa.RecordBatch.from_arrays([columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(_NAMES, types, strict=True)], _NAMES)

            for piece in ta.slices(batch.column(1)):
                n = len(piece)
                data, starts, owner, special = coder.spans(piece)
                ends = np.append(starts[1:], len(data))
                yield made(n, number, doc_id=ids.slice(piece.first, n), place=np.arange(n), n_bytes=piece.ends - piece.starts, special=np.bincount(owner[special], minlength=n))
                starts, ends, owner = starts[~special], ends[~special], owner[~special]
                first, which = ta.distinct_spans(data, starts, ends)
                starts, ends = starts[first], ends[first]
                bucket = (ta.hash_spans(data, starts, ends) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                rank = np.empty(len(order), dtype=np.int64)
                rank[order] = np.arange(len(order))
                pairs, times = np.unique(rank[which] * n + owner, return_counts=True)
                yield made(1, number, places=[_packed(pairs % n)], times=[_packed(times)], texts=[_packed(np.bincount(pairs // n, minlength=len(first)))])
                lengths = (ends - starts)[order]
                words = ta.ragged_gather(data, starts[order], lengths).tobytes()
                edges = np.concatenate([[0], np.cumsum(lengths)])
                used, low = np.unique(bucket[order], return_index=True)
                high = np.append(low[1:], len(order))
                spelt = [_squeezed(words[edges[i] : edges[j]]) for i, j in zip(low.tolist(), high.tolist(), strict=True)]
                if len(used):
                    yield made(len(used), number, bucket=used, words=spelt, lengths=[_packed(lengths[i:j]) for i, j in zip(low.tolist(), high.tolist(), strict=True)])
                number += 1

    return rows.mapInArrow(run, schema)


def piece_counts(words: DataFrame, path: str) -> DataFrame:
    """``slice, bucket, pieces`` of the pre-tokens in each row of ``slice, bucket, words, lengths``; each distinct one is counted once."""

    def count(group: pa.Table) -> pa.Table:
        lengths = [_unpacked(x) for x in group.column("lengths").to_pylist()]
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype(np.int64)
        spans = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(_loosened(w) for w in group.column("words").to_pylist()))]).dictionary_encode()
        coder = load(path)
        counts = np.empty(len(spans.dictionary), dtype=np.int64)
        for low in range(0, len(counts), _TOGETHER):
            counts[low : low + _TOGETHER] = coder.pieces([w.decode() for w in spans.dictionary.slice(low, _TOGETHER).to_pylist()])
        found = counts[np.asarray(spans.indices)]
        cuts = np.cumsum([len(x) for x in lengths])[:-1]
        return pa.table({"slice": group.column("slice"), "bucket": group.column("bucket"), "pieces": pa.array([_packed(x) for x in np.split(found, cuts)], pa.binary())})

    return words.select("slice", "bucket", "words", "lengths").groupBy("bucket").applyInArrow(count, "slice long, bucket int, pieces binary")


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text: ``doc_id, n_bytes, n_tokens, over_limit`` (more tokens than ``limit``).

    One row for each input row, repeated rows and null ids included.  A null or empty
    text has no bytes and no tokens.  A special token's string counts as that token.
    Very long texts are slices of their own; a very long pre-token is a key as any other.
    An empty table gives an empty result.  Other columns are not carried; their names
    can't clash.

    Two shuffles: of distinct pre-tokens by bucket, and of their numbers and the packed
    frequencies by slice.  A slice is about ``textarrays.SLICE_BYTES`` of texts, or one
    longer text, and a bucket has about ``BUCKET_BYTES``, so both bound what a task holds.
    """
    kind = docs.select(docs[id_col].alias("doc_id")).schema["doc_id"].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length(docs[text_col].cast("string")).cast("double"))).first()[0] or 0
    found = written(frequencies(docs, path, max(BUCKETS, math.ceil(size / BUCKET_BYTES)), id_col, text_col), "pre-tokens")
    counted = piece_counts(found.filter("words is not null"), path)
    both = found.filter("words is null").drop("bucket", "words", "lengths").unionByName(counted, allowMissingColumns=True)

    def total(group: pa.Table) -> pa.Table:
        rows = group.filter(pc.is_valid(group.column("place")))
        rows = rows.take(pc.sort_indices(rows, [("place", "ascending")]))
        sums = np.asarray(rows.column("special"), dtype=np.int64).copy()
        (packed,) = group.filter(pc.is_valid(group.column("times"))).select(["places", "times", "texts"]).to_pylist()
        counts = group.filter(pc.is_valid(group.column("pieces")))
        if counts.num_rows:
            counts = counts.take(pc.sort_indices(counts, [("bucket", "ascending")]))
            pieces = np.concatenate([_unpacked(x) for x in counts.column("pieces").to_pylist()])
            weights = np.repeat(pieces, _unpacked(packed["texts"])) * _unpacked(packed["times"])
            np.add.at(sums, _unpacked(packed["places"]), weights)
        return pa.table({"doc_id": rows.column("doc_id"), "n_bytes": rows.column("n_bytes"), "n_tokens": pa.array(sums, pa.int64()), "over_limit": pa.array(sums > limit)})

    return both.groupBy("slice").applyInArrow(total, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
