"""Best-fit packing of token sequences by bin completion with branch and bound.

Documents are encoded where they lie; only the lengths of their pieces are dealt
out, in buckets of about ``BUCKET`` pieces, and each bucket is packed by itself.  A
bucket holds thousands of sequences, so the part-filled ones at its end weigh little.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import bpe
from . import textarrays as ta

#: Bytes of text encoded at once; the library's objects for them are many times as large.
SLICE_BYTES = 512 << 10
#: Pieces of a bucket, about.
BUCKET = 20_000
#: Fillings tried for one bin, and bins filled for each bin of the incumbent; see ``complete``.
BRANCHES, EFFORT = 4, 3
#: Distinct lengths up to which fillings are found by all sums they can reach, else by pairs and triples.
_FEW = 64


def cut_pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every whole text: ``doc_id, piece, start, length, ids``.

    A document is its ids and then ``end_id``; a longer one than ``capacity`` is cut
    into pieces of that size, the last one shorter or not.  ``ids`` is binary, little-
    endian unsigned 32-bit.  A null or empty text is one piece with the end id.
    Repeated rows and null ids give their own pieces.  One narrow pass.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(path, library=True)
        for batch in batches:
            for piece in ta.slices(batch.column(1), SLICE_BYTES):
                ids, offsets = bpe.with_end(*coder.chunks_of(piece).documents(), end_id)
                sizes = np.diff(offsets)
                n = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(piece)), n)
                number = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                start = number * capacity
                length = np.minimum(sizes[doc] - start, capacity)
                flat = pa.py_buffer(ids.astype("<u4"))
                for low in range(0, len(doc), 4096):
                    d = slice(low, min(low + 4096, len(doc)))
                    at = 4 * (offsets[doc[d]] + start[d])
                    ends = np.append(at, at[-1] + 4 * length[d][-1]).astype(np.int64)
                    binary = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends - ends[0]), flat.slice(int(ends[0]), int(ends[-1] - ends[0]))])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(piece.first + doc[d])), pa.array(number[d], pa.int32()), pa.array(start[d], pa.int64()), pa.array(length[d], pa.int64()), binary.cast(pa.binary())],
                        ["doc_id", "piece", "start", "length", "ids"],
                    )

    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each length goes to the fullest sequence with room for it."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0
    for x in sorted(lengths, reverse=True):
        fits = open_rooms >> x
        if fits:
            r = x + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_rooms &= ~(1 << r)
            bins[b].append(x)
        else:
            r, b = capacity, len(bins)
            bins.append([x])
        if r > x:
            room[r - x].append(b)
            open_rooms |= 1 << (r - x)
    return bins


def least_bins(lengths: list[int], capacity: int) -> int:
    """A lower bound: the total, or what pieces over a threshold need by themselves."""
    if not lengths:
        return 0
    x = np.sort(np.asarray(lengths, dtype=np.int64))
    sums = np.concatenate([[0], np.cumsum(x)])
    best = -(-int(sums[-1]) // capacity)
    half = int(np.searchsorted(x, capacity // 2, side="right"))
    for k in np.unique(x[: half + 1]).tolist():
        if k > capacity // 2:
            continue
        large = int(np.searchsorted(x, capacity - k, side="right"))
        small = int(np.searchsorted(x, k))
        middle_room = (large - half) * capacity - int(sums[large] - sums[half])
        rest = int(sums[half] - sums[small]) - middle_room
        best = max(best, len(x) - half + max(0, -(-rest // capacity)))
    return best


class _Lengths:
    """A multiset of lengths with bit masks of those at hand."""

    def __init__(self, lengths: list[int], capacity: int):
        self.capacity, self.count = capacity, [0] * (capacity + 1)
        self.mask = self.back = 0
        for x in lengths:
            self.put(x)

    def put(self, x: int) -> None:
        self.count[x] += 1
        if self.count[x] == 1:
            self.mask |= 1 << x
            self.back |= 1 << (self.capacity - x)

    def take(self, x: int) -> None:
        self.count[x] -= 1
        if not self.count[x]:
            self.mask &= ~(1 << x)
            self.back &= ~(1 << (self.capacity - x))

    def up_to(self, room: int) -> list[int]:
        """Distinct lengths of ``room`` at most, descending."""
        out, mask = [], self.mask & ((2 << room) - 1)
        while mask:
            out.append(mask.bit_length() - 1)
            mask &= ~(1 << out[-1])
        return out

    def greedy(self, room: int) -> tuple[int, ...]:
        """The largest piece that fits, again and again, until none does."""
        out: list[int] = []
        while x := max((self.mask & ((2 << room) - 1)).bit_length() - 1, 0):
            self.take(x)
            out.append(x)
            room -= x
        for x in out:
            self.put(x)
        return tuple(out)

    def dominated(self, filling: tuple[int, ...], room: int) -> bool:
        """Whether a piece at hand could replace a smaller one, or two, of a filling of ``room``.

        What it replaces then fits where that piece will lie, so the filling can be left out.
        """
        waste = room - sum(filling)
        parts = sorted(set(filling))
        for x in filling:
            self.count[x] -= 1
        try:
            for i, x in enumerate(parts):
                for y in (0, *parts[i:]):
                    if y and y == x and filling.count(x) < 2:
                        continue
                    # Larger than one piece, or as large as two together.
                    low, high = (x + 1, x + waste) if not y else (x + y, x + y + waste)
                    seen = (self.mask >> low) & ((1 << max(high - low + 1, 0)) - 1)
                    while seen:
                        z = low + (seen & -seen).bit_length() - 1
                        if self.count[z] > 0:
                            return True
                        seen &= seen - 1
            return False
        finally:
            for x in filling:
                self.count[x] += 1

    def fillings(self, room: int, branches: int | None) -> list[tuple[int, ...]]:
        """Undominated fillings of ``room``, fullest first; those with larger pieces first among equals.

        All of them if ``branches`` is None, else about that many of the fullest.
        """
        mask = self.mask & ((2 << room) - 1)
        single = mask.bit_length() - 1
        if single <= 0:
            return [()]
        if single == room:
            return [(single,)]  # dominates all others
        found: dict[tuple[int, ...], None] = {}
        if branches is not None and mask.bit_count() > _FEW:
            exact = mask & (self.back >> (self.capacity - room))
            tried = 0
            firsts = self.up_to(room) if not exact else []
            while exact and len(found) < branches:
                a = exact.bit_length() - 1
                exact &= ~(1 << a)
                if room - a <= a and (room - a < a or self.count[a] > 1):
                    found[a, room - a] = None
            for a in firsts[: 8 * branches]:
                if len(found) >= branches:
                    break
                tried += 1
                self.take(a)
                rest = room - a
                both = self.mask & (self.back >> (self.capacity - rest)) if rest else 0
                tail: tuple[int, ...] | None = None
                if not rest or self.mask >> rest & 1:
                    tail = (rest,) if rest else ()
                elif both:
                    x = both.bit_length() - 1
                    tail = (x, rest - x) if rest - x < x or self.count[x] > 1 else None
                if tail is None:
                    tail = self.greedy(rest)
                self.put(a)
                found[tuple(sorted((a, *tail), reverse=True))] = None
        else:
            lengths = self.up_to(room)
            # Sums that lengths from the i-th on can reach, each as often as it is there.
            reach = [1] * (len(lengths) + 1)
            for i in range(len(lengths) - 1, -1, -1):
                sums, n, step = reach[i + 1], min(self.count[lengths[i]], room // lengths[i]), 1
                while n:
                    k = min(step, n)
                    sums |= sums << (k * lengths[i])
                    n, step = n - k, 2 * step
                reach[i] = sums & ((2 << room) - 1)
            sums, wanted = reach[0], branches if branches is not None else 1 << 62
            least = lengths[-1]
            while sums and len(found) < wanted:
                total = sums.bit_length() - 1
                sums &= ~(1 << total)
                if not total or room - total >= least and branches is not None and found:
                    break
                self._reaching(lengths, reach, 0, total, (), found, wanted)
            if branches is None:
                found = {f: None for f in found if not self.dominated(f, room)}
        ranked = sorted(found, key=lambda f: (room - sum(f), len(f), [-x for x in f]))
        if branches is None:
            return ranked
        kept = [f for f in ranked if not self.dominated(f, room)]
        return (kept or ranked)[:branches]

    def _reaching(self, lengths: list[int], reach: list[int], i: int, total: int, chosen: tuple[int, ...], found: dict, wanted: int) -> None:
        """Adds fillings that sum up to ``total`` exactly, with larger pieces first."""
        if not total:
            found[chosen] = None
            return
        for j in range(i, len(lengths)):
            x = lengths[j]
            if len(found) >= wanted or not reach[j] >> total & 1:
                return
            for n in range(min(self.count[x], total // x), 0, -1):
                if reach[j + 1] >> (total - n * x) & 1:
                    self._reaching(lengths, reach, j + 1, total - n * x, (*chosen, *[x] * n), found, wanted)
                    if len(found) >= wanted:
                        return


def complete(lengths: list[int], capacity: int, branches: int | None = BRANCHES, effort: int | None = EFFORT) -> list[list[int]]:
    """Packs lengths (1 to ``capacity``) into few bins, by bin completion.

    The best-fit solution is the first incumbent.  The search fills a bin around the
    largest piece left, tries its undominated fillings, and drops a branch once its
    waste is more than a better solution may have.  It ends at the lower bound.

    ``branches`` is how many fillings are tried for one bin, and ``effort`` how many bins
    are filled for each bin of the incumbent and, a hundred times that, for each bin
    that the incumbent is above the lower bound; then the incumbent is returned.  With
    None for both the search is exhaustive and the result the least possible.
    """
    best = best_fit(lengths, capacity)
    least = least_bins(lengths, capacity)
    if len(best) <= least:
        return best
    left = _Lengths(lengths, capacity)
    total = sum(lengths)
    nodes = effort * (len(best) + 100 * (len(best) - least)) if effort is not None else -1
    bins: list[list[int]] = []
    waste = 0
    stack: list[list[tuple[int, ...]]] = []
    allowed = (len(best) - 1) * capacity - total
    open_next = True
    while nodes:
        if open_next:
            open_next = False
            if left.mask:
                nodes -= 1
                large = left.mask.bit_length() - 1
                left.take(large)
                stack.append(left.fillings(capacity - large, branches))
                bins.append([large])
                waste += capacity - large
            elif len(bins) < len(best):
                best = [b[:] for b in bins]
                allowed = (len(best) - 1) * capacity - total
                if len(best) <= least:
                    break
        if not stack:
            break
        # Undo the filling that stands, then take the next one within the bounds.
        for x in bins[-1][1:]:
            left.put(x)
            waste += x
        del bins[-1][1:]
        while stack[-1]:
            f = stack[-1].pop(0)
            if waste - sum(f) <= allowed:
                for x in f:
                    left.take(x)
                waste -= sum(f)
                bins[-1] += f
                open_next = True
                break
        else:
            stack.pop()
            large = bins.pop()[0]
            left.put(large)
            waste -= capacity - large
    return best


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece."""
    bins_of, offset_of = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    full = lengths == capacity
    bins_of[full] = np.arange(int(full.sum()))
    base = int(full.sum())
    rest = np.flatnonzero(~full)
    waiting: dict[int, list[int]] = {}
    for i in rest[::-1].tolist():
        waiting.setdefault(int(lengths[i]), []).append(i)
    for b, content in enumerate(complete(lengths[rest].tolist(), capacity)):
        at = 0
        for x in content:
            i = waiting[x].pop()
            bins_of[i], offset_of[i] = base + b, at
            at += x
    return bins_of, offset_of


def pack(pieces: DataFrame, capacity: int = 2048, bucket: int = BUCKET) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows that have a ``length`` of 1 to ``capacity``.

    The other columns are carried.  ``pieces`` should be a written table: it is counted
    first, and rows are dealt by their place in it, so that repeated rows spread evenly.
    Sequence ids are unique, in no order.  An empty table gives an empty result.
    """
    buckets = max(1, -(-pieces.count() // bucket))
    dealt = pieces.withColumn("__bucket", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)).cast("int"))
    names = [f.name for f in pieces.schema.fields]

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        which, offsets = place(group.column("length").to_numpy(), capacity)
        ids = key[0].as_py() * (1 << 32) + which
        return group.select(names).append_column("sequence_id", pa.array(ids, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return dealt.groupBy("__bucket").applyInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Places of all pieces: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null or empty text is one piece with the end id; repeated rows and null ids are
    packed each.  Other columns are not carried, so their names can't clash.  An empty
    table gives an empty result.
    """
    cut = cut_pieces(docs, path, capacity, end_id, id_col, text_col)
    return pack(written(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces"), capacity)


def sequences(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """The packed sequences: ``sequence_id, length, ids`` from pieces with ids and their places.

    Ids of documents must be unique here; the join is by ``doc_id`` and ``piece``.
    """
    both = pieces.select("doc_id", "piece", "ids").join(places.select("doc_id", "piece", "sequence_id", "offset", "length"), ["doc_id", "piece"])
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return both.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
