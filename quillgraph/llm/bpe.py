"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

Every word is a row of leaves, one for each adjacent pair of its symbols; a leaf
holds ``rank * width + position``, so the root of the minimum tree is the leftmost
lowest-rank merge.  A merge changes three leaves, each a logarithmic update.  The
words of a slice are merged in step, all of one width together, so each tree level
is one numpy operation over many words.

The vocabulary file is one of the public tokenizer files, given by its path.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textarrays as ta

#: Words merged in step at once.
_LANES = 1 << 15
#: Distinct chunks of text, and bytes of them and of their ids, that a worker remembers.
_KNOWN, _KNOWN_BYTES = 100_000, 8 << 20
#: Symbols of a word from which all pairs of the lowest rank merge at once.
_WIDE = 2048


def public_path(name: str) -> str:
    """Where an installed public tokenizer file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


_LETTER, _NUMBER, _OTHER, _WHITE = 1, 2, 3, 0


@lru_cache(maxsize=2)
def _classes(size: int = sys.maxunicode + 1) -> np.ndarray:
    """Class of every code point below ``size``: letter, number, white space or other."""
    kind = {"L": _LETTER, "N": _NUMBER}
    out = np.array([kind.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(size)], dtype=np.uint8)
    # What the public file's pattern counts as white space.
    white = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    out[[c for c in white if c < size]] = _WHITE
    return out


def assigned() -> np.ndarray:
    """Which code points this Python's Unicode tables have."""
    return np.array([unicodedata.category(chr(c)) != "Cn" for c in range(sys.maxunicode + 1)], dtype=bool)


def split_pieces(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each piece of lower-case text, given as code points (or as bytes, if it is ASCII).

    Pieces are runs of letters, single numbers, runs of other characters, and the
    contractions ``'s 't 're 've 'm 'll 'd`` where an apostrophe begins a run.
    """
    kind = _classes(0x80 if points.dtype == np.uint8 else sys.maxunicode + 1)[points]
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = kind != _WHITE
    begin[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
    marks = np.flatnonzero((points == 0x27) & begin)
    marks = marks[marks + 1 < n]
    if len(marks):
        one = points[marks + 1]
        two = points[np.minimum(marks + 2, n - 1)]
        two[marks + 2 >= n] = 0
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for chosen, size in ((short, 2), (long & ~short, 3)):
            at = marks[chosen]
            begin[at + 1] = False
            rest = at[at + size < n] + size
            begin[rest] |= kind[rest] != _WHITE
    starts = np.flatnonzero(begin)
    if not len(starts):
        return starts, starts
    solid = np.flatnonzero(kind != _WHITE)
    # A piece ends before the next one or at the last solid character before it.
    last = np.searchsorted(solid, np.concatenate([starts[1:], [n]])) - 1
    return starts, solid[last] + 1


class ChunkCoder:
    """Encodes texts chunk by chunk, a chunk being a run of non-blank bytes."""

    tokens: list[str]

    def __init__(self) -> None:
        self._forget()

    def encode_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks without blank bytes, joined, and the number of ids of each chunk."""
        raise NotImplementedError

    def chunks_of(self, piece: ta.TextSlice) -> ChunkIds:
        """Ids of a slice's chunks; each distinct chunk is encoded when it is first met.

        Chunks are told apart by their bytes.  At most ``_KNOWN`` chunks, or
        ``_KNOWN_BYTES`` of them or their ids, are remembered; then memory starts anew.
        """
        starts, ends, docs = ta.words(piece)
        first, which = ta.distinct_spans(piece.data, starts, ends)
        if len(self._known) > _KNOWN or max(self._ids.nbytes, self._bytes) > _KNOWN_BYTES:
            self._forget()
        raw = piece.data.tobytes()
        chunks = [raw[i:j] for i, j in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        at = np.array([self._known.get(c, -1) for c in chunks], dtype=np.int64)
        new = np.flatnonzero(at < 0)
        fresh = [chunks[i] for i in new.tolist()]
        ids, counts = self.encode_chunks(fresh)
        at[new] = len(self._known) + np.arange(len(new))
        self._known.update(zip(fresh, at[new].tolist(), strict=True))
        self._bytes += sum(map(len, fresh))
        self._offsets = np.concatenate([self._offsets, len(self._ids) + np.cumsum(counts) - counts])
        self._counts = np.concatenate([self._counts, counts])
        self._ids = np.concatenate([self._ids, ids])
        return ChunkIds(self._ids, self._offsets[at], self._counts[at], which, ta.group_starts(docs, len(piece)))

    def _forget(self) -> None:
        self._known: dict[bytes, int] = {}
        self._bytes, self._ids = 0, np.zeros(0, np.int32)
        self._offsets, self._counts = np.zeros(0, np.int64), np.zeros(0, np.int64)


class SegmentTreeBpe(ChunkCoder):
    """Encoder and decoder of a vocabulary file with lower-cased words and word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab: dict[str, int] = {**model["vocab"], **self.special}
        end = model["end_of_word_suffix"]
        self.tokens = [""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.tokens[i] = token
        chars = _byte_chars()
        self._inner = np.array([vocab[c] for c in chars], dtype=np.int32)
        self._final = np.array([vocab[c + end] for c in chars], dtype=np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self._pair_keys = keys[order]
        self._pair_rank = order.astype(np.int64)
        self._merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int32)
        self._none = len(merges)
        super().__init__()

    # -- words -------------------------------------------------------------------------

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols; the number of merges where there is none."""
        keys = left.astype(np.int64) << 20 | right
        at = np.searchsorted(self._pair_keys, keys)
        at[at == len(self._pair_keys)] = 0
        return np.where((self._pair_keys[at] == keys) & (left >= 0) & (right >= 0), self._pair_rank[at], self._none)

    def _merge_lanes(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Merges every row of ``symbols`` (n x width, a power of two) to its end; -1 marks no symbol."""
        n, width = symbols.shape
        none = self._none * width
        tree = np.full((n, 2 * width), none, dtype=np.int32 if none < 2**31 else np.int64)
        place = np.arange(width, dtype=np.int64)
        if width > 1:
            leaves = self._ranks(symbols[:, :-1], symbols[:, 1:]) * width + place[:-1]
            tree[:, width : 2 * width - 1] = np.minimum(leaves, none)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        after = np.minimum(np.broadcast_to(place + 1, (n, width)), lengths[:, None]).astype(np.int32)
        before = np.broadcast_to(place - 1, (n, width)).astype(np.int32)

        def put(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            node = at + width
            tree[rows, node] = value
            while True:
                node = node >> 1
                if not len(node) or node[0] < 1:
                    return
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        rows = np.flatnonzero(tree[:, 1] < none)
        while len(rows):
            if n == 1 and width >= _WIDE and self._merge_all(symbols[0], tree[0], before[0], after[0], int(lengths[0])):
                rows = rows[tree[rows, 1] < none]
                continue
            best = tree[rows, 1]
            at, merged = best % width, self._merged[best // width]
            right = after[rows, at].astype(np.int64)
            beyond = after[rows, right].astype(np.int64)
            left = before[rows, at].astype(np.int64)
            symbols[rows, at] = merged
            symbols[rows, right] = -1
            after[rows, at] = beyond
            more = beyond < lengths[rows]
            before[rows[more], beyond[more]] = at[more]
            put(rows, right, np.full(len(rows), none))
            follower = np.where(more, symbols[rows, np.minimum(beyond, width - 1)], -1)
            put(rows, at, np.minimum(self._ranks(merged, follower) * width + at, none))
            some = left >= 0
            r, p = rows[some], left[some]
            put(r, p, np.minimum(self._ranks(symbols[r, p], merged[some]) * width + p, none))
            rows = rows[tree[rows, 1] < none]
        return symbols

    def _merge_all(self, symbols: np.ndarray, tree: np.ndarray, before: np.ndarray, after: np.ndarray, length: int) -> bool:
        """Merges all pairs of the root's rank in one long word, from left to right, if that is the same as one by one.

        It is, unless a pair that arises has a lower rank than the root's; then nothing is done.
        """
        width = len(symbols)
        none = self._none * width
        rank = int(tree[1]) // width
        leaves = tree[width:]
        at = np.flatnonzero((leaves >= rank * width) & (leaves < (rank + 1) * width))
        # Of a run of overlapping pairs every second one merges.
        touching = np.concatenate([[False], after[at[:-1]] == at[1:]])
        head = np.maximum.accumulate(np.where(touching, 0, np.arange(len(at))))
        at = at[(np.arange(len(at)) - head) % 2 == 0]
        right = after[at].astype(np.int64)
        beyond = after[right].astype(np.int64)
        value = self._merged[rank]
        old = symbols[at].copy(), symbols[right].copy()
        symbols[at], symbols[right] = value, -1
        more = beyond < length
        left = before[at].astype(np.int64)
        some = left >= 0
        # A left neighbour that was merged away gives way to what it merged into.
        gone = some & (symbols[np.maximum(left, 0)] < 0)
        left[gone] = before[left[gone]]
        follower = np.where(more, symbols[np.minimum(beyond, width - 1)], -1)
        leading = np.full(len(at), -1, dtype=symbols.dtype)
        leading[some] = symbols[left[some]]
        new_at, new_left = self._ranks(np.full(len(at), value), follower), self._ranks(leading, np.full(len(at), value))
        if min(new_at.min(), new_left.min()) < rank:
            symbols[at], symbols[right] = old
            return False
        after[at] = beyond
        before[beyond[more]] = at[more]
        leaves[right] = none
        leaves[at] = np.minimum(new_at * width + at, none)
        leaves[left[some]] = np.minimum(new_left[some] * width + left[some], none)
        level = width
        while level > 1:
            tree[level // 2 : level] = np.minimum(tree[level : 2 * level : 2], tree[level + 1 : 2 * level : 2])
            level //= 2
        return True

    def encode_words(self, blob: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the newline-ended words of ``blob``, joined, and the number of ids of each."""
        data = np.frombuffer(blob, dtype=np.uint8)
        ends = np.flatnonzero(data == 0x0A)
        starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64) if len(ends) else ends
        lengths = ends - starts
        counts = np.zeros(len(ends), dtype=np.int64)
        flat = self._inner[data]
        solid = lengths > 0
        flat[ends[solid] - 1] = self._final[data[ends[solid] - 1]]
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        widths = np.zeros(len(ends), dtype=np.int64)
        widths[solid] = 1 << np.ceil(np.log2(lengths[solid])).astype(np.int64)
        for width in np.unique(widths[solid]).tolist():
            chosen = np.flatnonzero(widths == width)
            lanes = max(1, min(_LANES, (1 << 19) // width))
            for i in range(0, len(chosen), lanes):
                w = chosen[i : i + lanes]
                at = starts[w][:, None] + np.arange(width)
                live = np.arange(width) < lengths[w][:, None]
                symbols = np.where(live, flat[np.minimum(at, len(flat) - 1)], -1).astype(np.int32)
                symbols = self._merge_lanes(symbols, lengths[w])
                keep = symbols >= 0
                counts[w] = keep.sum(axis=1)
                parts.append((w, symbols[keep]))
        offsets = np.cumsum(counts) - counts
        ids = np.empty(int(counts.sum()), dtype=np.int32)
        for w, values in parts:
            n = counts[w]
            ids[np.arange(len(values)) + np.repeat(offsets[w] - (np.cumsum(n) - n), n)] = values
        return ids, counts

    # -- texts -------------------------------------------------------------------------

    def _encode_special(self, chunk: str) -> list[int]:
        """Ids of a chunk that holds a special token's string."""
        out: list[int] = []
        for part in re.split("(" + "|".join(map(re.escape, self.special)) + ")", chunk):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out.extend(self._encode_plain(part)[0].tolist())
        return out

    def _encode_plain(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of newline-separated chunks and the number of ids of each chunk."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # str.lower() would look at a capital sigma's neighbours; the file's rule does not.
        text = text.replace("Σ", "σ").lower()
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        starts, ends = split_pieces(points)
        first, which = ta.distinct_spans(points, starts, ends)
        # Each distinct piece with the character after it, which then becomes a newline.
        lengths = ends[first] - starts[first] + 1
        spelt = ta.ragged_gather(np.append(points, np.uint32(0x0A)), starts[first], lengths)
        spelt[np.cumsum(lengths) - 1] = 0x0A
        ids, counts = self.encode_words(spelt.tobytes().decode("utf-32-le").encode())
        offsets = np.cumsum(counts) - counts
        breaks = np.flatnonzero(points == 0x0A)
        chunk = np.searchsorted(breaks, starts)
        n = np.bincount(chunk, weights=counts[which], minlength=len(breaks) + 1).astype(np.int64)
        return ta.ragged_gather(ids, offsets[which], counts[which]), n

    def encode_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks without blank bytes, joined, and the number of ids of each chunk."""
        if not chunks:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        blob = b"\n".join(chunks)
        marks = [s.encode() for s in self.special]
        if not any(m in blob for m in marks):
            return self._encode_plain(blob.decode("utf-8", "replace"))
        odd = {i: self._encode_special(c.decode("utf-8", "replace")) for i, c in enumerate(chunks) if any(m in c for m in marks)}
        ids, counts = self._encode_plain(b"\n".join(b"" if i in odd else c for i, c in enumerate(chunks)).decode("utf-8", "replace"))
        lists = [odd[i] if i in odd else x.tolist() for i, x in enumerate(np.split(ids, np.cumsum(counts)[:-1]))]
        return np.array([t for x in lists for t in x], dtype=np.int32), np.array([len(x) for x in lists], dtype=np.int64)

    def decode(self, ids: list[int]) -> str:
        """The tokens' strings joined by blanks, as the public file's decoder gives them."""
        return " ".join(self.tokens[i] for i in ids)


class ChunkIds:
    """Ids of the distinct chunks of a slice, and which chunks each document has."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, counts: np.ndarray, which: np.ndarray, bounds: np.ndarray):
        self.ids, self.offsets, self.counts, self.which, self.bounds = ids, offsets, counts, which, bounds

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, joined, and their offsets (one more than documents)."""
        counts = self.counts[self.which]
        ends = np.concatenate([[0], np.cumsum(counts)])
        return ta.ragged_gather(self.ids, self.offsets[self.which], counts), ends[self.bounds]


class _PieceIds:
    """Ids of pieces met before.

    Past ``_KNOWN`` pieces, or ``_KNOWN_BYTES`` of them or their ids, only those that
    were asked for again are kept, and none if these are more than half of that.
    """

    def __init__(self) -> None:
        self._forget()

    def _forget(self) -> None:
        self._known: dict[bytes, int] = {}
        self._again = np.zeros(0, dtype=bool)
        self._bytes, self.ids = 0, np.zeros(0, np.int32)
        self._offsets, self._counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _keep_used(self) -> None:
        kept = np.flatnonzero(self._again)
        pieces = [p for p, again in zip(self._known, self._again.tolist(), strict=True) if again]
        ids, counts = ta.ragged_gather(self.ids, self._offsets[kept], self._counts[kept]), self._counts[kept]
        self._forget()
        if len(pieces) <= _KNOWN // 2 and max(ids.nbytes, sum(map(len, pieces))) <= _KNOWN_BYTES // 2:
            self._add(pieces, ids, counts)

    def _add(self, pieces: list[bytes], ids: np.ndarray, counts: np.ndarray) -> None:
        self._known.update(zip(pieces, range(len(self._known), len(self._known) + len(pieces)), strict=True))
        self._again = np.concatenate([self._again, np.zeros(len(pieces), dtype=bool)])
        self._bytes += sum(map(len, pieces))
        self._offsets = np.concatenate([self._offsets, len(self.ids) + np.cumsum(counts) - counts])
        self._counts = np.concatenate([self._counts, counts])
        self.ids = np.concatenate([self.ids, ids])

    def find(self, pieces: list[bytes], encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of distinct pieces start in ``ids``, and their numbers; ``encode`` gives those of new ones."""
        if len(self._known) > _KNOWN or max(self.ids.nbytes, self._bytes) > _KNOWN_BYTES:
            self._keep_used()
        at = np.array([self._known.get(p, -1) for p in pieces], dtype=np.int64)
        self._again[at[at >= 0]] = True
        new = np.flatnonzero(at < 0)
        at[new] = len(self._known) + np.arange(len(new))
        fresh = [pieces[i] for i in new.tolist()]
        self._add(fresh, *encode(fresh))
        return self._offsets[at], self._counts[at]


class LibraryBpe(ChunkCoder):
    """The tokenizers library as the coder of each distinct chunk.

    Chunks of ASCII are cut into the pieces that the library's pattern makes of them, and
    each distinct piece goes to it once, some at a time between blanks: the last token of
    a piece is marked by its spelling.  Other chunks, and those with the string of a
    special token, go whole, between marks: a NUL between blanks is a token of its own.
    Chunks that hold a NUL themselves are encoded alone.  The library's objects take far
    more memory than the ids in them, so they are dropped after every ``_AT_ONCE`` bytes.
    """

    _TOGETHER, _AT_ONCE = 64, 1 << 16

    def __init__(self, path: str):
        # One thread in a worker: Spark's tasks are the parallelism.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._library.no_truncation()
        self._library.no_padding()
        size = self._library.get_vocab_size(with_added_tokens=True)
        self.tokens = [self._library.id_to_token(i) or "" for i in range(size)]
        (self._mark,) = self._library_ids("\0")
        self._last = np.array([t.endswith(self._library.model.end_of_word_suffix) for t in self.tokens])
        self._special = [str(t).lower().encode() for t in self._library.get_added_tokens_decoder().values()] + [b"\0"]
        self._pieces = _PieceIds()
        super().__init__()

    def _library_ids(self, text: str) -> list[int]:
        return self._library.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def encode_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if not chunks:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        blob = b"\n".join(chunks)
        plain = [True] * len(chunks)
        if not blob.isascii():
            plain = [c.isascii() for c in chunks]
        for mark in self._special:
            if mark in blob.lower():
                plain = [p and mark not in c.lower() for p, c in zip(plain, chunks, strict=True)]
        if not all(plain):
            blob = b"\n".join(c if p else b"" for p, c in zip(plain, chunks, strict=True))
        ids, counts = self._encode_ascii(blob.lower())
        whole = [i for i, p in enumerate(plain) if not p]
        if not whole:
            return ids, counts
        others, sizes = self._encode_whole([chunks[i] for i in whole])
        # The plain chunks' ids, then the others'; taken in the order of the chunks.
        starts = np.cumsum(counts) - counts
        starts[whole], counts[whole] = len(ids) + np.cumsum(sizes) - sizes, sizes
        return ta.ragged_gather(np.concatenate([ids, others]), starts, counts), counts

    def _encode_ascii(self, blob: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of newline-separated chunks of lower-case ASCII, joined, and the number of ids of each chunk."""
        points = np.frombuffer(blob, dtype=np.uint8)
        starts, ends = split_pieces(points)
        first, which = ta.distinct_spans(points, starts, ends)
        pieces = [blob[i:j] for i, j in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        offsets, counts = self._pieces.find(pieces, self._encode_pieces)
        breaks = np.flatnonzero(points == 0x0A)
        n = np.bincount(np.searchsorted(breaks, starts), weights=counts[which], minlength=len(breaks) + 1).astype(np.int64)
        return ta.ragged_gather(self._pieces.ids, offsets[which], counts[which]), n

    def _encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found, low, size = [np.zeros(0, np.int32)], 0, 0
        for high, piece in enumerate(pieces, 1):
            size += len(piece)
            if high == len(pieces) or high - low == 8 * self._TOGETHER or size >= self._AT_ONCE:
                found.append(np.array(self._library_ids(b" ".join(pieces[low:high]).decode()), dtype=np.int32))
                low, size = high, 0
        ids = np.concatenate(found)
        counts = np.diff(np.flatnonzero(self._last[ids]), prepend=-1)
        if len(counts) != len(pieces):
            raise ValueError("the library cut a piece, or ended it without its mark")
        return ids, counts

    def _encode_whole(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        alone = {i: self._library_ids(c.decode("utf-8", "replace")) for i, c in enumerate(chunks) if b"\0" in c}
        found: list[np.ndarray] = []
        low = size = 0
        for high in range(1, len(chunks) + 1):
            size += len(chunks[high - 1])
            if high == len(chunks) or high - low == self._TOGETHER or size >= self._AT_ONCE:
                texts = [(b"" if i in alone else chunks[i]).decode("utf-8", "replace") for i in range(low, high)]
                found.append(np.array(self._library_ids(" \0 ".join(texts) + " \0 "), dtype=np.int32))
                low, size = high, 0
        ids = np.concatenate(found)
        marks = np.flatnonzero(ids == self._mark)
        counts = np.diff(marks, prepend=-1) - 1
        ids = np.delete(ids, marks)
        if alone:
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i, x in alone.items():
                parts[i], counts[i] = np.array(x, dtype=np.int32), len(x)
            ids = np.concatenate(parts)
        return ids, counts


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Appends ``end_id`` to every document of joined ids."""
    n = len(offsets) - 1
    return np.insert(ids, offsets[1:], end_id), offsets + np.arange(n + 1)


@lru_cache(maxsize=2)
def load(path: str, library: bool = False) -> ChunkCoder:
    """The coder of a file, read once in a worker."""
    return LibraryBpe(path) if library else SegmentTreeBpe(path)


def token_rows(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Adds ids and decoded text to batches of (doc_id, text)."""
    bpe = load(path)
    names = np.array(bpe.tokens, dtype=object)
    for batch in batches:
        keys = batch.column(0)
        for piece in ta.slices(batch.column(1)):
            c = bpe.chunks_of(piece)
            used = ta.ragged_gather(c.ids, c.offsets, c.counts)
            flat, spoken = used.astype("<u4").tobytes(), names[used].tolist()
            id_bytes, strings, a = [], [], 0
            for n in c.counts.tolist():
                id_bytes.append(flat[4 * a : 4 * (a + n)])
                strings.append(" ".join(spoken[a : a + n]))
                a += n
            id_bytes, strings = np.array([*id_bytes, None], dtype=object), np.array([*strings, None], dtype=object)
            for low in range(0, len(piece), 256):
                high = min(low + 256, len(piece))
                ids, texts = [], []
                for i in range(low, high):
                    which = c.which[c.bounds[i] : c.bounds[i + 1]]
                    ids.append(b"".join(id_bytes[which].tolist()))
                    texts.append(" ".join(strings[which[c.counts[which] > 0]].tolist()))
                yield pa.RecordBatch.from_arrays([keys.slice(piece.first + low, high - low), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every whole text, and the text decoded from them.

    Returns ``doc_id`` (the id's own type), ``ids`` (binary: little-endian unsigned
    32-bit integers) and ``decoded``; one row for each input row, repeated rows and
    null ids included.  A null or empty text, or one of blanks only (Unicode blanks
    too), has no ids and decodes to the empty string.  A very long text is a slice of
    its own and a very long word a tree of its own; both take memory in proportion to
    their length.  Other columns are not carried; their names can't clash.  One narrow
    pass: nothing is shuffled, and a task holds one slice of texts.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda batches: token_rows(batches, path), f"doc_id {kind}, ids binary, decoded string")
