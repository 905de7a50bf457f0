"""Language-model scores by online logistic context mixing over the bits of tokens.

A token is coded in bits: a word of the dictionary (training words seen at least twice,
the commonest first, and the end of a text) by its prefix code, any other by the code of
an escape and then its bytes with a blank, each by a prefix code of bytes.  So every token
sequence has a probability.  The codes are Huffman's, so that there are few bits to predict.

Each bit of a code has predictions from the code alone, by the counts of all words that go
on so, and from hashed contexts: the previous token, and the two previous ones; each bit of a spelling has those of the last one, two, three and five bytes and of the word so far.  A context's
slot counts zeros and ones; the seven slots that three bits of a code can meet lie side by
side, so that they are hashed once and fetched from memory together.  Weights, gated by how much the longer contexts have seen,
combine the predictions in the logistic domain; an adaptive map refines the mix.

Learning is online: block by block, in the order of the texts, the bits are predicted first,
the weights take a gradient step and the map notes what came; the counters are raised as soon as they are read.
Every task learns from its share; counters are summed, weights averaged.  Then the model
is frozen, so a text's score doesn't depend on where and when it is read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from . import textarrays as ta

#: Words of the dictionary at most (17 bytes each in a task); rarer ones are spelt.
DICTIONARY = 1 << 19
#: Bits of a context's table at most (for codes, by one and by two tokens); tables grow with the distinct tokens up to this.
CODE_BITS, SPELL_BITS = (21, 22), 22
#: Training tokens of a task, about; each task sends its counters once.
TASK_TOKENS = 8_000_000
#: Distinct words of a spelling task, about.
TASK_WORDS = 1_000_000
#: Tokens, and bytes of spellings, of a block that the model learns from at once.
_BLOCK, _SPELT_BLOCK = 1024, 1536
#: Tokens, and bytes of spellings, whose bits are made and scored at once.
_AT_ONCE, _SPELT_AT_ONCE = 2048, 4608
#: Distinct tokens, and their bytes, that a counting task gathers before it emits their counts.
_GATHER, _GATHER_BYTES = 600_000, 64 << 20
_CHUNK = 1 << 16
_GATES, _STEPS, _FINE, _PRIOR, _LIMIT = 25, 33, 4096, 0.4, 12.0
_EDGES = np.array([0.5, 2.5, 12.0, 80.0])
#: What a counter's code stands for: small counts exactly, larger ones in steps of an eighth.
_VALUE = np.concatenate([np.arange(16), 16 * 1.125 ** np.arange(240)])
_CUTS = np.sqrt(_VALUE[1:] * np.maximum(_VALUE[:-1], 0.25))
_FLOAT_PRIOR = np.float32(_PRIOR)
_START = np.uint64(0xD1B54A32D192ED03)
_END = np.uint64(0x9AE16A3B2F90404F)
#: Bits of a code whose slots lie side by side, the log of these slots' number, and for each value of the bits, each bit and its slot.
_RUN, _SIDE = 3, 3
_BITS = (np.arange(1 << _RUN)[:, None] >> np.arange(_RUN - 1, -1, -1) & 1).astype(np.int64)
_SLOTS = (np.arange(1 << _RUN)[:, None] >> np.arange(_RUN, 0, -1)) + (1 << np.arange(_RUN))
_SCHEMA = "at long, counts binary, mass double, weights binary, seen binary"


def _stretched(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.clip(np.log((ones + _PRIOR) / (zeros + _PRIOR)), -_LIMIT, _LIMIT).astype(np.float32)


#: The log-odds and the level of trust of each pair of coded counters (zeros << 8 | ones).
_PAIR_STRETCH = _stretched(np.repeat(_VALUE, 256), np.tile(_VALUE, 256))
_PAIR_LEVEL = np.searchsorted(_EDGES, np.repeat(_VALUE, 256) + np.tile(_VALUE, 256)).astype(np.uint8)


def _fresh_map() -> np.ndarray:
    """For each gate and step of the stretched probability: ones and all, as if seen twice."""
    grid = 1 / (1 + np.exp(-np.linspace(-_LIMIT, _LIMIT, _STEPS)))
    return np.stack([np.tile(2 * grid, (_GATES, 1)), np.full((_GATES, _STEPS), 2.0)], axis=-1)


class Mixer:
    """Counters of all contexts' tables, weights by gate, and the refining map.

    While it learns the counters are numbers, zeros and ones in turn; a frozen model has
    them as pairs of codes.  The last two tables decide the gate.  With ``known`` the first
    input isn't counted: it has these log-odds, and the first row of slots are places there.
    """

    def __init__(self, bits: list[int], known: np.ndarray | None = None):
        self.bits, self.known = bits, known
        self.starts = np.concatenate([[0], np.cumsum([1 << b for b in bits])]).astype(np.int64)
        self.counted = slice(known is not None, -1)
        self.inputs = len(bits) + 1 + (known is not None)
        self.counts: np.ndarray | None = None
        self.pairs: np.ndarray | None = None
        self.weights = np.full((_GATES, self.inputs), 0.35, np.float32)
        self.seen = _fresh_map()
        self.odds: np.ndarray | None = None
        self.adapted = 0

    def slots(self, k: int, hashes: np.ndarray) -> np.ndarray:
        """Places of hashed contexts in table ``k``."""
        return (hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits[k])).astype(np.int64) + self.starts[k]

    def _given(self, slots: np.ndarray) -> np.ndarray:
        """Inputs (x bits), with those that no counter gives."""
        x = np.empty((self.inputs, slots.shape[1]), dtype=np.float32)
        if self.known is not None:
            x[0] = self.known.take(slots[0])
        x[-1] = 0.3
        return x

    def _frozen(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Stretched predictions (inputs x bits) of the frozen model, and how much the longer contexts have seen."""
        x = self._given(slots)
        pair = self.pairs.take(slots[self.counted.start :]).astype(np.intp)
        _PAIR_STRETCH.take(pair, out=x[self.counted], mode="clip")
        return x, _PAIR_LEVEL.take(pair[-2:])

    def _raised(self, slots: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of the counters as they are; then these are raised, table by table, while a processor still has them near."""
        x = self._given(slots)
        both = np.empty((len(self.bits), len(bit)), dtype=np.complex64)  # zeros and ones side by side
        sides, one = self.counts.view(np.complex64), np.ones(len(bit), np.float32)
        for k, at in enumerate(slots[self.counted.start :]):
            sides.take(at, out=both[k], mode="clip")
            np.add.at(self.counts, 2 * at + bit, one)
        zeros, ones = both.real, both.imag
        np.log((ones + _FLOAT_PRIOR) / (zeros + _FLOAT_PRIOR), out=x[self.counted])
        np.clip(x[self.counted], -_LIMIT, _LIMIT, out=x[self.counted])
        total = zeros[-2:] + ones[-2:]
        level = np.zeros(total.shape, dtype=np.uint8)
        for edge in _EDGES.astype(np.float32):
            level += total > edge
        return x, level

    def _mixed(self, x: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The gate, and the mixed log-odds."""
        gate = (level[1] * np.uint8(5) + level[0]).astype(np.intp)
        weights = np.ascontiguousarray(self.weights.T)
        m = weights[-1].take(gate) * np.float32(0.3)
        for w, stretched in zip(weights[:-1], x[:-1], strict=True):
            m += w.take(gate) * stretched
        return gate, np.clip(m, -_LIMIT, _LIMIT, out=m)

    def log10(self, slots: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """log10 probability of each bit under the frozen model."""
        if self.odds is None:
            self._tabulate()
        gate, m = self._mixed(*self._frozen(slots))
        m += np.float32(_LIMIT)
        m *= np.float32((_FINE - 1) / (2 * _LIMIT))
        m += np.float32(0.5)
        gate *= _FINE
        gate += m.astype(np.int64)
        gate *= 2
        gate += bit
        return self.odds.take(gate)

    def _tabulate(self) -> None:
        """Each bit's log10 probability by gate and finely stepped mix: the mix and its refinement, averaged."""
        m = np.linspace(-_LIMIT, _LIMIT, _FINE)
        at = (m + _LIMIT) * ((_STEPS - 1) / (2 * _LIMIT))
        low = np.minimum(at.astype(np.int64), _STEPS - 2)
        ratio = self.seen[..., 0] / self.seen[..., 1]
        refined = ratio[:, low] + (ratio[:, low + 1] - ratio[:, low]) * (at - low)
        p = np.clip((refined + 1 / (1 + np.exp(-m))) / 2, 1e-7, 1 - 1e-7)
        self.odds = np.log10(np.stack([1 - p, p], axis=-1)).astype(np.float32).ravel()

    def learn(self, slots: np.ndarray, bit: np.ndarray) -> None:
        """Learns from a block of bits, each of which is predicted before it raises the counters.

        The weights take a step, scaled by the loss's curvature, and the map notes what came.
        """
        x, level = self._raised(slots, bit)
        gate, m = self._mixed(x, level)
        p = 1 / (1 + np.exp(-m))
        wrong, bend = bit.astype(np.float32) - p, np.maximum(p * (1 - p), np.float32(1e-3))
        rate = max(0.02, 0.3 / (1 + self.adapted / 4))
        by_gate = lambda rows: np.stack([np.bincount(gate, weights=r, minlength=_GATES) for r in rows], axis=1)
        slope, curve = by_gate(x * wrong), by_gate(x * x * bend)
        self.weights += (rate * slope / (curve + 4)).astype(np.float32)
        gate *= _STEPS
        gate += np.rint((m + np.float32(_LIMIT)) * np.float32((_STEPS - 1) / (2 * _LIMIT))).astype(np.int64)
        gate *= 2
        gate += bit
        both = np.bincount(gate, minlength=2 * _GATES * _STEPS).reshape(_GATES, _STEPS, 2)
        self.seen *= 0.999  # what early weights gave fades
        self.seen[..., 1] += both[..., 0] + both[..., 1]
        self.seen[..., 0] += both[..., 1]
        self.adapted += 1

    def learn_blocks(self, slots: np.ndarray, bit: np.ndarray, begin: np.ndarray) -> None:
        """Learns from blocks in turn; ``begin`` tells where each one's bits begin."""
        for i, j in zip(begin.tolist(), [*begin[1:].tolist(), len(bit)], strict=True):
            self.learn(slots[:, i:j], bit[i:j])

    # -- between tasks -------------------------------------------------------------------

    def begin(self) -> None:
        n = 2 * int(self.starts[-1])
        room = np.zeros(n + 16, dtype=np.float32)
        skip = -room.ctypes.data % 64 // 4  # slots side by side are one line of a processor's cache
        self.counts = room[skip : skip + n]

    def parts(self, mass: float) -> Iterator[pa.RecordBatch]:
        """What a task has learnt: counters in chunks of 16 bits each, weights and map in one row."""
        for i in range(0, len(self.counts), _CHUNK):
            part = self.counts[i : i + _CHUNK]
            if part.any():
                short = (part.view(np.uint32) + np.uint32(0x8000) >> np.uint32(16)).astype("<u2")
                yield _part(i, short.tobytes(), 0.0, b"", b"")
        yield _part(-1, b"", mass, self.weights.tobytes(), (self.seen - _fresh_map() * 0.999**self.adapted).tobytes())

    def freeze(self, learnt: DataFrame) -> Mixer:
        """Sums what all tasks have learnt; the model has a fixed size, so that much reaches the driver."""
        inputs = self.inputs

        def add(group: pa.Table) -> pa.Table:
            at = group.column("at")[0].as_py()
            if at >= 0:
                total = np.zeros(0)
                for raw in group.column("counts").to_pylist():
                    part = (np.frombuffer(raw, "<u2").astype(np.uint32) << np.uint32(16)).view(np.float32)
                    total = part.astype(np.float64) if not len(total) else total + part
                codes = np.searchsorted(_CUTS, total).astype(np.uint16)
                out = (at, (codes[::2] << np.uint16(8) | codes[1::2]).astype("<u2").tobytes(), 0.0, b"", b"")
            else:
                mass = np.array(group.column("mass").to_pylist())
                weights = np.average([np.frombuffer(w, np.float32) for w in group.column("weights").to_pylist()], axis=0, weights=mass)
                seen = np.sum([np.frombuffer(s) for s in group.column("seen").to_pylist()], axis=0)
                out = (at, b"", float(mass.sum()), weights.astype(np.float32).tobytes(), seen.tobytes())
            return pa.Table.from_batches([_part(*out)])

        self.pairs = np.zeros(int(self.starts[-1]), dtype=np.uint16)
        for r in learnt.groupBy("at").applyInArrow(add, _SCHEMA).collect():
            if r["at"] >= 0:
                part = np.frombuffer(r["counts"], "<u2")
                self.pairs[r["at"] // 2 : r["at"] // 2 + len(part)] = part
            else:
                self.weights = np.frombuffer(r["weights"], np.float32).reshape(_GATES, inputs).copy()
                self.seen = _fresh_map() + np.frombuffer(r["seen"]).reshape(_GATES, _STEPS, 2)
        return self


def _part(at: int, counts: bytes, mass: float, weights: bytes, seen: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([at], pa.int64()), pa.array([counts], pa.binary()), pa.array([mass]), pa.array([weights], pa.binary()), pa.array([seen], pa.binary())],
        ["at", "counts", "mass", "weights", "seen"],
    )


# -- codes of tokens ---------------------------------------------------------------------


@dataclass
class Dictionary:
    """Hashes of the words in ascending order, their counts and codes; the escape's code is the last.

    ``known`` has the log-odds of a one at each place of the codes, by the counts of all
    words with that beginning.  A run of bits has its places side by side; those of the
    runs that begin at one depth are numbered by their beginnings, from ``base`` on.
    """

    keys: np.ndarray
    counts: np.ndarray
    code: np.ndarray
    size: np.ndarray
    known: np.ndarray
    base: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, counts: np.ndarray, tokens: int) -> Dictionary:
        """Huffman codes of the words' counts, and of the escape's: all other tokens."""
        order = np.argsort(hashes)
        keys, counts = hashes[order], counts[order]
        weight = np.append(counts, max(1, tokens - int(counts.sum())))
        code, size = prefix_codes(weight)
        # Codes ascend with their sizes, so those that go on at a depth have the highest beginnings there.
        base, lines = [], 0
        for depth in range(0, int(size.max()), _RUN):
            longer = size > depth
            begin = code[longer] >> (size[longer] - depth).astype(np.uint64)
            base.append(lines - int(begin.min()))
            lines += int(begin.max()) - int(begin.min()) + 1
        out = cls(keys, counts, code, size, np.zeros(0, np.float32), np.array(base, np.int64))
        seen = np.zeros(2 * lines << _SIDE)
        for low in range(0, len(size), _CHUNK):
            part = slice(low, low + _CHUNK)
            _, bit, slots = coded_bits(code[part], size[part], [], out)  # only the places
            np.add.at(seen, 2 * slots[0] + bit, np.repeat(weight[part], size[part]).astype(np.float64))
        out.known = _stretched(seen[::2], seen[1::2])
        return out

    @cached_property
    def _lead(self) -> tuple[np.uint64, np.ndarray]:
        """How far to shift a hash for its first bits, and where the keys with each value of these begin."""
        bits = max(int(len(self.keys)).bit_length(), 1)
        shift = np.uint64(64 - bits)
        many = np.bincount((self.keys >> shift).astype(np.intp), minlength=1 << bits)
        return shift, np.append(0, np.cumsum(many)).astype(np.int32)

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each token in the dictionary; the escape's where it isn't."""
        out = np.full(len(hashes), len(self.keys), np.int64)
        shift, lead = self._lead
        first = (hashes >> shift).astype(np.intp)
        at, stop = lead.take(first), lead.take(first + 1)
        left = np.flatnonzero(at < stop)
        at, stop, sought = at[left], stop[left], hashes[left]
        while len(left):
            same = self.keys.take(at) == sought
            out[left[same]] = at[same]
            at += 1
            on = np.flatnonzero(~same & (at < stop))
            left, at, stop, sought = left[on], at[on], stop[on], sought[on]
        return out


def prefix_codes(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Huffman's code for each weight, and its bits; shorter codes come first in the order of their values."""
    rank = np.lexsort((np.arange(len(weights)), -weights))
    n = len(weights)
    size = np.ones(n, np.int64)
    if n > 1:
        # Leaves from the lightest on, then the joined nodes, whose weights ascend as they are made.
        heavy = [*weights[rank[::-1]].tolist(), *[0] * (n - 1)]
        up = [0] * (2 * n - 1)
        leaf, node = 0, n
        for made in range(n, 2 * n - 1):
            for _ in range(2):
                if leaf < n and (node >= made or heavy[leaf] <= heavy[node]):
                    least, leaf = leaf, leaf + 1
                else:
                    least, node = node, node + 1
                up[least] = made
                heavy[made] += heavy[least]
        depth = [0] * (2 * n - 1)
        for i in range(2 * n - 3, -1, -1):
            depth[i] = depth[up[i]] + 1
        size[rank] = depth[:n][::-1]
    code = np.zeros(n, dtype=np.uint64)
    # In whole numbers: each code begins where the one before ends, at its own precision.
    at, last = 0, int(size[rank[0]])
    for i, bits in zip(rank.tolist(), size[rank].tolist(), strict=True):
        at <<= bits - last
        code[i], last = at, bits
        at += 1
    return code, size


def coded_bits(
    code: np.ndarray, size: np.ndarray, contexts: list[np.ndarray], words: Dictionary | None = None, model: Mixer | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits of the codes and their slots by context, and where each code's bits begin; first the places in what ``words`` knows."""
    runs = (size + (_RUN - 1)) // _RUN
    which = np.repeat(np.arange(len(size)), runs)
    done = _RUN * (np.arange(len(which)) - (np.cumsum(runs) - runs).take(which))
    left = size.take(which) - done
    code, shift = code.take(which), left.astype(np.uint64)
    begin = code >> shift
    node = (begin | np.uint64(1) << done.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
    node ^= node >> np.uint64(29)
    # The next bits of a code, as if it ended in zeros where it has fewer.
    value = (code << np.uint64(_RUN) >> shift).astype(np.int64) & ((1 << _RUN) - 1)
    some = np.minimum(left, _RUN)
    run = np.repeat(np.arange(len(which)), some)
    at = (_RUN * value - (np.cumsum(some) - some)).take(run) + np.arange(len(run))
    bit, side = _BITS.take(at), _SLOTS.take(at)
    lines = [model.slots(k, c.take(which) ^ node) for k, c in enumerate(contexts)]
    if words is not None:
        lines.insert(0, words.base.take(done // _RUN) + begin.astype(np.int64) << _SIDE)
    slots = np.empty((len(lines), len(run)), dtype=np.int64)
    for out, line in zip(slots, lines, strict=True):
        np.bitwise_xor(line.take(run), side, out=out)  # within a line of eight, evenly where contexts share it
    return np.cumsum(size) - size, bit, slots


class Tokens:
    """The tokens of a slice's texts, each text with its end: hashes, documents, places and contexts."""

    def __init__(self, piece: ta.TextSlice, words: Dictionary):
        self.data = ta.LOWER[piece.data]
        starts, stops, docs = ta.words(piece)
        n = len(piece)
        bounds = ta.group_starts(docs, n)
        self.hash = np.insert(ta.hash_spans(self.data, starts, stops), bounds[1:], _END)
        self.doc = np.insert(docs, bounds[1:], np.arange(n))
        self.starts, self.stops = np.insert(starts, bounds[1:], 0), np.insert(stops, bounds[1:], 0)
        self.symbol = words.symbols(self.hash)
        self.first = (bounds + np.arange(n + 1))[:-1]
        place = np.arange(len(self.hash))
        begin = self.first[self.doc]
        prev = self._before(place - 1, begin)
        two = prev * np.uint64(0xBF58476D1CE4E5B9) + self._before(place - 2, begin)
        self.contexts = [ta.mix64(prev + np.uint64(1)), ta.mix64(two + np.uint64(2))]

    def _before(self, at: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The token at each place, or a mark where that is before its text."""
        return np.where(at >= begin, self.hash[np.maximum(at, 0)], _START) if len(at) else np.zeros(0, np.uint64)

    def bits(self, words: Dictionary, model: Mixer, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits of the codes of tokens ``low`` to ``high - 1`` and their slots, and where each token's bits begin."""
        symbol = self.symbol[low:high]
        contexts = [c[low:high] for c in self.contexts]
        if model.known is None:
            return coded_bits(words.code[symbol], words.size[symbol], [np.zeros(len(symbol), np.uint64), *contexts], None, model)
        return coded_bits(words.code[symbol], words.size[symbol], contexts, words, model)


# -- spellings ---------------------------------------------------------------------------


class Spelling:
    """Bytes of words, each with its blank, and the contexts of each byte."""

    _ORDERS = (1, 2, 3, 5)

    def __init__(self, words: list[bytes], code: tuple[np.ndarray, np.ndarray] | None = None):
        self.code, self.size = byte_codes([]) if code is None else code
        self.data = np.frombuffer(b" ".join(words) + b" ", dtype=np.uint8)
        sizes = np.array([len(w) + 1 for w in words], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        self.word = np.repeat(np.arange(len(words)), sizes)
        begin = starts[self.word]
        n = len(self.data)
        place = np.arange(n)
        self.contexts = []
        h = np.zeros(n, dtype=np.uint64)
        for back in range(1, self._ORDERS[-1] + 1):
            at = place - back
            byte = np.where(at >= begin, self.data[np.maximum(at, 0)], 0x20).astype(np.uint64)
            h = (h + byte + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
            if back in self._ORDERS:
                self.contexts.append(h.copy())
        self.contexts.append(ta.prefix_hashes(self.data, begin) + np.uint64(7))

    def bits(self, model: Mixer, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each bit of bytes ``low`` to ``high - 1``: its word, itself and its slots."""
        byte = self.data[low:high]
        size = self.size[byte]
        _, bit, slots = coded_bits(self.code[byte], size, [c[low:high] for c in self.contexts], None, model)
        return np.repeat(self.word[low:high], size), bit, slots


def byte_codes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Huffman's code of each byte value in such words and their blanks; an even share keeps those of rare bytes short."""
    seen = np.bincount(np.frombuffer(b" ".join(words) + b" ", dtype=np.uint8), minlength=256) if words else np.zeros(256, np.int64)
    return prefix_codes(16 * seen + int(seen.sum()) // 256 + 1)


def log10_spellings(words: list[bytes], model: Mixer, code: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """log10 probability of each word's bytes and its blank under the frozen model."""
    out = np.zeros(len(words))
    if words:
        s = Spelling(words, code)
        for low in range(0, len(s.data), _SPELT_AT_ONCE):
            word, bit, slots = s.bits(model, low, min(low + _SPELT_AT_ONCE, len(s.data)))
            first = int(word[0])
            part = np.bincount(word - first, weights=model.log10(slots, bit))
            out[first : first + len(part)] += part
    return out


# -- Spark jobs --------------------------------------------------------------------------


def vocabulary(docs: DataFrame, text_col: str, train: Column) -> DataFrame:
    """Every distinct token of all texts with its count in training texts: ``word, c``.

    Words are runs of non-blank bytes with A-Z lower-cased; the empty word is the end of
    a text.  Tasks sum up what they read before anything is shuffled.
    """
    rows = docs.select(docs[text_col].cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[pa.Table] = []
        texts, ends = 0, 0

        def summed() -> pa.Table:
            return pa.concat_tables(found).group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns(["word", "c"])

        def rows_of() -> Iterator[pa.RecordBatch]:
            yield from summed().cast(pa.schema([("word", pa.binary()), ("c", pa.int64())])).to_batches(max_chunksize=50_000)

        for batch in batches:
            flags = np.asarray(batch.column(1).to_pylist(), dtype=bool)
            texts, ends = texts + len(flags), ends + int(flags.sum())
            for piece in ta.slices(batch.column(0)):
                starts, stops, docs_ = ta.words(piece)
                if not len(starts):
                    continue
                solid = ta.LOWER[piece.data[~ta.BLANK[piece.data]]]  # the words, one after the other
                offsets = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int64)
                spans = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(solid)]).dictionary_encode()
                n = np.bincount(np.asarray(spans.indices), weights=flags[piece.first + docs_], minlength=len(spans.dictionary)).astype(np.int64)
                found.append(pa.table({"word": spans.dictionary, "c": pa.array(n)}))
                if sum(len(t) for t in found) > 2 * _GATHER or sum(t.nbytes for t in found) > _GATHER_BYTES:
                    found = [summed()]
                    if len(found[0]) > _GATHER or found[0].nbytes > _GATHER_BYTES // 2:
                        yield from rows_of()
                        found = []
        if found:
            yield from rows_of()
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([b""], pa.binary()), pa.array([ends], pa.int64())], ["word", "c"])

    return rows.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _gathered(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Words and counts some at a time, by bytes."""
    words: list[bytes] = []
    counts: list[int] = []
    size = 0
    for batch in batches:
        for word, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words.append(word), counts.append(c)
            size += len(word) + 1
            if size >= most:
                yield words, np.array(counts, np.int64)
                words, counts, size = [], [], 0
    if words:
        yield words, np.array(counts, np.int64)


def _fewer(df: DataFrame, tasks: int) -> DataFrame:
    """At most so many tasks, without a shuffle."""
    return df.coalesce(max(1, tasks))


def _learn_codes(texts: DataFrame, words, model: Mixer, tokens: int) -> Mixer:
    """Learns the codes' bits from training texts (column ``text``)."""
    bits = model.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Mixer(bits, words.value.known)
        own.begin()
        mass = 0
        for batch in batches:
            for piece in ta.slices(batch.column(0)):
                t = Tokens(piece, words.value)
                for low in range(0, len(t.hash), _AT_ONCE):
                    first, bit, slots = t.bits(words.value, own, low, min(low + _AT_ONCE, len(t.hash)))
                    own.learn_blocks(slots, bit, first[::_BLOCK])
                mass += len(t.hash)
        if mass:
            yield from own.parts(float(mass))

    return model.freeze(_fewer(texts, -(-tokens // TASK_TOKENS)).mapInArrow(run, _SCHEMA))


def _learn_spellings(vocab: DataFrame, model: Mixer, distinct: int, code: tuple[np.ndarray, np.ndarray]) -> Mixer:
    """Learns the bytes' bits from the distinct training words, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Mixer(model.bits)
        own.begin()
        mass = 0
        for spelt, _ in _gathered(batches):
            order = np.random.default_rng(len(spelt)).permutation(len(spelt))
            s = Spelling([spelt[i] for i in order.tolist()], code)
            for low in range(0, len(s.data), _SPELT_AT_ONCE):
                high = min(low + _SPELT_AT_ONCE, len(s.data))
                _, bit, slots = s.bits(own, low, high)
                ends = np.cumsum(s.size[s.data[low:high]])
                own.learn_blocks(slots, bit, np.append(0, ends[_SPELT_BLOCK - 1 : -1 : _SPELT_BLOCK]))
            mass += len(s.data)
        if mass:
            yield from own.parts(float(mass))

    return model.freeze(_fewer(vocab.filter("c > 0").select("word", "c"), -(-distinct // TASK_WORDS)).mapInArrow(run, _SCHEMA))


def score_corpus(docs: DataFrame, is_training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores every whole text with a model of the training texts.

    Returns ``doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``:
    tokens with the end, those that training texts have, all training tokens, the sum of
    log10((c + 0.1) / (N + 0.1 (V + 1))), the mixing model's log10 probability of the
    tokens, and its bits for each byte of them.  A null or empty text has the end alone.
    Repeated rows and null ids are scored each.  Tokens of any length are read whole.
    Other columns are not carried.  An empty table gives an empty result; without
    training texts all counters are empty.

    What grows with the corpus (its words and their counts) stays in tables.  The
    dictionary and the counters have a fixed bound and are broadcast; the other tokens of
    a text meet the vocabulary in a join, where none of them is frequent enough to be hot.
    """
    sc = docs.sparkSession.sparkContext
    training = F.coalesce(is_training, F.lit(False))
    vocab = written(vocabulary(docs, text_col, training), "lm-vocabulary")
    n, v, distinct = (x or 0 for x in vocab.agg(F.sum("c"), F.count_if(F.col("c") > 0), F.count(F.lit(1))).first())
    top = vocab.filter("c > 1").orderBy(F.desc("c"), "word").limit(DICTIONARY).toArrow()
    spelt = top.column("word").combine_chunks().to_pylist() if top.num_rows else []
    plain = Dictionary.of(token_hashes(spelt), np.asarray(top.column("c")) if spelt else np.zeros(0, np.int64), n)
    letters = byte_codes(spelt)
    del spelt, top
    words = sc.broadcast(plain)
    room = math.ceil(math.log2(max(distinct, 2)))
    codes = sc.broadcast(_learn_codes(docs.filter(training).select(docs[text_col].cast("string").alias("text")), words, Mixer([min(max(room + 4 + k, 16), most) for k, most in enumerate(CODE_BITS)], plain.known), n))
    most = min(max(room + 2, 16), SPELL_BITS)
    spellings = sc.broadcast(_learn_spellings(vocab, Mixer([16, min(18, most), min(20, most), most, most]), v, letters))

    def score_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got, c in _gathered(batches):
            rare = np.flatnonzero(words.value.symbols(token_hashes(got)) == len(words.value.keys))
            got, c = [got[i] for i in rare.tolist()], c[rare]
            base = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary()), pa.array(c), pa.array(base), pa.array(log10_spellings(got, spellings.value, letters))], ["word", "c", "base", "logp"])

    scored = written(vocab.mapInArrow(score_words, "word binary, c long, base double, logp double"), "lm-tokens")
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, model = words.value, codes.value
        base_of = np.append(np.log10((d.counts + 0.1) / (n + 0.1 * (v + 1))), 0.0)
        for batch in batches:
            for piece in ta.slices(batch.column(1)):
                t, size = Tokens(piece, d), len(piece)
                logp = np.zeros(size)
                for low in range(0, len(t.hash), _AT_ONCE):
                    first, bit, slots = t.bits(d, model, low, min(low + _AT_ONCE, len(t.hash)))
                    # Every token has a bit at least, so the sums by token are those from one first bit to the next.
                    of_token = np.add.reduceat(model.log10(slots, bit).astype(np.float64), first)
                    part = np.bincount(t.doc[low : low + _AT_ONCE] - t.doc[low], weights=of_token)
                    logp[t.doc[low] : t.doc[low] + len(part)] += part
                known = t.symbol < len(d.keys)
                total = lambda w, doc=t.doc, m=size: np.bincount(doc, weights=w, minlength=m)
                raw, far = t.data.tobytes(), np.flatnonzero(~known)
                bounds = np.searchsorted(t.doc[far], np.arange(size + 1))
                rest = [raw[i:j] for i, j in zip(t.starts[far].tolist(), t.stops[far].tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(rest, pa.binary()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(piece.first, size), pa.array(np.bincount(t.doc, minlength=size), pa.int64()), pa.array(total(t.stops - t.starts + 1), pa.float64()),
                        pa.array(total(known).astype(np.int64)), pa.array(total(base_of[t.symbol])), pa.array(logp), lists,
                    ],
                    ["doc_id", "n_tokens", "bytes", "n_known", "base", "logp", "rest"],
                )

    texts = rows.mapInArrow(read, f"doc_id {kind}, n_tokens long, bytes double, n_known long, base double, logp double, rest array<binary>")
    texts = written(texts.withColumn("row", F.monotonically_increasing_id()), "lm-texts")
    rest = texts.select("row", F.explode("rest").alias("word")).groupBy("row", "word").agg(F.count(F.lit(1)).alias("tf"))
    rest = rest.join(scored, "word").select("row", F.when(F.col("c") > 0, F.col("tf")).otherwise(0).alias("n_known"), (F.col("tf") * F.col("base")).alias("base"), (F.col("tf") * F.col("logp")).alias("logp"))
    first = texts.select("row", F.struct("doc_id", "n_tokens", "bytes").alias("text"), "n_known", "base", "logp")
    both = first.unionByName(rest, allowMissingColumns=True).groupBy("row")
    out = both.agg(F.first("text", ignorenulls=True).alias("text"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("logp").alias("score"))
    bits = F.col("score") * F.lit(-float(np.log2(10))) / F.col("text.bytes")
    return out.select("text.doc_id", "text.n_tokens", "n_known", F.lit(int(n)).cast("bigint").alias("train_tokens"), "base_score", "score", bits.alias("bits_per_byte"))


def token_hashes(words: list[bytes]) -> np.ndarray:
    """Hashes of tokens as ``hash_spans`` gives them; the end has one of its own."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    ends = np.cumsum(lengths)
    out = np.full(len(words), _END, dtype=np.uint64)
    solid = lengths > 0
    out[solid] = ta.hash_spans(np.frombuffer(b"".join(words), dtype=np.uint8), (ends - lengths)[solid], ends[solid])
    return out
