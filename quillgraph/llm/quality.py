"""Quality scores by histogram gradient-boosted trees over document statistics.

Trees are complete binary trees of one depth, flattened into arrays; a batch of
documents walks all of them level by level with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta

#: Rows of the training sample at most.
SAMPLE = 20_000

_CLASSES = {
    "upper": [b for b in range(0x41, 0x5B)],
    "lower": [b for b in range(0x61, 0x7B)],
    "digit": [b for b in range(0x30, 0x3A)],
    "stop": [ord(c) for c in ".,;:?"],
    "symbol": [b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in ".,;:?"],
    "newline": [0x0A],
    "other": [b for b in range(0x80, 0x100)],
}
_TABLE = np.full(256, len(_CLASSES), dtype=np.int64)
for _i, _bytes in enumerate(_CLASSES.values()):
    _TABLE[_bytes] = _i
FEATURES = [
    *(f"share_{k}" for k in _CLASSES), "log_bytes", "log_words", "log_lines", "mean_word", "spread_word", "longest_word",
    "distinct_words", "top_word", "distinct_pairs", "top_pair", "distinct_lines", "top_line", "mean_line",
    "words_with_stop", "words_with_symbol", "words_upper", "words_short", "words_with_digit",
]


def _variety(docs: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Share of distinct values, and share of the most frequent one, in each document."""
    total = np.maximum(np.bincount(docs, minlength=n), 1)
    if not len(docs):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((hashes, docs))
    d, h = docs[order], hashes[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])]))
    runs, owner = np.diff(np.append(first, len(h))), d[first]
    top = np.zeros(n)
    np.maximum.at(top, owner, runs)
    return np.bincount(owner, minlength=n) / total, top / total


def statistics(piece: ta.TextSlice) -> np.ndarray:
    """The ``FEATURES`` of each document of a slice."""
    n, data = len(piece), piece.data
    sizes = piece.ends - piece.starts
    out = np.zeros((n, len(FEATURES)))
    k = len(_CLASSES)
    owner = np.repeat(np.arange(n), sizes)
    kinds = _TABLE[data]
    counts = np.bincount(owner * (k + 1) + kinds, minlength=n * (k + 1)).reshape(n, k + 1)
    out[:, :k] = counts[:, :k] / np.maximum(sizes, 1)[:, None]
    starts, ends, docs = ta.words(piece)
    length = ends - starts
    words = np.bincount(docs, minlength=n)
    some = np.maximum(words, 1)
    hashes = ta.hash_spans(ta.LOWER[data], starts, ends)
    breaks = np.flatnonzero(data == 0x0A)
    line_starts = np.union1d(piece.starts[sizes > 0], breaks + 1)
    line_starts = line_starts[line_starts < len(data)]
    line_docs = np.searchsorted(piece.starts, line_starts, side="right") - 1
    line_ends = np.append(line_starts, len(data))[1:]
    line_ends = line_ends - (data[line_ends - 1] == 0x0A)
    full = line_ends > line_starts
    line_starts, line_ends, line_docs = line_starts[full], line_ends[full], line_docs[full]
    lines = np.bincount(line_docs, minlength=n)
    out[:, k : k + 3] = np.log1p(np.stack([sizes, words, lines], axis=1))
    mean = np.bincount(docs, weights=length, minlength=n) / some
    out[:, k + 3] = mean
    out[:, k + 4] = np.sqrt(np.maximum(np.bincount(docs, weights=length.astype(float) ** 2, minlength=n) / some - mean**2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, docs, length)
    out[:, k + 5] = np.log1p(longest)
    out[:, k + 6], out[:, k + 7] = _variety(docs, hashes, n)
    pair = np.flatnonzero(docs[1:] == docs[:-1]) if len(docs) else np.zeros(0, np.int64)
    out[:, k + 8], out[:, k + 9] = _variety(docs[pair], ta.mix64(hashes[pair] * np.uint64(3) + hashes[pair + 1]), n)
    out[:, k + 10], out[:, k + 11] = _variety(line_docs, ta.hash_spans(data, line_starts, line_ends), n)
    out[:, k + 12] = np.log1p(np.bincount(line_docs, weights=line_ends - line_starts, minlength=n) / np.maximum(lines, 1))
    if len(docs):
        last, head = kinds[ends - 1], kinds[starts]
        marked = np.concatenate([[0], np.cumsum(kinds == 4)])
        digits = np.concatenate([[0], np.cumsum(kinds == 2)])
        capital = np.concatenate([[0], np.cumsum(kinds == 0)])
        for j, hit in enumerate((last == 3, marked[ends] > marked[starts], (capital[ends] - capital[starts] > 1) & (head == 0), length <= 3, digits[ends] > digits[starts])):
            out[:, k + 13 + j] = np.bincount(docs, weights=hit, minlength=n) / some
    return out


@dataclass
class Trees:
    """Flattened trees: ``feature`` and ``cut`` by tree and inner node, ``leaf`` values by tree."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            total += v[node - inner]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 100, depth: int = 4, rate: float = 0.12, bins: int = 64, damp: float = 2.0) -> Trees:
    """Boosts depth-wise trees on binned features with logistic loss."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    rate_up = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(rate_up / (1 - rate_up)))
    margin = np.full(n, start)
    inner = 2**depth - 1
    feature, cut, leaf = np.zeros((rounds, inner), np.int64), np.full((rounds, inner), np.inf), np.zeros((rounds, inner + 1))
    for t in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            width, base = 2**level, 2**level - 1
            local = node - base
            gain, where = np.zeros(width), np.full((width, 2), -1)
            for j in range(m):
                cell = local * bins + binned[:, j]
                gs = np.bincount(cell, weights=g, minlength=width * bins).reshape(width, bins).cumsum(axis=1)
                hs = np.bincount(cell, weights=h, minlength=width * bins).reshape(width, bins).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                value = gs**2 / (hs + damp) + (gt - gs) ** 2 / (ht - hs + damp) - gt**2 / (ht + damp)
                value[(hs < 1) | (ht - hs < 1)] = 0
                value[:, len(edges[j]) :] = 0
                at = value.argmax(axis=1)
                better = value[np.arange(width), at] > gain + 1e-9
                gain[better] = value[np.arange(width), at][better]
                where[better] = np.stack([np.full(width, j), at], axis=1)[better]
            right = np.zeros(n, dtype=np.int64)
            for i in range(width):
                j, b = where[i]
                if j >= 0:
                    feature[t, base + i], cut[t, base + i] = j, edges[j][b]
                    own = local == i
                    right[own] = binned[own, j] > b
            node = 2 * node + 1 + right
        at = node - inner
        gl, hl = np.bincount(at, weights=g, minlength=inner + 1), np.bincount(at, weights=h, minlength=inner + 1)
        leaf[t] = rate * gl / (hl + damp)
        margin += leaf[t][at]
    return Trees(feature, cut, leaf, start)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Trees | None:
    """Trains on at most ``sample`` labelled rows, those with the smallest hash of the id.

    Null labels and ids are left out; None if no labelled text is found.  The sample's
    ids (bounded by ``sample``) are broadcast.  An id may have several rows; of all that
    match, the ``sample`` with the least hash of id and text are taken, so that what
    reaches the driver, their statistics, is bounded too.
    """
    chosen = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y")).filter("id is not null and y in (0, 1)").orderBy(F.xxhash64("id"), "id", "y").limit(sample)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).join(F.broadcast(chosen), "id").select("y", "text", F.xxhash64("id", "text").alias("draw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in ta.slices(batch.column(1)):
                x = statistics(piece)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.first, len(piece)), pa.array(list(x), pa.list_(pa.float64())), batch.column(2).slice(piece.first, len(piece))], ["y", "x", "draw"])

    got = rows.mapInArrow(run, "y int, x array<double>, draw long").orderBy("draw", "y").limit(sample).toArrow()
    if not got.num_rows:
        return None
    x = np.array(got.column("x").to_pylist())
    y = got.column("y").to_numpy().astype(np.float64)
    order = np.lexsort((*x.T, y))  # the same fit however rows arrived
    return boost(x[order], y[order])


def predict(docs: DataFrame, model: Trees | None, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score of every whole text: ``doc_id, score, predicted``.

    ``score`` is 0 to 1, higher where label 1 is likelier; null and empty texts have
    the score of an empty text.  Without a model all scores are 0.5.  One row for each
    input row, repeated ones and null ids too; other columns are not carried.  Texts of
    any length are read whole; an empty table gives an empty result.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in ta.slices(batch.column(1)):
                score = model.score(statistics(piece)) if model else np.full(len(piece), 0.5)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(piece.first, len(piece)), pa.array(score, pa.float64()), pa.array(score >= threshold, pa.bool_()).cast(pa.int32())], ["doc_id", "score", "predicted"]
                )

    return rows.mapInArrow(run, f"doc_id {kind}, score double, predicted int")
