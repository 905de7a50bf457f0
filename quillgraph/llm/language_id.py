"""Language identification with error-correcting output codes.

Each language has a codeword; one binary n-gram classifier predicts each of its bits.
Decoding sums the weighted logistic losses of all bits and takes the language whose
codeword loses least; a near second marks the text as ambiguous.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta

#: Hashed trigram features.
FEATURES = 4096
#: Training documents of a language, about; the sample is bounded by this times the languages.
PER_LANGUAGE = 600
_BLOCK = 512

_FOLD = ta.LOWER.copy()
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 0x20
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[[b for b in range(128) if chr(b).isalpha()]] = True


def trigram_features(piece: ta.TextSlice, first: int, last: int) -> np.ndarray:
    """Root of the share of each hashed byte trigram in documents ``first`` to ``last - 1``.

    A-Z are lower-cased and other ASCII characters are blanks; trigrams do not cross
    documents.
    """
    a, b = int(piece.starts[first]), int(piece.ends[last - 1])
    n = last - first
    sizes = piece.ends[first:last] - piece.starts[first:last]
    starts = piece.starts[first:last] - a
    c0 = _FOLD[piece.data[a:b]].astype(np.uint32)
    c1, c2 = np.empty_like(c0), np.empty_like(c0)
    if len(c0):
        c1[0], c1[1:] = 0x20, c0[:-1]
        c1[starts[sizes > 0]] = 0x20
        c2[0], c2[1:] = 0x20, c1[:-1]
        c2[starts[sizes > 0]] = 0x20
    code = ((c2 * np.uint32(0x01000193) + c1) * np.uint32(0x01000193) + c0) * np.uint32(0x9E3779B1)
    cell = np.repeat(np.arange(n, dtype=np.int64) * FEATURES, sizes) + (code >> np.uint32(20))
    counts = np.bincount(cell, minlength=n * FEATURES).reshape(n, FEATURES).astype(np.float32)
    return np.sqrt(counts / np.maximum(sizes, 1)[:, None].astype(np.float32))


def has_letter(piece: ta.TextSlice, first: int, last: int) -> np.ndarray:
    data = piece.data
    out = np.zeros(last - first, dtype=bool)
    for i in range(first, last):
        part = data[piece.starts[i] : piece.ends[i]]
        out[i - first] = bool(_ASCII_LETTER[part[:64]].any() or _ASCII_LETTER[part].any())
        if not out[i - first] and (part > 127).any():
            out[i - first] = any(c.isalpha() for c in part.tobytes().decode("utf-8", "replace"))
    return out


def codewords(k: int) -> np.ndarray:
    """Codewords (k x bits, -1 or 1): exhaustive to five languages, else a seeded random code.

    The random code is the best of 200 draws by its least distance between codewords.
    """
    if k == 1:
        return np.ones((1, 1))
    if k <= 5:
        columns = [c for c in itertools.product((-1, 1), repeat=k) if c[0] == 1 and len(set(c)) == 2]
        return np.array(columns, dtype=np.float64).T
    bits = 8 * int(np.ceil(np.log2(k))) + 7
    rng, best, far = np.random.default_rng(20), None, -1
    for _ in range(200):
        m = rng.choice([-1.0, 1.0], (k, bits))
        m[0, np.abs(m.sum(axis=0)) == k] *= -1
        d = (bits - m @ m.T) / 2 + bits * np.eye(k)
        if d.min() > far:
            best, far = m, d.min()
    return best


@dataclass
class LanguageModel:
    """Languages, their codewords, the bits' linear classifiers, and the bits' weights."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray
    margin: float = 0.05

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Weighted loss of each language's codeword, documents x languages."""
        f = x @ self.weights + self.bias
        plus, minus = np.logaddexp(0, -f), np.logaddexp(0, f)
        positive = (self.code > 0).T * self.trust.T
        negative = (self.code < 0).T * self.trust.T
        return plus @ positive + minus @ negative


def train(x: np.ndarray, y: np.ndarray, languages: list[str], steps: int = 150) -> LanguageModel:
    """Fits all bits' logistic classifiers at once by accelerated gradient steps."""
    code = codewords(len(languages))
    target = code[y]
    w = np.zeros((x.shape[1], code.shape[1]), dtype=np.float32)
    b = np.zeros(code.shape[1], dtype=np.float32)
    vw, vb = w.copy(), b.copy()
    share = 1 / np.maximum(np.bincount(y, minlength=len(languages)), 1)
    row = (share[y] / share[y].sum()).astype(np.float32)[:, None]
    for step in range(steps):
        f = x @ vw + vb
        g = (-target * row / (1 + np.exp(np.clip(target * f, -30, 30)))).astype(np.float32)
        new_w, new_b = vw - 8.0 * (x.T @ g + 1e-5 * vw), vb - 8.0 * g.sum(axis=0)
        m = step / (step + 3)
        vw, vb, w, b = new_w + m * (new_w - w), new_b + m * (new_b - b), new_w, new_b
    right = ((x @ w + b) * target > 0).astype(np.float64)
    trust = np.array([right[y == i].mean(axis=0) if (y == i).any() else np.ones(code.shape[1]) for i in range(len(languages))])
    trust = np.maximum(trust, 1e-3)
    return LanguageModel(languages, code, w, b, trust / trust.sum(axis=1, keepdims=True) * code.shape[1])


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = PER_LANGUAGE) -> LanguageModel | None:
    """Trains on a sample of the rows that have a language; None if there are none.

    The sample takes about ``per_language`` rows of each language, by a hash of the id
    and the text, and of them the ``2 * per_language`` times the languages with the least
    hash, so it is bounded however often rows repeat and the same wherever it is drawn.
    Ties of that hash go by language.  Only the features of the sample reach the driver.
    """
    rows = docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang")).filter("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    languages = sorted(counts)
    drawn = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30))
    draw = F.col("draw") / F.lit(float(1 << 30))
    share = F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(min(1.0, per_language / n))) for k, n in counts.items()))
    drawn_rows = rows.select("lang", "text", drawn.alias("draw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in ta.slices(batch.column(1)):
                for low in range(0, len(piece), _BLOCK):
                    high = min(low + _BLOCK, len(piece))
                    x = trigram_features(piece, low, high).astype("<f2")
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.first + low, high - low), pa.array([r.tobytes() for r in x], pa.binary()), batch.column(2).slice(piece.first + low, high - low)], ["lang", "x", "draw"])

    def features(some: DataFrame, least: int) -> pa.Table:
        return some.mapInArrow(run, "lang string, x binary, draw long").orderBy("draw", "lang").limit(least).toArrow()

    got = features(drawn_rows.filter(draw < share[F.col("lang")]), 2 * per_language * len(languages))
    # Where a language's rows are all alike the draw may leave none of them.
    missing = sorted(set(languages) - set(got.column("lang").to_pylist()))
    if missing:
        got = pa.concat_tables([got, features(drawn_rows.filter(F.col("lang").isin(missing)), per_language * len(missing))])
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), dtype="<f2").reshape(got.num_rows, FEATURES).astype(np.float32)
    place = {k: i for i, k in enumerate(languages)}
    y = np.array([place[k] for k in got.column("lang").to_pylist()])
    order = np.lexsort((*(x[:, j] for j in range(0, FEATURES, 512)), y))  # the same fit however rows arrived
    return train(x[order], y[order], languages)


def classify(batch: pa.RecordBatch, at: int, model: LanguageModel | None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For rows of a batch: first row, number, language (-1: none), score, and if it is ambiguous."""
    for piece in ta.slices(batch.column(at)):
        for low in range(0, len(piece), _BLOCK):
            high = min(low + _BLOCK, len(piece))
            best, score = np.full(high - low, -1), np.zeros(high - low)
            close = np.zeros(high - low, dtype=bool)
            known = has_letter(piece, low, high) if model else np.zeros(high - low, dtype=bool)
            if known.any():
                losses = model.losses(trigram_features(piece, low, high))
                likely = np.exp(losses.min(axis=1, keepdims=True) - losses)
                likely /= likely.sum(axis=1, keepdims=True)
                best = np.where(known, likely.argmax(axis=1), -1)
                score = np.where(known, likely.max(axis=1), 0.0)
                if likely.shape[1] > 1:
                    close = known & (score - np.partition(likely, -2, axis=1)[:, -2] < model.margin)
            yield piece.first + low, high - low, best, score, close


def predict(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of every whole text: ``doc_id, lang_pred, score, ambiguous``.

    ``lang_pred`` is ``und`` and ``score`` 0 for null texts, texts without a letter, and
    if there is no model.  ``score`` is the share of the nearest codeword (0 to 1);
    ``ambiguous`` tells that the second codeword's share is within ``margin`` of it.
    One row for each input row, repeated ones and null ids too; other columns are not
    carried.  Of equally near codewords the language first in order is taken.  Texts of
    any length are read whole; an empty table gives an empty result.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*(model.languages if model else []), "und"], dtype=object)
        for batch in batches:
            for first, n, best, score, close in classify(batch, 1, model):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(names[best].tolist(), pa.string()), pa.array(score, pa.float64()), pa.array(close)], ["doc_id", "lang_pred", "score", "ambiguous"])

    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")


def keep_identified(docs: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """The rows, with all columns, whose text has one clear language; all rows without a model."""
    if model is None:
        return docs
    at, names = docs.columns.index(text_col), [f"c{i}" for i in range(len(docs.columns))]
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, best, _, close in classify(batch, at, model):
                yield batch.slice(first, n).filter(pa.array((best >= 0) & ~close))

    return docs.toDF(*names).mapInArrow(run, schema).toDF(*docs.columns)


def fold(id_column: Column, n: int) -> Column:
    """Remainder of crc32 of the id as text; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")), F.lit(n))
