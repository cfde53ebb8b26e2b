"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader updates.

A text's n-grams are hashed into a fixed number of weights: its words, pairs of
neighbouring words, word shapes (kind of the first and last character, capitals) and
pairs of shapes.  Two markers stand for any pair of words that the text has held before
and for any word that repeats its neighbour.  A feature's value is its share of the text's
words, so a score is one sparse dot product whatever the length of the text.

Training takes a bounded, documented sample of labelled texts; only hashed features
reach the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_text, byte_sizes, distinct, freed, id_remainder, labelled_sample, runs, small_batches, split_words

BITS = 18
SCALE = 10.0
TEXT_BYTES = 3_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_AGAIN, _TWIN = np.uint64(1), np.uint64(2)


def _kind(c: str) -> str:
    return "a" if c.isalpha() else "0" if c.isdigit() else c


def _word_codes(word: bytes) -> tuple[int, int]:
    """Hashes of a word and of its shape."""
    text = word.decode("utf-8", "replace")
    shape = f"{_kind(text[0])}{_kind(text[-1])}{int(text.isupper() and len(text) > 1)}"
    return zlib.crc32(text.lower().encode()), zlib.crc32(shape.encode())


def _slot(codes: np.ndarray, family: int) -> np.ndarray:
    return ((codes + np.uint64(family)) * _MIX >> np.uint64(64 - BITS)).astype(np.int64)


def features(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and weight slot of every n-gram occurrence, and the words of each text."""
    words, counts = split_words(texts)
    names, codes = distinct(words)
    coded = np.array([_word_codes(w) for w in names], np.uint64).reshape(-1, 2)[codes]
    word, shape = coded[:, 0], coded[:, 1]
    doc = np.repeat(np.arange(len(texts)), counts)
    joined = doc[1:] == doc[:-1]
    pair = (word[:-1] * _MIX ^ word[1:])[joined]
    shapes = (shape[:-1] * _MIX ^ shape[1:])[joined]
    pair_doc = doc[1:][joined]
    twin = pair_doc[(word[1:] == word[:-1])[joined]]
    order = np.lexsort((pair, pair_doc))
    a, b = order[1:], order[:-1]
    again = pair_doc[a[(pair[a] == pair[b]) & (pair_doc[a] == pair_doc[b])]]
    rows = [doc, pair_doc, doc, pair_doc, again, twin]
    slots = [
        _slot(word, 11), _slot(pair, 12), _slot(shape, 13), _slot(shapes, 14),
        _slot(np.full(len(again), _AGAIN), 15), _slot(np.full(len(twin), _TWIN), 16),
    ]
    return np.concatenate(rows), np.concatenate(slots), counts


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, texts: pa.StringArray) -> np.ndarray:
        out = np.zeros(len(texts))
        for a, b in runs(byte_sizes(texts).tolist(), TEXT_BYTES):
            doc, slot, counts = features(texts.slice(a, b - a))
            total = np.bincount(doc, self.weights[slot], b - a)
            out[a:b] = self.bias + SCALE * total / np.maximum(counts, 1)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], *, passes: int = 4, rate: float = 0.5, l1: float = 1e-3, l2: float = 1e-2) -> Model:
    """Per-coordinate FTRL-proximal updates over sparse rows (slots, values, label), in the order given."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(at):
        step = (1.0 + np.sqrt(n[at])) / rate + l2
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / step)

    for _ in range(passes):
        for slots, values, label in rows:
            at, x = np.append(slots, size), np.append(values, 1.0)
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - label) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / rate * w
            n[at] += g * g
    w = weights(np.arange(size + 1))
    return Model(w[:size].astype(np.float32), float(w[size]))


def fit(
    docs: DataFrame, labels: DataFrame, target: str = "quality", most: int = 4000, *, id_col: str = "doc_id", text_col: str = "text"
) -> Model:
    """Train on at most ``most`` labelled texts of the training rows (see ``labelled_sample``).

    The order of the updates is that of a hash of the id.  Without any label the score is 0.5.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = arrow_text(batch.column("text"))
            slots, values = [], []
            for i in range(len(texts)):
                _, slot, counts = features(texts.slice(i, 1))
                at, found = np.unique(slot, return_counts=True)
                slots.append(at.astype(np.int32).tobytes())
                values.append((SCALE * found / max(1, counts[0])).astype(np.float32).tobytes())
            columns = [batch.column("key"), batch.column("label"), pa.array(slots, pa.binary()), pa.array(values, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "label", "slots", "values"])

    sample = labelled_sample(small_batches(docs), labels, target, most, id_col=id_col, text_col=text_col)
    sample = sample.select(F.xxhash64("__id").alias("key"), "label", "text")
    found = sample.mapInArrow(rows, "key long, label int, slots binary, values binary").collect()
    found.sort(key=lambda r: (r["key"], bytes(r["slots"])))
    return train([(np.frombuffer(r["slots"], np.int32), np.frombuffer(r["values"], np.float32), r["label"]) for r in found])


def apply(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: id, held_out, score, predicted.

    A null text counts as empty; an empty text takes the bias as its score.  A null id is never held out.  Ids
    may repeat; each row is scored by itself.  Other columns are not read.  An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(arrow_text(batch.column("text")))
            columns = [batch.column("id"), batch.column("held_out"), score, (score >= threshold).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)

    names = [id_col, "held_out", "score", "predicted"]
    kind = docs.schema[id_col].dataType.simpleString()
    rows = small_batches(docs).select(F.col(id_col).alias("id"), (id_remainder(id_col, 3) == 1).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(freed(run), f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, all columns as they are.

    A null text counts as empty.  Each row is scored by itself, so repeated rows stay or go together; no column is added, so
    none can clash.  An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(arrow_text(batch.column(text_col))) >= threshold))

    return small_batches(docs).mapInArrow(freed(run), docs.schema)
