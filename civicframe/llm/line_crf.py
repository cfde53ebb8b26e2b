"""Quality rules: a linear-chain conditional random field labels lines as content or boilerplate.

Each line that holds a word becomes a feature vector; the Viterbi path through the
text's lines gives one label per line, and the share of words in content lines
decides whether a text stays.  A few count rules reject a text beforehand.

The field is trained on a bounded, documented sample of labelled texts: the lines of
a text take its quality label.  Only line features reach the driver, never texts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from .common import arrow_text, freed, labelled_sample, small_batches, words_of

SYMBOLS = "#*$%&|<>"
FEATURES = (
    "bias", "symbols", "bare", "upper", "bangs", "few_distinct", "repeated_windows", "repeated_neighbours", "seen_before",
    "ends_a_sentence", "length", "short_words", "digits", "word_length",
)
#: Longer sequences are trained as several; decoding always takes whole texts.
TRAIN_LINES = 256
MIN_WORDS, MAX_REPEATED, MIN_CONTENT = 50, 0.5, 0.5


@dataclass(frozen=True)
class LineField:
    """Scores of the label content against boilerplate, and of label changes (0 boilerplate, 1 content)."""

    weights: tuple[float, ...]
    start: tuple[float, float]
    change: tuple[tuple[float, float], tuple[float, float]]

    def decode(self, features: np.ndarray) -> list[int]:
        """The best label sequence; ties go to content."""
        if not len(features):
            return []
        emit = (features @ np.array(self.weights)).tolist()
        (stay0, to1), (to0, stay1) = self.change
        a, b = self.start[0], self.start[1] + emit[0]
        back = []
        for e in emit[1:]:
            from0, from1 = (0, a + stay0), (0, a + to1)
            if b + to0 >= from0[1]:
                from0 = (1, b + to0)
            if b + stay1 >= from1[1]:
                from1 = (1, b + stay1)
            back.append((from0[0], from1[0]))
            a, b = from0[1], from1[1] + e
        path = [1 if b >= a else 0]
        for step in reversed(back):
            path.append(step[path[-1]])
        return path[::-1]


#: Without usable labels every line counts as content.
KEEP_ALL = LineField((0.0,) * len(FEATURES), (0.0, 0.0), ((0.0, 0.0), (0.0, 0.0)))


def repeated_words(words: list[str]) -> int:
    """Words in windows of three that occur twice or more, the first occurrence included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered = Counter(windows), bytearray(len(words))
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered[i : i + 3] = b"\1\1\1"
    return sum(covered)


def _line(words: list[str], line: str, seen: bool) -> tuple[float, ...]:
    n = len(words)
    windows = list(zip(words, words[1:], words[2:]))
    return (
        1.0,
        min(2.0, sum(map(line.count, SYMBOLS)) / n),
        sum(1 for w in words if not w[0].isalnum() and not any(map(str.isalnum, w))) / n,
        sum(map(str.isupper, words)) / n,
        min(2.0, line.count("!") / n),
        1 - len(set(words)) / n,
        1 - len(set(windows)) / len(windows) if windows else 0.0,
        sum(map(eq, words, words[1:])) / n,
        float(seen),
        float(words[-1][-1] in ".!?…。\"')"),
        math.log1p(n) / 6,
        sum(1 for w in words if len(w) <= 3) / n,
        sum(map(str.isdigit, line)) / len(line),
        min(3.0, sum(map(len, words)) / n / 10),
    )


def line_rows(text: str) -> tuple[np.ndarray, list[int], list[int], int]:
    """Features of the lines that hold a word, their places and word counts, and how many repeat an earlier line."""
    rows, places, sizes, seen, repeats = [], [], [], set(), 0
    for i, line in enumerate(text.split("\n")):
        words = words_of(line)
        if words:
            again = line in seen
            repeats += again
            seen.add(line)
            rows.append(_line(words, line, again))
            places.append(i)
            sizes.append(len(words))
    return np.array(rows, np.float64).reshape(-1, len(FEATURES)), places, sizes, repeats


def train(sequences: list[np.ndarray], labels: list[int], steps: int = 150, rate: float = 0.1) -> LineField:
    """Maximum likelihood with a small penalty, by Adam over all sequences at once."""
    if len(set(labels)) < 2:
        return KEEP_ALL
    cut = [(s[i : i + TRAIN_LINES], y) for s, y in zip(sequences, labels) for i in range(0, len(s), TRAIN_LINES)]
    cut.sort(key=lambda x: -len(x[0]))
    lengths = np.array([len(s) for s, _ in cut])
    n, longest, width = len(cut), int(lengths[0]), len(FEATURES)
    x = np.zeros((longest, n, width), np.float32)
    y = np.array([y for _, y in cut])
    for i, (s, _) in enumerate(cut):
        x[: len(s), i] = s
    active = [int((lengths > t).sum()) for t in range(longest)]
    theta, m, v = np.zeros(width + 6), np.zeros(width + 6), np.zeros(width + 6)
    for step in range(1, steps + 1):
        grad = _gradient(theta, x, y, active) / n - 1e-3 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    rest = theta[width:].tolist()
    return LineField(tuple(theta[:width].tolist()), tuple(rest[:2]), (tuple(rest[2:4]), tuple(rest[4:])))


def _gradient(theta: np.ndarray, x: np.ndarray, y: np.ndarray, active: list[int]) -> np.ndarray:
    """Of the summed log likelihood: observed less expected features, starts and changes."""
    width = x.shape[2]
    start, change = theta[width : width + 2], theta[width + 2 :].reshape(2, 2)
    emit = np.zeros((*x.shape[:2], 2))
    emit[:, :, 1] = x @ theta[:width].astype(np.float32)
    ahead = [start + emit[0]]
    for t in range(1, len(active)):
        ahead.append(np.logaddexp.reduce(ahead[-1][: active[t], :, None] + change, axis=1) + emit[t, : active[t]])
    grad, behind = np.zeros_like(theta), np.zeros((0, 2))
    for t in range(len(active) - 1, -1, -1):
        k, after = active[t], len(behind)
        here = np.zeros((k, 2))
        if after:
            onward = change + (emit[t + 1, :after] + behind)[:, None, :]
            here[:after] = np.logaddexp.reduce(onward, axis=2)
            both = ahead[t][:after, :, None] + onward
            both = np.exp(both - np.logaddexp.reduce(both.reshape(after, 4), axis=1)[:, None, None])
            seen = np.bincount(3 * y[:after], minlength=4).reshape(2, 2)
            grad[width + 2 :] += (seen - both.sum(0)).ravel()
        share = ahead[t] + here
        share = np.exp(share - np.logaddexp.reduce(share, axis=1)[:, None])
        grad[:width] += (y[:k] - share[:, 1]) @ x[t, :k]
        if t == 0:
            grad[width : width + 2] += np.bincount(y, minlength=2) - share.sum(0)
        behind = here
    return grad


def fit(docs: DataFrame, labels: DataFrame, most: int = 2000, *, id_col: str = "doc_id", text_col: str = "text") -> LineField:
    """Train on at most ``most`` labelled texts of the training rows (see ``labelled_sample``)."""

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [line_rows(t)[0].astype(np.float32).tobytes() for t in batch["text"]]
            yield pd.DataFrame({"__id": batch["__id"].astype(str), "label": batch["label"], "rows": rows})

    sample = labelled_sample(small_batches(docs), labels, "quality", most, id_col=id_col, text_col=text_col)
    found = sample.mapInPandas(features, "__id string, label int, rows binary").collect()
    found.sort(key=lambda r: (r["__id"], bytes(r["rows"])))
    sequences = [np.frombuffer(r["rows"], np.float32).reshape(-1, len(FEATURES)) for r in found]
    kept = [(s, r["label"]) for s, r in zip(sequences, found) if len(s)]
    return train([s for s, _ in kept], [y for _, y in kept])


def judge(text: str, field: LineField) -> tuple:
    """Word count, base counts, the base verdict, content words, the verdict, and the content lines' text."""
    words = words_of(text)
    n = len(words)
    rows, places, sizes, dup_lines = line_rows(text)
    labels = field.decode(rows)
    content = sum(s for s, y in zip(sizes, labels) if y)
    again = repeated_words(words)
    failed = n < MIN_WORDS or again > MAX_REPEATED * n
    kept = not failed and content >= MIN_CONTENT * n
    lines = text.split("\n")
    kept_text = "\n".join(lines[i] for i, y in zip(places, labels) if y)
    return n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), dup_lines, again, failed, kept, content, kept_text


def apply(
    docs: DataFrame, field: LineField, *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False
) -> DataFrame:
    """One row per document: id, n_words, base counts, base_failed, kept, content_words and (``with_text``) content.

    A null text has no words; a text without words is never kept.  Ids may repeat or be null; each row is judged
    by itself.  Other columns are not read.  An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(t, field) for t in arrow_text(batch.column("text")).to_pylist()]
            columns = [pa.array([r[i] for r in found], to_arrow_type(f.dataType)) for i, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], [id_col, *(f.name for f in fields)])

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_words", "content"]
    kinds = [LongType()] * 5 + [BooleanType()] * 2 + [LongType(), StringType()]
    fields = [StructField(n, k) for n, k in zip(names, kinds)][: 9 if with_text else 8]
    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), *fields])
    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(freed(run), schema)


def keep(docs: DataFrame, field: LineField, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they are.

    A null or empty text is not kept.  Each row is judged by itself, so repeated rows stay or go together; no column is
    added, so none can clash.  An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([judge(t, field)[6] for t in arrow_text(batch.column(text_col)).to_pylist()], pa.bool_()))

    return small_batches(docs).mapInArrow(freed(run), docs.schema)
