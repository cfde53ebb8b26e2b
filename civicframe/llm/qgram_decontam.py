"""Benchmark decontamination by the q-gram lemma over diagonal bands, verified by banded alignment.

A text that holds a benchmark passage of m characters with at most e edits shares at
least m - q + 1 - q*e of the passage's q-grams with it, all within e + 1 neighbouring
diagonals (place in the text less place in the passage).  Bands of 2*(e + 1)
diagonals that overlap by half contain any such run of diagonals.  A band that
holds enough distinct shared q-grams is a candidate region, and a banded alignment decides.

The benchmark is the stated query set: it is read in blocks of bounded size, and each
block is held against all documents where they lie, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_text, byte_sizes, freed, runs, small_batches, spread

Q = 12
#: Edits allowed in a passage, as a share of its characters.
EDIT_RATE = 0.06
#: Characters of benchmark text held at once, bytes of document text handled at once.
BLOCK_CHARS, TEXT_BYTES = 2_000_000, 3_000_000
_BASE = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 22


def normal(text: str) -> str:
    """Lower case with white space as blanks, character for character, so places stay those of the text."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    return low.replace("\n", " ").replace("\t", " ").replace("\r", " ")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(chars: np.ndarray) -> np.ndarray:
    """A 64-bit code of the Q characters from each place on."""
    if len(chars) < Q:
        return np.zeros(0, np.uint64)
    one = chars.astype(np.uint64) * _MIX
    b2, b4 = _BASE**np.uint64(2), _BASE**np.uint64(4)
    two = one[:-1] * _BASE + one[1:]
    four = two[:-2] * b2 + two[2:]
    eight = four[:-4] * b4 + four[4:]
    return eight[: len(chars) - Q + 1] * b4 + four[8 : 8 + len(chars) - Q + 1]


def budget(length: int) -> int:
    """Edits allowed in a passage: the rate's share, but few enough that the lemma asks for a shared q-gram."""
    return min(int(EDIT_RATE * length), max(0, (length - Q) // Q))


@dataclass
class Passages:
    """A block of passages with their q-grams sorted by code."""

    ids: list
    texts: list[str]

    def __post_init__(self):
        lengths = np.array([len(t) for t in self.texts], np.int64)
        grams = [_grams(_codes(t)) for t in self.texts]
        codes = np.concatenate([*grams, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([*(np.arange(len(g)) for g in grams), np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(codes, kind="stable")
        self.codes, first, self.sizes = np.unique(codes, return_index=True, return_counts=True) if len(codes) else (codes, item, item)
        if len(codes):
            first = np.cumsum(self.sizes) - self.sizes
        self.first, self.item, self.place = first, item[order], place[order]
        self.edits = np.array([budget(n) for n in lengths], np.int64)
        self.need = np.maximum(1, lengths - Q + 1 - Q * self.edits)
        self.short = [i for i, n in enumerate(lengths) if 0 < n < Q]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.codes * _MIX >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def regions(self, texts: list[str]) -> Iterator[tuple[int, int, int, int]]:
        """Candidates: text, item, lowest and highest diagonal of a band with enough shared q-grams."""
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        ends = np.cumsum(lengths)
        grams = _grams(_codes("\0".join([*texts, ""])))
        at = np.flatnonzero(self.filter[(grams * _MIX >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        found = np.searchsorted(self.codes, grams[at])
        if not len(self.codes):
            return
        found = np.minimum(found, len(self.codes) - 1)
        same = self.codes[found] == grams[at]
        at, found = at[same], found[same]
        entry = spread(self.first[found], self.sizes[found])
        at = np.repeat(at, self.sizes[found])
        doc = np.searchsorted(ends, at, "right")
        item, place = self.item[entry], self.place[entry]
        diagonal = at - (ends - lengths)[doc] - place
        step = self.edits[item] + 1
        for shift in (0, 1):
            # Bands [band * step, (band + 2) * step) of every other number.
            band = 2 * ((diagonal // step - shift) // 2) + shift
            rows = np.unique(np.column_stack([doc, item, band, place]), axis=0)
            if not len(rows):
                continue
            head = np.flatnonzero(np.append(True, np.any(rows[1:, :3] != rows[:-1, :3], axis=1)))
            count = np.diff(np.append(head, len(rows)))
            for d, i, b, _ in rows[head[count >= self.need[rows[head, 1]]]].tolist():
                yield d, i, b * int(self.edits[i] + 1), (b + 2) * int(self.edits[i] + 1) - 1

    def find(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """The best region of each (text, item) within the budget: text, item, begin, end, edits."""
        texts, best = [normal(t) for t in texts], {}
        for d, i, low, high in self.regions(texts):
            if (known := best.get((d, i))) and known[0] == 0:
                continue
            got = align(self.texts[i], texts[d], low, high, int(self.edits[i]))
            if got and (not known or got < known):
                best[d, i] = got
        for i in self.short:
            for d, t in enumerate(texts):
                if (at := t.find(self.texts[i])) >= 0:
                    best[d, i] = (0, at, at + len(self.texts[i]))
        return [(d, i, begin, end, edits) for (d, i), (edits, begin, end) in sorted(best.items())]


def align(item: str, text: str, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """Fewest edits between the whole item and a stretch of the text on diagonals low - most to high + most.

    Returns edits, begin and end of the stretch, or nothing beyond ``most`` edits.
    """
    low, high = max(low - most, -len(item)), min(high + most, len(text))
    exact = text.find(item, max(0, low), max(0, high) + len(item))
    if exact >= 0:
        return 0, exact, exact + len(item)
    pattern, chars = _codes(item), _codes(text)
    diagonals = np.arange(low, high + 1)
    far = len(item) + len(text) + 1
    padded = np.zeros(len(diagonals) + len(item), np.uint32)
    lo, hi = max(0, low), min(len(text), high + len(item))
    padded[lo - low : hi - low] = chars[lo:hi]
    # cost[k]: edits of the item's first i characters against the text up to place i + diagonals[k].
    cost = np.where((diagonals >= 0) & (diagonals <= len(text)), 0, far)
    begin = diagonals.copy()
    steps = np.arange(len(diagonals))
    for i, c in enumerate(pattern):
        place = diagonals + i + 1
        same = cost + (padded[i : i + len(diagonals)] != c)
        skip = np.append(cost[1:], far) + 1
        take = skip < same
        now, from_ = np.where(take, skip, same), np.where(take, np.append(begin[1:], 0), begin)
        now = np.where((place >= 0) & (place <= len(text)), now, far)
        level = now - steps
        lowest = np.minimum.accumulate(level)
        origin = np.maximum.accumulate(np.where(level == lowest, steps, 0))
        cost, begin = lowest + steps, from_[origin]
        cost = np.where((place >= 0) & (place <= len(text)), cost, far)
    k = int(np.argmin(cost))
    if cost[k] > most:
        return None
    return int(cost[k]), int(begin[k]), int(diagonals[k]) + len(item)


def blocks(benchmark: DataFrame, *, id_col: str = "item_id", text_col: str = "text") -> Iterator[Passages]:
    """The benchmark in blocks of bounded size; null and blank texts are left out."""
    rows = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    ids, texts, size = [], [], 0
    for row in rows.toLocalIterator():
        text = normal(row["text"]).strip()
        if not text:
            continue
        if size and size + len(text) > BLOCK_CHARS:
            yield Passages(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(row["id"])
        texts.append(text)
        size += len(text)
    if texts:
        yield Passages(ids, texts)


def _found(texts: pa.StringArray, passages: Passages) -> list[tuple[int, int, int, int, int]]:
    out = []
    for a, b in runs(byte_sizes(texts).tolist(), TEXT_BYTES):
        found = passages.find(texts.slice(a, b - a).to_pylist())
        out += [(a + d, *rest) for d, *rest in found]
    return out


def apply(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row per document and benchmark passage found in it: id, item, begin, end (characters of the text), edits.

    Null and empty texts hold nothing; a blank passage is in no text; a passage shorter than a q-gram must stand
    there letter for letter (case and kind of white space aside).  Rows with a repeated or null id are searched like others.
    Repeated passages are found each.  Empty tables give an empty result.  Other columns are not read.
    """
    kind, item_kind = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    schema = f"`{id_col}` {kind.simpleString()}, `{item_col}` {item_kind.simpleString()}, begin long, end long, edits int"
    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = None
    for passages in blocks(benchmark, id_col=item_col, text_col=item_text):
        held = docs.sparkSession.sparkContext.broadcast(passages)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = _found(arrow_text(batch.column("text")), held.value)
                d, i, begin, end, edits = (list(x) for x in zip(*found)) if found else ([], [], [], [], [])
                items = pa.array([held.value.ids[x] for x in i]).cast(item_type) if i else pa.array([], item_type)
                columns = [batch.column("id").take(pa.array(d, pa.int64())), items, pa.array(begin, pa.int64()), pa.array(end, pa.int64()), pa.array(edits, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, [id_col, item_col, "begin", "end", "edits"])

        item_type = _arrow_type(item_kind)
        part = rows.mapInArrow(freed(run), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def _arrow_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def keep(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that hold no passage of the benchmark, all columns as they are.

    A null or empty text holds none and stays.  Each row is judged by itself, so repeated rows stay or go together; no
    column is added, so none can clash.  An empty table gives an empty result, an empty benchmark all rows.
    """
    for passages in blocks(benchmark, id_col=item_col, text_col=item_text):
        held = docs.sparkSession.sparkContext.broadcast(passages)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[d for d, *_ in _found(arrow_text(batch.column(text_col)), held.value)]] = False
                yield batch.filter(pa.array(clean))

        docs = small_batches(docs).mapInArrow(freed(run), docs.schema)
    return docs
