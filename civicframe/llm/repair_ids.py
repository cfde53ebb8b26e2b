"""Token ids in binary shards, compressed by Re-Pair grammars that allow random access.

Documents are dealt out by ranges of their id and sorted, so shards follow each other in
id order.  A task encodes its documents and cuts the ids into shards of bounded size.  In
each shard, rounds of Re-Pair replace all frequent pairs of neighbouring symbols by
nonterminals, until no pair occurs ``LEAST`` times.  A shard file stores the rules, the length each rule expands to, the
remaining symbols and its documents' ids and token counts; from the lengths, any
stretch of ids is found and expanded without the rest.

File format (little-endian): magic ``RPR1``; eight 64-bit numbers: version, first nonterminal, rules, symbols, tokens,
documents, bytes of a symbol, bytes of the id section; rules as pairs of 32-bit symbols; 32-bit expansion lengths; symbols; 64-bit
token counts of the documents; the documents' ids as JSON.

Shard files are kept as rows of a table (place and bytes), which Spark writes to and reads from any shared store.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_dir
from .common import arrow_text, byte_sizes, distinct, freed, joined_batches, runs, small_batches, split_words, spread

MAGIC, VERSION = b"RPR1", 1
_HEADER = struct.Struct("<4s8q")
#: Tokens of a shard (one longer document is a shard of its own), bytes of text handled at once, words remembered (twice at most).
SHARD_TOKENS, TEXT_BYTES, REMEMBERED = 1 << 20, 16_000_000, 500_000
#: The least occurrences of a pair that becomes a rule.
LEAST = 24
_SLOTS = 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Encoder:
    """Ids of a ``tokenizers`` file whose tokens never reach over ASCII white space.

    Words are encoded once and remembered; the library's own normaliser, splitter and merges run on each word.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self.size = self._tokenizer.get_vocab_size(with_added_tokens=True)
        #: Words met lately, and those met before them: what is used again moves up, the rest is forgotten.
        self._known: dict[bytes, bytes] = {}
        self._older: dict[bytes, bytes] = {}

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each text has."""
        # The tokenizer lowers case and parts letters from punctuation itself, but a special token's text must stay as it is.
        plain = not pc.any(pc.match_substring(texts, "<|")).as_py()
        words, counts = split_words(texts, lower=plain, punctuation=plain)
        names, codes = distinct(words)
        if len(self._known) > REMEMBERED:
            self._older, self._known = self._known, {}
        self._known |= {w: self._older[w] for w in names if w in self._older}
        new = [w for w in names if w not in self._known]
        for a in range(0, len(new), 20_000):
            some = new[a : a + 20_000]
            found = self._tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)
            self._known |= {w: array("I", e.ids).tobytes() for w, e in zip(some, found)}
        found = [self._known[w] for w in names]
        sizes = np.array([len(x) // 4 for x in found], np.int64)
        flat, at = np.frombuffer(b"".join(found), np.uint32), np.cumsum(sizes) - sizes
        doc = np.repeat(np.arange(len(texts)), counts)
        return flat[spread(at[codes], sizes[codes])], np.bincount(doc, sizes[codes], len(texts)).astype(np.int64)


def _frequent(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs that become rules in this round, and each one's pair code, in order of place.

    Pairs are counted in hashed slots first; only those of full slots are counted one by one.
    """
    pair = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
    slot = (pair * _MIX >> np.uint64(64 - _SLOTS)).astype(np.int64)
    count = np.bincount(slot, minlength=1 << _SLOTS)
    place = np.flatnonzero(count[slot] >= LEAST)
    codes, inverse, counts = np.unique(pair[place], return_inverse=True, return_counts=True)
    place = place[counts[inverse] >= LEAST]
    # Of pairs that overlap in a run, every other one from the left.
    head = np.flatnonzero(np.append(True, np.diff(place) != 1)) if len(place) else place
    inside = np.arange(len(place)) - np.repeat(head, np.diff(np.append(head, len(place))))
    place = place[inside % 2 == 0]
    return place, pair[place]


def compress(ids: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules (pairs of symbols), their expansion lengths and the remaining symbols; nonterminals count from ``first``."""
    symbols, rules, lengths = ids.astype(np.uint32), np.zeros((0, 2), np.uint32), np.zeros(0, np.int64)
    while len(symbols) > 1:
        place, pair = _frequent(symbols[:-1], symbols[1:])
        codes, rule = np.unique(pair, return_inverse=True)
        if not len(codes):
            break
        new = np.column_stack([codes >> np.uint64(32), codes & np.uint64(0xFFFFFFFF)]).astype(np.uint32)
        length = np.append(np.ones(1, np.int64), lengths)
        lengths = np.append(lengths, length[np.where(new >= first, new.astype(np.int64) - first + 1, 0)].sum(axis=1))
        keep = np.ones(len(symbols), bool)
        keep[place + 1] = False
        symbols[place] = first + len(rules) + rule
        symbols, rules = symbols[keep], np.concatenate([rules, new])
    return rules, lengths, symbols


def expand(symbols: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """The ids that symbols stand for, one level of rules at a time."""
    symbols = symbols.astype(np.uint32)
    while len(at := np.flatnonzero(symbols >= first)):
        sizes = np.ones(len(symbols), np.int64)
        sizes[at] = 2
        start = np.cumsum(sizes) - sizes
        out = np.repeat(symbols, sizes)
        pair = rules[symbols[at].astype(np.int64) - first]
        out[start[at]], out[start[at] + 1] = pair[:, 0], pair[:, 1]
        symbols = out
    return symbols


def pack(doc_ids: list, counts: np.ndarray, ids: np.ndarray, first: int) -> bytes:
    """One shard file."""
    rules, lengths, symbols = compress(ids, first)
    width = 2 if first + len(rules) <= 1 << 16 else 4
    names = json.dumps(doc_ids).encode()
    head = _HEADER.pack(MAGIC, VERSION, first, len(rules), len(symbols), len(ids), len(doc_ids), width, len(names))
    return b"".join([
        head, rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), symbols.astype(f"<u{width}").tobytes(),
        np.asarray(counts).astype("<i8").tobytes(), names,
    ])


class Shard:
    """A shard file opened for reading; arrays are views of its bytes."""

    def __init__(self, raw: bytes):
        magic, version, self.first, n_rules, n_symbols, self.n_tokens, n_docs, width, n_names = _HEADER.unpack_from(raw)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a shard file of this version")
        at = _HEADER.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        self.rules = take("<u4", 2 * n_rules).reshape(-1, 2)
        self.lengths, self.symbols, self.counts = take("<u4", n_rules), take(f"<u{width}", n_symbols), take("<i8", n_docs)
        self.doc_ids = json.loads(raw[at : at + n_names])
        if len(raw) != at + n_names:
            raise ValueError("shard file of the wrong length")
        sizes = np.append(1, self.lengths)[np.where(self.symbols >= self.first, self.symbols.astype(np.int64) - self.first + 1, 0)]
        self._ends = np.cumsum(sizes, dtype=np.int64)

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids from ``start`` up to ``stop``; only the symbols that cover them are expanded."""
        stop = self.n_tokens if stop is None else min(stop, self.n_tokens)
        if start >= stop:
            return np.zeros(0, np.uint32)
        a, b = np.searchsorted(self._ends, [start, stop - 1], "right")
        before = int(self._ends[a - 1]) if a else 0
        return expand(self.symbols[a : b + 1], self.rules, self.first)[start - before : stop - before]

    def documents(self) -> Iterator[tuple[object, int, np.ndarray]]:
        """Each document's id, its place in the shard and its ids."""
        ids, ends = self.ids(), np.cumsum(self.counts)
        for doc, begin, end in zip(self.doc_ids, (ends - self.counts).tolist(), ends.tolist()):
            yield doc, begin, ids[begin:end]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write(
    docs: DataFrame, path: str, folder: str, *, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None
) -> None:
    """Write all documents' ids as shard files into a table in ``folder`` (columns part, shard, n_tokens, file).

    (part, shard) follow the ids' ascending order, null ids first; documents of one id are ordered by a hash of their text.
    A null text counts as empty and has the end id alone.  Ids must be whole numbers or text.  An empty table gives an
    empty shard table.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, shard = _encoder(path), TaskContext.get().partitionId(), 0
        doc_ids, counts, held, size = [], [], [], 0

        def file() -> pa.RecordBatch:
            raw = pack(doc_ids, np.array(counts), np.concatenate(held), encoder.size)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([size], pa.int64()), pa.array([raw], pa.binary())],
                ["part", "shard", "n_tokens", "file"],
            )

        for batch in joined_batches(batches, TEXT_BYTES):
            texts = arrow_text(batch.column("text"))
            for a, b in runs(byte_sizes(texts).tolist(), TEXT_BYTES):
                ids, n = encoder.encode(texts.slice(a, b - a))
                ids = np.insert(ids, np.cumsum(n), end_id)
                ends = np.cumsum(n + 1)
                for doc, begin, end in zip(batch.column("id").slice(a, b - a).to_pylist(), (ends - n - 1).tolist(), ends.tolist()):
                    if size and size + end - begin > SHARD_TOKENS:
                        yield file()
                        doc_ids, counts, held, size, shard = [], [], [], 0, shard + 1
                    doc_ids.append(doc)
                    counts.append(end - begin)
                    held.append(ids[begin:end])
                    size += end - begin
        if doc_ids:
            yield file()

    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    by = [F.col("id").asc_nulls_first(), F.col("tie")]
    dealt = rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)
    files = dealt.sortWithinPartitions(*by).select("id", "text").mapInArrow(freed(shards), "part int, shard int, n_tokens long, file binary")
    files.write.mode("errorifexists").parquet(folder)


def read(spark: SparkSession, folder: str, *, id_col: str = "doc_id", id_type: str = "long", with_ids: bool = True) -> DataFrame:
    """One row per document of the shard files in ``folder``: id, start, n_tokens, ids_crc32 and (``with_ids``) ids.

    ``start`` counts the ids of all documents before.  The places of shards come from sums over parts, then over the shards of a part.
    """

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "shard", "file"))):
                rows = [(doc, begin, ids) for doc, begin, ids in Shard(raw).documents()]
                out = {
                    "part": pa.array([part] * len(rows), pa.int32()), "shard": pa.array([shard] * len(rows), pa.int32()),
                    "id": pa.array([r[0] for r in rows], kind), "begin": pa.array([r[1] for r in rows], pa.int64()),
                    "n_tokens": pa.array([len(r[2]) for r in rows], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(r[2].astype("<u4").tobytes()) for r in rows], pa.int64()),
                }
                if with_ids:
                    out["ids"] = pa.array([r[2].astype(np.int32) for r in rows], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    kind = pa.string() if id_type == "string" else pa.int64()
    files = spark.read.parquet(folder)
    schema = "part int, shard int, id {0}, begin long, n_tokens long, ids_crc32 long".format("string" if id_type == "string" else "long")
    rows = files.select("part", "shard", "file").mapInArrow(documents, schema + (", ids array<int>" if with_ids else ""))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    sizes = files.select("part", "shard", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(before.orderBy("part")), F.lit(0)).alias("part_start"))
    inner = F.coalesce(F.sum("n_tokens").over(before.partitionBy("part").orderBy("shard")), F.lit(0))
    places = sizes.select("part", "shard", inner.alias("shard_start")).join(parts, "part")
    out = rows.join(places, ["part", "shard"]).withColumn("start", F.col("part_start") + F.col("shard_start") + F.col("begin"))
    return out.select(F.col("id").cast(id_type).alias(id_col), "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def apply(docs: DataFrame, path: str, *, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Write shard files to a new folder of the shared scratch space and read them back."""
    folder = scratch_dir(docs.sparkSession)
    write(docs, path, folder, end_id=end_id, id_col=id_col, text_col=text_col)
    return read(docs.sparkSession, folder, id_col=id_col, id_type=docs.schema[id_col].dataType.simpleString(), with_ids=with_ids)
