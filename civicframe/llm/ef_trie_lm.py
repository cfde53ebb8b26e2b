"""Language-model scoring with n-gram tries whose levels are Elias-Fano sequences.

The corpus is read once into chunks: a chunk holds some documents' tokens as numbers into its own
sorted word hashes.  Each chunk sends every shard the distinct words and pairs of words that
belong there, with their training counts.  A shard adds these up and builds a trie: level 1
holds words, level 2 the words that follow each of them.  Words, pointers to the first
follower (monotone) and followers (numbered relative to their context) are Elias-Fano
sequences; counts become quantised log probabilities of one byte.  The levels are flat arrays in
one byte string, which can be read from a memory-mapped file or from a table's cell alike.

The shard answers the same words and pairs by successor search among a context's followers,
and the answers go back to their chunk, where documents are scored.  So nothing of the
model is ever whole on one machine, and its size follows the corpus: a word's followers are
spread over ``salts`` shards, the more the more shards there are, and a pair weighs one entry per chunk however
frequent it is.  Between tasks chunks travel in pieces, so that no executor holds long rows.

The model is a bigram model with a Dirichlet prior: P(w | v) = (c(vw) + mu P(w)) / (c(v) + mu), where P(w) is
the add-one estimate.  It sums to one over the known words and one unknown word.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir
from .common import BATCH_BYTES, arrow_text, byte_sizes, freed, hash_words, id_remainder, runs, small_batches, split_words

#: Bytes of text in a chunk (one longer text is a chunk of its own) and documents, tokens of the corpus per shard.
CHUNK_BYTES, CHUNK_DOCS, SHARD_TOKENS = 12_000_000, 10_000, 2_000_000
#: Bytes of a chunk in a row that is shuffled; half a region of a small heap, which holds larger arrays apart.
PIECE_BYTES = 256 << 10
#: Bytes of text that are cut into words at a time; that takes forty times as much memory.
SPLIT_BYTES = 2 << 20
#: Words and pairs looked up at a time, so that what a look-up works on stays in the processor's cache.
ASK = 1 << 15
#: Shards of a hot word's followers: the least, and one more for so many shards of the model.
SALTS, SALT_SHARDS = 8, 32
#: Weight of the prior, in tokens.
MU = 400.0
END, START = np.uint64(0x0E4D000000000001), np.uint64(0x57A2700000000001)
_MIX, _SALT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bits of a follower's number; the rest of a 64-bit key is the place of its context.
CHILD_BITS = 32
_SKIP = 64
_POP = np.array([bin(b).count("1") for b in range(256)], np.uint8)
_NTH = np.array([[([i for i in range(8) if b >> i & 1] + [0] * 8)[k] for k in range(8)] for b in range(256)], np.uint8)


def salts(n: int) -> int:
    """Over how many of ``n`` shards a word's followers are spread: a fixed number would fill a few shards as the corpus grows."""
    return max(SALTS, n // SALT_SHARDS)


class EliasFano:
    """A non-decreasing sequence of 64-bit numbers: low bytes as they are, high parts as gaps in unary.

    Fields of ``raw`` (little-endian): length, bytes of a low part, high words; low parts; high words; ones before
    each high word; every 64th value.  All reads are views, so ``raw`` may be a memory map.
    """

    _HEAD = struct.Struct("<3q")

    def __init__(self, raw):
        self.n, self.low_bytes, words = self._HEAD.unpack_from(raw)
        at = self._HEAD.size

        def take(kind, count):
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += -(-out.nbytes // 8) * 8
            return out

        self._low = take(np.uint8, self.n * self.low_bytes).reshape(self.n, self.low_bytes)
        self._high, self._ones, self._skip = take("<u8", words), take("<i8", words), take("<u8", -(-self.n // _SKIP))
        self.nbytes = at

    @classmethod
    def pack(cls, values: np.ndarray) -> bytes:
        values = values.astype(np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bytes = min(7, -(-max(0, (top // max(1, n)).bit_length()) // 8))
        bits = np.uint64(8 * low_bytes)
        low = values.astype("<u8").view(np.uint8).reshape(n, 8)[:, :low_bytes]
        place = (values >> bits).astype(np.int64) + np.arange(n)
        words = (int(place[-1]) >> 6) + 1 if n else 0
        marks = np.zeros(64 * words, np.uint8)
        marks[place] = 1
        high = np.packbits(marks, bitorder="little").view("<u8")
        ones = np.bitwise_count(high).astype(np.int64)
        parts = [low.tobytes(), high.tobytes(), (np.cumsum(ones) - ones).astype("<i8").tobytes(), values[::_SKIP].astype("<u8").tobytes()]
        return cls._HEAD.pack(n, low_bytes, words) + b"".join(p + b"\0" * (-len(p) % 8) for p in parts)

    def get(self, at: np.ndarray) -> np.ndarray:
        """The values at the given places."""
        word = np.searchsorted(self._ones, at, "right") - 1
        rest = at - self._ones[word]
        split = self._high[word].astype("<u8").view(np.uint8).reshape(-1, 8)
        upto = np.cumsum(_POP[split], axis=1, dtype=np.int64)
        byte = (upto <= rest[:, None]).sum(axis=1)
        row = np.arange(len(at))
        inside = rest - np.where(byte > 0, upto[row, np.maximum(byte - 1, 0)], 0)
        place = word * 64 + byte * 8 + _NTH[split[row, byte], inside]
        low = np.zeros((len(at), 8), np.uint8)
        low[:, : self.low_bytes] = self._low[at]
        return (place - at).astype(np.uint64) << np.uint64(8 * self.low_bytes) | low.view("<u8").ravel()

    def find(self, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The place of each x among places low to high - 1, or -1: the successor of x, if it is x."""
        low, high, end = low.copy(), high.copy(), high
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) // 2
            less = self.get(middle) < x[open_]
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
            open_ = open_[low[open_] < high[open_]]
        out = np.full(len(x), -1)
        inside = np.flatnonzero(low < end)
        same = inside[self.get(low[inside]) == x[inside]]
        out[same] = low[same]
        return out

    def find_anywhere(self, x: np.ndarray) -> np.ndarray:
        """``find`` in the whole sequence, by the kept values first."""
        block = np.searchsorted(self._skip, x, "right") - 1
        low = np.maximum(block, 0) * _SKIP
        return self.find(x, low, np.minimum(low + _SKIP, self.n))


def _book(top: float) -> np.ndarray:
    """The values of codes 1 to 255, as logarithms: whole numbers up to 64, then even steps of the logarithm up to ``top``."""
    return np.append(np.log10(np.arange(1, 65)), np.linspace(np.log10(64), np.log10(max(top, 65)), 192)[1:])


def _codes(counts: np.ndarray) -> tuple[np.ndarray, float]:
    """The nearest code of each count (from 1 on), and the highest count."""
    top = float(counts.max(initial=0))
    book = _book(top)
    return (1 + np.searchsorted((book[1:] + book[:-1]) / 2, np.log10(np.maximum(counts, 1)))).astype(np.uint8), top


class Trie:
    """One shard of the model, read from its bytes."""

    _HEAD = struct.Struct("<8s2d2q")

    def __init__(self, raw):
        magic, self.word_top, self.pair_top, n_words, n_pairs = self._HEAD.unpack_from(raw)
        if magic != b"EFTRIE1\0":
            raise ValueError("not a trie of this version")
        raw = memoryview(raw)[self._HEAD.size :]
        self.words = EliasFano(raw)
        self.pointers = EliasFano(raw[self.words.nbytes :])
        self.followers = EliasFano(raw[self.words.nbytes + self.pointers.nbytes :])
        at = self.words.nbytes + self.pointers.nbytes + self.followers.nbytes
        self.counts = np.frombuffer(raw, "<u4", n_words, at)
        self.word_codes = np.frombuffer(raw, np.uint8, n_words, at + 4 * n_words)
        self.pair_codes = np.frombuffer(raw, np.uint8, n_pairs, at + 5 * n_words)

    @classmethod
    def pack(cls, words: np.ndarray, counts: np.ndarray, first: np.ndarray, second: np.ndarray, pair_counts: np.ndarray) -> bytes:
        """From words with counts and pairs (context hash, follower number) with counts; repeated ones are added up."""
        taught = pair_counts > 0
        first, second, pair_counts = first[taught], second[taught], pair_counts[taught]
        head = np.flatnonzero(np.append(True, first[1:] != first[:-1])) if len(first) else np.zeros(0, np.int64)
        nodes, at = np.unique(np.concatenate([words[counts > 0], first[head]]), return_inverse=True)
        if len(nodes) >> (64 - CHILD_BITS):
            raise ValueError("too many contexts for one shard")
        own = int((counts > 0).sum())
        total = np.bincount(at[:own], counts[counts > 0], len(nodes)).astype(np.int64)
        key = np.repeat(at[own:].astype(np.uint64) << np.uint64(CHILD_BITS), np.diff(np.append(head, len(first)))) | second
        del first, second, taught, at
        order = np.argsort(key)
        key, pair_counts = key[order], pair_counts[order].astype(np.int64)
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        keys, pairs = key[head], np.add.reduceat(pair_counts, head) if len(key) else pair_counts
        del key, order, pair_counts
        pointers = np.searchsorted(keys, np.arange(len(nodes) + 1, dtype=np.uint64) << np.uint64(CHILD_BITS))
        word_codes, word_top = _codes(total + 1)
        pair_codes, pair_top = _codes(pairs)
        word_codes[total == 0] = 0
        return b"".join([
            cls._HEAD.pack(b"EFTRIE1\0", word_top, pair_top, len(nodes), len(keys)), EliasFano.pack(nodes), EliasFano.pack(pointers),
            EliasFano.pack(keys), total.astype("<u4").tobytes(), word_codes.tobytes(), pair_codes.tobytes(),
        ])

    @classmethod
    def open(cls, path: str) -> Trie:
        """A shard from a memory-mapped file."""
        return cls(np.memmap(path, np.uint8, "r"))

    def known_words(self) -> int:
        return int((self.counts > 0).sum())

    def word(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact training counts and log10(count + 1) as the level has it; 0 for unknown words."""
        at = self.words.find_anywhere(hashes)
        found = at >= 0
        counts, logs = np.zeros(len(at), np.int64), np.zeros(len(at))
        counts[found] = self.counts[at[found]]
        logs[found] = np.append(0.0, _book(self.word_top))[self.word_codes[at[found]]]
        return counts, logs

    def pair(self, contexts: np.ndarray, sizes: np.ndarray, children: np.ndarray) -> np.ndarray:
        """Codes of pairs, 0 for unknown ones: each context, how many followers are asked for, and their numbers."""
        node = self.words.find_anywhere(contexts)
        known = node >= 0
        low, high = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64)
        low[known] = self.pointers.get(node[known]).astype(np.int64)
        high[known] = self.pointers.get(node[known] + 1).astype(np.int64)
        base = np.where(known, node, 0).astype(np.uint64) << np.uint64(CHILD_BITS)
        at = self.followers.find(np.repeat(base, sizes) | children, np.repeat(low, sizes), np.repeat(high, sizes))
        out = np.zeros(len(at), np.uint8)
        out[at >= 0] = self.pair_codes[at[at >= 0]]
        return out


class Chunk:
    """Some documents as token numbers into sorted word hashes, and what they ask each shard for."""

    def __init__(self, vocabulary: np.ndarray, tokens: np.ndarray, counts: np.ndarray, train: np.ndarray):
        self.vocabulary, self.tokens, self.counts, self.train = vocabulary, tokens.astype(np.int64), counts.astype(np.int64), train.astype(bool)

    @classmethod
    def of(cls, texts: pa.StringArray, train: np.ndarray) -> Chunk:
        parts = []
        for a, b in runs(byte_sizes(texts).tolist(), SPLIT_BYTES):
            words, counts = split_words(texts.slice(a, b - a), lower=True)
            coded = words.dictionary_encode()
            parts.append((hash_words(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False), counts))
        vocabulary = np.unique(np.concatenate([np.array([END]), *(hashes for hashes, _, _ in parts)]))
        end = np.searchsorted(vocabulary, END)
        tokens = [np.insert(np.searchsorted(vocabulary, hashes)[places], np.cumsum(counts), end) for hashes, places, counts in parts]
        none = np.zeros(0, np.int64)
        return cls(vocabulary, np.concatenate([none, *tokens]), np.concatenate([none, *(counts + 1 for _, _, counts in parts)]), train)

    def count(self) -> None:
        """Distinct words and pairs with their training counts; pairs are sorted by context and follower."""
        taught = np.repeat(self.train, self.counts)
        self.word_counts = np.bincount(self.tokens[taught], minlength=len(self.vocabulary))
        start = len(self.vocabulary)
        before = np.append(start, self.tokens[:-1])
        before[(np.cumsum(self.counts) - self.counts)] = start
        key = before * (start + 1) + self.tokens
        self.pairs, self.pair_of = np.unique(key, return_inverse=True)
        self.pair_counts = np.bincount(self.pair_of[taught], minlength=len(self.pairs))
        self.first, self.second = self.pairs // (start + 1), self.pairs % (start + 1)
        self.hashes = np.append(self.vocabulary, START)

    def shards(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The shard of each word and of each pair."""
        with np.errstate(over="ignore"):
            salt = self.hashes[self.second] % np.uint64(salts(n)) + np.uint64(1)
            pair = (self.hashes[self.first] + salt * _SALT) * _MIX >> np.uint64(32)
            word = self.vocabulary * _MIX >> np.uint64(32)
        return (word % np.uint64(n)).astype(np.int64), (pair % np.uint64(n)).astype(np.int64)

    def _grouped(self, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Words and pairs of each shard that has any, in their order."""
        word, pair = self.shards(n)
        by_word, by_pair = np.argsort(word, kind="stable"), np.argsort(pair, kind="stable")
        word_ends, pair_ends = (np.append(0, np.cumsum(np.bincount(x, minlength=n))) for x in (word, pair))
        for s in range(n):
            w, p = by_word[word_ends[s] : word_ends[s + 1]], by_pair[pair_ends[s] : pair_ends[s + 1]]
            if len(w) or len(p):
                yield s, w, p

    def questions(self, n: int) -> Iterator[tuple[int, bytes]]:
        """For each shard its words with counts, contexts with sizes, followers' numbers with counts."""
        for s, w, p in self._grouped(n):
            first = self.first[p]
            head = np.flatnonzero(np.append(True, first[1:] != first[:-1])) if len(p) else p
            size = np.diff(np.append(head, len(p)))
            child = (self.hashes[self.second[p]] >> np.uint64(64 - CHILD_BITS)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : CHILD_BITS // 8]
            yield s, b"".join([
                struct.pack("<3q", len(w), len(head), len(p)), self.vocabulary[w].astype("<u8").tobytes(), self.word_counts[w].astype("<u4").tobytes(),
                self.hashes[first[head]].astype("<u8").tobytes(), size.astype("<u4").tobytes(), child.tobytes(), self.pair_counts[p].astype("<u4").tobytes(),
            ])

    def scores(self, n: int, answers: dict[int, bytes], train_tokens: int, train_docs: int, vocabulary: int) -> dict[str, np.ndarray]:
        """Of each document: tokens, known tokens, the base score and the model's, all from the shards' answers."""
        word_counts, word_logs = np.zeros(len(self.vocabulary), np.int64), np.zeros(len(self.vocabulary))
        pair_counts = np.zeros(len(self.pairs))
        for s, w, p in self._grouped(n):
            raw = answers[s]
            word_counts[w] = np.frombuffer(raw, "<u4", len(w), 8)
            word_logs[w] = np.frombuffer(raw, "<f4", len(w), 8 + 4 * len(w))
            code = np.frombuffer(raw, np.uint8, len(p), 8 + 8 * len(w))
            pair_counts[p] = np.append(0.0, 10 ** _book(struct.unpack_from("<d", raw)[0]))[code]
        norm = np.log10(train_tokens + vocabulary + 1)
        base = np.log10(word_counts + 1) - norm
        prior = 10 ** (word_logs - norm)
        context = np.append(word_counts, train_docs)[self.first]
        pair = np.log10((pair_counts + MU * prior[self.second]) / (context + MU))
        doc = np.repeat(np.arange(len(self.counts)), self.counts)
        sums = lambda x: np.bincount(doc, x, len(self.counts))
        return {
            "n_tokens": self.counts, "n_known": sums(word_counts[self.tokens] > 0).astype(np.int64),
            "base_score": sums(base[self.tokens]), "score": sums(pair[self.pair_of]),
        }


def _parts(raw: bytes) -> list[np.ndarray]:
    """The arrays of a question: words, counts, contexts, sizes, followers' numbers, counts."""
    n_words, n_contexts, n_pairs = struct.unpack_from("<3q", raw)
    at, out = 24, []
    for kind, n in (("<u8", n_words), ("<u4", n_words), ("<u8", n_contexts), ("<u4", n_contexts), ("u1", n_pairs * (CHILD_BITS // 8)), ("<u4", n_pairs)):
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    child = np.zeros((n_pairs, 8), np.uint8)
    child[:, : CHILD_BITS // 8] = out[4].reshape(n_pairs, CHILD_BITS // 8)
    out[4] = child.view("<u8").ravel()
    return out


def build(questions: list[bytes]) -> bytes:
    """A shard's trie from the training counts of all chunks."""
    parts = [_parts(q) for q in questions]
    words, counts, contexts, sizes, children, pair_counts = (np.concatenate(x) for x in zip(*parts))
    return Trie.pack(words, counts, np.repeat(contexts, sizes), children, pair_counts)


def answers(trie: Trie, questions: list[bytes]) -> list[bytes]:
    """To each question the highest count of a pair, then of all words the exact counts and smoothed logs, of all pairs the codes.

    As many questions as make up ``ASK`` words and pairs are looked up together: the more shards, the shorter a question.
    """
    out = []
    asked = [n_words + n_pairs for n_words, _, n_pairs in (struct.unpack_from("<3q", q) for q in questions)]
    for a, b in runs(asked, ASK):
        parts = [_parts(q) for q in questions[a:b]]
        words, _, contexts, sizes, children, _ = (np.concatenate(x) for x in zip(*parts))
        counts, logs = trie.word(words)
        counts, logs, codes = counts.astype("<u4"), logs.astype("<f4"), trie.pair(contexts, sizes, children)
        w = p = 0
        for own, _, _, _, child, _ in parts:
            word, pair = slice(w, w + len(own)), slice(p, p + len(child))
            out.append(struct.pack("<d", trie.pair_top) + counts[word].tobytes() + logs[word].tobytes() + codes[pair].tobytes())
            w, p = word.stop, pair.stop
    return out


def _filled(batches: Iterator[pa.RecordBatch], most_bytes: int, most_docs: int) -> Iterator[pa.RecordBatch]:
    """The same rows, in batches of one chunk each: up to so many bytes of text (or one longer text) and documents."""
    held, total, rows = [], 0, 0
    for batch in batches:
        start = 0
        for i, size in enumerate(byte_sizes(arrow_text(batch.column("text"))).tolist()):
            if rows and (total + size > most_bytes or rows == most_docs):
                yield pa.concat_batches([*held, batch.slice(start, i - start)])
                held, total, rows, start = [], 0, 0, i
            total, rows = total + size, rows + 1
        held.append(batch.slice(start))
    if rows:
        yield pa.concat_batches(held)


def _write_chunks(docs: DataFrame, id_col: str, text_col: str, folder: str, held: bool) -> None:
    """The corpus as chunks, written once: every later step reads the same ones."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in _filled(batches, CHUNK_BYTES, CHUNK_DOCS):
            c = Chunk.of(arrow_text(batch.column("text")), batch.column("train").to_numpy(zero_copy_only=False).astype(bool))
            row = {
                "chunk": pa.array([number], pa.int64()), "ids": pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("id")),
                "train_tokens": pa.array([int(c.counts[c.train].sum())], pa.int64()), "tokens": pa.array([int(c.counts.sum())], pa.int64()),
                "train_docs": pa.array([int(c.train.sum())], pa.int64()),
                "vocabulary": pa.array([c.vocabulary.astype("<u8").tobytes()], pa.binary()), "numbers": pa.array([c.tokens.astype("<u4").tobytes()], pa.binary()),
                "counts": pa.array([c.counts.astype("<u4").tobytes()], pa.binary()), "train": pa.array([c.train.tobytes()], pa.binary()),
            }
            yield pa.RecordBatch.from_pydict(row)
            number += 1

    kind = docs.schema[id_col].dataType.simpleString()
    train = id_remainder(id_col, 7) != 2 if held else F.lit(True)
    rows = docs.select(F.col(id_col).alias("id"), train.alias("train"), F.col(text_col).alias("text"))
    schema = f"chunk long, ids array<{kind}>, train_tokens long, tokens long, train_docs long, vocabulary binary, numbers binary, counts binary, train binary"
    small_batches(rows).mapInArrow(freed(chunks), schema).write.option("compression", "zstd").parquet(folder)


#: A chunk's columns; the part of the row that holds its ids, before all pieces.
_CHUNK = {"vocabulary": "<u8", "numbers": "<u4", "counts": "<u4", "train": "u1"}
_FIRST = -(1 << 31)


def _chunk(row: dict) -> Chunk:
    chunk = Chunk(*(np.frombuffer(row[k], kind) for k, kind in _CHUNK.items()))
    chunk.count()
    return chunk


def _in_batches(chunk: int, found: Iterator[tuple[int, bytes]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of a number, the chunk and some bytes, in batches of half of ``BATCH_BYTES`` or a little more."""
    numbers, data, total = [], [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array([chunk] * len(data), pa.int64()), pa.array(data, pa.binary())], names)

    for number, raw in found:
        numbers.append(number)
        data.append(raw)
        total += len(raw)
        if total >= BATCH_BYTES // 2:
            yield batch()
            numbers, data, total = [], [], 0
    if data:
        yield batch()


def _questions(chunks: DataFrame, n: int) -> DataFrame:
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                yield from _in_batches(row["chunk"], _chunk(row).questions(n), ["shard", "chunk", "question"])

    rows = small_batches(chunks.select("chunk", "vocabulary", "numbers", "counts", "train"))
    return rows.mapInArrow(freed(ask), "shard int, chunk long, question binary")


def _sizes(chunks: DataFrame) -> tuple[int, int, int]:
    """Shards, training tokens and training documents of a corpus."""
    total = chunks.agg(F.sum("tokens").alias("all"), F.sum("train_tokens").alias("taught"), F.sum("train_docs").alias("docs")).first()
    return max(1, -(-(total["all"] or 0) // SHARD_TOKENS)), total["taught"] or 0, total["docs"] or 0


_ANSWER = "shard int, chunk long, answer binary, words long"


def _answers(questions: DataFrame) -> DataFrame:
    """Each shard's answers to all chunks, and a row of chunk -1 with the number of its known words."""

    def shard(rows: pa.Table) -> pa.Table:
        asked = [q.as_buffer() for q in rows["question"]]
        trie = Trie(build(asked))
        number, chunk = rows["shard"].to_pylist(), rows["chunk"].to_pylist()
        words = [0] * len(asked) + [trie.known_words()]
        out = [pa.array([*number, number[0]], pa.int32()), pa.array([*chunk, -1], pa.int64()), pa.array([*answers(trie, asked), None], pa.binary()), pa.array(words, pa.int64())]
        return pa.Table.from_arrays(out, ["shard", "chunk", "answer", "words"])

    return questions.groupBy("shard").applyInArrow(shard, _ANSWER)


def train(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", held: bool = False) -> None:
    """Write a model to a new folder: ``tries`` (shard, trie) and ``sizes`` (shards, train_tokens, train_docs, words).

    With ``held``, documents whose crc32(id as text) mod 7 is 2 are left out.
    """

    def shard(rows: pd.DataFrame) -> pd.DataFrame:
        raw = build(rows["question"].tolist())
        return pd.DataFrame({"shard": rows["shard"].iloc[:1], "trie": [raw], "words": [Trie(raw).known_words()]})

    spark = docs.sparkSession
    _write_chunks(docs, id_col, text_col, f"{folder}/chunks", held)
    chunks = spark.read.parquet(f"{folder}/chunks")
    n, tokens, taught = _sizes(chunks)
    _questions(chunks, n).groupBy("shard").applyInPandas(shard, "shard int, trie binary, words long").write.parquet(f"{folder}/tries")
    tries = spark.read.parquet(f"{folder}/tries")
    sizes = tries.agg(F.lit(n).alias("shards"), F.lit(tokens).alias("train_tokens"), F.lit(taught).alias("train_docs"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"))
    sizes.write.parquet(f"{folder}/sizes")


def _pieces(chunks: DataFrame) -> DataFrame:
    """Chunks in rows of ``PIECE_BYTES``: chunk, part (from below 0 up to -1), data."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                raw = struct.pack("<4q", *(len(row[k]) for k in _CHUNK)) + b"".join(row[k] for k in _CHUNK)
                n = -(-len(raw) // PIECE_BYTES)
                found = ((k - n, raw[k * PIECE_BYTES : (k + 1) * PIECE_BYTES]) for k in range(n))
                yield from _in_batches(row["chunk"], found, ["part", "chunk", "data"])

    rows = small_batches(chunks.select("chunk", *_CHUNK))
    return rows.mapInArrow(freed(cut), "part int, chunk long, data binary")


def _whole(pieces: list[bytes]) -> Chunk:
    """The chunk of all its pieces, in order."""
    raw, at, fields = b"".join(pieces), 32, {}
    for k, size in zip(_CHUNK, struct.unpack_from("<4q", raw)):
        fields[k] = memoryview(raw)[at : at + size]
        at += size
    return _chunk(fields)


def _finish(chunks: DataFrame, answered: DataFrame, n: int, tokens: int, taught: int, words: int, id_col: str, kind: str) -> DataFrame:
    """Documents scored: a chunk's ids, its pieces and its answers meet in one partition, one after another."""
    names = ["id", "n_tokens", "n_known", "base_score", "score"]

    def scored(ids: pa.Array, pieces: list[bytes], found: dict[int, bytes]) -> pa.RecordBatch:
        got = _whole(pieces).scores(n, found, tokens, taught, words)
        return pa.RecordBatch.from_arrays([ids, *(pa.array(got[k]) for k in names[1:])], names)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, pieces, found = None, None, [], {}
        for batch in batches:
            for i, (chunk, part, data) in enumerate(zip(*(batch.column(k).to_pylist() for k in ("chunk", "part", "data")))):
                if chunk != last:
                    if last is not None:
                        yield scored(ids, pieces, found)
                    last, ids, pieces, found = chunk, None, [], {}
                if data is None:
                    ids = batch.column("ids").slice(i, 1).flatten()
                elif part < 0:
                    pieces.append(data)
                else:
                    found[part] = data
        if last is not None:
            yield scored(ids, pieces, found)

    none = F.lit(None)
    parts = _pieces(chunks).select("chunk", "part", none.cast(f"array<{kind}>").alias("ids"), "data")
    ids = chunks.select("chunk", F.lit(_FIRST).alias("part"), "ids", none.cast("binary").alias("data"))
    back = answered.where("chunk >= 0").select("chunk", F.col("shard").alias("part"), none.cast(f"array<{kind}>").alias("ids"), F.col("answer").alias("data"))
    both = small_batches(parts.unionByName(ids).unionByName(back).repartition("chunk").sortWithinPartitions("chunk", "part"))
    rows = both.mapInArrow(freed(score), f"id {kind}, n_tokens long, n_known long, base_score double, score double")
    held = (id_remainder("id", 7) == 2).alias("held_out")
    return rows.select(F.col("id").alias(id_col), held, "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def score(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score documents with a model that ``train`` has written; columns as in ``apply``."""

    def shard(rows: pd.DataFrame, tries: pd.DataFrame) -> pd.DataFrame:
        trie = Trie(tries["trie"].iloc[0] if len(tries) else build([struct.pack("<3q", 0, 0, 0)]))
        return pd.DataFrame({"shard": rows["shard"], "chunk": rows["chunk"], "answer": answers(trie, rows["question"].tolist()), "words": 0})

    spark, folder = docs.sparkSession, scratch_dir(docs.sparkSession)
    _write_chunks(docs, id_col, text_col, f"{folder}/chunks", False)
    chunks, tries, sizes = spark.read.parquet(f"{folder}/chunks"), spark.read.parquet(f"{model}/tries"), spark.read.parquet(f"{model}/sizes").first()
    asked = _questions(chunks, sizes["shards"]).groupBy("shard").cogroup(tries.groupBy("shard"))
    asked.applyInPandas(shard, _ANSWER).write.parquet(f"{folder}/answers")
    kind = docs.schema[id_col].dataType.simpleString()
    return _finish(
        chunks, spark.read.parquet(f"{folder}/answers"), sizes["shards"], sizes["train_tokens"], sizes["train_docs"], sizes["words"], id_col, kind
    )


def apply(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the documents whose crc32(id as text) mod 7 is not 2 and score all of them.

    One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.  A null text counts as empty and has
    the end token alone.  Ids may repeat or be null (a null id is never held out); each row counts by itself.  Other columns
    are not read.  An empty table gives an empty result.
    """
    spark, folder = docs.sparkSession, scratch_dir(docs.sparkSession)
    _write_chunks(docs, id_col, text_col, f"{folder}/chunks", True)
    chunks = spark.read.parquet(f"{folder}/chunks")
    n, tokens, taught = _sizes(chunks)
    _answers(_questions(chunks, n)).write.option("compression", "zstd").parquet(f"{folder}/answers")
    answered = spark.read.parquet(f"{folder}/answers")
    words = answered.where("chunk = -1").agg(F.sum("words")).first()[0] or 0
    return _finish(chunks, answered, n, tokens, taught, words, id_col, docs.schema[id_col].dataType.simpleString())
