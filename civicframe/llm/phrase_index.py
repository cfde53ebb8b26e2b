"""Phrases by an FM-index per shard over word ids.

Texts are cut into pieces and words, and every task turns its texts into shards of bounded size, one language each: word numbers of
the shard with a break between pieces.  A shard's index holds the Burrows-Wheeler transform of its words and that of its
words read backwards, sorted as deep as a phrase is long.  The interval of a phrase in the one extends to the
right, that in the other to the left: the words in an interval of the transform are the extensions, and how often they stand
there are the counts.  A phrase is thus found twice, from its first words and from its last, and both must be frequent.

Spark sums the counts of all shards, one row a shard and phrase, so no phrase holds more rows than there are shards.
Phrases below the least count go before the next level.  A phrase is named by the smallest (shard, place) that has it, so names are
exact and shards need no common dictionary; a longer phrase is the pair of names of its first and its last words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_dir
from .common import _bytes_and_ends, arrow_text, drop_table, freed, small_batches, spread

LEAST, LONGEST, TOP, SHARE, FACTOR = 30, 4, 2000, 80, 2_000_000
#: Bytes of text of a shard, and of all texts that wait in a task for their shard to fill.
SHARD_BYTES, HELD_BYTES = 16 << 20, 48 << 20

_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", 10, 11, 12, 13]] = 2


def words_and_breaks(texts: pa.StringArray) -> tuple[pa.BinaryArray, np.ndarray]:
    """The words of all texts with A-Z in lower case, and whether each begins a piece."""
    raw, ends = _bytes_and_ends(texts)
    kind = _KIND[raw]
    inside = kind == 0
    fresh = np.zeros(len(raw) + 1, bool)
    fresh[ends] = True
    start = np.flatnonzero(inside & (fresh[:-1] | ~np.append(False, inside[:-1]))) if len(raw) else np.zeros(0, np.int64)
    packed = raw[inside]
    packed = np.where((packed >= 65) & (packed <= 90), packed | 32, packed)
    offsets = np.append((np.cumsum(inside) - inside)[start], len(packed)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(packed))])
    # Breaks so far, counting the ends of texts.
    passed = (np.cumsum(kind == 2) + np.cumsum(fresh)[:-1])[start] if len(start) else np.zeros(0, np.int64)
    return words, np.append(True, passed[1:] != passed[:-1])[: len(start)]


def _pack(values: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(values)
    return len(raw).to_bytes(8, "little") + pa.compress(raw.tobytes(), codec="zstd", asbytes=True)


def _unpack(packed: bytes, kind: str) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    return np.frombuffer(pa.decompress(packed[8:], n * np.dtype(kind).itemsize, codec="zstd"), kind)


_SHARD_KIND = "lang string, n long, size long, tokens binary, words array<string>, counts array<int>"


def _shard(lang: str, held: list[tuple[pa.BinaryArray, np.ndarray]]) -> pa.RecordBatch:
    """One shard: word numbers from 1 with 0 before each piece, the words in that order, and their counts."""
    coded = pa.concat_arrays([w for w, _ in held]).dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32) + 1
    first = np.concatenate([b for _, b in held])
    tokens = np.zeros(len(code) + int(first.sum()), np.int32)
    tokens[np.arange(len(code)) + np.cumsum(first)] = code
    words, counts = coded.dictionary.cast(pa.string()), np.bincount(code, minlength=len(coded.dictionary) + 1)[1:]
    ends = pa.array([0, len(words)], pa.int32())
    columns = [
        pa.array([lang], pa.string()), pa.array([len(code)]), pa.array([len(tokens)]), pa.array([_pack(tokens)], pa.binary()),
        pa.ListArray.from_arrays(ends, words), pa.ListArray.from_arrays(ends, pa.array(counts.astype(np.int32))),
    ]
    return pa.RecordBatch.from_arrays(columns, ["lang", "n", "size", "tokens", "words", "counts"])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of the texts (lang, text) of a task; a longer text is a shard of its own."""
    held: dict[str, list] = {}
    size: dict[str, int] = {}
    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), arrow_text(batch.column("text"))
        for lang in dict.fromkeys(langs):
            words, first = words_and_breaks(texts.take(pa.array([i for i, x in enumerate(langs) if x == lang])))
            if len(words):
                held.setdefault(lang, []).append((words, first))
                size[lang] = size.get(lang, 0) + words.nbytes + len(first)
        while size and (max(size.values()) >= SHARD_BYTES or sum(size.values()) >= HELD_BYTES):
            lang = max(size, key=size.get)
            size.pop(lang)
            yield _shard(lang, held.pop(lang))
    for lang, parts in held.items():
        yield _shard(lang, parts)


class PhraseIndex:
    """Transforms of a text of word numbers (0 is a break) and of the text read backwards, sorted to ``depth`` words."""

    def __init__(self, text: np.ndarray, depth: int):
        # One break at either end at any depth, so that places are the same in all indexes of a text.
        self.text = np.concatenate([[0], text, [0]]).astype(np.int64)
        self.n, self.symbols = len(self.text), int(self.text.max(initial=0)) + 1
        #: Where the suffixes that begin with a word begin.
        self.begin = np.append(0, np.cumsum(np.bincount(self.text, minlength=self.symbols)))
        self.order, self.before = self._sorted(self.text, depth)
        _, self.after = self._sorted(self.text[::-1], depth)
        self._keys: dict[bool, np.ndarray] = {}

    @staticmethod
    def _sorted(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes by their first ``depth`` words, and the word before each."""
        rank, known = text, 1
        while True:
            step = min(known, depth - known)
            later = np.append(rank[step:], np.zeros(step, rank.dtype)) if step else np.zeros_like(rank)
            key = rank * (int(rank.max(initial=0)) + 1) + later
            order = np.argsort(key, kind="stable")
            known += step
            if known >= depth:
                return order, text[order - 1]
            # Ranks of the first ``known`` words; the last word alone serves the rest, as a rank of as many words orders it too.
            rank = np.empty(len(text), np.int64)
            rank[order] = np.cumsum(np.append(0, np.diff(key[order]) != 0))

    def places(self, words: np.ndarray, backwards: bool, at: np.ndarray) -> np.ndarray:
        """Where the interval of word + phrase begins, for phrases whose intervals begin ``at``."""
        if backwards not in self._keys:
            bwt = self.after if backwards else self.before
            order = np.argsort(bwt, kind="stable")
            self._keys[backwards] = bwt[order] * self.n + order
        return np.searchsorted(self._keys[backwards], words * self.n + at)

    def extensions(self, at: np.ndarray, size: np.ndarray, backwards: bool) -> tuple[np.ndarray, ...]:
        """For all intervals: parent, word before (after, if ``backwards``), count, occurrences of smaller words in the parent."""
        bwt = self.after if backwards else self.before
        key = np.repeat(np.arange(len(at)), size) * self.symbols + bwt[spread(at, size)]
        key, count = np.unique(key, return_counts=True)
        parent, word = key // self.symbols, key % self.symbols
        passed = np.cumsum(count) - count
        passed -= passed[np.searchsorted(parent, parent)]
        whole = word > 0
        return parent[whole], word[whole], count[whole], passed[whole]

    def reverse_places(self, at: np.ndarray, length: int) -> np.ndarray:
        """Where the backward intervals of phrases begin whose forward intervals begin ``at``: one backward search."""
        first = self.order[at]
        found = self.begin[self.text[first]]
        for k in range(1, length):
            found = self.places(self.text[first + k], True, found)
        return found

    def longer(self, at: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
        """Phrases one word longer than the given ones: forward place, number of the first words, of the last words, count.

        Both the first and the last ``length`` words must be among the given phrases.
        """
        p, _, count, passed = self.extensions(self.reverse_places(at, length), size, True)
        right = at[p] + passed
        q, word, _, _ = self.extensions(at, size, False)
        left = self.places(word, False, at[q])
        _, i, j = np.intersect1d(right, left, assume_unique=True, return_indices=True)
        return right[i], p[i], q[j], count[i]


_INDEX_KIND = "shard long, text binary, names binary"
_FOUND_KIND = "row long, p long, q long, c long"


def _frequent_text(tokens: pa.Table, words: pa.Table) -> pa.Table:
    """A shard's text with its frequent words only, numbered anew, and their names; other words are breaks."""
    out = []
    if tokens.num_rows and words.num_rows:
        text = _unpack(tokens["tokens"][0].as_py(), "<i4")
        local = words["local"].to_numpy().astype(np.int64)
        order = np.argsort(local)
        number = np.zeros(int(max(text.max(initial=0), local.max())) + 1, np.int32)
        number[local[order]] = np.arange(1, len(order) + 1)
        text = number[text]
        text = text[(text > 0) | np.append(True, text[:-1] > 0)]
        names = words["name"].to_numpy().astype("<i8")[order]
        out = [(tokens["shard"][0].as_py(), _pack(text.astype("<i4")), _pack(names))]
    return pa.table({"shard": pa.array([r[0] for r in out], pa.int64()), "text": pa.array([r[1] for r in out], pa.binary()), "names": pa.array([r[2] for r in out], pa.binary())})


def _found(first: int, index: PhraseIndex, at: np.ndarray, size: np.ndarray, names: np.ndarray, length: int) -> pa.Table:
    place, p, q, count = index.longer(at, size, length)
    return pa.table({"row": first + place, "p": names[p], "q": names[q], "c": count.astype(np.int64)})


def _pairs(bits: int):
    """Phrases of two words of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                index = PhraseIndex(_unpack(row["text"], "<i4"), 2)
                words = np.arange(1, index.symbols)
                found = _found(row["shard"] << bits, index, index.begin[words], np.diff(index.begin)[words], _unpack(row["names"], "<i8"), 1)
                yield from found.to_batches(max_chunksize=1 << 17)

    return run


def _next_level(length: int, bits: int):
    """Phrases of one word more than ``length`` of a shard."""

    def run(shards: pa.Table, phrases: pa.Table) -> pa.Table:
        if not shards.num_rows or not phrases.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("row", "p", "q", "c")})
        index = PhraseIndex(_unpack(shards["text"][0].as_py(), "<i4"), length + 1)
        at, size, names = (phrases[c].to_numpy().astype(np.int64) for c in ("place", "c", "name"))
        order = np.argsort(at)
        return _found(shards["shard"][0].as_py() << bits, index, at[order], size[order], names[order], length)

    return run


def _summed(found: DataFrame, by: list[str], least: int) -> DataFrame:
    """The rows of frequent phrases with f, the count over all shards, and name, the smallest row."""
    over = Window.partitionBy(*by)
    return found.withColumns({"f": F.sum("c").over(over), "name": F.min("row").over(over)}).where(F.col("f") >= least)


def phrases(
    docs: DataFrame, *, least: int = LEAST, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang"
) -> tuple[list[DataFrame], DataFrame]:
    """For each length from 1 the phrases found ``least`` times or more in a language, and the words of each language.

    A level has name, lang, f, phrase, last (its last word), p and q (names of its first and its last words), heads and tails
    (counts of its first and of its last 1, 2, ... words).
    """
    spark, folder = docs.sparkSession, scratch_dir(docs.sparkSession)
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    texts = small_batches(docs).select(lang.alias("lang"), F.col(text_col).alias("text"))
    texts.mapInArrow(freed(_shards), _SHARD_KIND).withColumn("made", F.monotonically_increasing_id()).write.parquet(f"{folder}/made")
    made = spark.read.parquet(f"{folder}/made")
    made.groupBy("lang").agg(F.sum("n").alias("n")).write.parquet(f"{folder}/totals")
    # A phrase's row in a shard is (task, shard of the task, place) in one long: as many bits for each as these tables need.
    task, turn = F.shiftright("made", 33), F.col("made").bitwiseAND(F.lit((1 << 33) - 1))
    most = [int(x or 0) for x in made.agg(F.max(task), F.max(turn), F.max("size") + 2).first()]
    if sum(x.bit_length() for x in most) > 63:
        raise ValueError("the rows of all shards do not fit a long; read the table in larger partitions")
    bits = most[2].bit_length()
    shards = made.withColumn("shard", F.shiftleft(task, most[1].bit_length()) + turn)

    words = shards.select("lang", "shard", F.posexplode(F.arrays_zip("words", "counts")).alias("i", "w"))
    row = F.shiftleft("shard", bits) + F.col("i") + 1
    words = words.select("lang", row.alias("row"), F.col("w.words").alias("phrase"), F.col("w.counts").cast("long").alias("c"))
    _summed(words, ["lang", "phrase"], least).write.parquet(f"{folder}/level1")
    level = spark.read.parquet(f"{folder}/level1")

    def of_shards(rows: DataFrame, place: str) -> DataFrame:
        return rows.select(F.shiftright("row", bits).alias("shard"), F.col("row").bitwiseAND(F.lit((1 << bits) - 1)).alias(place), "name", "c")

    both = shards.select("shard", "tokens").groupBy("shard").cogroup(of_shards(level, "local").groupBy("shard"))
    both.applyInArrow(_frequent_text, _INDEX_KIND).write.parquet(f"{folder}/index")
    drop_table(spark, f"{folder}/made")
    index = spark.read.parquet(f"{folder}/index")
    one = level.where("row = name").select("name", "lang", "f", "phrase")
    out = [one.select("*", F.col("phrase").alias("last"), F.lit(None).cast("long").alias("p"), F.lit(None).cast("long").alias("q"), F.array("f").alias("heads"), F.array("f").alias("tails"))]
    for length in range(1, longest):
        if length == 1:
            found = index.mapInArrow(freed(_pairs(bits)), _FOUND_KIND)
        else:
            both = index.groupBy("shard").cogroup(of_shards(level, "place").groupBy("shard"))
            found = both.applyInArrow(_next_level(length, bits), _FOUND_KIND)
        _summed(found, ["p", "q"], least).write.parquet(f"{folder}/level{length + 1}")
        level = spark.read.parquet(f"{folder}/level{length + 1}")
        below = out[-1]
        first = below.select(F.col("name").alias("p"), "lang", F.col("phrase").alias("start"), "heads")
        rest = below.select(F.col("name").alias("q"), "last", "tails")
        longer = level.where("row = name").select("name", "p", "q", "f").join(first, "p").join(rest, "q")
        longer = longer.select(
            "name", "lang", "f", F.concat_ws(" ", "start", "last").alias("phrase"), "last", "p", "q",
            F.concat("heads", F.array("f")).alias("heads"), F.concat("tails", F.array("f")).alias("tails"),
        )
        longer.write.parquet(f"{folder}/phrases{length + 1}")
        out.append(spark.read.parquet(f"{folder}/phrases{length + 1}"))
    drop_table(spark, f"{folder}/index")
    return out, spark.read.parquet(f"{folder}/totals")


def collocations(
    docs: DataFrame, *, least: int = LEAST, longest: int = LONGEST, top: int = TOP, share: int = SHARE, factor: int = FACTOR,
    text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of 2 to ``longest`` words.

    A phrase is cut in two where floor(factor * a / (l + r)) is lowest (the first such cut); a, l and r count the phrase, its first part and
    its rest, n all words of the language.  A phrase inside a longer one that has ``share`` percent of its count or more goes.  As counts
    can only fall with length, the phrases one word longer decide that.  Ties go to the larger count, then to the smaller phrase by its bytes.

    A null text has no words, a null language is ``und``.  Repeated rows count as often as they stand there; other columns are not
    read.  An empty table gives an empty result.
    """
    levels, totals = phrases(docs, least=least, longest=longest, text_col=text_col, lang_col=lang_col)
    ranked = []
    for k, level in enumerate(levels[1:], 1):
        if k + 1 < len(levels):
            above = levels[k + 1]
            over = above.select(F.col("p").alias("name"), "f").unionByName(above.select(F.col("q").alias("name"), "f"))
            over = over.groupBy("name").agg(F.max("f").alias("over"))
            level = level.join(over, "name", "left").where(f"over IS NULL OR 100BD * cast(over AS decimal(20)) < {share}BD * cast(f AS decimal(20))")
        score = f"({factor}BD * cast(f AS decimal(20))) div (cast(heads[k - 1] AS decimal(20)) + cast(tails[size(tails) - k - 1] AS decimal(20)))"
        cuts = f"transform(sequence(1, size(heads) - 1), k -> named_struct('score', {score}, 'k', k, 'l', heads[k - 1], 'r', tails[size(tails) - k - 1]))"
        ranked.append(level.select("lang", "phrase", F.col("f").alias("a"), F.array_min(F.expr(cuts)).alias("cut")))
    every = reduce(DataFrame.unionByName, ranked).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = every.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
