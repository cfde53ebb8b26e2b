"""Helpers the training-data operators share."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Words are runs of anything but the six ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
words_of = re.compile(WORD_PATTERN).findall


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a folder, read by Spark wherever the folder lives."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(col: str | Column, modulus: int) -> Column:
    """crc32 of an id as text, modulo ``modulus``; -1 for a null id."""
    text = (F.col(col) if isinstance(col, str) else col).cast("string")
    return F.coalesce(F.crc32(text.cast("binary")) % modulus, F.lit(-1))


def crc_remainder(value, modulus: int) -> int:
    """``id_remainder`` of one Python value."""
    return -1 if value is None else zlib.crc32(str(value).encode()) % modulus


def text_or_empty(value) -> str:
    return value if isinstance(value, str) else ""


def runs(sizes: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
    """Cut 0..n into runs whose sizes add up to ``most`` or less; a larger item is a run of its own."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


#: Bytes of all texts of a training sample, which go to the driver as texts or features.
SAMPLE_BYTES = 32 << 20


def labelled_sample(
    docs: DataFrame, labels: DataFrame, target: str, most: int, *, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = SAMPLE_BYTES
) -> DataFrame:
    """At most ``most`` labelled training documents of ``most_bytes`` of text together: id, text, label.

    Training rows are those whose crc32(id as text) mod 3 is not 1.  The sample is
    the first by a hash of the id, so it is the same on every run.  Of an id that stands in
    several rows one text is taken, the first by its hash; a text beyond ``most_bytes`` is passed over.  Only ids, labels and sizes
    are sorted; the sample is bounded, so it is broadcast against the documents.
    """
    chosen = (
        labels.select(F.col(id_col).alias("__id"), F.col(target).cast("int").alias("label"))
        .where(F.col("__id").isNotNull() & F.col("label").isNotNull() & (id_remainder("__id", 3) != 1))
        .groupBy("__id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(most)
    )
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    first = F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))["text"]
    one = texts.where(F.octet_length("text") <= most_bytes).join(F.broadcast(chosen), "__id").groupBy("__id", "label").agg(first.alias("text"))
    one = cut_lineage(one)
    total = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("__id"), "__id"))
    within = one.select("__id", total.alias("total")).where(F.col("total") <= most_bytes).select("__id")
    return one.join(F.broadcast(within), "__id", "left_semi").select("__id", "text", "label")


#: Bytes of an Arrow batch; executors and their Python workers hold a few at a time.
BATCH_BYTES = 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """The same rows; batches to Python are bounded in bytes, since texts differ widely in length."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = df.sparkSession.conf
    if int(conf.get(name).rstrip("bB")) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def joined_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in fewer batches, of ``size`` bytes or a little more."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.nbytes
        if total >= size:
            yield pa.concat_batches(held)
            held, total = [], 0
    if held:
        yield pa.concat_batches(held)


def freed(run):
    """``run``, a function of batches, returning unused memory to the system when a partition ends."""

    def inner(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return inner


def arrow_text(column) -> pa.StringArray:
    """A text column of an Arrow batch as one string array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.string()), "")


def byte_sizes(texts: pa.StringArray) -> np.ndarray:
    return pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)


def _bytes_and_ends(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an array without nulls, and where each text begins and ends."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


#: ASCII letters are 1, ASCII punctuation other than the apostrophe 2.
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[[x for x in range(33, 127) if not chr(x).isalnum() and chr(x) != "'"]] = 2


def split_words(texts: pa.StringArray, *, lower: bool = False, punctuation: bool = False) -> tuple[pa.BinaryArray, np.ndarray]:
    """The words of all texts one after another, and how many each text has.

    Works on the bytes of the whole array at once.  ``lower`` turns A-Z into a-z.  ``punctuation`` also cuts words
    between an ASCII letter and ASCII punctuation (apostrophes aside).
    """
    raw, ends = _bytes_and_ends(texts)
    inside = ~_IS_SPACE[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[ends] = True
    before = np.empty(len(raw), bool)
    if len(raw):
        before[0] = False
        before[1:] = inside[:-1]
    starts = inside & (~before | first[:-1])
    if punctuation and len(raw):
        kind = _KIND[raw]
        starts[1:] |= kind[1:] + kind[:-1] * 4 == 6
        starts[1:] |= kind[1:] + kind[:-1] * 4 == 9
    start = np.flatnonzero(starts)
    packed = raw[inside]
    if lower:
        packed = np.where((packed >= 65) & (packed <= 90), packed | 32, packed)
    at = np.concatenate([np.cumsum(inside) - inside, [len(packed)]]) if len(raw) else np.zeros(1, np.int64)
    offsets = np.append(at[start], len(packed)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(packed))])
    counts = np.diff(np.searchsorted(start, ends))
    return words, counts


def distinct(values: pa.Array) -> tuple[list, np.ndarray]:
    """The distinct values and each row's place among them."""
    coded = values.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i]+1, ... (sizes[i] of them) for all i, one after another."""
    total = int(sizes.sum())
    shift = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return shift + np.arange(total)


def hash_words(words: pa.BinaryArray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a polynomial, then a mixer, over the whole array at once."""
    raw, ends = _bytes_and_ends(words)
    sizes = np.diff(ends)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(sizes.max(initial=0)) + 1, np.uint64(0xD1342543DE82EF95)))
        place = np.arange(len(raw)) - np.repeat(ends[:-1], sizes)
        sums = np.append(np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[place]))
        h = sums[ends[1:]] - sums[ends[:-1]]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ h >> np.uint64(shift)) * np.uint64(factor)
        return h ^ h >> np.uint64(31)


def drop_table(spark: SparkSession, folder: str) -> None:
    """Remove a written table that no later step reads."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
