"""SimHash near-duplicates by a Gray-ordered hierarchical index.

Texts become 64-bit fingerprints; equal fingerprints are grouped first.  Two different
fingerprints that differ in at most two bits agree on at least four of six fixed
blocks, so the top level of the index is keyed by the bits of four blocks (15 choices):
one masked pattern, shared by every fingerprint below it.  Spark shuffles the
fingerprints by these keys.  A key leaves at most 22 bits open, so a key holds at most
2**22 distinct fingerprints (32 MB) however large a group of copies is.

Within a key, the fingerprints are sorted by Gray rank, so neighbours share many bits.
Runs of neighbours form nodes; a node keeps the pattern of bits that all of its
fingerprints share, less the bits its parent has already compared.  A search walks
from the top, adds up differences in these patterns and drops a node, with all below it,
as soon as they exceed the distance.

Links between fingerprints become components by alternating large-star and
small-star steps on tables, checkpointed in the shared folder.

``keep`` keeps one document of each component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import cut_lineage, scratch_dir
from .common import arrow_text, byte_sizes, freed, runs, small_batches, split_words

SHINGLE, SEED, DISTANCE = 3, 42, 2
TEXT_BYTES = 3_000_000
#: Bits of the six blocks; distance 2 leaves four of them equal.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Children of a node, and searches carried on at once.
FAN_OUT, SEARCHES = 8, 8192


def _masks() -> list[int]:
    ends = np.cumsum(BLOCKS).tolist()
    blocks = [((1 << size) - 1) << (end - size) for size, end in zip(BLOCKS, ends)]
    return [sum(c) for c in combinations(blocks, len(BLOCKS) - DISTANCE)]


def fingerprints(texts: pa.StringArray, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text, as unsigned 64-bit integers."""
    out = np.zeros(len(texts), np.uint64)
    for a, b in runs(byte_sizes(texts).tolist(), TEXT_BYTES):
        out[a:b] = _fingerprints(*_shingles(texts.slice(a, b - a), shingle))
    return out


def _shingles(texts: pa.StringArray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' shingles one after another, and how many each text has; a shorter text is one shingle."""
    words, counts = split_words(texts, lower=True)
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    # The words of all texts with one blank after each; a shingle is a slice of it.
    size = np.diff(np.frombuffer(words.buffers()[1], np.int32)).astype(np.int64)
    raw = np.frombuffer(words.buffers()[2], np.uint8)
    begin = np.cumsum(size + 1) - size - 1
    spaced = np.full(int(size.sum()) + len(size), 32, np.uint8)
    spaced[np.arange(len(raw)) + np.repeat(np.arange(len(size)), size)] = raw
    text, end = spaced.tobytes(), begin + size
    full = counts > 0
    shingles = np.where(counts >= shingle, counts - shingle + 1, full)
    first = np.cumsum(counts) - counts
    doc = np.repeat(np.arange(len(texts)), shingles)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(shingles) - shingles, shingles) + first[doc]
    last = np.minimum(start + shingle, first[doc] + counts[doc]) - 1
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(text[i:j], SEED) for i, j in zip(begin[start].tolist(), end[last].tolist())], np.uint64)
    return hashes, shingles


def _fingerprints(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    full = counts > 0
    out = np.zeros(len(counts), np.uint64)
    at = (np.cumsum(counts) - counts)[full]
    for low in range(0, len(at), 256):
        some = at[low : low + 256]
        stop = at[low + 256] if low + 256 < len(at) else len(hashes)
        bits = np.unpackbits(hashes[some[0] : stop].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, some - some[0], axis=0, dtype=np.int32)
        sizes = np.diff(np.append(some, stop))
        packed = np.packbits(2 * ones > sizes[:, None], axis=1)
        out[np.flatnonzero(full)[low : low + 256]] = packed.view(">u8").ravel()
    return out


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the order of the reflected Gray code."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Nodes over fingerprints sorted by (group, Gray rank); a node never spans two groups."""

    def __init__(self, groups: np.ndarray, codes: np.ndarray):
        order = np.lexsort((gray_rank(codes), groups))
        self.groups, self.codes = groups[order], codes[order]
        all_bits = np.uint64(0xFFFFFFFFFFFFFFFF)
        shared, group = np.full(len(codes), all_bits), self.groups
        #: Per level from the leaves up: first child of each node, shared pattern, bits to compare there.
        self.levels = [(None, self.codes, shared)]
        self.parents: list[np.ndarray] = []
        while len(group) > len(np.unique(group)):
            head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            place = np.arange(len(group)) - np.repeat(head, np.diff(np.append(head, len(group))))
            child = np.flatnonzero(place % FAN_OUT == 0)
            _, value, below = self.levels[-1]
            same = np.bitwise_and.reduceat(below, child)
            varied = np.bitwise_or.reduceat(value, child) ^ np.bitwise_and.reduceat(value, child)
            same &= ~varied
            size = np.diff(np.append(child, len(group)))
            self.levels[-1] = (self.levels[-1][0], value, below & ~np.repeat(same, size))
            self.levels.append((np.append(child, len(group)), value[child], same))
            group = group[child]
        self.top = group

    def links(self, most: int, searches: int = SEARCHES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of all pairs of one group that differ in at most ``most`` bits, in blocks of searches."""
        top = np.searchsorted(self.top, self.groups)
        for low in range(0, len(self.codes), searches):
            query = np.arange(low, min(low + searches, len(self.codes)))
            node, diff = top[query], np.zeros(len(query), np.int64)
            for first, value, mask in reversed(self.levels):
                diff = diff + np.bitwise_count((self.codes[query] ^ value[node]) & mask[node])
                near = diff <= most
                query, node, diff = query[near], node[near], diff[near]
                if first is not None:
                    size = first[node + 1] - first[node]
                    query, diff = np.repeat(query, size), np.repeat(diff, size)
                    node = np.repeat(first[node] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            later = node > query
            yield query[later], node[later]


def spanning_links(groups: np.ndarray, codes: np.ndarray, most: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Each linked code and the smallest place linked to it through its group: a forest, not all pairs."""
    index = GrayIndex(groups, codes)
    root = np.arange(len(codes))
    for a, b in index.links(most):
        while len(a):
            low = np.minimum(root[a], root[b])
            np.minimum.at(root, root[a], low)
            np.minimum.at(root, root[b], low)
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
            left = root[a] != root[b]
            a, b = a[left], b[left]
    linked = np.flatnonzero(root != np.arange(len(root)))
    return index.codes[linked], index.codes[root[linked]]


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of whole keys; rows come sorted by key, and a key may go on in the next batch."""
    kept: list[np.ndarray] = []

    def links(part: np.ndarray) -> pa.RecordBatch:
        change = np.any(part[1:, :2] != part[:-1, :2], axis=1)
        group = np.append(0, np.cumsum(change)) if len(part) else np.zeros(0, np.int64)
        many = np.bincount(group)[group] > 1 if len(part) else np.zeros(0, bool)
        a, b = spanning_links(group[many], part[many, 2].astype(np.int64).view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        part = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("mask", "key", "code")])
        kept.append(part)
        change = np.flatnonzero(np.any(part[1:, :2] != part[:-1, :2], axis=1))
        if len(change):
            whole = np.concatenate([*kept[:-1], part[: change[-1] + 1]])
            kept = [part[change[-1] + 1 :]]
            yield links(whole)
    if kept:
        yield links(np.concatenate(kept))


def near_links(codes: DataFrame) -> DataFrame:
    """Links a, b that connect all distinct codes (column ``code``, long) within the distance."""
    keys = [F.struct(F.lit(i).alias("mask"), F.col("code").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("key")) for i, m in enumerate(_masks())]
    rows = codes.select("code", F.explode(F.array(*keys)).alias("k")).select("k.mask", "k.key", "code")
    dealt = rows.repartition("mask", "key").sortWithinPartitions("mask", "key")
    return dealt.mapInArrow(_link_batches, "a long, b long").where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root of every linked node, by alternating star steps until nothing changes.

    A hot node is never gathered: minima are partial aggregates that are joined back.
    """
    edges = cut_lineage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        small = small.unionByName(low.select("a", F.col("low").alias("b")))
        edges = cut_lineage(small.distinct())


def _placed(rows: DataFrame) -> DataFrame:
    """code, root and component_id of every distinct code of ``rows`` (id, code)."""
    groups = cut_lineage(rows.groupBy("code").agg(F.min("id").alias("first")))
    roots = components(near_links(groups.select("code")))
    placed = groups.join(roots, groups["code"] == roots["node"], "left").select("code", "first", F.coalesce("root", "code").alias("root"))
    named = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return placed.join(named, "root").select("code", "root", "component_id")


def apply(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fingerprint, component_id.

    A null text counts as empty and takes the zero fingerprint.  Rows with a null id are linked like others, but
    no component takes its name from them (null if there is nothing else).  Repeated rows come back as often as they
    stand there.  Other columns are not read.  An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = fingerprints(arrow_text(batch.column("text"))).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(codes)], ["id", "code"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(freed(run), f"id {kind}, code long")
    rows = cut_lineage(rows)
    out = rows.join(_placed(rows).select("code", "component_id"), "code")
    fingerprint = F.lower(F.lpad(F.hex("code"), 16, "0"))
    return out.select(F.col("id").alias(id_col), fingerprint.alias("fingerprint"), "component_id")


def _free(name: str, taken: list[str]) -> str:
    """``name``, lengthened until no column has it."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def keep(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``apply``, the one with the smallest id (any one of several); all columns as they are.

    A null text counts as empty; texts without words are one component.  A row with a null id stays only if its component
    has no other.  The marks stand in one column whose name no column of ``docs`` has.  The rows are written once to the
    shared folder with a number each, so that the choice stays the same when a task runs again.  An empty table gives an
    empty result.
    """
    mark = _free("mark", docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = fingerprints(arrow_text(batch.column(text_col))).view(np.int64)
            yield batch.append_column(mark, pa.array(codes))

    spark, folder = docs.sparkSession, scratch_dir(docs.sparkSession)
    marked = small_batches(docs).mapInArrow(freed(run), StructType([*docs.schema.fields, StructField(mark, LongType())]))
    numbered = F.struct(F.col(mark).alias("code"), F.monotonically_increasing_id().alias("row"))
    marked.withColumn(mark, numbered).write.parquet(folder)
    marked = spark.read.parquet(folder)
    rows = marked.select(F.col(id_col).alias("id"), f"{mark}.code", f"{mark}.row")
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row"))["row"]
    chosen = rows.join(_placed(rows).select("code", "root"), "code").groupBy("root").agg(first.alias("row"))
    return marked.join(chosen.select("row"), F.col(f"{mark}.row") == chosen["row"], "left_semi").select(*docs.columns)
