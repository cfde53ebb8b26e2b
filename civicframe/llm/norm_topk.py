"""Exact inner-product search over vectors in order of their length.

Entries become whole numbers, so scores are exact.  Vectors are sorted by falling length into blocks; equal vectors
keep only as many ids as a result can name.  All vectors are seen in the axes of the singular value decomposition of the whole
table (the eigenvectors of its second moments), where the first coordinates hold most of a score.  A search of a block

* ends when |q| |x| of the longest vector left cannot reach the query's k-th score so far,
* adds up the first rotated coordinates and drops what the Cauchy-Schwarz bound of the rest cannot lift to that score,
  first a quarter of the axes, then a half,
* multiplies what is left exactly.

Bounds are in doubles with a margin far above their rounding, scores in 64-bit whole numbers.  The longest vectors
give each query a first k-th score.  Queries go out in blocks of bounded size, each against all vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_dir
from .common import freed, small_batches
from .vectors import integers, lengths

SCALE, TOP, EVERY = 256, 5, 50
#: Scaled entries from here on could give scores beyond a long (at 4,096 dimensions).
LIMIT = 2.0**25
#: Vectors of a block, queries of a row and searched together, bytes of the queries of one broadcast, pairs compared at once.
BLOCK, QUERIES, QUERY_BYTES, PAIRS = 4096, 1024, 16 << 20, 1 << 16
#: A bound must stay below the score sought by more than this share of |q| |x|.
MARGIN = 1e-9
_LEAST = np.iinfo(np.int64).min

_BLOCK_KIND = "norm long, n int, ids binary, vectors binary"


def _firsts(order_keys: list[np.ndarray], vectors: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places, in sorted order, of the ``most`` smallest different ids of each distinct vector."""
    order = np.lexsort((ids, *vectors.T[::-1], *order_keys[::-1]))
    v, i = vectors[order], ids[order]
    fresh = np.append(True, np.any(v[1:] != v[:-1], axis=1))[: len(i)]
    new = fresh | np.append(True, i[1:] != i[:-1])[: len(i)]
    order, fresh = order[new], fresh[new]
    head = np.flatnonzero(fresh)
    place = np.arange(len(order)) - np.repeat(head, np.diff(np.append(head, len(order))))
    return order[place < most]


def _prepared(vectors: DataFrame, width: int, most: int) -> DataFrame:
    """norm (squared length), id, vec of the usable vectors; of equal vectors of a batch the ``most`` smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, x = integers(batch.column("vec"), SCALE, width, LIMIT)
            ids = batch.column("id").to_numpy(zero_copy_only=False)[kept].astype(np.int64)
            norm = (x * x).sum(axis=1)
            chosen = _firsts([-norm], x, ids, most)
            vec = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * width), len(chosen), [None, pa.py_buffer(x[chosen].astype("<i4").tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(norm[chosen]), pa.array(ids[chosen]), vec.cast(pa.binary())], ["norm", "id", "vec"])

    return vectors.mapInArrow(freed(run), "norm long, id long, vec binary")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, width).astype(np.int64)


def _packed(ids: np.ndarray, x: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    for low in range(0, len(ids), size):
        part = ids[low : low + size]
        yield pa.RecordBatch.from_arrays([
            pa.array((x[low : low + 1] ** 2).sum(axis=1)), pa.array([len(part)], pa.int32()), pa.array([part.astype("<i8").tobytes()], pa.binary()),
            pa.array([x[low : low + size].astype("<i4").tobytes()], pa.binary()),
        ], ["norm", "n", "ids", "vectors"])


def _blocks(rows: DataFrame, width: int, most: int) -> DataFrame:
    """Blocks of vectors by falling length; rows come sorted, and copies of a vector stand together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_ids, run, held_ids, held = np.zeros(0, np.int64), np.zeros((0, width), np.int64), np.zeros(0, np.int64), np.zeros((0, width), np.int64)
        for batch in batches:
            # The last copies of one vector wait for the next batch, which may go on with them.
            ids, x = np.append(run_ids, batch.column("id").to_numpy()), np.vstack([run, _matrix(batch.column("vec"), width)])
            if not len(ids):
                continue
            fresh = np.append(True, np.any(x[1:] != x[:-1], axis=1))
            new = fresh | np.append(True, ids[1:] != ids[:-1])
            ids, x, fresh = ids[new], x[new], fresh[new]
            head = np.flatnonzero(fresh)
            place = np.arange(len(ids)) - np.repeat(head, np.diff(np.append(head, len(ids))))
            use = place < most
            ids, x, last = ids[use], x[use], int(use[: head[-1]].sum())
            held_ids, held = np.append(held_ids, ids[:last]), np.vstack([held, x[:last]])
            run_ids, run = ids[last:], x[last:]
            whole = len(held) // BLOCK * BLOCK
            yield from _packed(held_ids[:whole], held[:whole], BLOCK)
            held_ids, held = held_ids[whole:], held[whole:]
        yield from _packed(np.append(held_ids, run_ids), np.vstack([held, run]), BLOCK)

    ordered = rows.withColumn("h", F.xxhash64("vec")).repartitionByRange(F.desc("norm"), "h").sortWithinPartitions(F.desc("norm"), "h", "vec", "id")
    return ordered.select("id", "vec").mapInArrow(freed(run), _BLOCK_KIND)


def _unpacked(row, width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["vectors"], "<i4").reshape(-1, width).astype(np.int64)


def rotation(blocks: DataFrame, width: int) -> np.ndarray:
    """The right singular vectors of all vectors as columns; only second moments, summed over tasks, reach the driver."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for row in batch.to_pylist():
                x = _unpacked(row, width)[1].astype(float)
                total += x.T @ x
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "v"])

    sums = blocks.mapInArrow(freed(moments), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    second = np.zeros((width, width))
    for r in sums:
        second[r["i"], r["j"]] = second[r["j"], r["i"]] = r["v"]
    return np.linalg.svd(second)[2].T


class Rotated:
    """Whole-number vectors, their rotated coordinates, and the length left beyond a number of axes."""

    def __init__(self, x: np.ndarray, axes: np.ndarray):
        self.x, self.turned = x, x.astype(float) @ axes
        self.steps = sorted({len(axes) // 4, len(axes) // 2} - {0})
        square = self.turned**2
        self.length = np.sqrt(square.sum(axis=1))
        self.rest = {h: np.sqrt(square[:, h:].sum(axis=1)) for h in self.steps}


class Search:
    """The best scores of a set of queries so far, block after block of vectors by falling length."""

    def __init__(self, ids: np.ndarray, queries: Rotated, top: int, floor: np.ndarray):
        self.ids, self.q, self.top = ids, queries, top
        #: The score that a candidate must reach; ties may still win by their id.
        self.floor = floor.copy()
        self.best = np.full((len(ids), top), _LEAST)
        self.best_id = np.zeros((len(ids), top), np.int64)
        self.exact = 0

    def add(self, ids: np.ndarray, block: Rotated) -> None:
        for low in range(0, len(self.ids), QUERIES):
            some = np.arange(low, min(low + QUERIES, len(self.ids)))
            reach = self.q.length[some] * block.length[0]
            some = some[reach * (1 + MARGIN) + 1 >= self.floor[some]]
            if len(some):
                self._add(some, ids, block)

    def _add(self, some: np.ndarray, ids: np.ndarray, block: Rotated) -> None:
        floor = self.floor[some].astype(float)
        slack = MARGIN * self.q.length[some] * block.length[0] + 1
        if self.q.steps:
            h = self.q.steps[0]
            bound = self.q.turned[some, :h] @ block.turned[:, :h].T + np.outer(self.q.rest[h][some], block.rest[h])
            a, b = np.nonzero(bound >= (floor - slack)[:, None])
            del bound
        if not self.q.steps or len(a) * 8 > len(some) * len(ids):
            return self._all(some, ids, block)
        for low in range(0, len(a), PAIRS):
            x, y = a[low : low + PAIRS], b[low : low + PAIRS]
            for h in self.q.steps[1:]:
                part = np.einsum("ij,ij->i", self.q.turned[some[x], :h], block.turned[y, :h]) + self.q.rest[h][some[x]] * block.rest[h][y]
                near = part >= (floor - slack)[x]
                x, y = x[near], y[near]
            score = np.einsum("ij,ij->i", self.q.x[some[x]], block.x[y])
            self.exact += len(score)
            good = (score >= self.floor[some[x]]) & (ids[y] != self.ids[some[x]])
            self._merge(some[x[good]], score[good], ids[y[good]])

    def _all(self, some: np.ndarray, ids: np.ndarray, block: Rotated) -> None:
        """Where the bounds leave much of a block, all its scores at once; doubles hold them exactly below 2**53."""
        if self.q.length[some].max() * block.length[0] < 2.0**52:
            score = (self.q.x[some].astype(float) @ block.x.T.astype(float)).astype(np.int64)
        else:
            score = self.q.x[some] @ block.x.T
        self.exact += score.size
        own = ids == self.ids[some][:, None]
        score[own] = _LEAST
        good = (score >= self.floor[some][:, None]) & ~own
        if len(ids) > self.top:
            good &= score >= np.partition(score, -self.top, axis=1)[:, -self.top :][:, :1]
        a, b = np.nonzero(good)
        self._merge(some[a], score[a, b], ids[b])

    def _merge(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(q):
            return
        touched, where = np.unique(q, return_inverse=True)
        where = np.append(where, np.repeat(np.arange(len(touched)), self.top))
        score = np.append(score, self.best[touched].ravel())
        ids = np.append(ids, self.best_id[touched].ravel())
        order = np.lexsort((ids, ~score, where))
        start = np.searchsorted(where[order], np.arange(len(touched)))
        take = order[start[:, None] + np.arange(self.top)]
        self.best[touched], self.best_id[touched] = score[take], ids[take]
        self.floor[touched] = np.maximum(self.floor[touched], self.best[touched, -1])


def search(
    vectors: DataFrame, *, top: int = TOP, every: int = EVERY, id_col: str = "vec_id", vec_col: str = "embedding", query_bytes: int = QUERY_BYTES
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` highest inner products of each query with all vectors but its own.

    Queries are the rows whose id ``every`` divides.  Entries count as floor(256 * entry).  Ties go to the smaller id.  A vector takes no part if it is null,
    if an entry is null, not finite or 131,072 or more in size (a score might pass 64 bits), or if its id is null (no result could name it).
    Shorter vectors count as filled with zeros.  Rows that repeat an id and its vector count once; different
    vectors of one id are queries and candidates of their own, but none is a candidate of its own id.  Other columns
    are not read.  An empty table gives an empty result; with few vectors queries have fewer ranks.
    """
    spark, folder = vectors.sparkSession, scratch_dir(vectors.sparkSession)
    out_kind = "query_id long, rank int, vec_id long, score long"
    rows = small_batches(vectors).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where("id IS NOT NULL")
    width = rows.agg(F.max(F.size("vec"))).first()[0]
    if width is None or width < 0:
        return spark.createDataFrame([], out_kind)
    width = max(1, width)
    _blocks(_prepared(rows, width, top + 1), width, top + 1).write.parquet(f"{folder}/blocks")
    blocks = spark.read.schema(_BLOCK_KIND).parquet(f"{folder}/blocks")
    longest = blocks.orderBy(F.desc("norm")).limit(1).collect()
    if not longest:
        return spark.createDataFrame([], out_kind)
    axes = rotation(blocks, width)
    shared = spark.sparkContext.broadcast((axes, *_unpacked(longest[0], width)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct queries in packs, with the score that the longest vectors give each."""
        turn, head_ids, head = shared.value
        head = Rotated(head, turn)
        for batch in batches:
            ids, x = batch.column("id").to_numpy(), _matrix(batch.column("vec"), width)
            for pack in _packed(ids, x, QUERIES):
                some, rows = _unpacked(pack.to_pylist()[0], width)
                first = Search(some, Rotated(rows, turn), top, np.full(len(some), _LEAST))
                first.add(head_ids, head)
                yield pack.append_column("floor", pa.array([first.floor.astype("<i8").tobytes()], pa.binary()))

    asked = _prepared(rows.where(F.col("id") % every == 0), width, 1 << 30).select("id", "vec").distinct()
    asked.mapInArrow(freed(ask), _BLOCK_KIND + ", floor binary").write.parquet(f"{folder}/queries")
    queries = spark.read.parquet(f"{folder}/queries")

    def look(batches: Iterator[pa.RecordBatch], held) -> Iterator[pa.RecordBatch]:
        turn = shared.value[0]
        ids, x, floor = held.value
        found = Search(ids, Rotated(x, turn), top, floor)
        for batch in batches:
            for row in batch.to_pylist():
                names, vecs = _unpacked(row, width)
                found.add(names, Rotated(vecs, turn))
        q, k = np.nonzero(found.best > _LEAST)
        columns = [q.astype(np.int64), ids[q], found.best_id[q, k], found.best[q, k]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["q", "query_id", "vec_id", "score"])

    kind = "q long, query_id long, vec_id long, score long"
    number, held, size = 0, [], 0

    def one_pass() -> None:
        nonlocal number, held, size
        ids, x = (np.concatenate(c) for c in zip(*(_unpacked(r, width) for r in held)))
        block = spark.sparkContext.broadcast((ids, x, np.concatenate([np.frombuffer(r["floor"], "<i8") for r in held])))
        found = blocks.mapInArrow(freed(lambda b: look(b, block)), kind)
        found.withColumn("q", F.col("q") + F.lit(number)).write.parquet(f"{folder}/found", mode="append")
        number, held, size = number + len(ids), [], 0
        block.unpersist()

    for row in queries.toLocalIterator():
        held.append(row)
        size += len(row["vectors"])
        if size >= query_bytes:
            one_pass()
    if held:
        one_pass()
    if not number:
        return spark.createDataFrame([], out_kind)
    by = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    ranked = spark.read.schema(kind).parquet(f"{folder}/found").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")
