"""Nearest neighbours by inner product with an inverted multi-index.

Vectors are cut in two halves and each half is quantised by a codebook of its own, so that K
centroids a half make K * K cells. A query scores the centroids of both halves, and a heap
traverses centroid pairs in descending order of the summed inner products until the cells
passed hold `depth` entries; the entries are then reranked by their exact inner products.

The codebooks are fitted on a bounded sample (SAMPLE vectors, least hashes of vec_id), and so
is the depth, as a share of all entries: the least at which the sample's own queries reach the
wanted recall. Every vector is indexed. Of equal vectors only the `k` + 1 with the smallest ids
can be results, so others leave the index (exactly, by rank, before any shuffle by cell).

Cells are dealt to shards of bounded size; a shard is read into memory and the queries that
want any of its cells stream past, so no task holds more than SHARD vectors and one batch.

Cases: vectors that are null, zero, or that hold null, NaN or infinite components take no part,
neither as queries nor as candidates; vectors of different lengths meet as if the shorter ones
ended in zeros; ties go to the smaller vec_id; every row is a candidate of its own, so a
repeated vec_id can come up more than once, and each of its rows is a query; fewer candidates
than k give fewer results; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from vellum.plans.runtime import Scratch

SAMPLE, SHARD, MAX_K = 16384, 16384, 1024
#: Recall that the depth is fitted to on the sample, and the least number of entries to pass.
RECALL, LEAST_DEPTH = 0.95, 1000


def valid(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(row, vec_id, v) of the vectors that take part; row tells rows apart once this is stored."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")


def kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Centroids by Lloyd's rounds from k spread rows; an empty centroid stays where it is."""
    centroids = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(x, centroids)
        sums, counts = np.zeros_like(centroids), np.bincount(near, minlength=k)
        np.add.at(sums, near, x)
        filled = counts > 0
        centroids[filled] = sums[filled] / counts[filled, None]
    return centroids


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    half = (centroids * centroids).sum(axis=1) / 2
    return np.concatenate([(x[i : i + 8192] @ centroids.T - half).argmax(axis=1) for i in range(0, len(x), 8192)]) if len(x) else np.zeros(0, int)


def traverse(first: np.ndarray, second: np.ndarray, counts: np.ndarray, depth: int) -> list[int]:
    """Cells i * K + j in descending order of first[i] + second[j] until they hold `depth` entries.

    The heap holds one frontier pair for each row of the sorted grid that has been entered.
    """
    rows, cols = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    a, b = first[rows].tolist(), second[cols].tolist()
    i_of, j_of, k = rows.tolist(), cols.tolist(), len(rows)
    table = counts.tolist()
    heap, out, have = [(-(a[0] + b[0]), 0, 0)], [], 0
    while heap and have < depth:
        _, r, c = heap[0]
        cell = i_of[r] * k + j_of[c]
        if table[cell]:
            out.append(cell)
            have += table[cell]
        if c + 1 < k:
            heapq.heapreplace(heap, (-(a[r] + b[c + 1]), r, c + 1))
        else:
            heapq.heappop(heap)
        if c == 0 and r + 1 < k:
            heapq.heappush(heap, (-(a[r + 1] + b[0]), r + 1, 0))
    return out


def fit_depth(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], k: int, recall: float = RECALL) -> float:
    """The share of entries that must be passed for the recall, over up to 256 of the sample as queries."""
    n, half = len(x), books[0].shape[1]
    q = np.linspace(0, n - 1, min(n, 256)).astype(int)
    exact = x[q] @ x.T
    coarse = (x[q, :half] @ books[0].T)[:, nearest(x[:, :half], books[0])] + (x[q, half:] @ books[1].T)[:, nearest(x[:, half:], books[1])]
    exact[np.arange(len(q)), q] = coarse[np.arange(len(q)), q] = -np.inf
    top = np.argsort(-exact, axis=1)[:, : min(k, n - 1)]
    place = np.argsort(np.argsort(-coarse, axis=1), axis=1)
    found = np.sort(np.take_along_axis(place, top, axis=1).ravel())
    return (found[min(len(found) - 1, int(np.ceil(recall * len(found))))] + 1) / n if len(found) else 1.0


HITS = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("query_row", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])


def search(vectors: DataFrame, scratch: Scratch, every: int = 20, k: int = 20, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose vec_id is divisible by `every`."""
    rows = scratch.save(valid(vectors), "vectors")
    kept = rows.withColumn("r", F.row_number().over(W.partitionBy("v").orderBy("vec_id", "row"))).where(F.col("r") <= k + 1).drop("r")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    spark = vectors.sparkSession
    if not sample.num_rows:
        scratch.drop(rows)
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n, dim = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    x = padded(sample["v"].combine_chunks(), dim)
    half = (dim + 1) // 2
    size = int(min(MAX_K, len(x), 2 ** max(2, round(np.log2(np.sqrt(n) / 4)))))
    books = kmeans(x[:, :half], size), kmeans(x[:, half:], size)
    share = fit_depth(x, books, k, recall)
    shared = spark.sparkContext.broadcast(books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = padded(batch.column(2), dim)
                cell = nearest(m[:, :half], shared.value[0]) * size + nearest(m[:, half:], shared.value[1])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64())], names=["row", "vec_id", "v", "cell"])

    index = scratch.save(kept.mapInArrow(encode, "row long, vec_id long, v array<double>, cell long"), "index")
    # At most MAX_K ** 2 counts whatever the number of vectors.
    table = index.groupBy("cell").count().toArrow()
    counts = np.zeros(size * size, np.int64)
    counts[np.asarray(table["cell"])] = np.asarray(table["count"])
    depth = max(LEAST_DEPTH, int(np.ceil(share * counts.sum())))
    # Cells in order fill shards; a cell of more than a shard is dealt to several by id.
    parts = np.maximum(1, -(-counts // SHARD))
    shard_of = np.cumsum(np.maximum(counts, 1)) // SHARD
    plan = spark.sparkContext.broadcast((counts, shard_of, parts))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, shards, split = plan.value
        for batch in batches:
            cell = np.asarray(batch.column(3))
            part = np.asarray(batch.column(0)) // 7 % split[cell]
            alone = pa.ListArray.from_arrays(pa.array(np.arange(len(cell) + 1, dtype=np.int32)), pa.array(cell))
            yield _rows(shards[cell], part, np.zeros(len(cell), bool), batch.column(0), batch.column(1), batch.column(2), alone)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shards, split = plan.value
        for batch in batches:
            rows_, ids, m = batch.column(0).to_pylist(), batch.column(1).to_pylist(), padded(batch.column(2), dim)
            first, second = m[:, :half] @ shared.value[0].T, m[:, half:] @ shared.value[1].T
            where, part, qrow, qid, at, cells = [], [], [], [], [], []
            for i in range(len(ids)):
                found = np.sort(np.array(traverse(first[i], second[i], held, depth), np.int64))
                for own in np.split(found, np.flatnonzero(np.diff(shards[found])) + 1):
                    for p in range(int(split[own].max())):
                        where.append(int(shards[own[0]]))
                        part.append(p)
                        qrow.append(rows_[i])
                        qid.append(ids[i])
                        at.append(i)
                        cells.append(own[split[own] > p].tolist())
            if where:
                yield _rows(np.array(where), np.array(part), np.ones(len(where), bool), pa.array(qrow, pa.int64()), pa.array(qid, pa.int64()), batch.column(2).take(pa.array(at)), pa.array(cells, pa.list_(pa.int64())))

    dealt = "shard long, part long, asks boolean, row long, id long, v array<double>, cells array<long>"
    entries = index.mapInArrow(deal, dealt)
    asked = rows.where(F.col("vec_id") % every == 0).mapInArrow(ask, dealt)
    mixed = entries.unionByName(asked).repartition("shard", "part").sortWithinPartitions("shard", "part", "asks")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, pieces, shard = None, [], None
        for batch in batches:
            place = np.asarray(batch.column(0)) << 20 | np.asarray(batch.column(1))
            asks = np.asarray(batch.column(2))
            edges = np.concatenate([[0], np.flatnonzero((np.diff(place) != 0) | (np.diff(asks.astype(int)) != 0)) + 1, [len(place)]])
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                part = batch.slice(lo, hi - lo)
                if not asks[lo]:
                    if current != place[lo]:
                        current, pieces, shard = place[lo], [], None
                    pieces.append((np.asarray(part.column(3)), np.asarray(part.column(4)), np.asarray(part.column(6).flatten()), padded(part.column(5), dim)))
                elif current == place[lo]:
                    if shard is None:
                        # Entries in order of their cells, so that a cell is a range of rows.
                        rows_, ids, cell, m = (np.concatenate(c) for c in zip(*pieces, strict=True))
                        order, pieces = np.argsort(cell, kind="stable"), []
                        shard = rows_[order], ids[order], cell[order], m[order]
                    yield _best(part, padded(part.column(5), dim), *shard, k)

    hits = mixed.mapInArrow(rerank, HITS)
    per = W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(per)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    return scratch.finish(ranked)


def padded(vectors: pa.Array, dim: int) -> np.ndarray:
    """[vector, component]; shorter vectors end in zeros, and there are two components at least."""
    sizes = np.asarray(vectors.value_lengths()).astype(np.int64)
    flat = np.asarray(vectors.flatten())
    if dim > 1 and (sizes == dim).all():
        return flat.reshape(len(vectors), dim)
    out = np.zeros((len(vectors), max(2, dim)))
    within = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(vectors)), sizes), within] = flat
    return out


def _rows(*columns) -> pa.RecordBatch:
    names = ["shard", "part", "asks", "row", "id", "v", "cells"]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def _best(part: pa.RecordBatch, q: np.ndarray, rows: np.ndarray, ids: np.ndarray, cell: np.ndarray, m: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best entries of the shard for each query among those of the cells it asks for; no other entry is read."""
    query_rows, query_ids, wanted = np.asarray(part.column(3)), np.asarray(part.column(4)), part.column(6)
    out: list[list] = [[], [], [], []]
    for r in range(len(query_ids)):
        cells = np.asarray(wanted[r].values)
        low, high = np.searchsorted(cell, cells), np.searchsorted(cell, cells, side="right")
        sizes = high - low
        at = np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        at = at[rows[at] != query_rows[r]]
        if not len(at):
            continue
        scores = m[at] @ q[r]
        if len(at) > k:
            # A little below the k-th, since sums in another order differ in the last bits.
            at = at[scores >= np.partition(scores, len(at) - k)[len(at) - k] - 1e-9 * max(1.0, float(np.abs(scores).max()))]
        exact = (m[at] * q[r]).sum(axis=1)
        best = np.lexsort((ids[at], -exact))[:k]
        out[0] += [query_ids[r]] * len(best)
        out[1] += [query_rows[r]] * len(best)
        out[2] += ids[at[best]].tolist()
        out[3] += exact[best].tolist()
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=HITS.names)
