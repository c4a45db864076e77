"""Exact top-k by inner product through distributed histogram selection.

Queries are taken in blocks of a fixed size. For each block every vector is scored, and each task reports, per query, the
histogram of its scores over the range still in question; the sums tell which bin holds the kth best score, and the range
shrinks to that bin until it is one score wide. A last pass keeps the scores from there on, ties in the order of ids.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .common import quoted

QUERY_BLOCK, BINS = 4096, 1024
LONG = 2**63 - 1


def _scores(queries: np.ndarray, vectors: np.ndarray, safe: bool) -> np.ndarray:
    """Inner products as int64. Beyond 2**53 exact Python integers, held within the range of a long."""
    if safe:
        return np.rint(queries @ vectors.T).astype(np.int64)
    exact = queries.astype(object) @ vectors.astype(object).T
    return np.array([[max(-LONG, min(LONG, int(v))) for v in row] for row in exact], np.int64).reshape(len(queries), len(vectors))


def top_k(
    vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0, id_column: str = "vec_id", vector_column: str = "embedding",
    rows_in_task: int = 2048,
) -> DataFrame:
    """The k best vectors of each query by the inner product of floor(scale * component): query_id, rank, vec_id, score.

    is_query: a condition on the id. A query does not meet its own id. Vectors that are null, hold a null or non-finite
    component, or have a null id take no part; vectors of another length do not meet, empty ones score 0 with each other. Equal scores rank by id, and rows that
    repeat an id are one candidate each. Fewer candidates than k: all are returned. Scores beyond a long stop at its ends.
    """
    spark = vectors.sparkSession
    given = vectors.select(quoted(id_column).cast("long").alias("id"), F.transform(quoted(vector_column), lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double")).alias("v"), quoted(vector_column).alias("raw"))
    ok = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    used = stored(given.filter(F.col("id").isNotNull() & F.col("raw").isNotNull() & ok).select("id", "v", F.size("v").alias("dim")), "topk")
    rows = used.count()
    dealt = stored(used.repartition(max(1, math.ceil(rows / rows_in_task))), "topk-dealt")
    numbered = stored(used.filter(is_query(F.col("id"))).withColumn("n", F.monotonically_increasing_id()), "topk-queries")
    blocks = [tuple(r) for r in numbered.select("dim", F.spark_partition_id().alias("p"), F.col("n").alias("n")).groupBy("dim").agg(F.count("*")).collect()]
    out = None
    for dim, count in sorted(blocks):
        mine, parts = numbered.filter(F.col("dim") == dim), max(1, math.ceil(count / QUERY_BLOCK * 1.2))
        for part in range(parts):
            block = mine.filter(F.pmod(F.xxhash64("n"), F.lit(parts)) == part).orderBy("id", "n").select("id", "v").toArrow()
            if block.num_rows:
                found = _block(dealt.filter(F.col("dim") == dim), block, k, scale)
                out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return out


def _matrix(column, dim: int) -> np.ndarray:
    if dim == 0:  # empty vectors meet each other, with product 0
        return np.zeros((len(column), 0))
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def _block(candidates: DataFrame, block: pa.Table, k: int, scale: float) -> DataFrame:
    """All of it for one block of at most about QUERY_BLOCK queries, which every task holds."""
    spark = candidates.sparkSession
    dim = len(block.column("v")[0])
    ids = block.column("id").to_numpy()
    queries = _matrix(block.column("v"), dim)
    peak = candidates.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 0.0
    bound = float(np.abs(queries).sum(1).max(initial=0.0)) * peak
    safe = bound < 2**53
    held = spark.sparkContext.broadcast((ids, queries))
    low, high = np.full(len(ids), -min(bound, LONG), object), np.full(len(ids), min(bound, LONG), object)
    low, high = np.array([int(x) for x in low], np.int64), np.array([int(x) for x in high], np.int64)
    above = np.zeros(len(ids), np.int64)  # candidates known to lie above the range
    while True:
        width = np.array([max(1, -(-(int(h) - int(lo) + 1) // BINS)) for lo, h in zip(low, high, strict=True)], object)
        width = np.array([min(w, LONG) for w in width], np.int64)
        open_ = np.flatnonzero(high > low)
        if not len(open_):
            break
        ranges_ = spark.sparkContext.broadcast((low, high, width, open_, k - above))

        def histogram(batches):
            own, q = held.value
            lo, hi, w, live, want = ranges_.value
            counts = np.zeros((len(live), BINS), np.int64)
            for b in batches:
                vec, v = b.column("id").to_numpy(), _matrix(b.column("v"), dim)
                for at in range(0, len(vec), 1024):
                    s = _scores(q[live], v[at : at + 1024], safe)
                    inside = (s >= lo[live, None]) & (s <= hi[live, None]) & (own[live, None] != vec[None, at : at + 1024])
                    row, col = np.nonzero(inside)
                    bins = ((s[row, col] - lo[live][row]) // w[live][row]).astype(np.int64)
                    counts += np.bincount(row * BINS + bins, minlength=counts.size).reshape(counts.shape)
            over = counts[:, ::-1].cumsum(1)[:, ::-1] - counts  # only bins that can hold one of the best count
            row, col = np.nonzero((counts > 0) & (over < want[live][:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(live[row]), pa.array(col), pa.array(counts[row, col])], names=["q", "bin", "n"])

        summed = candidates.select("id", "v").mapInArrow(histogram, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        # Per query no more bins come to the driver than can still hold the kth score.
        best = Window.partitionBy("q").orderBy(F.desc("bin"))
        rows = summed.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k).select("q", "bin", "n").toArrow().to_pylist()
        found: dict[int, list] = {}
        for r in rows:
            found.setdefault(r["q"], []).append((r["bin"], r["n"]))
        for q in open_.tolist():
            need, at = int(k - above[q]), None
            for b, n in sorted(found.get(q, []), reverse=True):
                at = b
                if n >= need:
                    break
                need -= n
            else:  # fewer than k candidates in all: everything counts
                high[q] = low[q]
                continue
            above[q] = k - need
            low[q] += at * int(width[q])
            high[q] = min(int(high[q]), int(low[q]) + int(width[q]) - 1)
        ranges_.unpersist()
    floor_ = spark.sparkContext.broadcast(low)

    def select(batches):
        own, q = held.value
        least = floor_.value
        kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        for b in batches:
            vec, v = b.column("id").to_numpy(), _matrix(b.column("v"), dim)
            for at in range(0, len(vec), 1024):
                s = _scores(q, v[at : at + 1024], safe)
                row, col = np.nonzero((s >= least[:, None]) & (own[:, None] != vec[None, at : at + 1024]))
                kept = _best(*(np.concatenate(x) for x in zip(kept, (row, vec[at + col], s[row, col]), strict=True)), k)
        yield pa.RecordBatch.from_arrays([pa.array(own[kept[0]]), pa.array(kept[0]), pa.array(kept[1]), pa.array(kept[2])], names=["query_id", "q", "vec_id", "score"])

    picked = candidates.select("id", "v").mapInArrow(select, "query_id long, q long, vec_id long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return picked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _best(row: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row; a task needs no more, whatever the number of ties."""
    order = np.lexsort((vec, -score, row))
    row, vec, score = row[order], vec[order], score[order]
    first = np.searchsorted(row, row)
    some = np.arange(len(row)) - first < k
    return row[some], vec[some], score[some]
