"""Exact top-k inner products by pivot-table elimination.

Distances from every vector to many pivots are computed once.  By the triangle inequality the largest
difference between a query's and a candidate's distances bounds their distance from below, and with
the norms that bounds the inner product from above.  A query evaluates candidates in the order of
their bounds and stops when the next bound is below its k-th score: results are exact.

Queries and candidates meet in blocks, some thousand by some thousand; a task holds two blocks.  Each
gives k rows a query, and the k best of those are the result, ties to the smaller id.

Vectors that are null, empty, or hold null or non-finite components take no part.  Only vectors of
one length are compared.  Rows that share an id are separate candidates and queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .work import stash

PIVOTS, SCALE = 32, 256
QUERY_BLOCK, ROW_BLOCK, FIRST, STEP = 1024, 4096, 128, 512


def _whole(rows: DataFrame, vector: str) -> DataFrame:
    """Vectors of whole numbers: floor(SCALE * x)."""
    fine = F.col(vector).isNotNull() & (F.size(vector) > 0)
    number = lambda x: x.cast("double")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(number(x)) & (F.abs(number(x)) < float("inf")))
    return rows.filter(fine).filter(F.coalesce(finite, F.lit(False))).withColumn("v", F.transform(vector, lambda x: F.floor(number(x) * SCALE)))


def _table(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """The pivot table: each row's vector and distances to the pivots of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column("v"):
                v = value.values.to_numpy(zero_copy_only=False).astype(np.int64)
                gap = pivots[len(v)] - v.astype(np.float64)
                out.append((v.tobytes(), np.sqrt((gap * gap).sum(axis=1)).tobytes()))
            columns = list(zip(*out, strict=True)) or [(), ()]
            yield pa.record_batch([batch.column("row"), batch.column("vec_id"), pa.array([len(v) // 8 for v in columns[0]], pa.int32()), pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.binary())], names=["row", "vec_id", "dim", "v", "far"])

    return rows.select("row", "vec_id", "v").mapInArrow(run, "row long, vec_id long, dim int, v binary, far binary")


def best_of(queries: tuple, rows: tuple, k: int) -> Iterator[tuple[int, int, int, int]]:
    """(query row, query id, id, score): the k best of a block for each query.  Each side: row, id, vectors, distances.

    The FIRST candidates by bound give a k-th score; of the others only those whose bound reaches it
    are ordered, and evaluated until the next bound is below the k-th score so far.
    """
    qrow, qid, q, qfar = queries
    row, own, x, far = rows
    # Products of whole numbers are exact in double precision below 2 ** 53.
    exact = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1] < 2.0**53
    x, q = (x.astype(np.float64), q.astype(np.float64)) if exact else (x, q)
    norm = (x.astype(np.float64) ** 2).sum(axis=1)
    table = np.ascontiguousarray(far.T)
    farthest = table.max(axis=0, initial=0)
    for i in range(len(qrow)):
        least = np.abs(table - qfar[i][:, None]).max(axis=0)
        qnorm = float((q[i].astype(np.float64) ** 2).sum())
        # Distances are off by at most a few units in the last place of the larger one: never below the true score.
        least = np.maximum(least - 1e-12 * (farthest + qfar[i].max(initial=0)), 0)
        bound = (qnorm + norm - least * least) / 2
        bound += 1e-12 * (qnorm + norm) + 1
        bound[row == qrow[i]] = -np.inf
        best_score, best_id = np.zeros(0, np.int64), np.zeros(0, np.int64)
        some = np.argpartition(-bound, FIRST)[:FIRST] if len(bound) > FIRST else np.arange(len(bound))
        some = some[bound[some] > -np.inf]
        rest = None
        while len(some):
            score = np.rint(x[some] @ q[i]).astype(np.int64) if exact else x[some] @ q[i]
            near = score >= best_score[-1] if len(best_score) == k else slice(None)
            score, ids = np.r_[best_score, score[near]], np.r_[best_id, own[some][near]]
            order = np.lexsort((ids, -score))[:k]
            best_score, best_id = score[order], ids[order]
            enough = best_score[-1] if len(best_score) == k else -np.inf
            if rest is None:
                left = bound >= enough
                left[some] = False
                rest = np.flatnonzero(left & (bound > -np.inf))
                rest = rest[np.argsort(-bound[rest], kind="stable")]
            some, rest = rest[:STEP], rest[STEP:]
            if len(some) and bound[some[0]] < enough:
                break
        for score, vec_id in zip(best_score.tolist(), best_id.tolist(), strict=True):
            yield int(qrow[i]), int(qid[i]), vec_id, score


def top_k(rows: DataFrame, is_query, k: int = 5, vector: str = "embedding", pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each row where ``is_query`` holds."""
    whole = _whole(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("__v")), "__v")
    whole = stash(whole.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"))
    # Pivots: by hash, as many for each length of vector.
    order = Window.partitionBy(F.size("v")).orderBy(F.xxhash64("row"), "row")
    chosen = whole.select("v", F.row_number().over(order).alias("n")).filter(F.col("n") <= pivots).select("v").collect()
    by_length: dict[int, list] = {}
    for r in chosen:
        by_length.setdefault(len(r.v), []).append(r.v)
    table = stash(_table(whole, {n: np.array(v, np.float64) for n, v in by_length.items()}))
    n_rows, n_queries = table.agg(F.count("*"), F.count_if(is_query)).first()
    row_blocks, query_blocks = max(1, -(-n_rows // ROW_BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))
    h = F.xxhash64("row")
    asks = table.filter(is_query).withColumns({"q": F.pmod(h, F.lit(query_blocks)), "asks": F.lit(True)}).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
    held = table.withColumns({"r": F.pmod(h, F.lit(row_blocks)), "asks": F.lit(False)}).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    columns = ["dim", "q", "r", "asks", "row", "vec_id", "v", "far"]
    dealt = asks.select(*columns).unionByName(held.select(*columns)).withColumns({c: F.col(c).cast("long") for c in ("q", "r")})
    dealt = dealt.repartition("dim", "q", "r").sortWithinPartitions("dim", "q", "r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides = None, ([], [])

        def done() -> pa.RecordBatch:
            found: list[tuple] = []
            if sides[0] and sides[1]:
                arrays = []
                for side in sides:
                    row, vec_id, v, far = zip(*side, strict=True)
                    own = [x if x is not None else -(1 << 63) for x in vec_id]
                    arrays.append((np.array(row), np.array(own), np.frombuffer(b"".join(v), np.int64).reshape(len(row), -1), np.frombuffer(b"".join(far)).reshape(len(row), -1)))
                found = list(best_of(*arrays, k))
            parts = list(zip(*found, strict=True)) or [()] * 4
            return pa.record_batch([pa.array(p, pa.int64()) for p in parts], names=["row", "query_id", "vec_id", "score"])

        for batch in batches:
            for dim, q, r, asks, *rest in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if (dim, q, r) != key:
                    yield done()
                    key, sides = (dim, q, r), ([], [])
                sides[0 if asks else 1].append(rest)
        yield done()

    found = dealt.mapInArrow(run, "row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    out = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("vec_id") > -(1 << 63), F.col("vec_id")).alias("vec_id"), "score")


def op10_top_k(spark, sf_dir: str) -> DataFrame:
    """The 5 best vectors for every vector whose id is divisible by 50."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
