"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation (three rounds of random signs and a fast Hadamard transform) is applied to a vector; its hash is the signed
axis nearest to the result, one of twice the dimension. Every row is indexed in ``tables`` tables, each with rotations of
its own; a bucket joins ``hashes`` hashes, so many that it holds about ``BUCKET_ROWS`` rows. A query looks into the share
``PROBES`` of each table's buckets whose axes its own rotated vector is nearest to, and what it meets is ranked by exact cosine
on the original vectors. Queries that meet fewer than ``k`` rows go through all buckets of one table, which is exact.

Scale: rows of one bucket are packed into blocks by the task that hashes them, equality joins bring blocks of rows and blocks
of queries together, and a task keeps the ``k`` best per query only, so a bucket with a third of all rows is many blocks and
no block grows with it. Number of buckets follows the number of rows at every size. Recall is set by ``tables`` and ``PROBES``;
the defaults are for vectors whose neighbours are hardly nearer than others (cosine 0.4), where narrow probes miss. Nearer
neighbours allow far fewer probes.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, nor
do rows without an id. Rows with equal ids are one candidate, and one query, at the best score. Ties go to the smaller id. With
fewer than ``k`` candidates all are returned. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import column
from foliospark.operators.shared import materialise, shuffled

TABLES, PROBES, BUCKET_ROWS, BLOCK_ROWS, HELD = 8, 1 / 8, 4096, 8192, 200_000
FOUND = "query long, id long, score double"


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, v)`` with the vectors that can take part, whatever their length."""
    v = column(vec_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(column(id_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(column(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"))


def fwht(x: np.ndarray) -> np.ndarray:
    """The Hadamard transform of each row, unit scale; the width is a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(n, -1, 2, step)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(n, width)
        step *= 2
    return x / np.sqrt(width)


def rotated(unit: np.ndarray, table: int, part: int, seed: int) -> np.ndarray:
    n, d = unit.shape
    width = 1 << max(0, (d - 1).bit_length())
    x = np.zeros((n, width))
    x[:, :d] = unit
    signs = np.random.default_rng([seed, table, part]).choice([-1.0, 1.0], size=(3, width))
    for s in signs:
        x = fwht(x * s)
    return x


def buckets(unit: np.ndarray, table: int, hashes: int, seed: int) -> np.ndarray:
    """The bucket of each row in one table."""
    code = np.zeros(len(unit), np.int64)
    for part in range(hashes):
        x = rotated(unit, table, part, seed)
        axis = np.argmax(abs(x), axis=1)
        code = code * 2 * x.shape[1] + 2 * axis + (x[np.arange(len(x)), axis] < 0)
    return code


def probes(unit: np.ndarray, table: int, hashes: int, seed: int, share: float) -> np.ndarray:
    """For each row the buckets nearest to it, by the sum of its components along their axes."""
    code, score = np.zeros((len(unit), 1), np.int64), np.zeros((len(unit), 1))
    for part in range(hashes):
        x = rotated(unit, table, part, seed)
        along = np.stack((x, -x), axis=2).reshape(len(x), -1)
        score = (score[:, :, None] + along[:, None, :]).reshape(len(x), -1)
        code = (code[:, :, None] * along.shape[1] + np.arange(along.shape[1])).reshape(len(x), -1)
        most = max(1, ceil(share * along.shape[1] ** (part + 1)))
        if part < hashes - 1:
            most = min(score.shape[1], 4 * most)
        if most < score.shape[1]:
            best = np.argpartition(-score, most - 1, axis=1)[:, :most]
            score, code = np.take_along_axis(score, best, 1), np.take_along_axis(code, best, 1)
    return code


def _units(batch: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors scaled by a power of two (which is exact), and unit vectors."""
    ids = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
    x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    x = np.ldexp(x, -np.frexp(abs(x).max(axis=1))[1][:, None])
    return ids, x, x / np.sqrt((x * x).sum(axis=1))[:, None]


def _blocks(rows: DataFrame, d: int, tables: int, places) -> DataFrame:
    """``(t, bucket, ids, vecs)``: the rows of a batch that fall into a bucket, packed; ``places`` gives each row's buckets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x, unit = _units(batch, d)
            for t in range(tables):
                at = places(unit, t)
                row = np.repeat(np.arange(len(ids)), at.shape[1])
                order = np.argsort(at.ravel(), kind="stable")
                code, row = at.ravel()[order], row[order]
                starts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
                parts = np.split(row, starts[1:])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(starts), t, np.int32)), pa.array(code[starts]), pa.array([ids[p].tobytes() for p in parts], pa.binary()),
                     pa.array([x[p].tobytes() for p in parts], pa.binary())], ["t", "bucket", "ids", "vecs"])

    return rows.mapInArrow(run, "t int, bucket long, ids binary, vecs binary")


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the ``k`` best different ids of their query; ties to the smaller id."""
    order = np.lexsort((-score, ids, query))
    q, i = query[order], ids[order]
    order = order[np.append(True, (q[1:] != q[:-1]) | (i[1:] != i[:-1]))] if len(order) else order
    order = order[np.lexsort((ids[order], -score[order], query[order]))]
    q = query[order]
    begins = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(begins, np.diff(np.append(begins, len(q))))
    return order[rank < k]


def _scored(met: DataFrame, d: int, k: int) -> DataFrame:
    """The ``k`` nearest rows of each query among all blocks that a task meets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def merged() -> tuple[np.ndarray, ...]:
            query, ids, score = (np.concatenate(c) for c in zip(*held))
            keep = _best(query, ids, score, k)
            return query[keep], ids[keep], score[keep]

        for batch in batches:
            for ids, vecs, query_ids, query_vecs in zip(*[c.to_pylist() for c in batch.columns]):
                i, q = np.frombuffer(ids, "<i8"), np.frombuffer(query_ids, "<i8")
                x, y = np.frombuffer(vecs).reshape(-1, d), np.frombuffer(query_vecs).reshape(-1, d)
                nx, ny = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
                near = (y / ny[:, None]) @ (x / nx[:, None]).T
                near[q[:, None] == i] = -np.inf
                by_id = np.argsort(i, kind="stable")
                first = np.flatnonzero(np.append(True, np.diff(i[by_id]) != 0))
                once = np.maximum.reduceat(near[:, by_id], first, axis=1) if len(first) < len(i) else near  # an id counts once
                least = -np.partition(-once, k - 1, axis=1)[:, k - 1] if once.shape[1] > k else np.full(len(q), -2.0)
                r, c = np.nonzero(near >= np.maximum(least, -2.0)[:, None] - 1e-9)
                score = (y[r] * x[c]).sum(1) / (ny[r] * nx[c])  # the same sum for a pair wherever it meets
                held.append((q[r], i[c], score))
            if sum(len(h[0]) for h in held) > HELD:
                held = [merged()]
                if len(held[0][0]) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in held.pop()], ["query", "id", "score"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in merged()], ["query", "id", "score"])

    return met.mapInArrow(run, FOUND)


def _search(base: DataFrame, asked: DataFrame, d: int, k: int, n: int, tables: int, share: float, seed: int) -> DataFrame:
    width = 2 << max(0, (d - 1).bit_length())
    hashes = max(1, round(log(max(1, n) / BUCKET_ROWS) / log(max(2, width))))
    index = _blocks(base.repartition(n // BLOCK_ROWS + 1), d, tables, lambda unit, t: buckets(unit, t, hashes, seed)[:, None])
    looked = _blocks(asked.repartition(n // (50 * BLOCK_ROWS) + 1), d, tables, lambda unit, t: probes(unit, t, hashes, seed, share))
    looked = looked.select("t", "bucket", F.col("ids").alias("query_ids"), F.col("vecs").alias("query_vecs"))
    met = shuffled(index).join(shuffled(looked), ["t", "bucket"]).select("ids", "vecs", "query_ids", "query_vecs")
    best = _scored(met, d, k).groupBy("query", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(base: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
            tables: int = TABLES, share: float = PROBES, seed: int = 42) -> DataFrame:
    """``(query, rank, id, score)``: each query's ``k`` nearest rows of ``base`` but itself, by cosine."""
    rows, asked = usable(base, id_col, vec_col), usable(queries, id_col, vec_col)
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d, n = (common["d"], common["count"]) if common else (1, 0)
    rows, asked = rows.where(F.size("v") == d), asked.where(F.size("v") == d)
    found = materialise(_search(rows, asked, d, k, n, tables, share, seed))
    enough = found.groupBy("query").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    few = materialise(asked.join(enough, F.col("id") == F.col("query"), "left_anti"))
    if not few.isEmpty():
        rest = _search(rows, few, d, k, n, 1, 1.0, seed)
        found = found.join(enough, "query", "left_semi").unionByName(rest)
    return found.select("query", "rank", "id", "score")
