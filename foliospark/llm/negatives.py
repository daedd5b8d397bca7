"""Hard negatives by a secondary sort.

Every anchor has windows: each of its first ``positives`` rows of the same label opens one, from its own score down to a share
of it, and the first ``negatives`` rows of other labels inside it are the negatives of that pair. Scores are exact inner
products of whole numbers, ``floor(scale * component)``; higher ones come first, ties go to the smaller id.

Anchors and rows are packed into blocks. Rows are dealt into slices, every block of anchors is sent to each slice, and a task
works out the scores of whole blocks as matrix products. In the first pass it keeps the best rows of an anchor's label, which
gives the windows; in the second the best others inside each window. So a pair reaches the shuffle only if it is among the
first of its slice. What does is keyed by (anchor, descending score, positive first, id), repartitioned by anchor and sorted
within partitions, and one iterator reads the sorted rows: a positive opens a window, a negative goes to every open window it
lies in. It holds an anchor's few windows and never its rows.

Scale: scores of all anchors against all rows are the definition. Slices grow with the root of the rows, so a slice's rows
and the copies of an anchor both do; no task, hot label or crowd of copies holds more than a slice and bounded best lists.

Defined cases: rows without id, label or vector, with a null or non-finite component or one of 2^31 or more after scaling,
or of another length than most take no part. Rows that agree in id and score are one row to an anchor; rows that agree
in the anchor's id are never its partners. Anchors that agree in id, label and vector are one, others with the same id
each have results. Windows of negative scores are empty. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import column
from foliospark.operators.shared import materialise

SCALE, POSITIVES, NEGATIVES, SHARE = 256, 5, 5, 80
BLOCK_ROWS, BLOCK_ANCHORS, SLICE_ROOT, HELD = 4096, 256, 256, 200_000
FOUND = "no long, anchor_id long, score long, id long"
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
KEY = "no", "down", "kind", "id"


def usable(rows: DataFrame, id_col: str, label_col: str, vec_col: str, scale: int) -> DataFrame:
    """``(id, label, q)`` of the rows that can take part, whatever their length."""
    v = column(vec_col)
    scaled = lambda c: F.floor(c.cast("double") * scale)
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) < 2.0**31))
    known = column(id_col).isNotNull() & column(label_col).isNotNull() & F.coalesce(fine & (F.size(v) > 0), F.lit(False))
    return rows.where(known).select(column(id_col).cast("long").alias("id"), column(label_col).cast("long").alias("label"), F.transform(v, scaled).alias("q"))


def _packed(rows: DataFrame, numbers: list[str], d: int, size: int) -> DataFrame:
    """Blocks of ``size`` rows: the number columns and ``q`` each as bytes, ``q`` as narrow as its values allow."""
    def block(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        *cols, q = (np.concatenate(p) for p in zip(*parts))
        kind = "<i2" if abs(q).max() < 1 << 15 else "<i8"
        return pa.RecordBatch.from_arrays([pa.array([c.astype("<i8").tobytes()], pa.binary()) for c in cols] + [pa.array([q.astype(kind).tobytes()], pa.binary())], [*numbers, "q"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, size):
                part = batch.slice(i, size)
                cols = [part.column(j).to_numpy(zero_copy_only=False) for j in range(len(numbers))]
                held.append([*cols, part.column(len(numbers)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)])
                n += part.num_rows
                if n >= size:
                    yield block(held)
                    held, n = [], 0
        if held:
            yield block(held)

    return rows.select(*numbers, "q").mapInArrow(run, ", ".join(f"{c} binary" for c in [*numbers, "q"]))


def _numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8")


def _vectors(data: bytes, n: int, d: int) -> np.ndarray:
    return np.frombuffer(data, "<i2" if len(data) == 2 * n * d else "<i8").reshape(n, d)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of two blocks of whole numbers."""
    most = int(abs(a).max()) * int(abs(b).max()) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most < 1 << 63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which entries are the first ``k`` of their group by falling score, then id; entries that agree in all three are one."""
    order = np.lexsort((ids, ~score, group))
    g, s, i = group[order], score[order], ids[order]
    new = np.append(True, (g[1:] != g[:-1]) | (s[1:] != s[:-1]) | (i[1:] != i[:-1])) if len(g) else np.zeros(0, bool)
    order, g = order[new], g[new]
    begins = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, int)
    rank = np.arange(len(g)) - np.repeat(begins, np.diff(np.append(begins, len(g))))
    return order[rank < k]


Picked = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _best(met: DataFrame, d: int, k: int, picks: Callable[[dict, np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[int, np.ndarray, np.ndarray]]]) -> DataFrame:
    """For each anchor and window the first ``k`` of the pairs that ``picks`` names, among all blocks a task meets."""
    names = met.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Picked] = []

        def merged() -> Picked:
            no, window, anchor, score, ids = (np.concatenate(c) for c in zip(*held))
            keep = first(no * 64 + window, score, ids, k)
            return no[keep], window[keep], anchor[keep], score[keep], ids[keep]

        def batch_of(part: Picked) -> pa.RecordBatch:
            no, _, anchor, score, ids = part
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (no, anchor, score, ids)], ["no", "anchor_id", "score", "id"])

        for batch in batches:
            for row in batch.to_pylist():
                own = {c: _numbers(row[c]) for c in names if c not in ("q", "anchor_q")}
                score = _scores(_vectors(row["anchor_q"], len(own["no"]), d), _vectors(row["q"], len(own["id"]), d))
                alike = own["anchor_label"][:, None] == own["label"][None, :]
                other = own["anchor_id"][:, None] != own["id"][None, :]
                for window, r, c in picks(own, score, alike, other):
                    s, ids = score[r, c], own["id"][c]
                    keep = first(r, s, ids, k)
                    r = r[keep]
                    held.append((own["no"][r], np.full(len(r), window), own["anchor_id"][r], s[keep], ids[keep]))
                if sum(len(h[0]) for h in held) > HELD:
                    held = [merged()]
                    if len(held[0][0]) > HELD // 2:
                        yield batch_of(held.pop())
        if held:
            yield batch_of(merged())

    return met.mapInArrow(run, FOUND)


def _windows(sorted_rows: DataFrame, positives: int, negatives: int, share: int) -> DataFrame:
    """Read rows in the order of their keys; windows of one anchor are all that is held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, windows, seen = None, [], None
        for batch in batches:
            out: list[tuple] = []
            for no, down, kind, i, anchor_id in zip(*[c.to_pylist() for c in batch.columns]):
                score = ~down
                if no != anchor:
                    anchor, windows, seen = no, [], None
                if (score, kind, i) == seen:
                    continue
                seen = score, kind, i
                if kind == 0:
                    if len(windows) < positives:
                        windows.append([i, score, 0])
                    continue
                for w in windows:
                    if w[2] < negatives and share * w[1] <= 100 * score <= 100 * w[1]:
                        w[2] += 1
                        out.append((anchor_id, w[0], w[2], i, w[1], score))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [x.split()[0] for x in OUT.split(", ")])

    return sorted_rows.mapInArrow(run, OUT)


def mine(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding",
         scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, share: int = SHARE) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows that ``is_anchor`` holds for.

    A window reaches from a positive's score down to ``share`` hundredths of it.
    """
    all_rows = usable(rows, id_col, label_col, vec_col, scale)
    common = all_rows.groupBy(F.size("q").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d, n = (common["d"], common["count"]) if common else (1, 0)
    slices = isqrt(n // SLICE_ROOT) + 1
    blocks = _packed(all_rows.where(F.size("q") == d), ["id", "label"], d, BLOCK_ROWS)
    blocks = materialise(blocks.withColumn("slice", F.pmod(F.xxhash64("id", "q"), F.lit(slices)).cast("int")))
    asked = usable(rows.where(is_anchor), id_col, label_col, vec_col, scale).where(F.size("q") == d).distinct()
    asked = materialise(asked.select(F.monotonically_increasing_id().alias("no"), F.col("id").alias("anchor_id"), F.col("label").alias("anchor_label"), "q"))

    def met(anchors: DataFrame, numbers: list[str]) -> DataFrame:
        packed = _packed(anchors, numbers, d, BLOCK_ANCHORS).withColumnRenamed("q", "anchor_q")
        each = packed.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        return blocks.join(each, "slice").drop("slice")

    def same(own: dict, score: np.ndarray, alike: np.ndarray, other: np.ndarray):
        yield 0, *np.nonzero(alike & other)

    order = Window.partitionBy("no").orderBy(F.desc("score"), "id")
    near = _best(met(asked, ["no", "anchor_id", "anchor_label"]), d, positives, same).distinct()
    near = materialise(near.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= positives))

    tops = [F.max(F.when(F.col("_r") == i + 1, F.col("score"))).alias(f"top{i}") for i in range(positives)]
    names = [f"top{i}" for i in range(positives)]
    opened = near.groupBy("no").agg(*tops)  # a missing window is a negative one, which is empty
    opened = opened.select("no", *[F.coalesce(c, F.lit(-1).cast("long")).alias(c) for c in names])

    def others(own: dict, score: np.ndarray, alike: np.ndarray, other: np.ndarray):
        apart = ~alike & other
        for i, name in enumerate(names):
            top = own[name][:, None]
            yield i, *np.nonzero(apart & (top >= 0) & (score <= top) & (100 * score >= share * top))

    far = _best(met(asked.join(opened, "no"), ["no", "anchor_id", "anchor_label", *names]), d, negatives, others)
    keyed = lambda df, kind: df.select("no", F.bitwise_not("score").alias("down"), F.lit(kind).alias("kind"), "id", "anchor_id")
    pairs = keyed(near, 0).unionByName(keyed(far, 1))
    return _windows(pairs.repartition("no").sortWithinPartitions(*KEY), positives, negatives, share)
