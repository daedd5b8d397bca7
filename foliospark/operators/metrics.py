"""Clustering and classification metrics, from contingency and confusion counts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from foliospark.functions.vectors import argmax
from foliospark.operators.shared import materialise, running, small_side

TILE_ROWS = 2048
CLUSTER_BLOCK = 4096


def _safe(top: Column, bottom: Column, otherwise: Column | None = None) -> Column:
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(None).cast("double") if otherwise is None else otherwise)


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def partition_agreement(df: DataFrame, truth: str, cluster: str) -> DataFrame:
    """One row with ``ari`` and ``nmi`` (arithmetic-mean normaliser).

    The contingency cells are cubed, so cells, both margins and the total come from one pass.
    """
    cells = contingency(df, truth, cluster)
    levels = cells.cube("a", "b").agg(F.sum("n").cast("double").alias("n"), F.grouping_id().alias("g"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    plogp = F.col("n") * F.ln("n")

    def over(level: int, value: Column) -> Column:
        return F.sum(F.when(F.col("g") == level, value))

    def entropy(level: int) -> Column:
        return F.ln("total") - F.col(f"plogp{level}") / F.col("total")

    sums = levels.agg(
        over(3, F.col("n")).alias("total"),
        *[over(g, pairs).alias(f"pairs{g}") for g in (0, 1, 2, 3)],
        *[over(g, plogp).alias(f"plogp{g}") for g in (0, 1, 2)],
        *[F.count_if(F.col("g") == g).alias(f"groups{g}") for g in (0, 1, 2)],
    )
    expected = F.col("pairs1") * F.col("pairs2") / F.col("pairs3")
    half = (F.col("pairs1") + F.col("pairs2")) / 2
    # identical partitions have as many cells as groups on either side
    same = (F.col("groups0") == F.col("groups1")) & (F.col("groups0") == F.col("groups2"))
    mutual = F.greatest(entropy(1) + entropy(2) - entropy(0), F.lit(0.0))
    nmi = (
        F.when((F.col("groups1") == 1) & (F.col("groups2") == 1), 1.0)
        .when((F.col("groups1") == 1) | (F.col("groups2") == 1), 0.0)
        .otherwise(2 * mutual / (entropy(1) + entropy(2)))
    )
    return sums.select(
        F.when(same, 1.0).otherwise((F.col("pairs0") - expected) / (half - expected)).alias("ari"), nmi.alias("nmi")
    )


SUMS = "id long, own long, other long, total double"


def _tile_sums(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Distance sums from each row of either block to each cluster of the other one; a block against itself gives its rows once."""
    if left.empty or right.empty:
        return pd.DataFrame({"id": [], "own": [], "other": [], "total": []}).astype(
            {"id": "int64", "own": "int64", "other": "int64", "total": "float64"}
        )
    x, y = np.stack(left["vec"]).astype(float), np.stack(right["right_vec"]).astype(float)
    square = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T
    dist = np.sqrt(np.maximum(square, 0))
    ids, clusters = left["id"].to_numpy(), left["cluster"].to_numpy()
    right_ids, right_clusters = right["right_id"].to_numpy(), right["right_cluster"].to_numpy()
    dist[ids[:, None] == right_ids[None, :]] = 0

    def to_clusters(dist: np.ndarray, ids: np.ndarray, own: np.ndarray, others: np.ndarray) -> pd.DataFrame:
        names, place = np.unique(others, return_inverse=True)
        sums = dist @ np.eye(len(names))[place]
        return pd.DataFrame({"id": np.repeat(ids, len(names)), "own": np.repeat(own, len(names)), "other": np.tile(names, len(ids)), "total": sums.ravel()})

    forth = to_clusters(dist, ids, clusters, right_clusters)
    if left["block"].iloc[0] == right["at_tile"].iloc[0]:
        return forth
    return pd.concat([forth, to_clusters(dist.T, right_ids, right_clusters, clusters)], ignore_index=True)


def silhouette_exact(df: DataFrame, cluster: str, vec: str = "embedding", id_col: str = "doc_id") -> DataFrame:
    """Mean Euclidean silhouette, one row; null with fewer than two clusters.

    The metric is quadratic by definition. Rows are hashed into blocks of about 2,048 regardless of
    their cluster; a task takes two blocks, each pair of blocks once, and returns distance sums per row and cluster, never pairs.
    For large tables use :func:`silhouette_squared`.
    """
    rows = df.select(
        F.col(id_col).cast("long").alias("id"), F.col(cluster).cast("long").alias("cluster"), F.col(vec).alias("vec")
    )
    blocks = -(-rows.count() // TILE_ROWS) or 1
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    # a pair of blocks meets once, on the side of the lower block, and gives sums for the rows of both
    left = rows.withColumn("block", block).withColumn("tile", F.explode(F.sequence(F.col("block"), F.lit(blocks - 1)))).groupBy("block", "tile")
    right = rows.select(*[F.col(c).alias(f"right_{c}") for c in ("id", "cluster", "vec")], block.alias("at_tile"), F.explode(F.sequence(F.lit(0), block)).alias("at")).groupBy("at", "at_tile")
    sums = left.cogroup(right).applyInPandas(_tile_sums, SUMS)
    sizes = rows.groupBy(F.col("cluster").alias("other")).agg(F.count("*").alias("size"))
    per_cluster = sums.groupBy("id", "own", "other").agg(F.sum("total").alias("total")).join(small_side(sizes), "other")
    is_own = F.col("own") == F.col("other")
    per_row = per_cluster.groupBy("id").agg(
        F.max(F.when(is_own, F.when(F.col("size") > 1, F.col("total") / (F.col("size") - 1)))).alias("a"),
        F.min(F.when(~is_own, F.col("total") / F.col("size"))).alias("b"),
    )
    width = F.when(F.col("a").isNull(), 0.0).otherwise(
        F.coalesce(_safe(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    )
    return per_row.agg(F.when(F.count("b") > 0, F.avg(width)).alias("silhouette"))


def _against(rows: DataFrame, held: list[Row]) -> DataFrame:
    """``row, a, b, size`` of ``rows(row, cluster, vec, sq)`` against a block of profiles: the mean squared distance within the own
    cluster, if the block has it, the least to another one, and the own cluster's size."""
    names, sizes = np.array([p["cluster"] for p in held]), np.array([p["size"] for p in held], float)
    msq, means = np.array([p["msq"] for p in held]), np.array([p["mean"] for p in held])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if not len(x):
                continue
            mean_dist = np.maximum(x["sq"].to_numpy()[:, None] + msq[None, :] - 2 * np.stack(x["vec"]) @ means.T, 0)
            at = np.minimum(np.searchsorted(names, x["cluster"]), len(names) - 1)
            here = names[at] == x["cluster"].to_numpy()
            size = np.where(here, sizes[at], 0)
            own = mean_dist[np.arange(len(x)), at] * size / np.maximum(size - 1, 1)
            mean_dist[np.flatnonzero(here), at[here]] = np.inf
            yield pd.DataFrame({"row": x["row"], "a": np.where(here, own, np.nan), "b": mean_dist.min(1), "size": size.astype("int64")})

    kinds = "row long, a double, b double, size long"
    found = rows.select("row", "cluster", "vec", "sq").mapInPandas(run, kinds)
    return found.withColumn("a", F.when(~F.isnan("a"), F.col("a")))


def silhouette_squared(df: DataFrame, cluster: str, vec: str = "embedding") -> DataFrame:
    """Silhouette on squared Euclidean distance, linear in the rows, one row.

    The mean squared distance to a cluster follows from its size, mean vector and mean squared norm.
    This is another number than :func:`silhouette_exact`; never compare the two.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    rows = df.select(F.col(cluster).cast("long").alias("cluster"), F.col(vec).cast("array<double>").alias("vec")).withColumn(
        "sq", F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    )
    profile = rows.groupBy("cluster").agg(
        F.count("*").alias("size"), F.avg("sq").alias("msq"), vector_to_array(Summarizer.mean(array_to_vector("vec"))).alias("mean")
    )
    n = profile.count()
    if n < 2:
        return df.sparkSession.sql("select cast(null as double) as silhouette")
    # a block of profiles is small by construction and goes with the task's code, not with the rows
    numbered = materialise(running(profile.withColumn("one", F.lit(1)), [], ["cluster"], {"rank": "one"}))
    measured = None
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id())) if n > CLUSTER_BLOCK else rows.withColumn("row", F.lit(0).cast("long"))
    for first in range(0, n, CLUSTER_BLOCK):
        held = numbered.where(F.col("rank").between(first + 1, first + CLUSTER_BLOCK)).orderBy("cluster").collect()  # one block
        part = _against(rows, held)
        measured = part if measured is None else measured.unionByName(part)
    if n > CLUSTER_BLOCK:
        best = measured.groupBy("row").agg(F.max("a").alias("a"), F.min("b").alias("b"), F.max("size").alias("size"))
    else:
        best = measured
    top = F.greatest("a", "b")
    width = F.when((F.col("size") > 1) & (top > 0), (F.col("b") - F.col("a")) / top).otherwise(0.0)
    return best.agg(F.avg(width).alias("silhouette"))


def noise_and_clusters(df: DataFrame, cluster: str) -> DataFrame:
    """Noise count and share (label -1) and the number of distinct labels."""
    noise = F.count_if(F.col(cluster) == -1)
    return df.agg(
        noise.alias("noise"), (noise / F.count("*")).alias("noise_frac"), F.countDistinct(cluster).alias("clusters")
    )


def with_prediction(df: DataFrame, scores: str = "scores", out: str = "y_pred") -> DataFrame:
    return df.withColumn(out, argmax(F.col(scores)))


def confusion(df: DataFrame, y: str = "y", y_pred: str = "y_pred") -> DataFrame:
    return df.groupBy(F.col(y).alias("y"), F.col(y_pred).alias("y_pred")).agg(F.count("*").alias("n"))


def confusion_wide(df: DataFrame, num_labels: int, y: str = "y", y_pred: str = "y_pred") -> DataFrame:
    """The matrix with one row per true class and one column per predicted class."""
    cells = df.groupBy(F.col(y).alias("y")).pivot(y_pred, list(range(num_labels))).count()
    return cells.na.fill(0)


def class_table(cells: DataFrame) -> DataFrame:
    """Per class seen in truth or prediction: support, predicted count, hits, precision, recall, F1."""
    n, hit = F.col("n"), F.col("y") == F.col("y_pred")
    zero = F.lit(0)
    sides = F.explode(F.array(
        F.struct(F.col("y").alias("label"), n.alias("support"), zero.cast("long").alias("predicted"), F.when(hit, n).otherwise(zero).alias("hits")),
        F.struct(F.col("y_pred").alias("label"), zero.cast("long").alias("support"), n.alias("predicted"), zero.cast("long").alias("hits")),
    ))
    counts = cells.select(sides.alias("s")).groupBy("s.label").agg(
        *[F.sum(f"s.{c}").alias(c) for c in ("support", "predicted", "hits")]
    )
    zero = F.lit(0.0)
    return counts.withColumn("precision", _safe(F.col("hits"), F.col("predicted"), zero)).withColumn(
        "recall", _safe(F.col("hits"), F.col("support"), zero)
    ).withColumn("f1", _safe(2 * F.col("hits"), F.col("support") + F.col("predicted"), zero))


def label_metrics(df: DataFrame, y: str = "y", y_pred: str = "y_pred") -> DataFrame:
    """Accuracy, macro and weighted F1/precision/recall, kappa and MCC in one row."""
    classes = class_table(confusion(df, y, y_pred))
    support, predicted, hits = (F.col(c).cast("double") for c in ("support", "predicted", "hits"))
    total = F.sum(support)
    averages = [
        x for m in ("f1", "precision", "recall")
        for x in (F.avg(m).alias(f"{m}_macro"), (F.sum(F.col(m) * support) / total).alias(f"{m}_weighted"))
    ]
    sums = classes.agg(
        total.alias("s"), F.sum(hits).alias("c"), F.sum(support * predicted).alias("pt"),
        F.sum(predicted * predicted).alias("pp"), F.sum(support * support).alias("tt"), *averages,
    )
    s, c, pt, pp, tt = (F.col(x) for x in ("s", "c", "pt", "pp", "tt"))
    chance = pt / (s * s)
    spread = F.sqrt(s * s - pp) * F.sqrt(s * s - tt)
    return sums.select(
        (c / s).alias("acc"),
        *[f"{m}_{kind}" for m in ("f1", "precision", "recall") for kind in ("macro", "weighted")],
        _safe(c / s - chance, 1 - chance).alias("kappa"),
        _safe(c * s - pt, spread, F.lit(0.0)).alias("mcc"),
    )


def top_k_accuracy(df: DataFrame, num_labels: int, k: int = 3, y: str = "y", scores: str = "scores") -> DataFrame:
    """Share of rows whose true class is among the ``k`` best scores; equal scores favour the later class.

    Null with fewer than three classes, or where a class has no row.
    """
    places = F.sequence(F.lit(0), F.lit(num_labels - 1))
    s = F.col(scores)
    mine = F.element_at(s, F.col(y) + 1)
    ahead = F.size(F.filter(places, lambda i: (F.get(s, i) > mine) | ((F.get(s, i) == mine) & (i > F.col(y)))))
    value = F.avg((ahead < k).cast("double"))
    whole = F.countDistinct(y) == num_labels
    return df.agg(F.when(whole & F.lit(num_labels > 2), value).alias(f"top{k}_acc"))


def roc_auc_macro(df: DataFrame, num_labels: int, y: str = "y", scores: str = "scores") -> DataFrame:
    """One-vs-rest ROC-AUC on raw scores, macro mean; null with fewer than three classes or a one-sided class.

    Rows are first counted per class and distinct score; the rank sums come from a range-partitioned
    running total, so no class is sorted in one task.
    """
    points = df.select(F.col(y).alias("_y"), F.posexplode(scores).alias("label", "score")).groupBy("label", "score").agg(
        F.sum((F.col("_y") == F.col("label")).cast("long")).alias("pos"), F.count("*").alias("n")
    ).withColumn("neg", F.col("n") - F.col("pos"))
    ranked = running(points, ["label"], ["score"], {"upto": "neg"})
    wins = F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2))
    per_class = ranked.groupBy("label").agg(_safe(wins, F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))
    complete = (F.count("auc") == num_labels) & F.lit(num_labels > 2)
    return per_class.agg(F.when(complete, F.avg("auc")).alias("roc_auc_macro_ovr"))


def evaluate_predictions(df: DataFrame, num_labels: int, y: str = "y", scores: str = "scores") -> DataFrame:
    """The whole suite as one row, from true labels and score arrays."""
    rows = with_prediction(df, scores)
    parts = [label_metrics(rows, y), top_k_accuracy(rows, num_labels, 3, y, scores), roc_auc_macro(rows, num_labels, y, scores)]
    one_row = [p.withColumn("_k", F.lit(1)) for p in parts]
    return reduce(lambda a, b: a.join(b, "_k"), one_row).drop("_k")
