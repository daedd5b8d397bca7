import math

import pytest

from foliospark.operators import cluster as C
from foliospark.operators import metrics as M

SCORES = [
    (0, [.9, .1, .0, .2]), (0, [.2, .8, .1, .3]), (1, [.1, .7, .2, .0]), (1, [.0, .6, .5, .1]),
    (2, [.3, .2, .9, .1]), (2, [.9, .3, .2, .1]), (3, [.1, .2, .3, .8]), (3, [.4, .3, .2, .1]),
]


def groups(spark, y, c, x=None):
    x = x or [0.0] * len(y)
    return spark.createDataFrame([(i, a, b, [float(v)]) for i, (a, b, v) in enumerate(zip(y, c, x))], "doc_id long, y string, c int, embedding array<double>")


def test_cluster_metrics(spark):
    df = groups(spark, "aabbcc", [0, 0, 1, 1, 1, 2], [0, 1, 10, 11, 12, 30])
    got = M.partition_agreement(df, "y", "c").first()
    assert got["ari"] == pytest.approx(0.444444, abs=1e-6) and got["nmi"] == pytest.approx(0.739667, abs=1e-6)
    assert M.silhouette_exact(df, "c").first()[0] == pytest.approx(0.737587, abs=1e-6)


def test_agreement_special_cases(spark):
    same = M.partition_agreement(groups(spark, "aabbcc", [2, 2, 0, 0, 1, 1]), "y", "c").first()
    assert (same["ari"], same["nmi"]) == (1.0, pytest.approx(1.0))
    flat = M.partition_agreement(groups(spark, "aabb", [1, 1, 1, 1]), "y", "c").first()
    assert flat["nmi"] == 0.0 and flat["ari"] == pytest.approx(0.0)
    both = M.partition_agreement(groups(spark, "aaaa", [1, 1, 1, 1]), "y", "c").first()
    assert (both["ari"], both["nmi"]) == (1.0, 1.0)


def test_silhouette_over_several_tiles(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(0)
    x, c = rng.normal(size=(60, 3)), rng.integers(0, 3, 60)
    c[0] = 7  # a cluster of one
    df = spark.createDataFrame([(i, int(k), [float(v) for v in r]) for i, (k, r) in enumerate(zip(c, x))], "doc_id long, c int, embedding array<double>")

    def plain(power):
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) ** power
        s = []
        for i in range(60):
            own = (c == c[i]) & (np.arange(60) != i)
            b = min(d[i, c == k].mean() for k in set(c) - {c[i]})
            s.append(0.0 if not own.any() else (b - d[i, own].mean()) / max(b, d[i, own].mean()))
        return np.mean(s)

    monkeypatch.setattr(M, "TILE_ROWS", 16)
    assert M.silhouette_exact(df, "c").first()[0] == pytest.approx(plain(1), abs=1e-9)
    assert M.silhouette_squared(df, "c").first()[0] == pytest.approx(plain(2), abs=1e-9)
    monkeypatch.setattr(M, "CLUSTER_BLOCK", 2)  # profiles in two blocks, an own cluster in one of them
    assert M.silhouette_squared(df, "c").first()[0] == pytest.approx(plain(2), abs=1e-9)
    one = df.withColumn("c", df["c"] * 0)
    assert M.silhouette_exact(one, "c").first()[0] is None and M.silhouette_squared(one, "c").first()[0] is None


def test_classification_suite(spark):
    df = spark.createDataFrame([(i, y, s) for i, (y, s) in enumerate(SCORES)], "doc_id long, y int, scores array<double>")
    pred = M.with_prediction(df)
    assert [r["y_pred"] for r in pred.orderBy("doc_id").collect()] == [0, 1, 1, 1, 2, 0, 3, 0]
    got = M.evaluate_predictions(df, 4).first().asDict()
    want = {"acc": .625, "f1_macro": .633333, "f1_weighted": .633333, "precision_macro": .75, "precision_weighted": .75,
            "recall_macro": .625, "recall_weighted": .625, "kappa": .5, "mcc": .522233, "top3_acc": .875, "roc_auc_macro_ovr": .75}
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}


def test_nulls_where_a_metric_is_undefined(spark):
    df = spark.createDataFrame([(1, 0, [.9, .1, .0]), (2, 1, [.2, .8, .1])], "doc_id long, y int, scores array<double>")
    got = M.evaluate_predictions(df, 3).first()
    assert got["top3_acc"] is None and got["roc_auc_macro_ovr"] is None and got["acc"] == 1.0
    constant = spark.createDataFrame([(1, 0, 1), (2, 0, 1)], "doc_id long, y int, y_pred int")
    assert M.label_metrics(constant).first()["mcc"] == 0.0


RESULTS = [
    ("e1", "KMeans", .2, .3, .1, None), ("e1", "GMM", .2, .3, None, None), ("e2", "HDBSCAN", .1, .4, None, .46), ("e2", "KMeans", -.1, .9, .9, None),
]


def result_frame(spark, rows):
    names = ("embedding", "algorithm", "ari", "nmi", "silhouette", "composite")
    return C.result_rows(spark, [dict(zip(names, r)) | {"k": 4, "noise": 3} for r in rows])


def test_pipeline_selection(spark):
    scored = {(r["embedding"], r["algorithm"]): r["score"] for r in C.scored_pipelines(result_frame(spark, RESULTS), 100).collect()}
    assert scored == {("e1", "KMeans"): pytest.approx(.45), ("e1", "GMM"): pytest.approx(.4), ("e2", "HDBSCAN"): pytest.approx(.46)}
    assert C.select_best(result_frame(spark, RESULTS), 100)["algorithm"] == "HDBSCAN"
    assert C.select_best(result_frame(spark, RESULTS), 100, force_k=4)["algorithm"] == "KMeans"
    with pytest.raises(RuntimeError):
        C.select_best(result_frame(spark, RESULTS[3:]), 100)


def test_composite_falls_back_on_noise(spark):
    row = C.scored_pipelines(result_frame(spark, [("e", "HDBSCAN", .2, .4, None, None)]), 30).first()
    assert row["score"] == pytest.approx(.4 + .1 - .5 * 3 / 30)


def test_best_k_ties_and_failures(spark):
    rows = spark.createDataFrame([("KMeans", 4, .5, .2, .2), ("KMeans", 2, .5, .2, .2), ("KMeans", 6, None, None, None), ("GMM", 8, .1, .1, .1)],
                                 "algorithm string, k int, nmi double, ari double, silhouette double")
    assert {r["algorithm"]: r["k"] for r in C.best_k(rows).collect()} == {"KMeans": 2, "GMM": 8}
    assert math.isclose(C.best_k(rows).where("algorithm = 'GMM'").first()["score"], .2)


def test_confusion_matrix(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "y int, y_pred int")
    wide = {r["y"]: (r["0"], r["1"], r["2"]) for r in M.confusion_wide(df, 3).collect()}
    assert wide == {0: (1, 1, 0), 1: (0, 2, 0)}
