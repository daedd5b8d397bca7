import numpy as np
from pyspark.sql import functions as F

from foliospark.operators import subspace as S


def angles(a, b):
    """Sines of the angles between two ranges."""
    qa, qb = np.linalg.qr(a)[0], np.linalg.qr(b)[0]
    return np.sqrt(np.maximum(0, 1 - np.linalg.svd(qa.T @ qb, compute_uv=False) ** 2))


def test_axes_are_those_of_the_full_decomposition(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(90, 6)) * [40, 30, 20, 12, 8, 5] @ rng.normal(size=(6, 70)) + rng.normal(size=(90, 70)) * 0.3
    a[rng.random(a.shape) < 0.05] = 0
    entries = spark.createDataFrame([(int(i), 1000 + int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "doc_id long, slot int, weight double")
    rows = {r.slot: r.axis for r in S.principal_slots(entries, 5).collect()}
    got = np.array([rows[1000 + j] for j in range(70)])
    want = np.linalg.svd(a)[2][:5].T
    assert got.shape == (70, 5) and np.allclose(got.T @ got, np.eye(5), atol=1e-8)
    assert angles(got, want).max() < 1e-3


def test_a_low_rank_gives_fewer_axes(spark):
    rows = [(i, s, w) for i in range(9) for s, w in ((1, 1.0 + i), (2, 2.0 + 2 * i))]
    axes = S.principal_slots(spark.createDataFrame(rows, "doc_id long, slot int, weight double"), 4).collect()
    assert sorted((r.slot, [round(abs(x), 6) for x in r.axis]) for r in axes) == [(1, [0.447214]), (2, [0.894427])]
    assert S.principal_slots(spark.createDataFrame([], "doc_id long, slot int, weight double"), 4).count() == 0


def test_texts_become_unit_vectors(spark):
    words = [["a", "b"] * 3, ["a", "b", "c"], ["x", "y"], ["x", "y", "z", "z"], []]
    tokens = spark.createDataFrame(list(enumerate(words)), "doc_id long, tokens array<string>")
    model = S.fit_wide(tokens, 3)
    got = {r.doc_id: r.unit.toArray() for r in model.transform(tokens).collect()}
    assert len(got) == 5 and all(abs(np.linalg.norm(got[i]) - 1) < 1e-6 for i in range(4)) and not got[4].any()
    assert got[0] @ got[1] > 0.5 and got[2] @ got[3] > 0.5 and abs(got[0] @ got[2]) < 0.1
    new = model.transform(spark.createDataFrame([(9, ["never", "seen"])], "doc_id long, tokens array<string>")).first()
    assert not new.unit.toArray().any() and S.slot_of(F.lit("a"), 7) is not None
