import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import langid, negatives, whitening

VECTORS = "vec_id long, embedding array<double>, label int, _x string, q string, no string, n string, whitened string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], y, "x", "q", "n", "m", "w") for i, v, y in rows], VECTORS)


@pytest.fixture(scope="module")
def crowd():
    """Vectors in a few directions, with a crowd of copies, and rows that cannot take part."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 12)) @ rng.normal(size=(12, 12)) * 0.3
    x[500:] = x[3]
    rows = [(i, v.tolist(), int(rng.integers(4))) for i, v in enumerate(x)]
    odd = [(1000, None, 1), (1100, [], 1), (1200, [float("nan")] * 12, 1), (1300, [None, *[1.0] * 11], 2), (1400, [float("inf")] * 12, 1), (1500, [1.0], 1)]
    return rows, odd


def test_components_are_eigenvectors():
    rng = np.random.default_rng(1)
    for d, rank in ((1, 1), (2, 2), (7, 7), (16, 5), (33, 33)):
        b = rng.normal(size=(rank, d)) * np.logspace(0, -4, rank)[:, None]
        a = b.T @ b
        low, order = whitening.pivoted_cholesky(a)
        assert low.shape == (d, rank) and np.allclose(low @ low.T, a[np.ix_(order, order)], atol=1e-12) and np.allclose(np.triu(low, 1), 0)
        values, axes = whitening.components(a)
        assert np.allclose(axes.T @ axes, np.eye(rank), atol=1e-12) and (np.diff(values) <= 0).all()
        assert np.allclose(a @ axes, axes * values, atol=1e-12 * values[0])
        small = np.linalg.svd(b, compute_uv=False)[-1] ** 2
        assert abs(values[-1] - small) < 1e-4 * small
    assert whitening.components(np.zeros((3, 3)))[0].shape == (0,)


def test_whitening_against_plain_algebra(spark, crowd):
    rows, odd = crowd
    table = vectors(spark, rows + odd + [(None, rows[0][1], None)])
    model = whitening.fit(table, keep=5)
    x = np.floor(64 * np.array([v for _, v, _ in rows])).astype(np.int64) + 1_000_000
    once = np.unique(x, axis=0)
    n, s = len(once), once.sum(0)
    v = np.cov(once.T.astype(float), bias=True)
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1][:5], axes[:, ::-1][:, :5]
    assert model.n == n and model.sums == tuple(s.tolist()) and np.allclose(model.values, e, rtol=1e-10)
    assert np.allclose(model.explained, e / np.trace(v), rtol=1e-10) and model.identity_error < 1e-9
    done = whitening.transform(table, model)
    assert done.columns == [*[c for c in table.columns if c != "whitened"], "deviation", "whitened"]
    got = {r.vec_id: r for r in whitening.by_component(done, model, F.col("vec_id"), F.col("deviation")).where("component = 2").collect()}
    assert set(got) == {i for i, _, _ in rows} | {None}
    want = (x - s / n) @ axes[:, 1] / np.sqrt(e[1])
    mine = np.array([got[i].whitened for i, _, _ in rows])
    assert min(abs(mine - want).max(), abs(mine + want).max()) < 1e-7
    exact = [sum((n * int(c) - int(t)) ** 2 for c, t in zip(row, s)) for row in x]
    assert [got[i].deviation for i, _, _ in rows] == exact and got[None].deviation == exact[0]


def test_whitening_of_next_to_nothing(spark, crowd):
    rows, odd = crowd
    for few in ([], odd[:5], rows[:1], [rows[3]] * 4):
        table = vectors(spark, few)
        model = whitening.fit(table)
        assert len(model.values) == 0 and whitening.by_component(whitening.transform(table, model), model, F.col("vec_id")).count() == 0
    two = whitening.fit(vectors(spark, rows[:2]))
    assert two.n == 2 and len(two.values) == 1 and abs(two.explained[0] - 1) < 1e-12 and two.identity_error < 1e-9
    far = whitening.fit(vectors(spark, [(1, [1e13], 0), (2, [-1e13], 0), (3, [3.0], 0)]))
    assert [r.deviation for r in whitening.transform(vectors(spark, [(1, [1e13], 0)]), far).collect()] == [None]


def mined(rows, positives=5, negatives=5):
    """Brute force, one anchor after the other, in whole numbers."""
    usable = sorted({(i, y, tuple(int(np.floor(256 * c)) for c in v)) for i, v, y in rows if i is not None and y is not None and v and None not in v and np.isfinite(v).all() and len(v) == 12})
    out = set()
    for anchor, label, q in usable:
        if anchor % 100:
            continue
        scored = sorted({(-sum(a * b for a, b in zip(q, p)), i, y == label) for i, y, p in usable if i != anchor})
        for s, i, _ in [x for x in scored if x[2]][:positives]:
            inside = [(n, j) for n, j, same in scored if not same and 80 * -s <= 100 * -n <= 100 * -s][:negatives]
            out |= {(anchor, i, rank, j, -s, -n) for rank, (n, j) in enumerate(inside, 1)}
    return sorted(out)


def test_negatives_are_those_of_brute_force(spark, crowd, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 50)
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", 3)
    monkeypatch.setattr(negatives, "SLICE_ROOT", 40)
    monkeypatch.setattr(negatives, "HELD", 60)
    rows, odd = crowd
    rows = rows + odd + [(None, rows[0][1], 1), (2000, rows[5][1], None), (100, rows[9][1], 2), rows[7], rows[200], rows[200]]
    got = negatives.mine(vectors(spark, rows), F.col("vec_id") % 100 == 0)
    assert sorted(tuple(r) for r in got.collect()) == mined(rows)
    assert {r[0] for r in mined(rows)} >= {0, 200, 300} and got.columns == [x.split()[0] for x in negatives.OUT.split(", ")]
    assert negatives.mine(vectors(spark, []), F.col("vec_id") % 100 == 0).count() == 0


def test_large_components_stay_exact():
    a = np.array([[2**30, -(2**30) + 1]])
    assert negatives._scores(a, a).tolist() == [[2**60 + (2**30 - 1) ** 2]]
    b = np.full((1, 64), 2**31 - 1)
    assert negatives._scores(b, -b).tolist() == [[-(2**63)]]


def plain_forward_backward(e, turns):
    a, b = [e[0]], [np.zeros(e.shape[1])]
    for x in e[1:]:
        a.append(x + np.logaddexp.reduce(a[-1][:, None] + turns, 0))
    for x in e[:0:-1]:
        b.insert(0, np.logaddexp.reduce(turns + (x + b[0])[None], 1))
    z = np.logaddexp.reduce(a[-1])
    pairs = sum((np.exp(a[t - 1][:, None] + turns + (e[t] + b[t])[None] - z) for t in range(1, len(e))), np.zeros(turns.shape))
    return np.exp(np.array(a) + np.array(b) - z), pairs, z


def test_forward_backward_in_blocks_is_the_plain_one():
    rng = np.random.default_rng(2)
    for sizes in ([1], [31, 32, 33], [1, 200, 2, 65]):
        e, turns = rng.normal(size=(sum(sizes), 3)) * 3, rng.normal(size=(3, 3))
        found, pairs, z = langid.forward_backward(e, np.array(sizes), turns)
        want = [plain_forward_backward(x, turns) for x in np.split(e, np.cumsum(sizes)[:-1])]
        assert np.allclose(found, np.concatenate([w[0] for w in want]), atol=1e-9) and np.allclose(pairs, sum(w[1] for w in want), atol=1e-8) and abs(z - sum(w[2] for w in want)) < 1e-8
    assert langid.forward_backward(np.zeros((0, 3)), np.zeros(0, int), np.zeros((3, 3)))[2] == 0


def test_gradient_is_that_of_the_likelihood():
    rng, words = np.random.default_rng(3), "le chat est sur the mat und der hund the cat le".split()
    chains = langid.chained([(words, 0), (words[::-1], 1), ([], 1), (["hund"] * 50, 1)])
    assert len(chains[0]) == 2 * len(words) + 50 and sorted(chains[0]) == sorted([*words, *words, *["hund"] * 50]) and chains[2].sum() == len(chains[0])
    counts = rng.integers(0, 5, size=(langid.LEXICON, 2)).astype(float)
    size = langid.SLOTS * 2 + 8
    x = rng.normal(size=size) * 0.1
    value = lambda x: langid.log_likelihood(chains, counts, langid.Weights.unflat(x, 2))
    g = value(x)
    at = [*np.argsort(-abs(g[:langid.SLOTS * 2]))[:4].tolist(), *range(size - 8, size)]
    for i in at:
        step = np.zeros(size)
        step[i] = 1e-2
        assert abs((value(x + step)[-2] - value(x - step)[-2]) / 2e-2 - g[i]) < 2e-3 * max(1, abs(g[i]))


def test_letter_runs_and_affixes():
    word, slot = langid.gram_slots(["ab", "abc", "b"])
    own = [set(slot[word == i].tolist()) for i in range(3)]
    assert [int((word == i).sum()) for i in range(3)] == [2 + 1 + 2 + 2, 3 + 2 + 1 + 2 + 2 + 2, 1 + 2]
    assert own[0] & own[1] and own[0] != own[1] and langid.words_of("L'été 2²a x_y\n ﬁn!") == ["l", "été", "a", "x", "y", "ﬁn"]
    assert langid.words_of(None) == langid.words_of("12 ² _!") == []


def test_languages_of_held_out_documents(spark, edges, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs, most=60)
    done = langid.predict(docs.drop("lang").withColumn("c0", F.lit(1)), model).join(docs.select("doc_id", "lang"), "doc_id").where(langid.held_out(F.col("doc_id")))
    right = done.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert right[0] > 0.98 and 0.25 <= right[1] <= right[2] <= 1
    out = spark.range(60).where(langid.held_out(F.col("id"))).collect()
    assert [r.id for r in out] == [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 == 2]
    rnd = random.Random(7)
    by = {x: [w for r in docs.where(f"lang = '{x}'").limit(40).collect() for w in langid.words_of(r.text)] for x in ("de", "es")}
    parts = [" ".join(rnd.choices(by[x], k=25)) for x in ("de", "es", "de")]
    mixed = spark.createDataFrame([(". ".join(parts),), (None,), ("",), ("123 ² _ !",), ("x " * 50_000,)], "text string")
    got = langid.spans(mixed, model).collect()
    text, found = got[0].text, got[0].spans
    in_lang = {x: sum(len(langid.words_of(text[s.start:s.end])) for s in found if s.lang == x) for x in ("de", "es")}
    assert 40 <= in_lang["de"] <= 60 and 18 <= in_lang["es"] <= 35 and found[0].start == 0 and found[-1].end == len(text)
    assert [r.spans for r in got[1:4]] == [[], [], []]
    kinds = langid.predict(mixed, model).collect()
    assert kinds[0].lang_pred == "de" and [(r.lang_pred, r.score) for r in kinds[1:4]] == [("und", 0.0)] * 3 and kinds[4].lang_pred in model.langs
    odd = langid.predict(edges, model)
    assert odd.columns == [*[c for c in edges.columns if c != "score"], "lang_pred", "score"] and odd.count() == edges.count()
    assert langid.predict(nothing, model).count() == 0
    none = langid.fit(nothing)
    assert none.langs == () and langid.predict(mixed, none).where("lang_pred <> 'und' OR score <> 0").count() == 0 and [r.spans for r in langid.spans(mixed, none).collect()] == [[]] * 5


def test_a_fit_on_odd_rows(spark, edges):
    model = langid.fit(edges)
    assert model.langs == ("en",)
    assert langid.predict(edges, model).where("lang_pred = 'und'").count() == 4  # null, null, empty and blank
