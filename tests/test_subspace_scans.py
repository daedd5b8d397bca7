"""The wide encoder keeps a document's entries together: they are counted once and never joined with vectors."""

from collections import Counter
from math import log

import numpy as np
from pyspark.sql import functions as F

from foliospark.operators import subspace as S

SLOTS = 64


def tokens_of(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [f"w{j}" for j in rng.integers(0, 30 + i, 20)]) for i in range(12)]
    rows += [(3, ["w1", "w1", "own"]), (None, ["w2"]), (None, ["w3", "w2"]), (90, []), (91, None)]
    return spark.createDataFrame(rows, "doc_id long, tokens array<string>"), rows


def slot_numbers(spark, rows):
    words = sorted({w for _, ws in rows for w in ws or ()})
    found = spark.createDataFrame([(w,) for w in words], "w string").select("w", S.slot_of(F.col("w"), SLOTS).alias("s")).collect()
    return {r.w: r.s for r in found}


def bags_of(rows, slots):
    bags = {}
    for doc, words in rows:
        if words:
            bags.setdefault(doc, Counter()).update(slots[w] for w in words)
    return bags


def test_bags_and_weights(spark):
    tokens, rows = tokens_of(spark)
    want = bags_of(rows, slot_numbers(spark, rows))
    bags = S.counts(tokens, SLOTS)
    assert {r.doc_id: dict(zip(r.slot, r.tf)) for r in bags.collect()} == want and bags.count() == len(want)
    shares = Counter(s for bag in want.values() for s in bag)
    weights = S.weighted(bags, S.document_shares(bags, len(rows)))
    got = {(r.doc_id, r.slot): (r.tf, round(r.weight, 9)) for r in weights.collect()}
    assert got == {(d, s): (n, round(n * log((len(rows) + 1) / (shares[s] + 1)), 9)) for d, bag in want.items() for s, n in bag.items()}


def test_a_fit_writes_no_entry_as_a_row(spark, monkeypatch):
    tokens, rows = tokens_of(spark)
    written, real = [], S.materialise

    def record(df):
        written.append(real(df))
        return written[-1]

    monkeypatch.setattr(S, "materialise", record)
    model = S.fit_wide(tokens, 4, SLOTS)
    units = {}
    for r in model.transform(tokens).collect():
        units.setdefault(r.doc_id, []).append(r.unit.toArray())
    slots = slot_numbers(spark, rows)
    bags = bags_of(rows, slots)
    assert all(t.count() <= len(bags) for t in written)
    shares = Counter(s for bag in bags.values() for s in bag)
    a = np.zeros((len(bags), SLOTS))
    for i, bag in enumerate(bags.values()):
        for s, n in bag.items():
            a[i, s] = n * log((len(rows) + 1) / (shares[s] + 1))
    lead = a @ np.linalg.svd(a)[2][:4].T
    lead /= np.linalg.norm(lead, axis=1, keepdims=True)
    at = [i for i, d in enumerate(bags) if d is not None]
    ids = [d for d in bags if d is not None]
    got = np.array([units[d][0] for d in ids])
    assert np.allclose(got @ got.T, lead[at] @ lead[at].T, atol=0.05)  # the axes may be turned, likeness is not
    assert len(units[3]) == 2 and np.array_equal(*units[3]) and not np.any(units[None] + units[90] + units[91])


def test_blocks_cut_a_batch_anywhere(spark, monkeypatch):
    tokens, rows = tokens_of(spark)
    bags = S.counts(tokens, SLOTS).toArrow().combine_chunks().to_batches()[0]
    monkeypatch.setattr(S, "BLOCK_ENTRIES", 20)
    seen = [(first + r, s, n) for first, _, row, (slot, tf) in S._blocks(bags.slice(2)) for r, s, n in zip(row, slot, tf)]
    want = [(i, s, n) for i, bag in enumerate(bags.slice(2).to_pylist()) for s, n in zip(bag["slot"], bag["tf"])]
    assert seen == want
