import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliospark.llm import simhash, toxicity
from foliospark.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    from foliospark.operators.shared import materialise

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(materialise(stage(spark, kept[-1], SMALL)))
    return kept


def test_stages_decide_as_brute_force_does(spark, stages):
    docs, clean, lines, single, mixed, tokens = stages
    model = toxicity.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    known = toxicity.Gains(model)
    score = {r.doc_id: toxicity.probability(model, toxicity.features(toxicity.windows(r.text), known)) for r in docs.collect()}
    assert {r.doc_id for r in clean.collect()} == {i for i, s in score.items() if s < 0.7}
    from tests.llm.test_texts import kept_lines

    want = kept_lines([(r.doc_id, r.text) for r in clean.collect()])
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in lines.collect()), key=str) == sorted(((i, t, len(t)) for i, _, _, t in want), key=str)
    rows = sorted(lines.collect(), key=lambda r: r.doc_id)
    prints = [simhash.simhash(r.text.encode(), 4) for r in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    assert sorted(r.doc_id for r in single.collect()) == sorted({rows[x].doc_id for x in root})
    text = {r.doc_id: r.text for r in single.collect()}
    assert all(text[r.doc_id] == r.text for r in mixed.collect()) and max(r["count"] for r in mixed.groupBy("doc_id").count().collect()) <= 3
    assert sorted((r.doc_id, r.decoded_sha256) for r in tokens.collect()) == sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in mixed.collect())
    for df in stages[1:-1]:
        assert df.columns == docs.columns


def test_run_is_the_stages(spark, stages):
    pick = lambda df: sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in df.collect())
    assert pick(corpus_pipeline.run(spark, SMALL)) == pick(stages[-1])


def test_stages_on_odd_rows(spark, edges, nothing):
    count = edges.count()
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, edges, SMALL)
        rows = done.collect()
        assert stage(spark, nothing, SMALL).count() == 0
        if name != "byte_bpe":
            assert done.columns == edges.columns
        if name in ("toxicity", "line_dedup", "byte_bpe"):
            assert len(rows) == count
        if name == "simhash_near_dedup":
            texts = [r.text for r in rows]
            assert sum(1 for t in texts if not (t or "").strip()) == 1 and len(texts) == len(set(texts)) and {r.doc_id for r in rows} >= {1, 2, 5, None}
        if name == "mixing":
            assert all((r.text or "").strip() for r in rows)


def test_edited_texts(spark):
    rows = sorted(spark.read.parquet(f"{SMALL}/documents.parquet").collect(), key=lambda r: -r.doc_id)
    got = {r.doc_id: r for r in QUERIES["op1_spotsigs"](spark, SMALL).collect()}
    assert len(got) == len(rows)
    for r, other in zip(rows, [*rows[1:], rows[0]]):
        k = len(r.text) // 3
        edited = r.text[:len(r.text) - k] + other.text[:k]
        own = got[r.doc_id]
        assert own.n_chars == len(r.text) and own.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        sets = [{f[i:i + 8] for i in range(0, len(f), 8)} for f in (own.fingerprint, own.edited_fingerprint, got[other.doc_id].fingerprint)]
        assert abs(own.near_edited - len(sets[0] & sets[1]) / len(sets[0] | sets[1])) < 1e-9
        assert abs(own.near_next - len(sets[0] & sets[2]) / len(sets[0] | sets[2])) < 1e-9


def test_queries_cover_their_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name in ("op2_byte_bpe", "op3_simhash", "op5_mixing", "op6_sharding", "op7_line_dedup", "op8_toxicity", "op10_secrets"):
        assert QUERIES[name](spark, SMALL).select("doc_id").exceptAll(docs.select("doc_id")).count() == 0
        assert QUERIES[name](spark, SMALL).agg(F.count("*")).first()[0] == docs.count()
