from hashlib import sha256

from foliospark.llm import queries


def test_what_a_document_lends_is_dealt_once(spark, tmp_path):
    rows = [(1, "the cat sat"), (1, "the cat sat"), (2, None), (None, "abcdef"), (None, None), (5, "of mice and men")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = queries.QUERIES["op1_spotsigs"](spark, str(tmp_path))
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = [(r.doc_id, r.n_chars, r.edited_sha256) for r in found.collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum("Exchange hashpartitioning(" in line and "to_h" in line for line in plan.splitlines()) == 1
    order = sorted({(d, t or "") for d, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    at = {d: i for i, (d, _) in enumerate(order) if d is not None}
    for d, n, digest in got:
        if d in (5, 2):  # documents next to those without an id have two possible lenders
            text, lender = order[at[d]][1], order[(at[d] + 1) % len(order)][1]
            k = n // 3
            assert n == len(text) and digest == sha256((text[:n - k] + lender[:k]).encode()).hexdigest()
    assert sorted((d or 0, n) for d, n, _ in got) == sorted((d or 0, len(t or "")) for d, t in rows)
