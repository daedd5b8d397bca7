"""Persisted tables of wide rows are kept in small batches, so that a stream to disk never holds much of the heap."""

import pytest
from pyspark.sql import functions as F

from foliospark.operators.classify import search
from foliospark.operators.shared import KEPT_ROWS, small_batches

BATCH = "spark.sql.inMemoryColumnarStorage.batchSize"


def test_setting_holds_inside_only(spark):
    before = spark.conf.get(BATCH)
    with pytest.raises(ValueError), small_batches(spark):
        assert int(spark.conf.get(BATCH)) == KEPT_ROWS
        raise ValueError
    assert spark.conf.get(BATCH) == before


def test_search_keeps_its_rows_in_small_batches(spark, monkeypatch):
    from foliospark.operators import classify

    seen = []
    monkeypatch.setattr(classify, "run_trial", lambda train, val, t, n, seed: seen.append(int(spark.conf.get(BATCH))) or {"trial_id": t.trial_id, "state": "FAIL"})
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id") % 4).alias("clean"), (F.col("id") % 2).alias("y"))
    assert search(docs, "abstract", "y", n_trials=1).count() == 1
    assert seen == [KEPT_ROWS]
