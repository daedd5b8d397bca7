from foliospark.operators import triples as E
from foliospark.operators.annotate import TOKEN_SCHEMA


def test_phrases_need_no_object_per_token(spark):
    """Before, a grouping kept an object for each token; rows with one number still give one row, the largest."""
    rows = [(1, 0, 0, 2, "big", "big", "ADJ", "amod"), (1, 0, 1, 2, "steam", "steam", "NOUN", "compound"), (1, 0, 2, 3, "engine", "engine", "NOUN", "nsubj"),
            (1, 0, 3, 3, "runs", "run", "VERB", "ROOT"), (1, 0, 3, 3, "moves", "move", "VERB", "ROOT"), (1, 0, 4, 9, "lost", "lost", "ADJ", "amod"),
            (None, 0, 5, 6, None, "x", "NOUN", "compound"), (None, 0, 6, 6, "fuel", "fuel", "NOUN", "dobj")]
    tokens = spark.createDataFrame(rows, TOKEN_SCHEMA)
    got = E.token_phrases(tokens)
    assert "ObjectHashAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    found = {(r["doc_id"], r["tok_id"]): (r["lemma"], r["phrase"]) for r in got.collect()}
    assert found == {
        (1, 0): ("big", "big"), (1, 1): ("steam", "steam"), (1, 2): ("engine", "big steam engine"), (1, 3): ("run", "moves runs"), (1, 4): ("lost", "lost"),
        (None, 5): ("x", ""), (None, 6): ("fuel", "fuel")}
    assert got.count() == 7
    bare = E.token_phrases(tokens, keep=())
    assert bare.columns == ["doc_id", "tok_id", "phrase"] and sorted(map(str, bare.collect())) == sorted(map(str, got.select(*bare.columns).collect()))
