from foliospark.operators import triples as E
from foliospark.operators.annotate import ENTITY_SCHEMA, TOKEN_SCHEMA


def test_edges_find_their_source_without_a_map(spark):
    """Before, each edge looked its source up in a map of the document's nodes, name by name, and an entity without text made the map fail."""
    rows = []
    for i, (subj, obj) in enumerate([("b", "x"), ("a", "x"), ("b", "y"), ("b", "x")]):
        at = 10 * i
        rows += [(1, i, at, at + 1, subj, subj, "NOUN", "nsubj"), (1, i, at + 1, at + 1, "v", f"v{i}", "VERB", "ROOT"), (1, i, at + 2, at + 1, obj, obj, "NOUN", "dobj")]
    tokens = spark.createDataFrame(rows, TOKEN_SCHEMA)
    entities = spark.createDataFrame([(1, 0, None, "ORG"), (1, 1, "a", "ORG")], ENTITY_SCHEMA)
    docs = spark.createDataFrame([(1, "t"), (1, "t"), (2, ""), (3, None), (None, "t")], "doc_id long, abstract string")
    got = sorted(E.document_graphs(tokens, entities, docs).collect(), key=lambda r: r["doc_id"] or 0)
    empty = "This work discusses the following key scientific concepts: . The analysis reveals several relationships among them. "
    assert [tuple(t) for t in got[1]["triples"]] == [("a", "v1", "x"), ("b", "v3", "x"), ("b", "v2", "y")]
    assert got[1]["nodes"] == [None, "a", "b", "x", "y"] and got[1] == got[2]
    assert (got[0]["doc_id"], got[0]["prose"], got[0]["triples"]) == (None, empty, [])
    assert [r["prose"] for r in got[3:]] == ["", ""]
