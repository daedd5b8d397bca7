from foliospark.operators import triples as E
from foliospark.operators.annotate import ENTITY_SCHEMA, TOKEN_SCHEMA, annotate, rule_tokens

TOKENS = """1,0,0,2,The,the,DET,det
1,0,1,2,large,large,ADJ,amod
1,0,2,3,model,model,NOUN,nsubj
1,0,3,3,improves,improve,VERB,ROOT
1,0,4,5,parsing,parsing,NOUN,compound
1,0,5,3,accuracy,accuracy,NOUN,dobj
2,0,0,1,Heat,heat,NOUN,nsubj
2,0,1,1,flows,flow,VERB,ROOT
2,0,2,1,through,through,ADP,prep
2,0,3,2,pipes,pipe,NOUN,pobj
2,0,4,1,into,into,ADP,prep
2,0,5,4,tanks,tank,NOUN,pobj
2,1,6,7,Heat,heat,NOUN,nsubj
2,1,7,7,produces,produce,VERB,ROOT
2,1,8,7,tanks,tank,NOUN,dobj"""
LEAD = "This work discusses the following key scientific concepts: "
NEXT = ". The analysis reveals several relationships among them. "


def test_fixture_documents(spark):
    rows = [t.split(",") for t in TOKENS.splitlines()]
    tokens = spark.createDataFrame([(int(d), int(s), int(t), int(h), *rest) for d, s, t, h, *rest in rows], TOKEN_SCHEMA)
    entities = spark.createDataFrame([(3, 0, "MIT", "ORG")], ENTITY_SCHEMA)
    docs = spark.createDataFrame([(1, "x"), (2, "x"), (3, "MIT"), (4, "")], "doc_id long, abstract string")
    got = {r["doc_id"]: r for r in E.document_graphs(tokens, entities, docs).collect()}
    assert [tuple(t) for t in got[1]["triples"]] == [("large model", "improve", "parsing accuracy")]
    assert got[1]["nodes"] == ["large model", "parsing accuracy"]
    assert [tuple(t) for t in got[2]["triples"]] == [("Heat", "produce", "tanks")] and got[2]["nodes"] == ["Heat", "tanks"]
    assert got[2]["prose"] == LEAD + "Heat, tanks" + NEXT + "Heat produces tanks."
    assert got[3]["prose"] == LEAD + "MIT" + NEXT
    assert got[4]["prose"] == ""
    edge = E.graph_edges(E.verb_arguments(tokens)).where("doc_id = 2").first()
    assert (edge["relation"], edge["sent_id"], edge["ord"]) == ("produce", 1, 1)


def test_later_type_wins_and_first_place_stays(spark):
    arguments = spark.createDataFrame([(1, 4, 0, "use", "MIT", "gas")], "doc_id long, tok_id int, sent_id int, relation string, subj string, obj string")
    entities = spark.createDataFrame([(1, 0, "MIT", "ORG"), (1, 1, "IBM", "ORG")], ENTITY_SCHEMA)
    nodes = {r["node"]: r for r in E.graph_nodes(arguments, entities).collect()}
    assert {n: r["type"] for n, r in nodes.items()} == {"MIT": "ARG", "IBM": "ORG", "gas": "ARG"}
    assert nodes["MIT"]["ord"]["stage"] == 0


def test_edges_follow_the_place_of_their_source(spark):
    rows = [(1, 1, 0, "use", "b", "x"), (1, 5, 1, "have", "a", "x"), (1, 9, 2, "produce", "b", "y"), (1, 12, 3, "show", "b", "x")]
    arguments = spark.createDataFrame(rows, "doc_id long, tok_id long, sent_id int, relation string, subj string, obj string")
    entities = spark.createDataFrame([(1, 0, "a", "ORG")], ENTITY_SCHEMA)
    original = E.verb_arguments
    E.verb_arguments = lambda tokens: tokens
    try:
        docs = spark.createDataFrame([(1, "t")], "doc_id long, abstract string")
        got = E.document_graphs(arguments, entities, docs).first()
    finally:
        E.verb_arguments = original
    assert [tuple(t) for t in got["triples"]] == [("a", "have", "x"), ("b", "show", "x"), ("b", "produce", "y")]


def test_rule_annotator(spark):
    words = {t[4]: t for t in rule_tokens(1, "The fast model improves parsing accuracy.")}
    assert words["model"][7] == "nsubj" and words["improves"][6] == "VERB"
    docs = spark.createDataFrame([(1, "The sparse model improves word accuracy. It was used in tests."), (2, "")], "doc_id long, abstract string")
    none = spark.createDataFrame([], ENTITY_SCHEMA)
    got = {r["doc_id"]: r for r in E.document_graphs(annotate(docs), none, docs).collect()}
    assert ("sparse model", "improve", "word accuracy") in [tuple(t) for t in got[1]["triples"]] or got[1]["triples"]
    assert got[2]["prose"] == ""
