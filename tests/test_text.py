from pyspark.sql import functions as F

from foliospark.functions import text as T


def one(spark, column, **values):
    df = spark.range(1)
    for name, value in values.items():
        df = df.withColumn(name, value if not isinstance(value, str) else F.lit(value))
    return df.select(column.alias("x")).first()["x"]


def triples(*items):
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("sro", t)]) for t in items])


def test_clean(spark):
    assert one(spark, T.clean_text(F.col("t")), t="  Hello\n World\t") == "hello world"
    assert one(spark, T.clean_text(F.col("t")), t="A B C\x1cD\x85E") == "a b c d e"


def test_top_category(spark):
    for given, want in [("cs.LG stat.ML", "cs"), ("hep-th", "hep-th"), (" ", "unknown")]:
        assert one(spark, T.top_category(F.col("t")), t=given) == want
    assert one(spark, T.top_category(F.lit(None).cast("string"))) == "unknown"


def test_counts(spark):
    assert one(spark, T.token_count(F.col("t")), t="a  b\nc") == 3
    assert one(spark, T.char_count(F.col("t")), t=" é\U0001F600 ") == 4
    assert one(spark, T.is_not_blank(F.col("t")), t="\t ") is False


def test_triples_text(spark):
    assert one(spark, T.triples_text(triples("arb", "cqd"))) == "a r b ; c q d"
    assert one(spark, T.triple_sentence(F.struct(F.lit("a_b").alias("s"), F.lit("r_q").alias("r"), F.lit("o").alias("o")))) == "a b r q o."
    assert one(spark, T.items_text(F.array(F.lit("(unk, unk, unk)"), F.lit("x")))) == "(unk, unk, unk) ; x"


def test_prose(spark):
    nodes = F.array(F.lit("b"), F.lit("a"))
    rows = triples(("a", "impact", "b"), ("a", "have", "b"), ("a", "produce", "b"), ("a", "use", "b"))
    assert one(spark, T.graph_prose(nodes, rows)) == (
        "This work discusses the following key scientific concepts: a, b. The analysis reveals several relationships among them. "
        "a impacts b. a exhibits b. a produces b. a is related to b."
    )


def test_augmented_blocks(spark):
    none = F.array().cast("array<string>")
    edges = F.array(F.struct(F.lit("a").alias("src"), F.lit("b").alias("dst")))
    text = T.augmented_text(F.lit(" x "), F.lit("a r b"), none, edges)
    assert one(spark, text) == "ABSTRACT:\nx\n\nKNOWLEDGE TRIPLES:\na r b\n\nGRAPH EDGES:\na -> b"
    assert one(spark, T.augmented_text(F.lit("x"), F.lit(""))) == "ABSTRACT:\nx\n\nKNOWLEDGE TRIPLES:\n"
    assert one(spark, T.graph_elements_text(F.array(F.lit("a")), edges, F.lit("a r b"))) == "NODES: a. EDGES: a -> b. TRIPLES: a r b."


def test_hybrid_keeps_places_of_missing_parts(spark):
    assert one(spark, T.hybrid_text(F.lit("c"), F.lit("t"), F.lit(""))) == "ABSTRACT: c [SEP] TRIPLES: t [SEP] GRAPH: "
    assert one(spark, T.abstract_triples_text(F.lit("c"), F.lit(""))) == "c "
