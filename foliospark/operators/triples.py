"""Subject-relation-object triples from parsed tokens.

Input tables: ``tokens(doc_id, sent_id, tok_id, head_id, text, lemma, pos, dep)`` and
``entities(doc_id, ent_idx, text, label)``; token numbers are unique inside a document and a root
token is its own head. Children are not joined to their heads: each token sends what its head needs
to the head's key and one window or grouping gathers it. All of them share the hash partitioning on
``doc_id``, so the whole extraction costs one shuffle of the tokens; none if they are ``placed``, which
says that they were made from documents dealt by ``doc_id`` (``shared.side_by_side``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators.shared import materialise

# Dependency labels and word classes that take part in a triple.
LEFT_PARTS = ("compound", "amod")
RIGHT_PARTS = ("compound",)
SUBJECTS = ("nsubj", "nsubjpass")
OBJECTS = ("dobj", "obj", "pobj")
NOUNS = ("NOUN", "PROPN")
# Columns of a token that come along with its phrase.
ROW = ("sent_id", "head_id", "text", "lemma", "pos", "dep")


def by_document(tokens: DataFrame, placed: bool = False) -> DataFrame:
    return tokens if placed else tokens.repartition("doc_id")


def token_phrases(tokens: DataFrame, wanted: Column | None = None, placed: bool = False, keep: tuple[str, ...] = ROW) -> DataFrame:
    """Add ``phrase``: left compounds and modifiers, the token, right compounds, in text order.

    Only tokens that are ``wanted`` (all by default) get a row; others still lend their text. ``keep`` names the columns that
    come along; of rows with the same number the largest is kept.
    """
    wanted = F.lit(True) if wanted is None else wanted
    left = F.col("dep").isin(*LEFT_PARTS) & (F.col("tok_id") < F.col("head_id"))
    right = F.col("dep").isin(*RIGHT_PARTS) & (F.col("tok_id") > F.col("head_id"))
    sends = F.array(
        F.when(wanted, F.struct(F.col("tok_id").alias("to"), F.lit(True).alias("own"))),
        F.when(left | right, F.struct(F.col("head_id").alias("to"), F.lit(False).alias("own"))),
    )
    others = [c for c in keep if c != "text"]
    sent = by_document(tokens, placed).withColumn("s", F.explode_outer(sends)).where("s is not null").select(
        "doc_id", "s.to", "s.own", "tok_id", "text", *[F.when(F.col("s.own"), F.col(c)).alias(c) for c in others])
    # Groups are one or two rows: a window reads them off the sorted rows, where a grouping keeps an object for each. Narrow rows matter.
    own_first = Window.partitionBy("doc_id", "to").orderBy(F.desc("own"), *[F.desc(c) for c in ROW if c in keep or (keep and c == "text")])
    parts = F.collect_list(F.struct("tok_id", "text")).over(own_first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    phrase = F.trim(F.array_join(F.transform(F.sort_array("parts"), lambda p: p["text"]), " "))
    return (
        sent.select("doc_id", F.col("to").alias("tok_id"), "own", *keep, F.row_number().over(own_first).alias("nth"), parts.alias("parts"))
        .where("nth = 1 and own").select("doc_id", "tok_id", *keep, phrase.alias("phrase"))
    )


def verb_arguments(tokens: DataFrame, placed: bool = False) -> DataFrame:
    """One row per verb: ``subj`` (last subject child), ``obj`` (last object child, else the first
    object of the last preposition that has one), ``relation`` (lower-case lemma)."""
    noun = F.col("pos").isin(*NOUNS)
    argument = noun & F.col("dep").isin(*SUBJECTS, *OBJECTS)
    phrases = token_phrases(tokens, argument | (F.col("pos") == "VERB") | (F.col("dep") == "prep"), placed, tuple(c for c in ROW if c != "text"))
    here = F.struct("tok_id", "phrase")
    # first hop: nouns report to their heads
    report = F.when(noun & (F.col("head_id") != F.col("tok_id")), F.struct(
        F.col("head_id").alias("to"),
        F.lit(None).cast("struct<sent_id:int,head_id:long,lemma:string,pos:string,dep:string>").alias("row"),
        F.when(F.col("dep").isin(*SUBJECTS), here).alias("subj"),
        F.when(F.col("dep").isin(*OBJECTS), here).alias("obj"),
        F.when(F.col("dep") == "pobj", here).alias("pobj"),
    ))
    own_row = F.struct(
        F.col("sent_id").cast("int"), F.col("head_id").cast("long"), "lemma", "pos", "dep"
    ).cast("struct<sent_id:int,head_id:long,lemma:string,pos:string,dep:string>")
    nothing = F.lit(None).cast(phrases.select(here).schema[0].dataType)
    keep = F.when((F.col("pos") == "VERB") | (F.col("dep") == "prep"), F.struct(
        F.col("tok_id").alias("to"), own_row.alias("row"), nothing.alias("subj"), nothing.alias("obj"), nothing.alias("pobj"),
    ))
    heads = (
        phrases.select("doc_id", F.explode_outer(F.array(keep, report)).alias("s")).where("s is not null")
        .groupBy("doc_id", F.col("s.to").alias("tok_id"))
        .agg(F.max("s.row").alias("row"), F.max("s.subj").alias("subj"), F.max("s.obj").alias("obj"), F.min("s.pobj").alias("pobj"))
        .where("row is not null")
        .select("doc_id", "tok_id", "row.*", F.col("subj.phrase").alias("subj"), F.col("obj.phrase").alias("obj"), F.col("pobj.phrase").alias("pobj"))
    )
    # second hop: prepositions hand their object to the verb
    verb = F.when(F.col("pos") == "VERB", F.struct(
        F.col("tok_id").alias("to"), F.struct("sent_id", F.lower("lemma").alias("relation"), "subj", "obj").alias("verb"),
        F.lit(None).cast("struct<tok_id:long,phrase:string>").alias("by_prep"),
    ))
    verb_type = heads.select(F.struct("sent_id", F.lower("lemma").alias("relation"), "subj", "obj")).schema[0].dataType
    prep = F.when((F.col("dep") == "prep") & F.col("pobj").isNotNull() & (F.col("head_id") != F.col("tok_id")), F.struct(
        F.col("head_id").alias("to"), F.lit(None).cast(verb_type).alias("verb"),
        F.struct(F.col("tok_id").cast("long").alias("tok_id"), F.col("pobj").alias("phrase")).alias("by_prep"),
    ))
    return (
        heads.select("doc_id", F.explode_outer(F.array(verb, prep)).alias("s")).where("s is not null")
        .groupBy("doc_id", F.col("s.to").alias("tok_id"))
        .agg(F.max("s.verb").alias("verb"), F.max("s.by_prep").alias("by_prep"))
        .where("verb is not null")
        .select("doc_id", "tok_id", "verb.sent_id", "verb.relation", "verb.subj", F.coalesce("verb.obj", "by_prep.phrase").alias("obj"))
    )


def sentence_texts(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("doc_id", "sent_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("tok_id", "text"))), lambda t: t["text"]), " ").alias("sentence")
    )


def graph_nodes(arguments: DataFrame, entities: DataFrame) -> DataFrame:
    """Nodes unique by text per document: entities first, then arguments in verb order.

    ``ord`` is the place of the first insertion; ``type`` comes from the last one.
    """
    named = entities.select(
        "doc_id", F.col("text").alias("node"), F.struct(F.lit(0).alias("stage"), F.col("ent_idx").cast("long").alias("at"), F.lit(0).alias("side")).alias("ord"),
        F.col("label").alias("type"),
    )
    used = arguments.select(
        "doc_id", F.explode_outer(F.array(F.struct(F.col("subj").alias("node"), F.lit(0).alias("side")), F.struct(F.col("obj").alias("node"), F.lit(1).alias("side")))).alias("a"), "tok_id"
    ).where("a.node is not null").select(
        "doc_id", "a.node", F.struct(F.lit(1).alias("stage"), F.col("tok_id").cast("long").alias("at"), F.col("a.side").alias("side")).alias("ord"), F.lit("ARG").alias("type"),
    )
    return named.unionByName(used).groupBy("doc_id", "node").agg(F.min("ord").alias("ord"), F.max_by("type", "ord").alias("type"))


def with_sentences(edges: DataFrame, tokens: DataFrame) -> DataFrame:
    """Edges with the text of their sentence."""
    return edges.join(sentence_texts(tokens), ["doc_id", "sent_id"], "left")


def graph_edges(arguments: DataFrame) -> DataFrame:
    """One edge per (src, dst); a later verb overwrites relation and sentence but not the place."""
    return (
        arguments.where("subj is not null and obj is not null")
        .groupBy("doc_id", F.col("subj").alias("src"), F.col("obj").alias("dst"))
        .agg(F.max_by("relation", "tok_id").alias("relation"), F.max_by("sent_id", "tok_id").alias("sent_id"), F.min("tok_id").alias("ord"))
    )


def document_graphs(tokens: DataFrame, entities: DataFrame, documents: DataFrame, placed: bool = False) -> DataFrame:
    """Per document ``nodes``, ordered ``triples`` and the prose built from them.

    Triples follow the first insertion of their source node, then of the edge. A document without
    text gives '' and one without tokens the prose of an empty graph.
    """
    # nodes and edges both start from the verbs: a small table next to the tokens
    arguments = materialise(verb_arguments(tokens, **({"placed": True} if placed else {})))
    # an edge finds the place of its source in the window over node names; looking it up in a map per document is quadratic
    triple = F.struct(F.col("src").alias("s"), F.col("relation").alias("r"), F.col("dst").alias("o"))
    nodes = graph_nodes(arguments, entities).select("doc_id", "node", F.struct("ord", "node").alias("placed"))
    edges = graph_edges(arguments).select("doc_id", F.col("src").alias("node"), F.struct(F.col("ord").alias("b"), triple.alias("t")).alias("edge"))
    place = F.max("placed.ord").over(Window.partitionBy("doc_id", "node"))
    graphs = (
        nodes.unionByName(edges, allowMissingColumns=True).repartition("doc_id")
        .select("doc_id", "placed", F.when(F.col("edge").isNotNull(), F.struct(place.alias("a"), F.col("edge.b").alias("b"), F.col("edge.t").alias("t"))).alias("edge"))
        .groupBy("doc_id").agg(F.sort_array(F.collect_list("placed")).alias("placed"), F.sort_array(F.collect_list("edge")).alias("edges"))
        .select("doc_id", F.transform("placed", lambda p: p["node"]).alias("nodes"), F.transform("edges", lambda e: e["t"]).alias("triples"))
    )
    text = F.coalesce(T.newlines_to_spaces(F.col("abstract")), F.lit(""))
    nodes_or_none = F.coalesce("nodes", F.array().cast("array<string>"))
    triples_or_none = F.coalesce("triples", F.array().cast("array<struct<s:string,r:string,o:string>>"))
    return documents.select("doc_id", (text == "").alias("blank")).join(graphs, "doc_id", "left").select(
        "doc_id", nodes_or_none.alias("nodes"), triples_or_none.alias("triples"),
        F.when(F.col("blank"), "").otherwise(T.graph_prose(nodes_or_none, triples_or_none)).alias("prose"),
    )
