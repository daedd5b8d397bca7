"""Graph texts and triple extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.operators import triples as E
from foliospark.operators.shared import side_by_side, spread
from foliospark.plans.catalogue.registry import WS, papers, query, sql_words, table

# ---- graph texts: the words of a document, taken by threes, as its triples ---------------------


def _graphs(spark, sf_dir):
    words = T.word_list(F.col("abstract"))
    w = F.col("words")

    def triple(i):
        r = F.get(w, i * 3 + 1)
        kind = F.length(r) % 5
        relation = F.when(kind == 0, "have").when(kind == 1, "impact").when(kind == 2, "produce").otherwise(F.concat(r, F.lit("_by")))
        return F.struct(F.get(w, i * 3).alias("s"), relation.alias("r"), F.get(w, i * 3 + 2).alias("o"))

    places = F.filter(F.sequence(F.lit(0), F.floor(F.size(w) / 3)), lambda i: i * 3 + 2 < F.size(w))
    return spread(papers(spark, sf_dir)).select("doc_id", "abstract", words.alias("words")).withColumn(
        "triples", F.transform(places, triple)
    ).select(
        "doc_id", "abstract", "triples",
        F.array_sort(F.array_distinct(F.flatten(F.transform("triples", lambda t: F.array(t["s"], t["o"]))))).alias("nodes"),
        F.transform("triples", lambda t: F.struct(t["s"].alias("src"), t["o"].alias("dst"))).alias("edges"),
    )


_GRAPHS = f"""
ws AS (SELECT doc_id, text AS abstract, {sql_words('text')} AS w FROM documents),
t AS (SELECT doc_id, abstract, list_transform(range(0, len(w) // 3), lambda i: {{'s': w[i * 3 + 1], 'r': CASE length(w[i * 3 + 2]) % 5 WHEN 0 THEN 'have'
  WHEN 1 THEN 'impact' WHEN 2 THEN 'produce' ELSE concat(w[i * 3 + 2], '_by') END, 'o': w[i * 3 + 3]}}) AS ts FROM ws),
p AS (SELECT doc_id, abstract, ts, list_transform(ts, lambda x: concat(x.s, ' ', x.r, ' ', x.o)) AS spo,
  list_transform(ts, lambda x: concat(x.s, ' -> ', x.o)) AS arrows,
  array_to_string(list_sort(list_distinct(list_concat(list_transform(ts, lambda x: x.s), list_transform(ts, lambda x: x.o)))), ', ') AS nodes FROM t)"""


@query("triples_text", f"WITH {_GRAPHS} SELECT doc_id, array_to_string(spo, ' ; ') AS value FROM p")
def _(spark, sf_dir):
    return _graphs(spark, sf_dir).select("doc_id", T.triples_text(F.col("triples")).alias("value"))


@query("items_text", f"WITH {_GRAPHS} SELECT doc_id, array_to_string(list_transform(ts, lambda x: concat('(', x.s, ', ', x.r, ')')), ' ; ') AS value FROM p")
def _(spark, sf_dir):
    items = F.transform("triples", lambda t: F.concat(F.lit("("), t["s"], F.lit(", "), t["r"], F.lit(")")))
    return _graphs(spark, sf_dir).select("doc_id", T.items_text(items).alias("value"))


@query("augmented_text", f"""
WITH {_GRAPHS}, nl AS (SELECT chr(10) AS n)
SELECT doc_id, concat('ABSTRACT:', n, regexp_replace(abstract, '^{WS}|{WS}$', '', 'g'), n, n, 'KNOWLEDGE TRIPLES:', n, array_to_string(spo, ' ; '),
  CASE WHEN len(ts) > 0 THEN concat(n, n, 'GRAPH NODES:', n, nodes, n, n, 'GRAPH EDGES:', n, array_to_string(arrows, ' ; ')) ELSE '' END) AS value
FROM p, nl""")
def _(spark, sf_dir):
    value = T.augmented_text(F.col("abstract"), T.triples_text(F.col("triples")), F.col("nodes"), F.col("edges"))
    return _graphs(spark, sf_dir).select("doc_id", value.alias("value"))


@query("graph_elements_text", f"""
WITH {_GRAPHS}
SELECT doc_id, concat('NODES: ', nodes, '. EDGES: ', array_to_string(arrows, '; '), '. TRIPLES: ', array_to_string(spo, '; '), '.') AS value FROM p""")
def _(spark, sf_dir):
    value = T.graph_elements_text(F.col("nodes"), F.col("edges"), T.triples_text(F.col("triples"), "; "))
    return _graphs(spark, sf_dir).select("doc_id", value.alias("value"))


@query("triple_sentence", f"WITH {_GRAPHS}, x AS (SELECT doc_id, unnest(spo) AS spo FROM p) SELECT doc_id, replace(concat(spo, '.'), '_', ' ') AS value FROM x")
def _(spark, sf_dir):
    return _graphs(spark, sf_dir).select("doc_id", F.explode_outer("triples").alias("t")).where("t is not null").select("doc_id", T.triple_sentence(F.col("t")).alias("value"))


@query("graph_prose", f"""
WITH {_GRAPHS}
SELECT doc_id, concat('This work discusses the following key scientific concepts: ', nodes,
  '. The analysis reveals several relationships among them. ',
  array_to_string(list_transform(ts, lambda x: concat(x.s, ' ', CASE x.r WHEN 'have' THEN 'exhibits' WHEN 'impact' THEN 'impacts'
    WHEN 'produce' THEN 'produces' ELSE 'is related to' END, ' ', x.o, '.')), ' ')) AS value FROM p""")
def _(spark, sf_dir):
    return _graphs(spark, sf_dir).select("doc_id", T.graph_prose(F.col("nodes"), F.col("triples")).alias("value"))


# ---- triples: lines of documents as sentences, with a parse set by word place -----------------
# place mod 8: modifier, compound, subject, verb, object or adverb, preposition, its object, right compound


def _tokens(spark, sf_dir):
    docs = side_by_side(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    words = (
        docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("sent_id", "line"))
        .select("doc_id", "sent_id", F.posexplode(F.split("line", " ")).alias("i", "text"))
        .where("text <> ''")
    )
    slot = F.col("i") % 8
    even = F.length("text") % 2 == 0

    def pick(values):
        c = F
        for i, v in enumerate(values):
            c = c.when(slot == i, v)
        return c

    pos = pick([F.lit("ADJ"), F.lit("NOUN"), F.when(even, "NOUN").otherwise("PRON"), F.lit("VERB"),
                F.when(even, "NOUN").otherwise("ADV"), F.lit("ADP"), F.lit("NOUN"), F.lit("PROPN")])
    dep = pick([F.lit("amod"), F.lit("compound"), F.lit("nsubj"), F.lit("ROOT"),
                F.when(even, "dobj").otherwise("advmod"), F.lit("prep"), F.lit("pobj"), F.lit("compound")])
    shift = pick([F.lit(x) for x in (2, 1, 1, 0, -1, -2, -1, -1)])
    first = F.col("sent_id").cast("long") * 100_000
    return words.select(
        "doc_id", "sent_id", (first + F.col("i")).alias("tok_id"), (first + F.col("i") + shift).alias("head_id"), "text",
        F.when(F.length("text") % 3 == 0, "produce").otherwise(F.lower("text")).alias("lemma"), pos.alias("pos"), dep.alias("dep"),
    )


def _entities(spark, sf_dir):
    """The first two words of each line as named entities."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("sent_id", "line"))
    words = F.slice(F.filter(F.split("line", " "), lambda w: w != ""), 1, 2)
    return lines.select("doc_id", "sent_id", F.posexplode(words).alias("i", "text")).select(
        "doc_id", (2 * F.col("sent_id") + F.col("i")).alias("ent_idx"), "text", F.lit("ORG").alias("label"))


_TOKENS = """
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS sent_id FROM documents),
w AS (SELECT doc_id, sent_id, unnest(string_split(line, ' ')) AS text, generate_subscripts(string_split(line, ' '), 1) - 1 AS i FROM l),
tokens AS (SELECT doc_id, sent_id, sent_id * 100000 + i AS tok_id,
  sent_id * 100000 + i + [2, 1, 1, 0, -1, -2, -1, -1][i % 8 + 1] AS head_id, text,
  CASE WHEN length(text) % 3 = 0 THEN 'produce' ELSE lower(text) END AS lemma,
  CASE i % 8 WHEN 0 THEN 'ADJ' WHEN 1 THEN 'NOUN' WHEN 2 THEN (CASE WHEN length(text) % 2 = 0 THEN 'NOUN' ELSE 'PRON' END) WHEN 3 THEN 'VERB'
    WHEN 4 THEN (CASE WHEN length(text) % 2 = 0 THEN 'NOUN' ELSE 'ADV' END) WHEN 5 THEN 'ADP' WHEN 6 THEN 'NOUN' ELSE 'PROPN' END AS pos,
  CASE i % 8 WHEN 0 THEN 'amod' WHEN 1 THEN 'compound' WHEN 2 THEN 'nsubj' WHEN 3 THEN 'ROOT'
    WHEN 4 THEN (CASE WHEN length(text) % 2 = 0 THEN 'dobj' ELSE 'advmod' END) WHEN 5 THEN 'prep' WHEN 6 THEN 'pobj' ELSE 'compound' END AS dep
  FROM w WHERE text <> ''),
parts AS (SELECT doc_id, tok_id AS place, tok_id, text FROM tokens UNION ALL
  SELECT doc_id, head_id AS place, tok_id, text FROM tokens WHERE (dep IN ('compound', 'amod') AND tok_id < head_id) OR (dep = 'compound' AND tok_id > head_id)),
joined AS (SELECT doc_id, place, string_agg(text, ' ' ORDER BY tok_id) AS phrase FROM parts GROUP BY doc_id, place),
phrases AS (SELECT t.*, phrase FROM tokens t JOIN joined j ON t.doc_id = j.doc_id AND t.tok_id = j.place),
nouns AS (SELECT * FROM phrases WHERE pos IN ('NOUN', 'PROPN')),
subj AS (SELECT doc_id, head_id, arg_max(phrase, tok_id) AS subj FROM nouns WHERE dep IN ('nsubj', 'nsubjpass') GROUP BY 1, 2),
obj AS (SELECT doc_id, head_id, arg_max(phrase, tok_id) AS obj FROM nouns WHERE dep IN ('dobj', 'obj', 'pobj') GROUP BY 1, 2),
pobj AS (SELECT doc_id, head_id, arg_min(phrase, tok_id) AS pobj FROM nouns WHERE dep = 'pobj' GROUP BY 1, 2),
prep AS (SELECT t.doc_id, t.head_id, arg_max(pobj, t.tok_id) AS pobj FROM tokens t JOIN pobj p ON t.doc_id = p.doc_id AND t.tok_id = p.head_id
  WHERE dep = 'prep' GROUP BY 1, 2),
args AS (SELECT v.doc_id, v.tok_id, v.sent_id::INT AS sent_id, lower(v.lemma) AS relation, subj, coalesce(obj, pobj) AS obj FROM tokens v
  LEFT JOIN subj s ON v.doc_id = s.doc_id AND v.tok_id = s.head_id LEFT JOIN obj o ON v.doc_id = o.doc_id AND v.tok_id = o.head_id
  LEFT JOIN prep p ON v.doc_id = p.doc_id AND v.tok_id = p.head_id WHERE v.pos = 'VERB'),
ew AS (SELECT doc_id, sent_id, list_filter(string_split(line, ' '), lambda w: w <> '')[1:2] AS ws FROM l),
entities AS (SELECT doc_id, unnest(ws) AS text, 2 * sent_id + generate_subscripts(ws, 1) - 1 AS ent_idx FROM ew),
inserted AS (SELECT doc_id, text AS node, ent_idx AS ord, 'ORG' AS type FROM entities
  UNION ALL SELECT doc_id, subj, 1000000000 + tok_id * 2, 'ARG' FROM args WHERE subj IS NOT NULL
  UNION ALL SELECT doc_id, obj, 1000000001 + tok_id * 2, 'ARG' FROM args WHERE obj IS NOT NULL),
nodes AS (SELECT doc_id, node, min(ord) AS ord, arg_max(type, ord) AS type FROM inserted GROUP BY 1, 2),
edges AS (SELECT doc_id, subj AS src, obj AS dst, arg_max(relation, tok_id) AS relation, arg_max(sent_id, tok_id) AS sent_id, min(tok_id) AS ord
  FROM args WHERE subj IS NOT NULL AND obj IS NOT NULL GROUP BY 1, 2, 3)"""


@query("token_phrases", f"WITH {_TOKENS} SELECT doc_id, tok_id, phrase FROM phrases")
def _(spark, sf_dir):
    return E.token_phrases(_tokens(spark, sf_dir), placed=True, keep=()).select("doc_id", "tok_id", "phrase")


@query("verb_arguments", f"WITH {_TOKENS} SELECT * FROM args")
def _(spark, sf_dir):
    return E.verb_arguments(_tokens(spark, sf_dir), placed=True)


@query("graph_nodes", f"WITH {_TOKENS} SELECT doc_id, node, type FROM nodes")
def _(spark, sf_dir):
    args = E.verb_arguments(_tokens(spark, sf_dir), placed=True)
    return E.graph_nodes(args, _entities(spark, sf_dir)).select("doc_id", "node", "type")


@query("graph_edges", f"""WITH {_TOKENS}, s AS (SELECT doc_id, sent_id, string_agg(text, ' ' ORDER BY tok_id) AS sentence FROM tokens GROUP BY 1, 2)
SELECT e.*, s.sentence FROM edges e JOIN s ON e.doc_id = s.doc_id AND e.sent_id = s.sent_id""")
def _(spark, sf_dir):
    tokens = _tokens(spark, sf_dir)
    return E.with_sentences(E.graph_edges(E.verb_arguments(tokens, placed=True)), tokens)


# Fixed values in the SQL below: the frame of the prose and its relation words.
@query("document_prose", f"""
WITH {_TOKENS},
nt AS (SELECT doc_id, string_agg(node, ', ' ORDER BY node) AS names FROM nodes GROUP BY 1),
et AS (SELECT e.doc_id, string_agg(concat(src, ' ', CASE WHEN relation IN ('affects', 'impact', 'interact') THEN concat(relation, 's')
   WHEN relation IN ('have', 'has') THEN 'exhibits' WHEN relation = 'produce' THEN 'produces' ELSE 'is related to' END, ' ', dst, '.'), ' '
   ORDER BY n.ord, e.ord) AS block FROM edges e JOIN nodes n ON e.doc_id = n.doc_id AND e.src = n.node GROUP BY 1)
SELECT d.doc_id, CASE WHEN text = '' THEN '' ELSE concat('This work discusses the following key scientific concepts: ', coalesce(names, ''),
  '. The analysis reveals several relationships among them. ', coalesce(block, '')) END AS prose
FROM documents d LEFT JOIN nt ON d.doc_id = nt.doc_id LEFT JOIN et ON d.doc_id = et.doc_id""")
def _(spark, sf_dir):
    graphs = E.document_graphs(_tokens(spark, sf_dir), _entities(spark, sf_dir), papers(spark, sf_dir), placed=True)
    return graphs.select("doc_id", "prose")
