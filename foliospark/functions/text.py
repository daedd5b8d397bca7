"""String and array expressions over document text, all evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters Python's str.split() and \s treat as white space.
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"

# How a relation is put into words.
VERBS_TAKING_S = ("affects", "impact", "interact")
VERBS_OF_HAVING = ("have", "has")
CONCEPTS_LEAD = "This work discusses the following key scientific concepts: "
RELATIONS_LEAD = "The analysis reveals several relationships among them. "


def squeeze(c: Column) -> Column:
    """Collapse white-space runs to one space and strip both ends."""
    return F.trim(F.regexp_replace(c, WHITESPACE, " "))


def clean_text(c: Column) -> Column:
    return squeeze(F.lower(c))


def is_not_blank(c: Column) -> Column:
    return F.coalesce(squeeze(c) != "", F.lit(False))


def word_list(c: Column) -> Column:
    """White-space separated tokens, as ``str.split()`` gives them."""
    return F.filter(F.split(c, WHITESPACE), lambda w: w != "")


def token_count(c: Column) -> Column:
    return F.size(word_list(c))


def char_count(c: Column) -> Column:
    return F.char_length(c)


def before_dot(c: Column) -> Column:
    return F.substring_index(c, ".", 1)


def top_category(c: Column) -> Column:
    """Top level of the first category; ``unknown`` for null or blank input."""
    return F.when(is_not_blank(c), before_dot(F.get(word_list(c), F.lit(0)))).otherwise("unknown")


def newlines_to_spaces(c: Column) -> Column:
    return F.translate(c, "\n", " ")


def _spo(t: Column) -> Column:
    return F.concat_ws(" ", t["s"], t["r"], t["o"])


def triples_text(triples: Column, sep: str = " ; ") -> Column:
    """``array<struct<s,r,o>>`` to text, e.g. ``a r b ; c q d``."""
    return F.array_join(F.transform(triples, _spo), sep)


def items_text(items: Column, sep: str = " ; ") -> Column:
    """``array<string>`` whose items are already text."""
    return F.array_join(F.transform(items, lambda x: x.cast("string")), sep, "None")


def _edges_text(edges: Column, sep: str) -> Column:
    return F.array_join(F.transform(edges, lambda e: F.concat_ws(" -> ", e["src"], e["dst"])), sep)


def augmented_text(abstract: Column, triples: Column, nodes: Column | None = None, edges: Column | None = None) -> Column:
    """Titled blocks joined by a blank line; ``triples`` is text (see :func:`triples_text`).

    Node and edge blocks appear only where the list has items.
    """
    blocks = [
        F.concat(F.lit("ABSTRACT:\n"), squeeze_ends(abstract)),
        F.concat(F.lit("KNOWLEDGE TRIPLES:\n"), F.coalesce(triples, F.lit(""))),
    ]
    if nodes is not None:
        blocks.append(F.when(F.size(nodes) > 0, F.concat(F.lit("GRAPH NODES:\n"), F.array_join(nodes, ", "))))
    if edges is not None:
        blocks.append(F.when(F.size(edges) > 0, F.concat(F.lit("GRAPH EDGES:\n"), _edges_text(edges, " ; "))))
    return F.concat_ws("\n\n", *blocks)


def squeeze_ends(c: Column) -> Column:
    """Strip white space at both ends only."""
    return F.regexp_replace(c, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def graph_elements_text(nodes: Column, edges: Column, triples: Column) -> Column:
    """Nodes, edges and triples on one line; ``triples`` is text made with ``"; "``."""
    return F.concat(
        F.lit("NODES: "), F.array_join(nodes, ", "),
        F.lit(". EDGES: "), _edges_text(edges, "; "),
        F.lit(". TRIPLES: "), triples, F.lit("."),
    )


def triple_sentence(t: Column) -> Column:
    return F.concat(F.translate(_spo(t), "_", " "), F.lit("."))


def relation_sentence(t: Column) -> Column:
    r = t["r"]
    verb = (
        F.when(r.isin(*VERBS_TAKING_S), F.concat(r, F.lit("s")))
        .when(r.isin(*VERBS_OF_HAVING), F.lit("exhibits"))
        .when(r == "produce", F.lit("produces"))
        .otherwise(F.lit("is related to"))
    )
    return F.concat(t["s"], F.lit(" "), verb, F.lit(" "), t["o"], F.lit("."))


def graph_prose(nodes: Column, triples: Column) -> Column:
    """Two fixed sentences: the sorted node list, then one short sentence per triple."""
    return F.concat(
        F.lit(CONCEPTS_LEAD), F.array_join(F.sort_array(nodes), ", "), F.lit(". "),
        F.lit(RELATIONS_LEAD), F.array_join(F.transform(triples, relation_sentence), " "),
    )


def abstract_triples_text(clean: Column, triples: Column) -> Column:
    return F.concat(F.coalesce(clean, F.lit("")), F.lit(" "), F.coalesce(triples, F.lit("")))


def hybrid_text(clean: Column, triples: Column, graph: Column) -> Column:
    parts = [("ABSTRACT: ", clean), (" [SEP] TRIPLES: ", triples), (" [SEP] GRAPH: ", graph)]
    return F.concat(*(x for title, c in parts for x in (F.lit(title), F.coalesce(c, F.lit("")))))
