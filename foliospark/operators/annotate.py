"""Token tables from text: a hook for any annotator and one small rule annotator.

Annotation is a per-document step without shuffle. The rule annotator knows a short word list and a
few endings; it is there so that documents can flow through without an external parser.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

TOKEN_SCHEMA = "doc_id long, sent_id int, tok_id int, head_id int, text string, lemma string, pos string, dep string"
ENTITY_SCHEMA = "doc_id long, ent_idx int, text string, label string"

# Fixed values of the rule annotator.
DETERMINERS = {"a", "an", "the", "this", "that", "these", "those", "our", "its", "their"}
PREPOSITIONS = {"of", "in", "on", "for", "with", "by", "from", "to", "at", "as", "into", "through", "over"}
OTHER_WORDS = {"and", "or", "but", "we", "it", "he", "she", "they", "not", "there", "which", "than"}
VERB_FORMS = {
    "is": "be", "are": "be", "was": "be", "were": "be", "be": "be", "has": "have", "have": "have", "had": "have",
    "produces": "produce", "produce": "produce", "uses": "use", "use": "use", "shows": "show", "show": "show",
    "impacts": "impact", "impact": "impact", "improves": "improve", "improve": "improve",
}
VERB_ENDINGS = ("ed", "ing")
ADJECTIVE_ENDINGS = ("ble", "ous", "ive", "al", "est")
SENTENCE = re.compile(r"[^.!?]+[.!?]*")
WORD = re.compile(r"[^\W_]+(?:[-'][^\W_]+)*")


def _word_class(word: str) -> tuple[str, str]:
    low = word.lower()
    if low in VERB_FORMS:
        return "VERB", VERB_FORMS[low]
    if low in DETERMINERS:
        return "DET", low
    if low in PREPOSITIONS:
        return "ADP", low
    if low in OTHER_WORDS or not low[0].isalpha() or low.endswith("ly"):
        return "X", low
    for ending in VERB_ENDINGS:
        if low.endswith(ending) and len(low) > len(ending) + 3:
            return "VERB", low[: -len(ending)]
    return ("ADJ" if low.endswith(ADJECTIVE_ENDINGS) else "NOUN"), low


def parse_sentence(words: list[str]) -> list[tuple[int, str, str, str]]:
    """Head (place in the sentence), lemma, class and dependency label of each word."""
    classes = [_word_class(w) for w in words]
    pos = [c for c, _ in classes]
    next_verb, following = [None] * len(words), None
    for i in range(len(words) - 1, -1, -1):
        next_verb[i] = following
        following = i if pos[i] == "VERB" else following
    out, verb, prep = [], None, None
    for i, (cls, lemma) in enumerate(classes):
        head, dep = i, "ROOT"
        follower = pos[i + 1] if i + 1 < len(words) else None
        if cls == "VERB":
            verb, prep = i, None
        elif cls == "ADP" and verb is not None:
            prep, head, dep = i, verb, "prep"
        elif cls == "DET" and follower:
            head, dep = i + 1, "det"
        elif cls == "ADJ" and follower == "NOUN":
            j = i + 1
            while j + 1 < len(words) and pos[j + 1] == "NOUN":
                j += 1
            head, dep = j, "amod"
        elif cls == "NOUN":
            if follower == "NOUN":
                j = i + 1
                while j + 1 < len(words) and pos[j + 1] == "NOUN":
                    j += 1
                head, dep = j, "compound"
            elif prep is not None:
                head, dep, prep = prep, "pobj", None
            elif verb is None and next_verb[i] is not None:
                head, dep = next_verb[i], "nsubj"
            elif verb is not None:
                later = next_verb[i]
                head, dep = (later, "nsubj") if later is not None and later - i < i - verb else (verb, "dobj")
        out.append((head, lemma, cls, dep))
    return out


def rule_tokens(doc_id: int, text: str) -> Iterable[tuple]:
    at = 0
    for sent_id, sentence in enumerate(SENTENCE.findall(text.replace("\n", " "))):
        words = WORD.findall(sentence)
        for i, (head, lemma, pos, dep) in enumerate(parse_sentence(words)):
            yield doc_id, sent_id, at + i, at + head, words[i], lemma, pos, dep
        at += len(words)


def annotate(df: DataFrame, annotator: Callable[[int, str], Iterable[tuple]] = rule_tokens, text: str = "abstract",
             schema: str = TOKEN_SCHEMA, rows_per_batch: int = 50_000) -> DataFrame:
    """Run a per-document annotator; it yields rows of ``schema``. Output leaves in bounded batches."""
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = []
        for batch in batches:
            for doc_id, value in zip(batch["doc_id"], batch["text"]):
                for row in annotator(doc_id, value or ""):
                    rows.append(row)
                    if len(rows) >= rows_per_batch:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return df.selectExpr("doc_id", f"`{text}` as text").mapInPandas(run, schema)


def capitalised_entities(doc_id: int, text: str) -> Iterable[tuple]:
    """Upper-case abbreviations as named entities of the rule annotator."""
    for i, found in enumerate(re.finditer(r"\b[A-Z]{2,}\b", text)):
        yield doc_id, i, found.group(), "ORG"
