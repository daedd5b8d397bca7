"""Document vectors: four encoders fitted on the texts, a precomputed column, and a user-model hook."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.config import TEXT_MODES
from foliospark.functions import text as T
from foliospark.functions.vectors import concat_views, l2_normalise
from foliospark.operators.sampling import select_text
from foliospark.operators.shared import materialise
from foliospark.operators.stored import keep, lookup
from foliospark.operators.subspace import WideModel, fit_wide

HASH_DIM = 512
PCA_DIM = 32
WORD_DIM = 48
WORD_BUCKETS = 1 << 14
WORD_TASKS = 8  # part of the model: Word2Vec averages what this many tasks learn
MAX_TOKENS = 256
#: What a stored vector depends on besides rows and settings.
FORM = (HASH_DIM, PCA_DIM, WORD_DIM, WORD_BUCKETS, WORD_TASKS)


def _words(text: Column) -> Column:
    """Words of the clean text; they are split off at the white space that cleaning would squeeze first."""
    return T.word_list(F.lower(text))


def _hashed_words(text: Column) -> Column:
    """Words as one of 16,384 bucket names, so the Word2Vec vocabulary has a fixed bound."""
    return F.transform(_words(text), lambda w: F.pmod(F.xxhash64(w), F.lit(WORD_BUCKETS)).cast("string"))


@lru_cache(1 << 20)
def _gram_slot(gram: int) -> int:
    """The slot of ``a b c``, for three code points of 21 bits each: Murmur3 of its UTF-8 with seed 42, as ``HashingTF`` places terms."""
    data = " ".join(chr(gram >> s & 0x1FFFFF) for s in (42, 21, 0)).encode()
    h, full, low = 42, len(data) & ~3, 0xFFFFFFFF
    for i in range(0, len(data), 4):
        k = int.from_bytes(data[i:i + 4], "little") * 0xCC9E2D51 & low
        h ^= (k << 15 | k >> 17) * 0x1B873593 & low
        if i < full:
            h = ((h << 13 | h >> 19) & low) * 5 + 0xE6546B64 & low
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & low
    h = (h ^ h >> 13) * 0xC2B2AE35 & low
    h ^= h >> 16
    return (h - (h >> 31 << 32)) % HASH_DIM


def _gram_counts(texts: pd.Series) -> pd.Series:
    """How often a text has the character trigrams of each slot; only the different ones are hashed."""
    def one(text: str | None) -> np.ndarray | None:
        if text is None:
            return None
        c = np.frombuffer(text.encode("utf-32-le"), "<u4").astype("int64")
        grams, n = np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:], return_counts=True)
        return np.bincount(np.fromiter(map(_gram_slot, grams.tolist()), int, len(grams)), n, HASH_DIM)

    return pd.Series([one(t) for t in texts], dtype=object)


def _characters(text: Column) -> Column:
    return array_to_vector(F.pandas_udf(_gram_counts, "array<double>")(T.clean_text(text)))


# name -> (tokens from text, stages). Every model's size is bounded by the dimensions above.
ENCODERS: dict[str, tuple[Callable[[Column], Column], Callable[[int], list]]] = {
    "tfidf_hash": (_words, lambda seed: [
        HashingTF(numFeatures=HASH_DIM, inputCol="tokens", outputCol="tf"), IDF(inputCol="tf", outputCol="vector")]),
    "tfidf_pca": (_words, lambda seed: []),  # fitted by subspace.fit_wide
    "word2vec": (_hashed_words, lambda seed: [
        Word2Vec(numPartitions=WORD_TASKS, vectorSize=WORD_DIM, minCount=1, seed=seed, maxIter=1, inputCol="tokens", outputCol="vector")]),
    "char_hash": (_characters, lambda seed: [IDF(inputCol="tokens", outputCol="vector")]),
}

#: Encoders whose fit goes over the words more than once; the others count them in one pass, so writing them is a pass too many.
READ_AGAIN = ("word2vec",)


def views_of(df: DataFrame, mode: str) -> list[str]:
    """Text columns one mode encodes: hybrid encodes its parts apart and joins the vectors."""
    if mode not in TEXT_MODES:
        raise ValueError(f"Unknown text mode: {mode!r}; expected one of {TEXT_MODES}")
    if mode != "hybrid":
        return [mode]
    return ["abstract", "triples"] + (["graph_text"] if "graph_text" in df.columns else [])


def _view_text(df: DataFrame, view: str) -> DataFrame:
    if view == "graph_text":
        return df.select("doc_id", F.col("graph_text").alias("text"))
    return select_text(df, view)


@dataclass
class FittedEncoder:
    """One fitted pipeline per text view; the same object serves sweep, fit and assignment."""

    name: str
    mode: str
    views: dict[str, PipelineModel | WideModel]

    def _encode(self, df: DataFrame, view: str) -> DataFrame:
        tokens = ENCODERS[self.name][0]
        texts = _view_text(df, view).select("doc_id", tokens(F.col("text")).alias("tokens"))
        return self.views[view].transform(texts).select("doc_id", vector_to_array("unit").alias(view))

    def transform(self, df: DataFrame) -> DataFrame:
        """``doc_id, embedding array<float>``, unit length (all-zero rows stay zero)."""
        encoded = [self._encode(df, v) for v in self.views]
        joined = encoded[0]
        for other in encoded[1:]:
            joined = joined.join(other, "doc_id")
        parts = [F.col(v) for v in self.views]
        vector = parts[0] if len(parts) == 1 else concat_views(*parts)
        return joined.select("doc_id", vector.cast("array<float>").alias("embedding"))


def fit_encoder(df: DataFrame, name: str, mode: str, seed: int = 42) -> FittedEncoder:
    tokens, make = ENCODERS[name]
    stages = [*make(seed), Normalizer(p=2.0, inputCol="vector", outputCol="unit")]
    models = {}
    for view in views_of(df, mode):
        texts = _view_text(df, view).select("doc_id", tokens(F.col("text")).alias("tokens"))
        if name in READ_AGAIN:
            texts = materialise(texts)  # every pass of a fit reads the words, none makes them again
        models[view] = fit_wide(texts, PCA_DIM) if name == "tfidf_pca" else Pipeline(stages=stages).fit(texts)
    return FittedEncoder(name, mode, models)


def precomputed(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    """Use a vector column of a table as it is, brought to unit length."""
    return df.select(F.col(id_col).alias("doc_id"), l2_normalise(F.col(vec)).cast("array<float>").alias("embedding"))


def encode_with(texts: DataFrame, make_model: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 16) -> DataFrame:
    """Encode with a user's model: ``make_model`` is called once per task and returns texts -> matrix."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make_model()
        for series in batches:
            values = series.fillna("").tolist()
            rows = [r for i in range(0, len(values), batch) for r in np.asarray(model(values[i:i + batch]), dtype="float32")]
            yield pd.Series(rows)

    encoded = texts.select("doc_id", run("text").alias("raw"))
    return encoded.select("doc_id", l2_normalise(F.col("raw")).cast("array<float>").alias("embedding"))


def mean_pool(tokens: DataFrame, vectors: DataFrame, max_tokens: int | None = MAX_TOKENS) -> DataFrame:
    """Mean word vector of the first ``max_tokens`` words (an encoder's truncation; None takes all words).

    ``tokens(doc_id, tokens array)``, ``vectors(word, embedding)``; words without a vector are left out, and a document
    without any has the zero vector. Words are counted per document before the join.
    """
    words = F.col("tokens") if max_tokens is None else F.slice("tokens", 1, max_tokens)
    counted = (
        tokens.select("doc_id", F.explode_outer(words).alias("word"))
        .where("word is not null").groupBy("doc_id", "word").agg(F.count("*").cast("double").alias("n"))
    )
    table = vectors.select("word", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    width = vectors.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()[0]
    pooled = counted.join(table, "word").groupBy("doc_id").agg(vector_to_array(Summarizer.mean(F.col("v"), F.col("n"))).alias("m"))
    return tokens.select("doc_id").distinct().join(pooled, "doc_id", "left").select(
        "doc_id", F.coalesce("m", F.array_repeat(F.lit(0.0), width)).alias("embedding"))


def mean_vectors(df: DataFrame, group: str, vec: str = "embedding") -> DataFrame:
    """Mean vector per group, added up in the JVM with map-side combination."""
    v = array_to_vector(F.col(vec).cast("array<double>"))
    return df.groupBy(group).agg(vector_to_array(Summarizer.mean(v)).alias("centroid"))


@dataclass
class EmbeddingStore:
    """Encoded tables, reused by a key of plain values: mode, encoder, seed and digests of the rows fitted and encoded.

    Under ``root``, a folder that all executors share, they outlive the session; without one they are the session's scratch.
    """

    root: str | None = None
    kept: dict[tuple, DataFrame] = field(default_factory=dict)

    def get(self, key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
        if key not in self.kept:
            self.kept[key] = self._written(key, make)
        return self.kept[key]

    def _written(self, key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
        if self.root is None:
            return materialise(make())
        held = lookup(SparkSession.active(), self.root, key)
        return keep(self.root, key, make()) if held is None else held

    def release(self) -> None:
        """Forget the tables; those under ``root`` stay."""
        self.kept.clear()
