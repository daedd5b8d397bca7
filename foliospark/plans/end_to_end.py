"""The whole run: prepare, embed, compare, select, fit, assign, filter, search."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.config import PipelineConfig
from foliospark.functions import text as T
from foliospark.operators import classify, cluster, embed, sampling
from foliospark.operators.annotate import ENTITY_SCHEMA, annotate, capitalised_entities
from foliospark.operators.profile import cluster_mix, cluster_purity
from foliospark.operators.shared import materialise
from foliospark.operators.stored import content_digest
from foliospark.operators.triples import document_graphs


@dataclass
class Outcome:
    comparison: DataFrame
    best: dict
    clustered: DataFrame
    assigned: DataFrame
    mix: DataFrame
    purity: DataFrame
    dropped: int
    trials: DataFrame
    best_trial: dict


def prepare(records: DataFrame, cfg: PipelineConfig, tokens: DataFrame | None = None, entities: DataFrame | None = None) -> DataFrame:
    """Text columns of ``doc_id, abstract, categories``, and a seeded split: a fitting sample, and all others.

    Without parsed ``tokens`` the built-in rule annotator runs.
    """
    chosen = materialise(sampling.split_sample(records, cfg.n_clustering, seed=cfg.seed))
    tokens = annotate(chosen) if tokens is None else tokens.join(chosen.select("doc_id"), "doc_id", "left_semi")
    entities = annotate(chosen, capitalised_entities, schema=ENTITY_SCHEMA) if entities is None else entities.join(
        chosen.select("doc_id"), "doc_id", "left_semi")
    prose = document_graphs(tokens, entities, chosen).select("doc_id", F.col("prose").alias("triples"))
    return sampling.with_representations(chosen.join(prose, "doc_id").select(
        "doc_id", "split", "abstract", T.clean_text(F.col("abstract")).alias("clean"), "triples",
        T.top_category(F.col("categories")).alias("top_category"),
    ))


def run(records: DataFrame, cfg: PipelineConfig | None = None) -> Outcome:
    cfg = cfg or PipelineConfig()
    docs = materialise(prepare(records, cfg))
    # an empty graph column would only add zeros to hybrid vectors
    docs = docs.drop("graph_text")
    to_cluster, to_classify = docs.where("split = 'cluster'"), docs.where("split = 'class'")
    store = embed.EmbeddingStore(cfg.store)
    digest = {split: content_digest(part) if cfg.store else "" for split, part in (("cluster", to_cluster), ("class", to_classify))}

    @cache
    def encoder(name: str) -> embed.FittedEncoder:  # fitted only if vectors of it are missing
        return embed.fit_encoder(to_cluster, name, cfg.cluster_mode, cfg.seed)

    def vectors(name: str, part: DataFrame, split: str) -> DataFrame:
        make = lambda: encoder(name).transform(part).join(part.select("doc_id", "top_category"), "doc_id")
        return store.get(("vectors", split, digest["cluster"], digest[split], cfg.cluster_mode, name, cfg.seed, embed.FORM), make)

    embedded = {name: vectors(name, to_cluster, "cluster") for name in cfg.encoders}
    comparison = cluster.compare(embedded, "top_category", cfg)
    best = cluster.select_best(comparison, to_cluster.count(), cfg.force_k)
    fitted = cluster.fit_final(embedded[best["embedding"]], best, cfg.seed)
    clustered = materialise(cluster.fitted_labels(fitted, embedded[best["embedding"]]))
    assigned = materialise(fitted.transform(vectors(best["embedding"], to_classify, "class")))
    dropped = sampling.rare_count(assigned, "cluster_id", cfg.min_group_size).first()[0]
    kept = sampling.drop_rare(assigned, "cluster_id", cfg.min_group_size)
    labelled = sampling.label_encode(kept, "cluster_id").select("doc_id", "cluster_id", "cluster_id_enc")
    # the classifier may learn from a bounded sample of the labelled rows; every row has its cluster all the same
    taught = sampling.split_first_n(labelled, cfg.n_classifier, 0, seed=cfg.seed).select("doc_id", "cluster_id_enc")
    training = to_classify.join(taught, "doc_id")
    trials = classify.search(training, cfg.class_mode, "cluster_id_enc", cfg.n_trials, cfg.validation_fraction, cfg.seed, cfg.parallelism, cfg.store)
    both = clustered.select("cluster_id", "top_category", F.lit("cluster").alias("split")).unionByName(
        assigned.select("cluster_id", "top_category", F.lit("class").alias("split")))
    named = both.withColumn("cluster_id", F.concat_ws(":", "split", "cluster_id"))
    top = classify.best_trial(trials).first()
    store.release()
    return Outcome(comparison, best, clustered, assigned, cluster_mix(named), cluster_purity(named), dropped, trials, top.asDict() if top else {})
