"""Settings of a run, in one frozen object that is passed around explicitly."""

from __future__ import annotations

from dataclasses import dataclass

TEXT_MODES = ("abstract", "triples", "abstract_triples", "hybrid")
SILHOUETTES = ("squared", "euclidean")


@dataclass(frozen=True)
class PipelineConfig:
    """Defaults are fixed values of the method: set sizes, sweep ranges, trial count and seed.

    ``n_clustering`` documents fit the encoders and the clustering; all others get their labels. ``n_classifier`` of those
    bound the labelled rows that the classifier search learns from. ``silhouette`` names the form of that score at every
    size: ``squared`` is linear in the rows, ``euclidean`` is exact and quadratic. ``store`` is a shared folder that keeps
    encodings and completed trials for later sessions.
    """

    cluster_mode: str = "abstract"
    class_mode: str = "abstract"
    n_clustering: int = 2000
    n_classifier: int = 2000
    n_trials: int = 24
    force_k: int | None = None
    max_k: int = 40
    k_step: int = 2
    min_cluster_sizes: tuple[int, ...] = (5, 10, 20, 30, 50, 75)
    algorithms: tuple[str, ...] = ("KMeans", "GMM", "HDBSCAN")
    encoders: tuple[str, ...] = ("tfidf_hash", "tfidf_pca", "word2vec", "char_hash")
    validation_fraction: float = 0.2
    min_group_size: int = 2
    silhouette: str = "squared"
    seed: int = 42
    parallelism: int = 4
    store: str | None = None

    def __post_init__(self):
        for mode in (self.cluster_mode, self.class_mode):
            if mode not in TEXT_MODES:
                raise ValueError(f"Unknown text mode: {mode!r}; expected one of {TEXT_MODES}")
        if self.silhouette not in SILHOUETTES:
            raise ValueError(f"Unknown silhouette: {self.silhouette!r}; expected one of {SILHOUETTES}")
