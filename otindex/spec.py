"""Parameters of the end-to-end index."""

from __future__ import annotations

from dataclasses import dataclass, field

from otindex.functions.stopwords import ENGLISH


@dataclass(frozen=True)
class DictionarySpec:
    """Topic dictionary: model, transport and optimizer parameters.

    ``batch_size`` documents make one optimizer step, which is one Spark job: raise it with the
    corpus. ``weight_grad='shared'`` moves the weights of all documents by the batch mean,
    ``'per_doc'`` moves each document by its own gradient. ``metric`` is the distance between words
    where the ground cost is given by their vectors. ``domain='auto'`` trains in the log domain where the
    largest cost exceeds 500 times ``reg``.
    """

    num_topics: int = 4
    batch_size: int = 64
    epochs: int = 5
    reg: float = 0.1
    max_iter: int = 1000
    tol: float = 1e-8
    debias: bool = True
    loss: str = "linear"
    optimizer: str = "adam"
    lr: float = 0.005
    beta1: float = 0.9
    beta2: float = 0.999
    eps: float = 1e-8
    decay: float = 0.01
    weight_grad: str = "per_doc"
    seed: int = 0
    metric: str = "sqeuclidean"
    domain: str = "auto"

    def __post_init__(self):
        allowed = {
            "loss": ("squared", "linear", "regularized"),
            "optimizer": ("sgd", "adam", "adamw"),
            "weight_grad": ("per_doc", "shared"),
            "metric": ("sqeuclidean", "euclidean"),
            "domain": ("auto", "exp", "log"),
        }
        for name, values in allowed.items():
            if getattr(self, name) not in values:
                raise ValueError(f"{name} must be one of {values}")
        if min(self.num_topics, self.batch_size, self.epochs) < 1:
            raise ValueError("num_topics, batch_size and epochs must be positive")


@dataclass(frozen=True)
class TokenizerSpec:
    """Words to drop; none with an empty tuple."""

    stopwords: tuple[str, ...] = tuple(ENGLISH)


@dataclass(frozen=True)
class EmbeddingSpec:
    """Word vectors, used when no pretrained ones are given."""

    dim: int = 10
    iterations: int = 20
    min_count: int = 5
    window: int = 5
    partitions: int | None = None
    metric: str = "sqeuclidean"


@dataclass(frozen=True)
class IndexSpec:
    """All parameters of :func:`otindex.plans.index.wasserstein_index`."""

    dictionary: DictionarySpec = field(default_factory=DictionarySpec)
    tokenizer: TokenizerSpec = field(default_factory=TokenizerSpec)
    embedding: EmbeddingSpec = field(default_factory=EmbeddingSpec)
    oov: str = "bucket"
    period: str = "month"
    svd_method: str = "topics"
    standardize: bool = True

    def __post_init__(self):
        if self.svd_method not in ("topics", "docs"):
            raise ValueError("svd_method must be 'topics' or 'docs'")
