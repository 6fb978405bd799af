"""The ground cost as Spark tasks need it: a joinable kernel table or a bounded dense array."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from otindex.functions.kernel import VectorKernel, distances, factorize
from otindex.session import at_most, broadcast_if_small

#: Largest number of words for which tasks receive the cost as an array (128 MB of doubles).
DENSE_WORDS = 4096

#: Largest number of vector entries that travels to every task (512 MB of doubles).
VECTOR_VALUES = 64_000_000

#: Beyond this ratio of cost to eps the kernel underflows and the log domain is needed.
EXP_RANGE = 500.0


def choose_domain(domain: str, cost: DataFrame, eps: float) -> str:
    """Resolve ``auto`` by the largest cost in units of ``eps``."""
    if domain not in ("auto", "exp", "log"):
        raise ValueError("domain must be 'auto', 'exp' or 'log'")
    if domain != "auto":
        return domain
    top = cost.agg(F.max("cost")).first()[0]
    return "log" if top is not None and top / eps > EXP_RANGE else "exp"


def choose_strategy(strategy: str, cost: DataFrame) -> str:
    """Resolve ``auto``: Arrow batches while the cost fits every task, else joins."""
    if strategy not in ("auto", "batched", "relational"):
        raise ValueError("strategy must be 'auto', 'batched' or 'relational'")
    fits = strategy != "relational" and at_most(cost, DENSE_WORDS * DENSE_WORDS)
    if strategy == "batched" and not fits:
        raise ValueError(f"the cost exceeds {DENSE_WORDS} x {DENSE_WORDS}; use 'relational'")
    return "batched" if fits else "relational"


def kernel_table(cost: DataFrame, eps: float) -> DataFrame:
    """``(i, j, c, k)`` with ``c = cost / eps`` and ``k = exp(-c)``; broadcast only if small."""
    scaled = (F.col("cost") / eps).alias("c")
    return broadcast_if_small(cost.select("i", "j", scaled).withColumn("k", F.exp(-F.col("c"))))


class _Indexed:
    """Index values ``ids`` in rising order, and the places of some of them."""

    ids: np.ndarray

    def at(self, idx) -> np.ndarray:
        """Positions of index values, all of which must occur in the cost."""
        idx = np.asarray(idx)
        found = np.minimum(np.searchsorted(self.ids, idx), len(self.ids) - 1)
        if not np.array_equal(self.ids[found], idx):
            raise ValueError("a histogram uses an index that the cost does not have")
        return found

    def column(self, idx, p) -> np.ndarray:
        """A dense histogram from its sparse arrays."""
        out = np.zeros(len(self.ids))
        out[self.at(idx)] = p
        return out


@dataclass
class DenseCost(_Indexed):
    """Sorted index values and the cost between them; travels to tasks as a broadcast."""

    ids: np.ndarray
    matrix: np.ndarray
    _shared: Broadcast | None = None

    @classmethod
    def collect(cls, cost: DataFrame, limit: int = DENSE_WORDS) -> DenseCost:
        """Fetch a cost table whose size is checked first; absent pairs cost infinity."""
        if not at_most(cost, limit * limit):
            raise ValueError(f"the cost exceeds {limit} x {limit} entries")
        table = cost.select("i", "j", "cost").toArrow()
        i, j, value = (table.column(name).to_numpy() for name in ("i", "j", "cost"))
        ids = np.union1d(i, j)
        matrix = np.full((len(ids), len(ids)), np.inf)
        matrix[np.searchsorted(ids, i), np.searchsorted(ids, j)] = value
        return cls(ids, matrix)

    def share(self, df: DataFrame) -> Broadcast:
        """Broadcast the arrays, once; rebuild with ``type(ground)(*shared.value)`` inside a task."""
        if self._shared is None:
            self._shared = df.sparkSession.sparkContext.broadcast((self.ids, self.matrix))
        return self._shared

    @cached_property
    def finite(self) -> np.ndarray:
        return np.where(np.isfinite(self.matrix), self.matrix, 0.0)

    def kernel(self, eps: float) -> np.ndarray:
        return np.exp(-self.matrix / eps)

    def kernel_columns(self, K: np.ndarray, at: np.ndarray) -> np.ndarray:
        return K[:, at]

    def cost_columns(self, at: np.ndarray) -> np.ndarray:
        """The cost from everywhere to some positions, zero where it is infinite."""
        return self.finite[:, at]

    def block(self, i, j) -> np.ndarray:
        """The cost between two sets of positions."""
        return self.matrix[np.ix_(i, j)]


@dataclass
class VectorCost(_Indexed):
    """Sorted index values and their vectors: the cost between them is their distance.

    Tasks make what they need of the cost from the vectors, which travel as a broadcast of words times
    dimensions; the table of all pairs exists nowhere.
    """

    ids: np.ndarray
    vectors: np.ndarray
    rooted: bool = False
    factor: tuple | None = None
    _shared: Broadcast | None = None

    @classmethod
    def collect(cls, vectors: DataFrame, metric: str = "sqeuclidean", eps: float | None = None) -> VectorCost:
        """Fetch ``(word_id, vec)``, at most ``VECTOR_VALUES`` numbers; ``eps`` also prepares the kernel's factor."""
        size = vectors.agg(F.count("*"), F.max(F.size("vec"))).first()
        if (size[0] or 0) * (size[1] or 0) > VECTOR_VALUES:
            raise ValueError(f"the vectors exceed {VECTOR_VALUES} numbers; take fewer dimensions or words")
        table = vectors.select(F.col("word_id").cast("int").alias("word_id"), F.col("vec").cast("array<double>").alias("vec")).toArrow()
        ids = table.column("word_id").to_numpy()
        rows = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        order = np.argsort(ids)
        ids, rows = ids[order], rows[order]
        if len(np.unique(ids)) < len(ids):
            raise ValueError("a word has more than one vector")
        factor = factorize(rows, eps, metric == "euclidean") if eps else None
        return cls(ids, rows, metric == "euclidean", factor)

    def share(self, df: DataFrame) -> Broadcast:
        if self._shared is None:
            self._shared = df.sparkSession.sparkContext.broadcast((self.ids, self.vectors, self.rooted, self.factor))
        return self._shared

    def kernel(self, eps: float) -> VectorKernel:
        return VectorKernel(self.vectors, eps, self.rooted, *(self.factor or ()))

    def kernel_columns(self, K: VectorKernel, at: np.ndarray) -> np.ndarray:
        return K.columns(at)

    def cost_columns(self, at: np.ndarray) -> np.ndarray:
        return distances(self.vectors, self.vectors[at], self.rooted)

    def block(self, i, j) -> np.ndarray:
        return distances(self.vectors[i], self.vectors[j], self.rooted)


def collect_ground(cost: DataFrame, metric: str = "sqeuclidean", eps: float | None = None):
    """The ground cost for tasks: from ``(word_id, vec)`` by ``metric``, or from ``(i, j, cost)``."""
    if "vec" in cost.columns:
        return VectorCost.collect(cost, metric, eps)
    return DenseCost.collect(cost)


def tasks(df: DataFrame) -> int:
    """Partitions for compute-heavy Arrow stages: row sizes say nothing about their work, so
    they are spread over the configured shuffle partitions rather than merged by size."""
    spark = df.sparkSession
    return max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        spark.sparkContext.defaultParallelism,
    )


def chunks(batches, rows: int):
    """Cut Arrow batches into pandas frames of at most ``rows`` rows."""
    for batch in batches:
        for start in range(0, len(batch), rows):
            yield batch.iloc[start : start + rows]
