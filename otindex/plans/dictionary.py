"""Wasserstein dictionary learning: topics whose barycenters reproduce the documents.

Documents and their weights stay distributed. One optimizer step is one pass over one batch:
tasks fit their documents and add up topic gradients, Spark sums those, and the updates of topics
and weights are projections. Each step writes its documents to the shared folder and the next
epoch reads them from there, so a lost executor costs one step at most and no lineage builds up.
Steps follow each other, so where batches are too small to occupy several tasks, one task walks through
a run of a fixed number of them, and a job is spent on a run instead of several on every step.
Only the topics, whose size is the checked number of words times the number of topics, pass
through the driver, from which every step broadcasts them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from otindex.functions import scaling as sc
from otindex.operators import optim
from otindex.operators.gradients import (
    STATES,
    _stacking,
    _width,
    collect_topics,
    document_gradients,
    document_targets,
    gradient_rows,
    in_logarithms,
    softmax,
    topic_gradient,
    topic_matrix,
    training_kernel,
)
from otindex.operators.ground import chunks, collect_ground, tasks
from otindex.operators.linalg import softmax as softmax_table
from otindex.operators.svd import truncated_svd
from otindex.operators.text import pack
from otindex.operators.transport import Solution
from otindex.session import working_folder
from otindex.spec import DictionarySpec

#: Columns of a training history; the last three count the documents of a batch by solver status.
HISTORY = "step int, epoch int, batch int, loss double, converged bigint, max_iter bigint, nonfinite bigint"


#: Batches of up to so many numbers (documents x words x topics) are walked through in runs of so many steps.
RUN_VALUES, RUN_STEPS = 1_000_000, 256


@dataclass(frozen=True)
class DictionaryModel:
    """``topics (topic, word_id, p)``, ``weights (doc_id, weights)`` and ``history``, the mean
    loss of the finite documents per step and how many documents had which solver status."""

    topics: DataFrame
    weights: DataFrame
    history: DataFrame
    spec: DictionarySpec


def initial_logits(spec: DictionarySpec, key: str = "doc_id"):
    """Random starting weights of a document: fixed by seed and id."""
    return F.array(
        *(
            optim.standard_normal(spec.seed, F.lit("weight"), F.lit(k), F.col(key))
            for k in range(spec.num_topics)
        )
    )


def initial_topics(cost: DataFrame, spec: DictionarySpec) -> DataFrame:
    """``(topic, word_id, value, m, v)``: random logits and zero moments."""
    zero = F.lit(0.0)
    topics = F.explode(F.sequence(F.lit(0), F.lit(spec.num_topics - 1))).alias("topic")
    words = F.col("word_id" if "vec" in cost.columns else "i").cast("int").alias("word_id")
    return cost.select(words).distinct().select(
        topics, "word_id"
    ).select(
        "topic",
        "word_id",
        optim.standard_normal(spec.seed, F.lit("topic"), F.col("topic"), F.col("word_id")).alias("value"),
        zero.alias("m"),
        zero.alias("v"),
    )


def fit(
    distributions: DataFrame, cost: DataFrame, spec: DictionarySpec, verbose: bool = False, folder: str | None = None
) -> DictionaryModel:
    """Learn topics and weights from ``(doc_id, word_id, p)`` and the ground cost.

    The cost is ``(i, j, cost)``, which every task holds whole, or the words' vectors ``(word_id, vec)``
    with ``spec.metric`` between them: then no table of word pairs is made and the vocabulary may have any
    size whose vectors and topics fit a task.

    With a ``folder`` of the user's, on a store that all executors reach, a training that was broken off
    goes on after its last finished step when it is called again with the same arguments; so each step is
    then a job of its own, however small its batch.
    """
    spark = distributions.sparkSession
    training = _Training(spark, folder or working_folder(spark, "dictionary"), collect_ground(cost, spec.metric, spec.reg), spec)
    start = training.saved("start")
    if start is None:
        no_moments = F.array_repeat(F.lit(0.0), spec.num_topics)
        docs = pack(distributions, "doc_id", "word_id").select(
            "doc_id", "idx", "p", initial_logits(spec).alias("logits"),
            no_moments.alias("m"), no_moments.alias("v"),
        )
        # sorted by document and so by batch: a batch is a range of few files, whatever their number
        batched = optim.assign_batches(docs, spec.batch_size).drop("pos")
        start = training.keep(batched.repartitionByRange(tasks(docs), "batch", "doc_id").sortWithinPartitions("batch", "doc_id"), "start")
    training.columns = start.drop("batch").columns
    batches = (start.agg(F.max("batch")).first()[0] or 0) + 1
    training.begin(initial_topics(cost, spec), spec.epochs * batches)
    if folder is None and spec.batch_size * len(training.dense.ids) * spec.num_topics <= RUN_VALUES:
        for epoch in range(spec.epochs):
            for first in range(0, batches, RUN_STEPS):
                last = min(batches, first + RUN_STEPS)
                losses = training.run(training.documents(start, epoch, first, last), epoch)
                if verbose:
                    for batch, loss in zip(range(first, last), losses):
                        print(f"epoch {epoch + 1}/{spec.epochs} batch {batch + 1}/{batches} loss {loss:.6g}")
            training.close(epoch, batches)
        return training.model(spec.epochs - 1)
    done, rest = divmod(training.steps, batches)
    if done and not rest and training.saved(f"epoch-{done - 1}") is None:
        training.close(done - 1, batches)  # broken off between the last step of an epoch and its end
    for step in range(training.steps, spec.epochs * batches):
        epoch, batch = divmod(step, batches)
        loss = training.step(training.documents(start, epoch, batch), epoch, batch)
        if verbose:
            print(f"epoch {epoch + 1}/{spec.epochs} batch {batch + 1}/{batches} loss {loss:.6g}")
        if batch + 1 == batches:
            training.close(epoch, batches)
    return training.model(spec.epochs - 1)


class _Training:
    """The state of a training: one folder of documents per finished epoch, and per step the topics.

    Steps of the running epoch write folders of their own; a finished epoch is written as a whole, in as
    few files as its start, and is what the next one reads.
    """

    def __init__(self, spark, folder, dense, spec):
        self.spark, self.folder, self.dense, self.spec = spark, folder, dense, spec
        self.columns = self.topics = None
        self.steps = 0
        self.losses, self.runs = [], []
        self.offset = self._no_offset()

    def keep(self, table: DataFrame, name: str) -> DataFrame:
        table.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(table.schema).parquet(f"{self.folder}/{name}")

    def saved(self, name: str) -> DataFrame | None:
        """A table that was written to its end, or None."""
        try:
            self.spark.read.text(f"{self.folder}/{name}/_SUCCESS")
            return self.spark.read.parquet(f"{self.folder}/{name}")
        except AnalysisException:
            return None

    def begin(self, topics: DataFrame, steps: int) -> None:
        """Start with ``topics``, or with what the last finished step left."""
        low, high = 0, steps  # steps finish in order: the last one by bisection
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.saved(f"topics-{mid}") is not None else (low, mid - 1)
        if not low:
            self.topics = topics.toArrow()
            return
        history = [self.spark.read.parquet(f"{self.folder}/history-{k}").first() for k in range(1, low + 1)]
        self.steps, self.losses = low, [tuple(row) for row in history]
        self.topics = self.saved(f"topics-{low}").toArrow()
        if self.spec.weight_grad == "shared":
            self.offset = self.saved(f"offset-{low}")

    def documents(self, start: DataFrame, epoch: int, batch: int, end: int | None = None) -> DataFrame:
        """The documents of a batch or, with their batch, of those before ``end``."""
        rows = start if epoch == 0 else self.saved(f"epoch-{epoch - 1}")
        if end is not None:
            return rows.where(F.col("batch").between(batch, end - 1)).select(*self.columns, "batch")
        return rows.where(F.col("batch") == batch).select(*self.columns)

    def close(self, epoch: int, batches: int) -> None:
        """Write the documents of all batches of an epoch as one table."""
        paths = self.runs or [f"{self.folder}/step-{epoch}-{batch}" for batch in range(batches)]
        self.runs = []
        rows = self.spark.read.parquet(*paths).where("topic is null").select(*self.columns, "batch")
        count = tasks(rows)
        self.keep(rows.repartitionByRange(count, "batch", "doc_id").sortWithinPartitions("batch", "doc_id"), f"epoch-{epoch}")

    def step(self, docs: DataFrame, epoch: int, batch: int) -> float:
        spec = self.spec
        self.steps += 1
        logits = topic_matrix(self.topics, self.dense, "value")
        if spec.weight_grad == "shared":
            docs = docs.withColumn("own", F.col("logits")).withColumn("logits", self._shifted("logits"))
        rows = gradient_rows(docs.repartition(tasks(docs), "doc_id"), self.dense, logits, spec)
        if spec.weight_grad == "shared":
            rows = rows.withColumn("logits", F.col("own")).drop("own")
        else:
            rows = self._moved(rows, epoch + 1)
        rows = self.keep(rows.withColumn("batch", F.lit(batch)), f"step-{epoch}-{batch}")
        grads = topic_gradient(rows)
        state = self.spark.createDataFrame(self.topics)
        told = ["loss", sc.CONVERGED, sc.MAX_ITER, sc.NONFINITE]
        moved = self._update(state, grads, ["topic", "word_id"]).join(
            grads.select("topic", "word_id", *told), ["topic", "word_id"]
        )
        fetched = moved.toArrow()
        loss, *counts = (fetched.column(name)[0].as_py() for name in told)
        if loss is None:
            raise _no_finite(batch)
        self.topics = fetched.drop_columns(told)
        if spec.weight_grad == "shared":
            self._move_offset(rows)
        self.losses.append((self.steps, epoch, batch, loss, *counts))
        self.keep(self.spark.createDataFrame(self.losses[-1:], HISTORY).coalesce(1), f"history-{self.steps}")
        # written last: with it the step is finished
        self.keep(self.spark.createDataFrame(self.topics).coalesce(1), f"topics-{self.steps}")
        return loss

    def run(self, docs: DataFrame, epoch: int) -> list[float]:
        """The steps of consecutive small batches, in one task that holds one batch at a time."""
        spec, done = self.spec, self.steps
        shared, kind = self.dense.share(docs), type(self.dense)
        moments = ("value", "m", "v")
        topics = tuple(topic_matrix(self.topics, self.dense, name) for name in moments)
        offset = tuple(np.array([r[n] for r in self.offset.orderBy("topic").collect()]) for n in moments)
        model = self.spark.sparkContext.broadcast((topics, offset))
        width, whole = _stacking(len(self.dense.ids), spec.max_iter, spec.num_topics + 1, in_logarithms(self.dense, spec))
        common = spec.weight_grad == "shared"

        def walk(frames):
            ground, (topics, offset), step = kind(*shared.value), model.value, done
            K = training_kernel(ground, spec)
            for batch in _by_batch(frames):
                step += 1
                parts, gradient, lost = [], np.zeros_like(topics[0]), 0.0
                states = dict.fromkeys(STATES, 0)
                for rows in chunks([batch], width):
                    own = np.stack(rows["logits"].to_list())
                    targets, logits = document_targets(ground, rows), own + offset[0] if common else own
                    loss, by_weight, by_topic, status = document_gradients(ground, K, topics[0], logits, targets, spec, whole)
                    gradient, lost = gradient + by_topic, lost + np.nansum(loss)
                    for state in status:
                        states[state] += 1
                    parts.append((rows, own, by_weight))
                finite = sum(states.values()) - states[sc.NONFINITE]
                number = int(batch["batch"].iloc[0])
                told = {"batch": [number], "topic": [TOLD], "step": [step], "states": [list(states.values())]}
                yield pd.DataFrame({**_NOTHING, **told, "loss": [lost / finite if finite else None]})
                if not finite:
                    return
                for rows, own, by_weight in parts:
                    moved = own, *(np.stack(rows[n].to_list()) for n in "mv")
                    if not common:
                        moved = _moved_arrays(spec, epoch + 1, by_weight, *moved)
                    named = dict(zip(("logits", "m", "v"), map(list, moved)))
                    yield rows.assign(**named, topic=None, step=None, loss=None, states=None)
                if common:
                    mean = np.concatenate([by_weight for *_, by_weight in parts]).mean(axis=0)
                    offset = _moved_arrays(spec, step, mean, *offset)
                topics = _moved_arrays(spec, step, gradient / finite, *topics)
            for k in range(topics[0].shape[1]):
                yield _state_row(k, ground.ids, [x[:, k] for x in topics])
            yield _state_row(OFFSET, None, offset)

        key = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema)
        walked = docs.coalesce(1).sortWithinPartitions("batch", "doc_id").mapInPandas(
            walk, f"{key}, topic int, step int, loss double, states array<bigint>"
        )
        kept = self.keep(walked, name := f"step-{epoch}-run-{done}")
        self.runs.append(f"{self.folder}/{name}")
        told = kept.where("topic is not null").select("batch", "idx", "logits", "m", "v", "topic", "step", "loss", "states").collect()
        losses = []
        for row in sorted((r for r in told if r.topic == TOLD), key=lambda r: r.step):
            if row.loss is None:
                raise _no_finite(row.batch)
            self.steps = row.step
            self.losses.append((row.step, epoch, row.batch, row.loss, *row.states))
            losses.append(row.loss)
        states = sorted((r for r in told if r.topic >= 0), key=lambda r: r.topic)
        self.topics = pa.table(
            {"topic": pa.array(np.repeat([r.topic for r in states], [len(r.idx) for r in states]), pa.int32()),
             "word_id": pa.array(np.concatenate([r.idx for r in states]), pa.int32()),
             **{n: np.concatenate([r[c] for r in states]) for n, c in zip(moments, ("logits", "m", "v"))}}
        )
        last = next(r for r in told if r.topic == OFFSET)
        self.offset = self.spark.createDataFrame(
            [(k, *x) for k, x in enumerate(zip(last.logits, last.m, last.v))], "topic int, value double, m double, v double"
        )
        return losses

    def _update(self, state: DataFrame, grads: DataFrame, keys: list[str]) -> DataFrame:
        spec = self.spec
        if spec.optimizer == "sgd":
            moments = state.select(*keys, "m", "v")
            return optim.sgd_step(state, grads, keys, spec.lr).join(moments, keys)
        betas = (spec.beta1, spec.beta2, spec.eps)
        if spec.optimizer == "adam":
            return optim.adam_step(state, grads, keys, self.steps, spec.lr, *betas)
        return optim.adamw_step(state, grads, keys, self.steps, spec.lr, spec.decay, *betas)

    def _moved(self, rows: DataFrame, visit: int) -> DataFrame:
        """Each document's weights after a step along its own gradient, inside its row.

        A document is visited once per epoch; its moments are corrected for that many visits.
        """
        spec = self.spec

        def update(e):
            if spec.optimizer == "sgd":
                new = (e["logits"] - spec.lr * e["grad"], e["m"], e["v"])
            else:
                decay = spec.decay if spec.optimizer == "adamw" else 0.0
                new = optim.adam_columns(
                    e["logits"], e["grad"], e["m"], e["v"], visit, spec.lr,
                    spec.beta1, spec.beta2, spec.eps, decay,
                )
            return F.struct(*(c.alias(n) for c, n in zip(new, ("logits", "m", "v"))))

        moved = F.when(
            F.col("topic").isNull(),
            F.transform(F.arrays_zip("logits", "grad", "m", "v"), update),
        )
        rows = rows.withColumn("_moved", moved)
        for name in ("logits", "m", "v"):
            rows = rows.withColumn(name, F.col(f"_moved.{name}"))
        return rows.drop("_moved")

    # weights moved together differ from their starting values by one common vector

    def _no_offset(self) -> DataFrame:
        zero = F.lit(0.0)
        return self.spark.range(self.spec.num_topics).select(
            F.col("id").cast("int").alias("topic"), zero.alias("value"), zero.alias("m"), zero.alias("v")
        )

    def _shifted(self, name: str):
        shift = [row.value for row in self.offset.orderBy("topic").select("value").collect()]
        return F.zip_with(name, F.lit(shift), lambda x, y: x + y)

    def _move_offset(self, rows: DataFrame) -> None:
        exploded = rows.where("topic is null").select(F.posexplode("grad").alias("topic", "grad"))
        grads = optim.batch_mean(exploded, "topic")
        self.offset = self.keep(
            self._update(self.offset, grads, ["topic"]), f"offset-{self.steps}"
        )

    def model(self, epoch: int) -> DictionaryModel:
        final = self.saved(f"epoch-{epoch}")
        logits = self._shifted("logits") if self.spec.weight_grad == "shared" else F.col("logits")
        topics = self.spark.createDataFrame(self.topics).select(
            F.col("word_id").alias("i"), F.col("topic").alias("j"), "value"
        )
        return DictionaryModel(
            topics=softmax_table(topics).select(
                F.col("j").alias("topic"), F.col("i").alias("word_id"), F.col("value").alias("p")
            ),
            weights=final.select("doc_id", softmax_array(logits).alias("weights")),
            history=self.spark.createDataFrame(
                self.losses, HISTORY
            ),
            spec=self.spec,
        )


#: Rows of a run that are no documents: what a step tells, and the common vector behind the last step.
TOLD, OFFSET = -1, -2

_NOTHING = dict.fromkeys(("doc_id", "idx", "p", "logits", "m", "v", "batch", "topic", "step", "loss", "states"))


def _state_row(topic: int, words, state) -> pd.DataFrame:
    """Values and moments behind the last step of a run."""
    return pd.DataFrame({**_NOTHING, "topic": [topic], "idx": [words], **{n: [x] for n, x in zip(("logits", "m", "v"), state)}})


def _by_batch(frames):
    """Frames sorted by batch, cut and joined to one frame per batch."""
    held = None
    for frame in frames:
        held = frame if held is None else pd.concat([held, frame], ignore_index=True)
        cuts = [0, *(np.flatnonzero(np.diff(held["batch"].to_numpy())) + 1)]
        for start, end in zip(cuts, cuts[1:]):
            yield held.iloc[start:end]
        held = held.iloc[cuts[-1] :]
    if held is not None and len(held):
        yield held


def _moved_arrays(spec: DictionarySpec, t: int, grad, value, m, v):
    """``optim.adam_columns``, or a plain step, on arrays."""
    if spec.optimizer == "sgd":
        return value - spec.lr * grad, m, v
    decay = spec.decay if spec.optimizer == "adamw" else 0.0
    grad = grad + decay * value
    m, v = spec.beta1 * m + (1 - spec.beta1) * grad, spec.beta2 * v + (1 - spec.beta2) * grad * grad
    moved = spec.lr * (m / (1 - spec.beta1**t)) / (np.sqrt(v / (1 - spec.beta2**t)) + spec.eps)
    return value - moved - decay * value, m, v


def _no_finite(batch: int) -> RuntimeError:
    return RuntimeError(
        f"no document of batch {batch} has a finite loss: the kernel underflows; raise reg, scale the cost or train in the log domain"
    )


def softmax_array(logits):
    """Softmax of an array column."""
    lifted = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    total = F.aggregate(lifted, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(lifted, lambda x: x / total)


def topic_array(topics: DataFrame, dense) -> np.ndarray:
    """Topics as a words x topics array of probabilities."""
    return collect_topics(topics.withColumnRenamed("p", "logit"), dense)


def reconstruct(model: DictionaryModel, cost: DataFrame) -> DataFrame:
    """``(doc_id, word_id, p)``: each document's barycenter of the topics under its weights.

    Documents whose barycenter is not finite have no rows; see :func:`reconstruction`.
    """
    return reconstruction(model, cost).values


def reconstruction(model: DictionaryModel, cost: DataFrame) -> Solution:
    """The reconstructed documents and ``(doc_id, status, iterations, error)`` for every one."""
    spec = model.spec
    dense = collect_ground(cost, spec.metric, spec.reg)
    shared, kind = dense.share(cost), type(dense)
    topics = model.weights.sparkSession.sparkContext.broadcast(topic_array(model.topics, dense))
    width = _width(len(dense.ids), 1, 8 * spec.num_topics)

    def solve(batches):
        ground, A = kind(*shared.value), topics.value[:, None, :]
        K = training_kernel(ground, spec)
        for rows in chunks(batches, width):
            W = np.stack(rows["weights"].to_list())
            if K is None:
                with np.errstate(divide="ignore"):
                    smooth, log_a = sc.LogSmoothing(ground.matrix, spec.reg), np.log(topics.value)
                fitted, status, rounds, error = sc.log_barycenters(smooth, log_a, W, spec.max_iter, spec.tol, spec.debias)
                fitted = np.exp(fitted)
            else:
                fitted, status, rounds, error = sc.barycenters(K, A, W, spec.max_iter, spec.tol, spec.debias)
            none = np.empty(0)
            yield pd.DataFrame(
                {"doc_id": rows["doc_id"].to_numpy(),
                 "word_id": [ground.ids if r else none.astype(int) for r in rounds],
                 "p": [p if r else none for p, r in zip(fitted.T, rounds)],
                 "status": status, "iterations": rounds, "error": error}
            )

    key = model.weights.schema["doc_id"].dataType.simpleString()
    solved = model.weights.repartition(tasks(model.weights)).mapInPandas(
        solve,
        f"doc_id {key}, word_id array<int>, p array<double>, status string, iterations int, error double",
    )
    return Solution(
        solved.select("doc_id", F.inline(F.arrays_zip("word_id", "p"))),
        solved.select("doc_id", "status", "iterations", "error"),
    )


def predict(
    model: DictionaryModel, distributions: DataFrame, cost: DataFrame, steps: int = 50, lr: float = 0.1, tol: float = 1e-4
) -> DataFrame:
    """``(doc_id, weights, status, iterations)`` of new documents, fitted with the topics held fixed.

    Documents do not depend on each other, so each task fits its own in one pass. A document stops
    when a step moves none of its weights by ``tol`` (``converged``), after ``steps`` steps
    (``max_iter``), or as soon as its solver is not finite (``nonfinite``, with the weights so far).
    """
    spec = model.spec
    dense = collect_ground(cost, spec.metric, spec.reg)
    shared, kind = dense.share(cost), type(dense)
    with np.errstate(divide="ignore"):
        frozen = np.log(topic_array(model.topics, dense))
    topics = cost.sparkSession.sparkContext.broadcast(frozen)
    width, whole = _stacking(len(dense.ids), spec.max_iter, spec.num_topics + 1, in_logarithms(dense, spec))
    docs = pack(distributions, "doc_id", "word_id").withColumn("logits", initial_logits(spec))

    def solve(batches):
        ground = kind(*shared.value)
        K = training_kernel(ground, spec)
        for rows in chunks(batches, width):
            targets = document_targets(ground, rows)
            logits = np.stack(rows["logits"].to_list())
            m, v = np.zeros_like(logits), np.zeros_like(logits)
            status = np.full(len(rows), sc.MAX_ITER, dtype=object)
            taken, live = np.zeros(len(rows), int), np.arange(len(rows))
            for t in range(1, steps + 1):
                here = [targets[k] for k in live]
                _, grad, _, state = document_gradients(ground, K, topics.value, logits[live], here, spec, whole)
                broken = state == sc.NONFINITE
                status[live[broken]] = sc.NONFINITE
                live, grad = live[~broken], grad[~broken]
                m[live] = spec.beta1 * m[live] + (1 - spec.beta1) * grad
                v[live] = spec.beta2 * v[live] + (1 - spec.beta2) * grad**2
                ahead, spread = m[live] / (1 - spec.beta1**t), v[live] / (1 - spec.beta2**t)
                moved = logits[live] - lr * ahead / (np.sqrt(spread) + spec.eps)
                step = np.abs(softmax(moved, 1) - softmax(logits[live], 1)).max(axis=1, initial=0.0)
                logits[live], taken[live] = moved, t
                status[live[step < tol]] = sc.CONVERGED
                live = live[step >= tol]
                if not live.size:
                    break
            yield pd.DataFrame(
                {"doc_id": rows["doc_id"].to_numpy(), "weights": list(softmax(logits, 1)), "status": status, "iterations": taken}
            )

    key = distributions.schema["doc_id"].dataType.simpleString()
    return docs.repartition(tasks(docs), "doc_id").mapInPandas(
        solve, f"doc_id {key}, weights array<double>, status string, iterations int"
    )


def reconstruction_loss(predicted: DataFrame, actual: DataFrame) -> DataFrame:
    """``(doc_id, loss)``: summed squared gap between two tables ``(doc_id, word_id, p)``.

    Both are stacked with opposite signs and summed per coordinate, which is a full outer join
    without the join. For the transport loss use the transport operators.
    """
    stacked = predicted.select("doc_id", "word_id", "p").unionByName(
        actual.select("doc_id", "word_id", (-F.col("p")).alias("p"))
    )
    gaps = stacked.groupBy("doc_id", "word_id").agg(F.sum("p").alias("gap"))
    return gaps.groupBy("doc_id").agg(F.sum(F.col("gap") * F.col("gap")).alias("loss"))


def topic_scores(topics: DataFrame) -> DataFrame:
    """``(topic, score)``: the topics along their first singular direction."""
    matrix = topics.select(F.col("topic").alias("row_id"), F.col("word_id").alias("col"), F.col("p").alias("value"))
    return truncated_svd(matrix, 1).select(F.col("row_id").alias("topic"), F.col("value").alias("score"))


def document_scores(
    model: DictionaryModel, cost: DataFrame | None = None, svd_method: str = "topics"
) -> DataFrame:
    """``(doc_id, score)``: weighted topic scores, or the reconstructed documents along their
    first singular direction (``svd_method='docs'``, which needs the cost)."""
    if svd_method == "topics":
        return weighted_scores(model.weights, model.topics)
    if svd_method != "docs":
        raise ValueError("svd_method must be 'topics' or 'docs'")
    matrix = reconstruct(model, cost).select(
        F.col("doc_id").alias("row_id"), F.col("word_id").alias("col"), F.col("p").alias("value")
    )
    return truncated_svd(matrix, 1).select(F.col("row_id").alias("doc_id"), F.col("value").alias("score"))


def weighted_scores(weights: DataFrame, topics: DataFrame) -> DataFrame:
    """``(doc_id, score)`` from ``(doc_id, weights)``: one score per topic, applied in each row."""
    scores = [row.score for row in topic_scores(topics).orderBy("topic").collect()]
    products = F.zip_with("weights", F.lit(scores), lambda w, s: w * s)
    return weights.select(
        "doc_id", F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x).alias("score")
    )
