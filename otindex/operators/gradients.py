"""Derivatives of transport costs and barycenters, per problem, in Arrow batches.

All derivatives come from one reverse sweep through the rounds actually done, so they match the
result that was returned, converged or not. Spark spreads the problems and adds up gradients.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from otindex.functions import scaling as sc
from otindex.operators.ground import (
    EXP_RANGE,
    DenseCost,
    VectorCost,
    choose_domain,
    choose_strategy,
    chunks,
    collect_ground,
    tasks,
)
from otindex.operators.text import pack
from otindex.operators.transport import packed_pairs, sinkhorn, stack

#: Doubles a reverse sweep may keep for one stack of problems.
TRAIL_VALUES = 32_000_000

#: Doubles of what the rounds of a whole group's sweep may keep, and of one stack in the log domain.
KEPT_VALUES, LOG_VALUES = 4_000_000, 2_000_000

#: Words up to which documents are stacked whatever their supports.
STACKED_WORDS = 512

#: Doubles of one block of a Jacobian.
BLOCK_VALUES = 250_000

#: Solver statuses in the order of their counts.
STATES = (sc.CONVERGED, sc.MAX_ITER, sc.NONFINITE)

LOSSES = ("squared", "linear", "regularized")


def loss_and_slope(ground, K, P, targets, loss: str, eps: float, max_iter: int, tol: float):
    """Loss of each column of ``P`` against its target, its gradient with respect to ``P``, and status.

    ``targets`` has one pair of positions and shares per column. A target touches few words, and the loss
    needs the kernel only from all words to those: no product runs over all pairs of words, unless
    the targets fill so much of a small kernel that stacking them is cheaper. ``squared`` is the sum
    of squared gaps, ``linear`` the cost moved by the entropic plan and ``regularized`` that cost with
    its entropy term.
    """
    if loss not in LOSSES:
        raise ValueError(f"loss must be one of {LOSSES}")
    if loss == "squared":
        gap = P.copy()
        for c, (at, y) in enumerate(targets):
            gap[at, c] -= y
        return (gap**2).sum(axis=0), 2 * gap, np.full(P.shape[1], sc.CONVERGED, dtype=object)
    size = P.shape[0]
    if isinstance(K, np.ndarray) and (size <= STACKED_WORDS or sum(len(at) for at, _ in targets) * 4 > size * len(targets)):
        Y = np.zeros_like(P)
        for c, (at, y) in enumerate(targets):
            Y[at, c] = y
        return _moved(K, ground.finite, P, Y, loss, eps, max_iter, tol)
    value, slope, status = np.empty(P.shape[1]), np.empty_like(P), np.empty(P.shape[1], dtype=object)
    for c, (at, y) in enumerate(targets):
        part, cost = ground.kernel_columns(K, at), ground.cost_columns(at)
        one = _moved(part, cost, P[:, [c]], np.asarray(y, float)[:, None], loss, eps, max_iter, tol)
        value[c], slope[:, c], status[c] = one[0][0], one[1][:, 0], one[2][0]
    return value, slope, status


def _moved(K, C, P, Y, loss, eps, max_iter, tol):
    """Transport loss between columns of ``P`` and ``Y``, whose points are the rows and columns of ``K``."""
    trail = []
    U, V, status, *_ = sc.scale_pairs(K, P, Y, max_iter, tol, trail)
    KC = K * C
    Ubar, Vbar = KC @ V, KC.T @ U
    value = (U * Ubar).sum(axis=0)
    if loss == "regularized":
        # the derivative of cost + eps * mass * (log mass - 1) by the mass is f + g
        with np.errstate(divide="ignore"):
            f = np.where(U > 0, eps * np.log(U), 0.0)
            g = np.where(V > 0, eps * np.log(V), 0.0)
        KV, KU = K @ V, K.T @ U
        Ubar = f * KV + K @ (g * V)
        Vbar = K.T @ (f * U) + g * KU
        value = (U * Ubar).sum(axis=0) - eps * (U * KV).sum(axis=0)
    return value, sc.pairs_reverse(K, P, Y, trail, Ubar, Vbar), status


def sinkhorn_gradient(
    a: DataFrame, b: DataFrame, cost: DataFrame, eps: float, loss: str = "linear",
    max_iter: int = 1000, tol: float = 1e-8, domain: str = "auto",
) -> DataFrame:
    """``(problem_id, i, grad)``: derivative of the transport cost by the first histogram.

    One row per support point; that of a problem that is not finite is not a number or null. The
    derivative is centered within each problem, because mass can
    only move along directions that keep the total. In the log domain, which ``auto`` takes for costs beyond
    the reach of the kernel, the sweep runs back through the log updates. A cost too large for the
    tasks leaves the regularized loss, whose derivative at convergence is the potential itself.
    """
    if loss == "regularized" and choose_strategy("auto", cost) == "relational":
        potentials = sinkhorn(a, b, cost, eps, max_iter, tol, strategy="relational").values
        # a problem has at most one potential per word
        center = F.avg("potential").over(Window.partitionBy("problem_id"))
        return potentials.where("side = 'a'").select(
            "problem_id", F.col("idx").alias("i"), (F.col("potential") - center).alias("grad")
        )
    domain = choose_domain(domain, cost, eps)
    dense = DenseCost.collect(cost)
    shared = dense.share(a)
    width = _width(len(dense.ids), max_iter)

    def by_logarithms(ground, rows):
        for ia, pa, ib, pb in zip(rows["idx_a"], rows["p_a"], rows["idx_b"], rows["p_b"]):
            C = ground.block(ground.at(ia), ground.at(ib))
            _, by_log, status = sc.log_pair_gradient(C, np.asarray(pa), np.asarray(pb), loss, eps, max_iter, tol)
            yield np.full(len(pa), np.nan) if status == sc.NONFINITE else by_log / np.asarray(pa)

    def solve(batches):
        ground = DenseCost(*shared.value)
        K = ground.kernel(eps) if domain == "exp" else None
        for rows in chunks(batches, width):
            if K is None:
                grads = list(by_logarithms(ground, rows))
                yield _centered(rows, grads)
                continue
            A = stack(ground, rows, "a")
            targets = [(ground.at(i), np.asarray(p)) for i, p in zip(rows["idx_b"], rows["p_b"])]
            _, slope, status = loss_and_slope(ground, K, A, targets, loss, eps, max_iter, tol)
            slope[:, status == sc.NONFINITE] = np.nan
            yield _centered(rows, [slope[ground.at(ia), s] for s, ia in enumerate(rows["idx_a"])])

    key = a.schema["problem_id"].dataType.simpleString()
    solved = packed_pairs(a, b).mapInPandas(
        solve, f"problem_id {key}, i array<int>, grad array<double>"
    )
    return solved.select("problem_id", F.inline(F.arrays_zip("i", "grad")))


def _centered(rows: pd.DataFrame, grads: list) -> pd.DataFrame:
    return pd.DataFrame(
        {"problem_id": rows["problem_id"].to_numpy(), "i": rows["idx_a"].to_numpy(), "grad": [g - g.mean() for g in grads]}
    )


def _width(words: int, rounds: int, per_word: int = 3) -> int:
    """Problems of one stack, so that what a reverse sweep keeps of every round stays within bounds."""
    return max(1, TRAIL_VALUES // (words * max(1, rounds) * per_word))


def _stacking(words: int, rounds: int, per_word: int, logarithms: bool = False) -> tuple[int, bool]:
    """Documents of one stack, and whether every round is kept: otherwise one state per check of the
    error is, and the rounds between are run again. With ``logarithms`` a stack is narrower, as a sweep
    then keeps eight arrays of each round between two checks."""
    if logarithms:
        kept = 8 * min(max(1, rounds), sc.CHECK_EVERY) + rounds // sc.CHECK_EVERY
        return max(1, LOG_VALUES // (words * kept * per_word)), False
    if words * max(1, rounds) * per_word <= TRAIL_VALUES:
        return _width(words, rounds, per_word), True
    return _width(words, rounds // sc.CHECK_EVERY + sc.CHECK_EVERY, per_word), False


def sinkhorn_jacobian(
    a: DataFrame, b: DataFrame, cost: DataFrame, eps: float, max_iter: int = 1000, tol: float = 1e-8
) -> DataFrame:
    """``(problem_id, side, out, in, value)``: derivatives of the scalings ``u`` (side a) and
    ``v`` (side b) by the first histogram.

    A problem is solved once; unit vectors of its outputs sweep back in blocks of bounded size, whose
    rows are handed on block by block. The result is a row per pair of support points and side.
    """
    dense = DenseCost.collect(cost)
    shared = dense.share(a)

    def solve(batches):
        ground = DenseCost(*shared.value)
        for row in (r for batch in batches for r in batch.itertuples(index=False)):
            ia, ib = ground.at(row.idx_a), ground.at(row.idx_b)
            K = np.exp(-ground.block(ia, ib) / eps)
            A, B = np.asarray(row.p_a, float)[:, None], np.asarray(row.p_b, float)[:, None]
            trail = []
            sc.scale_pairs(K, A, B, max_iter, tol, trail)
            # one sweep for the outputs of both sides, those of a first
            outputs, on_a = np.concatenate([ia, ib]), len(ia)
            for some in _unit_blocks(len(outputs), max(on_a, len(ib))):
                bars = [np.zeros((len(x), len(some))) for x in (ia, ib)]
                first = some < on_a
                bars[0][some[first], np.flatnonzero(first)] = 1.0
                bars[1][some[~first] - on_a, np.flatnonzero(~first)] = 1.0
                J = sc.pairs_reverse(K, A, B, trail, *bars)
                yield pd.DataFrame(
                    {
                        "problem_id": row.problem_id,
                        "side": np.repeat(np.where(first, "a", "b").astype(object), on_a),
                        "out": np.repeat(ground.ids[outputs[some]], on_a),
                        "in": np.tile(ground.ids[ia], len(some)),
                        "value": J.T.ravel(),
                    }
                )

    key = a.schema["problem_id"].dataType.simpleString()
    return packed_pairs(a, b).mapInPandas(
        solve, f"problem_id {key}, side string, out int, in int, value double"
    )


def _unit_blocks(outputs: int, per_output: int):
    """Ranges of outputs whose sweep holds at most ``BLOCK_VALUES`` numbers, or one output."""
    step = max(1, BLOCK_VALUES // max(1, per_output))
    for at in range(0, outputs, step):
        yield np.arange(at, min(outputs, at + step))


def barycenter_jacobian(
    atoms: DataFrame, weights: DataFrame, cost: DataFrame, eps: float, wrt: str = "weights",
    debias: bool = False, max_iter: int = 1000, tol: float = 1e-8,
) -> DataFrame:
    """Derivatives of a group's barycenter.

    A group is solved once, in one task; unit vectors of its outputs sweep back in blocks of bounded
    size, whose rows are handed on block by block. ``wrt='weights'`` gives ``(group_id, out, member, value)``, ``wrt='atoms'`` gives
    ``(group_id, out, member, in, value)``.
    """
    if wrt not in ("weights", "atoms"):
        raise ValueError("wrt must be 'weights' or 'atoms'")
    shared = DenseCost.collect(cost).share(atoms)
    packed = atoms.groupBy("group_id", "member").agg(
        F.collect_list("idx").alias("idx"), F.collect_list("p").alias("p")
    )
    grouped = (
        packed.join(weights, ["group_id", "member"])
        .groupBy("group_id")
        .agg(F.array_sort(F.collect_list(F.struct("member", "weight", "idx", "p"))).alias("all"))
        .select(
            "group_id",
            F.col("all.member").alias("member"),
            F.col("all.weight").cast("array<double>").alias("weight"),
            F.col("all.idx").alias("idx"),
            F.col("all.p").alias("p"),
        )
        .repartition(tasks(atoms), "group_id")
    )

    def solve(batches):
        ground = DenseCost(*shared.value)
        K, size = ground.kernel(eps), len(ground.ids)
        for row in (r for batch in batches for r in batch.itertuples(index=False)):
            A = np.stack([ground.column(i, p) for i, p in zip(row.idx, row.p)], axis=1)[:, None, :]
            W, members = np.asarray(row.weight)[None], np.asarray(row.member)
            trail = []
            sc.barycenters(K, A, W, max_iter, tol, debias, trail, whole=A.size * max_iter <= KEPT_VALUES)
            for some in _unit_blocks(size, A.size):
                unit = np.zeros((size, len(some)))
                unit[some, np.arange(len(some))] = 1.0
                Abar, Wbar = sc.barycenters_reverse(K, A, W, trail, unit, debias)
                if wrt == "weights":
                    yield pd.DataFrame(
                        {
                            "group_id": row.group_id,
                            "out": np.repeat(ground.ids[some], len(members)),
                            "member": np.tile(members, len(some)),
                            "value": Wbar.ravel(),
                        }
                    )
                else:
                    for k, out in enumerate(ground.ids[some]):
                        step = max(1, BLOCK_VALUES // size)
                        for at in range(0, len(members), step):
                            part = members[at : at + step]
                            yield pd.DataFrame(
                                {
                                    "group_id": row.group_id,
                                    "out": np.full(len(part) * size, out),
                                    "member": np.repeat(part, size),
                                    "in": np.tile(ground.ids, len(part)),
                                    "value": Abar[:, k, at : at + step].T.ravel(),
                                }
                            )

    group, member = (atoms.schema[c].dataType.simpleString() for c in ("group_id", "member"))
    inner = "" if wrt == "weights" else ", in int"
    return grouped.mapInPandas(solve, f"group_id {group}, out int, member {member}{inner}, value double")


# --- dictionary gradients --------------------------------------------------------------------


def softmax(x, axis):
    lifted = np.exp(x - x.max(axis=axis, keepdims=True))
    return lifted / lifted.sum(axis=axis, keepdims=True)


def through_softmax(y, bar, axis):
    """Chain a gradient through a softmax with values ``y``."""
    return y * (bar - (y * bar).sum(axis=axis, keepdims=True))


def document_gradients(ground, K, topic_logits, logits, targets, settings, whole: bool = True):
    """Loss and gradients of a few documents: by their own weights and, summed, by the topics; status.

    ``targets`` are the documents' words and shares as in :func:`loss_and_slope`.

    A document whose barycenter or loss is not finite says so in its status; its loss is null, its
    weights get no gradient and the topics none from it. ``settings`` has ``loss``, ``reg``, ``max_iter``, ``tol`` and ``debias``; parameters are
    logits, the softmax of which are topics and weights.
    """
    A, W = softmax(topic_logits, 0), softmax(logits, 1)
    if K is None:
        return _log_document_gradients(ground, topic_logits, A, W, targets, settings)
    trail = []
    fitted, status, *_ = sc.barycenters(
        K, A[:, None, :], W, settings.max_iter, settings.tol, settings.debias, trail, whole=whole
    )
    value, slope, moved = loss_and_slope(
        ground, K, fitted, targets, settings.loss, settings.reg, settings.max_iter, settings.tol
    )
    status = np.where(status == sc.CONVERGED, moved, status)
    broken = (status == sc.NONFINITE) | (moved == sc.NONFINITE) | ~np.isfinite(value)
    status[broken], value[broken], slope[:, broken] = sc.NONFINITE, np.nan, 0.0
    Abar, Wbar = sc.barycenters_reverse(K, A[:, None, :], W, trail, slope, settings.debias)
    return value, through_softmax(W, Wbar, 1), through_softmax(A, Abar.sum(axis=1), 0), status


def _log_document_gradients(ground, topic_logits, A, W, targets, settings):
    """The same in the log domain, for costs whose kernel underflows."""
    eps, rounds, tol = settings.reg, settings.max_iter, settings.tol
    smooth = sc.LogSmoothing(ground.matrix, eps)
    log_a = topic_logits - sc.lse(topic_logits, 0)[None, :]
    trail = []
    log_b, status, *_ = sc.log_barycenters(smooth, log_a, W, rounds, tol, settings.debias, trail)
    fitted = np.exp(log_b)
    value, bar = np.full(len(W), np.nan), np.zeros_like(log_b)
    for c, (at, y) in enumerate(targets):
        if status[c] == sc.NONFINITE:
            continue
        if settings.loss == "squared":
            gap = fitted[:, c].copy()
            gap[at] -= y
            value[c], bar[:, c] = (gap**2).sum(), 2 * gap * fitted[:, c]
            continue
        cost = ground.cost_columns(at)
        value[c], bar[:, c], moved = sc.log_pair_gradient(cost, fitted[:, c], np.asarray(y, float), settings.loss, eps, rounds, tol)
        status[c] = moved if status[c] == sc.CONVERGED or moved == sc.NONFINITE else status[c]
    broken = ~np.isfinite(value)
    status[broken], bar[:, broken] = sc.NONFINITE, 0.0
    Abar, Wbar = sc.log_barycenters_reverse(smooth, log_a, W, trail, bar, settings.debias)
    total = Abar.sum(axis=1)
    return value, through_softmax(W, Wbar, 1), total - A * total.sum(axis=0, keepdims=True), status


def training_kernel(ground, settings):
    """The kernel of a task, or None where the settings or the size of the cost ask for the log domain."""
    domain = getattr(settings, "domain", "auto")
    if isinstance(ground, VectorCost):  # every word is near itself, so no sum of the kernel vanishes
        if domain == "log":
            raise ValueError("the log domain needs the cost as (i, j, cost)")
        return ground.kernel(settings.reg)
    return None if in_logarithms(ground, settings) else ground.kernel(settings.reg)


def in_logarithms(ground, settings) -> bool:
    """Whether the settings or the size of a cost table ask for the log domain."""
    domain = getattr(settings, "domain", "auto")
    if isinstance(ground, VectorCost):
        return False
    return domain == "log" or (domain == "auto" and ground.finite.max(initial=0.0) / settings.reg > EXP_RANGE)


def batch_gradient(
    distributions: DataFrame, topics: DataFrame, weights: DataFrame, cost: DataFrame, settings
) -> tuple[DataFrame, DataFrame]:
    """Gradients of the mean loss of a batch by topic logits and by each document's logits.

    ``distributions`` is ``(doc_id, word_id, p)``; ``cost`` is ``(i, j, cost)`` or ``(word_id, vec)``; ``topics`` is ``(topic, word_id, logit)`` and
    ``weights`` is ``(doc_id, logits)``. Returns ``(topic, word_id, grad)``, averaged over the
    finite documents of the batch, and ``(doc_id, loss, grad, status)``. Each task adds up its documents
    before the shuffle.
    """
    dense = collect_ground(cost, eps=settings.reg)
    logits = collect_topics(topics, dense)
    docs = pack(distributions, "doc_id", "word_id").join(weights, "doc_id")
    rows = gradient_rows(docs.repartition(tasks(docs), "doc_id"), dense, logits, settings)
    return topic_gradient(rows).select("topic", "word_id", "grad"), rows.where("topic is null").select(
        "doc_id", "loss", "grad", "status"
    )


def collect_topics(topics: DataFrame, dense) -> np.ndarray:
    """Topic logits as a words x topics array; bounded by the checked number of words."""
    return topic_matrix(topics.select("topic", "word_id", "logit").toArrow(), dense)


def topic_matrix(table, dense, value: str = "logit") -> np.ndarray:
    """The same from an Arrow table."""
    topic, word, logit = (table.column(n).to_numpy() for n in ("topic", "word_id", value))
    out = np.zeros((len(dense.ids), int(topic.max()) + 1))
    out[dense.at(word), topic] = logit
    return out


def document_targets(ground, rows) -> list:
    """The words and shares of packed documents, as positions."""
    return [(ground.at(i), np.asarray(p)) for i, p in zip(rows["idx"], rows["p"])]


def gradient_rows(docs: DataFrame, dense, topic_logits: np.ndarray, settings) -> DataFrame:
    """The packed documents ``(doc_id, idx, p, logits, ...)`` with their loss and weight gradient, and
    per task and topic one row with the summed loss and topic gradient.

    ``topic`` is null in document rows; in topic rows ``idx`` and ``grad`` run over all words, ``docs``
    counts the documents that were finite and ``states`` those of each solver status.
    """
    shared, kind = dense.share(docs), type(dense)
    model = docs.sparkSession.sparkContext.broadcast(topic_logits)
    width, whole = _stacking(len(dense.ids), settings.max_iter, topic_logits.shape[1] + 1, in_logarithms(dense, settings))

    def solve(batches):
        ground, topics = kind(*shared.value), model.value
        K = training_kernel(ground, settings)
        gradient, lost, states, names = np.zeros_like(topics), 0.0, dict.fromkeys(STATES, 0), None
        for rows in chunks(batches, width):
            targets, logits = document_targets(ground, rows), np.stack(rows["logits"].to_list())
            loss, by_weight, by_topic, status = document_gradients(ground, K, topics, logits, targets, settings, whole)
            by_doc = rows.assign(topic=None, docs=1, loss=loss, grad=list(by_weight), status=status, states=None)
            gradient, lost, names = gradient + by_topic, lost + np.nansum(loss), by_doc.columns
            for state in status:
                states[state] += 1
            yield by_doc
        if names is None:
            return
        count = gradient.shape[1]
        sums = {"idx": [ground.ids] * count, "topic": range(count), "docs": sum(states.values()) - states[sc.NONFINITE],
                "loss": lost, "grad": list(gradient.T), "states": [list(states.values())] * count}
        yield pd.DataFrame({**dict.fromkeys(names), **sums})

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInPandas(
        solve, f"{fields}, topic int, docs bigint, loss double, grad array<double>, status string, states array<bigint>"
    )


def topic_gradient(rows: DataFrame) -> DataFrame:
    """``(topic, word_id, grad, loss, converged, max_iter, nonfinite)``: the tasks' sums over the number of
    finite documents (null for none), and how many documents ended with each status."""
    return (
        rows.where("topic is not null")
        .select("topic", "docs", "loss", "states", F.inline(F.arrays_zip(F.col("idx").alias("word_id"), "grad")))
        .groupBy("topic", "word_id")
        .agg(
            F.try_divide(F.sum("grad"), F.sum("docs")).alias("grad"),
            F.try_divide(F.sum("loss"), F.sum("docs")).alias("loss"),
            *(F.sum(F.col("states")[k]).alias(name) for k, name in enumerate(STATES)),
        )
    )
