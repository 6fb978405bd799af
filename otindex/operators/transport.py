"""Entropic optimal transport for tables of problems.

A problem is a pair of histograms ``(problem_id, idx, p)``. Two strategies give the same
potentials, rounds and status, as both look at errors after the same rounds:

* ``batched``: each problem is one row with arrays; tasks stack the problems of an Arrow chunk
  and iterate with dense matrix products. Needs a cost table small enough for every task.
* ``relational``: each round is a join with the kernel table, a grouped sum and a join with the
  marginals. Vectors are partitioned by problem before the kernel join. While the kernel table can
  be broadcast the joined rows are summed where they arise and only vectors are exchanged; a
  larger kernel is joined by a shuffle of the joined rows, and is quadratic in the vocabulary.

Potentials are ``f = eps * log u`` and ``g = eps * log v`` in both the exp and the log domain.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from otindex.functions import scaling as sc
from otindex.functions.kernel import PairKernel
from otindex.operators.ground import (
    EXP_RANGE,
    DenseCost,
    VectorCost,
    choose_domain,
    choose_strategy,
    chunks,
    collect_ground,
    kernel_table,
    tasks,
)
from otindex.operators.text import pack
from otindex.session import BROADCAST_ROWS, SALTS, broadcast_if_small, materialize

#: Status of a problem with a histogram without mass.
EMPTY = "empty"

#: Doubles one task may hold for one stack of problems.
STACK_VALUES = 4_000_000

#: Largest cost in units of ``eps`` up to which sums of one vector may share a shift: exp(-600) is a normal double.
LEVEL_RANGE = 600.0


@dataclass(frozen=True)
class Solution:
    """Result rows and one status row per problem; for transport also both costs per problem."""

    values: DataFrame
    status: DataFrame
    costs: DataFrame | None = None


def _attach(link: DataFrame, dist: DataFrame, side: str) -> DataFrame:
    """Put the packed histogram of ``{side}_id`` on every row of ``link``.

    Many rows may share one histogram. Histograms are packed to one row each and either broadcast
    after a size check or joined on a salted key, so an id used by a third of all pairs is spread
    over tasks.
    """
    packed = materialize(pack(dist.where(F.col("p") > 0), "id", "idx")).select(
        F.col("id").alias(f"{side}_id"), F.col("idx").alias(f"idx_{side}"), F.col("p").alias(f"p_{side}")
    )
    entries = packed.agg(F.sum(F.size(f"idx_{side}"))).first()[0] or 0
    if entries <= BROADCAST_ROWS:
        return link.join(F.broadcast(packed), f"{side}_id")
    salt = F.pmod(F.xxhash64("problem_id"), F.lit(SALTS)).cast("int")
    copies = packed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return link.withColumn("_salt", salt).join(copies, [f"{side}_id", "_salt"]).drop("_salt")


def pair_problems(
    pairs: DataFrame, dist_a: DataFrame, dist_b: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Histograms ``(problem_id, idx, p)`` of both sides of ``pairs(problem_id, a_id, b_id)``.

    Distributions are ``(id, idx, p)``.
    """
    return tuple(
        _attach(pairs.select("problem_id", f"{side}_id"), dist, side).select(
            "problem_id",
            F.inline(F.arrays_zip(F.col(f"idx_{side}").alias("idx"), F.col(f"p_{side}").alias("p"))),
        )
        for side, dist in (("a", dist_a), ("b", dist_b))
    )


def check_indices(cost: DataFrame, a: DataFrame, b: DataFrame) -> None:
    """Every index that carries mass must occur in the cost: ``a`` as i, ``b`` as j, or have a vector."""
    for side, name in ((a, "i"), (b, "j")):
        used = side.where(F.col("p") > 0).select(F.col("idx").alias(name)).distinct()
        known = cost.select(F.col("word_id" if "vec" in cost.columns else name).alias(name))
        if not used.join(known, name, "left_anti").isEmpty():
            raise ValueError("a histogram uses an index that the cost does not have")


def sinkhorn_pairs(
    pairs: DataFrame,
    dist_a: DataFrame,
    dist_b: DataFrame,
    cost: DataFrame,
    eps: float,
    max_iter: int = 1000,
    tol: float = 1e-8,
    domain: str = "auto",
    strategy: str = "auto",
    check_every: int = 10,
) -> Solution:
    """Solve ``pairs(problem_id, a_id, b_id)`` of histograms ``(id, idx, p)``; see :func:`sinkhorn`.

    ``cost`` is ``(i, j, cost)``, or ``(word_id, vec)`` for the squared distance between vectors. From vectors a
    task makes only the costs between the words of a pair, so histograms may come from any vocabulary;
    such pairs are solved in the batched layout and ``domain='auto'`` looks at each pair's own costs.
    A pair with a histogram that is missing or has no mass has no potentials and the status ``empty``.
    In the batched strategy a pair is one small row when it is spread over the tasks; a shared
    histogram that can be broadcast joins it there and is never shuffled once per pair.
    """
    from_vectors = "vec" in cost.columns
    domain = domain if from_vectors else choose_domain(domain, cost, eps)
    if from_vectors and strategy == "relational":
        raise ValueError("vectors need the batched strategy")
    if from_vectors or choose_strategy(strategy, cost) == "batched":
        check_indices(cost, dist_a, dist_b)
        spread = pairs.repartition(tasks(pairs), "problem_id")
        packed = _attach(_attach(spread, dist_a, "a"), dist_b, "b")
        solution = _batched(packed, cost, eps, max_iter, tol, domain, check_every)
    else:
        a, b = pair_problems(pairs, dist_a, dist_b)
        solution = sinkhorn(a, b, cost, eps, max_iter, tol, domain, "relational", check_every)
    empty = F.coalesce("status", F.lit(EMPTY)).alias("status")
    rounds = F.coalesce("iterations", F.lit(0)).alias("iterations")
    status = pairs.select("problem_id").join(solution.status, "problem_id", "left")
    return Solution(solution.values, status.select("problem_id", empty, rounds, "error"), solution.costs)


def sinkhorn(
    a: DataFrame,
    b: DataFrame,
    cost: DataFrame,
    eps: float,
    max_iter: int = 1000,
    tol: float = 1e-8,
    domain: str = "auto",
    strategy: str = "auto",
    check_every: int = 10,
) -> Solution:
    """Solve every problem; ``values`` is ``(problem_id, side, idx, potential)``.

    ``max_iter`` is the exact number of rounds where nothing converges; the error is the norm of
    the gap in the first marginal, looked at every ``check_every`` rounds in either strategy. Status
    is ``converged``, ``max_iter`` or ``nonfinite``: that one keeps the potentials and the number of
    rounds of the check before (zeros and 0 at first), with an infinite error. An index that the
    cost lacks is an error, and a problem without mass on one side has no rows.
    """
    domain = choose_domain(domain, cost, eps)
    check_indices(cost, a, b)
    if choose_strategy(strategy, cost) == "batched":
        return _batched(packed_pairs(a, b), cost, eps, max_iter, tol, domain, check_every)
    a, b = (t.where(F.col("p") > 0) for t in (a, b))
    ids = a.select("problem_id").distinct().join(b.select("problem_id").distinct(), "problem_id")
    a, b = (t.join(ids, "problem_id", "left_semi") for t in (a, b))
    if tol > 0:
        return _relational(a, b, cost, eps, max_iter, tol, domain, check_every)
    return _fixed_rounds(a, b, cost, eps, max_iter, domain)


# --- batched ---------------------------------------------------------------------------------


def packed_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row per problem: ``(problem_id, idx_a, p_a, idx_b, p_b)``."""

    def named(df: DataFrame, side: str) -> DataFrame:
        return pack(df.where(F.col("p") > 0), "problem_id", "idx").select(
            "problem_id", F.col("idx").alias(f"idx_{side}"), F.col("p").alias(f"p_{side}")
        )

    joined = named(a, "a").join(named(b, "b"), "problem_id")
    return joined.repartition(tasks(a), "problem_id")


def stack(dense: DenseCost, rows: pd.DataFrame, side: str) -> np.ndarray:
    columns = [dense.column(i, p) for i, p in zip(rows[f"idx_{side}"], rows[f"p_{side}"])]
    return np.stack(columns, axis=1)


def padded_stacks(rows: pd.DataFrame):
    """Cut rows, in order, into stacks whose padded couplings hold at most ``STACK_VALUES`` numbers."""
    start, tall, wide = 0, 0, 0
    sizes = list(zip(map(len, rows["idx_a"]), map(len, rows["idx_b"])))
    for at, (a, b) in enumerate(sizes):
        if at > start and max(tall, a) * max(wide, b) * (at + 1 - start) > STACK_VALUES:
            yield rows.iloc[start:at]
            start, tall, wide = at, 0, 0
        tall, wide = max(tall, a), max(wide, b)
    yield rows.iloc[start:]


def _padded(arrays) -> np.ndarray:
    """Arrays of different lengths as rows, filled up with zeros."""
    out = np.zeros((len(arrays), max(map(len, arrays))))
    for row, values in zip(out, arrays):
        row[: len(values)] = values
    return out


def solve_in_blocks(pair: PairKernel, pa, pb, max_iter, tol, domain, check_every=sc.CHECK_EVERY) -> tuple:
    """``(f, g, status, rounds, error, linear, regularized)`` of one pair whose coupling is too large to be held.

    Costs and kernel come in blocks of columns, in every walk again where they do not fit.
    """
    eps = pair.eps
    if domain == "log" or (domain == "auto" and max(cost.max() for _, cost in pair.costs()) / eps > EXP_RANGE):
        f, g, status, rounds, error = sc.scale_pair_log(pair.costs, pa, pb, eps, max_iter, tol, check_every)
    else:
        U, V, (status,), (rounds,), (error,) = sc.scale_pairs(pair, pa[:, None], pb[:, None], max_iter, tol, None, check_every)
        f, g = (eps * np.log(x[:, 0], where=x[:, 0] > 0, out=np.zeros(len(x))) for x in (U, V))
    linear = regularized = 0.0
    for columns, cost in pair.costs():
        level = f[:, None] + g[None, columns]
        mass = np.exp((level - cost) / eps)
        linear += float((mass * cost).sum())
        regularized += float((mass * (level - eps)).sum())
    return f, g, status, int(rounds), float(error), linear, regularized


def _batched(packed, cost, eps, max_iter, tol, domain, check_every=sc.CHECK_EVERY) -> Solution:
    dense = collect_ground(cost)
    shared, kind = dense.share(packed), type(dense)
    width = max(1, STACK_VALUES // (8 * max(1, len(dense.ids))))

    def solve_exp(rows, ground, K):
        U, V, status, rounds, error = sc.scale_pairs(
            K, stack(ground, rows, "a"), stack(ground, rows, "b"), max_iter, tol, None, check_every
        )
        # off the support U and V are zero, and so is what they contribute to the costs
        f = eps * np.log(U, where=U > 0, out=np.zeros_like(U))
        g = eps * np.log(V, where=V > 0, out=np.zeros_like(V))
        linear = (U * ((K * ground.finite) @ V)).sum(axis=0)
        # cost + eps * mass * (log mass - 1) sums mass * (f + g - eps)
        by_f = (U * (K @ V) * (f - eps)).sum(axis=0)
        by_g = (V * (K.T @ U) * g).sum(axis=0)
        for s in range(len(rows)):
            ia, ib = ground.at(rows["idx_a"].iloc[s]), ground.at(rows["idx_b"].iloc[s])
            moved = float(linear[s]), float(by_f[s] + by_g[s])
            yield f[ia, s], g[ib, s], status[s], int(rounds[s]), float(error[s]), *moved

    def solve_log(rows, ground):
        for some in padded_stacks(rows):
            at = [[ground.at(i) for i in some[f"idx_{side}"]] for side in "ab"]
            A, B = (_padded(some[f"p_{side}"]) for side in "ab")
            C = np.zeros((len(some), A.shape[1], B.shape[1]))
            for c, ia, ib in zip(C, *at):
                c[: len(ia), : len(ib)] = ground.matrix[np.ix_(ia, ib)]
            F_, G_, status, rounds, error = sc.scale_pairs_log(C, A, B, eps, max_iter, tol, check_every)
            level = F_[:, :, None] + G_[:, None, :]
            mass = np.exp((level - C) / eps) * ((A > 0)[:, :, None] & (B > 0)[:, None, :])
            linear = (mass * np.where(mass > 0, C, 0.0)).sum(axis=(1, 2))
            regularized = (mass * (level - eps)).sum(axis=(1, 2))
            for s, (ia, ib) in enumerate(zip(*at)):
                moved = float(linear[s]), float(regularized[s])
                yield F_[s, : len(ia)], G_[s, : len(ib)], status[s], int(rounds[s]), float(error[s]), *moved

    def solve_alone(rows, ground):
        """Each pair on the words that its two histograms have."""
        for one in (rows.iloc[at : at + 1] for at in range(len(rows))):
            (ia, ib), (pa, pb) = ([np.asarray(one[f"{x}_{side}"].iloc[0]) for side in "ab"] for x in ("idx", "p"))
            if len(ia) * len(ib) > STACK_VALUES:
                pair = PairKernel(ground.vectors[ground.at(ia)], ground.vectors[ground.at(ib)], eps, ground.rooted)
                yield solve_in_blocks(pair, pa, pb, max_iter, tol, domain, check_every)
                continue
            C = ground.block(ground.at(ia), ground.at(ib))
            if domain == "log" or (domain == "auto" and C.max() / eps > EXP_RANGE):
                f, g, status, rounds, error = sc.scale_pairs_log(C[None], pa[None], pb[None], eps, max_iter, tol, check_every)
                f, g = f[0], g[0]
            else:
                U, V, status, rounds, error = sc.scale_pairs(np.exp(-C / eps), pa[:, None], pb[:, None], max_iter, tol, None, check_every)
                f, g = (eps * np.log(x[:, 0], where=x[:, 0] > 0, out=np.zeros(len(x))) for x in (U, V))
            level = f[:, None] + g[None, :]
            mass = np.exp((level - C) / eps)
            moved = float((mass * C).sum()), float((mass * (level - eps)).sum())
            yield f, g, status[0], int(rounds[0]), float(error[0]), *moved

    def solve(batches):
        ground = kind(*shared.value)
        K = None if kind is VectorCost else ground.kernel(eps)
        for rows in chunks(batches, width):
            if K is None:
                solved = solve_alone(rows, ground)
            else:
                solved = solve_exp(rows, ground, K) if domain == "exp" else solve_log(rows, ground)
            f, g, status, rounds, error, linear, regularized = zip(*solved)
            yield pd.DataFrame(
                {
                    "problem_id": rows["problem_id"].to_numpy(),
                    "idx_a": rows["idx_a"].to_numpy(),
                    "f": list(f),
                    "idx_b": rows["idx_b"].to_numpy(),
                    "g": list(g),
                    "status": status,
                    "iterations": rounds,
                    "error": error,
                    "linear": linear,
                    "regularized": regularized,
                }
            )

    key = packed.schema["problem_id"].dataType.simpleString()
    solved = packed.select("problem_id", "idx_a", "p_a", "idx_b", "p_b").mapInPandas(
        solve,
        f"problem_id {key}, idx_a array<int>, f array<double>, idx_b array<int>, g array<double>,"
        " status string, iterations int, error double, linear double, regularized double",
    )

    sides = F.array(
        F.struct(F.lit("a").alias("side"), F.arrays_zip(F.col("idx_a").alias("idx"), F.col("f").alias("potential")).alias("entries")),
        F.struct(F.lit("b").alias("side"), F.arrays_zip(F.col("idx_b").alias("idx"), F.col("g").alias("potential")).alias("entries")),
    )
    values = solved.select("problem_id", F.inline(sides)).select(
        "problem_id", "side", F.inline("entries")
    )
    return Solution(
        values,
        solved.select("problem_id", "status", "iterations", "error"),
        solved.select("problem_id", "linear", "regularized"),
    )


# --- relational ------------------------------------------------------------------------------


def log_of(total: Column) -> Column:
    """The logarithm, which for zero is minus infinity and not null."""
    return F.when(total > 0, F.ln(total)).otherwise(F.lit(-math.inf))


def choose_shift(kernel: DataFrame, domain: str) -> str:
    """``level`` for a log domain whose sums over one vector may all be shifted by the vector's maximum.

    That is safe where every pair has a cost of at most ``LEVEL_RANGE``: each sum then holds a term of
    ``exp(-LEVEL_RANGE)`` or more. Other domains, and kernels with gaps or steeper costs, stay as they are.
    """
    if domain != "log":
        return domain
    pairs, rows, columns, low, high = kernel.where("c is not null").agg(
        F.count_distinct("i", "j"), F.count_distinct("i"), F.count_distinct("j"), F.min("c"), F.max("c")
    ).first()
    return "level" if 0 < pairs == rows * columns and -1 <= low and high <= LEVEL_RANGE else "log"


def smooth(x: DataFrame, kernel: DataFrame, src: str, dst: str, keys: list[str], domain: str) -> DataFrame:
    """``log(sum over src of exp(x - cost / eps))`` per key and ``dst``, as ``(*keys, dst, x)``.

    The exp domain sums ``k * exp(x)``; the log domain shifts every sum by its own maximum, for which
    the joined rows are sorted. The domain ``level``, see :func:`choose_shift`, shifts all sums of a key by
    the key's maximum before the join. A key has at most one row per index, so placing whole keys in one
    task is bounded.
    """
    if domain == "level":
        top = F.max("x").over(Window.partitionBy(*keys))
        lowered = F.when(F.col("top") == -math.inf, 0.0).otherwise(F.exp(F.col("x") - F.col("top")))
        shifted = x.repartition(*keys).withColumn("top", top).select(*keys, src, "top", lowered.alias("e"))
        total = F.max("top") + log_of(F.sum(F.col("e") * F.col("k")))
        return shifted.join(kernel, src).groupBy(*keys, dst).agg(total.alias("x"))
    joined = x.repartition(*keys).join(kernel, src)
    if domain == "exp":
        return joined.groupBy(*keys, dst).agg(log_of(F.sum(F.exp("x") * F.col("k"))).alias("x"))
    shifted = joined.select(*keys, dst, (F.col("x") - F.col("c")).alias("z")).withColumn(
        "top", F.max("z").over(Window.partitionBy(*keys, dst))
    )
    lowest = F.max("top") == F.lit(-math.inf)
    total = F.when(lowest, -math.inf).otherwise(F.max("top") + log_of(F.sum(F.exp(F.col("z") - F.col("top")))))
    return shifted.groupBy(*keys, dst).agg(total.alias("x"))


def _sides(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    log_p = F.ln("p").alias("log_p")
    positive = F.col("p") > 0
    return (
        a.where(positive).select("problem_id", F.col("idx").alias("i"), log_p),
        b.where(positive).select("problem_id", F.col("idx").alias("j"), log_p),
    )


def _scale(marginal: DataFrame, smoothed: DataFrame, idx: str) -> DataFrame:
    reached = F.coalesce("x", F.lit(-math.inf))
    return marginal.join(smoothed, ["problem_id", idx], "left").select(
        "problem_id", idx, (F.col("log_p") - reached).alias("x")
    )


def _round(left, right, log_v, kernel, domain):
    log_u = _scale(left, smooth(log_v, kernel, "j", "i", ["problem_id"], domain), "i")
    return log_u, _scale(right, smooth(log_u, kernel, "i", "j", ["problem_id"], domain), "j")


def _stacked(log_u: DataFrame, log_v: DataFrame) -> DataFrame:
    return log_u.select("problem_id", F.lit("a").alias("side"), F.col("i").alias("idx"), "x").unionByName(
        log_v.select("problem_id", F.lit("b").alias("side"), F.col("j").alias("idx"), "x")
    )


def _unstacked(state: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (
        state.where("side = 'a'").select("problem_id", F.col("idx").alias("i"), "x"),
        state.where("side = 'b'").select("problem_id", F.col("idx").alias("j"), "x"),
    )


def _gap(left, log_u, log_v, kernel, domain) -> DataFrame:
    """Norm of the gap in the first marginal per problem."""
    reached = smooth(log_v, kernel, "j", "i", ["problem_id"], domain).withColumnRenamed("x", "s")
    gap = F.exp("log_p") - F.exp(F.col("x") + F.coalesce("s", F.lit(-math.inf)))
    return (
        left.join(log_u, ["problem_id", "i"])
        .join(reached, ["problem_id", "i"], "left")
        .groupBy("problem_id")
        .agg(F.sqrt(F.sum(gap * gap)).alias("error"))
    )


def _potentials(state: DataFrame, eps: float) -> DataFrame:
    return state.select("problem_id", "side", "idx", (eps * F.col("x")).alias("potential"))


def _fixed_rounds(a, b, cost, eps, rounds, domain) -> Solution:
    """Exactly ``rounds`` rounds as one declarative plan, without looking at errors."""
    kernel = kernel_table(cost, eps)
    domain = choose_shift(kernel, domain)
    left, right = _sides(a, b)
    log_v = right.select("problem_id", "j", F.lit(0.0).alias("x"))
    for done in range(1, rounds + 1):
        log_u, log_v = _round(left, right, log_v, kernel, domain)
        if done % 4 == 0 and done < rounds:
            log_v = materialize(log_v)
    status = _gap(left, log_u, log_v, kernel, domain).select(
        "problem_id", F.lit(sc.MAX_ITER).alias("status"), F.lit(rounds).alias("iterations"), "error"
    )
    return Solution(_potentials(_stacked(log_u, log_v), eps), status)


def _relational(a, b, cost, eps, max_iter, tol, domain, check_every) -> Solution:
    """Rounds with a checkpoint and an error check after every few; solved problems drop out."""
    kernel = kernel_table(cost, eps)
    domain = choose_shift(kernel, domain)
    left, right = (materialize(side) for side in _sides(a, b))
    state = _stacked(
        left.select("problem_id", "i", F.lit(0.0).alias("x")),
        right.select("problem_id", "j", F.lit(0.0).alias("x")),
    )
    values, statuses, rounds = [], [], 0
    while True:
        before, start = state, rounds
        log_u, log_v = _unstacked(state)
        steps = min(check_every, max_iter - rounds)
        for step in range(1, steps + 1):
            log_u, log_v = _round(left, right, log_v, kernel, domain)
            if step % 4 == 0 and step < steps:
                log_v = materialize(log_v)
        rounds += steps
        state = materialize(_stacked(log_u, log_v))
        log_u, log_v = _unstacked(state)
        gaps = _gap(left, log_u, log_v, kernel, domain)
        checked = materialize(checked_status(gaps, "problem_id", tol, start, rounds, max_iter))
        closed = checked.where("status is not null")
        if not closed.isEmpty():
            statuses.append(closed)
            sound = closed.where(F.col("status") != sc.NONFINITE).select("problem_id")
            broken = closed.where(F.col("status") == sc.NONFINITE).select("problem_id")
            ended = state.join(sound, "problem_id", "left_semi").unionByName(
                before.join(broken, "problem_id", "left_semi")
            )
            values.append(materialize(ended))
        pending = checked.where("status is null").select("problem_id")
        if rounds >= max_iter or pending.isEmpty():
            break
        if not closed.isEmpty():
            state, left, right = (
                materialize(t.join(pending, "problem_id", "left_semi")) for t in (state, left, right)
            )
    if not statuses:  # no problems at all
        values, statuses = [state], [checked]
    return Solution(_potentials(_union(values), eps), _union(statuses))


def checked_status(gaps: DataFrame, key: str, tol: float, start: int, rounds: int, max_iter: int) -> DataFrame:
    """``(key, status, iterations, error)`` after a look at the errors; null status: go on."""
    fine = F.col("error").isNotNull() & ~F.isnan("error") & (F.col("error") < math.inf)
    status = (
        F.when(~fine, sc.NONFINITE)
        .when(F.col("error") < tol, sc.CONVERGED)
        .when(F.lit(rounds >= max_iter), sc.MAX_ITER)
    )
    return gaps.select(
        key,
        status.alias("status"),
        F.when(fine, rounds).otherwise(start).cast("int").alias("iterations"),
        F.when(fine, F.col("error")).otherwise(math.inf).alias("error"),
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


# --- results ---------------------------------------------------------------------------------


def transport_plan(potentials: DataFrame, cost: DataFrame, eps: float) -> DataFrame:
    """``(problem_id, i, j, mass, cost)`` with ``mass = exp((f + g - cost) / eps)``.

    One row per pair of support points, which is the size of a coupling.
    """
    f = potentials.where("side = 'a'").select(
        "problem_id", F.col("idx").alias("i"), F.col("potential").alias("f")
    )
    g = potentials.where("side = 'b'").select(
        "problem_id", F.col("idx").alias("j"), F.col("potential").alias("g")
    )
    mass = F.exp((F.col("f") + F.col("g") - F.col("cost")) / eps).alias("mass")
    return (
        f.join(broadcast_if_small(cost.select("i", "j", "cost")), "i")
        .join(g, ["problem_id", "j"])
        .select("problem_id", "i", "j", mass, "cost")
    )


def solved_cost(
    solution: Solution, cost: DataFrame, eps: float, kind: str = "linear"
) -> DataFrame:
    """``(problem_id, cost)`` of a solution.

    Batched solutions carry their costs, so no coupling is ever laid out; for relational ones
    the coupling is joined and summed.
    """
    if kind not in ("linear", "regularized"):
        raise ValueError("kind must be 'linear' or 'regularized'")
    if solution.costs is None:
        return transport_cost(transport_plan(solution.values, cost, eps), kind, eps)
    return solution.costs.select("problem_id", F.col(kind).alias("cost"))


def transport_cost(plan: DataFrame, kind: str = "linear", eps: float | None = None) -> DataFrame:
    """``(problem_id, cost)``: mass times cost, or that plus ``eps * mass * (log mass - 1)``."""
    spent = F.col("mass") * F.col("cost")
    if kind == "regularized":
        if eps is None:
            raise ValueError("the regularized cost needs eps")
        entropy = F.when(F.col("mass") > 0, F.col("mass") * (F.ln("mass") - 1)).otherwise(0.0)
        spent = spent + eps * entropy
    elif kind != "linear":
        raise ValueError("kind must be 'linear' or 'regularized'")
    return plan.groupBy("problem_id").agg(F.sum(spent).alias("cost"))
