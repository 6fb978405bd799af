"""Wasserstein barycenters, plain and debiased, one per group of weighted histograms.

``atoms`` is ``(group_id, member, idx, p)`` and ``weights`` is ``(group_id, member, weight)``.
The relational strategy never gathers a group: a group may hold a third of all members. The
geometric mean over members is a grouped sum, and its result goes back to the members by a
broadcast of checked size or by a salted join.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from otindex.functions import scaling as sc
from otindex.operators.ground import (
    DenseCost,
    choose_domain,
    choose_strategy,
    kernel_table,
    tasks,
)
from otindex.operators.transport import (
    STACK_VALUES,
    Solution,
    _union,
    check_indices,
    checked_status,
    choose_shift,
    smooth,
)
from otindex.session import BROADCAST_ROWS, SALTS, materialize

#: Members, and numbers (members x words), up to which one task may hold a whole group: with the arrays of a
#: round some 400 MB.
GROUP_MEMBERS, GROUP_VALUES = 65_536, 4_000_000

MEMBER = ["group_id", "member", "weight"]


def barycenter(
    atoms: DataFrame,
    weights: DataFrame,
    cost: DataFrame,
    eps: float,
    debias: bool = False,
    max_iter: int = 1000,
    tol: float = 1e-8,
    domain: str = "auto",
    strategy: str = "auto",
    check_every: int = 10,
) -> Solution:
    """``values`` is ``(group_id, idx, p)``; status as for transport problems.

    A group that is ``nonfinite`` at the first check has no values. Weights of a group should sum to one. ``debias`` adds the correction that returns a histogram
    unchanged as the barycenter of copies of itself.
    """
    domain = choose_domain(domain, cost, eps)
    members = atoms.where(F.col("p") > 0).join(weights, ["group_id", "member"])
    check_indices(cost, atoms, atoms)
    chosen = choose_strategy(strategy, cost)
    if chosen == "relational":
        return _Relational(members, weights, cost, eps, debias, domain).solve(max_iter, tol, check_every)
    sizes = weights.groupBy("group_id").count()
    most = min(GROUP_MEMBERS, GROUP_VALUES // max(1, cost.select("j").distinct().count()))
    large = materialize(sizes.where(F.col("count") > most).select("group_id"))
    if large.isEmpty():
        return _batched(members, cost, eps, debias, max_iter, tol, domain, check_every)
    if strategy == "batched":
        raise ValueError(f"a group exceeds {most} members; use 'relational'")
    # large groups go the relational way, and only they
    small = _batched(
        members.join(large, "group_id", "left_anti"), cost, eps, debias, max_iter, tol, domain, check_every
    )
    of_large = [t.join(large, "group_id", "left_semi") for t in (members, weights)]
    rest = _Relational(*of_large, cost, eps, debias, domain).solve(max_iter, tol, check_every)
    return Solution(small.values.unionByName(rest.values), small.status.unionByName(rest.status))


# --- batched ---------------------------------------------------------------------------------


def _batched(members, cost, eps, debias, max_iter, tol, domain, check_every=sc.CHECK_EVERY) -> Solution:
    shared = DenseCost.collect(cost).share(members)
    atom = F.struct("idx", "p")
    per_member = members.groupBy(*MEMBER).agg(F.array_sort(F.collect_list(atom)).alias("entries"))
    per_group = (
        per_member.groupBy("group_id")
        .agg(F.array_sort(F.collect_list(F.struct("member", "weight", "entries"))).alias("all"))
        .select(
            "group_id",
            F.col("all.weight").cast("array<double>").alias("weight"),
            F.transform("all.entries", lambda e: e["idx"].cast("array<int>")).alias("idx"),
            F.transform("all.entries", lambda e: e["p"].cast("array<double>")).alias("p"),
        )
        .repartition(tasks(members), "group_id")
    )

    def solve(batches):
        ground = DenseCost(*shared.value)
        smooth = sc.ExpSmoothing(ground.kernel(eps)) if domain == "exp" else sc.LogSmoothing(ground.matrix, eps)
        for batch in batches:
            for rows in _stacks(batch, len(ground.ids)):
                A = np.stack([ground.column(i, q) for idx, p in zip(rows["idx"], rows["p"]) for i, q in zip(idx, p)], axis=1)
                counts = rows["weight"].map(len).to_numpy()
                b, status, rounds, error = sc.barycenter_groups(
                    smooth, A, np.concatenate(rows["weight"].to_list()), np.cumsum(counts) - counts,
                    max_iter, tol, debias, check_every,
                )
                # no round was finite: no values
                some = [slice(None) if r else slice(0) for r in rounds]
                yield pd.DataFrame(
                    {
                        "group_id": rows["group_id"].to_numpy(),
                        "idx": [ground.ids[k] for k in some],
                        "p": [b[k, g] for g, k in enumerate(some)],
                        "status": status,
                        "iterations": rounds,
                        "error": error,
                    }
                )

    key = members.schema["group_id"].dataType.simpleString()
    solved = per_group.mapInPandas(
        solve,
        f"group_id {key}, idx array<int>, p array<double>, status string, iterations int,"
        " error double",
    )
    return Solution(
        solved.select("group_id", F.inline(F.arrays_zip("idx", "p"))),
        solved.select("group_id", "status", "iterations", "error"),
    )


def _stacks(batch: pd.DataFrame, words: int):
    """Cut groups, in order, into stacks whose members hold at most ``STACK_VALUES`` numbers, or one group."""
    start, members = 0, 0
    limit = max(1, STACK_VALUES // words)
    for at, count in enumerate(batch["weight"].map(len)):
        if at > start and members + count > limit:
            yield batch.iloc[start:at]
            start, members = at, 0
        members += count
    if len(batch):
        yield batch.iloc[start:]


# --- relational ------------------------------------------------------------------------------


class _Relational:
    """Rounds over tables of logarithms; see the module text for how groups are spread."""

    def __init__(self, members, weights, cost, eps, debias, domain):
        self.kernel = kernel_table(cost, eps)
        self.domain = domain = choose_shift(self.kernel, domain)
        self.debias, self.eager = debias, False
        self.atoms = members.select(
            *MEMBER, F.col("idx").alias("i"), F.ln("p").alias("log_p")
        )
        groups = weights.select("group_id").distinct()
        words = cost.select("j").distinct()
        # the table sent back to members has one row per group and word
        self.small = groups.count() * words.count() <= BROADCAST_ROWS
        # kernel row sums: the first smoothing of V = d = 1
        ones = words.select(F.lit(0).alias("unit"), "j", F.lit(0.0).alias("x"))
        self.start = smooth(ones, self.kernel, "j", "i", ["unit"], domain).select("i", "x")

    def _to_members(self, log_t: DataFrame, log_b: DataFrame) -> DataFrame:
        """``log v = log b - log T`` for every member of each group."""
        b = log_b.select("group_id", "j", F.col("x").alias("b"))
        if self.small:
            joined = log_t.join(F.broadcast(b), ["group_id", "j"])
        else:
            salted = log_t.withColumn("_salt", F.pmod(F.xxhash64("member"), F.lit(SALTS)).cast("int"))
            copies = b.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            joined = salted.join(copies, ["group_id", "j", "_salt"])
        return joined.select(*MEMBER, "j", (F.col("b") - F.col("x")).alias("x"))

    def round(self, log_v: DataFrame | None, log_d: DataFrame | None):
        """One round from ``log_v, log_d`` (None stands for all zeros)."""
        if log_v is None:
            scaled = self.atoms.join(self.start, "i", "left")
        else:
            smoothed = smooth(log_v, self.kernel, "j", "i", MEMBER, self.domain)
            scaled = self.atoms.join(smoothed, [*MEMBER, "i"], "left")
        reached = F.coalesce("x", F.lit(-math.inf))
        log_u = scaled.select(*MEMBER, "i", (F.col("log_p") - reached).alias("x"))
        log_t = smooth(log_u, self.kernel, "i", "j", MEMBER, self.domain)
        if self.eager:  # used by both the mean and the members: computed once per round
            log_t = materialize(log_t)
        log_b = log_t.groupBy("group_id", "j").agg(F.sum(F.col("weight") * F.col("x")).alias("x"))
        if log_d is not None:
            d = log_d.select("group_id", "j", F.col("x").alias("d"))
            log_b = log_b.join(d, ["group_id", "j"]).select(
                "group_id", "j", (F.col("x") + F.col("d")).alias("x")
            )
        log_v = self._to_members(log_t, log_b)
        if self.debias:
            log_d = self._correction(log_b, log_d)
            log_d = materialize(log_d) if self.eager else log_d
        return log_u, log_b, log_v, log_d

    def _correction(self, log_b, log_d):
        """``log d = (log d + log b - log K d) / 2``."""
        if log_d is None:
            kd = self.start.select(F.col("i").alias("j"), F.col("x").alias("kd"))
            return log_b.join(kd, "j").select(
                "group_id", "j", ((F.col("x") - F.col("kd")) / 2).alias("x")
            )
        kd = smooth(log_d, self.kernel, "j", "i", ["group_id"], self.domain).select(
            "group_id", F.col("i").alias("j"), F.col("x").alias("kd")
        )
        d = log_d.select("group_id", "j", F.col("x").alias("d"))
        return log_b.join(d, ["group_id", "j"]).join(kd, ["group_id", "j"]).select(
            "group_id", "j", ((F.col("d") + F.col("x") - F.col("kd")) / 2).alias("x")
        )

    def gap(self, log_u, log_v, log_d=None, before=None) -> DataFrame:
        """Error per group: gap in the atoms' marginals and, with ``log_d``, the last move of d."""
        reached = smooth(log_v, self.kernel, "j", "i", MEMBER, self.domain).withColumnRenamed("x", "s")
        gap = F.exp("log_p") - F.exp(F.col("x") + F.coalesce("s", F.lit(-math.inf)))
        squares = (
            self.atoms.join(log_u, [*MEMBER, "i"])
            .join(reached, [*MEMBER, "i"], "left")
            .select("group_id", (gap * gap).alias("square"))
        )
        if log_d is not None:
            old = F.lit(0.0).alias("old") if before is None else F.col("x").alias("old")
            start = (log_d if before is None else before).select("group_id", "j", old)
            move = F.exp("x") - F.exp("old")
            moves = log_d.join(start, ["group_id", "j"])
            squares = squares.unionByName(moves.select("group_id", (move * move).alias("square")))
        return squares.groupBy("group_id").agg(F.sqrt(F.sum("square")).alias("error"))

    @staticmethod
    def _values(log_b: DataFrame) -> DataFrame:
        return log_b.select("group_id", F.col("j").alias("idx"), F.exp("x").alias("p"))

    def solve(self, max_iter: int, tol: float, check_every: int) -> Solution:
        log_v = log_d = None
        self.eager = tol > 0 or max_iter > 3
        if tol <= 0:
            for _ in range(max_iter):
                old_d = log_d
                log_u, log_b, log_v, log_d = self.round(log_v, log_d)
            status = self.gap(log_u, log_v, log_d, old_d).select(
                "group_id", F.lit(sc.MAX_ITER).alias("status"),
                F.lit(max_iter).alias("iterations"), "error",
            )
            return Solution(self._values(log_b), status)
        return self._until_converged(max_iter, tol, check_every)

    def _until_converged(self, max_iter, tol, check_every) -> Solution:
        self.atoms = materialize(self.atoms)
        log_v = log_d = log_b = None
        values, statuses, rounds = [], [], 0
        while True:
            before, start = log_b, rounds
            for _ in range(min(check_every, max_iter - rounds)):
                old_d = log_d
                log_u, log_b, log_v, log_d = self.round(log_v, log_d)
                rounds += 1
            log_b, log_u, log_v = materialize(log_b), materialize(log_u), materialize(log_v)
            gaps = self.gap(log_u, log_v, log_d, old_d)
            checked = materialize(checked_status(gaps, "group_id", tol, start, rounds, max_iter))
            closed = checked.where("status is not null")
            if not closed.isEmpty():
                statuses.append(closed)
                sound = closed.where(F.col("status") != sc.NONFINITE).select("group_id")
                ended = log_b.join(sound, "group_id", "left_semi")
                if before is not None:
                    broken = closed.where(F.col("status") == sc.NONFINITE).select("group_id")
                    ended = ended.unionByName(before.join(broken, "group_id", "left_semi"))
                values.append(materialize(ended))
            pending = checked.where("status is null").select("group_id")
            if rounds >= max_iter or pending.isEmpty():
                break
            if not closed.isEmpty():
                self.atoms, log_v, log_b, log_d = (
                    None if t is None else materialize(t.join(pending, "group_id", "left_semi"))
                    for t in (self.atoms, log_v, log_b, log_d)
                )
        if not statuses:  # no groups at all
            values, statuses = [log_b], [checked]
        return Solution(self._values(_union(values)), _union(statuses))
