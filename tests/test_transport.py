import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from otindex.operators import gradients as gr
from otindex.operators.barycenter import barycenter
from otindex.operators.ground import choose_domain, choose_strategy, kernel_table
from otindex.operators.transport import (
    choose_shift,
    pair_problems,
    sinkhorn,
    sinkhorn_pairs,
    smooth,
    solved_cost,
    transport_cost,
    transport_plan,
)

# Fixed fixture values: small problems and the plans and barycenters that belong to them.
PAIR = ([[0.4, 0.6]], [[0.8, 0.2]], [[0.1, 0.5], [0.5, 0.1]])
PLAN = {(0, 0): 0.3999329524, (0, 1): 0.0000670476, (1, 0): 0.4000670476, (1, 1): 0.1999329524}

ATOMS = [[0.2, 0.2, 0.5, 0.1], [0.3, 0.4, 0.2, 0.1], [0.5, 0.4, 0.05, 0.05]]
SQUARES = [[(i - j) ** 2 for j in range(4)] for i in range(4)]
PLAIN = [0.3557116373, 0.3599282559, 0.2036156933, 0.0807444135]
DEBIASED = [0.4088521516, 0.4540729775, 0.0842349414, 0.0528399294]

BOTH = ["batched", "relational"]


def by_index(table):
    return [r.p for r in table.orderBy("idx").collect()]


@pytest.mark.parametrize("strategy", BOTH)
@pytest.mark.parametrize("domain", ["exp", "log"])
def test_one_pair(make, strategy, domain):
    a, b, cost = make.histograms(PAIR[0]), make.histograms(PAIR[1]), make.cost(PAIR[2])
    solution = sinkhorn(a, b, cost, 0.1, tol=1e-12, domain=domain, strategy=strategy)
    plan = transport_plan(solution.values, cost, 0.1)
    assert {(r.i, r.j): r.mass for r in plan.collect()} == pytest.approx(PLAN, abs=1e-9)
    assert transport_cost(plan).first().cost == pytest.approx(0.2600536380, abs=1e-9)
    entropic = transport_cost(plan, "regularized", 0.1).first().cost
    assert entropic == pytest.approx(0.0545012762, abs=1e-9)
    for kind, expected in (("linear", 0.2600536380), ("regularized", 0.0545012762)):
        carried = solved_cost(solution, cost, 0.1, kind).first().cost
        assert carried == pytest.approx(expected, abs=1e-9)
    status = solution.status.first()
    assert status.status == "converged" and status.error < 1e-12


def test_steep_cost_needs_the_log_domain(make):
    a, b = make.histograms([[0.1, 0.2, 0.7]]), make.histograms([[0.6, 0.2, 0.2]])
    cost = make.cost([[100, 400, 300], [200, 100, 400], [300, 200, 100]])
    assert choose_domain("auto", cost, 0.1) == "log"
    solution = sinkhorn(a, b, cost, 0.1, tol=1e-9)
    moved = transport_cost(transport_plan(solution.values, cost, 0.1)).first().cost
    assert moved == pytest.approx(200.0, abs=1e-6)
    broken = sinkhorn(a, b, cost, 0.1, domain="exp").status.first()
    assert broken.status == "nonfinite"


def rounded(table):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in table.collect())


@pytest.mark.parametrize("check_every", [1, 4, 10])
def test_partial_underflow_is_nonfinite_in_both_strategies(make, check_every):
    # problem 0 stays within reach of the kernel; in problem 1 a word reaches no mass
    a = make.histograms([[0.5, 0.5, 0.0], [0.3, 0.3, 0.4]])
    b = make.histograms([[0.5, 0.5, 0.0], [0.6, 0.4, 0.0]])
    cost = make.cost([[0.0, 0.1, 500.0], [0.1, 0.0, 500.0], [500.0, 500.0, 0.0]])
    runs = [
        sinkhorn(a, b, cost, 0.1, domain="exp", strategy=s, max_iter=30, check_every=check_every) for s in BOTH
    ]
    for run in runs:
        status = {r.problem_id: (r.status, r.iterations) for r in run.status.collect()}
        assert status[0][0] == "converged" and status[1] == ("nonfinite", 0)
        assert all(r.potential == 0 for r in run.values.where("problem_id = 1").collect())
    assert rounded(runs[0].values) == rounded(runs[1].values)
    assert rounded(runs[0].status) == rounded(runs[1].status)


@pytest.mark.parametrize("domain", ["exp", "log"])
def test_strategies_agree_on_rounds_potentials_and_status(make, domain):
    rng = np.random.default_rng(3)
    a, b = (make.histograms(rng.dirichlet(np.ones(5), 6).tolist()) for _ in range(2))
    cost = make.cost(rng.random((5, 5)))
    runs = [sinkhorn(a, b, cost, 0.05, tol=1e-6, domain=domain, strategy=s, max_iter=200) for s in BOTH]
    assert rounded(runs[0].status.select("problem_id", "status", "iterations")) == rounded(
        runs[1].status.select("problem_id", "status", "iterations")
    )
    for x, y in zip(rounded(runs[0].values), rounded(runs[1].values)):
        assert x[:3] == y[:3] and x[3] == pytest.approx(y[3], abs=1e-8)


@pytest.mark.parametrize("strategy", BOTH)
def test_an_index_without_cost_is_an_error(make, strategy):
    a, b, cost = make.histograms([[0.5, 0.0, 0.5]]), make.histograms([[1.0]]), make.cost([[0.0, 1.0], [1.0, 0.0]])
    with pytest.raises(ValueError, match="index that the cost does not have"):
        sinkhorn(a, b, cost, 0.1, strategy=strategy)
    with pytest.raises(ValueError, match="index that the cost does not have"):
        barycenter(*make.group([[0.5, 0.0, 0.5]], [1.0]), cost, 0.1, strategy=strategy)


@pytest.mark.parametrize("strategy", BOTH)
def test_every_pair_has_a_status(spark, make, strategy):
    dist = make.histograms([[0.5, 0.5], [0.1, 0.9]], "id")
    pairs = spark.createDataFrame([(1, 0, 1), (2, 0, 7), (3, 9, 9)], "problem_id bigint, a_id bigint, b_id bigint")
    cost = make.cost([[0.0, 1.0], [1.0, 0.0]])
    solution = sinkhorn_pairs(pairs, dist, dist, cost, 0.5, strategy=strategy)
    status = {r.problem_id: (r.status, r.iterations > 0) for r in solution.status.collect()}
    assert status == {1: ("converged", True), 2: ("empty", False), 3: ("empty", False)}


def test_barycenters_agree_on_partial_underflow_and_large_groups(make, monkeypatch):
    fine, fine_weights = make.group([[0.5, 0.5, 0.0], [0.2, 0.8, 0.0]], [0.5, 0.5], 0)
    torn, torn_weights = make.group([[1.0, 0.0, 0.0], [0.0, 0.0, 1.0]], [0.5, 0.5], 1)
    large, large_weights = make.group([[0.5, 0.5, 0.0], [0.2, 0.8, 0.0], [0.9, 0.1, 0.0]], [0.2, 0.3, 0.5], 2)
    cost = make.cost([[0.0, 0.1, 500.0], [0.1, 0.0, 500.0], [500.0, 500.0, 0.0]])
    atoms, weights = fine.union(torn).union(large), fine_weights.union(torn_weights).union(large_weights)
    runs = [barycenter(atoms, weights, cost, 0.1, domain="exp", strategy=s, max_iter=50) for s in BOTH]
    monkeypatch.setattr("otindex.operators.barycenter.GROUP_MEMBERS", 2)
    runs.append(barycenter(atoms, weights, cost, 0.1, domain="exp", max_iter=50))
    first = rounded(runs[0].status.select("group_id", "status", "iterations"))
    assert (1, "nonfinite", 0) in first
    for run in runs:
        assert rounded(run.status.select("group_id", "status", "iterations")) == first
        assert run.values.where("group_id = 1").isEmpty()
        got, expected = rounded(run.values.where("p > 0")), rounded(runs[0].values.where("p > 0"))
        assert [r[:2] for r in got] == [r[:2] for r in expected]
        assert [r[2] for r in got] == pytest.approx([r[2] for r in expected], abs=1e-8)


def test_max_iter_is_exact_and_strategies_agree(make):
    rng = np.random.default_rng(0)
    p, q, c = (rng.random(s) for s in ((5, 6), (5, 6), (6, 6)))
    a, b = make.histograms((p / p.sum(1, keepdims=True)).tolist()), make.histograms((q / q.sum(1, keepdims=True)).tolist())
    cost = make.cost(c)

    def potentials(**how):
        solution = sinkhorn(a, b, cost, 0.2, max_iter=3, tol=0.0, **how)
        assert {r.iterations for r in solution.status.collect()} == {3}
        return {(r.problem_id, r.side, r.idx): r.potential for r in solution.values.collect()}

    reference = potentials(strategy="batched", domain="exp")
    assert len(reference) == 60
    for how in ({"strategy": "batched", "domain": "log"}, {"strategy": "relational", "domain": "exp"},
                {"strategy": "relational", "domain": "log"}):
        assert potentials(**how) == pytest.approx(reference, abs=1e-10)


def test_sparse_supports_and_marginals(make):
    a = make.histograms([[0.5, 0, 0.5], [0, 1, 0]])
    b = make.histograms([[0, 0.25, 0.75], [0.5, 0.5, 0]])
    cost = make.cost([[0, 1, 2], [1, 0, 1], [2, 1, 0]])
    solution = sinkhorn(a, b, cost, 0.3, tol=1e-12)
    plan = transport_plan(solution.values, cost, 0.3)
    rows = {(r.problem_id, r.i): r.m for r in plan.groupBy("problem_id", "i").agg(F.sum("mass").alias("m")).collect()}
    assert rows == pytest.approx({(0, 0): 0.5, (0, 2): 0.5, (1, 1): 1.0}, abs=1e-10)


@pytest.mark.parametrize("salted", [False, True])
def test_many_pairs_share_one_histogram(spark, make, monkeypatch, salted):
    if salted:
        monkeypatch.setattr("otindex.operators.transport.BROADCAST_ROWS", 0)
    dist = make.histograms([[0.5, 0.5], [0.1, 0.9]], "id")
    pairs = spark.createDataFrame([(n, n % 2, 0) for n in range(40)], "problem_id bigint, a_id bigint, b_id bigint")
    a, b = pair_problems(pairs, dist, dist)
    assert a.count() == b.count() == 80
    assert b.where("p <> 0.5").count() == 0
    assert a.where("problem_id = 3").orderBy("idx").first().p == 0.1


def test_results_do_not_depend_on_partitions(spark, make):
    rng = np.random.default_rng(5)
    p = rng.dirichlet(np.ones(4), 9).tolist()
    a, b, cost = make.histograms(p), make.histograms(p[::-1]), make.cost(rng.random((4, 4)))
    runs = []
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        runs.append({tuple(r)[:3]: r.potential for r in sinkhorn(a, b, cost, 0.1).values.collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert runs[0] == pytest.approx(runs[1], abs=1e-12)


@pytest.mark.parametrize("domain", ["exp", "log"])
@pytest.mark.parametrize("debias, expected", [(False, PLAIN), (True, DEBIASED)])
def test_barycenter_batched(make, domain, debias, expected):
    atoms, weights = make.group(ATOMS, [0.1, 0.1, 0.8])
    solution = barycenter(atoms, weights, make.cost(SQUARES), 2.0, debias, 5000, 1e-11, domain)
    assert by_index(solution.values) == pytest.approx(expected, abs=1e-8)
    assert solution.status.first().status == "converged"


@pytest.mark.parametrize("debias, rounds", [(False, 3), (True, 5)])
@pytest.mark.parametrize("domain", ["exp", "log"])
def test_barycenter_relational_equals_batched(make, debias, rounds, domain):
    atoms, weights = make.group(ATOMS, [1 / 3] * 3)
    cost = make.cost(SQUARES)
    runs = [
        by_index(barycenter(atoms, weights, cost, 2.0, debias, rounds, 0.0, domain, how).values)
        for how in BOTH
    ]
    assert runs[0] == pytest.approx(runs[1], abs=1e-11)


def test_barycenter_relational_converges(make):
    atoms, weights = make.group(ATOMS, [0.1, 0.1, 0.8])
    solution = barycenter(atoms, weights, make.cost(SQUARES), 2.0, strategy="relational", tol=1e-9)
    assert by_index(solution.values) == pytest.approx(PLAIN, abs=1e-8)
    assert solution.status.first().status == "converged"


def test_barycenter_members_by_salted_join(make, monkeypatch):
    monkeypatch.setattr("otindex.operators.barycenter.BROADCAST_ROWS", 0)
    atoms, weights = make.group(ATOMS, [0.1, 0.1, 0.8])
    cost = make.cost(SQUARES)
    solution = barycenter(atoms, weights, cost, 2.0, False, 2, 0.0, "exp", "relational")
    reference = barycenter(atoms, weights, cost, 2.0, False, 2, 0.0, "exp", "batched")
    assert by_index(solution.values) == pytest.approx(by_index(reference.values), abs=1e-12)


def test_debiased_barycenter_of_equal_inputs_is_the_input(make):
    atoms, weights = make.group([ATOMS[0]] * 2, [0.5, 0.5])
    solution = barycenter(atoms, weights, make.cost(SQUARES), 2.0, True, 20_000, 1e-12)
    assert by_index(solution.values) == pytest.approx(ATOMS[0], abs=1e-5)
    assert solution.status.first().iterations > 1


def test_debiased_status_waits_for_the_correction_in_both_strategies(make):
    atoms, weights = make.group([ATOMS[0]] * 2, [0.5, 0.5])
    errors = [
        barycenter(atoms, weights, make.cost(SQUARES), 2.0, True, 2, 0.0, "exp", how).status.first().error
        for how in BOTH
    ]
    assert errors[0] > 0.01 and errors[0] == pytest.approx(errors[1])


def test_two_bin_goldens(make):
    atoms, weights = make.group([[0.4, 0.6], [0.3, 0.7], [0.2, 0.8]], [0.7, 0.2, 0.1])
    cost = make.cost([[0.1, 0.8], [0.6, 0.3]])
    assert by_index(barycenter(atoms, weights, cost, 0.1, True, tol=1e-11).values) == pytest.approx(
        [0.3992059405, 0.6007940595], abs=1e-8
    )
    assert by_index(barycenter(atoms, weights, cost, 0.1, tol=1e-11).values) == pytest.approx(
        [0.4141220507, 0.5858779493], abs=1e-8
    )


def test_slow_case_reports_max_iter(make):
    atoms, weights = make.group([[0.4, 0.6], [0.3, 0.7], [0.2, 0.8]], [0.6, 0.2, 0.2])
    cost = make.cost([[0.1, 0.5], [0.6, 0.2]])
    short = barycenter(atoms, weights, cost, 0.001, True, 300, 1e-8, "log").status.first()
    assert short.status == "max_iter" and short.error > 0.01
    long = barycenter(atoms, weights, cost, 0.001, True, 10_000, 1e-8, "log").values
    assert by_index(long) == pytest.approx([0.4, 0.6], abs=1e-4)


# --- derivatives -----------------------------------------------------------------------------


def moved_cost(make, a, b, c, eps, kind, rounds):
    cost = make.cost(c)
    solution = sinkhorn(
        make.histograms(a), make.histograms(b), cost, eps, rounds, 0.0, "exp", "batched"
    )
    plan = transport_plan(solution.values, cost, eps)
    return {r.problem_id: r.cost for r in transport_cost(plan, kind, eps).collect()}


@pytest.mark.parametrize("kind", ["linear", "regularized"])
def test_sinkhorn_gradient_by_finite_differences(make, kind):
    c, eps, rounds, h = [[0.1, 0.3, 0.2], [0.5, 0.1, 0.5], [0.4, 0.2, 0.1]], 0.1, 30, 1e-5
    start, other = np.array([0.2, 0.2, 0.6]), [0.3, 0.3, 0.4]
    steps = [start + sign * h * np.eye(3)[i] for i in range(3) for sign in (1, -1)]
    costs = moved_cost(make, [s.tolist() for s in steps], [other] * 6, c, eps, kind, rounds)
    numeric = np.array([(costs[2 * i] - costs[2 * i + 1]) / (2 * h) for i in range(3)])
    table = gr.sinkhorn_gradient(
        make.histograms([start.tolist()]), make.histograms([other]), make.cost(c), eps, kind, rounds, 0.0
    )
    got = np.array([r.grad for r in table.orderBy("i").collect()])
    assert got == pytest.approx(numeric - numeric.mean(), abs=1e-6)


def test_gradient_for_a_cost_beyond_the_tasks(make, monkeypatch):
    args = make.histograms(PAIR[0]), make.histograms(PAIR[1]), make.cost(PAIR[2]), 0.1, "regularized"
    dense = {r.i: r.grad for r in gr.sinkhorn_gradient(*args, tol=1e-12).collect()}
    monkeypatch.setattr("otindex.operators.ground.DENSE_WORDS", 1)
    joined = {r.i: r.grad for r in gr.sinkhorn_gradient(*args, tol=1e-12).collect()}
    assert joined == pytest.approx(dense, abs=1e-8)


def test_sinkhorn_jacobian_by_finite_differences(make):
    c, eps, rounds, h = np.array([[0.1, 0.3, 0.2], [0.5, 0.1, 0.5], [0.4, 0.2, 0.1]]), 0.1, 4, 1e-6
    a, b = np.array([0.2, 0.2, 0.6]), [0.3, 0.3, 0.4]
    table = gr.sinkhorn_jacobian(
        make.histograms([a.tolist()]), make.histograms([b]), make.cost(c), eps, rounds, 0.0
    )
    jac = {(r.side, r.out, r["in"]): r.value for r in table.collect()}
    shifted = [a + s * h * np.eye(3)[i] for i in range(3) for s in (1, -1)]
    solved = sinkhorn(
        make.histograms([s.tolist() for s in shifted]), make.histograms([b] * 6), make.cost(c), eps,
        rounds, 0.0, "exp", "batched",
    )
    u = {(r.side, r.idx, r.problem_id): np.exp(r.potential / eps) for r in solved.values.collect()}
    for side in "ab":
        for out in range(3):
            for i in range(3):
                numeric = (u[side, out, 2 * i] - u[side, out, 2 * i + 1]) / (2 * h)
                assert jac[side, out, i] == pytest.approx(numeric, rel=1e-4, abs=1e-4)


@pytest.mark.parametrize("debias", [False, True])
def test_barycenter_jacobian_by_finite_differences(spark, make, debias):
    eps, rounds, h = 2.0, 6, 1e-5
    w = np.array([0.2, 0.3, 0.5])
    atoms, weights = make.group(ATOMS, w)
    cost = make.cost(SQUARES)
    args = (atoms, weights, cost, eps)
    by_weight = {
        (r.out, r.member): r.value
        for r in gr.barycenter_jacobian(*args, "weights", debias, rounds, 0.0).collect()
    }
    by_atom = {
        (r.out, r.member, r["in"]): r.value
        for r in gr.barycenter_jacobian(*args, "atoms", debias, rounds, 0.0).collect()
    }
    moves = [("w", s) for s in range(3)] + [("a", s, i) for s in range(3) for i in range(4)]
    groups_a, groups_w = [], []
    for g, (move, sign) in enumerate((m, s) for m in moves for s in (1, -1)):
        columns, share = np.array(ATOMS), w.copy()
        if move[0] == "w":
            share[move[1]] += sign * h
        else:
            columns[move[1], move[2]] += sign * h
        groups_a += [(g, s, i, float(columns[s, i])) for s in range(3) for i in range(4)]
        groups_w += [(g, s, float(share[s])) for s in range(3)]
    solved = barycenter(
        spark.createDataFrame(groups_a, "group_id int, member int, idx int, p double"),
        spark.createDataFrame(groups_w, "group_id int, member int, weight double"),
        cost, eps, debias, rounds, 0.0, "exp", "batched",
    )
    b = {(r.group_id, r.idx): r.p for r in solved.values.collect()}
    for n, move in enumerate(moves):
        for out in range(4):
            numeric = (b[2 * n, out] - b[2 * n + 1, out]) / (2 * h)
            got = by_weight[out, move[1]] if move[0] == "w" else by_atom[out, move[1], move[2]]
            assert got == pytest.approx(numeric, abs=1e-6)


def test_oversized_cost_is_refused(make, monkeypatch):
    monkeypatch.setattr("otindex.operators.ground.DENSE_WORDS", 1)
    cost = make.cost([[0, 1], [1, 0]])
    assert choose_strategy("auto", cost) == "relational"
    with pytest.raises(ValueError):
        choose_strategy("batched", cost)


def test_log_sums_share_a_shift_only_where_it_is_safe(make):
    """One shift per vector gives the sums that a shift per sum gives, without sorting the joined rows."""
    squares = [[(i - j) ** 2 for j in range(4)] for i in range(4)]
    vectors = make.matrix([[-900.0, -905.0, -math.inf, -903.0], [700.0, 10.0, 3.0, -math.inf], [-math.inf] * 4], "key", "i")
    vectors = vectors.withColumnRenamed("value", "x")
    kernel = kernel_table(make.cost(squares), 0.1)
    assert choose_shift(kernel, "log") == "level" and choose_shift(kernel, "exp") == "exp"
    assert choose_shift(kernel_table(make.cost(squares).where("i < 3 or j < 3"), 0.1), "log") == "log"
    assert choose_shift(kernel_table(make.cost([[0, 70], [70, 0]]), 0.1), "log") == "log"
    shared, own = (smooth(vectors, kernel, "i", "j", ["key"], domain) for domain in ("level", "log"))
    found, expected = ({(r.key, r.j): r.x for r in t.collect()} for t in (shared, own))
    assert len(found) == 12 and found == pytest.approx(expected, rel=1e-12)
    plan = smooth(vectors, kernel, "i", "j", ["key"], "level")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Window")  # printed from the top: the window is below the join
