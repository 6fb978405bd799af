"""The kernel made from word vectors, sparse targets, stacked log-domain solvers, and stored states."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from otindex.functions import kernel as kn
from otindex.functions import scaling as sc
from otindex.operators import barycenter as bc
from otindex.operators import gradients as gr
from otindex.operators import transport as tr
from otindex.operators.barycenter import barycenter
from otindex.operators.distance import pairwise_distance
from otindex.operators.ground import DenseCost, VectorCost
from otindex.operators.transport import padded_stacks, sinkhorn, sinkhorn_pairs, solved_cost
from otindex.plans import dictionary as dl
from otindex.session import materialize
from otindex.spec import DictionarySpec


def vectors(n, dim=4, seed=0, scale=0.4):
    return np.random.default_rng(seed).normal(size=(n, dim)) * scale


def direct(X, Y):
    return ((X[:, None] - Y[None]) ** 2).sum(axis=2)


def vector_table(spark, X):
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(X)]
    return spark.createDataFrame(rows, "word_id int, vec array<double>")


@pytest.mark.parametrize("shift", [0.0, 1e4])
def test_distances_by_product_are_exact(shift):
    X = vectors(60) + shift
    X[7], X[8] = X[6], X[6] + 1e-7  # equal and almost equal
    found, wanted = kn.squared_distances(X, X), direct(X, X)
    assert np.allclose(found, wanted, rtol=1e-9, atol=0) and (np.diag(found) == 0).all()


def test_pairwise_distance_is_symmetric_and_exact(spark):
    X = vectors(300, 6)
    X[9] = X[3]
    rows = pairwise_distance(vector_table(spark, X), tile=64).toPandas()
    found = np.zeros((300, 300))
    found[rows["i"], rows["j"]] = rows["cost"]
    assert np.array_equal(found, found.T) and np.allclose(found, direct(X, X), rtol=1e-9, atol=0)


@pytest.mark.parametrize("rooted", [False, True])
def test_tiles_give_the_dense_product(monkeypatch, rooted):
    monkeypatch.setattr(kn, "TILE", 17)
    X, eps = vectors(80), 0.3
    cost = np.sqrt(direct(X, X)) if rooted else direct(X, X)
    dense = np.exp(-cost / eps)
    V = np.random.default_rng(1).normal(size=(80, 5))
    for room in (0, 1000, 10**6):
        monkeypatch.setattr(kn, "KEPT_VALUES", room)
        K = kn.VectorKernel(X, eps, rooted)
        assert np.allclose(K @ V, dense @ V, rtol=1e-11) and np.allclose(K @ V, dense @ V, rtol=1e-11)
    assert np.allclose(K.columns(np.array([3, 70])), dense[:, [3, 70]])


def test_the_factor_is_taken_only_where_it_is_exact_enough():
    X, eps = vectors(400, 2), 2.0
    dense = np.exp(-direct(X, X) / eps)
    L, residual = kn.factorize(X, eps, False)
    assert L.shape[1] <= 100 and np.abs(dense - L @ L.T).max() <= residual + 1e-14
    K = kn.VectorKernel(X, eps, False, L, residual)
    positive = np.random.default_rng(2).random((400, 3))
    exactly = []
    K.exactly = lambda V: exactly.append(V.shape) or dense @ V
    assert np.allclose(K @ positive, dense @ positive, rtol=1e-9, atol=0) and not exactly
    # one entry outweighs what the others reach: the bound of the error says so
    far = np.vstack([X, X[:1] + 40.0])
    L, residual = kn.factorize(far, eps, False)
    spiked = np.zeros((401, 1))
    spiked[0], spiked[400] = 1e12, 1e-12
    exact = np.exp(-direct(far, far) / eps) @ spiked
    assert np.allclose(kn.VectorKernel(far, eps, False, L, residual) @ spiked, exact, rtol=1e-9, atol=0)
    assert kn.factorize(vectors(50, 40, scale=3.0), 0.01, False) is None  # nearly the identity


def test_training_from_vectors_equals_training_from_the_cost(spark):
    """500 words: topics, weights, reconstruction and prediction agree with the dense cost."""
    n = 500
    X = vectors(n, 5)
    rng = np.random.default_rng(3)
    rows = []
    for d in range(8):
        words = np.sort(rng.choice(n, 12 + d, replace=False))
        p = rng.dirichlet(np.ones(len(words)))
        rows += [(d, int(w), float(x)) for w, x in zip(words, p)]
    docs = spark.createDataFrame(rows, "doc_id bigint, word_id int, p double")
    ground = vector_table(spark, X)
    cost = materialize(pairwise_distance(ground))
    spec = DictionarySpec(num_topics=2, batch_size=8, epochs=1, reg=0.5, max_iter=30, lr=0.05)
    one, two = dl.fit(docs, cost, spec), dl.fit(docs, ground, spec)
    topics = [{(r.topic, r.word_id): r.p for r in m.topics.collect()} for m in (one, two)]
    assert topics[0] == pytest.approx(topics[1], abs=1e-8, rel=1e-8)
    fitted = [{(r.doc_id, r.word_id): r.p for r in dl.reconstruct(one, g).collect()} for g in (cost, ground)]
    assert fitted[0] == pytest.approx(fitted[1], abs=1e-8, rel=1e-8)
    guesses = [dl.predict(one, docs, g, steps=3).orderBy("doc_id").collect() for g in (cost, ground)]
    for left, right in zip(*guesses):
        assert left.weights == pytest.approx(right.weights, abs=1e-8)
        assert (left.status, left.iterations) == (right.status, right.iterations)


@pytest.mark.parametrize("loss", ["squared", "linear", "regularized"])
def test_sparse_targets_give_the_stacked_loss(monkeypatch, loss):
    n, rng = 40, np.random.default_rng(4)
    X = vectors(n, 3)
    C = direct(X, X)
    dense, sparse = DenseCost(np.arange(n), C), VectorCost(np.arange(n), X)
    P = rng.dirichlet(np.ones(n), 3).T
    targets = [(np.sort(rng.choice(n, k, replace=False)), rng.dirichlet(np.ones(k))) for k in (1, 3, 9)]
    stacked = gr.loss_and_slope(dense, dense.kernel(0.4), P, targets, loss, 0.4, 25, 0.0)
    alone = gr.loss_and_slope(sparse, sparse.kernel(0.4), P, targets, loss, 0.4, 25, 0.0)
    monkeypatch.setattr(gr, "STACKED_WORDS", 0)
    gathered = gr.loss_and_slope(dense, dense.kernel(0.4), P, targets, loss, 0.4, 25, 0.0)
    for other in (alone, gathered):
        assert np.allclose(stacked[0], other[0], rtol=1e-9) and np.allclose(stacked[1], other[1], rtol=1e-8, atol=1e-10)
        assert list(stacked[2]) == list(other[2])


@pytest.mark.parametrize("debias", [False, True])
def test_few_stored_states_give_the_same_derivative(debias):
    rng = np.random.default_rng(5)
    K = np.exp(-direct(vectors(12), vectors(12)) / 0.5)
    A, W, bar = rng.dirichlet(np.ones(12), 3).T, rng.dirichlet(np.ones(3), 4), rng.normal(size=(12, 4))
    found = []
    for whole in (True, False):
        trail = []
        sc.barycenters(K, A[:, None, :], W, 37, 0.0, debias, trail, whole=whole)
        assert sum(len(starts) for _, starts, _ in trail) == (37 if whole else 4)
        found.append(sc.barycenters_reverse(K, A[:, None, :], W, trail, bar, debias))
    assert np.array_equal(found[0][0], found[1][0]) and np.array_equal(found[0][1], found[1][1])
    assert not gr._stacking(100_000, 1000, 5)[1] and gr._stacking(50, 40, 4)[1]


def test_log_product_never_underflows():
    rng = np.random.default_rng(6)
    C, X = rng.random((7, 9)) * 5000, rng.normal(size=(9, 4))
    found = sc.log_product(C, X, 1.0)
    shifted = X[None] - C[:, :, None]
    top = shifted.max(axis=1)
    assert np.allclose(found, top + np.log(np.exp(shifted - top[:, None]).sum(axis=1)))


def test_stacked_log_problems_equal_single_ones(spark, make, monkeypatch):
    """Supports of different sizes, padded; one problem underflows in the exp domain."""
    rng = np.random.default_rng(7)
    cost = make.cost(rng.random((6, 6)) * 20)
    sides = []
    for _ in "ab":
        columns = []
        for k in (1, 2, 6, 4, 3):
            p = np.zeros(6)
            p[rng.choice(6, k, replace=False)] = rng.dirichlet(np.ones(k))
            columns.append(p.tolist())
        sides.append(columns)
    both = [make.histograms(c) for c in sides]
    whole = sinkhorn(*both, cost, 0.05, 4000, 1e-10, "log", "batched")
    tables = {(r.problem_id, r.side, r.idx): r.potential for r in whole.values.collect()}
    status = {r.problem_id: (r.status, r.iterations) for r in whole.status.collect()}
    costs = {r.problem_id: r.cost for r in solved_cost(whole, cost, 0.05).collect()}
    for k in range(5):
        alone = sinkhorn(*(t.where(F.col("problem_id") == k) for t in both), cost, 0.05, 4000, 1e-10, "log", "batched")
        for r in alone.values.collect():
            assert tables[k, r.side, r.idx] == pytest.approx(r.potential, abs=1e-9)
        r = alone.status.first()
        assert status[k] == (r.status, r.iterations)
        assert costs[k] == pytest.approx(solved_cost(alone, cost, 0.05).first().cost, abs=1e-9)


def test_stacks_are_cut_by_their_padded_size(monkeypatch):
    import pandas as pd

    monkeypatch.setattr("otindex.operators.transport.STACK_VALUES", 20)
    rows = pd.DataFrame({"idx_a": [[0] * k for k in (2, 2, 5, 1, 9)], "idx_b": [[0] * k for k in (3, 2, 5, 1, 9)]})
    assert [len(s) for s in padded_stacks(rows)] == [2, 1, 1, 1]


@pytest.mark.parametrize("domain", ["exp", "log"])
@pytest.mark.parametrize("debias", [False, True])
def test_groups_of_any_size_share_a_stack(spark, make, domain, debias):
    rng = np.random.default_rng(8)
    X = vectors(7, 2)
    cost = make.cost(direct(X, X))
    atoms = weights = None
    for group, members in enumerate((1, 4, 2)):
        columns = rng.dirichlet(np.ones(7), members)
        columns[0][:3] = 0
        columns[0] /= columns[0].sum()
        one = make.group(columns.tolist(), rng.dirichlet(np.ones(members)).tolist(), group)
        atoms, weights = one if atoms is None else (atoms.unionByName(one[0]), weights.unionByName(one[1]))
    args = (cost, 0.5, debias, 3, 0.0, domain)
    stacked, joined = (barycenter(atoms, weights, *args, strategy=how) for how in ("batched", "relational"))
    found = [{(r.group_id, r.idx): r.p for r in s.values.collect()} for s in (stacked, joined)]
    assert found[0] == pytest.approx(found[1], abs=1e-10)
    errors = [{r.group_id: r.error for r in s.status.collect()} for s in (stacked, joined)]
    assert errors[0] == pytest.approx(errors[1], abs=1e-9)


def test_prediction_stops_and_says_so(spark, make):
    docs = make.histograms([[0.2, 0.2, 0.6], [0.6, 0.2, 0.2]], "doc_id", "word_id")
    cost = make.cost([[0.1, 0.3, 0.2], [0.5, 0.1, 0.5], [0.4, 0.2, 0.1]])
    model = dl.fit(docs, cost, DictionarySpec(num_topics=2, batch_size=2, epochs=1, max_iter=20, reg=0.2))
    done = dl.predict(model, docs, cost, steps=400, tol=1e-3).collect()
    assert {r.status for r in done} == {"converged"} and all(0 < r.iterations < 400 for r in done)
    cut = dl.predict(model, docs, cost, steps=2, tol=0.0).collect()
    assert {(r.status, r.iterations) for r in cut} == {("max_iter", 2)}
    steep = make.cost([[0.0, 9e4, 9e4], [9e4, 0.0, 9e4], [9e4, 9e4, 0.0]])
    lost = dl.predict(model, docs, steep, steps=5).collect()
    assert all(r.status in ("nonfinite", "max_iter", "converged") and abs(sum(r.weights) - 1) < 1e-9 for r in lost)


def test_jacobians_of_large_groups_come_in_blocks(spark, make, monkeypatch):
    """More members than a matrix of all outputs would hold at once: the same rows, block by block."""
    rng = np.random.default_rng(9)
    X = vectors(12, 2)
    cost = make.cost(direct(X, X))
    atoms, weights = make.group(rng.dirichlet(np.ones(12), 40).tolist(), rng.dirichlet(np.ones(40)).tolist())
    pair = [make.histograms(rng.dirichlet(np.ones(12), 2).tolist()) for _ in "ab"]
    found = []
    for values in (10**6, 1):
        monkeypatch.setattr(gr, "BLOCK_VALUES", values)
        rows = gr.barycenter_jacobian(atoms, weights, cost, 0.5, "atoms", True, 15, 0.0).collect()
        pairs = gr.sinkhorn_jacobian(*pair, cost, 0.5, 15, 0.0).collect()
        found.append(({tuple(r)[:4]: r.value for r in rows}, {tuple(r)[:4]: r.value for r in pairs}))
    assert len(found[0][0]) == 12 * 40 * 12 and len(found[0][1]) == 2 * 2 * 144
    assert found[0][0] == pytest.approx(found[1][0]) and found[0][1] == pytest.approx(found[1][1])


@pytest.mark.parametrize("domain", ["auto", "exp", "log"])
def test_pairs_from_vectors_equal_pairs_from_the_cost(spark, make, domain):
    """Histograms over any words: only the costs between a pair's own words are made."""
    rng = np.random.default_rng(10)
    X = vectors(9, 3)
    a, b = (make.histograms(rng.dirichlet(np.ones(9), 3).tolist(), "id") for _ in "ab")
    empty = spark.createDataFrame([(0, 0, 1), (1, 1, 1), (2, 2, 0), (3, 2, 77)], "problem_id bigint, a_id bigint, b_id bigint")
    dense = sinkhorn_pairs(empty, a, b, make.cost(direct(X, X)), 0.4, 500, 1e-10, "exp", "batched")
    sparse = sinkhorn_pairs(empty, a, b, vector_table(spark, X), 0.4, 500, 1e-10, domain)
    found = [{r.problem_id: (r.status, r.iterations) for r in s.status.collect()} for s in (dense, sparse)]
    assert found[0] == found[1] and found[1][3][0] == "empty"
    for kind in ("linear", "regularized"):
        costs = [{r.problem_id: r.cost for r in solved_cost(s, None, 0.4, kind).collect()} for s in (dense, sparse)]
        assert costs[0] == pytest.approx(costs[1], abs=1e-9)
    with pytest.raises(ValueError):
        sinkhorn_pairs(empty, a, b, vector_table(spark, X), 0.4, strategy="relational")


@pytest.mark.parametrize("domain", ["exp", "log"])
def test_a_large_pair_is_solved_in_blocks(domain):
    """In blocks, kept or not, a pair has the potentials, rounds and costs of its dense cost."""
    rng, eps = np.random.default_rng(12), 0.4
    X, Y = vectors(30, 3), vectors(70, 3, seed=1)
    a, b, C = rng.dirichlet(np.ones(30)), rng.dirichlet(np.ones(70)), direct(X, Y)
    f, g, status, rounds, error = sc.scale_pairs_log(C[None], a[None], b[None], eps, 500, 1e-9)
    mass = np.exp((f[0][:, None] + g[0][None, :] - C) / eps)
    for kept in (0, 500, 10_000):
        found = tr.solve_in_blocks(kn.PairKernel(X, Y, eps, values=100, kept=kept), a, b, 500, 1e-9, domain)
        plan = np.exp((found[0][:, None] + found[1][None, :] - C) / eps)
        assert plan == pytest.approx(mass, abs=1e-9)
        assert found[2:4] == (status[0], rounds[0]) and found[4] == pytest.approx(error[0], abs=1e-12)
        assert found[5] == pytest.approx((mass * C).sum(), abs=1e-9)
        assert found[6] == pytest.approx((mass * (eps * np.log(mass) + C - eps)).sum(), abs=1e-9)


@pytest.mark.parametrize("domain", ["auto", "log"])
def test_memory_of_a_pair_does_not_grow_with_its_coupling(domain):
    """500 x 20,000 words, whose coupling alone has 80 MB, once as costs and once as kernel."""
    rng = np.random.default_rng(13)
    X, Y = vectors(500, 3), vectors(20_000, 3, seed=1)
    a, b = rng.dirichlet(np.ones(500)), rng.dirichlet(np.ones(20_000))
    tracemalloc.start()
    found = tr.solve_in_blocks(kn.PairKernel(X, Y, 0.4, values=100_000, kept=1_000_000), a, b, 2, 0.0, domain)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[3] == 2 and np.isfinite(found[5]) and peak < 40_000_000


def test_a_group_is_held_by_its_numbers_not_its_members(make, monkeypatch):
    """A group of many members is solved in one task while its numbers fit, whatever its members."""
    rng = np.random.default_rng(5)
    columns = rng.dirichlet(np.ones(3), 300)
    atoms, weights = make.group(columns.tolist(), [1 / 300] * 300)
    cost = make.cost([[(i - j) ** 2 / 4 for j in range(3)] for i in range(3)])
    with monkeypatch.context() as patch:
        patch.setattr(bc, "_Relational", None)
        one = bc.barycenter(atoms, weights, cost, 0.1, True, max_iter=20, tol=0.0)
        found = [r.p for r in one.values.orderBy("idx").collect()]
    monkeypatch.setattr(bc, "GROUP_VALUES", 300)
    other = bc.barycenter(atoms, weights, cost, 0.1, True, max_iter=2, tol=0.0)
    same = bc.barycenter(atoms, weights, cost, 0.1, True, max_iter=2, tol=0.0, strategy="relational")
    assert len(found) == 3 and [r.p for r in other.values.orderBy("idx").collect()] == pytest.approx([r.p for r in same.values.orderBy("idx").collect()])


def test_log_stacks_are_narrow_enough_for_all_arrays_of_a_round():
    for words, rounds, topics in ((50, 1, 6), (50, 1000, 6), (4096, 40, 9)):
        width, _ = gr._stacking(words, rounds, topics, True)
        assert width == 1 or width * words * topics * 8 * min(rounds, 10) <= 2_000_000


def test_jacobian_rows_of_one_output_come_in_pieces(spark, make, monkeypatch):
    atoms, weights = make.group([[0.2, 0.8], [0.5, 0.5], [0.9, 0.1]], [0.2, 0.3, 0.5])
    cost = make.cost([[0, 0.3], [0.3, 0]])
    found = []
    for values in (1000, 2):
        monkeypatch.setattr(gr, "BLOCK_VALUES", values)
        rows = gr.barycenter_jacobian(atoms, weights, cost, 0.2, "atoms", max_iter=3, tol=0.0).collect()
        found.append({tuple(r)[:4]: r.value for r in rows})
    assert len(found[0]) == 12 and found[0] == pytest.approx(found[1], abs=1e-12)


def test_one_sweep_serves_the_outputs_of_both_sides():
    """Bars on both sides at once give the sum of the sweeps of each."""
    rng = np.random.default_rng(2)
    K, A, B = rng.uniform(0.1, 1, (3, 4)), rng.dirichlet(np.ones(3))[:, None], rng.dirichlet(np.ones(4))[:, None]
    trail = []
    sc.scale_pairs(K, A, B, 23, 0.0, trail)
    ubar, vbar = np.hstack([np.eye(3), np.zeros((3, 4))]), np.hstack([np.zeros((4, 3)), np.eye(4)])
    both = sc.pairs_reverse(K, A, B, trail, ubar, vbar)
    for at in range(7):
        one = sc.pairs_reverse(K, np.hstack([A, A]), np.hstack([B, B]), [(np.arange(2), np.hstack([v, v])) for _, v in trail], ubar[:, [at, at]], vbar[:, [at, at]])
        assert both[:, at] == pytest.approx(one[:, 0], abs=1e-12)
