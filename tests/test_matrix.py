import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from otindex.operators import linalg as la
from otindex.operators import svd
from otindex.operators import distance
from otindex.operators.distance import check_symmetric, pairwise_distance
from otindex.session import made_in_tasks, read_in_tasks

GOLDEN = [[20, 10, 15, 0, 2], [10, 5, 8, 1, 0], [0, 1, 2, 6, 3], [1, 0, 0, 10, 5]]


def dense(table, shape, row="i", col="j"):
    out = np.zeros(shape)
    for r in table.collect():
        out[r[row], r[col]] = r["value"]
    return out


@pytest.mark.parametrize("tile", [2, 100])
@pytest.mark.parametrize("metric", ["sqeuclidean", "euclidean"])
def test_pairwise_distance(spark, tile, metric):
    x = np.random.default_rng(0).normal(size=(7, 3))
    vectors = spark.createDataFrame(
        [(10 * i, [float(v) for v in row]) for i, row in enumerate(x)], "word_id int, vec array<double>"
    )
    cost = pairwise_distance(vectors, metric, tile=tile)
    expected = ((x[:, None] - x[None]) ** 2).sum(-1)
    expected = np.sqrt(expected) if metric == "euclidean" else expected
    rows = cost.collect()
    assert len(rows) == 49
    for r in rows:
        assert r.cost == pytest.approx(expected[r.i // 10, r.j // 10], abs=1e-12)
    assert tuple(check_symmetric(cost).first()) == (49, 0)


def test_check_symmetric_finds_gaps(make):
    assert tuple(check_symmetric(make.cost([[0, 1], [2, 0]])).first()) == (4, 1)
    assert tuple(check_symmetric(make.cost([[0, 1], [1, 0]]).where("i <= j")).first()) == (3, 1)


def test_products(make):
    rng = np.random.default_rng(1)
    a, b = rng.random((3, 4)), rng.random((4, 2))
    left, right = make.matrix(a), make.matrix(b)
    assert np.allclose(dense(la.matmul(left, right), (3, 2)), a @ b)
    assert np.allclose(dense(la.transpose(left), (4, 3)), a.T)
    other = make.matrix(a + 1)
    for op, expected in (("mul", a * (a + 1)), ("div", a / (a + 1)), ("pow", a ** (a + 1))):
        assert np.allclose(dense(la.hadamard(left, other, op), a.shape), expected)
    sums = {r.i: r.value for r in la.row_sums(left).collect()}
    assert np.allclose([sums[i] for i in range(3)], a.sum(1))
    scaled = la.scale(left, la.col_sums(left), "j", "div")
    assert np.allclose(dense(scaled, a.shape), a / a.sum(0))
    with pytest.raises(ValueError):
        la.hadamard(left, other, "minus")


def test_soft_operators_survive_large_values(make):
    z = np.array([[1000.0, 1001.0, 1002.0], [-1000.0, 0.0, 5.0]])
    found = {r.i: r.value for r in la.softmin(make.matrix(z), 0.5).collect()}
    low = z.min(1, keepdims=True)
    expected = low[:, 0] - 0.5 * np.log(np.exp(-(z - low) / 0.5).sum(1))
    assert np.allclose([found[0], found[1]], expected)
    top = np.exp(z - z.max(0))
    assert np.allclose(dense(la.softmax(make.matrix(z)), z.shape), top / top.sum(0))
    jac = dense(la.softmin_jacobian(make.matrix(z), 0.5), z.shape)
    assert np.allclose(jac, np.exp(-(z - low) / 0.5) / np.exp(-(z - low) / 0.5).sum(1, keepdims=True))


def test_softmax_jacobian(spark):
    y = np.array([0.2, 0.3, 0.5])
    table = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(y)], "col int, i int, value double")
    assert np.allclose(dense(la.softmax_jacobian(table), (3, 3)), np.diag(y) - np.outer(y, y))


def test_geomean_contract_and_tensor(spark, make):
    rng = np.random.default_rng(2)
    t, w = rng.random((3, 2)) + 0.1, np.array([0.3, 0.7])
    weights = spark.createDataFrame([(j, float(v)) for j, v in enumerate(w)], "j int, weight double")
    found = {r.i: r.value for r in la.row_geomean(make.matrix(t), weights).collect()}
    assert np.allclose([found[i] for i in range(3)], (t**w).prod(1))
    cube = rng.random((3, 4, 2))
    rows = [(i, j, k, float(cube[i, j, k])) for i in range(3) for j in range(4) for k in range(2)]
    x = spark.createDataFrame(rows, "i int, j int, k int, value double")
    out = la.weighted_contract(weights.withColumnRenamed("j", "k"), x, make.matrix(t, "i", "k"))
    assert np.allclose(dense(out, (3, 4)), np.einsum("k,ijk,ik->ij", w, cube, 1 / t))
    m = rng.random((5, 3))
    product = np.zeros((5, 4, 2))
    for r in la.tensor_product(make.matrix(m), x).collect():
        product[r.i, r.j, r.k] = r.value
    assert np.allclose(product, np.einsum("it,tjk->ijk", m, cube))


def test_marginal_error_counts_absent_entries(make):
    a, b = make.matrix([[1, 2], [3, 4]]), make.matrix([[1, 0], [3, 4]]).where("value > 0")
    assert la.marginal_error(a, b).first().error == pytest.approx(2.0)


def test_svd_golden(make):
    m = make.matrix(GOLDEN, "row_id", "col")
    for rule in ("auto", "sklearn"):
        rows = svd.truncated_svd(m, 2, rule).collect()
        got = {(r.row_id, r.component): r.value for r in rows}
        assert [got[i, 1] for i in range(4)] == pytest.approx(
            [26.97223175, 13.73834416, 1.98003873, 1.5472032], abs=1e-7
        )
        assert [got[i, 2] for i in range(4)] == pytest.approx(
            [-1.07652919, -0.08806552, 6.61789207, 11.07972543], abs=1e-7
        )


@pytest.mark.parametrize("shape", [(30, 5), (4, 25), (30, 25)])
def test_svd_paths_agree_with_numpy(make, monkeypatch, shape):
    monkeypatch.setattr(svd, "GRAM_SIDE", 10)
    rng = np.random.default_rng(3)
    x = rng.normal(size=shape) @ np.diag(0.7 ** np.arange(shape[1]))
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    m = make.matrix(x, "row_id", "col")
    for k, table in ((2, svd.truncated_svd(m, 2)),):
        got = dense(table.withColumn("component", F.col("component") - 1), (shape[0], k), "row_id", "component")
        for c in range(k):
            left, right = s[c] * u[:, c], s[c] * vt[c]
            pull = max((np.sum(left * abs(left)), np.sum(right * abs(right))), key=abs)
            assert np.allclose(got[:, c], left * np.sign(pull), atol=1e-6)


def test_randomized_svd_is_close(make):
    rng = np.random.default_rng(4)
    x = rng.random((12, 8))
    m = make.matrix(x, "row_id", "col")
    exact = {r.row_id: r.value for r in svd.truncated_svd(m, 1).collect()}
    for r in svd.randomized_svd(m, 1).collect():
        assert r.value == pytest.approx(exact[r.row_id], rel=1e-2)


def test_svd_rejects_bad_shapes(make):
    with pytest.raises(ValueError):
        svd.truncated_svd(make.matrix([[1], [2]], "row_id", "col"), 1)
    with pytest.raises(ValueError):
        svd.truncated_svd(make.matrix([[1, 2], [3, 4]], "row_id", "col"), 2)
    with pytest.raises(ValueError):
        svd.truncated_svd(make.matrix([[1, 2], [3, 4]], "row_id", "col"), 1, "other")


def test_joins_on_an_index_beyond_the_broadcast_limit(make, monkeypatch):
    rng = np.random.default_rng(4)
    a, b = rng.random((4, 5)), rng.random((5, 3))

    def product():
        out = la.matmul(make.matrix(a), make.matrix(b)).collect()
        return {(r.i, r.j): r.value for r in out}

    expected = {(i, j): v for i, line in enumerate(a @ b) for j, v in enumerate(line)}
    assert product() == pytest.approx(expected)
    monkeypatch.setattr("otindex.operators.linalg.BROADCAST_ROWS", 0)
    assert product() == pytest.approx(expected)


def test_check_symmetric_where_pairs_lie_apart(spark, monkeypatch):
    """Entries in any tasks, several of a pair, nulls and NaN: as one aggregation over the pairs says."""
    rng = np.random.default_rng(4)
    pairs = [(i, j) for i in range(9) for j in range(9)]
    rows = [(i, j, float(abs(i - j))) for i, j in pairs]
    rows += [(2, 5, 3.0), (7, 7, 0.0), (3, 1, None), (4, 4, float("nan")), (None, None, 1.0), (None, 6, 2.0), (20, 21, 1.0)]
    rows.remove((8, 0, 8.0))
    plain = spark.createDataFrame(rows, "i int, j int, cost double")
    spread = spark.createDataFrame([rows[k] for k in rng.permutation(len(rows))], plain.schema).repartition(3)
    monkeypatch.setattr("otindex.operators.distance.CHECK_ROWS", 10)
    for cost in (plain, plain.coalesce(1), spread):
        both = cost.groupBy(F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi")).agg(
            F.count(F.lit(1)).alias("n"), (F.max("cost") - F.min("cost")).alias("gap")
        )
        bad = (F.col("n") != F.when(F.col("lo") == F.col("hi"), 1).otherwise(2)) | (F.col("gap") > 0)
        expected = both.agg(F.sum("n"), F.sum(bad.cast("long"))).first()
        assert tuple(check_symmetric(cost).first()) == tuple(expected)
    assert tuple(check_symmetric(plain.where("i > 99")).first()) == (None, None)


def test_whole_pairs_come_as_ranges_and_vectors_are_not_sent_per_tile(spark, monkeypatch):
    vectors = spark.range(40).selectExpr("cast(id as int) AS word_id", "array(cast(id as double), 1.0D) AS vec")
    cost = pairwise_distance(vectors, tile=8)
    assert distance._ranges(cost.selectExpr("least(i, j) AS lo", "greatest(i, j) AS hi", "cost"), 0.0).count() < 400
    plan = cost._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    monkeypatch.setattr(distance, "BROADCAST_VALUES", 0)
    other = pairwise_distance(vectors, tile=8)
    assert sorted(map(tuple, cost.collect())) == sorted(map(tuple, other.collect()))


def test_check_symmetric_with_indices_far_apart(spark):
    far = 1 << 62
    rows = [(-far, far, 1.0), (far, -far, 1.0), (-far, -far, 0.0), (5, far, 2.0), (far, 5, 3.0)]
    assert tuple(check_symmetric(spark.createDataFrame(rows, "i bigint, j bigint, cost double").coalesce(1)).first()) == (5, 1)


def test_entries_are_checked_in_the_tasks_that_make_them(spark, monkeypatch):
    """Only ranges travel; gaps, lone entries and pairs of two tasks are found as in a plain table."""

    def make(batches):
        for batch in batches:
            for k in batch.column("id").to_pylist():
                rows = [(k, 5, 1.0), (5, k, 1.0 + (k == 1)), (k, k, 0.0), [(7, 8, 2.0), (8, 7, 2.0), (9, 3, float("nan"))][k]]
                i, j, cost = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(cost)], ["i", "j", "cost"])

    made = made_in_tasks(spark.range(3).repartition(3, "id"), make, "i int, j int, cost double")
    assert read_in_tasks(made.select("i", "j", "cost"), make, "i int") is None
    plain = tuple(check_symmetric(made.select("i", "j", "cost")).first())
    vectors = spark.range(300).selectExpr("cast(id as int) AS word_id", "array(cast(id as double), 1.0D) AS vec")
    monkeypatch.setattr(distance, "_ranges", None)
    assert tuple(check_symmetric(made).first()) == plain == (12, 2)
    assert tuple(check_symmetric(pairwise_distance(vectors, tile=8)).first()) == (90_000, 0)


def test_neighbouring_tiles_make_long_ranges(spark):
    vectors = spark.range(512).selectExpr("cast(id as int) AS word_id", "array(cast(id as double), 1.0D) AS vec")
    cost = pairwise_distance(vectors, tile=8)
    ranges = read_in_tasks(cost, lambda batches: distance._packed(0.0)(distance._keyed(batches)), distance.RANGES)
    # 2,080 tiles, each with ranges of its 8 first indices, come in groups of four
    assert ranges.count() < 8 * 2_080 / 3 and ranges.agg(F.sum("n")).first()[0] == 512 * 512
