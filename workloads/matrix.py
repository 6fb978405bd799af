"""Distances between vectors and matrices as coordinate tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from otindex.operators import linalg as la
from otindex.operators import optim
from otindex.operators.distance import check_symmetric, pairwise_distance
from otindex.operators.svd import randomized_svd, truncated_svd
from workloads.tables import EPS, KERNEL, PROFILES, profiles, quantity_cost, rounded, table


def _vectors(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select(F.col("vec_id").alias("word_id"), F.col("embedding").alias("vec"))


def pairwise_sq(spark, sf_dir):
    return rounded(pairwise_distance(_vectors(spark, sf_dir)), "cost")


def pairwise_euclid(spark, sf_dir):
    return rounded(pairwise_distance(_vectors(spark, sf_dir), "euclidean"), "cost")


def symmetric_check(spark, sf_dir):
    return check_symmetric(pairwise_distance(_vectors(spark, sf_dir)))


def _suppliers(spark, sf_dir):
    """Matrix of quantities by suppliers."""
    return profiles(spark, sf_dir).select(
        F.col("idx").alias("i"), F.col("id").alias("j"), F.col("p").alias("value")
    )


def _kernel(spark, sf_dir):
    kernel = la.gibbs_kernel(quantity_cost(spark, sf_dir), EPS)
    return kernel.select("i", "j", F.col("k").alias("value"))


def _smoothed(spark, sf_dir):
    return la.matmul(la.transpose(_kernel(spark, sf_dir)), _suppliers(spark, sf_dir))


def _shares(spark, sf_dir):
    """Each supplier's share of all lines."""
    sold = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("j")).count()
    total = sold.agg(F.sum("count").alias("n")).scalar()
    return sold.select("j", (F.col("count") / total).alias("weight"))


def kernel(spark, sf_dir):
    return rounded(la.gibbs_kernel(quantity_cost(spark, sf_dir), EPS), "cost", "k")


def matmul(spark, sf_dir):
    return rounded(_smoothed(spark, sf_dir), "value")


def hadamard(spark, sf_dir):
    a, b = _suppliers(spark, sf_dir), _smoothed(spark, sf_dir)
    parts = [
        la.hadamard(x, y, op).withColumn("op", F.lit(op))
        for op, x, y in (("mul", a, b), ("div", a, b), ("pow", b, a))
    ]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rounded(whole.select("op", "i", "j", "value"), "value")


def scale(spark, sf_dir):
    vector = la.row_sums(_suppliers(spark, sf_dir))
    return rounded(la.scale(_smoothed(spark, sf_dir), vector, "i", "div"), "value")


def row_sums(spark, sf_dir):
    return rounded(la.row_sums(_smoothed(spark, sf_dir)), "value")


def col_sums(spark, sf_dir):
    return rounded(la.col_sums(_smoothed(spark, sf_dir)), "value")


def row_geomean(spark, sf_dir):
    return rounded(la.row_geomean(_smoothed(spark, sf_dir), _shares(spark, sf_dir)), "value")


def softmin_rows(spark, sf_dir):
    return rounded(la.softmin(_smoothed(spark, sf_dir), 0.05, "i"), "value")


def softmin_cols(spark, sf_dir):
    return rounded(la.softmin(_smoothed(spark, sf_dir), 0.05, "j"), "value")


def _nations(spark, sf_dir):
    return profiles(spark, sf_dir, "s_nationkey")


def reduced_cost(spark, sf_dir):
    nations = _nations(spark, sf_dir)
    f = nations.select(F.col("id").alias("topic"), F.col("idx").alias("i"), F.col("p").alias("value"))
    g = f.select("topic", F.col("i").alias("j"), (2 * F.col("value")).alias("value"))
    return rounded(la.cost_minus_potentials(quantity_cost(spark, sf_dir), f, g), "value")


def _sharpened(spark, sf_dir):
    return _suppliers(spark, sf_dir).withColumn("value", F.col("value") * 100)


def softmax_cols(spark, sf_dir):
    return rounded(la.softmax(_sharpened(spark, sf_dir)), "value")


def softmax_jac(spark, sf_dir):
    y = _nations(spark, sf_dir).select(
        F.col("id").alias("col"), F.col("idx").alias("i"), F.col("p").alias("value")
    )
    return rounded(la.softmax_jacobian(y), "value", digits=9)


def softmin_jac(spark, sf_dir):
    return rounded(la.softmin_jacobian(_smoothed(spark, sf_dir), 0.05), "value", digits=9)


def _cube(spark, sf_dir):
    """``K[i, j] * A[j, k]`` for nations ``k``."""
    kernel = _kernel(spark, sf_dir).withColumnRenamed("value", "x")
    nations = _nations(spark, sf_dir).select(
        F.col("idx").alias("j"), F.col("id").alias("k"), F.col("p").alias("y")
    )
    return kernel.join(nations, "j").select("i", "j", "k", (F.col("x") * F.col("y")).alias("value"))


def contract(spark, sf_dir):
    cube = _cube(spark, sf_dir)
    y = cube.groupBy("i", "k").agg(F.sum("value").alias("value"))
    weights = y.groupBy("k").agg((1.0 / (1.0 + F.count(F.lit(1)))).alias("weight"))
    return rounded(la.weighted_contract(weights, cube, y), "value")


def tensor_product(spark, sf_dir):
    return rounded(la.tensor_product(_kernel(spark, sf_dir), _cube(spark, sf_dir)), "value")


def marginal_error(spark, sf_dir):
    smoothed = la.normalize_columns(_smoothed(spark, sf_dir))
    return rounded(la.marginal_error(smoothed, _suppliers(spark, sf_dir)), "error")


# --- optimizer steps -------------------------------------------------------------------------


def _parameters(spark, sf_dir):
    """Nation profiles with made moments, and their gap to the region profile as gradient."""
    nations = _nations(spark, sf_dir)
    parent = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("region")
    )
    regions = profiles(spark, sf_dir, "n_regionkey").select(
        F.col("id").alias("region"), "idx", F.col("p").alias("q")
    )
    joined = nations.join(parent, "id").join(regions, ["region", "idx"])
    state = joined.select(
        "id", "idx", F.col("p").alias("value"), (F.col("q") / 2).alias("m"),
        (F.col("q") * F.col("q")).alias("v"),
    )
    return state, joined.select("id", "idx", (F.col("p") - F.col("q")).alias("grad"))


def sgd_step(spark, sf_dir):
    state, grads = _parameters(spark, sf_dir)
    return rounded(optim.sgd_step(state, grads, ["id", "idx"], 0.5), "value")


def adam_step(spark, sf_dir):
    state, grads = _parameters(spark, sf_dir)
    return rounded(optim.adam_step(state, grads, ["id", "idx"], 3, 0.01), "value", "m", "v", digits=9)


def adamw_step(spark, sf_dir):
    state, grads = _parameters(spark, sf_dir)
    stepped = optim.adamw_step(state, grads, ["id", "idx"], 3, 0.01, 0.02)
    return rounded(stepped, "value", "m", "v", digits=9)


def batch_mean(spark, sf_dir):
    _, grads = _parameters(spark, sf_dir)
    return rounded(optim.batch_mean(grads, "idx"), "grad", digits=9)


def random_init(spark, sf_dir):
    return rounded(optim.random_init(_suppliers(spark, sf_dir), ["i", "j"], seed=7), "value", digits=9)


# --- singular values -------------------------------------------------------------------------


def _rows(spark, sf_dir):
    return profiles(spark, sf_dir).select(
        F.col("id").alias("row_id"), F.col("idx").alias("col"), F.col("p").alias("value")
    )


def tsvd(spark, sf_dir):
    return rounded(truncated_svd(_rows(spark, sf_dir), 1), "value")


def tsvd_signs(spark, sf_dir):
    return rounded(truncated_svd(_rows(spark, sf_dir), 2, "sklearn"), "value")


def rsvd(spark, sf_dir):
    return rounded(randomized_svd(_rows(spark, sf_dir), 1), "value", digits=4)


QUERIES = {
    "pairwise_sq": pairwise_sq,
    "pairwise_euclid": pairwise_euclid,
    "symmetric_check": symmetric_check,
    "kernel": kernel,
    "matmul": matmul,
    "hadamard": hadamard,
    "scale": scale,
    "row_sums": row_sums,
    "col_sums": col_sums,
    "row_geomean": row_geomean,
    "softmin_rows": softmin_rows,
    "softmin_cols": softmin_cols,
    "reduced_cost": reduced_cost,
    "softmax_cols": softmax_cols,
    "softmax_jac": softmax_jac,
    "softmin_jac": softmin_jac,
    "contract": contract,
    "tensor_product": tensor_product,
    "marginal_error": marginal_error,
    "sgd_step": sgd_step,
    "adam_step": adam_step,
    "adamw_step": adamw_step,
    "batch_mean": batch_mean,
    "random_init": random_init,
    "tsvd": tsvd,
    "tsvd_signs": tsvd_signs,
    "rsvd": rsvd,
}


def _pairs_sql(measure: str) -> str:
    return f"""
WITH parts AS (
  SELECT CAST(vec_id AS INTEGER) AS id, generate_subscripts(embedding, 1) AS at,
    CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings
),
squares AS (
  SELECT a.id AS i, b.id AS j, sum(pow(a.x - b.x, 2)) AS d FROM parts a JOIN parts b ON a.at = b.at GROUP BY 1, 2
)
{measure}"""


_SMOOTHED = f"""
WITH {PROFILES}, {KERNEL},
a AS (SELECT idx AS i, id AS j, p AS value FROM profile),
s AS MATERIALIZED (
  SELECT kernel.j AS i, a.j, sum(k * value) AS value FROM kernel JOIN a ON a.i = kernel.i GROUP BY 1, 2
)"""

_CUBE = f"""
WITH {PROFILES}, {KERNEL},
cube AS MATERIALIZED (
  SELECT kernel.i, kernel.j, id AS k, k * p AS value FROM kernel JOIN nation_profile ON idx = j
)"""

_STATE = f"""
WITH {PROFILES},
state AS (
  SELECT n.id, n.idx, n.p AS value, r.p / 2 AS m, r.p * r.p AS v, n.p - r.p AS grad
  FROM nation_profile n JOIN nation ON n.id = n_nationkey
  JOIN region_profile r ON r.id = n_regionkey AND r.idx = n.idx
)"""


def _adam_sql(lr: float, decay: float) -> str:
    return f"""{_STATE},
moments AS (
  SELECT id, idx, value, 0.9 * m + 0.1 * (grad + {decay} * value) AS m,
    0.999 * v + 0.001 * pow(grad + {decay} * value, 2) AS v FROM state
)
SELECT id, idx,
  round(value - ({lr} * (m / (1 - pow(0.9, 3))) / (sqrt(v / (1 - pow(0.999, 3))) + 1e-8) + {decay} * value), 9) + 0.0 AS value,
  round(m, 9) + 0.0 AS m, round(v, 9) + 0.0 AS v FROM moments"""


def _uniform_sql(stream: int) -> str:
    return f"(('0x' || substr(md5('7|{stream}|' || i || '|' || j), 1, 13))::BIGINT + 0.5) / 4503599627370496.0"


_RANDOM = f"""
WITH {PROFILES}, keys AS (SELECT idx AS i, id AS j FROM profile)
SELECT i, j, round(sqrt(-2 * ln({_uniform_sql(1)})) * cos(2 * pi() * {_uniform_sql(2)}), 9) + 0.0 AS value FROM keys"""


def _power_sql(rounds: int, digits: int) -> str:
    """Leading left singular vector times its value, by power iteration; entries are positive."""
    steps = ["v0 AS (SELECT idx, 1.0 / sqrt(count(*) OVER ()) AS x FROM bins)"]
    for r in range(1, rounds + 1):
        steps.append(f"""
y{r} AS MATERIALIZED (SELECT id, sum(p * x) AS y FROM profile JOIN v{r - 1} USING (idx) GROUP BY 1),
z{r} AS (SELECT idx, sum(p * y) AS z FROM profile JOIN y{r} USING (id) GROUP BY 1),
v{r} AS MATERIALIZED (SELECT idx, z / sqrt(sum(z * z) OVER ()) AS x FROM z{r})""")
    return f"""
WITH {PROFILES}, {', '.join(steps)}
SELECT id AS row_id, 1 AS component, round(sum(p * x), {digits}) AS value
FROM profile JOIN v{rounds} USING (idx) GROUP BY 1"""


ORACLES = {
    "random_init": _RANDOM,
    "pairwise_sq": _pairs_sql("SELECT i, j, round(d, 6) + 0.0 AS cost FROM squares"),
    "pairwise_euclid": _pairs_sql("SELECT i, j, round(sqrt(d), 6) + 0.0 AS cost FROM squares"),
    "symmetric_check": _pairs_sql("""SELECT count(*) AS entries,
  count(*) FILTER (WHERE t.d IS NULL OR t.d <> s.d) AS mismatches
FROM squares s LEFT JOIN squares t ON t.i = s.j AND t.j = s.i"""),
    "kernel": f"WITH {PROFILES}, {KERNEL} SELECT i, j, round(cost, 6) AS cost, round(k, 6) AS k FROM kernel",
    "matmul": f"{_SMOOTHED} SELECT i, j, round(value, 6) AS value FROM s",
    "hadamard": f"""{_SMOOTHED},
both_ AS (SELECT i, j, a.value AS x, s.value AS y FROM a JOIN s USING (i, j))
SELECT 'mul' AS op, i, j, round(x * y, 6) AS value FROM both_
UNION ALL SELECT 'div', i, j, round(x / y, 6) FROM both_
UNION ALL SELECT 'pow', i, j, round(pow(y, x), 6) FROM both_""",
    "scale": f"""{_SMOOTHED}
SELECT i, j, round(s.value / r.value, 6) AS value
FROM s JOIN (SELECT i, sum(value) AS value FROM a GROUP BY 1) r USING (i)""",
    "row_sums": f"{_SMOOTHED} SELECT i, round(sum(value), 6) AS value FROM s GROUP BY 1",
    "col_sums": f"{_SMOOTHED} SELECT j, round(sum(value), 6) AS value FROM s GROUP BY 1",
    "row_geomean": f"""{_SMOOTHED},
share AS (SELECT id AS j, sum(c) / (SELECT sum(c) FROM counts) AS weight FROM counts GROUP BY 1)
SELECT i, round(exp(sum(weight * ln(value))), 6) AS value FROM s JOIN share USING (j) GROUP BY 1""",
    "softmin_rows": f"""{_SMOOTHED},
low AS (SELECT i, min(value) AS low FROM s GROUP BY 1)
SELECT i, round(min(low) - 0.05 * ln(sum(exp((low - value) / 0.05))), 6) AS value FROM s JOIN low USING (i) GROUP BY 1""",
    "softmin_cols": f"""{_SMOOTHED},
low AS (SELECT j, min(value) AS low FROM s GROUP BY 1)
SELECT j, round(min(low) - 0.05 * ln(sum(exp((low - value) / 0.05))), 6) AS value FROM s JOIN low USING (j) GROUP BY 1""",
    "reduced_cost": f"""
WITH {PROFILES}
SELECT f.id AS topic, i, j, round(cost - f.p - 2 * g.p, 6) + 0.0 AS value
FROM cost JOIN nation_profile f ON f.idx = i JOIN nation_profile g ON g.idx = j AND g.id = f.id""",
    "softmax_cols": f"""
WITH {PROFILES}
SELECT idx AS i, id AS j, round(exp(100 * p) / sum(exp(100 * p)) OVER (PARTITION BY id), 6) AS value FROM profile""",
    "softmax_jac": f"""
WITH {PROFILES}
SELECT x.id AS col, x.idx AS i, y.idx AS j,
  round(CASE WHEN x.idx = y.idx THEN x.p ELSE 0 END - x.p * y.p, 9) + 0.0 AS value
FROM nation_profile x JOIN nation_profile y ON x.id = y.id""",
    "softmin_jac": f"""{_SMOOTHED}
SELECT i, j, round(exp(-value / 0.05) / sum(exp(-value / 0.05)) OVER (PARTITION BY i), 9) AS value FROM s""",
    "contract": f"""{_CUBE},
y AS (SELECT i, k, sum(value) AS y FROM cube GROUP BY 1, 2),
w AS (SELECT k, 1.0 / (1.0 + count(*)) AS weight FROM y GROUP BY 1)
SELECT i, j, round(sum(weight * value / y), 6) AS value
FROM cube JOIN y USING (i, k) JOIN w USING (k) GROUP BY 1, 2""",
    "tensor_product": f"""{_CUBE}
SELECT kernel.i, cube.j, cube.k, round(sum(kernel.k * cube.value), 6) AS value
FROM kernel JOIN cube ON kernel.j = cube.i GROUP BY 1, 2, 3""",
    "marginal_error": f"""{_SMOOTHED},
n AS (SELECT i, j, value / sum(value) OVER (PARTITION BY j) AS value FROM s)
SELECT round(sqrt(sum(pow(coalesce(n.value, 0) - coalesce(a.value, 0), 2))), 6) AS error
FROM n FULL JOIN a ON a.i = n.i AND a.j = n.j""",
    "sgd_step": f"{_STATE} SELECT id, idx, round(value - 0.5 * grad, 6) AS value FROM state",
    "adam_step": _adam_sql(0.01, 0.0),
    "adamw_step": _adam_sql(0.01, 0.02),
    "batch_mean": f"{_STATE} SELECT idx, round(avg(grad), 9) + 0.0 AS grad FROM state GROUP BY 1",
    "tsvd": _power_sql(16, 6),
    "rsvd": _power_sql(16, 4),
}
