"""Transport between suppliers and their nations, and barycenters of each nation's suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from otindex.operators import gradients as gr
from otindex.operators import text as tx
from otindex.operators.barycenter import barycenter
from otindex.operators.transport import (
    pair_problems,
    sinkhorn,
    sinkhorn_pairs,
    solved_cost,
    transport_cost,
    transport_plan,
)
from otindex.session import materialize
from workloads.tables import (
    EPS,
    KERNEL,
    PROFILES,
    nation_members,
    profiles,
    quantity_cost,
    rounded,
    supplier_pairs,
    table,
    tokenized,
    word_vectors,
)

EXACT = dict(max_iter=400, tol=1e-13)

#: Smoothing for costs between word vectors, and the least frequency of their words.
WORD_EPS, MIN_COUNT = 0.5, 5


def _problems(spark, sf_dir):
    return pair_problems(
        supplier_pairs(spark, sf_dir),
        profiles(spark, sf_dir),
        profiles(spark, sf_dir, "s_nationkey"),
    )


def _rounds(spark, sf_dir, rounds, domain):
    a, b = _problems(spark, sf_dir)
    cost = quantity_cost(spark, sf_dir)
    solution = sinkhorn(
        a, b, cost, EPS, max_iter=rounds, tol=0.0, domain=domain, strategy="relational"
    )
    return solution.values, cost


def _converged(spark, sf_dir):
    cost = quantity_cost(spark, sf_dir)
    suppliers, nations = profiles(spark, sf_dir), profiles(spark, sf_dir, "s_nationkey")
    pairs = supplier_pairs(spark, sf_dir)
    return sinkhorn_pairs(pairs, suppliers, nations, cost, EPS, **EXACT), cost


def sinkhorn_3(spark, sf_dir):
    return rounded(_rounds(spark, sf_dir, 3, "exp")[0], "potential")


def sinkhorn_log_2(spark, sf_dir):
    return rounded(_rounds(spark, sf_dir, 2, "log")[0], "potential")


def sinkhorn_log_batched(spark, sf_dir):
    """Two rounds in the log domain, all problems of a task in one padded stack."""
    a, b = _problems(spark, sf_dir)
    solution = sinkhorn(a, b, quantity_cost(spark, sf_dir), EPS, 2, 0.0, "log", "batched")
    return rounded(solution.values, "potential")


def _plan_3(spark, sf_dir):
    potentials, cost = _rounds(spark, sf_dir, 3, "exp")
    return transport_plan(potentials, cost, EPS)


def plan_3(spark, sf_dir):
    return rounded(_plan_3(spark, sf_dir).select("problem_id", "i", "j", "mass"), "mass", digits=9)


def cost_linear_3(spark, sf_dir):
    return rounded(transport_cost(_plan_3(spark, sf_dir)), "cost")


def cost_regularized_3(spark, sf_dir):
    return rounded(transport_cost(_plan_3(spark, sf_dir), "regularized", EPS), "cost")


def sinkhorn_converged(spark, sf_dir):
    solution, cost = _converged(spark, sf_dir)
    return rounded(solved_cost(solution, cost, EPS), "cost")


def regularized_converged(spark, sf_dir):
    solution, cost = _converged(spark, sf_dir)
    return rounded(solved_cost(solution, cost, EPS, "regularized"), "cost")


def sinkhorn_status(spark, sf_dir):
    a, b = _problems(spark, sf_dir)
    return rounded(sinkhorn(a, b, quantity_cost(spark, sf_dir), EPS).status, "error", digits=10)


def sinkhorn_gradient(spark, sf_dir):
    """At convergence the derivative of the regularized cost is the centered potential."""
    a, b = _problems(spark, sf_dir)
    cost = quantity_cost(spark, sf_dir)
    return rounded(gr.sinkhorn_gradient(a, b, cost, EPS, "regularized", **EXACT), "grad", digits=4)


def sinkhorn_gradient_linear(spark, sf_dir):
    a, b = _problems(spark, sf_dir)
    return gr.sinkhorn_gradient(a, b, quantity_cost(spark, sf_dir), EPS, "linear")


def sinkhorn_gradient_2(spark, sf_dir):
    """The derivative through exactly two rounds."""
    a, b = _problems(spark, sf_dir)
    cost = quantity_cost(spark, sf_dir)
    return rounded(gr.sinkhorn_gradient(a, b, cost, EPS, "linear", 2, 0.0), "grad")


def sinkhorn_gradient_log_2(spark, sf_dir):
    """The same by the reverse of the log updates."""
    a, b = _problems(spark, sf_dir)
    cost = quantity_cost(spark, sf_dir)
    return rounded(gr.sinkhorn_gradient(a, b, cost, EPS, "linear", 2, 0.0, "log"), "grad")


def sinkhorn_jacobian_1(spark, sf_dir):
    """The derivatives through one round."""
    a, b = _problems(spark, sf_dir)
    jacobian = gr.sinkhorn_jacobian(a, b, quantity_cost(spark, sf_dir), EPS, 1, 0.0)
    return rounded(jacobian, "value")


def sinkhorn_jacobian(spark, sf_dir):
    a, b = _problems(spark, sf_dir)
    return gr.sinkhorn_jacobian(a, b, quantity_cost(spark, sf_dir), EPS)


def _barycenter(rounds, domain, debias):
    def query(spark, sf_dir):
        atoms, weights = nation_members(spark, sf_dir)
        solution = barycenter(
            atoms, weights, quantity_cost(spark, sf_dir), EPS, debias, max_iter=rounds, tol=0.0,
            domain=domain, strategy="relational",
        )
        return rounded(solution.values, "p", digits=8)

    return query


def _stacked_barycenter(rounds, debias):
    """Some rounds in the log domain, all groups of a task in one stack."""

    def query(spark, sf_dir):
        atoms, weights = nation_members(spark, sf_dir)
        cost = quantity_cost(spark, sf_dir)
        solution = barycenter(atoms, weights, cost, EPS, debias, max_iter=rounds, tol=0.0, domain="log", strategy="auto")
        return rounded(solution.values, "p", digits=8)

    return query


def barycenter_converged(spark, sf_dir):
    atoms, weights = nation_members(spark, sf_dir)
    solution = barycenter(atoms, weights, quantity_cost(spark, sf_dir), EPS, **EXACT)
    return rounded(solution.values, "p")


def barycenter_debiased(spark, sf_dir):
    atoms, weights = nation_members(spark, sf_dir)
    return barycenter(atoms, weights, quantity_cost(spark, sf_dir), EPS, True).values


def barycenter_status(spark, sf_dir):
    atoms, weights = nation_members(spark, sf_dir)
    return rounded(barycenter(atoms, weights, quantity_cost(spark, sf_dir), EPS).status, "error", digits=10)


def _jacobian(wrt):
    def query(spark, sf_dir):
        atoms, weights = nation_members(spark, sf_dir)
        cost = quantity_cost(spark, sf_dir)
        return gr.barycenter_jacobian(atoms, weights, cost, EPS, wrt, debias=True, max_iter=50)

    return query


def document_transport(spark, sf_dir):
    """Each document against all documents of its source, over all words seen ``MIN_COUNT`` times.

    A document without such a word says that it is empty.
    """
    documents = table(spark, sf_dir, "documents")
    tok = tokenized(spark, sf_dir)
    vocabulary = materialize(tx.build_vocabulary(tok, MIN_COUNT))
    vectors = materialize(word_vectors(vocabulary, table(spark, sf_dir, "embeddings")))
    counts = tx.lookup_words(tx.word_counts(tok), vocabulary).where("word_id is not null")
    counts = materialize(counts.join(documents.select("doc_id", "source"), "doc_id"))
    by_doc = tx.distribution(counts, "doc_id", "word_id", "count").withColumnRenamed("doc_id", "id")
    by_source = tx.distribution(counts, "source", "word_id", "count").withColumnRenamed("source", "id")
    pairs = documents.select(
        F.col("doc_id").alias("problem_id"), F.col("doc_id").alias("a_id"), F.col("source").alias("b_id")
    )
    solution = sinkhorn_pairs(pairs, by_doc, by_source, vectors, WORD_EPS)
    costs = solution.status.select("problem_id", "status").join(
        solved_cost(solution, vectors, WORD_EPS), "problem_id", "left"
    )
    return rounded(costs.select("problem_id", (F.col("status") == "empty").alias("empty"), "cost"), "cost")


def _jacobian_1(wrt):
    def query(spark, sf_dir):
        atoms, weights = nation_members(spark, sf_dir)
        cost = quantity_cost(spark, sf_dir)
        jacobian = gr.barycenter_jacobian(atoms, weights, cost, EPS, wrt, max_iter=1, tol=0.0)
        return rounded(jacobian, "value", digits=7)

    return query


QUERIES = {
    "sinkhorn_3": sinkhorn_3,
    "sinkhorn_log_2": sinkhorn_log_2,
    "sinkhorn_log_batched": sinkhorn_log_batched,
    "barycenter_log_batched": _stacked_barycenter(2, False),
    "debiased_log_batched": _stacked_barycenter(2, True),
    "plan_3": plan_3,
    "cost_linear_3": cost_linear_3,
    "cost_regularized_3": cost_regularized_3,
    "sinkhorn_converged": sinkhorn_converged,
    "regularized_converged": regularized_converged,
    "sinkhorn_status": sinkhorn_status,
    "sinkhorn_gradient": sinkhorn_gradient,
    "sinkhorn_gradient_linear": sinkhorn_gradient_linear,
    "sinkhorn_jacobian": sinkhorn_jacobian,
    "barycenter_3": _barycenter(3, "exp", False),
    "barycenter_log_2": _barycenter(2, "log", False),
    "debiased_2": _barycenter(2, "exp", True),
    "debiased_log_2": _barycenter(2, "log", True),
    "barycenter_converged": barycenter_converged,
    "barycenter_debiased": barycenter_debiased,
    "barycenter_status": barycenter_status,
    "barycenter_jacobian_weights": _jacobian("weights"),
    "barycenter_jacobian_atoms": _jacobian("atoms"),
    "sinkhorn_gradient_2": sinkhorn_gradient_2,
    "sinkhorn_gradient_log_2": sinkhorn_gradient_log_2,
    "sinkhorn_jacobian_1": sinkhorn_jacobian_1,
    "barycenter_jacobian_weights_1": _jacobian_1("weights"),
    "barycenter_jacobian_atoms_1": _jacobian_1("atoms"),
    "document_transport": document_transport,
}


def _rounds_sql(rounds: int) -> str:
    """Scalings ``u`` and ``v`` of the problems in ``a`` and ``b``, one table per half round."""
    steps = ["v0 AS (SELECT problem_id, j, 1.0 AS v FROM b)"]
    for r in range(1, rounds + 1):
        steps.append(f"""
u{r} AS MATERIALIZED (
  SELECT problem_id, i, p / s AS u FROM a JOIN (
    SELECT problem_id, i, sum(k * v) AS s FROM v{r - 1} JOIN kernel USING (j) GROUP BY 1, 2
  ) USING (problem_id, i)
),
v{r} AS MATERIALIZED (
  SELECT problem_id, j, p / s AS v FROM b JOIN (
    SELECT problem_id, j, sum(k * u) AS s FROM u{r} JOIN kernel USING (i) GROUP BY 1, 2
  ) USING (problem_id, j)
)""")
    return ", ".join(steps)


def _pairs_sql(rounds: int) -> str:
    """Suppliers against their nations."""
    return f"""WITH {PROFILES}, {KERNEL},
a AS MATERIALIZED (SELECT id AS problem_id, idx AS i, p FROM profile),
b AS MATERIALIZED (
  SELECT s_suppkey AS problem_id, idx AS j, p FROM supplier JOIN nation_profile ON id = s_nationkey
),
{_rounds_sql(rounds)}"""


def _first_check(key: str, checks: list[int], errors: str) -> str:
    """The first look at the errors, every ten rounds, that finds them below 1e-8."""
    return f"""{errors}
SELECT {key}, 'converged' AS status, rounds AS iterations, round(error, 10) + 0.0 AS error
FROM ({" UNION ALL ".join(f"SELECT {c}::INT AS rounds, * FROM e{c}" for c in checks)}) WHERE error < 1e-8
QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY rounds) = 1"""


def _status_sql(rounds: int) -> str:
    checks = list(range(10, rounds + 1, 10))
    errors = [
        f"""e{c} AS (
  SELECT problem_id, sqrt(sum(pow(p - u * s, 2))) AS error FROM a JOIN u{c} USING (problem_id, i) JOIN (
    SELECT problem_id, i, sum(k * v) AS s FROM v{c} JOIN kernel USING (j) GROUP BY 1, 2
  ) USING (problem_id, i) GROUP BY 1
)"""
        for c in checks
    ]
    return _first_check("problem_id", checks, ", ".join([_pairs_sql(rounds), *errors]))


def _potentials_sql(rounds: int) -> str:
    return f"""{_pairs_sql(rounds)}
SELECT problem_id, 'a' AS side, i AS idx, round({EPS} * ln(u), 6) + 0.0 AS potential FROM u{rounds}
UNION ALL
SELECT problem_id, 'b', j, round({EPS} * ln(v), 6) + 0.0 FROM v{rounds}"""


def _plan_sql(rounds: int, select: str) -> str:
    return f"""{_pairs_sql(rounds)},
plan AS (
  SELECT problem_id, i, j, u * k * v AS mass, cost
  FROM u{rounds} JOIN kernel USING (i) JOIN v{rounds} USING (problem_id, j)
)
{select}"""


_LINEAR = "SELECT problem_id, round(sum(mass * cost), 6) AS cost FROM plan GROUP BY 1"


_REGULARIZED = f"""
SELECT problem_id, round(sum(mass * cost + {EPS} * mass * (ln(mass) - 1)), 6) AS cost FROM plan GROUP BY 1"""


def _barycenter_sql(rounds: int, debias: bool, digits: int) -> str:
    steps = [
        """atom AS MATERIALIZED (SELECT group_id, member, weight, idx AS i, p FROM weight JOIN profile ON id = member),
v0 AS (SELECT group_id, member, idx AS j, 1.0 AS v FROM weight, bins),
d0 AS (SELECT group_id, idx AS j, 1.0 AS d FROM (SELECT DISTINCT group_id FROM weight), bins)"""
    ]
    for r in range(1, rounds + 1):
        steps.append(f"""
u{r} AS MATERIALIZED (
  SELECT group_id, member, weight, i, p / s AS u FROM atom JOIN (
    SELECT group_id, member, i, sum(k * v) AS s FROM v{r - 1} JOIN kernel USING (j) GROUP BY 1, 2, 3
  ) USING (group_id, member, i)
),
t{r} AS MATERIALIZED (
  SELECT group_id, member, weight, j, sum(k * u) AS t FROM u{r} JOIN kernel USING (i) GROUP BY 1, 2, 3, 4
),
b{r} AS MATERIALIZED (
  SELECT group_id, j, min(d) * exp(sum(weight * ln(t))) AS b
  FROM t{r} JOIN d{r - 1} USING (group_id, j) GROUP BY 1, 2
),
v{r} AS MATERIALIZED (SELECT group_id, member, j, b / t AS v FROM t{r} JOIN b{r} USING (group_id, j))""")
        if debias:
            steps.append(f"""
kd{r} AS (SELECT group_id, i AS j, sum(k * d) AS kd FROM d{r - 1} JOIN kernel USING (j) GROUP BY 1, 2),
d{r} AS MATERIALIZED (
  SELECT group_id, j, sqrt(d * b / kd) AS d
  FROM d{r - 1} JOIN b{r} USING (group_id, j) JOIN kd{r} USING (group_id, j)
)""")
        else:
            steps.append(f"d{r} AS (SELECT * FROM d{r - 1})")
    return f"""WITH {PROFILES}, {KERNEL}, {', '.join(steps)}
SELECT group_id, j AS idx, round(b, {digits}) AS p FROM b{rounds}"""


def _barycenter_status_sql(rounds: int) -> str:
    checks = list(range(10, rounds + 1, 10))
    errors = [
        f"""e{c} AS (
  SELECT group_id, sqrt(sum(pow(p - u * s, 2))) AS error FROM atom JOIN u{c} USING (group_id, member, i) JOIN (
    SELECT group_id, member, i, sum(k * v) AS s FROM v{c} JOIN kernel USING (j) GROUP BY 1, 2, 3
  ) USING (group_id, member, i) GROUP BY 1
)"""
        for c in checks
    ]
    rounds_sql = _barycenter_sql(rounds, False, 8).rsplit("SELECT", 1)[0].rstrip()
    return _first_check("group_id", checks, ", ".join([rounds_sql, *errors]))


def _applied(name: str, vector: str, value: str, inner: str, outer: str, weight: str = "k") -> str:
    """``name``: the kernel (or kernel times cost) applied to a vector table."""
    return f"""{name} AS MATERIALIZED (
  SELECT problem_id, {outer}, sum({weight} * {value}) AS x FROM {vector} JOIN kernel USING ({inner}) GROUP BY 1, 2
)"""


_GRADIENT_2 = f"""{_pairs_sql(2)},
{_applied("kv0", "v0", "v", "j", "i")}, {_applied("kv1", "v1", "v", "j", "i")},
{_applied("t1", "u1", "u", "i", "j")}, {_applied("t2", "u2", "u", "i", "j")},
{_applied("ubar", "v2", "v", "j", "i", "k * cost")}, {_applied("vbar2", "u2", "u", "i", "j", "k * cost")},
tbar2 AS (SELECT problem_id, j, -vbar2.x * v / t2.x AS y FROM vbar2 JOIN v2 USING (problem_id, j) JOIN t2 USING (problem_id, j)),
{_applied("back2", "tbar2", "y", "j", "i")},
ubar2 AS MATERIALIZED (SELECT problem_id, i, ubar.x + back2.x AS y FROM ubar JOIN back2 USING (problem_id, i)),
kvbar AS (SELECT problem_id, i, -y * u / kv1.x AS y FROM ubar2 JOIN u2 USING (problem_id, i) JOIN kv1 USING (problem_id, i)),
{_applied("vbar1", "kvbar", "y", "i", "j")},
tbar1 AS (SELECT problem_id, j, -vbar1.x * v / t1.x AS y FROM vbar1 JOIN v1 USING (problem_id, j) JOIN t1 USING (problem_id, j)),
{_applied("ubar1", "tbar1", "y", "j", "i")},
total AS (
  SELECT problem_id, i, y / kv1.x + ubar1.x / kv0.x AS g FROM ubar2 JOIN kv1 USING (problem_id, i)
  JOIN ubar1 USING (problem_id, i) JOIN kv0 USING (problem_id, i)
)
SELECT problem_id, i, round(g - avg(g) OVER (PARTITION BY problem_id), 6) + 0.0 AS grad FROM total"""

_JACOBIAN_1 = f"""{_pairs_sql(1)},
{_applied("kv0", "v0", "v", "j", "i")}, {_applied("t1", "u1", "u", "i", "j")}
SELECT problem_id, 'a' AS side, l.i AS out, r.i AS in,
  round(CASE WHEN l.i = r.i THEN 1 / x ELSE 0 END, 6) + 0.0 AS value
FROM a l JOIN a r USING (problem_id) JOIN kv0 ON kv0.problem_id = l.problem_id AND kv0.i = l.i
UNION ALL
SELECT problem_id, 'b', j, i, round(-p / pow(t1.x, 2) * k / kv0.x, 6) + 0.0
FROM b JOIN t1 USING (problem_id, j) JOIN kv0 USING (problem_id) JOIN kernel USING (i, j)"""

_BARYCENTER_1 = _barycenter_sql(1, False, 8).rsplit("SELECT", 1)[0]

ORACLES = {
    "sinkhorn_gradient_2": _GRADIENT_2,
    "sinkhorn_gradient_log_2": _GRADIENT_2,
    "sinkhorn_jacobian_1": _JACOBIAN_1,
    "barycenter_jacobian_weights_1": f"""{_BARYCENTER_1}
SELECT group_id, j AS out, member, round(b * ln(t), 7) + 0.0 AS value FROM t1 JOIN b1 USING (group_id, j)""",
    "barycenter_jacobian_atoms_1": f"""{_BARYCENTER_1},
ones AS (SELECT i, sum(k) AS kv FROM kernel GROUP BY 1)
SELECT group_id, j AS out, member, i AS in, round(weight * b / t * k / kv, 7) + 0.0 AS value
FROM t1 JOIN b1 USING (group_id, j) JOIN kernel USING (j) JOIN ones USING (i)""",
    "sinkhorn_3": _potentials_sql(3),
    "sinkhorn_log_2": _potentials_sql(2),
    "sinkhorn_log_batched": _potentials_sql(2),
    "barycenter_log_batched": _barycenter_sql(2, False, 8),
    "debiased_log_batched": _barycenter_sql(2, True, 8),
    "plan_3": _plan_sql(3, "SELECT problem_id, i, j, round(mass, 9) AS mass FROM plan"),
    "cost_linear_3": _plan_sql(3, _LINEAR),
    "cost_regularized_3": _plan_sql(3, _REGULARIZED),
    "sinkhorn_status": _status_sql(80),
    "barycenter_status": _barycenter_status_sql(60),
    "sinkhorn_converged": _plan_sql(80, _LINEAR),
    "regularized_converged": _plan_sql(80, _REGULARIZED),
    "sinkhorn_gradient": f"""{_pairs_sql(80)}
SELECT problem_id, i, round({EPS} * (ln(u) - avg(ln(u)) OVER (PARTITION BY problem_id)), 4) + 0.0 AS grad FROM u80""",
    "barycenter_3": _barycenter_sql(3, False, 8),
    "barycenter_log_2": _barycenter_sql(2, False, 8),
    "debiased_2": _barycenter_sql(2, True, 8),
    "debiased_log_2": _barycenter_sql(2, True, 8),
    "barycenter_converged": _barycenter_sql(60, False, 6),
}
