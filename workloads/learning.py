"""Dictionary learning: on supplier profiles, and end to end on the documents."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from otindex.operators.gradients import batch_gradient
from otindex.plans import dictionary as dl
from otindex.plans import index as ix
from otindex.session import working_folder
from otindex.sources.model_store import load_model, save_model
from otindex.spec import DictionarySpec, IndexSpec
from workloads.tables import EPS, KERNEL, PROFILES, corpus, profiles, quantity_cost, rounded, table

#: One round and a squared loss: short enough to write out in SQL.
ONE_ROUND = DictionarySpec(num_topics=5, reg=EPS, max_iter=1, tol=0.0, debias=False, loss="squared")

SMALL = DictionarySpec(num_topics=3, batch_size=64, epochs=2, max_iter=40, lr=0.05)

#: The same with as many epochs and rounds as the reference: 5 and up to 1,000.
WHOLE = DictionarySpec(num_topics=3, batch_size=64, lr=0.05)

#: The end-to-end model: all words, and one pass over the documents.
INDEX = IndexSpec(dictionary=DictionarySpec(batch_size=500, epochs=1, max_iter=10, reg=0.5, lr=0.05))


def _shares(spark, sf_dir):
    return profiles(spark, sf_dir).select(
        F.col("id").alias("doc_id"), F.col("idx").alias("word_id"), "p"
    )


def squared_loss(spark, sf_dir):
    """Each supplier's profile against that of its nation."""
    supplier = table(spark, sf_dir, "supplier")
    nations = profiles(spark, sf_dir, "s_nationkey").withColumnRenamed("id", "s_nationkey")
    predicted = supplier.join(nations, "s_nationkey").select(
        F.col("s_suppkey").alias("doc_id"), F.col("idx").alias("word_id"), "p"
    )
    return rounded(dl.reconstruction_loss(predicted, _shares(spark, sf_dir)), "loss", digits=9)


def _gradient(spark, sf_dir, domain="auto"):
    topics = profiles(spark, sf_dir, "n_regionkey").select(
        F.col("id").alias("topic"), F.col("idx").alias("word_id"), F.ln("p").alias("logit")
    )
    docs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"))
    logits = F.array(*(0.3 * F.pmod(F.col("doc_id") + k, F.lit(5)) for k in range(5)))
    weights = docs.withColumn("logits", logits)
    return batch_gradient(
        _shares(spark, sf_dir), topics, weights, quantity_cost(spark, sf_dir), replace(ONE_ROUND, domain=domain)
    )


def _given_model(spark, sf_dir):
    """Region profiles as topics and fixed weights per supplier."""
    topics = profiles(spark, sf_dir, "n_regionkey").select(
        F.col("id").alias("topic"), F.col("idx").alias("word_id"), "p"
    )
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc_id"))
    logits = F.array(*(0.3 * F.pmod(F.col("doc_id") + k, F.lit(5)) for k in range(5)))
    weights = suppliers.select("doc_id", dl.softmax_array(logits).alias("weights"))
    spec = DictionarySpec(num_topics=5, reg=EPS, max_iter=2, tol=0.0)
    history = spark.createDataFrame([], "step int, epoch int, batch int, loss double")
    return dl.DictionaryModel(topics, weights, history, spec), quantity_cost(spark, sf_dir)


def model_round_trip(spark, sf_dir):
    """Weights and topics of a model after saving and loading it."""
    path = working_folder(spark, "model")
    model, _ = _given_model(spark, sf_dir)
    save_model(model, path)
    loaded = load_model(spark, path)
    assert loaded.spec == model.spec
    weights = loaded.weights.select("doc_id", F.posexplode("weights").alias("topic", "value"))
    topics = loaded.topics.select(F.lit(-1).alias("doc_id"), (1000 * (F.col("topic") + 1) + F.col("word_id")).alias("topic"), F.col("p").alias("value"))
    return rounded(weights.select(F.col("doc_id").cast("long"), F.col("topic").cast("long"), "value").unionByName(
        topics.select(F.col("doc_id").cast("long"), F.col("topic").cast("long"), "value")
    ), "value", digits=9)


def reconstruct_given(spark, sf_dir):
    return rounded(dl.reconstruct(*_given_model(spark, sf_dir)), "p", digits=8)


def scores_topics_given(spark, sf_dir):
    return rounded(dl.document_scores(_given_model(spark, sf_dir)[0]), "score")


def scores_docs_given(spark, sf_dir):
    return rounded(dl.document_scores(*_given_model(spark, sf_dir), "docs"), "score")


def batch_gradient_topics(spark, sf_dir):
    return rounded(_gradient(spark, sf_dir)[0], "grad", digits=9)


def batch_gradient_topics_log(spark, sf_dir):
    """The same by the reverse of the log updates."""
    return rounded(_gradient(spark, sf_dir, "log")[0], "grad", digits=9)


def batch_gradient_weights(spark, sf_dir):
    return _by_weight(spark, sf_dir, "auto")


def batch_gradient_weights_log(spark, sf_dir):
    return _by_weight(spark, sf_dir, "log")


def _by_weight(spark, sf_dir, domain):
    by_doc = _gradient(spark, sf_dir, domain)[1]
    rows = by_doc.select("doc_id", "loss", F.posexplode("grad").alias("topic", "grad"))
    return rounded(rows, "loss", "grad", digits=9)


def _model(spark, sf_dir, spec=SMALL, **changes):
    cost = quantity_cost(spark, sf_dir)
    return dl.fit(_shares(spark, sf_dir), cost, replace(spec, **changes)), cost


def wdl_fit(spark, sf_dir):
    return _model(spark, sf_dir, WHOLE)[0].topics


def wdl_fit_shared(spark, sf_dir):
    model, _ = _model(spark, sf_dir, weight_grad="shared", loss="squared", optimizer="sgd")
    return model.weights


def reconstruct(spark, sf_dir):
    model, cost = _model(spark, sf_dir, epochs=1)
    return dl.reconstruct(model, cost)


def predict(spark, sf_dir):
    """Topics learned on suppliers, weights of nations."""
    model, cost = _model(spark, sf_dir, epochs=1)
    nations = profiles(spark, sf_dir, "s_nationkey").select(
        F.col("id").alias("doc_id"), F.col("idx").alias("word_id"), "p"
    )
    return dl.predict(model, nations, cost, steps=10)


def scores_topics(spark, sf_dir):
    return dl.document_scores(_model(spark, sf_dir, epochs=1)[0])


def scores_docs(spark, sf_dir):
    model, cost = _model(spark, sf_dir, epochs=1)
    return dl.document_scores(model, cost, "docs")


def wasserstein_index(spark, sf_dir):
    """The whole model on all documents and all words seen five times, with vectors trained on them."""
    return ix.wasserstein_index(corpus(spark, sf_dir), INDEX)


QUERIES = {
    "squared_loss": squared_loss,
    "batch_gradient_topics": batch_gradient_topics,
    "batch_gradient_weights": batch_gradient_weights,
    "batch_gradient_topics_log": batch_gradient_topics_log,
    "batch_gradient_weights_log": batch_gradient_weights_log,
    "wdl_fit": wdl_fit,
    "wdl_fit_shared": wdl_fit_shared,
    "reconstruct": reconstruct,
    "predict": predict,
    "scores_topics": scores_topics,
    "scores_docs": scores_docs,
    "model_round_trip": model_round_trip,
    "reconstruct_given": reconstruct_given,
    "scores_topics_given": scores_topics_given,
    "scores_docs_given": scores_docs_given,
    "wasserstein_index": wasserstein_index,
}

_GRADIENT = f"""
WITH {PROFILES}, {KERNEL},
topic AS (SELECT CAST(id AS INTEGER) AS topic, idx AS i, p AS a FROM region_profile),
ones AS (SELECT i, sum(k) AS kv FROM kernel GROUP BY 1),
t AS MATERIALIZED (
  SELECT topic, j, sum(k * a / kv) AS t FROM topic JOIN ones USING (i) JOIN kernel USING (i) GROUP BY 1, 2
),
logit AS (
  SELECT s_suppkey AS doc_id, CAST(r AS INTEGER) AS topic, 0.3 * ((s_suppkey + r) % 5) AS x
  FROM supplier, range(5) AS n(r)
),
w AS (SELECT doc_id, topic, exp(x) / sum(exp(x)) OVER (PARTITION BY doc_id) AS w FROM logit),
fitted AS MATERIALIZED (
  SELECT doc_id, j, exp(sum(w * ln(t))) AS b FROM w JOIN t USING (topic) GROUP BY 1, 2
),
slope AS MATERIALIZED (
  SELECT doc_id, j, b, b - coalesce(p, 0) AS gap
  FROM fitted LEFT JOIN profile ON id = doc_id AND idx = j
)"""



def _applied(name: str, vector: str, value: str, inner: str, outer: str) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT doc_id, topic, {outer}, sum(k * {value}) AS x FROM {vector} JOIN kernel USING ({inner}) GROUP BY 1, 2, 3
)"""


#: Two debiased rounds from the topics and weights of ``_GRADIENT``.
_RECONSTRUCTED = f"""{_GRADIENT},
d1 AS MATERIALIZED (SELECT doc_id, j, sqrt(b / kv) AS d FROM fitted JOIN ones ON i = j),
v1 AS (SELECT doc_id, topic, j, b / t AS v FROM fitted JOIN t USING (j)),
{_applied("kv1", "v1", "v", "j", "i")},
u2 AS (SELECT doc_id, topic, i, a / x AS u FROM kv1 JOIN topic USING (topic, i)),
{_applied("t2", "u2", "u", "i", "j")},
b2 AS MATERIALIZED (
  SELECT doc_id, j, min(d) * exp(sum(w * ln(x))) AS b
  FROM t2 JOIN w USING (doc_id, topic) JOIN d1 USING (doc_id, j) GROUP BY 1, 2
)"""


def _leading_sql(matrix: str, row: str, col: str, value: str, rounds: int) -> str:
    """Power iteration for the first left singular vector times its value; all entries positive."""
    steps = [f"x0 AS (SELECT DISTINCT {col}, 1.0 AS x FROM {matrix})"]
    for r in range(1, rounds + 1):
        steps.append(f"""
y{r} AS MATERIALIZED (SELECT {row}, sum({value} * x) AS y FROM {matrix} JOIN x{r - 1} USING ({col}) GROUP BY 1),
z{r} AS (SELECT {col}, sum({value} * y) AS z FROM {matrix} JOIN y{r} USING ({row}) GROUP BY 1),
x{r} AS MATERIALIZED (SELECT {col}, z / sqrt(sum(z * z) OVER ()) AS x FROM z{r})""")
    steps.append(f"""
led AS MATERIALIZED (SELECT {row}, sum({value} * x) AS score FROM {matrix} JOIN x{rounds} USING ({col}) GROUP BY 1)""")
    return ", ".join(steps)


ORACLES = {
    "model_round_trip": f"""{_GRADIENT}
SELECT doc_id::BIGINT AS doc_id, topic::BIGINT AS topic, round(w, 9) AS value FROM w
UNION ALL SELECT -1, 1000 * (topic + 1) + i, round(a, 9) FROM topic""",
    "reconstruct_given": f"{_RECONSTRUCTED} SELECT doc_id, j AS word_id, round(b, 8) AS p FROM b2",
    "scores_topics_given": f"""{_GRADIENT}, {_leading_sql("topic", "topic", "i", "a", 16)}
SELECT doc_id, round(sum(w * score), 6) AS score FROM w JOIN led USING (topic) GROUP BY 1""",
    "scores_docs_given": f"""{_RECONSTRUCTED}, {_leading_sql("b2", "doc_id", "j", "b", 16)}
SELECT doc_id, round(score, 6) AS score FROM led""",
    "squared_loss": f"""
WITH {PROFILES},
predicted AS (SELECT s_suppkey AS id, idx, p FROM supplier JOIN nation_profile ON id = s_nationkey)
SELECT id AS doc_id, round(sum(pow(coalesce(a.p, 0) - coalesce(b.p, 0), 2)), 9) AS loss
FROM predicted a FULL JOIN profile b USING (id, idx) GROUP BY 1""",
    "batch_gradient_weights": f"""{_GRADIENT},
lost AS (SELECT doc_id, sum(gap * gap) AS loss FROM slope GROUP BY 1),
bar AS (
  SELECT doc_id, topic, sum(2 * gap * b * ln(t)) AS bar FROM slope JOIN t USING (j) GROUP BY 1, 2
)
SELECT doc_id, round(loss, 9) AS loss, topic,
  round(w * (bar - sum(w * bar) OVER (PARTITION BY doc_id)), 9) + 0.0 AS grad
FROM bar JOIN w USING (doc_id, topic) JOIN lost USING (doc_id)""",
    "batch_gradient_topics": f"""{_GRADIENT},
tbar AS MATERIALIZED (
  SELECT topic, j, sum(w * 2 * gap * b / t) AS tbar
  FROM slope JOIN t USING (j) JOIN w USING (doc_id, topic) GROUP BY 1, 2
),
abar AS (
  SELECT topic, i, sum(k * tbar) / min(kv) / (SELECT count(*) FROM supplier) AS abar
  FROM tbar JOIN kernel USING (j) JOIN ones USING (i) GROUP BY 1, 2
)
SELECT topic, i AS word_id, round(a * (abar - sum(a * abar) OVER (PARTITION BY topic)), 9) + 0.0 AS grad
FROM abar JOIN topic USING (topic, i)""",
}

for _name in ("batch_gradient_topics", "batch_gradient_weights"):
    ORACLES[f"{_name}_log"] = ORACLES[_name]
