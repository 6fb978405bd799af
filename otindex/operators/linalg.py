"""Matrices as coordinate tables.

A matrix is a table ``(i, j, value)``; an absent coordinate is zero. Products are equi-joins on
the inner index followed by a grouped sum, which Spark combines before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from otindex.session import BROADCAST_ROWS, SALTS, at_most, broadcast_if_small, materialize

OPERATIONS = ("mul", "div", "pow")


def _match(large: DataFrame, small: DataFrame, on: str, by: str) -> DataFrame:
    """Inner join on one matrix index, which takes few values and so holds many rows each.

    The small side is broadcast if its size allows; beyond that the rows of an index are dealt by
    column ``by`` to several tasks, each with a copy of the other side's rows.
    """
    small = materialize(small)
    if at_most(small, BROADCAST_ROWS):
        return large.join(F.broadcast(small), on)
    salted = large.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [on, "_salt"]).drop("_salt")


def gibbs_kernel(cost: DataFrame, eps: float) -> DataFrame:
    """``(i, j, cost, k)`` with ``k = exp(-cost / eps)``."""
    return cost.withColumn("k", F.exp(-F.col("cost") / eps))


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "value")


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """``sum over k of a[i, k] * b[k, j]``."""
    left = a.select("i", F.col("j").alias("k"), F.col("value").alias("x"))
    right = b.select(F.col("i").alias("k"), "j", F.col("value").alias("y"))
    product = _match(left, right, "k", "i")
    return product.groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("value"))


def _combine(x, y, op: str):
    if op not in OPERATIONS:
        raise ValueError(f"op must be one of {OPERATIONS}")
    return {"mul": x * y, "div": x / y, "pow": F.pow(x, y)}[op]


def hadamard(a: DataFrame, b: DataFrame, op: str = "mul") -> DataFrame:
    """Entry by entry ``a * b``, ``a / b`` or ``a ** b`` where both have the coordinate."""
    other = b.select("i", "j", F.col("value").alias("y"))
    return a.join(other, ["i", "j"]).select(
        "i", "j", _combine(F.col("value"), F.col("y"), op).alias("value")
    )


def scale(m: DataFrame, vector: DataFrame, axis: str = "i", op: str = "mul") -> DataFrame:
    """Combine every row (``axis='i'``) or column (``axis='j'``) with one entry of a vector
    ``(axis, value)``."""
    other = vector.select(axis, F.col("value").alias("y"))
    return _match(m, other, axis, "j" if axis == "i" else "i").select(
        "i", "j", _combine(F.col("value"), F.col("y"), op).alias("value")
    )


def row_sums(m: DataFrame) -> DataFrame:
    return m.groupBy("i").agg(F.sum("value").alias("value"))


def col_sums(m: DataFrame) -> DataFrame:
    return m.groupBy("j").agg(F.sum("value").alias("value"))


def row_geomean(m: DataFrame, weights: DataFrame) -> DataFrame:
    """``prod over j of m[i, j] ** weight[j]`` for positive entries; weights ``(j, weight)``."""
    return (
        _match(m, weights, "j", "i")
        .groupBy("i")
        .agg(F.exp(F.sum(F.col("weight") * F.ln("value"))).alias("value"))
    )


def softmin(m: DataFrame, eps: float, axis: str = "i") -> DataFrame:
    """``min - eps * log(sum(exp(-(z - min) / eps)))`` along each row or column.

    Two aggregations, both combined on the map side, so a long row is never held in one task.
    """
    m = materialize(m.select("i", "j", "value"))
    least = materialize(m.groupBy(axis).agg(F.min("value").alias("least")))
    shifted = _match(m, least, axis, "j" if axis == "i" else "i")
    return shifted.groupBy(axis).agg(
        (
            F.min("least")
            - eps * F.ln(F.sum(F.exp((F.col("least") - F.col("value")) / eps)))
        ).alias("value")
    )


def cost_minus_potentials(cost: DataFrame, f: DataFrame, g: DataFrame) -> DataFrame:
    """``cost[i, j] - f[t, i] - g[t, j]`` for every topic ``t``: ``(topic, i, j, value)``.

    ``f`` is ``(topic, i, value)`` and ``g`` is ``(topic, j, value)``.
    """
    left = f.select("topic", "i", F.col("value").alias("f"))
    right = g.select("topic", "j", F.col("value").alias("g"))
    return (
        _match(cost, left, "i", "j")
        .join(right, ["topic", "j"])
        .select("topic", "i", "j", (F.col("cost") - F.col("f") - F.col("g")).alias("value"))
    )


def _normalized(m: DataFrame, axis: str, lifted) -> DataFrame:
    """``lifted(value, least, top)`` over its sum along ``axis``; the input is computed once."""
    m = materialize(m.select("i", "j", "value"))
    ends = broadcast_if_small(
        materialize(m.groupBy(axis).agg(F.min("value").alias("least"), F.max("value").alias("top")))
    )
    raised = m.join(ends, axis).select("i", "j", lifted(F.col("value"), F.col("least"), F.col("top")).alias("value"))
    total = broadcast_if_small(materialize(raised.groupBy(axis).agg(F.sum("value").alias("total"))))
    return raised.join(total, axis).select("i", "j", (F.col("value") / F.col("total")).alias("value"))


def softmax(m: DataFrame) -> DataFrame:
    """Softmax of each column ``j``, shifted by the column's largest entry."""
    return _normalized(m, "j", lambda value, least, top: F.exp(value - top))


def softmax_jacobian(y: DataFrame) -> DataFrame:
    """``diag(y) - y y'`` for each column ``col`` of softmax values ``(i, col, value)``.

    The result is a matrix per column, hence quadratic in the column's length by definition.
    """
    left = y.select("col", "i", F.col("value").alias("x"))
    right = y.select("col", F.col("i").alias("j"), F.col("value").alias("y"))
    diagonal = F.when(F.col("i") == F.col("j"), F.col("x")).otherwise(F.lit(0.0))
    return left.join(right, "col").select(
        "col", "i", "j", (diagonal - F.col("x") * F.col("y")).alias("value")
    )


def softmin_jacobian(m: DataFrame, eps: float) -> DataFrame:
    """Derivative of the row softmin: ``exp(-m / eps)`` normalized within each row."""
    return _normalized(m, "i", lambda value, least, top: F.exp((least - value) / eps))


def weighted_contract(weights: DataFrame, x: DataFrame, y: DataFrame) -> DataFrame:
    """``sum over k of weight[k] * x[i, j, k] / y[i, k]``.

    ``weights`` is ``(k, weight)``, ``x`` is ``(i, j, k, value)`` and ``y`` is ``(i, k, value)``.
    """
    ratio = _match(y, weights, "k", "i").select("i", "k", (F.col("weight") / F.col("value")).alias("r"))
    return (
        x.join(ratio, ["i", "k"])
        .groupBy("i", "j")
        .agg(F.sum(F.col("r") * F.col("value")).alias("value"))
    )


def tensor_product(m: DataFrame, x: DataFrame) -> DataFrame:
    """``sum over t of m[i, t] * x[t, j, k]``: a matrix applied to every slice of a cube."""
    left = m.select("i", F.col("j").alias("t"), F.col("value").alias("a"))
    right = x.select(F.col("i").alias("t"), "j", "k", F.col("value").alias("b"))
    return (
        _match(right, left, "t", "j")
        .groupBy("i", "j", "k")
        .agg(F.sum(F.col("a") * F.col("b")).alias("value"))
    )


def marginal_error(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Frobenius norm of ``actual - expected`` for tables ``(i, j, value)``; absent means zero.

    The two tables are stacked with opposite signs and summed per coordinate.
    """
    stacked = actual.select("i", "j", "value").unionByName(
        expected.select("i", "j", (-F.col("value")).alias("value"))
    )
    gaps = stacked.groupBy("i", "j").agg(F.sum("value").alias("gap"))
    return gaps.agg(F.sqrt(F.sum(F.col("gap") * F.col("gap"))).alias("error"))


def normalize_columns(m: DataFrame) -> DataFrame:
    """Scale each column ``j`` to sum to one; columns hold one entry per distinct ``i``."""
    total = F.sum("value").over(Window.partitionBy("j"))
    return m.select("i", "j", (F.col("value") / total).alias("value"))
