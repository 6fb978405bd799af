"""First-order updates as projections over parameter tables, and mini-batch numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from otindex.session import with_positions


def assign_batches(df: DataFrame, batch_size: int, *order: str) -> DataFrame:
    """Add ``batch``: contiguous blocks of ``batch_size`` rows in the given order."""
    numbered = with_positions(df, *(order or ("doc_id",)))
    return numbered.withColumn("batch", F.floor(F.col("pos") / batch_size).cast("int"))


def batch_mean(gradients: DataFrame, *keys: str) -> DataFrame:
    """Average gradient per parameter over the members of a batch."""
    return gradients.groupBy(*keys).agg(F.avg("grad").alias("grad"))


def sgd_step(params: DataFrame, grads: DataFrame, keys: list[str], lr: float) -> DataFrame:
    """``value - lr * grad`` for tables ``(*keys, value)`` and ``(*keys, grad)``."""
    return params.join(grads, keys).select(
        *keys, (F.col("value") - lr * F.col("grad")).alias("value")
    )


def adam_columns(
    value: Column, grad: Column, m: Column, v: Column, t: int | Column, lr: float,
    beta1: float = 0.9, beta2: float = 0.999, eps: float = 1e-8, decay: float = 0.0,
) -> tuple[Column, Column, Column]:
    """The new ``(value, m, v)`` after one Adam update, bias corrected for step ``t``.

    A positive ``decay`` adds it to the gradient and to the step, as in AdamW with its weight
    ``eta_t`` fixed to one.
    """
    step = t if isinstance(t, Column) else F.lit(float(t))
    if decay:
        grad = grad + decay * value
    m_new = beta1 * m + (1 - beta1) * grad
    v_new = beta2 * v + (1 - beta2) * grad * grad
    m_hat = m_new / (1 - F.pow(F.lit(beta1), step))
    v_hat = v_new / (1 - F.pow(F.lit(beta2), step))
    moved = lr * m_hat / (F.sqrt(v_hat) + eps)
    if decay:
        moved = moved + decay * value
    return value - moved, m_new, v_new


def adam_step(
    state: DataFrame, grads: DataFrame, keys: list[str], t: int, lr: float = 0.001,
    beta1: float = 0.9, beta2: float = 0.999, eps: float = 1e-8,
) -> DataFrame:
    """One Adam update of ``(*keys, value, m, v)`` with gradients ``(*keys, grad)``."""
    columns = adam_columns(
        F.col("value"), F.col("grad"), F.col("m"), F.col("v"), t, lr, beta1, beta2, eps
    )
    names = ("value", "m", "v")
    return state.join(grads, keys).select(*keys, *(c.alias(n) for c, n in zip(columns, names)))


def adamw_step(
    state: DataFrame, grads: DataFrame, keys: list[str], t: int, lr: float = 0.001,
    decay: float = 0.01, beta1: float = 0.9, beta2: float = 0.999, eps: float = 1e-8,
) -> DataFrame:
    """One AdamW update; ``decay`` is the decay parameter."""
    columns = adam_columns(
        F.col("value"), F.col("grad"), F.col("m"), F.col("v"), t, lr, beta1, beta2, eps, decay
    )
    names = ("value", "m", "v")
    return state.join(grads, keys).select(*keys, *(c.alias(n) for c, n in zip(columns, names)))


def standard_normal(seed: int, *keys: Column) -> Column:
    """A standard normal draw fixed by seed and key columns, whatever the partitioning.

    Two MD5 digests of seed, stream and keys, joined by ``|``, give two uniforms for the Box-Muller
    transform: the first 13 hexadecimal digits, plus a half, over 2**52. Any engine can repeat that.
    """

    def uniform(stream: int) -> Column:
        parts = [F.lit(str(seed)), F.lit(str(stream)), *(k.cast("string") for k in keys)]
        digits = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13)
        return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)

    return F.sqrt(-2.0 * F.ln(uniform(1))) * F.cos(2.0 * F.pi() * uniform(2))


def random_init(rows: DataFrame, keys: list[str], seed: int = 0) -> DataFrame:
    """``(*keys, value)``: one independent standard normal per key row (apply softmax next)."""
    return rows.select(*keys, standard_normal(seed, *(F.col(k) for k in keys)).alias("value"))
