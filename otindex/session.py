"""Session helpers: durable checkpoints, size-checked broadcasts, dense positions."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a narrow lookup table may be broadcast.
BROADCAST_ROWS = 2_000_000

#: Copies made of the small side where one join key may hold a large share of the rows.
SALTS = 16


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and working tables.

    The cluster names it in ``spark.checkpoint.dir``. Without that setting a local master uses
    a folder in the warehouse; any other master must configure one, because a machine-local folder
    would not survive the loss of an executor.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if configured:
        if current is None:
            context.setCheckpointDir(configured)
        return configured
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/otindex-checkpoints"
    context.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Compute once, keep the rows in the shared folder and cut the lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def working_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder for working tables, next to the checkpoints."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def at_most(df: DataFrame, rows: int) -> bool:
    """True if ``df`` has no more than ``rows`` rows (a distributed count)."""
    return df.count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when the row count is proven to be below ``rows``.

    Beyond it the plan falls back to a shuffled join, where adaptive execution splits
    skewed partitions. Call it on materialized tables: the check runs the plan.
    """
    return F.broadcast(df) if at_most(df, rows) else df


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Use all cores for a scan with fewer splits than cores, such as one small file.

    Only such small inputs are shuffled, by key; a large table has splits enough and stays as
    it is. Meant for plain scans: asking a plan with shuffles for its partitions would run it.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, key) if scan.rdd.getNumPartitions() < cores else scan


def with_positions(df: DataFrame, *order, name: str = "pos") -> DataFrame:
    """Number the rows 0, 1, 2, ... in a total order without a one-task window.

    Rows are range-partitioned and sorted; each row gets its offset within its partition
    plus the number of rows in the partitions before. Only the per-partition counts (one
    row per partition) pass through a single window.
    """
    ordered = materialize(df.orderBy(*order)).select(
        "*",
        F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_offset"),
    )
    starts = (
        ordered.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(
            "_part",
            (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_start"),
        )
    )
    return (
        ordered.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_offset"))
        .drop("_part", "_offset", "_start")
    )


def made_in_tasks(rows: DataFrame, make, schema: str) -> DataFrame:
    """``rows.mapInArrow(make, schema)``, which :func:`read_in_tasks` can read where it is made."""
    made = rows.mapInArrow(make, schema)
    made._made = [(rows, make)]
    return made


def read_in_tasks(made: DataFrame, run, schema: str) -> DataFrame | None:
    """``made.mapInArrow(run, schema)`` in the tasks that make the rows, so that these do not travel to the JVM and back.

    None for a table that does not come from :func:`made_in_tasks`.
    """

    def both(make):
        return lambda batches: run(make(batches))

    parts = [rows.mapInArrow(both(make), schema) for rows, make in getattr(made, "_made", ())]
    return reduce(DataFrame.unionByName, parts) if parts else None
