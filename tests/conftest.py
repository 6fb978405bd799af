import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


class Tables:
    """Small coordinate tables from nested lists."""

    def __init__(self, spark):
        self.spark = spark

    def cost(self, matrix):
        rows = [(i, j, float(c)) for i, line in enumerate(matrix) for j, c in enumerate(line)]
        return self.spark.createDataFrame(rows, "i int, j int, cost double")

    def matrix(self, matrix, row="i", col="j"):
        rows = [(i, j, float(x)) for i, line in enumerate(matrix) for j, x in enumerate(line)]
        return self.spark.createDataFrame(rows, f"{row} int, {col} int, value double")

    def histograms(self, columns, key="problem_id", idx="idx"):
        rows = [(s, i, float(x)) for s, column in enumerate(columns) for i, x in enumerate(column) if x]
        return self.spark.createDataFrame(rows, f"{key} bigint, {idx} int, p double")

    def group(self, columns, weights, group=0):
        atoms = [(group, s, i, float(x)) for s, c in enumerate(columns) for i, x in enumerate(c) if x]
        shares = [(group, s, float(w)) for s, w in enumerate(weights)]
        return (
            self.spark.createDataFrame(atoms, "group_id int, member int, idx int, p double"),
            self.spark.createDataFrame(shares, "group_id int, member int, weight double"),
        )

    def documents(self, texts):
        return self.spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


@pytest.fixture(scope="session")
def make(spark):
    return Tables(spark)
