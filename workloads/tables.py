"""Inputs shared by the queries, and the same inputs as SQL table expressions.

* corpus: ``documents`` dated by the order with the same number.
* profiles: one histogram of line quantities per supplier (and per nation and region), with the
  squared distance between quantities as ground cost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from otindex.functions.stopwords import ENGLISH
from otindex.operators.distance import pairwise_distance
from otindex.operators.text import distribution, tokenize
from otindex.session import broadcast_if_small, materialize, spread, with_positions
from otindex.sources.corpus import attach_dates

EPS = 0.1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return attach_dates(documents(spark, sf_dir), orders, "o_orderkey", "o_orderdate")


def tokenized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(documents(spark, sf_dir))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their supplier's nation and region."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity")
    return line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(
        nation, F.col("s_nationkey") == F.col("n_nationkey")
    )


def profiles(spark: SparkSession, sf_dir: str, level: str = "l_suppkey") -> DataFrame:
    """``(id, idx, p)``: share of each quantity per supplier, nation or region."""
    source = table(spark, sf_dir, "lineitem") if level == "l_suppkey" else lines(spark, sf_dir)
    return distribution(source, level, "l_quantity").withColumnRenamed(level, "id")


def quantity_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    quantities = table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").cast("int").alias("word_id")
    )
    scale = F.array(F.col("word_id") / 49.0)
    return materialize(pairwise_distance(quantities.distinct().withColumn("vec", scale)))


def supplier_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier against its nation."""
    supplier = table(spark, sf_dir, "supplier")
    return supplier.select(
        F.col("s_suppkey").alias("problem_id"),
        F.col("s_suppkey").alias("a_id"),
        F.col("s_nationkey").alias("b_id"),
    )


def nation_members(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Supplier profiles grouped by nation, weighted by their share of the nation's lines."""
    sold = lines(spark, sf_dir).groupBy(
        F.col("s_nationkey").alias("group_id"), F.col("l_suppkey").alias("member")
    ).agg(F.count(F.lit(1)).alias("n"))
    total = sold.groupBy("group_id").agg(F.sum("n").alias("all"))
    weights = sold.join(total, "group_id").select(
        "group_id", "member", (F.col("n") / F.col("all")).alias("weight")
    )
    atoms = (
        profiles(spark, sf_dir)
        .withColumnRenamed("id", "member")
        .join(weights.select("group_id", "member"), "member")
        .select("group_id", "member", "idx", "p")
    )
    return atoms, weights


def word_vectors(vocabulary: DataFrame, given: DataFrame) -> DataFrame:
    """``(word_id, vec)``: a vector of its own for every word, from the given ones.

    With V given vectors word n has vector n modulo V, plus half of a vector behind it: the next one for
    the first V words, the one after that for the next V, and so on.
    """
    numbered = with_positions(given.select("vec_id", F.col("embedding").cast("array<double>").alias("x")), "vec_id")
    numbered = materialize(numbered.select("pos", "x"))
    size = max(1, numbered.count())
    first, second = (numbered.select(F.col("pos").alias(p), F.col("x").alias(x)) for p, x in (("_p", "_x"), ("_q", "_y")))
    placed = vocabulary.select(
        "word_id", F.pmod("word_id", F.lit(size)).alias("_p"), F.pmod(F.expr(f"word_id + word_id div {size} + 1"), F.lit(size)).alias("_q")
    )
    joined = placed.join(broadcast_if_small(first), "_p").join(broadcast_if_small(second), "_q")
    return joined.select("word_id", F.zip_with("_x", "_y", lambda x, y: x + 0.5 * y).alias("vec"))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round to a fixed number of digits; adding zero turns -0.0 into 0.0."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


# --- the same as SQL -------------------------------------------------------------------------

_WORD = "trim(part, '''’')"

WORDS = f"""
parts AS (
  SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS place
  FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}''’]+') AS parts FROM documents)
),
words AS (SELECT doc_id, place, {_WORD} AS token FROM parts WHERE {_WORD} <> '')
"""

STOP = ", ".join("('" + word.replace("'", "''") + "')" for word in ENGLISH)


def vocabulary_sql(min_count: int, words: str = "words") -> str:
    return f"""
vocabulary AS (
  SELECT CAST(row_number() OVER (ORDER BY freq DESC, word) - 1 AS INTEGER) AS word_id, word, freq
  FROM (SELECT token AS word, count(*) AS freq FROM {words} GROUP BY 1 HAVING count(*) >= {min_count})
)"""


PROFILES = """
counts AS (
  SELECT l_suppkey AS id, CAST(l_quantity AS INTEGER) AS idx, count(*) AS c FROM lineitem GROUP BY 1, 2
),
profile AS (SELECT id, idx, c / sum(c) OVER (PARTITION BY id) AS p FROM counts),
nation_counts AS (
  SELECT s_nationkey AS id, idx, sum(c) AS c FROM counts JOIN supplier ON id = s_suppkey GROUP BY 1, 2
),
nation_profile AS (SELECT id, idx, c / sum(c) OVER (PARTITION BY id) AS p FROM nation_counts),
region_counts AS (
  SELECT n_regionkey AS id, idx, sum(c) AS c FROM nation_counts JOIN nation ON id = n_nationkey GROUP BY 1, 2
),
region_profile AS (SELECT id, idx, c / sum(c) OVER (PARTITION BY id) AS p FROM region_counts),
weight AS (
  SELECT s_nationkey AS group_id, id AS member, n / sum(n) OVER (PARTITION BY s_nationkey) AS weight
  FROM (SELECT id, sum(c) AS n FROM counts GROUP BY 1) JOIN supplier ON id = s_suppkey
),
bins AS (SELECT DISTINCT idx FROM counts),
cost AS MATERIALIZED (
  SELECT a.idx AS i, b.idx AS j, pow(a.idx / 49.0 - b.idx / 49.0, 2) AS cost FROM bins a, bins b
)"""

KERNEL = f"kernel AS MATERIALIZED (SELECT i, j, cost, exp(-cost / {EPS}) AS k FROM cost)"
