import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from otindex.operators import optim
from otindex.operators.index import index_by_period, standardize, topic_top_words
from otindex.session import with_positions


def days(spark, first, count):
    rows = [(first + dt.timedelta(days=n), 1.0) for n in range(count)]
    return spark.createDataFrame(rows, "ts date, score double")


def test_months_are_labelled_by_their_first_date(spark):
    out = index_by_period(days(spark, dt.date(1970, 1, 2), 100), "month").orderBy("period_start").collect()
    assert [(r.period_start, r["index"]) for r in out] == [
        (dt.date(1970, 1, 2), 30.0), (dt.date(1970, 2, 1), 28.0),
        (dt.date(1970, 3, 1), 31.0), (dt.date(1970, 4, 1), 11.0),
    ]


@pytest.mark.parametrize("period, groups", [("year", 1), ("quarter", 2), ("week", 15), ("day", 100)])
def test_other_periods(spark, period, groups):
    out = index_by_period(days(spark, dt.date(1970, 1, 2), 100), period)
    assert out.count() == groups and out.agg(F.sum("index")).first()[0] == 100.0
    with pytest.raises(ValueError):
        index_by_period(out, "hour")


def test_standardize(spark):
    series = spark.range(1, 101).select((F.col("id") / 2).alias("index"))
    values = [r["index"] for r in standardize(series).orderBy("index").collect()]
    assert values[0] == pytest.approx(98.29377958) and values[-1] == pytest.approx(101.70622042)
    assert np.mean(values) == pytest.approx(100) and np.std(values, ddof=1) == pytest.approx(1)
    flat = spark.range(3).select(F.lit(2.0).alias("index"))
    assert [r["index"] for r in standardize(flat).collect()] == [None] * 3
    assert standardize(spark.range(1).select(F.lit(2.0).alias("index"))).first()["index"] is None


def test_positions_are_dense_over_many_partitions(spark):
    shuffled = spark.range(1000).repartition(13).withColumn("k", F.col("id") * 7 % 1000)
    rows = with_positions(shuffled, "k").orderBy("k").collect()
    assert [r.pos for r in rows] == list(range(1000))


def test_batches_are_contiguous_and_the_last_one_short(spark):
    out = optim.assign_batches(spark.range(10).withColumnRenamed("id", "doc_id"), 4)
    assert [r.batch for r in out.orderBy("doc_id").collect()] == [0] * 4 + [1] * 4 + [2] * 2


def test_top_words(spark):
    topics = spark.createDataFrame(
        [(0, 0, 0.5), (0, 1, 0.2), (0, 2, 0.3), (1, 0, 0.4), (1, 1, 0.4), (1, 2, 0.2)],
        "topic int, word_id int, p double",
    )
    words = spark.createDataFrame([(0, "b"), (1, "a"), (2, "c")], "word_id int, word string")
    top = topic_top_words(topics, words, 2)
    assert {(r.topic, r["rank"], r.word) for r in top.collect()} == {
        (0, 1, "b"), (0, 2, "c"), (1, 1, "a"), (1, 2, "b"),
    }
    assert "WindowGroupLimit" in top._jdf.queryExecution().optimizedPlan().toString()


def test_sgd_with_batch_mean(spark):
    params = spark.createDataFrame([(0, 0.1), (1, 0.2), (2, 0.3)], "k int, value double")
    grads = spark.createDataFrame(
        [(0, 0.4), (1, 0.5), (2, 0.6), (0, 0.1), (1, 0.3), (2, 0.2)], "k int, grad double"
    )
    out = optim.sgd_step(params, optim.batch_mean(grads, "k"), ["k"], 0.001).orderBy("k").collect()
    assert [r.value for r in out] == pytest.approx([0.09975, 0.1996, 0.2996])


def test_adam_and_adamw_follow_their_formulas(spark):
    state = spark.createDataFrame([(0, 1.0, 0.1, 0.02)], "k int, value double, m double, v double")
    grads = spark.createDataFrame([(0, 0.5)], "k int, grad double")

    def expected(decay):
        g = 0.5 + decay
        m, v = 0.9 * 0.1 + 0.1 * g, 0.999 * 0.02 + 0.001 * g * g
        move = 0.01 * (m / (1 - 0.9**2)) / (np.sqrt(v / (1 - 0.999**2)) + 1e-8)
        return 1.0 - move - decay * 1.0, m, v

    adam = optim.adam_step(state, grads, ["k"], 2, 0.01).first()
    assert (adam.value, adam.m, adam.v) == pytest.approx(expected(0.0))
    adamw = optim.adamw_step(state, grads, ["k"], 2, 0.01, 0.05).first()
    assert (adamw.value, adamw.m, adamw.v) == pytest.approx(expected(0.05))


def test_random_init_is_normal_and_independent_of_partitions(spark):
    keys = spark.range(20_000)
    first = optim.random_init(keys, ["id"], 3)
    stats = first.agg(F.avg("value").alias("m"), F.stddev("value").alias("s"), F.kurtosis("value").alias("k")).first()
    assert abs(stats.m) < 0.03 and abs(stats.s - 1) < 0.03 and abs(stats.k) < 0.15
    again = optim.random_init(keys.repartition(11), ["id"], 3)
    assert first.exceptAll(again).count() == 0
    assert first.join(optim.random_init(keys, ["id"], 4), ["id", "value"]).count() == 0
