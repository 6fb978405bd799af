import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from otindex.llm.mixing import draw, hypergeometric, log_factorial, mix, split_quotas, targets, uniform

SCHEMA = "doc_id bigint, text string, source string, SIZE string, `a.b` map<string,int>"


def corpus():
    rows, at = [], 0
    for source, lengths in {"b": [5, 7, 1, 40] * 12, "é": [3] * 30, None: [9, 2], "a": [200, 1, 1], "zero": [0, 0]}.items():
        for n in lengths:
            rows.append((at, " \t".join(f"w{k}" for k in range(n)), source, "x", {"k": 1}))
            at += 1
    return [*rows, (None, None, "b", None, None), rows[3], rows[3], (None, "a b", "b", None, None)]


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def wanted(sizes, most=3):
    """Targets by sharing the excess until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        share = sum(weight[s] for s in names if s not in capped)
        target = {s: most * sizes[s] if s in capped else left * weight[s] / share for s in names}
        above = {s for s in names if s not in capped and target[s] > most * sizes[s]}
        if not above:
            return target
        capped |= above


@pytest.mark.parametrize("block_words, shards", [(1 << 16, 1), (20, 5)])
def test_like_brute_force(spark, block_words, shards):
    rows = corpus()
    table = spark.createDataFrame(rows, SCHEMA)
    mixed = mix(table, shards=shards, block_words=block_words)
    assert [c.lower() for c in mixed.columns] == ["doc_id", "text", "source", "a.b", "size", "source_size", "target", "copies"]
    found = mixed.select("doc_id", "text", "source", "size", "source_size", "target", "copies").collect()
    assert sorted(((r.doc_id, r.text, r.source) for r in found), key=repr) == sorted(((r[0], r[1], r[2]) for r in rows), key=repr)
    sizes, taken, times = defaultdict(int), defaultdict(int), defaultdict(set)
    for r in rows:
        sizes[r[2]] += words(r[1])
    target = wanted(sizes)
    for r in found:
        assert r.size == words(r.text) and r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert len(r.copies) <= 3 and all(0 <= s < shards for s in r.copies)
        taken[r.source] += r.size * len(r.copies)
        times[r.doc_id, r.text, r.source].add(tuple(r.copies))
    assert all(len(t) == 1 for t in times.values())  # equal rows go the same way
    for source, want in target.items():
        passes = math.floor(want / sizes[source]) if sizes[source] else 0
        assert abs(taken[source] - want) <= max(r.size for r in found if r.source == source)
        assert all(passes <= len(r.copies) <= passes + 1 for r in found if r.source == source and r.size)
    again = mix(table.repartition(3), shards=shards, block_words=block_words).select("doc_id", "copies").collect()
    assert Counter(map(repr, again)) == Counter(repr(r) for r in mixed.select("doc_id", "copies").collect())


def test_drawn_shards_hold_every_copy(spark):
    mixed = mix(spark.createDataFrame(corpus(), SCHEMA).drop("a.b"), shards=3, block_words=10)
    wanted_rows = Counter((r.doc_id, s) for r in mixed.collect() for s in r.copies)
    drawn = draw(mixed)
    assert Counter((r.doc_id, r.shard) for r in drawn.collect()) == wanted_rows
    parts = drawn.select("shard", F.spark_partition_id().alias("part")).distinct().groupBy("shard").count()
    assert all(r["count"] == 1 for r in parts.collect())


def test_empty_table(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).count() == 0
    only_empty = spark.createDataFrame([(1, "", "s", None, None), (2, None, None, None, None)], SCHEMA)
    rows = mix(only_empty).collect()
    assert [(r.size, r.target, r.copies) for r in rows] == [(0, 0.0, [])] * 2


def test_quotas_are_split_exactly(spark):
    quotas = [7, 0, 300, 5, 61]
    table = spark.createDataFrame(list(enumerate(quotas)), "pos bigint, quota bigint")
    for shards in (1, 5, 32):
        stops = {r.pos: r.stops for r in split_quotas(table, shards, 3).collect()}
        shares = {p: [b - a for a, b in zip([0, *s], s)] for p, s in stops.items()}
        assert all(sum(shares[p]) == q and min(shares[p]) >= 0 for p, q in enumerate(quotas))
        loads = [sum(s[k] for s in shares.values()) for k in range(shards)]
        assert max(loads) - min(loads) <= 1


def test_draws_are_hypergeometric(spark):
    long = lambda x: F.lit(x).cast("long")
    for total, good, draws in ((50, 20, 15), (10, 10, 4), (9, 0, 3), (6, 3, 6)):
        rows = spark.range(6000).select(hypergeometric(long(total), long(good), long(draws), uniform(F.lit(total), "id")).alias("x")).collect()
        counts = Counter(r.x for r in rows)
        for x in range(draws + 1):
            p = math.comb(good, x) * math.comb(total - good, draws - x) / math.comb(total, draws) if x <= good else 0
            assert abs(counts[x] / 6000 - p) <= 5 * math.sqrt(p * (1 - p) / 6000) + 1e-9
    large = spark.range(300).select(hypergeometric(long(4_000_000), long(1_000_000), long(2_000_000), uniform("id")).alias("x")).collect()
    mean = sum(r.x for r in large) / 300
    assert abs(mean - 500_000) < 5 * 433 / math.sqrt(300)


def test_log_factorial(spark):
    numbers = [0, 1, 2, 9, 10, 170, 10**6]
    rows = spark.createDataFrame([(n,) for n in numbers], "n bigint").select("n", log_factorial(F.col("n")).alias("x")).collect()
    assert all(r.x == pytest.approx(math.lgamma(r.n + 1), rel=1e-12, abs=1e-10) for r in rows)


def test_targets_share_the_excess(spark):
    sizes = {"a": 1, "b": 1000, "c": 10, "d": 0, "e": 500}
    weight = dict(zip(sizes, (1.0, 2.0, 3.0, 1.0, 2.0)))
    rows = [(k, s, weight[k]) for k, s in sizes.items()]
    found = {r.k: r.target for r in targets(spark.createDataFrame(rows, "k string, size bigint, weight double"), 3).collect()}
    assert found == pytest.approx(wanted(sizes))
