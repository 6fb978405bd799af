import itertools
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from otindex.llm.line_crf import NAMES, Chains, Fit, accepted, classify, fit, held_out, learnable, line_features, loss_and_slope, marginals

SCHEMA = "doc_id bigint, text string, score string, label int"


def test_marginals_and_likelihood_like_enumeration():
    rng = np.random.default_rng(0)
    lines = np.array([3, 1, 5])
    x = rng.normal(size=(9, len(NAMES)))
    w = rng.normal(size=len(NAMES) + 3) * 0.3
    good = rng.integers(0, 2, 9).astype(float)
    e, t = x @ w[:-3], {(0, 0): 0.0, (0, 1): w[-3], (1, 0): w[-2], (1, 1): w[-1]}
    expected, loss, at = [], 0.5 * (w @ w), 0
    for n in lines:
        weight = {}
        for path in itertools.product((0, 1), repeat=n):
            weight[path] = np.exp(sum(e[at + k] * y for k, y in enumerate(path)) + sum(t[p] for p in zip(path, path[1:])))
        z = sum(weight.values())
        expected += [sum(v for path, v in weight.items() if path[k]) / z for k in range(n)]
        loss -= np.log(weight[tuple(int(g) for g in good[at : at + n])] / z)
        at += n
    assert np.allclose(marginals(x, lines, w), expected)
    value, slope = loss_and_slope(w, x, lines, good, Chains(lines), 1.0)
    assert np.isclose(value, loss)
    for k in (0, 5, len(w) - 3, len(w) - 2, len(w) - 1):
        step = np.zeros(len(w))
        step[k] = 1e-5
        up, down = (loss_and_slope(w + s, x, lines, good, Chains(lines), 1.0)[0] for s in (step, -step))
        assert np.isclose((up - down) / 2e-5, slope[k], atol=1e-4)


def test_lines_of_texts():
    features, size, lines = line_features([b"", b" \n\t", b"a b\n\na b\nc", "é x".encode(), b"one."])
    assert lines.tolist() == [1, 1, 3, 1, 1] and size.tolist() == [0, 0, 2, 2, 1, 3, 4]
    assert features.shape == (7, len(NAMES)) and np.isfinite(features).all()
    assert features[:, NAMES.index("first")].tolist() == [1, 1, 1, 0, 0, 1, 1]
    assert features[:, NAMES.index("seen_before")].tolist() == [0, 0, 0, 1, 0, 0, 0]
    assert features[2, NAMES.index("after_seen_before")] == 1 and features[4, NAMES.index("before_seen_before")] == 1


def corpus():
    rng = random.Random(4)

    def line(junk):
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(rng.randint(3, 12))]
        return " ".join(w + "$$$" if junk else w for w in words) + "."

    rows = []
    for i in range(400):
        good = rng.random() < 0.8
        text = [line(False) for _ in range(rng.randint(1, 9))]
        if not good:
            text[rng.randrange(len(text)) :] = [line(True) for _ in range(3)]
        rows.append((i, "\n".join(text), "x", int(good)))
    return rows


def test_held_out_documents_are_told_apart(spark):
    rows = corpus()
    extra = [(1000, None, None, None), (1001, "", None, None), (None, rows[0][1], None, None), rows[0], (1002, "a\n" * 5000, "", None)]
    docs = spark.createDataFrame(rows + extra, SCHEMA)
    labels = spark.createDataFrame([(i, g) for i, _, _, g in rows] + [(None, 0), (1, None)], "doc_id bigint, quality int")
    weights = fit(docs, learnable(labels))
    out = classify(docs, weights).withColumn("held_out", held_out(F.col("doc_id"))).collect()
    assert len(out) == len(rows) + len(extra) and all(0 <= r["score"] <= 1 for r in out)
    own = {i: g for i, _, _, g in rows}
    fresh = [r for r in out if r["held_out"] and r["doc_id"] in own]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in fresh) and len(fresh) > 50
    assert sum(r["predicted"] == own[r["doc_id"]] for r in fresh) / len(fresh) > 0.97
    assert (weights == fit(docs, learnable(labels))).all()


def test_held_out_labels_are_never_learnt(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    labels = docs.select("doc_id", docs["label"].alias("quality"))
    flipped = docs.select("doc_id", (1 - docs["label"]).alias("quality"))
    mixed = learnable(labels).unionByName(flipped.where(held_out(F.col("doc_id"))))
    assert (fit(docs, learnable(mixed), Fit(steps=5)) == fit(docs, learnable(labels), Fit(steps=5))).all()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    docs = spark.createDataFrame([], SCHEMA)
    assert classify(docs, fit(docs, none)).count() == 0
    row = classify(spark.createDataFrame([(1, "x", "", 1)], SCHEMA), fit(docs, none)).first()
    assert row["score"] == 0.5 and row["predicted"] == 1


def test_columns_that_differ_in_letter_case(spark):
    docs = spark.createDataFrame([(1, "some text", 7)], "doc_id bigint, text string, Score int")
    weights = np.zeros(len(NAMES) + 3)
    assert [c.lower() for c in classify(docs, weights).columns] == ["doc_id", "text", "score", "predicted"]
    kept = accepted(docs, weights, 0.0)
    assert kept.columns == docs.columns and kept.first()["Score"] == 7


def test_maps_and_dotted_names(spark):
    docs = spark.createDataFrame([(1, "some text", "q", {"k": 1})], "doc_id bigint, text string, `a.b` string, m map<string,int>")
    kept = accepted(docs, np.zeros(len(NAMES) + 3), 0.0)
    assert kept.columns == docs.columns and tuple(kept.first()) == (1, "some text", "q", {"k": 1})
    assert classify(docs, np.zeros(len(NAMES) + 3)).columns == [*docs.columns, "score", "predicted"]
