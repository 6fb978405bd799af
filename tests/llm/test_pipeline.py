import random

import corpus_pipeline
import numpy as np
import pytest
from test_byte_bpe import brute as brute_bpe
from test_decontaminate import brute as brute_leaks
from test_simhash import brute_components

from otindex.llm.line_crf import fit, learnable, line_features, marginals
from otindex.llm.pii import pseudonymize
from otindex.llm.queries import PII_KEY

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, n_hit string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(8)

    def line(junk=False):
        words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(rng.randint(5, 14))]
        return " ".join(w + "$$$" if junk else w for w in words) + "."

    items = [(i, line() + " " + line()) for i in range(5)] + [(9, None)]
    rows = []
    for i in range(150):
        bad = rng.random() < 0.2
        text = "\n".join(line(bad) for _ in range(rng.randint(2, 8)))
        if i % 10 == 3:
            text += "\n" + rng.choice(items[:5])[1].upper()
        if i % 7 == 2:
            text += f"\nmail joe{i}@corp.example.com or +1 (547) 555-01{i % 90 + 10}"
        rows.append((i, text, "en", "s", len(text), "clash", None))
    copies = [(200 + k, rows[k][1].replace(".", " .") if k % 2 else rows[k][1], "en", "s", 1, None, "clash") for k in range(0, 40, 3)]
    rows += [*copies, (300, None, None, None, None, None, None), (301, "", "", "", 0, "", ""), (None, rows[1][1], None, None, None, None, None), rows[4]]
    labels = [(r[0], int("$$$" not in r[1]), 0) for r in rows[:150]] + [(None, 0, 0), (3, None, None)]
    folder = str(tmp_path_factory.mktemp("tables"))
    for name, data, schema in (
        ("documents", rows, DOCUMENTS),
        ("labels", labels, "doc_id bigint, quality int, toxic int"),
        ("benchmark", items, "item_id bigint, text string"),
    ):
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return folder, rows, items


def test_stages_by_brute_force(spark, tables):
    folder, rows, items = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    weights = fit(docs, learnable(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")))

    def score(text):
        x, size, lines = line_features([(text or "").encode()])
        return float(np.average(marginals(x, lines, weights), weights=size + 1.0))

    expected = [r for r in rows if score(r[1]) >= 0.3]
    assert 0 < len(expected) < len(rows)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "pii_surrogates", "byte_bpe"]
    kept = stages["quality_classifier"](spark, docs, folder)
    assert kept.columns == docs.columns
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, expected))

    for seed in corpus_pipeline.SEEDS:
        _, least, group = brute_components(expected, seed)
        first = {}
        for r, c, g in zip(expected, least, group):
            if r[0] == c:
                first[g] = min(first.get(g, r), r, key=str)
        expected = list(first.values())
    kept = stages["simhash_near_dedup"](spark, spark.createDataFrame(kept.collect(), DOCUMENTS), folder)
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, expected))

    expected = [r for r in expected if brute_leaks(r[1], items, 10)[1] == 0]
    kept = stages["benchmark_decontamination"](spark, spark.createDataFrame(kept.collect(), DOCUMENTS), folder)
    assert kept.columns == docs.columns
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, expected))

    clean = stages["pii_surrogates"](spark, spark.createDataFrame(kept.collect(), DOCUMENTS), folder)
    assert clean.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert len(texts) == len(expected) and not any("corp.example" in (t or "") for t in texts.values())
    assert all(texts[r[0]] == r[1] for r in expected if r[1] is None or "@" not in r[1])

    result = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, map(tuple, result.collect()))) == sorted(str((i, *brute_bpe(t))) for i, t in texts.items())


def test_stages_on_empty_tables(spark, tables, tmp_path):
    folder, *_ = tables
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stand_ins_are_the_same_in_any_subset(spark, tables):
    folder, *_ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id % 7 = 2")
    some = {r["doc_id"]: r["text"] for r in pseudonymize(docs.where("doc_id < 60"), PII_KEY).collect()}
    every = {r["doc_id"]: r["text"] for r in pseudonymize(docs, PII_KEY).collect()}
    assert some and all(every[k] == t for k, t in some.items())
