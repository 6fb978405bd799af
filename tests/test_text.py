from collections import Counter
from datetime import datetime
from math import log

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from otindex.functions.stopwords import ENGLISH
from otindex.operators import text as tx
from otindex.sources.corpus import attach_dates
from workloads.text import _commonness

SENTENCES = ["This is a sentence", "this is ANOTHER sentence.", "", "this is jslf", "... !!"]


@pytest.fixture(scope="module")
def tokens(make):
    return tx.tokenize(make.documents(SENTENCES))


def test_words_keep_inner_apostrophes(make):
    rows = tx.tokenize(make.documents(["Don't 'quote' l’été, 3 co-ops\n—ÜBER"])).first()
    assert rows.tokens == ["don't", "quote", "l’été", "3", "co", "ops", "über"]


def test_stopwords(tokens):
    kept = {r.doc_id: r.tokens for r in tx.remove_stopwords(tokens).collect()}
    assert kept[0] == ["sentence"] and kept[1] == ["another", "sentence"] and kept[2] == []
    assert len(ENGLISH) == len(set(ENGLISH)) == 175


def test_word_counts_match_a_plain_count(make):
    texts = ["b a b c a b", "", "x", "y y y"]
    found = {}
    for r in tx.word_counts(tx.tokenize(make.documents(texts))).collect():
        found.setdefault(r.doc_id, {})[r.word] = r["count"]
        assert r.n_tokens == len(texts[r.doc_id].split())
    assert found == {i: dict(Counter(t.split())) for i, t in enumerate(texts) if t}


def test_word_counts_need_no_shuffle(tokens):
    plan = tx.word_counts(tokens)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_vocabulary_order_and_threshold(tokens):
    rows = tx.build_vocabulary(tokens, 2).orderBy("word_id").collect()
    assert [(r.word_id, r.word, r.freq) for r in rows] == [
        (0, "is", 3), (1, "this", 3), (2, "sentence", 2),
    ]


@pytest.mark.parametrize("limit", [1_000, 1])
def test_distributions(tokens, limit):
    """With a limit of one, all but the most frequent word take the shuffled way."""
    words = tx.build_vocabulary(tokens, 2)
    bucket = tx.doc_distributions(tokens, words, "bucket", limit)
    assert {(r.doc_id, r.word_id): r.p for r in bucket.collect()} == pytest.approx({
        (0, 0): 0.25, (0, 1): 0.25, (0, 2): 0.25, (0, 3): 0.25,
        (1, 0): 0.25, (1, 1): 0.25, (1, 2): 0.25, (1, 3): 0.25,
        (3, 0): 1 / 3, (3, 1): 1 / 3, (3, 3): 1 / 3,
    })
    drop = tx.doc_distributions(tokens, words, "drop", limit)
    assert {(r.doc_id, r.word_id): r.p for r in drop.collect()}[(3, 0)] == pytest.approx(0.5)
    with pytest.raises(ValueError):
        tx.doc_distributions(tokens, words, "other")


def test_empty_documents(tokens):
    shares = tx.doc_distributions(tokens, tx.build_vocabulary(tokens, 1))
    assert {r.doc_id for r in tx.empty_documents(tokens, shares).collect()} == {2, 4}


def test_count_vectors_include_zeros(tokens):
    words = tx.build_vocabulary(tokens, 2)
    rows = {r.doc_id: r.counts for r in tx.count_vectors(tokens, words).collect()}
    assert rows[0] == [1, 1, 1] and rows[2] == [0, 0, 0] and rows[3] == [1, 1, 0]
    blocks = {(r.doc_id, r.block): r.counts for r in tx.count_vectors(tokens, words, 2).collect()}
    assert {k: blocks[d, 0] + blocks[d, 1] for k, d in enumerate(rows)} == dict(enumerate(rows.values()))


def test_hot_word_and_many_rare_ones(make):
    """One word fills a third of all tokens; the split lookup must not lose a row."""
    texts = [f"hot w{i} w{i + 1}" for i in range(60)]
    tokens = tx.tokenize(make.documents(texts))
    words = tx.build_vocabulary(tokens, 1)
    joined = tx.lookup_words(tx.word_counts(tokens), words, 3)
    assert joined.where("word_id is null").count() == 0
    assert joined.where("word = 'hot'").agg(F.sum("count")).first()[0] == 60
    assert joined.count() == 180


def test_distribution_by_weight(spark):
    rows = spark.createDataFrame([(1, 0, 2.0), (1, 1, 6.0), (2, 5, 3.0)], "k int, b int, w double")
    out = {(r.k, r.idx): r.p for r in tx.distribution(rows, "k", "b", "w").collect()}
    assert out == {(1, 0): 0.25, (1, 1): 0.75, (2, 5): 1.0}


def test_entries_other_than_zero_are_read_from_dense_vectors(tokens, monkeypatch):
    """Also where a batch of vectors is made and read in pieces."""
    monkeypatch.setattr(tx, "DENSE_VALUES", 2)
    words = tx.build_vocabulary(tokens, 1)
    blocks = tx.count_vectors(tokens, words, 2)
    expected = {
        (r.doc_id, r.block, len(r.counts), at, n) for r in blocks.collect() for at, n in enumerate(r.counts) if n
    }
    found = [tuple(r) for r in tx.nonzero_counts(blocks).collect()]
    assert len(found) == len(expected) > 6 and set(found) == expected


@pytest.mark.parametrize("oov", ["bucket", "drop"])
def test_distributions_read_each_text_once(tokens, oov):
    """Documents with ids of their own are counted in their task: one scan, no join, no shuffle."""
    words = tx.build_vocabulary(tokens, 2)
    plan = tx.doc_distributions(tokens, words, oov)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Union" not in plan
    assert "sort_array" not in plan and plan.count("MapInArrow") == 1


@pytest.mark.parametrize("limit", [1_000, 1])
@pytest.mark.parametrize("oov", ["bucket", "drop"])
def test_distributions_of_repeated_and_missing_ids(spark, oov, limit):
    """Rows that share an id, null too, share their total or their bucket."""
    texts = [(1, "a a b x y"), (2, "b c z"), (2, "a b z z"), (None, "a c"), (None, "q a"), (3, None), (4, ""), (5, "q q")]
    tokenized = tx.tokenize(spark.createDataFrame(texts, "doc_id long, text string"))
    words = spark.createDataFrame([(0, "a", 9), (1, "b", 8), (2, "c", 7)], "word_id int, word string, freq long")
    found = sorted(map(str, map(tuple, tx.doc_distributions(tokenized, words, oov, limit).collect())))
    if oov == "bucket":
        expected = [
            (1, 0, 2 / 5), (1, 1, 1 / 5), (1, 3, 2 / 5), (2, 1, 1 / 3), (2, 2, 1 / 3), (2, 0, 1 / 4), (2, 1, 1 / 4),
            (2, 3, 3 / 4), (None, 0, 1 / 2), (None, 2, 1 / 2), (None, 0, 1 / 2), (None, 3, 1 / 2), (5, 3, 1.0),
        ]
    else:
        expected = [
            (1, 0, 2 / 3), (1, 1, 1 / 3), (2, 1, 1 / 4), (2, 2, 1 / 4), (2, 0, 1 / 4), (2, 1, 1 / 4),
            (None, 0, 1 / 3), (None, 2, 1 / 3), (None, 0, 1 / 3),
        ]
    assert found == sorted(map(str, expected))


def test_pieces_are_whole_documents_of_bounded_size(monkeypatch):
    monkeypatch.setattr(tx, "PIECE_TOKENS", 3)
    tokens = [["a"], None, ["b", "a"], ["c"], ["d"] * 5, [], ["a", "a"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(tokens, pa.list_(pa.string()))], ["doc_id", "tokens"])
    pieces = list(tx._batch_pieces(batch))
    assert [p.column("doc_id").to_pylist() for p, _ in pieces] == [[0, 1, 2], [3], [4], [5, 6]]
    for piece, sizes in pieces:
        row, code, words = tx._encoded(piece, sizes)
        assert [words[c].as_py() for c in code] == [t for some in piece.column("tokens").to_pylist() for t in some or []]
        assert list(sizes) == [len(some or []) for some in piece.column("tokens").to_pylist()]


def test_word_counts_of_any_tokens(spark):
    """Null tokens count for the length only, empty and missing arrays give nothing."""
    rows = [("p", ["b", None, "a", "b"]), ("q", []), ("r", None), ("s", [None]), ("t", ["a"])]
    counted = tx.word_counts(spark.createDataFrame(rows, "doc_id string, tokens array<string>"))
    assert counted._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(map(tuple, counted.collect())) == [("p", 4, "a", 1), ("p", 4, "b", 2), ("t", 1, "a", 1)]


def test_dates_are_found_by_ids_alone(spark):
    """Texts are not shuffled to find their dates, which may be several; ids that are null or unknown have none."""
    documents = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (1, "d"), (9, "e")], "doc_id long, text string")
    dates = spark.createDataFrame([(k, f"2020-01-{k + 1:02d}") for k in (1, 2, 2, 3)] + [(None, "2020-01-09")], "k long, day string")
    found = attach_dates(documents, dates, "k", "day")
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.columns == ["doc_id", "ts", "text"]
    assert sorted(map(tuple, found.collect())) == [
        (1, "2020-01-02", "a"), (1, "2020-01-02", "d"), (2, "2020-01-03", "b"), (2, "2020-01-03", "b"),
    ]


def test_the_commonness_of_words_by_hand(spark, tmp_path):
    """The mean log frequency over all tokens, for rows that share an id too; texts are neither sorted nor sent to Python."""
    texts = [(1, "a a b"), (2, "a a x"), (3, ""), (4, None), (5, "a q b b b b")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    orders = [(k, datetime(2020, 1, k)) for k in range(1, 6)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    scored = _commonness(spark, str(tmp_path))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "sort_array" not in plan and "MapInArrow" not in plan
    common = log(5)
    assert {r.doc_id: r.score for r in scored.collect()} == pytest.approx({1: common, 2: 2 * common / 3, 5: 5 * common / 6})


def test_dense_vectors_are_filled_and_read_in_one_task(tokens):
    """Dense arrays do not travel: one scan, one Python stage, no join, no shuffle."""
    words = tx.build_vocabulary(tokens, 2)
    plan = tx.nonzero_counts(tx.count_vectors(tokens, words, 2))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and plan.count("MapInArrow") == 1


@pytest.mark.parametrize("limit", [1_000, 1])
def test_vectors_of_repeated_and_missing_ids(spark, monkeypatch, limit):
    """Rows that share an id have the words of all, those without one have none; either way of filling agrees."""
    monkeypatch.setattr(tx, "DENSE_VALUES", 4)
    texts = [(1, "a a b x y"), (2, "b c z"), (2, "a b z z"), (None, "a c"), (3, None), (4, ""), (5, "q q"), (6, "c")]
    tokenized = tx.tokenize(spark.createDataFrame(texts, "doc_id long, text string"))
    words = spark.createDataFrame([(0, "a", 9), (1, "b", 8), (2, "c", 7)], "word_id int, word string, freq long")
    blocks = tx.count_vectors(tokenized, words, 2, limit)
    assert sorted((r.doc_id or 0, r.block, r.counts) for r in blocks.collect()) == sorted(
        (d, k, counts[2 * k : 2 * k + 2])
        for d, counts in [(0, [0] * 3), (1, [2, 1, 0]), (2, [1] * 3), (2, [1] * 3), (3, [0] * 3), (4, [0] * 3), (5, [0] * 3), (6, [0, 0, 1])]
        for k in range(2)
    )
    found = [(1, 0, 2, 0, 2), (1, 0, 2, 1, 1), (6, 1, 1, 0, 1), *[(2, 0, 2, 0, 1), (2, 0, 2, 1, 1), (2, 1, 1, 0, 1)] * 2]
    assert sorted(map(tuple, tx.nonzero_counts(blocks).collect())) == sorted(found)
    empty = tx.count_vectors(tokenized, words.where("false"), 2, limit)
    assert [(r.block, r.counts) for r in empty.collect()] == [(0, [])] * len(texts)
