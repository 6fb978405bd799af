import random
import re

import pytest

from otindex.llm.decontaminate import decontaminate, find_leaks

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def brute(text, items, n):
    own = words(text)
    hit, found = set(), set()
    for item, content in items:
        inside = words(content)
        size = min(n, len(inside))
        for k in range(len(inside) - size + 1 if size else 0):
            for at in range(len(own) - size + 1):
                if own[at : at + size] == inside[k : k + size]:
                    hit.update(range(at, at + size))
                    found.add("" if item is None else str(item))
    return len(own), len(hit), sorted(found)


def tables(spark):
    rng = random.Random(7)
    vocabulary = ["a", "b", "Ça", "x1", "É", "zz"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([2, 4, 6, 12])))) for i in range(8)]
    items += [(3, "zz zz-a, b"), (9, None), (10, ""), (11, "?!"), (None, "only, Once 北京"), items[0]]
    texts = [" ,".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 30, 200]))) for _ in range(40)]
    texts += [None, "", "ONLY once\n北京!", "ZZ zz A B", "!!!", texts[3], " ".join(i[1] or "" for i in items)]
    docs = [(i // 2, t, "x", "clash", i) for i, t in enumerate(texts)] + [(None, texts[3], None, None, None)]
    return (
        spark.createDataFrame(docs, "doc_id bigint, text string, lang string, n_hit string, n_chars bigint"),
        spark.createDataFrame(items, "item_id bigint, text string"),
        docs,
        items,
    )


@pytest.mark.parametrize(("n", "block"), [(4, 1 << 25), (10, 1 << 25), (3, 1500)])
def test_like_brute_force_in_one_block_or_many(spark, n, block):
    documents, benchmark, docs, items = tables(spark)
    out = find_leaks(documents, benchmark, n, block_bytes=block).collect()
    got = sorted((str(r["doc_id"]), str(r["text"]), r["n_words"], r["n_hit"], sorted(r["items"])) for r in out)
    assert got == sorted((str(d[0]), str(d[1]), *brute(d[1], items, n)) for d in docs)


def test_removal_of_documents_and_spans(spark):
    documents, benchmark, docs, items = tables(spark)
    clean = [d for d in docs if brute(d[1], items, 4)[1] == 0]
    kept = decontaminate(documents, benchmark, 4)
    assert kept.columns == documents.columns
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, clean))
    cut = decontaminate(documents, benchmark, 4, "spans")
    assert cut.columns == documents.columns and cut.count() == len(docs)
    before = {str(d[4]): d for d in docs}
    for r in cut.collect():
        total, hit, _ = brute(before[str(r["n_chars"])][1], items, 4)
        assert len(words(r["text"])) == total - hit


def test_empty_tables(spark):
    documents, benchmark, docs, _ = tables(spark)
    assert find_leaks(documents.limit(0), benchmark).count() == 0
    assert find_leaks(documents, benchmark.limit(0)).where("n_hit > 0").count() == 0


def test_columns_that_differ_in_letter_case(spark):
    """A column named like an added one but for its case is replaced in the report and kept in the text."""
    docs = spark.createDataFrame([(1, "one two three", 7), (2, "four five", 8)], "doc_id bigint, text string, N_Hit int")
    items = spark.createDataFrame([("a", "one two three")], "item_id string, text string")
    found = find_leaks(docs, items, 3)
    assert sorted((r["doc_id"], r["n_hit"]) for r in found.collect()) == [(1, 3), (2, 0)]
    kept = decontaminate(docs, items, 3)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(2, "four five", 8)]


def test_maps_and_dotted_names(spark):
    docs = spark.createDataFrame(
        [(1, "one two three four", "q", {"k": 1}), (2, "four five", "p", None)], "doc_id bigint, text string, `a.b` string, m map<string,int>"
    )
    items = spark.createDataFrame([("a", "one two three")], "item_id string, text string")
    assert [tuple(r) for r in decontaminate(docs, items, 3).collect()] == [(2, "four five", "p", None)]
    cut = {r["doc_id"]: tuple(r) for r in decontaminate(docs, items, 3, "spans").collect()}
    assert cut[1] == (1, " four", "q", {"k": 1}) and cut[2] == (2, "four five", "p", None)
