import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from otindex.llm import collocations as module
from otindex.llm.collocations import Unit, collocations

NAMES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
SCHEMA = "doc_id bigint, lang string, text string, F int, rank string, `a.b` map<string,int>"


def corpus():
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(12)] + ["Über", "ÜBER", " x", "a\x00b", "New York", "state\tof  the art", "日本"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    rows = []
    for k in range(120):
        words = rng.choices(vocabulary, weights, k=rng.choice([0, 1, 2, 30, 90]))
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "\x0b", "!"]) for w in words)
        rows.append((k, rng.choice(["en", "en", "fr", None, "und"]), text, 1, "r", {"x": 1}))
    rows += [(500, "en", "hot dog " * 400, None, None, None), (501, "once", "hot dog " * 9, None, None, None), (None, "fr", None, 1, "", None)]
    return [*rows, rows[3], rows[3], (None, "fr", "w1 w2 w3", None, None, None), (502, "en", "", None, None, None)]


def brute(rows, size, least, top, share):
    counts, totals = Counter(), Counter()
    for _, lang, text, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, size + 1):
                counts.update((lang, *words[at : at + k]) for at in range(len(words) - k + 1))
    found = {p: n for p, n in counts.items() if n >= least}
    out = []
    for lang in totals:
        scored = []
        for phrase, a in found.items():
            words = phrase[1:]
            if phrase[0] != lang or len(words) < 2:
                continue
            inside = [
                n for p, n in found.items()
                if p[0] == lang and len(p) > len(phrase) and any(p[1 + k : 1 + k + len(words)] == words for k in range(len(p)))
            ]
            if any(100 * n >= share * a for n in inside):
                continue
            cuts = [(found[lang, *words[:k]], found[lang, *words[k:]]) for k in range(1, len(words))]
            scores = [1_000_000 * a * a // (left * right) for left, right in cuts]
            k = scores.index(min(scores))
            scored.append((-scores[k], -a, " ".join(words).encode(), *cuts[k]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("size, least, top, share, shards", [(3, 10, 2000, 50, 4), (4, 3, 7, 30, 2), (2, 1, 50, 50, 1)])
def test_like_brute_force(spark, monkeypatch, size, least, top, share, shards):
    monkeypatch.setattr(module, "BUCKET_HASHES", 100)
    rows = corpus()
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = collocations(table, size, least, top, share, shards)
    assert found.columns == NAMES
    assert sorted(map(tuple, found.collect())) == brute(rows, size, least, top, share)


def test_scores_pass_64_bits(spark):
    """A phrase said a hundred thousand times: the product of its counts and a million passes 2**63."""
    rows = [(k, "en", "big deal " * 10_000) for k in range(400)]
    found = collocations(spark.createDataFrame(rows, "doc_id bigint, lang string, text string"), 2)
    best = [tuple(r)[2:] for r in found.collect()]
    both, n = 4_000_000, 8_000_000
    after = both - 400
    assert best == [("big deal", both, both, both, n, 1_000_000), ("deal big", after, both, both, n, 10**6 * after**2 // both**2)]


def test_empty_table(spark):
    assert collocations(spark.createDataFrame([], "doc_id bigint, lang string, text string")).count() == 0
    nothing = spark.createDataFrame([(1, "en", None), (2, "en", ".,;")], "doc_id bigint, lang string, text string")
    assert collocations(nothing).count() == 0


def test_words_do_not_reach_across_texts():
    unit = Unit(pa.array(["one two", "three", None, "", "four. five"]))
    assert [n.decode() for n in unit.names.to_pylist()] == ["one", "two", "three", "four", "five"]
    assert unit.row.tolist() == [0, 0, 1, 4, 4] and len(set(unit.piece.tolist())) == 4
