import random
import re
from collections import Counter

import numpy as np

from otindex.llm.quality_rules import COUNTS, FEATURES, Training, grow, judge, statistics

SCHEMA = "doc_id bigint, text string, score string, features int"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often = Counter(windows)
    repeated = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated),
    )


def texts():
    rng = random.Random(1)
    vocabulary = ["a", "bc", "É", "北京", "x|y", "#", "d.", "!!"]
    out = [" ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 4, 5, 6, 50, 400]))) for _ in range(30)]
    out += ["\n".join(rng.choices(["l 1", " l 1", "", "  ", "m"], k=12)) for _ in range(5)]
    return [*out, None, "", " \t\n", "w " * 300, "one two three four five " * 2, out[0], "a\x1cb\xa0c \x0b\x0cd\re"]


def test_counts_are_exact():
    raw = [(t or "").encode() for t in texts()]
    counts, features = statistics(raw)
    assert [tuple(c) for c in counts.tolist()] == [brute(t) for t in texts()]
    assert features.shape == (len(raw), len(FEATURES)) and np.isfinite(features).all()


def test_trees_learn_and_respect_directions():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] < 0.5) & (x[:, 1] > 0.3)).astype(float)
    forest = grow(x, y, [-1, 0, 1], Training(trees=30))
    assert ((forest.score(x) > 0.5) == (y > 0.5)).mean() > 0.97
    grid = np.linspace(0, 1, 50)
    for row in rng.random((20, 3)):
        line = np.repeat(row[None], 50, axis=0)
        line[:, 0] = grid
        assert (np.diff(forest.score(line)) <= 1e-12).all()
        line[:, 0], line[:, 2] = row[0], grid
        assert (np.diff(forest.score(line)) >= -1e-12).all()


def test_verdicts_for_all_rows(spark):
    rng = random.Random(2)
    good = [" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(60)) + "." for _ in range(80)]
    bad = [" ".join("".join(rng.choices("abcdefgh", k=6)) + "$$$" for _ in range(60)) for _ in range(80)]
    rows = [(i, t, "x", 1) for i, t in enumerate(good + bad)] + [(1000 + i, t, None, None) for i, t in enumerate(texts())]
    rows += [(None, good[0], None, None), rows[0]]
    labels = spark.createDataFrame(
        [(i, int(i < 80)) for i in range(0, 160, 2)] + [(None, 0), (3, None), (0, 1)], "doc_id bigint, quality int"
    )
    out = judge(spark.createDataFrame(rows, SCHEMA), labels).collect()
    assert len(out) == len(rows)
    by_id = {r["doc_id"]: r for r in out}
    for i, t, *_ in rows:
        r, b = by_id[i], brute(t)
        assert tuple(r[c] for c in COUNTS) == b
        assert r["base_failed"] == (b[0] < 10 or 100 * b[4] > 20 * b[0])
        assert not (r["base_failed"] and r["kept"])
    held_out = [by_id[i]["kept"] == (i < 80) for i in range(1, 160, 2)]
    assert sum(held_out) / len(held_out) > 0.95


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert judge(spark.createDataFrame([], SCHEMA), none).count() == 0
    row = judge(spark.createDataFrame([(1, "a b c d e f g h i j k", "", 1)], SCHEMA), none).first()
    assert row["kept"] and row["score"] == 0.5


def test_texts_made_to_collide_do_not_change_a_count():
    """Thue-Morse words and their complements share every polynomial hash modulo 2**64."""
    bits = [bin(k).count("1") & 1 for k in range(1 << 12)]
    word, other = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    raw = [" ".join(["w", "x", word, "y", "z", "w", "x", other, "y", "z"]), " ".join(["w", "x", word, "y", "z"] * 2)]
    counts, _ = statistics([t.encode() for t in raw])
    assert [tuple(c) for c in counts.tolist()] == [brute(t) for t in raw]
    assert counts[0, 4] == 0 and counts[1, 4] == 10
