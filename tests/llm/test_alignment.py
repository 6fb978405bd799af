import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from otindex.llm.alignment import Encoders, align, group_labels

BPE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def corpus():
    rng = random.Random(5)
    words = ["The", "naïve", "tokenization", "über", "2024", "don't", "日本語", "🙂", "<|endoftext|>", "<s>", "<0x41>", "▁x", "a  b", "\t", "\n\n", "\x1c", "\u180e", "\u3000x", "  ", "\u2581", "\xa0y", "'s", "\u200b"]
    texts = [" ".join(rng.choices(words, k=rng.choice([1, 3, 30]))) for _ in range(25)]
    texts += [None, "", " ", "   ", "　", "x\x00y", "z" * 5000, texts[0], texts[0], "word " * 3000]
    rows = [(k, t, 1, "c") for k, t in enumerate(texts)]
    return [*rows, rows[3], (None, texts[1], 2, None), (None, texts[2], 2, None)]


def brute(rows):
    code = Encoders(BPE, PIECE)
    documents = []
    for doc_id, text, *_ in rows:
        text = text or ""
        whole = (" " + text).encode()
        a = code.bpe.encode(" " + text, add_special_tokens=False).ids
        b = code.pieces.encode(text)
        groups = []
        if text and b"".join(code.a[x] for x in a) == whole == b"".join(code.b[x] for x in b):
            ends = [np.cumsum([len(t[x]) for x in ids]).tolist() for t, ids in ((code.a, a), (code.b, b))]
            start = [0, 0]
            for cut in sorted(set(ends[0]) & set(ends[1])):
                stop = [ends[0].index(cut) + 1, ends[1].index(cut) + 1]
                groups.append((a[start[0] : stop[0]], b[start[1] : stop[1]]))
                start = stop
        documents.append((doc_id, groups))
    counts = Counter(p for _, groups in documents for p in {(x, y) for g, h in groups for x in g for y in h})
    most = Counter()
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    for doc_id, groups in documents:
        found = [(x, y) for g, h in groups for x in g for y in h]
        text = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        yield (
            doc_id, sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), len(found),
            sum(counts[p] == most[p[0]] for p in found), sum(counts[p] for p in found),
            hashlib.sha256(text.encode()).hexdigest() if groups else "",
        )


@pytest.mark.parametrize("broadcast_pairs", [4_000_000, 20, 0])
def test_like_brute_force(spark, broadcast_pairs):
    rows = corpus()
    table = spark.createDataFrame(rows, "doc_id bigint, text string, N_A int, pairs string").repartition(3)
    found = align(table, BPE, PIECE, broadcast_pairs)
    assert found.columns == ["doc_id", *NAMES]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(brute(rows), key=repr)


def test_empty_table(spark):
    assert align(spark.createDataFrame([], "doc_id bigint, text string"), BPE, PIECE).count() == 0
    nothing = align(spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string"), BPE, PIECE).collect()
    assert [tuple(r)[1:] for r in nothing] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_groups_by_pointer_jumping():
    rng = np.random.default_rng(0)
    for size in (1, 2, 30, 1000):
        for _ in range(20):
            a, b = (np.union1d(rng.integers(1, size + 1, rng.integers(1, size + 1)), [size]) for _ in range(2))
            left, right = group_labels(a, b)
            cuts = np.intersect1d(a, b)
            expected = [np.searchsorted(cuts, x, "left") for x in (a, b)]
            names, numbers = np.unique(right, return_inverse=True)
            assert np.array_equal(numbers, expected[1]) and np.array_equal(np.searchsorted(names, left), expected[0])


def test_long_chain():
    """Cuts that interleave without ever meeting make one group, found in a few doublings."""
    a, b = np.append(np.arange(2, 200_001, 2), 200_001), np.arange(1, 200_002, 2)
    left, right = group_labels(a, b)
    assert len(np.unique(left)) == 1 and left[0] == right[-1]
