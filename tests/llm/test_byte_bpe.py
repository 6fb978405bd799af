import hashlib

import public_tokenizers
import pytest
import tiktoken

from otindex.llm.byte_bpe import encode_documents, load_ranks

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

TEXTS = [
    "", None, "a", "   ", "\n\n b", "Hello  world's 123!\r\n\r\n  they're", "x" * 500, "né à 北京 🙂" * 20,
    "they're we'll " * 30, ("a  \n\n  b' re 12 " * 40), "'" * 90 + "re", "word " * 100, "word " * 100,
    " " * 300 + "end", "ab" * 40 + " " + "7" * 400,
]


def brute(text):
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(RANKS), special_tokens={})
    ids = encoding.encode_ordinary(text or "")
    joined = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    return len(ids), joined, hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize(("chunk", "overlap"), [(1 << 16, 1 << 10), (64, 16), (17, 9), (100, 1)])
def test_like_the_library_at_any_chunk_size(spark, chunk, overlap):
    rows = [(i // 2, t, "en", i) for i, t in enumerate(TEXTS)] + [(None, "null id " * 30, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, key string, piece int")
    out = encode_documents(docs, RANKS, public_tokenizers.PATTERN, chunk, overlap).collect()
    expected = [(i, *brute(t)) for i, t, *_ in rows]
    assert sorted(map(tuple, out), key=str) == sorted(expected, key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert encode_documents(docs, RANKS, public_tokenizers.PATTERN).count() == 0
