import io
import random
import zlib

import numpy as np
import pyarrow.fs as pafs
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from otindex.llm.files import manifest
from otindex.llm.token_files import _MAGIC, WordEncoder, blocks, compress, pack, read_tokens, write_tokens
from otindex.session import working_folder

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, shard string, ids int"

TEXTS = [
    "", None, "Hello, WORLD! they're we'll  x1y2 \x1c\x85\xa0z", "É́ é, ñ. Å\n̸x", "北京 🙂🙂 ﬁn", "<|endoftext|> a <|startoftext|>b",
    "<|ENDOFTEXT|>", "end... (of) [it]*** $$$ a_b-c 'tis o'clock' \"q\"", "ÀÉÎ ÷× ÿß µª ΑΣ ΣΑΣ İI", "word " * 400, "x" * 300, "\r\n\t\x0b\x0c",
]


def library(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_words_are_encoded_as_the_library_encodes_whole_texts():
    encoder = WordEncoder(PATH)
    assert encoder.plain
    rng = random.Random(0)
    parts = " ".join(t for t in TEXTS if t and "<|" not in t).split(" ")
    mixed = [" ".join(rng.choices(parts, k=40)) + rng.choice(["\n", "", ",", "'s"]) for _ in range(100)]
    for texts in (TEXTS, mixed):
        got = [np.frombuffer(x, encoder.kind).tolist() for x in encoder.batch([(t or "").encode() for t in texts])]
        assert got == library(texts)


@pytest.mark.parametrize("limit", [1 << 16, 1 << 20])
def test_blocks_expand_to_their_ids_whole_and_in_part(limit):
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 6, n).astype(np.uint32) + 1000 for n in (0, 1, 2, 5000, 0, 777, 3)]
    docs += [np.full(1000, 7, np.uint32), np.tile(np.arange(9, dtype=np.uint32), 200), np.empty(0, np.uint32)]
    names = [None, -5, *range(8)]
    (block,) = blocks(io.BytesIO(_MAGIC + pack(names, docs, 2000, limit)))
    assert block.doc_ids == names and (block.ids() == np.concatenate(docs)).all()
    assert len(block.symbols) < 0.5 * sum(map(len, docs)) and len(block.grammar.left) > 10
    for k, doc in enumerate(docs):
        for a, b in ((0, len(doc)), (len(doc) // 3, len(doc) // 2), (len(doc) // 2, len(doc) // 2 + 1)):
            if b <= len(doc) and a < b:
                assert (block.part(k, a, b) == doc[a:b]).all()
    lengths = [len(block.grammar.expand(np.array([2000 + k]))) for k in range(len(block.grammar.left))]
    assert lengths == block.grammar.lengths.tolist()


def test_rules_are_pairs_that_were_frequent():
    ids = np.tile(np.array([1, 2, 3, 4], np.uint32), 50)
    grammar, symbols, ends = compress(ids, np.array([100, 200]), 10, rounds=3)
    assert (grammar.left[0], grammar.right[0]) in {(1, 2), (2, 3), (3, 4), (4, 1)}
    assert ends[-1] == len(symbols) and (grammar.expand(symbols[: ends[0]]) == ids[:100]).all()


@pytest.mark.parametrize(("shards", "block", "size"), [(None, 1 << 20, 1 << 28), (3, 50, 500)])
def test_round_trip_in_ascending_order(spark, shards, block, size):
    rng = random.Random(2)
    rows = [(i * 7 - 20, rng.choice(TEXTS), "clash", 1) for i in range(60)]
    rows += [rows[3], (rows[3][0], "another text", None, None), (None, "no id", None, None), (None, None, None, None)]
    rng.shuffle(rows)
    folder = working_folder(spark, "tokens")
    files = write_tokens(spark.createDataFrame(rows, SCHEMA), folder, PATH, 2, shards, block, size)
    ids = {i: x + [2] for i, x in enumerate(library([r[1] for r in rows]))}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, np.array(ids[i], "<u2").tobytes()))
    expected, start = [], 0
    for i in order:
        expected.append((rows[i][0], start, len(ids[i]), zlib.crc32(np.array(ids[i], "<u4").tobytes())))
        start += len(ids[i])
    out = sorted(read_tokens(spark, folder).collect(), key=lambda r: r["start"])
    assert [tuple(r)[:4] for r in out] == expected and [r["ids"] for r in out] == [ids[i] for i in order]
    assert sum(r["items"] for r in files.collect()) == start and (files.count() > 4) == (size < 1000)
    assert sorted(map(tuple, read_tokens(spark, folder, ids=False).collect()), key=lambda r: r[1]) == expected


def test_damage_is_noticed(spark):
    folder = working_folder(spark, "tokens")
    write_tokens(spark.createDataFrame([(1, "some text here", "", 0)], SCHEMA), folder, PATH, 2)
    store, path = pafs.FileSystem.from_uri(folder)
    name = f"{path}/{manifest(spark, folder).first()['name']}"
    data = bytearray(store.open_input_stream(name).read())
    data[-1] ^= 1
    with store.open_output_stream(name) as out:
        out.write(bytes(data))
    with pytest.raises(Exception, match="damaged block"):
        read_tokens(spark, folder).collect()


def test_empty_table(spark):
    folder = working_folder(spark, "tokens")
    write_tokens(spark.createDataFrame([], SCHEMA), folder, PATH, 2)
    assert read_tokens(spark, folder).count() == 0


@pytest.mark.parametrize("unit", [[7], [1, 2, 3], list(range(50))])
def test_grammar_goes_on_until_nothing_repeats(unit):
    """A shard of one repeated passage shrinks to a handful of symbols, and any part of it is found."""
    ids = np.array(unit * (100_000 // len(unit)), np.uint32)
    grammar, symbols, ends = compress(ids, np.array([len(ids)]), 49_408)
    assert len(symbols) < 40 * len(unit) and list(ends) == [len(symbols)]
    assert np.array_equal(grammar.expand(symbols), ids)
