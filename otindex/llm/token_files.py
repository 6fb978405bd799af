"""Token files: documents' token ids in grammar-compressed blocks, decodable at any place.

Documents are tokenised where they are read: a task splits texts at white space, has the library
encode each distinct word once and remembers a bounded number of words. The ids (two or four bytes
each) are dealt into shards by ranges of doc_id, whose bounds are quantiles of the doc_id column alone,
and sorted. A task compresses blocks of its shard and appends them to files, which are committed
through temporary names and a manifest (see :mod:`otindex.llm.files`).

A block is compressed by Re-Pair: count all adjacent pairs of ids, give the most frequent ones a new
id each, replace their occurrences from left to right, and repeat on what results. Pairs never span
two documents, so a document is a range of symbols. A block stores its rules, the expansion length of
every rule, and the directory of its documents; with the lengths any range of ids is found and
expanded without the rest.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import count as count_up

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from otindex.llm.bytes_ import as_bytes, pieces
from otindex.llm.files import MANIFEST_SCHEMA, RollingWriter, commit, manifest, one_file_per_task

#: Ids per block, and bytes after which a file is full.
BLOCK_IDS, FILE_BYTES = 1 << 20, 256 << 20

#: Words remembered by a task, and bytes of the longest one.
REMEMBERED, LONGEST = 800_000, 64

#: Latin letters, and punctuation that neither joins them nor begins a contraction.
_PLAIN = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")

_MAGIC, _HEADER = b"RPTF0001", "<4sIIIQQ"
_NO_ID = -(1 << 63)


class WordEncoder(dict):
    """Encodes texts with a tokenizer that works on each white-space separated word on its own.

    As a dictionary it holds the ids of the words met so far and encodes a missing one. A word of Latin
    letters and the punctuation after it are encoded apart, the letters by the library's model without
    the steps before it; a tokenizer for which that makes a difference is found out at the start. A text
    with one of the tokenizer's special strings, which it finds across words, is encoded whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.specials = [str(t.content).encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        rest = [b for b in range(256) if b not in shown]
        self.letters = {b: 256 + k for k, b in enumerate(rest)}  # byte-level BPE shows these bytes as other letters
        self.plain = True
        self.plain = all(
            self.encoded(b"".join(x)) == b"".join(self[part] for part in x) and self[x[0]] == self.encoded(x[0])
            for x in ((b"the", b",."), ("Straße".encode(), b"!"), ("ÉTÉ".encode(), b")"), (b"internationalization", b"***"))
        )
        self.clear()

    def encoded(self, text: bytes) -> bytes:
        """The ids of a text, by the whole tokenizer, as little-endian numbers."""
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, self.kind).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        if self.plain and word.isalpha():  # ASCII letters
            folded = word.lower()
            if folded == word:
                ids = array(self.kind.char, [t.id for t in self.tokenize(word.decode())]).tobytes()
            else:
                ids = self[folded]
        elif self.plain and (split := _PLAIN.fullmatch(word)):
            core, tail = split.groups()
            if tail:
                ids = self[core] + self[tail]
            elif (folded := core.decode().lower().encode()) != word:
                ids = self[folded]
            else:
                shown = word.decode("latin-1").translate(self.letters)
                ids = array(self.kind.char, [t.id for t in self.tokenize(shown)]).tobytes()
        else:
            ids = self.encoded(word)
        if len(word) <= LONGEST:
            self[word] = ids
        return ids

    def batch(self, texts: list[bytes]) -> list[bytes]:
        """The ids of some texts."""
        if len(self) > REMEMBERED:
            self.clear()
        return [
            self.encoded(t) if any(s in t for s in self.specials) else b"".join(map(self.__getitem__, t.split())) for t in texts
        ]


@lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    """The encoder of a worker process, whose tasks follow each other and share the words it remembers."""
    return WordEncoder(path)


@dataclass(frozen=True)
class Grammar:
    """Symbols below ``base`` are ids; rule k is symbol base + k and stands for left[k], right[k]."""

    base: int
    left: np.ndarray
    right: np.ndarray
    lengths: np.ndarray  # ids that each rule stands for

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        """Ids that each symbol stands for."""
        if not len(self.lengths):
            return np.ones(len(symbols), np.int64)
        rule = symbols.astype(np.int64) - self.base
        return np.where(rule >= 0, self.lengths[np.maximum(rule, 0)], 1)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of some symbols."""
        flat, starts = self._expansions
        sizes = self.sizes(symbols)
        out = np.repeat(symbols.astype(np.int64), sizes)
        if not len(starts):
            return out
        first = starts[np.maximum(symbols.astype(np.int64) - self.base, 0)]
        of_rule = out >= self.base
        at = np.arange(len(out)) - np.repeat(np.cumsum(sizes) - sizes - first, sizes)
        out[of_rule] = flat[at[of_rule]]
        return out

    @cached_property
    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rules one after the other, and where each rule's begin."""
        ids = np.arange(self.base, self.base + len(self.left))
        while (rule := ids >= self.base).any():
            out = np.empty(len(ids) + int(rule.sum()), np.int64)
            at = np.arange(len(ids)) + np.cumsum(rule) - rule
            out[at] = ids
            out[at[rule]] = self.left[ids[rule] - self.base]
            out[at[rule] + 1] = self.right[ids[rule] - self.base]
            ids = out
        return ids, np.cumsum(self.lengths) - self.lengths


def compress(ids: np.ndarray, ends: np.ndarray, base: int, rounds: int = 5, least: int = 6, limit: int = 1 << 16) -> tuple[Grammar, np.ndarray, np.ndarray]:
    """Re-Pair on a block: the grammar, the symbols, and where each document's symbols end.

    ``ids`` are those of all documents, ``ends`` where each document ends; ids are below ``base`` and
    symbols below ``limit``. Each round counts all pairs within documents and replaces those that
    occur at least ``least`` times, the most frequent first as far as symbols are left; rounds go on until
    no pair does or no symbol is left.
    """
    seq = ids.astype(np.uint32)
    last = np.zeros(len(seq) + 1, bool)  # the last symbol of a document, or before the first
    last[ends] = True
    last = last[1:]
    left, right, lengths = (np.empty(0, np.int64) for _ in range(3))
    for k in count_up():
        free = limit - base - len(left)
        if free <= 0 or len(seq) < 2:
            break
        code = (seq[:-1].astype(np.uint64) << np.uint64(32)) | seq[1:] if limit > 1 << 16 else (seq[:-1] << np.uint32(16)) | seq[1:]
        open_ = ~last[:-1]
        ordered = np.sort(code[open_])
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.empty(0, np.int64)
        counts = np.diff(np.append(first, len(ordered)))
        often = np.flatnonzero(counts >= least)
        if not len(often):
            break
        # Half of the free symbols in the first rounds, then all: later rounds join what earlier ones made.
        share = free if k >= rounds - 1 else max(1, free // 2)
        if len(often) > share:
            often = np.sort(often[np.argsort(-counts[often], kind="stable")[:share]])
        pairs = ordered[first[often]]
        slots = np.full(1 << 18, -1, np.int32)
        where = _slot(pairs)
        slots[where] = np.arange(len(pairs))  # of pairs that share a slot one waits for another round
        kept = slots[where] == np.arange(len(pairs))
        pairs = pairs[kept]
        slots[where[kept]] = np.arange(len(pairs))
        found = slots[_slot(code)]
        match = (found >= 0) & open_
        match[match] = pairs[found[match]] == code[match]
        at = np.flatnonzero(match)
        if not len(at):
            break
        # Of overlapping pairs in a run the first, third, ... are replaced.
        run = np.concatenate(([True], at[1:] != at[:-1] + 1))
        start = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - start) % 2 == 0]
        shift = 32 if limit > 1 << 16 else 16
        a, b = (pairs >> pairs.dtype.type(shift)).astype(np.int64), (pairs & pairs.dtype.type((1 << shift) - 1)).astype(np.int64)
        seq[at] = (base + len(left) + found[at]).astype(np.uint32)
        last[at] = last[at + 1]
        stays = np.ones(len(seq), bool)
        stays[at + 1] = False
        grammar = Grammar(base, left, right, lengths)
        lengths = np.concatenate((lengths, grammar.sizes(a) + grammar.sizes(b)))
        left, right = np.concatenate((left, a)), np.concatenate((right, b))
        seq, last = seq[stays], last[stays]
    filled = np.diff(np.concatenate(([0], ends))) > 0
    symbol_ends = np.zeros(len(ends), np.int64)
    symbol_ends[filled] = np.flatnonzero(last) + 1
    return Grammar(base, left, right, lengths), seq, np.maximum.accumulate(symbol_ends) if len(ends) else symbol_ends


def _slot(code: np.ndarray) -> np.ndarray:
    """A place among 2**18 for each pair."""
    if code.dtype == np.uint64:
        return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(14)).astype(np.int64)


def pack(doc_ids: list[int | None], ids: list[np.ndarray], base: int, limit: int = 1 << 16) -> bytes:
    """A block of documents as bytes."""
    ends = np.cumsum([len(x) for x in ids]).astype(np.int64)
    joined = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    grammar, symbols, symbol_ends = compress(joined, ends, base, limit=limit)
    kind = "<u2" if limit <= 1 << 16 else "<u4"
    body = b"".join(
        [
            np.array([_NO_ID if d is None else d for d in doc_ids], "<i8").tobytes(),
            ends.astype("<u8").tobytes(),
            symbol_ends.astype("<u8").tobytes(),
            grammar.left.astype(kind).tobytes(),
            grammar.right.astype(kind).tobytes(),
            grammar.lengths.astype("<u4").tobytes(),
            symbols.astype(kind).tobytes(),
        ]
    )
    return struct.pack(_HEADER, b"BLCK", base, len(doc_ids), len(grammar.left), len(symbols), len(body)) + struct.pack("<II", limit.bit_length(), zlib.crc32(body)) + body


class Block:
    """A block that was read: its documents and any range of their ids."""

    def __init__(self, header: tuple, bits: int, body: bytes):
        _, base, docs, rules, symbols, _ = header
        kind, at = np.dtype("<u2" if bits <= 17 else "<u4"), 0

        def take(count: int, kind: np.dtype) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(body, kind, count, at)
            at += out.nbytes
            return out

        self.doc_ids = [None if d == _NO_ID else d for d in take(docs, np.dtype("<i8")).tolist()]
        self.ends = take(docs, np.dtype("<u8")).astype(np.int64)
        self.symbol_ends = take(docs, np.dtype("<u8")).astype(np.int64)
        left, right = take(rules, kind).astype(np.int64), take(rules, kind).astype(np.int64)
        self.grammar = Grammar(base, left, right, take(rules, np.dtype("<u4")).astype(np.int64))
        self.symbols = take(symbols, kind)

    def ids(self) -> np.ndarray:
        """All ids of the block."""
        return self.grammar.expand(self.symbols)

    def part(self, doc: int, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of a document; only the symbols that hold them are expanded."""
        low = self.symbol_ends[doc - 1] if doc else 0
        symbols = self.symbols[low : self.symbol_ends[doc]]
        reach = np.cumsum(self.grammar.sizes(symbols))
        first = int(np.searchsorted(reach, start, "right"))
        after = int(np.searchsorted(reach, stop, "left")) + 1
        before = int(reach[first - 1]) if first else 0
        return self.grammar.expand(symbols[first:after])[start - before : stop - before]


def blocks(stream):
    """The blocks of an open token file, checked against their checksums."""
    if stream.read(len(_MAGIC)) != _MAGIC:
        raise ValueError("not a token file")
    while head := stream.read(struct.calcsize(_HEADER)):
        header = struct.unpack(_HEADER, head)
        bits, crc = struct.unpack("<II", stream.read(8))
        body = stream.read(header[5])
        if header[0] != b"BLCK" or len(body) != header[5] or zlib.crc32(body) != crc:
            raise ValueError("damaged block")
        yield Block(header, bits, body)


def write_tokens(
    documents: DataFrame, folder: str, tokenizer_path: str, end_id: int, shards: int | None = None,
    block_ids: int = BLOCK_IDS, file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Tokenise (doc_id, text), append ``end_id`` to each document, and write token files in ``folder``.

    Documents lie in ascending doc_id order over all files, null ids first; rows that share an id are
    all written, ordered by their ids. Null texts have no ids but the end id. A document longer than a
    block makes a block of its own. Other columns are ignored. Returns the manifest; its ``items`` are
    ids and ``start`` counts the ids before a file.
    """
    spark = documents.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / shards for k in range(1, shards)]
    quantiles = documents.agg(F.percentile_approx("doc_id", shares, 10_000).alias("q")).first()["q"] if shares else None
    bounds = np.array(sorted(set(quantiles or ())), np.int64)

    def encode(batches):
        encoder = None
        for batch in batches:
            encoder = encoder or _encoder(tokenizer_path)
            end = np.array([end_id], encoder.kind).tobytes()
            for piece in pieces(batch, "text"):
                ids = [x + end for x in encoder.batch(as_bytes(piece.column("text")).to_pylist())]
                keys = piece.column("doc_id").to_pylist()
                shard = [0 if d is None else int(np.searchsorted(bounds, d, "left")) for d in keys]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(ids, pa.binary()), pa.array(shard, pa.int32())],
                    ["doc_id", "ids", "shard"],
                )

    encoded = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "doc_id bigint, ids binary, shard int")
    dealt = encoded.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("doc_id", "ids")
    wide = _vocabulary(tokenizer_path)
    kind, base = ("<u2", wide) if wide <= 1 << 16 else ("<u4", wide)
    limit = 1 << 16 if wide < (1 << 16) - 256 else wide + (1 << 16)

    def write(batches):
        out, doc_ids, held, size = None, [], [], 0
        for batch in batches:
            if out is None and batch.num_rows:
                out = RollingWriter(folder, batch.column("shard")[0].as_py(), "tokens", ".rptf", file_bytes, _MAGIC)
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids = np.frombuffer(raw, kind)
                if held and size + len(ids) > block_ids:
                    out.write(pack(doc_ids, held, base, limit), len(held), size)
                    doc_ids, held, size = [], [], 0
                doc_ids.append(doc_id)
                held.append(ids)
                size += len(ids)
        if held:
            out.write(pack(doc_ids, held, base, limit), len(held), size)
        if out is not None:
            yield from out.manifest()

    return commit(dealt.mapInArrow(write, MANIFEST_SCHEMA), folder)


def _vocabulary(path: str) -> int:
    """The number of ids of a tokenizer: one more than its largest."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()) + 1


def read_tokens(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the files, and with ``ids`` the ids.

    ``start`` counts the ids of all documents before it; ids_crc32 is over the ids as little-endian
    unsigned 32-bit numbers.
    """
    files = one_file_per_task(manifest(spark, folder).select("name", "start"))
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 5 if ids else 4]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]

    def read(batches):
        store, path = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with store.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for block in blocks(stream):
                        all_ids = block.ids().astype("<u4")
                        raw, ends = memoryview(all_ids).cast("B"), block.ends
                        begins = np.concatenate(([0], ends[:-1]))
                        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                        columns = [block.doc_ids, start + begins, ends - begins, crc]
                        arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=False)]
                        if ids:
                            offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
                            arrays.append(pa.ListArray.from_arrays(offsets, pa.array(all_ids.astype(np.int32))))
                        yield pa.RecordBatch.from_arrays(arrays, names)
                        start += len(all_ids)

    fields = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if ids else "")
    return files.mapInArrow(read, fields)
