"""Align two tokenizers: groups of tokens that cover the same bytes, and how common their links are.

Both tokenizers cut one text. A token points to the token that overlaps it and reaches farthest right;
the last tokens of a group, which end together, point to the second tokenizer's one. Doubling the
pointers (every pointer takes its target's pointer, all at once) brings every token to the last token
of its group in logarithmically many steps, and that token labels the group.

Texts are encoded once; the distinct links of each row are kept in the shared folder as 32-bit numbers with
how often they occur. Counting adds up the links of many documents in a task before the shuffle. The
counts come back in two ways: those of the commonest pairs, as many as fit a fixed size, are broadcast;
rarer pairs, none of which is a hot key, are joined by a shuffle.
"""

from __future__ import annotations

import hashlib
import json
import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from otindex.llm.bytes_ import pieces
from otindex.session import working_folder

#: Pairs whose counts are broadcast, 9 bytes each, and link entries a task adds up before it passes them on.
BROADCAST_PAIRS, HELD_LINKS = 4_000_000, 8_000_000

#: Fixed value: how byte-level BPE of this kind splits a text before its merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_NOTHING = np.empty(0, np.int64)


class Encoders:
    """Both tokenizers with the bytes of each of their ids."""

    def __init__(self, bpe_path: str, piece_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.bpe = Tokenizer.from_file(bpe_path)
        self.bpe.encode_special_tokens = True
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        # byte-level BPE shows all other bytes as the letters from 256 on
        letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted({*range(256)} - {*shown}))}
        vocabulary = self.bpe.get_vocab(with_added_tokens=True)
        self.a = [b""] * (max(vocabulary.values()) + 1)
        for token, id_ in vocabulary.items():
            self.a[id_] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.b = [
            bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(k) else piece.replace("▁", " ").encode()
            for k, piece in enumerate(map(self.pieces.id_to_piece, range(self.pieces.get_piece_size())))
        ]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a, self.b))
        self.quick = self._by_ranks(json.loads(self.bpe.to_str()))
        # every id as text, with what may follow it
        self.names = [
            np.array([f"{i}{mark}" for mark in marks for i in range(len(table))], object) for table, marks in ((self.a, ",|"), (self.b, ",;"))
        ]

    def _by_ranks(self, settings: dict):
        """The same tokenizer by ranks, which is several times as fast, if its merges are numbered in their order."""
        model, splits = settings["model"], settings["pre_tokenizer"] or {}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        plain = splits.get("type") == "ByteLevel" and splits.get("use_regex") and not splits.get("add_prefix_space")
        if not plain or settings["normalizer"] or any(model["vocab"]["".join(m)] != 256 + k for k, m in enumerate(merges)):
            return None
        import tiktoken

        ranks = {token: k for k, token in enumerate(self.a[: 256 + len(merges)])}
        return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of both; none for empty texts and those that either does not give back."""
        spaced = [" " + t for t in texts]
        if self.quick:
            a = list(map(self.quick.encode_ordinary, spaced))
        else:
            a = [e.ids for e in self.bpe.encode_batch_fast(spaced, add_special_tokens=False)]
        b = self.pieces.encode(texts, num_threads=1)
        for k, (whole, text) in enumerate(zip(spaced, texts)):
            raw = whole.encode()
            if not text or b"".join(map(self.a.__getitem__, a[k])) != raw or b"".join(map(self.b.__getitem__, b[k])) != raw:
                a[k], b[k] = [], []
        return a, b

    def rows(self, texts: list[str]) -> tuple[list[np.ndarray], list[str], list[tuple[np.ndarray, np.ndarray]]]:
        """Of every text the numbers of tokens of both and of groups, the digest of the groups, and its
        distinct linked pairs with how often each is linked. All texts are aligned together."""
        coded = self.encode(texts)
        n_a, n_b = (np.array(list(map(len, ids)), np.int64) for ids in coded)
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in coded)
        # one after the other the texts are one text; tokens of both end where a text ends
        a_groups, b_groups = group_labels(np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b]))
        a_last, b_last = (np.append(g[1:] != g[:-1], [True])[: len(g)] for g in (a_groups, b_groups))
        a_stop, b_stop = np.cumsum(n_a), np.cumsum(n_b)
        groups = np.diff(np.concatenate(([0], np.cumsum(a_last)))[np.concatenate(([0], a_stop))])
        # the groups as text: ``a1,a2|b1;a3|b2,b3``
        shown = np.empty(len(a) + len(b), object)
        shown[np.arange(len(a)) + np.searchsorted(b_groups, a_groups, "left")] = self.names[0][a + a_last * len(self.a)]
        shown[np.arange(len(b)) + np.searchsorted(a_groups, b_groups, "right")] = self.names[1][b + b_last * len(self.b)]
        shown, stops = shown.tolist(), (a_stop + b_stop).tolist()
        digests = ["" if i == j else hashlib.sha256("".join(shown[i:j])[:-1].encode()).hexdigest() for i, j in zip([0, *stops], stops)]
        pairs, of = linked_pairs(a, b, a_groups, b_groups)
        ends = np.searchsorted(of, a_stop, "left").tolist()  # ``of`` is each link's token of the first kind
        found = [np.unique(pairs[i:j], return_counts=True) for i, j in zip([0, *ends], ends)]
        return [n_a, n_b, groups], digests, found


@lru_cache(maxsize=1)
def _encoders(bpe_path: str, piece_path: str) -> Encoders:
    """Those of a worker process, whose tasks follow each other."""
    return Encoders(bpe_path, piece_path)


def group_labels(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The label of every token's group, from the ends of the tokens of two cuts of the same bytes.

    Labels rise from left to right but are not consecutive. Tokens are not empty.
    """
    n, m = len(a_ends), len(b_ends)
    # the last token of the other kind that starts before this one ends
    from_a, from_b = np.searchsorted(b_ends, a_ends, "left"), np.searchsorted(a_ends, b_ends, "left")
    own = n + np.arange(m)
    # if that reaches farther it is the pointer; a token of the first kind goes to one that ends with it too
    pointer = np.concatenate((n + from_a, np.where(a_ends[np.minimum(from_b, n - 1)] > b_ends, from_b, own))) if n and m else np.arange(n + m)
    while not np.array_equal(further := pointer[pointer], pointer):
        pointer = further
    return pointer[:n], pointer[n:]


def linked_pairs(a: np.ndarray, b: np.ndarray, a_groups: np.ndarray, b_groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The id pairs of all linked tokens as ``a << 32 | b``, and the places of their first tokens, rising."""
    low, high = np.searchsorted(b_groups, a_groups, "left"), np.searchsorted(b_groups, a_groups, "right")
    width = high - low
    at = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width - low, width)
    return (np.repeat(a, width) << 32) | b[at], np.repeat(np.arange(len(a)), width)


_FIELDS = "_row bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, pairs array<bigint>, times array<int>"


def aligned(documents: DataFrame, bpe_path: str, piece_path: str) -> DataFrame:
    """Per row of (doc_id, text): tokens and groups, and its distinct linked id pairs with their numbers.

    ``(doc_id, _row, n_a, n_b, n_groups, groups_sha256, pairs, times)``; pairs are ``a << 32 | b``. Null
    and empty texts, and those that a tokenizer does not give back byte by byte, have no tokens.
    """
    key = documents.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                counts, digests, found = _encoders(bpe_path, piece_path).rows([t or "" for t in piece.column("text").to_pylist()])
                columns = [*(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string())]
                offsets = pa.array(np.cumsum([0, *(len(p) for p, _ in found)], dtype=np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).astype(k))) for x, k in zip(zip(*found), ("i8", "i4"))]
                names = ["doc_id", "_row", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("_row"), *columns, *lists], names)

    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("_row"))
    return rows.mapInArrow(run, f"doc_id {key}, {_FIELDS}")


def pair_counts(rows: DataFrame) -> DataFrame:
    """``(pair, n, best)``: in how many rows a pair is linked, and whether no pair of its first id is in more."""

    def add_up(batches):
        held, size = [], 0

        def out():
            pairs, at = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            n = np.bincount(at, np.concatenate([c for _, c in held]), len(pairs)).astype(np.int64)
            return pairs, n

        for batch in batches:
            pairs = batch.column("pairs").flatten().to_numpy(zero_copy_only=False)
            held.append((pairs, np.ones(len(pairs))))
            size += len(pairs)
            if size >= HELD_LINKS:
                held = [out()]
                if len(held[0][0]) * 2 > HELD_LINKS:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, held[0])), ["pair", "n"])
                    held = []
                size = len(held[0][0]) if held else 0
        if held:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, out())), ["pair", "n"])

    counts = rows.select("pairs").mapInArrow(add_up, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    return counts.withColumn("a", F.shiftright("pair", 32).cast("int"))


def align(
    documents: DataFrame, bpe_path: str, piece_path: str, broadcast_pairs: int = BROADCAST_PAIRS
) -> DataFrame:
    """Per row of (doc_id, text) the groups of tokens of two tokenizers and how common their links are.

    ``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``. Two tokens are linked
    if their group, the shortest stretch of bytes at whose ends tokens of both end, is the same. The
    count of an id pair is the number of rows that have it linked; ``n_best`` are the links whose count
    is the highest of their first id, ``count_sum`` adds up the counts of all links. Repeated rows count
    each; rows of null, empty or unfaithfully encoded texts have zeros and an empty ``groups_sha256``.
    Other columns are ignored. A text is encoded in one piece, in memory in proportion to it.
    """
    spark = documents.sparkSession
    folder = working_folder(spark, "alignment")
    aligned(documents, bpe_path, piece_path).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    pair_counts(rows).write.parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # one row per id of the first tokenizer
    counts = counts.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))

    # how many pairs there are with counts from 1, 2, 4, 8, ... on: at most 64 numbers
    levels = counts.groupBy((F.length(F.bin("n")) - 1).alias("level")).count().collect()
    least, room = 64, broadcast_pairs
    for level, size in sorted(levels, reverse=True):
        if size > room:
            break
        least, room = level, room - size
    common = F.col("n") >= F.lit(1 << min(least, 62))
    head = counts.where(common).toArrow() if levels else None
    rare = bool(levels) and least > min(level for level, _ in levels)
    arrays = [head.column(c).to_numpy() for c in ("pair", "n", "best")] if head is not None else [_NOTHING] * 3
    order = np.argsort(arrays[0])
    shared = spark.sparkContext.broadcast([np.ascontiguousarray(x[order]) for x in arrays])
    key = documents.schema["doc_id"].dataType.simpleString()

    def look_up(batches):
        known, n, best = shared.value
        for batch in batches:
            lists, times = batch.column("pairs"), batch.column("times").flatten().to_numpy(zero_copy_only=False)
            pairs = lists.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            at = np.minimum(np.searchsorted(known, pairs), max(0, len(known) - 1))
            found = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            of, often, at = row[found], times[found].astype(np.int64), at[found]

            def total(values, of=of, size=batch.num_rows):
                out = np.zeros(size, np.int64)
                np.add.at(out, of, values)
                return out

            links_ = np.zeros(batch.num_rows, np.int64)
            np.add.at(links_, row, times)
            columns = [links_, total(often * best[at]), total(often * n[at])]
            left = np.bincount(row[~found], minlength=batch.num_rows)
            offsets = pa.array(np.concatenate(([0], np.cumsum(left))).astype(np.int32))
            rest = [pa.ListArray.from_arrays(offsets, pa.array(x[~found])) for x in (pairs, times)]
            kept = [batch.column(c) for c in ("doc_id", "_row", "n_a", "n_b", "n_groups", "groups_sha256")]
            yield pa.RecordBatch.from_arrays(
                [*kept, *map(pa.array, columns), *rest],
                ["doc_id", "_row", "n_a", "n_b", "n_groups", "groups_sha256", "n_links", "n_best", "count_sum", "pairs", "times"],
            )

    fields = f"doc_id {key}, _row bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, n_links bigint, n_best bigint, count_sum bigint"
    result = rows.mapInArrow(look_up, f"{fields}, pairs array<bigint>, times array<int>")
    if rare:
        tail = result.select("_row", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), "times")))
        more = tail.join(counts.where(~common), "pair").groupBy("_row").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum")
        )
        result = result.drop("pairs", "times").join(more, "_row", "left").withColumns(
            {
                "n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)),
                "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0)),
            }
        )
    return result.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
