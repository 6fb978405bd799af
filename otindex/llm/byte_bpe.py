"""Byte-level BPE: encode whole texts by a rank file, and decode ids back to bytes.

A text longer than a chunk is cut into chunks that overlap. Each chunk is split into pre-tokens on
its own, wherever a task has room, starting at its own first character, which may lie inside a
pre-token. In the overlap of two neighbours the scans usually meet: from the first boundary that
both found they agree, because a scan depends only on the text after the place it stands at. That
boundary cuts the pieces, and every piece is then encoded on its own. Where two scans do not meet
within the overlap (thousands of letters without a break), the text is scanned as a whole instead.

Only chunks of long texts are shuffled, keyed by the digest of the text, so that copies of one long
text are encoded once and a long text never sits in one task.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from otindex.llm.bytes_ import pieces

#: Characters of a chunk and of the overlap with the next one.
CHUNK, OVERLAP = 1 << 16, 1 << 10

#: At a chunk's right end the last characters may still join a pre-token: the longest contraction,
#: and one character of lookahead.
EDGE = 4

#: Distinct pre-tokens remembered by a task, and characters of the longest one.
REMEMBERED, LONGEST = 200_000, 64


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file: a line holds the token in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Encoder(dict):
    """Encodes pre-tokens by ranks; as a dictionary it holds the ids of a bounded number of them.

    Ids are kept as little-endian 32-bit numbers, ready to be joined into an Arrow buffer.
    """

    def __init__(self, pattern: str, ranks: dict[bytes, int]):
        import regex
        import tiktoken

        self.scan = regex.compile(pattern)
        self.encoding = ranks and tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
        )

    def __missing__(self, token: str) -> bytes:
        ids = array("i", self.encoding._encode_single_piece(token)).tobytes()
        if len(token) <= LONGEST and len(self) < REMEMBERED:
            self[token] = ids
        return ids

    def ids(self, pre_tokens: list[str]) -> bytes:
        """The ids of consecutive pre-tokens."""
        if len(self) >= REMEMBERED:
            self.clear()
        return b"".join(map(self.__getitem__, pre_tokens))

    def boundaries(self, text: str, low: int, high: int, first: int, last: bool) -> list[int]:
        """Boundaries in [low, high) of a scan from the start of ``text``, shifted by ``first``.

        Those too near to the end of a chunk that is not the last are left out.
        """
        high = high if last else min(high, len(text) - EDGE)
        out, at = [0] if low <= 0 < high else [], 0
        for match in self.scan.finditer(text):
            at = match.end()
            if at >= high:
                break
            if at >= low:
                out.append(at)
        return [first + x for x in out]


def _rows(names, types, columns):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _id_lists(rows: list[bytes]) -> pa.Array:
    """Rows of joined ids as an Arrow list column."""
    offsets = np.cumsum([0, *(len(r) // 4 for r in rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), np.int32)))


def _rows_and_short(documents: DataFrame, chunk: int):
    """(doc_id, text), and whether a text is encoded in its own row."""
    return documents.select(F.col("doc_id").cast("long"), "text"), F.coalesce(F.length("text"), F.lit(0)) <= chunk


def _short_encoder(ranks_path: str, pattern: str):
    def encode_short(batches):
        code = None
        for batch in batches:
            code = code or Encoder(pattern, load_ranks(ranks_path))
            for piece in pieces(batch, "text"):
                ids = [code.ids(code.scan.findall(t)) if t else b"" for t in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), _id_lists(ids)], ["doc_id", "ids"])

    return encode_short


def encode(
    documents: DataFrame, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Encode (doc_id, text): ids of short texts, holders of long texts, and ids of their pieces.

    Returns (doc_id, ids) for texts of at most ``chunk`` characters, and for the others (doc_id, key)
    and (key, piece, ids), where the ids of a key's pieces follow each other. Every row of
    ``documents`` counts, repeated or not; a null text is empty and has no ids. Other columns are
    ignored. ``ranks_path`` is read by each Python worker and must exist on every executor.
    """
    rows, short = _rows_and_short(documents, chunk)
    short_ids = rows.where(short).mapInArrow(_short_encoder(ranks_path, pattern), "doc_id bigint, ids array<int>")

    def cut(batches):
        for batch in batches:
            for text in batch.column("text").to_pylist():
                key, starts = hashlib.sha256(text.encode()).hexdigest(), range(0, len(text), chunk)
                yield _rows(
                    ["key", "piece", "pieces", "text"],
                    [pa.string(), pa.int32(), pa.int32(), pa.string()],
                    [
                        [key] * len(starts),
                        range(len(starts)),
                        [len(starts)] * len(starts),
                        [text[at : at + chunk + overlap] for at in starts],
                    ],
                )

    long_rows = rows.where(~short)
    holders = long_rows.select("doc_id", F.sha2("text", 256).alias("key"))
    chunks = (
        long_rows.select("text")
        .mapInArrow(cut, "key string, piece int, pieces int, text string")
        .dropDuplicates(["key", "piece"])
    )

    def scan(batches):
        code = None
        for batch in batches:
            code = code or Encoder(pattern, {})
            left, right = [], []
            for r in batch.select(["piece", "pieces", "text"]).to_pylist():
                first, last = r["piece"] * chunk, r["piece"] == r["pieces"] - 1
                ends = last or len(r["text"]) < chunk + overlap
                left.append(code.boundaries(r["text"], 0, overlap, first, ends))
                right.append([] if last else code.boundaries(r["text"], chunk, chunk + overlap, first, ends))
            marks = pa.list_(pa.int64())
            yield _rows(
                ["key", "piece", "pieces", "left", "right"],
                [pa.string(), pa.int32(), pa.int32(), marks, marks],
                [*(batch.column(c) for c in ("key", "piece", "pieces")), left, right],
            )

    by_text = Window.partitionBy("key").orderBy("piece")
    meet = F.array_min(F.array_intersect(F.lag("right").over(by_text), F.col("left")))
    cuts = (
        chunks.mapInArrow(scan, "key string, piece int, pieces int, left array<bigint>, right array<bigint>")
        .withColumn("start", F.when(F.col("piece") == 0, F.lit(0).cast("long")).otherwise(meet))
        .withColumn("stop", F.lead("start").over(by_text))
        .withColumn("met", F.count("start").over(Window.partitionBy("key")) == F.col("pieces"))
        .select("key", "piece", "met", *((F.col(c) - F.col("piece") * chunk).alias(c) for c in ("start", "stop")))
    )
    parts = (
        chunks.select("key", "piece", "text")
        .join(cuts.where("met").drop("met"), ["key", "piece"])
        .select("key", "piece", "text", "start", "stop")
    )

    # Scans that never met: the whole text as one piece.
    apart = cuts.where(~F.col("met")).select("key").distinct()
    nothing = F.lit(None).cast("long")
    entire = (
        long_rows.withColumn("key", F.sha2("text", 256))
        .join(apart, "key", "left_semi")
        .dropDuplicates(["key"])
        .select("key", F.lit(0).alias("piece"), "text", F.lit(0).cast("long").alias("start"), nothing.alias("stop"))
    )

    def encode_pieces(batches):
        code = None
        for batch in batches:
            code, ids = code or Encoder(pattern, load_ranks(ranks_path)), []
            for r in batch.select(["text", "start", "stop"]).to_pylist():
                tokens, at = [], r["start"]
                for match in code.scan.finditer(r["text"], at):
                    if r["stop"] is not None and match.start() >= r["stop"]:
                        break
                    tokens.append(match[0])
                ids.append(code.ids(tokens))
            columns = [batch.column("key"), batch.column("piece"), _id_lists(ids)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "piece", "ids"])

    long_ids = parts.unionByName(entire).mapInArrow(encode_pieces, "key string, piece int, ids array<int>")
    return short_ids, holders, long_ids


_DIGEST = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def digest(ids: DataFrame, ranks_path: str, keys: list[str], order: str | None = None) -> DataFrame:
    """Decode ids and digest them: ``keys`` plus n_tokens, ids_sha256, decoded_sha256.

    With ``order``, consecutive rows of equal keys are pieces of one text; they stream by in order.
    Without it every row is a text of its own.
    """
    schema = ids.select(*keys).schema
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    if order is not None:
        ids = ids.repartition(*keys).sortWithinPartitions(*keys, order)
    return ids.select(*keys, "ids").mapInArrow(_digester(ranks_path, keys, order), f"{fields}, {_DIGEST}")


def _digester(ranks_path: str, keys: list[str], order: str | None = None):
    def run(batches):
        table, names, now, state = [], [], None, None

        def row(key, s):
            return (*key, s[0], s[1].hexdigest(), s[2].hexdigest())

        out_names = [*keys, "n_tokens", "ids_sha256", "decoded_sha256"]
        kinds = [pa.int64(), pa.string(), pa.string()]

        def output(batch_schema, found):
            columns = list(zip(*found, strict=True)) or [[]] * len(out_names)
            return _rows(out_names, [*(batch_schema.field(k).type for k in keys), *kinds], columns)

        arrow_schema = None
        for batch in batches:
            if not table:
                table = [t for t, _ in sorted(load_ranks(ranks_path).items(), key=lambda x: x[1])]
                names = [str(i) for i in range(len(table))]
            arrow_schema, found = batch.schema, []
            key_rows = zip(*(batch.column(k).to_pylist() for k in keys), strict=True)
            values, offsets = batch.column("ids").values.to_numpy(), batch.column("ids").offsets.to_pylist()
            for at, key in enumerate(key_rows):
                piece = values[offsets[at] : offsets[at + 1]].tolist()
                if state is None or order is None or key != now:
                    if state is not None:
                        found.append(row(now, state))
                    now, state = key, [0, hashlib.sha256(), hashlib.sha256()]
                if piece:
                    text = " ".join(map(names.__getitem__, piece))
                    state[1].update((" " + text if state[0] else text).encode())
                    state[2].update(b"".join(map(table.__getitem__, piece)))
                    state[0] += len(piece)
            yield output(arrow_schema, found)
        if state is not None:
            yield output(arrow_schema, [row(now, state)])
        pa.default_memory_pool().release_unused()

    return run


def encode_documents(
    documents: DataFrame, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """Encode, decode again and digest every document: (doc_id, n_tokens, ids_sha256, decoded_sha256).

    One row per row of ``documents``. ids_sha256 is over decimal ids joined by one space,
    decoded_sha256 over the bytes that the ids decode to.
    """
    _, holders, long_ids = encode(documents, ranks_path, pattern, chunk, overlap)
    rows, is_short = _rows_and_short(documents, chunk)
    encoder, digester = _short_encoder(ranks_path, pattern), _digester(ranks_path, ["doc_id"])
    # one Python worker encodes and digests
    short = rows.where(is_short).mapInArrow(lambda batches: digester(encoder(batches)), f"doc_id bigint, {_DIGEST}")
    long = digest(long_ids, ranks_path, ["key"], order="piece")
    return short.unionByName(holders.join(long, "key").drop("key"))
