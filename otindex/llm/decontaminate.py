"""Benchmark decontamination: find benchmark passages in training documents and remove them.

The windows (``n`` consecutive normalised words, or all words of a shorter item) of the benchmark
form a hash set that every task holds. Its size is measured first: beyond ``BLOCK_BYTES`` the windows
are dealt into blocks by hash and the documents are scanned once per block, so no task ever holds
more than one block. A scan works on about a megabyte of text at a time in numpy: word spans, a hash
per word, a hash per window, a bitmap test, and for the few windows left an exact comparison of words.
Documents are not shuffled, except by digest to merge several blocks, so copies and hot sources
are no burden. A single long document takes about three times its bytes.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from otindex.llm.bytes_ import as_bytes, pieces, spans, window_hashes, word_hashes
from otindex.llm.columns import fresh, quoted, set_aside
from otindex.session import materialize

#: Bytes of windows and item ids in one broadcast block.
BLOCK_BYTES = 32 << 20

#: Bits of the window hash that index the bitmap.
_BITMAP = 20

_FOLDED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IS_WORD = np.array([b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 for b in range(256)])
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def benchmark_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """Distinct (words, item): every window of every item, its words joined by spaces."""

    def cut(batches):
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), as_bytes(batch.column("text")).to_pylist()):
                words = _WORD.findall(text.translate(_FOLDED))
                size = min(n, len(words))
                windows = {b" ".join(words[k : k + size]).decode() for k in range(len(words) - size + 1)} if size else ()
                if windows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(windows), pa.string()), pa.array([item] * len(windows), pa.string())],
                        ["words", "item"],
                    )

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return items.mapInArrow(cut, "words string, item string").distinct()


class Windows:
    """The hash set of one block: a bitmap in front of the exact windows."""

    def __init__(self, rows: list[tuple[str, list[str]]]):
        self.items = {words.encode(): items for words, items in rows}
        by_size: dict[int, list[bytes]] = {}
        for words in self.items:
            by_size.setdefault(words.count(b" ") + 1, []).append(words)
        self.bitmaps = {}
        for size, windows in by_size.items():
            data = np.frombuffer(b" ".join(windows), np.uint8)
            hashes = word_hashes(data, *spans(_IS_WORD[data]))
            bitmap = np.zeros(1 << _BITMAP, bool)
            bitmap[window_hashes(hashes, size)[::size] >> np.uint64(64 - _BITMAP)] = True
            self.bitmaps[size] = bitmap

    def scan(self, texts: list[bytes]) -> tuple[list, list, list, list]:
        """Per text: words, hit words, byte spans of the runs of hit words, and items."""
        raw = b"\n".join(texts).translate(_FOLDED)
        data = np.frombuffer(raw, np.uint8)
        starts, ends = spans(_IS_WORD[data])
        first = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        bounds = np.searchsorted(starts, first)  # the words of text k are bounds[k] to bounds[k + 1]
        hashes = word_hashes(data, starts, ends)
        of = np.repeat(np.arange(len(texts)), np.diff(bounds))
        change = np.zeros(len(starts) + 1, np.int64)
        items: dict[int, set[str]] = {}
        for size, bitmap in self.bitmaps.items():
            maybe = np.flatnonzero(bitmap[window_hashes(hashes, size) >> np.uint64(64 - _BITMAP)])
            maybe = maybe[of[maybe] == of[maybe + size - 1]]
            for k in maybe.tolist():
                words = b" ".join([raw[a:b] for a, b in zip(starts[k : k + size].tolist(), ends[k : k + size].tolist())])
                found = self.items.get(words)
                if found is not None:
                    change[k] += 1
                    change[k + size] -= 1
                    items.setdefault(int(of[k]), set()).update(found)
        hit = np.cumsum(change[:-1]) > 0
        n_hit, runs = [0] * len(texts), [[] for _ in texts]
        for t in items:
            low, high = bounds[t], bounds[t + 1]
            n_hit[t] = int(hit[low:high].sum())
            for a, b in zip(*spans(hit[low:high]), strict=True):
                runs[t].append((int(starts[low + a] - first[t]), int(ends[low + b - 1] - first[t])))
        return np.diff(bounds).tolist(), n_hit, runs, [sorted(items.get(t, ())) for t in range(len(texts))]


_SPANS = "array<struct<start:int,stop:int>>"


def _scan(documents: DataFrame, rows: list[tuple[str, list[str]]], carried: list[str], hits_only: bool) -> DataFrame:
    """``carried`` columns plus n_words, n_hit, spans and items against one block."""
    block = documents.sparkSession.sparkContext.broadcast(rows)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*map(quoted, carried)).schema]
    schema = ", ".join([*fields, "n_words bigint", "n_hit bigint", f"spans {_SPANS}", "items array<string>"])
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])), pa.list_(pa.string())]

    def run(batches):
        windows = None
        for batch in batches:
            windows = windows or Windows(block.value)
            for piece in pieces(batch, "text"):
                found = windows.scan(as_bytes(piece.column("text")).to_pylist())
                runs = [[{"start": a, "stop": b} for a, b in r] for r in found[2]]
                columns = [pa.array(c, t) for c, t in zip((found[0], found[1], runs, found[3]), kinds, strict=True)]
                out = pa.RecordBatch.from_arrays(
                    [*(piece.column(c) for c in carried), *columns], [*carried, "n_words", "n_hit", "spans", "items"]
                )
                yield out.filter(pa.array([x > 0 for x in found[1]])) if hits_only else out

    return documents.select(*map(quoted, dict.fromkeys([*carried, "text"]))).mapInArrow(run, schema)


ADDED = ("n_words", "n_hit", "spans", "items")


def find_leaks(
    documents: DataFrame, benchmark: DataFrame, n: int = 10, keep_text: bool = True, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The documents with n_words, n_hit, spans (byte ranges of runs of hit words) and items.

    Words are runs of digits, letters a-z (A-Z lower-cased) and non-ASCII characters. A document word
    inside any occurrence of a window is hit. Null texts have no words; a null item_id counts as the
    id ''; items that share an id are one item; repeated documents stay. Columns of ``documents``
    with the names of the added ones are replaced. An empty benchmark hits nothing.
    """
    windows = materialize(
        benchmark_windows(benchmark, n).groupBy("words").agg(F.collect_set("item").alias("items"))
    )
    size = windows.agg(
        F.sum(F.octet_length("words") + F.aggregate("items", F.lit(0), lambda a, x: a + F.octet_length(x) + 16) + 64)
    ).first()[0]
    blocks = max(1, -(-(size or 0) // block_bytes))
    documents, back = set_aside(documents, ())
    carried = [c for c in documents.columns if c.lower() not in ADDED and (keep_text or c != "text")]

    def block(k: int) -> list[tuple[str, list[str]]]:
        part = windows.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == k) if blocks > 1 else windows
        return [(r["words"], r["items"]) for r in part.toLocalIterator()]

    if blocks == 1:
        return _scan(documents, block(0), carried, False).withColumnsRenamed(back)
    key = fresh(documents, "digest")
    keyed = documents.withColumn(key, F.sha2("text", 256))
    base = _scan(keyed, [], [*carried, key], False).drop("n_hit", "spans", "items")
    found = reduce(DataFrame.unionByName, [
        materialize(_scan(keyed, block(k), [key], True).dropDuplicates([key]).drop("n_hit", "n_words"))
        for k in range(blocks)
    ])
    merged = _merge(found, keyed, key)
    return base.join(merged, key, "left").select(
        *map(quoted, carried),
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("spans", F.expr(f"cast(array() as {_SPANS})")).alias("spans"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
    ).withColumnsRenamed(back)


def _merge(found: DataFrame, keyed: DataFrame, key: str) -> DataFrame:
    """Joins the spans that several blocks found in a text, and counts its hit words anew."""
    grouped = found.groupBy(key).agg(
        F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
    )
    texts = keyed.join(grouped.select(key), key, "left_semi").select(key, "text").dropDuplicates([key])

    def run(batches):
        for batch in batches:
            n_hit, spans_out = [], []
            for raw, runs in zip(as_bytes(batch.column("text")).to_pylist(), batch.column("spans").to_pylist()):
                words = [m.span() for m in _WORD.finditer(raw.translate(_FOLDED))]
                starts = np.array([a for a, _ in words])
                hit = np.zeros(len(words), bool)
                for r in runs:
                    hit[np.searchsorted(starts, r["start"]) : np.searchsorted(starts, r["stop"])] = True
                n_hit.append(int(hit.sum()))
                spans_out.append([{"start": words[a][0], "stop": words[b - 1][1]} for a, b in zip(*spans(hit))])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(n_hit, pa.int64()), pa.array(spans_out, kind), batch.column("items")],
                [key, "n_hit", "spans", "items"],
            )

    return texts.join(grouped, key).select(key, "text", "spans", "items").mapInArrow(
        run, f"`{key}` string, n_hit bigint, spans {_SPANS}, items array<string>"
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, n: int = 10, action: str = "documents") -> DataFrame:
    """``documents`` without leaked benchmark text, in their own columns.

    ``action`` 'documents' drops every document with a hit; 'spans' cuts the runs of hit words out of
    the text (what separates two runs stays). Clean documents come back unchanged.
    """
    if action not in ("documents", "spans"):
        raise ValueError(f"unknown action {action!r}")
    names = documents.columns
    kept, back = set_aside(documents, ADDED)
    found = find_leaks(kept, benchmark, n)
    if action == "documents":
        return found.where("n_hit = 0").select(*map(quoted, kept.columns)).withColumnsRenamed(back).select(*map(quoted, names))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)

    def cut(batches):
        for batch in batches:
            out = []
            for raw, runs in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                for r in reversed(runs):
                    raw = raw[: r["start"]] + raw[r["stop"] :]
                out.append(raw)
            text = pa.array(out, pa.binary()).cast(pa.string())
            columns = [text if c == "text" else batch.column(c) for c in batch.schema.names if c != "spans"]
            yield pa.RecordBatch.from_arrays(columns, [c for c in batch.schema.names if c != "spans"])

    clean = found.select(*map(quoted, kept.columns), "spans").mapInArrow(cut, fields)
    return clean.withColumnsRenamed(back).select(*map(quoted, names))
