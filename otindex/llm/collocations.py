"""Phrase collocations: frequent phrases found shard by shard, counted exactly, and scored.

Partitioned mining in two passes. Documents are dealt to a few shards by the hash of their id. A phrase
that occurs ``min_count`` times in all occurs, in at least one shard, that often times the shard's
share of the language's words, so every shard is mined completely at that lower support. The second
pass counts the phrases that were frequent somewhere over all documents.

A shard of a large corpus is no task's work, so it is mined by Spark: tasks count the phrases of a few
megabytes of text exactly (words become numbers, phrases pairs of numbers) and send, per shard and
bucket, sorted 32-bit hashes with their counts; a bucket, whose number grows with the corpus, is
added up in one task. A hash may stand for two phrases, which makes a candidate too many and never
one too few. What is frequent goes into a bit map of fixed size; the second pass leaves out what has
no bit there and adds up the rest by the phrase itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from otindex.llm.bytes_ import as_bytes, buffers, mixed, pieces, spans, word_hashes
from otindex.session import materialize, working_folder

#: Shards, bytes of text counted at a time, hashes of a bucket, and bits of the map of candidates.
SHARDS, UNIT_BYTES, BUCKET_HASHES, MAP_BITS = 4, 3 << 20, 1 << 21, 27

#: Bits of the map in one row.
_BLOCK_BITS = 16

#: Parts of a phrase whose counts are broadcast: those that are at least this share of all words.
HEAVY = 10_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _table(values: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_BREAKS, _SPACES = _table(b".,;:!?\n\x0b\x0c\r"), _table(b" \t")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Places:
    """Where the words of some texts lie: the lower-cased bytes, each word's start and end, and its row."""

    def __init__(self, column: pa.Array):
        data, offsets = buffers(as_bytes(column))
        self.data = data = _LOWER[data]
        self.breaks = _BREAKS[data]
        starts, ends = spans(~(self.breaks | _SPACES[data]))
        # a text begins like a break; a word across two texts is cut there
        inner = np.unique(offsets[1:-1])
        cut = inner[np.searchsorted(starts, inner, "left") > np.searchsorted(ends, inner, "right")]
        self.starts, self.ends = np.sort(np.concatenate((starts, cut))), np.sort(np.concatenate((ends, cut)))
        self.row = np.searchsorted(offsets, self.starts, "right") - 1


class Unit:
    """The words of some texts: their numbers, the piece that each lies in, and their row.

    Words are numbered by the distinct words ``names``, exactly; ``hashes`` belong to those.
    """

    def __init__(self, column: pa.Array):
        places = Places(column)
        starts, sizes = places.starts, places.ends - places.starts
        self.row = places.row
        self.piece = np.cumsum(places.breaks, dtype=np.int32)[starts] + self.row if len(starts) else starts
        where = np.concatenate(([0], np.cumsum(sizes)))
        words = places.data[np.repeat(starts - where[:-1], sizes) + np.arange(where[-1])]
        joined = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(where), pa.py_buffer(words)])
        coded = joined.dictionary_encode()
        self.names = coded.dictionary
        self.word = coded.indices.to_numpy().astype(np.int64)
        name_data, name_offsets = buffers(self.names)
        self.hashes = word_hashes(name_data, name_offsets[:-1], name_offsets[1:])

    def phrases(self, group: np.ndarray, seeds: np.ndarray, size: int):
        """Per length the distinct phrases of each group: (group, words as columns, hash, count).

        ``group`` numbers the texts' groups, ``seeds`` tells the hashes of groups apart.
        """
        of, count = group[self.row], len(self.names)
        code, at = of * count + self.word, np.arange(len(self.word))
        columns, keys = [], None
        for k in range(1, size + 1):
            if k > 1:
                # a phrase goes on where the next word lies in the same piece
                more = (at + k - 1 < len(self.word)) & (self.piece[at] == self.piece[np.minimum(at + k - 1, len(self.word) - 1)])
                at = at[more]
                code = number[more] * count + self.word[at + k - 1]
            if not len(code):
                return
            distinct, number, times = np.unique(code, return_inverse=True, return_counts=True)
            before, last = distinct // count, distinct % count
            if k == 1:
                keys, columns = before, [last]
                hashed = mixed(self.hashes[last] ^ seeds[keys])
            else:
                keys, columns = keys[before], [*(c[before] for c in columns), last]
                hashed = mixed(hashed[before] * _ODD + self.hashes[last])
            yield keys, columns, hashed, times

    def texts(self, columns: list[np.ndarray]) -> pa.Array:
        """Phrases as text, words joined by one space."""
        words = [self.names.take(pa.array(c)) for c in columns]
        return pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.large_binary())).cast(pa.large_string())


def _seeds(names: list[str]) -> np.ndarray:
    data, offsets = buffers(as_bytes(pa.array(names, pa.string())))
    return word_hashes(data, offsets[:-1], offsets[1:])


def _units(batches):
    """Units of text with their languages and shards as Python lists; none without text."""
    for batch in batches:
        for piece in pieces(batch, "text", UNIT_BYTES):
            yield piece.column("text"), piece.column("lang").to_pylist(), piece.column("shard").to_pylist()


def _grouped(keys: list) -> tuple[list, np.ndarray]:
    """The distinct keys and the place of each row's key among them."""
    places = {k: at for at, k in enumerate(dict.fromkeys(keys))}
    return list(places), np.array([places[k] for k in keys], np.int64)


def word_totals(rows: DataFrame) -> DataFrame:
    """``(lang, shard, n)``: all words of (lang, shard, text)."""

    def count(batches):
        for texts, langs, shards in _units(batches):
            groups, of = _grouped(list(zip(langs, shards, strict=True)))
            n = np.bincount(of[Places(texts).row], minlength=len(groups)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*zip(*groups, strict=True), n)], ["lang", "shard", "n"])

    return rows.mapInArrow(count, "lang string, shard bigint, n bigint").groupBy("lang", "shard").agg(F.sum("n").alias("n"))


def candidate_bits(rows: DataFrame, support: dict[tuple[str, int], int], size: int, bucket_bits: int) -> DataFrame:
    """``(block, bits)``: the map of the hashes that are frequent enough in at least one shard.

    ``support`` is the least count per language and shard.
    """
    top = max(support.values(), default=1)
    kind = np.dtype("u1") if top < 256 else np.dtype("<u4")

    def mine(batches):
        for texts, langs, shards in _units(batches):
            groups, of = _grouped(list(zip(langs, shards, strict=True)))
            seeds = _seeds([lang for lang, _ in groups])
            parts = [(g, h, np.minimum(n, top)) for g, _, h, n in Unit(texts).phrases(of, seeds, size)]
            if not parts:
                continue
            group, hashed, times = (np.concatenate(x) for x in zip(*parts))
            bucket = (hashed >> np.uint64(64 - bucket_bits)).astype(np.int64) if bucket_bits else np.zeros(len(hashed), np.int64)
            order = np.lexsort((hashed, group))
            group, bucket = group[order], bucket[order]
            low = (hashed[order] >> np.uint64(32 - bucket_bits)).astype("<u4")
            counts = times[order].astype(kind)
            cuts = np.flatnonzero((group[1:] != group[:-1]) | (bucket[1:] != bucket[:-1])) + 1
            at = np.concatenate(([0], cuts, [len(group)]))
            first = group[at[:-1]].tolist()
            lists = [[x[i:j].tobytes() for i, j in zip(at.tolist(), at[1:].tolist())] for x in (low, counts)]
            columns = [[groups[g][0] for g in first], [groups[g][1] for g in first], bucket[at[:-1]], *lists]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
                ["lang", "shard", "bucket", "hashes", "counts"],
            )

    def add_up(key, table):
        lang, shard, bucket = (k.as_py() for k in key)
        low, counts = (
            np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("hashes", "<u4"), ("counts", kind))
        )
        order = np.argsort(low)
        low = low[order]
        first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
        often = np.add.reduceat(counts[order].astype(np.int64), first) >= support[lang, shard]
        places = ((np.uint64(bucket) << np.uint64(32)) | low[first[often]].astype(np.uint64)) >> np.uint64(32 + bucket_bits - MAP_BITS)
        return pa.table({"place": np.unique(places).astype(np.int64)})

    def set_bits(key, table):
        bits = np.zeros(1 << _BLOCK_BITS, bool)
        bits[table.column("place").to_numpy() & ((1 << _BLOCK_BITS) - 1)] = True
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    mined = rows.mapInArrow(mine, "lang string, shard bigint, bucket bigint, hashes binary, counts binary")
    places = mined.groupBy("lang", "shard", "bucket").applyInArrow(add_up, "place bigint").distinct()
    return places.groupBy(F.shiftright("place", _BLOCK_BITS).alias("block")).applyInArrow(set_bits, "block bigint, bits binary")


def exact_counts(rows: DataFrame, bits: DataFrame, size: int, min_count: int) -> DataFrame:
    """``(lang, k, phrase, f)`` of all phrases that occur ``min_count`` times, counted over all rows."""
    table = bits.toArrow()  # at most 2**27 bits
    flags = np.zeros((1 << (MAP_BITS - _BLOCK_BITS), 1 << (_BLOCK_BITS - 3)), np.uint8)
    for block, row in zip(table.column("block").to_pylist(), table.column("bits").to_pylist(), strict=True):
        flags[block] = np.frombuffer(row, np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(flags.ravel())

    def count(batches):
        known = shared.value
        for texts, langs, _ in _units(batches):
            groups, of = _grouped(langs)
            unit = Unit(texts)
            for k, (group, words, hashed, times) in enumerate(unit.phrases(of, _seeds(groups), size), 1):
                place = hashed >> np.uint64(64 - MAP_BITS)
                found = np.flatnonzero(known[place >> np.uint64(3)] >> (np.uint8(7) - (place & np.uint64(7)).astype(np.uint8)) & 1)
                if len(found):
                    langs_ = pa.array(groups, pa.string()).take(pa.array(group[found]))
                    phrases = unit.texts([w[found] for w in words]).cast(pa.string())
                    columns = [langs_, pa.array(np.full(len(found), k, np.int32)), phrases, pa.array(times[found].astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "k", "phrase", "f"])

    counted = rows.mapInArrow(count, "lang string, k int, phrase string, f bigint")
    return counted.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count)


def _count_of(rows: DataFrame, heavy: DataFrame, light: DataFrame, name: str, out: str) -> DataFrame:
    """Add the count of the phrase in column ``name``. Parts of many phrases are among the ``heavy`` ones,
    of which there are few; the others are joined by a shuffle."""
    near = rows.join(
        F.broadcast(heavy.select(F.col("lang").alias("lang"), F.col("phrase").alias(name), F.col("f").alias("_f"))), ["lang", name], "left"
    )
    known = near.where("_f is not null").withColumnRenamed("_f", out)
    rest = near.where("_f is null").drop("_f").join(light.select("lang", F.col("phrase").alias(name), F.col("f").alias(out)), ["lang", name])
    return known.unionByName(rest)


def _words(column: str, first, count) -> Column:
    return F.array_join(F.slice(F.split(column, " "), first, count), " ")


def collocations(
    documents: DataFrame, size: int = 3, min_count: int = 10, top: int = 2000, share: int = 50, shards: int = SHARDS
) -> DataFrame:
    """The best ``top`` phrases of 2 to ``size`` words per language of (doc_id, lang, text).

    ``(lang, rank, phrase, a, l, r, n, score)``: the phrase's count, those of its two parts at the cut
    that scores least, the language's words, and floor(1e6 a a / (l r)), computed with 38 digits.
    A phrase lies within a piece, between two of ``.,;:!?`` and line ends, and occurs ``min_count``
    times; one inside a longer phrase with at least ``share`` percent of its count is dropped. Ties are
    broken by count and phrase. A null language is ``und``, a null text empty; repeated rows count each;
    other columns are ignored. A text longer than 3 MB is counted in one piece, in memory of some twenty times its
    size.
    """
    spark = documents.sparkSession
    rows = documents.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"),
        F.col("text").cast("string").alias("text"),
    )
    totals = materialize(word_totals(rows))
    sizes = {(r.lang, r.shard): r.n for r in totals.collect()}  # languages times shards
    of_lang: dict[str, int] = {}
    for (lang, _), n in sizes.items():
        of_lang[lang] = of_lang.get(lang, 0) + n
    support = {(lang, shard): max(1, -(-min_count * n // max(1, of_lang[lang]))) for (lang, shard), n in sizes.items()}
    hashes = size * sum(of_lang.values()) // shards
    bucket_bits = min(24, max(0, (hashes // BUCKET_HASHES).bit_length()))

    folder = working_folder(spark, "phrases")
    exact_counts(rows, candidate_bits(rows, support, size, bucket_bits), size, min_count).write.parquet(folder)
    counts = spark.read.parquet(folder)
    heavy_from = F.lit(max(1, sum(of_lang.values()) // HEAVY))
    heavy, light = counts.where(F.col("f") >= heavy_from), counts.where(F.col("f") < heavy_from)

    phrases = counts.where("k > 1").select("lang", "k", "phrase", F.col("f").alias("a"))
    cut = phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cut = cut.withColumn("left", _words("phrase", 1, F.col("cut"))).withColumn("right", _words("phrase", F.col("cut") + 1, F.col("k") - F.col("cut")))
    cut = _count_of(_count_of(cut, heavy, light, "left", "l"), heavy, light, "right", "r")
    wide = "cast({} as decimal(16, 0))".format
    score = F.expr(f"(cast(1000000 as decimal(7, 0)) * ({wide('a')} * {wide('a')})) div ({wide('l')} * {wide('r')})")
    best = cut.withColumn("score", score).groupBy("lang", "phrase", "k", "a").agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("best")
    )
    inner = phrases.where("k > 2").select(
        "lang", "a", F.explode(F.flatten(F.transform(
            F.sequence(F.lit(2), F.col("k") - 1),
            lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda at: F.array_join(F.slice(F.split("phrase", " "), at, m), " ")),
        ))).alias("phrase"),
    ).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True)))
    kept = kept.select("lang", "phrase", "a", "best.l", "best.r", "best.score")

    # first the best of a part of a language's phrases, then the best of those
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    ahead = kept.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    ranked = ahead.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    n = totals.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(F.broadcast(n), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
