"""From dated documents to word distributions.

A document is one row, so everything about a single document (its words, its word counts, its
length) is computed inside that row and needs no shuffle. Only statistics over the corpus, and
the merge of out-of-vocabulary words, exchange data.

Arrays are opened with the outer generators and a null filter: for the plain ones the optimizer
adds a filter on the array's size, which would split and sort every text a second time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from otindex.functions import text as tx
from otindex.functions.stopwords import ENGLISH
from otindex.session import BROADCAST_ROWS, SALTS, at_most, broadcast_if_small, made_in_tasks, materialize, read_in_tasks, with_positions


#: Numbers of dense count vectors that a task makes at a time.
DENSE_VALUES = 2_000_000

#: Tokens that a task counts at a time, but a document is counted whole.
PIECE_TOKENS = 2_000_000

#: Words up to which a vocabulary travels to every task that counts documents.
LOOKUP_WORDS = 4_000_000


def tokenize(corpus: DataFrame, text: str = "text", out: str = "tokens") -> DataFrame:
    """Replace the text column by the array of its words."""
    return corpus.withColumn(out, tx.words(F.col(text))).drop(text)


def remove_stopwords(
    tokenized: DataFrame, words: Sequence[str] = ENGLISH, tokens: str = "tokens"
) -> DataFrame:
    """Drop stop words from every token array."""
    return tokenized.withColumn(tokens, tx.without(F.col(tokens), words))


def explode_tokens(tokenized: DataFrame) -> DataFrame:
    """One row ``(doc_id, pos, token)`` per word occurrence."""
    return tokenized.select("doc_id", F.posexplode_outer("tokens").alias("pos", "token")).where(
        "token is not null"
    )


def _batch_pieces(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of whole documents with their numbers of tokens, of at most ``PIECE_TOKENS`` or one document."""
    sizes = pc.fill_null(pc.list_value_length(batch.column("tokens")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        done = ends[at] - sizes[at]
        to = max(at + 1, int(np.searchsorted(ends, done + PIECE_TOKENS, side="right")))
        yield batch.slice(at, to - at), sizes[at:to]
        at = to


def _encoded(piece: pa.RecordBatch, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Per token its row, the place of its word, and the distinct words; tokens that are null are left out."""
    words = piece.column("tokens").flatten().dictionary_encode()
    row, code = np.repeat(np.arange(len(sizes)), sizes), words.indices
    if code.null_count:
        there = code.is_valid().to_numpy(zero_copy_only=False)
        row, code = row[there], code.drop_null()
    return row, code.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary


def _runs(row: np.ndarray, code: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of row and code (below ``size``) and how often each occurs."""
    key = row * max(1, size) + code
    key.sort()
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    starts = np.flatnonzero(first)
    return *np.divmod(key[starts], max(1, size)), np.diff(np.append(starts, len(key)))


def word_counts(tokenized: DataFrame) -> DataFrame:
    """``(doc_id, n_tokens, word, count)``: term frequencies, computed without a shuffle.

    Arrow batches of documents are counted by the numbers of their words, a bounded piece at a time.
    """

    def run(batches):
        for batch in batches:
            for piece, sizes in _batch_pieces(batch):
                row, code, words = _encoded(piece, sizes)
                row, code, count = _runs(row, code, len(words))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id").take(pa.array(row)), pa.array(sizes[row]), words.take(pa.array(code)), pa.array(count)],
                    ["doc_id", "n_tokens", "word", "count"],
                )

    key = tokenized.schema["doc_id"].dataType.simpleString()
    return tokenized.select("doc_id", "tokens").mapInArrow(run, f"doc_id {key}, n_tokens bigint, word string, count bigint")


def build_vocabulary(tokenized: DataFrame, min_count: int = 5) -> DataFrame:
    """``(word_id, word, freq)``: words seen ``min_count`` times, most frequent first.

    Counting combines on the map side, so a word that fills a third of the corpus still sends
    one row per task. Ids are dense and come from a range partitioning.
    """
    frequent = (
        tokenized.select(F.explode_outer("tokens").alias("word"))
        .where("word is not null")
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("freq"))
        .where(F.col("freq") >= min_count)
    )
    return with_positions(frequent, F.desc("freq"), F.asc("word"), name="word_id").select(
        F.col("word_id").cast("int").alias("word_id"), "word", "freq"
    )


def lookup_words(
    counts: DataFrame, vocabulary: DataFrame, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Left-join word ids onto rows with a ``word`` column.

    A vocabulary that fits is broadcast whole. A larger one is split by rank: its most frequent
    words, which carry the skew, are broadcast, and only the rare rest is joined by shuffle.
    """
    ids = vocabulary.select("word", "word_id")
    if at_most(ids, broadcast_rows):
        return counts.join(F.broadcast(ids), "word", "left")
    head = ids.where(F.col("word_id") < broadcast_rows)
    tail = ids.where(F.col("word_id") >= broadcast_rows)
    probed = counts.join(F.broadcast(head), "word", "left")
    found = probed.where(F.col("word_id").isNotNull())
    # a word outside the vocabulary may still be hot: spread its rows over salted copies of the tail
    salts = F.array([F.lit(s) for s in range(SALTS)])
    rest = probed.where(F.col("word_id").isNull()).drop("word_id")
    rest = rest.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    tail = tail.withColumn("_salt", F.explode(salts))
    return found.unionByName(rest.join(tail, ["word", "_salt"], "left").select(found.columns))


def doc_distributions(
    tokenized: DataFrame,
    vocabulary: DataFrame,
    oov: str = "bucket",
    broadcast_rows: int = LOOKUP_WORDS,
) -> DataFrame:
    """``(doc_id, word_id, p)``: share of each vocabulary word in each document.

    ``oov='bucket'`` puts unknown words into one extra id behind the last word,
    ``oov='drop'`` leaves them out of the total. Documents without words yield no rows.

    A vocabulary that fits is sent to the tasks, which read each text once and exchange nothing. A larger one,
    and documents whose id is repeated and which therefore share a total, are joined and grouped.
    """
    if oov not in ("bucket", "drop"):
        raise ValueError("oov must be 'bucket' or 'drop'")
    bucket = vocabulary.count()
    if bucket > broadcast_rows:
        return _joined_shares(tokenized, vocabulary, oov, bucket, broadcast_rows)
    repeated = materialize(tokenized.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_again")))
    if repeated.isEmpty():
        return _counted_shares(tokenized, vocabulary, oov, bucket)
    repeated = broadcast_if_small(repeated)
    same = F.col("doc_id").eqNullSafe(F.col("_again"))
    once, again = (tokenized.join(repeated, same, how) for how in ("left_anti", "left_semi"))
    return _counted_shares(once, vocabulary, oov, bucket).unionByName(
        _joined_shares(again, vocabulary, oov, bucket, broadcast_rows)
    )


def _counted_shares(tokenized: DataFrame, vocabulary: DataFrame, oov: str, bucket: int) -> DataFrame:
    """The shares of documents whose ids differ, each counted in its task by a vocabulary that is broadcast."""
    known = vocabulary.select("word", F.col("word_id").cast("int").alias("word_id")).toArrow().combine_chunks()
    ids = np.append(known.column("word_id").to_numpy().astype(np.int32), np.int32(bucket))
    shared = tokenized.sparkSession.sparkContext.broadcast((known.column("word").combine_chunks().cast(pa.string()), ids))

    def run(batches):
        words, ids = shared.value
        for batch in batches:
            for piece, sizes in _batch_pieces(batch):
                row, code, found = _encoded(piece, sizes)
                place = pc.fill_null(pc.index_in(found.cast(pa.string()), value_set=words), len(words))
                code = place.to_numpy(zero_copy_only=False).astype(np.int64)[code]
                if oov == "drop":
                    row, code = row[code < len(words)], code[code < len(words)]
                    sizes = np.bincount(row, minlength=len(sizes))
                row, code, count = _runs(row, code, len(ids))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id").take(pa.array(row)), pa.array(ids[code]), pa.array(count / sizes[row])],
                    ["doc_id", "word_id", "p"],
                )

    key = tokenized.schema["doc_id"].dataType.simpleString()
    return tokenized.select("doc_id", "tokens").mapInArrow(run, f"doc_id {key}, word_id int, p double")


def _joined_shares(tokenized: DataFrame, vocabulary: DataFrame, oov: str, bucket: int, broadcast_rows: int) -> DataFrame:
    """The shares by joins with the vocabulary and grouped sums, for any ids and vocabulary."""
    matched = lookup_words(word_counts(tokenized), vocabulary, min(broadcast_rows, BROADCAST_ROWS))
    known = F.col("word_id").isNotNull()
    if oov == "drop":
        # words are unique per document here, and a document is bounded by its one input row
        total = F.sum("count").over(Window.partitionBy("doc_id"))
        return matched.where(F.col("word_id").isNotNull()).select(
            "doc_id", "word_id", (F.col("count") / total).alias("p")
        )
    # a word stands once per document: only unknown words need a shuffle, combined before it
    share = (F.col("count") / F.col("n_tokens")).alias("p")
    unknown = matched.where(~known).groupBy("doc_id").agg(
        F.lit(bucket).cast("int").alias("word_id"), (F.sum("count") / F.max("n_tokens")).alias("p")
    )
    return matched.where(known).select("doc_id", "word_id", share).unionByName(unknown)


def count_vectors(
    tokenized: DataFrame, vocabulary: DataFrame, block_words: int = 65_536, broadcast_rows: int = LOOKUP_WORDS
) -> DataFrame:
    """``(doc_id, block, counts)``: dense counts of each document, zeros included.

    A block holds the words from ``block * block_words`` on, at most ``block_words`` of them, so no
    array grows with the vocabulary.

    A vocabulary that fits is sent to the tasks, which read each text once and exchange nothing. A larger one,
    and documents whose id is null or repeated, are joined and grouped.
    """
    size = vocabulary.count()
    if size > broadcast_rows:
        return _joined_vectors(tokenized, vocabulary, size, block_words)
    shared_id = (F.col("count") > 1) | F.col("doc_id").isNull()
    repeated = materialize(tokenized.groupBy("doc_id").count().where(shared_id).select(F.col("doc_id").alias("_again")))
    if repeated.isEmpty():
        return _counted_vectors(tokenized, vocabulary, size, block_words)
    repeated = broadcast_if_small(repeated)
    same = F.col("doc_id").eqNullSafe(F.col("_again"))
    once, again = (tokenized.join(repeated, same, how) for how in ("left_anti", "left_semi"))
    counted = _counted_vectors(once, vocabulary, size, block_words)
    joined = _joined_vectors(again, vocabulary, size, block_words)
    both = counted.unionByName(joined)
    both._made = counted._made + joined._made
    return both


def _dense_blocks(rows: DataFrame, fill) -> DataFrame:
    """The blocks that ``fill`` makes of Arrow batches of rows."""
    key = rows.schema["doc_id"].dataType.simpleString()
    return made_in_tasks(rows, fill, f"doc_id {key}, block int, counts array<bigint>")


def _dense_batch(doc_id: pa.Array, block: np.ndarray, at: np.ndarray, word: np.ndarray, count: np.ndarray, size: int, block_words: int) -> pa.RecordBatch:
    """Dense blocks from the words and counts that belong to row ``at`` of them."""
    first = block.astype(np.int64) * block_words
    offsets = np.concatenate([[0], np.cumsum(np.clip(size - first, 0, block_words))])
    dense = np.zeros(offsets[-1], np.int64)
    dense[offsets[at] + word - first[at]] = count
    counts = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(dense))
    return pa.RecordBatch.from_arrays([doc_id, pa.array(block, pa.int32()), counts], ["doc_id", "block", "counts"])


def _counted_vectors(tokenized: DataFrame, vocabulary: DataFrame, size: int, block_words: int) -> DataFrame:
    """The vectors of documents whose ids differ, each filled in its task by a vocabulary that is broadcast."""
    known = vocabulary.select("word", F.col("word_id").cast("int").alias("word_id")).toArrow().combine_chunks()
    ids = np.append(known.column("word_id").to_numpy().astype(np.int64), -1)
    shared = tokenized.sparkSession.sparkContext.broadcast((known.column("word").combine_chunks().cast(pa.string()), ids))
    blocks, step = max(1, -(-size // block_words)), max(1, DENSE_VALUES // block_words)

    def fill(batches):
        words, ids = shared.value
        for batch in batches:
            for piece, sizes in _batch_pieces(batch):
                row, code, found = _encoded(piece, sizes)
                place = pc.fill_null(pc.index_in(found.cast(pa.string()), value_set=words), len(words))
                word = ids[place.to_numpy(zero_copy_only=False).astype(np.int64)][code]
                row, word, count = _runs(row[word >= 0], word[word >= 0], size)
                at = row * blocks + word // block_words
                for start in range(0, len(sizes) * blocks, step):
                    here = np.arange(start, min(start + step, len(sizes) * blocks))
                    a, b = np.searchsorted(at, [start, start + step])
                    doc_id = piece.column("doc_id").take(pa.array(here // blocks))
                    yield _dense_batch(doc_id, here % blocks, at[a:b] - start, word[a:b], count[a:b], size, block_words)

    return _dense_blocks(tokenized.select("doc_id", "tokens"), fill)


def _joined_vectors(tokenized: DataFrame, vocabulary: DataFrame, size: int, block_words: int) -> DataFrame:
    """The vectors by joins with the vocabulary, for any ids and vocabulary."""
    last = max(0, -(-size // block_words) - 1)
    block = F.floor(F.col("word_id") / F.lit(block_words)).cast("int")
    matched = lookup_words(word_counts(tokenized), vocabulary).where("word_id is not null")
    entry = F.struct("word_id", "count")
    packed = matched.groupBy("doc_id", block.alias("block")).agg(F.collect_list(entry).alias("_found"))
    wanted = tokenized.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("block"))
    rows = wanted.join(packed, ["doc_id", "block"], "left").select(
        "doc_id", "block", F.col("_found.word_id").alias("words"), F.col("_found.count").alias("found")
    )

    step = max(1, DENSE_VALUES // block_words)

    def fill(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                some = batch.slice(start, step)
                sizes = pc.fill_null(pc.list_value_length(some.column("words")), 0).to_numpy(zero_copy_only=False)
                words, found = (some.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("words", "found"))
                at = np.repeat(np.arange(len(sizes)), sizes)
                yield _dense_batch(some.column("doc_id"), some.column("block").to_numpy(zero_copy_only=False), at, words, found, size, block_words)

    return _dense_blocks(rows, fill)


def nonzero_counts(blocks: DataFrame) -> DataFrame:
    """``(doc_id, block, size, at, count)``: the entries of :func:`count_vectors` that are not zero, with the
    size of their block. Zeros are passed over a batch at a time instead of becoming rows.

    Blocks as :func:`count_vectors` returned them are filled and read in one task: the dense arrays, which are
    documents times vocabulary, do not travel. Any other table of blocks is read as it is.
    """

    def entries(batches):
        for batch in batches:
            counts = batch.column("counts")
            sizes = pc.list_value_length(counts).to_numpy(zero_copy_only=False).astype(np.int32)
            ends, values = np.cumsum(sizes, dtype=np.int64), counts.flatten().to_numpy(zero_copy_only=False)
            hits = np.flatnonzero(values)
            row = np.searchsorted(ends, hits, side="right")
            at = (hits - (ends - sizes)[row]).astype(np.int32)
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(rows), batch.column("block").take(rows), pa.array(sizes[row]), pa.array(at), pa.array(values[hits])],
                ["doc_id", "block", "size", "at", "count"],
            )

    key = blocks.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, block int, size int, at int, count bigint"
    read = read_in_tasks(blocks, entries, schema)
    return blocks.select("doc_id", "block", "counts").mapInArrow(entries, schema) if read is None else read


def empty_documents(corpus: DataFrame, distributions: DataFrame) -> DataFrame:
    """Documents that have no distribution because no word of theirs counts."""
    return corpus.join(distributions.select("doc_id"), "doc_id", "left_anti")


def pack(distributions: DataFrame, key: str, idx: str, p: str = "p") -> DataFrame:
    """One row per key with aligned arrays ``idx`` and ``p``, ordered by index.

    An array never exceeds the number of distinct indices.
    """
    entries = F.array_sort(F.collect_list(F.struct(F.col(idx).alias("i"), F.col(p).alias("p"))))
    return (
        distributions.groupBy(key)
        .agg(entries.alias("_entries"))
        .select(
            key,
            F.col("_entries.i").cast("array<int>").alias("idx"),
            F.col("_entries.p").cast("array<double>").alias("p"),
        )
    )


def distribution(rows: DataFrame, key: str, idx: str, weight: str | None = None) -> DataFrame:
    """``(key, idx, p)``: any table's rows as one histogram per key.

    Counts (or the sum of ``weight``) combine before the shuffle; the window that normalizes
    sees one row per distinct index and key.
    """
    mass = F.sum(weight) if weight else F.count(F.lit(1))
    counted = rows.groupBy(key, F.col(idx).cast("int").alias("idx")).agg(
        mass.cast("double").alias("_mass")
    )
    total = F.sum("_mass").over(Window.partitionBy(key))
    return counted.select(key, "idx", (F.col("_mass") / total).alias("p"))
