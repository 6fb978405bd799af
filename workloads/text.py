"""Documents: words, vocabularies, distributions and simple indices."""

from __future__ import annotations

from pyspark.sql import functions as F

from otindex.operators import text as tx
from otindex.operators.embeddings import train_embeddings
from otindex.operators.index import index_by_period, standardize, topic_top_words
from otindex.operators.optim import assign_batches
from otindex.session import broadcast_if_small, materialize, working_folder
from otindex.sources.corpus import read_corpus, write_corpus
from workloads.tables import (
    STOP,
    WORDS,
    corpus,
    rounded,
    table,
    tokenized,
    vocabulary_sql,
)

MIN_COUNT = 5
BLOCK_WORDS = 1000


def corpus_rows(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", "ts", F.md5("text").alias("digest"))


def event_corpus(spark, sf_dir):
    read = read_corpus(
        spark, f"{sf_dir}/events.parquet", doc_id="event_id", ts="ts", text="event_type"
    )
    return read.select("doc_id", "ts", "text")


def corpus_round_trip(spark, sf_dir):
    """The corpus after writing it as delimited text and reading it back."""
    path = working_folder(spark, "corpus")
    write_corpus(corpus(spark, sf_dir), path, "tsv")
    back = read_corpus(spark, path, "tsv")
    return back.select("doc_id", "ts", F.md5("text").alias("digest"))


def tokens(spark, sf_dir):
    return tx.explode_tokens(tokenized(spark, sf_dir))


def tokens_no_stop(spark, sf_dir):
    return tx.explode_tokens(tx.remove_stopwords(tokenized(spark, sf_dir)))


def vocabulary(spark, sf_dir):
    return tx.build_vocabulary(tokenized(spark, sf_dir), MIN_COUNT)


def word_counts(spark, sf_dir):
    return tx.word_counts(tokenized(spark, sf_dir))


def word_count_vectors(spark, sf_dir):
    """The entries other than zero of the dense vectors, with the size of the block they lie in."""
    tok = tokenized(spark, sf_dir)
    blocks = tx.count_vectors(tok, tx.build_vocabulary(tok, MIN_COUNT), BLOCK_WORDS)
    word = (F.col("block") * BLOCK_WORDS + F.col("at")).alias("word_id")
    return tx.nonzero_counts(blocks).select("doc_id", word, "size", "count")


def doc_distributions(spark, sf_dir):
    tok = tokenized(spark, sf_dir)
    return rounded(tx.doc_distributions(tok, tx.build_vocabulary(tok, MIN_COUNT)), "p")


def doc_distributions_drop(spark, sf_dir):
    tok = tokenized(spark, sf_dir)
    return rounded(tx.doc_distributions(tok, tx.build_vocabulary(tok, MIN_COUNT), "drop"), "p")


def empty_documents(spark, sf_dir):
    tok = tokenized(spark, sf_dir)
    shares = tx.doc_distributions(tok, tx.build_vocabulary(tok, MIN_COUNT), "drop")
    return tx.empty_documents(tok, shares).select("doc_id")


def batches(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id")
    return assign_batches(documents, 64).select("doc_id", "batch")


def word2vec(spark, sf_dir):
    """Vectors of 10 numbers after 20 iterations, as in the reference."""
    return train_embeddings(tokenized(spark, sf_dir), dim=10, iterations=20, min_count=MIN_COUNT)


def top_words(spark, sf_dir):
    """The ten most likely words per document source."""
    documents = table(spark, sf_dir, "documents")
    source = F.regexp_replace("source", "[^0-9]", "").cast("int").alias("topic")
    tok = tokenized(spark, sf_dir)
    words = tx.build_vocabulary(tok, MIN_COUNT)
    counts = tx.lookup_words(tx.word_counts(tok), words).where("word_id is not null")
    by_source = counts.join(documents.select("doc_id", source), "doc_id")
    topics = tx.distribution(by_source, "topic", "word_id", weight="count")
    shares = topics.select("topic", F.col("idx").alias("word_id"), "p")
    return rounded(topic_top_words(shares, words, 10), "p")


def _commonness(spark, sf_dir):
    """How common the words of each dated document are: the mean logarithm of their frequency."""
    dated = corpus(spark, sf_dir)
    tok = tx.tokenize(dated)
    words = tx.build_vocabulary(tok, MIN_COUNT)
    frequencies = broadcast_if_small(materialize(words.select("word", "freq")))
    length = F.size("tokens").alias("n_tokens")
    found = tok.select("doc_id", length, F.explode_outer("tokens").alias("word")).where("word is not null").join(frequencies, "word", "left")
    scores = found.groupBy("doc_id").agg((F.sum(F.ln("freq")) / F.max("n_tokens")).alias("score"))
    return dated.select("doc_id", "ts").join(scores, "doc_id")


def flagship_index(spark, sf_dir):
    """Monthly standardized index of how common words are, over the whole vocabulary."""
    series = standardize(index_by_period(_commonness(spark, sf_dir), "month"))
    return rounded(series, "index")


def _orders_index(period):
    def query(spark, sf_dir):
        orders = table(spark, sf_dir, "orders").select("o_orderdate", "o_totalprice")
        series = index_by_period(orders, period, "o_orderdate", "o_totalprice")
        return rounded(series, "index", digits=2)

    return query


def _events_index(period):
    def query(spark, sf_dir):
        events = table(spark, sf_dir, "events").select("ts", "value")
        return rounded(index_by_period(events, period, "ts", "value"), "index", digits=4)

    return query


def standardized_index(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("ts", "value")
    return rounded(standardize(index_by_period(events, "day", "ts", "value")), "index")


QUERIES = {
    "corpus": corpus_rows,
    "corpus_round_trip": corpus_round_trip,
    "event_corpus": event_corpus,
    "tokens": tokens,
    "tokens_no_stop": tokens_no_stop,
    "vocabulary": vocabulary,
    "word_counts": word_counts,
    "word_count_vectors": word_count_vectors,
    "doc_distributions": doc_distributions,
    "doc_distributions_drop": doc_distributions_drop,
    "empty_documents": empty_documents,
    "batches": batches,
    "word2vec": word2vec,
    "topic_top_words": top_words,
    "index_year": _orders_index("year"),
    "index_quarter": _orders_index("quarter"),
    "index_month": _orders_index("month"),
    "index_week": _events_index("week"),
    "index_day": _events_index("day"),
    "standardized_index": standardized_index,
    "flagship_index": flagship_index,
}

_COUNTS = "counted AS (SELECT doc_id, token AS word, count(*) AS count FROM words GROUP BY 1, 2)"
_POSITIONS = "CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS INTEGER) AS pos"


def _index_sql(source: str, ts: str, value: str, period: str, digits: int) -> str:
    return f"""
SELECT CAST(min({ts}) AS DATE) AS period_start, round(sum({value}), {digits}) + 0.0 AS index
FROM {source} GROUP BY date_trunc('{period}', {ts})"""


_CORPUS = """
SELECT doc_id, o_orderdate AS ts, md5(text) AS digest FROM documents JOIN orders ON doc_id = o_orderkey"""

ORACLES = {
    "corpus": _CORPUS,
    "corpus_round_trip": _CORPUS,
    "event_corpus": "SELECT event_id AS doc_id, ts, event_type AS text FROM events",
    "tokens": f"WITH {WORDS} SELECT doc_id, {_POSITIONS}, token FROM words",
    "tokens_no_stop": f"""
WITH {WORDS}, stop(word) AS (VALUES {STOP})
SELECT doc_id, {_POSITIONS}, token FROM words WHERE token NOT IN (SELECT word FROM stop)""",
    "vocabulary": f"WITH {WORDS}, {vocabulary_sql(MIN_COUNT)} SELECT * FROM vocabulary",
    "word_counts": f"""
WITH {WORDS}, {_COUNTS}
SELECT doc_id, CAST(sum(count) OVER (PARTITION BY doc_id) AS BIGINT) AS n_tokens, word, count FROM counted""",
    "word_count_vectors": f"""
WITH {WORDS}, {vocabulary_sql(MIN_COUNT)}, {_COUNTS}
SELECT doc_id, word_id, count,
  CAST(least({BLOCK_WORDS}, (SELECT count(*) FROM vocabulary) - word_id // {BLOCK_WORDS} * {BLOCK_WORDS}) AS INTEGER) AS size
FROM counted JOIN vocabulary USING (word)""",
    "doc_distributions": f"""
WITH {WORDS}, {vocabulary_sql(MIN_COUNT)},
known AS (
  SELECT doc_id, coalesce(word_id, (SELECT CAST(count(*) AS INTEGER) FROM vocabulary)) AS word_id
  FROM words LEFT JOIN vocabulary ON token = word
),
counted AS (SELECT doc_id, word_id, count(*) AS n FROM known GROUP BY 1, 2)
SELECT doc_id, word_id, round(n / sum(n) OVER (PARTITION BY doc_id), 6) AS p FROM counted""",
    "doc_distributions_drop": f"""
WITH {WORDS}, {vocabulary_sql(MIN_COUNT)},
counted AS (SELECT doc_id, word_id, count(*) AS n FROM words JOIN vocabulary ON token = word GROUP BY 1, 2)
SELECT doc_id, word_id, round(n / sum(n) OVER (PARTITION BY doc_id), 6) AS p FROM counted""",
    "empty_documents": f"""
WITH {WORDS}, {vocabulary_sql(MIN_COUNT)}
SELECT doc_id FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM words JOIN vocabulary ON token = word)""",
    "batches": """
SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 64 AS INTEGER) AS batch FROM documents""",
    "topic_top_words": f"""
WITH {WORDS}, {vocabulary_sql(MIN_COUNT)},
counted AS (
  SELECT CAST(regexp_replace(source, '[^0-9]', '', 'g') AS INTEGER) AS topic, v.word, count(*) AS n
  FROM words w JOIN vocabulary v ON w.token = v.word JOIN documents d ON d.doc_id = w.doc_id GROUP BY 1, 2
),
ranked AS (
  SELECT topic, word, n / sum(n) OVER (PARTITION BY topic) AS p,
    row_number() OVER (PARTITION BY topic ORDER BY n DESC, word) AS rank
  FROM counted
)
SELECT topic, CAST(rank AS INTEGER) AS rank, word, round(p, 6) AS p FROM ranked WHERE rank <= 10""",
    "index_year": _index_sql("orders", "o_orderdate", "o_totalprice", "year", 2),
    "index_quarter": _index_sql("orders", "o_orderdate", "o_totalprice", "quarter", 2),
    "index_month": _index_sql("orders", "o_orderdate", "o_totalprice", "month", 2),
    "index_week": _index_sql("events", "ts", "value", "week", 4),
    "index_day": _index_sql("events", "ts", "value", "day", 4),
    "standardized_index": """
WITH series AS (
  SELECT CAST(min(ts) AS DATE) AS period_start, sum(value) AS x FROM events GROUP BY date_trunc('day', ts)
)
SELECT period_start, round((x - avg(x) OVER ()) / stddev_samp(x) OVER () + 100, 6) AS index FROM series""",
    "flagship_index": f"""
WITH {WORDS}, {vocabulary_sql(MIN_COUNT)},
scored AS (
  SELECT w.doc_id, sum(ln(freq)) / count(*) AS score
  FROM words w LEFT JOIN vocabulary v ON w.token = v.word GROUP BY 1
),
series AS (
  SELECT CAST(min(o_orderdate) AS DATE) AS period_start, sum(score) AS x
  FROM scored JOIN orders ON doc_id = o_orderkey GROUP BY date_trunc('month', o_orderdate)
)
SELECT period_start, round((x - avg(x) OVER ()) / stddev_samp(x) OVER () + 100, 6) AS index FROM series""",
}
