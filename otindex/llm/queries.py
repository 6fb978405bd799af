"""One query per operator over the driver tables, with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from otindex.llm.byte_bpe import encode_documents
from otindex.llm.chat_format import ESCAPE, Template, format_chats, read_chats
from otindex.llm.decontaminate import find_leaks
from otindex.llm.alignment import align
from otindex.llm.collocations import collocations
from otindex.llm.line_crf import classify, fit, held_out, learnable
from otindex.llm.mixing import mix
from otindex.llm.pii import pseudonymize
from otindex.llm.quality_rules import judge
from otindex.llm.simhash import near_duplicates
from otindex.llm.token_files import read_tokens, write_tokens
from otindex.llm.url_reputation import SUFFIXES, Rule, filter_urls
from otindex.llm.warc import read_warc, write_warc
from otindex.session import working_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie inside benchmark passages of ten words."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(documents, table(spark, sf_dir, "benchmark"), 10, keep_text=False)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS_SQL} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS words
  FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS u(p) WHERE len(w) > 0
),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT r, p, size, array_to_string(w[p:p + size - 1], ' ') AS words
  FROM d, sizes, unnest(range(1, len(w) - size + 2)) AS u(p)
),
hits AS (SELECT r, p, item, size FROM places JOIN windows USING (size, words)),
n_hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM hits, unnest(range(p, p + size)) AS u(k) GROUP BY r),
n_items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n_hit USING (r) LEFT JOIN n_items USING (r)
"""


#: A conversation that says what marks turns in other templates.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations and one made of control strings, and read them back."""
    more = spark.createDataFrame(
        [(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)],
        "conv_id bigint, turn bigint, role string, text string",
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_chats(format_chats(turns.unionByName(more)))


_CHAT = Template()


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _escaped_length(column: str) -> str:
    counts = " + ".join(
        f"(length({column}) - length(replace({column}, {_sql_text(c)}, ''))) // {len(c)}" for c in _CHAT.controls
    )
    return f"(length({column}) + length({column}) - length(replace({column}, chr({ord(ESCAPE)}), '')) + {counts})"


OP2_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS said_by, coalesce(text, '') AS said, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL_TEXT}', 'user', '{CONTROL_TEXT}'
  UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TEXT}', 'assistant', '{CONTROL_TEXT}'
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(said_by || chr(10) || said || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)) AS turns_sha256,
  sum(CASE WHEN said_by = 'assistant' THEN length(said) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN said_by = 'assistant' THEN said ELSE '' END, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)) AS loss_sha256,
  sum({len(_CHAT.opening) + 1 + len(_CHAT.closing)} + {_escaped_length("said_by")}
    + length(said_by) - length(replace(said_by, chr(10), '')) + {_escaped_length("said")})::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""


#: The key of the stand-ins; a deployment takes its own from a secret store.
PII_KEY = "otindex demonstration key"


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with stand-ins for the personal data and secrets in its text."""
    return pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages to archives in the shared folder and read those back."""
    folder = working_folder(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), folder, 0)
    return read_warc(spark, folder, payloads=False).drop("url")


def _base32_sql(hexadecimal: str) -> str:
    """Base32 of 40 hexadecimal digits: five of them are four letters."""
    digits = "'0123456789abcdef'"
    letters = []
    for at in range(1, 41, 5):
        value = " + ".join(f"(strpos({digits}, substr({hexadecimal}, {at + k}, 1)) - 1) * {16 ** (4 - k)}" for k in range(5))
        letters += [f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((({value}) >> {s}) & 31)::INT + 1, 1)" for s in (15, 10, 5, 0)]
    return " || ".join(letters)


OP4_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS h FROM p),
r AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS last,
    row_number() OVER (PARTITION BY h ORDER BY page_id DESC NULLS LAST) AS place FROM d
)
SELECT page_id, payload_bytes, {_base32_sql("h")} AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN place > 1 THEN last END AS refers_to
FROM r
"""


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every whole document, decode the ids, and digest both."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return encode_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document, the base rules, and the verdict of the trees."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return judge(table(spark, sf_dir, "documents"), labels).drop("score")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"), 3, 2, 42)


#: The rules of the query: subdomains too, longest fitting rule first.
URL_RULES = [
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]

#: Tolerated bad rate of a host, and posterior standard deviations of the bound.
TOLERATED, BOUND_Z = 0.5, 1.645


def op8_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every page; a page's outcome is that of the label with its number, bad if low or toxic."""
    outcomes = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")
    )
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, outcomes, URL_RULES, TOLERATED, BOUND_Z).drop("method")


def _rule_cases(value: str) -> str:
    ordered = sorted(URL_RULES, key=lambda r: (-len(r.text), r.verdict != "block", r.text))
    return " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') "
        f"THEN '{r.text if value == 'rule' else r.verdict}'"
        for r in ordered
    )


_TWO = "(" + ", ".join(f"'{s}'" for s in SUFFIXES) + ")"


def _strength_sql(name: str) -> str:
    """One row (rate, k): pooled rate and prior strength, as the operator computes them."""
    return f"""
  SELECT coalesce(rate, 0.0) AS rate, 1 / CASE WHEN t IS NULL OR rate * (1 - rate) <= 0 OR t - nn / t <= 0 OR g < 2 THEN 1e-3
    ELSE least(0.5, greatest(1e-3, CASE WHEN t - nn / t = g - 1 THEN 0.0 ELSE
      ((bb - b * b / t) - rate * (1 - rate) * (g - 1)) / (rate * (1 - rate) * (t - nn / t - (g - 1))) END)) END - 1 AS k
  FROM (SELECT *, b / t AS rate FROM (
    SELECT count(*) AS g, sum(n)::DOUBLE AS t, sum(bad)::DOUBLE AS b,
      sum((n * n)::DOUBLE) AS nn, sum((bad * bad)::DOUBLE / n) AS bb FROM {name} WHERE n > 0))"""


OP8_SQL = f"""
WITH judged AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages
), outcome AS (
  SELECT doc_id AS page_id, max((quality = 0 OR toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id
), hosts AS (
  SELECT *, CASE WHEN two IN {_TWO} THEN two ELSE split_part(host, '.', -1) END AS suffix,
    CASE WHEN two IN {_TWO} THEN regexp_extract(host, '[^.]*[.]?[^.]*[.]?[^.]*$') ELSE two END AS domain
  FROM (SELECT *, regexp_extract(host, '[^.]*[.]?[^.]*$') AS two FROM (
    SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS bad
    FROM judged LEFT JOIN outcome USING (page_id) GROUP BY host))
), domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
s1 AS ({_strength_sql("suffixes")}), s2 AS ({_strength_sql("domains")}), s3 AS ({_strength_sql("hosts")}),
top AS (SELECT suffix, (bad + k * rate) / (n + k) AS top FROM suffixes, s1),
middle AS (SELECT domain, suffix, (bad + k * top) / (n + k) AS prior FROM domains JOIN top USING (suffix), s2),
posterior AS (SELECT host, n, k, (bad + k * prior) / (n + k) AS mean FROM hosts JOIN middle USING (domain, suffix), s3),
blocked AS (SELECT host FROM posterior WHERE mean - {BOUND_Z} * sqrt(mean * (1 - mean) / (n + k + 1)) > {TOLERATED})
SELECT page_id, host, path, CASE {_rule_cases("rule")} END AS rule,
  CASE {_rule_cases("verdict")} WHEN host IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""

#: The id that ends each document in the token files.
END_ID = 2


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the token ids of all documents to files in the shared folder and read those back."""
    import public_tokenizers

    folder = working_folder(spark, "tokens")
    path = public_tokenizers.path("word_bpe_49k.json")
    write_tokens(table(spark, sf_dir, "documents"), folder, path, END_ID)
    return read_tokens(spark, folder, ids=False)


def op10_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every whole document; a fifth of the documents is never learnt from."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = fit(documents, learnable(table(spark, sf_dir, "labels").select("doc_id", "quality")))
    scored = classify(documents, weights, 0.3, keep_text=False)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of two or three words of every language."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return collocations(documents, size=3, min_count=10, top=2000)


OP11_SQL = r"""
WITH words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)
), phrases AS MATERIALIZED (
  SELECT lang, k, w[p:p + k - 1] AS w, count(*)::HUGEINT AS f
  FROM words, range(1, 4) AS s(k), unnest(range(1, len(w) - k + 2)) AS u(p) GROUP BY ALL
), totals AS (SELECT lang, sum(f)::BIGINT AS n FROM phrases WHERE k = 1 GROUP BY lang),
frequent AS MATERIALIZED (SELECT * FROM phrases WHERE f >= 10),
cuts AS (
  SELECT c.lang, c.w, c.f AS a, x.f AS l, y.f AS r, cut, (1000000 * c.f * c.f) // (x.f * y.f) AS score
  FROM frequent c, range(1, 3) AS s(cut)
  JOIN frequent x ON x.lang = c.lang AND x.w = c.w[1:cut] JOIN frequent y ON y.lang = c.lang AND y.w = c.w[cut + 1:]
  WHERE c.k > cut
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, w, max(f) AS longer FROM (
    SELECT lang, w[1:2] AS w, f FROM frequent WHERE k = 3 UNION ALL SELECT lang, w[2:3], f FROM frequent WHERE k = 3)
  GROUP BY ALL
), kept AS (
  SELECT lang, array_to_string(w, ' ') AS phrase, a, l, r, score
  FROM best LEFT JOIN inside USING (lang, w) WHERE coalesce(100 * longer < 50 * a, true)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
  a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM kept JOIN totals USING (lang)
QUALIFY rank <= 2000
"""


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix of sources weighed 1, 2, 3 in turn takes."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mix(documents, weights=(1, 2, 3), most=3)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("copies")).alias("taken"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of tokens that two tokenizers share in every document, and how common their links are."""
    import public_tokenizers

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align(documents, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_chat_format": op2_chat_format,
    "op3_pii_surrogates": op3_pii_surrogates,
    "op4_warc": op4_warc,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_quality_rules": op6_quality_rules,
    "op7_simhash": op7_simhash,
    "op8_url_reputation": op8_url_reputation,
    "op9_token_files": op9_token_files,
    "op10_line_crf": op10_line_crf,
    "op11_collocations": op11_collocations,
    "op12_mixing": op12_mixing,
    "op13_alignment": op13_alignment,
}

ORACLES = {"op1_decontaminate": OP1_SQL, "op2_chat_format": OP2_SQL, "op4_warc": OP4_SQL, "op8_url_reputation": OP8_SQL, "op11_collocations": OP11_SQL}
