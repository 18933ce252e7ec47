"""The registered query of each operator, over whole tables, and SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from parlance.llm.brown_lm import score_documents
from parlance.llm.byte_transducer import encode_bytes
from parlance.llm.common import remainder, table
from parlance.llm.histogram_sort import shard_by_bytes
from parlance.llm.language_mixture import language_columns, learn
from parlance.llm.line_frequency import line_frequency_rules
from parlance.llm.line_templates import drop_recurring_lines
from parlance.llm.partenum import near_duplicates
from parlance.llm.piece_table import encode_pieces
from parlance.llm.source_divergence import audit_sources
from parlance.llm.string_tiling import find_leaks
from parlance.llm.token_attribution import attribute_tokens
from parlance.llm.url_markov import filter_urls, parse_rule
from parlance.llm.word_runs import find_runs

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_bytes(path: str) -> bytes:
    """A vocabulary file of the driver; it is sent to the executors from there."""
    with open(path, "rb") as file:
        return file.read()


def op1_token_counts(spark, sf_dir):
    return attribute_tokens(table(spark, sf_dir, "documents"), read_bytes(RANK_FILE), public_tokenizers.PATTERN)


def op2_leaks(spark, sf_dir):
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


RULES = [parse_rule(r) for r in ("allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/")]


def op3_url_filter(spark, sf_dir):
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)


def op4_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = remainder(4) == 2
    judged = language_columns(spark, *learn(docs.filter(~held)))(F.col("text"))
    return docs.select("doc_id", held.alias("held_out"), judged.alias("j")).select(
        "doc_id", "held_out", "j.lang_pred", "j.score", "j.mixture"
    )


def op6_class_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = remainder(5) == 1
    return score_documents(docs, docs.filter(~held)).withColumn("held_out", held)


def op7_line_templates(spark, sf_dir):
    kept = drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return kept.select("doc_id", "n_lines", "n_dropped", F.length(text).alias("kept_chars"), F.sha2(text, 256).alias("kept_sha256"))


def op8_shards(spark, sf_dir):
    return shard_by_bytes(table(spark, sf_dir, "documents"))


def op9_pieces(spark, sf_dir):
    fields = ("n_tokens", "ids_sha256", "decoded_sha256")
    return encode_pieces(table(spark, sf_dir, "documents"), read_bytes(PIECE_MODEL), fields)


def op10_quality(spark, sf_dir):
    return line_frequency_rules(table(spark, sf_dir, "documents"))


def op11_divergence(spark, sf_dir):
    return audit_sources(table(spark, sf_dir, "documents"))


def planted(docs):
    """The texts of op12: in a tenth of the documents the words from a point on repeat those before."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def repeat(words):
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        again = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, place(i).cast("int")))
        return F.when(n > 0, F.array_join(again, " ")).otherwise("")

    # A list of one list, so that the words are named once and split once.
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    repeated = F.get(F.transform(F.array(words), repeat), F.lit(0))
    return docs.select("doc_id", F.when(F.col("text").isNotNull() & (h % 10 == 0), repeated).otherwise(F.col("text")).alias("text"))


def op12_runs(spark, sf_dir):
    found = find_runs(planted(table(spark, sf_dir, "documents")))
    # Of the longest runs the first, then the one of the shortest period.
    longest = F.get(F.sort_array(F.transform("runs", lambda r: F.struct((-r["length"]).alias("falling"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    found = found.withColumn("longest", longest)
    length, period = -F.col("longest.falling"), F.col("longest.period")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("longest.start").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.expr("(-1000L * longest.falling) div longest.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )


def op13_bytes(spark, sf_dir):
    fields = ("n_tokens", "ids_sha256", "decoded_sha256")
    return encode_bytes(table(spark, sf_dir, "documents"), read_bytes(RANK_FILE), public_tokenizers.PATTERN, fields)


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_leaks,
        op3_url_filter,
        op4_near_duplicates,
        op5_language,
        op6_class_scores,
        op7_line_templates,
        op8_shards,
        op9_pieces,
        op10_quality,
        op11_divergence,
        op12_runs,
        op13_bytes,
    )
}

OP11_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
),
words AS (
    SELECT lang, source, id, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
totals AS (
    SELECT g.lang, g.source, coalesce(sum(n), 0) AS total
    FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source
    GROUP BY g.lang, g.source
),
cells AS (
    SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
        1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (t.total + l.v) AS p,
        1 + (1000000000::HUGEINT * (k.n + 1)) // (l.total + l.v) AS whole
    FROM totals t JOIN langs l ON l.lang = t.lang JOIN kept k ON k.lang = t.lang
        LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term
),
sums AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
    FROM cells a JOIN cells b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source
    GROUP BY ALL
),
parts AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
    FROM totals a JOIN totals b ON b.lang = a.lang AND b.source <> a.source
        LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, CAST(((p - whole) * (p - whole)) // whole AS BIGINT) FROM cells WHERE n > 0 AND p > whole
)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 200
"""
ORACLE: dict[str, str] = {"op11_divergence": OP11_SQL}
