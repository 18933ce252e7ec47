"""From raw documents to encoded ones, in five stages.

Each stage takes all documents that the one before kept; the last returns their encoding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import stored, table
from parlance.llm.language_mixture import known_language, learn
from parlance.llm.line_templates import drop_recurring_lines
from parlance.llm.partenum import keep_one_of_each
from parlance.llm.piece_table import encode_pieces
from parlance.llm.queries import PIECE_MODEL, read_bytes
from parlance.llm.string_tiling import leak_columns
from parlance.session import configure


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the learned languages: those that a background of equally likely trigrams explains clearly better go.

    Languages are learnt from the rows with a text and a lang. A null or empty text, and one without a
    letter, goes; so does text of no learned language. If no row has both, all documents stay. Rows
    are judged by their text alone, repeated ones alike; no row changes, whatever its doc_id or other
    columns hold, and columns may have any names. An empty table stays empty.
    """
    configure(spark)
    langs, model = learn(docs)
    return docs.filter(known_language(spark, langs, model)(F.col("text"))) if langs else docs


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of recurring templates; those of which no word is left go.

    Only `text` changes, and n_chars with it if there is such a column. A document that loses no line
    stays as it is, also with a null or empty text. Repeated rows count as one document and are treated
    alike; a null doc_id is an id like any other. Other columns stay, whatever their names. An empty
    table stays empty.
    """
    configure(spark)
    packed = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    cleaned = drop_recurring_lines(packed)
    left = (F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    changed = F.col("n_dropped") > 0
    columns = {c: F.col("row").getField(c) for c in docs.columns}
    columns["text"] = F.when(changed, F.col("text")).otherwise(columns["text"])
    if "n_chars" in columns:
        n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(changed, n_chars).otherwise(columns["n_chars"])
    return cleaned.filter(left).select(*[v.alias(c) for c, v in columns.items()])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id.

    Of repeated rows one stays; a null doc_id comes after all others. Documents without words (a null
    or empty text) have no duplicates and stay. Of equal ids with different texts of one group the one
    with the smaller hash stays. Columns are not read besides doc_id and text, and may have any names.
    An empty table stays empty.
    """
    configure(spark)
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item.

    Rows are judged by their text alone, repeated ones alike; a null or empty text covers nothing and
    stays. No row changes; columns may have any names. Empty tables, of documents or of items, drop nothing.
    """
    configure(spark)
    leaks = leak_columns(spark, table(spark, sf_dir, "benchmark"))
    return docs.filter(~leaks(F.col("text")))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and digests of them and of the text they decode to.

    One row per row, also for repeated ones; a null text counts as empty. Other columns are left out.
    """
    configure(spark)
    return encode_pieces(docs, read_bytes(PIECE_MODEL), ("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: SQL has neither the tokenizer nor the learnt models; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each result stored as Parquet and read again by the next stage."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{name}")
    return docs
