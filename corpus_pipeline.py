"""From raw documents to token ids, in five stages; each is written before the next reads it.

A stage takes (spark, docs, sf_dir) and works on all rows of ``docs``, which has the columns
of ``documents`` and is read from files. All but the last return these columns; others are left
out. Texts without letters, null or empty ones among them, have no language and go in the
first stage. Ids may be null or repeat, and whole rows may repeat: each is a document, and of
equal ones the first stays. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import bpe, language, near_copies, personal, tiling
from paperloom.llm.queries import table, vocabulary
from paperloom.llm.words import batch_bytes
from paperloom.session import fits_in_broadcast, stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bytes of a batch between Spark and Python: two tasks of an executor hold some at once.
BATCH = 1 << 20


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that no language's model accepts."""
    batch_bytes(spark, BATCH)
    found = language.identify(docs.select(*COLUMNS), language.fit(docs))
    return found.where("accepted").select(*COLUMNS)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8).

    Rows are told apart by their place in the files, so that repeated ids and repeated rows
    are documents like any others; of a group, the row that comes first stays. The places are
    written once, as a later scan may split the files in another way.
    """
    batch_bytes(spark, BATCH)
    rows = stage(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "rows")
    found = near_copies.near_copies(rows, size=5, threshold=80, doc_id="row")
    removed = stage(found.where(~F.col("kept")).select(F.col("doc_id").alias("row")), "removed")
    listed = F.broadcast(removed) if fits_in_broadcast(removed, "row") else removed
    return rows.join(listed, "row", "left_anti").select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that have a benchmark item in them."""
    batch_bytes(spark, BATCH)
    return tiling.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each span of personal data replaced by its kind."""
    found = personal.find_personal(docs.select(*COLUMNS), keep_text=True)
    text = F.when(F.size("spans") > 0, personal.redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, checked by decoding them again."""
    batch_bytes(spark, BATCH)
    return bpe.round_trip(docs.select("doc_id", "text", "lang", "source"), *vocabulary(), keep_ids=True)


STAGES = [
    ("language", known_language),
    ("near_copies", one_of_near_copies),
    ("decontamination", decontaminated),
    ("personal_data", without_personal_data),
    ("bpe", encoded),
]

#: Models, signatures and tokens cannot be had from SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
