"""Typed readers: mention documents, papers, identifiers, stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom import schemas
from paperloom.sources.documents import decode, scan_jsonl


def decode_mentions(docs: DataFrame, strict: bool = False) -> DataFrame:
    """(…, file, mentions): only the declared keys are read, missing ones become empty."""
    return decode(docs, schemas.MENTION_DOC, strict).withColumn(
        "mentions",
        F.coalesce(
            "mentions",
            F.array().cast(
                "array<struct<`software-name`:struct<normalizedForm:string,"
                "wikidataId:string>,`software-type`:string>>"
            ),
        ),
    )


def decode_papers(docs: DataFrame, strict: bool = False) -> DataFrame:
    """(…, file, year). A missing year is 0."""
    return decode(docs, schemas.PAPER_DOC, strict).withColumn(
        "year", F.coalesce("year", F.lit(0))
    )


def decode_paper_ids(docs: DataFrame, strict: bool = False) -> DataFrame:
    """Identifier rows with missing strings as '' and missing lists as empty."""
    rows = decode(docs, schemas.PAPER_ID_DOC, strict)
    text = ("id", "doi", "arxiv", "pmid", "pmcid", "istexId", "license", "oa_link")
    filled = {c: F.coalesce(c, F.lit("")) for c in text}
    filled["resources"] = F.coalesce("resources", F.array().cast("array<string>"))
    return rows.withColumns(filled)


def scan_mentions_json(spark: SparkSession, path, strict: bool = False, spread: int | None = None) -> DataFrame:
    return decode_mentions(scan_jsonl(spark, path, spread), strict)


def scan_papers(spark: SparkSession, path, strict: bool = False, spread: int | None = None) -> DataFrame:
    return decode_papers(scan_jsonl(spark, path, spread), strict)


def scan_paper_ids(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    if not path.rstrip("/").endswith(".jsonl"):
        raise ValueError(f"identifier input must end in .jsonl: {path}")
    return decode_paper_ids(scan_jsonl(spark, path), strict)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the tables papers, software, mentions."""
    return spark.read.schema(schemas.TABLES[name]).parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_paper_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PAPER_IDS).parquet(path)


def read_paper_mentions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PAPER_MENTIONS).parquet(path)
