"""From mention documents to the mentions, software and papers tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import files
from paperloom.functions.identifiers import uuid_to_bytes
from paperloom.operators.ordering import ORDER_KEY, with_order_key
from paperloom.session import fits_in_broadcast, stage
from paperloom.sources.documents import SOURCE_ORDER

MAX_YEAR = 65535


def explode_mentions(docs: DataFrame) -> DataFrame:
    """One row per mention: its document's columns, mention_pos, name, id and type.

    Every mention is kept, duplicates too. Missing strings are ''.
    """
    keep = [c for c in docs.columns if c != "mentions"]
    rows = docs.select(*keep, F.posexplode("mentions").alias("mention_pos", "_m"))
    name = F.col("_m")["software-name"]

    def text(c):
        return F.coalesce(c, F.lit(""))

    return rows.select(
        *keep,
        "mention_pos",
        text(name["normalizedForm"]).alias("normalizedForm"),
        text(name["wikidataId"]).alias("wikidataId"),
        text(F.col("_m")["software-type"]).alias("softwareType"),
    )


def project_mentions(exploded: DataFrame) -> DataFrame:
    """(paperId, softwareId) for every mention. Rows without a 36-character id are left to
    ``unidentified``."""
    return exploded.select(
        files.paper_id(F.col("file")).alias("paperId"),
        F.col("normalizedForm").alias("softwareId"),
    ).where(F.col("paperId").isNotNull())


def unidentified(docs: DataFrame) -> DataFrame:
    """Rows whose ``file`` is missing or too short to hold a paper id."""
    return docs.where(files.paper_id(F.coalesce("file", F.lit(""))).isNull())


def project_papers(papers: DataFrame, strict: bool = False) -> DataFrame:
    """(uuid, year) with 0 <= year <= 65535; other rows are dropped or, if strict, raise."""
    fits = F.col("year").between(0, MAX_YEAR) & files.paper_id(F.col("file")).isNotNull()
    if strict:
        wrong = F.raise_error(
            F.concat_ws(" ", F.lit("bad paper row:"), "file", F.col("year").cast("string"))
        )
        papers = papers.withColumn(
            "year", F.when(F.coalesce(fits, F.lit(False)), F.col("year")).otherwise(wrong.cast("int"))
        )
    else:
        papers = papers.where(fits)
    return papers.select(files.paper_id(F.col("file")).alias("uuid"), "year")


def rejected_papers(papers: DataFrame) -> DataFrame:
    """The rows that ``project_papers`` drops: no or a bad year, no id, an unreadable body."""
    fits = F.col("year").between(0, MAX_YEAR) & files.paper_id(F.col("file")).isNotNull()
    return papers.where(~F.coalesce(fits, F.lit(False)))


def software_dimension(
    exploded: DataFrame, order: Sequence[str] = (*SOURCE_ORDER, "mention_pos"), written: bool = False
) -> DataFrame:
    """(normalizedForm, wikidataId, softwareType): id and type of the first mention seen; of
    mentions at the same place, the smallest.

    Two steps. A hash aggregate finds the first place of each name, as one number, so each
    task reduces a hot name to one row before the shuffle. Then the mentions at these places
    are fetched: by broadcast if the list of names is small, else by a join on name and place,
    which no name can make uneven. Mentions are written first unless they are ``written``.
    """
    rows = exploded.select("normalizedForm", "wikidataId", "softwareType", *order)
    rows = rows if written else stage(rows, "mentions")
    placed = with_order_key(rows, order)
    if placed is None:
        found = rows.groupBy("normalizedForm").agg(F.min(F.struct(*order, "wikidataId", "softwareType")).alias("_first"))
        return found.select("normalizedForm", "_first.wikidataId", "_first.softwareType")
    first = stage(placed.groupBy("normalizedForm").agg(F.min(ORDER_KEY).alias(ORDER_KEY)), "first-mentions")
    first = F.broadcast(first) if fits_in_broadcast(first, "normalizedForm") else first
    at_first = placed.join(first, ["normalizedForm", ORDER_KEY])
    smallest = F.array_min(F.collect_set(F.struct("wikidataId", "softwareType")))
    return (
        at_first.groupBy("normalizedForm")
        .agg(smallest.alias("_first"))
        .select("normalizedForm", "_first.wikidataId", "_first.softwareType")
    )


def mention_counts(exploded: DataFrame, name: str = "normalizedForm") -> DataFrame:
    """Raw occurrences per name: not distinct by paper, no stop list."""
    return exploded.groupBy(name).agg(F.count("*").alias("n"))


def order_report(counts: DataFrame, name: str, n: str = "n") -> DataFrame:
    return counts.orderBy(F.desc(n), F.asc(name))


def mentions_per_paper(docs: DataFrame) -> DataFrame:
    """(id, mentions): the names of each document as one list. No shuffle.

    Documents whose name does not start with 36 characters before the first dot are
    skipped; 36 characters that are not a UUID stop the job.
    """
    head = F.substring_index("file", ".", 1)
    wrong = F.raise_error(F.concat(F.lit("not a UUID in file name: "), F.col("file")))
    named = F.transform(
        "mentions",
        lambda m: F.struct(
            F.coalesce(m["software-name"]["normalizedForm"], F.lit("")).alias("normalized_form"),
            F.lit("").alias("wikidata_id"),
        ),
    )
    return docs.where(files.has_id_length(F.col("file"))).select(
        F.coalesce(uuid_to_bytes(head), wrong.cast("binary")).alias("id"),
        named.alias("mentions"),
    )


def mentions_with_software(mentions: DataFrame, software: DataFrame) -> DataFrame:
    """Each mention with its software row, if there is one.

    The software side is not hinted: it is broadcast only when its measured size allows,
    and otherwise both sides shuffle on the name with oversized names split.
    """
    return mentions.join(
        software, mentions["softwareId"] == software["normalizedForm"], "left"
    )
