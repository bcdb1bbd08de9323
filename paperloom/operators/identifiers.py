"""Paper-identifier records: text form to stored form, back, and the check between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import identifiers as ids
from paperloom.functions.once import once

FIELDS = ("id", "doi", "arxiv", "pmid", "pmcid", "istexId", "resources", "license", "oa_link")


def _parsed(rows: DataFrame) -> DataFrame:
    """Add ``stored``, the record in stored form, and ``errors``, the fields that have none."""
    c = F.col

    def text(name):
        return F.coalesce(c(name), F.lit(""))

    record = F.struct(
        ids.uuid_to_bytes(text("id")).alias("id"),
        text("doi").alias("doi"),
        text("arxiv").alias("arxiv"),
        ids.parse_pmid(c("pmid")).alias("pmid"),
        ids.parse_pmcid(c("pmcid")).alias("pmcid"),
        ids.parse_istex(c("istexId")).alias("istex_id"),
        ids.resource_codes(c("resources")).alias("resources"),
        ids.licence_code(c("license")).alias("license"),
        text("oa_link").alias("oa_link"),
    )
    failing = {
        "id": c("stored.id").isNull(),
        "pmid": ids.present(c("pmid")) & c("stored.pmid").isNull(),
        "pmcid": ids.present(c("pmcid")) & c("stored.pmcid").isNull(),
        "istexId": ids.present(c("istexId")) & c("stored.istex_id").isNull(),
        "resources": F.exists("stored.resources", lambda code: code.isNull()),
        "license": c("stored.license").isNull(),
    }
    errors = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in failing.items()]))
    return once(once(rows, stored=record), errors=errors)


def paper_id_errors(rows: DataFrame) -> DataFrame:
    """Rows that cannot be stored, with ``errors`` naming every failing field."""
    return _parsed(rows).where(F.size("errors") > 0).drop("stored")


def normalise_paper_ids(rows: DataFrame, strict: bool = False) -> DataFrame:
    """The stored form of every good row; ``strict`` raises at the first bad one."""
    return _good(rows, strict).select("stored.*")


def _good(rows: DataFrame, strict: bool = False) -> DataFrame:
    good = F.size("errors") == 0
    if strict:
        message = F.concat_ws(" ", F.lit("bad fields:"), F.array_join("errors", ","), F.lit("in"), "id")
        good = F.when(good, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return _parsed(rows).where(good)


def denormalise_paper_ids(stored: DataFrame) -> DataFrame:
    """The text form of stored rows, licences by their canonical label."""
    c = F.col
    return stored.select(
        ids.bytes_to_uuid(c("id")).alias("id"),
        "doi",
        "arxiv",
        ids.format_pmid(c("pmid")).alias("pmid"),
        ids.format_pmcid(c("pmcid")).alias("pmcid"),
        ids.format_istex(c("istex_id")).alias("istexId"),
        ids.resource_names(c("resources")).alias("resources"),
        ids.licence_label(c("license")).alias("license"),
        "oa_link",
    )


def drop_oa_link(stored: DataFrame, include: bool = True) -> DataFrame:
    return stored if include else stored.withColumn("oa_link", F.lit(""))


def roundtrip_mismatches(rows: DataFrame) -> DataFrame:
    """(id, field, before, after) where storing and rebuilding a good row changes a field.

    Licences are compared by code, so two spellings of one licence are equal; a missing
    list equals an empty one.
    """
    def text(name):
        return F.coalesce(F.col(name), F.lit(""))

    def stored(name):
        return F.col("stored")[name]

    label = ids.licence_label(stored("license"))
    names = F.coalesce("resources", F.array().cast("array<string>"))
    rebuilt_names = ids.resource_names(stored("resources"))
    pairs = {
        "id": (text("id"), ids.bytes_to_uuid(stored("id"))),
        "pmid": (text("pmid"), ids.format_pmid(stored("pmid"))),
        "pmcid": (text("pmcid"), ids.format_pmcid(stored("pmcid"))),
        "istexId": (text("istexId"), ids.format_istex(stored("istex_id"))),
        "resources": (F.array_join(names, ","), F.array_join(rebuilt_names, ",")),
        "license": (text("license"), label),
    }
    same = {name: before.eqNullSafe(after) for name, (before, after) in pairs.items()}
    same["license"] = stored("license").eqNullSafe(ids.licence_code(label))
    differences = [
        F.when(
            ~same[name],
            F.struct(F.lit(name).alias("field"), before.alias("before"), after.alias("after")),
        )
        for name, (before, after) in pairs.items()
    ]
    compared = once(_good(rows), _diff=F.array_compact(F.array(*differences)))
    return compared.select("id", F.inline("_diff"))
