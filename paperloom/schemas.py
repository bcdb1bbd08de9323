"""Record shapes, table schemas and the fixed vocabularies of the data model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- typed projections of JSON documents (unknown keys are not read) -------------

MENTION_DOC = """
file STRING,
mentions ARRAY<STRUCT<
  `software-name`: STRUCT<normalizedForm: STRING, wikidataId: STRING>,
  `software-type`: STRING>>
"""

PAPER_DOC = "file STRING, year INT"

PAPER_ID_DOC = """
id STRING, doi STRING, arxiv STRING, pmid STRING, pmcid STRING, istexId STRING,
resources ARRAY<STRING>, license STRING, oa_link STRING
"""

# --- stored tables ------------------------------------------------------------------

PAPERS = "uuid STRING, year INT"
SOFTWARE = "normalizedForm STRING, wikidataId STRING, softwareType STRING"
MENTIONS = "paperId STRING, softwareId STRING"
PAPER_IDS = """
id BINARY, doi STRING, arxiv STRING, pmid BIGINT, pmcid BIGINT, istex_id BINARY,
resources ARRAY<INT>, license INT, oa_link STRING
"""
PAPER_MENTIONS = """
id BINARY, mentions ARRAY<STRUCT<normalized_form: STRING, wikidata_id: STRING>>
"""

TABLES = {"papers": PAPERS, "software": SOFTWARE, "mentions": MENTIONS}

# --- fixed values: document kinds by file-name suffix -----------------------------------

KIND_BY_SUFFIX = {
    ".json": "paper",
    ".software.json": "software",
    ".jats.software.json": "jats",
    ".pub2tei.tei.software.json": "pub2tei",
    ".latex.tei.software.json": "latex",
    ".grobid.tei.software.json": "grobid",
}
KINDS = tuple(KIND_BY_SUFFIX.values())

# --- fixed values: generic names that are not counted as software --------------------------

STOP_WORDS = (
    "script",
    "code",
    "scripts",
    "survival",
    "library",
    "software",
    "interface",
    "program",
)

# --- fixed values: licence code, canonical label, other accepted spelling ---------------------

LICENCES = (
    (0, "", None),
    (1, "cc-by", "CC BY"),
    (2, "cc-by-nc-nd", "CC BY-NC-ND"),
    (3, "cc-by-nc", "CC BY-NC"),
    (4, "arXiv", None),
    (5, "cc-by-nc-sa", "CC BY-NC-SA"),
    (6, "cc-by-sa", "CC BY-SA"),
    (7, "cc0", "CC0"),
    (8, "elsevier-specific: oa user license", None),
    (9, "implied-oa", None),
    (10, "pd", None),
    (11, "NO-CC CODE", None),
    (12, "cc-by-nd", "CC BY-ND"),
    (13, "publisher-specific license", None),
    (14, "publisher-specific, author manuscript", None),
    (15, "acs-specific: authorchoice/editors choice usage agreement", None),
    (16, "Open Government Licence - Canada", None),
)

# --- fixed values: resource names and their stored codes -----------------------------------

RESOURCE_CODES = {"json": 1, "pdf": 2, "latex": 3, "xml": 4}


def literal_map(pairs: dict) -> Column:
    """A constant map column."""
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def licence_dimension(spark: SparkSession) -> DataFrame:
    """(code, label, alias): the 17 licence rows as a DataFrame."""
    rows = F.array(
        *[
            F.struct(
                F.lit(code).alias("code"),
                F.lit(label).alias("label"),
                F.lit(alias).cast("string").alias("alias"),
            )
            for code, label, alias in LICENCES
        ]
    )
    return spark.range(1).select(F.inline(rows))
