"""Codecs for paper identifiers, resources and licences.

Parsers give NULL both for a missing value (``''`` or NULL) and for a bad one; ``present``
tells them apart.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.schemas import LICENCES, RESOURCE_CODES, literal_map

_HEX_UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
# canonical, urn:uuid: prefix, in braces, 32 bare hex digits
_UUID_FORMS = f"^(?:(?i:urn:uuid:)?{_HEX_UUID}|\\{{{_HEX_UUID}\\}}|[0-9a-fA-F]{{32}})$"
_MAX_INT32 = 2147483647


def present(s: Column) -> Column:
    return F.coalesce(s, F.lit("")) != ""


# --- UUID -------------------------------------------------------------------------


def uuid_to_bytes(s: Column) -> Column:
    """16 bytes, or NULL when ``s`` is not a UUID in one of the four written forms."""
    digits = F.regexp_replace(s, "^(?i:urn:uuid:)|[{}-]", "")
    return F.when(s.rlike(_UUID_FORMS), F.unhex(digits))


def bytes_to_uuid(b: Column) -> Column:
    """Canonical lower-case text of 16 bytes."""
    h = F.lower(F.hex(b))
    parts = [h.substr(1, 8), h.substr(9, 4), h.substr(13, 4), h.substr(17, 4), h.substr(21, 12)]
    return F.when(F.length(b) == 16, F.concat_ws("-", *parts))


# --- PubMed numbers -------------------------------------------------------------------


def _number(digits: Column) -> Column:
    """A signed decimal that fits 32 bits and is not negative."""
    n = F.when(digits.rlike("^[+-]?[0-9]+$"), digits.try_cast("decimal(38,0)"))
    return F.when(n.between(0, _MAX_INT32), n.cast("long"))


def parse_pmid(s: Column) -> Column:
    return F.when(present(s), _number(s))


def format_pmid(n: Column) -> Column:
    return F.coalesce(n.cast("string"), F.lit(""))


def parse_pmcid(s: Column) -> Column:
    """The number after the first three characters, which are not checked."""
    return F.when(present(s), _number(F.substr(s, F.lit(4))))


def format_pmcid(n: Column) -> Column:
    return F.coalesce(F.concat(F.lit("PMC"), n.cast("string")), F.lit(""))


# --- ISTEX ----------------------------------------------------------------------------


def parse_istex(s: Column) -> Column:
    return F.when(s.rlike("^[0-9a-fA-F]{40}$"), F.unhex(s))


def format_istex(b: Column) -> Column:
    return F.coalesce(F.hex(b), F.lit(""))


# --- resources ---------------------------------------------------------------------------


def resource_codes(names: Column) -> Column:
    """Codes of the names, in order; an unknown name gives a NULL element."""
    codes = literal_map(RESOURCE_CODES)
    return F.transform(
        F.coalesce(names, F.array().cast("array<string>")),
        lambda name: F.try_element_at(codes, name),
    )


def resource_names(codes: Column) -> Column:
    names = literal_map({code: name for name, code in RESOURCE_CODES.items()})
    return F.transform(codes, lambda code: F.try_element_at(names, code))


# --- licences ---------------------------------------------------------------------------


def licence_code(spelling: Column) -> Column:
    """Code of an exact, case-sensitive spelling; NULL when it is not known."""
    codes = {label: code for code, label, _ in LICENCES}
    codes.update({alias: code for code, _, alias in LICENCES if alias})
    return F.try_element_at(literal_map(codes), F.coalesce(spelling, F.lit("")))


def licence_label(code: Column) -> Column:
    return F.try_element_at(literal_map({code: label for code, label, _ in LICENCES}), code)
