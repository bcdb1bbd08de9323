"""File-name expressions: kind, paper id, shard."""

from __future__ import annotations

import re
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.schemas import KIND_BY_SUFFIX, literal_map

UUID_RE = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"

#: What stays as it is in the path of a file URI.
PLAIN_IN_PATH = "/!$&'()*+,;=:@~-._"


def file_suffix(file: Column) -> Column:
    """Everything after the leading UUID; empty when the name does not start with one."""
    return F.regexp_extract(file, f"^{UUID_RE}(\\..*)$", 1)


def classify_kind(file: Column) -> Column:
    """Document kind by exact suffix after the UUID; NULL for any other name."""
    return F.try_element_at(literal_map(KIND_BY_SUFFIX), file_suffix(file))


def is_mention_file(file: Column) -> Column:
    """Names ending ``.software.json``, whatever tool produced them."""
    return F.endswith(file, F.lit(".software.json"))


def has_id_length(file: Column) -> Column:
    """True when the part before the first dot has the 36 characters of a UUID."""
    return F.length(F.substring_index(file, ".", 1)) == 36


def paper_id(file: Column) -> Column:
    """The first 36 characters; NULL for shorter names, so the row can be rejected."""
    return F.when(F.length(file) >= 36, F.substring(file, 1, 36))


def packed_name(name: Column) -> Column:
    """A string in as few bytes as it can be shuffled in: a leading UUID takes 16 bytes instead
    of 36, which no codec of a shuffle does. ``unpacked_name`` gives the string again."""
    has_uuid = name.rlike(f"^{UUID_RE}")
    digits = F.unhex(F.translate(F.substring(name, 1, 36), "-", ""))
    rest = F.substr(name, F.lit(37)).cast("binary")
    return F.when(has_uuid, F.concat(F.lit(b"u"), digits, rest)).otherwise(F.concat(F.lit(b"-"), name.cast("binary")))


def unpacked_name(packed: Column) -> Column:
    h = F.lower(F.hex(F.substr(packed, F.lit(2), F.lit(16))))
    cuts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    rest = F.substr(packed, F.lit(18)).cast("string")
    whole = F.substr(packed, F.lit(2)).cast("string")
    return F.when(F.substr(packed, F.lit(1), F.lit(1)) == F.lit(b"u"), F.concat(F.concat_ws("-", *cuts), rest)).otherwise(whole)


def root_pattern(root: str) -> str:
    """Regex for ``root`` as it occurs inside ``_metadata.file_path``."""
    path = re.sub(r"^[A-Za-z][\w+.-]*:(//[^/]*)?", "", root)
    path = re.sub(r"/+", "/", path).rstrip("/")
    path = path[2:] if path.startswith("./") else path
    return "\\Q" + quote(path, safe=PLAIN_IN_PATH) + "\\E/+"


def relative_path(file_path: Column, root: str) -> Column:
    return F.regexp_extract(file_path, root_pattern(root) + "(.*)$", 1)


def shard(file_path: Column, root: str) -> Column:
    """The top-level directory below ``root``; empty for files directly in it."""
    return F.regexp_extract(file_path, root_pattern(root) + "([^/]+)/", 1)
