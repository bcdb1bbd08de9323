"""Readers for document trees and JSON lines, and the checks on what they hold.

A document frame has the text in ``body`` plus the columns that say where it came from.
Source order is the order of ``(file_path, block_start, line_pos)``: rows of one file are
numbered inside each block of the file, so the order does not depend on how Spark packs
blocks into tasks, and files of one name in two folders do not tie.
"""

from __future__ import annotations

import json
import math
import os
import re
import sys
from collections.abc import Iterable, Iterator
from itertools import islice
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions import files, places
from paperloom.functions.once import once
from paperloom.session import stage

SOURCE_ORDER = ("file_path", "block_start", "line_pos")
# What the engine's JSON parser takes: characters of one string, and nested levels.
MOST_CHARACTERS = 20_000_000
MOST_LEVELS = 1000
SHARD_NAME = r"[0-9a-f]{2}\.software\.jsonl\.gz"


def scan_documents(
    spark: SparkSession,
    root: str,
    kinds: Iterable[str] | None = None,
    shards: Iterable[str] | None = None,
) -> DataFrame:
    """One JSON object per file below ``root/<shard>/``: (shard, file, kind, paper_id, body),
    for files whose name is that of a known kind.
    """
    docs = scan_tree(spark, root, shards).where(F.col("kind").isNotNull())
    return docs if kinds is None else docs.where(F.col("kind").isin(list(kinds)))


def scan_mention_files(
    spark: SparkSession, root: str, shards: Iterable[str] | None = None
) -> DataFrame:
    """The same for all names ending ``.software.json`` that start with 36 characters."""
    name = F.col("file")
    return scan_tree(spark, root, shards).where(files.is_mention_file(name) & files.has_id_length(name))


def scan_tree(spark: SparkSession, root: str, shards: Iterable[str] | None = None) -> DataFrame:
    """Every ``.json`` file below ``root``, one row per file; ``kind`` is NULL for other names.

    Tasks list the directories and read the files, so the driver holds the names in ``root``
    only. ``shards`` lists only those directories, which bounds one run over a tree with
    billions of files.
    """
    listed = _listed(spark, root, shards)
    if listed is not None:
        read = listed.mapInArrow(_read_files, "file_path string, file string, value binary")
        return _named(read.withColumn("value", F.col("value").cast("string")), root)
    raw = (
        spark.read.format("text")
        .option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .load(_tree_paths(root, shards))
    )
    return described(raw, root)


def list_documents(spark: SparkSession, root: str, shards: Iterable[str] | None = None) -> DataFrame:
    """``scan_documents`` without the bodies: a listing that opens no file."""
    listed = _listed(spark, root, shards)
    if listed is not None:
        found = _named(listed.withColumn("value", F.lit("")), root)
    else:
        raw = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", "*.json")
            .load(_tree_paths(root, shards))
        )
        found = described(raw.withColumn("value", F.lit("")), root)
    return found.where(F.col("kind").isNotNull()).drop("body")


def _tree_paths(root: str, shards: Iterable[str] | None) -> list[str]:
    base = root.rstrip("/")
    return [f"{base}/{name}" for name in shards] if shards is not None else [root]


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over as well."""
    return name.startswith((".", "_")) or name.endswith("._COPYING_")


def _listed(spark: SparkSession, root: str, shards: Iterable[str] | None) -> DataFrame | None:
    """(file_path, file) of the ``.json`` files of a tree; None if only Spark's own readers know
    the file system or if the root is a pattern.

    One row per directory in the root is dealt out; a task lists all below it. The names found
    are dealt out again, so a shard with most files is read by all tasks.
    """
    local = root.startswith("file:/") or (
        ":" not in root.partition("/")[0] and spark.sparkContext.master.startswith("local")
    )
    if not local or any(c in root for c in "*?[{") or (top := _local(root)) is None:
        return None
    folders, names = [f"{top}/{name}" for name in shards] if shards is not None else [top], []
    if shards is None:
        if not os.path.isdir(top):
            return None
        with os.scandir(top) as found:
            entries = [(e.name, e.is_dir()) for e in found if not _hidden(e.name) and (e.is_dir() or e.stat().st_size)]
        folders = [f"{top}/{name}" for name, is_dir in entries if is_dir]
        names = [f"{top}/{name}" for name, is_dir in entries if not is_dir and name.endswith(".json")]
    elif not all(os.path.isdir(f) for f in folders):
        return None  # the reader's own error
    rows = [(f, True) for f in folders] + [(f, False) for f in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, is_dir in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = _files_below(path) if is_dir else iter([path])
                while some := list(islice(found, 10_000)):
                    yield pa.RecordBatch.from_pydict(
                        {
                            "file_path": [f"file://{quote(p, safe=files.PLAIN_IN_PATH)}" for p in some],
                            "file": [p.rpartition("/")[2] for p in some],
                        }
                    )

    tasks = spark.sparkContext.defaultParallelism
    places = spark.createDataFrame(rows, "path STRING, is_dir BOOLEAN").repartition(tasks, "path")
    return places.mapInArrow(run, "file_path string, file string").repartition("file_path")


def _local(root: str) -> str | None:
    path = re.sub(r"^file:(//)?", "", root)
    return os.path.abspath(path) if not path.startswith("//") else None


def _files_below(folder: str) -> Iterator[str]:
    """The ``.json`` files below a folder; as with Spark's readers, empty ones have no row."""
    with os.scandir(folder) as found:
        for e in found:
            if _hidden(e.name):
                continue
            if e.is_dir():
                yield from _files_below(e.path)
            elif e.name.endswith(".json") and e.stat().st_size:
                yield e.path


#: Bytes of texts in one batch of ``_read_files``, if it is more than one text.
_BATCH_BYTES = 4 << 20


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add ``value``, the whole file as it is."""
    names = ["file_path", "file", "value"]

    kinds = (pa.string(), pa.string(), pa.binary())

    def made(rows: list[tuple[str, str, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for batch in batches:
        rows, size = [], 0
        for path, file in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            with open(unquote(path.removeprefix("file://")), "rb") as source:
                text = source.read()
            rows.append((path, file, text))
            size += len(text)
            if size > _BATCH_BYTES:
                yield made(rows)
                rows, size = [], 0
        if rows:
            yield made(rows)


def described(raw: DataFrame, root: str) -> DataFrame:
    """Name columns for a whole-file text scan, batch or stream."""
    return _named(
        raw.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file"), "value"),
        root,
    )


def _named(found: DataFrame, root: str) -> DataFrame:
    name = F.col("file")
    return found.select(
        files.shard(F.col("file_path"), root).alias("shard"),
        "file",
        files.classify_kind(name).alias("kind"),
        files.paper_id(name).alias("paper_id"),
        F.col("value").alias("body"),
    )


def scan_jsonl(spark: SparkSession, path, spread: int | None = None, **options) -> DataFrame:
    """JSON lines, plain or gzip: (file_path, block_start, line_pos, body).

    ``path`` is a file, a directory, or a list of them (read as one stream of rows).
    A gzip file is one task however large it is; ``spread`` redistributes its lines when
    the work after the scan outweighs a shuffle of the text.
    """
    lines = (
        spark.read.options(**options)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_block_start").alias("block_start"),
            F.monotonically_increasing_id().alias("line_pos"),
            F.col("value").alias("body"),
        )
        .where(F.trim("body") != "")
    )
    return lines.repartition(spread) if spread else lines


def scan_shards(
    spark: SparkSession, root: str, name_regex: str = SHARD_NAME, spread: int | None = None
) -> DataFrame:
    """JSON lines of the shard files below ``root``.

    The pattern may match anywhere in a name and is asked of every directory on the way too.
    """
    names = F.split(files.relative_path(F.col("_metadata.file_path"), root), "/")
    raw = (
        spark.read.option("recursiveFileLookup", True)
        .text(root)
        .where(F.forall(names, lambda part: part.rlike(name_regex)))
    )
    lines = raw.select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line_pos"),
        F.col("value").alias("body"),
    ).where(F.trim("body") != "")
    return lines.repartition(spread) if spread else lines


def scan_merged(spark: SparkSession, path: str) -> DataFrame:
    """Compacted documents as ``write_merged`` leaves them; shard and kind prune directories."""
    return (
        spark.read.schema("value STRING, shard STRING, kind STRING")
        .text(path)
        .withColumnRenamed("value", "body")
    )


# --- checks -----------------------------------------------------------------------------


def parsed(docs: DataFrame) -> DataFrame:
    """Add ``doc``: the body as a VARIANT object, NULL unless the body is a JSON object.

    With duplicate keys the last one counts. A number too large for a double is an error, as
    it would otherwise become the text "Infinity"; only bodies with such long numbers are
    looked at for it. Hexadecimal digits within a name are none: a number follows a sign or blank.
    """
    docs.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    value = F.try_parse_json("body")
    read = once(docs, doc=F.when(F.ltrim("body").startswith("{"), value))
    infinite = F.lit('"-?Infinity"')
    overflows = F.regexp_count(F.to_json("doc"), infinite) > F.regexp_count("body", infinite)
    suspect = F.col("body").rlike(r"[\[,:\s]-?[0-9](?:[0-9.]*+[eE][+]?[0-9]{3}|[0-9.]{308})")
    return once(read, doc=F.when(~F.coalesce(suspect & overflows, F.lit(False)), F.col("doc")))


def drop_malformed(docs: DataFrame) -> DataFrame:
    """Documents whose body is an object; the others are what ``rejects`` returns."""
    return _with_doc(docs).where(F.col("doc").isNotNull())


def rejects(docs: DataFrame) -> DataFrame:
    """Documents whose body is not a JSON object, with the text as found."""
    return _with_doc(docs).where(F.col("doc").isNull()).drop("doc")


def fail_on_malformed(docs: DataFrame) -> DataFrame:
    """Stop the job at the first body that is not a JSON object."""
    message = F.concat(F.lit("not a JSON object: "), F.substring("body", 1, 200))
    return _with_doc(docs).withColumn(
        "doc", F.coalesce("doc", F.raise_error(message).cast("variant"))
    )


def counted(docs: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """The documents whose body is an object, staged, and how many were read and which rules
    they break: the counters of a strict run.

    The counters are kept while the documents are written, so nothing is read for them, and
    they speak of all documents, not of the first bad one. Spark adds what each task of the
    write has seen; a task that is run again counts once.
    """
    seen = Observation("strict")
    read = _with_doc(docs)
    name = F.try_variant_get("doc", "$.file", "string")
    broken = {
        "malformed": F.col("doc").isNull(),
        "blank": F.trim("body") == "",
        "without_kind": files.classify_kind(F.col("file")).isNull(),
        "without_paper_id": files.paper_id(F.col("file")).isNull(),
        "other_file_key": name.isNotNull() & (name != F.col("file")),
    }
    counts = [F.count_if(rule).alias(rule_name) for rule_name, rule in broken.items()]
    good = stage(read.observe(seen, F.count("*").alias("documents"), *counts).where(F.col("doc").isNotNull()), "counted")
    return good, seen.get


def _with_doc(docs: DataFrame) -> DataFrame:
    return docs if "doc" in docs.columns else parsed(docs)


def with_provenance(docs: DataFrame) -> DataFrame:
    """Set the key ``file`` of every object to the base name, whatever it held before.

    Returns the documents with ``body`` replaced by the rewritten JSON text.
    """
    return docs.withColumn("body", _with_own_name(F.col("doc"))).drop("doc")


def _with_own_name(doc: Column) -> Column:
    members = F.map_filter(doc.cast("map<string,variant>"), lambda key, _: key != "file")
    own = F.create_map(F.lit("file"), F.col("file").cast("variant"))
    return F.to_json(F.map_concat(members, own))


def beyond_limits(body: Column) -> Column:
    """Objects that the engine's parser may give up on: strings beyond 20 million characters,
    more than 1000 levels."""
    brackets = F.length(body) - F.length(F.translate(body, "[{", ""))
    large = F.ltrim(body).startswith("{") & ((F.length(body) > MOST_CHARACTERS) | (brackets > MOST_LEVELS))
    # the size is known, the rest is counted
    return F.coalesce((F.octet_length(body) > MOST_LEVELS) & large, F.lit(False))


def converted(docs: DataFrame) -> DataFrame:
    """Documents with ``text``, their JSON with the key ``file`` set, in place of ``body``; of
    those that are not JSON objects ``text`` is NULL and ``body`` is as found. Staged, so each
    document is parsed once.

    Bodies that are ``beyond_limits`` are read again by Python's parser, which has no such
    limits; they are few, and all others never leave the engine.
    """
    read = _with_doc(docs)
    rewritten_body = with_provenance(read.withColumn("_raw", F.col("body"))).withColumnRenamed("body", "text")
    found = once(rewritten_body, text=F.col("text"))
    keep = [c for c in found.columns if c not in ("_raw", "text")]
    found = stage(
        found.select(*keep, F.when(F.col("text").isNull(), F.col("_raw")).alias("body"), "text"),
        "converted",
        "zstd",
    )
    beyond = F.col("text").isNull() & beyond_limits(F.col("body"))
    names = found.columns
    at, name_at = names.index("body"), names.index("file")

    def read_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one at a time: each may be very large
                row = batch.slice(i, 1)
                body = row.column(at)[0].as_py()
                text = with_file_key(body, row.column(name_at)[0].as_py())
                new = {"text": text, "body": body if text is None else None}
                columns = [pa.array([new[n]], pa.string()) if n in new else row.column(k) for k, n in enumerate(names)]
                yield pa.RecordBatch.from_arrays(columns, names)

    again = stage(found.where(beyond).mapInArrow(read_again, found.schema), "large-documents")
    return found.where(~beyond).unionByName(again)


def rewritten(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects): the first with the key ``file`` set in their ``body``, the second
    with the body as found.

    Of ``docs`` with places in a table (see ``places``) no text is staged but those that may be
    beyond the parser's limits: the documents are parsed once to tell which are JSON objects, a
    bit each, and where their new text is asked for.
    """
    if places.ROW not in docs.columns:
        return _split(converted(docs))
    keep = [c for c in docs.columns if c not in (places.FILE, places.ROW)]
    beyond = beyond_limits(F.col("body"))
    large = _split(converted(docs.where(beyond).select(keep)))
    small = docs.where(~beyond)
    read = parsed(small.select(places.FILE, places.ROW, "body"))
    readable = places.bits(read, readable=F.col("doc").isNotNull())
    text = _with_own_name(F.try_parse_json("body")).alias("body")
    good = places.at(small, readable, F.col("readable")).select([text if c == "body" else c for c in keep])
    bad = places.at(small, readable, ~F.col("readable")).select(keep)
    return good.unionByName(large[0]), bad.unionByName(large[1])


def _split(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = found.where(F.col("text").isNotNull()).withColumn("body", F.col("text")).drop("text")
    return good, found.where(F.col("text").isNull()).drop("text")


def with_file_key(body: str, file: str) -> str | None:
    """The text of a JSON object with its key ``file`` set; None if it is not an object."""

    def finite(text: str) -> float:
        if math.isinf(value := float(text)):
            raise ValueError(text)
        return value

    def refuse(text: str):
        raise ValueError(text)

    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 1_000_000))
    try:
        value = json.loads(body, parse_float=finite, parse_constant=refuse)
        if not isinstance(value, dict):
            return None
        if "file" in value:
            # the key goes to the end, as in other documents
            del value["file"]
            body = json.dumps(value, ensure_ascii=False)
    except (ValueError, RecursionError):
        return None
    finally:
        sys.setrecursionlimit(limit)
    key = f'"file":{json.dumps(file, ensure_ascii=False)}}}'
    return body.rstrip()[:-1] + ("," if value else "") + key


def decode(docs: DataFrame, ddl: str, strict: bool = False) -> DataFrame:
    """Typed projection of ``body``: the columns of ``ddl`` plus ``bad_body``.

    ``bad_body`` is NULL for a good row and the text otherwise; ``strict`` raises instead.
    A column that ``docs`` has already, such as the ``file`` of a tree scan, stays as it is.
    """
    if strict:
        record = F.from_json("body", ddl, {"mode": "FAILFAST"})
        bad: Column = F.lit(None).cast("string")
    else:
        record = F.from_json("body", ddl + ", _bad STRING", {"columnNameOfCorruptRecord": "_bad"})
        bad = F.when(F.col("_record").isNull(), F.col("body")).otherwise(F.col("_record._bad"))
    keep = [c for c in docs.columns if c not in ("body", "doc")]
    names = [n for n in T.StructType.fromDDL(ddl).fieldNames() if n not in keep]
    return once(docs, _record=record).select(
        *keep, *[F.col("_record")[n].alias(n) for n in names], bad.alias("bad_body")
    )


def file_key(body: Column) -> Column:
    """The value of the key ``file`` in a JSON object's text."""
    return F.from_json(body, "file STRING")["file"]
