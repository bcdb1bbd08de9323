"""The programs of the engine: each reads a source, applies operators and writes its output."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import places
from paperloom.functions.once import once
from paperloom.operators import identifiers, licences, maintenance, mentions, ordering, pairs, profile
from paperloom.sources import documents, ledger, sinks, typed
from paperloom.session import job_folder, stage


def compact(
    spark: SparkSession,
    root: str,
    out: str,
    kinds: Iterable[str] | None = None,
    shards: Iterable[str] | None = None,
    strict: bool = False,
) -> DataFrame:
    """Tree of JSON files to gzip JSON lines per shard and kind. Returns the rejects.

    ``strict`` writes nothing if a document is unreadable, and says how many are.

    The files are read once and parsed once: rejects come from the same pass over the staged
    texts as the output, so they belong to the same state of the tree. ``out`` must be new.
    """
    if not ledger.merged(spark, out).isEmpty():
        raise ValueError(f"has documents already: {out}")
    read = stage(_with_digest(documents.scan_documents(spark, root, kinds, shards)), "documents")
    good, bad = documents.rewritten(read)
    if strict and (n := bad.count()):
        raise ValueError(f"{n} documents that are not JSON objects")
    batch = ledger.begin(good, out)
    sinks.write_merged(good, out, mode="append")
    ledger.commit(spark, out, batch)
    return bad.drop("digest")


def _with_digest(docs: DataFrame) -> DataFrame:
    return docs.withColumn("digest", ledger.content_digest(F.col("body")))


def compact_new(
    spark: SparkSession,
    root: str,
    out: str,
    rejects: str,
    kinds: Iterable[str] | None = None,
    shards: Iterable[str] | None = None,
) -> None:
    """The same for documents that ``out`` does not have yet; it may not exist.

    What is done is what the output's ledger has: a document counts as merged when its
    (paper_id, kind) is there, whatever the age of its file. No merged text is read. Run it for
    one range of ``shards`` after the other on a large tree. Unreadable documents go to the
    Parquet table ``rejects``, once.
    """
    append_new(documents.scan_documents(spark, root, kinds, shards), out, rejects)


#: Column of documents that came in several batches, by number.
BATCH = "batch"


def append_new(docs: DataFrame, out: str, rejects: str, written: bool = False) -> None:
    """Append the documents that ``out`` lacks, and list the unreadable ones that ``rejects``
    lacks. Of the ledger, only the shards of ``docs`` are read.

    ``written`` says that ``docs`` is a table already. What is staged on the way is removed at
    the end, as ``out`` and ``rejects`` then hold all of it. With a column ``batch`` the result
    is that of one append for each batch, in the order of their numbers.
    """
    spark = docs.sparkSession
    with job_folder(spark):
        docs = docs if written and places.known(docs) else stage(docs, "documents", "zstd")
        shards = [r["shard"] for r in docs.select("shard").distinct().collect()]
        done = ledger.merged(spark, out, shards)
        new = places.with_places(docs)
        # which documents are new is written before anything is appended to what decides it
        new = new if done.isEmpty() else maintenance.pending_of_table(new, done)
        if BATCH in docs.columns:
            # several steps look for the first batch of a document, so these are parsed once
            good, bad = _first_batches(*documents.rewritten(_with_digest(new.select(docs.columns))))
        else:
            good, bad = documents.rewritten(_with_digest(new))
        known = _known_rejects(spark, rejects)
        bad = bad.drop("digest")
        if known is not None:
            bad = stage(bad.join(known, ["shard", "file"], "left_anti"), "rejects", "zstd")
        bad.write.mode("append").option("compression", "zstd").parquet(rejects)
        batch = ledger.begin(good, out)
        sinks.write_merged(good, out, mode="append")
        ledger.commit(spark, out, batch)


def _first_batches(good: DataFrame, bad: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left of both when a document is done with the first batch that has it readable,
    and a file is rejected once."""
    key, first = ["paper_id", "kind"], F.min(BATCH).alias("_first")
    done = stage(good.groupBy(key).agg(first), "first-batches")
    unread = bad.join(done, key, "left").where(f"_first is null or {BATCH} <= _first").drop("_first")
    refused = unread.groupBy("shard", "file").agg(first)
    unread = unread.join(refused, ["shard", "file"]).where(f"{BATCH} = _first")
    kept = good.join(done, key).where(f"{BATCH} = _first")
    return kept.drop(BATCH, "_first"), unread.drop(BATCH, "_first").select([c for c in bad.columns if c != BATCH])


def _known_rejects(spark: SparkSession, rejects: str) -> DataFrame | None:
    try:
        return spark.read.parquet(rejects).select("shard", "file")
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def pending(
    spark: SparkSession, root: str, merged: str, shards: Iterable[str] | None = None
) -> DataFrame:
    """Source files that compaction has not taken in yet. Opens no file."""
    source = documents.list_documents(spark, root, shards)
    return maintenance.pending_documents(source, ledger.merged(spark, merged, shards))


def processed(
    spark: SparkSession, root: str, merged: str, shards: Iterable[str] | None = None
) -> DataFrame:
    """Source files that may be removed, as what they hold now is in the merged output.

    Reads the files, as one that was changed after it was merged must stay; see ``changed``.
    """
    source = _with_digest(documents.scan_documents(spark, root, shards=shards)).drop("body")
    return maintenance.unchanged_documents(source, ledger.merged(spark, merged, shards))


def changed(
    spark: SparkSession, root: str, merged: str, shards: Iterable[str] | None = None
) -> DataFrame:
    """Source files that were merged with other content than they have now."""
    source = _with_digest(documents.scan_documents(spark, root, shards=shards)).drop("body")
    return maintenance.changed_documents(source, ledger.merged(spark, merged, shards))


def removable(spark: SparkSession, root: str, shards: Iterable[str] | None = None) -> DataFrame:
    """Source files in shard directories whose name is that of a known kind."""
    listed = documents.list_documents(spark, root, shards)
    return maintenance.removable_by_name(listed.where("shard <> ''"))


def profile_path(
    spark: SparkSession,
    path: str,
    max_depth: int | None = None,
    strict: bool = False,
    spread: int | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Profile of one .jsonl or .jsonl.gz file, or of the shard files of a directory.

    ``spread`` deals the lines of gzip files, each read in one task, over more tasks.
    """
    one_file = path.endswith((".jsonl", ".jsonl.gz"))
    if one_file:
        lines = documents.scan_jsonl(spark, path, spread)
    else:
        lines = documents.scan_shards(spark, path, spread=spread)
    return profile_json(lines, max_depth, strict)


def profile_json(
    lines: DataFrame, max_depth: int | None = None, strict: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(field_profile, field_values, rejects) of JSON bodies.

    Documents beyond the engine's limits are walked by themselves and count like all others.
    ``rejects`` are the bodies that are not JSON objects, as found; ``strict`` stops at them.
    """
    read = documents.parsed(lines)
    leaves = profile.flatten_json(read.where(F.col("doc").isNotNull()).select("doc"), max_depth)
    unread = stage(read.where(F.col("doc").isNull()).drop("doc"), "unread")
    beyond = documents.beyond_limits(F.col("body"))
    large = profile.flatten_large(unread.where(beyond), max_depth)
    refused = large.where("kind = 'refused'").withColumn("body", F.col("str"))
    rejects = unread.where(~beyond).unionByName(refused.select(*unread.columns))
    if strict and (n := rejects.count()):
        raise ValueError(f"{n} bodies that are not JSON objects: {rejects.first()['body'][:200]}")
    totals = profile.summarise(leaves.unionByName(large.where("kind <> 'refused'").select(*leaves.columns)))
    values = profile.field_values(totals)
    return profile.field_profile(totals, values, strict), values, rejects


def extract_software(
    spark: SparkSession, source, out: str, strict: bool = True, spread: int | None = None
) -> None:
    """JSON lines of mention documents to the mentions and software tables.

    ``spread`` deals the lines of gzip files, each read in one task, over more tasks; here and
    in ``extract_papers`` and ``sort_jsonl``.
    The mentions are staged between, so that the text is read and parsed once for both.
    Unreadable lines and mentions without a paper id stop the job, or are left out if not
    ``strict``.
    """
    exploded = mentions.explode_mentions(typed.scan_mentions_json(spark, source, strict, spread))
    has_id = F.coalesce(F.length("file") >= 36, F.lit(False))
    if strict:
        message = F.concat(F.lit("mention without a paper id: "), F.coalesce("file", F.lit("")))
        has_id = F.when(has_id, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    known = stage(exploded.where(has_id).drop("bad_body"), "mentions")
    sinks.write_tables(
        out,
        mentions=mentions.project_mentions(known),
        software=mentions.software_dimension(known, written=True),
    )


def extract_papers(
    spark: SparkSession, source, out: str, strict: bool = True, spread: int | None = None
) -> None:
    """JSON lines of paper documents to the papers table."""
    papers = typed.scan_papers(spark, source, strict, spread)
    sinks.write_tables(out, papers=mentions.project_papers(papers, strict))


def count_mentions(
    spark: SparkSession, folder: str, support: int = pairs.MIN_SUPPORT
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(number of frequent names, top 10 names, top 20 pairs) of a mentions table."""
    table = typed.read_table(spark, folder, "mentions")
    edges = stage(pairs.distinct_edges(pairs.stop_list_filter(table)), "edges")
    frequent = pairs.min_support(pairs.papers_per_software(edges), support)
    together = pairs.most_frequent_pairs(edges, support=support, written=True)
    return pairs.frequent_count(frequent), pairs.top_software(frequent), together


def convert_mentions(
    spark: SparkSession, root: str, out: str, counts: str | None = None, shards: Iterable[str] | None = None
) -> None:
    """Tree of mention documents, or some of its shards, to one record per document, and raw
    counts if asked for."""
    found = documents.scan_mention_files(spark, root, shards)
    sinks.write_paper_mentions(mentions.mentions_per_paper(typed.decode_mentions(found, strict=True)), out)
    if counts:
        named = typed.read_paper_mentions(spark, out).select(
            F.explode("mentions.normalized_form").alias("normalizedForm")
        )
        report = mentions.order_report(mentions.mention_counts(named), "normalizedForm")
        sinks.write_report(report, counts)


def convert_paper_ids(
    spark: SparkSession, source: str, out: str, oa_link: bool = True, strict: bool = True
) -> DataFrame:
    """Identifier JSON lines to stored records. Returns the round-trip mismatches.

    The rows are staged between, so that the source is read and parsed once for both.
    """
    rows = stage(typed.scan_paper_ids(spark, source, strict), "paper-ids")
    stored = identifiers.normalise_paper_ids(rows, strict)
    sinks.write_paper_ids(identifiers.drop_oa_link(stored, oa_link), out)
    return identifiers.roundtrip_mismatches(rows)


def count_licences(spark: SparkSession, path: str) -> DataFrame:
    return licences.licence_histogram(typed.read_paper_ids(spark, path))


def sort_jsonl(
    spark: SparkSession, source, out: str, on_duplicate: str = "keep", spread: int | None = None
) -> None:
    """JSON lines to gzip JSON lines ordered by the UUID in ``file``."""
    rows = once(documents.scan_jsonl(spark, source, spread), file=documents.file_key(F.col("body")))
    sinks.write_sorted_jsonl(
        ordering.sort_by_uuid(rows, on_duplicate=on_duplicate, strict=True), out
    )
