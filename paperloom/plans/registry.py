"""One query per operator over the given tables: ``QUERIES[name](spark, sf_dir)``."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import files
from paperloom.functions import identifiers as ids
from paperloom.functions.numbers import fits_float32, is_integral
from paperloom.functions.once import once
from paperloom.operators import identifiers, licences, maintenance, mentions, ordering, pairs, profile
from paperloom.plans import jobs, views
from paperloom.session import configure, stage, staging_path
from paperloom.sources import documents, ledger, sinks, typed
from paperloom.streaming.ingest import ingest_new_documents

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

VIEW_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "mention_pos")


def query(fn: Query) -> Query:
    @wraps(fn)
    def configured(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir.rstrip("/"))

    QUERIES[fn.__name__] = configured
    return configured


def _exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = typed.decode_mentions(views.mention_documents(spark, sf_dir))
    return mentions.explode_mentions(docs.where(F.col("bad_body").isNull()))


# --- counting software ---------------------------------------------------------------------


@query
def top_software(spark, sf_dir):
    """JSON text to ranked names: decode, explode, stop list, distinct, count, support, top 10."""
    table = mentions.project_mentions(_exploded(spark, sf_dir))
    edges = pairs.distinct_edges(pairs.stop_list_filter(table, views.STOP_LIST))
    return pairs.top_software(pairs.min_support(pairs.papers_per_software(edges)))


@query
def mentions_table(spark, sf_dir):
    """Every mention of every readable document, repeats kept."""
    return mentions.project_mentions(_exploded(spark, sf_dir))


@query
def distinct_edges(spark, sf_dir):
    return pairs.distinct_edges(pairs.stop_list_filter(views.mentions(spark, sf_dir)))


@query
def papers_per_software(spark, sf_dir):
    table = pairs.stop_list_filter(views.mentions(spark, sf_dir), ("small widget",))
    return pairs.papers_per_software(pairs.distinct_edges(table))


@query
def excluded_by_list(spark, sf_dir):
    """The stop list as a table: names of few parts."""
    part = views.table(spark, sf_dir, "part")
    rare = part.groupBy(F.col("p_name").alias("softwareId")).agg(F.count("*").alias("n")).where("n < 30")
    kept = pairs.exclude_stop_list(views.mentions(spark, sf_dir), rare.select("softwareId"))
    return pairs.papers_per_software(pairs.distinct_edges(kept))


@query
def frequent_software(spark, sf_dir):
    edges = pairs.distinct_edges(views.mentions(spark, sf_dir))
    return pairs.min_support(pairs.papers_per_software(edges), 1000)


@query
def frequent_count(spark, sf_dir):
    edges = pairs.distinct_edges(views.mentions(spark, sf_dir))
    return pairs.frequent_count(pairs.min_support(pairs.papers_per_software(edges)))


@query
def restricted_edges(spark, sf_dir):
    """Edges of names with enough papers: what enters pair counting."""
    edges = stage(pairs.distinct_edges(views.mentions(spark, sf_dir)), "edges")
    frequent = stage(pairs.min_support(pairs.papers_per_software(edges), 1000), "frequent")
    return pairs.restrict_to_frequent(edges, frequent)


@query
def co_mentions(spark, sf_dir):
    table = pairs.stop_list_filter(views.mentions(spark, sf_dir), ("small widget",))
    return pairs.co_mentions(pairs.distinct_edges(table), item_support=1000, pair_support=60)


@query
def co_mentions_wide(spark, sf_dir):
    """Papers with dozens of names; most take the way for wide papers."""
    edges = pairs.distinct_edges(views.customer_mentions(spark, sf_dir))
    return pairs.co_mentions(edges, item_support=100, pair_support=320, max_fanout=24)


@query
def co_mentions_hot(spark, sf_dir):
    """A support beyond what Spark cuts in a window before its shuffle."""
    edges = pairs.distinct_edges(views.feature_mentions(spark, sf_dir))
    return pairs.co_mentions(edges, item_support=100, pair_support=1500, max_fanout=8)


@query
def top_pairs(spark, sf_dir):
    edges = pairs.distinct_edges(pairs.stop_list_filter(views.mentions(spark, sf_dir)))
    return pairs.top_pairs(pairs.co_mentions(edges))


@query
def top_pairs_of_all(spark, sf_dir):
    """The most frequent pairs when every pair counts; most are never counted."""
    edges = pairs.distinct_edges(views.customer_mentions(spark, sf_dir))
    return pairs.most_frequent_pairs(edges, support=1, max_fanout=24)


@query
def co_mentions_equal(spark, sf_dir):
    """Papers of a few features each, many of them with the same ones."""
    edges = pairs.distinct_edges(views.feature_mentions(spark, sf_dir))
    return pairs.co_mentions(edges, item_support=1, pair_support=1, max_fanout=6)


# --- tables from documents --------------------------------------------------------------------


@query
def software_dimension(spark, sf_dir):
    return mentions.software_dimension(_exploded(spark, sf_dir), VIEW_ORDER)


@query
def mention_counts(spark, sf_dir):
    return mentions.order_report(mentions.mention_counts(_exploded(spark, sf_dir)), "normalizedForm")


@query
def mention_report(spark, sf_dir):
    """``name;count`` lines, written and read back."""
    path = staging_path(spark, "report")
    sinks.write_report(mention_counts(spark, sf_dir), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query
def mentions_per_paper(spark, sf_dir):
    docs = typed.decode_mentions(views.mention_documents(spark, sf_dir))
    stored = mentions.mentions_per_paper(docs.where(F.col("bad_body").isNull()))
    return stored.select(
        ids.bytes_to_uuid(F.col("id")).alias("paper"),
        F.array_join("mentions.normalized_form", ";").alias("names"),
        F.size("mentions").alias("n"),
    )


@query
def paper_mentions_stored(spark, sf_dir):
    """The lists of names per paper, written as Parquet and read back."""
    path = staging_path(spark, "paper-mentions")
    docs = typed.decode_mentions(views.mention_documents(spark, sf_dir))
    sinks.write_paper_mentions(mentions.mentions_per_paper(docs.where(F.col("bad_body").isNull())), path)
    return spark.read.parquet(path).select(
        ids.bytes_to_uuid(F.col("id")).alias("paper"),
        F.array_join("mentions.normalized_form", ";").alias("names"),
        F.size("mentions").alias("n"),
    )


@query
def mentions_with_software(spark, sf_dir):
    exploded = stage(_exploded(spark, sf_dir).drop("bad_body"), "mentions")
    known = mentions.software_dimension(exploded, VIEW_ORDER, written=True).where("wikidataId <> ''")
    return mentions.mentions_with_software(mentions.project_mentions(exploded), known)


@query
def papers_table(spark, sf_dir):
    return mentions.project_papers(typed.decode_papers(views.paper_documents(spark, sf_dir)))


@query
def stored_tables(spark, sf_dir):
    """The three tables written as gzip Parquet and read back."""
    folder = staging_path(spark, "tables")
    exploded = stage(_exploded(spark, sf_dir).drop("bad_body"), "mentions")
    sinks.write_tables(
        folder,
        papers=papers_table(spark, sf_dir),
        software=mentions.software_dimension(exploded, VIEW_ORDER, written=True),
        mentions=mentions.project_mentions(exploded),
    )
    papers = typed.read_table(spark, folder, "papers").select("uuid", "year")
    named = mentions.mentions_with_software(
        typed.read_table(spark, folder, "mentions"), typed.read_table(spark, folder, "software")
    )
    return (
        named.join(papers, named["paperId"] == papers["uuid"], "left")
        .groupBy("year", "softwareType")
        .agg(F.count("*").alias("n"))
    )


# --- documents ---------------------------------------------------------------------------------


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names as a tree scan would meet them, some of them foreign."""
    items = views.line_items(spark, sf_dir)
    name = (
        F.when(F.col("l_tax") == 0.0, F.upper("name"))
        .when(F.col("l_tax") == 0.01, F.concat("name", F.lit(".bak")))
        .when(F.col("l_tax") == 0.02, F.concat(F.lit("x"), "name"))
        .otherwise(F.col("name"))
    )
    path = F.concat(F.lit("file:///corpus/"), F.substring("paper", 1, 2), F.lit("/a/"), "file")
    return items.withColumn("file", name).select("file", path.alias("file_path"))


@query
def classified_files(spark, sf_dir):
    name = F.col("file")
    return _listing(spark, sf_dir).select(
        "file",
        files.shard(F.col("file_path"), "/corpus").alias("shard"),
        files.classify_kind(name).alias("kind"),
        files.paper_id(name).alias("paper_id"),
        files.is_mention_file(name).alias("is_mention_file"),
        files.has_id_length(name).alias("has_id_length"),
    )


@query
def shard_kind_counts(spark, sf_dir):
    return classified_files(spark, sf_dir).groupBy("shard", "kind").agg(F.count("*").alias("n"))


@query
def removable_by_name(spark, sf_dir):
    listed = maintenance.removable_by_name(_listing(spark, sf_dir))
    return listed.groupBy("file").agg(F.count("*").alias("n"))


@query
def rejected_documents(spark, sf_dir):
    return documents.rejects(views.tree_documents(spark, sf_dir))


@query
def provenance(spark, sf_dir):
    """The key ``file`` after rewriting, beside a value that must be unchanged."""
    docs = documents.drop_malformed(views.tree_documents(spark, sf_dir))
    shape = "file STRING, title STRING, price DOUBLE, amounts ARRAY<DOUBLE>"
    return documents.with_provenance(docs).select(
        "file",
        F.from_json("body", shape).alias("r"),
        F.array_size(F.json_object_keys("body")).alias("n_keys"),
    ).select(
        "file",
        F.col("r.file").alias("file_key"),
        F.col("r.title").alias("title"),
        F.col("r.price").alias("price"),
        F.element_at("r.amounts", 1).alias("quantity"),
        "n_keys",
    )


@query
def concatenated_documents(spark, sf_dir):
    """Two sources as one stream of documents, counted by genre of file name."""
    papers = views.paper_documents(spark, sf_dir).select("body")
    found = views.mention_documents(spark, sf_dir).select("body")
    docs = documents.drop_malformed(papers.unionByName(found))
    kind = files.classify_kind(F.try_variant_get("doc", "$.file", "string"))
    return docs.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def _written(spark: SparkSession, rows: DataFrame, name: str, *parts: str) -> str:
    """A folder with the files of ``rows``, each at its ``parts``."""
    root = staging_path(spark, name)
    root = root if ":" in root.partition("/")[0] else f"file://{root}"
    path = F.concat(F.lit(root), *[F.concat(F.lit("/"), F.col(p)) for p in parts])
    sinks.write_files(rows.withColumn("path", path)).count()
    return root


@query
def scanned_tree(spark, sf_dir):
    """A tree of files, written, listed and read: what merging would take and refuse."""
    root = _written(spark, views.customer_tree(spark, sf_dir), "tree", "shard", "file")
    docs = documents.parsed(documents.scan_documents(spark, root))
    listed = documents.list_documents(spark, root).select("file")
    return docs.join(listed, "file").select(
        "shard", "file", "kind", "paper_id",
        F.col("doc").isNotNull().alias("readable"),
        F.get_json_object("body", "$.name").alias("name"),
    )


@query
def first_seen_across_folders(spark, sf_dir):
    """Shard files of equal names in two folders: the first mention of each name, by path."""
    root = _written(spark, views.customer_lines(spark, sf_dir), "shards", "folder", "name")
    # folder names must match the pattern of the shard files too, so each is read by itself
    lines = [documents.scan_shards(spark, f"{root}/{folder}", spread=3) for folder in ("b", "a")]
    docs = typed.decode_mentions(lines[0].unionByName(lines[1]))
    return mentions.software_dimension(mentions.explode_mentions(docs).drop("bad_body"))


@query
def merged_shards(spark, sf_dir):
    """Compaction written as gzip JSON lines per shard and kind, then read back and counted."""
    path = staging_path(spark, "merged")
    docs = views.tree_documents(spark, sf_dir).withColumn("kind", files.classify_kind(F.col("file")))
    sinks.write_merged(documents.with_provenance(documents.drop_malformed(docs)), path)
    found = documents.scan_merged(spark, path).withColumn(
        "r", F.from_json("body", "file STRING, price DOUBLE")
    )
    return found.groupBy("shard", "kind").agg(
        F.count("*").alias("n"),
        F.count_distinct("r.file").alias("n_files"),
        F.max("r.price").alias("max_price"),
    )


@query
def two_kind_merge(spark, sf_dir):
    """Paper metadata and plain software documents only, compacted and read back."""
    path = staging_path(spark, "two-kinds")
    docs = views.tree_documents(spark, sf_dir).withColumn("kind", files.classify_kind(F.col("file")))
    sinks.write_paper_and_software(documents.with_provenance(documents.drop_malformed(docs)), path)
    return documents.scan_merged(spark, path).groupBy("shard", "kind").agg(F.count("*").alias("n"))


@query
def compacted_in_two_runs(spark, sf_dir):
    """Half of the papers first, then all: what is merged already is not merged again."""
    out, bad = staging_path(spark, "two-runs"), staging_path(spark, "two-runs-rejects")
    docs = _named(stage(views.tree_documents(spark, sf_dir), "tree", "zstd"))
    jobs.append_new(docs.where(F.crc32(F.col("paper_id").cast("binary")) % 2 == 0), out, bad, written=True)
    jobs.append_new(docs, out, bad, written=True)
    merged = documents.scan_merged(spark, out).groupBy("shard", "kind")
    rejected = spark.read.parquet(bad).groupBy("shard", "kind")
    return (
        merged.agg(F.count("*").alias("n"))
        .join(rejected.agg(F.count("*").alias("n_rejected")), ["shard", "kind"], "full")
        .select("shard", "kind", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_rejected", F.lit(0)).alias("n_rejected"))
    )


def _named(docs: DataFrame) -> DataFrame:
    name = F.col("file")
    return docs.withColumns({"kind": files.classify_kind(name), "paper_id": files.paper_id(name)})


@query
def changed_documents(spark, sf_dir):
    """Files that hold something else than what was merged; goods of one kind were changed."""
    out, bad = staging_path(spark, "changed"), staging_path(spark, "changed-rejects")
    docs = _named(stage(views.tree_documents(spark, sf_dir), "tree", "zstd"))
    jobs.append_new(docs, out, bad, written=True)
    other = F.get_json_object("body", "$.file").isNotNull()
    now = docs.withColumn("body", F.when(other, F.concat("body", F.lit(" "))).otherwise(F.col("body")))
    source = now.select("file", "paper_id", "kind", ledger.content_digest(F.col("body")).alias("digest"))
    changed = maintenance.changed_documents(source, ledger.merged(spark, out))
    name = files.packed_name(F.col("file")).alias("name")
    counts = changed.groupBy(name).agg(F.count("*").alias("n"))
    return counts.select(files.unpacked_name(F.col("name")).alias("file"), "n")


@query
def removable_unchanged(spark, sf_dir):
    """Files that are merged as they are: what may be removed, per shard."""
    out, bad = staging_path(spark, "unchanged"), staging_path(spark, "unchanged-rejects")
    docs = _named(stage(views.tree_documents(spark, sf_dir), "tree", "zstd"))
    jobs.append_new(docs, out, bad, written=True)
    source = docs.withColumn("digest", ledger.content_digest(F.col("body"))).drop("body")
    return maintenance.unchanged_documents(source, ledger.merged(spark, out)).groupBy("shard", "kind").agg(F.count("*").alias("n"))


@query
def streamed_in_two_runs(spark, sf_dir):
    """A tree taken in by a stream, which stops, meets more files and goes on."""
    tree = views.customer_tree(spark, sf_dir)
    root = staging_path(spark, "stream-in")
    root = root if ":" in root.partition("/")[0] else f"file://{root}"
    out, bad, state = (staging_path(spark, f"stream-{n}") for n in ("out", "rejects", "state"))
    for part in (0, 1):
        path = F.concat(F.lit(root), F.lit("/"), F.col("shard"), F.lit("/"), F.col("file"))
        sinks.write_files(tree.where(F.crc32(F.col("file").cast("binary")) % 2 == part).withColumn("path", path)).count()
        ingest_new_documents(spark, root, out, state, bad, 1000).awaitTermination()
    merged = documents.scan_merged(spark, out).groupBy("shard", "kind")
    rejected = spark.read.parquet(bad).groupBy("shard", "kind")
    return (
        merged.agg(F.count("*").alias("n"))
        .join(rejected.agg(F.count("*").alias("n_rejected")), ["shard", "kind"], "full")
        .select("shard", "kind", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_rejected", F.lit(0)).alias("n_rejected"))
    )


@query
def strict_counts(spark, sf_dir):
    """The rules that documents break, counted while they are written."""
    _, counts = documents.counted(views.tree_documents(spark, sf_dir))
    return spark.createDataFrame(sorted(counts.items()), "rule STRING, n BIGINT")


# --- profile -----------------------------------------------------------------------------------


@query
def json_nested_paths(spark, sf_dir):
    """Leaves of nested documents, summed per path."""
    docs = documents.drop_malformed(views.conversation_documents(spark, sf_dir))
    leaves = profile.flatten_json(docs.select("doc"))
    return leaves.groupBy("path", "kind").agg(
        F.count("*").alias("n"),
        F.sum(F.length("str")).alias("characters"),
        F.min("num").alias("low"),
        F.max("num").alias("high"),
    )


@query
def json_deep_paths(spark, sf_dir):
    """Turns wrapped in 15 to 40 objects."""
    docs = documents.drop_malformed(views.deep_documents(spark, sf_dir))
    leaves = profile.flatten_json(docs.select("doc"))
    return leaves.groupBy("path", "kind").agg(
        F.count("*").alias("n"), F.sum("num").alias("total"), F.sum(F.length("str")).alias("characters")
    )


@query
def json_field_profile(spark, sf_dir):
    return jobs.profile_json(views.event_documents(spark, sf_dir))[0]


@query
def json_field_values(spark, sf_dir):
    values = jobs.profile_json(views.event_documents(spark, sf_dir))[1]
    return values.select("path", "kind", "value", "n", "n_distinct")


@query
def json_profile_report(spark, sf_dir):
    return profile.profile_report(*jobs.profile_json(views.event_documents(spark, sf_dir))[:2])


@query
def storage_types(spark, sf_dir):
    """The profile of typed columns."""
    leaves = _line_item_leaves(spark, sf_dir)
    totals = profile.summarise(leaves)
    return profile.field_profile(totals, profile.field_values(totals))


def _line_item_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.leaves_of(
        views.table(spark, sf_dir, "lineitem"),
        order="l_orderkey", line="l_linenumber", quantity="l_quantity",
        price="l_extendedprice", discount="l_discount", tax="l_tax", flag="l_returnflag",
    )


@query
def number_tests(spark, sf_dir):
    x = F.col("x")
    prices = views.table(spark, sf_dir, "lineitem").select(
        F.explode(F.array(F.col("l_extendedprice"), F.col("l_extendedprice") / 1024, F.col("l_quantity") * 0.5)).alias("x")
    )
    return prices.select("x", is_integral(x).alias("integral"), fits_float32(x).alias("float32"))


# --- identifiers ---------------------------------------------------------------------------------


def _identifier_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed.decode_paper_ids(views.identifier_documents(spark, sf_dir))


def _readable(stored: DataFrame) -> DataFrame:
    """Binary and list columns as text, so that any client can compare them."""
    return stored.withColumns(
        {
            "id": F.lower(F.hex("id")),
            "istex_id": F.hex("istex_id"),
            "resources": F.array_join(F.col("resources").cast("array<string>"), ","),
        }
    )


@query
def paper_ids_normalised(spark, sf_dir):
    return _readable(identifiers.normalise_paper_ids(_identifier_rows(spark, sf_dir)))


@query
def paper_ids_stored(spark, sf_dir):
    """Stored as Parquet without oa_link and read back."""
    path = staging_path(spark, "paper-ids")
    stored = identifiers.normalise_paper_ids(_identifier_rows(spark, sf_dir))
    sinks.write_paper_ids(identifiers.drop_oa_link(stored, include=False), path)
    return _readable(typed.read_paper_ids(spark, path))


@query
def paper_ids_denormalised(spark, sf_dir):
    stored = identifiers.normalise_paper_ids(_identifier_rows(spark, sf_dir))
    return identifiers.denormalise_paper_ids(stored).withColumn(
        "resources", F.array_join("resources", ",")
    )


@query
def paper_id_errors(spark, sf_dir):
    wrong = identifiers.paper_id_errors(_identifier_rows(spark, sf_dir))
    return wrong.select("id", F.array_join("errors", ",").alias("errors"))


@query
def paper_ids_roundtrip_mismatches(spark, sf_dir):
    return identifiers.roundtrip_mismatches(_identifier_rows(spark, sf_dir))


@query
def resource_codes(spark, sf_dir):
    codes = _identifier_rows(spark, sf_dir).select(ids.resource_codes(F.col("resources")).alias("codes"))
    known = codes.where(~F.exists("codes", lambda code: code.isNull()))
    counted = known.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    name = F.element_at(ids.resource_names(F.array("code")), 1)
    return counted.select("code", name.alias("name"), "n")


@query
def licence_counts(spark, sf_dir):
    stored = identifiers.normalise_paper_ids(_identifier_rows(spark, sf_dir))
    return licences.licence_histogram(stored)


# --- order, pending work ------------------------------------------------------------------------

ITEM_ORDER = ("l_linenumber", "l_partkey", "l_extendedprice")


def _keyed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.line_items(spark, sf_dir).select(F.col("name").alias("file"), *ITEM_ORDER)


@query
def sorted_by_uuid(spark, sf_dir):
    """The global order, shown as each row's position."""
    ordered = ordering.sort_by_uuid(_keyed_items(spark, sf_dir), ITEM_ORDER)
    return ordering.with_position(ordered).select("position", F.substring("file", 1, 36).alias("paper"), *ITEM_ORDER)


@query
def sorted_last_wins(spark, sf_dir):
    ordered = ordering.sort_by_uuid(_keyed_items(spark, sf_dir), ITEM_ORDER, "last")
    return ordered.select(F.substring("file", 1, 36).alias("paper"), *ITEM_ORDER)


@query
def last_documents(spark, sf_dir):
    """The last document of each paper, with its text."""
    order = ("l_linenumber", "l_partkey")
    docs = documents.drop_malformed(views.mention_documents(spark, sf_dir)).drop("doc", "l_orderkey")
    last = ordering.sort_by_uuid(once(docs, file=documents.file_key(F.col("body"))), order, "last")
    price = F.get_json_object("body", "$.price").cast("double")
    return last.select(F.substring("file", 1, 36).alias("paper"), *order, price.alias("price"))


@query
def sorted_repeat_last(spark, sf_dir):
    ordered = ordering.sort_by_uuid(_keyed_items(spark, sf_dir), ITEM_ORDER, "repeat_last")
    return ordered.select("file", *ITEM_ORDER)


@query
def sorted_jsonl(spark, sf_dir):
    """Sorted gzip JSON lines, read back in source order: the paper at each position."""
    path = staging_path(spark, "sorted")
    docs = documents.with_provenance(documents.drop_malformed(views.tree_documents(spark, sf_dir)))
    sinks.write_sorted_jsonl(ordering.sort_by_uuid(docs, ("body",)), path)
    found = once(documents.scan_jsonl(spark, path), file=documents.file_key(F.col("body"))).drop("body")
    read = ordering.with_position(found.orderBy(*documents.SOURCE_ORDER))
    return read.select("position", F.substring("file", 1, 36).alias("paper"))


def _sources_and_merged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    listed = views.line_items(spark, sf_dir).select(
        F.col("name").alias("file"),
        F.col("paper").alias("paper_id"),
        files.classify_kind(F.col("name")).alias("kind"),
        F.substring("paper", 1, 2).alias("shard"),
        "l_shipdate",
        "l_partkey",
    )
    merged = listed.where(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    return listed.select("file", "paper_id", "kind", "shard", "l_partkey"), merged


@query
def pending_documents(spark, sf_dir):
    return maintenance.pending_documents(*_sources_and_merged(spark, sf_dir))


@query
def processed_documents(spark, sf_dir):
    return maintenance.processed_documents(*_sources_and_merged(spark, sf_dir))


@query
def pending_shards(spark, sf_dir):
    """Shards of 16 bits, so that some lack a kind."""
    source, merged = _sources_and_merged(spark, sf_dir)
    source, merged = (t.withColumn("shard", F.substring("paper_id", 1, 4)) for t in (source, merged))
    done = merged.select("shard", "kind")
    left = maintenance.pending_shards(source, done, ("jats", "latex"))
    return left.groupBy("shard").agg(F.count("*").alias("n"))
