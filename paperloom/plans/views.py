"""The given tables in the shapes the operators read.

Nothing is grouped here: each order is a paper, and each of its line items is one mention
document of that paper, written as JSON text that the operators parse again. Part names
stand for software names, brands for wikidata ids. Some rows are spoilt on purpose, by
value, so that rejects are not empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.once import once
from paperloom.schemas import KIND_BY_SUFFIX, LICENCES
from paperloom.session import shuffles, spread

MENTION_SUFFIXES = [suffix for suffix, kind in KIND_BY_SUFFIX.items() if kind != "paper"]
SPELLINGS = [label for _, label, _ in LICENCES] + [alias for _, _, alias in LICENCES if alias]
STOP_LIST = ("widget", "plate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; a small one is dealt out, as its file is one row group."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def with_uuid(df: DataFrame, name: str, key: str) -> DataFrame:
    """Add a UUID made from the MD5 of a key."""
    h = F.col("_md5")
    cuts = [h.substr(1, 8), h.substr(9, 4), h.substr(13, 4), h.substr(17, 4), h.substr(21, 12)]
    hashed = once(df, _md5=F.md5(F.col(key).cast("string")))
    return hashed.withColumn(name, F.concat_ws("-", *cuts)).drop("_md5")


def pick(options: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (index + 1).cast("int"))


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their part, paper id and file name.

    Parts that are too many to be sent to each task make the join deal the items out by itself.
    """
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    items = items if shuffles(part) else spread(items)
    items = items.join(part, F.col("l_partkey") == F.col("p_partkey"))
    suffix = pick(MENTION_SUFFIXES, F.pmod("l_linenumber", F.lit(5)))
    return with_uuid(items, "paper", "l_orderkey").withColumn("name", F.concat("paper", suffix))


def mention_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, l_linenumber, l_partkey, body): merged mention lines.

    Two mentions each: the part with its brand, and the thing it is, without an id. Text
    of items with the largest discount is cut short.
    """
    whole = F.struct(
        F.struct(F.col("p_name").alias("normalizedForm"), F.col("p_brand").alias("wikidataId")).alias(
            "software-name"
        ),
        F.col("p_type").alias("software-type"),
    )
    thing = F.struct(
        F.struct(
            F.substring_index("p_name", " ", -1).alias("normalizedForm"),
            F.lit(None).cast("string").alias("wikidataId"),
        ).alias("software-name"),
        F.col("l_returnflag").alias("software-type"),
    )
    text = F.to_json(
        F.struct(
            F.col("name").alias("file"),
            F.array(whole, thing).alias("mentions"),
            F.col("l_extendedprice").alias("price"),
        )
    )
    return _with_body(line_items(spark, sf_dir), text).select(
        "l_orderkey", "l_linenumber", "l_partkey", "body"
    )


def _with_body(items: DataFrame, text: Column) -> DataFrame:
    """``body``: the text, without its last character for items with the largest discount."""
    whole = F.col("body")
    cut = F.when(F.col("l_discount") == 0.1, F.substr(whole, F.lit(1), F.length(whole) - 1))
    return once(once(items, body=text), body=F.coalesce(cut, whole))


def tree_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(shard, file, body): the same as files of a tree, before compaction.

    Returned goods have a ``file`` key already, which compaction must overwrite.
    """
    text = F.to_json(
        F.struct(
            F.when(F.col("l_returnflag") == "R", F.lit("elsewhere.json")).alias("file"),
            F.col("p_name").alias("title"),
            F.col("l_extendedprice").alias("price"),
            F.array("l_quantity", "l_tax").alias("amounts"),
        )
    )
    return _with_body(line_items(spark, sf_dir), text).select(
        F.substring("paper", 1, 1).alias("shard"), F.col("name").alias("file"), "body"
    )


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(paperId, softwareId): the typed mentions table, whole part names only."""
    return line_items(spark, sf_dir).select(
        F.col("paper").alias("paperId"), F.col("p_name").alias("softwareId")
    )


def customer_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(paperId, softwareId) with customers as papers, which then hold dozens of names."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    items = line_items(spark, sf_dir).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return with_uuid(items, "paperId", "o_custkey").select("paperId", F.col("p_name").alias("softwareId"))


def feature_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(paperId, softwareId): a few names that thousands of orders have, several each."""
    names = F.array(
        F.concat(F.lit("flag "), "l_returnflag"),
        F.concat(F.lit("status "), "l_linestatus"),
        F.concat(F.lit("line "), F.col("l_linenumber").cast("string")),
        F.concat(F.lit("quantity "), (F.col("l_quantity") / 10).cast("int").cast("string")),
    )
    return line_items(spark, sf_dir).select(F.col("paper").alias("paperId"), F.explode(names).alias("softwareId"))


def paper_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, body): paper metadata. Years of urgent orders do not fit; of low ones are missing."""
    year = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.year("o_orderdate") + 70000)
        .when(F.col("o_orderpriority") != "5-LOW", F.year("o_orderdate"))
    )
    name = F.concat("uuid", F.lit(".json"))
    text = F.to_json(
        F.struct(name.alias("file"), year.alias("year"), F.col("o_orderstatus").alias("genre"))
    )
    orders = with_uuid(table(spark, sf_dir, "orders"), "uuid", "o_orderkey")
    return once(orders, body=text).select("body")


def identifier_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(body): identifier records. Some forms are lossy, some fields cannot be stored."""
    orders = table(spark, sf_dir, "orders").withColumn("number", F.col("o_orderkey").cast("string"))
    orders = once(with_uuid(orders, "uuid", "o_orderkey"), sha=F.upper(F.sha1("number")))
    number, sha, uuid = F.col("number"), F.col("sha"), F.col("uuid")
    key, status, priority = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")
    ident = F.when(priority == "2-HIGH", F.upper(uuid)).otherwise(uuid)
    pmid = F.when(priority == "1-URGENT", F.concat(F.lit("00"), number)).when(
        status == "P", F.concat(F.lit("-"), number)
    ).otherwise(number)
    pmcid = F.when(F.col("o_totalprice") >= 400000, F.concat(F.lit("PMC"), number, F.lit(".2"))).otherwise(
        F.concat(F.lit("PMC"), number)
    )
    istex = F.when(priority == "5-LOW", F.lower(sha)).when(
        F.col("o_totalprice") < 20000, F.substr(sha, F.lit(1), F.lit(39))
    ).otherwise(sha)
    resources = F.when(status == "F", F.array(F.lit("json"), F.lit("pdf"))).when(
        (status == "O") & (priority == "3-MEDIUM"), F.array(F.lit("xml"), F.lit("epub"))
    ).when(status == "O", F.array(F.lit("latex"), F.lit("xml")))
    licence = F.when(F.col("o_totalprice").between(100000, 110000), F.lit("CC-BY")).otherwise(
        pick(SPELLINGS, F.pmod(key, F.lit(len(SPELLINGS))))
    )
    return once(
        orders,
        body=F.to_json(
            F.struct(
                ident.alias("id"),
                F.concat(F.lit("10.1/"), number).alias("doi"),
                F.when(status != "F", F.concat(F.lit("arXiv:"), number)).alias("arxiv"),
                pmid.alias("pmid"),
                pmcid.alias("pmcid"),
                istex.alias("istexId"),
                resources.alias("resources"),
                licence.alias("license"),
                F.concat(F.lit("https://a.example/"), number).alias("oa_link"),
            )
        ),
    ).select("body")


def event_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(body): events as nested documents with a null leaf and a path of two kinds."""
    event = F.struct(
        "event_type",
        "value",
        "user_id",
        (F.col("value") > 100).alias("large"),
        F.array(F.floor(F.col("value") / 100)).alias("steps"),
    )
    code = F.when(F.col("event_type") == "error", F.col("user_id").cast("string")).otherwise(
        F.concat(F.lit('"'), "event_type", F.lit('"'))
    )
    maybe = F.when(F.col("value") > 50, F.lit("null")).otherwise(F.lit("1.5"))
    text = F.concat(
        F.lit('{"event":'), F.to_json(event), F.lit(',"props":'), F.col("props"),
        F.lit(',"code":'), code, F.lit(',"maybe":'), maybe, F.lit(',"none":[],"blank":{}}'),
    )
    return once(table(spark, sf_dir, "events"), body=text).select("body")


def customer_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(shard, file, text): a document file for each customer, its kind by number; every
    seventh is not JSON."""
    customers = with_uuid(table(spark, sf_dir, "customer"), "uuid", "c_custkey")
    suffix = pick([*KIND_BY_SUFFIX, ".txt.json"], F.pmod("c_custkey", F.lit(len(KIND_BY_SUFFIX) + 1)))
    body = F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")))
    bad = F.col("c_custkey") % 7 == 0
    return customers.select(
        F.substring("uuid", 1, 2).alias("shard"),
        F.concat("uuid", suffix).alias("file"),
        F.when(bad, F.lit("not JSON")).otherwise(body).alias("text"),
    )


def customer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, folder, text): shard files of JSON lines, the same names in two folders.

    A shard's lines are the customers of a nation in the order of their keys, those of even
    keys in folder ``a``; a name is that of a mention document of each.
    """
    customers = with_uuid(table(spark, sf_dir, "customer"), "uuid", "c_custkey")
    mention = F.struct(
        F.struct(F.col("c_mktsegment").alias("normalizedForm"), F.col("c_name").alias("wikidataId")).alias("software-name"),
        F.lit("x").alias("software-type"),
    )
    line = F.to_json(F.struct(F.concat("uuid", F.lit(".software.json")).alias("file"), F.array(mention).alias("mentions")))
    lines = customers.select(
        "c_custkey",
        line.alias("line"),
        F.format_string("%02x.software.jsonl.gz", "c_nationkey").alias("name"),
        F.when(F.col("c_custkey") % 2 == 0, "a").otherwise("b").alias("folder"),
    )
    listed = F.sort_array(F.collect_list(F.struct("c_custkey", "line")))
    return lines.groupBy("name", "folder").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("text"))


def deep_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(body): turns, each in 15 to 40 nested objects, the depth by conversation."""
    depth = (F.col("conv_id") % 26 + 15).cast("int")
    leaf = F.to_json(F.struct(F.col("turn").alias("no"), "role"))
    text = F.concat(F.repeat(F.lit('{"d":'), depth), leaf, F.repeat(F.lit("}"), depth))
    return once(table(spark, sf_dir, "conversations"), body=text).select("body")


def conversation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(body): each turn with its whole text as lines of words."""
    lines = F.transform(F.split("text", "\n"), lambda line: F.split(line, " "))
    text = F.to_json(
        F.struct(
            F.col("conv_id").alias("conv"),
            F.struct(F.col("turn").alias("no"), "role", lines.alias("lines")).alias("turn"),
            F.array().alias("none"),
        )
    )
    return once(table(spark, sf_dir, "conversations"), body=text).select("body")
