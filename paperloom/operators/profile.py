"""Profile of JSON documents: every leaf path with its type, range and few-valued histogram.

A leaf frame has (path, kind, num, str, flag): kind is null, bool, number, string or
truncated, and the value sits in the column of its kind.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions.numbers import fits_float32, is_integral, number_text, storage_type
from paperloom.functions.json_walk import walk
from paperloom.functions.once import once
from paperloom.session import stage

MAX_ENUM = 20
# Leaves of a large document that are passed on together.
LEAVES = 10_000
# Levels that are opened in one pass; rows that still hold a container then go on.
LEVELS = 8


def flatten_json(docs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Leaves of the VARIANT column ``doc``; other columns of ``docs`` are kept.

    An object member adds ``.key`` to the path, an array element ``[]``; empty containers
    give no row. A narrow pass opens ``LEVELS`` levels and passes leaves on. What still is a
    container then is staged and goes through the next pass, until none is left; so
    documents may be of any depth, and flat ones cost one pass. With ``max_depth``,
    containers below that level are kept as ``truncated``, with their JSON text in ``str``.
    """
    keep = [c for c in docs.columns if c not in ("doc", "body")]
    rows = docs.select(*keep, F.lit("").alias("path"), F.col("doc").alias("v"))
    left, leaves = max_depth, None
    while True:
        levels = LEVELS if left is None else min(LEVELS, left)
        opened = once(_opened(rows, keep, levels), schema=F.schema_of_variant("v"))
        if left is not None:
            left -= levels
        done = left == 0
        found = opened if done else opened.where(~_is_container(F.col("schema")))
        found = found.select(*keep, "path", *_leaf_columns())
        leaves = found if leaves is None else leaves.unionByName(found)
        if done:
            return leaves
        deeper = opened.where(_is_container(F.col("schema"))).select(*keep, "path", F.to_json("v").alias("v"))
        deeper = stage(deeper, "deeper")
        if deeper.isEmpty():
            return leaves
        rows = once(deeper, v=F.parse_json("v")).select(*keep, "path", "v")


def _opened(rows: DataFrame, keep: list[str], levels: int) -> DataFrame:
    """(path, v): containers opened for some levels. The empty ones, told by their schema
    alone, leave no row; a leaf's schema is as cheap, so passing on costs little per level."""
    kept = "".join(f"`{c}`, " for c in keep)
    query = "SELECT * FROM {rows}"
    for _ in range(levels):
        query = f"""
            SELECT {kept}
                   CASE WHEN e.key IS NOT NULL THEN concat(path, '.', e.key)
                        WHEN e.value IS NOT NULL THEN concat(path, '[]')
                        ELSE path END AS path,
                   coalesce(e.value, v) AS v
            FROM ({query}), LATERAL variant_explode_outer(v) AS e
            WHERE NOT (e.value IS NULL AND schema_of_variant(v) IN ('OBJECT<>', 'ARRAY<VOID>'))"""
    return rows.sparkSession.sql(query, rows=rows)


def _is_container(schema: Column) -> Column:
    return schema.startswith("OBJECT<") | schema.startswith("ARRAY<")


def _leaf_columns() -> list[Column]:
    schema = F.col("schema")
    kind = (
        F.when(schema == "VOID", "null")
        .when(schema == "BOOLEAN", "bool")
        .when(schema == "STRING", "string")
        .when(_is_container(schema), "truncated")
        .otherwise("number")
    )
    # Each value is read only from its own kind, so no cast is attempted that fails.
    # Adding zero turns -0.0 into 0.0.
    num = F.when(kind == "number", F.variant_get("v", "$", "double") + F.lit(0.0))
    text = F.when(kind == "string", F.variant_get("v", "$", "string")).when(
        kind == "truncated", F.to_json("v")
    )
    flag = F.when(kind == "bool", F.variant_get("v", "$", "boolean"))
    return [kind.alias("kind"), num.alias("num"), text.alias("str"), flag.alias("flag")]


def flatten_large(docs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Leaves of the texts in ``body``, one document at a time, by a walk without limits of size
    and depth; other columns of ``docs`` are kept. Staged. Of a text that is not a JSON object
    there is one row, of kind ``refused``, with the text in ``str``.
    """
    keep = [f for f in docs.schema.fields if f.name != "body"]
    leaf = T.StructType().add("path", "string").add("kind", "string").add("num", "double").add("str", "string").add("flag", "boolean")
    schema = T.StructType([*keep, *leaf.fields])
    kinds = [pa.string(), pa.string(), pa.float64(), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                body = batch.column(len(keep))[i].as_py()
                try:
                    found = walk(body, max_depth)
                except ValueError:
                    found = [("", "refused", None, body, None)]
                for at in range(0, len(found), LEAVES):
                    part = found[at : at + LEAVES]
                    same = pa.array([i] * len(part))
                    columns = [batch.column(k).take(same) for k in range(len(keep))]
                    columns += [pa.array([x[k] for x in part], kind) for k, kind in enumerate(kinds)]
                    yield pa.RecordBatch.from_arrays(columns, schema.names)

    return stage(docs.select(*(f.name for f in keep), "body").mapInArrow(run, schema), "large-leaves")


def leaves_of(rows: DataFrame, **paths: str) -> DataFrame:
    """Leaves of typed columns, ``path="column"``: numbers, booleans and strings as they are."""
    types = dict(rows.dtypes)
    leaf = []
    for path, column in paths.items():
        kind = {"string": "string", "boolean": "bool"}.get(types[column], "number")
        value = F.col(column)
        leaf.append(
            F.struct(
                F.lit("." + path).alias("path"),
                F.when(value.isNull(), "null").otherwise(kind).alias("kind"),
                (value.cast("double") + F.lit(0.0) if kind == "number" else F.lit(None).cast("double")).alias("num"),
                (value if kind == "string" else F.lit(None).cast("string")).alias("str"),
                (value if kind == "bool" else F.lit(None).cast("boolean")).alias("flag"),
            )
        )
    return rows.select(F.inline(F.array(*leaf)))


#: Paths that a task sums up at once; with more, as where keys are data, it starts again.
MOST_PATHS = 20_000

_PARTIAL = (
    "path string, kind string, n bigint, min double, max double, integral boolean, float32 boolean, "
    "n_true bigint, n_false bigint, many boolean, seen array<struct<num: double, str: string, n: bigint>>"
)


def _partials(leaves: DataFrame) -> DataFrame:
    """What each task has seen of each path and kind, with its values while they are few.

    The only pass over the leaves. A set of values stops at MAX_ENUM, so a path costs a fixed
    number of values in a task, and the sets of tasks can be added.
    """
    read = leaves.select(
        "path", "kind", "num", "str", "flag", is_integral(F.col("num")).alias("integral"), fits_float32(F.col("num")).alias("float32")
    )
    names = [f.split()[0] for f in _PARTIAL.split(", ")[:10]] + ["seen"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, list] = {}
        seen: dict[tuple, dict | None] = {}

        def summed() -> pa.RecordBatch:
            rows = [(*k, *v, seen[k] is None, [{"num": x, "str": t, "n": n} for (x, t), n in (seen[k] or {}).items()]) for k, v in total.items()]
            kinds = [pa.string()] * 2 + [pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_()]
            kinds.append(pa.list_(pa.struct([("num", pa.float64()), ("str", pa.string()), ("n", pa.int64())])))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table.append_column("yes", pc.cast(table.column("flag"), pa.int64()))
            table = table.append_column("no", pc.cast(pc.invert(table.column("flag")), pa.int64()))
            measures = [([], "count_all"), ("num", "min"), ("num", "max"), ("integral", "all"), ("float32", "all"), ("yes", "sum"), ("no", "sum")]
            found = table.group_by(["path", "kind"]).aggregate(measures).to_pylist()
            for r in found:
                path, kind, *new = (r[c] for c in ("path", "kind", "count_all", "num_min", "num_max", "integral_all", "float32_all", "yes_sum", "no_sum"))
                old = total.get((path, kind))
                seen.setdefault((path, kind), {})
                total[path, kind] = new if old is None else [_either(f, x, y) for f, x, y in zip(_MERGES, old, new)]
            valued = table.filter(pc.is_in(table.column("kind"), pa.array(["number", "string"])))
            counts = valued.group_by(["path", "kind", "num", "str"]).aggregate([([], "count_all")])
            sizes = counts.group_by(["path", "kind"]).aggregate([([], "count_all")]).to_pylist()
            few = [(r["path"], r["kind"]) for r in sizes if r["count_all"] <= MAX_ENUM and seen[r["path"], r["kind"]] is not None]
            for r in sizes:
                if r["count_all"] > MAX_ENUM:
                    seen[r["path"], r["kind"]] = None
            wanted = pa.table({"path": pa.array([p for p, _ in few], pa.string()), "kind": pa.array([k for _, k in few], pa.string())})
            for r in counts.join(wanted, ["path", "kind"], join_type="inner").to_pylist():
                key, value = (r["path"], r["kind"]), (r["num"], r["str"])
                own = seen[key]
                if own is not None:
                    own[value] = own.get(value, 0) + r["count_all"]
                    if len(own) > MAX_ENUM:
                        seen[key] = None
            if len(total) > MOST_PATHS:
                yield summed()
                total.clear()
                seen.clear()
        if total:
            yield summed()

    return stage(read.mapInArrow(run, _PARTIAL), "field-partials")


_MERGES = (sum, min, max, all, all, sum, sum)


def _either(merge, a, b):
    """Two values that may be missing, merged."""
    return b if a is None else a if b is None else merge((a, b))


def summarise(leaves: DataFrame) -> DataFrame:
    """(path, kind) totals, staged. ``few`` marks the paths of at most MAX_ENUM distinct numbers
    or strings, whose ``seen`` are their values with counts; the leaves are read once.
    """
    partials = _partials(leaves)
    value = ["path", "kind", "num", "str"]
    totals = partials.groupBy("path", "kind").agg(
        F.sum("n").alias("n"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.bool_and("integral").alias("integral"),
        F.bool_and("float32").alias("float32"),
        F.coalesce(F.sum("n_true"), F.lit(0)).alias("n_true"),
        F.coalesce(F.sum("n_false"), F.lit(0)).alias("n_false"),
        F.bool_or("many").alias("many"),
    )
    # a task has MAX_ENUM values of a path at most, so this is short beside the leaves
    counted = (
        partials.where("NOT many").select("path", "kind", F.inline("seen")).groupBy(*value).agg(F.sum("n").alias("n"))
    )
    # paths that stay few have few values; of others only the number counts
    places = Window.partitionBy("path", "kind").orderBy("num", "str")
    least = counted.withColumn("place", F.row_number().over(places)).where(F.col("place") <= MAX_ENUM + 1)
    seen = least.groupBy("path", "kind").agg(F.collect_list(F.struct("num", "str", "n")).alias("seen"))
    few = ~F.col("many") & F.col("kind").isin("number", "string") & (F.size("seen") <= MAX_ENUM)
    joined = totals.join(seen, ["path", "kind"], "left")
    few = F.coalesce(few, F.lit(False))
    return stage(
        joined.select(*[c for c in totals.columns if c != "many"], few.alias("few"), F.when(few, F.col("seen")).alias("seen")),
        "field-totals",
    )


def field_values(totals: DataFrame) -> DataFrame:
    """(path, kind, value, n) for number and string paths with <= MAX_ENUM distinct values."""
    rows = totals.where("few").select("path", "kind", "integral", F.size("seen").cast("long").alias("n_distinct"), F.inline("seen"))
    text = F.when(F.col("kind") == "string", F.col("str")).otherwise(
        F.when(F.col("integral") & (F.abs("num") < 1e37), F.col("num").cast("decimal(38,0)").cast("string"))
        .otherwise(F.col("num").cast("string"))
    )
    return rows.select("path", "kind", text.alias("value"), "num", "n", "n_distinct")


def field_profile(totals: DataFrame, values: DataFrame, strict: bool = False) -> DataFrame:
    """One row per path and kind, in path order.

    ``n_null`` and ``conflict`` (more than one kind) speak of the whole path. ``n_distinct``
    is NULL beyond MAX_ENUM and for booleans. ``strict`` raises on a null leaf, on a
    conflict and on a container below the last level.
    """
    distinct = values.groupBy("path", "kind").agg(F.max("n_distinct").alias("n_distinct"))
    whole_path = Window.partitionBy("path")
    is_null = F.col("kind") == "null"
    rows = (
        totals.withColumn("n_null", F.sum(F.when(is_null, F.col("n")).otherwise(0)).over(whole_path))
        .withColumn("_kinds", F.count_if(~is_null).over(whole_path))
        .where(~is_null | (F.col("_kinds") == 0))
        .join(distinct, ["path", "kind"], "left")
    )
    if strict:
        wrong = (F.col("_kinds") != 1) | (F.col("n_null") > 0) | (F.col("kind") == "truncated")
        message = F.concat(F.lit("null, mixed or too deep values at "), F.col("path"))
        rows = rows.where(
            F.when(wrong, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
        )
    number = storage_type(F.col("integral"), F.col("float32"), F.col("min"), F.col("max"))
    storage = (
        F.when(F.col("kind") == "number", number)
        .when(F.col("kind") != "string", F.col("kind"))
        .otherwise(F.when(F.col("n_distinct").isNotNull(), "enum").otherwise("string"))
    )
    is_bool = F.col("kind") == "bool"
    return rows.select(
        "path", "kind", "n", "n_null", "n_distinct", "min", "max", "integral", "float32",
        storage.alias("storage_type"),
        F.when(is_bool, F.col("n_true")).alias("n_true"),
        F.when(is_bool, F.col("n_false")).alias("n_false"),
        (F.col("_kinds") > 1).alias("conflict"),
    ).orderBy("path", "kind")


def profile_report(profile: DataFrame, values: DataFrame) -> DataFrame:
    """(path, line): the text form, one line per field; histograms in value order.

    A histogram has at most MAX_ENUM entries, so collecting one is bounded.
    """
    integral = F.col("integral")
    entry = F.when(F.col("kind") == "number", F.col("num")).alias("num")
    listed = values.groupBy("path", "kind").agg(
        F.sort_array(F.collect_list(F.struct(entry, "value", "n"))).alias("entries")
    )
    text = F.transform(
        F.coalesce("entries", F.array().cast("array<struct<num:double,value:string,n:bigint>>")),
        lambda e: F.concat(
            F.when(F.col("kind") == "number", number_text(e["num"], integral)).otherwise(e["value"]),
            F.lit(":"),
            e["n"].cast("string"),
        ),
    )
    numbers = F.array(
        F.col("storage_type"),
        number_text(F.col("min"), integral),
        number_text(F.col("max"), integral),
    )
    head = (
        F.when(F.col("kind") == "number", numbers)
        .when(
            F.col("kind") == "bool",
            F.array(
                F.concat(F.lit("true:"), F.col("n_true").cast("string")),
                F.concat(F.lit("false:"), F.col("n_false").cast("string")),
            ),
        )
        .when(F.col("storage_type") == "enum", F.array(F.lit("enum"), F.col("n_distinct").cast("string")))
        .otherwise(F.array("storage_type"))
    )
    return (
        profile.join(listed, ["path", "kind"], "left")
        .select("path", "kind", F.array_join(F.concat(F.array("path"), head, text), ";").alias("line"))
        .orderBy("path", "kind")
    )
