"""Sparse document-term matrix: counts of the words of each document, in CSR shards.

A shard is a run of documents of one task. Its words are dictionary-encoded at once, from the
bytes of the texts, and counted per document under the shard's own numbers. Only the list of
a shard's distinct words is shuffled, cut by a hash of the word into many buckets: in each,
the distinct words of the table are numbered, and each shard's numbers are replaced by these.
A word that every document has is thus sent once per shard, never once per document, and no
dictionary is held in one place.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.llm.words import BLANK, batch_rows, bounds, buffer_of, hash_words, release, slices
from paperloom.session import stage

#: Bytes of text in a shard; one longer document is a shard of its own.
SHARD = 1 << 23
#: Buckets of words for each shuffle partition.
BUCKETS = 16

def word_column(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK) -> tuple[pa.Array, np.ndarray]:
    """All words of some texts as one Arrow column, and the rows' offsets in it.

    Words keep their order, so leaving the separators out of the bytes puts them end to end.
    """
    starts, ends = bounds(data, offsets, blank)
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    inside = np.ascontiguousarray(data[~blank[data]])
    found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(inside))
    return found, np.searchsorted(starts, offsets).astype(np.int64)


def counted(codes: np.ndarray, rows: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(indptr, indices, data) of the codes of ``codes[rows[i]:rows[i + 1]]``, sorted in a row."""
    row = np.repeat(np.arange(len(rows) - 1, dtype=np.int64), np.diff(rows))
    entry, data = np.unique(row * max(1, n_words) + codes, return_counts=True)
    row, indices = np.divmod(entry, max(1, n_words))
    return np.searchsorted(row, np.arange(len(rows))), indices, data


def _list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _packed(values: np.ndarray, kind: str) -> pa.Array:
    return pa.array([values.astype(kind).tobytes()], pa.binary())


def _unpacked(column: pa.Array | pa.ChunkedArray, i: int, kind: str) -> np.ndarray:
    return np.frombuffer(column[i].as_py(), kind)


def _by_bucket(words: pa.Array, buckets: int) -> tuple[np.ndarray, pa.Array]:
    """Each word's number when words are ordered by bucket, and the buckets' words:
    list<struct<bucket, start, words>>, where the first word of a bucket has number ``start``
    and the words are joined by blanks."""
    data, offsets = buffer_of(words)
    bucket = (hash_words(data, offsets[:-1], offsets[1:], np.zeros(256, bool)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    number = np.empty(len(words), np.int64)
    number[order] = np.arange(len(words))
    there, start = np.unique(bucket[order], return_index=True)
    cut = pa.ListArray.from_arrays(
        pa.array(np.append(start, len(words)), pa.int32()), words.take(pa.array(order))
    )
    joined = pc.binary_join(cut, pa.scalar(" ", pa.large_string())).cast(pa.string())
    columns = [pa.array(there), pa.array(start.astype(np.int32)), joined]
    return number, _list(pa.StructArray.from_arrays(columns, ["bucket", "start", "words"]))


def _split(table: pa.Table) -> pa.Array:
    """The words of a bucket, a list for each shard."""
    return pc.split_pattern(table.column("words"), " ").combine_chunks()


def document_term_matrix(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """``(matrix, dictionary)`` of the words `[^\\x20\\x09-\\x0D]+` of a column, as they are.

    * matrix: (shard, indptr, indices, data, rows), one row per shard. Document i of a shard
      is ``rows[i]``, a struct of the columns ``keep``; its words are
      ``indices[indptr[i]:indptr[i + 1]]``, each once, with their counts in ``data``. The
      three are packed as little-endian integers, ``indices`` of 64 bits, the others of 32;
      ``entries`` has them as rows.
    * dictionary: (term, word), each distinct word once. Numbers have few gaps: they go round
      the buckets.

    Each row is a document, whatever its id: null and repeated ids and repeated rows stay.
    A null, empty or blank text is an empty row. Only ``keep`` and ``text`` are read, so other
    columns of any name do not matter; ``keep`` must not name one twice. An empty table gives
    a matrix and a dictionary without rows. A document is never cut, so a shard is bounded by
    ``SHARD`` or by its one longer document. A bucket holds its words of all shards: their
    number follows the session's shuffle partitions.
    """
    spark = docs.sparkSession
    batch_rows(spark)
    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = docs.select(F.struct(*keep).alias("rows"), F.col(text).alias("text"))
    row = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in keep])
    packed = [T.StructField(n, T.BinaryType()) for n in ("indptr", "indices", "data")]
    out = T.StructType([T.StructField("shard", T.LongType()), *packed, T.StructField("rows", T.ArrayType(row))])
    cut = T.StructType().add("bucket", "integer").add("start", "integer").add("words", "string")
    schema = T.StructType([*out.fields, T.StructField("buckets", T.ArrayType(cut))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = buffer_of(batch.column(1))
            for at, to in slices(data, offsets, SHARD):
                part, own = data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
                words, rows = word_column(part, own)
                coded = words.dictionary_encode()
                number, by_bucket = _by_bucket(coded.dictionary, buckets)
                indptr, indices, counts = counted(number[coded.indices.to_numpy()], rows, len(number))
                columns = [
                    pa.array([shard], pa.int64()),
                    _packed(indptr, "<i4"),
                    _packed(indices, "<i4"),
                    _packed(counts, "<i4"),
                    _list(batch.column(0).slice(at, to - at)),
                    by_bucket,
                ]
                yield pa.RecordBatch.from_arrays(columns, schema.names)
                shard += 1
        release()

    def numbers(words: pa.Array, bucket: int) -> tuple[np.ndarray, pa.Array]:
        """The number of each word and the distinct words in the order of their numbers, which
        do not depend on the order of the words that come in."""
        coded = words.dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return place[coded.indices.to_numpy()] * buckets + bucket, coded.dictionary.take(pa.array(order))

    def numbered(table: pa.Table) -> pa.Table:
        listed = _split(table)
        term, _ = numbers(listed.flatten(), table.column("bucket")[0].as_py())
        at = listed.offsets.to_numpy() - listed.offsets[0].as_py()
        terms = pa.array([term[a:b].astype("<i8").tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())
        return pa.table([table.column("of"), table.column("start"), terms], ["of", "start", "terms"])

    def listed_words(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        _, words = numbers(_split(table).flatten(), bucket)
        return pa.table([pa.array(np.arange(len(words)) * buckets + bucket), words], ["term", "word"])

    def renumbered(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("start").to_numpy())
        term = np.concatenate([np.zeros(0, "<i8"), *(_unpacked(right.column("terms"), i, "<i8") for i in order)])
        local = _unpacked(left.column("indices"), 0, "<i4")
        return left.set_column(left.column_names.index("indices"), "indices", _packed(term[local], "<i8"))

    shards = stage(kept.mapInArrow(run, schema), "shards")
    listed = shards.select(F.col("shard").alias("of"), F.inline("buckets")).groupBy("bucket")
    terms = listed.applyInArrow(numbered, "of bigint, start int, terms binary")
    by_shard = shards.drop("buckets").groupBy("shard").cogroup(terms.groupBy("of"))
    return by_shard.applyInArrow(renumbered, out), listed.applyInArrow(listed_words, "term bigint, word string")


def entries(matrix: DataFrame) -> DataFrame:
    """The nonzero entries as rows: the kept columns of a document, ``term`` and ``n``."""
    row = matrix.schema["rows"].dataType.elementType
    schema = T.StructType([*row.fields, T.StructField("term", T.LongType()), T.StructField("n", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                indptr, data = (_unpacked(batch.column(c), i, "<i4") for c in (0, 2))
                document = pa.array(np.repeat(np.arange(len(indptr) - 1), np.diff(indptr)))
                kept = batch.column(3).slice(i, 1).flatten().take(document).flatten()
                term = pa.array(_unpacked(batch.column(1), i, "<i8"))
                yield pa.RecordBatch.from_arrays([*kept, term, pa.array(data)], schema.names)

    return matrix.select("indptr", "indices", "data", "rows").mapInArrow(run, schema)


def row_statistics(matrix: DataFrame) -> DataFrame:
    """The kept columns of each document with ``n_words``, its row's sum, and ``n_distinct``,
    its number of nonzero entries. Neither the dictionary nor the word numbers are read."""
    row = matrix.schema["rows"].dataType.elementType
    schema = T.StructType([*row.fields, T.StructField("n_words", T.LongType()), T.StructField("n_distinct", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                indptr, data = (_unpacked(batch.column(c), i, "<i4") for c in (0, 1))
                total = np.concatenate([[0], np.cumsum(data, dtype=np.int64)])
                sums = [np.diff(total[indptr]), np.diff(indptr).astype(np.int64)]
                kept = batch.column(2).slice(i, 1).flatten().flatten()
                yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, sums)], schema.names)

    return matrix.select("indptr", "data", "rows").mapInArrow(run, schema)
