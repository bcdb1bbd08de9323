"""Byte-level BPE encoding and decoding over Arrow batches.

The tokenizers library does the merging on texts whose bytes are written as printable
characters. Texts repeat their words, so a batch is cut before spaces that always begin a
match of the pattern, each distinct piece is encoded once, and array operations put the ids
of every text together. Ranks name only the merged bytes, so one merged token can have
several pairs; all of them are merges, in the order of the ranks. The tests compare the ids
with those of the tiktoken library.

Nulls and empty texts have no tokens. Bytes that are not UTF-8 are read as U+FFFD. Texts may
be of any length. Other columns stay; a column that is called like a new one is replaced.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from paperloom.llm.words import batch_rows, buffer_of, hash_words, release, slices

CACHED_PIECES = 100_000
SLICE = 2 << 20
NO_BYTE = np.zeros(256, bool)


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where Latin-1 shows it, else from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class Codec:
    """A vocabulary with its encoder; one for each Python worker and vocabulary."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        chars = byte_characters()
        spell = lambda raw: "".join(chars[b] for b in raw)
        merges = []
        for token in sorted(ranks, key=ranks.get):
            cuts = [(token[:i], token[i:]) for i in range(1, len(token))]
            known = [(ranks[a], ranks[b], a, b) for a, b in cuts if a in ranks and b in ranks]
            merges += [(spell(a), spell(b)) for _, _, a, b in sorted(known)]
        model = models.BPE(vocab={spell(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [
                pre_tokenizers.Split(Regex(pattern), "isolated"),
                pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
            ]
        )
        # the byte table, read back from the characters
        byte_of = {c: b for b, c in enumerate(chars)}
        size = max(ranks.values()) + 1
        spelled = [""] * size
        for token, rank in ranks.items():
            spelled[rank] = spell(token)
        raw = [bytes(byte_of[c] for c in s) for s in spelled]
        self.lengths = np.array([len(r) for r in raw], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.pool = np.zeros(1 << 16, np.uint32)
        self.filled = 0
        self.at, self.n = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def end_task(self) -> None:
        """Drops what the task has learned; the vocabulary stays for the worker's next tasks."""
        self._forget()
        release()

    def _learn(self, hashes: list[int], pieces: list[str]) -> None:
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        ids = [encoding.ids for encoding in found]
        k, n = len(self.known), np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(n.sum()))
        if self.filled + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(flat)), np.uint32)])
        if k + len(ids) > len(self.at):
            more = np.zeros(max(len(self.at), len(ids)), np.int64)
            self.at, self.n = np.concatenate([self.at, more]), np.concatenate([self.n, more])
        self.pool[self.filled : self.filled + len(flat)] = flat
        self.at[k : k + len(ids)] = self.filled + np.cumsum(n) - n
        self.n[k : k + len(ids)] = n
        self.filled += len(flat)
        self.known.update(zip(hashes, range(k, k + len(ids)), strict=True))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows' bytes, and where each row's ids begin."""
        starts = piece_starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        hashes, first, inverse = np.unique(
            hash_words(data, starts, ends, NO_BYTE), return_index=True, return_inverse=True
        )
        if len(self.known) > CACHED_PIECES:
            self._forget()
        keys = hashes.tolist()
        new = [i for i, h in enumerate(keys) if h not in self.known]
        if new:
            raw = data.tobytes()
            cut = [(int(starts[first[i]]), int(ends[first[i]])) for i in new]
            self._learn([keys[i] for i in new], [raw[a:b].decode("utf-8", "replace") for a, b in cut])
        place = np.array([self.known[h] for h in keys], np.int64)[inverse]
        n = self.n[place]
        before = np.cumsum(n) - n
        ids = self.pool[np.repeat(self.at[place] - before, n) + np.arange(n.sum())]
        rows = np.append(before, n.sum())[np.searchsorted(starts, offsets)]
        return ids, rows

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids; a character may be split between two of them."""
        n = self.lengths[ids]
        before = np.cumsum(n) - n
        return self.bytes[np.repeat(self.begins[ids] - before, n) + np.arange(n.sum())]


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Row starts and spaces that follow a character that is surely no white space.

    A match of the pattern holds white space before other characters only as its first
    character, so one always ends before such a space, and the pattern never looks back.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    space = np.flatnonzero(data == 0x20)
    space = space[space > 0]
    last = data[space - 1]
    lead2 = data[np.maximum(space - 2, 0)]
    lead3 = data[np.maximum(space - 3, 0)]
    ascii_blank = (last <= 0x20) | (last == 0x7F)
    wide_blank = (last >= 0x80) & ((lead2 == 0xC2) | ((lead3 >= 0xE1) & (lead3 <= 0xE3)))
    begin = np.zeros(len(data), bool)
    begin[space[~(ascii_blank | wide_blank)]] = True
    begin[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(begin)


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _encoded(texts: pa.Array, own: Codec) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    data, offsets = buffer_of(texts)
    for at, to in slices(data, offsets, SLICE):
        part, rows = data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        yield at, to, part, rows, *own.encode(part, rows)


def _with(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = {f.name: batch.column(i) for i, f in enumerate(batch.schema) if f.name not in new}
    return pa.RecordBatch.from_pydict(kept | new)


def _extended(df: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    names = {name for name, _ in fields}
    kept = [f for f in df.schema.fields if f.name not in names]
    return T.StructType(kept + [T.StructField(name, kind) for name, kind in fields])


def _list(values: pa.Array, rows: list[np.ndarray]) -> pa.Array:
    sizes = np.concatenate([np.diff(r) for r in rows]) if rows else np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _joined(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", offsets: bool = False) -> DataFrame:
    """``df`` with ``ids`` (array of int) and, on request, each token's ``begins`` and ``ends``.

    These count characters of the text; a token that has a part of a character begins or ends
    with that character.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            ids, rows, begins, ends = [], [], [], []
            for _, _, data, cut, got, where in _encoded(batch.column(text), own):
                ids.append(got)
                rows.append(where)
                if offsets:
                    n = own.lengths[got]
                    till = np.cumsum(n)
                    # characters begun up to each byte, counted within the row
                    chars = np.cumsum((data & 0xC0) != 0x80)
                    skipped = np.repeat(np.append(0, chars)[cut[:-1]], np.diff(where))
                    begins.append(chars[till - n] - 1 - skipped if len(got) else n)
                    ends.append(chars[till - 1] - skipped if len(got) else n)
            new = {"ids": _list(pa.array(_joined(ids, np.int32)), rows)}
            if offsets:
                new |= {"begins": _list(pa.array(_joined(begins, np.int32)), rows)}
                new |= {"ends": _list(pa.array(_joined(ends, np.int32)), rows)}
            yield _with(batch, new)
        own.end_task()

    batch_rows(df.sparkSession)
    kind = T.ArrayType(T.IntegerType())
    names = ["ids", *(["begins", "ends"] if offsets else [])]
    return df.mapInArrow(run, _extended(df, *((n, kind) for n in names)))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``df`` with the texts of its ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            texts = []
            for row in batch.column(ids):
                got = np.array(row.as_py() or [], np.int64)
                texts.append(own.decode(got).tobytes().decode("utf-8", "replace"))
            yield _with(batch, {into: pa.array(texts, pa.string())})

    return df.mapInArrow(run, _extended(df, (into, T.StringType())))


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode, decode the ids again, and return digests of both instead of the text.

    Columns: those of ``df`` without the text, ``n_tokens``, ``ids_sha256`` (ids as
    little-endian unsigned 32-bit integers), ``decoded_sha256`` (decoded bytes), and ``ids``
    on request. One pass, no shuffle; the ids need not leave the Python worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            n, first, second, all_ids, all_rows = [], [], [], [], []
            for _, _, _, _, ids, rows in _encoded(batch.column(text), own):
                n.append(np.diff(rows))
                raw, back = ids.astype("<u4").tobytes(), own.decode(ids).tobytes()
                at = np.append(0, np.cumsum(own.lengths[ids]))[rows].tolist()
                cut = (rows * 4).tolist()
                first += [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(cut, cut[1:], strict=False)]
                second += [hashlib.sha256(back[a:b]).hexdigest() for a, b in zip(at, at[1:], strict=False)]
                if keep_ids:
                    all_ids.append(ids)
                    all_rows.append(rows)
            new = {
                "n_tokens": pa.array(_joined(n, np.int64)),
                "ids_sha256": pa.array(first, pa.string()),
                "decoded_sha256": pa.array(second, pa.string()),
            }
            if keep_ids:
                new["ids"] = _list(pa.array(_joined(all_ids, np.int32)), all_rows)
            yield _with(batch.drop_columns([text]), new)
        own.end_task()

    batch_rows(df.sparkSession)
    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    fields += [("ids", T.ArrayType(T.IntegerType()))] * keep_ids
    return df.mapInArrow(run, _extended(df.drop(text), *fields))
