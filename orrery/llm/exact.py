"""Exact deduplication: Patricia tries own the byte strings, partition by partition.

Texts are equal when they are the same after lower-casing A-Z. Of equal texts the row with the largest
``doc_id`` stays (a null id is smaller than any other; of rows that repeat an id too, one stays).

1. Each task of the input folds its own copies into one row, so a text that makes up a third of the corpus
   reaches the next step once per task.
2. The folded rows are dealt out and sorted by byte length and a content hash. In that order each bucket's full
   byte strings go into a compressed radix trie; a terminal node keeps the owner. A bucket is a subtree below
   its length and hash: once the sorted stream has left it, the finished subtree is spilled to the output and
   freed, so a task holds one bucket's distinct texts and never its whole partition.

Null counts as empty; empty texts equal one another. Extra columns, whatever their names, pass through untouched. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import documents, unused

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bits of the content hash that names a bucket within a length.
HASH_BITS = 16
#: Bytes of distinct text that a task of the first step holds before it hands on what it has folded.
FOLD_BYTES = 32 << 20
#: Rows and bytes of an output batch.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


class Trie:
    """A compressed radix trie of byte strings. A node is [edge, children by first byte, terminal]."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]
        self.held = 0

    def terminal(self, key: bytes, new) -> list:
        """The terminal of ``key``; if there was none, ``new()`` becomes it."""
        node, at = self.root, 0
        while at < len(key):
            child = node[1].get(key[at])
            if child is None:
                child = [key[at:], {}, None]
                node[1][key[at]] = child
                self.held += len(child[0])
                node, at = child, len(key)
                break
            edge = child[0]
            if key.startswith(edge, at):
                node, at = child, at + len(edge)
                continue
            same = shared(edge, key, at)
            middle = [edge[:same], {edge[same]: child}, None]
            child[0] = edge[same:]
            node[1][key[at]] = middle
            node, at = middle, at + same
        if node[2] is None:
            node[2] = new()
        return node[2]

    def terminals(self) -> Iterator[list]:
        stack = [self.root]
        while stack:
            _, children, found = stack.pop()
            if found is not None:
                yield found
            stack.extend(children.values())


def shared(edge: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of ``edge`` and ``key[at:]``, by halving."""
    low, high = 0, min(len(edge), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if edge[low:middle] == key[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Rows:
    """Collects rows and hands them on as record batches."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, row: tuple, size: int) -> bool:
        self.rows.append(row)
        self.size += size + 64
        return len(self.rows) >= BATCH_ROWS or self.size >= BATCH_BYTES

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) if self.rows else [()] * len(self.schema)
        arrays = [pa.array(list(c), pa.binary()).cast(f.type) if pa.types.is_string(f.type) else pa.array(list(c), f.type) for c, f in zip(columns, self.schema)]
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)


def listed(batch: pa.RecordBatch, name: str) -> list:
    column = batch.column(name)
    return (column.cast(pa.binary()) if pa.types.is_string(column.type) else column).to_pylist()


def better(a, b) -> bool:
    """Whether id ``a`` is larger than ``b``; null is smallest."""
    return a is not None and (b is None or a > b)


def fold(names: list[str], id_col: str, text_col: str, fold_bytes: int, bits: int, extra: list[str]):
    """First step: of one task's equal texts one row, that with the largest id, and how many there were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, out = Trie(), None

        def flush() -> Iterator[pa.RecordBatch]:
            for row, count, key in trie.terminals():
                if out.add((*row, len(key), xxhash.xxh64_intdigest(key) & ((1 << bits) - 1), count), len(key)):
                    yield out.batch()

        for batch in batches:
            if out is None:
                fields = [batch.schema.field(n) for n in names]
                out = Rows(pa.schema([*fields, *(pa.field(c, pa.int64()) for c in extra)]))
            at = names.index(id_col)
            for row, text in zip(zip(*(listed(batch, n) for n in names)), listed(batch, text_col)):
                key = (text or b"").translate(LOWER)
                # one trie for a task: a digest leads, so that texts part within few bytes
                found = trie.terminal(hashlib.sha256(key).digest() + key, lambda: [row, 0, key])  # noqa: B023
                found[1] += 1
                if better(row[at], found[0][at]):
                    found[0] = row
            if trie.held >= fold_bytes:
                yield from flush()
                trie = Trie()
        if out is not None:
            yield from flush()
            yield out.batch()

    return run


def own(names: list[str], id_col: str, text_col: str, report: bool, extra: list[str]):
    """Second step, over rows in order of length and hash: one row for each distinct text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, here, out = Trie(), None, None

        def spill() -> Iterator[pa.RecordBatch]:
            for row, count, key in trie.terminals():
                done = (row[at], count, hashlib.sha256(key).hexdigest().encode()) if report else row
                if out.add(done, 0 if report else len(key)):
                    yield out.batch()

        at = names.index(id_col)
        for batch in batches:
            if out is None:
                fields = [batch.schema.field(n) for n in names]
                out = Rows(pa.schema([pa.field("keep_id", fields[at].type), pa.field("group_size", pa.int64()), pa.field("text_sha256", pa.string())]) if report else pa.schema(fields))
            buckets = zip(*(batch.column(c).to_pylist() for c in extra))
            for row, text, (size, code, count) in zip(zip(*(listed(batch, n) for n in names)), listed(batch, text_col), buckets):
                if here != (size, code):
                    yield from spill()
                    trie, here = Trie(), (size, code)
                key = (text or b"").translate(LOWER)
                found = trie.terminal(key, lambda: [row, 0, key])  # noqa: B023
                found[1] += count
                if better(row[at], found[0][at]):
                    found[0] = row
        if out is not None:
            yield from spill()
            yield out.batch()

    return run


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", report: bool = False, bits: int = HASH_BITS, fold_bytes: int = FOLD_BYTES) -> DataFrame:
    """One row per distinct text: the whole row that stays, or (``report``) keep_id, group_size and text_sha256."""
    names = [id_col, text_col] if report else docs.columns
    plain = docs.select(names)
    extra = unused(names, "_bytes", "_hash", "_count")
    folded = plain.mapInArrow(fold(names, id_col, text_col, fold_bytes, bits, extra), T.StructType([*plain.schema.fields, *(T.StructField(c, T.LongType()) for c in extra)]))
    dealt = folded.repartition(*extra[:2]).sortWithinPartitions(*extra[:2])
    result = T.StructType([T.StructField("keep_id", plain.schema[id_col].dataType), T.StructField("group_size", T.LongType()), T.StructField("text_sha256", T.StringType())]) if report else plain.schema
    return dealt.mapInArrow(own(names, id_col, text_col, report, extra), result)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's id and the SHA-256 of its normalised text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shas = [hashlib.sha256((t or b"").translate(LOWER)).hexdigest() for t in listed(batch, text_col)]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(shas, pa.string())], [id_col, "text_sha256"])

    plain = docs.select(id_col, text_col)
    return plain.mapInArrow(run, T.StructType([plain.schema[id_col], T.StructField("text_sha256", T.StringType())]))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    return owners(docs, id_col, text_col)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the id that stays for its text. Copies of one text join their owner by the text's
    digest; that side may be skewed, so it stays a shuffle join whose large partitions Spark can split."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    joined = digests(docs).join(owners(docs, report=True).hint("merge"), "text_sha256")
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


OP8_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT doc_id, sha256(t) AS text_sha256, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g
"""
