"""Ranked lexical search without a document index: an Aho-Corasick automaton of all items' terms runs over each text.

Terms are runs of ASCII letters and digits and of everything beyond ASCII, with A-Z in lower case. In a text every other
character becomes a space, and each term stands in the automaton between two spaces, so that a match is a whole term and
the matches of a term are its tf. One pass over the texts gives a compact table (document, number of terms, matched terms
and their tf), which is written; document frequencies are an aggregate of it, and the ranking a second pass over it, in which
each task keeps ten documents for an item. Each term's output is the list of items that ask for it.

Items are dealt to blocks of about ``ITEMS`` items and ``BYTES`` of text, and each block has an automaton and a pass of its own, so
what the driver and a task hold doesn't grow with the items. A row of the items' table is an item. Null and empty texts have no
terms; such documents count neither in N nor in the result, such items have no rows. Documents without an id come last among
equal scores. Repeated rows are documents of their own. Sums are exact 64-bit integers.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import documents, written

ITEMS, BYTES, TOP = 1024, 16_000_000, 10
#: The values of a chunk of the ranking: documents by items, and sums to be added.
CELLS = 2_000_000
_lower = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_automata: dict[str, ahocorasick.Automaton] = {}


def normal(text: str | None) -> bytes:
    """A text's terms between spaces."""
    return (text or "").encode().translate(_lower)


def automaton(key: str, terms: list[str]) -> ahocorasick.Automaton:
    """The automaton of ``terms``, built once for each worker; only the latest stays."""
    if key not in _automata:
        _automata.clear()
        a = ahocorasick.Automaton()
        for i, t in enumerate(terms):
            a.add_word(f" {t} ", i)
        a.make_automaton()
        _automata[key] = a
    return _automata[key]


def matched(docs: DataFrame, terms: list[str], id_col: str, text_col: str) -> DataFrame:
    """(doc, n, terms array<int>, tfs array<int>): a document's number of terms, and tf of those of ``terms`` that it holds."""
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(key, terms) if terms else None
        for batch in batches:
            ns, offsets, held, tfs = [], [0], [], []
            for t in batch.column(1):
                b = normal(t.as_py())
                ns.append(len(b.split()))
                if found:
                    counts = Counter(map(itemgetter(1), found.iter(f" {b.decode()} ")))
                    held += counts.keys()
                    tfs += counts.values()
                offsets.append(len(held))
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int32())) for x in (held, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), *lists], ["doc", "n", "terms", "tfs"])

    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc long, n long, terms array<int>, tfs array<int>")


def best(items: np.ndarray, scores: np.ndarray, docs: np.ndarray, unknown: np.ndarray, k: int) -> np.ndarray:
    """The places of each item's ``k`` best: highest score, then least id, ids that are unknown last."""
    order = np.lexsort((docs, unknown, -scores, items))
    sorted_ = items[order]
    start = np.flatnonzero(np.diff(sorted_, prepend=-1))
    nth = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return order[nth < k]


def scored(held: DataFrame, weights: np.ndarray, first: np.ndarray, asked: np.ndarray, n_items: int, documents_: int, length: int, k: int) -> DataFrame:
    """(item, doc, score) of each task's ``k`` best documents for an item. ``asked``: the items of each term, from ``first`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
        floor = np.zeros(n_items, np.int64)
        for batch in batches:
            docs = batch.column(0)
            unknown = docs.is_null().to_numpy(zero_copy_only=False)
            ids, n = docs.fill_null(0).to_numpy(), batch.column(1).to_numpy()
            ends = np.concatenate(([0], np.cumsum(batch.column(2).value_lengths().to_numpy())))
            term, tf = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
            fan = np.concatenate(([0], np.cumsum(first[term + 1] - first[term])))  # sums before a match
            at = 0
            while at < len(ids):
                to = min(at + max(1, CELLS // n_items), max(at + 1, int(np.searchsorted(fan[ends], fan[ends[at]] + CELLS, "right")) - 1))
                a, b = ends[at], ends[to]
                row = np.repeat(np.arange(to - at), np.diff(ends[at : to + 1]))
                m = 100 - 90 + (90 * n[at:to] * documents_) // length
                part = weights[term[a:b]] * ((1_000_000_000 * tf[a:b]) // (1000 * tf[a:b] + 8 * m[row]))
                width = np.diff(fan[a : b + 1])
                place = np.repeat(first[term[a:b]] - (fan[a:b] - fan[a]), width) + np.arange(fan[b] - fan[a])
                sums = np.zeros((to - at) * n_items, np.int64)
                np.add.at(sums, np.repeat(row, width) * n_items + asked[place], np.repeat(part, width))
                sums = sums.reshape(to - at, n_items)
                least = floor if to - at <= k else np.maximum(floor, np.partition(sums, to - at - k, axis=0)[to - at - k])
                r, i = np.nonzero((sums >= least) & (sums > 0))
                top = [np.concatenate(x) for x in zip(top, (i, sums[r, i], ids[at:to][r], unknown[at:to][r]))]
                keep = best(*top, k)
                top = [x[keep] for x in top]
                full = np.bincount(top[0], minlength=n_items) == k
                last = np.full(n_items, np.iinfo(np.int64).max)
                np.minimum.at(last, top[0], top[1])
                floor[full] = last[full]
                at = to
        if len(top[0]):
            yield pa.RecordBatch.from_arrays([pa.array(top[0]), pa.array(top[2], mask=top[3]), pa.array(top[1])], ["item", "doc", "score"])

    return held.mapInArrow(run, "item long, doc long, score long")


def weight(documents_: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents_ + 2) / (2 * df + 1)))


def search(docs: DataFrame, items: DataFrame, k: int = TOP, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", items_in_block: int = ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` highest-scoring documents with a score above 0."""
    spark = docs.sparkSession
    asked = written(items.select(F.col(item_id).alias("item_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("uid")), "items")
    count, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-count // items_in_block), -(-size // BYTES))
    schema = f"item_id {asked.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long"
    out = [spark.createDataFrame([], schema)]
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("uid"), F.lit(blocks)) == block).select("item_id", "text").collect()
        sets = [sorted({t.decode() for t in normal(r.text).split()}) for r in rows]
        terms = sorted({t for s in sets for t in s})
        if not terms:
            continue
        number = {t: i for i, t in enumerate(terms)}
        pairs = np.array(sorted((number[t], i) for i, s in enumerate(sets) for t in s), np.int64)
        first = np.concatenate(([0], np.cumsum(np.bincount(pairs[:, 0], minlength=len(terms)))))
        held = written(matched(docs, terms, doc_id, text_col), "lexical")
        total = held.agg(F.count_if(F.col("n") > 0).alias("n"), F.sum("n").alias("l")).first()
        if not total.n:
            continue
        df = dict(held.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # one row a term of the block
        weights = np.array([weight(total.n, df.get(i, 0)) for i in range(len(terms))], np.int64)
        near = scored(held, weights, first, pairs[:, 1].copy(), len(rows), total.n, total.l, k)
        names = F.broadcast(spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"item long, item_id {asked.schema['item_id'].dataType.simpleString()}"))  # at most a block
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
        ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).join(names, "item")
        out.append(ranked.select("item_id", "rank", F.col("doc").alias("doc_id"), "score"))
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_terms = "unnest(regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"
OP13_SQL = f"""WITH d AS (SELECT doc_id, {_terms.format('text')} AS term FROM documents), i AS (SELECT DISTINCT item_id, {_terms.format('text')} AS term FROM benchmark),
  size AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1), total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS l FROM size),
  tf AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM i) GROUP BY 1, 2),
  w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY 1),
  s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * n_docs) // l))))) AS BIGINT) AS score FROM i JOIN tf USING (term) JOIN w USING (term) JOIN size USING (doc_id), total GROUP BY 1, 2)
  SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= {TOP}"""
