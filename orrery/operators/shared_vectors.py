"""Scores of whole tables whose terms share at most ``MOST_VECTORS`` distinct vectors.

Each term's vector is a number: the numbers and the distinct vectors go to all tasks (12 bytes a term), so no row carries a vector.
An entry's rows, two integers each, are dealt by its key, and a task goes through its entries in order of key, ``ENTRIES`` at a time.
For the mean of best matches it makes an entry's largest cosine with each vector that the query set has, once, from the cosines of the
distinct vectors; a slab of the query set is a matrix of weights by vector, and a product of both gives all scores of a block.
With ``k`` a task keeps each query key's k best and those within ``blocks.SLACK`` of the last; without, every pair is a row, which
is neither moved nor written here. Memory in a task is a slab, the cosines of the distinct vectors, and k rows for each query key.

None where more vectors are distinct, a term has several, or there are too many terms to be sent; the caller then goes over ``blocks``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as vec
from . import blocks, climb
from .lineage import cut, new_path

MOST_VECTORS, MOST_TERMS, SLAB = 4096, 16_000_000, 8_000_000
#: Entries and query keys of one product; nearest vectors that are looked up in an entry with at least one in ``DENSE`` of all.
ENTRIES, ASKED, NEAREST, DENSE = 1024, 2048, 32, 10


class Numbered:
    """Terms in order of id, each one's vector number, and the vectors."""

    def __init__(self, ids: np.ndarray, number: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.number, self.vectors = ids, number, vectors

    def numbers(self, values: np.ndarray) -> np.ndarray:
        if not len(self.ids):
            return np.full(len(values), -1)
        at = np.minimum(np.searchsorted(self.ids, values), len(self.ids) - 1)
        return np.where(self.ids[at] == values, at, -1)


def numbered(embedding: DataFrame) -> Numbered | None:
    rows = embedding.where("term_id is not null and v is not null").select("term_id", vec.doubles(F.col("v")).alias("v"))
    known = cut(rows.select(F.xxhash64("v").alias("h"), "v").distinct())
    if not 0 < known.count() <= MOST_VECTORS:
        return None
    lean = cut(rows.select("term_id", F.xxhash64("v").alias("h")))
    if lean.count() > MOST_TERMS:
        return None
    table, terms = known.toArrow().combine_chunks(), lean.toArrow()  # at most MOST_VECTORS and MOST_TERMS rows
    h, v = climb.arrow_values(table, 0), table["v"].combine_chunks()
    flat, sizes = v.flatten().to_numpy(zero_copy_only=False), v.value_lengths().to_numpy(zero_copy_only=False)
    ids = climb.arrow_values(terms, 0)
    by_hash, by_id = np.argsort(h), np.argsort(ids, kind="stable")
    if len(np.unique(h)) < len(h) or len(np.unique(ids)) < len(ids) or len(np.unique(sizes)) > 1 or not np.isfinite(flat).all():
        return None
    number = np.searchsorted(h[by_hash], climb.arrow_values(terms, 1)[by_id]).astype(np.int32)
    return Numbered(ids[by_id], number, flat.reshape(len(h), -1)[by_hash])


def dealt(rows: DataFrame, key: str, n: int) -> DataFrame:
    return rows.select(F.col(key).cast("long").alias("key"), "term_id").where("key is not null and term_id is not null").repartition(n, "key").sortWithinPartitions("key")


def entries_of(batches: Iterator[pa.RecordBatch], held: Numbered) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys, where each one's terms start, and these (places in ``held.ids``, each once); about ``ENTRIES`` keys at a time."""
    for keys, k, t, _ in climb.whole_keys(batches, held, 0):
        if len(k):
            start = np.concatenate(([0], np.flatnonzero(np.diff(k)) + 1))
            ends = np.append(start, len(k))
            for a in range(0, len(start), ENTRIES):
                part = ends[a : a + ENTRIES + 1]
                yield keys[k[part[:-1]]], part[:-1] - part[0], t[part[0] : part[-1]]


class Nearest:
    """By entry, the largest cosine of its vectors with each asked one."""

    def __init__(self, units: np.ndarray, asked: np.ndarray) -> None:
        self.cosines = units @ units[asked].T  # a row for each vector, a column for each asked one
        n = min(NEAREST, len(units))
        self.near = np.argsort(-self.cosines, axis=0)[:n].T.astype(np.int32)
        self.sorted = np.take_along_axis(self.cosines, self.near.T, axis=0).T

    def best(self, start: np.ndarray, number: np.ndarray) -> np.ndarray:
        n, size = len(self.cosines), np.diff(np.append(start, len(number)))
        out = np.empty((len(start), self.cosines.shape[1]))
        dense = np.flatnonzero(size * DENSE >= n)
        step = max(1, blocks.CELLS // max(1, self.near.size))
        for a in range(0, len(dense), step):
            part = dense[a : a + step]
            held = np.zeros((len(part), n), bool)
            for i, e in enumerate(part.tolist()):
                held[i, number[start[e] : start[e] + size[e]]] = True
            met = held[:, self.near]
            first = met.argmax(axis=2)
            out[part] = self.sorted[np.arange(len(self.sorted))[None], first]
            missed = ~np.take_along_axis(met, first[:, :, None], axis=2)[:, :, 0]
            for i in np.flatnonzero(missed.any(axis=1)).tolist():
                at = np.flatnonzero(missed[i])
                out[part[i], at] = self.cosines[np.ix_(np.flatnonzero(held[i]), at)].max(axis=0)
        few = np.flatnonzero(size * DENSE < n)
        width = max(1, blocks.CELLS // max(1, self.cosines.shape[1]))
        a = 0
        while a < len(few):  # entries of about ``width`` rows
            b = max(a + 1, a + int(np.searchsorted(np.cumsum(size[few[a:]]), width, side="right")))
            part = few[a:b]
            rows = np.concatenate([number[start[e] : start[e] + size[e]] for e in part.tolist()])
            out[part] = np.maximum.reduceat(self.cosines[rows], np.concatenate(([0], np.cumsum(size[part])[:-1])), axis=0)
            a = b
        return out


def best_cosines(query: DataFrame, library: DataFrame, key: str, embedding: DataFrame, ic: DataFrame, k: int | None = None) -> DataFrame | None:
    """(l, r, score) of patients and entries as ``match.best_match_similarity``: for each term of a patient the largest cosine over the
    entry's terms, averaged with the terms' content as weights (1 if unknown)."""
    spark, held = query.sparkSession, numbered(embedding)
    if held is None:
        return None
    n = max(1, len(held.vectors))
    number = F.col("term_id")
    rows = cut(query.select(F.col("patient_id").cast("long").alias("patient_id"), "term_id").where("patient_id is not null and term_id is not null").distinct().join(ic.hint("merge"), "term_id", "left").select("patient_id", number, F.coalesce("ic", F.lit(1.0)).alias("w")))
    slabs = max(1, -(-rows.count() // SLAB))
    lib = dealt(library, key, spark.sparkContext.defaultParallelism)
    lib = lib if slabs == 1 else dealt(cut(library.select(key, "term_id")), key, spark.sparkContext.defaultParallelism)
    schema, path, out = "l long, r long, score double", new_path(spark), []
    for s in range(slabs):
        part = rows.where(F.pmod(F.xxhash64("patient_id"), F.lit(slabs)) == s).toArrow()  # about SLAB rows
        at = held.numbers(climb.arrow_values(part, 1))
        patients, who = np.unique(climb.arrow_values(part, 0)[at >= 0], return_inverse=True)
        code, back = np.unique(who.astype(np.int64) * n + held.number[at[at >= 0]], return_inverse=True)
        weight = climb.arrow_values(part, 2)[at >= 0]
        total = np.bincount(who, weight, minlength=len(patients))
        with np.errstate(all="ignore"):
            share = np.bincount(back, weight, minlength=len(code)) / total[code // n]
        asked, column = np.unique(code % n, return_inverse=True)
        first = np.searchsorted(code // n, np.arange(len(patients) + 1))
        if not len(patients):
            continue
        shared = spark.sparkContext.broadcast((held, patients, first, asked, column.astype(np.int32), share))
        found = lib.mapInArrow(scored(shared, k), schema)
        if k:
            found.write.parquet(f"{path}/slab={s}")
        else:
            out.append(found)  # every pair is a row: they are not written here
    if not k:
        return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], schema)
    spark.createDataFrame([], schema).write.parquet(f"{path}/none")
    return spark.read.schema(schema).parquet(f"{path}/*")


def scored(shared, k: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, patients, first, asked, column, share = shared.value
        near, best = Nearest(blocks.unit_rows(held.vectors), asked), blocks.Best(len(patients), k) if k else None

        def batch(own, keys, scores):
            return pa.RecordBatch.from_arrays([pa.array(patients[own]), pa.array(keys), pa.array(scores)], ["l", "r", "score"])

        for keys, start, term in entries_of(batches, held):
            most = near.best(start, held.number[term]).T
            for a in range(0, len(patients), ASKED):
                own = np.arange(a, min(a + ASKED, len(patients)))
                x, y = first[a], first[own[-1] + 1]
                weights = np.zeros((len(own), len(asked)))
                weights[np.repeat(own - a, np.diff(first[a : own[-1] + 2])), column[x:y]] = share[x:y]
                scores = weights @ most
                if best is not None:
                    best.add(own, keys, scores)
                    continue
                step = max(1, blocks.SHARED // len(keys))
                for i in range(0, len(own), step):
                    part = own[i : i + step]
                    yield batch(np.repeat(part, len(keys)), np.tile(keys, len(part)), scores[i : i + step].ravel())
        if best is not None:
            own, keys, scores = best.rows()
            for a in range(0, len(own), blocks.SHARED):
                yield batch(own[a : a + blocks.SHARED], keys[a : a + blocks.SHARED], scores[a : a + blocks.SHARED])

    return run


def mean_vectors(rows: DataFrame, key: str, embedding: DataFrame, weight: DataFrame | None) -> DataFrame | None:
    """(key, v): the mean vector of a key's distinct terms, weighted by ``weight`` (term_id, ic), the plain mean where the weights sum to 0
    or less; terms without a vector or a weight have no part. Without ``weight`` all count 1."""
    spark, held = rows.sparkSession, numbered(embedding)
    if held is None:
        return None
    w = np.ones(len(held.ids))
    if weight is not None:
        known = weight.where("term_id is not null").select("term_id", F.coalesce(F.col("ic").cast("double"), F.lit(float("nan"))).alias("ic")).toArrow()  # one row a term
        ids, at = climb.arrow_values(known, 0), held.numbers(climb.arrow_values(known, 0))
        values = climb.arrow_values(known, 1)
        if len(np.unique(ids)) < len(ids) or not np.isfinite(values).all():
            return None
        w = np.full(len(held.ids), np.nan)
        w[at[at >= 0]] = values[at >= 0]
        keep = ~np.isnan(w)
        held, w = Numbered(held.ids[keep], held.number[keep], held.vectors), w[keep]
    shared, kind = spark.sparkContext.broadcast((held, w)), rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, w = shared.value
        for keys, start, term in entries_of(batches, held):
            size = np.diff(np.append(start, len(term)))
            total = np.add.reduceat(w[term], start)
            mine = np.where(np.repeat(total > 0, size), w[term], 1.0)
            total = np.where(total > 0, total, size)
            out = np.empty((len(keys), held.vectors.shape[1]))
            step = max(1, blocks.CELLS // max(1, held.vectors.shape[1] * int(size.max())))
            for a in range(0, len(keys), step):
                x, y = start[a], (start[a + step] if a + step < len(keys) else len(term))
                out[a : a + step] = np.add.reduceat(held.vectors[held.number[term[x:y]]] * mine[x:y, None], start[a : a + step] - x, axis=0)
            out /= total[:, None]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()), type=pa.list_(pa.field("element", pa.float64())))
            yield pa.RecordBatch.from_arrays([pa.array(keys), flat], [key, "v"])

    return dealt(rows, key, max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)).mapInArrow(run, f"{key} long, v array<double>").select(F.col(key).cast(kind).alias(key), "v")
