"""A query set against a whole library of vectors, exactly.

The library is written once in blocks of about ``ROWS`` vectors and stays where it is; the query set goes to it in slabs of about
``SLAB`` vectors, a bounded table that is sent to all tasks. A task works on one block at a time as matrices, over the distinct
vectors of both sides and at most ``CELLS`` values at once, so its memory does not depend on the tables' sizes. All
rows of a key are in one block or slab. With ``k`` a task keeps what can be among a query key's k best: k rows and those within ``SLACK``
of the last, so that rounding later changes nothing; one block is scored first, and its k-th scores are where all tasks start; bounds (a centroid and an angle, or distances to pivots) leave out entries
that can't be among them before they are scored. Without ``k`` every pair is a row, or those above ``least``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import by_block, cut, new_path

ROWS, SLAB, CELLS, SLACK, PIVOTS = 8192, 32768, 4_000_000, 1e-6, 8
#: Rows of a slab whose rows share at most ``SLAB`` vectors; query vectors that are compared at once; blocks after which bounds are judged.
SHARED, AT_ONCE, TRIED = 1_000_000, 256, 1

#: keys, weights and vectors of a block's rows, in order of keys; in a slab of shared vectors the distinct ones, and each row's number.
Block = tuple[np.ndarray, ...]


def packed(rows: DataFrame, key: str, weight: Column, vector: Column, size: int) -> DataFrame:
    """(block, rows array<struct<k, w, v>>) by a hash of ``key``."""
    n = max(1, -(-rows.count() // size))
    held = rows.select(F.pmod(F.xxhash64(key), F.lit(n)).alias("block"), F.struct(F.col(key).cast("long").alias("k"), weight.cast("double").alias("w"), vector.alias("v")).alias("r"))
    return by_block(held, "block", n).groupBy("block").agg(F.sort_array(F.collect_list("r")).alias("rows"))


def unpacked(column: pa.Array, i: int) -> Block:
    rows = column[i].values
    flat = rows.field("v").flatten().to_numpy(zero_copy_only=False)
    k = len(rows)
    return rows.field("k").to_numpy(), rows.field("w").to_numpy(zero_copy_only=False), flat.reshape(k, -1) if k else flat.reshape(0, 1)


def unit_rows(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.where(n > 0, m / np.where(n > 0, n, 1), m)


def starts_of(keys: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1)) if len(keys) else np.zeros(0, int)


def distinct(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, and for each row its number among them."""
    flat = np.ascontiguousarray(m)
    seen, first, back = np.unique(flat.view(np.dtype((np.void, flat.dtype.itemsize * flat.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return flat[first], back


def ball_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances in the ball of all pairs of rows."""
    return distance_of(ball_ratios(a, b))


def distance_of(x: np.ndarray) -> np.ndarray:
    return np.log(x + np.sqrt(x * x - 1))


def ball_ratios(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What the distances rise with; squares come from the inner products."""
    aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    square = np.maximum(aa[:, None] + bb[None] - 2 * (a @ b.T), 0)
    return np.maximum(1 + 2 * square / ((1 - np.minimum(aa, 1 - 1e-4))[:, None] * (1 - np.minimum(bb, 1 - 1e-4))[None]), 1 + 1e-5)


def extremes(values, n: int, back: np.ndarray, sizes: np.ndarray, most) -> np.ndarray:
    """For ``n`` query vectors and each entry the largest (or least) of its rows; ``values(i, j)`` has a row for each distinct vector of
    the entries and a column for each query vector from i to j, and ``back`` numbers the entries' rows, ``sizes`` for each."""
    out = np.empty((n, len(sizes)))
    begin = np.concatenate(([0], np.cumsum(sizes)))
    for i in range(0, n, AT_ONCE):
        held = values(i, min(i + AT_ONCE, n))
        if len(back) == len(sizes):
            out[i : i + AT_ONCE] = held[back].T
            continue
        for e in range(len(sizes)):
            out[i : i + AT_ONCE, e] = most(held[back[begin[e] : begin[e + 1]]], axis=0)
    return out


class Side:
    """A slab of the query set: its keys, and its rows over distinct vectors."""

    def __init__(self, block: Block) -> None:
        keys, weights, vectors, *back = block
        self.start = starts_of(keys)
        self.keys = keys[self.start]
        self.size = np.diff(np.append(self.start, len(keys)))
        if back:
            self.vectors, self.back = vectors, back[0]
        else:
            self.vectors, self.back = distinct(vectors) if len(keys) else (vectors, np.zeros(0, int))
        total = np.add.reduceat(weights, self.start) if len(keys) else weights
        self.share = weights / np.repeat(total, self.size)

    def mean(self, values: np.ndarray, own: np.ndarray) -> np.ndarray:
        """For the query keys ``own`` the mean, by the rows' weights, of rows of ``values`` (a row for each distinct vector)."""
        out = np.empty((len(own), values.shape[1]))
        if (self.size[own] == 1).all():
            rows = self.start[own]
            return values[self.back[rows]] * self.share[rows, None]
        for i, (s, n) in enumerate(zip(self.start[own].tolist(), self.size[own].tolist())):
            out[i] = self.share[s : s + n] @ values[self.back[s : s + n]]
        return out


class Best:
    """What can be among the ``k`` highest scores of each query key, of which at least k reach ``least``."""

    def __init__(self, n: int, k: int, least: np.ndarray | None = None) -> None:
        self.k, self.top, self.parts, self.held = k, np.full((n, k), -np.inf), [], 0
        if least is not None:
            self.top[:] = least[:, None]

    def floor(self) -> np.ndarray:
        return self.top.min(axis=1) - SLACK

    def add(self, own: np.ndarray, keys: np.ndarray, scores: np.ndarray) -> None:
        both = np.concatenate((self.top[own], scores), axis=1)
        self.top[own] = np.partition(both, both.shape[1] - self.k, axis=1)[:, both.shape[1] - self.k :]
        i, j = np.nonzero(scores >= self.floor()[own, None])
        self.parts.append((own[i], keys[j], scores[i, j]))
        self.held += len(i)
        if self.held > CELLS:
            self.parts = [self.rows()]
            self.held = len(self.parts[0][0])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own, keys, scores = (np.concatenate(x) for x in zip(*self.parts)) if self.parts else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        keep = scores >= self.floor()[own]
        return own[keep], keys[keep], scores[keep]


class Cosine:
    """Mean, by the query rows' weights, of each query row's largest cosine with an entry's rows; for keys of one row, their
    cosine. An entry's rows lie within an angle of their centroid, which bounds every cosine with them."""

    def __init__(self, library: DataFrame) -> None:
        pass

    def prepared(self, block: Block) -> Side:
        return Side((block[0], block[1], unit_rows(block[2]), *block[3:]))

    def library(self, block: Block) -> tuple[np.ndarray, Any]:
        """An entry's key, and what is known of it."""
        v = unit_rows(block[2])
        at = starts_of(block[0])
        sizes = np.diff(np.append(at, len(v)))
        centre = unit_rows(np.add.reduceat(v, at, axis=0))
        angle = np.maximum.reduceat(np.arccos(np.clip((v * np.repeat(centre, sizes, axis=0)).sum(axis=1), -1, 1)), at)
        odd = np.minimum.reduceat(np.linalg.norm(v, axis=1), at) < 0.5  # a zero vector's cosine is 0, at any angle
        return block[0][at], (v, at, sizes, centre, np.where(odd, np.pi, angle))

    def bound(self, left: Side, entries: Any, own: np.ndarray) -> np.ndarray:
        _, _, _, centre, angle = entries
        near = np.cos(np.maximum(np.arccos(np.clip(left.vectors @ centre.T, -1, 1)) - angle[None], 0))
        near[np.linalg.norm(left.vectors, axis=1) < 0.5] = 0
        return left.mean(near, own)

    def scores(self, left: Side, entries: Any, own: np.ndarray, take: np.ndarray) -> np.ndarray:
        v, at, sizes, _, _ = entries
        rows = np.concatenate([np.arange(at[j], at[j] + sizes[j]) for j in take])
        other, back = distinct(v[rows])
        return left.mean(extremes(lambda i, j: other @ left.vectors[i:j].T, len(left.vectors), back, sizes[take], np.max), own)


class Ball:
    """Minus the mean of both sides' mean least distances in the ball; for keys of one row, minus their distance. The distance is a
    metric, so the least and largest distance of an entry's rows to a pivot bound those to any query row from below."""

    def __init__(self, library: DataFrame) -> None:
        sample = [r.v for r in library.orderBy(F.xxhash64("key"), "v").limit(1024).select("v").collect()]  # any pivots serve
        self.pivots = np.zeros((0, 1))
        if sample:
            rows, chosen = np.array(sample, float), [0]
            nearest = ball_distances(rows, rows[:1])[:, 0]
            while len(chosen) < min(PIVOTS, len(rows)):
                chosen.append(int(nearest.argmax()))
                nearest = np.minimum(nearest, ball_distances(rows, rows[chosen[-1:]])[:, 0])
            self.pivots = rows[chosen]

    def prepared(self, block: Block) -> Side:
        side = Side((block[0], np.ones(len(block[0])), *block[2:]))
        side.far = ball_distances(side.vectors, self.pivots)
        return side

    def library(self, block: Block) -> tuple[np.ndarray, Any]:
        at = starts_of(block[0])
        far = ball_distances(block[2], self.pivots)
        return block[0][at], (block[2], at, np.diff(np.append(at, len(far))), np.minimum.reduceat(far, at, axis=0), np.maximum.reduceat(far, at, axis=0))

    def bound(self, left: Side, entries: Any, own: np.ndarray) -> np.ndarray:
        _, at, _, low, high = entries
        gap = np.zeros((len(left.vectors), len(at)))
        for p in range(len(self.pivots)):
            f = left.far[:, p, None]
            np.maximum(gap, np.maximum(f - high[None, :, p], low[None, :, p] - f), out=gap)
        gap -= SLACK  # distances are clamped near 0, which may break the triangle by a hair
        rows = gap[left.back]
        least = np.minimum.reduceat(rows, left.start, axis=0)[own] if len(rows) else rows
        return -(left.mean(gap, own) + least) / 2

    def scores(self, left: Side, entries: Any, own: np.ndarray, take: np.ndarray) -> np.ndarray:
        v, at, sizes, _, _ = entries
        rows = np.concatenate([np.arange(at[j], at[j] + sizes[j]) for j in take])
        other, back = distinct(v[rows])
        begin = np.concatenate(([0], np.cumsum(sizes[take])[:-1]))
        out = np.empty((len(own), len(take)))
        there = distance_of(extremes(lambda i, j: ball_ratios(other, left.vectors[i:j]), len(left.vectors), back, sizes[take], np.min))
        mean = left.mean(there, own)
        if len(other) == len(take) and (left.size[own] == 1).all() and (sizes[take] == 1).all():
            return -mean
        if len(left.vectors) * len(other) <= 2 * CELLS:  # each query vector is in many keys' rows: its ratios are made once
            ratios = ball_ratios(left.vectors, other)
            step = max(1, CELLS // max(1, len(rows)))
            for i in range(0, len(own), step):
                nearest = np.array([ratios[left.back[left.start[o] : left.start[o] + left.size[o]]].min(axis=0) for o in own[i : i + step]])
                out[i : i + step] = np.add.reduceat(distance_of(nearest)[:, back], begin, axis=1) / sizes[take]
            return -(mean + out) / 2
        step = max(1, CELLS // max(1, len(other) * int(left.size.max(initial=1))))
        for i in range(0, len(own), step):
            part = own[i : i + step]
            mine = np.concatenate([left.back[s : s + n] for s, n in zip(left.start[part], left.size[part])])
            met, place = np.unique(mine, return_inverse=True)
            first = np.concatenate(([0], np.cumsum(left.size[part])[:-1]))
            nearest = distance_of(np.minimum.reduceat(ball_ratios(left.vectors[met], other)[place], first, axis=0))
            out[i : i + step] = np.add.reduceat(nearest[:, back], begin, axis=1) / sizes[take]
        return -(mean + out) / 2


def slabs(query: DataFrame, size: int) -> Iterator[Block]:
    """The query set's rows (key, w, v), in slabs of about ``size`` rows with all rows of a key together; where at most ``size``
    vectors are shared by more rows, in slabs of about ``SHARED`` rows, so that each vector meets the library once."""
    rows = cut(query)
    n = max(1, -(-rows.count() // size))
    if n > 1:
        known = cut(rows.select(F.xxhash64("v").alias("h"), "v").distinct())
        if known.count() <= min(size, rows.count() // 2):
            table = known.toArrow().combine_chunks()  # at most ``size`` rows
            h = table["h"].to_numpy()
            order = np.argsort(h)
            h, vectors = h[order], table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(h), -1)[order]
            if len(np.unique(h)) == len(h):  # no two vectors share a hash
                yield from shared_slabs(rows, h, vectors)
                return
    dealt = rows if n == 1 else cut(rows.withColumn("slab", F.pmod(F.xxhash64("key"), F.lit(n))).repartition("slab"))
    for i in range(n):
        part = (dealt if n == 1 else dealt.where(F.col("slab") == i)).select(F.col("key").cast("long").alias("key"), "w", "v").toArrow().combine_chunks()  # about ``size`` rows
        if part.num_rows:
            keys = part["key"].to_numpy()
            order = np.argsort(keys, kind="stable")
            flat = part["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(keys), -1)
            yield keys[order], part["w"].to_numpy()[order], flat[order]


def shared_slabs(rows: DataFrame, h: np.ndarray, vectors: np.ndarray) -> Iterator[Block]:
    """Slabs of about ``SHARED`` rows over the distinct ``vectors`` with the hashes ``h``, in order of these."""
    n = max(1, -(-rows.count() // SHARED))
    lean = rows.select(F.col("key").cast("long").alias("key"), F.col("w").cast("double").alias("w"), F.xxhash64("v").alias("h"), F.pmod(F.xxhash64("key"), F.lit(n)).alias("slab"))
    dealt = lean if n == 1 else cut(lean.repartition("slab"))
    for i in range(n):
        part = dealt.where(F.col("slab") == i).select("key", "w", "h").toArrow().combine_chunks()  # about SHARED rows of 24 bytes
        if part.num_rows:
            keys = part["key"].to_numpy()
            order = np.argsort(keys, kind="stable")
            used, back = np.unique(np.searchsorted(h, part["h"].to_numpy()[order]), return_inverse=True)
            yield keys[order], part["w"].to_numpy()[order], vectors[used], back


def scan(query: DataFrame, library: DataFrame, kind: type, k: int | None = None, least: float | None = None, size: int = ROWS, slab: int = SLAB, report: dict | None = None) -> DataFrame:
    """(l, r, score) of query keys and library keys; both tables are (key, w, v) with integer keys, weights and vectors of one
    length, without nulls. ``report`` gets the numbers of pairs and of those that bounds left out."""
    spark, path, n, parts = query.sparkSession, new_path(query.sparkSession), 0, []
    scorer = kind(library)
    held = cut(packed(library, "key", F.col("w"), F.col("v"), size))
    schema = "l long, r long, score double, pruned long"
    for block in slabs(query, slab):
        left = scorer.prepared(block)

        def run(batches: Iterator[pa.RecordBatch], left: Side = left, start: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
            def batch(own, keys, scores, pruned=None):
                return pa.RecordBatch.from_arrays([pa.array(left.keys[own]) if pruned is None else pa.array([None], pa.int64()), pa.array(keys), pa.array(scores), pa.array([pruned], pa.int64()) if pruned is not None else pa.nulls(len(keys), pa.int64())], ["l", "r", "score", "pruned"])

            best, pairs, pruned, judged = Best(len(left.keys), k, start) if k else None, 0, 0, 0
            everyone = np.arange(len(left.keys))
            for b in batches:
                for i in range(b.num_rows):
                    keys, entries = scorer.library(unpacked(b.column("rows"), i))
                    step = max(1, CELLS // max(1, len(left.vectors), len(left.keys)))
                    judged += 1
                    bounded = best is not None and (judged <= TRIED or pruned * 8 > pairs)
                    if bounded:
                        may = np.zeros((len(everyone), len(keys)), bool)
                        for j in range(0, len(everyone), max(1, CELLS // max(1, len(keys)))):
                            part = everyone[j : j + max(1, CELLS // max(1, len(keys)))]
                            may[part] = scorer.bound(left, entries, part) >= best.floor()[part, None] - SLACK
                        pairs, pruned = pairs + may.size, pruned + int((~may).sum())
                    elif best is not None:  # bounds that leave out next to nothing cost as much as the scores
                        pairs += len(everyone) * len(keys)
                    for at in range(0, len(keys), step):
                        take = np.arange(at, min(at + step, len(keys)))
                        own = everyone
                        if bounded:
                            own, take = np.flatnonzero(may[:, take].any(axis=1)), take[may[:, take].any(axis=0)]
                        if not len(own) or not len(take):
                            continue
                        s = scorer.scores(left, entries, own, take)
                        if best is not None:
                            best.add(own, keys[take], s)
                        else:
                            some = max(1, SHARED // len(take))
                            for j in range(0, len(own), some):
                                part, mine = s[j : j + some], own[j : j + some]
                                x, y = np.nonzero(part > least) if least is not None else np.indices(part.shape).reshape(2, -1)
                                if len(x):
                                    yield batch(mine[x], keys[take][y], part[x, y])
            if best is not None:
                own, keys, scores = best.rows()
                if len(own):
                    yield batch(own, keys, scores)
                yield batch(None, np.array([pairs]), np.array([0.0]), pruned)

        task = run
        if k:
            first = held.select("rows").limit(1).mapInArrow(run, schema).where("pruned is null").toArrow().combine_chunks()  # one block's best
            tops = Best(len(left.keys), k)
            if first.num_rows:
                own, scores = np.searchsorted(left.keys, first["l"].to_numpy()), first["score"].to_numpy()
                order = np.lexsort((-scores, own))
                nth = np.arange(len(own)) - np.searchsorted(own[order], own[order])
                within = nth < k
                tops.top[own[order][within], nth[within]] = scores[order][within]
            start = tops.floor()

            def task(batches: Iterator[pa.RecordBatch], run=run, start=start) -> Iterator[pa.RecordBatch]:
                return run(batches, start=start)

        if not k:  # every pair may be a row: they are not written here
            parts.append(held.select("rows").mapInArrow(task, schema))
            continue
        held.select("rows").mapInArrow(task, schema).write.parquet(f"{path}/slab={n}")
        n += 1
    if n:
        parts = [spark.read.schema(schema).parquet(*[f"{path}/slab={i}" for i in range(n)])]
    out = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    if report is not None:
        seen = out.where("pruned is not null").agg(F.coalesce(F.sum("r"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("pruned"), F.lit(0)).alias("pruned")).first()
        report.update(pairs=seen.pairs, pruned=seen.pruned)
    return out.where("pruned is null").select("l", "r", "score")
