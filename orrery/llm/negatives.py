"""Hard negatives: rows of another label whose inner product with an anchor lies in a window below a positive's.

Rows are laid along a Hilbert curve (Skilling's transform) over the ``DIMS`` dimensions of largest variance and packed into blocks
of ``ROWS`` rows, written as Parquet with each dimension's least and largest value and the labels: a zone map. Anchors are
taken in slabs of at most ``SLAB``. For each slab interval arithmetic over the zone maps bounds the products of each
anchor with a block: a block is read if it can hold one of the first positives (its upper bound reaches the fifth best of the
anchor's own block) or a product within one of the anchor's windows; the same bounds, with what a task has found so far, choose the
anchors for each block that is read. The chosen blocks are pushed to the scan as ranges of block numbers; blocks stay
where they are, a slab goes to them, and each task keeps ``k`` rows for an anchor or window. In vectors that spread evenly over many
dimensions zone maps are wide and spare little; the result is exact either way.

Rows with a null label or vector, or a null or non-finite component, take no part, nor do vectors whose length isn't the most
common one. Components beyond 2**28 (after scaling) count as 2**28. Rows without an id are candidates, last among equal scores,
and never anchors. Repeated rows are rows of their own: one is an "other row" to the next. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import new_path, written

DIMS, BITS, ROWS, SLAB, RANGES, CHUNK = 15, 4, 1024, 8192, 256, 128
LEAST = np.iinfo(np.int64).min
LAST = np.iinfo(np.int64).max
BLOCK = "block long, lo array<int>, hi array<int>, labels array<int>, ids array<long>, row_labels array<int>, q binary"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def quantised(rows: DataFrame) -> DataFrame:
    """(vec_id, label, q array<int>) of the rows of (vec_id, label, vector) that take part."""
    x = F.col("vector")
    whole = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    held = rows.where(F.col("label").isNotNull() & x.isNotNull() & whole)
    most = held.groupBy(F.size(x).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    far = float(1 << 28)
    q = F.transform(x, lambda c: F.greatest(F.lit(-far), F.least(F.lit(far), F.floor(256 * c.cast("double")).cast("double"))).cast("int"))
    return held.where(F.size(x) == (most[0].n if most else 0)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), q.alias("q"))


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of rows of coordinates from 0 to 2**bits - 1; dimensions times bits below 63."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= turn
    place = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = place << 1 | (x[i] >> b) & 1
    return place


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0), np.int32)


def blocks_of(rows: DataFrame, size: int = ROWS) -> DataFrame:
    """The written blocks of (vec_id, label, q), in the curve's order; within a block rows go by id."""
    held = written(rows, "vectors")
    stats = held.select(F.posexplode("q").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("i").collect()  # a row a dimension
    d, mean, spread = len(stats), np.array([r.m for r in stats], float), np.array([r.s for r in stats], float)
    dims = np.sort(np.argsort(-spread, kind="stable")[:DIMS])
    low, step = mean[dims] - 2 * spread[dims], np.maximum(spread[dims] * 4 / (1 << BITS), 1e-9)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.clip((matrix(b.column(2))[:, dims] - low) // step, 0, (1 << BITS) - 1)
            curve = hilbert(at) if len(dims) else np.zeros(b.num_rows, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(curve)], ["vec_id", "label", "q", "curve"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, labels, qs = TaskContext.get().partitionId() << 32, np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros((0, d), np.int32)

        def block(n: int) -> pa.RecordBatch:
            by = np.argsort(ids[:n], kind="stable")
            i, lab, q = ids[:n][by], labels[:n][by], qs[:n][by]
            return pa.RecordBatch.from_pylist([{"block": number, "lo": q.min(axis=0), "hi": q.max(axis=0), "labels": np.unique(lab), "ids": i, "row_labels": lab, "q": q.astype("<i4").tobytes()}],
                                              pa.schema([("block", pa.int64()), ("lo", pa.list_(pa.int32())), ("hi", pa.list_(pa.int32())), ("labels", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64())), ("row_labels", pa.list_(pa.int32())), ("q", pa.binary())]))

        for b in batches:
            ids = np.concatenate((ids, b.column(0).fill_null(LAST).to_numpy()))
            labels, qs = np.concatenate((labels, b.column(1).to_numpy())), np.concatenate((qs, matrix(b.column(2))))
            while len(ids) >= size:
                yield block(size)
                number, ids, labels, qs = number + 1, ids[size:], labels[size:], qs[size:]
        if len(ids):
            yield block(len(ids))

    curved = held.mapInArrow(placed, "vec_id long, label int, q array<int>, curve long")
    # the id parts equal places, so that one common vector fills many partitions
    laid = curved.repartitionByRange("curve", "vec_id").sortWithinPartitions("curve", "vec_id").select("vec_id", "label", "q")
    spark, path = rows.sparkSession, new_path(rows.sparkSession, "blocks")
    laid.mapInArrow(packed, BLOCK).write.option("parquet.block.size", 4 << 20).parquet(path)
    return spark.read.schema(BLOCK).parquet(path)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: by floats where every sum stays below 2**53."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def first_k(scores: np.ndarray, k: int) -> np.ndarray:
    """The places of each row's ``k`` largest, ties by place; LEAST marks what doesn't count."""
    k, n = min(k, scores.shape[1]), scores.shape[1]
    if n <= 4 * k:
        return np.argsort(-np.maximum(scores, LEAST + 1), axis=1, kind="stable")[:, :k]
    least = np.partition(scores, n - k, axis=1)[:, n - k]
    out = np.empty((len(scores), k), np.int64)
    for i, t in enumerate(least):
        at = np.flatnonzero(scores[i] >= t)
        out[i] = at[np.argsort(-np.maximum(scores[i, at], LEAST + 1), kind="stable")[:k]]
    return out


def merged(best: tuple[np.ndarray, ...], rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, *more: np.ndarray) -> None:
    """Puts new scores into ``best`` (scores, ids, and what goes with them) in ``rows``."""
    k = best[0].shape[1]
    new = [np.concatenate((b[rows], x), axis=1) for b, x in zip(best, (scores, ids, *more))]
    order = np.lexsort((new[1], -np.maximum(new[0], LEAST + 1)), axis=1)[:, :k]
    for b, x in zip(best, new):
        b[rows] = np.take_along_axis(x, order, axis=1)


def bounds(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest product of each row of ``a`` with vectors between ``lo`` and ``hi``."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return (product(up, lo[None]) + product(down, hi[None]))[:, 0], (product(up, hi[None]) + product(down, lo[None]))[:, 0]


def unpacked(b: pa.RecordBatch, i: int, d: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    return b.column("block")[i].as_py(), b.column("ids")[i].values.to_numpy(), b.column("row_labels")[i].values.to_numpy(), np.frombuffer(b.column("q")[i].as_py(), "<i4").reshape(-1, d)


class Slab:
    """Anchors by number: block and place in it, id, label, vector, and the score that the k-th positive has at least."""

    def __init__(self, rows: list, d: int) -> None:
        self.block, self.place = np.array([r.block for r in rows]), np.array([r.place for r in rows])
        self.ids, self.labels, self.floor = [r.vec_id for r in rows], np.array([r.label for r in rows]), np.array([r.floor for r in rows])
        self.q = np.stack([np.frombuffer(r.q, "<i4") for r in rows]).reshape(len(rows), d)


def anchors_of(blocks: DataFrame, every: int, k: int, d: int) -> DataFrame:
    """(slab, block, place, vec_id, label, q, floor) of the rows whose id is divisible by ``every``, at most SLAB a slab."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            for i in range(b.num_rows):
                number, ids, labels, q = unpacked(b, i, d)
                places = np.flatnonzero((ids % every == 0) & (ids != LAST))
                if not len(places):
                    continue
                s = product(q[places], q)
                s[(labels[None] != labels[places, None]) | (np.arange(len(ids))[None] == places[:, None])] = LEAST
                floor = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) >= k else np.full(len(places), LEAST)
                slab = part + (seen + np.arange(len(places))) // SLAB
                seen += len(places)
                yield pa.RecordBatch.from_arrays([pa.array(slab), pa.array(np.full(len(places), number)), pa.array(places), pa.array(ids[places]), pa.array(labels[places]), pa.array([q[p].tobytes() for p in places], pa.binary()), pa.array(floor)], ["slab", "block", "place", "vec_id", "label", "q", "floor"])

    few = max(1, -(-blocks.count() // 4096))  # some thousand blocks to a task, so that slabs are full
    return written(blocks.select("block", "ids", "row_labels", "q").coalesce(few).mapInArrow(run, "slab long, block long, place long, vec_id long, label int, q binary, floor long"), "anchors")


def chosen(blocks: DataFrame, needs) -> DataFrame:
    """The blocks within the ranges that ``needs`` (lo, hi, labels of a block -> which anchors) leaves: at most RANGES ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [needs(b.column("lo")[i].values.to_numpy(), b.column("hi")[i].values.to_numpy(), b.column("labels")[i].values.to_numpy()).any() for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("block"), pa.array(keep, pa.bool_())], ["block", "need"])

    parts = blocks.agg(F.max("block")).first()[0] or 0
    bucket = F.floor(F.shiftright("block", 32) * RANGES / ((parts >> 32) + 1))
    zones = blocks.select("block", "lo", "hi", "labels").mapInArrow(run, "block long, need boolean")
    ranges = zones.groupBy(bucket.alias("r")).agg(F.min(F.when(F.col("need"), F.col("block"))).alias("a"), F.max(F.when(F.col("need"), F.col("block"))).alias("b"), F.every("need").alias("all")).collect()
    if all(r["all"] for r in ranges):
        return blocks
    keep = F.lit(False)
    for r in ranges:
        if r.a is not None:
            keep = keep | F.col("block").between(r.a, r.b)
    return blocks.where(keep)


def positives(blocks: DataFrame, slab: Slab, k: int) -> DataFrame:
    """(a, score, id): each anchor's ``k`` best other rows of its label."""
    d = slab.q.shape[1]

    def needs(lo, hi, labels, least=slab.floor):
        return np.isin(slab.labels, labels) & (bounds(slab.q, lo, hi)[1] >= least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(slab.q)
        best = (np.full((n, k), LEAST), np.full((n, k), LAST))
        for b in batches:
            for i in range(b.num_rows):
                number, ids, labels, q = unpacked(b, i, d)
                need = np.flatnonzero(needs(q.min(axis=0), q.max(axis=0), np.unique(labels), np.maximum(slab.floor, best[0][:, -1])))
                for c in range(0, len(need), CHUNK):
                    own = need[c : c + CHUNK]
                    s = product(slab.q[own], q)
                    s[labels[None] != slab.labels[own, None]] = LEAST
                    here = np.flatnonzero(slab.block[own] == number)
                    s[here, slab.place[own[here]]] = LEAST
                    top = first_k(s, k)
                    merged(best, own, np.take_along_axis(s, top, axis=1), ids[top])
        a, c = np.nonzero(best[0] > LEAST)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(best[0][a, c]), pa.array(best[1][a, c])], ["a", "score", "id"])

    found = chosen(blocks, needs).select("block", "ids", "row_labels", "q").mapInArrow(run, "a long, score long, id long")
    return found.withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), F.asc("id")))).where(F.col("n") <= k)


def negatives(blocks: DataFrame, slab: Slab, anchor: np.ndarray, positive: np.ndarray, score: np.ndarray, k: int) -> DataFrame:
    """For windows (anchor's number, positive's id and score) the ``k`` best rows of another label from 80 to 100 per cent of the score."""
    d = slab.q.shape[1]

    def needs(lo, hi, labels, least=None):
        low, high = bounds(slab.q, lo, hi)
        other = (labels[None] != slab.labels[:, None]).any(axis=1)[anchor]
        fits = other & (100 * high[anchor] >= 80 * score) & (low[anchor] <= score)
        return fits if least is None else fits & (high[anchor] >= least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = (np.full((len(anchor), k), LEAST), np.full((len(anchor), k), LAST))
        for b in batches:
            for i in range(b.num_rows):
                _, ids, labels, q = unpacked(b, i, d)
                need = np.flatnonzero(needs(q.min(axis=0), q.max(axis=0), np.unique(labels), best[0][:, -1]))
                for c in range(0, len(need), CHUNK):
                    own = need[c : c + CHUNK]
                    met, back = np.unique(anchor[own], return_inverse=True)
                    s = product(slab.q[met], q)
                    s[labels[None] == slab.labels[met, None]] = LEAST
                    s = s[back]
                    p = score[own, None]
                    fits = (s > LEAST) & (s <= p)
                    fits[fits] = 80 * np.broadcast_to(p, s.shape)[fits] <= 100 * s[fits]
                    s[~fits] = LEAST
                    top = first_k(s, k)
                    merged(best, own, np.take_along_axis(s, top, axis=1), ids[top])
        w, c = np.nonzero(best[0] > LEAST)
        if len(w):
            out = best[1][w, c]
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(best[0][w, c]), pa.array(out)], ["w", "score", "id"])

    found = chosen(blocks, needs).select("block", "ids", "row_labels", "q").mapInArrow(run, "w long, score long, id long")
    return found.withColumn("n", F.row_number().over(Window.partitionBy("w").orderBy(F.desc("score"), F.asc("id")))).where(F.col("n") <= k)


def mine(rows: DataFrame, anchor_every: int, n_positives: int = 5, n_negatives: int = 5, size: int = ROWS) -> DataFrame:
    """``RESULT`` for rows of (vec_id, label, vector): each anchor's and positive's first negatives, hardest first."""
    spark = rows.sparkSession
    blocks = blocks_of(quantised(rows), size)
    one = blocks.select(F.size("lo").alias("d")).first()
    d = one.d if one else 0
    anchors = anchors_of(blocks, anchor_every, n_positives, d)
    known = lambda c: F.when(F.col(c) != int(LAST), F.col(c))
    path, n = new_path(spark, "negatives"), 0
    for s in anchors.select("slab").distinct().orderBy("slab").toLocalIterator():
        slab = Slab(anchors.where(F.col("slab") == s.slab).orderBy("block", "place").collect(), d)  # at most SLAB rows
        near = sorted(positives(blocks, slab, n_positives).collect(), key=lambda r: (r.a, r.n))  # at most k a row of the slab
        if not near:
            continue
        anchor, ids, score = (np.array([r[c] for r in near], np.int64) for c in ("a", "id", "score"))
        windows = spark.createDataFrame([(w, slab.ids[r.a], r.id, r.score) for w, r in enumerate(near)], "w long, anchor_id long, positive_id long, positive_score long")
        found = negatives(blocks, slab, anchor, ids, score, n_negatives).join(F.broadcast(windows), "w")
        found.select("anchor_id", known("positive_id").alias("positive_id"), F.col("n").alias("rank"), known("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.parquet(f"{path}/slab={n}")
        n += 1
    return spark.read.schema(RESULT).parquet(*[f"{path}/slab={i}" for i in range(n)]) if n else spark.createDataFrame([], RESULT)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh row bears the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", label.alias("label"), F.col("embedding").alias("vector"))
    return mine(rows, 100)


OP12_SQL = """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  p AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS s FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
  pos AS (SELECT anchor_id, vec_id AS positive_id, s AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, vec_id) AS n FROM p WHERE same) WHERE n <= 5),
  neg AS (SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, s AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s DESC, vec_id) AS n FROM pos JOIN p USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * s AND 100 * s <= 100 * positive_score)
  SELECT anchor_id, positive_id, CAST(n AS INT) AS rank, negative_id, positive_score, negative_score FROM neg WHERE n <= 5"""
