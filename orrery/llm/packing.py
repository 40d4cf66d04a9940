"""Best-fit packing into sequences of several permitted lengths.

A text is a run of tokens (words and single signs, counted over the whole text) plus one separator. Runs longer
than the largest permitted length are cut into pieces of that length and a rest; nothing is dropped. Pieces are
dealt into shards of about ``SHARD_ROWS`` pieces by a hash, so that a task holds one shard, and the work grows
with the number of shards.

Within a shard, pieces go from long to short into the open bin that they fill best. When none fits, a bin is
opened, and its size is chosen jointly with what is still to be packed: of the permitted lengths that hold the
piece, the one with the least cost for each token it can be expected to hold (the piece, and what remains to be
packed that is short enough for the room left). At the end each bin takes the smallest permitted length that
holds its contents. A length ``c`` costs ``c * (1 + c / ATTENTION)``: linear work plus attention. The permitted
lengths are optimised jointly over the shard: it is packed once with every length open to new bins, and once with
only those from each length on; the cheapest outcome stays.

``sequences`` gives the packed sequences themselves, from any column of token ids. Null and empty texts are one
separator each. Repeated rows are pieces of their own, extra columns are not read, and an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import documents, written

CAPACITIES = (512, 1024, 2048, 4096, 8192)
ATTENTION = 32768
SHARD_ROWS = 20_000
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN)).cast("long") + 1


def cost(capacity: int) -> float:
    return capacity * (1 + capacity / ATTENTION)


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES) -> tuple[list[int], list[int], list[int]]:
    """For lengths in falling order: each one's bin and offset, and by bin its final capacity, at the least cost found."""
    every = [packed_with(lengths, capacities[k:], capacities) for k in range(len(capacities))]
    return min(every, key=lambda found: sum(cost(c) for c in found[2]))


def packed_with(lengths: list[int], opening: tuple[int, ...], capacities: tuple[int, ...]) -> tuple[list[int], list[int], list[int]]:
    """One packing, with new bins of the sizes ``opening`` only."""
    most = capacities[-1]
    remaining = np.bincount(np.asarray(lengths, dtype=np.int64), minlength=most + 1).astype(np.int64)
    weights = np.arange(most + 1)
    room: list[int] = []  # by bin: what is left, and the size it was opened with
    opened: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(most + 1)]
    present = 0  # bit r is set where a bin with room r is open
    bins, offsets = [], []
    for n in lengths:
        remaining[n] -= 1
        fits = present >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                present &= ~(1 << r)
        else:
            short = np.cumsum(remaining * weights)
            c = min((c for c in opening if c >= n), key=lambda c: (cost(c) / (n + min(c - n, int(short[c - n]))), c))  # noqa: B023
            b = len(room)
            room.append(c)
            opened.append(c)
        bins.append(b)
        offsets.append(opened[b] - room[b])
        room[b] -= n
        if room[b]:
            by_room[room[b]].append(b)
            present |= 1 << room[b]
    final = [next(c for c in capacities if c >= o - r) for o, r in zip(opened, room)]
    return bins, offsets, final


def best_fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None, capacities: tuple[int, ...] = CAPACITIES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece: its id, number, first token and length, and its bin's id, capacity and offset in it."""
    capacities = tuple(sorted(capacities))
    most = capacities[-1]
    counted = docs.select(F.col(id_col).alias("doc_id"), (token_count(F.col(text_col)) if tokens is None else tokens).alias("_n"))
    pieces = counted.select("doc_id", "_n", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_n") / most).cast("int") - 1)).alias("piece"))
    start = F.col("piece").cast("long") * most
    pieces = written(pieces.select("doc_id", "piece", start.alias("start_token"), F.least(F.lit(most), F.col("_n") - start).cast("int").alias("n_tokens")), "pieces")
    shards = -(-pieces.count() // shard_rows) or 1
    id_type = pieces.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("piece", T.IntegerType()), T.StructField("start_token", T.LongType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("bin_id", T.LongType()), T.StructField("bin_capacity", T.IntegerType()), T.StructField("bin_offset", T.IntegerType())])

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets, final = pack(rows["n_tokens"].tolist(), capacities)
        return rows.drop(columns="_shard").assign(bin_id=[(int(key[0]) << 32) + b for b in bins], bin_capacity=[final[b] for b in bins], bin_offset=offsets)

    dealt = pieces.withColumn("_shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
    return dealt.groupBy("_shard").applyInPandas(run, schema)


def sequences(placed: DataFrame, docs: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", separator: int = 0) -> DataFrame:
    """(bin_id, bin_capacity, doc_ids, ids): each bin's tokens in order. ``docs`` has one row for each id, its ``ids`` without the separator
    that ends a text, and ``placed`` was made with ``tokens`` their number plus one."""
    whole = docs.select(F.col(id_col).alias("doc_id"), F.concat(F.col(ids_col), F.array(F.lit(separator))).alias("_ids"))
    at = placed.join(whole.hint("merge"), "doc_id").select("bin_id", "bin_capacity", F.struct("bin_offset", "doc_id", F.slice("_ids", (F.col("start_token") + 1).cast("int"), F.col("n_tokens")).alias("ids")).alias("p"))
    held = at.groupBy("bin_id", "bin_capacity").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return held.select("bin_id", "bin_capacity", F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"), F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and where they are packed."""
    return best_fit(documents(spark, sf_dir))
