"""Fusing rankings. Rankings are (patient_id, method, key, rank) with the row's measures; a method's place in ``methods`` is
its priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MEASURES = ("n_match", "ic_share", "weighted", "similarity")
#: By method, the measures in order of weight, falling; total associations, rising, come next, then the key.
TUPLES = {"ic": ("ic_share", "n_match"), "freq": ("weighted", "n_match"), "score": ("score", "n_match"), "overlap": ("n_match", "ic_share"), "embedding": ("similarity", "n_match"), "resort": ("n_match", "similarity")}


def fusion_key(name, ids):
    return F.coalesce(name, F.array_join(ids, ";"))


def listed(rankings: dict[str, DataFrame], key: str = "disease_id") -> DataFrame:
    """The methods' lists as one table; a measure that a method's row does not have counts as 0."""
    rows = None
    for m, df in rankings.items():
        measures = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in df.columns else F.lit(0.0).alias(c) for c in MEASURES]
        total = F.col("total_associations").cast("double") if "total_associations" in df.columns else F.lit(None).cast("double")
        part = df.select("patient_id", F.lit(m).alias("method"), F.col(key).alias("key"), F.col("rank").cast("int").alias("rank"), *measures, total.alias("total"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def complete_rankings(rankings: DataFrame, methods: list[str]) -> DataFrame:
    """Each method's list with the other methods' keys, sorted by the method's own measures.

    A key that a method does not have brings the row of the first other method that does. One shuffle by patient and key
    gathers a key's rows (one a method); the lists are windows after that."""
    prior = F.create_map(*[F.lit(x) for i, m in enumerate(methods) for x in (m, i)])
    row = F.struct(prior[F.col("method")].alias("priority"), "method", *MEASURES, "total")
    have = rankings.groupBy("patient_id", "key").agg(F.sort_array(F.collect_list(row)).alias("rows"))  # at most one row for each method

    def taken(m: str) -> Column:
        own = F.filter("rows", lambda r: r["method"] == m)
        return F.struct(F.lit(m).alias("method"), F.coalesce(F.try_element_at(own, F.lit(1)), F.col("rows")[0]).alias("r"))

    every = have.select("patient_id", "key", F.explode(F.array(*[taken(m) for m in methods])).alias("x")).select("patient_id", "key", "x.method", *[F.col(f"x.r.{c}").alias(c) for c in (*MEASURES, "total")])
    first, second = (F.lit(None).cast("double") for _ in range(2))
    for m in methods:
        a, b = TUPLES[m]
        first, second = F.when(F.col("method") == m, F.col(a)).otherwise(first), F.when(F.col("method") == m, F.col(b)).otherwise(second)
    w = Window.partitionBy("patient_id", "method").orderBy(F.desc("_a"), F.desc("_b"), F.asc_nulls_last("total"), F.asc("key"))
    return every.withColumn("_a", first).withColumn("_b", second).select("patient_id", "method", "key", F.row_number().over(w).alias("rank"))


def rank_ratio(completed: DataFrame) -> DataFrame:
    """rank / longest list of the patient; where a list repeats a key, its last rank counts."""
    last = completed.groupBy("patient_id", "method", "key").agg(F.max("rank").alias("rank"))
    sizes = completed.groupBy("patient_id", "method").agg(F.count("*").alias("_c")).groupBy("patient_id").agg(F.max("_c").alias("_m"))
    return last.join(sizes.hint("merge"), "patient_id").select("patient_id", "method", "key", "rank", (F.col("rank") / F.col("_m")).alias("ratio"))


def order_statistic_z(ratios: DataFrame, methods: int) -> DataFrame:
    """The product of a key's ratios; a missing method counts as 1."""
    return ratios.groupBy("patient_id", "key").agg(F.product("ratio").alias("z"))


def fused_rank(ratios: DataFrame, methods: list[str], k: int) -> DataFrame:
    """By rising z, with each method's rank."""
    z = ratios.groupBy("patient_id", "key").agg(F.round(F.product("ratio"), 9).alias("z"), *[F.max(F.when(F.col("method") == m, F.col("rank"))).alias(f"rank_{m}") for m in methods])
    return z.withColumn("rank", F.row_number().over(Window.partitionBy("patient_id").orderBy("z", "key"))).where(F.col("rank") <= k)


def fuse(lists: dict[str, DataFrame], k: int) -> DataFrame:
    """From rankings with (patient_id, disease_id, rank, measures) by method to one list."""
    return fused_rank(rank_ratio(complete_rankings(listed(lists), list(lists))), list(lists), k)
