"""Top-k rankings per patient. Orders are falling but for the number of associations; the id is the last key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks, shared_vectors
from .lineage import cut

# By method, the measures in order of weight; total associations, rising, always come third.
ORDERS = {
    "overlap": ("n_match", "ic_share"),
    "ic": ("ic_share", "n_match"),
    "freq": ("weighted", "n_match"),
    "score": ("score", "n_match"),
}


def order_of(method: str, key: str = "disease_id") -> list[Column]:
    a, b = ORDERS[method]
    return [F.desc(a), F.desc(b), F.asc("total_associations"), F.asc(key)]


def ranked(measures: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` of each patient with their ``rank``; Spark cuts each task's rows to k before the shuffle."""
    return measures.withColumn("rank", F.row_number().over(Window.partitionBy("patient_id").orderBy(*order))).where(F.col("rank") <= k)


def measured(summary: DataFrame, weight: DataFrame | None = None) -> DataFrame:
    """``summary`` with rounded measures: ``weighted`` is the share summed over the query's size, or the given ``weight``
    (patient_id, disease_id, weight, or a column of ``summary``), 0 where there is none."""
    rows = summary.withColumn("ic_share", F.round("ic_share", 9))
    if "weight" in summary.columns:
        return rows.withColumn("weighted", F.round(F.coalesce("weight", F.lit(0.0)), 9)).drop("weight")
    if weight is None:
        return rows.withColumn("weighted", F.round(F.col("freq_sum") / F.col("n_query"), 9))
    return rows.join(weight, ["patient_id", "disease_id"], "left").withColumn("weighted", F.round(F.coalesce("weight", F.lit(0.0)), 9)).drop("weight")


def rank_overlap(summary: DataFrame, method: str, k: int, weight: DataFrame | None = None) -> DataFrame:
    return ranked(measured(summary, weight), order_of(method), k)


def rank_score(summary: DataFrame, similarity: DataFrame | None, weight: DataFrame | None, k: int) -> DataFrame:
    """By content share, similarity (a column of ``summary`` if None is given) and (if given) another weight, added up."""
    rows = measured(summary, weight)
    if similarity is not None:
        rows = rows.join(similarity, ["patient_id", "disease_id"], "left")
    rows = rows.withColumn("similarity", F.round(F.coalesce("similarity", F.lit(0.0)), 9))
    score = F.coalesce("ic_share", F.lit(0.0)) + F.col("similarity") + (F.col("weighted") if weight is not None or "weight" in summary.columns else F.lit(0.0))
    return ranked(rows.withColumn("score", F.round(score, 6)), order_of("score"), k)


def rank_embedding(similarity: DataFrame, summary: DataFrame, k: int, resort: bool, extra: int = 50) -> DataFrame:
    """The k + 50 most similar, with the measures of their matches, in order of similarity or (``resort``) of matches."""
    rows = similarity.withColumn("similarity", F.round("similarity", 6))
    top = ranked(rows, [F.desc("similarity"), F.asc("disease_id")], k + extra).drop("rank")
    joined = top.join(measured(summary).select("patient_id", "disease_id", "n_match", "ic_share", "weighted", "total_associations"), ["patient_id", "disease_id"], "left").na.fill(0, ["n_match", "ic_share", "weighted"])
    order = [F.desc("n_match"), F.desc("similarity")] if resort else [F.desc("similarity"), F.desc("n_match")]
    return ranked(joined, [*order, F.asc_nulls_last("total_associations"), F.asc("disease_id")], k)


def rank_both(overlap: DataFrame, embedding: DataFrame, k: int, by_content: bool = False) -> DataFrame:
    """Both lists together; of equal keys the overlap's row stays; by matches, then content, or the other way round."""
    side = lambda df, n: df.select("patient_id", "disease_id", "n_match", "ic_share", F.lit(n).alias("src"))
    first = side(overlap, 0).unionByName(side(embedding, 1)).groupBy("patient_id", "disease_id").agg(F.min_by(F.struct("n_match", "ic_share", "src"), "src").alias("r")).select("patient_id", "disease_id", "r.*")
    a, b = ("ic_share", "n_match") if by_content else ("n_match", "ic_share")
    return ranked(first, [F.desc(a), F.desc(b), F.asc("disease_id")], k)


def rank_cases(query: DataFrame, cases: DataFrame, k: int, annotation: DataFrame, similarity: DataFrame | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Units are cases: shared terms, for each the largest share over the case's diseases (0 if unknown), and the similarity's
    maximum over them. Of cases with the same set of diseases the best stays.

    Similarity comes third in the order, so only cases that can be among the k by the first two are unfolded into their diseases: those
    with the highest measures of their set, of sets with fewer than k sets above them. ``similarity`` may be a function of the pairs
    that are then asked for. A case's shares come from a join by term whose condition looks into its list of diseases."""
    held = cases.select("case_id", "terms", F.array_sort("diseases").alias("diseases")).where(F.size("diseases") > 0)
    asked = query.select("patient_id", "term_id").distinct()
    terms = held.select("case_id", "diseases", F.explode("terms").alias("term_id")).join(asked.select("term_id").distinct().hint("merge"), "term_id", "left_semi")
    known = annotation.select("disease_id", F.col("term_id").alias("_term"), "freq")
    share = terms.join(known.hint("merge"), (F.col("term_id") == F.col("_term")) & F.array_contains("diseases", F.col("disease_id"))).groupBy("case_id", "term_id").agg(F.max("freq").alias("freq"))
    met = asked.join(terms.select("case_id", "term_id").hint("merge"), "term_id")
    n = met.join(share.hint("merge"), ["case_id", "term_id"], "left").groupBy("patient_id", "case_id").agg(F.count("*").alias("n_match"), F.round(F.sum(F.coalesce("freq", F.lit(0.0))), 9).alias("freq_sum"))
    sets = held.groupBy("diseases").agg(F.min("case_id").alias("_set"))
    of_set = held.select("case_id", "diseases").join(sets.hint("merge"), "diseases").select("case_id", "_set")
    in_set = n.join(of_set.hint("merge"), "case_id").groupBy("patient_id", "_set").agg(F.max(F.struct("n_match", "freq_sum")).alias("_b"), F.collect_list(F.struct("n_match", "freq_sum", "case_id")).alias("_c"))
    above = F.rank().over(Window.partitionBy("patient_id").orderBy(F.desc("_b.n_match"), F.desc("_b.freq_sum")))
    first = F.filter("_c", lambda c: (c["n_match"] == F.col("_b.n_match")) & (c["freq_sum"] == F.col("_b.freq_sum")))
    may = cut(in_set.withColumn("_r", above).where(F.col("_r") <= k).select("patient_id", "_set", F.explode(first).alias("c")).select("patient_id", "_set", "c.*"))
    unfolded = cut(may.join(held.select("case_id", F.explode("diseases").alias("disease_id")).hint("merge"), "case_id"))
    near_ = similarity(unfolded.select("patient_id", "disease_id").distinct()) if callable(similarity) else similarity
    rows = unfolded.join(near_.hint("merge"), ["patient_id", "disease_id"], "left").groupBy("patient_id", "case_id", "n_match", "freq_sum", "_set").agg(F.round(F.max(F.coalesce("similarity", F.lit(0.0))), 6).alias("similarity"))
    order = [F.desc("n_match"), F.desc("freq_sum"), F.desc("similarity"), F.asc("case_id")]
    best = rows.withColumn("_n", F.row_number().over(Window.partitionBy("patient_id", "_set").orderBy(*order))).where("_n = 1").drop("_n", "_set")
    return ranked(best, order, k)


def rank_by_frequency_weight(matches: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    rows = matches.groupBy("patient_id", "disease_id").agg(F.round(F.sum(F.coalesce("weight", F.lit(0.5))), 6).alias("weight_sum"), F.count("*").alias("n_match")).join(totals.hint("merge"), "disease_id")
    return ranked(rows, [F.desc("weight_sum"), F.desc("n_match"), F.asc("total_associations"), F.asc("disease_id")], k)


def rank_given(summary: DataFrame, given: DataFrame | Column, method: str, k: int) -> DataFrame:
    """Of the given pairs alone: a table of them, or a condition on the rows of ``summary``, which then meet no other table."""
    if isinstance(given, Column):
        return rank_overlap(summary.where(given), method, k)
    return rank_overlap(summary.join(given.select("patient_id", "disease_id").distinct().hint("merge"), ["patient_id", "disease_id"], "left_semi"), method, k)


def single_term_diseases(annotation: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    rows = terms.select(F.col("term_id").alias("patient_id"), "term_id").join(annotation, "term_id").select("patient_id", "disease_id", F.coalesce("freq", F.lit(-1.0)).alias("freq"))
    return ranked(rows, [F.desc("freq"), F.asc("disease_id")], k).withColumnRenamed("patient_id", "term_id")


def term_specificity_order(query: DataFrame, annotation: DataFrame) -> DataFrame:
    """A patient's terms from the rarest on."""
    n = annotation.groupBy("term_id").agg(F.countDistinct("disease_id").alias("n_diseases"))
    rows = query.join(n.hint("merge"), "term_id", "left").withColumn("n_diseases", F.coalesce("n_diseases", F.lit(0)))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("patient_id").orderBy("n_diseases", "term_id")))


def dedup_by_name(ranking: DataFrame, name: DataFrame) -> DataFrame:
    """After the cut, the first row of each name, ranked anew."""
    first = ranking.join(name, "disease_id").groupBy("patient_id", "name").agg(F.min_by("disease_id", "rank").alias("disease_id"), F.min("rank").alias("_r"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("patient_id").orderBy("_r"))).drop("_r")


def poincare_rank(query: DataFrame, annotation: DataFrame, embedding: DataFrame, k: int) -> DataFrame:
    """All diseases by the distance in the ball between the mean vectors of a patient's and a disease's terms."""
    from ..functions import vectors as vec

    def mean(df: DataFrame, key: str) -> DataFrame:
        found = shared_vectors.mean_vectors(df, key, embedding, None)
        if found is not None:
            return found.select(F.col(key).alias("key"), F.lit(1.0).alias("w"), "v")
        rows = df.select(key, "term_id").distinct().join(embedding, "term_id").withColumn("_one", F.lit(1.0))
        return vec.weighted_mean_vectors(rows, [key], "v", "_one").select(F.col(key).alias("key"), F.lit(1.0).alias("w"), "v")

    rows = blocks.scan(mean(query, "patient_id"), mean(annotation, "disease_id"), blocks.Ball, k, size=1024, slab=8192)
    return ranked(rows.select(F.col("l").alias("patient_id"), F.col("r").alias("disease_id"), F.round(-F.col("score"), 6).alias("distance")), [F.asc("distance"), F.asc("disease_id")], k)


def chamfer_similar_cases(query: DataFrame, library: DataFrame, key: str, embedding: DataFrame, k: int) -> DataFrame:
    """The k entries of each patient with the least mean of both sides' mean least distances in the ball; a side without
    vectors is infinitely far and has no rows."""
    side = lambda df, c: df.select(c, "term_id").distinct().join(embedding, "term_id").select(F.col(c).alias("key"), F.lit(1.0).alias("w"), "v")
    rows = blocks.scan(side(query, "patient_id"), side(library, key), blocks.Ball, k)
    return ranked(rows.select(F.col("l").alias("patient_id"), F.col("r").alias(key), F.round(-F.col("score"), 6).alias("distance")), [F.asc("distance"), F.asc(key)], k)
