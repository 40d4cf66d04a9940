"""Evaluation of rankings against known diseases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as vec
from .lineage import cut

HIT = 0.8
#: A claim of a term less similar than this is wrong; one more similar than that is missed.
LOW, HIGH = 0.4, 0.7
TOPS = (1, 3, 5, 10, 20, 30)


def name_grams(s):
    """A name's vector without a model: the set of its runs of three characters, with a space at both ends."""
    t = F.concat(F.lit(" "), F.lower(F.trim(s)), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: F.substr(t, i, F.lit(3))))


def gram_similarity(a, b):
    """Cosine of two names' sets of runs."""
    return F.size(F.array_intersect(name_grams(a), name_grams(b))) / F.sqrt((F.size(name_grams(a)) * F.size(name_grams(b))).cast("double"))


def variants(s, pattern: str = ";"):
    """The names in a list of names, trimmed and distinct."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(s, F.lit("")), pattern), lambda x: F.trim(x)), lambda x: x != ""))


def name_similarity_pairs(truth: DataFrame, ranking: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """(patient_id, true_name, ranked_name, rank, sim): every true name against every ``;`` variant of the patient's ranked names;
    cosine of the given vectors (name, v), or of the names' runs of characters."""
    a = truth.select("patient_id", "true_name").distinct()
    b = ranking.select("patient_id", "rank", F.explode(variants(F.col("ranked_name"))).alias("ranked_name"))
    if vectors is None:
        return a.join(b.hint("merge"), "patient_id").withColumn("sim", gram_similarity(F.col("true_name"), F.col("ranked_name")))
    a = a.join(vectors.select(F.col("name").alias("true_name"), F.col("v").alias("_a")), "true_name")
    b = b.join(vectors.select(F.col("name").alias("ranked_name"), F.col("v").alias("_b")), "ranked_name")
    return a.join(b.hint("merge"), "patient_id").select("patient_id", "true_name", "ranked_name", "rank", vec.cosine(F.col("_a"), F.col("_b")).alias("sim"))


def prediction_accuracy(truth: DataFrame, predicted: DataFrame, alias: DataFrame, resolved: DataFrame, threshold: float = HIT, tops: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """By patient, the best similarity and its rank, and whether one of the first 1, 3, 5, 10 predictions is right.

    True names (patient_id, true_name) are cut at ``;`` and ``/``; predictions (patient_id, rank, name) bring all aliases of the
    disease that ``resolved`` (name, disease_id) takes them for."""
    a = truth.select("patient_id", F.explode(variants(F.col("true_name"), "[;/]")).alias("true_name"))
    more = predicted.join(resolved.select("name", "disease_id"), "name").join(alias.select("disease_id", "alias"), "disease_id").select("patient_id", "rank", F.col("alias").alias("ranked_name"))
    b = predicted.select("patient_id", "rank", F.col("name").alias("ranked_name")).unionByName(more)
    pairs = name_similarity_pairs(a, b)
    flags = [F.bool_or((F.col("sim") >= threshold) & (F.col("rank") <= n)).alias(f"top{n}") for n in tops]
    best = pairs.groupBy("patient_id").agg(F.max(F.struct(F.round("sim", 9).alias("sim"), (-F.col("rank")).alias("r"))).alias("b"), *flags)
    return best.select("patient_id", F.col("b.sim").alias("best_similarity"), (-F.col("b.r")).alias("best_rank"), *[f"top{n}" for n in tops])


def prediction_mapping(predicted: DataFrame, resolved: DataFrame, standard: DataFrame, annotation: DataFrame, matches: DataFrame) -> DataFrame:
    """(patient_id, step, rank, name, disease_id, standard_name, similarity, total_associations, matched, n_matched) of predictions
    (patient_id, step, rank, name): what each name is taken for, and which of the patient's terms that disease has."""
    totals = annotation.groupBy("disease_id").agg(F.countDistinct("term_id").alias("total_associations"))
    rows = predicted.join(resolved.select("name", "disease_id", F.col("sim").alias("similarity")).hint("merge"), "name", "left").join(standard.select("disease_id", "standard_name"), "disease_id", "left")
    rows = cut(rows)
    asked = matches.join(rows.select("patient_id", "disease_id").distinct().hint("shuffle_hash"), ["patient_id", "disease_id"], "left_semi")  # few matches are of predicted pairs
    terms = asked.groupBy("patient_id", "disease_id").agg(F.array_join(F.array_sort(F.collect_set(F.col("query_term").cast("string"))), ";").alias("matched"), F.countDistinct("query_term").alias("n_matched"))
    rows = rows.join(totals.hint("merge"), "disease_id", "left").join(terms.hint("merge"), ["patient_id", "disease_id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("patient_id", "step", "rank", "name", "disease_id", F.coalesce("standard_name", F.lit("Unknown")).alias("standard_name"), "similarity", zero("total_associations"), F.coalesce("matched", F.lit("")).alias("matched"), zero("n_matched"))


def best_match_rank(pairs: DataFrame, threshold: float = HIT) -> DataFrame:
    """Rank of the most similar candidate, a hit if similar enough."""
    best = pairs.groupBy("patient_id").agg(F.max(F.struct("sim", (-F.col("rank")).alias("r"))).alias("b"))
    return best.select("patient_id", F.col("b.sim").alias("sim"), (-F.col("b.r")).alias("rank"), (F.col("b.sim") >= threshold).alias("hit"))


def topn_flags(pairs: DataFrame, threshold: float = HIT, tops: tuple[int, ...] = TOPS) -> DataFrame:
    return pairs.groupBy("patient_id").agg(*[F.bool_or((F.col("sim") >= threshold) & (F.col("rank") <= n)).alias(f"top{n}") for n in tops])


def upper_median(values: DataFrame, column: str, out: str) -> DataFrame:
    """One row with ``sorted[n // 2]`` of the values that are not null: they are counted by value, and the counts added up."""
    counts = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_c"))
    sums = counts.select("_v", F.sum("_c").over(Window.orderBy("_v")).alias("_to"), F.sum("_c").over(Window.partitionBy()).alias("_all"))  # a row for each value
    return sums.agg(F.min(F.when(F.col("_to") > F.floor(F.col("_all") / 2), F.col("_v"))).alias(out))


def overall_statistics(best: DataFrame, flags: DataFrame, tops: tuple[int, ...] = TOPS) -> DataFrame:
    """One row: numbers and rates of hits, and their ranks."""
    hit = F.when(F.col("hit"), F.col("rank"))
    rows = best.join(flags.hint("merge"), "patient_id").agg(
        F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.round(100 * F.count_if("hit") / F.count("*"), 6).alias("hit_rate"), F.round(F.avg(hit), 6).alias("mean_rank"),
        F.min(hit).alias("best_rank"), F.max(hit).alias("worst_rank"), F.count_if(~F.col("hit")).alias("unranked"), *[F.round(100 * F.count_if(f"top{n}") / F.count("*"), 6).alias(f"top{n}_rate") for n in tops])
    return rows.crossJoin(F.broadcast(upper_median(best.withColumn("_r", hit), "_r", "median_rank")))  # one row


def method_hit_rates(fused: DataFrame, truth: DataFrame, methods: list[str], tops: tuple[int, ...] = TOPS) -> DataFrame:
    """(method, n, top...): the percentage of patients whose true disease a method's own list has among its first ranks."""
    ranks = fused.select("patient_id", "method", "key", "rank").join(truth.select("patient_id", F.col("true_id").alias("key")).hint("merge"), ["patient_id", "key"])
    n = truth.agg(F.countDistinct("patient_id").alias("n"))
    counted = ranks.groupBy("method").agg(*[F.count_if(F.col("rank") <= t).alias(f"_{t}") for t in tops])
    return counted.where(F.col("method").isin(*methods)).crossJoin(F.broadcast(n)).select("method", "n", *[F.round(100 * F.col(f"_{t}") / F.col("n"), 6).alias(f"top{t}") for t in tops])


def distribution(values: DataFrame, column: str) -> DataFrame:
    rows = values.agg(F.min(column).alias("least"), F.max(column).alias("most"), F.round(F.avg(column), 6).alias("mean"))
    return rows.crossJoin(F.broadcast(upper_median(values, column, "median")))  # one row


def rebuilt_claims(checked: DataFrame) -> DataFrame:
    """(patient_id, disease_id, matched, unmatched, explained): claims as they should have been made, and whether any term is explained."""
    right = F.when(F.col("finding") == "error", False).when(F.col("finding") == "missed", True).otherwise(F.col("claimed"))
    listed = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("term_id").cast("string")))), ";")
    return checked.withColumn("_r", right).groupBy("patient_id", "disease_id").agg(listed(F.col("_r")).alias("matched"), listed(~F.col("_r")).alias("unmatched"), F.bool_or("_r").alias("explained"))


def unexplained_terms(checked: DataFrame) -> DataFrame:
    """(patient_id, term_id) of terms that no disease of the patient explains."""
    right = F.when(F.col("finding") == "error", False).when(F.col("finding") == "missed", True).otherwise(F.col("claimed"))
    return checked.groupBy("patient_id", "term_id").agg(F.bool_or(right).alias("_any")).where("not _any").select("patient_id", "term_id")


def term_claim_check(claims: DataFrame, sims: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Claims (patient_id, disease_id, term_id, claimed) with the best similarity: wrong claims and missed matches."""
    best = sims.groupBy("disease_id", "term_id").agg(F.max("sim").alias("best"))
    return with_finding(claims.join(best, ["disease_id", "term_id"], "left").withColumn("best", F.coalesce("best", F.lit(0.0))), low, high)


def with_finding(claims: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    return claims.withColumn("finding", F.when(F.col("claimed") & (F.col("best") < low), "error").when(~F.col("claimed") & (F.col("best") > high), "missed").otherwise("ok"))


def over_common_terms(named: DataFrame, annotation: DataFrame, answers: int = 5, diseases: int = 100) -> DataFrame:
    """Terms named in at least ``answers`` answers of a patient and annotated to over ``diseases`` diseases."""
    n = annotation.groupBy("term_id").agg(F.countDistinct("disease_id").alias("n_diseases")).where(F.col("n_diseases") > diseases)
    return named.groupBy("patient_id", "term_id").agg(F.countDistinct("disease_id").alias("n_answers")).where(F.col("n_answers") >= answers).join(n, "term_id")


def step_statistics(steps: DataFrame) -> DataFrame:
    return steps.groupBy("step").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.round(F.count_if("hit") / F.count("*"), 6).alias("accuracy"))


def ranking_performance(best: DataFrame, k: int) -> DataFrame:
    """Shares of patients whose hit ranks within 1, 5, 10, 20, 30 and k."""
    within = lambda n: F.round(F.count_if(F.col("hit") & (F.col("rank") <= n)) / F.count("*"), 6)
    return best.agg(F.count("*").alias("n"), *[within(n).alias(f"within{n}") for n in sorted({1, 5, 10, 20, 30, k})])


def matching_summary(best: DataFrame) -> DataFrame:
    """One line on each patient's outcome."""
    said = F.when(F.col("hit"), F.concat(F.lit("found at rank "), F.col("rank").cast("string"))).otherwise("not found")
    return best.select("patient_id", F.concat(F.lit("patient "), F.col("patient_id").cast("string"), F.lit(": "), said).alias("line"))


def review_notes(findings: DataFrame) -> DataFrame:
    """(patient_id, notes): the findings (patient_id, term_id, finding) of a patient as one text."""
    note = F.concat("finding", F.lit(" "), F.col("term_id").cast("string"))
    return findings.where("finding <> 'ok'").groupBy("patient_id").agg(F.array_join(F.array_sort(F.collect_set(note)), "; ").alias("notes"))
