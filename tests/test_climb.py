"""Values carried up and down the ontology in the task that holds a disease, against the joins."""

import random

import pytest
from oracle import check
from pyspark.sql import functions as F

from orrery.operators import climb, kg, likelihood, ontology, ratio_blocks, ratio_pairs
from orrery.plans import source_queries  # noqa: F401
from orrery.plans.more_queries import base

SF = "/root/testdata/sf0.001"


@pytest.fixture
def case(spark):
    rng = random.Random(5)
    edge = spark.createDataFrame([(c, p) for c in range(1, 90) for p in {rng.randrange(c) // 2, c // 3}], "child long, parent long").distinct()
    model = spark.createDataFrame([(d, t, rng.choice([0.0, 0.25, 0.5, 1.0])) for d in range(12) for t in rng.sample(range(95), 6)], "disease_id long, term_id long, freq double")
    absent = spark.createDataFrame([(d, rng.randrange(95)) for d in range(14)], "disease_id long, term_id long")
    query = spark.createDataFrame([(p, t) for p in range(9) for t in rng.sample(range(97), 5)], "patient_id long, term_id long")
    return query, model, absent, edge, ontology.closure(edge), spark.createDataFrame([(d, d // 2) for d in range(15)], "disease_id long, group_id long")


def near(df):
    return {tuple(r)[:-1]: round(r[-1], 9) if r[-1] is not None else None for r in df.collect()}


def test_ratios_disease_by_disease_equal_the_joins(spark, case, monkeypatch):
    query, model, absent, edge, closure, groups = case
    want = likelihood.lr_observed_by_joins(query, model, absent, edge, closure, 0).select("term_id", "disease_id", "match_type", "lr")
    monkeypatch.setattr(ratio_blocks, "MOST_EDGES", 5)
    monkeypatch.setattr(likelihood, "lr_observed_by_joins", lambda *a: 1 / 0)  # nothing is joined with ancestors
    found = likelihood.lr_observed(query, model, absent, edge, lambda: 1 / 0, 0).select("term_id", "disease_id", "match_type", "lr")
    assert near(found) == near(want) and found.count() > 100


def test_posteriors_of_given_pairs_alone(spark, case, monkeypatch):
    query, model, absent, edge, closure, groups = case
    whole = likelihood.posteriors(query, likelihood.lr_observed_by_joins(query, model, absent, edge, closure, 0), groups)
    pairs = query.select("patient_id").distinct().crossJoin(groups.select("disease_id")).where("(patient_id + disease_id) % 2 = 0").withColumn("more", F.lit("x"))
    want = pairs.join(whole, ["patient_id", "disease_id"], "left").select("patient_id", "disease_id", "more", "posterior")
    for slab in (ratio_pairs.SLAB, 10):
        monkeypatch.setattr(ratio_pairs, "SLAB", slab)
        assert near(likelihood.pair_posteriors(pairs, query, model, absent, edge, lambda: 1 / 0, 0, groups).select(want.columns)) == near(want)
    eligible = F.col("disease_id") % 3 != 1
    of_group = likelihood.with_group_posterior(pairs, whole.where(eligible), groups)
    assert near(likelihood.group_posteriors(pairs, query, model, absent, edge, lambda: 1 / 0, 0, groups, eligible)) == near(of_group)


@pytest.mark.parametrize("name", ["R03_rank_posterior", "R03_group_posterior", "R04_rank_score"])
def test_rankings_compute_no_other_pairs(spark, monkeypatch, name):
    monkeypatch.setattr(ratio_blocks, "MOST_EDGES", 5)
    monkeypatch.setattr(likelihood, "lr_observed_by_joins", lambda *a: 1 / 0)
    monkeypatch.setattr(ratio_blocks, "log_sums", lambda *a: 1 / 0)
    check(spark, name, base.QUERIES[name], base.ORACLES[name], SF)


def test_counts_and_shares_above_equal_the_joins(spark, case, monkeypatch):
    query, model, absent, edge, closure, groups = case
    monkeypatch.setattr(climb, "CHUNK", 7)
    terms = spark.range(92).select(F.col("id").alias("term_id")).where("term_id % 11 <> 4")  # some ancestors are no terms of their own
    mine, o = ontology.with_self(closure, terms), climb.terms_of(edge, terms)
    counts = kg.association_count_by_climb(model, groups, o, terms)
    assert near(counts) == near(kg.association_count(model, groups, closure, terms)) and counts.count() > 50
    assert near(likelihood.background_by_climb(model, o)) == near(likelihood.background_frequency(model, mine))
    assert near(likelihood.induced_by_climb(model, o, 0).select("disease_id", "term_id", "f")) == near(likelihood.induced_frequency(model, mine, 0))
    looped = edge.union(spark.createDataFrame([(2, 80), (80, 2)], "child long, parent long"))
    assert climb.terms_of(looped, terms) is None


def test_closest_annotated_ancestors_equal_the_joins(spark, case):
    query, model, absent, edge, closure, groups = case
    terms = spark.range(97).select(F.col("id").alias("term_id"))
    mine = ontology.with_self(closure, terms)
    induced = likelihood.induced_frequency(model, mine, 0)
    want = ontology.closest_annotated_ancestor(query, mine, induced, 0).join(induced.withColumnRenamed("term_id", "ancestor_id"), ["disease_id", "ancestor_id"]).select("term_id", "disease_id", "ancestor_id", "f")
    found = ratio_pairs.nearest_annotated(climb.terms_of(edge, terms), query, model, 0)
    assert near(found) == near(want) and found.count() > 100


@pytest.mark.parametrize("name", ["N01_association_count", "N04_ic_minmax", "L02_background_frequency", "L03_induced_frequency", "L05_no_common_organ", "O08_closest_annotated_ancestor"])
def test_no_annotation_is_joined_with_its_ancestors(spark, monkeypatch, name):
    monkeypatch.setattr(ontology, "closure", lambda *a: 1 / 0)
    from orrery.operators import lineage

    lineage.forget()
    check(spark, name, base.QUERIES[name], base.ORACLES[name], SF)
