"""R06 unfolds the cases that can be ranked alone; pairs meet vectors without carrying them."""

import pytest
from oracle import check
from pyspark.sql import functions as F

from orrery.operators import match, ontology, rank
from orrery.plans.more_queries import base

SF = "/root/testdata/sf0.001"


def test_only_cases_that_can_be_ranked_are_unfolded(spark):
    query = spark.createDataFrame([(1, t) for t in range(4)], "patient_id long, term_id long")
    # case: terms, diseases; 0 and 1 share their set and tie, 2 ties with them, 3 to 9 have one term
    cases = spark.createDataFrame([(0, [0, 1], [5, 6]), (1, [1, 2], [6, 5]), (2, [2, 3], [7]), (10, [0, 1, 2], []), *[(i, [0], [20 + i]) for i in range(3, 10)]], "case_id long, terms array<long>, diseases array<long>")
    annotation = spark.createDataFrame([(5, 0, 0.5), (6, 1, 0.25), (5, 1, 0.1), (6, 2, 0.5), (7, 2, 0.75), (24, 0, None), (25, 3, 0.9)], "disease_id long, term_id long, freq double")
    similarity = spark.createDataFrame([(1, 6, 0.4), (1, 7, 0.3), (1, 25, 1.0)], "patient_id long, disease_id long, similarity double")
    asked = []

    def of(pairs):
        asked.extend(tuple(r) for r in pairs.collect())
        return similarity

    found = [tuple(r) for r in rank.rank_cases(query, cases, 2, annotation, of).orderBy("rank").select("case_id", "n_match", "freq_sum", "similarity", "rank").collect()]
    assert found == [(0, 2, 0.75, 0.4, 1), (2, 2, 0.75, 0.3, 2)]
    assert sorted(asked) == [(1, 5), (1, 6), (1, 7)]
    whole = rank.rank_cases(query, cases, 20, annotation, similarity).collect()
    assert {r.case_id for r in whole} == {0, 2, *range(3, 10)} and max(r.rank for r in whole) == 9


def test_pairs_carry_no_vectors(spark, monkeypatch):
    v = lambda key, rows: spark.createDataFrame(rows, f"{key} long, v array<double>")
    pairs = spark.createDataFrame([(p, d, "x") for p in range(4) for d in range(4)], "patient_id long, disease_id long, more string")
    a, b = v("patient_id", [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 0.0])]), v("disease_id", [(0, [2.0, 0.0]), (1, [0.0, -1.0]), (3, [0.0, 0.0])])
    want = {(0, 0): 1.0, (1, 0): 0.707107, (1, 1): -0.707107}
    for slab in (100, 1):
        monkeypatch.setattr(match, "PATIENTS", slab)
        rows = match.pair_cosines(pairs, a, b)
        found = {(r.patient_id, r.disease_id): round(r.similarity, 6) + 0.0 for r in rows.collect()}
        assert found == {(p, d): want.get((p, d), 0.0) for p in range(4) for d in range(4)} and rows.columns == ["patient_id", "disease_id", "more", "similarity"]


@pytest.mark.parametrize("name", ["M01_candidates", "M03_match_by_parent", "M06_match_summary", "M08_case_similarity", "R04_rank_score", "R06_rank_cases"])
def test_matches_by_parents_make_no_closure(spark, monkeypatch, name):
    from orrery.operators import lineage

    lineage.forget()
    monkeypatch.setattr(ontology, "closure", lambda *a: 1 / 0)
    check(spark, name, base.QUERIES[name], base.ORACLES[name], SF)
