"""Terms that share a few vectors: rows carry numbers, and results equal plain loops."""

import numpy as np
import pytest

from orrery.operators import blocks, match, shared_vectors


def tables(spark, seed=3, n_vectors=12, n_terms=40):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n_vectors, 5))
    v[0] = 0
    vector = {t: v[t % n_vectors] for t in range(n_terms)}
    asked = {p: sorted(set(rng.integers(0, n_terms + 3, 6).tolist())) for p in range(9)}
    held = {d: sorted(set(rng.integers(0, n_terms + 3, 1 + 4 * (d % 4)).tolist())) for d in range(30)}
    ic = {t: float(t % 5) + 0.5 for t in range(0, n_terms, 2)}
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    return (vector, asked, held, ic, frame([(p, t) for p, ts in asked.items() for t in ts], "patient_id long, term_id long"), frame([(d, t) for d, ts in held.items() for t in [*ts, ts[0]]], "disease_id long, term_id long"),
            frame([(t, [float(c) for c in x]) for t, x in vector.items()], "term_id long, v array<double>"), frame(list(ic.items()), "term_id long, ic double"))


def unit(x):
    n = np.linalg.norm(x)
    return x / n if n else x


@pytest.mark.parametrize("dense", [1, 1000])
def test_best_matches_by_numbers(spark, monkeypatch, dense):
    monkeypatch.setattr(shared_vectors, "DENSE", dense)  # 1000: every entry is looked up by nearest vectors
    monkeypatch.setattr(shared_vectors, "NEAREST", 3)
    monkeypatch.setattr(shared_vectors, "ENTRIES", 4)
    monkeypatch.setattr(shared_vectors, "ASKED", 2)
    vector, asked, held, ic, query, library, embedding, weights = tables(spark)
    score = {}
    for p, ts in asked.items():
        for d, other in held.items():
            mine = [(ic.get(t, 1.0), max(unit(vector[t]) @ unit(vector[u]) for u in other if u in vector)) for t in ts if t in vector and any(u in vector for u in other)]
            if mine:
                score[p, d] = sum(w * c for w, c in mine) / sum(w for w, _ in mine)
    monkeypatch.setattr(blocks, "packed", None)  # no row carries a vector
    whole = {(r.patient_id, r.disease_id): r.similarity for r in match.best_match_similarity(query, library, "disease_id", embedding, weights).collect()}
    assert whole.keys() == score.keys() and all(abs(whole[x] - score[x]) < 1e-9 for x in score)
    best = {(r.patient_id, r.disease_id): r.similarity for r in match.best_match_similarity(query, library, "disease_id", embedding, weights, 3).collect()}
    for p in asked:
        third = sorted((s for (q, _), s in score.items() if q == p), reverse=True)[2]
        assert all(abs(best[x] - score[x]) < 1e-9 for x in score if x[0] == p and score[x] >= third - 1e-9)


def test_slabs_of_patients(spark, monkeypatch):
    _, _, _, _, query, library, embedding, weights = tables(spark)
    rows = lambda k: sorted((r.patient_id, r.disease_id, round(r.similarity, 9)) for r in match.best_match_similarity(query, library, "disease_id", embedding, weights, k).collect())
    whole, all_rows = rows(40), rows(None)
    monkeypatch.setattr(shared_vectors, "SLAB", 10)
    assert rows(40) == whole == all_rows == rows(None)


def test_many_vectors_go_over_blocks(spark, monkeypatch):
    _, _, _, _, query, library, embedding, weights = tables(spark)
    rows = lambda: sorted((r.patient_id, r.disease_id, round(r.similarity, 9)) for r in match.best_match_similarity(query, library, "disease_id", embedding, weights).collect())
    whole = rows()
    monkeypatch.setattr(shared_vectors, "MOST_VECTORS", 3)
    assert rows() == whole


def test_empty_sides(spark):
    _, _, _, _, query, library, embedding, weights = tables(spark)
    for k in (None, 2):
        assert match.best_match_similarity(query.where("false"), library, "disease_id", embedding, weights, k).count() == 0
        assert match.best_match_similarity(query, library.where("false"), "disease_id", embedding, weights, k).count() == 0
        assert match.best_match_similarity(query, library, "disease_id", embedding.where("false"), weights, k).count() == 0


def test_mean_vectors_by_numbers(spark, monkeypatch):
    monkeypatch.setattr(shared_vectors, "ENTRIES", 4)
    monkeypatch.setattr(match.vec, "weighted_mean_vectors", None)  # no row is unfolded into components
    vector, _, held, ic, _, library, embedding, weights = tables(spark)
    found = {r.disease_id: r.v for r in match.mean_vectors(library, "disease_id", embedding, weights.where("ic < 4")).collect()}
    for d, ts in held.items():
        mine = [(ic[t], vector[t]) for t in ts if t in vector and ic.get(t, 9) < 4]
        assert (d in found) == bool(mine)
        if mine:
            assert np.allclose(found[d], sum(w * v for w, v in mine) / sum(w for w, _ in mine), atol=1e-12)
    flat = {r.disease_id: r.v for r in match.mean_vectors(library, "disease_id", embedding, weights.selectExpr("term_id", "0.0 as ic")).collect()}
    assert all(np.allclose(v, np.mean([vector[t] for t in held[d] if t in ic], axis=0)) for d, v in flat.items()) and flat
