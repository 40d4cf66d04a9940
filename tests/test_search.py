"""Similar sets, phrases and SQL functions against plain recomputation."""

import random

from pyspark.sql import functions as F

from orrery.functions import frequency, registered, vectors
from orrery.operators import match, textops


def test_most_similar_sets(spark):
    """A term that most cases have, ties, repeated rows, nulls, patients with few similar cases or none: the k best by id."""
    r = random.Random(3)
    cases = {i: {0} | {min(int(r.expovariate(0.06)), 60) for _ in range(r.randint(1, 9))} for i in range(150)} | {200 + i: {1, 2, 3} for i in range(5)}
    patients = {i: {min(int(r.expovariate(0.06)), 60) for _ in range(r.randint(1, 8))} | ({0} if i % 2 else set()) for i in range(25)} | {90: {777}, 91: {1, 2, 3}, 92: {777, 778, 5}}
    rows = lambda d, k: spark.createDataFrame([(i, t) for i, ts in d.items() for t in ts] * 2 + [(None, 1), (1000, None)], f"{k} long, term_id long")
    for k in (1, 3, 200):
        got = {}
        for x in match.most_similar_sets(rows(patients, "patient_id"), rows(cases, "case_id"), k).collect():
            got.setdefault(x.patient_id, []).append((-round(x.jaccard, 9), x.case_id))
        for p, mine in patients.items():
            every = sorted((-round(len(mine & c) / len(mine | c), 9), i) for i, c in cases.items() if mine & c)
            assert sorted(got.get(p, [])) == every[:k]
    assert match.most_similar_sets(rows({}, "patient_id"), rows(cases, "case_id"), 3).count() == 0
    assert match.most_similar_sets(rows(patients, "patient_id"), rows({}, "case_id").where("term_id < 0"), 3).count() == 0


def test_phrases(spark, monkeypatch):
    """Overlapping phrases of several lengths, one phrase of two terms, odd texts: the automaton and the join agree with plain search."""
    r = random.Random(5)
    words = ["ab", "b", "abc", "é", "x1"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 30))) for _ in range(40)] + [None, "", "--", "Ab, B!", "ab b " * 3000]
    lexicon = [("ab b", 5), ("AB  b", 3), ("b abc é", 7), ("ab", 1), ("b", 2), ("ab b abc é x1", 9), ("", 8), (None, 8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    frame = spark.createDataFrame(lexicon, "phrase string, term_id long")
    known = {}
    for p, t in lexicon:
        w = tuple((p or "").lower().split())
        if w:
            known[w] = min(t, known.get(w, t))
    want = set()
    for i, t in enumerate(texts):
        w = (t or "").lower().replace(",", " ").replace("!", " ").replace("-", " ").split()
        for at in range(len(w)):
            fits = [n for n in range(1, 6) if tuple(w[at : at + n]) in known and at + n <= len(w)]
            if fits:
                want.add((i, at + 1, max(fits), known[tuple(w[at : at + max(fits)])]))
    rows = lambda: {tuple(x) for x in textops.dictionary_annotate(docs, frame).collect()}
    assert rows() == want
    monkeypatch.setattr(textops, "MOST_PHRASES", 1)
    assert rows() == want
    assert textops.dictionary_annotate(docs, frame.where("term_id < 0")).count() == 0


def test_sql_functions(spark):
    registered.register(spark)
    tokens = ["4/5", "0/0", "80%", "12.5%", "3 of 7", "30%-79%", "30-79%", "HP:0040281", "hp:0040281", "HP:0040281; HP:0040283", "Very frequent", "rare", "excluded", "", None, "n/a", " 1/2 ", "Very rare;1/2", "3 / 4"]
    s = F.col("s")
    rows = spark.createDataFrame([(t,) for t in tokens], "s string")
    rows.createOrReplaceTempView("frequency_tokens")
    ours = rows.select("s", frequency.freq_type(s), frequency.freq_numeric(s), frequency.freq_max(s)).collect()
    assert [tuple(x) for x in spark.sql("SELECT s, freq_type(s), freq_numeric(s), freq_max(s) FROM frequency_tokens").collect()] == [tuple(x) for x in ours]
    pairs = spark.createDataFrame([([0.1, 0.2], [0.3, -0.1]), ([0.0, 0.0], [0.0, 0.0]), ([0.999, 0.0], [-0.999, 0.1])], "u array<double>, v array<double>")
    pairs.createOrReplaceTempView("ball_pairs")
    d = [x[0] for x in pairs.select(vectors.poincare_distance(F.col("u"), F.col("v"))).collect()]
    assert all(abs(a[0] - b) < 1e-9 for a, b in zip(spark.sql("SELECT poincare_distance(u, v) FROM ball_pairs").collect(), d))
