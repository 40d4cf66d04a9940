"""What grows with the tables: work that is repeated, rows that are moved after they were multiplied, tasks that hold one key."""

import numpy as np
from pyspark.sql import functions as F

from orrery.operators import blocks, match, resolve, textops
from orrery.sources import readers


def test_shared_vectors_meet_the_library_once(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(6, 4))
    asked = {k: list(rng.integers(0, 6, 3)) for k in range(40)}
    held = {k: list(rng.integers(0, 6, 2)) for k in range(30)}
    table = lambda of: spark.createDataFrame([(int(k), 1.0, [float(x) for x in v[i]]) for k, ids in of.items() for i in ids], "key long, w double, v array<double>")
    slabs = list(blocks.slabs(table(asked), 20))
    assert len(slabs) == 1 and len(slabs[0][2]) <= 6
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    score = {(a, b): np.mean([max(unit[i] @ unit[j] for j in held[b]) for i in asked[a]]) for a in asked for b in held}
    whole = {(r.l, r.r): r.score for r in blocks.scan(table(asked), table(held), blocks.Cosine, size=16, slab=20).collect()}
    assert whole.keys() == score.keys() and all(abs(whole[p] - score[p]) < 1e-9 for p in score)
    best = {(r.l, r.r): r.score for r in blocks.scan(table(asked), table(held), blocks.Cosine, 3, size=16, slab=20).collect()}
    for a in asked:
        third = sorted((score[a, b] for b in held), reverse=True)[2]
        assert all((a, b) in best and abs(best[a, b] - score[a, b]) < 1e-9 for b in held if score[a, b] > third - 1e-9)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def moved_after_explode(plan):
    """Whether an exchange stands above an explode in a plan's tree."""
    lines = plan.splitlines()
    at = [i for i, x in enumerate(lines) if "Generate explode(_ids" in x]
    depth = lambda x: len(x) - len(x.lstrip(" :+-*()0123456789"))
    return not at or any("Exchange" in x and depth(x) < depth(lines[i]) for i in at for x in lines[:i])


def test_rows_of_groups_are_multiplied_last(spark):
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4)], "disease_id long, group_id long")
    merged = spark.createDataFrame([(1, 7, ["1/2"], ["fraction"], ["a"]), (2, 7, ["5%"], ["percentage"], ["b"]), (2, 8, [], [], ["b"]), (4, 7, ["rare"], ["other"], ["a"])], "disease_id long, term_id long, frequencies array<string>, frequency_types array<string>, sources array<string>")
    whole = resolve.annotations_of_groups(merged, groups)
    assert {tuple(r) for r in whole.collect()} == {(d, 7, "1/2; 5%", "fraction; percentage", "a; b", 2) for d in (1, 2, 3)} | {(d, 8, "", "", "b", 2) for d in (1, 2, 3)} | {(4, 7, "rare", "other", "a", 1)}
    assert not moved_after_explode(plan_of(whole))
    shares = resolve.propagate_annotations(spark.createDataFrame([(1, 7, 0.5), (2, 7, 0.25), (4, 7, None)], "disease_id long, term_id long, freq double"), groups)
    assert {tuple(r) for r in shares.collect()} == {(1, 7, 0.5), (2, 7, 0.5), (3, 7, 0.5), (4, 7, None)}
    assert not moved_after_explode(plan_of(shares))


def test_public_ids_of_several_groups_are_merged_alone(spark):
    edges = spark.createDataFrame([("D:1", "t", 0.5), ("D:1", "t", 0.7), ("D:2", "t", 0.9), ("D:3", "u", None), ("D:4", "u", 0.1)], "sourceID string, targetID string, freq double")
    public = spark.createDataFrame([("D:1", "a"), ("D:1", "b"), ("D:2", "b"), ("D:2", "D:3"), ("D:4", "c"), ("D:4", "c")], "sourceID string, targetID string")
    found = readers.public_annotations(edges, public)
    assert sorted(tuple(r) for r in found.collect()) == [("D:3", "t", 0.9), ("D:3", "u", None), ("a", "t", 0.7), ("b", "t", 0.9), ("c", "u", 0.1)]


def test_terms_of_one_vector_are_compared_once(spark):
    v = [[1.0, 0.0], [0.0, 1.0]]
    embedding = spark.createDataFrame([(i, v[i % 2]) for i in range(40)], "term_id long, v array<double>")
    terms = spark.range(40).select(F.col("id").alias("term_id"))
    seen = []
    scan = blocks.scan
    blocks.scan = lambda a, b, *args, **more: seen.append((a.count(), b.count())) or scan(a, b, *args, **more)
    try:
        found = match.term_cosines(terms.where("term_id < 20"), terms, embedding, 0.6).collect()
    finally:
        blocks.scan = scan
    assert seen == [(2, 2)]
    assert {(r.query_term, r.term_id) for r in found} == {(a, b) for a in range(20) for b in range(40) if a % 2 == b % 2} and len(found) == 400


def test_all_terms_of_pairs_are_unfolded_last(spark):
    query = spark.createDataFrame([(1, 5), (1, 6), (1, 7), (2, 5)], "patient_id long, term_id long")
    matches = spark.createDataFrame([(1, 9, 5, "by parent"), (1, 9, 5, "direct"), (1, 8, 6, "by child"), (2, 9, 5, "by parent")], "patient_id long, disease_id long, query_term long, kind string")
    found = match.all_terms_predicted(query, matches)
    pairs = matches.select("patient_id", "disease_id").distinct()
    same = match.prediction_term_enrichment(query.join(pairs, "patient_id"), matches).select(found.columns)
    assert sorted(found.collect()) == sorted(same.collect()) and found.count() == 7
    top = plan_of(found).split("Generate explode(_terms")[0]
    assert "Exchange" not in top


def test_case_annotations_are_not_moved(spark, monkeypatch):
    monkeypatch.setattr(resolve, "PAIRS", 3)
    cases = spark.createDataFrame([(1, [1, 2], [7, 8]), (2, [2, 3, None], [8, 9, 8]), (3, [2], []), (4, [4], None), (5, [2, 2], [7, None, 5])], "case_id long, diseases array<long>, terms array<long>")
    found = resolve.case_annotations(cases, ())
    plan = plan_of(found)
    want = {(d, t) for ds, ts in (((1, 2), (7, 8)), ((2, 3, None), (8, 9)), ((2,), (7, None, 5))) for d in ds for t in ts}
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(want) and set(rows) == {(None if d is None else str(d), t) for d, t in want}
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan
    named = spark.createDataFrame([(1, [" OMIM:1", "X:2"], ["a"]), (2, ["OMIM:1 "], ["a", "b"])], "case_id long, diseases array<string>, terms array<string>")
    assert sorted(tuple(r) for r in resolve.case_annotations(named).collect()) == [("OMIM:1", "a"), ("OMIM:1", "b")]


def test_xml_files_are_cut(spark, tmp_path):
    one = '  <HPODisorderSetStatus id="{0}">\n    <Disorder id="{0}">\n      <OrphaCode>{0}</OrphaCode><Name lang="en">a &lt;b&gt; &amp;\n{0}</Name>\n      <HPODisorderAssociationList count="1"><HPODisorderAssociation><HPO><HPOId>HP:{0}</HPOId></HPO><HPOFrequency><Name>Frequent (79-30%)</Name></HPOFrequency></HPODisorderAssociation></HPODisorderAssociationList>\n    </Disorder>\n    <Source>s</Source>\n  </HPODisorderSetStatus>\n'
    (tmp_path / "p.xml").write_text('<?xml version="1.0" encoding="UTF-8"?>\n<JDBOR><HPODisorderSetStatusList count="200">\n<HPODisorderSetStatus/>\n' + "".join(one.format(i) for i in range(200)) + "</HPODisorderSetStatusList></JDBOR>\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        found = readers.read_xml_disorder_phenotypes(spark, str(tmp_path / "p.xml"))
        assert found.rdd.getNumPartitions() > 4
        rows = found.select("disease_id", "name", "term_id", "frequency_label", "record_source").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(tuple(r) for r in rows) == sorted((f"ORPHA:{i}", f"a <b> &\n{i}", f"HP:{i}", "Frequent", "s") for i in range(200))


def test_large_lexicons_run_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words, 40))) for i in range(20)] + [(20, None)], "doc_id long, text string")
    lexicon = spark.createDataFrame([(" ".join(rng.choice(words, 1 + i % 3)), i) for i in range(120)] + [(f"w0 w{i}", 500 + i) for i in range(30)], "phrase string, term_id long")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    whole = rows(textops.dictionary_annotate(docs, lexicon))
    monkeypatch.setattr(textops, "MOST_PHRASES", 60)
    parts = textops.dictionary_annotate(docs, lexicon)
    assert rows(parts) == whole and len(whole) > 100
    assert "Exchange" not in plan_of(parts) and plan_of(parts).count("MapInArrow") > 2
    monkeypatch.setattr(textops, "MOST_PHRASES", 10)  # w0 alone has more
    assert rows(textops.dictionary_annotate(docs, lexicon)) == whole
