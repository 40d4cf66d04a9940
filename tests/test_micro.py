"""Hand-computed small tables for what is easily got wrong."""

import json

from pyspark.sql import functions as F

from orrery.functions import frequency as freq
from orrery.functions import names
from orrery.operators import evaluate, fusion, kg, ontology, resolve
from orrery.sources import readers, sinks
from orrery.streaming import ranks


def values(spark, texts, f):
    return [r[1] for r in spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", f(F.col("s"))).orderBy("i").collect()]


def test_frequencies(spark):
    got = values(spark, ["4/5", "0/0", "80%", "3 of 7", "30%-79%", "30-79%", "HP:0040281", "Very frequent", "rare", "excluded", "", None], freq.freq_numeric)
    want = [0.8, None, 0.8, 3 / 7, 0.545, 0.545, 0.895, 0.895, 0.05, None, None, None]
    assert [None if g is None else round(g, 9) for g in got] == [None if w is None else round(w, 9) for w in want]
    assert values(spark, ["HP:0040281; HP:0040283; x"], freq.freq_max) == [0.895]
    assert values(spark, ["1/2"], lambda s: freq.freq_numeric(s, "pred")) == [0.0]
    assert values(spark, ["HP:0040281; HP:0040281; 1/2"], freq.freq_display) == ["Very frequent; 1/2"]


def test_ratio_rounds_half_to_even(spark):
    got = values(spark, ["10%", "30%", "50%", "3/0", "7/5", "", "HP:0040282"], lambda s: freq.lr_freq_ratio(F.lit(False), s))
    assert [tuple(g) for g in got] == [(0, 5), (2, 5), (2, 5), (3, 5), (5, 5), (1, 1), (3, 5)]


def test_norm_name(spark):
    assert values(spark, ["Marfan syndrome", "Xsyndrome", "A disease"], names.norm_name) == ["marfan", "", "a"]
    assert values(spark, ["Xsyndrome"], lambda s: names.norm_name(s, compat=False)) == ["x"]


def test_closure_of_diamonds_and_cycles(spark):
    e = spark.createDataFrame([(4, 2), (4, 3), (2, 1), (3, 1), (1, 4)], "child int, parent int")
    got = {(r.term_id, r.ancestor_id): r.distance for r in ontology.closure(e).collect()}
    assert got[4, 1] == 2 and got[1, 2] == 2 and got[2, 3] == 3 and all(a != b for a, b in got)


def test_groups_through_chains(spark):
    a = spark.createDataFrame([(i, x) for i in range(1, 9) for x in (f"n{i}", f"N{i + 1}")] + [(20, "solo"), (21, " ")], "disease_id int, alias string")
    got = dict(resolve.entity_groups(a).collect())
    assert {got[i] for i in range(1, 9)} == {1} and got[20] == 20 and got[21] == 21


def test_statistics(spark):
    v = spark.createDataFrame([(x,) for x in (1, 2, 3, 10)], "n int")
    assert evaluate.distribution(v, "n").first()["median"] == 3
    p = spark.createDataFrame([(1, 0.85, 2), (1, 0.95, 40), (1, 0.95, 30)], "patient_id int, sim double, rank int")
    assert evaluate.best_match_rank(p).first()["rank"] == 30 and evaluate.topn_flags(p).first()["top3"]


def test_last_rank_of_repeated_keys(spark):
    c = spark.createDataFrame([(1, "m", "a", 1), (1, "m", "a", 4), (1, "m", "b", 2), (1, "m", "c", 3)], "patient_id int, method string, key string, rank int")
    got = {r["key"]: r["ratio"] for r in fusion.rank_ratio(c).collect()}
    assert got["a"] == 1.0 and got["b"] == 0.5


def test_numbering(spark):
    df = spark.createDataFrame([(f"k{i:03d}",) for i in range(50)], "k string").repartition(5)
    got = kg.numbered(df, "k", "n").orderBy("k").collect()
    assert [r["n"] for r in got] == list(range(1, 51))


def test_readers(spark, tmp_path):
    (tmp_path / "o.obo").write_text('format-version: 1\n\n[Term]\nid: HP:1\nname: one\nsynonym: "a "b" c" EXACT []\nis_a: HP:0 ! root\nalt_id: HP:9\n\n[Term]\nid: HP:2\nname: two\nis_obsolete: true\nreplaced_by: HP:1\n')
    rows = {r.term_id: r for r in readers.read_obo(spark, str(tmp_path / "o.obo")).collect()}
    assert rows["HP:1"].synonyms == ['a "b" c'] and rows["HP:1"].is_a == ["HP:0"] and rows["HP:2"].replaced_by == "HP:1"
    (tmp_path / "m.obo").write_text('[Term]\nid: MONDO:1\nname: x\nsubset: gard_rare {a="b"}\nxref: OMIM:5 {source="MONDO:equivalentTo"}\nxref: Z:1 {source="other"}\nsynonym: "y" RELATED []\n')
    m = readers.read_disease_obo(spark, str(tmp_path / "m.obo")).first()
    assert m.is_rare and m.equivalent_ids == ["OMIM:5"] and m.synonyms[0].type == "RELATED"
    (tmp_path / "p.json").write_text(json.dumps([[["HP:1"], ["OMIM:1"]], [[], ["x"]], [["HP:2", "HP:3"], ["OMIM:2"]]]))
    got = readers.read_patients(spark, str(tmp_path / "p.json"))
    assert [(r.patient_id, r.terms) for r in got.orderBy("patient_id").collect()] == [(1, ["HP:1"]), (2, ["HP:2", "HP:3"])]
    assert readers.sample_select(got, "1-7").count() == 1
    (tmp_path / "c.jsonl").write_text('{"Phenotype":["HP:1"],"RareDisease":["OMIM:1"],"Department":null}\nnot json\n')
    assert readers.read_case_library(spark, str(tmp_path / "c.jsonl")).count() == 1
    (tmp_path / "h.tsv").write_text("#note\n" + "\t".join(readers.ANNOTATION_COLUMNS) + "\n" + "\t".join(["OMIM:1", "x", "NOT", "HP:1"] + ["a"] * 8) + "\n")
    assert readers.read_annotation_tsv(spark, str(tmp_path / "h.tsv")).first().qualifier == "NOT"
    (tmp_path / "d.json").write_text(json.dumps({"HP:1": [0.5, 1.0]}))
    assert readers.read_json_dict(spark, str(tmp_path / "d.json"), "array<double>").first().value == [0.5, 1.0]
    (tmp_path / "e.csv").write_text('node_type,id,embedding\nphenotype,HP:1,"0.5,1"\nphenotype,HP:2,"x,1"\ngene,G:1,"1,1"\n')
    assert [r.term_id for r in readers.read_embedding_csv(spark, str(tmp_path / "e.csv")).collect()] == ["HP:1"]
    tree = "<JDBOR><ClassificationList><Classification><Name>Orphanet classification of eyes</Name><ClassificationNodeRootList><ClassificationNode>{}<ClassificationNodeChildList><ClassificationNode>{}</ClassificationNode></ClassificationNodeChildList></ClassificationNode></ClassificationNodeRootList></Classification></ClassificationList></JDBOR>"
    node = "<Disorder><OrphaCode>{}</OrphaCode><Name>{}</Name><DisorderType><Name>{}</Name></DisorderType></Disorder>"
    (tmp_path / "t.xml").write_text(tree.format(node.format(1, "Top", "Category"), node.format(2, "Low", "Disease")))
    got = {r.disease_id: r for r in readers.read_xml_classification(spark, str(tmp_path / "t.xml")).collect()}
    assert got["ORPHA:2"].category == "Top" and got["ORPHA:1"].category is None and got["ORPHA:2"].classification == "eyes"


def test_case_library_and_files(spark, tmp_path):
    a = spark.createDataFrame([(2, 7), (2, 8), (3, 9)], "disease_id int, term_id int")
    g = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4)], "disease_id int, group_id int")
    lib = sinks.case_library(a, g)
    assert [(r.group_id, r.terms, r.diseases) for r in lib.collect()] == [(1, [7, 8], [1, 2, 3])]
    sinks.write_jsonl(lib, str(tmp_path / "lib"))
    assert spark.read.json(str(tmp_path / "lib")).count() == 1


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5), (1, 6), (2, 5)], "patient_id int, term_id int")
    rows.write.parquet(str(tmp_path / "in"))
    rank = lambda df: df.groupBy("patient_id").agg(F.count("*").alias("n"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    ranks.stream_rank(stream, rank, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(spark.read.parquet(str(tmp_path / "out")).select("patient_id", "n").collect()) == sorted(rank(rows).collect())
