"""Sources and sinks: a given table is written in a file format of the domain and read back by its reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import frequency
from ..operators import evaluate, likelihood, ontology, resolve
from ..operators.lineage import cut, new_path
from ..sources import readers, sinks
from ..streaming import ranks
from . import more_queries
from .fixture import Fixture
from .queries import query

_text = lambda c: F.col(c).cast("string")
_joined = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), "|")


def _hp(c: str):
    return F.concat(F.lit("HP:"), _text(c))


@query("S01_read_obo", "SELECT 'HP:' || p_partkey AS term_id, p_name AS name, p_brand || ' \"' || p_size || '\"|' || p_type AS synonyms, p_type AS definition, 'HP:' || (p_partkey // 3) || CASE WHEN p_partkey % 5 = 0 THEN '|HP:' || (p_partkey // 7) ELSE '' END AS is_a, CASE WHEN p_partkey % 4 = 1 THEN 'HP:9' || p_partkey ELSE '' END AS alt_ids, p_partkey % 9 = 2 AS is_obsolete, CASE WHEN p_partkey % 9 = 2 THEN 'HP:' || (p_partkey + 1) END AS replaced_by FROM part")
def _(x: Fixture):
    k, line = F.col("p_partkey"), lambda tag, *parts: F.concat(F.lit(f"\n{tag}: "), *[p if not isinstance(p, str) else F.lit(p) for p in parts])
    up = lambda n: F.floor(k / n).cast("string")
    stanza = F.concat(
        F.lit("[Term]"), line("id", _hp("p_partkey")), line("name", F.col("p_name")), F.when(k % 4 == 1, line("alt_id", "HP:9", _text("p_partkey"))).otherwise(""), line("def", '"', F.col("p_type"), '" [src:1]'),
        line("synonym", '"', F.col("p_brand"), ' "', _text("p_size"), '"" EXACT []'), line("synonym", '"', F.col("p_type"), '" RELATED []'), line("is_a", "HP:", up(3), " ! parent"), F.when(k % 5 == 0, line("is_a", "HP:", up(7), " ! other")).otherwise(""),
        F.when(k % 9 == 2, F.concat(line("is_obsolete", "true"), line("replaced_by", "HP:", (k + 1).cast("string")))).otherwise(""), F.lit("\n"))
    path = new_path(x.spark)
    x.table("part").select(stanza).write.text(path)
    return readers.read_obo(x.spark, path).select("term_id", "name", _joined("synonyms").alias("synonyms"), "definition", _joined("is_a").alias("is_a"), _joined("alt_ids").alias("alt_ids"), "is_obsolete", "replaced_by")


@query("S02_read_disease_obo", "SELECT 'MONDO:' || s_suppkey AS disease_id, s_name AS name, s_name || ' disease EXACT|no. ' || s_nationkey || ' RELATED' AS synonyms, 'OMIM:' || (s_suppkey + 7) AS equivalent_ids, s_suppkey % 3 = 0 OR s_suppkey % 5 = 1 AS is_rare, 'MONDO:' || (s_suppkey // 2) AS parents FROM supplier WHERE s_suppkey % 10 <> 4")
def _(x: Fixture):
    k, line = F.col("s_suppkey"), lambda tag, *parts: F.concat(F.lit(f"\n{tag}: "), *[p if not isinstance(p, str) else F.lit(p) for p in parts])
    stanza = F.concat(
        F.lit("[Term]"), line("id", F.when(k % 10 == 4, "OTHER:").otherwise("MONDO:"), _text("s_suppkey")), line("name", F.col("s_name")), line("subset", F.when(k % 3 == 0, "gard_rare").when(k % 5 == 1, "rare_grouping").otherwise("rarely_seen"), ' {source="a"}'),
        line("synonym", '"', F.col("s_name"), ' disease" EXACT []'), line("synonym", '"no. ', _text("s_nationkey"), '" RELATED []'), line("xref", "OMIM:", (k + 7).cast("string"), ' {source="MONDO:equivalentTo"}'), line("xref", 'UMLS:1 {source="other"}'),
        line("is_a", "MONDO:", F.floor(k / 2).cast("string"), ' {source="b"} ! x'), F.lit("\n"))
    path = new_path(x.spark)
    x.table("supplier").select(stanza).write.text(path)
    return readers.read_disease_obo(x.spark, path).select("disease_id", "name", F.array_join(F.transform("synonyms", lambda s: F.concat(s["name"], F.lit(" "), s["type"])), "|").alias("synonyms"), _joined("equivalent_ids").alias("equivalent_ids"), "is_rare", _joined("parents").alias("parents"))


@query("S06_read_annotation_tsv", "SELECT 'OMIM:' || disease_id AS database_id, 'HP:' || term_id AS hpo_id, qualifier, frequency, source AS reference, l AS line FROM ann_rows")
def _(x: Fixture):
    empty = [F.lit("").alias(c) for c in ("evidence", "onset")]
    rows = x.annotation_rows.select(F.concat(F.lit("OMIM:"), _text("disease_id")).alias("database_id"), F.concat(F.lit("d"), _text("disease_id")).alias("disease_name"), "qualifier", _hp("term_id").alias("hpo_id"), F.col("source").alias("reference"), *empty, "frequency", F.lit("").alias("sex"), _text("l").alias("modifier"), F.lit("P").alias("aspect"), F.lit("x").alias("biocuration"))
    path = new_path(x.spark)
    rows.write.option("sep", "\t").option("header", True).csv(path)
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return readers.read_annotation_tsv(x.spark, path).select("database_id", "hpo_id", blank("qualifier"), blank("frequency"), "reference", F.col("modifier").cast("long").alias("line"))


_genes = "SELECT gene_id, term_id, disease_id FROM gene"


def _gene_file(x: Fixture, *columns):
    path = new_path(x.spark)
    x.gene.select(*columns).write.option("sep", "\t").option("header", True).csv(path)
    return path


@query("S07_read_phenotype_to_genes", f"SELECT 'HP:' || term_id AS hpo_id, CAST(gene_id AS VARCHAR) AS ncbi_gene_id, 'OMIM:' || disease_id AS disease_id FROM ({_genes}) WHERE disease_id % 6 > 1")
def _(x: Fixture):
    d = F.when(F.col("disease_id") % 6 == 0, "-").when(F.col("disease_id") % 6 == 1, " ").otherwise(F.concat(F.lit("OMIM:"), _text("disease_id")))
    path = _gene_file(x, _hp("term_id").alias("hpo_id"), F.lit("n").alias("hpo_name"), _text("gene_id").alias("ncbi_gene_id"), F.lit("g").alias("gene_symbol"), d.alias("disease_id"))
    return readers.read_phenotype_to_genes(x.spark, path).select("hpo_id", "ncbi_gene_id", "disease_id")


@query("S08_read_genes_to_phenotype", f"SELECT 'g' || gene_id AS gene_symbol, 'HP:' || term_id AS hpo_id, 'OMIM:' || disease_id AS disease_id FROM ({_genes}) WHERE term_id % 4 <> 1 AND gene_id % 7 <> 2")
def _(x: Fixture):
    term = F.concat(F.when(F.col("term_id") % 4 == 1, "XX:").otherwise("HP:"), _text("term_id"))
    symbol = F.when(F.col("gene_id") % 7 == 2, " ").otherwise(F.concat(F.lit("g"), _text("gene_id")))
    path = _gene_file(x, _text("gene_id").alias("ncbi_gene_id"), symbol.alias("gene_symbol"), term.alias("hpo_id"), F.lit("n").alias("hpo_name"), F.lit("1/2").alias("frequency"), F.concat(F.lit("OMIM:"), _text("disease_id")).alias("disease_id"))
    return readers.read_genes_to_phenotype(x.spark, path).select("gene_symbol", "hpo_id", "disease_id")


@query("S09_read_genes_to_disease", f"SELECT DISTINCT CAST(gene_id AS VARCHAR) AS ncbi_gene_id, 'OMIM:' || disease_id AS disease_id FROM ({_genes}) WHERE disease_id % 8 <> 3")
def _(x: Fixture):
    d = F.when(F.col("disease_id") % 8 != 3, F.concat(F.lit("OMIM:"), _text("disease_id")))
    path = _gene_file(x, F.concat(F.lit("NCBIGene:"), _text("gene_id")).alias("ncbi_gene_id"), F.lit("g").alias("gene_symbol"), F.lit("MENDELIAN").alias("association_type"), d.alias("disease_id"), F.lit("s").alias("source"))
    return readers.read_genes_to_disease(x.spark, path).select(F.replace("ncbi_gene_id", F.lit("NCBIGene:"), F.lit("")).alias("ncbi_gene_id"), "disease_id").distinct()


_sets = "SELECT {k} AS id, string_agg(DISTINCT 'HP:' || term_id, '|' ORDER BY 'HP:' || term_id) AS terms, string_agg(DISTINCT 'OMIM:' || disease_id, '|' ORDER BY 'OMIM:' || disease_id) AS diseases FROM case_rows GROUP BY 1"


def _cases(x: Fixture):
    some = lambda c, p: F.array_sort(F.transform(c, lambda v: F.concat(F.lit(p), v.cast("string"))))
    return x.cases.select("case_id", some("terms", "HP:").alias("terms"), some("diseases", "OMIM:").alias("diseases"))


@query("S10_read_case_library", f"SELECT id AS case_id, terms, diseases FROM ({_sets.format(k='case_id')}) WHERE id % 11 <> 4")
def _(x: Fixture):
    row = F.to_json(F.struct(F.col("terms").alias("Phenotype"), F.col("diseases").alias("RareDisease"), _text("case_id").alias("Department")))
    path = new_path(x.spark)
    _cases(x).select(F.when(F.col("case_id") % 11 == 4, F.substring(row, 1, 20)).otherwise(row)).write.text(path)  # every eleventh line is cut off
    return readers.read_case_library(x.spark, path).select(F.col("department").cast("long").alias("case_id"), _joined("terms").alias("terms"), _joined("diseases").alias("diseases"))


@query("S11_read_patients", f"SELECT terms, diseases, count(*) AS n FROM ({_sets.format(k='case_id')}) WHERE id % 5 <> 2 GROUP BY 1, 2")
def _(x: Fixture):
    path = new_path(x.spark)
    pair = F.array("terms", F.when(F.col("case_id") % 5 == 2, F.array().cast("array<string>")).otherwise(F.col("diseases")))
    sinks.write_json(_cases(x).select(pair.alias("p")), path, None, "p")
    return readers.read_patients(x.spark, path).groupBy(_joined("terms").alias("terms"), _joined("true_diseases").alias("diseases")).agg(F.countDistinct("patient_id").alias("n"))


@query("S12_sample_select", "SELECT c_custkey AS patient_id FROM customer WHERE c_custkey - 1 IN (0, 5, 6, 7, 10)")
def _(x: Fixture):
    return readers.sample_select(x.table("customer").select(F.col("c_custkey").alias("patient_id")), "10,0,5-7,6,999999999-1000000001")


@query("S14_read_embedding_csv", "SELECT 'HP:' || vec_id AS term_id, round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))), 5) AS total, len(embedding) AS n FROM embeddings WHERE vec_id % 3 <> 1 AND vec_id % 10 <> 9")
def _(x: Fixture):
    e = x.table("embeddings")
    kind = F.when(F.col("vec_id") % 3 == 1, "G:").otherwise("HP:")
    values = F.transform("embedding", lambda v: v.cast("string"))
    bad = F.when(F.col("vec_id") % 10 == 9, F.concat(values, F.array(F.lit("x")))).otherwise(values)
    path = new_path(x.spark)
    e.select(F.lit("phenotype").alias("node_type"), F.concat(kind, _text("vec_id")).alias("id"), F.array_join(bad, ",").alias("embedding")).write.option("header", True).csv(path)
    total = F.aggregate("v", F.lit(0.0), lambda a, v: a + v.cast("double"))
    return readers.read_embedding_csv(x.spark, path).select("term_id", F.round(total, 5).alias("total"), F.size("v").cast("long").alias("n"))


@query("S15_read_json_dict", "SELECT 'HP:' || vec_id || ', \"x\": {' AS key, round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))), 5) AS total, len(embedding) AS n FROM embeddings")
def _(x: Fixture):
    path = new_path(x.spark)
    rows = x.table("embeddings").select(F.concat(_hp("vec_id"), F.lit(', "x": {')).alias("k"), F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    sinks.write_json(rows, path, "k", "v")
    total = F.aggregate("value", F.lit(0.0), lambda a, v: a + v)
    return readers.read_json_dict(x.spark, path, "array<double>").select("key", F.round(total, 5).alias("total"), F.size("value").cast("long").alias("n"))


@query("S16_read_descriptions", "SELECT CAST(doc_id AS VARCHAR) AS disease_id, md5(text) AS digest FROM documents WHERE text IS NOT NULL AND doc_id % 6 <> 5")
def _(x: Fixture):
    path = new_path(x.spark)
    text = F.when(F.col("doc_id") % 6 != 5, F.col("text"))
    sinks.write_json(x.table("documents").select("doc_id", F.struct(text.alias("description"), F.lit("s").alias("source")).alias("v")), path, "doc_id", "v", "results")
    return readers.read_descriptions(x.spark, path).select("disease_id", F.md5("description").alias("digest"))


@query("S17_read_categorization_csv", "SELECT 'ORPHA:' || p_partkey AS disease_id, p_name AS name, p_brand || '/' || p_type AS categories FROM part")
def _(x: Fixture):
    path = new_path(x.spark)
    x.table("part").select(_text("p_partkey").alias("OrphaNumber"), F.col("p_name").alias("Disorder_Name"), F.concat("p_brand", F.lit("|"), "p_type").alias("Category")).write.option("header", True).csv(path)
    return readers.read_categorization_csv(x.spark, path).select("disease_id", "name", F.array_join("categories", "/").alias("categories"))


@query("S18_read_disease_ontology_json", "SELECT e AS disease_id, unnest([s_name, s_name || ' disease']) AS alias, unnest(range(2)) AS pos FROM (SELECT s_name, unnest(['ORPHA:' || s_suppkey, 'OMIM:' || s_nationkey]) AS e FROM supplier)")
def _(x: Fixture):
    named = lambda n, t: F.struct(n.alias("name"), F.lit(t).alias("type"))
    v = F.struct(F.col("s_name").alias("name"), F.array(named(F.concat("s_name", F.lit(" x")), "RELATED"), named(F.concat("s_name", F.lit(" disease")), "EXACT")).alias("synonyms"), F.array(F.concat(F.lit("Orphanet:"), _text("s_suppkey")), F.concat(F.lit("OMIM:"), _text("s_nationkey")), F.lit("UMLS:1")).alias("equivalent_ids"))
    path = new_path(x.spark)
    sinks.write_json(x.table("supplier").select(F.concat(F.lit("MONDO:"), _text("s_suppkey")).alias("k"), v.alias("v")), path, "k", "v")
    return readers.read_disease_ontology_json(x.spark, path).select("disease_id", "alias", F.col("pos").cast("long").alias("pos"))


@query("S19_read_alt_names_json", "SELECT CAST(s_suppkey AS VARCHAR) AS disease_id, a AS alias FROM (SELECT s_suppkey, unnest([s_name, 'n ' || s_nationkey]) AS a FROM supplier)")
def _(x: Fixture):
    v = F.struct(F.col("s_name").alias("ENG_NAME"), F.concat(F.lit("n "), _text("s_nationkey"), F.lit(" ;; ;;MOVED TO 7;;Removed from database")).alias("ALT_NAME"))
    path = new_path(x.spark)
    sinks.write_json(x.table("supplier").select(_text("s_suppkey").alias("k"), v.alias("v")), path, "k", "v")
    return readers.read_alt_names_json(x.spark, path).select("disease_id", "alias")


@query("S20_read_predictions", "SELECT doc_id AS sample_id, md5(text) AS digest FROM documents WHERE text IS NOT NULL")
def _(x: Fixture):
    d = x.table("documents").where("text is not null")
    one, other = new_path(x.spark), new_path(x.spark)
    item = F.struct(F.col("doc_id").alias("sample_id"), "text").alias("s")
    sinks.write_json(d.where("doc_id % 2 = 0").select(item), one, None, "s")
    sinks.write_json(d.where("doc_id % 2 <> 0").select(item), other, None, "s", "samples")
    rows = readers.read_predictions(x.spark, one).unionByName(readers.read_predictions(x.spark, other))
    return rows.select("sample_id", F.md5("text").alias("digest"))


@query("K07_ic_dictionary", "SELECT CAST(term_id AS VARCHAR) AS key, round(ic, 6) + 0.0 AS value FROM ic")
def _(x: Fixture):
    path = new_path(x.spark)
    sinks.write_json(x.ic, path, "term_id", "ic")
    return readers.read_json_dict(x.spark, path, "double").select("key", (F.round("value", 6) + 0.0).alias("value"))


@query("K08_classification_files", "SELECT 'ORPHA:' || p_size AS disease_id, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS categories, string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) AS names FROM part GROUP BY 1")
def _(x: Fixture):
    path = new_path(x.spark)
    rows = x.table("part").select(F.concat(F.lit("ORPHA:"), _text("p_size")).alias("disease_id"), F.col("p_brand").alias("name"), F.lit("Disease").alias("disorder_type"), F.col("p_name").alias("classification"), F.col("p_type").alias("category"))
    sinks.write_classification(rows, path)
    csv = readers.read_categorization_csv(x.spark, f"{path}/csv").select("disease_id", _joined("categories").alias("categories"))
    held = readers.read_json_dict(x.spark, f"{path}/json", "struct<name:array<string>,category:array<string>>").select(F.col("key").alias("disease_id"), _joined("value.name").alias("names"))
    return csv.join(held, "disease_id")


def _in_two_runs(x: Fixture, rows, at, run) -> str:
    """Feeds ``rows`` to a stream in two parts, by whether ``at`` holds; the second run starts from the first one's checkpoint."""
    source, out, checkpoint = (new_path(x.spark) for _ in range(3))
    for part in (rows.where(at), rows.where(~at)):
        part.repartition(3).write.mode("append").parquet(source)
        run(x.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source), out, checkpoint).awaitTermination()
    return out


@query("K09_running_results", "SELECT patient_id, rank, hit FROM best", more_queries.base._truth)
def _(x: Fixture):
    rows = cut(evaluate.best_match_rank(more_queries.base._pairs(x)).select("patient_id", "rank", "hit"))
    out = _in_two_runs(x, rows, F.col("patient_id") % 3 == 0, ranks.running_results)
    return ranks.collected(x.spark, out, rows.schema)


@query("ST01_running_counters", "SELECT rank, count(*) AS n, count(*) FILTER (WHERE hit) AS hits FROM best GROUP BY 1", more_queries.base._truth)
def _(x: Fixture):
    rows = cut(evaluate.best_match_rank(more_queries.base._pairs(x)).select("patient_id", "rank", "hit"))
    out = _in_two_runs(x, rows, F.col("patient_id") % 3 == 0, ranks.running_counters)
    return ranks.counters(x.spark, out, rows.schema["rank"].dataType.simpleString())


@query("ST02_intake", "SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL")
def _(x: Fixture):
    rows = x.table("events").select("user_id")
    out = _in_two_runs(x, rows, F.col("user_id") % 2 == 0, lambda s, o, c: ranks.stream_intake(s, "user_id", o, c))
    return ranks.taken_in(x.spark, out, rows.schema)


_shares = "CASE l % 7 WHEN 0 THEN NULL WHEN 1 THEN 'Excluded (0%)' WHEN 2 THEN 'VERY RARE (<4-1%)' WHEN 3 THEN 'rare' WHEN 4 THEN ' Very frequent (99-80%)' WHEN 5 THEN '3/7' ELSE 'Obligate' END"


@query("I03_orphanet_annotations", """SELECT 'ORPHA:' || disease_id AS disease_id, 'HP:' || term_id || '/' || o AS term_id, CASE l % 7 WHEN 0 THEN '' WHEN 2 THEN 'HP:0040284' WHEN 3 THEN 'HP:0040284' WHEN 4 THEN 'HP:0040281' WHEN 5 THEN '3/7' ELSE 'HP:0040280' END AS frequency,
  CASE l % 7 WHEN 0 THEN 'empty' WHEN 5 THEN 'fraction' ELSE 'hpo_id' END AS frequency_type FROM ann_rows WHERE l % 7 <> 1 AND o % 10 <> 3 AND o % 10 <> 4""")
def _(x: Fixture):
    code = F.when(F.col("o") % 10 == 3, "nan").otherwise(_text("disease_id"))
    term = F.when(F.col("o") % 10 == 4, F.lit(" ")).otherwise(F.concat(_hp("term_id"), F.lit("/"), _text("o")))
    rows = x.annotation_rows.select(code.alias("orpha_code"), term.alias("term_id"), F.expr(_shares).alias("frequency_label"))
    return resolve.orphanet_annotations(rows).drop("source")


@query("F06_every_row", "SELECT o, l, CASE frequency " + " ".join(f"WHEN '{c}' THEN '{v[1]}/{v[2]}/{v[3]}'" for c, v in frequency.CODES.items()) + " END AS interval_text FROM ann_rows")
def _(x: Fixture):
    return x.annotation_rows.select("o", "l", F.array_join(F.transform(frequency.freq_interval(F.col("frequency")), lambda v: v.cast("string")), "/").alias("interval_text"))


@query("I07_annotations_of_groups", "SELECT g.disease_id, whole.term_id, whole.frequency, whole.frequency_type, whole.source, count(*) OVER (PARTITION BY g.disease_id) AS n_terms FROM grp g JOIN whole USING (group_id)",
       {"texts": "SELECT group_id, disease_id, term_id, string_agg(f, '; ' ORDER BY n) AS f, string_agg(CASE WHEN regexp_matches(f, '^\\d+/\\d+$') THEN 'fraction' WHEN regexp_matches(f, '^\\d+%$') THEN 'percentage' WHEN f LIKE 'HP:%' THEN 'hpo_id' ELSE 'other' END, '; ' ORDER BY n) AS t FROM (SELECT disease_id, term_id, frequency AS f, min((o, l)) AS n FROM ann_rows WHERE qualifier <> 'NOT' AND frequency <> '' GROUP BY 1, 2, 3) JOIN grp USING (disease_id) GROUP BY 1, 2, 3",
        "origins": "SELECT group_id, term_id, string_agg(source, '; ' ORDER BY n) AS source FROM (SELECT group_id, term_id, source, min((disease_id, o, l)) AS n FROM ann_rows JOIN grp USING (disease_id) WHERE qualifier <> 'NOT' GROUP BY 1, 2, 3) GROUP BY 1, 2",
        "whole": "SELECT group_id, term_id, coalesce(string_agg(f, '; ' ORDER BY disease_id), '') AS frequency, CASE WHEN bool_or(t LIKE '%hpo_id%') THEN 'hpo_id' ELSE coalesce(string_agg(t, '; ' ORDER BY disease_id), '') END AS frequency_type, any_value(source) AS source FROM origins LEFT JOIN texts USING (group_id, term_id) GROUP BY 1, 2"})
def _(x: Fixture):
    return resolve.annotations_of_groups(x.merged, x.groups)


@query("I10_type_of_namesakes", "WITH s AS (SELECT s_suppkey AS i, CASE WHEN s_suppkey % 2 = 0 THEN 'Name ' ELSE 'NAME ' END || (s_suppkey % 7) AS name, CASE WHEN s_suppkey % 5 = 0 THEN 'type' || s_suppkey END AS t FROM supplier) SELECT s.i AS disease_id, coalesce(s.t, f.t) AS disease_type FROM s LEFT JOIN (SELECT lower(name) AS n, arg_min(t, i) AS t FROM s WHERE t IS NOT NULL GROUP BY 1) f ON f.n = lower(s.name)")
def _(x: Fixture):
    k, i = F.col("s_suppkey"), F.col("s_suppkey").alias("disease_id")
    named = x.table("supplier").select(i, F.concat(F.when(k % 2 == 0, "Name ").otherwise("NAME "), (k % 7).cast("string")).alias("name"))
    typed = x.table("supplier").select(i, F.when(k % 5 == 0, F.concat(F.lit("type"), k.cast("string"))).alias("disease_type"))
    return resolve.type_of_namesakes(named, typed)


@query("O08_closest_or_root", "SELECT t.term_id, t.disease_id, coalesce(c5.a, 0) AS ancestor_id, round(coalesce(c5.f, 1.0), 6) AS f FROM (SELECT DISTINCT q.term_id, s_suppkey AS disease_id FROM q, supplier WHERE s_suppkey % 7 = q.term_id % 7) t LEFT JOIN c5 USING (term_id, disease_id)")
def _(x: Fixture):
    model, _absent = likelihood.lr_models(x.annotation_rows)
    mine = ontology.with_self(x.closure, x.term)
    pairs = x.query.select("term_id").distinct().withColumn("r", F.col("term_id") % 7).join(x.table("supplier").select(F.col("s_suppkey").alias("disease_id"), (F.col("s_suppkey") % 7).alias("r")).hint("merge"), "r")
    return ontology.closest_or_root(pairs, mine, cut(likelihood.induced_frequency(model, mine, 0)), 0).withColumn("f", F.round("f", 6))


@query("R03_group_posterior", "SELECT m.patient_id, m.disease_id, round(coalesce(h.posterior, og.p, 0), 6) AS posterior FROM (SELECT DISTINCT patient_id, disease_id FROM matches) m JOIN grp USING (disease_id) LEFT JOIN own_post h USING (patient_id, disease_id) LEFT JOIN group_post og USING (patient_id, group_id)",
       more_queries._vec | {"own_post": "SELECT patient_id, disease_id, posterior FROM post WHERE disease_id % 4 <> 1", "group_post": "SELECT patient_id, group_id, arg_min(posterior, disease_id) AS p FROM own_post JOIN grp USING (disease_id) GROUP BY 1, 2"})
def _(x: Fixture):
    model = likelihood.lr_models(x.annotation_rows)
    found = likelihood.group_posteriors(more_queries.base._matches(x), x.query, *model, x.edge, lambda: x.closure, 0, x.groups, F.col("disease_id") % 4 != 1)
    return found.withColumn("posterior", F.round("posterior", 6))


def _graph(x: Fixture) -> dict:
    """The graph's files, written from the given tables, and read back."""
    path = new_path(x.spark)
    out = lambda df, name: df.select(*[(F.col(c).cast("string") if c in df.columns else F.lit("")).alias(c) for c in readers.GRAPH_FILES[name]]).write.option("header", True).option("escape", '"').csv(f"{path}/{name}")
    d = lambda c: F.concat(F.lit("D:"), _text(c))
    s = x.table("supplier")
    out(s.select(d("s_suppkey").alias("ID"), F.col("s_name").alias("standard_name"), F.concat(F.lit("a, "), _text("s_nationkey"), F.lit("; ; b")).alias("synonyms"), F.when(F.col("s_suppkey") % 3 == 0, "t").alias("disease_type"), F.when(F.col("s_suppkey") % 2 == 0, "No disease description found.").otherwise(F.concat(F.lit('says "'), "s_name", F.lit('"'))).alias("description")), "disease_nodes.csv")
    out(x.groups.select(d("group_id").alias("sourceID"), F.concat(F.lit("OMIM:"), _text("disease_id")).alias("targetID")), "disease_to_publicDisease_edges.csv")
    shown = F.when(F.col("freq").isNull(), "n/a").otherwise(F.format_string("%.4f", "freq"))
    out(x.annotation.join(x.groups, "disease_id").groupBy("group_id", "term_id").agg(F.max("freq").alias("freq")).select(d("group_id").alias("sourceID"), _hp("term_id").alias("targetID"), shown.alias("frequency_max")), "disease_to_phenotype_edges.csv")
    ic = x.ic.where("term_id % 3 <> 0").select(_hp("term_id").alias("ID"), F.when(F.col("term_id") % 3 == 1, F.col("ic")).alias("IC"))
    out(ic, "phenotype_nodes.csv")
    sinks.write_json(x.ic.where("term_id % 2 = 0").select(_hp("term_id").alias("k"), F.when(F.col("term_id") % 10 != 0, (F.col("ic") + 100).cast("string")).otherwise("x").alias("v")), f"{path}/ic_dict_recomputed.json", "k", "v")
    out(x.edge.select(_hp("child").alias("sourceID"), _hp("parent").alias("targetID"), F.when(F.col("child") % 6 == 5, "phenotype_exact").otherwise("is_a").alias("relationship")), "phenotype_to_phenotype_edges.csv")
    return readers.read_kg(x.spark, path)


@query("S13_read_kg_annotations", "SELECT 'OMIM:' || g.disease_id AS disease_id, 'HP:' || a.term_id AS term_id, round(a.freq, 3) AS freq FROM grp g JOIN (SELECT group_id, term_id, max(freq) AS freq FROM ann JOIN grp USING (disease_id) GROUP BY 1, 2) a USING (group_id)")
def _(x: Fixture):
    return _graph(x)["annotation"].withColumn("freq", F.round("freq", 3))


@query("S13_read_kg_terms", "SELECT 'HP:' || term_id AS term_id, round(CASE WHEN term_id % 2 = 0 AND term_id % 10 <> 0 THEN ic + 100 WHEN term_id % 3 = 1 THEN ic END, 5) + 0.0 AS ic FROM ic WHERE term_id % 3 <> 0 OR (term_id % 2 = 0 AND term_id % 10 <> 0)")
def _(x: Fixture):
    return _graph(x)["term"].select("term_id", (F.round("ic", 5) + 0.0).alias("ic"))


@query("S13_read_kg_diseases", "SELECT 'D:' || s_suppkey AS disease_id, s_name AS name, s_name || '|a, ' || s_nationkey || '|b' AS names, CASE WHEN s_suppkey % 3 = 0 THEN 't' END AS disease_type, CASE WHEN s_suppkey % 2 = 1 THEN 'says \"' || s_name || '\"' END AS description FROM supplier")
def _(x: Fixture):
    return _graph(x)["disease"].withColumn("names", F.array_join("names", "|"))


@query("S13_read_kg_edges", "SELECT 'HP:' || child AS child, 'HP:' || parent AS parent FROM edge WHERE child % 6 <> 5")
def _(x: Fixture):
    return _graph(x)["term_edge"]


@query("K04_public_links", "SELECT id AS ID, s_name AS standard_name, CASE s_suppkey % 3 WHEN 0 THEN 'https://www.omim.org/entry/' || s_suppkey WHEN 1 THEN 'https://www.orpha.net/en/disease/detail/' || s_suppkey ELSE '' END AS link FROM (SELECT *, ['OMIM:', 'ORPHA:', 'DECIPHER:'][s_suppkey % 3 + 1] || s_suppkey AS id FROM supplier)")
def _(x: Fixture):
    kind = F.element_at(F.array(F.lit("OMIM:"), F.lit("ORPHA:"), F.lit("DECIPHER:")), (F.col("disease_id") % 3 + 1).cast("int"))
    return sinks.public_disease_nodes(x.alias.withColumn("disease_id", F.concat(kind, _text("disease_id"))))


def _named(c):
    return F.struct(c.alias("Name"))


@query("S03_read_disorder_phenotypes", "SELECT 'ORPHA:' || disease_id AS disease_id, 'HP:' || term_id AS term_id, 'type ' || (disease_id % 4) AS disorder_type, 'group ' || (disease_id % 3) AS disorder_group, CASE WHEN disease_id % 2 = 0 THEN 'y' ELSE 'n' END AS validation_status, CASE WHEN term_id % 2 = 0 THEN 'Frequent' ELSE 'Very rare' END AS frequency_label, CASE WHEN term_id % 5 = 0 THEN 'Criterion' END AS criterion FROM ann")
def _(x: Fixture):
    d, t = F.col("disease_id"), F.col("term_id")
    link = F.struct(F.struct(_hp("term_id").alias("HPOId"), F.lit("n").alias("HPOTerm")).alias("HPO"), _named(F.when(t % 2 == 0, "Frequent (79-30%)").otherwise("Very rare (<4-1%)")).alias("HPOFrequency"), F.when(t % 5 == 0, _named(F.lit("Criterion"))).alias("DiagnosticCriteria"))
    per = x.annotation.select("disease_id", link.alias("l")).groupBy("disease_id").agg(F.collect_list("l").alias("l"))
    disorder = F.struct(d.alias("OrphaCode"), F.lit("n").alias("Name"), _named(F.concat(F.lit("type "), (d % 4).cast("string"))).alias("DisorderType"), _named(F.concat(F.lit("group "), (d % 3).cast("string"))).alias("DisorderGroup"), F.struct(F.col("l").alias("HPODisorderAssociation")).alias("HPODisorderAssociationList"))
    path = new_path(x.spark)
    per.select(disorder.alias("Disorder"), F.lit("s").alias("Source"), F.when(d % 2 == 0, "y").otherwise("n").alias("ValidationStatus")).write.format("xml").option("rowTag", "HPODisorderSetStatus").option("indent", "").save(path)
    return readers.read_xml_disorder_phenotypes(x.spark, path).select("disease_id", "term_id", "disorder_type", "disorder_group", "validation_status", "frequency_label", "criterion")


@query("S04_read_alignment", "SELECT 'ORPHA:' || s_suppkey AS disease_id, 'a|b' || s_nationkey AS synonyms, CASE WHEN s_suppkey % 3 = 0 THEN 'Obsolete' ELSE 'Active' END || '|Head' AS flags, unnest(['OMIM', 'ICD-10']) AS source, unnest(['o' || s_suppkey, 'i' || s_suppkey]) AS reference, unnest(['E', 'NTBT']) AS relation, unnest([NULL, 'Specific code']) AS icd_relation, 'Validated' AS validation_status FROM supplier")
def _(x: Fixture):
    k = F.col("s_suppkey")
    ref = lambda source, number, relation, icd: F.struct(F.lit(source).alias("Source"), F.concat(F.lit(number), k.cast("string")).alias("Reference"), _named(F.lit(relation)).alias("DisorderMappingRelation"), (_named(F.lit(icd)) if icd else F.lit(None).cast("struct<Name:string>")).alias("DisorderMappingICDRelation"), _named(F.lit("Validated")).alias("DisorderMappingValidationStatus"))
    flag = lambda c: F.struct(F.lit("1").alias("Value"), c.alias("Label"))
    path = new_path(x.spark)
    x.table("supplier").select(
        k.alias("OrphaCode"), F.col("s_name").alias("Name"), F.struct(F.array(flag(F.when(k % 3 == 0, "Obsolete").otherwise("Active")), flag(F.lit("Head"))).alias("DisorderFlag")).alias("DisorderFlagList"), F.struct(F.array(F.lit("a"), F.concat(F.lit("b"), _text("s_nationkey"))).alias("Synonym")).alias("SynonymList"),
        F.struct(F.array(ref("OMIM", "o", "E", None), ref("ICD-10", "i", "NTBT", "Specific code")).alias("ExternalReference")).alias("ExternalReferenceList")).write.format("xml").option("rowTag", "Disorder").save(path)
    return readers.read_xml_alignment(x.spark, path).select("disease_id", _joined("synonyms").alias("synonyms"), _joined("flags").alias("flags"), "source", "reference", "relation", "icd_relation", "validation_status")
