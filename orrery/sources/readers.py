"""Files of the domain as DataFrames, with declared schemas."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.kg import numbered
from ..operators.resolve import given_to_ids
from .large_json import entries

ANNOTATION_COLUMNS = ("database_id", "disease_name", "qualifier", "hpo_id", "reference", "evidence", "onset", "frequency", "sex", "modifier", "aspect", "biocuration")


def _strings(*columns: str) -> str:
    return ", ".join(f"{c} string" for c in columns)


def _field(lines, tag: str):
    """The values of a stanza's lines of one tag."""
    return F.transform(F.filter(lines, lambda x: x.startswith(f"{tag}: ")), lambda x: F.trim(F.substr(x, F.lit(len(tag) + 3), F.length(x))))


def _quoted(x):
    """The text between the first and the last quotation mark."""
    return F.regexp_extract(x, '(?s)^[^"]*"(.*)"[^"]*$', 1)


def _stanzas(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", "\n\n").text(path)
    return rows.where(F.trim("value").startswith("[Term]")).select(F.transform(F.split(F.trim("value"), "\n"), lambda x: F.trim(x)).alias("lines"))


def read_obo(spark: SparkSession, path: str) -> DataFrame:
    """Terms of an ontology file, one stanza a row."""
    s = F.col("lines")
    first = lambda tag: F.get(_field(s, tag), F.lit(0))
    return _stanzas(spark, path).select(
        first("id").alias("term_id"), first("name").alias("name"), F.transform(_field(s, "synonym"), _quoted).alias("synonyms"), _quoted(first("def")).alias("definition"), first("comment").alias("comment"),
        F.transform(_field(s, "is_a"), lambda x: F.trim(F.split_part(x, F.lit(" ! "), F.lit(1)))).alias("is_a"), _field(s, "alt_id").alias("alt_ids"), F.coalesce(first("is_obsolete") == "true", F.lit(False)).alias("is_obsolete"), first("replaced_by").alias("replaced_by"))


def read_disease_obo(spark: SparkSession, path: str, prefix: str = "MONDO:") -> DataFrame:
    """Diseases of an ontology file: synonyms with type, equivalent ids, whether rare, parents."""
    s = F.col("lines")
    first = lambda tag: F.get(_field(s, tag), F.lit(0))
    same = F.filter(_field(s, "xref"), lambda x: x.contains('source="MONDO:equivalentTo"'))
    rare = F.exists(_field(s, "subset"), lambda x: F.regexp_like(F.split_part(x, F.lit(" "), F.lit(1)), F.lit("^(rare|rare_grouping|.*_rare)$")))
    return _stanzas(spark, path).select(
        first("id").alias("disease_id"), first("name").alias("name"), F.transform(_field(s, "synonym"), lambda x: F.struct(_quoted(x).alias("name"), F.regexp_extract(x, r'"\s+(\w+)', 1).alias("type"))).alias("synonyms"),
        F.transform(same, lambda x: F.split_part(x, F.lit(" "), F.lit(1))).alias("equivalent_ids"), rare.alias("is_rare"), F.transform(_field(s, "is_a"), lambda x: F.split_part(x, F.lit(" "), F.lit(1))).alias("parents")).where(F.col("disease_id").startswith(prefix))


def read_annotation_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", comment="#", header=True, schema=_strings(*ANNOTATION_COLUMNS))


def read_phenotype_to_genes(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, sep="\t", header=True, schema=_strings("hpo_id", "hpo_name", "ncbi_gene_id", "gene_symbol", "disease_id"))
    return rows.where(F.trim(F.coalesce("disease_id", F.lit(""))).isin("", "-") == F.lit(False))


def read_genes_to_phenotype(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, sep="\t", header=True, schema=_strings("ncbi_gene_id", "gene_symbol", "hpo_id", "hpo_name", "frequency", "disease_id"))
    return rows.where(F.col("hpo_id").startswith("HP:") & (F.trim(F.coalesce("gene_symbol", F.lit(""))) != ""))


def read_genes_to_disease(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=_strings("ncbi_gene_id", "gene_symbol", "association_type", "disease_id", "source")).where("disease_id is not null")


def read_case_library(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a JSON-lines file; lines that can't be read go."""
    rows = spark.read.schema("Phenotype array<string>, RareDisease array<string>, Department string, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    kept = rows.select("Phenotype", "RareDisease", "Department", "_bad").where("_bad is null and Phenotype is not null")
    return kept.select(F.col("Phenotype").alias("terms"), F.col("RareDisease").alias("diseases"), F.col("Department").alias("department"))


def read_patients(spark: SparkSession, path: str) -> DataFrame:
    """(patient_id, terms, true_diseases) of a file of pairs of lists; others go, and ids count what is left from 1."""
    pairs = entries(spark, path).select(F.struct("file", "place").alias("place"), F.from_json("value", "array<array<string>>").alias("p"))
    good = pairs.where((F.size("p") == 2) & (F.size(F.col("p")[0]) > 0) & (F.size(F.col("p")[1]) > 0))
    return numbered(good, "place", "patient_id").select("patient_id", F.col("p")[0].alias("terms"), F.col("p")[1].alias("true_diseases"))


def sample_select(patients: DataFrame, wanted: str | int) -> DataFrame:
    """Patients of "0,5-7,10" (positions from 0, ranges inclusive), or the first n."""
    if isinstance(wanted, int):
        return patients.orderBy("patient_id").limit(wanted)
    spark = patients.sparkSession
    parts = spark.range(1).select(F.explode(F.split(F.lit(wanted), ",")).alias("p"))
    ends = parts.select(F.split_part(F.trim("p"), F.lit("-"), F.lit(1)).cast("long").alias("a"), F.element_at(F.split(F.trim("p"), "-"), -1).cast("long").alias("b"))
    ids = ends.select(F.explode(F.sequence("a", "b")).alias("i")).distinct().select((F.col("i") + 1).alias("patient_id"))
    return patients.join(F.broadcast(ids), "patient_id", "left_semi")


def read_embedding_csv(spark: SparkSession, path: str, prefix: str = "HP:") -> DataFrame:
    rows = spark.read.csv(path, header=True, schema=_strings("node_type", "id", "embedding")).where(F.col("id").startswith(prefix))
    v = rows.select(F.col("id").alias("term_id"), F.transform(F.split(F.regexp_replace("embedding", r"[\[\]\s]", ""), ","), lambda x: x.try_cast("float")).alias("v"))
    return v.where(~F.exists("v", lambda x: x.isNull()))


def read_json_dict(spark: SparkSession, path: str, value_type: str) -> DataFrame:
    """(key, value) of a file that holds one dictionary."""
    rows = entries(spark, path).where("key is not null")
    return rows.select("key", F.from_json(F.concat(F.lit("["), "value", F.lit("]")), f"array<{value_type}>")[0].alias("value"))


def read_descriptions(spark: SparkSession, path: str) -> DataFrame:
    rows = entries(spark, path, 2).where("parent = 'results' and key is not null").select(F.col("key").alias("disease_id"), F.from_json("value", "struct<description:string>").alias("d"))
    return rows.select("disease_id", F.col("d.description").alias("description")).where("description is not null")


def read_categorization_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, header=True, schema=_strings("OrphaNumber", "Disorder_Name", "Category"))
    return rows.select(F.concat(F.lit("ORPHA:"), F.trim("OrphaNumber")).alias("disease_id"), F.col("Disorder_Name").alias("name"), F.split("Category", r"\|").alias("categories"))


def read_disease_ontology_json(spark: SparkSession, path: str) -> DataFrame:
    """(disease_id, alias, pos): names and exact synonyms under the equivalent ids."""
    kind = "struct<name:string,synonyms:array<struct<name:string,type:string>>,equivalent_ids:array<string>>"
    d = entries(spark, path).select(F.from_json("value", kind).alias("d"))
    named = F.concat(F.array("d.name"), F.transform(F.filter("d.synonyms", lambda s: s["type"] == "EXACT"), lambda s: s["name"]))
    rows = d.select(F.explode("d.equivalent_ids").alias("e"), named.alias("a")).select(F.regexp_replace("e", "^Orphanet:", "ORPHA:").alias("disease_id"), "a").where("disease_id like 'ORPHA:%' or disease_id like 'OMIM:%'")
    return rows.select("disease_id", F.posexplode("a").alias("pos", "alias"))


def read_alt_names_json(spark: SparkSession, path: str) -> DataFrame:
    from ..functions.names import placeholder_name

    d = entries(spark, path).select(F.col("key").alias("disease_id"), F.from_json("value", "struct<ENG_NAME:string,ALT_NAME:string>").alias("d")).where("disease_id is not null")
    rows = d.select("disease_id", F.posexplode(F.concat(F.array("d.ENG_NAME"), F.split(F.coalesce("d.ALT_NAME", F.lit("")), ";;"))).alias("pos", "alias")).withColumn("alias", F.trim("alias"))
    return rows.where(~placeholder_name(F.col("alias")))


def read_predictions(spark: SparkSession, path: str, item: str = "sample_id long, text string") -> DataFrame:
    """The columns ``item`` of a list of samples, or of an object that holds one as ``samples``."""
    listed = entries(spark, path).where("key is null").select("value")
    held = entries(spark, path, 2).where("parent = 'samples'").select("value")
    return listed.unionByName(held).select(F.from_json("value", item).alias("s")).where("s is not null").select("s.*")


def _xml_records(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """The elements of one name as rows of ``schema``. Files are cut where an element ends, at any number of places: Spark's own reader takes a
    file with records of several lines whole, in one task. An end tag within a comment would cut a record."""
    end = f"</{tag}>"
    texts = spark.read.option("lineSep", end).text(path).where(F.contains("value", F.lit(f"<{tag}")))
    record = F.concat(F.regexp_extract("value", rf"(?s).*(<{tag}[\s>].*)", 1), F.lit(end))
    # an explode, so that a filter on the record's fields does not parse it once more
    return texts.select(F.explode(F.array(F.from_xml(record, schema))).alias("r")).select("r.*")


def read_xml_disorder_phenotypes(spark: SparkSession, path: str) -> DataFrame:
    """One row per disorder and term, with frequency and diagnostic criterion, the disorder's type and group, and the
    record's source and validation status."""
    schema = "Disorder struct<OrphaCode:long, Name:string, DisorderType:struct<Name:string>, DisorderGroup:struct<Name:string>, HPODisorderAssociationList:struct<HPODisorderAssociation:array<struct<HPO:struct<HPOId:string,HPOTerm:string>,HPOFrequency:struct<Name:string>,DiagnosticCriteria:struct<Name:string>>>>>, Source string, ValidationStatus string, Online string, ValidationDate string"
    d = _xml_records(spark, path, "HPODisorderSetStatus", schema)
    rows = d.select(
        F.concat(F.lit("ORPHA:"), F.col("Disorder.OrphaCode").cast("string")).alias("disease_id"), F.col("Disorder.Name").alias("name"), F.col("Disorder.DisorderType.Name").alias("disorder_type"), F.col("Disorder.DisorderGroup.Name").alias("disorder_group"),
        F.col("Source").alias("record_source"), F.col("ValidationStatus").alias("validation_status"), F.col("Online").alias("online"), F.col("ValidationDate").alias("validation_date"), F.explode("Disorder.HPODisorderAssociationList.HPODisorderAssociation").alias("a"))
    about = ("disease_id", "name", "disorder_type", "disorder_group", "record_source", "validation_status", "online", "validation_date")
    return rows.select(*about, F.col("a.HPO.HPOId").alias("term_id"), F.col("a.HPO.HPOTerm").alias("term_name"), F.trim(F.split_part("a.HPOFrequency.Name", F.lit("("), F.lit(1))).alias("frequency_label"), F.col("a.DiagnosticCriteria.Name").alias("criterion"))


def read_xml_alignment(spark: SparkSession, path: str) -> DataFrame:
    """One row per disorder and external reference, with the disorder's flags, synonyms, type and group, and how the reference maps."""
    named = "struct<Name:string>"
    reference = f"struct<Source:string,Reference:string,DisorderMappingRelation:{named},DisorderMappingICDRelation:{named},DisorderMappingValidationStatus:{named},DisorderMappingICDRefUrl:string,DisorderMappingICDRefUri:string>"
    schema = f"OrphaCode long, Name string, DisorderFlagList struct<DisorderFlag:array<struct<Value:string,Label:string>>>, SynonymList struct<Synonym:array<string>>, DisorderType {named}, DisorderGroup {named}, ExternalReferenceList struct<ExternalReference:array<{reference}>>"
    d = _xml_records(spark, path, "Disorder", schema)
    rows = d.select(
        F.concat(F.lit("ORPHA:"), F.col("OrphaCode").cast("string")).alias("disease_id"), F.col("Name").alias("name"), F.col("SynonymList.Synonym").alias("synonyms"), F.transform("DisorderFlagList.DisorderFlag", lambda f: f["Label"]).alias("flags"),
        F.col("DisorderType.Name").alias("disorder_type"), F.col("DisorderGroup.Name").alias("disorder_group"), F.explode_outer("ExternalReferenceList.ExternalReference").alias("r"))
    return rows.select(
        "disease_id", "name", "synonyms", "flags", "disorder_type", "disorder_group", F.col("r.Source").alias("source"), F.col("r.Reference").alias("reference"), F.col("r.DisorderMappingRelation.Name").alias("relation"),
        F.col("r.DisorderMappingICDRelation.Name").alias("icd_relation"), F.col("r.DisorderMappingValidationStatus.Name").alias("validation_status"), F.col("r.DisorderMappingICDRefUrl").alias("url"), F.col("r.DisorderMappingICDRefUri").alias("uri"))


def read_xml_classification(spark: SparkSession, path: str) -> DataFrame:
    """(classification, disease_id, name, disorder_type, category): each node of a classification tree and the nearest category above it."""

    def nodes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xml.etree.ElementTree as ET

        text = lambda e, p: (e.findtext(p) or "").strip()
        for frame in frames:
            rows = []
            for content in frame["content"]:
                for c in ET.fromstring(bytes(content)).iter("Classification"):
                    stack = [(n, None) for n in c.findall("ClassificationNodeRootList/ClassificationNode")]
                    while stack:
                        n, category = stack.pop()
                        d = n.find("Disorder")
                        kind, name = text(d, "DisorderType/Name"), text(d, "Name")
                        rows.append((text(c, "Name"), "ORPHA:" + text(d, "OrphaCode"), name, kind, category))
                        under = name if kind == "Category" else category
                        stack += [(k, under) for k in n.findall("ClassificationNodeChildList/ClassificationNode")]
            yield pd.DataFrame(rows, columns=["classification", "disease_id", "name", "disorder_type", "category"])

    from ..functions.names import class_name_norm

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(nodes, _strings("classification", "disease_id", "name", "disorder_type", "category")).withColumn("classification", class_name_norm(F.col("classification")))


def expand_groups(edges: DataFrame, public: DataFrame) -> DataFrame:
    """Graph edges of groups (sourceID "D:n") as edges of each public id."""
    ids = public.select(F.col("sourceID").alias("_g"), F.col("targetID").alias("_p"))
    return edges.join(ids, edges.sourceID == ids._g, "left").withColumn("sourceID", F.coalesce("_p", "sourceID")).drop("_g", "_p")


def public_annotations(edges: DataFrame, public: DataFrame) -> DataFrame:
    """(disease_id, term_id, freq): the largest share of each public id and term over its groups. Only ids of several groups, or that are
    a group's own id too, and groups without public ids need an aggregation after the expansion."""
    pairs = edges.groupBy(F.col("sourceID").alias("group_id"), F.col("targetID").alias("term_id")).agg(F.max("freq").alias("freq"))
    ids = public.select(F.col("sourceID").alias("group_id"), F.col("targetID").alias("disease_id")).distinct()
    own = edges.select(F.col("sourceID").alias("disease_id")).distinct()
    several = ids.groupBy("disease_id").agg(F.count("*").alias("_n")).where("_n > 1").select("disease_id").unionByName(own)
    once = ids.join(several.hint("merge"), "disease_id", "left_anti")
    again = pairs.join(ids.join(several.hint("merge"), "disease_id", "left_semi").hint("merge"), "group_id")
    bare = pairs.join(ids.select("group_id").distinct().hint("merge"), "group_id", "left_anti").withColumn("disease_id", F.col("group_id"))
    columns = ["disease_id", "term_id", "freq"]
    merged = again.select(columns).unionByName(bare.select(columns)).groupBy("disease_id", "term_id").agg(F.max("freq").alias("freq"))
    return given_to_ids(pairs, once).select(columns).unionByName(merged)


# The graph's files and their columns.
GRAPH_FILES = {
    "disease_nodes.csv": ("ID", "standard_name", "synonyms", "disease_type", "is_rare", "description"),
    "disease_to_publicDisease_edges.csv": ("sourceID", "targetID", "source", "relationship"),
    "disease_to_phenotype_edges.csv": ("sourceID", "targetID", "source", "frequency", "frequency_max", "relationship"),
    "phenotype_nodes.csv": ("ID", "standard_name", "synonyms", "description", "comment", "associations", "IC", "embedding"),
    "phenotype_to_phenotype_edges.csv": ("sourceID", "targetID", "source", "relationship"),
    "gene_to_phenotype_edges.csv": ("ncbi_gene_id", "gene_symbol", "phenotype_id", "disease_id", "relationship", "publicDisease_ids"),
    "gene_to_disease_edges.csv": ("ncbi_gene_id", "gene_symbol", "disease_id", "relationship"),
}


def _graph_file(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A file's rows with trimmed columns, blank ones empty; a file that isn't there has no rows."""
    columns = GRAPH_FILES[name]
    try:
        rows = spark.read.csv(f"{path}/{name}", header=True, schema=_strings(*columns), multiLine=True, escape='"')
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], _strings(*columns))
    return rows.select(*[F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in columns])


def read_kg(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The graph's tables: diseases with names, synonyms (the name first), type and description; groups and their public ids;
    annotations, one for each public id of a group, with numeric shares alone, and each group's number of edges; terms with
    vector and content, where the JSON file's content comes before the table's; is-a edges; genes by term and by disease."""
    file = lambda name: _graph_file(spark, path, name)
    filled = lambda c: F.nullif(c, F.lit(""))
    nodes = file("disease_nodes.csv").where("ID <> '' and standard_name <> ''")
    synonyms = F.filter(F.transform(F.split("synonyms", ";"), lambda x: F.trim(x)), lambda x: x != "")
    public = file("disease_to_publicDisease_edges.csv").where("sourceID <> '' and targetID <> ''").select("sourceID", "targetID")
    has = file("disease_to_phenotype_edges.csv").where("sourceID <> '' and targetID <> ''").withColumn("freq", F.col("frequency_max").try_cast("double"))
    own = file("phenotype_nodes.csv").where("ID <> ''")
    try:
        given = read_json_dict(spark, f"{path}/ic_dict_recomputed.json", "string").select(F.col("key").alias("term_id"), F.col("value").try_cast("double").alias("_ic")).where("_ic is not null")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        given = spark.createDataFrame([], "term_id string, _ic double")
    vector = F.from_json(filled("embedding"), "array<float>")
    terms = own.select(F.col("ID").alias("term_id"), filled("standard_name").alias("name"), F.col("IC").try_cast("double").alias("ic"), vector.alias("v"))
    return {
        "disease": nodes.select(F.col("ID").alias("disease_id"), F.col("standard_name").alias("name"), F.concat(F.array("standard_name"), synonyms).alias("names"), filled("disease_type").alias("disease_type"), F.when(F.col("description") != "No disease description found.", filled("description")).alias("description")),
        "group": public.select(F.col("sourceID").alias("group_id"), F.col("targetID").alias("disease_id")).distinct(),
        "annotation": public_annotations(has, public),
        "count": has.groupBy(F.col("sourceID").alias("group_id")).agg(F.count("*").alias("n_edges")),
        "term": terms.join(given.hint("merge"), "term_id", "full").select("term_id", "name", F.coalesce("_ic", "ic").alias("ic"), "v"),
        "term_edge": file("phenotype_to_phenotype_edges.csv").where("sourceID <> '' and targetID <> '' and relationship = 'is_a'").select(F.col("sourceID").alias("child"), F.col("targetID").alias("parent")),
        "gene_term": file("gene_to_phenotype_edges.csv").select(F.col("ncbi_gene_id").alias("gene_id"), "gene_symbol", F.col("phenotype_id").alias("term_id"), F.col("disease_id").alias("group_id"), F.filter(F.split("publicDisease_ids", ";"), lambda x: x != "").alias("disease_ids")),
        "gene_disease": file("gene_to_disease_edges.csv").select(F.col("ncbi_gene_id").alias("gene_id"), "gene_symbol", F.col("disease_id").alias("group_id")),
    }
