"""Readers of documents, graphs, claims, protocols and journals."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLAIMS = (
    "rq_id string, claim_seq bigint, claim_text string, study_id string, stance string, citation_tokens array<string>, "
    "entailment_score double, entailment_status string, supporting_chunk_ids array<string>"
)
JOURNAL = "event_id string, timestamp string, action string, agent string, input string, output string"


def markdown_directory(spark: SparkSession, path: str) -> DataFrame:
    """(path, filename, stem, text) of the ``*.md`` files of a folder, not of those below it."""
    found = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True).withColumn("path", F.input_file_name())
    name = F.element_at(F.split("path", "/"), -1)
    return found.select("path", name.alias("filename"), F.regexp_replace(name, r"\.md$", "").alias("stem"), F.col("value").alias("text"))


def bound_documents(found: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files bound to the records of an accepted parent by path, and records without a file."""
    both = records.join(found.select(F.col("path").alias("extracted_path"), "text"), "extracted_path", "left")
    return both.where("text is not null").orderBy("document_id"), both.where("text is null").drop("text")


def citation_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(edges, given ranks, nodes) of a graph file: nodes and links, or ranks by node.

    Nodes that no link names are nodes as well.  A file that is missing or cannot be read
    gives nothing: a question is answered without a graph then.
    """
    edges, nodes = spark.createDataFrame([], "src string, dst string"), spark.createDataFrame([], "node string")
    try:
        raw = spark.read.json(path, multiLine=True)
    except AnalysisException:  # there is no such file
        return edges, None, nodes
    fields = dict(raw.dtypes)
    if "links" in fields and "nodes" in fields:
        if fields["links"].startswith("array<struct"):
            edges = raw.select(F.explode("links").alias("l")).select(F.col("l.source").cast("string").alias("src"), F.col("l.target").cast("string").alias("dst"))
        if fields["nodes"].startswith("array"):
            of = F.col("n.id") if fields["nodes"].startswith("array<struct") else F.col("n")
            nodes = raw.select(F.explode("nodes").alias("n")).select(of.cast("string").alias("node"))
        return edges, None, nodes.unionByName(edges.select(F.col("src").alias("node"))).unionByName(edges.select(F.col("dst").alias("node"))).where("node is not null").distinct()
    if "pagerank" in fields:
        ranks = raw.select(F.explode(F.from_json(F.to_json("pagerank"), "map<string,double>")).alias("node", "rank"))
        return edges, ranks, nodes
    return edges, None, nodes


def claims(spark: SparkSession, path: str) -> DataFrame:
    """Claims of a JSON-lines ledger, or of a JSON list or object; other fields are dropped."""
    found = spark.read.schema(CLAIMS).json(path, multiLine=not path.endswith(".jsonl"))
    return found.withColumn("claim_seq", F.coalesce("claim_seq", F.monotonically_increasing_id()))


def protocol(value) -> dict:
    """A protocol as a dict, from a dict or a JSON file."""
    import json

    if isinstance(value, dict):
        found = value
    elif isinstance(value, str):
        with open(value, encoding="utf-8") as file:
            found = json.load(file)
    else:
        raise TypeError(f"a protocol is a dict or the path of a JSON file, not {type(value).__name__}")
    return {"protocol_id": found["protocol_id"], "project_slug": found.get("project_slug", ""), "matrix_dimensions": list(found.get("matrix_dimensions", []))}


def journal(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.schema(JOURNAL).json(path)
