"""The command line: index, query, synthesize, consensus, matrix, stats and extract."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .integrity.codes import Refusal
from .operators import claims, consensus, matrices
from .service import embedders, events, extraction, indexing, paths, searching
from .service import matrices as matrix_files
from .sources import files
from .sources.store import Store


def panel(found: DataFrame) -> str:
    """Results as blocks, for people to read."""
    out = []
    for r in searching.ranked_table(found).orderBy("rank").collect():  # k rows
        out.append(f"--- {r['rank']}  {r['citation_token']}  score {r['hybrid_score']}  cosine {r['cosine_sim']}\n{r['snippet']}")
    return "\n".join(out) if out else "No results."


def table(found: DataFrame) -> str:
    rows = searching.ranked_table(found).orderBy("rank").collect()  # k rows
    names = ("rank", "hybrid_score", "cosine_sim", "citation_token", "snippet")
    lines = ["\t".join(names), *("\t".join(str(r[n]).replace("\n", " ") for n in names) for r in rows)]
    return "\n".join(lines)


def as_json(found: DataFrame) -> str:
    return json.dumps([r.asDict() for r in found.collect()], indent=2, default=str)  # k rows


RENDER = {"panel": panel, "table": table, "json": as_json}


def write(path: str, body: str) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as file:
        file.write(body)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="paperloom")
    top.add_argument("--store", default="index")
    top.add_argument("--collection", default="papers")
    top.add_argument("--provider", default="mock")
    top.add_argument("--model")
    command = top.add_subparsers(dest="command", required=True)
    index = command.add_parser("index")
    index.add_argument("folder")
    index.add_argument("--manifest")
    index.add_argument("--bib")
    index.add_argument("--json", action="store_true")
    query = command.add_parser("query")
    for one in (query, command.add_parser("synthesize")):
        one.add_argument("question")
        one.add_argument("-k", type=int, default=5)
        one.add_argument("--category")
        one.add_argument("--paradigm")
        one.add_argument("--boost", action="append", default=[])
        one.add_argument("--output")
    query.add_argument("--graph")
    query.add_argument("--format", choices=sorted(RENDER), default="panel")
    agree = command.add_parser("consensus")
    agree.add_argument("ledger")
    agree.add_argument("--threshold", type=float, default=consensus.THRESHOLD)
    agree.add_argument("--output")
    matrix = command.add_parser("matrix")
    matrix.add_argument("--protocol")
    matrix.add_argument("--output", default="literature")
    command.add_parser("stats")
    extract = command.add_parser("extract")
    extract.add_argument("file")
    extract.add_argument("--output")
    return top


def run(spark: SparkSession, arguments: list[str]) -> tuple[int, str]:
    """(exit code, what to print) of a command."""
    a = parser().parse_args(arguments)
    try:
        return 0, _COMMANDS[a.command](spark, a)
    except Refusal as refused:
        return 3, json.dumps({"code": refused.code, "field": refused.field, "message": str(refused)}, indent=2)
    except (FileNotFoundError, ValueError) as error:
        return 1, f"error: {error}"


def _store(spark: SparkSession, a) -> Store:
    return Store(spark, f"file://{os.path.abspath(a.store)}/{a.collection}")


def _embedder(a) -> embedders.Embedder:
    return embedders.embedder(a.provider, a.model)


def _index(spark, a) -> str:
    indexer = indexing.Indexer(spark, f"file://{os.path.abspath(a.store)}", a.collection, _embedder(a))
    found = indexer.index_directory(a.folder, manifest=a.manifest, bib_file=a.bib)
    if a.json:
        return json.dumps(found, indent=2)
    return f"Indexed {found['indexed_files']} files, {found['total_chunks']} chunks; the collection holds {found['collection_count']}."


def _found(spark, a, graph=None) -> DataFrame:
    journal = paths.audit_journal(os.getcwd())
    return searching.query(_store(spark, a), _embedder(a), a.question, a.k, seeds=a.boost, graph=graph and f"file://{os.path.abspath(graph)}", journal=journal, section_category=a.category, paradigm=a.paradigm)


def _query(spark, a) -> str:
    body = RENDER[a.format](_found(spark, a, a.graph))
    if a.output:
        write(a.output, body)
    return body


def _synthesize(spark, a) -> str:
    found = _found(spark, a)
    place = F.row_number().over(Window.orderBy(F.desc("hybrid_score"), "raw_distance", "chunk_id"))  # k rows
    markdown, ledger = claims.synthesize(found.withColumn("place", place), a.question, embed=_embedder(a).column)
    events.audit(paths.audit_journal(os.getcwd()), "SYNTHESIS_GENERATED", {"query": a.question}, {"claims_count": ledger.count()})
    if a.output:
        write(a.output, markdown)
        write(f"{os.path.splitext(a.output)[0]}.claims.json", "[" + ",\n".join(r[0] for r in ledger.select(F.to_json(F.struct("*"))).toLocalIterator()) + "]")
    return markdown


def _consensus(spark, a) -> str:
    read = files.claims(spark, f"file://{os.path.abspath(a.ledger)}")
    clustered = consensus.clusters(consensus.prepared(read), a.threshold)
    groups = consensus.analyze(read, a.threshold)
    body = consensus.report(groups, clustered)
    if a.output:
        write(a.output, body)
        write(f"{os.path.splitext(a.output)[0]}.json", json.dumps(consensus.totals_of(groups, read), indent=2, default=str))
    return body


def _matrix(spark, a) -> str:
    store = _store(spark, a)
    if a.protocol:
        rows, written = matrix_files.extract_all(store, files.protocol(a.protocol), a.output, journal=paths.audit_journal(os.getcwd()))
        return f"{len(rows)} studies: " + ", ".join(sorted(written.values()))
    live = store.live()
    if live is None:
        return matrices.methodology_markdown([])
    found = matrices.methodology_matrix(live)
    body = matrices.methodology_markdown(found.orderBy("first_seq").collect())  # one row a study, for people to read
    write(os.path.join(a.output, "methodology_matrix.md"), body)
    write(os.path.join(a.output, "methodology_matrix.json"), "[" + ",\n".join(r["json"] for r in matrices.methodology_json(found).collect()) + "]")
    return body


def _stats(spark, a) -> str:
    return f"Chunks: {_store(spark, a).count()}"


def _extract(spark, a) -> str:
    docs = spark.read.text(f"file://{os.path.abspath(a.file)}", wholetext=True).withColumnRenamed("value", "text")
    body = json.dumps(json.loads(extraction.as_json(extraction.extract(docs, source_file=os.path.basename(a.file))).head()[0]), indent=2, ensure_ascii=False)
    if a.output:
        write(a.output, body)
    return body


_COMMANDS = {"index": _index, "query": _query, "synthesize": _synthesize, "consensus": _consensus, "matrix": _matrix, "stats": _stats, "extract": _extract}


def main() -> None:
    spark = SparkSession.builder.appName("paperloom").getOrCreate()
    code, said = run(spark, sys.argv[1:])
    print(said)
    sys.exit(code)


if __name__ == "__main__":
    main()
