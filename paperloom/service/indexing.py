"""From markdown and folders to chunks in the store."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import LIMBS
from ..operators import chunking
from ..sources import bibliography, files
from ..sources.rows import to_store_row
from ..sources.store import Store
from . import events, paths
from .embedders import Embedder
from .requests import IndexRequest, check_binding, resolve

TOLD_BY_ENTRY = ("doi", "title", "authors", "year", "paradigm", "study_design")


class Indexer:
    """Writes chunks of documents, with vectors, into one collection of a store."""

    def __init__(self, spark: SparkSession, folder: str, collection: str, embedder: Embedder, chunker: chunking.Chunker = chunking.Chunker()):
        self.spark, self.collection, self.embedder, self.chunker = spark, collection, embedder, chunker
        self.store = Store(spark, f"{folder.rstrip('/')}/{collection}")

    def check(self, request: IndexRequest) -> None:
        check_binding(request, collection=self.collection, provider=self.embedder.provider, model=self.embedder.model)

    def chunks(self, documents: DataFrame) -> DataFrame:
        """Chunk rows with identity of documents that carry the identity columns beside ``text``."""
        told = chunking.merged_metadata(chunking.with_frontmatter(documents))
        found = chunking.with_identity(chunking.chunks(chunking.with_methodology(told), self.chunker), self.chunker)
        return found.drop("frontmatter", "section_no")

    def index(self, documents: DataFrame) -> DataFrame:
        """Chunk and upsert; the chunk rows."""
        found = self.chunks(documents)
        order = F.struct("document_id", "chunk_id")
        rows = to_store_row(found).withColumn("ingest_seq", F.xxhash64(order)).withColumn("embedding", self.embedder.column(F.col("text")))
        self.store.upsert(rows)
        return found

    def index_markdown(self, markdown: str, request: IndexRequest | None = None, metadata: dict | None = None) -> DataFrame:
        """One document; the identity of a request stands above that of the metadata."""
        if request is not None:
            self.check(request)
        values = {k: ", ".join(map(str, x)) if isinstance(x, list) else str(x) for k, x in (metadata or {}).items() if x is not None}
        values |= request.limbs() if request is not None else {}
        names = sorted({*values, *LIMBS})
        schema = ", ".join(f"`{name}` string" for name in (*names, "text"))
        return self.index(self.spark.createDataFrame([(*(values.get(name) for name in names), markdown)], schema))

    def index_directory(self, folder: str, request: IndexRequest | None = None, manifest=None, bib_file: str | None = None, workspace_id: str | None = None, journal: bool = True) -> dict:
        """All markdown files of a folder, told about by its bibliography.

        Identity is settled before a file is read; file names and entries never give one.
        """
        if not os.path.exists(folder):
            raise FileNotFoundError(folder)
        bound = resolve(folder, request, manifest, workspace_id)
        self.check(bound)
        found = files.markdown_directory(self.spark, f"file://{os.path.abspath(folder)}").drop("path")
        entries = bib_file or paths.bibliography_of(folder)
        if entries:
            keyed = bibliography.keys(bibliography.read(self.spark, f"file://{os.path.abspath(entries)}"))
            found = bibliography.join_documents(found, keyed).select("filename", "text", *(F.nullif(F.col(name), F.lit("")).alias(name) for name in TOLD_BY_ENTRY))
        documents = found.withColumns({name: F.lit(value) for name, value in bound.limbs().items()})
        n_files, n_chunks = documents.count(), self.index(documents).count()
        if journal:
            result = {"collection_name": self.collection, "db_path": self.store.folder, "embedding_provider": self.embedder.provider}
            events.audit(paths.audit_journal(folder), "RAG_INDEX_BUILT", {"document_count": n_files, "total_chunks": n_chunks}, result)
        return {"indexed_files": n_files, "total_chunks": n_chunks, "collection_count": self.store.count(), "identity": bound.report(self.embedder.model)}


def embed_staged(store: Store, run_id: str, embedder: Embedder, text: str = "text") -> None:
    """Write the vectors of a staged generation anew; the live one cannot be touched."""
    if store.live_generation == run_id:
        raise ValueError("the generation is live")
    rows = store.generation(run_id).drop("generation").withColumn("embedding", embedder.column(F.col(text)))
    again = f"{run_id}-embedded"
    store.stage(rows, again)
    store.rename(again, run_id)
