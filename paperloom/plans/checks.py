"""Queries over rules and sets of the index, each with the same result in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..integrity import verify
from ..operators import chunking, consensus
from ..service import embedders, events, extraction, paths, requests
from ..sources.store import Store
from ..sources.tables import new_folder, read
from .catalogue import _CHUNKS, _HAS_PII, _REDACTED, _TURNS, _pick, _sql_list, _study_chunks, query
from .catalogue import _turns as turns

REFERENCES = ("notes/a.md", "/etc/x", "C:\\x", "a/../b", "a//b", "./a", ".", "", "a/b/c.md", "..\\x")


@query("""WITH r AS (SELECT source, count(*) FILTER (n_chars >= 300) AS accepted, count(*) FILTER (n_chars < 300) AS rejected FROM documents GROUP BY source)
SELECT source, accepted, rejected, CASE WHEN accepted = 0 THEN 'FAILED' WHEN rejected > 0 THEN 'PARTIAL' ELSE 'SUCCESS' END AS status FROM r""")
def run_statuses(spark, sf_dir):
    per = read(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(F.col("n_chars") >= 300).alias("accepted"), F.count_if(F.col("n_chars") < 300).alias("rejected"))
    return per.withColumn("status", events.run_status_column(F.col("accepted"), F.col("rejected")))


@query(rf"""WITH r AS (SELECT doc_id, ({_sql_list(REFERENCES)})[doc_id % {len(REFERENCES)} + 1] AS ref FROM documents)
SELECT doc_id, CASE WHEN trim(ref) = '' THEN 'blank' WHEN regexp_matches(ref, '^([A-Za-z]:|[\\/])') THEN 'absolute' WHEN regexp_matches(ref, '(^|[\\/])\.\.([\\/]|$)') THEN 'upwards'
  WHEN ref <> '.' AND regexp_matches(ref, '(^|[\\/])\.?([\\/]|$)') THEN 'redundant' END AS fault FROM r""")
def reference_faults(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", paths.reference_fault(_pick(REFERENCES, F.col("doc_id"))).alias("fault"))


@query(f"""SELECT doc_id, sha256({_REDACTED}) AS text_sha256, sha256(replace(source, 'src', '')) AS note_sha256, {" OR ".join(_HAS_PII)} AS found FROM documents""")
def redact_nested(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.struct(F.array("text").alias("texts"), F.create_map(F.lit("note"), F.replace("source", F.lit("src"), F.lit(""))).alias("notes")).alias("nested"))
    kind = rows.schema["nested"].dataType
    out = rows.withColumns({"r": extraction.redacted(F.col("nested"), kind), "found": extraction.has_personal_data(F.col("nested"), kind)})
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    return out.select("doc_id", digest(F.col("r.texts")[0]).alias("text_sha256"), digest(F.col("r.notes")["note"]).alias("note_sha256"), "found")


@query(f"""WITH {_TURNS}, g AS (SELECT rq_id, count(*) AS input_claims, count(DISTINCT study_id) AS studies FROM claims GROUP BY rq_id)
SELECT rq_id, input_claims, studies FROM g""")
def consensus_inputs(spark, sf_dir):
    said = turns(spark, sf_dir)
    groups = consensus.analyze(said)
    per = consensus.totals(groups, said).groupBy("rq_id").agg(F.max("input_claims").alias("input_claims"), F.sum("clusters").alias("_c"), F.max("total_groups").alias("_g"))
    studies = said.groupBy("rq_id").agg(F.count_distinct("study_id").alias("studies"))
    return per.where("_c = _g").join(studies, "rq_id").select("rq_id", "input_claims", "studies")


@query(f"""WITH {_CHUNKS}, m AS (SELECT chunk_id, paradigm, CASE WHEN doc_id % 4 = 0 THEN 'RCT' END AS design, CASE WHEN doc_id % 3 = 1 THEN 'F1, recall' END AS metrics FROM chunks)
SELECT chunk_id, paradigm IS NOT NULL OR design IS NOT NULL AS has_methodology, CASE WHEN paradigm IS NOT NULL OR design IS NOT NULL THEN coalesce(metrics, '') END AS metrics,
  CASE WHEN paradigm IS NOT NULL OR design IS NOT NULL THEN design END AS design FROM m""")
def methodology_struct(spark, sf_dir):
    rows = _study_chunks(spark, sf_dir).select("chunk_id", "paradigm", F.when(F.col("doc_id") % 4 == 0, "RCT").alias("study_design"), F.when(F.col("doc_id") % 3 == 1, "F1, recall").alias("evaluation_metrics"))
    m = F.col("methodology")
    return chunking.with_methodology(rows).select(
        "chunk_id", m.isNotNull().alias("has_methodology"), F.when(m.isNotNull(), F.array_join(m["evaluation_metrics"], ", ")).alias("metrics"), m["study_design"].alias("design")
    )


@query(f"WITH {_CHUNKS} SELECT chunk_id, row_number() OVER (PARTITION BY workspace_id, path ORDER BY ingest_seq) AS ordinal FROM chunks")
def chunk_ordinals(spark, sf_dir):
    found = chunking.ordinals(_study_chunks(spark, sf_dir), "workspace_id", "section_hierarchy", ("ingest_seq",))
    return found.select("chunk_id", F.col("ordinal_in_section").cast("bigint").alias("ordinal"))


@query("""WITH r AS (SELECT doc_id, 'WSP-1' AS a, CASE WHEN doc_id % 3 > 0 THEN source END AS b, CASE WHEN doc_id % 5 = 0 THEN '  ' ELSE 'DOC-' || doc_id END AS c FROM documents)
SELECT doc_id, concat_ws(',', CASE WHEN b IS NULL THEN 'study_id' END, CASE WHEN trim(c) = '' THEN 'document_id' END) AS missing FROM r""")
def identity_missing(spark, sf_dir):
    i = F.col("doc_id")
    rows = read(spark, sf_dir, "documents").select(
        i, F.lit("WSP-1").alias("workspace_id"), F.when(i % 3 > 0, F.col("source")).alias("study_id"), F.when(i % 5 == 0, "  ").otherwise(F.concat(F.lit("DOC-"), i.cast("string"))).alias("document_id")
    )
    return rows.select("doc_id", F.array_join(requests.missing_limbs(("workspace_id", "study_id", "document_id")), ",").alias("missing"))


@query("""SELECT source, list_aggregate(list_sort(list(DISTINCT lang)), 'string_agg', ',') AS codes, count(*) AS n FROM documents GROUP BY source""")
def code_lists(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.array_join(verify.code_list(F.col("lang")), ",").alias("codes"), F.count("*").alias("n"))


@query("""SELECT list_aggregate(list_sort(list(DISTINCT len(embedding))), 'string_agg', ',') AS dimensions, count(*) AS n, count(*) FILTER (len(embedding) <> 64) AS wrong FROM embeddings""")
def observed_dimensions(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    return rows.agg(F.array_join(verify.dimensions(F.col("embedding")), ",").alias("dimensions"), F.count("*").alias("n"), F.count_if(F.size("embedding") != 64).alias("wrong"))


@query("""WITH d AS (SELECT source, list_sort(list(DISTINCT lang)) AS a, list_sort(list(DISTINCT CASE WHEN n_chars > 1000 THEN lang END) FILTER (n_chars > 1000)) AS b FROM documents GROUP BY source)
SELECT source, array_to_string(list_sort(list_distinct(list_concat(a, coalesce(b, [])))), ',') AS merged, len(list_filter(coalesce(b, []), lambda x: NOT list_contains(a, x))) = 0 AS within,
  len(list_filter(a, lambda x: NOT list_contains(coalesce(b, []), x))) = 0 AS covers FROM d""")
def id_groups(spark, sf_dir):
    a, b = F.collect_set("lang"), F.collect_set(F.when(F.col("n_chars") > 1000, F.col("lang")))
    per = read(spark, sf_dir, "documents").groupBy("source").agg(a.alias("a"), b.alias("b"))
    merged = F.array_join(verify.merged_ids(F.col("a"), F.col("b")), ",")
    return per.select("source", merged.alias("merged"), verify.is_subset(F.col("b"), F.col("a")).alias("within"), verify.is_subset(F.col("a"), F.col("b")).alias("covers"))


@query("""WITH p AS (SELECT doc_id FROM documents WHERE n_chars > 2000), q AS (SELECT doc_id FROM labels WHERE quality = 1)
SELECT count(*) AS n, min(doc_id) AS low, max(doc_id) AS high FROM (SELECT doc_id FROM p UNION SELECT doc_id FROM q)""")
def removal_scope(spark, sf_dir):
    accepted = read(spark, sf_dir, "documents").where("n_chars > 2000").select(F.col("doc_id").alias("document_id"))
    candidate = read(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("document_id"))
    return verify.scope(accepted, candidate).agg(F.count("*").alias("n"), F.min("document_id").alias("low"), F.max("document_id").alias("high"))


@query(f"""WITH {_CHUNKS}, owners AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1)
SELECT CASE WHEN o.doc_id IS NULL THEN 'no owner' WHEN c.doc_id % 7 = 0 THEN 'other study' ELSE 'owned' END AS state, count(*) AS n FROM chunks c LEFT JOIN owners o ON o.doc_id = c.doc_id GROUP BY 1""")
def chunk_owners(spark, sf_dir):
    study = F.col("doc_id") % 7 == 0
    chunks = _study_chunks(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.when(study, "x").otherwise(F.lit("s")).alias("study_id"), "chunk_id")
    owners = read(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("document_id"), F.lit("s").alias("study_id")).distinct()
    return verify.owners(chunks, owners).groupBy("state").agg(F.count("*").alias("n"))


@query("""SELECT source, (SELECT count(*) FROM documents d WHERE d.source = g.source) AS stored, declared, declared = 0 AS complete FROM (
  SELECT source, count(*) FILTER (n_chars <= 400) AS declared FROM documents GROUP BY source) g""")
def generation_completeness(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("chunk_id"), "n_chars")
    lost = verify.lost(docs, docs.where("n_chars > 400"), "chunk_id").groupBy("source").agg(F.count("*").alias("declared"))
    return docs.groupBy("source").agg(F.count("*").alias("stored")).join(lost, "source", "left").select(
        "source", "stored", F.coalesce("declared", F.lit(0)).cast("bigint").alias("declared"), F.col("declared").isNull().alias("complete")
    )


@query("""WITH b AS (SELECT b0.vec_id, b0.embedding AS x, b1.embedding AS y FROM embeddings b0 JOIN embeddings b1 ON b1.vec_id = b0.vec_id + 1)
SELECT vec_id, round(greatest(0, least(1, list_dot_product(x::DOUBLE[], y::DOUBLE[]) / (sqrt(list_dot_product(x::DOUBLE[], x::DOUBLE[])) * sqrt(list_dot_product(y::DOUBLE[], y::DOUBLE[]))))), 6) AS score FROM b""")
def claim_cosines(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    after = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    own = lambda x: x  # noqa: E731  the vectors are there already
    return vectors.join(after, "vec_id").select("vec_id", F.round(embedders.bounded_cosine(F.col("embedding"), F.col("other"), own), 6).alias("score"))


@query(r"""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '```json' || chr(10) || '{"title": "T' || doc_id || '", "year": 2020}' || chr(10) || '```' WHEN doc_id % 3 = 1 THEN '```' || chr(10) || '{"title": "x"}```  ' ELSE ' plain ' END AS raw FROM documents)
SELECT doc_id, trim(regexp_replace(regexp_replace(raw, '```json?\s*', '', 'g'), '```\s*$', ''), ' ' || chr(10)) AS json FROM r""")
def model_answers(spark, sf_dir):
    i = F.col("doc_id")
    first = F.concat(F.lit('```json\n{"title": "T'), i.cast("string"), F.lit('", "year": 2020}\n```'))
    raw = F.when(i % 3 == 0, first).when(i % 3 == 1, F.lit('```\n{"title": "x"}```  ')).otherwise(F.lit(" plain "))
    return read(spark, sf_dir, "documents").select("doc_id", extraction.without_fences(raw).alias("json"))


@query("""WITH a AS (SELECT doc_id, source, lang FROM documents WHERE n_chars > 300)
SELECT count(*) AS live, count(DISTINCT source) AS sources, (SELECT count(*) FROM documents) AS staged, (SELECT count(*) FROM documents) - count(*) AS hidden FROM a""")
def staged_and_live(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "source", "n_chars")
    kept = Store(spark, new_folder(spark, "staged-and-live"))
    kept.stage(docs.where("n_chars > 300"), "RUN-1")
    kept.switch("RUN-1")
    kept.stage(docs, "RUN-2")  # nobody reads it yet
    live = kept.live().agg(F.count("*").alias("live"), F.count_distinct("source").alias("sources"))
    staged = kept.generation("RUN-2").agg(F.count("*").alias("staged"), F.count_if(F.col("n_chars") <= 300).alias("hidden"))
    return live.join(staged, F.lit(True))  # one row each


@query("""SELECT doc_id, 'A, B ' || lang AS authors, CASE WHEN doc_id % 3 = 0 THEN 2000 + doc_id % 20 END::INT AS year FROM documents""")
def authors_and_years(spark, sf_dir):
    i = F.col("doc_id")
    rows = read(spark, sf_dir, "documents").select(
        i, F.concat(F.lit("---\nauthors: [A, B "), "lang", F.lit("]\nyear: "), F.when(i % 3 == 0, (2000 + i % 20).cast("string")).when(i % 3 == 1, F.lit("in press")).otherwise(F.lit("")), F.lit("\n---\nbody")).alias("text")
    )
    return chunking.merged_metadata(chunking.with_frontmatter(rows)).select("doc_id", "authors", "year")
