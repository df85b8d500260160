"""Named queries over the driver tables, each with the same result in DuckDB SQL.

The corpus has no headings, so documents are seen as Markdown: a heading by id, the
text with blank lines between its lines, a second heading, and the text's start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions import vocabulary as v
from ..operators import chunking, claims, consensus, matrices, pagerank, retrieval
from ..sources import bibliography, store
from ..sources.tables import new_folder, read

HEADINGS = ("Introduction", "Methodology", "Results", "Discussion", "Appendix", "2.1 Dataset")
SUBHEADINGS = ("Background", "3. Evaluation", "Limitations", "IV. Protocol")
PARADIGMS = ("design science", "empirical", "")
QUERY = "accuracy of the proposed method on the benchmark"
DIMENSIONS = [
    {"id": "design", "name": "Study design", "description": "How the study was set up", "target_section_category": "methodology"},
    {"id": "outcome", "name": "Outcome", "description": "What was found", "target_section_category": "results_empirical"},
    {"id": "scope", "name": "Scope", "description": "", "target_section_category": ""},
]
PAGERANK_ROUNDS = 5

_queries: dict = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        _queries[function.__name__] = function
        if sql is not None:
            _sql[function.__name__] = sql.strip()
        return function

    return register


def queries() -> dict:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


# ---- views, in both languages ---------------------------------------------------


def _pick(values: tuple[str, ...], n: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.pmod(n, F.lit(len(values))).cast("int"))


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in values) + "]"


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    body = F.concat(
        F.lit("# "), _pick(HEADINGS, F.col("doc_id")), F.lit("\n"), F.replace("text", F.lit("\n"), F.lit("\n\n")),
        F.lit("\n## "), _pick(SUBHEADINGS, F.col("doc_id")), F.lit("\n"), F.substring("text", 1, 400),
    )
    return docs.select("doc_id", "source", "lang", body.alias("text"))


_MD = f"""md AS (
  SELECT doc_id, source, lang, '# ' || ({_sql_list(HEADINGS)})[doc_id % 6 + 1] || chr(10) || replace(text, chr(10), chr(10) || chr(10))
    || chr(10) || '## ' || ({_sql_list(SUBHEADINGS)})[doc_id % 4 + 1] || chr(10) || left(text, 400) AS md
  FROM documents)"""
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_SECTIONS = _MD + r""", lines AS (
  SELECT doc_id, source, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM (SELECT doc_id, source, string_split(md, chr(10)) AS ls FROM md)
), heads AS (
  SELECT *, length(regexp_extract(line, '^(#{1,3})\s+(.*)$', 1)) AS lvl, trim(regexp_extract(line, '^(#{1,3})\s+(.*)$', 2)) AS title FROM lines
), numbered AS (
  SELECT *, sum((lvl > 0)::INT) OVER (PARTITION BY doc_id ORDER BY i)::INT AS section_no FROM heads
), stacked AS (
  SELECT *, last_value(CASE WHEN lvl = 1 THEN title END IGNORE NULLS) OVER w AS t1, last_value(CASE WHEN lvl = 1 THEN i END IGNORE NULLS) OVER w AS p1,
    last_value(CASE WHEN lvl = 2 THEN title END IGNORE NULLS) OVER w AS t2, last_value(CASE WHEN lvl = 2 THEN i END IGNORE NULLS) OVER w AS p2
  FROM numbered WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), sections AS (
  SELECT doc_id, source, section_no, coalesce(max(CASE WHEN lvl > 0 THEN title END), 'Abstract/Intro') AS section,
    max(CASE WHEN p2 > p1 THEN t1 || ' > ' || t2 ELSE coalesce(t1, 'Abstract/Intro') END) AS path,
    """ + _STRIP.format("coalesce(string_agg(CASE WHEN lvl = 0 THEN line END, chr(10) ORDER BY i), '')") + """ AS body
  FROM stacked GROUP BY doc_id, source, section_no HAVING body <> '')"""
_BARE = r"regexp_replace(regexp_replace(lower(section), '^(?:[0-9]+(?:\.[0-9]+)*|[ivxlcdm]+)\s*[-:.)]\s*', ''), '^[0-9]+\s+', '')"
_CATEGORY = "CASE " + " ".join(f"WHEN regexp_matches({_BARE}, '{'|'.join(words)}') THEN '{name}'" for name, words in v.SECTION_KEYWORDS.items()) + " ELSE 'other' END"


def _section_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.sections(markdown(spark, sf_dir))


def _study_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk for each section, with study attributes made from the document."""
    found = _section_rows(spark, sf_dir).withColumn("section_category", text.section_category(F.col("section")))
    paradigm = _pick(PARADIGMS, F.col("doc_id"))
    return found.select(
        "doc_id", F.concat(F.lit("ws-"), "source").alias("workspace_id"), F.format_string("chk-%d-%d", "doc_id", "section_no").alias("chunk_id"),
        F.concat(F.lit("10.1/"), F.col("doc_id").cast("string")).alias("doi"), F.concat("source", F.lit(".md")).alias("filename"),
        F.concat(F.lit("Paper "), "lang").alias("title"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Author "), "source")).alias("authors"),
        (2000 + F.col("doc_id") % 20).cast("string").alias("year"), F.nullif(paradigm, F.lit("")).alias("paradigm"),
        "section", "section_hierarchy", "section_category", F.col("section_body").alias("text"), (F.col("doc_id") * 10 + F.col("section_no")).alias("ingest_seq"),
    )


_CHUNKS = _SECTIONS + f""", chunks AS (
  SELECT doc_id, 'ws-' || source AS workspace_id, 'chk-' || doc_id || '-' || section_no AS chunk_id, '10.1/' || doc_id AS doi, source || '.md' AS filename,
    'Paper ' || (SELECT lang FROM documents d WHERE d.doc_id = sections.doc_id) AS title, CASE WHEN doc_id % 2 = 0 THEN 'Author ' || source END AS authors,
    (2000 + doc_id % 20)::VARCHAR AS year, nullif(({_sql_list(PARADIGMS)})[doc_id % 3 + 1], '') AS paradigm,
    section, path, {_CATEGORY} AS section_category, body AS text, doc_id * 10 + section_no AS ingest_seq
  FROM sections)"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as claims: a question each, a study for each role, a stance by length."""
    return read(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("rq_id"), F.col("turn").alias("claim_seq"), F.col("text").alias("claim_text"), F.col("role").alias("study_id"),
        _pick(v.STANCES, F.length("text")).alias("stance"), (F.pmod(F.length("text"), F.lit(7)) / 7.0).alias("entailment_score"),
    )


_TURNS = f"""claims AS (
  SELECT conv_id::VARCHAR AS rq_id, turn AS claim_seq, text AS claim_text, role AS study_id, ({_sql_list(v.STANCES)})[length(text) % 3 + 1] AS stance,
    (length(text) % 7)::DOUBLE / 7 AS entailment_score FROM conversations)"""
_WORDS = f"list_filter(list_distinct(regexp_extract_all(lower({{}}), '[a-z0-9][a-z0-9\\-]*')), lambda w: NOT list_contains({_sql_list(v.STOPWORDS)}, w))"
_REDACTED = "text"
_HAS_PII = []
for _pattern, _with in v.REDACTIONS:
    _bare = _pattern.removeprefix("(?i)").replace("'", "''")
    _flags = "gi" if _pattern.startswith("(?i)") else "g"
    _HAS_PII.append(f"regexp_matches({_REDACTED}, '{_bare}', '{_flags[1:] or 'c'}')")
    _REDACTED = f"regexp_replace({_REDACTED}, '{_bare}', '{_with}', '{_flags}')"

# ---- text and structure ----------------------------------------------------------


@query(r"""SELECT doc_id, len(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)))::INT AS n_sentences FROM documents""")
def sentence_split_counts(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.size(text.sentences(F.col("text"))).alias("n_sentences"))


@query(f"WITH {_SECTIONS} SELECT doc_id, section_no, section, length(body)::INT AS n_chars, sha256(body) AS body_sha256 FROM sections")
def section_assign(spark, sf_dir):
    found = _section_rows(spark, sf_dir)
    return found.select("doc_id", "section_no", "section", F.length("section_body").alias("n_chars"), F.sha2(F.col("section_body").cast("binary"), 256).alias("body_sha256"))


@query(f"WITH {_SECTIONS} SELECT doc_id, section_no, path AS breadcrumb FROM sections")
def breadcrumbs(spark, sf_dir):
    return _section_rows(spark, sf_dir).select("doc_id", "section_no", F.array_join("section_hierarchy", " > ").alias("breadcrumb"))


@query(f"WITH {_SECTIONS} SELECT doc_id, section_no, {_CATEGORY} AS section_category FROM sections")
def section_category(spark, sf_dir):
    return _section_rows(spark, sf_dir).select("doc_id", "section_no", text.section_category(F.col("section")).alias("section_category"))


@query(rf"WITH {_SECTIONS} SELECT doc_id, section_no, left(regexp_replace(regexp_replace({_BARE}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 20) AS slug FROM sections")
def heading_slugs(spark, sf_dir):
    return _section_rows(spark, sf_dir).select("doc_id", "section_no", text.heading_slug(F.col("section")).alias("slug"))


@query(rf"""WITH {_SECTIONS}, p AS (SELECT doc_id, section_no, {_STRIP.format('unnest(string_split(body, chr(10) || chr(10)))')} AS para FROM sections)
SELECT doc_id, section_no, count(*) AS n_paragraphs, max(length(para))::INT AS longest FROM p WHERE para <> '' GROUP BY doc_id, section_no""")
def paragraphs_nonblank(spark, sf_dir):
    parts = F.filter(F.transform(F.split("section_body", "\n\n"), text.strip), lambda x: x != "")
    found = _section_rows(spark, sf_dir).withColumn("_p", parts)
    return found.select("doc_id", "section_no", F.size("_p").cast("bigint").alias("n_paragraphs"), F.array_max(F.transform("_p", lambda x: F.length(x))).alias("longest"))


@query(rf"""WITH {_SECTIONS} SELECT doc_id, section_no, len(string_split_regex(body, '\s+'))::INT AS token_count, length(body)::INT AS character_count,
'sha256:' || sha256(body) AS chunk_text_sha256 FROM sections""")
def chunk_measures(spark, sf_dir):
    body = F.col("section_body")
    return _section_rows(spark, sf_dir).select("doc_id", "section_no", text.word_count(body).alias("token_count"), F.length(body).alias("character_count"), text.fingerprint(body).alias("chunk_text_sha256"))


@query()
def guarded_chunks(spark, sf_dir):
    return chunking.chunks(markdown(spark, sf_dir)).select("doc_id", "section_no", "section", "section_category", "paragraph_idx", "token_count", "character_count", "chunk_text_sha256")


WHOLE = chunking.Chunker(max_chunk_chars=1_000_000_000)


def _identified(spark, sf_dir):
    """Markdown documents with identity limbs made from the document's id."""
    of = lambda prefix, c: F.concat(F.lit(prefix), F.substring(F.sha2(c.cast("binary"), 256), 1, 32))
    docs, i = markdown(spark, sf_dir), F.col("doc_id").cast("string")
    return docs.withColumns({
        "workspace_id": F.lit("WSP-0123456789abcdef0123456789abcdef"), "study_id": of("STU-", F.col("source")), "document_id": of("DOC-", i),
        "parent_artifact_id": F.lit("ART-11111111111111111111111111111111"), "parent_artifact_sha256": text.fingerprint(F.lit("parent")), "extracted_content_sha256": text.fingerprint(F.col("text")),
    })


@query(rf"""WITH {_SECTIONS}, ids AS (
  SELECT s.doc_id, s.section_no, '{{"algorithm_version":"{v.CHUNK_ID_VERSION}","input":{{"chunk_text_sha256":"sha256:' || sha256(body)
  || '","chunker_algorithm_version":"{chunking.ALGORITHM}","chunker_configuration_fingerprint":"{WHOLE.fingerprint}","document_id":"DOC-' || left(sha256(s.doc_id::VARCHAR), 32)
  || '","extracted_content_sha256":"sha256:' || sha256(md) || '","locator":{{"heading_path":["' || replace(path, ' > ', '","') || '"],"ordinal_in_section":1,"section_category":"' || ({_CATEGORY})
  || '"}},"parent_artifact_id":"ART-11111111111111111111111111111111","parent_artifact_sha256":"sha256:' || sha256('parent') || '","study_id":"STU-' || left(sha256(s.source), 32)
  || '"}},"kind":"chunk","workspace_namespace":"WSP-0123456789abcdef0123456789abcdef"}}' AS j FROM sections s JOIN md ON md.doc_id = s.doc_id)
SELECT doc_id, section_no, 'CHK-' || left(sha256(j), 32) AS chunk_id FROM ids""")
def chunk_ids(spark, sf_dir):
    found = chunking.with_identity(chunking.chunks(_identified(spark, sf_dir), WHOLE), WHOLE)
    return found.select("doc_id", "section_no", "chunk_id")


@query(r"""SELECT doc_id, length(regexp_extract(line, '^(.*)$', 1))::INT AS line_chars, CASE WHEN length(line) <= 160 THEN line
  WHEN length(regexp_extract(left(line, 160), '^(.*[.!?])', 1)) > 120 THEN left(line, length(regexp_extract(left(line, 160), '^(.*[.!?])', 1)))
  WHEN contains(left(line, 160), ' ') THEN regexp_extract(left(line, 160), '^(.*) ', 1) || '…' ELSE left(line, 160) END AS snippet
FROM (SELECT doc_id, trim(regexp_replace(trim(regexp_replace(regexp_replace(string_split(text, chr(10))[1], '\*\*+|`+|#{1,6}\s*', ' ', 'g'), '\s+', ' ', 'g')), '\s*\[[^\]]+\]\s*$', '')) AS line FROM documents)""")
def snippets(spark, sf_dir):
    line = text.strip(F.regexp_replace(text.squeeze(F.regexp_replace(F.substring_index("text", "\n", 1), r"\*\*+|`+|#{1,6}\s*", " ")), r"\s*\[[^\]]+\]\s*$", ""))
    return read(spark, sf_dir, "documents").select("doc_id", F.length(line).alias("line_chars"), text.snippet(F.col("text")).alias("snippet"))


@query(f"SELECT doc_id, sha256({_REDACTED}) AS redacted_sha256 FROM documents")
def redact_documents(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(text.redacted(F.col("text")).cast("binary"), 256).alias("redacted_sha256"))


@query(f"SELECT doc_id, {' OR '.join(_HAS_PII)} AS pii_found FROM documents")
def redact_flags(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.has_personal_data(F.col("text")).alias("pii_found"))


_FIELDS = r"""SELECT doc_id, nullif(trim(regexp_extract(md, '(?m)^#\s+(.+)$', 1)), '') AS title, nullif(regexp_replace(regexp_extract(md, '10\.\d{4,}/[^\s]+', 0), '[.,;]+$', ''), '') AS doi,
TRY_CAST(nullif(regexp_extract(md, '\b((?:19|20)\d{2})\b', 1), '') AS INT) AS year FROM md"""


@query(f"WITH {_MD} {_FIELDS}")
def heuristic_fields(spark, sf_dir):
    f = text.heuristic_fields(F.col("text"))
    return markdown(spark, sf_dir).withColumn("f", f).select("doc_id", "f.title", "f.doi", "f.year")


@query(f"WITH {_MD}, f AS ({_FIELDS}) SELECT doc_id, round((CASE WHEN title IS NULL THEN 0 ELSE 0.15 END + CASE WHEN year IS NULL THEN 0 ELSE 0.1 END + CASE WHEN doi IS NULL THEN 0 ELSE 0.1 END)::DOUBLE, 3) AS confidence FROM f")
def extraction_confidence(spark, sf_dir):
    f = markdown(spark, sf_dir).withColumn("f", text.heuristic_fields(F.col("text")))
    return f.select("doc_id", text.confidence({k: F.col(f"f.{k}") for k in ("title", "doi", "year")}).alias("confidence"))


# ---- vectors and ranks -------------------------------------------------------------

_EMBED = """list_transform(range(384), lambda i: (((instr('0123456789abcdef', h[(i % 32) * 2 + 1]) - 1) * 16 + instr('0123456789abcdef', h[(i % 32) * 2 + 2]) - 1 + i * 31) % 256 - 128)::DOUBLE / 128)"""


@query(f"""WITH e AS (SELECT doc_id, sha256(text) AS h FROM documents), r AS (SELECT doc_id, {_EMBED} AS x FROM e)
SELECT doc_id, round(x[1] / sqrt(list_sum(list_transform(x, lambda y: y * y))), 8) AS first, round(x[384] / sqrt(list_sum(list_transform(x, lambda y: y * y))), 8) AS last FROM r""")
def mock_embedding(spark, sf_dir):
    e = read(spark, sf_dir, "documents").select("doc_id", text.mock_embedding(F.col("text")).alias("e"))
    return e.select("doc_id", F.round(F.get("e", F.lit(0)), 8).alias("first"), F.round(F.get("e", F.lit(383)), 8).alias("last"))


_DIST = "1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def _query_vector(spark, sf_dir) -> list[float]:
    """The vector of least id: one row."""
    return [float(x) for x in read(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0]]


_Q = "q AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)"


@query(f"WITH {_Q} SELECT vec_id, round({_DIST}, 4) AS distance FROM embeddings e, q ORDER BY {_DIST}, vec_id LIMIT 10")
def vector_topk(spark, sf_dir):
    near = retrieval.nearest(read(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 10, tie="vec_id")
    return near.select("vec_id", F.round("distance", 4).alias("distance"))


@query(f"WITH {_Q} SELECT vec_id, label, round({_DIST}, 4) AS distance FROM embeddings e, q WHERE label IN (1, 3, 5) AND vec_id >= 20 ORDER BY {_DIST}, vec_id LIMIT 10")
def vector_topk_filtered(spark, sf_dir):
    rows = retrieval.where(read(spark, sf_dir, "embeddings"), {"$and": [{"label": {"$in": [1, 3, 5]}}, {"vec_id": {"$gte": 20}}]})
    return retrieval.nearest(rows, _query_vector(spark, sf_dir), 10, tie="vec_id").select("vec_id", "label", F.round("distance", 4).alias("distance"))


@query("""SELECT query_id, neighbour_id, rank::INT AS rank, round(d, 4) AS distance FROM (
  SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS rank
  FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0) WHERE rank <= 5""")
def knn_join(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    found = retrieval.neighbours(rows, rows.where(F.col("vec_id") % 20 == 0), 5)
    return found.select("query_id", "neighbour_id", "rank", F.round("distance", 4).alias("distance"))


def _edges(spark, sf_dir) -> DataFrame:
    node = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    return read(spark, sf_dir, "lineitem").select(node("S", "l_suppkey").alias("src"), node("P", "l_partkey").alias("dst")).distinct()


def _pagerank_sql() -> str:
    parts = [
        "edges AS MATERIALIZED (SELECT DISTINCT 'S' || l_suppkey AS src, 'P' || l_partkey AS dst FROM lineitem)",
        "degree AS MATERIALIZED (SELECT src, count(*) AS n FROM edges GROUP BY src)",
        "nodes AS MATERIALIZED (SELECT src AS node FROM edges UNION SELECT dst FROM edges)",
        "r0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS rank FROM nodes)",
    ]
    for k in range(PAGERANK_ROUNDS):
        parts.append(f"""r{k + 1} AS MATERIALIZED (SELECT n.node, 0.15::DOUBLE / (SELECT count(*) FROM nodes) + 0.85::DOUBLE * (coalesce(g.given, 0) +
          (SELECT coalesce(sum(rank), 0) FROM r{k} WHERE node NOT IN (SELECT src FROM degree)) / (SELECT count(*) FROM nodes)) AS rank
          FROM nodes n LEFT JOIN (SELECT dst, sum(rank / d.n) AS given FROM edges JOIN r{k} ON node = edges.src JOIN degree d ON d.src = edges.src GROUP BY dst) g ON g.dst = n.node)""")
    return "WITH " + ", ".join(parts)


@query(f"{_pagerank_sql()} SELECT node, round(rank, 9) AS rank FROM r{PAGERANK_ROUNDS}")
def pagerank_parts(spark, sf_dir):
    return pagerank.pagerank(_edges(spark, sf_dir), rounds=PAGERANK_ROUNDS, tolerance=None).select("node", F.round("rank", 9).alias("rank"))


def _vector_rows(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.concat(F.lit("P"), F.col("label").cast("string")).alias("doi"), F.concat(F.lit(" s"), F.col("vec_id").cast("string")).alias("paper_id"))


def _rank_rows(spark, sf_dir) -> DataFrame:
    edges = read(spark, sf_dir, "supplier").select(F.concat(F.lit("p"), F.pmod("s_suppkey", F.lit(10)).cast("string")).alias("node"), "s_acctbal")
    return edges.groupBy("node").agg((F.count("*") / 1000.0).alias("rank"))


@query(f"""WITH {_Q}, ranks AS (SELECT 'p' || (s_suppkey % 10) AS node, count(*) / 1000.0::DOUBLE AS rank FROM supplier GROUP BY 1),
near AS (SELECT vec_id, lower(trim('P' || label)) AS doi, 's' || vec_id AS paper, {_DIST} AS d FROM embeddings e, q ORDER BY d, vec_id LIMIT 20),
s AS (SELECT vec_id, d, greatest(0, least(1, 1 - d / 2)) AS cos, coalesce(rank, 0) AS pr, CASE WHEN doi IN ('p3') OR paper IN ('s3', 's7') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS seed FROM near LEFT JOIN ranks ON node = doi)
SELECT vec_id, round(cos, 4) AS cosine_sim, round(pr, 4)::DOUBLE AS pagerank_score, seed AS seed_boost, round(cos + 0.25::DOUBLE * pr + 0.15::DOUBLE * seed, 4) AS hybrid_score, round(d, 4) AS raw_distance
FROM s ORDER BY hybrid_score DESC, d, vec_id LIMIT 5""")
def hybrid_search(spark, sf_dir):
    found = retrieval.search(_vector_rows(spark, sf_dir), _query_vector(spark, sf_dir), 5, ranks=_rank_rows(spark, sf_dir), seeds=["P3", " S3", "s7 "], tie="vec_id")
    return found.select("vec_id", "cosine_sim", "pagerank_score", "seed_boost", "hybrid_score", "raw_distance")


@query("""SELECT vec_id, CASE WHEN 'p' || label IN ('p3') OR 's' || vec_id IN ('s3', 's7') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS seed_boost FROM embeddings""")
def seed_boost(spark, sf_dir):
    rows = _vector_rows(spark, sf_dir).withColumn("distance", F.lit(0.0))
    return retrieval.boosted(rows, None, ["P3", " S3", "s7 "]).select("vec_id", "seed_boost")


# ---- chunks, claims, consensus ---------------------------------------------------------


@query(rf"WITH {_CHUNKS} SELECT chunk_id, '[' || workspace_id || '#' || coalesce(nullif(left(regexp_replace(lower(section), '[^a-zA-Z0-9]', '', 'g'), 10), ''), 'sec') || '#' || chunk_id || ']' AS citation_token FROM chunks")
def citation_tokens(spark, sf_dir):
    c = F.col
    token = text.citation_token(c("workspace_id"), F.lit(None).cast("string"), c("doi"), c("filename"), c("section"), c("chunk_id"))
    return _study_chunks(spark, sf_dir).select("chunk_id", token.alias("citation_token"))


@query(rf"WITH {_CHUNKS} SELECT section_category, count(*) AS n FROM chunks WHERE section_category = 'results_empirical' AND paradigm = 'empirical' GROUP BY section_category")
def filtered_chunks(spark, sf_dir):
    rows = retrieval.where(_study_chunks(spark, sf_dir), section_category="results_empirical", paradigm="empirical", doi="")
    return rows.groupBy("section_category").agg(F.count("*").alias("n"))


@query(r"""WITH u AS (SELECT conv_id, turn, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)), lambda x: x <> '') AS s,
  list_transform(list_filter(string_split(text, chr(10)), lambda x: starts_with(trim(x), '- ')), lambda x: trim(x[3:])) AS b FROM conversations)
SELECT conv_id, turn, len(CASE WHEN len(b) > 0 THEN list_filter(b, lambda x: x <> '') ELSE s END)::INT AS n_units FROM u""")
def claim_units(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(text.claim_units(F.col("text"))).alias("n_units"))


def _cited(spark, sf_dir) -> DataFrame:
    unit = F.concat("text", F.lit(" [w"), F.col("conv_id").cast("string"), F.lit("#"), "role", F.lit("#c"), F.col("turn").cast("string"), F.lit("] end [not a token]"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", unit.alias("unit"))


_UNIT = r"SELECT conv_id, turn, text || ' [w' || conv_id || '#' || role || '#c' || turn || '] end [not a token]' AS unit FROM conversations"


@query(rf"""WITH u AS ({_UNIT}) SELECT conv_id, turn, array_to_string(list_transform(regexp_extract_all(unit, '\[([^\]]+#[^\]]+#[^\]]+)\]', 1), lambda t: '[' || t || ']'), ' ') AS tokens,
  sha256(trim(regexp_replace(regexp_replace(unit, '\[([^\]]+#[^\]]+#[^\]]+)\]', '', 'g'), '\s+', ' ', 'g'))) AS bare_sha256 FROM u""")
def claim_tokens(spark, sf_dir):
    bare = text.squeeze(F.regexp_replace("unit", text.CITATION, ""))
    return _cited(spark, sf_dir).select("conv_id", "turn", F.array_join(text.citation_tokens(F.col("unit")), " ").alias("tokens"), F.sha2(bare.cast("binary"), 256).alias("bare_sha256"))


_STANCE_HITS = lambda words, t: "(" + " + ".join(f"contains({t}, ' {w.replace(chr(39), chr(39) * 2)} ')::INT" for w in words) + ")"


@query(f"""WITH t AS (SELECT item_id, ' ' || lower(text || ({_sql_list((" better but not worse", " no gain", " improves strongly", " plain"))})[item_id % 4 + 1]) || ' ' AS t FROM benchmark),
h AS (SELECT item_id, {_STANCE_HITS(v.POSITIVE_WORDS, 't')} AS p, {_STANCE_HITS(v.NEGATIVE_WORDS, 't')} AS n FROM t)
SELECT item_id, CASE WHEN p + n = 0 THEN 'NEUTRAL' WHEN (p - n)::DOUBLE / (p + n) >= 0.2::DOUBLE THEN 'POSITIVE' WHEN (p - n)::DOUBLE / (p + n) <= -0.2::DOUBLE THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS stance FROM h""")
def stance_lexicon(spark, sf_dir):
    said = F.concat("text", _pick((" better but not worse", " no gain", " improves strongly", " plain"), F.col("item_id")))
    return read(spark, sf_dir, "benchmark").select("item_id", text.stance(said).alias("stance"))


@query(f"SELECT doc_id, len({_WORDS.format('text')})::INT AS n_words, sha256(array_to_string(list_sort({_WORDS.format('text')}), ' ')) AS words_sha256 FROM documents")
def content_words(spark, sf_dir):
    found = read(spark, sf_dir, "documents").withColumn("w", text.content_words(F.col("text")))
    return found.select("doc_id", F.size("w").alias("n_words"), F.sha2(F.array_join(F.array_sort("w"), " ").cast("binary"), 256).alias("words_sha256"))


@query(f"""WITH w AS (SELECT conv_id, turn, {_WORDS.format('text')} AS w, lag({_WORDS.format('text')}) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations)
SELECT conv_id, turn, round(CASE WHEN len(w) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(w, b))::DOUBLE / len(list_distinct(list_concat(w, b))) END, 6) AS jaccard FROM w WHERE b IS NOT NULL""")
def jaccard_pairs(spark, sf_dir):
    words = read(spark, sf_dir, "conversations").withColumn("w", text.content_words(F.col("text")))
    pairs = words.withColumn("b", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b is not null")
    return pairs.select("conv_id", "turn", F.round(text.jaccard(F.col("w"), F.col("b")), 6).alias("jaccard"))


def _pairs_of_turns(spark, sf_dir) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    return turns.withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before is not null")


_PAIRS = "t AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)"
_LEX = r"round(len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[\pL\pN_\pM]+')), list_distinct(regexp_extract_all(lower(before), '[\pL\pN_\pM]+'))))::DOUBLE / nullif(len(list_distinct(regexp_extract_all(lower(text), '[\pL\pN_\pM]+'))), 0), 6)"


@query(f"WITH {_PAIRS} SELECT conv_id, turn, coalesce({_LEX}, 0) AS overlap FROM t WHERE before IS NOT NULL")
def entailment_lexical(spark, sf_dir):
    return _pairs_of_turns(spark, sf_dir).select("conv_id", "turn", F.round(claims.lexical_overlap(F.col("text"), F.col("before")), 6).alias("overlap"))


@query(f"""WITH {_PAIRS}, e AS (SELECT conv_id, turn, (SELECT {_EMBED} FROM (SELECT sha256(t.text) AS h)) AS a, (SELECT {_EMBED} FROM (SELECT sha256(t.before) AS h)) AS b FROM t WHERE before IS NOT NULL),
s AS (SELECT conv_id, turn, (list_cosine_similarity(a, b) + 1) / 2 AS s FROM e)
SELECT conv_id, turn, round(s, 4) AS entailment_score, CASE WHEN s >= 0.85::DOUBLE THEN 'VERIFIED' WHEN s >= 0.5::DOUBLE THEN 'AMBIGUOUS' ELSE 'UNSUPPORTED' END AS entailment_status FROM s""")
def entailment_scores(spark, sf_dir):
    pairs = _pairs_of_turns(spark, sf_dir).select("conv_id", "turn", text.mock_embedding(F.col("text")).alias("a"), text.mock_embedding(F.col("before")).alias("b"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (text.cosine(F.col("a"), F.col("b")) + 1) / 2))
    return pairs.withColumn("s", score).select("conv_id", "turn", F.round("s", 4).alias("entailment_score"), claims.status(F.col("s")).alias("entailment_status"))


@query("""WITH s AS (SELECT CASE WHEN length(text) % 3 = 0 THEN 'VERIFIED' ELSE 'AMBIGUOUS' END AS st FROM conversations)
SELECT count(*) AS claims_count, count(*) FILTER (st = 'VERIFIED') AS verified_claims_count, round(coalesce(count(*) FILTER (st = 'VERIFIED') / nullif(count(*), 0), 1)::DOUBLE, 4) AS entailment_rate FROM s""")
def entailment_rate(spark, sf_dir):
    status = F.when(F.length("text") % 3 == 0, "VERIFIED").otherwise("AMBIGUOUS")
    return claims.summary(read(spark, sf_dir, "conversations").select(status.alias("entailment_status")))


_MAJORITY = f"""{_TURNS}, n AS (SELECT rq_id, study_id, stance, count(*) AS n, min(claim_seq) AS seen FROM claims GROUP BY ALL),
majority AS (SELECT rq_id, study_id, stance FROM n QUALIFY row_number() OVER (PARTITION BY rq_id, study_id ORDER BY n DESC, seen) = 1)"""


@query(f"WITH {_MAJORITY} SELECT rq_id, study_id, stance FROM majority")
def study_majority_stance(spark, sf_dir):
    return consensus.study_stances(_turns(spark, sf_dir), "rq_id")


@query(f"""WITH {_MAJORITY}, c AS (SELECT rq_id, count(*) FILTER (stance = 'POSITIVE') AS p, count(*) FILTER (stance = 'NEGATIVE') AS n, count(*) FILTER (stance = 'NEUTRAL') AS u, count(*) AS s,
  string_agg(study_id, ',' ORDER BY study_id) AS studies FROM majority GROUP BY rq_id)
SELECT c.rq_id, p AS positive, n AS negative, u AS neutral, s AS n_studies, studies, round(greatest(p, n)::DOUBLE / greatest(s, 1), 3) AS consensus_score,
  CASE WHEN s < 2 THEN 'PROVISIONAL' WHEN u::DOUBLE / s > 0.5::DOUBLE THEN 'UNRESOLVED' WHEN least(p, n) >= 1 AND least(p, n) * 3 >= p + n THEN 'ACTIVE_DEBATE' ELSE 'HIGH_CONSENSUS' END AS verdict,
  t.theme FROM c JOIN (SELECT rq_id, arg_max(claim_text, (entailment_score, -length(claim_text), -claim_seq)) AS theme FROM claims GROUP BY rq_id) t ON t.rq_id = c.rq_id""")
def consensus_verdict(spark, sf_dir):
    found = consensus.verdicts(_turns(spark, sf_dir), "rq_id").withColumn("studies", F.array_join("studies", ","))
    return found.select("rq_id", "positive", "negative", "neutral", "n_studies", "studies", "consensus_score", "verdict", "theme")


@query()
def leader_clusters(spark, sf_dir):
    return consensus.clusters(consensus.prepared(_turns(spark, sf_dir))).select("rq_id", "claim_seq", "study_id", "stance", "cluster_no")


@query()
def consensus_analyze(spark, sf_dir):
    return consensus.analyze(_turns(spark, sf_dir)).withColumn("studies", F.array_join("studies", ","))


# ---- matrices --------------------------------------------------------------------------

_FIRST = "arg_min({0}, ingest_seq)"


@query(f"""WITH {_CHUNKS}, t AS (SELECT *, coalesce(nullif(workspace_id, ''), 'DOC') AS k, replace(left(text, 120), chr(10), ' ') || '...' AS teaser FROM chunks),
a AS (SELECT k, min(ingest_seq) AS f, arg_min(teaser, ingest_seq) FILTER (section_category = 'results_empirical') AS r, arg_min(teaser, ingest_seq) FILTER (section_category = 'discussion_limitations') AS l FROM t GROUP BY k)
SELECT a.k AS study_id, coalesce(t.authors, 'Unknown') || ' (' || t.year || ')' AS authors_year, 'Evaluation Benchmark (' || coalesce(t.paradigm, 'Design Science / Empirical') || ')' AS epistemological_design,
  'Standard Corpus' AS population_dataset_sample, t.title AS key_intervention_model, coalesce(r, 'Evaluated via Accuracy / F1') AS primary_metrics_results, coalesce(l, 'Domain bounded') AS declared_limitations
FROM a JOIN t ON t.k = a.k AND t.ingest_seq = a.f""")
def methodology_matrix(spark, sf_dir):
    return matrices.methodology_matrix(_study_chunks(spark, sf_dir)).drop("first_seq")


@query(f"""WITH {_CHUNKS} SELECT workspace_id AS label, title, coalesce(authors, '') AS authors, year, doi AS scope_doi, ingest_seq AS first_seq
FROM chunks QUALIFY row_number() OVER (PARTITION BY workspace_id ORDER BY ingest_seq) = 1""")
def distinct_studies(spark, sf_dir):
    return matrices.distinct_studies(_study_chunks(spark, sf_dir)).select("label", "title", "authors", "year", "scope_doi", "first_seq")


def _with_vectors(spark, sf_dir) -> DataFrame:
    return _study_chunks(spark, sf_dir).withColumns({"embedding": text.mock_embedding(F.col("text")), "study_id": F.col("workspace_id")})


def _top3(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = _with_vectors(spark, sf_dir)
    c = F.col
    rows = rows.withColumn("citation_token", text.citation_token(c("workspace_id"), F.lit(None).cast("string"), c("doi"), c("filename"), c("section"), c("chunk_id")))
    studies = matrices.distinct_studies(rows)
    return studies, matrices.top_per_dimension(studies, rows, DIMENSIONS)


def _dims_sql() -> str:
    row = lambda d: f"('{d['id']}', {repr(d['target_section_category']) if d['target_section_category'] else 'NULL'}, sha256('{d['name']} {d['description']}'))"
    return "dims(dim_id, category, h) AS (VALUES " + ", ".join(map(row, DIMENSIONS)) + ")"


_TOP3 = f"""{_CHUNKS}, {_dims_sql()}, dv AS (SELECT dim_id, category, {_EMBED} AS q FROM dims), cv AS (SELECT *, (SELECT {_EMBED} FROM (SELECT sha256(chunks.text) AS h)) AS e FROM chunks),
top3 AS (SELECT workspace_id AS label, dim_id, chunk_id, text, section, row_number() OVER (PARTITION BY workspace_id, dim_id ORDER BY 1 - list_cosine_similarity(e, q), chunk_id)::INT AS place
  FROM cv JOIN dv ON category IS NULL OR category = section_category QUALIFY place <= 3)"""


@query(f"WITH {_TOP3} SELECT label, dim_id, place, chunk_id FROM top3")
def matrix_top3(spark, sf_dir):
    return _top3(spark, sf_dir)[1].select("label", "dim_id", "place", "chunk_id")


def _cell(d: dict) -> str:
    token = "'[' || label || '#' || coalesce(nullif(left(regexp_replace(lower(section), '[^a-zA-Z0-9]', '', 'g'), 10), ''), 'sec') || '#' || chunk_id || ']'"
    return f"""coalesce(max(CASE WHEN dim_id = '{d['id']}' THEN nullif({_STRIP.format("string_split(text, '.')[1]")}, '') END), 'N/A') AS {d['id']},
  coalesce(max(CASE WHEN dim_id = '{d['id']}' THEN {token} END), '') AS {d['id']}_citation"""


@query(f"WITH {_TOP3} SELECT label AS study_id, {', '.join(map(_cell, DIMENSIONS))} FROM top3 WHERE place = 1 GROUP BY label")
def protocol_matrix(spark, sf_dir):
    studies, ranked = _top3(spark, sf_dir)
    return matrices.protocol_matrix(studies, ranked, DIMENSIONS).drop("title", "authors", "year")


# ---- stores, joins, checks -------------------------------------------------------------


@query("""WITH new AS (SELECT o_orderkey AS k, 'new' AS origin, o_totalprice * 2 AS price, 2 AS seq FROM orders WHERE o_orderpriority LIKE '1%' UNION ALL SELECT o_orderkey + 1, 'later', 1.0, 3 FROM orders WHERE o_orderpriority LIKE '1%'),
latest AS (SELECT * FROM new QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq DESC) = 1)
SELECT k, origin, round(price, 2) AS price FROM latest UNION ALL SELECT o_orderkey, 'old', round(o_totalprice, 2) FROM orders WHERE o_orderkey NOT IN (SELECT k FROM latest)""")
def upsert_merge(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    row = lambda k, origin, price, seq: (k.alias("k"), F.lit(origin).alias("origin"), price.alias("price"), F.lit(seq).alias("seq"))
    first = orders.where(F.startswith("o_orderpriority", F.lit("1")))
    new = first.select(*row(F.col("o_orderkey"), "new", F.col("o_totalprice") * 2, 2)).unionByName(first.select(*row(F.col("o_orderkey") + 1, "later", F.lit(1.0), 3)))
    old = orders.select(*row(F.col("o_orderkey"), "old", F.col("o_totalprice"), 1))
    kept = store.Store(spark, new_folder(spark, "upsert-merge"))
    as_rows = lambda rows: rows.select(F.col("k").cast("string").alias("chunk_id"), "k", "origin", "price", F.col("seq").alias("ingest_seq"))
    kept.upsert(as_rows(old))
    kept.upsert(as_rows(new))
    return kept.live().select("k", "origin", F.round("price", 2).alias("price"))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1")
def delete_ids(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    gone = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    kept = store.Store(spark, new_folder(spark, "delete-ids"))
    kept.append(orders.select(F.col("o_orderkey").cast("string").alias("chunk_id"), "o_orderstatus"))
    kept.delete(orders.join(gone, "o_custkey").select(F.col("o_orderkey").cast("string").alias("chunk_id")))
    return kept.live().groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("""WITH declared AS (SELECT DISTINCT doc_id AS id FROM labels WHERE quality = 1), live AS (SELECT doc_id AS id FROM documents WHERE n_chars > 500)
SELECT CASE WHEN l.id IS NULL THEN 'missing' WHEN d.id IS NULL THEN 'unexpected' ELSE 'both' END AS state, count(*) AS n FROM declared d FULL JOIN live l ON d.id = l.id GROUP BY 1""")
def live_set_diff(spark, sf_dir):
    from ..integrity.verify import compare_sets

    declared = read(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id")).distinct()
    live = read(spark, sf_dir, "documents").where("n_chars > 500").select(F.col("doc_id").alias("id"))
    return compare_sets(declared, live, "id").groupBy("state").agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) % 4 AS ordinal FROM documents)
SELECT source, lang, ordinal, count(*) AS n, min(doc_id) AS first_id FROM d GROUP BY ALL HAVING count(*) > 1""")
def duplicate_locators(spark, sf_dir):
    from ..integrity.verify import duplicates

    ordinal = F.row_number().over(Window.partitionBy("source", "lang").orderBy("doc_id")) % 4
    rows = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", ordinal.cast("bigint").alias("ordinal"))
    return duplicates(rows, ["source", "lang", "ordinal"], F.min("doc_id").alias("first_id"))


@query("""SELECT CASE WHEN l.doc_id IS NULL THEN 'refused' WHEN l.quality = 0 THEN 'differs' ELSE 'eligible' END AS outcome, count(*) AS n
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id, quality FROM labels) l ON l.doc_id = d.doc_id GROUP BY 1""")
def parent_eligibility(spark, sf_dir):
    from ..integrity.verify import against_parent

    mine = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("quality"))
    parent = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"), F.col("quality").cast("int").alias("quality")).distinct()
    return against_parent(mine, parent, ["quality"]).groupBy("outcome").agg(F.count("*").alias("n"))


@query("""WITH docs AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Brand#' || (doc_id % 60) WHEN doc_id % 3 = 1 THEN 'x_brand#' || (doc_id % 60) || '_v2' ELSE 'none' || doc_id END AS stem FROM documents),
keys AS (SELECT lower(p_brand) AS key, min(p_partkey) AS ord FROM part GROUP BY 1),
exact AS (SELECT d.doc_id, k.key, 'exact' AS matched FROM docs d JOIN keys k ON k.key = lower(d.stem)),
within AS (SELECT d.doc_id, k.key, 'contains' AS matched FROM docs d JOIN keys k ON contains(lower(d.stem), k.key) WHERE d.doc_id NOT IN (SELECT doc_id FROM exact) QUALIFY row_number() OVER (PARTITION BY d.doc_id ORDER BY k.ord) = 1)
SELECT d.doc_id, m.key, m.matched FROM docs d LEFT JOIN (SELECT * FROM exact UNION ALL SELECT * FROM within) m ON m.doc_id = d.doc_id""")
def bib_join(spark, sf_dir):
    i = F.col("doc_id")
    n = (i % 60).cast("string")
    stem = F.when(i % 3 == 0, F.concat(F.lit("Brand#"), n)).when(i % 3 == 1, F.concat(F.lit("x_brand#"), n, F.lit("_v2"))).otherwise(F.concat(F.lit("none"), i.cast("string")))
    keyed = read(spark, sf_dir, "part").groupBy(F.lower("p_brand").alias("key")).agg(F.min("p_partkey").alias("key_order"))
    found = bibliography.join_documents(read(spark, sf_dir, "documents").select("doc_id", stem.alias("stem")), keyed)
    return found.select("doc_id", "key", "matched")


@query("SELECT event_type AS action, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n FROM events GROUP BY ALL")
def journal_by_action(spark, sf_dir):
    from ..streaming.journal import counts_by_action

    return counts_by_action(read(spark, sf_dir, "events"), action="event_type").select("action", F.col("start").alias("day"), "n")


_LEGACY_ID = "CASE doc_id % 4 WHEN 0 THEN 'chk-' || doc_id WHEN 1 THEN 'chk-a' || doc_id WHEN 2 THEN 'CHK-' || left(sha256(doc_id::VARCHAR), 32) ELSE 'row ' || doc_id END"


@query(rf"""WITH r AS (SELECT doc_id, {_LEGACY_ID} AS chunk_id, CASE WHEN doc_id % 5 <> 0 THEN 'ART-1' END AS parent FROM documents)
SELECT doc_id, regexp_matches(chunk_id, '^chk-[0-9a-z]+$') AS legacy_id, regexp_matches(chunk_id, '^chk-\d+$') AS ordinal_id, parent IS NULL AS no_parent, regexp_matches(chunk_id, '^(?:CHK-)[A-Za-z0-9][A-Za-z0-9._-]*$') AS valid_id FROM r""")
def classify_legacy(spark, sf_dir):
    from ..integrity.recovery import legacy_signals

    i = F.col("doc_id").cast("string")
    kinds = (F.concat(F.lit("chk-"), i), F.concat(F.lit("chk-a"), i), F.concat(F.lit("CHK-"), F.substring(F.sha2(i.cast("binary"), 256), 1, 32)), F.concat(F.lit("row "), i))
    which = F.pmod("doc_id", F.lit(4))
    chunk_id = F.when(which == 0, kinds[0]).when(which == 1, kinds[1]).when(which == 2, kinds[2]).otherwise(kinds[3])
    rows = read(spark, sf_dir, "documents").select("doc_id", chunk_id.alias("chunk_id"), F.when(F.col("doc_id") % 5 != 0, "ART-1").alias("parent_artifact_id"))
    return legacy_signals(rows).select("doc_id", "legacy_id", "ordinal_id", "no_parent", text.valid_identifier("chunk", F.col("chunk_id")).alias("valid_id"))


@query(r"""WITH r AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '/etc/x' WHEN 1 THEN 'a/../b' WHEN 2 THEN 'Bearer abcdefghijkl' WHEN 3 THEN 'sk-' || left(sha256(doc_id::VARCHAR), 24) ELSE source END AS value, text FROM documents)
SELECT doc_id, doc_id % 5 <> 4 AS leaks, regexp_matches(text, '\b(sk-[A-Za-z0-9]{8,}|ghp_[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{12,})\b') OR regexp_matches(text, '\bbearer\s+\S+', 'i')
  OR regexp_matches(text, 'os\.environ|getenv\s*\(|process\.env|\benv\(|\$ENV\{|\$\{ENV|ENV\[', 'i') AS text_leaks FROM r""")
def leak_scan(spark, sf_dir):
    from ..integrity.verify import leaks, secrets

    i = F.pmod("doc_id", F.lit(5))
    secret = F.concat(F.lit("sk-"), F.substring(F.sha2(F.col("doc_id").cast("string").cast("binary"), 256), 1, 24))
    value = F.when(i == 0, "/etc/x").when(i == 1, "a/../b").when(i == 2, "Bearer abcdefghijkl").when(i == 3, secret).otherwise(F.col("source"))
    return read(spark, sf_dir, "documents").select("doc_id", leaks(F.lit("note"), value).alias("leaks"), secrets(F.col("text")).alias("text_leaks"))


@query(f"""WITH {_CHUNKS} SELECT chunk_id, workspace_id, doi, title, authors, year, section, replace(path, ' > ', ' > ') AS section_hierarchy, section_category, paradigm FROM chunks""")
def store_rows(spark, sf_dir):
    from ..sources.rows import to_store_row

    found = to_store_row(_study_chunks(spark, sf_dir))
    return found.select("chunk_id", "workspace_id", "doi", "title", "authors", "year", "section", "section_hierarchy", "section_category", "paradigm")


@query("""SELECT s.s_suppkey AS id, CASE WHEN intent IS NULL THEN 'NO_INTENT' WHEN owner THEN 'OWNERSHIP' WHEN accepted THEN 'POST_CHECK_7' WHEN live_prev THEN 'PRE_R5' WHEN stored AND prev AND within THEN 'R5_TO_R6' WHEN stored THEN 'R5_TO_CHECK_7' ELSE 'UNREADABLE_STATE' END AS row
FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 7 <> 0 THEN 1 END AS intent, s_suppkey % 11 = 0 AS owner, s_suppkey % 5 = 0 AS accepted, s_suppkey % 3 = 0 AS live_prev, s_suppkey % 2 = 0 AS stored, s_suppkey % 4 = 0 AS prev, s_suppkey % 8 = 0 AS within FROM supplier) s""")
def recovery_rows(spark, sf_dir):
    from ..integrity.recovery import classify_column

    k = F.col("s_suppkey")
    facts = {
        "has_intent": k % 7 != 0, "parent_changed": k % 11 == 0, "candidate_accepted": k % 5 == 0, "live_is_previous": k % 3 == 0,
        "candidate_stored": k % 2 == 0, "previous_stored": k % 4 == 0, "candidate_within_live": k % 8 == 0,
    }
    return read(spark, sf_dir, "supplier").select(k.alias("id"), classify_column(facts).alias("row"))
