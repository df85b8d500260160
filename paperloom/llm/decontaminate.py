"""Operator 1: benchmark decontamination by winnowing, in DataFrame operations alone.

Words are maximal runs of digits, letters and characters beyond ASCII, with A-Z
lower-cased.  A text's k-grams of words are hashed, and of each ``WINDOW`` words
in a row the least hash is a fingerprint.  Two texts that share a span of
``WINDOW`` words share its fingerprint, so no such span is missed.  Documents and
benchmark items are joined on fingerprints; each hit is then extended to its
whole window and compared word by word, which removes chance matches.  An item of
fewer words, but not none, is one window of its own length.

The first pass over the documents carries hashes alone; texts are read again only
of documents that share a fingerprint.  The benchmark side is broadcast if its
checked size is small, and shuffled otherwise.

Null texts have no words, no hits and no items.  Rows are told apart by id and
text: a null id is an id like any other, and equal rows each get the result.
Items with a null id are searched for, but have no id to list.  An empty
benchmark leaves every document clean; columns other than the id and the text
are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import is_small, join_checked, materialise

GRAM, WINDOW = 5, 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fingerprints of the benchmark that are broadcast at most.
BROADCAST_FINGERPRINTS = 500_000


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, other characters as they are."""
    plain = F.octet_length(text) == F.char_length(text)  # then lower() does just that, and faster
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _upto(last: Column) -> Column:
    """0..last; no numbers if last is negative."""
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _at(column: str, i: Column, n: int) -> list[Column]:
    return [F.get(F.col(column), i + k) for k in range(n)]


def _grams(size: int) -> Column:
    """Hashes of the ``size`` words at each place."""
    return F.transform(_upto(F.col("n_words") - size), lambda i: F.xxhash64(F.lit(size), *_at("_h", i, size)))


def with_fingerprints(df: DataFrame, short: list[int]) -> DataFrame:
    """Adds ``words``, ``n_words``, and by window length the fingerprint of the
    window at each place: ``f{WINDOW}``, and ``f1`` to ``f9`` for those in ``short``."""
    n = F.col("n_words")
    out = (
        df.withColumn("words", words(F.col("text")))
        .withColumn("n_words", F.size("words"))
        .withColumn("_h", F.transform("words", lambda w: F.xxhash64(w)))
        .withColumn("_g", F.transform(_upto(n - GRAM), lambda i: F.xxhash64(*_at("_h", i, GRAM))))
        .withColumn(f"f{WINDOW}", F.transform(_upto(n - WINDOW), lambda i: F.least(*_at("_g", i, WINDOW - GRAM + 1))))
    )
    for size in short:
        out = out.withColumn(f"f{size}", _grams(size))
    return out.drop("_h", "_g")


def _windows(sizes: list[int], wanted: Column | None = None) -> Column:
    """The windows of a row: start, length, fingerprint and words; only those whose
    fingerprint is in ``wanted``, if that is given."""

    def of(size: int) -> Column:
        starts = _upto(F.col("n_words") - size)
        prints = F.col(f"f{size}")
        if wanted is not None:
            starts = F.filter(starts, lambda i: F.array_contains(wanted, F.get(prints, i)))
        return F.transform(
            starts,
            lambda i: F.struct(i.alias("start"), F.lit(size).alias("length"), F.get(prints, i).alias("print"), F.array_join(F.slice(F.col("words"), i + 1, size), " ").alias("window")),
        )

    return F.concat(*map(of, sizes))


def _covered(spans: Column) -> Column:
    """Words in the union of sorted (start, end) spans."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))

    def step(so_far: Column, span: Column) -> Column:
        end = F.greatest(so_far["end"], span["end"])
        return F.struct(end.alias("end"), (so_far["n"] + end - F.greatest(so_far["end"], F.least(span["start"], end))).cast("bigint").alias("n"))

    return F.aggregate(spans, zero, step, lambda x: x["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, with_hash: bool = False) -> DataFrame:
    """Words hit and items found in every document; ``with_hash`` adds ``text_hash``."""
    items = benchmark.select(F.col("item_id"), F.col("text").cast("string").alias("text"))
    # at most WINDOW - 1 different lengths
    short = sorted(r[0] for r in items.select(F.size(words(F.col("text"))).alias("n")).where((F.col("n") > 0) & (F.col("n") < WINDOW)).distinct().collect())
    sizes = [WINDOW, *short]
    own_size = F.when(F.col("n_words") >= WINDOW, WINDOW).otherwise(F.col("n_words"))
    sought = materialise(
        with_fingerprints(items, short)
        .withColumn("_w", F.explode(F.filter(_windows(sizes), lambda w: w["length"] == own_size)))
        .select("item_id", "_w.print", "_w.window")
        .distinct(),
        "sought-windows",
    )
    prints = sought.select("print").distinct()

    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    marked = with_fingerprints(keyed, short).select("doc_id", "text_hash", F.col("n_words").cast("bigint").alias("n_words"), F.array_distinct(F.concat(*(F.col(f"f{s}") for s in sizes))).alias("prints"))
    if is_small(prints, BROADCAST_FINGERPRINTS):
        # one more, null print gives every document a row
        each = marked.select("doc_id", "text_hash", "n_words", F.explode(F.concat("prints", F.array(F.lit(None).cast("bigint")))).alias("print"))
        found = each.join(F.broadcast(prints.withColumn("sought", F.lit(True))), "print", "left").where("sought or print is null")
    else:
        each = marked.select("doc_id", "text_hash", "n_words", F.explode("prints").alias("print")).join(prints, "print", "left_semi")
        found = each.unionByName(marked.select("doc_id", "text_hash", "n_words", F.lit(None).cast("bigint").alias("print")))
    found = materialise(found.groupBy("doc_id", "text_hash").agg(F.max("n_words").alias("n_words"), F.collect_set("print").alias("prints")), "shared-prints")

    suspects = found.where(F.size("prints") > 0)
    some = suspects.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    texts = join_checked(keyed, some, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left_semi")
    same = texts["doc_id"].eqNullSafe(suspects["doc_id"]) & (texts["text_hash"] == suspects["text_hash"])
    both = texts.dropDuplicates(["doc_id", "text_hash"]).join(suspects, same).select(texts["doc_id"], texts["text_hash"], "text", "prints")
    hits = (
        with_fingerprints(both, short)
        .select("doc_id", "text_hash", F.explode(_windows(sizes, F.col("prints"))).alias("_w"))
        .select("doc_id", "text_hash", "_w.*")
    )
    key = ["doc_id", "text_hash"]
    hits = materialise(join_checked(hits, sought.select("print", "window").distinct(), ["print", "window"], "left_semi"), "window-hits")
    spans = hits.groupBy(*key).agg(_covered(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end"))))).alias("n_hit"))
    listed = (
        join_checked(hits.select(*key, "window").distinct(), sought.select("window", F.col("item_id").cast("string").alias("item")), "window", "inner")
        .groupBy(*key)
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    rows = keyed.select("doc_id", "text_hash")
    out = rows.alias("r")
    for other in (found.select(*key, "n_words"), spans, listed):
        renamed = other.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
        out = out.join(renamed, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("text_hash").eqNullSafe(F.col("_hash")), "left").drop("_id", "_hash")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return out.select(
        "doc_id",
        *(["text_hash"] if with_hash else []),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items_of).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items_of, ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM bw
), dw AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n, -1) + 2)) AS i FROM d, sizes)
), hit AS (SELECT dw.* FROM dw WHERE EXISTS (SELECT 1 FROM bw WHERE bw.n = dw.n AND bw.win = dw.win)
), hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT hit.doc_id, bw.item_id::VARCHAR AS item FROM hit JOIN bw ON bw.n = hit.n AND bw.win = hit.win) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw ON hw.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id
"""
