"""Operator 4: near-duplicates by MinHash bands, odd sketches and exact confirmation.

A document's set holds its distinct 5-word shingles (fewer words: the whole
sequence).  Documents with equal sets form a class, and only classes are compared.
Bands of MinHash values put classes into buckets; two sets at the threshold miss
each other in all bands with a chance under one in a million.  ``LAYOUTS`` has the
bands and the values in each by the threshold: 85 percent is that of the op4 query,
80 that of the stage of the pipeline.

The MinHash samples of a set are folded into an odd sketch, a bitmap of parities of
``SAMPLE_BITS`` bits.  Equal samples cancel in the xor of two sketches, so from its
population count the similarity is estimated (``estimate``).  Candidates whose
estimate is so low that a pair at the threshold falls under it with a chance below
``MISS`` are dropped (``least_estimate``).  A hundred samples cannot tell 0.80 from
0.85, so a second odd sketch folds every shingle of the set.  Its population count
never exceeds the symmetric difference of the sets, which the similarity bounds:
it drops almost every candidate below the threshold and none above it.  What is
left is confirmed on the full sets, in whole numbers, shingles being compared by
64-bit hashes.

Only components are asked for, so within a bucket not all pairs are compared.
First its least class is compared with all others.  In buckets that then still
hold several components, ``PIVOTS`` classes of the first one's component are
compared with those outside it, ``TRIES`` times.  What is left over are mostly
classes that are like nothing: ``STRAYS`` of them at a time are compared with all
of their bucket outside their component, until each had its turn.  Then every
pair of a bucket was compared, or lies within one component: no candidate is lost
or capped, and a bucket of copies costs a few comparisons each.

Null and blank texts have an empty set and are linked with nothing.  Rows are told
apart by id and text.  Rows with a null id are linked like others, but cannot
name a component: where no other row can, ``component_id`` is null and the row is
kept.  Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh3_64_intdigest

from .common import frugal, is_small, join_checked, materialise, small_batches

SHINGLE, PERCENT = 5, 85
SKETCH_BITS, SAMPLE_BITS, MISS = 2048, 512, 1e-7
LAYOUTS = {85: (24, 5), 80: (27, 4)}
_HASHES, _MOST_ROWS = max(b * r for b, r in LAYOUTS.values()), max(r for _, r in LAYOUTS.values())
PIVOTS, TRIES, STRAYS = 8, 2, 1024
_rng = np.random.default_rng(20_240_601)
_FACTORS = _rng.integers(0, 1 << 63, _HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _rng.integers(0, 1 << 63, _HASHES, np.uint64)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(max(SHINGLE, _MOST_ROWS))], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z, and space and \\t..\\r, alone
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n)
    size = min(n, SHINGLE)
    sums = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        sums += each[k : n - size + 1 + k] * _POWERS[k]
    return np.unique(_mixed(sums))


def min_hashes(shingles: np.ndarray, n: int) -> np.ndarray:
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048]
        np.minimum(least, (part[None, :] * _FACTORS[:n, None] + _OFFSETS[:n, None]).min(1), out=least)
    return least


def bands(least: np.ndarray, n: int) -> np.ndarray:
    rows = _mixed(least).reshape(n, -1)
    return _mixed((rows * _POWERS[None, : rows.shape[1]]).sum(1, dtype=np.uint64) + np.arange(n, dtype=np.uint64)).view(np.int64)


def odd_sketch(members: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parities of how many members fall on each bit, as 64-bit words."""
    odd = np.bincount((members % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sample_sketch(least: np.ndarray) -> np.ndarray:
    """The odd sketch of MinHash samples, each told apart by which hash it is the least of."""
    return odd_sketch(_mixed(least + np.arange(len(least), dtype=np.uint64) * _POWERS[1]), SAMPLE_BITS)


def estimate(apart: int, samples: int) -> float:
    """The similarity that a population count of the xor of two sample sketches speaks for."""
    share = 1 - 2 * apart / SAMPLE_BITS
    return 1 + SAMPLE_BITS / (4 * samples) * math.log(share) if share > 0 else -math.inf


def least_estimate(samples: int, percent: int) -> tuple[float, int]:
    """The estimate below which candidates go, and the population count that has it.

    Of the samples of two sets at the threshold more than ``d`` differ with a chance below
    ``MISS``; samples that differ set two bits each at most.
    """
    differ, tail, d = 1 - percent / 100, 1.0, -1
    while tail >= MISS:
        d += 1
        tail -= math.comb(samples, d) * differ**d * (1 - differ) ** (samples - d)
    most = min(2 * d, SAMPLE_BITS // 2 - 1)
    return estimate(most, samples), most


def _signatures(docs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, text_hash, class, n_shingles, bands, sketch) of every row."""
    n_bands, n_rows = LAYOUTS[percent]

    def run(batches):
        for batch in batches:
            sets = [shingle_set(value.as_py()) for value in batch.column(2)]
            least = [min_hashes(s, n_bands * n_rows) if len(s) else None for s in sets]
            columns = [
                batch.column(0),
                batch.column(1),
                pa.array([xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([bands(m, n_bands) if m is not None else [] for m in least], pa.list_(pa.int64())),
                pa.array([odd_sketch(s) if len(s) else [] for s in sets], pa.list_(pa.int64())),
                pa.array([sample_sketch(m) if m is not None else [] for m in least], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "cls", "n_shingles", "bands", "sketch", "samples"])

    return docs.mapInArrow(frugal(run), "doc_id bigint, text_hash bigint, cls binary, n_shingles bigint, bands array<bigint>, sketch array<bigint>, samples array<bigint>")


def _may_reach(a: str, b: str, percent: int) -> Column:
    """Whether two classes can reach the threshold, by sizes and sketches."""
    na, nb = F.col(f"{a}_size"), F.col(f"{b}_size")
    apart = lambda of, bits: sum((F.bit_count(F.get(F.col(f"{a}_{of}"), k).bitwiseXOR(F.get(F.col(f"{b}_{of}"), k))) for k in range(bits // 64)), F.lit(0))
    _, most = least_estimate(math.prod(LAYOUTS[percent]), percent)
    near = (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (apart("samples", SAMPLE_BITS) <= most)
    # 100 * both >= percent * (na + nb - both) bounds the difference na + nb - 2 * both
    return near & ((100 + percent) * apart("sketch", SKETCH_BITS) <= (100 - percent) * (na + nb))


def _confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of candidate pairs (a, b) those whose full sets reach the threshold."""
    named = lambda x: texts.select(F.col("cls").alias(x), F.col("text").alias(f"{x}_text"))
    pairs = materialise(pairs, "candidate-pairs", ids_only=True)
    few = is_small(pairs)  # then the texts stay where they are
    one = named("b").join(F.broadcast(pairs) if few else pairs, "b")
    ends = materialise(pairs.select("a").distinct(), "candidate-ends", ids_only=True)
    two = named("a").join(F.broadcast(ends) if few else ends, "a", "left_semi")
    with_texts = one.join(two, "a").select("a", "b", "a_text", "b_text")

    def run(batches):
        last, first = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            yes = []
            for i, name in enumerate(a):
                if name != last:
                    last, first = name, shingle_set(batch.column(2)[i].as_py())
                second = shingle_set(batch.column(3)[i].as_py())
                both = len(np.intersect1d(first, second, assume_unique=True))
                yes.append(100 * both >= percent * (len(first) + len(second) - both))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"]).filter(pa.array(yes, pa.bool_()))

    return with_texts.mapInArrow(frugal(run), "a binary, b binary")


def components(edges: DataFrame, name: str = "labels") -> DataFrame:
    """(cls, label) of every end of ``edges`` (a, b): the least class reachable.

    Labels spread along edges, and each label is replaced by its own label, so a
    chain shortens by more than half in each round.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialise(both.groupBy(F.col("a").alias("cls")).agg(F.least(F.min("b"), F.first("a")).alias("label")), name, ids_only=True)
    while True:
        near = both.join(labels.withColumnsRenamed({"cls": "b"}), "b").groupBy(F.col("a").alias("cls")).agg(F.min("label").alias("near"))
        spread = labels.join(near, "cls").select("cls", "label", F.least("label", "near").alias("to"))
        jump = labels.select(F.col("cls").alias("to"), F.col("label").alias("jump"))
        moved = materialise(spread.join(jump, "to", "left").select("cls", "label", F.least("to", F.coalesce("jump", "to")).alias("next")), name, ids_only=True)
        done = moved.where("label <> next").isEmpty()
        labels = moved.select("cls", F.col("next").alias("label"))
        if done:
            return labels


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links (a, b) between labelled classes."""
    of = lambda x: labels.select(F.col("cls").alias(x), F.col("label").alias(f"{x}_label"))
    ends = links.join(of("a"), "a").join(of("b"), "b").select(F.col("a_label").alias("a"), F.col("b_label").alias("b")).where("a <> b").distinct()
    moved = components(materialise(ends, "label-links", ids_only=True), "merged-labels").select(F.col("cls").alias("label"), F.col("label").alias("to"))
    out = join_checked(labels, moved, "label", "left").select("cls", F.coalesce("to", "label").alias("label"))
    return materialise(out, "labels", ids_only=True)


def _linked(classes: DataFrame, members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(cls, label) of all classes in shared buckets."""
    about = classes.select("cls", "sketch", "samples", F.col("n_shingles").alias("size"))
    of = lambda x: about.select(F.col("cls").alias(x), F.col("sketch").alias(f"{x}_sketch"), F.col("samples").alias(f"{x}_samples"), F.col("size").alias(f"{x}_size"))
    stars = members.where("cls <> first").select(F.col("first").alias("a"), F.col("cls").alias("b")).distinct()
    near = stars.join(of("b"), "b").join(of("a"), "a").where(_may_reach("a", "b", percent)).select("a", "b")
    links = materialise(_confirm(near, texts, percent), "links", ids_only=True)
    alone = members.select("cls").distinct().join(components(links), "cls", "left")
    labels = materialise(alone.select("cls", F.coalesce("label", "cls").alias("label")), "labels", ids_only=True)

    left, turn, tried = members, 0, None
    while True:
        here = left.select("bucket", "cls", "first").join(labels, "cls")
        mixed = here.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
        main = labels.select(F.col("cls").alias("first"), F.col("label").alias("first_label"))
        left = here.join(mixed, "bucket", "left_semi").join(main, "first").select("bucket", "cls", "first", "label", "first_label")
        left = materialise(left, "unsettled", ids_only=True)
        by_turn = Window.partitionBy("bucket").orderBy(F.xxhash64("cls", F.lit(turn)), "cls")
        if turn < TRIES:
            pivots, most = left.where("label = first_label"), PIVOTS
        else:
            pivots, most = left.where("label <> first_label"), STRAYS
            pivots = pivots if tried is None else pivots.join(tried, ["bucket", "cls"], "left_anti")
        pivots = materialise(pivots.withColumn("_k", F.row_number().over(by_turn)).where(F.col("_k") <= most).select("bucket", "cls", "label"), "pivots", ids_only=True)
        if pivots.isEmpty():
            return labels
        if turn >= TRIES:
            now = pivots.select("bucket", "cls")
            tried = now if tried is None else tried.unionByName(now)
        a = pivots.select("bucket", F.col("cls").alias("a"), F.col("label").alias("a_label")).join(of("a"), "a")
        b = left.select("bucket", F.col("cls").alias("b"), F.col("label").alias("b_label")).join(of("b"), "b")
        pairs = b.join(a, (b["bucket"] == a["bucket"]) & (F.col("a_label") != F.col("b_label")) & _may_reach("a", "b", percent))
        found = materialise(_confirm(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), texts, percent), "links", ids_only=True)
        if not found.isEmpty():
            labels = _relabelled(labels, found)
        turn += 1


def _labelled(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, cls, n_shingles, ...) of every row, and (cls, label) of all classes in shared buckets."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    signed = materialise(_signatures(rows, percent), "signatures")
    full = signed.where("n_shingles > 0")
    classes = materialise(
        full.groupBy("cls", "n_shingles").agg(F.min(F.struct("doc_id", "text_hash")).alias("row"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("samples").alias("samples")),
        "classes",
    )
    banded = classes.select(F.explode("bands").alias("bucket"), "cls")
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min("cls").alias("first")).where("n > 1").select("bucket", "first")
    members = materialise(banded.join(shared, "bucket"), "buckets")  # (bucket, cls, first)
    near = classes.join(members.select("cls").distinct(), "cls", "left_semi").select("cls", "n_shingles", "sketch", "samples", "row")
    near = materialise(near, "near-classes")

    want = near.select("cls", F.col("row.doc_id").alias("_id"), F.col("row.text_hash").alias("_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("text_hash").eqNullSafe(F.col("_hash"))
    texts = materialise(join_checked(rows, want, same, "inner").select("cls", "text").dropDuplicates(["cls"]), "candidate-texts")
    return signed, _linked(near, members, texts, percent)


def deduplicate(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Set size, component and whether it stands for its component, of every row.

    Two sets are linked at a similarity of ``percent`` in a hundred or more.
    """
    signed, labels = _labelled(docs, percent)
    full = signed.where("n_shingles > 0")
    named = signed.select("doc_id", "cls", "n_shingles").join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    least = full.select("cls", "doc_id").groupBy("cls").agg(F.min("doc_id").alias("doc_id")).join(labels, "cls", "left")
    least = least.groupBy(F.coalesce("label", "cls").alias("label")).agg(F.min("doc_id").alias("least"))
    out = named.join(least, "label", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def redundant(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash) of the rows that go if one row of each component stays,
    and of those that stay but stand in several equal rows.

    The row of least id stays, then that of least hash; a null id comes last.
    """
    signed, labels = _labelled(docs, percent)
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    rows = materialise(signed.where("n_shingles > 0").groupBy("cls", "doc_id", "text_hash").agg(F.count("*").alias("n")).join(labels, "cls", "left"), "rows-of-components", ids_only=True)
    rows = rows.withColumn("label", F.coalesce("label", "cls")).withColumn("row", row)
    stays = rows.groupBy("label").agg(F.min("row").alias("stays"))
    gone = rows.join(stays, "label").where(~F.col("row").eqNullSafe(F.col("stays"))).select("doc_id", "text_hash")
    blank = signed.where("n_shingles = 0").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"))
    again = rows.select("doc_id", "text_hash", "n").unionByName(blank).where("n > 1").select("doc_id", "text_hash")
    return gone, again
