"""Operator 6: removal of repeated byte strings by a hash-compared suffix sort.

A byte goes if a string of ``LENGTH`` bytes over it also starts anywhere else.
So every suffix matters by its first ``LENGTH`` bytes, its window, alone.

1. Of each window the rightmost of the least k-gram hashes is its anchor.  Equal
   windows have the same anchor at the same place, so only windows whose anchor
   hash occurs twice can repeat; all others are dropped before any text moves.
2. What is left is dealt by anchor hash: for each run of windows with one anchor
   the bytes that they span.  A task gets whole groups of equal anchor hash and
   sorts their suffixes by mergesort, comparing windows by polynomial hashes that
   come from prefix sums.  From each suffix that stands next to an equal one,
   binary search over the prefix hashes finds how far both go on alike, and that
   whole common extension is compared byte by byte: a collision removes nothing.
   Runs of one anchor hash that follow each other, as in periodic text, are one run
   of up to ``RUN_WINDOWS`` windows: their bytes overlap almost wholly.
3. An anchor hash with over ``SPLIT`` occurrences is dealt to several tasks.  Each
   settles what repeats within its share; the distinct windows of the shares are
   then grouped by digest, which settles the rest.

4. Only texts that lose something are shuffled to meet what they lose; a bitmap of
   fixed size tells which, and those that it names wrongly just find nothing.

The order of the sort is that of the hashes, not of the bytes; only which windows
are equal is used.  Strings are judged on the input, not on what is left.

The filter of step 1 is a bitmap of fixed size if few enough hashes repeat, and a
shuffle join beyond that.  Null texts are empty; texts of under ``LENGTH`` bytes
lose nothing.

All this works on units of a text: bytes, or its words, each as 8 bytes of hash.  By
words a passage is caught however few bytes its words take; what goes is then all
from the first byte of its first word to the last byte of its last.

Rows are told apart by id and text; equal rows are copies of each other like any
copies.  All columns of the input are carried through but those of the names that
are added: ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` and ``kept_sha256``.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from .common import free_names, frugal, join_checked, materialise, small_batches

LENGTH, GRAM = 400, 64
SPLIT = 4_096
#: Windows that a task sorts at once, starts of windows of a text hashed at once, and windows of a run.
BLOCK_WINDOWS, SEGMENT, RUN_WINDOWS = 1 << 19, 1 << 20, 1 << 16
#: Bytes of runs that a task holds before it hands them on.
EMIT_BYTES = 4 << 20
#: Bits of the filter (a power of two), and the repeated hashes that it takes at most.
FILTER_BITS = 1 << 26
FILTER_HASHES = FILTER_BITS // 16


class Unit(NamedTuple):
    """What windows are counted in: ``length`` units a window, ``gram`` a gram."""

    length: int
    gram: int
    kind: type  # of a unit in arrays

    @property
    def size(self) -> int:
        return np.dtype(self.kind).itemsize


BYTES = Unit(LENGTH, GRAM, np.uint8)
WORD_GRAM = 10
_WORD = re.compile(rb"\S+")


def of_words(length: int) -> Unit:
    return Unit(length, min(WORD_GRAM, length), np.uint64)


def units(text: str, unit: Unit) -> np.ndarray:
    data = text.encode()
    if unit.kind is np.uint8:
        return np.frombuffer(data, np.uint8)
    return np.array([xxh3_64_intdigest(word) for word in data.split()], np.uint64)


_TABLE = np.random.default_rng(99).integers(0, (1 << 64) - 1, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64((1 << 22) - 1)  # place within a segment
_powers: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers[k] = np.multiply.accumulate(factors)
    return _powers[0][:n], _powers[1][:n]


def prefix_hashes(data: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Sums of the weighted units before each place; ``at`` gives the exponents."""
    up, _ = powers(len(data) if at is None else int(at.max(initial=0)) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_TABLE[data] if data.dtype == np.uint8 else data) * (up if at is None else up[at]), out=out[1:])
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x) - w + 1
    blocks = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchored_runs(data: np.ndarray, unit: Unit = BYTES):
    """(hash, first start, windows) of each run of windows that share an anchor."""
    length, gram = unit.length, unit.gram
    prints, firsts, counts = [], [], []
    for base in range(0, max(len(data) - length + 1, 0), SEGMENT):
        part = data[base : base + SEGMENT + length - 1]
        prefix = prefix_hashes(part)
        grams = _mixed((prefix[gram:] - prefix[:-gram]) * powers(len(part) - gram + 1)[1])
        keys = (grams & ~_LOW) | (_LOW - np.arange(len(grams), dtype=np.uint64))
        place = (_LOW - (_sliding_min(keys, length - gram + 1) & _LOW)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        prints.append(grams[place[first]].view(np.int64))
        firsts.append(first + base)
        counts.append(np.diff(np.append(first, len(place))))
    if not prints:
        return (np.zeros(0, np.int64),) * 3
    return tuple(map(np.concatenate, (prints, firsts, counts)))


def merged_runs(prints: np.ndarray, firsts: np.ndarray, counts: np.ndarray):
    """Runs that follow each other with one anchor hash as one, of ``RUN_WINDOWS`` windows or one run
    at most; and how many each is made of."""
    if not len(prints):
        return prints, firsts, counts, counts
    new = np.append(True, prints[1:] != prints[:-1])
    group = np.flatnonzero(new)[np.cumsum(new) - 1]
    new[1:] |= (firsts[1:] - firsts[group[1:]]) // RUN_WINDOWS != (firsts[:-1] - firsts[group[:-1]]) // RUN_WINDOWS
    start = np.flatnonzero(new)
    return prints[start], firsts[start], np.add.reduceat(counts, start), np.diff(np.append(start, len(prints)))


def repeated_runs(parts: list[bytes], windows: np.ndarray, unit: Unit = BYTES):
    """Which windows of a block repeat within it.

    ``parts`` are byte strings, each over ``windows[i]`` windows.  Returns a mask
    over all windows, the place of the first equal window of each, and where the
    windows of each part begin.
    """
    length, wide = unit.length, unit.size
    sizes = np.array([len(p) // wide for p in parts])
    begin = np.cumsum(sizes) - sizes
    first = np.cumsum(windows) - windows
    flat = np.frombuffer(b"".join(parts), unit.kind)
    local = np.arange(len(flat)) - np.repeat(begin, sizes)
    prefix = prefix_hashes(flat, local)
    at = np.arange(int(windows.sum())) - np.repeat(first, windows)
    start = at + np.repeat(begin, windows)
    _, down = powers(int(at.max(initial=0)) + 1)
    key = (prefix[start + length] - prefix[start]) * down[at]
    order = np.argsort(key, kind="stable")  # mergesort
    new = np.append(True, np.diff(key[order]) != 0)
    leader = np.empty(len(key), np.int64)
    leader[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    size = np.diff(np.append(np.flatnonzero(new), len(key)))
    alike = np.zeros(len(key), bool)
    alike[order] = size[np.cumsum(new) - 1] > 1
    # the leader of a class is compared with the next of it, every other with the leader
    other = leader.copy()
    heads = order[np.flatnonzero(new)[size > 1]]
    other[heads] = order[np.flatnonzero(new)[size > 1] + 1]
    part_of = np.repeat(np.arange(len(parts)), windows)
    inverse = powers(int(sizes.max(initial=0)) + 1)[1]

    def same(a: int, b: int, n: int) -> bool:
        """Whether the n units from two places hash alike."""
        x = (int(prefix[a + n]) - int(prefix[a])) * int(inverse[local[a]])
        y = (int(prefix[b + n]) - int(prefix[b])) * int(inverse[local[b]])
        return (x - y) & 0xFFFFFFFFFFFFFFFF == 0

    proven = np.zeros(len(key), bool)
    whole = flat.tobytes()
    ends = begin + sizes
    todo = np.flatnonzero(alike)
    i = 0
    while i < len(todo):
        e = int(todo[i])
        o = int(other[e])
        a, b = int(start[e]), int(start[o])
        most = min(int(ends[part_of[e]]) - a, int(ends[part_of[o]]) - b)
        low, high = length, most
        while low < high:  # the common extension
            middle = (low + high + 1) // 2
            if same(a, b, middle):
                low = middle
            else:
                high = middle - 1
        if whole[a * wide : (a + low) * wide] == whole[b * wide : (b + low) * wide]:
            proven[e : e + low - length + 1] = True
            i = int(np.searchsorted(todo, e + low - length + 1))
        else:  # a collision: look at all windows of that hash
            same_key = np.flatnonzero(key == key[e])
            mine = whole[a * wide : (a + length) * wide]
            proven[e] = any(w != e and whole[start[w] * wide : (start[w] + length) * wide] == mine for w in same_key.tolist())
            i += 1
    return proven, leader, first, start, whole


def _ranges(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


_KEY = ["rid", "rid2"]
ADDED = ("n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")


def _keys(text: Column) -> dict[str, Column]:
    return {"rid": F.xxhash64("doc_id", text), "rid2": F.hash(text, "doc_id")}


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(*(key.alias(name) for name, key in _keys(text).items()), text.alias("text"))


def _long(unit: Unit) -> Column:
    """Whether a text may hold a window; n words take 2 * n - 1 bytes at least."""
    return F.octet_length("text") >= (unit.length if unit.kind is np.uint8 else 2 * unit.length - 1)


def _anchors(rows: DataFrame, unit: Unit) -> DataFrame:
    def run(batches):
        for batch in batches:
            for r, r2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                prints, _, _, made_of = merged_runs(*anchored_runs(units(text.as_py(), unit), unit))
                if len(prints):
                    prints = np.repeat(prints, np.minimum(made_of, 2))  # within such a run windows may repeat
                    n = len(prints)
                    yield pa.RecordBatch.from_arrays([pa.array([r] * n, pa.int64()), pa.array([r2] * n, pa.int32()), pa.array(prints)], ["rid", "rid2", "print"])

    return rows.select("rid", "rid2", "text").where(_long(unit)).mapInArrow(frugal(run), "rid bigint, rid2 int, print bigint")


#: ``alone``: whether windows of the run may repeat within it
_PART = "rid bigint, rid2 int, print bigint, first bigint, windows bigint, bytes binary, alone boolean"


def _emit(bitmap, unit: Unit):
    """Maps texts to the units, as bytes, under windows whose anchor may repeat."""

    def run(batches):
        bits = None if bitmap is None else bitmap.value
        for batch in batches:
            rows, held = [], 0
            listed = batch.column(3).to_pylist() if bits is None else None
            for i, (r, r2, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2))):
                data = units(text.as_py(), unit)
                prints, firsts, counts, made_of = merged_runs(*anchored_runs(data, unit))
                if bits is None:
                    wanted = np.isin(prints, np.array(listed[i], np.int64))
                else:
                    place = prints.view(np.uint64) % np.uint64(FILTER_BITS)
                    wanted = (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
                for k in np.flatnonzero(wanted).tolist():
                    first, n = int(firsts[k]), int(counts[k])
                    rows.append((r, r2, int(prints[k]), first, n, data[first : first + n + unit.length - 1].tobytes(), bool(made_of[k] > 1)))
                    held += len(rows[-1][5])
                    if held > EMIT_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
            if rows:
                yield _batch(rows)

    def _batch(rows):
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["rid", "rid2", "print", "first", "windows", "bytes", "alone"])

    return frugal(run)


def _bit_parts(hashes: DataFrame, name: str) -> DataFrame:
    """(part, bits): bits set at the hashes, in parts of fixed size."""
    placed = hashes.select(F.col(name).bitwiseAND(F.lit(FILTER_BITS - 1)).alias("place"))
    return placed.groupBy(F.shiftright("place", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("place").bitwiseAND(F.lit(32767))).alias("bits"))


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """Bits set at the hashes, built by the executors."""
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in _bit_parts(hashes, "print").collect():
        out[row["part"] * 4096 : (row["part"] + 1) * 4096] = np.frombuffer(row["bits"], np.uint8)
    return out


def _resolve(batches, unit: Unit):
    """Rows of a partition, sorted by group: settled ranges of starts, and for groups
    that were split the distinct windows with whether they are settled here."""
    wide, length = unit.size, unit.length
    names = ["rid", "rid2", "low", "high", "digest", "settled"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]

    def settle(rows):
        windows = np.array([r[5] for r in rows], np.int64)
        proven, leader, first, start, whole = repeated_runs([r[6] for r in rows], windows, unit)
        out = []
        for i, (r, r2, _, _, base, n, _, shares, _) in enumerate(rows):
            mine = proven[first[i] : first[i] + n]
            out += [(r, r2, base + int(a), base + int(b), None, True) for a, b in zip(*_ranges(mine))]
            if shares > 1:
                for w in np.flatnonzero(~mine | (leader[first[i] : first[i] + n] == np.arange(first[i], first[i] + n))).tolist():
                    s = int(start[first[i] + w])
                    out.append((r, r2, base + w, base + w, hashlib.blake2b(whole[s * wide : (s + length) * wide], digest_size=16).digest(), bool(mine[w])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    held, size, last = [], 0, None
    group: list = []

    def to_settle():
        return len(group) > 1 or (group and (group[0][7] > 1 or group[0][8]))

    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns)):
            if row[2:4] != last:
                if to_settle():
                    held += group
                    size += sum(r[5] for r in group)
                    if size >= BLOCK_WINDOWS:
                        yield from settle(held)
                        held, size = [], 0
                group, last = [], row[2:4]
            group.append(row)
    if to_settle():
        held += group
    if held:
        yield from settle(held)


def repeated_spans(docs: DataFrame, unit: Unit = BYTES) -> DataFrame:
    """(rid, rid2, spans): sorted ranges of starts of repeated windows, for rows that have any."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = _keyed(docs)
    anchors = materialise(_anchors(rows, unit), "anchors")
    again = materialise(anchors.groupBy("print").agg(F.count("*").alias("n")).where("n > 1"), "repeated-anchors")
    long = rows.where(_long(unit))
    if again.count() <= FILTER_HASHES:
        parts = long.mapInArrow(_emit(spark.sparkContext.broadcast(_bitmap(again)), unit), _PART)
    else:
        listed = anchors.join(again, "print", "left_semi").groupBy(*_KEY).agg(F.collect_set("print").alias("prints"))
        parts = long.join(listed, _KEY).select("rid", "rid2", "text", "prints").mapInArrow(_emit(None, unit), _PART)
    hot = again.where(F.col("n") > SPLIT).select("print", F.ceil(F.col("n") / SPLIT).alias("shares"))
    shares = F.coalesce(F.col("shares"), F.lit(1).cast("bigint"))
    dealt = (
        join_checked(parts, hot, "print", "left")
        .withColumn("shares", shares)
        .withColumn("share", F.pmod(F.xxhash64("rid", "rid2", "first"), F.col("shares")))
        .select("rid", "rid2", "print", "share", "first", "windows", "bytes", "shares", "alone")
        .repartition("print", "share")
        .sortWithinPartitions("print", "share")
    )
    found = dealt.mapInArrow(frugal(lambda batches: _resolve(batches, unit)), "rid bigint, rid2 int, low bigint, high bigint, digest binary, settled boolean")
    found = materialise(found, "settled-windows")
    settled = found.where(F.col("digest").isNull()).select(*_KEY, "low", "high")
    if hot.isEmpty():
        spans = settled
    else:
        twice = found.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
        spans = settled.unionByName(found.where("not settled").join(twice, "digest", "left_semi").select(*_KEY, "low", "high"))
    return spans.groupBy(*_KEY).agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("spans"))


def removed_runs(spans, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal runs of removed units from sorted ranges of starts of repeated windows."""
    return _merged((span["low"], span["high"] + length) for span in spans or ())


def _removed_words(data: bytes, spans, length: int) -> list[tuple[int, int]]:
    """Runs of removed bytes from sorted ranges of words."""
    places = [word.span() for word in _WORD.finditer(data)] if spans else []
    return [(places[low][0], places[high - 1][1]) for low, high in removed_runs(spans, length)]


def _merged(runs) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for low, high in runs:
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [tuple(x) for x in out]


def _cut(as_text: bool, words: int | None):
    """What is left of texts: bytes, or the whole characters among them."""
    kind = T.StructType().add("n_bytes", T.LongType()).add("n_removed", T.LongType()).add("n_spans", T.LongType())
    kind = kind.add("kept", T.StringType() if as_text else T.BinaryType()).add("kept_sha256", T.StringType())

    def run(texts: pa.Array, spans: pa.Array, word_spans: pa.Array) -> pa.Array:
        out = []
        for text, ranges, of_words in zip(texts, spans.to_pylist(), word_spans.to_pylist()):
            data, runs = text.as_py().encode(), removed_runs(ranges)
            if of_words:
                runs = _merged(sorted(runs + _removed_words(data, of_words, words)))
            at, kept = 0, []
            for low, high in runs:
                kept.append(data[at:low])
                at = high
            left = b"".join(kept) + data[at:]
            kept = "".join(part.decode(errors="ignore") for part in (*kept, data[at:])) if as_text else left
            out.append((len(data), len(data) - len(left), len(runs), kept, hashlib.sha256(left).hexdigest()))
        columns = list(zip(*out)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string() if as_text else pa.binary(), pa.string()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return F.arrow_udf(run, kind)


def parted(docs: DataFrame, key: str, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` whose ``key`` is one of ``found``, with a few others, and all the rest; no row is shuffled."""
    part, bits, hit = free_names(docs.columns, "part", "bits", "hit")
    parts = _bit_parts(found, key).select(F.col("part").alias(part), F.col("bits").alias(bits))
    place = F.col(key).bitwiseAND(F.lit(FILTER_BITS - 1))
    within = place.bitwiseAND(F.lit(32767))
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.shiftright(within, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.getbit(byte, within.bitwiseAND(F.lit(7)).cast("int")) == 1
    # as many parts as FILTER_BITS / 32768 at most
    marked = docs.join(F.broadcast(parts), F.shiftright(place, 15) == F.col(part), "left").withColumn(hit, F.coalesce(bit, F.lit(False)))
    return tuple(marked.where(which).select(*docs.columns) for which in (F.col(hit), ~F.col(hit)))


def remove_repeats(docs: DataFrame, as_text: bool = False, words: int | None = None) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` and ``kept_sha256``.

    ``kept`` are the bytes left; ``as_text`` drops those that are parts of a cut character.
    With ``words``, repeated runs of so many words go as well, however few bytes they have.
    """
    docs = docs.drop(*ADDED)
    key, key2, spans, word_spans, cut = free_names(docs.columns, "rid", "rid2", "spans", "word_spans", "cut")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    of = _keys(text)
    joined = docs.withColumns({key: of["rid"], key2: of["rid2"]})

    def found(unit: Unit, name: str) -> DataFrame:
        return repeated_spans(docs.select("doc_id", "text"), unit).select(F.col("rid").alias(key), F.col("rid2").alias(key2), F.col("spans").alias(name))

    none = F.lit(None).cast("array<struct<low:bigint,high:bigint>>")
    lost = found(BYTES, spans)
    lost = lost.withColumn(word_spans, none) if words is None else lost.join(found(of_words(words), word_spans), [key, key2], "full")
    lost = materialise(lost, "spans")
    losing, rest = parted(joined, key, lost)
    joined = losing.join(lost, [key, key2], "left").unionByName(rest.withColumns({spans: none, word_spans: none}))
    joined = joined.withColumn(cut, _cut(as_text, words)(text, spans, word_spans))
    return joined.select(*docs.columns, *(F.col(f"{cut}.{name}").alias(name) for name in ADDED))
