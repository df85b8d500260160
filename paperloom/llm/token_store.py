"""Operator 8: token ids in a content-addressed store.

Each text is encoded with the tokenizers library, and the end id appended.  A
rolling hash over the ids cuts each document's stream into chunks at places that
depend on the ids near them alone, so equal passages give equal chunks wherever
they stand.  A chunk is named by the hash of its bytes and stored once.

Layout of a store (a folder; all files are Parquet, written by Spark):

* ``objects/kind=chunk``: name and ids (little-endian, 2 or 4 bytes each);
* ``recipes``: in ascending order of ``doc_id``, each document's chunk names in
  order, its count of ids, and ``start``, the ids of all documents before it;
* ``manifest``: a Merkle tree over the recipes: leaves by document, a node for
  each ``BLOCK`` of documents and for each part, and the root.

``read`` goes over the files alone: it hashes every chunk again and folds the
checksums of a document's chunks into that of its stream; a chunk that is
missing or altered stops it.  ``verify`` recomputes the Merkle tree.

Null texts are empty; a document then has its end id alone.  Equal rows are kept
as often as they occur; they stand next to each other.  A null id comes first.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal, new_folder, small_batches, together
from .pretokens import Memo, piece_starts, pieces, plain_texts
from .token_counts import byte_alphabet

VOCABULARY, END_ID = "byte_bpe_50k.json", 0
MOST_PIECES = 600_000
#: Bytes of rows encoded at once, or those of one Arrow batch.
GROUP_BYTES = 4 << 20
#: Ids that the rolling hash sees; shortest, usual and longest chunk in ids.
REACH, SHORTEST, USUAL, LONGEST = 16, 64, 256, 1024
BLOCK = 1024
_CHUNK, _RECIPE = "chunk", "recipe"


class LibraryEncoder:
    """Ids by the BPE model of the tokenizers library, each piece encoded once and remembered.

    Texts are split at added tokens and then into pieces, as the library itself does
    before any merge, so the ids of a text are those of its pieces.  Many texts are
    encoded at once by their distinct pieces, which Arrow finds.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.model = library.model
        self.width = 2 if library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind, self.code = np.dtype(f"<u{self.width}"), "H" if self.width == 2 else "I"
        self.added = {token.content: np.array([i], self.kind).tobytes() for i, token in library.get_added_tokens_decoder().items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.added else None
        self.split_bytes = re.compile(b"|".join(re.escape(token.encode()) for token in longest_first))
        self.alphabet = dict(enumerate(byte_alphabet()))
        self.of_piece = Memo(self._encode, MOST_PIECES)
        self.bare = Tokenizer(self.model)  # neither splits nor adds anything
        self.letters = np.array([ord(letter) for letter in byte_alphabet()], "<u4")
        vocabulary = library.get_vocab(with_added_tokens=False)
        self.sizes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.sizes[i] = len(token)  # a letter for each byte

    def _encode(self, piece: str) -> bytes:
        tokens = self.model.tokenize(piece.encode().decode("latin-1").translate(self.alphabet))
        return array(self.code, [token.id for token in tokens]).tobytes()

    def _encode_all(self, pieces: list[str]) -> list[bytes]:
        """``_encode`` of many pieces in one call of the library; their bytes tell whose ids are whose."""
        data = [piece.encode() for piece in pieces]
        until = np.cumsum([len(piece) for piece in data])
        spelt = self.letters[np.frombuffer(b"".join(data), np.uint8)].tobytes().decode("utf-32-le")
        ends = until.tolist()
        words = [spelt[a:b] for a, b in zip([0, *ends], ends)]
        ids = np.array(self.bare.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)[0].ids, np.int64)
        spans = np.cumsum(self.sizes[ids])
        last = np.searchsorted(spans, until)
        if not len(ids) or spans[-1] != until[-1] or (spans[last] != until).any():
            return [self._encode(piece) for piece in pieces]  # bytes without a token
        whole, ends = ids.astype(self.kind).tobytes(), ((last + 1) * self.width).tolist()
        return [whole[a:b] for a, b in zip([0, *ends], ends)]

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """``encode`` of every text; null is empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not len(texts):
            return []
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        whole = memoryview(data or b"")[offsets[0] : offsets[-1]]
        offsets, data = offsets - offsets[0], np.frombuffer(whole, np.uint8)
        plain = plain_texts(data, offsets)
        if self.split is not None:
            plain[np.searchsorted(offsets, [m.start() for m in self.split_bytes.finditer(whole)], "right") - 1] = False
        out: list[bytes] = [b""] * len(texts)
        for i in np.flatnonzero(~plain).tolist():
            out[i] = self.encode(texts[i].as_py())
        sizes = np.diff(offsets)
        if not plain.all():
            data, sizes = data[np.repeat(plain, sizes)], sizes[plain]
            offsets = np.append(0, np.cumsum(sizes))
        starts = piece_starts(data, offsets)
        if len(starts):
            bounds = np.append(starts, len(data))
            found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
            coded = pa.array(self.of_piece.many(found.dictionary.to_pylist(), self._encode_all), pa.large_binary()).take(found.indices)
            ends = np.frombuffer(coded.buffers()[1], np.int64)
            ids, ends = coded.buffers()[2].to_pybytes(), ends[np.searchsorted(bounds, offsets)].tolist()
            for i, a, b in zip(np.flatnonzero(plain).tolist(), ends, ends[1:]):
                out[i] = ids[a:b]
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text as bytes."""
        of = self.of_piece.__getitem__
        if self.split is None or self.split.search(text) is None:
            return b"".join(map(of, pieces(text)))
        parts = self.split.split(text)
        return b"".join(self.added[part] if k % 2 else b"".join(map(of, pieces(part))) for k, part in enumerate(parts))


_of_worker: dict[str, LibraryEncoder] = {}


def encoder_of(vocabulary: str = VOCABULARY) -> LibraryEncoder:
    """One encoder for all tasks of a Python worker: what it remembers of pieces serves the next task too."""
    if vocabulary not in _of_worker:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _of_worker[vocabulary] = LibraryEncoder(public_tokenizers.path(vocabulary))
    return _of_worker[vocabulary]


def rolling_hash(ids: np.ndarray) -> np.ndarray:
    """For each place a hash of the ``REACH`` ids that end there."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    factor, reach = np.uint64(0xD6E8FEB86659FD93), 1
    while reach < REACH:
        more = h.copy()
        more[reach:] += h[:-reach] * factor
        h, reach, factor = more, 2 * reach, factor * factor
    return h


def marks(ids: np.ndarray) -> np.ndarray:
    """Places after which a chunk may end.

    Those within ``REACH`` ids of a stream's start depend on what stands before it;
    as chunks are no shorter than ``SHORTEST``, they are never used, so the streams of
    many documents can be hashed in one go.
    """
    return np.flatnonzero((rolling_hash(ids) >> np.uint64(40)) % np.uint64(USUAL - SHORTEST) == 0) + 1


def cuts(ends_allowed: list[int], start: int, stop: int) -> list[int]:
    """Ends of the chunks of the stream from ``start`` to ``stop``."""
    ends = []
    for end in ends_allowed:
        if end - start < SHORTEST:
            continue
        while end - start > LONGEST:
            start += LONGEST
            ends.append(start)
        if end - start >= SHORTEST:
            ends.append(end)
            start = end
    while stop - start > LONGEST:
        start += LONGEST
        ends.append(start)
    return ends + [stop] if start < stop else ends


def name_of(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


@lru_cache(maxsize=64)
def _zero_bytes(k: int) -> np.ndarray:
    """What 2**k zero bytes do to a crc32, as tables for each of its 4 bytes."""
    if k == 0:
        state = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            state = (state >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (state & np.uint32(1)))
        return np.stack([state] + [np.arange(256, dtype=np.uint32) << np.uint32(8 * (b - 1)) for b in range(1, 4)])
    half = _zero_bytes(k - 1)
    each = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * b) for b in range(4)])
    return _through(half, _through(half, each))


def _through(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = np.zeros_like(crc)
    for b in range(4):
        out ^= tables[b][(crc >> np.uint32(8 * b)) & np.uint32(255)]
    return out


def followed_by(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What each crc32 adds to that of its string with ``n_bytes`` more bytes behind it."""
    crc = crc.astype(np.uint32)
    for k in range(int(n_bytes.max(initial=0)).bit_length()):
        here = (n_bytes >> k) & 1 == 1
        crc[here] = _through(_zero_bytes(k), crc[here])
    return crc


def write(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> str:
    """Write the store of ``docs`` to ``folder``."""
    spark = docs.sparkSession
    small_batches(spark)

    def run(batches):
        encoder = encoder_of(vocabulary)
        end, width = np.array([end_id], encoder.kind).tobytes(), encoder.width
        names = ["kind", "name", "data", "n_ids", "doc_id"]
        kinds = [pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        for batch in together(batches, GROUP_BYTES):
            rows, seen = [], set()
            streams = [ids + end for ids in encoder.encode_all(batch.column(1))]
            whole = b"".join(streams)
            allowed = marks(np.frombuffer(whole, encoder.kind))
            start = 0
            for key, stream in zip(batch.column(0).to_pylist(), streams):
                stop = start + len(stream) // width
                first, last = np.searchsorted(allowed, (start, stop), "right")
                recipe, at = [], start
                for cut in cuts(allowed[first:last].tolist(), start, stop):
                    part = whole[at * width : cut * width]
                    name = name_of(part)
                    recipe.append(name)
                    if name not in seen:
                        seen.add(name)
                        rows.append((_CHUNK, name, part, cut - at, None))
                    at = cut
                rows.append((_RECIPE, name_of(repr(key).encode() + b"".join(recipe)), b"".join(recipe), stop - start, key))
                start = stop
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    found = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(frugal(run), "kind string, name binary, data binary, n_ids bigint, doc_id bigint")
    once = found.groupBy("kind", "name").agg(F.first("data").alias("data"), F.first("n_ids").alias("n_ids"), F.first("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    once.write.partitionBy("kind").option("compression", "zstd").parquet(f"{folder}/objects")

    objects = _objects(spark, folder)
    copies = objects.where(F.col("kind") == _RECIPE).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    ordered = (
        copies.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("name"), F.col("copy"))
        .withColumn("part", F.spark_partition_id())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "name", "copy")
        .select("part", "doc_id", "name", "copy", F.col("n_ids").alias("n_tokens"), F.col("data").alias("chunks"))
    )
    ordered.write.option("compression", "zstd").parquet(f"{folder}/order")
    order = spark.read.parquet(f"{folder}/order")
    # as many rows as parts
    parts = order.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "name", "copy")
    recipes = order.join(F.broadcast(before), "part").select(
        "part",
        (F.row_number().over(within) - 1).alias("place"),
        "doc_id",
        (F.col("before") + F.sum("n_tokens").over(within) - F.col("n_tokens")).alias("start"),
        "n_tokens",
        "chunks",
    )
    recipes.write.option("compression", "zstd").parquet(f"{folder}/recipes")
    _tree(spark.read.parquet(f"{folder}/recipes")).write.parquet(f"{folder}/manifest")
    return folder


def _objects(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("name binary, data binary, n_ids bigint, doc_id bigint, copies bigint, kind string").parquet(f"{folder}/objects")


def _tree(recipes: DataFrame) -> DataFrame:
    """Nodes of the Merkle tree: (level, part, block, hash)."""
    numbers = F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "start", "n_tokens")
    leaf = F.sha2(F.concat(numbers.cast("binary"), F.lit(b"\0"), F.col("chunks")), 256)
    ordered = lambda: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("_row")), lambda x: x["hash"]), ""), 256)
    blocks = (
        recipes.select("part", (F.col("place") / BLOCK).cast("bigint").alias("block"), F.struct("place", leaf.alias("hash")).alias("_row"))
        .groupBy("part", "block").agg(ordered().alias("hash"))
    )
    parts = blocks.select("part", F.struct("block", "hash").alias("_row")).groupBy("part").agg(ordered().alias("hash"))
    root = parts.select(F.struct("part", "hash").alias("_row")).agg(ordered().alias("hash"))
    none = F.lit(None).cast("bigint")
    return (
        blocks.select(F.lit("block").alias("level"), F.col("part").cast("bigint").alias("part"), "block", "hash")
        .unionByName(parts.select(F.lit("part").alias("level"), F.col("part").cast("bigint").alias("part"), none.alias("block"), "hash"))
        .unionByName(root.select(F.lit("root").alias("level"), none.alias("part"), none.alias("block"), "hash"))
    )


def verify(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of the Merkle tree that the recipes on file no longer give; none if all is well."""
    now, then = _tree(spark.read.parquet(f"{folder}/recipes")), spark.read.parquet(f"{folder}/manifest")
    return now.exceptAll(then).unionByName(then.exceptAll(now))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Per document from the files: start, count, and checksum of its ids as 4-byte integers."""

    def sums(batches):
        for batch in batches:
            names, data, counts = (batch.column(i).to_pylist() for i in range(3))
            crc = []
            if names:
                width = len(data[0]) // counts[0]
                wide = memoryview(np.frombuffer(b"".join(data), f"<u{width}").astype("<u4")).cast("B")
                at = 0
                for name, part, n in zip(names, data, counts):
                    if name_of(part) != name:
                        raise ValueError(f"chunk {name.hex()} was altered")
                    crc.append(zlib.crc32(wide[at : at + 4 * n]))
                    at += 4 * n
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crc, pa.int64()), batch.column(2)], ["name", "crc", "n_ids"])

    chunks = _objects(spark, folder).where(F.col("kind") == _CHUNK).select("name", "data", "n_ids").mapInArrow(sums, "name binary, crc bigint, n_ids bigint")
    names = F.transform(F.sequence(F.lit(0), (F.octet_length("chunks") / 16).cast("int") - 1), lambda i: F.substring(F.col("chunks"), i * 16 + 1, F.lit(16)))
    steps = spark.read.parquet(f"{folder}/recipes").select("part", "place", "doc_id", "start", "n_tokens", F.posexplode(names).alias("step", "name"))
    found = steps.join(chunks, "name", "left")
    listed = found.groupBy("part", "place", "doc_id", "start", "n_tokens").agg(F.array_sort(F.collect_list(F.struct("step", F.coalesce("crc", F.lit(-1)).alias("crc"), F.coalesce("n_ids", F.lit(0)).alias("n_ids")))).alias("steps"))

    @F.arrow_udf(T.LongType())
    def joined(lists: pa.Array) -> pa.Array:
        sizes = lists.value_lengths().to_numpy()
        _, crc, n_ids = (column.to_numpy(zero_copy_only=False) for column in lists.flatten().flatten())
        if (crc < 0).any():
            raise ValueError("a chunk is missing")
        ends = np.cumsum(sizes)
        until = np.cumsum(4 * n_ids)
        behind = np.repeat(until[ends - 1], sizes) - until
        out = np.bitwise_xor.reduceat(followed_by(crc, behind), ends - sizes) if len(crc) else np.zeros(0, np.uint32)
        return pa.array(out.astype(np.int64))

    return listed.select("doc_id", "start", "n_tokens", joined("steps").alias("ids_crc32"))


def read_verified(spark: SparkSession, folder: str) -> DataFrame:
    """``read``, once the manifest is found to hold."""
    broken = verify(spark, folder).head()
    if broken is not None:
        raise ValueError(f"the manifest does not hold: {broken}")
    return read(spark, folder)


def store_and_read(docs: DataFrame) -> DataFrame:
    """Write a new store in the shared folder, verify its manifest and read it back."""
    spark = docs.sparkSession
    return read_verified(spark, write(docs, new_folder(spark, "token-store")))
