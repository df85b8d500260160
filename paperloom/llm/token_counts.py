"""Operator 7: token counts by heap-and-linked-list byte-pair merging.

A piece starts as a doubly linked list of its bytes.  A heap holds the adjacent
pairs that have a merge, by rank and then place; the lowest is popped, checked
to be still there, and joined, which adds at most two new pairs.  The count is
the initial symbols minus the merges done; no token identifiers are emitted.

Added tokens of the vocabulary file that stand in a text count as one token, as
the tokenizers library has it by default.  Nulls and empty texts have no bytes
and no tokens.  Columns other than the id and the text are ignored, equal rows
give equal rows.
"""

from __future__ import annotations

import heapq
import json
import re

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .pretokens import Memo, pieces

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
MOST_PIECES = 300_000
SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Printable Latin-1 characters stand for themselves, the other bytes, in
    order, for the characters from U+0100 on.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class HeapMerger:
    """Counts tokens of pieces by the merges of a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary = spec["model"]["vocab"]
        self.byte_id = [vocabulary[char] for char in byte_alphabet()]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocabulary[left], vocabulary[right]] = (rank, vocabulary[left + right])
        added = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.of_piece = Memo(self.count_piece, MOST_PIECES)

    def count_piece(self, piece: str) -> int:
        ids = [self.byte_id[byte] for byte in piece.encode()]
        n = len(ids)
        if n < 2:
            return n
        merges = self.merges
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            found = merges.get((ids[i], ids[i + 1]))
            if found:
                heap.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(heap)
        done = 0
        while heap:
            _, i, left, right, joined = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            done += 1
            ids[i], ids[j] = joined, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = merges.get((joined, ids[k]))
                if found:
                    heapq.heappush(heap, (found[0], i, joined, ids[k], found[1]))
            h = before[i]
            if h >= 0:
                found = merges.get((ids[h], joined))
                if found:
                    heapq.heappush(heap, (found[0], h, ids[h], joined, found[1]))
        return n - done

    def count(self, text: str) -> int:
        if self.added is None:
            return sum(map(self.of_piece.__getitem__, pieces(text)))
        parts = self.added.split(text)
        return len(parts) - 1 + sum(sum(map(self.of_piece.__getitem__, pieces(part))) for part in parts)


_of_worker: dict[str, HeapMerger] = {}


def merger(vocabulary: str = VOCABULARY) -> HeapMerger:
    if vocabulary not in _of_worker:
        _of_worker[vocabulary] = HeapMerger(public_tokenizers.path(vocabulary))
    return _of_worker[vocabulary]


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Bytes and tokens of every text, and whether the tokens exceed ``limit``."""
    small_batches(docs.sparkSession)

    def run(batches):
        counter = merger(vocabulary)
        for batch in batches:
            texts = [value.as_py() or "" for value in batch.column(1)]
            tokens = [counter.count(value) for value in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(value.encode()) for value in texts], pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col(doc_id).cast("bigint"), F.col(text).cast("string")).mapInArrow(run, SCHEMA)
