"""Operator 3: byte-level BPE as a lazily determinised finite-state transducer.

A token sequence is what the ranked merges give for its bytes exactly if the
merges keep every adjacent pair of its tokens apart.  So the encoder of a piece
is a nondeterministic transducer: a thread holds the last whole token, the place
in the trie of tokens that the bytes since then have reached, and tokens not
emitted yet.  Reading a byte moves each thread down the trie; where that ends a
token that may follow the thread's last one, a new thread starts behind it.
Subsets of threads become states of a deterministic machine when texts need them;
states that only one rare piece has come by are not kept.  What all threads of a subset would emit first is emitted at once,
so the lookahead never exceeds the longest token.

A piece that is a token as a whole is that token, though no merge may lead to it:
the tiktoken library looks whole pieces up first.  Only other pieces are run
through the machine.

Decoding joins the bytes of tokens and runs an incremental UTF-8 machine over
them, which holds back the bytes of an unfinished character between calls.  What
``decoded_sha256`` digests are the characters that come out of that machine.

Nulls are empty texts: no ids, and the hash of no bytes.  Any length of text is
taken; only the ids of one document are held at once.  Equal rows give equal
rows.  Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import base64
import codecs
import gc
import hashlib
from array import array
from typing import NamedTuple

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, small_batches
from .pretokens import Memo, pieces

VOCABULARY = "byte_bpe_50k.tiktoken"
class Bounds(NamedTuple):
    """What a worker remembers at most: machine states, token pairs, pieces."""

    states: int
    pairs: int
    pieces: int


#: Some 350 MB and 150 MB; the ids are the same with either.
FAST, LEAN = Bounds(150_000, 300_000, 900_000), Bounds(60_000, 100_000, 200_000)
#: Moves on the first bytes of a piece are kept when first made, later ones when made again.
KEPT_BYTES = 6
_NO_TOKEN = -1
_NEVER = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class _State:
    __slots__ = ("threads", "moves")

    def __init__(self, threads):
        self.threads = threads
        self.moves: dict[int, tuple | None] = {}

    def final(self) -> tuple:
        """What is still to be emitted where a piece ends here."""
        return next(emitted for emitted, _, node in self.threads if node == 0)


class Transducer:
    """Encoder and decoder over a table of ranked tokens that holds all single bytes."""

    def __init__(self, ranks: dict[bytes, int], bounds: Bounds = FAST):
        self.ranks, self.bounds = ranks, bounds
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        self.children: list[dict[int, int]] = [{}]
        self.token_at = [_NO_TOKEN]
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
            node = 0
            for byte in token:
                down = self.children[node].get(byte)
                if down is None:
                    down = self.children[node][byte] = len(self.children)
                    self.children.append({})
                    self.token_at.append(_NO_TOKEN)
                node = down
            self.token_at[node] = rank
        self.reachable = Memo(lambda token: self.merge(self.bytes_of[token]) == [token], bounds.pairs)
        self.left_edge = Memo(lambda token: self._edge(token, 0), bounds.pairs)
        self.right_edge = Memo(lambda token: self._edge(token, 1), bounds.pairs)
        self.may_follow = Memo(self._may_follow, bounds.pairs)
        self._restart()

    def merge(self, data: bytes, until: int = 1) -> list[int]:
        """The merges done one by one, to ``until`` parts at least; only for a token's few bytes."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > until:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], _NEVER))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[part] for part in parts]

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The parts that stand at one edge of a token while it grows, each with
        the rank of the merge that takes it up."""
        parts, taken_up = [(token, _NEVER)], token
        while len(self.bytes_of[token]) > 1:
            token = self.merge(self.bytes_of[token], 2)[-side]
            parts.append((token, taken_up))
            taken_up = token
        return parts[::-1]

    def _may_follow(self, pair: tuple[int, int]) -> bool:
        """Whether no merge crosses the border of two tokens while both grow."""
        first, second = pair
        if not self.reachable[second]:
            return False
        if first == _NO_TOKEN:
            return True
        left, right, i, j = self.right_edge[first], self.left_edge[second], 0, 0
        while True:
            (a, a_ends), (b, b_ends) = left[i], right[j]
            crossing = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], _NEVER)
            if crossing < a_ends and crossing <= b_ends and crossing != _NEVER:
                return False
            if a_ends == b_ends == _NEVER:
                return True
            if a_ends <= b_ends:
                i += 1
            else:
                j += 1

    def _restart(self) -> None:
        for state in getattr(self, "states", {}).values():
            state.moves.clear()  # states lead to each other in circles; so they go without the collector
        threads = (((), _NO_TOKEN, 0),)
        self.start = _State(threads)
        self.states = {threads: self.start}

    def _move(self, state: _State, byte: int, keep: bool) -> tuple:
        """The state behind a byte and what is emitted; a move that is not kept is marked as made once."""
        children, token_at, may_follow, threads = self.children, self.token_at, self.may_follow, []
        for emitted, last, node in state.threads:
            down = children[node].get(byte)
            if down is None:
                continue
            if children[down]:
                threads.append((emitted, last, down))
            token = token_at[down]
            if token != _NO_TOKEN and may_follow[last, token]:
                threads.append((emitted + (token,), token, 0))
        shared = threads[0][0]
        for emitted, _, _ in threads[1:] if shared else ():
            n = 0
            while n < len(shared) and n < len(emitted) and shared[n] == emitted[n]:
                n += 1
            shared = shared[:n]
        n = len(shared)
        key = tuple([(emitted[n:], last, node) for emitted, last, node in threads] if n else threads)
        target = self.states.get(key)
        if target is None:
            if not keep:
                state.moves[byte] = None
                return _State(key), shared
            if len(self.states) >= self.bounds.states:
                self._restart()
            target = self.states[key] = _State(key)
        move = state.moves[byte] = (target, shared)
        return move

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        out: list[int] = []
        state = self.start
        for at, byte in enumerate(piece):
            moves = state.moves
            move = moves.get(byte)
            if move is None:
                move = self._move(state, byte, at < KEPT_BYTES or byte in moves)
            state, emitted = move
            if emitted:
                out += emitted
        out += state.final()
        return out

    def decoder(self) -> "StreamDecoder":
        return StreamDecoder(self.bytes_of)


class StreamDecoder:
    """Bytes and text of ids that arrive in any portions."""

    def __init__(self, bytes_of: list[bytes]):
        self.bytes_of = bytes_of
        self.machine = codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, ids, last: bool = False) -> tuple[bytes, str]:
        """The bytes of ``ids``, and the characters that they complete."""
        data = b"".join(map(self.bytes_of.__getitem__, ids))
        return data, self.machine.decode(data, last)


def transducer(vocabulary: str = VOCABULARY, bounds: Bounds = FAST) -> Transducer:
    """A machine of its own for each task: what it has determinised goes when the task ends."""
    return Transducer(read_ranks(public_tokenizers.path(vocabulary)), bounds)


SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_chars_decoded bigint"
SCHEMA_IDS = SCHEMA + ", ids array<int>"
_PORTION = 1 << 16


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, ids: bool = False, doc_id: str = "doc_id", text: str = "text", bounds: Bounds = FAST) -> DataFrame:
    """Encode and decode every text: hashes and counts, with ``ids`` the ids as well."""
    small_batches(docs.sparkSession)

    def run(batches):
        gc.disable()  # a million small objects that are no garbage would be looked through again and again
        try:
            yield from encoded(batches)
        finally:
            gc.enable()

    def encoded(batches):
        machine = transducer(vocabulary, bounds)
        memo = Memo(lambda piece: array("I", machine.encode_piece(piece.encode())).tobytes(), bounds.pieces)
        for batch in batches:
            rows = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = b"".join(map(memo.__getitem__, pieces(value.as_py() or "")))
                found = memoryview(data).cast("I")
                stream, digest, chars = machine.decoder(), hashlib.sha256(), 0
                for at in range(0, len(found) or 1, _PORTION):
                    _, out = stream.feed(found[at : at + _PORTION], at + _PORTION >= len(found))
                    digest.update(out.encode())
                    chars += len(out)
                rows.append((key, len(found), hashlib.sha256(data).hexdigest(), digest.hexdigest(), chars) + ((found.tolist(),) if ids else ()))
            columns = list(zip(*rows)) if rows else [[]] * (6 if ids else 5)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_chars_decoded", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names[: len(columns)])

    source = docs.select(F.col(doc_id).cast("bigint"), F.col(text).cast("string"))
    return source.mapInArrow(frugal(run), SCHEMA_IDS if ids else SCHEMA)
