"""Many texts encoded at once: the same ids as one by one, with few calls of the library."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from paperloom.llm import common, token_store
from paperloom.llm.pretokens import _OTHER, Memo, piece_starts, pieces, plain_texts
from tokenizers import Tokenizer

ALPHABETS = ["ab '\n\t1.s", "'srtvemld e ", "aé×÷«»¿¡‐‧€…  '\x1b\x1c\x7f\x85\xa0ſƀ𐀀漢", " \n\r\t\x0b\x0c'x"]


def odd_texts(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(12))) for alphabet in ALPHABETS for _ in range(n)]


def laid_out(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data = [text.encode() for text in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.append(0, np.cumsum([len(x) for x in data])).astype(np.int64)


def test_pieces_by_bytes_are_those_of_the_pattern():
    texts = ["", *odd_texts(31, 3000), "'", "a", "it's'll", "'l", "'", "l", ""] + [chr(c) + "a" for c in range(0x3000)]
    plain = plain_texts(*laid_out(texts))
    assert plain.tolist() == [_OTHER.search(text) is None for text in texts]
    texts = [text for text, here in zip(texts, plain) if here]
    data, offsets = laid_out(texts)
    starts, whole = piece_starts(data, offsets).tolist(), data.tobytes()
    assert [whole[a:b].decode() for a, b in zip(starts, [*starts[1:], len(whole)])] == [piece for text in texts for piece in pieces(text)]


def test_ids_of_many_texts_take_one_call_of_the_library(monkeypatch):
    rng = random.Random(32)
    path = public_tokenizers.path(token_store.VOCABULARY)
    encoder, library = token_store.LibraryEncoder(path), Tokenizer.from_file(path)
    mixed = ["".join(rng.choice([*encoder.added, "ab", " ", "漢", "é", "'s", "\n"]) for _ in range(rng.randrange(9))) for _ in range(300)]
    texts = [None, "", "x" * 5000, *odd_texts(33, 100), *mixed]
    want = [np.array(library.encode(text or "", add_special_tokens=False).ids, encoder.kind).tobytes() for text in texts]
    assert encoder.encode_all(pa.array(texts)) == want
    assert encoder.encode_all(pa.array(["zz", *texts, "y"]).slice(1, len(texts))) == want
    assert encoder.encode_all(pa.array(["", None])) == [b"", b""] and encoder.encode_all(pa.array([], pa.string())) == []

    prose = [f"word{rng.random()} and café" for _ in range(200)]
    fresh = token_store.LibraryEncoder(path)
    monkeypatch.setattr(fresh, "_encode", lambda piece: 1 / 0)  # one call for each new piece
    assert fresh.encode_all(pa.array(prose)) == [encoder.encode(text) for text in prose]


def test_pieces_without_a_token_are_encoded_one_by_one():
    encoder = token_store.LibraryEncoder(public_tokenizers.path(token_store.VOCABULARY))
    want = [encoder.encode(text) for text in ("a bc", "de")]
    encoder.of_piece.clear()
    encoder.sizes = encoder.sizes + 1  # as if the ids covered other bytes
    assert encoder.encode_all(pa.array(["a bc", "de"])) == want


def test_memo_of_many_keys_forgets_the_older_half():
    asked = []
    memo = Memo(str, 8)

    def many(keys):
        asked.extend(keys)
        return list(map(str, keys))

    for keys in ([1, 2, 3], [3, 4], [1, 5], [6, 7], [1, 8, 9, 10], [2]):
        assert memo.many(keys, many) == list(map(str, keys))
        assert len(memo) <= 4 and len(memo.older) <= 4
    assert asked == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 2]


def test_batches_are_joined_up_to_a_size():
    batches = [pa.RecordBatch.from_pydict({"x": pa.array(range(a, a + n), pa.int64())}) for a, n in ((0, 10), (10, 5), (15, 100), (115, 1), (116, 2))]
    joined = list(common.together(batches, 8 * 15 + 7))
    assert [len(batch) for batch in joined] == [15, 100, 3]
    assert [x for batch in joined for x in batch.column(0).to_pylist()] == list(range(118))
    assert list(common.together([], 8)) == []
