"""Each operator against a plain model, on fixtures with nulls, blanks, copies and long texts."""

from __future__ import annotations

import os
import random
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402
from paperloom.llm import bpe_transducer, decontaminate, language_id, near_dedup, quality_classifier, quality_rules, suffix_dedup, token_counts, token_store, toxicity  # noqa: E402

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra int"
ODD = [None, "", "  \n\t ", "a", "Ünïcode 😀 x²½ <|endoftext|> don't", "z" * 3000, " " * 500 + "end", "日本語のテキスト。", "\x1c\x85 q"]


def frame(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", f"s{i % 3}", len(t or ""), 1) for i, t in enumerate(texts)], DOCS)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_transducer_is_the_library(spark):
    import public_tokenizers
    import tiktoken

    rng = random.Random(1)
    texts = ODD + [prose(rng, 200) for _ in range(10)] + ["".join(chr(rng.choice([32, 101, 116, 10, 233, 0x4E00 + rng.randint(0, 99)])) for _ in range(400)) for _ in range(10)]
    ranks = bpe_transducer.read_ranks(public_tokenizers.path(bpe_transducer.VOCABULARY))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(bpe_transducer.encode(frame(spark, texts), ids=True))
    for i, text in enumerate(texts):
        ids = library.encode_ordinary(text or "")
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == brute.sha(np.array(ids, "<u4").tobytes()) and got[i]["decoded_sha256"] == brute.sha((text or "").encode())


def test_stream_decoder_holds_back_unfinished_characters():
    machine = bpe_transducer.transducer()
    ids = machine.encode_piece("é😀é".encode())
    stream = machine.decoder()
    assert "".join(stream.feed([i], k == len(ids) - 1)[1] for k, i in enumerate(ids)) == "é😀é"


def test_counts_and_store_are_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    same = prose(rng, 900)
    texts = ODD + [same, same, same + " tail", prose(rng, 60)]
    ids = [x.ids for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    counted = by_id(token_counts.count_tokens(frame(spark, texts)))
    folder = token_store.new_folder(spark, "test-store")
    token_store.write(frame(spark, texts), folder)
    stored = by_id(token_store.read(spark, folder))
    start = 0
    for i, own in enumerate(ids):
        assert (counted[i]["n_tokens"], counted[i]["n_bytes"], counted[i]["over_limit"]) == (len(own), len((texts[i] or "").encode()), len(own) > 512)
        assert (stored[i]["start"], stored[i]["n_tokens"]) == (start, len(own) + 1)
        assert stored[i]["ids_crc32"] == zlib.crc32(np.array([*own, 0], "<u4").tobytes())
        start += len(own) + 1
    assert token_store.verify(spark, folder).isEmpty()


def near_copies(rng, n, words=120, edits=(0, 6)):
    base = prose(rng, words).split()
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(*edits)):
            copy[rng.randrange(words)] = prose(rng, 1)
        out.append(" ".join(copy))
    return out


def test_near_duplicates_are_all_found(spark):
    rng = random.Random(3)
    texts = [None, "", " \n", "one two", "One TWO", "one two three"] + near_copies(rng, 60) + near_copies(rng, 40, 60, (1, 3)) + [prose(rng, 80) for _ in range(10)]
    texts += texts[6:16]
    rows = list(enumerate(texts))
    got = by_id(near_dedup.deduplicate(frame(spark, texts)))
    want = brute.near_components(rows)
    assert {i: got[i]["component_id"] for i, _ in rows} == want
    assert all(got[i]["n_shingles"] == len(brute.shingles(t)) and got[i]["kept"] == (want[i] == i) for i, t in rows)


def test_repeats_are_all_removed(spark):
    rng = random.Random(4)
    passage = prose(rng, 150)
    texts = [None, "", "é" * 150, "é" * 250, "ab" * 400, passage, prose(rng, 50) + passage[37:620] + prose(rng, 20), "x" + passage + "y", passage + passage, prose(rng, 300)]
    texts += near_copies(rng, 12, 250, (0, 3)) + [passage] * 3
    for split in (suffix_dedup.SPLIT, 4):
        before, suffix_dedup.SPLIT = suffix_dedup.SPLIT, split
        try:
            got = by_id(suffix_dedup.remove_repeats(frame(spark, texts)))
        finally:
            suffix_dedup.SPLIT = before
        for i, (gone, spans, kept) in enumerate(brute.kept_bytes(texts)):
            assert (got[i]["n_removed"], got[i]["n_spans"], bytes(got[i]["kept"])) == (gone, spans, kept), i


@pytest.mark.parametrize("short", [False, True])
def test_decontamination(spark, short, monkeypatch):
    rng = random.Random(5)
    items = [(1, prose(rng, 30)), (2, prose(rng, 12)), (3, None), (4, " - "), (10, prose(rng, 30))] + ([(5, "abc def"), (6, "solo"), (7, prose(rng, 9))] if short else [])
    if not short:
        monkeypatch.setattr(decontaminate, "BROADCAST_FINGERPRINTS", 0)
    words = items[0][1].split()
    texts = [None, "", "abc, DEF ghi", "solo", prose(rng, 40) + " " + " ".join(words[3:17]).upper() + "! " + prose(rng, 10), " ".join(words[3:12]), items[1][1] + " " + items[4][1], prose(rng, 200)]
    frame_of = spark.createDataFrame(items, "item_id bigint, text string")
    got = by_id(decontaminate.decontaminate(frame(spark, texts), frame_of))
    for i, text in enumerate(texts):
        n, hit, found = brute.hits(text, items)
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["n_items"], got[i]["contaminated"]) == (n, hit, len(found), hit > 0), i
        assert got[i]["items_sha256"] == brute.sha(",".join(found).encode())


def test_toxicity_tells_planted_words(spark):
    rng = random.Random(6)
    texts = [prose(rng, 60) + (" wretchword" if i % 4 == 0 else "") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id bigint, toxic int")
    rows = toxicity.score(frame(spark, texts + [None, ""]), labels).collect()
    right = [r["predicted"] == int(r["doc_id"] % 4 == 0) for r in rows if r["held_out"] and r["doc_id"] < 400]
    assert len(rows) == 402 and np.mean(right) > 0.95 and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(frame(spark, texts[:3]), labels.limit(0)).count() == 3


def test_language_by_segmentations(spark):
    rng = random.Random(7)
    make = lambda parts: " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(40))
    kinds = {"xx": ["the", "ing", "er", "on"], "yy": ["que", "os", "ci", "la"]}
    rows = [(i, make(kinds[lang]), lang, "s", 1, 1) for i, lang in enumerate(["xx", "yy"] * 60)] + [(200, None, None, "s", 0, 1), (201, "12 !", None, "s", 0, 1)]
    got = by_id(language_id.identify(spark.createDataFrame(rows, DOCS)))
    assert all(got[i]["lang_pred"] == lang for i, _, lang, *_ in rows if i < 200 and got[i]["held_out"])
    assert got[200]["lang_pred"] == got[201]["lang_pred"] == "und"


def test_scorer_sums_all_segmentations():
    p = {"a": 0.5, "b": 0.25, "ab": 0.25, language_id._START: 1.0}
    scorer = language_id.Scorer({"l": p})
    assert np.exp(scorer.log_words([language_id._START + "ab"])[0, 0]) == pytest.approx(0.5 * 0.25 + 0.25)


def test_quality_keeps_clean_and_drops_junk(spark):
    rng = random.Random(8)
    good = [prose(rng, 120).capitalize() + "." for _ in range(150)]
    bad = [" ".join(w + "$$$" for w in prose(rng, 120).split()) for _ in range(50)]
    docs = frame(spark, good + bad + [None, ""])
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(0, 200, 2)], "doc_id bigint, quality int")
    scored = by_id(quality_classifier.classify(docs, labels))
    ruled = by_id(quality_rules.apply_rules(docs, labels))
    for got in (scored, ruled):
        assert len(got) == 202
        assert all(got[i]["kept"] == (i < 150) for i in range(200))
    assert ruled[200]["base_failed"] and ruled[201]["n_words"] == 0 and scored[0]["extra"] == 1
    assert quality_classifier.classify(docs, labels.limit(0)).where("kept").count() == 202


def test_empty_tables(spark):
    none = frame(spark, ["x"]).limit(0)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    items = spark.createDataFrame([], "item_id bigint, text string")
    for got in (
        decontaminate.decontaminate(none, items), toxicity.score(none, labels), bpe_transducer.encode(none), near_dedup.deduplicate(none), language_id.identify(none),
        suffix_dedup.remove_repeats(none), token_counts.count_tokens(none), token_store.store_and_read(none), quality_classifier.classify(none, labels), quality_rules.apply_rules(none, labels),
    ):
        assert got.count() == 0
