"""Stages of the pipeline against plain models."""

from __future__ import annotations

import collections
import os
import random
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from paperloom.llm import near_dedup, suffix_dedup  # noqa: E402
from test_corpus_operators import frame, prose  # noqa: E402


def test_near_duplicates_go_from_080(spark):
    rng = random.Random(11)
    texts, similar = [], []
    for edits in (1, 2, 2, 3, 3, 4):  # of 100 words, far enough from each other to cost 5 shingles each
        words = prose(rng, 100).split()
        copy = list(words)
        for k in range(edits):
            copy[10 + 20 * k] = "changed"
        a, b = brute.shingles(" ".join(words)), brute.shingles(" ".join(copy))
        similar.append(len(a & b) / len(a | b))
        texts += [" ".join(words), " ".join(copy)]
    assert any(0.8 <= s < 0.85 for s in similar) and any(s < 0.8 for s in similar)
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, frame(spark, texts), "").collect()}
    assert kept == {2 * k for k in range(len(similar))} | {2 * k + 1 for k, s in enumerate(similar) if s < 0.8}


@pytest.mark.parametrize("percent", sorted(near_dedup.LAYOUTS))
def test_bands_seldom_miss_a_pair_at_the_threshold(percent):
    bands, rows = near_dedup.LAYOUTS[percent]
    assert (1 - (percent / 100) ** rows) ** bands < 8e-7


def plain_cut(texts, words=51, length=400):
    """What is left of each text without repeated runs of words and of bytes."""
    data = [t.encode() for t in texts]
    places = [[m.span() for m in re.finditer(rb"\S+", d)] for d in data]
    windows = [[tuple(d.split()[i : i + words]) for i in range(len(p) - words + 1)] for d, p in zip(data, places)]
    seen = collections.Counter(w for own in windows for w in own)
    strings = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d, p, own in zip(data, places, windows):
        gone = [False] * len(d)
        for i, window in enumerate(own):
            if seen[window] > 1:
                low, high = p[i][0], p[i + words - 1][1]
                gone[low:high] = [True] * (high - low)
        for i in range(len(d) - length + 1):
            if strings[d[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append(bytes(x for x, g in zip(d, gone) if not g).decode())
    return out


@pytest.mark.parametrize("split", [suffix_dedup.SPLIT, 4])
def test_repeated_passages_of_51_words_go(spark, split, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SPLIT", split)
    rng = random.Random(12)
    some = lambda n: prose(rng, n).split()
    passage, small, brief, wide = some(55), ["ab"[rng.randrange(2)] for _ in range(60)], some(50), ["".join(rng.choice("klmn") for _ in range(30)) for _ in range(20)]
    put = lambda x: " ".join(some(30) + x + some(25))
    texts = [put(x) for x in (passage, passage[:52], passage[2:], small, small, brief, brief, wide, wide)]
    texts += [put(passage), put(passage), put(passage + brief), " ".join(some(20)), "a\tb\n" + "  ".join(passage) + " é end"]
    assert len(" ".join(passage)) < 400 and len(" ".join(wide)) > 400
    want = plain_cut(texts)
    assert want[0] != texts[0] and want[3] != texts[3] and want[5] == texts[5] and want[7] != texts[7]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_strings(spark, frame(spark, texts), "").collect()}
    assert got == dict(enumerate(want))


def test_stages_tell_rows_apart_by_id_and_text(spark, tmp_path):
    rng = random.Random(13)
    a, b, c, d, e, f = (prose(rng, 100) for _ in range(6))
    rows = [(1, a), (1, a), (1, a + " near"), (2, b), (2, a), (None, b), (None, c), (None, c + " near"), (None, c), (3, d), (4, None), (4, None), (5, ""), (None, None), (7, e)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, extra int")
    left = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, "").select("doc_id", "text").collect()]
    of_a, of_c = [x for x in left if x[1] in (a, a + " near")], [x for x in left if x[1] in (c, c + " near")]
    assert len(of_a) == 1 and of_a[0][0] == 1 and len(of_c) == 1
    rest = [x for x in left if x not in of_a + of_c]
    assert collections.Counter(rest) == collections.Counter([(2, b), (3, d), (4, None), (5, ""), (None, None), (7, e)])

    spark.createDataFrame([(1, f)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, "see " + f), (None, a), (1, f), (1, b), (2, c)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), 1) for i, t in rows], docs.schema)
    left = [tuple(r) for r in corpus_pipeline.remove_benchmark(spark, docs, str(tmp_path)).select("doc_id", "text").collect()]
    assert collections.Counter(left) == collections.Counter([(None, a), (1, b), (2, c)])
