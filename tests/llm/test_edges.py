"""Odd rows and columns for every operator, and operators against plain models."""

from __future__ import annotations

import itertools
import math
import os
import random
import re
import sys
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from paperloom.llm import bpe_transducer, decontaminate, language_id, linear, near_dedup, quality_classifier, quality_rules, suffix_dedup, token_counts, token_store, toxicity  # noqa: E402
from test_corpus_operators import by_id, frame, near_copies, prose  # noqa: E402
from test_pipeline_stages import plain_cut  # noqa: E402

CLASHES = ("rid", "rid2", "spans", "word_spans", "cut", "_cut", "n_bytes", "n_removed", "kept", "kept_sha256", "stats", "_host", "_path", "_fold", "fold", "host", "evidence", "score", "cls", "label", "bands", "sketch", "text_hash", "held_out", "n", "good", "print", "steps", "quality_", "ids", "component_id", "n_words", "contaminated", "start", "part", "place")


def operators(labels, items):
    return {
        "decontaminate": lambda d: decontaminate.decontaminate(d, items), "toxicity": lambda d: toxicity.score(d, labels), "bpe": bpe_transducer.encode,
        "near": near_dedup.deduplicate, "language": language_id.identify, "suffix": lambda d: suffix_dedup.remove_repeats(d).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"),
        "counts": token_counts.count_tokens, "store": token_store.store_and_read, "quality": lambda d: quality_classifier.classify(d, labels).select("doc_id", *quality_classifier.ADDED),
        "rules": lambda d: quality_rules.apply_rules(d, labels),
    }


def test_clashing_columns_repeated_rows_and_null_ids_change_nothing(spark):
    rng = random.Random(21)
    texts = [prose(rng, 60) for _ in range(6)] + [None, ""]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (0, texts[0]), (None, texts[1]), (None, None), (3, "other text")]
    docs = spark.createDataFrame([(i, t, "en", "s1", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(6)], "doc_id bigint, quality int, toxic int")
    items = spark.createDataFrame([(1, texts[2])], "item_id bigint, text string")
    from pyspark.sql import functions as F

    wide = docs.select("*", *(F.lit(f"x{k}").alias(name) for k, name in enumerate(CLASHES)))
    for name, run in operators(labels, items).items():
        plain, odd = ([tuple(map(str, r)) for r in run(d).collect()] for d in (docs, wide))
        assert len(plain) == len(rows), name
        assert Counter(plain) == Counter(odd), name


def test_no_input_column_is_lost(spark):
    from pyspark.sql import functions as F

    rng = random.Random(22)
    docs = frame(spark, [prose(rng, 60) for _ in range(4)]).select("*", *(F.lit(name).alias(name) for name in ("rid", "spans", "_cut", "stats", "_host", "_path", "host")))
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id bigint, quality int")
    for out in (suffix_dedup.remove_repeats(docs), quality_classifier.classify(docs, labels)):
        assert set(docs.columns) <= set(out.columns) and all(r["rid"] == "rid" and r["_host"] == "_host" and r["_cut"] == "_cut" for r in out.collect())


@pytest.mark.parametrize(("windows", "block"), [(1 << 16, 1 << 19), (50, 300)])
def test_periodic_and_long_texts_lose_what_repeats(spark, monkeypatch, windows, block):
    monkeypatch.setattr(suffix_dedup, "RUN_WINDOWS", windows)
    monkeypatch.setattr(suffix_dedup, "BLOCK_WINDOWS", block)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1 << 11)
    rng = random.Random(23)
    texts = ["a" * 3000, "ab" * 900, "abc" * 300 + prose(rng, 80), prose(rng, 900), prose(rng, 20) + "a" * 405]
    texts.append(texts[3][500:2500])
    got = by_id(suffix_dedup.remove_repeats(frame(spark, texts)))
    for i, (gone, spans, kept) in enumerate(brute.kept_bytes(texts)):
        assert (got[i]["n_removed"], got[i]["n_spans"], bytes(got[i]["kept"])) == (gone, spans, kept), i


def test_only_texts_that_lose_something_move(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "cast(id as string) as _part", "xxhash64(id) as rid")
    wanted = set(range(0, 3000, 7))
    losing, rest = suffix_dedup.parted(docs, "rid", docs.where("doc_id % 7 = 0").select("rid"))
    assert losing.columns == rest.columns == docs.columns
    some, others = ([r["doc_id"] for r in x.collect()] for x in (losing, rest))
    assert wanted <= set(some) and len(some) < len(wanted) + 30 and sorted(some + others) == list(range(3000))
    assert suffix_dedup.parted(docs, "rid", docs.where("false"))[1].count() == 3000
    plan = losing._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_periodic_text_moves_few_bytes():
    data = np.frombuffer(b"x" * 20_000, np.uint8)
    prints, _, counts, _ = suffix_dedup.merged_runs(*suffix_dedup.anchored_runs(data))
    assert len(prints) <= 2 and counts.sum() == 20_000 - suffix_dedup.LENGTH + 1


def test_the_sample_sketch_passes_pairs_at_the_threshold():
    rng = np.random.default_rng(24)
    for percent, (bands, rows) in near_dedup.LAYOUTS.items():
        samples = bands * rows
        least, most = near_dedup.least_estimate(samples, percent)
        assert least < percent / 100 - 0.1
        passed, guesses = 0, []
        for _ in range(300):
            n = 400
            shared = round(n * 2 * percent / (100 + percent))
            both, a, b = (rng.integers(0, 1 << 63, k, np.uint64) for k in (shared, n - shared, n - shared))
            sketches = [near_dedup.sample_sketch(near_dedup.min_hashes(np.unique(np.concatenate([both, x])), samples)) for x in (a, b)]
            apart = int(np.bitwise_count((sketches[0] ^ sketches[1]).view(np.uint64)).sum())
            passed += apart <= most
            guesses.append(near_dedup.estimate(apart, samples))
        assert passed == 300 and abs(np.mean(guesses) - percent / 100) < 0.02


def counted(text):
    """The base columns of the rules, word by word."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(i, i + 3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again), failed


def test_rule_counts(spark):
    rng = random.Random(25)
    texts = [None, "", " \n\t", "a b c a b c a b c", "x\n\nx\n y\nx", "é # * 日本 ½ | <>&", "\x1c \x85 word"] + [prose(rng, n) + "\n" + prose(rng, 3) * k for n, k in ((49, 0), (60, 1), (80, 30))] + [" ".join(["the cat"] * 60)]
    labels = spark.createDataFrame([(7, 1), (8, 0)], "doc_id bigint, quality int")
    got = by_id(quality_rules.apply_rules(frame(spark, texts), labels))
    for i, text in enumerate(texts):
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == counted(text), i
        assert not (got[i]["base_failed"] and got[i]["kept"])


def test_a_label_does_not_reach_its_own_score(spark):
    rng = random.Random(26)
    texts = [prose(rng, 80) + (" $$ %%" * 20 if i % 4 == 0 else "") for i in range(120)]
    docs = frame(spark, texts)
    quality = [int(i % 4 != 0) for i in range(120)]
    run = lambda q: by_id(quality_classifier.classify(docs, spark.createDataFrame(list(enumerate(q)), "doc_id bigint, quality int")))
    before = run(quality)
    assert np.mean([before[i]["kept"] == bool(quality[i]) for i in range(120)]) > 0.95  # by models that have not seen the row
    flipped = list(quality)
    flipped[5] = 0
    after = run(flipped)
    assert after[5]["path_posterior"] == pytest.approx(before[5]["path_posterior"], abs=0.02) and after[5]["kept"]
    same_fold = [i for i in range(120) if quality_classifier.FOLDS and i != 5 and after[i]["host_posterior"] != before[i]["host_posterior"]]
    assert same_fold  # the flip is seen elsewhere


def segmentations(word, p):
    """The probability of a word as the sum over every way to cut it."""
    total = 0.0
    for cuts in itertools.product((0, 1), repeat=len(word) - 1):
        parts, at = [], 0
        for i, cut in enumerate((*cuts, 1), 1):
            if cut:
                parts.append(word[at:i])
                at = i
        total += math.prod(p.get(x, language_id.FLOOR if len(x) == 1 else 0.0) for x in parts)
    return total


def test_languages_by_enumerated_segmentations(spark, monkeypatch):
    rng = random.Random(27)
    kinds = {"xx": ["the", "ing", "er", "on"], "yy": ["que", "os", "ci", "la"]}
    make = lambda lang, n: " ".join("".join(rng.choice(kinds[lang]) for _ in range(2)) for _ in range(n))
    rows = [(i, make(lang, 30), lang, "s", 1, 1) for i, lang in enumerate(["xx", "yy"] * 20)]
    rows += [(90, "½ ² Ⅷ 12", "xx", "s", 1, 1), (91, "नमस्ते दुनिया", None, "s", 1, 1), (92, "the os", None, "s", 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, extra int")
    model = language_id.fit(docs)
    got = by_id(language_id.identify(docs))
    assert (got[90]["lang_pred"], got[90]["score"]) == ("und", 0.0) and got[91]["lang_pred"] != "und"
    assert language_id.words("नमस्ते x½y") == ["▁नमस्ते", "▁x", "▁y"]
    for i in (0, 1, 92):
        text = rows[i][1] if i < 40 else "the os"
        logs = {lang: sum(math.log(max(segmentations(w, p), 1e-300)) for w in language_id.words(text)) for lang, p in model.items()}
        best = max(sorted(logs), key=logs.get)
        assert got[i]["lang_pred"] == best and got[i]["score"] == pytest.approx(1 / sum(math.exp(max(x - logs[best], -700)) for x in logs.values()))


def test_long_words_are_scored_whole():
    p = {"a": 0.3, "b": 0.3, "ab": 0.2, "▁": 0.2}
    scorer = language_id.Scorer({"l": p})
    word = "▁" + "ab" * 3000
    assert scorer.log_words([word])[0, 0] == pytest.approx(math.log(0.2) + 3000 * math.log(0.29), rel=1e-6)
    counts = language_id.expected_counts({word: 1}, p)
    assert counts["ab"] == pytest.approx(3000 * 0.2 / 0.29, rel=1e-6) and counts["▁"] == pytest.approx(1)
    assert scorer.score([word[1:]]) == [("l", 1.0)]


def test_toxicity_weights_and_scores_are_those_of_the_definition():
    rng = random.Random(28)
    texts = [prose(rng, 30) + (" badword" if i % 3 == 0 else "") for i in range(90)]
    y = np.array([i % 3 == 0 for i in range(90)])
    seen = np.zeros(linear.PLACES, bool)
    rows = [linear.distinct(toxicity.features(t), seen) for t in texts]
    model = linear.fit(rows, y, np.arange(90) % 5, 5)
    # an n-gram of all toxic texts and no others: its log-count ratio by hand
    place = next(iter(linear.gram_places("badwor", (6,), True)))[1]
    a, b = sum(place in r for r, t in zip(rows, y) if t), sum(place in r for r, t in zip(rows, y) if not t)
    assert (a, b) == (30, 0) and linear.log_count_ratios(np.array([30.0]), np.array([0.0]), 30, 60)[0] == pytest.approx(math.log(31 / 32) - math.log(1 / 62))
    scorer = linear.Scorer(model)
    for text, row in list(zip(texts, rows))[:10]:
        column = {int(p): k for k, p in enumerate(model.places)}
        odds = sum(float(model.weights[-1][column[int(p)]]) for p in row if int(p) in column) + model.intercepts[-1]
        assert scorer.odds(toxicity.features(text)) == pytest.approx(model.slope * odds + model.shift, rel=1e-5)
    assert np.mean([(scorer.probability(toxicity.features(t), i % 5) > 0.5) == y[i] for i, t in enumerate(texts)]) > 0.95


def test_the_pipeline_is_its_stages(spark, tmp_path):
    import public_tokenizers
    import tiktoken

    rng = random.Random(29)
    item = prose(rng, 30)
    passage = prose(rng, 120)
    texts = near_copies(rng, 6, 120, (0, 2)) + [prose(rng, 70) for _ in range(6)] + [f"{prose(rng, 40)} {passage} {prose(rng, 40)}" for _ in range(2)] + [f"{prose(rng, 30)} {item}", None, "", "one two"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    sets = {i: brute.shingles(t) for i, t in enumerate(texts)}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    left = [i for i in sets if root(i) == i]
    cut = dict(zip(left, plain_cut([texts[i] or "" for i in left])))
    left = [i for i in left if cut[i] or not texts[i]]
    left = [i for i in left if not brute.hits(cut[i], [(1, item)])[1]]
    ranks = bpe_transducer.read_ranks(public_tokenizers.path(bpe_transducer.VOCABULARY))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {i: library.encode_ordinary(cut[i]) for i in left}


def test_the_pipeline_takes_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id bigint, text string, lang string, source string, n_chars bigint"), ("labels", "doc_id bigint, quality int, toxic int"), ("benchmark", "item_id bigint, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
