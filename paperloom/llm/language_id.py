"""Operator 5: language by segmentation-marginalised unigrams.

Each language has probabilities of the pieces of a fixed public vocabulary, all of
them, plus a small floor for single characters.  The probability of a word is the
sum over all its segmentations into pieces, found by the forward algorithm; a
text's is the product over its words, lower-cased runs of letters with the marks
that follow them, whole however long they are.  The piece probabilities are fitted
by expectation maximisation: forward and backward sums give expected piece counts
over all segmentations of the training words.

Training reads a bounded sample: of the rows with a language and a text that are
not held out, the first ``ROWS_OF_LANG`` of each language by a hash of the id, of at
most ``MOST_LANGS`` languages, those with most rows.  Rare languages are so learned
from all rows they have.  The score is the posterior of the language among those
learned.  A text that is null or has no letter gets ``und`` and 0; a number such as
a half or a Roman numeral sign is no letter.  If nothing can be learned, every text
is ``und``.  Ties go to the language first in order.  A row without an id is scored,
but neither held out nor trained on.  Columns but id, text and language are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, frugal, small_batches

VOCABULARY = "piece_bpe_32k.model"
FOLDS, HELD_OUT = 4, 2
ROWS_OF_LANG, MOST_LANGS, ROUNDS = 300, 400, 3
#: Words that a worker remembers, and the longest of them.
MOST_WORDS, MEMO_CHARS = 300_000, 64
UNKNOWN, FLOOR = "und", 1e-7
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
#: Where all characters are of these, the letters are ``_LETTERS`` and no mark occurs.
_OTHER = re.compile(r"[^\x00-ɏ‐-⁞€]")
_PLAIN, _FULL = re.compile(f"[{_LETTERS}]+"), regex.compile(r"\p{L}[\p{L}\p{M}]*")
_START = "▁"
_LIFT = 1e100


def words(text: str) -> list[str]:
    text = text.lower()
    return [_START + word for word in (_FULL if _OTHER.search(text) else _PLAIN).findall(text)]


def vocabulary_pieces(name: str = VOCABULARY) -> set[str]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return {piece for piece in found if piece}


def _sums(word: str, p: dict[str, float], longest: int, backwards: bool) -> tuple[list[float], list[int]]:
    """Sums over the segmentations of every beginning of ``word`` (of every end, if ``backwards``).

    The value at a place is the first list's times ``_LIFT`` to the power of minus the
    second's, which keeps long words within range.
    """
    n, get = len(word), p.get
    sums, lifts, lift = [0.0] * (n + 1), [0] * (n + 1), 0
    order = range(n, -1, -1) if backwards else range(n + 1)
    at = list(order)
    sums[at[0]] = 1.0
    for k in range(1, n + 1):
        j, total = at[k], 0.0
        for back in range(1, min(longest, k) + 1):
            i = at[k - back]
            value = get(word[j:i] if backwards else word[i:j], FLOOR if back == 1 else 0.0)
            if value:
                total += sums[i] * value
        sums[j], lifts[j] = total, lift
        if total < 1 / _LIFT:
            low = range(max(0, k - longest + 1), k + 1)
            if max(sums[at[x]] for x in low) < 1 / _LIFT:
                lift += 1
                for x in low:
                    sums[at[x]] *= _LIFT
                    lifts[at[x]] = lift
    return sums, lifts


def expected_counts(counts: dict[str, int], p: dict[str, float]) -> Counter:
    """Expected piece counts over all segmentations of the words; ``p`` holds every piece that may occur."""
    total: Counter = Counter()
    longest = max(map(len, p), default=1)
    for word, times in counts.items():
        n = len(word)
        forward, up = _sums(word, p, longest, False)
        backward, down = _sums(word, p, longest, True)
        if forward[n] <= 0:
            continue
        for j in range(1, n + 1):
            for i in range(max(0, j - longest), j):
                piece = word[i:j]
                value = p.get(piece, FLOOR if j - i == 1 else 0.0)
                if value:
                    power = up[n] - up[i] - down[j]
                    part = forward[i] * value * backward[j] / forward[n]
                    total[piece] += times * (part if power == 0 else part * _LIFT**power)
    return total


def train(texts: list[tuple[str, str]], known, rounds: int = ROUNDS) -> dict[str, dict[str, float]]:
    """Piece probabilities by language from (language, text) rows."""
    by_lang: dict[str, Counter] = {}
    for lang, text in texts:
        by_lang.setdefault(lang, Counter()).update(words(text))
    model, longest = {}, max(map(len, known), default=1)
    for lang, counts in sorted(by_lang.items()):
        start: Counter = Counter()
        for word, times in counts.items():
            for j in range(1, len(word) + 1):
                for i in range(max(0, j - longest), j):
                    if j - i == 1 or word[i:j] in known:
                        start[word[i:j]] += times
        p = _normalised(start)
        for _ in range(rounds):
            p = _normalised(expected_counts(counts, p))
        if p:
            model[lang] = p
    return model


def _normalised(counts: Counter) -> dict[str, float]:
    total = sum(counts.values())
    return {piece: n / total for piece, n in counts.items() if n > 0 and n / total > FLOOR}


class Scorer:
    """Log probabilities of words, remembered as rows of one matrix."""

    def __init__(self, model: dict[str, dict[str, float]], most: int = MOST_WORDS):
        self.langs = sorted(model)
        self.piece: dict[str, int] = {}
        for p in model.values():
            for piece in p:
                self.piece.setdefault(piece, len(self.piece))
        #: A row for each piece, then the row of unknown characters and that of no piece.
        self.p = np.full((len(self.piece) + 2, len(self.langs)), FLOOR)
        self.p[: len(self.piece)] = 0.0
        for piece, row in self.piece.items():
            if len(piece) == 1:
                self.p[row] = FLOOR
        self.p[-1] = 0.0
        for k, lang in enumerate(self.langs):
            for piece, value in model[lang].items():
                self.p[self.piece[piece], k] = value
        self.longest = max(map(len, self.piece), default=1)
        self.most = most
        self._forget()

    def _forget(self) -> None:
        self.row: dict[str, int] = {}
        self.logs = np.zeros((0, len(self.langs)))

    def log_words(self, found: list[str]) -> np.ndarray:
        """Forward algorithm over words of one length, all languages at once.

        Only the sums that a piece may still start from are held.
        """
        n, get = len(found[0]), self.piece.get
        unknown, none = len(self.piece), len(self.piece) + 1
        window = [np.ones((len(found), len(self.langs)))]
        lift = np.zeros((len(found), 1))
        for j in range(1, n + 1):
            total = np.zeros_like(window[0])
            for back in range(1, len(window) + 1):
                rows = [get(word[j - back : j], unknown if back == 1 else none) for word in found]
                if back == 1 or any(row != none for row in rows):
                    total += window[-back] * self.p[rows]
            window = [*window[-self.longest + 1 :], total] if self.longest > 1 else [total]
            low = total.max(1) < 1 / _LIFT
            if low.any():
                for held in window:
                    held[low] *= _LIFT
                lift[low] += np.log(_LIFT)
        return np.log(np.maximum(window[-1], 1e-300)) - lift

    def learn(self, found) -> None:
        """Score the words that are not remembered yet."""
        new = [word for word in found if word not in self.row]
        if len(self.row) + len(new) > self.most:
            self._forget()
            new = list(found)
        by_length: dict[int, list[str]] = {}
        for word in new:
            by_length.setdefault(len(word), []).append(word)
        parts = [self.logs]
        for same in by_length.values():
            for word in same:
                self.row[word] = len(self.row)
            parts.append(self.log_words(same))
        if new:
            self.logs = np.concatenate(parts)

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        counts = [Counter(words(text)) if text and self.langs else {} for text in texts]
        self.learn({word for found in counts for word in found if len(word) <= MEMO_CHARS})
        out = []
        for found in counts:
            if not found:
                out.append((UNKNOWN, 0.0))
                continue
            known = [word for word in found if len(word) <= MEMO_CHARS]
            rows = np.fromiter(map(self.row.__getitem__, known), np.int64, len(known))
            total = np.fromiter(map(found.__getitem__, known), float, len(known)) @ self.logs[rows]
            if len(known) < len(found):
                total = total + sum(times * self.log_words([word])[0] for word, times in found.items() if len(word) > MEMO_CHARS)
            k = int(total.argmax())
            out.append((self.langs[k], float(1.0 / np.exp(np.maximum(total - total[k], -700.0)).sum())))
        return out


def _sample(docs: DataFrame, rows: int) -> DataFrame:
    """(doc_id, lang) of the training rows; no text moves to find them.

    A cut-off of the hash, from the count of each language, leaves about twice as many
    as are wanted before they are ranked, however many rows a language has.
    """
    named = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").isNotNull().alias("has_text"))
    named = named.where(F.col("lang").isNotNull() & F.col("has_text") & (fold("doc_id", FOLDS) != HELD_OUT)).select("doc_id", "lang")
    most = named.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS)
    within = 1 << 40
    near = named.join(F.broadcast(most), "lang").where(F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(within)) < F.lit(float(within) * 2 * rows) / F.col("n"))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    return near.distinct().withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= rows).select("doc_id", "lang")


def fit(docs: DataFrame, rows: int = ROWS_OF_LANG) -> dict[str, dict[str, float]]:
    """The model: one task for each language, on its bounded sample."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("text is not null")
    sample = texts.join(F.broadcast(_sample(docs, rows)), ["doc_id", "lang"]).select("lang", "text")

    def run(batches):
        by_lang: dict[str, list] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_lang.setdefault(lang, []).append((lang, text))
        known = vocabulary_pieces() if by_lang else set()
        for lang in sorted(by_lang):
            for _, p in train(sorted(by_lang[lang]), known).items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(p)), pa.array(list(p)), pa.array(list(p.values()))], ["lang", "piece", "p"])

    model: dict[str, dict[str, float]] = {}
    for lang, piece, p in sample.repartition("lang").mapInArrow(frugal(run), "lang string, piece string, p double").collect():
        model.setdefault(lang, {})[piece] = p
    return model


def identify(docs: DataFrame, rows: int = ROWS_OF_LANG) -> DataFrame:
    """Language and score of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(fit(docs, rows))

    def run(batches):
        scorer = Scorer(model.value)
        for batch in batches:
            found = scorer.score(batch.column(2).to_pylist())
            columns = [batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])

    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), F.col("text").cast("string"))
    return keyed.mapInArrow(frugal(run), "doc_id bigint, held_out boolean, lang_pred string, score double")
