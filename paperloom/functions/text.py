"""Column functions over text: built-in expressions, but for vectors, which are handled in Arrow batches."""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as v

SENTENCE_END = r"(?<=[.!?])\s+"
CITATION = r"\[([^\]]+#[^\]]+#[^\]]+)\]"
CONTENT_WORD = r"[a-z0-9][a-z0-9\-]*"


def given(column: Column) -> Column:
    """The value, or null where it is empty."""
    return F.nullif(column.cast("string"), F.lit(""))


def first_given(*columns: Column) -> Column:
    """The first value that is neither null nor empty; blanks count as values."""
    return F.coalesce(*map(given, columns))


def is_present(column: Column) -> Column:
    """Not null and not blank; "0" is a value."""
    return column.isNotNull() & (strip(column.cast("string")) != "")


def strip(column: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


def squeeze(column: Column) -> Column:
    return strip(F.regexp_replace(column, r"(?U)\s+", " "))


def sentences(column: Column, pattern: str = SENTENCE_END) -> Column:
    return F.split(column, pattern)


def word_count(column: Column) -> Column:
    stripped = strip(column)
    return F.when(stripped == "", 0).otherwise(F.size(F.split(stripped, r"(?U)\s+")))


def fingerprint(column: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(column.cast("binary"), 256))


def without_numeral(heading: Column) -> Column:
    """A heading in lower case without its leading numeral."""
    bare = F.regexp_replace(F.lower(heading), r"^(?:[0-9]+(?:\.[0-9]+)*|[ivxlcdm]+)\s*[-:.)]\s*", "")
    return F.regexp_replace(bare, r"^[0-9]+\s+", "")


def section_category(heading: Column) -> Column:
    """The first category any of whose keywords is in the heading."""
    bare = strip(without_numeral(strip(heading)))
    has = lambda words: reduce(Column.__or__, (F.contains(bare, F.lit(w)) for w in words))
    (name, words), *more = v.SECTION_KEYWORDS.items()
    ladder = F.when(has(words), name)
    for name, words in more:
        ladder = ladder.when(has(words), name)
    return ladder.otherwise(v.OTHER_SECTION)


def heading_slug(heading: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(without_numeral(heading), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.coalesce(given(F.substring(slug, 1, 20)), F.lit("sec"))


def citation_token(workspace: Column, paper: Column, doi: Column, filename: Column, section: Column, chunk_id: Column) -> Column:
    """``[owner#section#chunk]``, the owner being the first identity given."""
    owner = F.coalesce(first_given(workspace, paper, doi), filename, F.lit("DOC"))
    slug = given(F.substring(F.regexp_replace(F.lower(F.coalesce(section, F.lit("sec"))), r"[^a-zA-Z0-9]", ""), 1, 10))
    return F.concat(F.lit("["), owner, F.lit("#"), F.coalesce(slug, F.lit("sec")), F.lit("#"), chunk_id, F.lit("]"))


def snippet(text: Column, most: int = 160) -> Column:
    """The first line as a claim fragment: no markup, no trailing token, cut at a
    sentence end near the limit, or else at a word."""
    line = strip(F.substring_index(F.coalesce(text, F.lit("")), "\n", 1))
    line = squeeze(F.regexp_replace(line, r"\*\*+|`+|#{1,6}\s*", " "))
    line = strip(F.regexp_replace(line, r"(?U)\s*\[[^\]]+\]\s*$", ""))
    cut = F.substring(line, 1, most)
    # the last sentence end, if it is among the last 40 characters
    ending = F.length(F.regexp_extract(cut, r"(?s)^(.*[.!?])", 1))
    at_word = F.concat(F.regexp_extract(cut, r"(?s)^(.*) ", 1), F.lit("…"))
    return (
        F.when(F.length(line) <= most, line)
        .when(ending > most - 40, F.substring(line, F.lit(1), ending))
        .when(F.contains(cut, F.lit(" ")), at_word)
        .otherwise(cut)
    )


def claim_units(markdown: Column) -> Column:
    """Bullets if there are any, or else sentences."""
    lines = F.split(markdown, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")
    bullets = F.transform(F.filter(lines, lambda x: F.startswith(strip(x), F.lit("- "))), lambda x: strip(F.substring(x, 3, 1 << 30)))
    units = F.filter(sentences(strip(markdown)), lambda x: x != "")
    return F.when(F.size(bullets) > 0, F.filter(bullets, lambda x: x != "")).otherwise(units)


def citation_tokens(unit: Column) -> Column:
    return F.transform(F.regexp_extract_all(unit, F.lit(CITATION), F.lit(1)), lambda t: F.concat(F.lit("["), t, F.lit("]")))


def claim_text(unit: Column, most: int = 220) -> Column:
    """A unit without its citation tokens; a long one is cut to a snippet."""
    bare = squeeze(F.regexp_replace(unit, CITATION, ""))
    return F.when(F.length(bare) > most, snippet(bare, most)).otherwise(bare)


def content_words(text: Column) -> Column:
    """Distinct words of the lower-cased text that are not stopwords."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(CONTENT_WORD), F.lit(0)))
    return F.array_except(found, F.array(*map(F.lit, v.STOPWORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def stance(text: Column) -> Column:
    """Polarity by lexicon entries that stand between spaces."""
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    hits = lambda words: sum((F.contains(padded, F.lit(f" {w} ")).cast("int") for w in words), F.lit(0))
    good, bad = hits(v.POSITIVE_WORDS), hits(v.NEGATIVE_WORDS)
    score = F.try_divide(good - bad, good + bad)
    return F.when(score >= 0.2, "POSITIVE").when(score <= -0.2, "NEGATIVE").otherwise("NEUTRAL")


def redacted(text: Column) -> Column:
    """Text with addresses, identifiers, numbers and grants replaced, in order."""
    for pattern, replacement in v.REDACTIONS:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def has_personal_data(text: Column) -> Column:
    """Whether any redaction applies to the text as redacted so far."""
    found = F.lit(False)
    for pattern, replacement in v.REDACTIONS:
        found = found | text.rlike(pattern)
        text = F.regexp_replace(text, pattern, replacement)
    return found


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of an array column that have a value, as a matrix, and which they are; all of one length."""
    given = column.is_valid().to_numpy(zero_copy_only=False)
    kept = column.filter(pa.array(given))
    if not len(kept):
        return np.zeros((0, 0)), given
    sizes = np.unique(kept.value_lengths().to_numpy())
    if len(sizes) > 1:
        raise ValueError(f"vectors of one column have lengths {sizes[:5].tolist()}")
    return kept.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(kept), int(sizes[0])), given


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays, in double precision; a zero norm counts as 1.

    In Arrow batches: products are added in the order of the elements, as an expression
    over the arrays would, but a whole batch at a time.
    """

    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        both = pa.array(left.is_valid().to_numpy(zero_copy_only=False) & right.is_valid().to_numpy(zero_copy_only=False))
        (x, _), (y, _) = _matrix(left.filter(both)), _matrix(right.filter(both))
        if x.shape != y.shape:
            raise ValueError(f"vectors have lengths {x.shape[1]} and {y.shape[1]}")
        dot, xx, yy = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
        for p, q in zip(x.T, y.T):
            dot += p * q
            xx += p * p
            yy += q * q
        norm = lambda z: np.where(z == 0, 1.0, np.sqrt(z))
        out = np.full(len(left), np.nan)
        out[both.to_numpy(zero_copy_only=False)] = dot / (norm(xx) * norm(yy))
        return pa.array(out, pa.float64(), mask=~both.to_numpy(zero_copy_only=False))

    return F.arrow_udf(run, "double")(a, b)


def mock_embedding(text: Column, dimension: int = 384) -> Column:
    """A pseudo vector of unit length seeded by the SHA-256 of the text."""

    def run(texts: pa.Array) -> pa.Array:
        given = texts.is_valid().to_numpy(zero_copy_only=False)
        digests = b"".join(hashlib.sha256(x.encode()).digest() for x in texts.to_pylist() if x is not None)
        seeds = np.frombuffer(digests, np.uint8).reshape(-1, 32).astype(np.int64)
        steps = np.arange(dimension)
        raw = ((seeds[:, steps % 32] + 31 * steps) % 256 - 128) / 128.0
        norm = np.sqrt((raw * raw).sum(1, keepdims=True))  # of multiples of 2**-14: exact in any order
        flat = raw / np.where(norm == 0, 1.0, norm)
        offsets = np.append(0, np.cumsum(given) * dimension).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel()), mask=pa.array(~given))

    return F.arrow_udf(run, "array<double>")(text)


def mock_vector(text: str, dimension: int = 384) -> list[float]:
    """The same for one text on the driver."""
    digest = hashlib.sha256(text.encode()).digest()
    raw = [((digest[i % 32] + 31 * i) % 256 - 128) / 128.0 for i in range(dimension)]
    norm = math.sqrt(sum(x * x for x in raw)) or 1.0
    return [x / norm for x in raw]


def heuristic_fields(text: Column) -> Column:
    """Title, DOI, year and abstract by pattern, as a struct; null where not found."""
    year = given(F.regexp_extract(text, r"\b((?:19|20)\d{2})\b", 1)).cast("int")
    doi = F.regexp_replace(given(F.regexp_extract(text, r"10\.\d{4,}/[^\s]+", 0)), r"[.,;]+$", "")
    abstract = F.regexp_extract(text, r"(?s)(?:abstract|Abstract)[:\s]*\n(.+?)(?:\n#|\n\*\*|\z)", 1)
    return F.struct(
        F.nullif(strip(F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1)), F.lit("")).alias("title"),
        doi.alias("doi"),
        year.alias("year"),
        F.nullif(F.substring(strip(abstract), 1, 2000), F.lit("")).alias("abstract"),
    )


def confidence(fields: dict[str, Column]) -> Column:
    """Sum of the weights of the fields that have a value."""
    return F.round(sum((F.when(fields[k].isNotNull(), w).otherwise(0.0) for k, w in v.FIELD_WEIGHTS.items() if k in fields), F.lit(0.0)), 3)


def valid_identifier(kind: str, value: Column) -> Column:
    prefixes = "|".join(v.ID_PREFIXES[kind])
    return F.coalesce(value.rlike(rf"^(?:{prefixes})[A-Za-z0-9][A-Za-z0-9._-]*\z"), F.lit(False))
