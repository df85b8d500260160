"""Closed vocabularies: word lists, keyword ladders and patterns."""

from __future__ import annotations

# Results depend on these exact words, keys and patterns.

SECTION_KEYWORDS = {
    "abstract_intro": (
        "abstract", "introduction", "intro", "background", "overview", "motivation", "related work", "prior art",
    ),
    "methodology": (
        "method", "methodology", "study design", "experimental setup", "experiment design", "dataset",
        "data collection", "material", "implementation", "protocol", "architecture", "preprocessing",
    ),
    "results_empirical": (
        "result", "finding", "evaluation", "ablation", "experiment", "empirical", "performance", "analysis",
        "benchmark", "quantitative", "qualitative",
    ),
    "discussion_limitations": (
        "discussion", "limitation", "threats to validity", "future work", "conclusion", "concluding",
    ),
}
OTHER_SECTION = "other"

POSITIVE_WORDS = (
    "improve", "improvement", "improves", "improved", "increase", "increases", "increased", "outperform",
    "outperforms", "outperformed", "outperforming", "better", "higher", "gain", "gains", "boost", "boosts",
    "boosted", "enable", "enables", "enhance", "enhances", "enhancement", "superior", "advantage",
    "reduces error", "fewer errors", "successful", "viable", "greatest", "best", "strongly",
)
NEGATIVE_WORDS = (
    "not", "no", "none", "never", "fails", "failed", "failure", "without", "unable", "decline", "decreases",
    "decrease", "decreased", "worse", "lower", "negative", "limited", "limitation", "insufficient", "negligible",
    "no significant", "no significant difference", "not significant", "trade-off", "tradeoff", "overhead",
    "adverse", "harmful", "difficulty", "challenge", "does not", "did not", "do not", "cannot", "can't",
    "inferior", "lacks", "lack", "despite", "however", "but", "although", "contrary", "rather than",
)
STOPWORDS = (
    "a", "an", "the", "and", "or", "of", "to", "in", "for", "on", "with", "as", "by", "at", "from", "is", "are",
    "was", "were", "be", "been", "being", "this", "that", "these", "those", "it", "its", "their", "our", "your",
    "his", "her", "we", "you", "i", "they", "them", "about", "into", "over", "under", "between", "out", "up",
    "down", "off", "high", "low", "more", "most", "less", "least", "new", "study", "studies", "paper", "papers",
    "results", "findings", "evidence", "data", "method", "methods", "approach", "proposed", "using", "used", "use",
    "show", "shown", "demonstrates", "demonstrating", "indicate", "indicated", "report", "reported", "found",
)

#: In the order in which they are applied: (pattern, replacement).
REDACTIONS = (
    (r"https?://orcid\.org/\d{4}-\d{4}-\d{4}-\d{3}[\dX]", "[ORCID REDACTED]"),
    (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "[EMAIL REDACTED]"),
    (r"\d{4}-\d{4}-\d{4}-\d{3}[\dX]", "[ORCID REDACTED]"),
    (r"[\+]?[(]?\d{1,4}[)]?[-\s.]?\d{1,4}[-\s.]?\d{1,9}", "[PHONE REDACTED]"),
    (r"(?i)(?:NIH|NSF|ERC|DFG|grant\s+(?:number\s+)?)[\s:]?[A-Z0-9\-]+", "[GRANT REDACTED]"),
)

#: Weight of each extracted field in the confidence of an extraction.
FIELD_WEIGHTS = {
    "title": 0.15, "authors": 0.10, "abstract": 0.15, "year": 0.10, "doi": 0.10, "venue": 0.10, "keywords": 0.10,
    "contributions": 0.10, "limitations": 0.05, "future_work": 0.05,
}

STANCES = ("POSITIVE", "NEGATIVE", "NEUTRAL")
VERDICTS = ("HIGH_CONSENSUS", "ACTIVE_DEBATE", "UNRESOLVED", "PROVISIONAL")

ID_PREFIXES = {
    "workspace": ("WSP-",), "protocol": ("PRT-",), "run": ("RUN-",), "corpus": ("COR-",), "study": ("STU-", "SCI-"),
    "source_record": ("REC-",), "document": ("DOC-",), "chunk": ("CHK-",), "claim": ("CLM-",), "evidence": ("EV-",),
    "screening_decision": ("SCR-",), "artifact": ("ART-",), "audit_event": ("AUD-", "EVT-"),
}
CHUNK_ID_VERSION = "rag-chunk-identity-v1"
