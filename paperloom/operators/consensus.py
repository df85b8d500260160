"""Claims to clusters, verdicts and a report."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..functions.vocabulary import STANCES, VERDICTS

THRESHOLD = 0.30


def prepared(claims: DataFrame, auto_stance: bool = True) -> DataFrame:
    """Claims with text; stance by lexicon where asked for or not valid, study UNKNOWN where missing."""
    own = F.col("stance") if "stance" in claims.columns else F.lit(None).cast("string")
    by_words = text.stance(F.col("claim_text"))
    valid = F.coalesce(own.isin(*STANCES), F.lit(False))
    study = text.given(F.col("study_id"))
    return claims.where(text.strip(F.col("claim_text")) != "").withColumns(
        {"stance": by_words if auto_stance else F.when(valid, own).otherwise(by_words), "study_id": F.coalesce(study, F.lit("UNKNOWN"))}
    )


def clusters(claims: DataFrame, threshold: float = THRESHOLD, group: str = "rq_id", order: str = "claim_seq", similarity=None) -> DataFrame:
    """Adds ``cluster_no``: in order, each claim joins the leader most like it, the
    first of equals, if that reaches the threshold; otherwise it becomes a leader.

    Leaders depend on all claims before, so a question is one sequential task; its
    words are found beforehand by Catalyst.  ``similarity`` takes two claim texts.
    """
    words = claims.withColumn("_words", text.content_words(F.col("claim_text")))

    def lead(rows: pd.DataFrame) -> pd.DataFrame:
        leaders, out = [], []
        rows = rows.sort_values(order, kind="stable")
        for claim, own in zip(rows["claim_text"], rows["_words"].map(frozenset)):
            best, like = -1, 0.0
            for k, (other, theirs) in enumerate(leaders):
                s = similarity(claim, other) if similarity else (len(own & theirs) / len(own | theirs) if own and theirs else 0.0)
                if s > like:
                    best, like = k, s
            if best < 0 or like < threshold:
                best = len(leaders)
                leaders.append((claim, own))
            out.append(best + 1)
        return rows.drop(columns="_words").assign(cluster_no=out)

    schema = T.StructType([*claims.schema.fields, T.StructField("cluster_no", T.IntegerType())])
    return words.groupBy(group).applyInPandas(lead, schema)


def study_stances(claims: DataFrame, *keys: str) -> DataFrame:
    """The majority stance of each study within ``keys``; of equals the first seen."""
    n = claims.groupBy(*keys, text.strip(F.col("study_id")).alias("study_id"), "stance").agg(F.count("*").alias("n"), F.min("claim_seq").alias("seen"))
    first = Window.partitionBy(*keys, "study_id").orderBy(F.desc("n"), "seen")
    return n.withColumn("_k", F.row_number().over(first)).where("_k = 1").select(*keys, "study_id", "stance")


def verdict(positive: Column, negative: Column, neutral: Column, studies: Column) -> Column:
    agreed, opposing = F.greatest(positive, negative), F.least(positive, negative)
    return (
        F.when(studies < 2, "PROVISIONAL")
        .when(neutral / F.greatest(studies, F.lit(1)) > 0.5, "UNRESOLVED")
        .when((opposing >= 1) & (opposing * 3 >= agreed + opposing), "ACTIVE_DEBATE")
        .otherwise("HIGH_CONSENSUS")
    )


def verdicts(claims: DataFrame, *keys: str) -> DataFrame:
    """Per group: studies, studies of each stance, verdict, score and theme."""
    of = study_stances(claims, *keys)
    count = lambda s: F.count_if(F.col("stance") == s)
    stats = of.groupBy(*keys).agg(*(count(s).alias(s.lower()) for s in STANCES), F.count("*").alias("n_studies"), F.array_sort(F.collect_set("study_id")).alias("studies"))
    score = F.col("entailment_score") if "entailment_score" in claims.columns else F.lit(0.0)
    theme = claims.groupBy(*keys).agg(F.max_by("claim_text", F.struct(score, -F.length("claim_text"), -F.col("claim_seq"))).alias("theme"), F.count("*").alias("n_claims"))
    p, n, u, s = (F.col(c) for c in ("positive", "negative", "neutral", "n_studies"))
    return stats.join(theme, list(keys)).withColumns({"verdict": verdict(p, n, u, s), "consensus_score": F.round(F.greatest(p, n) / F.greatest(s, F.lit(1)), 3)})


def bucket_order(groups: DataFrame) -> DataFrame:
    """Adds ``place`` within each verdict: agreement from the highest, debates from the
    lowest, the others by studies; then by cluster."""
    score = F.when(F.col("verdict") == "HIGH_CONSENSUS", -F.col("consensus_score")).when(F.col("verdict") == "ACTIVE_DEBATE", F.col("consensus_score")).otherwise(0.0)
    return groups.withColumn("place", F.row_number().over(Window.partitionBy("rq_id", "verdict").orderBy(score, "n_studies", "cluster_no")))


def analyze(claims: DataFrame, threshold: float = THRESHOLD, auto_stance: bool = True, similarity=None) -> DataFrame:
    """One row for each cluster of each question, with its verdict and place."""
    found = clusters(prepared(claims, auto_stance), threshold, similarity=similarity)
    return bucket_order(verdicts(found, "rq_id", "cluster_no"))


def totals(groups: DataFrame, claims: DataFrame) -> DataFrame:
    """(rq_id, verdict, clusters, place-ordered cluster numbers, input_claims, total_groups) of each question."""
    said = claims.groupBy("rq_id").agg(F.count("*").alias("input_claims"))
    per = groups.groupBy("rq_id").agg(F.count("*").alias("total_groups"))
    buckets = groups.groupBy("rq_id", "verdict").agg(
        F.count("*").alias("clusters"), F.transform(F.array_sort(F.collect_list(F.struct("place", "cluster_no"))), lambda x: x["cluster_no"]).alias("cluster_nos")
    )
    return buckets.join(said, "rq_id").join(per, "rq_id")


def totals_of(groups: DataFrame, claims: DataFrame) -> dict:
    """The same as one document, for a report file: the counts, and the clusters of each verdict."""
    out: dict = {"input_claims": claims.count(), "total_groups": groups.count(), "groups": {v: [] for v in VERDICTS}}
    for row in groups.orderBy("verdict", "place").toLocalIterator():
        out["groups"].setdefault(row["verdict"], []).append(row.asDict())
    return out


def report(groups: DataFrame, claims: DataFrame) -> str:
    """Markdown of agreed and debated clusters of one question, for people to read."""
    rows = groups.where(F.col("verdict").isin(*VERDICTS[:2])).orderBy("place").collect()
    listed: dict[int, list] = {}
    for c in claims.orderBy("claim_seq").collect():
        listed.setdefault(c["cluster_no"], []).append(c)
    titles = dict(zip(VERDICTS, ("High-Consensus Findings", "Active Debates")))
    of = lambda name: [g for g in rows if g["verdict"] == name]
    out = ["# Consensus Cartographer Report", "", f"- **High-Consensus Clusters**: {len(of(VERDICTS[0]))}", f"- **Active Debates**: {len(of(VERDICTS[1]))}", ""]
    for name, title in titles.items():
        out += [f"## {title}", ""]
        if not of(name):
            out += ["_No clusters in this category._", ""]
        for g in of(name):
            stances = ", ".join(f"{s}: {g[s.lower()]}" for s in sorted(STANCES))
            out += [
                f"### C{g['cluster_no']} — {g['theme']}", "", f"- **Consensus score**: {g['consensus_score']:.2f}",
                f"- **Supporting studies ({g['n_studies']})**: {', '.join(g['studies'])}", f"- **Stance distribution (per study)**: {stances}", "",
                "**Supporting claims:**", "",
            ]
            for c in listed.get(g["cluster_no"], ()):
                tokens = c["citation_tokens"] if "citation_tokens" in c else None
                out.append(f"- `{c['stance']}` {c['claim_text']} — [{', '.join(tokens) if tokens else '(no token)'}]")
            out.append("")
    return "\n".join(out)
