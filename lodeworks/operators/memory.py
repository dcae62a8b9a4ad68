"""Project memory: nodes(node_id, section, timestamp, status, data), incidents, and claims checked against the code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HIDDEN = ["REFUTED", "SUPERSEDED"]


def visible(memory: DataFrame) -> DataFrame:
    """Nodes that still hold."""
    return memory.where(~F.coalesce(F.col("status"), F.lit("")).isin(HIDDEN))


def latest_state(log: DataFrame, key: str, ts: str, state: str) -> DataFrame:
    """(key, state, ts): the last state of each key in an event log."""
    return log.groupBy(key).agg(F.max_by(state, ts).alias(state), F.max(ts).alias(ts))


def status_distribution(memory: DataFrame) -> DataFrame:
    """(status, n)."""
    return memory.groupBy(F.coalesce("status", F.lit("ACTIVE")).alias("status")).agg(F.count("*").alias("n"))


def false_retractions(log: DataFrame, key: str, ts: str, state: str) -> DataFrame:
    """One row: retracted nodes, those restored later, and their rate."""
    at = log.groupBy(key).agg(F.min(F.when(F.col(state) == "REFUTED", F.col(ts))).alias("out"), F.max(F.when(F.col(state) == "ACTIVE", F.col(ts))).alias("back")).where("out is not null")
    both = at.agg(F.count("*").alias("retracted"), F.count_if(F.col("back") > F.col("out")).alias("restored"))
    return both.withColumn("rate", F.round(F.coalesce(F.try_divide("restored", "retracted"), F.lit(0.0)), 6))


def matching_incidents(incidents: DataFrame, symptoms: DataFrame, least: int = 2) -> DataFrame:
    """(symptom_id, incident_id, common): incidents that share words with a symptom.

    incidents: (incident_id, text); symptoms: (symptom_id, text). The join is on words, not on all pairs.
    """
    split = r"[^\p{L}\p{N}_]+"
    a = incidents.select("incident_id", F.explode(F.array_distinct(F.split(F.lower("text"), split))).alias("w")).where("length(w) > 3")
    b = symptoms.select("symptom_id", F.explode(F.array_distinct(F.split(F.lower("text"), split))).alias("w")).where("length(w) > 3")
    return b.join(a, "w").groupBy("symptom_id", "incident_id").agg(F.count("*").alias("common")).where(F.col("common") >= least)


def root_causes(incidents: DataFrame, symptoms: DataFrame, commits: DataFrame | None = None) -> DataFrame:
    """(symptom_id, cause, score): causes of like incidents by common words, successful fixes twice; with commits
    (hash, message) also those whose message shares two words or more with the symptom, as ``commit <hash>`` (R38).
    """
    m = matching_incidents(incidents.select("incident_id", F.col("symptom").alias("text")), symptoms)
    s = m.join(incidents.select("incident_id", "root_cause", "success"), "incident_id")
    known = s.groupBy("symptom_id", F.col("root_cause").alias("cause")).agg(F.sum(F.col("common") * F.when(F.col("success"), 2).otherwise(1)).alias("score"))
    if commits is None:
        return known
    near = matching_incidents(commits.select(F.col("hash").alias("incident_id"), F.col("message").alias("text")), symptoms)
    return known.unionByName(near.select("symptom_id", F.concat(F.lit("commit "), "incident_id").alias("cause"), F.col("common").alias("score")))


def verdicts(anchors: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """(key, verdict, found, anchors): FOUND if every anchor is in the code, NOT_FOUND if none, else INCONCLUSIVE.

    anchors: (key, kind, anchor); present: (kind, anchor).
    """
    at = anchors.join(present.select("kind", "anchor").distinct().withColumn("hit", F.lit(True)), ["kind", "anchor"], "left")
    out = at.groupBy(key).agg(F.count_if(F.col("hit").isNotNull()).alias("found"), F.count("*").alias("anchors"))
    return out.withColumn("verdict", F.when(F.col("found") == F.col("anchors"), "FOUND").when(F.col("found") == 0, "NOT_FOUND").otherwise("INCONCLUSIVE"))


def stored_verdicts(memory: DataFrame, checked: DataFrame, key: str = "node_id") -> DataFrame:
    """Statuses after a check; terminal ones stay."""
    at = memory.join(checked.select(key, "verdict"), key, "left")
    return at.withColumn("status", F.when(F.col("status").isin(HIDDEN), F.col("status")).when(F.col("verdict") == "NOT_FOUND", "STALE").otherwise(F.col("status"))).drop("verdict")


def budgeted(parts: DataFrame, group: str, priority: str, key: str, tokens: str, budget: int) -> DataFrame:
    """Sections in order of priority while their running sum fits the budget."""
    from pyspark.sql import Window as W

    w = W.partitionBy(group).orderBy(priority, key).rowsBetween(W.unboundedPreceding, W.currentRow)
    return parts.withColumn("running", F.sum(tokens).over(w)).where(F.col("running") <= budget)
