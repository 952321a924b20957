"""Decisions: policy by type and intent, a reviewer's overrides, an adviser's tightening. A legal hold never removes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed


def checked_intent(intent: str, strict: bool = True) -> str:
    """Unknown intents are refused or, for a preview, taken as public sharing."""
    if intent in fixed.INTENTS:
        return intent
    if strict:
        raise ValueError(f"unknown intent {intent!r}; known are {', '.join(fixed.INTENTS)}")
    return "public_sharing"


def policy_matrix(spark: SparkSession) -> DataFrame:
    """type, intent, action: 80 rows."""
    rows = [(t, i, a) for t, actions in fixed.POLICY.items() for i, a in zip(fixed.INTENTS, actions, strict=True)]
    return spark.createDataFrame(rows, "type string, intent string, action string")


def action_of(type_: Column, intent: str) -> Column:
    """The matrix as an expression, for arrays of findings; what it doesn't name is WARN."""
    pairs = [F.lit(x) for t, actions in fixed.POLICY.items() for x in (t, actions[fixed.INTENTS.index(intent)])]
    return held_back(F.coalesce(F.try_element_at(F.create_map(*pairs), type_), F.lit("WARN")), F.lit(intent))


def held_back(action: Column, intent: Column) -> Column:
    return F.when((intent == "legal_hold") & (action == "REMOVE"), F.lit("KEEP")).otherwise(action)


def decide(rows: DataFrame, intent: str, matrix: DataFrame | None = None) -> DataFrame:
    """decision of every finding; matrix: another policy as type, intent, action, of any size: Spark chooses the join by it."""
    intent = checked_intent(intent)
    own = (F.broadcast(policy_matrix(rows.sparkSession)) if matrix is None else matrix).filter(F.col("intent") == intent).select(F.col("type").alias("_type"), F.col("action").alias("_action"))
    known = F.when(F.col("_action").isin(fixed.ACTIONS), F.col("_action")).otherwise(F.lit("WARN"))
    joined = rows.join(own, F.col("type") == F.col("_type"), "left")
    return joined.withColumn("decision", held_back(known, F.lit(intent))).drop("_type", "_action")


def decide_all(rows: DataFrame) -> DataFrame:
    """Each finding under each of the four intents (column intent)."""
    every = rows.withColumn("intent", F.explode(F.array(*[F.lit(i) for i in fixed.INTENTS])))
    own = policy_matrix(rows.sparkSession).withColumnsRenamed({"type": "_type", "intent": "_intent", "action": "_action"})
    joined = every.join(F.broadcast(own), (F.col("type") == F.col("_type")) & (F.col("intent") == F.col("_intent")), "left")
    return joined.withColumn("decision", held_back(F.coalesce("_action", F.lit("WARN")), F.col("intent"))).drop("_type", "_intent", "_action")


def apply_overrides(decided: DataFrame, overrides: DataFrame, intent: str, doc_id: str = "doc_id") -> DataFrame:
    """A reviewer's choices (doc_id, id, choice) win where they are actions; of several for a finding, the last by value."""
    own = overrides.filter(F.col("choice").isin(fixed.ACTIONS)).groupBy(F.col(doc_id).alias("_doc"), F.col("id").alias("_id")).agg(F.max("choice").alias("_choice"))
    joined = decided.join(own, (F.col(doc_id) == F.col("_doc")) & (F.col("id") == F.col("_id")), "left")
    return joined.withColumn("decision", held_back(F.coalesce("_choice", "decision"), F.lit(checked_intent(intent)))).drop("_doc", "_id", "_choice")


def override_all(decided: DataFrame, choice: str, intent: str) -> DataFrame:
    """One choice for every finding."""
    if choice not in fixed.ACTIONS:
        return decided
    return decided.withColumn("decision", held_back(F.lit(choice), F.lit(checked_intent(intent))))


def judge_payload(decided: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """What an outside adviser may see: no preview, no value."""
    return decided.select(doc_id, "id", "type", "location", "visibility", "severity", "value_hash", "decision")


def apply_advice(decided: DataFrame, advice: DataFrame, doc_id: str = "doc_id", order: str = "advice_no") -> DataFrame:
    """The last advice of each finding: its note stays if it isn't blank, and it may only tighten KEEP to WARN."""
    last = Window.partitionBy(doc_id, "id").orderBy(F.col(order).desc())
    own = advice.withColumn("_n", F.row_number().over(last)).filter("_n = 1").select(F.col(doc_id).alias("_doc"), F.col("id").alias("_id"), F.col("recommend").alias("_recommend"), F.trim(F.coalesce("note", F.lit(""))).alias("_note"))
    joined = decided.join(own, (F.col(doc_id) == F.col("_doc")) & (F.col("id") == F.col("_id")), "left")
    tightened = F.when((F.col("_recommend") == "WARN") & (F.col("decision") == "KEEP"), F.lit("WARN")).otherwise(F.col("decision"))
    note = F.when(F.coalesce("_note", F.lit("")) != "", F.col("_note")).otherwise(F.col("note") if "note" in decided.columns else F.lit(""))
    return joined.withColumn("decision", tightened).withColumn("note", note).drop("_doc", "_id", "_recommend", "_note")
